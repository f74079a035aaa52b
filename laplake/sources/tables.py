"""Lap tables on disk: one race, any set of races, the race catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from laplake.functions.numbers import finite

RACE_FOLDER = r"^(\d{4})_round(\d+)"


def read_races(spark: SparkSession, path: str, season: int | None = None,
               round_number: int | None = None) -> DataFrame:
    """Laps partitioned by season and round; filters prune folders."""
    laps = spark.read.parquet(path)
    if season is not None:
        laps = laps.where(F.col("season") == season)
    if round_number is not None:
        laps = laps.where(F.col("round_number") == round_number)
    return laps


def json_safe(df: DataFrame) -> DataFrame:
    """Replace NaN and infinities by NULL in every floating column."""
    return df.withColumns({
        field.name: finite(field.name)
        for field in df.schema.fields if isinstance(field.dataType, (DoubleType, FloatType))
    })


def json_records(df: DataFrame) -> DataFrame:
    """One JSON object per row, NULL fields kept."""
    return json_safe(df).select(
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))


def race_folders(paths: DataFrame, column: str = "folder") -> DataFrame:
    """Season and round from folder names; other names are skipped."""
    season = F.regexp_extract(column, RACE_FOLDER, 1)
    number = F.regexp_extract(column, RACE_FOLDER, 2)
    return paths.where(F.col(column).rlike(RACE_FOLDER)).select(
        season.cast("int").alias("season"), number.cast("int").alias("round_number"))


def available_races(laps: DataFrame) -> DataFrame:
    """Races with data, newest first, from partition columns."""
    return (
        laps.select("season", "round_number").distinct()
        .orderBy(F.desc("season"), F.desc("round_number"))
    )


def races_per_season(races: DataFrame) -> DataFrame:
    return races.groupBy("season").agg(F.count(F.lit(1)).alias("races"))
