"""Seasons, calendars, sessions and what has been processed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laplake.constants import FIRST_SEASON
from laplake.functions.labels import flag_code, race_short_name
from laplake.operators.groups import lookup

RACE = ("season", "round_number")


def season_list(current: DataFrame, first: int | None = FIRST_SEASON) -> DataFrame:
    """Seasons from the newest in ``current.season`` down to ``first``, or to the oldest there."""
    oldest = F.min("season") if first is None else F.lit(first)
    bounds = current.agg(F.max("season").alias("newest"), oldest.alias("oldest"))
    return bounds.where(F.col("newest") >= F.col("oldest")).select(
        F.explode(F.sequence("newest", "oldest", F.lit(-1))).alias("season"))


def season_list_until(spark: SparkSession, year: Column | None = None, first: int = FIRST_SEASON) -> DataFrame:
    """Seasons from the current year down to ``first``."""
    newest = F.year(F.current_date()) if year is None else year
    return season_list(spark.range(1).select(newest.alias("season")), first)


def calendar_status(calendar: DataFrame, processed: DataFrame, today: Column | None = None) -> DataFrame:
    """Calendar rows with flag code, short date, past mark and processed mark."""
    day = F.col("date").try_cast("date")
    now = F.current_date() if today is None else today
    done = processed.select("season", F.col("round_number").alias("round")).distinct().withColumn(
        "_done", F.lit(True))
    return lookup(calendar, done, ["season", "round"]).withColumns({
        "flag": flag_code("country"),
        "short_date": F.coalesce(F.date_format(day, "d MMM"), F.lit("")),
        "is_past": F.coalesce(day < now, F.lit(False)),
        "is_processed": F.coalesce("_done", F.lit(False)),
    }).drop("_done")


def circuit_names(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """Add the circuit's race name by season and round, ``Unknown`` where missing."""
    names = calendar.groupBy("season", F.col("round").alias("round_number")).agg(
        F.min("name").alias("_name"))
    return lookup(rows, names, list(RACE)).withColumn(
        "circuit_name", F.coalesce("_name", F.lit("Unknown"))).drop("_name")


def completed_rounds(results: DataFrame) -> DataFrame:
    """Rounds with results and their short names."""
    return results.select(*RACE, race_short_name("race_name", " GP").alias("race_name")).distinct()


def latest_session(sessions: DataFrame, session_type: str = "Race") -> DataFrame:
    """The most recent session of a type."""
    return (
        sessions.where(F.col("session_type") == session_type)
        .orderBy(F.desc("date_start"), F.desc("session_key")).limit(1)
    )


def sessions_with_data(sessions: DataFrame, laps: DataFrame, years: Sequence[int] | None = None,
                       newest: int = 5) -> DataFrame:
    """Of the newest sessions of each year, those with first-lap data, newest first.

    The first row is the session to use.
    """
    chosen = sessions if years is None else sessions.where(F.col("year").isin(*years))
    by_date = Window.partitionBy("year").orderBy(F.desc("date_start"), F.desc("session_key"))
    recent = chosen.withColumn("_at", F.row_number().over(by_date)).where(F.col("_at") <= newest).drop("_at")
    started = laps.where(F.col("lap_number") == 1).select("session_key").distinct()
    return recent.join(started, ["session_key"], "left_semi").orderBy(
        F.desc("year"), F.desc("date_start"), F.desc("session_key"))


def first_lap_counts(sessions: DataFrame, laps: DataFrame) -> DataFrame:
    """Number of first-lap rows of every session."""
    counts = laps.where(F.col("lap_number") == 1).groupBy("session_key").agg(
        F.count(F.lit(1)).alias("records"))
    return lookup(sessions, counts, ["session_key"]).withColumn(
        "records", F.coalesce("records", F.lit(0)))


def laps_since(laps: DataFrame, cursors: DataFrame) -> DataFrame:
    """Laps after each driver's own cursor; no cursor means all laps."""
    keys = ["session_key", "driver_number"]
    return lookup(laps, cursors, keys).where(
        F.col("lap_number") > F.coalesce("after_lap", F.lit(0))).drop("after_lap")


def new_lap_range(laps: DataFrame) -> DataFrame:
    """How many new laps there are per session, and from which lap to which."""
    return laps.groupBy("session_key").agg(
        F.count(F.lit(1)).alias("new_laps"),
        F.min("lap_number").alias("first_lap"), F.max("lap_number").alias("last_lap"))
