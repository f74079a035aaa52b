"""Result status, retirements, non-starters, source fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laplake import constants as C
from laplake.functions.labels import is_unclassified, or_code_number, status_label, team_color
from laplake.functions.numbers import clean_text, double_or, int_or, zero_to_null
from laplake.operators.race import DRIVER, first_available


def status_classes(results: DataFrame) -> DataFrame:
    """Display label and the not-classified mark."""
    return results.withColumn("status_label", status_label("status")).withColumn(
        "not_classified", is_unclassified("status_label"))


def non_starters(status: DataFrame, laps: DataFrame) -> DataFrame:
    """Drivers marked as not started who have no lap in the session."""
    raced = laps.select(*DRIVER).distinct()
    return status.where(status_label("status") == "DNS").join(raced, list(DRIVER), "left_anti")


def race_drivers(status: DataFrame, laps: DataFrame) -> DataFrame:
    """Drivers with laps, then the non-starters."""
    raced = laps.select(*DRIVER).distinct().withColumn("started", F.lit(True))
    absent = non_starters(status, laps).select(*DRIVER).distinct().withColumn("started", F.lit(False))
    return raced.unionByName(absent)


def retirements(status: DataFrame, laps: DataFrame) -> DataFrame:
    """Drivers who retired, with the last lap they reached."""
    last = laps.groupBy(*DRIVER).agg(F.max("lap_number").alias("last_lap"))
    out = status.where(status_label("status").startswith("DNF"))
    return out.join(last, list(DRIVER), "inner").select(
        *DRIVER, or_code_number("code", F.concat(F.lit("D"), F.col("driver_number").cast("string")))
        .alias("code"), "last_lap")


def typed_results(raw: DataFrame) -> DataFrame:
    """Results of the second source, text typed: safe casts and defaults."""
    team = clean_text("team")
    return raw.select(
        "season", "round_number",
        int_or(clean_text("driver_number"), 0).alias("driver_number"),
        clean_text("abbreviation").alias("abbreviation"),
        clean_text("full_name").alias("full_name"),
        team.alias("team"),
        team_color(F.coalesce(team, F.lit(""))).alias("team_color"),
        double_or(clean_text("grid_position")).cast("int").alias("grid_position"),
        double_or(clean_text("finish_position")).cast("int").alias("finish_position"),
        clean_text("status").alias("status"),
        double_or(clean_text("points"), 0.0).alias("points"),
        double_or(clean_text("laps_completed"), 0.0).cast("int").alias("laps_completed"),
        F.lit("").alias("time"), F.lit("").alias("fastest_lap_time"),
        F.lit(None).cast("int").alias("fastest_lap_rank"),
    )


def race_results(primary: DataFrame, secondary: DataFrame, names: tuple[str, str] = ("jolpica", "fastf1")) -> DataFrame:
    """Classification per race from the first source that has it."""
    return first_available(primary, secondary, ["season", "round_number"], names)


def by_finish(results: DataFrame) -> DataFrame:
    """Results of every race in finishing order, unplaced last."""
    place = F.coalesce(zero_to_null("finish_position"), F.lit(C.UNPLACED))
    return results.orderBy("season", "round_number", place, "driver_number")
