"""Text built from lap rows: index documents and prompt inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laplake import constants as C
from laplake.functions.numbers import fixed, fixed_text, nan_to_null, zero_to_null


def _known(name: str, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def _number(name: str, default: float = 0.0) -> Column:
    return F.coalesce(nan_to_null(name), F.lit(default))


def lap_sentence(season: Column | str = "season", round_number: Column | str = "round_number") -> Column:
    """One sentence that describes an enriched lap."""
    advice = F.when(_known("should_pit_soon", False), C.PIT_SOON_TEXT).otherwise(C.PIT_LATER_TEXT)
    return F.format_string(
        "Driver %d in %d Round %d: Lap %d, lap time %.3fs on %s tyres (age %d laps). "
        "Rolling avg %.3fs, delta to personal best +%.3fs. "
        "Tyre degradation rate %.4fs/lap. Stint length %d laps. Strategy assessment: %s.",
        "driver_number", season, round_number, "lap_number", fixed("lap_duration", 3),
        _known("tyre_compound", "unknown"), _known("tyre_age_laps", 0),
        fixed(_number("rolling_avg_lap_time"), 3), fixed(_number("lap_delta"), 3),
        fixed(_number("tyre_degradation_rate"), 4), _known("stint_length", 0), advice,
    )


def vector_id(season: str = "season", round_number: str = "round_number") -> Column:
    return F.format_string("%d_r%d_d%d_l%d", season, round_number, "driver_number", "lap_number")


def lap_documents(features: DataFrame, circuit: Column | None = None) -> DataFrame:
    """Id, metadata and sentence of every enriched lap."""
    return features.select(
        vector_id().alias("id"),
        F.col("season").alias("year"), "round_number",
        (F.lit("unknown") if circuit is None else circuit).alias("circuit"),
        _known("driver_number", 0).alias("driver_number"),
        _known("lap_number", 0).alias("lap_number"),
        _number("lap_duration").alias("lap_duration"),
        _known("tyre_compound", "unknown").alias("tyre_compound"),
        _known("tyre_age_laps", 0).alias("tyre_age_laps"),
        _number("tyre_degradation_rate").alias("tyre_degradation_rate"),
        _known("should_pit_soon", False).alias("should_pit_soon"),
        _known("stint_length", 0).alias("stint_length"),
        lap_sentence().alias("document"),
    )


def pit_note(laps_to_pit: Column, flagged: Column) -> Column:
    """The pit model's advice in words."""
    left = F.format_string("%.1f", fixed(laps_to_pit, 1))
    return (
        F.when(flagged, F.concat(F.lit("pit flag active, ~"), left, F.lit(" laps window")))
        .when(laps_to_pit >= C.NO_PIT_ESTIMATE, C.NO_FLAG_TEXT)
        .otherwise(F.concat(F.lit("no pit flag, estimated "), left, F.lit(" laps left on this set")))
    )


def search_text(circuit: Column | None = None) -> Column:
    """What a lap asks of the lap documents."""
    rate = F.coalesce(F.col("tyre_degradation_rate"), F.lit(0.0))
    return F.format_string(
        "%s tyres %d laps degradation rate %.4f circuit %s lap %d", _known("tyre_compound", "UNKNOWN"),
        _known("tyre_age_laps", 0), fixed(rate, 4), F.lit("Unknown") if circuit is None else circuit, "lap_number")


def strategy_inputs(laps: DataFrame) -> DataFrame:
    """One row of strategy prompt inputs per lap.

    Expects the features, ``circuit_name``, ``total_race_laps``, and ``position``
    and ``gap_to_leader``, which may be NULL. Zero counts as missing.
    """
    rate = F.coalesce(F.col("tyre_degradation_rate"), F.lit(0.0))
    pace = F.coalesce(zero_to_null("rolling_avg_lap_time"), F.col("lap_duration"))
    delta = F.coalesce(F.col("lap_delta"), F.lit(0.0))
    laps_to_pit = F.coalesce(F.col("estimated_laps_to_pit"), F.lit(C.NO_PIT_ESTIMATE))
    compound, age = _known("tyre_compound", "UNKNOWN"), _known("tyre_age_laps", 0)
    gap = zero_to_null("gap_to_leader")
    return laps.select(
        "session_key", "driver_number", "lap_number", "total_race_laps", "circuit_name",
        search_text(F.col("circuit_name")).alias("search_text"),
        F.format_string("Lap time: %.3fs, rolling avg: %.3fs, delta to best: +%.3fs",
                        fixed("lap_duration", 3), fixed(pace, 3), fixed(delta, 3)).alias("pace_line"),
        F.format_string("Tyres: %s, %d laps old, degrading at %.4fs/lap",
                        compound, age, fixed(rate, 4)).alias("tyre_line"),
        pit_note(laps_to_pit, _known("should_pit_soon", False)).alias("pit_note"),
        F.coalesce(zero_to_null("position").cast("string"), F.lit("unknown")).alias("position"),
        F.when(gap.isNull(), "unknown").otherwise(F.concat(fixed_text(gap, 3), F.lit("s"))).alias("gap_to_leader"),
        (F.col("total_race_laps") - F.col("lap_number")).alias("laps_remaining"),
    )


def commentary_inputs(laps: DataFrame) -> DataFrame:
    """One row of commentary prompt inputs per lap."""
    rate = F.coalesce(F.col("tyre_degradation_rate"), F.lit(0.0))
    wear = F.when(
        rate > 0.01, F.concat(F.lit("degrading at "), fixed_text(rate, 4), F.lit("s/lap"))
    ).otherwise(C.MINIMAL_WEAR_TEXT)
    name = F.coalesce(F.col("full_name"), F.format_string("Driver %d", "driver_number"))
    return laps.select(
        "session_key", "driver_number", "lap_number",
        F.format_string("%s (#%d)", name, "driver_number").alias("driver"),
        fixed_text("lap_duration", 3).alias("lap_time"),
        F.format_string("%s, %d laps old", _known("tyre_compound", "UNKNOWN"), _known("tyre_age_laps", 0))
        .alias("tyres"),
        wear.alias("wear_note"),
        F.when(_known("should_pit_soon", False), C.BOX_TEXT).otherwise(C.STAY_OUT_TEXT).alias("pit_note"),
        F.coalesce(zero_to_null("position").cast("string"), F.lit("unknown")).alias("position"),
    )
