"""Normalise landed provider feeds to the entity schemas.

Every function takes a frame read with an explicit schema and only projects and
filters, so nothing shuffles and pushed filters reach the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laplake.functions.numbers import interval_seconds


def _or(name: str, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def _no_text(name: str) -> Column:
    return F.lit(None).cast("string").alias(name)


def _stamp(at: Column | str | None) -> Column:
    """ISO text of the time of a row; without one, of the time it is taken in."""
    time = F.current_timestamp() if at is None else at if isinstance(at, Column) else F.col(at)
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")


def _session_key(raw: DataFrame) -> Column:
    """The feed's session key, or one from season and round where it has none."""
    if "session_key" in raw.columns:
        return F.col("session_key")
    return season_session_key("season", "round_number").alias("session_key")


def timing_laps(raw: DataFrame, driver_number: int | None = None,
                lap_number: int | None = None, at: Column | str | None = None) -> DataFrame:
    """Laps of the timing feed; zero or no filter value means all. ``at`` is the time of a lap."""
    if driver_number:
        raw = raw.where(F.col("driver_number") == driver_number)
    if lap_number:
        raw = raw.where(F.col("lap_number") == lap_number)
    return raw.select(
        "session_key", "driver_number", "lap_number", "lap_duration",
        F.col("duration_sector_1").alias("sector_1_time"),
        F.col("duration_sector_2").alias("sector_2_time"),
        F.col("duration_sector_3").alias("sector_3_time"),
        F.col("compound").alias("tyre_compound"),
        F.col("tyre_age_at_start").alias("tyre_age_laps"),
        _or("is_pit_out_lap", False).alias("is_pit_out_lap"),
        F.lit(False).alias("is_pit_in_lap"), _stamp(at),
        F.lit("openf1").alias("source"),
    )


def timing_drivers(raw: DataFrame) -> DataFrame:
    return raw.select(
        "driver_number",
        _or("full_name", "").alias("full_name"),
        _or("name_acronym", "").alias("abbreviation"),
        _or("team_name", "").alias("team_name"),
        F.concat(F.lit("#"), _or("team_colour", "000000")).alias("team_colour"),
        "headshot_url", "country_code",
        F.lit("openf1").alias("source"),
    )


def timing_pits(raw: DataFrame) -> DataFrame:
    return raw.select(
        "session_key", "driver_number", _or("lap_number", 0).alias("lap_number"),
        "pit_duration", _no_text("tyre_compound_new"),
        _or("date", "").alias("timestamp"), F.lit("openf1").alias("source"),
    )


def timing_sessions(raw: DataFrame, session_key: int | None = None) -> DataFrame:
    """Sessions of the timing feed, optionally one of them.

    A race listing fills gaps with race defaults, a single session with blanks.
    """
    name, kind = ("Race", "R") if session_key is None else ("", "")
    if session_key is not None:
        raw = raw.where(F.col("session_key") == session_key)
    return raw.select(
        "session_key",
        _or("session_name", name).alias("session_name"),
        _or("session_type", kind).alias("session_type"),
        _or("year", 0).alias("year"),
        _or("circuit_short_name", "").alias("circuit_short_name"),
        _or("circuit_key", 0).alias("circuit_key"),
        _or("country_name", "").alias("country_name"),
        _or("date_start", "").alias("date_start"),
        _or("gmt_offset", "+00:00").alias("gmt_offset"),
        F.lit("openf1").alias("source"),
    )


def clock_laps(raw: DataFrame, at: Column | str | None = None) -> DataFrame:
    """Laps of the clock feed: intervals to seconds, untimed laps skipped."""
    timed = raw.where(F.col("lap_time").isNotNull())
    return timed.select(
        _session_key(raw), "driver_number", "lap_number",
        interval_seconds("lap_time").alias("lap_duration"),
        interval_seconds("sector_1").alias("sector_1_time"),
        interval_seconds("sector_2").alias("sector_2_time"),
        interval_seconds("sector_3").alias("sector_3_time"),
        F.col("compound").alias("tyre_compound"),
        F.col("tyre_life").cast("int").alias("tyre_age_laps"),
        F.col("pit_out_time").isNotNull().alias("is_pit_out_lap"),
        F.col("pit_in_time").isNotNull().alias("is_pit_in_lap"), _stamp(at),
        F.lit("fastf1").alias("source"),
    )


def clock_drivers(raw: DataFrame) -> DataFrame:
    """Drivers of the clock feed; rows whose number is no number are skipped."""
    number = F.coalesce(F.col("driver_number"), F.lit("0")).try_cast("int")
    return raw.where(number.isNotNull()).select(
        number.alias("driver_number"),
        _or("full_name", "").alias("full_name"),
        _or("abbreviation", "").alias("abbreviation"),
        _or("team_name", "").alias("team_name"),
        F.concat(F.lit("#"), _or("team_colour", "000000")).alias("team_colour"),
        _no_text("headshot_url"), _no_text("country_code"),
        F.lit("fastf1").alias("source"),
    )


def clock_session(raw: DataFrame) -> DataFrame:
    """Session facts of the clock feed; the type is the first letter of the name."""
    return raw.select(
        _session_key(raw),
        F.col("name").alias("session_name"),
        F.substring("name", 1, 1).alias("session_type"),
        F.year("event_date").alias("year"),
        _or("location", "").alias("circuit_short_name"),
        F.lit(0).alias("circuit_key"),
        _or("country", "").alias("country_name"),
        F.date_format("event_date", "yyyy-MM-dd HH:mm:ss").alias("date_start"),
        F.lit("+00:00").alias("gmt_offset"),
        F.lit("fastf1").alias("source"),
    )


def clock_pits(raw: DataFrame, at: Column | str | None = None) -> DataFrame:
    """One pit stop per lap with a pit-in time."""
    return raw.where(F.col("pit_in_time").isNotNull()).select(
        _session_key(raw), "driver_number", "lap_number",
        F.lit(None).cast("double").alias("pit_duration"),
        F.col("compound").alias("tyre_compound_new"), _stamp(at),
        F.lit("fastf1").alias("source"),
    )


def season_session_key(season: Column | str, round_number: Column | str) -> Column:
    """A session key for feeds without one, unique per season and round."""
    season = F.col(season) if isinstance(season, str) else season
    round_number = F.col(round_number) if isinstance(round_number, str) else round_number
    return (season * 1000 + round_number).cast("int")
