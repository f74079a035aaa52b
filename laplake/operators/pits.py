"""Pit stops: cleaning, events, durations, statistics, next compound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laplake import constants as C
from laplake.functions.numbers import double_or, fixed, int_or, zero_to_null
from laplake.operators.groups import LIMITS, HotGroups, Limits, lookup, numbered, running_total
from laplake.operators.race import DRIVER, first_available

NO_DURATION = "—"


def clean_stops(feed: DataFrame, session: str = "session_key", arrival: str = "copy_no") -> DataFrame:
    """Typed stops of a text feed, first copy of (driver, stop, lap).

    Copies are combined before the shuffle, so a stop that is repeated without
    end does not gather in one task. Unparsable durations become NULL.
    """
    others = [name for name in feed.columns if name not in (session, "driver_id", "stop", "lap")]
    typed = feed.withColumns({
        "stop_number": int_or(F.coalesce("stop", F.lit("1")), 1),
        "lap_number": int_or(F.coalesce("lap", F.lit("0")), 0),
    })
    keys = [session, "driver_id", "stop_number", "lap_number"]
    first = typed.groupBy(*keys).agg(F.min_by(F.struct(*others), arrival).alias("_f"))
    return first.select(*keys, "_f.*").withColumns({
        "duration_seconds": double_or(F.nullif("duration", F.lit(""))),
        "duration_formatted": F.coalesce("duration", F.lit(NO_DURATION)),
    }).drop("duration")


def by_lap(stops: DataFrame, session: str = "session_key") -> DataFrame:
    """Stops by lap, then duration, a missing or zero duration last."""
    shown = F.coalesce(zero_to_null("duration_seconds"), F.lit(float(C.UNPLACED)))
    return stops.orderBy(session, "lap_number", shown, "driver_id", "stop_number")


def pit_report(stops: DataFrame, events: DataFrame, names: tuple[str, str] = ("pages", "laps")) -> DataFrame:
    """Identified stops, or for races without any the stops seen in the laps, marked with their source.

    Both have the session, driver code and number, stop and lap number and duration.
    """
    columns = ["session_key", "driver_code", "driver_number", "stop_number", "lap_number",
               "duration_seconds", "duration_formatted"]
    return first_available(stops.select(*columns), events.select(*columns), ["session_key"], names)


def pit_events(timed_laps: DataFrame, hot_drivers: HotGroups | None = None,
               limits: Limits = LIMITS) -> DataFrame:
    """Laps with a pit-in time, numbered per driver."""
    events = timed_laps.where(F.col("pit_in_s").isNotNull())
    return numbered(events, DRIVER, ["lap_number"], "stop_number", hot=hot_drivers, limits=limits)


def pit_durations(events: DataFrame, timed_laps: DataFrame) -> DataFrame:
    """Time from pit-in to the pit-out of the next lap, if within two minutes."""
    exits = (
        timed_laps.where(F.col("pit_out_s").isNotNull())
        .select(*DRIVER, (F.col("lap_number") - 1).alias("lap_number"),
                F.col("pit_out_s").alias("_out_s"))
    )
    joined = events.join(exits, [*DRIVER, "lap_number"], "left")
    stay = F.col("_out_s") - F.col("pit_in_s")
    return joined.withColumn(
        "duration_seconds", F.when((stay > 0) & (stay < 120), fixed(stay, 3))
    ).withColumn(
        "duration_formatted",
        F.when(F.col("duration_seconds").isNull(), NO_DURATION)
        .otherwise(F.format_string("%.3f", "duration_seconds")),
    ).drop("_out_s")


def _counted(low: float, high: float):
    duration = F.col("duration_seconds")
    return F.when((duration > low) & (duration < high), duration)


def stop_statistics(stops: DataFrame, low: float = 1.0, high: float = 60.0) -> DataFrame:
    """Fastest, mean and slowest stop per session, bounds excluded."""
    counted = _counted(low, high)
    return stops.groupBy("session_key").agg(
        F.min(counted).alias("fastest_stop"),
        F.avg(counted).alias("average_stop"),
        F.max(counted).alias("slowest_stop"),
    )


def stop_flags(stops: DataFrame, low: float = 1.0, high: float = 60.0) -> DataFrame:
    """Mark the fastest stop of the session and the slow ones."""
    fastest = stops.groupBy("session_key").agg(F.min(_counted(low, high)).alias("_fastest"))
    duration = F.col("duration_seconds")
    return lookup(stops, fastest, ["session_key"]).withColumns({
        "is_fastest": F.coalesce(duration == F.col("_fastest"), F.lit(False)),
        "is_slow": F.coalesce(
            (duration > C.SLOW_STOP_SECONDS) & ~F.coalesce(duration == F.col("_fastest"), F.lit(False)),
            F.lit(False)),
    }).drop("_fastest")


def stop_compounds(stops: DataFrame, stints: DataFrame, hot_drivers: HotGroups | None = None,
                   limits: Limits = LIMITS) -> DataFrame:
    """Compound of the stint that starts first after each stop.

    A running count of stint starts tells how many stints began up to the stop;
    the next stint then is found by its number, without pairing stops and stints.
    """
    marks = stints.select(
        *DRIVER, F.col("start_lap").alias("lap_number"), F.lit(0).alias("_kind"), F.lit(1).alias("_mark"))
    asked = stops.select(*DRIVER, "lap_number", F.lit(1).alias("_kind"), F.lit(0).alias("_mark"))
    counted = running_total(marks.unionByName(asked), DRIVER, ["lap_number", "_kind"], "_mark",
                            "stint_number", hot=hot_drivers, limits=limits)
    numbered_stops = counted.where(F.col("_kind") == 1).select(*DRIVER, "lap_number", "stint_number")
    following = stints.select(*DRIVER, "stint_number", F.col("compound").alias("tyre_compound_new"))
    return numbered_stops.join(following, [*DRIVER, "stint_number"], "left").drop("stint_number")
