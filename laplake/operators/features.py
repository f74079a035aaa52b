"""Lap features: rolling pace, running best, stints, degradation, pit window."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laplake import constants as C
from laplake.operators.groups import (
    LIMITS,
    HotGroups,
    Limits,
    before_slice,
    join_on,
    numbered,
)
from laplake.session import cut_lineage


@dataclass(frozen=True)
class LapColumns:
    """Names of the group keys, the order and the measurements."""

    keys: tuple[str, ...] = ("session_key", "driver_number")
    order: str = "lap_number"
    duration: str = "lap_duration"
    age: str = "tyre_age_laps"
    compound: str = "tyre_compound"


LAPS = LapColumns()


def valid_laps(df: DataFrame, duration: str = LAPS.duration,
               low: float = C.MIN_LAP_SECONDS, high: float = C.MAX_LAP_SECONDS) -> DataFrame:
    """Timed laps strictly between the two bounds."""
    value = F.col(duration)
    return df.where(value.isNotNull() & (value > low) & (value < high))


def _resets(cols: LapColumns) -> Column:
    """A stint starts where the tyre age is lower than on the lap before."""
    return F.when(F.col(cols.age) < F.col("prev_tyre_age"), 1).otherwise(0)


def _stint_start(cols: LapColumns, starts: Column) -> Column:
    """First lap time of the stint; the struct keeps a NULL first time."""
    return F.last(F.when(starts, F.struct(F.col(cols.duration).alias("t"))), ignorenulls=True)


def _plain(df: DataFrame, cols: LapColumns, rolling: int) -> DataFrame:
    rows = Window.partitionBy(*cols.keys).orderBy(cols.order)
    upto = rows.rowsBetween(Window.unboundedPreceding, 0)
    same_compound = Window.partitionBy(*cols.keys, cols.compound).orderBy(cols.order)
    return (
        df.withColumns({
            "prev_tyre_age": F.lag(cols.age).over(rows),
            "rolling_avg_lap_time": F.avg(cols.duration).over(rows.rowsBetween(1 - rolling, 0)),
            "personal_best": F.min(cols.duration).over(upto),
            "_seq": F.row_number().over(rows),
        })
        .withColumn("is_new_stint", _resets(cols))
        .withColumns({
            "stint_number": F.sum("is_new_stint").over(upto),
            "stint_start_lap_time": _stint_start(
                cols, (F.col("is_new_stint") == 1) | (F.col("_seq") == 1)).over(upto)["t"],
        })
        .withColumn("_compound_lap", F.row_number().over(same_compound).cast("long"))
        .drop("_seq")
    )


def _sliced(df: DataFrame, cols: LapColumns, rolling: int, hot: HotGroups, limits: Limits) -> DataFrame:
    """The same columns for groups too large for one task.

    Rows are numbered, cut into blocks of equal length, and the last rows of a
    block are repeated at the head of the next, which makes the previous row and
    the rolling frame exact. Sums, minima and stint starts carry over by block.
    """
    keys, size, halo = list(cols.keys), limits.group_rows, max(1, rolling - 1)
    if size <= halo:
        raise ValueError("group_rows must exceed the rolling window")
    everything = HotGroups(keys, rows=hot.rows, everything=True)
    numbers = numbered(df, keys, [cols.order], "_seq", "long", everything, limits)
    own = F.floor((F.col("_seq") - 1) / size)
    near_end = (F.col("_seq") - 1) % size >= size - halo
    blocks = numbers.withColumn("_own", own).withColumn(
        "_block",
        F.explode(F.when(near_end, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))),
    )
    parts = [*keys, "_block"]
    rows = Window.partitionBy(*parts).orderBy("_seq")
    upto = rows.rowsBetween(Window.unboundedPreceding, 0)
    starts = (F.col("is_new_stint") == 1) | (F.col("_seq") == 1)
    stepped = cut_lineage(
        blocks.withColumns({
            "prev_tyre_age": F.lag(cols.age).over(rows),
            "rolling_avg_lap_time": F.avg(cols.duration).over(rows.rowsBetween(1 - rolling, 0)),
        })
        .where("_block = _own")
        .withColumn("is_new_stint", _resets(cols))
        .drop("_own")
    )

    per_block = stepped.groupBy(*parts).agg(
        F.sum("is_new_stint").alias("_resets"),
        F.min(cols.duration).alias("_best"),
        F.max_by(
            F.when(starts, F.struct(F.col(cols.duration).alias("t"))), F.when(starts, F.col("_seq")),
        ).alias("_start"),
    )
    carried = before_slice(per_block, keys, "_block", {
        "_resets_before": F.sum("_resets"),
        "_best_before": F.min("_best"),
        "_start_before": F.last("_start", ignorenulls=True),
    })
    per_compound = stepped.groupBy(*parts, cols.compound).agg(F.count(F.lit(1)).alias("_laps"))
    laps_before = before_slice(
        per_compound, [*keys, cols.compound], "_block", {"_laps_before": F.sum("_laps")})

    local = stepped.withColumns({
        "_stint": F.sum("is_new_stint").over(upto),
        "_local_best": F.min(cols.duration).over(upto),
        "_local_start": _stint_start(cols, starts).over(upto),
        "_local_lap": F.row_number().over(
            Window.partitionBy(*parts, cols.compound).orderBy("_seq")),
    })
    joined = join_on(join_on(local, carried, parts), laps_before, [*parts, cols.compound])
    return joined.withColumns({
        "personal_best": F.least("_local_best", "_best_before"),
        "stint_number": F.col("_stint") + F.coalesce("_resets_before", F.lit(0)),
        "stint_start_lap_time": F.coalesce("_local_start", "_start_before")["t"],
        "_compound_lap": F.col("_local_lap") + F.coalesce("_laps_before", F.lit(0)),
    }).drop("_seq", "_block", "_stint", "_local_best", "_local_start", "_local_lap",
            "_resets_before", "_best_before", "_start_before", "_laps_before")


def _sequence(df: DataFrame, cols: LapColumns, rolling: int,
              hot: HotGroups | None, limits: Limits) -> DataFrame:
    hot = hot if hot is not None else HotGroups.measure(df, cols.keys, limits)
    cold, rest = hot.split(df)
    parts = []
    if cold is not None:
        parts.append(_plain(cold, cols, rolling))
    if rest is not None:
        parts.append(_sliced(rest, cols, rolling, hot, limits))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.withColumns({
        "lap_delta": F.col(cols.duration) - F.col("personal_best"),
        "stint_length": F.coalesce(F.col(cols.age).cast("long"), F.col("_compound_lap")),
    }).drop("_compound_lap")


def _with(names: Sequence[str], df: DataFrame, cols: LapColumns, rolling: int,
          hot: HotGroups | None, limits: Limits) -> DataFrame:
    return _sequence(df, cols, rolling, hot, limits).select(*df.columns, *names)


def rolling_avg(df: DataFrame, window: int = C.ROLLING_LAPS, cols: LapColumns = LAPS,
                hot: HotGroups | None = None, limits: Limits = LIMITS) -> DataFrame:
    """Mean lap time of the last ``window`` rows, fewer at the start."""
    return _with(["rolling_avg_lap_time"], df, cols, window, hot, limits)


def lap_delta(df: DataFrame, cols: LapColumns = LAPS,
              hot: HotGroups | None = None, limits: Limits = LIMITS) -> DataFrame:
    """Best time so far and the distance to it."""
    return _with(["personal_best", "lap_delta"], df, cols, C.ROLLING_LAPS, hot, limits)


def stint_detect(df: DataFrame, cols: LapColumns = LAPS,
                 hot: HotGroups | None = None, limits: Limits = LIMITS) -> DataFrame:
    """Previous tyre age, reset flag and zero-based stint number."""
    return _with(["prev_tyre_age", "is_new_stint", "stint_number"],
                 df, cols, C.ROLLING_LAPS, hot, limits)


def stint_length(df: DataFrame, cols: LapColumns = LAPS,
                 hot: HotGroups | None = None, limits: Limits = LIMITS) -> DataFrame:
    """Tyre age where known, else the count of laps on the compound."""
    return _with(["stint_length"], df, cols, C.ROLLING_LAPS, hot, limits)


def degradation_columns(df: DataFrame, cols: LapColumns = LAPS) -> DataFrame:
    """Seconds lost per lap of tyre age; values outside the sane range become 0."""
    age = F.col(cols.age)
    safe = F.when(age > 1, age).otherwise(1)
    raw = (F.col(cols.duration) - F.col("stint_start_lap_time")) / safe
    sane = raw.between(C.MIN_DEGRADATION, C.MAX_DEGRADATION)
    return df.withColumns({
        "tyre_age_safe": safe,
        "tyre_degradation_rate": F.when(sane, raw).otherwise(0.0),
    })


def tyre_degradation(df: DataFrame, cols: LapColumns = LAPS,
                     hot: HotGroups | None = None, limits: Limits = LIMITS) -> DataFrame:
    out = _with(["stint_number", "stint_start_lap_time"], df, cols, C.ROLLING_LAPS, hot, limits)
    return degradation_columns(out, cols)


def pit_window(df: DataFrame, threshold: float = C.PIT_THRESHOLD) -> DataFrame:
    """Pit flag and laps left until the rate reaches the threshold."""
    rate = F.col("tyre_degradation_rate")
    return df.withColumns({
        "should_pit_soon": F.coalesce(rate > threshold, F.lit(False)),
        "estimated_laps_to_pit": F.when(
            rate > 0, F.greatest(F.lit(0.0), (threshold - rate) / rate),
        ).otherwise(C.NO_PIT_ESTIMATE),
    })


def lap_features(df: DataFrame, cols: LapColumns = LAPS, window: int = C.ROLLING_LAPS,
                 threshold: float = C.PIT_THRESHOLD, hot: HotGroups | None = None,
                 limits: Limits = LIMITS) -> DataFrame:
    """All features of valid laps in one pass: one exchange by the group keys."""
    sequence = _sequence(valid_laps(df, cols.duration), cols, window, hot, limits)
    return pit_window(degradation_columns(sequence, cols), threshold)
