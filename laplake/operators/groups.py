"""Ordered and keyed work that stays balanced when one group is very large.

A window over a group runs in one task. That is the best plan while groups are
small, and the wrong one when a single group holds a large share of the rows.
``HotGroups`` measures the groups with one column-pruned, map-side combined
count. Groups within the limit use a plain window. Larger ones are cut into
slices of consecutive rows: each slice is windowed on its own, one summary row
per slice carries the totals of the slices before it. Both ways give the same
rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from laplake.session import cut_lineage


@dataclass(frozen=True)
class Limits:
    """Rows that one task may hold of a group, and hot keys that are broadcast."""

    group_rows: int = 1_000_000
    hot_groups: int = 10_000


LIMITS = Limits()


class HotGroups:
    """The groups of ``keys`` that exceed ``limits.group_rows`` rows.

    At most ``limits.hot_groups`` keys are held, so the frame can be broadcast.
    With more of them ``everything`` is set and all rows take the sliced way.
    """

    def __init__(self, keys: Sequence[str], frame: DataFrame | None = None,
                 rows: int = 0, everything: bool = False):
        self.keys = list(keys)
        self.frame = frame
        self.rows = rows
        self.everything = everything

    @classmethod
    def measure(cls, df: DataFrame, keys: Sequence[str], limits: Limits = LIMITS) -> "HotGroups":
        keys = list(keys)
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        large = F.col("_rows") > limits.group_rows
        total, count, rows = sizes.agg(
            F.sum("_rows"), F.count_if(large), F.sum(F.when(large, F.col("_rows")))).first()
        if not count:
            return cls(keys)
        if count > limits.hot_groups:
            return cls(keys, rows=total, everything=True)
        schema = StructType([df.schema[key] for key in keys])
        found = sizes.where(large).limit(limits.hot_groups).select(*keys).collect()
        frame = df.sparkSession.createDataFrame([tuple(row) for row in found], schema)
        return cls(keys, frame, rows)

    @classmethod
    def measure_levels(cls, df: DataFrame, outer: Sequence[str], inner: Sequence[str],
                       limits: Limits = LIMITS) -> tuple["HotGroups", "HotGroups"]:
        """Rows per (outer, inner) group, and inner groups per outer group.

        One job finds the largest of both; only if one is too large are the
        groups themselves looked up.
        """
        both = [*outer, *inner]
        sizes = df.groupBy(*both).agg(F.count(F.lit(1)).alias("_rows"))
        per_outer = sizes.groupBy(*outer).agg(
            F.max("_rows").alias("_rows"), F.count(F.lit(1)).alias("_groups"))
        rows, groups = per_outer.agg(F.max("_rows"), F.max("_groups")).first()
        inner_hot = cls(both) if (rows or 0) <= limits.group_rows else cls.measure(df, both, limits)
        outer_hot = cls(outer) if (groups or 0) <= limits.group_rows else cls.measure(sizes, outer, limits)
        return inner_hot, outer_hot

    def __bool__(self) -> bool:
        return self.everything or self.frame is not None

    def split(self, df: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
        """Rows of groups within the limit, and rows of hot groups."""
        if self.everything:
            return None, df
        if self.frame is None:
            return df, None
        return self._filter(df, "left_anti"), self._filter(df, "left_semi")

    def only(self, df: DataFrame) -> DataFrame:
        """Rows of a keyed table that belong to hot groups."""
        return self._filter(df, "left_semi") if self.frame is not None else df

    def _filter(self, df: DataFrame, how: str) -> DataFrame:
        return join_on(df, F.broadcast(self.frame), self.keys, how)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join that treats NULL keys as equal and keeps the left key columns."""
    renamed = {key: f"_r_{key}" for key in keys}
    right = right.withColumnsRenamed(renamed)
    condition = reduce(
        lambda a, b: a & b,
        (left[key].eqNullSafe(right[other]) for key, other in renamed.items()),
    )
    return left.join(right, condition, how).drop(*renamed.values())


def _union(parts: Sequence[DataFrame | None]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [part for part in parts if part is not None])


def slice_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
               rows: int, limits: Limits = LIMITS) -> DataFrame:
    """Cut the rows into ranges of (keys, order); ``_slice`` grows with the order.

    Range boundaries come from the full sort key, so a single group spreads over
    as many slices as it needs. The result is checkpointed: slice numbers must
    not change when a lost task is run again.
    """
    count = max(2, math.ceil(2 * rows / limits.group_rows))
    ranged = df.repartitionByRange(count, *keys, *order)
    return cut_lineage(ranged.withColumn("_slice", F.spark_partition_id()))


def before_slice(summary: DataFrame, keys: Sequence[str], slice_name: str,
                 carries: dict[str, Column]) -> DataFrame:
    """Combine the summaries of all earlier slices of the same group."""
    earlier = (
        Window.partitionBy(*keys).orderBy(slice_name)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return summary.select(
        *keys, slice_name, *[carry.over(earlier).alias(name) for name, carry in carries.items()]
    )


def _number_hot(df, keys, order, name, dtype, rows, limits):
    sliced = slice_rows(df, keys, order, rows, limits)
    parts = [*keys, "_slice"]
    local = sliced.withColumn("_local", F.row_number().over(Window.partitionBy(*parts).orderBy(*order)))
    sizes = sliced.groupBy(*parts).agg(F.count(F.lit(1)).alias("_rows"))
    before = before_slice(sizes, keys, "_slice", {"_before": F.sum("_rows")})
    joined = join_on(local, before, parts)
    number = F.col("_local") + F.coalesce(F.col("_before"), F.lit(0))
    return joined.withColumn(name, number.cast(dtype)).drop("_local", "_before", "_slice")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str,
             dtype: str = "int", hot: HotGroups | None = None, limits: Limits = LIMITS) -> DataFrame:
    """``row_number`` over ``keys`` in ``order``, which must be a total order.

    ``hot`` may be measured on a subset of ``keys`` or on a cheaper table that
    has at least as many rows per group.
    """
    hot = hot if hot is not None else HotGroups.measure(df, keys, limits)
    cold, rest = hot.split(df)
    if cold is not None:
        window = Window.partitionBy(*keys).orderBy(*order)
        cold = cold.withColumn(name, F.row_number().over(window).cast(dtype))
    if rest is not None:
        rest = _number_hot(rest, keys, order, name, dtype, hot.rows, limits)
    return _union([cold, rest])


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: str,
                  name: str, hot: HotGroups | None = None, limits: Limits = LIMITS) -> DataFrame:
    """Cumulative sum of ``value`` over ``keys`` in ``order``."""
    hot = hot if hot is not None else HotGroups.measure(df, keys, limits)
    cold, rest = hot.split(df)

    def cumulative(frame: DataFrame, parts: list[str], out: str) -> DataFrame:
        window = (
            Window.partitionBy(*parts).orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        return frame.withColumn(out, F.sum(value).over(window))

    if cold is not None:
        cold = cumulative(cold, list(keys), name)
    if rest is not None:
        parts = [*keys, "_slice"]
        sliced = slice_rows(rest, keys, order, hot.rows, limits)
        sums = sliced.groupBy(*parts).agg(F.sum(value).alias("_sum"))
        before = before_slice(sums, keys, "_slice", {"_before": F.sum("_sum")})
        joined = join_on(cumulative(sliced, parts, "_local"), before, parts)
        total = F.coalesce(F.col("_before") + F.col("_local"), F.col("_local"), F.col("_before"))
        rest = joined.withColumn(name, total).drop("_local", "_before", "_slice")
    return _union([cold, rest])


def lookup(fact: DataFrame, dimension: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join to a table with one row per key.

    Nothing is forced: adaptive execution broadcasts the dimension if the bytes
    that its shuffle wrote are few, and else splits the partitions of hot keys.
    """
    return fact.join(dimension, list(keys), how)


def without_matches(df: DataFrame, covered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is absent from a table with one row per key."""
    return df.join(covered, list(keys), "left_anti")
