"""Whole-table jobs: enrich races, plan and audit backfills, index documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from laplake.operators.features import LAPS, LapColumns, lap_features, valid_laps
from laplake.operators.groups import LIMITS, HotGroups, Limits, lookup, without_matches
from laplake.operators.text import lap_documents
from laplake.operators.vectors import Encoder, embed_documents
from laplake.session import cut_lineage
from laplake.sinks.tables import VersionedTable, write_races

RACE = ("season", "round_number")


def backfill_plan(rounds: DataFrame, processed: DataFrame, seasons: Sequence[int] | None = None,
                  only_rounds: Sequence[int] | None = None, force: bool = False) -> DataFrame:
    """Every requested race, marked ``skip`` where it is processed already."""
    if seasons is not None:
        rounds = rounds.where(F.col("season").isin(*seasons))
    if only_rounds:
        rounds = rounds.where(F.col("round_number").isin(*only_rounds))
    if force:
        return rounds.withColumn("skip", F.lit(False))
    done = processed.select(*RACE).distinct().withColumn("_done", F.lit(True))
    return lookup(rounds, done, list(RACE)).withColumn(
        "skip", F.coalesce("_done", F.lit(False))).drop("_done")


def process_races(laps: DataFrame, races: DataFrame, path: str, cols: LapColumns = LAPS,
                  hot: HotGroups | None = None, limits: Limits = LIMITS) -> DataFrame:
    """Enrich any set of races in one job, write them by race, and return what is there of them.

    A race that now has no valid lap loses the rows of earlier runs.
    """
    todo = races.select(*RACE).distinct()
    schema, _, _ = _run(laps, todo, path, cols, hot, limits)
    return lookup(laps.sparkSession.read.schema(schema).parquet(path), todo, list(RACE), how="left_semi")


def _run(laps: DataFrame, todo: DataFrame, path: str, cols: LapColumns, hot: HotGroups | None,
         limits: Limits) -> tuple[StructType, DataFrame, int]:
    """Process races; gives the schema of the rows, the rows that each race should have, and the rows written."""
    spark = laps.sparkSession
    chosen = lookup(laps, todo, list(RACE), how="inner")
    expected = cut_lineage(expected_laps(chosen, cols))  # a row per race
    features = lap_features(chosen, cols, hot=hot, limits=limits)
    written = write_races(features, path)
    for season, number in without_matches(todo, expected, list(RACE)).toLocalIterator():
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/season={season}/round_number={number}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return features.schema, expected, written


def expected_laps(laps: DataFrame, cols: LapColumns = LAPS) -> DataFrame:
    """Valid laps per race: the rows that processing has to write."""
    return valid_laps(laps, cols.duration).groupBy(*RACE).agg(F.count(F.lit(1)).alias("expected"))


def backfill_audit(plan: DataFrame, written: DataFrame, expected: DataFrame) -> DataFrame:
    """Outcome of every planned race: skipped, succeeded, partial, or failed (no rows)."""
    return audit_counts(plan, _rows_by_race(written), expected)


def _rows_by_race(written: DataFrame) -> DataFrame:
    return written.groupBy(*RACE).agg(F.count(F.lit(1)).alias("rows"))


def audit_counts(plan: DataFrame, rows: DataFrame, expected: DataFrame) -> DataFrame:
    """The audit from the rows written and expected per race."""
    joined = lookup(lookup(plan, rows, list(RACE)), expected, list(RACE))
    none = F.lit(0).cast("long")
    joined = joined.withColumns({
        name: F.when(F.col("skip"), none).otherwise(F.coalesce(name, none)) for name in ("rows", "expected")})
    outcome = (
        F.when(F.col("skip"), "skipped")
        .when(F.col("rows") == 0, "failed")
        .when(F.col("rows") < F.col("expected"), "partial")
        .otherwise("succeeded")
    )
    return joined.withColumn("outcome", outcome)


def outcome_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("outcome").agg(F.count(F.lit(1)).alias("races"))


def backfill(spark: SparkSession, laps: DataFrame, rounds: DataFrame, path: str,
             processed: DataFrame, seasons: Sequence[int] | None = None,
             only_rounds: Sequence[int] | None = None, force: bool = False,
             limits: Limits = LIMITS) -> DataFrame:
    """Plan, process what is missing, and return the audit.

    A race never has more rows than valid laps. So if as many rows were written in all as there
    should be, every race has its rows, and nothing is read back; else each race's rows are counted.
    """
    plan = backfill_plan(rounds, processed, seasons, only_rounds, force)
    todo = plan.where(~F.col("skip")).select(*RACE).distinct()
    schema, expected, written = _run(laps, todo, path, LAPS, None, limits)
    if written == (expected.agg(F.sum("expected")).first()[0] or 0):
        return audit_counts(plan, expected.withColumnRenamed("expected", "rows"), expected)
    found = lookup(spark.read.schema(schema).parquet(path), todo, list(RACE), how="left_semi")
    return backfill_audit(plan, found, expected)


def index_races(features: DataFrame, encoder: Encoder, table: VersionedTable, version: int | None = None,
                circuit=None, merge_every: int = 10) -> DataFrame:
    """Describe, embed and upsert every lap of the given races.

    Without a ``version`` the next number is taken, and ``merge_every`` versions are merged into one.
    """
    number = 1 + max(table.versions(), default=-1) if version is None else version
    table.write(embed_documents(lap_documents(features, circuit), encoder), number)
    if version is None and len(table.versions()) >= merge_every:
        table.merge(number + 1)
    return table.latest()
