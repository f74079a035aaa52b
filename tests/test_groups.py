"""Skewed groups: the sliced way gives the rows of the plain way."""

import pytest
from conftest import SMALL
from pyspark.sql import Window
from pyspark.sql import functions as F

from laplake.operators import race
from laplake.operators.features import lap_features, stint_detect, valid_laps
from laplake.operators.groups import (
    HotGroups,
    Limits,
    lookup,
    numbered,
    running_total,
    without_matches,
)
from laplake.operators.pits import stop_compounds
from laplake.plans.fixtures import RaceData

TINY = Limits(group_rows=7)
CROWDED = Limits(group_rows=7, hot_groups=2)


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, others few, some rows have no key."""
    ids = spark.range(400)
    key = F.when(F.col("id") % 10 < 7, 1).when(F.col("id") % 10 == 7, 2).when(
        F.col("id") % 40 != 9, (F.col("id") % 17 + 3).cast("int"))
    return ids.select(
        key.cast("int").alias("k"), (F.col("id") * 7919 % 400).alias("o"),
        (F.col("id") % 13).cast("double").alias("v")).cache()


def _plain(df, name, expression):
    return df.withColumn(name, expression)


@pytest.mark.parametrize("limits", [TINY, CROWDED])
def test_numbered(skewed, rows, limits):
    hot = HotGroups.measure(skewed, ["k"], limits)
    assert hot and hot.everything == (limits is CROWDED)
    ours = numbered(skewed, ["k"], ["o"], "n", limits=limits)
    plain = _plain(skewed, "n", F.row_number().over(Window.partitionBy("k").orderBy("o")))
    assert rows(ours) == rows(plain)


def test_numbered_descending_without_hot_groups(skewed, rows):
    ours = numbered(skewed, ["k"], [F.desc("o")], "n")
    plain = _plain(skewed, "n", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("o"))))
    assert rows(ours) == rows(plain)


def test_numbered_descending_hot(skewed, rows):
    ours = numbered(skewed, ["k"], [F.desc("o")], "n", limits=TINY)
    plain = _plain(skewed, "n", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("o"))))
    assert rows(ours) == rows(plain)


@pytest.mark.parametrize("limits", [TINY, CROWDED])
def test_running_total(skewed, rows, limits):
    window = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    ours = running_total(skewed, ["k"], ["o"], "v", "s", limits=limits)
    assert rows(ours) == rows(_plain(skewed, "s", F.sum("v").over(window)))


def test_running_total_with_nulls(spark, rows):
    df = spark.createDataFrame(
        [(1, i, None if i % 3 else float(i)) for i in range(1, 40)], "k int, o int, v double")
    window = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    ours = running_total(df, ["k"], ["o"], "v", "s", limits=TINY)
    assert rows(ours) == rows(_plain(df, "s", F.sum("v").over(window)))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_lookup(spark, skewed, rows, how):
    dimension = spark.createDataFrame([(i, f"n{i}") for i in range(1, 15)], "k int, name string")
    ours, plain = lookup(skewed, dimension, ["k"], how), skewed.join(dimension, ["k"], how)
    assert rows(ours, *plain.columns) == rows(plain)


def test_lookup_forces_no_broadcast(spark, skewed, tmp_path):
    """A table that only looks small to the planner: repeated values in little Parquet."""
    path = str(tmp_path / "wide")
    spark.range(400_000).select(F.col("id").cast("int").alias("k"), F.lit("x" * 200).alias("name")).write.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
    try:
        joined = lookup(skewed, spark.read.parquet(path), ["k"])
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_without_matches(spark, skewed, rows):
    covered = spark.createDataFrame([(1,), (5,)], "k int")
    ours = without_matches(skewed, covered, ["k"])
    assert rows(ours) == rows(skewed.where("k IS NULL OR k NOT IN (1, 5)"))


def test_hot_keys_are_bounded(skewed):
    hot = HotGroups.measure(skewed, ["k"], TINY)
    cold, rest = hot.split(skewed)
    assert cold.count() + rest.count() == skewed.count()
    assert hot.rows == rest.count()
    assert cold.groupBy("k").count().agg(F.max("count")).first()[0] <= TINY.group_rows


@pytest.fixture(scope="module")
def plain(spark):
    return RaceData(spark, SMALL)


@pytest.fixture(scope="module")
def tiny(spark):
    data = RaceData(spark, SMALL, TINY)
    assert data.hot_drivers and data.hot_sessions
    return data


def test_laps_of_hot_drivers(plain, tiny, rows):
    assert rows(tiny.laps.drop("ts")) == rows(plain.laps.drop("ts"))


@pytest.mark.parametrize("limits", [TINY, CROWDED, Limits(group_rows=5)])
def test_features_of_hot_drivers(plain, rows, limits):
    expected = rows(plain.features.drop("ts"))
    ours = lap_features(plain.laps, limits=limits).select(*plain.features.drop("ts").columns)
    assert rows(ours) == expected


def test_single_feature_of_hot_drivers(plain, rows):
    names = ["session_key", "driver_number", "lap_number", "prev_tyre_age", "is_new_stint", "stint_number"]
    valid = valid_laps(plain.laps)
    assert rows(stint_detect(valid, limits=TINY), *names) == rows(stint_detect(valid), *names)


def test_block_must_exceed_rolling_window(plain):
    with pytest.raises(ValueError):
        lap_features(plain.laps, limits=Limits(group_rows=4))


def test_positions_of_hot_sessions(plain, tiny, rows):
    names = ["session_key", "driver_number", "lap_number", "position"]
    ours = race.lap_positions(plain.valid, tiny.hot_drivers, tiny.hot_sessions, TINY)
    assert rows(ours, *names) == rows(race.lap_positions(plain.valid), *names)


def test_fastest_laps_of_hot_sessions(plain, tiny, rows):
    ours = race.fastest_laps(plain.valid, plain.roster, tiny.hot_sessions, TINY)
    expected = race.fastest_laps(plain.valid, plain.roster)
    assert rows(ours.select(*expected.columns)) == rows(expected)


def test_lap_range_of_hot_drivers(plain, tiny, rows):
    ours = race.driver_lap_range(plain.valid, tiny.hot_drivers, TINY)
    assert rows(ours) == rows(race.driver_lap_range(plain.valid))


def test_next_compound_of_hot_drivers(plain, tiny, rows):
    stops, stints = plain.laps.where("is_pit_in_lap"), race.tyre_stints(plain.features)
    ours = stop_compounds(stops, stints, tiny.hot_drivers, TINY)
    assert rows(ours) == rows(stop_compounds(stops, stints))


def test_strategies_in_pages(plain, rows):
    stints = race.tyre_stints(plain.features)
    paged = race.tyre_strategies(stints, plain.roster, page=2)
    parts = paged.select("session_key", "driver_number", F.explode("stints").alias("s")).select(
        "session_key", "driver_number", "s.*")
    assert rows(parts) == rows(stints.select(
        "session_key", "driver_number", "stint", "compound", "start_lap", "end_lap", "lap_count"))
    assert paged.agg(F.max(F.size("stints"))).first()[0] <= 2


def test_plain_features_need_one_exchange(plain):
    plan = plain.features._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("+- Sort [") == 3
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
