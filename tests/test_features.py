"""Hand-computed feature values."""

import math

import pytest

from laplake import schemas
from laplake.operators.features import LapColumns, lap_features, pit_window, rolling_avg
from laplake.sources.messages import clean_numbers


def _laps(spark, items):
    """(driver, lap, duration, compound, age) in session 9999."""
    data = [
        (9999, driver, lap, duration, 28.0, 32.0, 30.0, compound, age, False, False, "2024-01-01T00:00:00", "test")
        for driver, lap, duration, compound, age in items
    ]
    return spark.createDataFrame(data, schemas.LAP)


def _one(df):
    return {(r["driver_number"], r["lap_number"]): r for r in df.collect()}


def test_twenty_laps_on_one_set(spark):
    laps = _laps(spark, [(1, lap, 90.0 + 0.05 * lap, "SOFT", lap) for lap in range(1, 21)])
    out = _one(lap_features(laps))
    assert len(out) == 20
    for lap in range(1, 21):
        row, rate = out[(1, lap)], 0.05 * (lap - 1) / lap
        recent = [90.0 + 0.05 * n for n in range(max(1, lap - 4), lap + 1)]
        assert row["stint_number"] == 0 and row["stint_length"] == lap
        assert row["personal_best"] == pytest.approx(90.05)
        assert row["lap_delta"] == pytest.approx(0.05 * (lap - 1))
        assert row["rolling_avg_lap_time"] == pytest.approx(sum(recent) / len(recent))
        assert row["tyre_degradation_rate"] == pytest.approx(rate)
        assert row["should_pit_soon"] is False
        assert row["estimated_laps_to_pit"] == pytest.approx(999.0 if lap == 1 else (0.15 - rate) / rate)


def test_invalid_laps_leave_every_window(spark):
    laps = _laps(spark, [(1, 1, 90.0, "SOFT", 1), (1, 2, 60.0, "SOFT", 2), (1, 3, 200.0, "SOFT", 3),
                         (1, 4, None, "SOFT", 4), (1, 5, 92.0, "SOFT", 5)])
    out = _one(lap_features(laps))
    assert set(out) == {(1, 1), (1, 5)}
    assert out[(1, 5)]["rolling_avg_lap_time"] == pytest.approx(91.0)
    assert out[(1, 5)]["prev_tyre_age"] == 1


def test_stints_start_on_lower_age_only(spark):
    ages = [3, 4, 4, 1, None, 1, 9]
    laps = _laps(spark, [(1, lap, 90.0 + lap, "HARD", age) for lap, age in enumerate(ages, 1)])
    out = _one(lap_features(laps))
    assert [out[(1, n)]["stint_number"] for n in range(1, 8)] == [0, 0, 0, 1, 1, 1, 1]
    assert [out[(1, n)]["stint_start_lap_time"] for n in range(1, 8)] == [91.0] * 3 + [94.0] * 4


def test_unknown_age_counts_laps_on_compound(spark):
    laps = _laps(spark, [(1, 1, 90.0, "SOFT", None), (1, 2, 90.0, "HARD", None), (1, 3, 90.0, "SOFT", None),
                         (1, 4, 90.0, None, None), (1, 5, 90.0, None, None)])
    out = _one(lap_features(laps))
    assert [out[(1, n)]["stint_length"] for n in range(1, 6)] == [1, 1, 2, 1, 2]
    assert out[(1, 3)]["tyre_age_safe"] == 1


@pytest.mark.parametrize("second, rate", [
    (91.5, 1.5), (91.5001, 0.0), (89.5, -0.5), (89.49, 0.0), (90.15, 0.15)])
def test_rate_is_kept_inside_the_sane_range(spark, second, rate):
    laps = _laps(spark, [(1, 1, 90.0, "SOFT", None), (1, 2, second, "SOFT", None)])
    row = _one(lap_features(laps))[(1, 2)]
    assert row["tyre_degradation_rate"] == pytest.approx(rate)


@pytest.mark.parametrize("rate, flag, left", [
    (None, False, 999.0), (0.0, False, 999.0), (-0.2, False, 999.0), (0.15, False, 0.0),
    (0.2, True, 0.0), (0.05, False, 2.0)])
def test_pit_window(spark, rate, flag, left):
    row = pit_window(spark.createDataFrame([(rate,)], "tyre_degradation_rate double")).first()
    assert row["should_pit_soon"] is flag
    assert row["estimated_laps_to_pit"] == pytest.approx(left)


def test_sessions_do_not_mix(spark):
    one = _laps(spark, [(1, 1, 80.0, "SOFT", 9), (1, 2, 81.0, "SOFT", 10)])
    two = one.selectExpr("8888 AS session_key", *[c for c in one.columns if c != "session_key"]).withColumn(
        "lap_duration", one["lap_duration"] + 10)
    best = {(r["session_key"], r["lap_number"]): r["personal_best"] for r in lap_features(one.union(two)).collect()}
    assert best[(9999, 2)] == 80.0 and best[(8888, 2)] == 90.0


def test_nan_is_cleaned_at_the_edge(spark):
    laps = clean_numbers(_laps(spark, [(1, 1, math.nan, "nan", 1), (1, 2, 90.0, "SOFT", 1)]))
    values = {r["lap_number"]: r for r in laps.collect()}
    assert values[1]["lap_duration"] is None and values[1]["tyre_compound"] is None
    assert lap_features(laps).count() == 1


def test_any_keys_and_order(spark, rows):
    df = spark.createDataFrame([("a", i, 100.0 + i, i, "x") for i in range(1, 6)],
                               "entity string, step int, cost double, wear int, kind string")
    cols = LapColumns(keys=("entity",), order="step", duration="cost", age="wear", compound="kind")
    out = rolling_avg(df, 2, cols)
    assert rows(out, "step", "rolling_avg_lap_time") == [(1, 101.0), (2, 101.5), (3, 102.5), (4, 103.5), (5, 104.5)]
