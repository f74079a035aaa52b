import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from laplake.operators.features import lap_features
from laplake.operators.groups import HotGroups
from laplake.plans import jobs
from laplake.plans.fixtures import RaceData
from laplake.session import CHECKPOINT_CONF, cut_lineage, shared_dir
from laplake.sinks.tables import write_races
from laplake.sources.tables import available_races, races_per_season, read_races


@pytest.fixture(scope="module")
def laps(spark):
    return RaceData(spark, SMALL).laps.withColumns({"season": F.lit(2024), "round_number": F.col("session_key")})


def _rounds(spark, *items):
    return spark.createDataFrame(list(items), "season int, round_number int, race_name string")


def test_backfill_skips_and_reports(spark, laps, rows, tmp_path):
    rounds = _rounds(spark, (2024, 1, "A GP"), (2024, 2, "B GP"), (2024, 3, "C GP"), (2023, 1, "D GP"))
    done = spark.createDataFrame([(2024, 1)], "season int, round_number int")
    audit = jobs.backfill(spark, laps, rounds, str(tmp_path / "out"), done, seasons=[2024])
    assert rows(audit, "round_number", "outcome") == [(1, "skipped"), (2, "succeeded"), (3, "failed")]
    assert rows(jobs.outcome_counts(audit)) == [("failed", 1), ("skipped", 1), ("succeeded", 1)]
    forced = jobs.backfill_plan(rounds, done, only_rounds=[1], force=True)
    assert rows(forced, "season", "round_number", "skip") == [(2023, 1, False), (2024, 1, False)]


def test_backfill_with_nothing_to_do(spark, laps, rows, tmp_path):
    rounds = _rounds(spark, (2024, 1, "A GP"))
    audit = jobs.backfill(spark, laps, rounds, str(tmp_path / "new"), rounds)
    assert rows(audit, "round_number", "outcome", "rows") == [(1, "skipped", 0)]


def test_a_forced_race_without_rows_has_failed(spark, laps, rows, tmp_path):
    path, none = str(tmp_path / "out"), spark.createDataFrame([], "season int, round_number int")
    rounds = _rounds(spark, (2024, 1, "A GP"), (2024, 2, "B GP"))
    first = jobs.backfill(spark, laps, rounds, path, none)
    assert {r["outcome"] for r in first.collect()} == {"succeeded"}
    broken = laps.withColumn("lap_duration", F.when(F.col("round_number") == 2, F.col("lap_duration")))
    again = jobs.backfill(spark, broken, rounds, path, rounds, force=True)
    assert rows(again, "round_number", "outcome") == [(1, "failed"), (2, "succeeded")]
    assert read_races(spark, path, 2024, 1).count() == 0


def test_a_partly_written_race_is_seen(spark, laps, rows):
    plan = _rounds(spark, (2024, 1, "A GP")).withColumn("skip", F.lit(False))
    expected = jobs.expected_laps(laps)
    written = laps.where("round_number = 1").limit(3)
    assert rows(jobs.backfill_audit(plan, written, expected), "outcome", "rows") == [("partial", 3)]


def test_rows_are_counted_while_they_are_written(spark, laps, rows, tmp_path, monkeypatch):
    path, none = str(tmp_path / "out"), spark.createDataFrame([], "season int, round_number int")
    features = RaceData(spark, SMALL).race_features
    assert write_races(features, path) == features.count()
    assert write_races(features.limit(0), path) == 0
    rounds = _rounds(spark, (2024, 1, "A GP"), (2024, 2, "B GP"))
    monkeypatch.setattr(jobs, "_rows_by_race", None)  # nothing is read back
    whole = jobs.backfill(spark, laps, rounds, path, none)
    assert {r["outcome"] for r in whole.collect()} == {"succeeded"}
    assert sum(r["rows"] for r in whole.collect()) == features.count()
    monkeypatch.undo()
    # A job that loses laps of one race on the way.
    monkeypatch.setattr(jobs, "lap_features", lambda *args, **more: lap_features(*args, **more).where(
        "round_number = 2 OR lap_number > 3"))
    broken = jobs.backfill(spark, laps, rounds, path, none)
    assert rows(broken, "round_number", "outcome") == [(1, "partial"), (2, "succeeded")]


def test_writing_a_race_again_leaves_the_others(spark, laps, tmp_path):
    path = str(tmp_path / "races")
    features = RaceData(spark, SMALL).race_features
    write_races(features, path)
    write_races(features.where("round_number = 2").limit(5), path)
    assert read_races(spark, path, 2024, 2).count() == 5
    assert read_races(spark, path, 2024, 1).count() == features.where("round_number = 1").count()
    assert [tuple(r) for r in available_races(read_races(spark, path)).collect()] == [(2024, 2), (2024, 1)]
    assert [tuple(r) for r in races_per_season(available_races(read_races(spark, path))).collect()] == [(2024, 2)]


def test_race_filters_prune_folders(spark, laps, tmp_path):
    path = str(tmp_path / "races")
    write_races(RaceData(spark, SMALL).race_features, path)
    plan = read_races(spark, path, 2024, 2).select("lap_duration")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan
    assert "ReadSchema: struct<lap_duration:double>" in plan


def test_filters_on_keys_pass_the_windows(spark, tmp_path):
    path = str(tmp_path / "laps")
    laps = RaceData(spark, SMALL).laps.withColumns({"season": F.lit(2024), "round_number": F.col("session_key")})
    laps.write.partitionBy("season", "round_number").parquet(path)
    features = lap_features(read_races(spark, path), hot=HotGroups(["session_key", "driver_number"]))
    chosen = features.where("driver_number = 3").select("lap_number", "rolling_avg_lap_time")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(driver_number,3)" in plan and "GreaterThan(lap_duration,60.0)" in plan
    assert "ReadSchema: struct<session_key:int,driver_number:int,lap_number:int,lap_duration:double>" in plan
    assert plan.count("Exchange hashpartitioning") == 1


class _Cluster:
    """A session that only names its settings."""

    class sparkContext:
        master = "spark://host:7077"

    def __init__(self, **settings):
        self.conf = settings


def test_shared_folder_is_read_from_the_session(spark):
    assert shared_dir(_Cluster(**{CHECKPOINT_CONF: "hdfs://shared/"})) == "hdfs://shared"
    with pytest.raises(ValueError):
        shared_dir(_Cluster())
    assert shared_dir(spark) == shared_dir(spark)


def test_checkpoint_is_reliable(spark):
    df = cut_lineage(spark.range(10))
    assert "ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()
    assert df._jdf.queryExecution().toRdd().dependencies().size() > 0
    assert df.count() == 10
