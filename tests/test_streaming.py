import json

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from laplake.operators.features import lap_features
from laplake.operators.groups import Limits
from laplake.plans.fixtures import RaceData
from laplake.sinks.tables import VersionedTable
from laplake.sources import messages
from laplake.streaming import live
from laplake.streaming.features import FeatureStream, run_available
from laplake.streaming.keyed import ordered_features

NAMES = ["session_key", "driver_number", "lap_number", "lap_duration", "prev_tyre_age", "is_new_stint",
         "stint_number", "rolling_avg_lap_time", "personal_best", "lap_delta", "stint_length",
         "stint_start_lap_time", "tyre_degradation_rate", "should_pit_soon", "estimated_laps_to_pit"]
LAP = ["session_key", "driver_number", "lap_number", "lap_duration", "tyre_compound", "tyre_age_laps"]


@pytest.fixture(scope="module")
def data(spark):
    return RaceData(spark, SMALL)


def _land(df, path, condition, count):
    """Write files one after another, so the stream reads them in this order."""
    for at in range(count):
        df.where(F.expr(condition) == at).coalesce(1).write.mode("append").parquet(path)


def test_shuffled_and_repeated_laps_equal_batch(spark, data, rows, tmp_path):
    path = str(tmp_path / "in")
    _land(data.laps.select(*LAP), path, "pmod(xxhash64(lap_number, driver_number), 3)", 3)
    data.laps.select(*LAP).where("lap_number % 4 = 0").coalesce(1).write.mode("append").parquet(path)
    stream = messages.landed_stream(spark, path, data.laps.select(*LAP).schema, files_per_trigger=1)
    job = FeatureStream(spark, str(tmp_path / "out"))
    run_available(stream, str(tmp_path / "progress"), job.process)
    assert job.live.versions() == [0, 1, 2, 3]
    assert rows(job.table(), *NAMES) == rows(data.features, *NAMES)


@pytest.mark.parametrize("order", [["seq"], []])
def test_the_size_of_batches_does_not_matter(spark, data, rows, tmp_path, order):
    """Contradicting messages for a lap, in files whose order is not that of the messages."""
    path = str(tmp_path / "in")
    laps = data.laps.select(*LAP).where("driver_number < 12")
    early = laps.where("lap_number % 3 = 0").withColumns({"lap_duration": F.lit(95.0), "seq": F.lit(1)})
    frames = [laps.withColumn("seq", F.lit(2)).where("lap_number % 2 = 0"), early,
              laps.withColumn("seq", F.lit(2)).where("lap_number % 2 = 1")]
    for frame in frames:
        frame.select(*LAP, *order).coalesce(1).write.mode("append").parquet(path)
    results = []
    for files in (1, 2, 1000):
        job = FeatureStream(spark, str(tmp_path / f"out{files}"), order=order, merge_every=2)
        stream = messages.landed_stream(spark, path, frames[0].select(*LAP, *order).schema, files_per_trigger=files)
        run_available(stream, str(tmp_path / f"progress{files}"), job.process)
        results.append(rows(job.table(), *NAMES))
    assert results[0] == results[1] == results[2]
    if order:
        assert results[0] == rows(data.features.where("driver_number < 12"), *NAMES)


def _counted(job, table):
    """Rows written so far to a table of the job, by version."""
    written, write = {}, table.write

    def counting(frame, version):
        write(frame, version)
        written[version] = table.all().where(F.col("version") == version).count()

    table.write = counting
    return written


def test_many_batches_keep_few_versions(spark, data, rows, tmp_path):
    job = FeatureStream(spark, str(tmp_path / "out"), merge_every=4)
    laps = data.laps.select(*LAP).where("driver_number < 6")
    written = _counted(job, job.raw)
    for batch in range(20):
        job.process(laps.where(f"lap_number % 20 = {batch}"), batch)
        for table in (job.raw, job.features, job.live):
            assert len(table.versions()) <= 3 * 2 + 1
    # Twenty batches in levels of four: every row once as it came, and at most twice in merges.
    assert laps.count() < sum(written.values()) <= 3 * laps.count()
    assert job.raw.all().count() == laps.count()
    assert rows(job.table(), *NAMES) == rows(data.features.where("driver_number < 6"), *NAMES)


def test_only_sessions_with_many_versions_are_rewritten(spark, data, rows, tmp_path):
    """A hundred sessions, of which ten come in six parts and the others in one."""
    job = FeatureStream(spark, str(tmp_path / "out"), merge_every=3)
    some = data.laps.select(*LAP).where("session_key = 1 AND driver_number = 1 AND lap_number <= 6")
    laps = some.drop("session_key").crossJoin(spark.range(100).select(F.col("id").cast("int").alias("session_key")))
    laps = laps.select(*LAP).persist()
    written = _counted(job, job.raw)
    batch = F.when(F.col("session_key") % 10 == 0, F.col("lap_number") % 6).otherwise(F.floor(F.col("session_key") / 17))
    for at in range(6):
        job.process(laps.where(batch == at), at)
    # Both threes of parts are merged, the two results and the other sessions are not.
    assert sum(written.values()) - laps.count() == laps.where("session_key % 10 = 0").count()
    versions = job.live.all().groupBy("session_key").agg(F.countDistinct("version").alias("n"))
    assert versions.agg(F.max("n")).first()[0] == 2
    assert rows(job.table(), *NAMES) == rows(lap_features(laps), *NAMES)


@pytest.mark.parametrize("step", ["raw", "features", "live", "remove"])
def test_a_merge_that_fails_anywhere_loses_nothing(spark, data, rows, tmp_path, step):
    laps = data.laps.select(*LAP).where("driver_number < 4")
    job = FeatureStream(spark, str(tmp_path / "out"), merge_every=3)
    for batch in range(2):
        job.process(laps.where(f"lap_number % 4 = {batch}"), batch)
    calls = []

    class Stop(Exception):
        pass

    def failing(*args):
        calls.append(args)
        raise Stop

    if step == "remove":
        job.features.remove = failing
    else:
        table, write = getattr(job, step), getattr(job, step).write
        table.write = lambda frame, version: failing() if version == 3 else write(frame, version)
    with pytest.raises(Stop):
        job.process(laps.where("lap_number % 4 = 2"), 2)
    again = FeatureStream(spark, str(tmp_path / "out"), merge_every=3)
    assert rows(again.table(), *NAMES) == rows(lap_features(laps.where("lap_number % 4 < 3")), *NAMES)
    again.process(laps.where("lap_number % 4 = 2"), 2)
    again.process(laps.where("lap_number % 4 = 3"), 3)
    assert rows(again.table(), *NAMES) == rows(lap_features(laps), *NAMES)
    assert calls and len(again.live.versions()) <= 4


def test_a_retry_after_a_merge_reads_live_versions_only(spark, data, rows, tmp_path):
    laps = data.laps.select(*LAP).where("driver_number < 4")
    job = FeatureStream(spark, str(tmp_path / "out"), merge_every=2)
    job.process(laps.where("lap_number % 2 = 0"), 0)
    job.process(laps.where("lap_number % 2 = 1"), 1)
    assert job.raw.versions() == job.features.versions() == job.live.versions() == [2]
    job.process(laps.where("lap_number % 2 = 1"), 1)
    assert job.raw.versions() == [2, 3] and job.raw.all().where("version < 2").count() == 0
    assert rows(job.table(), *NAMES) == rows(data.features.where("driver_number < 4"), *NAMES)


def test_a_version_is_replaced_as_a_whole(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["id"], ["part"])
    schema = "id int, name string, part int"
    table.write(spark.createDataFrame([(1, "a", 1), (2, "b", 2)], schema), 0)
    table.write(spark.createDataFrame([(1, "c", 1)], schema), 0)
    assert [tuple(r) for r in table.latest().collect()] == [(1, "c", 1)]
    table.write(spark.createDataFrame([(1, "d", 1), (1, "e", 1), (3, "f", 2)], schema), 1)
    assert sorted(tuple(r) for r in table.latest().collect()) == [(1, "e", 1), (3, "f", 2)]
    table.merge(2)
    assert table.versions() == [2]
    assert sorted(tuple(r) for r in VersionedTable(spark, table.path, ["id"]).latest().select("id", "name").collect()) == [(1, "e"), (3, "f")]


def test_a_retried_batch_changes_nothing(spark, data, rows, tmp_path):
    job = FeatureStream(spark, str(tmp_path / "out"))
    laps = data.laps.select(*LAP)
    job.process(laps.where("lap_number <= 20"), 0)
    job.process(laps.where("lap_number > 20"), 1)
    first = rows(job.table(), *NAMES)
    job.process(laps.where("lap_number > 20"), 1)
    assert rows(job.table(), *NAMES) == first == rows(data.features, *NAMES)


def test_a_corrected_lap_can_leave_the_table(spark, data, tmp_path):
    job = FeatureStream(spark, str(tmp_path / "out"), order=["seq"])
    laps = data.laps.select(*LAP, F.lit(1).alias("seq")).where("session_key = 1 AND driver_number = 1")
    job.process(laps, 0)
    assert job.table().count() > 0
    job.process(laps.withColumns({"lap_duration": F.lit(300.0), "seq": F.lit(2)}), 1)
    assert job.table().count() == 0


def test_hot_drivers_in_a_batch(spark, data, rows, tmp_path):
    limits = Limits(group_rows=7)
    job = FeatureStream(spark, str(tmp_path / "out"), limits=limits)
    laps = data.laps.select(*LAP)
    job.process(laps.where("lap_number % 2 = 0"), 0)
    job.process(laps.where("lap_number % 2 = 1"), 1)
    assert rows(job.table(), *NAMES) == rows(data.features, *NAMES)


def test_laps_computed_stay_in_proportion_to_laps_that_came(spark, data, rows, tmp_path):
    """Every batch touches every driver, so computing all their laps with each would grow with the square."""
    job = FeatureStream(spark, str(tmp_path / "out"), limits=Limits(group_rows=50), merge_every=100)
    laps = data.laps.select(*LAP).where("driver_number < 6").persist()
    written = _counted(job, job.features)
    for batch in range(8):
        job.process(laps.where(f"lap_number % 8 = {batch}"), batch)
        if batch in (2, 5):
            some = laps.where(f"lap_number % 8 <= {batch}")
            assert rows(job.table(), *NAMES) == rows(lap_features(some), *NAMES)
    assert sum(written.values()) <= 2 * laps.count()
    assert rows(job.table(), *NAMES) == rows(data.features.where("driver_number < 6"), *NAMES)


def test_late_features_after_merges_retries_and_restarts(spark, data, rows, tmp_path):
    """Corrected laps and sessions that come at different times, with features that wait for the next computing."""
    limits, place = Limits(group_rows=50), F.pmod(F.xxhash64("lap_number", "driver_number"), F.lit(7))
    laps = data.laps.select(*LAP).where("driver_number < 6")
    wrong = laps.withColumns({"lap_duration": F.lit(95.0), "seq": F.lit(1), "at": (place + 3) % 7}).where("lap_number % 3 = 0")
    sent = laps.withColumns({"seq": F.lit(2), "at": place}).where("session_key = 1 OR at > 4").unionByName(wrong).persist()
    waited = 0
    for batch in range(7):
        job = FeatureStream(spark, str(tmp_path / "out"), limits=limits, order=["seq"], merge_every=2)
        for _ in range(2 if batch == 4 else 1):
            job.process(sent.where(F.col("at") == batch).drop("at"), batch)
        again = FeatureStream(spark, str(tmp_path / "out"), limits=limits, order=["seq"], merge_every=2)
        waited += again._late().count()
        newest = sent.where(F.col("at") <= batch).groupBy(*LAP[:3]).agg(
            F.max_by(F.struct(*LAP[3:]), "seq").alias("lap")).select(*LAP[:3], "lap.*")
        want = rows(lap_features(newest), *NAMES)
        assert rows(job.table(), *NAMES) == want and rows(again.table(), *NAMES) == want
    assert waited


def test_empty_batches_write_nothing(spark, data, tmp_path):
    FeatureStream(spark, str(tmp_path / "out")).process(data.laps.select(*LAP).limit(0), 0)
    assert not (tmp_path / "out").exists()


def test_keyed_state_equals_batch_for_ordered_laps(spark, data, rows, tmp_path):
    path = str(tmp_path / "in")
    _land(data.laps.select(*LAP), path, "least(floor((lap_number - 1) / 15), 3)", 4)
    stream = messages.landed_stream(spark, path, data.laps.select(*LAP).schema, files_per_trigger=1)
    table = VersionedTable(spark, str(tmp_path / "out"), LAP[:3])
    run_available(ordered_features(stream), str(tmp_path / "progress"), table.write)
    assert rows(table.all(), *NAMES) == rows(data.features, *NAMES)


def test_repeats_are_dropped_across_batches(spark, data, tmp_path):
    path = str(tmp_path / "in")
    timed = data.laps.select(*LAP, F.col("ts").cast("timestamp").alias("event_time"))
    for _ in range(2):
        timed.coalesce(1).write.mode("append").parquet(path)
    stream = messages.landed_stream(spark, path, timed.schema, files_per_trigger=1)
    table = VersionedTable(spark, str(tmp_path / "out"), LAP[:3])
    run_available(live.without_repeats(stream, delay="60 days"), str(tmp_path / "progress"), table.write)
    assert table.all().count() == timed.count()


def test_replay_is_in_order(spark, data, tmp_path):
    path = str(tmp_path / "replay")
    laps, pits = data.laps.select(*LAP), data.laps.where("is_pit_in_lap").select(*LAP[:3])
    events = live.replay_events(laps, pits)
    live.land_replay(events, path, per_file=50)
    stream = live.replay_stream(spark, path, events.schema, files_per_trigger=5)
    table = VersionedTable(spark, str(tmp_path / "out"), ["session_key", "seq"])
    run_available(stream, str(tmp_path / "progress"), table.write)
    assert len(table.versions()) > 3
    found = live.in_order(table.all()).collect()
    assert len(found) == laps.count() + pits.count() + 2 * laps.select("session_key").distinct().count()
    for session in {r["session_key"] for r in found}:
        mine = [r for r in found if r["session_key"] == session]
        assert [r["seq"] for r in mine] == list(range(1, len(mine) + 1))
        kinds = [r["kind"] for r in mine]
        assert kinds[0] == "session_start" and kinds[-1] == "session_end"
        assert kinds[1:-1] == sorted(kinds[1:-1])
        numbers = [json.loads(r["data"])["lap_number"] for r in mine if r["kind"] == "lap"]
        assert numbers == sorted(numbers)


def test_a_missing_newest_position_is_99(spark):
    df = spark.createDataFrame([(1, 1, 5, 10, 1), (1, 1, None, 20, 2)], "session_key int, driver_number int, position int, ts int, event_id int")
    assert [tuple(r) for r in live.newest_positions(df).collect()] == [(1, 1, 99)]


def test_start_uses_the_given_trigger(spark, data, tmp_path):
    path = str(tmp_path / "in")
    data.laps.select(*LAP).coalesce(1).write.parquet(path)
    stream = messages.landed_stream(spark, path, data.laps.select(*LAP).schema)
    job = FeatureStream(spark, str(tmp_path / "out"))
    query = job.start(stream, str(tmp_path / "progress"), availableNow=True)
    query.awaitTermination()
    assert job.table().count() == data.features.count()
