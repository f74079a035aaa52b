import json
import os

from pyspark.sql import functions as F

from laplake.sinks.messages import publish
from laplake.sinks.tables import VersionedTable
from laplake.sources.message_log import LogFolder, Written, follow_into, log_batch
from laplake.sources.messages import message_batch, message_stream
from laplake.streaming.features import run_available


def _messages(spark, first, n, topic="laps"):
    return spark.range(first, first + n).select(
        F.lit(topic).alias("topic"), F.concat(F.lit("k"), (F.col("id") % 7).cast("string")).alias("key"),
        F.col("id").cast("string").alias("value")).repartition(3)


def _values(df):
    return sorted(int(bytes(r["value"])) for r in df.collect())


def test_batches_get_offsets_without_gaps(spark, tmp_path):
    servers = f"log:{tmp_path}/log"
    assert message_batch(spark, servers, "laps").count() == 0
    for part in range(3):
        publish(_messages(spark, part * 50, 50), servers)
    publish(_messages(spark, 1000, 5, "pits"), servers)
    publish(_messages(spark, 0, 0), servers)
    rows = message_batch(spark, servers, "laps").collect()
    assert sorted(int(bytes(r["value"])) for r in rows) == list(range(150))
    places, parts = {}, {}
    for r in rows:
        places.setdefault(r["partition"], []).append(r["offset"])
        parts.setdefault(bytes(r["key"]), set()).add(r["partition"])
    assert all(sorted(found) == list(range(len(found))) for found in places.values())
    assert all(len(found) == 1 for found in parts.values())
    # Offsets of later commits lie behind those of earlier ones.
    ends = {}
    for r in sorted(rows, key=lambda r: int(bytes(r["value"])) // 50):
        batch = int(bytes(r["value"])) // 50
        low, high = ends.setdefault((r["partition"], batch), [r["offset"], r["offset"]])
        ends[r["partition"], batch] = [min(low, r["offset"]), max(high, r["offset"])]
    assert all(ends[p, b][1] < ends[p, b + 1][0] for p, b in ends if (p, b + 1) in ends)
    assert _values(message_batch(spark, servers, "laps,pits")) == [*range(150), *range(1000, 1005)]
    assert _values(message_batch(spark, servers, "")) == [*range(150), *range(1000, 1005)]


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    servers, progress = f"log:{tmp_path}/log", str(tmp_path / "progress")
    table = VersionedTable(spark, str(tmp_path / "out"), ["value"])
    for part in range(3):
        publish(_messages(spark, part * 20, 20), servers)
        run_available(message_stream(spark, servers, "laps"), progress, table.write)
    assert table.versions() == [0, 1, 2] and _values(table.all()) == list(range(60))


def test_uncommitted_and_repeated_batches_are_not_read(spark, tmp_path):
    log = LogFolder(str(tmp_path / "log"))
    batch = _messages(spark, 0, 10).coalesce(1).toArrow().to_batches()
    lost = log.write(iter(batch), 2)
    assert log.commits() == 0
    kept = log.write(iter(batch), 2)
    log.append([kept, None], "q/0")
    again = log.write(iter(batch), 2)
    log.append([again], "q/0")
    assert log.commits() == 1 and not any(os.path.exists(f"{log.root}/{s.file}") for s in again.segments)
    log.drop([lost])
    assert _values(log_batch(spark, log.root)) == list(range(10))
    log.append([Written([])], "q/1")
    assert json.loads((tmp_path / "log/commits/000000000001.json").read_text())["segments"] == []


def test_a_stream_as_producer(spark, tmp_path):
    source = str(tmp_path / "in")
    for part in range(2):
        _messages(spark, part * 30, 30).coalesce(1).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    for _ in range(2):  # the second time there is nothing new
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        follow_into(stream, str(tmp_path / "log"), str(tmp_path / "progress"), "copy", availableNow=True).awaitTermination()
    rows = log_batch(spark, str(tmp_path / "log"))
    assert _values(rows) == list(range(60)) and LogFolder(str(tmp_path / "log")).commits() == 2
