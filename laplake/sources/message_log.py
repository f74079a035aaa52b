"""Topics as a log of files: a Spark data source for places without a message broker.

A batch of messages becomes Parquet segments, one per task, topic and partition, and a
commit that names them and their first offsets. Readers see committed segments only, in
the order of commits, so a stream's position is the number of commits it has read.
One query may write to a log at a time.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)

NAME = "message_log"
PREFIX = "log:"
PARTITIONS = 4
SCHEMA = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp"
SEGMENT = pa.schema([("key", pa.binary()), ("value", pa.binary())])
READ_ROWS = 10_000  # messages handed to Spark at a time


@dataclass
class Segment(InputPartition):
    topic: str
    partition: int
    file: str
    rows: int
    first: int = 0
    at: float = 0.0


@dataclass
class Written(WriterCommitMessage):
    segments: list


class LogFolder:
    """The files of a log, on any file system that Arrow knows."""

    def __init__(self, path: str):
        self.fs, self.root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))

    def commits(self) -> int:
        """How many commits there are; they are numbered from 0 without a gap."""
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/commits", allow_not_found=True))
        return 1 + max((int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json")), default=-1)

    def commit(self, number: int) -> dict:
        with self.fs.open_input_stream(f"{self.root}/commits/{number:012d}.json") as file:
            return json.loads(file.read())

    def segments(self, start: int, end: int) -> list[Segment]:
        return [Segment(**s, at=c["at"]) for c in map(self.commit, range(start, end)) for s in c["segments"]]

    def write(self, batches: Iterator[pa.RecordBatch], partitions: int) -> Written:
        """Segments of one task, not yet committed; a key always falls into the same partition."""
        self.fs.create_dir(f"{self.root}/segments", recursive=True)
        writers, rows, task = {}, {}, uuid.uuid4().hex
        try:
            for batch in batches:
                topics = batch.column("topic").to_pylist()
                keys = batch.column("key").cast(pa.binary())
                parts = [zlib.crc32(k or b"") % partitions for k in keys.to_pylist()]
                places: dict[tuple, list[int]] = {}
                for at, place in enumerate(zip(topics, parts, strict=True)):
                    places.setdefault(place, []).append(at)
                for place, own in places.items():
                    if place not in writers:
                        name = f"segments/{task}-{len(writers)}.parquet"
                        writers[place] = name, pq.ParquetWriter(f"{self.root}/{name}", SEGMENT, filesystem=self.fs)
                        rows[place] = 0
                    mine = pa.table([keys, batch.column("value").cast(pa.binary())], schema=SEGMENT).take(pa.array(own))
                    writers[place][1].write_table(mine)
                    rows[place] += len(own)
        finally:
            for _, writer in writers.values():
                writer.close()
        return Written([Segment(topic, part, name, rows[topic, part]) for (topic, part), (name, _) in writers.items()])

    def append(self, messages: list[Written | None], batch: str) -> None:
        """Commit segments under the next offsets; a batch that is there already changes nothing."""
        number = self.commits()
        ends: dict[str, int] = {}
        if number:
            last = self.commit(number - 1)
            if last["batch"] == batch:
                return self.drop(messages)
            ends = dict(last["ends"])
        segments = []
        for s in (s for m in messages if m is not None for s in m.segments):
            place = f"{s.topic}/{s.partition}"
            segments.append({"topic": s.topic, "partition": s.partition, "file": s.file, "rows": s.rows, "first": ends.get(place, 0)})
            ends[place] = ends.get(place, 0) + s.rows
        self.fs.create_dir(f"{self.root}/commits", recursive=True)
        place = f"{self.root}/commits/{number:012d}"
        with self.fs.open_output_stream(f"{place}.tmp") as file:
            file.write(json.dumps({"batch": batch, "at": time.time(), "segments": segments, "ends": ends}).encode())
        self.fs.move(f"{place}.tmp", f"{place}.json")

    def drop(self, messages: list[Written | None]) -> None:
        for s in (s for m in messages if m is not None for s in m.segments):
            self.fs.delete_file(f"{self.root}/{s.file}")

    def read(self, segment: Segment) -> Iterator[pa.RecordBatch]:
        first = segment.first
        with pq.ParquetFile(f"{self.root}/{segment.file}", filesystem=self.fs) as file:
            for batch in file.iter_batches(READ_ROWS):
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([
                    batch.column("key"), batch.column("value"), pa.array([segment.topic] * n, pa.string()),
                    pa.array([segment.partition] * n, pa.int32()), pa.array(range(first, first + n), pa.int64()),
                    pa.array([int(segment.at * 1e6)] * n, pa.timestamp("us", tz="UTC"))],
                    names=["key", "value", "topic", "partition", "offset", "timestamp"])
                first += n


class _Options:
    def __init__(self, options):
        self.path, self.topics = options["path"], [t for t in options.get("topics", "").split(",") if t]
        self.partitions, self.batch = int(options.get("partitions", PARTITIONS)), options.get("producer") or uuid.uuid4().hex

    def chosen(self, segments: list[Segment]) -> list[Segment]:
        return [s for s in segments if not self.topics or s.topic in self.topics]


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = _Options(options)

    def partitions(self):
        folder = LogFolder(self.options.path)
        return self.options.chosen(folder.segments(0, folder.commits())) or [Segment("", 0, "", 0)]

    def read(self, partition):
        return LogFolder(self.options.path).read(partition) if partition.file else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.options = _Options(options)

    def initialOffset(self):
        return {"commits": 0}

    def latestOffset(self):
        return {"commits": LogFolder(self.options.path).commits()}

    def partitions(self, start, end):
        return self.options.chosen(LogFolder(self.options.path).segments(start["commits"], end["commits"]))

    def read(self, partition):
        return LogFolder(self.options.path).read(partition)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.options = _Options(options)

    def write(self, iterator):
        return LogFolder(self.options.path).write(iterator, self.options.partitions)

    def commit(self, messages):
        LogFolder(self.options.path).append(messages, self.options.batch)

    def abort(self, messages):
        LogFolder(self.options.path).drop(messages)


class _StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, options):
        self.options = _Options(options)

    def write(self, iterator):
        return LogFolder(self.options.path).write(iterator, self.options.partitions)

    def commit(self, messages, batchId):
        LogFolder(self.options.path).append(messages, f"{self.options.batch}/{batchId}")

    def abort(self, messages, batchId):
        LogFolder(self.options.path).drop(messages)


class MessageLog(DataSource):
    """Format ``message_log``: option ``path``, and ``topics``, ``partitions`` or ``producer``."""

    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)

    def streamWriter(self, schema, overwrite):
        return _StreamWriter(self.options)


def _columns(messages: DataFrame) -> DataFrame:
    return messages.select("topic", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))


def log_stream(spark: SparkSession, path: str, topics: str = "") -> DataFrame:
    spark.dataSource.register(MessageLog)
    return spark.readStream.format(NAME).option("path", path).option("topics", topics).load()


def log_batch(spark: SparkSession, path: str, topics: str = "") -> DataFrame:
    spark.dataSource.register(MessageLog)
    return spark.read.format(NAME).option("path", path).option("topics", topics).load()


def append_messages(messages: DataFrame, path: str, partitions: int = PARTITIONS) -> None:
    """Append a batch of (topic, key, value) to a log, in one commit."""
    messages.sparkSession.dataSource.register(MessageLog)
    _columns(messages).write.format(NAME).mode("append").option("path", path).option("partitions", partitions).save()


def follow_into(messages: DataFrame, path: str, checkpoint: str, producer: str, partitions: int = PARTITIONS, **trigger):
    """Append a stream of messages; a micro-batch that is run again is not written twice.

    ``producer`` names the query, the same after a restart.
    """
    messages.sparkSession.dataSource.register(MessageLog)
    return (_columns(messages).writeStream.format(NAME).option("path", path).option("partitions", partitions)
            .option("producer", producer).option("checkpointLocation", checkpoint).trigger(**trigger).start())
