"""Live feeds: repeated events, newest positions, replays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from laplake import constants as C
from laplake.operators.groups import numbered
from laplake.sources.messages import landed_stream

LAP_KEYS = ("session_key", "driver_number", "lap_number")


def event_time(column: str | Column = "timestamp") -> Column:
    """Event time of a message; watermarks need a timestamp with zone."""
    value = F.col(column) if isinstance(column, str) else column
    return value.cast("timestamp")


def without_repeats(stream: DataFrame, keys: Sequence[str] = LAP_KEYS, time: str = "event_time",
                    delay: str = "1 day") -> DataFrame:
    """First message of every key within the delay.

    Polls send all pit stops and positions again and may bring a lap late, so
    the key decides what is new, not a cursor.
    """
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def newest_positions(stream: DataFrame, keys: Sequence[str] = ("session_key", "driver_number"),
                     order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Newest position per driver, 99 if it is missing, for update or complete output."""
    first_of_equal = F.struct(F.col(order[0]), *[-F.col(name) for name in order[1:]])
    newest = F.max_by("position", first_of_equal)
    return stream.groupBy(*keys).agg(F.coalesce(newest, F.lit(C.UNPLACED)).alias("position"))


def replay_events(laps: DataFrame, pits: DataFrame) -> DataFrame:
    """Everything a finished session sends, numbered in order: (session_key, seq, kind, data).

    First the start marker, then the laps by lap and driver, then the pit stops by
    lap and driver, last the end marker. ``data`` is the message as JSON.
    """

    def rows(frame: DataFrame, kind: str, rank: int) -> DataFrame:
        return frame.select(
            "session_key", F.lit(rank).alias("_rank"), F.col("lap_number").alias("_lap"),
            F.col("driver_number").alias("_driver"), F.lit(kind).alias("kind"),
            F.to_json(F.struct(*frame.columns)).alias("data"))

    markers = session_events(laps).select(
        "session_key", F.when(F.col("event_type") == "session_start", 0).otherwise(3).alias("_rank"),
        F.col("at_lap").alias("_lap"), F.lit(0).alias("_driver"), F.col("event_type").alias("kind"),
        F.to_json(F.struct("session_key", "event_type", "at_lap", "laps")).alias("data"))
    events = rows(laps, "lap", 1).union(rows(pits, "pit", 2)).union(markers)
    numbers = numbered(events, ["session_key"], ["_rank", "_lap", "_driver", "data"], "seq", dtype="long")
    return numbers.select("session_key", "seq", "kind", "data")


def land_replay(events: DataFrame, path: str, per_file: int = 1000, file_format: str = "parquet") -> None:
    """Write replay events as files of consecutive numbers, each in order.

    File streams go by modification time, which says little within one job. The
    number in every row is what orders a replay; ``in_order`` restores it.
    """
    step = F.floor((F.col("seq") - 1) / per_file)
    events.withColumn("_step", step).repartition("session_key", "_step").sortWithinPartitions(
        "session_key", "seq").drop("_step").write.option("maxRecordsPerFile", per_file).format(file_format).save(path)


def replay_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1,
                  file_format: str = "parquet") -> DataFrame:
    """Landed replay files as a stream, a few files per trigger."""
    return landed_stream(spark, path, schema, file_format, files_per_trigger)


def in_order(events: DataFrame) -> DataFrame:
    """Replay events of any batches, by session and number; every number once."""
    return events.dropDuplicates(["session_key", "seq"]).repartitionByRange("session_key", "seq").sortWithinPartitions(
        "session_key", "seq")


def session_events(laps: DataFrame) -> DataFrame:
    """Start and end marker of every session, with its first and last lap."""
    bounds = laps.groupBy("session_key").agg(
        F.min("lap_number").alias("first_lap"), F.max("lap_number").alias("last_lap"),
        F.count(F.lit(1)).alias("laps"))
    marker = F.array(
        F.struct(F.lit("session_start").alias("event_type"), F.col("first_lap").alias("at_lap")),
        F.struct(F.lit("session_end").alias("event_type"), F.col("last_lap").alias("at_lap")))
    return bounds.select("session_key", F.explode(marker).alias("e"), "laps").select(
        "session_key", "e.event_type", "e.at_lap", "laps")
