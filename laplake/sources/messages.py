"""Message streams: reading, decoding, rejects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from laplake import constants as C
from laplake import schemas
from laplake.functions.numbers import nan_to_null
from laplake.sources.message_log import PREFIX, log_batch, log_stream


def message_stream(spark: SparkSession, servers: str, topics: str = C.LAP_TOPIC,
                   max_offsets: int = 1_000_000) -> DataFrame:
    """Topic rows from the earliest offset; lost segments do not stop the query.

    ``max_offsets`` bounds a micro-batch, and with it the state and the rewrite
    that one batch can cause. ``log:`` and a path name a log of files instead of servers.
    """
    if servers.startswith(PREFIX):
        return log_stream(spark, servers.removeprefix(PREFIX), topics)
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topics)
        .option("startingOffsets", "earliest")
        .option("failOnDataLoss", "false")
        .option("maxOffsetsPerTrigger", max_offsets)
        .load()
    )


def message_batch(spark: SparkSession, servers: str, topics: str,
                  starting: str = "earliest", ending: str = "latest") -> DataFrame:
    """A bounded read of topics; offsets are JSON maps or earliest / latest. A log of files is read whole."""
    if servers.startswith(PREFIX):
        return log_batch(spark, servers.removeprefix(PREFIX), topics)
    return (
        spark.read.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topics)
        .option("startingOffsets", starting)
        .option("endingOffsets", ending)
        .load()
    )


def landed_stream(spark: SparkSession, path: str, schema: StructType, file_format: str = "parquet",
                  files_per_trigger: int = 1000) -> DataFrame:
    """Files landed in a folder, as a stream with a bounded batch."""
    return (
        spark.readStream.schema(schema).format(file_format)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(path)
    )


def clean_numbers(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column, text ``nan`` in every compound."""
    fixed = {
        field.name: nan_to_null(field.name)
        for field in df.schema.fields if isinstance(field.dataType, (DoubleType, FloatType))
    }
    if "tyre_compound" in df.columns:
        fixed["tyre_compound"] = F.when(F.col("tyre_compound") != "nan", F.col("tyre_compound"))
    return df.withColumns(fixed) if fixed else df


def _decoded(raw: DataFrame, schema: StructType, others: list[Column]) -> DataFrame:
    """Message fields as columns; the generator keeps later filters above the
    parser, so every message is parsed once. A broken message gives NULLs."""
    data = F.from_json(F.col("value").cast("string"), schema)
    return raw.select(*others, F.inline(F.array(data)))


def decode_messages(raw: DataFrame, schema: StructType = schemas.LAP,
                    keys: tuple[str, ...] = ("driver_number", "lap_number"),
                    origin: bool = False) -> DataFrame:
    """Typed rows of JSON messages; rows without their keys are dropped.

    ``origin`` adds the topic and the offset of every message.
    """
    names = ("topic", "offset") if origin else ()
    typed = _decoded(raw, schema, [F.col(name).alias(f"_kafka_{name}") for name in names])
    for key in keys:
        typed = typed.where(F.col(key).isNotNull())
    return clean_numbers(typed).select(*schema.names, *[f"_kafka_{name}" for name in names])


def rejected_messages(raw: DataFrame, schema: StructType = schemas.LAP,
                      keys: tuple[str, ...] = ("driver_number", "lap_number")) -> DataFrame:
    """Messages that ``decode_messages`` drops, for a quarantine table."""
    needed = StructType([schema[key] for key in keys])
    typed = _decoded(raw, needed, [F.struct(*raw.columns).alias("_message")])
    missing = reduce(lambda a, b: a | b, (F.col(key).isNull() for key in keys))
    return typed.where(missing).select("_message.*")


def first_messages(rows: DataFrame, count: int) -> DataFrame:
    """The first messages by topic and offset, for a bounded look."""
    return rows.orderBy("_kafka_topic", "_kafka_offset").limit(count)
