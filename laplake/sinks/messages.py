"""Keyed JSON messages for topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laplake import constants as C
from laplake.sources.message_log import PREFIX, append_messages


def _message(df: DataFrame, topic: str, key: Column, body: Column, *beside: Column) -> DataFrame:
    value = F.to_json(body, {"ignoreNullFields": "false"})
    return df.select(F.lit(topic).alias("topic"), key.alias("key"), value.alias("value"), *beside)


def _joined(*names: str) -> Column:
    return F.concat_ws(":", *[F.col(name).cast("string") for name in names])


def lap_messages(laps: DataFrame, topic: str = C.LAP_TOPIC, beside: tuple[str, ...] = ()) -> DataFrame:
    """Lap messages; columns named ``beside`` stay outside the message."""
    body = F.struct(*[name for name in laps.columns if name not in beside])
    key = _joined("session_key", "driver_number", "lap_number")
    return _message(laps, topic, key, body, *[F.col(name) for name in beside])


def pit_messages(pits: DataFrame, topic: str = C.PIT_TOPIC) -> DataFrame:
    return _message(pits, topic, _joined("session_key", "driver_number", "lap_number"), F.struct("*"))


def position_messages(positions: DataFrame, topic: str = C.POSITION_TOPIC) -> DataFrame:
    return _message(positions, topic, _joined("session_key", "driver_number"), F.struct("*"))


def session_messages(events: DataFrame, event_type: str, topic: str = C.SESSION_TOPIC) -> DataFrame:
    """Session events: the type is the key and the first field; a type in the data wins."""
    others = [F.col(name) for name in events.columns if name != "event_type"]
    kind = F.col("event_type") if "event_type" in events.columns else F.lit(event_type)
    return _message(events, topic, F.lit(event_type), F.struct(kind.alias("event_type"), *others))


def driver_messages(drivers: DataFrame, topic: str = C.DRIVER_TOPIC) -> DataFrame:
    return _message(drivers, topic, F.col("driver_number").cast("string"), F.struct("*"))


def publish(messages: DataFrame, servers: str) -> None:
    """Write messages; the topic column routes each row. ``log:`` and a path name a log of files."""
    if servers.startswith(PREFIX):
        append_messages(messages, servers.removeprefix(PREFIX))
        return
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).save()
