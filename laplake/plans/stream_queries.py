"""Streams over landed data; every result equals its batch counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from laplake import constants as C
from laplake.functions.numbers import fixed
from laplake.plans.feed_queries import lap_feed, lap_rows
from laplake.plans.fixtures import RaceData
from laplake.plans.oracle import r6
from laplake.plans.registry import query
from laplake.session import new_folder
from laplake.sinks.messages import lap_messages, publish
from laplake.sinks.tables import VersionedTable
from laplake.sources import messages
from laplake.streaming import live
from laplake.streaming import polls as polls_module
from laplake.streaming.features import FeatureStream, run_available

LAP_SQL = "session_key, driver_number, lap_number"
LAP = ["session_key", "driver_number", "lap_number"]
ROWS_PER_FILE = 1_000_000
BLOCK_BYTES = 8 << 20  # of a file; one task each reads it


def landed(d: RaceData, df, name: str, files: int = 3):
    """Land a frame as files and open them as a stream of one file per trigger."""
    path = new_folder(d.spark, name)
    df.repartition(files).write.option("maxRecordsPerFile", ROWS_PER_FILE).option(
        "parquet.block.size", BLOCK_BYTES).parquet(path)
    return messages.landed_stream(d.spark, path, df.schema, files_per_trigger=1)


def collected(d: RaceData, stream, name: str, keys):
    """Run a stream to its end into a table versioned by batch."""
    table = VersionedTable(d.spark, new_folder(d.spark, name), keys)
    run_available(stream, new_folder(d.spark, "progress"), table.write)
    return table


@query("stream_source", f"""SELECT {LAP_SQL}, {r6('lap_duration')} AS lap_duration, tyre_compound
       FROM laps WHERE event_id % 89 <> 0""")
def _source(d: RaceData):
    decoded = messages.decode_messages(landed(d, lap_feed(d), "messages"))
    rows = collected(d, decoded, "decoded", LAP).all()
    return rows.select(*LAP, fixed("lap_duration", 6).alias("lap_duration"), "tyre_compound")


@query("message_roundtrip", f"""SELECT {LAP_SQL}, {r6('lap_duration')} AS lap_duration, tyre_compound,
       'f1.lap.data' AS topic, TRUE AS in_order FROM laps WHERE event_id % 89 <> 0""")
def _roundtrip(d: RaceData):
    """Published in two parts and followed by a stream that is started anew for the second."""
    servers, progress = f"log:{new_folder(d.spark, 'log')}", new_folder(d.spark, "progress")
    table = VersionedTable(d.spark, new_folder(d.spark, "followed"), LAP)
    feed = lap_feed(d)
    for part in (feed.where("offset % 2 = 0"), feed.where("offset % 2 = 1")):
        publish(part, servers)
        raw = messages.message_stream(d.spark, servers)
        run_available(messages.decode_messages(raw, origin=True), progress, table.write)
    ends = messages.message_batch(d.spark, servers, C.LAP_TOPIC).groupBy("topic", "partition").agg(
        F.countDistinct("offset").alias("n"), F.max("offset").alias("last"))
    gapless = ends.agg(F.bool_and(F.col("n") == F.col("last") + 1)).first()[0]
    return table.all().select(
        *LAP, fixed("lap_duration", 6).alias("lap_duration"), "tyre_compound", F.col("_kafka_topic").alias("topic"),
        F.lit(gapless).alias("in_order"))


def repeated_feed(d: RaceData):
    """Lap messages of which every fifth is sent twice."""
    feed = lap_feed(d)
    copies = F.when(F.col("offset") % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return feed.withColumn("copy", F.explode(copies)).drop("copy")


@query("stream_features", f"""
    SELECT {LAP_SQL}, stint_number, stint_length, should_pit_soon,
           {r6('rolling_avg_lap_time')} AS rolling_avg_lap_time, {r6('personal_best')} AS personal_best,
           {r6('tyre_degradation_rate')} AS tyre_degradation_rate FROM features""")
def _features(d: RaceData):
    stream = messages.decode_messages(landed(d, corrected_feed(d), "laps"), origin=True)
    job = FeatureStream(d.spark, new_folder(d.spark, "live"), order=["_kafka_offset"], merge_every=2)
    run_available(stream.drop("_kafka_topic"), new_folder(d.spark, "progress"), job.process)
    return job.table().select(
        *LAP, "stint_number", "stint_length", "should_pit_soon",
        fixed("rolling_avg_lap_time", 6).alias("rolling_avg_lap_time"),
        fixed("personal_best", 6).alias("personal_best"),
        fixed("tyre_degradation_rate", 6).alias("tyre_degradation_rate"))


def corrected_feed(d: RaceData):
    """Lap messages, every fifth of them after a message with other values, in any order of arrival."""
    copies = F.when(F.col("event_id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    rows = lap_rows(d).withColumn("_right", F.explode(copies))
    rows = rows.withColumns({
        "lap_duration": F.when(F.col("_right") == 1, F.col("lap_duration")).otherwise(F.lit(61.5)),
        "tyre_age_laps": F.when(F.col("_right") == 1, F.col("tyre_age_laps")).otherwise(F.lit(40)),
        "offset": 2 * F.col("event_id") + F.col("_right")})
    return lap_messages(rows.drop("_right", "event_id"), beside=("offset",))


@query("stream_dedup", f"SELECT {LAP_SQL}, tyre_compound FROM laps WHERE event_id % 89 <> 0")
def _dedup(d: RaceData):
    decoded = messages.decode_messages(landed(d, repeated_feed(d), "repeats"))
    timed = decoded.withColumn("event_time", live.event_time())
    rows = collected(d, live.without_repeats(timed, delay="60 days"), "once", LAP).all()
    return rows.select(*LAP, "tyre_compound")


def polled_feed(d: RaceData):
    """(poll, message): laps sent once, pit stops again with every poll, end markers, and a poll after them.

    One pit stop in seven is missing in all polls but the last.
    """
    laps = d.laps.select(*LAP, "event_id", "is_pit_in_lap", (F.col("lap_number") % 3 + 1).alias("begin"))
    pits = laps.where("is_pit_in_lap")
    polls = F.when(F.col("event_id") % 7 == 0, F.array(F.lit(4))).otherwise(F.sequence("begin", F.lit(4)))
    sent = laps.select(F.lit("lap").alias("kind"), *LAP, "event_id", F.col("begin").alias("poll")).unionByName(
        pits.select(F.lit("pit").alias("kind"), *LAP, "event_id", F.explode(polls).alias("poll"))).select(
        "kind", *LAP, "poll", (F.col("poll") * 10_000_000_000 + F.col("event_id")).alias("offset"))
    ends = d.sessions.select(
        F.lit(polls_module.END).alias("kind"), "session_key", *[F.lit(None).cast("int").alias(c) for c in LAP[1:]],
        F.lit(3).alias("poll"), F.lit(39_999_999_999).alias("offset"))
    return sent.unionByName(ends)


@query("stream_pits", """
    SELECT session_key, driver_number, 'lap' AS kind, count(*) AS rows, CAST(0 AS BIGINT) AS repeats, CAST(0 AS BIGINT) AS late
    FROM laps GROUP BY session_key, driver_number
    UNION ALL
    SELECT session_key, driver_number, 'pit', count(*) FILTER (event_id % 7 <> 0),
           CAST(coalesce(sum(2 - lap_number % 3) FILTER (event_id % 7 <> 0), 0) AS BIGINT), count(*)
    FROM laps WHERE is_pit_in_lap GROUP BY session_key, driver_number""")
def _pits(d: RaceData):
    """Laps and pit stops of several polls, followed until the end markers of all sessions came, then on."""
    feed, path = polled_feed(d), new_folder(d.spark, "polls")
    progress = new_folder(d.spark, "progress")
    job = polls_module.PolledFeed(d.spark, new_folder(d.spark, "polled"))
    for poll in (1, 2, 3):
        feed.where(F.col("poll") == poll).drop("poll").write.mode("append").parquet(path)
    stream = messages.landed_stream(d.spark, path, feed.drop("poll").schema, files_per_trigger=100)
    polls_module.run_to_marker(stream, progress, job.process, markers=d.sessions.count())
    feed.where("poll = 4").drop("poll").write.mode("append").parquet(path)
    run_available(stream, progress, job.process)

    def number(outcome):
        return F.count_if(F.col("outcome") == outcome)

    return job.outcomes().groupBy("session_key", "driver_number", "kind").agg(
        number("row").alias("rows"), number("repeat").alias("repeats"), number("late").alias("late"))


@query("stream_latest_position", """
    SELECT session_key, driver_number, coalesce(position, 99) AS position
    FROM (SELECT *, row_number() OVER (PARTITION BY session_key, driver_number ORDER BY ts DESC, event_id) AS place
          FROM positions) WHERE place = 1""")
def _latest(d: RaceData):
    timed = d.positions.withColumn("ts", F.col("ts").cast("timestamp"))
    newest = live.newest_positions(landed(d, timed, "positions"))
    keys = ["session_key", "driver_number"]
    table = VersionedTable(d.spark, new_folder(d.spark, "latest"), keys)
    run_available(newest, new_folder(d.spark, "progress"), table.write, "update")
    return table.latest()


@query("stream_replay", """
    SELECT session_key, CAST(row_number() OVER (
               PARTITION BY session_key ORDER BY stage, lap_number, driver_number) AS BIGINT) AS seq,
           kind, CAST(lap_number AS BIGINT) AS lap_number, CAST(driver_number AS BIGINT) AS driver_number
    FROM (SELECT session_key, 1 AS stage, 'lap' AS kind, lap_number, driver_number FROM laps
          UNION ALL SELECT session_key, 2, 'pit', lap_number, driver_number FROM laps WHERE is_pit_in_lap
          UNION ALL SELECT session_key, 0, 'session_start', min(lap_number), 0 FROM laps GROUP BY session_key
          UNION ALL SELECT session_key, 3, 'session_end', max(lap_number), 0 FROM laps GROUP BY session_key)""")
def _replay(d: RaceData):
    """The replay as it arrives in several micro-batches, in the order of its numbers."""
    path = new_folder(d.spark, "replay")
    laps = d.laps.select(*LAP, "lap_duration", "tyre_compound")
    events = live.replay_events(laps, d.laps.where("is_pit_in_lap").select(*LAP))
    live.land_replay(events, path, per_file=100_000)
    stream = live.replay_stream(d.spark, path, events.schema, files_per_trigger=2)
    arrived = live.in_order(collected(d, stream, "replayed", ["session_key", "seq"]).all())

    def number(*names):
        return F.coalesce(*[F.get_json_object("data", f"$.{name}") for name in names]).cast("long")

    return arrived.select(
        "session_key", "seq", "kind", number("lap_number", "at_lap").alias("lap_number"),
        F.coalesce(number("driver_number"), F.lit(0)).alias("driver_number"))
