"""Messages, normalised feeds and table sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from laplake.functions.numbers import fixed
from laplake.plans.fixtures import RaceData
from laplake.plans.oracle import r6
from laplake.plans.registry import query
from laplake.session import new_folder
from laplake.sinks import messages as out
from laplake.sinks.tables import write_races
from laplake.sources import feeds, messages
from laplake.sources.tables import read_races

LAP_SQL = "session_key, driver_number, lap_number"


def lap_rows(d: RaceData):
    """Laps in the message schema; a missing time is sent as NaN."""
    return d.laps.select(
        "session_key", "driver_number", "lap_number",
        F.coalesce("lap_duration", F.lit(float("nan"))).alias("lap_duration"),
        (F.col("value") / 4).alias("sector_1_time"), (F.col("value") / 2).alias("sector_2_time"),
        (F.col("value") / 4).alias("sector_3_time"), "tyre_compound", "tyre_age_laps",
        "is_pit_out_lap", "is_pit_in_lap",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.lit("test").alias("source"), "event_id")


def lap_feed(d: RaceData):
    """Topic rows with an offset; some values are cut short and do not parse."""
    offset = F.col("offset")
    encoded = out.lap_messages(lap_rows(d).withColumnRenamed("event_id", "offset"), beside=("offset",))
    broken = F.when(offset % 89 == 0, F.substring("value", 1, 20)).otherwise(F.col("value"))
    return encoded.select("topic", "key", broken.alias("value"), "offset")


@query("decode_lap_json", f"""SELECT {LAP_SQL}, {r6('lap_duration')} AS lap_duration, tyre_compound, tyre_age_laps,
       is_pit_out_lap, is_pit_in_lap, 'f1.lap.data' AS _kafka_topic, event_id AS _kafka_offset
       FROM laps WHERE event_id % 89 <> 0""")
def _decode(d: RaceData):
    rows = messages.decode_messages(lap_feed(d), origin=True)
    return rows.select(
        "session_key", "driver_number", "lap_number", fixed("lap_duration", 6).alias("lap_duration"),
        "tyre_compound", "tyre_age_laps", "is_pit_out_lap", "is_pit_in_lap", "_kafka_topic", "_kafka_offset")


@query("rejected_lap_json", """SELECT concat_ws(':', session_key, driver_number, lap_number) AS key,
       event_id AS "offset" FROM laps WHERE event_id % 89 = 0""")
def _rejected(d: RaceData):
    return messages.rejected_messages(lap_feed(d)).select("key", "offset")


@query("encode_messages", """
    SELECT 'f1.lap.data' AS topic, concat_ws(':', session_key, driver_number, lap_number) AS key,
           CAST(driver_number AS VARCHAR) AS driver, CAST(NULL AS VARCHAR) AS event FROM laps
    UNION ALL SELECT 'f1.pit.stops', concat_ws(':', session_key, driver_number, lap_number),
           CAST(driver_number AS VARCHAR), NULL FROM laps WHERE is_pit_in_lap
    UNION ALL SELECT 'f1.positions', concat_ws(':', session_key, driver_number),
           CAST(driver_number AS VARCHAR), NULL FROM positions
    UNION ALL SELECT 'f1.session.events', 'session_start', NULL, 'session_start'
           FROM (SELECT DISTINCT session_key FROM laps)
    UNION ALL SELECT 'f1.driver.info', CAST(driver_number AS VARCHAR), CAST(driver_number AS VARCHAR), NULL
           FROM people""")
def _encode(d: RaceData):
    laps = lap_rows(d).drop("event_id")
    pits = d.laps.where("is_pit_in_lap").select("session_key", "driver_number", "lap_number")
    positions = d.positions.select("session_key", "driver_number", "position")
    frames = [
        out.lap_messages(laps), out.pit_messages(pits), out.position_messages(positions),
        out.session_messages(d.sessions, "session_start"),
        out.driver_messages(d.people.select("driver_number", "full_name", F.col("code").alias("abbreviation"))),
    ]
    sent = frames[0]
    for frame in frames[1:]:
        sent = sent.unionByName(frame)
    return sent.select("topic", "key", F.get_json_object("value", "$.driver_number").alias("driver"),
                       F.get_json_object("value", "$.event_type").alias("event"))


@query("normalize_laps", f"""
    SELECT {LAP_SQL}, {r6('lap_duration')} AS lap_duration, {r6('value / 4')} AS sector_1_time, tyre_compound,
           tyre_age_laps, is_pit_out_lap, FALSE AS is_pit_in_lap, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, 'openf1' AS source FROM laps
    UNION ALL SELECT {LAP_SQL}, {r6('lap_duration')}, {r6('round(value, 2)')}, tyre_compound, tyre_age_laps,
           is_pit_out_lap, is_pit_in_lap, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), 'fastf1' FROM laps WHERE lap_duration IS NOT NULL""")
def _normalize_laps(d: RaceData):
    timing = d.laps.select(
        "session_key", "driver_number", "lap_number", "lap_duration",
        (F.col("value") / 4).alias("duration_sector_1"), F.col("value").alias("duration_sector_2"),
        F.col("value").alias("duration_sector_3"), F.col("tyre_compound").alias("compound"),
        F.col("tyre_age_laps").alias("tyre_age_at_start"),
        F.when(F.col("is_pit_out_lap"), True).alias("is_pit_out_lap"), "ts")

    def span(seconds):
        return F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))

    value = F.round("value", 2)
    clock = d.laps.select(
        "session_key", "driver_number", "lap_number", span(F.col("lap_duration")).alias("lap_time"),
        span(value).alias("sector_1"), span(value).alias("sector_2"), span(value).alias("sector_3"),
        F.col("tyre_compound").alias("compound"), F.col("tyre_age_laps").cast("double").alias("tyre_life"),
        F.when(F.col("is_pit_out_lap"), span(value)).alias("pit_out_time"),
        F.when(F.col("is_pit_in_lap"), span(value)).alias("pit_in_time"), "ts")
    both = feeds.timing_laps(timing, at="ts").unionByName(feeds.clock_laps(clock, at="ts"))
    return both.select(
        "session_key", "driver_number", "lap_number", fixed("lap_duration", 6).alias("lap_duration"),
        fixed("sector_1_time", 6).alias("sector_1_time"), "tyre_compound", "tyre_age_laps",
        "is_pit_out_lap", "is_pit_in_lap", "timestamp", "source")


@query("normalize_drivers", """
    SELECT driver_number, full_name, CASE WHEN driver_number % 6 = 0 THEN '' ELSE code END AS abbreviation,
           team AS team_name, CASE WHEN driver_number % 3 = 0 THEN '#000000' ELSE '#AA00FF' END AS team_colour,
           nationality AS country_code, 'openf1' AS source FROM people
    UNION ALL SELECT driver_number, full_name, code, team, '#000000', NULL, 'fastf1' FROM people
    WHERE driver_number % 9 <> 4""")
def _normalize_drivers(d: RaceData):
    number = F.col("driver_number")
    timing = d.people.select(
        "driver_number", "full_name", F.when(number % 6 != 0, F.col("code")).alias("name_acronym"),
        F.col("team").alias("team_name"), F.when(number % 3 != 0, "AA00FF").alias("team_colour"),
        F.lit(None).cast("string").alias("headshot_url"), F.col("nationality").alias("country_code"))
    clock = d.people.select(
        F.when(number % 9 != 4, number.cast("string")).otherwise("n/a").alias("driver_number"), "full_name",
        F.col("code").alias("abbreviation"), F.col("team").alias("team_name"),
        F.lit(None).cast("string").alias("team_colour"))
    both = feeds.timing_drivers(timing).unionByName(feeds.clock_drivers(clock))
    return both.select("driver_number", "full_name", "abbreviation", "team_name", "team_colour",
                       "country_code", "source")


@query("normalize_pits", f"""
    SELECT session_key, driver_number, CASE WHEN event_id % 10 = 0 THEN 0 ELSE lap_number END AS lap_number,
           {r6('value')} AS pit_duration, CAST(NULL AS VARCHAR) AS tyre_compound_new, 'openf1' AS source
    FROM laps WHERE is_pit_in_lap
    UNION ALL SELECT session_key, driver_number, lap_number, NULL, tyre_compound, 'fastf1'
    FROM laps WHERE is_pit_in_lap""")
def _normalize_pits(d: RaceData):
    timing = d.laps.where("is_pit_in_lap").select(
        "session_key", "driver_number",
        F.when(F.col("event_id") % 10 != 0, F.col("lap_number")).alias("lap_number"),
        F.col("value").alias("pit_duration"), F.col("ts").cast("string").alias("date"))
    clock = d.timed_laps.select(
        "session_key", "driver_number", "lap_number", F.col("tyre_compound").alias("compound"),
        F.col("pit_in_s").alias("pit_in_time"))
    names = ["session_key", "driver_number", "lap_number", "pit_duration", "tyre_compound_new", "source"]
    both = feeds.timing_pits(timing).select(*names).unionByName(feeds.clock_pits(clock).select(*names))
    return both.withColumn("pit_duration", fixed("pit_duration", 6))


@query("normalize_sessions", """
    SELECT CAST(season * 1000 + round_number AS INT) AS session_key, 'Race' AS session_name,
           CASE WHEN race_no % 4 = 3 THEN 'Qualifying' ELSE 'R' END AS session_type, season AS year,
           country AS country_name, race_date AS date_start, '+00:00' AS gmt_offset, 'openf1' AS source FROM races
    UNION ALL SELECT CAST(season * 1000 + round_number AS INT), race_name, substr(race_name, 1, 1), season, country, concat(race_date, ' 00:00:00'),
           '+00:00', 'fastf1' FROM races""")
def _normalize_sessions(d: RaceData):
    none = F.lit(None).cast("string")
    timing = d.races.select(
        feeds.season_session_key("season", "round_number").alias("session_key"), none.alias("session_name"),
        F.when(F.col("race_no") % 4 == 3, "Qualifying").alias("session_type"), F.col("season").alias("year"),
        F.col("circuit_id").alias("circuit_short_name"), F.lit(None).cast("int").alias("circuit_key"),
        F.col("country").alias("country_name"), F.col("race_date").alias("date_start"), none.alias("gmt_offset"))
    clock = d.races.select(
        F.col("race_name").alias("name"), F.col("race_date").cast("timestamp").alias("event_date"),
        F.col("circuit_id").alias("location"), "country", "season", "round_number")
    both = feeds.timing_sessions(timing).unionByName(feeds.clock_session(clock))
    return both.select("session_key", "session_name", "session_type", "year", "country_name", "date_start",
                       "gmt_offset", "source")


@query("write_features", f"""SELECT 2024 AS season, session_key AS round_number, {LAP_SQL},
       {r6('tyre_degradation_rate')} AS tyre_degradation_rate, should_pit_soon FROM features""")
def _write(d: RaceData):
    path = new_folder(d.spark, "races")
    write_races(d.race_features, path)
    back = read_races(d.spark, path)
    return back.select("season", "round_number", "session_key", "driver_number", "lap_number",
                       fixed("tyre_degradation_rate", 6).alias("tyre_degradation_rate"), "should_pit_soon")


