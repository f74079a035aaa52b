"""Lap features and the summaries built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from laplake.constants import DRIVER_SURNAMES
from laplake.functions.labels import driver_surname
from laplake.functions.numbers import fixed
from laplake.operators import catalogue, features, pits, race
from laplake.operators.groups import lookup
from laplake.plans.fixtures import RaceData
from laplake.plans.oracle import lap_time, r3, r4, r6
from laplake.plans.registry import query

LAP = ["session_key", "driver_number", "lap_number"]
LAP_SQL = "session_key, driver_number, lap_number"


def rounded(df, *names, digits: int = 6):
    return df.withColumns({name: fixed(name, digits) for name in names})


@query("valid_laps", f"SELECT {LAP_SQL}, {r6('lap_duration')} AS lap_duration FROM valid")
def _valid(d: RaceData):
    return rounded(d.valid.select(*LAP, "lap_duration"), "lap_duration")


@query("rolling_avg", f"SELECT {LAP_SQL}, {r6('rolling_avg_lap_time')} AS rolling_avg_lap_time FROM features")
def _rolling(d: RaceData):
    out = features.rolling_avg(d.valid, hot=d.hot_drivers)
    return rounded(out.select(*LAP, "rolling_avg_lap_time"), "rolling_avg_lap_time")


@query("lap_delta", f"""SELECT {LAP_SQL}, {r6('personal_best')} AS personal_best,
                        {r6('lap_delta')} AS lap_delta FROM features""")
def _delta(d: RaceData):
    out = features.lap_delta(d.valid, hot=d.hot_drivers)
    return rounded(out.select(*LAP, "personal_best", "lap_delta"), "personal_best", "lap_delta")


@query("stint_detect", f"SELECT {LAP_SQL}, prev_tyre_age, is_new_stint, stint_number FROM features")
def _stints(d: RaceData):
    return features.stint_detect(d.valid, hot=d.hot_drivers).select(
        *LAP, "prev_tyre_age", "is_new_stint", "stint_number")


@query("stint_length", f"SELECT {LAP_SQL}, stint_length FROM features")
def _stint_length(d: RaceData):
    return features.stint_length(d.valid, hot=d.hot_drivers).select(*LAP, "stint_length")


@query("tyre_degradation", f"""SELECT {LAP_SQL}, CAST(tyre_age_safe AS INT) AS tyre_age_safe,
       {r6('stint_start_lap_time')} AS stint_start_lap_time,
       {r6('tyre_degradation_rate')} AS tyre_degradation_rate FROM features""")
def _degradation(d: RaceData):
    out = features.tyre_degradation(d.valid, hot=d.hot_drivers).select(
        *LAP, "tyre_age_safe", "stint_start_lap_time", "tyre_degradation_rate")
    return rounded(out, "stint_start_lap_time", "tyre_degradation_rate")


@query("pit_window", f"""SELECT {LAP_SQL}, should_pit_soon,
       {r4('estimated_laps_to_pit')} AS estimated_laps_to_pit FROM features""")
def _pit_window(d: RaceData):
    rated = features.tyre_degradation(d.valid, hot=d.hot_drivers)
    out = features.pit_window(rated).select(*LAP, "should_pit_soon", "estimated_laps_to_pit")
    return rounded(out, "estimated_laps_to_pit", digits=4)


_ALL = ["lap_duration", "rolling_avg_lap_time", "personal_best", "lap_delta", "stint_start_lap_time",
        "tyre_degradation_rate"]


@query("lap_features", f"""SELECT {LAP_SQL}, tyre_compound, tyre_age_laps, prev_tyre_age, is_new_stint,
       stint_number, stint_length, CAST(tyre_age_safe AS INT) AS tyre_age_safe, should_pit_soon,
       {r4('estimated_laps_to_pit')} AS estimated_laps_to_pit,
       {', '.join(f'{r6(name)} AS {name}' for name in _ALL)} FROM features""")
def _features(d: RaceData):
    out = d.features.select(
        *LAP, "tyre_compound", "tyre_age_laps", "prev_tyre_age", "is_new_stint", "stint_number",
        "stint_length", "tyre_age_safe", "should_pit_soon", "estimated_laps_to_pit", *_ALL)
    return rounded(rounded(out, *_ALL), "estimated_laps_to_pit", digits=4)


@query("feature_summary", f"""SELECT session_key, driver_number, count(lap_number) AS total_laps,
       {r6('min(lap_duration)')} AS fastest_lap, {r6('avg(lap_duration)')} AS avg_lap_time,
       {r6('avg(tyre_degradation_rate)')} AS avg_deg_rate, max(stint_length) AS longest_stint
       FROM features GROUP BY ALL""")
def _feature_summary(d: RaceData):
    return rounded(race.feature_summary(d.features), "fastest_lap", "avg_lap_time", "avg_deg_rate")


@query("driver_summary", f"""SELECT session_key, driver_number, count(lap_number) AS total_laps,
       {r6('min(lap_duration)')} AS fastest_lap, {r6('avg(lap_duration)')} AS avg_lap_time,
       {r6('avg(tyre_degradation_rate)')} AS avg_deg_rate,
       CAST(sum(CAST(should_pit_soon AS INT)) AS BIGINT) AS pit_flags,
       avg(tyre_degradation_rate) > 0.15 AS high_wear FROM features GROUP BY ALL""")
def _driver_summary(d: RaceData):
    out = race.by_wear(race.driver_summary(d.features))
    return rounded(out, "fastest_lap", "avg_lap_time", "avg_deg_rate")


_SURNAMES = " ".join(f"WHEN {number} THEN '{name}'" for number, name in DRIVER_SURNAMES.items())


@query("name_summary", f"""
    SELECT session_key, CASE driver_number {_SURNAMES} ELSE CAST(driver_number AS VARCHAR) END AS driver_name,
           {r6('avg(tyre_degradation_rate)')} AS avg_deg_rate,
           CAST(sum(CAST(should_pit_soon AS INT)) AS BIGINT) AS pit_flags
    FROM features GROUP BY session_key, driver_number""")
def _names(d: RaceData):
    out = race.by_pit_flags(race.driver_summary(d.features))
    return rounded(out.select("session_key", driver_surname("driver_number").alias("driver_name"),
                              "avg_deg_rate", "pit_flags"), "avg_deg_rate")


@query("batch_sample", f"""SELECT {LAP_SQL}, {r6('lap_duration')} AS lap_duration, tyre_compound,
       should_pit_soon FROM features ORDER BY {LAP_SQL} LIMIT 10""")
def _sample(d: RaceData):
    out = race.batch_sample(d.features).select(*LAP, "lap_duration", "tyre_compound", "should_pit_soon")
    return rounded(out, "lap_duration")


@query("race_laps", f"""SELECT {LAP_SQL}, {r6('lap_duration')} AS lap_duration,
       {r6("CASE WHEN is_new_stint = 0 THEN lap_delta END")} AS lap_delta,
       {r6('tyre_degradation_rate')} AS tyre_degradation_rate FROM features""")
def _race_laps(d: RaceData):
    # NaN on the laps of a fresh stint, which JSON-safe rows must not show.
    marked = d.features.withColumn(
        "lap_delta", F.when(F.col("is_new_stint") == 0, F.col("lap_delta")).otherwise(F.lit(float("nan"))))
    out = race.race_laps(marked).select(*LAP, "lap_duration", "lap_delta", "tyre_degradation_rate")
    return rounded(out, "lap_duration", "lap_delta", "tyre_degradation_rate")


@query("lap_range", """SELECT session_key, driver_number, min(lap_number) AS first_lap,
       max(lap_number) AS last_lap, CAST(trunc(median(lap_number)) AS INT) AS default_lap,
       any_value(drivers) AS drivers, any_value(middle_lap) AS middle_lap
       FROM valid JOIN (SELECT session_key, count(DISTINCT driver_number) AS drivers,
                               CAST(max(lap_number) // 2 AS INT) AS middle_lap
                        FROM valid GROUP BY session_key) s USING (session_key)
       GROUP BY session_key, driver_number""")
def _lap_range(d: RaceData):
    drivers = race.driver_lap_range(d.valid, hot_drivers=d.hot_drivers)
    sessions = race.session_laps(d.valid).select("session_key", "drivers", "middle_lap")
    return race.lookup(drivers, sessions, ["session_key"])


@query("fastest_laps", f"""SELECT session_key, driver_number, lap_number,
       lap_time_seconds,
       {lap_time('lap_time_seconds')} AS lap_time_formatted,
       coalesce(tyre_compound, 'UNKNOWN') AS tyre_compound,
       CAST(row_number() OVER (PARTITION BY session_key ORDER BY lap_time_seconds, driver_number) AS INT) AS rank,
       coalesce(code, CAST(driver_number AS VARCHAR)) AS driver_code
       FROM fastest LEFT JOIN roster USING (driver_number)""")
def _fastest(d: RaceData):
    return race.fastest_laps(d.valid, d.roster, hot_sessions=d.hot_sessions).orderBy("session_key", "rank")


@query("driver_code_join", f"""SELECT {LAP_SQL}, coalesce(code, CAST(driver_number AS VARCHAR)) AS driver_code
       FROM laps LEFT JOIN roster USING (driver_number)""")
def _codes(d: RaceData):
    return race.with_codes(d.laps.select(*LAP), d.roster)


@query("lap_positions", """SELECT session_key, driver_number, lap_number, position,
       coalesce(code, CAST(driver_number AS VARCHAR)) AS driver_code
       FROM ranked_positions LEFT JOIN roster USING (driver_number)""")
def _lap_positions(d: RaceData):
    ranked = race.lap_positions(d.valid, d.hot_drivers, d.hot_sessions)
    return race.with_codes(ranked.select(*LAP, "position"), d.roster)


@query("lap_positions_exact", """
    SELECT session_key, driver_number, lap_number, position, 'exact' AS source
    FROM positions JOIN (SELECT session_key, driver_number FROM positions GROUP BY ALL HAVING count(*) = count(position))
         USING (session_key, driver_number)
    UNION ALL
    SELECT session_key, driver_number, lap_number, position, 'derived'
    FROM ranked_positions JOIN (SELECT session_key, driver_number FROM positions GROUP BY ALL
                                HAVING count(*) > count(position)) USING (session_key, driver_number)""")
def _exact(d: RaceData):
    # Drivers whose telemetry has a gap take derived positions.
    driver = ["session_key", "driver_number"]
    whole = d.positions.groupBy(*driver).agg(F.count_if(F.col("position").isNull()).alias("gaps")).where("gaps = 0")
    exact = race.exact_positions(lookup(d.positions, whole.select(*driver), driver, "left_semi"))
    derived = race.lap_positions(d.valid, d.hot_drivers, d.hot_sessions)
    return race.first_available(exact, derived, driver, ("exact", "derived"))


@query("tyre_stints", """SELECT session_key, driver_number, stint_number, CAST(stint_number + 1 AS INT) AS stint,
       compound, start_lap, end_lap, CAST(lap_count AS BIGINT) AS lap_count FROM stint_table""")
def _tyre_stints(d: RaceData):
    return race.tyre_stints(d.features)


@query("tyre_strategies", """
    SELECT session_key, driver_number, driver_code, page, stints, finish_order FROM (
      SELECT session_key, driver_number, CAST(stint_number // 1000 AS INT) AS page,
             string_agg(concat_ws(':', stint_number + 1, compound, start_lap, end_lap, lap_count), '|'
                        ORDER BY stint_number) AS stints
      FROM stint_table GROUP BY session_key, driver_number, stint_number // 1000)
    JOIN (SELECT session_key, driver_number, coalesce(code, CAST(driver_number AS VARCHAR)) AS driver_code,
                 coalesce(finish_position, 99) AS finish_order
          FROM (SELECT DISTINCT session_key, driver_number FROM valid)
          LEFT JOIN race_status USING (session_key, driver_number)) USING (session_key, driver_number)""")
def _strategies(d: RaceData):
    nested = race.tyre_strategies(race.tyre_stints(d.features), d.roster)
    line = F.transform("stints", lambda s: F.concat_ws(
        ":", *[s[name].cast("string") for name in ("stint", "compound", "start_lap", "end_lap", "lap_count")]))
    ordered = race.by_finish(nested, d.race_status)
    return ordered.select("session_key", "driver_number", "driver_code", "page",
                          F.array_join(line, "|").alias("stints"), "finish_order")


SLOTS = [1, 2, 3, 4, 5]


def _slot_sql(value: str) -> str:
    return ", ".join(f'max(CASE WHEN slot = {n} THEN {value} END) AS "slot_{n}"' for n in SLOTS)


def _named(df):
    return df.withColumnsRenamed({str(n): f"slot_{n}" for n in SLOTS})


@query("lap_time_pivot", f"""SELECT session_key, lap_number, {_slot_sql(r6('lap_duration'))}
       FROM valid JOIN slots USING (session_key, driver_number) GROUP BY session_key, lap_number""")
def _lap_pivot(d: RaceData):
    value = fixed(race.lap_time_value(), 6)
    return _named(race.lap_pivot(d.valid, race.first_drivers(d.valid), value, SLOTS))


@query("deg_pivot", f"""SELECT session_key, lap_number, {_slot_sql(r6('greatest(0.0, tyre_degradation_rate)'))}
       FROM features JOIN slots USING (session_key, driver_number) GROUP BY session_key, lap_number""")
def _deg_pivot(d: RaceData):
    value = fixed(race.degradation_value(), 6)
    return _named(race.lap_pivot(d.features, race.first_drivers(d.valid), value, SLOTS))


@query("position_pivot", f"""SELECT session_key, lap_number, {_slot_sql('position')}
       FROM (SELECT session_key, CAST(unnest(range(1, last_lap + 1)) AS INT) AS lap_number FROM session_last)
       LEFT JOIN (SELECT * FROM ranked_positions JOIN slots USING (session_key, driver_number))
            USING (session_key, lap_number)
       GROUP BY session_key, lap_number""")
def _position_pivot(d: RaceData):
    ranked = race.lap_positions(d.valid, d.hot_drivers, d.hot_sessions)
    return _named(race.position_pivot(ranked, race.first_drivers(d.valid), SLOTS))


@query("race_headline", f"""
    SELECT session_key, last_lap AS laps, coalesce(n, 0) AS pit_stops, pit_flags,
           printf('%.4fs', {r4('wear')}) AS avg_tyre_deg,
           {lap_time(r3('best'))} AS fastest_lap,
           coalesce(winner, '—') AS winner
    FROM (SELECT session_key, max(lap_number) AS last_lap, count(*) FILTER (should_pit_soon) AS pit_flags,
                 min(lap_duration) AS best,
                 coalesce(avg(tyre_degradation_rate) FILTER (tyre_degradation_rate > 0
                                                             AND tyre_degradation_rate < 2), 0.0) AS wear
          FROM features GROUP BY session_key)
    LEFT JOIN (SELECT session_key, count(*) AS n FROM stops GROUP BY session_key) p USING (session_key)
    LEFT JOIN (SELECT session_key, min(code) AS winner FROM race_status WHERE finish_position = 1
               GROUP BY session_key) w USING (session_key)""")
def _headline(d: RaceData):
    return race.race_headline(d.features, d.race_status, pits.clean_stops(d.raw_pits))


@query("latest_positions", """
    SELECT session_key, driver_number, coalesce(position, 99) AS position
    FROM (SELECT *, row_number() OVER (PARTITION BY session_key, driver_number ORDER BY ts DESC, event_id) AS place
          FROM positions) WHERE place = 1""")
def _latest(d: RaceData):
    return race.latest_positions(d.positions)


@query("incidents", """
    SELECT session_key, code, first_seen,
           CASE code WHEN '2' THEN 'Yellow Flag' WHEN '4' THEN 'Safety Car' WHEN '5' THEN 'Red Flag'
                WHEN '6' THEN 'Virtual Safety Car' WHEN '7' THEN 'VSC Ending'
                ELSE concat('Status ', code) END AS label
    FROM (SELECT session_key, code, epoch_us(min(ts)) AS first_seen FROM track_status WHERE code <> '1'
          GROUP BY session_key, code)""")
def _incidents(d: RaceData):
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', first_seen)")
    return race.incidents(d.track_status).withColumn("first_seen", micros)


@query("laps_since", """SELECT session_key, count(*) AS new_laps, min(lap_number) AS first_lap,
       max(lap_number) AS last_lap
       FROM laps LEFT JOIN (SELECT session_key, driver_number, max(lap_number) AS after_lap
                            FROM laps WHERE is_pit_in_lap GROUP BY session_key, driver_number) c
            USING (session_key, driver_number)
       WHERE lap_number > coalesce(after_lap, 0) GROUP BY session_key""")
def _laps_since(d: RaceData):
    # Laps were read up to the last pit stop; drivers without one have no cursor yet.
    cursors = d.laps.where("is_pit_in_lap").groupBy("session_key", "driver_number").agg(
        F.max("lap_number").alias("after_lap"))
    return catalogue.new_lap_range(catalogue.laps_since(d.laps, cursors))
