"""The derived race tables in SQL, and the composition of oracle statements."""

from __future__ import annotations

import re

from laplake.plans.fixtures import COUNTRIES, GIVEN, HALF, TEAMS


def _round(expression: str, digits: int) -> str:
    """Round half away from zero on decimals, free of binary noise."""
    return f"CAST(round(CAST({expression} AS DECIMAL(28, 9)), {digits}) AS DOUBLE)"


def r1(expression: str) -> str:
    return _round(expression, 1)


def r3(expression: str) -> str:
    return _round(expression, 3)


def r4(expression: str) -> str:
    return _round(expression, 4)


def r6(expression: str) -> str:
    return _round(expression, 6)


def lap_time(seconds: str) -> str:
    """``m:ss.mmm`` of seconds with three digits."""
    return f"printf('%d:%06.3f', CAST(floor({seconds} / 60) AS INT), round({seconds} - 60 * floor({seconds} / 60), 3))"


def _pick(index: str, values: list[str]) -> str:
    return "CASE " + index + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


TABLES = {
    "timed_events": f"""
        SELECT CASE WHEN ts < TIMESTAMP '{HALF}' THEN 1 ELSE 2 END AS session_key,
               CAST(user_id AS INT) AS driver_number, ts, event_id, event_type, value FROM events""",
    "laps": """
        SELECT session_key, driver_number, lap_number,
               CASE WHEN event_id % 97 <> 0 THEN 55.0 + value END AS lap_duration,
               CASE event_type WHEN 'click' THEN 'SOFT' WHEN 'view' THEN 'MEDIUM'
                    WHEN 'purchase' THEN 'HARD' WHEN 'signup' THEN 'INTERMEDIATE' END AS tyre_compound,
               CASE WHEN event_id % 53 <> 0
                    THEN CAST((lap_number + driver_number) % 17 + 1 AS INT) END AS tyre_age_laps,
               (lap_number + driver_number) % 17 = 0 AS is_pit_out_lap,
               (lap_number + driver_number) % 17 = 16 AS is_pit_in_lap, ts, event_id, value
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY session_key, driver_number
                                                ORDER BY ts, event_id) AS INT) AS lap_number
              FROM timed_events)""",
    "valid": "SELECT * FROM laps WHERE lap_duration > 60 AND lap_duration < 200",
    "windowed": """
        SELECT *, lag(tyre_age_laps) OVER w AS prev_tyre_age,
               avg(lap_duration) OVER (PARTITION BY session_key, driver_number ORDER BY lap_number
                                       ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rolling_avg_lap_time,
               min(lap_duration) OVER (PARTITION BY session_key, driver_number ORDER BY lap_number
                                       ROWS UNBOUNDED PRECEDING) AS personal_best,
               row_number() OVER (PARTITION BY session_key, driver_number, tyre_compound
                                  ORDER BY lap_number) AS compound_lap
        FROM valid WINDOW w AS (PARTITION BY session_key, driver_number ORDER BY lap_number)""",
    "resets": """
        SELECT *, CASE WHEN tyre_age_laps < prev_tyre_age THEN 1 ELSE 0 END AS is_new_stint,
               lap_duration - personal_best AS lap_delta,
               CAST(coalesce(tyre_age_laps, compound_lap) AS BIGINT) AS stint_length
        FROM windowed""",
    "stints": """
        SELECT *, CAST(sum(is_new_stint) OVER (PARTITION BY session_key, driver_number ORDER BY lap_number
                                               ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stint_number
        FROM resets""",
    "started": """
        SELECT *, first_value(lap_duration) OVER (PARTITION BY session_key, driver_number, stint_number
                                                  ORDER BY lap_number) AS stint_start_lap_time,
               CASE WHEN tyre_age_laps > 1 THEN tyre_age_laps ELSE 1 END AS tyre_age_safe
        FROM stints""",
    "rated": """
        SELECT * EXCLUDE (raw), CASE WHEN raw >= -0.5 AND raw <= 1.5 THEN raw ELSE 0.0 END AS tyre_degradation_rate
        FROM (SELECT *, (lap_duration - stint_start_lap_time) / tyre_age_safe AS raw FROM started)""",
    "features": """
        SELECT *, tyre_degradation_rate > 0.15 AS should_pit_soon,
               CASE WHEN tyre_degradation_rate > 0
                    THEN greatest(0.0, (0.15 - tyre_degradation_rate) / tyre_degradation_rate)
                    ELSE 999.0 END AS estimated_laps_to_pit
        FROM rated""",
    "people": f"""
        SELECT CAST(c_custkey AS INT) AS driver_number,
               concat('D', lpad(CAST(c_custkey AS VARCHAR), 8, '0')) AS code,
               {_pick('c_custkey % 3', GIVEN)} AS given, concat('Müller', c_custkey) AS family,
               concat({_pick('c_custkey % 3', GIVEN)}, ' ', concat('Müller', c_custkey)) AS full_name,
               {_pick('c_nationkey % 8', TEAMS)} AS team, concat('nation_', c_nationkey) AS nationality
        FROM customer""",
    "roster": "SELECT * FROM people WHERE driver_number % 10 <> 9",
    "results": f"""
        SELECT *, concat('Circuit ', race_no % 24, ' Grand Prix') AS race_name,
               concat('circuit_', race_no % 24) AS circuit_id, {_pick('race_no % 6', COUNTRIES)} AS country,
               CAST(make_date(season, round_number % 12 + 1, round_number % 28 + 1) AS VARCHAR) AS race_date,
               concat('driver_', driver_number) AS driver_id,
               concat('team_', driver_number % 8) AS constructor_id
        FROM (SELECT CAST(1950 + (o_orderkey // 20) % 75 AS INT) AS season,
                     CAST((o_orderkey // 20) // 75 + 1 AS INT) AS round_number, o_orderkey // 20 AS race_no,
                     CAST(o_custkey AS INT) AS driver_number, o_orderkey,
                     CAST(nullif(o_orderkey % 21, 0) AS INT) AS grid_position,
                     CAST(o_orderkey % 20 + 1 AS INT) AS finish_position,
                     CASE WHEN o_orderkey % 13 = 0 THEN 'Did Not Start' WHEN o_orderkey % 13 = 1 THEN 'Unknown'
                          WHEN o_orderkey % 13 = 2 THEN '2 Laps' WHEN o_orderstatus = 'F' THEN 'Finished'
                          WHEN o_orderstatus = 'O' THEN '+1 Lap' ELSE 'Engine' END AS status,
                     CAST(CASE WHEN o_orderkey % 7 = 0 THEN 25 WHEN o_orderkey % 7 = 1 THEN 18 ELSE 0 END AS DOUBLE)
                         AS points,
                     CAST(o_orderkey % 70 AS INT) AS laps_completed,
                     CASE WHEN o_orderkey % 4 <> 0 THEN concat('1:', o_orderkey % 50 + 10, '.5') END
                         AS fastest_lap_time,
                     CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 20 + 1 AS INT) END AS fastest_lap_rank,
                     CASE WHEN o_orderkey % 3 = 0 THEN concat('+', o_orderkey % 90, 's') END AS gap
              FROM orders)""",
    "races": """
        SELECT DISTINCT season, round_number, race_no, race_name, circuit_id, country, race_date FROM results""",
    "race_status": """
        SELECT s.session_key, driver_number, code, full_name, team,
               CASE driver_number % 5 WHEN 0 THEN 'Did Not Start' WHEN 1 THEN 'Finished' WHEN 2 THEN '+1 Lap'
                    WHEN 3 THEN 'Gearbox' ELSE 'Unknown' END AS status,
               driver_number + 1 AS finish_position, driver_number AS entry_order
        FROM roster CROSS JOIN (SELECT 1 AS session_key UNION ALL SELECT 2) s""",
    "positions": """
        SELECT session_key, driver_number, lap_number,
               CASE WHEN event_id % 41 <> 0 THEN CAST(CAST(floor(value) AS INT) % 20 + 1 AS INT) END AS position,
               ts, event_id FROM laps""",
    "track_status": """
        SELECT session_key, ts, event_id,
               CASE event_type WHEN 'click' THEN '1' WHEN 'view' THEN '2' WHEN 'purchase' THEN '4'
                    WHEN 'signup' THEN '5' ELSE '9' END AS code FROM timed_events""",
    "timed_laps": """
        SELECT session_key, driver_number, lap_number, tyre_compound, event_id,
               CASE WHEN is_pit_in_lap THEN lap_number * 100.0::DOUBLE END AS pit_in_s,
               CASE WHEN is_pit_out_lap AND event_id % 7 <> 0
                    THEN (lap_number - 1) * 100.0::DOUBLE + value END AS pit_out_s FROM laps""",
    "raw_pits": """
        SELECT session_key, driver_number, CAST(stop_no AS VARCHAR) AS stop, CAST(lap_number AS VARCHAR) AS lap,
               CASE driver_number % 5
                    WHEN 0 THEN concat(CASE driver_number % 3 WHEN 0 THEN 'jose' WHEN 1 THEN 'zoe' ELSE 'max' END,
                                       '_muller', driver_number)
                    WHEN 1 THEN concat('muller', driver_number)
                    WHEN 2 THEN concat('d', lpad(CAST(driver_number AS VARCHAR), 8, '0'))
                    WHEN 3 THEN concat('old_muller', driver_number, '_jr')
                    ELSE concat('nobody_', driver_number) END AS driver_id,
               CASE WHEN event_id % 11 = 0 THEN '30:12.345' WHEN event_id % 11 = 1 THEN ''
                    ELSE CAST(value AS VARCHAR) END AS duration, copy_no
        FROM (SELECT *, row_number() OVER (PARTITION BY session_key, driver_number ORDER BY lap_number) AS stop_no
              FROM laps WHERE is_pit_in_lap)
        CROSS JOIN (SELECT 1 AS copy_no UNION ALL SELECT 2) c WHERE copy_no = 1 OR event_id % 2 = 0""",
    "stops": """
        SELECT session_key, driver_id, CAST(stop AS INT) AS stop_number, CAST(lap AS INT) AS lap_number,
               driver_number, TRY_CAST(nullif(duration, '') AS DOUBLE) AS duration_seconds,
               duration AS duration_formatted
        FROM raw_pits WHERE copy_no = 1""",
    "vectors": """
        SELECT concat('v', vec_id) AS id, vec_id, embedding, label AS driver_number,
               CASE WHEN vec_id % 3 = 0 THEN 'SOFT' WHEN vec_id % 3 = 1 THEN 'MEDIUM' ELSE 'HARD' END
                   AS tyre_compound,
               CAST(2023 + vec_id % 2 AS INT) AS year, concat('situation ', vec_id) AS document
        FROM embeddings""",
    "fastest": """
        SELECT session_key, driver_number, lap_number, lap_duration, tyre_compound,
               CAST(round(CAST(lap_duration AS DECIMAL(28, 9)), 3) AS DOUBLE) AS lap_time_seconds
        FROM (SELECT *, row_number() OVER (PARTITION BY session_key, driver_number
                                           ORDER BY lap_duration, lap_number) AS place FROM valid) WHERE place = 1""",
    "stint_table": """
        SELECT session_key, driver_number, stint_number, coalesce(compound, 'UNKNOWN') AS compound,
               start_lap, end_lap, lap_count
        FROM (SELECT session_key, driver_number, stint_number, min(lap_number) AS start_lap,
                     max(lap_number) AS end_lap, count(*) AS lap_count
              FROM features GROUP BY ALL)
        LEFT JOIN (SELECT session_key, driver_number, stint_number, tyre_compound AS compound,
                          row_number() OVER (PARTITION BY session_key, driver_number, stint_number
                                             ORDER BY n DESC, tyre_compound) AS place
                   FROM (SELECT session_key, driver_number, stint_number, tyre_compound, count(*) AS n
                         FROM features WHERE tyre_compound IS NOT NULL GROUP BY ALL)) m
        USING (session_key, driver_number, stint_number) WHERE coalesce(place, 1) = 1""",
    "ranked_positions": """
        SELECT session_key, driver_number, lap_number,
               CAST(row_number() OVER (PARTITION BY session_key, lap_number
                                       ORDER BY cum_time, driver_number) AS INT) AS position
        FROM (SELECT *, sum(CAST(round(lap_duration * 1000000) AS BIGINT)) OVER (PARTITION BY session_key, driver_number ORDER BY lap_number
                                                ROWS UNBOUNDED PRECEDING) AS cum_time FROM valid)""",
    "slots": """
        SELECT session_key, driver_number, slot
        FROM (SELECT session_key, driver_number,
                     row_number() OVER (PARTITION BY session_key ORDER BY driver_number) AS slot
              FROM (SELECT DISTINCT session_key, driver_number FROM valid)) WHERE slot <= 5""",
    "session_last": "SELECT session_key, max(lap_number) AS last_lap FROM valid GROUP BY session_key",
    "norms": """
        SELECT *, sqrt(list_inner_product(e, e)) AS norm
        FROM (SELECT *, CAST(embedding AS DOUBLE[]) AS e FROM vectors)""",
    "dimension": """
        SELECT session_key, race_number, final_code AS code,
               CASE WHEN pair_code IS NULL THEN by_number ELSE coalesce(c.full_name, v.full_name, by_number, final_code) END
                   AS full_name,
               CASE WHEN pair_code IS NULL THEN team_by_number
                    ELSE coalesce(c.team, v.team, team_by_number, '') END AS team
        FROM (SELECT session_key, driver_number AS race_number, pair_code, coalesce(pair_code, n.code) AS final_code,
                     n.full_name AS by_number, n.team AS team_by_number
              FROM (SELECT session_key, driver_number,
                           CASE WHEN bool_or(rank = 0) THEN coalesce(any_value(r.code), CAST(driver_number AS VARCHAR))
                                WHEN bool_or(rank = 1) THEN concat('P', driver_number)
                                ELSE concat('S', driver_number) END AS pair_code
                    FROM (SELECT DISTINCT session_key, driver_number, 0 AS rank FROM valid WHERE tyre_compound = 'SOFT'
                          UNION ALL SELECT DISTINCT session_key, driver_number, 1 FROM positions WHERE position IS NOT NULL
                          UNION ALL SELECT DISTINCT session_key, driver_number, 2 FROM valid)
                    LEFT JOIN roster r USING (driver_number) GROUP BY session_key, driver_number)
              FULL JOIN (SELECT session_key, driver_number, code, full_name, team FROM race_status) n
                   USING (session_key, driver_number))
        LEFT JOIN (SELECT session_key, code AS final_code, full_name, team FROM race_status) c USING (session_key, final_code)
        LEFT JOIN (SELECT code AS final_code, full_name, team FROM roster) v USING (final_code)""",
}


def _used(sql: str) -> list[str]:
    return [name for name in TABLES if re.search(rf"\b{name}\b", sql)]


def statement(sql: str) -> str:
    """A self-contained statement: derived tables in front, in dependency order."""
    ordered: list[str] = []

    def visit(text: str, own: str | None) -> None:
        for name in _used(text):
            if name != own and name not in ordered:
                visit(TABLES[name], name)
                if name not in ordered:
                    ordered.append(name)

    visit(sql, None)
    if not ordered:
        return sql.strip()
    head = ",\n".join(f"{name} AS ({TABLES[name].strip()})" for name in ordered)
    return f"WITH {head}\n{sql.strip()}"
