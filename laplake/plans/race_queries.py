"""Results, identity, pit stops, calendars and catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from laplake import constants as C
from laplake import schemas
from laplake.functions.labels import team_color
from laplake.functions.numbers import fixed
from laplake.operators import catalogue, identity, pits, race, results
from laplake.plans import jobs
from laplake.plans.fixtures import RaceData
from laplake.plans.oracle import r3, r6
from laplake.plans.registry import query
from laplake.session import new_folder
from laplake.sources import pages, tables
from laplake.sources.feeds import season_session_key

CUT = "1990-06-15"


def _color_sql(team: str, palette: dict[str, str] = C.TEAM_COLORS) -> str:
    cases = " ".join(f"WHEN contains(lower({team}), '{k}') THEN '{v}'" for k, v in palette.items())
    return f"CASE {cases} ELSE '{C.DEFAULT_COLOR}' END"


LABEL = """CASE WHEN status IS NULL OR status IN ('', 'Unknown') THEN '—' WHEN status = 'Finished' THEN 'Finished'
    WHEN status LIKE '+%' THEN status WHEN status IN ('Did Not Start', 'DNS') THEN 'DNS'
    WHEN status LIKE '%Lap%' THEN status ELSE concat('DNF: ', status) END"""


@query("status_class", f"""SELECT *, status_label <> 'Finished' AND status_label NOT LIKE '+%'
       AND status_label <> '—' AS not_classified
       FROM (SELECT season, round_number, driver_number, finish_position, status, {LABEL} AS status_label
             FROM results)""")
def _status(d: RaceData):
    return results.status_classes(d.results.select(
        "season", "round_number", "driver_number", "finish_position", "status"))


@query("dns_drivers", """
    SELECT DISTINCT session_key, driver_number, TRUE AS started FROM laps
    UNION ALL
    SELECT session_key, driver_number, FALSE FROM race_status s
    WHERE status = 'Did Not Start' AND NOT EXISTS (
        SELECT 1 FROM laps l WHERE l.session_key = s.session_key AND l.driver_number = s.driver_number)""")
def _dns(d: RaceData):
    return results.race_drivers(d.race_status, d.laps)


@query("dnf_last_lap", """SELECT session_key, driver_number, any_value(code) AS code, max(lap_number) AS last_lap
       FROM race_status JOIN laps USING (session_key, driver_number)
       WHERE status = 'Gearbox' GROUP BY session_key, driver_number""")
def _dnf(d: RaceData):
    return results.retirements(d.race_status, d.laps)


@query("team_color", f"""SELECT driver_number, team, {_color_sql('team')} AS color,
       {_color_sql('team', C.DISPLAY_TEAM_COLORS)} AS display_color FROM people""")
def _team_color(d: RaceData):
    return d.people.select(
        "driver_number", "team", team_color("team").alias("color"),
        team_color("team", C.DISPLAY_TEAM_COLORS).alias("display_color"))


ROSTER_SQL = f"""
    SELECT 2024 AS season, CASE WHEN known THEN driver_number ELSE 0 END AS driver_number,
           CASE WHEN known THEN code ELSE '???' END AS code, full_name, shown AS team,
           {_color_sql('shown')} AS color,
           CASE WHEN driver_number % 4 <> 0 THEN nationality ELSE '' END AS nationality
    FROM (SELECT *, driver_number % 10 <> 9 AS known,
                 CASE WHEN driver_number % 10 <> 9 AND driver_number % 7 <> 3 AND driver_number % 11 <> 0
                      THEN team ELSE 'Unknown' END AS shown FROM people)"""


@query("roster_enrich", ROSTER_SQL)
def _roster(d: RaceData):
    drivers = pages.season_drivers(pages.parse_pages(d.driver_pages, schemas.DRIVER_PAGE))
    teams = pages.standings_teams(pages.parse_pages(d.standings_pages, schemas.STANDINGS_PAGE))
    return pages.roster(drivers, teams)


@query("results_flatten", f"""
    SELECT season, round_number, r.driver_number, code AS abbreviation,
           concat(given, ' ', family) AS full_name, team, {_color_sql('team')} AS team_color,
           grid_position, finish_position, status, points, laps_completed, coalesce(gap, '') AS time,
           coalesce(fastest_lap_time, '') AS fastest_lap_time, fastest_lap_rank
    FROM (SELECT *, CASE driver_number % 8 WHEN 0 THEN 'Red Bull Racing' WHEN 1 THEN 'Scuderia Ferrari'
                 WHEN 2 THEN 'McLaren F1 Team' WHEN 3 THEN 'Racing Bulls' WHEN 4 THEN 'Kick Sauber'
                 WHEN 5 THEN 'RB Honda' WHEN 6 THEN 'Turbo Works' ELSE 'Unknown Garage' END AS team
          FROM results) r
    JOIN (SELECT driver_number, code, given, family FROM people) p ON r.driver_number = p.driver_number""")
def _results(d: RaceData):
    return pages.classification(pages.parse_pages(d.race_pages))


SEASON_RESULTS = """SELECT season, round_number, race_name, circuit_id, driver_id, constructor_id, grid_position,
       finish_position, points, status, fastest_lap_time, 'jolpica' AS source FROM results"""


@query("season_results", SEASON_RESULTS)
def _season_results(d: RaceData):
    return pages.season_results(pages.parse_pages(d.race_pages))


@query("driver_career", f"""SELECT * REPLACE (CAST(NULL AS VARCHAR) AS fastest_lap_time)
       FROM ({SEASON_RESULTS}) WHERE season BETWEEN 2020 AND 2024""")
def _career(d: RaceData):
    return pages.driver_career(pages.season_results(pages.parse_pages(d.race_pages)))


@query("circuit_history", f"""SELECT * REPLACE (CAST(NULL AS VARCHAR) AS fastest_lap_time)
       FROM ({SEASON_RESULTS}) WHERE season BETWEEN 2018 AND 2024""")
def _circuit(d: RaceData):
    return pages.circuit_history(pages.season_results(pages.parse_pages(d.race_pages)))


@query("results_fallback", """
    SELECT season, round_number, driver_number, finish_position, grid_position, status, points,
           CASE WHEN country <> 'Atlantis' THEN laps_completed
                WHEN laps_completed % 5 = 0 THEN 0 ELSE laps_completed END AS laps_completed,
           CASE WHEN country <> 'Atlantis' THEN 'jolpica' ELSE 'fastf1' END AS source
    FROM results""")
def _fallback(d: RaceData):
    # The first provider lacks the races of one country; the second types all as text.
    known = d.races.where("country <> 'Atlantis'").select("season", "round_number")
    first = race.lookup(
        pages.classification(pages.parse_pages(d.race_pages)), known, ["season", "round_number"], "left_semi")
    raw = d.results.select(
        "season", "round_number", F.col("driver_number").cast("string").alias("driver_number"),
        F.lit("nan").alias("abbreviation"), F.lit("").alias("full_name"), F.lit("<NA>").alias("team"),
        F.coalesce(F.col("grid_position").cast("double").cast("string"), F.lit("nan")).alias("grid_position"),
        F.col("finish_position").cast("double").cast("string").alias("finish_position"), "status",
        F.col("points").cast("string").alias("points"),
        F.when(F.col("laps_completed") % 5 != 0, F.col("laps_completed").cast("string")).otherwise("None")
        .alias("laps_completed"))
    both = results.race_results(first, results.typed_results(raw))
    return results.by_finish(both).select(
        "season", "round_number", "driver_number", "finish_position", "grid_position", "status", "points",
        "laps_completed", "source")


@query("driver_dimension", f"""SELECT session_key, race_number, code, full_name, team,
       {_color_sql('team', C.DISPLAY_TEAM_COLORS)} AS color FROM dimension""")
def _dimension(d: RaceData):
    return _drivers(d)


def _drivers(d: RaceData):
    """Three sources that cover different drivers and name them differently: soft laps, positions, valid laps."""
    def drivers(rows):
        return rows.select("session_key", "driver_number").distinct()

    def named(rows, letter):
        return drivers(rows).withColumn("driver_code", F.concat(F.lit(letter), F.col("driver_number").cast("string")))

    timed = race.with_codes(drivers(d.valid.where("tyre_compound = 'SOFT'")), d.roster)
    seen = named(d.positions.where("position IS NOT NULL"), "P")
    return identity.driver_dimension(d.race_status, timed, seen, named(d.valid, "S"), d.roster)


@query("results_drivers", """
    SELECT s.session_key, s.driver_number, s.code, coalesce(d.race_number, n.race_number) AS matched_number,
           CASE WHEN d.race_number IS NULL THEN n.full_name ELSE d.full_name END AS full_name
    FROM race_status s LEFT JOIN dimension d ON s.session_key = d.session_key AND s.code = d.code
    LEFT JOIN dimension n ON s.session_key = n.session_key AND s.driver_number = n.race_number""")
def _results_drivers(d: RaceData):
    joined = identity.results_with_driver(d.race_status, _drivers(d))
    return joined.select("session_key", "driver_number", "code",
                         F.col("driver.race_number").alias("matched_number"),
                         F.col("driver.full_name").alias("full_name"))


STOP = ["session_key", "driver_id", "stop_number", "lap_number"]
STOP_SQL = "session_key, driver_id, stop_number, lap_number"


@query("pit_stops_clean", f"SELECT {STOP_SQL}, {r6('duration_seconds')} AS duration_seconds, duration_formatted FROM stops")
def _clean(d: RaceData):
    ordered = pits.by_lap(pits.clean_stops(d.raw_pits))
    return ordered.select(*STOP, fixed("duration_seconds", 6).alias("duration_seconds"), "duration_formatted")


def _matched(number: str, otherwise: str) -> str:
    """Slug rules of the derived feed: kinds 0 to 2 match a rostered driver."""
    return f"CASE WHEN s.driver_number % 5 < 3 AND r.code IS NOT NULL THEN {number} ELSE {otherwise} END"


@query("pit_identity", f"""
    SELECT s.session_key, s.driver_id, s.stop_number, s.lap_number, {_matched('r.code', "''")} AS driver_code,
           {_matched('s.driver_number', '0')} AS driver_number
    FROM stops s LEFT JOIN roster r ON s.driver_number = r.driver_number""")
def _identity(d: RaceData):
    found = identity.identify_stops(pits.clean_stops(d.raw_pits), d.race_status)
    return found.select(*STOP, "driver_code", "driver_number")


@query("identity_cascade", """
    SELECT s.session_key, s.driver_id, s.stop_number, s.lap_number,
           coalesce(c.race_number, p.race_number, z.race_number, s.matched) AS race_number
    FROM (SELECT s.*, CASE WHEN s.driver_number % 5 < 3 THEN r.code END AS code,
                 CASE WHEN s.driver_number % 5 < 3 AND r.code IS NOT NULL THEN s.driver_number ELSE 0 END AS matched
          FROM stops s LEFT JOIN roster r ON s.driver_number = r.driver_number) s
    LEFT JOIN dimension c ON c.session_key = s.session_key AND c.code = s.code
    LEFT JOIN (SELECT session_key, driver_id, min(race_number) AS race_number
               FROM (SELECT DISTINCT session_key, driver_id FROM stops) i JOIN dimension n USING (session_key)
               WHERE contains(replace(lower(i.driver_id), '_', ''), lower(split_part(n.full_name, ' ', -1)))
               GROUP BY session_key, driver_id) p
         ON p.session_key = s.session_key AND p.driver_id = s.driver_id
    LEFT JOIN dimension z ON z.session_key = s.session_key AND z.race_number = s.matched""")
def _cascade(d: RaceData):
    stops = identity.identify_stops(pits.clean_stops(d.raw_pits), d.race_status)
    out = identity.identity_cascade(stops, _drivers(d), d.race_status)
    return out.select(*STOP, "race_number")


@query("pit_events", """SELECT session_key, driver_number, lap_number,
       CAST(row_number() OVER (PARTITION BY session_key, driver_number ORDER BY lap_number) AS INT) AS stop_number
       FROM timed_laps WHERE pit_in_s IS NOT NULL""")
def _events(d: RaceData):
    return pits.pit_events(d.timed_laps, d.hot_drivers).select(
        "session_key", "driver_number", "lap_number", "stop_number")


@query("pit_duration_join", f"""
    SELECT session_key, driver_number, lap_number, duration_seconds,
           CASE WHEN duration_seconds IS NULL THEN '—' ELSE printf('%.3f', duration_seconds) END AS duration_formatted
    FROM (SELECT i.session_key, i.driver_number, i.lap_number,
                 CASE WHEN o.pit_out_s - i.pit_in_s > 0 AND o.pit_out_s - i.pit_in_s < 120
                      THEN {r3('o.pit_out_s - i.pit_in_s')} END AS duration_seconds
          FROM timed_laps i LEFT JOIN timed_laps o
            ON i.session_key = o.session_key AND i.driver_number = o.driver_number
           AND o.lap_number = i.lap_number + 1 AND o.pit_out_s IS NOT NULL
          WHERE i.pit_in_s IS NOT NULL)""")
def _durations(d: RaceData):
    events = pits.pit_events(d.timed_laps, d.hot_drivers)
    return pits.pit_durations(events, d.timed_laps).select(
        "session_key", "driver_number", "lap_number", "duration_seconds", "duration_formatted")


@query("pit_report", f"""
    SELECT 2024000 + s.session_key AS session_key, {_matched('r.code', "''")} AS driver_code,
           {_matched('s.driver_number', '0')} AS driver_number, s.stop_number, s.lap_number,
           {r6('s.duration_seconds')} AS duration_seconds, s.duration_formatted, 'pages' AS source
    FROM stops s LEFT JOIN roster r ON s.driver_number = r.driver_number
    WHERE s.session_key < (SELECT max(session_key) FROM laps)
    UNION ALL
    SELECT 2024000 + e.session_key, coalesce(r.code, CAST(e.driver_number AS VARCHAR)), e.driver_number,
           CAST(row_number() OVER (PARTITION BY e.session_key, e.driver_number ORDER BY lap_number) AS INT), lap_number,
           {r6('stay')}, CASE WHEN stay IS NULL THEN '—' ELSE printf('%.3f', stay) END, 'laps'
    FROM (SELECT i.session_key, i.driver_number, i.lap_number,
                 CASE WHEN o.pit_out_s - i.pit_in_s > 0 AND o.pit_out_s - i.pit_in_s < 120
                      THEN {r3('o.pit_out_s - i.pit_in_s')} END AS stay
          FROM timed_laps i LEFT JOIN timed_laps o
            ON i.session_key = o.session_key AND i.driver_number = o.driver_number
           AND o.lap_number = i.lap_number + 1 AND o.pit_out_s IS NOT NULL
          WHERE i.pit_in_s IS NOT NULL) e
    LEFT JOIN roster r ON e.driver_number = r.driver_number
    WHERE e.session_key = (SELECT max(session_key) FROM laps)""")
def _report(d: RaceData):
    """Pages to typed, identified stops, and the laps' own stops for the race without pages."""

    def keyed(frame):
        return frame.withColumn("session_key", season_session_key(F.lit(2024), "session_key"))

    stops = identity.identify_stops(pits.clean_stops(pages.pit_feed(pages.parse_pages(d.pit_pages))), keyed(d.race_status))
    events = pits.pit_durations(pits.pit_events(d.timed_laps, d.hot_drivers), d.timed_laps)
    report = pits.pit_report(stops, race.with_codes(keyed(events), d.roster))
    return report.withColumn("duration_seconds", fixed("duration_seconds", 6))


@query("pit_compound", """
    SELECT session_key, driver_number, lap_number,
           (SELECT min_by(t.compound, t.start_lap) FROM stint_table t
            WHERE t.session_key = l.session_key AND t.driver_number = l.driver_number
              AND t.start_lap > l.lap_number) AS tyre_compound_new
    FROM laps l WHERE is_pit_in_lap""")
def _compound(d: RaceData):
    stops = d.laps.where("is_pit_in_lap")
    return pits.stop_compounds(stops, race.tyre_stints(d.features), d.hot_drivers)


@query("pit_stop_stats", f"""SELECT session_key, {r6('min(duration_seconds)')} AS fastest_stop,
       {r6('avg(duration_seconds)')} AS average_stop, {r6('max(duration_seconds)')} AS slowest_stop
       FROM (SELECT session_key, CASE WHEN duration_seconds > 1 AND duration_seconds < 60 THEN duration_seconds END
                    AS duration_seconds FROM stops) GROUP BY session_key""")
def _stats(d: RaceData):
    out = pits.stop_statistics(pits.clean_stops(d.raw_pits))
    return out.select("session_key", *[fixed(n, 6).alias(n) for n in ("fastest_stop", "average_stop", "slowest_stop")])


@query("pit_stop_flags", f"""
    SELECT {STOP_SQL}, coalesce(duration_seconds = best, FALSE) AS is_fastest,
           coalesce(duration_seconds > 40 AND NOT coalesce(duration_seconds = best, FALSE), FALSE) AS is_slow
    FROM stops JOIN (SELECT session_key, min(duration_seconds) FILTER (duration_seconds > 1 AND duration_seconds < 60)
                            AS best FROM stops GROUP BY session_key) USING (session_key)""")
def _flags(d: RaceData):
    return pits.stop_flags(pits.clean_stops(d.raw_pits)).select(*STOP, "is_fastest", "is_slow")


CALENDAR_SQL = """SELECT season, round_number AS round, replace(race_name, ' Grand Prix', '') AS name,
       race_name AS full_name, upper(circuit_id) AS circuit, country, concat(country, ' City') AS locality,
       race_date AS date FROM races"""


@query("calendar", CALENDAR_SQL)
def _calendar(d: RaceData):
    return pages.calendar(pages.parse_pages(d.race_pages))


@query("cached_calendar", CALENDAR_SQL)
def _cached_calendar(d: RaceData):
    """The calendar as it is kept between runs: a JSON array per season, in a file of its own."""
    rows = pages.calendar(pages.parse_pages(d.race_pages))
    path = new_folder(d.spark, "calendar")
    rows.groupBy(F.col("season").alias("year")).agg(
        F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")).write.partitionBy("year").text(path)
    return pages.cached_json(d.spark, path).withColumnRenamed("year", "season").select(*rows.columns)


_FLAGS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.COUNTRY_CODES.items())


@query("calendar_status", f"""
    SELECT season, round_number AS round, CASE country {_FLAGS} ELSE 'un' END AS flag,
           strftime(CAST(race_date AS DATE), '%-d %b') AS short_date,
           CAST(race_date AS DATE) < DATE '{CUT}' AS is_past, country <> 'Japan' AS is_processed
    FROM races""")
def _calendar_status(d: RaceData):
    calendar = pages.calendar(pages.parse_pages(d.race_pages))
    done = d.races.where("country <> 'Japan'").select("season", "round_number")
    out = catalogue.calendar_status(calendar, done, F.lit(CUT).cast("date"))
    return out.select("season", "round", "flag", "short_date", "is_past", "is_processed")


@query("season_list", """SELECT CAST(unnest(range(CAST(max(season) AS BIGINT), CAST(min(season) AS BIGINT) - 1, -1)) AS INT)
       AS season FROM results""")
def _seasons(d: RaceData):
    return catalogue.season_list(d.results, first=None)


@query("available_races", """SELECT season, round_number, CAST(count(*) OVER (PARTITION BY season) AS BIGINT) AS races
       FROM races WHERE country <> 'Japan'""")
def _available(d: RaceData):
    # Folder names of processed races, among them folders that name no race.
    done = d.races.select(F.when(
        F.col("country") != "Japan", F.concat(F.col("season"), F.lit("_round"), F.col("round_number")),
    ).otherwise(F.concat(F.lit("tmp_"), F.col("season"))).alias("folder"))
    found = tables.available_races(tables.race_folders(done))
    return race.lookup(found, tables.races_per_season(found), ["season"])


@query("completed_rounds", """SELECT DISTINCT season, round_number, replace(race_name, ' Grand Prix', ' GP')
       AS race_name FROM results""")
def _rounds(d: RaceData):
    return catalogue.completed_rounds(d.results)


SESSIONS_SQL = """SELECT CAST(season * 1000 + round_number AS INT) AS session_key, season AS year,
       CASE WHEN race_no % 4 = 3 THEN 'Qualifying' ELSE 'Race' END AS session_type, country AS country_name,
       concat(race_date, 'T13:00:00') AS date_start FROM races"""


def _sessions(d: RaceData):
    return d.races.select(
        season_session_key("season", "round_number").alias("session_key"), F.col("season").alias("year"),
        F.when(F.col("race_no") % 4 == 3, "Qualifying").otherwise("Race").alias("session_type"),
        F.col("country").alias("country_name"),
        F.concat("race_date", F.lit("T13:00:00")).alias("date_start"))


@query("latest_session", f"""SELECT * FROM ({SESSIONS_SQL}) WHERE session_type = 'Race'
       ORDER BY date_start DESC, session_key DESC LIMIT 1""")
def _latest_session(d: RaceData):
    return catalogue.latest_session(_sessions(d))


FIRST_LAPS = """SELECT CAST(season * 1000 + round_number AS INT) AS session_key, laps_completed AS lap_number
       FROM results"""


@query("sessions_with_data", f"""
    SELECT session_key, year, session_type, country_name, date_start
    FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY date_start DESC, session_key DESC) AS place
          FROM ({SESSIONS_SQL})) WHERE place <= 5
      AND session_key IN (SELECT session_key FROM ({FIRST_LAPS}) WHERE lap_number = 1)""")
def _with_data(d: RaceData):
    laps = d.results.select(season_session_key("season", "round_number").alias("session_key"),
                            F.col("laps_completed").alias("lap_number"))
    return catalogue.sessions_with_data(_sessions(d), laps)


@query("session_probe", f"""
    SELECT s.session_key, count(l.session_key) AS records FROM ({SESSIONS_SQL}) s
    LEFT JOIN (SELECT session_key FROM ({FIRST_LAPS}) WHERE lap_number = 1) l ON s.session_key = l.session_key
    GROUP BY s.session_key""")
def _probe(d: RaceData):
    laps = d.results.select(season_session_key("season", "round_number").alias("session_key"),
                            F.col("laps_completed").alias("lap_number"))
    return catalogue.first_lap_counts(_sessions(d), laps).select("session_key", "records")


@query("circuit_names", """
    SELECT r.season, r.round_number, r.driver_number, r.finish_position,
           CASE WHEN country = 'Atlantis' THEN 'Unknown' ELSE replace(race_name, ' Grand Prix', '') END AS circuit_name
    FROM results r""")
def _circuit_names(d: RaceData):
    calendar = d.races.where("country <> 'Atlantis'").select(
        "season", F.col("round_number").alias("round"),
        F.replace("race_name", F.lit(" Grand Prix"), F.lit("")).alias("name"))
    rows = d.results.select("season", "round_number", "driver_number", "finish_position")
    return catalogue.circuit_names(rows, calendar)


@query("backfill_plan", """SELECT DISTINCT season, round_number, replace(race_name, ' Grand Prix', ' GP') AS race_name,
       country <> 'Japan' AS skip FROM results""")
def _plan(d: RaceData):
    return _backfill_plan(d)


def _backfill_plan(d: RaceData):
    done = d.races.where("country <> 'Japan'").select("season", "round_number")
    return jobs.backfill_plan(catalogue.completed_rounds(d.results), done)


@query("backfill_audit", """
    SELECT CAST(season AS INT) AS season, CAST(round_number AS INT) AS round_number,
           CASE WHEN season = 2020 THEN 'skipped' WHEN n > 0 THEN 'succeeded' ELSE 'failed' END AS outcome,
           CAST(CASE WHEN season = 2020 THEN 0 ELSE coalesce(n, 0) END AS BIGINT) AS rows,
           CAST(CASE WHEN season = 2020 THEN 0 ELSE coalesce(n, 0) END AS BIGINT) AS expected
    FROM (SELECT DISTINCT 2020 + driver_number % 5 AS season, session_key AS round_number FROM laps
          UNION SELECT 2025, session_key FROM laps) rounds
    LEFT JOIN (SELECT 2020 + driver_number % 5 AS season, session_key AS round_number, count(*) AS n
               FROM valid GROUP BY ALL) counted USING (season, round_number)""")
def _audit(d: RaceData):
    """Plan, process, write and audit: one season is done before, one has no laps."""
    season = (2020 + F.col("driver_number") % 5).cast("int")
    laps = d.laps.withColumns({"season": season, "round_number": F.col("session_key")})
    rounds = laps.select("season", "round_number").union(
        laps.select(F.lit(2025), "round_number")).distinct()
    audit = jobs.backfill(
        d.spark, laps, rounds, new_folder(d.spark, "backfill"), rounds.where("season = 2020"), limits=d.limits)
    return audit.select("season", "round_number", "outcome", "rows", "expected")
