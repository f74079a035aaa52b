import datetime
import json
import math

import pytest
from pyspark.sql import functions as F

from laplake import schemas
from laplake.functions.labels import driver_surname, flag_code, status_label, team_color, track_status_label
from laplake.functions.numbers import clean_text, fixed_text, interval_seconds, lap_time_text
from laplake.operators import results as res
from laplake.operators.catalogue import calendar_status, season_list_until
from laplake.sinks import messages as out
from laplake.sources import feeds, messages, pages, tables

LAP = dict(session_key=9999, driver_number=1, lap_number=42, lap_duration=91.234, sector_1_time=28.1,
           sector_2_time=32.4, sector_3_time=30.7, tyre_compound="SOFT", tyre_age_laps=5,
           is_pit_out_lap=False, is_pit_in_lap=False, timestamp="2024-01-01T00:00:00", source="test")


def _raw(spark, *values):
    rows = [("f1.lap.data", i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "topic string, offset long, value string")


def test_lap_round_trip_is_exact(spark):
    sent = out.lap_messages(spark.createDataFrame([tuple(LAP.values())], schemas.LAP))
    row = sent.first()
    assert (row["topic"], row["key"]) == ("f1.lap.data", "9999:1:42")
    back = messages.decode_messages(sent.select("value")).first().asDict()
    assert back == LAP


def test_bad_messages_are_dropped_and_kept_apart(spark):
    good, no_lap = json.dumps(LAP), json.dumps({**LAP, "lap_number": None})
    wrong_type = json.dumps({**LAP, "tyre_age_laps": "many"})
    nan = json.dumps({**LAP, "lap_duration": math.nan})
    raw = _raw(spark, good, "{broken", no_lap, wrong_type, nan, "")
    decoded = messages.decode_messages(raw, origin=True).orderBy("_kafka_offset").collect()
    assert [r["_kafka_offset"] for r in decoded] == [0, 3, 4]
    assert decoded[1]["tyre_age_laps"] is None and decoded[1]["lap_duration"] == 91.234
    assert decoded[2]["lap_duration"] is None
    assert sorted(r["offset"] for r in messages.rejected_messages(raw).collect()) == [1, 2, 5]
    assert messages.first_messages(messages.decode_messages(raw, origin=True), 2).count() == 2


def test_session_event_type_comes_first(spark):
    events = spark.createDataFrame([("fastf1",)], "source string")
    row = out.session_messages(events, "session_end").first()
    assert (row["key"], row["value"]) == ("session_end", '{"event_type":"session_end","source":"fastf1"}')


def test_position_and_pit_keys(spark):
    positions = spark.createDataFrame([(7, 44, 3)], "session_key int, driver_number int, position int")
    assert out.position_messages(positions).first()["key"] == "7:44"
    pits = spark.createDataFrame([(7, 44, 30)], "session_key int, driver_number int, lap_number int")
    assert out.pit_messages(pits).first()["key"] == "7:44:30"


def test_timing_lap_filters(spark):
    raw = spark.createDataFrame(
        [(1, d, n, 90.0, 1.0, 2.0, 3.0, "SOFT", 4, None) for d in (1, 2) for n in (1, 2)],
        "session_key int, driver_number int, lap_number int, lap_duration double, duration_sector_1 double, "
        "duration_sector_2 double, duration_sector_3 double, compound string, tyre_age_at_start int, "
        "is_pit_out_lap boolean")
    assert feeds.timing_laps(raw, 1).count() == 2
    assert feeds.timing_laps(raw, 1, 2).count() == 1
    assert feeds.timing_laps(raw, 0, 0).count() == 4
    assert feeds.timing_laps(raw).first()["is_pit_out_lap"] is False


def test_clock_laps_use_seconds(spark):
    second = datetime.timedelta(minutes=1, seconds=31, milliseconds=234)
    raw = spark.createDataFrame(
        [(1, 1, 1, second, None, second, None, "SOFT", 3.0, None, second), (1, 1, 2, None, None, None, None, None,
                                                                          None, None, None)],
        "session_key int, driver_number int, lap_number int, lap_time interval day to second, "
        "sector_1 interval day to second, sector_2 interval day to second, sector_3 interval day to second, "
        "compound string, tyre_life double, pit_out_time interval day to second, pit_in_time interval day to second")
    row = feeds.clock_laps(raw).first()
    assert feeds.clock_laps(raw).count() == 1
    assert row["lap_duration"] == pytest.approx(91.234) and row["sector_1_time"] is None
    assert (row["is_pit_out_lap"], row["is_pit_in_lap"], row["tyre_age_laps"]) == (False, True, 3)


def test_long_interval_seconds(spark):
    df = spark.createDataFrame([(datetime.timedelta(days=1, hours=2, seconds=3, microseconds=5),)],
                               "i interval day to second")
    assert df.select(interval_seconds("i")).first()[0] == pytest.approx(93603.000005)


RACE_PAGE = {"MRData": {"RaceTable": {"season": "2024", "Races": [{
    "season": "2024", "round": "3", "raceName": "Australian Grand Prix", "date": "2024-03-24",
    "Circuit": {"circuitId": "albert_park", "circuitName": "Albert Park",
                "Location": {"country": "Australia", "locality": "Melbourne"}},
    "Results": [
        {"number": "55", "position": "1", "grid": "2", "points": "25", "laps": "58", "status": "Finished",
         "Driver": {"driverId": "sainz", "code": "SAI", "givenName": "Carlos", "familyName": "Sainz"},
         "Constructor": {"constructorId": "ferrari", "name": "Ferrari"}, "Time": {"time": "1:20:26.843"},
         "FastestLap": {"rank": "2", "Time": {"time": "1:20.031"}}},
        {"position": "20", "grid": "0", "points": "0", "laps": "x",
         "Driver": {"driverId": "doe", "permanentNumber": "99", "givenName": "Jo", "familyName": "Doe"},
         "Constructor": {"constructorId": "none", "name": "Privateer"}}],
    "PitStops": [{"driverId": "sainz", "stop": "1", "lap": "16", "time": "15:20:01", "duration": "22.1"}],
}]}}}


def _page(spark, body, schema=schemas.RACE_PAGE):
    return pages.parse_pages(spark.createDataFrame([(json.dumps(body),)], "body string"), schema)


def test_classification_defaults(spark):
    first, second = pages.classification(_page(spark, RACE_PAGE)).orderBy("finish_position").collect()
    assert (first["driver_number"], first["abbreviation"], first["team_color"]) == (55, "SAI", "#E8002D")
    assert (first["fastest_lap_rank"], first["fastest_lap_time"], first["time"]) == (2, "1:20.031", "1:20:26.843")
    assert (second["driver_number"], second["abbreviation"], second["grid_position"]) == (99, "???", None)
    assert (second["status"], second["laps_completed"], second["fastest_lap_rank"]) == ("Unknown", 0, None)
    assert second["team_color"] == "#888888" and second["time"] == ""


def test_season_results_and_histories(spark):
    found = pages.season_results(_page(spark, RACE_PAGE))
    assert found.where("grid_position IS NULL").count() == 1
    assert pages.driver_career(found, "sainz").count() == 1
    assert pages.driver_career(found, "sainz", [2020]).count() == 0
    assert pages.circuit_history(found, "albert_park").count() == 2
    assert pages.circuit_history(found).where("fastest_lap_time IS NOT NULL").count() == 0


def test_calendar_and_pit_feed(spark):
    parsed = _page(spark, RACE_PAGE)
    race = pages.calendar(parsed).first()
    assert (race["round"], race["name"], race["locality"]) == (3, "Australian", "Melbourne")
    assert pages.pit_feed(parsed).first()["duration"] == "22.1"
    done = spark.createDataFrame([(2024, 3)], "season int, round_number int")
    status = calendar_status(pages.calendar(parsed), done, F.lit("2024-03-25").cast("date")).first()
    assert (status["flag"], status["short_date"], status["is_past"], status["is_processed"]) == (
        "au", "24 Mar", True, True)


def test_roster_skips_unknown_codes(spark):
    drivers = {"MRData": {"DriverTable": {"season": "2024", "Drivers": [
        {"permanentNumber": "23", "code": "ALB", "givenName": "Alexander", "familyName": "Albon",
         "nationality": "Thai"}, {"givenName": "Paul", "familyName": "Aron"}]}}}
    standings = {"MRData": {"StandingsTable": {"season": "2024", "StandingsLists": [{"DriverStandings": [
        {"Driver": {"code": "ALB"}, "Constructors": [{"name": "Williams"}]},
        {"Driver": {"code": "???"}, "Constructors": [{"name": "Ferrari"}]},
        {"Driver": {"code": "XXX"}, "Constructors": []}]}]}}}
    rows = {r["full_name"]: r for r in pages.roster(
        pages.season_drivers(_page(spark, drivers, schemas.DRIVER_PAGE)),
        pages.standings_teams(_page(spark, standings, schemas.STANDINGS_PAGE))).collect()}
    assert (rows["Alexander Albon"]["team"], rows["Alexander Albon"]["color"]) == ("Williams", "#64C4FF")
    assert tuple(rows["Paul Aron"])[1:] == (0, "???", "Paul Aron", "Unknown", "#888888", "")


def test_empty_standings(spark):
    body = {"MRData": {"StandingsTable": {"season": "2024", "StandingsLists": []}}}
    assert pages.standings_teams(_page(spark, body, schemas.STANDINGS_PAGE)).count() == 0


def test_cached_json_arrays(spark, tmp_path):
    (tmp_path / "calendar.json").write_text(json.dumps([
        {"round": 1, "name": "A", "full_name": "A Grand Prix", "circuit": "x", "country": "Italy",
         "locality": "y", "date": "2025-03-16"}, {"round": 2, "name": "B"}]))
    assert [r["round"] for r in pages.cached_json(spark, str(tmp_path)).orderBy("round").collect()] == [1, 2]


def test_typed_results(spark):
    raw = spark.createDataFrame(
        [("2024", "1", "nan", "VER", "Max", "Red Bull Racing", "1.0", "nan", "Finished", "x", "57.0")],
        "season string, round_number string, driver_number string, abbreviation string, full_name string, "
        "team string, grid_position string, finish_position string, status string, points string, "
        "laps_completed string")
    row = res.typed_results(raw).first()
    assert (row["driver_number"], row["grid_position"], row["finish_position"]) == (0, 1, None)
    assert (row["points"], row["laps_completed"], row["team_color"]) == (0.0, 57, "#3671C6")


@pytest.mark.parametrize("status, label", [
    (None, "—"), ("", "—"), ("Unknown", "—"), ("Finished", "Finished"), ("+1 Lap", "+1 Lap"), ("DNS", "DNS"),
    ("Did Not Start", "DNS"), ("2 Laps", "2 Laps"), ("Engine", "DNF: Engine")])
def test_status_labels(spark, status, label):
    assert spark.createDataFrame([(status,)], "s string").select(status_label("s")).first()[0] == label


def test_label_tables(spark):
    df = spark.createDataFrame([("Visa RB Team", "Miami", "4"), (None, "Atlantis", "9")],
                               "team string, country string, code string")
    found = df.select(team_color("team"), flag_code("country"), track_status_label("code")).collect()
    assert tuple(found[0]) == ("#6692FF", "us", "Safety Car")
    assert tuple(found[1]) == ("#888888", "un", "Status 9")


def test_driver_surnames(spark):
    df = spark.createDataFrame([(44,), (99,)], "n int")
    assert [r[0] for r in df.select(driver_surname("n")).collect()] == ["Hamilton", "99"]


@pytest.mark.parametrize("seconds, text", [
    (119.9996, "2:00.000"), (90.05, "1:30.050"), (60.0, "1:00.000"), (61.0004, "1:01.000"), (125.5, "2:05.500")])
def test_lap_time_text(spark, seconds, text):
    assert spark.range(1).select(lap_time_text(F.lit(seconds))).first()[0] == text


def test_number_texts(spark):
    df = spark.range(1).select(fixed_text(F.lit(0.0625), 3), fixed_text(F.lit(-0.25125), 4))
    assert tuple(df.first()) == ("0.063", "-0.2513")
    marks = spark.createDataFrame([("nan",), ("None",), ("<NA>",), ("",), ("ok",)], "t string")
    assert [r[0] for r in marks.select(clean_text("t")).collect()] == [None] * 4 + ["ok"]


def test_json_records(spark):
    df = spark.createDataFrame([(1, math.nan), (2, math.inf), (3, 1.5), (4, None)], "k int, v double")
    found = sorted(r[0] for r in tables.json_records(df).collect())
    assert found == ['{"k":1,"v":null}', '{"k":2,"v":null}', '{"k":3,"v":1.5}', '{"k":4,"v":null}']


def test_race_folders(spark):
    names = spark.createDataFrame([("2024_round1",), ("2024_round12_old",), ("x2024_round1",), ("tmp",)],
                                  "folder string")
    found = tables.race_folders(names).collect()
    assert sorted(map(tuple, found)) == [(2024, 1), (2024, 12)]


def test_season_list(spark):
    found = [r[0] for r in season_list_until(spark, F.lit(2026)).collect()]
    assert found == [2026, 2025, 2024, 2023]
    assert season_list_until(spark, F.lit(2020)).count() == 0


def test_normalised_laps_pass_as_messages(spark):
    raw = spark.createDataFrame(
        [(2024, 3, 7, 1, "0 00:01:31.5", "SOFT", 4.0)], "season int, round_number int, driver_number int, lap_number int, "
        "lap_time string, compound string, tyre_life double").withColumns({
            "lap_time": F.expr("make_dt_interval(0, 0, 1, 31.5)"),
            **{name: F.expr("make_dt_interval(0, 0, 0, 30.5)") for name in ("sector_1", "sector_2", "sector_3")},
            "pit_out_time": F.expr("CAST(NULL AS INTERVAL DAY TO SECOND)"), "pit_in_time": F.expr("make_dt_interval(0, 0, 0, 9)")})
    laps = feeds.clock_laps(raw)
    back = messages.decode_messages(out.lap_messages(laps)).first()
    assert (back["session_key"], back["lap_duration"], back["is_pit_in_lap"]) == (2024003, 91.5, True)
    assert back["timestamp"] == laps.first()["timestamp"] or back["timestamp"][:4].isdigit()
    assert feeds.clock_pits(raw).first()["session_key"] == 2024003
    raw_session = spark.createDataFrame([(2024, 3, "Race", "Spa", "Belgium")], "season int, round_number int, name string, location string, country string")
    assert feeds.clock_session(raw_session.withColumn("event_date", F.current_timestamp())).first()["session_key"] == 2024003
