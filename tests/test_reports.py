import random

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from laplake.functions.automaton import WordAutomaton
from laplake.functions.names import fold_name
from laplake.operators import catalogue, identity, pits, race, results, text
from laplake.plans.fixtures import RaceData

LAPS = ("session_key int, driver_number int, lap_number int, lap_duration double, tyre_compound string, "
        "stint_number long, tyre_degradation_rate double, should_pit_soon boolean")
ROSTER = "driver_number int, code string, full_name string, team string"


def _laps(spark, *items):
    """(driver, lap, duration, compound, stint)."""
    return spark.createDataFrame([(1, d, n, t, c, s, 0.1, False) for d, n, t, c, s in items], LAPS)


def test_fastest_lap_ties(spark):
    laps = _laps(spark, (2, 3, 90.0004, "SOFT", 0), (2, 1, 90.0004, None, 0), (1, 5, 90.0, "HARD", 0),
                 (3, 1, 89.9, "HARD", 0))
    roster = spark.createDataFrame([(1, "ONE", "A", "T")], ROSTER)
    found = race.fastest_laps(laps, roster).orderBy("rank").collect()
    assert [(r["driver_number"], r["lap_number"], r["driver_code"]) for r in found] == [
        (3, 1, "3"), (1, 5, "ONE"), (2, 1, "2")]
    assert found[2]["tyre_compound"] == "UNKNOWN" and found[2]["lap_time_formatted"] == "1:30.000"


def test_positions_skip_missing_laps(spark):
    laps = _laps(spark, (1, 1, 90.0, None, 0), (1, 2, 90.0, None, 0), (2, 2, 100.0, None, 0), (3, 1, 90.0, None, 0))
    found = {(r["driver_number"], r["lap_number"]): r["position"] for r in race.lap_positions(laps).collect()}
    assert found == {(1, 1): 1, (3, 1): 2, (2, 2): 1, (1, 2): 2}


def test_stint_compound_mode(spark):
    laps = _laps(spark, (1, 1, 90.0, "SOFT", 0), (1, 2, 90.0, "HARD", 0), (1, 3, 90.0, None, 0),
                 (1, 4, 90.0, None, 0), (1, 5, 90.0, None, 0), (1, 6, 90.0, None, 1))
    found = {r["stint"]: r for r in race.tyre_stints(laps).collect()}
    assert (found[1]["compound"], found[1]["start_lap"], found[1]["end_lap"], found[1]["lap_count"]) == ("HARD", 1, 5, 5)
    assert found[2]["compound"] == "UNKNOWN"


def test_headline_of_a_race_without_wear_or_winner(spark):
    laps = _laps(spark, (1, 1, 90.0, "SOFT", 0)).withColumn("tyre_degradation_rate", F.lit(-0.1))
    none = spark.createDataFrame([], "session_key int, code string, finish_position int")
    row = race.race_headline(laps, none, none.select("session_key")).first()
    assert tuple(row) == (1, 1, 0, 0, "0.0000s", "1:30.000", "—")


def test_lap_grid_covers_every_lap(spark):
    last = spark.createDataFrame([(1, 10), (2, 3)], "session_key int, last_lap int")
    found = sorted(map(tuple, race.lap_grid(last, step=4).collect()))
    assert found == [(1, n) for n in range(1, 11)] + [(2, n) for n in range(1, 4)]


def test_latest_position_first_of_equal_times(spark):
    df = spark.createDataFrame([(1, 1, 5, 10, 1), (1, 1, 6, 20, 2), (1, 1, 7, 20, 3), (1, 2, None, 1, 4)],
                               "session_key int, driver_number int, position int, ts int, event_id int")
    assert [tuple(r) for r in race.latest_positions(df).collect()] == [(1, 1, 6), (1, 2, 99)]


def test_first_source_wins_per_race(spark, rows):
    schema = "session_key int, driver_number int, lap_number int, position int"
    exact = spark.createDataFrame([(1, 1, 1, 1)], schema)
    derived = spark.createDataFrame([(1, 2, 1, 1), (2, 2, 1, 1)], schema)
    found = race.first_available(exact, derived, ["session_key"], ("exact", "derived"))
    assert rows(found) == [(1, 1, 1, 1, "exact"), (2, 2, 1, 1, "derived")]


def _feed(spark, *items):
    return spark.createDataFrame(
        [(1, *item) for item in items],
        "session_key int, driver_id string, stop string, lap string, duration string, copy_no int")


def test_clean_stops(spark):
    feed = _feed(spark, ("a", "1", "10", "22.5", 1), ("a", "1", "10", "99.9", 2), ("b", "1", "10", "30:12.345", 1),
                 ("c", "1", "9", "", 1), ("d", None, None, None, 1), ("e", "2", "9", "0.0", 1))
    found = {r["driver_id"]: r for r in pits.clean_stops(feed).collect()}
    assert found["a"]["duration_seconds"] == 22.5
    assert found["b"]["duration_seconds"] is None and found["b"]["duration_formatted"] == "30:12.345"
    assert found["c"]["duration_seconds"] is None and found["c"]["duration_formatted"] == ""
    assert (found["d"]["stop_number"], found["d"]["lap_number"], found["d"]["duration_formatted"]) == (1, 0, "—")
    order = [r["driver_id"] for r in pits.by_lap(pits.clean_stops(feed)).collect()]
    assert order == ["d", "c", "e", "a", "b"]


def test_stop_flags_and_statistics(spark, rows):
    stops = spark.createDataFrame([(1, 0.9), (1, 20.0), (1, 45.0), (1, 60.0), (1, None), (2, 70.0)],
                                  "session_key int, duration_seconds double")
    assert rows(pits.stop_statistics(stops)) == [(1, 20.0, 32.5, 45.0), (2, None, None, None)]
    assert rows(pits.stop_flags(stops), "session_key", "duration_seconds", "is_fastest", "is_slow") == [
        (1, 0.9, False, False), (1, 20.0, True, False), (1, 45.0, False, True), (1, 60.0, False, True),
        (1, None, False, False), (2, 70.0, False, True)]


def test_pit_duration_needs_the_next_lap(spark, rows):
    timed = spark.createDataFrame(
        [(1, 1, 5, 500.0, None), (1, 1, 6, None, 520.5), (1, 2, 5, 500.0, None), (1, 2, 7, None, 520.0),
         (1, 3, 5, 500.0, None), (1, 3, 6, None, 620.0)],
        "session_key int, driver_number int, lap_number int, pit_in_s double, pit_out_s double")
    found = pits.pit_durations(pits.pit_events(timed), timed)
    assert rows(found, "driver_number", "stop_number", "duration_seconds", "duration_formatted") == [
        (1, 1, 20.5, "20.500"), (2, 1, None, "—"), (3, 1, None, "—")]


def test_non_starters_and_retirements(spark, rows):
    status = spark.createDataFrame([(1, 1, "A", "DNS"), (1, 2, "B", "DNS"), (1, 3, None, "Engine"), (1, 4, "D", "Engine")],
                                   "session_key int, driver_number int, code string, status string")
    laps = spark.createDataFrame([(1, 1, 1), (1, 3, 7), (1, 3, 9)], "session_key int, driver_number int, lap_number int")
    assert rows(results.race_drivers(status, laps)) == [(1, 1, True), (1, 2, False), (1, 3, True)]
    assert rows(results.retirements(status, laps)) == [(1, 3, "D3", 9)]


def test_accent_folding(spark):
    df = spark.createDataFrame([("Pérez",), ("Sørensen",), ("HÜLKENBERG",), (None,)], "n string")
    assert [r[0] for r in df.select(fold_name("n")).collect()] == ["perez", "srensen", "hulkenberg", None]


ENTRIES = "session_key int, driver_number int, code string, full_name string, team string, entry_order int"


def test_identity_rules(spark):
    entries = spark.createDataFrame(
        [(1, 11, "PER", "Sergio Pérez", "T", 1), (1, 44, "HAM", "Lewis Hamilton", "T", 2),
         (1, 45, "HAX", "Anthony Hamilton", "T", 3), (1, 12, "ANT", "Andrea Kimi Antonelli", "T", 4)], ENTRIES)
    ids = ["perez", "sergio_perez", "hamilton", "anthony_hamilton", "HAM", "andrea_antonelli",
           "andreakimiantonelli", "max_verstappen", ""]
    stops = spark.createDataFrame([(1, i) for i in ids], "session_key int, driver_id string")
    found = {r["driver_id"]: (r["driver_code"], r["driver_number"])
             for r in identity.identify_stops(stops, entries).collect()}
    assert found == {
        "perez": ("PER", 11), "sergio_perez": ("PER", 11), "hamilton": ("HAM", 44), "anthony_hamilton": ("HAX", 45),
        "HAM": ("HAM", 44), "andrea_antonelli": ("ANT", 12), "andreakimiantonelli": ("ANT", 12),
        "max_verstappen": ("", 0), "": ("", 0)}


def test_identity_cascade(spark):
    dimension = spark.createDataFrame(
        [(1, 1, "VER", "Max Verstappen", "T", "c"), (1, 20, "MAG", "Kevin Magnussen", "T", "c"),
         (1, 27, "HUL", "Nico Hulkenberg", "T", "c")],
        "session_key int, race_number int, code string, full_name string, team string, color string")
    entries = spark.createDataFrame([(1, 50, "HUL", "Oliver Bearman", "T", 1)], ENTRIES)
    stops = spark.createDataFrame(
        [(1, "x", "ver", 0), (1, "kevin_magnussen_jr", "", 0), (1, "zzz", "", 27), (1, "bearman", "", 0),
         (1, "nobody", "", 77)], "session_key int, driver_id string, driver_code string, driver_number int")
    found = {r["driver_id"]: r["race_number"] for r in identity.identity_cascade(stops, dimension, entries).collect()}
    assert found == {"x": 1, "kevin_magnussen_jr": 20, "zzz": 27, "bearman": 27, "nobody": 77}


def test_automaton_equals_search(spark):
    draw = random.Random(5)
    for _ in range(200):
        words = [("".join(draw.choice("ab") for _ in range(draw.randint(0, 4))), (draw.randint(0, 9),)) for _ in range(6)]
        text = "".join(draw.choice("abc") for _ in range(draw.randint(0, 12)))
        want = min((key for word, key in words if word and word in text), default=None)
        assert WordAutomaton(words).least(text) == want


@pytest.mark.parametrize("block", [2, 100000])
def test_slugs_with_last_names_inside(spark, block):
    draw = random.Random(6)
    names = [(draw.randint(1, 2), draw.choice(["driver", "result"]), rank, draw.choice([None, f"C{rank}"]),
              "Max " + "".join(draw.choice("abÄ") for _ in range(draw.randint(0, 3)))) for rank in range(40)]
    asked = [(race, f"{race}_{n}", "".join(draw.choice("abä") for _ in range(draw.randint(0, 8))), "")
             for race in (1, 2, 3) for n in range(25)]
    found = identity._slug_matches(
        spark.createDataFrame(asked, "session_key int, driver_id string, slug string, raw string"),
        spark.createDataFrame(names, "session_key int, kind string, rank int, code string, full_name string"), block)
    want = set()
    for race, driver, slug, _ in asked:
        def first(kind):
            return min(((rank, code) for r, k, rank, code, name in names if r == race and k == kind and slug and (
                name.split()[-1].lower() in slug or name.lower().replace(" ", "") == slug)), default=None)
        if first("driver") or first("result"):
            want.add((race, driver, first("driver"), first("result")))
    got = {(r["session_key"], r["driver_id"], r["driver"] and (r["driver"]["rank"], r["driver"]["code"]),
            r["result"] and (r["result"]["rank"], r["result"]["code"])) for r in found.collect()}
    assert got == want


def test_driver_dimension_precedence(spark, rows):
    entries = spark.createDataFrame(
        [(1, 1, "VER", "Max Verstappen", "Red Bull", 1), (1, 2, "OLD", "Old Name", "Haas", 2),
         (1, 3, "RES", "Only Result", "Ferrari", 3)], ENTRIES)
    pairs = "session_key int, driver_number int, driver_code string"
    fastest = spark.createDataFrame([(1, 1, "VER"), (1, 2, "NEW")], pairs)
    positions = spark.createDataFrame([(1, 2, "POS"), (1, 4, "PST")], pairs)
    none = spark.createDataFrame([], pairs)
    roster = spark.createDataFrame([(9, "NEW", "New Name", "")], ROSTER)
    found = identity.driver_dimension(entries, fastest, positions, none, roster)
    assert rows(found, "race_number", "code", "full_name", "team", "color") == [
        (1, "VER", "Max Verstappen", "Red Bull", "#1E2248"), (2, "NEW", "New Name", "Haas", "#F2F2F2"),
        (3, "RES", "Only Result", "Ferrari", "#E8002D"), (4, "PST", "PST", "", "#888888")]


def test_sessions_with_data_probes_five_per_year(spark):
    sessions = spark.createDataFrame(
        [(k, 2024, f"2024-01-{k:02d}") for k in range(1, 8)] + [(20, 2023, "2023-05-01")],
        "session_key int, year int, date_start string")
    laps = spark.createDataFrame([(1, 1), (4, 1), (4, 1), (5, 2), (20, 1)], "session_key int, lap_number int")
    found = [r["session_key"] for r in catalogue.sessions_with_data(sessions, laps).collect()]
    assert found == [4, 20]


@pytest.mark.parametrize("flag, left, note", [
    (True, 0.04, "pit flag active, ~0.0 laps window"), (False, 999.0, "no pit flag, tyres look ok for now"),
    (False, 2.25, "no pit flag, estimated 2.3 laps left on this set")])
def test_pit_notes(spark, flag, left, note):
    assert spark.range(1).select(text.pit_note(F.lit(left), F.lit(flag))).first()[0] == note


def test_lap_sentence_defaults(spark):
    df = spark.createDataFrame(
        [(2024, 1, 44, 7, 91.2345, None, None, float("nan"), None, None, None, None)],
        "season int, round_number int, driver_number int, lap_number int, lap_duration double, tyre_compound string, "
        "tyre_age_laps int, rolling_avg_lap_time double, lap_delta double, tyre_degradation_rate double, "
        "stint_length long, should_pit_soon boolean")
    row = text.lap_documents(df).first()
    assert row["id"] == "2024_r1_d44_l7" and row["circuit"] == "unknown"
    assert row["document"] == (
        "Driver 44 in 2024 Round 1: Lap 7, lap time 91.235s on unknown tyres (age 0 laps). "
        "Rolling avg 0.000s, delta to personal best +0.000s. Tyre degradation rate 0.0000s/lap. "
        "Stint length 0 laps. Strategy assessment: pit not needed yet.")


def test_pivot_lists_its_columns(spark):
    data = RaceData(spark, SMALL)
    table = race.lap_pivot(data.valid, race.first_drivers(data.valid, 2), race.lap_time_value(), [1, 2])
    assert table.columns == ["session_key", "lap_number", "1", "2"]


def test_hot_copies_of_a_stop_are_combined_before_the_shuffle(spark):
    plan = pits.clean_stops(RaceData(spark, SMALL).raw_pits)._jdf.queryExecution().executedPlan().toString()
    last = plan.index("Exchange hashpartitioning(session_key")
    assert "partial_min_by" in plan[last:]
