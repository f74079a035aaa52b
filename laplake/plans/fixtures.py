"""Race tables derived from the given tables, for the registered queries.

Every frame covers whole tables and grows with them. ``laplake.plans.oracle``
defines the same tables in SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laplake.operators.features import lap_features, valid_laps
from laplake.operators.groups import LIMITS, HotGroups, Limits, lookup, numbered
from laplake.operators.race import DRIVER

HALF = "2024-01-16 00:00:00"
PAGE_ROWS = 100

# Names given to the derived teams, countries and compounds.
TEAMS = ["Red Bull Racing", "Scuderia Ferrari", "McLaren F1 Team", "Racing Bulls",
         "Kick Sauber", "RB Honda", "Turbo Works", "Unknown Garage"]
COUNTRIES = ["Italy", "Japan", "Monaco", "Atlantis", "Saudi Arabia", "Great Britain"]
GIVEN = ["José", "Zoë", "Max"]


def _pick(index, values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


# Column types of the given tables; a declared schema needs no look into the files.
SCHEMAS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}


class RaceData:
    """Derived frames of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, limits: Limits = LIMITS):
        self.spark = spark
        self.sf_dir = sf_dir
        self.limits = limits

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def timed_events(self) -> DataFrame:
        return self.table("events").select(
            F.when(F.col("ts") < F.expr(f"TIMESTAMP_NTZ '{HALF}'"), 1).otherwise(2).alias("session_key"),
            F.col("user_id").cast("int").alias("driver_number"),
            "ts", "event_id", "event_type", "value",
        )

    @cached_property
    def _hot(self) -> tuple[HotGroups, HotGroups]:
        return HotGroups.measure_levels(self.timed_events, ["session_key"], ["driver_number"], self.limits)

    @property
    def hot_drivers(self) -> HotGroups:
        return self._hot[0]

    @property
    def hot_sessions(self) -> HotGroups:
        """Sessions with more drivers than one task should rank."""
        return self._hot[1]

    @cached_property
    def laps(self) -> DataFrame:
        events = numbered(self.timed_events, DRIVER, ["ts", "event_id"], "lap_number",
                          hot=self.hot_drivers, limits=self.limits)
        wheel = (F.col("lap_number") + F.col("driver_number")) % 17
        compound = (
            F.when(F.col("event_type") == "click", "SOFT").when(F.col("event_type") == "view", "MEDIUM")
            .when(F.col("event_type") == "purchase", "HARD")
            .when(F.col("event_type") == "signup", "INTERMEDIATE")
        )
        return events.select(
            "session_key", "driver_number", "lap_number",
            F.when(F.col("event_id") % 97 != 0, 55.0 + F.col("value")).alias("lap_duration"),
            compound.alias("tyre_compound"),
            F.when(F.col("event_id") % 53 != 0, wheel + 1).cast("int").alias("tyre_age_laps"),
            (wheel == 0).alias("is_pit_out_lap"), (wheel == 16).alias("is_pit_in_lap"),
            "ts", "event_id", "value",
        )

    @cached_property
    def valid(self) -> DataFrame:
        return valid_laps(self.laps)

    @cached_property
    def features(self) -> DataFrame:
        return lap_features(self.laps, hot=self.hot_drivers, limits=self.limits)

    @cached_property
    def race_features(self) -> DataFrame:
        """Features with a season and a round, one race per session."""
        return self.features.withColumns({"season": F.lit(2024), "round_number": F.col("session_key")})

    @cached_property
    def people(self) -> DataFrame:
        key = F.col("c_custkey")
        family = F.concat(F.lit("Müller"), key.cast("string"))
        given = _pick(key % 3, GIVEN)
        return self.table("customer").select(
            key.cast("int").alias("driver_number"),
            F.concat(F.lit("D"), F.lpad(key.cast("string"), 8, "0")).alias("code"),
            given.alias("given"), family.alias("family"),
            F.concat_ws(" ", given, family).alias("full_name"),
            _pick(F.col("c_nationkey") % 8, TEAMS).alias("team"),
            F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("nationality"),
        )

    @cached_property
    def roster(self) -> DataFrame:
        return self.people.where("driver_number % 10 <> 9")

    @cached_property
    def results(self) -> DataFrame:
        key = F.col("o_orderkey")
        race = F.floor(key / 20)
        orders = self.table("orders").select(
            (1950 + race % 75).cast("int").alias("season"),
            (F.floor(race / 75) + 1).cast("int").alias("round_number"),
            race.alias("race_no"),
            F.col("o_custkey").cast("int").alias("driver_number"), "o_orderkey",
            F.nullif(key % 21, F.lit(0)).cast("int").alias("grid_position"),
            (key % 20 + 1).cast("int").alias("finish_position"),
            F.when(key % 13 == 0, "Did Not Start").when(key % 13 == 1, "Unknown")
            .when(key % 13 == 2, "2 Laps").when(F.col("o_orderstatus") == "F", "Finished")
            .when(F.col("o_orderstatus") == "O", "+1 Lap").otherwise("Engine").alias("status"),
            F.when(key % 7 == 0, 25.0).when(key % 7 == 1, 18.0).otherwise(0.0).alias("points"),
            (key % 70).cast("int").alias("laps_completed"),
            F.when(key % 4 != 0, F.concat(F.lit("1:"), (key % 50 + 10).cast("string"), F.lit(".5")))
            .alias("fastest_lap_time"),
            F.when(key % 4 != 0, key % 20 + 1).cast("int").alias("fastest_lap_rank"),
            F.when(key % 3 == 0, F.concat(F.lit("+"), (key % 90).cast("string"), F.lit("s")))
            .alias("gap"),
        )
        return orders.withColumns({
            "race_name": F.concat(F.lit("Circuit "), (F.col("race_no") % 24).cast("string"), F.lit(" Grand Prix")),
            "circuit_id": F.concat(F.lit("circuit_"), (F.col("race_no") % 24).cast("string")),
            "country": _pick(F.col("race_no") % 6, COUNTRIES),
            "race_date": F.make_date(
                "season", F.col("round_number") % 12 + 1, F.col("round_number") % 28 + 1).cast("string"),
            "driver_id": F.concat(F.lit("driver_"), F.col("driver_number").cast("string")),
            "constructor_id": F.concat(F.lit("team_"), (F.col("driver_number") % 8).cast("string")),
        })

    @cached_property
    def races(self) -> DataFrame:
        return self.results.select(
            "season", "round_number", "race_no", "race_name", "circuit_id", "country", "race_date").distinct()

    @cached_property
    def race_pages(self) -> DataFrame:
        """Landed result pages of at most 100 rows each."""
        text = {name: F.col(name).cast("string") for name in
                ("season", "round_number", "driver_number", "grid_position", "finish_position",
                 "points", "laps_completed", "fastest_lap_rank")}
        people = self.people.select("driver_number", "given", "family", "code")
        joined = lookup(self.results, people, ["driver_number"])
        result = F.struct(
            text["driver_number"].alias("number"), text["finish_position"].alias("position"),
            F.coalesce(text["grid_position"], F.lit("0")).alias("grid"), text["points"].alias("points"),
            text["laps_completed"].alias("laps"), F.col("status"),
            F.struct("driver_id", "code", "given", "family").alias("Driver"),
            F.struct(F.col("constructor_id").alias("constructorId"),
                     _pick(F.col("driver_number") % 8, TEAMS).alias("name")).alias("Constructor"),
            F.when(F.col("gap").isNotNull(), F.struct(F.col("gap").alias("time"))).alias("Time"),
            F.when(F.col("fastest_lap_time").isNotNull(), F.struct(
                text["fastest_lap_rank"].alias("rank"),
                F.struct(F.col("fastest_lap_time").alias("time")).alias("Time"))).alias("FastestLap"),
        )
        driver = F.struct(
            F.col("driver_id").alias("driverId"), F.col("code"),
            F.col("given").alias("givenName"), F.col("family").alias("familyName"))
        result = result.withField("Driver", driver)
        page = F.floor((F.col("finish_position") - 1) / PAGE_ROWS)
        paged = joined.groupBy(
            "season", "round_number", "race_name", "circuit_id", "country", "race_date", page.alias("page"),
        ).agg(F.collect_list(result).alias("rows"))
        race = F.struct(
            F.col("season").cast("string").alias("season"), F.col("round_number").cast("string").alias("round"),
            F.col("race_name").alias("raceName"), F.col("race_date").alias("date"),
            F.struct(
                F.col("circuit_id").alias("circuitId"), F.upper("circuit_id").alias("circuitName"),
                F.struct(F.col("country"), F.concat(F.col("country"), F.lit(" City")).alias("locality"))
                .alias("Location")).alias("Circuit"),
            F.col("rows").alias("Results"),
        )
        body = F.struct(F.struct(F.struct(
            F.col("season").cast("string").alias("season"), F.array(race).alias("Races"),
        ).alias("RaceTable")).alias("MRData"))
        return paged.select(F.to_json(body).alias("body"))

    @cached_property
    def driver_pages(self) -> DataFrame:
        """Landed driver pages; one driver in ten has neither code nor number."""
        known = F.col("driver_number") % 10 != 9
        driver = F.struct(
            F.when(known, F.col("driver_number").cast("string")).alias("permanentNumber"),
            F.when(known, F.col("code")).alias("code"),
            F.col("given").alias("givenName"), F.col("family").alias("familyName"),
            F.when(F.col("driver_number") % 4 != 0, F.col("nationality")).alias("nationality"))
        paged = self.people.groupBy(F.floor(F.col("driver_number") / PAGE_ROWS).alias("page")).agg(
            F.collect_list(driver).alias("rows"))
        return paged.select(F.to_json(F.struct(F.struct(F.struct(
            F.lit("2024").alias("season"), F.col("rows").alias("Drivers")).alias("DriverTable"),
        ).alias("MRData"))).alias("body"))

    @cached_property
    def standings_pages(self) -> DataFrame:
        """Landed standings pages; some drivers are absent, some have no team."""
        placed = self.people.where("driver_number % 7 <> 3 AND driver_number % 10 <> 9")
        teams = F.when(F.col("driver_number") % 11 != 0, F.array(F.struct(F.col("team").alias("name"))))
        entry = F.struct(
            F.struct(F.col("code")).alias("Driver"),
            F.coalesce(teams, F.from_json(F.lit("[]"), "array<struct<name:string>>")).alias("Constructors"))
        paged = placed.groupBy(F.floor(F.col("driver_number") / PAGE_ROWS).alias("page")).agg(
            F.collect_list(entry).alias("rows"))
        return paged.select(F.to_json(F.struct(F.struct(F.struct(
            F.lit("2024").alias("season"),
            F.array(F.struct(F.col("rows").alias("DriverStandings"))).alias("StandingsLists"),
        ).alias("StandingsTable")).alias("MRData"))).alias("body"))

    @cached_property
    def sessions(self) -> DataFrame:
        return self.timed_events.select("session_key").distinct()

    @cached_property
    def race_status(self) -> DataFrame:
        """One status per rostered driver and session."""
        turn = F.col("driver_number") % 5
        return self.roster.select(
            F.explode(F.array(F.lit(1), F.lit(2))).alias("session_key"), "driver_number", "code", "full_name",
            "team",
            F.when(turn == 0, "Did Not Start").when(turn == 1, "Finished").when(turn == 2, "+1 Lap")
            .when(turn == 3, "Gearbox").otherwise("Unknown").alias("status"),
            (F.col("driver_number") + 1).alias("finish_position"),
            F.col("driver_number").alias("entry_order"),
        )

    @cached_property
    def positions(self) -> DataFrame:
        return self.laps.select(
            "session_key", "driver_number", "lap_number",
            F.when(F.col("event_id") % 41 != 0, F.floor("value").cast("int") % 20 + 1).alias("position"),
            "ts", "event_id")

    @cached_property
    def track_status(self) -> DataFrame:
        kind = F.col("event_type")
        return self.timed_events.select(
            "session_key", "ts", "event_id",
            F.when(kind == "click", "1").when(kind == "view", "2").when(kind == "purchase", "4")
            .when(kind == "signup", "5").otherwise("9").alias("code"))

    @cached_property
    def timed_laps(self) -> DataFrame:
        lap = F.col("lap_number")
        return self.laps.select(
            "session_key", "driver_number", "lap_number", "tyre_compound", "event_id",
            F.when(F.col("is_pit_in_lap"), lap * 100.0).alias("pit_in_s"),
            F.when(F.col("is_pit_out_lap") & (F.col("event_id") % 7 != 0),
                   (lap - 1) * 100.0 + F.col("value")).alias("pit_out_s"))

    @cached_property
    def pit_pages(self) -> DataFrame:
        """Landed pit-stop pages, a few drivers each; the provider lacks the last session."""
        last = self.timed_events.agg(F.max("session_key")).first()[0]
        stops = self.raw_pits.where(F.col("session_key") != last)
        row = F.struct(
            F.col("copy_no"), F.col("driver_id").alias("driverId"), "stop", "lap", "duration")
        paged = stops.groupBy("session_key", F.floor(F.col("driver_number") / 5).alias("page")).agg(
            F.transform(F.sort_array(F.collect_list(row)), lambda r: r.dropFields("copy_no")).alias("rows"))
        race = F.struct(
            F.lit("2024").alias("season"), F.col("session_key").cast("string").alias("round"), F.col("rows").alias("PitStops"))
        body = F.struct(F.struct(F.struct(
            F.lit("2024").alias("season"), F.array(race).alias("Races")).alias("RaceTable")).alias("MRData"))
        return paged.select(F.to_json(body).alias("body"))

    @cached_property
    def raw_pits(self) -> DataFrame:
        """Text-typed stops; some are sent twice, some durations do not parse."""
        stops = numbered(self.laps.where("is_pit_in_lap"), DRIVER, ["lap_number"], "stop_no",
                         hot=self.hot_drivers, limits=self.limits)
        copies = F.when(F.col("event_id") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
        number = F.col("driver_number").cast("string")
        slug = (
            F.when(F.col("driver_number") % 5 == 0, F.concat(_pick(F.col("driver_number") % 3, ["jose", "zoe", "max"]),
                                                             F.lit("_muller"), number))
            .when(F.col("driver_number") % 5 == 1, F.concat(F.lit("muller"), number))
            .when(F.col("driver_number") % 5 == 2, F.concat(F.lit("d"), F.lpad(number, 8, "0")))
            .when(F.col("driver_number") % 5 == 3, F.concat(F.lit("old_muller"), number, F.lit("_jr")))
            .otherwise(F.concat(F.lit("nobody_"), number))
        )
        return stops.select(
            "session_key", slug.alias("driver_id"), "driver_number",
            F.col("stop_no").cast("string").alias("stop"),
            F.col("lap_number").cast("string").alias("lap"),
            F.when(F.col("event_id") % 11 == 0, "30:12.345").when(F.col("event_id") % 11 == 1, "")
            .otherwise(F.col("value").cast("string")).alias("duration"),
            F.explode(copies).alias("copy_no"))

    @cached_property
    def vectors(self) -> DataFrame:
        key = F.col("vec_id")
        return self.table("embeddings").select(
            F.concat(F.lit("v"), key.cast("string")).alias("id"), "vec_id", "embedding",
            F.col("label").alias("driver_number"),
            F.when(key % 3 == 0, "SOFT").when(key % 3 == 1, "MEDIUM").otherwise("HARD").alias("tyre_compound"),
            (2023 + key % 2).cast("int").alias("year"),
            F.concat(F.lit("situation "), key.cast("string")).alias("document"))
