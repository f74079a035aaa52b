"""Flatten landed JSON pages of race results, pit stops, calendars and rosters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from laplake import constants as C
from laplake import schemas
from laplake.functions.labels import race_short_name, team_color
from laplake.functions.numbers import double_or, int_or, zero_to_null
from laplake.operators.groups import lookup
from laplake.sources.feeds import season_session_key

UNKNOWN_CODE = "???"


def parse_pages(pages: DataFrame, schema: StructType = schemas.RACE_PAGE, column: str = "body") -> DataFrame:
    """One struct per landed page."""
    return pages.select(F.from_json(F.col(column), schema).alias("page"))


def cached_json(spark: SparkSession, path: str, schema: StructType = schemas.CALENDAR) -> DataFrame:
    """JSON arrays of flat objects, one array per file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def races(pages: DataFrame) -> DataFrame:
    """One row per race and page."""
    table = pages.select(F.col("page.MRData.RaceTable").alias("t"))
    return table.select(
        F.coalesce("t.season", F.lit(None)).alias("_season"), F.explode("t.Races").alias("race"))


def _season() -> Column:
    return F.coalesce(F.col("_season"), F.col("race.season")).try_cast("int")


def _text(path: str, default: str = "") -> Column:
    return F.coalesce(F.col(path), F.lit(default))


def _full_name(driver: str) -> Column:
    return F.concat_ws(" ", F.col(f"{driver}.givenName"), F.col(f"{driver}.familyName"))


def season_results(pages: DataFrame) -> DataFrame:
    """One row per driver and race, over every landed page."""
    rows = races(pages).select("*", F.explode("race.Results").alias("r"))
    return rows.select(
        _season().alias("season"),
        int_or(F.col("race.round"), 0).alias("round_number"),
        _text("race.raceName").alias("race_name"),
        _text("race.Circuit.circuitId").alias("circuit_id"),
        _text("r.Driver.driverId").alias("driver_id"),
        _text("r.Constructor.constructorId").alias("constructor_id"),
        zero_to_null(int_or(F.col("r.grid"))).alias("grid_position"),
        int_or(F.col("r.position")).alias("finish_position"),
        double_or(F.col("r.points"), 0.0).alias("points"),
        _text("r.status", "Unknown").alias("status"),
        F.col("r.FastestLap.Time.time").alias("fastest_lap_time"),
        F.lit("jolpica").alias("source"),
    )


def driver_career(results: DataFrame, driver_id: str | None = None,
                  seasons: Sequence[int] = C.CAREER_SEASONS) -> DataFrame:
    """Results of the given seasons, of one driver or of every driver."""
    rows = results.where(F.col("season").isin(*seasons))
    if driver_id is not None:
        rows = rows.where(F.col("driver_id") == driver_id)
    return rows.withColumn("fastest_lap_time", F.lit(None).cast("string"))


def circuit_history(results: DataFrame, circuit_id: str | None = None,
                    seasons: Sequence[int] = C.CIRCUIT_SEASONS) -> DataFrame:
    """Results of the given seasons, at one circuit or at every circuit."""
    rows = results.where(F.col("season").isin(*seasons))
    if circuit_id is not None:
        rows = rows.where(F.col("circuit_id") == circuit_id)
    return rows.withColumn("fastest_lap_time", F.lit(None).cast("string"))


def classification(pages: DataFrame) -> DataFrame:
    """The classified results of every race, with names and colours."""
    rows = races(pages).select("*", F.explode("race.Results").alias("r"))
    number = F.coalesce(F.col("r.number"), F.col("r.Driver.permanentNumber"))
    return rows.select(
        _season().alias("season"),
        int_or(F.col("race.round"), 0).alias("round_number"),
        int_or(number, 0).alias("driver_number"),
        _text("r.Driver.code", UNKNOWN_CODE).alias("abbreviation"),
        _full_name("r.Driver").alias("full_name"),
        F.col("r.Constructor.name").alias("team"),
        team_color("r.Constructor.name").alias("team_color"),
        zero_to_null(int_or(F.col("r.grid"), 0)).alias("grid_position"),
        zero_to_null(int_or(F.col("r.position"), 0)).alias("finish_position"),
        _text("r.status", "Unknown").alias("status"),
        double_or(F.col("r.points"), 0.0).alias("points"),
        int_or(F.col("r.laps"), 0).alias("laps_completed"),
        _text("r.Time.time").alias("time"),
        _text("r.FastestLap.Time.time").alias("fastest_lap_time"),
        F.when(F.col("r.FastestLap").isNotNull(), int_or(F.col("r.FastestLap.rank"), 0))
        .alias("fastest_lap_rank"),
    )


def calendar(pages: DataFrame) -> DataFrame:
    """One row per race of a season, from every landed page."""
    return races(pages).select(
        _season().alias("season"),
        int_or(F.col("race.round")).alias("round"),
        race_short_name("race.raceName").alias("name"),
        F.col("race.raceName").alias("full_name"),
        F.col("race.Circuit.circuitName").alias("circuit"),
        F.col("race.Circuit.Location.country").alias("country"),
        F.col("race.Circuit.Location.locality").alias("locality"),
        _text("race.date").alias("date"),
    ).distinct()


def pit_feed(pages: DataFrame) -> DataFrame:
    """Raw pit stops, text typed, one row per entry in the order of the page."""
    rows = races(pages).select("*", F.posexplode("race.PitStops").alias("_at", "p"))
    season, number = _season(), int_or(F.col("race.round"), 0)
    return rows.select(
        season.alias("season"), number.alias("round_number"),
        season_session_key(season, number).alias("session_key"), F.col("_at").alias("copy_no"),
        F.col("p.driverId").alias("driver_id"),
        F.col("p.stop").alias("stop"),
        F.col("p.lap").alias("lap"),
        F.col("p.time").alias("time_of_day"),
        F.col("p.duration").alias("duration"),
    )


def season_drivers(pages: DataFrame) -> DataFrame:
    """One row per driver of a season."""
    table = pages.select(F.col("page.MRData.DriverTable").alias("t"))
    rows = table.select(F.col("t.season").alias("season"), F.explode("t.Drivers").alias("d"))
    return rows.select(
        F.col("season").try_cast("int").alias("season"),
        int_or(F.col("d.permanentNumber"), 0).alias("driver_number"),
        _text("d.code", UNKNOWN_CODE).alias("code"),
        _full_name("d").alias("full_name"),
        _text("d.nationality").alias("nationality"),
    )


def standings_teams(pages: DataFrame) -> DataFrame:
    """Team of every driver code in a season's first standings list."""
    table = pages.select(F.col("page.MRData.StandingsTable").alias("t"))
    first = table.select(
        F.col("t.season").try_cast("int").alias("season"),
        F.try_element_at(F.col("t.StandingsLists"), F.lit(1)).alias("s"))
    rows = first.select("season", F.posexplode("s.DriverStandings").alias("at", "e"))
    team = F.coalesce(F.try_element_at(F.col("e.Constructors"), F.lit(1))["name"], F.lit("Unknown"))
    # The last entry of a code wins; the team text breaks ties between pages.
    return (
        rows.select("season", F.col("e.Driver.code").alias("code"), "at", team.alias("team"))
        .where(F.col("code").isNotNull() & (F.col("code") != UNKNOWN_CODE))
        .groupBy("season", "code").agg(F.max_by("team", F.struct("at", "team")).alias("team"))
    )


def roster(drivers: DataFrame, teams: DataFrame) -> DataFrame:
    """Drivers with team and colour; codes without a standing are Unknown."""
    joined = lookup(drivers, teams, ["season", "code"])
    team = F.coalesce(F.col("team"), F.lit("Unknown"))
    return joined.select(
        "season", "driver_number", "code", "full_name", team.alias("team"),
        team_color(team).alias("color"), "nationality",
    )
