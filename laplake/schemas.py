"""Column types of every entity, the same for batch and stream.

Measurements are doubles, so a value survives a JSON round trip unchanged.
"""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)


def _struct(**columns) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns.items()])


INT, DBL, STR, BOOL = IntegerType(), DoubleType(), StringType(), BooleanType()

LAP = _struct(
    session_key=INT, driver_number=INT, lap_number=INT, lap_duration=DBL,
    sector_1_time=DBL, sector_2_time=DBL, sector_3_time=DBL,
    tyre_compound=STR, tyre_age_laps=INT, is_pit_out_lap=BOOL, is_pit_in_lap=BOOL,
    timestamp=STR, source=STR,
)

PIT_STOP = _struct(
    session_key=INT, driver_number=INT, lap_number=INT, pit_duration=DBL,
    tyre_compound_new=STR, timestamp=STR, source=STR,
)

POSITION = _struct(
    session_key=INT, driver_number=INT, position=INT, gap_to_leader=DBL,
    interval=DBL, timestamp=STR, source=STR,
)

DRIVER = _struct(
    driver_number=INT, full_name=STR, abbreviation=STR, team_name=STR,
    team_colour=STR, headshot_url=STR, country_code=STR, source=STR,
)

SESSION = _struct(
    session_key=INT, session_name=STR, session_type=STR, year=INT,
    circuit_short_name=STR, circuit_key=INT, country_name=STR,
    date_start=STR, gmt_offset=STR, source=STR,
)

CALENDAR = _struct(
    round=INT, name=STR, full_name=STR, circuit=STR, country=STR, locality=STR, date=STR,
)

ROSTER = _struct(
    driver_number=INT, code=STR, full_name=STR, team=STR, color=STR, nationality=STR,
)

# Landed provider pages; every number in them is text.
_DRIVER_JSON = _struct(
    driverId=STR, permanentNumber=STR, code=STR, givenName=STR, familyName=STR, nationality=STR,
)
_CONSTRUCTOR_JSON = _struct(constructorId=STR, name=STR)
_RESULT_JSON = _struct(
    number=STR, position=STR, grid=STR, points=STR, laps=STR, status=STR,
    Driver=_DRIVER_JSON, Constructor=_CONSTRUCTOR_JSON,
    Time=_struct(time=STR),
    FastestLap=_struct(rank=STR, Time=_struct(time=STR)),
)
_PIT_JSON = _struct(driverId=STR, stop=STR, lap=STR, time=STR, duration=STR)
_CIRCUIT_JSON = _struct(
    circuitId=STR, circuitName=STR, Location=_struct(country=STR, locality=STR),
)
_RACE_JSON = _struct(
    season=STR, round=STR, raceName=STR, date=STR, Circuit=_CIRCUIT_JSON,
    Results=ArrayType(_RESULT_JSON), PitStops=ArrayType(_PIT_JSON),
)
_STANDING_JSON = _struct(Driver=_DRIVER_JSON, Constructors=ArrayType(_CONSTRUCTOR_JSON))

RACE_PAGE = _struct(
    MRData=_struct(RaceTable=_struct(season=STR, Races=ArrayType(_RACE_JSON))),
)
DRIVER_PAGE = _struct(
    MRData=_struct(DriverTable=_struct(season=STR, Drivers=ArrayType(_DRIVER_JSON))),
)
STANDINGS_PAGE = _struct(
    MRData=_struct(
        StandingsTable=_struct(
            season=STR,
            StandingsLists=ArrayType(_struct(DriverStandings=ArrayType(_STANDING_JSON))),
        ),
    ),
)
