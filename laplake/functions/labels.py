"""Label expressions over the fixed tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from laplake import constants as C


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def team_color(team: Column | str, palette: dict[str, str] = C.TEAM_COLORS) -> Column:
    """Colour of the first key, in palette order, that the team name contains."""
    lowered = F.lower(_col(team))
    hits = [F.when(lowered.contains(key), F.lit(color)) for key, color in palette.items()]
    return F.coalesce(*hits, F.lit(C.DEFAULT_COLOR))


def _mapped(value: Column, table: dict, default: Column) -> Column:
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.coalesce(F.create_map(*pairs)[value], default)


def flag_code(country: Column | str) -> Column:
    return _mapped(_col(country), C.COUNTRY_CODES, F.lit(C.DEFAULT_FLAG))


def track_status_label(code: Column | str) -> Column:
    column = _col(code)
    return _mapped(column, C.TRACK_STATUS_LABELS, F.concat(F.lit("Status "), column))


def status_label(status: Column | str) -> Column:
    """Display label of a result status; the first rule that holds wins."""
    column = _col(status)
    blank = column.isNull() | column.isin("", "Unknown")
    return (
        F.when(blank, "—")
        .when(column == "Finished", "Finished")
        .when(column.startswith("+"), column)
        .when(column.isin("Did Not Start", "DNS"), "DNS")
        .when(column.contains("Lap"), column)
        .otherwise(F.concat(F.lit("DNF: "), column))
    )


def is_unclassified(label: Column | str) -> Column:
    """Listed as not classified: neither finished, nor lapped with ``+``, nor unknown."""
    column = _col(label)
    return (column != "Finished") & ~column.startswith("+") & (column != "—")


def race_short_name(name: Column | str, suffix: str = "") -> Column:
    return F.replace(_col(name), F.lit(" Grand Prix"), F.lit(suffix))


def driver_surname(number: Column | str) -> Column:
    """Surname of a known car number, else the number as text."""
    column = _col(number)
    return _mapped(column, C.DRIVER_SURNAMES, column.cast("string"))


def or_code_number(code: Column | str, number: Column | str) -> Column:
    """The driver code, or the number as text where no code is known."""
    return F.coalesce(_col(code), _col(number).cast("string"))
