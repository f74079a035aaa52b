"""Who a driver is: slugs, codes, numbers and names from several sources."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from laplake.constants import DISPLAY_TEAM_COLORS
from laplake.functions.automaton import WordAutomaton
from laplake.functions.labels import team_color
from laplake.functions.names import first_word, fold_name, last_word, without
from laplake.operators.groups import lookup

RACE = "session_key"
SLUG_BLOCK = 100_000  # slugs, or last names, of one race that meet in a task


def _aliases(entries: DataFrame) -> DataFrame:
    """One row per (race, form, alias): the first entry that has the alias.

    ``form`` tells which form of the driver id may match: without underscores
    ("joined") or as it is ("raw").
    """
    folded = entries.select(
        RACE, "entry_order", "code",
        fold_name("full_name").alias("_full"), fold_name("code").alias("_code"))
    first, last = first_word(F.col("_full")), last_word(F.col("_full"))

    def alias(form, value):
        return F.struct(F.lit(form).alias("form"), value.alias("alias"))

    options = F.array(
        alias("joined", without(F.col("_full"), " ")),
        alias("joined", F.concat(first, last)),
        alias("joined", last),
        alias("raw", last),
        alias("raw", F.col("_code")),
    )
    rows = folded.select(RACE, "entry_order", "code", F.explode(options).alias("o"))
    return rows.groupBy(RACE, "o.form", "o.alias").agg(
        F.min(F.struct("entry_order", "code")).alias("entry"))


def resolve_ids(ids: DataFrame, entries: DataFrame) -> DataFrame:
    """Driver code of every (race, driver_id); the first matching entry wins.

    The five-way OR of the matching rules becomes one equi-join on aliases. Both
    sides are reduced to distinct keys first, so no pair of rows is formed that
    is not a match.
    """
    distinct = ids.select(RACE, "driver_id").where(F.col("driver_id") != "").distinct()
    folded = distinct.withColumn("_id", fold_name("driver_id"))
    forms = F.array(
        F.struct(F.lit("joined").alias("form"), without(F.col("_id"), "_").alias("alias")),
        F.struct(F.lit("raw").alias("form"), F.col("_id").alias("alias")),
    )
    asked = folded.select(RACE, "driver_id", F.explode(forms).alias("q")).select(
        RACE, "driver_id", "q.form", "q.alias")
    matched = asked.join(_aliases(entries), [RACE, "form", "alias"])
    return matched.groupBy(RACE, "driver_id").agg(F.min("entry").alias("e")).select(
        RACE, "driver_id", F.col("e.code").alias("driver_code"))


def identify_stops(stops: DataFrame, entries: DataFrame) -> DataFrame:
    """Add code and number to pit stops; unknown ids get a blank code and number 0."""
    codes = resolve_ids(stops, entries)
    numbers = entries.groupBy(RACE, "code").agg(
        F.min_by("driver_number", "entry_order").alias("driver_number"))
    known = codes.join(numbers.withColumnRenamed("code", "driver_code"), [RACE, "driver_code"], "left")
    bare = stops.drop("driver_number", "driver_code")
    return lookup(bare, known, [RACE, "driver_id"]).withColumns({
        "driver_code": F.coalesce("driver_code", F.lit("")),
        "driver_number": F.coalesce("driver_number", F.lit(0)),
    })


def driver_dimension(results: DataFrame, fastest: DataFrame, positions: DataFrame,
                     strategies: DataFrame, roster: DataFrame) -> DataFrame:
    """One row per race and car number, merged from four sources.

    The code of a number comes from the fastest laps, else the positions, else
    the strategies, else the results. Name and team come from the results by
    code, else the roster by code, else the results by number.
    """
    pairs = reduce(lambda a, b: a.unionByName(b), [
        source.select(RACE, "driver_number", "driver_code", F.lit(rank).alias("rank"))
        for rank, source in enumerate((fastest, positions, strategies))
    ])
    codes = pairs.groupBy(RACE, "driver_number").agg(
        F.min_by("driver_code", F.struct("rank", "driver_code")).alias("pair_code"))
    entry = F.struct("code", "full_name", "team")
    by_number = results.where(F.col("driver_number") != 0).groupBy(RACE, "driver_number").agg(
        F.max_by(entry, "entry_order").alias("n"))
    by_code = results.groupBy(RACE, F.col("code").alias("final_code")).agg(
        F.max_by(entry, "entry_order").alias("c"))
    known = roster.groupBy(F.col("code").alias("final_code")).agg(
        F.min(F.struct("full_name", "team")).alias("r"))
    coded = codes.join(by_number, [RACE, "driver_number"], "full").withColumn(
        "final_code", F.coalesce("pair_code", "n.code"))
    merged = lookup(
        lookup(coded, by_code, [RACE, "final_code"]),
        known, ["final_code"])

    def first_text(name, *last):
        sources = [F.nullif(F.col(f"{part}.{name}"), F.lit("")) for part in ("c", "r", "n")]
        return F.coalesce(*sources, *last)

    seeded = F.col("pair_code").isNull()
    team = F.when(seeded, F.col("n.team")).otherwise(first_text("team", F.lit("")))
    name = F.when(seeded, F.col("n.full_name")).otherwise(first_text("full_name", F.col("final_code")))
    return merged.select(
        RACE, F.col("driver_number").alias("race_number"), F.col("final_code").alias("code"),
        name.alias("full_name"), team.alias("team"),
    ).withColumn("color", team_color("team", DISPLAY_TEAM_COLORS))


def results_with_driver(results: DataFrame, dimension: DataFrame) -> DataFrame:
    """Attach the dimension row to results, by code, else by number."""
    row = F.struct("race_number", "code", "full_name", "team", "color")
    codes = dimension.groupBy(RACE, "code").agg(F.min_by(row, "race_number").alias("_by_code"))
    numbers = dimension.groupBy(RACE, F.col("race_number").alias("driver_number")).agg(
        F.min_by(row, "code").alias("_by_number"))
    joined = lookup(lookup(results, codes, [RACE, "code"]),
                    numbers, [RACE, "driver_number"])
    return joined.withColumn("driver", F.coalesce("_by_code", "_by_number")).drop("_by_code", "_by_number")


def _surnames_in(asked: DataFrame, names: DataFrame, block: int) -> DataFrame:
    """(race, driver_id, kind, rank, code): the first driver and result whose last name the slug contains.

    The last names of a race make an automaton, which reads each slug once; a slug gives at
    most one row per kind and task. Races with more than ``block`` slugs or names are cut
    into blocks, and every block of slugs meets every block of names in a task of its own.
    """
    surnames = names.select(RACE, "kind", "rank", "code", F.lower(last_word(F.col("full_name"))).alias("word")).where(
        F.length("word") > 0)
    asked = asked.select(RACE, "driver_id", "slug")
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    sizes = asked.select(RACE, one.alias("slugs"), none.alias("names")).union(
        surnames.select(RACE, none, one)).groupBy(RACE).agg(
        *[F.ceil(F.sum(n) / block).cast("int").alias(f"{n}_blocks") for n in ("slugs", "names")])
    keys = [RACE, "_slugs", "_names"]

    def dealt(frame, value, own, other):
        each = F.col(f"{own}_blocks"), F.col(f"{other}_blocks")
        return lookup(frame, sizes, [RACE]).select(
            *frame.columns, F.pmod(F.xxhash64(value), each[0]).cast("int").alias(f"_{own}"),
            F.explode(F.sequence(F.lit(0), F.greatest(each[1], F.lit(1)) - 1)).alias(f"_{other}"))

    kind = StructType([
        asked.schema[RACE], asked.schema["driver_id"], names.schema["kind"], names.schema["rank"], names.schema["code"]])
    columns = kind.names

    def match(slugs: pa.Table, words: pa.Table) -> pa.Table:
        found = {name: [] for name in columns}
        rows = list(zip(*(words.column(c).to_pylist() for c in ("kind", "word", "rank", "code")), strict=True))
        texts = list(zip(*(slugs.column(c).to_pylist() for c in (RACE, "driver_id", "slug")), strict=True))
        for which in sorted({row[0] for row in rows}):
            # Null codes come first, as in Spark's order.
            automaton = WordAutomaton((word, (rank, code is not None, code or "")) for k, word, rank, code in rows if k == which)
            for race, name, slug in texts:
                if (best := automaton.least(slug)) is not None:
                    row = (race, name, which, best[0], best[2] if best[1] else None)
                    for column, value in zip(columns, row, strict=True):
                        found[column].append(value)
        return pa.table(found, to_arrow_schema(kind))

    left, right = dealt(asked, "driver_id", "slugs", "names"), dealt(surnames, "word", "names", "slugs")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(match, kind)


def _slug_matches(asked: DataFrame, names: DataFrame, block: int = SLUG_BLOCK) -> DataFrame:
    """First driver and first result whose name matches a slug, per (race, driver_id).

    Rules: the slug equals the full name, first plus last name, or the code; or
    it contains the last name. The first three are one equi-join on aliases, to
    which names are reduced before; the last is an automaton of a race's last names.
    """
    asked = asked.where(F.length("slug") > 0)
    forms = F.array(F.struct(F.lit("whole").alias("form"), F.col("slug").alias("alias")),
                    F.struct(F.lit("code").alias("form"), F.col("raw").alias("alias")))
    questions = asked.select(RACE, "driver_id", F.explode(forms).alias("q")).select(RACE, "driver_id", "q.form", "q.alias")
    lowered = F.lower("full_name")
    last, first = F.lower(last_word(F.col("full_name"))), F.lower(first_word(F.col("full_name")))
    options = F.array(*[
        F.struct(F.lit(form).alias("form"), value.alias("alias"))
        for form, value in (
            ("whole", F.regexp_replace(lowered, r"\s", "")), ("whole", F.concat(first, last)), ("code", F.lower("code")))
    ])
    entry = F.struct("rank", "code")

    def firsts(rows, *keys):
        return rows.groupBy(*keys).agg(*[
            F.min(F.when(F.col("kind") == kind, entry)).alias(kind) for kind in ("driver", "result")])

    aliases = names.select(RACE, "kind", "rank", "code", F.explode(options).alias("o")).select(
        "*", "o.form", "o.alias").where(F.length("alias") > 0)
    equal = lookup(questions, firsts(aliases, RACE, "form", "alias"), [RACE, "form", "alias"], "inner")
    inside = firsts(_surnames_in(asked, names, block), RACE, "driver_id")
    both = equal.select(RACE, "driver_id", "driver", "result").union(inside)
    return both.groupBy(RACE, "driver_id").agg(F.min("driver").alias("driver"), F.min("result").alias("result"))


def identity_cascade(stops: DataFrame, dimension: DataFrame, results: DataFrame) -> DataFrame:
    """Resolve pit stops to drivers: code, slug, number, then result names.

    The rules run on the distinct identities of the stops; the stops meet the
    outcome in one join.
    """
    identity = [RACE, "driver_id", "driver_code", "driver_number"]
    asked = stops.select(*identity).distinct().withColumn(
        "code", F.upper(F.nullif("driver_code", F.lit(""))))
    by_code = dimension.groupBy(RACE, "code").agg(F.min("race_number").alias("_by_code"))
    coded = asked.join(by_code, [RACE, "code"], "left")
    ids = (
        coded.where(F.col("_by_code").isNull() & (F.col("driver_id") != ""))
        .select(RACE, "driver_id").distinct()
        .withColumns({"slug": F.lower(without(F.col("driver_id"), "_")), "raw": F.lower("driver_id")})
    )
    names = dimension.select(
        RACE, F.lit("driver").alias("kind"), F.col("race_number").alias("rank"), "code", "full_name",
    ).unionByName(results.select(
        RACE, F.lit("result").alias("kind"), F.col("entry_order").alias("rank"), "code", "full_name"))
    matches = _slug_matches(ids, names).select(
        RACE, "driver_id", F.col("driver.rank").alias("_by_slug"), F.col("result.code").alias("_result_code"))
    by_number = dimension.select(
        RACE, F.col("race_number").alias("driver_number"), F.col("race_number").alias("_by_number")).distinct()
    by_result = by_code.withColumnsRenamed({"code": "_result_code", "_by_code": "_by_result"})
    chosen = F.coalesce("_by_code", "_by_slug", "_by_number", "_by_result", "driver_number")
    found = (
        coded.join(matches, [RACE, "driver_id"], "left")
        .join(by_number, [RACE, "driver_number"], "left")
        .join(by_result, [RACE, "_result_code"], "left")
        .select(*identity, chosen.alias("race_number"))
    )
    return lookup(stops, found, identity)
