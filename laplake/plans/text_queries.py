"""Lap documents, vector search and prompt inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from laplake.operators import catalogue, race, text, vectors
from laplake.operators.groups import lookup
from laplake.operators.vector_index import VectorIndex
from laplake.plans import jobs
from laplake.plans.fixtures import RaceData
from laplake.plans.oracle import r1, r3, r4
from laplake.plans.registry import query
from laplake.session import new_folder, written
from laplake.sinks.tables import VersionedTable

DOCUMENT = f"""printf('Driver %d in 2024 Round %d: Lap %d, lap time %.3fs on %s tyres (age %d laps). Rolling avg %.3fs, delta to personal best +%.3fs. Tyre degradation rate %.4fs/lap. Stint length %d laps. Strategy assessment: %s.',
    driver_number, session_key, lap_number, {r3('lap_duration')}, coalesce(tyre_compound, 'unknown'),
    coalesce(tyre_age_laps, 0), {r3('rolling_avg_lap_time')}, {r3('lap_delta')}, {r4('tyre_degradation_rate')},
    stint_length, CASE WHEN should_pit_soon THEN 'should pit soon' ELSE 'pit not needed yet' END)"""


@query("lap_documents", f"""SELECT printf('2024_r%d_d%d_l%d', session_key, driver_number, lap_number) AS id,
       2024 AS year, session_key AS round_number, driver_number, lap_number,
       coalesce(tyre_compound, 'unknown') AS tyre_compound, coalesce(tyre_age_laps, 0) AS tyre_age_laps,
       should_pit_soon, stint_length, {DOCUMENT} AS document FROM features""")
def _documents(d: RaceData):
    return text.lap_documents(d.race_features).select(
        "id", "year", "round_number", "driver_number", "lap_number", "tyre_compound", "tyre_age_laps",
        "should_pit_soon", "stint_length", "document")


def _scored(source: str = "norms") -> str:
    """Every vector against the mean vector of every driver label."""
    return f"""(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place
        FROM (SELECT q.query_id, v.id, v.year, v.document,
                     round(list_inner_product(v.e, q.qv) / (v.norm * sqrt(list_inner_product(q.qv, q.qv))), 6) + 0.0
                         AS score
              FROM {source} v CROSS JOIN (
                  SELECT query_id, list(x ORDER BY i) AS qv FROM (
                      SELECT CAST(driver_number AS VARCHAR) AS query_id, i, avg(x) AS x
                      FROM (SELECT driver_number, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM norms)
                      GROUP BY driver_number, i) GROUP BY query_id) q))"""


@query("vector_topk", f"""SELECT query_id, id, score, CAST(place AS INT) AS rank FROM {_scored()} WHERE place <= 5""")
def _topk(d: RaceData):
    corpus = d.vectors.select("id", "embedding")
    found = vectors.top_k(corpus, vectors.mean_vectors(d.vectors, "driver_number"), 5)
    return found.select("query_id", "id", "score", "rank")


@query("vector_index", f"""SELECT query_id, id, year, document, score, CAST(place AS INT) AS rank
       FROM {_scored()} WHERE place <= 5""")
def _indexed(d: RaceData):
    """Exact search through inverted lists; lists that cannot hold a better vector are not read."""
    index = VectorIndex.build(d.vectors.select("id", "year", "document", "embedding"), new_folder(d.spark, "lists"))
    found = index.search(vectors.mean_vectors(d.vectors, "driver_number"), 5, exact=True)
    return found.select("query_id", "id", "year", "document", "score", "rank")


@query("vector_topk_filtered", f"""SELECT query_id, id, score, CAST(place AS INT) AS rank
       FROM {_scored("(SELECT * FROM norms WHERE year = 2024 AND tyre_compound = 'SOFT')")} WHERE place <= 3""")
def _topk_filtered(d: RaceData):
    corpus = vectors.filter_vectors(d.vectors, year=2024, driver=0, compound="SOFT")
    found = vectors.top_k(corpus, vectors.mean_vectors(d.vectors, "driver_number"), 3)
    return found.select("query_id", "id", "score", "rank")


@query("vector_range", f"""SELECT query_id, CAST(count(*) AS BIGINT) AS vectors, min(score) AS worst, max(score) AS best
       FROM {_scored()} GROUP BY query_id""")
def _range(d: RaceData):
    return vectors.score_range(d.vectors, vectors.mean_vectors(d.vectors, "driver_number"))


@query("retrieval_context", f"""
    SELECT query_id, concat('Relevant historical F1 situations:', chr(10), chr(10), string_agg(
               concat(place, '. [similarity: ', printf('%.3f', {r3('score')}), '] ', document), chr(10) ORDER BY place))
           AS context
    FROM {_scored()} WHERE place <= 3 GROUP BY query_id""")
def _context(d: RaceData):
    asked = vectors.mean_vectors(d.vectors, "driver_number")
    return vectors.retrieval_context(vectors.top_k(d.vectors, asked, 3), asked)


@query("vector_stats", "SELECT year, count(*) AS vectors FROM vectors GROUP BY year")
def _stats(d: RaceData):
    return vectors.vector_stats(d.vectors)


@query("vector_upsert", """SELECT id, year, tyre_compound,
       CASE WHEN tyre_compound = 'SOFT' THEN concat(document, ' again') ELSE document END AS document,
       CAST(len(embedding) AS INT) AS size FROM vectors""")
def _upsert(d: RaceData):
    table = VersionedTable(d.spark, new_folder(d.spark, "vectors"), ["id"])
    rows = d.vectors.select("id", "year", "tyre_compound", "document", "embedding")
    table.write(rows, 0)
    changed = rows.where("tyre_compound = 'SOFT'").withColumn("document", F.concat("document", F.lit(" again")))
    table.write(changed, 1)
    return table.latest().select("id", "year", "tyre_compound", "document", F.size("embedding").alias("size"))


INDEXED = "123e"


def letter_counts(texts: list[str]) -> list[list[float]]:
    """A deterministic stand-in for an embedding service: how often some characters occur."""
    return [[float(text.count(c)) for c in "123e"] for text in texts]


@query("lap_index", f"""
    SELECT id, year, tyre_compound, document, {", ".join(
        f"CAST(length(document) - length(replace(document, '{c}', '')) AS DOUBLE) AS count_{c}" for c in INDEXED)}
    FROM (SELECT printf('2024_r%d_d%d_l%d', session_key, driver_number, lap_number) AS id, 2024 AS year,
                 coalesce(tyre_compound, 'unknown') AS tyre_compound, {DOCUMENT} AS document
          FROM (SELECT * REPLACE (CASE WHEN driver_number % 2 = 0 THEN 'WET' ELSE tyre_compound END AS tyre_compound)
                FROM features))""")
def _index(d: RaceData):
    """Describe, embed and upsert all laps; then half of the drivers again with another compound."""
    table = VersionedTable(d.spark, new_folder(d.spark, "index"), ["id"])
    jobs.index_races(d.race_features, letter_counts, table)
    corrected = d.race_features.where("driver_number % 2 = 0").withColumn("tyre_compound", F.lit("WET"))
    found = jobs.index_races(corrected, letter_counts, table, merge_every=2)
    counts = [F.col("embedding")[i].cast("double").alias(f"count_{c}") for i, c in enumerate(INDEXED)]
    return found.select("id", "year", "tyre_compound", "document", *counts)


COUNTS = ", ".join(f"CAST(length(t) - length(replace(t, '{c}', '')) AS DOUBLE)" for c in INDEXED)


@query("text_search", f"""
    SELECT query_id, concat('Relevant historical F1 situations:', chr(10), chr(10), string_agg(
               concat(place, '. [similarity: ', printf('%.3f', {r3('score')}), '] ', document), chr(10) ORDER BY place))
           AS context
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place
          FROM (SELECT query_id, id, document, round(list_inner_product(q, v) / (sqrt(list_inner_product(q, q))
                       * sqrt(list_inner_product(v, v))), 6) + 0.0 AS score
                FROM (SELECT query_id, [{COUNTS}] AS q FROM (
                    SELECT printf('%d-%d', session_key, driver_number) AS query_id,
                           printf('%s tyres %d laps degradation rate %.4f circuit %s lap %d', coalesce(tyre_compound, 'UNKNOWN'),
                                  coalesce(tyre_age_laps, 0), {r4('tyre_degradation_rate')}, 'Unknown', lap_number) AS t,
                           row_number() OVER (PARTITION BY session_key, driver_number ORDER BY lap_number DESC) AS back
                    FROM features) WHERE back = 1)
                CROSS JOIN (SELECT id, t AS document, [{COUNTS}] AS v FROM (
                    SELECT printf('2024_r%d_d%d_l%d', session_key, driver_number, lap_number) AS id, {DOCUMENT} AS t
                    FROM features WHERE tyre_compound = 'SOFT'))))
    WHERE place <= 3 GROUP BY query_id""")
def _text_search(d: RaceData):
    """The last lap of every driver as a question to the laps on soft tyres."""
    last = F.max_by(F.struct("*"), "lap_number").alias("lap")
    laps = d.race_features.groupBy("session_key", "driver_number").agg(last).select("lap.*")
    questions = written(laps.select(
        F.format_string("%d-%d", "session_key", "driver_number").alias("query_id"), text.search_text().alias("question")),
        "questions")
    path = new_folder(d.spark, "documents")
    vectors.embed_documents(text.lap_documents(d.race_features), letter_counts).write.parquet(path)
    hits = vectors.search_texts(d.spark.read.parquet(path), questions, letter_counts, compound="SOFT")
    return vectors.retrieval_context(hits, questions)


@query("strategy_prompt", f"""
    SELECT session_key, driver_number, lap_number, last_lap AS total_race_laps, circuit AS circuit_name,
           printf('%s tyres %d laps degradation rate %.4f circuit %s lap %d', c, a, {r4('rate')}, circuit, lap_number)
               AS search_text,
           printf('Lap time: %.3fs, rolling avg: %.3fs, delta to best: +%.3fs', {r3('lap_duration')},
                  {r3('rolling_avg_lap_time')}, {r3('lap_delta')}) AS pace_line,
           printf('Tyres: %s, %d laps old, degrading at %.4fs/lap', c, a, {r4('rate')}) AS tyre_line,
           CASE WHEN should_pit_soon
                THEN concat('pit flag active, ~', printf('%.1f', {r1('e')}), ' laps window')
                WHEN e >= 999 THEN 'no pit flag, tyres look ok for now'
                ELSE concat('no pit flag, estimated ', printf('%.1f', {r1('e')}),
                            ' laps left on this set') END AS pit_note,
           CAST(position AS VARCHAR) AS position,
           CASE WHEN lap_delta = 0 THEN 'unknown' ELSE concat(printf('%.3f', {r3('lap_delta')}), 's') END
               AS gap_to_leader,
           last_lap - lap_number AS laps_remaining
    FROM (SELECT f.*, s.last_lap, p.position, f.tyre_degradation_rate AS rate,
                 coalesce(f.tyre_compound, 'UNKNOWN') AS c, coalesce(f.tyre_age_laps, 0) AS a,
                 f.estimated_laps_to_pit AS e, coalesce(replace(r.race_name, ' Grand Prix', ''), 'Unknown') AS circuit
          FROM features f JOIN session_last s USING (session_key)
          JOIN ranked_positions p USING (session_key, driver_number, lap_number)
          LEFT JOIN races r ON r.season = 2024 AND r.round_number = f.session_key)""")
def _strategy(d: RaceData):
    placed = race.with_positions(d.race_features, d.hot_drivers, d.hot_sessions)
    calendar = d.races.select(
        "season", F.col("round_number").alias("round"),
        F.replace("race_name", F.lit(" Grand Prix"), F.lit("")).alias("name"))
    named = catalogue.circuit_names(race.with_race_laps(placed, d.valid), calendar)
    return text.strategy_inputs(named.withColumn("gap_to_leader", F.col("lap_delta")))


@query("commentary_prompt", f"""
    SELECT session_key, driver_number, lap_number,
           printf('%s (#%d)', coalesce(full_name, printf('Driver %d', driver_number)), driver_number) AS driver,
           printf('%.3f', {r3('lap_duration')}) AS lap_time,
           printf('%s, %d laps old', coalesce(tyre_compound, 'UNKNOWN'), coalesce(tyre_age_laps, 0)) AS tyres,
           CASE WHEN tyre_degradation_rate > 0.01
                THEN concat('degrading at ', printf('%.4f', {r4('tyre_degradation_rate')}), 's/lap')
                ELSE 'minimal degradation, tyres still feeling strong' END AS wear_note,
           CASE WHEN should_pit_soon THEN 'box box box — pit window is open'
                ELSE 'stay out, tyres look okay' END AS pit_note, 'unknown' AS position
    FROM features LEFT JOIN (SELECT driver_number, full_name FROM roster) r USING (driver_number)""")
def _commentary(d: RaceData):
    names = d.roster.select("driver_number", "full_name")
    laps = lookup(d.features, names, ["driver_number"]).withColumn("position", F.lit(None).cast("int"))
    return text.commentary_inputs(laps)
