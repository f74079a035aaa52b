"""The registered queries of the training-data operators, and their SQL counterparts."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from laplake.llm.chat import (
    branches,
    format_branches,
    read_loss,
    read_turns,
    turns_as_replies,
)
from laplake.llm.decontaminate import find_contamination
from laplake.llm.exact_dedup import exact_duplicates
from laplake.llm.frames import attach, remainder, staged
from laplake.llm.language import identify_language, train_language
from laplake.llm.lm_score import lm_scores
from laplake.llm.near_dedup import near_duplicates
from laplake.llm.nearest import nearest
from laplake.llm.packing import pack
from laplake.llm.periodic_runs import periodic_runs
from laplake.llm.quality import score_quality, train_quality
from laplake.llm.token_counts import count_tokens
from laplake.llm.token_files import read_token_files, write_token_files
from laplake.llm.va_clusters import centroid_clusters
from laplake.session import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(of: int, fold: int) -> Column:
    """Rows that are scored but not learned from; rows without an id are neither held out nor learned from."""
    return F.coalesce(remainder("doc_id", of) == fold, F.lit(False))


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(documents, table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return found.select(
        "doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"),
        (c["n_hit"] > 0).alias("contaminated"))


ORACLES["op1_decontamination"] = r"""
WITH words AS (
    SELECT doc_id, list_filter(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
    FROM documents),
items AS (
    SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
    FROM benchmark),
item_windows AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
    SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, d.n, item_id FROM doc_windows d JOIN item_windows b ON d.n = b.n AND d.g = b.g),
hit_words AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
    FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.names, '')) AS items_sha256,
    coalesce(h.n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items i USING (doc_id)
"""


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    read = read_token_files(spark, path)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def _train_language(documents: DataFrame):
    return train_language(documents.where(remainder("doc_id", 3) != 1))


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = identify_language(documents.select("doc_id", "text"), _train_language(documents))
    return found.select("doc_id", _held_out(3, 1).alias("held_out"), "lang_pred", "score")


def _train_quality(documents: DataFrame, labels: DataFrame):
    return train_quality(documents, labels.where(remainder("doc_id", 3) != 1))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_quality(documents, _train_quality(documents, table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id", _held_out(3, 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op5_near_dedup"] = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents),
grams AS (
    SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + least(5, len(w)) - 1], ' ')) AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
    FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM common c JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
    WHERE 100 * c.n >= 75 * (s.n + t.n - c.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
    SELECT a AS root, a AS node FROM both_ways
    UNION
    SELECT r.root, b.b FROM reach r JOIN both_ways b ON b.a = r.node),
lowest AS (SELECT node, min(root) AS component FROM reach GROUP BY node)
SELECT w.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, coalesce(l.component, w.doc_id) AS component_id,
    coalesce(l.component, w.doc_id) = w.doc_id AS kept
FROM words w LEFT JOIN sizes s USING (doc_id) LEFT JOIN lowest l ON l.node = w.doc_id
"""


@query
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    whole = format_branches(branches(turns_as_replies(rows)))
    read = whole.withColumns({"turns": read_turns("formatted"), "under": read_loss()})
    text = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"), F.length("under").cast("long").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


ORACLES["op6_chat_format"] = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(20 + 2 * length(role || text) - length(translate(role || text, '\<[', ''))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""


@query
def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 20 = 0"))


@query
def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_scores(documents, remainder("doc_id", 7) != 2).withColumn("held_out", _held_out(7, 2))


def repeated_tails(documents: DataFrame) -> DataFrame:
    """One document in ten, by the crc32 of its id, ends in repeats of a few of its words."""

    def changed(doc_id, text):
        h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "") if h % 10 == 0 else []
        if not words:
            return text
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return " ".join([*words[:a], *(words[a + k % p] for k in range(n - a))])

    def compute(batch):
        rows = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
        return [pa.array([changed(*row) for row in rows], pa.string())]

    return attach(documents.select("doc_id", "text"), [StructField("text", StringType())], compute)


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(repeated_tails(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("longest"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    size, period = F.col("longest.length"), -F.col("longest.period")
    return found.select(
        "doc_id", "n_runs", (-F.col("longest.start")).alias("start"), size.alias("length"), period.alias("period"),
        F.floor(1000 * size / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(spark, f"{sf_dir}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLES["op12_exact_dedup"] = r"""
WITH texts AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM texts JOIN firsts USING (t)
"""


@query
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = staged(centroid_clusters(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")), "clusters")
    sums = placed.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = sums.agg(F.sum("cluster_inertia")).first()[0] or 0
    found = placed.join(F.broadcast(sums), "cluster")  # a row per cluster
    return found.select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"),
        F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


_DISTANCE = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
_ROUND = """
near_{0} AS MATERIALIZED (
    SELECT r, arg_min(c, d) AS c FROM (SELECT v.r, c.c, {2} * 1000 + c.c AS d FROM v, c_{0} c) GROUP BY r),
sums_{0} AS (
    SELECT c, i, CAST(sum(y) AS BIGINT) AS s, count(*) AS n
    FROM (SELECT c, unnest(range(1, 65)) AS i, unnest(x) AS y FROM near_{0} JOIN v USING (r)) GROUP BY c, i),
means_{0} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM sums_{0} GROUP BY c),
c_{1} AS MATERIALIZED (SELECT c, coalesce(m.x, o.x) AS x FROM c_{0} o LEFT JOIN means_{0} m USING (c)),"""

ORACLES["op13_centroid_clusters"] = """
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id,
        list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c_0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h) - 1 AS c, x
    FROM (SELECT sha256('1:' || vec_id) AS h, x FROM v ORDER BY h LIMIT 16)),""" + "".join(
    _ROUND.format(i, i + 1, _DISTANCE) for i in range(3)) + f"""
last AS MATERIALIZED (
    SELECT r, min(d) AS d FROM (SELECT v.r, {_DISTANCE} * 1000 + c.c AS d FROM v, c_3 c) GROUP BY r),
named AS (SELECT vec_id, CAST(d % 1000 AS INTEGER) AS cluster, CAST(d // 1000 AS BIGINT) AS distance FROM last JOIN v USING (r)),
inner_sums AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM named GROUP BY cluster)
SELECT vec_id, cluster, distance, cluster_inertia, (SELECT CAST(sum(distance) AS BIGINT) FROM named) AS inertia,
    sha256(array_to_string(c_3.x, ',')) AS centroid_sha256
FROM named JOIN inner_sums USING (cluster) JOIN c_3 ON c_3.c = named.cluster
"""
