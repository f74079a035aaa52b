"""From documents to packed training sequences, in five stages.

Every stage works on all rows that the one before it kept. Stages hand on the
columns of ``documents``; the last gives the packed pieces. Results are written
between stages, to the shared folder.

Nulls: a null text has no language, so the first stage rejects it; rows without
an id pass all stages. Rows that share an id stay or go together. Empty tables
give empty results. Columns beyond those of ``documents`` are handed on.

Running a stage sets the session's limit on the bytes of a batch for Python workers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laplake.llm.decontaminate import drop_contaminated, find_contamination
from laplake.llm.frames import by_ids, remainder, staged
from laplake.llm.language import UNDETERMINED, identify_language, train_language
from laplake.llm.near_dedup import near_duplicates
from laplake.llm.packing import pack
from laplake.llm.quality import score_quality, train_quality

ARROW_BYTES = 4 << 20  # of rows that a stage hands to a Python worker at a time
LEAST_LANGUAGE = 0.4  # probability of the language found
LEAST_QUALITY = 0.5


def _in_small_batches(stage):
    """Let the session hand rows to Python in batches of few bytes: workers of all stages share an executor."""
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
        return stage(spark, docs, sf_dir)

    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _free(docs: DataFrame, name: str) -> str:
    """``name``, with underscores until no column is called so."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; others, and texts without letters, go."""
    net = train_language(docs.where(remainder("doc_id", 3) != 1))
    name, score = _free(docs, "found_lang"), _free(docs, "lang_score")
    found = identify_language(docs, net, predicted=name, score=score)
    return found.where((F.col(name) != UNDETERMINED) & (F.col(score) >= LEAST_LANGUAGE)).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good ones."""
    labels = _table(spark, sf_dir, "labels").where(remainder("doc_id", 3) != 1)
    score = _free(docs, "quality_score")
    found = score_quality(docs, train_quality(docs, labels), score=score)
    return found.where(F.col(score) >= LEAST_QUALITY).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id."""
    removed = near_duplicates(docs).where(~F.col("kept")).select("doc_id")
    return by_ids(docs, removed, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    own = [c for c in docs.columns if c.lower() == "contamination"]
    kept = docs.withColumnsRenamed({c: _free(docs, c) for c in own})
    clean = drop_contaminated(find_contamination(kept, _table(spark, sf_dir, "benchmark")))
    return clean.drop("contamination").withColumnsRenamed({_free(docs, c): c for c in own}).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids."""
    return pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [(name, _in_small_batches(stage)) for name, stage in (
    ("language", language),
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
)]

ORACLE_SQL = None  # trained models, MinHash and tokenizing have no SQL counterpart


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
