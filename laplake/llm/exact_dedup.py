"""Exact deduplication with a stream's keyed state.

The table is read as a stream, in micro-batches of bounded size. Per digest of the
normalised text the state, kept on disk and never expired, retains the smallest id,
where that row's content lies (file and row) and the number of rows. A later run on the
same state takes up only files that are new. The state is then read as a table, and
every row meets the entry of its digest: a row that the entry does not name is a hit,
and its whole text is compared with the text at the entry's place. Should texts with
one digest differ, all rows with that digest are grouped by their texts instead.

Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laplake.llm.frames import staged
from laplake.session import new_folder

BATCH_BYTES = 1 << 38  # of files read into one micro-batch
HOT_ROWS = 1_000  # of one digest, below which it is never spread
HOT_DIGESTS = 1_000  # so many at most have a thousandth of all rows or more
STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every partition takes megabytes of disk
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def normalised(text: str | Column) -> Column:
    """Every run of blanks as one space; null as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rows(files: DataFrame, doc_id: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    """(id, file, row, text, digest) of a table read from files."""
    found = files.select(
        F.col(doc_id).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
        normalised(text).alias("text"))
    return found.withColumn("digest", digest(F.col("text")))


def retain(spark: SparkSession, path: str, state: str, doc_id: str = "doc_id", text: str = "text",
           digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None) -> DataFrame:
    """(digest, keep_id, file, row, n): the state in the folder ``state`` after all files at ``path``.

    Ids that are null come last. Of rows with the same id the first by file and row is named.
    """
    # As a pattern, a path may be a folder or a single file.
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", BATCH_BYTES)
    if files_per_batch:
        source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    path = path.rstrip("/")
    rows = _rows(source.parquet(f"{path[:-1]}[{path[-1]}]"), doc_id, text, digest)
    kept = rows.groupBy("digest").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "file", "row")), F.count(F.lit(1)))
    with _settings(spark, STATE):
        run = kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(
            availableNow=True).start()
        run.awaitTermination()
    if run.lastProgress is None and not _committed(spark, state):
        return spark.createDataFrame([], "digest binary, keep_id long, file string, row long, n long")
    entry = F.col("value.min")
    return spark.read.format("statestore").load(state).select(
        F.col("key.digest").alias("digest"), entry["id"].alias("keep_id"), entry["file"].alias("file"),
        entry["row"].alias("row"), F.col("value.count").alias("n"))


def _committed(spark: SparkSession, state: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/commits/0")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _met(rows: DataFrame, entries: DataFrame, bar: int) -> DataFrame:
    """Rows with the entry of their digest, and ``part``, ``parts`` of digests with at least ``bar`` rows.

    Rows of such a digest are dealt to several tasks by their place in the file. Their
    entries, at most ``HOT_DIGESTS``, go to all tasks to tell which rows they are.
    """
    parts = F.ceil(F.col("n") / F.lit(bar)).cast("int")
    hot = entries.where(F.col("n") >= bar).select("digest", parts.alias("own"))
    rows = rows.join(F.broadcast(hot), "digest", "left")
    rows = rows.withColumn("part", F.pmod("row", F.coalesce("own", F.lit(1))).cast("int")).drop("own")
    entries = entries.select(
        "digest", "keep_id", F.col("file").alias("keep_file"), F.col("row").alias("keep_row"), "n",
        F.when(F.col("n") >= bar, parts).otherwise(1).alias("parts")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    named = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    return rows.join(entries, ["digest", "part"]).withColumn("kept", named)


def _unlike(rows: DataFrame, entries: DataFrame, bar: int) -> DataFrame:
    """Digests of which some row's text is not the text at the entry's place.

    Rows of digests with at least ``bar`` rows are combined in their tasks, the others meet by
    digest. As the entry names one of the rows, all texts are its text if the least and the
    greatest of them are.
    """
    columns = ["digest", F.col("file").alias("keep_file"), F.col("row").alias("keep_row")]
    hot, cold = (entries.where(where).select(*columns) for where in (F.col("n") >= bar, (F.col("n") > 1) & (F.col("n") < bar)))
    held = F.max(F.when((F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row")), F.col("text")))
    checked = []
    for met in (rows.join(F.broadcast(hot), "digest"),
                rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold, "digest")):
        texts = met.groupBy("digest").agg(held.alias("held"), F.min("text").alias("least"), F.max("text").alias("most"))
        checked.append(texts.where("NOT (least <=> held AND most <=> held)").select("digest"))
    return checked[0].union(checked[1])


def exact_duplicates(spark: SparkSession, path: str, doc_id: str = "doc_id", text: str = "text",
                     digest: Callable[[Column], Column] = sha256, state: str | None = None,
                     files_per_batch: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per row of the Parquet table at ``path``: id, keep_id, group_size, kept, digest.

    Texts are equal if they are after ``normalised``; null and empty texts are equal. Of equal
    texts the row with the smallest id stays, null ids last; of rows with the same id one stays.
    Other columns don't matter, whatever their names. An empty table gives no rows. With a folder
    ``state`` of an earlier run, only new files are streamed; files must not change or go.
    """
    entries = staged(retain(spark, path, state or new_folder(spark, "retained"), doc_id, text, digest, files_per_batch), "entries")
    total = entries.agg(F.sum("n")).first()[0] or 0
    bar = max(hot_rows, -(-total // HOT_DIGESTS))
    rows = _rows(spark.read.parquet(path), doc_id, text, digest)
    met = _met(rows.drop("text"), entries, bar)
    out = met.select(
        F.col("id").alias(doc_id), "keep_id", F.col("n").alias("group_size"), "kept", "digest")
    unlike = staged(_unlike(rows, entries, bar), "unlike")
    if unlike.isEmpty():
        return out
    apart = rows.join(unlike, "digest", "left_semi")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "file", "row")
    groups = staged(apart.groupBy("text").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size")), "groups")
    named = (F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))
    again = apart.join(groups, "text").select(
        F.col("id").alias(doc_id), F.col("first.id").alias("keep_id"), "group_size", named.alias("kept"), "digest")
    return out.join(unlike, "digest", "left_anti").select(*again.columns).union(again)
