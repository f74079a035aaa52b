"""Feature tables by race, and versioned tables for upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

PARTITIONS = ("season", "round_number")


def write_races(features: DataFrame, path: str, partitions: Sequence[str] = PARTITIONS,
                rows_per_file: int = 5_000_000) -> int:
    """Replace the races that occur in ``features``, leave the others alone, and return the rows written.

    Rebalancing by race gives one file for a normal race and, under adaptive
    execution, several tasks for an outsized one. Rows are counted on their way to the
    files, not read again.
    """
    written = Observation()
    (
        features.hint("rebalance", *partitions)
        .observe(written, F.count(F.lit(1)).alias("rows"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy(*partitions)
        .parquet(path)
    )
    return written.get["rows"]


class VersionedTable:
    """Parquet folder with one sub-folder per version.

    Writing a version again replaces that version as a whole, so a retried batch
    leaves no rows of its first try. Readers take the newest row of every key.
    ``order`` names columns that tell which of two rows of a key is newer; without
    it the version does. ``merge`` keeps the number of versions small.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str],
                 partitions: Sequence[str] = (), order: Sequence[str] = ("version",)):
        self.spark = spark
        self.path = path
        self.keys = list(keys)
        self.partitions = list(partitions)
        self.order = list(order)
        self.schema: StructType | None = None

    def write(self, rows: DataFrame, version: int) -> None:
        """Write one version; rows of equal keys must not contradict each other in ``order``."""
        self.learn(rows)
        writer = (rows.hint("rebalance", *self.partitions) if self.partitions else rows).write
        (
            writer.mode("overwrite")
            .option("partitionOverwriteMode", "static")
            .partitionBy(*self.partitions)
            .parquet(f"{self.path}/version={version}")
        )

    def learn(self, rows: DataFrame) -> None:
        """Take the schema of rows to be written as that of the table."""
        inner = [f for f in rows.schema.fields if f.name not in self.partitions]
        outer = [rows.schema[name] for name in self.partitions]
        self.schema = StructType([*inner, StructField("version", LongType()), *outer])

    def all(self) -> DataFrame:
        reader = self.spark.read.option("basePath", self.path)
        return (reader.schema(self.schema) if self.schema else reader).parquet(self.path)

    def latest(self, rows: DataFrame | None = None) -> DataFrame:
        """Newest row per key; copies of a key are combined before the shuffle.

        Of rows that are equally new the one with the largest values is taken, so
        the result does not depend on which version or task a row came by.
        """
        rows = self.all() if rows is None else rows
        payload = [name for name in rows.columns if name not in (*self.keys, "version")]
        rank, values = F.struct(*self.order).alias("rank"), F.struct(*payload).alias("values")
        newest = rows.groupBy(*self.keys).agg(F.max(F.struct(rank, values)).alias("_row"))
        return newest.select(*self.keys, "_row.values.*")

    def versions(self) -> list[int]:
        path, fs = self._folder()
        if not fs.exists(path):
            return []
        names = (status.getPath().getName() for status in fs.listStatus(path))
        return sorted(int(name.split("=")[1]) for name in names if name.startswith("version="))

    def expire(self, before: int) -> None:
        """Delete all versions below ``before``; what they held must be in a later one."""
        _, fs = self._folder()
        for version in self.versions():
            if version < before:
                fs.delete(self._path(f"version={version}"), True)

    def remove(self, files: Sequence[str]) -> None:
        """Delete those of the files that are in this table, and the versions that are empty then."""
        path, fs = self._folder()
        root, path_of = f"{fs.makeQualified(path).toString()}/", self.spark._jvm.org.apache.hadoop.fs.Path
        changed = set()
        for name in files:
            file = path_of(self.spark._jvm.java.net.URI(name))
            if file.toString().startswith(root):
                fs.delete(file, False)
                changed.add(file.toString()[len(root):].split("/")[0])
        for name in changed:
            rest, empty = fs.listFiles(self._path(name), True), True
            while empty and rest.hasNext():
                empty = rest.next().getPath().getName().startswith(("_", "."))
            if empty:
                fs.delete(self._path(name), True)

    def merge(self, version: int) -> None:
        """Write the newest rows as ``version``, which must be above all others, and drop the rest."""
        self.write(self.latest(), version)
        self.expire(version)

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _folder(self):
        path = self._path()
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())
