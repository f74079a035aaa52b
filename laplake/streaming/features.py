"""Feature tables that follow a lap stream and equal the batch result."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from laplake.operators.features import LAPS, LapColumns, lap_features
from laplake.operators.groups import LIMITS, HotGroups, Limits, lookup
from laplake.sinks.tables import VersionedTable


#: Rows about sessions that become part of the plans; so many sessions can be named to leave the folders of others unread.
NAMED = 1_000


class FeatureStream:
    """Keeps raw laps and their features up to date, batch by batch.

    A batch is stored first. While the sessions it touches hold at most ``limits.group_rows`` laps,
    every (session, driver) in it is computed again from all its laps. Larger sessions are computed
    again when their laps have doubled since the last time, with all drivers that got laps meanwhile;
    until then ``table`` computes these drivers from their laps as it is read. So the laps computed
    stay in proportion to the laps that came, whatever the number of batches, and every reader sees
    all batches. Of several messages for one lap the one with the highest ``order`` counts, whether
    they come in one batch or in many, so late and repeated laps give the result a batch job would
    give. Without order columns in the stream the message with the largest values counts.

    Every batch is a version of its own under a fresh number. A list of live versions names for
    every driver the one that holds its features, or says that they are still to be computed, so
    a batch counts once its entries are there; one that is run again after a failure adds a version
    with the same rows. A session with ``merge_every`` versions of one level has these merged into
    one of the next level, together with the levels that this fills, and only such sessions are
    read and rewritten: a row is written again at most once per level, so as often as the
    logarithm of the number of batches.
    """

    def __init__(self, spark: SparkSession, path: str, cols: LapColumns = LAPS, limits: Limits = LIMITS,
                 order: Sequence[str] = (), merge_every: int = 10):
        self.spark = spark
        self.cols = cols
        self.limits = limits
        self.order = list(order)
        self.merge_every = merge_every
        self.lap_keys = [*cols.keys, cols.order]
        self.session = cols.keys[0]
        self.raw = VersionedTable(spark, f"{path}/laps", self.lap_keys, [self.session], self.order)
        self.features = VersionedTable(spark, f"{path}/features", self.lap_keys, [self.session])
        self.live = VersionedTable(spark, f"{path}/live", cols.keys, [self.session])

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Take in one batch."""
        batch = batch.persist()
        try:
            if not batch.count():
                return
            version = self._fresh()
            self.raw.learn(batch)
            due = self._fixed(self._due(batch))
            try:
                self._store(batch, due, version)
            finally:
                due.unpersist()
        finally:
            batch.unpersist()
        self.compact()

    def _fixed(self, rows: DataFrame) -> DataFrame:
        """Rows about sessions that change no more: few of them as constants, others in memory."""
        few = rows.limit(NAMED + 1).toArrow()
        return self.spark.createDataFrame(few, rows.schema) if len(few) <= NAMED else rows.persist()

    def _due(self, batch: DataFrame) -> DataFrame:
        """(session, rows, due): laps of the sessions in a batch, and whether to compute them now."""
        sizes = batch.groupBy(self.session).agg(F.count(F.lit(1)).alias("rows"))
        if not self.raw.versions():
            return sizes.withColumn("due", F.lit(True))
        stored = self.raw.all().groupBy(self.session).agg(F.count(F.lit(1)).alias("_stored"))
        sizes = lookup(sizes, stored, [self.session]).select(
            self.session, (F.col("rows") + F.coalesce("_stored", F.lit(0))).alias("rows"))
        if sizes.agg(F.sum("rows")).first()[0] <= self.limits.group_rows:
            return sizes.withColumn("due", F.lit(True))
        last = self.live.all().groupBy(self.session).agg(F.max("rows").alias("_last"))
        grown = F.col("rows") >= 2 * F.coalesce("_last", F.lit(0))
        return lookup(sizes, last, [self.session]).select(self.session, "rows", grown.alias("due"))

    def _store(self, batch: DataFrame, due: DataFrame, version: int) -> None:
        """Write the laps of a batch, the features of what is due, and the entries of both."""
        keys, now = list(self.cols.keys), due.where("due")
        sessions = [row[0] for row in now.select(self.session).limit(NAMED + 1).collect()]
        touched = batch.select(*keys).distinct()
        drivers, history = lookup(touched, now, [self.session], "left_semi"), lookup(batch, now, [self.session], "left_semi")
        if self.raw.versions():
            if self.live.versions():
                late = lookup(self._late(), now, [self.session], "left_semi")
                drivers = drivers.unionByName(late).distinct()
            before = self.raw.all().drop("version")
            if len(sessions) <= NAMED:  # folders of others are not read
                before = before.where(F.col(self.session).isin(sessions))
            before = lookup(before, drivers, keys, "left_semi")
            history = before.unionByName(history)
        writes = [lambda: self.raw.write(self.raw.latest(batch), version)]
        if sessions:
            writes.append(lambda: self.features.write(self._computed(history), version))
        side_by_side(*writes)
        # Named last: until then readers take the rows of the versions before.
        waiting = lookup(touched, now, [self.session], "left_anti")
        entries = lookup(drivers.withColumn("done", F.lit(True)), now, [self.session]).drop("due").unionByName(
            waiting.select(*keys, F.lit(False).alias("done"), F.lit(0).cast("long").alias("rows")))
        self.live.write(entries.select(*keys, F.lit(version).alias("since"), F.lit(0).alias("level"), "done", "rows"), version)

    def _computed(self, laps: DataFrame) -> DataFrame:
        """Features of all given laps."""
        hot = HotGroups.measure(laps, self.cols.keys, self.limits)
        return lap_features(self.raw.latest(laps).drop(*self.order), self.cols, hot=hot, limits=self.limits)

    def _late(self) -> DataFrame:
        """Drivers with laps that their features lack."""
        return self._newest(self.live.all()).where(~F.col("done")).select(*self.cols.keys)

    def _fresh(self) -> int:
        """A number above all that were ever begun."""
        return 1 + max((n for t in (self.raw, self.features, self.live) for n in t.versions()), default=-1)

    def compact(self) -> None:
        """Merge the versions of one level of every session that has ``merge_every`` of them.

        If the new version fills the next level, that is merged along, and so on.
        """
        if len(self.live.versions()) < self.merge_every:
            return
        versions = self.live.all().select(self.session, "version", "level").distinct()
        due = self._fixed(lookup(versions, self._full(versions), [self.session]).where(
            "level BETWEEN full.first AND full.top").select(self.session, "version", (F.col("full.top") + 1).alias("level")))
        try:
            if not due.isEmpty():
                self._merge(due)
        finally:
            due.unpersist()

    def _full(self, versions: DataFrame) -> DataFrame:
        """(session, full): the first level with enough versions, and the top one that merging fills."""

        def step(full, x):
            first = full["first"].isNull() & (x["n"] >= self.merge_every)
            more = (x["level"] == full["top"] + 1) & (x["n"] + 1 >= self.merge_every)
            return F.when(first, F.struct(x["level"].alias("first"), x["level"].alias("top"))).when(
                more, F.struct(full["first"].alias("first"), x["level"].alias("top"))).otherwise(full)

        none = F.lit(None).cast("int")
        counted = versions.groupBy(self.session, "level").agg(F.count(F.lit(1)).alias("n"))
        return counted.groupBy(self.session).agg(F.aggregate(
            F.sort_array(F.collect_list(F.struct("level", "n"))), F.struct(none.alias("first"), none.alias("top")), step).alias("full"))

    def _merge(self, due: DataFrame) -> None:
        """One version instead of the given ones (session, version, level), with the level given.

        The list of live versions changes last, and old files go after that, so a failure
        in between loses nothing and leaves at most copies.
        """
        pairs, number = [self.session, "version"], self._fresh()
        levels = due.select(self.session, "level").distinct()
        due = due.select(*pairs)
        merged = F.col("version").isin([row[0] for row in due.select("version").distinct().collect()])
        tables = [t.all().where(merged) for t in (self.live, self.features, self.raw)]
        old = [lookup(rows, due, pairs, "left_semi") for rows in tables]
        places = reduce(DataFrame.union, [rows.select(*pairs, "_metadata.file_path") for rows in tables])
        files = [row[0] for row in lookup(places, due, pairs, "left_semi").select("file_path").distinct().toLocalIterator()]
        newest = self._newest(old[0])
        side_by_side(lambda: self.raw.write(self.raw.latest(old[2]), number),
                     lambda: self.features.write(self._held(old[1], newest.where("done")), number))
        self.live.write(lookup(newest, levels, [self.session]).select(
            *self.cols.keys, "since", "level", "done", "rows"), number)
        for table in (self.live, self.features, self.raw):
            table.remove(files)

    def _newest(self, entries: DataFrame) -> DataFrame:
        """Per driver the version with its features, if they are ``done``; ``since`` is the batch that gave them."""
        place = F.struct("since", "version")
        return entries.groupBy(*self.cols.keys).agg(
            F.max("since").alias("since"), F.max_by("version", place).alias("version"),
            F.max_by("done", place).alias("done"), F.max("rows").alias("rows"))

    def _held(self, features: DataFrame, newest: DataFrame) -> DataFrame:
        keys = [*self.cols.keys, "version"]
        return lookup(features, newest.select(*keys), keys, "left_semi").drop("version")

    def table(self) -> DataFrame:
        """Current features: for every driver the rows of the last batch that touched it, or from its laps."""
        newest, late = self._newest(self.live.all()).where("done"), self._late()
        if late.isEmpty():
            return self._held(self.features.all(), newest)
        laps = self.raw.all().where(F.col("version").isin(self.live.versions())).drop("version")
        computed = self._computed(lookup(laps, late, self.cols.keys, "left_semi"))
        self.features.learn(computed)
        return self._held(self.features.all(), newest).unionByName(computed)

    def start(self, laps: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Follow a stream of decoded laps; by default every five seconds."""
        return (
            laps.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "5 seconds"}))
            .start()
        )


def side_by_side(*jobs: Callable[[], None]) -> None:
    """Run jobs that don't depend on each other at the same time; wait for all, then raise what failed."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        running = [pool.submit(job) for job in jobs]
    for job in running:
        job.result()


def run_available(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None],
                  mode: str = "append") -> None:
    """Process what is there, in order, and stop."""
    query = (
        stream.writeStream.foreachBatch(sink)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    finally:
        query.stop()
