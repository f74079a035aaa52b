"""Feeds that are polled: what is new, what came before, what came too late; and when to stop."""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from laplake.operators.groups import lookup
from laplake.sinks.tables import VersionedTable
from laplake.streaming.features import side_by_side

END = "session_end"
EVENT_KEYS = ("session_key", "kind", "driver_number", "lap_number")


class PolledFeed:
    """Splits a feed into first messages and a side table, so that no row is lost.

    Providers send all pit stops of a session again with every poll. Of the messages of
    a key the first one goes to ``rows``; all others go to ``side``, with the reason
    ``repeat``. A message whose ``order`` lies behind the end marker of its session goes there
    as ``late``. Rows, side rows and markers together are the input.

    What was seen is looked up in the rows of earlier batches. The end marker closes a
    session: from then on nothing of it is read but the marker. A batch that is run
    again replaces what it wrote. Nulls in keys are values like others; a message
    without an order is never late.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = EVENT_KEYS, order: str = "offset",
                 kind: str = "kind"):
        self.keys, self.order, self.kind = list(keys), order, kind
        self.session = self.keys[0]
        self.rows = VersionedTable(spark, f"{path}/rows", self.keys, [self.session])
        self.side = VersionedTable(spark, f"{path}/side", self.keys, [self.session])
        self.ended = VersionedTable(spark, f"{path}/ended", [self.session])

    def process(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            marked = F.col(self.kind).eqNullSafe(F.lit(END))
            markers = batch.where(marked).groupBy(self.session).agg(F.min(self.order).alias("_end"))
            data = batch.where(~marked)
            for table, frame in ((self.rows, data), (self.ended, markers)):
                table.learn(frame)
            ends = markers
            if self._before(self.ended, batch_id):
                ends = ends.union(self.ended.all().where(F.col("version") < batch_id).select(self.session, "_end"))
            ends = ends.groupBy(self.session).agg(F.min("_end").alias("_end"))
            timed = self._matched(data, ends, [self.session]).withColumn(
                "_late", F.coalesce(F.col(self.order) > F.col("_end"), F.lit(False)))
            first = timed.where("NOT _late").groupBy(*self.keys).agg(F.min(F.struct(self.order)).alias("_first"))
            judged = self._matched(timed, first, self.keys)
            if self._before(self.rows, batch_id):
                open_rows = judged.where("NOT _late").select(*self.keys).distinct()
                seen = self._matched(self.rows.all().where(F.col("version") < batch_id).select(*self.keys), open_rows, self.keys, "left_semi")
                judged = self._matched(judged, seen.distinct().withColumn("_seen", F.lit(True)), self.keys)
            else:
                judged = judged.withColumn("_seen", F.lit(None).cast("boolean"))
            repeat = F.col("_seen").isNotNull() | ~F.struct(self.order).eqNullSafe(F.col("_first"))
            judged = judged.withColumn("reason", F.when(F.col("_late"), "late").when(repeat, "repeat"))
            judged = judged.select(*data.columns, "reason").persist()
            try:
                side_by_side(
                    lambda: self.rows.write(judged.where("reason IS NULL").drop("reason"), batch_id),
                    lambda: self.side.write(judged.where("reason IS NOT NULL"), batch_id),
                    lambda: self.ended.write(markers, batch_id))
            finally:
                judged.unpersist()
        finally:
            batch.unpersist()

    @staticmethod
    def _before(table: VersionedTable, batch_id: int) -> bool:
        return any(version < batch_id for version in table.versions())

    @staticmethod
    def _matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
        """Join on keys of which null is a value."""
        names = {key: f"_r{i}" for i, key in enumerate(keys)}
        condition = [left[key].eqNullSafe(F.col(other)) for key, other in names.items()]
        return left.join(right.withColumnsRenamed(names), condition, how).drop(*names.values())

    def outcomes(self) -> DataFrame:
        """Every data message with its outcome: ``row``, ``repeat`` or ``late``."""
        rows = self.rows.all().drop("version").withColumn("reason", F.lit("row"))
        return rows.unionByName(self.side.all().drop("version")).withColumnRenamed("reason", "outcome")


class _EndListener(StreamingQueryListener):
    """Sets an event once the observed metric of a query is positive, or the query has ended."""

    def __init__(self, name: str, wanted: int):
        self.name, self.wanted, self.found, self.done = name, wanted, 0, threading.Event()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.found += row["ends"] or 0
            if self.found >= self.wanted:
                self.done.set()

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def run_to_marker(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None],
                  ended: Column | None = None, markers: int = 1, name: str = "to_marker",
                  timeout: float | None = None, **trigger) -> StreamingQuery:
    """Follow a live stream and stop after the batch that holds the last of ``markers`` end markers.

    The markers are counted by the query itself while it runs, and reported with the progress of
    each batch, so nothing is read twice. A query that fails raises here; one that is
    still without its markers after ``timeout`` seconds is stopped as well.
    """
    ended = F.col("kind").eqNullSafe(F.lit(END)) if ended is None else ended
    spark = stream.sparkSession
    listener = _EndListener(name, markers)
    spark.streams.addListener(listener)
    try:
        query = (
            stream.observe(name, F.count_if(ended).alias("ends")).writeStream.foreachBatch(sink)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start())
        waited = 0.0
        while not listener.done.wait(0.2) and query.isActive and (timeout is None or waited < timeout):
            waited += 0.2
        if not query.isActive:
            query.awaitTermination()  # raises what ended it
        query.stop()
        return query
    finally:
        spark.streams.removeListener(listener)
