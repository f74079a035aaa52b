"""Near duplicates by b-bit MinHash.

A document is its set of word shingles. Documents of equal sets form a class,
and only classes are compared. Of a class's minima, bands of a few whole minima
make bucket keys; of each minimum only the low bits are kept, packed into a few
longs. Classes that share a bucket are candidates; the packed bits, corrected
for chance collisions, give an estimate that removes those far below the
threshold; the rest, and all pairs of few shingles, are confirmed on the full
shingle sets.

Inside a bucket not all pairs are formed. First all members meet the bucket's
smallest one. Links make components, and in further rounds only members of
different components of one bucket meet, by other hubs in every bucket. Shingles
that only one of all these members has bound its similarity with any other, which
sets most of the rest apart without looking at pairs. At last,
each of the few that are still outside the bucket's main component has its packed
bits compared with those of all members of other components, block by block, and
only near ones become rows. So a pair stays untested only where both are in one
component already, and no link between components is lost.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from laplake.llm.components import connected_components
from laplake.llm.frames import by_ids, staged
from laplake.llm.text import (
    blank_class,
    flat_bytes,
    give_back,
    lowered,
    mix,
    row_slices,
    span_hashes,
    window_hashes,
    word_bounds,
)

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 40, 4  # a pair at 0.75 shares no band with probability 2.5e-7
BITS = 2  # kept of each minimum
HASHES = 640  # the first BANDS * ROWS of them make the bands
LONGS = HASHES * BITS // 64
DEVIATIONS = 5  # standard deviations that an estimate may lie too low
SHORT = 64  # shingles of two classes together below which no estimate is asked
HUB_ROUNDS = 1  # after the first, with other hubs
BLOCK = 1024  # members of one bucket that meet at a time in the last round


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, each text's sorted, and the texts' bounds.

    A text of fewer words than ``size`` has its whole word sequence as one shingle;
    without words it has none.
    """
    data, bounds = flat_bytes(column)
    data = lowered(data)
    starts, ends, owner = word_bounds(data, bounds, blank_class())
    words = span_hashes(data, starts, ends)
    cuts = np.searchsorted(owner, np.arange(len(bounds)))
    whole = window_hashes(words, size).view(np.int64)
    out, counts = [], np.zeros(len(bounds) - 1, dtype=np.int64)
    for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if a == b:
            continue
        if b - a < size:
            found = window_hashes(words[a:b], b - a).view(np.int64)
        else:
            found = np.sort(whole[a:b - size + 1])
            found = found[np.concatenate([[True], found[1:] != found[:-1]])]
        out.append(found)
        counts[i] = len(found)
    limits = np.zeros(len(bounds), dtype=np.int64)
    np.cumsum(counts, out=limits[1:])
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64), limits


def minima(sets: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function in each set; one row per non-empty set."""
    filled = np.flatnonzero(np.diff(limits))
    heads = limits[filled]
    seeds = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    factors, shifts = (seeds[:HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), seeds[HASHES:].astype(np.uint32)
    keys = (sets.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((HASHES, len(filled)), dtype=np.uint32)
    work = np.empty_like(keys)
    for k in range(HASHES):
        np.multiply(keys, factors[k], out=work)
        work += shifts[k]
        if len(filled):
            np.minimum.reduceat(work, heads, out=out[k])
    return out.T


def band_keys(lows: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band, from the band's whole minima."""
    rows = lows[:, :BANDS * ROWS].reshape(len(lows), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), rows.shape[:2])
    for k in range(ROWS):
        key = mix(key + rows[:, :, k])
    return key.view(np.int64)


def packed_bits(lows: np.ndarray) -> np.ndarray:
    """Low bits of all minima, packed into longs.

    The minima are scattered first: the low bits of a product by an odd number depend on
    those of the shingle alone, and would agree by chance under all hash functions or none.
    """
    out = np.empty((len(lows), LONGS), dtype=np.uint64)
    places = np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)
    for at in range(0, len(lows), 256):
        low = mix(lows[at:at + 256].astype(np.uint64)) & np.uint64((1 << BITS) - 1)
        np.bitwise_or.reduce(low.reshape(-1, LONGS, 64 // BITS) << places, axis=2, out=out[at:at + 256])
    return out.view(np.int64)


def estimated(left: Column | str, right: Column | str) -> Column:
    """Similarity from two packed signatures, corrected for minima that agree in their low bits by chance."""
    every_other = sum(1 << (BITS * i) for i in range(64 // BITS))
    differ = None
    for i in range(LONGS):
        x = F.col(left)[i].bitwiseXOR(F.col(right)[i])
        for shift in range(1, BITS):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        n = F.bit_count(x.bitwiseAND(F.lit(every_other)))
        differ = n if differ is None else differ + n
    chance = 1 / (1 << BITS)
    return (1 - differ / HASHES - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    """An estimate that a pair at the threshold stays below only by more than ``DEVIATIONS``."""
    chance = 1 / (1 << BITS)
    agree = chance + (1 - chance) * percent / 100
    return percent / 100 - DEVIATIONS * math.sqrt(agree * (1 - agree) / HASHES) / (1 - chance)


def sketches(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, n, two halves of the set's digest, band keys, packed bits) of every row."""

    def run(batches):
        for batch in batches:
            for at, to in row_slices(batch.column(text), rows=1024):
                part = batch.slice(at, to - at)
                sets, limits = shingle_sets(part.column(text))
                n = np.diff(limits)
                filled = np.flatnonzero(n)
                lows = minima(sets, limits)
                halves = []
                for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                    half = np.zeros(len(n), dtype=np.uint64)
                    if len(filled):
                        half[filled] = np.add.reduceat(mix(sets.view(np.uint64) + np.uint64(salt)), limits[filled])
                    halves.append(pa.array(half.view(np.int64)))
                place = np.zeros(len(n) + 1, dtype=np.int32)
                np.cumsum(n > 0, out=place[1:])
                lists = [
                    pa.ListArray.from_arrays(pa.array(place * width), pa.array(values.ravel()))
                    for width, values in ((BANDS, band_keys(lows)), (LONGS, packed_bits(lows)))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(doc_id), pa.array(n, pa.int64()), *halves, *lists],
                    names=["id", "n", "d1", "d2", "bands", "bits"])
        give_back()

    schema = StructType([
        StructField("id", documents.schema[doc_id].dataType), *(StructField(c, LongType()) for c in ("n", "d1", "d2")),
        StructField("bands", ArrayType(LongType())), StructField("bits", ArrayType(LongType()))])
    return documents.select(doc_id, text).mapInArrow(run, schema)


def _sets_of(documents: DataFrame, nodes: DataFrame, doc_id: str, text: str, repeated: bool) -> DataFrame:
    """(node, shingles) of the given documents, once for each; ``repeated``: some id has several rows."""
    chosen = by_ids(
        documents.select(F.col(doc_id).alias("node"), F.col(text).alias("text")), nodes.select("node"), "node", "left_semi")
    if repeated:
        chosen = chosen.distinct()

    def run(batches):
        for batch in batches:
            for at, to in row_slices(batch.column("text"), rows=1024):
                part = batch.slice(at, to - at)
                sets, limits = shingle_sets(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pa.array(sets))],
                    names=["node", "shingles"])
        give_back()

    return chosen.mapInArrow(run, StructType([chosen.schema["node"], StructField("shingles", ArrayType(LongType()))]))


class _Links:
    """Confirmed and refused pairs so far, and the sets that were needed for them."""

    def __init__(self, documents: DataFrame, classes: DataFrame, doc_id: str, text: str, percent: int,
                 repeated: bool):
        self.documents, self.classes, self.doc_id, self.text = documents, classes, doc_id, text
        self.percent, self.repeated = percent, repeated
        self.sets: list[DataFrame] = []
        self.tested: list[DataFrame] = []

    def _near(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and packed bits allow the threshold."""
        side = self.classes.select("node", "n", "bits")
        for name in ("a", "b"):
            pairs = pairs.join(side.withColumnsRenamed({"node": name, "n": f"n_{name}", "bits": f"bits_{name}"}), name)
        return pairs.where(
            (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent)
            & ((F.col("n_a") + F.col("n_b") < SHORT)
               | (estimated("bits_a", "bits_b") >= least_estimate(self.percent)))).select("a", "b")

    def hold_sets(self, nodes: DataFrame) -> None:
        """Compute and keep the shingle sets of those nodes whose sets are not there yet."""
        if self.sets:
            nodes = nodes.join(reduce(DataFrame.union, self.sets).select("node"), "node", "left_anti")
        self.sets.append(staged(_sets_of(self.documents, nodes, self.doc_id, self.text, self.repeated), "shingles"))

    def with_bounds(self, members: DataFrame) -> DataFrame:
        """(key, node, n, most): members that may still have a link among all given ones.

        ``most`` is the number of a member's shingles that another member has too, and
        so the largest intersection that it can have with any of them.
        """
        nodes = members.select("node").distinct()
        self.hold_sets(nodes)
        sets = reduce(DataFrame.union, self.sets).join(nodes, "node", "left_semi")
        alone = sets.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(
            F.min("node").alias("node"), F.count(F.lit(1)).alias("times")).where("times = 1").groupBy("node").agg(
            F.count(F.lit(1)).alias("alone"))
        bounded = sets.select("node", F.size("shingles").alias("n")).join(alone, "node", "left").select(
            "node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).cast("int").alias("most"))
        likely = staged(bounded.where(F.col("most") * 100 >= F.col("n") * self.percent), "bounds")
        return members.select("key", "node", "size").join(likely, "node")

    def confirm(self, pairs: DataFrame, estimated_before: bool = False) -> DataFrame | None:
        """The pairs that are links on full sets; None if no new pair is one."""
        if self.tested:
            pairs = pairs.join(reduce(DataFrame.union, self.tested), ["a", "b"], "left_anti")
        near = staged(pairs if estimated_before else self._near(pairs), "pairs")
        if near.isEmpty():
            return None
        self.tested.append(near)
        self.hold_sets(near.select(F.col("a").alias("node")).union(near.select("b")).distinct())
        sets = reduce(DataFrame.union, self.sets)
        full = near
        for name in ("b", "a"):
            full = full.join(sets.withColumnsRenamed({"node": name, "shingles": f"set_{name}"}), name)
        same = F.size(F.array_intersect("set_a", "set_b"))
        union = F.size("set_a") + F.size("set_b") - same
        found = staged(full.where(same * 100 >= union * self.percent).select("a", "b"), "links")
        return None if found.isEmpty() else found


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Texts of null, or without words, have no shingles and are linked with nothing.
    Rows that share an id count as one document. A row without an id stands alone,
    with a null component, and is kept.
    """
    rows = staged(sketches(documents, doc_id, text), "sketches")
    classes = staged(
        rows.where((F.col("n") > 0) & F.col("id").isNotNull()).groupBy("d1", "d2").agg(
            F.min("id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"),
            F.first("bits").alias("bits")), "classes")
    placed = classes.select("node", F.explode("bands").alias("key"))
    shared = placed.groupBy("key").agg(
        F.min("node").alias("hub"), F.max("node").alias("last"), F.count(F.lit(1)).alias("size")).where("hub <> last")
    members = staged(placed.join(shared.select("key", "hub", "size"), "key"), "buckets")
    repeated = not rows.groupBy("id").count().where("count > 1").isEmpty()
    links = _Links(documents, classes, doc_id, text, percent, repeated)

    edges = links.confirm(
        members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    if edges is None:
        edges = classes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    components = staged(connected_components(edges), "components")
    members = links.with_bounds(_open_buckets(members, components, 0))
    for salt in range(HUB_ROUNDS + 1):
        members = _open_buckets(members, components, salt)
        if salt < HUB_ROUNDS:
            found = links.confirm(_hub_pairs(members))
        else:
            found = links.confirm(_all_pairs(members, classes, percent), estimated_before=True)
        if found is not None:
            components = staged(_joined(components, found), "components")

    named = classes.select("d1", "d2", "node")
    named = named.join(components, "node", "left").select(
        "d1", "d2", F.coalesce("component", "node").alias("component"))
    joined = rows.select("id", "n", "d1", "d2").join(named, ["d1", "d2"], "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return joined.select(
        F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _joined(components: DataFrame, links: DataFrame) -> DataFrame:
    """Components after new links between them."""
    ends = links
    for name in ("a", "b"):
        own = components.withColumnsRenamed({"node": name, "component": "_c"})
        ends = ends.join(own, name, "left").withColumn(name, F.coalesce("_c", name)).drop("_c")
    merged = staged(connected_components(ends), "merged").select(F.col("node").alias("component"), F.col("component").alias("_m"))
    old = components.join(merged, "component", "left").select("node", F.coalesce("_m", "component").alias("component"))
    # Ends that were alone before are nodes of their own name.
    new = merged.select(F.col("component").alias("node"), F.col("_m").alias("component")).join(components, "node", "left_anti")
    return old.union(new)


def _open_buckets(members: DataFrame, components: DataFrame, salt: int) -> DataFrame:
    """(key, node, c, hub, hub_c, main, size) of the buckets that hold several components.

    ``c`` is a member's component, ``hub`` a member by a hash of its own in every
    bucket and round, ``main`` the component with most members.
    """
    named = components.withColumnRenamed("component", "c")
    own = [c for c in ("key", "node", "size", "n", "most") if c in members.columns]
    members = members.select(*own).join(named, "node", "left").withColumn("c", F.coalesce("c", "node"))
    order = F.xxhash64("key", "node", F.lit(salt))
    # Counted by component first, so that no row holds all components of a bucket.
    counted = members.groupBy("key", "c").agg(
        F.min_by("node", order).alias("hub"), F.min(order).alias("place"), F.count(F.lit(1)).alias("size"),
        F.max("size").alias("before"))
    mixed = counted.groupBy("key").agg(
        F.min("c").alias("c0"), F.max("c").alias("c1"), F.max_by("c", F.struct("size", "c")).alias("main"),
        F.min_by("hub", F.col("place")).alias("hub"), F.min_by("c", F.col("place")).alias("hub_c"),
        F.sum("size").alias("now"), F.max("before").alias("size"),
    ).where("c0 <> c1").drop("c0", "c1")
    # A bucket's members are spread over one part for each block of its size before.
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    spread = mixed.select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).drop("size")
    placed = members.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).drop("size")
    return staged(placed.join(spread, ["key", "part"]).drop("part").withColumnRenamed("now", "size"), "open-buckets")


def _hub_pairs(members: DataFrame) -> DataFrame:
    """Each member with its bucket's hub, where that is of another component."""
    return members.where("c <> hub_c").select(
        F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _all_pairs(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """All near pairs of one bucket and different components, by their packed bits."""
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    columns = ("node", "c", "main", "n", "most", "bits", "bands")
    wide = members.join(classes.select("node", "bits", "bands"), "node").select(
        "key", *columns, own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    # Members outside the main component are on the left, all members on the right.
    left = wide.where("c <> main").select(
        "key", F.col("own").alias("i"), F.col("other").alias("j"), F.lit(True).alias("outside"), *columns)
    right = wide.select(
        "key", F.col("other").alias("i"), F.col("own").alias("j"), F.lit(False).alias("outside"), *columns)
    rows = left.union(right).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    least = least_estimate(percent)
    chance = 1 / (1 << BITS)
    most = HASHES * (1 - chance) * (1 - least) + 1e-9  # minima that may differ
    every_other = np.uint64(sum(1 << (BITS * i) for i in range(64 // BITS)))

    def near(table: pa.Table):
        outside = table.column("outside").to_numpy()
        node, c, main, n, shared = (table.column(k).to_numpy() for k in columns[:-2])
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        here = table.column("key")[0].as_py() if len(table) else None
        bits = table.column("bits").combine_chunks().flatten().to_numpy().reshape(-1, LONGS).view(np.uint64)
        x_all, y_all = np.flatnonzero(outside), np.flatnonzero(~outside)
        for at in range(0, len(x_all), 256):
            x, y = x_all[at:at + 256, None], y_all[None, :]
            differ = np.zeros((x.shape[0], y.shape[1]), dtype=np.int32)
            for k in range(LONGS):
                d = bits[x, k] ^ bits[y, k]
                for shift in range(1, BITS):
                    d |= d >> np.uint64(shift)
                differ += np.bitwise_count(d & every_other)
            good = ((differ <= most) | (n[x] + n[y] < SHORT)) & (c[x] != c[y]) & ((c[y] == main[y]) | (node[x] < node[y]))
            same = np.minimum(shared[x], shared[y])
            good &= same * 100 >= (n[x] + n[y] - same) * percent
            i, j = np.nonzero(good)
            if len(i):
                # Of all buckets that two members share, the first band's counts.
                i, j = x[i, 0], y[0, j]
                both = bands[i] == bands[j]
                first = bands[i][np.arange(len(i)), both.argmax(axis=1)] == here
                i, j = i[first], j[first]
            if len(i):
                a, b = node[i], node[j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            key, i, j = (table.column(k).to_numpy() for k in ("key", "i", "j"))
            change = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            cuts = [0, *change.tolist()]
            for s, e in zip(cuts, cuts[1:], strict=False):
                yield from near(table.slice(s, e - s))
            rest = table.slice(cuts[-1])
        if rest is not None:
            yield from near(rest)
        give_back()

    kind = members.schema["node"].dataType
    return rows.mapInArrow(run, StructType([StructField("a", kind), StructField("b", kind)])).distinct()
