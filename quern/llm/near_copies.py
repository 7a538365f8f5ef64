"""Near copies of similarity 0.8 by SimHash fingerprints, compared bit-sliced, with exact counts deciding.

A text's set is the distinct XXH64 of its runs of five words. Two sets of similarity 0.8 differ in
about ten of the 64 bits of their SimHash fingerprints, and blocks of bits can't be the buckets of so
wide a radius. So buckets are 24 bands of five MinHash minima: two such sets share one with probability
1 - (1 - 0.8^5)^24 = 0.99993. In a bucket, fingerprints are compared as bit planes by carry-save
counters; pairs within the radius are candidates, and a candidate is a link if the whole sets, counted
with integers, are of similarity 0.8 or more.

The fewer shingles, the more a fingerprint's distance varies. Sets of under 20 shingles therefore have
exact buckets too, where no distance rules a pair out: of s sorted hashes the first s - ceil(0.8 s) + 1,
one of which any set of similarity 0.8 has among its own first ones. A set under 16 has no such partner
of 20, so its links are all found. A larger pair at 0.8 is lost about once in ten thousand times.

Equal sets are one node. Candidates are checked in rounds: first each node's closest one in a bucket,
then its closest one outside its class so far, at last every candidate whose ends are in different
classes. In that round the members of a bucket bring 32 bits of each shingle, and candidates whose
common ones are too few are dropped where they are found, so that the texts near a large group but
outside of it give no rows. No candidate goes unchecked unless its ends are connected already.

Defined results:
* null or empty text, or blanks only: the empty set, equal to itself alone.
* fewer words than the width: the whole sequence is the one shingle. Sets under four shingles are
  similar to none but their equals.
* null doc_id: links like any other row; never a component's id unless a component has no other.
* of a class, one row stays: that of the smallest doc_id, of rows that share it the one of the smallest
  text hash; an id and text that occur twice stay once.
* other columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import simhash
from quern.llm.common import id_and_text, per_batch, texts
from quern.llm.components import components
from quern.session import stored

WIDTH, BANDS, ROWS, RADIUS, SMALL = 5, 24, 5, 21, 20
#: How many closest candidates of a node a round checks; the last round checks all that are left.
ROUNDS = (1, 1, None)
_RNG = np.random.default_rng(8)
_BY_ROW = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BY_BAND = _RNG.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(simhash.shingle_hashes(text, WIDTH))


def node_of(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.astype("<u8").tobytes(), 1)


def buckets(own: np.ndarray, block: int = 1024) -> np.ndarray:
    """One 64-bit bucket a band, then a small set's exact ones; sets under four shingles are similar to none but their equals."""
    if len(own) < 4:
        return np.zeros(0, np.int64)
    low = np.full(len(_BY_ROW), np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(own), block):
        np.minimum(low, (own[None, i : i + block] * _BY_ROW[:, None]).min(axis=1), out=low)
    low = low.reshape(BANDS, ROWS)
    low = (low ^ (low >> np.uint64(31))) * _BY_BAND
    low = (low ^ (low >> np.uint64(29))).sum(axis=1, dtype=np.uint64)
    exact = own[: len(own) + 1 - -(-len(own) * 4 // 5)] if len(own) < SMALL else own[:0]
    return np.concatenate((low, exact)).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, node, fp, size, buckets): the node stands for the text's shingle set."""

    def start():
        def f(batch: pa.RecordBatch) -> dict:
            own = [shingle_set(x) for x in texts(batch)]
            return {
                "doc_id": batch.column("doc_id"),
                "text_key": batch.column("text_key"),
                "node": np.array([node_of(x) for x in own], np.uint64).view(np.int64),
                "fp": np.array([simhash.majority(x) for x in own], np.uint64).view(np.int64),
                "size": [len(x) for x in own],
                "buckets": [buckets(x) for x in own],
            }

        return f

    rows = id_and_text(docs).withColumn("text_key", F.xxhash64("text"))
    return per_batch(rows, "doc_id long, text_key long, node long, fp long, size int, buckets array<long>", start)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted (node, least), read from the documents of those ids."""
    ids = wanted.select(F.col("least").alias("__least")).distinct()
    own = id_and_text(docs)
    own = own.join(ids.hint("merge"), own["doc_id"].eqNullSafe(ids["__least"]), "left_semi")

    def start():
        def f(batch: pa.RecordBatch) -> dict:
            sets = [shingle_set(x) for x in texts(batch)]
            nodes = np.array([node_of(x) for x in sets], np.uint64).view(np.int64)
            return {"node": nodes, "shingles": [x.view(np.int64) for x in sets]}

        return f

    return per_batch(own, "node long, shingles array<long>", start).dropDuplicates(["node"])


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) whose sets' similarity is at least percent / 100."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    either = F.size("sa") + F.size("sb") - common
    return pairs.join(one, "a").join(two, "b").filter(100 * common >= percent * either).select("a", "b")


def _nearest(q: np.ndarray, distance: np.ndarray, most: int | None) -> np.ndarray:
    """Indices of the ``most`` pairs of smallest distance of each q."""
    if most is None or not len(q):
        return np.arange(len(q))
    order = np.lexsort((distance, q))
    own = q[order]
    first = np.searchsorted(own, own)
    return order[np.arange(len(own)) - first < most]


class Postings:
    """Which of a tile's members hold each of their shingles' 32 bits."""

    def __init__(self, sketches: pa.Array):
        self.at = sketches.offsets.to_numpy()
        flat = sketches.values.to_numpy()[self.at[0] : self.at[-1]]
        self.at = self.at - self.at[0]
        self.size = np.diff(self.at)
        owner = np.repeat(np.arange(len(self.size)), self.size)
        order = np.argsort(flat, kind="stable")
        self.owner, held = owner[order], flat[order]
        self.low = np.searchsorted(held, flat)
        self.many = np.searchsorted(held, flat, "right") - self.low

    def similar(self, q: int, others: np.ndarray, percent: int) -> np.ndarray:
        """False for those whose sets cannot be of that similarity; equal bits only add to what is common."""
        low, many = self.low[self.at[q] : self.at[q + 1]], self.many[self.at[q] : self.at[q + 1]]
        ends = np.cumsum(many)
        where = np.arange(ends[-1]) + np.repeat(low - ends + many, many)
        common = np.bincount(self.owner[where], minlength=len(self.size))[others]
        return 100 * common >= percent * (self.size[q] + self.size[others] - common)


def _candidates(most: int | None, percent: int, small: int = 48):
    """Streams groups (bucket and tile pair); gives each node's ``most`` closest partners of another class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in simhash.whole_groups(batches, simhash.KEYS):
            fps = rows.column("fp").to_numpy().view(np.uint64)
            node, size, part, klass, tile_a, tile_b = (rows.column(c).to_numpy() for c in ("node", "size", "part", "class", "tile_a", "tile_b"))

            def chosen(a: np.ndarray, b: np.ndarray, both_ways: bool) -> pa.RecordBatch:
                low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
                ok = (klass[a] != klass[b]) & (100 * low >= percent * high)
                a, b = a[ok], b[ok]
                if both_ways:
                    a, b = np.concatenate((a, b)), np.concatenate((b, a))
                near = _nearest(a, np.bitwise_count(fps[a] ^ fps[b]), most)
                a, b = node[a[near]], node[b[near]]
                return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

            starts = np.flatnonzero(np.diff(group, prepend=-1))
            ends = np.append(starts[1:], len(group))
            lone = tile_a == tile_b
            exact = rows.column("mask").to_numpy() == BANDS
            few = np.repeat(ends - starts <= small, ends - starts) & lone
            for radius, which in ((RADIUS, few & ~exact), (64, few & exact)):
                if which.any():
                    at = np.flatnonzero(which)
                    a, b = simhash.links_in_sorted_runs(fps[at], group[at], radius)
                    yield chosen(at[a], at[b], True)
            for s, e in zip(starts[~few[starts]].tolist(), ends[~few[starts]].tolist(), strict=True):
                cut = s if lone[s] else s + int(np.searchsorted(part[s:e], 1))
                stop = e if lone[s] else cut
                held = Postings(rows.column("sketch").slice(s, e - s).combine_chunks()) if most is None else None
                for i in range(s, stop, 128):  # every row of a tile, or of the pair's first tile, is a query
                    q, m = simhash.links_across(fps[i : min(i + 128, stop)], fps[cut:e], 64 if exact[s] else RADIUS)
                    q, m = q + i, m + cut
                    if held is not None:
                        q, m = _sifted(held, q, m, klass, s, percent)
                    yield chosen(q, m, False)

    return run


def _sifted(held: Postings, q: np.ndarray, m: np.ndarray, klass: np.ndarray, start: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (sorted by q) of different classes that the postings do not rule out."""
    other = klass[q] != klass[m]
    q, m = q[other], m[other]
    keep = np.zeros(len(q), bool)
    first = np.flatnonzero(np.diff(q, prepend=-1))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(q)], strict=True):
        keep[a:b] = held.similar(int(q[a]) - start, m[a:b] - start, percent)
    return q[keep], m[keep]


def _joined(known: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) of the classes so far and the new links: only classes that these touch are walked again."""
    if known is None:
        return components(links)
    at = [known.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")) for x in ("a", "b")]
    between = links.join(at[0], "a", "left").join(at[1], "b", "left")
    between = between.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    merged = stored(components(between), "near-merged")
    to = merged.select(F.col("node").alias("component"), F.col("component").alias("new"))
    moved = known.join(to, "component", "left").select("node", F.coalesce("new", "component").alias("component"))
    return moved.unionAll(merged.join(known, "node", "left_anti").select("node", "component"))


def near_copies(docs: DataFrame, percent: int = 80, tile: int = 2048) -> DataFrame:
    """One row per row of docs: doc_id, text_key, node, component_id (the smallest doc_id reachable)
    and part (the class's own number)."""
    rows = stored(signatures(docs), "near-signatures")
    each = [F.any_value(c).alias(c) for c in ("fp", "size", "buckets")]
    nodes = stored(rows.groupBy("node").agg(F.min("doc_id").alias("least"), *each), "near-nodes")
    placed = nodes.select("node", "fp", "size", F.posexplode("buckets").alias("mask", "bucket"))
    placed = placed.withColumn("mask", F.least("mask", F.lit(BANDS)))  # exact buckets have no place in the set
    shared = placed.groupBy("mask", "bucket").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    members = stored(placed.join(shared, ["mask", "bucket"]), "near-members")
    sets = stored(_sets(docs, members.select("node").distinct().join(nodes, "node").select("node", "least")), "near-sets")

    checked = known = None
    klass = F.col("node")
    for most in ROUNDS:
        own = members
        if known is not None:
            own, klass = members.join(known, "node", "left"), F.coalesce("component", "node")
        columns = ("node", "fp", "size", "class")
        own = own.select("mask", "bucket", "node", "fp", "size", klass.alias("class"))
        mixed = (
            own.groupBy("mask", "bucket")
            .agg(F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high"))
            .filter("low <> high")
            .select("mask", "bucket", "n")
        )
        if most is None:
            columns += ("sketch",)
            own = own.join(mixed.select("mask", "bucket"), ["mask", "bucket"], "left_semi").join(
                sets.select("node", F.transform("shingles", lambda x: F.shiftright(x, 32).cast("int")).alias("sketch")), "node"
            )
        found = simhash.tiled(own, mixed, tile, columns)
        found = found.mapInArrow(_candidates(most, percent), "a long, b long").distinct()
        if checked is not None:
            found = found.join(checked, ["a", "b"], "left_anti")
        found = stored(found, "near-candidates")
        good = stored(_similar(found, sets, percent), "near-links")
        checked = found if checked is None else checked.unionAll(found)
        known = stored(_joined(known, good), "near-classes")

    part = F.coalesce("component", "node").alias("part")
    classes = nodes.join(known, "node", "left").select("node", "least", part)
    ids = classes.groupBy("part").agg(F.min("least").alias("component_id"))
    classes = stored(classes.join(ids, "part").select("node", "part", "component_id"), "near-ids")
    return rows.join(classes, "node").select("doc_id", "text_key", "node", "part", "component_id")


def drop_near_copies(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs, same columns, with one row of each class."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    kept = near_copies(docs, percent).groupBy("part").agg(first)
    # the ids grow with the texts: one way of joining at every size, on columns without nulls
    kept = stored(kept.select(F.coalesce("first.doc_id", F.lit(0)).alias("id"), "first.no_id", "first.text_key"), "near-kept")
    doc_id = F.col("doc_id").cast("long")
    wide = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(doc_id, F.lit(0)).alias("id"),
        doc_id.isNull().alias("no_id"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"),
    )
    key = ["id", "no_id", "text_key"]
    # what the join has dealt out by these columns needs no other shuffle to be told apart
    once = wide.join(kept.hint("merge"), key, "left_semi").groupBy(*key).agg(F.any_value("row").alias("row"))
    return once.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
