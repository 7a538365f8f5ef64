"""SimHash near-dedup with bit-sliced comparison.

Fingerprints are compared only within buckets that share two of five bit blocks (three differing
bits touch three blocks at most, so every link shares a bucket). In a bucket, fingerprints are
stored as 64 vertical bit planes; carry-save counters update the distances of 64 lanes with a few
word operations a plane, and lanes' blocks are abandoned once all their distances exceed the
radius. Buckets over ``tile`` fingerprints are cut into tiles and spread as tile pairs, so that no
task gathers a group; each task returns a star per connected set, never all pairs.

Equal fingerprints are merged before any comparison; classes come from distributed connected
components over the distinct ones, so rows that share a fingerprint share a component.

Defined results:
* null or empty text, or blanks only: fingerprint zero, linked like any other.
* ties and repeated rows: one result row for each input row.
* null doc_id: links like any other row; never a component's id unless a component has no other,
  then it is null. A doc_id whose rows have different texts is in the component of each.
* other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import id_and_text, per_batch, texts
from quern.llm.components import components
from quern.session import stored

BITS = 64


def shingle_hashes(text: str, width: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``width`` words, repeats included (fewer words: the whole sequence)."""
    words = text.encode().lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), len(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, n - width + 1)


def majority(hashes: np.ndarray, block: int = 1 << 15) -> int:
    """The bits that are set in over half the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), block):
        part = hashes[i : i + block].astype("<u8").view(np.uint8)
        # sums of at most 255 rows fit a byte, so most of the adding is done on bytes
        bits = np.unpackbits(part, bitorder="little").reshape(-1, BITS)
        cut = len(bits) // 240 * 240
        if cut:
            ones += bits[:cut].reshape(-1, 240, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[cut:].sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in range(BITS) if 2 * ones[i] > len(hashes)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def start():
        def f(batch: pa.RecordBatch) -> dict:
            fps = np.array([majority(shingle_hashes(x)) for x in texts(batch)], np.uint64)
            return {"doc_id": batch.column("doc_id"), "fp": fps.view(np.int64)}

        return f

    return per_batch(id_and_text(docs), "doc_id long, fp long", start)


def planes(fps: np.ndarray) -> np.ndarray:
    """64 x ceil(n / 64) words: word w of plane i has bit i of the fingerprints 64w .. 64w+63."""
    lanes = -len(fps) % 64
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, BITS).T
    bits = np.pad(bits, ((0, 0), (0, lanes)))
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view("<u8")


def lanes_within(diff: list[np.ndarray] | np.ndarray, radius: int, check_every: int = 8) -> np.ndarray:
    """Words whose bits mark the lanes with ``radius`` or fewer set bits over the planes of diff.

    diff: 64 planes of the same shape. Distances are kept as bitwise counters with a sticky
    overflow; words in which every lane is over the radius are dropped as soon as that is seen.
    """
    shape = diff[0].shape
    rows = [np.asarray(x).reshape(-1) for x in diff]
    alive = np.arange(rows[0].size)
    width = radius.bit_length()
    counters = [np.zeros(alive.size, np.uint64) for _ in range(width)]
    over = np.zeros(alive.size, np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.zeros(rows[0].size, np.uint64)
    for i, row in enumerate(rows):
        carry = row[alive] if alive.size != row.size else row
        for c in counters:
            both = c & carry
            c ^= carry
            carry = both
        over |= carry
        if i % check_every == check_every - 1:
            keep = over != full
            if not keep.all():
                alive, over, counters = alive[keep], over[keep], [c[keep] for c in counters]
                if not alive.size:
                    return out.reshape(shape)
    # a count without overflow may still exceed a radius that is not 2^k - 1
    more, equal = np.zeros_like(over), np.full_like(over, full)
    for k in range(width - 1, -1, -1):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            more |= equal & counters[k]
            equal &= ~counters[k]
    out[alive] = ~(over | more)
    return out.reshape(shape)


def _lane_bits(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.astype("<u8").view(np.uint8), bitorder="little")[:n].astype(bool)


def links_in_sorted_runs(fps: np.ndarray, run: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the radius, among equal values of ``run`` (which is grouped)."""
    a, b = [], []
    shift = 1
    while len(fps) > shift:
        left = np.flatnonzero(run[shift:] == run[:-shift])
        if not left.size:
            break
        near = _lane_bits(lanes_within(planes(fps[left] ^ fps[left + shift]), radius), left.size)
        a.append(left[near])
        b.append(left[near] + shift)
        shift += 1
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def links_across(queries: np.ndarray, tile: np.ndarray, radius: int, block: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, tile member) within the radius; the tile's planes are built once."""
    vertical = planes(tile)
    a, b = [], []
    for i in range(0, len(queries), block):
        own = queries[i : i + block].astype(np.uint64)
        diff = [
            plane[None, :] ^ (np.uint64(0) - ((own >> np.uint64(k)) & np.uint64(1)))[:, None]
            for k, plane in enumerate(vertical)
        ]
        near = lanes_within(diff, radius)
        q, w = np.nonzero(near)
        bits = np.unpackbits(near[q, w].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        hit, lane = np.nonzero(bits)
        member = w[hit] * 64 + lane
        real = member < len(tile)
        a.append(q[hit][real] + i)
        b.append(member[real])
    return np.concatenate(a), np.concatenate(b)


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index connected to each of n items by the index pairs."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _star_edges(fps: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = stars(len(fps), a, b)
    own = np.flatnonzero(low != np.arange(len(fps)))
    return fps[own].view(np.int64), fps[low[own]].view(np.int64)


def block_masks(radius: int) -> list[int]:
    """Masks of which every two fingerprints within the radius agree on one at least."""
    n = radius + 2
    cuts = [round(BITS * i / n) for i in range(n + 1)]
    blocks = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(n)]
    return [sum(x) for x in combinations(blocks, n - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: What a group of rows that are compared with one another shares.
KEYS = ("mask", "bucket", "tile_a", "tile_b")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by the keys, cut between groups only, with the number of each row's group."""

    def numbered(rows: pa.Table) -> np.ndarray:
        new = np.zeros(rows.num_rows, bool)
        for c in keys:
            x = rows.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.cumsum(new)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held)
        group = numbered(rows)
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            yield rows.slice(0, cut), group[:cut]
        held = rows.slice(cut).combine_chunks().to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        yield rows, numbered(rows)


def _compare(radius: int):
    """Streams rows sorted by bucket and tile pair; only one bucket's rows are held at a time."""

    def links(run: np.ndarray, part: np.ndarray, lone: np.ndarray, fps: np.ndarray, small: int):
        """part: which tile of a tile pair; lone: the pair is a tile with itself."""
        out = []
        ends = np.flatnonzero(np.diff(run)) + 1
        starts, ends = np.concatenate(([0], ends)), np.concatenate((ends, [len(run)]))
        size = ends - starts
        few = np.repeat((size <= small) & lone[starts], size)
        if few.any():
            out.append(_star_edges(fps[few], *links_in_sorted_runs(fps[few], run[few], radius)))
        for s, e in zip(starts[~((size <= small) & lone[starts])], ends[~((size <= small) & lone[starts])], strict=True):
            own = fps[s:e]
            if lone[s]:
                out.append(_star_edges(own, *links_across(own, own, radius)))
            else:
                cut = int(np.searchsorted(part[s:e], 1))
                if 0 < cut < e - s:
                    a, b = links_across(own[:cut], own[cut:], radius)
                    out.append(_star_edges(own, a, b + cut))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in whole_groups(batches, KEYS):
            fps = rows.column("fp").to_numpy().view(np.uint64)
            lone = rows.column("tile_a").to_numpy() == rows.column("tile_b").to_numpy()
            for a, b in links(group, rows.column("part").to_numpy(), lone, fps, 48):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def tiled(rows: DataFrame, shared: DataFrame, tile: int, columns: tuple[str, ...]) -> DataFrame:
    """rows of the buckets in shared (mask, bucket, n), dealt out by bucket and pair of tiles and sorted by it.

    part is 0 for the rows of the first tile of a pair, 1 for those of the second.
    """
    own = F.expr(f"cast(pmod(xxhash64({columns[0]}), tiles) as int)")
    placed = (
        rows.join(shared, ["mask", "bucket"])
        .withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(
            "mask",
            "bucket",
            F.least("own", "other").alias("tile_a"),
            F.greatest("own", "other").alias("tile_b"),
            (F.col("own") > F.col("other")).cast("int").alias("part"),
            *columns,
        )
    )
    return placed.repartition(*KEYS).sortWithinPartitions(*KEYS, "part")


def fingerprint_links(fps: DataFrame, radius: int = 3, tile: int = 2048) -> DataFrame:
    """(a, b): links that connect every two of the distinct fingerprints ``fp`` within the radius."""
    masks = [F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bucket")) for i, m in enumerate(block_masks(radius))]
    rows = fps.select("fp", F.explode(F.array(*masks)).alias("m")).select("fp", "m.mask", "m.bucket")
    shared = rows.groupBy("mask", "bucket").agg(F.count("*").alias("n")).filter("n > 1")
    return tiled(rows, shared, tile, ("fp",)).mapInArrow(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 3, tile: int = 2048) -> DataFrame:
    """One row per row of docs: doc_id, fp (signed long), component_id (smallest doc_id reachable)."""
    rows = stored(fingerprints(docs), "simhash")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    classes = components(fingerprint_links(nodes.select("fp"), radius, tile))
    # classes are of fingerprints, so rows without a doc_id link others too
    known = nodes.join(classes, nodes["fp"] == classes["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("part"))
    known = stored(known, "simhash-parts")
    ids = known.groupBy("part").agg(F.min("least").alias("component_id"))
    known = stored(known.join(ids, "part").select("fp", "component_id"), "simhash-classes")
    return rows.join(known, "fp").select("doc_id", "fp", "component_id")


def hex16(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
