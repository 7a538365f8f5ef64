"""Best-fit packing by a grouping genetic algorithm on islands.

Tokenising never shuffles text: each document gives small rows (piece, start, length, checksum).
The pieces are dealt into shards of about ``shard_size`` by row, not by key, so a repeated or hot
document spreads. Each shard is evolved on several islands (after Falkenauer's grouping genetic
algorithm, 1996): crossover injects whole well-filled sequences of one parent into another, removes
the sequences that hold duplicates, and best-fits the displaced pieces; between two epochs every
island of a ring of three or more receives its neighbour's elite. A shard that reaches the lower bound ceil(tokens / capacity)
is proven optimal and stops.

Defined results:
* null or empty text: one piece, the end id alone.
* repeated rows and null ids: every row is packed; pieces of equal rows are packed as often.
* only documents over the capacity are cut; all pieces but a document's last are full.
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import random
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import id_and_text, per_batch, resident, tokenizer_path
from quern.session import stored

END = (0).to_bytes(4, "little")


class Ids(dict):
    """chunk of lower-case bytes without ASCII blanks -> its ids as little-endian words.

    The tokenizer splits at white space and lower-cases letter by letter, so a text's ids are those
    of its chunks in order; each chunk is encoded when it is first missing. ``plain`` says whether the
    file also keeps ASCII letters together and apart from a full stop or comma after them.
    At most ``memory`` chunks are kept, of 64 bytes at most each.
    """

    def __init__(self, path: str, memory: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.memory = Tokenizer.from_file(path), memory
        self.merge = self.tokenizer.model.tokenize
        same = self.tokenizer.encode_batch(["Ab cde.", "ab", "cde", "."], add_special_tokens=False)
        if same[0].ids != same[1].ids + same[2].ids + same[3].ids:
            raise ValueError(f"{path}: not a tokenizer that lower-cases and splits at white space")
        parts = [self.merge("abcde"), self.tokenizer.encode("abcde", add_special_tokens=False)]
        self.plain = [t.id for t in parts[0]] == parts[1].ids

    def __missing__(self, chunk: bytes) -> bytes:
        # only letters and odd chunks are kept: others are put together from them
        if self.plain and chunk.isalpha():  # ASCII letters: one pre-token, whose bytes stand for themselves
            ids = array("I", [t.id for t in self.merge(chunk.decode())]).tobytes()
        elif self.plain and chunk[-1:] in (b".", b",") and chunk[:-1].isalpha():  # two pre-tokens
            return self[chunk[:-1]] + self[chunk[-1:]]
        else:
            ids = array("I", self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids).tobytes()
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids

    def of(self, text: bytes) -> bytes:
        if len(self) > self.memory:
            self.clear()
        return b"".join(map(self.__getitem__, text.lower().split())) + END


def pieces(docs: DataFrame, path: str | None = None, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for every piece of every row."""
    path = path or tokenizer_path("word_bpe_49k.json")

    def start():
        ids = resident(("packing", path), lambda: Ids(path))

        def f(batch: pa.RecordBatch) -> dict:
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                own = ids.of(text)
                for k, at in enumerate(range(0, len(own), 4 * capacity)):
                    part = own[at : at + 4 * capacity]
                    for name, v in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        out[name].append(v)
            return out

        return f

    return per_batch(id_and_text(docs), "doc_id long, piece int, start long, length long, ids_crc32 long", start)


class Bins:
    """Sequences as lists of items, with best fit by a bit set of the free space in use."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.items: list[list[int]] = []
        self.free: list[int] = []
        self.with_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.set = 0

    def add(self, items: list[int], free: int) -> None:
        self.items.append(items)
        self.free.append(free)
        self.with_free[free].append(len(self.items) - 1)
        self.set |= 1 << free

    def best_fit(self, item: int) -> None:
        n = self.lengths[item]
        fits = self.set >> n
        if not fits:
            self.add([item], self.capacity - n)
            return
        free = (fits & -fits).bit_length() - 1 + n
        same = self.with_free[free]
        k = same.pop()
        if not same:
            self.set ^= 1 << free
        self.items[k].append(item)
        self.free[k] = left = free - n
        self.with_free[left].append(k)
        self.set |= 1 << left

    def fitness(self) -> tuple[int, int]:
        """Fewer sequences first, then the unevenness of what is free."""
        return len(self.items), -sum(f * f for f in self.free)


def best_fit(order: list[int], lengths: list[int], capacity: int) -> Bins:
    out = Bins(lengths, capacity)
    for i in order:
        out.best_fit(i)
    return out


def cross(giver: Bins, taker: Bins, rng: random.Random) -> Bins:
    """Whole well-filled sequences of ``giver`` go into ``taker``."""
    full = sorted(range(len(giver.items)), key=giver.free.__getitem__)
    full = full[: max(1, len(full) // 2)]
    chosen = [k for k in full if rng.random() < 0.7] or full[:1]
    taken = {i for k in chosen for i in giver.items[k]}
    out = Bins(taker.lengths, taker.capacity)
    for k in chosen:
        out.add(list(giver.items[k]), giver.free[k])
    displaced = []
    for items, free in zip(taker.items, taker.free, strict=True):
        left = [i for i in items if i not in taken]
        if len(left) == len(items):
            out.add(list(items), free)
        else:
            displaced += left
    for i in sorted(displaced, key=taker.lengths.__getitem__, reverse=True):
        out.best_fit(i)
    return out


def mutate(one: Bins, rng: random.Random) -> Bins:
    """Empties the worst sequences and some others, then best-fits their items."""
    worst = sorted(range(len(one.items)), key=one.free.__getitem__, reverse=True)
    gone = set(worst[: max(1, len(worst) // 50)]) | {k for k in range(len(one.items)) if rng.random() < 0.02}
    out, loose = Bins(one.lengths, one.capacity), []
    for k, items in enumerate(one.items):
        if k in gone:
            loose += items
        else:
            out.add(list(items), one.free[k])
    rng.shuffle(loose)
    for i in sorted(loose, key=lambda i: one.lengths[i] >> 3, reverse=True):
        out.best_fit(i)
    return out


def from_labels(labels: list[int], lengths: list[int], capacity: int) -> Bins:
    items: dict[int, list[int]] = {}
    for i, k in enumerate(labels):
        items.setdefault(k, []).append(i)
    out = Bins(lengths, capacity)
    for own in items.values():
        out.add(own, capacity - sum(lengths[i] for i in own))
    return out


def labels_of(one: Bins) -> list[int]:
    out = [0] * len(one.lengths)
    for k, items in enumerate(one.items):
        for i in items:
            out[i] = k
    return out


def evolve(
    lengths: list[int], capacity: int, seed: int, elites: list[list[int]] = (), population: int = 4, generations: int = 4
) -> Bins:
    """The best packing found; stops at the lower bound."""
    rng = random.Random(seed)
    bound = -(-sum(lengths) // capacity)
    order = sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True)
    people = [from_labels(x, lengths, capacity) for x in elites] or [best_fit(order, lengths, capacity)]
    while len(people) < population and min(len(x.items) for x in people) > bound:
        grain = rng.choice((4, 16, 64))
        rough = sorted(order, key=lambda i: (lengths[i] // grain, rng.random()), reverse=True)
        people.append(best_fit(rough, lengths, capacity))
    for _ in range(generations):
        people.sort(key=Bins.fitness)
        if len(people[0].items) <= bound:
            break
        best = people[: max(2, population // 2)]
        young = [cross(rng.choice(best), rng.choice(best), rng) for _ in range(population - 1)]
        people = [people[0], *(mutate(x, rng) if rng.random() < 0.5 else x for x in young)]
    return min(people, key=Bins.fitness)




def _epoch(rows: DataFrame, capacity: int, seed: int) -> DataFrame:
    """rows: shard, island, lengths, elites -> shard, island, labels, n."""

    def start():
        def f(batch: pa.RecordBatch) -> dict:
            out = {"shard": [], "island": [], "labels": [], "n": []}
            for r in batch.select(["shard", "island", "lengths", "elites"]).to_pylist():
                best = evolve(r["lengths"], capacity, hash((seed, r["shard"], r["island"])), r["elites"])
                for k, v in zip(out, (r["shard"], r["island"], labels_of(best), len(best.items)), strict=True):
                    out[k].append(v)
            return out

        return f

    return per_batch(rows, "shard long, island int, labels array<int>, n int", start)


def pack(
    docs: DataFrame, path: str | None = None, capacity: int = 2048, shard_size: int = 4096, islands: int = 3, seed: int = 1
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row."""
    own = stored(pieces(docs, path, capacity), "pieces")
    shards = max(1, -(-own.count() // shard_size))
    item = F.struct("doc_id", "piece", "start", "length", "ids_crc32")
    # dealt by row number, not by key: equal rows spread over the shards
    dealt = (
        own.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("long"))
        .groupBy("shard")
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
    )
    dealt = stored(dealt, "pack-shards")
    lengths = dealt.select("shard", F.transform("items", lambda x: x["length"].cast("int")).alias("lengths"))
    every = F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island")
    none = F.array().cast("array<array<int>>")
    spread = ["shard", "island"]
    first = _epoch(
        lengths.select("shard", "lengths", every).withColumn("elites", none).repartition(*spread), capacity, seed
    )
    first = stored(first, "pack-epoch")
    # migration: each island starts again from its own elite and its neighbour's
    elites = first.select("shard", "island", "labels").unionAll(
        first.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), "labels")
    )
    again = (
        elites.groupBy("shard", "island").agg(F.collect_list("labels").alias("elites")).join(lengths, "shard")
    )
    second = _epoch(again.select("shard", "island", "lengths", "elites"), capacity, seed + 1)
    best = second.groupBy("shard").agg(F.min_by("labels", F.struct("n", "island")).alias("labels"))
    chosen = dealt.join(best, "shard")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at: dict[int, int] = {}
                out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")}
                for x, k in zip(r["items"], r["labels"], strict=True):
                    offset = at.get(k, 0)
                    at[k] = offset + x["length"]
                    for name in ("doc_id", "piece", "start", "length", "ids_crc32"):
                        out[name].append(x[name])
                    out["sequence_id"].append((r["shard"] << 24) + k)
                    out["offset"].append(offset)
                kinds = {"piece": pa.int32()}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, type=kinds.get(k, pa.int64())) for k, v in out.items()], names=list(out)
                )

    return chosen.select("shard", "items", "labels").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
