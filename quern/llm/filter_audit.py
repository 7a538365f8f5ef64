"""What each filter of a chain removes, in every order of the filters.

A filter's failures don't depend on the order, so one mask of failed filters a row tells the result of
all orders. Four filters look at a text alone; the last one, exact copies, looks at the whole table:
texts are routed as an RDD, partitioned by XXH64 and sorted by it, and each fingerprint's chain of full
texts, each with its least id, decides who is a copy. Before they are routed, a task's own copies are
settled among themselves (in chains of ``held`` bytes at most), so a text that a third of all rows
share is sent about once a task. combineByKey then merges vectors of counts by mask for each part, and
every order is read off those vectors.

Defined results:
* null text: empty; null part: the empty string; an empty table gives an empty result.
* a null id is no smaller or larger than any other: such a row is no copy and makes none.
* repeated rows: a copy needs a smaller id, so rows equal in id and text share their fate; all count.
* labels: a doc_id labelled more often counts as good or toxic if any of its rows says so.
* other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby, permutations

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Filter = Callable[[str, bytes, list[bytes]], bool]

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ODD = b"#$%&*|"


def short(text: str, raw: bytes, words: list[bytes]) -> bool:
    return len(words) < 50


def repetitive(text: str, raw: bytes, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < 65 * len(words)


def shouting(text: str, raw: bytes, words: list[bytes]) -> bool:
    return 100 * (len(raw) - len(raw.translate(None, UPPER))) > 5 * len(text)


def odd_symbols(text: str, raw: bytes, words: list[bytes]) -> bool:
    return len(raw) != len(raw.translate(None, ODD))


#: Bytes of text that a routed partition gets, as the corpus's counted size deals them out.
ROUTED = 64 << 20

#: By letter; the letter after the last one here stands for exact copies.
FILTERS: dict[str, Filter] = {"A": short, "B": repetitive, "C": shouting, "D": odd_symbols}
COPY = "E"

REPORT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def _failed(text: str, raw: bytes, filters: list[Filter]) -> int:
    words = raw.split()  # bytes split at [\x20\x09-\x0D] alone
    return sum(1 << i for i, f in enumerate(filters) if f(text, raw, words))


class Chains:
    """Texts by fingerprint, each with its least id seen and the rows of that id.

    Rows that lose, since a smaller id has their text, are returned as (id, part, mask, rows).
    """

    def __init__(self, copy: int):
        self.copy, self.chains, self.held = copy, {}, 0

    def add(self, key: int, raw: bytes, doc: int, mask: int, parts: Counter) -> list[tuple]:
        chain = self.chains.setdefault(key, [])
        for link in chain:
            if link[0] == raw:
                if doc == link[1]:
                    link[3] += parts
                    return []
                if doc > link[1]:
                    return self._lost(doc, mask, parts)
                out = self._lost(link[1], link[2], link[3])
                link[1:] = [doc, mask, parts]
                return out
        chain.append([raw, doc, mask, parts])
        self.held += len(raw) + 200
        return []

    def _lost(self, doc: int, mask: int, parts: Counter) -> list[tuple]:
        return [(doc, part, mask | self.copy, n) for part, n in parts.items()]

    def drain(self) -> Iterator[tuple]:
        """key, text, least id, mask, parts of every text held."""
        chains, self.chains, self.held = self.chains, {}, 0
        for key, chain in chains.items():
            for link in chain:
                yield (key, *link)


def masks(
    docs: DataFrame,
    filters: dict[str, Filter] = FILTERS,
    part: str = "source",
    fingerprint: Callable[[bytes], int] = xxhash.xxh64_intdigest,
    held: int = 32 << 20,
) -> DataFrame:
    """doc_id, part, mask (bit i: fails filter i; the last bit: an exact copy of a smaller id) and rows alike."""
    spark = docs.sparkSession
    copy, tests = 1 << len(filters), list(filters.values())
    rows = docs.select(
        F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")), F.coalesce(F.col(part).cast("string"), F.lit(""))
    ).rdd

    def settled(own):
        """(fingerprint, row with its text) for texts to be routed; (any key, row without one) for known ones."""
        chains, alone = Chains(copy), Counter()
        for doc, text, where in own:
            raw = text.encode()
            mask = _failed(text, raw, tests)
            if doc is None:
                alone[where, mask] += 1
                continue
            for lost in chains.add(fingerprint(raw), raw, doc, mask, Counter({where: 1})):
                yield xxhash.xxh64_intdigest(str(lost[0])), (None, *lost)
            if chains.held > held:
                for key, *link in chains.drain():
                    yield key, tuple(link)
        for key, *link in chains.drain():
            yield key, tuple(link)
        for i, ((where, mask), n) in enumerate(alone.items()):
            yield i, (None, None, where, mask, n)

    def resolved(own):
        for _, same in groupby(own, key=lambda x: x[0]):
            chains = Chains(copy)
            for key, (raw, *rest) in same:
                yield from [tuple(rest)] if raw is None else chains.add(key, raw, *rest)
            for _, _, doc, mask, parts in chains.drain():
                for where, n in parts.items():
                    yield doc, where, mask, n

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(-(-size // ROUTED), int(spark.conf.get("spark.sql.shuffle.partitions")))
    routed = rows.mapPartitions(settled).repartitionAndSortWithinPartitions(n, lambda key: key)
    return spark.createDataFrame(
        routed.mapPartitions(resolved), "doc_id long, part string, mask int, n long", verifySchema=False
    )


def count_vectors(rows: DataFrame, labels: DataFrame, size: int):
    """An RDD of (part, [rows by mask, then good ones by mask, then toxic ones by mask])."""
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    marked = rows.join(marks, "doc_id", "left").select("part", "mask", "n", "good", "toxic")

    def merge(own: list[int], x) -> list[int]:
        mask, n, good, toxic = x
        own[mask] += n
        if good:
            own[size + mask] += n
        if toxic:
            own[2 * size + mask] += n
        return own

    def both(a: list[int], b: list[int]) -> list[int]:
        return [x + y for x, y in zip(a, b, strict=True)]

    return marked.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(lambda x: merge([0] * (3 * size), x), merge, both)


def orders(letters: str, counts: list[int]) -> Iterator[tuple]:
    """filter_order, step and the report's counts, for every order of the filters."""
    size = 1 << len(letters)
    rows, good, toxic = counts[:size], counts[size : 2 * size], counts[2 * size :]
    every = [*permutations(range(len(letters)))]
    # of all orders, each failed filter of a mask comes first among them equally often
    share = [0] * len(letters)
    for mask in range(1, size):
        for i in range(len(letters)):
            if mask >> i & 1:
                share[i] += rows[mask] * len(every) // mask.bit_count()
    for order in every:
        before = 0
        for step, i in enumerate(order, 1):
            fails = [m for m in range(size) if m >> i & 1]
            first = [m for m in fails if not m & before]
            upto = before | 1 << i
            yield (
                "".join(letters[k] for k in order), step,
                sum(rows[m] for m in range(size) if not m & upto),
                sum(rows[m] for m in first), sum(rows[m] for m in fails) - sum(rows[m] for m in first),
                rows[1 << i], sum(good[m] for m in first), sum(toxic[m] for m in first), share[i],
            )
            before = upto


def audit(
    docs: DataFrame,
    labels: DataFrame,
    filters: dict[str, Filter] = FILTERS,
    copy: str = COPY,
    part: str = "source",
    fingerprint: Callable[[bytes], int] = xxhash.xxh64_intdigest,
    held: int = 32 << 20,
) -> DataFrame:
    """For each part, order of the filters and step: what is kept, removed, redundant, and lost of the good and toxic."""
    letters = "".join(filters) + copy
    vectors = count_vectors(masks(docs, filters, part, fingerprint, held), labels, 1 << len(letters))
    rows = vectors.flatMap(lambda x: ((x[0], *y) for y in orders(letters, x[1])))
    return docs.sparkSession.createDataFrame(rows, REPORT, verifySchema=False)
