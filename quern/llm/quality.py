"""Quality rules: word rules, then n-gram perplexity bands by language.

Spark counts character 4-grams over every document, on a fixed alphabet of 48 classes, and beside them which
letter of its class follows which (chargrams). Modified Kneser-Ney models are made of both and stored in sorted hash
arrays; since the alphabet and Unicode bound the models, they may be broadcast, and a worker looks each 4-gram up when
it first meets it. Together they give every letter of any script its own probability. Characters spell the
words; a cache of the document's own last eight words is mixed in, so that a word said again costs
few bits: the model sees repetition at any vocabulary, without word counts that grow past a bound.

Every document gets its bits per word (the binary logarithm of its perplexity). For each language, the median and the two quartiles'
distances from it, as spreads below and above, give a lower and an upper band, widened for short
documents by the sampling error of their mean; documents outside are rejected.

Defined results:
* null or empty text: no words; base_failed, so not kept.
* null lang: a language of its own. Every language is judged: its bands are drawn towards those of
  all documents as if by ``PRIOR`` more documents of them, so a count has no threshold.
* repeated rows and null ids: one result row for each input row.
* very long texts are scored whole, in arrays of a million characters; their words are one list.
"""

from __future__ import annotations

import uuid
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from quern.llm import chargrams as cg
from quern.llm.common import BLANK, per_batch, resident, texts
from quern.session import stored

SYMBOLS = "#*$%&|<>"
_NEWLINE = int(cg.classes("\n")[0])
_MIX = np.random.default_rng(20).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def repeat_words(words: list[bytes], width: int = 8) -> int:
    """Words inside windows of ``width`` words that occur twice or more, first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    w = np.zeros(n, np.uint64)
    for j in range(width):
        w += (h[j : j + n] ^ (h[j : j + n] >> np.uint64(29))) * _MIX[j]
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def word_rules(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANK)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


def _hashed(code: np.ndarray) -> np.ndarray:
    """A 64-bit mix of n-gram codes (splitmix64's finaliser); one to one."""
    x = code.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class HashArray:
    """Values by n-gram code, as arrays sorted by the code's hash."""

    def __init__(self, code: np.ndarray, value: np.ndarray):
        h = _hashed(code)
        order = np.argsort(h)
        self.keys, self.values = h[order], value[order].astype(np.float32)

    def get(self, code: np.ndarray, default: float) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(code), default, np.float32)
        h = _hashed(code)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.values[at], np.float32(default))


#: The share of the document's own cache, and what each of its last words weighs in it, last first.
CACHE = 0.3
_RECENT = 0.5 ** np.arange(1, 9) / (1 - 0.5**8)


def spelt_words(text: str, bits: Remembered) -> np.ndarray:
    """The bits of each word's characters with the blanks after it (the first one also has those before it)."""
    found: list[np.ndarray] = []
    lead, in_word, at = 0.0, False, 0
    members, plain = bits.model.members, text.isascii()
    for code in cg.codes(text):
        bit = bits(code).astype(np.float64)
        if members and not plain:
            where, pair = cg.told(text, at, at + len(code))
            bit[where] += members.bits(pair)
        at += len(code)
        last = code % cg.SIZE
        inside = (last != 0) & (last != _NEWLINE)
        first = np.flatnonzero(inside & ~np.concatenate(([in_word], inside[:-1])))
        head = float(bit[: first[0] if len(first) else len(bit)].sum())
        if found:
            found[-1][-1] += head
        else:
            lead += head
        if len(first):
            found.append(np.add.reduceat(bit, first))
        in_word = bool(inside[-1])
    if not found:
        return np.zeros(0)
    found[0][0] += lead
    return np.concatenate(found)


def scored(text: str, bits: Remembered) -> tuple[float, float]:
    """Bits per word, and the variance of a word's bits. A text without words has none."""
    words = text.encode().split()
    n = len(words)
    if not n:
        return 0.0, 0.0
    spelt = spelt_words(text, bits)
    h = np.fromiter(map(hash, words), np.int64, n)
    again = np.zeros(n)
    for j, share in enumerate(_RECENT[: n - 1], 1):
        again[j:] += share * (h[j:] == h[:-j])
    with np.errstate(divide="ignore"):
        word = -np.logaddexp2(np.log2(1 - CACHE) - spelt, np.log2(CACHE * again))
    return float(word.mean()), float(word.var())


def discounted(c: np.ndarray, m: np.ndarray, context: np.ndarray) -> tuple[HashArray, HashArray]:
    """What each n-gram keeps after discounting, and what its context passes down."""
    tally = [int((m == i).sum()) for i in (1, 2, 3, 4)]
    y = tally[0] / (tally[0] + 2 * tally[1]) if tally[0] else 0.5
    d = [0.0] + [
        min(max(i - (i + 1) * y * tally[i] / tally[i - 1], 0.05), i - 0.05) if tally[i - 1] else min(0.5, i / 2)
        for i in (1, 2, 3)
    ]
    cut = np.array(d)[np.minimum(m, 3)]
    context, where = np.unique(context, return_inverse=True)
    total = np.bincount(where, weights=m, minlength=len(context))
    lost = np.bincount(where, weights=cut, minlength=len(context))
    return HashArray(c, (m - cut) / np.maximum(total[where], 1)), HashArray(context, lost / np.maximum(total, 1))


class Members:
    """Which character of its class: the row after the character before, then the place in the row, each a
    modified Kneser-Ney of order 2 over a uniform choice."""

    #: where the context begins in a code, and the bits of what is told
    _ROW, _PLACE = (cg.CONTEXT_OF_ROW, 15), (cg.CONTEXT_OF_PLACE, 6)

    def __init__(self, rows: tuple[np.ndarray, np.ndarray], places: tuple[np.ndarray, np.ndarray]):
        self.rows = self._orders(*rows, *self._ROW)
        self.places = self._orders(*places, *self._PLACE)

    @staticmethod
    def _orders(code: np.ndarray, n: np.ndarray, high: int, low: int):
        """(kept, passed) without and with the character before."""
        short, count = np.unique(code & ((1 << high) - 1), return_counts=True)
        return [discounted(c, m, c >> low) for c, m in ((short, count), (code, n))]

    def bits(self, pair: np.ndarray) -> np.ndarray:
        """-log2 of the probability of the second code point of each pair among its class, after the first."""
        pair, where = np.unique(pair, return_inverse=True)
        bit = np.zeros(len(pair), np.float32)
        for kind, at, code, choices in cg.members(pair):
            orders, high, low = (self.rows, *self._ROW) if kind == cg.ROW_BIT else (self.places, *self._PLACE)
            p = (1 / choices).astype(np.float32)
            for (kept, passed), own in zip(orders, (code & ((1 << high) - 1), code), strict=True):
                p = kept.get(own, 0.0) + passed.get(own >> low, 1.0) * p
            bit[at] -= np.log2(np.maximum(p, 1e-9))
        return bit[where]


class KneserNey:
    """Modified Kneser-Ney of order 4, interpolated, from 4-gram counts; with members, of characters, else of classes."""

    members: Members | None = None

    def __init__(self, code: np.ndarray, n: np.ndarray):
        #: by order: what an n-gram keeps after discounting, and what its context passes down
        self.kept: list[HashArray] = []
        self.passed: list[HashArray] = []
        per_order = [(code, n)]
        for k in range(cg.ORDER - 1, 0, -1):
            # below the top, an n-gram counts the distinct characters before it
            short, count = np.unique(per_order[0][0] % cg.SIZE**k, return_counts=True)
            per_order.insert(0, (short, count))
        for c, m in per_order:
            kept, passed = discounted(c, m, c // cg.SIZE)
            self.kept.append(kept)
            self.passed.append(passed)

    def bits(self, code: np.ndarray) -> np.ndarray:
        """-log2 of the probability of each 4-gram's last character after the others."""
        p = np.full(len(code), 1 / cg.SIZE, np.float32)
        for k in range(1, cg.ORDER + 1):
            own = code % cg.SIZE**k
            p = self.kept[k - 1].get(own, 0.0) + self.passed[k - 1].get(own // cg.SIZE, 1.0) * p
        return -np.log2(np.maximum(p, 1e-9)).astype(np.float32)


class Remembered:
    """A model's bits; each 4-gram is looked up in the hash arrays when a worker first meets it."""

    def __init__(self, model: KneserNey):
        self.model = model
        self.known = np.full(cg.SIZE**cg.ORDER, np.nan, np.float32)

    def __call__(self, code: np.ndarray) -> np.ndarray:
        bit = self.known[code]
        new = np.isnan(bit)
        if new.any():
            missing = np.unique(code[new])
            self.known[missing] = self.model.bits(missing)
            bit = self.known[code]
        return bit


def train(docs: DataFrame) -> KneserNey:
    grams, rows, places = cg.collected(cg.count_characters(docs))
    model = KneserNey(*grams)
    model.members = Members(rows, places)
    return model


def measured(docs: DataFrame, model: KneserNey, carry: bool = False) -> DataFrame:
    """For each row: row (its doc_id, or with carry all its columns), lang, the word rules, bits per
    word and their variance."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded, see chargrams
    own_key = uuid.uuid4().hex
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    lang = F.coalesce(F.col("lang"), F.lit("")).alias("lang")
    if carry:  # the text goes to the worker once, inside its row
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), lang)
    else:
        only = F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("row")
        rows = docs.select(only, F.coalesce(F.col("text"), F.lit("")).alias("text"), lang)

    def start():
        bits = resident(own_key, lambda: Remembered(shared.value))

        def f(b: pa.RecordBatch) -> dict:
            own = [x or "" for x in pc.struct_field(b.column("row"), "text").to_pylist()] if carry else texts(b)
            rules = list(zip(*map(word_rules, own), strict=True))
            mean, var = zip(*(scored(text, bits) for text in own), strict=True)
            return {"row": b.column("row"), "lang": b.column("lang"), "bits": mean, "bit_var": var} | dict(
                zip(names, rules, strict=True)
            )

        return f

    kinds = StructType([StructField("row", rows.schema["row"].dataType), StructField("lang", StringType())])
    for name in names:
        kinds.add(name, LongType())
    return per_batch(rows, kinds.add("bits", DoubleType()).add("bit_var", DoubleType()), start)


#: How many documents the bands of all documents weigh in a language's own.
PRIOR = 20


def bands(scores: DataFrame) -> DataFrame:
    """lang, middle, spreads under and over it, and noise over the documents of a language that pass
    the word rules, each drawn towards the value over all documents."""
    names = ("middle", "under", "over", "noise")
    passing = scores.filter(~_base_failed())

    def measures(rows, prefix: str) -> DataFrame:
        q = F.percentile_approx("bits", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10000)
        found = rows.agg(q.alias("q"), F.avg("bit_var").alias("noise"), F.count("*").alias("n"))
        return found.withColumns({
            "middle": F.col("q")[1],
            "under": (F.col("q")[1] - F.col("q")[0]) / 0.6745,
            "over": (F.col("q")[2] - F.col("q")[1]) / 0.6745,
        }).withColumnsRenamed({x: prefix + x for x in names})

    own = measures(passing.groupBy("lang"), "own_")
    every = measures(passing, "").first()  # one row
    drawn = [((F.col("n") * F.col(f"own_{x}") + PRIOR * F.lit(every[x])) / (F.col("n") + PRIOR)).alias(x) for x in names]
    return own.select(F.col("lang").alias("band_lang"), *drawn)


def _base_failed() -> F.Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judged(docs: DataFrame, below: float = 3.0, above: float = 3.0, carry: bool = False) -> DataFrame:
    """The measures of every row with base_failed and kept. The measured rows are stored once; with
    carry, whole, so that no text is shuffled to meet its verdict.

    below, above: how many spreads a document's bits per word may lie under or over its language's middle;
    on its side, the spread of a document of n words is sqrt(spread^2 + noise / n), where the first is at
    least 1 % of the middle.
    """
    scores = stored(measured(docs, train(docs), carry), "quality")
    limits = stored(bands(scores), "quality-bands")
    spread = F.when(F.col("bits") < F.col("middle"), F.col("under")).otherwise(F.col("over"))
    width = F.sqrt(
        F.greatest(spread, 0.01 * F.col("middle")) ** 2 + F.col("noise") / F.greatest(F.col("n_words"), F.lit(1))
    )
    off = (F.col("bits") - F.col("middle")) / width
    inside = (off >= -below) & (off <= above)
    return (
        scores.join(limits, scores["lang"] == limits["band_lang"], "left")
        .withColumn("base_failed", _base_failed())
        .withColumn("kept", ~_base_failed() & F.coalesce(inside, F.lit(False)))  # only failed rows may have no bands
        .withColumn("off", off)
    )


def quality_report(docs: DataFrame) -> DataFrame:
    return judged(docs).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def drop_poor(docs: DataFrame) -> DataFrame:
    """docs, same columns, without the rejected rows."""
    return judged(docs, carry=True).filter("kept").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
