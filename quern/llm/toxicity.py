"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs to Latin letters and digit or sign substitutions before a
letter back to letters ("1d10t", "Іdіоt"). The lexicon holds whole words and word beginnings. It is
learned from labelled rows by document frequency: a term enters if its share of toxic documents, or
of toxic ones among the documents dense in it, is so high that chance would give one such term in a
hundred lexicons, and its weight is the smoothed log odds ratio. Hits inside an exception phrase do not count. A small logistic model turns
the strongest hit, the sum of weights and that sum per hundred words into a score.

Bounds (parameters): at most ``max_toxic`` + ``max_clean`` labelled documents are learned from,
those of smallest hash; at most ``max_terms`` terms. These are the only rows sampled; every document
is scored over its whole text.

Defined results:
* null or empty text: the score of a text without hits.
* no labels, or labels of one class only: the seed lexicon with preset weights.
* repeated labels of a doc_id: toxic if any says so. Null labels are ignored.
* repeated rows and null ids: one result row for each input row; a null id counts as the empty
  text in the fold. Labels, lang, source and doc_id are never inputs of the score.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fold, id_and_text, passing, per_batch, texts
from quern.session import stored

#: Common insults with a prior weight, and phrases in which they mean no harm.
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "worthless", "pathetic", "disgusting")
EXCEPTIONS = ("clown fish", "idiot proof", "idiot savant", "trash can", "trash bin", "scum line", "stupid easy")
#: Letters of other scripts that look Latin, and signs used for letters.
HOMOGLYPHS = str.maketrans("аеорсухіјѕԁһкмтвнαονιρτυκ", "aeopcyxijsdhkmtbhaoviptuk")
SIGNS = str.maketrans("0134578@$", "oieastbas")

_SIGN_RUN = re.compile(r"[0134578@$]+(?=[^\W\d_])")
_RARE = re.compile("[\u2000-\U0010ffff]")
_HAS_GLYPH = re.compile("[\u0370-\u052f]")
_WORD = re.compile(r"[^\W\d_]+")


def folded(text: str) -> str:
    if not text.isascii():
        if _RARE.search(text):
            text = unicodedata.normalize("NFKC", text)
        text = text.lower()
        if _HAS_GLYPH.search(text):
            text = text.translate(HOMOGLYPHS)
    else:
        text = text.lower()
    return _SIGN_RUN.sub(lambda m: m.group().translate(SIGNS), text)


def terms_of(text: str, shortest: int = 4, longest: int = 7) -> dict[str, bool]:
    """Whole words ("=word") and word beginnings ("word" cut to 4..7 letters); True for the dense ones,
    which are met twice or more and once in a hundred words."""
    hits: Counter = Counter()
    words = Counter(_WORD.findall(folded(text)))
    for w, n in words.items():
        if len(w) >= 3:
            hits["=" + w] += n
        for k in range(shortest, min(longest, len(w)) + 1):
            hits[w[:k]] += n
    total = words.total()
    return {t: n >= 2 and 100 * n >= total for t, n in hits.items()}


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    #: intercept, then the strongest hit, log of the sum, and the sum per hundred words
    model: tuple[float, ...] = (-4.0, 1.0, 0.5, 0.1)

    def __post_init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for term, w in self.weights.items():
            whole = term.startswith("=")
            word = term.lstrip("=")
            held = [x for x in self.automaton.get(word, [])] + [(len(word), w, whole)]
            self.automaton.add_word(word, held)
        for phrase in self.exceptions:
            held = [x for x in self.automaton.get(phrase, [])] + [(len(phrase), None, True)]
            self.automaton.add_word(phrase, held)
        if len(self.automaton):
            self.automaton.make_automaton()

    def __reduce__(self):
        return Lexicon, (self.weights, self.exceptions, self.model)

    def features(self, text: str) -> tuple[float, float, float]:
        if not len(self.automaton):
            return 0.0, 0.0, 0.0
        t = folded(text)
        hits: dict[int, tuple[float, int]] = {}
        excused: list[tuple[int, int]] = []
        for end, held in self.automaton.iter(t):
            for n, w, whole in held:
                start = end - n + 1
                if start and t[start - 1].isalpha() or whole and end + 1 < len(t) and t[end + 1].isalpha():
                    continue
                if w is None:
                    excused.append((start, end))
                elif w > hits.get(start, (0.0, 0))[0]:
                    hits[start] = (w, end)
        if not hits:
            return 0.0, 0.0, 0.0
        for a, b in excused:
            for s in [s for s in hits if a <= s <= b]:
                del hits[s]
        total = sum(w for w, _ in hits.values())
        return max((w for w, _ in hits.values()), default=0.0), float(np.log1p(total)), 100 * total / (t.count(" ") + 1)

    def score(self, text: str) -> float:
        x = self.features(text)
        z = self.model[0] + sum(a * b for a, b in zip(self.model[1:], x, strict=True))
        return float(1 / (1 + np.exp(-min(max(z, -50.0), 50.0))))


def seed_lexicon() -> Lexicon:
    return Lexicon({"=" + w: 4.0 for w in SEEDS})


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[float, ...]:
    """Newton's method with a small ridge."""
    x = np.hstack([np.ones((len(x), 1)), x])
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * b)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in b)


def _gain(a: int, b: int, p0: float) -> float:
    """How much less likely chance makes a toxic and b clean documents than their own share does, as a log."""
    p = a / (a + b) if a else 0.0
    if p <= p0:
        return 0.0
    return (a + b) * (p * np.log(p / p0) + ((1 - p) * np.log((1 - p) / (1 - p0)) if p < 1 else 0))


def choose(
    counts: list[tuple[str, int, int, int, int]], n_toxic: int, n_clean: int, n_terms: int, max_terms: int
) -> dict[str, float]:
    """Terms that chance does not explain, without terms that begin with one another.

    counts: term, toxic and clean documents that hold it, and those of them that are dense in it. A term
    enters by either pair and is weighted by the first.
    """
    p0 = n_toxic / (n_toxic + n_clean)
    need = np.log(max(2 * n_terms, 1) / 0.01)
    found = []
    for term, a, b, a_dense, b_dense in counts:
        gain = max(_gain(a, b, p0), _gain(a_dense, b_dense, p0))
        weight = np.log((a + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_clean + 1))
        if gain >= need and weight >= 1.5 and a >= 0.005 * n_toxic:
            found.append((float(gain), term, float(weight)))
    # of terms that tell as much, the most specific; of a word and the same beginning, the beginning
    found.sort(key=lambda x: (-x[0], -len(x[1].lstrip("=")), x[1].startswith("="), x[1]))
    chosen: dict[str, float] = {}
    for _, term, weight in found:
        word = term.lstrip("=")
        if not any(word.startswith(c.lstrip("=")) or c.lstrip("=").startswith(word) for c in chosen):
            chosen[term] = weight
        if len(chosen) >= max_terms:
            break
    return chosen


def learn(
    docs: DataFrame,
    labels: DataFrame,
    max_toxic: int = 4000,
    max_clean: int = 8000,
    max_terms: int = 2000,
    modulus: int = 4,
    held_out: int = 2,
) -> Lexicon:
    """A lexicon from a bounded sample of the labelled rows outside the held-out fold."""
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus != held_out)
        .groupBy(F.col("doc_id").cast("long").alias("label_id"))
        .agg(F.max("toxic").alias("toxic"))
    )
    order = (F.xxhash64("label_id"), F.col("label_id"))
    sample = (
        known.filter("toxic = 1").orderBy(*order).limit(max_toxic)
        .unionAll(known.filter("toxic <> 1").orderBy(*order).limit(max_clean))
    )
    train = (
        id_and_text(docs)
        # at most max_toxic + max_clean rows are sent
        .join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))
        .repartition("label_id")  # not by text: copies spread
        .select("text", F.col("toxic").cast("int").alias("toxic"))
    )

    kinds = ("toxic", "clean", "toxic_dense", "clean_dense")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [Counter() for _ in kinds]
            for text, y in zip(texts(b), b.column("toxic").to_pylist(), strict=True):
                held, dense = (found[0], found[2]) if y == 1 else (found[1], found[3])
                own = terms_of(text)
                held.update(own.keys())
                dense.update(t for t, often in own.items() if often)
                held[""] += 1  # the number of documents
            terms = list(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in found)], names=["term", *kinds]
            )

    counted = (
        train.mapInArrow(count, "term string, " + ", ".join(f"{k} long" for k in kinds))
        .groupBy("term")
        .agg(*[F.sum(k).alias(k) for k in kinds])
    )
    counted = stored(counted, "toxic-terms")
    n_terms = counted.count()
    head = counted.filter("term = ''").first()
    if head is None or not head["toxic"] or not head["clean"]:
        return seed_lexicon()
    likely = (
        counted.filter((F.col("toxic") >= 4) & (F.col("term") != ""))
        .filter(F.col("toxic") * F.lit(float(head["clean"])) > F.col("clean") * F.lit(2.0 * head["toxic"]))
        .orderBy((F.col("toxic") - F.col("clean")).desc(), "term")
        .limit(20 * max_terms)
        .collect()
    )
    weights = choose(
        [(r["term"], *(r[k] for k in kinds)) for r in likely], head["toxic"], head["clean"], n_terms, max_terms
    )
    plain = Lexicon({"=" + w: 2.0 for w in SEEDS} | weights)

    def measure():
        def f(b: pa.RecordBatch) -> dict:
            x = np.array([plain.features(t) for t in texts(b)]).reshape(-1, 3)
            return {"y": b.column("toxic"), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]}

        return f

    rows = per_batch(train, "y int, a double, b double, c double", measure).toPandas()
    x, y = rows[["a", "b", "c"]].to_numpy(), (rows["y"].to_numpy() == 1).astype(float)
    order = np.lexsort((y, *x.T))
    return Lexicon(plain.weights, plain.exceptions, logistic(x[order], y[order]))


def toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""

    def start():
        def f(b: pa.RecordBatch) -> dict:
            ids = b.column("doc_id")
            score = np.array([lexicon.score(t) for t in texts(b)])
            return {
                "doc_id": ids,
                "held_out": [fold(i, 4) == 2 for i in ids.to_pylist()],
                "score": score,
                "predicted": (score >= threshold).astype(np.int32),
            }

        return f

    return per_batch(id_and_text(docs), "doc_id long, held_out boolean, score double, predicted int", start)


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """docs, all columns as they are, without the rows predicted toxic."""
    return passing(docs, lambda: lambda b: [lexicon.score(t) < threshold for t in texts(b)])
