"""LM scoring with a log-bilinear neural model trained by noise-contrastive estimation in numpy.

Words are counted over all training documents by Spark. The model's symbols are the ``frequent``
commonest words, classes of the other words by their last two bytes (the ``endings`` commonest, and
one class for the rest), and the end. The last three symbols predict the next one: q is the sum over
positions j of w_j r C_j, with r the vector of the symbol there, and the scores are q . t + b. The output
is factored: q gives a distribution over groups of symbols, then one over the symbols of a group, both
normalised; a word of a class then has its add-one share of the class, where unseen words are one type of
their class.

Spark counts, in every training document, how often a symbol follows another at distances one to three
(at most three times the square of the symbols, whatever the input). These counts are the batches of the
training, with the exact expectation of the noise term, so training does not sample: each position learns
its own pairs, and ``WEIGHTS`` (parameters) discount the farther positions, which are no news after the
nearer ones. Scoring takes the contexts of a batch of texts as one matrix product for the groups and one
for each group's symbols.

Counts of words beyond the ``table`` commonest never leave Spark: documents send a row for each
distinct such word, joined to the counts by word; the hot words are all in the table.

Defined results:
* null or empty text: the end alone.
* no training documents: every count is 0; the score is that of a uniform model.
* repeated rows and null ids: one result row for each input row; a null id counts as the empty
  text in the fold. Ties among the commonest words go to the smaller word.
* very long texts and words are scored whole. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fold, id_and_text, resident, sliced, texts
from quern.session import stored

def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()  # bytes: A-Z and the six ASCII blanks only


#: What the last symbol, the one before it and the one before that weigh.
WEIGHTS = (1.0, 0.4, 0.2)


def _adam(parameters: dict[str, np.ndarray], gradient, rounds: int, rate: float) -> None:
    """Changes the parameters in place; gradient() gives theirs."""
    first = {n: np.zeros_like(x) for n, x in parameters.items()}
    second = {n: np.zeros_like(x) for n, x in parameters.items()}
    for i in range(1, rounds + 1):
        step = rate * min(1.0, 2 * (1 - i / (rounds + 1)))
        for n, g in gradient().items():
            first[n] += 0.1 * (g - first[n])
            second[n] += 0.01 * (g * g - second[n])
            parameters[n] -= step * (first[n] / (1 - 0.9**i)) / (np.sqrt(second[n] / (1 - 0.99**i)) + 1e-12)


def _contrast(scores: np.ndarray, seen: np.ndarray, share: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The NCE objective's slope by score: seen pairs against the expected noise pairs (share)."""
    p = 1 / (1 + np.exp(-np.clip(scores - shift, -30, 30)))
    return share * p - seen * (1 - p)


class LogBilinear:
    """Scores q . t_w + b_w with q = sum over positions of w_j r_{c_j} C_j, normalised in groups."""

    def __init__(self, size: int, weights: tuple[float, ...] = WEIGHTS, dim: int = 32, groups: int = 32, seed: int = 7):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.weights = weights
        self.source = rng.normal(0, 0.1, (size, dim)).astype(f)
        self.target = rng.normal(0, 0.1, (size, dim)).astype(f)
        self.turn = np.stack([np.eye(dim, dtype=f) for _ in weights])
        self.bias = np.full(size, -np.log(size), f)
        self.group = np.arange(size) * min(groups, size) // size
        self._settle(np.zeros((max(self.group) + 1, dim), f), np.zeros(max(self.group) + 1, f))

    def _settle(self, heads: np.ndarray, head_bias: np.ndarray) -> None:
        self.heads, self.head_bias = heads, head_bias
        self.members = [np.flatnonzero(self.group == g) for g in range(len(heads))]
        self.within = np.empty(len(self.group), np.int64)
        for own in self.members:
            self.within[own] = np.arange(len(own))
        #: by position: what a symbol there adds to q
        self.adds = [w * (self.source @ c) for w, c in zip(self.weights, self.turn, strict=True)]

    def train(self, counts: np.ndarray, noise: float = 8.0, rounds: int = 150, rate: float = 0.03) -> LogBilinear:
        """counts: distances x symbols x next symbols. Noise comes from the unigrams; each symbol's noise
        term is its expectation over all next symbols, so a round is exact."""
        total = counts[0].sum()
        if total == 0:
            return self
        size = counts.shape[1]
        seen = (counts / total).astype(np.float32)
        left = seen.sum(axis=2, keepdims=True)
        unigram = ((counts[0].sum(axis=0) + 0.5) / (total + 0.5 * size)).astype(np.float32)
        self.bias[:] = np.log(unigram)
        shift = np.log(noise * unigram)

        def gradient() -> dict[str, np.ndarray]:
            out = {n: np.zeros_like(x) for n, x in own.items()}
            for j, turn in enumerate(self.turn):
                q = self.source @ turn
                g = _contrast(q @ self.target.T + self.bias, seen[j], left[j] * (noise * unigram), shift)
                gq = g @ self.target
                out["target"] += g.T @ q
                out["bias"] += g.sum(axis=0)
                out["turn"][j] = self.source.T @ gq
                out["source"] += gq @ turn.T
            return out

        own = {"source": self.source, "target": self.target, "turn": self.turn, "bias": self.bias}
        _adam(own, gradient, rounds, rate)

        # like symbols share a group: cut along the main direction of their vectors, by equal shares
        main = np.linalg.svd((self.target - unigram @ self.target) * np.sqrt(unigram)[:, None], full_matrices=False)[2][0]
        order = np.argsort(self.target @ main, kind="stable")
        room = 0.5 * np.cumsum(unigram[order]) / unigram.sum() + 0.5 * np.arange(1, size + 1) / size
        n = max(self.group) + 1
        cut = np.minimum((room * n).astype(np.int64), n - 1)
        self.group = np.empty(size, np.int64)
        self.group[order] = np.unique(cut, return_inverse=True)[1]  # none is empty
        n = max(self.group) + 1
        by_group = np.zeros((len(self.turn), size, n), np.float32)
        for g in range(n):
            by_group[:, :, g] = seen[:, :, self.group == g].sum(axis=2)
        share = np.bincount(self.group, weights=unigram, minlength=n).astype(np.float32)
        heads = {"heads": np.zeros((n, self.source.shape[1]), np.float32), "bias": np.log(share)}
        qs = [self.source @ turn for turn in self.turn]

        def head_gradient() -> dict[str, np.ndarray]:
            out = {k: np.zeros_like(x) for k, x in heads.items()}
            for j, q in enumerate(qs):
                g = _contrast(q @ heads["heads"].T + heads["bias"], by_group[j], left[j] * (noise * share), np.log(noise * share))
                out["heads"] += g.T @ q
                out["bias"] += g.sum(axis=0)
            return out

        _adam(heads, head_gradient, rounds, rate)
        self._settle(heads["heads"], heads["bias"])
        return self

    @staticmethod
    def _softmax(s: np.ndarray, at: np.ndarray) -> np.ndarray:
        s -= s.max(axis=1, keepdims=True)
        return s[np.arange(len(s)), at] - np.log(np.exp(s).sum(axis=1))

    def log10(self, contexts: np.ndarray, following: np.ndarray, batch: int = 1 << 14) -> np.ndarray:
        """Normalised log10 probability of each next symbol after its context (last symbol first)."""
        out = np.empty(len(following), np.float32)
        for i in range(0, len(following), batch):
            c, w = contexts[i : i + batch], following[i : i + batch]
            q = self.adds[0][c[:, 0]]
            for j in range(1, len(self.adds)):
                q = q + self.adds[j][c[:, j]]
            group = self.group[w]
            p = self._softmax(q @ self.heads.T + self.head_bias, group)
            order = np.argsort(group, kind="stable")
            ends = np.searchsorted(group[order], np.arange(len(self.members) + 1))
            for g in np.unique(group).tolist():
                own = order[ends[g] : ends[g + 1]]
                m = self.members[g]
                p[own] += self._softmax(q[own] @ self.target[m].T + self.bias[m], self.within[w[own]])
            out[i : i + batch] = p / np.log(10)
        return out


class Model:
    """Everything a scoring task needs; bounded by ``table`` words and the network."""

    def __init__(self, words: list[bytes], counts: np.ndarray, frequent: int, endings: list[bytes], class_size: np.ndarray, tokens: int, types: int, ends: int, net: LogBilinear):
        self.key = uuid.uuid4().hex
        self.words, self.counts, self.tokens, self.types, self.ends = words, counts, tokens, types, ends
        self.frequent, self.endings, self.net = frequent, endings, net
        #: log10 of a class's tokens and types plus one, its unseen type
        self.class_log10 = np.log10(class_size + 1.0)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.types + 1))

    def ready(self) -> None:
        """The lookups of a worker."""
        self.index = {w: i for i, w in enumerate(self.words)}
        self.class_of = {e: self.frequent + i for i, e in enumerate(self.endings)}
        self.end = self.frequent + len(self.endings) + 1
        self.base_log10 = self.base(self.counts)
        self.symbol = np.array([i if i < self.frequent else self.symbol_of(w) for i, w in enumerate(self.words)], np.int64)
        rare = self.symbol >= self.frequent
        self.share_log10 = np.zeros(len(self.words))
        self.share_log10[rare] = np.log10(self.counts[rare] + 1.0) - self.class_log10[self.symbol[rare] - self.frequent]

    def symbol_of(self, word: bytes) -> int:
        """Of a word that is not frequent."""
        return self.class_of.get(word[-2:], self.end - 1)


def _worker_model(shared) -> Model:
    m = shared.value

    def made() -> Model:
        m.ready()
        return m

    return resident(m.key, made)


def word_counts(docs: DataFrame, modulus: int, held_out: int, memory: int = 150_000) -> DataFrame:
    """(word, n) over the training documents; the null word is the end of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"]
            )

        for b in sliced(batches):
            for doc, text in zip(b.column("doc_id").to_pylist(), texts(b), strict=True):
                if fold(doc, modulus) != held_out:
                    held.update(words_of(text))
                    held[None] += 1
                    if len(held) > memory:
                        yield rows()
                        held = Counter()
        yield rows()

    return id_and_text(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def symbol_counts(docs: DataFrame, words: list[bytes], endings: list[bytes], distances: int, modulus: int, held_out: int) -> DataFrame:
    """(code, n): code is (distance - 1, symbol, the symbol so far after it) in one number; documents begin
    with as many ends as there are distances."""
    shared = docs.sparkSession.sparkContext.broadcast((words, endings))
    size = len(words) + len(endings) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_words, own_endings = shared.value
        symbol = {w: i for i, w in enumerate(own_words)}
        class_of = {e: len(own_words) + i for i, e in enumerate(own_endings)}
        other, end = size - 2, size - 1
        pairs = np.zeros((distances, size * size), np.int64)
        held: list[list[np.ndarray]] = [[] for _ in range(distances)]
        room = 1 << 19

        def settle():
            nonlocal room
            for own, found in zip(pairs, held, strict=True):
                if found:
                    own += np.bincount(np.concatenate(found), minlength=len(own))
                    found.clear()
            room = 1 << 19

        for b in sliced(batches):
            for doc, text in zip(b.column("doc_id").to_pylist(), texts(b), strict=True):
                if fold(doc, modulus) == held_out:
                    continue
                seq = [end] * distances
                for w in words_of(text):
                    k = symbol.get(w)
                    seq.append(class_of.get(w[-2:], other) if k is None else k)
                seq.append(end)
                at = np.array(seq, np.int64)
                for d, found in enumerate(held, 1):
                    found.append(at[distances - d : -d] * size + at[distances:])
                room -= len(at)
                if room < 0:
                    settle()
        settle()
        flat = pairs.reshape(-1)
        code = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(flat[code])], names=["code", "n"])

    return id_and_text(docs).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def learn(
    docs: DataFrame, counts: DataFrame, frequent: int = 800, endings: int = 200, table: int = 1 << 17, modulus: int = 7, held_out: int = 2,
    weights: tuple[float, ...] = WEIGHTS,
) -> Model:
    """counts: what word_counts() gives. Collected: ``table`` words, the counts of all endings of two
    bytes (65792 at most), and for each position as many pair counts as the square of the symbols at most."""
    head = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"),
        F.count("*").alias("types"),
        F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0)).alias("ends"),
    ).first()
    top = counts.filter("word is not null").orderBy(F.col("n").desc(), "word").limit(table).toPandas()
    words, n = [w.encode() for w in top["word"]], top["n"].to_numpy(np.int64)
    frequent = min(frequent, len(words))
    ending = F.substring(F.col("word").cast("binary"), -2, 2)
    sizes = {
        bytes(r["e"]): [r["n"], r["types"]]
        for r in counts.filter("word is not null").groupBy(ending.alias("e")).agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()
    }
    for w, k in zip(words[:frequent], n[:frequent].tolist(), strict=True):  # these have symbols of their own
        sizes[w[-2:]][0] -= k
        sizes[w[-2:]][1] -= 1
    ranked = sorted(sizes, key=lambda e: (-sizes[e][0], e))
    chosen = ranked[:endings]
    class_size = np.array([sum(sizes[e]) for e in chosen] + [sum(sum(sizes[e]) for e in ranked[endings:])], float)
    got = symbol_counts(docs, words[:frequent], chosen, len(weights), modulus, held_out).toArrow()
    size = frequent + len(chosen) + 2
    pair = np.zeros(len(weights) * size * size, np.float32)
    pair[got["code"].to_numpy()] = got["n"].to_numpy()
    del got
    net = LogBilinear(size, weights).train(pair.reshape(len(weights), size, size))
    return Model(words, n, frequent, chosen, class_size, head["tokens"], head["types"], head["ends"], net)


def _parts(docs: DataFrame, model: Model) -> DataFrame:
    """For each row one part with a null word, and one for each distinct word outside the table."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = id_and_text(docs).withColumn("row", F.monotonically_increasing_id())
    kinds = {
        "row": pa.int64(), "doc_id": pa.int64(), "word": pa.string(), "n": pa.int64(), "class_log10": pa.float64(),
        "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "score": pa.float64(),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _worker_model(shared)
        get, end = m.index.get, m.end
        out: dict[str, list] = {k: [] for k in kinds}

        def put(*values):
            for own, v in zip(out.values(), values, strict=True):
                own.append(v)

        def flush():
            b = pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], names=list(kinds))
            for own in out.values():
                own.clear()
            return b

        depth = len(m.net.weights)
        for b in sliced(batches):
            ids = list(zip(b.column("row").to_pylist(), b.column("doc_id").to_pylist(), strict=True))
            seqs, plain = [], []
            for text in texts(b):
                own = words_of(text)
                at = np.array([get(w, -1) for w in own], np.int64)
                known = at >= 0
                symbols = np.full(len(own) + depth + 1, end, np.int64)
                symbols[depth:-1][known] = m.symbol[at[known]]
                odd = np.flatnonzero(~known).tolist()
                for i in odd:
                    symbols[i + depth] = m.symbol_of(own[i])
                seqs.append(symbols)
                plain.append((len(own) + 1, int(known.sum()), float(m.base_log10[at[known]].sum()), float(m.share_log10[at[known]].sum()), Counter(own[i] for i in odd)))
            if not seqs:
                continue
            sizes = np.array([len(x) - depth for x in seqs])
            contexts = np.concatenate([np.stack([x[depth - j - 1 : len(x) - j - 1] for j in range(depth)], axis=1) for x in seqs])
            next_log10 = m.net.log10(contexts, np.concatenate([x[depth:] for x in seqs]))
            said = np.add.reduceat(next_log10.astype(np.float64), np.cumsum(sizes) - sizes)
            for (row, doc), (n, n_known, base, share, odd), net in zip(ids, plain, said.tolist(), strict=True):
                put(row, doc, None, None, None, n, n_known + (m.ends > 0), base + float(m.base(np.array(m.ends))), net + share)
                for w, times in odd.items():
                    put(row, doc, w, times, float(m.class_log10[m.symbol_of(w) - m.frequent]), 0, 0, 0.0, 0.0)
                if len(out["row"]) > 50_000:
                    yield flush()
        if out["row"]:
            yield flush()

    return rows.mapInArrow(
        run,
        "row long, doc_id long, word string, n long, class_log10 double, n_tokens long, n_known long, base double, score double",
    )


def lm_scores(
    docs: DataFrame, frequent: int = 800, endings: int = 200, table: int = 1 << 17, modulus: int = 7, held_out: int = 2,
    weights: tuple[float, ...] = WEIGHTS,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row."""
    counts = stored(word_counts(docs, modulus, held_out), "lm-counts")
    model = learn(docs, counts, frequent, endings, table, modulus, held_out, weights)
    parts = stored(_parts(docs, model), "lm-parts")
    odd = (
        parts.filter("word is not null")
        .select("row", "word", F.col("n").alias("times"), "class_log10")
        .join(counts.filter("word is not null"), "word", "left")
        .withColumn("log10_n", F.log10(F.coalesce("n", F.lit(0)) + 1))
    )
    every = float(np.log10(model.tokens + model.types + 1))
    added = odd.select(
        "row",
        F.lit(None).cast("long").alias("doc_id"),
        F.lit(None).cast("long").alias("n_tokens"),
        F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("n_known"),
        (F.col("times") * (F.col("log10_n") - every)).alias("base"),
        (F.col("times") * (F.col("log10_n") - F.col("class_log10"))).alias("score"),
    )
    whole = parts.filter("word is null").select("row", "doc_id", "n_tokens", "n_known", "base", "score")
    summed = (
        whole.unionByName(added)
        .groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_tokens").alias("n_tokens"),
            F.sum("n_known").alias("n_known"),
            F.sum("base").alias("base_score"),
            F.sum("score").alias("score"),
        )
    )
    digest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return summed.select(
        "doc_id",
        (digest % modulus == held_out).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
