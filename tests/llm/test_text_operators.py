"""The operators against brute force on a small table of odd texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import xxhash

from quern.llm import bpe, line_dedup, lm, packing, quality, simhash, token_count, toxicity
from quern.llm.common import tokenizer_path

from .conftest import sentence

BLANK = " \t\n\x0b\x0c\r"


def plain(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def low(s):
    return s.translate({i: i + 32 for i in range(65, 91)})


def words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", s)


def rows(df, *cols):
    return sorted([tuple(r[c] for c in cols) for r in df.collect()], key=str)


def test_line_dedup(docs, empty):
    own = plain(docs)
    holders = defaultdict(set)
    for i, t in own:
        for x in t.split("\n"):
            k = low(x.strip(BLANK))
            if len(k) >= 40:
                holders[k].add((i, t if i is None else None))
    keeper = {k: max(i for i, _ in h if i is not None) for k, h in holders.items() if len(h) >= 5}
    want = []
    for i, t in own:
        lines = t.split("\n")
        kept = [x for x in lines if keeper.get(low(x.strip(BLANK)), i) == i]
        want.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    assert any(w[2] for w in want)
    assert rows(line_dedup.line_report(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(want, key=str)
    cleaned = line_dedup.line_dedup(docs)
    assert cleaned.columns == docs.columns
    got = sorted(((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in cleaned.collect()), key=str)
    assert got == sorted(((w[0], w[3]) for w in want), key=str)
    assert line_dedup.line_report(empty).count() == 0


def test_a_document_of_many_rows_holds_a_line_once(spark):
    line = "a line of more than forty characters in rows"
    own = [(1, line), (1, line + "\nx"), (1, "y\n" + line), (2, line), (3, line + "\nz"), (None, line)]
    got = line_dedup.line_report(spark.createDataFrame(own, "doc_id long, text string"))
    assert {r.n_dropped for r in got.collect()} == {0}  # three documents and one without an id
    more = spark.createDataFrame([*own, (4, line.upper() + "  ")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_dropped) for r in line_dedup.line_report(more).collect()) == [(0, 1), (1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 0)]


def fingerprint(t):
    w = words(low(t))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(own):
    """Brute-force components: smallest id reachable, by fingerprint."""
    fps = sorted({f for _, f in own})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for i, f in own:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return {f: least.get(find(f)) for f in fps}


def test_simhash(docs, empty, spark):
    own = [(i, fingerprint(t)) for i, t in plain(docs)]
    by = classes(own)
    want = sorted([(i, f"{f:016x}", by[f]) for i, f in own], key=str)
    assert rows(simhash.simhash_report(docs), "doc_id", "fingerprint", "component_id") == want
    assert rows(simhash.near_duplicates(docs, tile=4).select("doc_id", "component_id"), "doc_id", "component_id") == sorted([(a, c) for a, _, c in want], key=str)
    assert simhash.simhash_report(empty).count() == 0


def test_simhash_rows_without_an_id_link_others(spark):
    """1 and 2 meet only through a row without doc_id; texts under one doc_id stay in their own classes."""
    rng = random.Random(8)
    found = {}
    for _ in range(4000):  # short texts, so that a word moves few bits
        t = " ".join(rng.choice("abcdefgh") for _ in range(3))
        found.setdefault(fingerprint(t), t)
    words_, chain = [sentence(rng, 60).split() for _ in range(20)], None
    for w in words_:
        a = " ".join(w)
        for _ in range(400):
            b, c = list(w), list(w)
            b[rng.randrange(60)] = "x"
            c[rng.randrange(60)] = "x"
            f = [fingerprint(" ".join(x)) for x in (b, w, c)]
            if (f[0] ^ f[1]).bit_count() <= 3 >= (f[1] ^ f[2]).bit_count() and (f[0] ^ f[2]).bit_count() > 3:
                chain = (" ".join(b), a, " ".join(c))
                break
        if chain:
            break
    far = [sentence(rng, 50), sentence(rng, 50)]
    own = [(1, chain[0]), (None, chain[1]), (2, chain[2]), (None, chain[1]), (7, far[0]), (7, far[1]), (8, far[1]), (None, sentence(rng, 50))]
    got = simhash.near_duplicates(spark.createDataFrame(own, "doc_id long, text string"))
    want = [(1, 1), (None, 1), (2, 1), (None, 1), (7, 7), (7, 7), (8, 7), (None, None)]
    assert rows(got, "doc_id", "component_id") == sorted(want, key=str)


def test_simhash_hot_bucket_is_tiled(spark):
    """Many fingerprints in one bucket: tiles, chains and singles against brute force."""
    import random

    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 200:
        fps.add(rng.choice(sorted(fps)) ^ sum({1 << rng.randrange(26, 64) for _ in range(rng.randint(1, 6))}))
    own = list(enumerate(sorted(fps)))
    by = classes(own)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for _, f in own], "fp long")
    links = {(r.a, r.b) for r in simhash.fingerprint_links(df, tile=16).collect()}
    from quern.llm.components import components

    signed = {f - (1 << 64) if f >> 63 else f: i for i, f in own}
    e = spark.createDataFrame([(signed[a], signed[b]) for a, b in links] or [(0, 0)], "a long, b long")
    found = {r.node: r.component for r in components(e).collect()}
    assert all(found.get(i, i) == by[f] for i, f in own)


def test_bit_sliced_distances_by_radius():
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 12).astype(np.uint64)
    fps = np.concatenate([base ^ (np.uint64(1) << np.uint64(k)) ^ (np.uint64(1) << np.uint64(k // 2)) for k in range(6)])
    for radius in (0, 1, 2, 3, 5):
        a, b = simhash.links_across(fps, fps, radius)
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == {
            (i, j) for i in range(len(fps)) for j in range(len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= radius
        }


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 230)] + [(229, 300), (5, 5), (None, 3), (9, 8), (9, 8)]
    got = {r.node: r.component for r in __import__("quern.llm.components", fromlist=["x"]).components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 141))
    assert all(got[i] == 7 for i in range(200, 230)) and got[300] == 7 and got[9] == got[8] == 8 and 5 not in got


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = []
    for i, x in plain(docs):
        n = len(t.encode(x, add_special_tokens=False).ids)
        want.append((i, len(x.encode()), n, n > 512))
    assert rows(token_count.token_counts(docs), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=str)
    assert token_count.token_counts(empty).count() == 0


def test_token_counts_on_random_strings():
    import random

    from tokenizers import Tokenizer

    p = tokenizer_path("byte_bpe_50k.json")
    t, c, rng = Tokenizer.from_file(p), token_count.TokenCounter(p, memory=50), random.Random(1)
    for _ in range(2000):
        s = "".join(rng.choice(" \n\t'abst1<|>é😀.  sendoftext|>\u0085\xa0") for _ in range(rng.randint(0, 40))) + rng.choice(["", "<|endoftext|>"])
        assert c.count(s) == len(t.encode(s, add_special_tokens=False).ids), s


def test_bpe_round_trip(docs, empty):
    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    enc = bpe.encoding(path)
    want = []
    for i, x in plain(docs):
        ids = [k for m in __import__("regex").findall(bpe.PATTERN, x) for k in enc.encode_ordinary(m)]
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(x.encode()).hexdigest()))
    assert rows(bpe.round_trip(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    back = {(r.doc_id, bytes(r.bytes).decode()) for r in bpe.decoded(bpe.encoded(docs)).collect()}
    assert back == set(plain(docs))
    assert bpe.round_trip(empty).count() == 0


def test_spans_are_safe(texts):
    enc = bpe.encoding(tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    for x in texts:
        if x:
            assert [i for s in bpe.spans(x, 50) for i in enc.encode_ordinary(s)] == enc.encode_ordinary(x)


def test_packing(docs, empty):
    import numpy as np
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = []
    for i, x in plain(docs):
        ids = [*t.encode(x, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want.append((i, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = packing.pack(docs, shard_size=20).collect()
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=str) == sorted(want, key=str)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    one = packing.pack(docs)
    total = sum(w[3] for w in want)
    assert one.select("sequence_id").distinct().count() <= -(-total // 2048) + 1
    assert packing.pack(empty).count() == 0


def test_bpe_of_long_runs():
    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    enc = bpe.encoding(path)
    for text in (" " * 300_000 + "a", "ab" * 150_000, "\n" * 200_000 + " x", "é" * 150_000 + "12 3"):
        assert bpe.encode(text, path) == enc.encode_ordinary(text)
    text = "word " + " " * 2_000_000 + "end" + "x" * 300_000  # the library's own splitter fails here
    assert bpe.decode(bpe.encode(text, path), path) == text.encode()


def test_evolution_keeps_every_item():
    import random

    rng = random.Random(4)
    lengths = [rng.choice([1030, 700, 690, 340, 680, 1024]) for _ in range(300)]
    best = packing.evolve(lengths, 2048, 1, generations=3)
    assert sorted(i for b in best.items for i in b) == list(range(300))
    assert all(sum(lengths[i] for i in b) + f == 2048 and f >= 0 for b, f in zip(best.items, best.free, strict=True))
    first = packing.best_fit(sorted(range(300), key=lengths.__getitem__, reverse=True), lengths, 2048)
    assert len(best.items) <= len(first.items)
    again = packing.evolve(lengths, 2048, 2, elites=[packing.labels_of(best)])
    assert len(again.items) <= len(best.items)


def test_quality_rules(docs, empty):
    want = []
    for i, t in plain(docs):
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        at = defaultdict(list)
        for k in range(len(w) - 7):
            at[tuple(w[k : k + 8])].append(k)
        hit = {j for own in at.values() if len(own) > 1 for k in own for j in range(k, k + 8)}
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(hit), failed))
    got = quality.quality_report(docs)
    assert rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=str)
    assert got.filter("base_failed and kept").count() == 0
    kept = quality.drop_poor(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r.doc_id for r in got.filter("kept").collect()), key=str)
    assert quality.quality_report(empty).count() == 0 and quality.drop_poor(empty).count() == 0


def test_kneser_ney_is_a_distribution(texts):
    import numpy as np

    from quern.llm import chargrams as cg

    code = np.concatenate([c for t in texts for c in cg.codes(t or "")])
    p = 2.0 ** -quality.KneserNey(*np.unique(code, return_counts=True)).bits(np.arange(cg.SIZE**4)).astype(float)
    assert abs(p.reshape(-1, cg.SIZE).sum(axis=1) - 1).max() < 1e-3


def test_perplexity_bands_reject_noise(spark):
    import random

    from tests.llm.conftest import frame, sentence

    rng = random.Random(8)
    good = [" ".join(sentence(rng, 12) for _ in range(6)) for _ in range(300)]
    bad = ["".join(rng.choice("#$%qxzjvw@^~ ") for _ in range(400)) for _ in range(4)]
    r = {x.doc_id: x.kept for x in quality.quality_report(frame(spark, good + bad)).collect()}
    assert sum(not r[i] for i in range(300)) <= 2
    assert not any(r[i] for i in range(300, 304) if r[i])


def test_toxicity(spark, empty):
    import random

    from tests.llm.conftest import frame, sentence

    rng = random.Random(9)
    own, labels = [], []
    for i in range(600):
        t = sentence(rng, 40)
        bad = i % 5 == 0
        if bad:
            t += " " + rng.choice(["grobulus", "krapfonta", "krapfelso"]) + " x."
        own.append(t)
        labels.append((i, int(bad)))
    docs = frame(spark, own + [None, "", "a Gr0bulus here", "grоbulus", "a clown fish"])
    lab = spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, lab)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, lexicon).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(600))
    assert sum(got[i].predicted != y for i, y in labels if got[i].held_out) <= 2
    assert got[602].predicted == got[603].predicted == 1 and got[600].predicted == got[601].predicted == 0
    kept = toxicity.drop_toxic(docs, lexicon)
    assert kept.columns == docs.columns and kept.count() == docs.count() - sum(r.predicted for r in toxicity.toxicity(docs, lexicon).collect())
    assert toxicity.toxicity(empty, toxicity.seed_lexicon()).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.learn(docs, none).weights == toxicity.seed_lexicon().weights
    assert toxicity.learn(empty, none).weights == toxicity.seed_lexicon().weights


def test_toxicity_exceptions():
    x = toxicity.Lexicon({"=clown": 5.0, "krap": 4.0}, ("clown fish",))
    assert x.features("a clown fish")[0] == 0 and x.features("a clown") [0] == 5 and x.features("clowns")[0] == 0
    assert x.features("krapfen and skrap")[0] == 4 and x.features("skrap")[0] == 0


def test_lm_equals_a_naive_softmax():
    import numpy as np

    rng = np.random.default_rng(1)
    size = 40
    counts = rng.poisson(rng.gamma(0.3, 20, (3, size, size))).astype(np.float32)
    net = lm.LogBilinear(size, groups=6).train(counts, rounds=60)
    contexts = rng.integers(0, size, (25, 3))
    for c in contexts:
        q = sum(w * (net.source[x] @ turn) for w, x, turn in zip(net.weights, c, net.turn))
        of_group = np.exp(q @ net.heads.T + net.head_bias)
        s = np.exp(q @ net.target.T + net.bias)
        want = [of_group[net.group[w]] / of_group.sum() * s[w] / s[net.group == net.group[w]].sum() for w in range(size)]
        got = 10.0 ** net.log10(np.repeat(c[None, :], size, axis=0), np.arange(size)).astype(float)
        assert abs(got.sum() - 1) < 1e-4 and np.allclose(got, want, rtol=1e-3)
    plain = lm.LogBilinear(size, (1.0,), groups=6).train(counts[:1], rounds=150)
    seen = counts[0] / counts[0].sum(axis=1, keepdims=True)
    model = np.stack([10.0 ** plain.log10(np.full((size, 1), c), np.arange(size)) for c in range(size)])
    unigram = counts[0].sum(axis=0) / counts[0].sum()
    gain = (seen * np.log(np.maximum(model, 1e-12) / np.maximum(unigram, 1e-12))).sum(axis=1)
    assert gain.mean() > 0.2  # the network knows more than how common a symbol is


def test_lm_scores(docs, empty):
    own = plain(docs)
    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in own}
    counts = Counter()
    for i, t in own:
        if not held[i]:
            counts.update([*words(low(t)), None])
    n, v = sum(counts.values()), len(counts)
    got = lm.lm_scores(docs, frequent=50, endings=20, table=200).collect()
    assert len(got) == len(own)
    want = defaultdict(list)
    for i, t in own:
        seq = [*words(low(t)), None]
        base = sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in seq)
        want[i].append((len(seq), sum(w in counts for w in seq), round(base, 4)))
    have = defaultdict(list)
    for r in got:
        assert r.train_tokens == n and r.held_out == held[r.doc_id] and r.score < 0
        have[r.doc_id].append((r.n_tokens, r.n_known, round(r.base_score, 4)))
    assert {k: sorted(x) for k, x in have.items()} == {k: sorted(x) for k, x in want.items()}
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert lm.lm_scores(empty).count() == 0
