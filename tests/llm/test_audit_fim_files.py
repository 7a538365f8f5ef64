"""Filter audit, fill-in-middle and token files against brute force."""

import hashlib
import os
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import fill_middle, filter_audit, token_files
from quern.llm.common import tokenizer_path
from quern.llm.elias_fano import EliasFano
from quern.session import shared_dir

LABELS = "doc_id long, quality int, toxic int"


def audited(rows, labels):
    """rows: (doc_id, text, part); the report by its definition, order by order."""
    good, toxic = ({i for i, *x in labels if x[k] == 1} for k in (0, 1))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    fails = []
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails.append({
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i,
        })
    out, shapley = {}, {}
    for order in permutations("ABCDE"):
        for part in {p for *_, p in rows}:
            left = {k for k, r in enumerate(rows) if r[2] == part}
            whole = set(left)
            for step, x in enumerate(order, 1):
                gone = {k for k in left if fails[k][x]}
                every = {k for k in whole if fails[k][x]}
                left -= gone
                alone = sum(sum(fails[k].values()) == 1 for k in every)
                shapley[part, x] = shapley.get((part, x), 0) + len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(every - gone), alone,
                    sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone),
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def report(df):
    got = df.collect()
    out = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got}
    assert len(out) == len(got)
    return out


def some_rows(n=400):
    rng = random.Random(9)
    pool = ["", "A B C", "word " * 60, "x#y " * 3, " ".join(f"w{k}" for k in range(70)), "\x85\xa0é \tz", "UPPER lower " * 40]
    pool += [" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(rng.randint(1, 120))) + rng.choice(["", "$", " Q"]) for _ in range(40)]
    rows = [(i if rng.random() < 0.9 else None, rng.choice(pool), rng.choice(["s0", "s1", None, ""])) for i in range(n)]
    rows += rows[:30] + [(7, pool[5], "s1"), (7, pool[6], "s0")]
    return [*rows, (-(2**62), pool[2], "s1")]


@pytest.mark.parametrize("fingerprint,held", [(None, 1 << 20), (lambda raw: len(raw) % 3, 1000)])
def test_filter_audit(spark, fingerprint, held):
    rows = some_rows()
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 300, 3)] + [(6, 0, 0), (6, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, source string, mask string, n int").repartition(7)
    kind = {} if fingerprint is None else {"fingerprint": fingerprint}
    got = report(filter_audit.audit(docs, spark.createDataFrame(labels, LABELS), held=held, **kind))
    assert got == audited([(i, t, p or "") for i, t, p in rows], [x for x in labels if x[0] is not None])


def test_filter_audit_of_nulls_and_nothing(spark, docs, empty):
    none = spark.createDataFrame([], LABELS)
    own = [(r.doc_id, r.text or "", r.source or "") for r in docs.collect()]
    assert report(filter_audit.audit(docs, none)) == audited(own, [])
    assert filter_audit.audit(empty, none).count() == 0


def test_other_filters_of_the_audit(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bb")], "doc_id long, text string").selectExpr("*", "'x' as kind")
    none = spark.createDataFrame([], LABELS)
    long = {"L": lambda text, raw, words: len(text) > 1}
    got = report(filter_audit.audit(docs, none, filters=long, copy="X", part="kind"))
    assert got == {
        ("x", "LX", 1): (2, 1, 0, 1, 0, 0, 2), ("x", "LX", 2): (1, 1, 0, 1, 0, 0, 2),
        ("x", "XL", 1): (2, 1, 0, 1, 0, 0, 2), ("x", "XL", 2): (1, 1, 0, 1, 0, 0, 2),
    }


def test_a_text_in_every_row_is_sent_once_a_task(spark):
    docs = spark.range(4000, numPartitions=8).selectExpr("id as doc_id", "'same text' as text", "'s' as source")
    rows = filter_audit.masks(docs)
    assert rows.filter("mask < 16").agg({"n": "sum"}).first()[0] == 1
    assert rows.agg({"n": "sum"}).first()[0] == 4000


def cut(doc, text):
    """One output by its definition."""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    if text == "" or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return doc, len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return doc, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, docs, empty):
    odd = ["<", "a <P b< S> ", "<P>", "x <S> y", " \n ", "a\x85b\xa0c d\r\n\te  ", "\x00 \x1c a", "é\U0001f600 ሰላም <M", "w " * 50000, "x" * 200000]
    more = [(1000 + i, odd[i % len(odd)]) for i in range(120)]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    own = [(r.doc_id, r.text or "") for r in rows.collect()]
    want = sorted((cut(*x) for x in own), key=str)
    assert {x[2] for x in want} == {"plain", "psm", "spm"}
    got = fill_middle.fill_in_middle(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want
    sha = [(*x[:5], *(hashlib.sha256(t.encode()).hexdigest() for t in (x[5], t))) for x, t in ((cut(*y), y[1]) for y in own)]
    assert sorted(map(tuple, fill_middle.fill_report(rows).collect()), key=str) == sorted(sha, key=str)
    assert fill_middle.fill_report(empty).count() == 0


def test_offsets_of_runs_are_those_of_the_whole_text():
    rng = random.Random(4)
    whole, small = fill_middle.Units(chunk=1 << 30), fill_middle.Units(chunk=7)
    for _ in range(3000):
        t = "".join(rng.choice(["a", "bc", " ", "  ", "\n", "\t", "é", "\x85", "\U0001f600"]) for _ in range(rng.randint(0, 60)))
        ends = [m.end() for m in re.finditer(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)]
        assert whole.ends(t).tolist() == ends == small.ends(t).tolist()


def test_elias_fano():
    rng = np.random.default_rng(3)
    cases = [[], [0], [5], [-3, -3, -3], [0, 2**62], [-(2**63), 0, 2**63 - 1], list(range(3000)), [0] * 2000 + [10**12]]
    cases += [np.sort(rng.integers(0, top, n)) for top in (2, 100, 10**6, 2**60) for n in (1, 511, 512, 70000)]
    for values in cases:
        values = np.array(values, np.int64)
        one = EliasFano.of(values)
        data = one.dump()
        again = EliasFano.load(one.header(), data)
        ranks = np.arange(len(values))
        for at in range(0, len(values), 5000):
            assert (again.select(ranks[at : at + 5000]) == values[at : at + 5000]).all()
        if len(values):
            assert again.select(np.array([len(values) - 1, 0])).tolist() == [values[-1], values[0]]
            top = max(1, int(values[-1]) - int(values[0]))
            # low bits, two high bits, the directory, a whole block of each
            assert len(data) * 8 <= len(values) * (max(0, np.log2(top / len(values))) + 3) * 1.07 + 1100


def test_units_are_the_library(texts):
    units = token_files.UnitIds(tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(2)
    odd = [*"ab1.,$!'é中 \t\n\x0b\r\x85\xa0 　\x1c​", "'s", "<|endoftext|>", "ab cd", "it's, ", "W" * 70]
    own = [t or "" for t in texts] + ["".join(rng.choice(odd) for _ in range(rng.randint(0, 25))) for _ in range(5000)]
    own += ["word " * 250000, "y" * 1100000]
    want = [units.tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in own]
    for at in range(0, len(own), 700):
        ids, n = units.of_batch(pa.array(own[at : at + 700]))
        assert n.tolist() == [len(x) for x in want[at : at + 700]]
        assert ids.tolist() == sum(want[at : at + 700], [])


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    folder = token_files.write_token_files(docs)
    own = [(r.doc_id, np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")) for r in docs.collect()]
    got = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in own), key=lambda i: (i is not None, i))
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((i or -1, len(x), zlib.crc32(x)) for i, x in own)
    # random access by rank
    fs, root = token_files.filesystem(folder)
    names = sorted(x.base_name for x in fs.get_file_info(selector(root)))
    assert names[-1] == "manifest.json" and not [x for x in names if x.startswith(".")]
    rank = 0
    for name in names[:-1]:
        file = token_files.Reader(folder, name)
        for k in range(len(file)):
            assert file.doc_ids(k, k + 1) == [got[rank].doc_id]
            assert zlib.crc32(file.document(k).astype("<u4")) == got[rank].ids_crc32
            rank += 1
        file.close()
    assert rank == len(got)
    assert token_files.read_token_files(spark, token_files.write_token_files(empty)).count() == 0


def selector(root):
    from pyarrow.fs import FileSelector

    return FileSelector(root)


def test_one_id_in_many_rows_fills_many_files(spark):
    docs = spark.range(2000, numPartitions=4).selectExpr("cast(5 as long) as doc_id", "'one text' as text")
    folder = f"{shared_dir(spark)}/ids-{os.getpid()}-{random.random()}"
    assert token_files.write_token_files(docs, folder) == folder
    fs, root = token_files.filesystem(folder)
    got = token_files.read_token_files(spark, folder)
    assert got.count() == 2000 and got.select("start").distinct().count() == 2000
    assert len(fs.get_file_info(selector(root))) >= 2


def test_toxicity_features_by_a_plain_scan():
    """Every term and phrase tried at every place of the folded text."""
    from quern.llm import toxicity

    rng = random.Random(8)
    terms = {"=idiot": 2.0, "moro": 1.5, "=moron": 3.0, "scum": 2.5, "=a b": 1.0, "gro": 0.5, "grob": 2.2}
    lexicon = toxicity.Lexicon(terms, ("scum line", "idiot proof", "my moron"))
    parts = ["idiot", "1d1ot", "moron", "moronic", "scum", "scum line", "scum  line", "idiot proof", "idiot-proof", "my moron", "GR0B", "grоb", "a b", "x", " ", " ", "\n", "é", "4"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 12)))
        t = toxicity.folded(text)

        def at(word, whole, t=t):
            found = []
            for i in range(len(t)):
                j = i + len(word)
                if t[i:j] == word and not (i and t[i - 1].isalpha()) and not (whole and t[j : j + 1].isalpha()):
                    found.append(i)
            return found

        hits = {}
        for term, w in terms.items():
            for i in at(term.lstrip("="), term.startswith("=")):
                hits[i] = max(w, hits.get(i, 0.0))
        for phrase in lexicon.exceptions:
            for i in at(phrase, True):
                hits = {k: w for k, w in hits.items() if not i <= k < i + len(phrase)}
        total = sum(hits.values())
        want = (max(hits.values(), default=0.0), float(np.log1p(total)), 100 * total / (t.count(" ") + 1))
        assert np.allclose(lexicon.features(text), want), text


def test_toxicity_with_labels_of_one_class(spark):
    from quern.llm import toxicity

    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(30)], "doc_id long, text string")
    for label in (0, 1):
        labels = spark.createDataFrame([(i, label) for i in range(30)], "doc_id long, toxic int")
        assert toxicity.learn(docs, labels).weights == toxicity.seed_lexicon().weights
