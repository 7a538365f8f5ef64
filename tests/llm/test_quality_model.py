"""What the quality model counts and what its bands reject."""

import math
import random
from collections import Counter

import numpy as np

from quern.llm import chargrams as cg
from quern.llm import quality

from .conftest import frame, sentence


def test_every_document_lends_its_counts(spark):
    rng = random.Random(2)
    own = [sentence(rng, 40) for _ in range(20)] + ["| a | # b | *c* $ % |\n" * rng.randint(5, 30) for _ in range(20)]
    docs = frame(spark, own)
    code = np.concatenate([c for r in docs.collect() for c in cg.codes(r.text or "")])
    every = np.arange(cg.SIZE**4)
    want = quality.KneserNey(*np.unique(code, return_counts=True)).bits(every)
    assert np.allclose(quality.train(docs).bits(every), want, atol=1e-4)


def naive_model(texts):
    """Modified Kneser-Ney with dictionaries of class tuples; gives the probability of an n-gram's last class."""
    top = Counter()
    for t in texts:
        s = (0, 0, 0, *cg.classes(t).tolist())
        top.update(s[i : i + 4] for i in range(len(s) - 3))
    orders = {4: top}
    for k in (3, 2, 1):
        orders[k] = Counter(g[1:] for g in orders[k + 1])
    discount = {}
    for k, grams in orders.items():
        n = [sum(m == i for m in grams.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = [0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) if n[i] else min(0.5, i / 2) for i in (1, 2, 3)]
        discount[k] = d

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / cg.SIZE
        same = {g: m for g, m in orders[k].items() if g[:-1] == gram[:-1]}
        if not same:
            return p(gram[1:])
        cut = {g: discount[k][min(m, 3)] for g, m in same.items()}
        total = sum(same.values())
        kept = (same[gram] - cut[gram]) / total if gram in same else 0
        return kept + sum(cut.values()) / total * p(gram[1:])

    return p


def naive_bits(t, p):
    """Bits per word: the word and its blanks spelt, mixed with the share among the last eight words."""
    s = (0, 0, 0, *cg.classes(t).tolist())
    blank = [c in " \t\x0b\x0c\r\n" for c in t]
    begins = [i for i in range(len(t)) if not blank[i] and (i == 0 or blank[i - 1])]
    begins[0] = 0
    own, bits = t.encode().split(), []
    for k, (a, b) in enumerate(zip(begins, [*begins[1:], len(t)])):
        spelt = math.prod(p(s[i : i + 4]) for i in range(a, b))
        again = sum(0.5**j / (1 - 0.5**8) for j in range(1, 9) if k - j >= 0 and own[k - j] == own[k])
        bits.append(-math.log2(0.7 * spelt + 0.3 * again))
    return sum(bits) / len(bits)


def test_scores_equal_a_naive_kneser_ney(monkeypatch):
    rng = random.Random(3)
    own = [sentence(rng, rng.randint(1, 30)) for _ in range(12)]
    own += ["  Lead and\n\ttail \n", "é ö ሰላም 漢字 # $ 12.5", "the the the of the the", "x" * 90, " \n ", ""]
    p = naive_model(own)
    code = np.concatenate([c for t in own for c in cg.codes(t)])
    bits = quality.Remembered(quality.KneserNey(*np.unique(code, return_counts=True)))
    plain = cg.codes
    for chars in (1 << 20, 7, 1):  # texts that span arrays score the same
        monkeypatch.setattr(cg, "codes", lambda t, n=chars: plain(t, n))
        for t in [*own, "other words that it has not seen, Ünd"]:
            got = quality.scored(t, bits)[0]
            assert abs(got - (naive_bits(t, p) if t.split() else 0)) < 1e-3, (chars, t)


def test_stuttered_and_garbled_texts_fall_outside(spark):
    rng = random.Random(4)
    good = [sentence(rng, rng.randint(60, 200)) for _ in range(300)]
    stuttered = []
    for _ in range(12):
        w = sentence(rng, 30).split()
        stuttered.append(" ".join(x for x in w for _ in range(rng.randint(4, 6))))
    garbled = ["".join(rng.choice("qxzjvwkyüé^~ ") for _ in range(500)) for _ in range(6)]
    found = {r["row"].doc_id: r for r in quality.judged(frame(spark, good + stuttered + garbled)).collect()}
    assert sum(not found[i].kept for i in range(300)) <= 6
    assert not any(found[i].kept for i in range(300, 318))
    assert all(found[i].off < 0 for i in range(300, 312) if not found[i].base_failed)
    assert all(not found[i].base_failed for i in range(312, 318)) and all(found[i].off > 0 for i in range(312, 318))


def test_small_languages_are_judged(spark):
    rng = random.Random(6)
    good = [sentence(rng, rng.randint(60, 200)) for _ in range(200)]
    rows = [(i, t, "en") for i, t in enumerate(good)]
    for lang, n in (("xx", 1), ("yy", 4), ("zz", 49), ("ww", 51)):  # the junk is the last row of each
        for _ in range(n - 1):
            rows.append((len(rows), sentence(rng, rng.randint(60, 200)), lang))
        rows.append((len(rows), "".join(rng.choice("qxzjvwkyüé^~ ") for _ in range(500)), lang))
    found = {r["row"].doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(r.off is not None for r in found.values())
    last = {lang: i for i, _, lang in rows if lang != "en"}
    assert not any(found[i].kept or found[i].base_failed for i in last.values())
    assert sum(not r.kept for i, r in found.items() if i not in last.values()) <= 6


LATIN = "abcdefghijklmnopqrstuvwxyz"
SCRIPTS = {
    "Cyrillic": "абвгдежзиклмнопрстуфхцчшщы",
    "Ethiopic": "አበቸደእፈገሀኢጀከለመነኦጰቀረሰተኡቨወጠየዘ",
    "Han": "的一是不了人我在有他这中大来上国个到说们为子和你地出",
    "accents": "àáâãåèêëìíîïòóôõùúûāēģķļņš",
}


def test_garbled_texts_of_any_script_fall_outside(spark):
    """Texts whose words have the right lengths and wrong letters; all these letters were once of a class or two."""
    rng = random.Random(7)
    rows, garbled = [], set()
    for lang, letters in SCRIPTS.items():
        own = str.maketrans(LATIN, letters)
        for i in range(210):
            t = sentence(rng, rng.randint(60, 200)).translate(own)
            if i >= 200:
                garbled.add(len(rows))
                t = "".join(rng.choice(letters) if c in letters else c for c in t)
            rows.append((len(rows), t, lang))
    found = {r["row"].doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not any(found[i].kept for i in garbled) and not any(found[i].base_failed for i in garbled)
    assert sum(not r.kept for i, r in found.items() if i not in garbled) <= 16


def member_parts(texts):
    """Counts of rows and of places, from the definition, in pieces of seven characters."""
    counted = [cg.told(t, i, i + 7)[1] for t in texts for i in range(0, len(t), 7)]
    found = Counter()
    for pair in counted:
        for bit, at, code, _ in cg.members(pair):
            found.update((bit, int(c)) for c in code)
    return [
        (np.array(sorted(c for b, c in found if b == bit)), np.array([found[bit, c] for c in sorted(c for b, c in found if b == bit)]))
        for bit in (cg.ROW_BIT, cg.PLACE_BIT)
    ]


ODD = ["ሰላም ለዓለም 漢字かな Жук жук", "é ö Ÿ Straße àá ÀÁ ﬁ Ａｂ", "\U0001f600 \U0010ffff\ue000\u0378 x漢", "plain", ""]


def test_members_of_a_class_share_its_probability():
    model = quality.Members(*member_parts(ODD))
    every = np.flatnonzero((cg.FOLD == np.arange(0x110000)) & (cg.TABLE >= cg.TOLD))
    for before in " aላ漢ж\U0001f600\ue000\U0010ffff":
        p = 2.0 ** -model.bits((ord(before) << 21) | every).astype(float)
        share = np.bincount(cg.TABLE[every], weights=p, minlength=cg.SIZE)[cg.TOLD :]
        assert abs(share - 1).max() < 1e-3, before
    bits = lambda a, b: float(model.bits(np.array([(ord(a) << 21) | ord(b)]))[0])
    assert bits("ለ", "ላ") < bits("ለ", "乙") and bits("漢", "字") < bits("漢", "漢")


def test_every_member_is_counted(spark):
    rows = cg.collected(cg.count_characters(spark.createDataFrame([(t,) for t in [*ODD * 3, None]], "text string").repartition(3)))
    for (code, n), (want, m) in zip(rows[1:], member_parts(ODD * 3), strict=True):
        assert code.tolist() == want.tolist() and n.tolist() == m.tolist()


def test_members_are_scored_in_any_arrays(monkeypatch):
    code = np.concatenate([c for t in ODD for c in cg.codes(t)])
    model = quality.KneserNey(*np.unique(code, return_counts=True))
    plain = [quality.spelt_words(t, quality.Remembered(model)).sum() for t in ODD]
    model.members = quality.Members(*member_parts(ODD))
    bits, codes = quality.Remembered(model), cg.codes
    more = [float(model.members.bits(cg.told(t, 0, len(t))[1]).sum()) if t else 0.0 for t in ODD]
    for chars in (1 << 20, 5, 1):
        monkeypatch.setattr(cg, "codes", lambda t, n=chars: codes(t, n))
        got = [quality.spelt_words(t, bits).sum() for t in ODD]
        assert np.allclose(got, np.add(plain, more), atol=1e-3)
    assert more[0] > 0 and more[3] == 0
