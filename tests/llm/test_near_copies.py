"""The pipeline's near-dedup against all pairs, by exact similarity of five-word shingles."""

import random

import corpus_pipeline
from quern.llm import near_copies

from .conftest import DOCS, sentence


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def edited(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_lightly_edited_copies(spark):
    rng = random.Random(3)
    own = ["", None, " \n", "one two", "One  two", "one two three four five six"]
    for n in (40, 100, 100, 300, 300, 300):
        body = sentence(rng, n)
        near = edited(rng, body, n // 60 + 1)
        own += [body, near, edited(rng, near, n // 60 + 1), edited(rng, body, n // 10)]
    hub = sentence(rng, 200)  # copies that are near the original, hardly near each other
    own += [edited(rng, hub, 4) for _ in range(12)] + [hub] + [hub + " " + sentence(rng, k) for k in (10, 20, 40, 60, 200)]
    rows = [(i, t, "en", "s", 0, 0.5, "a", "b") for i, t in enumerate(own)]
    rows += [rows[7], rows[7], (None, "no id and alone in it", None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)

    sets = [shingles(t) for t in own]
    part = list(range(len(own)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                low, high = sorted((part[i], part[j]))
                part = [low if x == high else x for x in part]
    want = {i: c for i, c in enumerate(part)}
    assert len(set(part)) < len(own) - 20
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert got == {**want, None: None}

    stage = dict(corpus_pipeline.STAGES)["simhash"]
    kept = stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*set(part), None], key=str)


def test_no_rows(spark, empty):
    assert near_copies.drop_near_copies(empty).count() == 0


def test_no_short_pair_is_lost(spark):
    """10,000 pairs of four and five shingles and 3000 of 12 and 15, all of similarity 0.8 exactly."""
    rng = random.Random(6)
    rows = []
    for k in range(13000):
        words = [f"w{rng.randrange(10**9)}" for _ in range(9 if k < 10000 else 19)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:8] if k < 10000 else words[:16]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert got == {i: i - i % 2 for i in range(26000)}


def test_many_short_near_copies_of_one_text(spark):
    """One exact bucket of thousands: all are linked through the text they vary."""
    rng = random.Random(7)
    head = [f"w{i}" for i in range(16)]
    rows = [(0, " ".join(head))] + [(i, " ".join([*head, *(f"x{rng.randrange(10**9)}" for _ in range(1 + i % 3))])) for i in range(1, 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert {r.component_id for r in near_copies.near_copies(docs, tile=512).collect()} == {0}


def test_settings_of_the_session_stay(spark):
    from quern.llm import line_dedup, quality, token_count, toxicity

    before = dict(spark.sparkContext.getConf().getAll()) | {r.key: r.value for r in spark.sql("SET").collect()}
    docs = spark.createDataFrame([(i, f"some words of text {i}", "en", "s", 0, 0.5, "a", "b") for i in range(40)], DOCS)
    for f in (line_dedup.line_report, token_count.token_counts, quality.quality_report, near_copies.drop_near_copies):
        f(docs).count()
    toxicity.toxicity(docs, toxicity.seed_lexicon()).count()
    after = dict(spark.sparkContext.getConf().getAll()) | {r.key: r.value for r in spark.sql("SET").collect()}
    assert after == before
