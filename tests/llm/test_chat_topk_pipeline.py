"""Chat trees, exact search and the pipeline."""

import hashlib
import math
import random

from quern.llm import chat, topk


def test_escaping_is_reversible():
    rng = random.Random(2)
    parts = ["<", "|", "turn", "text", "end", "|>", "\\", "s>", "/", "[", "INST", "]", "a", "im_start"]
    for _ in range(5000):
        role, text = ("".join(rng.choice(parts) for _ in range(rng.randint(0, k))) for k in (6, 12))
        turn, a, b = chat.format_turn(role, text)
        assert chat.parse_turn(turn) == (role, text) and chat.unescape(turn[a:b]) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROL)


def conversations():
    rows = []
    for c in range(40):
        for k in range(c % 5 + 1):
            text = "hello" if k == 0 else f"turn {k} of {c // 10}" if k < 3 else "</s>[INST] x [/INST]" * (c % 3)
            rows.append((c, k, ("user", "assistant")[k % 2], text, "x"))
    rows += [(100, 0, None, None, "x"), (100, None, "assistant", "first", "x"), (101, 3, "assistant", "a", "x"), (101, 3, "assistant", "a", "x"), (101, 1, "user", "", "x")]
    rows += [(200, k, ("user", "assistant")[k % 2], f"long {k}", "x") for k in range(300)]
    rows += [(None, 0, "assistant", "no id", "x")]
    return rows


def test_prefix_trees(spark):
    schema = "conv_id long, turn long, role string, text string, nodes string"
    df = spark.createDataFrame(conversations(), schema).repartition(4)
    by = {}
    for c, k, role, text, _ in conversations():
        by.setdefault(c, []).append((k is not None, k or 0, role or "", text or ""))
    want = {}
    for c, turns in by.items():
        turns = sorted(turns)
        loss = [t for *_, role, t in turns if role == "assistant"]
        want[c] = (
            len(turns),
            hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest(),
            sum(map(len, loss)),
            hashlib.sha256("".join(loss).encode()).hexdigest(),
            sum(len(chat.format_turn(r, t)[0]) for *_, r, t in turns),
        )
    for leaves in (512, 3):
        trees = chat.prefix_trees(df, tree_leaves=leaves).cache()
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in chat.read_back(trees).collect()}
        assert got == want
        for t in trees.collect():
            for n in t.nodes:
                up = t.nodes[n.parent] if n.parent >= 0 else None
                assert n.position == (up.position + up.end - up.start if up else 0)
                seen, k = set(), n.parent
                while k >= 0:
                    seen |= set(range(t.nodes[k].start, t.nodes[k].end))
                    k = t.nodes[k].parent
                assert {i for a in n.ancestors for i in range(a.start, a.end)} == seen
                assert all(x.start >= t.nodes[n.parent].start or x.end <= n.start for x in n.ancestors)
    total = sum(len(t.text) for t in chat.prefix_trees(df).collect())
    assert total < sum(w[4] for w in want.values())  # shared turns are emitted once
    assert chat.prefix_trees(spark.createDataFrame([], schema)).count() == 0


def test_turns_shared_at_any_depth_are_emitted_once(spark):
    """Thirty conversations of one beginning of 20 turns, then three branches of 15 more, then a turn of their own."""
    rows = []
    for c in range(30):
        said = [f"start {k}" for k in range(20)] + [f"branch {c % 3} {k}" for k in range(15)] + [f"own {c}"]
        rows += [(c, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(said)]
    trees = chat.prefix_trees(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)).collect()
    turns = [n for t in trees for n in t.nodes]
    assert len(turns) <= len(trees) * (20 + 15) + 3 * 15 + 30
    assert len(trees) > 1 or len(turns) == 20 + 3 * 15 + 30


def vectors():
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(12)], "z") for i in range(300)]
    rows += [(300, None, "z"), (301, [], "z"), (302, [float("nan")] * 12, "z"), (303, [math.inf] * 12, "z"), (304, [None] * 12, "z"), (None, [1.0] * 12, "z"), (305, [1.0], "z")]
    return rows + [(310 + i, rows[7][1], "z") for i in range(20)] + [rows[50], rows[50]]


def test_top_k_both_ways(spark):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, score string").repartition(3)
    import numpy as np

    own = []
    for i, v, _ in vectors():
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and len(v) == 12:
            own.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    want = []
    for q in sorted({i for i, _ in own if i % 50 == 0}):
        v = next(x for i, x in own if i == q)
        best = sorted(((-sum(a * b for a, b in zip(v, x, strict=True)), i) for i, x in own if i != q))[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    clean = topk.clean(df)
    queries = clean.filter("vec_id % 50 = 0")
    for limit in (1 << 25, 100):
        got = [tuple(r) for r in topk.top_k(clean, queries, 5, broadcast_bytes=limit).collect()]
        assert sorted(got) == want
    assert topk.top_k_report(df.limit(0)).count() == 0
    few = [tuple(r) for r in topk.top_k_report(df.filter("vec_id in (50, 51, 52)").dropDuplicates(["vec_id"])).collect()]
    assert len(few) == 2


def test_top_k_by_length_and_repeated_queries(spark):
    own = [(i, [float(i % 7), 1.0, -float(i % 3)]) for i in range(1, 12)] + [(12, [1.0] * 9), (13, [2.0, 1.0]), (14, [1.0, 1.0])]
    queries = [(100, [5.0, 0.0, 0.0]), (100, [0.0, 0.0, 5.0]), (100, [0.0, 0.0, 5.0]), (101, [1.0, 0.0])]
    df = spark.createDataFrame(own + queries, "vec_id long, embedding array<double>")
    clean = topk.clean(df)
    got = topk.top_k(clean, clean.filter("vec_id >= 100"), 3).collect()

    def best(q, v):
        found = sorted((-sum(256 * 256 * a * b for a, b in zip(v, x)), i) for i, x in own + queries if len(x) == len(v) and i != q)
        return [(q, r + 1, i, int(-s)) for r, (s, i) in enumerate(found[:3])]

    assert sorted(tuple(r) for r in got) == best(100, [0.0, 0.0, 5.0]) + best(101, [1.0, 0.0])  # the least vector of 100


def test_top_k_of_large_components(spark):
    own = [(50, [2.0**23, 2.0**23 + 1]), (51, [2.0**23, 3.0]), (52, [2.0**23, 3.0 + 2.0**-8]), (53, [-(2.0**23), 1.0])]
    got = topk.top_k_report(spark.createDataFrame(own, "vec_id long, embedding array<double>")).collect()
    v = {i: [int(256 * c) for c in x] for i, x in own}
    want = sorted((-sum(a * b for a, b in zip(v[50], x)), i) for i, x in v.items() if i != 50)
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(i, -s) for s, i in want]


def test_most_pairs_are_never_multiplied():
    import numpy as np

    rng = np.random.default_rng(2)
    centre = rng.normal(0, 60, (40, 16)).repeat(4, axis=1)  # segments that tell the vectors apart
    v = (centre[rng.integers(0, 40, 8000)] + rng.normal(0, 20, (8000, 64))).astype(np.int64)
    s = topk.Searcher(np.arange(100), v[:100], 5)
    for i in range(0, 8000, 1000):
        s.add(np.arange(i, i + 1000), v[i : i + 1000])
    assert s.multiplied < 100 * 8000 // 4
    exact = v[:100] @ v.T
    exact[np.arange(100), np.arange(100)] = -(1 << 60)
    got = s.rows().to_pydict()["score"]
    assert got == (-np.sort(-exact, axis=1)[:, :5]).ravel().tolist()


def test_bounds_hold():
    import numpy as np

    rng = np.random.default_rng(0)
    a, b = rng.integers(-500, 500, (30, 13)).astype(float), rng.integers(-500, 500, (40, 13)).astype(float)
    exact, last = a @ b.T, None
    for s in topk.LEVELS:
        bound = topk.statistics(a, s) @ topk.statistics(b, s).T
        assert (bound >= exact - 1e-6).all()
        last = bound if last is None else last


def test_pipeline_equals_its_operators(spark, sf):
    import corpus_pipeline as p
    from quern.llm import packing
    from quern.session import table

    docs = table(spark, sf, "documents")
    kept = [docs.count()]
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == table(spark, sf, "documents").columns, name
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True)
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    want = sorted(tuple(r[k] for k in key) for r in packing.pieces(docs).collect())
    got = sorted(tuple(r[k] for k in key) for r in p.run(spark, sf).collect())
    assert got == want


def test_queries_match_their_sql(spark, sf):
    import duckdb

    from quern.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, sf)
        cur = con.execute(sql)
        at = [[d[0] for d in cur.description].index(c) for c in df.columns]
        assert sorted(map(tuple, df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=str), name
