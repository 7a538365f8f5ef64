"""Interval joins of any lengths and content merges with very common hashes, against plain loops."""

import random

from quern.operators import metadata, segments

KIND = "source_id int, idx int, start double, end double"


def intervals(rng, n):
    out = []
    for i in range(n):
        start = rng.choice([rng.random() * 1000, float(rng.randint(0, 1000)), -rng.random() * 50])
        length = rng.choice([0.0, 0.5, 1, 2, 4, 30, 100, 900, 86400.0, -3.0, rng.random() * 50])
        out.append((rng.choice([0, 1]), i, start if rng.random() > 0.03 else None, start + length))
    return out


def test_overlaps_of_all_lengths(spark):
    rng = random.Random(21)
    a, b = intervals(rng, 250), intervals(rng, 200)
    left, right = spark.createDataFrame(a, KIND), spark.createDataFrame(b, KIND)
    for width in (1.0, 7.0):
        got = [(r.source_id, r.idx, r.b_idx) for r in segments.overlapping(left, right, width).collect()]
        want = {
            (x[0], x[1], y[1]) for x in a for y in b if x[0] == y[0] and None not in (*x, *y) and x[2] < y[3] and y[2] < x[3]
        }
        assert len(got) == len(want) and set(got) == want
    inside = {(r.source_id, r.idx, r.b_idx) for r in segments.contained(right, left).collect()}
    assert inside == {(s, i, j) for s, i, j in want for x in [a[i]] for y in [b[j]] if y[2] >= x[2] and y[3] <= x[3]}
    assert segments.overlapping(left, right.limit(0)).count() == 0


def test_a_long_interval_makes_few_rows(spark):
    """A hundred days beside a thousand seconds: each interval looks up two sizes."""
    short = spark.range(1000).selectExpr("0 as source_id", "cast(id as int) as idx", "cast(id as double) as start", "id + 0.9d as end")
    long = spark.createDataFrame([(0, 0, 0.0, 8_640_000.0)], KIND)
    out = segments.overlapping(short, long)
    assert out.count() == 1000
    plan = out._jdf.queryExecution().executedPlan()
    nodes, rows = [plan], []
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "Generate":
            rows.append(node.metrics().get("numOutputRows").get().value())
        kids = node.children()
        nodes += [kids.apply(i) for i in range(kids.size())]
        for name in ("executedPlan", "plan"):
            if name in [m.getName() for m in node.getClass().getMethods()] and not kids.size():
                nodes.append(getattr(node, name)())
    assert rows and sum(rows) <= 3 * 1000 + 100


def test_merge_by_content(spark):
    rng = random.Random(22)
    hashes = ["silence"] * 300 + [f"h{rng.randint(0, 60)}" for _ in range(200)] + [None] * 10
    rng.shuffle(hashes)
    new = [(h, i, "x") for i, h in enumerate(hashes)]
    base = [(f"h{i}",) for i in range(0, 60, 7)] + [(None,), ("h0",)]
    df = spark.createDataFrame(new, "h string, pos int, status_before string").repartition(3)
    got = {r.pos: r.status for r in metadata.merge_by_content(spark.createDataFrame(base, "h string"), df, "h", "pos").collect()}
    seen, want = {x for x, in base if x}, {}
    for h, i, _ in new:
        want[i] = "error" if h is None else "duplicate" if h in seen else "added"
        seen.add(h)
    assert got == want
