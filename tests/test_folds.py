"""Blocked folds: any block size gives what one pass over the whole source gives."""

import math
import random

import pytest

from quern.operators import folds, segments, training

CUES = "source_id int, idx int, start double, end double, text string, confidence double, snr double, padded boolean"


def plain(fold, rows):
    """One pass, one state."""
    out, state = [], None
    for r in rows:
        if state is None:
            state = fold.first(r)
        else:
            state, closed = fold.step(state, r)
            if closed is not None:
                out.append(fold.emit(closed))
    return out + ([fold.emit(state)] if rows else [])


def composed(fold, rows, size):
    """The same through summaries of blocks, as the states that blocks start from."""
    blocks = [rows[i : i + size] for i in range(0, len(rows), size)]
    out, state, high = [], None, None
    for own in blocks:
        now = state
        for r in own:
            if now is None:
                now = fold.first(r)
            else:
                now, closed = fold.step(now, r)
                if closed is not None:
                    out.append(fold.emit(closed))
        one = fold.summary(-math.inf if high is None else high)
        for r in own:
            one.push(r)
        state = one.apply(state)
        starts = [x[1] for x in own if x[1] is not None] + ([high] if high is not None else [])
        high = math.nan if any(map(math.isnan, starts)) else max(starts, default=None)  # as Spark has it
    return out + ([fold.emit(state)] if rows else [])


def some_cues(rng, n, odd=False):
    """On a grid of tenths, so that limits are met exactly; dense or sparse by turns."""
    out, at = [], 0.0
    for i in range(n):
        length = rng.choice([0.1, 0.2, 0.4, 0.5, 0.9, 1.0, 1.9, 2.0, 3.0, 7.0])
        gap = rng.choice([0.0, 0.1, 0.4, 0.5, 0.6, 1.5, 2.2, 3.0, 3.1, -0.3] if rng.random() < 0.5 else [0.0, 0.1, 0.3])
        at = round(at + gap, 1)
        start, end = at, round(at + length, 1)
        if odd and rng.random() < 0.05:
            start, end = rng.choice([(None, end), (start, None), (end, start), (start + 50, end + 50), (math.nan, end)])
        at = round(at + length, 1)
        out.append((i + 1, start, end, rng.choice(["a", "b", None]) if odd else f"t{i}"))
    return out


def close(a, b):
    return len(a) == len(b) and all(
        x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, abs_tol=1e-12)) for p, q in zip(a, b, strict=True) for x, y in zip(p, q, strict=True)
    )


@pytest.mark.parametrize("odd", [False, True])
def test_merging_folds_composed(odd):
    rng = random.Random(11)
    kinds = [folds.Cues(1.0, 20.0, 1.5), folds.Cues(1.5, 4.0, 1.0), folds.Cues(2.5, 9.0, 0.2), folds.Speech(0.5, 0.5), folds.Speech(3.0, 0.1), folds.Close(0.5)]
    for k in range(150):
        own = some_cues(rng, rng.randint(0, 60), odd)
        for fold in kinds:
            rows = own
            if not isinstance(fold, folds.Cues):
                rows = [(*r[:3], (r[0] % 9) / 8, rng.choice([1.0, 2.0, None]), rng.choice([True, None, False])) for r in own]
            for size in (1, 2, 3, 7, 20):
                assert close(composed(fold, rows, size), plain(fold, rows)), (k, fold, size)


def test_summaries_stay_small():
    """An hour of speech without a pause: no more intervals and texts than may join."""
    rows = [(i, i * 0.5, i * 0.5 + 0.4, "x") for i in range(7200)]
    for fold, kind in ((folds.Cues(1.0, 20.0, 1.5), 0), (folds.Speech(0.5, 0.05), 1)):
        one = fold.summary(0.0)
        for r in rows:
            one.push(r if not kind else (*r[:3], 0.5))
            assert len(one.pieces) <= 45 and len(one.rows or ()) <= 45  # 40 such segments may join


def test_losses_composed():
    rng = random.Random(12)
    for _ in range(300):
        rows = [(i + 1, rng.choice([rng.random(), rng.randint(0, 5) / 5, None])) for i in range(rng.randint(1, 50))]
        for fold in (folds.Stopping(1, 0.01, True), folds.Stopping(3, 0.0, False), folds.Stopping(8, 0.2, True), folds.Average(0.9)):
            for size in (1, 2, 5, 9):
                assert close(composed(fold, rows, size), plain(fold, rows)), (rows, fold, size)


def test_sources_of_many_blocks(spark):
    rng = random.Random(13)
    groups = {0: some_cues(rng, 700), 1: some_cues(rng, 3), 2: some_cues(rng, 90), None: some_cues(rng, 50)}
    rows = [(g, *r, (r[0] % 9) / 8, float(r[0] % 7), r[0] % 3 > 0) for g, own in groups.items() for r in own]
    df = spark.createDataFrame(rows, CUES).repartition(4)
    for block in (7, 100, 1 << 16):
        got = {}
        for r in segments.merge_short_cues(df, block=block).collect():
            got.setdefault(r.source_id, []).append(tuple(r)[1:])
        assert {g: sorted(x) for g, x in got.items()} == {g: plain(folds.Cues(1.0, 20.0, 1.5), own) for g, own in groups.items()}
        for fold, out in ((folds.Speech(0.5, 0.5), segments.merge_short_speech(df, block=block)), (folds.Close(0.5), segments.merge_close(df, block=block))):
            got = {}
            for r in out.collect():
                got.setdefault(r.source_id, []).append(tuple(r)[1:])
            for g in groups:
                want = plain(fold, [x[1:] if isinstance(fold, folds.Close) else (*x[1:4], x[5]) for x in ((r[0], *r[1:4], *r[5:]) if isinstance(fold, folds.Close) else r for r in rows) if x[0] == g])
                want = [x for x in want if isinstance(fold, folds.Close) or x[2] - x[1] >= 0.5]
                assert close(sorted(got[g]), want)
    assert segments.merge_short_cues(df.limit(0), block=7).count() == 0


def test_a_hot_source_fills_all_tasks(spark):
    """100,000 segments of one source: no task holds more than its blocks, and the fold's result stands."""
    df = spark.range(100_000, numPartitions=8).selectExpr(
        "0 as source_id", "cast(id as int) as idx", "id * 1.0d + (id div 10) as start", "id * 1.0d + (id div 10) + 0.9d as end", "0.5d as confidence"
    )
    out = segments.merge_short_speech(df, block=1000)
    assert out.count() == 10_000
    assert out.filter("round(end - start, 6) = 9.9 and idx % 10 = 0 and confidence = 0.5").count() == 10_000


def test_long_runs_of_losses(spark):
    rng = random.Random(14)
    runs = {r: [rng.random() for _ in range(200)] for r in range(5)}
    rows = [(r, i + 1, x) for r, own in runs.items() for i, x in enumerate(own)]
    df = spark.createDataFrame(rows, "run int, epoch int, val_loss double")
    whole = training.early_stop(df, 20, 0.001, True).collect()
    assert sorted(map(tuple, training.early_stop(df, 20, 0.001, True, block=7).collect())) == sorted(map(tuple, whole))
    want = {r.run: r.ema for r in training.ema(df, 0.9).collect()}
    for r in training.ema(df, 0.9, block=7).collect():
        assert math.isclose(r.ema, want[r.run], rel_tol=1e-12)
