"""Recordings in blocks give what whole ones give."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import signal, waveforms

RATE = 1000


def clip(rng, n):
    """Tones and hushes of random lengths; levels repeat, so that frames tie."""
    out = []
    while sum(map(len, out)) < n:
        level = rng.choice([0.0, 0.0, 0.001, 0.5])
        own = np.full(rng.randint(1, 400), level, np.float32)
        if rng.random() < 0.5:
            own *= np.float32(1) + np.sin(np.arange(len(own))).astype(np.float32) / 2
        out.append(own)
    return np.concatenate(out)[:n]


@pytest.fixture(scope="module")
def clips(spark):
    rng = random.Random(31)
    own = {i: clip(rng, rng.choice([1, 3, 40, 399, 400, 2000, 2400, 5000])) for i in range(60)}
    rows = [(i, y.tolist()) for i, y in own.items()] + [(100, []), (101, None)]
    return own, spark.createDataFrame(rows, "clip_id int, samples array<float>")


@pytest.mark.parametrize("size", [80, 400, waveforms.SIZE])
def test_silence_cuts_in_blocks(clips, size):
    own, df = clips
    for plan in (signal.SilencePlan(RATE, -40.0, 200, 100, 10, 50), signal.SilencePlan(RATE, -20.0, 60, 20, 20, 40), signal.SilencePlan(RATE, -30.0, 300, 30, 5, 200)):
        step = size // plan.hop * plan.hop
        got = {}
        for r in waveforms.slice_at_silence(waveforms.blocked(df, "clip_id", "samples", step), plan, "clip_id", step).collect():
            got.setdefault(r.clip_id, []).append((r.chunk, r.begin, r.end))
        want = {i: [(k, *x) for k, x in enumerate(plan.chunks(y))] for i, y in own.items()}
        assert {i: sorted(got.get(i, [])) for i in want} == want and set(got) <= set(want)


@pytest.mark.parametrize("size", [100, waveforms.SIZE])
def test_segments_in_blocks(clips, size):
    own, df = clips
    x = df.filter("clip_id < 60").select("clip_id", signal.doubles(F.col("samples")).alias("x"))
    ways = [
        (signal.energy_segments(F.col("x"), RATE, 20), lambda b: waveforms.energy_segments(b, "clip_id", RATE, 20, size)),
        (signal.simple_segments(F.col("x"), RATE, 0.02, 1.0), lambda b: waveforms.simple_segments(b, "clip_id", RATE, 0.02, 1.0, size)),
    ]
    for whole, parts in ways:
        want = x.select("clip_id", F.explode(whole).alias("s")).select("clip_id", "s.start", "s.end").collect()
        got = parts(waveforms.blocked(df, "clip_id", "samples", size)).collect()
        near = lambda rows: sorted((r.clip_id, round(r.start, 6), round(r.end, 6)) for r in rows)
        assert near(got) == near(want) and len(want) > 30


def test_a_long_recording_in_many_blocks(spark):
    """An hour at 100 samples a second in 360 blocks: 0.2 s of silence every ten seconds, one block a row."""
    blocks = spark.range(360, numPartitions=8).selectExpr(
        "0 as clip_id", "cast(id as int) as block", "transform(sequence(0, 999), i -> cast(if(i < 500 or i >= 520, 0.5, 0.0) as float)) as samples"
    )
    plan = signal.SilencePlan(100, -40.0, 1000, 100, 10, 100)
    out = waveforms.slice_at_silence(blocks, plan, "clip_id", 1000).orderBy("chunk").collect()
    assert len(out) == 361 and out[0].begin == 0 and out[-1].end == 360_000
    whole = plan.chunks(np.tile(np.where((np.arange(1000) < 500) | (np.arange(1000) >= 520), 0.5, 0.0).astype(np.float32), 360))
    assert [(r.begin, r.end) for r in out] == whole
