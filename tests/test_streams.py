"""Streams that are stopped, killed, replayed and restarted give the rows of one run."""

import random
import time

import pytest

from quern.operators import segments
from quern.session import shared_dir
from quern.streaming import incremental


@pytest.fixture
def root(spark):
    return f"{shared_dir(spark)}/test-stream-{random.randrange(10**12)}"


def write(spark, path, rows, kind):
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)


LOSSES = "run long, epoch int, loss double"


def stopped(rows, patience, delta):
    """The plain loop, over epochs in order."""
    out, best, bad, stop = [], float("inf"), 0, False
    for e, x in rows:
        if not stop:
            if x is not None and x < best - delta:
                best, bad = x, 0
            else:
                bad += 1
                stop = bad >= patience
        out.append((e, best, bad, stop))
    return out


def test_early_stopping_over_restarts(spark, root):
    rng = random.Random(1)
    runs = {r: [(e, rng.choice([rng.random(), rng.random(), None])) for e in range(1, 31)] for r in range(6)}
    for low in (1, 11, 21):  # three runs of the query, with late and repeated epochs in the later files
        rows = [(r, e, x) for r, own in runs.items() for e, x in own if low <= e < low + 10]
        rows += [(r, e, -5.0) for r in runs for e in ((3, low - 1) if low > 1 else ())]
        rng.shuffle(rows)
        write(spark, f"{root}/in", rows, LOSSES)
        s = spark.readStream.schema(LOSSES).parquet(f"{root}/in")
        got = incremental.drained(incremental.early_stopping(s, 4, 0.01), "t", root=f"{root}/out")
    out = {}
    for r in got.collect():
        out.setdefault(r.run, []).append((r.epoch, r.best, r.bad, r.stopped))
    assert {r: sorted(x) for r, x in out.items()} == {r: stopped(own, 4, 0.01) for r, own in runs.items()}


def test_divergence_over_restarts(spark, root):
    kind = "run long, epoch int, train_loss double, val_loss double"
    rows = [(1, 1, 3.0, 1.0), (1, 2, 2.0, 2.0), (1, 3, 1.0, 4.0), (1, 4, 0.5, 5.0), (1, 5, None, 6.0), (1, 6, 0.4, 7.0), (1, 7, 0.3, 8.0), (1, 8, 0.2, 9.0)]
    for part in (rows[:2], rows[2:7], [*rows[7:], rows[0]]):
        write(spark, f"{root}/in", part, kind)
        s = spark.readStream.schema(kind).parquet(f"{root}/in")
        got = incremental.drained(incremental.divergence(s), "t", root=f"{root}/out")
    assert sorted((r.epoch, r.diverging, r.wide_gap) for r in got.collect()) == [
        (1, False, False), (2, False, False), (3, True, True), (4, True, True), (5, False, False), (6, False, True), (7, False, True), (8, True, True),
    ]


def test_a_killed_stream_goes_on(spark, root):
    """The sink fails after it has written a batch: the replayed batch replaces it, the state is not counted twice."""
    own = [(e, 1.0) for e in range(1, 13)]
    for low in (1, 5, 9):
        write(spark, f"{root}/in", [(7, e, x) for e, x in own if low <= e < low + 4], LOSSES)
        time.sleep(1.1)  # files are taken by their time
    s = spark.readStream.schema(LOSSES).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    failed = []

    def put(batch, i):
        batch.write.mode("overwrite").parquet(f"{root}/out/data/batch={i}")
        if i == 1 and not failed:
            failed.append(i)
            raise RuntimeError("killed")

    out = incremental.early_stopping(s, 100, 0.0)
    for attempt in range(2):
        with incremental.state_in_rocksdb(spark):
            q = out.writeStream.foreachBatch(put).option("checkpointLocation", f"{root}/out/checkpoint").trigger(availableNow=True).start()
        if attempt == 0:
            with pytest.raises(Exception, match="killed"):
                q.awaitTermination()
        else:
            q.awaitTermination()
    got = spark.read.schema(incremental.EARLY_OUT).parquet(f"{root}/out/data").collect()
    assert failed and sorted((r.epoch, r.best, r.bad, r.stopped) for r in got) == stopped(own, 100, 0.0)


def test_an_idle_run_is_closed(spark, root):
    write(spark, f"{root}/in", [(1, 1, 0.5), (1, 2, 0.6)], LOSSES)
    s = spark.readStream.schema(LOSSES).parquet(f"{root}/in")
    rows = []
    with incremental.state_in_rocksdb(spark):
        out = incremental.early_stopping(s, 9, 0.0, idle_ms=500)
        q = out.writeStream.foreachBatch(lambda b, i: rows.extend(map(tuple, b.collect()))).option("checkpointLocation", f"{root}/c").trigger(processingTime="200 milliseconds").start()
    until = time.time() + 60
    while len(rows) < 3 and time.time() < until:
        time.sleep(0.2)
    q.stop()
    assert rows[:3] == [(1, 1, 0.5, 0, False), (1, 2, 0.5, 1, False), (1, 2, 0.5, 1, True)]


DOCS = "h string, pos long, what string"


def test_increments_are_merged_once(spark, root):
    """Batches overlap each other and hold repeats; one fails half way, one is replayed after later ones."""
    rng = random.Random(2)
    batches = [[(rng.choice([None, *(f"h{k}" for k in range(40))]), 100 * b + i, f"b{b}") for i in range(60)] for b in range(4)]
    merge = incremental.ContentMerge(root, "h", "pos", buckets=5)
    frames = [spark.createDataFrame(x, DOCS).repartition(3) for x in batches]
    want, seen = [], set()
    for own in batches:
        for h, pos, what in sorted(own, key=lambda r: r[1]):
            if h is not None and h not in seen:
                seen.add(h)
                want.append((h, pos, what))

    def rows():
        return sorted(map(tuple, merge.rows(spark, frames[0].schema).collect()))

    merge.put(frames[0], 0)
    merge.put(frames[1], 1)
    merge.put(frames[1], 1)  # replayed at once
    frames[2].limit(5).write.parquet(f"{root}/rows/batch=2")  # half written, then replayed
    merge.put(frames[2], 2)
    merge.put(frames[3], 3)
    assert rows() == sorted(want)
    merge.put(frames[1], 1)  # replayed after later batches: earlier content alone counts
    merge.put(frames[3], 3)
    assert rows() == sorted(want)
    assert merge.known(spark, frames[0].schema).count() == len(want)


def test_increments_over_restarts(spark, root):
    write(spark, f"{root}/in", [("a", 1, "x"), ("b", 2, "x"), ("a", 0, "x")], DOCS)
    s = spark.readStream.schema(DOCS).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    assert sorted(map(tuple, incremental.ContentMerge(f"{root}/out", "h", "pos").run(s).collect())) == [("a", 0, "x"), ("b", 2, "x")]
    write(spark, f"{root}/in", [("a", 3, "y"), ("c", 4, "y"), (None, 5, "y")], DOCS)
    got = incremental.ContentMerge(f"{root}/out", "h", "pos").run(s)
    assert sorted(map(tuple, got.collect())) == [("a", 0, "x"), ("b", 2, "x"), ("c", 4, "y")]


def test_speech_runs_are_merge_close(spark, root):
    """Segments that do not hold one another: as a stream and as a table they form the same runs."""
    rng = random.Random(3)
    rows, at = [], 0
    for i in range(300):
        at += rng.choice([0, 100, 499, 500, 501, 900])
        length = rng.choice([0, 100, 700, 1500])
        rows.append((i % 3, i, at / 1000, (at + length) / 1000, length / 1000))
        at += length
    kind = "source_id int, idx int, start double, end double, duration double"
    table = spark.createDataFrame(rows, kind).selectExpr("*", "0.5d as confidence", "1.0d as snr", "true as padded")
    timed = table.selectExpr("source_id", "duration", "timestamp_millis(cast(round(start * 1000) as long)) as ts")
    timed.write.parquet(f"{root}/in")
    s = spark.readStream.schema(timed.schema).parquet(f"{root}/in")
    got = incremental.drained(incremental.speech_runs(s, 0.5, "1 minute", "source_id"), "t", "complete")
    ms = "cast(round({0} * 1000) as long)"
    want = segments.merge_close(table, 0.5).selectExpr("source_id", f"{ms.format('start')} as a", f"{ms.format('end')} as b", "n")
    assert sorted(map(tuple, got.selectExpr("source_id", "unix_millis(start)", "unix_millis(end)", "n").collect())) == sorted(map(tuple, want.collect()))
