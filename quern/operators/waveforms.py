"""Long recordings as blocks of samples: a recording fills any number of tasks.

A recording is rows (key, block, samples): every block holds ``size`` samples, the last one fewer. Frames
reach into the neighbours, so each block sends them its edges; a block then has its own frames exactly as the
whole recording has them. Runs of frames are found in each block and joined where one ends at a block's border
and the next starts there. Nothing but runs, which are few, is ever brought together by recording.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators import folds
from quern.operators.signal import SilencePlan, framed_rms

#: Samples a block: whole hops of 5, 10 and 20 ms at the usual rates.
SIZE = 44100 * 32


def blocked(df: DataFrame, key: str, samples: str, size: int = SIZE) -> DataFrame:
    """(key, block, samples) of whole arrays; null and empty ones have no block."""
    n = F.size(samples)
    blocks = F.sequence(F.lit(0), F.ceil(n / size).cast("int") - 1)
    cut = F.transform(blocks, lambda i: F.struct(i.alias("block"), F.slice(samples, i * size + 1, F.lit(size)).alias("samples")))
    return df.filter(n > 0).select(key, F.explode(cut).alias("b")).select(key, "b.block", "b.samples")


def frames(blocks: DataFrame, key: str, window: int, hop: int, size: int = SIZE) -> DataFrame:
    """(key, block, first, rms, total, n): root mean squares of the frames around every hop-th sample.

    first is the number of the block's first frame; total and n, the recording's frames and samples, are
    given by its last block and null elsewhere. Beyond the recording lie zeros.
    """
    half = window // 2
    if size % hop or size < window:
        raise ValueError("a block holds whole hops and at least a window")
    own = F.col("samples").cast("array<float>")
    sent = F.array(
        F.struct(F.col("block").alias("to"), F.lit(1).alias("part"), own.alias("y")),
        F.struct((F.col("block") + 1).alias("to"), F.lit(0).alias("part"), F.slice(own, F.greatest(F.size(own) - half, F.lit(0)) + 1, F.lit(half)).alias("y")),
        F.struct((F.col("block") - 1).alias("to"), F.lit(2).alias("part"), F.slice(own, F.lit(1), F.lit(window)).alias("y")),
    )
    dealt = blocks.select(F.col(key).alias("key"), F.explode(sent).alias("s")).select("key", "s.*")
    ready = dealt.filter("to >= 0").repartition("key", "to").sortWithinPartitions("key", "to", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                yield from zip(b.column("key").to_pylist(), b.column("to").to_pylist(), b.column("part").to_pylist(), b.column("y"), strict=True)

        for (k, block), group in groupby(rows(), key=lambda r: r[:2]):
            parts = {part: np.asarray(y.values) for _, _, part, y in group}
            if 1 not in parts:  # an edge sent beyond the recording
                continue
            mine = parts[1]
            head = parts.get(0, np.zeros(0, np.float32))
            y = np.concatenate([np.zeros(half - len(head), np.float32), head, mine, parts.get(2, np.zeros(0, np.float32)), np.zeros(window, np.float32)])
            first, last = block * size // hop, 2 not in parts
            n = block * size + len(mine)
            total = max(0, n + 2 * half - window) // hop + 1
            count = (total - first) if last else size // hop
            rms = framed_rms(y, window, hop)[:count]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k], kind), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([rms.tolist()], pa.list_(pa.float64())),
                    pa.array([total if last else None], pa.int64()), pa.array([n if last else None], pa.int64()),
                ],
                names=["key", "block", "first", "rms", "total", "n"],
            )

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(dealt.schema["key"].dataType)
    out = ready.mapInArrow(run, f"key {dict(dealt.dtypes)['key']}, block int, first long, rms array<double>, total long, n long")
    return out.withColumnRenamed("key", key)


def runs(frame_rows: DataFrame, key: str, inside, *keep: str) -> DataFrame:
    """(key, start, stop, rms, run, run_start, run_stop): every block's runs of frames for which inside(rms) holds,
    with the number and the bounds of the whole run that they are part of."""
    n = F.size("rms")
    at = F.sequence(F.lit(0), n - 1)
    on = lambda i: F.coalesce(inside(F.get("rms", i)), F.lit(False))
    starts = F.filter(at, lambda i: on(i) & ((i == 0) | ~on(i - 1)))
    stops = F.filter(at, lambda i: on(i) & ((i == n - 1) | ~on(i + 1)))
    each = F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("a"), (b + 1).alias("b")))
    local = frame_rows.filter(n > 0).select(key, "first", "rms", *keep, F.explode(each).alias("r")).select(
        key, (F.col("first") + F.col("r.a")).alias("start"), (F.col("first") + F.col("r.b")).alias("stop"),
        F.slice("rms", F.col("r.a") + 1, F.col("r.b") - F.col("r.a")).alias("rms"), *keep,
    )
    order = W.partitionBy(key).orderBy("start")
    new = F.when(F.lag("stop").over(order) == F.col("start"), 0).otherwise(1)
    numbered = local.withColumn("__new", new).withColumn("run", F.sum("__new").over(order)).drop("__new")
    whole = W.partitionBy(key, "run")
    return numbered.withColumns({"run_start": F.min("start").over(whole), "run_stop": F.max("stop").over(whole)})


def runs_over(frame_rows: DataFrame, key: str, limits: DataFrame) -> DataFrame:
    """(key, start, stop, open) of runs of frames over each recording's limit (key, limit); open if at its end."""
    ends = frame_rows.filter("total is not null").select(key, "total", "n")
    found = runs(frame_rows.join(limits, key), key, lambda x: x > F.col("limit"))
    whole = found.groupBy(key, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return whole.join(ends, key).select(key, "start", "stop", (F.col("stop") == F.col("total")).alias("open"), "n")


def energy_limits(frame_rows: DataFrame, key: str) -> DataFrame:
    """(key, limit): mean and half the deviation of a recording's frames."""
    values = frame_rows.select(key, F.explode("rms").alias("x"))
    return values.groupBy(key).agg((F.avg("x") + F.stddev_pop("x") * 0.5).alias("limit"))


def median_limits(frame_rows: DataFrame, key: str, share: float = 0.3) -> DataFrame:
    """(key, limit): a share of the median of a recording's frames."""
    return frame_rows.select(key, F.explode("rms").alias("x")).groupBy(key).agg((F.median("x") * share).alias("limit"))


def _seconds(found: DataFrame, key: str, hop: int, rate: int) -> DataFrame:
    end = F.when(F.col("open"), F.col("n") / F.lit(rate)).otherwise(F.col("stop") * hop / rate)
    return found.select(key, (F.col("start") * hop / rate).alias("start"), end.alias("end"))


def energy_segments(blocks: DataFrame, key: str, rate: int, least_ms: float = 250, size: int = SIZE) -> DataFrame:
    """Speech by energy: frames of 50 ms every 20 ms over mean + std / 2, runs of 250 ms at least."""
    hop = int(rate * 0.02)
    rows = frames(blocks, key, int(rate * 0.05), hop, size)
    found = _seconds(runs_over(rows, key, energy_limits(rows, key)), key, hop, rate)
    return found.filter((F.col("end") - F.col("start")) * 1000 >= least_ms)


def simple_segments(blocks: DataFrame, key: str, rate: int, least: float, most: float, size: int = SIZE) -> DataFrame:
    """Frames of 25 ms every 10 ms over 0.3 median; runs within the duration range."""
    hop = int(rate * 0.010)
    rows = frames(blocks, key, int(rate * 0.025), hop, size)
    found = _seconds(runs_over(rows, key, median_limits(rows, key)), key, hop, rate)
    return found.filter((F.col("end") - F.col("start")).between(least, most))


class Cuts(folds.Merging):
    """Rows (start, right, stop, left, leading) of silences that are long enough; one is cut if it leads, or
    lies ``least`` frames behind the last cut. The state's start is that cut; the first row is the recording's own."""

    out = "silence long, cut_left long, cut_right long"

    def __init__(self, least: int):
        self.least = least

    def joins(self, start, end, row):
        return not (row[4] or row[2] - start >= self.least)

    def cuts(self, end, row):
        return [] if row[4] else [folds.least_start(row[2], math.nextafter(self.least, -math.inf))]

    def payload(self, row):
        return row[3]

    def both(self, payload, row):
        return payload

    def through(self, rows, row):
        return ()

    def extended(self, payload, rows):
        return payload

    def emit(self, state):
        return state[0], state[3], int(state[1])


def _quietest(low: Column, high: Column) -> Column:
    """struct(rms, at) of the quietest of a local run's frames from low to high, both inside; null if there is none."""
    a, b = F.greatest(low, F.col("start")), F.least(high, F.col("stop") - 1)
    part = F.slice("rms", F.greatest(a - F.col("start"), F.lit(0)).cast("int") + 1, F.greatest(b - a + 1, F.lit(0)).cast("int"))
    return F.array_min(F.transform(part, lambda x, i: F.struct(x.alias("x"), (a + i).alias("at"))))


def slice_at_silence(blocks: DataFrame, plan: SilencePlan, key: str = "clip_id", size: int = SIZE) -> DataFrame:
    """(key, chunk, begin, end): the sample ranges that SilencePlan.chunks keeps of each recording."""
    rows = frames(blocks, key, plan.window, plan.hop, size)
    ends = rows.filter("total is not null").select(key, "total", "n")
    kept, start, stop = plan.kept, F.col("run_start"), F.col("run_stop")
    local = runs(rows, key, lambda x: x < plan.limit)
    least = {
        "whole": _quietest(start, stop - 1), "head": _quietest(start, start + kept),
        "tail": _quietest(stop - kept, stop - 1), "middle": _quietest(stop - kept, start + kept),
    }
    silences = (
        local.withColumns(least)
        .groupBy(key, "run")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"), *[F.min(x).getField("at").alias(x) for x in least])
        .join(ends, key)
        .filter(F.ceil(F.col("n") / plan.hop) > plan.least)
        .withColumn("length", F.col("stop") - F.col("start"))
    )
    inner = silences.filter("stop < total")
    leading = (F.col("start") == 0) & (F.col("stop") > kept)
    around = (F.col("length") <= 2 * kept) & (F.col("start") > 0)
    left = F.when(F.col("length") <= kept, F.col("whole")).when(around, F.least("head", "middle")).otherwise(F.col("head"))
    right = F.when(F.col("length") <= kept, F.col("whole")).when(around, F.greatest("tail", "middle")).otherwise(F.col("tail"))
    able = inner.filter(leading | (F.col("length") >= plan.interval)).select(
        key, "start", right.cast("double").alias("right"), F.col("stop").cast("double").alias("stop"),
        F.when(F.col("start") == 0, 0).otherwise(left).alias("left"), leading.alias("leading"),
    )
    own = ends.select(key, F.lit(-1).cast("long").alias("start"), F.lit(0.0).alias("right"), F.lit(0.0).alias("stop"), F.lit(-1).cast("long").alias("left"), F.lit(False).alias("leading"))
    cut = folds.folded(own.unionByName(able), key, "start", ["right", "stop", "left", "leading"], Cuts(plan.least)).filter("silence >= 0")
    trailing = silences.filter((F.col("stop") == F.col("total")) & (F.col("length") >= plan.interval))
    tags = cut.select(key, "silence", "cut_left", "cut_right").unionByName(
        trailing.select(key, F.col("start").alias("silence"), F.col("head").alias("cut_left"), (F.col("total") + 1).alias("cut_right"))
    )
    order = W.partitionBy(key).orderBy("silence")
    before = F.lag("cut_right").over(order)
    inner = tags.select(key, F.coalesce(before, F.lit(0)).alias("a"), F.col("cut_left").alias("b"), before.isNotNull().alias("always"))
    last = ends.join(tags.groupBy(key).agg(F.max_by("cut_right", "silence").alias("a")), key, "left").select(
        key, F.coalesce("a", F.lit(0)).alias("a"), F.col("total").alias("b"), F.col("a").isNull().alias("always")
    )
    ranges = inner.unionByName(last).filter("always or b > a")
    # a recording without cuts stays whole, also the samples after its last frame
    end = F.when(F.col("always") & (F.col("a") == 0) & (F.col("b") == F.col("total")), F.col("n")).otherwise(F.least(F.col("b") * plan.hop, F.col("n")))
    chunk = F.row_number().over(W.partitionBy(key).orderBy("a", "b")) - 1
    return ranges.join(ends, key).select(key, chunk.alias("chunk"), (F.col("a") * plan.hop).alias("begin"), end.alias("end"))
