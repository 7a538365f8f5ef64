"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quern.session import shared_dir

EARLY_OUT = "run long, epoch int, best double, bad int, stopped boolean"
DIVERGE_OUT = "run long, epoch int, diverging boolean, wide_gap boolean"


def new_content(stream: DataFrame, hash_col: str, ts: str | None = None, delay: str = "1 day") -> DataFrame:
    """The first row of each content hash; with ts, hashes are forgotten ``delay`` after the watermark."""
    known = stream.filter(F.col(hash_col).isNotNull())
    if ts:
        return known.withWatermark(ts, delay).dropDuplicatesWithinWatermark([hash_col])
    return known.dropDuplicates([hash_col])


def unseen_sources(batch: DataFrame, done: DataFrame) -> DataFrame:
    """For foreachBatch: the rows of a batch whose source is in no earlier result."""
    return batch.join(done.select("source").distinct(), "source", "left_anti")


# --- increments merged exactly once ---------------------------------------------------------------


class ContentMerge:
    """A growing table of rows with new content, and the index of all content it knows.

    put() is for foreachBatch. A batch adds, for each content it holds and no earlier batch held, its
    first row by ``order`` (which tells rows apart); rows without content are left out. Rows lie in
    ``rows/batch=N`` and their keys in ``known/batch=N/bucket=B``, dealt out by the hash of the key; a batch
    looks at the buckets of earlier batches alone, those it has keys in. So a batch that is replayed, also
    one that failed half way or after later code has changed, finds what it found before and replaces
    its own files: every content is merged once. Restarts need no watermark and no state store.
    """

    def __init__(self, path: str, key: str, order: str, buckets: int = 64):
        self.path, self.key, self.order, self.buckets = path, key, order, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _there(self, spark: SparkSession, part: str) -> bool:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def known(self, spark: SparkSession, schema, before: int | None = None) -> DataFrame:
        """The index: key, bucket and batch, of the batches before a number."""
        kind = f"`{self.key}` {schema[self.key].dataType.simpleString()}, batch long, bucket int"
        if not self._there(spark, "known"):
            return spark.createDataFrame([], kind)
        index = spark.read.schema(kind).parquet(f"{self.path}/known")
        return index if before is None else index.filter(F.col("batch") < before)

    def put(self, batch: DataFrame, number: int) -> None:
        spark, key = batch.sparkSession, self.key
        held = batch.filter(F.col(key).isNotNull())
        row = F.struct(*[F.col(f"`{c}`") for c in batch.columns])
        first = held.groupBy(F.col(key).alias("__key")).agg(F.min_by(row, F.col(self.order)).alias("row"))
        rows = first.select(*[F.col("row").getField(c).alias(c) for c in batch.columns]).withColumn("__bucket", self._bucket())
        known = self.known(spark, batch.schema, number).select(F.col("bucket").alias("__bucket"), F.col(key))
        new = rows.join(known, ["__bucket", key], "left_anti")
        out = f"{self.path}/rows/batch={number}"
        new.select(*batch.columns).write.mode("overwrite").parquet(out)
        keys = spark.read.schema(batch.schema).parquet(out).select(key, self._bucket().alias("bucket"))
        keys.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/known/batch={number}")

    def rows(self, spark: SparkSession, schema) -> DataFrame:
        """All merged rows."""
        if not self._there(spark, "rows"):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.path}/rows").select(*schema.names)

    def run(self, stream: DataFrame) -> DataFrame:
        """Merges all that a stream has available; the checkpoint lies beside the table."""
        with state_in_rocksdb(stream.sparkSession):
            q = stream.writeStream.foreachBatch(self.put).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        return self.rows(stream.sparkSession, stream.schema)


# --- sessions -------------------------------------------------------------------------------------


def sessions(stream: DataFrame, ts: str = "ts", gap: str | Column = "500 milliseconds", delay: str = "1 minute", *keys: str) -> DataFrame:
    """Runs of events no further apart than the gap, by key; a Column gives each event its own gap."""
    w = F.session_window(ts, gap)
    return stream.withWatermark(ts, delay).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n")).select(
        *keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"
    )


def speech_runs(stream: DataFrame, max_gap: float = 0.5, delay: str = "1 minute", *keys: str) -> DataFrame:
    """Runs of segments (ts, duration in seconds) by key, where no segment starts more than max_gap
    seconds after all earlier ones of its run have ended: keys, start, end (of the last one to end), n.

    Each segment's gap is its own duration and max_gap (and a microsecond: a session's end is outside of it).
    A segment of no or unknown duration ends where it starts.
    """
    micros = F.round(F.coalesce(F.greatest("duration", F.lit(0.0)), F.lit(0.0)) * 1_000_000).cast("long")
    reach = F.lit(round(max_gap * 1_000_000) + 1)
    timed = stream.withColumn("__micros", micros).withWatermark("ts", delay)
    w = F.session_window("ts", F.concat((F.col("__micros") + reach).cast("string"), F.lit(" microseconds")))
    found = timed.groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"))
    end = F.timestamp_micros(F.unix_micros("w.end") - reach)
    return found.select(*keys, F.col("w.start").alias("start"), end.alias("end"), "n")


# --- series of losses -----------------------------------------------------------------------------


class _Series(StatefulProcessor):
    """Metrics of a run in epoch order. Those of a batch are sorted (a trigger bounds them); an epoch not
    beyond the last one taken, late or repeated, changes nothing and gives no row.

    ttl_ms: a run's state is forgotten that long after its last metric. idle_ms: a run that gives none for
    so long gets a last row by a timer, and starts anew afterwards.
    """

    ttl_ms: int | None = None
    idle_ms: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "epoch int", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = self.last.get()[0] if self.last.exists() else None
        taken = False
        for r in sorted(rows, key=lambda r: r["epoch"]):
            if last is None or r["epoch"] > last:
                if not taken:
                    self.load()
                taken, last = True, r["epoch"]
                yield self.row(key[0], r)
        if taken:
            self.save()
            self.last.update((last,))
            if self.idle_ms is not None:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.load()
        last = self.last.get()[0] if self.last.exists() else None
        closing = self.closing(key[0], last)
        self.last.clear()
        self.clear()
        if closing is not None:
            yield closing

    def close(self) -> None:
        pass


class EarlyStopping(_Series):
    def __init__(self, patience: int, least_delta: float, ttl_ms: int | None = None, idle_ms: int | None = None):
        self.patience, self.least_delta, self.ttl_ms, self.idle_ms = patience, least_delta, ttl_ms, idle_ms

    def init(self, handle):
        super().init(handle)
        self.state = handle.getValueState("state", "best double, bad int, stopped boolean", self.ttl_ms)

    def load(self):
        self.best, self.bad, self.stopped = self.state.get() if self.state.exists() else (float("inf"), 0, False)

    def save(self):
        self.state.update((self.best, self.bad, self.stopped))

    def clear(self):
        self.state.clear()

    def row(self, run, r):
        if not self.stopped:
            if r["loss"] is not None and r["loss"] < self.best - self.least_delta:
                self.best, self.bad = r["loss"], 0
            else:
                self.bad += 1
                self.stopped = self.bad >= self.patience
        return Row(run=run, epoch=r["epoch"], best=self.best, bad=self.bad, stopped=self.stopped)

    def closing(self, run, last):
        return None if self.stopped else Row(run=run, epoch=last, best=self.best, bad=self.bad, stopped=True)


class Diverging(_Series):
    def __init__(self, gap: float, ttl_ms: int | None = None):
        self.gap, self.ttl_ms = gap, ttl_ms

    def init(self, handle):
        super().init(handle)
        self.recent = handle.getListState("recent", "train double, val double", self.ttl_ms)

    def load(self):
        self.held = [tuple(x) for x in self.recent.get()] if self.recent.exists() else []

    def save(self):
        self.recent.put(self.held)

    def row(self, run, r):
        train, val = r["train_loss"], r["val_loss"]
        if train is None or val is None:
            self.held = []  # no trend across a gap
            return Row(run=run, epoch=r["epoch"], diverging=False, wide_gap=False)
        three = [*self.held, (train, val)]
        bad = len(three) == 3 and three[0][0] > three[1][0] > three[2][0] and three[0][1] < three[1][1] < three[2][1]
        self.held = three[-2:]
        return Row(run=run, epoch=r["epoch"], diverging=bad, wide_gap=bool(train > 0 and val / train > self.gap))


def early_stopping(stream: DataFrame, patience: int, least_delta: float, ttl_ms: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """A row for each metric (run, epoch, loss): best so far, epochs without improvement, stopped.

    A run that is idle for idle_ms and has not stopped gets a last row that says so. A null loss is no improvement.
    """
    one = EarlyStopping(patience, least_delta, ttl_ms, idle_ms)
    mode = "None" if ttl_ms is None and idle_ms is None else "ProcessingTime"
    return stream.select("run", "epoch", "loss").groupBy("run").transformWithState(one, EARLY_OUT, "Append", mode)


def divergence(stream: DataFrame, gap: float = 3.0, ttl_ms: int | None = None) -> DataFrame:
    """Per metric (run, epoch, train_loss, val_loss): train fell and val rose over the last three rows, and
    whether val / train exceeds the gap. The state is the last two losses of a run."""
    rows = stream.select("run", "epoch", "train_loss", "val_loss").groupBy("run")
    return rows.transformWithState(Diverging(gap, ttl_ms), DIVERGE_OUT, "Append", "None" if ttl_ms is None else "ProcessingTime")


# --- running to the end ---------------------------------------------------------------------------


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which transformWithState asks for; the session's own choice comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def drained(out: DataFrame, name: str, mode: str = "append", root: str | None = None) -> DataFrame:
    """Runs a streaming result over all that is available, into a table in the shared folder.

    The files are Parquet through foreachBatch, under the batch's number, so nothing is kept in the driver and a
    replayed batch replaces its own rows. With ``root`` a later call goes on from the checkpoint there; without,
    the files are removed when the driver's file system closes.
    """
    spark = out.sparkSession
    if root is None:
        root = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)

    def put(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/data/batch={i}")

    with state_in_rocksdb(spark):
        q = out.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/data").select(*out.columns)
