"""Session factory and shared scratch storage.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``: driver and executors
share it, so a lost executor loses no data. A temporary folder is used only where the setting is
absent (local tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "quern", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own session instead."""
    n = cores or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    b = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("QUERN_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and scratch tables; reads ``spark.checkpoint.dir`` first."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not path:
        path = "file://" + os.path.join(tempfile.gettempdir(), f"quern-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries run inside free their shuffle files when they end, not when the driver's JVM next collects.

    For results that are written or checkpointed: nothing reads those shuffles again. While a query
    runs its files stay, so that only what a lost executor held is made again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the reread table.

    Cuts the lineage, survives lost executors, and gives the planner the table's true size.
    The files are removed when the driver's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    with shuffles_freed(spark):
        df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Removes the files of a stored() table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def spread(df: DataFrame, least: int = 4 << 20) -> DataFrame:
    """df dealt over all cores if its files are too small to keep them busy (under ``least`` bytes a core): a file
    of one row group is one task. Larger tables have splits enough and are left alone."""
    spark = df.sparkSession
    cores, hadoop = spark.sparkContext.defaultParallelism, spark.sparkContext._jsc.hadoopConfiguration()
    size = 0
    for f in df.inputFiles():
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        size += p.getFileSystem(hadoop).getFileStatus(p).getLen()
        if size > cores * least:
            return df
    return df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
