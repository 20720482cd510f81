"""Session helpers: table paths and durable cut points for long lineages."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of ids up to which a kept list is broadcast: some 20 MB for two ids a row.
FEW = 1 << 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where it is unset, the context's own, or in local mode a new one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer referred to (a full collection: for large shuffles only)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Fewer rows in an Arrow batch while whole texts are read by the (eager) jobs inside: a batch of long texts is held several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` so that later plans neither recompute it nor depend on one executor's disk."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def few(kept: DataFrame) -> DataFrame:
    """``kept`` (rows of ids, already stored), to be broadcast where it is short, so that what it meets is not shuffled."""
    return F.broadcast(kept) if kept.count() <= FEW else kept


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back (column pruning still applies)."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    kept = spark.read.parquet(path)
    kept.written_to = path
    return kept


def discard(df: DataFrame) -> None:
    """Delete what ``written`` wrote for ``df`` itself, once nothing will read it again; other tables are left alone."""
    folder = getattr(df, "written_to", None)
    if folder:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
