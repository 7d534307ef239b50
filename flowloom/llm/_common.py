"""What the text operators share: scratch tables in the cluster's shared folder, and bounded Arrow slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task's vectorised code holds at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share, or the context's checkpoint folder.

    With neither set, a local session (tests) gets a folder of this machine; on a cluster that is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='flowloom-')}")
        found = context.getCheckpointDir()
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/flowloom/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df``, written as Parquet to the shared folder and read back: lineage is cut and a lost executor costs nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_or_whole(df: DataFrame, name: str, most_rows: int = 100_000, size: Column | None = None, most_bytes: int = 32 << 20) -> tuple[DataFrame, bool]:
    """``df`` as a table, and whether it is small: at most ``most_rows`` rows and, if ``size`` gives a row's bytes, ``most_bytes``.

    Only a small table is marked for broadcast; larger ones are joined as Spark chooses.
    """
    table = materialize(df, name)
    rows, total = table.agg(F.count("*"), F.coalesce(F.sum(F.lit(0) if size is None else size), F.lit(0))).first()
    small = rows <= most_rows and total <= most_bytes
    return (F.broadcast(table) if small else table), small


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, cut so that ``column`` holds about ``limit`` bytes in each slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(size)
        yield batch.slice(start)
