"""Outputs: partitioned tables, manifests, and the rules that decide what is written again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_samples(df: DataFrame, path: str, partition: str = "dataset", mode: str = "errorifexists") -> None:
    """Parquet by dataset. Spark's committer makes it appear as a whole or not at all."""
    df.write.mode(mode).partitionBy(partition).parquet(path)


def append_manifest(df: DataFrame, path: str) -> None:
    """JSON lines, added to those that are there."""
    df.write.mode("append").json(path)


def write_qc(rows: DataFrame, path: str) -> None:
    """The rows as JSON lines and as CSV."""
    rows.write.mode("overwrite").json(f"{path}/qc_manifest_json")
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/qc_manifest_csv")


def write_metadata(rows: DataFrame, info: DataFrame, path: str) -> None:
    """A data set's metadata as CSV and as JSON lines, and its lists of indices (list, position, index) as Parquet by list."""
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/metadata_csv")
    rows.write.mode("overwrite").json(f"{path}/metadata_json")
    info.write.mode("overwrite").partitionBy("list").parquet(f"{path}/split_info")


def with_qc(samples: DataFrame, qc: DataFrame, key: str) -> DataFrame:
    """Samples with qc_status and qc_reasons of their row in ``qc``; null without one."""
    return samples.drop("qc_status", "qc_reasons").join(qc.select(key, F.col("status").alias("qc_status"), F.col("reasons").alias("qc_reasons")), key, "left")


def stale_reason(expected: dict[str, Column], prefix: str = "found_", tolerance: float = 1e-8) -> Column:
    """The first expected value that differs from the column ``prefix`` + name, as ``name``; null if all agree. Numbers may differ by ``tolerance``."""
    differs = []
    for name, value in expected.items():
        found = F.col(prefix + name)
        close = F.coalesce(F.abs(found.cast("string").try_cast("double") - value.cast("string").try_cast("double")) <= tolerance, F.lit(False))
        differs.append(F.when(~(found.cast("string").eqNullSafe(value.cast("string")) | close), F.lit(name)))
    return F.coalesce(*differs)


def still_to_do(work: DataFrame, complete: DataFrame, key: str, reason: Column) -> DataFrame:
    """Work without a complete output, or whose output has a ``reason`` to be made again."""
    fresh = complete.where(reason.isNull()).select(key)
    return work.join(fresh, key, "left_anti")
