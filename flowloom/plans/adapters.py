"""The canonical tables, read from the driver's tables, and the same as SQL for the oracle.

points: one row per (sample, point) with position, wall distance, wall normal, a probe's direction and step, and a
predicted and a true flow (p, u, v, w). cfd: solver rows of a sample without a point id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.session import table

#: column -> position in the embedding
_AT = {"x": 0, "y": 1, "z": 2, "dx": 7, "dy": 8, "dz": 9, "pp": 11, "pu": 12, "pv": 13, "pw": 14, "tp": 15, "tu": 16, "tv": 17, "tw": 18}


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    n = F.sqrt(e(4) * e(4) + e(5) * e(5) + e(6) * e(6)) + 1e-8
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("s"), F.col("label")).alias("sample_id"), F.col("vec_id").alias("point_id"), *(e(i).alias(c) for c, i in _AT.items()),
        F.abs(e(3)).alias("wall_dist"), (e(4) / n).alias("nx"), (e(5) / n).alias("ny"), (e(6) / n).alias("nz"), F.abs(e(10)).alias("step"),
    )


_N = "(sqrt(embedding[5]::DOUBLE ** 2 + embedding[6]::DOUBLE ** 2 + embedding[7]::DOUBLE ** 2) + 1e-8)"
POINTS = (
    "points AS (SELECT 's' || label AS sample_id, vec_id AS point_id, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS {c}" for c, i in _AT.items())
    + f", abs(embedding[4]::DOUBLE) AS wall_dist, embedding[5]::DOUBLE / {_N} AS nx, embedding[6]::DOUBLE / {_N} AS ny, embedding[7]::DOUBLE / {_N} AS nz, abs(embedding[11]::DOUBLE) AS step FROM embeddings)"
)


def cfd(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_suppkey").alias("sample_id"), (F.col("l_tax") * 10).alias("p"), (F.col("l_quantity") / 50).alias("u"), (F.col("l_extendedprice") / 99991).alias("v"), F.col("l_discount").alias("w"))


CFD = "cfd AS (SELECT l_suppkey AS sample_id, l_tax * 10 AS p, l_quantity / 50 AS u, l_extendedprice / 99991 AS v, l_discount AS w FROM lineitem)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the last bits of two engines don't differ; -0.0 becomes 0.0."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))
