"""Sample-wide moments, principal frames and wall coordinates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.vectors import clip, is_finite, vec, with_unit

AXES = ("axis_", "side_", "normal_")


def moments(points: DataFrame, key: str = "sample_id") -> DataFrame:
    """One row per sample: n, mean position and the six sample covariances, in one aggregation with map-side combine."""
    pair = lambda a, b: F.covar_samp(a, b).alias(f"c{a}{b}")
    return points.groupBy(key).agg(F.count("*").alias("n"), *(F.avg(a).alias(f"center_{a}") for a in "xyz"), *(pair(a, b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")))


def _frame_of(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (largest first) and the orthonormal axis, side and normal of a covariance, with a fixed sign rule."""
    if not np.isfinite(c).all():
        return np.full(3, np.nan), np.eye(3)
    values, vectors = np.linalg.eigh(c)
    axis, side = (v * (1.0 if v[np.argmax(np.abs(v))] >= 0 else -1.0) for v in (vectors[:, 2], vectors[:, 1]))
    return values[::-1], np.stack([axis, side, np.cross(axis, side)])


def principal_axes(moments_df: DataFrame, key: str = "sample_id") -> DataFrame:
    """Adds eigenvalues l1 >= l2 >= l3 and the vectors axis_*, side_*, normal_* to each row of ``moments``.

    The sign rule makes the component of largest magnitude positive, so that the frame does not hang on rounding; the
    normal is axis x side. A sample of one point, or with a moment that isn't finite, has the coordinate axes. One row
    per sample goes through Arrow, never a point.
    """
    names = ["l1", "l2", "l3", *(a + c for a in AXES for c in "xyz")]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in moments_df.schema), *(f"{n} double" for n in names)])

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            m = pdf[["cxx", "cxy", "cxz", "cxy", "cyy", "cyz", "cxz", "cyz", "czz"]].to_numpy(float).reshape(-1, 3, 3)
            out = [np.concatenate([v, f.ravel()]) for v, f in map(_frame_of, m)]
            yield pd.concat([pdf, pd.DataFrame(np.reshape(out, (-1, 12)), columns=names, index=pdf.index)], axis=1)

    return moments_df.mapInPandas(solve, schema)


def fixed_axes(moments_df: DataFrame) -> DataFrame:
    """The coordinate axes instead of principal ones: for data in a known pose, and for checks."""
    one = {a + c: F.lit(1.0 if i == j else 0.0) for i, a in enumerate(AXES) for j, c in enumerate("xyz")}
    return moments_df.withColumns(one)


def p95_scale(c: Column) -> Column:
    """95th percentile of the finite positive values; their maximum, then 1, where it is below 1e-8."""
    good = F.when(is_finite(c) & (c > 0), c)
    p, top = F.percentile(good, 0.95), F.max(good)
    return F.when(p >= 1e-8, p).when(top >= 1e-8, top).otherwise(1.0)


def with_frame(points: DataFrame, frame: DataFrame, key: str = "sample_id") -> DataFrame:
    """Points with their sample's frame; a sample has one frame row, so its points are only looked up."""
    return points.join(frame.drop("n", "cxx", "cxy", "cxz", "cyy", "cyz", "czz", "l1", "l2", "l3"), key)


def axial_scales(framed: DataFrame, key: str = "sample_id") -> DataFrame:
    """Per sample: the least axial offset, its span (1 where under 1e-8), and the scale of wall distances."""
    offset = (vec("") - vec("center_")).dot(vec("axis_"))
    good = F.when(is_finite(offset), offset)
    span = F.max(good) - F.min(good)
    return framed.groupBy(key).agg(F.coalesce(F.min(good), F.lit(0.0)).alias("axial_min"), F.when(span >= 1e-8, span).otherwise(1.0).alias("axial_span"), p95_scale(F.greatest(F.col("wall_dist"), F.lit(0.0))).alias("dist_scale"))


def wall_coordinates(framed: DataFrame, scales: DataFrame, key: str = "sample_id") -> DataFrame:
    """Adds axial (0 to 1 along the axis) and rho (0 at the wall, 1 from the 95th percentile of distances on)."""
    offset = F.col("__along")
    placed = framed.join(scales, key).withColumn("__along", (vec("") - vec("center_")).dot(vec("axis_")))
    return placed.withColumns({"axial": clip((offset - F.col("axial_min")) / F.col("axial_span"), 0.0, 1.0), "rho": clip(F.greatest(F.col("wall_dist"), F.lit(0.0)) / F.col("dist_scale"), 0.0, 1.0)}).drop("__along")


def with_radial(points: DataFrame) -> DataFrame:
    """Adds rad_* and swirl_*, the unit vectors away from the axis and around it, wall (1 - rho) and phase (sine along the axis)."""
    axis = vec("axis_")
    centred = points.withColumns((vec("") - vec("center_")).named("__o"))
    off = vec("__o")
    out = with_unit(centred, off - axis * off.dot(axis), vec("side_"), "rad_")
    out = with_unit(out, axis.cross(vec("rad_")), vec("normal_"), "swirl_")
    return out.withColumns({"wall": 1.0 - F.col("rho"), "phase": F.sin(F.lit(math.pi) * F.col("axial"))}).drop("__ox", "__oy", "__oz")
