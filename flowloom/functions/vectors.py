"""Three-vectors of columns. All of it stays inside whole-stage code generation: no arrays, no Python."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Vec(NamedTuple):
    x: Column
    y: Column
    z: Column

    def __add__(self, o: Vec) -> Vec:  # type: ignore[override]
        return Vec(self.x + o.x, self.y + o.y, self.z + o.z)

    def __sub__(self, o: Vec) -> Vec:
        return Vec(self.x - o.x, self.y - o.y, self.z - o.z)

    def __mul__(self, k) -> Vec:  # type: ignore[override]
        return Vec(self.x * k, self.y * k, self.z * k)

    def __neg__(self) -> Vec:
        return Vec(-self.x, -self.y, -self.z)

    def dot(self, o: Vec) -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: Vec) -> Vec:
        return Vec(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def norm(self) -> Column:
        return F.sqrt(self.dot(self))

    def named(self, prefix: str, names: str = "xyz") -> dict[str, Column]:
        """Columns ``prefix`` + each of ``names``, for withColumns."""
        return {prefix + n: c for n, c in zip(names, self, strict=True)}


def vec(prefix: str, names: str = "xyz") -> Vec:
    return Vec(*(F.col(prefix + n) for n in names))


def const(x: float, y: float, z: float) -> Vec:
    return Vec(F.lit(x), F.lit(y), F.lit(z))


def clip(c: Column, low: float, high: float) -> Column:
    """Like NumPy's: NaN stays NaN (Spark's greatest would keep it, its least would not)."""
    return F.when(F.isnan(c), c).otherwise(F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def unit(v: Vec, fallback: Vec, eps: float = 1e-8) -> Vec:
    """v / |v|; ``fallback`` where v is shorter than ``eps`` or not finite."""
    length = v.norm()
    good = is_finite(length) & (length >= eps)
    return Vec(*(F.when(good, a / F.greatest(length, F.lit(eps))).otherwise(b) for a, b in zip(v, fallback, strict=True)))


def with_unit(df, v: Vec, fallback: Vec, prefix: str, eps: float = 1e-8):
    """``df`` with ``unit(v)`` as ``prefix`` + x, y, z. The vector and its length are columns first, so that each is computed once."""
    raw = df.withColumns(v.named("__v")).withColumn("__n", vec("__v").norm())
    good = is_finite(F.col("__n")) & (F.col("__n") >= eps)
    out = {prefix + c: F.when(good, F.col(f"__v{c}") / F.col("__n")).otherwise(f) for c, f in zip("xyz", fallback, strict=True)}
    return raw.withColumns(out).drop("__vx", "__vy", "__vz", "__n")
