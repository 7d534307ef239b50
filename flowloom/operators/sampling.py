"""Random probes, points and masks. Draws are hashes of a seed and the row's key: the same on every engine, retry and partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.functions.draws import key_hash, uniform
from flowloom.functions.vectors import Vec, const, vec, with_unit
from flowloom.operators.geometry import winding_numbers
from flowloom.session import cut_lineage

MIN_STEP, MAX_STEP = 0.02, 0.12


def normal(seed: int, *keys: str | Column) -> Column:
    """A standard normal number for each key."""
    return F.sqrt(-2 * F.log(1.0 - uniform(2 * seed, *keys))) * F.cos(2 * math.pi * uniform(2 * seed + 1, *keys))


def sphere(seed: int, *keys: str | Column) -> Vec:
    """A direction, uniform on the sphere."""
    phi, cosine = 2 * math.pi * uniform(seed, *keys), 2 * uniform(seed + 1, *keys) - 1
    sine = F.sqrt(F.greatest(1 - cosine * cosine, F.lit(0.0)))
    return Vec(sine * F.cos(phi), sine * F.sin(phi), cosine)


def probe_walks(points: DataFrame, walks: int, base: int, sigma: float, seed: int, keys: list[str]) -> DataFrame:
    """A row per point and walk: direction d*, step. Walk w reuses base walk w modulo ``base``, perturbed by ``sigma`` and normalised.

    With sigma 0 the reused walks are equal. Points on the wall (is_wall) have step 0.
    """
    if min(walks, base) <= 0:
        raise ValueError("walks and base must be positive")
    every = points.select(*keys, "is_wall", F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk_idx")).withColumn("__b", F.col("walk_idx") % min(walks, base))
    start = every.withColumns(sphere(seed, *keys, "__b").named("__s")).withColumn("step", F.when(F.col("is_wall"), 0.0).otherwise(MIN_STEP + (MAX_STEP - MIN_STEP) * uniform(seed + 7, *keys, "__b")))
    noise = Vec(*(normal(seed + 100 + i, *keys, "walk_idx") * sigma for i in range(3))) if sigma > 0 else const(0.0, 0.0, 0.0)
    return with_unit(start, vec("__s") + noise, vec("__s"), "d").drop("__b", "__sx", "__sy", "__sz")


def sampled(points: DataFrame, n: int, seed: int, group: str, key: str) -> DataFrame:
    """``n`` rows of each group: without repeats if it has as many, else every row once and repeats for the rest."""
    order = F.row_number().over(W.partitionBy(group).orderBy(key_hash(seed, key), key))
    ranked = points.withColumn("__r", order).withColumn("__n", F.count("*").over(W.partitionBy(group)))
    times = F.when(F.col("__n") >= n, F.when(F.col("__r") <= n, 1).otherwise(0)).otherwise(F.floor((F.lit(n) - F.col("__r")) / F.col("__n")).cast("int") + 1)
    return ranked.withColumn("__t", times).where("__t > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__t") - 1))).drop("__r", "__n", "__t")


def surface_points(triangles: DataFrame, n: int, seed: int, mesh: str = "mesh_id") -> DataFrame:
    """``n`` points of each mesh's surface, with the face's normal: faces get their share by area, and what is left over by even steps from one draw.

    Face by face in order, the running area is cut at ``n`` even steps; a mesh without area gives none.
    """
    a, b, c = vec("a_"), vec("b_"), vec("c_")
    cross = triangles.withColumns((b - a).cross(c - a).named("__n")).withColumn("__area", 0.5 * vec("__n").norm())
    w = W.partitionBy(mesh).orderBy("tri").rowsBetween(W.unboundedPreceding, 0)
    run = cross.withColumn("__run", F.sum("__area").over(w)).withColumn("__total", F.max("__run").over(W.partitionBy(mesh))).where("__total > 0")
    step = lambda area: F.floor(n * area / F.col("__total") + uniform(seed, mesh))
    before = F.coalesce(F.lag("__run").over(W.partitionBy(mesh).orderBy("tri")), F.lit(0.0))
    each = run.withColumn("__k", (step(F.col("__run")) - step(before)).cast("int")).where("__k > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
    r, s = F.sqrt(uniform(seed + 1, mesh, "tri", "k")), uniform(seed + 2, mesh, "tri", "k")
    at = a * (1 - r) + b * (r * (1 - s)) + c * (r * s)
    placed = each.withColumns(at.named("") | vec("__n").named("__m"))
    return with_unit(placed, vec("__m"), const(0.0, 0.0, 1.0), "n").select(mesh, "tri", "k", "x", "y", "z", "nx", "ny", "nz")


def interior_points(triangles: DataFrame, n: int, candidates: int, seed: int, mesh: str = "mesh_id", rounds: int = 80, least: int = 1, pad: bool = True) -> DataFrame:
    """``n`` points inside each mesh: mesh, k, x, y, z, found, copy.

    A round draws ``candidates`` in the bounding boxes of the meshes that still lack points, up to ``rounds`` of them. found is
    how many points there are, ``n`` at most. A mesh with fewer than ``least`` gives none; one with fewer than ``n``
    repeats its points, in order, if ``pad`` (copy counts from 0). A round's points are a checkpoint.
    """
    low = {c: F.min(F.least(*(f"{p}_{c}" for p in "abc"))).alias(f"lo{c}") for c in "xyz"}
    high = {c: F.max(F.greatest(*(f"{p}_{c}" for p in "abc"))).alias(f"hi{c}") for c in "xyz"}
    lacking, kept = triangles.groupBy(mesh).agg(*low.values(), *high.values()), None
    for i in range(rounds):
        drawn = lacking.withColumn("k", F.explode(F.sequence(F.lit(i * candidates), F.lit((i + 1) * candidates - 1))))
        drawn = drawn.withColumns({c: F.col(f"lo{c}") + (F.col(f"hi{c}") - F.col(f"lo{c}")) * uniform(seed + j, mesh, "k") for j, c in enumerate("xyz")}).select(mesh, "k", "x", "y", "z")
        inside = cut_lineage(drawn.join(winding_numbers(drawn, triangles, [mesh, "k"], mesh).where("inside").select(mesh, "k"), [mesh, "k"]))
        kept = inside if kept is None else kept.unionByName(inside)
        enough = kept.groupBy(mesh).count().where(F.col("count") >= n).select(mesh)
        lacking = cut_lineage(lacking.join(enough, mesh, "left_anti"))  # a round plans no earlier one
        if lacking.isEmpty():
            break
    w = W.partitionBy(mesh)
    placed = kept.withColumn("__r", F.row_number().over(w.orderBy("k"))).withColumn("found", F.least(F.count("*").over(w), F.lit(n))).where((F.col("__r") <= n) & (F.col("found") >= least))
    times = F.floor((F.lit(n) - F.col("__r")) / F.col("found")).cast("int") + 1 if pad else F.lit(1)
    return placed.withColumn("copy", F.explode(F.sequence(F.lit(0), times - 1))).drop("__r")


def wall_mask(points: DataFrame, probability: float, seed: int, mode: str = "all", key: str = "sample_id") -> DataFrame:
    """Wall features zeroed in samples drawn with ``probability``: all of them, the distance, or the direction. A sample is masked whole."""
    columns = {"all": ("wall_dist", "nx", "ny", "nz"), "distance": ("wall_dist",), "direction": ("nx", "ny", "nz")}[mode]
    hit = uniform(seed, key) < probability
    return points.withColumn("masked", hit).withColumns({c: F.when(hit, 0.0).otherwise(F.col(c)) for c in columns})


def synthetic_cylinder(spark: SparkSession, samples: int, points: int, seed: int) -> DataFrame:
    """Points of unit cylinders along x in [-1, 1], uniform over the cross-section, with exact wall distance and outward normal."""
    rows = spark.range(samples * points).select(F.concat(F.lit("c"), (F.col("id") / points).cast("long")).alias("sample_id"), (F.col("id") % points).alias("point_id"), "id")
    r, phi = F.sqrt(uniform(seed, "id")), 2 * math.pi * uniform(seed + 1, "id")
    return rows.withColumns({"__r": r, "__phi": phi}).select("sample_id", "point_id", (2 * uniform(seed + 2, "id") - 1).alias("x"), (F.col("__r") * F.cos("__phi")).alias("y"), (F.col("__r") * F.sin("__phi")).alias("z"), F.greatest(1 - F.col("__r"), F.lit(0.0)).alias("wall_dist"), F.lit(0.0).alias("nx"), F.cos("__phi").alias("ny"), F.sin("__phi").alias("nz"))
