"""Queries of points against triangle meshes: nearest point, containment, ray hits and constrained walks.

A mesh's triangles are dealt into tiles, cells of a coarse grid over the mesh: about the square root of as many tiles as
there are triangles. A point first meets the boxes of its mesh's tiles, as one array; only the triangles of tiles that
may decide its answer are joined, by an equality of mesh and tile. So a mesh that is refined n times makes about the
square root of n times as many steps for a point, not n times. All of it is column arithmetic.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.vectors import Vec, clip, vec
from flowloom.session import cut_lineage

TRI = ("a_", "b_", "c_")
#: A tile farther than this many of its radii counts as one dipole in a winding number.
FAR_RADII = 4.0


def tiled(triangles: DataFrame, mesh: str = "mesh_id") -> tuple[DataFrame, DataFrame]:
    """Triangles with their __tile, and per mesh the array __tiles of (tile, box lo*, hi*, centre c*, radius r, area normal n*)."""
    low = {c: F.least(*(F.col(f"{t}{c}") for t in TRI)) for c in "xyz"}
    high = {c: F.greatest(*(F.col(f"{t}{c}") for t in TRI)) for c in "xyz"}
    middle = {c: (F.col(f"a_{c}") + F.col(f"b_{c}") + F.col(f"c_{c}")) / 3 for c in "xyz"}
    span = triangles.groupBy(mesh).agg(F.count("*").alias("__k"), *(F.min(low[c]).alias(f"__l{c}") for c in "xyz"), F.greatest(*(F.max(high[c]) - F.min(low[c]) for c in "xyz")).alias("__e"))
    cells = F.ceil(F.pow(F.col("__k"), F.lit(0.25)))
    cell = lambda c: F.least(F.floor(F.coalesce(F.try_divide((middle[c] - F.col(f"__l{c}")) * cells, F.col("__e")), F.lit(0.0))), cells - 1)
    dealt = triangles.join(span, mesh).withColumn("__tile", ((cell("x") * cells + cell("y")) * cells + cell("z")).cast("long")).drop("__k", "__e", "__lx", "__ly", "__lz")
    a, b, c = (vec(t) for t in TRI)
    normal = dealt.withColumns(((b - a).cross(c - a) * 0.5).named("__n"))
    tiles = normal.groupBy(mesh, "__tile").agg(*(F.min(low[x]).alias(f"lo{x}") for x in "xyz"), *(F.max(high[x]).alias(f"hi{x}") for x in "xyz"), *(F.sum(f"__n{x}").alias(f"n{x}") for x in "xyz"), *(F.sum(middle[x] * vec("__n").norm()).alias(f"m{x}") for x in "xyz"), F.sum(vec("__n").norm()).alias("area"))
    centre = {x: F.coalesce(F.try_divide(F.col(f"m{x}"), F.col("area")), (F.col(f"lo{x}") + F.col(f"hi{x}")) / 2) for x in "xyz"}
    tiles = tiles.withColumns({f"c{x}": v for x, v in centre.items()})
    reach = F.sqrt(sum((F.greatest(F.col(f"hi{x}") - F.col(f"c{x}"), F.col(f"c{x}") - F.col(f"lo{x}")) ** 2 for x in "xyz"), F.lit(0.0)))
    told = F.struct(F.col("__tile").alias("tile"), *(f"{k}{x}" for k in ("lo", "hi", "c", "n") for x in "xyz"), reach.alias("r"))
    return dealt, tiles.groupBy(mesh).agg(F.collect_list(told).alias("__tiles"))


def _box_distances(t: Column) -> tuple[Column, Column]:
    """Squares of the least and the greatest distance from (x, y, z) to a tile's box."""
    least = lambda x: F.greatest(t[f"lo{x}"] - F.col(x), F.col(x) - t[f"hi{x}"], F.lit(0.0))
    most = lambda x: F.greatest(F.abs(F.col(x) - t[f"lo{x}"]), F.abs(F.col(x) - t[f"hi{x}"]))
    return sum((least(x) ** 2 for x in "xyz"), F.lit(0.0)), sum((most(x) ** 2 for x in "xyz"), F.lit(0.0))


def near_triangles(points: DataFrame, triangles: DataFrame, mesh: str = "mesh_id") -> DataFrame:
    """Each point with each triangle of the tiles that may hold the nearest one: those no farther than the far side of some tile."""
    dealt, tiles = tiled(triangles, mesh)
    told = points.join(tiles, mesh).withColumn("__reach", F.array_min(F.transform("__tiles", lambda t: _box_distances(t)[1])))
    near = F.filter("__tiles", lambda t: _box_distances(t)[0] <= F.col("__reach") * (1 + 1e-12) + 1e-24)
    each = told.withColumn("__tile", F.explode(F.transform(near, lambda t: t["tile"]))).drop("__tiles", "__reach")
    return each.join(dealt, [mesh, "__tile"]).drop("__tile")


def _nearest_on_segment(p: Vec, a: Vec, b: Vec) -> Vec:
    edge = b - a
    along = F.coalesce(F.try_divide((p - a).dot(edge), edge.dot(edge)), F.lit(0.0))
    return a + edge * clip(along, 0.0, 1.0)


def closest_points(points: DataFrame, triangles: DataFrame, keys: list[str], mesh: str = "mesh_id") -> DataFrame:
    """Each point with dist, q_* (the nearest point of its mesh), tri (that triangle; ties: the lowest) and dir_* = (q - p) / (dist + 1e-8).

    Points of a mesh without triangles are left out. Degenerate triangles count as their edges.
    """
    near = near_triangles(points, triangles, mesh)
    p, a, b, c = vec(""), vec("a_"), vec("b_"), vec("c_")
    normal = near.withColumns((b - a).cross(c - a).named("__n")).withColumn("__nn", vec("__n").dot(vec("__n")))
    foot = normal.withColumn("__h", F.coalesce(F.try_divide((p - a).dot(vec("__n")), F.col("__nn")), F.lit(0.0))).withColumns((p - vec("__n") * F.col("__h")).named("__f"))
    f, n = vec("__f"), vec("__n")
    inside = (F.col("__nn") > 1e-24) & ((b - a).cross(f - a).dot(n) >= 0) & ((c - b).cross(f - b).dot(n) >= 0) & ((a - c).cross(f - c).dot(n) >= 0)
    edges = foot.withColumn("__in", inside)
    for i, (s, t) in enumerate(((a, b), (b, c), (c, a))):
        edges = edges.withColumns(_nearest_on_segment(p, s, t).named(f"__e{i}"))
    option = lambda v: F.struct((v - p).norm().alias("d"), *(x.alias(k) for k, x in v.named("", "xyz").items()))
    best = edges.withColumn("__b", F.array_min(F.array(*(option(vec(f"__e{i}")) for i in range(3)))))
    best = best.withColumn("__b", F.when(F.col("__in"), option(f)).otherwise(F.col("__b")))
    won = best.groupBy(*keys).agg(F.min(F.struct(F.col("__b.d").alias("d"), F.col("tri"), F.col("__b.x").alias("x"), F.col("__b.y").alias("y"), F.col("__b.z").alias("z"))).alias("__w"))
    out = points.join(won, keys).withColumns({"dist": F.col("__w.d"), "tri": F.col("__w.tri"), **{f"q_{x}": F.col(f"__w.{x}") for x in "xyz"}}).drop("__w")
    return out.withColumns(((vec("q_") - vec("")) * (1 / (F.col("dist") + 1e-8))).named("dir_"))


def winding_numbers(points: DataFrame, triangles: DataFrame, keys: list[str], mesh: str = "mesh_id") -> DataFrame:
    """Each point's winding (sum of solid angles over 4 pi) and inside (its magnitude above a half): sound for meshes with small holes.

    Tiles farther than ``FAR_RADII`` radii count as one dipole, their area normal at their centre, whose error is of the order
    of the square of radius over distance; the triangles of nearer ones count exactly. A point of a mesh without triangles is left out.
    """
    dealt, tiles = tiled(triangles, mesh)
    told = points.join(tiles, mesh)
    away = lambda t: F.sqrt(sum(((t[f"c{x}"] - F.col(x)) ** 2 for x in "xyz"), F.lit(0.0)))
    is_far = lambda t: away(t) > FAR_RADII * t["r"] + 1e-12
    dipole = lambda t: sum((t[f"n{x}"] * (t[f"c{x}"] - F.col(x)) for x in "xyz"), F.lit(0.0)) / F.pow(away(t), F.lit(3.0))
    far = F.aggregate(F.filter("__tiles", is_far), F.lit(0.0), lambda total, t: total + dipole(t))
    near = F.transform(F.filter("__tiles", lambda t: ~is_far(t)), lambda t: t["tile"])
    split = told.select(mesh, *(k for k in keys if k != mesh), "x", "y", "z", far.alias("__far"), near.alias("__near"))
    pairs = split.withColumn("__tile", F.explode("__near")).drop("__near").join(dealt, [mesh, "__tile"])
    for t in TRI:
        pairs = pairs.withColumns((vec(t) - vec("")).named(f"__{t}")).withColumn(f"__{t}n", vec(f"__{t}").norm())
    a, b, c = (vec(f"__{t}") for t in TRI)
    la, lb, lc = (F.col(f"__{t}n") for t in TRI)
    angle = 2 * F.atan2(a.dot(b.cross(c)), la * lb * lc + a.dot(b) * lc + b.dot(c) * la + c.dot(a) * lb)
    exact = pairs.select(*keys, angle.alias("__angle")).unionByName(split.select(*keys, F.col("__far").alias("__angle")))
    total = exact.groupBy(*keys).agg((F.sum("__angle") / (4 * math.pi)).alias("winding"))
    return total.withColumn("inside", F.abs("winding") > 0.5)


def _meets_box(t: Column) -> Column:
    """Whether the way from (x, y, z) by step along walk_* meets a tile's box, a little widened."""
    enter, leave = F.lit(0.0), F.greatest(F.col("step"), F.lit(0.0))
    for x in "xyz":
        wide = 1e-9 * (1 + F.abs(t[f"lo{x}"]) + F.abs(t[f"hi{x}"]))
        low, high, way = t[f"lo{x}"] - wide - F.col(x), t[f"hi{x}"] + wide - F.col(x), F.col(f"walk_{x}")
        flat = F.abs(way) < 1e-12
        inside = F.when((low <= 0) & (high >= 0), 1.0).otherwise(-1.0)
        enter = F.greatest(enter, F.when(flat, F.when(inside > 0, 0.0).otherwise(float("inf"))).otherwise(F.least(F.try_divide(low, way), F.try_divide(high, way))))
        leave = F.least(leave, F.when(flat, float("inf")).otherwise(F.greatest(F.try_divide(low, way), F.try_divide(high, way))))
    return enter <= leave + 1e-9


def first_hits(rays: DataFrame, triangles: DataFrame, keys: list[str], mesh: str = "mesh_id") -> DataFrame:
    """Each ray (x, y, z, walk_*, step) with hit: the least distance, up to step, at which it meets its mesh; null if it doesn't."""
    dealt, tiles = tiled(triangles, mesh)
    o, d = vec(""), vec("walk_")
    crossed = rays.join(tiles, mesh).withColumn("__tile", F.explode(F.transform(F.filter("__tiles", _meets_box), lambda t: t["tile"]))).drop("__tiles")
    pairs = crossed.join(dealt, [mesh, "__tile"])
    e1, e2 = vec("b_") - vec("a_"), vec("c_") - vec("a_")
    h = pairs.withColumns(d.cross(e2).named("__p")).withColumn("__det", e1.dot(vec("__p"))).where(F.abs("__det") > 1e-12)
    h = h.withColumns((o - vec("a_")).named("__s")).withColumn("__u", vec("__s").dot(vec("__p")) / F.col("__det")).withColumns(vec("__s").cross(e1).named("__q"))
    h = h.withColumns({"__v": d.dot(vec("__q")) / F.col("__det"), "__hit": e2.dot(vec("__q")) / F.col("__det")})
    fine = (F.col("__u") >= 0) & (F.col("__v") >= 0) & (F.col("__u") + F.col("__v") <= 1) & (F.col("__hit") >= 0) & (F.col("__hit") <= F.col("step"))
    hits = h.where(fine).groupBy(*keys).agg(F.min("__hit").alias("hit"))
    return rays.join(hits, keys, "left")


def clamped_move(rays: DataFrame, triangles: DataFrame, keys: list[str], mesh: str = "mesh_id") -> DataFrame:
    """Positions moved by step along walk_*, or to 0.99 of the way to the wall where it is hit; steps up to 1e-8 don't look for it."""
    moved = first_hits(rays, triangles, keys, mesh)
    way = F.when(F.col("hit").isNotNull() & (F.col("step") > 1e-8), F.greatest(F.col("hit") * 0.99, F.lit(0.0))).otherwise(F.col("step"))
    return moved.withColumn("__w", way).withColumns({k: v for k, v in (vec("") + vec("walk_") * F.col("__w")).named("").items()}).drop("__w", "hit")


def bisected_move(rays: DataFrame, triangles: DataFrame, keys: list[str], rounds: int = 6, mesh: str = "mesh_id") -> DataFrame:
    """Positions moved by step along walk_*; those that would end outside move 0.99 of the way that ``rounds`` bisections find.

    It asks only whether points are inside, so it does for meshes whose faces no ray hits soundly; ``clamped_move`` is exact.
    """

    def inside(df: DataFrame, way: Column) -> DataFrame:
        at = df.withColumns((vec("") + vec("walk_") * way).named("__p"))
        probes = at.select(*dict.fromkeys([mesh, *keys]), *(F.col(f"__p{x}").alias(x) for x in "xyz"))
        return df.join(winding_numbers(probes, triangles, keys, mesh).select(*keys, F.col("inside").alias("__in")), keys)

    now = inside(rays, F.col("step")).withColumns({"__out": ~F.col("__in"), "__lo": F.lit(0.0), "__hi": F.col("step").cast("double")}).drop("__in")
    held = cut_lineage(now)
    moving = held.where("__out")
    for _ in range(rounds):
        middle = (F.col("__lo") + F.col("__hi")) / 2
        told = inside(moving, middle)
        moving = cut_lineage(told.withColumns({"__lo": F.when(F.col("__in"), middle).otherwise(F.col("__lo")), "__hi": F.when(F.col("__in"), F.col("__hi")).otherwise(middle)}).drop("__in"))
    ways = moving.withColumn("__way", (F.col("__lo") + F.col("__hi")) / 2 * 0.99).unionByName(held.where("not __out").withColumn("__way", F.col("step").cast("double")))
    return ways.withColumns({k: v for k, v in (vec("") + vec("walk_") * F.col("__way")).named("").items()}).drop("__way", "__lo", "__hi", "__out")


def constrained_walk(rays: DataFrame, triangles: DataFrame, keys: list[str], steps: int = 3, mesh: str = "mesh_id") -> DataFrame:
    """A row per walker and step: its displacement from the nearest wall point. Walkers on the wall (is_wall) stay; the last step doesn't move."""
    now, out = rays, None
    for i in range(steps):
        at = closest_points(now, triangles, keys, mesh)
        seen = at.select(*keys, F.lit(i).alias("walk_step"), *(c.alias(n) for n, c in (vec("") - vec("q_")).named("d").items()))
        out = seen if out is None else out.unionByName(seen)
        if i < steps - 1:
            moving = clamped_move(now.where(~F.col("is_wall")), triangles, keys, mesh)
            now = cut_lineage(moving.select(*now.columns).unionByName(now.where("is_wall")))
    return out


def cylinder_wall(points: DataFrame) -> DataFrame:
    """Wall distance and outward normal of a cylinder of radius 1 along x: exact, for checks of the mesh queries."""
    r = F.sqrt(F.col("y") ** 2 + F.col("z") ** 2)
    return points.withColumns({"wall_dist": clip(1.0 - r, 0.0, 1.0), "nx": F.lit(0.0), "ny": F.coalesce(F.try_divide(F.col("y"), r), F.lit(1.0)), "nz": F.coalesce(F.try_divide(F.col("z"), r), F.lit(0.0))})
