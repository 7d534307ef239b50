"""Meshes as tables of faces (mesh, tri, a, b, c) and vertices (mesh, vertex, x, y, z): orientation, smoothing, walls of volume cells, merging of points."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators.graphs import connected_components
from flowloom.session import cut_lineage

#: Faces of volume cells by their type's number, as places in a cell's list of nodes, counted so that normals point outwards (fixed values of the format).
CELL_FACES = {
    10: [(0, 2, 1), (0, 1, 3), (1, 2, 3), (0, 3, 2)],
    12: [(0, 4, 7, 3), (1, 2, 6, 5), (0, 1, 5, 4), (3, 7, 6, 2), (0, 3, 2, 1), (4, 5, 6, 7)],
    13: [(0, 1, 2), (3, 5, 4), (0, 3, 4, 1), (1, 4, 5, 2), (2, 5, 3, 0)],
    14: [(0, 3, 2, 1), (0, 1, 4), (1, 2, 4), (2, 3, 4), (3, 0, 4)],
}


def _sides(faces: DataFrame, mesh: str) -> DataFrame:
    """mesh, tri, p < q and whether the face runs from p to q, of each face's three sides."""
    sides = F.array(*(F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q"), (F.col(p) < F.col(q)).alias("up")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))))
    return faces.select(mesh, "tri", F.explode(sides).alias("s")).select(mesh, "tri", "s.*")


def oriented(faces: DataFrame, mesh: str = "mesh_id") -> DataFrame:
    """``faces`` turned so that neighbours run along their common side in opposite ways, with component (the least tri) and orientable.

    Each component follows its least face. A side of two faces that run along it alike says that one of them must turn: a parity, which is
    carried along all sides. Where parities contradict each other (a strip with a twist), orientable is false. Sides
    of more than two faces join nothing.
    """
    sides = _sides(faces, mesh)
    pairs = sides.groupBy(mesh, "p", "q").agg(F.count("*").alias("n"), F.min(F.struct("tri", "up")).alias("x"), F.max(F.struct("tri", "up")).alias("y")).where("n = 2 and x.tri <> y.tri")
    pairs = cut_lineage(pairs.select(mesh, F.struct(mesh, F.col("x.tri").alias("tri")).alias("x"), F.struct(mesh, F.col("y.tri").alias("tri")).alias("y"), (F.col("x.up") == F.col("y.up")).cast("int").alias("sign")))
    found = cut_lineage(connected_components(pairs, "x", "y", F.col("sign")))
    at = lambda end: found.select(F.col("node").alias(end), F.col("component").alias("component"), F.col("flip").alias(f"flip_{end}"))
    wrong = pairs.join(at("x"), "x").join(at("y").drop("component"), "y").where(F.col("flip_x").bitwiseXOR(F.col("flip_y")) != F.col("sign")).select("component").distinct().withColumn("wrong", F.lit(True))
    told = found.join(wrong, "component", "left").select(F.col(f"node.{mesh}").alias(mesh), F.col("node.tri").alias("tri"), F.col("component.tri").alias("component"), "flip", F.col("wrong").isNull().alias("orientable"))
    out = faces.join(told, [mesh, "tri"], "left")
    turn = F.coalesce("flip", F.lit(0)) == 1
    rest = [c for c in faces.columns if c not in ("b", "c")]
    return out.select(*rest, F.when(turn, F.col("c")).otherwise(F.col("b")).alias("b"), F.when(turn, F.col("b")).otherwise(F.col("c")).alias("c"), F.coalesce("component", "tri").alias("component"), F.coalesce("orientable", F.lit(True)).alias("orientable"))


def with_corners(faces: DataFrame, vertices: DataFrame, mesh: str = "mesh_id") -> DataFrame:
    """``faces`` with their corners' coordinates: a_x to c_z."""
    for corner in "abc":
        faces = faces.join(vertices.select(mesh, F.col("vertex").alias(corner), *(F.col(x).alias(f"{corner}_{x}") for x in "xyz")), [mesh, corner])
    return faces


def volumes(faces: DataFrame, vertices: DataFrame, keys: list[str]) -> DataFrame:
    """Signed volume for each of ``keys`` (the first is the mesh)."""
    from flowloom.functions.vectors import vec

    a, b, c = vec("a_"), vec("b_"), vec("c_")
    return with_corners(faces, vertices, keys[0]).groupBy(*keys).agg(F.sum(a.dot(b.cross(c)) / 6.0).alias("volume"))


def turned_outwards(faces: DataFrame, vertices: DataFrame, mesh: str = "mesh_id") -> DataFrame:
    """``faces``, as ``oriented`` gives them, with every component turned so that it bounds a volume above 0."""
    volume = volumes(faces, vertices, [mesh, "component"])
    back = F.col("volume") < 0
    out = faces.join(volume, [mesh, "component"]).select(*(c for c in faces.columns if c not in ("b", "c")), F.when(back, F.col("c")).otherwise(F.col("b")).alias("b"), F.when(back, F.col("b")).otherwise(F.col("c")).alias("c"))
    return out.select(faces.columns)


def smoothed(vertices: DataFrame, faces: DataFrame, rounds: int = 10, rate: float = 0.5, keep_volume: bool = True, mesh: str = "mesh_id", every: int = 3) -> DataFrame:
    """``vertices`` moved ``rounds`` times by ``rate`` of the way to the mean of their neighbours, all at once.

    With ``keep_volume``, each round scales a mesh about the origin to the volume it had at first. A vertex in no face stays where it
    is, but for the scaling. Lineage is cut each ``every`` rounds.
    """
    sides = _sides(faces, mesh).select(mesh, "p", "q").distinct()
    ways = cut_lineage(sides.select(mesh, F.col("p").alias("vertex"), F.col("q").alias("other")).unionByName(sides.select(mesh, F.col("q").alias("vertex"), F.col("p").alias("other"))))
    at = vertices.select(mesh, "vertex", *"xyz")
    first = cut_lineage(volumes(faces, at, [mesh]).select(mesh, F.col("volume").alias("first"))) if keep_volume else None
    for n in range(1, rounds + 1):
        other = at.select(mesh, F.col("vertex").alias("other"), *"xyz")
        means = ways.join(other, [mesh, "other"]).groupBy(mesh, "vertex").agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
        at = at.join(means, [mesh, "vertex"], "left").select(mesh, "vertex", *(F.coalesce(F.col(c) + rate * (F.col(f"m{c}") - F.col(c)), F.col(c)).alias(c) for c in "xyz"))
        if keep_volume:
            at = cut_lineage(at)  # read for the volume and for the scaling
            scale = volumes(faces, at, [mesh]).join(first, mesh).select(mesh, F.coalesce(F.cbrt(F.col("first") / F.nullif("volume", F.lit(0.0))), F.lit(1.0)).alias("scale"))
            at = at.join(scale, mesh, "left").select(mesh, "vertex", *((F.col(c) * F.coalesce("scale", F.lit(1.0))).alias(c) for c in "xyz"))
        if n % every == 0 and n < rounds:
            at = cut_lineage(at)
    return at


def wall_of_cells(cells: DataFrame, mesh: str = "mesh_id") -> DataFrame:
    """mesh, a, b, c: the triangles of the faces that only one volume cell has.

    ``cells`` has cell (a number), type and nodes, in the order of the mesh format: tetrahedra (10), hexahedra (12), wedges (13)
    and pyramids (14); other types are left out. Faces are met by their sorted nodes. One of four corners is cut from its
    least node, one where nodes coincide loses the corner. Normals point out of the cell, if its nodes are in order.
    """
    faces = F.array()
    for kind, lists in CELL_FACES.items():
        made = F.array(*(F.array(*(F.get("nodes", F.lit(n)) for n in f)) for f in lists))
        faces = F.when(F.col("type") == kind, made) if kind == 10 else faces.when(F.col("type") == kind, made)
    each = cells.select(mesh, F.explode(faces).alias("f"))
    once = each.groupBy(mesh, F.array_sort("f").alias("key")).agg(F.count("*").alias("n"), F.first("f").alias("f")).where("n = 1")
    at = F.array_position("f", F.array_min("f")).cast("int") - 1
    ring = F.concat(F.slice("f", at + 1, F.size("f")), F.slice("f", F.lit(1), at))  # from the least node on
    fans = F.array(F.array(F.get("r", F.lit(0)), F.get("r", F.lit(1)), F.get("r", F.lit(2))), F.array(F.get("r", F.lit(0)), F.get("r", F.lit(2)), F.get("r", F.lit(3))))
    out = once.select(mesh, ring.alias("r")).select(mesh, F.explode(F.when(F.size("r") == 3, F.slice(fans, 1, 1)).otherwise(fans)).alias("t"))
    return out.where(F.size(F.array_distinct("t")) == 3).select(mesh, *(F.get("t", F.lit(n)).alias(c) for n, c in enumerate("abc")))


def merged_points(vertices: DataFrame, tolerance: float, mesh: str = "mesh_id") -> DataFrame:
    """mesh, vertex, into: each vertex with the least one of those that steps of at most ``tolerance`` lead to from it.

    Vertices of one place are taken together first. Then a grid, whose cells are so small that all in one are within the tolerance,
    makes a cell's places one; between cells up to two apart, places are compared and cells joined where any two
    are near enough. With a tolerance of 0, only equal places are merged.
    """
    if tolerance <= 0:
        least = vertices.groupBy(mesh, *"xyz").agg(F.min("vertex").alias("into"))
        return vertices.join(least, [mesh, *"xyz"]).select(mesh, "vertex", "into")
    side = tolerance / 3**0.5 * (1 - 1e-9)
    cell = F.struct(*(F.floor(F.col(c) / F.lit(side)).cast("long").alias(c) for c in "xyz"))
    placed = cut_lineage(vertices.select(mesh, "vertex", *"xyz", cell.alias("cell")))
    spots = placed.select(mesh, "cell", *"xyz").distinct()
    steps = [d for d in product(range(-2, 3), repeat=3) if d > (0, 0, 0)]
    near = F.array(*(F.struct(*((F.col(f"cell.{c}") + n).alias(c) for c, n in zip("xyz", d, strict=True))) for d in steps))
    used = placed.select(mesh, "cell").distinct()
    # only pairs of cells that both hold something go on to their places
    pairs = used.select(mesh, F.col("cell").alias("home"), F.explode(near.alias("near")).alias("cell")).join(used, [mesh, "cell"]).select(mesh, "home", F.col("cell").alias("away"))
    left = spots.select(mesh, F.col("cell").alias("home"), *(F.col(c).alias(f"h{c}") for c in "xyz"))
    right = spots.select(mesh, F.col("cell").alias("away"), *(F.col(c).alias(f"a{c}") for c in "xyz"))
    gap = sum(((F.col(f"h{c}") - F.col(f"a{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    edges = pairs.join(left, [mesh, "home"]).join(right, [mesh, "away"]).where(gap <= tolerance**2)
    edges = edges.select(F.struct(mesh, F.col("home").alias("spot")).alias("a"), F.struct(mesh, F.col("away").alias("spot")).alias("b")).distinct()
    found = connected_components(edges).select(F.col(f"node.{mesh}").alias(mesh), F.col("node.spot").alias("cell"), F.col("component.spot").alias("root"))
    rooted = placed.join(found, [mesh, "cell"], "left").select(mesh, "vertex", F.coalesce("root", "cell").alias("root"))
    return rooted.join(rooted.groupBy(mesh, "root").agg(F.min("vertex").alias("into")), [mesh, "root"]).select(mesh, "vertex", "into")


def cleaned(faces: DataFrame, vertices: DataFrame, tolerance: float = 0.0, mesh: str = "mesh_id") -> tuple[DataFrame, DataFrame]:
    """Faces over merged points, without those that lost a corner, and the vertices that they still use."""
    into = cut_lineage(merged_points(vertices, tolerance, mesh))
    for corner in "abc":
        names = into.select(mesh, F.col("vertex").alias(corner), F.col("into").alias(f"__{corner}"))
        faces = faces.join(names, [mesh, corner]).drop(corner).withColumnRenamed(f"__{corner}", corner)
    faces = cut_lineage(faces.where("a <> b and b <> c and c <> a"))
    used = faces.select(mesh, F.explode(F.array("a", "b", "c")).alias("vertex")).distinct()
    return faces, vertices.join(used, [mesh, "vertex"], "left_semi")
