"""Scenes: trees of nodes with transforms, put together to one mesh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.session import cut_lineage

IDENTITY = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]


def composed(outer: Column, inner: Column) -> Column:
    """The transform that applies ``inner`` first: arrays of twelve numbers, three rows of four."""
    m = lambda c, r, k: F.get(c, F.lit(4 * r + k))
    cell = lambda r, k: sum((m(outer, r, n) * m(inner, n, k) for n in range(3)), m(outer, r, 3) if k == 3 else F.lit(0.0))
    return F.array(*(cell(r, k) for r in range(3) for k in range(4)))


def world_transforms(nodes: DataFrame, scene: str = "scene", node: str = "node", parent: str = "parent", matrix: str = "matrix") -> DataFrame:
    """``nodes`` with world: the transforms from the root down to the node, composed.

    Every node first knows the way to its parent, then to ever farther ancestors, twice as far in each round, so a chain
    takes the logarithm of its length. A null matrix is no transform; a parent that isn't there is the scene itself.
    Parents that go round in a circle fail the query.
    """
    known = nodes.select(F.col(scene).alias("s"), F.col(node).alias("p"))
    up = F.coalesce(F.col(matrix), F.array(*map(F.lit, IDENTITY)))
    at = nodes.select(F.col(scene).alias("s"), F.col(node).alias("n"), F.col(parent).alias("p"), up.alias("way")).join(known.withColumn("there", F.lit(True)), ["s", "p"], "left")
    at = cut_lineage(at.select("s", "n", F.when(F.col("there"), F.col("p")).alias("p"), "way"))
    rounds = max(1, at.count()).bit_length() + 1
    while not at.where("p is not null").isEmpty():
        if not rounds:
            raise ValueError("a scene's nodes are each other's parents")
        rounds -= 1
        higher = at.select("s", F.col("n").alias("p"), F.col("p").alias("next"), F.col("way").alias("above"))
        moved = at.where("p is not null").join(higher, ["s", "p"]).select("s", "n", F.col("next").alias("p"), composed(F.col("above"), F.col("way")).alias("way"))
        at = cut_lineage(at.where("p is null").unionByName(moved))
    world = at.select(F.col("s").alias(scene), F.col("n").alias(node), F.col("way").alias("world"))
    return nodes.join(world, [scene, node])


def placed(nodes: DataFrame, triangles: DataFrame, mesh: str = "mesh_id", scene: str = "scene", node: str = "node") -> DataFrame:
    """scene, node, tri and corners (a_x to c_z): the triangles of all nodes' meshes, each where its node puts it.

    ``nodes`` as ``world_transforms`` gives them. A node without a mesh, or whose mesh has no triangles, adds nothing; a mesh may stand in several nodes.
    """
    each = nodes.where(F.col(mesh).isNotNull()).select(scene, node, mesh, "world").join(triangles, mesh)
    m = lambda r, k: F.get("world", F.lit(4 * r + k))
    spot = lambda c, r: sum((m(r, n) * F.col(f"{c}_{x}") for n, x in enumerate("xyz")), m(r, 3))
    return each.select(scene, node, "tri", *(spot(c, r).alias(f"{c}_{x}") for c in "abc" for r, x in enumerate("xyz")))
