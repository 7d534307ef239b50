"""Image masks as sparse voxels: 26-connected components by bricks, and closed surfaces by tetrahedra.

Voxels are rows (mask, i, j, k) of whole numbers from 0. A place is also one number, ``packed``, so labels and vertices
are keys that any task makes alike: neither components nor surfaces need a merge of what two bricks found twice.
"""

from __future__ import annotations

from itertools import permutations, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators.graphs import connected_components

#: Places are numbers under 2**20 in each direction; doubled coordinates of vertices under 2**21.
BITS = 21
IJK = ("i", "j", "k")
#: Of the 26 directions to neighbours, the 13 that point forwards.
FORWARD = [d for d in product((-1, 0, 1), repeat=3) if d > (0, 0, 0)]


def packed(i: Column, j: Column, k: Column) -> Column:
    """One number of a place: ordered like (i, j, k)."""
    long = lambda c: c.cast("long")
    return F.shiftleft(long(i), 2 * BITS).bitwiseOR(F.shiftleft(long(j), BITS)).bitwiseOR(long(k))


def unpacked(place: Column) -> tuple[Column, Column, Column]:
    low = F.lit((1 << BITS) - 1)
    return F.shiftright(place, 2 * BITS), F.shiftright(place, BITS).bitwiseAND(low), place.bitwiseAND(low)


def _pack(ijk: np.ndarray) -> np.ndarray:
    at = ijk.astype(np.int64)
    return at[..., 0] << 2 * BITS | at[..., 1] << BITS | at[..., 2]


def _brick_labels(at: np.ndarray) -> np.ndarray:
    """The number of the least voxel that each one hangs together with, of the voxels of one brick."""
    low = at.min(axis=0) - 1
    shape = at.max(axis=0) - low + 2
    grid = np.full(shape, -1)
    grid[tuple((at - low).T)] = np.arange(len(at))
    ends = []
    for d in FORWARD:
        other = grid[tuple((at - low + d).T)]
        here = np.flatnonzero(other >= 0)
        ends.append(np.stack([here, other[here]]))
    p, q = np.concatenate(ends, axis=1)
    label = np.argsort(np.argsort(_pack(at)))  # ranks, so that the least voxel has the least number
    while True:
        low_of = np.minimum(label[p], label[q])
        new = label.copy()
        np.minimum.at(new, p, low_of)
        np.minimum.at(new, q, low_of)
        by_rank = np.empty_like(new)
        by_rank[np.argsort(np.argsort(_pack(at)))] = new
        new = by_rank[new]  # a voxel takes the label of the voxel it is labelled by
        if np.array_equal(new, label):
            return np.sort(_pack(at))[label]
        label = new


def labelled(voxels: DataFrame, mask: str = "mask", brick: int = 32) -> DataFrame:
    """``voxels`` (mask, i, j, k, each once) with label: the least voxel, packed, of those that hang together over faces, edges and corners.

    Bricks of ``brick`` voxels a side are labelled within a task. Voxels at a brick's border then meet their
    neighbours beyond it by equality of places, which gives edges between labels of bricks, and components of these.
    """
    side = lambda c: F.floor(F.col(c) / F.lit(brick)).cast("long")

    def label(rows: pd.DataFrame) -> pd.DataFrame:
        rows["own"] = _brick_labels(rows[list(IJK)].to_numpy())
        return rows[["mask", *IJK, "own"]]

    kind = voxels.schema[mask].dataType.simpleString()
    given = voxels.select(F.col(mask).alias("mask"), *(F.col(c).cast("int").alias(c) for c in IJK)).distinct()
    in_bricks = given.withColumns({f"b{c}": side(c) for c in IJK}).groupBy("mask", "bi", "bj", "bk").applyInPandas(label, f"mask {kind}, i int, j int, k int, own long")
    from flowloom.session import cut_lineage

    own = cut_lineage(in_bricks)
    at_border = F.lit(False)
    for c in IJK:
        at_border = at_border | F.pmod(F.col(c), F.lit(brick)).isin(0, brick - 1)
    border = own.where(at_border).select("mask", packed(*map(F.col, IJK)).alias("place"), "own", *IJK)
    steps = F.array(*(F.struct(*(F.lit(x).alias(f"d{c}") for c, x in zip(IJK, d, strict=True))) for d in FORWARD))
    beyond = F.lit(False)
    for c in IJK:
        beyond = beyond | (side(c) != F.floor((F.col(c) + F.col(f"s.d{c}")) / F.lit(brick)))
    inside = F.col("i") + F.col("s.di") >= 0
    for c in ("j", "k"):
        inside = inside & (F.col(c) + F.col(f"s.d{c}") >= 0)
    asked = border.withColumn("s", F.explode(steps)).where(beyond & inside)
    asked = asked.select("mask", F.struct("mask", "own").alias("a"), packed(*(F.col(c) + F.col(f"s.d{c}") for c in IJK)).alias("place"))
    edges = asked.join(border.select("mask", "place", F.struct("mask", "own").alias("b")), ["mask", "place"]).select("a", "b").distinct()
    joined = connected_components(edges).select(F.col("node.mask").alias("mask"), F.col("node.own").alias("own"), F.col("component.own").alias("label"))
    out = own.join(joined, ["mask", "own"], "left")
    return out.select(F.col("mask").alias(mask), *IJK, F.coalesce("label", "own").alias("label"))


def kept_components(labels: DataFrame, min_voxels: int, min_fraction: float, mask: str = "mask") -> DataFrame:
    """The voxels of components of ``min_voxels`` and ``min_fraction`` of the mask's largest, rounded up; where none is that large, of the largest (ties: the least label)."""
    sizes = labels.groupBy(mask, "label").agg(F.count("*").alias("voxels"))
    top = sizes.groupBy(mask).agg(F.max("voxels").alias("top"), F.max_by("label", F.struct("voxels", -F.col("label"))).alias("first"))
    need = F.greatest(F.lit(min_voxels), F.ceil(F.lit(min_fraction) * F.col("top")))
    kept = sizes.join(top, mask).where((F.col("voxels") >= need) | ((F.col("top") < need) & (F.col("label") == F.col("first"))))
    return labels.join(kept.select(mask, "label"), [mask, "label"], "left_semi").select(labels.columns)


def _tetrahedra() -> np.ndarray:
    """The six tetrahedra of a cell, each a way from its least corner to its greatest along the axes; neighbours' faces agree."""
    out = []
    for order in permutations(range(3)):
        corner, way = np.zeros(3, int), [np.zeros(3, int)]
        for axis in order:
            corner = corner + np.eye(3, dtype=int)[axis]
            way.append(corner)
        out.append(way)
    return np.array(out)


TETRAHEDRA = _tetrahedra()


def _triangles(inside: np.ndarray, corner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of tetrahedra (n x 4 corners, n x 4 whether inside): the number of each triangle's tetrahedron, and its three vertices as doubled coordinates.

    A triangle cuts off one corner, or two triangles part two corners from the others; normals point from inside to outside.
    """
    found_of, found = [], []
    for code in range(1, 15):
        bits = [bool(code >> n & 1) for n in range(4)]
        these = np.flatnonzero((inside == bits).all(axis=1))
        if not len(these):
            continue
        ins, outs = [n for n in range(4) if bits[n]], [n for n in range(4) if not bits[n]]
        mid = lambda p, q: corner[these, p] + corner[these, q]  # noqa: E731,B023
        if len(ins) == 2:
            ring = [mid(ins[0], outs[0]), mid(ins[0], outs[1]), mid(ins[1], outs[1]), mid(ins[1], outs[0])]
            made = [[ring[0], ring[1], ring[2]], [ring[0], ring[2], ring[3]]]
        else:
            made = [[mid(p, q) for p in ins for q in outs]]
        way = corner[these][:, outs].mean(axis=1) - corner[these][:, ins].mean(axis=1)
        for t in made:
            t = np.stack(t, axis=1)
            back = (np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]) * way).sum(axis=1) < 0
            t[back] = t[back][:, [0, 2, 1]]
            found_of.append(these)
            found.append(t)
    if not found:
        return np.zeros(0, int), np.zeros((0, 3, 3), int)
    return np.concatenate(found_of), np.concatenate(found)


def surface(voxels: DataFrame, mask: str = "mask", brick: int = 32) -> DataFrame:
    """mask, tri, a, b, c: a closed surface around the voxels, halfway to the places that are none; normals point outwards.

    Cells between eight neighbouring places are cut to tetrahedra, and these by the plane through their edges' middles. A
    vertex is its edge's middle, as the packed sum of both ends with 2 added in each direction: tasks name it alike, so a surface
    needs no merging. Each brick of cells is a task's work; a voxel goes to every brick that has one of its eight cells.
    """
    cells = F.array(*(F.struct(*(F.floor((F.col(c) - x) / F.lit(brick)).cast("long").alias(f"b{c}") for c, x in zip(IJK, d, strict=True))) for d in product((0, 1), repeat=3)))
    kind = voxels.schema[mask].dataType.simpleString()
    given = voxels.select(F.col(mask).alias("mask"), *(F.col(c).cast("int").alias(c) for c in IJK)).distinct()
    dealt = given.withColumn("b", F.explode(F.array_distinct(cells))).select("mask", *IJK, "b.*")

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        home = rows[["bi", "bj", "bk"]].to_numpy()[0] * brick
        grid = np.zeros((brick + 1,) * 3, bool)
        grid[tuple((rows[list(IJK)].to_numpy() - home).T)] = True
        corners = np.stack([grid[x : x + brick, y : y + brick, z : z + brick] for x, y, z in product((0, 1), repeat=3)], axis=-1)
        mixed = np.argwhere(corners.any(axis=-1) & ~corners.all(axis=-1))
        at = (mixed[:, None, None, :] + TETRAHEDRA[None]).reshape(-1, 4, 3)
        of, found = _triangles(grid[tuple(np.moveaxis(at, -1, 0))], at + home)
        cell, which = mixed[of // 6] + home + 1, of % 6
        again = np.zeros(len(of), int)
        order = np.argsort(of, kind="stable")
        again[order[1:]] = of[order][1:] == of[order][:-1]
        vertex = _pack(found + 2)
        return pd.DataFrame({"mask": rows["mask"].iloc[0], "cell": _pack(cell), "part": which * 2 + again, "a": vertex[:, 0], "b": vertex[:, 1], "c": vertex[:, 2]})

    cut_up = dealt.groupBy("mask", "bi", "bj", "bk").applyInPandas(cut, f"mask {kind}, cell long, part int, a long, b long, c long")
    return cut_up.select(F.col("mask").alias(mask), F.struct("cell", "part").alias("tri"), "a", "b", "c")


def vertex_position(vertex: Column) -> tuple[Column, Column, Column]:
    """Where a vertex of ``surface`` lies, counted in voxels from the middle of voxel 0."""
    return tuple((c - F.lit(2)) / F.lit(2.0) for c in unpacked(vertex))


def surface_vertices(faces: DataFrame, mask: str = "mask") -> DataFrame:
    """mask, vertex, x, y, z: every vertex of the faces once."""
    each = faces.select(mask, F.explode(F.array("a", "b", "c")).alias("vertex")).distinct()
    return each.withColumns(dict(zip("xyz", vertex_position(F.col("vertex")), strict=True)))


def to_world(vertices: DataFrame, affine: Column) -> DataFrame:
    """x, y, z moved by an affine: an array of twelve numbers, three rows of four."""
    at = [F.col(c) for c in "xyz"]
    place = lambda r: sum((F.get(affine, F.lit(4 * r + n)) * at[n] for n in range(3)), F.get(affine, F.lit(4 * r + 3)))
    return vertices.withColumn("__at", F.array(*map(place, range(3)))).withColumns({c: F.get("__at", F.lit(n)) for n, c in enumerate("xyz")}).drop("__at")
