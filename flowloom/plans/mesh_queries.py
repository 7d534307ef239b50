"""Masks to surfaces, orientation, smoothing, walls of volume cells, merging of points: each over tables made from the driver's."""

from __future__ import annotations

from itertools import combinations, pairwise, permutations, product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators import meshes, sampling, scenes, voxels
from flowloom.operators import quality_control as qc
from flowloom.plans.adapters import rounded
from flowloom.plans.geometry_queries import FACES, _corner, _r, meshes_of
from flowloom.plans.registry import register
from flowloom.session import cut_lineage, table

#: Each market segment's customers as voxels of one mask: a sparse cloud, in which some hang together.
VOXELS = "v AS (SELECT DISTINCT c_mktsegment AS mask, (c_custkey % 17)::INT AS i, (abs(c_acctbal)::BIGINT % 19)::INT AS j, (c_nationkey % 13)::INT AS k FROM customer)"


def mask_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    # DuckDB rounds half to even on a cast, and so does bround
    return c.select(F.col("c_mktsegment").alias("mask"), (F.col("c_custkey") % 17).cast("int").alias("i"), (F.bround(F.abs("c_acctbal"), 0).cast("long") % 19).cast("int").alias("j"), (F.col("c_nationkey") % 13).cast("int").alias("k")).distinct()


_LABELS = "n AS (SELECT *, (i::BIGINT << 42) | (j::BIGINT << 21) | k AS p FROM v), r AS (SELECT mask, p, p AS root FROM n UNION SELECT r.mask, y.p, r.root FROM r JOIN n x ON x.mask = r.mask AND x.p = r.p JOIN n y ON y.mask = x.mask AND abs(y.i - x.i) <= 1 AND abs(y.j - x.j) <= 1 AND abs(y.k - x.k) <= 1), l AS (SELECT mask, p, min(root) AS label FROM r GROUP BY ALL), w AS (SELECT n.mask, n.i, n.j, n.k, l.label FROM n JOIN l USING (mask, p))"


@register("g10_voxel_components", f"WITH RECURSIVE {VOXELS}, {_LABELS} SELECT * FROM w")
def g10_voxel_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every voxel with its component's least voxel, in bricks of four so that most components cross some."""
    return voxels.labelled(mask_voxels(spark, sf_dir), brick=4)


_KEPT = "s AS (SELECT mask, label, count(*) AS n FROM w GROUP BY ALL), t AS (SELECT *, max(n) OVER (PARTITION BY mask) AS top, row_number() OVER (PARTITION BY mask ORDER BY n DESC, label) AS place FROM s), k AS (SELECT mask, label FROM t WHERE n >= greatest(3, ceil(0.2 * top)) OR (top < greatest(3, ceil(0.2 * top)) AND place = 1)), z AS (SELECT w.* FROM w JOIN k USING (mask, label))"


@register("g10_kept_components", f"WITH RECURSIVE {VOXELS}, {_LABELS}, {_KEPT} SELECT * FROM z")
def g10_kept_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of three voxels and a fifth of the mask's largest."""
    return voxels.kept_components(voxels.labelled(mask_voxels(spark, sf_dir), brick=4), 3, 0.2)


def _mask_surface(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    kept = voxels.kept_components(voxels.labelled(mask_voxels(spark, sf_dir), brick=4), 3, 0.2)
    faces = cut_lineage(voxels.surface(kept, brick=4))
    return faces, voxels.surface_vertices(faces)


# SQL counts what the surface must have without making it: a tetrahedron with one or three corners inside has a triangle, with two
# inside two; an edge with one end inside has a vertex; a tetrahedron holds 1, 4, 7 or 8 forty-eighths of a voxel.
_TETS = [[tuple(int(a in order[:n]) for a in range(3)) for n in range(4)] for order in permutations(range(3))]
_CELL_ROWS = ", ".join(f"({t}, {n}, {x}, {y}, {z})" for t, tet in enumerate(_TETS) for n, (x, y, z) in enumerate(tet))
_EDGE_ROWS = ", ".join(str(d) for d in product((0, 1), repeat=3) if any(d))
_SURFACE = f"""c AS (SELECT DISTINCT mask, i - x AS i, j - y AS j, k - z AS k FROM z, (VALUES (0), (1)) AS a(x), (VALUES (0), (1)) AS b(y), (VALUES (0), (1)) AS e(z)),
q AS (SELECT c.mask, c.i, c.j, c.k, t.t, count(z.label) AS n FROM c CROSS JOIN (VALUES {_CELL_ROWS}) AS t(t, n, x, y, z) LEFT JOIN z ON z.mask = c.mask AND z.i = c.i + t.x AND z.j = c.j + t.y AND z.k = c.k + t.z GROUP BY ALL),
f AS (SELECT mask, sum([0, 1, 2, 1, 0][n + 1])::BIGINT AS n_faces, sum([0, 1, 4, 7, 8][n + 1]) / 48 AS volume FROM q GROUP BY mask),
g AS (SELECT z.mask, count(*) FILTER (o.label IS NULL) AS n_vertices FROM z CROSS JOIN (SELECT a * s AS x, b * s AS y, d * s AS z FROM (VALUES {_EDGE_ROWS}) AS e(a, b, d), (VALUES (1), (-1)) AS h(s)) AS e LEFT JOIN z o ON o.mask = z.mask AND o.i = z.i + e.x AND o.j = z.j + e.y AND o.k = z.k + e.z GROUP BY z.mask)
"""


@register("g10_mask_surface", f"WITH RECURSIVE {VOXELS}, {_LABELS}, {_KEPT}, {_SURFACE} SELECT mask, n_faces, n_vertices, n_faces * 3 // 2 AS n_edges, 0::BIGINT AS boundary_edges, n_vertices - n_faces * 3 // 2 + n_faces AS euler_number, " + _r(volume="volume") + " FROM f JOIN g USING (mask)")
def g10_mask_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces of the kept components: counts of faces, vertices and edges, and the volume within."""
    faces, vertices = _mask_surface(spark, sf_dir)
    counts = qc.topology(faces, "mask").select("mask", "n_faces", "n_vertices", "n_edges", "boundary_edges", "euler_number")
    return rounded(counts.join(meshes.volumes(faces, vertices, ["mask"]), "mask"))


_ROUNDS = 2
_UNIT = [(t, *f) for t, f in enumerate(FACES)]
_EDGES = sorted({(p, q) for f in FACES for a, b in zip(f, f[1:] + f[:1]) for p, q in ((a, b), (b, a))})
#: Cubes for nations, each of its own size, whose corners are moved a little, all by what SQL can name.
CORNERS = f"p0 AS (SELECT n_name AS mesh_id, v AS vertex, x * (1 + n_nationkey / 7) / 1.37 + (v * v % 3) / 11 AS x, y * (1 + n_nationkey / 7) / 1.37 AS y, z * (1 + n_nationkey / 7) / 1.37 - (v % 4) / 20 AS z FROM nation, (VALUES {', '.join(str((v, *_corner(v))) for v in range(8))}) AS c(v, x, y, z))"


def _cubes_of_nations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("mesh_id"), "n_nationkey")
    corner = F.array(*(F.struct(F.lit(v).cast("long").alias("v"), *(F.lit(x).alias(c) for c, x in zip("xyz", _corner(v), strict=True))) for v in range(8)))
    size = (1 + F.col("n_nationkey") / 7) / 1.37
    at = n.select("mesh_id", "n_nationkey", F.explode(corner).alias("c")).select("mesh_id", F.col("c.v").alias("vertex"), (F.col("c.x") * size + (F.col("c.v") * F.col("c.v") % 3) / 11).alias("x"), (F.col("c.y") * size).alias("y"), (F.col("c.z") * size - (F.col("c.v") % 4) / 20).alias("z"))
    face = F.array(*(F.struct(*(F.lit(x).cast("long").alias(c) for c, x in zip(("tri", *"abc"), row, strict=True))) for row in _UNIT))
    return n.select("mesh_id", F.explode(face).alias("f")).select("mesh_id", "f.*"), at


def _rounds(n: int) -> str:
    rows = ", ".join(str(e) for e in _EDGES)
    made = [f"e AS (SELECT * FROM (VALUES {rows}) AS e(vertex, other))"]
    for r in range(1, n + 1):
        made.append(f"p{r} AS (SELECT a.mesh_id, a.vertex, " + ", ".join(f"any_value(a.{c}) + 0.5 * (avg(b.{c}) - any_value(a.{c})) AS {c}" for c in "xyz") + f" FROM p{r - 1} a JOIN e USING (vertex) JOIN p{r - 1} b ON b.mesh_id = a.mesh_id AND b.vertex = e.other GROUP BY a.mesh_id, a.vertex)")
    return ", ".join(made)


@register("g10_smoothed", f"WITH {CORNERS}, {_rounds(_ROUNDS)} SELECT mesh_id, vertex::BIGINT AS vertex, " + _r(x="x", y="y", z="z") + f" FROM p{_ROUNDS}")
def g10_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds over a mesh for each nation."""
    faces, at = _cubes_of_nations(spark, sf_dir)
    return rounded(meshes.smoothed(at, faces, _ROUNDS, keep_volume=False))


#: A band of five faces with a twist: one side only.
STRIP = [(0, 20, 21, 22), (1, 21, 23, 22), (2, 22, 23, 24), (3, 23, 20, 24), (4, 24, 20, 21)]
_ALL_FACES = ", ".join(str(r) for r in _UNIT)


@register("g10_oriented", f"WITH f AS (SELECT n_name AS mesh_id, f.* FROM nation, (VALUES {_ALL_FACES}) AS f(tri, a, b, c)) SELECT mesh_id, tri::BIGINT AS tri, CASE least(a, b, c) WHEN a THEN [a, b, c] WHEN b THEN [b, c, a] ELSE [c, a, b] END::BIGINT[] AS corners, true AS orientable FROM f")
def g10_oriented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cube for each nation, some faces of which are turned by a hash, turned back and outwards."""
    faces, at = _cubes_of_nations(spark, sf_dir)
    flip = F.pmod(F.xxhash64("mesh_id", "tri"), F.lit(3)) == 0
    mixed = faces.select("mesh_id", "tri", "a", F.when(flip, F.col("c")).otherwise(F.col("b")).alias("b"), F.when(flip, F.col("b")).otherwise(F.col("c")).alias("c"))
    back = meshes.turned_outwards(meshes.oriented(mixed), at)
    least = F.least("a", "b", "c")
    ring = F.when(least == F.col("a"), F.array("a", "b", "c")).when(least == F.col("b"), F.array("b", "c", "a")).otherwise(F.array("c", "a", "b"))
    return back.select("mesh_id", "tri", ring.alias("corners"), "orientable")


@register("g10_twisted", f"WITH f AS (SELECT n_name AS mesh_id, f.*, false AS twisted FROM nation, (VALUES {_ALL_FACES}) AS f(tri, a, b, c) UNION ALL SELECT n_name, 100 + f.tri, f.a, f.b, f.c, true FROM nation, (VALUES {', '.join(map(str, STRIP))}) AS f(tri, a, b, c) WHERE n_regionkey = 2) SELECT mesh_id, count(*) AS n_faces, count(*) FILTER (twisted) AS not_orientable FROM f GROUP BY mesh_id")
def g10_twisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a strip of one side beside the cubes of one region: its faces are told, the cubes' are not."""
    faces, _ = _cubes_of_nations(spark, sf_dir)
    strip = F.array(*(F.struct(*(F.lit(x).cast("long").alias(c) for c, x in zip(("tri", *"abc"), (100 + t, *f), strict=True))) for t, *f in STRIP))
    twisted = table(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_name").alias("mesh_id"), F.explode(strip).alias("f")).select("mesh_id", "f.*")
    told = meshes.oriented(faces.unionByName(twisted))
    return told.groupBy("mesh_id").agg(F.count("*").alias("n_faces"), F.count_if(~F.col("orientable")).alias("not_orientable"))


#: The corners of a voxel in the order of a hexahedron's nodes.
_HEX = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each voxel a hexahedron; in masks of names of odd length, six tetrahedra, all of one handedness."""
    v = mask_voxels(spark, sf_dir)
    node = lambda d: voxels.packed(*(F.col(c) + x for c, x in zip("ijk", d, strict=True)))
    even = lambda tet: sum(a > b for a, b in combinations([next(x for x in range(3) if q[x] > p[x]) for p, q in pairwise(tet)], 2)) % 2 == 0
    tets = [tet if even(tet) else [tet[0], tet[2], tet[1], tet[3]] for tet in _TETS]
    made = F.when(F.length("mask") % 2 == 1, F.array(*(F.array(*map(node, tet)) for tet in tets))).otherwise(F.array(F.array(*map(node, _HEX))))
    return v.select("mask", F.explode(made).alias("nodes")).select("mask", F.when(F.size("nodes") == 4, 10).otherwise(12).alias("type"), "nodes")


_OPEN = ", ".join(str(d) for d in product((-1, 0, 1), repeat=3) if sum(map(abs, d)) == 1)


@register("s17_wall_of_cells", f"WITH {VOXELS}, o AS (SELECT v.mask, 2 * count(*) FILTER (n.mask IS NULL) AS wall FROM v CROSS JOIN (VALUES {_OPEN}) AS d(x, y, z) LEFT JOIN v n ON n.mask = v.mask AND n.i = v.i + d.x AND n.j = v.j + d.y AND n.k = v.k + d.z GROUP BY v.mask), c AS (SELECT mask, count(*)::DOUBLE AS volume FROM v GROUP BY mask) SELECT mask, wall, volume FROM o JOIN c USING (mask)")
def s17_wall_of_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triangles around a volume mesh for each mask, and the volume that they enclose: every voxel's bare faces, twice, and its volume."""
    wall = cut_lineage(meshes.wall_of_cells(_cells(spark, sf_dir), "mask"))
    nodes = wall.select("mask", F.explode(F.array("a", "b", "c")).alias("vertex")).distinct()
    at = nodes.withColumns({c: x.cast("double") for c, x in zip("xyz", voxels.unpacked(F.col("vertex")), strict=True)})
    counts = wall.groupBy("mask").agg(F.count("*").alias("wall"))
    return rounded(counts.join(meshes.volumes(wall, at, ["mask"]), "mask"))


@register("s17_cleaned_surface", f"WITH f AS (SELECT n_name AS mesh_id, f.tri, f.a, f.b, f.c FROM nation, (VALUES {_ALL_FACES}) AS f(tri, a, b, c)) SELECT mesh_id, count(*) AS n_faces, 8::BIGINT AS n_vertices, 18::BIGINT AS n_edges, count(*) - count(DISTINCT tri) AS boundary_edges, 2::BIGINT AS euler_number FROM f GROUP BY mesh_id")
def s17_cleaned_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cubes of nations as loose triangles, each corner a point of its own that a hash moves by less than the tolerance; and one triangle of no size."""
    faces, at = _cubes_of_nations(spark, sf_dir)
    own = lambda n: F.col("tri") * 3 + n
    loose = faces.select("mesh_id", "tri", *(own(n).alias(c) for n, c in enumerate("abc")))
    each = faces.select("mesh_id", F.posexplode(F.array("a", "b", "c")).alias("n", "corner"), "tri").select("mesh_id", own(F.col("n")).alias("vertex"), F.col("corner"))
    jitter = lambda c: (F.pmod(F.xxhash64("mesh_id", "vertex", F.lit(c)), F.lit(1001)) / 1000 - 0.5) * 0.001
    spots = each.join(at.withColumnRenamed("vertex", "corner"), ["mesh_id", "corner"]).select("mesh_id", "vertex", *((F.col(c) + jitter(c)).alias(c) for c in "xyz"))
    flat = loose.where("tri = 0").withColumns({"tri": F.lit(50).cast("long"), "b": F.col("a")})
    kept, used = meshes.cleaned(loose.unionByName(flat), spots, tolerance=0.005)
    counts = qc.topology(kept).select("mesh_id", "n_faces", "n_edges", "boundary_edges", "euler_number")
    return counts.join(used.groupBy("mesh_id").agg(F.count("*").alias("n_vertices")), "mesh_id")


#: A prism that is half of its box, cut across: corners 0 to 2 below, 3 to 5 above.
_PRISM = [(0, 2, 1), (3, 4, 5), (0, 1, 4), (0, 4, 3), (1, 2, 5), (1, 5, 4), (2, 0, 3), (2, 3, 5)]
_PRISM_AT = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (0, 1, 1)]


def _draw(seed: int) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', mesh_id, k)), 1, 13))::BIGINT / {2**52}.0)"


@register("g4_interior_of_prisms", f"WITH m AS (SELECT n_name AS mesh_id, 1 + n_nationkey / 7 AS s FROM nation), d AS (SELECT mesh_id, k, s, s * {_draw(3)} AS x, s * {_draw(4)} AS y, s * {_draw(5)} AS z FROM m, range(1600) AS r(k)), i AS (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY k) AS n FROM d WHERE x + y < s) SELECT mesh_id, k::INT AS k, 0 AS copy, 100 AS found, " + _r(x="x", y="y", z="z") + " FROM i WHERE n <= 100")
def g4_interior_of_prisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred points within a prism for each nation, in rounds of 80: about half of the draws fall outside and are rejected."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("mesh_id"), (1 + F.col("n_nationkey") / 7).alias("s"))
    faces = F.array(*(F.struct(F.lit(t).alias("tri"), *(F.lit(float(_PRISM_AT[v][a])).alias(f"{c}_{x}") for c, v in zip("abc", f, strict=True) for a, x in enumerate("xyz"))) for t, f in enumerate(_PRISM)))
    each = n.select("mesh_id", "s", F.explode(faces).alias("f")).select("mesh_id", "s", "f.*")
    sized = each.select("mesh_id", "tri", *((F.col(f"{c}_{x}") * F.col("s")).alias(f"{c}_{x}") for c in "abc" for x in "xyz"))
    s = sampling.interior_points(sized, 100, 80, 3)
    return rounded(s.select("mesh_id", F.col("k").cast("int").alias("k"), "copy", F.col("found").cast("int").alias("found"), "x", "y", "z"))


def _times(outer: str, inner: str) -> str:
    cell = lambda r, k: " + ".join([*(f"{outer}[{4 * r + n + 1}] * {inner}[{4 * n + k + 1}]" for n in range(3)), *([f"{outer}[{4 * r + 4}]"] if k == 3 else [])])
    return "[" + ", ".join(cell(r, k) for r in range(3) for k in range(4)) + "]"


_NODES = "n AS (SELECT n_nationkey % 3 AS scene, n_nationkey AS node, CASE WHEN n_nationkey >= 3 THEN n_nationkey - 3 END AS parent, [0, -1, 0, n_nationkey, 1, 0, 0, 1, 0, 0, 0.5, n_nationkey / 10]::DOUBLE[] AS m FROM nation)"


@register("s16_placed_scene", f"WITH RECURSIVE {_NODES}, w AS (SELECT scene, node, m FROM n WHERE parent IS NULL UNION ALL SELECT n.scene, n.node, {_times('w.m', 'n.m')} FROM w JOIN n ON n.scene = w.scene AND n.parent = w.node) SELECT scene, node, f.tri, " + _r(**{f"{c}_{x}": f"m[{4 * r + 1}] * q{c}x + m[{4 * r + 2}] * q{c}y + m[{4 * r + 3}] * q{c}z + m[{4 * r + 4}]" for c in "abc" for r, x in enumerate("xyz")}) + f" FROM w, (VALUES {', '.join(str((t, *(x for v in f for x in _corner(v)))) for t, f in enumerate(FACES))}) AS f(tri, {', '.join(f'q{c}{x}' for c in 'abc' for x in 'xyz')}) WHERE node % 4 <> 1")
def s16_placed_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scenes of nations in chains, each turned and moved against the one before it; every fourth has no mesh of its own."""
    k = F.col("n_nationkey")
    m = F.array(*(x.cast("double") for x in (F.lit(0), F.lit(-1), F.lit(0), k, F.lit(1), F.lit(0), F.lit(0), F.lit(1), F.lit(0), F.lit(0), F.lit(0.5), k / 10)))
    nodes = table(spark, sf_dir, "nation").select((k % 3).alias("scene"), k.alias("node"), F.when(k >= 3, k - 3).alias("parent"), m.alias("matrix"), F.when(k % 4 != 1, F.lit("cube")).alias("mesh_id"))
    cube = meshes_of(spark, sf_dir).where("mesh_id = 's0'").withColumn("mesh_id", F.lit("cube"))
    return rounded(scenes.placed(scenes.world_transforms(nodes), cube).withColumn("tri", F.col("tri").cast("int")))
