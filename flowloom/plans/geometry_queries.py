"""Mesh queries on a cube whose corners SQL can write down, networks on the canonical points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.vectors import vec
from flowloom.operators import geometry, inference, slice_network
from flowloom.operators import quality_control as qc
from flowloom.plans import network_sql as sql
from flowloom.plans.adapters import POINTS, points, rounded
from flowloom.plans.registry import register
from flowloom.session import table

#: Triangles of a cube as corner numbers; bit i of a number is the corner's i-th coordinate.
FACES = [(0, 3, 1), (0, 2, 3), (4, 7, 6), (4, 5, 7), (0, 5, 4), (0, 1, 5), (2, 7, 3), (2, 6, 7), (0, 6, 2), (0, 4, 6), (1, 7, 5), (1, 3, 7)]
HALF = 0.15
MESHES = tuple(f"s{i}" for i in range(10))


def _corner(v: int) -> tuple[float, float, float]:
    return tuple(HALF if v >> i & 1 else -HALF for i in range(3))


_ROWS = [(t, *(x for v in f for x in _corner(v))) for t, f in enumerate(FACES)]
_COLS = "tri, " + ", ".join(f"{p}_{x}" for p in "abc" for x in "xyz")
CUBE = f"cube AS (SELECT * FROM (VALUES {', '.join(str(r) for r in _ROWS)}) AS c({_COLS}))"


def cubes(spark: SparkSession) -> DataFrame:
    rows = [(m, *r) for m in MESHES for r in _ROWS]
    return spark.createDataFrame(rows, "mesh_id string, tri int, " + ", ".join(f"{p}_{x} double" for p in "abc" for x in "xyz"))


def meshes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cube for each sample that the points' table has."""
    samples = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("s"), F.col("label")).alias("mesh_id")).distinct()
    cube = F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(_COLS.split(", "), r, strict=True))) for r in _ROWS))
    return samples.select("mesh_id", F.explode(cube).alias("t")).select("mesh_id", "t.*")


#: The same names as a table of SQL.
NAMES = "(SELECT DISTINCT label AS m FROM embeddings)"


def walkers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with the direction and step of their probe; every seventh is taken as standing on the wall."""
    p = points(spark, sf_dir)
    n = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2)
    return p.select(F.col("sample_id").alias("mesh_id"), "point_id", "x", "y", "z", *((F.col(f"d{c}") / n).alias(f"walk_{c}") for c in "xyz"), (F.col("step") * 2).alias("step"), (F.col("point_id") % 7 == 0).alias("is_wall"))


def _r(**cols: str) -> str:
    return ", ".join(f"round(({v})::DOUBLE, 6) + 0.0 AS {k}" for k, v in cols.items())


# For the oracle a cube needs no triangles: the nearest point of a box, the slab test for rays, and comparisons.
BOX = f"""WITH {POINTS}, w AS (SELECT sample_id AS mesh_id, point_id, x, y, z, dx / sqrt(dx * dx + dy * dy + dz * dz) AS wx, dy / sqrt(dx * dx + dy * dy + dz * dz) AS wy, dz / sqrt(dx * dx + dy * dy + dz * dz) AS wz, step * 2 AS step FROM points),
i AS (SELECT *, greatest(abs(x), abs(y), abs(z)) < {HALF} AS inside, least({HALF} - abs(x), {HALF} - abs(y), {HALF} - abs(z)) AS deep,
  sqrt(pow(greatest(abs(x) - {HALF}, 0), 2) + pow(greatest(abs(y) - {HALF}, 0), 2) + pow(greatest(abs(z) - {HALF}, 0), 2)) AS away FROM w)
"""


@register("g5_closest_points", BOX + "SELECT mesh_id, point_id, " + _r(dist="CASE WHEN inside THEN deep ELSE away END") + " FROM i")
def g5_closest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(geometry.closest_points(walkers(spark, sf_dir), cubes(spark), ["mesh_id", "point_id"]).select("mesh_id", "point_id", "dist"))


#: A point's nearest wall of a box: the side that is nearest inside, the clamped place outside.
_NEAREST = BOX.rstrip() + f""",
d AS (SELECT *, {HALF} - abs(x) AS ex, {HALF} - abs(y) AS ey, {HALF} - abs(z) AS ez FROM i),
c AS (SELECT *, """ + ", ".join(f"CASE WHEN NOT inside THEN least(greatest({c}, -{HALF}), {HALF}) WHEN e{c} <= least(ex, ey, ez) THEN CASE WHEN {c} < 0 THEN -{HALF} ELSE {HALF} END ELSE {c} END AS q{c}" for c in "xyz") + """ FROM d)
"""


@register("g5_wall_directions", _NEAREST + "SELECT mesh_id, point_id, " + _r(qx="qx", qy="qy", qz="qz", **{f"d{c}": f"CASE WHEN sqrt(pow(qx - x, 2) + pow(qy - y, 2) + pow(qz - z, 2)) > 1e-3 THEN abs((q{c} - {c}) / (sqrt(pow(qx - x, 2) + pow(qy - y, 2) + pow(qz - z, 2)) + 1e-8)) END" for c in "xyz"}) + " FROM c")
def g5_wall_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest point of the cube and, where it isn't the point itself, the direction to it without its sign."""
    c = geometry.closest_points(walkers(spark, sf_dir), cubes(spark), ["mesh_id", "point_id"])
    return rounded(c.select("mesh_id", "point_id", *(F.col(f"q_{x}").alias(f"q{x}") for x in "xyz"), *(F.when(F.col("dist") > 1e-3, F.abs(f"dir_{x}")).alias(f"d{x}") for x in "xyz")))


@register("g6_inside", BOX + "SELECT mesh_id, point_id, inside FROM i")
def g6_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.winding_numbers(walkers(spark, sf_dir), cubes(spark), ["mesh_id", "point_id"]).select("mesh_id", "point_id", "inside")


SLAB = BOX.rstrip() + f""",
t AS (SELECT *, least((-{HALF} - x) / wx, ({HALF} - x) / wx) AS x0, greatest((-{HALF} - x) / wx, ({HALF} - x) / wx) AS x1, least((-{HALF} - y) / wy, ({HALF} - y) / wy) AS y0, greatest((-{HALF} - y) / wy, ({HALF} - y) / wy) AS y1,
  least((-{HALF} - z) / wz, ({HALF} - z) / wz) AS z0, greatest((-{HALF} - z) / wz, ({HALF} - z) / wz) AS z1 FROM i),
h AS (SELECT *, CASE WHEN greatest(x0, y0, z0) > least(x1, y1, z1) OR least(x1, y1, z1) < 0 THEN NULL WHEN greatest(x0, y0, z0) >= 0 THEN greatest(x0, y0, z0) ELSE least(x1, y1, z1) END AS t FROM t),
k AS (SELECT *, CASE WHEN t <= step THEN t END AS hit FROM h)
"""


@register("g8_ray_hits", SLAB + "SELECT mesh_id, point_id, " + _r(hit="hit") + " FROM k")
def g8_ray_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(geometry.first_hits(walkers(spark, sf_dir), cubes(spark), ["mesh_id", "point_id"]).select("mesh_id", "point_id", "hit"))


@register("g8_clamped_move", SLAB + "SELECT mesh_id, point_id, " + _r(**{c: f"{c} + w{c} * CASE WHEN hit IS NOT NULL AND step > 1e-8 THEN hit * 0.99 ELSE step END" for c in "xyz"}) + " FROM k")
def g8_clamped_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(geometry.clamped_move(walkers(spark, sf_dir), cubes(spark), ["mesh_id", "point_id"]).select("mesh_id", "point_id", "x", "y", "z"))


@register("g9_constrained_walk", BOX + f"SELECT mesh_id, 3 * count(*) AS n, " + _r(first="sum(CASE WHEN inside THEN deep ELSE away END)") + ", true AS contained FROM i GROUP BY mesh_id")
def g9_constrained_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first step's displacements are those of the start; no walker that starts inside is outside later."""
    start = walkers(spark, sf_dir)
    keys = ["mesh_id", "point_id"]
    walk = geometry.constrained_walk(start, cubes(spark), keys)
    within = start.select(*keys, (F.greatest(*(F.abs(c) for c in "xyz")) < HALF).alias("inside"))
    size = walk.withColumn("d", vec("d").norm()).join(within, keys)
    bound = ~F.col("inside") | (F.col("d") <= HALF + 1e-9)
    return rounded(size.groupBy("mesh_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("walk_step") == 0, F.col("d"))).alias("first"), F.bool_and(bound).alias("contained")))


@register("g11_cylinder", f"WITH {POINTS} SELECT sample_id, point_id, " + _r(wall_dist="least(greatest(1 - sqrt(y * y + z * z), 0), 1)", ny="y / sqrt(y * y + z * z)", nz="z / sqrt(y * y + z * z)") + " FROM points")
def g11_cylinder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(geometry.cylinder_wall(points(spark, sf_dir)).select("sample_id", "point_id", "wall_dist", "ny", "nz"))


_INDEXED = ", ".join(f"({t}, {a}, {b}, {c})" for t, (a, b, c) in enumerate(FACES))
_MESHED = f"WITH f AS (SELECT n.n_name AS mesh_id, v.* FROM nation n, (VALUES {_INDEXED}) AS v(tri, a, b, c) WHERE v.tri < 12 - n.n_regionkey)"


def _faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cube per nation, with as many triangles missing as its region's number."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("mesh_id"), F.col("n_regionkey").alias("r"))
    cube = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip((t, *f), ("tri", "a", "b", "c"), strict=True))) for t, f in enumerate(FACES)))
    return nations.select("mesh_id", "r", F.explode(cube).alias("f")).select("mesh_id", "r", "f.*").where("tri < 12 - r").drop("r")


_TOPOLOGY = _MESHED + """, e AS (SELECT mesh_id, least(p, q) AS p, greatest(p, q) AS q FROM (SELECT mesh_id, a AS p, b AS q FROM f UNION ALL SELECT mesh_id, b, c FROM f UNION ALL SELECT mesh_id, c, a FROM f)),
g AS (SELECT mesh_id, p, q, count(*) AS k FROM e GROUP BY ALL), h AS (SELECT mesh_id, count(*) AS n_edges, count(*) FILTER (k = 1) AS boundary_edges, count(*) FILTER (k > 2) AS nonmanifold_edges FROM g GROUP BY mesh_id),
v AS (SELECT mesh_id, count(DISTINCT x) AS n_vertices FROM (SELECT mesh_id, unnest([a, b, c]) AS x FROM f) GROUP BY mesh_id), n AS (SELECT mesh_id, count(*) AS n_faces FROM f GROUP BY mesh_id)
SELECT mesh_id, n_faces, n_vertices, n_edges, boundary_edges, nonmanifold_edges, n_vertices - n_edges + n_faces AS euler_number, boundary_edges = 0 AND nonmanifold_edges = 0 AS is_watertight FROM n JOIN v USING (mesh_id) JOIN h USING (mesh_id)"""


@register("a10_a11_topology", _TOPOLOGY)
def a10_a11_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.topology(_faces(spark, sf_dir))


@register("a12_components", _MESHED + " SELECT mesh_id, 1 AS n_components, count(*) AS largest_component_faces, 1.0::DOUBLE AS largest_component_fraction FROM f GROUP BY mesh_id")
def a12_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.components(_faces(spark, sf_dir))


@register("a13_measures", f"SELECT 's' || m AS mesh_id, " + _r(surface_area=f"6 * pow(2 * {HALF}, 2)", volume=f"pow(2 * {HALF}, 3)") + f", 0::BIGINT AS degenerate_faces FROM {NAMES}")
def a13_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = qc.measures(meshes_of(spark, sf_dir))
    return rounded(m.withColumn("volume", F.abs("volume")))


GEOMETRY = ["wall_dist", "nx", "ny", "nz", "dx", "dy", "dz", "step"]


def _walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).withColumn("trajectory", F.array(*(F.col(f"d{c}") * (k + 1) * F.col("step") for k in range(3) for c in "xyz")))


_ENCODER, _ROUTER, _BASIS = inference.seeded_weights(inference.trajectory_shapes(), 1), inference.seeded_weights(inference.gate_shapes(len(GEOMETRY) + 16), 2), inference.seeded_weights(inference.basis_shapes(), 3)


def _routing_sql() -> str:
    e, g = _ENCODER, _ROUTER
    walked, last = sql.steps("t", "sample_id, point_id, k", sql.linear("h", e["w1"], e["b1"]), sql.norm("h", e["n1_scale"], e["n1_shift"]), sql.gelu("h"), sql.linear("h", e["w2"], e["b2"]), sql.gelu("h"), sql.plus("h", f"{sql.literal(e['step'])}[k]"), tag="a")
    each = "list_transform(hs, lambda x: x[i])"
    pooled = f"p AS MATERIALIZED (SELECT sample_id, point_id, list_concat(list_transform(range(1, 17), lambda i: list_avg({each})), list_transform(range(1, 17), lambda i: list_max({each}))) AS h FROM (SELECT sample_id, point_id, list(h) AS hs FROM {last} GROUP BY ALL))"
    coded, last = sql.steps("p", "sample_id, point_id", sql.linear("h", e["w3"], e["b3"]), sql.norm("h", e["n3_scale"], e["n3_shift"]), sql.gelu("h"), tag="b")
    given = f"f AS MATERIALIZED (SELECT c.sample_id, c.point_id, list_concat([{', '.join(GEOMETRY)}]::DOUBLE[], c.h) AS h FROM {last} c JOIN points USING (sample_id, point_id))"
    gated, last = sql.steps("f", "sample_id, point_id", sql.linear("h", g["w1"], g["b1"]), sql.gelu("h"), sql.linear("h", g["w2"], g["b2"]), sql.gelu("h"), sql.linear("h", g["w3"], g["b3"]), sql.softmax("h"), tag="c")
    return f"WITH {POINTS}, t AS (SELECT sample_id, point_id, k, [dx * k * step, dy * k * step, dz * k * step] AS h FROM points, range(1, 4) AS r(k)), {walked}, {pooled}, {coded}, {given}, {gated} SELECT sample_id, point_id, m::INT AS mode, " + _r(weight="h[m]") + f" FROM {last}, range(1, 9) AS r(m)"


@register("m1_m2_routing_weights", _routing_sql())
def m1_m2_routing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point's weight of each mode, from its geometry and its encoded walk."""
    w = inference.routing_weights(_walked(spark, sf_dir), _ENCODER, _ROUTER, ["sample_id", "point_id"], GEOMETRY)
    return rounded(w.select("sample_id", "point_id", F.posexplode("weights").alias("mode", "weight")).withColumn("mode", F.col("mode") + 1))


_AROUND = ["x", "y", "z", "wall_dist", "nx", "ny", "nz"]


def _basis_sql() -> str:
    b = _BASIS
    made, last = sql.steps("f", "sample_id, point_id", sql.linear("h", b["w1"], b["b1"]), sql.norm("h", b["n1_scale"], b["n1_shift"]), sql.gelu("h"), sql.linear("h", b["w2"], b["b2"]), sql.norm("h", b["n2_scale"], b["n2_shift"]), sql.gelu("h"), sql.linear("h", b["w3"], b["b3"]), sql.gelu("h"), sql.linear("h", b["w4"], b["b4"]), tag="a")
    return f"WITH {POINTS}, f AS (SELECT sample_id, point_id, [{', '.join(_AROUND)}]::DOUBLE[] AS h FROM points), {made} SELECT sample_id, point_id, m::INT AS place, " + _r(value="h[m]") + f" FROM {last}, range(1, 13) AS r(m)"


@register("m4_learned_basis", _basis_sql())
def m4_learned_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point's learned modes, twelve numbers."""
    b = inference.learned_basis(points(spark, sf_dir), _BASIS, ["sample_id", "point_id"], _AROUND)
    return rounded(b.select("sample_id", "point_id", F.posexplode("modes").alias("place", "value")).withColumn("place", F.col("place") + 1))


_SLICED = slice_network.seeded(7, 4, 5, hidden=8, layers=2, heads=2, slices=4, ratio=2)


@register("m6_slice_network", f"WITH {POINTS}, src AS (SELECT sample_id AS sid, point_id AS pid, [{', '.join(_AROUND)}]::DOUBLE[] AS h FROM points), {sql.slice_network(_SLICED, 'src')} SELECT sid AS sample_id, pid AS point_id, " + _r(**{c: f"h[{i + 1}]" for i, c in enumerate("puvw")}) + " FROM done")
def m6_slice_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers of two heads over all points, in blocks of 16 points so that every sample is several."""
    out = slice_network.forward(points(spark, sf_dir), _SLICED, _AROUND, block=16)
    return rounded(out.select("sample_id", "point_id", *(F.get("out", F.lit(i)).alias(c) for i, c in enumerate("puvw"))))


@register("m5_slice_tokens", f"WITH {POINTS}, s AS (SELECT *, unnest(range(4)) AS slice FROM points), w AS (SELECT *, exp(-abs(x) * (slice + 1)) AS w FROM s) SELECT sample_id, slice, " + _r(y="sum(w * y) / (sum(w) + 1e-5)", z="sum(w * z) / (sum(w) + 1e-5)") + " FROM w GROUP BY sample_id, slice")
def m5_slice_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumn("w", F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.exp(-F.abs("x") * k)))
    return rounded(inference.slice_tokens(p, "w", ["y", "z"]))
