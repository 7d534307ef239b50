"""Random draws by their properties, and the remaining selections and splits, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.operators import frames, sampling
from flowloom.operators import selection as sel
from flowloom.operators.ranges import running
from flowloom.plans.adapters import CFD, POINTS, cfd, points, rounded
from flowloom.plans.geometry_queries import CUBE, HALF, NAMES, meshes_of
from flowloom.plans.registry import register
from flowloom.session import table


def _r(**cols: str) -> str:
    return ", ".join(f"round(({v})::DOUBLE, 6) + 0.0 AS {k}" for k, v in cols.items())


def _u(seed: int, *keys: str) -> str:
    """The draw of a seed and keys in SQL."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 13))::BIGINT / {2**52}.0)"


def _sphere(seed: int, *keys: str) -> dict[str, str]:
    phi, cosine = f"2 * pi() * {_u(seed, *keys)}", f"(2 * {_u(seed + 1, *keys)} - 1)"
    sine = f"sqrt(greatest(1 - {cosine} * {cosine}, 0))"
    return {"x": f"{sine} * cos({phi})", "y": f"{sine} * sin({phi})", "z": cosine}


def _walks(walks: int, base: int, sigma: float, seed: int, wall: str) -> str:
    """Probe walks in SQL: the base direction and, for a sigma, noise; normalised."""
    keys = ("sample_id", "point_id")
    noise = lambda i: f"{sigma} * sqrt(-2 * ln(1 - {_u(2 * (seed + 100 + i), *keys, 'walk_idx')})) * cos(2 * pi() * {_u(2 * (seed + 100 + i) + 1, *keys, 'walk_idx')})"
    start = _sphere(seed, *keys, "b")
    moved = ", ".join(f"{v} + {noise(i) if sigma else 0} AS q{c}" for i, (c, v) in enumerate(start.items()))
    return f"""WITH {POINTS}, e AS (SELECT sample_id, point_id, {wall} AS is_wall, walk_idx, walk_idx % {min(walks, base)} AS b FROM points, range({walks}) AS r(walk_idx)),
q AS (SELECT *, {moved}, CASE WHEN is_wall THEN 0 ELSE {sampling.MIN_STEP} + {sampling.MAX_STEP - sampling.MIN_STEP} * {_u(seed + 7, *keys, 'b')} END AS step FROM e)
SELECT sample_id, point_id, walk_idx::INT AS walk_idx, """ + _r(**{f"d{c}": f"q{c} / sqrt(qx * qx + qy * qy + qz * qz)" for c in "xyz"}, step="step") + " FROM q"


@register("f17_probe_walks", _walks(6, 4, 0.0, 11, "point_id % 7 = 0"))
def f17_probe_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six walks on four base walks without noise; every seventh point stands on the wall."""
    p = points(spark, sf_dir).withColumn("is_wall", F.col("point_id") % 7 == 0)
    return rounded(sampling.probe_walks(p, 6, 4, 0.0, 11, ["sample_id", "point_id"]).select("sample_id", "point_id", "walk_idx", "dx", "dy", "dz", "step"))


@register("f17_perturbed_walks", _walks(3, 2, 0.05, 11, "false"))
def f17_perturbed_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumn("is_wall", F.lit(False))
    return rounded(sampling.probe_walks(p, 3, 2, 0.05, 11, ["sample_id", "point_id"]).select("sample_id", "point_id", "walk_idx", "dx", "dy", "dz", "step"))


@register("f18_sampled_points", f"WITH {POINTS}, r AS (SELECT sample_id, point_id, row_number() OVER (PARTITION BY sample_id ORDER BY md5('5|' || point_id), point_id) AS r, count(*) OVER (PARTITION BY sample_id) AS n FROM points), t AS (SELECT *, CASE WHEN n >= 60 THEN (r <= 60)::INT ELSE (60 - r) // n + 1 END AS times FROM r) SELECT sample_id, point_id, unnest(range(times))::INT AS copy FROM t")
def f18_sampled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sampled(points(spark, sf_dir).select("sample_id", "point_id"), 60, 5, "sample_id", "point_id").select("sample_id", "point_id", "copy")


_SURFACE = f"""WITH {CUBE}, m AS (SELECT 's' || m AS mesh_id FROM {NAMES}), t AS (SELECT mesh_id, c.*, {", ".join(f"(b_{p} - a_{p}) * (c_{q} - a_{q}) - (b_{q} - a_{q}) * (c_{p} - a_{p}) AS m{c}" for c, p, q in ("xyz", "yzx", "zxy"))} FROM m, cube c),
s AS (SELECT *, sqrt(mx * mx + my * my + mz * mz) AS l, sum(0.5 * sqrt(mx * mx + my * my + mz * mz)) OVER (PARTITION BY mesh_id ORDER BY tri) AS run FROM t),
w AS (SELECT *, max(run) OVER (PARTITION BY mesh_id) AS total, coalesce(lag(run) OVER (PARTITION BY mesh_id ORDER BY tri), 0) AS before FROM s),
k AS (SELECT *, unnest(range((floor(250 * run / total + {_u(3, 'mesh_id')}) - floor(250 * before / total + {_u(3, 'mesh_id')}))::BIGINT))::INT AS k FROM w),
d AS (SELECT *, sqrt({_u(4, 'mesh_id', 'tri', 'k')}) AS r, {_u(5, 'mesh_id', 'tri', 'k')} AS s FROM k)
SELECT mesh_id, tri::INT AS tri, k, """ + _r(**{c: f"a_{c} * (1 - r) + b_{c} * r * (1 - s) + c_{c} * r * s" for c in "xyz"}, **{f"n{c}": f"m{c} / l" for c in "xyz"}) + " FROM d"


@register("g3_surface_points", _SURFACE)
def g3_surface_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sampling.surface_points(meshes_of(spark, sf_dir), 250, 3))


@register("g4_interior_points", "SELECT 's' || m AS mesh_id, k::INT AS k, 0 AS copy, 400 AS found, " + _r(**{c: f"{-HALF} + {2 * HALF} * {_u(3 + i, repr('s') + ' || m', 'k')}" for i, c in enumerate("xyz")}) + f" FROM {NAMES}, range(400) AS s(k)")
def g4_interior_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """400 points in rounds of 160: in a cube every draw is inside."""
    s = sampling.interior_points(meshes_of(spark, sf_dir), 400, 160, 3)
    return rounded(s.select("mesh_id", F.col("k").cast("int").alias("k"), "copy", F.col("found").cast("int").alias("found"), "x", "y", "z"))


_MASKED = {"all": ("wall_dist", "nx", "ny", "nz"), "distance": ("wall_dist",), "direction": ("nx", "ny", "nz")}


@register("p4_wall_mask", f"WITH {POINTS} " + " UNION ALL ".join(f"SELECT '{m}' AS mode, sample_id, point_id, " + _r(**{c: f"CASE WHEN {_u(9, 'sample_id')} < 0.5 THEN 0 ELSE {c} END" if c in cs else c for c in _MASKED["all"]}) + " FROM points" for m, cs in _MASKED.items()))
def p4_wall_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three modes, one after another."""
    p = points(spark, sf_dir)
    each = [sampling.wall_mask(p, 0.5, 9, m).select(F.lit(m).alias("mode"), "sample_id", "point_id", *_MASKED["all"]) for m in _MASKED]
    return rounded(each[0].unionByName(each[1]).unionByName(each[2]))


@register("s27_synthetic_cylinder", f"WITH d AS (SELECT id, sqrt({_u(2026, 'id')}) AS r, 2 * pi() * {_u(2027, 'id')} AS phi FROM range((SELECT count(DISTINCT label) FROM embeddings) * 64) AS t(id)) SELECT 'c' || (id // 64) AS sample_id, id % 64 AS point_id, " + _r(x=f"2 * {_u(2028, 'id')} - 1", y="r * cos(phi)", z="r * sin(phi)", wall_dist="greatest(1 - r, 0)", nx="0", ny="cos(phi)", nz="sin(phi)") + " FROM d")
def s27_synthetic_cylinder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many cylinders as there are samples of points, of 64 points each."""
    return rounded(sampling.synthetic_cylinder(spark, table(spark, sf_dir, "embeddings").select("label").distinct().count(), 64, 2026))


@register("s20_finite_samples", f"WITH {CFD} SELECT sample_id FROM cfd GROUP BY sample_id HAVING bool_and(NOT (sample_id % 9 = 0 AND u > 0.9))")
def s20_finite_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples whose every value is finite, and not all nearly 0."""
    rows = cfd(spark, sf_dir).withColumn("u", F.when((F.col("sample_id") % 9 == 0) & (F.col("u") > 0.9), float("nan")).otherwise(F.col("u")))
    told = rows.groupBy("sample_id").agg(F.bool_and(frames.is_finite(F.col("p") + F.col("u") + F.col("v") + F.col("w"))).alias("fine"), F.max(F.greatest(*(F.abs(c) for c in "puvw"))).alias("top"))
    return told.where("fine and top >= 1e-12").select("sample_id")


@register("x1_split_fallback", "WITH s AS (SELECT n_name, CASE WHEN c_custkey % 5 = 0 THEN CASE WHEN n_regionkey = 3 THEN 'val' ELSE 'test' END WHEN c_custkey % 5 = 1 THEN 'val' ELSE 'train' END AS split FROM customer JOIN nation ON c_nationkey = n_nationkey), h AS (SELECT n_name, bool_or(split = 'test') AS t FROM s GROUP BY n_name) SELECT n_name, CASE WHEN split = 'val' AND NOT t THEN 'test' ELSE split END AS split, count(*) AS n FROM s JOIN h USING (n_name) GROUP BY ALL")
def x1_split_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation without a test split is tested on its validation split."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    split = F.when(F.col("c_custkey") % 5 == 0, F.when(F.col("n_regionkey") == 3, F.lit("val")).otherwise("test")).when(F.col("c_custkey") % 5 == 1, "val").otherwise("train")
    rows = c.select("n_name", split.alias("split"))
    has = rows.groupBy("n_name").agg(F.bool_or(F.col("split") == "test").alias("has_test"))
    told = rows.join(has, "n_name").withColumn("split", F.when((F.col("split") == "val") & ~F.col("has_test"), "test").otherwise(F.col("split")))
    return told.groupBy("n_name", "split").agg(F.count("*").alias("n"))


@register("x7_pretrain_split", "WITH n AS (SELECT least(12, greatest(1, count(*) // 10)) AS t, count(*) AS c FROM customer), r AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('7|' || c_custkey), c_custkey) AS r FROM customer) SELECT c_custkey, CASE WHEN r <= least(80, c - t) THEN 'train' ELSE 'test' END AS split FROM r, n WHERE r <= least(80, c - t) + t")
def x7_pretrain_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the samples in the order of a seeded hash, the first for training and the next for the test."""
    return sel.pretrain_split(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 80, 12, 7)


@register("p13_split_filter", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_orderstatus")
def p13_split_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O")).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@register("a20_scoped_normaliser", f"WITH {CFD} SELECT " + _r(p_mean="avg(p)", p_std="stddev_samp(p) + 1e-8") + " FROM cfd WHERE sample_id % 3 = 0")
def a20_scoped_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sel.normaliser(cfd(spark, sf_dir).where("sample_id % 3 = 0"), ["p"]))


@register("a17_component_threshold", "WITH c AS (SELECT l_suppkey AS label_id, l_linenumber AS part, count(*) AS voxels FROM lineitem GROUP BY ALL), m AS (SELECT *, max(voxels) OVER (PARTITION BY label_id) AS top FROM c), k AS (SELECT *, voxels >= greatest(20, ceil(0.9 * top)) AS fits FROM m), n AS (SELECT *, bool_or(fits) OVER (PARTITION BY label_id) AS any_fits FROM k) SELECT label_id, part, voxels FROM n WHERE fits OR (NOT any_fits AND voxels = top)")
def a17_component_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of at least 20 voxels and 0.9 of the largest; where none is that large, the largest."""
    parts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("label_id"), F.col("l_linenumber").alias("part")).agg(F.count("*").alias("voxels"))
    w = W.partitionBy("label_id")
    told = parts.withColumn("top", F.max("voxels").over(w)).withColumn("fits", F.col("voxels") >= F.greatest(F.lit(20), F.ceil(0.9 * F.col("top"))))
    some = told.withColumn("some", F.bool_or("fits").over(w))
    return some.where(F.col("fits") | (~F.col("some") & (F.col("voxels") == F.col("top")))).select("label_id", "part", "voxels")


@register("s24_first_existing", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'a/' || c_custkey WHEN c_custkey % 3 = 0 THEN 'b/' || c_custkey END AS path FROM customer")
def s24_first_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a case's candidate paths, the first that is in the listing."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    listing = c.where("c_custkey % 2 = 0").select(F.concat(F.lit("a/"), "c_custkey").alias("path")).unionByName(c.where("c_custkey % 3 = 0").select(F.concat(F.lit("b/"), "c_custkey").alias("path"))).withColumn("path_key", F.col("path"))
    keys = [F.concat(F.lit(p), F.col("c_custkey")) for p in ("a/", "b/")]
    return sel.first_match(c, listing, keys, "path_key", "c_custkey", ["path"])


@register("s29_running_index", "SELECT p_brand, p_partkey, row_number() OVER (ORDER BY p_brand, p_partkey) - 1 AS idx FROM part")
def s29_running_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running index over configurations, ranked in ranges of brand and key."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey")
    return running(p, [], ["p_brand", "p_partkey"]).select("p_brand", "p_partkey", F.col("position").alias("idx"))
