"""Assembly of data sets over the driver's tables: arrays, discovery, meshes and walls, folds, audits and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators import datasets, geometry, inference
from flowloom.operators import quality_control as qc
from flowloom.operators import selection as sel
from flowloom.plans.adapters import POINTS, points, rounded
from flowloom.plans.geometry_queries import _MESHED, BOX, HALF, _faces, cubes, walkers
from flowloom.plans.registry import register
from flowloom.plans.relational_queries import QC, _r, qc_rows
from flowloom.session import scratch, table
from flowloom.sources import files, sinks

# ---- arrays ------------------------------------------------------------------------------------------------------

_INDEXED = f"WITH {POINTS}, i AS (SELECT *, substr(sample_id, 2)::BIGINT AS index, row_number() OVER (PARTITION BY sample_id ORDER BY point_id) - 1 AS row FROM points)\n"


def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arrays x, y and cond of each sample, as the reader of array files gives them; sample 3 has no cond, sample 4 half its y."""
    from pyspark.sql import Window as W

    p = points(spark, sf_dir).withColumns({"index": F.substring("sample_id", 2, 9), "row": (F.row_number().over(W.partitionBy("sample_id").orderBy("point_id")) - 1).cast("long")})
    path = lambda kind: F.concat(F.lit(f"file:/data/{kind}_"), "index", F.lit(".npy"))
    x = p.select(path("x").alias("path"), "row", F.array("x", "y", "z", "wall_dist", "nx").alias("values"))
    y = p.where("index <> '4' or row % 2 = 0").select(path("y").alias("path"), "row", F.array("tp", "tu", "tv", "tw").alias("values"))
    cond = p.where("row = 0 and index <> '3'").select(path("cond").alias("path"), "row", F.array("dx", "dy", "dz").alias("values"))
    return x.unionByName(y).unionByName(cond)


def _rounded_arrays(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.transform(n, lambda v: F.round(v, 6) + F.lit(0.0)) for n in names})


_LISTS = {"pos": ("x", "y", "z"), "fx": ("wall_dist", "nx"), "y": ("tp", "tu", "tv", "tw")}
_RND = lambda xs: "[" + ", ".join(f"round(({x})::DOUBLE, 6) + 0.0" for x in xs) + "]"
_KEPT = " FROM i JOIN (SELECT index, arg_min(dx, row) AS cx, arg_min(dy, row) AS cy, arg_min(dz, row) AS cz FROM i GROUP BY index) c USING (index) WHERE index <> 3 AND (index <> 4 OR row % 2 = 0)"


@register("s1_triplets", _INDEXED + "SELECT index, row, " + ", ".join(f"{_RND(v)} AS {k}" for k, v in _LISTS.items()) + f", {_RND(('cx', 'cy', 'cz'))} AS cond" + _KEPT)
def s1_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_arrays(datasets.triplets(_arrays(spark, sf_dir)), ["pos", "fx", "cond", "y"])


@register("s2_legacy_shape", _INDEXED + f"SELECT index, row, {_RND(('wall_dist', 'nx', '0', '0'))} AS fx, list_concat({_RND(('cx', 'cy', 'cz'))}, [0.0::DOUBLE, 0, 0, 0, 0, 0, 0, 0, -1]) AS cond" + _KEPT)
def s2_legacy_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometry filled up to four channels and conditions to twelve, the last of which tells the format."""
    return _rounded_arrays(datasets.legacy_shape(datasets.triplets(_arrays(spark, sf_dir))).select("index", "row", "fx", "cond"), ["fx", "cond"])


# ---- discovery and manifests -------------------------------------------------------------------------------------


_SOUND = """SELECT CASE WHEN p_partkey % 11 = 0 THEN '/other/data/' ELSE '/root/data/' END || p_brand || '/case' || p_partkey AS sample FROM part
WHERE p_partkey % 11 <> 0 AND p_size * 100 > 1000 AND (p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 OR p_partkey % 7 = 0) AND p_partkey % 13 <> 0 AND p_partkey % 17 <> 5 AND p_partkey % 4 <> 1 AND p_partkey % 9 <> 2"""


def _sample_listing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files and meta of samples made from parts: some outside of the root, small, without a pair, unsound or of other walks."""
    k = F.col("p_partkey")
    root = F.when(k % 11 == 0, "/other/data/").otherwise("/root/data/")
    p = table(spark, sf_dir, "part").withColumn("sample", F.concat(root, "p_brand", F.lit("/case"), "p_partkey"))
    file = lambda name, size: F.struct(F.lit(name).alias("name"), size.cast("long").alias("length"))
    files = F.array_compact(F.array(
        file("x.npy", F.col("p_size") * 100), file("meta.json", F.lit(90)), file("condition_0.npy", F.when(k % 3 == 0, 50).otherwise(150)), F.when(k % 5 != 0, file("supervise_0.npy", F.lit(150))),
        F.when(k % 7 == 0, file("condition_1.npy", F.lit(101))), F.when(k % 7 == 0, file("supervise_1.npy", F.lit(101))), file("supervise_2.npy", F.lit(900)),
    ))
    listing = p.select("sample", F.explode(files).alias("f")).select(F.concat_ws("/", "sample", "f.name").alias("path"), "f.length")
    meta = p.select(
        "sample", (k % 13 != 0).alias("readable"), (k % 17 != 5).alias("success"), F.when(k % 4 == 1, "fail").when(k % 4 == 2, "Pass").alias("meta_status"), F.when(k % 4 == 3, "warn").alias("manifest_status"),
        F.when(k % 9 == 2, F.lit(4)).otherwise(20).alias("n_random_walks"), F.lit(0.05).alias("perturb_sigma"), F.lit(3).alias("walk_steps"),
    )
    return listing, meta


@register("s23_discovered", _SOUND)
def s23_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders under the root with a large x, a complete pair of walks, a sound meta and the walks asked for."""
    listing, meta = _sample_listing(spark, sf_dir)
    return datasets.discovered(listing, meta, "/root/data", ["pass", "warn"], 20, 3)


@register("s23_first_discovered", f"SELECT sample FROM ({_SOUND}) ORDER BY regexp_extract(sample, '^(.*)/', 1), sample LIMIT 40")
def s23_first_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty of them by cohort and case, where every third one has a copy a folder deeper and every fourth one a folder higher, which don't count."""
    listing, meta = _sample_listing(spark, sf_dir)
    deeper = lambda df, c: df.withColumn(c, F.replace(c, F.lit("/case"), F.lit("/more/case"))).where(F.length(c) % 3 == 0)
    higher = lambda df, c: df.withColumn(c, F.regexp_replace(c, "data/[^/]*/case", "data/case")).where(F.length(c) % 4 == 0)
    listing = listing.unionByName(deeper(listing, "path")).unionByName(higher(listing, "path"))
    meta = meta.unionByName(deeper(meta, "sample")).unionByName(higher(meta, "sample"))
    return datasets.discovered(listing, meta, "/root/data", ["pass", "warn"], 20, 3, levels=2, most=40)


@register("s7_stem_lookup", QC + "SELECT dataset, 'm' || (p_partkey // 2) || '.v' AS stem, arg_max(status, p_partkey) AS status, max(p_partkey) AS line FROM qc WHERE p_partkey % 6 <> 0 GROUP BY ALL")
def s7_stem_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last manifest row of each data set and stem; rows without a name are left out."""
    rows = qc_rows(spark, sf_dir).select("dataset", F.when(F.col("p_partkey") % 6 != 0, F.concat(F.lit("m"), F.floor(F.col("p_partkey") / 2), F.lit(".v.stl"))).otherwise(F.when(F.col("p_partkey") % 12 == 0, "")).alias("name"), "status", F.col("p_partkey").alias("line"))
    return sel.stem_lookup(rows, "line", "dataset", "name", ["status", "line"])


@register("s19_reserved_cases", "SELECT n_nationkey, 'V_' || n_name AS case_id FROM nation WHERE n_regionkey < 4 UNION ALL SELECT n_nationkey, n_nationkey::VARCHAR FROM nation WHERE n_regionkey < 4")
def s19_reserved_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of reserved ids in JSON, with repeats; texts that have none or aren't JSON."""
    text = F.when(F.col("n_regionkey") < 4, F.concat(F.lit('{"reserved_case_ids": ["V_'), "n_name", F.lit('", "'), "n_nationkey", F.lit('", "V_'), "n_name", F.lit('"]}'))).otherwise("not json")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(datasets.reserved_cases(text)).alias("case_id"))


@register("s25_fold_manifest", "SELECT r_regionkey, fold, role, position::INT AS position, 'c' || ((r_regionkey + 1) * n + position) AS \"case\" FROM region, (VALUES ('fold_0', 'train', 3), ('fold_0', 'val', 1), ('fold_1', 'train', 2)) AS v(fold, role, n), range(3) AS t(position) WHERE position < n")
def s25_fold_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = lambda n, i: F.concat(F.lit("c"), ((F.col("r_regionkey") + 1) * n + i).cast("string"))
    folds = F.create_map(
        F.lit("fold_0"), F.struct(F.array(*(case(3, i) for i in range(3))).alias("train_cases"), F.array(case(1, 0)).alias("val_cases")),
        F.lit("fold_1"), F.struct(F.array(*(case(2, i) for i in range(2))).alias("train_cases"), F.lit(None).cast("array<string>").alias("val_cases")),
    )
    text = F.to_json(F.struct(folds.alias("folds"), F.lit("more").alias("note")))
    return table(spark, sf_dir, "region").select("r_regionkey", F.explode(datasets.fold_cases(text)).alias("c")).select("r_regionkey", "c.*")


# ---- meshes, solutions, walls ------------------------------------------------------------------------------------

_SOLVED = """WITH m AS (SELECT l_suppkey AS simulation, count(*) AS n_points FROM lineitem GROUP BY ALL), s AS (SELECT l_suppkey AS simulation, count(*) AS n_rows, max(l_suppkey * 10) AS step FROM lineitem WHERE l_suppkey % 7 <> 0 AND (l_suppkey % 5 <> 0 OR l_linenumber > 1) GROUP BY ALL)"""


@register("p10_mesh_decisions", _SOLVED + " SELECT simulation, n_points, coalesce(n_rows, 0) AS n_rows, step, CASE WHEN step IS NULL THEN 'no_restart' WHEN step < 45 THEN 'early_restart' WHEN n_points <> n_rows THEN 'count_mismatch' ELSE 'kept' END AS decision FROM m LEFT JOIN s USING (simulation)")
def p10_mesh_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulations by the step of their restart and by whether mesh and solution have as many rows."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("simulation"), "l_linenumber")
    solved = rows.where("simulation % 7 <> 0 and (simulation % 5 <> 0 or l_linenumber > 1)").withColumn("step", F.col("simulation") * 10)
    return datasets.mesh_decisions(rows, solved, min_step=45)


@register("j7_mesh_solution", "WITH m AS (SELECT o_orderstatus AS mesh, o_orderkey AS node, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS row, o_totalprice AS x FROM orders) SELECT mesh, row, node, x, row * 2 + length(mesh) AS p FROM m WHERE row % 3 <> 1")
def j7_mesh_solution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The solution's rows joined to mesh points by the order of their node numbers; every third solution row is missing."""
    o = table(spark, sf_dir, "orders")
    meshes = o.select(F.col("o_orderstatus").alias("mesh"), F.col("o_orderkey").alias("node"), F.col("o_totalprice").alias("x"))
    counts = o.groupBy(F.col("o_orderstatus").alias("mesh")).count()
    solutions = datasets.numbered_rows(counts, "mesh", "count", "row").where("row % 3 <> 1").withColumn("p", F.col("row") * 2 + F.length("mesh"))
    return datasets.mesh_solution(meshes, solutions, "mesh", "node", "row", ["x"]).select("mesh", "row", "node", "x", "p")


@register("j8_wall_surfaces", "SELECT c_custkey, strict, CASE WHEN c_custkey % 3 = 0 THEN 'zeros_missing_wall' ELSE 'walls' END AS feature_source FROM customer, (VALUES (true), (false)) AS v(strict) WHERE NOT strict OR c_custkey % 3 <> 0")
def j8_wall_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with and without a wall surface; once those without are left out, once they stay with zeros."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 6 != 0, F.concat(F.lit("/w/"), "c_custkey")).alias("wall"))
    surfaces = c.where("c_custkey % 3 <> 0").select("wall")
    both = [datasets.with_walls(c, surfaces.unionByName(surfaces), "wall", "walls", strict).withColumn("strict", F.lit(strict)) for strict in (True, False)]
    return both[0].unionByName(both[1]).select("c_custkey", "strict", "feature_source")


#: The meshes of the topology queries, each with a tetrahedron of four faces apart from its cube.
_APART = _MESHED + ", a AS (SELECT mesh_id, tri, a, b, c FROM f UNION ALL SELECT n.n_name, v.* FROM nation n, (VALUES (100, 50, 51, 52), (101, 50, 51, 53), (102, 50, 52, 53), (103, 51, 52, 53)) AS v(tri, a, b, c))"


def _apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = _faces(spark, sf_dir)
    more = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(f, ("tri", "a", "b", "c"), strict=True))) for f in ((100, 50, 51, 52), (101, 50, 51, 53), (102, 50, 52, 53), (103, 51, 52, 53))))
    return faces.unionByName(faces.select("mesh_id").distinct().select("mesh_id", F.explode(more).alias("f")).select("mesh_id", "f.*"))


@register("g2_largest_component", _APART + " SELECT mesh_id, tri::INT AS tri FROM a WHERE tri < 100")
def g2_largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.largest_component(_apart(spark, sf_dir)).select("mesh_id", F.col("tri").cast("int").alias("tri"))


@register("t2s_components_by_size", _APART + " SELECT mesh_id, CASE WHEN tri < 100 THEN 1 ELSE 2 END AS rank, min(least(a, b, c))::INT AS component, count(*) AS faces FROM a GROUP BY ALL")
def t2s_components_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = qc.component_labels(_apart(spark, sf_dir)).groupBy("mesh_id", "component").agg(F.count("*").alias("faces"))
    return datasets.components_by_size(parts, "mesh_id", "faces", "component").select("mesh_id", "rank", F.col("component").cast("int").alias("component"), "faces")


@register("a12_several_components", _APART + " SELECT mesh_id, 2::BIGINT AS n_components, count(*) FILTER (tri < 100) AS largest_component_faces, " + _r(largest_component_fraction="count(*) FILTER (tri < 100) / count(*)") + " FROM a GROUP BY mesh_id")
def a12_several_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(qc.components(_apart(spark, sf_dir)))


# ---- folds, splits, audits ---------------------------------------------------------------------------------------

_FOLDED = "WITH f AS (SELECT o_custkey % 4 AS fold, CASE WHEN o_orderkey % 5 = 0 THEN 'val' ELSE 'train' END AS role, o_orderkey AS index FROM orders WHERE o_orderstatus <> 'P'), p AS (SELECT *, row_number() OVER (PARTITION BY fold, role ORDER BY index) - 1 AS position FROM f), t AS (SELECT o_orderkey AS index, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders WHERE o_orderstatus = 'P')"


@register("x2_strict_folds", _FOLDED + " SELECT 'val' AS evaluate, CASE role WHEN 'val' THEN 'eval' ELSE role END AS role, index FROM p WHERE fold = 2 AND position < CASE role WHEN 'val' THEN 40 ELSE 100 END UNION ALL SELECT 'test', 'train', index FROM p WHERE fold = 2 AND role = 'train' UNION ALL SELECT 'test', 'eval', index FROM t")
def x2_strict_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold 2, evaluated on its validation indices, with limits, and on the independent tests, whole."""
    o = table(spark, sf_dir, "orders")
    named = o.where("o_orderstatus <> 'P'").select((F.col("o_custkey") % 4).alias("fold"), F.when(F.col("o_orderkey") % 5 == 0, "val").otherwise("train").alias("role"), "o_orderkey")
    at = sel.split_positions(named, ["fold", "role"], "o_orderkey")
    tests = sel.split_positions(o.where("o_orderstatus = 'P'"), "o_orderstatus", "o_orderkey").select("position", "index")
    each = [sel.strict_folds(at, tests, 2, e, *limits).withColumn("evaluate", F.lit(e)) for e, limits in (("val", (100, 40)), ("test", ()))]
    return each[0].unionByName(each[1]).select("evaluate", "role", "index")


_SPLIT = "CASE WHEN o_orderkey % 10 = 0 THEN 'val' ELSE 'train' END"


@register("k6_split_info", f"WITH s AS (SELECT {_SPLIT} AS list, o_orderkey AS index FROM orders), e AS (SELECT * FROM s UNION ALL SELECT 'test', index FROM s WHERE list = 'val') SELECT list, row_number() OVER (PARTITION BY list ORDER BY index) - 1 AS position, index FROM e")
def k6_split_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train, val and test lists of a data set without a test split, whose validation list is tested on."""
    rows = table(spark, sf_dir, "orders").selectExpr(f"{_SPLIT} AS split", "o_orderkey AS index")
    return datasets.split_info(rows)


@register("p16_first_of_split", f"WITH s AS (SELECT {_SPLIT} AS split, o_orderkey AS index FROM orders), r AS (SELECT split, row_number() OVER (PARTITION BY split ORDER BY index) - 1 AS position, index FROM s) SELECT * FROM r WHERE split <> 'train' OR position < 50")
def p16_first_of_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr(f"{_SPLIT} AS split", "o_orderkey AS index")
    return datasets.first_of_split(rows, "split", "index", {"train": 50})


@register("k7_audit", "SELECT p_brand, count(*) AS n, min('/root/data/' || p_brand || '/case' || p_partkey) AS first FROM part GROUP BY p_brand")
def k7_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample's path is under the root, or the query fails."""
    samples = table(spark, sf_dir, "part").select("p_brand", F.concat(F.lit("/root/data/"), "p_brand", F.lit("/case"), "p_partkey").alias("path"))
    return datasets.audited(samples, "/root/data").groupBy("p_brand").agg(F.count("path").alias("n"), F.min("path").alias("first"))


@register("a23_run_totals", "SELECT p_brand, count(*) FILTER (p_size < 20) AS ok, count(*) FILTER (p_size >= 40) AS failed, count(*) FILTER (p_size >= 20 AND p_size < 40) AS skipped, count(*) AS total FROM part GROUP BY p_brand")
def a23_run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("p_size") < 20, "ok").when(F.col("p_size") < 40, "skip").otherwise("fail")
    return datasets.totals(table(spark, sf_dir, "part").withColumn("outcome", outcome), by=["p_brand"])


@register("a24_identity_normaliser", f"WITH {POINTS} SELECT sample_id, point_id, " + _r(tp="tp") + " FROM points")
def a24_identity_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted like the others, and applied without effect."""
    p = points(spark, sf_dir).select("sample_id", "point_id", "tp")
    return rounded(datasets.identity_encode(p, sel.normaliser(p, ["tp"], ["sample_id"], 1e-5)))


@register("k10_results", """WITH s AS (SELECT n_name, avg(c_acctbal) / 9973.1 AS d, stddev_samp(c_acctbal) / 9973.1 AS m, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT n_name, rpad(substr(n_name, 1, 12), 12, ' ') || ' | ' || rpad('compact', 24, ' ') || ' | ' || printf('%.4f', d) || ' | ' || printf('%.4f', m) || ' | ' || CASE WHEN n_regionkey = 0 THEN '---' ELSE printf('%+.2f%%', n_regionkey * 12.5) END AS line,
  CASE WHEN n_regionkey = 0 THEN '{"name":"' || n_name || '"}' ELSE '{"name":"' || n_name || '","region":' || n_regionkey || '}' END AS results FROM s""")
def k10_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as a table's lines and as JSON."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    s = c.groupBy("n_name", "n_regionkey").agg((F.avg("c_acctbal") / 9973.1).alias("d"), (F.stddev_samp("c_acctbal") / 9973.1).alias("m"))
    region = F.when(F.col("n_regionkey") > 0, F.col("n_regionkey"))
    told = datasets.results_json(s.withColumns({"name": F.col("n_name"), "region": region}), "n_name", ["name", "region"])
    lines = s.select("n_name", datasets.results_line(F.col("n_name"), F.lit("compact"), F.col("d"), F.col("m"), region * 12.5).alias("line"))
    return lines.join(told, "n_name")


@register("l17_channels", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'u,v,w' WHEN 1 THEN 'p,u,v,w' WHEN 2 THEN 'c0,c1' WHEN 3 THEN 'c0' ELSE 'c0,c1,c2,c3,c4' END AS label, n_regionkey = 1 AS pressure, n_regionkey < 2 AS physics FROM nation")
def l17_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of outputs of several widths, whether they have a pressure, and whether the loss has a physics branch over a geometry of two."""
    widths = {0: 3, 1: 4, 2: 2, 3: 1, 4: 5}
    of = lambda value: F.create_map(*(F.lit(x) for r, w in widths.items() for x in (r, value(w))))[F.col("n_regionkey")]
    physics = lambda w: datasets.uses_physics_loss(w != 5, w, 9, 2)
    return table(spark, sf_dir, "nation").select("n_nationkey", of(datasets.channel_label).alias("label"), of(datasets.has_pressure).alias("pressure"), of(physics).alias("physics"))


# ---- attention over slices ---------------------------------------------------------------------------------------

_Q, _K, _V = [[0.8, 0.1], [-0.2, 0.6]], [[0.5, 0.3], [0.4, -0.7]], [[1.0, 0.2], [-0.5, 0.9]]
_row = lambda m, f: f"({m[0]} * y + {m[1]} * z) AS {f}"
_ATTEND = f"""WITH {POINTS}, s AS (SELECT *, unnest(range(4)) AS slice FROM points), w AS (SELECT *, exp(-abs(x) * (slice + 1)) AS w FROM s),
t AS (SELECT sample_id, slice, sum(w * y) / (sum(w) + 1e-5) AS y, sum(w * z) / (sum(w) + 1e-5) AS z FROM w GROUP BY sample_id, slice),
q AS (SELECT sample_id, slice, {_row(_Q[0], 'qy')}, {_row(_Q[1], 'qz')} FROM t), k AS (SELECT sample_id, slice AS o, {_row(_K[0], 'ky')}, {_row(_K[1], 'kz')}, {_row(_V[0], 'vy')}, {_row(_V[1], 'vz')} FROM t),
a AS (SELECT sample_id, slice, sum(exp(0.7 * (qy * ky + qz * kz)) * vy) / sum(exp(0.7 * (qy * ky + qz * kz))) AS y, sum(exp(0.7 * (qy * ky + qz * kz)) * vz) / sum(exp(0.7 * (qy * ky + qz * kz))) AS z FROM q JOIN k USING (sample_id) GROUP BY sample_id, slice)
"""


def _attended(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = points(spark, sf_dir).withColumn("w", F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.exp(-F.abs("x") * k)))
    return p, inference.attend_slices(inference.slice_tokens(p, "w", ["y", "z"]), ["y", "z"], _Q, _K, _V, 0.7)


@register("m5_slice_attention", _ATTEND + "SELECT sample_id, slice::INT AS slice, " + _r(y="y", z="z") + " FROM a")
def m5_slice_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_attended(spark, sf_dir)[1])


@register("m5_deslice", _ATTEND + "SELECT w.sample_id, w.point_id, " + _r(y="sum(w.w * a.y)", z="sum(w.w * a.z)") + " FROM w JOIN a USING (sample_id, slice) GROUP BY w.sample_id, w.point_id")
def m5_deslice(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, tokens = _attended(spark, sf_dir)
    return rounded(inference.deslice(p, tokens, "w", ["y", "z"], ["sample_id", "point_id"]))


# ---- written and read back ---------------------------------------------------------------------------------------


@register("s8_k6_metadata_round_trip", "SELECT p_partkey::VARCHAR AS index, p_brand AS dataset, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_name END AS name, p_size AS size_json FROM part")
def s8_k6_metadata_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata written as CSV and JSON lines, read back as strings and typed."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("index"), F.col("p_brand").alias("dataset"), F.when(F.col("p_size") % 7 != 0, F.col("p_name")).alias("name"), F.col("p_size").alias("size"))
    path = scratch(spark, "metadata")
    sinks.write_metadata(rows, datasets.split_info(rows.withColumn("split", F.lit("train"))), path)
    csv = files.read_manifest_csv(spark, f"{path}/metadata_csv").select("index", "dataset", "name")
    told = files.read_manifest_json(spark, f"{path}/metadata_json", "index long, size int").select(F.col("index").cast("string").alias("index"), F.col("size").alias("size_json"))
    return csv.join(told, "index")


@register("s9_text_table", f"WITH {POINTS} SELECT point_id, " + _r(**{c: c for c in ("x", "y", "z", "p")}) + " FROM (SELECT point_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(tp, 6) AS p FROM points WHERE point_id % 5 <> 0)")
def s9_text_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of numbers parted by odd white space; every fifth has a word among them and is left out."""
    p = points(spark, sf_dir)
    number = lambda c: F.format_string("%.6f", c)
    last = F.when(F.col("point_id") % 5 == 0, F.lit("none")).otherwise(number(F.col("tp")))
    path = scratch(spark, "text-table")
    p.select(F.concat(F.lit(" "), F.concat_ws("\t ", F.col("point_id").cast("string"), number(F.col("x")), number(F.col("y")), number(F.col("z")), last), F.lit(" ")).alias("value")).write.text(path)
    return rounded(files.read_table(spark, path, ["point_id", "x", "y", "z", "p"]).select(F.col("point_id").cast("long").alias("point_id"), "x", "y", "z", "p"))


@register("k1_k5_appended_manifest", QC + "SELECT dataset, status, count(*) AS n, 2 * count(*) AS lines FROM qc GROUP BY ALL")
def k1_k5_appended_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples written by data set, and a manifest to which they are appended twice; both read back."""
    rows = qc_rows(spark, sf_dir).select("p_partkey", "dataset", "status")
    path = scratch(spark, "samples")
    sinks.write_samples(rows, f"{path}/samples")
    for _ in range(2):
        sinks.append_manifest(rows, f"{path}/manifest")
    manifest = files.read_manifest_json(spark, f"{path}/manifest", "dataset string, status string").groupBy("dataset", "status").agg(F.count("*").alias("lines"))
    return spark.read.parquet(f"{path}/samples").groupBy("dataset", "status").agg(F.count("*").alias("n")).join(manifest, ["dataset", "status"])


@register("k4_qc_round_trip", QC + "SELECT p_partkey, status, reasons FROM qc")
def k4_qc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rows written as JSON lines and CSV; statuses read from the one, reasons from the other."""
    path = scratch(spark, "qc")
    sinks.write_qc(qc_rows(spark, sf_dir).select("p_partkey", "status", "reasons"), path)
    said = files.read_manifest_json(spark, f"{path}/qc_manifest_json", "p_partkey long, status string")
    why = files.read_manifest_csv(spark, f"{path}/qc_manifest_csv").select(F.col("p_partkey").cast("long").alias("p_partkey"), F.coalesce("reasons", F.lit("")).alias("reasons"))
    return said.join(why, "p_partkey")


# ---- weights, configurations, walks ------------------------------------------------------------------------------


@register("s26_matching_weights", "SELECT p_partkey, p_brand || CASE p_partkey % 5 WHEN 0 THEN '.mlp2.w' WHEN 1 THEN '.ln_3.b' ELSE '.w' || p_partkey END AS name FROM part WHERE p_partkey % 5 > 1 AND p_partkey % 3 > 0 AND p_size % 4 > 0")
def s26_matching_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved parameters that the model has in the same shape, without its heads."""
    name = F.concat("p_brand", F.when(F.col("p_partkey") % 5 == 0, F.lit(".mlp2.w")).when(F.col("p_partkey") % 5 == 1, ".ln_3.b").otherwise(F.concat(F.lit(".w"), "p_partkey")))
    saved = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), F.array("p_size", F.lit(2)).alias("shape"), "p_size")
    wanted = saved.where("p_partkey % 3 > 0").select("name", F.when(F.col("p_size") % 4 > 0, F.col("shape")).otherwise(F.array(F.lit(2), "p_size")).alias("shape")).distinct()
    return datasets.matching_weights(saved, wanted).where("p_size % 4 > 0").select("p_partkey", "name")


@register("s29_configured", """WITH f AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'C1' WHEN 1 THEN 'ICA_norm' WHEN 2 THEN 'ICA_ste' ELSE 'other' END AS config, CASE WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM customer)
SELECT config, split, config || '/' || split || '/' || c_custkey || '.txt' AS path, CASE config WHEN 'C1' THEN 0 WHEN 'ICA_norm' THEN 1 ELSE 2 END AS vessel_type, 0.3::DOUBLE AS inlet, 0.0035::DOUBLE AS viscosity,
  row_number() OVER (ORDER BY config, split DESC, config || '/' || split || '/' || c_custkey || '.txt') - 1 AS index FROM f WHERE config <> 'other'""")
def s29_configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three configurations with their constants and one running index through all of them."""
    c = F.col("c_custkey")
    config = F.when(c % 4 == 0, "C1").when(c % 4 == 1, "ICA_norm").when(c % 4 == 2, "ICA_ste").otherwise("other")
    rows = table(spark, sf_dir, "customer").select("c_custkey", config.alias("config"), F.when(c % 5 == 0, "test").otherwise("train").alias("split"))
    return datasets.configured(rows.select("config", "split", F.concat(F.concat_ws("/", "config", "split", "c_custkey"), F.lit(".txt")).alias("path")))


@register("s3_random_walk", f"WITH {POINTS}, w AS (SELECT sample_id, list_sort(list(DISTINCT (point_id % 7)::INT)) AS a FROM points WHERE point_id % 3 > 0 GROUP BY sample_id) SELECT epoch, sample_id, a[floor(len(a) * (('0x' || substr(md5(concat_ws('|', '41', sample_id, epoch)), 1, 13))::BIGINT / {2**52}.0))::INT + 1] AS walk_idx FROM w, range(5) AS e(epoch)")
def s3_random_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk that each sample is trained on in each of five epochs, drawn from those it has."""
    walks = points(spark, sf_dir).where("point_id % 3 > 0").select("sample_id", (F.col("point_id") % 7).cast("int").alias("walk_idx"))
    return sel.random_walk(walks, 5, 41)


@register("u2_intersect", "SELECT c_nationkey AS nation FROM customer WHERE c_mktsegment = 'BUILDING' INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def u2_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("nation"))
    return a.intersect(table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("nation")))


_INSIDE = lambda way: f"greatest(abs(x + wx * {way}), abs(y + wy * {way}), abs(z + wz * {way})) < {HALF}"
_BISECT = BOX.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f""",
s AS (SELECT *, {_INSIDE('step')} AS ends FROM i WHERE inside),
b AS (SELECT mesh_id, point_id, x, y, z, wx, wy, wz, 0.0::DOUBLE AS lo, step AS hi, 0 AS k FROM s WHERE NOT ends
  UNION ALL SELECT mesh_id, point_id, x, y, z, wx, wy, wz, CASE WHEN {_INSIDE('((lo + hi) / 2)')} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_INSIDE('((lo + hi) / 2)')} THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM b WHERE k < 6),
e AS (SELECT mesh_id, point_id, x, y, z, wx, wy, wz, (lo + hi) / 2 * 0.99 AS way FROM b WHERE k = 6 UNION ALL SELECT mesh_id, point_id, x, y, z, wx, wy, wz, step FROM s WHERE ends)
"""


@register("g7_bisected_move", _BISECT + "SELECT mesh_id, point_id, " + _r(**{c: f"{c} + w{c} * way" for c in "xyz"}) + " FROM e")
def g7_bisected_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walkers that start inside, clamped by six bisections."""
    keys = ["mesh_id", "point_id"]
    inside = F.greatest(*(F.abs(c) for c in "xyz")) < HALF
    return rounded(geometry.bisected_move(walkers(spark, sf_dir).where(inside), cubes(spark), keys).select(*keys, "x", "y", "z"))
