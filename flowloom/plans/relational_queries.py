"""Filters, lookups, summaries, quality control and splits over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions import strings
from flowloom.operators import quality_control as qc
from flowloom.operators import selection as sel
from flowloom.plans.adapters import CFD, POINTS, cfd, points, rounded
from flowloom.plans.registry import register
from flowloom.session import cut_lineage, table


def _r(**cols: str) -> str:
    return ", ".join(f"round(({v})::DOUBLE, 6) + 0.0 AS {k}" for k, v in cols.items())


# ---- strings -----------------------------------------------------------------------------------------------------


@register("f1_status_set", "SELECT p_partkey, list_sort(list_distinct(list_filter(list_transform(string_split(' ' || p_brand || ', ,PASS,' || lower(p_brand), ','), lambda x: lower(trim(x))), lambda x: x <> ''))) AS statuses FROM part")
def f1_status_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", strings.status_set(F.concat(F.lit(" "), "p_brand", F.lit(", ,PASS,"), F.lower("p_brand"))).alias("statuses"))


@register("f2_path_key", r"SELECT page_id, regexp_replace(replace('../' || replace(url, '/', '\'), '\', '/'), '^[./]+', '') AS key FROM pages")
def f2_path_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", strings.path_key(F.concat(F.lit("../"), F.replace("url", F.lit("/"), F.lit("\\")))).alias("key"))


@register("f3_safe_stem", r"SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(url || '.nii.gz', '\.nii(\.gz)?$', ''), '[^A-Za-z0-9._=-]+', '_', 'g'), '._-'), ''), 'case') AS stem FROM pages")
def f3_safe_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", strings.safe_stem(F.concat("url", F.lit(".nii.gz"))).alias("stem"))


@register("f4_path_stem", r"SELECT page_id, regexp_replace(string_split(split_part(url, '?', 1), '/')[-1], '(.)\.[^.]*$', '\1') AS stem, string_split(url, '/')[3] AS dataset FROM pages")
def f4_path_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", strings.stem(F.split("url", r"\?")[0]).alias("stem"), F.split("url", "/")[2].alias("dataset"))


_FAMILY = "CASE WHEN c_custkey % 9 = 0 THEN 'AO_' || c_custkey WHEN c_custkey % 9 = 1 THEN 'PULM_x' WHEN c_custkey % 9 = 2 THEN 'CORO' ELSE c_mktsegment END"


def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").withColumn("territory", F.expr(_FAMILY))


@register("f5_territory_family", f"WITH t AS (SELECT c_custkey, split_part({_FAMILY}, '_', 1) AS f FROM customer) SELECT c_custkey, CASE WHEN f IN ('AO', 'PULM', 'CORO') THEN f ELSE 'UNKNOWN' END AS family, round(CASE f WHEN 'AO' THEN 1 WHEN 'PULM' THEN 4 WHEN 'CORO' THEN 3 ELSE 7 END / 7, 6) AS family_norm FROM t")
def f5_territory_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = strings.territory_family(F.col("territory"))
    return rounded(_families(spark, sf_dir).select("c_custkey", family.alias("family"), strings.family_norm(family).alias("family_norm")))


@register("f6_parse_bool", "SELECT o_orderkey, o_orderstatus = 'F' AS flag FROM orders")
def f6_parse_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", strings.parse_bool(F.when(F.col("o_orderstatus") == "F", F.lit("Yes")).otherwise("0")).alias("flag"))


@register("f7_m_value", "SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN NULL ELSE round(p_size / 1000, 6) END AS m FROM part")
def f7_m_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("m="), (F.col("p_size") / 1000).cast("string"))).when(F.col("p_size") % 3 == 1, (F.col("p_size") / 1000).cast("string")).otherwise("m=bad")
    return rounded(table(spark, sf_dir, "part").select("p_partkey", strings.m_value(text).alias("m")))


@register("p11_filter_words", "SELECT r_regionkey, CASE WHEN r_regionkey = 0 THEN NULL ELSE list_distinct(list_filter(string_split(replace(r_name || ',A B', ',', ' '), ' '), lambda x: x <> '')) END AS words FROM region".replace("list_distinct(", "("))
def p11_filter_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("r_regionkey") == 0, F.lit("x, All")).otherwise(F.concat("r_name", F.lit(",A B")))
    return table(spark, sf_dir, "region").select("r_regionkey", strings.filter_words(text).alias("words"))


_FILES = "(SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'VMR_' || (c_custkey % 40) || '_' || (c_custkey % 7) || '_H_AO_x.stl' WHEN 1 THEN 'aneumo_' || c_custkey || '_m.stl' WHEN 2 THEN c_custkey || '.stl' WHEN 3 THEN 'VMR_' || c_custkey || '_a_b_c.stl' WHEN 4 THEN 'VMR_a_b.stl' ELSE 'other_' || c_custkey || '.stl' END AS name FROM customer)"
_RESERVED = "(SELECT DISTINCT (s_suppkey % 40) || CASE WHEN s_suppkey % 3 > 0 THEN '_' || (s_suppkey % 7) ELSE '' END AS case_id FROM supplier)"


@register("s28_case_ids", f"""WITH f AS (SELECT c_custkey, regexp_replace(name, '[.][^.]*$', '') AS stem FROM {_FILES}),
r AS (SELECT f.c_custkey, arg_max(c.case_id, length(c.case_id)) AS reserved FROM f JOIN {_RESERVED} c ON starts_with(stem, 'VMR_') AND (stem[5:] = c.case_id OR starts_with(stem[5:], c.case_id || '_')) GROUP BY f.c_custkey)
SELECT f.c_custkey, coalesce(r.reserved, CASE WHEN starts_with(stem, 'VMR_') AND len(string_split(stem, '_')) >= 5 THEN array_to_string(string_split(stem, '_')[2:5], '_') END) AS vessel_case,
  CASE WHEN len(string_split(stem, '_')) >= 2 AND lower(split_part(stem, '_', 1)) = 'aneumo' THEN split_part(stem, '_', 2) WHEN regexp_full_match(stem, '[0-9]+') THEN stem END AS numbered_case FROM f LEFT JOIN r USING (c_custkey)""")
def s28_case_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three rules on file names: the longest reserved id, else parts 1 to 4, and a second part or an all-digit stem."""
    c = table(spark, sf_dir, "customer")
    files = c.selectExpr("c_custkey", "CASE c_custkey % 6 WHEN 0 THEN 'VMR_' || (c_custkey % 40) || '_' || (c_custkey % 7) || '_H_AO_x.stl' WHEN 1 THEN 'aneumo_' || c_custkey || '_m.stl' WHEN 2 THEN c_custkey || '.stl' WHEN 3 THEN 'VMR_' || c_custkey || '_a_b_c.stl' WHEN 4 THEN 'VMR_a_b.stl' ELSE 'other_' || c_custkey || '.stl' END AS name")
    reserved = table(spark, sf_dir, "supplier").selectExpr("(s_suppkey % 40) || CASE WHEN s_suppkey % 3 > 0 THEN '_' || (s_suppkey % 7) ELSE '' END AS case_id").distinct()
    told = sel.vessel_cases(files.withColumn("stem", strings.stem(F.col("name"))), reserved, "stem", "c_custkey")
    return told.select("c_custkey", "vessel_case", strings.numbered_case(F.col("stem")).alias("numbered_case"))


# ---- quality control ---------------------------------------------------------------------------------------------

_QC = """p_brand AS dataset, p_partkey % 23 <> 0 AS load_ok, CAST(p_partkey * 7 % 90000 AS BIGINT) AS file_size_bytes, CAST(p_partkey % 997 AS BIGINT) AS n_vertices, CAST(p_size * 40 AS BIGINT) AS n_faces, p_partkey % 31 <> 0 AS finite_vertices,
CASE WHEN p_partkey % 37 = 0 THEN 0 ELSE p_retailprice END AS surface_area, p_retailprice / 10 AS max_extent, (p_partkey % 100) / 99 AS largest_component_fraction, p_partkey % 5 <> 0 AS is_watertight,
CAST(CASE WHEN p_partkey % 5 = 0 THEN 12 ELSE 0 END AS BIGINT) AS boundary_edges, CAST(p_partkey % 7 AS BIGINT) AS nonmanifold_edges, CAST(1 + p_partkey % 3 AS BIGINT) AS n_components, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size * 5.0 END AS aspect_ratio, CAST(p_partkey % 2 AS BIGINT) AS degenerate_faces"""


def qc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.judged(table(spark, sf_dir, "part").selectExpr("p_partkey", *_split(_QC)))


def _split(text: str) -> list[str]:
    """The expressions of a select list, whose commas stand outside of brackets."""
    out, depth, now = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]


QC = f"""WITH raw AS (SELECT p_partkey, {_QC} FROM part),
fails AS (SELECT *, list_filter([CASE WHEN file_size_bytes < 1000 THEN 'tiny_file' END, CASE WHEN n_vertices < 100 THEN 'too_few_vertices' END, CASE WHEN n_faces < 100 THEN 'too_few_faces' END, CASE WHEN NOT finite_vertices THEN 'nonfinite_vertices' END,
  CASE WHEN surface_area <= 1e-8 THEN 'zero_area' END, CASE WHEN max_extent <= 1e-8 THEN 'degenerate_extent' END, CASE WHEN largest_component_fraction < 0.5 THEN 'fragmented_components' END], lambda x: x IS NOT NULL) AS f,
  list_filter([CASE WHEN NOT is_watertight THEN 'not_watertight' END, CASE WHEN boundary_edges > 0 THEN 'open_boundary' END, CASE WHEN nonmanifold_edges > 0 THEN 'nonmanifold_edges' END, CASE WHEN n_components > 1 THEN 'multiple_components' END,
  CASE WHEN aspect_ratio > 100 THEN 'extreme_aspect_ratio' END, CASE WHEN degenerate_faces > 0 THEN 'degenerate_faces' END], lambda x: x IS NOT NULL) AS w FROM raw),
qc AS (SELECT p_partkey, dataset, CASE WHEN NOT load_ok OR len(f) > 0 THEN 'fail' WHEN len(w) > 0 THEN 'warn' ELSE 'pass' END AS status, CASE WHEN NOT load_ok THEN 'load_error' ELSE array_to_string(list_concat(f, w), '|') END AS reasons FROM fails)
"""


@register("f9_qc_ladder", QC + "SELECT p_partkey, status, reasons FROM qc")
def f9_qc_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc_rows(spark, sf_dir).select("p_partkey", "status", "reasons")


@register("a1_status_by_dataset", QC + "SELECT dataset, count(*) FILTER (status = 'pass') AS pass, count(*) FILTER (status = 'warn') AS warn, count(*) FILTER (status = 'fail') AS fail FROM qc GROUP BY dataset")
def a1_status_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.by_status(qc_rows(spark, sf_dir))


@register("a2_top_reasons", QC + "SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, '|')) AS reason FROM qc) WHERE reason <> '' GROUP BY reason ORDER BY n DESC, reason LIMIT 30")
def a2_top_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.top_reasons(qc_rows(spark, sf_dir))


@register("a3_status_totals", QC + "SELECT dataset, status, count(*) AS n FROM qc GROUP BY GROUPING SETS ((dataset, status), (status), ())")
def a3_status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.totals(qc_rows(spark, sf_dir))


@register("p5_status_filter", QC + "SELECT decision, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 11 = 0 THEN 'unmatched_qc' WHEN status IN ('pass', 'warn') THEN 'kept' ELSE 'skipped_status' END AS decision FROM qc) GROUP BY decision")
def p5_status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = qc_rows(spark, sf_dir).withColumn("status", F.when(F.col("p_partkey") % 11 != 0, F.upper("status")))
    return sel.by_status(files, ["pass", "warn"], True).groupBy("decision").agg(F.count("*").alias("n"))


@register("j1_manifest_lookup", QC + "SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE status END AS found FROM qc")
def j1_manifest_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are known by their path, by dataset and name, by their absolute path, or not at all."""
    rows = qc_rows(spark, sf_dir).withColumn("name", F.concat(F.lit("m"), "p_partkey", F.lit(".stl")))
    manifest = rows.where("p_partkey % 4 <> 3").select(F.concat_ws("/", F.lit("./raw"), "dataset", "name").alias("path"), "dataset", "name", F.concat_ws("/", F.lit("/elsewhere/kept"), "name").alias("absolute"), F.upper("status").alias("status"), F.col("p_partkey").alias("line"))
    stale = manifest.withColumns({"status": F.lit("OLD"), "line": F.lit(-1).cast("long")})
    found = sel.manifest_lookup(manifest.unionByName(stale), "line", "path", "dataset", "name", "absolute")
    keys = [F.when(F.col("p_partkey") % 4 == 0, F.concat_ws("/", F.lit("raw"), "dataset", "name")), F.when(F.col("p_partkey") % 4 == 1, F.concat_ws("/", "dataset", "name")), F.concat_ws("/", F.lit("elsewhere/kept"), "name")]
    return sel.first_match(rows.select("p_partkey", "dataset", "name"), found.withColumnRenamed("status", "found"), keys, "key", "p_partkey", ["found"]).select("p_partkey", "found")


@register("p6_meta_filter", "SELECT event_type, count(*) AS n, count(*) FILTER (NOT (event_id % 5 = 0 OR event_id % 7 = 0) AND CASE WHEN event_id % 3 = 0 THEN event_id % 2 = 0 WHEN event_id % 11 = 3 THEN false WHEN event_id % 3 = 1 THEN event_id % 4 < 2 ELSE true END) AS kept FROM events GROUP BY event_type")
def p6_meta_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    meta = table(spark, sf_dir, "events").select(
        "event_type", (e % 5 != 0).alias("readable"), F.when(e % 7 == 0, False).when(e % 2 == 0, True).alias("success"),
        F.when(e % 3 == 0, F.when(e % 2 == 0, F.lit("Pass")).otherwise("fail")).when(e % 11 == 3, "").alias("meta_status"), F.when(e % 3 == 1, F.when(e % 4 < 2, F.lit("warn")).otherwise("fail")).alias("manifest_status"),
    )
    return sel.meta_keeps(meta, ["pass", "warn"]).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("keep").alias("kept"))


@register("p7_walk_contract", "SELECT p_partkey FROM part WHERE p_size >= 20 AND p_partkey % 4 <> 0 AND p_partkey % 5 >= 3")
def p7_walk_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("n_random_walks"), F.when(F.col("p_partkey") % 4 == 0, F.lit("none")).otherwise("0.05").alias("perturb_sigma"), (F.col("p_partkey") % 5).alias("walk_steps"))
    return sel.walk_contract(meta, 20, 3).select("p_partkey")


# ---- joins and filters -------------------------------------------------------------------------------------------


@register("p11_family_filter", f"SELECT c_custkey FROM customer WHERE split_part({_FAMILY}, '_', 1) IN ('AO', 'CORO') AND c_custkey % 2 = 0")
def p11_family_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = _families(spark, sf_dir).where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("index"), "territory")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("index"))
    return sel.family_filter(rows, meta, sel.combined(["AO", "CORO", "PULM"], ["AO", "CORO"]), None).withColumnRenamed("index", "c_custkey")


@register("p12_vessel_types", "SELECT p_partkey FROM part WHERE round_even(p_size / 2, 0) IN (1, 2, 3, 8)")
def p12_vessel_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 2).alias("vessel_type"))
    return sel.vessel_types(rows, [1, 2, 3, 8]).select("p_partkey")


@register("p14_official_cases", "SELECT o_orderkey FROM orders WHERE o_custkey <= 540 AND o_orderkey % 10 <> 0")
def p14_official_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey").cast("string")).alias("case_id"))
    return sel.official(rows).select("o_orderkey")


@register("j2_metadata_join", "SELECT n_name, count(*) AS samples, " + _r(balance="avg(c_acctbal)") + " FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def j2_metadata_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rounded(joined.groupBy("n_name").agg(F.count("*").alias("samples"), F.avg("c_acctbal").alias("balance")))


@register("j3_without_reserved", "SELECT o_orderkey FROM orders WHERE o_orderkey % 13 = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def j3_without_reserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_custkey")).alias("case_id"))
    reserved = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("case_id"))
    return sel.without_reserved(rows, reserved, "case_id").select("o_orderkey")


@register("j4_include_list", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j4_include_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    include = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(include, "o_custkey", "left_semi").select("o_orderkey")


_NAMES = "(SELECT 'V_' || (c_custkey % 40) || CASE WHEN c_custkey % 3 = 0 THEN '_' || (c_custkey % 7) ELSE '' END || CASE WHEN c_custkey % 5 = 0 THEN '_x' ELSE '' END AS stem FROM customer)"
_CASES = "(SELECT DISTINCT 'V_' || (s_suppkey % 30) || CASE WHEN s_suppkey % 2 = 0 THEN '_' || (s_suppkey % 7) ELSE '' END AS case_id FROM supplier)"


@register("j5_longest_prefix", f"SELECT n.stem, arg_max(c.case_id, length(c.case_id)) AS case_id FROM (SELECT DISTINCT stem FROM {_NAMES}) n LEFT JOIN {_CASES} c ON n.stem = c.case_id OR starts_with(n.stem, c.case_id || '_') GROUP BY n.stem")
def j5_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    names = c.selectExpr("'V_' || (c_custkey % 40) || CASE WHEN c_custkey % 3 = 0 THEN '_' || (c_custkey % 7) ELSE '' END || CASE WHEN c_custkey % 5 = 0 THEN '_x' ELSE '' END AS stem").distinct()
    cases = s.selectExpr("'V_' || (s_suppkey % 30) || CASE WHEN s_suppkey % 2 = 0 THEN '_' || (s_suppkey % 7) ELSE '' END AS case_id").distinct()
    return sel.longest_prefix(names, cases)


@register("s22_first_of_each", "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) <= 5")
def s22_first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.first_of_each(table(spark, sf_dir, "part"), "p_brand", ["p_name", "p_partkey"], 5).select("p_brand", "p_partkey")


_RESTARTS = "'sim/' || CASE event_id % 5 WHEN 0 THEN 'restart.' || (event_id * 7 % 40) || '.gz' WHEN 1 THEN 'restart.' || (event_id * 7 % 40) || '.0.gz' WHEN 2 THEN 'restart.' || (event_id % 900) WHEN 3 THEN 'restart.x.' || event_id ELSE 'restart.' || (event_id * 3 % 40) || '.1' END"


@register("s11_latest_restart", f"WITH f AS (SELECT user_id, {_RESTARTS} AS path FROM events), s AS (SELECT *, coalesce(TRY_CAST(nullif(regexp_extract(path, 'restart[.]([0-9]+)[.]', 1), '') AS BIGINT), -1) AS step FROM f) SELECT user_id, path, step FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY step DESC, path) = 1")
def s11_latest_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of all shapes: with and without a part after the step, without a step, and ties."""
    return sel.latest_restart(table(spark, sf_dir, "events").selectExpr("user_id", f"{_RESTARTS} AS path"), "user_id", "path")


@register("s4_fallback_walk", "WITH w AS (SELECT user_id AS sample_id, list_sort(list(DISTINCT (event_id % 20)::INT)) AS a FROM events WHERE event_id % 3 <> 0 GROUP BY user_id) SELECT sample_id, CASE WHEN list_contains(a, 7) THEN 7 ELSE a[7 % len(a) + 1] END AS walk_idx, list_contains(a, 7) AS present FROM w")
def s4_fallback_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    walks = table(spark, sf_dir, "events").where("event_id % 3 <> 0").select(F.col("user_id").alias("sample_id"), (F.col("event_id") % 20).cast("int").alias("walk_idx"))
    return sel.fallback_walk(walks, 7)


# ---- aggregates --------------------------------------------------------------------------------------------------

STATS = f"""WITH {CFD}, s AS (SELECT sample_id, count(*) AS n, sqrt(sum(p * p + u * u + v * v + w * w)) AS y_norm, sqrt(sum(p * p)) AS p_norm, sqrt(sum(u * u + v * v + w * w)) AS v_norm, max(greatest(abs(p), abs(u), abs(v), abs(w))) AS max_abs, stddev_pop(p) AS p_std,
  max(sqrt(u * u + v * v + w * w)) AS vmax, avg(sqrt(u * u + v * v + w * w)) AS speed_mean FROM cfd GROUP BY sample_id), v AS (SELECT sample_id, stddev_pop(c) AS v_std FROM (SELECT sample_id, unnest([u, v, w]) AS c FROM cfd) GROUP BY sample_id)
"""
_STATS = ("y_norm", "p_norm", "v_norm", "max_abs", "p_std", "vmax", "speed_mean", "v_std")


@register("a4_solution_stats", STATS + "SELECT sample_id, n, " + _r(**{c: c for c in _STATS}) + " FROM s JOIN v USING (sample_id)")
def a4_solution_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sel.solution_stats(cfd(spark, sf_dir)).select("sample_id", "n", *_STATS))


@register("p8_solution_filter", STATS + "SELECT sample_id FROM s WHERE y_norm >= 16 AND p_norm >= 11.5 AND p_std >= 0.25 AND max_abs >= 1")
def p8_solution_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.sound_solutions(sel.solution_stats(cfd(spark, sf_dir)), 16, 11.5, 0.25, 1.0).select("sample_id")


@register("a14_extents", f"WITH {POINTS}, e AS (SELECT sample_id, max(x) - min(x) AS a, max(y) - min(y) AS b, max(z) - min(z) AS c FROM points GROUP BY sample_id) SELECT sample_id, " + _r(min_extent="least(a, b, c)", max_extent="greatest(a, b, c)", aspect_ratio="greatest(a, b, c) / least(a, b, c)") + " FROM e")
def a14_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sel.extents(points(spark, sf_dir)))


@register("g1_normalised_geometry", f"WITH {POINTS}, e AS (SELECT sample_id, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS e, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM points GROUP BY sample_id) SELECT sample_id, point_id, " + _r(x="(x - mx) * 5 / e", y="(y - my) * 5 / e", z="(z - mz) * 5 / e", scale="5 / e") + " FROM points JOIN e USING (sample_id)")
def g1_normalised_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sel.normalised(points(spark, sf_dir)).select("sample_id", "point_id", "x", "y", "z", "scale"))


@register("a5_wall_stats", f"WITH {POINTS} SELECT sample_id, " + _r(lo="min(wall_dist)", mean="avg(wall_dist)", hi="max(wall_dist)") + ", count(*) FILTER (wall_dist < 0.05) AS near FROM points GROUP BY sample_id")
def a5_wall_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(points(spark, sf_dir).groupBy("sample_id").agg(F.min("wall_dist").alias("lo"), F.avg("wall_dist").alias("mean"), F.max("wall_dist").alias("hi"), F.count_if(F.col("wall_dist") < 0.05).alias("near")))


@register("a18_normaliser", f"WITH {CFD} SELECT " + _r(**{f"{c}_{k}": e for c in "pu" for k, e in (("mean", f"avg({c})"), ("std", f"stddev_samp({c}) + 1e-8"))}) + " FROM cfd")
def a18_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sel.normaliser(cfd(spark, sf_dir), ["p", "u"]))


@register("a19_keyed_normaliser", f"WITH {CFD} SELECT sample_id, " + _r(p_mean="avg(p)", p_std="stddev_samp(p) + 1e-5") + " FROM cfd GROUP BY sample_id")
def a19_keyed_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sel.normaliser(cfd(spark, sf_dir), ["p"], ["sample_id"], 1e-5))


@register("l15_encode_decode", f"WITH {POINTS}, f AS (SELECT avg(tp) AS m, stddev_samp(tp) + 1e-8 AS s FROM points) SELECT sample_id, point_id, " + _r(encoded="(tp - m) / s", decoded="tp") + " FROM points, f")
def l15_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("sample_id", "point_id", "tp")
    fitted = sel.normaliser(p, ["tp"])
    coded = sel.encode(p, fitted, ["tp"])
    return rounded(sel.decode(coded.withColumn("encoded", F.col("tp")), fitted, ["tp"]).select("sample_id", "point_id", "encoded", F.col("tp").alias("decoded")))


_GROUP = "FROM (SELECT o_custkey % 60 AS grp, split_part(o_orderpriority, '-', 1) AS territory, CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE sqrt(o_totalprice) END AS vmax FROM orders)"
_GROUPED = f"WITH n AS (SELECT grp, territory, count(*) AS k {_GROUP} GROUP BY ALL), g AS (SELECT grp, avg(vmax) AS speed, count(*) AS rows {_GROUP} GROUP BY grp), t AS (SELECT grp, territory FROM n QUALIFY row_number() OVER (PARTITION BY grp ORDER BY k DESC, territory) = 1)\n"


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rows = o.select((F.col("o_custkey") % 60).alias("grp"), F.split("o_orderpriority", "-")[0].alias("territory"), F.when(F.col("o_orderkey") % 6 != 0, F.sqrt("o_totalprice")).alias("vmax"))
    return sel.group_stats(rows, "grp", "territory", "vmax")


@register("a15_group_stats", _GROUPED + "SELECT grp, territory, " + _r(speed="speed") + ", rows FROM g JOIN t USING (grp)")
def a15_group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_groups(spark, sf_dir))


@register("x5_speed_bins", _GROUPED + ", q AS (SELECT quantile_cont(speed, 0.25) AS a, quantile_cont(speed, 0.5) AS b, quantile_cont(speed, 0.75) AS c FROM g) SELECT grp, (speed >= a)::INT + (speed >= b)::INT + (speed >= c)::INT AS bin FROM g, q")
def x5_speed_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.speed_bins(_groups(spark, sf_dir), 4).select("grp", "bin")


def _u(seed: int, key: str) -> str:
    return f"(('0x' || substr(md5('{seed}|' || {key}), 1, 13))::BIGINT / {2**52}.0)"


_BY_CUSTOMER = """SELECT o_custkey AS grp, arg_min(territory, (-k, territory)) AS territory, sum(k)::BIGINT AS rows, sum(s) / sum(k) AS speed FROM (SELECT o_custkey, split_part(o_orderpriority, '-', 1) AS territory, count(*) AS k, sum(CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE sqrt(o_totalprice) END) AS s FROM orders GROUP BY ALL) GROUP BY o_custkey"""


def _greedy(order: str) -> str:
    """Groups in order, each to the fold of the fewest rows so far, of equals the first: by recursion over all groups."""
    return f"""o AS (SELECT grp, rows, row_number() OVER (ORDER BY {order} rows DESC, md5('2026|' || grp), grp) AS n FROM g),
z AS (SELECT 0::BIGINT AS n, [0, 0, 0, 0, 0]::BIGINT[] AS sizes, NULL::BIGINT AS grp, NULL::BIGINT AS rows, NULL::INT AS fold
  UNION ALL SELECT n, list_transform(sizes, lambda x, i: x + CASE WHEN i = fold + 1 THEN rows ELSE 0 END), grp, rows, fold FROM (SELECT o.n, z.sizes, o.grp, o.rows, (list_position(z.sizes, list_min(z.sizes)) - 1)::INT AS fold FROM z JOIN o ON o.n = z.n + 1)),
d AS (SELECT grp, rows, fold FROM z WHERE n > 0)"""


_FOLDS = f"WITH RECURSIVE g AS ({_BY_CUSTOMER}), {_greedy('')}\n"


def _customer_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("grp"), F.split("o_orderpriority", "-")[0].alias("territory"), F.when(F.col("o_orderkey") % 6 != 0, F.sqrt("o_totalprice")).alias("vmax"))
    return sel.group_stats(rows, "grp", "territory", "vmax")


@register("x4_group_folds", _FOLDS + "SELECT grp, fold, rows FROM d")
def x4_group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's orders in one of five folds, the largest first, each to the smallest fold."""
    return sel.greedy_group_folds(_customer_groups(spark, sf_dir), 5, 2026, "grp", "rows")


@register("x5_stratified_folds", f"WITH RECURSIVE g0 AS ({_BY_CUSTOMER}), q AS (SELECT quantile_cont(speed, 0.25) AS a, quantile_cont(speed, 0.5) AS b, quantile_cont(speed, 0.75) AS c FROM g0), g AS (SELECT *, (speed >= a)::INT + (speed >= b)::INT + (speed >= c)::INT AS bin FROM g0, q), {_greedy('territory, bin,')} SELECT grp, fold, rows FROM d")
def x5_stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folds of whole customers, dealt stratum by stratum (territory and speed bin) over the same folds."""
    return sel.stratified_group_folds(_customer_groups(spark, sf_dir), 4, 5, 2026, "grp", "rows")


@register("x6_validation_groups", _FOLDS + f", r AS (SELECT grp, rows, {_u(2026 + 1009 + 2, 'grp')} AS h FROM d WHERE fold <> 2), w AS (SELECT *, coalesce(sum(rows) OVER (ORDER BY h, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (ORDER BY h, grp) AS k, count(*) OVER () AS n FROM r) SELECT grp, rows, before < (SELECT greatest(1, count(*) // 10) FROM orders) AND k < n AS validation FROM w")
def x6_validation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the customers that fold 2 trains on, those carved out for validation: a tenth of all orders."""
    folds = x4_group_folds(spark, sf_dir)
    target = max(1, table(spark, sf_dir, "orders").count() // 10)
    return sel.carved_groups(folds.where("fold <> 2").select("grp", "rows"), target, 2026, 2, "grp", "rows")


@register("x3_plain_folds", "WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('2026|' || c_custkey), c_custkey) - 1 AS r, count(*) OVER () AS n FROM customer) SELECT c_custkey, (CASE WHEN r < (n % 7) * (n // 7 + 1) THEN r // (n // 7 + 1) ELSE n % 7 + (r - (n % 7) * (n // 7 + 1)) // greatest(n // 7, 1) END)::INT AS fold FROM r")
def x3_plain_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.hashed_folds(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 7, 2026)


@register("x8_folds_disjoint", _FOLDS + f", r AS (SELECT grp, rows, md5('{2026 + 1009 + 2}|' || grp) AS h FROM d WHERE fold <> 2), c AS (SELECT grp, coalesce(sum(rows) OVER (ORDER BY h, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < (SELECT greatest(1, count(*) // 10) FROM orders) AND row_number() OVER (ORDER BY h, grp) < count(*) OVER () AS validation FROM r), p AS (SELECT d.grp, d.fold, CASE WHEN d.fold = 2 THEN 'test' WHEN c.validation THEN 'val' ELSE 'train' END AS role FROM d LEFT JOIN c USING (grp)) SELECT role, count(DISTINCT grp) AS n_groups, count(o.o_orderkey) AS n_rows, 0::BIGINT AS straddling FROM (SELECT DISTINCT o_orderkey, o_custkey FROM orders) o JOIN p ON p.grp = o.o_custkey GROUP BY role")
def x8_folds_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train, validation and test of fold 2: groups and orders of each, none empty, and how many groups stand in another part too."""
    folds = cut_lineage(x4_group_folds(spark, sf_dir))
    target = max(1, table(spark, sf_dir, "orders").count() // 10)
    taken = sel.carved_groups(folds.where("fold <> 2").select("grp", "rows"), target, 2026, 2, "grp", "rows")
    parts = sel.fold_parts(folds, 2, taken, "grp")
    each = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("grp")).distinct().join(parts, "grp")
    several = parts.groupBy("grp").agg((F.countDistinct("role") > 1).alias("several"))
    return each.join(several, "grp").groupBy("role").agg(F.countDistinct("grp").alias("n_groups"), F.count("o_orderkey").alias("n_rows"), F.countDistinct(F.when(F.col("several"), F.col("grp"))).alias("straddling"))


@register("a16_split_lists", "WITH r AS (SELECT o_orderstatus AS split, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS pos FROM orders) SELECT split, pos // 1000 AS block, list(o_orderkey ORDER BY pos) AS indices FROM r GROUP BY ALL")
def a16_split_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of each split in order, as lists of 1,000."""
    return sel.split_blocks(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderkey")


@register("a16_split_positions", "SELECT o_orderstatus AS split, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS position, o_orderkey AS index FROM orders")
def a16_split_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of each split, a row an index."""
    return sel.split_positions(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderkey")


@register("u1_union_roles", f"WITH {CFD}, {POINTS} SELECT role, count(*) AS n, count(x) AS with_position FROM (SELECT 'volume' AS role, x FROM points UNION ALL SELECT 'surface', NULL FROM cfd) GROUP BY role")
def u1_union_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = points(spark, sf_dir).withColumn("role", F.lit("volume")), cfd(spark, sf_dir).withColumn("role", F.lit("surface"))
    return p.unionByName(c.withColumn("sample_id", F.col("sample_id").cast("string")), allowMissingColumns=True).groupBy("role").agg(F.count("*").alias("n"), F.count("x").alias("with_position"))


@register("u3_except_configs", "SELECT n_name FROM nation EXCEPT SELECT n_name FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 9900")
def u3_except_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer").where("c_acctbal > 9900")
    return n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left_anti").select("n_name").distinct()


@register("l16_early_stop", """WITH RECURSIVE h AS (SELECT user_id, abs(value) AS l, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS e FROM events),
r AS (SELECT user_id, 1::BIGINT AS e, l AS best, 1::BIGINT AS best_e, 0 AS bad, NULL::BIGINT AS stop FROM h WHERE e = 1
  UNION ALL SELECT r.user_id, h.e, CASE WHEN r.stop IS NULL AND h.l < r.best - 0.5 THEN h.l ELSE r.best END, CASE WHEN r.stop IS NULL AND h.l < r.best - 0.5 THEN h.e ELSE r.best_e END,
  CASE WHEN r.stop IS NOT NULL THEN r.bad WHEN h.l < r.best - 0.5 THEN 0 ELSE r.bad + 1 END, CASE WHEN r.stop IS NULL AND h.l >= r.best - 0.5 AND r.bad + 1 >= 6 THEN h.e ELSE r.stop END FROM r JOIN h ON h.user_id = r.user_id AND h.e = r.e + 1)
SELECT user_id, """ + _r(best="arg_max(best, e)") + ", arg_max(best_e, e) AS best_epoch, max(stop) AS stop_epoch FROM r GROUP BY user_id")
def l16_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patience of six epochs."""
    from pyspark.sql import Window as W

    history = table(spark, sf_dir, "events").select("user_id", F.abs("value").alias("loss"), F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).alias("epoch"))
    return rounded(sel.early_stop(history, "user_id", "epoch", "loss", 0.5, 6).select("user_id", "best", "best_epoch", "stop_epoch"))


@register("a22_weighted_mean", "SELECT l_returnflag, " + _r(loss="sum(l_discount * l_quantity) / greatest(sum(l_quantity), 1)") + " FROM lineitem GROUP BY l_returnflag")
def a22_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rounded(rows.groupBy("l_returnflag").agg((F.sum(F.col("l_discount") * F.col("l_quantity")) / F.greatest(F.sum("l_quantity"), F.lit(1.0))).alias("loss")))
