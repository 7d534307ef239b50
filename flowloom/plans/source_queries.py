"""Parsing, conditions, walks and write decisions, on values from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.plans.adapters import POINTS, points, rounded
from flowloom.plans.registry import register
from flowloom.session import table
from flowloom.sources import sinks, solver_text


def _r(**cols: str) -> str:
    return ", ".join(f"round(({v})::DOUBLE, 6) + 0.0 AS {k}" for k, v in cols.items())


@register("s14_inflow_summary", "SELECT user_id, count(value) AS flow_n, " + _r(flow_mean_abs="avg(abs(value))", flow_rms_abs="sqrt(avg(value * value))", flow_peak_abs="max(abs(value))", flow_std_abs="stddev_pop(value)", flow_pulsatility="stddev_pop(value) / (avg(abs(value)) + 1e-8)") + " FROM events GROUP BY user_id")
def s14_inflow_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(solver_text.inflow_summary(table(spark, sf_dir, "events"), "user_id", "value"))


@register("s13_solver_settings", "SELECT s_suppkey AS file, " + _r(density="CASE WHEN s_suppkey % 3 = 0 THEN 1.06 ELSE 1 + s_suppkey % 7 / 10 END", viscosity="0.04", time_step_size="s_suppkey % 5 / 100", n_timesteps="0") + " FROM supplier")
def s13_solver_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.array(F.when(F.col("s_suppkey") % 3 == 0, F.lit("no colon here")).otherwise(F.concat(F.lit("Density : "), (1 + F.col("s_suppkey") % 7 / 10).cast("string"), F.lit(" g"))), F.lit("viscosity: none"), F.concat(F.lit("Time Step Size:"), (F.col("s_suppkey") % 5 / 100).cast("string")))
    lines = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"), F.posexplode(text).alias("line", "value"))
    return rounded(solver_text.solver_settings(lines))


@register("s15_resistance_blocks", "SELECT s_suppkey AS file, CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 2 END::BIGINT AS rcr_count, " + _r(rcr_resistance_mean="CASE WHEN s_suppkey % 4 = 0 THEN 30 ELSE 20 END", rcr_resistance_std="CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE 10 END", rcr_capacitance_mean="CASE WHEN s_suppkey % 4 = 0 THEN 0.5 ELSE 0.3 END") + " FROM supplier")
def s15_resistance_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two blocks for each supplier; in every fourth the second one has a negative value."""
    last = F.when(F.col("s_suppkey") % 4 == 0, F.lit("-0.1")).otherwise("0.1")
    text = F.array(*map(F.lit, ("2", "2", "10", "0.5", "20", "0 1", "1 1", "1", "5")), last, F.lit("5"), F.lit("0 0"))
    lines = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"), F.posexplode(text).alias("line", "value"))
    return rounded(solver_text.resistance_blocks(lines))


@register("j9_solver_texts", "WITH i AS (SELECT user_id, avg(abs(value)) AS m, stddev_pop(value) / (avg(abs(value)) + 1e-8) AS p, count(value) AS n FROM events GROUP BY user_id), c AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 150 END AS s, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS f, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 130 END AS r, (SELECT max(s_suppkey) FROM supplier) AS top FROM customer) SELECT c_custkey, " + _r(density="CASE WHEN s BETWEEN 1 AND top AND s % 3 <> 0 THEN 1 + s % 7 / 10 ELSE 1.06 END", viscosity="0.04", time_step_size="CASE WHEN s BETWEEN 1 AND top THEN s % 5 / 100 ELSE 0 END", flow_mean_abs="coalesce(m, 0)", flow_pulsatility="coalesce(p, 0)", rcr_resistance_mean="CASE WHEN r IS NULL OR r NOT BETWEEN 1 AND top THEN 0 WHEN r % 4 = 0 THEN 30 ELSE 20 END") + ", coalesce(n, 0) AS flow_n, CASE WHEN r IS NULL OR r NOT BETWEEN 1 AND top THEN 0 WHEN r % 4 = 0 THEN 1 ELSE 2 END::BIGINT AS rcr_count FROM c LEFT JOIN i ON i.user_id = c.f")
def j9_solver_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cases whose texts are suppliers' settings and resistances and users' inflows; many name none, or one that isn't there."""
    k = F.col("c_custkey")
    cases = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 2 == 0, k % 150).alias("solver_inp"), F.when(k % 3 != 0, k).alias("inflow_flow"), F.when(k % 5 != 0, k % 130).alias("rcrt_dat"))
    inflows = solver_text.inflow_summary(table(spark, sf_dir, "events"), "user_id", "value").withColumnRenamed("user_id", "file")
    told = solver_text.with_solver_texts(cases, s13_solver_settings(spark, sf_dir), inflows, s15_resistance_blocks(spark, sf_dir))
    return rounded(told.select("c_custkey", "density", "viscosity", "time_step_size", "flow_mean_abs", "flow_pulsatility", "flow_n", "rcr_count", "rcr_resistance_mean"))


_CASE = "SELECT p_partkey, p_size / 50 AS fam, p_retailprice AS q, p_size * 1.0 AS s FROM part"


@register("f11_territory_condition", f"WITH c AS ({_CASE}) SELECT p_partkey, " + _r(c0="fam", c1="ln(1 + q) / 6", c3="ln(1 + 2 * q) / 7", c4="least(s / 4, 5) / 5", c5="0.05 / 0.04", c7="0.3", c8="ln(1 + q * 3) / 12", c9="-log10(greatest(fam, 1e-12)) / 12", c10="ln(1 + 5 / greatest(s, 1e-12)) / 10", c11="ln(1 + greatest(s - 10, 0)) / 10") + ", 12 AS width FROM c")
def f11_territory_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 50).alias("fam"), F.col("p_retailprice").alias("q"), (F.col("p_size") * 1.0).cast("double").alias("s"))
    rows = c.select("p_partkey", F.col("fam").alias("family_norm"), F.col("q").alias("flow_mean_abs"), F.col("q").alias("flow_rms_abs"), (2 * F.col("q")).alias("flow_peak_abs"), (F.col("s") / 4).alias("flow_pulsatility"), F.lit(0.05).alias("viscosity"), F.lit(1.06).alias("density"), F.lit(3).alias("rcr_count"), (3 * F.col("q")).alias("rcr_resistance_mean"), F.col("fam").alias("rcr_capacitance_mean"), F.col("s").alias("scale"), (F.col("s") - 10).alias("restart_step"))
    told = solver_text.territory_condition(rows)
    return rounded(told.select("p_partkey", *(F.get("cond", F.lit(i)).alias(f"c{i}") for i in (0, 1, 3, 4, 5, 7, 8, 9, 10, 11)), F.size("cond").alias("width")))


@register("f12_inlet_condition", f"WITH c AS ({_CASE}) SELECT p_partkey, " + _r(c0="4", c1="fam", c2="fam / 0.004", c3="q", c4="2 * q", c5="ln(1 + 3 * q) / 12", c6="CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_partkey / 120 END", c7="ln(1 + s) / 12", c8="ln(1 + 5 / greatest(s, 1e-12)) / 10", c11="1") + " FROM c")
def f12_inlet_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 50).alias("m_value"), F.col("p_retailprice").alias("inlet_mean"), (2 * F.col("p_retailprice")).alias("inlet_max"), (3 * F.col("p_retailprice")).alias("inlet_flow"), F.when(F.col("p_partkey") % 5 == 0, F.lit("none")).otherwise(F.col("p_partkey").cast("string")).alias("case_id"), F.col("p_size").alias("n_points"), F.col("p_size").cast("double").alias("scale"))
    return rounded(solver_text.inlet_condition(c).select("p_partkey", *(F.get("cond", F.lit(i)).alias(f"c{i}") for i in (0, 1, 2, 3, 4, 5, 6, 7, 8, 11))))


@register("s2_widened_condition", "SELECT p_partkey, " + _r(c1="p_retailprice", last="CASE WHEN p_size % 2 = 0 THEN -1 ELSE 0.5 END") + ", 12 AS width FROM part")
def s2_widened_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("p_retailprice")
    short = F.array(F.lit(1.0), price, F.lit(0.0035))
    cond = solver_text.widened_condition(F.when(F.col("p_size") % 2 == 0, short).otherwise(F.concat(short, F.array_repeat(F.lit(0.5), 9))))
    return rounded(table(spark, sf_dir, "part").select("p_partkey", F.get(cond, F.lit(1)).alias("c1"), F.element_at(cond, -1).alias("last"), F.size(cond).alias("width")))


@register("k3_stale_outputs", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'walks' WHEN o_orderkey % 5 = 0 THEN 'sigma' END AS why FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0")
def k3_stale_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit("19")).otherwise("20").alias("found_walks"), F.when(F.col("o_orderkey") % 5 == 0, 0.06).otherwise(0.05 + 1e-10).alias("found_sigma"))
    return found.select("o_orderkey", sinks.stale_reason({"walks": F.lit(20), "sigma": F.lit(0.05)}).alias("why")).where("why is not null")


@register("k3_still_to_do", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def k3_still_to_do(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("s"))
    return sinks.still_to_do(table(spark, sf_dir, "customer").select("c_custkey"), done, "c_custkey", F.when(F.col("s") != "F", F.lit("open")))


@register("k2_qc_upsert", "SELECT c_custkey, o.status AS qc_status FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS status FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey")
def k2_qc_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    qc = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderpriority").alias("status"), F.lit("").alias("reasons"))
    return sinks.with_qc(table(spark, sf_dir, "customer"), qc, "c_custkey").select("c_custkey", "qc_status")


@register("s3_s5_walk_samples", f"WITH {POINTS} SELECT sample_id, point_id, " + _r(first="dx * step", last="dz * 2 * step") + ", 6 AS width FROM points WHERE point_id % 4 = 1")
def s3_s5_walk_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points joined with one walk's rows by sample and point, its displacements cut to two steps."""
    p = points(spark, sf_dir)
    walks = p.select("sample_id", "point_id", (F.col("point_id") % 4).alias("walk_idx"), F.array(*(F.col(f"d{c}") * (k + 1) * F.col("step") for k in range(3) for c in "xyz")).alias("disp"))
    one = walks.where("walk_idx = 1").withColumn("disp", F.slice("disp", 1, 6))
    return rounded(p.select("sample_id", "point_id", "x").join(one, ["sample_id", "point_id"]).select("sample_id", "point_id", F.get("disp", F.lit(0)).alias("first"), F.element_at("disp", -1).alias("last"), F.size("disp").alias("width")))


@register("p3_wall_ablation", f"WITH {POINTS} SELECT sample_id, count(*) AS n, count(*) FILTER (point_id % 2 = 0) AS zeroed FROM points GROUP BY sample_id")
def p3_wall_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    off = F.col("point_id") % 2 == 0
    zero = p.withColumns({c: F.when(off, 0.0).otherwise(F.col(c)) for c in ("wall_dist", "nx", "ny", "nz")})
    return zero.groupBy("sample_id").agg(F.count("*").alias("n"), F.count_if((F.col("wall_dist") == 0) & (F.col("nx") == 0) & (F.col("ny") == 0)).alias("zeroed"))


@register("s21_boundary_speed", "SELECT s_suppkey, " + _r(mean="coalesce(a.m, 0)", top="coalesce(a.t, 0)", flow="coalesce(a.m * a.n, 0)") + " FROM supplier LEFT JOIN (SELECT l_suppkey, avg(l_quantity * sqrt(2)) AS m, max(l_quantity * sqrt(2)) AS t, count(*) AS n FROM lineitem WHERE l_linenumber = 7 GROUP BY l_suppkey) a ON s_suppkey = l_suppkey")
def s21_boundary_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, maximum and mean times count of inlet speeds; zeros for a case without an inlet."""
    speed = F.col("l_quantity") * F.sqrt(F.lit(2.0))
    inlet = table(spark, sf_dir, "lineitem").where("l_linenumber = 7").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.avg(speed).alias("mean"), F.max(speed).alias("top"), (F.avg(speed) * F.count("*")).alias("flow"))
    return rounded(table(spark, sf_dir, "supplier").select("s_suppkey").join(inlet, "s_suppkey", "left").na.fill(0.0))


@register("j7_order_by_global_id", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS row_id FROM events")
def j7_order_by_global_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position of each mesh point among its sample's global ids, which is its row in the solution."""
    from pyspark.sql import Window as W

    return table(spark, sf_dir, "events").select("event_id", (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("row_id"))


@register("f16_json_meta", "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE try_cast(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def f16_json_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of a JSON text by schema; a corrupt text (here every tenth) gives null."""
    text = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.from_json(text, "k long").getField("k").alias("k"))


@register("f15_reshape", f"WITH {POINTS} SELECT sample_id, point_id, " + _r(mid="2 * dy * step", total="6 * (dx + dy + dz) * step") + " FROM points")
def f15_reshape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine flat displacements as three of three: the middle one's y, and the sum of all."""
    flat = F.array(*(F.col(f"d{c}") * (k + 1) * F.col("step") for k in range(3) for c in "xyz"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.slice("flat", i * 3 + 1, 3))
    rows = points(spark, sf_dir).withColumn("flat", flat).withColumn("steps", steps)
    total = F.aggregate(F.flatten("steps"), F.lit(0.0), lambda a, x: a + x)
    return rounded(rows.select("sample_id", "point_id", F.get(F.get("steps", F.lit(1)), F.lit(1)).alias("mid"), total.alias("total")))
