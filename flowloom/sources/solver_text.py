"""Solver settings, inflow curves and resistance blocks, from lines of text (file, line number, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Settings that are read, their column and their default.
SETTINGS = {"density": ("density", 1.06), "viscosity": ("viscosity", 0.04), "time step size": ("time_step_size", 0.0), "number of timesteps": ("n_timesteps", 0.0)}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line, value of text files, in the order of the lines."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), "value")
    return rows.select("file", F.row_number().over(W.partitionBy("file").orderBy("b", "i")).alias("line"), "value")


def solver_settings(lines: DataFrame) -> DataFrame:
    """Per file: density, viscosity, time_step_size, n_timesteps. The last readable line of a setting wins; defaults fill in."""
    named = lines.where(F.contains("value", F.lit(":"))).select("file", "line", F.lower(F.trim(F.split("value", ":", 2)[0])).alias("k"), F.get(F.split(F.trim(F.split("value", ":", 2)[1]), r"\s+"), F.lit(0)).try_cast("double").alias("x")).where("x is not null")
    found = named.groupBy("file").agg(*(F.max_by(F.when(F.col("k") == k, F.col("x")), F.when(F.col("k") == k, F.col("line"))).alias(c) for k, (c, _) in SETTINGS.items()))
    every = lines.select("file").distinct().join(found, "file", "left")
    return every.select("file", *(F.coalesce(c, F.lit(d)).alias(c) for c, d in SETTINGS.values()))


def inflow_summary(curve: DataFrame, key: str = "file", flow: str = "flow") -> DataFrame:
    """Per file: mean, root mean square, peak and deviation of a flow curve, its pulsatility and length."""
    c = F.col(flow)
    s = curve.groupBy(key).agg(F.avg(F.abs(c)).alias("flow_mean_abs"), F.sqrt(F.avg(c * c)).alias("flow_rms_abs"), F.max(F.abs(c)).alias("flow_peak_abs"), F.stddev_pop(c).alias("flow_std_abs"), F.count(c).alias("flow_n"))
    return s.withColumn("flow_pulsatility", F.col("flow_std_abs") / (F.col("flow_mean_abs") + 1e-8))


def resistance_blocks(lines: DataFrame) -> DataFrame:
    """Per file: rcr_count, mean and deviation of rp + rd, mean capacitance, over blocks whose three values are positive.

    A block is a number n, three single values (rp, c, rd) and n lines of two numbers or more. Its lines depend on those
    before it, so each file's few lines are folded in order.
    """
    numbers = F.transform(F.filter(F.split(F.btrim("value", F.lit(" \t\r")), r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    rows = lines.withColumn("f", numbers).where((F.size("f") > 0) & F.forall("f", lambda x: x.isNotNull()))
    files = rows.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "f"))), lambda r: r["f"]).alias("r"))
    n = F.size("r")
    single = lambda i: F.size(F.get("r", i)) == 1
    head = lambda i, k: F.get(F.get("r", i + k), F.lit(0))

    def step(a: Column, i: Column) -> Column:
        curve = F.when(single(i), F.round(F.get(F.get("r", i), F.lit(0))).cast("int")).otherwise(0)
        whole = (i >= a["next"]) & single(i) & (curve >= 1) & (i + 3 + curve < n) & single(i + 1) & single(i + 2) & single(i + 3) & F.forall(F.slice("r", i + 5, F.greatest(curve, F.lit(1))), lambda x: F.size(x) >= 2)
        block = F.struct(head(i, 1).alias("rp"), head(i, 2).alias("c"), head(i, 3).alias("rd"))
        good = whole & (block["rp"] > 0) & (block["c"] > 0) & (block["rd"] > 0)
        return F.struct(F.when(whole, i + 4 + curve).otherwise(a["next"]).alias("next"), F.when(good, F.array_append(a["out"], block)).otherwise(a["out"]).alias("out"))

    first = F.when(single(F.lit(0)) & (F.get(F.get("r", F.lit(0)), F.lit(0)) >= 1), 1).otherwise(0)
    zero = F.struct(first.alias("next"), F.array().cast("array<struct<rp:double,c:double,rd:double>>").alias("out"))
    found = files.select("file", F.aggregate(F.sequence(F.lit(0), n - 1), zero, step, lambda a: a["out"]).alias("blocks"))
    each = found.select("file", F.explode_outer("blocks").alias("b"))
    total = F.col("b.rp") + F.col("b.rd")
    some = each.groupBy("file").agg(F.count("b").alias("rcr_count"), F.coalesce(F.avg(total), F.lit(0.0)).alias("rcr_resistance_mean"), F.coalesce(F.stddev_pop(total), F.lit(0.0)).alias("rcr_resistance_std"), F.coalesce(F.avg("b.c"), F.lit(0.0)).alias("rcr_capacitance_mean"))
    return lines.select("file").distinct().join(some, "file", "left").na.fill(0)


def with_solver_texts(cases: DataFrame, settings: DataFrame, inflows: DataFrame, resistances: DataFrame, solver: str = "solver_inp", inflow: str = "inflow_flow", resistance: str = "rcrt_dat") -> DataFrame:
    """``cases`` with what their three texts say: solver settings, inflow summary, resistance summary, each by the file that the case names.

    Every case stays: one that names no file, or one that isn't there, has the settings' defaults and zeros.
    """
    defaults = dict(SETTINGS.values()) | dict.fromkeys([c for t in (inflows, resistances) for c in t.columns if c != "file"], 0.0)
    out = cases
    for column, told in ((solver, settings), (inflow, inflows), (resistance, resistances)):
        out = out.join(told.withColumnRenamed("file", f"__{column}"), F.col(column) == F.col(f"__{column}"), "left").drop(f"__{column}")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(d).cast(out.schema[c].dataType)) for c, d in defaults.items()})


def territory_condition(rows: DataFrame, target_length: float = 5.0) -> DataFrame:
    """Adds cond: the twelve channels of a case, from its family id share, flow, solver, resistance, scale and restart columns."""
    c = F.col
    log = lambda x, d: F.log1p(x) / d
    channels = [
        c("family_norm"), log(c("flow_mean_abs"), 6.0), log(c("flow_rms_abs"), 6.0), log(c("flow_peak_abs"), 7.0), F.least(c("flow_pulsatility"), F.lit(5.0)) / 5.0, c("viscosity") / 0.04, c("density") / 1.06,
        c("rcr_count") / 10.0, log(c("rcr_resistance_mean"), 12.0), -F.log10(F.greatest(c("rcr_capacitance_mean"), F.lit(1e-12))) / 12.0, log(F.lit(target_length) / F.greatest(c("scale"), F.lit(1e-12)), 10.0), log(F.greatest(c("restart_step").cast("double"), F.lit(0.0)), 10.0),
    ]
    return rows.withColumn("cond", F.array(*(x.cast("double") for x in channels)))


def inlet_condition(rows: DataFrame, target_length: float = 5.0) -> DataFrame:
    """Adds cond: the twelve channels of a case described by its inlet; a case id that isn't a number counts as 0."""
    c = F.col
    channels = [
        F.lit(4.0), c("m_value"), c("m_value") / 0.004, c("inlet_mean"), c("inlet_max"), F.log1p(c("inlet_flow")) / 12.0, F.coalesce(c("case_id").cast("string").try_cast("double") / 120.0, F.lit(0.0)),
        F.log1p(c("n_points")) / 12.0, F.log1p(F.lit(target_length) / F.greatest(c("scale"), F.lit(1e-12))) / 10.0, F.lit(0.0), F.lit(0.0), F.lit(1.0),
    ]
    return rows.withColumn("cond", F.array(*(x.cast("double") for x in channels)))


def widened_condition(cond: Column, sentinel: float = -1.0) -> Column:
    """A short condition padded with zeros to twelve channels, the last one the sentinel; longer ones as they are."""
    return F.when(F.size(cond) >= 12, cond).otherwise(F.concat(cond, F.array_repeat(F.lit(0.0), F.lit(11) - F.size(cond)), F.array(F.lit(sentinel))))
