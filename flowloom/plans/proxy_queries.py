"""Frames, proxies and metrics over the canonical points. Checked in a fixed pose; the principal frame by its invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.vectors import vec
from flowloom.operators import frames, metrics, proxies
from flowloom.plans.adapters import POINTS, points, rounded
from flowloom.session import table
from flowloom.plans.registry import ORACLES, register

UVWS = ("sample_id", "point_id", "u", "v", "w", "speed")
UVWC = ("sample_id", "point_id", "u", "v", "w", "scalar")


def framed(spark: SparkSession, sf_dir: str, principal: bool = False) -> DataFrame:
    p = points(spark, sf_dir)
    m = frames.moments(p)
    f = frames.with_frame(p, frames.principal_axes(m) if principal else frames.fixed_axes(m))
    return frames.wall_coordinates(f, frames.axial_scales(f))


BASE = f"""WITH {POINTS},
f AS (SELECT sample_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM points GROUP BY sample_id),
g AS (SELECT p.*, x - cx AS ox, y - cy AS oy, z - cz AS oz FROM points p JOIN f USING (sample_id)),
s AS (SELECT sample_id, min(ox) AS axial_min, CASE WHEN max(ox) - min(ox) >= 1e-8 THEN max(ox) - min(ox) ELSE 1 END AS axial_span, quantile_cont(wall_dist, 0.95) FILTER (wall_dist > 0) AS dist_scale,
  quantile_cont(step, 0.95) FILTER (step > 0) AS step_scale, max(wall_dist) AS dist_max, min(x) AS x_min, max(x) AS x_max FROM g GROUP BY sample_id),
c AS (SELECT *, least(greatest((ox - axial_min) / axial_span, 0), 1) AS axial, least(greatest(wall_dist / dist_scale, 0), 1) AS rho, sqrt(oy * oy + oz * oz) AS rr FROM g JOIN s USING (sample_id)),
q AS (SELECT *, 1 - rho AS wall, sin(pi() * axial) AS phase, CASE WHEN rr >= 1e-8 THEN oy / rr ELSE 1 END AS ry, CASE WHEN rr >= 1e-8 THEN oz / rr ELSE 0 END AS rz,
  2 * rho - rho * rho AS par, 1 - pow(1 - rho, 6) AS plg, exp(-pow((axial - 0.65) / 0.22, 2)) * (1 - rho) AS pocket FROM c),
b AS (SELECT *, least(greatest((0.65 * par + 0.35 * plg) * (0.85 + 0.3 * phase), 0), 1.25) AS acc, 0.7 * par - 0.3 * wall * phase AS dec,
  par * least(greatest(1 + 0.4 * ry, 0.5), 1.5) / sqrt(1 + 0.18 * 0.18) AS skw, 0.28 * rho * wall * phase * ry AS sec, 0.22 * rho * wall * (0.5 + 0.5 * phase) AS swl, par * (1 - 0.7 * pocket) - 0.22 * pocket AS rec FROM q),
m AS (SELECT *, [[par, 0, 0], [plg, 0, 0], [acc, 0, 0], [dec, 0, 0], [skw, 0.18 * skw, 0], [par, 0, sec], [par, -swl * rz, swl * ry], [rec, 0.1 * pocket * ry, 0.1 * pocket * rz]] AS bank FROM b)
"""
_MIX = [0.24, 0.18, 0.16, 0.10, 0.14, 0.08, 0.06, 0.04]


def _mix(weights: list[float] | str, k: int) -> str:
    return " + ".join(f"{w} * bank[{i + 1}][{k}]" for i, w in enumerate(weights))


def _r(**cols: str) -> str:
    return ", ".join(f"round(({v})::DOUBLE, 6) + 0.0 AS {k}" for k, v in cols.items())


@register("a7_moments", f"WITH {POINTS} SELECT sample_id, count(*) AS n, " + _r(**{f"center_{a}": f"avg({a})" for a in "xyz"}, **{f"c{a}{b}": f"covar_samp({a}, {b})" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")}) + " FROM points GROUP BY sample_id")
def a7_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(frames.moments(points(spark, sf_dir)))


@register(
    "v1_principal_frame",
    f"WITH {POINTS}, m AS (SELECT sample_id, covar_samp(x, x) AS xx, covar_samp(x, y) AS xy, covar_samp(x, z) AS xz, covar_samp(y, y) AS yy, covar_samp(y, z) AS yz, covar_samp(z, z) AS zz FROM points GROUP BY sample_id) SELECT sample_id, "
    + _r(trace="xx + yy + zz", determinant="xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)", residual="0.0", skewness="0.0", handedness="1.0") + ", true AS signed FROM m",
)
def v1_principal_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every principal frame must satisfy: C a = l a, an orthonormal right-handed basis, the sign rule."""
    f = frames.principal_axes(frames.moments(points(spark, sf_dir)))
    a, s, n = vec("axis_"), vec("side_"), vec("normal_")
    row = lambda i: vec("c", {"x": ("xx", "xy", "xz"), "y": ("xy", "yy", "yz"), "z": ("xz", "yz", "zz")}[i])
    off = F.sqrt(sum(((row(i).dot(a) - F.col("l1") * F.col(f"axis_{i}")) ** 2 for i in "xyz"), F.lit(0.0)))
    top = F.greatest(*(F.abs(c) for c in a))
    return rounded(f.select(
        "sample_id", (F.col("l1") + F.col("l2") + F.col("l3")).alias("trace"), (F.col("l1") * F.col("l2") * F.col("l3")).alias("determinant"), off.alias("residual"),
        F.greatest(F.abs(a.dot(s)), F.abs(a.dot(n)), F.abs(s.dot(n))).alias("skewness"), a.dot(s.cross(n)).alias("handedness"), (F.greatest(*a) >= top - 1e-12).alias("signed"),
    ))


@register("v2_wall_coordinates", BASE + "SELECT sample_id, point_id, " + _r(axial="axial", rho="rho") + " FROM q")
def v2_wall_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(framed(spark, sf_dir).select("sample_id", "point_id", "axial", "rho"))


@register("a8_axial_scales", BASE + "SELECT sample_id, " + _r(axial_min="axial_min", axial_span="axial_span", dist_scale="dist_scale") + " FROM s")
def a8_axial_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return rounded(frames.axial_scales(frames.with_frame(p, frames.fixed_axes(frames.moments(p)))))


@register("v3_velocity", BASE + "SELECT sample_id, point_id, " + _r(u="par", v="0.0", w="0.0", speed="par") + " FROM q")
def v3_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(proxies.velocity(framed(spark, sf_dir)).select(*UVWS))


@register("v4_full", BASE + "SELECT sample_id, point_id, " + _r(u="par", speed="par", pressure="1 - axial", no_slip="wall", axial="axial") + " FROM q")
def v4_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(proxies.full(framed(spark, sf_dir)).select("sample_id", "point_id", "u", "speed", "pressure", "no_slip", "axial"))


WALK = BASE.rstrip() + """,
w1 AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS dn FROM q),
w2 AS (SELECT *, CASE WHEN dn >= 1e-8 THEN dx / dn ELSE 1 END AS wx, CASE WHEN dn >= 1e-8 THEN dy / dn ELSE 0 END AS wy, CASE WHEN dn >= 1e-8 THEN dz / dn ELSE 0 END AS wz, least(greatest(step / step_scale, 0), 1) AS stp FROM w1),
w3 AS (SELECT *, least(greatest(wx, -1), 1) AS al, sqrt(pow(wx - least(greatest(wx, -1), 1), 2) + wy * wy + wz * wz) AS tn FROM w2),
w4 AS (SELECT *, CASE WHEN tn >= 1e-8 THEN wy / tn ELSE 1 END AS ty, CASE WHEN tn >= 1e-8 THEN wz / tn ELSE 0 END AS tz, least(greatest(ry * wy + rz * wz, -1), 1) AS lw FROM w3),
w5 AS (SELECT *, least(greatest(0.25 + 0.35 * stp + 0.2 * greatest(al, 0), 0.05), 0.85) AS pm, 0.2 + 0.2 * stp AS ts, 0.1 * (1 - abs(al)) * rho * wall AS ss FROM w4),
w6 AS (SELECT *, least(greatest(((1 - pm) * par + pm * plg) * least(greatest(1 + 0.35 * lw, 0.55), 1.45) * least(greatest(1 + 0.22 * al * phase, 0.65), 1.3), 0), 1.35) AS sp, ts * ty - ss * rz AS ay, ts * tz + ss * ry AS az FROM w5),
w7 AS (SELECT *, sp / sqrt(1 + ay * ay + az * az) AS fu, sp * ay / sqrt(1 + ay * ay + az * az) AS fv, sp * az / sqrt(1 + ay * ay + az * az) AS fw, least(greatest(greatest(-al, 0) * phase * wall, 0), 1) AS rv,
  least(greatest(0.45 + 0.25 * stp, 0.25), 0.75) AS k1, least(greatest(0.12 + 0.18 * abs(lw), 0.05), 0.35) AS k2, least(greatest(0.1 + 0.2 * (1 - abs(al)), 0.05), 0.35) AS k3, least(greatest(0.05 + 0.25 * greatest(-al, 0), 0.02), 0.3) AS k4 FROM w6),
w8 AS (SELECT *, 0.22 * rho * wall * phase * lw AS de, 0.2 * rho * wall * (0.5 + 0.5 * stp) AS he, par * (1 - 0.55 * rv) - 0.18 * rv AS ba, k1 + k2 + k3 + k4 AS ks FROM w7),
w9 AS (SELECT *, (k1 * fu + k2 * par + k3 * par + k4 * ba) / ks AS gu, (k1 * fv - k3 * he * rz + k4 * 0.1 * rv * ry) / ks AS gv, (k1 * fw + k2 * de + k3 * he * ry + k4 * 0.1 * rv * rz) / ks AS gw FROM w8)
"""


@register("v5_condition_features", WALK + "SELECT sample_id, point_id, " + _r(walk_x="wx", walk_y="wy", walk_z="wz", alignment="al", across_y="ty", across_z="tz", step_norm="stp") + " FROM w9")
def v5_condition_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(proxies.condition_features(framed(spark, sf_dir)).select("sample_id", "point_id", "walk_x", "walk_y", "walk_z", "alignment", "across_y", "across_z", "step_norm"))


@register("a9_step_scale", BASE + "SELECT sample_id, " + _r(step_scale="step_scale") + " FROM s")
def a9_step_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(points(spark, sf_dir).groupBy("sample_id").agg(frames.p95_scale(F.abs("step")).alias("step_scale")))


@register("v6_conditioned_velocity", WALK + "SELECT sample_id, point_id, " + _r(u="fu", v="fv", w="fw", speed="sqrt(fu * fu + fv * fv + fw * fw)") + " FROM w9")
def v6_conditioned_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(proxies.conditioned_velocity(proxies.condition_features(framed(spark, sf_dir))).select(*UVWS))


@register("v7_conditioned_compact", WALK + "SELECT sample_id, point_id, " + _r(u="gu", v="gv", w="gw", speed="sqrt(gu * gu + gv * gv + gw * gw)") + " FROM w9")
def v7_conditioned_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(proxies.conditioned_compact(proxies.condition_features(framed(spark, sf_dir))).select(*UVWS))


LONG = BASE.rstrip() + ",\nl AS (SELECT *, unnest(range(8)) AS mode FROM m),\nk AS (SELECT sample_id, point_id, mode, bank[mode + 1][1] AS u, bank[mode + 1][2] AS v, bank[mode + 1][3] AS w, wall_dist FROM l)\n"


@register("v8_flow_bank", LONG + "SELECT sample_id, point_id, mode, " + _r(u="u", v="v", w="w", speed="sqrt(u * u + v * v + w * w)") + " FROM k")
def v8_flow_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(proxies.bank_long(framed(spark, sf_dir)))


COMPACT = BASE.rstrip() + f",\nx AS (SELECT *, {_mix(_MIX, 1)} AS u, {_mix(_MIX, 2)} AS v, {_mix(_MIX, 3)} AS w FROM m)\n"


@register("v9_compact", COMPACT + "SELECT sample_id, point_id, " + _r(u="u", v="v", w="w", speed="sqrt(u * u + v * v + w * w)") + " FROM x")
def v9_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(proxies.compact(proxies.bank(framed(spark, sf_dir))).select(*UVWS))


@register("v10_bank_shape", LONG + "SELECT sample_id, count(DISTINCT point_id) AS points, count(*) AS rows_long, bool_and(isfinite(u) AND isfinite(v) AND isfinite(w)) AS finite, " + _r(mean_speed="avg(sqrt(u * u + v * v + w * w))") + " FROM k GROUP BY sample_id")
def v10_bank_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = proxies.bank(framed(spark, sf_dir))
    speed = F.aggregate(F.transform("bank", lambda m: F.sqrt(m["u"] ** 2 + m["v"] ** 2 + m["w"] ** 2)), F.lit(0.0), lambda a, s: a + s)
    fine = F.forall("bank", lambda m: ~F.isnan(m["u"] + m["v"] + m["w"]))
    return rounded(b.groupBy("sample_id").agg(F.countDistinct("point_id").alias("points"), F.sum(F.size("bank")).cast("long").alias("rows_long"), F.bool_and(fine).alias("finite"), (F.sum(speed) / F.sum(F.size("bank"))).alias("mean_speed")))


_COND = [0.3, 0.5, 0.7, 0.9, 0.4, 1.0, 1.0, 0.2, 0.6, 0.5, 0.8, 0.1]
cond = lambda last=0.1: F.array(*(F.lit(c) for c in [*_COND[:11], last]))


@register("v11_legacy_prompt", BASE + "SELECT sample_id, point_id, " + _r(u="0.3", v="0.0", w="0.0", scalar="0.3") + " FROM q")
def v11_legacy_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(proxies.legacy_prompt(framed(spark, sf_dir), F.lit(0.3)).select(*UVWC))


PROMPT = BASE.rstrip() + """,
z AS (SELECT *, 0.7 + 0.25 * 0.9 * 0.4 AS ts, 0.7 * 0.6 / (0.8 + 1e-4) AS pd, least(greatest(wall_dist / greatest(dist_max, 1e-6), 0), 1) AS pr, (x - x_min) / (x_max - x_min + 1e-8) AS fwd, sqrt(nx * nx + ny * ny + nz * nz) AS nn FROM q),
y1 AS (SELECT *, ts * pr + 0.1 * pd * (1 - fwd) - 0.05 * ((1 - pr) + 0.1 * nn) AS sc FROM z)
"""


@register("v12_territory_prompt", PROMPT + "SELECT sample_id, point_id, " + _r(u="ts * pr", v="0.0", w="0.0", scalar="sc") + " FROM y1")
def v12_territory_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(proxies.territory_prompt(framed(spark, sf_dir), cond()).select(*UVWC))


@register("v13_inlet_prompt", PROMPT + "SELECT sample_id, point_id, " + _r(u="0.5 * pr", v="0.0", w="0.0", scalar="0.5 * pr") + " FROM y1")
def v13_inlet_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(proxies.inlet_prompt(framed(spark, sf_dir), F.lit(0.4), F.lit(2.0)).select(*UVWC))


@register("v14_mixed_prompt", PROMPT + "SELECT sample_id, point_id, " + _r(u="CASE WHEN sample_id < 's5' THEN 0.5 ELSE ts * pr END", v="0.0", w="0.0", scalar="CASE WHEN sample_id < 's5' THEN 0.5 ELSE sc END") + " FROM y1")
def v14_mixed_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.when(F.col("sample_id") < "s5", cond(-1.0)).otherwise(cond())
    return rounded(proxies.mixed_prompt(framed(spark, sf_dir), told).select(*UVWC))


@register("v18_prompt_dispatch", PROMPT + "SELECT sample_id, point_id, " + _r(u="CASE WHEN sample_id < 's3' THEN 0.5 ELSE ts * pr END", scalar="CASE WHEN sample_id < 's3' THEN 0.5 ELSE sc END") + " FROM y1")
def v18_prompt_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.when(F.col("sample_id") < "s3", F.slice(cond(), 1, 3)).otherwise(cond())
    return rounded(proxies.mixed_prompt(framed(spark, sf_dir), told).select("sample_id", "point_id", "u", "scalar"))


@register("v15_geometry_prompt", BASE + "SELECT sample_id, point_id, " + _r(u="1.0", v="0.0", w="0.0") + " FROM q")
def v15_geometry_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(framed(spark, sf_dir).select("sample_id", "point_id", *(c.alias(n) for n, c in vec("axis_").named("", "uvw").items())))


@register(
    "v16_centroid_features",
    BASE.rstrip() + ",\nr AS (SELECT *, sqrt(ox * ox + oy * oy + oz * oz) AS r FROM q), t AS (SELECT sample_id, max(r) + 1e-6 AS top FROM r GROUP BY sample_id)\nSELECT sample_id, point_id, "
    + _r(wall_dist="top - r", nx="-ox / (r + 1e-8)", ny="-oy / (r + 1e-8)", nz="-oz / (r + 1e-8)") + " FROM r JOIN t USING (sample_id)",
)
def v16_centroid_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(proxies.centroid_features(points(spark, sf_dir)).select("sample_id", "point_id", "wall_dist", "nx", "ny", "nz"))


TURNED = BASE.rstrip() + ",\nd AS (SELECT sample_id, avg(par) * avg(tu) AS dot FROM m GROUP BY sample_id),\ne AS (SELECT m.*, CASE WHEN dot < 0 THEN -1 ELSE 1 END AS sg FROM m JOIN d USING (sample_id))\n"


@register("v17_aligned_bank", TURNED + "SELECT sample_id, point_id, " + _r(plug_u="sg * bank[2][1]", dean_w="sg * bank[6][3]") + " FROM e")
def v17_aligned_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = proxies.aligned_bank(proxies.bank(framed(spark, sf_dir)))
    return rounded(b.select("sample_id", "point_id", F.get("bank", F.lit(1))["u"].alias("plug_u"), F.get("bank", F.lit(5))["w"].alias("dean_w")))


def alignment_summary(spark: SparkSession, sf_dir: str, principal: bool) -> DataFrame:
    """Parabolic flow and the bank's mean against the truth, per sample, then over the samples of each half of the labels."""
    b = proxies.aligned_bank(proxies.bank(framed(spark, sf_dir, principal)))
    first = F.get("bank", F.lit(0))
    even = proxies.mixed(b, F.array_repeat(F.lit(0.125), 8)).select("sample_id", *"uvw", *(f"t{c}" for c in "uvw"), F.lit("uniform").alias("method"))
    poi = b.select("sample_id", *(first[c].alias(c) for c in "uvw"), *(f"t{c}" for c in "uvw"), F.lit("parabolic").alias("method"))
    both = poi.unionByName(even)
    each = metrics.alignment(both.withColumn("sample_id", F.concat_ws(":", "method", "sample_id")))
    dataset = F.when(F.substring("sample_id", -1, 1) < "5", "low").otherwise("high")
    return metrics.summary(each.withColumn("dataset", F.concat_ws(":", F.split("sample_id", ":")[0], dataset)))


ALIGN = (
    TURNED.rstrip() + f",\na AS (SELECT 'parabolic' AS method, sample_id, sg * bank[1][1] AS u, sg * bank[1][2] AS v, sg * bank[1][3] AS w, tu, tv, tw FROM e UNION ALL SELECT 'uniform', sample_id, "
    + ", ".join(f"sg * ({_mix([0.125] * 8, k)})" for k in (1, 2, 3)) + """, tu, tv, tw FROM e),
h AS (SELECT *, sqrt(u * u + v * v + w * w) AS np, sqrt(tu * tu + tv * tv + tw * tw) AS ng FROM a),
i AS (SELECT method, sample_id, avg((u * tu + v * tv + w * tw) / (np * ng + 1e-6)) AS c_dir, sum(abs(np - ng)) / (sum(ng) + 1e-6) AS c_mag FROM h GROUP BY ALL),
j AS (SELECT method || ':' || CASE WHEN substr(sample_id, -1) < '5' THEN 'low' ELSE 'high' END AS dataset, * FROM i),
o AS (SELECT dataset, avg(c_dir) AS c_dir_mean, stddev_pop(c_dir) AS c_dir_std, avg(c_mag) AS c_mag_mean, stddev_pop(c_mag) AS c_mag_std, count(*) AS n_samples FROM j GROUP BY dataset)
"""
)


@register("l8_alignment", ALIGN + "SELECT method, sample_id, " + _r(c_dir="c_dir", c_mag="c_mag") + " FROM i")
def l8_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = proxies.aligned_bank(proxies.bank(framed(spark, sf_dir)))
    first = F.get("bank", F.lit(0))
    even = proxies.mixed(b, F.array_repeat(F.lit(0.125), 8)).select("sample_id", *"uvw", "tu", "tv", "tw", F.lit("uniform").alias("method"))
    poi = b.select("sample_id", *(first[c].alias(c) for c in "uvw"), "tu", "tv", "tw", F.lit("parabolic").alias("method"))
    each = metrics.alignment(poi.unionByName(even).withColumn("sample_id", F.struct("method", "sample_id")))
    return rounded(each.select("sample_id.method", "sample_id.sample_id", "c_dir", "c_mag"))


@register("a21_alignment_summary", ALIGN + "SELECT dataset, " + _r(c_dir_mean="c_dir_mean", c_dir_std="c_dir_std", c_mag_mean="c_mag_mean", c_mag_std="c_mag_std") + ", n_samples FROM o")
def a21_alignment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(alignment_summary(spark, sf_dir, principal=False))


@register("l9_macro_reduction", ALIGN + ", z1 AS (SELECT split_part(dataset, ':', 1) AS method, avg(c_dir_mean) AS cd, avg(c_mag_mean) AS cm FROM o GROUP BY ALL) SELECT " + _r(c_dir_parabolic="max(cd) FILTER (method = 'parabolic')", c_dir_uniform="max(cd) FILTER (method = 'uniform')", reduction_pct="(max(cm) FILTER (method = 'parabolic') - max(cm) FILTER (method = 'uniform')) / max(cm) FILTER (method = 'parabolic') * 100") + " FROM z1")
def l9_macro_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = alignment_summary(spark, sf_dir, principal=False).withColumn("method", F.split("dataset", ":")[0])
    each = s.groupBy("method").agg(F.avg("c_dir_mean").alias("cd"), F.avg("c_mag_mean").alias("cm"))
    of = lambda c, m: F.max(F.when(F.col("method") == m, F.col(c)))
    return rounded(each.agg(of("cd", "parabolic").alias("c_dir_parabolic"), of("cd", "uniform").alias("c_dir_uniform"), metrics.relative_reduction(of("cm", "parabolic"), of("cm", "uniform"), 0.0).alias("reduction_pct")))


@register("l10_no_slip", COMPACT + "SELECT sample_id, " + _r(no_slip="avg(pow(sqrt(u * u + v * v + w * w) * exp(-greatest(wall_dist, 0) / 0.05), 2))") + " FROM x GROUP BY sample_id")
def l10_no_slip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.no_slip(proxies.compact(proxies.bank(framed(spark, sf_dir)))))


@register("l12_mode_energy", LONG + ", e1 AS (SELECT sample_id, mode, avg(u * u + v * v + w * w) AS e FROM k GROUP BY ALL) SELECT sample_id, " + _r(energy_loss="avg(pow(e - 1, 2))") + " FROM e1 GROUP BY sample_id")
def l12_mode_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.mode_energy(proxies.bank_long(framed(spark, sf_dir))))


@register(
    "l12_mode_orthogonality",
    LONG + """, d1 AS (SELECT a.sample_id, a.mode AS i, b.mode AS j, sum(a.u * b.u + a.v * b.v + a.w * b.w) AS d FROM k a JOIN k b USING (sample_id, point_id) GROUP BY ALL),
c1 AS (SELECT d1.sample_id, pow(d1.d / (sqrt(x1.d) * sqrt(y1.d)), 2) AS c FROM d1 JOIN d1 x1 ON x1.sample_id = d1.sample_id AND x1.i = d1.i AND x1.j = d1.i JOIN d1 y1 ON y1.sample_id = d1.sample_id AND y1.i = d1.j AND y1.j = d1.j WHERE d1.i <> d1.j)
SELECT sample_id, """ + _r(orthogonality="sum(c) / 56") + " FROM c1 GROUP BY sample_id",
)
def l12_mode_orthogonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.mode_orthogonality(proxies.bank(framed(spark, sf_dir))))


def _weights() -> "F.Column":
    """A softmax of eight functions of a point."""
    raised = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.exp(F.col("rho") * i.cast("double") / 4 - F.col("axial")))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


GATE = BASE.rstrip() + ",\nw0 AS (SELECT *, list_transform(range(8), lambda i: exp(rho * i / 4 - axial)) AS raised FROM m),\ngw AS (SELECT *, list_transform(raised, lambda r: r / list_sum(raised)) AS weights FROM w0)\n"
_ENT = "-list_sum(list_transform(weights, lambda t: t * ln(greatest(t, 1e-8))))"


@register("l13_gate_entropy", GATE + "SELECT " + _r(gate_entropy=f"avg({_ENT})", entropy_loss=f"avg(pow({_ENT} - 0.75 * ln(8.0), 2))") + " FROM gw")
def l13_gate_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.gate_statistics(framed(spark, sf_dir).withColumn("weights", _weights())))


@register("l13_mode_weights", GATE + ", u1 AS (SELECT unnest(range(8)) AS mode, unnest(weights) AS weight FROM gw) SELECT mode, " + _r(weight_mean="avg(weight)", weight_std="stddev_samp(weight)") + " FROM u1 GROUP BY mode")
def l13_mode_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.mode_weights(framed(spark, sf_dir).withColumn("weights", _weights())))


@register("m3_mixture", GATE + ", z3 AS (SELECT *, " + ", ".join(f"list_sum(list_transform(range(1, 9), lambda i: weights[i] * bank[i][{k}])) AS {c}" for k, c in ((1, "mu"), (2, "mv"), (3, "mw"))) + " FROM gw) SELECT sample_id, point_id, " + _r(u="mu", v="mv", w="mw", speed="sqrt(mu * mu + mv * mv + mw * mw)") + " FROM z3")
def m3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = proxies.bank(framed(spark, sf_dir)).withColumn("weights", _weights())
    return rounded(proxies.mixed(b, F.col("weights")).select(*UVWS))


_P = "puvw"
METRICS = f"""WITH {POINTS},
d AS (SELECT sample_id, count(*) AS n, {', '.join(f'sum(pow(p{c} - t{c}, 2)) AS d{c}, sum(t{c} * t{c}) AS t{c}' for c in _P)}, avg(abs(sqrt(pu * pu + pv * pv + pw * pw) - sqrt(tu * tu + tv * tv + tw * tw))) AS mag,
  sum(pow(sqrt(pu * pu + pv * pv + pw * pw) - sqrt(tu * tu + tv * tv + tw * tw), 2)) AS dm, sum(tu * tu + tv * tv + tw * tw) AS tm, var_pop(pp - tp) * count(*) AS dpc, var_pop(tp) * count(*) AS tpc FROM points GROUP BY sample_id),
r AS (SELECT *, {', '.join(f'sqrt(d{c}) / (sqrt(t{c}) + 1e-8) AS rel_{c}' for c in _P)}, sqrt(dp + du + dv + dw) / (sqrt(tp + tu + tv + tw) + 1e-8) AS rel, sqrt(du + dv + dw) / (sqrt(tu + tv + tw) + 1e-8) AS vec_rel,
  sqrt(dm) / (sqrt(tm) + 1e-8) AS mag_rel, sqrt(dpc) / (sqrt(tpc) + 1e-8) AS pc_rel FROM d),
a AS (SELECT *, (rel_u + rel_v + rel_w) / 3 AS vel_rel FROM r)
"""


@register(
    "l3_l4_l5_flow_metrics",
    METRICS + "SELECT sample_id, "
    + _r(
        rel="rel", rel_p="rel_p", rel_u="rel_u", rel_v="rel_v", rel_w="rel_w", balanced_rel="(rel_p + rel_u + rel_v + rel_w) / 4", weighted_balanced_rel="(rel_p * 2 + rel_u + rel_v + rel_w) / (5 + 1e-8)", vel_rel="vel_rel", vel_mag_err="mag", vel_vector_rel="vec_rel",
        vel_mag_rel="mag_rel", velocity_balanced_rel="0.5 * (vec_rel + mag_rel)", pressure_rel="rel_p", pressure_center_rel="pc_rel", physics_balanced_rel="(rel_p + pc_rel + vel_rel + 0.5 * mag_rel) / (3.5 + 1e-8)",
    ) + " FROM a",
)
def l3_l4_l5_flow_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.flow_metrics(points(spark, sf_dir), channel_weights=(2.0, 1.0, 1.0, 1.0)))


@register("l5_velocity_only_metrics", METRICS + "SELECT sample_id, " + _r(rel="vec_rel", vel_rel="vel_rel", physics_balanced_rel="0.5 * (vec_rel + mag_rel)") + ", true AS no_pressure FROM a")
def l5_velocity_only_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.flow_metrics(points(spark, sf_dir), pressure=False)
    return rounded(m.select("sample_id", "rel", "vel_rel", "physics_balanced_rel", F.isnan("pressure_rel").alias("no_pressure")))


_PAIRS = [(f"p{c}", f"t{c}") for c in _P]


@register("l1_relative_l2", METRICS + "SELECT sample_id, " + _r(rel_l2="sqrt(dp + du + dv + dw) / greatest(sqrt(tp + tu + tv + tw), 1.1920928955078125e-07)") + " FROM a")
def l1_relative_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.relative_l2(points(spark, sf_dir), _PAIRS))


@register("l1_zero_truth", METRICS + "SELECT sample_id, isfinite(sqrt(dp) / 1.1920928955078125e-07) AS finite FROM a")
def l1_zero_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = points(spark, sf_dir).withColumn("tp", F.lit(0.0))
    m = metrics.relative_l2(zero, [("pp", "tp")])
    return m.select("sample_id", (~F.isnan("rel_l2") & (F.col("rel_l2") < float("inf"))).alias("finite"))


@register("l2_absolute_l2", METRICS + "SELECT sample_id, " + _r(abs_l2="sqrt(dp + du + dv + dw) / (n - 1)") + " FROM a")
def l2_absolute_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.absolute_l2(points(spark, sf_dir), _PAIRS))


@register("l6_training_losses", METRICS + "SELECT " + _r(global_rel="sum(rel)", channel_rel="sum((rel_p + rel_u + rel_v + rel_w) / (4 + 1e-8))", physics_rel="(avg(rel_p) + avg(pc_rel) + avg(vec_rel) + 0.5 * avg(mag_rel)) / (3.5 + 1e-8)", velocity_rel="(avg(vec_rel) + 0.5 * avg(mag_rel)) / (1.5 + 1e-8)") + " FROM a")
def l6_training_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.flow_metrics(points(spark, sf_dir))
    p, c, v, g = 1.0, 1.0, 1.0, 0.5
    return rounded(m.agg(
        F.sum("rel").alias("global_rel"), F.sum("weighted_balanced_rel").alias("channel_rel"),
        ((p * F.avg("pressure_rel") + c * F.avg("pressure_center_rel") + v * F.avg("vel_vector_rel") + g * F.avg("vel_mag_rel")) / (p + c + v + g + 1e-8)).alias("physics_rel"),
        ((v * F.avg("vel_vector_rel") + g * F.avg("vel_mag_rel")) / (v + g + 1e-8)).alias("velocity_rel"),
    ))


@register("l7_dataset_means", METRICS + "SELECT " + _r(rel="avg(rel)", vel_rel="avg(vel_rel)", pressure_center_rel="avg(pc_rel)", vel_mag_err="avg(mag)") + ", count(*) AS n FROM a")
def l7_dataset_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.flow_metrics(points(spark, sf_dir))
    return rounded(m.agg(*(F.avg(c).alias(c) for c in ("rel", "vel_rel", "pressure_center_rel", "vel_mag_err")), F.count("*").alias("n")))


@register("l14_combined_loss", "SELECT l_orderkey, count(*) AS n, " + _r(loss="sum(l_quantity + 0.25 * (l_tax + l_discount * l_linenumber))") + " FROM lineitem GROUP BY l_orderkey")
def l14_combined_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of every line's terms, summed by order."""
    loss = metrics.combined_loss(F.col("l_quantity"), F.col("l_tax"), F.col("l_discount"), F.col("l_linenumber"), 0.25)
    return rounded(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(loss).alias("loss")))


@register(
    "l11_divergence",
    COMPACT + """, r0 AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY md5('0|' || point_id), point_id) AS r FROM x),
n0 AS (SELECT * FROM r0 WHERE r <= 256),
p0 AS (SELECT a.sample_id, a.point_id AS i, b.point_id AS j, b.x - a.x AS px, b.y - a.y AS py, b.z - a.z AS pz, b.u - a.u AS qx, b.v - a.v AS qy, b.w - a.w AS qz, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + pow(b.z - a.z, 2)) AS dist FROM n0 a JOIN n0 b USING (sample_id)),
k0 AS (SELECT *, row_number() OVER (PARTITION BY sample_id, i ORDER BY dist, j) AS kk FROM p0),
k1 AS (SELECT *, exp(-dist / greatest(avg(dist) OVER (PARTITION BY sample_id, i), 1e-4)) AS kern FROM k0 WHERE kk BETWEEN 2 AND 9),
s0 AS (SELECT sample_id, i, """
    + ", ".join(f"sum(kern * p{a} * p{b}){' + 1e-4' if a == b else ''} AS c{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")) + ", " + ", ".join(f"sum(kern * q{a} * p{b}) AS m{a}{b}" for a in "xyz" for b in "xyz")
    + """ FROM k1 GROUP BY sample_id, i),
d0 AS (SELECT sample_id, (mxx * (cyy * czz - cyz * cyz) + myy * (cxx * czz - cxz * cxz) + mzz * (cxx * cyy - cxy * cxy) + (mxy + myx) * (cxz * cyz - cxy * czz) + (mxz + mzx) * (cxy * cyz - cxz * cyy) + (myz + mzy) * (cxy * cxz - cxx * cyz))
  / (cxx * (cyy * czz - cyz * cyz) + cxy * (cxz * cyz - cxy * czz) + cxz * (cxy * cyz - cxz * cyy)) AS d FROM s0)
SELECT sample_id, """ + _r(divergence="avg(d * d)") + " FROM d0 GROUP BY sample_id",
)
def l11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points go to the operator, which takes its own subset of 256 for each sample by a hash that SQL can name."""
    return rounded(metrics.divergence(proxies.compact(proxies.bank(framed(spark, sf_dir)))))


#: The name under which all points were first compared; the same query as l11_divergence since that reads all points too.
register("l11_divergence_all_points", ORACLES["l11_divergence"])(l11_divergence)
