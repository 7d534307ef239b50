"""Error and alignment metrics of predicted flows, as aggregations over one row per (sample, point)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.draws import key_hash
from flowloom.functions.vectors import vec

EPS32 = 1.1920928955078125e-07  # the machine epsilon of 32-bit floats


def _l2(*squares: Column) -> Column:
    return F.sqrt(F.sum(sum(squares[1:], squares[0])))


def relative_l2(df: DataFrame, pairs: list[tuple[str, str]], key: str = "sample_id") -> DataFrame:
    """Per sample: |prediction - truth| / max(|truth|, eps) over all points and channels; finite for a zero truth."""
    diff = _l2(*((F.col(p) - F.col(t)) ** 2 for p, t in pairs))
    return df.groupBy(key).agg((diff / F.greatest(_l2(*(F.col(t) ** 2 for _, t in pairs)), F.lit(EPS32))).alias("rel_l2"))


def absolute_l2(df: DataFrame, pairs: list[tuple[str, str]], d: int = 2, p: int = 2, key: str = "sample_id") -> DataFrame:
    """Per sample: h**(d/p) |prediction - truth| with h = 1 / (points - 1); null for a single point."""
    h = F.try_divide(F.lit(1.0), F.count("*") - 1)
    return df.groupBy(key).agg((F.pow(h, F.lit(d / p)) * _l2(*((F.col(a) - F.col(b)) ** 2 for a, b in pairs))).alias("abs_l2"))


def flow_metrics(df: DataFrame, key: str = "sample_id", channel_weights: tuple[float, ...] = (1.0, 1.0, 1.0, 1.0), physics_weights: tuple[float, ...] = (1.0, 1.0, 1.0, 0.5), pressure: bool = True) -> DataFrame:
    """All per-sample metrics of predicted (pp, pu, pv, pw) against true (tp, tu, tv, tw), in one aggregation.

    Without pressure, its metrics are NaN and the physics mean is the velocity mean.
    """
    eps, names = 1e-8, "puvw" if pressure else "uvw"
    diff = {c: F.col(f"p{c}") - F.col(f"t{c}") for c in names}
    pred, true = vec("p", "uvw").norm(), vec("t", "uvw").norm()
    sums = {f"d{c}": F.sum(diff[c] ** 2) for c in names} | {f"t{c}": F.sum(F.col(f"t{c}") ** 2) for c in names}
    sums |= {"mag": F.avg(F.abs(pred - true)), "dm": F.sum((pred - true) ** 2), "tm": F.sum(true**2)}
    if pressure:
        sums |= {"dpc": F.count("*") * F.var_pop(diff["p"]), "tpc": F.count("*") * F.var_pop(F.col("tp"))}
    s = df.groupBy(key).agg(*(v.alias(f"s_{k}") for k, v in sums.items()))
    ratio = lambda a, b: F.sqrt(a) / (F.sqrt(b) + eps)
    col = lambda n: F.col(f"s_{n}")
    split = {c: ratio(col(f"d{c}"), col(f"t{c}")) for c in names}
    total = lambda kind, cs: sum((col(f"{kind}{c}") for c in cs[1:]), col(f"{kind}{cs[0]}"))
    weights = dict(zip(names, channel_weights[-len(names) :], strict=True))
    out = {
        "rel": ratio(total("d", names), total("t", names)),
        **{f"rel_{c}": v for c, v in split.items()},
        "balanced_rel": sum(split.values(), F.lit(0.0)) / len(names),
        "weighted_balanced_rel": sum((split[c] * w for c, w in weights.items()), F.lit(0.0)) / (sum(weights.values()) + eps),
        "vel_rel": (split["u"] + split["v"] + split["w"]) / 3,
        "vel_mag_err": col("mag"),
        "vel_vector_rel": ratio(total("d", "uvw"), total("t", "uvw")),
        "vel_mag_rel": ratio(col("dm"), col("tm")),
    }
    out["velocity_balanced_rel"] = 0.5 * (out["vel_vector_rel"] + out["vel_mag_rel"])
    if pressure:
        out |= {"pressure_rel": split["p"], "pressure_center_rel": ratio(col("dpc"), col("tpc"))}
        terms = (out["pressure_rel"], out["pressure_center_rel"], out["vel_rel"], out["vel_mag_rel"])
        out["physics_balanced_rel"] = sum((t * w for t, w in zip(terms, physics_weights, strict=True)), F.lit(0.0)) / (sum(physics_weights) + eps)
    else:
        out |= {"pressure_rel": F.lit(float("nan")), "pressure_center_rel": F.lit(float("nan")), "physics_balanced_rel": out["velocity_balanced_rel"]}
    return s.select(key, *(v.alias(k) for k, v in out.items()))


def training_loss(metrics: DataFrame, mode: str, physics_weights: tuple[float, ...] = (1.0, 1.0, 1.0, 0.5)) -> DataFrame:
    """One row: the batch's loss by ``mode`` (global, channel, physics or velocity), from ``flow_metrics`` rows.

    Unlike the metric of the same name, the physics loss takes the velocity's vector error, not its components' mean.
    """
    p, c, v, m = physics_weights
    if mode == "global":
        loss = F.sum("rel")
    elif mode == "channel":
        loss = F.sum("weighted_balanced_rel")
    elif mode == "physics":
        loss = (p * F.avg("pressure_rel") + c * F.avg("pressure_center_rel") + v * F.avg("vel_vector_rel") + m * F.avg("vel_mag_rel")) / (p + c + v + m + 1e-8)
    elif mode == "velocity":
        loss = (v * F.avg("vel_vector_rel") + m * F.avg("vel_mag_rel")) / (v + m + 1e-8)
    else:
        raise ValueError(f"unknown mode {mode}")
    return metrics.agg(loss.alias("loss"))


def alignment(df: DataFrame, pred: str = "", truth: str = "t", key: str = "sample_id") -> DataFrame:
    """Per sample: c_dir, the mean cosine, and c_mag, the relative error of speeds."""
    u, g = vec(pred, "uvw"), vec(truth, "uvw")
    return df.groupBy(key).agg(F.avg(u.dot(g) / (u.norm() * g.norm() + 1e-6)).alias("c_dir"), (F.sum(F.abs(u.norm() - g.norm())) / (F.sum(g.norm()) + 1e-6)).alias("c_mag"))


def summary(aligned: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Mean and population deviation over the samples of each dataset."""
    return aligned.groupBy(dataset).agg(*(f(m).alias(f"{m}_{n}") for m in ("c_dir", "c_mag") for n, f in (("mean", F.avg), ("std", F.stddev_pop))), F.count("*").alias("n_samples"))


def macro(summaries: DataFrame) -> DataFrame:
    """The unweighted mean of the datasets' means."""
    return summaries.agg(F.avg("c_dir_mean").alias("c_dir_mean"), F.avg("c_mag_mean").alias("c_mag_mean"))


def relative_reduction(base: Column, ours: Column, eps: float = 1e-8) -> Column:
    """Percent by which ``ours`` is below ``base``; null where ``base`` + ``eps`` is 0."""
    return F.try_divide(base - ours, base + eps) * 100.0


def no_slip(df: DataFrame, key: str = "sample_id", decay: float = 0.05) -> DataFrame:
    """Mean square of the speed weighted by nearness to the wall."""
    near = F.exp(-F.greatest(F.col("wall_dist"), F.lit(0.0)) / decay)
    return df.groupBy(key).agg(F.avg((vec("", "uvw").norm() * near) ** 2).alias("no_slip"))


def mode_energy(modes: DataFrame, target: float = 1.0, key: str = "sample_id") -> DataFrame:
    """Per sample: the mean over modes of (mean square speed - target)**2."""
    energy = modes.groupBy(key, "mode").agg(F.avg(vec("", "uvw").dot(vec("", "uvw"))).alias("e"))
    return energy.groupBy(key).agg(F.avg((F.col("e") - target) ** 2).alias("energy_loss"))


def mode_orthogonality(banked: DataFrame, n_modes: int = 8, key: str = "sample_id") -> DataFrame:
    """Per sample: the mean square cosine of all pairs of different modes, over all points: one aggregation of the pairs' dot products."""
    at = lambda i: F.get("bank", F.lit(i))
    dot = lambda i, j: F.sum(sum((at(i)[c] * at(j)[c] for c in "vw"), at(i)["u"] * at(j)["u"]))
    pairs = [(i, j) for i in range(n_modes) for j in range(i, n_modes)]
    s = banked.groupBy(key).agg(*(dot(i, j).alias(f"d{i}_{j}") for i, j in pairs))
    length = lambda i: F.greatest(F.sqrt(F.col(f"d{i}_{i}")), F.lit(1e-12))
    cosines = [2 * (F.col(f"d{i}_{j}") / (length(i) * length(j))) ** 2 for i, j in pairs if i < j]
    return s.select(key, (sum(cosines[1:], cosines[0]) / (n_modes * (n_modes - 1))).alias("orthogonality"))


def entropy(weights: Column) -> Column:
    """Shannon entropy of an array of weights."""
    return -F.aggregate(F.transform(weights, lambda w: w * F.log(F.greatest(w, F.lit(1e-8)))), F.lit(0.0), lambda a, x: a + x)


def gate_statistics(df: DataFrame, weights: str = "weights", n_modes: int = 8) -> DataFrame:
    """One row: mean entropy and the mean square gap to 75 percent of the largest entropy."""
    import math

    e = entropy(F.col(weights))
    return df.agg(F.avg(e).alias("gate_entropy"), F.avg((e - 0.75 * math.log(n_modes)) ** 2).alias("entropy_loss"))


def mode_weights(df: DataFrame, weights: str = "weights") -> DataFrame:
    """Per mode: mean and sample deviation of its weight over all points."""
    rows = df.select(F.posexplode(weights).alias("mode", "weight"))
    return rows.groupBy("mode").agg(F.avg("weight").alias("weight_mean"), F.stddev_samp("weight").alias("weight_std"))


def combined_loss(geometry: Column, physics: Column, dictionary: Column, batch: Column, weight: float) -> Column:
    return geometry + weight * (physics + dictionary * batch)


def divergence(df: DataFrame, k: int = 8, subset: int = 256, key: str = "sample_id", point: str = "point_id") -> DataFrame:
    """Per sample: the mean square divergence of a flow by moving least squares on ``subset`` points and their ``k`` neighbours.

    The subset is that of the least seeded hashes of the point id, so pairs are at most ``subset`` squared for each sample.
    Ranks break ties of distance by the point id; the first rank (the point itself, or a twin) is dropped.
    """
    from pyspark.sql import Window as W

    drawn = df.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(key_hash(0, point), point))).where(F.col("__r") <= subset)
    a = drawn.select(key, *(F.col(c).alias(f"a{c}") for c in ("x", "y", "z", "u", "v", "w")), F.col(point).alias("__i"))
    b = drawn.select(key, *(F.col(c).alias(f"b{c}") for c in ("x", "y", "z", "u", "v", "w")), F.col(point).alias("__j"))
    dp, dv = vec("b") - vec("a"), vec("b", "uvw") - vec("a", "uvw")
    pairs = a.join(b, key).withColumns({**dp.named("p"), **dv.named("q"), "dist": dp.norm()})
    near = pairs.withColumn("__k", F.row_number().over(W.partitionBy(key, "__i").orderBy("dist", "__j"))).where((F.col("__k") > 1) & (F.col("__k") <= k + 1))
    sigma = F.greatest(F.avg("dist").over(W.partitionBy(key, "__i")), F.lit(1e-4))
    weighed = near.withColumn("kern", F.exp(-F.col("dist") / sigma))
    second = {f"c{i}{j}": F.sum(F.col("kern") * F.col(f"p{i}") * F.col(f"p{j}")) + (1e-4 if i == j else 0.0) for i, j in ("xx", "xy", "xz", "yy", "yz", "zz")}
    cross = {f"m{i}{j}": F.sum(F.col("kern") * F.col(f"q{i}") * F.col(f"p{j}")) for i in "xyz" for j in "xyz"}
    s = weighed.groupBy(key, "__i").agg(*(v.alias(n) for n, v in (second | cross).items()))
    c = lambda n: F.col(f"c{n}")
    cof = {"xx": c("yy") * c("zz") - c("yz") ** 2, "yy": c("xx") * c("zz") - c("xz") ** 2, "zz": c("xx") * c("yy") - c("xy") ** 2, "xy": c("xz") * c("yz") - c("xy") * c("zz"), "xz": c("xy") * c("yz") - c("xz") * c("yy"), "yz": c("xy") * c("xz") - c("xx") * c("yz")}
    det = c("xx") * cof["xx"] + c("xy") * cof["xy"] + c("xz") * cof["xz"]
    trace = sum((F.col(f"m{i}{j}") * cof["".join(sorted(i + j))] for i in "xyz" for j in "xyz"), F.lit(0.0)) / det
    return s.select(key, trace.alias("d")).groupBy(key).agg(F.avg(F.col("d") ** 2).alias("divergence"))
