"""Analytic flow features of points in their sample's frame: profiles, an eight-mode bank, mixtures and prompts.

Every function takes points with the columns of ``frames.wall_coordinates`` and adds columns; nothing is shuffled. The
shapes, gains and weights below are fixed values: results must equal those of the published definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.vectors import Vec, clip, vec, with_unit
from flowloom.operators.frames import p95_scale, with_radial

#: The compact mixture's weights of the eight modes, in order.
COMPACT_WEIGHTS = (0.24, 0.18, 0.16, 0.10, 0.14, 0.08, 0.06, 0.04)
MODES = ("parabolic", "plug", "accelerating", "decelerating", "skewed", "dean", "helical", "recirculating")


def parabolic(rho: Column) -> Column:
    return 2.0 * rho - rho * rho


def plug(rho: Column) -> Column:
    return 1.0 - F.pow(1.0 - rho, F.lit(6))


def packed(flow: Vec) -> dict[str, Column]:
    """Flow columns u, v, w and speed."""
    return {**flow.named("", "uvw"), "speed": flow.norm()}


def velocity(points: DataFrame) -> DataFrame:
    """Parabolic flow along the axis: u, v, w, speed."""
    return points.withColumns({**(vec("axis_") * parabolic(F.col("rho"))).named("", "uvw"), "speed": parabolic(F.col("rho"))})


def full(points: DataFrame) -> DataFrame:
    """``velocity`` with pressure, no_slip and axial."""
    return velocity(points).withColumns({"pressure": 1.0 - F.col("axial"), "no_slip": 1.0 - F.col("rho")})


def _coefficients(points: DataFrame) -> tuple[DataFrame, list[dict[str, Column]]]:
    """Points with what the modes are made of, and for each of the eight its parts along axis (a), side, normal, swirl (w) and radial direction.

    The modes are sums of few directions, so one expression turns any of them into a flow; a part not given is 0.
    """
    c = F.col
    ready = with_radial(points).withColumns({"lateral": clip(vec("rad_").dot(vec("side_")), -1.0, 1.0), "__slow": parabolic(c("rho")), "__plug": plug(c("rho")), "__pocket": F.exp(-F.pow((c("axial") - 0.65) / 0.22, F.lit(2))) * c("wall")})
    gain = c("__slow") * clip(1.0 + 0.40 * c("lateral"), 0.50, 1.50) / (1 + 0.18**2) ** 0.5
    ready = ready.withColumns({"__accel": clip((0.65 * c("__slow") + 0.35 * c("__plug")) * (0.85 + 0.30 * c("phase")), 0.0, 1.25), "__skew": gain})
    modes = {
        "parabolic": {"a": c("__slow")},
        "plug": {"a": c("__plug")},
        "accelerating": {"a": c("__accel")},
        "decelerating": {"a": 0.70 * c("__slow") - 0.30 * c("wall") * c("phase")},
        "skewed": {"a": c("__skew"), "s": 0.18 * c("__skew")},
        "dean": {"a": c("__slow"), "n": 0.28 * c("rho") * c("wall") * c("phase") * c("lateral")},
        "helical": {"a": c("__slow"), "w": 0.22 * c("rho") * c("wall") * (0.5 + 0.5 * c("phase"))},
        "recirculating": {"a": c("__slow") * (1.0 - 0.70 * c("__pocket")) - 0.22 * c("__pocket"), "r": 0.10 * c("__pocket")},
    }
    return ready, list(modes.values())


_DIRECTIONS = {"a": "axis_", "s": "side_", "n": "normal_", "w": "swirl_", "r": "rad_"}


def _flow(parts: dict[str, Column]) -> Vec:
    first, *rest = (vec(_DIRECTIONS[k]) * p for k, p in parts.items())
    for more in rest:
        first = first + more
    return first


def bank(points: DataFrame) -> DataFrame:
    """Adds bank: the eight modes as an array of (u, v, w)."""
    ready, modes = _coefficients(points)
    flows = F.array(*(F.struct(*(c.alias(n) for n, c in _flow(m).named("", "uvw").items())) for m in modes))
    return _result(ready.withColumn("bank", flows))


def bank_long(points: DataFrame, keys: tuple[str, ...] = ("sample_id", "point_id")) -> DataFrame:
    """A row for each point and mode: keys, mode (0 to 7), u, v, w, speed."""
    ready, modes = _coefficients(points)
    rows = ready.withColumn("mode", F.explode(F.sequence(F.lit(0), F.lit(len(modes) - 1))))

    def part(k: str) -> Column:
        chosen = F.when(F.lit(False), 0.0)
        for i, m in enumerate(modes):
            chosen = chosen.when(F.col("mode") == i, m[k]) if k in m else chosen
        return chosen.otherwise(0.0)

    parted = rows.withColumns({f"__{k}": part(k) for k in _DIRECTIONS})
    flowing = parted.withColumns(_flow({k: F.col(f"__{k}") for k in _DIRECTIONS}).named("", "uvw"))
    return flowing.select(*keys, "mode", "u", "v", "w", vec("", "uvw").norm().alias("speed"))


def mixed(banked: DataFrame, weights: Column) -> DataFrame:
    """Adds u, v, w and speed of the bank's mixture; ``weights`` is an array of eight, speed is that of the mixed flow."""
    part = lambda c: F.aggregate(F.zip_with("bank", weights, lambda m, w: m[c] * w), F.lit(0.0), lambda a, x: a + x)
    return banked.withColumns({c: part(c) for c in "uvw"}).withColumn("speed", vec("", "uvw").norm())


def compact(banked: DataFrame) -> DataFrame:
    return mixed(banked, F.array(*(F.lit(w) for w in COMPACT_WEIGHTS)))


def condition_features(points: DataFrame, key: str = "sample_id") -> DataFrame:
    """Adds walk_* (unit probe direction), alignment with the axis, across_* (its transverse part) and step_norm."""
    axis, walk = vec("axis_"), vec("walk_")
    scale = points.groupBy(key).agg(p95_scale(F.abs("step")).alias("step_scale"))
    walked = with_unit(points.join(scale, key), vec("d"), axis, "walk_")
    aligned = walked.withColumns({"alignment": clip(walk.dot(axis), -1.0, 1.0), "step_norm": clip(F.abs("step") / F.col("step_scale"), 0.0, 1.0)})
    return with_unit(aligned, walk - axis * F.col("alignment"), vec("side_"), "across_")


def _conditioned(points: DataFrame) -> DataFrame:
    """Adds __f*, the flow that leans towards the probe, and what it is made of. A column for each step, each computed once."""
    axis, c = vec("axis_"), F.col
    step1 = with_radial(points).withColumns({"lateral": clip(vec("rad_").dot(vec("walk_")), -1.0, 1.0), "__mix": clip(0.25 + 0.35 * c("step_norm") + 0.20 * F.greatest(c("alignment"), F.lit(0.0)), 0.05, 0.85), "__slow": parabolic(c("rho")), "__plug": plug(c("rho"))})
    step2 = step1.withColumns({"__gain": clip(1.0 + 0.35 * c("lateral"), 0.55, 1.45), "__pulse": clip(1.0 + 0.22 * c("alignment") * c("phase"), 0.65, 1.30), "__base": (1.0 - c("__mix")) * c("__slow") + c("__mix") * c("__plug")})
    step3 = step2.withColumn("__product", c("__base") * c("__gain") * c("__pulse"))
    across = vec("across_") * (0.20 + 0.20 * c("step_norm"))
    around = vec("swirl_") * (0.10 * (1.0 - F.abs(c("alignment"))) * c("rho") * c("wall"))
    step4 = with_unit(step3.withColumn("__speed", clip(c("__product"), 0.0, 1.35)), axis + across + around, axis, "__d")
    return step4.withColumns((vec("__d") * c("__speed")).named("__f"))


def _result(points: DataFrame) -> DataFrame:
    return points.drop(*(n for n in points.columns if n.startswith("__")))


def conditioned_velocity(points: DataFrame) -> DataFrame:
    """Flow that leans towards the probe: u, v, w, speed. Needs ``condition_features``."""
    return _result(_conditioned(points).withColumns(packed(vec("__f"))))


def conditioned_compact(points: DataFrame) -> DataFrame:
    """The conditioned flow mixed with a secondary, a swirling and a reversing one, by weights that sum to 1."""
    axis, c = vec("axis_"), F.col
    slow, against = c("__slow"), F.greatest(-c("alignment"), F.lit(0.0))
    ready = _conditioned(points).withColumns({
        "__reverse": clip(against * c("phase") * c("wall"), 0.0, 1.0), "__w0": clip(0.45 + 0.25 * c("step_norm"), 0.25, 0.75), "__w1": clip(0.12 + 0.18 * F.abs("lateral"), 0.05, 0.35),
        "__w2": clip(0.10 + 0.20 * (1.0 - F.abs("alignment")), 0.05, 0.35), "__w3": clip(0.05 + 0.25 * against, 0.02, 0.30),
    })
    ready = ready.withColumn("__total", c("__w0") + c("__w1") + c("__w2") + c("__w3"))
    dean = axis * slow + vec("normal_") * (0.22 * c("rho") * c("wall") * c("phase") * c("lateral"))
    helical = axis * slow + vec("swirl_") * (0.20 * c("rho") * c("wall") * (0.5 + 0.5 * c("step_norm")))
    back = axis * (slow * (1.0 - 0.55 * c("__reverse")) - 0.18 * c("__reverse")) + vec("rad_") * (0.10 * c("__reverse"))
    flow = vec("__f") * c("__w0") + dean * c("__w1") + helical * c("__w2") + back * c("__w3")
    blended = ready.withColumns((flow * (1.0 / c("__total"))).named("__m"))
    return _result(blended.withColumns(packed(vec("__m"))))


def legacy_prompt(points: DataFrame, inlet: Column) -> DataFrame:
    """The axis times the inlet speed, and that speed as scalar."""
    return points.withColumns({**(vec("axis_") * inlet).named("", "uvw"), "scalar": inlet})


def _profile(points: DataFrame, key: str) -> DataFrame:
    dist = F.greatest(F.col("wall_dist"), F.lit(0.0))
    scale = points.groupBy(key).agg(F.greatest(F.max(dist), F.lit(1e-6)).alias("dist_max"))
    return points.join(scale, key).withColumn("profile", clip(dist / F.col("dist_max"), 0.0, 1.0))


def territory_prompt(points: DataFrame, cond: Column, key: str = "sample_id") -> DataFrame:
    """Prompt of the twelve-channel condition: wall profile times a pulsatile speed along the axis, and a pressure-like scalar."""
    at = lambda i: F.get(cond, F.lit(i))
    along = points.withColumn("__a", vec("").dot(vec("axis_")))
    ends = along.groupBy(key).agg(F.min("__a").alias("__lo"), F.max("__a").alias("__hi"))
    rms = F.greatest(at(2), F.lit(1e-4))
    rows = _profile(along.join(ends, key), key).withColumn("__speed", rms + 0.25 * F.greatest(at(3), rms) * clip(at(4), 0.0, 1.0))
    speed = F.col("__speed")
    drop = rms * F.greatest(at(8), F.lit(1e-4)) / (F.greatest(at(10), F.lit(1e-4)) + 1e-4)
    forward = (F.col("__a") - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + 1e-8)
    decay = (1.0 - F.col("profile")) + 0.1 * vec("n").norm()
    scalar = speed * F.col("profile") + 0.1 * drop * (1.0 - forward) - 0.05 * decay
    return rows.withColumns({**(vec("axis_") * (speed * F.col("profile"))).named("", "uvw"), "scalar": scalar}).drop("__a", "__lo", "__hi", "__speed")


def inlet_prompt(points: DataFrame, inlet_mean: Column, inlet_max: Column, key: str = "sample_id") -> DataFrame:
    """Prompt of measured inlet speeds: the larger of the mean and a quarter of the maximum, times the wall profile."""
    speed = F.greatest(F.greatest(inlet_mean, F.lit(0.0)), 0.25 * F.greatest(inlet_max, F.lit(0.0)))
    return _profile(points, key).withColumns({**(vec("axis_") * (speed * F.col("profile"))).named("", "uvw"), "scalar": speed * F.col("profile")})


def mixed_prompt(points: DataFrame, cond: Column, key: str = "sample_id") -> DataFrame:
    """``legacy_prompt`` for rows whose condition ends in a negative sentinel or is shorter than 12, else ``territory_prompt``."""
    legacy = (F.size(cond) < 12) | (F.get(cond, F.lit(11)) < 0)
    told = territory_prompt(points, cond, key)
    inlet = F.get(cond, F.lit(1))
    old = {**(vec("axis_") * inlet).named("", "uvw"), "scalar": inlet}
    return told.withColumns({n: F.when(legacy, c).otherwise(F.col(n)) for n, c in old.items()})


def centroid_features(points: DataFrame, key: str = "sample_id") -> DataFrame:
    """Wall distance and inward normal guessed from the distance to the centroid, for samples without wall geometry."""
    centre = points.groupBy(key).agg(*(F.avg(c).alias(f"__c{c}") for c in "xyz"))
    off = points.join(centre, key).withColumns((vec("") - vec("__c")).named("__o")).withColumn("__r", vec("__o").norm())
    top = off.groupBy(key).agg((F.max("__r") + 1e-6).alias("__top"))
    inward = -(vec("__o") * (1 / (F.col("__r") + 1e-8)))
    return off.join(top, key).withColumns({"wall_dist": F.col("__top") - F.col("__r"), **inward.named("n")}).drop(*(f"__c{c}" for c in "xyz"), *(f"__o{c}" for c in "xyz"), "__r", "__top")


def aligned_bank(banked: DataFrame, truth: str = "t", key: str = "sample_id") -> DataFrame:
    """The bank turned round in samples where its first mode points against the mean true flow. It looks at the truth: evaluation only."""
    mean = banked.groupBy(key).agg(sum((F.avg(F.get("bank", F.lit(0))[c]) * F.avg(truth + c) for c in "uvw"), F.lit(0.0)).alias("__dot"))
    sign = F.when(F.col("__dot") < 0, -1.0).otherwise(1.0)
    turned = F.transform("bank", lambda m: F.struct(*((m[c] * F.col("__s")).alias(c) for c in "uvw")))
    return banked.join(mean, key).withColumn("__s", sign).withColumn("bank", turned).drop("__dot", "__s")
