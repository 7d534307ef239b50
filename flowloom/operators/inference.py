"""Inference of the small routing networks, batched in NumPy per Arrow batch, and what around it Spark expresses itself."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Weights = dict[str, np.ndarray]
#: Published coefficients of a Chebyshev fit of erfc, whose relative error is under 1.2e-7 (fixed values).
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _erf(x: np.ndarray) -> np.ndarray:
    """The error function over a whole array, to 1.2e-7."""
    t = 1 / (1 + 0.5 * np.abs(x))
    power = np.polynomial.polynomial.polyval(t, _ERFC)
    return np.sign(x) * (1 - t * np.exp(power - x * x))


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1.0 + _erf(x / math.sqrt(2.0)))


def layer_norm(x: np.ndarray, scale: np.ndarray, shift: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    centred = x - x.mean(-1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(-1, keepdims=True) + eps) * scale + shift


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def seeded_weights(shapes: dict[str, tuple[int, ...]], seed: int) -> Weights:
    """Deterministic weights for tests and demonstrations; real ones come as a table of arrays."""
    rng = np.random.default_rng(seed)
    return {k: rng.normal(0, 1 / math.sqrt(s[0]), s) if len(s) > 1 else (np.ones(s) if k.endswith("scale") else rng.normal(0, 0.02, s)) for k, s in shapes.items()}


def trajectory_shapes(hidden: int = 16, out: int = 16, steps: int = 3) -> dict[str, tuple[int, ...]]:
    return {"w1": (3, hidden), "b1": (hidden,), "n1_scale": (hidden,), "n1_shift": (hidden,), "w2": (hidden, hidden), "b2": (hidden,), "step": (steps, hidden), "w3": (2 * hidden, out), "b3": (out,), "n3_scale": (out,), "n3_shift": (out,)}


def gate_shapes(width: int, modes: int = 8, hidden: int = 32) -> dict[str, tuple[int, ...]]:
    return {"w1": (width, hidden), "b1": (hidden,), "w2": (hidden, hidden), "b2": (hidden,), "w3": (hidden, modes), "b3": (modes,)}


def basis_shapes(width: int = 7, modes: int = 4, hidden: int = 64) -> dict[str, tuple[int, ...]]:
    norms = {f"n{i}_{k}": (hidden,) for i in (1, 2) for k in ("scale", "shift")}
    return {"w1": (width, hidden), "b1": (hidden,), "w2": (hidden, hidden), "b2": (hidden,), "w3": (hidden, hidden), "b3": (hidden,), "w4": (hidden, modes * 3), "b4": (modes * 3,), **norms}


def encode_trajectory(w: Weights, t: np.ndarray) -> np.ndarray:
    """(n, steps * 3) or (n, steps, 3) displacements to (n, out) features."""
    steps = w["step"].shape[0]
    if t.shape[1:] not in ((steps * 3,), (steps, 3)):
        raise ValueError(f"a trajectory must have shape (n, {steps * 3}) or (n, {steps}, 3), not {t.shape}")
    h = gelu(layer_norm(t.reshape(len(t), steps, 3) @ w["w1"] + w["b1"], w["n1_scale"], w["n1_shift"]))
    h = gelu(h @ w["w2"] + w["b2"]) + w["step"]
    pooled = np.concatenate([h.mean(1), h.max(1)], -1)
    return gelu(layer_norm(pooled @ w["w3"] + w["b3"], w["n3_scale"], w["n3_shift"]))


def gate(w: Weights, x: np.ndarray) -> np.ndarray:
    """(n, width) features to (n, modes) weights that sum to 1."""
    return softmax(gelu(gelu(x @ w["w1"] + w["b1"]) @ w["w2"] + w["b2"]) @ w["w3"] + w["b3"])


def basis(w: Weights, x: np.ndarray) -> np.ndarray:
    """(n, width) geometry to (n, modes, 3) learned modes."""
    h = gelu(layer_norm(x @ w["w1"] + w["b1"], w["n1_scale"], w["n1_shift"]))
    h = gelu(layer_norm(h @ w["w2"] + w["b2"], w["n2_scale"], w["n2_shift"]))
    return (gelu(h @ w["w3"] + w["b3"]) @ w["w4"] + w["b4"]).reshape(len(x), -1, 3)


def _apply(df: DataFrame, keys: list[str], inputs: list[str], make, out: str) -> DataFrame:
    schema = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), f"{out} array<double>"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                yield pdf[keys].assign(**{out: list(make(pdf).reshape(len(pdf), -1))})

    return df.select(*keys, *inputs).mapInPandas(run, schema)


def routing_weights(df: DataFrame, encoder: Weights, router: Weights, keys: list[str], features: list[str], trajectory: str = "trajectory") -> DataFrame:
    """keys and weights: the gate over ``features`` and the encoded trajectory (an array of 3 * steps numbers)."""

    def make(pdf: pd.DataFrame) -> np.ndarray:
        walked = encode_trajectory(encoder, np.stack(pdf[trajectory].to_numpy()).astype(float))
        return gate(router, np.concatenate([pdf[features].to_numpy(float), walked], 1))

    return _apply(df, keys, [*features, trajectory], make, "weights")


def learned_basis(df: DataFrame, weights: Weights, keys: list[str], features: list[str]) -> DataFrame:
    """keys and modes: a flat array of modes * 3 numbers."""
    return _apply(df, keys, features, lambda pdf: basis(weights, pdf[features].to_numpy(float)), "modes")


def slice_tokens(df: DataFrame, weights: str, features: list[str], key: str = "sample_id", eps: float = 1e-5) -> DataFrame:
    """Per sample and slice: the weighted mean of features over all points, where weights is an array with one number per slice."""
    rows = df.select(key, *features, F.posexplode(weights).alias("slice", "__w"))
    return rows.groupBy(key, "slice").agg(*((F.sum(F.col("__w") * F.col(f)) / (F.sum("__w") + eps)).alias(f) for f in features))


def attend_slices(tokens: DataFrame, features: list[str], query: list[list[float]], key_: list[list[float]], value: list[list[float]], scale: float, key: str = "sample_id") -> DataFrame:
    """Attention among the slices of each sample: sample, slice and features.

    Matrices are given by rows of the output; softmax over a slice's scores weighs the values of all. Slices are few, so
    a sample's pairs are their square.
    """
    times = lambda m: {f: sum((F.col(g) * w for g, w in zip(features, row, strict=True)), F.lit(0.0)) for f, row in zip(features, m, strict=True)}
    q = tokens.select(key, "slice", *(v.alias(f"__q{f}") for f, v in times(query).items()))
    kv = tokens.select(key, F.col("slice").alias("__o"), *(v.alias(f"__k{f}") for f, v in times(key_).items()), *(v.alias(f"__v{f}") for f, v in times(value).items()))
    score = q.join(kv, key).withColumn("__s", scale * sum((F.col(f"__q{f}") * F.col(f"__k{f}") for f in features), F.lit(0.0)))
    top = F.max("__s").over(W.partitionBy(key, "slice"))
    weighed = score.withColumn("__w", F.exp(F.col("__s") - top))
    return weighed.groupBy(key, "slice").agg(*((F.sum(F.col("__w") * F.col(f"__v{f}")) / F.sum("__w")).alias(f) for f in features))


def deslice(points: DataFrame, tokens: DataFrame, weights: str, features: list[str], keys: list[str], key: str = "sample_id") -> DataFrame:
    """keys and features: each point's mixture of its sample's slice features, by its own weight of each slice."""
    packed = tokens.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slice", F.struct(*features)))).alias("__t"))
    joined = points.join(packed, key)
    mixed = lambda f: F.aggregate(F.transform(weights, lambda w, i: w * F.col("__t")[i][f]), F.lit(0.0), lambda a, x: a + x)
    return joined.select(*keys, *(mixed(f).alias(f) for f in features))
