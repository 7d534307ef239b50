"""The forward pass of a network that attends over slices of point clouds: narrow NumPy over blocks of points, sums of slices in Spark.

Each layer needs of a sample only its slices' sums, which are added up over blocks of points: a sample of any size is many
tasks' work, and what goes back to its points is one small array a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators.inference import Weights, gelu, layer_norm, seeded_weights, softmax
from flowloom.operators.ranges import running
from flowloom.session import cut_lineage


def shapes(width: int, out: int, hidden: int = 64, layers: int = 2, heads: int = 4, slices: int = 16, ratio: int = 2) -> dict[str, tuple[int, ...]]:
    """Names and shapes of all parameters; matrices are (in, out)."""
    d = hidden // heads
    found = {"pre_w1": (width, 2 * hidden), "pre_b1": (2 * hidden,), "pre_w2": (2 * hidden, hidden), "pre_b2": (hidden,), "placeholder": (hidden,)}
    for i in range(layers):
        found |= {f"l{i}_{k}": s for k, s in {
            "n1_scale": (hidden,), "n1_shift": (hidden,), "fx_w": (hidden, hidden), "fx_b": (hidden,), "x_w": (hidden, hidden), "x_b": (hidden,), "slice_w": (d, slices), "slice_b": (slices,), "heat": (heads,),
            "q": (d, d), "k": (d, d), "v": (d, d), "out_w": (hidden, hidden), "out_b": (hidden,), "n2_scale": (hidden,), "n2_shift": (hidden,), "mlp_w1": (hidden, ratio * hidden), "mlp_b1": (ratio * hidden,), "mlp_w2": (ratio * hidden, hidden), "mlp_b2": (hidden,),
        }.items()}
    return found | {"n3_scale": (hidden,), "n3_shift": (hidden,), "head_w": (hidden, out), "head_b": (out,)}


def seeded(width: int, out: int, seed: int, **sizes: int) -> Weights:
    """Deterministic weights for tests and demonstrations, with a temperature of a half for every head."""
    w = seeded_weights(shapes(width, out, **sizes), seed)
    return {k: np.full(v.shape, 0.5) if k.endswith("heat") else v for k, v in w.items()}


def layers_of(w: Weights) -> int:
    return sum(k.endswith("_heat") for k in w)


def embedded(w: Weights, x: np.ndarray) -> np.ndarray:
    return gelu(x @ w["pre_w1"] + w["pre_b1"]) @ w["pre_w2"] + w["pre_b2"] + w["placeholder"]


def sliced(w: Weights, layer: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(points, heads, slices) weights and (points, heads, d) features of each point."""
    p = {k[len(f"l{layer}_") :]: v for k, v in w.items() if k.startswith(f"l{layer}_")}
    heads = len(p["heat"])
    n = layer_norm(h, p["n1_scale"], p["n1_shift"])
    parts = lambda x: x.reshape(len(h), heads, -1)
    weight = softmax((parts(n @ p["x_w"] + p["x_b"]) @ p["slice_w"] + p["slice_b"]) / p["heat"][:, None])
    return weight, parts(n @ p["fx_w"] + p["fx_b"])


def attended(w: Weights, layer: int, sums: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """(heads, slices, d) sums and (heads, slices) weights to what each slice takes from the others of its head."""
    token = sums / (norm + 1e-5)[..., None]
    q, k, v = (token @ w[f"l{layer}_{x}"] for x in "qkv")
    return softmax(q @ np.swapaxes(k, -1, -2) * token.shape[-1] ** -0.5) @ v


def passed(w: Weights, layer: int, h: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Points after the layer, from their sample's slices."""
    p = {k[len(f"l{layer}_") :]: v for k, v in w.items() if k.startswith(f"l{layer}_")}
    weight, _ = sliced(w, layer, h)
    h = np.einsum("nhg,hgc->nhc", weight, token).reshape(len(h), -1) @ p["out_w"] + p["out_b"] + h
    return gelu(layer_norm(h, p["n2_scale"], p["n2_shift"]) @ p["mlp_w1"] + p["mlp_b1"]) @ p["mlp_w2"] + p["mlp_b2"] + h


def headed(w: Weights, h: np.ndarray) -> np.ndarray:
    return layer_norm(h, w["n3_scale"], w["n3_shift"]) @ w["head_w"] + w["head_b"]


def packed(points: DataFrame, features: list[str], sample: str, point: str, block: int = 4096) -> DataFrame:
    """sample, block, ids and x: each sample's points in blocks of ``block`` at most, their features one after another."""
    x = F.array(*(F.col(f).cast("double") for f in features))
    at = running(points.select(F.col(sample).alias("sample"), F.col(point).alias("point"), x.alias("x")), ["sample"], ["point"])
    rows = F.array_sort(F.collect_list(F.struct("position", "point", "x")))
    made = at.groupBy("sample", F.floor(F.col("position") / block).alias("block")).agg(rows.alias("r"))
    return made.select("sample", "block", F.col("r.point").alias("ids"), F.flatten("r.x").alias("x"))


def forward(points: DataFrame, weights: Weights, features: list[str], sample: str = "sample_id", point: str = "point_id", block: int = 4096) -> DataFrame:
    """sample, point and out: the network's numbers for every point.

    A layer's slices are summed over blocks in Spark and attended in NumPy, one row a sample; then each block gets its
    sample's slices. Blocks between layers are checkpoints. Null features count 0.
    """
    sent = points.sparkSession.sparkContext.broadcast(weights)
    ids = f"array<{points.schema[point].dataType.simpleString()}>"
    kind = f"sample {points.schema[sample].dataType.simpleString()}, block long, ids {ids}, x array<double>"
    width = lambda r: np.nan_to_num(np.asarray(r.x, float)).reshape(len(r.ids), -1)

    def start(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(x=[embedded(sent.value, width(r)).ravel() for r in pdf.itertuples()])

    def sums(layer: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                made = []
                for r in pdf.itertuples():
                    weight, value = sliced(sent.value, layer, width(r))
                    made.append(np.concatenate([np.einsum("nhg,nhc->hgc", weight, value).ravel(), weight.sum(0).ravel()]))
                yield pd.DataFrame({"sample": pdf["sample"], "sums": made})

        return run

    def attend(layer: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            w = sent.value
            heads, (d, slices) = len(w[f"l{layer}_heat"]), w[f"l{layer}_slice_w"].shape
            for pdf in frames:
                cut = heads * slices * d
                each = [np.asarray(s, float) for s in pdf["sums"]]
                yield pd.DataFrame({"sample": pdf["sample"], "token": [attended(w, layer, s[:cut].reshape(heads, slices, d), s[cut:].reshape(heads, slices)).ravel() for s in each]})

        return run

    def step(layer: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            w = sent.value
            heads, (d, slices) = len(w[f"l{layer}_heat"]), w[f"l{layer}_slice_w"].shape
            for pdf in frames:
                yield pdf.assign(x=[passed(w, layer, width(r), np.asarray(r.token, float).reshape(heads, slices, d)).ravel() for r in pdf.itertuples()]).drop(columns="token")

        return run

    def end(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                yield pd.DataFrame({"sample": r.sample, "point": list(r.ids), "out": list(headed(sent.value, width(r)))})

    one = kind.split(", ")[0]
    now = cut_lineage(packed(points, features, sample, point, block).mapInPandas(start, kind))
    for layer in range(layers_of(weights)):
        each = now.mapInPandas(sums(layer), f"{one}, sums array<double>").select("sample", F.posexplode("sums").alias("place", "value"))
        added = each.groupBy("sample", "place").agg(F.sum("value").alias("value")).groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("place", "value")))["value"].alias("sums"))
        tokens = cut_lineage(added.mapInPandas(attend(layer), f"{one}, token array<double>"))
        now = cut_lineage(now.join(tokens, "sample").select("sample", "block", "ids", "x", "token").mapInPandas(step(layer), kind))
    out = now.mapInPandas(end, f"{one}, point {ids[6:-1]}, out array<double>")
    return out.select(F.col("sample").alias(sample), F.col("point").alias(point), "out")
