"""The network over slices against plain loops, number by number."""

from __future__ import annotations

import math

import numpy as np

from flowloom.operators import slice_network


def plain(w, x):
    """One sample, one number after another."""
    gelu = np.vectorize(lambda v: 0.5 * v * (1 + math.erf(v / math.sqrt(2))))
    soft = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    norm = lambda v, s, t: (v - v.mean()) / math.sqrt(((v - v.mean()) ** 2).mean() + 1e-5) * s + t
    h = [gelu(r @ w["pre_w1"] + w["pre_b1"]) @ w["pre_w2"] + w["pre_b2"] + w["placeholder"] for r in x]
    for i in range(slice_network.layers_of(w)):
        g = lambda k: w[f"l{i}_{k}"]  # noqa: E731,B023
        heads, (d, slices) = len(g("heat")), g("slice_w").shape
        n = [norm(v, g("n1_scale"), g("n1_shift")) for v in h]
        mixed = [[] for _ in h]
        for a in range(heads):
            part = slice(a * d, (a + 1) * d)
            weight = [soft(((v @ g("x_w") + g("x_b"))[part] @ g("slice_w") + g("slice_b")) / g("heat")[a]) for v in n]
            value = [(v @ g("fx_w") + g("fx_b"))[part] for v in n]
            token = [sum(u[s] * v for u, v in zip(weight, value, strict=True)) / (sum(u[s] for u in weight) + 1e-5) for s in range(slices)]
            q, k, v = ([t @ g(m) for t in token] for m in "qkv")
            taken = [sum(p * u for p, u in zip(soft(np.array([x @ y for y in k]) / math.sqrt(d)), v, strict=True)) for x in q]
            for m, u in zip(mixed, weight, strict=True):
                m.append(sum(u[s] * taken[s] for s in range(slices)))
        h = [np.concatenate(m) @ g("out_w") + g("out_b") + v for m, v in zip(mixed, h, strict=True)]
        h = [gelu(norm(v, g("n2_scale"), g("n2_shift")) @ g("mlp_w1") + g("mlp_b1")) @ g("mlp_w2") + g("mlp_b2") + v for v in h]
    return [norm(v, w["n3_scale"], w["n3_shift"]) @ w["head_w"] + w["head_b"] for v in h]


def test_two_layers_of_two_heads_number_by_number(spark):
    w = slice_network.seeded(3, 4, 11, hidden=6, layers=2, heads=2, slices=3, ratio=2)
    w["l0_heat"] = np.array([0.3, 0.9])
    rng = np.random.default_rng(0)
    given = {s: rng.normal(size=(n, 3)) for s, n in (("a", 37), ("b", 5), ("c", 1))}
    rows = [(s, i, *map(float, p)) for s, x in given.items() for i, p in enumerate(x)]
    got = {(r.sample_id, r.point_id): r.out for r in slice_network.forward(spark.createDataFrame(rows, "sample_id string, point_id long, x double, y double, z double"), w, ["x", "y", "z"], block=8).collect()}
    assert len(got) == len(rows)
    for s, x in given.items():
        for i, want in enumerate(plain(w, x)):
            assert np.allclose(got[s, i], want, atol=1e-6)
