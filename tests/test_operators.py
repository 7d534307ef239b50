"""Properties and edge cases that tables without nulls, NaN or degenerate samples don't show."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from flowloom.functions import strings
from flowloom.functions.vectors import clip, unit, vec
from flowloom.operators import frames, inference, metrics, proxies, quality_control, sampling, selection
from flowloom.plans import proxy_queries


def test_clip_keeps_nan(spark):
    rows = spark.createDataFrame([(float("nan"),), (-2.0,), (9.0,), (None,)], "x double").select(clip(F.col("x"), 0.0, 1.0).alias("y")).collect()
    assert math.isnan(rows[0].y) and [r.y for r in rows[1:3]] == [0.0, 1.0]


def test_unit_falls_back_for_short_and_nan_vectors(spark):
    df = spark.createDataFrame([(3.0, 4.0, 0.0), (0.0, 0.0, 0.0), (float("nan"), 1.0, 1.0)], "x double, y double, z double")
    got = df.select(*unit(vec(""), vec("").__class__(F.lit(1.0), F.lit(0.0), F.lit(0.0)))).collect()
    assert [tuple(r) for r in got] == [(0.6, 0.8, 0.0), (1.0, 0.0, 0.0), (1.0, 0.0, 0.0)]


def test_principal_axis_turns_with_the_points(spark):
    line = [("a", float(t), 2.0 * t, 0.1 * (t % 3)) for t in range(-10, 11)]
    turned = [("b", -y, x, z) for _, x, y, z in line]
    m = frames.moments(spark.createDataFrame(line + turned, "sample_id string, x double, y double, z double"))
    axes = {r.sample_id: (r.axis_x, r.axis_y, r.axis_z) for r in frames.principal_axes(m).collect()}
    a, b = axes["a"], axes["b"]
    assert abs(abs(-a[1] * b[0] + a[0] * b[1] + a[2] * b[2]) - 1) < 1e-9
    assert a[1] > 0 and max(map(abs, b)) == max(b)


def test_single_point_has_coordinate_axes(spark):
    m = frames.moments(spark.createDataFrame([("a", 1.0, 2.0, 3.0)], "sample_id string, x double, y double, z double"))
    row = frames.principal_axes(m).first()
    assert (row.axis_x, row.side_y, row.normal_z) == (1.0, 1.0, 1.0)


def test_p95_scale_skips_what_is_not_finite(spark):
    df = spark.createDataFrame([(float("inf"),), (float("nan"),), (-1.0,), (2.0,)], "d double")
    assert df.agg(frames.p95_scale(F.col("d")).alias("s")).first().s == 2.0
    assert df.where("d < 0").agg(frames.p95_scale(F.col("d")).alias("s")).first().s == 1.0


def test_mixture_speed_is_that_of_the_mixed_flow(spark, sf_dir):
    from flowloom.plans.proxy_queries import framed

    rows = proxies.compact(proxies.bank(framed(spark, sf_dir))).select(vec("", "uvw").norm().alias("n"), "speed").collect()
    assert abs(sum(proxies.COMPACT_WEIGHTS) - 1) < 1e-9 and all(abs(r.n - r.speed) < 1e-12 for r in rows)


def test_relative_l2_does_not_change_with_scale(spark, sf_dir):
    from flowloom.plans.adapters import points

    p = points(spark, sf_dir)
    pairs = [("pu", "tu"), ("pv", "tv")]
    scaled = p.withColumns({c: F.col(c) * 7.0 for pair in pairs for c in pair})
    a, b = ({r.sample_id: r.rel_l2 for r in metrics.relative_l2(x, pairs).collect()} for x in (p, scaled))
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_combined_loss_of_the_known_case(spark):
    row = spark.createDataFrame([(18.0, 8.0, 5.0, 2.0)], "g double, p double, d double, b double")
    assert row.select(metrics.combined_loss(F.col("g"), F.col("p"), F.col("d"), F.col("b"), 0.25).alias("l")).first().l == 22.5


def test_parse_bool_refuses_other_words(spark):
    with pytest.raises(PySparkException):
        spark.createDataFrame([("maybe",)], "t string").select(strings.parse_bool(F.col("t"))).collect()


def test_path_key_strips_all_leading_dots_and_slashes(spark):
    got = spark.createDataFrame([("./a/b",), ("/a/b",), ("..\\a\\b",)], "p string").select(strings.path_key(F.col("p")).alias("k")).collect()
    assert {r.k for r in got} == {"a/b"}


def _faces(spark, rows):
    return spark.createDataFrame(rows, "mesh_id string, a int, b int, c int")


CUBE = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]


def test_topology_of_closed_open_and_branching_meshes(spark):
    rows = [("closed", *f) for f in CUBE] + [("open", *f) for f in CUBE[:-2]] + [("bowtie", 0, 1, 2), ("bowtie", 0, 1, 3), ("bowtie", 0, 1, 4)]
    got = {r.mesh_id: r for r in quality_control.topology(_faces(spark, rows)).collect()}
    assert (got["closed"].n_edges, got["closed"].euler_number, got["closed"].is_watertight) == (18, 2, True)
    assert (got["open"].boundary_edges, got["open"].is_watertight) == (4, False)
    assert got["bowtie"].nonmanifold_edges == 1


def test_components_of_two_tetrahedra(spark):
    tetra = [(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)]
    rows = [("two", *f) for f in tetra] + [("two", *(v + 10 for v in f)) for f in tetra[:3]] + [("one", *f) for f in CUBE]
    got = {r.mesh_id: r for r in quality_control.components(_faces(spark, rows)).collect()}
    assert (got["two"].n_components, got["two"].largest_component_faces) == (2, 4)
    assert (got["one"].n_components, got["one"].largest_component_fraction) == (1, 1.0)


def test_cube_area_and_volume(spark):
    corner = lambda v: (float(v & 1), float(v >> 1 & 1), float(v >> 2 & 1))
    outward = [(a, c, b) for a, b, c in CUBE]
    rows = [("cube", *corner(a), *corner(b), *corner(c)) for a, b, c in outward]
    t = spark.createDataFrame(rows, "mesh_id string, " + ", ".join(f"{p}_{x} double" for p in "abc" for x in "xyz"))
    r = quality_control.measures(t).first()
    assert abs(r.surface_area - 6) < 1e-12 and abs(abs(r.volume) - 1) < 1e-12 and r.degenerate_faces == 0


def test_qc_load_error_hides_other_reasons(spark):
    row = (False, 1, 1, 1, False, 0.0, 0.0, 0.0, False, 5, 5, 5, None, 1)
    cols = "load_ok boolean, file_size_bytes int, n_vertices int, n_faces int, finite_vertices boolean, surface_area double, max_extent double, largest_component_fraction double, is_watertight boolean, boundary_edges int, nonmanifold_edges int, n_components int, aspect_ratio double, degenerate_faces int"
    r = quality_control.judged(spark.createDataFrame([row, (True, *row[1:])], cols)).collect()
    assert (r[0].status, r[0].reasons) == ("fail", "load_error")
    assert r[1].reasons.split("|")[0] == "tiny_file" and "extreme_aspect_ratio" not in r[1].reasons


def test_null_case_is_not_reserved(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "i int, case_id string")
    kept = selection.without_reserved(rows, spark.createDataFrame([("a",)], "case_id string"), "case_id")
    assert [r.i for r in kept.collect()] == [2]


def greedy(rows, k, seed):
    """The rule itself, one group after another."""
    import hashlib

    sizes, out = [0] * k, {}
    for t, _, _, name, n in sorted((t, -n, hashlib.md5(f"{seed}|{g}".encode()).hexdigest(), g, n) for g, n, t in rows):
        fold = sizes.index(min(sizes))
        out[name], sizes[fold] = fold, sizes[fold] + n
    return out, sizes


@pytest.mark.parametrize(("count", "strata"), [(12, 12), (24, 8), (200, 3), (60, 1)])
def test_greedy_folds_are_those_of_the_rule(spark, count, strata):
    rows = [(f"g{i}", (i * i) % 7 + (40 if i % 29 == 5 else 0) + (i < 20), f"t{i % strata:02d}") for i in range(count)]
    df = spark.createDataFrame(rows, "group string, rows int, t string")
    got = selection.greedy_group_folds(df, 5, 7, strata=["t"]).collect()
    want, sizes = greedy(rows, 5, 7)
    assert {r.group: r.fold for r in got} == want and len(got) == count
    assert max(sizes) - min(sizes) <= max(n for _, n, _ in rows)


def test_phases_deal_like_the_rule():
    import random

    rng = random.Random(3)
    for _ in range(300):
        k, size, count = rng.randrange(1, 7), rng.randrange(0, 5), rng.randrange(0, 60)
        sizes = [rng.randrange(0, 40) for _ in range(k)]
        after, want = list(sizes), []
        for _ in range(count):
            want.append(after.index(min(after)))
            after[want[-1]] += size
        phases = selection._phases(sizes, count, size)
        got = [turn[(p - at) % len(turn)] for p in range(count) for at, turn in [[x for x in phases if x[0] <= p][-1]]]
        assert got == want and sizes == after and len(phases) <= k + 1


def test_a_part_without_groups_fails(spark):
    few = spark.createDataFrame([(f"g{i}", 2) for i in range(3)], "group string, rows int")
    with pytest.raises(ValueError, match="no group"):
        selection.greedy_group_folds(few, 5, 7)
    folds = selection.greedy_group_folds(few, 3, 7)
    none = few.withColumn("validation", F.lit(False))
    with pytest.raises(ValueError, match="no val"):
        selection.fold_parts(folds, 1, none)
    spread = selection.stratified_group_folds(spark.createDataFrame([(f"g{i}", 1, f"t{i}", float("nan") if i % 2 else float(i)) for i in range(12)], "group string, rows int, territory string, speed double"), 4, 5, 1)
    assert sorted(r["count"] for r in spread.groupBy("fold").count().collect()) == [2, 2, 2, 3, 3]


def test_early_stop_counts_only_accepted_improvements(spark):
    h = spark.createDataFrame([("r", e, v) for e, v in enumerate([1.0, 0.95, 0.91, 0.8, 0.79, 0.78])], "run string, epoch int, loss double")
    r = selection.early_stop(h, "run", "epoch", "loss", 0.1, 2).first()
    assert (r.best, r.best_epoch, r.stop_epoch) == (1.0, 0, 2)


def test_extentless_sample_is_refused(spark):
    flat = spark.createDataFrame([("a", 1.0, 1.0, 1.0)] * 2, "sample_id string, x double, y double, z double")
    with pytest.raises(PySparkException):
        selection.normalised(flat).collect()


def brute_divergence(rows, k=8, subset=256):
    """Mean square divergence of (id, xyz, uvw) rows, one point after another."""
    drawn = sorted(rows, key=lambda r: (hashlib.md5(f"0|{r[0]}".encode()).hexdigest(), r[0]))[:subset]
    total = 0.0
    for _, p, q in drawn:
        near = sorted((math.dist(p, b), i, b, f) for i, b, f in drawn)[1 : k + 1]
        sigma = max(np.mean([d for d, *_ in near]), 1e-4)
        w = np.exp([-d / sigma for d, *_ in near])
        dp, dv = (np.array([np.subtract(n[j], o) for n in near]) for j, o in ((2, p), (3, q)))
        c = (dp * w[:, None]).T @ dp + 1e-4 * np.eye(3)
        total += np.trace((dv * w[:, None]).T @ dp @ np.linalg.inv(c)) ** 2
    return total / len(drawn)


def test_divergence_of_all_points_is_that_of_brute_force(spark, sf_dir, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(s, i, *map(float, rng.normal(size=6))) for s, n in (("a", 300), ("b", 60)) for i in range(n)]
    given = spark.createDataFrame(rows, "sample_id string, point_id long, x double, y double, z double, u double, v double, w double")
    monkeypatch.setattr(proxy_queries, "framed", lambda *_: given)
    monkeypatch.setattr(proxies, "bank", lambda df: df)
    monkeypatch.setattr(proxies, "compact", lambda df: df)
    got = {r.sample_id: r.divergence for r in proxy_queries.l11_divergence(spark, sf_dir).collect()}
    want = {s: brute_divergence([(r[1], r[2:5], r[5:8]) for r in rows if r[0] == s]) for s in "ab"}
    assert set(got) == set(want) and all(abs(got[s] - want[s]) <= 1e-5 * max(1, want[s]) for s in want)


def test_split_positions_list_every_row(spark):
    rows = [(("a", "b", None)[i % 3], i * 7 % 500 if i % 50 else None) for i in range(400)]
    got = selection.split_positions(spark.createDataFrame(rows, "s string, i long"), "s", "i").collect()
    for s in ("a", "b", None):
        mine = sorted((r.position, r["index"]) for r in got if r.split == s)
        assert mine == list(enumerate(sorted(i for x, i in rows if x == s and i is not None)))
    assert selection.split_positions(spark.createDataFrame([], "s string, i long"), "s", "i").count() == 0


def plain_network(rows, encoder, router):
    """The routing weights of (features, trajectory) rows, one number after another."""
    gelu = lambda x: 0.5 * x * (1 + math.erf(x / math.sqrt(2)))
    layer = lambda v, w, b: [sum(x * w[i][j] for i, x in enumerate(v)) + b[j] for j in range(len(b))]

    def norm(v, scale, shift):
        mean = sum(v) / len(v)
        sd = math.sqrt(sum((x - mean) ** 2 for x in v) / len(v) + 1e-5)
        return [(x - mean) / sd * a + b for x, a, b in zip(v, scale, shift, strict=True)]

    out = []
    for features, walk in rows:
        steps = []
        for k in range(3):
            h = [gelu(x) for x in norm(layer(walk[3 * k : 3 * k + 3], encoder["w1"], encoder["b1"]), encoder["n1_scale"], encoder["n1_shift"])]
            steps.append([gelu(x) + s for x, s in zip(layer(h, encoder["w2"], encoder["b2"]), encoder["step"][k], strict=True)])
        pooled = [sum(c) / 3 for c in zip(*steps, strict=True)] + [max(c) for c in zip(*steps, strict=True)]
        code = [gelu(x) for x in norm(layer(pooled, encoder["w3"], encoder["b3"]), encoder["n3_scale"], encoder["n3_shift"])]
        h = [gelu(x) for x in layer([*features, *code], router["w1"], router["b1"])]
        h = layer([gelu(x) for x in layer(h, router["w2"], router["b2"])], router["w3"], router["b3"])
        e = [math.exp(x - max(h)) for x in h]
        out.append([x / sum(e) for x in e])
    return out


def test_routing_weights_and_learned_basis_number_by_number(spark):
    rng = np.random.default_rng(4)
    encoder, router = inference.seeded_weights(inference.trajectory_shapes(), 1), inference.seeded_weights(inference.gate_shapes(2 + 16), 2)
    rows = [(i, *map(float, rng.normal(size=2)), [float(x) for x in rng.normal(size=9) * 3]) for i in range(12)]
    df = spark.createDataFrame(rows, "i int, f double, g double, trajectory array<double>")
    got = {r.i: r.weights for r in inference.routing_weights(df, encoder, router, ["i"], ["f", "g"]).collect()}
    want = plain_network([((f, g), t) for _, f, g, t in rows], encoder, router)
    assert all(np.allclose(got[i], w, atol=1e-6) for i, w in enumerate(want))
    basis = inference.seeded_weights(inference.basis_shapes(2, 2, 5), 3)
    gelu = np.vectorize(lambda x: 0.5 * x * (1 + math.erf(x / math.sqrt(2))))
    for r in inference.learned_basis(df, basis, ["i"], ["f", "g"]).collect():
        h = np.array(rows[r.i][1:3])
        for k in (1, 2):
            h = h @ basis[f"w{k}"] + basis[f"b{k}"]
            h = gelu((h - h.mean()) / np.sqrt(h.var() + 1e-5) * basis[f"n{k}_scale"] + basis[f"n{k}_shift"])
        assert np.allclose(r.modes, gelu(h @ basis["w3"] + basis["b3"]) @ basis["w4"] + basis["b4"], atol=1e-6)


def test_error_function_over_arrays():
    x = np.linspace(-6, 6, 2001)
    assert np.abs(inference._erf(x) - np.array([math.erf(v) for v in x])).max() < 2e-7


def test_interior_points_repeat_and_fail(spark):
    thin = spark.createDataFrame([("tet", 0, *map(float, (0, 0, 0, 0, 1, 0, 1, 0, 0))), ("tet", 1, *map(float, (0, 0, 0, 1, 0, 0, 0, 0, 1))), ("tet", 2, *map(float, (0, 0, 0, 0, 0, 1, 0, 1, 0))), ("tet", 3, *map(float, (1, 0, 0, 0, 1, 0, 0, 0, 1)))], "mesh_id string, tri int, " + ", ".join(f"{p}_{x} double" for p in "abc" for x in "xyz"))
    rows = sampling.interior_points(thin, 40, 30, 1, rounds=2).collect()
    found = rows[0].found
    assert 0 < found < 40 and len(rows) == 40 and len({r.k for r in rows}) == found and all(r.x + r.y + r.z < 1 for r in rows)
    assert sampling.interior_points(thin, 40, 30, 1, rounds=2, least=39).count() == 0
    whole = sampling.interior_points(thin, 40, 60, 1)
    assert whole.count() == 40 and {r.copy for r in whole.collect()} == {0}


def test_a_sample_outside_the_root_fails(spark):
    from flowloom.operators import datasets

    rows = spark.createDataFrame([("/root/a",), ("/rooted/b",)], "path string")
    with pytest.raises(PySparkException):
        datasets.audited(rows, "/root").collect()
    with pytest.raises(ValueError, match="no fold"):
        datasets_folds = spark.createDataFrame([(0, "train", 0, 1)], "fold int, role string, position int, index int")
        selection.strict_folds(datasets_folds, datasets_folds, 3, "val")
