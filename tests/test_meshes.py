"""Mesh queries by tiles against plain NumPy, and how their work grows when a mesh is refined."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import geometry, quality_control

COLS = [f"{p}_{x}" for p in "abc" for x in "xyz"]


def sphere(rings: int) -> np.ndarray:
    """Triangles (n, 3, 3) of a unit sphere of rings x 2 rings cells."""
    t = np.linspace(0, math.pi, rings + 1)
    f = np.linspace(0, 2 * math.pi, 2 * rings + 1)
    at = lambda i, j: np.array([math.sin(t[i]) * math.cos(f[j]), math.sin(t[i]) * math.sin(f[j]), math.cos(t[i])])
    out = []
    for i in range(rings):
        for j in range(2 * rings):
            a, b, c, d = at(i, j), at(i + 1, j), at(i + 1, j + 1), at(i, j + 1)
            out += [[a, b, c]] * (i < rings - 1) + [[a, c, d]] * (i > 0)
    return np.array(out)


def table(spark, triangles):
    rows = [("m", i, *map(float, t.ravel())) for i, t in enumerate(triangles)]
    return spark.createDataFrame(rows, "mesh_id string, tri int, " + ", ".join(f"{c} double" for c in COLS))


@pytest.fixture(scope="module")
def points():
    return np.random.default_rng(5).uniform(-1.6, 1.6, (150, 3))


@pytest.fixture(scope="module")
def at(spark, points):
    walk = np.random.default_rng(6).normal(size=points.shape)
    walk /= np.linalg.norm(walk, axis=1, keepdims=True)
    walk[:3] = np.eye(3)  # along the axes
    rows = [("m", i, *map(float, p), *map(float, w), 0.9) for i, (p, w) in enumerate(zip(points, walk, strict=True))]
    return spark.createDataFrame(rows, "mesh_id string, point_id int, x double, y double, z double, walk_x double, walk_y double, walk_z double, step double")


def hit(o, d, step, triangles):
    best = None
    for a, b, c in triangles:
        e1, e2 = b - a, c - a
        h = np.cross(d, e2)
        det = e1 @ h
        if abs(det) <= 1e-12:
            continue
        s = o - a
        u, q = s @ h / det, np.cross(s, e1)
        v, t = d @ q / det, e2 @ q / det
        if u >= 0 and v >= 0 and u + v <= 1 and 0 <= t <= step and (best is None or t < best):
            best = t
    return best


def test_tiles_change_no_answer(spark, points, at):
    mesh = sphere(10)
    keys, t = ["mesh_id", "point_id"], table(spark, mesh)
    r = np.linalg.norm(points, axis=1)
    near = {x.point_id: x for x in geometry.closest_points(at, t, keys).collect()}
    fine = np.linspace(0, 1, 12)
    grid = np.array([(u, v) for u in fine for v in fine if u + v <= 1])
    dense = mesh[:, 0, None] + (mesh[:, 1] - mesh[:, 0])[:, None] * grid[:, :1] + (mesh[:, 2] - mesh[:, 0])[:, None] * grid[:, 1:]
    for i, p in enumerate(points):
        brute = np.linalg.norm(dense.reshape(-1, 3) - p, axis=1).min()
        assert near[i].dist <= brute + 1e-9 and near[i].dist >= abs(1 - r[i]) - 0.05 and near[i].dist > brute - 0.05
    inside = {x.point_id: x for x in geometry.winding_numbers(at, t, keys).collect()}
    assert all(inside[i].inside == (r[i] < 1) for i in inside if abs(r[i] - 1) > 0.03) and len(inside) == len(points)
    assert all(abs(abs(inside[i].winding) - (r[i] < 1)) < 0.05 for i in inside if abs(r[i] - 1) > 0.1)
    hits = {x.point_id: x.hit for x in geometry.first_hits(at, t, keys).collect()}
    for x in at.collect():
        want = hit(np.array([x.x, x.y, x.z]), np.array([x.walk_x, x.walk_y, x.walk_z]), x.step, mesh)
        assert (hits[x.point_id] is None) == (want is None) and (want is None or abs(hits[x.point_id] - want) < 1e-9)


def test_work_does_not_grow_with_a_mesh_as_it_is_refined(spark, at):
    coarse, fine = (geometry.near_triangles(at, table(spark, sphere(n))).count() for n in (6, 24))
    assert fine < 8 * coarse  # 16 times the triangles


def test_the_largest_component_stays(spark):
    rows = [("m", i, *f) for i, f in enumerate([(1, 2, 3), (2, 3, 4), (10, 11, 12), (11, 12, 13), (12, 13, 14)])] + [("k", i, *f) for i, f in enumerate([(1, 2, 3), (7, 8, 9)])] + [("long", i, i, i + 1, i + 2) for i in range(300)]
    faces = spark.createDataFrame(rows, "mesh_id string, tri int, a long, b long, c long")
    kept = quality_control.largest_component(faces).groupBy("mesh_id").agg(F.sort_array(F.collect_list("tri")).alias("t")).collect()
    assert {r.mesh_id: r.t for r in kept} == {"m": [2, 3, 4], "k": [0], "long": list(range(300))}


def test_walks_in_a_cube_step_by_step(spark):
    """Every step's displacement, against a box's nearest point and slab test."""
    from flowloom.plans.geometry_queries import HALF, cubes

    rng = np.random.default_rng(8)
    start = rng.uniform(-0.14, 0.14, (40, 3))
    walk = rng.normal(size=(40, 3))
    walk /= np.linalg.norm(walk, axis=1, keepdims=True)
    rows = [("s1", i, *map(float, p), *map(float, w), 0.06, i % 5 == 0) for i, (p, w) in enumerate(zip(start, walk, strict=True))]
    walkers = spark.createDataFrame(rows, "mesh_id string, point_id int, x double, y double, z double, walk_x double, walk_y double, walk_z double, step double, is_wall boolean")
    got = {(r.point_id, r.walk_step): (r.dx, r.dy, r.dz) for r in geometry.constrained_walk(walkers, cubes(spark), ["mesh_id", "point_id"]).collect()}
    assert len(got) == 120
    for i in range(40):
        p = start[i].copy()
        for k in range(3):
            axis = int(np.argmax(np.abs(p)))
            wall = p.copy()
            wall[axis] = math.copysign(HALF, p[axis])
            assert np.allclose(got[i, k], p - wall, atol=1e-9)
            if i % 5:
                t = min((math.copysign(HALF, w) - x) / w for x, w in zip(p, walk[i], strict=True) if w)
                p = p + walk[i] * (t * 0.99 if t <= 0.06 else 0.06)
