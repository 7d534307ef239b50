from __future__ import annotations

import numpy as np
import pytest

from flowloom.operators import scenes


def matrix(rng):
    return rng.normal(size=(3, 4))


def test_two_levels_and_a_long_chain(spark):
    rng = np.random.default_rng(1)
    m = {n: matrix(rng) for n in range(4)}
    rows = [("s", 0, None, m[0].ravel().tolist(), None), ("s", 1, 0, m[1].ravel().tolist(), "t"), ("s", 2, 1, m[2].ravel().tolist(), "t"), ("s", 3, 99, m[3].ravel().tolist(), "none"), ("s", 4, 0, None, "t")]
    rows += [("long", i, i - 1 if i else None, [1.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0], "t" if i == 199 else None) for i in range(200)]
    nodes = spark.createDataFrame(rows, "scene string, node long, parent long, matrix array<double>, mesh_id string")
    tri = rng.normal(size=(3, 3))
    mesh = spark.createDataFrame([("t", 0, *map(float, tri.ravel()))], "mesh_id string, tri int, " + ", ".join(f"{c}_{x} double" for c in "abc" for x in "xyz"))
    got = {(r.scene, r.node): np.array(r[3:]).reshape(3, 3) for r in scenes.placed(scenes.world_transforms(nodes), mesh).collect()}
    go = lambda t, p: p @ t[:, :3].T + t[:, 3]
    want = {("s", 1): go(m[0], go(m[1], tri)), ("s", 2): go(m[0], go(m[1], go(m[2], tri))), ("s", 4): go(m[0], tri), ("long", 199): tri + [200, 0, 0]}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


def test_a_circle_of_parents_fails(spark):
    nodes = spark.createDataFrame([("s", 0, 1, None), ("s", 1, 0, None)], "scene string, node long, parent long, matrix array<double>")
    with pytest.raises(ValueError, match="each other's parents"):
        scenes.world_transforms(nodes)
