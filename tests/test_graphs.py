"""Components and parities against union-find, on stars, paths and random graphs."""

from __future__ import annotations

import random

import pytest

from flowloom.operators import graphs


def plain(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("hub", [3, 100_000])
def test_components_of_any_shape(spark, monkeypatch, hub):
    monkeypatch.setattr(graphs, "HUB", hub)
    rng = random.Random(hub)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(500, 501 + i) for i in range(80)] + [(1000 + i, 1001 + i) for i in range(40)] + [(None, 3), (7, 7)]
    got = graphs.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.component for r in got} == plain(edges)
    assert all(r.flip == 0 for r in got)


def test_parity_follows_the_edges(spark):
    rng = random.Random(5)
    side = [rng.randrange(2) for _ in range(50)]
    edges = [(i, rng.randrange(i)) for i in range(1, 50)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(60)]
    rows = [("m", a, b, side[a] ^ side[b]) for a, b in edges]
    df = spark.createDataFrame(rows, "m string, a long, b long, s int").selectExpr("struct(m, a as i) as p", "struct(m, b as i) as q", "s")
    from pyspark.sql import functions as F

    got = {r.node.i: r for r in graphs.connected_components(df, "p", "q", F.col("s")).collect()}
    assert len(got) == 50 and all(r.component.i == 0 and r.flip == side[i] ^ side[0] for i, r in got.items())


def test_a_hubs_rows_are_not_shuffled_under_one_key(spark, monkeypatch):
    """Of a star's edges none is left for the join by key: the hub is sent to them."""
    monkeypatch.setattr(graphs, "HUB", 1000)
    star = spark.range(1, 20_001).selectExpr("0L as v", "id as u", "0 as s")
    both = star.unionByName(star.selectExpr("u as v", "v as u", "s"))
    made = []
    linked, least = graphs._to_least(both, True, True, made)
    assert least.where("n > 1000").count() == 1
    assert linked.count() == 20_000 and linked.where("v = 0").count() == 20_000
    plan = linked._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan.lower()


def test_no_edges(spark):
    assert graphs.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
