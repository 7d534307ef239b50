"""Running numbers against a plain loop, with groups that reach over many ranges."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from flowloom.operators import datasets, ranges
from flowloom.operators.ranges import BASE, running


def expected(rows):
    """group -> (order, position, sum before, prefix number) of its rows."""
    out = {}
    for g in {r[0] for r in rows}:
        mine, total, prefix = sorted((r for r in rows if r[0] == g), key=lambda r: r[1]), 0, 0
        for i, (_, o, v) in enumerate(mine):
            prefix = (prefix + (v or 0) * pow(BASE, i, 2**64)) % 2**64
            out[g, o] = (i, total, total + (v or 0), prefix)
            total += v or 0
    return out


@pytest.mark.parametrize("batch", [3, 10_000])
def test_groups_reach_over_ranges_and_batches(spark, batch):
    rng = random.Random(batch)
    rows = [("hot", i, rng.randrange(100)) for i in range(400)] + [(None, i, None) for i in range(30)] + [(f"g{i}", j, j - 3) for i in range(60) for j in range(i % 4)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = running(spark.createDataFrame(rows, "g string, o long, n long").selectExpr("*", "n as p"), ["g"], ["o"], ["n"], ["p"], parts=7).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = expected(rows)
    assert len(got) == len(rows)
    assert {(r.g, r.o): (r.position, r.n_before, r.n_through, r.p_through % 2**64) for r in got} == want


def test_no_group_and_an_empty_table(spark):
    got = running(spark.range(1000).selectExpr("999 - id as k"), [], ["k"], parts=5).collect()
    assert sorted((r.k, r.position) for r in got) == [(i, i) for i in range(1000)]
    assert running(spark.createDataFrame([], "g string, o long"), ["g"], ["o"]).count() == 0


def largest_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_tasks_of_a_join_by_place_hold_so_many_rows_at_most(spark, monkeypatch):
    """One mesh of numbers that compress to a few bytes: by bytes it would be one task's, both in making the rows and in joining them."""
    monkeypatch.setattr(ranges, "TASK_ROWS", 500)
    mesh = spark.range(10_000).selectExpr("'m' as mesh", "id * 3 as node", "id * 0.5 as x")
    rows = datasets.numbered_rows(spark.createDataFrame([("m", 10_000), ("none", 0)], "mesh string, n long"), "mesh", "n", "row", block=100)
    assert largest_task(rows) <= 1500
    joined = datasets.mesh_solution(mesh, rows.withColumn("p", F.col("row") + 1), "mesh", "node", "row", ["x"])
    assert largest_task(joined) <= 1500
    assert sorted((r.row, r.node, r.x, r.p) for r in joined.collect()) == [(i, 3 * i, i * 0.5, i + 1) for i in range(10_000)]


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 17])
def test_rows_numbered_in_blocks(spark, n):
    counts = spark.createDataFrame([("a", n), (None, 3)], "g string, n int")
    got = datasets.numbered_rows(counts, "g", "n", "row", block=8).collect()
    assert sorted((r.g or "", r.row) for r in got) == [("", i) for i in range(3)] + [("a", i) for i in range(n)]
