"""Connected components of a graph given as a table of edges, with a parity along edges if they have one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.session import delete, scratch

#: Nodes of so many neighbours or more are hubs, if no more than MOST_HUBS are.
HUB, MOST_HUBS = 100_000, 50_000


def _stored(df: DataFrame, name: str, made: list[str]) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _to_least(edges: DataFrame, own: bool, larger: bool, made: list[str]) -> tuple[DataFrame, DataFrame]:
    """For every u of ``edges`` (u, v, s): its neighbours linked to its least neighbour (or itself, if ``own``), and these least ones.

    A hub's neighbours are many rows of one key: hubs are sent to them instead. So many neighbours make a hub that there
    are ``MOST_HUBS`` at most, whatever the graph, and no key that is shuffled holds more than a 50,000th of all edges, or ``HUB``.
    """
    least = edges.groupBy("u").agg(F.min(F.struct("v", "s")).alias("m"), F.count("*").alias("n"))
    least = _stored(least.select("u", F.when(F.lit(own) & (F.col("u") < F.col("m.v")), F.struct(F.col("u").alias("v"), F.lit(0).alias("s"))).otherwise(F.col("m")).alias("m"), "n"), "least", made)
    limit = max(HUB, (least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // MOST_HUBS)
    hubs = least.where(F.col("n") > limit).select("u", "m")
    rows = edges.where("v > u") if larger else edges
    told = rows.join(F.broadcast(hubs), "u", "left")
    linked = told.where("m is not null").unionByName(told.where("m is null").drop("m").join(least.select("u", "m"), "u"))
    return linked.select(F.col("v").alias("u"), F.col("m.v").alias("v"), F.col("s").bitwiseXOR(F.col("m.s")).alias("s")), least


def _once(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").groupBy("u", "v").agg(F.min("s").alias("s"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", sign: Column | None = None) -> DataFrame:
    """(node, component, flip): every node of ``edges`` with the smallest node of its component, and its parity against that one.

    ``sign`` is 0 where an edge's ends are of one parity and 1 where they differ (without it, all flips are 0). Where a circle
    of edges contradicts itself, a flip is that of one way; compare them along all edges to find such components. Nodes are of any type that
    Spark orders; null ends and loops are left out.

    Alternating large-star and small-star steps: each links neighbours to the smallest one, once to all larger
    neighbours, once to all smaller ones, until every node hangs on its component's smallest. A round's edges are
    a table in the shared folder; only sizes and checksums come to the driver.
    """
    spark, last, seen = edges.sparkSession, [], None
    s = F.lit(0) if sign is None else sign.cast("int")
    now = _once(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), s.alias("s")))
    while True:
        made: list[str] = []
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"), "s"))
        large = _stored(_once(_to_least(both, True, True, made)[0]), "large", made)
        moved, low = _to_least(large, False, False, made)
        small = _once(moved.unionByName(low.select("u", F.col("m.v").alias("v"), F.col("m.s").alias("s"))))
        kept: list[str] = []
        now = _stored(small, "edges", kept)
        for path in last + made:
            delete(spark, path)
        last = kept
        sums = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if sums == seen:
            break
        seen = sums
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"), F.lit(0).alias("flip")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"), F.col("s").alias("flip")).unionByName(roots)
