"""Near-duplicate documents: an n-gram Jaccard join with Bayesian pruning of candidates.

1. Every document's distinct word shingles are hashed and sketched with MinHash in one pass; equal sets are one class.
2. Classes that agree in a band of the sketch are candidates. Buckets with the same members are one bucket.
3. In a bucket, MinHash values are compared a few at a time; a pair whose posterior probability of reaching
   the threshold falls below the tolerance is dropped. The rest connects classes into components.
4. In a component, all pairs are verified exactly, on the shingles of the whole texts.

Buckets and components larger than a block are dealt out as pairs of blocks, so no task holds one whole; tasks give a
number of links and a root for each member, never a row for each pair, and no bucket is capped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm._common import materialize, slices
from flowloom.llm._words import mix, shingles, words
from flowloom.operators.graphs import connected_components

HASHES, BAND = 128, 4  # 32 bands of 4: a pair at 0.8 agrees in none with probability 5e-8
_STEP = 16  # values compared before each decision
_MULTIPLIER = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_ADDEND = mix(np.arange(HASHES + 1, 2 * HASHES + 1, dtype=np.uint64))


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """After n compared values: the fewest matches with which P(similarity >= threshold) is at least ``tolerance``.

    With a uniform prior and m of n values matching, that probability is P(Binomial(n + 1, threshold) <= m).
    """
    found = {}
    for n in range(_STEP, HASHES + 1, _STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        found[n] = m
    return found


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after another, and where each begins (and the last ends)."""
    row, found = shingles(words(texts, lower=True), size)
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
    row, found = row[new], found[new]
    return found, np.searchsorted(row, np.arange(len(texts) + 1))


def _sketcher(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found, cut = shingle_sets(part.column("text"), size)
            count = np.diff(cut)
            some = np.flatnonzero(count)
            sketch = np.zeros((part.num_rows, HASHES), np.uint64)
            one, two = np.zeros((2, part.num_rows), np.uint64)
            if len(some):
                at, room = cut[some], np.empty_like(found)
                for i in range(HASHES):
                    np.multiply(found, _MULTIPLIER[i], out=room)
                    np.add(room, _ADDEND[i], out=room)
                    sketch[some, i] = np.minimum.reduceat(room, at)
                one[some], two[some] = np.add.reduceat(mix(found), at), np.bitwise_xor.reduceat(mix(found + np.uint64(7)), at)
            short = mix(sketch).astype(np.uint16)
            rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * HASHES), part.num_rows, [None, pa.py_buffer(np.ascontiguousarray(short))]).cast(pa.binary())
            yield pa.record_batch([part.column("id"), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(count, pa.int32()), rows], names=["id", "one", "two", "n", "sketch"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows that are sorted by ``keys``: a table and where each group begins (and the last ends)."""
    rest: list[pa.RecordBatch] = []

    def cuts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in keys:
            x = t.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.append(np.flatnonzero(new), t.num_rows)

    for batch in batches:
        rest.append(batch)
        ends = [tuple(b.column(k)[i].as_py() for k in keys) for b, i in ((rest[0], 0), (batch, batch.num_rows - 1)) if b.num_rows]
        if len(ends) < 2 or ends[0] == ends[1]:
            continue
        t = pa.Table.from_batches(rest)
        cut = cuts(t)
        yield t.slice(0, cut[-2]), cut[:-1]
        rest = t.slice(cut[-2]).to_batches()
    if rest and (t := pa.Table.from_batches(rest)).num_rows:
        yield t, cuts(t)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each member's component in a small graph."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def _linked(sketch: np.ndarray, begin: int, n: int, least: dict[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The surviving pairs of the rows from ``begin`` on, some rows against all later ones at a time."""
    strip = max(1, 100_000 // n)
    for a in range(0, n - 1, strip):
        rows = np.arange(a, min(a + strip, n - 1))
        count = n - 1 - rows
        i = np.repeat(rows, count)
        j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + i + 1
        yield survivors(sketch, begin + i, begin + j, least)


class _Forest:
    """Edges between rows, kept as a spanning forest so that they never take more room than the rows."""

    def __init__(self):
        self.a, self.b = np.zeros((2, 0), np.int64)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.a, self.b = np.concatenate([self.a, i]), np.concatenate([self.b, j])
        if len(self.a) > 200_000:
            self.a, self.b = _forest(self.a, self.b)


def _across(sketch: np.ndarray, begin: int, side: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Between two blocks: an edge for each pair of their inner components that are linked, as a forest.

    The components themselves are given by the task that compares the block with itself.
    """
    inner, cross = _Forest(), _Forest()
    for i, j in _linked(sketch, begin, len(side), least):
        same = side[i - begin] == side[j - begin]
        inner.add(i[same], j[same])
        cross.add(i[~same], j[~same])
    root = _roots(len(side), inner.a - begin, inner.b - begin)
    a, b = root[cross.a - begin], root[cross.b - begin]
    a, b = _forest(a, b) if len(a) else (a, b)
    return a + begin, b + begin


def _pruner(threshold: float, tolerance: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = least_matches(threshold, tolerance)
        tied: list[tuple[np.ndarray, np.ndarray]] = []
        for t, cut in _groups(batches, ["key", "low", "high"]):
            node, mine, low, high = (t.column(c).to_numpy() for c in ("rep", "mine", "low", "high"))
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(-1, HASHES)
            size, found = np.diff(cut), _Forest()
            for s in np.unique(size[size > 1]):
                begin = cut[:-1][size == s]
                two = low[begin] != high[begin]
                small = begin[~two] if s <= 32 else begin[:0]
                if len(small):  # many groups of one size at a time
                    i, j = np.triu_indices(s, 1)
                    for some in np.array_split(small, -(-len(small) * len(i) // 100_000)):
                        found.add(*survivors(sketch, (some[:, None] + i).ravel(), (some[:, None] + j).ravel(), least))
                for b in begin[two]:
                    found.add(*_across(sketch, b, mine[b : b + s] != low[b], least))
                for b in begin[~two] if s > 32 else begin[:0]:
                    for i, j in _linked(sketch, b, s, least):
                        found.add(i, j)
            if len(found.a):
                tied.append(_forest(node[found.a], node[found.b]))
                if sum(len(a) for a, _ in tied) > 200_000:
                    tied = [_forest(*(np.concatenate(x) for x in zip(*tied, strict=True)))]
        if tied:
            a, b = _forest(*(np.concatenate(x) for x in zip(*tied, strict=True)))
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the same components, fewer than nodes: each node with the smallest of its component."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = _roots(len(node), at[: len(a)], at[len(a) :])
    hangs = np.flatnonzero(root != np.arange(len(node)))
    return node[hangs], node[root[hangs]]


def survivors(sketch: np.ndarray, i: np.ndarray, j: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no comparison dropped."""
    matches = np.zeros(len(i), np.int32)
    for n, m in least.items():
        matches += (sketch[i, n - _STEP : n] == sketch[j, n - _STEP : n]).sum(1, dtype=np.int32)
        keep = matches >= m
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 4096) -> np.ndarray:
    """How many shingles each of ``left`` shares with each of ``right``, by products of 0/1 matrices in bounded strips."""
    who = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, which, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[which] > 1
    who, which = who[shared], which[shared]
    _, which = np.unique(which, return_inverse=True)
    order = np.argsort(which, kind="stable")
    who, which = who[order], which[order]
    total, top = np.zeros((len(left), len(right)), np.float64), int(which[-1]) + 1 if len(which) else 0
    for c in range(0, top, columns):
        a, b = np.searchsorted(which, (c, c + columns))
        strip = np.zeros((len(sets), min(columns, top - c)), np.float32)
        strip[who[a:b], which[a:b] - c] = 1
        total += strip[left] @ strip[right].T
    return total


def _verifier(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cut in _groups(batches, ["component", "low", "high"]):
            node, mine, copies, low, high, blocks = (t.column(c).to_numpy() for c in ("node", "mine", "copies", "low", "high", "blocks"))
            sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
            for b, e in zip(cut[:-1], cut[1:], strict=True):
                seen = {(node[k], len(sets[k]), hash(sets[k].tobytes())): k for k in range(b, e)}  # a row that repeats counts once
                own = np.array(sorted(seen.values(), key=lambda k: node[k]))  # so that a root is the smallest node
                left, right = (own, own) if low[b] == high[b] else (own[mine[own] == low[b]], own[mine[own] == high[b]])
                if not len(left) or not len(right):
                    continue
                at = {k: i for i, k in enumerate(own)}
                l, r = np.array([at[k] for k in left]), np.array([at[k] for k in right])
                size = np.array([len(sets[k]) for k in own], np.float64)
                both = intersections([sets[k] for k in own], l, r)
                linked = (both >= (threshold - 1e-12) * (size[l][:, None] + size[r][None, :] - both)) & (node[left][:, None] != node[right][None, :])
                links = np.zeros(len(own), np.int64)
                links[l] += linked @ copies[right]
                if low[b] != high[b]:
                    links[r] += copies[left] @ linked
                i, j = np.nonzero(linked)
                root = _roots(len(own), l[i], r[j])
                yield pa.record_batch([pa.array(node[own]), pa.array(links), pa.array(node[own][root]), pa.array(blocks[own])], names=["node", "links", "root", "blocks"])

    return run


def _setter(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found, cut = shingle_sets(part.column("text"), size)
            sets = [found[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.record_batch([*part.columns[:-1], pa.array(sets, pa.binary())], names=[*part.schema.names[:-1], "set"])

    return run


#: Shingles that a block of texts holds, besides those of its longest text: 32 MB of hashes.
BLOCK_SHINGLES = 4 << 20


def _dealt(rows: DataFrame, group: str, node: str, blocks: Column) -> DataFrame:
    """Each member once for every pair of blocks of its group that its own block is in."""
    blocks = rows.withColumn("blocks", blocks.cast("int")).withColumn("mine", F.pmod(F.xxhash64(node), "blocks").cast("int"))
    other = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = other.withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")}).drop("other")
    return pairs.repartition(group, "low", "high").sortWithinPartitions(group, "low", "high")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, tolerance: float = 1e-5, block: int = 1024) -> DataFrame:
    """A row for each row of ``docs``: id_col, representative, class_id, n_links, n_shingles.

    Words are runs without white space, in lower case; a text of fewer than ``size`` words, but one at least, has one
    shingle. Two documents are linked if the Jaccard similarity of their shingle sets is ``threshold`` or more;
    n_links is the number of other documents that a document is linked to, class_id the smallest id of those it is
    linked to over any number of links, representative the smallest id of those with the same shingles. A null or
    empty text and one of white space have no shingles and no links. A row with a null id is not compared. Rows that
    share an id count as copies if their shingles are equal, else as one document with several texts.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sketches = materialize(texts.mapInArrow(_sketcher(size), f"id {kind}, one long, two long, n int, sketch binary"), "sketches")
    same = ["one", "two", "n"]
    classes = materialize(sketches.where("n > 0 and id is not null").groupBy(same).agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("sketch").alias("sketch")), "classes")
    band: Callable[[Column], Column] = lambda j: F.xxhash64(j, F.substring(F.col("sketch"), j * (2 * BAND) + 1, F.lit(2 * BAND)))
    bands = classes.select("rep", F.explode(F.transform(F.sequence(F.lit(0), F.lit(HASHES // BAND - 1)), band)).alias("key"))
    shared = bands.groupBy("key").count().where("count > 1").select("key")
    members = materialize(bands.join(shared, "key", "left_semi"), "members")
    signature = members.groupBy("key").agg(F.count("*").alias("members"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("x"))
    buckets = signature.groupBy("members", "s", "x").agg(F.min("key").alias("key")).select("key", "members")
    compared = members.join(buckets, "key").join(classes.select("rep", "sketch"), "rep").select("key", "rep", "members", "sketch")
    edges = _dealt(compared, "key", "rep", F.ceil(F.col("members") / block)).mapInArrow(_pruner(threshold, tolerance), f"a {kind}, b {kind}")
    component = materialize(connected_components(edges).select("node", "component"), "components")
    nodes = component.join(classes.groupBy(F.col("rep").alias("node")).agg(F.max("copies").alias("copies"), F.max("n").alias("n")), "node")
    sizes = nodes.groupBy("component").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    alike = nodes.join(sizes, "component")
    whole = alike.join(texts.withColumnRenamed("id", "node"), "node").select("component", "node", "members", "shingles", "copies", "text")
    sets = whole.mapInArrow(_setter(size), f"component {kind}, node {kind}, members long, shingles long, copies long, set binary")
    blocks = F.ceil(F.greatest(F.col("members") / max(1, block // 4), F.col("shingles") / BLOCK_SHINGLES))
    verified = materialize(_dealt(sets, "component", "node", blocks).mapInArrow(_verifier(threshold), f"node {kind}, links long, root {kind}, blocks int"), "verified")
    large = verified.where("blocks > 1")
    roots = verified.where("blocks = 1").select("node", "root")
    if not large.isEmpty():
        roots = roots.unionByName(connected_components(large.select(F.col("node").alias("a"), F.col("root").alias("b"))).select("node", F.col("component").alias("root")))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    told = classes.select(*same, "rep", "copies").join(links.join(roots.groupBy("node").agg(F.min("root").alias("root")), "node", "left").withColumnRenamed("node", "rep"), "rep", "left")
    out = sketches.select("id", *same).join(told, same, "left")
    counted = F.col("id").isNotNull() & F.col("rep").isNotNull()
    return out.select(
        F.col("id").alias(id_col), F.when(counted, F.col("rep")).otherwise(F.col("id")).alias("representative"), F.when(counted, F.coalesce("root", "rep")).otherwise(F.col("id")).alias("class_id"),
        F.when(counted, F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"), F.col("n").cast("long").alias("n_shingles"),
    )
