"""The trie of conversations' prefixes, from partial tries that are merged by the hash of the prefix.

A node is a sequence of turns; its key is its depth and a 256-bit number of the prefix, in which each turn's SHA-256 is
weighted by its place. Each partition combines its rows to a table of nodes, and merges, first within salts and then
over all, add up members and take the smallest. Lists of the members that end in a node are merged in parts of bounded
length. What a subtree holds is rolled up from below along one path for each node: that of its smallest member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm._common import materialize
from flowloom.operators.ranges import running

#: The four 64-bit parts of a prefix's number.
LANES = [f"k{i}" for i in range(4)]
KEY = ["depth", *LANES]
MERGE_SALTS = 64


def turns_of(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, at, chars, digest and its four lanes of each turn, at from 0 by turn (null first); turns that tie come by digest. Null ids are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    return running(rows, ["conv"], ["turn", "digest"]).select("conv", F.col("position").alias("at"), "digest", "chars")


def _lane(digest: Column, i: int) -> Column:
    """Sixteen hexadecimal digits as a long: halves, for a whole one may be beyond its range."""
    half = lambda k: F.conv(F.substring(digest, 16 * i + 8 * k + 1, 8), 16, 10).cast("long")
    return F.shiftleft(half(0), 32).bitwiseOR(half(1))


def with_shared_heads(turns: DataFrame, base: Column, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations, and the turns of each rebuilt one in order: the first ``heads`` turns of conversation ``base``, then its own after as many.

    ``base`` and ``heads`` are expressions of ``conv``; heads are ``most`` at most. A conversation may be left without turns.
    """
    convs = materialize(turns.where("at = 0").select("conv"), "trie-conversations")
    own = turns.where(F.col("at") >= heads).select("conv", F.lit(1).alias("part"), "at", "digest", "chars")
    wanted = convs.select("conv", base.alias("base"), heads.alias("heads"))
    shared = turns.where(F.col("at") < most).select(F.col("conv").alias("base"), "at", "digest", "chars")
    shared = wanted.where("heads > 0").join(shared, "base").where("at < heads").select("conv", F.lit(0).alias("part"), "at", "digest", "chars")
    return convs, own.unionByName(shared)


def _merged(nodes: DataFrame) -> DataFrame:
    """Partial node tables, merged by key within salts and then over all; Spark combines each partition's rows before it sends them."""
    whole = [F.sum("members").alias("members"), F.min("conv").alias("conv"), F.max("chars").alias("chars"), *(F.max(f"parent_{k}").alias(f"parent_{k}") for k in LANES)]
    for salt in ([F.pmod(F.xxhash64("conv"), F.lit(MERGE_SALTS)).alias("salt")], []):
        nodes = nodes.groupBy(*KEY, *salt).agg(*whole).drop("salt")
    return nodes


def _hash_of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of parts in the order of node and part: each node's SHA-256, with one part in memory at a time."""
    last, hasher = None, None
    done = lambda key, h: pa.record_batch([*(pa.array([k], pa.int64()) for k in key), pa.array([h.hexdigest()])], names=[*KEY, "ends_sha256"])
    for batch in batches:
        for *key, text in zip(*(batch.column(c).to_pylist() for c in (*KEY, "text")), strict=True):
            if key != last:
                if last is not None:
                    yield done(last, hasher)
                last, hasher = key, hashlib.sha256(text.encode())
            else:
                hasher.update(b"," + text.encode())
    if last is not None:
        yield done(last, hasher)


def end_hashes(ends: DataFrame, width: int = 10_000) -> DataFrame:
    """KEY, ends_sha256: the SHA-256 of the ids that end in each node, ascending and joined by commas.

    Lists are made for ranges of ``width`` ids, so none is longer. A node with one list is hashed where it is; the others'
    lists are streamed through the hash in order.
    """
    part = F.floor(F.col("conv") / F.lit(width)).cast("long")
    parts = ends.groupBy(*KEY, part.alias("part")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("text"))
    parts = materialize(parts, "trie-ends")
    count = parts.groupBy(*KEY).agg(F.count("*").alias("parts"), F.max("text").alias("text"))
    count = materialize(count.select(*KEY, "parts", F.when(F.col("parts") == 1, F.sha2("text", 256)).alias("ends_sha256")), "trie-end-hashes")
    long = parts.join(count.where("parts > 1").select(*KEY), KEY).select(*KEY, "part", "text")
    streamed = long.repartition(*KEY).sortWithinPartitions(*KEY, "part").mapInArrow(_hash_of_parts, ", ".join(f"{k} bigint" for k in KEY) + ", ends_sha256 string")
    return count.where("parts = 1").select(*KEY, "ends_sha256").unionByName(streamed)


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``convs`` has every conversation (conv), ``turns`` their turns (conv, part, at, digest, chars; in the order of part and at).
    A node's members are the conversations that begin with it, conv_id the smallest; the root has all, those without
    turns too. n_leaves and saved_tokens are sums over its subtree, itself included: of nodes without children, and of
    (members - 1) times the characters of the last turn. ends_sha256 is that of its members of no more turns. Empty
    texts are turns like others, of no characters; equal conversations are members of the same nodes. Without any
    conversation there is no node.
    """
    weighed = turns.withColumns({f"k{i}": _lane(F.col("digest"), i) for i in range(4)}).drop("digest")
    path = running(weighed, ["conv"], ["part", "at"], powers=LANES)
    path = path.select("conv", (F.col("position") + 1).alias("depth"), "chars", *(F.col(f"{k}_through").alias(k) for k in LANES), *(F.col(f"{k}_before").alias(f"parent_{k}") for k in LANES))
    root = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), *(F.lit(0).cast("long").alias(k) for k in LANES), *(F.lit(None).cast("long").alias(f"parent_{k}") for k in LANES))
    path = materialize(path.unionByName(root), "trie-paths")
    nodes = materialize(_merged(path.withColumn("members", F.lit(1).cast("long"))), "trie-nodes")

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *(F.col(f"parent_{k}").alias(k) for k in LANES)).agg(F.count("*").alias("n_children"))
    known = materialize(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-known")
    own = known.select("conv", "depth", ((F.col("members") - 1) * F.col("chars")).alias("saved"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"))
    # from below: along the path of each node's smallest member, what is saved and the leaves at or under each place
    walked = path.select("conv", "depth", *LANES).join(own, ["conv", "depth"], "left").withColumn("height", -F.col("depth"))
    below = running(walked, ["conv"], ["height"], ["saved", "leaf"]).where("saved_through > 0 OR leaf_through > 0")
    sums = below.groupBy(*KEY).agg(F.sum("saved_through").alias("saved_tokens"), F.sum("leaf_through").alias("n_leaves"))

    last = path.groupBy("conv").agg(F.max_by(F.struct(*KEY), "depth").alias("end")).select("conv", "end.*")
    ends = end_hashes(last)
    parents = known.select((F.col("depth") + 1).alias("depth"), *(F.col(k).alias(f"parent_{k}") for k in LANES), F.col("conv").alias("parent_conv_id"))
    out = known.join(sums, KEY, "left").join(ends, KEY, "left").join(parents, ["depth", *(f"parent_{k}" for k in LANES)], "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("members").alias("n_convs"), count("n_children"), count("n_leaves"), count("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, base: Column | None = None, heads: Column | None = None, most: int = 5, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of all conversations, as ``trie`` tells; rebuilt before with ``with_shared_heads`` if ``base`` and ``heads`` (of ``conv``) are given.

    Turns come by their number, null first, and those that tie by a digest of role and text; null roles and texts are
    empty; rows without a conversation's id are left out. Other columns don't matter, whatever their names.
    """
    turns = turns_of(conversations, id_col, turn_col, role_col, text_col)
    base, heads = (F.col("conv"), F.lit(0)) if base is None or heads is None else (base, heads)
    return trie(*with_shared_heads(turns, base, heads, most))
