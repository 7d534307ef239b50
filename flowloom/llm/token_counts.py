"""Token counts by overlap resynchronisation.

A text of up to ``huge_chars`` characters is in one task, which counts the tokens of its chunks between white space and marks, each
distinct chunk once, if the tokenizer is of a form whose tokens never reach over these, and else encodes it whole. A longer one is cut into chunks that
overlap, the chunks are dealt out over the cluster and encoded with offsets, and neighbouring chunks are
spliced at a boundary that both found and that is proven stable: a token starts there in both encodings, with
the same id, and the character before it is white space, which no token, merge or normalisation of a
white-space-splitting tokenizer crosses, or a punctuation mark that the tokenizer's own pre-tokenizer cuts from a letter
or digit after it. Where an overlap holds no such boundary, the document is encoded
again with wider chunks and overlaps, at last as one chunk; so every count equals that of the whole text.
"""

from __future__ import annotations

import json
import os
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm._common import materialize, slices
from flowloom.llm.token_files import WordTable

#: White space that ends a token for sure; other white space is left out, which costs at most a wider overlap.
STABLE_BEFORE = frozenset(" \t\n\r")
#: Marks that the pre-tokenizer is asked about, and what may stand after one: letters and digits that no normal form joins to it.
MARKS = ".,;:!?\"()[]{}<>/\\|*+=~#$%&@^`_-。、，．！？；：「」『』（）【】《》"
SAMPLES = "aZé5ñЖ日のテ한"
_ID_BITS = 20  # a boundary is packed as position << 20 | token id


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism; threads of each would only add memory
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


#: The pattern of words, digits and runs of marks, of which none reaches over white space, or from a letter or digit to a mark.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def has_apart_words(tokenizer) -> bool:
    """Whether a text has as many tokens as its chunks have together (see ``WordTable``): the words of ``WORDS`` in bytes, and normal forms that join nothing to white space or to an ASCII mark before which it stands."""
    made = json.loads(tokenizer.to_str())
    normal = made.get("normalizer") or {"type": "Sequence", "normalizers": []}
    forms = normal["normalizers"] if normal["type"] == "Sequence" else [normal]
    known = all(f["type"] in ("NFC", "Lowercase") or f == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "} for f in forms)
    steps = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0] == {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}
    loose = any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or any(c.isspace() for c in t["content"]) for t in made.get("added_tokens", []))
    return known and split and not steps[1].get("use_regex", True) and not steps[1].get("add_prefix_space") and not loose and made["model"]["type"] == "BPE"


@lru_cache(maxsize=2)
def _table_of(path: str) -> WordTable | None:
    tokenizer = _tokenizer(path)
    return WordTable(tokenizer, limit=500_000) if has_apart_words(tokenizer) else None


def counted(texts: list[str], path: str) -> list[int]:
    """The number of tokens of each text."""
    table = _table_of(path)
    if table is None or not texts:
        return [len(x) for x in _tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]
    _, cut = table.encode(pa.array(texts, pa.large_string()))
    return np.diff(cut).tolist()


@lru_cache(maxsize=2)
def _breaks_of(path: str) -> frozenset:
    return breaks(_tokenizer(path))


def breaks(tokenizer) -> frozenset:
    """The marks after which the pre-tokenizer always cuts, whatever letter or digit follows and whatever stands before."""
    if tokenizer.pre_tokenizer is None:
        return frozenset()

    def cuts(mark: str) -> bool:
        for before in ("a", "5", "日", ".", "'", mark):
            for after in SAMPLES:
                text = f"{before}{mark}{after}{after}"
                if not any(start == 2 for _, (start, _) in tokenizer.pre_tokenizer.pre_tokenize_str(text)):
                    return False
        return True

    return frozenset(m for m in MARKS if cuts(m))


def _is_plain(c: str) -> bool:
    """ASCII and Latin-1 letters and digits, Cyrillic, kana, Han and Hangul syllables: never joined to a mark before them."""
    return c.isalnum() and (c < "\u0180" or "\u0400" <= c <= "\u0482" or "\u3041" <= c <= "\u3096" or "\u30a1" <= c <= "\u30fa" or "\u4e00" <= c <= "\u9fff" or "\uac00" <= c <= "\ud7a3")


def _counter(path: str, remembered: int = 200_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts whole texts; copies of a text that the task has just counted are told by a digest of 128 bits, and not counted again."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        for part in slices(batches, "text", 1 << 20):
            texts = part.column("text").to_pylist()
            prints = [blake2b(t.encode(), digest_size=16).digest() for t in texts]
            new = {p: t for p, t in zip(prints, texts, strict=True) if p not in known}
            known.update(zip(new, counted(list(new.values()), path), strict=True))
            yield pa.record_batch([*part.columns[:2], pa.array([known[p] for p in prints], pa.int64()), pa.array([1] * len(texts), pa.int32())], names=["key", "n_bytes", "n_tokens", "n_chunks"])
            if len(known) > remembered:
                known.clear()

    return count


def _chunker(chunk: int, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each chunk: [k * chunk, (k + 1) * chunk + overlap) of the text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1):
            key, n_bytes, copies, text = (part.column(i)[0] for i in range(4))
            text = text.as_py()
            n = max(1, -(-len(text) // chunk))
            for k in range(n):
                yield pa.record_batch([pa.array([key.as_py()], part.schema.field(0).type), pa.array([n_bytes.as_py()], pa.int64()), pa.array([copies.as_py()], pa.int64()), pa.array([k], pa.int32()), pa.array([n], pa.int32()), pa.array([text[k * chunk : (k + 1) * chunk + overlap]])], names=["key", "n_bytes", "fingerprint", "k", "n", "text"])

    return cut


def _seams(path: str, chunk: int, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Encodes chunks with offsets; keeps the stable boundaries in both overlaps and the tokens before each."""

    def stable(text: str, at: int, marks: frozenset) -> bool:
        return text[at - 1] in STABLE_BEFORE or (text[at - 1] in marks and _is_plain(text[at]))

    def boundaries(text: str, ids: list[int], offsets: list[tuple[int, int]], low: int, high: int, base: int, marks: frozenset) -> tuple[list[int], list[int]]:
        first, last = (bisect_left(offsets, (x, 0)) for x in (max(low, 1), high))
        at = [(((base + offsets[n][0]) << _ID_BITS) | ids[n], n) for n in range(first, last) if stable(text, offsets[n][0], marks) and offsets[n][0] != offsets[n - 1][0]]
        return [x for x, _ in at], [n for _, n in at]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, marks = _tokenizer(path), _breaks_of(path)
        for part in slices(batches, "text", 1 << 18):
            texts, ks = part.column("text").to_pylist(), part.column("k").to_pylist()
            heads, tails, totals = [], [], []
            for text, k, found in zip(texts, ks, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
                ids, offsets = found.ids, found.offsets
                heads.append(boundaries(text, ids, offsets, 0, overlap, k * chunk, marks) if k else ([], []))
                tails.append(boundaries(text, ids, offsets, chunk, chunk + overlap, k * chunk, marks))
                totals.append(len(ids))
            longs = pa.list_(pa.int64())
            yield pa.record_batch([*part.columns[:5], *(pa.array([x[i] for x in xs], longs) for xs in (heads, tails) for i in (0, 1)), pa.array(totals, pa.int64())], names=["key", "n_bytes", "fingerprint", "k", "n", "head", "head_before", "tail", "tail_before", "total"])

    return encode


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", huge_chars: int = 65_536, chunk_chars: int = 32_768, overlap_chars: int = 512) -> DataFrame:
    """The number of tokens of every text: ``id_col``, n_bytes, n_tokens, n_chunks, a row for each input row.

    A null text counts as an empty one (0 tokens). Rows that repeat, ids that repeat and null ids each give their
    own row. Other columns of ``docs`` are ignored, whatever their names. ``tokenizer`` is a tokenizers file whose
    pre-tokenizer splits at white space; the executors open it, so it must be installed on them.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("key", F.octet_length("text").cast("long").alias("n_bytes"), F.xxhash64("text").alias("fingerprint"), "text")
    huge = F.length("text") > huge_chars
    counted = f"key {kind}, n_bytes long, n_tokens long, n_chunks int"
    out = rows.where(~huge).drop("fingerprint").mapInArrow(_counter(tokenizer), counted)
    spark = docs.sparkSession
    pending, chunk, overlap = rows.where(huge), chunk_chars, overlap_chars
    while True:
        pieces = pending.mapInArrow(_chunker(chunk, overlap), f"key {kind}, n_bytes long, fingerprint long, k int, n int, text string")
        dealt = pieces.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), "key", "k", "fingerprint")
        ends = dealt.mapInArrow(_seams(tokenizer, chunk, overlap), f"key {kind}, n_bytes long, fingerprint long, k int, n int, head array<long>, head_before array<long>, tail array<long>, tail_before array<long>, total long")
        done = materialize(_splice(ends), "token-seams")
        out = out.unionByName(done.where("n_tokens is not null").select("key", "n_bytes", "n_tokens", "n_chunks", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy"))
        failed = done.where("n_tokens is null").select("key", "fingerprint").distinct()
        if failed.isEmpty():
            return out.withColumnRenamed("key", id_col)
        again = failed.select(F.col("key").alias("failed_key"), F.col("fingerprint").alias("failed_fingerprint"))
        pending = pending.join(again, F.col("key").eqNullSafe(F.col("failed_key")) & (F.col("fingerprint") == F.col("failed_fingerprint")), "left_semi")
        chunk, overlap = chunk * 8, overlap * 16


def _splice(ends: DataFrame) -> DataFrame:
    """One row for each text. A seam adds the tokens of its left chunk before the boundary, less those of its right one.

    Rows that repeat have chunks that repeat: one of each is kept, with their number.
    """
    one = ends.groupBy("key", "fingerprint", "n_bytes", "n", "k").agg(*(F.first(c).alias(c) for c in ("head", "head_before", "tail", "tail_before", "total")), F.count("*").alias("copies"))
    none, count = F.lit(None).cast("array<long>"), F.lit(None).cast("long")
    side = lambda k, tail, head, total, copies: F.struct(k.alias("k"), *(x.alias(n) for x, n in zip((*tail, *head), ("tail", "tail_before", "head", "head_before"), strict=True)), total.alias("total"), copies.alias("copies"))
    sides = F.array(side(F.col("k"), (F.col("tail"), F.col("tail_before")), (none, none), F.col("total"), F.col("copies")), side(F.col("k") - 1, (none, none), (F.col("head"), F.col("head_before")), count, count))
    each = one.select("key", "fingerprint", "n_bytes", "n", F.explode(sides).alias("side")).select("key", "fingerprint", "n_bytes", "n", "side.*").where("k >= 0")
    seam = each.groupBy("key", "fingerprint", "n_bytes", "n", "k").agg(*(F.max(c).alias(c) for c in ("total", "copies")), *(F.first(c, ignorenulls=True).alias(c) for c in ("tail", "tail_before", "head", "head_before")))
    at = F.element_at(F.array_intersect("tail", "head"), 1)
    before = lambda ids, counts: F.get(counts, (F.array_position(ids, F.col("at")) - 1).cast("int"))
    part = seam.withColumn("at", F.when(F.size(F.array_intersect("tail", "head")) > 0, at)).withColumn("tokens", F.when(F.col("k") == F.col("n") - 1, F.col("total")).otherwise(before(F.col("tail"), "tail_before") - before(F.col("head"), "head_before")))
    whole = part.groupBy("key", "fingerprint", "n_bytes", "n").agg(F.sum("tokens").alias("n_tokens"), F.count("tokens").alias("joined"), F.max("copies").alias("copies"))
    return whole.select("key", "fingerprint", "n_bytes", F.when(F.col("joined") == F.col("n"), F.col("n_tokens")).alias("n_tokens"), F.col("n").alias("n_chunks"), "copies")
