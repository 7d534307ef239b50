"""Token ids in binary files: each document compressed by itself, with a dictionary that all share.

The dictionary is trained by zstandard on the serialized id arrays of a bounded sample of short documents, since these
gain from one. A file has a header, the documents' frames in the order of their ids, an index of offsets and a
footer, so a reader that wants a few documents takes the footer, the index and their frames:

    header   magic (8 bytes), SHA-256 of the dictionary (32), bytes an id (1), number of the file (8)
    frames   one zstandard frame for each document, of its ids in little-endian order
    index    for each document: whether its id is null (1), its id (8), offset of its frame (8), its number of ids (8)
    footer   offset of the index (8), documents (8), magic (8), and a line break, with which Spark's text sink ends a row

The folder holds ``files`` (a file in each ``shard=<n>``, in the order of n), ``dictionary`` (one file) and ``manifest`` (Parquet: for
each file its number, smallest and largest id, documents, ids, and ids before it). All numbers are little-endian.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm._common import delete, materialize, scratch_path, slices
from flowloom.llm._words import NOT_ALNUM, mix, raw
from flowloom.llm.pieces import ChunkTable, joined
from flowloom.operators.ranges import running

MAGIC = b"IDFILE01"
HEADER, FOOTER = len(MAGIC) + 32 + 1 + 8, 8 + 8 + len(MAGIC) + 1
INDEX = np.dtype([("null", "u1"), ("id", "<i8"), ("offset", "<u8"), ("n", "<u8")])

_code = np.arange(256)
_WHITE = (_code == 0x20) | ((_code >= 9) & (_code <= 13))
#: White space 1, ASCII letters and digits 2, ASCII marks 3.
_KIND = np.select([_WHITE, ~NOT_ALNUM & (_code < 128), NOT_ALNUM & (_code > 32) & (_code < 127)], [1, 2, 3], 0).astype(np.uint8).tobytes()
#: The last two bytes of white-space characters beyond ASCII, and some that share them.
_WIDE = [(0xC2, 0x85), (0xC2, 0xA0), (0x9A, 0x80), *((0x80, x) for x in [*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF]), (0x81, 0x9F)]
_WIDE_PAIRS = [a << 8 | b for a, b in _WIDE]
#: What fills up the rest of a word of eight bytes of which k are a chunk's: 0xFF, which no UTF-8 text holds.
_FILL = np.array([2**64 - (1 << 8 * k) for k in range(8)] + [0], np.uint64)


def _words_at(words: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number, of which ``size`` at most count."""
    at, shift = place >> 3, (place & 7).astype(np.uint64) << np.uint64(3)
    found = words[at] >> shift | words[at + 1] << np.uint64(1) << (np.uint64(63) - shift)
    return found | _FILL[np.clip(size, 0, 8)]


def chunk_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each range of bytes, a hash and a check: chunks of up to 16 bytes have equal ones only if they are equal; for longer ones they are a digest of 128 bits."""
    words = np.concatenate([data, np.full(32 - len(data) % 8, 0xFF, np.uint8)]).view("<u8")
    size = end - start
    check = np.full(len(start), _FILL[0])
    more = np.flatnonzero(size > 8)
    check[more] = _words_at(words, start[more] + 8, size[more] - 8)
    hashes = mix(_words_at(words, start, size) ^ mix(check))  # for each check a bijection of the first eight bytes
    long = np.flatnonzero(size > 16)
    if len(long):
        digests = b"".join(hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True))
        hashes[long], check[long] = np.frombuffer(digests, "<u8").reshape(-1, 2).T
    return hashes, check


def _merged(old: np.ndarray, here: np.ndarray, new: np.ndarray | int) -> np.ndarray:
    """``here`` at the places that are ``old``, and ``new`` at the others."""
    out = np.empty(len(old), here.dtype)
    out[old], out[~old] = here, new
    return out


class WordTable(ChunkTable):
    """The table of distinct chunks for a byte-level tokenizer that cuts texts at white space and at marks before it merges.

    A chunk begins at the first character of a run of white space. What comes before such a run never joins it, whatever
    follows; a run goes on after white space of any kind, so places after a character that may be some are not cut. One
    begins at an ASCII mark after an ASCII letter or digit too, as a run of letters or digits ends there; places
    that lie within a special token's string are not cut.
    """

    def __init__(self, processor, **limits):
        super().__init__(processor, **limits)
        names = [t.content.encode() for t in processor.get_added_tokens_decoder().values()]
        self.inside = sorted({a << 8 | b for name in names for a, b in pairwise(name)})
        between = [(i, t.content) for i, t in processor.get_added_tokens_decoder().items() if t.content]
        self.between = between[0] if between else None
        self.lengths = None if processor.normalizer else _byte_lengths(processor)

    def _hashed(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return chunk_keys(data, start, end)

    def _ids_of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that begin with white space and don't end with any are put together as they are, and the bytes of their tokens tell where each ends; the others are parted."""
        plain = np.zeros(len(start), bool)
        if self.lengths is not None:
            pair = data[np.maximum(end - 2, 0)].astype(np.int64) << 8 | data[end - 1]
            plain = _WHITE[data[start]] & (data[end - 1] > 0x20) & ~np.isin(pair, _WIDE_PAIRS)
        found = self._put_together(data, start[plain], end[plain])
        if found is None:
            plain, found = np.zeros(len(start), bool), joined([])
        whole = data.tobytes() if not plain.all() else b""
        rest = self._segment([whole[a:b].decode() for a, b in zip(start[~plain].tolist(), end[~plain].tolist(), strict=True)]) if whole else joined([])
        sizes = np.zeros(len(start), np.int64)
        sizes[plain], sizes[~plain] = found[1], rest[1]
        of_plain, ids = np.repeat(plain, sizes), np.zeros(int(sizes.sum()), np.uint32)
        ids[of_plain], ids[~of_plain] = found[0], rest[0]
        return ids, sizes

    def _put_together(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """As ``_ids_of``; None if a token doesn't end where a chunk does, or a chunk may hold the special token's string."""
        if not len(start):
            return joined([])
        cut = np.concatenate([[0], np.cumsum(end - start)])
        text = data[np.repeat(start - cut[:-1], end - start) + np.arange(cut[-1])].tobytes()
        if self.between is not None and self.between[1].encode() in text:
            return None
        ids, edges = [], [*cut[:-1:256].tolist(), len(text)]
        for lot in range(0, len(edges) - 1, 32):  # what the library makes of a lot is freed before the next
            many = [text[a:b].decode() for a, b in pairwise(edges[lot : lot + 33])]
            ids += [np.array(x.ids, np.uint32) for x in self.processor.encode_batch_fast(many, add_special_tokens=False)]
        ids = np.concatenate(ids)
        ends = np.cumsum(self.lengths[ids])
        at = np.searchsorted(ends, cut[1:])
        if at[-1] != len(ends) - 1 or (ends[at] != cut[1:]).any():
            return None
        return ids, np.diff(at, prepend=-1)

    def _add(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, checks: np.ndarray) -> None:
        """``hashes`` are in order, so the entries are put where they belong without sorting the table."""
        ids, sizes = self._ids_of(data, start, end)
        old = np.ones(len(self.hash) + len(hashes), bool)
        old[np.searchsorted(self.hash, hashes) + np.arange(len(hashes))] = False
        size = _merged(old, np.diff(self.cut), sizes)
        self.ids, self.cut = _merged(np.repeat(old, size), self.ids, ids), np.concatenate([[0], np.cumsum(size)])
        self.hash, self.check = _merged(old, self.hash, hashes), _merged(old, self.check, checks)
        self.used, self.bytes = _merged(old, self.used, 0), _merged(old, self.bytes, end - start)

    def _segment(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._parted(chunks)

    def _parted(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many chunks are one text, with a special token's string between them, at which the library cuts first; those that hold its id themselves go alone."""
        if self.between is None:
            return joined(self._whole(chunks))
        mark, name = self.between
        if any(name in c for c in chunks):
            return joined(self._whole(chunks))
        ids = []
        for lot in range(0, len(chunks), 1 << 13):  # what the library makes of a lot is freed before the next
            many = [name.join(chunks[i : i + 256]) + name for i in range(lot, min(lot + (1 << 13), len(chunks)), 256)]
            ids += [np.array(x.ids, np.uint32) for x in self.processor.encode_batch_fast(many, add_special_tokens=False)]
        ids = np.concatenate(ids)
        ends = np.flatnonzero(ids == mark)
        if len(ends) != len(chunks):  # a name cut across two chunks
            return joined(self._whole(chunks))
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.processor.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, offsets = raw(texts)
        kind = np.frombuffer(data.tobytes().translate(_KIND), np.uint8)
        white = kind == 1
        starts = np.zeros(len(data), bool)
        starts[1:] = white[1:] & ~white[:-1]
        after = np.flatnonzero(starts)
        after = after[after >= 2]
        pair = data[after - 2].astype(np.int64) << 8 | data[after - 1]  # the two bytes before each place
        starts[after[np.isin(pair, _WIDE_PAIRS)]] = False
        around = np.flatnonzero((kind[1:] == 3) & (kind[:-1] == 2)) + 1
        starts[around[~np.isin(data[around - 1].astype(np.int64) << 8 | data[around], self.inside)]] = True
        starts[offsets[:-1][np.diff(offsets) > 0]] = True
        return data, offsets, np.flatnonzero(starts)


def _byte_lengths(processor) -> np.ndarray:
    """The bytes that each id stands for: a byte-level token has a character for each byte."""
    out = np.zeros(processor.get_vocab_size(with_added_tokens=True), np.int64)
    for token, i in processor.get_vocab(with_added_tokens=False).items():
        out[i] = len(token)
    for i, token in processor.get_added_tokens_decoder().items():
        out[i] = len(token.content.encode())
    return out


def cuts_at_white_space(tokenizer) -> bool:
    """Whether a text's ids are those of its chunks, one after another: byte-level pieces of the usual pattern, nothing normalised or put before it."""
    import json

    made = json.loads(tokenizer.to_str())
    level = made.get("pre_tokenizer") or {}
    plain = level.get("type") == "ByteLevel" and level.get("use_regex", True) and not level.get("add_prefix_space")
    loose = any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in made.get("added_tokens", []))
    return bool(plain) and not loose and not made.get("normalizer") and made["model"]["type"] == "BPE"


@lru_cache(maxsize=2)
def _loaded(path: str) -> tuple:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the cores
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    if not cuts_at_white_space(tokenizer):
        return tokenizer, None
    tokenizer.model._resize_cache(0)  # the table keeps what the library would: it only sees chunks that the table lacks
    return tokenizer, WordTable(tokenizer, limit=600_000)


def encoded(texts: pa.Array, path: str) -> list[np.ndarray]:
    """The ids of each text, without special ones added; a null text has none."""
    tokenizer, table = _loaded(path)
    if table is None:
        return [np.array(x.ids, np.uint32) for x in tokenizer.encode_batch_fast(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
    ids, cut = table.encode(texts)
    return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _serialized(path: str, end_id: int | None, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            made = [_ended(x, end_id).astype(f"<u{width}").tobytes() for x in encoded(part.column("text"), path)]
            yield pa.record_batch([pa.array(made, pa.binary())], names=["ids"])

    return run


def _ended(ids: np.ndarray, end_id: int | None) -> np.ndarray:
    return ids if end_id is None else np.append(ids, np.uint32(end_id))


def train_dictionary(docs: DataFrame, path: str, id_col: str, text_col: str, end_id: int | None, width: int, max_rows: int, max_chars: int, size: int) -> bytes:
    """A zstandard dictionary of the id arrays of at most ``max_rows`` documents of ``max_chars`` characters or less, those of the lowest hash; empty if they are too few."""
    import zstandard

    short = docs.where((F.length(text_col) > 0) & (F.length(text_col) <= max_chars)).select(F.xxhash64(F.col(id_col).cast("string"), text_col).alias("hash"), F.col(text_col).alias("text"))
    last = short.select("hash").orderBy("hash").limit(max_rows).agg(F.max("hash")).first()[0]
    sample = short.where(F.col("hash") <= F.lit(last)).limit(max_rows).select("text")  # more only where rows repeat
    rows = sample.mapInArrow(_serialized(path, end_id, width), "ids binary").toArrow().column("ids").to_pylist()  # bounded by both parameters
    rows = sorted(x for x in rows if len(x) >= 8)
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, rows)) // 8), rows).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too small to learn from
        return b""


@lru_cache(maxsize=2)
def _codecs(dictionary: bytes, level: int) -> tuple:
    import zstandard

    shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdCompressor(level=level, **shared), zstandard.ZstdDecompressor(**shared)


def _framed(path: str, sent, end_id: int | None, width: int, level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows end in n, size and frame instead of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor, _ = _codecs(sent.value, level)
        for part in slices(batches, "text", 1 << 20):
            each = [_ended(x, end_id) for x in encoded(part.column("text"), path)]
            if any(len(x) and int(x.max()) >> 8 * width for x in each):
                raise ValueError(f"an id does not fit {width} bytes")
            frames = [compressor.compress(x.astype(f"<u{width}").tobytes()) for x in each]
            made = [pa.array([len(x) for x in each], pa.int64()), pa.array([len(x) for x in frames], pa.int64()), pa.array(frames, pa.binary())]
            yield pa.record_batch([part.column("id"), part.column("tie"), *made], names=["id", "tie", "n", "size", "frame"])

    return run


def _number(x: int) -> bytes:
    return int(x).to_bytes(8, "little")


def _files(sent, width: int, file_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A range's rows, in order, become files of about ``file_bytes``, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, shard = hashlib.sha256(sent.value).digest(), TaskContext.get().partitionId() << 32
        parts, index, at = [], [], HEADER

        def done() -> pa.RecordBatch:
            head = MAGIC + digest + bytes([width]) + _number(shard)
            whole = b"".join([head, *parts, np.array(index, INDEX).tobytes(), _number(at), _number(len(index)), MAGIC])
            return pa.record_batch([pa.array([shard], pa.int64()), pa.array([whole], pa.binary())], names=["shard", "file"])

        for batch in batches:
            for i, n, frame in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "frame")), strict=True):
                index.append((i is None, i or 0, at, n))
                parts.append(frame)
                at += len(frame)
                if at >= file_bytes:
                    yield done()
                    shard, parts, index, at = shard + 1, [], [], HEADER
        if index:
            yield done()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 0, width: int = 2, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = 8 << 20, level: int = 3, max_rows: int = 2_000, max_chars: int = 8_192, dictionary_bytes: int = 112_640) -> None:
    """Writes every document's ids, in ascending order of the documents' ids, in files of about ``file_bytes``.

    A null text is an empty one: of the end id alone. Null ids come first; rows that share an id are each written, in the order of a
    hash of their text. A document is in one file, whatever its length. ``width`` is the bytes of an id, 2 or 4; ids
    that don't fit are an error. An empty table gives a dictionary, a manifest and no file.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    dictionary = train_dictionary(rows, tokenizer, "id", "text", end_id, width, max_rows, max_chars, dictionary_bytes)
    sent = spark.sparkContext.broadcast(dictionary)
    kept = spark.createDataFrame([(dictionary,)], "file binary").coalesce(1)
    kept.select(F.col("file").cast("string")).write.text(f"{path}/dictionary")
    tied = rows.select("id", F.xxhash64("text").alias("tie"), "text")
    framed = materialize(tied.mapInArrow(_framed(tokenizer, sent, end_id, width, level), "id bigint, tie bigint, n bigint, size bigint, frame binary"), "token-frames")
    total = framed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + total // file_bytes), -(-total // (8 * file_bytes)))
    order = [F.col("id").asc_nulls_first(), F.col("tie")]
    ranged = framed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    whole = ranged.mapInArrow(_files(sent, width, file_bytes), "shard bigint, file binary")
    whole.select("shard", F.col("file").cast("string").alias("value")).write.partitionBy("shard").text(f"{path}/files")
    indexed = _opened(spark, path).mapInArrow(_summaries(sent), "shard bigint, first_id bigint, last_id bigint, documents bigint, ids bigint") if total else spark.createDataFrame([], "shard bigint, first_id bigint, last_id bigint, documents bigint, ids bigint")
    placed = running(indexed, [], ["shard"], ["ids"])
    placed.select("shard", "first_id", "last_id", "documents", "ids", F.col("ids_before").alias("start")).write.parquet(f"{path}/manifest")


def _opened(spark: SparkSession, path: str, shards: list[int] | None = None) -> DataFrame:
    paths = [f"{path}/files"] if shards is None else [f"{path}/files/shard={s}" for s in shards]
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(paths).select("content")


def _parsed(file: pa.Scalar, dictionary: bytes) -> tuple[memoryview, int, int, np.ndarray, int]:
    """A file's bytes, bytes an id, number, index, and where its index begins."""
    data = memoryview(file.as_buffer())
    if bytes(data[: len(MAGIC)]) != MAGIC or bytes(data[-1 - len(MAGIC) : -1]) != MAGIC:
        raise ValueError("not a whole file of token ids")
    if bytes(data[len(MAGIC) : len(MAGIC) + 32]) != hashlib.sha256(dictionary).digest():
        raise ValueError("the file was written with another dictionary")
    foot = len(data) - FOOTER
    begin, count = (int.from_bytes(data[foot + 8 * k : foot + 8 * k + 8], "little") for k in (0, 1))
    return data, data[HEADER - 9], int.from_bytes(data[HEADER - 8 : HEADER], "little"), np.frombuffer(data, INDEX, count, begin), begin


def _summaries(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("content"):
                _, _, shard, index, _ = _parsed(file, sent.value)
                known = index["id"][index["null"] == 0]
                ends = [int(known[0]), int(known[-1])] if len(known) else [None, None]
                row = [shard, *ends, len(index), int(index["n"].sum())]
                yield pa.record_batch([pa.array([x], pa.int64()) for x in row], names=["shard", "first_id", "last_id", "documents", "ids"])

    return run


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    found = spark.read.format("binaryFile").load(f"{path}/dictionary/part-*").select("content").collect()  # one file of bounded size
    return next((bytes(r["content"])[:-1] for r in found if len(r["content"])), b"")


def _documents(sent, wanted: np.ndarray | None, keep_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decompressor = _codecs(sent.value, 3)
        for batch in batches:
            for file in batch.column("content"):
                data, width, shard, index, begin = _parsed(file, sent.value)
                start = np.concatenate([[0], np.cumsum(index["n"].astype(np.int64))])[:-1]
                end = np.append(index["offset"][1:], begin).astype(np.int64)
                take = np.arange(len(index)) if wanted is None else np.flatnonzero(np.isin(index["id"], wanted) & (index["null"] == 0))
                for lot in np.array_split(take, max(1, -(-int(index["n"][take].sum()) // (1 << 20)))):  # about a million ids at once
                    each = [np.frombuffer(decompressor.decompress(data[index["offset"][k] : end[k]], max_output_size=int(index["n"][k]) * width), f"<u{width}").astype("<u4") for k in lot.tolist()]
                    if any(len(x) != n for x, n in zip(each, index["n"][lot].tolist(), strict=True)):
                        raise ValueError("a document has another number of ids than the index says")
                    made = [pa.array(np.full(len(lot), shard)), pa.array(index["id"][lot], pa.int64(), mask=index["null"][lot] == 1), pa.array(start[lot], pa.int64()), pa.array(index["n"][lot].astype(np.int64)), pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())]
                    names = ["shard", "doc_id", "inside", "n_tokens", "ids_crc32"]
                    if keep_ids:
                        made, names = [*made, pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32()))], [*names, "ids"]
                    yield pa.record_batch(made, names=names)

    return run


def read_token_files(spark: SparkSession, path: str, ids: list[int] | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if ``keep_ids``, ids of each document, read from the files.

    With ``ids``, a list that a driver can hold, only files whose range holds one are opened, and of these only the
    wanted documents' frames are decompressed; an id that no document has gives no row. A file of another dictionary, cut short or
    of other lengths than its index says fails the query.
    """
    sent = spark.sparkContext.broadcast(read_dictionary(spark, path))
    manifest = spark.read.parquet(f"{path}/manifest")
    wanted, shards = None, None
    if ids is not None:
        wanted = np.array(sorted(set(ids)), np.int64)
        few = spark.createDataFrame([(x,) for x in wanted.tolist()], "wanted bigint")
        held = manifest.join(F.broadcast(few), F.col("wanted").between(F.col("first_id"), F.col("last_id")), "left_semi")
        shards = [r["shard"] for r in held.select("shard").collect()]  # at most a file or so for each wanted id
    if shards == [] or manifest.isEmpty():
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids)
    kind = "shard bigint, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    found = _opened(spark, path, shards).mapInArrow(_documents(sent, wanted, keep_ids), kind).join(manifest.select("shard", F.col("start").alias("before")), "shard")
    return found.select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if keep_ids else []))


def token_round_trip(docs: DataFrame, tokenizer: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``read_token_files`` gives of the files that ``write_token_files`` writes to the shared folder."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, end_id, id_col=id_col, text_col=text_col)
    found = materialize(read_token_files(docs.sparkSession, path), "token-documents")
    delete(docs.sparkSession, path)
    return found
