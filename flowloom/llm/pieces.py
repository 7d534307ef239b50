"""SentencePiece encoding and decoding with a table of distinct chunks.

Where no piece holds a white-space marker after another character, no merge crosses from a word into the
marker that follows it. So a text, marked as the library marks it, is cut before each run of markers; each distinct
chunk is segmented once and its ids are joined back by position.

Chunks of a slice of texts are found and hashed in NumPy, all at once. The distinct ones that the table lacks go to the
library in one batch, and every chunk's ids are gathered from the table by its place. The table lives in a Python
worker, over all its tasks, and is bounded: one for the whole corpus would have to shuffle every word of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm._common import slices
from flowloom.llm._words import mix, range_hashes, raw

MARK = "▁"


_MIXED = mix(np.arange(1, 257, dtype=np.uint64))


def _check_sums(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A second number for each range, of other making than its hash: chunks count as equal only if both are."""
    each = _MIXED[data]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(each * (np.arange(len(data), dtype=np.uint64) + np.uint64(1)), out=sums[1:])
    plain = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(each, out=plain[1:])
    return sums[end] - sums[start] - start.astype(np.uint64) * (plain[end] - plain[start])


def joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], np.int64)
    return np.fromiter((i for x in lists for i in x), np.uint32, int(sizes.sum())), sizes


class ChunkTable:
    """Distinct chunks (hash and check sum, sorted by hash) and their ids, one after another.

    Between slices at most ``limit`` chunks of up to ``longest`` bytes are kept: beyond that, the half that was used most.
    """

    def __init__(self, processor, limit: int = 300_000, longest: int = 256):
        self.processor, self.limit, self.longest = processor, limit, longest
        self.hash, self.check, self.used, self.bytes = (np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
        self.ids, self.cut = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _segment(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The chunks' ids, one after another, and how many each has. The library puts a marker before what it is given: a chunk's own first one is left out."""
        inner = [c[1:].replace(" ", MARK) for c in chunks]
        found = self.processor.encode(inner, num_threads=1)
        mark = self.processor.piece_to_id(MARK)
        return joined([x if c else [mark] for c, x in zip(inner, found, strict=True)])

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=1)

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of the marked texts, where each text begins in them, and where each chunk does: at every run of markers."""
        texts = pc.replace_substring(texts, MARK, " ")  # a marker in a text is what a space becomes
        data, offsets = raw(pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, "")))
        space = data == 0x20
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets] = True
        after = np.ones(len(data), bool)
        after[1:] = ~space[:-1]
        return data, offsets, np.flatnonzero(space & (after | begins[:-1]))

    def _hashed(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers for each chunk; chunks count as equal if both are."""
        return range_hashes(data, start, end), _check_sums(data, start, end)

    def _take(self, keep: np.ndarray) -> None:
        """Only the entries ``keep``, in that order."""
        size = np.diff(self.cut)[keep]
        cut = np.concatenate([[0], np.cumsum(size)])
        self.ids = self.ids[np.repeat(self.cut[keep] - cut[:-1], size) + np.arange(cut[-1])]
        self.hash, self.check, self.used, self.bytes, self.cut = self.hash[keep], self.check[keep], self.used[keep], self.bytes[keep], cut

    def _add(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, checks: np.ndarray) -> None:
        whole = data.tobytes()
        ids, sizes = self._segment([whole[a:b].decode() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        self.hash, self.check = np.append(self.hash, hashes), np.append(self.check, checks)
        self.used, self.bytes = np.append(self.used, np.zeros(len(sizes), np.int64)), np.append(self.bytes, end - start)
        self.cut, self.ids = np.append(self.cut, self.cut[-1] + np.cumsum(sizes)), np.append(self.ids, ids)
        self._take(np.argsort(self.hash, kind="stable"))

    def _shrink(self) -> None:
        if len(self.hash) > self.limit or (self.bytes > self.longest).any():
            keep = np.flatnonzero(self.bytes <= self.longest)
            if len(keep) > self.limit:
                keep = np.sort(keep[np.argsort(-self.used[keep], kind="stable")[: self.limit // 2]])
            self._take(keep)
            self.used //= 2

    def _places(self, hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """Where each chunk stands in the table, whether it does, and whether another chunk of its hash does."""
        if not len(self.hash):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool), False
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        known = self.hash[at] == hashes
        return at, known, bool((known & (self.check[at] != checks)).any())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin (and the last's end).

        Where two chunks share a hash, the texts are encoded whole and the table stays as it is.
        """
        texts = pc.fill_null(texts, "")
        data, offsets, start = self._cut(texts)
        end = np.append(start[1:], len(data))
        hashes, checks = self._hashed(data, start, end)
        distinct, first, which, often = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        _, known, clash = self._places(distinct, checks[first])
        if clash or (checks[first][which] != checks).any():
            ids, sizes = joined(self._whole(texts.to_pylist()))
            return ids, np.concatenate([[0], np.cumsum(sizes)])
        if not known.all():
            new = first[~known]
            self._add(data, start[new], end[new], hashes[new], checks[new])
        at, _, _ = self._places(distinct, checks[first])
        self.used[at] += often
        size = np.diff(self.cut)[at][which]
        cut = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.cut[at][which] - cut[:-1], size) + np.arange(cut[-1])]
        self._shrink()
        return ids, cut[np.searchsorted(start, offsets)]


def chunks_are_independent(processor) -> bool:
    """No piece, user defined or not, has a marker after another character, and texts are only marked, not rewritten."""
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    text = "  ﬁ ① a  Å\t "  # what folding, stripping or joining of white space would change
    return processor.piece_to_id(MARK) != processor.unk_id() and not any(MARK in x.lstrip(MARK) for x in pieces) and processor.decode(processor.encode(text)) == text


@lru_cache(maxsize=2)
def _loaded(model: str, limit: int) -> tuple:
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    return processor, ChunkTable(processor, limit) if chunks_are_independent(processor) else None


def _worker(model: str, limit: int, keep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor, table = _loaded(model, limit)
        begin, end = (np.array([x], np.uint32) for x in (processor.bos_id(), processor.eos_id()))
        for part in slices(batches, "text", 1 << 20):
            texts = part.column("text")
            if table is not None:
                ids, cut = table.encode(texts)
                each = [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            else:
                each = [np.array(x, np.uint32) for x in processor.encode(texts.to_pylist(), num_threads=1)]
            each = [np.concatenate([begin, x, end]).astype("<u4") for x in each]
            decoded = [processor.decode(x.tolist()) for x in each]
            out = [pa.array([len(x) for x in each], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in each], pa.string()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string())]
            names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                out += [pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.record_batch([*part.columns[:-1], *out], names=[*part.schema.names[:-1], *names])

    return run


def encode_decode(docs: DataFrame, model: str, text_col: str = "text", carry: list[str] | None = None, keep_ids: bool = False, table_limit: int = 300_000) -> DataFrame:
    """Every row's ``carry`` columns with n_tokens, ids_sha256 and decoded_sha256 of its whole text; ids and decoded too if ``keep_ids``.

    Ids have begin and end ids around them, as the library gives them; a null text counts as an empty one. Each
    row gives one row, repeated or not; a carried column of a name that is made is replaced. A model whose pieces cross markers is applied to whole texts instead.
    """
    made = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep_ids else [])]
    carry = [c for c in (["doc_id"] if carry is None else carry) if c not in made]
    rows = docs.select(*(F.col(c) for c in carry), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).toDF(*(f"c{i}" for i in range(len(carry))), "text")
    kinds = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry)]
    schema = ", ".join([*kinds, "n_tokens long", "ids_sha256 string", "decoded_sha256 string", *(["ids array<int>", "decoded string"] if keep_ids else [])])
    return rows.mapInArrow(_worker(model, table_limit, keep_ids), schema).toDF(*carry, *made)
