"""Toxicity by multiple-instance learning: sentences are scored, a leaky noisy-or of them is the document's score.

Only documents have labels. A sentence's probability is a logistic function of its words, and 0 if none of them goes with
toxic documents; a document is toxic unless its leak and all its sentences are clean: ``1 - (1 - leak) * prod(1 - p)``.
The leak, one for each document of any length, stands for labels that no word explains. The weights maximise the
likelihood of the documents' labels, so blame falls on the sentences that tell toxic documents from others, and these
are given back as spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm._common import materialize, slices
from flowloom.llm._words import NOT_ALNUM, Words, places_of, words

BUCKETS = 1 << 20
_ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?\n"])
#: Sentence ends beyond ASCII: of East Asian, South Asian and Arabic scripts, and the ellipsis.
WIDE_ENDS = [c.encode() for c in "。．！？｡…।॥؟۔"]


@dataclass(frozen=True)
class Model:
    """Weights of the words, by bucket (sorted), which of them go with toxic documents, the common weight of sentences with one of these, and a document's leak."""

    buckets: np.ndarray
    weights: np.ndarray
    marks: np.ndarray
    bias: float
    leak: float

    @property
    def learnt(self) -> bool:
        """Whether any word has a weight. If not, every document with words scores the base rate, which tells none from another."""
        return len(self.buckets) > 0


def sentences(w: Words) -> np.ndarray:
    """The sentence of each word, numbered through the batch. Full stops, marks (of other scripts too) and line ends between words end one."""
    marks = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(_ENDS[w.data] | places_of(w.data, WIDE_ENDS), out=marks[1:])
    new = np.ones(len(w.start), bool)
    new[1:] = (marks[w.start[1:]] > marks[w.end[:-1]]) | (w.row[1:] != w.row[:-1])
    return np.cumsum(new) - 1


def _features(w: Words, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, bucket) pairs, each once."""
    pair = np.unique((of.astype(np.uint64) << np.uint64(20)) | (w.hash & np.uint64(BUCKETS - 1)))
    return (pair >> np.uint64(20)).astype(np.int64), (pair & np.uint64(BUCKETS - 1)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For training: the documents and the toxic documents that hold each bucket, and under -1 all that have words."""
    for part in slices(batches, "text"):
        w = words(part.column("text"), NOT_ALNUM, lower=True, marks=WIDE_ENDS)
        label = part.column("label").to_numpy()
        pair = np.unique((w.row.astype(np.int64) << 20) | (w.hash & np.uint64(BUCKETS - 1)).astype(np.int64))
        names, which, docs_with = np.unique(pair & (BUCKETS - 1), return_inverse=True, return_counts=True)
        some = label[np.unique(w.row)]
        toxic_with = np.bincount(which, label[pair >> 20], len(names))
        yield pa.record_batch([pa.array(np.append(names, -1), pa.int32()), pa.array(np.append(docs_with, len(some)), pa.int64()), pa.array(np.append(toxic_with, some.sum()).astype(np.int64))], names=["bucket", "docs", "toxic"])


def _bags(names: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For training: of each document with words, the numbers of its sentences with words of ``names`` and these words' places in ``names``, side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            w = words(part.column("text"), NOT_ALNUM, lower=True, marks=WIDE_ENDS)
            of = sentences(w)
            s, b = _features(w, of)
            row = w.row[np.searchsorted(of, s)] if len(s) else s
            some = np.unique(row)
            at, known = _places(names, b)
            s, row, at = s[known], row[known], at[known]
            cut = np.append(np.searchsorted(row, some), len(row))
            as_lists = lambda x: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, pa.int32()))
            yield pa.record_batch([part.column("label").take(pa.array(some)), as_lists(s), as_lists(at)], names=["label", "sentence", "place"])

    return run


def _places(names: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each bucket stands in ``names`` (sorted), and whether it does."""
    if not len(names):
        return np.zeros(len(buckets), np.int64), np.zeros(len(buckets), bool)
    at = np.minimum(np.searchsorted(names, buckets), len(names) - 1)
    return at, names[at] == buckets


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", where: Column | None = None, max_rows: int = 5_000, min_docs: int = 5, min_z: float = 4.0, steps: int = 300, ridge: float = 0.1) -> Model:
    """The model, from at most ``max_rows`` labelled documents of any length, those of the lowest hash of their ids.

    ``where`` limits the ids that may be learnt from. Labels that contradict each other count as 1; null ids, null
    labels, labels without a document and texts without words are left out. Words in fewer than ``min_docs`` of them, or
    whose share of toxic documents is less than ``min_z`` standard errors from the common share, get no weight. A word
    with which alone a sentence is less likely toxic than a document at large marks no sentence: many of its sentences
    would add up. Without
    labels of both kinds, every document with words scores the base rate (a half without any label). Of the texts that
    share an id, the least is learnt from. What comes to the driver is a count for each bucket and, of the documents,
    only the words that have weights.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.where(where) if where is not None else known
    known = known.groupBy(F.col(id_col).alias("key")).agg(F.max(label_col).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64(F.col("key").cast("string")), "key").limit(max_rows)  # bounded by max_rows
    texts = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = materialize(texts.join(F.broadcast(sample), "key").groupBy("key").agg(F.max("label").alias("label"), F.min("text").alias("text")).select("label", "text"), "toxicity-sample")
    held = texts.mapInArrow(_counts, "bucket int, docs bigint, toxic bigint").groupBy("bucket").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    held = held.where(f"bucket = -1 OR docs >= {int(min_docs)}").orderBy("bucket").toArrow()  # bounded by BUCKETS
    bucket, docs_with, toxic_with = (held.column(c).to_numpy() for c in ("bucket", "docs", "toxic"))
    n, toxic = (int(docs_with[0]), int(toxic_with[0])) if len(bucket) else (0, 0)
    if not 0 < toxic < n:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool), 0.0, (toxic + 0.5) / (n + 1))
    share = toxic / n
    z = ((toxic_with - docs_with * share) / np.sqrt(docs_with * share * (1 - share)))[1:]
    names, marks = bucket[1:][np.abs(z) >= min_z].astype(np.int64), z[np.abs(z) >= min_z] > 0
    rows = texts.mapInArrow(_bags(names), "label int, sentence array<int>, place array<int>").toArrow()
    model = _solve(rows.column("label").to_numpy(), rows.column("sentence").combine_chunks(), rows.column("place").combine_chunks(), names, marks, steps, ridge)
    while (weak := model.marks & (model.bias + model.weights < np.log(share / (1 - share)))).any():
        model = _solve(rows.column("label").to_numpy(), rows.column("sentence").combine_chunks(), rows.column("place").combine_chunks(), names, model.marks & ~weak, steps, ridge)
    return model


def _solve(label: np.ndarray, sentence: pa.ListArray, place: pa.ListArray, names: np.ndarray, marks: np.ndarray, steps: int, ridge: float) -> Model:
    """Adam on the mean log loss of the leaky noisy-or, over the words' weights, what marked sentences have in common (bias), and the leak."""
    n = len(label)
    row = np.repeat(np.arange(n), np.diff(sentence.offsets.to_numpy()))
    s, at = sentence.values.to_numpy().astype(np.int64), place.values.to_numpy()
    most = s.max(initial=0) + 1
    known, of = np.unique(row * most + s, return_inverse=True)
    doc_of = known // most
    marked = np.bincount(of, marks[at], len(known)) > 0
    theta, bias, leak = np.zeros(len(names)), -4.0, -4.0
    moment, square = np.zeros(len(names) + 2), np.zeros(len(names) + 2)
    toxic = label == 1
    for t in range(1, steps + 1):
        z = np.where(marked, bias + np.bincount(of, theta[at], len(known)), -np.inf)
        p = 1 / (1 + np.exp(-np.clip(z, -700, 30)))
        clean = np.exp(-np.logaddexp(0, leak) - np.bincount(doc_of, np.logaddexp(0, z), n))
        blame = np.where(toxic, -np.clip(clean / np.maximum(1 - clean, 1e-9), 0, 1e3), 1.0) / n
        g = blame[doc_of] * p
        grad = np.concatenate([np.bincount(at, g[of], len(names)) + ridge / n * theta, [g.sum(), blame.sum() / (1 + np.exp(-leak))]])
        moment = 0.9 * moment + 0.1 * grad
        square = 0.99 * square + 0.01 * grad**2
        pace = 0.15 * min(1.0, 2 * (1 - t / (steps + 1))) ** 2  # slower from half way on, so that it comes to rest
        move = pace * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-9)
        theta, bias, leak = theta - move[:-2], bias - move[-2], leak - move[-1]
    return Model(names, theta, marks, float(bias), float(1 / (1 + np.exp(-leak))))


def sentence_scores(model: Model, w: Words, of: np.ndarray, count: int) -> np.ndarray:
    s, b = _features(w, of)
    at, known = _places(model.buckets, b)
    s, at = s[known], at[known]
    z = model.bias + np.bincount(s, model.weights[at], count)
    marked = np.bincount(s, model.marks[at], count) > 0
    return np.where(marked, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)


def _scorer(model, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for part in slices(batches, "text"):
            w = words(part.column("text"), NOT_ALNUM, lower=True, marks=WIDE_ENDS)
            of = sentences(w)
            count = int(of[-1]) + 1 if len(of) else 0
            p = sentence_scores(m, w, of, count)
            first = np.searchsorted(of, np.arange(count))
            last = np.append(first[1:], len(of)) - 1
            row = w.row[first] if count else first
            leak = np.where(np.bincount(row, minlength=part.num_rows) > 0, np.log1p(-m.leak), 0.0)
            score = -np.expm1(leak + np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-12)), part.num_rows))
            hit = np.flatnonzero(p >= threshold)
            chars = np.zeros(len(w.data) + 1, np.int64)
            np.cumsum((w.data & 0xC0) != 0x80, out=chars[1:])
            base = chars[w.offsets[row[hit]]] if len(hit) else hit
            spans = pa.StructArray.from_arrays([pa.array(chars[w.start[first[hit]]] - base, pa.int64()), pa.array(chars[w.end[last[hit]]] - base, pa.int64()), pa.array(p[hit], pa.float64())], ["start", "end", "score"])
            cut = np.searchsorted(row[hit], np.arange(part.num_rows + 1))
            yield pa.record_batch([*part.columns[:-1], pa.array(np.clip(score, 0, 1)), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), spans)], names=[*part.schema.names[:-1], "score", "spans"])

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Every row's ``carry`` columns with score (0 to 1) and spans: start, end (characters) and score of each sentence at ``threshold`` or more.

    Texts of any length are scored whole; words of kana and ideographs are single characters. A null or empty text and one without words have no sentence and score 0. Rows that repeat are each scored; carried columns called score or spans are replaced.
    Spans refer to the lower-cased text, which for a few letters of some scripts is of another length.
    """
    carry = [c for c in (["doc_id"] if carry is None else carry) if c not in ("score", "spans")]
    rows = docs.select(*(F.col(c) for c in carry), F.coalesce(F.col(text_col), F.lit(""))).toDF(*(f"c{i}" for i in range(len(carry))), "text")
    # NumPy and pandas types of the carried columns are kept: they pass through Arrow untouched
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry)), "score double, spans array<struct<start: bigint, end: bigint, score: double>>"])
    return rows.mapInArrow(_scorer(sent, threshold), schema).toDF(*carry, "score", "spans")
