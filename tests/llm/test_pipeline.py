"""The pipeline and the registered queries on the driver's smallest tables, against SQL or brute force."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowloom.llm.queries import ORACLES, QUERIES
from tests.llm.test_text_operators import base_spans, brute_classes
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir) == ""


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_tokens_and_spans(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in QUERIES["op1_token_counts"](spark, sf_dir).collect():
        n = len(t.encode(docs[r.doc_id].text, add_special_tokens=False).ids)
        assert (r.n_tokens, r.over_limit) == (n, n > 2048)
    for r in QUERIES["op4_pii"](spark, sf_dir).collect():
        base = base_spans(docs[r.doc_id].text)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(filter(None, base.split(","))) <= set(r.spans.split(","))


def plain_windows(text, size=8):
    words = [x for x in (re.sub(r"^\W+|\W+$", "", w.lower()) for w in (text or "").split()) if x]
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


def test_contamination_is_that_of_plain_windows(spark, sf_dir, docs):
    """The driver's benchmark passages are verbatim but for case: half of an item's word windows in a document decide."""
    items = {r.item_id: set(plain_windows(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = {}
    for i, r in docs.items():
        own = set(plain_windows(r.text))
        want[i] = sorted(k for k, w in items.items() if w and len(w & own) >= 0.5 * len(w))
    got = {r.doc_id: r["items"] for r in QUERIES["op10_decontamination"](spark, sf_dir).collect()}
    assert got == want and any(want.values())


def test_held_out_toxicity(spark, sf_dir):
    larger = sf_dir.replace("sf0.001", "sf0.01")
    rows = QUERIES["op6_toxicity"](spark, larger).join(spark.read.parquet(f"{larger}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.93 * len(rows)
    assert all(r.toxic == 1 for r in rows if r.predicted == 1)


def test_stages_one_by_one(spark, sf_dir, docs):
    """What each stage keeps of what it is given, by brute force where the stage isn't a fitted model."""
    import sentencepiece

    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, given, sf_dir)
        assert out.columns == corpus_pipeline.COLUMNS, name
        kept.append({r.doc_id: r.text for r in out.collect()})
        given = out
    after_lines = kept[1]
    classes = brute_classes(after_lines.items())
    assert set(kept[2]) == {i for i in after_lines if classes[i][0] == i}
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaked = {i for i, t in kept[2].items() if any(b.lower() in t.lower() for b in items)}
    assert leaked and not leaked & set(kept[3]) and len(kept[3]) >= 0.9 * len(kept[2])
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    last = corpus_pipeline.STAGES[-1][1](spark, given, sf_dir).collect()
    assert {r.doc_id for r in last} == set(kept[3])
    for r in last:
        ids = sp.encode(kept[3][r.doc_id], add_bos=True, add_eos=True)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()} == set(kept[3])


ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_take_odd_rows(spark, sf_dir):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "x y z", "en", "s", 5), (None, "x y z", "en", "s", 5)]
    given = spark.createDataFrame(rows, ROWS)
    for _, stage in corpus_pipeline.STAGES:
        given = stage(spark, given, sf_dir)
    ids = [r.doc_id for r in given.collect()]
    assert ids.count(None) == 2 and ids.count(2) == 2 and ids.count(1) == 1


def test_rows_of_one_id_are_documents_of_their_own(spark, sf_dir):
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abc"}
    rows = [(None, text["a"]), (None, text["a"]), (3, text["a"]), (3, text["a"]), (3, text["b"]), (1, text["c"]), (5, text["c"]), (5, text["b"] + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], ROWS)
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group(spark, docs, sf_dir).collect()), key=str)
    assert kept == sorted([(None, text["a"]), (None, text["a"]), (3, text["a"]), (3, text["b"]), (1, text["c"])], key=str)
    alone = corpus_pipeline.one_of_each_group(spark, docs.where("doc_id is null or doc_id = 1"), sf_dir)
    assert sum(r.doc_id is None for r in alone.collect()) == 2


def test_without_labels_no_document_goes(spark, sf_dir, tmp_path):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(["one.", "one. two. three. four.", ""])], ROWS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for i, few in enumerate([labels.limit(0), labels.select("doc_id", "quality", (F.col("toxic") * 0 + 1).alias("toxic"))]):
        few.write.parquet(f"{tmp_path}/{i}/labels.parquet")
        assert corpus_pipeline.toxicity(spark, docs, f"{tmp_path}/{i}").count() == 3


def test_scores_are_the_noisy_or_of_their_sentences(spark, sf_dir):
    """The registered query's scores, by plain Python from the model's weights, where there are labels enough to learn from."""
    from flowloom.llm import _words, toxicity
    from flowloom.llm.queries import HELD_OUT

    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels, where=~F.expr(HELD_OUT))
    assert model.learnt
    weight = dict(zip(model.buckets.tolist(), zip(model.weights.tolist(), model.marks.tolist(), strict=True), strict=True))

    def bucket(word, seen={}):  # noqa: B006
        if word not in seen:
            seen[word] = int(_words.words(pa.array([word]), _words.NOT_ALNUM).hash[0]) & (toxicity.BUCKETS - 1)
        return seen[word]

    def brute(text):
        clean, some = 1 - model.leak, False
        for sentence in re.split(r"[.!?\n]", (text or "").lower()):
            found = {bucket(w) for w in re.findall(r"[a-z0-9\u0080-\U0010ffff]+", sentence)}
            some |= bool(found)
            known = [weight[b] for b in found if b in weight]
            if any(mark for _, mark in known):
                clean *= 1 - 1 / (1 + math.exp(-(model.bias + sum(w for w, _ in known))))
        return 1 - clean if some else 0.0

    rows = QUERIES["op6_toxicity"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.score == pytest.approx(brute(docs[r.doc_id].text), abs=1e-9) and r.predicted == (r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_registered_pieces_are_the_library_s(spark, sf_dir, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = QUERIES["op2_pieces"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = sp.encode(docs[r.doc_id].text or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
