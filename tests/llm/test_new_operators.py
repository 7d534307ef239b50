"""The conversation trie, the divergence audit, token files, and later changes to others, against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from flowloom.llm import decontamination, pieces, queries, token_files, toxicity
from flowloom.llm._words import NOT_ALNUM, words
from flowloom.llm.conversation_trie import conversation_trie, end_hashes
from flowloom.llm.decontamination import contaminated_by
from flowloom.llm.divergence import divergence
from flowloom.llm.pieces import encode_decode
from flowloom.llm.url_filter import judge_urls

BYTES = public_tokenizers.path("byte_bpe_50k.json")
NASTY = ["a", "b", "Z", "é", "ß", "1", "23", "²", " ", "  ", "\t", "\n", "\r\n", " ", "　", " ", " ", "\x85", "'s", "'", "’", "!", ".", "<|endoftext|>", "<|endof", "text|>", "中", "。", "😀", "́", "-", "\x00", "​", "it's"]


# ---- op11 --------------------------------------------------------------------------------------------------------


def plain_trie(rows):
    """Node (a tuple of turns) -> what is told of it, from conversations one after another."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[3] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = defaultdict(set)
    for n in nodes:
        if n:
            children[n[:-1]].add(n)
    out = {}
    for n, members in nodes.items():
        under = [m for m in nodes if m[: len(n)] == n]
        ends = sorted(c for c in members if len(built[c]) == len(n))
        out[n] = (min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), len(children[n]), sum(not children[m] for m in under), sum((len(nodes[m]) - 1) * len(m[-1][1]) for m in under if m), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return sorted(out.values(), key=str)


CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "so?", "é", None, ""])) for c in [*range(40), *range(100, 130), 205, 999, -7, -107] for t in range(rng.randrange(1, 7))]
    rows += [(5, None, "user", "null turn"), (5, 2, "user", "tie"), (5, 2, "user", "tie"), (None, 1, "user", "no id")] + [(300, t, "user", "x" * 50) for t in range(200)] + [(c, 0, "user", "same") for c in range(1000, 1040)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, CONVERSATIONS).withColumn("depth", F.lit("clash"))
    got = conversation_trie(df, F.expr("conv - conv % 100"), F.expr("crc32(cast(conv as string)) % 6"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_trie(rows)


def test_trie_of_no_conversation_and_without_rebuilding(spark):
    assert conversation_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    rows = [(c, t, "user", "same") for c in (3, 1, 2) for t in range(2)]
    got = {r.depth: r for r in conversation_trie(spark.createDataFrame(rows, CONVERSATIONS)).collect()}
    assert [got[d].n_convs for d in range(3)] == [3, 3, 3] and got[0].saved_tokens == 2 * 4 * 2 and got[2].ends_sha256 == hashlib.sha256(b"1,2,3").hexdigest()


def test_long_end_lists_are_hashed_in_parts(spark):
    rows = [(c, 1, 1, 2, 3, 4) for c in range(0, 3000, 3)] + [(c, 2, 9, 9, 9, 9) for c in (5, 12)]
    df = spark.createDataFrame(rows, "conv long, depth long, k0 long, k1 long, k2 long, k3 long")
    got = {r.depth: r.ends_sha256 for r in end_hashes(df, width=100).collect()}
    assert got == {1: hashlib.sha256(",".join(str(c) for c in range(0, 3000, 3)).encode()).hexdigest(), 2: hashlib.sha256(b"5,12").hexdigest()}


# ---- op12 --------------------------------------------------------------------------------------------------------


def plain_divergence(rows, least, top):
    import re

    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))) for text, lang, source in rows]
    groups, out = sorted({d[:2] for d in docs}), []
    for lang in {g[0] for g in groups}:
        held = Counter(t for l, _, terms in docs if l == lang for t in set(terms))
        kept = {t for t, n in held.items() if n >= least}
        counts = {s: Counter(t for l, x, terms in docs if l == lang and x == s for t in terms if t in kept) for l, s in groups if l == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}  # noqa: E731,B023
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        for s in counts:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s)
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, x[2], -x[0], n) for part, found in (("pair", pairs), ("term", terms)) for n, x in enumerate(found, 1)]
    return sorted(out)


def test_divergence_equals_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["The", "the", "Éa", "éa", "x", "日本", "don't", "A1b", "ß", "q" * 300, "z\x00y"])
    rows = [(" ".join(word() for _ in range(rng.randrange(12))), rng.choice(["en", "fr", None]), rng.choice(["a", "B", "é", None, ""])) for _ in range(150)]
    rows += [(None, "en", "silent"), ("", "xx", "one"), ("rare", "xx", "two"), rows[0], rows[0], ("word " * 20000, "en", "long")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit(1), "n": F.lit("n"), "rank": F.lit(0)})
    got = [tuple(r) for r in divergence(df, min_docs=8, top=4).collect()]
    assert sorted(got) == plain_divergence(rows, 8, 4)
    assert divergence(df.limit(0)).count() == 0


# ---- op13 --------------------------------------------------------------------------------------------------------


def library(texts, end=(0,)):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(BYTES)
    return [known.encode(t or "", add_special_tokens=False).ids + list(end) for t in texts]


def test_ids_of_any_text_are_those_of_the_library():
    rng = random.Random(9)
    texts = ["".join(rng.choice(NASTY) for _ in range(rng.randrange(30))) for _ in range(1500)] + ["", None, "word " * 9000, "<|endoftext|>" * 50]
    for start in range(0, len(texts), 300):
        some = texts[start : start + 300]
        assert [x.tolist() for x in token_files.encoded(pa.array(some), BYTES)] == library(some, ())


def test_equal_hashes_end_no_query(monkeypatch):
    """Where all chunks have one hash, texts are encoded whole; so for both kinds of table."""
    import sentencepiece
    from tokenizers import Tokenizer

    monkeypatch.setattr(pieces, "range_hashes", lambda data, start, end: np.ones(len(start), np.uint64))
    texts = pa.array(["some words here", "and some more", ""])
    ids, cut = token_files.WordTable(Tokenizer.from_file(BYTES)).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)] == library(texts.to_pylist(), ())
    processor = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids, cut = pieces.ChunkTable(processor).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)] == processor.encode(texts.to_pylist())


def test_keys_of_chunks_are_equal_only_for_equal_chunks():
    rng = random.Random(12)
    parts = [b"", b"a", b" ", b"\x00", b"abcdefgh", b"abcdefg", b"\xc3\xa9", b"0123456789abcdef"]
    chunks = [b for b in ("".join(rng.choice(["a", " ", "\0", "é", "日", "abcdefgh", "1234567"]) for _ in range(rng.randrange(1, 9))).encode() for _ in range(4000)) if b] + [b for b in parts if b]
    cut = np.cumsum([0, *map(len, chunks)])
    keys = list(zip(*(x.tolist() for x in token_files.chunk_keys(np.frombuffer(b"".join(chunks), np.uint8), cut[:-1], cut[1:])), strict=True))
    assert len(set(keys)) == len(set(chunks)) == len(set(zip(keys, chunks, strict=True)))


def test_chunks_of_equal_keys_are_encoded_with_their_texts(monkeypatch):
    monkeypatch.setattr(token_files, "chunk_keys", lambda data, start, end: (np.ones(len(start), np.uint64), (end - start).astype(np.uint64)))
    _, table = token_files._loaded.__wrapped__(BYTES)
    texts = pa.array(["some words here", "and some more", ""])
    ids, cut = table.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)] == library(texts.to_pylist(), ())


def test_a_large_vocabulary_goes_to_the_library_once():
    """400,000 distinct words are sent when they are met first and not again."""
    _, table = token_files._loaded.__wrapped__(BYTES)
    known, sent = table.processor, []

    class Counted:
        def encode_batch_fast(self, texts, **how):
            sent.append(sum(map(len, texts)))
            return known.encode_batch_fast(texts, **how)

    table.processor = Counted()
    texts = ["".join(f" w{i:x}" for i in range(n, n + 20_000)) for n in range(0, 400_000, 20_000)]
    first = [table.encode(pa.array([t]))[0].tolist() for t in texts]
    assert 0 < sum(sent) <= sum(map(len, texts)) + 400_000
    sent.clear()
    assert [table.encode(pa.array([t]))[0].tolist() for t in texts] == first and not sent
    assert first[3] == known.encode(texts[3], add_special_tokens=False).ids


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = [(i * 3 % 500, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "x"]) for _ in range(rng.randrange(60)))) for i in range(500)]
    rows += [(None, "no id"), (None, None), (7, "again"), (7, "again"), (7, "other"), (10_000, "long " * 60_000), (-5, "")]
    rng.shuffle(rows)
    path = f"file://{tmp_path_factory.mktemp('ids')}/out"
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit("clash"), "n": F.lit(1), "frame": F.lit(2)})
    token_files.write_token_files(df, path, BYTES, file_bytes=4096)
    return path, rows


def test_files_give_back_what_was_written(spark, stored):
    path, rows = stored
    got = sorted(token_files.read_token_files(spark, path, keep_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += r.n_tokens
    want = Counter((i, tuple(x)) for (i, _), x in zip(rows, library([t for _, t in rows]), strict=True))
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    manifest = spark.read.parquet(f"{path}/manifest").orderBy("shard").collect()
    assert len(manifest) > 3 and sum(r.documents for r in manifest) == len(rows) and manifest[0].start == 0
    assert len(token_files.read_dictionary(spark, path)) > 0


def test_a_few_documents_are_read_from_few_files(spark, stored):
    path, rows = stored
    got = token_files.read_token_files(spark, path, ids=[7, 10_000, 123_456], keep_ids=True).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows if i in (7, 10_000))
    whole = {(r.doc_id, r.start): r.ids_crc32 for r in token_files.read_token_files(spark, path).collect()}
    assert all(whole[r.doc_id, r.start] == r.ids_crc32 for r in got)
    assert token_files.read_token_files(spark, path, ids=[123_456]).count() == 0


def test_a_damaged_file_or_another_dictionary_is_told(spark, stored):
    path, _ = stored
    sent = spark.sparkContext.broadcast(b"another dictionary")
    with pytest.raises(PySparkException, match="another dictionary"):
        token_files._opened(spark, path).mapInArrow(token_files._summaries(sent), "shard bigint, first_id bigint, last_id bigint, documents bigint, ids bigint").count()
    with pytest.raises(ValueError, match="whole file"):
        token_files._parsed(pa.scalar(b"IDFILE01" + b"\0" * 100, pa.binary()), b"")


def test_no_document_and_few_documents(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    token_files.write_token_files(none, f"file://{tmp_path}/none", BYTES)
    assert token_files.read_token_files(spark, f"file://{tmp_path}/none").count() == 0
    got = token_files.token_round_trip(spark.createDataFrame([(1, None)], "doc_id long, text string"), BYTES).collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == [(1, 0, 1, zlib.crc32(b"\0\0\0\0"))]


def test_registered_token_files(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op13_token_files(spark, sf_dir).collect()}
    rows = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    at = 0
    for (i, _), ids in zip(rows, library([r.text for r in rows]), strict=True):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(rows)


# ---- op10: short items, hot templates ----------------------------------------------------------------------------


def test_short_items_are_found_verbatim(spark):
    items = ["What is 12 plus 7?", "Compute 15 - 8", "Solve 3 x = 9", "Convert 5 kg to grams", "12", None, ""]
    docs = [f"Well then: {x} And so on." if x else x for x in items[:4]] + items[:4] + ["What is 13 plus 7?", "we compute 15 or 8", "12", None, ""]
    got = contaminated_by(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), carry=["doc_id"]).collect()
    assert {r.doc_id: r["items"] for r in got} == {i: [i % 4] if i < 8 else [] for i in range(13)}


def test_many_variants_of_one_template_are_one_group():
    rng = random.Random(6)
    text = lambda name: f"A shop has {rng.randrange(10**6)} apples and {rng.randrange(10**6)} pears and sells {rng.randrange(10**6)} of them to {name} how many apples are left in the shop"
    items = [text("Ann") for _ in range(3000)]
    block = decontamination._block(pa.array(items), list(range(3000)), 8, 4, 0.5)
    assert len(block.groups) == 1
    sheet = ". ".join(text("Zed") for _ in range(1000))
    mixed = " and ".join(x.replace("apples", "apples 5") for x in sheet.split(". ")[:50])
    got = decontamination.matches(block, pa.array([sheet, mixed, items[17], "nothing of it"]))
    assert got[0] == list(range(3000)) == got[2] and 3 not in got


def test_small_letters_and_capitals_hide_no_name():
    items = ["Peter sells 12 loaves and 7 cakes to Maria for 45 dollars on Monday then he sells 9 loaves", "FOUR FRIENDS OF ANNA BUY 3 TICKETS FOR THE SHOW IN BERLIN ON FRIDAY"]
    block = decontamination._block(pa.array(items), ["a", "b"], 8, 4, 0.5)
    got = decontamination.matches(block, pa.array([items[0].lower(), "Four friends of Anna buy 3 tickets for the show in Berlin on Friday", items[0].upper()]))
    assert got == {0: [0], 1: [1], 2: [0]}


# ---- op6: the fit, other scripts; empty tables and long texts of others ------------------------------------------


def test_every_parameter_comes_to_rest():
    rng = np.random.default_rng(2)
    n, names = 400, np.arange(6)
    label = (rng.random(n) < 0.3).astype(int)
    sentence, place, cut = [], [], [0]
    for y in label:
        for s in range(3):
            for w in range(6):
                if rng.random() < (0.35 if (w < 3 and y and s == 0) else 0.06):
                    sentence.append(s)
                    place.append(w)
        cut.append(len(sentence))
    lists = lambda x: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, pa.int32()))
    marks = names < 3
    solve = lambda steps: toxicity._solve(label, lists(sentence), lists(place), names, marks, steps, 0.1)
    m = solve(300)

    def loss(theta, bias, leak):
        total = 0.05 / n * (theta**2).sum()
        for d in range(n):
            clean = 1 / (1 + np.exp(leak))
            for s in range(3):
                mine = [place[k] for k in range(cut[d], cut[d + 1]) if sentence[k] == s]
                if any(marks[w] for w in mine):
                    clean *= 1 / (1 + np.exp(bias + theta[mine].sum()))
            total -= np.log(1 - clean if label[d] else clean) / n
        return total

    at = np.concatenate([m.weights, [m.bias, np.log(m.leak / (1 - m.leak))]])
    slope = [(loss((x := at.copy() + np.eye(8)[i] * 1e-4)[:6], x[6], x[7]) - loss((y := at.copy() - np.eye(8)[i] * 1e-4)[:6], y[6], y[7])) / 2e-4 for i in range(8)]
    assert np.abs(slope).max() < 2e-3 and abs(m.bias + 4) > 0.1


def test_sentences_of_other_scripts():
    w = words(pa.array(["你好。世界！ok now", "क ख। ग", "カナ test。"]), NOT_ALNUM, lower=True, marks=toxicity.WIDE_ENDS)
    said = [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)]
    assert said == ["你", "好", "世", "界", "ok", "now", "क", "ख", "ग", "カ", "ナ", "test"]
    assert toxicity.sentences(w).tolist() == [0, 0, 1, 1, 2, 2, 3, 3, 4, 5, 5, 5]


def test_empty_tables_and_long_texts(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert encode_decode(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES).count() == 0
    import sentencepiece

    long = "some words and others " * 40_000
    known = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    r = encode_decode(spark.createDataFrame([(1, long)], "doc_id long, text string"), public_tokenizers.path("piece_bpe_32k.model")).first()
    assert r.n_tokens == len(known.encode(long)) + 2
    item = "the quick brown fox jumps over the lazy dog near the old river bank today"
    docs = spark.createDataFrame([(1, long + item), (2, long)], "doc_id long, text string")
    got = contaminated_by(docs, spark.createDataFrame([(9, item)], "item_id long, text string"), carry=["doc_id"]).collect()
    assert {r.doc_id: r["items"] for r in got} == {1: [9], 2: []}


def test_carried_columns_of_made_names_are_replaced(spark):
    df = spark.createDataFrame([(1, "some words", "x", "y")], "doc_id long, text string, n_tokens string, score string")
    assert encode_decode(df, public_tokenizers.path("piece_bpe_32k.model"), carry=["doc_id", "n_tokens"]).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    none = toxicity.Model(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool), 0.0, 0.1)
    got = toxicity.score(df, none, carry=["doc_id", "score"])
    assert got.columns == ["doc_id", "score", "spans"] and 0 < got.first().score < 0.2


def test_stages_of_an_empty_table(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
