"""Text operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import struct
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowloom.llm import pii
from flowloom.llm.decontamination import contaminated_by
from flowloom.operators.graphs import connected_components
from flowloom.llm.line_dedup import drop_boilerplate
from flowloom.llm.near_duplicates import least_matches, near_duplicates
from flowloom.llm.pieces import ChunkTable, encode_decode
from flowloom.llm.quality import binomial_tail, judge
from flowloom.llm.token_counts import _table_of, _tokenizer, counted, has_apart_words, token_counts
from flowloom.llm.token_files import WordTable
from flowloom.llm.toxicity import fit, score
from flowloom.llm.url_filter import Automaton, UrlRule, judge_urls
from flowloom.llm.warc import round_trip

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\n", "a", "é Å ﬁ 😀 \x00 x", "<|endoftext|> <s> it's ▁ two  spaces\t\r\n", "word " * 3000, "x" * 5000, "日本語のテキスト" * 50]


def documents(spark, texts, extra=""):
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, one row twice, a null id, and columns whose names clash with those the operators make."""
    df = documents(spark, ODD)
    twice = df.unionByName(df.where("doc_id = 6")).unionByName(df.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    return twice.withColumns({c: F.lit("clash") for c in ("key", "n", "score", "spans", "items", "host", "rep", "id", "label", "n_tokens", "n_lines", "kept")})


# ---- tokens ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("sizes", [{}, {"huge_chars": 40, "chunk_chars": 30, "overlap_chars": 6}])
def test_token_counts_are_the_library_s(spark, odd, sizes):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    want = Counter((r.doc_id, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts(odd, WORDS, **sizes).collect())
    assert got == want
    assert token_counts(odd.limit(0), WORDS).count() == 0


def test_texts_without_white_space_are_spliced_at_marks(spark):
    from tokenizers import Tokenizer

    from flowloom.llm import token_counts as module

    rng, t = random.Random(3), Tokenizer.from_file(WORDS)
    letters = "日本語のテキスト한국éЖabc'e\u0301\u030a5"
    texts = ["".join(rng.choice(letters) if rng.random() < 0.9 else rng.choice("。、,.;!'\"") for _ in range(3000)) for _ in range(20)]
    assert {"。", ",", "."} <= module.breaks(t) and "'" not in module.breaks(t)
    rows = {r.doc_id: r for r in token_counts(documents(spark, texts), WORDS, huge_chars=500, chunk_chars=400, overlap_chars=100).collect()}
    assert all(rows[i].n_tokens == len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts))
    assert sum(r.n_chunks == 8 for r in rows.values()) >= 15


def test_pieces_are_the_library_s(spark, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def digest(text):
        ids = sp.encode(text or "", add_bos=True, add_eos=True)
        return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()

    want = Counter((r.doc_id, *digest(r.text)) for r in odd.collect())
    assert Counter(tuple(r) for r in encode_decode(odd, PIECES).collect()) == want
    tiny = encode_decode(odd, PIECES, keep_ids=True, table_limit=2)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in tiny.collect()) == want
    assert all(len(r.ids) == r.n_tokens for r in tiny.collect())
    table, rng = ChunkTable(sp, limit=3, longest=6), random.Random(1)
    for _ in range(60):
        texts = ["".join(rng.choice(" ▁ab1é\n ") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(6))]
        ids, cut = table.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)] == [sp.encode(t) for t in texts]
        assert len(table.hash) <= 3


# ---- near duplicates ---------------------------------------------------------------------------------------------


def shingle_set(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(rows, threshold=0.8):
    sets = {i: shingle_set(t) for i, t in rows}
    links = {i: {j for j, b in sets.items() if i != j and a and b and len(a & b) >= threshold * len(a | b)} for i, a in sets.items()}
    root = {}
    for i in sorted(sets):
        if i not in root:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = i
                    todo += links[x]
    return {i: (root[i], len(links[i])) for i in sets}


def near_copies(n, seed=3, length=120):
    """A group of near copies, a chain whose ends are not alike, exact copies, and loners that share a passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, passage = [word() for _ in range(length)], [word() for _ in range(60)]
    texts = []
    for _ in range(n):
        copy = list(base)
        copy[rng.randrange(length)] = word()
        texts.append(" ".join(copy))
    chain = [word() for _ in range(length)]
    for _ in range(6):
        texts.append(" ".join(chain))
        chain = chain[5:] + [word() for _ in range(5)]
    texts += [" ".join(base)] * 5 + [" ".join([*passage, *(word() for _ in range(90))]) for _ in range(10)]
    return texts + ["too short", "too short", "", " ", None, "one"]


@pytest.mark.parametrize("block", [1024, 8])
def test_near_duplicates_are_those_of_all_pairs(spark, block):
    docs = documents(spark, near_copies(60))
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates(docs, block=block).collect()}
    assert got == brute_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_near_duplicates_on_odd_rows(spark, odd):
    rows = near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    twice = [r for r in rows if r.doc_id == 6]
    assert [r.n_links for r in twice] == [1, 1] and all(r.class_id is None for r in rows if r.doc_id is None)
    assert near_duplicates(odd.limit(0)).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    least = least_matches(0.8, 1e-5)
    lost = sum(math.comb(128, m) * 0.8**m * 0.2 ** (128 - m) for m in range(least[128]))
    assert least[16] < 13 and lost < 1e-4


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 303


# ---- personal data -----------------------------------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            out += [f"{kind}:{m.start()}:{m.end()}"] * bool(fine)
    return ",".join(out)


def test_base_spans_are_those_of_the_plain_patterns(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("a@.1 +-(9_é4") for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["a@b.co_x@d.e", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "+1 (234) 555-0199", "1" * 8000, "a@" + "a." * 4000 + "b", "é@x.y", *ODD]
    docs = documents(spark, texts)
    got = {r.doc_id: r.t for r in pii.find(docs, None).select("doc_id", pii.as_text(F.col("base")).alias("t")).collect()}
    assert got == {i: base_spans(t) for i, t in enumerate(texts)}


def test_model_adds_secrets_and_redaction_hides_all(spark):
    rng = random.Random(2)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    texts = [f'some words token = "{h}" and more' for h in hexes] + [f"order {rng.randrange(10**15, 10**16)} of {rng.randrange(10**9)} items" for _ in range(120)]
    docs = documents(spark, texts)
    model = pii.fit(docs, sample_docs=1000)
    found = pii.find(docs, model)
    kinds = Counter(s.kind for r in found.collect() for s in r.spans)
    assert kinds["secret"] >= 55
    hidden = docs.join(found, "doc_id").select("doc_id", pii.redact(F.col("text"), F.col("spans")).alias("t")).collect()
    assert sum("[secret]" in r.t and hexes[r.doc_id] not in r.t for r in hidden if r.doc_id < 60) >= 55


def planted_secrets(seed, n):
    """Texts with planted keys of several formats and numbers, and what only looks like them; the planted spans of each."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    upper, lower, digits = "ABCDEFGHJKLMNPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"

    def card():
        body = pick(digits, 15)
        return body + next(c for c in digits if luhn(body + c))

    real = [lambda: pick("0123456789abcdef", 40), lambda: "AKIA" + pick(upper + digits, 16), lambda: "ghp_" + pick(upper + lower + digits, 36), card, lambda: f"{pick(lower, 6)}@{pick(lower, 5)}.org"]
    fake = [lambda: f"release-{rng.randrange(9)}-{rng.randrange(99)}-candidate-{pick(lower, 8)}", lambda: f"/srv/{pick(lower, 6)}/v{rng.randrange(9)}/{pick(lower, 7)}.txt", lambda: str(rng.randrange(10**8, 10**9)), lambda: f"{pick(lower, 4)}@{pick(lower, 4)}", lambda: "2024-05-17 10-22-31"]
    texts, planted = [], []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randrange(1, 5)):
            text += " ".join(pick(lower, 5) for _ in range(6)) + rng.choice([" ", " value = ", " see: "])
            is_real = rng.random() < 0.5
            value = rng.choice(real if is_real else fake)()
            spans += [(len(text), len(text) + len(value))] * is_real
            text += value + " "
        texts.append(text)
        planted.append(spans)
    return texts, planted


def test_planted_secrets_of_texts_not_learnt_from(spark):
    """Precision and recall on texts of another seed than those that the model is fitted on."""
    model = pii.fit(documents(spark, planted_secrets(1, 1500)[0]))
    texts, planted = planted_secrets(2, 400)
    found = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in pii.find(documents(spark, texts), model).collect()}
    inside = lambda a, b: a[0] < b[1] and b[0] < a[1]
    told = [(s, planted[i]) for i, spans in found.items() for s in spans]
    recall = sum(any(s[0] <= p[0] and s[1] >= p[1] for s in found[i]) for i, ps in enumerate(planted) for p in ps) / sum(map(len, planted))
    precision = sum(any(inside(s, p) for p in ps) for s, ps in told) / len(told)
    assert recall >= 0.95 and precision >= 0.9, (recall, precision)


def test_spans_are_those_of_all_pairs(spark):
    """Placing and dropping spans, against plain Python over the scores that the operator gives when nothing is dropped."""
    model = pii.fit(documents(spark, planted_secrets(1, 600)[0]))
    texts = [*planted_secrets(3, 60)[0], *ODD, " ".join(planted_secrets(4, 30)[0])]
    docs = documents(spark, texts)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    kinds = [k for k in pii.MORE if k in model.thresholds]
    named = lambda k: F.transform(k, lambda s: F.struct(F.lit(k).alias("kind"), s.alias("s")))
    each = pii._found(rows, "t", pii.MORE).select("doc_id", F.explode(F.flatten(F.array(*map(named, kinds)))).alias("c"))
    scored = each.select("doc_id", "c.kind", "c.s.start", "c.s.end", "c.s.text", model.probability(pii._features(F.col("c.kind"), F.col("c.s"))).alias("p")).collect()
    more = {i: [] for i in range(len(texts))}
    for r in scored:
        assert texts[r.doc_id][r.start : r.end] == r.text
        if r.p >= model.thresholds[r.kind]:
            more[r.doc_id].append((r.kind, r.start, r.end))
    for i, spans in {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find(docs, model).collect()}.items():
        base = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in base_spans(texts[i]).split(",") if x)]
        holds = lambda b, s: b[1] <= s[1] and b[2] >= s[2]
        larger = lambda b, s: holds(b, s) and (b[2] - b[1] > s[2] - s[1] or b[0] > s[0])
        free = [s for s in more[i] if not any(holds(b, s) for b in base) and not any(larger(b, s) for b in more[i])]
        assert spans == base + sorted(free, key=lambda s: (list(pii.MORE).index(s[0]), s[1]))


def test_a_long_text_of_many_matches_ends(spark):
    model = pii.fit(documents(spark, planted_secrets(1, 600)[0]))
    line = "10.0.0.1 mail a@b.org token = 0123456789abcdef0123456789abcdef01234567 call +1 234 555 0199\n"
    n = 4_000_000 // len(line)
    began = time.time()
    (r,) = pii.find(documents(spark, [line * n]), model).select(F.size("base").alias("base"), F.size("spans").alias("spans")).collect()
    assert r.base == 3 * n and r.spans >= 4 * n and time.time() - began < 60


def test_cutoffs_are_calibrated():
    assert pii.cutoff({10: (50, 0), 90: (50, 50)}, 0.95) == (90 + 10 + 1) / 200
    assert pii.cutoff({60: (10, 10), 90: (50, 50)}, 0.95) == 0.5 and pii.cutoff({90: (50, 10)}, 0.95) is None
    assert pii.cutoff({5: (100, 0), 70: (20, 20), 80: (20, 16), 90: (100, 100)}, 0.95) == (90 + 80 + 1) / 200  # 70 and 80 are pooled


def test_redaction_of_overlapping_spans(spark):
    row = spark.sql("select 'abcdefghij' as t, array(named_struct('kind','x','start',2,'end',5), named_struct('kind','y','start',4,'end',7), named_struct('kind','z','start',8,'end',9)) as s")
    assert row.select(pii.redact(F.col("t"), F.col("s")).alias("r")).first().r == "ab[x]h[z]j"


def test_the_sample_is_bounded_by_rows_and_characters(spark):
    texts = planted_secrets(5, 300)[0]
    assert pii.fit(documents(spark, texts), sample_docs=100) is not None
    assert pii.fit(documents(spark, ["x" * 1000] * 50), sample_chars=10) is None


def test_trees_and_thresholds_come_from_all_documents(spark):
    """Every candidate stands in the ten thousandth and later documents of the order in which a bounded look takes them; copies and null ids count too."""
    late = {r.id for r in spark.range(10_400).select("id", F.xxhash64("id", F.lit(17)).alias("draw")).orderBy("draw").tail(400)}
    planted = iter(planted_secrets(6, 400)[0])
    docs = documents(spark, [next(planted) if i in late else "plain words" for i in range(10_400)])
    model = pii.fit(docs)
    assert model is not None and {"key", "address"} <= set(model.thresholds) and pii.fit(docs, sample_docs=6_000) is None
    every = pii.candidates(docs.unionByName(docs).unionByName(docs.withColumn("doc_id", F.lit(None).cast("long"))))
    found = pii._found(docs.where("text is not null"), "text", pii.MORE).select(F.sum(sum(F.size(k) for k in pii.MORE))).first()[0]
    assert every.agg(F.sum("weight")).first()[0] == 3 * found


def test_personal_data_in_odd_rows(spark, odd):
    assert pii.find(odd, pii.fit(odd)).count() == odd.count()
    assert pii.fit(odd.limit(0)) is None and pii.find(odd.limit(0), None).count() == 0


# ---- urls --------------------------------------------------------------------------------------------------------


def test_automaton_agrees_with_regular_expressions():
    rng = random.Random(4)
    globs = [UrlRule("block", h, p, sub) for h in ("ab", "a*b", "*c", "b?a") for p in ("", "/", "/x*y", "/?z") for sub in (True, False)]
    machine = Automaton(globs)

    def pattern(r):
        part = lambda t, any_: "".join(any_ + "*" if c == "*" else any_ if c == "?" else re.escape(c) for c in t)
        return re.compile((r"[^\0]*" if r.subdomains else "") + r"\." + part(r.host, r"[^\0]") + r"\0" + part(r.path, r"[^\0]") + r"(?s:.*)", re.S)

    rules = [pattern(r) for r in machine.rules]
    texts = ["." + "".join(rng.choice("abc.") for _ in range(rng.randrange(6))) + "\0" + "".join(rng.choice("/xyz") for _ in range(rng.randrange(6))) for _ in range(2000)]
    want = [next((i for i, p in enumerate(rules) if p.fullmatch(t)), -1) for t in texts]
    assert machine.match(texts).tolist() == want


def test_urls_of_odd_shapes(spark):
    urls = [None, "", "no scheme/en/", "http://", "HTTP://A.Example.COM:80/en/x?q#f", "x://www.example.com/en/", "http://com", "a://b.net?x", "http://é.net/fr/\0", "http://a.com/" + "p" * 50_000]
    pages = spark.createDataFrame(list(enumerate(urls)) * 2, "page_id int, url string")
    rules = [UrlRule("allow", "com", "/"), UrlRule("block", "example.com", "/en/"), UrlRule("allow", "www.example.com", "/en/"), UrlRule("block", "net", "/fr/")]
    rows = judge_urls(pages, rules).collect()
    got = {r.page_id: (r.host[:20], r.rule, r.verdict) for r in rows}
    assert len(rows) == 20
    assert got[0] == got[1] == got[2] == got[3] == ("", None, "allow")
    assert got[4] == ("a.example.com:80", None, "allow") and got[5][1:] == ("www.example.com/en/", "allow") and got[6] == ("com", None, "allow")
    assert got[7] == ("b.net", None, "allow") and got[8][1:] == ("net/fr/", "block") and got[9][1:] == ("com/", "allow")


def test_registered_rules_on_made_urls_are_those_of_the_sql(spark, tmp_path):
    from flowloom.llm.queries import OP5_SQL, op5_url_filter
    from tests.oracle import compare

    rng = random.Random(6)
    hosts = ["free-bets.example.net", "a.free-bet.example.net", "adult-x.example.org", "adult-xx.org", "ads-track.net", "ads-tk.org", "x.com", "casino.free-betz.cheap-pills.org", "spam-farm.example.net", "www.example.com"]
    paths = ["", "/en/1", "/es/", "/fr/x", "/wp-login.php", "/a/b/wp-.php?x", "/wp-x", "/en/wp-admin/y.php"]
    rows = [(i, f"http://{rng.choice(hosts)}{rng.choice(paths)}", "", "clash") for i in range(300)]
    spark.createDataFrame(rows, "page_id long, url string, html string, host string").write.parquet(f"{tmp_path}/pages.parquet")
    assert compare(op5_url_filter(spark, str(tmp_path)), OP5_SQL, str(tmp_path)) == ""


# ---- toxicity ----------------------------------------------------------------------------------------------------


def toxic_corpus(spark, n=600):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcde") for _ in range(4))
    sentence = lambda bad: " ".join([word() for _ in range(8)] + (["vile"] if bad else [])) + "."
    texts, toxic = [], []
    for _ in range(n):
        bad = rng.random() < 0.2
        at = rng.randrange(5)
        texts.append(" ".join(sentence(bad and i == at) for i in range(5)))
        toxic.append(int(bad))
    return documents(spark, texts), spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int"), toxic


def test_toxicity_learns_from_documents_and_points_at_sentences(spark):
    docs, labels, toxic = toxic_corpus(spark)
    model = fit(docs, labels, where=F.col("doc_id") % 5 != 0)
    rows = {r.doc_id: r for r in score(docs, model).collect()}
    held = [i for i in rows if i % 5 == 0]
    assert all((rows[i].score >= 0.5) == bool(toxic[i]) for i in held)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all("vile" in text[i][s.start : s.end] for i in held for s in rows[i].spans)


def test_toxicity_of_odd_rows(spark, odd):
    docs, labels, _ = toxic_corpus(spark, 100)
    model = fit(docs, labels)
    rows = score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert [r.score for r in rows if r.doc_id in (0, 1)] == [0.0, 0.0]
    assert fit(docs, labels.limit(0)).weights.size == 0 and fit(docs.limit(0), labels).weights.size == 0
    assert score(odd.limit(0), model).count() == 0


def test_toxicity_does_not_rise_with_length(spark):
    docs, labels, toxic = toxic_corpus(spark)
    flipped = labels.withColumn("toxic", F.when(F.col("doc_id") % 20 == 7, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    model = fit(docs, flipped)
    clean = [t for (t,), bad in zip(docs.orderBy("doc_id").select("text").collect(), toxic, strict=True) if not bad]
    long = (" ".join(clean) + " ") * (20_000 // (5 * len(clean)) + 1)
    assert long.count(".") >= 20_000
    a, b = score(documents(spark, [long, f"{long} so vile."]), model).orderBy("doc_id").collect()
    assert a.score < 0.2 and not a.spans and b.score >= 0.5 and len(b.spans) == 1


def test_toxicity_is_learnt_from_long_texts_too(spark):
    text = {True: "filler words. " * 2_000 + "so vile.", False: "filler words. " * 2_000}
    toxic = [i % 4 == 0 for i in range(120)]
    labels = spark.createDataFrame([(i, int(x)) for i, x in enumerate(toxic)], "doc_id long, toxic int")
    rows = score(documents(spark, ["so vile.", "filler words."]), fit(documents(spark, [text[x] for x in toxic]), labels)).orderBy("doc_id").collect()
    assert rows[0].score >= 0.5 > rows[1].score


# ---- lines -------------------------------------------------------------------------------------------------------


def test_boilerplate_lines_go_and_salting_changes_nothing(spark, monkeypatch):
    from flowloom.llm import line_dedup

    texts = [f"menu\nown {i}\n\n menu \nend" if i % 3 else f"own {i}" for i in range(60)] + [None, "", "menu"]
    docs = documents(spark, texts).withColumn("source", F.when(F.col("doc_id") % 4 > 0, F.lit("big")))
    want = {i: None if t is None else "\n".join(x for x in t.split("\n") if x.strip() not in ("menu", "end")) for i, t in enumerate(texts)}
    plain = {r.doc_id: r.text for r in drop_boilerplate(docs).collect()}
    assert plain == want
    monkeypatch.setattr(line_dedup, "SENT_HOSTS", -1)
    assert {r.doc_id: r.text for r in drop_boilerplate(docs).collect()} == want


def test_lines_of_odd_rows(spark, odd):
    out = drop_boilerplate(odd)
    assert out.count() == odd.count() and drop_boilerplate(odd.limit(0)).count() == 0
    assert {r.doc_id: r.n_dropped for r in out.collect() if r.doc_id == 7} == {7: 0}


# ---- quality -----------------------------------------------------------------------------------------------------


def test_binomial_tail_is_exact(spark):
    rows = [(n, k) for n in (50, 700, 3000) for k in (0, 1, n // 300)]
    got = spark.createDataFrame(rows, "n long, k long").select(binomial_tail(F.col("n"), F.col("k"), 0.01).alias("p")).collect()
    for (n, k), r in zip(rows, got, strict=True):
        want = sum(math.comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1)) if k < n * 0.01 else 1.0
        assert r.p == pytest.approx(want, rel=1e-9)


def test_quality_cutoffs_hold_their_risk(spark):
    rng = random.Random(8)
    good = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30)) for _ in range(1500)]
    junk = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) + "###" for _ in range(30)) for _ in range(200)]
    docs = documents(spark, good + junk)
    labels = spark.createDataFrame([(i, int(i < len(good)), 0) for i in range(len(good) + len(junk))], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in judge(docs, labels).collect()}
    assert all(kept[i] for i in range(len(good))) and not any(kept[i] for i in range(len(good), len(kept)))
    few = {r.doc_id: r.kept for r in judge(docs, labels.limit(50)).collect()}
    assert all(few.values())


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, None), (None, 1), (6, 1), (6, 0), (99, 1)], "doc_id long, quality int")
    rows = judge(odd, labels).collect()
    assert len(rows) == odd.count() and judge(odd.limit(0), labels.limit(0)).count() == 0
    assert {r.n_repeat_words for r in rows if r.doc_id == 7} == {3000}


# ---- archives ----------------------------------------------------------------------------------------------------

EVIL = "<p>WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nWARC/1.1\r\nhello"


def test_archives_survive_magic_in_payloads(spark):
    pages = [(1, "http://a", EVIL), (2, None, None), (3, "u", ""), (4, "x\r\ny", EVIL), (None, "z", "q"), (5, "z", "WARC/1.1\r\n"), (6, "é", "é" * 1000), (7, "a", "q"), (7, "a", "q")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = round_trip(df).collect()
    assert Counter(r.page_id for r in rows) == Counter(p[0] for p in pages)
    by = {r.page_id: r for r in rows}
    for i, _, html in pages:
        raw = (html or "").encode()
        assert by[i].payload_bytes == len(raw) and by[i].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert by[i].record_type == "revisit" or bytes(by[i].payload) == raw
    assert {i: r.refers_to for i, r in by.items() if r.record_type == "revisit"} == {3: 2, 4: 1, None: 7}
    assert round_trip(df.limit(0)).count() == 0


# ---- decontamination ---------------------------------------------------------------------------------------------


def test_copies_and_reparameterised_items_are_found(spark):
    question = "In the shop Tom has 12 apples and gives 5 apples to Sara in the morning before lunch. How many apples are left with Tom after 3 hours of the day"
    items = spark.createDataFrame([(1, question), (2, "short walk"), (3, None), (4, ""), (None, question)], "item_id long, text string")
    texts = [
        f"before it. {question} and after", question.upper(), question.replace("Tom", "Bob").replace("12", "31").replace("Sara", "Ann").replace("hours", "days"),
        question.replace("Tom has", "Bob has").replace("with Tom", "with Jim").replace("12 apples", "5 apples").replace("gives 5", "gives 7"), "Tom has a short walk", "a short one here", *ODD,
    ]
    docs = documents(spark, texts).withColumn("items", F.lit("old"))
    got = {r.doc_id: r["items"] for r in contaminated_by(docs, items).collect()}
    assert got[0] == got[1] == got[2] == [1, None] and got[4] == [2]
    assert got[5] == [] and all(got[i] == [] for i in range(6, len(texts)))
    strict = {r.doc_id: r["items"] for r in contaminated_by(docs, items, share=0.9, block_items=1).collect()}
    assert strict[2] == [1, None] and strict[3] == []
    assert contaminated_by(docs, items.limit(0)).where(F.size("items") > 0).count() == 0 and contaminated_by(docs.limit(0), items).count() == 0


def test_copies_beside_variants_and_items_with_parallel_clauses_are_found(spark):
    rng = random.Random(4)
    names = ["Tom", "Sara", "Peter", "Susan", "Maria", "Ivan", "Bob", "Ann", "Karl", "Nina"]
    days = ["Monday", "Tuesday", "Friday", "Sunday"]

    def values():
        return [rng.choice(names) for _ in range(3)], [rng.randrange(2, 99) for _ in range(6)], rng.sample(days, 2)

    def clauses(a, n, d):
        return f"The baker sells {n[0]} loaves and {n[1]} cakes to {a[0]} for {n[2]} dollars on {d[0]}, then {n[3]} loaves and {n[4]} cakes to {a[1]} for {n[5]} dollars on {d[1]}."

    def question(a, n, d):
        return f"In the shop {a[0]} has {n[0]} apples and gives {n[1]} apples to {a[1]} in the morning before lunch, then buys {n[2]} pears from {a[2]} at the market, so how many fruits are left after {n[3]} hours?"

    items, texts, want = [], [], []
    for i in range(40):
        make = (clauses, question)[i % 2]
        item = make(*values())
        items.append((i, item))
        sheet = [make(*values()) for _ in range((0, 1, 4, 9)[i // 2 % 4])]
        sheet.insert(rng.randrange(len(sheet) + 1), item)
        texts.append("\n".join(sheet))
        want.append(i)
    for i in range(40):
        first = values()
        changed = [[names[(names.index(x) + 5) % 10] for x in first[0]], [x + 100 + k for k, x in enumerate(first[1])], first[2]]
        make = (clauses, question)[i % 2]
        items.append((40 + i, make(*first)))
        texts.append("\n".join([make(*values()), make(*changed), make(*values())]))
        want.append(40 + i)
    got = {r.doc_id: r["items"] for r in contaminated_by(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert [i for i, k in enumerate(want) if k not in got[i]] == []


def test_formulas_have_literal_windows(spark):
    formula = "Compute 12 + 7 - 3 * 45 / 9 + 61 - 8 * 14 + 90"
    items = spark.createDataFrame([(1, formula), (2, "5 6 7"), (None, "9 8 7 6 5 4 3 2 1 0 11 12")], "item_id long, text string")
    texts = [f"task: {formula}", formula.replace("45", "46").replace("12", "99").replace("8", "77"), "5 6 7 8", "so 9 8 7 6 5 4 3 2 1 0 11 12 end", None]
    got = {r.doc_id: r["items"] for r in contaminated_by(documents(spark, texts), items).collect()}
    assert got == {0: [1], 1: [], 2: [], 3: [None], 4: []}


def test_contamination_with_repeated_rows_and_tied_items(spark):
    text = "the quick brown fox jumps over the lazy dog near the quiet river bank today"
    items = spark.createDataFrame([(5, text), (3, text), (4, "something else that no document has in it at all here")], "item_id long, text string")
    docs = documents(spark, [text, "nothing"]).unionByName(documents(spark, [text]))
    for size in ({}, {"block_items": 1}, {"block_chars": 10}):
        assert sorted((r.doc_id, r["items"]) for r in contaminated_by(docs, items, **size).collect()) == [(0, [3, 5]), (0, [3, 5]), (1, [])]


def test_repeated_payloads_too_many_to_send(spark, monkeypatch):
    from flowloom.llm import warc

    pages = [(i, f"u{i}", EVIL if i % 7 == 0 else f"p{i % 5}" if i % 2 else f"own {i}") for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("id", "payload", "first", "size", "slot")})
    want = {r.page_id: (r.record_type, r.refers_to, r.payload_digest) for r in round_trip(df).collect()}
    monkeypatch.setattr(warc, "small_or_whole", lambda t, name, *a: (t, False))
    assert {r.page_id: (r.record_type, r.refers_to, r.payload_digest) for r in round_trip(df).collect()} == want and len(want) == 60


def test_a_long_payload_full_of_magic(spark):
    html = "x" * 3_000_000 + EVIL * 300
    df = spark.createDataFrame([(1, "u", html), (2, "v", "after")], "page_id long, url string, html string")
    rows = {r.page_id: bytes(r.payload) for r in round_trip(df).collect()}
    assert rows == {1: html.encode(), 2: b"after"}


def test_words_of_all_lengths_have_hashes_of_their_own():
    from flowloom.llm import _words

    x = [0]
    while len(x) < 4096:
        x += [1 - v for v in x]
    for n in (1024, 2048, 4096):
        a, b = bytes(65 + v for v in x[:n]), bytes(66 - v for v in x[:n])
        one, two = _words.words(pa.array([a.decode(), b.decode()])).hash
        assert one != two


def test_rows_of_one_id_with_two_texts(spark):
    text = [" ".join(f"{k}{i}" for i in range(30)) for k in "ab"]
    docs = spark.createDataFrame([(1, text[0]), (1, text[1]), (2, text[1])], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id) for r in near_duplicates(docs).collect()) == [(1, 1), (1, 1), (2, 1)]


def test_near_duplicates_in_blocks_of_few_shingles(spark, monkeypatch):
    from flowloom.llm import near_duplicates as module

    monkeypatch.setattr(module, "BLOCK_SHINGLES", 500)
    docs = documents(spark, near_copies(30))
    assert {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates(docs).collect()} == brute_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_names_and_numbers_of_other_languages_are_placeholders(spark):
    pairs = [
        ("heute haben wir zwölf davon gesehen und dann noch fünf mehr gekauft aber Ömer wollte nach drei Tagen wieder alles zurück haben weil er ja sonst nie etwas sagt", "heute haben wir neun davon gesehen und dann noch zwei mehr gekauft aber Élodie wollte nach vier Wochen wieder alles zurück haben weil er ja sonst nie etwas sagt"),
        ("в магазине утром Иван купил 12 яблок и отдал 5 яблок соседке Марии сколько яблок осталось вечером у мальчика Иван", "в магазине утром Пётр купил 31 яблок и отдал 7 яблок соседке Ольге сколько яблок осталось вечером у мальчика Пётр"),
    ]
    items = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "item_id long, text string")
    texts = [b for _, b in pairs] + [a.upper() for a, _ in pairs] + ["İ " + pairs[0][0], "heute haben wir alles gesehen und er sagt nie etwas"]
    got = {r.doc_id: r["items"] for r in contaminated_by(documents(spark, texts), items).collect()}
    assert got == {0: [0], 1: [1], 2: [0], 3: [1], 4: [0], 5: []}


# ---- tables of chunks --------------------------------------------------------------------------------------------

CHUNKY = ["a", "B", "e\u0301", "\u0301", "Σ", "İ", " ", "  ", "\n", "\t", "\xa0", "\u2003", "\u3000", "\x1c", "\u200b", "'s", "'S", "'", "=", "\u0338", "<", "|>", "<|startoftext|>", "<|endoftext|>", "endoftext", "5", "½", "日本", "テ", "...", "#", "_", "\0", "don't"]


def chunky_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(CHUNKY) for _ in range(rng.randrange(25))) for _ in range(n)]


def test_counts_of_chunks_are_the_librarys():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = chunky_texts(1, 3000)
    assert counted(texts, path) == [len(x) for x in _tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


def test_a_chunk_is_counted_once(monkeypatch):
    """The library sees each distinct chunk, not each text."""
    table = _table_of(public_tokenizers.path("word_bpe_49k.json"))
    seen, segment = [], table._segment
    monkeypatch.setattr(table, "_segment", lambda chunks: seen.extend(chunks) or segment(chunks))
    texts = [f"qzxv{i % 7} kjwp" * 50 for i in range(200)]
    assert len(set(counted(texts, public_tokenizers.path("word_bpe_49k.json")))) >= 1 and 0 < len(seen) < 40


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer, normalizers

    path = public_tokenizers.path("word_bpe_49k.json")
    assert has_apart_words(Tokenizer.from_file(path)) and not has_apart_words(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    other = Tokenizer.from_file(path)
    other.normalizer = normalizers.NFKC()  # turns some marks into white space
    assert not has_apart_words(other)


def test_chunks_put_together_are_told_apart_by_their_bytes(monkeypatch):
    """Chunks between white space go to the library without a special string between them, and in order of their hashes into the table."""
    from tokenizers import Tokenizer

    processor = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    table, parted = WordTable(processor, limit=500), []
    direct = table._parted
    monkeypatch.setattr(table, "_parted", lambda chunks: parted.extend(chunks) or direct(chunks))
    for lot in range(4):
        texts = chunky_texts(lot, 600)
        ids, cut = table.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)] == [x.ids for x in processor.encode_batch_fast(texts, add_special_tokens=False)]
        assert (np.diff(table.hash.astype(object)) > 0).all() and len(table.cut) == len(table.hash) + 1
    parted.clear()
    table.encode(pa.array([" some qzxv" + " words kjwpq" * 3]))
    assert not parted
