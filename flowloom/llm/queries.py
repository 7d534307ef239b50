"""The registered queries of this subpackage, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import pii
from flowloom.llm.conversation_trie import conversation_trie
from flowloom.llm.decontamination import contaminated_by, is_clean
from flowloom.llm.divergence import PRIOR, SCALE, TERM, divergence
from flowloom.llm.line_dedup import drop_boilerplate
from flowloom.llm.near_duplicates import near_duplicates
from flowloom.llm.pieces import encode_decode
from flowloom.llm.quality import GRID, judge
from flowloom.llm.token_counts import token_counts
from flowloom.llm.token_files import token_round_trip
from flowloom.llm.toxicity import fit, score
from flowloom.llm.url_filter import UrlRule, judge_urls
from flowloom.llm.warc import round_trip

URL_RULES = [
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
    UrlRule("block", "*spam-farm*", subdomains=False, named=False),
    UrlRule("block", "*cheap-pills*", subdomains=False, named=False),
    UrlRule("block", "*casino*", subdomains=False, named=False),
    UrlRule("block", "*free-bet?.*", subdomains=False, named=False),
    UrlRule("block", "*adult-?.*", subdomains=False, named=False),
    UrlRule("block", "*ads-t*k.*", subdomains=False, named=False),
    UrlRule("block", "*", "*/wp-*.php", subdomains=False, named=False),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) = any_value(x.n) AND count(*) = any_value(y.n) AS same FROM s a JOIN s b USING (sh) JOIN c x ON x.doc_id = a.doc_id JOIN c y ON y.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 10 * count(*) >= 8 * (any_value(x.n) + any_value(y.n) - count(*))),
r AS (SELECT a AS node, a AS root FROM p UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.node),
k AS (SELECT node, min(root) AS root FROM r GROUP BY node),
l AS (SELECT a, count(*) AS links, min(b) FILTER (same) AS twin FROM p GROUP BY a)
SELECT d.doc_id, least(d.doc_id, coalesce(l.twin, d.doc_id)) AS representative, coalesce(k.root, d.doc_id) AS class_id, coalesce(l.links, 0) AS n_links, coalesce(c.n, 0) AS n_shingles
FROM documents d LEFT JOIN l ON l.a = d.doc_id LEFT JOIN k ON k.node = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in pii.BASE), F.sha2(pii.as_text(F.col("base")), 256).alias("base_sha256"), pii.as_text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


OP5_SQL = """
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, CASE
    WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule,
  CASE WHEN contains(host, 'cheap-pills') THEN '*cheap-pills*' WHEN regexp_matches(host, '(?s)free-bet.[.]') THEN '*free-bet?.*' WHEN contains(host, 'spam-farm') THEN '*spam-farm*' WHEN regexp_matches(path, '(?s)/wp-.*[.]php') THEN '**/wp-*.php'
    WHEN regexp_matches(host, '(?s)adult-.[.]') THEN '*adult-?.*' WHEN regexp_matches(host, '(?s)ads-t.*k[.]') THEN '*ads-t*k.*' WHEN contains(host, 'casino') THEN '*casino*' END AS hit FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL OR hit IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NULL THEN hit END AS glob FROM r
"""


#: Labels may be learnt from only where this remainder isn't 0. A null id has no labels and counts as not held out.
HELD_OUT = "coalesce(crc32(cast(doc_id as string)) % 5 = 0, false)"


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), where=~F.expr(HELD_OUT))
    scored = score(docs, model).withColumns({"held_out": F.expr(HELD_OUT), "predicted": F.when(F.col("score") >= 0.5, 1).otherwise(0)})
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_spans"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS key FROM l),
h AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
b AS (SELECT t.source, t.key FROM t JOIN h USING (source) WHERE t.key <> '' GROUP BY t.source, t.key, h.pages HAVING count(DISTINCT t.doc_id) >= 5 AND count(DISTINCT t.doc_id) > h.pages * 0.05),
k AS (SELECT t.doc_id, count(*) AS n_lines, count(b.key) AS n_dropped, coalesce(string_agg(t.line, chr(10) ORDER BY t.i) FILTER (b.key IS NULL), '') AS kept FROM t LEFT JOIN b USING (source, key) GROUP BY t.doc_id)
SELECT doc_id, n_lines, n_dropped, length(kept) AS kept_chars, sha256(kept) AS kept_sha256 FROM k
"""


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.withColumn("failed", F.array_join("failed", ","))


OP8_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM x) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT t.doc_id, stratum, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^!]', '', 'g')) AS n_marks, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM t LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)),
f AS (SELECT *, [CASE WHEN word_chars = 0 THEN 0 ELSE n_symbols / word_chars END, CASE WHEN n_lines = 0 THEN 0 ELSE n_dup_lines / n_lines END, CASE WHEN n_words = 0 THEN 0 ELSE n_repeat_words / n_words END,
  CASE WHEN word_chars = 0 THEN 0 ELSE n_upper / word_chars END, CASE WHEN word_chars = 0 THEN 0 ELSE n_marks / word_chars END, CASE WHEN n_words = 0 THEN 0 ELSE word_chars / n_words END] AS ratio FROM m),
g AS (SELECT * FROM (VALUES GRID_ROWS) AS g(pos, rule, cutoff)),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(coalesce(quality, 0)) = 1),
k AS (SELECT stratum, pos, rule, cutoff, count(*) AS n, count(*) FILTER (ratio[pos] > cutoff) AS k FROM f JOIN good USING (doc_id), g GROUP BY ALL),
p AS (SELECT *, CASE WHEN k >= n * 0.05 / 6 THEN 1 ELSE list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.05 / 6) + (n - i) * ln(1 - 0.05 / 6)))) END AS tail FROM k),
a AS (SELECT stratum, pos, rule, min(cutoff) AS cutoff FROM p WHERE tail <= 0.05 / ((SELECT count(DISTINCT stratum) FROM k) * (SELECT count(*) FROM g)) GROUP BY ALL),
j AS (SELECT f.doc_id, string_agg(a.rule, ',' ORDER BY a.pos) AS failed FROM f JOIN a ON a.stratum = f.stratum AND f.ratio[a.pos] > a.cutoff GROUP BY f.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, coalesce(failed, '') AS failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND failed IS NULL AS kept FROM f LEFT JOIN j USING (doc_id)
""".replace("GRID_ROWS", ", ".join(f"({i}, '{rule}', {c}::DOUBLE)" for i, (rule, cutoffs) in enumerate(GRID.items(), 1) for c in cutoffs))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first FROM p),
b AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(hex, 5 * i + 1, 5))::BIGINT) AS parts FROM d)
SELECT page_id, payload_bytes, list_aggregate(list_transform(parts, lambda v: list_aggregate(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31)::INT + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to FROM b
"""

def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_by(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.withColumn("contaminated", ~is_clean(F.col("items")))



def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations share the head of the first of their hundred, of zero to five turns."""
    return conversation_trie(table(spark, sf_dir, "conversations"), F.expr("conv - conv % 100"), F.expr("crc32(cast(conv as string)) % 6"), most=5)


OP11_SQL = """
WITH RECURSIVE t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS at FROM conversations WHERE conv_id IS NOT NULL),
bits(n) AS (SELECT 0 UNION ALL SELECT n + 1 FROM bits WHERE n < 255), poly(n, v, k) AS (SELECT n, n::BIGINT, 0 FROM bits UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM poly WHERE k < 8),
crc AS (SELECT list(v ORDER BY n) AS c FROM poly WHERE k = 8),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
  lambda a, b: xor(crc.c[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t), crc),
a AS (SELECT c.conv_id, 0 AS part, t.at, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.at < c.h UNION ALL SELECT c.conv_id, 1, t.at, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.at >= c.h),
r AS (SELECT c.conv_id, list((a.role, a.text) ORDER BY a.part, a.at) FILTER (a.at IS NOT NULL) AS turns FROM c LEFT JOIN a USING (conv_id) GROUP BY c.conv_id),
p AS (SELECT conv_id, d AS depth, len(coalesce(turns, [])) AS n, turns[1:d] AS prefix, CASE WHEN d > 0 THEN turns[1:d - 1] END AS upper, CASE WHEN d > 0 THEN length(turns[d][2]) ELSE 0 END AS chars
  FROM (SELECT *, unnest(range(len(coalesce(turns, [])) + 1)) AS d FROM (SELECT conv_id, coalesce(turns, []) AS turns FROM r))),
n AS (SELECT depth, prefix, any_value(upper) AS upper, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends FROM p GROUP BY depth, prefix),
k AS (SELECT depth - 1 AS depth, upper AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, prefix)),
s AS (SELECT d AS depth, prefix[1:d] AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved FROM (SELECT *, unnest(range(depth + 1)) AS d FROM f) GROUP BY ALL)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN s USING (depth, prefix) LEFT JOIN n u ON u.depth = f.depth - 1 AND u.prefix = f.upper
"""


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'TERM') AS t FROM documents),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(t) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(t)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
z AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (SCALE::HUGEINT * (n + PRIOR)) // (sum(n) OVER (PARTITION BY lang, source) + PRIOR * v) AS p FROM z JOIN v USING (lang)),
l AS (SELECT lang, term, 1 + (SCALE::HUGEINT * (n + PRIOR)) // (sum(n) OVER (PARTITION BY lang) + PRIOR * v) AS q FROM (SELECT lang, term, sum(n) AS n FROM z GROUP BY ALL) JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM r QUALIFY part = 'pair' OR rank <= 50
""".replace("TERM", TERM).replace("SCALE", str(SCALE)).replace("PRIOR", str(PRIOR))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_pieces, op3_near_duplicates, op4_pii, op5_url_filter, op6_toxicity, op7_line_dedup, op8_quality, op9_warc, op10_decontamination, op11_conversation_trie, op12_divergence, op13_token_files)}
ORACLES = {"op3_near_duplicates": OP3_SQL, "op5_url_filter": OP5_SQL, "op7_line_dedup": OP7_SQL, "op8_quality": OP8_SQL, "op9_warc": OP9_SQL, "op11_conversation_trie": OP11_SQL, "op12_divergence": OP12_SQL}
