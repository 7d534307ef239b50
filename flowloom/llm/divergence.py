"""Source divergence audit: how far the sources of a language differ in the words they use, by relational steps alone.

Terms are regular-expression matches, exploded and counted by language and source. Each language keeps the terms that enough
of its documents hold; its sources, crossed with these terms, give every term a smoothed share, zeros too. Sources
are compared by joining these shares with themselves on language and term, terms by their share in the whole language.
Shares are whole numbers (parts of a milliard), so every sum is exact whatever its order.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.llm._common import materialize

#: Runs of ASCII letters and of any characters beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE, PRIOR = 1_000_000_000, 5


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)), exact: the product is a decimal, as counts of billions would overflow a long."""
    scaled = (n.cast("decimal(20,0)") + PRIOR).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", scaled, (total.cast("decimal(20,0)") + PRIOR * terms.cast("decimal(18,0)")).cast("decimal(22,0)"))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n, docs: a term's occurrences and the documents that hold it. Nulls are empty strings; each row is a document."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), F.translate(blank(text_col), string.ascii_uppercase, string.ascii_lowercase).alias("text"))
    found = rows.select("lang", "source", F.regexp_extract_all("text", F.lit(TERM), F.lit(0)).alias("terms"))
    both = F.array(F.struct(F.col("terms"), F.lit(1).alias("n"), F.lit(0).alias("d")), F.struct(F.array_distinct("terms").alias("terms"), F.lit(0).alias("n"), F.lit(1).alias("d")))
    each = found.select("lang", "source", F.inline(both)).select("lang", "source", F.explode("terms").alias("term"), "n", "d")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("docs"))


def divergence(docs: DataFrame, min_docs: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", salts: int = 32) -> DataFrame:
    """lang, source, part, item, value, rank: for each language's source, how far it is from each other one, and its ``top`` most excessive terms.

    Part ``pair``: the other source, and the sum over the language's kept terms (in ``min_docs`` of its documents or more) of
    the difference of shares; 0 without kept terms. Part ``term``: a term of the source whose share exceeds the
    language's, and by how much. Ranks go by value downwards, then by item in the order of its bytes.

    Null texts, languages and sources count as empty strings; sources without terms are compared like others. Rows
    that repeat are each a document. An empty table gives no rows; other columns don't matter, whatever their names.
    What is joined on a language alone is salted by the term, and equal pairs are summed once for both directions.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    counts = materialize(term_counts(docs, text_col, lang_col, source_col), "divergence-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= min_docs)
    kept = materialize(kept.select("lang", "term", "n"), "divergence-kept")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    held = materialize(counts.select("lang", "source", "term", "n").join(kept.select("lang", "term"), ["lang", "term"]), "divergence-held")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source")).distinct()
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = materialize(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"), "lang_total"), "divergence-groups")

    salted = kept.select("lang", "term", F.pmod(F.xxhash64("term"), F.lit(salts)).alias("salt"))
    crossed = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))).join(salted, ["lang", "salt"]).drop("salt")
    dense = crossed.join(held, ["lang", "source", "term"], "left").select("lang", "term", "source", _share(F.coalesce("n", F.lit(0)), F.col("total"), F.col("terms")).alias("p"))
    dense = materialize(dense, "divergence-dense")
    other = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    sums = dense.join(other, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("value"))
    sums = materialize(sums, "divergence-sums")
    ways = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(ways, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    of_lang = kept.join(sizes, "lang").select("lang", "term", _share(F.col("n"), F.col("lang_total"), F.col("terms")).alias("q"))
    own = held.join(groups.select("lang", "source", "total", "terms"), ["lang", "source"]).select("lang", "source", "term", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    terms = own.join(of_lang, ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = terms.withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(best).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
