"""Boilerplate lines by their frequency within a site: native DataFrame expressions throughout.

The pages of each host that contain a line, over all pages of the host: lines above a ratio are dropped. Only
digests of lines are shuffled, after a partial count; the lines to drop are few for each host by construction
(at most the mean number of lines of a page over the ratio), and go back to the pages as one array per host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm._common import small_or_whole

#: Boilerplate lines are broadcast if they are those of at most this many hosts and of at most this many bytes in all.
SENT_HOSTS, SENT_BYTES = 10_000, 64 << 20
_TRIM = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """Lines are the same if they differ only in white space at their ends."""
    return F.md5(F.encode(F.btrim(line, F.lit(_TRIM)), "UTF-8"))


_BLANK = "d41d8cd98f00b204e9800998ecf8427e"  # the digest of an empty line


def boilerplate(docs: DataFrame, host_col: str, text_col: str, ratio: float, min_pages: int) -> DataFrame:
    """host, lines: the digests of the lines that are on more than ``ratio`` of a host's pages, and on ``min_pages`` at least."""
    rows = docs.select(F.col(host_col).alias("host"), F.array_distinct(F.transform(_lines(F.coalesce(F.col(text_col), F.lit(""))), _key)).alias("keys"))
    pages = docs.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("pages"))
    with_line = rows.select("host", F.explode("keys").alias("key")).where(F.col("key") != _BLANK).groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = pages.select(F.col("host").alias("total_host"), "pages")
    over = with_line.join(totals, F.col("host").eqNullSafe(F.col("total_host"))).where(F.col("n") > F.col("pages") * F.lit(ratio))
    return over.groupBy("host").agg(F.array_sort(F.collect_list("key")).alias("lines"))


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.05, min_pages: int = 5, salts: int = 32) -> DataFrame:
    """``docs`` without boilerplate lines in ``text_col``, with n_lines and n_dropped added (replacing columns so named).

    Each row is a page and stays, repeated or not. Null hosts are one host; a null text is a page without lines
    and stays null. Blank lines are never dropped. A page with nothing dropped keeps its text as it is; one with
    every line dropped has an empty text.
    """
    hot, small = small_or_whole(boilerplate(docs, host_col, text_col, ratio, min_pages), "boilerplate", SENT_HOSTS, F.size("lines").cast("long") * 48 + 64, SENT_BYTES)
    hot = hot.select(F.col("host").alias("__host"), F.col("lines").alias("__lines"))
    if small:
        joined = docs.join(hot, F.col(host_col).eqNullSafe(F.col("__host")), "left")
    else:  # too many hosts or lines to send everywhere: each host's lines go to every salt, its pages are dealt over the salts
        salted = docs.withColumn("__salt", F.pmod(F.xxhash64(F.length(text_col), F.substring(text_col, 1, 64)), F.lit(salts)))
        spread = hot.withColumn("__of", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = salted.join(spread, F.col(host_col).eqNullSafe(F.col("__host")) & (F.col("__salt") == F.col("__of")), "left").drop("__salt", "__of")
    # a page's own lines are looked up in the host's by hash, once; what is compared line by line is only what it shares with them
    shared = F.array_intersect(F.transform(_lines(F.col(text_col)), _key), "__lines")
    joined = joined.withColumn("__shared", F.when(F.col("__lines").isNotNull(), shared))
    kept = F.filter(_lines(F.col(text_col)), lambda line: ~F.array_contains("__shared", _key(line)))
    marked = joined.withColumn("__kept", F.when(F.size("__shared") > 0, kept))
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(_lines(F.col(text_col)))).cast("long")
    out = marked.withColumns({"n_lines": n_lines, "n_dropped": F.when(F.col("__kept").isNull(), 0).otherwise(n_lines - F.size("__kept")).cast("long"), text_col: F.when(F.col("__kept").isNull(), F.col(text_col)).otherwise(F.array_join("__kept", "\n"))})
    return out.drop("__host", "__lines", "__shared", "__kept")
