"""Quality rules whose cutoffs are risk controlled: native DataFrame expressions throughout.

Rules reject documents whose ratio of symbols, repeated lines, repeated word windows, capitals and so on is over a
cutoff. Cutoffs are chosen for each stratum from labelled documents: a cutoff is admissible if the exact binomial test
rejects, at a level shared out over all cutoffs tried in all strata, that it rejects more than its part of ``risk`` of the
good documents. Of the admissible cutoffs the lowest is taken; so with confidence 1 - ``error``, in every stratum
at once, at most ``risk`` of the good documents are rejected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm._common import materialize, small_or_whole

SPACES = r"[\x20\x09-\x0D]+"
#: The ratios that are tested, and the cutoffs tried for each.
GRID: dict[str, list[float]] = {
    "symbol_ratio": [0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3],
    "dup_line_ratio": [0.1, 0.2, 0.3, 0.4, 0.5, 0.7],
    "repeat_ratio": [0.05, 0.1, 0.15],
    "upper_ratio": [0.06, 0.1, 0.2, 0.3, 0.5],
    "mark_ratio": [0.02, 0.05, 0.1, 0.2],
    "mean_word_length": [8.0, 9.0, 10.0, 12.0, 15.0],
}


def _kept_length(text: Column, drop: str) -> Column:
    return F.length(F.regexp_replace(text, drop, "")).cast("long")


def measures(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, window: int = 5) -> DataFrame:
    """Every row's ``carry`` columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the ratios need.

    A null text is an empty one, repeated rows are each measured, and texts of any length are read whole. Windows are compared by a 64-bit hash of their words; positions are sorted, not
    compared all with all, so a text of repetitions only costs n log n.
    """
    carry = ["doc_id"] if carry is None else carry
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*carry, text.alias("__t")).withColumn("__w", F.filter(F.split("__t", SPACES, -1), lambda w: w != ""))
    lines = F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashes = F.transform(F.sequence(F.lit(0), F.size("__w") - window), lambda i: F.xxhash64(*(F.get("__w", i + j) for j in range(window))))
    counted = rows.withColumns({
        "n_words": F.size("__w").cast("long"), "word_chars": _kept_length(F.col("__t"), SPACES), "n_symbols": _kept_length(F.col("__t"), r"[^#*$%&|<>]+"),
        "n_upper": _kept_length(F.col("__t"), "[^A-Z]+"), "n_marks": _kept_length(F.col("__t"), "[^!]+"),
        "__l": lines, "__h": F.when(F.size("__w") >= window, hashes).otherwise(F.array().cast("array<bigint>")),
    }).drop("__t", "__w")
    lined = counted.withColumns({"n_lines": F.size("__l").cast("long"), "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"), "__again": F.size(F.array_distinct("__h")) < F.size("__h")}).drop("__l")
    placed = lined.withColumn("__s", F.when(F.col("__again"), F.sort_array(F.transform("__h", lambda v, i: F.struct(v.alias("v"), i.alias("i")))))).drop("__h", "__again")
    same = lambda a, b: F.coalesce(F.get("__s", a)["v"] == F.get("__s", b)["v"], F.lit(False))
    found = F.filter(F.sequence(F.lit(0), F.size("__s") - 1), lambda k: same(k, k - 1) | same(k, k + 1))
    starts = placed.withColumn("__p", F.when(F.col("__s").isNotNull(), F.sort_array(F.transform(found, lambda k: F.get("__s", k)["i"])))).drop("__s")
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("__p", zero, lambda a, p: F.struct((a["n"] + p + window - F.greatest(a["end"], p)).cast("long").alias("n"), (p + window).alias("end")), lambda a: a["n"])
    return starts.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("__p")


def ratios() -> dict[str, Column]:
    """The tested ratios, 0 where there is nothing to divide by."""
    of = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {"symbol_ratio": of("n_symbols", "word_chars"), "dup_line_ratio": of("n_dup_lines", "n_lines"), "repeat_ratio": of("n_repeat_words", "n_words"), "upper_ratio": of("n_upper", "word_chars"), "mark_ratio": of("n_marks", "word_chars"), "mean_word_length": of("word_chars", "n_words")}


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), exactly, in logarithms; 1 where k >= n * p (for such k it's no evidence)."""
    start = F.struct((n * math.log1p(-p)).alias("term"), (n * math.log1p(-p)).alias("total"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + F.lit(math.log(p) - math.log1p(-p))
        high, low = F.greatest(a["total"], term), F.least(a["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    summed = F.aggregate(F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), start, step, lambda a: F.exp(a["total"]))
    return F.when(k >= n * p, 1.0).otherwise(summed)


def admissible(labelled: DataFrame, risk: float, error: float) -> DataFrame:
    """stratum, rule, cutoff: for each stratum and rule the lowest admissible cutoff, where there is one.

    ``labelled`` has stratum, good and the ratios. Every rule of a stratum may reject an equal part of ``risk``.
    """
    tried = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), (F.col(r) > c).alias("over")) for r, cs in GRID.items() for c in cs))
    counts = labelled.where("good").select("stratum", F.explode(tried).alias("t")).groupBy("stratum", "t.rule", "t.cutoff").agg(F.count("*").alias("n"), F.count_if("t.over").alias("k"))
    tests = sum(map(len, GRID.values()))
    strata = labelled.where("good").select("stratum").distinct().count()
    level = counts.withColumn("p", binomial_tail(F.col("n"), F.col("k"), risk / len(GRID)))
    return level.where(F.col("p") <= error / max(1, strata * tests)).groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", risk: float = 0.05, error: float = 0.05, min_words: int = 10, repeat_percent: int = 20) -> DataFrame:
    """A row for each row of ``docs``: id_col, the measures, base_failed, failed (names of the rules that reject it) and kept.

    Base rules: fewer than ``min_words`` words, or more than ``repeat_percent`` percent of them in repeated windows. A
    null stratum is one of its own. Labels that contradict each other, null ones and those without a document don't
    count as good. With too few labels to prove any cutoff, only the base rules reject.
    """
    told = measures(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.col(text_col).alias("text")), "text", ["id", "stratum"]).withColumns(ratios())
    rows = materialize(told, "measures")
    good = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.min(F.coalesce(F.col(label_col), F.lit(0))) == 1).alias("good")).where("good")
    cutoffs = admissible(rows.join(good, "id"), risk, error)
    chosen, _ = small_or_whole(cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs")), "cutoffs", 10_000)
    judged = rows.join(chosen, "stratum", "left")
    failed = F.array_compact(F.array(*(F.when(F.col(r) > F.col("cutoffs")[r], F.lit(r)) for r in GRID)))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    out = judged.withColumns({"base_failed": base, "failed": failed})
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))
