"""Personal data: generators with high recall, boosted trees over their candidates, calibrated thresholds.

Native DataFrame expressions throughout: regular expressions propose spans, arrays hold them within the row, and the
boosted trees, fitted by Spark's own gradient boosting on the candidates of all texts, are applied as one expression. What is
shuffled are counts of candidates that are alike.

The base detectors (e-mail, ip, card, phone) report exactly the spans that their definition gives. The other generators
propose more: assigned secrets, keys of mixed characters, long numbers, loose addresses. What of those is redacted is
the trees' decision. No table labels personal data, so the trees learn from validators (check digits, ranges of lengths,
formats of keys and addresses), which see a candidate's own characters only: what stands around it is for the features
alone. So the trees carry over to text what validators vouch for; they find no kind of data that no validator knows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm._common import materialize

#: Base detectors. Possessive repeats and the look-behind (a run of characters is tried from its start only, or from the
#: end of the last match) find the same spans as the plain patterns, in time linear in the text.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further generators; their spans may overlap each other and the base spans.
MORE = {
    "secret": r"(?<=[=:]|[=:][\x20\"']|[=:]\x20[\"'])[A-Za-z0-9+/_.-]{6,}+",
    "key": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9]|A[KS]IA[A-Z0-9]{16})[A-Za-z0-9+/_-]{14,}+",
    "number": r"(?<![0-9A-Za-z])[+(]?[0-9][\x20().0-9-]{6,}[0-9]",
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]++",
}
#: A text without this has no match of that pattern: a cheap test before the costly one.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "secret": r"[=:][\x20\"']{0,2}[A-Za-z0-9+/_.-]{6}", "key": "[0-9]|A[KS]IA[A-Z]{16}", "number": "[0-9]", "address": "@"}
KINDS = [*BASE, *MORE]
KEYWORDS = r"(?i)(?:token|passw(?:or)?d|secret|key|credential|pwd|auth)[\x20_A-Za-z]*[\x20\"'=:]*$"
CALLS = r"(?i)(?:call|phone|tel|fax|mobile|contact)[\x20.:a-z]*$"
FEATURES = ["length", "digits", "letters", "upper", "others", "at", "dots", "plus", "named", "assigned", "called", "hex", "variety", *(f"is_{k}" for k in MORE)]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a sound check digit."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def is_valid(kind: str, text: Column) -> Column:
    """What a base detector asks of a match besides its pattern."""
    digits = _digits(text)
    if kind == "ip":
        short = F.transform(F.split(text, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(short, lambda p: (F.length(p) <= 3) & (p.try_cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


_SPAN = "array<struct<start:int,end:int,text:string,before:string,after:string>>"


def _running(values: Column, combine) -> Column:
    """The running ``combine`` (+ or greatest) of an array: in round k each place takes in the one 2**k before it, so n log n steps."""
    rounds = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.size(values))).cast("int"), F.lit(1)) - 1)
    none = F.array().cast("array<int>")
    join = lambda x, k: F.transform(x, lambda v, i: combine(v, F.get(x, i - F.call_function("shiftleft", F.lit(1), k))))
    return F.when(F.size(values) > 0, F.aggregate(rounds, values, join)).otherwise(none)


def _found(docs: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Adds, for each pattern, its matches with their places (code points, end exclusive) and what stands around them."""
    has = {k: F.col(text).rlike(NEEDS[k]) for k in patterns}
    none = F.array().cast("array<string>")
    cut = docs.withColumns({f"__m_{k}": F.when(has[k], F.regexp_extract_all(text, F.lit(p), 0)).otherwise(none) for k, p in patterns.items()})
    cut = cut.withColumns({f"__p_{k}": F.when(F.size(f"__m_{k}") > 0, F.split(text, p, -1)).otherwise(none) for k, p in patterns.items()})
    lengths = lambda k: F.transform(F.col(f"__m_{k}"), lambda m, i: F.length(F.get(f"__p_{k}", i)) + F.length(m))
    cut = cut.withColumns({f"__e_{k}": lengths(k) for k in patterns})
    cut = cut.withColumns({f"__e_{k}": _running(F.col(f"__e_{k}"), lambda v, before: v + F.coalesce(before, F.lit(0))) for k in patterns})

    def placed(k: str) -> Column:
        pieces, ends = F.col(f"__p_{k}"), F.col(f"__e_{k}")

        def span(m: Column, i: Column) -> Column:
            end = F.get(ends, i)
            return F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("text"), F.right(F.get(pieces, i), F.lit(24)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(8)).alias("after"))

        return F.when(F.size(f"__m_{k}") > 0, F.transform(f"__m_{k}", span)).otherwise(F.array().cast(_SPAN))

    return cut.withColumns({k: placed(k) for k in patterns}).drop(*(f"__{x}_{k}" for x in "mpe" for k in patterns))


def _features(kind: Column, span: Column) -> dict[str, Column]:
    """Format and context of a candidate. Shares are in 64ths, and counts above 64 in eighths of a doubling, so each has a few hundred values at most."""
    text, length = span["text"], F.length(span["text"]).cast("double")
    share = lambda drop: part(F.length(F.regexp_replace(text, drop, "")))
    part = lambda n: F.floor(64 * n / length) / 64
    coarse = lambda n: F.when(n <= 64, n).otherwise(16 + F.floor(8 * F.log2(n)))
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    return {
        "length": coarse(length), "digits": share("[^0-9]"), "letters": share("[^A-Za-z]"), "upper": share("[^A-Z]"), "others": share("[A-Za-z0-9]"),
        "at": flag(F.contains(text, F.lit("@"))), "dots": coarse(F.length(F.regexp_replace(text, r"[^.]", "")).cast("double")), "plus": flag(F.startswith(text, F.lit("+"))),
        "named": flag(span["before"].rlike(KEYWORDS)), "assigned": flag(span["before"].rlike(r"[=:][\x20\"']*$")), "called": flag(span["before"].rlike(CALLS)),
        "hex": flag(text.rlike("^[0-9a-f]+$|^[0-9A-F]+$")), "variety": part(F.size(F.array_distinct(F.split(text, "")))),
        **{f"is_{k}": flag(kind == k) for k in MORE},
    }


def vouched(kind: Column, span: Column) -> Column:
    """1.0 where a validator vouches for a candidate by its own characters: check digits, lengths, formats of keys and addresses."""
    text, digits = span["text"], _digits(span["text"])
    known = text.rlike("^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{30,}$|^sk[-_][A-Za-z0-9_-]{20,}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_.-]{10,}$|^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{32,}$|^(?=.*[0-9])(?=.*[A-F])[0-9A-F]{32,}$")
    mixed = (F.length(text) >= 20) & text.rlike("[0-9].*[0-9]") & text.rlike("[a-z]") & text.rlike("[A-Z]") & ~text.rlike("[./].*[./]|-.*-")
    number = (F.startswith(F.ltrim(text), F.lit("+")) & F.length(digits).between(9, 15)) | F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    yes = F.when(kind.isin("secret", "key"), known | mixed).when(kind == "number", number).otherwise(text.rlike(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\.?$"))
    return F.when(yes, 1.0).otherwise(0.0)


@dataclass(frozen=True)
class Model:
    """The boosted trees as nested (feature, threshold, left, right) with leaves, their weights, and a threshold for each kind."""

    trees: tuple
    weights: tuple[float, ...]
    thresholds: dict[str, float]

    def margin(self, x: dict[str, Column]) -> Column:
        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, threshold, left, right = node
            return F.when(x[feature] <= threshold, walk(left)).otherwise(walk(right))

        return sum((w * walk(t) for t, w in zip(self.trees, self.weights, strict=True)), F.lit(0.0))

    def probability(self, x: dict[str, Column]) -> Column:
        return 1 / (1 + F.exp(-2 * self.margin(x)))


def _tree(node):
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return FEATURES[split.featureIndex()], float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def cutoff(bins: dict[int, tuple[float, float]], precision: float) -> float | None:
    """The lowest score at which the calibrated precision is ``precision`` or more; None if it is nowhere.

    ``bins`` has, by hundredths of the score, the number of held-out candidates and of vouched ones. Neighbouring bins whose
    precision falls as the score rises are pooled until none does (isotonic regression). Between two pools nothing was
    seen, so the cutoff is half way; where every candidate holds, nothing binds and it is a half at most.
    """
    pools: list[list[float]] = []  # lowest bin, highest bin, candidates, vouched
    for at in sorted(bins):
        pools.append([at, at, *bins[at]])
        while len(pools) > 1 and pools[-1][3] * pools[-2][2] <= pools[-2][3] * pools[-1][2]:
            low, high = pools[-2:]
            pools[-2:] = [[low[0], high[1], low[2] + high[2], low[3] + high[3]]]
    holds = [i for i, p in enumerate(pools) if p[3] >= precision * p[2]]
    if not holds:
        return None
    first = holds[0]
    return min(pools[0][0], 50) / 100 if first == 0 else (pools[first][0] + pools[first - 1][1] + 1) / 200


def _bounded(given: DataFrame, most_docs: int, most_chars: int) -> DataFrame:
    """The ``most_docs`` rows of the lowest hashes of their ids, up to the one with which they would hold more than ``most_chars`` characters; the first is always there."""
    from pyspark.sql import Window as W

    order = ["draw", "id", "print"]
    known = given.where(F.col("id").isNotNull() & F.col("text").isNotNull()).withColumn("print", F.xxhash64("text"))
    chosen = materialize(known.select("id", "print", F.length("text").alias("chars"), F.xxhash64("id", F.lit(17)).alias("draw")).orderBy(*order).limit(most_docs), "pii-chosen")
    running = F.sum("chars").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))  # over most_docs rows at most
    within = chosen.withColumn("total", running).where((F.col("total") <= most_chars) | (F.col("total") == F.col("chars"))).select("id", "print").distinct()
    return known.join(F.broadcast(within), ["id", "print"], "left_semi").dropDuplicates(["id", "print"]).select("id", "text")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What the trees learn from: kind, held, label, the features, and weight, the number of candidates of all texts that are alike in these.

    A candidate is held out (a fifth are) by a hash of its document's id and its start. Features are whole numbers and shares in
    64ths, so the rows are far fewer than the candidates, and no candidate is left out.
    """
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    named_as = lambda k: F.transform(F.col(k), lambda s: F.struct(F.lit(k).alias("kind"), s.alias("span")))
    every = F.flatten(F.array(*map(named_as, MORE)))
    each = _found(given, "text", MORE).select("id", F.explode(every).alias("c")).select("id", "c.kind", "c.span")
    held = (F.pmod(F.xxhash64("id", "span.start"), F.lit(1_000_003)) % 5 == 0).alias("held")
    named = each.select("kind", held, vouched(F.col("kind"), F.col("span")).alias("label"), *(v.cast("double").alias(k) for k, v in _features(F.col("kind"), F.col("span")).items()))
    return named.groupBy("kind", "held", "label", *FEATURES).agg(F.count("*").cast("double").alias("weight"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int | None = None, sample_chars: int | None = None, trees: int = 16, depth: int = 4, precision: float = 0.95) -> Model | None:
    """Trees and thresholds from every candidate of every text.

    Four fifths of the candidates fit the trees, and on the rest each kind's scores are calibrated: see ``cutoff``. Candidates that
    are alike are one row with a weight, and every value of a feature may be a split, as there are bins enough for Spark ML to draw
    no rows in looking for splits. A kind without any score that holds is never redacted. Null texts have no
    candidates. None where those to be fitted are of one sort only, for example none.

    For a trial, ``sample_docs`` or ``sample_chars`` look at some documents only; the query gives neither.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if sample_docs is not None or sample_chars is not None:
        given = _bounded(given, 6_000 if sample_docs is None else sample_docs, 50_000_000 if sample_chars is None else sample_chars)
    learnt = materialize(candidates(given, "id"), "pii-candidates")
    rows, *sorts = learnt.agg(F.count_if(~F.col("held")), *(F.count_if(~F.col("held") & (F.col("label") == x)) for x in (0.0, 1.0))).first()
    if not all(sorts):
        return None
    train = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(learnt.where(~F.col("held"))).select("label", "weight", "x")
    bins = max(512, math.isqrt(rows) + 1)  # Spark ML draws rows beyond the square of this; a feature has under 512 values
    boosted = GBTClassifier(labelCol="label", featuresCol="x", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, maxBins=bins, checkpointInterval=-1, maxMemoryInMB=64).fit(train)
    model = Model(tuple(_tree(t._call_java("rootNode")) for t in boosted.trees), tuple(boosted.treeWeights), {})
    scored = learnt.where("held").select("kind", "label", "weight", F.floor(100 * model.probability({f: F.col(f) for f in FEATURES})).alias("bin"))
    seen: dict[str, dict[int, tuple[float, float]]] = {}
    for r in scored.groupBy("kind", "bin").agg(F.sum("weight").alias("n"), F.sum(F.col("label") * F.col("weight")).alias("good")).collect():  # at most 404 rows
        seen.setdefault(r["kind"], {})[int(r["bin"])] = (r["n"], r["good"])
    return Model(model.trees, model.weights, {k: c for k in MORE if k in seen and (c := cutoff(seen[k], precision)) is not None})


def find(docs: DataFrame, model: Model | None, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Every row's ``carry`` columns with base and spans: arrays of (kind, start, end, score), by kind as listed, then start.

    ``base`` has what the base detectors find. ``spans`` has those and the candidates of the other generators that the
    model gives their kind's threshold, but for those that a base span or a longer such candidate holds. A null text
    is an empty one. Rows that repeat are each searched.
    """
    carry = ["doc_id"] if carry is None else carry
    rows = docs.select(*(F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    found = _found(rows, "__text", BASE | (MORE if model is not None and model.thresholds else {})).drop("__text")
    plain = lambda kind, s, score: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))
    sound = lambda k: F.transform(F.filter(F.col(k), lambda s: is_valid(k, s["text"])), lambda s: plain(k, s, F.lit(1.0)))
    out = found.withColumn("base", F.flatten(F.array(*map(sound, BASE))))
    if model is None or not model.thresholds:
        return out.select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)), "base", F.col("base").alias("spans"))
    seen = lambda k: F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), *(v.cast("double").alias(f) for f, v in _features(F.lit(k), s).items())))
    rated = lambda k: F.filter(F.transform(seen(k), lambda s: plain(k, s, model.probability({f: s[f] for f in FEATURES}))), lambda s: s["score"] >= model.thresholds[k])
    out = out.withColumn("__more", F.flatten(F.array(*(rated(k) for k in MORE if k in model.thresholds))))
    out = _uncovered(out)
    return out.select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)), "base", F.concat("base", "__new").alias("spans"))


def _uncovered(found: DataFrame) -> DataFrame:
    """Adds __new: those of __more, by kind as listed, then start, that no span of base and no larger one of __more holds.

    Larger is longer, or as long and later named. Sorted by start, the longest first, a span is held by another if and
    only if one before it ends no earlier; so a running maximum of ends tells.
    """
    place = lambda names, s: F.array_position(F.array(*map(F.lit, names)), s["kind"]).cast("int")
    entry = lambda s, rank, at: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), rank.alias("rank"), at.alias("at"), s["kind"].alias("kind"), s["score"].alias("score"))
    known = F.transform("base", lambda s: entry(s, F.lit(0), F.lit(0)))
    new = F.transform("__more", lambda s: entry(s, place(sorted(MORE, reverse=True), s), place(list(MORE), s)))
    ordered = found.withColumn("__all", F.when(F.size("__more") > 0, F.array_sort(F.concat(known, new))).otherwise(F.slice(new, 1, 0)))
    far = ordered.withColumn("__far", F.transform("__all", lambda s: -s["back"])).withColumn("__far", _running(F.col("__far"), F.greatest))
    before = F.concat(F.array(F.lit(-1)), F.col("__far"))  # one more than there are spans: zipped with a null, which no test lets through
    free = F.filter(F.zip_with("__all", before, lambda s, f: F.struct(s.alias("s"), f.alias("f"))), lambda b: (b["s"]["at"] > 0) & (b["f"] < -b["s"]["back"]))
    by_kind = F.array_sort(F.transform(free, lambda b: F.struct(b["s"]["at"].alias("at"), b["s"]["start"].alias("start"), (-b["s"]["back"]).alias("end"), b["s"]["kind"].alias("kind"), b["s"]["score"].alias("score"))))
    return far.withColumn("__new", F.transform(by_kind, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))).drop("__all", "__far")


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span, merged where they overlap, replaced by the first one's kind in brackets; null for a null text."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        fresh = s["start"] >= a["at"]
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], gap, F.when(fresh, F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise("")).alias("out"))

    return F.aggregate(ordered, zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
