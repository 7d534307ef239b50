"""Filters, lookups and splits over manifests, metadata and file listings. Joins that keep or drop rows are semi and anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.functions.strings import path_key, stem
from flowloom.functions.draws import key_hash, uniform
from flowloom.operators.ranges import running


def first_match(files: DataFrame, manifest: DataFrame, keys: list[Column], manifest_key: str, file_id: str, take: list[str]) -> DataFrame:
    """Each file with the manifest row of the first of its ``keys`` that has one; null columns if none has."""
    each = files.select(file_id, F.posexplode(F.array(*keys)).alias("__rank", "__key"))
    hits = each.join(manifest.select(F.col(manifest_key).alias("__key"), *take), "__key")
    best = hits.groupBy(file_id).agg(F.min_by(F.struct(*take), "__rank").alias("__row"))
    return files.join(best, file_id, "left").select(*files.columns, *(F.col("__row")[t].alias(t) for t in take))


def manifest_lookup(manifest: DataFrame, order: str, relative: str, dataset: str, name: str, absolute: str) -> DataFrame:
    """key, status: a row for each of a row's three keys (relative path, dataset/name, its own absolute path); the last row of a key wins.

    Keys have forward slashes and no dots or slashes at their front (``path_key``), so files are looked up by such keys. A
    null part gives no key; a null status counts as unknown; statuses are lower-cased.
    """
    both = F.when(F.col(dataset).isNotNull() & F.col(name).isNotNull(), F.concat_ws("/", dataset, name))
    keys = F.array_compact(F.array(path_key(F.col(relative)), path_key(both), path_key(F.col(absolute))))
    each = manifest.select(F.explode(keys).alias("key"), F.lower(F.coalesce("status", F.lit("unknown"))).alias("status"), order)
    return each.groupBy("key").agg(F.max_by("status", order).alias("status"))


def stem_lookup(manifest: DataFrame, order: str, dataset: str, name: str, take: list[str]) -> DataFrame:
    """dataset, stem and ``take`` of the last manifest row of each (dataset, file name without its last extension)."""
    rows = manifest.where((F.coalesce(dataset, F.lit("")) != "") & (F.coalesce(name, F.lit("")) != ""))
    last = rows.groupBy(F.col(dataset).alias("dataset"), stem(F.col(name)).alias("stem")).agg(F.max_by(F.struct(*take), order).alias("__row"))
    return last.select("dataset", "stem", *(F.col("__row")[t].alias(t) for t in take))


def by_status(files: DataFrame, allowed: list[str], require_match: bool) -> DataFrame:
    """Adds decision: kept, skipped_status, or unmatched_qc for a null status that must match."""
    return files.withColumn("decision", F.when(F.col("status").isNull(), F.lit("unmatched_qc" if require_match else "kept")).when(F.lower("status").isin(*allowed), "kept").otherwise("skipped_status"))


def meta_keeps(meta: DataFrame, allowed: list[str]) -> DataFrame:
    """Adds keep: unreadable or failed meta drops a sample; else its status decides, an empty one too, else the manifest's, else it stays."""
    ok = lambda c: F.when(F.col(c).isNotNull(), F.lower(c).isin(*allowed))
    return meta.withColumn("keep", F.when(~F.col("readable") | ~F.coalesce("success", F.lit(True)), False).otherwise(F.coalesce(ok("meta_status"), ok("manifest_status"), F.lit(True))))


def walk_contract(meta: DataFrame, walks: int, steps: int) -> DataFrame:
    """Samples whose meta promises at least ``walks`` perturbed walks of ``steps`` steps; a value that isn't a number fails."""
    number = lambda c: F.col(c).cast("string").try_cast("double")
    return meta.where((number("n_random_walks") >= walks) & (number("perturb_sigma") > 0) & (number("walk_steps") >= steps))


def family_filter(rows: DataFrame, metadata: DataFrame, families: list[str] | None, territories: list[str] | None, key: str = "index") -> DataFrame:
    """Rows whose metadata fits both filters; None is no filter. With a filter, a row without metadata is dropped."""
    if families is None and territories is None:
        return rows
    fits = metadata
    if families is not None:
        fits = fits.where(F.split("territory", "_")[0].isin(families))
    if territories is not None:
        fits = fits.where(F.col("territory").isin(territories))
    return rows.join(fits.select(key), key, "left_semi")


def combined(common: list[str] | None, specific: list[str] | None) -> list[str] | None:
    """The intersection of two filters, where None is all."""
    if common is None or specific is None:
        return specific if common is None else common
    return sorted(set(common) & set(specific))


def vessel_types(rows: DataFrame, allowed: list[int], column: str = "vessel_type") -> DataFrame:
    """Rows whose type, rounded half to even, is allowed."""
    return rows.where(F.bround(column, 0).cast("int").isin(allowed))


def official(rows: DataFrame, limit: int = 540, column: str = "case_id") -> DataFrame:
    """Rows with a case number up to ``limit``; a missing one counts as 9999."""
    return rows.where(F.coalesce(F.col(column).try_cast("int"), F.lit(9999)) <= limit)


def longest_prefix(names: DataFrame, reserved: DataFrame, name: str = "stem", case: str = "case_id") -> DataFrame:
    """Each name with the longest reserved id that is the name or, followed by ``_``, its beginning.

    A name has few such beginnings: they are listed and joined by equality, instead of comparing each name with each id.
    """
    parts = F.split(F.col(name), "_")
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "_"))
    hits = names.select(name, F.explode(starts).alias(case)).join(reserved.select(case), case, "left_semi")
    best = hits.groupBy(name).agg(F.max_by(case, F.length(case)).alias(case))
    return names.join(best, name, "left")


def vessel_cases(files: DataFrame, reserved: DataFrame, name: str, key: str, prefix: str = "VMR_") -> DataFrame:
    """``files`` with vessel_case: for stems that begin with ``prefix``, the longest reserved id, else parts 1 to 4 if there are as many; else null."""
    inner = files.where(F.startswith(name, F.lit(prefix))).select(key, F.substring(F.col(name), len(prefix) + 1, 2**30).alias("__stem"))
    known = longest_prefix(inner.select("__stem").distinct(), reserved, "__stem", "case_id")
    found = inner.join(known, "__stem").select(key, F.col("case_id").alias("__case"))
    parts = F.split(F.col(name), "_")
    rest = F.when(F.startswith(name, F.lit(prefix)) & (F.size(parts) >= 5), F.array_join(F.slice(parts, 2, 4), "_"))
    return files.join(found, key, "left").withColumn("vessel_case", F.coalesce("__case", rest)).drop("__case")


def without_reserved(rows: DataFrame, reserved: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't reserved; a null key stays."""
    return rows.join(reserved.select(key), key, "left_anti")


def first_of_each(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def latest_restart(files: DataFrame, simulation: str, path: str) -> DataFrame:
    """Per simulation: the file of the largest step, told by ``restart.<step>.`` in its name; other names count as -1; ties: the first path."""
    step = F.coalesce(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"restart\.(\d+)\.", 1).try_cast("long"), F.lit(-1).cast("long"))
    return files.withColumn("step", step).groupBy(simulation).agg(F.min(F.struct((-F.col("step")).alias("s"), path)).alias("b")).select(simulation, f"b.{path}", (-F.col("b.s")).alias("step"))


def fallback_walk(walks: DataFrame, wanted: int, sample: str = "sample_id", walk: str = "walk_idx") -> DataFrame:
    """Per sample: walk number ``wanted``, or if it is missing the one at ``wanted`` modulo the number there are, of the same sample."""
    found = walks.groupBy(sample).agg(F.array_sort(F.collect_set(walk)).alias("a"))
    return found.select(sample, F.when(F.array_contains("a", wanted), F.lit(wanted)).otherwise(F.get("a", F.pmod(F.lit(wanted), F.size("a")))).cast("int").alias("walk_idx"), F.array_contains("a", wanted).alias("present"))


def random_walk(walks: DataFrame, epochs: int, seed: int, sample: str = "sample_id", walk: str = "walk_idx") -> DataFrame:
    """epoch, sample, walk: for each epoch, one of the sample's own walks, drawn by a hash of sample and epoch."""
    found = walks.groupBy(sample).agg(F.array_sort(F.collect_set(walk)).alias("a"))
    each = found.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(epochs - 1).cast("long"))))
    return each.select("epoch", sample, F.get("a", F.floor(F.size("a") * uniform(seed, sample, "epoch")).cast("int")).alias(walk))


def solution_stats(rows: DataFrame, key: str = "sample_id") -> DataFrame:
    """Norms, extremes and deviations of p, u, v, w per sample, in one pass. v_std is that of all velocity components together."""
    c = F.col
    squares = c("u") ** 2 + c("v") ** 2 + c("w") ** 2
    sums = rows.groupBy(key).agg(
        F.count("*").alias("n"), F.sqrt(F.sum(c("p") ** 2 + squares)).alias("y_norm"), F.sqrt(F.sum(c("p") ** 2)).alias("p_norm"), F.sqrt(F.sum(squares)).alias("v_norm"),
        F.max(F.greatest(*(F.abs(x) for x in "puvw"))).alias("max_abs"), F.stddev_pop("p").alias("p_std"), F.max(F.sqrt(squares)).alias("vmax"), F.avg(F.sqrt(squares)).alias("speed_mean"),
        *(F.avg(x).alias(f"m{x}") for x in "uvw"), *(F.var_pop(x).alias(f"s{x}") for x in "uvw"),
    )
    mean = (c("mu") + c("mv") + c("mw")) / 3
    spread = (c("su") + c("sv") + c("sw") + (c("mu") - mean) ** 2 + (c("mv") - mean) ** 2 + (c("mw") - mean) ** 2) / 3
    return sums.withColumn("v_std", F.sqrt(spread)).drop(*(f"{a}{x}" for a in "ms" for x in "uvw"))


def sound_solutions(stats: DataFrame, y_norm: float, p_norm: float, p_std: float, max_abs: float) -> DataFrame:
    return stats.where((F.col("y_norm") >= y_norm) & (F.col("p_norm") >= p_norm) & (F.col("p_std") >= p_std) & (F.col("max_abs") >= max_abs))


def extents(points: DataFrame, key: str = "sample_id") -> DataFrame:
    """Per sample: the largest extent, the smallest that is above 0, and their ratio (null without one)."""
    size = points.groupBy(key).agg(*((F.max(c) - F.min(c)).alias(f"e{c}") for c in "xyz"))
    least = F.array_min(F.filter(F.array("ex", "ey", "ez"), lambda e: e > 0))
    return size.select(key, F.coalesce(least, F.lit(0.0)).alias("min_extent"), F.greatest("ex", "ey", "ez").alias("max_extent"), (F.greatest("ex", "ey", "ez") / least).alias("aspect_ratio"))


def normalised(points: DataFrame, target: float = 5.0, key: str = "sample_id") -> DataFrame:
    """Positions scaled so that the largest extent is ``target``, and centred. A sample without extent fails the query."""
    size = points.groupBy(key).agg(F.greatest(*(F.max(c) - F.min(c) for c in "xyz")).alias("__e"), *(F.avg(c).alias(f"__m{c}") for c in "xyz"))
    scale = F.when(F.col("__e") < 1e-12, F.raise_error(F.lit("a sample has no extent"))).otherwise(F.lit(target) / F.col("__e"))
    out = points.join(size.withColumn("scale", scale), key)
    return out.withColumns({c: (F.col(c) - F.col(f"__m{c}")) * F.col("scale") for c in "xyz"}).drop("__e", "__mx", "__my", "__mz")


def normaliser(rows: DataFrame, columns: list[str], keys: list[str] | None = None, eps: float = 1e-8) -> DataFrame:
    """Mean and sample deviation + ``eps`` of columns, over all rows or per ``keys``."""
    grouped = rows.groupBy(*keys) if keys else rows.groupBy()
    return grouped.agg(*(f for c in columns for f in (F.avg(c).alias(f"{c}_mean"), (F.stddev_samp(c) + eps).alias(f"{c}_std"))))


def encode(rows: DataFrame, fitted: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Columns less their mean over their deviation. Without keys, ``fitted`` is one row, read as constants."""
    if keys:
        joined = rows.join(fitted, keys)
        return joined.withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in columns}).select(*rows.columns)
    f = fitted.first()
    return rows.withColumns({c: (F.col(c) - f[f"{c}_mean"]) / f[f"{c}_std"] for c in columns})


def decode(rows: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    f = fitted.first()
    return rows.withColumns({c: F.col(c) * f[f"{c}_std"] + f[f"{c}_mean"] for c in columns})


def group_stats(rows: DataFrame, group: str, territory: str, speed: str) -> DataFrame:
    """Per group: its commonest territory (ties: the first by name) and mean speed; missing speeds count as 0, NaN not at all."""
    n = rows.groupBy(group, territory).agg(F.count("*").alias("k"), F.sum(F.when(~F.isnan(F.coalesce(speed, F.lit(0.0))), F.coalesce(speed, F.lit(0.0)))).alias("s"), F.count_if(~F.isnan(F.coalesce(speed, F.lit(0.0)))).alias("c"))
    return n.groupBy(group).agg(F.min(F.struct((-F.col("k")).alias("k"), F.col(territory).alias("t")))["t"].alias("territory"), F.try_divide(F.sum("s"), F.sum("c")).alias("speed"), F.sum("k").alias("rows"))


def speed_bins(stats: DataFrame, bins: int, speed: str = "speed") -> DataFrame:
    """Adds bin: how many distinct quantile edges are at or below the group's speed. The edges, a handful of constants, are those of finite speeds."""
    cuts = [i / bins for i in range(1, bins)]
    finite = stats.where(~F.isnan(speed) & ~F.abs(speed).isin(float("inf")))
    edges = sorted(set(finite.agg(F.percentile(speed, F.array(*map(F.lit, cuts)))).first()[0] or [])) if cuts else []
    return stats.withColumn("bin", sum((F.when(F.col(speed) >= e, 1).otherwise(0) for e in edges), F.lit(0)))


def hash_ranked(rows: DataFrame, key: str, seed: int, sums: list[str] | None = None) -> DataFrame:
    """``rows`` with rank (from 0), total and, for each of ``sums``, ``<c>_before``, in the order of a seeded hash of the key.

    Rows are ranked within the 4,096 ranges that the hash's first digits make, which are even, and the ranges' counts are
    added up by a window over them: one plan, whose size hangs on nothing, and no task with more than its ranges.
    """
    sums = sums or []
    dealt = rows.withColumn("__h", key_hash(seed, key)).withColumn("__b", F.substring("__h", 1, 3))
    counts = dealt.groupBy("__b").agg(F.count("*").alias("__n"), *(F.sum(c).alias(f"__s_{c}") for c in sums))
    w, every = W.orderBy("__b"), W.partitionBy()  # over 4,096 rows at most
    starts = counts.select(F.col("__b").alias("__c"), (F.sum("__n").over(w) - F.col("__n")).alias("__start"), F.sum("__n").over(every).alias("total"), *((F.sum(f"__s_{c}").over(w) - F.col(f"__s_{c}")).alias(f"__start_{c}") for c in sums))
    within = W.partitionBy("__b").orderBy("__h", key)
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1)
    for c in sums:
        ranked = ranked.withColumn(f"{c}_before", F.coalesce(F.sum(c).over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    joined = ranked.join(F.broadcast(starts), F.col("__b") == F.col("__c"))
    joined = joined.withColumn("rank", (F.col("rank") + F.col("__start")).cast("long")).withColumns({f"{c}_before": F.col(f"{c}_before") + F.col(f"__start_{c}") for c in sums})
    return joined.select(*rows.columns, "rank", "total", *(f"{c}_before" for c in sums))


def hashed_folds(rows: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """Plain k folds whose sizes differ by one at most (the larger ones first), in the order of a seeded hash."""
    big, size, rank = F.col("total") % k, F.floor(F.col("total") / k), F.col("rank")
    rest = big + F.floor((rank - big * (size + 1)) / F.greatest(size, F.lit(1)))
    fold = F.when(rank < big * (size + 1), F.floor(rank / (size + 1))).otherwise(rest)
    return hash_ranked(rows, key, seed).withColumn("fold", fold.cast("int")).select(*rows.columns, "fold")


def pretrain_split(rows: DataFrame, key: str, ntrain: int, ntest: int, seed: int) -> DataFrame:
    """``rows`` of the split, in the order of a seeded hash: the first are train, the next test, a tenth at most and one at least.

    Fewer than two rows fail, as no split is then independent. What is ordered in one place are the rows of the split,
    which ``ntrain`` and ``ntest`` bound.
    """
    if min(ntrain, ntest) <= 0:
        raise ValueError("ntrain and ntest must be positive")
    n = rows.count()
    if n < 2:
        raise ValueError("two samples at least are needed for train and test")
    test = min(ntest, max(1, n // 10))
    train = min(ntrain, n - test)
    first = rows.withColumn("__h", key_hash(seed, key)).orderBy("__h", key).limit(train + test)
    ranked = first.withColumn("__r", F.row_number().over(W.orderBy("__h", key)))
    return ranked.withColumn("split", F.when(F.col("__r") <= train, "train").otherwise("test")).drop("__h", "__r")


def split_positions(rows: DataFrame, split: str | list[str], index: str, carry: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """split, position (from 0), index (a number or name) and ``carry`` of each row, in the order of the index within its split; null indices are left out.

    ``split`` may be several columns, which then keep their names. A split is ranked in ranges of the index (see ``running``), so no task holds a whole one.
    """
    names, carry = ([split] if isinstance(split, str) else split), carry or []
    told = ["split"] if isinstance(split, str) else names
    given = rows.select(*(F.col(c).alias(t) for c, t in zip(names, told, strict=True)), F.col(index).alias("index"), *carry).where(F.col("index").isNotNull())
    return running(given, told, ["index", *carry], parts=parts).select(*told, "position", "index", *carry)


def split_blocks(rows: DataFrame, split: str, index: str, block: int = 1000) -> DataFrame:
    """The indices of each split in order, as lists of ``block``: split, block (from 0) and indices, so that no row holds a whole split."""
    at = split_positions(rows, split, index).withColumn("block", F.floor(F.col("position") / block))
    return at.groupBy("split", "block").agg(F.array_sort(F.collect_list(F.struct("position", "index")))["index"].alias("indices"))


def _phases(sizes: list[int], count: int, size: int) -> list[tuple[int, list[int]]]:
    """How ``count`` groups of one size are dealt, each to the smallest fold (of equals the first): (place of the first, folds in turn), and ``sizes`` is what they are then.

    Folds whose turn comes round before any other's take turns. They go on until the next smallest one is reached, so there
    are no more phases than folds, however many groups.
    """
    out, at = [], 0
    while at < count:
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        if size == 0:
            return [*out, (at, [order[0]])]
        first = order[0]
        turn = [i for i in order if (sizes[i], i) < (sizes[first] + size, first)]
        others = order[len(turn) :]
        take = count - at
        if others:
            j = others[0]
            take = min(take, sum((sizes[j] - sizes[i]) // size + 1 if i < j else -(-(sizes[j] - sizes[i]) // size) for i in turn))
        out.append((at, turn))
        for n, i in enumerate(turn):
            sizes[i] += size * (take // len(turn) + (n < take % len(turn)))
        at += take
    return out


def greedy_group_folds(groups: DataFrame, k: int, seed: int, group: str = "group", size: str = "rows", strata: list[str] | None = None, max_runs: int = 1_000_000) -> DataFrame:
    """group, fold, ``size``: whole groups in k folds, each put to the fold that has the fewest rows (of equals the first), the largest groups first.

    Strata are dealt one after another, in their order, over the same folds; groups of one size come in the order of a seeded
    hash. Groups of one stratum and size are a run: only runs come to the driver, with their counts, and go back with the
    turns that their groups take (``_phases``). There are as many as different sizes in each stratum; more than
    ``max_runs`` are an error. A fold without a group fails the query, as its training or test part would be empty.
    """
    strata = strata or []
    given = groups.select(*strata, F.col(group).alias("__g"), F.col(size).cast("long").alias("__size"), key_hash(seed, group).alias("__h"))
    ranked = running(given, [*strata, "__size"], ["__h", "__g"])
    runs = ranked.groupBy(*strata, "__size").agg(F.count("*").alias("n"))
    order = [*(F.col(c).asc_nulls_first() for c in strata), F.col("__size").desc()]
    rows = runs.orderBy(*order).limit(max_runs + 1).collect()
    if len(rows) > max_runs:
        raise ValueError(f"more than {max_runs} sizes of groups")
    sizes, dealt, made = [0] * k, [0] * k, []
    for r in rows:
        phases = _phases(sizes, r["n"], r["__size"])
        for (at, turn), end in zip(phases, [*(p[0] for p in phases[1:]), r["n"]], strict=True):
            for n, i in enumerate(turn):
                dealt[i] += (end - at) // len(turn) + (n < (end - at) % len(turn))
        made.append((*(r[c] for c in [*strata, "__size"]), phases))
    if 0 in dealt:
        raise ValueError(f"fold {dealt.index(0)} of {k} has no group")
    kind = ", ".join([*(f"`__s{i}` {groups.schema[c].dataType.simpleString()}" for i, c in enumerate(strata)), "__n bigint", "phases array<struct<at: bigint, turn: array<int>>>"])
    turns = groups.sparkSession.createDataFrame(made, kind)
    same = F.col("__size") == F.col("__n")
    for i, c in enumerate(strata):
        same = same & F.col(c).eqNullSafe(F.col(f"__s{i}"))
    last = F.element_at(F.filter("phases", lambda p: p["at"] <= F.col("position")), -1)
    fold = F.get(last["turn"], ((F.col("position") - last["at"]) % F.size(last["turn"])).cast("int"))
    return ranked.join(turns, same).select(F.col("__g").alias(group), fold.alias("fold"), F.col("__size").cast(groups.schema[size].dataType).alias(size))


def stratified_group_folds(stats: DataFrame, bins: int, k: int, seed: int, group: str = "group", size: str = "rows", territory: str = "territory", speed: str = "speed") -> DataFrame:
    """Greedy folds within strata of territory and speed bin; without any finite speed, without strata."""
    finite = ~F.isnan(speed) & ~F.abs(speed).isin(float("inf"))
    if stats.where(F.col(speed).isNotNull() & finite).isEmpty():
        return greedy_group_folds(stats, k, seed, group, size)
    return greedy_group_folds(speed_bins(stats, bins, speed), k, seed, group, size, [territory, "bin"])


def carved_groups(groups: DataFrame, target: int, seed: int, fold: int, group: str = "group", size: str = "rows") -> DataFrame:
    """``groups`` with validation: whether a group is taken for it, in the order of a hash, until ``target`` rows are reached, leaving one group at least."""
    ranked = hash_ranked(groups, group, seed + 1009 + fold, [size])
    taken = (F.col(f"{size}_before") < target) & (F.col("rank") + 1 < F.col("total"))
    return ranked.withColumn("validation", taken).select(*groups.columns, "validation")


def fold_parts(folds: DataFrame, fold: int, validation: DataFrame, group: str = "group") -> DataFrame:
    """``folds`` with role for one fold: test, val (those that ``validation`` takes) or train. A part without a group fails the query."""
    val = validation.where("validation").select(group).withColumn("__val", F.lit(True))
    told = folds.join(val, group, "left").withColumn("role", F.when(F.col("fold") == fold, "test").when(F.col("__val"), "val").otherwise("train")).drop("__val")
    lacking = {"train", "val", "test"} - {r["role"] for r in told.select("role").distinct().collect()}
    if lacking:
        raise ValueError(f"fold {fold} has no {' and no '.join(sorted(lacking))}")
    return told


def strict_folds(folds: DataFrame, tests: DataFrame, fold: int, evaluate: str, ntrain: int | None = None, neval: int | None = None) -> DataFrame:
    """role, index of one fold: its training indices and, to evaluate on, its validation indices (``val``) or the independent tests (``test``).

    ``folds`` has fold, role (train or val), position and index; ``tests`` position and index. Limits keep the first
    positions. A fold that isn't there fails the query.
    """
    if evaluate not in ("val", "test"):
        raise ValueError("evaluate must be val or test")
    mine = folds.where(F.col("fold") == fold)
    if mine.isEmpty():
        raise ValueError(f"there is no fold {fold}")
    first = lambda df, n: df if n is None else df.where(F.col("position") < n)
    train = first(mine.where("role = 'train'"), ntrain).select(F.lit("train").alias("role"), "index")
    held = first(mine.where("role = 'val'") if evaluate == "val" else tests, neval).select(F.lit("eval").alias("role"), "index")
    return train.unionByName(held)


def early_stop(history: DataFrame, run: str, epoch: str, loss: str, min_delta: float, patience: int) -> DataFrame:
    """Per run: the best accepted loss, its epoch, and the epoch at which ``patience`` epochs had brought no improvement (null: never).

    An improvement counts only if it is more than ``min_delta`` below the last accepted one, so the epochs are folded in order.
    """
    ordered = history.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(F.col(epoch).alias("e"), F.col(loss).alias("l")))).alias("h"))
    zero = F.struct(F.lit(float("inf")).alias("best"), F.lit(None).cast("long").alias("at"), F.lit(0).alias("bad"), F.lit(None).cast("long").alias("stop"))

    def step(a: Column, x: Column) -> Column:
        better = a["stop"].isNull() & (x["l"] < a["best"] - min_delta)
        bad = F.when(a["stop"].isNotNull(), a["bad"]).when(better, 0).otherwise(a["bad"] + 1)
        return F.struct(F.when(better, x["l"]).otherwise(a["best"]).alias("best"), F.when(better, x["e"].cast("long")).otherwise(a["at"]).alias("at"), bad.alias("bad"), F.when(a["stop"].isNull() & (bad >= patience), x["e"].cast("long")).otherwise(a["stop"]).alias("stop"))

    return ordered.select(run, F.aggregate("h", zero, step).alias("r")).select(run, F.col("r.best").alias("best"), F.col("r.at").alias("best_epoch"), F.col("r.stop").alias("stop_epoch"))
