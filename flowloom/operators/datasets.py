"""Assembling data sets: discovery of complete samples, meshes with their solutions, wall surfaces, folds and what is told of a split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.operators.ranges import parts_for, running
from flowloom.operators.selection import meta_keeps, split_positions, walk_contract

LEGACY_GEOMETRY, LEGACY_CONDITION = 4, 12


# ---- samples of arrays -------------------------------------------------------------------------------------------


def triplets(arrays: DataFrame) -> DataFrame:
    """index, row, pos, fx, cond, y: arrays x_i, y_i and cond_i of one index, row by row; pos are the first three numbers of x, fx the rest.

    ``arrays`` has path, row and values, as read_npy gives them. cond is the index's one row. An index that lacks one of
    the three is left out, as is a row of x without one of y.
    """
    name = F.element_at(F.split("path", "/"), -1)
    told = arrays.select(F.regexp_extract(name, r"^(x|y|cond)_(\d+)\.npy$", 1).alias("kind"), F.regexp_extract(name, r"_(\d+)\.npy$", 1).try_cast("long").alias("index"), "row", "values")
    x, y = (told.where(F.col("kind") == k).select("index", "row", F.col("values").alias(k)) for k in "xy")
    cond = told.where("kind = 'cond'").groupBy("index").agg(F.min_by("values", "row").alias("cond"))
    both = x.join(y, ["index", "row"]).join(cond, "index")
    return both.select("index", "row", F.slice("x", 1, 3).alias("pos"), F.slice("x", 4, 2**20).alias("fx"), "cond", "y")


def padded(values: Column, width: int, fill: float = 0.0) -> Column:
    """An array cut or filled up to ``width`` numbers."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(fill), width)), 1, width)


def legacy_shape(rows: DataFrame) -> DataFrame:
    """Triplets of the older format: fx of four channels, cond of twelve numbers, whose last one, -1, tells the format."""
    return rows.withColumns({"fx": padded(F.col("fx"), LEGACY_GEOMETRY), "cond": F.concat(padded(F.slice("cond", 1, 3), LEGACY_CONDITION - 1), F.array(F.lit(-1.0)))})


def discovered(files: DataFrame, meta: DataFrame, root: str, allowed: list[str], walks: int, steps: int, min_x: int = 1000, min_pair: int = 100, levels: int | None = None, most: int | None = None) -> DataFrame:
    """sample: the folders under ``root`` that are complete samples, from a listing (path, length) and the samples' meta.

    A folder needs an x.npy of more than ``min_x`` bytes, a condition_j.npy and a supervise_j.npy of the same j of more
    than ``min_pair`` bytes each, a status that is allowed (see ``meta_keeps``) and the walks that the contract asks for.
    With ``levels``, it must lie exactly so many folders below the root (2: cohort and case); with ``most``, only the first
    so many are taken, by the folder that holds them and then by name.
    """
    name = F.element_at(F.split("path", "/"), -1)
    inside = files.where(F.startswith("path", F.lit(root.rstrip("/") + "/"))).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("sample"), name.alias("name"), "length")
    walk = lambda kind: F.collect_set(F.when(F.col("length") > min_pair, F.nullif(F.regexp_extract("name", rf"^{kind}_(.*)\.npy$", 1), F.lit(""))))
    found = inside.groupBy("sample").agg(F.max(F.when(F.col("name") == "x.npy", F.col("length"))).alias("x"), walk("condition").alias("c"), walk("supervise").alias("s"))
    whole = found.where((F.col("x") > min_x) & F.arrays_overlap("c", "s")).select("sample")
    told = whole.join(meta, "sample", "left").withColumn("readable", F.coalesce("readable", F.lit(True)))
    sound = walk_contract(meta_keeps(told, allowed).where("keep"), walks, steps).select("sample")
    if levels is not None:
        sound = sound.where(F.size(F.split(F.substring("sample", len(root.rstrip("/")) + 2, 2**30), "/")) == levels)
    return sound if most is None else sound.orderBy(F.regexp_extract("sample", "^(.*)/[^/]*$", 1), "sample").limit(most)


# ---- meshes, solutions and walls ---------------------------------------------------------------------------------


def mesh_decisions(meshes: DataFrame, solutions: DataFrame, simulation: str = "simulation", min_step: int = 0) -> DataFrame:
    """Per simulation of ``meshes``: n_points, n_rows, step and decision: no_restart, early_restart, count_mismatch or kept.

    ``meshes`` has a row for each point; ``solutions`` one for each solution row, with its step.
    """
    points = meshes.groupBy(simulation).agg(F.count("*").alias("n_points"))
    rows = solutions.groupBy(simulation).agg(F.count("*").alias("n_rows"), F.max("step").alias("step"))
    both = points.join(rows, simulation, "left").na.fill(0, ["n_rows"])
    decision = F.when(F.col("step").isNull(), "no_restart").when(F.col("step") < min_step, "early_restart").when(F.col("n_points") != F.col("n_rows"), "count_mismatch").otherwise("kept")
    return both.withColumn("decision", decision)


def mesh_solution(meshes: DataFrame, solutions: DataFrame, simulation: str, node: str, row: str, carry: list[str]) -> DataFrame:
    """Mesh points with the solution of their place: the solution's row k belongs to the point of the k-th smallest node number.

    Points are ranked in ranges of the node number, so no task holds a whole mesh, and joined by place in partitions whose number
    grows with the points, so a task's memory does not.
    """
    parts = parts_for(meshes.sparkSession, meshes.count())
    ranked = split_positions(meshes, simulation, node, carry, parts).select(F.col("split").alias(simulation), F.col("position").alias(row), F.col("index").alias(node), *carry)
    dealt = lambda df: df.repartition(parts, simulation, row)
    return dealt(ranked).join(dealt(solutions), [simulation, row])


def numbered_rows(counts: DataFrame, group: str, count: str, row: str, block: int = 1 << 16) -> DataFrame:
    """group, row: the numbers from 0 to below ``count`` of each group, made in blocks that many tasks share. Groups of no rows have none."""
    spark, n = counts.sparkSession, F.col(count).cast("long")
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    starts = counts.where(n > 0).select(group, n.alias("__n"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / block))).alias("__b"))
    dealt = starts.repartition(parts_for(spark, total), group, "__b").withColumn("__at", F.col("__b") * block)
    return dealt.select(group, F.explode(F.sequence("__at", F.least(F.col("__at") + block, "__n") - 1)).alias(row))


def with_walls(samples: DataFrame, surfaces: DataFrame, path: str, source: str, strict: bool) -> DataFrame:
    """Samples with feature_source: ``source`` where their wall surface is among ``surfaces``.

    Others are left out if ``strict``; else they stay and their wall features are to be zeros (zeros_missing_wall).
    """
    there = surfaces.select(F.col(path)).distinct().withColumn("__there", F.lit(True))
    told = samples.join(there, path, "inner" if strict else "left")
    return told.withColumn("feature_source", F.when(F.col("__there"), source).otherwise("zeros_missing_wall")).drop("__there")


# ---- splits and what is told of them -----------------------------------------------------------------------------


def fold_cases(manifest: Column) -> Column:
    """A manifest of folds (JSON text) as an array of (fold, role, position, case)."""
    parsed = F.from_json(manifest, "folds map<string, struct<train_cases: array<string>, val_cases: array<string>>>")["folds"]
    cases = lambda e, role: F.transform(F.coalesce(e["value"][f"{role}_cases"], F.array().cast("array<string>")), lambda c, i: F.struct(e["key"].alias("fold"), F.lit(role).alias("role"), i.alias("position"), c.alias("case")))
    return F.flatten(F.transform(F.map_entries(parsed), lambda e: F.concat(cases(e, "train"), cases(e, "val"))))


def reserved_cases(text: Column) -> Column:
    """The reserved ids of a JSON text; none if it has no list of them."""
    return F.coalesce(F.array_distinct(F.from_json(text, "reserved_case_ids array<string>")["reserved_case_ids"]), F.array().cast("array<string>"))


def split_info(rows: DataFrame, split: str = "split", index: str = "index") -> DataFrame:
    """list, position, index: the train, val and test lists of a data set, where an empty test list is the validation list."""
    given = rows.select(F.col(split).alias("__s"), F.col(index).alias("__i"))
    tested = not given.where("__s = 'test'").isEmpty()
    every = given if tested else given.unionByName(given.where("__s = 'val'").withColumn("__s", F.lit("test")))
    return split_positions(every, "__s", "__i").select(F.col("split").alias("list"), "position", "index")


def audited(samples: DataFrame, root: str, path: str = "path") -> DataFrame:
    """``samples``, in which one outside ``root`` fails the query."""
    inside = F.startswith(F.col(path), F.lit(root.rstrip("/") + "/"))
    return samples.withColumn(path, F.when(inside, F.col(path)).otherwise(F.raise_error(F.concat(F.lit("outside of the data folder: "), F.coalesce(F.col(path), F.lit("null"))))))


def totals(outcomes: DataFrame, outcome: str = "outcome", by: list[str] | None = None) -> DataFrame:
    """ok, failed, skipped and total of a run's outcomes."""
    count = lambda v: F.count_if(F.col(outcome) == v)
    return outcomes.groupBy(*(by or [])).agg(count("ok").alias("ok"), count("fail").alias("failed"), count("skip").alias("skipped"), F.count("*").alias("total"))


def results_json(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """key and results: the values of each row as JSON text, nulls left out."""
    return rows.select(key, F.to_json(F.struct(*values)).alias("results"))


def results_line(name: Column, label: Column, direction: Column, magnitude: Column, reduction: Column) -> Column:
    """A line of the table of results: numbers to four places, the reduction signed, to two, and ``---`` where there is none."""
    shown = F.when(reduction.isNotNull(), F.format_string("%+.2f%%", reduction)).otherwise("---")
    return F.concat_ws(" | ", F.rpad(name, 12, " "), F.rpad(label, 24, " "), F.format_string("%.4f", direction), F.format_string("%.4f", magnitude), shown)


# ---- what a training run decides ---------------------------------------------------------------------------------


def uses_physics_loss(proxy: bool, out_width: int, target_width: int, geometry_width: int) -> bool:
    """Whether the loss has its physics branch: the proxy is on, and output and target are both wider than the geometry."""
    return bool(proxy) and out_width > geometry_width and target_width > geometry_width


def has_pressure(width: int) -> bool:
    return width == 4


def channel_label(width: int) -> str:
    return {3: "u,v,w", 4: "p,u,v,w"}.get(width) or ",".join(f"c{i}" for i in range(width))


def identity_encode(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """The identity normaliser: it has a mean and a deviation like any other, and applies neither."""
    return rows


def first_of_split(rows: DataFrame, split: str, index: str, limits: dict[str, int]) -> DataFrame:
    """split, position, index: the first indices of each split that ``limits`` names; splits it doesn't name are whole."""
    at = split_positions(rows, split, index)
    most = F.create_map(*(F.lit(x) for kv in (limits or {"": 0}).items() for x in kv))[F.col("split")]
    return at.where(most.isNull() | (F.col("position") < most))


def components_by_size(parts: DataFrame, mesh: str, faces: str, component: str) -> DataFrame:
    """Components with rank: the most faces first, ties by the least component."""
    return parts.withColumn("rank", F.row_number().over(W.partitionBy(mesh).orderBy(F.desc(faces), component)))


def matching_weights(saved: DataFrame, wanted: DataFrame, skip: tuple[str, ...] = ("mlp2", "ln_3")) -> DataFrame:
    """The saved parameters (name, shape, values) that a model wants: of the same name and shape, and not of the heads in ``skip``."""
    named = saved.where(~F.coalesce(F.array_contains(F.transform(F.array(*map(F.lit, skip)), lambda s: F.contains("name", s)), True), F.lit(False)))
    return named.join(wanted.select("name", "shape"), ["name", "shape"], "left_semi")


#: The vessel configurations of the older format: name, vessel type, inlet velocity, viscosity (fixed values).
CONFIGURATIONS = [("C1", 0, 0.3, 0.0035), ("ICA_norm", 1, 0.3, 0.0035), ("ICA_ste", 2, 0.3, 0.0035)]


def configured(files: DataFrame) -> DataFrame:
    """config, split, path with their configuration's constants and index, counted through configurations, splits (train first) and paths.

    Files of other configurations are left out. All are ranked in ranges of that order, so no task holds a configuration.
    """
    known = files.sparkSession.createDataFrame([(i, *c) for i, c in enumerate(CONFIGURATIONS)], "__order int, config string, vessel_type int, inlet double, viscosity double")
    rows = files.join(F.broadcast(known), "config").withColumn("__s", F.col("__order") * 2 + F.when(F.col("split") == "train", 0).otherwise(1))
    return running(rows, [], ["__s", "path"]).select("config", "split", "path", "vessel_type", "inlet", "viscosity", F.col("position").alias("index"))
