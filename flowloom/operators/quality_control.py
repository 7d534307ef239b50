"""Mesh quality control: rules, summaries, and topology counts from vertex and face tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.session import cut_lineage


@dataclass(frozen=True)
class Limits:
    min_file_size: int = 1000
    min_vertices: int = 100
    min_faces: int = 100
    min_area: float = 1e-8
    min_extent: float = 1e-8
    min_largest_fraction: float = 0.5
    max_aspect: float = 100.0


def judged(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds status (pass, warn, fail) and reasons (in rule order, joined by ``|``). A file that did not load has that reason only.

    A null measure breaks no rule.
    """
    c = F.col
    fails = {
        "tiny_file": c("file_size_bytes") < limits.min_file_size, "too_few_vertices": c("n_vertices") < limits.min_vertices, "too_few_faces": c("n_faces") < limits.min_faces, "nonfinite_vertices": ~c("finite_vertices"),
        "zero_area": c("surface_area") <= limits.min_area, "degenerate_extent": c("max_extent") <= limits.min_extent, "fragmented_components": c("largest_component_fraction") < limits.min_largest_fraction,
    }
    warns = {
        "not_watertight": ~c("is_watertight"), "open_boundary": c("boundary_edges") > 0, "nonmanifold_edges": c("nonmanifold_edges") > 0,
        "multiple_components": c("n_components") > 1, "extreme_aspect_ratio": c("aspect_ratio") > limits.max_aspect, "degenerate_faces": c("degenerate_faces") > 0,
    }
    said: list[Column] = [F.when(x, F.lit(n)) for n, x in (fails | warns).items()]
    any_of = lambda rules: F.greatest(*(F.coalesce(x, F.lit(False)) for x in rules.values()))
    status = F.when(~c("load_ok") | any_of(fails), "fail").when(any_of(warns), "warn").otherwise("pass")
    return rows.withColumns({"status": status, "reasons": F.when(~c("load_ok"), F.lit("load_error")).otherwise(F.concat_ws("|", *said))})


def by_status(rows: DataFrame) -> DataFrame:
    """A row per dataset with a column for each status."""
    return rows.groupBy("dataset").pivot("status", ["pass", "warn", "fail"]).agg(F.count(F.lit(1))).na.fill(0)


def totals(rows: DataFrame) -> DataFrame:
    """Counts by (dataset, status), by status, and in all, in one pass."""
    return rows.groupingSets([["dataset", "status"], ["status"], []], "dataset", "status").agg(F.count("*").alias("n"))


def top_reasons(rows: DataFrame, n: int = 30) -> DataFrame:
    """The ``n`` commonest reasons; ties by name."""
    each = rows.select(F.explode(F.split("reasons", r"\|")).alias("reason")).where("reason <> ''")
    return each.groupBy("reason").count().withColumnRenamed("count", "n").orderBy(F.desc("n"), "reason").limit(n)


def edges(faces: DataFrame, mesh: str = "mesh_id") -> DataFrame:
    """Undirected edges with the number of faces at each."""
    sides = F.array(*(F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))))
    return faces.select(mesh, F.explode(sides).alias("e")).groupBy(mesh, "e.p", "e.q").agg(F.count("*").alias("faces"))


def topology(faces: DataFrame, mesh: str = "mesh_id") -> DataFrame:
    """Per mesh: vertices used, faces, edges, boundary and non-manifold edges, the Euler number and whether each edge has two faces."""
    e = edges(faces, mesh).groupBy(mesh).agg(F.count("*").alias("n_edges"), F.count_if(F.col("faces") == 1).alias("boundary_edges"), F.count_if(F.col("faces") > 2).alias("nonmanifold_edges"))
    v = faces.select(mesh, F.explode(F.array("a", "b", "c")).alias("v")).groupBy(mesh).agg(F.countDistinct("v").alias("n_vertices"))
    f = faces.groupBy(mesh).agg(F.count("*").alias("n_faces"))
    out = f.join(v, mesh).join(e, mesh)
    return out.withColumns({"euler_number": F.col("n_vertices") - F.col("n_edges") + F.col("n_faces"), "is_watertight": (F.col("boundary_edges") == 0) & (F.col("nonmanifold_edges") == 0)})


def measures(triangles: DataFrame, min_face_area: float = 1e-12, mesh: str = "mesh_id") -> DataFrame:
    """Per mesh: surface area, signed volume and degenerate faces, of triangles with corners a_*, b_*, c_*."""
    from flowloom.functions.vectors import vec

    a, b, c = vec("a_"), vec("b_"), vec("c_")
    area = 0.5 * (b - a).cross(c - a).norm()
    return triangles.withColumns({"__area": area, "__volume": a.dot(b.cross(c)) / 6.0}).groupBy(mesh).agg(F.sum("__area").alias("surface_area"), F.sum("__volume").alias("volume"), F.count_if(F.col("__area") <= min_face_area).alias("degenerate_faces"))


def component_labels(faces: DataFrame, mesh: str = "mesh_id") -> DataFrame:
    """Faces with component: the least vertex of those that are connected by shared vertices.

    Labels of vertices spread along faces and are halved by pointer jumping, so rounds grow with the logarithm of a
    component's breadth. Each round is a checkpoint in the folder that spark.checkpoint.dir names, and rounds go on until
    one changes no label.
    """
    label = faces.select(mesh, F.explode(F.array("a", "b", "c")).alias("v")).distinct().withColumn("l", F.col("v"))
    while True:
        at = lambda k: label.select(mesh, F.col("v").alias(k), F.col("l").alias(f"l{k}"))  # noqa: E731,B023
        low = faces.join(at("a"), [mesh, "a"]).join(at("b"), [mesh, "b"]).join(at("c"), [mesh, "c"]).withColumn("m", F.least("la", "lb", "lc"))
        spread = low.select(mesh, F.explode(F.array("a", "b", "c", "la", "lb", "lc")).alias("v"), "m").groupBy(mesh, "v").agg(F.min("m").alias("m"))
        hop = spread.select(mesh, F.col("v").alias("m"), F.col("m").alias("m2"))
        moved = spread.join(hop, [mesh, "m"], "left").join(label, [mesh, "v"]).select(mesh, "v", F.least("m", "m2").alias("next"), "l")
        kept = cut_lineage(moved.select(mesh, "v", F.col("next").alias("l"), (F.col("next") != F.col("l")).alias("changed")))
        label = kept.select(mesh, "v", "l")
        if kept.where("changed").isEmpty():
            break
    return faces.join(label.select(mesh, F.col("v").alias("a"), F.col("l").alias("component")), [mesh, "a"]).select(*faces.columns, "component")


def components(faces: DataFrame, mesh: str = "mesh_id") -> DataFrame:
    """Per mesh: connected components by shared vertices: their number, the largest's faces and its share of all."""
    parts = component_labels(faces, mesh).groupBy(mesh, "component").agg(F.count("*").alias("faces"))
    return parts.groupBy(mesh).agg(F.count("*").alias("n_components"), F.max("faces").alias("largest_component_faces"), (F.max("faces") / F.sum("faces")).alias("largest_component_fraction"))


def largest_component(faces: DataFrame, mesh: str = "mesh_id") -> DataFrame:
    """The faces of each mesh's component of the most faces (ties: of the least vertex)."""
    named = component_labels(faces, mesh)
    sizes = named.groupBy(mesh, "component").agg(F.count("*").alias("faces"))
    best = sizes.groupBy(mesh).agg(F.min(F.struct((-F.col("faces")).alias("n"), "component"))["component"].alias("component"))
    return named.join(best, [mesh, "component"], "left_semi").select(*faces.columns)
