"""Binary and text inputs as DataFrames, through Spark's own readers, so that any store it reads will do.

Files come as one row each (``binaryFile``): a file must fit in a task. That is what array, mesh and restart files of one
sample are; tables of many samples belong in Parquet.
"""

from __future__ import annotations

import ast
import gzip
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def listing(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, name, parent, length of the files under ``path``; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path).select("path", "length")
    parts = F.split("path", "/")
    return files.select("path", F.element_at(parts, -1).alias("name"), F.element_at(parts, -2).alias("parent"), "length")


def decoded(spark: SparkSession, path: str, pattern: str, decode: Callable[[str, bytes], pd.DataFrame], schema: str) -> DataFrame:
    """The rows that ``decode`` makes of each file's path and content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")
    empty = pd.DataFrame(columns=[x.strip().split(" ")[0] for x in re.split(r",(?![^<]*>)", schema)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                out = decode(p, content)
                yield out if len(out) else empty

    return files.mapInPandas(run, schema)


def npy_array(content: bytes) -> np.ndarray:
    """A .npy file's array, without unpickling: object arrays are refused."""
    if content[:6] != b"\x93NUMPY":
        raise ValueError("not a .npy file")
    wide = content[6] >= 2
    size, start = struct.unpack("<I" if wide else "<H", content[8 : 12 if wide else 10])[0], 12 if wide else 10
    header = ast.literal_eval(content[start : start + size].decode("utf-8" if content[6] >= 3 else "latin1"))
    kind = np.dtype(header["descr"])
    if kind.hasobject:
        raise ValueError("object arrays are refused")
    array = np.frombuffer(content, kind, offset=start + size, count=int(np.prod(header["shape"], dtype=np.int64)))
    return array.reshape(header["shape"], order="F" if header["fortran_order"] else "C")


def read_npy(spark: SparkSession, path: str, pattern: str = "*.npy") -> DataFrame:
    """path, row, values: a row for each first index of each array; half precision becomes double, exactly."""

    def decode(p: str, content: bytes) -> pd.DataFrame:
        array = npy_array(content)
        flat = array.reshape(array.shape[0] if array.ndim else 1, int(np.prod(array.shape[1:], dtype=np.int64))).astype(float)
        return pd.DataFrame({"path": p, "row": np.arange(len(flat), dtype=np.int64), "values": list(flat)})

    return decoded(spark, path, pattern, decode, "path string, row long, values array<double>")


def read_restart(spark: SparkSession, path: str, pattern: str = "*.gz") -> DataFrame:
    """path, row, p, u, v, w: the first four variables of the solution block of a gzipped restart file.

    The block follows a header line ``solution : < bytes > points variables ...``, little-endian doubles, one variable
    after another. A file without one gives no rows.
    """

    def decode(p: str, content: bytes) -> pd.DataFrame:
        raw = gzip.decompress(content)
        found = re.search(rb"solution\s*:\s*<\s*\d+\s*>\s*(\d+)\s+(\d+)[^\n]*\n", raw)
        if not found or int(found[2]) < 4:
            return pd.DataFrame()
        n, variables = int(found[1]), int(found[2])
        block = np.frombuffer(raw, "<f8", count=n * variables, offset=found.end()).reshape(variables, n)
        return pd.DataFrame({"path": p, "row": np.arange(n, dtype=np.int64), **{c: block[i] for i, c in enumerate("puvw")}})

    return decoded(spark, path, pattern, decode, "path string, row long, p double, u double, v double, w double")


def read_stl(spark: SparkSession, path: str, pattern: str = "*.stl") -> DataFrame:
    """path, tri, a_*, b_*, c_*: the triangles of STL files, binary or text; a text's solids, one after another, are one mesh.

    A file is binary if its size is that of the number of triangles its header tells; else it must be a text that begins
    with ``solid``, and every three of its vertices are a triangle. Others fail.
    """
    record = np.dtype([("n", "<f4", 3), ("v", "<f4", 9), ("pad", "<u2")])
    corners = [f"{p}_{x}" for p in "abc" for x in "xyz"]

    def decode(p: str, content: bytes) -> pd.DataFrame:
        n = struct.unpack("<I", content[80:84])[0] if len(content) >= 84 else -1
        if len(content) == 84 + record.itemsize * n:
            v = np.frombuffer(content, record, count=n, offset=84)["v"].astype(float)
        elif content.lstrip()[:5].lower() == b"solid":
            found = re.findall(rb"(?im)^\s*vertex\s+(\S+)\s+(\S+)\s+(\S+)\s*$", content)
            if len(found) % 3:
                raise ValueError(f"{p}: {len(found)} vertices do not make triangles")
            v = np.array(found, dtype="S").astype(float).reshape(-1, 9) if found else np.zeros((0, 9))
        else:
            raise ValueError(f"{p}: neither a binary nor a text STL file")
        n = len(v)
        return pd.DataFrame({"path": p, "tri": np.arange(n, dtype=np.int32), **{c: v[:, i] for i, c in enumerate(corners)}})

    return decoded(spark, path, pattern, decode, "path string, tri int, " + ", ".join(f"{c} double" for c in corners))


def indexed_mesh(triangles: DataFrame, mesh: str = "mesh_id", digits: int = 8) -> tuple[DataFrame, DataFrame]:
    """Vertices (mesh, v, x, y, z) and faces (mesh, tri, a, b, c) of triangles: corners that round to the same position are one vertex."""
    at = lambda p: F.struct(*((F.round(f"{p}_{x}", digits) + F.lit(0.0)).alias(x) for x in "xyz"))
    corners = triangles.select(mesh, "tri", F.posexplode(F.array(at("a"), at("b"), at("c"))).alias("k", "p")).withColumn("v", F.xxhash64("p.x", "p.y", "p.z"))
    vertices = corners.groupBy(mesh, "v").agg(F.first("p").alias("p")).select(mesh, "v", "p.*")
    faces = corners.groupBy(mesh, "tri").agg(*(F.max(F.when(F.col("k") == i, F.col("v"))).alias(c) for i, c in enumerate("abc")))
    return vertices, faces


def read_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """file and columns of white-space separated numbers; a line with another number of fields, or with one that isn't a number, is left out."""
    fields = F.split(F.btrim("value", F.lit(" \t\r")), r"\s+")
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), fields.alias("f")).where(F.size("f") == len(columns))
    parsed = rows.select("file", *(F.get("f", F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(columns)))
    return parsed.dropna(subset=columns)


def read_manifest_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV manifest, all strings."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def read_manifest_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A manifest of one JSON object per line; lines that aren't JSON are left out."""
    full = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    with_corrupt = T.StructType([*full.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.text(path).select(F.from_json("value", with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return rows.select("r.*").where("_corrupt is null").drop("_corrupt")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A list of names, one per line: trimmed, without blank lines and repeats."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''").distinct()
