"""Large .npy arrays, read by many tasks: each takes a range of a file's bytes."""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, row bigint, values array<double>"
#: Bytes of an array that a task decodes at once.
STEP_BYTES = 4 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def npy_header(start: bytes) -> tuple[np.dtype, tuple[int, ...], int]:
    """Type, shape and the place of the first value, from a file's first bytes; columns first and objects are refused."""
    if start[:6] != b"\x93NUMPY":
        raise ValueError("not a .npy file")
    wide = start[6] >= 2
    size, begin = struct.unpack("<I" if wide else "<H", start[8 : 12 if wide else 10])[0], 12 if wide else 10
    if len(start) < begin + size:
        raise ValueError("the header is longer than what was read of it")
    header = ast.literal_eval(start[begin : begin + size].decode("utf-8" if start[6] >= 3 else "latin1"))
    kind = np.dtype(header["descr"])
    if kind.hasobject or (header["fortran_order"] and len(header["shape"]) > 1):
        raise ValueError("arrays of objects and arrays stored by columns cannot be read in ranges")
    return kind, tuple(header["shape"]), begin + size


@dataclass
class Range(InputPartition):
    """Rows ``first`` to ``end`` of an array whose rows are ``width`` values from ``begin`` on."""

    path: str
    kind: str
    width: int
    begin: int
    first: int
    end: int


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, pattern: str, part_bytes: int):
        self.path, self.pattern, self.part_bytes = path, pattern, part_bytes

    def partitions(self) -> list[Range]:
        """The driver lists the files and reads a header of each; no values."""
        system, at = _opened(self.path)
        info = system.get_file_info(at)
        files = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File]
        out = []
        for f in sorted(files, key=lambda f: f.path):
            if not f.path.endswith(self.pattern):
                continue
            with system.open_input_file(f.path) as file:
                kind, shape, begin = npy_header(file.read_at(min(1 << 16, f.size), 0))
            rows, width = shape[0] if shape else 1, int(np.prod(shape[1:], dtype=np.int64))
            if f.size < begin + rows * width * kind.itemsize:
                raise ValueError(f"{f.path} is shorter than its shape says")
            each = max(1, self.part_bytes // max(1, width * kind.itemsize))
            out += [Range(f.path, kind.str, width, begin, a, min(a + each, rows)) for a in range(0, rows, each)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        kind = np.dtype(part.kind)
        row = max(1, part.width * kind.itemsize)
        step = max(1, STEP_BYTES // row)
        with system.open_input_file(part.path) as file:
            for a in range(part.first, part.end, step):
                b = min(a + step, part.end)
                flat = np.frombuffer(file.read_at((b - a) * part.width * kind.itemsize, part.begin + a * part.width * kind.itemsize), kind).astype(float)
                cut = pa.array(np.arange(b - a + 1, dtype=np.int32) * part.width)
                yield pa.record_batch([pa.array([part.path] * (b - a)), pa.array(np.arange(a, b)), pa.ListArray.from_arrays(cut, pa.array(flat))], names=["path", "row", "values"])


class ArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(self.options["path"], self.options.get("pattern", ".npy"), int(self.options.get("partbytes", self.options.get("partBytes", 64 << 20))))


def read_arrays(spark: SparkSession, path: str, pattern: str = ".npy", part_bytes: int = 64 << 20) -> DataFrame:
    """path, row, values: a row for each first index of the arrays whose names end in ``pattern``, at ``path`` or under it.

    A file of any size is read in ranges of about ``part_bytes``, each a task. Files must lie where the driver and every executor
    reach them by Arrow's file systems (shared folders, HDFS, object stores); ``files.read_npy`` takes any store that Spark reads, a file a
    task. A number alone is one row; an array without rows gives none.
    """
    spark.dataSource.register(ArraySource)
    return spark.read.format("npy_ranges").option("path", path).option("pattern", pattern).option("partBytes", str(part_bytes)).load()
