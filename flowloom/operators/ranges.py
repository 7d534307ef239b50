"""Running numbers and totals of ordered groups of any size: ranges of the order are scanned apart and put together by their ends."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from flowloom.session import scratch

#: The base of prefix fingerprints, odd and 3 modulo 4 so that powers of it stay apart modulo powers of two.
BASE = 0x9E3779B97F4A7C17


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    np.cumprod(np.full(max(0, n - 1), BASE, np.uint64), out=out[1:])
    return out


def _begins(batch: pa.RecordBatch, group: list[str]) -> np.ndarray:
    """Whether each row but the first has another group than the row before it."""
    new = np.zeros(max(0, batch.num_rows - 1), bool)
    for c in group:
        a, b = batch.column(c).slice(1), batch.column(c).slice(0, batch.num_rows - 1)
        other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new |= other.to_numpy(zero_copy_only=False)
    return new


def _numbers(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return pc.fill_null(batch.column(column), 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _scan(group: list[str], sums: list[str], powers: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of the rows of one range, in order: numbers and totals as if each group began in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, raised, pieces, rows = None, 0, np.uint64(1), 0, 0
        total, held_back = dict.fromkeys([*sums, *powers], np.uint64(0)), None  # a batch waits for the next, which tells whether it is the last
        for batch in (b for b in batches if b.num_rows):
            n = batch.num_rows
            head = tuple(batch.column(c)[0].as_py() for c in group)
            new = np.concatenate([[last is None or head != last], _begins(batch, group)])
            piece = np.cumsum(new)  # 0: goes on from the batch before
            start = np.concatenate([[0], np.flatnonzero(new)])[piece]
            inside = np.arange(n) - start
            going = piece == 0
            made = [pa.array(inside + np.where(going, count, 0), pa.int64())]
            table = _powers(n + 1)
            factor = table[inside] * np.where(going, raised, np.uint64(1))
            for c in [*sums, *powers]:
                term = _numbers(batch, c) * (factor if c in powers else np.uint64(1))
                through = np.cumsum(term)
                through = through - (through - term)[start] + np.where(going, total[c], np.uint64(0))
                made += [pa.array((through - term).view(np.int64)), pa.array(through.view(np.int64))]
                total[c] = through[-1]
            made += [pa.array(pieces + piece <= 1), pa.array(np.arange(rows, rows + n))]
            pieces, rows, last = pieces + int(piece[-1]), rows + n, tuple(batch.column(c)[n - 1].as_py() for c in group)
            held = int(inside[-1]) + 1 + (count if going[-1] else 0)
            raised = table[int(inside[-1]) + 1] * (raised if going[-1] else np.uint64(1))
            count = held
            if held_back is not None:
                yield _closed(held_back, False)
            held_back = pa.record_batch([*batch.columns, *made], names=[*batch.schema.names, *_added(sums, powers), "__first", "__row"])
        if held_back is not None:
            yield _closed(held_back, True)

    return run


def _closed(batch: pa.RecordBatch, last: bool) -> pa.RecordBatch:
    """``batch`` with __last, which the last row has if it ends its range."""
    return pa.record_batch([*batch.columns, pa.array(np.arange(batch.num_rows) == (batch.num_rows - 1 if last else -1))], names=[*batch.schema.names, "__last"])


def _added(sums: list[str], powers: list[str]) -> list[str]:
    return ["position", *(f"{c}_{x}" for c in [*sums, *powers] for x in ("before", "through"))]


def _carried(ends: list, sums: list[str], powers: list[str]) -> dict[int, list[int]]:
    """Range -> what its first group has before it: rows, and the total of each column (modulo 2**64)."""
    carry, state, of = {}, None, None
    for e in sorted(ends, key=lambda e: e["range"]):
        before = state if of is not None and of == tuple(e["head"]) else [0] * (1 + len(sums) + len(powers))
        if before[0]:
            carry[e["range"]] = before
        own = [e["tail"]["rows"], *(x % 2**64 for x in e["tail"]["totals"][1:])]
        if e["tail"]["first"]:  # one group fills the range, or what is left of it
            raised = pow(BASE, before[0], 2**64)
            own = [before[0] + own[0], *((b + o * (raised if i >= len(sums) else 1)) % 2**64 for i, (b, o) in enumerate(zip(before[1:], own[1:], strict=True)))]
        state, of = own, tuple(e["tail"]["group"])
    return carry


def _joined(carry: dict[int, list[int]], sums: list[str], powers: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            columns = dict(zip(names, batch.columns, strict=True))
            of, first = columns.pop("__range").to_numpy(), columns.pop("__first").to_numpy(zero_copy_only=False)
            del columns["__row"], columns["__last"]
            for r in np.unique(of[first]).tolist() if carry else []:
                if r not in carry:
                    continue
                mine, (n, *totals) = first & (of == r), carry[r]
                raised = np.uint64(pow(BASE, n, 2**64))
                columns["position"] = pa.array(columns["position"].to_numpy() + np.where(mine, n, 0))
                for c, t in zip([*sums, *powers], totals, strict=True):
                    for name in (f"{c}_before", f"{c}_through"):
                        old = columns[name].to_numpy().view(np.uint64)
                        columns[name] = pa.array(np.where(mine, old * (raised if c in powers else np.uint64(1)) + np.uint64(t), old).view(np.int64))
            yield pa.record_batch(list(columns.values()), names=list(columns))

    return run


#: Rows that a task of a sort or a join by place takes: some 64 MB of them in Spark's own format.
TASK_ROWS = 1 << 19


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: the session's number of them, or more where each would have over ``TASK_ROWS``.

    Given to ``repartition`` as a number, it holds: by bytes, which for sorted numbers are few, Spark would put many more rows in a task.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def running(rows: DataFrame, group: list[str], order: list[str], sums: list[str] | None = None, powers: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """``rows`` with position, from 0 within each ``group`` by ``order`` (nulls first), and running totals.

    For each whole-number column of ``sums``, ``<c>_before`` and ``<c>_through`` are its totals without and with the row (nulls
    count 0); for each of ``powers`` the same of the values times the powers of ``BASE``, modulo 2**64: numbers of a prefix
    that tell its values and their places.

    Rows are sorted in ranges of group and order and written to the shared folder, so a group of any size is many tasks'
    work. What comes to the driver are two rows a range: its first group, and its last one's totals. Groups that are
    null are groups of their own; rows that tie in ``order`` come in any order. Columns must not be called ``position``,
    ``__range``, ``__first``, ``__row`` or ``__last``.
    """
    sums, powers, spark = sums or [], powers or [], rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    ranged = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys) if keys else rows
    long = [StructField(c, LongType()) for c in _added(sums, powers)]
    ranged = ranged.withColumn("__range", F.spark_partition_id())
    kind = StructType([*ranged.schema.fields, *long, StructField("__first", BooleanType()), StructField("__row", LongType()), StructField("__last", BooleanType())])
    path = scratch(spark, "running")
    ranged.mapInArrow(_scan(group, sums, powers), kind).write.parquet(path)
    at = spark.read.schema(kind).parquet(path)
    totals = F.array(F.lit(0).cast("long"), *(f"{c}_through" for c in [*sums, *powers]))
    tail = F.struct(F.struct(F.lit(0), *group).alias("group"), (F.col("position") + 1).alias("rows"), F.col("__first").alias("first"), totals.alias("totals"))
    found = at.where("__row = 0 or __last").select(F.col("__range").alias("range"), F.col("__row").alias("row"), F.struct(F.lit(0), *group).alias("head"), F.col("__last").alias("last"), tail.alias("tail"))
    pairs = found.collect()  # the first and the last row of each range: at most 2 * ``parts``, picked while reading
    tails = {e["range"]: e["tail"] for e in pairs if e["last"]}
    ends = [{"range": e["range"], "head": e["head"], "tail": tails[e["range"]]} for e in pairs if e["row"] == 0]
    carry = _carried(ends, sums, powers)
    return at.mapInArrow(_joined(carry, sums, powers), StructType([*rows.schema.fields, *long]))
