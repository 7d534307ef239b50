"""WARC archives, written and read with Spark's own text source, and verified by their chain of boundaries.

Writing: a record's header and payload are one text, the blank line after a record is the line separator. Reading:
the record magic is the line separator, so splits of a file are cut at every magic by separate tasks. Each cut
is a candidate with its own offset and, by its Content-Length, its successor's. A magic inside a payload makes
candidates too: pointer jumping from the start of each file finds those that a chain of records reaches; the others
are given back to the payload that holds them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowloom.llm._common import delete, materialize, scratch_path, small_or_whole

MAGIC = "WARC/1.1\r\n"
CRLF = "\r\n"
#: Digests are told apart by so many slots where those that repeat are too many to send everywhere: 16 bytes a slot.
SLOTS = 1 << 20
_BASE32, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of bytes in upper-case base 32: each 5 hexadecimal digits are 4 of base 32."""
    text = F.concat(*(F.lpad(F.conv(F.substring(F.sha1(payload), 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)))
    return F.translate(text, _DIGITS, _BASE32)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", records_per_file: int = 20_000) -> None:
    """A record per row. Of equal payloads of ``min_revisit_bytes`` or more, that of the smallest id is response, others revisit.

    A null payload is an empty one. Rows that repeat the smallest id are responses too; a null id is larger than
    any other and, like a null URL, has no header line. Line breaks in a URL are written as %0D and %0A. Payloads of any
    length are written whole; other columns of ``pages`` are ignored, whatever their names.
    """
    text = F.coalesce(F.col(payload_col), F.lit("")).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text.alias("payload")).withColumns({"digest": base32_sha1(F.encode("payload", "UTF-8")), "size": F.octet_length("payload")})
    first, small = small_or_whole(rows.where(F.col("size") >= min_revisit_bytes).groupBy("digest", "size").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-first")
    if small:
        told = rows.join(first, ["digest", "size"], "left")
    else:  # only payloads whose slot holds a repeated digest are shuffled; the slots are few enough to send, however many digests there are
        slot = F.pmod(F.xxhash64("digest"), F.lit(SLOTS))
        slots = F.broadcast(materialize(first.select(slot.alias("slot")).distinct(), "warc-slots"))
        slotted = rows.withColumn("slot", slot)
        alone = slotted.join(slots, "slot", "left_anti").withColumn("first", F.lit(None).cast(rows.schema["id"].dataType))
        told = slotted.join(slots, "slot", "left_semi").join(first, ["digest", "size"], "left").drop("slot").unionByName(alone.drop("slot"))
    revisit = F.coalesce(F.col("first") < F.col("id"), F.col("first").isNotNull() & F.col("id").isNull())
    head = lambda name, value, when=F.lit(True): F.when(when & value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))).otherwise("")
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC), head("WARC-Type", F.when(revisit, "revisit").otherwise("response")), head("WARC-Record-ID", urn(F.col("id"))), head("WARC-Date", F.lit(date)),
        head("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))), head("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), head("WARC-Payload-Length", F.col("size")),
        head("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), revisit), head("WARC-Refers-To", urn(F.col("first")), revisit),
        head("Content-Type", F.lit("text/html; charset=utf-8")), head("Content-Length", F.when(revisit, 0).otherwise(F.col("size"))), F.lit(CRLF), F.when(revisit, "").otherwise(F.col("payload")),
    )
    told.select(record.alias("value")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", records_per_file).text(path)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds local: the bytes of a split's pieces and magics before each piece. Rows come in the order of the file."""
    last, total = (None, None), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block, size = (batch.column(c).to_numpy() for c in ("file", "block", "size"))
        ends = np.cumsum(size + len(MAGIC))
        new = np.ones(len(file), bool)
        new[1:] = (file[1:] != file[:-1]) | (block[1:] != block[:-1])
        new[0] = (file[0], block[0]) != last
        before = np.append(0, ends[:-1])
        base = np.where(new, before, -total)
        base = base[np.maximum.accumulate(np.where(new, np.arange(len(file)), 0))]
        last, total = (file[-1], block[-1]), int(ends[-1] - base[-1])
        yield pa.record_batch([*batch.columns, pa.array(before - base)], names=[*batch.schema.names, "local"])


def _pieces(spark: SparkSession, path: str, body: bool) -> DataFrame:
    """What stands between the magics: file, block, size, head and length (null where no record header begins it), local; header and body if ``body``."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    head = F.substring_index("value", CRLF * 2, 1)
    length = F.regexp_extract("header", r"(?i)(?:^|\r\n)Content-Length: *([0-9]{1,15})", 1).try_cast("long")
    rows = text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.octet_length("value").cast("long").alias("size"), head.alias("header"), F.col("value").cast("binary").alias("body"))
    rows = rows.withColumns({"head": F.octet_length("header").cast("long"), "length": F.when(F.octet_length("header") < F.col("size"), length)})
    numbers = ["file", "block", "size", "head", "length"]
    schema = "file long, block long, size long, head long, length long"
    if not body:
        return rows.select(*numbers).mapInArrow(_placed, schema + ", local long")
    rest = F.when(F.col("length").isNotNull(), F.substr("body", (F.col("head") + 5).cast("int"))).otherwise(F.col("body"))
    return rows.select(*numbers, F.when(F.col("length").isNotNull(), F.col("header")).alias("header"), rest.alias("body")).mapInArrow(_placed, schema + ", header string, body binary, local long")


def reachable(links: DataFrame) -> DataFrame:
    """The (file, offset) that the chain of offset -> successor reaches from offset 0, by pointer jumping.

    After k doublings the reached set holds the first 2**k records of every file; two doublings to a round.
    """
    spark = links.sparkSession
    most = links.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    jump = links.select("file", "offset", "successor")
    reach = links.where("offset = 0").select("file", "offset")
    paths: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        paths.append(scratch_path(spark, name))
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    twice = lambda j: j.join(j.select("file", F.col("offset").alias("successor"), F.col("successor").alias("far")), ["file", "successor"]).select("file", "offset", F.col("far").alias("successor"))
    further = lambda r, j: r.unionByName(r.join(j, ["file", "offset"]).select("file", F.col("successor").alias("offset")))
    done = 1
    while done < most:
        second = twice(jump)
        reach = kept(further(further(reach, jump), second), "warc-reach")
        if (done := done * 4) < most:
            jump = kept(twice(second), "warc-jump")
    out = materialize(reach.join(links.select("file", "offset"), ["file", "offset"], "left_semi"), "warc-records")
    for path in paths:
        delete(spark, path)
    return out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under ``path``: file, offset, successor, header (text), payload (bytes).

    Only records on the chain from the start of their file are given. An empty archive gives no rows; a record that
    is cut off at the end of its file gives what there is of its payload. The first pass keeps numbers only. The
    second reads payloads, and leaves out the pieces that the chain rejects: no payload is shuffled but those that
    hold a magic.
    """
    at = ["file", "block", "local"]
    found = materialize(_pieces(spark, path, body=False), "warc-pieces")
    blocks = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    base, _ = small_or_whole(blocks.select("file", "block", (F.sum("bytes").over(W.partitionBy("file").orderBy("block")) - F.col("bytes")).alias("base")), "warc-blocks")
    offset = lambda df: df.join(base, ["file", "block"]).withColumn("offset", F.col("base") + F.col("local") - len(MAGIC)).drop("base").where("offset >= 0").withColumn("successor", F.col("offset") + len(MAGIC) + F.col("head") + 8 + F.col("length"))
    pieces = offset(found)
    reach = reachable(pieces.where("length is not null").select("file", "offset", "successor"))
    gone = materialize(pieces.join(reach, ["file", "offset"], "left_anti").select(*at, "offset"), "warc-rejected-pieces")
    rejected, _ = small_or_whole(gone.select(*at), "warc-rejected")
    every = offset(_pieces(spark, path, body=True))
    out = ["file", "offset", "successor", "header"]
    if gone.isEmpty():
        return every.select(*out, F.substring("body", F.lit(1), F.col("length").cast("int")).alias("payload"))
    records = every.join(rejected, at, "left_anti")
    whole = F.octet_length("body") >= F.col("length")
    text = F.concat(F.encode(F.concat(F.lit(MAGIC), F.when(F.col("length").isNotNull(), F.concat("header", F.lit(CRLF * 2))).otherwise("")), "UTF-8"), "body")
    lost = every.join(rejected, at, "left_semi").select("file", F.col("offset").alias("at"), text.alias("text"))
    open_ = records.where(~whole)
    # the record that a rejected piece is in is the last one that begins before it, found on numbers only
    begins = reach.select("file", "offset", F.col("offset").alias("record")).unionByName(gone.select("file", "offset", F.lit(None).cast("long").alias("record")))
    owner = F.last("record", ignorenulls=True).over(W.partitionBy("file").orderBy("offset"))
    owned = begins.withColumn("owner", owner).where("record is null and owner is not null").select("file", F.col("offset").alias("at"), F.col("owner").alias("offset"))
    inside = lost.join(owned, ["file", "at"]).join(open_.select("file", "offset", "successor"), ["file", "offset"]).where("at < successor")
    inside = inside.groupBy("file", "offset").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("parts"))
    rest = F.aggregate("parts", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["text"]))
    filled = open_.join(inside.select("file", "offset", rest.alias("rest")), ["file", "offset"], "left").withColumn("body", F.concat("body", F.coalesce("rest", F.lit("").cast("binary"))))
    return records.where(whole).unionByName(filled.drop("rest")).select(*out, F.substring("body", F.lit(1), F.col("length").cast("int")).alias("payload"))


def header(name: str) -> Column:
    """The value of a record's header line; null if there is none."""
    return F.nullif(F.regexp_extract("header", rf"(?i)(?:^|\r\n){name}: *([^\r\n]*)", 1), F.lit(""))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """``pages`` written to archives in the shared folder and read back: ``id_col``, uri, record_type, refers_to, payload_bytes, payload_digest, payload.

    A response whose payload has another digest than its header says fails the query. A revisit has no payload of
    its own: its size and digest are those of its header.
    """
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType
    path = scratch_path(spark, "warc")
    write_warc(pages, path, id_col, url_col, payload_col, min_revisit_bytes)
    rows = read_warc(spark, path).withColumns({"told": F.substring(header("WARC-Payload-Digest"), 6, 40), "record_type": header("WARC-Type"), "payload_bytes": header("WARC-Payload-Length").cast("long")})
    id_of = lambda name: F.regexp_extract(F.coalesce(header(name), F.lit("")), "^<urn:page:(.*)>$", 1)
    to_id = lambda name: F.when(header(name).isNotNull(), id_of(name)).cast(kind)
    digest = F.when(F.col("record_type") == "revisit", F.col("told")).when(base32_sha1(F.col("payload")) == F.col("told"), F.col("told")).otherwise(F.raise_error(F.lit("a payload read back differs from its digest")))
    return rows.select(to_id("WARC-Record-ID").alias(id_col), header("WARC-Target-URI").alias("uri"), "record_type", to_id("WARC-Refers-To").alias("refers_to"), "payload_bytes", digest.alias("payload_digest"), "payload")
