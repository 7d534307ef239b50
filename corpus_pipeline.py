"""A corpus pipeline of five stages, each one of the text operators applied to what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet to the
shared folder and reads them back as the next one's documents. All stages but the last return the five columns of
documents, ``COLUMNS``; other columns are dropped. Texts of any length are judged whole, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm._common import materialize
from flowloom.llm.decontamination import contaminated_by, is_clean
from flowloom.llm.line_dedup import drop_boilerplate
from flowloom.llm.near_duplicates import near_duplicates
from flowloom.llm.pieces import encode_decode
from flowloom.llm.queries import HELD_OUT
from flowloom.llm.toxicity import fit, score

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.5; the model learns from the labels that aren't held out.

    Where nothing could be learnt (no labels, labels of one kind, or no word that tells them apart) all stay. Null and
    empty texts and null ids are scored like any; repeated rows are each judged.
    """
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), where=~F.expr(HELD_OUT))
    if not model.learnt:
        return docs.select(*COLUMNS)
    return score(docs, model, carry=COLUMNS).where("score < 0.5").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines of their source; n_chars follows the text.

    Those left without text stay, null texts stay null, null sources are one source, and repeated rows are each a page.
    """
    return drop_boilerplate(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates.

    Rows with a null id and rows without words all stay. Rows that share an id are documents of their own: copies of each
    other are one group, and of those that tie for the smallest id one stays; a text without copies stays whatever
    else has its id.
    """
    if _ids_repeat(docs):
        keyed = materialize(docs.withColumn("__key", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())), "keyed")
        members = near_duplicates(keyed, "__key").join(keyed.select("__key", "doc_id"), "__key")
        one = F.min(F.struct("doc_id", "__key")).alias("one")
        first = members.groupBy("class_id").agg(one).select(F.col("one.__key").alias("__key"))
        return keyed.join(members.select("__key").join(first, "__key", "left_anti"), "__key", "left_anti").select(*COLUMNS)
    others = near_duplicates(docs).where("doc_id <> class_id").select("doc_id")
    return docs.join(others, "doc_id", "left_anti").select(*COLUMNS)


def _ids_repeat(docs: DataFrame) -> bool:
    """Whether an id stands in several rows, which then need keys of their own."""
    return not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates. Null and empty texts are clean; repeated rows are each judged."""
    found = contaminated_by(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=COLUMNS)
    return found.where(is_clean(F.col("items"))).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' ids, with the number and digest of their SentencePiece ids and the digest of the decoded text.

    A null text is an empty one, with a begin and an end id only; repeated rows and null ids each give their row.
    """
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("n-gram Jaccard join", one_of_each_group), ("benchmark decontamination", decontamination), ("SentencePiece", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: A model that is fitted and one that segments text are in it: tests hold its rows against a brute-force version.
ORACLE_SQL = None
