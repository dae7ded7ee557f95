"""From raw documents to piece ids: five stages, each an operator of larkspur.llm on all rows that the one before it kept.

Every stage but the last returns the columns of documents. `run` writes each stage's rows to the shared folder and reads
them again, as a scheduler would that runs one stage at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import langid, minhash, mixing, sentencepiece_ops, suffix_dedup
from larkspur.llm.common import Tables

#: A document whose best language has a lower score than this is rejected, as is one without a letter.
LEAST_SCORE = 0.4
#: Near duplicates share this percentage of their five-word shingles.
NEAR_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labels name.

    A document whose text is null, empty or has no letter goes; so do all where no row has a label. Repeated rows and equal texts stay or go together; long texts are read
    whole. No rows in, no rows out. Other columns, whatever their names, are passed on.
    """
    return langid.accept(docs, langid.fit(docs), LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id.

    Documents without words are duplicates of nothing, and rows without an id always stay. Rows that repeat a doc_id are one document: they stay or go together. Long texts are
    compared whole. No rows in, no rows out. Other columns, whatever their names, are passed on.
    """
    gone = minhash.link(docs, Tables(spark, "near"), NEAR_PERCENT).where(~F.col("kept")).select(F.col("doc_id").alias("__lk_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__lk_gone"), "left_anti")


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document holds too; a document of which nothing is left goes.

    A null or empty text stays as it is (a null one as empty), and so do texts under 100 bytes. Repeated rows are one document and lose nothing to each other; rows without an
    id come first. n_chars is that of the new text. Long texts are read whole. No rows in, no rows out. Other columns, whatever their names, are passed on.
    """
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    inner = {c: f"__lk_own{k}" for k, c in enumerate(others)}
    given = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()]).alias("rest"))
    cut = suffix_dedup.dedup(given, Tables(spark, "passages"), ["rest"], "kept_text")
    left = cut.where((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    size = F.length("kept_text").cast(dict(docs.dtypes).get("n_chars", "bigint"))
    return left.select(*[F.col("kept_text").alias(c) if c == "text" else size.alias(c) if c == "n_chars" else F.col(f"rest.{inner[c]}").alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to the square root of their sizes, each document as often as drawn, shuffled.

    Rows without a source are a source, and those without an id are drawn alike; null, empty and long texts are rows as any other. Repeated rows are drawn equally often each.
    No rows in, no rows out. Other columns, whatever their names, are passed on.
    """
    rest = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`").alias(f"__lk_own{k}") for k, c in enumerate(docs.columns)]).alias("rest"))
    return mixing.mix(rest).select(*[F.col(f"rest.__lk_own{k}").alias(c) for k, c in enumerate(docs.columns)])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents but text and n_chars, plus ids, the piece ids of each text, and n_pieces long.

    A null text has null ids and an empty one none (n_pieces 0). Repeated rows and equal texts have equal ids; long texts are encoded whole. No rows in, no rows out. Columns named
    ids or n_pieces are replaced, all others are passed on.
    """
    return sentencepiece_ops.encode(docs, [c for c in docs.columns if c not in ("text", "n_chars", "n_pieces")]).withColumn("n_pieces", F.coalesce(F.size("ids"), F.lit(0)).cast("long"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encode),
]

#: SQL can express neither the network nor the sketches, suffix arrays and segmentation; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = tables.cut(stage(spark, docs, sf_dir))
        if before is not None:
            tables.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
