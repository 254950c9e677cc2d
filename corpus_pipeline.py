"""Corpus pipeline: quality rules, line dedup, n-gram Jaccard join, PII, packing.

Each stage works on all that its predecessor kept.  All but the last return the
columns of ``documents``; the last returns the packed pieces.

Cases that hold for every stage: an empty table gives an empty table; columns
beyond doc_id and text pass through, whatever their names; repeated rows are
treated alike; texts are used whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import jaccard_join, line_dedup, packing, pii, quality_rules
from wordloom.llm.queries import tokenizer_path
from wordloom.plans.names import fresh
from wordloom.plans.staging import Workspace, scope


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go; a null or empty text is rejected."""
    return quality_rules.keep_good(docs, "v1")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go, and so do documents that are left without a word.

    What is left of a document stays, however short: it may hold the only copy
    of a line that others lost.  Documents without a shared line stay as they
    are (a null text as an empty one), and so do rows without a doc_id.
    """
    before, dropped = fresh(docs.columns, "lines_before", "lines_dropped")
    clean = line_dedup.dedup_lines(docs, counts=(before, dropped))
    held = (F.col(dropped) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return clean.where(held).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays, with all its rows.

    Texts without a word and rows without a doc_id are in no group and stay.
    """
    return jaccard_join.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked; texts without any stay as they are, nulls included."""
    return pii.redact(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and offset; a null text is packed as an empty one."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("personal_data", personal_data), ("sequences", sequences)]

#: Tokenizers and spans can't be had in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what a stage wrote for itself is deleted once its result is written."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scope(spark):
            docs = work.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
