"""The corpus pipeline: five stages from raw documents to packed training sequences."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm.common import shared_dir, table
from ledgerline.llm.exact_dedup import drop_duplicates
from ledgerline.llm.mixing import mix_documents
from ledgerline.llm.near_dedup import drop_near_duplicates
from ledgerline.llm.packing import pack_documents
from ledgerline.llm.quality import keep_good

#: SQL cannot express the trained scorer, the random mix or the packing.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label scorer does not reject; same columns.

    Null, empty and blank texts are rejected; rows that repeat a text stay or go together; null ids, long texts and
    columns of any name pass through; an empty table stays empty. sf_dir is not read.
    """
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of equal texts; same columns.

    Null texts count as empty, null ids as the last; of rows that repeat an id and a text one stays. An empty table stays
    empty, long texts and columns of any name pass through. sf_dir is not read.
    """
    return drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component of near duplicates; same columns.

    Texts without words and null ids are linked with nothing and stay; rows that repeat an id and a text are one document. An empty
    table stays empty, long texts are compared whole, columns of any name pass through. sf_dir is not read.
    """
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times; same columns.

    Null sources are one source, null ids documents; texts without words take no words and keep the whole part of their copies; rows
    that repeat an id, source and size are taken alike. An empty table stays empty; columns of any name pass through. sf_dir is not read.
    """
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids, with their ids; a repeated document is packed again.

    A null or empty text is its end id alone, null ids stay null, a long text fills sequences of its own; other columns go. An empty table
    gives no pieces. sf_dir is not read.
    """
    return pack_documents(docs, "word_bpe_49k.json", end=1)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's result is written to the shared folder and reread."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
