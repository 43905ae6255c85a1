"""Corpus pipeline: quality filter, exact dedup, near dedup, PII surrogates, packing.

Each stage calls one operator of ``postlytics.llm``, works on all rows that its predecessor
kept, and returns the columns of ``documents`` (the last one the packed pieces). ``run``
writes every stage as Parquet to the shared folder and reads it again for the next one.
Nulls, empty texts, repeated rows and empty tables are handled as the operators state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlytics.llm.common import stored, table
from postlytics.llm.exact_dedup import keep_exact
from postlytics.llm.packing import pack_documents
from postlytics.llm.pii import replace_pii
from postlytics.llm.quality import fit_ranker, score_documents
from postlytics.llm.simhash import keep_near
from postlytics.session import ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score, learnt from the labels of these documents, is below the cut."""
    ship_package(spark)
    ranker = fit_ranker(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs.select(*COLUMNS), ranker).filter("predicted = 1").select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id stays."""
    return keep_exact(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash the one with the smallest doc_id stays."""
    ship_package(spark)
    return keep_near(docs.select(*COLUMNS))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; n_chars counts the new text."""
    out = replace_pii(docs.select(*COLUMNS), "corpus pipeline")
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                          .otherwise(F.length("text").cast("long")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 ids."""
    ship_package(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 0)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("pii", pii), ("packing", packing)]

# scoring, SimHash, surrogates and tokenizing have no SQL form: tests compare each stage
# with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
