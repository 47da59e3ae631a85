"""From raw documents to packed training sequences, one operator a stage.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written and read again before the next one.  All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import decontaminate, jaccard_join, packing, pii, quality_rules
from logloom.llm.common import saved, table


def few_rows(stage):
    """A stage of this application: Python workers get batches of few rows, as texts may be long.

    In every stage null, empty and very long texts, null ids, repeated rows, tables without rows and further columns of whatever name are allowed; each stage says what becomes of them.
    """

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        return stage(spark, docs, sf_dir)

    return run


@few_rows
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules of documents and hosts reject go, null and empty texts among them (they have no words); a null host rejects nothing; repeated rows are judged alike."""
    return quality_rules.keep_good(docs)


@few_rows
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays, that with the smallest id (null ids come last); texts without words are in no group and stay; a row that is there twice stays once."""
    return jaccard_join.one_of_each(docs)


@few_rows
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, every copy of them; null and empty texts hold none and stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@few_rows
def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets; the count of characters follows, null for a null text; every row stays."""
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(masked.schema["n_chars"].dataType))


@few_rows
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of full sequences, every sequence with each source's share; null and empty texts are their end id, null sources one source of their own."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", keep_good),
    ("jaccard_join", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: Tokens, message passing and shingle sets are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
