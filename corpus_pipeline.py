"""The corpus pipeline: five stages over ``documents``, each written as Parquet
to the shared folder and read again as the next one's documents.

Every stage judges all that its predecessor kept and calls one operator of
``cohortflow.llm``; all but the last return the columns of ``documents``, the
last the pieces of the packed corpus with their ids.
Near duplicates are those whose five-word shingles have a similarity of 0.8 or
more.  Nulls, repeated rows and empty tables are handled as each operator's
docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortflow.llm import decontam, exact_dedup, near_dup, packing, toxicity
from cohortflow.llm.common import staged, table


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", not_toxic),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", clean_of_benchmark),
    ("packing", packed),
]

#: No SQL can express the classifier, the link confirmation by signatures or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
