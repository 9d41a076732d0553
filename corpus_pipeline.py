"""From raw documents to a token file: five stages, each written and read again.

1. ``language``: documents without a letter, of no language that the model knows with
   probability one half, or far less probable than texts of that language usually are, go.
2. ``near_duplicates``: of each group of documents whose SimHash fingerprints (four-word
   shingles) are linked at four or fewer bits, the one with the smallest id stays.
3. ``decontamination``: documents that hold a window of a benchmark item go.
4. ``mixing``: documents are taken as often as the target weights of their sources ask.
5. ``tokens``: the mix is written as a token file; the result lists its documents.

All stages but the last return the columns of ``documents``, also such that the stages do
not know or have names that they use themselves. Empty tables pass through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledger_analytics.llm import decontaminate, langid, mixing, simhash
from ledger_analytics.llm.queries import token_rows
from ledger_analytics.llm.storage import Stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.identified_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, F.array("source"))


def token_file(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_rows(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
    ("tokens", token_file),
]

#: Language model, fingerprints and tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the checkpoint
    folder, and removed once the next stage is written."""
    stored = Stored(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored.table(stage(spark, docs, sf_dir))
        stored.keep(docs)
    return docs
