"""A training-data pipeline over ``documents``: five stages, each one of this library's operators.

Every stage works on all rows that the one before it kept. All but the last return the columns of ``documents``; the
last writes token shards and returns what is in them. Null, empty and repeated rows are treated as each operator's
docstring says: a text without a letter has no language and goes in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiforge.llm import decontaminate, langid, mixing, neardup, queries, tokenbin
from lexiforge.llm.work import shared_dir, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, to a probability of one half; the others go."""
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8 or more."""
    return neardup.deduplicated(docs, neardup.Plan(k=5, percent=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark within the edit budget."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 5, 2, 1 and so on, 150% of all words, no document more than twice: a row for each time a document is taken."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of all documents, with the end id 2, as read back."""
    return tokenbin.token_table(spark, docs, queries.tokenizer_file(), end_id=2)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mix", mix), ("tokens", tokens)]
#: Learned classifiers, hashed signatures and tokenizers aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"{out}/{i}-{name}")
    return docs
