"""Parallel corpora: XML books, aligned conversations, and saved corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import clean_target, parse_range, reference, simplified, strip

BOOK = "_number INT, chapter ARRAY<STRUCT<_number: INT, verse: ARRAY<STRUCT<_number: INT, _VALUE: STRING>>>>"


def read_verses(spark: SparkSession, path: str, books: str | None = None) -> DataFrame:
    """book, chapter, verse, text of an XML corpus; ``books`` is ``n`` or ``a-b``."""
    rows = spark.read.format("xml").option("rowTag", "book").schema(BOOK).load(path)
    if books:
        rows = rows.where(F.col("_number").between(*parse_range(books)))
    rows = rows.select(F.col("_number").alias("book"), F.explode("chapter").alias("c")).select("book", F.col("c._number").alias("chapter"), F.explode("c.verse").alias("v"))
    return rows.select("book", "chapter", F.col("v._number").alias("verse"), F.col("v._VALUE").alias("text"))


def structure(verses: DataFrame, *keys: str) -> DataFrame:
    """Verses by book and chapter."""
    return verses.groupBy(*(keys or ("book", "chapter"))).agg(F.count("*").alias("verses"))


def align(source: DataFrame, target: DataFrame, target_language: str = "English", compatible: bool = False, table: dict[str, str] | None = None) -> DataFrame:
    """Verses that both sides have with some text, cleaned; blank-only texts count as text."""
    keys = ["book", "chapter", "verse"]
    own, other = (x.where(F.length("text") > 0).select(*keys, F.col("text").alias(n)) for x, n in ((source, "s"), (target, "t")))
    return own.join(other, keys).select(*keys, reference(*map(F.col, keys)).alias("verse_reference"), strip(F.col("s")).alias("source_text"), simplified(clean_target(F.col("t"), target_language, compatible), table or {}).alias("target_text"))


def conversation_verses(conversations: DataFrame) -> DataFrame:
    """Each user's turn with the assistant's next as an aligned verse: conv_id is the book, the turn the verse.

    An equality join on conversation and turn, so a long conversation isn't one task.
    """
    own = conversations.where("role = 'user' AND length(text) > 0").select(F.col("conv_id").alias("book"), F.col("turn").alias("verse"), strip(F.col("text")).alias("source_text"))
    answer = conversations.where("role = 'assistant' AND length(text) > 0").select(F.col("conv_id").alias("book"), (F.col("turn") - 1).alias("verse"), strip(F.col("text")).alias("target_text"))
    return own.join(answer, ["book", "verse"]).select("book", "verse", reference(F.col("book"), F.col("verse")).alias("verse_reference"), "source_text", "target_text")


def save_corpus(verses: DataFrame, path: str, by: str | None = None, kind: str = "parquet") -> None:
    writer = verses.write.mode("overwrite").format(kind)
    (writer.partitionBy(by) if by else writer).save(path)


def load_corpus(spark: SparkSession, path: str, kind: str = "parquet", schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.format(kind)
    return (reader.schema(schema) if schema else reader).load(path)
