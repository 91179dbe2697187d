"""Co-occurrence counts of source and target terms in verses and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verse_counts(rows: DataFrame, keys: list[str], source: str, target: str) -> DataFrame:
    """Counts for arrays of terms: each different source term with every target occurrence of its verse.

    Both arrays are unfolded where the verse lies, so the only shuffle is that of the count itself.
    """
    pairs = rows.select(*keys, F.explode(F.array_distinct(source)).alias("source_term"), F.col(target).alias("t")).select(*keys, "source_term", F.explode("t").alias("target_term"))
    return pairs.groupBy(*keys, "source_term", "target_term").agg(F.count("*").alias("cnt"))


def batch_counts(counts: DataFrame, batch: list[str]) -> DataFrame:
    """Sums of verse counts by batch; without a batch, over everything."""
    return counts.groupBy(*batch, "source_term", "target_term").agg(F.sum("cnt").alias("cnt"))
