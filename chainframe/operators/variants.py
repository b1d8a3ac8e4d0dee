"""Deduplication that keeps multiplicity visible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dedup_with_variants(df: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """One row per key: the smallest of each payload column, the number of rows and of different payloads.

    Different payloads are counted as structs, so rows with nulls count too.
    """
    return df.groupBy(*keys).agg(*(F.min(c).alias(c) for c in payload), F.count("*").alias("source_row_count"), F.count_distinct(F.struct(*payload)).alias("payload_variant_count"))


def zero_filled(df: DataFrame, key: str, values: list[str], **aggregates: Column) -> DataFrame:
    """Aggregates for every value of a closed set, zero where it does not occur."""
    all_values = F.explode(F.array(*(F.lit(v) for v in values))).alias(key)
    base = df.sparkSession.range(1).select(all_values)
    found = df.groupBy(key).agg(*(e.alias(n) for n, e in aggregates.items()))
    return base.join(found, key, "left").select(key, *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in aggregates))
