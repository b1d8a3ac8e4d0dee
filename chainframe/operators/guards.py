"""Limits that raise; a result is complete or there is none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class LimitExceeded(ValueError):
    pass


def guard_rows(df: DataFrame, most: int) -> DataFrame:
    if df.limit(most + 1).count() > most:
        raise LimitExceeded(f"more than {most} rows")
    return df


def guard_empty(violations: DataFrame, what: str) -> None:
    if not violations.isEmpty():
        raise ValueError(f"{what}: {violations.first()}")


def guard_unique(df: DataFrame, *keys: str) -> DataFrame:
    guard_empty(duplicates(df, *keys), "repeated key")
    return df


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_schema(df: DataFrame, schema: StructType) -> DataFrame:
    have, want = ([(f.name, f.dataType) for f in s.fields] for s in (df.schema, schema))
    if have != want:
        raise TypeError(f"schema {have}, expected {want}")
    return df
