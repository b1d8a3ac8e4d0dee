"""Replay packs: a run's events as columns of small codes in the order of replay, with their dictionaries beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.research import global_ordinal
from .sinks import publish

#: Columns that are replaced by codes; the others are stored as they are.
CODED = ("venue", "side")
PLAIN = ("boundary", "event_id", "amount")


def write(events: DataFrame, path: str) -> str:
    """Publish the dictionaries first and the events last: a pack that has events is complete."""
    rows = events.select(*PLAIN, *CODED)
    for name in CODED:
        words = publish(global_ordinal(rows.select(name).distinct(), [name], f"{name}_code"), f"{path}/{name}")
        # dictionaries are as small as their columns' values are few; Spark decides how to join them
        rows = rows.join(words, name).drop(name)
    ordered = rows.repartitionByRange("boundary", "event_id")
    publish(ordered.select(*PLAIN, *(F.col(f"{n}_code").cast("int") for n in CODED)), f"{path}/events", ["boundary", "event_id"])
    return path


def read(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """Events with start <= boundary < end; row groups outside the range are not read."""
    rows = spark.read.parquet(f"{path}/events").where((F.col("boundary") >= start) & (F.col("boundary") < end))
    for name in CODED:
        words = spark.read.parquet(f"{path}/{name}").withColumn(f"{name}_code", F.col(f"{name}_code").cast("int"))
        rows = rows.join(words, f"{name}_code")
    return rows.select("event_id", "boundary", *CODED, "amount")
