"""Structured Streaming twins of the event-time operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, path: str, schema: StructType, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def _timed(events: DataFrame, at: str, late: str) -> DataFrame:
    return events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes", at: str = "ts", key: str = "event_type") -> DataFrame:
    """Tumbling windows, or sliding ones with ``slide``."""
    w = F.window("_at", size, slide) if slide else F.window("_at", size)
    counted = _timed(events, at, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes", at: str = "ts", key: str = "user_id") -> DataFrame:
    grouped = _timed(events, at, late).groupBy(F.session_window("_at", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def without_repeats(events: DataFrame, key: str, late: str = "1 hour", at: str = "ts") -> DataFrame:
    return _timed(events, at, late).dropDuplicatesWithinWatermark([key]).drop("_at")


def interval_join(left: DataFrame, right: DataFrame, key: str, within: str, late: str = "1 hour", at: str = "ts") -> DataFrame:
    """Pairs of a left event and a right event of the same key at most ``within`` later."""
    a = _timed(left, at, late).select(F.col(key).alias("k"), F.col("_at").alias("left_at"), F.col("event_id").alias("left_id"))
    b = _timed(right, at, late).select(F.col(key).alias("rk"), F.col("_at").alias("right_at"), F.col("event_id").alias("right_id"))
    return a.join(b, F.expr(f"k = rk AND right_at >= left_at AND right_at <= left_at + INTERVAL {within}")).select(F.col("k").alias(key), "left_id", "right_id")


def cooldown(events: DataFrame, key: str, seconds: int, at: str = "ts") -> DataFrame:
    """The greedy cooldown with its state per key; events must arrive in time order within a key's batches."""

    def accept(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        kept = []
        for t, i in zip(rows["t"], rows["event_id"], strict=True):
            if last is None or t >= last + seconds:
                last = int(t)
                kept.append((k[0], int(i), last))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(kept, columns=[key, "event_id", "t"])

    rows = events.select(key, "event_id", F.unix_timestamp(F.col(at).cast("timestamp")).alias("t"))
    return rows.groupBy(key).applyInPandasWithState(accept, f"{key} long, event_id long, t long", "last long", "append", GroupStateTimeout.NoTimeout)


def late_rows(events: DataFrame, floor: str, at: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Rows in time, and the late ones for a count of their own: nothing is dropped unseen."""
    late = F.col(at).cast("timestamp") < F.lit(floor).cast("timestamp")
    return events.where(~late), events.where(late)
