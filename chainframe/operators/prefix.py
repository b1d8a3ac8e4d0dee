"""Running totals and carried values over ranges, so that no task sees a whole key or table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 4096


def _before(totals: DataFrame, keys: list[str], rank: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the smaller ranks of the same keys; ranks are integers without repeats."""
    w = Window.partitionBy(*keys, "_up").orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    ranged = totals.withColumn("_up", F.floor(F.col(rank) / WIDTH))
    upper = ranged.groupBy(*keys, "_up").agg(F.sum(value).alias("_t"))
    # the ranges of ranges are few: one for 16 million values of the order
    top = Window.partitionBy(*keys).orderBy("_up").rowsBetween(Window.unboundedPreceding, -1)
    above = upper.select(*keys, "_up", F.coalesce(F.sum("_t").over(top), F.lit(0)).alias("_a"))
    own = ranged.withColumn("_o", F.coalesce(F.sum(value).over(w), F.lit(0)))
    return own.join(above, [*keys, "_up"]).select(*keys, rank, (F.col("_o") + F.col("_a")).alias(name))


def running_sum(df: DataFrame, keys: list[str], at: str, order: list[str], value: str | Column, name: str, width: int = WIDTH, inclusive: bool = True) -> DataFrame:
    """Running sum of ``value`` per ``keys`` in the order of (``at``, *order); ``at`` is an integer, cut into ranges of ``width``."""
    amount = F.col(value) if isinstance(value, str) else value
    ranged = df.withColumn("_r", F.floor(F.col(at) / width)).withColumn("_v", amount)
    w = Window.partitionBy(*keys, "_r").orderBy(at, *order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    own = ranged.withColumn("_own", F.coalesce(F.sum("_v").over(w), F.lit(0)))
    before = _before(ranged.groupBy(*keys, "_r").agg(F.sum("_v").alias("_t")), keys, "_r", "_t", "_b")
    return own.join(before, [*keys, "_r"]).withColumn(name, F.col("_own") + F.col("_b")).drop("_r", "_v", "_own", "_b")


def carried(ranges: DataFrame, keys: list[str], rank: str, value: str, forward: bool = False) -> DataFrame:
    """For every given (keys, rank) the ``value`` of the nearest smaller rank of the same keys that has one (forward: larger)."""
    up = F.floor(F.col(rank) / WIDTH)
    ranged = ranges.withColumn("_up", up)
    turn = F.desc if forward else F.asc  # frames that grow are folded once
    best = F.min_by if forward else F.max_by

    def before(name: str, part: list[str], order: str) -> Column:
        return F.last(name, ignorenulls=True).over(Window.partitionBy(*part).orderBy(turn(order)).rowsBetween(Window.unboundedPreceding, -1))

    upper = ranged.groupBy(*keys, "_up").agg(best(value, F.when(F.col(value).isNotNull(), F.col(rank))).alias("_t"))
    above = upper.select(*keys, "_up", before("_t", keys, "_up").alias("_a"))
    own = ranged.withColumn("_o", before(value, [*keys, "_up"], rank))
    return own.join(above, [*keys, "_up"]).select(*keys, rank, F.coalesce("_o", "_a").alias("_carried"))
