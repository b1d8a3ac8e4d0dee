"""The transaction clock: blocks, their transaction counts and the exclusive prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import boundary
from .prefix import WIDTH, carried, running_sum


def every_integer(span: DataFrame, first: str, last: str, name: str) -> DataFrame:
    """All integers of the one interval in ``span``: its ranges are dealt out before they are written out."""
    ranges = span.select(first, last, F.explode(F.sequence(F.floor(F.col(first) / WIDTH), F.floor(F.col(last) / WIDTH))).alias("_r")).repartition("_r")
    each = ranges.select(first, last, F.explode(F.sequence(F.col("_r") * WIDTH, F.col("_r") * WIDTH + WIDTH - 1)).alias(name))
    return each.where(F.col(name).between(F.col(first), F.col(last))).select(name)


def build_clock(counts: DataFrame, block: str = "block_ordinal", n: str = "transaction_count") -> DataFrame:
    """All blocks between the first and the last, empty ones included, with the exclusive prefix.

    Prefix sums run per range of blocks first and over the ranges' totals after that, so no task sees all blocks.
    """
    span = counts.agg(F.min(block).cast("long").alias("_a"), F.max(block).cast("long").alias("_z")).where("_a IS NOT NULL")
    # merged: the integers look like one row to the planner, which would broadcast them
    full = every_integer(span, "_a", "_z", block).hint("merge").join(counts, block, "left").select(block, F.coalesce(n, F.lit(0)).cast("long").alias(n))
    return exclusive_prefix(full, block, n, "prefix")


def exclusive_prefix(df: DataFrame, order: str, value: str, name: str, width: int = WIDTH) -> DataFrame:
    """Running sum before each row; ``order`` is an integer without repeats."""
    return running_sum(df, [], order, [], value, name, width, inclusive=False).withColumn(name, F.col(name).cast("long"))


def after_transactions(positions: DataFrame, clock: DataFrame, n: int, width: int = 1024) -> DataFrame:
    """(…, landing_block, landing_index): the place exactly ``n`` transactions later; none beyond the clock.

    Blocks with transactions are filed under every bucket of global numbers they touch, which turns the range join into an equi join.
    """
    target = positions.join(clock.select("block_ordinal", "prefix"), "block_ordinal").withColumn("g", F.col("prefix") + F.col("transaction_index") + n).drop("prefix").withColumn("_b", F.floor(F.col("g") / width))
    busy = clock.where("transaction_count > 0").select(F.col("block_ordinal").alias("landing_block"), F.col("prefix").alias("_p"), (F.col("prefix") + F.col("transaction_count")).alias("_e"))
    filed = busy.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_p") / width), F.floor((F.col("_e") - 1) / width))))
    hit = target.join(filed, "_b").where("_p <= g AND g < _e")
    return hit.withColumn("landing_index", F.col("g") - F.col("_p")).drop("_b", "_p", "_e", "g")


def first_block_at(times: DataFrame, clock: DataFrame, key: str, at: str, after: str, width: int = 3600) -> DataFrame:
    """The first block with transactions later than block ``after`` whose time is at least ``at``; null if there is none.

    ``key`` names the rows; ``at`` is no earlier than the time of block
    ``after``, and block times never fall.  Per bucket of time the earliest
    such block; if a row's own bucket has none, the first one of the next
    bucket that has any.  Rows with the same ``at`` and ``after`` have the same
    answer, so only different ones are looked up among the blocks.
    """
    busy = clock.where("transaction_count > 0").select("block_ordinal", "block_time_s").withColumn("_b", F.floor(F.col("block_time_s") / width))
    firsts = busy.groupBy("_b").agg(F.min("block_ordinal").alias("first"))
    wanted = times.select(at, after).distinct().withColumn("_b", F.floor(F.col(at) / width))
    buckets = firsts.unionByName(wanted.select("_b", F.lit(None).cast("long").alias("first"))).groupBy("_b").agg(F.min("first").alias("first"))
    following = carried(buckets, [], "_b", "first", forward=True).withColumnRenamed("_carried", "next_first")
    inside = wanted.join(busy.select("_b", F.col("block_ordinal").alias("_c"), "block_time_s"), "_b").where((F.col("block_time_s") >= F.col(at)) & (F.col("_c") > F.col(after)))
    own = inside.groupBy(at, after).agg(F.min("_c").alias("own"))
    found = wanted.join(own, [at, after], "left").join(following, "_b", "left").select(at, after, F.coalesce("own", "next_first").alias("found_block"))
    return times.join(found, [at, after], "left").select(*times.columns, "found_block")


def place(block, index):
    return boundary(block, index)
