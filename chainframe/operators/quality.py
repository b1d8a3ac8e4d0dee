"""Coverage, gaps, proofs and reconciliations; most return what is wrong, and must be empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gaps_and_overlaps(shards: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Neighbouring shards whose ends do not meet.

    Shards are manifest rows, one per published file group, so one task orders them.
    """
    nxt = F.lead(lo).over(Window.orderBy(lo, hi))
    return shards.withColumn("next_lo", nxt).where(F.col("next_lo").isNotNull() & (F.col("next_lo") != F.col(hi)))


def frontier(shards: DataFrame, start: int, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """The end of the gap-free coverage from ``start``; overlaps are fine."""
    w = Window.orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, -1)
    seen = shards.where(F.col(hi) > start).withColumn("_before", F.greatest(F.coalesce(F.max(hi).over(w), F.lit(start)), F.lit(start)))
    gap = seen.agg(F.min(F.when(F.col(lo) > F.col("_before"), F.col("_before"))).alias("g"), F.max(hi).alias("m"))
    return gap.select(F.coalesce("g", "m", F.lit(start)).alias("frontier"))


def unbalanced(postings: DataFrame, transaction: str = "transaction_id", asset: str = "asset", amount: str = "amount") -> DataFrame:
    """Transactions that are no double entry: a sum other than zero, fewer than two postings, or a zero posting."""
    per = postings.groupBy(transaction, asset).agg(F.sum(F.col(amount).cast("decimal(38,0)")).alias("total"), F.count("*").alias("n"), F.count_if(F.col(amount) == 0).alias("zeros"))
    return per.where("total <> 0 OR n < 2 OR zeros > 0")


def balances(postings: DataFrame, *keys: str, amount: str = "amount") -> DataFrame:
    return postings.groupBy(*keys).agg(F.sum(F.col(amount).cast("decimal(38,0)")).alias("amount"))


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys that one side lacks or whose values differ."""
    both = left.select(*keys, F.col(value).alias("left_value")).join(right.select(*keys, F.col(value).alias("right_value")), keys, "full_outer")
    return both.where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def three_valued(holds, known):
    """PROVEN, REFUTED, or UNKNOWN without evidence."""
    return F.when(~known, "UNKNOWN").when(holds, "PROVEN").otherwise("REFUTED")


def unordered_digest(df: DataFrame, *columns: str) -> DataFrame:
    """A digest of rows that does not depend on their order: row digests added up as numbers, with the count.

    Sums combine on the map side, where a sorted list of all rows would meet in one task.
    """
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string")
    return df.agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *(part(i) for i in range(8))), 256).alias("digest"))


def ordered_digest(df: DataFrame, order: list[str], *columns: str, domain: str = "stream") -> DataFrame:
    """A digest that depends on the order: per range of rows first, then over the ranges in order."""
    from .research import global_ordinal

    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    level = global_ordinal(df, order).select(F.col("row_id").alias("i"), row.alias("d"))
    # digests of 1024 digests each, over and over: three levels are a billion rows, and the last task reads a few
    for _ in range(3):
        part = F.floor(F.col("i") / 1024)
        level = level.groupBy(part.alias("i")).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "d"))), lambda x: x["d"]), ""), 256).alias("d"), F.sum("n" if "n" in level.columns else F.lit(1)).alias("n"))
    return level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.concat(F.lit(domain + "\0"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "d"))), lambda x: x["d"]), "")), 256).alias("digest"))
