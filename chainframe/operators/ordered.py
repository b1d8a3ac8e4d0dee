"""As-of, interval and forward joins, by union and window instead of range joins.

Both sides are shuffled once on the key and the range of time, and sorted once;
a theta join would compare every pair.  What a range has not seen comes from
the nearest range of the same key that has, so one hot key is many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prefix import carried


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, take: list[str], forward: bool = False, width: int | None = None) -> DataFrame:
    """``left`` with the columns ``take`` of the last right row at or before it (forward: the first at or after it).

    Of right rows at one place the largest ``take`` wins; null if there is
    none.  ``width`` cuts the integer positions into ranges.
    """
    kind = dict(left.dtypes)
    hit = right.select(F.struct(right_at, *take).alias("x")).schema["x"].dataType
    cut = (lambda at: F.floor(F.col(at) / width)) if width else (lambda at: F.lit(0).cast("long"))
    probe = left.select(*keys, F.col(left_at).alias("_at"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(hit).alias("_hit"), F.lit(0 if forward else 1).alias("_side"), cut(left_at).alias("_range"))
    base = right.select(*keys, F.col(right_at).cast(kind[left_at]).alias("_at"), F.lit(None).cast(probe.schema["_row"].dataType).alias("_row"), F.struct(right_at, *take).alias("_hit"), F.lit(1 if forward else 0).alias("_side"), cut(right_at).alias("_range"))
    # forward the order is turned round: a frame that grows is folded once, one that shrinks is read again for every row
    w = Window.partitionBy(*keys, "_range").orderBy(*(F.desc(c) if forward else F.asc(c) for c in ("_at", "_side", "_hit"))).rowsBetween(Window.unboundedPreceding, 0)
    joined = probe.unionByName(base).withColumn("_found", F.last("_hit", ignorenulls=True).over(w)).where("_row IS NOT NULL")
    if width:
        best = (F.min if forward else F.max)("_hit")  # right_at comes first in it
        ranges = base.select(*keys, "_range", "_hit").unionByName(probe.select(*keys, "_range", "_hit")).groupBy(*keys, "_range").agg(best.alias("_hit"))
        joined = joined.join(carried(ranges, keys, "_range", "_hit", forward), [*keys, "_range"], "left").withColumn("_found", F.coalesce("_found", "_carried"))
    return joined.select("_row.*", *(F.col("_found")[c].alias(c) for c in take))


def interval_lookup(left: DataFrame, right: DataFrame, keys: list[str], at: str, lo: str, hi: str, take: list[str], width: int | None = None) -> DataFrame:
    """The interval [lo, hi) with the greatest ``lo`` at or before ``at``, if it still covers it."""
    found = asof(left, right, keys, at, lo, [hi, *take], width=width)
    covers = F.col(at) < F.col(hi)
    return found.select(*left.columns, *(F.when(covers, F.col(c)).alias(c) for c in take))
