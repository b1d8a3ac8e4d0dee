"""Causal replay: cooldowns, venue states, and funds that refuse what they do not cover.

Own orders never change a venue's state here, so timing and quotes are plain
joins against the clock and the venues' states.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cooldown(events: DataFrame, key: str, at: str, seconds: int, tie: str) -> DataFrame:
    """Greedy per key: an accepted event blocks later ones for ``seconds``; blocked ones block nothing.

    An event that comes ``seconds`` or more after the one before it, accepted
    or not, is always accepted, so a key falls into segments there; the rule is
    sequential only within a segment, which is folded inside one row.
    """
    order = Window.partitionBy(key).orderBy(at, tie)
    fresh = F.coalesce((F.col(at) - F.lag(at).over(order) >= seconds).cast("int"), F.lit(1))
    cut = events.withColumn("_new", fresh).withColumn("_segment", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    entry = F.struct(F.col(at).alias("t"), F.col(tie).alias("id"))
    zero = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<long>").alias("ids"))

    def step(acc: Column, x: Column) -> Column:
        free = acc["last"].isNull() | (x["t"] >= acc["last"] + seconds)
        return F.when(free, F.struct(x["t"].alias("last"), F.concat(acc["ids"], F.array(x["id"])).alias("ids"))).otherwise(acc)

    lists = cut.groupBy(key, "_segment").agg(F.array_sort(F.collect_list(entry)).alias("l"))
    kept = lists.select(F.explode(F.aggregate("l", zero, step, lambda a: a["ids"])).alias(tie))
    return events.join(kept, tie)


def venue_states(curve: DataFrame, life: DataFrame) -> DataFrame:
    """The state after each whole transaction: nothing between is ever seen.

    ``life`` has per venue where it was completed and migrated, if it was.
    """
    last = curve.groupBy("venue", "boundary").agg(F.max_by(F.struct("vt", "vq"), "event_id").alias("s"))
    lifecycle = F.when(F.col("boundary") >= F.col("migrated_at"), "MIGRATED").when(F.col("boundary") >= F.col("completed_at"), "COMPLETED").otherwise("ACTIVE")
    return last.join(life, "venue", "left").select("venue", F.col("boundary").alias("state_at"), "s.vt", "s.vq", lifecycle.alias("lifecycle"))


def transition_errors(states: DataFrame) -> DataFrame:
    """States that do not follow from the one before them in their venue: ACTIVE, COMPLETED, MIGRATED, never back and none left out; reserves below what separates virtual from real."""
    rank = lambda c: F.when(c == "MIGRATED", 2).when(c == "COMPLETED", 1).otherwise(0)
    before = F.lag("lifecycle").over(Window.partitionBy("venue").orderBy("state_at"))
    step = rank(F.col("lifecycle")) - rank(F.coalesce(before, F.lit("ACTIVE")))
    return states.withColumn("step", step).where("step < 0 OR step > 1 OR vt <= 0 OR vq <= 0").drop("step")


def funded(acts: DataFrame, account: str, order: list[str], amount: str, opening: int) -> DataFrame:
    """Actions in order with ``accepted`` and the ``balance`` after them; what the funds do not cover is refused and changes nothing.

    Sequential per account: a task streams through one account after the other and holds a balance.
    """
    names = acts.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in acts.dtypes) + ", accepted boolean, balance long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, left, first = None, opening, True
        for batch in batches:
            accepted, balance = [], []
            for owner, x in zip(batch.column(names.index(account)).to_pylist(), batch.column(names.index(amount)).to_pylist(), strict=True):
                if first or owner != name:
                    name, left, first = owner, opening, False
                take = left + x >= 0
                left += x if take else 0
                accepted.append(take)
                balance.append(left)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(accepted, pa.bool_()), pa.array(balance, pa.int64())], [*names, "accepted", "balance"])

    return acts.repartition(account).sortWithinPartitions(account, *order).mapInArrow(run, schema)
