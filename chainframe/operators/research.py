"""Pairs of actors: first purchases, co-participation within a window, evidence, activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .guards import LimitExceeded
from .prefix import running_sum

POSITION = ["block_ordinal", "transaction_index", "source_instruction_index"]


def first_buys(obs: DataFrame) -> DataFrame:
    """The first BUY of each (signer, mint); a grouped minimum combines on the map side where row_number would not."""
    rest = [c for c in obs.columns if c not in ("signing_wallet", "mint", *POSITION)]
    first = obs.where(F.col("side") == "BUY").groupBy("signing_wallet", "mint").agg(F.min(F.struct(*POSITION, *rest)).alias("m"))
    return first.select("signing_wallet", "mint", "m.*")


def candidate_budget(firsts: DataFrame) -> DataFrame:
    per = firsts.groupBy("mint").agg(F.count("*").alias("n"))
    return per.agg(F.max("n").alias("max_signers"), F.sum(F.expr("n * (n - 1) div 2")).alias("candidates"))


def guarded(firsts: DataFrame, most_signers: int | None, most_candidates: int | None) -> DataFrame:
    """Raise before a join that would be too large."""
    if most_signers is not None or most_candidates is not None:
        b = candidate_budget(firsts).first()
        if (most_signers is not None and (b[0] or 0) > most_signers) or (most_candidates is not None and (b[1] or 0) > most_candidates):
            raise LimitExceeded(f"{b[0]} signers of a mint, {b[1]} candidate pairs")
    return firsts


def matches(firsts: DataFrame, window_s: int) -> DataFrame:
    """(mint, a, b, times and transactions): signers a < b that bought within the window.

    Time is cut into windows; a row meets its own and the next one, so that a hot mint's rows spread over many keys.
    """
    ids = [F.col("observation_id").alias("o")] if "observation_id" in firsts.columns else []
    rows = firsts.select("mint", F.col("signing_wallet").alias("w"), F.col("block_time_s").alias("t"), F.struct(*POSITION).alias("p"), *ids)
    own = [c for c in rows.columns if c != "mint"]
    cell = F.floor(F.col("t") / (window_s + 1)).cast("long")
    left = rows.select("mint", cell.alias("cell"), *(F.col(c).alias(f"x_{c}") for c in own))
    right = rows.withColumn("cell", F.explode(F.array(cell, cell - 1))).select("mint", "cell", *(F.col(c).alias(f"y_{c}") for c in own))
    near = left.join(right, ["mint", "cell"]).where((F.abs(F.col("x_t") - F.col("y_t")) <= window_s) & (F.col("x_w") != F.col("y_w")))
    # a pair inside one cell meets twice, in neighbouring cells once: keep the ordered one, or turn it round
    same_cell = F.floor(F.col("y_t") / (window_s + 1)) == F.col("cell")
    near = near.where(~same_cell | (F.col("x_w") < F.col("y_w")))
    flip = F.col("x_w") > F.col("y_w")
    pick = lambda c, other: F.when(flip, F.col(f"{other}_{c}")).otherwise(F.col(f"{'x' if other == 'y' else 'y'}_{c}"))
    return near.select("mint", pick("w", "y").alias("signer_a"), pick("w", "x").alias("signer_b"), pick("t", "y").alias("a_t"), pick("t", "x").alias("b_t"), pick("p", "y").alias("a_p"), pick("p", "x").alias("b_p"), *((pick("o", "y").alias("left_observation"), pick("o", "x").alias("right_observation")) if ids else ()))


def pair_counts(found: DataFrame, least_shared: int) -> DataFrame:
    """Who bought first is told by block and transaction; two buys of one transaction are a tie."""
    place = lambda p: F.struct(F.col(p)["block_ordinal"], F.col(p)["transaction_index"])
    counted = found.groupBy("signer_a", "signer_b").agg(
        F.count("*").alias("shared_mints"),
        F.count_if(place("a_p") < place("b_p")).alias("a_first"),
        F.count_if(place("b_p") < place("a_p")).alias("b_first"),
        F.count_if(place("a_p") == place("b_p")).alias("same_transaction"),
    )
    return counted.where(F.col("shared_mints") >= least_shared)


def with_evidence_ranges(pairs: DataFrame) -> DataFrame:
    """Pair rows in order with the range of their evidence."""
    numbered = stored(global_ordinal(pairs, ["signer_a", "signer_b"]), "pairs")
    ranged = running_sum(numbered, [], "row_id", [], "shared_mints", "evidence_start", inclusive=False)
    return ranged.select("row_id", *pairs.columns, F.col("evidence_start").cast("long").alias("evidence_start"), F.col("shared_mints").alias("evidence_count"))


def evidence(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """What the pairs rest on: with ``observation_id`` in the observations, both sides' ids as well."""
    ids = [c for c in ("left_observation", "right_observation") if c in found.columns]
    return found.join(pairs.select("signer_a", "signer_b"), ["signer_a", "signer_b"]).select("signer_a", "signer_b", "mint", *ids, (F.col("b_t") - F.col("a_t")).alias("delta_seconds"))


def evidence_rows(found: DataFrame, ranged: DataFrame) -> DataFrame:
    """Evidence with the row numbers of its pair (from ``with_evidence_ranges``) and its own, in the order of pair and mint."""
    rows = found.join(ranged.select("signer_a", "signer_b", F.col("row_id").alias("pair_row_id")), ["signer_a", "signer_b"])
    rows = rows.select("pair_row_id", "mint", "left_observation", "right_observation", (F.col("b_t") - F.col("a_t")).alias("delta_seconds"))
    return global_ordinal(rows, ["pair_row_id", "mint"])


def activity(obs: DataFrame) -> DataFrame:
    amount = lambda side: F.sum(F.when(F.col("side") == side, F.col("quote_amount").cast("decimal(38,0)")).otherwise(0))
    return obs.groupBy("signing_wallet").agg(
        F.count_if(F.col("side") == "BUY").alias("buy_rows"),
        F.count_if(F.col("side") == "SELL").alias("sell_rows"),
        F.count_distinct("mint").alias("mint_count"),
        F.min("block_ordinal").alias("first_block"),
        F.max("block_ordinal").alias("last_block"),
        amount("BUY").alias("quote_buy"),
        amount("SELL").alias("quote_sell"),
    )


def global_ordinal(df: DataFrame, order: list[str], name: str = "row_id", parts: int | None = None) -> DataFrame:
    """A gap-free ordinal in total order: range partitions, a local number and the partitions' offsets.

    The sorted partitions are written once and both steps read them, so that
    they agree on what a partition holds however often a task is run again.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # the partition and the place in it; both are taken in the same task
    local = stored(ranged.withColumn("_id", F.monotonically_increasing_id()), "ordinal")
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = local.groupBy(part.alias("_chunk")).agg(F.count("*").alias("_size"))
    # one row for each partition
    offset = sizes.select("_chunk", F.coalesce(F.sum("_size").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    return local.withColumn("_chunk", part).join(F.broadcast(offset), "_chunk").withColumn(name, (F.col("_offset") + place).cast("long")).drop("_chunk", "_id", "_offset")
