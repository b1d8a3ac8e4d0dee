"""Copy-buy: one position per venue after the first signal of a watched signer, with stop, take, holding time and up to four sales.

Decisions are made on what has been observed, which is the history some
transactions ago; orders land on the history as it is then.  Positions do not
meet, so every step is a join over all of them.  The wallet must cover all
positions at once (``most_needed``), so that no order can fail for funds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pricing
from ..functions.exact import boundary, boundary_block, boundary_transaction
from ..sources.scratch import stored
from .clock import after_transactions, first_block_at
from .guards import LimitExceeded
from .roundtrips import Terms, at_states, buying, selling, valued

#: Sales tried at most, and the wait before the next.
ATTEMPTS, RETRY_S = 4, 2


@dataclass(frozen=True)
class Policy:
    observation_delay: int
    stop_bps: int
    take_bps: int


def shifted(rows: DataFrame, clock: DataFrame, at: str, n: int, name: str) -> DataFrame:
    """``rows`` with the place ``n`` transactions after ``at``; rows whose place leaves the clock go."""
    if n == 0:
        return rows.withColumn(name, F.col(at))
    asked = rows.withColumn("block_ordinal", boundary_block(F.col(at))).withColumn("transaction_index", boundary_transaction(F.col(at)))
    moved = after_transactions(asked, clock, n)
    return moved.withColumn(name, boundary(F.col("landing_block"), F.col("landing_index"))).drop("block_ordinal", "transaction_index", "landing_block", "landing_index")


def after_seconds(rows: DataFrame, clock: DataFrame, at: str, seconds: int, name: str) -> DataFrame:
    """``rows`` (by event_id) with the start of the first later block with transactions that is ``seconds`` or more after the time of ``at``."""
    asked = stored(rows.withColumn("after", boundary_block(F.col(at))).join(clock.select(F.col("block_ordinal").alias("after"), (F.col("block_time_s") + seconds).alias("due")), "after"), "waits")
    found = first_block_at(asked, clock, "event_id", "due", "after").where("found_block IS NOT NULL")
    return found.withColumn(name, boundary(F.col("found_block"), F.lit(0))).drop("after", "due", "found_block")


def longest(rows: DataFrame, clock: DataFrame, terms: Terms, name: str) -> DataFrame:
    """``rows`` with the place where a position that is sold at its ``deadline`` has failed to sell for the last time; those whose path leaves the clock go."""
    rows = rows.withColumn("_at", F.col("deadline"))
    for attempt in range(ATTEMPTS):
        last = attempt + 1 == ATTEMPTS
        rows = shifted(rows, clock, "_at", terms.sell_delay, name if last else "_landed").drop("_at")
        if not last:
            rows = after_seconds(rows, clock, "_landed", RETRY_S, "_at").drop("_landed")
    return rows


def entries(signals: DataFrame, clock: DataFrame, terms: Terms, policy: Policy) -> DataFrame:
    """Per venue the first signal, if its longest path lies in the clock.

    If the first signal's path does not, no later one's does.
    """
    first = signals.groupBy("venue").agg(F.min(F.struct("boundary", "event_id")).alias("e")).select("venue", "e.*")
    rows = shifted(first, clock, "boundary", policy.observation_delay, "enter_at")
    rows = shifted(rows, clock, "enter_at", terms.buy_delay, "buy_at")
    rows = longest(after_seconds(rows, clock, "buy_at", terms.hold_s, "deadline"), clock, terms, "settled")
    return rows.select("venue", "boundary", "event_id", "enter_at", "buy_at", "deadline")


def most_needed(positions: DataFrame, terms: Terms) -> None:
    """Raise if the wallet could not pay for every position and all its sales."""
    n = positions.count()
    if n * (terms.reserved + ATTEMPTS * terms.sell_fee) + terms.wallet_deposit > terms.opening:
        raise LimitExceeded(f"{n} positions may need more than {terms.opening}")


def bought(positions: DataFrame, clock: DataFrame, states: DataFrame, terms: Terms, policy: Policy, width: int | None) -> DataFrame:
    """Positions with ``filled`` and what was got: quoted on the observed state, landed on the historical one."""
    rows = stored(shifted(positions, clock, "enter_at", -policy.observation_delay, "seen_at"), "placed")
    rows = at_states(rows, states, "event_id", {"s_ref": "seen_at", "s_buy": "buy_at"}, width)
    rows = rows.withColumn("ref", buying("s_ref", terms.budget)).withColumn("buy", buying("s_buy", terms.budget))
    enough = F.col("buy.out") >= pricing.minimum_output(F.col("ref.out"), terms.buy_slippage_bps)
    rows = rows.withColumn("submitted", F.col("ref.ok")).withColumn("filled", F.coalesce(F.col("ref.ok") & F.col("buy.ok") & enough, F.lit(False)))
    return rows.select("event_id", "venue", "boundary", "buy_at", "deadline", "submitted", "filled", F.col("buy.out").cast("long").alias("tokens"), F.col("buy.net").cast("long").alias("paid"), (F.col("buy.net") + F.col("buy.fees")).cast("long").alias("spent"))


def triggered(held: DataFrame, clock: DataFrame, states: DataFrame, policy: Policy, width: int | None) -> DataFrame:
    """``held`` with ``reason`` and ``decide_at``: stop before take before the deadline, on observed prices.

    A price that has been reached when the purchase lands is acted upon one
    transaction later.
    """

    def reason(s: str):
        price = lambda bps, up: pricing.price_reaches(F.col(s)["vq"], F.col(s)["vt"], F.col("paid"), F.col("tokens"), bps, up)
        active = F.col(s)["lifecycle"] == "ACTIVE"
        return F.when(active & price(policy.stop_bps, False), "STOP_LOSS").when(active & price(policy.take_bps, True), "TAKE_PROFIT")

    rows = shifted(held, clock, "buy_at", -policy.observation_delay, "seen_at")
    rows = shifted(stored(rows, "held"), clock, "buy_at", 1, "next_at")
    rows = stored(at_states(rows, states, "event_id", {"s_fill": "seen_at"}, width).withColumn("at_once", reason("s_fill")), "held")
    # a state is observed later than the fill if it is later than what had been observed by then
    later = states.join(rows.select("venue", "event_id", "seen_at", "paid", "tokens"), "venue").where("state_at > seen_at").withColumn("s", F.struct("vt", "vq", "lifecycle"))
    first = later.withColumn("reason", reason("s")).where("reason IS NOT NULL").groupBy("event_id").agg(F.min(F.struct("state_at", "reason")).alias("h"))
    hits = shifted(first.select("event_id", "h.state_at", F.col("h.reason").alias("by_price")), clock, "state_at", policy.observation_delay, "price_at").drop("state_at")
    out = rows.join(hits, "event_id", "left")
    in_time = F.col("price_at") < F.col("deadline")
    why = F.coalesce("at_once", F.when(in_time, F.col("by_price")), F.lit("MAXIMUM_HOLD"))
    when = F.when(F.col("at_once").isNotNull(), F.col("next_at")).when(in_time, F.col("price_at")).otherwise(F.col("deadline"))
    return out.select(*held.columns, why.alias("reason"), when.alias("decide_at"))


def sale(open_: DataFrame, clock: DataFrame, states: DataFrame, terms: Terms, policy: Policy, attempt: int, width: int | None) -> DataFrame:
    """One attempt of every open position: ``outcome`` REJECTED, FAILED or FILLED, ``ended_at`` where it was known, ``proceeds``."""
    rows = shifted(shifted(open_, clock, "decide_at", -policy.observation_delay, "seen_at"), clock, "decide_at", terms.sell_delay, "land_at")
    rows = at_states(stored(rows, "offers"), states, "event_id", {"s_ref": "seen_at", "s_land": "land_at"}, width)
    rows = rows.withColumn("ref", selling(F.col("tokens"), "s_ref")).withColumn("land", selling(F.col("tokens"), "s_land"))
    got = F.col("land.ok") & (F.col("land.net") >= pricing.minimum_output(F.col("ref.net"), terms.sell_slippage_bps))
    outcome = F.when(~F.col("ref.ok"), "REJECTED").when(got, "FILLED").otherwise("FAILED")
    ended = F.when(~F.col("ref.ok"), F.col("decide_at")).otherwise(F.col("land_at"))
    return rows.select(*open_.columns, F.lit(attempt).alias("attempt"), outcome.alias("outcome"), ended.alias("ended_at"), F.col("land.net").cast("long").alias("proceeds"))


def attempts(signals: DataFrame, clock: DataFrame, states: DataFrame, terms: Terms, policy: Policy, width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(positions, sales): the purchases, and every attempt to sell what they got."""
    placed = stored(entries(signals, clock, terms, policy), "entries")
    most_needed(placed, terms)
    positions = stored(bought(placed, clock, states, terms, policy, width), "bought")
    held = positions.where("filled").select("event_id", "venue", "buy_at", "deadline", "tokens", "paid")
    open_ = triggered(stored(held, "held"), clock, states, policy, width).select("event_id", "venue", "tokens", "reason", "decide_at")
    made = None
    for attempt in range(1, ATTEMPTS + 1):
        step = stored(sale(open_, clock, states, terms, policy, attempt, width), "sales")
        made = step if made is None else made.unionByName(step)
        open_ = after_seconds(step.where("outcome <> 'FILLED'"), clock, "ended_at", RETRY_S, "retry_at").select("event_id", "venue", "tokens", "reason", F.col("retry_at").alias("decide_at"))
    return positions, made


def results(positions: DataFrame, sales: DataFrame, states: DataFrame, terms: Terms) -> DataFrame:
    """Per position its status, attempts, cash flow and worth: CLOSED, EXHAUSTED or BUY_FAILED."""
    sold = sales.groupBy("event_id").agg(F.count("*").alias("attempts"), F.count_if(F.col("outcome") != "REJECTED").alias("landed"), F.max(F.when(F.col("outcome") == "FILLED", F.col("proceeds"))).alias("proceeds"), F.max("reason").alias("reason"))
    rows = positions.join(sold, "event_id", "left")
    status = F.when(~F.col("filled"), "BUY_FAILED").when(F.col("proceeds").isNotNull(), "CLOSED").otherwise("EXHAUSTED")
    # the wallet's account is paid by whoever fills first
    first = positions.where("filled").agg(F.min(F.struct("buy_at", "boundary", "event_id")).alias("f")).select(F.col("f.event_id").alias("event_id"), F.lit(terms.wallet_deposit).cast("long").alias("locked"))
    rows = rows.join(first, "event_id", "left").withColumn("locked", F.coalesce("locked", F.lit(0).cast("long"))).withColumn("status", status)
    paid = F.when(F.col("filled"), -(F.col("spent") + terms.buy_fee + terms.mint_deposit) - F.col("locked")).when(F.col("submitted"), -F.lit(terms.buy_fee)).otherwise(0)
    fees = F.coalesce("landed", F.lit(0)) * terms.sell_fee
    cash = paid - fees + F.when(F.col("status") == "CLOSED", F.col("proceeds") + terms.mint_deposit).otherwise(0)
    held = F.when(F.col("status") == "EXHAUSTED", "EXHAUSTED_OPEN").otherwise(F.col("status"))
    rows = rows.select("event_id", "venue", "status", "reason", F.coalesce("attempts", F.lit(0)).alias("attempts"), "tokens", cash.cast("long").alias("cash"), "locked", held.alias("held"))
    worth = valued(rows.withColumnRenamed("status", "ended").withColumnRenamed("held", "status"), states, terms)
    return worth.select("event_id", "venue", F.col("ended").alias("status"), "reason", "attempts", "cash", "realized", "mtm_status", "mtm_value", "economic")
