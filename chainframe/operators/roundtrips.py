"""Sniping: one round trip per launch, bought and sold after fixed delays from one shared wallet.

Own orders never change a venue's state, so when an order lands and what it
would get are joins against the clock and the venues' states.  What the wallet
can pay for depends on everything before: its actions are folded in order, one
wallet in a stream of its own that holds only the trips that are open.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pricing
from ..functions.exact import boundary
from ..sources.scratch import stored
from .clock import after_transactions, first_block_at
from .ordered import asof
from .replay import cooldown

STATUSES = (
    "COOLDOWN_SKIPPED", "BUY_REFERENCE_REJECTED", "BUY_PRE_SUBMIT_INSUFFICIENT_FUNDS", "BUY_LANDED_FAILED", "SELL_REFERENCE_UNAVAILABLE_OPEN",
    "SELL_PRE_SUBMIT_INSUFFICIENT_FUNDS_OPEN", "SELL_LANDED_FAILED_OPEN", "OPEN_AT_HORIZON", "CLOSED",
)


@dataclass(frozen=True)
class Terms:
    """What a run is configured with; amounts are atomic units of the quote asset."""

    budget: int
    opening: int
    cooldown_s: int
    buy_delay: int
    hold_s: int
    sell_delay: int
    buy_slippage_bps: int
    sell_slippage_bps: int
    buy_fee: int
    sell_fee: int
    mint_deposit: int
    wallet_deposit: int

    @property
    def reserved(self) -> int:
        """What a purchase sets aside, without the wallet's own deposit."""
        return self.budget + self.buy_fee + self.mint_deposit


def timed(launches: DataFrame, clock: DataFrame, terms: Terms) -> DataFrame:
    """Launches with ``buy_at``, ``decide_at`` and ``sell_at``; those whose path leaves the clock are outside the decision range and go."""
    bought = after_transactions(launches, clock, terms.buy_delay).withColumnRenamed("landing_block", "buy_block").withColumn("buy_at", boundary(F.col("buy_block"), F.col("landing_index"))).drop("landing_index")
    due = stored(bought.join(clock.select(F.col("block_ordinal").alias("buy_block"), (F.col("block_time_s") + terms.hold_s).alias("due")), "buy_block"), "due")
    decided = first_block_at(due, clock, "event_id", "due", "buy_block").where("found_block IS NOT NULL").drop("due", "buy_block", "block_ordinal", "transaction_index")
    decided = decided.withColumn("block_ordinal", F.col("found_block")).withColumn("transaction_index", F.lit(0).cast("long")).withColumn("decide_at", boundary(F.col("found_block"), F.lit(0))).drop("found_block")
    sold = after_transactions(decided, clock, terms.sell_delay)
    return sold.withColumn("sell_at", boundary(F.col("landing_block"), F.col("landing_index"))).drop("landing_block", "landing_index", "block_ordinal", "transaction_index")


def at_states(rows: DataFrame, states: DataFrame, key: str, places: dict[str, str], width: int | None = None) -> DataFrame:
    """``rows`` (with venue) and per name of ``places`` the struct of the venue's state at that column's place, in one as-of join.

    Before its first event a venue has its opening reserves.
    """
    probes = rows.select(key, "venue", F.explode(F.array(*(F.struct(F.lit(n).alias("what"), F.col(c).alias("at")) for n, c in places.items()))).alias("p")).select(key, "venue", "p.what", "p.at")
    found = asof(probes, states, ["venue"], "at", "state_at", ["vt", "vq", "lifecycle"], width=width)
    state = F.struct(F.coalesce("vt", F.lit(pricing.VIRTUAL_TOKEN)).alias("vt"), F.coalesce("vq", F.lit(pricing.VIRTUAL_QUOTE)).alias("vq"), F.coalesce("lifecycle", F.lit("ACTIVE")).alias("lifecycle"))
    wide = found.groupBy(key).agg(*(F.max(F.when(F.col("what") == n, state)).alias(n) for n in places))
    return rows.join(wide, key)


def buying(state: str, budget: int) -> Column:
    """struct(net, fees, out, ok) of a purchase on a state; a curve that is not active sells nothing."""
    s = F.col(state)
    q = pricing.buy_quote(F.lit(budget), s["vt"], s["vq"], s["vt"] - pricing.TOKEN_OFFSET)
    return F.struct(q["net"].alias("net"), q["fees"].alias("fees"), q["out"].alias("out"), (q["ok"] & (s["lifecycle"] == "ACTIVE")).alias("ok"))


def selling(tokens: Column, state: str, needs_active: bool = True) -> Column:
    """struct(net, ok) of a sale of all tokens."""
    s = F.col(state)
    q = pricing.sell_quote(tokens, s["vt"], s["vq"], s["vq"] - pricing.QUOTE_OFFSET)
    return F.struct(q["net"].alias("net"), (q["ok"] & (s["lifecycle"] == "ACTIVE") if needs_active else q["ok"]).alias("ok"))


def quoted(trips: DataFrame, states: DataFrame, terms: Terms, width: int | None = None) -> DataFrame:
    """The quotes of every trip, whatever the wallet will be able to pay for."""
    places = {"s_ref": "boundary", "s_buy": "buy_at", "s_decide": "decide_at", "s_sell": "sell_at"}
    rows = at_states(trips, states, "event_id", places, width)
    rows = rows.withColumn("ref", buying("s_ref", terms.budget)).withColumn("buy", buying("s_buy", terms.budget))
    rows = rows.withColumn("buy_ok", F.col("buy.ok") & (F.col("buy.out") >= pricing.minimum_output(F.col("ref.out"), terms.buy_slippage_bps)))
    rows = rows.withColumn("decide", selling(F.col("buy.out"), "s_decide")).withColumn("sell", selling(F.col("buy.out"), "s_sell"))
    sell_ok = F.col("sell.ok") & (F.col("sell.net") >= pricing.minimum_output(F.col("decide.net"), terms.sell_slippage_bps))
    return rows.select(
        "event_id", "venue", "wallet", "boundary", "buy_at", "decide_at", "sell_at",
        F.col("ref.ok").alias("ref_ok"), F.col("ref.out").cast("long").alias("reference"), F.col("buy.out").cast("long").alias("tokens"), (F.col("buy.net") + F.col("buy.fees")).cast("long").alias("spent"),
        F.coalesce("buy_ok", F.lit(False)).alias("buy_ok"), F.coalesce("decide.ok", F.lit(False)).alias("decide_ok"), F.coalesce(sell_ok, F.lit(False)).alias("sell_ok"), F.col("sell.net").cast("long").alias("proceeds"),
    )


#: Phases at one place: decisions to sell, launches, landings.
_KINDS = (("boundary", 45, "boundary"), ("buy_at", 60, "boundary"), ("decide_at", 40, "buy_at"), ("sell_at", 60, "decide_at"))
ACTION = "wallet long, at long, phase int, creator long, event_id long, kind int, spent long, buy_ok boolean, decide_ok boolean, sell_ok boolean, proceeds long"


def actions(quotes: DataFrame) -> DataFrame:
    """Four actions a trip in which the wallet may take part, in their order within a wallet."""
    each = F.explode(F.array(*(F.struct(F.col(at).alias("at"), F.lit(phase).alias("phase"), F.col(creator).alias("creator"), F.lit(k).alias("kind")) for k, (at, phase, creator) in enumerate(_KINDS)))).alias("a")
    rows = quotes.where("ref_ok").select("wallet", "event_id", "spent", "buy_ok", "decide_ok", "sell_ok", "proceeds", each)
    return rows.select("wallet", "a.at", "a.phase", "a.creator", "event_id", "a.kind", "spent", "buy_ok", "decide_ok", "sell_ok", "proceeds")


class Wallet:
    """The balance, the wallet's own account, and the trips that are open."""

    def __init__(self, terms: Terms):
        self.terms, self.available, self.has_account = terms, terms.opening, False
        self.open: dict[int, list[int]] = {}  # cash flow so far, deposit for the wallet's account reserved or paid

    def act(self, trip: int, kind: int, spent: int, buy_ok: bool, decide_ok: bool, sell_ok: bool, proceeds: int) -> tuple[str, int, int] | None:
        """(status, cash flow, locked deposit) once the trip is over for the wallet."""
        t = self.terms
        if kind == 0:
            own = 0 if self.has_account else t.wallet_deposit
            if t.reserved + own > self.available:
                return "BUY_PRE_SUBMIT_INSUFFICIENT_FUNDS", 0, 0
            self.available -= t.reserved + own
            self.open[trip] = [0, own]
            return None
        if trip not in self.open:
            return None
        state = self.open[trip]
        if kind == 1:
            reserved = t.reserved + state[1]
            if not buy_ok:
                self.available += reserved - t.buy_fee
                del self.open[trip]
                return "BUY_LANDED_FAILED", -t.buy_fee, 0
            state[1] = 0 if self.has_account else state[1]  # whoever fills first pays for the account
            self.has_account = self.has_account or state[1] > 0
            state[0] = -(spent + t.buy_fee + t.mint_deposit + state[1])
            self.available += reserved + state[0]
            return None
        if kind == 2:
            if decide_ok and t.sell_fee <= self.available:
                self.available -= t.sell_fee
                state[0] -= t.sell_fee
                return None
            del self.open[trip]
            return "SELL_PRE_SUBMIT_INSUFFICIENT_FUNDS_OPEN" if decide_ok else "SELL_REFERENCE_UNAVAILABLE_OPEN", state[0], state[1]
        del self.open[trip]
        if not sell_ok:
            return "SELL_LANDED_FAILED_OPEN", state[0], state[1]
        self.available += proceeds + t.mint_deposit
        return "CLOSED", state[0] + proceeds + t.mint_deposit, state[1]


def settled(acts: DataFrame, terms: Terms) -> DataFrame:
    """(event_id, status, cash, locked): the wallets' actions in order; a task streams through one wallet after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, wallet = None, Wallet(terms)
        for batch in batches:
            out = []
            names = [n for n in batch.schema.names if n not in ("at", "phase", "creator")]
            for owner, trip, *rest in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if owner != name:
                    name, wallet = owner, Wallet(terms)
                done = wallet.act(trip, *rest)
                if done:
                    out.append((trip, *done))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["event_id", "status", "cash", "locked"])

    ordered = acts.repartition("wallet").sortWithinPartitions("wallet", "at", "phase", "creator", "event_id")
    return ordered.mapInArrow(run, "event_id long, status string, cash long, locked long")


def final_states(states: DataFrame) -> DataFrame:
    """Per venue the last state, and the last one in which it was active."""
    state = F.struct("vt", "vq", "lifecycle")
    return states.groupBy("venue").agg(F.max_by(state, "state_at").alias("s_last"), F.max_by(state, F.when(F.col("lifecycle") == "ACTIVE", F.col("state_at"))).alias("s_active"))


def valued(trips: DataFrame, states: DataFrame, terms: Terms) -> DataFrame:
    """Adds realized, mtm_status, mtm_value, economic: what was earned, and what is still held is worth.

    A trip that still holds tokens is worth what its venue would pay at the
    end; after a migration what it would have paid last, if it ever was active.
    """
    ends = trips.join(final_states(states), "venue", "left")
    fresh = F.struct(F.lit(pricing.VIRTUAL_TOKEN).alias("vt"), F.lit(pricing.VIRTUAL_QUOTE).alias("vq"), F.lit("ACTIVE").alias("lifecycle"))
    ends = ends.withColumn("s_last", F.coalesce("s_last", fresh))
    ends = ends.withColumn("now", selling(F.col("tokens"), "s_last")).withColumn("then", selling(F.col("tokens"), "s_active", False))
    held = F.col("status").endswith("_OPEN") | (F.col("status") == "OPEN_AT_HORIZON")
    migrated = (F.col("s_last.lifecycle") == "MIGRATED") & F.coalesce("then.ok", F.lit(False))
    status = F.when(~held, "NOT_APPLICABLE").when(F.col("now.ok"), "EXECUTABLE").when(migrated, "STALE_PRE_MIGRATION").otherwise("UNAVAILABLE")
    ends = ends.withColumn("mtm_status", status)
    paid = F.when(F.col("mtm_status") == "EXECUTABLE", F.col("now.net")).when(F.col("mtm_status") == "STALE_PRE_MIGRATION", F.col("then.net"))
    ends = ends.withColumn("mtm_value", (paid - terms.sell_fee + terms.mint_deposit).cast("long")).withColumn("realized", F.when(~held, F.col("cash")))
    return ends.withColumn("economic", F.when(held, F.col("cash") + F.col("mtm_value") + F.col("locked")).otherwise(F.col("cash") + F.col("locked"))).drop("s_last", "s_active", "now", "then")


def snipe(launches: DataFrame, clock: DataFrame, states: DataFrame, terms: Terms, width: int | None = None) -> DataFrame:
    """One row per launch of the decision range, with its status and results.

    ``launches``: event_id, venue, developer, wallet, t, boundary, block_ordinal, transaction_index.
    """
    trips = stored(timed(launches, clock, terms), "trips")
    free = cooldown(trips.select("developer", "t", "event_id"), "developer", "t", terms.cooldown_s, "event_id").select("event_id", F.lit(True).alias("free"))
    taken = trips.join(free, "event_id", "left")
    quotes = stored(quoted(taken.where("free"), states, terms, width), "quotes")
    done = settled(actions(quotes), terms)
    known = quotes.select("event_id", "reference", "tokens", "ref_ok").join(done, "event_id", "left")
    rows = taken.select("event_id", "venue", "wallet", "boundary", "buy_at", "sell_at", "free").join(known, "event_id", "left")
    status = F.when(F.col("free").isNull(), "COOLDOWN_SKIPPED").when(~F.col("ref_ok"), "BUY_REFERENCE_REJECTED").otherwise(F.coalesce("status", F.lit("OPEN_AT_HORIZON")))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    bought = F.col("status").isin("CLOSED") | F.col("status").endswith("_OPEN")
    rows = rows.withColumn("status", status).select("event_id", "venue", "wallet", "boundary", "buy_at", "sell_at", F.when(F.col("ref_ok"), F.col("reference")).alias("reference"), F.when(bought, F.col("tokens")).alias("tokens"), "status", zero("cash"), zero("locked"))
    return valued(rows, states, terms)
