"""Stateful replay and event-time queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pricing
from ..functions.exact import boundary
from ..operators import copying, replay, roundtrips
from ..operators.clock import after_transactions, first_block_at
from ..operators.ordered import asof
from ..operators.research import global_ordinal
from ..operators.roundtrips import Terms
from ..sources.adapters import RANGE, Tables
from ..sources.scratch import scratch, stored
from ..sources.sinks import publish
from .registry import query

COOLDOWN = 21_600
TERMS = Terms(budget=20_000, opening=20_000_000, cooldown_s=COOLDOWN, buy_delay=5, hold_s=120, sell_delay=3, buy_slippage_bps=0, sell_slippage_bps=0, buy_fee=7_000, sell_fee=6_000, mint_deposit=2_039_280, wallet_deposit=1_844_400)
WALLETS = 8

_COOL = f"""WITH RECURSIVE l AS (SELECT event_id, developer, venue, boundary, block_ordinal, transaction_index, t, row_number() OVER (PARTITION BY developer ORDER BY t, event_id) AS rn FROM launches),
 nx AS (SELECT a.event_id, min(b.rn) AS nrn, a.developer FROM l a JOIN l b ON a.developer = b.developer AND b.t >= a.t + {COOLDOWN} AND b.rn > a.rn GROUP BY a.event_id, a.developer),
 acc(event_id, developer) AS (SELECT event_id, developer FROM l WHERE rn = 1 UNION ALL SELECT l.event_id, l.developer FROM acc JOIN nx ON nx.event_id = acc.event_id JOIN l ON l.developer = nx.developer AND l.rn = nx.nrn)"""


@query("filter_cooldown", f"{_COOL} SELECT event_id, developer FROM acc")
def filter_cooldown(t: Tables) -> DataFrame:
    return replay.cooldown(t.launches, "developer", "t", COOLDOWN, "event_id").select("event_id", "developer")


_TX = "SELECT p.event_id, c2.block_ordinal AS landing_block, p.transaction_index + c.prefix + {n} - c2.prefix AS landing_index FROM {src} p JOIN clock c USING (block_ordinal) JOIN clock c2 ON c2.prefix <= c.prefix + p.transaction_index + {n} AND c.prefix + p.transaction_index + {n} < c2.prefix + c2.transaction_count"


@query("join_forward_tx", _TX.format(n=500, src="launches"))
def join_forward_tx(t: Tables) -> DataFrame:
    return after_transactions(t.launches.select("event_id", "block_ordinal", "transaction_index"), t.clock, 500).select("event_id", "landing_block", "landing_index")


@query("st_tx_delay", _TX.format(n=3, src="trades"))
def st_tx_delay(t: Tables) -> DataFrame:
    return after_transactions(t.trades.select("event_id", "block_ordinal", "transaction_index"), t.clock, 3).select("event_id", "landing_block", "landing_index")


_FIRST = "SELECT l.event_id, min(c.block_ordinal) AS found_block FROM {src} l LEFT JOIN clock c ON c.transaction_count > 0 AND c.block_ordinal > l.block_ordinal AND c.block_time_s >= l.t + {s} GROUP BY 1"


@query("join_forward_block_time", _FIRST.format(src="launches", s=2))
def join_forward_block_time(t: Tables) -> DataFrame:
    return first_block_at(t.launches.select("event_id", "block_ordinal", (F.col("t") + 2).alias("due")), t.clock, "event_id", "due", "block_ordinal").select("event_id", "found_block")


@query("st_holding_deadline", _FIRST.format(src="(SELECT * FROM trades WHERE side = 'BUY')", s=900))
def st_holding_deadline(t: Tables) -> DataFrame:
    buys = t.trades.where("side = 'BUY'").select("event_id", "block_ordinal", (F.col("t") + 900).alias("due"))
    return first_block_at(buys, t.clock, "event_id", "due", "block_ordinal").select("event_id", "found_block")


_DELAYED = "SELECT t.event_id, min(c.block_ordinal) AS release_block FROM trades t LEFT JOIN clock c ON c.transaction_count > 0 AND c.block_ordinal >= t.block_ordinal + 3 GROUP BY 1"


def _released(t: Tables) -> DataFrame:
    rows = t.trades.select("event_id", (F.col("block_ordinal") + 2).alias("after"), ((F.col("block_ordinal") + 3) * 60).alias("due"))
    return first_block_at(rows, t.clock, "event_id", "due", "after").select("event_id", F.col("found_block").alias("release_block"))


@query("st_observation_delay", _DELAYED)
def st_observation_delay(t: Tables) -> DataFrame:
    return _released(t)


@query("join_forward_boundary", f"SELECT event_id, release_block << 32 AS release FROM ({_DELAYED}) WHERE release_block IS NOT NULL")
def join_forward_boundary(t: Tables) -> DataFrame:
    return _released(t).where("release_block IS NOT NULL").select("event_id", F.shiftleft("release_block", 32).alias("release"))


@query("st_materialized_delivery", f"SELECT event_id, release_block << 32 AS release, true AS verified FROM ({_DELAYED}) WHERE release_block IS NOT NULL")
def st_materialized_delivery(t: Tables) -> DataFrame:
    """A published delivery table merged with the history: every release is found again on another way, the next block with transactions as of the third one after the event."""
    rows = _released(t).where("release_block IS NOT NULL").select("event_id", F.shiftleft("release_block", 32).alias("release"))
    published = publish(rows, scratch(t.spark, "delivery"), ["release", "event_id"])
    busy = t.clock.where("transaction_count > 0").select(F.col("block_ordinal").alias("b"), F.col("block_ordinal").alias("next_block"))
    trades = t.trades.select("event_id", (F.col("block_ordinal") + 3).alias("from_block"))
    expected = asof(trades.select("from_block").distinct(), busy, [], "from_block", "b", ["next_block"], forward=True, width=4096)
    return published.join(trades.join(expected, "from_block"), "event_id").select("event_id", "release", (F.col("release") == F.shiftleft("next_block", 32)).alias("verified"))


MOST_IN_GROUP = 10_000


@query("st_group_atomic", "SELECT block_ordinal, count(*) AS n, arg_max(event_id, (boundary, event_id)) AS last_event FROM trades GROUP BY 1")
def st_group_atomic(t: Tables) -> DataFrame:
    """Groups are applied as a whole; one with more than 10,000 events is refused."""
    groups = t.trades.groupBy("block_ordinal").agg(F.count("*").alias("n"), F.max_by("event_id", F.struct("boundary", "event_id")).alias("last_event"))
    small = F.col("n") <= MOST_IN_GROUP
    return groups.withColumn("n", F.when(small, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("a group of events too large: "), F.col("n").cast("string"))).cast("long")))


_FRONTS = f"""SELECT event_id, 10 AS phase, boundary AS release, boundary AS creator FROM trades UNION ALL SELECT d.event_id, 30, release_block << 32, t.boundary FROM ({_DELAYED}) d JOIN trades t USING (event_id) WHERE release_block IS NOT NULL
 UNION ALL SELECT x.event_id, 60, (landing_block << 32) + landing_index + 1, t.boundary FROM ({_TX.format(n=3, src='trades')}) x JOIN trades t USING (event_id)"""


@query("st_phase_scheduler", f"SELECT event_id, phase, release, row_number() OVER (ORDER BY release, phase, creator, event_id) - 1 AS turn FROM ({_FRONTS})")
def st_phase_scheduler(t: Tables) -> DataFrame:
    """History, observations and landings as one queue: by release, then phase, then who made it, then id."""
    s = t.stored_events()
    history = s.trades.select("event_id", F.lit(10).alias("phase"), F.col("boundary").alias("release"), F.col("boundary").alias("creator"))
    seen = _released(s).where("release_block IS NOT NULL").join(s.trades.select("event_id", F.col("boundary").alias("creator")), "event_id").select("event_id", F.lit(30).alias("phase"), F.shiftleft("release_block", 32).alias("release"), "creator")
    landed = after_transactions(s.trades.select("event_id", "block_ordinal", "transaction_index", F.col("boundary").alias("creator")), s.clock, 3)
    landed = landed.select("event_id", F.lit(60).alias("phase"), boundary(F.col("landing_block"), F.col("landing_index")).alias("release"), "creator")
    queue = history.unionByName(seen).unionByName(landed)
    return global_ordinal(queue, ["release", "phase", "creator", "event_id"], "turn").select("event_id", "phase", "release", "turn")


@query("st_next_eligible", "SELECT event_id, greatest(boundary, ((block_ordinal) << 32) + 2) AS eligible FROM trades")
def st_next_eligible(t: Tables) -> DataFrame:
    return t.trades.select("event_id", F.greatest("boundary", F.shiftleft("block_ordinal", 32) + 2).alias("eligible"))


_POOL = f"""SELECT l.event_id, coalesce(h.vq, {pricing.VIRTUAL_QUOTE}) AS historical_vq, coalesce(o.vq, {pricing.VIRTUAL_QUOTE}) AS observed_vq,
 CASE WHEN coalesce(h.lifecycle, 'ACTIVE') = 'ACTIVE' THEN coalesce(h.vq, {pricing.VIRTUAL_QUOTE}) + 987654 ELSE h.vq END AS simulated_vq
 FROM launches l ASOF LEFT JOIN states h ON l.venue = h.venue AND l.boundary >= h.state_at ASOF LEFT JOIN states o ON l.venue = o.venue AND ((l.block_ordinal - 3) << 32) + 4294967295 >= o.state_at"""


@query("st_pool_state", _POOL)
def st_pool_state(t: Tables) -> DataFrame:
    """Three states of a launch's venue: as it is, as it was observed three blocks ago, and with an own purchase of 987,654 on top, which lasts until the next event."""
    l = t.launches.withColumn("seen", F.shiftleft(F.col("block_ordinal") - 3, 32) + 4294967295)  # noqa: E741
    rows = roundtrips.at_states(l, t.states, "event_id", {"historical": "boundary", "observed": "seen"}, RANGE)
    own = F.when(F.col("historical.lifecycle") == "ACTIVE", F.col("historical.vq") + 987_654).otherwise(F.col("historical.vq"))
    return rows.select("event_id", F.col("historical.vq").alias("historical_vq"), F.col("observed.vq").alias("observed_vq"), own.alias("simulated_vq"))


@query("st_curve_state", """SELECT s.venue, arg_max(lifecycle, state_at) AS lifecycle, arg_max(vt, state_at) AS vt, arg_max(vq, state_at) AS vq, arg_max(vq, state_at) FILTER (WHERE lifecycle = 'ACTIVE') AS last_active_vq,
 count(*) AS states, CAST(0 AS BIGINT) AS invalid FROM states s GROUP BY 1""")
def st_curve_state(t: Tables) -> DataFrame:
    """Per venue where its curve has come to; ``invalid`` counts states that no allowed step leads to."""
    ends = roundtrips.final_states(t.states).select("venue", "s_last.lifecycle", "s_last.vt", "s_last.vq", F.col("s_active.vq").alias("last_active_vq"))
    bad = replay.transition_errors(t.states).groupBy("venue").agg(F.count("*").alias("invalid"))
    return ends.join(t.states.groupBy("venue").agg(F.count("*").alias("states")), "venue").join(bad, "venue", "left").withColumn("invalid", F.coalesce("invalid", F.lit(0)).cast("long"))


MOST_AT_RISK, FEE_BPS = 9_000_000_000, 30
_REFERENCE = f"""WITH s AS (SELECT venue, event_id, block_ordinal, amount * 1000000 AS tokens FROM trades WHERE side = 'SELL' QUALIFY row_number() OVER (PARTITION BY venue ORDER BY boundary, event_id) = 1),
 r AS (SELECT s.*, (SELECT min(c.block_ordinal) FROM clock c WHERE c.transaction_count > 0 AND c.block_ordinal >= s.block_ordinal + 3) AS seen FROM s),
 x AS (SELECT r.*, (SELECT min(c.block_ordinal) FROM clock c WHERE c.transaction_count > 0 AND c.block_ordinal > r.seen) AS executes FROM r),
 q AS (SELECT x.*, (coalesce(executes, 0) << 32) + 1 AS place, tokens - tokens * {FEE_BPS} // 10000 AS eff FROM x),
 z AS (SELECT q.*, {{state}} FROM q ASOF LEFT JOIN states a ON q.venue = a.venue AND q.place >= a.state_at),
 o AS (SELECT *, CASE WHEN seen IS NULL THEN 'OBSERVATION_OUTSIDE_HORIZON' WHEN executes IS NULL THEN 'HORIZON_EXHAUSTED' WHEN tokens > {MOST_AT_RISK} THEN 'RISK_REJECTED' ELSE 'EXECUTED' END AS status FROM z)
 SELECT venue, event_id, status, executes, CASE WHEN status = 'EXECUTED' THEN CAST((a_vq * eff) // (a_vt + eff) AS BIGINT) END AS received FROM o"""


def _reference_sql() -> str:
    return _REFERENCE.replace("{state}", f"coalesce(a.vt, {pricing.VIRTUAL_TOKEN})::HUGEINT AS a_vt, coalesce(a.vq, {pricing.VIRTUAL_QUOTE})::HUGEINT AS a_vq")


@query("st_reference_engine", _reference_sql())
def st_reference_engine(t: Tables) -> DataFrame:
    """One order per venue, sold after its first swap has been observed.

    Observed three blocks later (30), decided (40), refused beyond the limit or
    without a later block (50), executed in the next block with transactions
    after history was applied there (10, 60).
    """
    s = t.stored_events()
    first = s.trades.where("side = 'SELL'").groupBy("venue").agg(F.min(F.struct("boundary", "event_id", "block_ordinal", "amount")).alias("f"))
    orders = first.select("venue", "f.event_id", F.col("f.block_ordinal").alias("block_ordinal"), (F.col("f.amount") * 1_000_000).alias("tokens"))
    orders = orders.withColumn("after", F.col("block_ordinal") + 2).withColumn("due", (F.col("block_ordinal") + 3) * 60)
    seen = stored(first_block_at(stored(orders, "orders"), s.clock, "event_id", "due", "after").select("venue", "event_id", "tokens", F.col("found_block").alias("seen")), "seen")
    asked = stored(seen.where("seen IS NOT NULL").select("event_id", F.col("seen").alias("after"), (F.col("seen") * 60 + 1).alias("due")), "asked")
    placed = seen.join(first_block_at(asked, s.clock, "event_id", "due", "after").select("event_id", F.col("found_block").alias("executes")), "event_id", "left")
    rows = roundtrips.at_states(placed.withColumn("place", F.shiftleft(F.coalesce("executes", F.lit(0).cast("long")), 32) + 1), s.states, "event_id", {"state": "place"}, RANGE)
    status = F.when(F.col("seen").isNull(), "OBSERVATION_OUTSIDE_HORIZON").when(F.col("executes").isNull(), "HORIZON_EXHAUSTED").when(F.col("tokens") > MOST_AT_RISK, "RISK_REJECTED").otherwise("EXECUTED")
    got = pricing.constant_product(F.col("tokens"), F.col("state.vt"), F.col("state.vq"), FEE_BPS)["out"].cast("long")
    return rows.withColumn("status", status).select("venue", "event_id", "status", "executes", F.when(F.col("status") == "EXECUTED", got).alias("received"))


# --- sniping ------------------------------------------------------------------------------------------------------------
def _buy_sql(budget: int) -> tuple[int, int, int]:
    """Net amount, what of it moves the curve, and net plus fees, of a purchase."""
    first = budget * 10_000 // 10_125
    fees = lambda n: -(-n * 95 // 10_000) + -(-n * 30 // 10_000)
    net = first - max(0, first + fees(first) - budget)
    return net, max(0, net - 1), net + fees(net)


_NET, _MOVES, _SPENT = _buy_sql(TERMS.budget)


def _state(s: str) -> str:
    """The columns of a state, or of a fresh curve."""
    return f"coalesce({s}.vt, {pricing.VIRTUAL_TOKEN})::HUGEINT AS {s}_vt, coalesce({s}.vq, {pricing.VIRTUAL_QUOTE})::HUGEINT AS {s}_vq, coalesce({s}.lifecycle, 'ACTIVE') AS {s}_l"


def _out(s: str) -> str:
    return f"({_MOVES}::HUGEINT * {s}_vt) // ({s}_vq + {_MOVES})"


def _buys(s: str) -> str:
    return f"({s}_l = 'ACTIVE' AND {_out(s)} > 0 AND {_out(s)} < {s}_vt AND {_out(s)} <= {s}_vt - {pricing.TOKEN_OFFSET})"


def _gross(tokens: str, vt: str, vq: str) -> str:
    return f"(({tokens}::HUGEINT * {vq}) // ({vt} + {tokens}))"


def _net(tokens: str, vt: str, vq: str) -> str:
    g = _gross(tokens, vt, vq)
    return f"({g} - ({g} * 95 + 9999) // 10000 - ({g} * 30 + 9999) // 10000)"


def _sells(tokens: str, vt: str, vq: str, lifecycle: str | None) -> str:
    ok = f"{_gross(tokens, vt, vq)} <= {vq} - {pricing.QUOTE_OFFSET} AND {_net(tokens, vt, vq)} > 0"
    return f"({ok}" + (f" AND {lifecycle} = 'ACTIVE')" if lifecycle else ")")


def _place(block: str, g: str, prefix: str) -> str:
    return f"({block} << 32) + {g} - {prefix} + 1"


_ENDS = """en AS (SELECT venue, arg_max(vt, state_at)::HUGEINT AS vt, arg_max(vq, state_at)::HUGEINT AS vq, arg_max(lifecycle, state_at) AS lifecycle,
 (arg_max(vt, state_at) FILTER (WHERE lifecycle = 'ACTIVE'))::HUGEINT AS avt, (arg_max(vq, state_at) FILTER (WHERE lifecycle = 'ACTIVE'))::HUGEINT AS avq FROM states GROUP BY 1)"""


def _worth(tokens: str, e: str = "en") -> tuple[str, str]:
    """(status, value) of tokens that are still held, from the venue's last states."""
    vt, vq, life = f"coalesce({e}.vt, {pricing.VIRTUAL_TOKEN})", f"coalesce({e}.vq, {pricing.VIRTUAL_QUOTE})", f"coalesce({e}.lifecycle, 'ACTIVE')"
    now, then = _sells(tokens, vt, vq, life), f"({life} = 'MIGRATED' AND coalesce({_sells(tokens, f'{e}.avt', f'{e}.avq', None)}, false))"
    more = TERMS.mint_deposit - TERMS.sell_fee
    status = f"CASE WHEN {now} THEN 'EXECUTABLE' WHEN {then} THEN 'STALE_PRE_MIGRATION' ELSE 'UNAVAILABLE' END"
    return status, f"CASE WHEN {now} THEN {_net(tokens, vt, vq)} + {more} WHEN {then} THEN {_net(tokens, f'{e}.avt', f'{e}.avq')} + {more} END"


_RESERVED = TERMS.reserved
_MTM, _VALUE = _worth("f.tokens")
_HELD = "(f.status LIKE 'SELL%OPEN')"
_SNIPE = f"""WITH RECURSIVE tl AS (SELECT l.event_id, l.developer, l.developer % {WALLETS} AS wallet, l.venue, l.t, l.boundary, c.prefix + l.transaction_index + {TERMS.buy_delay} AS g FROM launches l JOIN clock c USING (block_ordinal)),
 tb AS (SELECT tl.*, c.block_ordinal AS bb, {_place('c.block_ordinal', 'g', 'c.prefix')} AS buy_at FROM tl JOIN clock c ON c.prefix <= g AND g < c.prefix + c.transaction_count),
 td AS (SELECT tb.event_id, min(c.block_ordinal) AS db FROM tb JOIN clock c ON c.transaction_count > 0 AND c.block_ordinal > bb AND c.block_time_s >= bb * 60 + {TERMS.hold_s} GROUP BY 1),
 tr AS (SELECT tb.*, (db << 32) + 1 AS decide_at, {_place('c2.block_ordinal', f'c1.prefix + {TERMS.sell_delay}', 'c2.prefix')} AS sell_at FROM tb JOIN td USING (event_id) JOIN clock c1 ON c1.block_ordinal = db
  JOIN clock c2 ON c2.prefix <= c1.prefix + {TERMS.sell_delay} AND c1.prefix + {TERMS.sell_delay} < c2.prefix + c2.transaction_count),
 l AS (SELECT event_id, developer, t, row_number() OVER (PARTITION BY developer ORDER BY t, event_id) AS rn FROM tr),
 nx AS (SELECT a.event_id, min(b.rn) AS nrn, a.developer FROM l a JOIN l b ON a.developer = b.developer AND b.t >= a.t + {COOLDOWN} AND b.rn > a.rn GROUP BY a.event_id, a.developer),
 acc(event_id, developer) AS (SELECT event_id, developer FROM l WHERE rn = 1 UNION ALL SELECT l.event_id, l.developer FROM acc JOIN nx ON nx.event_id = acc.event_id JOIN l ON l.developer = nx.developer AND l.rn = nx.nrn),
 q0 AS (SELECT tr.*, {_state('a')} FROM tr JOIN acc USING (event_id) ASOF LEFT JOIN states a ON tr.venue = a.venue AND tr.boundary >= a.state_at),
 q1 AS (SELECT q0.*, {_state('b')} FROM q0 ASOF LEFT JOIN states b ON q0.venue = b.venue AND q0.buy_at >= b.state_at),
 q2 AS (SELECT q1.*, {_state('c')} FROM q1 ASOF LEFT JOIN states c ON q1.venue = c.venue AND q1.decide_at >= c.state_at),
 q3 AS (SELECT q2.*, {_state('d')} FROM q2 ASOF LEFT JOIN states d ON q2.venue = d.venue AND q2.sell_at >= d.state_at),
 q AS MATERIALIZED (SELECT event_id, venue, wallet, boundary, buy_at, decide_at, sell_at, {_buys('a')} AS ref_ok, {_out('a')} AS reference, {_out('b')} AS tokens, {_buys('b')} AND {_out('b')} >= {_out('a')} AS buy_ok,
  {_sells(_out('b'), 'c_vt', 'c_vq', 'c_l')} AS decide_ok, {_sells(_out('b'), 'd_vt', 'd_vq', 'd_l')} AND {_net(_out('b'), 'd_vt', 'd_vq')} >= {_net(_out('b'), 'c_vt', 'c_vq')} AS sell_ok, CAST({_net(_out('b'), 'd_vt', 'd_vq')} AS BIGINT) AS proceeds FROM q3),
 ev4 AS (SELECT event_id, wallet, buy_ok, decide_ok, sell_ok, proceeds, unnest([0, 1, 2, 3]) AS kind, unnest([boundary, buy_at, decide_at, sell_at]) AS place, unnest([45, 60, 40, 60]) AS phase, unnest([boundary, boundary, buy_at, decide_at]) AS creator FROM q WHERE ref_ok),
 e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY place, phase, creator, event_id) AS rn FROM ev4),
 w(wallet, rn, id, avail, acct, bare, full_, held, selling, payer, ended) AS (
  SELECT DISTINCT wallet, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST({TERMS.opening} AS BIGINT), false, CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM e
  UNION ALL
  SELECT wallet, rn, id, avail - CASE
    WHEN kind = 0 AND need <= avail THEN need
    WHEN kind = 1 AND mine THEN CASE WHEN NOT buy_ok THEN {TERMS.buy_fee} - ({_RESERVED} + own) ELSE {_SPENT + TERMS.buy_fee + TERMS.mint_deposit} + CASE WHEN acct THEN 0 ELSE own END - ({_RESERVED} + own) END
    WHEN kind = 2 AND list_contains(held, id) AND decide_ok AND avail >= {TERMS.sell_fee} THEN {TERMS.sell_fee}
    WHEN kind = 3 AND list_contains(selling, id) AND sell_ok THEN -(proceeds + {TERMS.mint_deposit}) ELSE 0 END,
   acct OR (kind = 1 AND own > 0 AND buy_ok),
   CASE WHEN kind = 0 AND acct AND need <= avail THEN list_append(bare, id) WHEN kind = 1 THEN list_filter(bare, lambda x: x <> id) ELSE bare END,
   CASE WHEN kind = 0 AND NOT acct AND need <= avail THEN list_append(full_, id) WHEN kind = 1 THEN list_filter(full_, lambda x: x <> id) ELSE full_ END,
   CASE WHEN kind = 1 AND mine AND buy_ok THEN list_append(held, id) WHEN kind = 2 THEN list_filter(held, lambda x: x <> id) ELSE held END,
   CASE WHEN kind = 2 AND list_contains(held, id) AND decide_ok AND avail >= {TERMS.sell_fee} THEN list_append(selling, id) WHEN kind = 3 THEN list_filter(selling, lambda x: x <> id) ELSE selling END,
   CASE WHEN kind = 1 AND own > 0 AND buy_ok AND NOT acct THEN id ELSE payer END,
   CASE WHEN kind = 0 AND need > avail THEN 'BUY_PRE_SUBMIT_INSUFFICIENT_FUNDS' WHEN kind = 1 AND mine AND NOT buy_ok THEN 'BUY_LANDED_FAILED'
    WHEN kind = 2 AND list_contains(held, id) AND NOT decide_ok THEN 'SELL_REFERENCE_UNAVAILABLE_OPEN' WHEN kind = 2 AND list_contains(held, id) AND avail < {TERMS.sell_fee} THEN 'SELL_PRE_SUBMIT_INSUFFICIENT_FUNDS_OPEN'
    WHEN kind = 3 AND list_contains(selling, id) AND NOT sell_ok THEN 'SELL_LANDED_FAILED_OPEN' WHEN kind = 3 AND list_contains(selling, id) THEN 'CLOSED' END
  FROM (SELECT w.wallet, e.rn, e.event_id AS id, avail, acct, bare, full_, held, selling, payer, kind, buy_ok, decide_ok, sell_ok, proceeds, {_RESERVED} + CASE WHEN acct THEN 0 ELSE {TERMS.wallet_deposit} END AS need,
   list_contains(bare, e.event_id) OR list_contains(full_, e.event_id) AS mine, CASE WHEN list_contains(full_, e.event_id) THEN {TERMS.wallet_deposit} ELSE 0 END AS own FROM w JOIN e ON e.wallet = w.wallet AND e.rn = w.rn + 1) s),
 f AS (SELECT tr.event_id, tr.venue, tr.wallet, CASE WHEN q.ref_ok THEN CAST(q.reference AS BIGINT) END AS reference, CAST(q.tokens AS BIGINT) AS tokens, coalesce(w.payer = tr.event_id, false) AS paid,
  CASE WHEN q.event_id IS NULL THEN 'COOLDOWN_SKIPPED' WHEN NOT q.ref_ok THEN 'BUY_REFERENCE_REJECTED' ELSE coalesce(w.ended, 'OPEN_AT_HORIZON') END AS status, q.proceeds FROM tr LEFT JOIN q USING (event_id) LEFT JOIN w ON w.id = tr.event_id AND w.ended IS NOT NULL),
 {_ENDS},
 g AS (SELECT f.*, CASE WHEN paid AND status <> 'BUY_LANDED_FAILED' THEN {TERMS.wallet_deposit} ELSE 0 END AS locked, CASE WHEN status = 'BUY_LANDED_FAILED' THEN -{TERMS.buy_fee} WHEN status = 'CLOSED' OR {_HELD} THEN
   -{_SPENT + TERMS.buy_fee + TERMS.mint_deposit} - CASE WHEN paid THEN {TERMS.wallet_deposit} ELSE 0 END - CASE WHEN status IN ('CLOSED', 'SELL_LANDED_FAILED_OPEN') THEN {TERMS.sell_fee} ELSE 0 END + CASE WHEN status = 'CLOSED' THEN proceeds + {TERMS.mint_deposit} ELSE 0 END ELSE 0 END AS cash,
  CASE WHEN {_HELD} THEN {_MTM} ELSE 'NOT_APPLICABLE' END AS mtm_status, CASE WHEN {_HELD} THEN CAST({_VALUE} AS BIGINT) END AS mtm_value FROM f LEFT JOIN en USING (venue)),
 trips AS (SELECT event_id AS roundtrip_id, venue, wallet, status, reference, CASE WHEN status = 'CLOSED' OR status LIKE 'SELL%OPEN' THEN tokens END AS tokens, CASE WHEN status NOT LIKE 'SELL%OPEN' THEN CAST(cash AS BIGINT) END AS realized, mtm_status, mtm_value,
  CAST(CASE WHEN status LIKE 'SELL%OPEN' THEN cash + mtm_value + locked ELSE cash + locked END AS BIGINT) AS economic, CAST(locked AS BIGINT) AS locked FROM g)"""


def _trips(t: Tables) -> DataFrame:
    """Launches with one wallet for every eighth developer; a wallet's run does not see the others'."""
    s = t.stored_events()
    launches = s.launches.select("event_id", "venue", "developer", (F.col("developer") % WALLETS).alias("wallet"), "t", "boundary", "block_ordinal", "transaction_index")
    return roundtrips.snipe(launches, s.clock, s.states, TERMS, RANGE).withColumnRenamed("event_id", "roundtrip_id")


_TRIP = ["roundtrip_id", "venue", "wallet", "status", "reference", "tokens", "realized", "mtm_status", "mtm_value", "economic"]


@query("st_sniping_engine", f"{_SNIPE} SELECT {', '.join(_TRIP)} FROM trips")
def st_sniping_engine(t: Tables) -> DataFrame:
    return _trips(t).select(*_TRIP)


@query("st_round_trip_status", f"{_SNIPE} SELECT status, count(*) AS n FROM trips GROUP BY 1")
def st_round_trip_status(t: Tables) -> DataFrame:
    return _trips(t).groupBy("status").agg(F.count("*").alias("n"))


@query("st_mtm_valuation", f"{_SNIPE} SELECT roundtrip_id, tokens, mtm_status, mtm_value FROM trips WHERE mtm_status <> 'NOT_APPLICABLE'")
def st_mtm_valuation(t: Tables) -> DataFrame:
    return _trips(t).where("mtm_status <> 'NOT_APPLICABLE'").select("roundtrip_id", "tokens", "mtm_status", "mtm_value")


@query("st_wallet_accounts", f"""{_SNIPE} SELECT wallet, count(*) FILTER (WHERE tokens IS NOT NULL) AS created, count(*) FILTER (WHERE status = 'CLOSED') AS refunded, count(*) FILTER (WHERE status LIKE 'SELL%OPEN') AS locked,
 count(*) FILTER (WHERE status = 'BUY_LANDED_FAILED') AS released, max(roundtrip_id) FILTER (WHERE locked > 0) AS account_paid_by FROM trips GROUP BY 1""")
def st_wallet_accounts(t: Tables) -> DataFrame:
    """Per wallet: accounts of tokens that were created, refunded by a sale, are locked still, or were released unpaid; and the trip that paid for the wallet's own."""
    over = lambda s: F.count_if(F.col("status") == s)
    return _trips(t).groupBy("wallet").agg(F.count("tokens").alias("created"), over("CLOSED").alias("refunded"), F.count_if(F.col("status").like("SELL%OPEN")).alias("locked"), over("BUY_LANDED_FAILED").alias("released"), F.max(F.when(F.col("locked") > 0, F.col("roundtrip_id"))).alias("account_paid_by"))


# --- copy-buy -----------------------------------------------------------------------------------------------------------
POLICY = copying.Policy(observation_delay=4, stop_bps=1, take_bps=1)
COPY_TERMS = replace(TERMS, opening=100_000_000, hold_s=86_400)


def _move(name: str, source: str, at: str, n: int, out: str) -> str:
    """A place n transactions further."""
    g = f"c.prefix + ({at} & 4294967295) - 1 + {n}"
    return f"{name} AS (SELECT x.*, {_place('c2.block_ordinal', g, 'c2.prefix')} AS {out} FROM {source} x JOIN clock c ON c.block_ordinal = {at} >> 32 JOIN clock c2 ON c2.prefix <= {g} AND {g} < c2.prefix + c2.transaction_count)"


def _wait(name: str, source: str, at: str, seconds: int, out: str) -> str:
    return f"{name} AS (SELECT x.*, (b << 32) + 1 AS {out} FROM {source} x JOIN (SELECT event_id, min(c.block_ordinal) AS b FROM {source} y JOIN clock k ON k.block_ordinal = {at} >> 32 JOIN clock c ON c.transaction_count > 0 AND c.block_ordinal > {at} >> 32 AND c.block_time_s >= k.block_time_s + {seconds} GROUP BY 1) USING (event_id))"


def _see(name: str, source: str, at: str, s: str) -> str:
    return f"{name} AS (SELECT x.*, {_state(s)} FROM {source} x ASOF LEFT JOIN states {s} ON x.venue = {s}.venue AND x.{at} >= {s}.state_at)"


def _exit(vt: str, vq: str, life: str) -> str:
    """Why a price ends a position."""
    now, then = f"{vq}::HUGEINT * tokens * 10000", f"{_NET}::HUGEINT * {vt}"
    return f"CASE WHEN {life} = 'ACTIVE' AND {now} <= {then} * {10_000 - POLICY.stop_bps} THEN 'STOP_LOSS' WHEN {life} = 'ACTIVE' AND {now} >= {then} * {10_000 + POLICY.take_bps} THEN 'TAKE_PROFIT' END"


def _sale(i: int) -> str:
    """Attempt i: quote what is seen, land, and wait for the next."""
    d, sell = POLICY.observation_delay, TERMS.sell_delay
    ref, land = _sells("tokens", f"u{i}_vt", f"u{i}_vq", f"u{i}_l"), _sells("tokens", f"v{i}_vt", f"v{i}_vq", f"v{i}_l")
    better = f"{_net('tokens', f'v{i}_vt', f'v{i}_vq')} >= {_net('tokens', f'u{i}_vt', f'u{i}_vq')}"
    parts = [_move(f"ma{i}", f"o{i}", "x.decide_at", -d, "seen_at"), _move(f"mb{i}", f"ma{i}", "x.decide_at", sell, "land_at"), _see(f"mc{i}", f"mb{i}", "seen_at", f"u{i}"), _see(f"md{i}", f"mc{i}", "land_at", f"v{i}")]
    parts.append(f"sa{i} AS (SELECT event_id, venue, tokens, reason, decide_at, {i} AS attempt, CASE WHEN NOT {ref} THEN 'REJECTED' WHEN {land} AND {better} THEN 'FILLED' ELSE 'FAILED' END AS outcome, CASE WHEN NOT {ref} THEN decide_at ELSE land_at END AS ended_at, CAST({_net('tokens', f'v{i}_vt', f'v{i}_vq')} AS BIGINT) AS proceeds FROM md{i})")
    if i < copying.ATTEMPTS:
        parts += [f"sb{i} AS (SELECT * FROM sa{i} WHERE outcome <> 'FILLED')", _wait(f"sc{i}", f"sb{i}", "ended_at", copying.RETRY_S, "retry_at"), f"o{i + 1} AS (SELECT event_id, venue, tokens, reason, retry_at AS decide_at FROM sc{i})"]
    return ", ".join(parts)


def _longest() -> str:
    parts, last = [], "c3"
    for i in range(1, copying.ATTEMPTS + 1):
        parts.append(_move(f"pa{i}", last, "x.deadline" if i == 1 else f"x.again{i - 1}", TERMS.sell_delay, f"landed{i}"))
        last = f"pa{i}"
        if i < copying.ATTEMPTS:
            parts.append(_wait(f"pb{i}", last, f"landed{i}", copying.RETRY_S, f"again{i}"))
            last = f"pb{i}"
    return ", ".join(parts)


_TAIL = f"""WITH t1 AS (SELECT event_id, venue, boundary, block_ordinal FROM launches), {_move('t2', 't1', 'x.boundary', TERMS.buy_delay, 'buy_at')}, {_wait('c3', 't2', 'buy_at', TERMS.hold_s, 'deadline')}, {_longest()}
 SELECT l.event_id, p.landed{copying.ATTEMPTS} AS settled FROM launches l LEFT JOIN pa{copying.ATTEMPTS} p USING (event_id)"""


@query("st_settlement_tail", _TAIL)
def st_settlement_tail(t: Tables) -> DataFrame:
    """Where a launch's longest path would end: bought, held, and sold at the fourth attempt; null if that leaves the clock."""
    s = t.stored_events()
    rows = copying.shifted(s.launches.select("event_id", "venue", "boundary"), s.clock, "boundary", TERMS.buy_delay, "buy_at")
    rows = copying.longest(copying.after_seconds(rows, s.clock, "buy_at", TERMS.hold_s, "deadline"), s.clock, TERMS, "settled")
    return s.launches.select("event_id").join(rows.select("event_id", "settled"), "event_id", "left")


_WORTH = _worth("p.tokens")
_SALES = " UNION ALL ".join(f"SELECT * FROM sa{i}" for i in range(1, copying.ATTEMPTS + 1))
_COPY = f"""WITH c0 AS (SELECT event_id, venue, boundary FROM trades WHERE side = 'BUY' AND signer < 60), {_move('c1', 'c0', 'x.boundary', POLICY.observation_delay, 'enter_at')}, {_move('c2_', 'c1', 'x.enter_at', COPY_TERMS.buy_delay, 'buy_at')},
 {_wait('c3', 'c2_', 'buy_at', COPY_TERMS.hold_s, 'deadline')}, {_longest()},
 en0 AS (SELECT event_id, venue, boundary, enter_at, buy_at, deadline FROM pa{copying.ATTEMPTS} QUALIFY row_number() OVER (PARTITION BY venue ORDER BY boundary, event_id) = 1),
 {_move('b1', 'en0', 'x.enter_at', -POLICY.observation_delay, 'seen_at')}, {_see('b2', 'b1', 'seen_at', 'r')}, {_see('b3', 'b2', 'buy_at', 'y')},
 p AS MATERIALIZED (SELECT event_id, venue, boundary, buy_at, deadline, {_buys('r')} AS submitted, {_buys('r')} AND {_buys('y')} AND {_out('y')} >= {_out('r')} AS filled, CAST({_out('y')} AS BIGINT) AS tokens FROM b3),
 h0 AS (SELECT event_id, venue, buy_at, deadline, tokens FROM p WHERE filled), {_move('h1', 'h0', 'x.buy_at', -POLICY.observation_delay, 'seen_at')}, {_see('h2', 'h1', 'seen_at', 'z')}, {_move('h3', 'h2', 'x.buy_at', 1, 'next_at')},
 k0 AS (SELECT h3.event_id, s.state_at, {_exit('s.vt', 's.vq', 's.lifecycle')} AS by_price FROM h3 JOIN states s ON s.venue = h3.venue AND s.state_at > h3.seen_at),
 k1 AS (SELECT * FROM k0 WHERE by_price IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY state_at) = 1), {_move('k2', 'k1', 'x.state_at', POLICY.observation_delay, 'price_at')},
 o1 AS MATERIALIZED (SELECT h3.event_id, h3.venue, tokens, coalesce({_exit('z_vt', 'z_vq', 'z_l')}, CASE WHEN price_at < deadline THEN by_price END, 'MAXIMUM_HOLD') AS reason,
  CASE WHEN {_exit('z_vt', 'z_vq', 'z_l')} IS NOT NULL THEN next_at WHEN price_at < deadline THEN price_at ELSE deadline END AS decide_at FROM h3 LEFT JOIN k2 USING (event_id)),
 {', '.join(_sale(i) for i in range(1, copying.ATTEMPTS + 1))}, sales AS MATERIALIZED ({_SALES}), {_ENDS},
 sd AS (SELECT event_id, count(*) AS attempts, count(*) FILTER (WHERE outcome <> 'REJECTED') AS landed, max(proceeds) FILTER (WHERE outcome = 'FILLED') AS proceeds, max(reason) AS reason FROM sales GROUP BY 1),
 fp AS (SELECT event_id FROM p WHERE filled ORDER BY buy_at, boundary, event_id LIMIT 1),
 ra AS (SELECT p.*, sd.attempts, sd.landed, sd.proceeds, sd.reason, CASE WHEN p.event_id IN (SELECT event_id FROM fp) THEN {TERMS.wallet_deposit} ELSE 0 END AS locked, CASE WHEN NOT filled THEN 'BUY_FAILED' WHEN sd.proceeds IS NOT NULL THEN 'CLOSED' ELSE 'EXHAUSTED' END AS status FROM p LEFT JOIN sd USING (event_id)),
 rb AS (SELECT p.*, CASE WHEN filled THEN -{_SPENT + TERMS.buy_fee + TERMS.mint_deposit} - locked WHEN submitted THEN -{TERMS.buy_fee} ELSE 0 END - coalesce(landed, 0) * {TERMS.sell_fee} + CASE WHEN status = 'CLOSED' THEN proceeds + {TERMS.mint_deposit} ELSE 0 END AS cash,
  CASE WHEN status = 'EXHAUSTED' THEN {_WORTH[0]} ELSE 'NOT_APPLICABLE' END AS mtm_status, CASE WHEN status = 'EXHAUSTED' THEN CAST({_WORTH[1]} AS BIGINT) END AS mtm_value FROM ra p LEFT JOIN en USING (venue))"""


def _copied(t: Tables) -> tuple[DataFrame, DataFrame, Tables]:
    s = t.stored_events()
    positions, sales = copying.attempts(s.trades.where("side = 'BUY' AND signer < 60"), s.clock, s.states, COPY_TERMS, POLICY, RANGE)
    return positions, sales, s


@query("st_copy_engine", f"""{_COPY} SELECT event_id, venue, status, reason, coalesce(attempts, 0) AS attempts, CAST(cash AS BIGINT) AS cash, CASE WHEN status <> 'EXHAUSTED' THEN CAST(cash AS BIGINT) END AS realized, mtm_status, mtm_value,
 CAST(CASE WHEN status = 'EXHAUSTED' THEN cash + mtm_value + locked ELSE cash + locked END AS BIGINT) AS economic FROM rb""")
def st_copy_engine(t: Tables) -> DataFrame:
    positions, sales, s = _copied(t)
    return copying.results(positions, sales, s.states, COPY_TERMS)


@query("st_copy_execution", f"{_COPY} SELECT event_id, attempt, outcome, decide_at, ended_at, CASE WHEN outcome = 'FILLED' THEN proceeds END AS proceeds FROM sales")
def st_copy_execution(t: Tables) -> DataFrame:
    """Every order to sell: quoted on what was observed, landed on the history, with the least output that it accepts."""
    _, sales, _ = _copied(t)
    return sales.select("event_id", "attempt", "outcome", "decide_at", "ended_at", F.when(F.col("outcome") == "FILLED", F.col("proceeds")).alias("proceeds"))


OPENING = 20_000_000


@query("st_ledger_apply", f"""WITH RECURSIVE o AS (SELECT transaction_id, customer, amount, row_number() OVER (PARTITION BY customer ORDER BY block_ordinal, transaction_id) AS rn FROM postings WHERE account = 'CUSTOMER'),
 r(transaction_id, customer, rn, accepted, balance) AS (SELECT CAST(NULL AS BIGINT), customer, CAST(0 AS BIGINT), true, CAST({OPENING} AS BIGINT) FROM (SELECT DISTINCT customer FROM o)
  UNION ALL SELECT o.transaction_id, o.customer, o.rn, balance + amount >= 0, CASE WHEN balance + amount >= 0 THEN balance + amount ELSE balance END FROM r JOIN o ON o.customer = r.customer AND o.rn = r.rn + 1)
 SELECT transaction_id, customer, accepted, balance FROM r WHERE rn > 0""")
def st_ledger_apply(t: Tables) -> DataFrame:
    """Charges in order against what each customer has; one that would leave less than nothing is refused."""
    own = t.postings.where("account = 'CUSTOMER'").select("transaction_id", "customer", "block_ordinal", "amount")
    return replay.funded(own, "customer", ["block_ordinal", "transaction_id"], "amount", OPENING).select("transaction_id", "customer", "accepted", "balance")


@query("st_snapshot_validator", "SELECT event_id FROM trades WHERE amount <= 0 UNION ALL SELECT event_id FROM positions GROUP BY event_id HAVING count(*) > 1")
def st_snapshot_validator(t: Tables) -> DataFrame:
    """Every violation of the stream's rules; empty for a sound snapshot."""
    repeated = t.positions.groupBy("event_id").agg(F.count("*").alias("n")).where("n > 1").select("event_id")
    return t.trades.where("amount <= 0").select("event_id").unionByName(repeated)


@query("st_late_data", "SELECT ts < TIMESTAMP '2024-01-02' AS late, count(*) AS n FROM ev GROUP BY 1")
def st_late_data(t: Tables) -> DataFrame:
    return t.raw("events").groupBy((F.col("ts") < F.lit("2024-01-02").cast("timestamp_ntz")).alias("late")).agg(F.count("*").alias("n"))


# --- event-time windows (streaming twins in chainframe.streaming) ------------------------------------------------------
def _epoch(c: str):
    return F.unix_timestamp(F.col(c).cast("timestamp"))


@query("st_tumbling_window", "SELECT t - t % 3600 AS start_s, event_type, count(*) AS n FROM ev GROUP BY 1, 2")
def st_tumbling_window(t: Tables) -> DataFrame:
    return t.raw("events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(_epoch("w.start").alias("start_s"), "event_type", "n")


@query("st_sliding_window", "SELECT s AS start_s, count(*) AS n FROM (SELECT unnest([t - t % 1800, t - t % 1800 - 1800]) AS s FROM ev) GROUP BY 1")
def st_sliding_window(t: Tables) -> DataFrame:
    return t.raw("events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select(_epoch("w.start").alias("start_s"), "n")


@query("st_session_window", "WITH g AS (SELECT user_id, ts, (lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 2 HOUR)::INT AS new FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k, ts FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, count(*) AS n FROM s GROUP BY user_id, k")
def st_session_window(t: Tables) -> DataFrame:
    s = t.raw("events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "2 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", _epoch("w.start").alias("start_s"), "n")


@query("st_dedup_window", "SELECT user_id, event_type, min(event_id) AS event_id FROM ev GROUP BY 1, 2")
def st_dedup_window(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    return t.positions.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("user_id", "event_type", "event_id")
