"""Scans, projections, filters, joins, aggregates, windows, pages and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact, pricing, text
from ..operators import cells, clock, graph, guards, ordered, paging, quality, research
from ..operators.variants import dedup_with_variants, zero_filled
from ..sources import replaypack, sinks
from ..sources.adapters import MODES, RANGE, Tables
from ..sources.scratch import scratch
from .registry import query

DAYS_30 = 30 * 86_400
PLACE = "block_ordinal, transaction_index, source_instruction_index"


# --- scans and projections -------------------------------------------------------------------------------------------
@query("scan_bounded", "SELECT event_id, user_id, amount, block_ordinal FROM ev WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-07' AND block_ordinal >= 28407000 AND block_ordinal < 28408000")
def scan_bounded(t: Tables) -> DataFrame:
    e = t.raw("events").where("ts >= TIMESTAMP_NTZ '2024-01-05' AND ts < TIMESTAMP_NTZ '2024-01-07'")
    block = F.floor(F.unix_timestamp("ts") / 60).cast("long")
    return e.select("event_id", "user_id", F.round(F.col("value") * 100).cast("long").alias("amount"), block.alias("block_ordinal")).where("block_ordinal >= 28407000 AND block_ordinal < 28408000").orderBy("block_ordinal", "event_id")


@query("scan_evidence", "SELECT DISTINCT event_type, user_id FROM ev WHERE block_ordinal < 28405000")
def scan_evidence(t: Tables) -> DataFrame:
    return guards.guard_rows(t.positions.where("block_ordinal < 28405000").select("event_type", "user_id").distinct(), 1_000_000)


@query("scan_limits", "SELECT count(*) AS n, count(*) <= 100000000 AS complete FROM events")
def scan_limits(t: Tables) -> DataFrame:
    return guards.guard_rows(t.raw("events"), 100_000_000).agg(F.count("*").alias("n"), (F.count("*") <= 100_000_000).alias("complete"))


@query("scan_stream_batches", "SELECT block_ordinal // 1440 AS batch, count(*) AS n, min(event_id) AS first_id FROM ev GROUP BY 1")
def scan_stream_batches(t: Tables) -> DataFrame:
    return t.positions.groupBy(F.floor(F.col("block_ordinal") / 1440).cast("long").alias("batch")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("scan_metadata", "SELECT * FROM (VALUES ('event_id', 'bigint'), ('ts', 'timestamp_ntz'), ('user_id', 'bigint'), ('event_type', 'string'), ('value', 'double'), ('props', 'string')) v(name, kind)")
def scan_metadata(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(t.raw("events").dtypes, "name string, kind string")


@query("scan_wallet_swaps", "SELECT signature, ix, upper(flag) AS flag, mint, base_amount, quote_amount FROM swaps WHERE base_amount > 0 AND flag <> 'A' AND signature >= 100 AND signature < 9000")
def scan_wallet_swaps(t: Tables) -> DataFrame:
    return t.swaps.where("base_amount > 0 AND flag <> 'A' AND signature >= 100 AND signature < 9000").select("signature", "ix", F.upper(text.cut_nul(F.col("flag"))).alias("flag"), "mint", "base_amount", "quote_amount")


@query("scan_token_modes", "SELECT m.mint, min(mode) AS mode, count(*) AS source_rows, count(DISTINCT (mode, issue)) AS variants FROM modes m WHERE m.mint IN (SELECT mint FROM obs WHERE signing_wallet < 50) GROUP BY m.mint")
def scan_token_modes(t: Tables) -> DataFrame:
    keys = t.obs.where("signing_wallet < 50").select("mint").distinct()
    return t.modes.join(keys, "mint", "left_semi").groupBy("mint").agg(F.min("mode").alias("mode"), F.count("*").alias("source_rows"), F.count_distinct(F.struct("mode", "issue")).alias("variants"))


@query("scan_memory", "SELECT * FROM (VALUES (CAST(2 AS BIGINT), 'b'), (CAST(3 AS BIGINT), 'c')) v(block_ordinal, payload)")
def scan_memory(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "block_ordinal long, payload string")
    return rows.where("block_ordinal >= 2 AND block_ordinal < 4")


@query("scan_canonical", "SELECT boundary, event_id, event_type FROM positions")
def scan_canonical(t: Tables) -> DataFrame:
    return t.positions.select("boundary", "event_id", "event_type").orderBy("boundary", "event_id")


@query("scan_venue_filter", "SELECT event_id, boundary, amount FROM trades WHERE venue = 7")
def scan_venue_filter(t: Tables) -> DataFrame:
    return t.trades.where("venue = 7").select("event_id", "boundary", "amount").orderBy("boundary")


@query("scan_candidate", "SELECT venue, count(*) AS n, min(boundary) AS first_boundary FROM trades GROUP BY venue")
def scan_candidate(t: Tables) -> DataFrame:
    return t.trades.groupBy("venue").agg(F.count("*").alias("n"), F.min("boundary").alias("first_boundary"))


@query("scan_delivery", "SELECT d.event_id, d.boundary AS source_boundary, min(c.block_ordinal) << 32 AS release FROM trades d JOIN clock c ON c.transaction_count > 0 AND c.block_ordinal >= d.block_ordinal + 3 GROUP BY 1, 2")
def scan_delivery(t: Tables) -> DataFrame:
    """A published delivery table, read back in the order of release; what the clock never releases is not in it."""
    due = t.trades.select("event_id", "boundary", (F.col("block_ordinal") + 2).alias("after"), ((F.col("block_ordinal") + 3) * 60).alias("due"))
    made = clock.first_block_at(due, t.clock, "event_id", "due", "after").where("found_block IS NOT NULL")
    rows = made.select("event_id", F.col("boundary").alias("source_boundary"), F.shiftleft("found_block", 32).alias("release"))
    return sinks.publish(rows, scratch(t.spark, "delivery"), ["release", "source_boundary"]).orderBy("release", "source_boundary", "event_id")


@query("scan_replaypack", "SELECT event_id, boundary, venue, side, amount FROM trades WHERE block_ordinal >= 28402000 AND block_ordinal < 28410000")
def scan_replaypack(t: Tables) -> DataFrame:
    """A range of a replay pack: columns of codes with their dictionaries, decoded after the range is cut."""
    return replaypack.read(t.spark, replaypack.write(t.trades, scratch(t.spark, "pack")), 28402000 << 32, 28410000 << 32)


@query("scan_results", "SELECT roundtrip_id, status, pnl FROM roundtrips WHERE boundary >= 9500 AND boundary < 9600")
def scan_results(t: Tables) -> DataFrame:
    return guards.guard_rows(t.roundtrips.where("boundary >= 9500 AND boundary < 9600"), 10_000_000).select("roundtrip_id", "status", "pnl")


@query("scan_shard_split", "SELECT shard, g AS lo, least(g + 4, hi) AS hi FROM (SELECT shard, hi, unnest(range(lo, hi, 4)) AS g FROM shards)")
def scan_shard_split(t: Tables) -> DataFrame:
    parts = t.shards.select("shard", "hi", F.explode(F.expr("sequence(lo, hi - 1, 4)")).alias("lo"))
    return parts.select("shard", "lo", F.least(F.col("lo") + 4, "hi").alias("hi"))


@query("scan_required_range", "SELECT shard, greatest(0, lo - 30) AS lo, hi + 12 AS hi FROM shards")
def scan_required_range(t: Tables) -> DataFrame:
    return t.shards.select("shard", F.greatest(F.lit(0).cast("long"), F.col("lo") - 30).alias("lo"), (F.col("hi") + 12).alias("hi"))


@query("scan_incremental_reuse", """WITH c AS (SELECT * FROM shards WHERE shard % 7 <> 6), o AS (SELECT *, greatest(coalesce(max(hi) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 10), 10) AS b FROM c WHERE hi > 10),
 f AS (SELECT coalesce(min(b) FILTER (WHERE lo > b), max(hi)) AS frontier FROM o) SELECT shard, lo, hi FROM shards WHERE hi <= (SELECT frontier FROM f)""")
def scan_incremental_reuse(t: Tables) -> DataFrame:
    """Shards that need no new scan: what lies wholly before the first gap of the committed ones."""
    upto = quality.frontier(t.shards.where("shard % 7 <> 6"), 10).first()[0]
    return t.shards.where(F.col("hi") <= upto).select("shard", "lo", "hi")


@query("proj_rename", "SELECT l_orderkey AS signature, l_partkey AS base_coin FROM lineitem")
def proj_rename(t: Tables) -> DataFrame:
    names = {"signature": "l_orderkey", "base_coin": "l_partkey"}
    return t.raw("lineitem").select(*(F.col(p).alias(n) for n, p in names.items()))


@query("proj_grouped_min", "SELECT signature, ix, min(mint) AS mint, min(base_amount) AS base_amount FROM swaps GROUP BY 1, 2")
def proj_grouped_min(t: Tables) -> DataFrame:
    return t.swaps.groupBy("signature", "ix").agg(*(F.min(c).alias(c) for c in ("mint", "base_amount")))


@query("proj_launch", "SELECT event_id, developer, venue, boundary FROM launches")
def proj_launch(t: Tables) -> DataFrame:
    return t.launches.select("event_id", "developer", "venue", "boundary")


@query("proj_trade", "SELECT event_id, venue, CAST(amount AS BIGINT) AS amount, side, boundary FROM trades")
def proj_trade(t: Tables) -> DataFrame:
    return t.trades.select("event_id", "venue", "amount", "side", "boundary")


@query("proj_normalize_block", "SELECT block_ordinal, transaction_count, block_ordinal - lag(block_ordinal) OVER (ORDER BY block_ordinal) = 1 AS follows, transaction_count = 0 AS sentinel FROM clock WHERE block_ordinal % 1000 < 900")
def proj_normalize_block(t: Tables) -> DataFrame:
    """Whether each block follows the one before; the neighbour is found by an equi join, not by one ordered task."""
    c = t.clock.where("block_ordinal % 1000 < 900").select("block_ordinal", "transaction_count")
    before = c.select((F.col("block_ordinal") + 1).alias("block_ordinal"), F.lit(True).alias("has"))
    start = F.broadcast(c.agg(F.min("block_ordinal").alias("_first")))
    joined = c.join(before, "block_ordinal", "left").join(start)
    return joined.select("block_ordinal", "transaction_count", F.when(F.col("block_ordinal") == F.col("_first"), None).otherwise(F.coalesce("has", F.lit(False))).alias("follows"), (F.col("transaction_count") == 0).alias("sentinel"))


@query("proj_normalize_launch", "SELECT event_id, venue % 4 <> 0 AS eligible, CASE WHEN venue % 4 = 0 THEN 'MODE' END AS excluded_reason, 1073000000000000 AS vt, 30000000000 AS vq FROM launches")
def proj_normalize_launch(t: Tables) -> DataFrame:
    return t.launches.select("event_id", (F.col("venue") % 4 != 0).alias("eligible"), F.when(F.col("venue") % 4 == 0, "MODE").alias("excluded_reason"), F.lit(pricing.VIRTUAL_TOKEN).alias("vt"), F.lit(pricing.VIRTUAL_QUOTE).alias("vq"))


@query("proj_normalize_trade", "SELECT event_id, side, amount, vt - 279900000000000 AS real_token, vq - 30000000000 AS real_quote, (amount * 95 + 9999) // 10000 AS protocol_fee, (amount * 95 + 9999) // 10000 AS checked_fee FROM curve WHERE amount > 0")
def proj_normalize_trade(t: Tables) -> DataFrame:
    state = pricing.curve_state(F.col("vt"), F.col("vq"))
    fee = pricing.fee(F.col("amount"), 95).cast("long")
    return t.curve.where("amount > 0").select("event_id", "side", "amount", state["real_token"].cast("long").alias("real_token"), state["real_quote"].cast("long").alias("real_quote"), fee.alias("protocol_fee"), fee.alias("checked_fee"))


_LIFE = "SELECT signature, mint, CASE WHEN k = 'C' THEN 0 ELSE 1 END AS event_index, k AS kind FROM (SELECT DISTINCT signature, mint, 'C' AS k FROM swaps WHERE flag = 'R' UNION ALL SELECT DISTINCT signature, mint, 'M' FROM swaps WHERE flag = 'R' AND base_amount > 25)"


@query("proj_normalize_lifecycle", _LIFE)
def proj_normalize_lifecycle(t: Tables) -> DataFrame:
    done = t.swaps.where("flag = 'R'")
    kinds = F.filter(F.array(F.struct(F.lit(0).alias("event_index"), F.lit("C").alias("kind"), F.lit(True).alias("on")), F.struct(F.lit(1).alias("event_index"), F.lit("M").alias("kind"), F.col("moved").alias("on"))), lambda x: x["on"])
    per = done.groupBy("signature", "mint").agg(F.bool_or(F.col("base_amount") > 25).alias("moved"))
    return per.select("signature", "mint", F.explode(kinds).alias("k")).select("signature", "mint", "k.event_index", "k.kind")


@query("proj_copybuy_normalize", "SELECT event_id, side, amount, signer AS signing_wallet FROM trades WHERE side = 'BUY'")
def proj_copybuy_normalize(t: Tables) -> DataFrame:
    return t.trades.where("side = 'BUY'").select("event_id", "side", "amount", F.col("signer").alias("signing_wallet"))


@query("proj_reference_rows", "SELECT 'LAUNCH' AS kind, event_id, boundary FROM launches UNION ALL SELECT 'TRADE', event_id, boundary FROM trades")
def proj_reference_rows(t: Tables) -> DataFrame:
    pick = lambda df, kind: df.select(F.lit(kind).alias("kind"), "event_id", "boundary")
    return pick(t.launches, "LAUNCH").unionByName(pick(t.trades, "TRADE"))


@query("proj_canonical_rows", "SELECT event_id, CASE WHEN side = 'BUY' THEN 'QUOTE' ELSE 'BASE' END AS sold, CASE WHEN side = 'BUY' THEN 'BASE' ELSE 'QUOTE' END AS bought, amount FROM trades")
def proj_canonical_rows(t: Tables) -> DataFrame:
    buy = F.col("side") == "BUY"
    return t.trades.select("event_id", F.when(buy, "QUOTE").otherwise("BASE").alias("sold"), F.when(buy, "BASE").otherwise("QUOTE").alias("bought"), "amount")


@query("proj_identity_digests", """SELECT event_id, sha256('event' || chr(0) || '{"boundary":' || boundary || ',"event_id":' || event_id || ',"kind":"' || event_type || '"}') AS canonical_id FROM positions""")
def proj_identity_digests(t: Tables) -> DataFrame:
    body = text.canonical_json(boundary=F.col("boundary"), event_id=F.col("event_id"), kind=F.col("event_type"))
    return t.positions.select("event_id", text.domain_digest("event", body).alias("canonical_id"))


# --- filters -------------------------------------------------------------------------------------------------------
@query("filter_range", "SELECT event_id, boundary FROM positions WHERE boundary >= (28405000::BIGINT << 32) AND boundary < (28410000::BIGINT << 32)")
def filter_range(t: Tables) -> DataFrame:
    return t.positions.where("block_ordinal >= 28405000 AND block_ordinal < 28410000 AND boundary >= shiftleft(28405000L, 32)").select("event_id", "boundary")


@query("filter_wallets", "SELECT * FROM obs WHERE signing_wallet IN (3, 5, 8, 13, 21)")
def filter_wallets(t: Tables) -> DataFrame:
    return t.obs.where(F.col("signing_wallet").isin(3, 5, 8, 13, 21))


@query("filter_mode_issue", "SELECT o.mint, o.signing_wallet, o.quote_amount, m.mode FROM obs o JOIN modes m USING (mint) WHERE issue = '' AND mode = 'MAYHEM'")
def filter_mode_issue(t: Tables) -> DataFrame:
    return t.obs.join(t.modes.where("issue = '' AND mode = 'MAYHEM'"), "mint").select("mint", "signing_wallet", "quote_amount", "mode")


@query("filter_first_per_key", "SELECT mint, min(signing_wallet) AS signer FROM (SELECT mint, signing_wallet, rank() OVER (PARTITION BY mint ORDER BY block_ordinal, transaction_index, source_instruction_index, signing_wallet) AS r FROM obs WHERE side = 'BUY') WHERE r = 1 GROUP BY mint")
def filter_first_per_key(t: Tables) -> DataFrame:
    first = t.obs.where("side = 'BUY'").groupBy("mint").agg(F.min(F.struct(*research.POSITION, "signing_wallet")).alias("m"))
    return first.select("mint", F.col("m.signing_wallet").alias("signer"))


@query("filter_once", "SELECT event_id, boundary FROM trades WHERE side = 'SELL' ORDER BY boundary, event_id LIMIT 1")
def filter_once(t: Tables) -> DataFrame:
    return t.trades.where("side = 'SELL'").select("event_id", "boundary").orderBy("boundary", "event_id").limit(1)


@query("filter_price_exit", """SELECT event_id, CASE WHEN vq::HUGEINT * 1073000000000000 * 10000 <= 30000000000::HUGEINT * vt * 9990 THEN 'STOP_LOSS' WHEN vq::HUGEINT * 1073000000000000 * 10000 >= 30000000000::HUGEINT * vt * 10001 THEN 'TAKE_PROFIT' END AS reason FROM curve""")
def filter_price_exit(t: Tables) -> DataFrame:
    args = (F.col("vq"), F.col("vt"), F.lit(pricing.VIRTUAL_QUOTE), F.lit(pricing.VIRTUAL_TOKEN))
    return t.curve.select("event_id", F.when(pricing.price_reaches(*args, 10, False), "STOP_LOSS").when(pricing.price_reaches(*args, 1, True), "TAKE_PROFIT").alias("reason"))


@query("filter_risk", "SELECT event_id, amount FROM trades WHERE venue IN (1, 2, 3) AND amount <= 5000")
def filter_risk(t: Tables) -> DataFrame:
    return t.trades.where(F.col("venue").isin(1, 2, 3) & (F.col("amount") <= 5000)).select("event_id", "amount")


# --- joins ---------------------------------------------------------------------------------------------------------
@query("join_inner_trade_launch", "SELECT t.event_id AS trade, l.event_id AS launch FROM trades t JOIN launches l ON t.venue = l.venue AND l.event_id % 50 = 0")
def join_inner_trade_launch(t: Tables) -> DataFrame:
    own = t.launches.where("event_id % 50 = 0").select("venue", F.col("event_id").alias("launch"))
    return t.trades.select("venue", F.col("event_id").alias("trade")).join(own, "venue").select("trade", "launch")


@query("join_inner_trade_launch_eligible", "SELECT t.event_id AS trade, l.event_id AS launch FROM trades t JOIN launches l ON t.venue = l.venue AND l.venue % 4 <> 0")
def join_inner_trade_launch_eligible(t: Tables) -> DataFrame:
    """Every trade with every eligible launch of its venue; ``join_inner_trade_launch`` takes one launch in fifty."""
    own = t.launches.where("venue % 4 <> 0").select("venue", F.col("event_id").alias("launch"))
    return cells.all_pairs(t.trades.select("venue", F.col("event_id").alias("trade")), own, "venue").select("trade", "launch")


_TERMINAL = "SELECT signature, mint, curve, count(*) AS source_row_count, max(base_amount) AS base FROM swaps WHERE flag = 'R' GROUP BY 1, 2, 3"


@query("join_left_migration_terminal", f"SELECT m.signature, m.mint, m.curve, coalesce(t.source_row_count, 0) AS source_row_count, coalesce(t.source_row_count, 0) = 0 AS missing FROM (SELECT DISTINCT signature, mint, curve FROM swaps WHERE base_amount > 40) m LEFT JOIN ({_TERMINAL}) t ON m.signature = t.signature AND m.mint = t.mint AND m.curve = t.curve")
def join_left_migration_terminal(t: Tables) -> DataFrame:
    keys = ["signature", "mint", "curve"]
    terminal = t.swaps.where("flag = 'R'").groupBy(*keys).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return t.swaps.where("base_amount > 40").select(*keys).distinct().join(terminal, keys, "left").select(*keys, n.alias("source_row_count"), (n == 0).alias("missing"))


@query("join_semi_candidates", "SELECT mint, signing_wallet, quote_amount FROM obs WHERE mint IN (SELECT mint FROM obs WHERE signing_wallet IN (3, 5, 8))")
def join_semi_candidates(t: Tables) -> DataFrame:
    return t.obs.join(t.obs.where("signing_wallet IN (3, 5, 8)").select("mint").distinct(), "mint", "left_semi").select("mint", "signing_wallet", "quote_amount")


def _found(t: Tables) -> DataFrame:
    return research.matches(research.guarded(research.first_buys(t.obs), None, None), DAYS_30)


@query("join_self_pair", "SELECT mint, signer_a, signer_b, b_t - a_t AS delta FROM found")
def join_self_pair(t: Tables) -> DataFrame:
    return _found(t).select("mint", "signer_a", "signer_b", (F.col("b_t") - F.col("a_t")).alias("delta"))


@query("join_dictionary_decode", "SELECT p.signer_a, a.c_name AS a_name, p.signer_b, b.c_name AS b_name FROM pairs p JOIN customer a ON a.c_custkey = signer_a JOIN customer b ON b.c_custkey = signer_b")
def join_dictionary_decode(t: Tables) -> DataFrame:
    names = t.raw("customer").select("c_custkey", "c_name").distinct()
    a, b = (names.select(F.col("c_custkey").alias(f"signer_{x}"), F.col("c_name").alias(f"{x}_name")) for x in "ab")
    return research.pair_counts(_found(t), 1).select("signer_a", "signer_b").join(a, "signer_a").join(b, "signer_b").select("signer_a", "a_name", "signer_b", "b_name")


@query("join_evidence", "SELECT f.signer_a, f.signer_b, f.mint, b_t - a_t AS delta_seconds FROM found f JOIN (SELECT signer_a, signer_b FROM pairs WHERE shared_mints >= 2) p USING (signer_a, signer_b)")
def join_evidence(t: Tables) -> DataFrame:
    found = _found(t)
    return research.evidence(found, research.pair_counts(found, 2))


@query("join_modes", "SELECT o.mint, mode, signing_wallet FROM obs o JOIN modes USING (mint)")
def join_modes(t: Tables) -> DataFrame:
    return t.obs.select("mint", "signing_wallet").join(t.modes.select("mint", "mode"), "mint").select("mint", "mode", "signing_wallet")


_ASOF = "SELECT l.event_id, r.boundary AS available, r.amount FROM launches l ASOF LEFT JOIN (SELECT venue, boundary, max(amount) AS amount FROM trades GROUP BY 1, 2) r ON l.venue = r.venue AND l.boundary >= r.boundary"


@query("join_asof_scalar", _ASOF)
def join_asof_scalar(t: Tables) -> DataFrame:
    right = t.trades.groupBy("venue", "boundary").agg(F.max("amount").alias("amount")).withColumnRenamed("boundary", "available")
    return ordered.asof(t.launches.select("event_id", "venue", "boundary"), right.withColumn("seen", F.col("available")), ["venue"], "boundary", "available", ["seen", "amount"], width=RANGE).select("event_id", F.col("seen").alias("available"), "amount")


@query("join_asof_marker", "SELECT l.event_id, r.vq FROM launches l ASOF LEFT JOIN (SELECT venue, boundary, max(vq) AS vq FROM curve GROUP BY 1, 2) r ON l.venue = r.venue AND l.boundary >= r.boundary")
def join_asof_marker(t: Tables) -> DataFrame:
    right = t.curve.groupBy("venue", "boundary").agg(F.max("vq").alias("vq")).withColumnRenamed("boundary", "at")
    return ordered.asof(t.launches.select("event_id", "venue", "boundary"), right, ["venue"], "boundary", "at", ["vq"], width=RANGE).select("event_id", "vq")


@query("join_asof_feature", "SELECT t.event_id, p.available, p.v AS feature FROM trades t ASOF LEFT JOIN (SELECT user_id % 20 AS venue, boundary + 1000 AS available, max(amount) AS v FROM positions GROUP BY 1, 2) p ON t.venue = p.venue AND t.boundary >= p.available")
def join_asof_feature(t: Tables) -> DataFrame:
    """The newest feature of the venue that had become available, whoever the event was of."""
    f = t.positions.groupBy((F.col("user_id") % 20).alias("venue"), (F.col("boundary") + 1000).alias("available")).agg(F.max("amount").alias("v"))
    found = ordered.asof(t.trades.select("event_id", "venue", "boundary"), f.withColumn("seen", F.col("available")), ["venue"], "boundary", "available", ["seen", "v"], width=RANGE)
    return found.select("event_id", F.col("seen").alias("available"), F.col("v").alias("feature"))


_UNIVERSE = "SELECT venue, block_ordinal AS eligible_from, block_ordinal + 200 AS eligible_until, max(event_id) AS model FROM launches GROUP BY 1, 2"


@query("join_interval_universe", f"SELECT t.event_id, CASE WHEN t.block_ordinal < u.eligible_until THEN u.model END AS model FROM trades t ASOF LEFT JOIN ({_UNIVERSE}) u ON t.venue = u.venue AND t.block_ordinal >= u.eligible_from")
def join_interval_universe(t: Tables) -> DataFrame:
    u = t.launches.groupBy("venue", F.col("block_ordinal").alias("eligible_from")).agg(F.max("event_id").alias("model")).withColumn("eligible_until", F.col("eligible_from") + 200)
    return ordered.interval_lookup(t.trades.select("event_id", "venue", "block_ordinal"), u, ["venue"], "block_ordinal", "eligible_from", "eligible_until", ["model"], width=256).select("event_id", "model")


@query("join_interval_schedule", "SELECT event_id, coalesce(s.shard, -1) AS model FROM trades LEFT JOIN (SELECT *, lead(lo, 1, 9223372036854775807) OVER (ORDER BY lo) AS following FROM shards) s ON event_id >= s.lo AND event_id < least(s.hi, s.following)")
def join_interval_schedule(t: Tables) -> DataFrame:
    """Intervals of any width; where two overlap, the one that begins later holds."""
    found = ordered.interval_lookup(t.trades.select("event_id"), t.shards.select("lo", "hi", "shard"), [], "event_id", "lo", "hi", ["shard"], width=4096)
    return found.select("event_id", F.coalesce("shard", F.lit(-1)).cast("long").alias("model"))


@query("join_kway_merge", "SELECT 'L' AS kind, event_id, boundary FROM launches UNION ALL SELECT 'T', event_id, boundary FROM trades")
def join_kway_merge(t: Tables) -> DataFrame:
    pick = lambda df, k: df.select(F.lit(k).alias("kind"), "event_id", "boundary")
    return pick(t.launches, "L").unionByName(pick(t.trades, "T")).orderBy("boundary", "event_id", "kind")


@query("join_ledger_result", "SELECT coalesce(p.transaction_id, r.roundtrip_id) AS id, p.amount AS left_value, r.spent AS right_value FROM (SELECT transaction_id, CAST(-sum(amount) AS BIGINT) AS amount FROM postings WHERE account = 'CUSTOMER' AND transaction_id % 10 <> 3 GROUP BY 1) p FULL JOIN (SELECT roundtrip_id, spent FROM roundtrips WHERE roundtrip_id % 11 <> 4) r ON p.transaction_id = r.roundtrip_id WHERE p.amount IS DISTINCT FROM r.spent")
def join_ledger_result(t: Tables) -> DataFrame:
    cash = t.postings.where("account = 'CUSTOMER' AND transaction_id % 10 <> 3").groupBy(F.col("transaction_id").alias("id")).agg((-F.sum("amount")).alias("v"))
    return quality.reconcile(cash, t.roundtrips.where("roundtrip_id % 11 <> 4").select(F.col("roundtrip_id").alias("id"), F.col("spent").alias("v")), ["id"], "v")


@query("join_order_lifecycle", "SELECT signature, count(*) FILTER (WHERE flag = 'A') AS decisions, count(*) FILTER (WHERE flag = 'R') AS terminals, count(*) FILTER (WHERE flag = 'A') = 1 AND count(*) FILTER (WHERE flag = 'R') = 1 AS valid, arg_max(flag, ix * 1000000 + base_amount * 1000 + (mint % 1000)) AS last FROM (SELECT DISTINCT signature, ix, flag, base_amount, mint FROM swaps QUALIFY row_number() OVER (PARTITION BY signature, ix ORDER BY flag, base_amount, mint) = 1) GROUP BY 1")
def join_order_lifecycle(t: Tables) -> DataFrame:
    s = t.swaps.groupBy("signature", "ix").agg(F.min(F.struct("flag", "base_amount", "mint")).alias("m")).select("signature", "ix", "m.*")
    d, e = F.count_if(F.col("flag") == "A"), F.count_if(F.col("flag") == "R")
    return s.groupBy("signature").agg(d.alias("decisions"), e.alias("terminals"), ((d == 1) & (e == 1)).alias("valid"), F.max_by("flag", F.col("ix") * 1000000 + F.col("base_amount") * 1000 + F.col("mint") % 1000).alias("last"))


@query("join_reuse_anti", "SELECT shard FROM shards s WHERE NOT EXISTS (SELECT 1 FROM shards c WHERE c.shard % 3 = 0 AND c.lo = s.lo AND c.hi = s.hi)")
def join_reuse_anti(t: Tables) -> DataFrame:
    return t.shards.join(t.shards.where("shard % 3 = 0").select("lo", "hi"), ["lo", "hi"], "left_anti").select("shard")


_LINEAGE = "WITH RECURSIVE reach(node) AS (SELECT CAST(90 AS BIGINT) UNION SELECT p FROM reach, (SELECT s_suppkey AS c, s_suppkey // 2 AS p FROM supplier WHERE s_suppkey > 0 UNION ALL SELECT s_suppkey, s_suppkey // 3 FROM supplier WHERE s_suppkey > 0) e WHERE e.c = node) SELECT node FROM reach"


def _parents(t: Tables) -> DataFrame:
    s = t.raw("supplier").where("s_suppkey > 0")
    return s.select(F.col("s_suppkey").alias("child"), F.expr("s_suppkey div 2").alias("parent")).union(s.select("s_suppkey", F.expr("s_suppkey div 3")))


@query("join_lineage", _LINEAGE)
def join_lineage(t: Tables) -> DataFrame:
    return graph.closure(t.spark.range(90, 91).select(F.col("id").alias("node")), _parents(t))


@query("join_job_retry", "SELECT o_orderkey AS job FROM orders LEFT JOIN (SELECT o_orderkey AS k, o_orderkey % 100 AS not_before FROM orders WHERE o_orderkey % 3 = 0) r ON k = o_orderkey WHERE o_orderstatus = 'O' AND (not_before IS NULL OR not_before <= 50)")
def join_job_retry(t: Tables) -> DataFrame:
    o = t.raw("orders")
    retry = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 100).alias("not_before"))
    return o.join(retry, o.o_orderkey == F.col("k"), "left").where("o_orderstatus = 'O' AND (not_before IS NULL OR not_before <= 50)").select(F.col("o_orderkey").alias("job"))


@query("join_catalog", "SELECT o_orderkey AS run, c_name AS artifact, n_name AS build FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def join_catalog(t: Tables) -> DataFrame:
    c = t.raw("customer").join(t.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return t.raw("orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("run"), F.col("c_name").alias("artifact"), F.col("n_name").alias("build"))


@query("join_attempts", "SELECT o_orderkey AS job, count(l_orderkey) AS attempts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linestatus = 'O' WHERE o_orderstatus <> 'F' GROUP BY 1")
def join_attempts(t: Tables) -> DataFrame:
    a = t.raw("lineitem").where("l_linestatus = 'O'").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    o = t.raw("orders").where("o_orderstatus <> 'F'")
    return o.join(a, o.o_orderkey == F.col("k"), "left").select(F.col("o_orderkey").alias("job"), F.coalesce("n", F.lit(0)).cast("long").alias("attempts"))


# --- aggregates ----------------------------------------------------------------------------------------------------
_DEDUP = "SELECT signature, ix, min(mint) AS mint, min(base_amount) AS base_amount, min(quote_amount) AS quote_amount, count(*) AS source_row_count, count(DISTINCT (mint, base_amount, quote_amount)) AS payload_variant_count FROM swaps GROUP BY 1, 2"


@query("agg_trade_dedup", _DEDUP)
def agg_trade_dedup(t: Tables) -> DataFrame:
    return dedup_with_variants(t.swaps, ["signature", "ix"], ["mint", "base_amount", "quote_amount"])


@query("agg_block_clock", "SELECT block_ordinal, min(t) AS t, count(*) AS n, count(DISTINCT (t, event_type)) AS variants, count(DISTINCT (t, event_type)) = 1 AND min(event_type) = 'error' AS sentinel FROM ev GROUP BY 1")
def agg_block_clock(t: Tables) -> DataFrame:
    v = F.count_distinct(F.struct("t", "event_type"))
    return t.positions.groupBy("block_ordinal").agg(F.min("t").alias("t"), F.count("*").alias("n"), v.alias("variants"), ((v == 1) & (F.min("event_type") == "error")).alias("sentinel"))


@query("agg_terminal_by_tx", f"SELECT signature, min(mint) AS mint, count(*) AS rows_, CAST(sum(source_row_count) AS BIGINT) AS source_rows, greatest(max(payload_variant_count), count(DISTINCT (mint, base_amount))) AS variants FROM ({_DEDUP}) GROUP BY 1")
def agg_terminal_by_tx(t: Tables) -> DataFrame:
    d = agg_trade_dedup(t)
    return d.groupBy("signature").agg(F.min("mint").alias("mint"), F.count("*").alias("rows_"), F.sum("source_row_count").alias("source_rows"), F.greatest(F.max("payload_variant_count"), F.count_distinct(F.struct("mint", "base_amount"))).alias("variants"))


@query("agg_migration_dedup", "SELECT signature, mint, curve, min(base_amount) AS base_amount, count(*) AS source_row_count, count(DISTINCT base_amount) AS payload_variant_count FROM swaps GROUP BY 1, 2, 3")
def agg_migration_dedup(t: Tables) -> DataFrame:
    return dedup_with_variants(t.swaps, ["signature", "mint", "curve"], ["base_amount"])


@query("agg_copy_candidates", "SELECT mint, count(*) AS n, count(DISTINCT signing_wallet) AS signers FROM obs WHERE signing_wallet IN (1, 2, 3, 4, 5) AND side = 'BUY' GROUP BY 1")
def agg_copy_candidates(t: Tables) -> DataFrame:
    return t.obs.where(F.col("signing_wallet").isin(1, 2, 3, 4, 5) & (F.col("side") == "BUY")).groupBy("mint").agg(F.count("*").alias("n"), F.count_distinct("signing_wallet").alias("signers"))


@query("agg_wallet_activity", "SELECT signing_wallet, count(*) FILTER (WHERE side = 'BUY') AS buy_rows, count(*) FILTER (WHERE side = 'SELL') AS sell_rows, count(DISTINCT mint) AS mint_count, min(block_ordinal) AS first_block, max(block_ordinal) AS last_block, CAST(coalesce(sum(quote_amount) FILTER (WHERE side = 'BUY'), 0) AS BIGINT) AS quote_buy, CAST(coalesce(sum(quote_amount) FILTER (WHERE side = 'SELL'), 0) AS BIGINT) AS quote_sell FROM obs GROUP BY 1")
def agg_wallet_activity(t: Tables) -> DataFrame:
    return research.activity(t.obs).withColumns({c: F.col(c).cast("long") for c in ("quote_buy", "quote_sell")})


@query("agg_pair_counts", "SELECT * FROM pairs")
def agg_pair_counts(t: Tables) -> DataFrame:
    return research.pair_counts(_found(t), 1)


@query("agg_candidate_budget", "SELECT max(n) AS max_signers, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS candidates FROM (SELECT mint, count(*) AS n FROM firsts GROUP BY 1)")
def agg_candidate_budget(t: Tables) -> DataFrame:
    return research.candidate_budget(research.first_buys(t.obs))


@query("agg_mode_counts", "SELECT v.mode, coalesce(n, 0) AS n_rows, coalesce(d, 0) AS n_mints FROM (VALUES ('NON_MAYHEM'), ('MAYHEM'), ('UNKNOWN')) v(mode) LEFT JOIN (SELECT mode, count(*) AS n, count(DISTINCT mint) AS d FROM obs JOIN modes USING (mint) GROUP BY 1) USING (mode)")
def agg_mode_counts(t: Tables) -> DataFrame:
    return zero_filled(t.obs.select("mint").join(t.modes, "mint"), "mode", MODES, n_rows=F.count("*"), n_mints=F.count_distinct("mint"))


@query("agg_issue_list", "SELECT mint, issue, count(*) AS observation_rows FROM obs JOIN modes USING (mint) WHERE issue <> '' GROUP BY 1, 2")
def agg_issue_list(t: Tables) -> DataFrame:
    return t.obs.select("mint").join(t.modes.where("issue <> ''"), "mint").groupBy("mint", "issue").agg(F.count("*").alias("observation_rows"))


@query("agg_issue_counts", "SELECT mode, issue, count(*) AS n_rows, count(DISTINCT mint) AS n_mints FROM obs JOIN modes USING (mint) WHERE issue <> '' GROUP BY 1, 2")
def agg_issue_counts(t: Tables) -> DataFrame:
    return t.obs.select("mint").join(t.modes.where("issue <> ''"), "mint").groupBy("mode", "issue").agg(F.count("*").alias("n_rows"), F.count_distinct("mint").alias("n_mints"))


@query("agg_first_position", "SELECT mint, p[1] AS block_ordinal, p[2] AS transaction_index, p[3] AS ix FROM (SELECT mint, min([block_ordinal, transaction_index, source_instruction_index]) AS p FROM obs GROUP BY 1)")
def agg_first_position(t: Tables) -> DataFrame:
    m = t.obs.groupBy("mint").agg(F.min(F.struct(*research.POSITION)).alias("p"))
    return m.select("mint", "p.block_ordinal", "p.transaction_index", F.col("p.source_instruction_index").alias("ix"))


@query("agg_distinct_wallets", "SELECT count(DISTINCT signing_wallet) AS wallets FROM obs")
def agg_distinct_wallets(t: Tables) -> DataFrame:
    return t.obs.agg(F.count_distinct("signing_wallet").alias("wallets"))


@query("agg_dup_identity", "SELECT signature, ix, count(*) AS n FROM swaps GROUP BY 1, 2 HAVING count(*) > 1")
def agg_dup_identity(t: Tables) -> DataFrame:
    return guards.duplicates(t.swaps, "signature", "ix")


@query("agg_distinct_boundaries", "SELECT DISTINCT boundary, block_ordinal FROM positions")
def agg_distinct_boundaries(t: Tables) -> DataFrame:
    return t.positions.select("boundary", "block_ordinal").distinct().orderBy("boundary")


_SUMMARY = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS n_{s.lower()}" for s in ("CLOSED", "OPEN_AT_HORIZON", "BUY_LANDED_FAILED"))


def _status_counts() -> list:
    return [F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("CLOSED", "OPEN_AT_HORIZON", "BUY_LANDED_FAILED")]


@query("agg_roundtrip_summary", f"SELECT count(*) AS n, {_SUMMARY}, CAST(sum(spent) AS BIGINT) AS spent, CAST(sum(fees) AS BIGINT) AS fees, CAST(sum(greatest(slippage, 0)) AS BIGINT) AS favorable, CAST(sum(greatest(-slippage, 0)) AS BIGINT) AS adverse, count(*) FILTER (WHERE pnl > 0) AS wins, count(*) FILTER (WHERE status = 'OPEN_AT_HORIZON' AND pnl IS NULL) AS unvalued, CASE WHEN count(*) FILTER (WHERE status = 'OPEN_AT_HORIZON' AND pnl IS NULL) = 0 THEN CAST(sum(pnl) AS BIGINT) END AS total_pnl, CAST(sum(pnl) FILTER (WHERE status = 'CLOSED') AS BIGINT) AS realized FROM roundtrips")
def agg_roundtrip_summary(t: Tables) -> DataFrame:
    """One pass of conditional counters; the total is null while any open position has no value."""
    unvalued = F.count_if((F.col("status") == "OPEN_AT_HORIZON") & F.col("pnl").isNull())
    zero = F.lit(0).cast("long")
    return t.roundtrips.agg(
        F.count("*").alias("n"), *_status_counts(), F.sum("spent").alias("spent"), F.sum("fees").alias("fees"),
        F.sum(F.greatest("slippage", zero)).alias("favorable"), F.sum(F.greatest(-F.col("slippage"), zero)).alias("adverse"),
        F.count_if(F.col("pnl") > 0).alias("wins"), unvalued.alias("unvalued"), F.when(unvalued == 0, F.sum("pnl")).alias("total_pnl"),
        F.sum(F.when(F.col("status") == "CLOSED", F.col("pnl"))).alias("realized"),
    )


@query("agg_copy_totals", f"SELECT owner, count(*) AS positions, {_SUMMARY}, CAST(sum(spent) AS BIGINT) AS spent, count(*) = count(*) FILTER (WHERE status = 'CLOSED') + count(*) FILTER (WHERE status = 'OPEN_AT_HORIZON') + count(*) FILTER (WHERE status = 'BUY_LANDED_FAILED') AS conserved FROM roundtrips GROUP BY 1")
def agg_copy_totals(t: Tables) -> DataFrame:
    out = t.roundtrips.groupBy("owner").agg(F.count("*").alias("positions"), *_status_counts(), F.sum("spent").alias("spent"))
    return out.withColumn("conserved", F.col("positions") == F.col("n_closed") + F.col("n_open_at_horizon") + F.col("n_buy_landed_failed"))


_SIGN = "CASE WHEN pnl > 0 THEN 'PROFIT' WHEN pnl < 0 THEN 'LOSS' ELSE 'FLAT' END"


@query("agg_result_distributions", f"SELECT d, k, count(*) AS n FROM (SELECT 'STATUS' AS d, status AS k FROM roundtrips UNION ALL SELECT 'PNL', {_SIGN} FROM roundtrips WHERE pnl IS NOT NULL UNION ALL SELECT 'SLIPPAGE', CASE WHEN slippage > 0 THEN 'FAVORABLE' WHEN slippage < 0 THEN 'ADVERSE' ELSE 'UNCHANGED' END FROM roundtrips) GROUP BY 1, 2")
def agg_result_distributions(t: Tables) -> DataFrame:
    """All histograms in one pass over the records."""
    slip = F.when(F.col("slippage") > 0, "FAVORABLE").when(F.col("slippage") < 0, "ADVERSE").otherwise("UNCHANGED")
    parts = [("STATUS", F.col("status")), ("PNL", F.when(F.col("pnl").isNotNull(), pricing.pnl_sign(F.col("pnl")))), ("SLIPPAGE", slip)]
    rows = t.roundtrips.select(F.explode(F.array(*(F.struct(F.lit(d).alias("d"), k.alias("k")) for d, k in parts))).alias("x")).select("x.d", "x.k")
    return rows.where("k IS NOT NULL").groupBy("d", "k").agg(F.count("*").alias("n"))


@query("agg_ledger_cashflow", "SELECT transaction_id, asset, CAST(sum(amount) AS BIGINT) AS amount FROM postings WHERE account = 'CUSTOMER' GROUP BY 1, 2")
def agg_ledger_cashflow(t: Tables) -> DataFrame:
    return quality.balances(t.postings.where("account = 'CUSTOMER'"), "transaction_id", "asset").withColumn("amount", F.col("amount").cast("long"))


@query("agg_ledger_balances", "SELECT account, customer, asset, CAST(sum(amount) AS BIGINT) AS amount FROM postings GROUP BY 1, 2, 3")
def agg_ledger_balances(t: Tables) -> DataFrame:
    return quality.balances(t.postings, "account", "customer", "asset").withColumn("amount", F.col("amount").cast("long"))


@query("agg_conservation", "SELECT transaction_id, CAST(sum(amount) AS BIGINT) AS total, count(*) AS n, count(*) FILTER (WHERE amount = 0) AS zeros FROM postings WHERE NOT (transaction_id % 13 = 0 AND account = 'FEE') GROUP BY transaction_id, asset HAVING sum(amount) <> 0 OR count(*) < 2 OR count(*) FILTER (WHERE amount = 0) > 0")
def agg_conservation(t: Tables) -> DataFrame:
    broken = t.postings.where("NOT (transaction_id % 13 = 0 AND account = 'FEE')")
    return quality.unbalanced(broken).select("transaction_id", F.col("total").cast("long"), "n", "zeros")


@query("agg_frontier", "WITH o AS (SELECT *, greatest(coalesce(max(hi) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS b FROM shards) SELECT coalesce(min(b) FILTER (WHERE lo > b), max(hi)) AS frontier FROM o")
def agg_frontier(t: Tables) -> DataFrame:
    return quality.frontier(t.shards, 0)


@query("agg_gap_overlap", "SELECT shard, lo, hi, n AS next_lo FROM (SELECT *, lead(lo) OVER (ORDER BY lo, hi) AS n FROM shards) WHERE n <> hi")
def agg_gap_overlap(t: Tables) -> DataFrame:
    return quality.gaps_and_overlaps(t.shards)


@query("agg_evidence_proofs", "SELECT block_ordinal % 10 AS k, CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') = 0 THEN 'UNKNOWN' WHEN bool_and(amount < 20000) THEN 'PROVEN' ELSE 'REFUTED' END AS proof FROM ev GROUP BY 1")
def agg_evidence_proofs(t: Tables) -> DataFrame:
    known = F.count_if(F.col("event_type") == "purchase") > 0
    return t.positions.groupBy((F.col("block_ordinal") % 10).alias("k")).agg(quality.three_valued(F.bool_and(F.col("amount") < 20000), known).alias("proof"))


_PARTS = ", ".join(f"CAST(sum(CAST(('0x' || substr(d, {1 + 8 * i}, 8)) AS BIGINT)) AS HUGEINT)" for i in range(8))


@query("agg_evidence_digest", f"""SELECT count(*) AS n, sha256(concat_ws(':', count(*), {_PARTS})) AS digest FROM (SELECT sha256('{{"event_id":' || event_id || ',"boundary":' || boundary || ',"amount":' || amount || '}}') AS d FROM trades)""")
def agg_evidence_digest(t: Tables) -> DataFrame:
    return quality.unordered_digest(t.trades, "event_id", "boundary", "amount")


def _ordered_sql(rows: str, domain: str) -> str:
    """Digests of 1024 digests each, three times, then of what is left."""
    level = f"SELECT row_number() OVER (ORDER BY boundary, event_id) - 1 AS i, d, 1 AS n FROM ({rows})"
    for _ in range(3):
        level = f"SELECT i // 1024 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d, sum(n) AS n FROM ({level}) GROUP BY i // 1024"
    return f"SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n, sha256('{domain}' || chr(0) || string_agg(d, '' ORDER BY i)) AS digest FROM ({level})"


@query("agg_stream_digest", _ordered_sql("""SELECT boundary, event_id, sha256('{"event_id":' || event_id || ',"boundary":' || boundary || ',"amount":' || amount || '}') AS d FROM trades""", "stream"))
def agg_stream_digest(t: Tables) -> DataFrame:
    return quality.ordered_digest(t.trades, ["boundary", "event_id"], "event_id", "boundary", "amount")


_SNAPSHOT = """SELECT boundary, event_id, sha256('{"boundary":' || boundary || ',"event_id":' || event_id || ',"amount":' || coalesce(CAST(amount AS VARCHAR), 'null') || '}') AS d
 FROM (SELECT boundary, event_id, NULL AS amount FROM launches UNION ALL SELECT boundary, event_id, amount FROM trades)"""


@query("agg_snapshot_hash", _ordered_sql(_SNAPSHOT, "snapshot"))
def agg_snapshot_hash(t: Tables) -> DataFrame:
    both = t.launches.select("boundary", "event_id").unionByName(t.trades.select("boundary", "event_id", "amount"), allowMissingColumns=True)
    return quality.ordered_digest(both, ["boundary", "event_id"], "boundary", "event_id", "amount", domain="snapshot")


@query("agg_signal_coverage", "SELECT count(*) AS signals, count(DISTINCT venue) AS venues FROM trades WHERE signer < 30 AND side = 'BUY'")
def agg_signal_coverage(t: Tables) -> DataFrame:
    return t.trades.where("signer < 30 AND side = 'BUY'").agg(F.count("*").alias("signals"), F.count_distinct("venue").alias("venues"))


@query("agg_candidate_coverage", "SELECT coalesce(a.mint, b.mint) AS mint, a.mint IS NOT NULL AS has_candidate, b.mint IS NOT NULL AS has_creation FROM (SELECT DISTINCT mint FROM obs WHERE signing_wallet < 20) a FULL JOIN (SELECT mint FROM modes WHERE issue = '') b ON a.mint = b.mint WHERE a.mint IS NULL OR b.mint IS NULL")
def agg_candidate_coverage(t: Tables) -> DataFrame:
    a = t.obs.where("signing_wallet < 20").select("mint").distinct().withColumn("a", F.lit(True))
    b = t.modes.where("issue = ''").select("mint").withColumn("b", F.lit(True))
    return a.join(b, "mint", "full_outer").where("a IS NULL OR b IS NULL").select("mint", F.col("a").isNotNull().alias("has_candidate"), F.col("b").isNotNull().alias("has_creation"))


@query("agg_launch_evidence", "SELECT count(*) AS classified, count(*) FILTER (WHERE venue % 4 <> 0) AS eligible, count(*) FILTER (WHERE venue % 4 = 0) AS excluded FROM launches")
def agg_launch_evidence(t: Tables) -> DataFrame:
    ok = F.col("venue") % 4 != 0
    return t.launches.agg(F.count("*").alias("classified"), F.count_if(ok).alias("eligible"), F.count_if(~ok).alias("excluded"))


@query("agg_fidelity_min", "SELECT venue, min(amount % 5) AS fidelity, max(amount % 40) AS warmup FROM trades GROUP BY 1")
def agg_fidelity_min(t: Tables) -> DataFrame:
    return t.trades.groupBy("venue").agg(F.min(F.col("amount") % 5).alias("fidelity"), F.max(F.col("amount") % 40).alias("warmup"))


@query("agg_budget_report", "SELECT 'rows' AS budget, count(*) AS used, CASE WHEN count(*) <= 1000000000 THEN 'PASS' ELSE 'REJECTED' END AS verdict FROM events UNION ALL SELECT 'bytes', NULL, 'UNKNOWN'")
def agg_budget_report(t: Tables) -> DataFrame:
    n = t.raw("events").agg(F.lit("rows").alias("budget"), F.count("*").alias("used"))
    rows = n.unionByName(t.spark.range(1).select(F.lit("bytes").alias("budget"), F.lit(None).cast("long").alias("used")))
    return rows.select("budget", "used", F.when(F.col("used").isNull(), "UNKNOWN").when(F.col("used") <= 1_000_000_000, "PASS").otherwise("REJECTED").alias("verdict"))


@query("agg_sweep_compare", "SELECT owner % 5 AS run, count(*) AS positions, CAST(sum(spent) AS BIGINT) AS spent, CAST(coalesce(sum(pnl), 0) AS BIGINT) AS pnl FROM roundtrips GROUP BY 1")
def agg_sweep_compare(t: Tables) -> DataFrame:
    return t.roundtrips.groupBy((F.col("owner") % 5).alias("run")).agg(F.count("*").alias("positions"), F.sum("spent").alias("spent"), F.coalesce(F.sum("pnl"), F.lit(0)).cast("long").alias("pnl"))


@query("agg_bench_percentile", "SELECT venue, list_sort(list(amount))[CAST(ceil((count(*) - 1) * 0.5) AS BIGINT) + 1] AS median, list_sort(list(amount))[CAST(ceil((count(*) - 1) * 0.95) AS BIGINT) + 1] AS p95 FROM trades GROUP BY 1")
def agg_bench_percentile(t: Tables) -> DataFrame:
    """Nearest-rank percentiles by counting equal values, so no group is gathered."""
    counts = t.trades.groupBy("venue", "amount").agg(F.count("*").alias("n"))
    w = Window.partitionBy("venue").orderBy("amount").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("venue")))
    at = lambda p: F.min(F.when(F.col("upto") > F.ceil((F.col("total") - 1) * p), F.col("amount")))
    return ranked.groupBy("venue").agg(at(0.5).alias("median"), at(0.95).alias("p95"))


@query("agg_ml_gram", "SELECT count(*) AS n, CAST(sum(amount * amount) AS BIGINT) AS xx, CAST(sum(amount * (event_id % 100)) AS BIGINT) AS xy, CAST(sum((event_id % 100) * (event_id % 100)) AS BIGINT) AS yy FROM trades")
def agg_ml_gram(t: Tables) -> DataFrame:
    x, y = F.col("amount"), F.col("event_id") % 100
    return t.trades.agg(F.count("*").alias("n"), *(F.sum(e.cast("decimal(38,0)")).cast("long").alias(k) for k, e in (("xx", x * x), ("xy", x * y), ("yy", y * y))))


# --- windows -------------------------------------------------------------------------------------------------------
@query("win_first_buy", "SELECT signing_wallet, mint, block_ordinal, transaction_index, source_instruction_index FROM firsts")
def win_first_buy(t: Tables) -> DataFrame:
    return research.first_buys(t.obs).select("signing_wallet", "mint", *research.POSITION)


@query("win_dense_rank_codes", "SELECT mint, dense_rank() OVER (ORDER BY mint) - 1 AS code FROM (SELECT DISTINCT mint FROM obs)")
def win_dense_rank_codes(t: Tables) -> DataFrame:
    return research.global_ordinal(t.obs.select("mint").distinct(), ["mint"], "code")


@query("win_row_ordinal", "SELECT mint, signing_wallet, block_ordinal, transaction_index, source_instruction_index, row_number() OVER (ORDER BY block_ordinal, transaction_index, source_instruction_index, mint, side, base_amount, quote_amount, signing_wallet) - 1 AS row_id FROM obs")
def win_row_ordinal(t: Tables) -> DataFrame:
    order = [*research.POSITION, "mint", "side", "base_amount", "quote_amount", "signing_wallet"]
    return research.global_ordinal(t.obs, order).select("mint", "signing_wallet", *research.POSITION, "row_id")


@query("win_prefix_exclusive", "SELECT signer_a, signer_b, CAST(coalesce(sum(shared_mints) OVER (ORDER BY signer_a, signer_b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS evidence_start FROM pairs")
def win_prefix_exclusive(t: Tables) -> DataFrame:
    return research.with_evidence_ranges(research.pair_counts(_found(t), 1)).select("signer_a", "signer_b", "evidence_start")


@query("win_tx_prefix", "SELECT block_ordinal, transaction_count, prefix FROM clock")
def win_tx_prefix(t: Tables) -> DataFrame:
    return t.clock.select("block_ordinal", "transaction_count", "prefix")


@query("win_monotone_check", "SELECT event_id FROM (SELECT event_id, amount, lag(amount) OVER (PARTITION BY venue ORDER BY boundary, event_id) AS b FROM trades) WHERE b > amount")
def win_monotone_check(t: Tables) -> DataFrame:
    w = Window.partitionBy("venue").orderBy("boundary", "event_id")
    return t.trades.withColumn("b", F.lag("amount").over(w)).where("b > amount").select("event_id")


@query("win_group_offsets", "SELECT block_ordinal, CAST(prefix AS BIGINT) AS start, CAST(prefix + transaction_count AS BIGINT) AS stop FROM clock WHERE transaction_count > 0")
def win_group_offsets(t: Tables) -> DataFrame:
    return t.clock.where("transaction_count > 0").select("block_ordinal", F.col("prefix").alias("start"), (F.col("prefix") + F.col("transaction_count")).alias("stop"))


@query("win_last_per_boundary", "SELECT venue, block_ordinal, arg_max(vq, (boundary, event_id)) AS vq FROM curve GROUP BY 1, 2")
def win_last_per_boundary(t: Tables) -> DataFrame:
    return t.curve.groupBy("venue", "block_ordinal").agg(F.max_by("vq", F.struct("boundary", "event_id")).alias("vq"))


@query("win_carry_forward", """WITH p AS (SELECT venue, block_ordinal, arg_max(vq, (boundary, event_id)) AS vq FROM curve GROUP BY 1, 2),
 g AS (SELECT v.venue, h.block_ordinal * 60 AS block_ordinal FROM (SELECT DISTINCT venue FROM p) v, (SELECT unnest(generate_series((SELECT min(block_ordinal) // 60 + 1 FROM ev), (SELECT max(block_ordinal) // 60 FROM ev))) AS block_ordinal) h)
 SELECT g.venue, g.block_ordinal, p.vq FROM g ASOF LEFT JOIN p ON g.venue = p.venue AND g.block_ordinal >= p.block_ordinal""")
def win_carry_forward(t: Tables) -> DataFrame:
    """Every venue's value at every full hour of blocks, carried on from the last block with a point; null before the first."""
    points = win_last_per_boundary(t).withColumnRenamed("block_ordinal", "seen")
    first, last = t.positions.agg((F.floor(F.min("block_ordinal") / 60) + 1).alias("a"), F.floor(F.max("block_ordinal") / 60).alias("z")).first()
    # the grid is the result: every venue writes out its hours
    grid = points.select("venue").distinct().select("venue", F.explode(F.sequence(F.lit(first) * 60, F.lit(last) * 60, F.lit(60).cast("long"))).alias("block_ordinal"))
    return ordered.asof(grid, points, ["venue"], "block_ordinal", "seen", ["vq"], width=4096).select("venue", "block_ordinal", "vq")


@query("win_last_active_state", "SELECT event_id, last_value(CASE WHEN side = 'BUY' THEN amount END IGNORE NULLS) OVER (PARTITION BY venue ORDER BY boundary, event_id ROWS UNBOUNDED PRECEDING) AS state FROM trades")
def win_last_active_state(t: Tables) -> DataFrame:
    w = Window.partitionBy("venue").orderBy("boundary", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.trades.select("event_id", F.last(F.when(F.col("side") == "BUY", F.col("amount")), ignorenulls=True).over(w).alias("state"))


@query("win_prior_6h_features", "SELECT event_id, count(*) OVER w AS n, CAST(sum(amount) OVER w AS BIGINT) AS total, CAST(coalesce(sum((event_type = 'purchase')::INT) OVER w, 0) AS BIGINT) AS purchases FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 21600 PRECEDING AND 1 PRECEDING)")
def win_prior_6h_features(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(-21600, -1)
    return t.positions.select("event_id", F.count("*").over(w).alias("n"), F.sum("amount").over(w).alias("total"), F.coalesce(F.sum((F.col("event_type") == "purchase").cast("long")).over(w), F.lit(0)).cast("long").alias("purchases"))


@query("win_time_split", "SELECT CASE WHEN block_ordinal < 28424160 THEN 'TRAIN' ELSE 'TEST' END AS part, count(*) AS n FROM ev WHERE NOT (block_ordinal < 28424160 AND block_ordinal + 30 >= 28424160) GROUP BY 1")
def win_time_split(t: Tables) -> DataFrame:
    cut = 28424160
    kept = t.positions.where(f"NOT (block_ordinal < {cut} AND block_ordinal + 30 >= {cut})")
    return kept.groupBy(F.when(F.col("block_ordinal") < cut, "TRAIN").otherwise("TEST").alias("part")).agg(F.count("*").alias("n"))


@query("win_attempt_number", "SELECT o_orderkey AS job, coalesce(max(l_linenumber), 0) + 1 AS attempt FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def win_attempt_number(t: Tables) -> DataFrame:
    a = t.raw("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linenumber").alias("m"))
    o = t.raw("orders").select("o_orderkey")
    return o.join(a, o.o_orderkey == F.col("k"), "left").select(F.col("o_orderkey").alias("job"), (F.coalesce("m", F.lit(0)) + 1).alias("attempt"))


# --- sorts, pages and sets -----------------------------------------------------------------------------------------
@query("sort_external", "SELECT boundary, event_id, user_id FROM positions")
def sort_external(t: Tables) -> DataFrame:
    return t.positions.select("boundary", "event_id", "user_id").orderBy("boundary", F.col("user_id").asc_nulls_first(), "event_id")


@query("sort_spill_merge", "SELECT signature, ix, count(*) AS n FROM swaps GROUP BY 1, 2")
def sort_spill_merge(t: Tables) -> DataFrame:
    return guards.guard_unique(t.swaps.groupBy("signature", "ix").agg(F.count("*").alias("n")), "signature", "ix").orderBy("signature", "ix")


@query("page_keyset_roundtrip", "SELECT boundary, roundtrip_id, status FROM roundtrips WHERE (boundary, roundtrip_id) > (9500, 100) ORDER BY boundary, roundtrip_id LIMIT 51")
def page_keyset_roundtrip(t: Tables) -> DataFrame:
    return paging.keyset_page(t.roundtrips.select("boundary", "roundtrip_id", "status"), ["boundary", "roundtrip_id"], (9500, 100), 50)


@query("page_exact_entry", "SELECT roundtrip_id, status, pnl FROM roundtrips WHERE roundtrip_id = 77")
def page_exact_entry(t: Tables) -> DataFrame:
    return t.roundtrips.where("roundtrip_id = 77").select("roundtrip_id", "status", "pnl")


@query("page_row_ordinal", "SELECT mint, code FROM (SELECT mint, row_number() OVER (ORDER BY mint) - 1 AS code FROM (SELECT DISTINCT mint FROM obs)) WHERE code BETWEEN 20 AND 39")
def page_row_ordinal(t: Tables) -> DataFrame:
    return win_dense_rank_codes(t).where("code BETWEEN 20 AND 39").select("mint", "code")


@query("page_pair_evidence", "SELECT mint, signer_a, signer_b, b_t - a_t AS delta_seconds FROM found WHERE (signer_a, signer_b) IN (SELECT (signer_a, signer_b) FROM pairs ORDER BY shared_mints DESC, signer_a, signer_b LIMIT 1)")
def page_pair_evidence(t: Tables) -> DataFrame:
    found = _found(t)
    top = research.pair_counts(found, 1).orderBy(F.col("shared_mints").desc(), "signer_a", "signer_b").limit(1)
    return research.evidence(found, top).select("mint", "signer_a", "signer_b", "delta_seconds")


@query("page_runs", "SELECT boundary, roundtrip_id FROM roundtrips ORDER BY boundary DESC, roundtrip_id DESC LIMIT 26")
def page_runs(t: Tables) -> DataFrame:
    return paging.keyset_page(t.roundtrips.select("boundary", "roundtrip_id"), ["boundary", "roundtrip_id"], None, 25, descending=True)


@query("page_artifacts", "SELECT p_partkey, p_brand FROM part WHERE p_type = 'ECONOMY' ORDER BY p_partkey LIMIT 20 OFFSET 10")
def page_artifacts(t: Tables) -> DataFrame:
    return t.raw("part").where("p_type = 'ECONOMY'").select("p_partkey", "p_brand").orderBy("p_partkey").offset(10).limit(20)


@query("page_jobs", "SELECT o_orderkey FROM orders WHERE o_orderkey < 700 ORDER BY o_orderkey DESC LIMIT 11")
def page_jobs(t: Tables) -> DataFrame:
    return paging.keyset_page(t.raw("orders").select("o_orderkey"), ["o_orderkey"], (700,), 10, descending=True)


@query("page_job_events", "SELECT event_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 11")
def page_job_events(t: Tables) -> DataFrame:
    return paging.keyset_page(t.raw("events").select("event_id", "event_type"), ["event_id"], (500,), 10)


@query("page_cursor_codec", "SELECT 'jobs' AS view, CAST(700 AS BIGINT) AS key")
def page_cursor_codec(t: Tables) -> DataFrame:
    secret = b"of this service"
    (key,) = paging.decode_cursor("jobs", paging.encode_cursor("jobs", (700,), secret), secret)
    return t.spark.createDataFrame([("jobs", key)], "view string, key long")


@query("ui_table_sort", "SELECT roundtrip_id, pnl FROM roundtrips WHERE status LIKE '%OPEN%' ORDER BY pnl DESC NULLS LAST, roundtrip_id LIMIT 40")
def ui_table_sort(t: Tables) -> DataFrame:
    return t.roundtrips.where("status LIKE '%OPEN%'").select("roundtrip_id", "pnl").orderBy(F.col("pnl").desc_nulls_last(), "roundtrip_id").limit(40)


@query("topk_claim_next", "SELECT o_orderkey AS job FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def topk_claim_next(t: Tables) -> DataFrame:
    return t.raw("orders").where("o_orderstatus = 'O'").orderBy("o_orderdate", "o_orderkey").select(F.col("o_orderkey").alias("job")).limit(1)


@query("set_union_all_lifecycle", "SELECT signature, mint, base_amount, CAST(NULL AS BIGINT) AS curve FROM swaps WHERE flag = 'R' UNION ALL SELECT signature, mint, NULL, curve FROM swaps WHERE flag = 'N'")
def set_union_all_lifecycle(t: Tables) -> DataFrame:
    return t.swaps.where("flag = 'R'").select("signature", "mint", "base_amount").unionByName(t.swaps.where("flag = 'N'").select("signature", "mint", "curve"), allowMissingColumns=True)


@query("set_union_by_name", "SELECT event_id, boundary, developer, CAST(NULL AS BIGINT) AS amount FROM launches UNION ALL SELECT event_id, boundary, NULL, amount FROM trades")
def set_union_by_name(t: Tables) -> DataFrame:
    return t.launches.select("event_id", "boundary", "developer").unionByName(t.trades.select("event_id", "boundary", "amount"), allowMissingColumns=True)


@query("set_distinct", "SELECT DISTINCT mint, side FROM obs")
def set_distinct(t: Tables) -> DataFrame:
    return t.obs.select("mint", "side").distinct()


@query("set_difference_checks", "SELECT mint FROM modes EXCEPT SELECT mint FROM obs WHERE side = 'SELL'")
def set_difference_checks(t: Tables) -> DataFrame:
    return t.modes.select("mint").distinct().join(t.obs.where("side = 'SELL'").select("mint"), "mint", "left_anti")


# --- graphs --------------------------------------------------------------------------------------------------------
def _edges(t: Tables) -> DataFrame:
    return research.pair_counts(_found(t), 1).select("signer_a", "signer_b", F.col("shared_mints").alias("weight"))


_CENTRE = 10


@query("graph_strength", "SELECT node, CAST(sum(weight) AS BIGINT) AS strength, count(*) AS degree FROM (SELECT signer_a AS node, weight FROM edges UNION ALL SELECT signer_b, weight FROM edges) GROUP BY 1")
def graph_strength(t: Tables) -> DataFrame:
    return graph.strength(_edges(t))


@query("graph_neighbourhood", f"WITH n AS (SELECT CASE WHEN signer_a = {_CENTRE} THEN signer_b ELSE signer_a END AS v FROM edges WHERE signer_a = {_CENTRE} OR signer_b = {_CENTRE}) SELECT * FROM edges WHERE signer_a = {_CENTRE} OR signer_b = {_CENTRE} OR (signer_a IN (SELECT v FROM n) AND signer_b IN (SELECT v FROM n))")
def graph_neighbourhood(t: Tables) -> DataFrame:
    return graph.neighbourhood(_edges(t), _CENTRE)


@query("graph_filter_min", "SELECT * FROM edges WHERE weight >= 2")
def graph_filter_min(t: Tables) -> DataFrame:
    return _edges(t).where("weight >= 2")


_GROUPS = "SELECT DISTINCT v AS node, v % 7 AS label FROM (SELECT signer_a AS v FROM edges UNION ALL SELECT signer_b FROM edges)"


@query("graph_group_index", f"WITH g AS ({_GROUPS}), s AS (SELECT label, count(*) AS size, min(node) AS first FROM g GROUP BY 1), x AS (SELECT a.label AS la, b.label AS lb FROM edges JOIN g a ON a.node = signer_a JOIN g b ON b.node = signer_b), e AS (SELECT la AS label, la = lb AS i FROM x UNION ALL SELECT lb, false FROM x WHERE la <> lb) SELECT row_number() OVER (ORDER BY size DESC, first) AS group_no, size, first, coalesce(internal, 0) AS internal, coalesce(crossing, 0) AS crossing FROM s LEFT JOIN (SELECT label, count(*) FILTER (WHERE i) AS internal, count(*) FILTER (WHERE NOT i) AS crossing FROM e GROUP BY 1) USING (label)")
def graph_group_index(t: Tables) -> DataFrame:
    edges = _edges(t)
    groups = graph.both_ways(edges).select("node").distinct().withColumn("label", F.col("node") % 7)
    return graph.group_summary(edges, groups)


@query("graph_communities")
def graph_communities(t: Tables) -> DataFrame:
    return graph.communities(_edges(t).where("weight >= 2"))


@query("graph_reachability", "WITH RECURSIVE reach(node) AS (SELECT CAST(90 AS BIGINT) UNION SELECT p FROM reach, (SELECT s_suppkey AS c, s_suppkey // 2 AS p FROM supplier WHERE s_suppkey > 0 UNION ALL SELECT s_suppkey, s_suppkey // 3 FROM supplier WHERE s_suppkey > 0) e WHERE e.c = node) SELECT s_suppkey AS node FROM supplier WHERE s_suppkey NOT IN (SELECT node FROM reach)")
def graph_reachability(t: Tables) -> DataFrame:
    live = join_lineage(t)
    return t.raw("supplier").select(F.col("s_suppkey").alias("node")).join(live, "node", "left_anti")


# --- scalar functions ----------------------------------------------------------------------------------------------
@query("fn_nul_trim", "SELECT event_id, event_type AS cut FROM events")
def fn_nul_trim(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", text.cut_nul(F.concat("event_type", F.lit("\0\0x"))).alias("cut"))


@query("fn_upper", "SELECT event_id, upper(event_type) AS u FROM events")
def fn_upper(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", F.upper("event_type").alias("u"))


@query("fn_base58_decode", "SELECT event_id, CAST(event_id AS VARCHAR) AS back FROM events")
def fn_base58_decode(t: Tables) -> DataFrame:
    e = t.raw("events").select("event_id", text.base58_encode(F.encode(F.col("event_id").cast("string"), "UTF-8")).alias("b58"))
    return e.select("event_id", F.decode(text.base58_decode("b58"), "UTF-8").alias("back"))


@query("fn_base58_check", "SELECT s_suppkey, regexp_full_match(s_name, '[1-9A-HJ-NP-Za-km-z]+') AS ok FROM supplier")
def fn_base58_check(t: Tables) -> DataFrame:
    return t.raw("supplier").select("s_suppkey", text.is_base58(F.col("s_name")).alias("ok"))


@query("fn_hex", "SELECT event_id, lower(hex(event_type)) AS h, event_type AS back FROM events")
def fn_hex(t: Tables) -> DataFrame:
    h = F.lower(F.hex("event_type"))
    return t.raw("events").select("event_id", h.alias("h"), F.decode(F.unhex(h), "UTF-8").alias("back"))


@query("fn_sha256_domain", "SELECT event_id, sha256('source' || chr(0) || event_type) AS d FROM events")
def fn_sha256_domain(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", text.domain_digest("source", F.col("event_type")).alias("d"))


def _hmac_sql(key: bytes, message: str) -> str:
    inner, outer = (bytes(k ^ x for k in key.ljust(64, b"\0")).hex() for x in (0x36, 0x5C))
    return f"sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({message}))))"


@query("fn_keyed_rng", f"SELECT event_id, CAST(CAST('0x' || substr({_hmac_sql(b'seed', "'latency' || chr(0) || event_id")}, 1, 16) AS UBIGINT) AS DECIMAL(20, 0)) AS u64 FROM events")
def fn_keyed_rng(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", text.keyed_random("seed", "latency", F.col("event_id")).alias("u64"))


@query("fn_canonical_json", """SELECT event_id, '{"a":' || user_id || ',"b":"' || event_type || '"}' AS j FROM events""")
def fn_canonical_json(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", text.canonical_json(b=F.col("event_type"), a=F.col("user_id")).alias("j"))


@query("fn_json_decode_state", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def fn_json_decode_state(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", F.from_json("props", "k long", {"mode": "FAILFAST"})["k"].alias("k"))


@query("fn_epoch", "SELECT event_id, t AS s, t * 1000000000 AS ns, (t * 1000000000) % 1000000000 = 0 AS whole FROM ev")
def fn_epoch(t: Tables) -> DataFrame:
    ns = F.col("t") * 1_000_000_000
    return t.positions.select("event_id", F.col("t").alias("s"), ns.alias("ns"), (ns % 1_000_000_000 == 0).alias("whole"))


@query("fn_utc_date_range", "SELECT event_id FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-10' AND CAST(ts AS DATE) < DATE '2024-01-12'")
def fn_utc_date_range(t: Tables) -> DataFrame:
    return t.raw("events").where("ts >= TIMESTAMP_NTZ '2024-01-10' AND ts < TIMESTAMP_NTZ '2024-01-12'").select("event_id")


@query("fn_cast_nullable", "SELECT event_id, CAST(NULL AS BIGINT) AS missing, CAST(amount AS BIGINT) AS amount FROM ev")
def fn_cast_nullable(t: Tables) -> DataFrame:
    return t.positions.select("event_id", F.lit(None).cast("long").alias("missing"), "amount")


@query("fn_if_greatest", "SELECT event_id, greatest(amount, user_id) AS g, coalesce(nullif(user_id, 5), -1) AS c FROM ev")
def fn_if_greatest(t: Tables) -> DataFrame:
    return t.positions.select("event_id", F.greatest("amount", "user_id").alias("g"), F.coalesce(F.nullif("user_id", F.lit(5)), F.lit(-1)).cast("long").alias("c"))


@query("fn_tuple_compare", "SELECT event_id, CASE WHEN (user_id, amount) < (50, 2000) THEN -1 WHEN (user_id, amount) > (50, 2000) THEN 1 ELSE 0 END AS c FROM ev")
def fn_tuple_compare(t: Tables) -> DataFrame:
    a = F.struct(F.col("user_id").alias("x"), F.col("amount").alias("y"))
    b = F.struct(F.lit(50).cast("long").alias("x"), F.lit(2000).cast("long").alias("y"))
    return t.positions.select("event_id", F.when(a < b, -1).when(a > b, 1).otherwise(0).alias("c"))


@query("fn_array_fees", "SELECT event_id, c, a FROM (SELECT event_id, 'creator' AS c, amount % 3 AS a FROM trades UNION ALL SELECT event_id, 'protocol', amount % 5 FROM trades) WHERE a > 0")
def fn_array_fees(t: Tables) -> DataFrame:
    fees = F.array(F.struct(F.lit("protocol").alias("c"), (F.col("amount") % 5).alias("a")), F.struct(F.lit("creator").alias("c"), (F.col("amount") % 3).alias("a")))
    kept = F.array_sort(F.filter(fees, lambda x: x["a"] > 0))
    return t.trades.select("event_id", F.explode(kept).alias("f")).select("event_id", "f.c", "f.a")


@query("fn_unnest_param", "SELECT unnest([3, 5, 8]) AS wallet")
def fn_unnest_param(t: Tables) -> DataFrame:
    return t.spark.range(1).select(F.explode(F.array(*(F.lit(x) for x in (3, 5, 8)))).alias("wallet"))


@query("fn_bitmap_validity", "SELECT event_id, (amount >> (event_id % 8)) & 1 = 1 AS valid FROM ev")
def fn_bitmap_validity(t: Tables) -> DataFrame:
    return t.positions.select("event_id", (F.expr("shiftright(amount, cast(event_id % 8 as int)) & 1") == 1).alias("valid"))


@query("fn_boundary_encode", "SELECT event_id, boundary, boundary >> 32 AS block, (boundary & 4294967295) - 1 AS tx FROM positions")
def fn_boundary_encode(t: Tables) -> DataFrame:
    b = F.col("boundary")
    return t.positions.select("event_id", "boundary", exact.boundary_block(b).alias("block"), exact.boundary_transaction(b).alias("tx"))


@query("fn_int128_codec", "SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END * amount::HUGEINT * 1000000000000 AS VARCHAR) AS back FROM ev")
def fn_int128_codec(t: Tables) -> DataFrame:
    value = F.when(F.col("event_id") % 2 == 0, -1).otherwise(1).cast("decimal(1,0)") * F.col("amount").cast("decimal(18,0)") * F.lit(1000000000000).cast("decimal(13,0)")
    return t.positions.select("event_id", exact.int128_value(exact.int128_bytes(value.cast("decimal(38,0)"))).cast("string").alias("back"))


def _long(struct, *names) -> list:
    return [struct[n].cast("long").alias(n) for n in names]


@query("fn_fee_ceil", "SELECT event_id, (amount * 95 + 9999) // 10000 AS fee FROM trades")
def fn_fee_ceil(t: Tables) -> DataFrame:
    return t.trades.select("event_id", pricing.fee(F.col("amount"), 95).cast("long").alias("fee"))


@query("fn_fee_breakdown", "SELECT event_id, (amount * 95 + 9999) // 10000 AS protocol, (amount * 30 + 9999) // 10000 AS creator FROM trades")
def fn_fee_breakdown(t: Tables) -> DataFrame:
    return t.trades.select("event_id", *_long(pricing.fee_breakdown(F.col("amount")), "protocol", "creator"))


_G = "(amount::HUGEINT * 1000)"
_BUY = f"""SELECT event_id, CAST(net AS BIGINT) AS net, CAST((net * 95 + 9999) // 10000 + (net * 30 + 9999) // 10000 AS BIGINT) AS fees, CAST(out AS BIGINT) AS out, out > 0 AND out < vt AND out <= vt - 279900000000000 AS ok FROM (
 SELECT *, (u * vt) // (vq + u) AS out FROM (SELECT *, greatest(0, net - 1) AS u FROM (SELECT *, f - greatest(0, f + (f * 95 + 9999) // 10000 + (f * 30 + 9999) // 10000 - g) AS net FROM (SELECT *, {_G} AS g, {_G} * 10000 // 10125 AS f FROM curve))))"""


@query("fn_buy_quote", _BUY)
def fn_buy_quote(t: Tables) -> DataFrame:
    q = pricing.buy_quote(F.col("amount") * 1000, F.col("vt"), F.col("vq"), F.col("vt") - pricing.TOKEN_OFFSET)
    return t.curve.select("event_id", *_long(q, "net", "fees", "out"), q["ok"].alias("ok"))


_SELL = """SELECT event_id, CAST(g AS BIGINT) AS gross, CAST(greatest(0, g - (vq - 30000000000)) AS BIGINT) AS shortfall, CAST(g - (g * 95 + 9999) // 10000 - (g * 30 + 9999) // 10000 AS BIGINT) AS net,
 g <= vq - 30000000000 AND g - (g * 95 + 9999) // 10000 - (g * 30 + 9999) // 10000 > 0 AS ok FROM (SELECT *, (amount::HUGEINT * 100000 * vq) // (vt + amount * 100000) AS g FROM curve)"""


@query("fn_sell_quote", _SELL)
def fn_sell_quote(t: Tables) -> DataFrame:
    q = pricing.sell_quote(F.col("amount") * 100000, F.col("vt"), F.col("vq"), F.col("vq") - pricing.QUOTE_OFFSET)
    return t.curve.select("event_id", *_long(q, "gross", "shortfall", "net"), q["ok"].alias("ok"))


@query("fn_min_output", "SELECT event_id, amount * 9700 // 10000 AS least FROM trades")
def fn_min_output(t: Tables) -> DataFrame:
    return t.trades.select("event_id", pricing.minimum_output(F.col("amount"), 300).cast("long").alias("least"))


@query("fn_slippage", "SELECT event_id, event_id % 100 - 50 AS signed, amount + event_id % 100 - 50 >= amount * 9900 // 10000 AS limit_met FROM trades")
def fn_slippage(t: Tables) -> DataFrame:
    s = pricing.slippage(F.col("amount"), F.col("amount") + F.col("event_id") % 100 - 50, 100)
    return t.trades.select("event_id", *_long(s, "signed"), s["limit_met"].alias("limit_met"))


@query("fn_synthetic_shortfall", f"SELECT event_id, shortfall FROM ({_SELL})")
def fn_synthetic_shortfall(t: Tables) -> DataFrame:
    return fn_sell_quote(t).select("event_id", "shortfall")


@query("fn_constant_product", "SELECT event_id, fee, CAST((1000000000::HUGEINT * e) // (500000000 + e) AS BIGINT) AS out, 500000000 + amount AS post_in, CAST(1000000000 - (1000000000::HUGEINT * e) // (500000000 + e) AS BIGINT) AS post_out FROM (SELECT *, amount * 30 // 10000 AS fee, amount - amount * 30 // 10000 AS e FROM trades)")
def fn_constant_product(t: Tables) -> DataFrame:
    q = pricing.constant_product(F.col("amount"), F.lit(500_000_000), F.lit(1_000_000_000), 30)
    return t.trades.select("event_id", *_long(q, "fee", "out", "post_in", "post_out"))


@query("fn_curve_state", "SELECT event_id, vt - 279900000000000 AS real_token, vq - 30000000000 AS real_quote, CASE WHEN vt = 279900000000000 THEN 'COMPLETED' ELSE 'ACTIVE' END AS lifecycle FROM curve")
def fn_curve_state(t: Tables) -> DataFrame:
    s = pricing.curve_state(F.col("vt"), F.col("vq"))
    return t.curve.select("event_id", *_long(s, "real_token", "real_quote"), s["lifecycle"].alias("lifecycle"))


@query("fn_market_cap", "SELECT event_id, CAST(vq::HUGEINT * 1000000000000000 // vt AS BIGINT) AS cap FROM curve")
def fn_market_cap(t: Tables) -> DataFrame:
    return t.curve.select("event_id", pricing.market_cap(F.col("vt"), F.col("vq"), F.lit(pricing.SUPPLY)).cast("long").alias("cap"))


@query("fn_price_compare", "SELECT event_id, vq::HUGEINT * 1073000000000000 * 10000 >= 30000000000::HUGEINT * vt * 10005 AS up FROM curve")
def fn_price_compare(t: Tables) -> DataFrame:
    return t.curve.select("event_id", pricing.price_reaches(F.col("vq"), F.col("vt"), F.lit(pricing.VIRTUAL_QUOTE), F.lit(pricing.VIRTUAL_TOKEN), 5, True).alias("up"))


@query("fn_network_fee", "SELECT event_id, 2 * 5000 + (200000 * amount + 999999) // 1000000 AS fee FROM trades")
def fn_network_fee(t: Tables) -> DataFrame:
    return t.trades.select("event_id", pricing.network_fee(F.lit(2), 5000, F.lit(200_000), F.col("amount")).cast("long").alias("fee"))


@query("fn_account_deposits", "SELECT venue, CAST(sum(CASE event_id % 3 WHEN 0 THEN 2039280 WHEN 1 THEN 2074080 ELSE 1844400 END) AS BIGINT) AS deposits FROM trades GROUP BY 1")
def fn_account_deposits(t: Tables) -> DataFrame:
    prices = t.spark.createDataFrame([(0, 2_039_280), (1, 2_074_080), (2, 1_844_400)], "schema long, price long")
    return t.trades.withColumn("schema", F.col("event_id") % 3).join(F.broadcast(prices), "schema").groupBy("venue").agg(F.sum("price").alias("deposits"))


@query("fn_exact_linear", "SELECT event_id, CAST(floor((7 - 3 * amount + 2 * (event_id % 100)) / 11.0) AS BIGINT) AS y FROM trades")
def fn_exact_linear(t: Tables) -> DataFrame:
    return t.trades.select("event_id", exact.floordiv(7 - 3 * F.col("amount") + 2 * (F.col("event_id") % 100), F.lit(11)).cast("long").alias("y"))


@query("fn_sigmoid", "SELECT event_id, round(1 / (1 + exp(-(amount - 2500) / 1000.0)), 9) AS p FROM trades")
def fn_sigmoid(t: Tables) -> DataFrame:
    return t.trades.select("event_id", F.round(pricing.sigmoid((F.col("amount") - 2500) / 1000.0), 9).alias("p"))


@query("fn_ratio_metrics", "SELECT owner, round(count(*) FILTER (WHERE status = 'CLOSED')::DOUBLE / count(*), 9) AS closure, round(CASE WHEN sum(spent) > 0 THEN sum(fees)::DOUBLE / sum(spent)::DOUBLE END, 9) AS fee_share FROM roundtrips GROUP BY 1")
def fn_ratio_metrics(t: Tables) -> DataFrame:
    return t.roundtrips.groupBy("owner").agg(F.round(pricing.ratio(F.count_if(F.col("status") == "CLOSED"), F.count("*")), 9).alias("closure"), F.round(pricing.ratio(F.sum("fees"), F.sum("spent")), 9).alias("fee_share"))


@query("fn_chart_viewport", "WITH m AS (SELECT venue, min(t) AS a, max(t) AS b FROM launches GROUP BY 1) SELECT c.event_id FROM curve c JOIN m USING (venue) WHERE c.t >= a - 20 AND c.t <= b + 20")
def fn_chart_viewport(t: Tables) -> DataFrame:
    m = t.launches.groupBy("venue").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return t.curve.join(m, "venue").where("t >= a - 20 AND t <= b + 20").select("event_id")


@query("fn_pnl_sign", f"SELECT roundtrip_id, {_SIGN} AS sign FROM roundtrips WHERE pnl IS NOT NULL")
def fn_pnl_sign(t: Tables) -> DataFrame:
    return t.roundtrips.where("pnl IS NOT NULL").select("roundtrip_id", pricing.pnl_sign(F.col("pnl")).alias("sign"))
