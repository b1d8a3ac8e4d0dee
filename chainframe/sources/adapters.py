"""The domain's tables, made from the driver's, as DataFrames and as the same SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exact import boundary
from ..operators.clock import build_clock
from ..operators.prefix import running_sum
from ..operators.replay import venue_states
from .scratch import stored

#: Boundaries of this many blocks are one range of an ordered operator.
RANGE = 256 << 32
MODES = ["NON_MAYHEM", "MAYHEM", "UNKNOWN"]


class Tables:
    """Lazily built views over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def obs(self) -> DataFrame:
        o = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        i = self.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity", "l_extendedprice")
        return i.join(o, i.l_orderkey == o.o_orderkey).select(
            F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("block_ordinal"),
            F.col("o_orderkey").alias("transaction_index"),
            F.col("l_linenumber").cast("long").alias("source_instruction_index"),
            F.unix_timestamp("o_orderdate").alias("block_time_s"),
            F.col("l_partkey").alias("mint"),
            F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
            F.col("l_quantity").cast("long").alias("base_amount"),
            F.round(F.col("l_extendedprice") * 100).cast("long").alias("quote_amount"),
            F.col("o_custkey").alias("signing_wallet"),
        )

    @cached_property
    def modes(self) -> DataFrame:
        size = F.col("p_size")
        return self.raw("part").select(F.col("p_partkey").alias("mint"), F.when(size % 3 == 0, "NON_MAYHEM").when(size % 3 == 1, "MAYHEM").otherwise("UNKNOWN").alias("mode"), F.when(size % 10 == 0, "MISSING_CREATION_SIGNATURE").otherwise("").alias("issue"))

    @cached_property
    def positions(self) -> DataFrame:
        e = self.raw("events").select("event_id", "ts", F.unix_timestamp("ts").alias("t"), "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("amount"), "props")
        e = e.withColumn("block_ordinal", F.floor(F.col("t") / 60).cast("long"))
        idx = F.row_number().over(Window.partitionBy("block_ordinal").orderBy("ts", "event_id")) - 1
        e = e.withColumn("transaction_index", idx.cast("long"))
        return e.withColumn("boundary", boundary(F.col("block_ordinal"), F.col("transaction_index"))).drop("ts")

    @cached_property
    def clock(self) -> DataFrame:
        counts = self.raw("events").groupBy(F.floor(F.unix_timestamp("ts") / 60).cast("long").alias("block_ordinal")).agg(F.count("*").alias("transaction_count"))
        return build_clock(counts).withColumn("block_time_s", F.col("block_ordinal") * 60)

    @cached_property
    def launches(self) -> DataFrame:
        return self.positions.where("event_type = 'signup'").select("event_id", "boundary", "block_ordinal", "transaction_index", "t", F.col("user_id").alias("developer"), (F.col("event_id") % 20).alias("venue"))

    @cached_property
    def trades(self) -> DataFrame:
        e = self.positions.where("event_type IN ('purchase', 'click')")
        return e.select("event_id", "boundary", "block_ordinal", "transaction_index", "t", (F.col("user_id") % 20).alias("venue"), F.when(F.col("event_id") % 3 == 0, "SELL").otherwise("BUY").alias("side"), "amount", F.col("user_id").alias("signer"))

    @cached_property
    def curve(self) -> DataFrame:
        """Each trade with its venue's reserves after it."""
        change = F.when(F.col("side") == "BUY", F.col("amount")).otherwise(-F.expr("amount div 2"))
        sums = running_sum(self.trades, ["venue"], "boundary", ["event_id"], change, "k", RANGE)
        return sums.withColumn("vt", F.lit(1073000000000000) - F.col("k") * 1000).withColumn("vq", F.lit(30000000000) + F.col("k") * 10).drop("k")

    @cached_property
    def life(self) -> DataFrame:
        """Per venue where it was completed, and where it migrated after that."""
        venue, event = F.col("venue"), F.col("event_id")
        done = self.trades.groupBy("venue").agg(F.min(F.when((event % 97 == 0) & (venue % 4 == 1), F.col("boundary"))).alias("completed_at"))
        moved = self.trades.join(done, "venue").where("boundary > completed_at AND event_id % 89 = 0 AND venue % 8 = 1").groupBy("venue").agg(F.min("boundary").alias("migrated_at"))
        return done.join(moved, "venue", "left")

    @cached_property
    def states(self) -> DataFrame:
        return venue_states(self.curve, self.life)

    def stored_events(self) -> Tables:
        """The same views over positions, clock and states that are written once, for plans that read them many times."""
        out = Tables(self.spark, self.dir)
        out.__dict__["positions"] = stored(self.positions, "positions")
        out.__dict__["clock"] = stored(self.clock, "clock")
        out.__dict__["curve"] = stored(out.curve, "curve")
        out.__dict__["states"] = stored(out.states, "states")
        return out

    @cached_property
    def postings(self) -> DataFrame:
        o = self.raw("orders").select(F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("customer"), F.round(F.col("o_totalprice") * 100).cast("long").alias("total"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("block_ordinal"))
        legs = F.explode(F.array(*(F.struct(F.lit(n).alias("account"), v.alias("amount")) for n, v in (("CUSTOMER", -F.col("total")), ("VENUE", F.col("total") - F.expr("total div 100")), ("FEE", F.expr("total div 100"))))))
        return o.select("transaction_id", "customer", "block_ordinal", F.lit("QUOTE").alias("asset"), legs.alias("leg")).select("transaction_id", "customer", "block_ordinal", "asset", "leg.account", "leg.amount")

    @cached_property
    def shards(self) -> DataFrame:
        s = F.col("s_suppkey")
        return self.raw("supplier").where(s % 17 != 5).select(s.alias("shard"), (s * 10).alias("lo"), (s * 10 + 10 + (s % 3 == 0).cast("long") * 5).alias("hi"))

    @cached_property
    def roundtrips(self) -> DataFrame:
        """One record per order: what it cost, what it returned, its status."""
        o, key = self.raw("orders"), F.col("o_orderkey")
        total = F.round(F.col("o_totalprice") * 100).cast("long")
        status = F.when(F.col("o_orderstatus") == "F", "CLOSED").when(F.col("o_orderstatus") == "O", "OPEN_AT_HORIZON").otherwise("BUY_LANDED_FAILED")
        pnl = F.when(F.col("o_orderstatus") == "F", (key % 2001 - 1000)).when((F.col("o_orderstatus") == "O") & (key % 7 != 0), (key % 501 - 250))
        return o.select(key.alias("roundtrip_id"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("boundary"), F.col("o_custkey").alias("owner"), total.alias("spent"), F.expr("cast(round(o_totalprice * 100) as bigint) div 100").alias("fees"), (key % 21 - 10).alias("slippage"), status.alias("status"), pnl.cast("long").alias("pnl"))

    @cached_property
    def swaps(self) -> DataFrame:
        """Source rows as an indexer delivers them, with repeats."""
        return self.raw("lineitem").select(F.col("l_orderkey").alias("signature"), F.col("l_linenumber").cast("long").alias("ix"), F.col("l_partkey").alias("mint"), F.col("l_quantity").cast("long").alias("base_amount"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("quote_amount"), F.col("l_returnflag").alias("flag"), F.col("l_suppkey").alias("curve"))


#: The same views in DuckDB's SQL, in the order of their dependencies.
CTES: dict[str, str] = {
    "obs": """SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS block_ordinal, o_orderkey AS transaction_index, CAST(l_linenumber AS BIGINT) AS source_instruction_index,
 CAST(epoch(o_orderdate) AS BIGINT) AS block_time_s, l_partkey AS mint, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, CAST(l_quantity AS BIGINT) AS base_amount,
 CAST(round(l_extendedprice * 100) AS BIGINT) AS quote_amount, o_custkey AS signing_wallet FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "modes": "SELECT p_partkey AS mint, CASE p_size % 3 WHEN 0 THEN 'NON_MAYHEM' WHEN 1 THEN 'MAYHEM' ELSE 'UNKNOWN' END AS mode, CASE WHEN p_size % 10 = 0 THEN 'MISSING_CREATION_SIGNATURE' ELSE '' END AS issue FROM part",
    "ev": "SELECT event_id, ts, CAST(floor(epoch(ts)) AS BIGINT) AS t, CAST(floor(epoch(ts) / 60) AS BIGINT) AS block_ordinal, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS amount, props FROM events",
    "positions": "SELECT *, (block_ordinal << 32) + transaction_index + 1 AS boundary FROM (SELECT *, row_number() OVER (PARTITION BY block_ordinal ORDER BY ts, event_id) - 1 AS transaction_index FROM ev)",
    "clock": """SELECT block_ordinal, transaction_count, CAST(coalesce(sum(transaction_count) OVER (ORDER BY block_ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prefix, block_ordinal * 60 AS block_time_s
 FROM (SELECT g AS block_ordinal, count(event_id) AS transaction_count FROM (SELECT unnest(generate_series(min(block_ordinal), max(block_ordinal))) AS g FROM ev) LEFT JOIN ev ON ev.block_ordinal = g GROUP BY g)""",
    "launches": "SELECT event_id, boundary, block_ordinal, transaction_index, t, user_id AS developer, event_id % 20 AS venue FROM positions WHERE event_type = 'signup'",
    "trades": "SELECT event_id, boundary, block_ordinal, transaction_index, t, user_id % 20 AS venue, CASE WHEN event_id % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS side, amount, user_id AS signer FROM positions WHERE event_type IN ('purchase', 'click')",
    "curve": "SELECT *, CAST(1073000000000000 - k * 1000 AS BIGINT) AS vt, CAST(30000000000 + k * 10 AS BIGINT) AS vq FROM (SELECT *, sum(CASE WHEN side = 'BUY' THEN amount ELSE -(amount // 2) END) OVER (PARTITION BY venue ORDER BY boundary, event_id ROWS UNBOUNDED PRECEDING) AS k FROM trades)",
    "life": """SELECT d.venue, completed_at, min(m.boundary) AS migrated_at FROM (SELECT venue, min(boundary) FILTER (WHERE event_id % 97 = 0 AND venue % 4 = 1) AS completed_at FROM trades GROUP BY 1) d
 LEFT JOIN trades m ON m.venue = d.venue AND m.boundary > completed_at AND m.event_id % 89 = 0 AND m.venue % 8 = 1 GROUP BY 1, 2""",
    "states": """SELECT c.venue, c.boundary AS state_at, arg_max(vt, event_id) AS vt, arg_max(vq, event_id) AS vq, CASE WHEN c.boundary >= migrated_at THEN 'MIGRATED' WHEN c.boundary >= completed_at THEN 'COMPLETED' ELSE 'ACTIVE' END AS lifecycle
 FROM curve c LEFT JOIN life USING (venue) GROUP BY c.venue, c.boundary, completed_at, migrated_at""",
    "ord": "SELECT o_orderkey AS transaction_id, o_custkey AS customer, CAST(round(o_totalprice * 100) AS BIGINT) AS total, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS block_ordinal FROM orders",
    "postings": "SELECT transaction_id, customer, block_ordinal, 'QUOTE' AS asset, 'CUSTOMER' AS account, -total AS amount FROM ord UNION ALL SELECT transaction_id, customer, block_ordinal, 'QUOTE', 'VENUE', total - total // 100 FROM ord UNION ALL SELECT transaction_id, customer, block_ordinal, 'QUOTE', 'FEE', total // 100 FROM ord",
    "shards": "SELECT s_suppkey AS shard, s_suppkey * 10 AS lo, s_suppkey * 10 + 10 + (s_suppkey % 3 = 0)::BIGINT * 5 AS hi FROM supplier WHERE s_suppkey % 17 <> 5",
    "roundtrips": """SELECT o_orderkey AS roundtrip_id, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS boundary, o_custkey AS owner, CAST(round(o_totalprice * 100) AS BIGINT) AS spent,
 CAST(round(o_totalprice * 100) AS BIGINT) // 100 AS fees, o_orderkey % 21 - 10 AS slippage, CASE o_orderstatus WHEN 'F' THEN 'CLOSED' WHEN 'O' THEN 'OPEN_AT_HORIZON' ELSE 'BUY_LANDED_FAILED' END AS status,
 CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 2001 - 1000 WHEN o_orderstatus = 'O' AND o_orderkey % 7 <> 0 THEN o_orderkey % 501 - 250 END AS pnl FROM orders""",
    "swaps": "SELECT l_orderkey AS signature, CAST(l_linenumber AS BIGINT) AS ix, l_partkey AS mint, CAST(l_quantity AS BIGINT) AS base_amount, CAST(round(l_extendedprice * 100) AS BIGINT) AS quote_amount, l_returnflag AS flag, l_suppkey AS curve FROM lineitem",
    "firsts": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY signing_wallet, mint ORDER BY block_ordinal, transaction_index, source_instruction_index, block_time_s, side, base_amount, quote_amount) AS rn FROM obs WHERE side = 'BUY') WHERE rn = 1",
    "found": """SELECT a.mint, a.signing_wallet AS signer_a, b.signing_wallet AS signer_b, a.block_time_s AS a_t, b.block_time_s AS b_t, (a.block_ordinal, a.transaction_index) AS a_p, (b.block_ordinal, b.transaction_index) AS b_p,
 a.block_ordinal = b.block_ordinal AND a.transaction_index = b.transaction_index AS same_tx FROM firsts a JOIN firsts b ON a.mint = b.mint AND a.signing_wallet < b.signing_wallet AND abs(a.block_time_s - b.block_time_s) <= 2592000""",
    "pairs": "SELECT signer_a, signer_b, count(*) AS shared_mints, count(*) FILTER (WHERE a_p < b_p) AS a_first, count(*) FILTER (WHERE b_p < a_p) AS b_first, count(*) FILTER (WHERE same_tx) AS same_transaction FROM found GROUP BY 1, 2 HAVING count(*) >= 1",
    "edges": "SELECT signer_a, signer_b, shared_mints AS weight FROM pairs",
}


def with_ctes(sql: str) -> str:
    """The SQL with the views it needs in front."""
    import re

    needed: set[str] = set()

    def add(text: str) -> None:
        for name, body in CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                add(body)

    add(sql)
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in CTES if n in needed)
    if not head:
        return sql
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    if own:
        return f"WITH {own[1] or ''}{head},\n{sql[own.end() :]}"
    return f"WITH {head}\n{sql}"
