"""Learning and sink queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import learning, ordered, quality, research
from ..sources import replaypack, sinks
from ..sources.adapters import RANGE, Tables
from ..sources.scratch import scratch
from .registry import query


@query("ml_feature_rows", "SELECT event_id AS replay_row_id, boundary + 5 AS available, amount AS v0, event_id % 100 AS v1 FROM trades")
def ml_feature_rows(t: Tables) -> DataFrame:
    return t.trades.select(F.col("event_id").alias("replay_row_id"), (F.col("boundary") + 5).alias("available"), F.col("amount").alias("v0"), (F.col("event_id") % 100).alias("v1"))


@query("ml_universe_rows", "SELECT event_id AS entity_id, boundary + 5 AS eligible_from, boundary + 6 AS eligible_until FROM trades")
def ml_universe_rows(t: Tables) -> DataFrame:
    return t.trades.select(F.col("event_id").alias("entity_id"), (F.col("boundary") + 5).alias("eligible_from"), (F.col("boundary") + 6).alias("eligible_until"))


CUTOFF = 28424160


@query("ml_label_rows", f"SELECT event_id AS replay_row_id, ((block_ordinal + 30) << 32) - boundary AS value FROM trades WHERE block_ordinal + 30 <= {CUTOFF}")
def ml_label_rows(t: Tables) -> DataFrame:
    """How far it is from a row to the boundary that its label looks ahead to; labels that look beyond the cutoff do not exist."""
    until = F.shiftleft(F.col("block_ordinal") + 30, 32)
    return t.trades.where(F.col("block_ordinal") + 30 <= CUTOFF).select(F.col("event_id").alias("replay_row_id"), (until - F.col("boundary")).alias("value"))


@query("ml_temporal_split", "SELECT event_id, CASE WHEN block_ordinal + 30 < 28414160 THEN 'TRAIN' WHEN block_ordinal >= 28414160 + 15 THEN 'TEST' ELSE 'PURGED' END AS part FROM trades")
def ml_temporal_split(t: Tables) -> DataFrame:
    part = F.when(F.col("block_ordinal") + 30 < 28414160, "TRAIN").when(F.col("block_ordinal") >= 28414160 + 15, "TEST").otherwise("PURGED")
    return t.trades.select("event_id", part.alias("part"))


def _solution(t: Tables):
    rows = t.trades.select("amount", (F.col("event_id") % 100).alias("x"), (3 * F.col("amount") - 2 * (F.col("event_id") % 100) + 7).alias("y"))
    return learning.ridge(learning.gram(rows, ["amount", "x"], "y"), 0)


@query("ml_train_exact", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(7 AS BIGINT)), (1, 3), (2, -2)) v(term, weight)")
def ml_train_exact(t: Tables) -> DataFrame:
    """The labels are 7 + 3 amount - 2 x, which exact elimination must return."""
    return t.spark.createDataFrame(list(enumerate(learning.quantised(_solution(t), 1))), "term long, weight long")


#: Which model holds for which blocks; none does after the last.
SCHEDULE = ((1, 0, 28410000), (2, 28410000, 28420000), (3, 28420000, 28430000))
DIVISOR, DELAY = 10, 7
_SCHEDULE = ", ".join(f"({m}, {lo}, {hi})" for m, lo, hi in SCHEDULE)


def _schedule(t: Tables) -> DataFrame:
    """A few rows of configuration."""
    return t.spark.createDataFrame(list(SCHEDULE), "model int, lo long, hi long")


@query("ml_schedule_select", f"SELECT event_id, s.model FROM trades LEFT JOIN (VALUES {_SCHEDULE}) s(model, lo, hi) ON block_ordinal >= lo AND block_ordinal < hi")
def ml_schedule_select(t: Tables) -> DataFrame:
    return t.trades.select("event_id", "block_ordinal").join(F.broadcast(_schedule(t)), F.expr("block_ordinal >= lo AND block_ordinal < hi"), "left").select("event_id", "model")


def _features(t: Tables) -> DataFrame:
    return t.trades.select(F.col("event_id").alias("replay_row_id"), "venue", "block_ordinal", (F.col("boundary") + 5).alias("available"), F.col("amount").alias("v0"), (F.col("event_id") % 100).alias("v1"))


def _models(t: Tables) -> DataFrame:
    """One model for each period of the schedule, fitted exactly on that period's labels 7 + (2 + m) v0 - (1 + m) v1, and known when the period begins."""
    rows = _features(t).join(F.broadcast(_schedule(t)), F.expr("block_ordinal >= lo AND block_ordinal < hi"))
    rows = rows.withColumn("y", 7 + (2 + F.col("model")) * F.col("v0") - (1 + F.col("model")) * F.col("v1"))
    fitted = {m: learning.quantised(learning.ridge(g, 0), 1) for m, g in learning.grams_by(rows, "model", ["v0", "v1"], "y").items()}
    return t.spark.createDataFrame([(m, lo << 32, *fitted[m]) for m, lo, _ in SCHEDULE if m in fitted], "model int, fitted long, w0 long, w1 long, w2 long")


def _predictions(t: Tables) -> DataFrame:
    return learning.predictions(_features(t), _schedule(t), _models(t), DIVISOR, DELAY)


_PREDICT = f"""SELECT event_id AS replay_row_id, s.model, greatest(boundary + 5, coalesce(CAST(s.lo AS BIGINT) << 32, 0)) + {DELAY} AS available, CAST(floor((7 + (2 + s.model) * amount - (1 + s.model) * (event_id % 100)) / {DIVISOR}.0) AS BIGINT) AS value
 FROM trades LEFT JOIN (VALUES {_SCHEDULE}) s(model, lo, hi) ON block_ordinal >= lo AND block_ordinal < hi"""


@query("ml_predict_frozen", _PREDICT)
def ml_predict_frozen(t: Tables) -> DataFrame:
    """Features, schedule and models are published as tables; predictions come from what a reader finds there."""
    base = scratch(t.spark, "models")
    tables = [sinks.publish(df, f"{base}/{name}") for name, df in (("features", _features(t)), ("schedule", _schedule(t)), ("models", _models(t)))]
    return learning.predictions(*tables, DIVISOR, DELAY)


@query("ml_predict_embedded", _PREDICT)
def ml_predict_embedded(t: Tables) -> DataFrame:
    """The models are fitted as part of the run; the rows must be those of the published ones."""
    return _predictions(t)


@query("ml_pred_asof", f"SELECT l.event_id, p.replay_row_id, p.value AS visible FROM launches l ASOF LEFT JOIN (SELECT venue, available, max(replay_row_id) AS replay_row_id, arg_max(value, replay_row_id) AS value FROM ({_PREDICT}) q JOIN trades ON event_id = replay_row_id WHERE value IS NOT NULL GROUP BY 1, 2) p ON l.venue = p.venue AND l.boundary >= p.available")
def ml_pred_asof(t: Tables) -> DataFrame:
    """The newest prediction for a launch's venue that could be seen when it came."""
    made = _predictions(t).where("value IS NOT NULL").join(_features(t).select("replay_row_id", "venue"), "replay_row_id")
    newest = made.groupBy("venue", "available").agg(F.max("replay_row_id").alias("replay_row_id"), F.max_by("value", "replay_row_id").alias("value"))
    found = ordered.asof(t.launches.select("event_id", "venue", "boundary"), newest, ["venue"], "boundary", "available", ["replay_row_id", "value"], width=RANGE)
    return found.select("event_id", "replay_row_id", F.col("value").alias("visible"))


@query("ml_overlay_compose", f"SELECT 'amount' AS name, event_id AS entity, amount AS value FROM trades UNION ALL SELECT 'prediction', replay_row_id, value FROM ({_PREDICT})")
def ml_overlay_compose(t: Tables) -> DataFrame:
    a = t.trades.select(F.lit("amount").alias("name"), F.col("event_id").alias("entity"), F.col("amount").alias("value"))
    return a.unionByName(_predictions(t).select(F.lit("prediction").alias("name"), F.col("replay_row_id").alias("entity"), "value"))


SAMPLE = 20_000  # rows of the demonstration's fit, the first by id


@query("ml_logistic_demo")
def ml_logistic_demo(t: Tables) -> DataFrame:
    import numpy as np

    rows = t.trades.select("event_id", F.col("amount").cast("double").alias("x"), (F.col("side") == "BUY").cast("double").alias("y"))
    fit = np.array([(r["x"], r["y"]) for r in rows.orderBy("event_id").limit(SAMPLE).collect()])
    mean, spread, w = learning.logistic_steps(fit[:, :1], fit[:, 1])
    p = 1 / (1 + F.exp(-(float(w[0]) + float(w[1]) * (F.col("x") - float(mean[0])) / float(spread[0]))))
    scored = rows.withColumn("p", p)
    return scored.agg(F.avg(((F.col("p") >= 0.5).cast("double") == F.col("y")).cast("double")).alias("accuracy"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"))


def _round_trip(name: str, sql: str, make, order: list[str], partition_by: list[str] | None = None) -> None:
    """A sink query writes its table and returns what a reader of the published one sees."""

    @query(name, sql)
    def run(t: Tables) -> DataFrame:
        df = make(t)
        return sinks.publish(df, scratch(t.spark, name), order, partition_by).select(*df.columns)


_round_trip("sink_canonical", "SELECT boundary, event_id, amount FROM trades", lambda t: t.trades.select("boundary", "event_id", "amount"), ["boundary", "event_id"])
_round_trip("sink_snapshot", "SELECT 'T' AS kind, event_id, boundary FROM trades UNION ALL SELECT 'L', event_id, boundary FROM launches", lambda t: t.trades.select(F.lit("T").alias("kind"), "event_id", "boundary").unionByName(t.launches.select(F.lit("L").alias("kind"), "event_id", "boundary")), ["boundary"])
_round_trip("sink_research", "SELECT signing_wallet, count(*) FILTER (WHERE side = 'BUY') AS buy_rows FROM obs GROUP BY 1", lambda t: research.activity(t.obs).select("signing_wallet", "buy_rows"), ["signing_wallet"])
_TABLES = {
    "audit": "SELECT event_id, boundary, event_type FROM positions",
    "fills": "SELECT event_id, venue, side, amount FROM trades",
    "ledger": "SELECT transaction_id, account, amount FROM postings",
    "portfolio": "SELECT account, CAST(sum(amount) AS BIGINT) AS amount FROM postings GROUP BY 1",
    "roundtrips": "SELECT roundtrip_id, owner, status, pnl FROM roundtrips",
}


def _run_tables(t: Tables) -> dict[str, DataFrame]:
    return {
        "audit": t.positions.select("event_id", "boundary", "event_type"),
        "fills": t.trades.select("event_id", "venue", "side", "amount"),
        "ledger": t.postings.select("transaction_id", "account", "amount"),
        "portfolio": quality.balances(t.postings, "account").select("account", F.col("amount").cast("long").alias("amount")),
        "roundtrips": t.roundtrips.select("roundtrip_id", "owner", "status", "pnl"),
    }


@query("sink_run_tables", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n, true AS intact FROM ({q})" for n, q in _TABLES.items()))
def sink_run_tables(t: Tables) -> DataFrame:
    """Five tables of a run and their manifest, published one after the other, the manifest last; what a reader finds is checked against it."""
    base, made = scratch(t.spark, "run"), _run_tables(t)
    found = {name: sinks.publish(df, f"{base}/{name}") for name, df in made.items()}
    manifest = sinks.publish(sinks.manifest(made), f"{base}/manifest")
    again = sinks.manifest(found).withColumnRenamed("digest", "read_digest").withColumnRenamed("n", "read_n")
    return manifest.join(again, "table_name").select("table_name", "n", ((F.col("digest") == F.col("read_digest")) & (F.col("n") == F.col("read_n"))).alias("intact"))


@query("sink_replaypack", "SELECT event_id, boundary, venue, side, amount FROM trades")
def sink_replaypack(t: Tables) -> DataFrame:
    return replaypack.read(t.spark, replaypack.write(t.trades, scratch(t.spark, "pack")), 0, (1 << 63) - 1)


_round_trip("sink_sweep", "SELECT owner % 5 AS run, count(*) AS positions FROM roundtrips GROUP BY 1", lambda t: t.roundtrips.groupBy((F.col("owner") % 5).alias("run")).agg(F.count("*").alias("positions")), ["run"])
_round_trip("sink_delivery", "SELECT event_id, boundary AS source_boundary FROM trades", lambda t: t.trades.select("event_id", F.col("boundary").alias("source_boundary")), ["source_boundary"])
_round_trip("sink_ml", "SELECT event_id AS replay_row_id, boundary + 5 AS available, amount AS v0, event_id % 100 AS v1 FROM trades", lambda t: ml_feature_rows(t), ["replay_row_id"])
_round_trip("sink_atomic_commit", "SELECT event_id, event_type FROM events", lambda t: t.raw("events").select("event_id", "event_type"), ["event_id"])
