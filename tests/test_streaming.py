"""The streaming twins give the batch results."""

from pyspark.sql import functions as F

from chainframe.operators import replay
from chainframe.streaming import streams


def _run(query_df, name, mode="append"):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def _source(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts")
    path = str(tmp_path / "events")
    events.coalesce(1).write.parquet(path)
    return events, streams.read_events(spark, path, events.schema)


def test_tumbling_windows(spark, tmp_path):
    events, stream = _source(spark, tmp_path)
    _run(streams.windowed_counts(stream, "1 hour"), "tumbling", "complete")
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.table("tumbling").collect()}
    want = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").count().collect()
    assert got == {(r["w"]["start"], r["event_type"]): r["count"] for r in want}


def test_cooldown_stream(spark, tmp_path):
    events, stream = _source(spark, tmp_path)
    _run(streams.cooldown(stream, "user_id", 7200), "cooling")
    got = {r["event_id"] for r in spark.table("cooling").collect()}
    timed = events.select("user_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"))
    assert got == {r["event_id"] for r in replay.cooldown(timed, "user_id", "t", 7200, "event_id").collect()}


def test_repeats_and_late_rows(spark, tmp_path):
    events, stream = _source(spark, tmp_path)
    _run(streams.without_repeats(stream, "event_id"), "unique_events")
    assert spark.table("unique_events").count() == events.count()
    fine, late = streams.late_rows(events, "2024-01-02 00:00:00")
    assert fine.count() + late.count() == events.count() and late.count() > 0
