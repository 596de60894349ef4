"""Streams against their batch forms."""

from pyspark.sql import functions as F

from quillstone.operators import memory, usage
from quillstone.streaming import usage as live

EVENTS = [
    ("a", "2024-01-01 00:00:00", 1, 1.0),
    ("a", "2024-01-02 00:00:00", 2, 2.0),
    ("a", "2024-01-03 00:00:01", 3, 3.0),
    ("b", "2024-01-05 12:00:00", 4, 1.0),
    ("b", None, 5, 1.0),
]


def _table(spark, path, name, build):
    rows = spark.createDataFrame(EVENTS, "project string, at string, event_id long, weight double").withColumn("ts", F.col("at").cast("timestamp"))
    rows.repartition(3).write.parquet(str(path / "in"))
    stream = build(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(path / "in")))
    stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(path / "log")).trigger(availableNow=True).start().awaitTermination()
    return rows, spark.table(name)


def test_running_strength(spark, tmp_path):
    as_usage = lambda df: df.where("ts is not null").select(F.lit("node").alias("target_kind"), F.col("project").alias("target_id"), "weight", F.col("ts").alias("event_at"))
    rows, got = _table(spark, tmp_path, "live_strength", lambda s: live.running_strength(as_usage(s)))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    expected = {r.target_id: (r.n, round(r.strength, 9)) for r in usage.summary(as_usage(rows), now).collect()}
    assert {r.target_id: (r.n, round(r.strength, 9)) for r in live.strength_at(got, now).collect()} == expected


def test_sessions(spark, tmp_path):
    rows, got = _table(spark, tmp_path, "live_sessions", live.sessions)
    batch = memory.episodes(memory.sessionise(rows)).where("session >= 0")
    key = lambda r: (r.project, r.time_start, r.time_end, r.n_events)
    assert sorted(map(key, got.collect())) == sorted(map(key, batch.collect()))
