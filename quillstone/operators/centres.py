"""Sums of the unit vectors of concepts by window, kept on disk and changed by what changed.

A row per concept and window: ``t0`` (the concept's first dated event, where its windows are anchored), ``idx`` (null for undated events),
``total`` and ``n`` as of ``vectors.unit_sums``. Sums are exact, so new events are added and old ones taken back, and the table equals one made of all events
whatever came before. Only a known concept whose first event moved is summed again from its events. Drift, central ranks and cores read the table.

Concepts lie in buckets; a batch writes the buckets of the concepts that it touches, and a manifest is switched, as in ``state``.
Rows without a concept or without a vector count for nothing; repeated rows count as often as they stand.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import versions
from ..durable import durable
from ..functions import scores, vectors
from . import memory
from .state import _clean

SCHEMA = "concept_id bigint, idx bigint, t0 timestamp, total array<bigint>, n bigint"
_KEYS = ["concept_id", "t0", "idx"]


def _stored(spark: SparkSession, root: str, manifest: dict, only: list[int] | None = None) -> DataFrame:
    paths = [f"{root}/{p}" for b, p in sorted(manifest["live"].items()) if only is None or int(b) in only]
    return spark.read.schema(SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], SCHEMA)


def read(spark: SparkSession, root: str) -> DataFrame:
    """The sums as of the last whole batch; none before the first."""
    return _stored(spark, root, versions.load(spark, root) or {"live": {}})


def _summed(events: DataFrame, anchors: DataFrame, days: float) -> DataFrame:
    """Sums of events (with ``__w``) by the windows of their concepts' anchors."""
    idx = F.floor((F.unix_micros("ts") - F.unix_micros("t0")) / int(days * scores.DAY)).cast("long")
    return vectors.unit_sums(events.join(anchors, "concept_id").withColumn("idx", idx), _KEYS, "vector", "__w")


def take(spark: SparkSession, root: str, batch: int, events: DataFrame, added: DataFrame, removed: DataFrame | None = None, days: float = 30.0, buckets: int = 64) -> dict:
    """Take a change into the sums below ``root`` as batch ``batch`` (numbered upwards; one that was taken changes nothing).

    ``added`` and ``removed``: concept_id, ts, vector of events that came and that went; a changed event is in both, as it is and as it was. ``events``: all events after the
    change, read only for concepts whose first event moved. Returns the concepts touched, those summed again, and the buckets written.
    """
    manifest = versions.load(spark, root) or {"batch": -1, "buckets": buckets, "days": days, "live": {}, "old": []}
    if batch <= manifest["batch"]:
        return {"repeated": True}
    if days != manifest["days"]:
        raise ValueError(f"{root} holds windows of {manifest['days']} days")
    bucket = F.pmod(F.xxhash64("concept_id"), F.lit(manifest["buckets"])).cast("int")
    counted = lambda df, w: df.where(F.col("concept_id").isNotNull() & F.col("vector").isNotNull()).select(F.col("concept_id").cast("long").alias("concept_id"), F.col("ts").cast("timestamp").alias("ts"), "vector", F.lit(w).alias("__w"))
    change = counted(added, 1) if removed is None else counted(added, 1).unionByName(counted(removed, -1))
    change = durable(change)
    touched = durable(change.groupBy("concept_id").agg(F.min(F.when(F.col("__w") > 0, F.col("ts"))).alias("__came"), F.min(F.when(F.col("__w") < 0, F.col("ts"))).alias("__went")))
    written = sorted(r["b"] for r in touched.select(bucket.alias("b")).distinct().collect())  # at most as many as buckets
    if not written:
        versions.commit(spark, root, {**manifest, "batch": batch})
        return {"touched": 0, "again": 0, "written": []}
    stored = _stored(spark, root, manifest, written)
    anchors = touched.join(stored.groupBy("concept_id").agg(F.min("t0").alias("t0"), F.count("*").alias("__rows")), "concept_id", "left")
    known = F.col("__rows").isNotNull()
    # A known concept's windows move where an event comes before its first one, or at first has a date, or where the first one went.
    earlier = F.col("__came").isNotNull() & (F.col("t0").isNull() | (F.col("__came") < F.col("t0")))
    moved = F.coalesce(known & (earlier | (F.col("__went") <= F.col("t0"))), F.lit(False))
    anchors = durable(anchors.select("concept_id", F.when(known, F.col("t0")).otherwise(F.col("__came")).alias("t0"), moved.alias("__moved")))
    again = anchors.where("__moved").select("concept_id")
    stay = anchors.where("not __moved").select("concept_id", "t0")
    parts = _summed(change, stay, days).unionByName(stored.join(stay.select("concept_id"), "concept_id", "left_semi").select(*_KEYS, "total", "n"))
    n_again = again.count()
    if n_again:
        mine = durable(counted(events, 1).join(again, "concept_id", "left_semi"))
        parts = parts.unionByName(_summed(mine, mine.groupBy("concept_id").agg(F.min("ts").alias("t0")), days))
    rows = vectors.merged_sums(parts, _KEYS).where("n <> 0").unionByName(stored.join(touched, "concept_id", "left_anti").select(*_KEYS, "total", "n"))
    token = uuid.uuid4().hex[:12]
    rows.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/sums/{token}")
    live = {b: p for b, p in manifest["live"].items() if int(b) not in written}
    live |= {f.removeprefix("bucket="): f"sums/{token}/{f}" for f in versions.folders(spark, f"{root}/sums/{token}")}
    old = [p for b, p in manifest["live"].items() if int(b) in written]
    versions.commit(spark, root, {**manifest, "batch": batch, "live": live, "old": old})
    _clean(spark, root, {"sums": live}, old)
    return {"touched": touched.count(), "again": n_again, "written": written}


def centres(kept: DataFrame) -> DataFrame:
    """concept_id, centroid, n of all events of a concept, dated or not: ``centres`` of ``memory.central_ranks`` and ``memory.distill_core``."""
    return vectors.merged_sums(kept, ["concept_id"]).select("concept_id", vectors.centroid(F.col("total")).alias("centroid"), "n")


def drift(kept: DataFrame, days: float = 30.0) -> DataFrame:
    """concept_id, idx, window_start, window_end, support, drift of every concept's windows, as ``build.drift`` makes them of all events."""
    windows = kept.where("idx is not null")
    moved = memory.drift_of_centres(windows.select("concept_id", "idx", vectors.centroid(F.col("total")).alias("centroid")), ["concept_id"], "idx")
    at = lambda k: F.timestamp_micros(F.unix_micros("t0") + (F.col("idx") + k) * int(days * scores.DAY))
    return windows.select("concept_id", "idx", at(0).alias("window_start"), at(1).alias("window_end"), F.col("n").alias("support")).join(moved, ["concept_id", "idx"])
