"""Streaming forms of the usage log and of event sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores

#: Decayed weights are summed as if seen at this instant and scaled when read.
EPOCH = "2024-01-01 00:00:00"


def running_strength(events: DataFrame, half_life: float = 30.0, epoch: str = EPOCH) -> DataFrame:
    """target_kind, target_id, n, last_event_at, at_epoch: decay is a factor per event, so sums add up over batches.

    Weights stay finite for some hundred half-lives around ``epoch``. State has one row per target and no expiry.
    """
    age = (F.unix_micros("event_at") - F.unix_micros(F.lit(epoch).cast("timestamp"))) / scores.DAY
    return events.groupBy("target_kind", "target_id").agg(
        F.count("*").alias("n"), F.max("event_at").alias("last_event_at"), F.sum(F.col("weight") * F.pow(F.lit(2.0), age / half_life)).alias("at_epoch")
    )


def strength_at(running: DataFrame, now: Column, half_life: float = 30.0, epoch: str = EPOCH) -> DataFrame:
    """The running sums with strength at ``now``, which must not lie before an event."""
    age = (F.unix_micros(now) - F.unix_micros(F.lit(epoch).cast("timestamp"))) / scores.DAY
    return running.withColumn("strength", F.col("at_epoch") * F.pow(F.lit(0.5), age / half_life)).drop("at_epoch")


def sessions(events: DataFrame, gap_hours: int = 24, late: str = "7 days", key: str = "project", ts: str = "ts") -> DataFrame:
    """``key``, time_start, time_end, n_events of sessions whose gaps are at most ``gap_hours``; later rows than ``late`` are not taken.

    Undated events belong to no session here.
    """
    # A session window ends before its gap does: a microsecond more lets a gap of exactly that length pass.
    gap = f"{gap_hours} hours 1 microsecond"
    dated = events.where(F.col(ts).isNotNull()).withWatermark(ts, late)
    found = dated.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("time_start"), F.max(ts).alias("time_end"), F.count("*").alias("n_events"))
    return found.select(key, "time_start", "time_end", "n_events")
