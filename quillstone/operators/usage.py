"""Usage events: strength, summaries and clearing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores


def summary(events: DataFrame, now: Column, half_life: float = 30.0) -> DataFrame:
    """target_kind, target_id, n, last_event_at, strength."""
    return events.groupBy("target_kind", "target_id").agg(
        F.count("*").alias("n"), F.max("event_at").alias("last_event_at"), F.sum(scores.decayed(F.col("weight"), F.col("event_at"), now, half_life)).alias("strength")
    )


def appended(events: DataFrame, fresh: DataFrame) -> DataFrame:
    """The log with new events (target_kind, target_id, event_type, event_at[, weight]); a weight that isn't given is its type's."""
    given = F.col("weight") if "weight" in fresh.columns else None
    return events.unionByName(fresh.withColumn("weight", scores.event_weight(given, F.col("event_type"))), allowMissingColumns=True)


def hits_of(chunk_ids: list[int], event_type: str, event_at) -> list[tuple]:
    """Rows of the log for the chunks of an answer, each once, in order: target_kind, target_id, event_type, event_at."""
    return [("chunk", c, event_type, event_at) for c in dict.fromkeys(chunk_ids)]


def stats(events: DataFrame, now: Column, top: int = 10, half_life: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """(events by type, the top targets by strength)."""
    return by_type(events).orderBy("event_type"), top_targets(summary(events, now, half_life), top)


def by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def top_targets(summaries: DataFrame, k: int) -> DataFrame:
    return summaries.orderBy(F.desc("strength"), "target_kind", "target_id").limit(k)


def clear(events: DataFrame, kind: str | None = None, ids: list[int] | None = None) -> DataFrame:
    """What is left; an empty list of ids clears nothing."""
    if ids is not None and not ids:
        return events
    hit = F.lit(True)
    if kind is not None:
        hit = hit & (F.col("target_kind") == kind)
    if ids is not None:
        hit = hit & F.col("target_id").isin(ids)
    return events.where(~hit)
