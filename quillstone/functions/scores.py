"""Score arithmetic as Column expressions. Times are timestamps, ages are in days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000  # microseconds

# Weights of (vector, lexical, recency, usage) for chunks and (vector, lexical, recency, centrality) for nodes.
CHUNK_WEIGHTS = {
    "balanced": (0.55, 0.30, 0.15, 0.0),
    "relevant": (0.70, 0.25, 0.05, 0.0),
    "recent": (0.35, 0.20, 0.45, 0.0),
    "usage": (0.55, 0.25, 0.05, 0.15),
}
NODE_WEIGHTS = {
    "balanced": (0.55, 0.25, 0.10, 0.10),
    "relevant": (0.70, 0.20, 0.05, 0.05),
    "recent": (0.30, 0.20, 0.40, 0.10),
    "usage": (0.70, 0.20, 0.05, 0.05),
}
#: Default weight of a usage event by type (fixed values).
EVENT_WEIGHTS = {"retrieval_hit": 1.0, "open": 2.0, "accepted_answer": 3.0}


def age_days(ts: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(ts)) / F.lit(float(DAY))


def recency(ts: Column, now: Column, scale: float = 45.0) -> Column:
    """exp(-whole days / scale); 0 without a time."""
    value = F.exp(-F.greatest(F.floor(age_days(ts, now)), F.lit(0)) / F.lit(scale))
    return F.when(ts.isNull(), F.lit(0.0)).otherwise(value)  # greatest() skips nulls


def decayed(weight: Column, ts: Column, now: Column, half_life: float = 30.0) -> Column:
    """weight * 0.5 ** (age / half_life); no age below 0; null without a time."""
    return F.when(ts.isNotNull(), weight * F.pow(F.lit(0.5), F.greatest(age_days(ts, now), F.lit(0.0)) / F.lit(half_life)))


def saturated(strength: Column, saturation: float = 3.0) -> Column:
    return F.when(strength > 0, strength / (strength + F.lit(saturation))).otherwise(F.lit(0.0))


def staleness(ts: Column, now: Column, half_life: float = 30.0) -> Column:
    """1 - 0.5 ** (age / half_life); 1 without a time."""
    value = F.lit(1.0) - F.pow(F.lit(0.5), F.greatest(age_days(ts, now), F.lit(0.0)) / F.lit(half_life))
    return F.when(ts.isNull(), F.lit(1.0)).otherwise(value)


def unit_cosine(cosine: Column) -> Column:
    return F.coalesce((cosine + 1) / 2, F.lit(0.0))


def confidence(support: Column) -> Column:
    return F.least(F.lit(1.0), support / F.lit(3.0))


def core_size(ratio: float, n: Column) -> Column:
    """max(1, ratio * n rounded half to even)."""
    return F.greatest(F.lit(1), F.bround(F.lit(ratio) * n).cast("int"))


def latest(*raw: Column) -> Column:
    """The original text of the latest parseable time; of equal ones the first."""
    items = [F.struct(x.try_cast("timestamp").alias("ts"), F.lit(-k).alias("k"), x.alias("raw")) for k, x in enumerate(raw)]
    return F.array_max(F.filter(F.array(*items), lambda s: s["ts"].isNotNull()))["raw"]


def event_weight(weight: Column | None, event_type: Column) -> Column:
    """The given weight, else the type's, else 1."""
    by_type = F.lit(1.0)
    for name, w in EVENT_WEIGHTS.items():
        by_type = F.when(event_type == name, F.lit(w)).otherwise(by_type)
    return by_type if weight is None else F.coalesce(weight, by_type)
