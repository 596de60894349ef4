"""Joins that keep keys of many rows out of a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, share: int = 1000) -> DataFrame:
    """``rows`` joined with ``groups``, a written table of one row per ``key`` whose ``size`` counts its rows.

    Groups that hold more than one row in ``share`` are fewer than ``share``, so they are broadcast; only
    rows of the other groups are shuffled. ``rows`` is read twice. A null key joins nothing.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    # Divided, as a product could overflow; the bound holds all the same.
    is_hot = F.col(size) > total // share
    hot = F.broadcast(groups.where(is_hot))
    cold = rows.join(F.broadcast(groups.where(is_hot).select(key)), key, "left_anti").join(groups.where(~is_hot), key)
    return rows.join(hot, key).unionByName(cold)


def with_salt(rows: DataFrame, groups: DataFrame, key: str, size: str, place: str, share: int = 1000) -> tuple[DataFrame, DataFrame]:
    """``rows`` and ``groups`` with a column ``salt``, to be joined on ``key`` and ``salt``.

    A group above one row in ``share`` is dealt by ``place`` over so many salts that each holds about that
    share; ``groups`` repeats such a group once per salt, fewer than 2 x ``share`` rows in all.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    part = max(total // share, 1)
    salts = F.ceil(F.col(size) / part).cast("int")
    hot = groups.where(F.col(size) > part).select(key, salts.alias("salts"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(place), F.col("salts")).cast("int"), F.lit(0))).drop("salts")
    return dealt, groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
