"""Frames that outlive their lineage, and numbers for rows in an order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's checkpoint folder."""
    return f"{_checkpoints(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder (``spark.checkpoint.dir``; where that is unset, on one machine, a temporary one)."""
    _checkpoints(df.sparkSession)
    return df.checkpoint()


def _checkpoints(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="quillstone-"))
    return context._jsc.sc().getCheckpointDir().get()


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in ``order``, without bringing all rows to one task."""
    at = F.monotonically_increasing_id()
    placed = durable(df.orderBy(*order).withColumn("__part", F.shiftright(at, 33)).withColumn("__at", at.bitwiseAND((1 << 33) - 1)))
    sizes = sorted((r["__part"], r["n"]) for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect())  # a row per partition
    before, shifts = 0, []
    for part, n in sizes:
        shifts.append((part, before + 1))
        before += n
    table = df.sparkSession.createDataFrame(shifts, "__part bigint, __shift bigint")
    return placed.join(F.broadcast(table), "__part").withColumn(name, F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")
