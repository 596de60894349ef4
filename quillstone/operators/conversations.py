"""Chat history over messages (conversation_id, turn_index, role, text, abstention_reason)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def history(conversations: DataFrame, messages: DataFrame, limit: int | None = None) -> DataFrame:
    """Conversations with n_messages and next_turn, the latest first; of equal times the newest."""
    counts = messages.groupBy("conversation_id").agg(F.count("*").alias("n_messages"), (F.max("turn_index") + 1).alias("next_turn"))
    rows = conversations.join(counts, "conversation_id", "left").withColumn("n_messages", F.coalesce("n_messages", F.lit(0).cast("long")))
    rows = rows.withColumn("next_turn", F.coalesce("next_turn", F.lit(0).cast("long"))).orderBy(F.desc("updated_at"), F.desc("conversation_id"))
    return rows if limit is None else rows.limit(limit)


def renamed(conversations: DataFrame, conversation_id: int, title: str) -> DataFrame:
    """Conversations with one's title changed."""
    return conversations.withColumn("title", F.when(F.col("conversation_id") == conversation_id, F.lit(title)).otherwise(F.col("title")))


def cleared(conversations: DataFrame, messages: DataFrame, conversation_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(conversations, messages) without one conversation, or without any."""
    keep = F.lit(False) if conversation_id is None else F.col("conversation_id") != conversation_id
    return conversations.where(keep), messages.where(keep)


def with_turn(conversations: DataFrame, messages: DataFrame, conversation_id: int, question: str, payload: dict, now, title: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(conversations, messages) after a turn: a question and the answer of a payload; the conversation is made where it isn't there.

    Its title is the given one, else made from the first question.
    """
    spark = messages.sparkSession
    turn = next_turn(messages.where(F.col("conversation_id") == conversation_id)).first()
    turn = 0 if turn is None else turn["next_turn"]
    rows = [(conversation_id, turn, "user", question, None, None, False, None), (conversation_id, turn, "assistant", payload["answer"], json.dumps(payload["evidence"]), payload["abstention_reason"], payload["truncated"], payload["model"])]
    said = spark.createDataFrame(rows, "conversation_id bigint, turn_index bigint, role string, text string, evidence_json string, abstention_reason string, truncated boolean, model string")
    at = F.lit(now).cast(conversations.schema["updated_at"].dataType)
    old = conversations.withColumn("updated_at", F.when(F.col("conversation_id") == conversation_id, at).otherwise(F.col("updated_at")))
    if conversations.where(F.col("conversation_id") == conversation_id).isEmpty():
        first = spark.range(1).select(F.lit(conversation_id).cast("bigint").alias("conversation_id"), (F.lit(title) if title else text.conversation_title(F.lit(question))).alias("title"), at.alias("updated_at"))
        old = old.unionByName(first, allowMissingColumns=True)
    return old, messages.unionByName(said, allowMissingColumns=True)


def shown(messages: DataFrame, conversation_id: int) -> DataFrame:
    """The messages of one conversation in order, a question before its answer."""
    return messages.where(F.col("conversation_id") == conversation_id).orderBy("turn_index", F.when(F.col("role") == "user", 0).otherwise(1))


def turn_pairs(messages: DataFrame) -> DataFrame:
    """conversation_id, turn_index, question, answer."""
    side = lambda role, name: messages.where(F.col("role") == role).select("conversation_id", "turn_index", F.col("text").alias(name))
    return side("user", "question").join(side("assistant", "answer"), ["conversation_id", "turn_index"])


def last_turns(pairs: DataFrame, n: int = 8) -> DataFrame:
    """The latest ``n`` turns that weren't abstained; 0 gives none."""
    live = pairs.where(F.col("abstention_reason").isNull()) if "abstention_reason" in pairs.columns else pairs
    order = Window.partitionBy("conversation_id").orderBy(F.desc("turn_index"))
    return live.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def next_turn(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conversation_id").agg((F.coalesce(F.max("turn_index"), F.lit(-1)) + 1).alias("next_turn"))
