"""Retrieval and generation metrics, and the gates over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def first_correct_rank(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, rank: the 1-based place, among distinct uris in rank order, of the first expected one (null: none).

    ``ranked``: query_id, uri, rank; ``gold``: query_id, uri. Queries without gold are left out.
    """
    hit = unique_uris(ranked).join(gold.select("query_id", "uri").distinct(), ["query_id", "uri"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return gold.select("query_id").distinct().join(hit, "query_id", "left")


def unique_uris(ranked: DataFrame) -> DataFrame:
    """query_id, uri, rank: each uri where it comes first, numbered again from 1."""
    first = ranked.groupBy("query_id", "uri").agg(F.min("rank").alias("__rank"))
    return first.select("query_id", "uri", F.row_number().over(Window.partitionBy("query_id").orderBy("__rank", "uri")).alias("rank"))


def with_prefix(queries: DataFrame, prefix: str | None) -> DataFrame:
    """Queries whose text begins with a prefix, in any case of ASCII letters; ``%`` and ``_`` in it stand for any text and character."""
    return queries.where(F.col("query_text").ilike(f"{prefix}%")) if prefix else queries


def retrieval_metrics(first_ranks: DataFrame, top_k: int) -> DataFrame:
    """n_queries, recall, mrr, citation_hit_rate (the first uri is an expected one) and misses at ``top_k``; mrr counts deeper ranks too."""
    hit = F.coalesce(F.col("rank") <= top_k, F.lit(False))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return first_ranks.agg(
        F.count("*").alias("n_queries"),
        mean(F.when(hit, 1.0).otherwise(0.0)).alias("recall"),
        mean(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"),
        mean(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)).alias("citation_hit_rate"),
        F.count_if(~hit).alias("misses"),
    )


def generation_metrics(answers: DataFrame) -> DataFrame:
    """``answers``: cited (array<int>), n_evidence, cited_uris, gold_uris (array<string>), abstained. A query with gold uris is answerable.

    An answer is valid if it cites nothing unknown, an abstention always; abstained answers ground and cover nothing.
    """
    answerable, speaks = F.size("gold_uris") > 0, ~F.col("abstained")
    valid = F.col("abstained") | (F.size(text.split_citations(F.col("cited"), F.col("n_evidence"))["invalid"]) == 0)
    overlap = F.when(speaks & answerable, F.size(F.array_intersect("cited_uris", "gold_uris"))).otherwise(0)
    per = F.greatest(F.count_if(answerable), F.lit(1))
    mean = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    return answers.agg(
        F.count("*").alias("n_queries"),
        mean(valid).alias("citation_validity"),
        (F.count_if(overlap > 0) / per).alias("grounding"),
        (F.coalesce(F.sum(F.when(answerable, overlap / F.size(F.array_distinct("gold_uris")))), F.lit(0.0)) / per).alias("coverage"),
        mean(F.col("abstained") != answerable).alias("abstention_accuracy"),
    )


def compression_ratio(distilled: DataFrame) -> DataFrame:
    """Core evidence over full evidence; 1 without any."""
    return distilled.agg(F.coalesce(F.try_divide(F.sum("core_size"), F.sum("full_size")), F.lit(1.0)).alias("ratio"))


def modality_gate(text_recall: float, visual_recall: float, gap: float = 0.30) -> bool:
    return text_recall - visual_recall >= gap


def distill_gate(full_recall: float, core_recall: float, ratio: float, epsilon: float = 0.05, target: float = 0.5) -> bool:
    return full_recall - core_recall <= epsilon and ratio <= target
