"""The corpus pipeline: stages over ``documents``, each written and read again.

Order: quality (documents scored below 0.3 go), exact deduplication, near
duplicates (one document of each class stays), benchmark decontamination
(documents that hold a passage of a benchmark item go), packing into sequences of
at most 1024 tokens. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import op3_decontamination, op4_packing, op6_exact_dedup, op8_jaccard_join, op9_quality, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the classifier rejects go; null and empty texts are judged like any."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return op9_quality.select(docs, labels)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of equal texts stays, of null and empty ones too; ties as there."""
    return op6_exact_dedup.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each class of near duplicates stays, the one of the smallest doc_id; texts without words stay."""
    return op8_jaccard_join.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents with a phrase of ten words of a benchmark item go; texts without words stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    marked = scratch.located(docs)
    hits = op3_decontamination.decontaminate(marked.select("doc_id", "text"), items).where("contaminated").select("__file", "__row")
    return marked.join(hits, ["__file", "__row"], "left_anti").transform(scratch.original, docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the pieces of all documents in their sequences; a null or empty text is its end token."""
    return op4_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", packing),
]

#: SQL can't express the classifier or the packing; tests/llm/test_pipeline.py holds stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``. Tables that a stage wrote for itself go when its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        since = scratch.mark()
        out = scratch.keep(stage(spark, docs, sf_dir), f"stage-{name}")
        scratch.release(spark, since, out)
        if before is not None:
            scratch.drop(before)
        docs = before = out
    return STAGES[-1][1](spark, docs, sf_dir)
