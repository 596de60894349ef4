"""Read-only views over the memory: timelines, concepts, distilled nodes, drift, recall cards, counts and integrity."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import versions
from ..durable import durable
from ..functions import text
from . import graph, memory, store


def with_members(nodes: DataFrame, edges: DataFrame, level: int, node_type: str) -> DataFrame:
    """Nodes of a level with members: how many they contain, 0 for none."""
    held = edges.where((F.col("parent_level") == level) & (F.col("relation") == "contains")).groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("members"))
    mine = nodes.where((F.col("level") == level) & (F.col("node_type") == node_type))
    return mine.join(held, "node_id", "left").withColumn("members", F.coalesce("members", F.lit(0).cast("long")))


def timeline(nodes: DataFrame, edges: DataFrame, limit: int = 50) -> DataFrame:
    """Episodes from the oldest on, undated ones last: node_id, title, time_start, time_end, members."""
    rows = with_members(nodes, edges, 2, "episode").orderBy(F.asc_nulls_last("time_start"), "node_id")
    return rows.limit(limit).select("node_id", "title", "time_start", "time_end", "members")


def concepts(nodes: DataFrame, edges: DataFrame, top: int = 20) -> DataFrame:
    """Concepts, the most central first, unranked ones last: node_id, title, centrality, members."""
    rows = with_members(nodes, edges, 3, "concept").orderBy(F.desc_nulls_last("centrality"), "node_id")
    return rows.limit(top).select("node_id", "title", F.coalesce("centrality", F.lit(0.0)).alias("centrality"), "members")


def top_central(nodes: DataFrame, top: int = 3) -> DataFrame:
    """The most central nodes of all levels."""
    return nodes.where("centrality is not null").orderBy(F.desc("centrality"), "node_id").limit(top).select("node_id", "level", "title", "centrality")


def joined_text(chunks: DataFrame, key: str, order: str, limit: int, column: str = "text") -> DataFrame:
    """``key``, text: chunks in ``order``, two line ends between them, cut to ``limit`` characters.

    Every chunk but the last takes two characters at least, so no more than ``limit`` / 2 + 1 of them can count, however many a key has.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    rows = chunks.withColumn("__n", place).where(F.col("__n") <= limit // 2 + 1)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", F.coalesce(column, F.lit("")).alias("text")))), lambda s: s["text"]), "\n\n")
    return rows.groupBy(key).agg(F.substring(whole, 1, limit).alias("text"))


def first_uris(evidence: DataFrame, chunks: DataFrame, limit: int = 3, key: str = "root_id") -> DataFrame:
    """``key``, evidence_source_uris: the first distinct source uris below it, in order."""
    rows = evidence.join(chunks.select("chunk_id", "source_uri"), "chunk_id").select(key, "source_uri").distinct()
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("source_uri"))).where(F.col("__n") <= limit)
    return first.groupBy(key).agg(F.array_sort(F.collect_list("source_uri")).alias("evidence_source_uris"))


def forgetting(nodes: DataFrame, evidence: DataFrame, chunks: DataFrame, now: Column, usage: DataFrame | None = None, levels: list[int] | None = None, half_life: float = 30.0, min_support: int = 1, top: int | None = None) -> DataFrame:
    """Nodes of the levels (3 without any) by forgetting risk; ungrounded ones never appear."""
    mine = nodes.where(F.col("level").isin(levels or [3]))
    touched = memory.last_touch(mine, evidence, chunks, usage)
    risks = memory.forgetting_risk(touched, now, half_life, min_support)
    uris = first_uris(evidence, chunks).withColumnRenamed("root_id", "node_id")
    found = risks.join(uris, "node_id", "left")
    columns = ["node_id", "level", "node_type", "title", "importance", "staleness", "risk", "confidence", "support", "last_touch", "evidence_source_uris"]
    return memory.by_risk(found.select(columns), top)


#: Characters of evidence behind a recall card (fixed value).
CARD_CHARS = 4000


def recall_cards(risks: DataFrame, evidence: DataFrame, chunks: DataFrame, cached: DataFrame | None = None, generate=None, version: str = "1") -> DataFrame:
    """A card for each row of ``risks``: question, answer, generated_by and the fingerprint it is kept by.

    ``cached`` (node_id, question, answer, generated_by, fingerprint): a card whose fingerprint hasn't changed is used again. Others come
    from ``generate`` (title column, evidence column -> struct(question, answer) or null), else from a template.
    """
    wanted = evidence.join(risks.select(F.col("node_id").alias("root_id")), "root_id", "left_semi")
    texts = joined_text(wanted.join(chunks.select("chunk_id", "text"), "chunk_id"), "root_id", "chunk_id", CARD_CHARS).withColumnRenamed("root_id", "node_id").withColumnRenamed("text", "__text")
    rows = risks.join(texts, "node_id", "left").withColumn("__text", F.coalesce("__text", F.lit("")))
    rows = rows.withColumn("fingerprint", F.sha2(F.concat_ws("\x1f", F.lit(version), F.coalesce("title", F.lit("")), "__text"), 256))
    question = F.concat(F.lit("What do you remember about: "), F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("this memory")), F.lit("?"))
    answer = F.when(F.trim("__text") != "", text.preview(F.col("__text"), 220, "…"))
    by_model = F.col("__made.question").isNotNull()
    card = F.struct(F.coalesce("__made.question", question).alias("question"), F.when(by_model, F.col("__made.answer")).otherwise(answer).alias("answer"), F.when(by_model, "llm").otherwise("fallback").alias("generated_by"))
    # Only cards that aren't kept are asked for.
    again = None
    if cached is not None:
        old = cached.select("node_id", F.col("fingerprint").alias("__fp"), F.struct("question", "answer", "generated_by").alias("__card"))
        rows = rows.join(old, "node_id", "left")
        again = rows.where("__fp = fingerprint")
        rows = rows.where("not coalesce(__fp = fingerprint, false)")
    made = generate(F.col("title"), F.col("__text")) if generate else F.lit(None).cast("struct<question:string,answer:string>")
    rows = rows.withColumn("__made", made).withColumn("__card", card)
    kept = ["node_id", "level", "node_type", "title", "risk", "confidence", "evidence_source_uris", "fingerprint"]
    found = rows.select(*kept, "__card.*")
    return memory.by_risk(found if again is None else found.unionByName(again.select(*kept, "__card.*")))


CARD = "node_id bigint, question string, answer string, generated_by string, fingerprint string"


def read_cards(spark: SparkSession, root: str) -> DataFrame:
    """The kept cards below ``root``, one per node; none before the first."""
    manifest = versions.load(spark, root)
    return spark.read.schema(CARD).parquet(f"{root}/{manifest['live']}") if manifest else spark.createDataFrame([], CARD)


def keep_cards(spark: SparkSession, root: str, risks: DataFrame, evidence: DataFrame, chunks: DataFrame, nodes: DataFrame, generate=None, version: str = "1") -> DataFrame:
    """The cards of ``risks`` as ``recall_cards`` makes them, with the table of cards below ``root`` brought up to date.

    A kept card is used again while its title, its evidence and ``version`` stay as they were; others take its place. Cards of nodes that ``nodes`` (node_id) lacks go, those of
    nodes that aren't asked for now stay. The table is written beside the old one and switched, so a run that dies changes nothing and asks again only for what it didn't keep.
    """
    manifest, stored = versions.load(spark, root), read_cards(spark, root)
    found = durable(recall_cards(risks, evidence, chunks, stored, generate, version))
    rows = store.replace_rows(stored.join(nodes.select("node_id").distinct(), "node_id", "left_semi"), found.select([c.split()[0] for c in CARD.split(", ")]), "node_id")
    live = f"cards-{uuid.uuid4().hex[:12]}"
    rows.write.parquet(f"{root}/{live}")
    versions.commit(spark, root, {"live": live, "old": manifest and manifest["live"]})
    for name in versions.folders(spark, root):
        # What the switch replaced stays for readers that are under way.
        if name not in (live, manifest and manifest["live"]):
            versions.remove(spark, f"{root}/{name}")
    return memory.by_risk(found)


def distilled_view(distilled: DataFrame, nodes: DataFrame, evidence: DataFrame, chunks: DataFrame, top: int | None = None) -> DataFrame:
    """Distilled nodes (node_id, level, summary, core (array), confidence), the most compressed first."""
    full = evidence.groupBy(F.col("root_id").alias("node_id")).agg(F.count("*").alias("full_count"))
    first = chunks.select(F.col("chunk_id").alias("__first"), F.col("source_uri").alias("evidence_source_uri"))
    rows = distilled.join(nodes.select("node_id", "node_type", "title"), "node_id", "left").join(full, "node_id", "left").withColumn("__first", F.try_element_at("core", F.lit(1))).join(first, "__first", "left")
    rows = rows.withColumn("core_count", F.size("core").cast("long")).withColumn("full_count", F.coalesce("full_count", F.lit(0).cast("long")))
    rows = rows.withColumn("compression_ratio", F.coalesce(F.try_divide("core_count", "full_count"), F.lit(1.0))).orderBy("compression_ratio", "node_id")
    rows = rows if top is None else rows.limit(top)
    return rows.select("node_id", "level", "node_type", "title", "summary", "core_count", "full_count", "compression_ratio", "confidence", "evidence_source_uri")


def drift_view(windows: DataFrame, nodes: DataFrame, evidence: DataFrame, chunks: DataFrame, top: int | None = None, min_support: int = 1) -> DataFrame:
    """Concepts by overall drift, with their windows in order; ``windows``: concept_id, idx, window_start, window_end, support, drift."""
    step = F.struct("window_start", "window_end", F.col("drift").alias("drift_metric"), "support")
    series = windows.groupBy("concept_id").agg(F.array_sort(F.collect_list(step)).alias("windows"))  # a concept's own windows
    uri = first_uris(evidence, chunks, 1).select(F.col("root_id").alias("concept_id"), F.element_at("evidence_source_uris", 1).alias("evidence_source_uri"))
    named = nodes.where("level = 3").select(F.col("node_id").alias("concept_id"), "title")
    rows = memory.relearned(windows).join(named, "concept_id").join(series, "concept_id").join(uri, "concept_id", "left")
    columns = ["concept_id", "title", "overall_drift", F.col("n_windows").alias("window_count"), "support", "confidence", F.col("relearned").alias("relearning"), "span_start", "span_end", "evidence_source_uri", "windows"]
    return memory.by_drift(rows, top, min_support).select(columns)


def memory_stats(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, node_embeddings: DataFrame | None = None, distilled: DataFrame | None = None, drift: DataFrame | None = None) -> DataFrame:
    """name, n: nodes in all, by level and by type, edges, relations, vectors, distilled nodes, drift windows, unsupported nodes, dangling edges."""
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    counted = [("total_nodes", nodes), ("edges", edges), ("relates_edges", edges.where("relation = 'relates_to'")), ("node_embeddings", node_embeddings), ("distilled_nodes", distilled), ("drift_snapshots", drift)]
    counted += [("unsupported", graph.unsupported_nodes(nodes, edges, chunks)), ("dangling", graph.dangling_edges(edges, nodes, chunks))]
    out = nodes.groupBy(F.concat(F.lit("level_"), F.col("level").cast("string")).alias("name")).agg(F.count("*").alias("n"))
    out = out.unionByName(nodes.groupBy(F.concat(F.lit("type_"), F.col("node_type")).alias("name")).agg(F.count("*").alias("n")))
    for name, df in counted:
        if df is not None:
            out = out.unionByName(one(name, df))
    return out
