"""Upper levels of the memory out of its events: each step a function of tables, reconciled by fingerprint.

A row whose fingerprint is still desired stays as it is, so names that a model gave it survive; others are made or go. Each step's
tables are written, so that the next one doesn't plan it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import durable
from ..functions import scores, text
from . import graph, memory, store
from .answers import Guarded

NODE = "node_id bigint, level int, node_type string, title string, content string, time_start timestamp, time_end timestamp, centrality double, fingerprint string, metadata_json string"


def _settled(nodes: DataFrame, edges: DataFrame, desired: DataFrame, level: int, node_type: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) whose nodes of a level are those of ``desired`` (fingerprint, title, content, members, ...), each with its members' edges."""
    mine = nodes.where((F.col("level") == level) & (F.col("node_type") == node_type))
    wanted = desired.withColumn("level", F.lit(level)).withColumn("node_type", F.lit(node_type))
    kept = durable(store.reconciled(mine, wanted.select([c for c in nodes.columns if c in wanted.columns]), taken=nodes).select(nodes.columns))
    gone = mine.join(kept.select("node_id"), "node_id", "left_anti").select("node_id")
    left = store.delete_nodes(gone, nodes, edges)
    ids = kept.select("fingerprint", F.col("node_id").alias("parent_id"))
    held = wanted.select("fingerprint", F.explode("members").alias("child_id")).join(ids, "fingerprint")
    fresh = held.select(F.lit(level).alias("parent_level"), "parent_id", F.lit(1).alias("child_level"), "child_id", F.lit("contains").alias("relation"))
    others = left["nodes"].where(~((F.col("level") == level) & (F.col("node_type") == node_type)))
    return durable(others.unionByName(kept)), durable(store.insert_edges(left["edges"], fresh))


def _events(nodes: DataFrame) -> DataFrame:
    return nodes.where("level = 1 and node_type = 'event'")


def episodes(nodes: DataFrame, edges: DataFrame, gap_hours: float = 24.0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with an episode for each session of a project's events."""
    project = text.project_key(F.get_json_object("metadata_json", "$.source_type"), F.get_json_object("metadata_json", "$.source_uri"))
    events = _events(nodes).select(F.col("node_id").alias("event_id"), project.alias("project"), F.col("time_start").alias("ts"), "title")
    made = memory.episode_nodes(memory.sessionise(events, gap_hours), gap_hours=gap_hours)
    return _settled(nodes, edges, made, 2, "episode")


def concepts(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, model: str, theta: float = 0.80) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with a concept for each cluster of events that have a vector of ``model`` (node_id, model, vector)."""
    titles = _events(nodes).select("node_id", "title")
    rows = durable(vectors.where(F.col("model") == model).join(titles.select("node_id"), "node_id", "left_semi").select("node_id", "vector"))
    clusters = memory.leader_clusters(rows, theta).join(rows, "node_id")
    return _settled(nodes, edges, memory.concept_nodes(clusters, titles, model, theta), 3, "concept")


def named(nodes: DataFrame, concepts_titles: DataFrame, model: Guarded, ask: str = "Name what these have in common in at most six words:") -> DataFrame:
    """``nodes`` whose concepts bear the names that a model gives them; the others, and those of names that are no labels, keep theirs.

    ``concepts_titles``: node_id, titles (the representative ones, eight at most). The model is asked where the driver is, a concept at a time.
    """
    said = []
    for r in concepts_titles.toLocalIterator():
        answer = model.says(ask + "\n" + "\n".join(r["titles"]))
        if answer is None:
            break
        line = next(iter(answer.strip().strip("\"'").splitlines()), "").strip()
        said.append((r["node_id"], line))
    found = nodes.sparkSession.createDataFrame(said, "node_id bigint, __name string").where(text.valid_label(F.col("__name")))
    return nodes.join(found, "node_id", "left").withColumn("title", F.coalesce("__name", "title")).select(nodes.columns)


def links(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with the relations of concepts made anew and every node's centrality."""
    related = durable(graph.concept_links(edges))
    ranks = graph.pagerank(nodes.select("node_id"), graph.rank_edges(related))
    return durable(store.set_centrality(nodes, ranks)), related


def drift(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, model: str, days: float = 30.0) -> DataFrame:
    """concept_id, idx, window_start, window_end, support, drift of every concept's events."""
    held = edges.where("parent_level = 3 and relation = 'contains'").select(F.col("parent_id").alias("concept_id"), F.col("child_id").alias("node_id"))
    events = held.join(_events(nodes).select("node_id", F.col("time_start").alias("ts")), "node_id").join(vectors.where(F.col("model") == model).select("node_id", "vector"), "node_id")
    windows = memory.drift_windows(events, days)
    index = memory.window_index(events, days)
    return windows.join(memory.drift_metric(index, ["concept_id"], "idx", "vector"), ["concept_id", "idx"])


def distilled(nodes: DataFrame, evidence: DataFrame, vectors: DataFrame, model: str, embed: Callable[[Column], Column], summarise: Callable[[Column, Column], Column] | None = None, ratio: float = 0.5, version: str = "1") -> DataFrame:
    """A stand-in for each grounded node of levels 2 and 3: summary, vector, core (ascending chunk ids), confidence, fingerprint.

    ``evidence``: root_id, chunk_id; ``vectors``: chunk_id, model, vector. The summary is a model's (``summarise`` of title and content), else the content, else the title.
    """
    mine = nodes.where("level in (2, 3)")
    members = evidence.select(F.col("root_id").alias("node_id"), "chunk_id").join(mine.select("node_id"), "node_id", "left_semi").join(vectors.where(F.col("model") == model).select("chunk_id", "vector"), "chunk_id", "left")
    full = members.groupBy("node_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("__ids"))  # a node's own evidence
    core = memory.distill_core(members, ratio)
    said = summarise(F.col("title"), F.col("content")) if summarise else F.lit(None).cast("string")
    own = F.trim(F.coalesce(F.nullif(F.col("content"), F.lit("")), F.col("title"), F.lit("")))
    summary = F.coalesce(F.nullif(said, F.lit("")), F.nullif(own, F.lit("")), F.lit("(no summary)"))
    made = F.concat_ws("\x1f", F.lit(version), F.lit(f"{ratio:.4f}"), F.lit(model), F.col("node_id").cast("string"), F.array_join(F.transform("__ids", lambda x: x.cast("string")), ","))
    rows = mine.join(core, "node_id").join(full, "node_id").withColumn("summary", summary)
    return rows.select("node_id", "level", "summary", F.lit(model).alias("model"), embed(F.col("summary")).alias("vector"), "core", scores.confidence(F.col("full_size")).alias("confidence"), F.sha2(made, 256).alias("fingerprint"))


def health(tables: dict[str, DataFrame], connectors: dict[str, list[str]], model: str | None = None) -> dict:
    """What is there: rows by table, optional libraries, folders by connector, the embedding model."""
    from ..sources import files

    return {"tables": {name: df.count() for name, df in tables.items()}, "extras": {"embeddings": model is not None, "pdf": files.has_pdf(), "ocr": files.has_ocr()}, "models": {"embed": model}, "connectors": {k: len(v) for k, v in connectors.items()}}
