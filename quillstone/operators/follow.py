"""Builds that follow changes: sessions and relations made anew only where the events below them changed, as changes of tables.

A change is ``gone`` and ``came`` rows; ``applied`` brings it to whole tables, ``build`` makes the same tables from all events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import durable
from ..functions import text
from . import graph, memory, store

_LINK = ["parent_level", "parent_id", "child_level", "child_id", "relation"]


def projects(nodes: DataFrame, *more) -> DataFrame:
    """event_id, project of events, by what they were taken from, and ``more`` columns of them."""
    # The key names its parts many times, which would read the JSON again each time.
    said = lambda meta: F.struct(*[F.get_json_object(meta, f"$.{c}").alias(c) for c in ("source_type", "source_uri")])
    key = text.once(F.col("metadata_json"), lambda meta: text.once(said(meta), lambda m: text.project_key(m["source_type"], m["source_uri"])))
    return nodes.where("level = 1 and node_type = 'event'").select(F.col("node_id").alias("event_id"), key.alias("project"), *more)


def episodes(nodes: DataFrame, edges: DataFrame, changed: DataFrame, gap_hours: float = 24.0) -> dict[str, DataFrame]:
    """What becomes of the episodes after events changed: ``gone`` (node_id), ``came`` (rows of ``nodes``), ``gone_edges`` and ``came_edges``.

    ``nodes`` and ``edges``: with the events as they are now and the episodes as they were; edges of events that went may stand or be gone. ``changed``: event_id,
    project of events that came, went or changed, a row for the project that each is in and one for that it was in. Only projects named there are
    cut into sessions; an episode whose fingerprint is still desired stays as it is.
    """
    names = changed.select("project").distinct()
    events = durable(projects(nodes, F.col("time_start").alias("ts"), "title").join(names, "project", "left_semi"))
    held = edges.where("parent_level = 2 and child_level = 1 and relation = 'contains'")
    hit = events.select(F.col("event_id").alias("child_id")).union(changed.select("event_id")).distinct()
    old = nodes.where("level = 2 and node_type = 'episode'")
    mine = held.join(hit, "child_id", "left_semi").select(F.col("parent_id").alias("node_id"))
    empty = old.select("node_id").join(held.select(F.col("parent_id").alias("node_id")), "node_id", "left_anti")
    mine = durable(old.join(mine.union(empty), "node_id", "left_semi"))
    made = memory.episode_nodes(memory.sessionise(events, gap_hours), gap_hours=gap_hours)
    made = durable(made.withColumn("level", F.lit(2)).withColumn("node_type", F.lit("episode")))
    kept = durable(store.reconciled(mine, made.select([c for c in nodes.columns if c in made.columns]), taken=nodes).select(nodes.columns))
    gone = mine.join(kept.select("node_id"), "node_id", "left_anti").select("node_id")
    came = kept.join(mine.select("node_id"), "node_id", "left_anti")
    ends = gone.withColumnRenamed("node_id", "parent_id")
    below = edges.where("parent_level = 2").join(ends, "parent_id", "left_semi")
    above = edges.where("child_level = 2").join(ends.withColumnRenamed("parent_id", "child_id"), "child_id", "left_semi")
    fresh = made.select("fingerprint", F.explode("members").alias("child_id")).join(came.select("fingerprint", F.col("node_id").alias("parent_id")), "fingerprint")
    fresh = fresh.select(F.lit(2).alias("parent_level"), "parent_id", F.lit(1).alias("child_level"), "child_id", F.lit("contains").alias("relation"))
    return {"gone": gone, "came": came, "gone_edges": below.select(_LINK).union(above.select(_LINK)).distinct(), "came_edges": fresh}


def links(edges: DataFrame, gone: DataFrame, came: DataFrame) -> dict[str, DataFrame]:
    """What becomes of the relations of concepts where memberships went and came: ``gone_edges``, ``came_edges`` (a relation of another weight is in both).

    ``edges``: all edges as they were, with the relations of then; ``gone``, ``came``: edges that went and came. Only episodes that hold an event of these are
    counted, as they were and as they are, and relations move by the difference.
    """
    inside, keys = "relation = 'contains' and child_level = 1 and parent_level in (2, 3)", ["parent_level", "parent_id", "child_id"]
    before, went, new = (df.where(inside).select(keys) for df in (edges, gone, came))
    changed = durable(went.withColumn("came", F.lit(0)).union(new.withColumn("came", F.lit(1))).groupBy(keys).agg(F.max("came").alias("came")))
    events = changed.select("child_id").distinct()
    # Episodes that hold a changed event, as they were and as they are, and their events.
    held = before.where("parent_level = 2").union(changed.where("parent_level = 2").select(keys)).select(F.col("parent_id").alias("episode"), "child_id")
    mine = durable(held.join(events, "child_id", "left_semi").select("episode").distinct())
    around = held.join(mine, "episode", "left_semi").select("child_id").distinct()
    # Each membership of these events once: whether it was there, and is now; a change says the latter.
    was = before.withColumn("was", F.lit(1)).withColumn("came", F.lit(None).cast("int"))
    both = was.union(changed.select(*keys, F.lit(0).alias("was"), "came")).join(around, "child_id", "left_semi")
    at = lambda level, name, end: (
        both.where(F.col("parent_level") == level).groupBy(F.col("child_id"), F.col("parent_id").alias(name)).agg(F.max("was").alias(f"was_{end}"), F.coalesce(F.max("came"), F.max("was")).alias(f"now_{end}"))
    )
    met = at(3, "concept", "c").join(at(2, "episode", "e").join(mine, "episode", "left_semi"), "child_id")
    members = met.groupBy("episode", "concept").agg(F.max(F.col("was_c") * F.col("was_e")).alias("was"), F.max(F.col("now_c") * F.col("now_e")).alias("now"))
    moved = graph.cooccurrence_change(members.where("was + now > 0"), "episode", "concept").select(F.col("a").alias("parent_id"), F.col("b").alias("child_id"), F.col("change").cast("double").alias("__d"))
    old = edges.where("relation = 'relates_to'").select("parent_id", "child_id", F.col("weight").alias("__w"))
    both = durable(moved.join(old, ["parent_id", "child_id"], "left").withColumn("weight", F.coalesce("__w", F.lit(0.0)) + F.col("__d")))
    link = [F.lit(3).alias("parent_level"), "parent_id", F.lit(3).alias("child_level"), "child_id", F.lit("relates_to").alias("relation")]
    return {"gone_edges": both.where("__w is not null").select(link), "came_edges": both.where("weight > 0").select(*link, "weight")}


def applied(nodes: DataFrame, edges: DataFrame, change: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after a change of ``episodes`` or ``links``."""
    if "gone" in change:
        nodes = nodes.join(change["gone"], "node_id", "left_anti").select(nodes.columns).unionByName(change["came"])
    return nodes, edges.join(change["gone_edges"], _LINK, "left_anti").select(edges.columns).unionByName(change["came_edges"], allowMissingColumns=True)


def drop_events(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without events that went (event_id) and the edges that touch them."""
    left = store.delete_nodes(gone.select(F.col("event_id").alias("node_id")), nodes, edges)
    return left["nodes"], left["edges"]


