"""Snapshot changes: every operator takes tables and returns the table as it should be."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import versions
from ..durable import numbered


def reconcile(stored: DataFrame, desired: DataFrame, key: str = "fingerprint") -> DataFrame:
    """``key``, action: created, kept or deleted."""
    left, right = stored.select(key).distinct().withColumn("__s", F.lit(True)), desired.select(key).distinct().withColumn("__d", F.lit(True))
    action = F.when(F.col("__s").isNull(), "created").when(F.col("__d").isNull(), "deleted").otherwise("kept")
    return left.join(right, key, "full_outer").select(key, action.alias("action"))


def source_changes(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """source_type, source_uri, state: new, changed or unchanged; the newest stored row of a source counts.

    A stored source without fingerprint but with the same timestamp is unchanged.
    """
    keys = ["source_type", "source_uri"]
    newest = Window.partitionBy(*keys).orderBy(F.desc("id"))
    canonical = stored.withColumn("__n", F.row_number().over(newest)).where("__n = 1").select(*keys, F.col("source_fingerprint").alias("__fp"), F.col("timestamp").alias("__ts"), F.lit(True).alias("__old"))
    same = (F.col("__fp") == F.col("source_fingerprint")) | (F.col("__fp").isNull() & F.col("__ts").eqNullSafe(F.col("timestamp")))
    state = F.when(F.col("__old").isNull(), "new").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("changed")
    return scanned.join(canonical, keys, "left").select(*keys, state.alias("state"))


SOURCE = ["source_type", "source_uri"]


def upsert_sources(stored: DataFrame, scanned: DataFrame, top: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(sources as they should be, ids whose chunks go) after a scan.

    ``stored``: id, source_type, source_uri, source_fingerprint, timestamp, title, metadata_json; ``scanned``: the same without id. Of
    several stored rows of a scanned source the newest stays. An unchanged one keeps its timestamp, and takes fingerprint,
    title and metadata only where it had no fingerprint; a changed one takes all, and its chunks go; new ones get the next ids. Sources that weren't scanned stay.
    ``top``: the highest id so far, where ``stored`` holds some sources only.
    """
    values = ["source_fingerprint", "timestamp", "title", "metadata_json"]
    touched = stored.join(scanned.select(SOURCE).distinct(), SOURCE, "left_semi")
    newest = Window.partitionBy(*SOURCE).orderBy(F.desc("id"))
    ranked = touched.withColumn("__n", F.row_number().over(newest))
    found = scanned.select(*SOURCE, *[F.col(c).alias(f"__{c}") for c in values])
    met = ranked.where("__n = 1").drop("__n").join(found, SOURCE)
    legacy = F.col("source_fingerprint").isNull()
    same = F.coalesce(F.col("source_fingerprint") == F.col("__source_fingerprint"), F.lit(False)) | (legacy & F.col("timestamp").eqNullSafe(F.col("__timestamp")))
    taken = {c: F.when(~same, F.col(f"__{c}")).when(legacy & F.lit(c != "timestamp"), F.col(f"__{c}")).otherwise(F.col(c)) for c in values}
    kept = met.select("id", *SOURCE, *[v.alias(c) for c, v in taken.items()])
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] if top is None else top
    new = numbered(scanned.join(stored.select(SOURCE).distinct(), SOURCE, "left_anti").dropDuplicates(SOURCE).select(*SOURCE, *values), "__id", *SOURCE)
    new = new.select((F.col("__id") + top).alias("id"), *SOURCE, *values)
    others = stored.select("id", *SOURCE, *values).join(scanned.select(SOURCE).distinct(), SOURCE, "left_anti")
    gone = ranked.where("__n > 1").select("id").unionByName(met.where(~same).select("id"))
    return others.unionByName(kept).unionByName(new), gone


def replace_chunks(chunks: DataFrame, vectors: DataFrame, gone: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, vectors) without those of the sources in ``gone`` (id), and with ``fresh`` (source_id, chunk_index, text, metadata_json) under new ids."""
    dead = chunks.join(gone.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi").select("chunk_id")
    top = chunks.agg(F.coalesce(F.max("chunk_id"), F.lit(0))).first()[0]
    new = numbered(fresh, "__id", "source_id", "chunk_index").withColumn("chunk_id", F.col("__id") + top).drop("__id")
    left = chunks.join(dead, "chunk_id", "left_anti")
    return left.unionByName(new.select(left.columns)), vectors.join(dead, "chunk_id", "left_anti")


def replace_rows(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Rows of every ``key`` that ``fresh`` has come from there (a chunk's or a node's vector, a recall card)."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def reconciled(stored: DataFrame, desired: DataFrame, key: str = "fingerprint", name: str = "node_id", taken: DataFrame | None = None) -> DataFrame:
    """Stored rows whose ``key`` is still desired, as they are, and the others of ``desired`` under the next ids; ``taken`` are other rows with ids."""
    kept = stored.join(desired.select(key).distinct(), key, "left_semi")
    top = (stored if taken is None else taken).agg(F.coalesce(F.max(name), F.lit(0))).first()[0]
    new = numbered(desired.join(stored.select(key).distinct(), key, "left_anti").dropDuplicates([key]), "__id", key)
    return kept.unionByName(new.withColumn(name, F.col("__id") + top).drop("__id"), allowMissingColumns=True)


def set_centrality(nodes: DataFrame, ranks: DataFrame) -> DataFrame:
    """Nodes with the centrality of ``ranks`` (node_id, centrality); those it lacks keep theirs."""
    new = ranks.select("node_id", F.col("centrality").alias("__new"))
    return nodes.join(new, "node_id", "left").withColumn("centrality", F.coalesce("__new", "centrality")).drop("__new").select(nodes.columns)


EDGE = ["parent_level", "parent_id", "child_level", "child_id", "relation"]


def insert_edges(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Edges that aren't there yet are added; stored ones stay as they are."""
    return stored.unionByName(fresh.dropDuplicates(EDGE).join(stored.select(EDGE), EDGE, "left_anti"), allowMissingColumns=True)


def delete_nodes(gone: DataFrame, nodes: DataFrame, edges: DataFrame, **side_tables: DataFrame) -> dict[str, DataFrame]:
    """All tables without the nodes in ``gone`` (node_id) and what hangs on them."""
    ids = gone.select("node_id").distinct()
    parent, child = ids.withColumnRenamed("node_id", "parent_id"), ids.withColumnRenamed("node_id", "child_id")
    upper = edges.where("parent_level <> 0").join(parent, "parent_id", "left_anti").unionByName(edges.where("parent_level = 0"))
    left = upper.where("child_level <> 0").join(child, "child_id", "left_anti").unionByName(upper.where("child_level = 0"))
    out = {"nodes": nodes.join(ids, "node_id", "left_anti"), "edges": left}
    for name, table in side_tables.items():
        key = "concept_id" if "concept_id" in table.columns else "node_id"
        out[name] = table.join(ids.withColumnRenamed("node_id", key), key, "left_anti")
    return out


def pending(rows: DataFrame, stored: DataFrame, model: str, key: str = "chunk_id") -> DataFrame:
    """Rows without a vector of ``model``."""
    return rows.join(stored.where(F.col("model") == model).select(key), key, "left_anti")


def upsert_eval_queries(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """By exact text: the lowest id stays and takes the fresh sources; new texts get the next ids, in order of the text."""
    first = Window.partitionBy("query_text").orderBy("id")
    canonical = stored.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    new = fresh.dropDuplicates(["query_text"]).select("query_text", F.col("expected_source_uris").alias("__uris"))
    kept = canonical.join(new, "query_text", "left").select("id", "query_text", F.coalesce("__uris", "expected_source_uris").alias("expected_source_uris"))
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    added = numbered(new.join(canonical.select("query_text"), "query_text", "left_anti"), "__id", "query_text")
    return kept.unionByName(added.select((F.col("__id") + top).alias("id"), "query_text", F.col("__uris").alias("expected_source_uris")))


def without_prefix(sources: DataFrame, chunks: DataFrame, queries: DataFrame, usage: DataFrame, uri_prefixes: list[str], query_prefix: str) -> dict[str, DataFrame]:
    """All tables without the sources below some uris, their chunks and these chunks' uses, and without the queries of a prefix."""
    below = F.lit(False)
    for prefix in uri_prefixes:
        below = below | F.col("source_uri").startswith(prefix)
    gone = sources.where(below).select(F.col("id").alias("source_id"))
    dead = chunks.join(gone, "source_id", "left_semi").select(F.col("chunk_id").alias("target_id"))
    return {
        "sources": sources.where(~F.coalesce(below, F.lit(False))),
        "chunks": chunks.join(gone, "source_id", "left_anti"),
        "queries": queries.where(~F.col("query_text").ilike(f"{query_prefix}%")),
        "usage": usage.where("target_kind <> 'chunk'").unionByName(usage.where("target_kind = 'chunk'").join(dead, "target_id", "left_anti")),
    }


MANIFEST = "_manifest.json"


def backup(tables: dict[str, DataFrame], folder: str) -> dict[str, dict]:
    """Write every table below ``folder`` and, last, a manifest of what each holds (``versions.content``). A folder without a manifest is no backup."""
    spark = next(iter(tables.values())).sparkSession
    held = {}
    for name, table in tables.items():
        table.write.mode("errorifexists").parquet(f"{folder}/{name}")
        held[name] = versions.content(spark.read.parquet(f"{folder}/{name}"))
    versions.commit(spark, folder, held, MANIFEST)
    return held


def restored(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    """The tables that the last ``restore`` put below ``target``."""
    live = versions.load(spark, target)
    if live is None:
        raise FileNotFoundError(f"{target} holds no tables")
    return {name: spark.read.parquet(f"{target}/{live['folder']}/{name}") for name in live["tables"]}


def restore(spark: SparkSession, folder: str, target: str, force: bool = False) -> dict[str, DataFrame]:
    """The tables of a backup, written below ``target`` in a folder of their own that one switch makes the live one.

    ValueError where the backup isn't complete or any value isn't what was backed up; FileExistsError where the target has tables and ``force`` isn't set. Whatever fails, the target holds what it held.
    """
    held, live = versions.load(spark, folder, MANIFEST), versions.load(spark, target)
    if held is None:
        raise ValueError(f"{folder} holds no backup")
    if live is not None and not force:
        raise FileExistsError(f"{target} holds tables")
    own = f"restored-{uuid.uuid4().hex[:12]}"
    try:
        for name, content in held.items():
            spark.read.parquet(f"{folder}/{name}").write.parquet(f"{target}/{own}/{name}")
            if versions.content(spark.read.parquet(f"{target}/{own}/{name}")) != content:
                raise ValueError(f"{folder}/{name} isn't what was backed up")
    except Exception as e:  # whatever it is, nothing of it stays
        versions.remove(spark, f"{target}/{own}")
        raise ValueError(f"{folder} isn't whole: {e}") from e
    versions.commit(spark, target, {"folder": own, "tables": sorted(held)})
    if live is not None:
        versions.remove(spark, f"{target}/{live['folder']}")
    return restored(spark, target)
