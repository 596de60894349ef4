"""Sources, chunks and vectors on disk, changed batch by batch at the cost of what a batch changes.

Every table is cut into buckets by source id. A batch writes anew only the buckets of sources that it changes; a manifest names the live folder of each bucket and the last
batch, and is switched when all is written. A batch that died leaves folders that no manifest names; it is done again from the same manifest, so nothing doubles. Folders that
a switch replaced stay until the next one, for readers that are under way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import versions
from ..durable import durable, numbered
from . import memory, store

SCHEMAS = {
    "sources": "id bigint, source_type string, source_uri string, source_fingerprint string, timestamp string, title string, metadata_json string",
    "chunks": "chunk_id bigint, source_id bigint, chunk_index int, text string, metadata_json string",
    "vectors": "chunk_id bigint, model string, dim int, vector array<float>",
}
#: As stored: vectors know the source they go with.
_STORED = {**SCHEMAS, "vectors": SCHEMAS["vectors"] + ", source_id bigint"}
_KEY = {"sources": "id", "chunks": "source_id", "vectors": "source_id"}


def _empty(buckets: int) -> dict:
    return {"version": 0, "batch": -1, "buckets": buckets, "last": {"sources": 0, "chunks": 0}, "live": {name: {} for name in SCHEMAS}, "old": []}


def _rows(spark: SparkSession, root: str, manifest: dict, name: str, only: list[int] | None = None) -> DataFrame:
    live = manifest["live"][name]
    paths = [f"{root}/{p}" for b, p in sorted(live.items()) if only is None or int(b) in only]
    return spark.read.schema(_STORED[name]).parquet(*paths) if paths else spark.createDataFrame([], _STORED[name])


def read(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables as of the last whole batch; empty ones before the first."""
    manifest = versions.load(spark, root) or _empty(1)
    return {name: _rows(spark, root, manifest, name).select([c.split()[0] for c in SCHEMAS[name].split(", ")]) for name in SCHEMAS}


def take(spark: SparkSession, root: str, batch: int, scanned: DataFrame, chunks: DataFrame, embedder=None, removed: DataFrame | None = None, buckets: int = 64) -> dict:
    """Take a scan (as for ``ingest.ingest``) into the tables below ``root`` as batch ``batch``; sources in ``removed`` (source_type, source_uri) go.

    Batches are numbered upwards; one that was taken changes nothing. Returns sources by state, chunks_inserted, removed, and the buckets written of each table.
    """
    manifest = versions.load(spark, root) or _empty(buckets)
    if batch <= manifest["batch"]:
        return {"repeated": True}
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(manifest["buckets"])).cast("int")
    scanned = durable(scanned.dropDuplicates(store.SOURCE))
    gone_uris = (scanned.limit(0) if removed is None else removed).select(store.SOURCE).distinct()
    scanned = scanned.join(gone_uris, store.SOURCE, "left_anti")
    named = scanned.select(store.SOURCE).unionByName(gone_uris)
    stored = durable(_rows(spark, root, manifest, "sources").join(named, store.SOURCE, "left_semi"))
    dead = durable(stored.join(gone_uris, store.SOURCE, "left_semi").select("id"))
    known = stored.join(dead, "id", "left_anti")
    states = durable(store.source_changes(known, scanned))
    after, outdated = store.upsert_sources(known, scanned, top=manifest["last"]["sources"])
    after, outdated = durable(after), durable(outdated.unionByName(dead).distinct())
    moved = states.where("state <> 'unchanged'").select(store.SOURCE).join(after.select(F.col("id").alias("source_id"), *store.SOURCE), store.SOURCE)
    fresh = numbered(chunks.join(moved, store.SOURCE).select("source_id", "chunk_index", "text", "metadata_json"), "__id", "source_id", "chunk_index")
    fresh = durable(fresh.select((F.col("__id") + manifest["last"]["chunks"]).alias("chunk_id"), "source_id", F.col("chunk_index").cast("int").alias("chunk_index"), "text", "metadata_json"))
    vectors = spark.createDataFrame([], _STORED["vectors"])
    if embedder is not None:
        made = memory.embed_pending(fresh, spark.createDataFrame([], SCHEMAS["vectors"]), embedder, "chunk_id", "text")
        vectors = made.join(fresh.select("chunk_id", "source_id"), "chunk_id")
    changed = durable(after.subtract(stored.select(after.columns)))
    left = stored.select("id").join(after.select("id"), "id", "left_anti").unionByName(changed.select("id"))

    token, live, old, written = uuid.uuid4().hex[:12], {}, [], {}
    for name, out, add in (("sources", left, changed), ("chunks", outdated, fresh), ("vectors", outdated, vectors)):
        key, columns = _KEY[name], [c.split()[0] for c in _STORED[name].split(", ")]
        ids = out.select(F.col("id").alias(key)).distinct()
        touched = sorted(r["b"] for r in ids.unionByName(add.select(key)).select(bucket(key).alias("b")).distinct().collect())  # at most as many as buckets
        live[name] = {b: p for b, p in manifest["live"][name].items() if int(b) not in touched}
        old += [p for b, p in manifest["live"][name].items() if int(b) in touched]
        written[name] = touched
        if touched:
            rows = _rows(spark, root, manifest, name, touched).join(ids, key, "left_anti").select(columns).unionByName(add.select(columns))
            rows.withColumn("bucket", bucket(key)).repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/{name}/{token}")
            live[name] |= {f.removeprefix("bucket="): f"{name}/{token}/{f}" for f in versions.folders(spark, f"{root}/{name}/{token}")}
    highest = lambda df, c, least: max(least, df.agg(F.max(c)).first()[0] or 0)
    last = {"sources": highest(after, "id", manifest["last"]["sources"]), "chunks": highest(fresh, "chunk_id", manifest["last"]["chunks"])}
    versions.commit(spark, root, {**manifest, "version": manifest["version"] + 1, "batch": batch, "last": last, "live": live, "old": old})
    _clean(spark, root, live, old)
    report = {r["state"]: r["n"] for r in states.groupBy("state").agg(F.count("*").alias("n")).collect()}
    return {**report, "chunks_inserted": fresh.count(), "removed": dead.count(), "written": written}


def _clean(spark: SparkSession, root: str, live: dict, old: list[str]) -> None:
    """Remove folders that neither this manifest nor the one before it names."""
    named = {p for paths in live.values() for p in paths.values()} | set(old)
    for name in live:
        for token in versions.folders(spark, f"{root}/{name}"):
            held = versions.folders(spark, f"{root}/{name}/{token}")
            stays = [f for f in held if f"{name}/{token}/{f}" in named]
            for f in held if stays else []:
                if f not in stays:
                    versions.remove(spark, f"{root}/{name}/{token}/{f}")
            if not stays:
                versions.remove(spark, f"{root}/{name}/{token}")

