"""From scanned files to sources, chunks and vectors, and from sources to events: each step a change of tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import durable, numbered
from ..functions import chunking, repair
from ..sources import files, git, notes
from . import memory, state, store, views

# How much of a source events are made from.
EVENT_CHARS = 8000


def forget(tables: dict[str, DataFrame], gone: DataFrame) -> tuple[dict[str, DataFrame], int]:
    """(tables without the sources in ``gone`` (source_type, source_uri), their chunks and vectors; how many sources went)."""
    dead = durable(tables["sources"].join(gone.select(store.SOURCE).distinct(), store.SOURCE, "left_semi").select("id"))
    n = dead.count()
    if not n:
        return tables, 0
    chunks, vectors = store.replace_chunks(tables["chunks"], tables["vectors"], dead, tables["chunks"].limit(0).drop("chunk_id"))
    return {**tables, "sources": durable(tables["sources"].join(dead, "id", "left_anti")), "chunks": durable(chunks), "vectors": durable(vectors)}, n


def ingest(tables: dict[str, DataFrame], scanned: DataFrame, chunks: DataFrame, embedder=None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, report) after a scan; ``tables``: sources, chunks, vectors.

    ``scanned``: source_type, source_uri, source_fingerprint, timestamp, title, metadata_json; ``chunks``: source_type, source_uri,
    chunk_index, text, metadata_json. Unchanged sources keep their chunks; those of changed ones are made anew under new ids, and embedded at once where there is an
    ``embedder``. The report counts sources by state, and inserted chunks.
    """
    states = store.source_changes(tables["sources"], scanned)
    sources, gone = store.upsert_sources(tables["sources"], scanned)
    sources = durable(sources)
    moved = states.where("state <> 'unchanged'").select(store.SOURCE).join(sources.select(F.col("id").alias("source_id"), *store.SOURCE), store.SOURCE)
    fresh = chunks.join(moved, store.SOURCE).select("source_id", "chunk_index", "text", "metadata_json")
    kept, vectors = store.replace_chunks(tables["chunks"], tables["vectors"], gone, fresh)
    kept = durable(kept)
    if embedder is not None:
        new = kept.join(fresh.select("source_id").distinct(), "source_id", "left_semi")
        vectors = store.replace_rows(vectors, memory.embed_pending(new, vectors, embedder, "chunk_id", "text"), "chunk_id")
    report = states.groupBy("state").agg(F.count("*").alias("n")).unionByName(fresh.agg(F.count("*").alias("n")).select(F.lit("chunks_inserted").alias("state"), "n"))
    return {**tables, "sources": sources, "chunks": kept, "vectors": durable(vectors)}, durable(report)


def _metadata(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def note_scan(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(sources, chunks) of the markdown files of a folder."""
    found = durable(notes.markdown(spark, folder).withColumn("source_type", F.lit("note")))
    sources = found.select(*store.SOURCE, F.col("fingerprint").alias("source_fingerprint"), F.col("timestamp").cast("string").alias("timestamp"), "title", _metadata(bytes=F.col("bytes"), fingerprint=F.col("fingerprint")).alias("metadata_json"))
    each = chunking.chunk_rows(found, chunking.markdown_chunks(F.col("text"), F.col("title")), *store.SOURCE)
    return sources, each.select(*store.SOURCE, "chunk_index", F.col("chunk_text").alias("text"), _metadata(modality=F.lit("text"), source_type=F.lit("note")).alias("metadata_json"))


def git_scan(spark: SparkSession, repository: str, name: str, email: str, most: int = 300) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, chunks) of an author's commits, and the sources that are commits of others."""
    found, others = git.by_author(durable(git.scan(spark, repository, most).withColumn("source_type", F.lit("git_commit"))), name, email)
    about = {c: F.col(c) for c in ("repo", "sha", "author_name", "author_email", "fingerprint")}
    sources = found.select(*store.SOURCE, F.col("fingerprint").alias("source_fingerprint"), "timestamp", "title", _metadata(**about).alias("metadata_json"))
    each = chunking.chunk_rows(found, chunking.diff_chunks(F.col("text")), *store.SOURCE, "sha", "author_name", "author_email")
    own = {c: F.col(c) for c in ("sha", "author_name", "author_email")}
    return sources, each.select(*store.SOURCE, "chunk_index", F.col("chunk_text").alias("text"), _metadata(modality=F.lit("code"), source_type=F.lit("git_commit"), **own).alias("metadata_json")), others.select(F.lit("git_commit").alias("source_type"), "source_uri")


def pdf_scan(spark: SparkSession, folder: str, read: Callable = files.pages_of) -> tuple[DataFrame, DataFrame]:
    """(sources, chunks) of PDF files; chunks are numbered across the pages of a file."""
    pages = durable(files.pdf_pages(spark, folder, read).withColumn("source_type", F.lit("pdf")))
    one = pages.groupBy(*store.SOURCE, "title", "timestamp", "fingerprint").agg(F.count("*").alias("pages"))
    sources = one.select(*store.SOURCE, F.col("fingerprint").alias("source_fingerprint"), F.col("timestamp").cast("string").alias("timestamp"), "title", _metadata(pages=F.col("pages"), fingerprint=F.col("fingerprint")).alias("metadata_json"))
    each = files.page_chunks(pages).withColumn("source_type", F.lit("pdf"))
    return sources, each.select(*store.SOURCE, "chunk_index", F.col("chunk_text").alias("text"), _metadata(modality=F.lit("pdf-page"), source_type=F.lit("pdf"), page=F.col("page")).alias("metadata_json"))


def image_scan(spark: SparkSession, folder: str, read: Callable = files.recognised) -> tuple[DataFrame, DataFrame]:
    """(sources, chunks) of images by their recognised text; an image without any is a source without chunks."""
    found = durable(files.image_texts(spark, folder, read).withColumn("source_type", F.lit("image")))
    sources = found.select(*store.SOURCE, F.col("fingerprint").alias("source_fingerprint"), F.col("timestamp").cast("string").alias("timestamp"), "title", _metadata(ocr_confidence=F.col("ocr_confidence"), fingerprint=F.col("fingerprint")).alias("metadata_json"))
    each = chunking.chunk_rows(found, chunking.text_chunks(F.col("text")), *store.SOURCE, "ocr_confidence")
    return sources, each.select(*store.SOURCE, "chunk_index", F.col("chunk_text").alias("text"), _metadata(modality=F.lit("ocr"), source_type=F.lit("image"), ocr_confidence=F.col("ocr_confidence")).alias("metadata_json"))


def sync(tables: dict[str, DataFrame], connectors: dict[str, list[str]], scans: dict[str, Callable[[str], tuple[DataFrame, ...]]], embedder=None, progress: Callable[[str, int, int], Any] | None = None) -> tuple[dict[str, DataFrame], list[dict]]:
    """(tables, report) after all folders of all connectors.

    ``scans``: how a connector reads a folder: (sources, chunks) and, where it knows some, the sources that go. A folder that can't be read is told in the report and stops nothing; a connector whose library is missing is skipped.
    """
    needs, report = {"pdf": "pdf", "image": "image"}, []
    for name, paths in connectors.items():
        entry: dict[str, Any] = {"connector": name, "paths": len(paths), "inserted": 0, "removed": 0, "status": "ok" if paths else "no-paths"}
        errors: list[str] = []
        for k, path in enumerate(paths, 1):
            try:
                sources, chunks, *gone = scans[name](path)
                for rows in gone:
                    tables, n = forget(tables, rows)
                    entry["removed"] += n
                tables, told = ingest(tables, sources, chunks, embedder)
                entry["inserted"] += sum(r.n for r in told.where("state = 'chunks_inserted'").collect())
            except files.MissingBackend as e:
                entry["status"] = f"skipped: {e}" if name in needs else f"failed: {e}"
                break
            except (FileNotFoundError, ValueError) as e:
                errors.append(f"{path}: {e}")
            if progress is not None:
                progress(name, k, len(paths))
        if errors:
            entry |= {"status": f"ok with {len(errors)} error(s)", "errors": errors}
        report.append(entry)
    return tables, report


def stream_notes(spark: SparkSession, folder: str, root: str, embedder=None):
    """A query that takes new notes of ``folder`` into the tables below ``root``, batch by batch; a file that comes again unchanged changes nothing.

    A batch writes what it changes (``state.take``); ``read_tables`` reads the tables of the last whole one.
    """
    rows = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    rows = rows.select(F.col("value").alias("text"), F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("source_uri"), F.col("_metadata.file_modification_time").alias("modified"))

    def take(batch: DataFrame, number: int) -> None:
        title = F.regexp_extract("source_uri", r"([^/]+)\.md$", 1)
        found = durable(batch.dropDuplicates(["source_uri"]).withColumn("title", title).withColumn("source_type", F.lit("note")))
        time = F.coalesce(notes.note_date(F.col("text")), "modified").cast("string")
        from ..functions.text import fingerprint

        sources = found.select(*store.SOURCE, fingerprint(F.col("text")).alias("source_fingerprint"), time.alias("timestamp"), "title", F.lit(None).cast("string").alias("metadata_json"))
        each = chunking.chunk_rows(found, chunking.markdown_chunks(F.col("text"), F.col("title")), *store.SOURCE)
        chunks = each.select(*store.SOURCE, "chunk_index", F.col("chunk_text").alias("text"), F.lit(None).cast("string").alias("metadata_json"))
        state.take(spark, root, number, sources, chunks, embedder)

    return rows.writeStream.foreachBatch(take).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()


def read_tables(spark: SparkSession, root: str | None = None) -> dict[str, DataFrame]:
    """The tables below ``root``; empty ones without it."""
    if root is None:
        return {name: spark.createDataFrame([], schema) for name, schema in state.SCHEMAS.items()}
    return state.read(spark, root)


def source_texts(chunks: DataFrame, limit: int = EVENT_CHARS) -> DataFrame:
    """source_id, text: its chunks in order, cut to ``limit`` characters."""
    return views.joined_text(chunks, "source_id", "chunk_index", limit)


def pending_sources(sources: DataFrame, chunks: DataFrame, derivations: DataFrame, model: str, version: str = "1", limit: int | None = None) -> DataFrame:
    """source_id, text, fingerprint of the sources whose events are missing or made from something else; with ``limit`` the first ones.

    ``derivations``: source_id, level, fingerprint. What stands behind the first 8,000 characters of a source doesn't count.
    """
    texts = sources.select(F.col("id").alias("source_id")).join(source_texts(chunks), "source_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    made = F.sha2(F.concat_ws("\x1f", F.lit(model), F.lit(version), "text"), 256)
    left = texts.withColumn("fingerprint", made).join(derivations.where("level = 1").select("source_id", "fingerprint"), ["source_id", "fingerprint"], "left_anti")
    return left.select("source_id", "text", "fingerprint") if limit is None else left.select("source_id", "text", "fingerprint").orderBy("source_id").limit(limit)


def extract_events(pending: DataFrame, sources: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, derivations: DataFrame, generate: Callable[[Column], Column], model: str, version: str = "1") -> dict[str, DataFrame]:
    """nodes, edges, derivations and failures after the events of ``pending`` sources were made anew.

    ``generate`` turns texts into a model's answers. An answer that can't be read is a failure, which is tried again in the next run; an empty list is a derivation without events.
    """
    asked = pending.where(F.trim("text") != "").join(chunks.select("source_id").distinct(), "source_id", "left_semi")
    answered = durable(asked.withColumn("events", repair.model_events(generate(F.col("text")))))
    old = nodes.where("level = 1").withColumn("__source", F.get_json_object("metadata_json", "$.source_id").cast("bigint"))
    gone = old.join(pending.select(F.col("source_id").alias("__source")), "__source", "left_semi").select("node_id")
    left = store.delete_nodes(gone, nodes, edges)
    about = sources.select(F.col("id").alias("source_id"), "source_uri", "source_type", "timestamp")
    each = answered.select("source_id", "fingerprint", F.posexplode("events").alias("__at", "event")).join(about, "source_id")
    top = nodes.agg(F.coalesce(F.max("node_id"), F.lit(0))).first()[0]
    new = durable(numbered(each, "__id", "source_id", "__at").withColumn("node_id", F.col("__id") + top))
    metadata = F.to_json(F.struct("source_id", "source_uri", "source_type"))
    fresh = new.select(
        "node_id", F.lit(1).alias("level"), F.lit("event").alias("node_type"), F.col("event.title").alias("title"), F.col("event.summary").alias("content"), F.col("timestamp").alias("time_start"), F.col("timestamp").alias("time_end"),
        F.col("fingerprint"), F.lit(model).alias("model"), F.lit(version).alias("prompt_version"), metadata.alias("metadata_json"),
    )
    linked = new.join(chunks.select("source_id", "chunk_id"), "source_id").select(
        F.lit(1).alias("parent_level"), F.col("node_id").alias("parent_id"), F.lit(0).alias("child_level"), F.col("chunk_id").alias("child_id"), F.lit("derived_from").alias("relation")
    )
    done = answered.where("events is not null").select("source_id", F.lit(1).alias("level"), "fingerprint")
    kept = derivations.join(done.select("source_id", "level"), ["source_id", "level"], "left_anti")
    return {
        "nodes": left["nodes"].unionByName(fresh, allowMissingColumns=True),
        "edges": left["edges"].unionByName(linked, allowMissingColumns=True),
        "derivations": kept.unionByName(done, allowMissingColumns=True),
        "failures": answered.where("events is null").select("source_id").join(about.select("source_id", "source_uri"), "source_id"),
    }
