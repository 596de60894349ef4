"""Exact deduplication by stateful streaming.

A staged table of one small row per document (digest, length, identifier, content
locator: the file that holds the row, and its place there) feeds a stream. A keyed aggregation without watermark, in a disk-backed
state store, keeps for each digest how many rows it has and the one that stays; state
never expires. Each micro-batch appends the keys it changed, and the last change of
a key is its state. Then hits, i.e. digests with several rows, are checked in full:
the whole normalised texts behind them are compared. Should two different texts
share a digest, those rows are grouped by the whole text instead.

With a ``state`` folder the stream's log, its state and its changes stay there, and a later run over more files goes on
from them: its new rows meet all earlier ones, and the row that stays is the best of all.

Only DataFrame operations touch rows; the driver names paths and starts the stream.

Defined results: null and empty texts are equal to each other; a row with a null
doc_id counts like any other and stays last; repeated rows (same doc_id, same text)
are one row each, and the same one is named for all, the first by file and place in it; very long texts are read whole; an empty table gives no rows;
other columns are kept only by ``deduplicate``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .hot import join_groups, with_salt

#: Space and the controls from tab to carriage return.
BLANK = " \t\n\x0b\x0c\r"
_LAST = (1 << 63) - 1
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANK, "")


#: The least of a group's ranks stays: most code points, then smallest doc_id (nulls last), then the first row.
RANK = "struct<less:bigint,first:bigint,file:string,row:bigint>"


def _stream(spark: SparkSession, path: str, files_per_batch: int, folder: str) -> DataFrame:
    """Run the staged rows below ``path`` through the keyed state in ``folder``; digest, n, best per digest."""
    source = spark.readStream.schema(f"digest binary, rank {RANK}").option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(path)
    state = source.groupBy("digest").agg(F.count("*").alias("n"), F.min("rank").alias("best"))
    out, log = f"{folder}/changes", f"{folder}/log"

    def append(changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={batch:06d}")

    # The state's settings hold for this stream only.
    settings = {
        "spark.sql.streaming.stateStore.providerClass": ROCKS,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
        "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
        # Stores of streams that have ended are closed soon, so a long session doesn't gather them.
        "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        # Many small stores: no disk is set aside before it is needed.
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        run = state.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", log).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = f"digest binary, n bigint, best {RANK}, batch bigint"
    changes = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)
    return changes.groupBy("digest").agg(F.max(F.struct("batch", "n", "best")).alias("last")).select("digest", "last.n", "last.best")


def _sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _texts(spark: SparkSession, staged: str) -> DataFrame:
    """doc_id, text, file, row of all staged rows, read where their locators say. The driver lists the files, as for any scan."""
    places = spark.read.option("recursiveFileLookup", "true").schema(f"rank {RANK}").parquet(staged).select("rank.file", "rank.row").distinct()
    files = [r.file for r in places.select("file").distinct().toLocalIterator()]
    if not files:
        return spark.createDataFrame([], "doc_id bigint, text string, file string, row bigint")
    rows = spark.read.parquet(*files).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows.join(places, ["file", "row"], "left_semi")


def groups(docs: DataFrame, files_per_batch: int = 100_000, state: str | None = None, digest: Callable[[Column], Column] = _sha256) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, and __file, __row (its place).

    ``state``: a shared folder that keeps the state for later runs. Sizes and the row that stays then count earlier runs too, whose
    texts must still be where they were; only rows of this run are returned. ``digest`` makes the key of a normalised text.
    """
    spark, docs = docs.sparkSession, scratch.located(docs)
    since = scratch.mark()
    text = normalised(F.col("text"))
    with_text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("__file").alias("file"), F.col("__row").alias("row"))
    rank = F.struct((-F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("less"), F.coalesce("doc_id", F.lit(_LAST)).alias("first"), "file", "row")
    folder = scratch.fresh(spark, "state") if state is None else state.rstrip("/")
    path = f"{folder}/staged/{scratch.token()}"
    other_key = digest is not _sha256
    sha = [F.sha2(text, 256).alias("text_sha256")] if other_key else []
    with_text.select(digest(text).alias("digest"), rank.alias("rank"), *sha).write.option("compression", "zstd").parquet(path)
    staged = spark.read.schema(f"digest binary, rank {RANK}" + ", text_sha256 string" * other_key).parquet(path)
    staged = staged if other_key else staged.withColumn("text_sha256", F.lower(F.hex("digest")))
    kept = scratch.keep(_stream(spark, f"{folder}/staged", files_per_batch, folder), "groups")
    if state is None:
        for part in ("log", "changes"):
            scratch.delete(spark, f"{folder}/{part}")

    # Hits in full: equal digests must hide equal bytes. min and max of the whole texts see any difference.
    # The texts of a large group are compared in parts, and then what the parts found.
    whole = with_text if state is None else _texts(spark, f"{folder}/staged")
    texts = whole.select(digest(text).alias("digest"), text.alias("whole"), "file", "row")
    texts, salted = with_salt(texts, kept.select("digest", "n"), "digest", "n", "row")
    hits = salted.where("n > 1").select("digest", "salt").hint("shuffle_merge")  # their number has no bound
    unequal = texts.join(hits, ["digest", "salt"], "left_semi").groupBy("digest", "salt").agg(F.min("whole").alias("low"), F.max("whole").alias("high"))
    unequal = unequal.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("digest")
    clashing = scratch.keep(unequal, "clashes")
    of_digest = kept.select("digest", F.col("n").alias("group_size"), "best")
    if clashing.isEmpty():
        rows = join_groups(staged, of_digest, "digest", "group_size")
    else:
        other = whole.select(digest(text).alias("digest"), rank.alias("rank"), F.sha2(text, 256).alias("text_sha256"), text.alias("whole")).join(clashing, "digest", "left_semi")
        by_text = other.groupBy("whole").agg(F.count("*").alias("group_size"), F.min("rank").alias("best"))
        mine = other.join(staged.select("rank"), "rank", "left_semi")
        rows = join_groups(staged.join(clashing, "digest", "left_anti"), of_digest, "digest", "group_size").unionByName(mine.join(by_text, "whole").drop("whole"))
    scratch.release(spark, since, *([kept] if clashing.isEmpty() else [kept, clashing]), spare=folder)
    id_of = lambda rank: F.when(F.col(f"{rank}.first") != _LAST, F.col(f"{rank}.first"))
    return rows.select(
        id_of("rank").alias("doc_id"),
        id_of("best").alias("keep_id"),
        "group_size",
        (F.col("rank") == F.col("best")).alias("kept"),
        "text_sha256",
        F.col("rank.file").alias("__file"),
        F.col("rank.row").alias("__row"),
    )


def deduplicate(docs: DataFrame, files_per_batch: int = 100_000) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    marked = scratch.located(docs)
    dropped = groups(marked.select("doc_id", "text"), files_per_batch).where("not kept").select("__file", "__row")
    return marked.join(dropped, ["__file", "__row"], "left_anti").transform(scratch.original, docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op6_exact_dedup``: every row of documents with its group and the row that stays."""
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("__file", "__row")


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), k AS (
  SELECT doc_id, sha256(norm) AS text_sha256, length(text) AS n_chars, norm FROM t
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) = 1 AS kept,
       text_sha256
FROM k
"""
