"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class k holds lengths in
(capacity/(k+1), capacity/k], and each of its bins takes exactly k pieces. As a
document may be cut anywhere, a remainder is cut down to the upper edge of its
class, ``capacity // k``, until what the last piece would waste of its slot is at
most ``slack`` tokens; bins of whole pieces then carry almost no padding.

Workers cut and class documents independently. The pieces are written once; a
count per (block, class) gives every block the rank at which its pieces start in
each class, and the rank alone decides bin and slot. Classes go on to the capacity, so that
tiny pieces fill their bins too; of 1024 only those of a whole ``capacity // length`` and their next are used.
Only the last, incomplete bin of each class is left over; these few thousand pieces are packed
by first-fit decreasing in one small task, whatever the size of the corpus.

Defined results: a null text counts as empty; an empty text still has its
separator id, so it is one piece of length 1; repeated rows are packed once each; very long texts are encoded whole and cut into as many
pieces as they need; pieces of equal length tie by their row's number and start, which are written once;
an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch
from .bpe import ids_of

PIECES = (
    "doc_id bigint, row_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, klass int"
)


def cut(total: int, capacity: int, classes: int, slack: int) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of ``total`` tokens, in order.

    >>> cut(2500, 1024, 64, 8)
    [(1024, 1), (1024, 1), (341, 3), (111, 9)]
    """
    out = [(capacity, 1)] * (total // capacity)
    left = total % capacity
    while left:
        k = min(capacity // left, classes)  # the class that the whole rest belongs to
        if capacity // k - left <= slack or k == classes:
            out.append((left, k))
            break
        edge = capacity // (k + 1)
        if k + 1 > classes:
            out.append((left, k))
            break
        out.append((edge, k + 1))
        left -= edge
    return out


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, separator: int = 0, classes: int = 1024, slack: int = 8) -> DataFrame:
    """Cut every document's ids, followed by ``separator``, into classed pieces."""
    tail = int(separator).to_bytes(4, "little")
    schema = pa.schema(
        [("doc_id", pa.int64()), ("row_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("klass", pa.int32())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            for doc, row, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ids = memoryview(ids_of(tokenizer_path, text) + tail)
                total, at = len(ids) // 4, 0
                for length, klass in cut(total, capacity, classes, slack):
                    crc = zlib.crc32(ids[4 * at : 4 * (at + length)])
                    for column, value in zip(rows, (doc, row, at, length, crc, total, klass), strict=True):
                        column.append(value)
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), F.coalesce("text", F.lit("")).alias("text"))
    return keyed.mapInArrow(run, PIECES)


def _fit(rows: list[tuple[int, int]], capacity: int) -> list[tuple[int, int]]:
    """First-fit decreasing: (bin, position in its bin) per (length, n)."""
    bins: list[list[int]] = []
    where = {}
    for length, n in sorted(rows, key=lambda r: (-r[0], r[1])):
        for k, b in enumerate(bins):
            if b[0] + length <= capacity:
                where[n] = (k, b[1])
                b[0] += length
                b[1] += 1
                break
        else:
            where[n] = (len(bins), 0)
            bins.append([length, 1])
    return [(n, *where[n]) for _, n in rows]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, separator: int = 0, classes: int = 1024, slack: int = 8, block_pieces: int = 100_000) -> DataFrame:
    """Place all pieces of ``docs``; see the module's text.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, klass.
    At most about ``block_pieces`` pieces are ranked in one task, whatever their class.
    """
    spark = docs.sparkSession
    table = scratch.keep(pieces(docs, tokenizer_path, capacity, separator, classes, slack), "pieces")
    # Blocks hold a range of hashes of the piece, so no document, source or class makes one large.
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), table.count() // block_pieces + 1)
    placed = table.withColumn("block", F.pmod(F.xxhash64("row_id", "start"), F.lit(blocks)))
    counts = scratch.keep(placed.groupBy("klass", "block").agg(F.count("*").alias("n")), "blocks")
    before = Window.partitionBy("klass").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    offsets = counts.select("klass", "block", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("before"))
    first, bins, base = {}, 0, {}
    for k, n in sorted(counts.groupBy("klass").agg(F.sum("n")).collect()):  # at most a row per class
        first[k], base[k] = n - n % k, bins  # ranks from first[k] on are left over
        bins += n // k
    per_class = F.broadcast(spark.createDataFrame([(k, base[k], first[k]) for k in base], "klass int, base bigint, whole bigint"))
    order = Window.partitionBy("klass", "block").orderBy("row_id", "start")
    ranked = placed.join(offsets.hint("shuffle_hash"), ["klass", "block"]).join(per_class, "klass").withColumn("rank", F.col("before") + F.row_number().over(order) - 1)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "klass", "row_id"]
    whole = ranked.where("rank < whole").select(*columns, (F.col("base") + F.expr("rank div klass")).alias("sequence_id"), F.expr("rank % klass").alias("place"))
    rest = ranked.where("rank >= whole").select(*columns)
    left = sorted((r.row_id, r.start, r.length) for r in rest.select("row_id", "start", "length").collect())  # fewer than the sum of the classes in use
    spots = [(left[n][0], left[n][1], bins + b, p) for n, b, p in _fit([(x[2], n) for n, x in enumerate(left)], capacity)]
    spots_df = F.broadcast(spark.createDataFrame(spots, "row_id bigint, start bigint, sequence_id bigint, place bigint"))
    both = whole.unionByName(rest.join(spots_df, ["row_id", "start"]))
    inside = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0).cast("long"))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "klass"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op4_packing``: all documents into sequences of at most 1024 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
