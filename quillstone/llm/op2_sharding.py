"""Byte-balanced sharding by histogram sort.

The sort key is (hash of the text, hash of the row), two 64-bit words, so equal
texts are neighbours. A splitter is a key below which a wanted share of all bytes
lies. Every round counts the exact bytes per candidate cell (the next bits of the
key) inside the cells that still hold a splitter, on all partitions with map-side
sums, and narrows each splitter to one cell. A splitter that can sit between two
texts within ``tolerance`` of a shard stays there, so that group of equal texts
is not cut; a group larger than that is cut by the row hash. When all splitters
hold, one exchange sends each row to its key range, which numbers its rows.

Only histograms reach the driver: 4096 sums for each of the seven splitters, whatever the number of rows.

Law ``bytes``: shard sizes differ from the mean by at most 2 x ``tolerance``
(plus one row's size). Defined results: a null text has size 1 and the checksum of the
empty text; a very long text is one row like any; equal texts, and repeated rows, are neighbours and are placed once each; rows of
equal keys come by doc_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch

BITS = 12


def _cell(level: int) -> Column:
    """The ``level``-th group of BITS bits of the 120-bit key, from the top."""
    word, k = ("k1", level) if level < 5 else ("k2", level - 5)
    return F.shiftrightunsigned(word, 64 - BITS * (k + 1)).bitwiseAND((1 << BITS) - 1).cast("int")


def _prefix(level: int) -> Column:
    """All cells above ``level``, as text, to name the cell that a row is in."""
    return F.concat_ws(".", *[_cell(k).cast("string") for k in range(level)]) if level else F.lit("")


def find_splitters(rows: DataFrame, targets: list[float], slack: float) -> list[tuple[int, ...]]:
    """For each target (bytes below) the key cells at whose start the splitter sits."""
    # Of each target: the cells so far, and the bytes below them.
    at = [((), 0) for _ in targets]
    done: list[tuple[int, ...] | None] = [None] * len(targets)
    for level in range(10):
        open_cells = {at[i][0] for i in range(len(targets)) if done[i] is None}
        if not open_cells:
            break
        names = [".".join(map(str, c)) for c in open_cells]
        part = rows if level == 0 else rows.where(_prefix(level).isin(names))
        sums = part.groupBy(_prefix(level).alias("prefix"), _cell(level).alias("cell")).agg(F.sum("size").alias("size")).collect()
        by: dict[str, dict[int, int]] = {}
        for r in sums:
            by.setdefault(r["prefix"], {})[r["cell"]] = r["size"]
        for i, target in enumerate(targets):
            if done[i] is not None:
                continue
            cells, below = at[i]
            found = by.get(".".join(map(str, cells)), {})
            # The last cell start whose bytes below don't exceed the target, and the next one.
            cell, size = 0, 0
            for c in sorted(found):
                cell, size = c, found[c]
                if below + size > target:
                    break
                below += size
            else:
                cell, size = cell + 1, 0
            if target - below <= slack:
                done[i] = (*cells, cell)
            elif below + size - target <= slack:
                done[i] = (*cells, cell + 1)
            elif level == 9:
                done[i] = (*cells, cell)
            else:
                at[i] = ((*cells, cell), below)
    return [d if d is not None else a[0] for d, a in zip(done, at, strict=True)]


def _as_key(cells: tuple[int, ...]) -> tuple[int, int]:
    """(k1, k2) of the first key in ``cells``, whose last cell may be one past the end; unsigned."""
    total = 0
    for k in range(10):
        total = (total << BITS) + (cells[k] if k < len(cells) else 0)
    k1, k2 = total >> 60, total & ((1 << 60) - 1)
    return k1, k2


def shard(docs: DataFrame, shards: int = 8, tolerance: float = 0.005, rows_per_range: int = 1_000_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard per row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    raw = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.lit(1)).alias("k1"),
        F.xxhash64(F.col("doc_id"), F.monotonically_increasing_id()).alias("k2"),
    )
    rows = scratch.keep(raw, "sizes")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    mean = total / shards
    cuts = sorted(_as_key(c) for c in find_splitters(rows, [mean * i for i in range(1, shards)], tolerance * mean)) if n else []
    # Keys as unsigned words, which sort as text.
    key = F.concat(F.lpad(F.hex(F.shiftrightunsigned("k1", 4)), 15, "0"), F.lpad(F.hex(F.shiftrightunsigned("k2", 4)), 15, "0"))
    keyed = rows.select("doc_id", "size", "text_crc32", key.alias("key")).withColumn("shard", _bisect(F.col("key"), [f"{k[0]:015X}{k[1]:015X}" for k in cuts]))
    # The one exchange: ranges of the key, whose rows are numbered where they land.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // rows_per_range + 1)
    place = F.monotonically_increasing_id()
    landed = keyed.repartitionByRange(parts, "shard", "key").sortWithinPartitions("shard", "key", "doc_id")
    landed = scratch.keep(landed.drop("key").withColumn("part", F.shiftright(place, 33)).withColumn("place", place.bitwiseAND((1 << 33) - 1)), "ranges")
    scratch.drop(rows)
    # A row per range and shard in it: what comes before it in its shard.
    order = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = landed.groupBy("shard", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    ranges = ranges.select("shard", "part", (F.coalesce(F.sum("n").over(order), F.lit(0)) - F.col("first")).alias("shift"))
    return landed.join(F.broadcast(ranges), ["shard", "part"]).select(  # ranges x shards rows at most
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") + F.col("shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _bisect(key: Column, cuts: list[str]) -> Column:
    """How many of the sorted ``cuts`` are at most ``key``: a balanced tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < cuts[middle], tree(low, middle)).otherwise(tree(middle + 1, high))

    return tree(0, len(cuts)).cast("int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op2_sharding``: all documents into eight shards of nearly equal bytes."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
