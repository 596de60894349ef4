"""Substring deduplication by recompression.

1. Texts become blocks of numbered words, written once; a document is known by its block and its place there.
   Later copies of whole texts (by SHA-256) lose all their windows and take no further part.
2. Rounds (``recompress``): every block plans its merges of runs and pairs of symbols. A Spark round names them: distinct keys of
   all blocks meet in buckets, those that stand in two places get one name, the others none, and the names go
   back to their blocks. Windows with a nameless symbol in their interior stand nowhere else and are dropped.
3. The windows left are candidates. Equal ones have equal interiors, so they pick equal symbols. In a block they are
   compared word by word: the earliest stays and the others are marked. The earliest of all blocks travel with their
   words, in runs of consecutive windows, to the place of their symbol, where their words are compared again; the earliest of all stays.
   Symbols of more than a thousandth of all runs are settled in salted parts first.
4. Marks go back to their blocks; words that a marked window covers are removed.

Hashes only bring windows together; no word is removed but for a window that was compared in full (or a copy of a whole text).
Order: smaller doc_id (nulls last), then start, then place in the table of blocks.

Defined results: null and empty texts have no words; texts of fewer words than a
window lose none; repeated rows are one result each, and later ones lose all their
windows; a text is never cut, and a very long one is a block of its own, held by one worker in about 20 bytes a word;
an empty table gives no rows; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import recompress, scratch
from .blocks import by_block, pack, rows_of, unpack
from .hot import join_groups
from .recompress import ALIVE, Merges, State, U

_LAST = (1 << 63) - 1
#: Bytes of text in a block, bytes of runs compared at once, and keys named at once.
BLOCK_BYTES, SETTLE_BYTES, BUCKET_KEYS = 4 << 20, 4 << 20, 500_000
BLOCK = "doc_ids array<bigint>, digests array<binary>, docs binary, nulls binary, bounds binary, words binary, ids binary"


def _blocks(docs: DataFrame) -> DataFrame:
    """block, and of its documents: ids, digests of their texts (null: no text), where their words begin, the words."""

    def emit(doc_ids: list, texts: list) -> pa.RecordBatch:
        words, ids, bounds = recompress.numbered([(t or b"").split() for t in texts])
        digests = [None if t is None else hashlib.sha256(t).digest() for t in texts]
        arrays = [pa.array([doc_ids], pa.list_(pa.int64())), pa.array([digests], pa.list_(pa.binary()))]
        docs, nulls = np.array([_LAST if d is None else d for d in doc_ids], np.int64), np.array([d is None for d in doc_ids])
        arrays += [pa.array([x], pa.binary()) for x in (pack(docs), pack(nulls), pack(bounds), b" ".join(words), pack(ids))]
        return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in BLOCK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if texts and size + len(text or b"") > BLOCK_BYTES:
                    yield emit(doc_ids, texts)
                    doc_ids, texts, size = [], [], 0
                doc_ids.append(doc_id)
                texts.append(text)
                size += len(text or b"")
        if texts:
            yield emit(doc_ids, texts)

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCK)
    return scratch.keep(made.withColumn("block", F.monotonically_increasing_id()), "blocks")


def _copies(blocks: DataFrame) -> DataFrame:
    """block, part: places of the documents whose whole text stands earlier."""
    each = blocks.select("block", F.posexplode(F.arrays_zip("digests", "doc_ids")).alias("part", "d")).where("d.digests is not null")
    order = F.struct(F.coalesce("d.doc_ids", F.lit(_LAST)).alias("doc_id"), "block", "part")
    placed = each.select(F.col("d.digests").alias("digest"), order.alias("order"))
    groups = scratch.keep(placed.groupBy("digest").agg(F.min("order").alias("earliest"), F.count("*").alias("n")).where("n > 1"), "copies")
    return join_groups(placed, groups, "digest", "n").where("order <> earliest").select("order.block", "order.part")


def _start(data: list[bytes], skip: np.ndarray, window: int) -> State:
    ids, words, bounds = unpack(data[0], np.int32), data[1].split(), unpack(data[2], np.int64)
    return recompress.begin(recompress.word_hashes(words)[ids] if len(ids) else np.zeros(0, U), bounds, window, skip)


def _packed(state: State) -> list[bytes]:
    return [pack(x) for x in (state.sym, np.diff(state.pos, prepend=0).astype(np.int32), state.flag, state.low, state.high, state.bounds)]


def _unpacked(data: list[bytes]) -> State:
    sym, steps, flag, low, high, bounds = (unpack(d, t) for d, t in zip(data, (U, np.int32, np.int8, np.int8, np.int8, np.int64), strict=True))
    return State(bounds, sym, np.cumsum(steps.astype(np.int64)), flag, low, high)


def _distinct(merges: Merges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, whether each stands twice, number of the key of each merge)."""
    keys, number, count = np.unique(merges.key, return_inverse=True, return_counts=True)
    return keys, count > 1, number


KEYS = "block bigint, state0 binary, state1 binary, state2 binary, state3 binary, state4 binary, state5 binary, n_keys bigint, keys binary, again binary"


def _keys(block: int, state: list[bytes | None], merges: Merges) -> list[list]:
    keys, again, _ = _distinct(merges)
    return [[x] for x in (block, *state, len(keys), pack(np.diff(keys, prepend=U(0))), pack(again))]


def _names(keys: DataFrame, level: int) -> DataFrame:
    """block, part, names: a Spark round. Distinct keys of all blocks meet in buckets; those that stand twice or more
    are numbered there, and each block gets the numbers of its keys, bucket by bucket (0: stands once)."""
    spark = keys.sparkSession
    total = keys.agg(F.coalesce(F.sum("n_keys"), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_KEYS + 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed, twice in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                key, again = np.cumsum(unpack(packed, U), dtype=U), unpack(twice, bool)
                part = ((key >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
                ends = np.append(np.flatnonzero(np.diff(part)) + 1, len(part)) if len(part) else np.zeros(0, int)
                begins = np.concatenate([[0], ends[:-1]])[: len(ends)]
                spans = list(zip(begins.tolist(), ends.tolist(), strict=True))
                cut = [[pack(np.diff(key[i:j], prepend=U(0))) for i, j in spans], [pack(again[i:j]) for i, j in spans]]
                arrays = [pa.array(part[begins], pa.int32()), pa.array([block] * len(ends), pa.int64()), *(pa.array(c, pa.binary()) for c in cut)]
                yield pa.RecordBatch.from_arrays(arrays, names=["part", "block", "keys", "again"])

    def number(part: int, rows: list[tuple]) -> pa.RecordBatch:
        keys = [np.cumsum(unpack(r[1], U), dtype=U) for r in rows]
        twice = np.concatenate([unpack(r[2], bool) for r in rows])
        _, place, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        shared = count > 1
        shared[place[twice]] = True
        name = np.where(shared, (np.cumsum(shared) * buckets + part) * 4 + level, 0)[place]
        found = [pack(x) for x in np.split(name, np.cumsum([len(k) for k in keys])[:-1])]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array(found, pa.binary())], names=["block", "part", "names"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []
        for batch in batches:
            for at, *row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if at != part and rows:
                    yield number(part, rows)
                    rows = []
                part = at
                rows.append(tuple(row))
        if rows:
            yield number(part, rows)

    dealt = keys.where("n_keys > 0").select("block", "keys", "again").mapInArrow(deal, "part int, block bigint, keys binary, again binary")
    return dealt.repartition("part").sortWithinPartitions("part", "block").mapInArrow(run, "block bigint, part int, names binary")


def _named(state: State, found: list[tuple], level: int, window: int, cap: int) -> State:
    """The state after a round whose names came in parts."""
    merges = recompress.plan(state, level, window, cap)
    names = np.concatenate([unpack(data[0], U) for _, data in found]) if found else np.zeros(0, U)
    return recompress.apply(state, merges, names[_distinct(merges)[-1]], level, window, cap)


RUNS = "block bigint, at int, start int, doc_id bigint, key bigint, words binary"


def _runs(at: np.ndarray, text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last + 1) places of runs of consecutive windows of one text and key, ``at`` ascending."""
    cut = np.ones(len(at), bool)
    cut[1:] = (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1]) | (key[1:] != key[:-1])
    first = np.flatnonzero(cut)
    return first, np.append(first[1:], len(at)) if len(at) else first


def _settle(rows: DataFrame, window: int, split: bool = False) -> DataFrame:
    """Of runs sorted by key: the later of equal windows (key null, ``words`` holding their places); with ``split`` also
    the earliest, each window by itself with its digest as the key."""
    names = [c.split()[0] for c in RUNS.split(", ")]

    def settle(runs: list[tuple]) -> pa.RecordBatch:
        words, ids, bounds = recompress.numbered([r[5].split() for r in runs])
        sizes = np.diff(bounds) - window + 1
        run = np.repeat(np.arange(len(runs)), sizes)
        inside = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        column = lambda k: np.array([r[k] for r in runs], np.int64)
        block, at, start, doc, key = (column(k)[run] for k in range(5))
        at, start, place = at + inside, start + inside, bounds[run] + inside
        digest = recompress.chained(recompress.word_hashes(words)[ids], window, place)
        by, head = recompress.equal_windows(ids, place, digest, window, doc, start, block, at)
        later = by[~head]
        later = later[np.lexsort((at[later], block[later]))]
        ends = np.flatnonzero(np.append(np.diff(block[later]) != 0, True)) + 1 if len(later) else np.zeros(0, int)
        begins = np.concatenate([[0], ends[:-1]])[: len(ends)]
        out = [[int(block[later[i]]), None, None, None, None, at[later[i:j]].astype(np.int32).tobytes()] for i, j in zip(begins, ends, strict=True)]
        first, names_ = np.sort(by[head]), recompress.listed(words)
        for w in first if split else ():
            out.append([int(block[w]), int(at[w]), int(start[w]), int(doc[w]), int(digest[w].astype(np.int64)), b" ".join(names_[ids[place[w] : place[w] + window]].tolist())])
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, runs, size = None, [], 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[4] != key and size > SETTLE_BYTES:
                    yield settle(runs)
                    runs, size = [], 0
                key = r[4]
                runs.append(r)
                size += len(r[5])
        if runs:
            yield settle(runs)

    return rows.select(names).mapInArrow(run, RUNS)


def _marks(runs: DataFrame, window: int) -> DataFrame:
    """block, marks: windows that a run of another block, or an earlier part of the same, holds earlier.

    A symbol of more than a thousandth of all runs is settled in parts first, and then window by window.
    """
    share = 1000
    counts = scratch.keep(runs.groupBy("key").agg(F.count("*").alias("n")), "symbols")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = counts.where(F.col("n") > max(total // share, 1)).select("key", F.ceil(F.col("n") * share / max(total, 1)).cast("int").alias("salts"))  # fewer than ``share``
    dealt = runs.join(F.broadcast(hot), "key").withColumn("salt", F.pmod(F.xxhash64("block"), F.col("salts")))
    parts = scratch.keep(_settle(dealt.repartition("key", "salt").sortWithinPartitions("key", "salt"), window, split=True), "hot-windows")
    rest = runs.join(F.broadcast(hot), "key", "left_anti").unionByName(parts.where("key is not null"))
    later = _settle(rest.repartition("key").sortWithinPartitions("key"), window)
    return parts.where("key is null").unionByName(later).select("block", F.col("words").alias("marks"))


CANDIDATES = RUNS + ", marks binary"


def _candidates(block: int, data: list[bytes], state: State, window: int) -> list[list]:
    """Runs of the windows that may stand elsewhere, the earliest of equals in the block, and the places of the others."""
    ids, words, bounds = unpack(data[0], np.int32), data[1].split(), unpack(data[2], np.int64)
    doc_ids, listed = unpack(data[3], np.int64), recompress.listed(words)
    at, pick = recompress.picks(state, window)
    text = np.searchsorted(bounds, at, "right") - 1
    digest = recompress.chained(recompress.word_hashes(words)[ids], window, at) if len(at) else np.zeros(0, U)
    key = np.where(state.flag[at] == ALIVE, pick, digest).view(np.int64)
    by, head = recompress.equal_windows(ids, at, digest, window, doc_ids[text], at - bounds[text], at)
    first, later = np.sort(by[head]), np.sort(at[by[~head]])
    out = []
    for i, j in zip(*_runs(at[first], text[first], key[first]), strict=True):
        w = first[i]
        stretch = b" ".join(listed[ids[at[w] : at[first[j - 1]] + window]].tolist())
        out.append((block, int(at[w]), int(at[w] - bounds[text[w]]), int(doc_ids[text[w]]), int(key[w]), stretch, None))
    if len(later):
        out.append((block, None, None, None, None, None, later.astype(np.int32).tobytes()))
    return [[r[k] for r in out] for k in range(7)]


RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept binary"


def substring_dedup(docs: DataFrame, window: int = 20, rounds: int = 3, cap: int = 8) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept (the words that stay, joined by one space, UTF-8).

    ``rounds`` and ``cap`` (below half the window) set how long the shared symbols get; any
    values give the same result.
    """
    if not 2 * cap < window or rounds < 1:
        raise ValueError("cap must be below half the window, and there is at least one round")
    blocks = _blocks(docs)
    copies = scratch.keep(_copies(blocks), "later-copies")
    words = rows_of(blocks, 0, "ids", "words", "bounds", "docs", "nulls")

    def first(block: int, found: dict) -> list[list]:
        data = found[0][0][1]
        skip = np.zeros(len(unpack(data[4], bool)), bool)
        skip[[part for part, _ in found.get(1, [])]] = True
        return _keys(block, [skip.tobytes(), *[None] * 5], recompress.plan(_start(data, skip, window), 1, window, cap))

    def before(found: dict, level: int) -> State:
        """The state that the round's names are for."""
        kept = found[1][0][1]
        return _unpacked(kept) if level > 1 else _start(found[0][0][1], np.frombuffer(kept[0], bool), window)

    def step_to(level: int) -> Callable[[int, dict], list[list]]:
        def step(block: int, found: dict) -> list[list]:
            state = _named(before(found, level), found.get(2, []), level, window, cap)
            return _keys(block, _packed(state), recompress.plan(state, level + 1, window, cap))

        return step

    def last(block: int, found: dict) -> list[list]:
        return _candidates(block, found[0][0][1], _named(before(found, rounds), found.get(2, []), rounds, window, cap), window)

    keys = scratch.keep(by_block([words, rows_of(copies, 1)], first, KEYS), "keys")
    for level in range(1, rounds + 1):
        kept = rows_of(keys, 1, *[f"state{k}" for k in range(6 if level > 1 else 1)])
        parts = [kept, rows_of(_names(keys, level), 2, "names")]
        if level in (1, rounds):
            parts.append(words)
        was = keys
        keys = scratch.keep(by_block(parts, last, CANDIDATES) if level == rounds else by_block(parts, step_to(level), KEYS), "candidates" if level == rounds else "keys")
        scratch.drop(was)
    marks = scratch.keep(_marks(keys.where("marks is null").select([c.split()[0] for c in RUNS.split(", ")]), window).unionByName(keys.where("marks is not null").select("block", "marks")), "marks")
    scratch.drop(keys)

    def remove(block: int, found: dict) -> list[list]:
        data = found[0][0][1]
        ids, words, bounds = unpack(data[0], np.int32), recompress.listed(data[1].split()), unpack(data[2], np.int64)
        docs, nulls = unpack(data[3], np.int64), unpack(data[4], bool)
        steps = np.zeros(len(ids) + 1, np.int64)
        for _, (at,) in found.get(1, []):
            np.add.at(steps, np.frombuffer(at, np.int32), 1)
            np.add.at(steps, np.frombuffer(at, np.int32) + window, -1)
        for part, _ in found.get(2, []):
            if bounds[part + 1] - bounds[part] >= window:
                steps[bounds[part]] += 1
                steps[bounds[part + 1]] -= 1
        stays = np.cumsum(steps)[:-1] == 0
        kept = [b" ".join(words[ids[a:b][stays[a:b]]].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        left = np.concatenate([[0], np.cumsum(stays)])[bounds]
        n = np.diff(bounds)
        return [[None if x else d for d, x in zip(docs.tolist(), nulls, strict=True)], n, n - np.diff(left), kept]

    return by_block([words, rows_of(marks, 1, "marks"), rows_of(copies, 2)], remove, RESULT).withColumn("kept", F.col("kept").cast("string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op5_substring_dedup``: windows of 20 words over all documents."""
    done = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS i FROM d)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later)
), word AS (
  SELECT doc_id, w[p] AS word, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)
), kept AS (
  SELECT word.doc_id, string_agg(word.word, ' ' ORDER BY word.p) FILTER (WHERE gone.p IS NULL) AS t, count(gone.p) AS n
  FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY 1
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
