"""Exact token counts without ids.

1. Documents become blocks, written once: each holds its distinct pre-tokens, and its documents as frequencies of units (one or few
   pre-tokens between two spaces), common units first.
2. Distinct pre-tokens of all blocks meet in buckets, where the tokenizer is asked once per distinct one how many pieces it has.
3. The numbers join their blocks, and each document's frequencies are summed with them.

A pre-token that stands in every document is one entry per block, so no key is hot.

Defined results: a null text counts as empty, an empty text has 0 tokens, repeated
rows are counted once each, rows of equal texts or ids tie in nothing, an empty table gives no rows, and other columns are
ignored. A text is never cut; a very long one is a block of its own, held by one worker in about 20 bytes a word. A special token's
string inside a text is one token, as the library's default has it. A tokenizer file that isn't plain byte-level BPE is an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .blocks import by_block, pack, pack_words, rows_of, unpack, unpack_words
from .bpe import PRE_TOKEN, encode, plain, rank_encoder, tokenizer, units

#: Bytes of text in a block, and pre-tokens measured at once.
BLOCK_BYTES, BUCKET_KEYS = 8 << 20, 250_000


def _splitter(path: str):
    """A function from a unit to its pre-tokens; special strings stand alone."""
    import regex

    find = regex.compile(PRE_TOKEN).findall
    special = [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]
    if not special:
        return find
    around = regex.compile("(" + "|".join(map(regex.escape, special)) + ")")

    def split(unit: str) -> list[str]:
        if not around.search(unit):
            return find(unit)
        return [p for k, part in enumerate(around.split(unit)) for p in ([part] if k % 2 else find(part))]

    return split


def _unit_list(text: str) -> list[str]:
    """Units of a text; those after the first of a plain text get their space back."""
    if not text:
        return []
    if plain(text):
        head, *rest = text.split(" ")
        return [head, *[" " + r for r in rest]]
    return units(text)


BLOCK = "docs binary, sizes binary, bounds binary, steps binary, counts binary, splits binary, parts binary, keys binary, crcs binary, n_keys bigint"


def _blocks(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """block, and of its documents: ids, bytes, where their units begin, the ascending numbers of their distinct units (as steps) and how
    often each stands; of each distinct unit: how many pre-tokens it has, and which; the distinct pre-tokens in order of their checksum."""

    def emit(split, docs_: list, texts: list[bytes]) -> pa.RecordBatch:
        lists = [_unit_list(t.decode()) for t in texts]
        lengths = np.array([len(x) for x in lists], np.int64)
        distinct = list(dict.fromkeys(chain.from_iterable(lists)))
        number = {u: k for k, u in enumerate(distinct)}
        ids = np.fromiter(map(number.__getitem__, chain.from_iterable(lists)), np.int64, int(lengths.sum()))
        by_use = np.argsort(-np.bincount(ids, minlength=len(distinct)), kind="stable")
        rank = np.empty(len(distinct), np.int64)
        rank[by_use] = np.arange(len(distinct))
        distinct = [distinct[k] for k in by_use]
        owner = np.repeat(np.arange(len(texts)), lengths)
        pairs, counts = np.unique(owner * max(1, len(distinct)) + rank[ids], return_counts=True)
        owner, units_ = np.divmod(pairs, max(1, len(distinct)))
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        steps = np.diff(units_, prepend=0)
        first = bounds[:-1][np.diff(bounds) > 0]
        steps[first] = units_[first]
        pieces = [split(u) for u in distinct]
        keys = [k.encode() for k in dict.fromkeys(chain.from_iterable(pieces))]
        crcs = np.fromiter(map(zlib.crc32, keys), np.uint32, len(keys))
        order = np.argsort(crcs, kind="stable")
        place = dict(zip((keys[k].decode() for k in order), range(len(keys)), strict=True))
        parts = np.fromiter(map(place.__getitem__, chain.from_iterable(pieces)), np.int32, sum(map(len, pieces)))
        values = [pack(np.array(docs_, np.int64)), pack(np.array([len(t) for t in texts], np.int64)), pack(bounds.astype(np.int64)), pack(steps.astype(np.int32)), pack(counts.astype(np.uint32)), pack(np.array([len(p) for p in pieces], np.int32)), pack(parts)]
        values += [pack_words([keys[k] for k in order]), pack(crcs[order])]
        arrays = [*(pa.array([v], pa.binary()) for v in values), pa.array([len(keys)], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in BLOCK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, docs_, texts, size = _splitter(tokenizer_path), [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if texts and size + len(text) > BLOCK_BYTES:
                    yield emit(split, docs_, texts)
                    docs_, texts, size = [], [], 0
                docs_.append(_NO_ID if doc is None else doc)
                texts.append(text)
                size += len(text)
        if texts:
            yield emit(split, docs_, texts)

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, BLOCK)
    return scratch.keep(made.withColumn("block", F.monotonically_increasing_id()), "blocks")


def pre_token_pieces(blocks: DataFrame, tokenizer_path: str) -> DataFrame:
    """block, part, pieces: how many pieces each of a block's pre-tokens has, bucket by bucket; each distinct one is measured once."""
    spark = blocks.sparkSession
    total = blocks.agg(F.coalesce(F.sum("n_keys"), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_KEYS + 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys, crcs in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words = unpack_words(keys)
                part = (unpack(crcs, np.uint32).astype(np.uint64) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
                ends = (np.append(np.flatnonzero(np.diff(part)) + 1, len(part)) if len(part) else np.zeros(0, int)).tolist()
                begins = [0, *ends[:-1]][: len(ends)]
                cut = [pack_words(words[i:j]) for i, j in zip(begins, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(part[begins], pa.int32()), pa.array([block] * len(ends), pa.int64()), pa.array(cut, pa.binary())], names=["part", "block", "keys"])

    def measure(part: int, rows: list[tuple]) -> pa.RecordBatch:
        lists = [unpack_words(keys) for _, keys in rows]
        distinct = list(dict.fromkeys(chain.from_iterable(lists)))
        sizes: list[int] = []
        for at in range(0, len(distinct), 20_000):
            sizes += map(len, encode(tokenizer_path, [w.decode() for w in distinct[at : at + 20_000]]))
        known = dict(zip(distinct, sizes, strict=True))
        found = [pack(np.fromiter(map(known.__getitem__, x), np.int64, len(x))) for x in lists]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array(found, pa.binary())], names=["block", "part", "pieces"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []
        for batch in batches:
            for at, block, keys in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if at != part and rows:
                    yield measure(part, rows)
                    rows = []
                part = at
                rows.append((block, keys))
        if rows:
            yield measure(part, rows)

    dealt = blocks.where("n_keys > 0").select("block", "keys", "crcs").mapInArrow(deal, "part int, block bigint, keys binary")
    return dealt.repartition("part").sortWithinPartitions("part", "block").mapInArrow(run, "block bigint, part int, pieces binary")


_NO_ID = -(1 << 63)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) per row of ``docs``."""
    if rank_encoder(tokenizer_path) is None:
        raise ValueError(f"{tokenizer_path} is no plain byte-level BPE, whose pre-tokens are known")
    blocks = _blocks(docs, tokenizer_path)

    def total(block: int, found: dict) -> list[list]:
        data = found[0][0][1]
        doc, sizes, bounds = (unpack(d, np.int64) for d in data[:3])
        steps, counts, splits, parts = (unpack(d, t) for d, t in zip(data[3:], (np.int32, np.uint32, np.int32, np.int32), strict=True))
        pieces = np.concatenate([unpack(d[0], np.int64) for _, d in found[1]]) if 1 in found else np.zeros(0, np.int64)
        sums = np.concatenate([[0], np.cumsum(pieces[parts])])
        ends = np.cumsum(splits)
        of_unit = sums[ends] - sums[ends - splits]
        run = np.cumsum(steps, dtype=np.int64)
        begin = np.repeat(bounds[:-1], np.diff(bounds))
        units_ = run - (run[begin] - steps[begin])
        tokens = np.concatenate([[0], np.cumsum(of_unit[units_] * counts)])[bounds]
        return [[None if d == _NO_ID else d for d in doc.tolist()], sizes, np.diff(tokens)]

    rows = [rows_of(blocks, 0, "docs", "sizes", "bounds", "steps", "counts", "splits", "parts"), rows_of(pre_token_pieces(blocks, tokenizer_path), 1, "pieces")]
    return by_block(rows, total, "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op1_token_counts``: tokens of every whole document by the 50k byte-level vocabulary."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
