"""Blocks of documents as rows of packed arrays, and the parts that come back to them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(x: np.ndarray) -> bytes:
    """An array of numbers, compressed: all first bytes, then all second ones ..."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def pack_words(words: list[bytes]) -> bytes:
    """Byte strings of any content, compressed: how many, their lengths, one behind the other."""
    lengths = np.array([len(w) for w in words], np.uint32)
    return zstandard.ZstdCompressor(1).compress(np.uint32(len(words)).tobytes() + lengths.tobytes() + b"".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = (np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64) + 4 * (n + 1)).tolist()
    return [raw[a:b] for a, b in zip([4 * (n + 1), *ends[:-1]], ends, strict=True)] if n else []


def rows_of(frame: DataFrame, kind: int, *data: str) -> DataFrame:
    """block, kind, part, data: a part of what a block needs."""
    values = F.array(*[F.col(c) for c in data]) if data else F.lit(None)
    part = F.col("part") if "part" in frame.columns else F.lit(0)
    return frame.select("block", F.lit(kind).alias("kind"), part.cast("int").alias("part"), values.cast("array<binary>").alias("data"))


def by_block(parts: list[DataFrame], step: Callable[[int, dict], list[list]], schema: str) -> DataFrame:
    """``step`` of each block, given its rows by kind in order of part, as (part, data)."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [types[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(block: int, found: dict) -> Iterator[pa.RecordBatch]:
            columns = step(block, found)
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields, strict=True)], names=names)

        block, found = None, {}
        for batch in batches:
            for at, kind, part, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if at != block and block is not None:
                    yield from done(block, found)
                    found = {}
                block = at
                found.setdefault(kind, []).append((part, data))
        if block is not None:
            yield from done(block, found)

    return rows.repartition("block").sortWithinPartitions("block", "kind", "part").mapInArrow(run, schema)
