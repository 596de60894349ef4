"""Vector functions over array<float> columns, JVM-side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import tokenize


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


#: Components of unit vectors are summed as whole numbers of this part of one, so sums are the same in any order and can be taken back.
UNIT = 1 << 40


def unit_sums(df: DataFrame, keys: list[str], vector: str, weight: str | None = None, groups_at_once: int = 10_000) -> DataFrame:
    """``keys``, total, n: sums of unit vectors and how many there are; ``weight`` (1 or -1) adds or takes back.

    Each task sums its own rows first, a batch by one reduction, so a group is shuffled as one sum per task. Zero vectors and those with a
    number that isn't finite count as zero. ``total`` is exact: its first half counts 2**32 parts, its second half the rest.
    """

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple, tuple] = {}
        for pdf in frames:
            if not len(pdf):
                continue
            x = np.stack(pdf["__v"].to_numpy()).astype(float)
            x[~np.isfinite(x).all(axis=1)] = 0.0
            length = np.sqrt((x * x).sum(axis=1, keepdims=True))
            sign = pdf["__w"].to_numpy()
            parts = np.rint(x / np.where(length > 0, length, 1.0) * UNIT).astype(np.int64) * sign[:, None]
            code = pdf.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            sums, counts = np.zeros((code.max() + 1, x.shape[1]), np.int64), np.zeros(code.max() + 1, np.int64)
            np.add.at(sums, code, parts)
            np.add.at(counts, code, sign)
            first = np.unique(code, return_index=True)[1]
            for k, key in enumerate(pdf[keys].iloc[first].itertuples(index=False, name=None)):
                total, n = found.get(_plain(key), (0, 0))
                found[_plain(key)] = (_carried(total + np.concatenate([sums[k] >> 32, sums[k] & _LOW])), n + counts[k])
            if len(found) > groups_at_once:
                yield _frame(keys, found)
                found = {}
        if found:
            yield _frame(keys, found)

    sign = F.lit(1) if weight is None else F.col(weight)
    rows = df.where(F.col(vector).isNotNull()).select(*keys, F.col(vector).alias("__v"), sign.cast("long").alias("__w"))
    return merged_sums(rows.mapInPandas(add, _sums_schema(df, keys)), keys)


def merged_sums(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of equal ``keys`` (keys, total, n) as one."""

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Equal keys are neighbours, so one is held at a time."""
        key, total, n = None, 0, 0
        for pdf in frames:
            done = []
            for *k, s, m in pdf.itertuples(index=False, name=None):
                k = _plain(k)
                if k != key:
                    if key is not None:
                        done.append((*key, total.tolist(), n))
                    key, total, n = k, 0, 0
                total, n = _carried(total + np.asarray(s, np.int64)), n + m
            if done:
                yield pd.DataFrame(done, columns=[*keys, "total", "n"])
        if key is not None:
            yield _frame(keys, {key: (total, n)})

    rows = parts.select(*keys, "total", "n")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(merge, _sums_schema(parts, keys))


_LOW = (1 << 32) - 1


def _carried(total: np.ndarray) -> np.ndarray:
    half = len(total) // 2
    return np.concatenate([total[:half] + (total[half:] >> 32), total[half:] & _LOW])


def _plain(key) -> tuple:
    """A key whose nulls are equal to each other."""
    return tuple(None if k is None or k != k else k for k in key)


def _frame(keys: list[str], found: dict) -> pd.DataFrame:
    return pd.DataFrame([(*k, t.tolist(), n) for k, (t, n) in found.items()], columns=[*keys, "total", "n"])


def _sums_schema(df: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType([*[df.schema[k] for k in keys], T.StructField("total", T.ArrayType(T.LongType())), T.StructField("n", T.LongType())])


def centroid(total: Column) -> Column:
    """A sum of ``unit_sums`` at unit length (a zero sum stays)."""
    half = (F.size(total) / 2).cast("int")
    x = F.zip_with(F.slice(total, F.lit(1), half), F.slice(total, half + 1, half), lambda high, low: high * F.lit(4294967296.0) + low)
    length = norm(x)
    return F.transform(x, lambda v: v / F.when(length > 0, length).otherwise(1.0))


def centroids(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """``keys`` and centroid: the mean of unit vectors, at unit length (a zero mean stays)."""
    return unit_sums(df, keys, vector).select(*keys, centroid(F.col("total")).alias("centroid"))


def pack(vector: Column) -> Column:
    """A vector as bytes: 32-bit floats, little-endian."""

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return run(vector)


def unpack(packed: Column) -> Column:
    """What ``pack`` was given, of imported tables."""

    @F.pandas_udf("array<float>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else np.frombuffer(b, "<f4").tolist())

    return run(packed)


def node_text(title: Column, content: Column) -> Column:
    """What a node's vector is made of: title and content on lines of their own."""
    return F.regexp_replace(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(content, F.lit(""))), r"(?U)^\s+|\s+$", "")


def bucket_embedding(text: Column, dim: int = 64) -> Column:
    """Deterministic embedding for tests: token counts by the last byte of their md5 (``dim`` divides 256)."""
    buckets = F.transform(tokenize(text), lambda t: F.conv(F.right(F.md5(t), F.lit(2)), 16, 10).cast("int") % dim)
    counts = F.transform(F.array(buckets), lambda b: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: (F.size(b) - F.size(F.array_remove(b, k))).cast("float")))
    return F.element_at(counts, 1)
