"""Folders of tables that change by one switch: a manifest names what is live, and is replaced whole."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CURRENT = "_current.json"


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def load(spark: SparkSession, root: str, name: str = CURRENT) -> dict | None:
    """The manifest of a folder, or None."""
    path, fs = _fs(spark, f"{root}/{name}")
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def commit(spark: SparkSession, root: str, manifest: dict, name: str = CURRENT) -> None:
    """Replace the manifest: it is written beside the old one, whose name it takes at once."""
    path, fs = _fs(spark, f"{root}/{name}")
    beside, _ = _fs(spark, f"{root}/_{uuid.uuid4().hex}.json")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(path), how)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none where it isn't there."""
    where, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()) if fs.exists(where) else []


def is_whole(spark: SparkSession, path: str) -> bool:
    """Whether a write to a folder ended well."""
    where, fs = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _fs(spark, path)
    fs.delete(where, True)


def content(df: DataFrame) -> dict[str, int]:
    """n, and two sums over hashes of whole rows: the same for the same rows in any order, another for a changed value."""
    values = [F.array_sort(F.map_entries(f"`{f.name}`")) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in df.schema]
    # Hashes skip nulls, so where these stand counts too.
    row = [*[v.isNull() for v in values], *values]
    hashed = lambda seed: F.xxhash64(F.lit(seed), *row)
    found = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(hashed(1).cast("decimal(20,0)")), F.lit(0)).alias("sum"), F.coalesce(F.bit_xor(hashed(2)), F.lit(0)).alias("xor")).first()
    return {"n": found["n"], "sum": int(found["sum"]), "xor": found["xor"], "columns": [f"{f.name} {f.dataType.simpleString()}" for f in df.schema]}
