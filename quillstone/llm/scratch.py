"""Tables that operators write between their steps.

They go to the folder named in ``spark.checkpoint.dir``, which all executors and
the driver share. Where that is unset (tests on one machine), a folder of the
session's own under the system's temporary directory is set once.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []
_path_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: A write's own shuffle files go as soon as it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """The shared folder of this session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = jsc.get() if jsc.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillstone-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = f"{folder(spark)}/quillstone/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _written.append(path)
    return path


def keep(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet and read it again, which cuts the lineage durably."""
    spark = df.sparkSession
    path = fresh(spark, name)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    kept = spark.read.schema(df.schema).parquet(path)
    _path_of[kept] = path
    return kept


def drop(*kept: DataFrame) -> None:
    """Delete tables that ``keep`` returned; frames that read them must be done with."""
    for df in kept:
        path = _path_of.pop(df)
        delete(df.sparkSession, path)
        _written.remove(path)


def delete(spark: SparkSession, name: str) -> None:
    """Delete a folder, in whatever file system it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def mark() -> int:
    """A point to which ``release`` can go back."""
    return len(_written)


def release(spark: SparkSession, since: int, *kept: DataFrame, spare: str | None = None) -> None:
    """Delete the tables written after ``since`` but ``kept`` and the folder ``spare``; frames that read them must be done with."""
    stay = {spare, *(_path_of[df] for df in kept)}
    for path in _written[since:]:
        if path not in stay:
            delete(spark, path)
    _written[since:] = [path for path in _written[since:] if path in stay]


def token() -> str:
    """A short random name."""
    return uuid.uuid4().hex[:12]


#: Names that ``located`` needs for itself.
_OWN = ("_metadata", "__file", "__row")


def located(df: DataFrame) -> DataFrame:
    """``df`` with ``__file`` and ``__row``: the file that holds a row, and its place there.

    Such a place stays the same however a scan is split, so two scans can be joined on it. A frame that isn't a plain
    scan of Parquet files is written first. Columns of these names get others, which ``original`` undoes.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = [line.strip(" :+-") for line in plan.splitlines() if line.strip()]
    plain = all(n.startswith(("Project ", "Filter ")) or (n.startswith("Relation ") and n.endswith(" parquet")) for n in nodes)
    clash = {c: f"__own{c}" for c in df.columns if c.lower() in _OWN}
    if clash or not plain:
        df = keep(df.withColumnsRenamed(clash), "input")
    return df.withColumns({"__file": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")})


def original(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that a frame had before ``located``."""
    return df.select([F.col(f"`__own{c}`").alias(c) if c.lower() in _OWN else F.col(f"`{c}`") for c in columns])
