"""Scans of markdown folders and of files of evaluation queries."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking
from ..functions.text import fingerprint

# The fence of a note's front matter, the fields that date it there and in the body, lines of the body that are searched.
FENCE, FRONT_FIELDS, BODY_FIELDS, HEAD_LINES = "---", ["date", "created"], ["date"], 12


def _field(lines: Column, names: list[str]) -> Column:
    """The value of the first of ``lines`` that gives one of ``names`` a value, or null."""
    name = lambda x: F.lower(F.rtrim(F.substring_index(x, ":", 1)))
    value = lambda x: F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x)))
    given = F.filter(lines, lambda x: x.contains(":") & name(x).isin(names) & (value(x) != ""))
    return F.get(F.transform(given, value), F.lit(0))


def note_date(text: Column) -> Column:
    """The declared date as a timestamp (UTC sessions: a bare date is midnight UTC), or null."""
    lines = F.split(F.regexp_replace(text, "^\ufeff", ""), r"\r\n|\n|\r")
    fences = F.filter(F.transform(lines, lambda x, k: F.when(F.rtrim(x) == FENCE, k + 1)), lambda k: k.isNotNull())
    closed = (F.rtrim(F.get(lines, F.lit(0))) == FENCE) & (F.size(fences) > 1)
    end = F.when(closed, F.get(fences, F.lit(1))).otherwise(0)
    front = F.slice(lines, F.lit(1), end)
    head = F.slice(lines, end + 1, F.lit(HEAD_LINES))
    raw = F.btrim(F.coalesce(_field(front, FRONT_FIELDS), _field(head, BODY_FIELDS)), F.lit(" \"'"))
    day = F.try_to_timestamp(F.substring(raw, 1, 10), F.lit("yyyy-MM-dd"))
    return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}"), F.coalesce(raw.try_cast("timestamp"), day))


def _decoded(content: Column) -> Column:
    """UTF-8 without what can't be decoded."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda b: b.decode("utf-8", "ignore"))

    return run(content)


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """A row per ``*.md`` below ``folder``: source_uri, title, timestamp, bytes, fingerprint, text."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(folder)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(folder) from e
        raise
    uri = F.regexp_replace("path", "^file:/+", "/")
    notes = files.select(uri.alias("source_uri"), "modificationTime", F.col("length").alias("bytes"), _decoded(F.col("content")).alias("text"))
    return notes.select(
        "source_uri",
        F.regexp_extract("source_uri", r"([^/]+)\.md$", 1).alias("title"),
        F.coalesce(note_date(F.col("text")), "modificationTime").alias("timestamp"),
        "bytes",
        fingerprint(F.col("text")).alias("fingerprint"),
        "text",
    )


def markdown_chunks(notes: DataFrame) -> DataFrame:
    """source_uri, chunk_index, chunk_text of scanned notes."""
    return chunking.chunk_rows(notes, chunking.markdown_chunks(F.col("text"), F.col("title")), "source_uri")


def evaluation_queries(spark: SparkSession, path: str) -> DataFrame:
    """query_text, expected_source_uris of a JSON list; ValueError where an entry has another shape."""
    schema = "query_text string, expected_source_uris array<string>, _corrupt string"
    rows = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    bad = rows.where("_corrupt is not null or query_text is null or expected_source_uris is null").limit(1)
    if not bad.isEmpty():
        raise ValueError(f"{path}: each entry needs query_text and a list expected_source_uris")
    return rows.drop("_corrupt")
