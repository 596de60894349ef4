"""Scans of PDF files by page and of images by their recognised text, where the optional libraries are installed."""

from __future__ import annotations

import importlib.util
import io
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking

# Names of image files.
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tif", ".tiff", ".webp"]


class MissingBackend(RuntimeError):
    """A library that a kind of file needs isn't installed."""


def _installed(*modules: str) -> bool:
    return all(importlib.util.find_spec(m) is not None for m in modules)


def has_pdf() -> bool:
    return _installed("pypdf")


def has_ocr() -> bool:
    return _installed("pytesseract", "PIL")


def require(kind: str) -> None:
    """Raise ``MissingBackend`` where files of the kind (pdf, image) can't be read."""
    if not {"pdf": has_pdf, "image": has_ocr}[kind]():
        raise MissingBackend(f"reading {kind} files needs " + {"pdf": "pypdf", "image": "pytesseract and Pillow"}[kind])


def _binary(spark: SparkSession, path: str, suffixes: list[str]) -> DataFrame:
    """source_uri, title, timestamp, content of the files of a folder (or of one file) with these suffixes, in any case."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from e
        raise
    wanted = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(suffixes)
    uri = F.regexp_replace("path", "^file:/+", "/")
    return files.where(wanted).select(uri.alias("source_uri"), F.regexp_extract(uri, r"([^/]+)\.[^./]+$", 1).alias("title"), F.col("modificationTime").alias("timestamp"), "content")


def _fingerprint(engine: str, version: str, content: str = "content"):
    return F.sha2(F.concat(F.lit(f"{engine}\x1f{version}\x1f").cast("binary"), F.col(content)), 256)


def pages_of(content: bytes, uri: str, library=None) -> list[str]:
    """Text of each page; an empty password is tried. ValueError where the file can't be read."""
    if library is None:
        import pypdf as library
    try:
        reader = library.PdfReader(io.BytesIO(content))
    except Exception as e:
        raise ValueError(f"{uri} can't be read: {e}") from e
    if reader.is_encrypted:
        try:
            opened = bool(reader.decrypt(""))
        except Exception:  # any refusal of the library
            opened = False
        if not opened:
            raise ValueError(f"{uri} needs a password")
    return [p.extract_text() or "" for p in reader.pages]


def pdf_pages(spark: SparkSession, path: str, read=pages_of, version: str = "1") -> DataFrame:
    """source_uri, title, timestamp, fingerprint, page (from 1), text of all PDF files."""
    if read is pages_of:
        require("pdf")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                texts = read(r.content, r.source_uri)
                yield pd.DataFrame({"source_uri": r.source_uri, "title": r.title, "timestamp": r.timestamp, "fingerprint": r.fingerprint, "page": range(1, len(texts) + 1), "text": texts})

    files = _binary(spark, path, [".pdf"]).withColumn("fingerprint", _fingerprint("pypdf", version))
    return files.mapInPandas(run, "source_uri string, title string, timestamp timestamp, fingerprint string, page int, text string")


def page_chunks(pages: DataFrame) -> DataFrame:
    """source_uri, chunk_index (across the pages of a file), page, chunk_text."""
    from pyspark.sql import Window

    each = pages.select("source_uri", "page", F.posexplode(chunking.text_chunks(F.col("text"))).alias("__at", "chunk_text"))
    index = F.row_number().over(Window.partitionBy("source_uri").orderBy("page", "__at")) - 1  # a file's own chunks
    return each.select("source_uri", index.alias("chunk_index"), "page", "chunk_text")


def mean_confidence(words: list[tuple[str, float]]) -> float | None:
    """Mean confidence, from 0 to 1, of words that aren't blank and have one; None without any."""
    told = [c for w, c in words if w.strip() and c >= 0]
    return sum(told) / len(told) / 100 if told else None


def recognised(content: bytes) -> tuple[str, list[tuple[str, float]]]:
    """(text, words with their confidence) of an image."""
    import pytesseract
    from PIL import Image

    with Image.open(io.BytesIO(content)) as image:
        picture = image.convert("RGB")
        told = pytesseract.image_to_data(picture, output_type=pytesseract.Output.DICT)
        return pytesseract.image_to_string(picture) or "", [(str(w), float(c)) for w, c in zip(told["text"], told["conf"], strict=False)]


def image_texts(spark: SparkSession, path: str, read=recognised, version: str = "1") -> DataFrame:
    """source_uri, title, timestamp, fingerprint, text, ocr_confidence of all images; one without text is a row all the same."""
    if read is recognised:
        require("image")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [read(c) for c in pdf["content"]]
            yield pdf.drop(columns="content").assign(text=[t for t, _ in found], ocr_confidence=pd.Series([mean_confidence(w) for _, w in found], dtype="float64").to_numpy())

    files = _binary(spark, path, IMAGE_SUFFIXES).withColumn("fingerprint", _fingerprint("tesseract", version)).select("source_uri", "title", "timestamp", "fingerprint", "content")
    return files.mapInPandas(run, "source_uri string, title string, timestamp timestamp, fingerprint string, text string, ocr_confidence double")


def name_of(uri: str) -> str:
    """A file's name without its suffix."""
    return PurePosixPath(uri).stem
