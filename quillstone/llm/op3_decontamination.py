"""Benchmark decontamination over a distributed positional inverted index.

The index is cut by document: a segment holds the postings of a block of documents
of bounded size, term by term, as ascending word positions; documents are one
position apart, so no phrase runs from one into the next. Segments are rows of a
stored table. Test items go to the workers in blocks of bounded bytes. Each phrase is filed under its
rarest term, by the counts of the whole index; a segment looks up which of its own terms have phrases, and touches
only these. Such a phrase takes the positions of its rarest term in the segment, shifted by the term's
place in the phrase, and intersects them with the shifted lists of its other terms,
rarest first; a phrase with a term that the segment lacks ends at once. Proximity
asks for all terms within a number of words instead.

Words: A-Z are lower-cased, then runs of digits, a-z and all characters from U+0080 on.

Defined results: null and empty texts have no words and are never contaminated;
items without words match nothing; equal item ids count once, and a null id never; repeated rows are
one result each; a document is never cut, a very long one is a segment of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SEGMENT_WORDS = 300_000
_NO_ID = -(1 << 63)


def words(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


SEGMENTS = "files binary, file_of binary, row_ids binary, doc_ids binary, starts binary, counts binary, terms binary, lengths binary, postings binary"


def build_index(docs: DataFrame) -> DataFrame:
    """One row per segment. files, file_of, row_ids: where each document's row is (``scratch.located``); starts, counts: first position and words of each document;
    postings: for each term, in the order of ``terms``, the differences of its positions."""

    def segment(rows: list[tuple]) -> pa.RecordBatch:
        number: dict[bytes, int] = {}
        ids, counts = [], []
        files: dict[str, int] = {}
        file_of = [files.setdefault(r[3], len(files)) for r in rows]
        for _, _, ws, _ in rows:
            ids += [number.setdefault(w, len(number)) for w in ws]
            counts.append(len(ws))
        counts_ = np.array(counts, "<i8")
        starts = np.concatenate([[0], np.cumsum(counts_ + 1)[:-1]]).astype("<i8") if rows else counts_
        position = np.arange(len(ids), dtype="<i8") + np.repeat(np.arange(len(rows)), counts_)
        term = np.array(ids, "<i4")
        order = np.argsort(term, kind="stable")
        sorted_position = position[order]
        lengths = np.bincount(term, minlength=len(number)).astype("<i4")
        delta = np.diff(sorted_position, prepend=0)
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype("i8") if len(number) else np.zeros(0, "i8")
        delta[first] = sorted_position[first]
        values = [
            "\n".join(files).encode(),
            np.array(file_of, "<i4").tobytes(),
            np.array([r[0] for r in rows], "<i8").tobytes(),
            np.array([_NO_ID if r[1] is None else r[1] for r in rows], "<i8").tobytes(),
            starts.tobytes(),
            counts_.tobytes(),
            b" ".join(number),
            lengths.tobytes(),
            delta.astype("<u4").tobytes(),
        ]
        names = [c.split()[0] for c in SEGMENTS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row, doc, text, file in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                ws = words(text)
                if rows and size + len(ws) > SEGMENT_WORDS:
                    yield segment(rows)
                    rows, size = [], 0
                rows.append((row, doc, ws, file))
                size += len(ws)
        if rows:
            yield segment(rows)

    keyed = scratch.located(docs).select("__row", F.col("doc_id").cast("long").alias("doc_id"), "text", "__file")
    return keyed.mapInArrow(run, SEGMENTS)


class Segment:
    """Posting lists of one stored segment, of the wanted terms only."""

    def __init__(self, row: dict, wanted: set[bytes]):
        files, file_of = row["files"].decode().split("\n"), np.frombuffer(row["file_of"], "<i4")
        self.files = [files[k] for k in file_of]
        self.row_ids, self.doc_ids, self.starts, self.counts = (np.frombuffer(row[k], "<i8") for k in ("row_ids", "doc_ids", "starts", "counts"))
        lengths = np.frombuffer(row["lengths"], "<i4").astype("i8")
        ends = np.cumsum(lengths)
        delta = np.frombuffer(row["postings"], "<u4")
        terms = row["terms"].split(b" ") if row["terms"] else []
        self.postings = {t: np.cumsum(delta[ends[k] - lengths[k] : ends[k]].astype("i8")) for k, t in enumerate(terms) if t in wanted}
        self.size = int(self.starts[-1] + self.counts[-1] + 1) if len(self.starts) else 0

    def phrase(self, window: tuple[bytes, ...]) -> np.ndarray:
        """Positions at which the window's words stand one after the other."""
        lists = []
        for k, t in enumerate(window):
            found = self.postings.get(t)
            if found is None:
                return np.zeros(0, "i8")
            lists.append((len(found), k, found))
        lists.sort(key=lambda x: x[:2])
        _, k, found = lists[0]
        at = found - k
        for _, k, found in lists[1:]:
            if not len(at):
                break
            place = np.searchsorted(found, at + k)
            place[place == len(found)] = 0
            at = at[found[place] == at + k]
        return at

    def proximity(self, terms: set[bytes], within: int) -> np.ndarray:
        """(first, last) positions of the shortest stretches of at most ``within`` words that hold all ``terms``."""
        if not terms or any(t not in self.postings for t in terms):
            return np.zeros((0, 2), "i8")
        tagged = sorted((int(p), k) for k, t in enumerate(sorted(terms)) for p in self.postings[t])
        last, out = {}, []
        for p, k in tagged:
            last[k] = p
            low = min(last.values()) if len(last) == len(terms) else -1
            if low >= 0 and p - low < within and np.searchsorted(self.starts, p, "right") == np.searchsorted(self.starts, low, "right"):
                out.append((low, p))
        return np.array(out, "i8").reshape(-1, 2)


RESULT = "__file string, __row bigint, doc_id bigint, n_words bigint, spans array<struct<first:bigint,n:bigint>>, items array<string>"


def windows_of(text: str | None, size: int) -> set[tuple[bytes, ...]]:
    ws = words(text)
    if not ws:
        return set()
    return {tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))}


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple]]:
    """(item_id, text) in lists of at most ``limit`` bytes of text (or one item)."""
    block, size = [], 0
    for r in items.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        n = len((r.text or "").encode())
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += n
    yield block


#: What the tasks of a worker have made of the last block of items.
_filed: dict[str, tuple] = {}


def _file(token: str, block: list[tuple], counts: dict[bytes, int], window: int, within: int | None) -> tuple[set, dict]:
    """(terms of all phrases, phrases with their items by rarest term) of a block of items."""
    if token not in _filed:
        phrases: dict[tuple, set] = {}
        for item, text in block:
            for w in [tuple(sorted(set(words(text))))] if within else windows_of(text, window):
                phrases.setdefault(w, set()).add(item)
        phrases.pop((), None)
        by_rarest: dict[bytes, list] = {}
        for w, ids in phrases.items():
            if all(t in counts for t in w):
                by_rarest.setdefault(min(w, key=lambda t: (counts[t], t)), []).append((w, ids))
        _filed.clear()
        _filed[token] = ({t for w in phrases for t in w}, by_rarest)
    return _filed[token]


def _counts(index: DataFrame, terms: set[bytes]) -> dict[bytes, int]:
    """How often each of ``terms``, a bounded set, stands in the whole index."""
    sent = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}
        for batch in batches:
            for listed, lengths in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for t, n in zip(listed.split(b" "), np.frombuffer(lengths, "<i4").tolist(), strict=False):
                    if t in sent.value:
                        found[t] = found.get(t, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

    rows = index.select("terms", "lengths").mapInArrow(run, "term binary, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    sent.destroy()
    return {bytes(r.term): r.n for r in rows}


def search(index: DataFrame, items: DataFrame, window: int = 10, within: int | None = None, block_bytes: int = 8 << 20) -> DataFrame:
    """Per document: __file, __row (its place), doc_id, n_words, spans of hit words (from 0, merged) and items found.

    Phrases of ``window`` words of each item; with ``within``, all distinct words of an
    item within so many words. Items are taken in blocks, each of which passes over the
    index once, so what a worker holds is bounded whatever the number of items.
    """
    spark, found = index.sparkSession, []
    names = [c.split()[0] for c in SEGMENTS.split(", ")]

    def pass_over(block: list[tuple]) -> DataFrame:
        token = scratch.token()
        sent = spark.sparkContext.broadcast((block, _counts(index, {t for _, text in block for t in words(text)})))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted, by_rarest = _file(token, *sent.value, window, within)
            for batch in batches:
                for row in batch.select(names).to_pylist():
                    seg = Segment(row, wanted)
                    hit = np.zeros(seg.size + 1, bool)
                    found_items: dict[int, set] = {}
                    for w, item_ids in (x for t in seg.postings for x in by_rarest.get(t, ())):
                        pairs = seg.proximity(set(w), within) if within else None
                        starts = pairs[:, 0] if within else seg.phrase(w)
                        if not len(starts):
                            continue
                        ends = pairs[:, 1] + 1 if within else starts + len(w)
                        for a, b in zip(starts, ends, strict=True):
                            hit[a:b] = True
                        for d in np.unique(np.searchsorted(seg.starts, starts, "right") - 1):
                            found_items.setdefault(int(d), set()).update(item_ids)
                    spans = [[] for _ in seg.row_ids]
                    if found_items:
                        edges = np.flatnonzero(np.diff(hit.astype("i1"), prepend=0, append=0))
                        for a, b in edges.reshape(-1, 2):
                            d = int(np.searchsorted(seg.starts, a, "right") - 1)
                            spans[d].append({"first": int(a - seg.starts[d]), "n": int(b - a)})
                    listed = [sorted(x for x in found_items.get(d, ()) if x is not None) for d in range(len(spans))]
                    docs = [None if d == _NO_ID else d for d in seg.doc_ids.tolist()]
                    span_type = pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))
                    arrays = [pa.array(seg.files, pa.string()), pa.array(seg.row_ids), pa.array(docs, pa.int64()), pa.array(seg.counts), pa.array(spans, span_type), pa.array(listed, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["__file", "__row", "doc_id", "n_words", "spans", "items"])

        return index.mapInArrow(run, RESULT)

    for block in _blocks(items, block_bytes):
        found.append(pass_over(block))
    if len(found) == 1:
        return found[0]
    union = found[0]
    for f in found[1:]:
        union = union.unionByName(f)
    merged = union.groupBy("__file", "__row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    return merged


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Per row of ``docs``: __file, __row (its place), doc_id, n_words, n_hit, items, contaminated."""
    index = scratch.keep(build_index(docs), "postings")
    found = search(index, items, window)
    # Words covered by spans that may overlap where items came in several blocks.
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s["first"] + s["n"] - F.greatest(a["end"], s["first"]), F.lit(0))).alias("n"), F.greatest(a["end"], s["first"] + s["n"]).alias("end")
        ),
        lambda a: a["n"],
    )
    return found.select("__file", "__row", "doc_id", "n_words", covered.alias("n_hit"), "items", (F.size("spans") > 0).alias("contaminated"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op3_decontamination``: all documents against all benchmark items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontaminate(docs, items)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM iw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win
), dwin AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM dw, sizes)
), hits AS (SELECT d.doc_id, d.i, d.n, v.item_id FROM dwin d JOIN win v ON d.g = v.g AND d.n = v.n
), pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits
), nh AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY 1
), it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY 1)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN nh USING (doc_id) LEFT JOIN it USING (doc_id)
"""
