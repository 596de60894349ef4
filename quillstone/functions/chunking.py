"""Chunkers: plain text, markdown and diffs, as Arrow-batched functions over columns.

Where a chunk ends decides where the next begins, so a text is cut in one loop; where it may be cut is
found once, and every choice is a search in these places. Tables stay distributed and only ``chunk_rows`` explodes them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from functools import reduce
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What ends a sentence, and the marks of headings, files and hunks.
SENTENCE_ENDS, HEADING, FILE, HUNK = ".!?", "#", "diff --git ", "@@ "


class _Places:
    """Where a text may be cut, by kind and ascending: before blank lines, behind sentences, at line ends, at white space."""

    def __init__(self, text: str):
        self.space = [k for k, c in enumerate(text) if c.isspace()]
        self.line = [k for k in self.space if text[k] == "\n"]
        self.paragraph = [k for k, following in zip(self.line, self.line[1:], strict=False) if following == k + 1]
        self.sentence = [k for k in self.space if k and text[k - 1] in SENTENCE_ENDS]

    @staticmethod
    def last(places: list[int], low: int, high: int) -> int | None:
        """The last of ``places`` from ``low`` on and before ``high``."""
        k = bisect_left(places, high) - 1
        return places[k] if k >= 0 and places[k] >= low else None

    def end(self, start: int, limit: int) -> int:
        """The best place behind the middle: a paragraph's before a sentence's, a line's, a word's, and else the limit itself."""
        middle = start + (limit - start) // 2 + 1
        kinds = ((self.paragraph, limit - 1), (self.sentence, limit), (self.line, limit), (self.space, limit))
        found = (self.last(places, middle, high) for places, high in kinds)
        return next((at for at in found if at is not None), limit)

    def again(self, start: int, end: int, overlap: int) -> int:
        """Where the next chunk repeats from: a line that begins at most ``overlap`` before the overlap, else the word that it falls in."""
        back = end - overlap if end - overlap > start else end
        line, word = self.last(self.line, start, back), self.last(self.space, start, back)
        if line is not None and back - line - 1 <= max(overlap, 1):
            return line + 1
        return back if word is None else word + 1


def chunk_text(text: str | None, max_chars: int = 900, overlap: int = 120) -> list[str]:
    """Overlapping chunks that end and start at words wherever there is white space; ``overlap`` is below ``max_chars``."""
    text = (text or "").strip()
    places, repeated = _Places(text), min(max(overlap, 0), max_chars - 1)
    spans, start = [], 0
    while start + max_chars < len(text):
        end = places.end(start, start + max_chars)
        spans.append((start, end))
        start = places.again(start, end, repeated)
        start += len(text[start:]) - len(text[start:].lstrip()) if text[start].isspace() else 0
    spans.append((start, len(text)))
    return [c for c in (text[a:b].strip() for a, b in spans) if c]


def _fitted(parts: list[str], max_chars: int, overlap: int) -> list[str]:
    """Parts without blank ones, long ones in chunks."""
    return [c for p in parts if p.strip() for c in ([p] if len(p) <= max_chars else chunk_text(p, max_chars, overlap))]


def _level(line: str) -> int:
    """How deep a heading is; 0 for other lines."""
    marks = len(line) - len(line.lstrip(HEADING))
    return marks if 1 <= marks <= 6 and line[marks : marks + 1].isspace() else 0


def _grouped(lines: list[str], begins: Callable[[str], bool]) -> list[list[str]]:
    """Lines in stretches, each from one that ``begins`` on; what comes before the first is a stretch too."""
    numbers = accumulate(int(begins(x)) for x in lines)
    return [[x for _, x in rows] for _, rows in groupby(zip(numbers, lines, strict=True), key=lambda r: r[0])]


def chunk_markdown(text: str | None, max_chars: int = 900, overlap: int = 120, title: str | None = None) -> list[str]:
    """Paragraphs by section, each below a line ``title > heading > subheading``, which isn't counted."""
    out: list[str] = []
    open_headings: dict[int, str] = {}
    for section in _grouped((text or "").strip().split("\n"), lambda x: _level(x) > 0):
        level = _level(section[0])
        if level:
            open_headings = {k: v for k, v in open_headings.items() if k < level} | {level: section[0].lstrip(HEADING).strip()}
        # A name that is the one before it is said once.
        names = reduce(lambda said, n: said if not n or said[-1:] == [n] else [*said, n], [(title or "").strip(), *open_headings.values()], [])
        context = " > ".join(names) + "\n\n" if names else ""
        paragraphs = ["\n".join(rows).strip() for filled, rows in groupby(section, key=lambda x: bool(x.strip())) if filled]
        if level and len(paragraphs) > 1 and paragraphs[0] == section[0].strip():  # a heading alone says nothing
            paragraphs = [paragraphs[0] + "\n\n" + paragraphs[1], *paragraphs[2:]]
        out += [context + c for c in _fitted(paragraphs, max_chars, overlap)]
    return out


def chunk_diff(text: str | None, max_chars: int = 1400, overlap: int = 180) -> list[str]:
    """What precedes the first file, then every hunk below its file's header; files without hunks as they are."""
    parts: list[list[str]] = []
    for block in _grouped((text or "").strip().split("\n"), lambda x: x.startswith(FILE)):
        if block[0].startswith(FILE):
            header, *hunks = _grouped(block, lambda x: x.startswith(HUNK))
            parts += [header + h for h in hunks] or [header]
        else:
            parts.append(block)
    return _fitted(["\n".join(p).strip() for p in parts], max_chars, overlap)


def _column(function: Callable, *inputs: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([function(*(None if pd.isna(v) else v for v in row)) for row in zip(*series, strict=True)])

    return run(*inputs)


def text_chunks(text: Column, max_chars: int = 900, overlap: int = 120) -> Column:
    return _column(lambda t: chunk_text(t, max_chars, overlap), text)


def markdown_chunks(text: Column, title: Column, max_chars: int = 900, overlap: int = 120) -> Column:
    return _column(lambda t, name: chunk_markdown(t, max_chars, overlap, name), text, title)


def diff_chunks(text: Column, max_chars: int = 1400, overlap: int = 180) -> Column:
    return _column(lambda t: chunk_diff(t, max_chars, overlap), text)


def chunk_rows(df: DataFrame, chunks: Column, *keys: str) -> DataFrame:
    """``keys``, chunk_index, chunk_text: a row per chunk; rows without chunks have none."""
    return df.select(*keys, F.posexplode(chunks).alias("chunk_index", "chunk_text"))
