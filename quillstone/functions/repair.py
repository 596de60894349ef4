"""Events and recall cards out of the JSON that language models write, read leniently.

A reader walks the text once per shape it looks for: a list of records, records written as
bracket blocks, single records. It takes what strict JSON takes and, besides, bare names of the two
fields, backslashes that begin no escape, and a field's value without quotes where the field has a line of its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The fields of an event, how many events an answer may hold, what a backslash may escape.
FIELDS, MAX_EVENTS, ESCAPES = ("title", "summary"), 10, '\\/"bfnrtu'
_JSON = json.JSONDecoder()


class _Unreadable(ValueError):
    pass


class _Reader:
    """A place in a text, moved by what is read there."""

    def __init__(self, text: str, at: int = 0):
        self.text, self.at = text, at

    def _blank(self) -> str:
        """Skip white space; the next character, or nothing at the end."""
        while self.at < len(self.text) and self.text[self.at] in " \t\r\n":
            self.at += 1
        return self.text[self.at : self.at + 1]

    def _take(self, mark: str) -> None:
        if self._blank() != mark:
            raise _Unreadable(mark)
        self.at += 1

    def _string(self) -> str:
        """A quoted string; a backslash before anything that JSON doesn't escape stands for itself."""
        self._take('"')
        body: list[str] = []
        while True:
            c = self.text[self.at : self.at + 1]
            following = self.text[self.at + 1 : self.at + 2]
            if c in ("", "\n"):
                raise _Unreadable("string")
            if c == '"':
                break
            if c == "\\" and following and following in ESCAPES:
                body.append(c + following)
                self.at += 2
            else:
                body.append("\\\\" if c == "\\" else c)
                self.at += 1
        self.at += 1
        try:
            return json.loads('"' + "".join(body) + '"')
        except json.JSONDecodeError as e:
            raise _Unreadable("escape") from e

    def _name(self) -> str:
        if self._blank() == '"':
            return self._string()
        for name in FIELDS:
            if self.text[self.at : self.at + len(name)].lower() == name:
                self.at += len(name)
                return name
        raise _Unreadable("name")

    def _value(self, name: str, own_line: bool) -> Any:
        c = self._blank()
        if c == '"':
            return self._string()
        if own_line and name.lower() in FIELDS and c not in ("[", "{"):
            end = self.text.find("\n", self.at)
            end = len(self.text) if end < 0 else end
            raw = self.text[self.at : end].strip()
            bare = raw.removesuffix(",").strip()
            if bare:
                self.at = self.text.rindex(",", self.at, end) if raw != bare and raw.endswith(",") else end
                return bare
        try:
            value, self.at = _JSON.raw_decode(self.text, self.at)
        except json.JSONDecodeError as e:
            raise _Unreadable("value") from e
        return value

    def record(self, ends: str, begins: str = "") -> dict:
        """Names and values up to the mark ``ends``; the first mark is ``begins`` where one is given."""
        found: dict[str, Any] = {}
        if begins:
            self._take(begins)
        while self._blank() != ends:
            if found:
                self._take(",")
                self._blank()
            own_line = not self.text[self.text.rfind("\n", 0, self.at) + 1 : self.at].strip()
            name = self._name()
            self._take(":")
            found[name] = self._value(name, own_line)
        self._take(ends)
        return found

    def records(self) -> list[dict]:
        """A whole list of records."""
        self._take("[")
        found: list[dict] = []
        while self._blank() != "]":
            if found:
                self._take(",")
            found.append(self.record("}", "{"))
        return found


def _single(raw: str, begins: str, ends: str) -> list[dict]:
    """Every record that is complete between the two marks; a block in brackets has to begin with a quoted title."""
    found, at = [], raw.find(begins)
    while at >= 0:
        reader = _Reader(raw, at)
        try:
            if begins == "[" and not raw[at + 1 :].lstrip()[:7].lower() == '"title"':
                raise _Unreadable("block")
            found.append(reader.record(ends, begins))
            at = reader.at - 1
        except _Unreadable:
            pass
        at = raw.find(begins, at + 1)
    return found


def _readings(raw: str) -> Iterator[Any]:
    """What the answer may be, the likeliest first; None where a reading finds nothing."""
    first, last = raw.find("["), raw.rfind("]")
    if 0 <= first < last:
        try:
            yield json.loads(raw[first : last + 1])
        except json.JSONDecodeError:
            reader = _Reader(raw[first : last + 1])
            try:
                found = reader.records()
                yield found if reader.at == last - first else None
            except _Unreadable:
                yield None
    yield _single(raw, "[", "]") or None
    yield _single(raw, "{", "}") or None


def _text(item: dict, key: str) -> str:
    return str(item.get(key, "")).strip()


def events(raw: str | None) -> list[dict] | None:
    """At most ten events with title and summary; None where nothing can be read, [] where there are none."""
    found = next((x for x in _readings(raw or "") if x is not None), None)
    if not isinstance(found, list):
        return None
    lowered = [{str(k).lower(): v for k, v in x.items()} for x in found if isinstance(x, dict)]
    return [{"title": _text(x, "title"), "summary": _text(x, "summary") or None} for x in lowered if _text(x, "title")][:MAX_EVENTS]


def card(raw: str | None) -> dict | None:
    """Question and answer of the outermost object; None without a question."""
    raw = raw or ""
    first, last = raw.find("{"), raw.rfind("}")
    try:
        found = json.loads(raw[first : last + 1]) if 0 <= first < last else None
    except json.JSONDecodeError:
        found = None
    if not isinstance(found, dict) or not _text(found, "question"):
        return None
    return {"question": _text(found, "question"), "answer": _text(found, "answer") or None}


def model_events(raw: Column) -> Column:
    """``events`` of a column of answers."""

    @F.pandas_udf("array<struct<title:string,summary:string>>")
    def run(answers: pd.Series) -> pd.Series:
        return pd.Series([events(x) for x in answers], dtype=object)

    return run(raw)


def recall_card(raw: Column) -> Column:
    """JSON of ``card`` parsed to a struct; null without a question."""

    @F.pandas_udf("string")
    def run(answers: pd.Series) -> pd.Series:
        found = [card(x) for x in answers]
        return pd.Series([None if x is None else json.dumps(x) for x in found], dtype=object)

    return F.from_json(run(raw), "question string, answer string")
