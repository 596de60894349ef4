"""op11 against plain counts of all phrases."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("quillstone.llm.registry")

from quillstone.llm import op11_collocations as q  # noqa: E402

RNG = np.random.default_rng(5)
LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute(rows, least, percent, top):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(words)
            for k in range(1, 5):
                f["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        found = {w: a for w, a in count.items() if len(w) > 1 and a >= least}
        inside = {w[i:j] for w, a in found.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and 100 * a >= percent * found[w[i:j]]}
        scored = []
        for w, a in found.items():
            if w not in inside:
                s, _, left, right = min((2_000_000 * a // (count[w[:k]] + count[w[k:]]), k, count[w[:k]], count[w[k:]]) for k in range(1, len(w)))
                scored.append((-s, -a, " ".join(w).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def corpus():
    words = ["the", "of", "New", "york", "new", "é", "É", "x", "x\x00y", "zz ", "日本", "rare"]
    p = np.array([9, 7, 5, 5, 4, 3, 3, 2, 1, 1, 1, 0.2])
    draw = lambda n: " ".join(RNG.choice(words, n, p=p / p.sum()))
    rows = [(draw(60) + RNG.choice([". ", "\t", "\r\n", " ,; ", "  "]) + draw(40), lang) for lang in ("en", "de", None, "und", "") for _ in range(12)]
    rows += [(None, "en"), ("", "en"), (" \t\n", None), ("a.b!c", "fr"), ("la la la la la la", "fr"), rows[0], rows[0], ("the the " * 4000, "en"), ("the of new york, " * 300, "de")]
    return rows


@pytest.mark.parametrize(("block", "part", "at_once"), [(1 << 23, 1 << 20, 1 << 18), (300, 20, 10)])
def test_phrases(spark, monkeypatch, block, part, at_once):
    monkeypatch.setattr(q, "BLOCK_BYTES", block)
    monkeypatch.setattr(q, "PART", part)
    monkeypatch.setattr(q, "AT_ONCE", at_once)
    rows = corpus()
    docs = spark.createDataFrame([(t, lang, 1, "x", 2) for t, lang in rows], "text string, lang string, word int, words string, n int").repartition(3)
    for least, percent, top in ((5, 80, 2000), (3, 50, 7)):
        got = sorted(tuple(r) for r in q.collocations(docs, least, percent, top).collect())
        assert got == brute(rows, least, percent, top) and len(got) > 20


def test_nothing(spark):
    docs = spark.createDataFrame([("a b", "en"), (None, None)], "text string, lang string")
    assert q.collocations(docs).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert q.collocations(docs).count() == 0 and q.collocations(docs.limit(0)).count() == 0


def test_each_phrase_has_one_fragment():
    ids = RNG.integers(0, 6, 3000)
    pivots, around = q.fragments_of(ids)
    expected = Counter()
    for k in range(2, 5):
        expected.update(tuple(ids[i : i + k].tolist()) for i in range(len(ids) - k + 1) if ids[i : i + k].all())
    got = Counter()
    for _, words, n in q.mined(pivots.astype(np.uint64), around.astype(np.uint64), np.zeros(len(pivots), bool), 1):
        got.update({tuple(w): int(c) for w, c in zip(words.tolist(), n, strict=True)})
    assert got == expected


def test_wide_numbers(spark):
    wide = [np.array([1, 1 << 40, 1, 5], np.uint64), np.array([1 << 33, 7, 1 << 33, 5], np.uint64)]
    first, n = q._counted(wide)
    assert sorted(zip(first.tolist(), n.tolist(), strict=True)) == [(0, 2), (1, 1), (3, 1)]
    a = 9_000_000_000_000_000
    phrases = spark.createDataFrame([("en", [1, 2], a), ("en", [1, 2, 3], a * 8 // 10), ("en", [2, 3], a * 8 // 10 + 1)], "lang string, words array<bigint>, a bigint")
    counts = phrases.selectExpr("words", "a f").union(spark.createDataFrame([([1], a), ([2], a + 1), ([3], a)], "words array<bigint>, f bigint"))
    assert [r.words for r in q.without_parts(phrases, 80).collect()] == [[1, 2, 3]]
    found = {tuple(r.words): (r.l, r.r, r.score) for r in q.scored(phrases, counts).collect()}
    assert found[1, 2] == (a, a + 1, 2_000_000 * a // (2 * a + 1)) and found[1, 2, 3] == (a, a, 800_000)
