import json
import random

import pytest
from pyspark.sql import functions as F

from quillstone.functions import chunking, repair
from quillstone.sources import notes


RIVERS = "Elbe Oder Main Isar Saale Spree Neckar Mosel Havel Weser".split()


def test_chunk_text():
    rng = random.Random(5)
    tour = " ".join(f"{rng.choice(RIVERS)}{k}" for k in range(300))
    found = chunking.chunk_text(tour, 130, 25)
    assert {w for c in found for w in c.split()} == set(tour.split()) and max(map(len, found)) <= 130
    # Every chunk is a stretch of the text, and neighbours overlap or touch.
    ends = 0
    for c in found:
        at = tour.index(c)
        assert at <= ends + 1 < at + len(c) + 1
        ends = at + len(c)
    diary = " ".join(f"On day {k} we rowed down the {rng.choice(RIVERS)}{'!' if k % 3 else '?'}" for k in range(50))
    assert all(c[-1] in "!?" for c in chunking.chunk_text(diary, 220, 35))
    bare = "".join(rng.choice("xyz") for _ in range(333))
    assert "".join(chunking.chunk_text(bare, 90, 0)) == bare and chunking.chunk_text(bare, 90, 200)[1] == bare[1:91]
    listed = "\n".join(f"* {r} is long" for r in RIVERS * 4)
    assert all(c.startswith("* ") and c.endswith("long") for c in chunking.chunk_text(listed, 100, 20))
    blocks = "\n\n".join(" ".join(rng.sample(RIVERS, 8)) for _ in range(12))
    assert all(c in blocks.split("\n\n") or "\n\n" in c for c in chunking.chunk_text(blocks, 120, 0))
    assert chunking.chunk_text(None) == chunking.chunk_text(" \t\n") == [] and chunking.chunk_text("\tMain\n") == ["Main"]


def test_chunk_markdown():
    found = chunking.chunk_markdown("before\n\n# Tour\n\nrow\n\nrest\n### Locks\ntwo\n \nthree\n## Weirs\nnone\n\n# Tour\n#no heading", title=" Tour ")
    assert found == [
        "Tour\n\nbefore", "Tour\n\n# Tour\n\nrow", "Tour\n\nrest", "Tour > Locks\n\n### Locks\ntwo", "Tour > Locks\n\nthree", "Tour > Weirs\n\n## Weirs\nnone", "Tour\n\n# Tour\n#no heading",
    ]
    assert chunking.chunk_markdown(None) == [] and chunking.chunk_markdown("plain") == ["plain"]


def test_chunk_diff():
    text = "commit: x\n\ndiff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -1 +1 @@\n-a\n+b\n@@ -9 +9 @@\n-c\ndiff --git a/g b/g\nold mode 1"
    found = chunking.chunk_diff(text)
    assert [c.splitlines()[0] for c in found] == ["commit: x", "diff --git a/f b/f", "diff --git a/f b/f", "diff --git a/g b/g"]
    assert found[2].endswith("@@ -9 +9 @@\n-c")


def test_repair():
    one = [{"title": "x", "summary": "y"}]
    for raw in ['say [{"title": "x", "summary": "y"}] ok', '[{title: "x", summary: "y"}]', '[{"Title": "x", "summary": "y"}, {"title": "z', '[ "title": "x", "summary": "y" ]', '[{\n"title": x,\n"summary": y\n}]']:
        assert repair.events(raw) == one, raw
    assert repair.events('[{"title": "a \\implies b"}]') == [{"title": "a \\implies b", "summary": None}]
    assert repair.events("[]") == [] and repair.events("no") is None and repair.events(None) is None
    assert repair.card('x {"question": "q"} y') == {"question": "q", "answer": None} and repair.card('{"answer": "a"}') is None


def test_repair_columns(spark):
    df = spark.createDataFrame([('[{"title": "x"}]', '{"question": "q", "answer": "a"}'), ("no", "no"), (None, None)], "e string, c string")
    rows = df.select(repair.model_events(F.col("e")).alias("e"), repair.recall_card(F.col("c")).alias("c")).collect()
    assert rows[0].e[0].title == "x" and rows[0].c.answer == "a" and rows[1].e is None and rows[2].c is None


def test_markdown_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_bytes(b"---\ndate: 2026-01-02\n---\n# H\nbody \xff")
    (tmp_path / "sub" / "b.md").write_text("# H\nDate: 2026-01-03T04:05:06Z\nbody")
    (tmp_path / "c.md").write_text("---\ndate: soon\n---\nDate: 2026-01-04\n")
    rows = {r.title: r for r in notes.markdown(spark, str(tmp_path)).select("title", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), "text", "source_uri").collect()}
    assert rows["a"].at == "2026-01-02 00:00:00" and rows["a"].text.endswith("body ") and rows["b"].at == "2026-01-03 04:05:06"
    assert not rows["c"].at.startswith("2026-01-04") and rows["b"].source_uri == str(tmp_path / "sub" / "b.md")
    found = notes.markdown_chunks(notes.markdown(spark, str(tmp_path))).where("source_uri like '%b.md'").collect()
    assert [r.chunk_text for r in found] == ["b > H\n\n# H\nDate: 2026-01-03T04:05:06Z\nbody"]
    with pytest.raises(FileNotFoundError):
        notes.markdown(spark, str(tmp_path / "none"))


def test_evaluation_queries(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps([{"query_text": "q", "expected_source_uris": ["/a"]}]))
    bad.write_text(json.dumps([{"query_text": "q", "expected_source_uris": "/a"}]))
    assert notes.evaluation_queries(spark, str(good)).first()["expected_source_uris"] == ["/a"]
    with pytest.raises(ValueError):
        notes.evaluation_queries(spark, str(bad))
