"""Recall cards as a kept table."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillstone import versions
from quillstone.operators import views

RISK = "node_id long, level int, node_type string, title string, risk double, confidence double, evidence_source_uris array<string>"


def risks(spark, titles):
    return spark.createDataFrame([(k, 3, "concept", t, 0.5, 1.0, []) for k, t in titles.items()], RISK)


def chunks(spark, texts):
    return spark.createDataFrame([(100 + k, t) for k, t in texts.items()], "chunk_id long, text string")


def asking(*asked):
    """A model that fails where it is asked about another title than these."""

    def ask(title, said):
        return F.when(title.isin(*asked), F.struct(F.concat(F.lit("Q "), title).alias("question"), said.alias("answer"))).otherwise(F.raise_error("asked again").cast("struct<question:string,answer:string>"))

    return ask


def test_only_changed_cards_are_asked_for(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "cards")
    evidence = spark.createDataFrame([(k, 100 + k) for k in range(1, 5)], "root_id long, chunk_id long")
    titles, texts = {1: "one", 2: "two", 3: "three"}, {1: "a", 2: "b", 3: "c", 4: "d"}
    held = lambda: {r.node_id: (r.question, r.answer) for r in views.read_cards(spark, root).collect()}
    nodes = spark.range(1, 5).withColumnRenamed("id", "node_id")
    assert held() == {}
    first = views.keep_cards(spark, root, risks(spark, titles), evidence, chunks(spark, texts), nodes, asking("one", "two", "three"))
    assert first.count() == 3 and held() == {1: ("Q one", "a"), 2: ("Q two", "b"), 3: ("Q three", "c")}
    # The evidence of one changed and another is new: only these are asked for. One that isn't asked for stays.
    titles, texts[2] = {1: "one", 2: "two", 4: "four"}, "bb"
    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(versions, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("killed")))
        views.keep_cards(spark, root, risks(spark, titles), evidence, chunks(spark, texts), nodes, asking("two", "four"))
    assert held()[2] == ("Q two", "b")
    again = views.keep_cards(spark, root, risks(spark, titles), evidence, chunks(spark, texts), nodes, asking("two", "four"))
    assert {r.node_id: r.question for r in again.collect()} == {1: "Q one", 2: "Q two", 4: "Q four"}
    assert held() == {1: ("Q one", "a"), 2: ("Q two", "bb"), 3: ("Q three", "c"), 4: ("Q four", "d")}
    # Nodes that went take their cards along; another version asks for all.
    views.keep_cards(spark, root, risks(spark, titles).limit(0), evidence, chunks(spark, texts), nodes.where("node_id <> 3"), asking("none"))
    assert set(held()) == {1, 2, 4} and len([p for p in Path(root).iterdir() if p.is_dir()]) == 2
    views.keep_cards(spark, root, risks(spark, {1: "one"}), evidence, chunks(spark, texts), nodes, None, "2")
    assert held()[1] == ("What do you remember about: one?", "a") and held()[2] == ("Q two", "bb")
