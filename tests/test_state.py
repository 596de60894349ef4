"""Tables that change batch by batch, backups that tell damage, batches that go on, support from below."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillstone import versions
from quillstone.operators import graph, ingest, memory, state, store

SCAN = "source_type string, source_uri string, source_fingerprint string, timestamp string, title string, metadata_json string"
CHUNK = "source_type string, source_uri string, chunk_index int, text string, metadata_json string"


def embedder():
    class Lengths:  # made here, so that workers needn't import this module
        name, dim = "m", 1

        def embed(self, texts):
            return [[float(len(t))] for t in texts]

    return Lengths()


def scan(spark, texts):
    """Sources n0, n1 ... with a chunk for each word of their text."""
    sources = [("note", u, f"fp-{t}", "2024-01-01", u, None) for u, t in texts.items()]
    chunks = [("note", u, k, w, None) for u, t in texts.items() for k, w in enumerate(t.split())]
    return spark.createDataFrame(sources, SCAN), spark.createDataFrame(chunks, CHUNK)


def held(spark, root):
    t = state.read(spark, root)
    rows = t["chunks"].join(t["sources"].select(F.col("id").alias("source_id"), "source_uri"), "source_id").join(t["vectors"], "chunk_id", "left")
    out = {}
    for r in rows.orderBy("source_uri", "chunk_index").collect():
        out.setdefault(r.source_uri, []).append((r.text, r.vector and r.vector[0]))
    assert t["chunks"].count() == t["chunks"].select("chunk_id").distinct().count() == rows.count() == t["vectors"].count()
    return out


def expected(texts):
    return {u: [(w, float(len(w))) for w in t.split()] for u, t in texts.items() if t}


def files_of(root):
    return {p for p in Path(root).rglob("*.parquet") if "_temporary" not in p.parts}


def test_batches_write_what_they_change(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "state")
    texts = {f"n{k}": f"one two{k} three" for k in range(40)}
    told = state.take(spark, root, 0, *scan(spark, texts), embedder(), buckets=8)
    assert told["new"] == 40 and told["chunks_inserted"] == 120 and held(spark, root) == expected(texts)
    before = files_of(root)
    # The same again, as a batch that is repeated and as a new one.
    assert state.take(spark, root, 0, *scan(spark, texts), embedder()) == {"repeated": True}
    told = state.take(spark, root, 1, *scan(spark, texts), embedder())
    assert told["unchanged"] == 40 and told["written"] == {"sources": [], "chunks": [], "vectors": []} and files_of(root) <= before
    # One changed, one new, one without chunks.
    texts |= {"n3": "changed", "new": "x y", "n4": ""}
    told = state.take(spark, root, 2, *scan(spark, {u: texts[u] for u in ("n3", "new", "n4", "n5")}), embedder())
    assert (told["changed"], told["new"], told["unchanged"], told["chunks_inserted"]) == (2, 1, 1, 3) and held(spark, root) == expected(texts)
    assert all(0 < len(b) <= 3 for b in told["written"].values())
    # A batch that dies before its switch leaves the tables as they were, and is done again.
    texts["n6"] = "died once"
    with monkeypatch.context() as m:
        m.setattr(versions, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            state.take(spark, root, 3, *scan(spark, {"n6": "died once"}), embedder())
    assert held(spark, root)["n6"] == expected({"n6": "one two6 three"})["n6"]
    told = state.take(spark, root, 3, *scan(spark, {"n6": "died once"}), embedder())
    assert told["chunks_inserted"] == 2 and held(spark, root) == expected(texts)
    gone = spark.createDataFrame([("note", "n7"), ("note", "n8"), ("pdf", "n9"), ("note", "none")], "source_type string, source_uri string")
    told = state.take(spark, root, 4, *scan(spark, {"n8": "again"}), embedder(), gone)
    texts = {u: t for u, t in texts.items() if u not in ("n7", "n8")}
    assert told["removed"] == 2 and held(spark, root) == expected(texts)
    state.take(spark, root, 5, *scan(spark, {"n10": "z"}), embedder())
    # Only this manifest's files and those that it replaced are there.
    manifest = versions.load(spark, root)
    named = {p for paths in manifest["live"].values() for p in paths.values()} | set(manifest["old"])
    assert {str(p.parent.relative_to(root)) for p in files_of(root)} == named
    ids = state.read(spark, root)["sources"].select("id").distinct().count()
    assert ids == state.read(spark, root)["sources"].count() == len(texts)


def test_batches_equal_whole_ingests(spark, tmp_path):
    root, draw = str(tmp_path / "state"), random.Random(3)
    tables = ingest.read_tables(spark)
    for batch in range(2):
        texts = {f"n{k}": f"v{draw.randint(0, 1)} word" for k in draw.sample(range(12), 5)}
        state.take(spark, root, batch, *scan(spark, texts), buckets=4)
        tables, _ = ingest.ingest(tables, *scan(spark, texts))
    mine = state.read(spark, root)
    for name, columns in (("sources", ["id", "source_uri", "source_fingerprint"]), ("chunks", ["chunk_id", "source_id", "chunk_index", "text"])):
        assert sorted(map(tuple, mine[name].select(columns).collect())) == sorted(map(tuple, tables[name].select(columns).collect()))


def test_backups_tell_damage(spark, tmp_path):
    copy, live = str(tmp_path / "copy"), str(tmp_path / "live")
    a = spark.createDataFrame([(1, None, {"k": 1}), (2, "x", None), (None, "y", {})], "id long, text string, more map<string, int>")
    store.backup({"a": a, "b": spark.range(5)}, copy)
    assert store.restore(spark, copy, live)["a"].count() == 3 and store.restored(spark, live)["b"].count() == 5
    # One value is another, with as many rows.
    damaged = spark.range(5).select(F.when(F.col("id") == 3, 30).otherwise(F.col("id")).alias("id"))
    damaged.write.mode("overwrite").parquet(f"{copy}/b")
    with pytest.raises(ValueError, match="isn't what was backed up"):
        store.restore(spark, copy, live, force=True)
    assert sorted(r.id for r in store.restored(spark, live)["b"].collect()) == list(range(5)) and len([p for p in Path(live).iterdir() if p.is_dir()]) == 1
    versions.remove(spark, f"{copy}/b")
    with pytest.raises(ValueError):
        store.restore(spark, copy, str(tmp_path / "other"))
    assert versions.load(spark, str(tmp_path / "other")) is None
    with pytest.raises(FileNotFoundError):
        store.restored(spark, str(tmp_path / "other"))


def test_content(spark):
    one = spark.createDataFrame([(1, None), (None, 1), (2, 2)], "a long, b long")
    assert versions.content(one) == versions.content(one.orderBy(F.desc("a")).repartition(3)) and versions.content(one)["n"] == 3
    for other in ([(1, None), (1, None), (2, 2)], [(1, None), (None, 1), (2, 3)], [(None, 1), (None, 1), (2, 2)]):
        assert versions.content(spark.createDataFrame(other, "a long, b long")) != versions.content(one)
    assert versions.content(one.limit(0)) == {"n": 0, "sum": 0, "xor": 0, "columns": ["a bigint", "b bigint"]}


def test_embedding_goes_on(spark, tmp_path):
    folder, calls = str(tmp_path / "vectors"), tmp_path / "calls"
    calls.mkdir()

    class Failing:
        name, dim = "m", 1

        def __init__(self, fails):
            self.fails, self.calls = fails, str(calls)

        def embed(self, texts):
            import os
            import uuid

            for t in texts:
                if self.fails and t == "t25":
                    raise RuntimeError("out of reach")
                open(os.path.join(self.calls, f"{t}-{uuid.uuid4().hex}"), "w").close()
            return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(k, f"t{k}") for k in range(40)], "chunk_id long, text string").repartition(4)
    stored = spark.createDataFrame([(0, "m"), (1, "other")], "chunk_id long, model string")
    with pytest.raises(Exception, match="out of reach"):
        memory.embed_in_batches(rows, stored, Failing(True), "chunk_id", "text", folder, 10)
    first = {p.name.split("-")[0] for p in calls.iterdir()}
    assert {f"t{k}" for k in range(1, 21)} <= first and not first & {f"t{k}" for k in range(31, 40)}
    found = memory.embed_in_batches(rows, stored, Failing(False), "chunk_id", "text", folder, 10)
    assert sorted(r.chunk_id for r in found.collect()) == list(range(1, 40))
    asked = [p.name.split("-")[0] for p in calls.iterdir()]
    assert all(asked.count(f"t{k}") == 1 for k in [*range(1, 21), *range(31, 40)])
    assert memory.embed_in_batches(rows, stored, Failing(True), "chunk_id", "text", folder, 10).count() == 39
    with pytest.raises(ValueError):
        other = Failing(False)
        other.name = "n"
        memory.embed_in_batches(rows, stored, other, "chunk_id", "text", folder)


def test_support_from_below(spark):
    draw = random.Random(8)
    nodes = [(draw.randint(1, 3), k) for k in range(1, 60)]
    level = dict((k, lv) for lv, k in nodes)
    edges = {(level[a], a, level[b], b, draw.choice(["contains", "derived_from", "relates_to"])) for a, b in ((draw.randint(1, 59), draw.randint(1, 59)) for _ in range(70))}
    edges |= {(level[a], a, 0, draw.randint(1, 9), draw.choice(["derived_from", "relates_to"])) for a in draw.sample(range(1, 60), 14)}
    n = spark.createDataFrame(nodes, "level int, node_id long")
    e = spark.createDataFrame([(*x, 1.0) for x in edges], "parent_level int, parent_id long, child_level int, child_id long, relation string, weight double")
    chunks = spark.createDataFrame([(k,) for k in range(1, 7)], "chunk_id long")
    for depth in (1, 2, 8):
        reached = {(r.root_level, r.root_id) for r in graph.closure(e, n, chunks, depth).collect()}
        assert {(r.level, r.node_id) for r in graph.supported(e, chunks, depth).collect()} == reached
    assert {r.node_id for r in graph.unsupported_nodes(n, e, chunks).collect()} == {k for lv, k in nodes} - {k for _, k in reached}
