"""From scans to answers: what the queries over driver tables can't show."""

import json
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillstone import config
from quillstone.durable import numbered
from quillstone.functions import text, vectors
from quillstone.operators import answers, build, conversations, graph, ingest, memory, retrieval, store, usage, views
from quillstone.sources import files, git, sample
# Workers can't import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def now():
    return F.lit("2024-02-01").cast("timestamp")


class Embedder:
    """Counts of a few words as vectors."""

    name, dim = "words", 4
    words = ("tea", "coffee", "rust", "zig")

    def embed(self, texts):
        return [[float(t.lower().count(w)) for w in self.words] for t in texts]


class Model:
    name = "stub"

    def __init__(self, said, fails=False):
        self.said, self.fails, self.asked = said, fails, []

    def generate(self, prompt, system):
        self.asked.append(prompt)
        if self.fails:
            raise answers.Unavailable
        return self.said


CHUNKS = [
    (1, 10, "/a.md", "note", "tea is brewed with hot water", "Tea", "2024-01-30"),
    (2, 10, "/a.md", "note", "tea is brewed with hot water now", "Tea", "2024-01-30"),
    (3, 10, "/a.md", "note", "cold tea", "Tea", "2024-01-30"),
    (4, 11, "/b.md", "note", "coffee is roasted", "Coffee", "2023-01-30"),
    (5, 12, "/c.pdf", "pdf", "tea and coffee are drinks", "Drinks", None),
    (6, 13, "/d.md", "note", None, None, None),
]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = spark.createDataFrame(CHUNKS, "chunk_id long, source_id long, source_uri string, source_type string, text string, title string, day string")
    return rows.withColumn("ts", F.col("day").cast("timestamp")).withColumn("metadata_json", F.when(F.col("source_type") == "pdf", '{"modality":"pdf-page","page":3}')).cache()


@pytest.fixture(scope="module")
def embedded(spark, chunks):
    stored = spark.createDataFrame([], "chunk_id long, model string, dim int, vector array<float>")
    return memory.embed_pending(chunks.where("text is not null"), stored, Embedder(), "chunk_id", "text").cache()


def ids(df):
    return [r.chunk_id for r in df.orderBy(F.desc("score"), "chunk_id").collect()]


def test_lexical(spark, chunks, tmp_path):
    found = retrieval.lexical_retrieve(chunks, "hot TEA water", now(), top_k=3)
    assert ids(found) == [1, 2, 5]  # a source has two hits at most
    assert ids(retrieval.dedupe_greedy(retrieval.lexical_hits(chunks, "hot TEA water", now()), 2, 0.9)) == [1, 3]  # the second nearly repeats the first
    assert ids(retrieval.lexical_retrieve(chunks, "hot TEA water", now(), top_k=3, restrict_ids=chunks.where("chunk_id in (1, 3, 5)"))) == [1, 3, 5]
    assert ids(retrieval.lexical_retrieve(chunks, "tea", now(), source_types=retrieval.source_types_of(["pdf"]))) == [5]
    assert retrieval.lexical_retrieve(chunks, "...", now()).count() == 0 and retrieval.source_types_of(None) is None
    with pytest.raises(ValueError):
        retrieval.source_types_of(["sound"])
    retrieval.store_postings(retrieval.postings(chunks), str(tmp_path / "p"), 3)
    stored = spark.read.parquet(str(tmp_path / "p"))
    direct = retrieval.lexical_scores(chunks, "hot tea_water coffee")
    assert "PushedFilters: [" in stored.where(F.col("token").isin("tea"))._jdf.queryExecution().toString()
    for q in ("hot tea_water coffee", "tea tea zig"):
        direct = {r.chunk_id: round(r.lexical, 12) for r in retrieval.lexical_scores(chunks, q).collect()}
        assert direct == {r.chunk_id: round(r.lexical, 12) for r in retrieval.stored_scores(stored, q).collect()}
        asked = spark.createDataFrame([(7, q)], "query_id long, query_text string")
        assert direct == {r.chunk_id: round(r.lexical, 12) for r in retrieval.bulk_scores(stored, asked).collect()}


def test_no_shuffle_for_one_query(chunks):
    plan = retrieval.lexical_scores(chunks.drop("ts"), "tea")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_dedupe_in_bulk(spark, chunks):
    hits = chunks.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("query_id"), "chunk_id", "text", (F.col("chunk_id") / -10.0).alias("score"))
    one = [r.chunk_id for r in retrieval.dedupe_greedy(hits.where("query_id = 1"), 4, 0.9).collect()]
    both = retrieval.dedupe_bulk(hits, 4, 0.9).collect()
    for q in (1, 2):
        assert sorted(r.chunk_id for r in both if r.query_id == q) == sorted(one)


def test_hybrid_and_comparative(chunks, embedded):
    embed = lambda q: Embedder().embed([q])[0]
    whole = retrieval.hybrid_retrieve(chunks, embedded, "tea vs coffee", embed("tea vs coffee"), now(), top_k=4, embed=embed, model="words")
    rows = {r.chunk_id: r.subquery for r in whole.collect()}
    assert set(rows.values()) == {None, "tea", "coffee"} and {4, 5} <= set(rows)
    none = retrieval.hybrid_retrieve(chunks, embedded, "tea", embed("tea"), now(), top_k=2, model="other")
    assert ids(none) == ids(retrieval.lexical_retrieve(chunks, "tea", now(), 2))
    assert retrieval.hybrid_retrieve(chunks, None, "zig", None, now()).count() == 0


def test_levels(spark, chunks, embedded):
    nodes = spark.createDataFrame([(1, 3, "concept", "Tea", "hot drinks", None, 0.5), (2, 3, "concept", "Cars", "wheels", None, None), (3, 2, "episode", "tea", "", None, None)], "node_id long, level int, node_type string, title string, content string, time_start timestamp, centrality double")
    evidence = spark.createDataFrame([(1, 1), (1, 5), (2, 4), (3, 3)], "root_id long, chunk_id long")
    embed = Embedder().embed
    hits, matched = retrieval.level_retrieve(nodes, None, evidence, chunks, embedded, "tea", embed(["tea"])[0], now(), "concept", model="words")
    assert [r.node_id for r in matched.collect()] == [1] and set(ids(hits)) == {1, 5}
    assert retrieval.level_retrieve(nodes, None, evidence, chunks, embedded, "zig", embed(["zig"])[0], now(), "episode")[0].count() == 0
    with pytest.raises(ValueError):
        retrieval.level_nodes(nodes, "planet")
    uris = retrieval.drill_down(matched, evidence.withColumnRenamed("root_id", "node_id"), chunks)
    assert [(r.uri, r.rank) for r in uris.orderBy("rank").collect()] == [("/a.md", 1), ("/c.pdf", 2)]


def test_answers(spark, chunks):
    hits = retrieval.lexical_retrieve(chunks, "tea coffee", now(), top_k=3).withColumn("subquery", F.lit(None).cast("string"))
    template = answers.answer_payload("tea coffee", hits, None)
    assert template["answer"] is None and not template["abstained"] and [e["evidence_id"] for e in template["evidence"]] == ["E1", "E2", "E3"][: len(template["evidence"])]
    assert not {"cited", "subquery", "excerpt"} & set(template["evidence"][0]) and "title" not in template["evidence"][0]["scores"]
    model = Model("Both are drinks [E1] [E9] [E1].")
    said = answers.answer_payload("tea coffee", hits, model, history="before")
    assert said["cited_evidence_ids"] == ["E1"] and said["invalid_citations"] == ["E9"] and said["evidence"][0]["cited"] and not said["evidence"][1]["cited"]
    first = next(e for e in said["evidence"] if e["chunk_id"] == 5)
    assert first["locator"] == "/c.pdf p.3" and first["page"] == 3 and first["modality"] == "pdf-page" and set(first["scores"]) == {"combined", "vector", "lexical", "recency", "usage", "title"}
    assert model.asked[0].startswith("before\n\nEvidence:\n[E1] (note: Tea | uri=/a.md | chunk_id=") and f"[{first['evidence_id']}] (pdf: Drinks | pdf-page | uri=/c.pdf p.3 | chunk_id=5)\ntea and coffee are drinks\n" in model.asked[0]
    assert model.asked[0].endswith("Question: tea coffee\nAnswer (cite evidence ids inline):")
    refused = answers.answer_payload("q", hits, Model(f" {answers.REFUSAL}\n"))
    assert refused["abstained"] and refused["abstention_reason"] == "llm_insufficient"
    assert answers.answer_payload("q", hits, Model("x", fails=True))["model"] is None
    weak = Model("x")
    for h in (hits.limit(0), hits.withColumn("score", F.lit(0.1))):
        gated = answers.answer_payload("q", h, weak)
        assert gated["abstained"] and gated["abstention_reason"] == "weak_retrieval" and gated["answer"] == answers.REFUSAL
    assert not weak.asked and answers.answer_payload("q", hits.limit(0), None)["abstained"]
    assert [e["type"] for e in answers.answer_events("q", hits, Model("word"))] == ["token", "final"]
    json.dumps(said)


def test_conversations(spark):
    talks = spark.createDataFrame([], "conversation_id long, title string, updated_at string")
    said = spark.createDataFrame([], "conversation_id long, turn_index long, role string, text string, evidence_json string, abstention_reason string, truncated boolean, model string")
    payload = {"answer": "a", "evidence": [{"x": 1}], "abstention_reason": None, "truncated": False, "model": "m"}
    for k, q in enumerate(["  first   question ", "second"]):
        talks, said = conversations.with_turn(talks, said, 4, q, payload, f"2024-01-0{k + 1}")
    talks, said = conversations.with_turn(talks, said, 5, "other", {**payload, "abstention_reason": "weak_retrieval"}, "2024-01-02", title="Named")
    listed = conversations.history(talks, said).collect()
    assert [(r.conversation_id, r.title, r.n_messages, r.next_turn) for r in listed] == [(5, "Named", 2, 1), (4, "first question", 4, 2)]
    assert [(r.turn_index, r.role) for r in conversations.shown(said, 4).collect()] == [(0, "user"), (0, "assistant"), (1, "user"), (1, "assistant")]
    assert conversations.renamed(talks, 4, "N").where("title = 'N'").count() == 1
    assert [df.count() for df in conversations.cleared(talks, said, 4)] == [1, 2] and [df.count() for df in conversations.cleared(talks, said)] == [0, 0]
    pairs = conversations.turn_pairs(said).join(said.where("role = 'assistant'").select("conversation_id", "turn_index", "abstention_reason"), ["conversation_id", "turn_index"])
    assert {(r.conversation_id, r.turn_index) for r in conversations.last_turns(pairs, 1).collect()} == {(4, 1)}


@pytest.fixture
def repository(tmp_path):
    def run(*a, **env):
        subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path), "GIT_CONFIG_GLOBAL": "/dev/null", **env})

    run("init", "-q")
    for k, who in enumerate(["ann", "bob", "ann"]):
        (tmp_path / f"f{k}.txt").write_text(f"line {k}\n")
        run("add", f"f{k}.txt")
        run("commit", "-q", "-m", f"change {k}\n\nbody {k}", GIT_AUTHOR_NAME=who, GIT_AUTHOR_EMAIL=f"{who}@x", GIT_COMMITTER_NAME="c", GIT_COMMITTER_EMAIL="c@x", GIT_COMMITTER_DATE=f"2024-01-0{k + 1}T00:00:00+00:00")
    return tmp_path


def test_git_scan(spark, repository):
    rows = git.scan(spark, str(repository)).collect()
    assert [r.title for r in rows] == ["change 2", "change 1", "change 0"] and rows[0].text.startswith("commit: change 2\n\nbody 2") and "+line 2" in rows[0].text
    assert rows[0].source_uri == f"{repository.resolve()}@{rows[0].sha}" and git.scan(spark, str(repository), most=1).count() == 1
    assert [r.timestamp for r in rows] == [f"2024-01-0{k}T00:00:00+00:00" for k in (3, 2, 1)] and " f2.txt | 1 +" in rows[0].text and "diff --git a/f2.txt b/f2.txt" in rows[0].text
    mine, others = git.by_author(git.scan(spark, str(repository)), "ann", "ann@x")
    assert mine.count() == 2 and [r.source_uri for r in others.collect()] == [rows[1].source_uri]
    with pytest.raises(FileNotFoundError):
        git.scan(spark, str(repository / "none"))


def test_commit_objects():
    raw = b"tree t\nparent p\nauthor Ann B <ann@x> 1700000000 -0330\ncommitter C <c@x> 1700000000 +0530\ngpgsig -----\n author no\n\nA subject\nin two lines\n\nbody \xff\n\nmore\n"
    found = git.commit_of(raw)
    assert found == {"timestamp": "2023-11-15T03:43:20+05:30", "subject": "A subject in two lines", "body": "\nbody \ufffd\n\nmore".strip("\n"), "author_name": "Ann B", "author_email": "ann@x"}
    assert list(git.objects_of(b"a commit 3\nx\ny\nb commit 0\n\n")) == [b"x\ny", b""]
    assert git.patches_of(b"s1\n+a\n s2\ns3\n-b", ["s1", "s2", "s3"]) == {"s1": "+a\n s2", "s2": "", "s3": "-b"}


def test_commits_of_others_go(spark, repository):
    repo = {"git": [str(repository)]}
    everyone = lambda p: ingest.git_scan(spark, p, "bob", "bob@x")
    mine = lambda p: ingest.git_scan(spark, p, "ann", "ann@x")
    tables, report = ingest.sync(ingest.read_tables(spark), repo, {"git": everyone}, Embedder())
    assert report[0]["removed"] == 0 and tables["sources"].count() == 1
    tables, report = ingest.sync(tables, repo, {"git": mine}, Embedder())
    authors = {r.a for r in tables["sources"].select(F.get_json_object("metadata_json", "$.author_name").alias("a")).collect()}
    assert report[0]["removed"] == 1 and tables["sources"].count() == 2 and authors == {"ann"}
    assert tables["chunks"].join(tables["sources"].selectExpr("id source_id"), "source_id", "left_anti").count() == 0 and tables["vectors"].count() == tables["chunks"].count()


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "one.pdf").write_bytes(b"p1|p2 " + b"word " * 400)
    (tmp_path / "sub" / "two.PDF").write_bytes(b"x")
    (tmp_path / "pic.JPG").write_bytes(b"some text")
    pages = files.pdf_pages(spark, str(tmp_path), lambda content, uri: content.decode().split("|"))
    got = {(r.title, r.page): r.text for r in pages.collect()}
    assert got["one", 1] == "p1" and got["two", 1] == "x" and len(got) == 3
    each = files.page_chunks(pages).orderBy("source_uri", "chunk_index").collect()
    one = [r for r in each if r.source_uri.endswith("one.pdf")]
    assert len(each) == len(one) + 1 and [r.chunk_index for r in one] == list(range(len(one))) and [r.page for r in one] == [1] + [2] * (len(one) - 1)
    read = lambda content: (content.decode(), [("some", 90.0), (" ", 10.0), ("text", 70.0), ("odd", -1.0)])
    image = files.image_texts(spark, str(tmp_path), read).collect()
    assert [(r.title, r.text, r.ocr_confidence) for r in image] == [("pic", "some text", 0.8)]
    assert files.mean_confidence([("", 50.0)]) is None and files.name_of("/a/b.c.pdf") == "b.c"

    class Locked:
        is_encrypted = True

        def __init__(self, stream):
            pass

        def decrypt(self, password):
            return 0

    class Library:
        PdfReader = Locked

    with pytest.raises(ValueError, match="password"):
        files.pages_of(b"", "/x.pdf", Library)
    with pytest.raises(FileNotFoundError):
        files.image_texts(spark, str(tmp_path / "none"), read)
    for kind, there in (("pdf", files.has_pdf()), ("image", files.has_ocr())):
        if not there:
            with pytest.raises(files.MissingBackend):
                files.require(kind)


def test_sync_is_idempotent(spark, tmp_path, repository):
    notes_dir = tmp_path / "vault"
    notes_dir.mkdir()
    (notes_dir / "a.md").write_text("# Tea\nhot tea\n\ncold tea")
    (notes_dir / "b.md").write_text("Date: 2024-01-02\ncoffee")
    scans = {"notes": lambda p: ingest.note_scan(spark, p), "git": lambda p: ingest.git_scan(spark, p, "ann", "ann@x"), "pdf": lambda p: ingest.pdf_scan(spark, p)}
    where = {"notes": [str(notes_dir), str(tmp_path / "none")], "git": [str(repository)], "pdf": [] if files.has_pdf() else [str(tmp_path)], "image": []}
    seen = []
    tables, report = ingest.sync(ingest.read_tables(spark), where, scans, Embedder(), lambda *a: seen.append(a))
    by_name = {r["connector"]: r for r in report}
    assert by_name["notes"]["inserted"] == 3 and len(by_name["notes"]["errors"]) == 1 and by_name["git"]["inserted"] >= 2 and by_name["image"]["status"] == "no-paths" and seen
    assert files.has_pdf() or by_name["pdf"]["status"].startswith("skipped")
    assert tables["vectors"].count() == tables["chunks"].count() and tables["sources"].count() == 4
    again, report = ingest.sync(tables, where, scans, Embedder())
    assert sum(r["inserted"] for r in report) == 0 and sorted(map(tuple, again["chunks"].collect())) == sorted(map(tuple, tables["chunks"].collect()))
    (notes_dir / "a.md").write_text("# Tea\nmint tea")
    third, report = ingest.sync(again, {"notes": [str(notes_dir)]}, scans, Embedder())
    assert report[0]["inserted"] == 1 and third["vectors"].count() == third["chunks"].count() == again["chunks"].count() - 1
    assert third["chunks"].agg(F.max("chunk_id")).first()[0] > again["chunks"].agg(F.max("chunk_id")).first()[0]


def test_stream_of_notes(spark, tmp_path):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    (folder / "a.md").write_text("hot tea")
    ingest.stream_notes(spark, str(folder), state).awaitTermination()
    assert [r.text for r in ingest.read_tables(spark, state)["chunks"].collect()] == ["a\n\nhot tea"]
    (folder / "b.md").write_text("coffee")
    ingest.stream_notes(spark, str(folder), state).awaitTermination()
    assert ingest.read_tables(spark, state)["sources"].count() == 2


def test_backup(spark, tmp_path):
    tables = {"a": spark.range(3), "b": spark.range(0)}
    store.backup(tables, str(tmp_path / "copy"))
    found = store.restore(spark, str(tmp_path / "copy"), str(tmp_path / "live"))
    assert {k: v.count() for k, v in found.items()} == {"a": 3, "b": 0}
    with pytest.raises(FileExistsError):
        store.restore(spark, str(tmp_path / "copy"), str(tmp_path / "live"))
    assert store.restore(spark, str(tmp_path / "copy"), str(tmp_path / "live"), force=True)["a"].count() == 3
    with pytest.raises(ValueError):
        store.restore(spark, str(tmp_path / "live"), str(tmp_path / "x"))


def test_building_the_memory(spark):
    meta = lambda uri: json.dumps({"source_type": "note", "source_uri": uri})
    rows = [(1, "green tea", "/v/tea/a.md", "2024-01-01 10:00:00"), (2, "black tea tea", "/v/tea/b.md", "2024-01-01 20:00:00"), (3, "coffee beans", "/v/tea/c.md", "2024-03-01 00:00:00"), (4, "coffee", "/v/x/d.md", "2024-03-01 01:00:00"), (5, "rust", "/v/x/e.md", None)]
    blank = spark.createDataFrame([], build.NODE)
    events = spark.createDataFrame([(k, 1, "event", t, None, d, d, meta(u)) for k, t, u, d in rows], "node_id long, level int, node_type string, title string, content string, s string, e string, metadata_json string")
    nodes = blank.unionByName(events.withColumn("time_start", F.col("s").cast("timestamp")).withColumn("time_end", F.col("e").cast("timestamp")).drop("s", "e"), allowMissingColumns=True)
    edges = spark.createDataFrame([(1, k, 0, 100 + k, "derived_from") for k in range(1, 6)], "parent_level int, parent_id long, child_level int, child_id long, relation string")
    chunks = spark.createDataFrame([(100 + k, f"/s{k}", t, "2024-01-15") for k, t, *_ in rows], "chunk_id long, source_uri string, text string, d string").withColumn("ts", F.col("d").cast("timestamp"))
    vecs = spark.createDataFrame([(k, "words", v) for k, v in zip(range(1, 6), Embedder().embed([r[1] for r in rows]), strict=True)], "node_id long, model string, vector array<float>")

    nodes2, edges2 = build.episodes(nodes, edges)
    titles = {r.title for r in nodes2.where("level = 2").collect()}
    assert titles == {"tea: 2 events, 2024-01-01", "tea: 1 event, 2024-03-01", "x: 1 event, 2024-03-01", "x: 1 event, undated"}
    nodes3, edges3 = build.concepts(nodes2, edges2, vecs, "words")
    concepts = {r.title: r.node_id for r in nodes3.where("level = 3").collect()}
    assert set(concepts) == {"green tea (+1 related)", "coffee beans (+1 related)"}
    again, same = build.concepts(*build.episodes(nodes3, edges3), vecs, "words")
    assert sorted((r.node_id, r.title) for r in again.collect()) == sorted((r.node_id, r.title) for r in nodes3.collect()) and same.count() == edges3.count()
    fewer = nodes3.where("node_id <> 4")
    left, left_edges = build.concepts(*build.episodes(fewer, edges3), vecs, "words")
    assert left.where("level = 3").count() == 1 and left_edges.where("relation = 'contains' and child_id = 4").count() == 0

    ranked, related = build.links(nodes3, edges3)
    assert ranked.agg(F.max("centrality")).first()[0] == 1.0 and related.where("relation = 'relates_to'").count() == 0  # no episode holds events of both
    evidence = graph.closure(edges3, nodes3.where("level in (2, 3)").select("level", "node_id"), chunks)
    assert {(r.root_id, r.chunk_id) for r in evidence.where("root_level = 3").collect()} >= {(i, 100 + k) for t, i in concepts.items() for k in ((1, 2) if "tea" in t else (3, 4))}
    moved = build.drift(nodes3, edges3, vecs, "words")
    assert moved.where("drift = 0").count() == moved.count() and moved.count() == 2
    both = chunks.select("chunk_id", F.lit("words").alias("model")).join(vecs.select((F.col("node_id") + 100).alias("chunk_id"), "vector"), "chunk_id")
    made = build.distilled(nodes3, evidence, both, "words", lambda c: vectors.bucket_embedding(c))
    rows = {r.node_id: r for r in made.collect()}
    assert all(len(r.core) == max(1, round(0.5 * len({1, 2}))) or len(r.core) == 1 for r in rows.values()) and all(r.summary for r in rows.values())
    shown = views.distilled_view(made, nodes3, evidence, chunks).collect()
    assert [r.node_id for r in shown] == [r.node_id for r in sorted(shown, key=lambda r: (r.compression_ratio, r.node_id))]
    risks = views.forgetting(ranked, evidence, chunks, now(), levels=[2, 3])
    cards = views.recall_cards(risks, evidence, chunks)
    kept = cards.withColumn("question", F.lit("kept")).cache()
    assert {r.question for r in views.recall_cards(risks, evidence, chunks, kept).collect()} == {"kept"}
    changed = chunks.withColumn("text", F.concat("text", F.lit("!")))
    assert all(r.question.startswith("What do you remember about: ") for r in views.recall_cards(risks, evidence, changed, kept).collect())
    report = build.health({"nodes": nodes3}, {"notes": ["/v"]}, "words")
    assert report["tables"]["nodes"] == nodes3.count() and report["connectors"] == {"notes": 1}


def test_closure_ends_on_cycles_and_diamonds(spark):
    steps = [(3, 1, 2, 1), (3, 1, 2, 2), (2, 1, 1, 1), (2, 2, 1, 1), (1, 1, 0, 7), (1, 1, 3, 1), (2, 2, 2, 1)]
    edges = spark.createDataFrame([(*s, "contains") for s in steps], "parent_level int, parent_id long, child_level int, child_id long, relation string")
    chunks = spark.createDataFrame([(7,), (8,)], "chunk_id long")
    roots = spark.createDataFrame([(3, 1), (2, 2), (1, 9), (0, 8)], "level int, node_id long")
    assert {(r.root_level, r.root_id, r.chunk_id) for r in graph.closure(edges, roots, chunks).collect()} == {(3, 1, 7), (2, 2, 7), (0, 8, 8)}
    assert graph.closure(edges, roots, chunks, max_depth=1).count() == 1


def test_cooccurrence_in_parts(spark):
    rows = spark.createDataFrame([(g, i) for g in range(3) for i in range(20) if (g + i) % 4], "g long, i long")
    whole = sorted(map(tuple, graph.cooccurrence(rows, "g", "i").collect()))
    assert whole == sorted(map(tuple, graph.cooccurrence(rows, "g", "i", part=4).collect())) and len(whole) > 100


def test_numbers_and_bytes(spark):
    df = spark.range(0, 1000, numPartitions=7).select((F.col("id") * 7919 % 1000).alias("v"))
    assert [(r.n, r.v) for r in numbered(df, "n", "v").orderBy("n").collect()] == [(k + 1, k) for k in range(1000)] and numbered(df.limit(0), "n", "v").count() == 0
    v = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>")
    packed = v.select(vectors.pack(F.col("v")).alias("b"))
    assert [r.b for r in packed.collect()] == [b"\x00\x00\xc0?\x00\x00\x00\xc0", None] and [r.v for r in packed.select(vectors.unpack(F.col("b")).alias("v")).collect()] == [[1.5, -2.0], None]
    t = spark.range(1).select(vectors.node_text(F.lit(" t"), F.lit(None).cast("string")).alias("x")).first()["x"]
    assert t == "t" and usage.hits_of([3, 1, 3], "open", None) == [("chunk", 3, "open", None), ("chunk", 1, "open", None)]
    with pytest.raises(Exception, match="unknown modality"):
        spark.range(1).select(text.build_locator(modality=F.lit("sound"))).collect()


def test_config(tmp_path):
    (tmp_path / "quillstone.toml").write_text('[retrieval]\nprofile = "recent"\ntop_k = 9\n[connectors]\nnotes = ["/n"]\ngit = "/g"\n')
    c = config.Config({"QUILLSTONE_RETRIEVAL_TOP_K": "7", "PDF_PATH_2": "/p2", "PDF_PATH_1": "/p1", "QUILLSTONE_CHAT_TURNS": "many"}, str(tmp_path))
    assert (c.get("retrieval", "profile"), c.get("retrieval", "top_k"), c.get("retrieval", "top_k", 3), c.get("chat", "turns")) == ("recent", 7, 3, 8)
    assert (c.paths("notes"), c.paths("git"), c.paths("pdf"), c.paths("image")) == (["/n"], ["/g"], ["/p1", "/p2"], [])
    (tmp_path / "quillstone.toml").write_text("not toml [")
    assert config.Config({}, str(tmp_path)).get("retrieval", "profile") == "balanced"
    (tmp_path / ".env").write_text("# A=0\nA=1\nexport B='two'\nno line\n")
    env = {"A": "0"}
    config.load_env(str(tmp_path / ".env"), env)
    config.load_env(str(tmp_path / "none"), env)
    assert env == {"A": "0", "B": "two"}


def test_sample_workspace(spark, tmp_path):
    vault, repository = sample.seed(str(tmp_path))
    assert sample.seed(str(tmp_path)) == (vault, repository) and git.scan(spark, repository).count() == len(sample.COMMITS)
    scans = {"notes": lambda p: ingest.note_scan(spark, p), "git": lambda p: ingest.git_scan(spark, p, sample.AUTHOR, sample.EMAIL)}
    tables, _ = ingest.sync(ingest.read_tables(spark), {"notes": [vault], "git": [repository]}, scans)
    rows = tables["chunks"].join(tables["sources"].select(F.col("id").alias("source_id"), "source_uri", "source_type", "title", "timestamp"), "source_id").withColumn("ts", F.col("timestamp").cast("timestamp"))
    rows = rows.cache()
    asked = sample.queries(spark, vault).collect()
    when = F.lit("2026-03-01").cast("timestamp")
    for q in asked:
        if q.expected_source_uris:
            found = retrieval.lexical_retrieve(rows, q.query_text.removeprefix(sample.PREFIX), when, 3).collect()
            assert {r.source_uri for r in found} & set(q.expected_source_uris), q
    used = sample.uses(tables["sources"], tables["chunks"], vault)
    log = usage.appended(spark.createDataFrame([], "target_kind string, target_id long, event_type string, event_at timestamp, weight double"), used)
    n = rows.where("source_uri like '%locks.md'").count() * 3 + rows.where("source_uri like '%pears.md'").count()
    assert log.count() == n and log.where("event_type = 'accepted_answer' and weight <> 3").count() == 0
    left = store.without_prefix(tables["sources"], tables["chunks"], sample.queries(spark, vault), log, [vault + "/", repository + "@"], "[sample")
    assert {k: v.count() for k, v in left.items()} == {"sources": 0, "chunks": 0, "queries": 0, "usage": 0}


def test_models_that_fail_are_asked_once(spark):
    failing = Model("x", fails=True)
    guarded = answers.Guarded(failing)
    assert [guarded.says("a"), guarded.says("b")] == [None, None] and len(failing.asked) == 1 and answers.Guarded(None).says("a") is None
    nodes = spark.createDataFrame([(1, "old"), (2, "kept")], "node_id long, title string")
    titles = spark.createDataFrame([(1, ["a", "b"])], "node_id long, titles array<string>")
    assert {r.node_id: r.title for r in build.named(nodes, titles, answers.Guarded(Model('"Green teas"\n'))).collect()} == {1: "Green teas", 2: "kept"}
    assert {r.title for r in build.named(nodes, titles, answers.Guarded(Model("These are all about tea."))).collect()} == {"old", "kept"}
    assert {r.title for r in build.named(nodes, titles, answers.Guarded(failing)).collect()} == {"old", "kept"}
    assert answers.conversation_name(answers.Guarded(Model('"Title: On tea."')), "q", "a") == "On tea"
    assert answers.conversation_name(answers.Guarded(failing), "q", "a") is None
