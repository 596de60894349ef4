from pyspark.sql import functions as F

from quillstone.functions import scores, text, vectors
from quillstone.operators import conversations, evaluation, graph, memory, retrieval, store, usage
from quillstone.plans import catalog


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokenize(spark):
    assert one(spark, text.tokenize(F.lit("Foo_Bar baz ___ é9"))) == ["foo_bar", "foobar", "baz", "___", "9"]
    assert one(spark, text.tokenize(F.lit(None).cast("string"))) == []


def test_scores(spark):
    now = F.lit("2024-02-01").cast("timestamp")
    half = F.lit("2024-01-02").cast("timestamp")
    assert abs(one(spark, scores.decayed(F.lit(2.0), half, now)) - 1.0) < 1e-12
    assert one(spark, scores.recency(F.lit(None).cast("timestamp"), now)) == 0
    assert one(spark, scores.core_size(0.5, F.lit(5))) == 2 and one(spark, scores.core_size(0.5, F.lit(1))) == 1
    assert one(spark, scores.latest(F.lit("x"), F.lit("2024-01-01"), F.lit("2024-01-02"))) == "2024-01-02"


def test_text_parsers(spark):
    sides_of = {
        "difference between the alpha and beta?": ("alpha", "beta"), "alpha vs Alpha": None, "tell me about alpha": None, "Please compare using Rust to a Zig compiler. Now": ("Rust", "Zig compiler"), "(tea) versus coffee!": ("tea)", "coffee"), "": None,
        "difference in taste": None, "compare teas": None, "vs": None, "tea vs ": None,
        "Say what differences between   hot  tea and iced tea there are": ("hot  tea", "iced tea there are"), "COMPARE an old kettle WITH the new kettle!": ("old kettle", "new kettle"), "(compare tea to .NET v2. Ok)": ("tea", ".NET v2"),
        "difference between tea, and: using": None, "is difference between tea and tea vs coffee": ("tea", "tea vs coffee"), "difference between tea and tea": None, "tea vs vs coffee": ("tea", "vs coffee"), "?? vs tea": ("??", "tea"),
        "  mint tea\tversus  a\u00a0black tea ? no": ("mint tea", "black tea"), "compare a, with; b": None, "compare milk\nand tea": ("milk", "tea"), "compare a\nb and c": None, "differences between and and or and not": ("and", "or and not"),
    }
    asked = spark.createDataFrame([(q,) for q in sides_of], "q string").select("q", text.comparative(F.col("q")).alias("s"))
    assert {r.q: r.s and tuple(r.s) for r in asked.collect()} == sides_of and text.comparative_sides(spark, "tea vs coffee") == ("tea", "coffee")
    assert one(spark, text.citations(F.lit("a [E2] b [E1] [E2]"))) == [2, 1]
    assert one(spark, text.citations(F.lit("[E99999999999] [E1] [E99999999999999999999]"))) == [99999999999, 1, None]
    assert one(spark, text.split_citations(F.array(F.lit(None).cast("bigint"), F.lit(1).cast("bigint"), F.lit(99999999999)), F.lit(3))).asDict() == {"valid": [1], "invalid": [None, 99999999999]}
    uris_of = {'\n ["/a"]\u00a0': ["/a"], '{"a": 1}': [], "5": [], "true": [], "null": [], '["/a", 1, null]': ["/a", "1", "null"], '["/a"': ['["/a"'], "/a,, \n/b": ["/a", "/b"], ' "/a" ': ["/a"], '"/a", "/b"': ['"/a"', '"/b"'], "[]": []}
    listed = spark.createDataFrame([(raw,) for raw in uris_of], "raw string").select("raw", text.gold_uris(F.col("raw")).alias("uris"))
    assert {r.raw: r.uris for r in listed.collect()} == uris_of
    assert one(spark, text.gold_uris(F.lit('["/a", "/b"]'))) == ["/a", "/b"]
    assert one(spark, text.gold_uris(F.lit('"/a"'))) == ["/a"] and one(spark, text.gold_uris(F.lit("/a, /b"))) == ["/a", "/b"]
    assert one(spark, text.gold_uris(F.lit("  "))) == []
    assert one(spark, text.project_key(F.lit("git_commit"), F.lit("/r/x@abc"))) == "/r/x"
    assert one(spark, text.project_key(F.lit("note"), F.lit("/v/n.md"))) == "/v"
    assert one(spark, text.parse_locator(F.lit("{bad"))) is None
    found = one(spark, text.format_locator(F.lit("/a.pdf"), text.parse_locator(F.lit('{"modality":"pdf-page","page":3}'))))
    assert found == "/a.pdf p.3"


def test_cap_and_dedupe(spark):
    rows = [(1, "a", "x y", 0.9), (2, "a", "x y", 0.8), (3, "a", "z", 0.7), (4, "b", "w", 0.6)]
    hits = spark.createDataFrame(rows, "chunk_id long, source_id string, text string, score double")
    assert {r.chunk_id for r in retrieval.source_cap(hits).collect()} == {1, 2, 4}
    for k in (1, 2, 3, 5):
        assert [r.chunk_id for r in retrieval.dedupe_greedy(hits, k).collect()] == [1, 3, 4][:k]


def test_slots(spark):
    def pool(*rows):
        return spark.createDataFrame(rows, "chunk_id long, score double")

    merged = retrieval.merge_slots(pool((1, 0.9)), pool((1, 0.9), (2, 0.5)), pool((1, 0.9), (3, 0.7)), 3)
    assert [r.chunk_id for r in merged.collect()] == [1, 3, 2]


def test_sessions_and_drift(spark):
    days = ["2026-01-01", "2026-02-10", "2026-03-15"]
    rows = spark.createDataFrame([(1, k, d) for k, d in enumerate(days)], "concept_id long, event_id long, d string").withColumn("ts", F.col("d").cast("timestamp"))
    assert [r.idx for r in memory.drift_windows(rows).orderBy("idx").collect()] == [0, 1, 2]
    gap = rows.where("event_id <> 1")
    assert memory.relearned(memory.drift_windows(gap)).first()["relearned"] and not memory.relearned(memory.drift_windows(rows)).first()["relearned"]
    hours = spark.createDataFrame([(0, 0), (1, 24), (2, 49)], "event_id long, h int").select("event_id", F.lit("p").alias("project"), F.timestamp_seconds(F.col("h") * 3600).alias("ts"))
    assert [r.session for r in memory.sessionise(hours).orderBy("event_id").collect()] == [0, 0, 1]


def test_graph(spark):
    edges = spark.createDataFrame([(3, 1, 2, 2, "contains"), (2, 2, 1, 3, "contains"), (1, 3, 0, 9, "derived_from"), (1, 3, 0, 99, "derived_from"), (3, 1, 3, 5, "relates_to"), (2, 2, 3, 1, "contains")], "parent_level int, parent_id long, child_level int, child_id long, relation string")
    chunks = spark.createDataFrame([(9, 1)], "chunk_id long, source_id long")
    nodes = spark.createDataFrame([(3, 1), (3, 5)], "level int, node_id long")
    assert [(r.root_id, r.chunk_id) for r in graph.closure(edges, nodes, chunks).collect()] == [(1, 9)]
    assert [r.node_id for r in graph.unsupported_nodes(nodes, edges, chunks).collect()] == [5]
    hub = spark.createDataFrame([("h", "a", 1.0), ("h", "b", 1.0), ("h", "c", 1.0)], "a string, b string, weight double")
    ids = spark.createDataFrame([("h",), ("a",), ("b",), ("c",), ("z",)], "node_id string")
    ranks = {r.node_id: r.centrality for r in graph.pagerank(ids, hub).collect()}
    assert ranks["h"] == 1.0 and ranks["a"] == ranks["b"] < 1 and ranks["z"] < ranks["a"]


def test_pagerank_against_plain_rounds(spark):
    links = [(1, 2, 1.0), (2, 3, 2.0), (1, 2, 0.5), (3, 99, 7.0)]
    edges = spark.createDataFrame(links, "a long, b long, weight double")
    ids = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 5)], "node_id long")
    both = [(a, b, w) for a, b, w in links if b != 99] + [(b, a, w) for a, b, w in links if b != 99]
    nodes = [1, 2, 3, 4, 5]
    total = {n: sum(w for a, _, w in both if a == n) for n in nodes}
    for rounds in (1, 3, 20, 50):
        rank = dict.fromkeys(nodes, 0.2)
        for _ in range(rounds):
            lost = sum(rank[n] for n in nodes if not total[n])
            rank = {n: (0.15 + 0.85 * lost) / 5 + 0.85 * sum(rank[a] * w / total[a] for a, b, w in both if b == n) for n in nodes}
        got = {r.node_id: r.centrality for r in graph.pagerank(ids, edges, iterations=rounds, every=4).collect()}
        assert got.keys() == rank.keys() and all(abs(got[n] - rank[n] / max(rank.values())) < 1e-12 for n in nodes)
    alone = graph.pagerank(ids, edges.limit(0)).collect()
    assert {(r.node_id, r.centrality) for r in alone} == {(n, 1.0) for n in nodes} and graph.pagerank(ids.limit(0), edges).count() == 0


def test_store(spark):
    frame = lambda *x: spark.createDataFrame([(v,) for v in x], "fingerprint string")
    assert {(r.fingerprint, r.action) for r in store.reconcile(frame("a", "b"), frame("b", "c")).collect()} == {("a", "deleted"), ("b", "kept"), ("c", "created")}
    same = store.reconcile(frame("a"), frame("a"))
    assert [r.action for r in same.collect()] == ["kept"]


def test_clusters_and_centroid(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.1, 1.0]), (5, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "node_id long, vector array<float>")
    assert {(r.node_id, r.cluster) for r in memory.leader_clusters(df).collect()} == {(1, 0), (2, 0), (3, 1), (4, 1)}
    c = vectors.centroids(df.where("node_id in (1, 3)").withColumn("g", F.lit(1)), ["g"], "vector").first()["centroid"]
    assert all(abs(x - 0.5**0.5) < 1e-6 for x in c)


def test_usage_and_history(spark):
    events = spark.createDataFrame([("node", 1), ("node", 2)], "target_kind string, target_id long")
    assert usage.clear(events, ids=[]).count() == 2 and usage.clear(events, "node", [1]).count() == 1
    m = spark.createDataFrame([(1, 0, "user", "q"), (1, 0, "assistant", "a"), (1, 1, "user", "r")], "conversation_id long, turn_index int, role string, text string")
    assert conversations.turn_pairs(m).count() == 1 and conversations.next_turn(m).first()["next_turn"] == 2


def test_gates():
    assert evaluation.modality_gate(1.0, 0.7) and not evaluation.modality_gate(1.0, 0.75) and not evaluation.modality_gate(0, 0)
    assert evaluation.distill_gate(1.0, 0.96, 0.5) and not evaluation.distill_gate(1.0, 0.9, 0.5)


def test_reanchor_of_large_sources(spark):
    """One source of many events and chunks is dealt out, equals plain loops, and no step stands above the pairs."""
    edges = [(1, e, 0, 100 + e, "derived_from") for e in range(40)] + [(1, e, 0, 500 + e % 30, "derived_from") for e in range(0, 40, 3)] * 2 + [(1, 50, 0, 901, "derived_from"), (1, 51, 0, 902, "derived_from"), (1, 51, 0, 700, "derived_from"), (2, 1, 1, 3, "contains"), (2, 1, 0, 950, "derived_from")]
    events = [(e, 7) for e in range(40)] * 2 + [(3, 8), (50, None), (51, 9)]
    chunks = [(c, 7) for c in range(500, 530)] * 2 + [(600, 8), (700, 10), (101, None), (105, None)]
    live = {c for c, _ in chunks}
    hurt = {p for _, p, level, c, r in edges if r == "derived_from" and level == 0 and c not in live}
    fresh = {(1, e, 0, c, "derived_from") for e, s in events if e in hurt for c, t in chunks if s is not None and s == t}
    repaired = {p for _, p, *_ in fresh}
    want = {x for x in edges if not (x[4] == "derived_from" and x[2] == 0 and x[3] not in live and x[1] in repaired)} | fresh
    got = graph.reanchor(
        spark.createDataFrame(edges, "parent_level int, parent_id long, child_level int, child_id long, relation string"),
        spark.createDataFrame(events, "node_id long, source_id long"), spark.createDataFrame(chunks, "chunk_id long, source_id long"), part=8,
    )
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got._jdf.queryExecution().optimizedPlan().nodeName() == "Union"
    assert got.where("child_id between 500 and 529").select(F.spark_partition_id().alias("p")).distinct().count() > 2


def _product(spark, n_events, n_chunks, part):
    """Edges remade for one source whose events are all hurt."""
    nodes, live = spark.range(n_events).select(F.col("id").alias("node_id")), spark.range(10**6, 10**6 + n_chunks).select(F.col("id").alias("chunk_id"))
    edges = nodes.select(F.lit(1).alias("parent_level"), F.col("node_id").alias("parent_id"), F.lit(0).alias("child_level"), (-1 - F.col("node_id")).alias("child_id"), F.lit("derived_from").alias("relation"))
    return graph.reanchor(edges, nodes.withColumn("source_id", F.lit(7)), live.withColumn("source_id", F.lit(7)), part=part)


def test_reanchor_files(spark, tmp_path):
    """Every pair stands once, also over many areas, and files of pairs take a small part of a byte for each."""
    pairs = _product(spark, 200, 300, 2)
    assert pairs.count() == pairs.distinct().count() == 60_000 and pairs.where("parent_id between 0 and 199 and child_id between 1000000 and 1000299").count() == 60_000
    _product(spark, 3000, 1500, 2048).select("parent_id", "child_id").write.parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 4_500_000
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 0.3 * 4_500_000


def test_reanchor_of_keys_that_meet(spark, tmp_path):
    """A pending order is dead evidence also where its key is a supplier's number as a chunk, and an order that is one of its customer's chunks stands once."""
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    put("customer", [(1, 5), (2, 5), (3, 6)], "c_custkey long, c_nationkey int")
    put("supplier", [(0, 5), (1, 5), (2, 7), (3, 5)], "s_suppkey long, s_nationkey int")
    put("orders", [(10000000, 1, "P"), (10000001, 1, "F"), (10000002, 1, "O"), (10000003, 2, "O"), (10000004, 3, "P"), (10000005, 3, "F")], "o_orderkey long, o_custkey long, o_orderstatus string")
    got = sorted(map(tuple, catalog.QUERIES["reanchor"](spark, str(tmp_path)).collect()))
    assert got == [(1, 10000000), (1, 10000001), (1, 10000002), (1, 10000003), (2, 10000003), (3, 10000004), (3, 10000005)]
