"""Retrieval for many questions against retrieval for each of them."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.functions import text, vectors
from quillstone.operators import bulk, evaluation, retrieval

DRAW = random.Random(4)
WORDS = ["tea", "hot", "Cold", "pot_lid", "water", "cup", "mint", "leaf", "été", "_"]
NOW = "2024-02-01"


def now():
    return F.lit(NOW).cast("timestamp")


def prose(n):
    return " ".join(DRAW.choices(WORDS, k=n))


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(k, f"s{k % 4}", prose(DRAW.randint(1, 12)), f"title {WORDS[k % 7]}", f"2024-01-{1 + k % 28:02d}", "note" if k % 3 else "pdf") for k in range(60)]
    rows += [(60 + k, "copies", "tea tea hot water cup " + "x" * (k == 9), None, "2024-01-30", "note") for k in range(30)] + [(90, "s1", None, None, None, None), (91, None, "", "tea", None, "note")]
    return spark.createDataFrame(rows, "chunk_id long, source_id string, text string, title string, ts string, source_type string").withColumn("ts", F.col("ts").cast("timestamp")).repartition(5).cache()


@pytest.fixture(scope="module")
def embedded(chunks):
    return chunks.where("chunk_id % 5 <> 0").select("chunk_id", F.lit("m").alias("model"), vectors.bucket_embedding(F.coalesce("text", F.lit(""))).alias("vector")).cache()


QUESTIONS = ["hot tea", "compare hot tea with cold water", "mint vs leaf", "nothing here", "", "pot lid potlid", "cup", "difference between été and tea?"]


@pytest.fixture(scope="module")
def queries(spark):
    rows = spark.createDataFrame([(k * 3, q) for k, q in enumerate(QUESTIONS)], "query_id long, query_text string")
    asked = rows.withColumn("vector", F.when(F.length("query_text") > 0, vectors.bucket_embedding(F.col("query_text"))))
    return asked.cache()


def by_query(rows, *columns):
    out = {}
    for r in rows.collect():
        out.setdefault(r.query_id, []).append((r["rank"], tuple(r[c] for c in columns)))
    return {q: [x for _, x in sorted(v)] for q, v in out.items()}


@pytest.mark.parametrize("most", [2, 256])
def test_vectors_and_hits(chunks, embedded, queries, monkeypatch, most):
    monkeypatch.setattr(bulk, "MOST", most)
    asked = {r.query_id: r for r in queries.collect()}
    near = by_query(bulk.ranked(bulk.vector_bulk(embedded, queries, 7).withColumn("score", F.col("cosine"))), "chunk_id")
    held = {r.chunk_id: np.array(r.vector) for r in embedded.collect()}
    for q, r in asked.items():
        cosine = lambda v, x=r.vector: round(float(v @ np.array(x) / (np.linalg.norm(v) * np.linalg.norm(x))), 9) if np.linalg.norm(v) else 0.0
        expected = sorted(held, key=lambda k: (-cosine(held[k]), k))[:7] if r.vector and any(r.vector) else []
        assert [k for (k,) in near.get(q, [])] == expected
    options = [{}, {"cap": 0}, {"profile": "recent", "source_types": ["pdf"]}, {"restrict_ids": chunks.where("chunk_id % 2 = 0"), "cap": 0}][:: 1 if most > 2 else 3]
    for option in options:
        got = by_query(bulk.retrieve_bulk(chunks, embedded, queries, now(), 4, threshold=0.9, **option), "chunk_id")
        # One question at a time is slow.
        for q, r in list(asked.items())[most % 3 :: 3]:
            rest = {k: v for k, v in option.items() if k != "cap"}
            scored = retrieval.hybrid_scores(chunks, embedded, r.query_text, r.vector or [0.0], now(), top_k=4, **rest).withColumn("score", F.round("score", 9))
            expected = retrieval.dedupe_greedy(retrieval.source_cap(scored, option.get("cap", 2)), 4, 0.9).collect()
            assert [k for (k,) in got.get(q, [])] == [x.chunk_id for x in expected], (option, r.query_text)


def test_nodes(chunks, embedded, queries):
    nodes = chunks.select(F.col("chunk_id").alias("node_id"), "title", F.col("text").alias("content"), F.col("ts").alias("time_start"), F.when(F.col("chunk_id") % 4 > 0, (F.col("chunk_id") % 10) / 10).alias("centrality"))
    vecs = embedded.select(F.col("chunk_id").alias("node_id"), "vector")
    got = bulk.nodes_bulk(nodes, vecs, queries, now(), 6)
    distilled = nodes.select("node_id", F.col("content").alias("summary")).join(embedded.select(F.col("chunk_id").alias("node_id"), "vector", F.when(F.col("chunk_id") % 2 > 0, "m").otherwise("n").alias("model")), "node_id", "left")
    cores = bulk.distilled_bulk(distilled, nodes, queries, now(), 6, "m")
    for r in queries.where("query_id in (0, 9, 12)").collect():
        one = retrieval.node_scores(nodes, vecs, r.query_text, r.vector, now()).withColumn("score", F.round("score", 9))
        two = retrieval.distilled_scores(distilled, nodes, r.query_text, r.vector, now(), "m").withColumn("score", F.round("score", 9))
        for found, single in ((got, one), (cores, two)):
            mine = sorted(((x.score, x.node_id) for x in found.where(F.col("query_id") == r.query_id).collect()), reverse=True)
            assert mine == [(x.score, x.node_id) for x in retrieval.top_nodes(single, 6).collect()]
    evidence = nodes.select("node_id", F.col("node_id").alias("chunk_id"))
    uris = chunks.select("chunk_id", F.col("source_id").alias("source_uri")).where("source_uri is not null")
    drilled = by_query(bulk.drill_down_bulk(got, evidence, uris), "uri")
    single = retrieval.drill_down(got.where("query_id = 0"), evidence, uris).orderBy("rank").collect()
    assert [u for (u,) in drilled[0]] == [r.uri for r in single]


def test_merge_of_slots(spark):
    pools = []
    for question in range(40):
        for pool in range(3):
            ids = DRAW.sample(range(12), DRAW.randint(0, 9))
            pools += [(question, pool, f"q{question}p{pool}", i, round(DRAW.choice([0.1, 0.2, 0.3, 0.4]) + (i % 3) / 100, 3)) for i in ids]
    rows = spark.createDataFrame(pools, "question_id long, pool int, subquery string, chunk_id long, score double").cache()
    for k in (1, 2, 4, 8):
        got = {}
        for r in bulk.merge_slots_bulk(rows, k).collect():
            got.setdefault(r.question_id, []).append((r["rank"], r.chunk_id, r.subquery, r.score))
        for question in range(0, 40, 4 if k == 4 else 10):
            mine = [rows.where((F.col("question_id") == question) & (F.col("pool") == p)) for p in range(3)]
            expected = [(r.chunk_id, r.subquery, r.score) for r in retrieval.merge_slots(*mine, k).collect()]
            assert [x[1:] for x in sorted(got.get(question, []))] == expected, (k, question)


def test_comparative_questions(chunks, embedded, queries):
    sides = queries.withColumn("s", text.comparative(F.col("query_text"))).select("*", "s.left", "s.right")
    asked = sides.withColumn("left_vector", vectors.bucket_embedding(F.coalesce("left", F.lit("")))).withColumn("right_vector", vectors.bucket_embedding(F.coalesce("right", F.lit(""))))
    got = by_query(bulk.comparative_bulk(chunks, embedded, asked, now(), 4), "chunk_id", "subquery")
    embed = lambda words: chunks.sparkSession.range(1).select(vectors.bucket_embedding(F.lit(words)).alias("v")).first()["v"]
    for r in queries.where("query_id in (0, 3, 6, 21)").collect():
        expected = retrieval.hybrid_retrieve(chunks, embedded, r.query_text, r.vector, now(), 4, embed=embed).collect()
        assert got[r.query_id] == [(x.chunk_id, x.subquery) for x in expected]
    assert any(side for rows in got.values() for _, side in rows)


def test_first_ranks(chunks, queries):
    gold = queries.select("query_id", F.explode(F.array(F.lit(61), F.lit(3), F.lit(90)).cast("array<bigint>")).alias("uri")).where("query_id < 15")
    ranks = {r.query_id: r["rank"] for r in bulk.first_ranks(chunks.select("chunk_id", "text"), queries, gold, (0.0, 1.0, 0.0)).collect()}
    hits = bulk.ranked(bulk.scan(chunks.select("chunk_id", "text"), queries, 1000, (0.0, 1.0, 0.0)))
    expected = evaluation.first_correct_rank(hits.select("query_id", F.col("chunk_id").alias("uri"), "rank"), gold)
    assert ranks == {r.query_id: r["rank"] for r in expected.collect()} and None in ranks.values() and max(filter(None, ranks.values())) > 1


def test_ranks_need_one_pool_of_workers(spark, chunks, queries, monkeypatch):
    """A list that is dealt out goes through Python workers of another kind, which stay beside the scan's on every executor."""

    def dealt(*_, **__):
        raise AssertionError("a list is dealt out to Python workers")

    chunks.count(), queries.count()
    gold = queries.select("query_id", F.lit(3).cast("bigint").alias("uri"))
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", dealt)
    monkeypatch.setattr(bulk, "MOST", 3)
    ranks = {r.query_id: r["rank"] for r in bulk.first_ranks(chunks.select("chunk_id", "text"), queries, gold, (0.0, 1.0, 0.0)).collect()}
    assert len(ranks) == len(QUESTIONS) and min(filter(None, ranks.values())) >= 1


@pytest.mark.parametrize("column", ["text", "title"])
def test_long_texts_are_read_one_by_one(column):
    block = bulk.Block.of([{"query_id": 1, "query_text": "hot tea", "vector": None}])
    long = ["tea " * 25_000, None, "", "hot tea", *["cup " * 25_000] * 96]
    batch = pa.RecordBatch.from_pydict({"chunk_id": list(range(len(long))), column: pa.array(long, pa.string())})
    next(bulk._scored(iter([batch.slice(0, 4)]), block, (0.0, 1.0, 1.0)))
    tracemalloc.start()
    (found,) = bulk._scored(iter([batch]), block, (0.0, 1.0, 1.0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.score[:5, 0].tolist() == [round(0.5**0.5, 9), 0.0, 0.0, 1.0, 0.0]
    # All texts together have ten million characters; one and its words take three.
    assert peak < 6e6


def test_prefixes_grow(spark):
    """All hits but the first and the last repeat each other, so the walk goes on to the end."""
    rows = [(q, k, f"same words here {q}" if 0 < k < 150 else f"other{k} text{k}", 1.0 - k / 1000) for q in (1, 2) for k in range(152)] + [(3, 0, "alone", 1.0)]
    hits = spark.createDataFrame(rows, "query_id long, chunk_id long, text string, score double").repartition(3)
    asked = []

    def best(n, open_):
        asked.append((n, None if open_ is None else open_.count()))
        mine = hits if open_ is None else hits.join(open_, "query_id", "left_semi")
        return mine.where(F.col("chunk_id") < n)

    found = retrieval.dedupe_prefixes(best, None, 4)
    assert sorted((r.query_id, r.chunk_id) for r in found.collect()) == [(q, k) for q in (1, 2) for k in (0, 1, 150, 151)] + [(3, 0)]
    assert asked == [(16, None), (32, 2), (64, 2), (128, 2), (256, 2)]
    assert [r.chunk_id for r in retrieval.dedupe_greedy(hits.where("query_id = 1"), 4).collect()] == [0, 1, 150, 151]


def test_nothing_asked(chunks, embedded, queries):
    none = queries.limit(0)
    assert bulk.vector_bulk(embedded, none, 3).count() == 0 and bulk.retrieve_bulk(chunks, embedded, none, now()).count() == 0 and bulk.retrieve_bulk(chunks.limit(0), embedded.limit(0), queries, now()).count() == 0
