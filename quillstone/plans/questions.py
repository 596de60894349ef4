"""Queries over retrieval for many questions at once, and reports of the first rows of views, beside their SQL.

Benchmark items are the questions, each with the vector of its number; documents are chunks, and nodes of their own.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bulk, conversations, evaluation, memory, retrieval, views
from .catalog import _AGE, _TOK, QUERY, SQL, SQL_TOKENS, _chunks, _messages, _now, _project_events, _read, _vectors, query
from .memories import _BULK, _GOLD, _METRICS, _asked, _gold, _lexical_sql, _metrics, _nodes, _user_evidence, _users

#: rows of (item_id, vec_id, c): cosines of every item with every vector, and the 50 best of each item.
_PAIRS = """pc AS (SELECT item_id, e.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS c FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id CROSS JOIN embeddings e),
pool AS (SELECT item_id, vec_id AS doc_id, c FROM pc QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY c DESC, vec_id) <= 50)"""
#: Scores of every item's candidates, of which the first two of a source stay.
_HITS = f"""h AS (SELECT item_id, doc_id, source, round(0.30 * coalesce(s, 0) + 0.55 * coalesce((c + 1) / 2, 0) + 0.15 * exp(-{_AGE} / 45.0), 9) AS score
  FROM (SELECT item_id, doc_id, s, c FROM (SELECT item_id, doc_id, s FROM sc) FULL JOIN pool USING (item_id, doc_id)) JOIN documents USING (doc_id)),
capped AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) <= 2),
ordered AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS i FROM capped)"""


def _walk(key: str, k: int, ordered: str = "ordered") -> str:
    """CTEs that walk ``ordered`` (``key``, doc_id, i) and keep the first ``k`` that no kept one nearly repeats: ``walked`` (``key``, doc_id, i)."""
    return f"""wt AS (SELECT doc_id, unnest({SQL_TOKENS}) AS u FROM documents WHERE doc_id IN (SELECT doc_id FROM {ordered})), wc AS (SELECT doc_id, u, count(*) AS n FROM wt GROUP BY ALL), wn AS (SELECT doc_id, sum(n * n) AS n2 FROM wc GROUP BY 1),
dots AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(a.n * b.n) AS d FROM wc a JOIN wc b ON a.u = b.u AND a.doc_id <> b.doc_id GROUP BY ALL),
near AS (SELECT x, y FROM dots JOIN wn a ON a.doc_id = x JOIN wn b ON b.doc_id = y WHERE d / sqrt(CAST(a.n2 * b.n2 AS DOUBLE)) >= 0.95),
likes AS (SELECT x, list(y) AS ys FROM near GROUP BY 1), steps AS (SELECT o.{key}, o.i, o.doc_id, coalesce(ys, []) AS ys FROM {ordered} o LEFT JOIN likes ON likes.x = o.doc_id),
walk AS (SELECT {key}, i, doc_id, true AS stays, [doc_id] AS kept FROM steps WHERE i = 1
  UNION ALL SELECT s.{key}, s.i, s.doc_id, NOT list_has_any(kept, ys), CASE WHEN list_has_any(kept, ys) THEN kept ELSE list_append(kept, s.doc_id) END FROM walk w JOIN steps s ON s.{key} = w.{key} AND s.i = w.i + 1 WHERE len(kept) < {k}),
walked AS (SELECT {key}, doc_id, i FROM walk WHERE stays)"""


@query(
    """WITH pc AS (SELECT item_id, e.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS c FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id CROSS JOIN embeddings e)
SELECT item_id AS query_id, vec_id AS chunk_id, round(c, 6) AS cosine FROM pc QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY c DESC, vec_id) <= 50"""
)
def vector_bulk(spark, sf_dir):
    """The 50 nearest vectors of every item."""
    return bulk.vector_bulk(_vectors(spark, sf_dir), _asked(spark, sf_dir), 50).select("query_id", "chunk_id", F.round("cosine", 6).alias("cosine"))


@query(f"WITH RECURSIVE {_BULK}, {_PAIRS}, {_HITS}, {_walk('item_id', 5)} SELECT item_id AS query_id, doc_id AS chunk_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY i) AS INTEGER) AS rank, round(score, 6) AS score FROM walked JOIN h USING (item_id, doc_id)")
def hybrid_bulk(spark, sf_dir):
    """The five hits of every item by words, vectors and time, two of a source at most, without near duplicates."""
    found = bulk.retrieve_bulk(_chunks(spark, sf_dir), _vectors(spark, sf_dir), _asked(spark, sf_dir), _now(), 5)
    return found.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(
    f"""WITH RECURSIVE {_BULK}, {_PAIRS}, {_HITS}, {_walk('item_id', 5)}, {_GOLD}, rr AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY i) AS r FROM walked),
f AS (SELECT query_id, min(r) AS rank FROM gold LEFT JOIN rr ON rr.item_id = query_id AND rr.doc_id = uri GROUP BY 1) {_METRICS.format(5)}"""
)
def eval_hybrid(spark, sf_dir):
    """How hybrid retrieval finds the documents that quote an item."""
    found = bulk.retrieve_bulk(_chunks(spark, sf_dir), _vectors(spark, sf_dir), _asked(spark, sf_dir), _now(), 5)
    ranks = evaluation.first_correct_rank(found.select("query_id", F.col("chunk_id").alias("uri"), "rank"), _gold(spark, sf_dir))
    return _metrics(ranks, 5)


_SOURCE_GOLD = "sg AS (SELECT DISTINCT query_id, source FROM gold JOIN documents ON doc_id = uri)"


def _source_gold(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("uri"), "source")
    return _gold(spark, sf_dir).join(docs, "uri").select("query_id", F.col("source").alias("uri")).distinct()


def _drilled(spark, sf_dir, hits):
    docs = _read(spark, sf_dir, "documents")
    evidence = docs.select(F.col("doc_id").alias("node_id"), F.col("doc_id").alias("chunk_id"))
    ranks = bulk.drill_down_bulk(hits, evidence, docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_uri")))
    return _metrics(evaluation.first_correct_rank(ranks, _source_gold(spark, sf_dir)), 5)


_NODE_TEXT = SQL_TOKENS.replace("coalesce(text, '')", "coalesce(lang, '') || ' ' || coalesce(text, '')")
_LEVEL = f"""nt AS (SELECT doc_id, unnest({_NODE_TEXT}) AS u FROM documents), nc AS (SELECT doc_id, u, count(*) AS n FROM nt GROUP BY ALL), nn AS (SELECT doc_id, sum(n * n) AS n2 FROM nc GROUP BY 1),
ns AS (SELECT item_id, doc_id, sum(n * m) / (sqrt(CAST(any_value(m2) AS DOUBLE)) * sqrt(CAST(any_value(n2) AS DOUBLE))) AS s FROM nc JOIN bc USING (u) JOIN nn USING (doc_id) JOIN bn USING (item_id) GROUP BY ALL),
nh AS (SELECT item_id, doc_id, source, round(0.25 * coalesce(s, 0) + 0.55 * coalesce((c + 1) / 2, 0) + 0.10 * exp(-{_AGE} / 45.0) + 0.10 * ((doc_id % 10) / 10.0), 9) AS score
  FROM (SELECT item_id, doc_id, s, c FROM ns FULL JOIN (SELECT item_id, vec_id AS doc_id, c FROM pc) USING (item_id, doc_id)) JOIN documents USING (doc_id)),
nr AS (SELECT item_id, source, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC) AS r FROM nh QUALIFY r <= 5)"""
_DRILL = "dr AS (SELECT item_id, source, row_number() OVER (PARTITION BY item_id ORDER BY r, source) AS r FROM (SELECT item_id, source, min(r) AS r FROM {0} GROUP BY ALL)), f AS (SELECT query_id, min(r) AS rank FROM sg LEFT JOIN dr ON dr.item_id = query_id AND dr.source = sg.source GROUP BY 1)"


@query(f"WITH {_BULK}, {_PAIRS}, {_LEVEL}, {_GOLD}, {_SOURCE_GOLD}, {_DRILL.format('nr')} {_METRICS.format(5)}")
def eval_level(spark, sf_dir):
    """How the best concepts of every item lead to the sources that quote it; documents are the concepts."""
    vecs = _vectors(spark, sf_dir).select(F.col("chunk_id").alias("node_id"), "vector")
    return _drilled(spark, sf_dir, bulk.nodes_bulk(_nodes(spark, sf_dir), vecs, _asked(spark, sf_dir), _now(), 5))


_SUMMARY = "left(text, 200)"
_DISTILLED = f"""dt2 AS (SELECT doc_id, unnest({SQL_TOKENS.replace("coalesce(text, '')", f"coalesce({_SUMMARY}, '')")}) AS u FROM documents), dc2 AS (SELECT doc_id, u, count(*) AS n FROM dt2 GROUP BY ALL), dn2 AS (SELECT doc_id, sum(n * n) AS n2 FROM dc2 GROUP BY 1),
ds AS (SELECT item_id, doc_id, sum(n * m) / (sqrt(CAST(any_value(m2) AS DOUBLE)) * sqrt(CAST(any_value(n2) AS DOUBLE))) AS s FROM dc2 JOIN bc USING (u) JOIN dn2 USING (doc_id) JOIN bn USING (item_id) GROUP BY ALL),
dh AS (SELECT item_id, doc_id, source, round(0.25 * coalesce(s, 0) + 0.55 * coalesce((c + 1) / 2, 0) + 0.10 * exp(-{_AGE} / 45.0) + 0.10 * ((doc_id % 10) / 10.0), 9) AS score
  FROM (SELECT item_id, doc_id, s, c FROM ds FULL JOIN (SELECT item_id, vec_id AS doc_id, c FROM pc WHERE vec_id % 2 = 0) USING (item_id, doc_id)) JOIN documents USING (doc_id)),
dq AS (SELECT item_id, source, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC) AS r FROM dh QUALIFY r <= 5)"""


@query(f"WITH {_BULK}, {_PAIRS}, {_DISTILLED}, {_GOLD}, {_SOURCE_GOLD}, {_DRILL.format('dq')} {_METRICS.format(5)}")
def eval_distilled(spark, sf_dir):
    """The same by distilled nodes, whose summaries are the beginnings of documents; every second vector is of another model."""
    nodes = _nodes(spark, sf_dir)
    vecs = _vectors(spark, sf_dir).select(F.col("chunk_id").alias("node_id"), "vector", F.when(F.col("chunk_id") % 2 == 0, "m").otherwise("other").alias("model"))
    distilled = nodes.select("node_id", F.left("content", F.lit(200)).alias("summary")).join(vecs, "node_id", "left")
    return _drilled(spark, sf_dir, bulk.distilled_bulk(distilled, nodes, _asked(spark, sf_dir), _now(), 5, "m"))


_MERGE = """a0 AS (SELECT *, row_number() OVER (PARTITION BY item_id, p ORDER BY score DESC, doc_id) AS r FROM pools), f0 AS (SELECT * FROM a0 WHERE p = 0 AND r <= 6),
l0 AS (SELECT * FROM a0 WHERE p = 1 AND (item_id, doc_id) NOT IN (SELECT (item_id, doc_id) FROM f0) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY r) <= 3),
t1 AS (SELECT item_id, p, doc_id, score FROM f0 UNION ALL SELECT item_id, p, doc_id, score FROM l0),
r0 AS (SELECT * FROM a0 WHERE p = 2 AND (item_id, doc_id) NOT IN (SELECT (item_id, doc_id) FROM t1) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY r) <= 3),
t2 AS (SELECT * FROM t1 UNION ALL SELECT item_id, p, doc_id, score FROM r0), n2 AS (SELECT item_id, count(*) AS n FROM t2 GROUP BY 1),
b0 AS (SELECT * FROM pools WHERE (item_id, doc_id) NOT IN (SELECT (item_id, doc_id) FROM t2) QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY score DESC, p) = 1),
b1 AS (SELECT b0.* FROM b0 JOIN n2 USING (item_id) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 12 - n2.n),
merged AS (SELECT * FROM t2 UNION ALL SELECT item_id, p, doc_id, score FROM b1)"""


@query(
    f"""WITH pc AS (SELECT item_id, p, e.vec_id AS doc_id, round(round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) / 2 + 0.5, 9) AS score
  FROM benchmark b CROSS JOIN range(0, 3) AS s(p) JOIN embeddings q ON q.vec_id = b.item_id + 7 * p CROSS JOIN embeddings e), pools AS (SELECT * FROM pc QUALIFY row_number() OVER (PARTITION BY item_id, p ORDER BY score DESC, doc_id) <= 12 - 3 * p), {_MERGE}
SELECT item_id AS query_id, CAST(p AS INTEGER) AS pool, doc_id AS chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY merged.score DESC, doc_id) AS INTEGER) AS rank FROM merged"""
)
def slot_merge_bulk(spark, sf_dir):
    """Twelve hits of every item from three pools: its nearest vectors and those of two others, the sides."""
    vecs = _vectors(spark, sf_dir)
    asked = _read(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("pool"))
    asked = asked.withColumn("query_id", F.col("item_id") * 4 + F.col("pool")).join(vecs.withColumnRenamed("chunk_id", "__v"), F.col("__v") == F.col("item_id") + 7 * F.col("pool")).select("query_id", "vector")
    near = bulk.vector_bulk(vecs, asked, 12).select(F.shiftright("query_id", 2).alias("question_id"), F.col("query_id").bitwiseAND(F.lit(3).cast("bigint")).cast("int").alias("pool"), "chunk_id", F.round(F.col("cosine") / 2 + 0.5, 9).alias("score"))
    order = Window.partitionBy("question_id", "pool").orderBy(F.desc("score"), "chunk_id")
    pools = near.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= 12 - 3 * F.col("pool")).drop("__r")
    merged = bulk.merge_slots_bulk(pools, 12)
    return merged.select(F.col("question_id").alias("query_id"), "pool", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH RECURSIVE {_TOK}, ordered AS (SELECT 0 AS one, doc_id, lexical, row_number() OVER (ORDER BY lexical DESC, doc_id) AS i FROM lx), {_walk('one', 10)} SELECT doc_id AS chunk_id, round(lexical, 6) AS score FROM walked JOIN lx USING (doc_id)")
def dedupe_greedy(spark, sf_dir):
    """The ten best documents by words, none nearly repeating a better one."""
    chunks = _chunks(spark, sf_dir)
    ranked = retrieval.with_lexical(chunks, QUERY, F.col("text"), "score").where("score > 0").select("chunk_id", "score")
    return retrieval.dedupe_greedy(ranked, 10, texts=chunks).select("chunk_id", F.round("score", 6).alias("score"))


_SOURCES = "(SELECT CAST(replace(source, 'src', '') AS BIGINT) AS node_id, string_agg(lang, ' ' ORDER BY doc_id) || ' the thing of ' || source AS content FROM documents GROUP BY source)"


@query(
    f"""WITH RECURSIVE {_lexical_sql(_SOURCES, "node_id", "content")}, m AS (SELECT k FROM lx WHERE lexical > 0 ORDER BY 0.25 * lexical DESC, k DESC LIMIT 3), dl AS (WITH {_TOK} SELECT doc_id, source, lexical FROM lx),
hits AS (SELECT doc_id, 0.85 * lexical + 0.15 * exp(-{_AGE} / 45.0) AS score FROM dl WHERE CAST(replace(source, 'src', '') AS BIGINT) IN (SELECT k FROM m)),
ordered AS (SELECT 0 AS one, doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS i FROM hits), {_walk('one', 3)} SELECT doc_id AS chunk_id, round(score, 6) AS score FROM walked JOIN hits USING (doc_id)"""
)
def level_retrieve(spark, sf_dir):
    """The three hits among the chunks below the three best concepts, which are the documents' sources."""
    docs = _read(spark, sf_dir, "documents")
    number = F.regexp_replace("source", "src", "").cast("bigint")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "lang"))), lambda s: s["lang"]), " ")
    nodes = docs.groupBy("source").agg(said.alias("__langs")).select(
        number.alias("node_id"), F.lit(3).alias("level"), F.lit("concept").alias("node_type"), F.lit("").alias("title"), F.concat("__langs", F.lit(" the thing of "), "source").alias("content"), F.lit(None).cast("timestamp").alias("time_start"),
        F.lit(None).cast("double").alias("centrality"),
    )
    evidence = docs.select(number.alias("root_id"), F.col("doc_id").alias("chunk_id"))
    hits, _ = retrieval.level_retrieve(nodes, None, evidence, _chunks(spark, sf_dir), None, QUERY, None, _now(), "concept", 3)
    return hits.select("chunk_id", F.round("score", 6).alias("score"))


@query(f"SELECT concept_id, overall_drift, support, relearning FROM ({SQL['drift_view']}) WHERE support >= 66 ORDER BY overall_drift DESC, least(1.0, support / 3.0) DESC, concept_id LIMIT 25")
def drift_top(spark, sf_dir):
    """The 25 users who moved most, of those with 66 events or more."""
    evidence, chunks = _user_evidence(spark, sf_dir)
    windows = memory.drift_windows(_project_events(spark, sf_dir).withColumnRenamed("project", "concept_id"), 3.0).withColumn("drift", (F.col("idx") % 5) / 5.0)
    found = views.drift_view(windows, _users(spark, sf_dir), evidence, chunks, 25, 66)
    return found.select("concept_id", F.round("overall_drift", 6).alias("overall_drift"), "support", "relearning")


@query(f"SELECT node_id, core_count, full_count FROM ({SQL['distilled_view']}) ORDER BY core_count / full_count, node_id LIMIT 20")
def distilled_top(spark, sf_dir):
    """The 20 users whose clicks are the smallest share of their events."""
    evidence, chunks = _user_evidence(spark, sf_dir)
    clicks = F.array_sort(F.collect_list(F.when(F.col("event_type") == "click", F.col("event_id"))))
    core = _read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("node_id")).agg(clicks.alias("core"))
    distilled = core.select("node_id", F.lit(3).alias("level"), F.lit("s").alias("summary"), "core", F.lit(1.0).alias("confidence"))
    return views.distilled_view(distilled, _users(spark, sf_dir), evidence, chunks, 20).select("node_id", "core_count", "full_count")


@query("SELECT conv_id AS conversation_id, count(*) AS n_messages FROM conversations GROUP BY 1 ORDER BY max(turn) DESC, conv_id DESC LIMIT 10")
def history_top(spark, sf_dir):
    """The ten latest conversations, a conversation's last turn being its time."""
    m = _messages(spark, sf_dir)
    heads = m.groupBy("conversation_id").agg(F.max("turn_index").alias("updated_at"))
    return conversations.history(heads, m, 10).select("conversation_id", "n_messages")
