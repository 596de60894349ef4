"""All queries by name over the driver's tables, and the SQL of those that SQL can express.

documents plays the chunks (chunk_id = doc_id, source_id = source), embeddings the
vectors, events the usage log and the dated events, benchmark the evaluation queries, and
orders and parts a two-level graph. Times are relative to a fixed ``NOW``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chunking, scores, text, vectors
from ..operators import conversations, evaluation, graph, memory, retrieval, store, usage

NOW = "2024-02-01 00:00:00"
QUERY = "the tion of worthless eron and thing"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _now():
    return F.lit(NOW).cast("timestamp")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.expr("timestampadd(DAY, cast(doc_id % 90 as int), timestamp'2023-11-01')")
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_id"), "text", ts.alias("ts"))


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.when(F.col("event_type") == "click", 2.0).when(F.col("event_type") == "purchase", 3.0).otherwise(1.0)
    return _read(spark, sf_dir, "events").select(F.lit("node").alias("target_kind"), F.col("user_id").alias("target_id"), "event_type", weight.alias("weight"), F.col("ts").cast("timestamp").alias("event_at"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label", F.col("embedding").alias("vector"))


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return _read(spark, sf_dir, "embeddings").orderBy("vec_id").limit(1).first()["embedding"]


#: The tokens of ``text`` in DuckDB.
SQL_TOKENS = """flatten(list_transform(regexp_extract_all(coalesce(text, ''), '[a-zA-Z0-9_]+'),
    lambda x: CASE WHEN contains(x, '_') AND replace(lower(x), '_', '') <> '' THEN [lower(x), replace(lower(x), '_', '')] ELSE [lower(x)] END))"""

_WANTED = sorted(retrieval.query_tokens(QUERY).items())
_TOK = """tok AS (
  SELECT doc_id, source, flatten(list_transform(regexp_extract_all(coalesce(text, ''), '[a-zA-Z0-9_]+'),
    lambda x: CASE WHEN contains(x, '_') AND replace(lower(x), '_', '') <> '' THEN [lower(x), replace(lower(x), '_', '')] ELSE [lower(x)] END)) AS t
  FROM documents
), cnt AS (SELECT doc_id, source, u, count(*) AS n FROM (SELECT doc_id, source, unnest(t) AS u FROM tok) GROUP BY ALL
), q(u, m) AS (VALUES %s
), lex AS (
  SELECT doc_id, source, sum(CASE WHEN q.m IS NULL THEN 0 ELSE n * q.m END) / (sqrt(CAST(%d AS DOUBLE)) * sqrt(CAST(sum(n * n) AS DOUBLE))) AS lexical
  FROM cnt LEFT JOIN q USING (u) GROUP BY ALL
), lx AS (SELECT * FROM lex WHERE lexical > 0)""" % (", ".join(f"('{t}', {n})" for t, n in _WANTED), sum(n * n for _, n in _WANTED))


@query(f"WITH {_TOK} SELECT doc_id AS chunk_id, round(lexical, 6) AS lexical FROM lx ORDER BY lx.lexical DESC, doc_id LIMIT 20")
def lexical_topk(spark, sf_dir):
    found = retrieval.lexical_scores(_chunks(spark, sf_dir), QUERY)
    return found.orderBy(F.desc("lexical"), "chunk_id").limit(20).select("chunk_id", F.round("lexical", 6).alias("lexical"))


_AGE = "greatest(floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(TIMESTAMP '2023-11-01' + to_days(CAST(doc_id % 90 AS INTEGER)))) / 86400000000.0), 0)"


@query(
    f"""WITH {_TOK}, s AS (SELECT doc_id, source, 0.85 * lexical + 0.15 * exp(-{_AGE} / 45.0) AS score FROM lx),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS n FROM s)
SELECT doc_id AS chunk_id, source AS source_id, round(score, 6) AS score FROM r WHERE n <= 2 ORDER BY r.score DESC, doc_id LIMIT 20"""
)
def lexical_source_cap(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    scored = retrieval.lexical_scores(chunks, QUERY).join(chunks.select("chunk_id", "source_id", "ts"), "chunk_id")
    ranked = scored.withColumn("score", 0.85 * F.col("lexical") + 0.15 * scores.recency(F.col("ts"), _now()))
    return retrieval.source_cap(ranked).orderBy(F.desc("score"), "chunk_id").limit(20).select("chunk_id", "source_id", F.round("score", 6).alias("score"))


_COS = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1))"


@query(f"SELECT vec_id AS chunk_id, round({_COS}, 6) AS cosine FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 50")
def vector_topk(spark, sf_dir):
    return retrieval.vector_topk(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 50).select("chunk_id", F.round("cosine", 6).alias("cosine"))


@query(
    f"""WITH {_TOK}, v AS (SELECT vec_id AS doc_id, {_COS} AS cosine FROM embeddings ORDER BY 2 DESC, 1 LIMIT 100),
s AS (SELECT d.doc_id, cosine, coalesce(lexical, 0) AS lexical, {_AGE.replace('doc_id', 'd.doc_id')} AS age
      FROM documents d LEFT JOIN v ON d.doc_id = v.doc_id LEFT JOIN lx ON d.doc_id = lx.doc_id WHERE cosine IS NOT NULL OR lexical > 0)
SELECT doc_id AS chunk_id, round(0.55 * coalesce((cosine + 1) / 2, 0) + 0.30 * lexical + 0.15 * exp(-age / 45.0), 6) AS score FROM s"""
)
def hybrid_blend(spark, sf_dir):
    found = retrieval.hybrid_scores(_chunks(spark, sf_dir), _vectors(spark, sf_dir).select("chunk_id", "vector"), QUERY, _query_vector(spark, sf_dir), _now(), top_k=10)
    return found.select("chunk_id", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_TOK}, a AS (SELECT doc_id, row_number() OVER (ORDER BY lexical DESC, doc_id) AS r FROM lx QUALIFY r <= 50),
b AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY {_COS} DESC, vec_id) AS r FROM embeddings QUALIFY r <= 50)
SELECT doc_id AS uri, round(sum(1.0 / (60 + r)), 9) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1"""
)
def rrf_merge(spark, sf_dir):
    def ranks(df, score):
        top = df.orderBy(F.desc(score), "chunk_id").limit(50)
        return top.select(F.col("chunk_id").alias("uri"), F.row_number().over(Window.orderBy(F.desc(score), "chunk_id")).alias("rank"))

    lists = ranks(retrieval.lexical_scores(_chunks(spark, sf_dir), QUERY), "lexical").unionByName(ranks(retrieval.vector_topk(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 50), "cosine"))
    return retrieval.rrf(lists).select("uri", F.round("rrf", 9).alias("rrf"))


@query("SELECT event_id, round(exp(-greatest(floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000.0), 0) / 45.0), 6) AS recency FROM events")
def recency_score(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", F.round(scores.recency(F.col("ts").cast("timestamp"), _now()), 6).alias("recency"))


_W = "(CASE event_type WHEN 'click' THEN 2.0 WHEN 'purchase' THEN 3.0 ELSE 1.0 END)"
_DECAY = f"sum({_W} * pow(0.5, greatest((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000.0, 0) / 30.0))"


@query(f"SELECT user_id AS target_id, count(*) AS n, round({_DECAY}, 6) AS strength FROM events GROUP BY 1")
def usage_strength(spark, sf_dir):
    return usage.summary(_usage(spark, sf_dir), _now()).select("target_id", "n", F.round("strength", 6).alias("strength"))


@query(f"SELECT user_id AS target_id, round({_DECAY} / ({_DECAY} + 3.0), 6) AS usage FROM events GROUP BY 1")
def usage_normalized(spark, sf_dir):
    return usage.summary(_usage(spark, sf_dir), _now()).select("target_id", F.round(scores.saturated(F.col("strength")), 6).alias("usage"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def usage_by_type(spark, sf_dir):
    return usage.by_type(_read(spark, sf_dir, "events"))


@query("SELECT count(*) AS n_left FROM events WHERE user_id NOT IN (1, 2, 3)")
def usage_clear(spark, sf_dir):
    return usage.clear(_usage(spark, sf_dir), "node", [1, 2, 3]).agg(F.count("*").alias("n_left"))


@query("SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def pending_embeddings(spark, sf_dir):
    stored = _vectors(spark, sf_dir).withColumn("model", F.lit("m"))
    return store.pending(_chunks(spark, sf_dir), stored, "m").select("chunk_id")


@query(f"SELECT doc_id AS chunk_id, sha256('{text.CHUNKER_VERSION}' || chr(31) || coalesce(text, '')) AS fingerprint FROM documents")
def source_fingerprint(spark, sf_dir):
    return _chunks(spark, sf_dir).select("chunk_id", text.fingerprint(F.coalesce("text", F.lit(""))).alias("fingerprint"))


@query(
    """SELECT fingerprint, CASE WHEN s IS NULL THEN 'created' WHEN d IS NULL THEN 'deleted' ELSE 'kept' END AS action
FROM (SELECT DISTINCT sha256(text) AS fingerprint, 1 AS s FROM documents WHERE lang IN ('en', 'fr'))
FULL JOIN (SELECT DISTINCT sha256(text) AS fingerprint, 1 AS d FROM documents WHERE lang IN ('fr', 'de')) USING (fingerprint)"""
)
def reconcile_actions(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").withColumn("fingerprint", F.sha2("text", 256))
    return store.reconcile(docs.where(F.col("lang").isin("en", "fr")), docs.where(F.col("lang").isin("fr", "de")))


def _project_events(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("project"), F.col("ts").cast("timestamp").alias("ts"))


_SESS = """s AS (SELECT event_id, user_id AS project, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 86400000000 THEN 1 ELSE 0 END AS nw
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
t AS (SELECT event_id, project, ts, CAST(sum(nw) OVER (PARTITION BY project ORDER BY ts, event_id) AS BIGINT) AS session FROM s)"""


@query(f"WITH {_SESS} SELECT event_id, project, session FROM t")
def sessionize(spark, sf_dir):
    return memory.sessionise(_project_events(spark, sf_dir)).select("event_id", "project", "session")


@query(f"WITH {_SESS} SELECT project, session, count(*) AS n_events, min(ts) AS time_start, max(ts) AS time_end FROM t GROUP BY ALL")
def episode_rollup(spark, sf_dir):
    e = memory.episodes(memory.sessionise(_project_events(spark, sf_dir)))
    return e.select("project", "session", "n_events", F.col("time_start").cast("timestamp_ntz").alias("time_start"), F.col("time_end").cast("timestamp_ntz").alias("time_end"))


_DRIFT = """w AS (SELECT user_id AS concept_id, CAST(floor((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 604800000000.0) AS BIGINT) AS idx FROM events),
c AS (SELECT concept_id, idx, count(*) AS support FROM w GROUP BY ALL)"""


@query(f"WITH {_DRIFT} SELECT concept_id, idx, support FROM c")
def drift_windows_support(spark, sf_dir):
    return memory.drift_windows(_project_events(spark, sf_dir).withColumnRenamed("project", "concept_id"), 7.0).select("concept_id", "idx", "support")


@query(
    f"""WITH {_DRIFT}, g AS (SELECT *, coalesce(idx > lag(idx) OVER (PARTITION BY concept_id ORDER BY idx) + 1, false) AS gap FROM c)
SELECT concept_id, count(*) AS n_windows, CAST(sum(support) AS BIGINT) AS support, bool_or(gap) AS relearned FROM g GROUP BY 1"""
)
def drift_relearning(spark, sf_dir):
    rows = memory.relearned(memory.drift_windows(_project_events(spark, sf_dir).withColumnRenamed("project", "concept_id"), 7.0))
    return rows.select("concept_id", "n_windows", "support", "relearned")


_CENT = """p AS (SELECT label, vec_id // 100 AS idx, generate_subscripts(embedding, 1) AS k, unnest(CAST(embedding AS DOUBLE[])) AS x,
   sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings),
m AS (SELECT label, idx, k, avg(x / n) AS v FROM p GROUP BY ALL),
c AS (SELECT label, idx, list(v ORDER BY k) AS v FROM m GROUP BY ALL)"""


@query(
    f"""WITH {_CENT} SELECT label, idx, round(CASE WHEN b IS NULL THEN 0.0 ELSE greatest(0.0, 1 - list_cosine_similarity(v, b)) END, 6) AS drift
FROM (SELECT *, lag(v) OVER (PARTITION BY label ORDER BY idx) AS b FROM c)"""
)
def drift_centroid_metric(spark, sf_dir):
    rows = _vectors(spark, sf_dir).withColumn("idx", F.expr("chunk_id div 100"))
    return memory.drift_metric(rows, ["label"], "idx", "vector").select("label", "idx", F.round("drift", 6).alias("drift"))


@query(
    """WITH r AS (SELECT DISTINCT l_orderkey AS o, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT x.b AS a, y.b AS b, count(*) AS weight FROM r x JOIN r y ON x.o = y.o AND x.b < y.b GROUP BY 1, 2"""
)
def cooccurrence_pairs(spark, sf_dir):
    items = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(_read(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return graph.cooccurrence(items, "l_orderkey", "p_brand")


def _geography(spark, sf_dir):
    """region (3) > nation (2) > customer (1) > order (0)."""
    edge = lambda df, pl, p, cl, c: df.select(F.lit(pl).alias("parent_level"), F.col(p).cast("long").alias("parent_id"), F.lit(cl).alias("child_level"), F.col(c).cast("long").alias("child_id"), F.lit("contains").alias("relation"))
    e = edge(_read(spark, sf_dir, "nation"), 3, "n_regionkey", 2, "n_nationkey")
    e = e.unionByName(edge(_read(spark, sf_dir, "customer"), 2, "c_nationkey", 1, "c_custkey"))
    return e.unionByName(edge(_read(spark, sf_dir, "orders"), 1, "o_custkey", 0, "o_orderkey"))


@query(
    """SELECT r_regionkey AS root_id, count(DISTINCT o_orderkey) AS n_chunks FROM region JOIN nation ON n_regionkey = r_regionkey
JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1"""
)
def closure_region(spark, sf_dir):
    roots = _read(spark, sf_dir, "region").select(F.lit(3).alias("level"), F.col("r_regionkey").cast("long").alias("node_id"))
    chunks = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"))
    found = graph.closure(_geography(spark, sf_dir), roots, chunks, max_depth=3)
    return found.groupBy(F.col("root_id").cast("int").alias("root_id")).agg(F.count("*").alias("n_chunks"))


def _part_edges(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select(F.lit(1).alias("parent_level"), F.col("o_custkey").alias("parent_id"), F.lit(0).alias("child_level"), F.col("o_orderkey").alias("child_id"), F.lit("derived_from").alias("relation"))


@query("SELECT o_custkey AS parent_id, o_orderkey AS child_id FROM orders WHERE o_orderstatus = 'F' OR o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def dangling_edges(spark, sf_dir):
    nodes = _read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("node_id"))
    chunks = _read(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("chunk_id"))
    return graph.dangling_edges(_part_edges(spark, sf_dir), nodes, chunks).select("parent_id", "child_id")


@query()
def leader_clusters(spark, sf_dir):
    rows = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vector"), "label")
    return memory.leader_clusters(rows, 0.3, per="label")


@query(
    f"""WITH {_CENT.replace('vec_id // 100', '0')}, s AS (
  SELECT e.label, e.vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 9) AS cos, count(*) OVER (PARTITION BY e.label) AS n
  FROM embeddings e JOIN c ON e.label = c.label),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cos DESC, vec_id) AS k FROM s)
SELECT label, vec_id AS chunk_id, n AS full_size FROM r WHERE k <= greatest(1, round_even(0.5 * n, 0))"""
)
def distill_core(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return memory.distill_core(rows, 0.5, "label", "chunk_id").select("label", F.explode("core").alias("chunk_id"), "full_size")


@query(
    """WITH u AS (SELECT user_id AS node_id, count(*) AS support, max(ts) AS t FROM events GROUP BY 1),
s AS (SELECT node_id, least(1.0, support / 3.0) AS conf, 1 - pow(0.5, greatest((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(t)) / 86400000000.0, 0) / 30.0) AS stale FROM u)
SELECT node_id, round(conf * stale, 6) AS risk, round(conf, 6) AS confidence FROM s"""
)
def forgetting_risk(spark, sf_dir):
    nodes = _project_events(spark, sf_dir).groupBy(F.col("project").alias("node_id")).agg(F.count("*").alias("support"), F.max("ts").alias("last_touch")).withColumn("centrality", F.lit(None).cast("double"))
    return memory.forgetting_risk(nodes, _now()).select("node_id", F.round("risk", 6).alias("risk"), F.round("confidence", 6).alias("confidence"))


def _messages(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("turn_index"), "role", "text")


@query("SELECT conv_id AS conversation_id, count(*) AS n_messages, CAST(coalesce(max(turn), -1) + 1 AS BIGINT) AS next_turn FROM conversations GROUP BY 1")
def conversation_history(spark, sf_dir):
    m = _messages(spark, sf_dir)
    heads = m.groupBy("conversation_id").agg(F.max("turn_index").alias("updated_at"))
    return conversations.history(heads, m).select("conversation_id", "n_messages", "next_turn")


@query(
    """SELECT u.conv_id AS conversation_id, u.turn AS turn_index, u.text AS question, a.text AS answer
FROM conversations u JOIN (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant') a ON u.conv_id = a.conv_id AND u.turn = a.turn WHERE u.role = 'user'"""
)
def turn_pairs(spark, sf_dir):
    m = _messages(spark, sf_dir).withColumn("turn_index", F.when(F.col("role") == "assistant", F.col("turn_index") - 1).otherwise(F.col("turn_index")))
    return conversations.turn_pairs(m)


@query("SELECT conv_id AS conversation_id, turn AS turn_index FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'user') WHERE n <= 2")
def last_n_turns(spark, sf_dir):
    return conversations.last_turns(_messages(spark, sf_dir).where("role = 'user'"), 2).select("conversation_id", "turn_index")


@query("WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT round(sum(greatest(1, round_even(0.5 * n, 0))) / sum(n), 6) AS ratio FROM n")
def compression_ratio(spark, sf_dir):
    return evaluation.compression_ratio(memory.distill_core(_vectors(spark, sf_dir), 0.5, "label", "chunk_id")).select(F.round("ratio", 6).alias("ratio"))


@query()
def chunk_documents(spark, sf_dir):
    """Overlapping chunks of every document."""
    docs = _read(spark, sf_dir, "documents")
    return chunking.chunk_rows(docs, chunking.text_chunks(F.col("text")), "doc_id")


# The other queries add themselves to the same tables.
from . import changes, memories, questions, texts  # noqa: E402, F401
