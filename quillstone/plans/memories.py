"""Queries over retrieval by level, evaluation, the graph and the views of the memory, beside their SQL.

Benchmark items are the evaluation queries, documents the chunks; events, their users and types the memory above; parts the nodes with titles.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..durable import durable, folder
from ..functions import scores, text
from ..operators import answers, bulk, evaluation, graph, memory, retrieval, usage, views
from .catalog import _AGE, _COS, _TOK, QUERY, SQL_TOKENS, _chunks, _geography, _now, _project_events, _query_vector, _read, _vectors, query

_Q2 = sum(n * n for n in retrieval.query_tokens(QUERY).values())
_WORDS = ", ".join(f"('{t}', {n})" for t, n in sorted(retrieval.query_tokens(QUERY).items()))


def _lexical_sql(rows: str, key: str, column: str) -> str:
    """CTEs that end in ``lx`` (key, lexical) of the texts in ``rows``."""
    return f"""tok AS (SELECT {key} AS k, unnest({SQL_TOKENS.replace('coalesce(text', f'coalesce({column}')}) AS u FROM {rows}), cnt AS (SELECT k, u, count(*) AS n FROM tok GROUP BY ALL), q(u, m) AS (VALUES {_WORDS}),
lx AS (SELECT k, sum(CASE WHEN q.m IS NULL THEN 0 ELSE n * q.m END) / (sqrt(CAST({_Q2} AS DOUBLE)) * sqrt(CAST(sum(n * n) AS DOUBLE))) AS lexical FROM cnt LEFT JOIN q USING (u) GROUP BY 1)"""


_TITLED = "(SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages)"


@query(
    f"""WITH {_lexical_sql(f"(SELECT DISTINCT title FROM {_TITLED})", "title", "title")}
SELECT page_id, round(0.05 * coalesce(lexical, 0), 8) AS boost FROM {_TITLED} p LEFT JOIN lx ON p.title = lx.k"""
)
def title_boost(spark, sf_dir):
    """What the titles of pages add to their scores."""
    pages = _read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))
    boost = retrieval.title_overlap(pages, QUERY)
    return pages.join(boost, "title", "left").select("page_id", F.round(0.05 * F.coalesce("title_score", F.lit(0.0)), 8).alias("boost"))


_BULK = f"""dt AS (SELECT doc_id, unnest({SQL_TOKENS}) AS u FROM documents), dc AS (SELECT doc_id, u, count(*) AS n FROM dt GROUP BY ALL), dn AS (SELECT doc_id, sum(n * n) AS n2 FROM dc GROUP BY 1),
bt AS (SELECT item_id, unnest({SQL_TOKENS}) AS u FROM benchmark), bc AS (SELECT item_id, u, count(*) AS m FROM bt GROUP BY ALL), bn AS (SELECT item_id, sum(m * m) AS m2 FROM bc GROUP BY 1),
sc AS (SELECT item_id, doc_id, sum(n * m) / (sqrt(CAST(any_value(m2) AS DOUBLE)) * sqrt(CAST(any_value(n2) AS DOUBLE))) AS s FROM dc JOIN bc USING (u) JOIN dn USING (doc_id) JOIN bn USING (item_id) GROUP BY ALL),
rk AS (SELECT item_id, doc_id, s, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, doc_id) AS r FROM sc)"""


def _asked(spark, sf_dir):
    """Every benchmark item as a question, with the vector of its number."""
    items = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return items.join(_vectors(spark, sf_dir).select(F.col("chunk_id").alias("query_id"), "vector"), "query_id", "left")


def _bulk(spark, sf_dir, top: int):
    """query_id, chunk_id, lexical, rank: the best documents of every benchmark item, all in one pass."""
    items = _asked(spark, sf_dir).withColumn("vector", F.lit(None).cast("array<float>"))
    found = bulk.scan(_chunks(spark, sf_dir).select("chunk_id", "text"), items, top, (0.0, 1.0, 0.0))
    return bulk.ranked(found).select("query_id", "chunk_id", "lexical", "rank")


def _windows(rows, key: str, column: str, size: int = 12):
    """``key``, window: hashes of all runs of ``size`` tokens; of fewer tokens, none."""
    tokens = text.tokenize(F.col(column))
    runs = lambda t: F.when(F.size(t) >= size, F.transform(F.sequence(F.lit(1), F.size(t) - (size - 1)), lambda i: F.xxhash64(F.slice(t, i, size))))
    return rows.select(key, F.explode(F.array_distinct(text.once(tokens, runs))).alias("window"))


def _gold(spark, sf_dir):
    """query_id, uri: documents that share a run of twelve tokens with a benchmark item."""
    items = _windows(_read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), "query_id", "text")
    docs = _windows(_read(spark, sf_dir, "documents").select(F.col("doc_id").alias("uri"), "text"), "uri", "text")
    return durable(docs.join(items, "window").select("query_id", "uri").distinct())


_WINDOWS = "SELECT DISTINCT {1} AS {2}, array_to_string(t[i : i + 11], ' ') AS run FROM (SELECT {1}, t, unnest(range(1, len(t) - 10)) AS i FROM (SELECT {1}, {3} AS t FROM {0}))"
_GOLD = f"""wi AS ({_WINDOWS.format('benchmark', 'item_id', 'query_id', SQL_TOKENS)}), wd AS ({_WINDOWS.format('documents', 'doc_id', 'uri', SQL_TOKENS)}),
gold AS (SELECT DISTINCT query_id, uri FROM wi JOIN wd USING (run))"""
_METRICS = """SELECT count(*) AS n_queries, round(avg(CASE WHEN rank <= {0} THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS citation_hit_rate,
count(*) FILTER (WHERE rank IS NULL OR rank > {0}) AS misses FROM f"""


def _metrics(first_ranks, top_k: int):
    m = evaluation.retrieval_metrics(first_ranks, top_k)
    return m.select("n_queries", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "citation_hit_rate")], "misses")


@query(f"WITH {_BULK} SELECT item_id AS query_id, doc_id AS chunk_id, round(s, 6) AS lexical, CAST(r AS INTEGER) AS rank FROM rk WHERE r <= 10")
def lexical_bulk(spark, sf_dir):
    """The ten best documents of all benchmark items."""
    return _bulk(spark, sf_dir, 10).select("query_id", "chunk_id", F.round("lexical", 6).alias("lexical"), "rank")


@query(f"WITH {_BULK}, {_GOLD}, f AS (SELECT query_id, min(r) AS rank FROM gold LEFT JOIN rk ON rk.item_id = query_id AND rk.doc_id = uri GROUP BY 1) {_METRICS.format(5)}")
def eval_recall_mrr(spark, sf_dir):
    """Retrieval by words of every benchmark item that a document quotes; the rank of the first quoting document counts however deep it is."""
    chunks, gold = _chunks(spark, sf_dir).select("chunk_id", "text"), _gold(spark, sf_dir)
    asked = _asked(spark, sf_dir).withColumn("vector", F.lit(None).cast("array<float>"))
    return _metrics(bulk.first_ranks(chunks, asked, gold, (0.0, 1.0, 0.0)), 5)


@query("SELECT item_id FROM benchmark WHERE lower(text) LIKE 'th%_e%'")
def eval_prefix(spark, sf_dir):
    """Evaluation queries of a prefix with wildcards."""
    queries = _read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query_text"))
    return evaluation.with_prefix(queries, "TH%_e").select("item_id")


@query(
    f"""WITH {_BULK}, o AS (SELECT row_number() OVER (PARTITION BY item_id ORDER BY r, source) AS k, item_id, source FROM (SELECT item_id, source, min(r) AS r FROM rk JOIN documents USING (doc_id) WHERE r <= 10 GROUP BY ALL))
SELECT item_id AS query_id, source AS uri, CAST(k AS INTEGER) AS rank FROM o"""
)
def unique_uris(spark, sf_dir):
    """The sources of every item's best documents, each where it comes first."""
    source = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("uri"))
    return evaluation.unique_uris(_bulk(spark, sf_dir, 10).join(source, "chunk_id").select("query_id", "uri", "rank"))


@query(f"WITH {_BULK}, t AS (SELECT item_id, max(s) AS s FROM sc GROUP BY 1) SELECT b.item_id AS query_id, coalesce(t.s, 0) < 0.15 AS abstained FROM benchmark b LEFT JOIN t USING (item_id)")
def evidence_gate(spark, sf_dir):
    """Which benchmark items are refused for weak evidence."""
    queries = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    hits = _bulk(spark, sf_dir, 1).withColumnRenamed("lexical", "score")
    return answers.gates(queries, hits).select("query_id", "abstained")


_CLAIMS = "concat('[E', turn % 4, '] and [E2]')"


@query(
    """WITH a AS (SELECT conv_id, turn, [turn % 4, 2] AS c, conv_id % 5 = 0 AS abstained, CASE WHEN conv_id % 3 = 0 THEN [] ELSE ['/u1', '/u2', '/u' || (turn % 4)] END AS gold FROM conversations),
u AS (SELECT *, list_transform(list_filter(list_distinct(c), lambda e: e BETWEEN 1 AND 2), lambda e: '/u' || e) AS cited FROM a),
v AS (SELECT *, len(gold) > 0 AS able, CASE WHEN abstained OR len(gold) = 0 THEN 0 ELSE len(list_intersect(cited, gold)) END AS hit, abstained OR len(list_filter(c, lambda e: e NOT BETWEEN 1 AND 2)) = 0 AS valid FROM u)
SELECT count(*) AS n_queries, round(avg(CAST(valid AS INT)), 6) AS citation_validity, round(count(*) FILTER (WHERE hit > 0) / greatest(count(*) FILTER (WHERE able), 1), 6) AS grounding,
round(coalesce(sum(hit / len(list_distinct(gold))) FILTER (WHERE able), 0) / greatest(count(*) FILTER (WHERE able), 1), 6) AS coverage, round(avg(CAST(abstained <> able AS INT)), 6) AS abstention_accuracy FROM v"""
)
def generation_metrics(spark, sf_dir):
    """Citation validity, grounding, coverage and abstention of answers with two pieces of evidence."""
    rows = _read(spark, sf_dir, "conversations")
    last = F.concat(F.lit("/u"), (F.col("turn") % 4).cast("string"))
    gold = F.when(F.col("conv_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("/u1"), F.lit("/u2"), last))
    from ..functions import text

    cited = text.citations(F.expr(_CLAIMS))
    uris = F.transform(text.split_citations(cited, F.lit(2))["valid"], lambda e: F.concat(F.lit("/u"), e.cast("string")))
    made = rows.select(cited.alias("cited"), F.lit(2).alias("n_evidence"), uris.alias("cited_uris"), gold.alias("gold_uris"), (F.col("conv_id") % 5 == 0).alias("abstained"))
    m = evaluation.generation_metrics(made)
    return m.select("n_queries", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


_UA = """u AS (SELECT user_id AS doc_id, sum((CASE event_type WHEN 'click' THEN 2.0 WHEN 'purchase' THEN 3.0 ELSE 1.0 END) * pow(0.5, greatest((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000.0, 0) / 30.0)) AS x FROM events GROUP BY 1)"""


@query(
    f"""WITH {_TOK}, {_UA}, v AS (SELECT vec_id AS doc_id, {_COS} AS cosine FROM embeddings ORDER BY 2 DESC, 1 LIMIT 100),
s AS (SELECT d.doc_id, cosine, coalesce(lexical, 0) AS lexical, {_AGE.replace('doc_id', 'd.doc_id')} AS age, CASE WHEN x > 0 THEN x / (x + 3) ELSE 0 END AS used
      FROM documents d LEFT JOIN v ON d.doc_id = v.doc_id LEFT JOIN lx ON d.doc_id = lx.doc_id LEFT JOIN u ON d.doc_id = u.doc_id WHERE cosine IS NOT NULL OR lexical > 0)
SELECT doc_id AS chunk_id, round(0.55 * coalesce((cosine + 1) / 2, 0) + 0.25 * lexical + 0.05 * exp(-age / 45.0) + 0.15 * used, 6) AS score FROM s"""
)
def hybrid_usage(spark, sf_dir):
    """The hybrid score of the profile that counts use."""
    weight = scores.event_weight(None, F.when(F.col("event_type") == "click", "open").when(F.col("event_type") == "purchase", "accepted_answer").otherwise("retrieval_hit"))
    log = _read(spark, sf_dir, "events").select(F.lit("chunk").alias("target_kind"), F.col("user_id").alias("target_id"), weight.alias("weight"), F.col("ts").cast("timestamp").alias("event_at"))
    found = retrieval.hybrid_scores(_chunks(spark, sf_dir), _vectors(spark, sf_dir).select("chunk_id", "vector"), QUERY, _query_vector(spark, sf_dir), _now(), "usage", top_k=10, usage=usage.summary(log, _now()))
    return found.select("chunk_id", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_TOK}, v AS (SELECT vec_id AS doc_id, {_COS} AS cosine FROM embeddings ORDER BY 2 DESC, 1 LIMIT 100),
s AS (SELECT d.doc_id, cosine, coalesce(lexical, 0) AS lexical, {_AGE.replace('doc_id', 'd.doc_id')} AS age FROM documents d LEFT JOIN v ON d.doc_id = v.doc_id LEFT JOIN lx ON d.doc_id = lx.doc_id
      WHERE (cosine IS NOT NULL OR lexical > 0) AND d.lang IN ('en', 'fr') AND d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))
SELECT doc_id AS chunk_id, round(0.35 * coalesce((cosine + 1) / 2, 0) + 0.20 * lexical + 0.45 * exp(-age / 45.0), 6) AS score FROM s"""
)
def hybrid_restricted(spark, sf_dir):
    """The hybrid score among some sources' chunks only; the vector pool is cut before."""
    chunks = _chunks(spark, sf_dir).join(_read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("source_type")), "chunk_id")
    ids = _read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("chunk_id"))
    found = retrieval.hybrid_scores(chunks, _vectors(spark, sf_dir).select("chunk_id", "vector"), QUERY, _query_vector(spark, sf_dir), _now(), "recent", top_k=10, restrict_ids=ids, source_types=["en", "fr"])
    return found.select("chunk_id", F.round("score", 6).alias("score"))


def _nodes(spark, sf_dir):
    """Every document as a concept."""
    docs = _chunks(spark, sf_dir).select(F.col("chunk_id").alias("node_id"), F.col("text").alias("content"), F.col("ts").alias("time_start"))
    lang = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), F.col("lang").alias("title"))
    return docs.join(lang, "node_id").withColumn("centrality", (F.col("node_id") % 10) / 10.0).withColumn("level", F.lit(3)).withColumn("node_type", F.lit("concept"))


_NODE_SQL = f"""WITH {_lexical_sql("(SELECT doc_id, coalesce(lang, '') || ' ' || coalesce(text, '') AS t FROM documents)", "doc_id", "t")}, v AS (SELECT vec_id AS doc_id, {_COS} AS cosine FROM embeddings),
s AS (SELECT d.doc_id, source, cosine, coalesce(lexical, 0) AS lexical, {_AGE.replace('doc_id', 'd.doc_id')} AS age FROM documents d LEFT JOIN v ON d.doc_id = v.doc_id LEFT JOIN lx ON d.doc_id = lx.k WHERE cosine IS NOT NULL OR lexical > 0),
n AS (SELECT doc_id, source, 0.55 * coalesce((cosine + 1) / 2, 0) + 0.25 * lexical + 0.10 * exp(-age / 45.0) + 0.10 * ((doc_id % 10) / 10.0) AS score FROM s)"""


@query(f"{_NODE_SQL} SELECT doc_id AS node_id, round(score, 6) AS score FROM n ORDER BY n.score DESC, doc_id DESC LIMIT 20")
def node_retrieve(spark, sf_dir):
    """The best nodes by vector, words, recency and centrality."""
    vecs = _vectors(spark, sf_dir).select(F.col("chunk_id").alias("node_id"), "vector")
    scored = retrieval.node_scores(retrieval.level_nodes(_nodes(spark, sf_dir), "concept"), vecs, QUERY, _query_vector(spark, sf_dir), _now())
    return retrieval.top_nodes(scored, 20).select("node_id", F.round("score", 6).alias("score"))


@query(f"{_NODE_SQL}, t AS (SELECT source, row_number() OVER (ORDER BY score DESC, doc_id DESC) AS r FROM n QUALIFY r <= 20) SELECT source AS uri, CAST(row_number() OVER (ORDER BY min(r), source) AS INTEGER) AS rank FROM t GROUP BY source")
def drill_down_uris(spark, sf_dir):
    """The sources below the best nodes, in order of the nodes."""
    vecs = _vectors(spark, sf_dir).select(F.col("chunk_id").alias("node_id"), "vector")
    hits = retrieval.top_nodes(retrieval.node_scores(_nodes(spark, sf_dir), vecs, QUERY, _query_vector(spark, sf_dir), _now()), 20)
    docs = _read(spark, sf_dir, "documents")
    evidence = docs.select(F.col("doc_id").alias("node_id"), F.col("doc_id").alias("chunk_id"))
    return retrieval.drill_down(hits, evidence, docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_uri")))


@query(
    f"""WITH {_lexical_sql("benchmark", "item_id", "text")}, v AS (SELECT vec_id AS k, {_COS} AS cosine FROM embeddings),
s AS (SELECT item_id, cosine, coalesce(lexical, 0) AS lexical FROM benchmark LEFT JOIN v ON v.k = item_id LEFT JOIN lx ON lx.k = item_id WHERE cosine IS NOT NULL OR lexical > 0)
SELECT item_id AS node_id, round(0.70 * coalesce((cosine + 1) / 2, 0) + 0.20 * lexical + 0.05 * ((item_id % 10) / 10.0), 6) AS score FROM s"""
)
def distilled_retrieve(spark, sf_dir):
    """Benchmark items as summaries of distilled nodes, scored by summary, vector and centrality."""
    items = _read(spark, sf_dir, "benchmark")
    vecs = _vectors(spark, sf_dir).select(F.col("chunk_id").alias("node_id"), "vector")
    distilled = items.select(F.col("item_id").alias("node_id"), F.col("text").alias("summary"), F.lit("m").alias("model")).join(vecs, "node_id", "left")
    nodes = items.select(F.col("item_id").alias("node_id"), F.lit(None).cast("timestamp").alias("time_start"), ((F.col("item_id") % 10) / 10.0).alias("centrality"))
    found = retrieval.distilled_scores(distilled, nodes, QUERY, _query_vector(spark, sf_dir), _now(), "m", "relevant")
    return found.select("node_id", F.round("score", 6).alias("score"))


_PR = """l AS (SELECT 'u:' || user_id AS a, 't:' || event_type AS b, CAST(count(*) AS DOUBLE) AS w FROM events GROUP BY ALL), e AS (SELECT a AS src, b AS dst, w FROM l UNION ALL SELECT b, a, w FROM l),
o AS (SELECT src, sum(w) AS t FROM e GROUP BY 1), h AS (SELECT e.src, dst, w / t AS s FROM e JOIN o USING (src)), c AS (SELECT (SELECT count(*) FROM o) + (SELECT count(*) FROM region) AS n),
r AS (SELECT 0 AS i, src AS node, 1.0 / n AS x, 5.0 / n AS lost, 1.0 / n AS z FROM o, c
  UNION ALL SELECT i + 1, dst, 0.15 / any_value(n) + 0.85 * any_value(lost) / any_value(n) + 0.85 * sum(x * s), 5 * (0.15 / any_value(n) + 0.85 * any_value(lost) / any_value(n)), 0.15 / any_value(n) + 0.85 * any_value(lost) / any_value(n)
  FROM r JOIN h ON h.src = r.node, c WHERE i < 50 GROUP BY i, dst)"""


@query(
    f"""WITH RECURSIVE {_PR}, f AS (SELECT node, x FROM r WHERE i = 50 UNION ALL SELECT 'r:' || r_regionkey, (SELECT any_value(z) FROM r WHERE i = 50) FROM region)
SELECT node AS node_id, round(x / (SELECT max(x) FROM f), 6) AS centrality FROM f"""
)
def pagerank(spark, sf_dir):
    """Fifty rounds over users and types of events, with regions as nodes that nothing leads to."""
    links = _read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("weight"))
    edges = links.select(F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("a"), F.concat(F.lit("t:"), "event_type").alias("b"), "weight")
    alone = _read(spark, sf_dir, "region").select(F.concat(F.lit("r:"), F.col("r_regionkey").cast("string")).alias("node_id"))
    nodes = edges.select(F.col("a").alias("node_id")).union(edges.select("b")).union(alone)
    return graph.pagerank(nodes, edges).select("node_id", F.round("centrality", 6).alias("centrality"))


@query("SELECT c_custkey AS node_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def unsupported_nodes(spark, sf_dir):
    """Customers without a fulfilled order, as nodes without evidence."""
    nodes = _read(spark, sf_dir, "customer").select(F.lit(1).alias("level"), F.col("c_custkey").alias("node_id"))
    orders = _read(spark, sf_dir, "orders")
    edges = orders.select(F.lit(1).alias("parent_level"), F.col("o_custkey").alias("parent_id"), F.lit(0).alias("child_level"), F.col("o_orderkey").alias("child_id"), F.lit("derived_from").alias("relation"))
    return graph.unsupported_nodes(nodes, edges, orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("chunk_id"))).select("node_id")


@query(
    """SELECT 'above' AS side, CAST(n_regionkey AS BIGINT) AS id, CAST(n_nationkey AS BIGINT) AS of_id FROM nation UNION ALL SELECT 'below', c_custkey, c_nationkey FROM customer"""
)
def parents_children(spark, sf_dir):
    """What stands above and below all nations."""
    edges = _geography(spark, sf_dir)
    nations = _read(spark, sf_dir, "nation").select(F.lit(2).alias("level"), F.col("n_nationkey").cast("long").alias("node_id"))
    above = graph.parents(edges, nations).select(F.lit("above").alias("side"), F.col("parent_id").alias("id"), F.col("child_id").alias("of_id"))
    return above.unionByName(graph.children(edges, nations, "contains").select(F.lit("below").alias("side"), F.col("child_id").alias("id"), F.col("parent_id").alias("of_id")))


def _held(spark, sf_dir):
    """Events held by concepts (their k) and episodes (their users)."""
    rows = _read(spark, sf_dir, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    edge = lambda level, parent: rows.select(F.lit(level).alias("parent_level"), F.col(parent).alias("parent_id"), F.lit(1).alias("child_level"), F.col("event_id").alias("child_id"), F.lit("contains").alias("relation"))
    return edge(3, "k").unionByName(edge(2, "user_id")).withColumn("weight", F.lit(1.0))


@query(
    """WITH p AS (SELECT DISTINCT user_id AS e, CAST(json_extract(props, '$.k') AS BIGINT) AS c FROM events)
SELECT x.c AS parent_id, y.c AS child_id, CAST(count(*) AS DOUBLE) AS weight FROM p x JOIN p y ON x.e = y.e AND x.c < y.c GROUP BY 1, 2"""
)
def concept_links(spark, sf_dir):
    """Relations between concepts that share episodes; relations from before are gone."""
    old = _held(spark, sf_dir).limit(1).select("parent_level", F.lit(-1).cast("long").alias("parent_id"), F.lit(3).alias("child_level"), F.lit(-2).cast("long").alias("child_id"), F.lit("relates_to").alias("relation"), "weight")
    return graph.concept_links(_held(spark, sf_dir).unionByName(old)).where("relation = 'relates_to'").select("parent_id", "child_id", "weight")


_DEAD = "o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')"


@query(
    """WITH hurt AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P'), src AS (SELECT c_custkey, c_nationkey FROM customer),
live AS (SELECT s_suppkey + 10000000 AS chunk, s_nationkey FROM supplier), ok AS (SELECT h.o_custkey FROM hurt h JOIN src ON src.c_custkey = h.o_custkey WHERE c_nationkey IN (SELECT s_nationkey FROM live))
SELECT o_custkey AS parent_id, o_orderkey AS child_id FROM orders WHERE o_orderstatus <> 'P' OR o_custkey NOT IN (SELECT o_custkey FROM ok)
UNION SELECT o_custkey, chunk FROM ok JOIN src ON src.c_custkey = ok.o_custkey JOIN live ON live.s_nationkey = src.c_nationkey"""
)
def reanchor(spark, sf_dir):
    """Customers as events whose pending orders are dead chunks: they are tied to the chunks (suppliers) of their source (nation)."""
    orders = _read(spark, sf_dir, "orders")
    # Order keys reach the suppliers' numbers in large tables: below 0, a pending order's is no live chunk's.
    key = F.when(F.col("o_orderstatus") == "P", -1 - F.col("o_orderkey")).otherwise(F.col("o_orderkey"))
    edges = orders.select(F.lit(1).alias("parent_level"), F.col("o_custkey").alias("parent_id"), F.lit(0).alias("child_level"), key.alias("child_id"), F.lit("derived_from").alias("relation"))
    old = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("chunk_id"), F.lit(None).cast("bigint").alias("source_id"))
    chunks = _read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 10000000).alias("chunk_id"), F.col("s_nationkey").cast("bigint").alias("source_id"))
    events = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_nationkey").cast("bigint").alias("source_id"))
    child = F.col("child_id")
    return graph.reanchor(edges, events, old.unionByName(chunks)).select("parent_id", F.when(child < 0, -1 - child).otherwise(child).alias("child_id"))


def _users(spark, sf_dir):
    """Users as concepts, some of them ranked."""
    rows = _project_events(spark, sf_dir).groupBy(F.col("project").alias("node_id")).agg(F.min("ts").alias("time_start"), F.max("ts").alias("time_end"))
    title = F.concat(F.lit("user "), F.col("node_id").cast("string"))
    return rows.select("node_id", F.lit(3).alias("level"), F.lit("concept").alias("node_type"), title.alias("title"), "time_start", "time_end", F.when(F.col("node_id") % 3 == 0, (F.col("node_id") % 7) / 7.0).alias("centrality"))


def _user_evidence(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    evidence = e.select(F.col("user_id").alias("root_id"), F.col("event_id").alias("chunk_id"))
    return evidence, e.select(F.col("event_id").alias("chunk_id"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("/"), "event_type").alias("source_uri"), F.col("props").alias("text"))


_RISK = """n AS (SELECT user_id AS node_id, count(*) AS support, max(ts) AS t, CASE WHEN user_id % 3 = 0 THEN (user_id % 7) / 7.0 END AS cen FROM events GROUP BY 1),
w AS (SELECT n.*, greatest(t, CASE WHEN p_size IS NULL THEN t ELSE TIMESTAMP '2024-01-20' + to_days(CAST(p_size AS INTEGER) % 15) END) AS touch FROM n LEFT JOIN part ON p_partkey = node_id),
r AS (SELECT *, coalesce(cen, least(1.0, support / 3.0)) AS imp, 1 - pow(0.5, greatest((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(touch)) / 86400000000.0, 0) / 30.0) AS stale FROM w)"""


def _risks(spark, sf_dir, top=None):
    evidence, chunks = _user_evidence(spark, sf_dir)
    used = F.expr("timestampadd(DAY, cast(p_size as int) % 15, timestamp'2024-01-20')")
    log = _read(spark, sf_dir, "part").select(F.lit("node").alias("target_kind"), F.col("p_partkey").alias("target_id"), used.alias("last_event_at"))
    return views.forgetting(_users(spark, sf_dir), evidence, chunks, _now(), log, top=top)


@query(
    f"""WITH {_RISK} SELECT node_id, support, round(imp, 6) AS importance, round(stale, 6) AS staleness, round(imp * stale, 6) AS risk, touch AS last_touch,
(SELECT string_agg(DISTINCT '/' || event_type, ',' ORDER BY '/' || event_type) FROM (SELECT DISTINCT event_type, user_id FROM events) e WHERE e.user_id = r.node_id AND event_type IN (SELECT event_type FROM (SELECT DISTINCT event_type FROM events x WHERE x.user_id = r.node_id) ORDER BY 1 LIMIT 3)) AS uris FROM r"""
)
def forgetting_view(spark, sf_dir):
    """Every user's risk of being forgotten, from use, span and sources' times."""
    rows = _risks(spark, sf_dir)
    return rows.select(
        "node_id", "support", *[F.round(c, 6).alias(c) for c in ("importance", "staleness", "risk")], F.col("last_touch").cast("timestamp_ntz").alias("last_touch"), F.array_join("evidence_source_uris", ",").alias("uris")
    )


@query(
    f"""WITH {_RISK}, x AS (SELECT node_id FROM r ORDER BY imp * stale DESC, least(1.0, support / 3.0) DESC, node_id LIMIT 10),
p AS (SELECT user_id, left(string_agg(props, chr(10) || chr(10) ORDER BY event_id), 4000) AS t FROM events GROUP BY 1), f AS (SELECT user_id, t, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS c FROM p)
SELECT node_id, 'What do you remember about: user ' || node_id || '?' AS question, CASE WHEN length(c) > 220 THEN rtrim(left(c, 220)) || '…' ELSE c END AS answer, sha256('1' || chr(31) || 'user ' || node_id || chr(31) || t) AS fingerprint,
'fallback' AS generated_by FROM x JOIN f ON f.user_id = node_id"""
)
def recall_cards(spark, sf_dir):
    """Cards for the ten riskiest users."""
    evidence, chunks = _user_evidence(spark, sf_dir)
    return views.recall_cards(_risks(spark, sf_dir, 10), evidence, chunks).select("node_id", "question", "answer", "fingerprint", "generated_by")


@query(
    f"""WITH {_RISK}, x AS (SELECT node_id FROM r ORDER BY imp * stale DESC, least(1.0, support / 3.0) DESC, node_id LIMIT 30),
p AS (SELECT user_id, left(string_agg(props, chr(10) || chr(10) ORDER BY event_id), 4000) AS t FROM events GROUP BY 1), f AS (SELECT user_id, t, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS c FROM p)
SELECT node_id, CASE WHEN node_id % 2 = 0 THEN 'Who is user ' || node_id ELSE 'What do you remember about: user ' || node_id || '?' END AS question,
CASE WHEN node_id % 2 = 0 THEN CAST(length(t) AS VARCHAR) WHEN length(c) > 220 THEN rtrim(left(c, 220)) || '…' ELSE c END AS answer, CASE WHEN node_id % 2 = 0 THEN 'llm' ELSE 'fallback' END AS generated_by FROM x JOIN f ON f.user_id = node_id"""
)
def cards_kept(spark, sf_dir):
    """Cards of the thirty riskiest users out of the kept table, after the evidence of every other user changed; only theirs are made again, without a model."""
    evidence, chunks = _user_evidence(spark, sf_dir)
    users, risks, root = _users(spark, sf_dir), durable(_risks(spark, sf_dir, 30)), folder(spark, "cards")
    before = chunks.join(evidence, "chunk_id").withColumn("text", F.when(F.col("root_id") % 2 == 1, F.concat(F.lit("old "), "text")).otherwise(F.col("text"))).drop("root_id")
    asked = lambda title, said: F.struct(F.concat(F.lit("Who is "), title).alias("question"), F.length(said).cast("string").alias("answer"))
    views.keep_cards(spark, root, risks, evidence, before, users, asked)
    views.keep_cards(spark, root, risks, evidence, chunks, users)
    return views.read_cards(spark, root).select("node_id", "question", "answer", "generated_by")


@query(
    """WITH k AS (SELECT user_id AS node_id, count(*) AS full_count, count(*) FILTER (WHERE event_type = 'click') AS core_count, min(event_id) FILTER (WHERE event_type = 'click') AS f FROM events GROUP BY 1)
SELECT node_id, 'user ' || node_id AS title, core_count, full_count, round(core_count / full_count, 6) AS compression_ratio, CASE WHEN f IS NULL THEN NULL ELSE '/click' END AS evidence_source_uri FROM k"""
)
def distilled_view(spark, sf_dir):
    """Users distilled to their clicks."""
    evidence, chunks = _user_evidence(spark, sf_dir)
    core = _read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.when(F.col("event_type") == "click", F.col("event_id")))).alias("core"))
    distilled = core.select("node_id", F.lit(3).alias("level"), F.lit("s").alias("summary"), "core", F.lit(1.0).alias("confidence"))
    found = views.distilled_view(distilled, _users(spark, sf_dir), evidence, chunks)
    return found.select("node_id", "title", "core_count", "full_count", F.round("compression_ratio", 6).alias("compression_ratio"), "evidence_source_uri")


@query(
    """WITH z AS (SELECT user_id, min(ts) AS t0 FROM events GROUP BY 1), i AS (SELECT e.user_id, t0, CAST(floor((epoch_us(ts) - epoch_us(t0)) / 259200000000.0) AS BIGINT) AS idx FROM events e JOIN z USING (user_id)),
w AS (SELECT user_id, idx, any_value(t0) AS t0, count(*) AS support, (idx % 5) / 5.0 AS drift FROM i GROUP BY user_id, idx), g AS (SELECT *, coalesce(idx > lag(idx) OVER (PARTITION BY user_id ORDER BY idx) + 1, false) AS gap FROM w)
SELECT user_id AS concept_id, 'user ' || user_id AS title, round(max(drift), 6) AS overall_drift, count(*) AS window_count, CAST(sum(support) AS BIGINT) AS support, bool_or(gap) AS relearning, min(t0 + to_days(CAST(3 * idx AS INTEGER))) AS span_start,
max(t0 + to_days(CAST(3 * idx + 3 AS INTEGER))) AS span_end, string_agg(support, ',' ORDER BY idx) AS supports FROM g GROUP BY user_id"""
)
def drift_view(spark, sf_dir):
    """How users moved, in windows of three days."""
    evidence, chunks = _user_evidence(spark, sf_dir)
    windows = memory.drift_windows(_project_events(spark, sf_dir).withColumnRenamed("project", "concept_id"), 3.0).withColumn("drift", (F.col("idx") % 5) / 5.0)
    found = views.drift_view(windows, _users(spark, sf_dir), evidence, chunks)
    supports = F.array_join(F.transform("windows", lambda w: w["support"].cast("string")), ",")
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return found.select("concept_id", "title", F.round("overall_drift", 6).alias("overall_drift"), "window_count", "support", "relearning", ntz("span_start"), ntz("span_end"), supports.alias("supports"))


def _episodes(spark, sf_dir):
    """(episodes as nodes, their edges to events); an episode's id is made of its user and session, the first of each is undated."""
    s = memory.sessionise(_project_events(spark, sf_dir)).withColumn("node_id", F.col("project") * 1000 + F.col("session"))
    time = F.when(F.col("session") > 0, F.min("ts"))
    nodes = s.groupBy("node_id", "session").agg(time.alias("time_start"), F.max("ts").alias("time_end")).select("node_id", F.lit(2).alias("level"), F.lit("episode").alias("node_type"), F.concat(F.lit("e"), F.col("node_id").cast("string")).alias("title"), "time_start", "time_end")
    edges = s.select(F.lit(2).alias("parent_level"), F.col("node_id").alias("parent_id"), F.lit(1).alias("child_level"), F.col("event_id").alias("child_id"), F.lit("contains").alias("relation"))
    return nodes, edges.where("child_id % 2 = 0")


_SESS = """s AS (SELECT event_id, user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 86400000000 THEN 1 ELSE 0 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
t AS (SELECT event_id, user_id, ts, CAST(sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM s)"""


@query(
    f"""WITH {_SESS}, n AS (SELECT user_id * 1000 + session AS node_id, CASE WHEN session > 0 THEN min(ts) END AS time_start, max(ts) AS time_end, count(*) FILTER (WHERE event_id % 2 = 0) AS members FROM t GROUP BY user_id, session)
SELECT node_id, 'e' || node_id AS title, time_start, time_end, members FROM n ORDER BY time_start ASC NULLS LAST, node_id LIMIT 50"""
)
def timeline(spark, sf_dir):
    """The fifty oldest episodes; some of their events are held by none."""
    rows = views.timeline(*_episodes(spark, sf_dir))
    return rows.select("node_id", "title", F.col("time_start").cast("timestamp_ntz").alias("time_start"), F.col("time_end").cast("timestamp_ntz").alias("time_end"), "members")


@query(
    """WITH n AS (SELECT user_id AS node_id, count(*) AS members, CASE WHEN user_id % 3 = 0 THEN (user_id % 7) / 7.0 END AS c FROM events GROUP BY 1)
SELECT node_id, 'user ' || node_id AS title, round(coalesce(c, 0), 6) AS centrality, members FROM n ORDER BY c DESC NULLS LAST, node_id LIMIT 60"""
)
def concept_browse(spark, sf_dir):
    """The sixty most central users with the number of their events."""
    e = _read(spark, sf_dir, "events")
    edges = e.select(F.lit(3).alias("parent_level"), F.col("user_id").alias("parent_id"), F.lit(1).alias("child_level"), F.col("event_id").alias("child_id"), F.lit("contains").alias("relation"))
    return views.concepts(_users(spark, sf_dir), edges, 60).withColumn("centrality", F.round("centrality", 6))


@query("SELECT user_id AS node_id, round((user_id % 7) / 7.0, 6) AS centrality FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 3 = 0) ORDER BY (user_id % 7) / 7.0 DESC, user_id LIMIT 3")
def top_central(spark, sf_dir):
    return views.top_central(_users(spark, sf_dir)).select("node_id", F.round("centrality", 6).alias("centrality"))


_NEAR = """p AS (SELECT label, generate_subscripts(embedding, 1) AS k, unnest(CAST(embedding AS DOUBLE[])) AS x, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings),
m AS (SELECT label, k, avg(x / n) AS v FROM p GROUP BY ALL), c AS (SELECT label, list(v ORDER BY k) AS v FROM m GROUP BY ALL),
r AS (SELECT e.label, vec_id, row_number() OVER (PARTITION BY e.label ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 9) DESC, vec_id) AS place,
CASE WHEN vec_id % 5 = 0 THEN ' ' WHEN vec_id % 2 = 0 THEN 'Topic ' || (vec_id % 13) ELSE 'topic ' || (vec_id % 13) END AS title FROM embeddings e JOIN c USING (label))"""


def _clustered(spark, sf_dir):
    title = F.when(F.col("chunk_id") % 5 == 0, " ").when(F.col("chunk_id") % 2 == 0, F.concat(F.lit("Topic "), (F.col("chunk_id") % 13).cast("string"))).otherwise(F.concat(F.lit("topic "), (F.col("chunk_id") % 13).cast("string")))
    return _vectors(spark, sf_dir).select(F.col("label").alias("cluster"), F.col("chunk_id").alias("node_id"), "vector", title.alias("title"))


@query(f"WITH {_NEAR} SELECT label AS cluster, vec_id AS node_id, CAST(place AS INTEGER) AS place FROM r")
def central_ranks(spark, sf_dir):
    """The members of every cluster, the most central first."""
    return memory.central_ranks(_clustered(spark, sf_dir)).select("cluster", "node_id", "place")


@query(
    f"""WITH {_NEAR}, o AS (SELECT label, trim(title) AS t, place FROM r WHERE trim(title) <> '' QUALIFY row_number() OVER (PARTITION BY label, lower(trim(title)) ORDER BY place) = 1),
f AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY place) AS k FROM o) SELECT label AS cluster, string_agg(t, '|' ORDER BY k) AS titles FROM f WHERE k <= 8 GROUP BY 1"""
)
def representative_titles(spark, sf_dir):
    """The eight titles that stand for every cluster."""
    found = memory.representative_titles(memory.central_ranks(_clustered(spark, sf_dir)))
    return found.select("cluster", F.array_join("titles", "|").alias("titles"))


@query(
    f"""WITH {_SESS}, g AS (SELECT t.user_id, session, count(*) AS n, min(t.ts) AS a, max(t.ts) AS b, list(event_type ORDER BY t.ts, event_id) AS names, string_agg(event_id, ',' ORDER BY event_id) AS ids FROM t JOIN events USING (event_id) GROUP BY t.user_id, session)
SELECT user_id AS project, session, user_id || ': ' || n || CASE WHEN n = 1 THEN ' event, ' ELSE ' events, ' END || CASE WHEN CAST(a AS DATE) = CAST(b AS DATE) THEN strftime(a, '%Y-%m-%d') ELSE strftime(a, '%Y-%m-%d') || '..' || strftime(b, '%Y-%m-%d') END AS title,
array_to_string(names[1:8], '; ') || CASE WHEN n > 8 THEN '; … (+' || (n - 8) || ' more)' ELSE '' END AS content, sha256('1' || chr(31) || '86400' || chr(31) || user_id || chr(31) || ids) AS fingerprint FROM g"""
)
def episode_nodes(spark, sf_dir):
    """Episodes as nodes: title, content and what they were made from."""
    types = _read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("title"))
    rows = memory.episode_nodes(memory.sessionise(_project_events(spark, sf_dir)).join(types, "event_id"))
    return rows.select("project", "session", "title", "content", "fingerprint")


@query(
    """SELECT 'total_nodes' AS name, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) AS n UNION ALL SELECT 'level_3', count(*) FROM region UNION ALL SELECT 'level_2', count(*) FROM nation UNION ALL SELECT 'level_1', count(*) FROM customer
UNION ALL SELECT 'type_concept', count(*) FROM region UNION ALL SELECT 'type_episode', count(*) FROM nation UNION ALL SELECT 'type_event', count(*) FROM customer
UNION ALL SELECT 'edges', (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) UNION ALL SELECT 'relates_edges', 0 UNION ALL SELECT 'node_embeddings', count(*) FROM embeddings
UNION ALL SELECT 'unsupported', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT 'dangling', count(*) FROM orders WHERE o_orderstatus <> 'O'"""
)
def memory_stats(spark, sf_dir):
    """Counts and integrity of regions, nations and customers over orders; only open orders are there as chunks."""
    node = lambda name, key, level, kind: _read(spark, sf_dir, name).select((F.col(key).cast("long") + F.lit(level * 1000000000).cast("long")).alias("node_id"), F.lit(level).alias("level"), F.lit(kind).alias("node_type"))
    nodes = node("region", "r_regionkey", 3, "concept").unionByName(node("nation", "n_nationkey", 2, "episode")).unionByName(node("customer", "c_custkey", 1, "event"))
    shift = lambda end: F.col(f"{end}_id") + F.col(f"{end}_level").cast("long") * 1000000000
    edges = _geography(spark, sf_dir).withColumn("parent_id", shift("parent")).withColumn("child_id", shift("child"))
    chunks = _read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("chunk_id"))
    return views.memory_stats(nodes, edges, chunks, _vectors(spark, sf_dir))
