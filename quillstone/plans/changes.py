"""Queries over changes of tables: scans taken in, vectors, edges, nodes, evaluation queries and uses updated, beside their SQL.

Documents play the stored sources, each in one chunk; even ones are scanned again, some with another text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..durable import durable, folder, numbered
from ..functions import text
from ..operators import centres, follow, graph, ingest, memory, retrieval, store, usage, views
from .catalog import _geography, _now, _read, _usage, _vectors, query

_TYPE = "CASE lang WHEN 'en' THEN 'note' ELSE 'pdf' END"


def _stored(spark, sf_dir):
    """Stored sources: two rows of every tenth, a row without fingerprint of every seventh."""
    docs = _read(spark, sf_dir, "documents")
    uri = F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    row = docs.select(
        (F.col("doc_id") + 1).alias("id"), F.expr(_TYPE).alias("source_type"), uri.alias("source_uri"), F.when(F.col("doc_id") % 7 != 0, F.sha2(F.coalesce("text", F.lit("")), 256)).alias("source_fingerprint"),
        F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("timestamp"), F.lit("old").alias("title"), F.lit(None).cast("string").alias("metadata_json"),
    )
    twice = row.where("(id - 1) % 10 = 0").withColumn("id", F.col("id") + 10000000).withColumn("title", F.lit("twice"))
    return row.unionByName(twice)


def _scanned(spark, sf_dir):
    """A scan of documents with an even number and of all pages: every third document has another text."""
    docs = _read(spark, sf_dir, "documents").where("doc_id % 2 = 0")
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.coalesce("text", F.lit("")))
    uri = F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    time = F.concat(F.when(F.col("doc_id") % 4 == 0, "t").otherwise("u"), F.col("doc_id").cast("string"))
    rows = docs.select(F.expr(_TYPE).alias("source_type"), uri.alias("source_uri"), F.sha2(body, 256).alias("source_fingerprint"), time.alias("timestamp"), F.lit("new").alias("title"), F.lit("{}").alias("metadata_json"))
    pages = _read(spark, sf_dir, "pages").select(F.lit("page").alias("source_type"), F.lpad(F.col("page_id").cast("string"), 9, "0").alias("source_uri"), F.sha2("html", 256).alias("source_fingerprint"), F.lit("p").alias("timestamp"), F.lit("new").alias("title"), F.lit("{}").alias("metadata_json"))
    return rows.unionByName(pages)


_OLD = f"""d AS (SELECT doc_id, doc_id + 1 AS id, {_TYPE} AS kind, '/' || source || '/' || doc_id AS uri, CASE WHEN doc_id % 7 <> 0 THEN sha256(coalesce(text, '')) END AS fp, 't' || doc_id AS ts, 'old' AS title FROM documents),
o AS (SELECT * FROM d UNION ALL SELECT doc_id, id + 10000000, kind, uri, fp, ts, 'twice' FROM d WHERE doc_id % 10 = 0),
c AS (SELECT doc_id, {_TYPE} AS kind, '/' || source || '/' || doc_id AS uri, sha256(coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN '+' ELSE '' END) AS fp, CASE WHEN doc_id % 4 = 0 THEN 't' ELSE 'u' END || doc_id AS ts FROM documents WHERE doc_id % 2 = 0),
m AS (SELECT o.*, c.fp AS nfp, c.ts AS nts, c.doc_id IS NOT NULL AS met, row_number() OVER (PARTITION BY o.kind, o.uri ORDER BY o.id DESC) AS n FROM o LEFT JOIN c ON o.kind = c.kind AND o.uri = c.uri),
s AS (SELECT *, coalesce(fp = nfp, false) OR (fp IS NULL AND ts = nts) AS same FROM m WHERE NOT met OR n = 1)"""


@query(
    f"""WITH {_OLD}, top AS (SELECT max(id) AS t FROM o)
SELECT id, kind AS source_type, uri AS source_uri, CASE WHEN NOT met THEN fp WHEN same AND fp IS NOT NULL THEN fp ELSE nfp END AS source_fingerprint, CASE WHEN met AND NOT same THEN nts ELSE ts END AS "timestamp",
CASE WHEN NOT met OR (same AND fp IS NOT NULL) THEN title ELSE 'new' END AS title FROM s
UNION ALL SELECT t + row_number() OVER (ORDER BY page_id), 'page', lpad(CAST(page_id AS VARCHAR), 9, '0'), sha256(html), 'p', 'new' FROM pages, top"""
)
def source_upsert(spark, sf_dir):
    """The sources after the scan: unchanged, filled in, changed, new, and older doubles gone."""
    return store.upsert_sources(_stored(spark, sf_dir), _scanned(spark, sf_dir))[0].drop("metadata_json")


@query(f"WITH {_OLD} SELECT id FROM m WHERE met AND n > 1 UNION ALL SELECT id FROM s WHERE met AND NOT same")
def sources_rechunked(spark, sf_dir):
    """The sources whose chunks go."""
    return store.upsert_sources(_stored(spark, sf_dir), _scanned(spark, sf_dir))[1]


@query(
    """WITH g AS (SELECT doc_id FROM documents WHERE doc_id % 5 = 0), l AS (SELECT doc_id AS chunk_id, doc_id AS source_id, 0 AS chunk_index FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM g)),
f AS (SELECT doc_id, i FROM g, (VALUES (0), (1)) v(i)), n AS (SELECT (SELECT max(doc_id) FROM documents) + row_number() OVER (ORDER BY doc_id, i) AS chunk_id, doc_id AS source_id, i AS chunk_index FROM f)
SELECT chunk_id, source_id, CAST(chunk_index AS INTEGER) AS chunk_index, chunk_id IN (SELECT vec_id FROM embeddings) AND chunk_id <= (SELECT max(doc_id) FROM documents) AND chunk_id NOT IN (SELECT doc_id FROM g) AS embedded FROM (SELECT * FROM l UNION ALL SELECT * FROM n)"""
)
def chunk_replace(spark, sf_dir):
    """Chunks after every fifth source was cut in two: new ids, and vectors only where the chunk stayed."""
    docs = _read(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("source_id"), F.lit(0).alias("chunk_index"), "text", F.lit(None).cast("string").alias("metadata_json"))
    gone = docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("id"))
    fresh = gone.select(F.col("id").alias("source_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_index"), F.lit("half").alias("text"), F.lit(None).cast("string").alias("metadata_json"))
    left, vectors = store.replace_chunks(chunks, _vectors(spark, sf_dir).select("chunk_id", "vector").join(chunks.select("chunk_id"), "chunk_id", "left_semi"), gone, fresh)
    there = vectors.select("chunk_id", F.lit(True).alias("__there"))
    return left.join(there, "chunk_id", "left").select("chunk_id", "source_id", "chunk_index", F.coalesce("__there", F.lit(False)).alias("embedded"))


@query("SELECT vec_id AS chunk_id, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS model FROM embeddings UNION ALL SELECT vec_id + 1000000, 'new' FROM embeddings WHERE vec_id % 3 = 0")
def vector_upsert(spark, sf_dir):
    """Vectors after a third of them came anew, with as many of new chunks."""
    old = _vectors(spark, sf_dir).select("chunk_id", "vector").withColumn("model", F.lit("old"))
    again = old.where("chunk_id % 3 = 0").withColumn("model", F.lit("new"))
    return store.replace_rows(old, again.unionByName(again.withColumn("chunk_id", F.col("chunk_id") + 1000000)), "chunk_id").select("chunk_id", "model")


@query("""SELECT n_regionkey AS parent_id, n_nationkey AS child_id, 1 AS seen FROM nation UNION ALL SELECT c_nationkey, c_custkey, 1 FROM customer UNION ALL SELECT o_custkey, o_orderkey, 1 FROM orders UNION ALL SELECT DISTINCT s_nationkey, -s_suppkey, 2 FROM supplier""")
def edge_insert(spark, sf_dir):
    """Edges after known and new ones were added."""
    old = _geography(spark, sf_dir).withColumn("seen", F.lit(1))
    new = _read(spark, sf_dir, "supplier").select(F.lit(2).alias("parent_level"), F.col("s_nationkey").cast("long").alias("parent_id"), F.lit(1).alias("child_level"), (-F.col("s_suppkey")).cast("long").alias("child_id"), F.lit("contains").alias("relation"))
    fresh = new.unionByName(new).unionByName(_geography(spark, sf_dir)).withColumn("seen", F.lit(2))
    return store.insert_edges(old, fresh).select("parent_id", "child_id", "seen")


@query(
    """WITH g AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) SELECT 'nodes' AS name, count(*) AS n FROM nation WHERE n_nationkey NOT IN (SELECT * FROM g) UNION ALL SELECT 'edges', (SELECT count(*) FROM nation WHERE n_regionkey NOT IN (SELECT * FROM g) AND n_nationkey NOT IN (SELECT * FROM g))
+ (SELECT count(*) FROM customer WHERE c_nationkey NOT IN (SELECT * FROM g) AND c_custkey NOT IN (SELECT * FROM g)) + (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT * FROM g)) UNION ALL SELECT 'cards', count(*) FROM nation WHERE n_nationkey NOT IN (SELECT * FROM g)"""
)
def node_delete(spark, sf_dir):
    """What is left of nodes, edges and cards after the nations of a region went."""
    nations = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node_id"), "n_regionkey")
    left = store.delete_nodes(nations.where("n_regionkey = 1"), nations, _geography(spark, sf_dir), cards=nations)
    out = None
    for name, df in left.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """WITH o AS (SELECT item_id + 1 AS id, CASE WHEN item_id % 4 = 0 THEN 'again' ELSE text END AS t, 'old' AS u FROM benchmark), k AS (SELECT min(id) AS id, t FROM o GROUP BY 2), f AS (SELECT DISTINCT CASE WHEN item_id % 2 = 0 THEN text ELSE 'fresh ' || text END AS t FROM benchmark)
SELECT k.id, k.t AS query_text, CASE WHEN f.t IS NULL THEN 'old' ELSE 'new' END AS uri FROM k LEFT JOIN f USING (t) UNION ALL SELECT (SELECT max(id) FROM o) + row_number() OVER (ORDER BY t), t, 'new' FROM f WHERE t NOT IN (SELECT t FROM k)"""
)
def eval_upsert(spark, sf_dir):
    """Evaluation queries after known and new ones came, doubles collapsed."""
    items = _read(spark, sf_dir, "benchmark")
    old = items.select((F.col("item_id") + 1).alias("id"), F.when(F.col("item_id") % 4 == 0, "again").otherwise(F.col("text")).alias("query_text"), F.array(F.lit("old")).alias("expected_source_uris"))
    fresh = items.select(F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("fresh "), "text")).alias("query_text"), F.array(F.lit("new")).alias("expected_source_uris"))
    return store.upsert_eval_queries(old, fresh).select("id", "query_text", F.element_at("expected_source_uris", 1).alias("uri"))


@query("SELECT p_partkey AS node_id, CASE WHEN p_partkey % 2 = 0 THEN p_size / 50.0 ELSE 0.5 END AS centrality FROM part")
def centrality_update(spark, sf_dir):
    """Nodes after half of them were ranked."""
    parts = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), F.lit(0.5).alias("centrality"), (F.col("p_size") / 50.0).alias("__new"))
    return store.set_centrality(parts.drop("__new"), parts.where("node_id % 2 = 0").select("node_id", F.col("__new").alias("centrality"))).select("node_id", "centrality")


@query(
    """SELECT 'sources' AS name, count(DISTINCT source) FILTER (WHERE NOT starts_with(source, 'src1')) AS n FROM documents UNION ALL SELECT 'chunks', count(*) FROM documents WHERE NOT starts_with(source, 'src1')
UNION ALL SELECT 'queries', count(*) FROM benchmark WHERE NOT (text ILIKE 'the%') UNION ALL SELECT 'usage', count(*) FROM events WHERE event_type = 'view' OR user_id NOT IN (SELECT doc_id FROM documents WHERE starts_with(source, 'src1'))"""
)
def sample_purge(spark, sf_dir):
    """What is left without the sources, queries and uses of a prefix."""
    docs = _read(spark, sf_dir, "documents")
    ids = docs.groupBy(F.col("source").alias("source_uri")).agg(F.min("doc_id").alias("id"))
    chunks = docs.select("source", F.col("doc_id").alias("chunk_id")).join(ids, F.col("source") == F.col("source_uri")).select("chunk_id", F.col("id").alias("source_id"))
    queries = _read(spark, sf_dir, "benchmark").select(F.col("text").alias("query_text"))
    log = _read(spark, sf_dir, "events").select(F.when(F.col("event_type") == "view", "node").otherwise("chunk").alias("target_kind"), F.col("user_id").alias("target_id"))
    out = None
    for name, df in store.without_prefix(ids, chunks, queries, log, ["src1"], "The").items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """WITH s AS (SELECT DISTINCT sha256(text) AS f, text FROM documents WHERE lang IN ('en', 'fr')), d AS (SELECT DISTINCT sha256(text) AS f FROM documents WHERE lang IN ('fr', 'de')), k AS (SELECT f, row_number() OVER (ORDER BY f) AS id FROM s)
SELECT k.f AS fingerprint, k.id AS node_id, 'old' AS title FROM k WHERE f IN (SELECT f FROM d) UNION ALL SELECT f, (SELECT max(id) FROM k) + row_number() OVER (ORDER BY f), 'new' FROM d WHERE f NOT IN (SELECT f FROM s)"""
)
def reconcile_apply(spark, sf_dir):
    """Stored nodes that are still desired, as they were, and the missing ones under the next ids."""
    from ..durable import numbered

    docs = _read(spark, sf_dir, "documents").where("text is not null").select(F.sha2("text", 256).alias("fingerprint"), "lang")
    stored = numbered(docs.where("lang in ('en', 'fr')").select("fingerprint").distinct(), "node_id", "fingerprint").withColumn("title", F.lit("old"))
    desired = docs.where("lang in ('fr', 'de')").select("fingerprint", F.lit("new").alias("title"))
    return store.reconciled(stored, desired).select("fingerprint", "node_id", "title")


@query("SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN event_id % 10 = 0 THEN 7.0 WHEN event_type = 'click' THEN 2.0 WHEN event_type = 'purchase' THEN 3.0 ELSE 1.0 END) AS DOUBLE) AS weight FROM events GROUP BY 1")
def usage_append(spark, sf_dir):
    """The log after events came, some with a weight of their own, the others with their type's."""
    named = F.when(F.col("event_type") == "click", "open").when(F.col("event_type") == "purchase", "accepted_answer").when(F.col("event_type") == "view", "retrieval_hit").otherwise(F.col("event_type"))
    rows = _read(spark, sf_dir, "events").select("event_id", F.lit("node").alias("target_kind"), F.col("user_id").alias("target_id"), named.alias("event_type"), F.col("ts").cast("timestamp").alias("event_at"), F.when(F.col("event_id") % 10 == 0, 7.0).alias("weight"), F.col("event_type").alias("as_told"))
    log = usage.appended(rows.limit(0), rows)
    return log.groupBy(F.col("as_told").alias("event_type")).agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query(
    """WITH s AS (SELECT user_id, sum((CASE event_type WHEN 'click' THEN 2.0 WHEN 'purchase' THEN 3.0 ELSE 1.0 END) * pow(0.5, greatest((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000.0, 0) / 30.0)) AS x FROM events GROUP BY 1)
SELECT user_id AS target_id, round(x, 6) AS strength FROM s ORDER BY x DESC, user_id LIMIT 10"""
)
def usage_top(spark, sf_dir):
    """The ten strongest targets."""
    return usage.stats(_usage(spark, sf_dir), _now())[1].select("target_id", F.round("strength", 6).alias("strength"))


@query(
    """WITH t AS (SELECT conv_id, left(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn), 8000) AS t FROM conversations GROUP BY 1), f AS (SELECT conv_id, t, sha256('m' || chr(31) || '1' || chr(31) || t) AS fp FROM t)
SELECT conv_id AS source_id, fp AS fingerprint FROM f WHERE conv_id % 2 = 1 OR conv_id % 3 = 0"""
)
def pending_sources(spark, sf_dir):
    """Sources whose events are missing, or made from something else."""
    chunks = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("chunk_index"), "text")
    sources = chunks.select(F.col("source_id").alias("id")).distinct()
    made = F.sha2(F.concat_ws("\x1f", F.lit("m"), F.lit("1"), "text"), 256)
    known = ingest.source_texts(chunks).where("source_id % 2 = 0").select("source_id", F.lit(1).alias("level"), F.when(F.col("source_id") % 3 == 0, F.lit("other")).otherwise(made).alias("fingerprint"))
    return ingest.pending_sources(sources, chunks, known, "m").select("source_id", "fingerprint")


_ANSWER = """CASE WHEN length(text) % 3 = 0 THEN 'no list' WHEN length(text) % 3 = 1 THEN '[]' ELSE concat('[{"title": "', length(text), '"}, {"title": "x", "summary": "y"}]') END"""


@query(
    """WITH t AS (SELECT conv_id, left(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn), 8000) AS t, count(*) AS n FROM conversations GROUP BY 1),
e AS (SELECT conv_id, i, CASE i WHEN 0 THEN CAST(length(t) AS VARCHAR) ELSE 'x' END AS title, n FROM t, (VALUES (0), (1)) v(i) WHERE length(t) % 3 = 2)
SELECT row_number() OVER (ORDER BY conv_id, i) AS node_id, conv_id AS source_id, title, CASE i WHEN 1 THEN 'y' END AS content, n AS n_chunks FROM e"""
)
def extract_events(spark, sf_dir):
    """Events that a stand-in model finds in conversations, each tied to all chunks of its source."""
    turns = _read(spark, sf_dir, "conversations")
    chunks = turns.select(F.col("conv_id").alias("source_id"), F.col("turn").alias("chunk_index"), (F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), "text")
    sources = chunks.select(F.col("source_id").alias("id")).distinct().select("id", F.lit("chat").alias("source_type"), F.concat(F.lit("/c/"), F.col("id").cast("string")).alias("source_uri"), F.lit("2024").alias("timestamp"))
    nodes = spark.createDataFrame([], "node_id bigint, level int, node_type string, title string, content string, time_start string, time_end string, fingerprint string, model string, prompt_version string, metadata_json string")
    edges = spark.createDataFrame([], "parent_level int, parent_id bigint, child_level int, child_id bigint, relation string")
    known = spark.createDataFrame([], "source_id bigint, level int, fingerprint string")
    pending = ingest.pending_sources(sources, chunks, known, "m")
    made = ingest.extract_events(pending, sources, chunks, nodes, edges, known, lambda c: F.expr(_ANSWER), "m")
    held = made["edges"].groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n_chunks"))
    return made["nodes"].join(held, "node_id", "left").select("node_id", text.event_source(F.col("metadata_json")).alias("source_id"), "title", "content", "n_chunks")


def _moments(spark, sf_dir):
    """Every embedding as an event of its label's concept, at the time of the event of its number; before some of them changed, came or went, and after."""
    times = _read(spark, sf_dir, "events").select(F.col("event_id").alias("chunk_id"), F.col("ts").cast("timestamp").alias("ts"))
    rows = _vectors(spark, sf_dir).join(times, "chunk_id", "left").select(F.col("label").cast("long").alias("concept_id"), F.col("chunk_id").alias("event_id"), "ts", "vector")
    kind = F.col("event_id") % 10
    other = rows.where(kind == 4).withColumn("vector", F.reverse("vector")).withColumn("ts", F.expr("timestampadd(HOUR, -5, ts)"))
    strays = rows.where(kind == 5).withColumn("concept_id", F.col("concept_id") + F.expr("event_id div 10 % 2"))
    came = rows.where(kind.isin(3, 4))
    return rows, rows.where(~kind.isin(3, 4)).unionByName(other).unionByName(strays), came, other.unionByName(strays)


_MOMENTS = """v AS (SELECT CAST(label AS BIGINT) AS concept_id, vec_id, ts, CAST(embedding AS DOUBLE[]) AS e FROM embeddings LEFT JOIN events ON event_id = vec_id),
z AS (SELECT concept_id, min(ts) AS t0 FROM v GROUP BY 1), i AS (SELECT v.*, t0, CAST(floor((epoch_us(ts) - epoch_us(t0)) / 21600000000.0) AS BIGINT) AS idx FROM v JOIN z USING (concept_id)),
p AS (SELECT concept_id, vec_id, idx, t0, generate_subscripts(e, 1) AS k, unnest(e) AS x, sqrt(list_dot_product(e, e)) AS n FROM i)"""


@query(
    f"""WITH {_MOMENTS}, m AS (SELECT concept_id, idx, t0, k, avg(x / n) AS x, count(*) AS support FROM p WHERE idx IS NOT NULL GROUP BY ALL), c AS (SELECT concept_id, idx, t0, support, list(x ORDER BY k) AS x FROM m GROUP BY ALL)
SELECT concept_id, idx, t0 + to_hours(CAST(6 * idx AS INTEGER)) AS window_start, support, round(CASE WHEN b IS NULL THEN 0.0 ELSE greatest(0.0, 1 - list_cosine_similarity(x, b)) END, 6) AS drift
FROM (SELECT *, lag(x) OVER (PARTITION BY concept_id ORDER BY idx) AS b FROM c)"""
)
def drift_kept(spark, sf_dir):
    """How concepts moved, out of sums that were kept through a change of a fifth of their events."""
    rows, before, came, went = _moments(spark, sf_dir)
    root = folder(spark, "centres")
    centres.take(spark, root, 0, before, before, days=0.25)
    centres.take(spark, root, 1, rows, came, went, days=0.25)
    return centres.drift(centres.read(spark, root), 0.25).select("concept_id", "idx", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "support", F.round("drift", 6).alias("drift"))


@query(
    f"""WITH {_MOMENTS}, m AS (SELECT concept_id, k, avg(x / n) AS x FROM p GROUP BY ALL), c AS (SELECT concept_id, list(x ORDER BY k) AS x FROM m GROUP BY 1)
SELECT v.concept_id AS cluster, vec_id AS node_id, CAST(row_number() OVER (PARTITION BY v.concept_id ORDER BY round(list_cosine_similarity(e, x), 9) DESC, vec_id) AS INTEGER) AS place FROM v JOIN c USING (concept_id)"""
)
def central_kept(spark, sf_dir):
    """The members of concepts, most central first, by centroids out of sums that were kept through a change."""
    rows, before, came, went = _moments(spark, sf_dir)
    root = folder(spark, "centres")
    centres.take(spark, root, 0, before, before, days=0.25)
    centres.take(spark, root, 1, rows, came, went, days=0.25)
    known = centres.centres(centres.read(spark, root)).withColumnRenamed("concept_id", "cluster")
    return memory.central_ranks(rows.select(F.col("concept_id").alias("cluster"), F.col("event_id").alias("node_id"), "vector"), centres=known).select("cluster", "node_id", "place")


def _log(spark, sf_dir):
    """(events as they are, as they were): some came, some were another user's and of another k, some went."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    now = _read(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", k.alias("k"))
    kind = F.col("event_id") % 10
    other = now.where(kind == 4).withColumn("user_id", F.col("user_id") + 1).withColumn("k", F.col("k") + 1)
    return now, now.where(~kind.isin(3, 4)).unionByName(other).unionByName(now.where(kind == 5).withColumn("event_id", F.col("event_id") + 100000000))


def _event_nodes(log):
    uri = F.concat(F.lit("/u/"), F.col("user_id").cast("string"), F.lit("/e"))
    meta = F.to_json(F.struct(F.lit("note").alias("source_type"), uri.alias("source_uri")))
    return log.select(
        F.col("event_id").alias("node_id"), F.lit(1).alias("level"), F.lit("event").alias("node_type"), F.col("event_type").alias("title"), F.lit(None).cast("string").alias("content"), F.col("ts").alias("time_start"),
        F.col("ts").alias("time_end"), F.lit(None).cast("double").alias("centrality"), F.lit(None).cast("string").alias("fingerprint"), meta.alias("metadata_json"),
    )


@query(
    """WITH g AS (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 14400000000 THEN 1 ELSE 0 END AS f FROM events),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT '/u/' || user_id AS project, min(event_id) + 1 AS first_event, count(*) AS n_events, min(ts) AS time_start, max(ts) AS time_end FROM s GROUP BY user_id, session"""
)
def episodes_followed(spark, sf_dir):
    """Episodes of users with four hours between them, made of the events as they were and brought up to date by what changed."""
    now, before = _log(spark, sf_dir)
    old, new = _event_nodes(before), _event_nodes(now)
    first = memory.episode_nodes(memory.sessionise(follow.projects(old, F.col("time_start").alias("ts"), "title"), 4.0), gap_hours=4.0)
    first = numbered(first, "node_id", "project", "session").withColumn("node_id", F.col("node_id") + 400000000).withColumn("level", F.lit(2)).withColumn("node_type", F.lit("episode"))
    contains = first.select(F.lit(2).alias("parent_level"), F.col("node_id").alias("parent_id"), F.lit(1).alias("child_level"), F.explode("members").alias("child_id"), F.lit("contains").alias("relation"))
    nodes = new.unionByName(first.select([c for c in new.columns if c in first.columns]), allowMissingColumns=True)
    differ = follow.projects(new, F.lit(1).alias("n")).union(follow.projects(old, F.lit(-1).alias("n"))).groupBy("event_id", "project").agg(F.sum("n").alias("n"))
    change = follow.episodes(nodes, contains, durable(differ.where("n <> 0").drop("n")), 4.0)
    nodes, edges = follow.applied(nodes, contains, change)
    held = edges.select(F.col("parent_id").alias("node_id"), F.col("child_id").alias("event_id")).join(follow.projects(nodes), "event_id")
    sizes = held.groupBy("node_id", "project").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n_events"))
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return nodes.where("level = 2").join(sizes, "node_id").select("project", "first_event", "n_events", ntz("time_start"), ntz("time_end"))


@query(
    """WITH p AS (SELECT DISTINCT user_id AS e, CAST(json_extract(props, '$.k') AS BIGINT) AS c FROM events)
SELECT x.c AS parent_id, y.c AS child_id, CAST(count(*) AS DOUBLE) AS weight FROM p x JOIN p y ON x.e = y.e AND x.c < y.c GROUP BY 1, 2"""
)
def links_followed(spark, sf_dir):
    """Relations of concepts (the events' k) that share episodes (their users), brought up to date by the memberships that changed."""
    now, before = _log(spark, sf_dir)
    edge = lambda log, level, parent: log.select(F.lit(level).alias("parent_level"), F.col(parent).alias("parent_id"), F.lit(1).alias("child_level"), F.col("event_id").alias("child_id"), F.lit("contains").alias("relation"))
    held = lambda log: edge(log, 3, "k").unionByName(edge(log, 2, "user_id")).withColumn("weight", F.lit(1.0))
    old, rows = held(before), ["event_id", "user_id", "k"]
    edges = old.unionByName(durable(graph.concept_links(old).where("relation = 'relates_to'")))
    differ = before.select(*rows, F.lit(1).alias("n")).union(now.select(*rows, F.lit(-1).alias("n"))).groupBy(rows).agg(F.sum("n").alias("n"))
    differ = durable(differ.where("n <> 0"))
    change = follow.links(edges, held(differ.where("n > 0")), held(differ.where("n < 0")))
    return follow.applied(old, edges, change)[1].where("relation = 'relates_to'").select("parent_id", "child_id", "weight")
