"""Queries over text rules: what they say of every row of a driver table, beside the SQL that says the same.

Where a table lacks texts of the needed shape, an expression that Spark and DuckDB both read makes them from its columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import repair, text, vectors
from ..operators import answers, ingest
from ..sources import notes
from .catalog import SQL_TOKENS, _read, query

_SPLIT = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"

_ASKED = """CASE event_id % 6 WHEN 0 THEN concat('Explain the difference between the ', event_type, ' and using item', user_id, ', ok? Then more')
WHEN 1 THEN concat('Please compare ', event_type, ' to item', user_id, '. Thanks') WHEN 2 THEN concat('Is ', event_type, ' vs. item', user_id, '! better')
WHEN 3 THEN concat('difference in ', event_type) WHEN 4 THEN concat(event_type, ' versus ', upper(event_type)) ELSE concat('the ', event_type, ' VS an item', user_id) END"""
@query(
    """SELECT event_id, CASE event_id % 6 WHEN 2 THEN 'Is ' || event_type WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE event_type END AS "left",
CASE event_id % 6 WHEN 0 THEN 'item' || user_id || ', ok' WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE 'item' || user_id END AS "right" FROM events"""
)
def comparative_sides(spark, sf_dir):
    """The two sides of comparative questions."""
    asked = _read(spark, sf_dir, "events").select("event_id", F.expr(_ASKED).alias("q"))
    return asked.select("event_id", text.comparative(F.col("q")).alias("s")).select("event_id", "s.left", "s.right")


_LABEL = """concat(CASE event_id % 8 WHEN 0 THEN 'This ' WHEN 1 THEN 'there ' WHEN 2 THEN 'I ' ELSE '' END, event_type, ' ', repeat('of it ', CAST(event_id % 5 AS INT)),
repeat('long', CAST(event_id % 23 AS INT)), CASE event_id % 7 WHEN 0 THEN 'end.' WHEN 1 THEN 'end:' WHEN 2 THEN 'end,' ELSE 'end' END)"""


@query(
    f"""WITH l AS (SELECT event_id, {_LABEL} AS x FROM events), w AS (SELECT event_id, x, {_SPLIT.format('x')} AS w FROM l)
SELECT event_id, len(w) BETWEEN 1 AND 8 AND length(x) <= 80 AND right(x, 1) NOT IN (':', '.', ',') AND lower(w[1]) NOT IN ('it', 'this', 'that', 'these', 'those', 'there', 'here') AS valid FROM w"""
)
def label_validity(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", text.valid_label(F.expr(_LABEL)).alias("valid"))


@query(
    r"""WITH f AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, CASE WHEN length(t) > 80 THEN rtrim(left(t, 80)) || '…' ELSE t END AS title FROM f"""
)
def conversation_titles(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", text.conversation_title(F.col("text")).alias("title"))


_TITLE = """concat(CASE event_id % 4 WHEN 0 THEN '"Title: ' WHEN 1 THEN '''title:' WHEN 2 THEN '`' ELSE '  ' END, event_type, repeat(' andmorewords', CAST(event_id % 9 AS INT)), CASE event_id % 3 WHEN 0 THEN '."' WHEN 1 THEN ' –;' ELSE '!' END)"""


@query(
    rf"""WITH r AS (SELECT event_id, regexp_replace(trim(trim({_TITLE}), '"''`“”‘’'), '^[Tt]itle\s*:\s*', '') AS x FROM events),
w AS (SELECT event_id, rtrim(array_to_string(({_SPLIT.format('x')})[1:7], ' '), '.,;:!?-–—') AS x FROM r)
SELECT event_id, CASE WHEN length(x) > 60 THEN rtrim(left(x, 60)) || '…' ELSE x END AS title FROM w"""
)
def model_titles(spark, sf_dir):
    """Conversation titles out of a model's answers."""
    return _read(spark, sf_dir, "events").select("event_id", text.llm_title(F.expr(_TITLE)).alias("title"))


_CITING = "concat(coalesce(text, ''), ' [E', turn % 5, '] so [E1] and [E', turn, '] [E1]')"


@query(
    rf"""WITH c AS (SELECT conv_id, turn, {_CITING} AS a FROM conversations), x AS (SELECT *, list_transform(regexp_extract_all(a, '\[E(\d+)\]', 1), lambda x: CAST(x AS INTEGER)) AS e FROM c),
d AS (SELECT *, list_filter(e, lambda v, i: list_position(e, v) = i) AS u FROM x)
SELECT conv_id, turn, array_to_string(list_filter(u, lambda v: v BETWEEN 1 AND 3), ',') AS valid, array_to_string(list_filter(u, lambda v: v NOT BETWEEN 1 AND 3), ',') AS invalid, md5(regexp_replace(a, '\[E\d+\]', '', 'g')) AS bare FROM d"""
)
def citations(spark, sf_dir):
    """What answers cite of three pieces of evidence, what they make up, and the answers without citations."""
    answer = F.expr(_CITING)
    parts = text.split_citations(text.citations(answer), F.lit(3))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", joined(parts["valid"]).alias("valid"), joined(parts["invalid"]).alias("invalid"), F.md5(text.strip_citations(answer).cast("binary")).alias("bare"))


@query(f"SELECT doc_id, md5(array_to_string({SQL_TOKENS}, ' ')) AS tokens, CAST(len({SQL_TOKENS}) AS BIGINT) AS n_tokens FROM documents")
def token_lists(spark, sf_dir):
    tokens = text.tokenize(F.col("text"))
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(tokens, " ").cast("binary")).alias("tokens"), F.size(tokens).cast("long").alias("n_tokens"))


_KIND = "CASE event_id % 7 WHEN 0 THEN 'git_commit' WHEN 1 THEN 'note' WHEN 2 THEN 'pdf' WHEN 3 THEN 'image' WHEN 4 THEN 'mail' WHEN 5 THEN '' END"
_URI = "CASE event_id % 5 WHEN 0 THEN concat('/r/a', user_id, '@b@', event_id) WHEN 1 THEN concat('/v/d', user_id, '/', event_id, '.md') WHEN 2 THEN concat('top', event_id) WHEN 3 THEN concat('/n', event_id) ELSE '' END"


@query(
    f"""WITH e AS (SELECT event_id, coalesce({_KIND}, '') AS k, {_URI} AS u FROM events), f AS (SELECT *, regexp_replace(u, '/+[^/]*$', '') AS d FROM e)
SELECT event_id, CASE WHEN u = '' THEN CASE WHEN k = '' THEN 'unknown' ELSE k END WHEN k = 'git_commit' THEN regexp_replace(u, '@[^@]*$', '')
  WHEN k IN ('note', 'pdf', 'image') THEN CASE WHEN d = '' THEN '/' ELSE d END WHEN k = '' THEN u ELSE k END AS project FROM f"""
)
def project_keys(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", text.project_key(F.expr(_KIND), F.expr(_URI)).alias("project"))


_GOLD = "CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN concat('/pages/', page_id) WHEN 2 THEN concat('//pages/', page_id) WHEN 3 THEN concat('pages/', page_id) WHEN 4 THEN concat('://', page_id) ELSE concat('s3://b//', page_id) END"


@query(
    f"""WITH g AS (SELECT page_id, {_GOLD} AS uri FROM pages), i AS (SELECT page_id, uri, CASE WHEN position('://' IN uri) = 1 THEN 'not_absolute'
  WHEN position('://' IN uri) = 0 AND NOT starts_with(uri, '/') THEN 'not_absolute'
  WHEN contains(CASE WHEN position('://' IN uri) > 0 THEN substring(uri, position('://' IN uri) + 3) ELSE uri END, '//') THEN 'doubled_slash'
  WHEN uri NOT IN (SELECT '/pages/' || page_id FROM pages WHERE page_id > 100) THEN 'unknown_source' END AS issue FROM g)
SELECT 'q' || page_id AS query_text, uri, issue FROM i WHERE issue IS NOT NULL"""
)
def uri_lint(spark, sf_dir):
    """Gold uris that can match nothing, and why."""
    pages = _read(spark, sf_dir, "pages")
    queries = pages.select(F.concat(F.lit("q"), "page_id").alias("query_text"), F.array(F.expr(_GOLD)).alias("expected_source_uris"))
    known = pages.where("page_id > 100").select(F.concat(F.lit("/pages/"), "page_id").alias("source_uri"))
    return text.uri_warnings(queries, known)


_LISTED = """CASE event_id % 6 WHEN 0 THEN concat('["/a', user_id, '", "/b"]') WHEN 1 THEN concat('"/c', user_id, '"') WHEN 2 THEN concat('/d', user_id, ', /e,,')
WHEN 3 THEN '  ' WHEN 4 THEN concat('[bad, /f', user_id) END"""


@query(
    f"""WITH e AS (SELECT event_id, user_id, {_LISTED} AS x FROM events)
SELECT event_id, CASE event_id % 6 WHEN 0 THEN '/a' || user_id || '|/b' WHEN 1 THEN '/c' || user_id WHEN 2 THEN '/d' || user_id || '|/e' WHEN 4 THEN '[bad|/f' || user_id ELSE '' END AS uris FROM e"""
)
def gold_uris(spark, sf_dir):
    """Expected sources of evaluation queries, however they are written."""
    return _read(spark, sf_dir, "events").select("event_id", F.array_join(text.gold_uris(F.expr(_LISTED)), "|").alias("uris"))


@query(
    r"""SELECT event_id, '/f' || user_id || '.pdf p.' || (event_id % 9) || CASE WHEN event_id % 3 = 0 THEN ' fig.' || (event_id % 4) ELSE '' END || CASE WHEN event_id % 2 = 0 THEN ' [region: top]' ELSE '' END AS locator,
'{"modality":"pdf-page","page":' || (event_id % 9) || CASE WHEN event_id % 2 = 0 THEN ',"region":"top"' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN ',"figure_index":' || (event_id % 4) ELSE '' END || '}' AS metadata FROM events"""
)
def locators(spark, sf_dir):
    """Chunk metadata, and what it says as a locator."""
    page, region = (F.col("event_id") % 9).cast("int"), F.when(F.col("event_id") % 2 == 0, "top")
    figure = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 4).cast("int"))
    raw = text.build_locator(modality=F.lit("pdf-page"), page=page, region=region, figure_index=figure)
    uri = F.concat(F.lit("/f"), F.col("user_id").cast("string"), F.lit(".pdf"))
    rows = _read(spark, sf_dir, "events").select("event_id", uri.alias("uri"), raw.alias("metadata"))
    return rows.select("event_id", text.format_locator(F.col("uri"), text.parse_locator(F.col("metadata"))).alias("locator"), "metadata")


_META = """CASE event_id % 5 WHEN 0 THEN concat('{"source_id": ', user_id, ', "x": 1}') WHEN 1 THEN concat('{"source_id": "', user_id, '"}') WHEN 2 THEN concat('{"source_id": ', user_id, '.5}') WHEN 3 THEN '{bad' END"""


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN user_id END AS source_id FROM events")
def event_sources(spark, sf_dir):
    """The source that an event's metadata names."""
    return _read(spark, sf_dir, "events").select("event_id", text.event_source(F.expr(_META)).alias("source_id"))


@query(
    f"""WITH t AS (SELECT doc_id, list_transform({SQL_TOKENS}, lambda x: CAST(('0x' || right(md5(x), 2)) AS INTEGER) % 64) AS b FROM documents)
SELECT doc_id, array_to_string(list_transform(range(64), lambda k: len(list_filter(b, lambda x: x = k))), ',') AS vector FROM t"""
)
def stub_embedding(spark, sf_dir):
    """Deterministic vectors of all documents."""
    vector = F.transform(vectors.bucket_embedding(F.col("text")), lambda x: x.cast("int").cast("string"))
    return _read(spark, sf_dir, "documents").select("doc_id", F.array_join(vector, ",").alias("vector"))


@query(
    r"""WITH f AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 220 THEN rtrim(left(t, 220)) || '...' ELSE t END AS preview FROM f"""
)
def previews(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", text.preview(F.coalesce("text", F.lit(""))).alias("preview"))


_SAID = """CASE event_id % 7 WHEN 0 THEN concat('Here: [{"title": "', event_type, '", "summary": "s', user_id, '"}] done') WHEN 1 THEN concat('[{title: "', event_type, '", Summary: "s', user_id, '"}]')
WHEN 2 THEN concat('[{\\n"title": ', event_type, ',\\n"summary": s', user_id, '\\n}]') WHEN 3 THEN concat('[ "title": "', event_type, '", "summary": "s', user_id, '" ]')
WHEN 4 THEN concat('[{"Title": "', event_type, '", "summary": "s', user_id, '"}, {"title": "cut') WHEN 5 THEN 'nothing to read' ELSE '[]' END"""


@query(
    """SELECT event_id, CASE WHEN event_id % 7 = 5 THEN NULL WHEN event_id % 7 = 6 THEN '' ELSE event_type || '=s' || user_id END AS events FROM events"""
)
def model_events(spark, sf_dir):
    """Events out of answers in all the broken ways that models write them."""
    found = F.transform(repair.model_events(F.expr(_SAID)), lambda e: F.concat(e["title"], F.lit("="), e["summary"]))
    return _read(spark, sf_dir, "events").select("event_id", F.array_join(found, ";").alias("events"))


_NOTE = """CASE event_id % 6 WHEN 0 THEN concat('---\\ntags: x\\nCreated : "', date_text, '"\\n---\\n# H') WHEN 1 THEN concat('# H\\nDate: ', date_text, 'T04:05:06Z\\nbody')
WHEN 2 THEN concat('---\\ndate: soon\\n---\\nDate: ', date_text) WHEN 3 THEN concat(repeat('line\\n', 12), 'Date: ', date_text) WHEN 4 THEN concat('---\\ntags: y\\n---\\ntext\\ndate:', date_text) ELSE 'no date' END"""


@query(
    """SELECT event_id, CASE WHEN event_id % 6 IN (0, 4) THEN strftime(ts, '%Y-%m-%d') || ' 00:00:00' WHEN event_id % 6 = 1 THEN strftime(ts, '%Y-%m-%d') || ' 04:05:06' END AS noted FROM events"""
)
def note_dates(spark, sf_dir):
    """The dates that notes declare."""
    rows = _read(spark, sf_dir, "events").withColumn("date_text", F.date_format("ts", "yyyy-MM-dd")).select("event_id", F.expr(_NOTE).alias("note"))
    return rows.select("event_id", F.date_format(notes.note_date(F.col("note")), "yyyy-MM-dd HH:mm:ss").alias("noted"))


@query(
    r"""WITH p AS (SELECT u.conv_id AS c, u.turn AS t, u.text AS q, a.text AS a FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user' AND u.text IS NOT NULL AND a.text IS NOT NULL),
b AS (SELECT c, t, q, regexp_replace(a || ' [E1]', '\[E\d+\]', '', 'g') AS a FROM p)
SELECT c AS conversation_id, 'Conversation so far:' || chr(10) || string_agg('User: ' || q || chr(10) || 'Assistant: ' || CASE WHEN length(a) > 1200 THEN rtrim(left(a, 1200)) || ' […truncated]' ELSE a END, chr(10) ORDER BY t) AS history FROM b GROUP BY 1"""
)
def history_blocks(spark, sf_dir):
    """What a model is told of every conversation so far."""
    rows = _read(spark, sf_dir, "conversations").where("text is not null")
    asked = rows.where("role = 'user'").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("turn_index"), F.col("text").alias("question"))
    said = rows.where("role = 'assistant'").select(F.col("conv_id").alias("conversation_id"), (F.col("turn") - 1).alias("turn_index"), F.concat("text", F.lit(" [E1]")).alias("answer"))
    return answers.history_blocks(asked.join(said, ["conversation_id", "turn_index"]))


@query(
    """WITH c AS (SELECT conv_id, left(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn), 8000) AS t FROM conversations GROUP BY 1)
SELECT conv_id AS source_id, t AS text FROM c"""
)
def source_texts(spark, sf_dir):
    """Conversations as sources whose turns are chunks: the text that events are made from."""
    chunks = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("chunk_index"), "text")
    return ingest.source_texts(chunks)
