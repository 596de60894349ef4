"""Ranked retrieval: lexical, vector, hybrid, over nodes and distilled nodes, with caps, deduplication and fusion.

Chunks are rows of chunk_id, source_id, text and what the scores need. One query is a projection over the chunks, without
a shuffle; many queries meet stored ``postings`` in an equi-join on tokens. All orders are total: ties go to the
smaller chunk_id, of nodes to the larger node_id.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable, numbered
from ..functions import scores, text, vectors


def query_tokens(query: str | None) -> Counter:
    """Counts of ``text.tokenize``, outside of Spark's expressions."""
    found = " ".join(re.findall(text.TOKEN, query or "")).lower()
    tokens = found.split()
    if "_" in found:
        tokens += [t.replace("_", "") for t in tokens if "_" in t and t.strip("_")]
    return Counter(tokens)


def lexical(column: Column, query: str) -> Column:
    """Cosine of a text's raw token counts with the query's; 0 without a common token."""
    wanted = query_tokens(query)
    if not wanted:
        return F.lit(0.0)
    q_norm = math.sqrt(sum(n * n for n in wanted.values()))
    # Most texts without a common token are told by one search; underscores may stand anywhere in a token.
    letters = {"_*".join(t.replace("_", "")) or "_" for t in wanted}
    hint = "(?i)(?<![a-z0-9_])_*(?:" + "|".join(sorted(letters)) + ")_*(?![a-z0-9_])"

    def weight(t: Column) -> Column:
        out = F.lit(0)
        for token, n in sorted(wanted.items()):
            out = F.when(t == token, n).otherwise(out)
        return out

    def norm2(tokens: Column) -> Column:
        """Sum of squared counts: the k-th equal one adds 2k - 1."""
        start = F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("sum"))

        def step(s: Column, t: Column) -> Column:
            k = F.when(s["last"] == t, s["k"] + 1).otherwise(F.lit(1).cast("long"))
            return F.struct(t.alias("last"), k.alias("k"), (s["sum"] + 2 * k - 1).alias("sum"))

        return F.aggregate(F.array_sort(tokens), start, step, lambda s: s["sum"])

    def score(tokens: Column) -> Column:
        dot = F.aggregate(F.filter(tokens, lambda t: t.isin(sorted(wanted))), F.lit(0), lambda s, t: s + weight(t))
        return text.once(dot, lambda d: F.when(d > 0, d / (F.lit(q_norm) * F.sqrt(norm2(tokens)))).otherwise(F.lit(0.0)))

    return F.when(F.coalesce(column.rlike(hint), F.lit(False)), text.once(text.tokenize(column), score)).otherwise(F.lit(0.0))


def with_lexical(rows: DataFrame, query: str, column: Column, name: str = "lexical") -> DataFrame:
    """``rows`` and the score of their ``column``, evaluated once whatever reads it."""
    return rows.withColumn(name, F.explode(F.array(lexical(column, query))))


def lexical_scores(chunks: DataFrame, query: str, key: str = "chunk_id", column: str = "text") -> DataFrame:
    """``key``, lexical; rows without a common token are absent."""
    found = F.filter(F.array(lexical(F.col(column), query)), lambda x: x > 0)
    return chunks.select(key, F.explode(found).alias("lexical"))


def postings(chunks: DataFrame, key: str = "chunk_id", column: str = "text") -> DataFrame:
    """token, ``key``, n, norm2 (of the whole chunk): a row for each distinct token of a chunk, made in one pass without a shuffle."""
    kind = chunks.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, tokens, counts, norms = [], [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bag = query_tokens(t or "")
                keys += [k] * len(bag)
                tokens += bag
                counts += bag.values()
                norms += [sum(n * n for n in bag.values())] * len(bag)
            arrays = [pa.array(tokens, pa.string()), pa.array(keys, batch.column(0).type), pa.array(counts, pa.int64()), pa.array(norms, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["token", key, "n", "norm2"])

    return chunks.select(key, column).mapInArrow(run, f"token string, {key} {kind}, n bigint, norm2 bigint")


def store_postings(found: DataFrame, path: str, partitions: int = 200) -> None:
    """Write postings in ranges of tokens, sorted, so that a query reads the row groups of its own tokens only."""
    found.repartitionByRange(partitions, "token").sortWithinPartitions("token").write.mode("overwrite").parquet(path)


def stored_scores(stored: DataFrame, query: str, key: str = "chunk_id") -> DataFrame:
    """``lexical_scores`` from stored postings: the filter on tokens reaches the scan."""
    wanted = query_tokens(query)
    q_norm = math.sqrt(sum(n * n for n in wanted.values()))
    weight = F.lit(0)
    for t, n in sorted(wanted.items()):
        weight = F.when(F.col("token") == t, n).otherwise(weight)
    per = stored.where(F.col("token").isin(sorted(wanted))).groupBy(key).agg(F.sum(F.col("n") * weight).alias("__dot"), F.max("norm2").alias("__norm2"))
    return per.select(key, (F.col("__dot") / (F.lit(q_norm) * F.sqrt("__norm2"))).alias("lexical"))


def bulk_scores(stored: DataFrame, queries: DataFrame, key: str = "chunk_id", query_text: str = "query_text") -> DataFrame:
    """query_id, ``key``, lexical for all ``queries`` (query_id, query_text) at once: an equi-join on tokens."""
    asked = postings(queries, "query_id", query_text).select("query_id", "token", F.col("n").alias("__m"), F.col("norm2").alias("__q2"))
    met = stored.join(asked, "token").groupBy("query_id", key).agg(F.sum(F.col("n") * F.col("__m")).alias("__dot"), F.max("norm2").alias("__norm2"), F.max("__q2").alias("__q2"))
    return met.select("query_id", key, (F.col("__dot") / (F.sqrt("__q2") * F.sqrt("__norm2"))).alias("lexical"))


def title_overlap(chunks: DataFrame, query: str, title: str = "title") -> DataFrame:
    """title, title_score over distinct titles."""
    return lexical_scores(chunks.select(title).distinct(), query, key=title, column=title).withColumnRenamed("lexical", "title_score")


def of_model(embeddings: DataFrame, model: str | None) -> DataFrame:
    """Vectors of one model; of all without one."""
    return embeddings if model is None else embeddings.where(F.col("model") == model)


def vector_topk(embeddings: DataFrame, query: list[float], k: int, key: str = "chunk_id", vector: str = "vector", model: str | None = None) -> DataFrame:
    """The ``k`` rows of highest cosine; a zero query gives none."""
    if not any(query):
        return embeddings.select(key, F.lit(0.0).alias("cosine")).limit(0)
    q = F.array(*[F.lit(float(x)) for x in query])
    return of_model(embeddings, model).select(key, vectors.cosine(F.col(vector), q).alias("cosine")).orderBy(F.desc("cosine"), key).limit(k)


def pool_size(top_k: int) -> int:
    return max(10 * top_k, 50)


def source_cap(hits: DataFrame, cap: int = 2, score: str = "score", per: list[str] | None = None) -> DataFrame:
    """At most ``cap`` hits of each source, best first; 0 or less caps nothing."""
    if cap <= 0:
        return hits
    order = Window.partitionBy(*(per or []), "source_id").orderBy(F.desc(score), "chunk_id")
    return hits.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= cap).drop("__n")


class _Kept:
    """Hits kept so far, which a next one must differ from; by token, so that only hits with a word in common are compared."""

    def __init__(self, top_k: int, threshold: float):
        self.top_k, self.threshold = top_k, threshold
        self.with_token: dict[str, list[tuple[int, int]]] = {}
        self.norm2: list[int] = []

    def full(self) -> bool:
        return len(self.norm2) >= self.top_k

    def takes(self, text_: str | None) -> bool:
        if self.full():
            return False
        mine = query_tokens(text_)
        dots, norm2 = [0] * len(self.norm2), sum(n * n for n in mine.values())
        for t, n in mine.items():
            for k, m in self.with_token.get(t, ()):
                dots[k] += n * m
        if any((d / math.sqrt(norm2 * self.norm2[k]) if d else 0.0) >= self.threshold for k, d in enumerate(dots)):
            return False
        for t, n in mine.items():
            self.with_token.setdefault(t, []).append((len(self.norm2), n))
        self.norm2.append(norm2)
        return True


def _walked(hits: DataFrame, top_k: int, threshold: float, per: str) -> DataFrame:
    """The hits that stay, of each ``per`` best first; the few hits of one stream through a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, kept = None, None
        for batch in batches:
            names = batch.schema.names
            stays = []
            for q, t in zip(batch.column(names.index(per)).to_pylist(), batch.column(names.index("text")).to_pylist(), strict=True):
                if kept is None or q != asked:
                    asked, kept = q, _Kept(top_k, threshold)
                stays.append(kept.takes(t))
            yield batch.filter(pa.array(stays, pa.bool_()))

    return hits.repartition(per).sortWithinPartitions(per, F.desc("score"), "chunk_id").mapInArrow(run, hits.schema)


#: Hits, without texts, that are few enough for every task.
BROADCAST_ROWS = 50_000


def dedupe_prefixes(best: Callable[[int, DataFrame | None], DataFrame], texts: DataFrame | None, top_k: int, threshold: float = 0.95, per: str = "query_id") -> DataFrame:
    """Walk the hits of every ``per`` best first; drop one whose token cosine with a kept hit reaches ``threshold``; stop at ``top_k``.

    ``best(n, open)`` gives the best ``n`` hits of each ``per`` in ``open`` (None: of all). Few are walked at first, and twice as many of those questions
    whose hits ran out, so all hits count and few are looked at. ``texts`` (chunk_id, text) are joined to those only; without them hits have a text.
    Up to ``BROADCAST_ROWS`` hits are broadcast to the texts.
    """
    n, open_, found = max(4 * top_k, 16), None, None
    while True:
        hits = durable(best(n, open_))
        few = F.broadcast(hits) if texts is not None and hits.count() <= BROADCAST_ROWS else hits
        named = hits if texts is None else few.join(texts, "chunk_id").select(*hits.columns, "text")
        kept = durable(_walked(named, top_k, threshold, per))
        found = kept if found is None else found.join(open_, per, "left_anti").unionByName(kept)
        seen = hits.groupBy(per).agg(F.count("*").alias("__seen")).where(F.col("__seen") >= n)
        full = kept.groupBy(per).agg(F.count("*").alias("__kept")).where(F.col("__kept") >= top_k)
        open_ = durable(seen.join(full, per, "left_anti").select(per))
        if open_.isEmpty():
            return found
        n *= 2


def dedupe_greedy(hits: DataFrame, top_k: int, threshold: float = 0.95, score: str = "score", texts: DataFrame | None = None) -> DataFrame:
    """``dedupe_prefixes`` of the hits of one question; ``texts``: where to find the texts of chunks if not in ``hits``."""
    if top_k <= 0:
        return hits.limit(0)
    order = [F.desc(score), F.asc("chunk_id")]
    named = hits.select("chunk_id", "text") if texts is None else texts.select("chunk_id", "text")
    ids = hits.drop("text").withColumn("__one", F.lit(0))
    rows = ids if score == "score" else ids.withColumn("score", F.col(score))
    found = dedupe_prefixes(lambda n, _: rows.orderBy(*order).limit(n), named, top_k, threshold, "__one")
    return found.orderBy(*order).select(*[c for c in hits.columns if c in found.columns], *([] if "text" in hits.columns else ["text"]))


def dedupe_bulk(hits: DataFrame, top_k: int, threshold: float = 0.95, per: str = "query_id") -> DataFrame:
    """``dedupe_prefixes`` of ``hits`` that have their texts, of every question at once."""
    order = Window.partitionBy(per).orderBy(F.desc("score"), "chunk_id")

    def best(n: int, open_: DataFrame | None) -> DataFrame:
        mine = hits if open_ is None else hits.join(open_, per, "left_semi")
        return mine.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")

    return dedupe_prefixes(best, None, top_k, threshold, per)


#: Source types that a modality names (fixed values).
MODALITY_TYPES = {"text": "note", "code": "git_commit", "pdf": "pdf", "image": "image"}


def source_types_of(modalities: list[str] | None) -> list[str] | None:
    """The source types that modalities name, united; None restricts nothing, an unknown one is an error."""
    if not modalities:
        return None
    unknown = [m for m in modalities if m.lower() not in MODALITY_TYPES]
    if unknown:
        raise ValueError(f"unknown modality {unknown[0]!r}; choose from {', '.join(sorted(MODALITY_TYPES))}")
    return sorted({MODALITY_TYPES[m.lower()] for m in modalities})


def restrict(rows: DataFrame, ids: DataFrame | None, source_types: list[str] | None) -> DataFrame:
    """Only chunks in ``ids`` and of the types, where these are given."""
    if ids is not None:
        rows = rows.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return rows.where(F.col("source_type").isin(source_types)) if source_types else rows


def _with_titles(rows: DataFrame, query: str) -> DataFrame:
    if "title" not in rows.columns:
        return rows.withColumn("title_score", F.lit(0.0))
    return with_lexical(rows, query, F.col("title"), "title_score")


def lexical_hits(chunks: DataFrame, query: str, now: Column, restrict_ids: DataFrame | None = None, source_types: list[str] | None = None) -> DataFrame:
    """0.85 lexical + 0.15 recency + 0.05 title overlap of all chunks with a common token."""
    rows = with_lexical(restrict(chunks, restrict_ids, source_types), query, F.col("text")).where("lexical > 0")
    rows = _with_titles(rows, query).withColumn("recency", scores.recency(F.col("ts"), now))
    return rows.withColumn("score", 0.85 * F.col("lexical") + 0.15 * F.col("recency") + 0.05 * F.col("title_score"))


def lexical_retrieve(chunks: DataFrame, query: str, now: Column, top_k: int = 5, cap: int = 2, restrict_ids: DataFrame | None = None, source_types: list[str] | None = None) -> DataFrame:
    """The best ``lexical_hits``, capped by source where all chunks are open, without near duplicates."""
    scored = lexical_hits(chunks, query, now, restrict_ids, source_types)
    return dedupe_greedy(source_cap(scored, 0 if restrict_ids is not None else cap), top_k, texts=chunks)


def hybrid_scores(
    chunks: DataFrame, embeddings: DataFrame | None, query: str, query_vector: list[float] | None, now: Column, profile: str = "balanced", top_k: int = 5, usage: DataFrame | None = None, title_weight: float = 0.05,
    restrict_ids: DataFrame | None = None, source_types: list[str] | None = None, model: str | None = None,
) -> DataFrame:
    """All candidates with their components and score. The vector pool is cut before any restriction, texts are scored after it."""
    wv, wl, wr, wu = scores.CHUNK_WEIGHTS[profile]
    pool = vector_topk(embeddings, query_vector, pool_size(top_k), model=model)  # a bounded number of rows
    rows = restrict(chunks, restrict_ids, source_types).join(F.broadcast(pool), "chunk_id", "left")
    rows = with_lexical(rows, query, F.col("text")).where(F.col("cosine").isNotNull() | (F.col("lexical") > 0))
    rows = rows.withColumn("vector_score", scores.unit_cosine(F.col("cosine"))).withColumn("recency", scores.recency(F.col("ts"), now))
    if wu > 0 and usage is not None:
        targets = usage.where("target_kind = 'chunk'") if "target_kind" in usage.columns else usage
        rows = rows.join(targets.select(F.col("target_id").alias("chunk_id"), F.col("strength")), "chunk_id", "left").withColumn("usage", scores.saturated(F.coalesce("strength", F.lit(0.0)))).drop("strength")
    else:
        rows = rows.withColumn("usage", F.lit(0.0))
    rows = _with_titles(rows, query)
    total = wv * F.col("vector_score") + wl * F.col("lexical") + wr * F.col("recency") + wu * F.col("usage") + title_weight * F.col("title_score")
    return rows.withColumn("score", total)


def hybrid_retrieve(chunks: DataFrame, embeddings: DataFrame | None, query: str, query_vector: list[float] | None, now: Column, top_k: int = 5, cap: int = 2, embed=None, decompose: bool = True, **options) -> DataFrame:
    """Top hits with subquery; a comparative question is asked whole and per side, then merged.

    Without vectors (of the model) it is ``lexical_retrieve``.
    """
    whole = lambda df: df.withColumn("subquery", F.lit(None).cast("string"))
    if embeddings is None or query_vector is None or of_model(embeddings, options.get("model")).isEmpty():
        picked = {k: v for k, v in options.items() if k in ("restrict_ids", "source_types")}
        return whole(lexical_retrieve(chunks, query, now, top_k, cap, **picked))
    sides = text.comparative_sides(chunks.sparkSession, query) if decompose and options.get("restrict_ids") is None and embed else None

    def once(q: str, v: list[float]) -> DataFrame:
        found = hybrid_scores(chunks, embeddings, q, v, now, top_k=top_k, **options)
        return dedupe_greedy(source_cap(found, 0 if options.get("restrict_ids") is not None else cap), top_k, texts=chunks)

    if not sides:
        return whole(once(query, query_vector))
    pools = [whole(once(query, query_vector))]
    pools += [once(s, embed(s)).withColumn("subquery", F.lit(s)) for s in sides]
    return merge_slots(*pools, top_k)


def merge_slots(full: DataFrame, left: DataFrame, right: DataFrame, top_k: int) -> DataFrame:
    """max(1, k // 4) slots for each side, the rest for the whole question; gaps are filled by score."""
    side = max(1, top_k // 4)
    rows = [p.orderBy(F.desc("score"), "chunk_id").limit(top_k).collect() for p in (full, left, right)]
    taken: dict = {}
    for pool, share in zip(rows, (max(0, top_k - 2 * side), side, side), strict=True):
        n = 0
        for r in pool:
            if n < share and len(taken) < top_k and r["chunk_id"] not in taken:
                taken[r["chunk_id"]] = r
                n += 1
    for r in sorted((r for pool in rows for r in pool), key=lambda r: (-r["score"], r["chunk_id"])):
        if len(taken) < top_k:
            taken.setdefault(r["chunk_id"], r)
    best = sorted(taken.values(), key=lambda r: (-r["score"], r["chunk_id"]))
    return full.sparkSession.createDataFrame(best, full.schema)


#: (level, type) of the nodes that a name stands for (fixed values).
NODE_LEVELS = {"event": (1, "event"), "episode": (2, "episode"), "concept": (3, "concept")}


def level_nodes(nodes: DataFrame, level: str) -> DataFrame:
    """Nodes of a named level."""
    if level not in NODE_LEVELS:
        raise ValueError(f"unknown level {level!r}; choose from {', '.join(NODE_LEVELS)}")
    number, kind = NODE_LEVELS[level]
    return nodes.where((F.col("level") == number) & (F.col("node_type") == kind))


def _node_score(rows: DataFrame, embeddings: DataFrame | None, query: str, query_vector: list[float] | None, now: Column, profile: str, words: Column) -> DataFrame:
    wv, wl, wr, wc = scores.NODE_WEIGHTS[profile]
    if embeddings is None or not query_vector or not any(query_vector):
        rows = rows.withColumn("cosine", F.lit(None).cast("double"))
    else:
        q = F.array(*[F.lit(float(x)) for x in query_vector])
        rows = rows.join(embeddings.select("node_id", vectors.cosine(F.col("vector"), q).alias("cosine")), "node_id", "left")
    rows = with_lexical(rows, query, words).where(F.col("cosine").isNotNull() | (F.col("lexical") > 0))
    total = wv * scores.unit_cosine(F.col("cosine")) + wl * F.col("lexical") + wr * scores.recency(F.col("time_start"), now) + wc * F.coalesce("centrality", F.lit(0.0))
    return rows.withColumn("score", total)


def node_scores(nodes: DataFrame, embeddings: DataFrame | None, query: str, query_vector: list[float] | None, now: Column, profile: str = "balanced") -> DataFrame:
    """Score of every candidate node of the given rows (node_id, title, content, time_start, centrality); all vectors count."""
    words = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")))
    return _node_score(nodes, embeddings, query, query_vector, now, profile, words)


def distilled_scores(distilled: DataFrame, nodes: DataFrame, query: str, query_vector: list[float] | None, now: Column, model: str | None = None, profile: str = "balanced") -> DataFrame:
    """Score of distilled nodes (node_id, level, summary, model, vector) by their summary, which is their title too."""
    known = distilled.join(nodes.select("node_id", "time_start", "centrality"), "node_id").withColumn("title", F.coalesce("summary", F.lit("")))
    mine = of_model(distilled, model).where("vector is not null").select("node_id", "vector")
    return _node_score(known.drop("vector"), mine, query, query_vector, now, profile, F.col("title"))


def top_nodes(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), F.desc("node_id")).limit(k)


def drill_down(hits: DataFrame, evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """uri, rank (from 1): source uris under ranked nodes, each where it is reached first; those of one node by uri.

    ``evidence``: node_id, chunk_id (a closure, or the core of distilled nodes); ``chunks``: chunk_id, source_uri.
    """
    place = F.row_number().over(Window.orderBy(F.desc("score"), F.desc("node_id")))
    ranked = hits.select("node_id", place.alias("__place"))  # top-k hits
    reached = evidence.join(F.broadcast(ranked), "node_id").join(chunks.select("chunk_id", "source_uri"), "chunk_id")
    first = reached.groupBy(F.col("source_uri").alias("uri")).agg(F.min("__place").alias("__place"))
    return numbered(first, "rank", "__place", "uri").select("uri", F.col("rank").cast("int").alias("rank"))


def level_retrieve(
    nodes: DataFrame, node_embeddings: DataFrame | None, evidence: DataFrame, chunks: DataFrame, embeddings: DataFrame | None, query: str, query_vector: list[float] | None, now: Column, level: str, top_k: int = 5,
    profile: str = "balanced", **options,
) -> tuple[DataFrame, DataFrame]:
    """(hits, matched nodes): the best nodes of a level, then hybrid retrieval among the chunks below them, uncapped; no chunks give no hits.

    ``evidence`` is the closure of the level's nodes: root_id, chunk_id.
    """
    matched = top_nodes(node_scores(level_nodes(nodes, level), node_embeddings, query, query_vector, now, profile), top_k)
    below = evidence.join(matched.select(F.col("node_id").alias("root_id")), "root_id", "left_semi").select("chunk_id").distinct()
    return hybrid_retrieve(chunks, embeddings, query, query_vector, now, top_k, restrict_ids=below, profile=profile, **options), matched


def rrf(rankings: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (uri, rank) rows of several lists."""
    return rankings.groupBy("uri").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("rrf"))
