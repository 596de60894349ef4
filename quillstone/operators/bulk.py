"""Retrieval for many questions at once, and what evaluation and comparative questions need of it.

Questions are a stated set; they come to the tasks in blocks of at most ``MOST`` questions and ``CELLS`` numbers (block by block by way of the driver, each with one pass over
the chunks). A task multiplies a block of rows with the block of questions: word counts with word counts, vectors with vectors. It
keeps the best rows of each question only, so what is shuffled doesn't grow with a task's rows, and chunks and vectors aren't shuffled at all. One
ranking by question then merges the tasks' bests.

Ids of questions, chunks and nodes are bigint. Scores are ordered by nine decimals, ties by the smaller id (of nodes the larger), as vectors multiplied in blocks differ in
their last bits. Questions without words or vector find what the other finds; null texts have no words.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable
from ..functions import scores
from . import retrieval

#: Questions in a block, and numbers in a matrix of a block.
MOST, CELLS = 256, 2 << 20


@dataclass
class Block:
    """Questions as matrices: ``words`` (token by question), ``vectors`` (a row per question, of unit length; NaN without one)."""

    ids: list[int]
    place: dict[str, int]
    words: np.ndarray
    vectors: np.ndarray | None

    @classmethod
    def of(cls, rows: list) -> Block:
        bags = [retrieval.query_tokens(r["query_text"]) for r in rows]
        place = {t: k for k, t in enumerate(dict.fromkeys(t for b in bags for t in b))}
        words = np.zeros((len(place), len(rows)))
        for q, b in enumerate(bags):
            length = math.sqrt(sum(n * n for n in b.values()))
            for t, n in b.items():
                words[place[t], q] = n / length
        given = [r["vector"] for r in rows]
        dim = next((len(v) for v in given if v), 0)
        vectors = np.full((len(rows), dim), np.nan) if dim else None
        for q, v in enumerate(given):
            if v and any(v):
                x = np.asarray(v, float)
                vectors[q] = x / math.sqrt(x @ x)
        return cls([r["query_id"] for r in rows], place, words, vectors)


def blocks_of(queries: DataFrame) -> Iterator[Block]:
    """``queries`` (query_id, query_text, vector) in blocks."""
    rows, tokens = [], set()
    for r in durable(queries.select("query_id", "query_text", "vector")).toLocalIterator():
        mine = set(retrieval.query_tokens(r["query_text"]))
        if rows and (len(rows) == MOST or len(tokens | mine) * (len(rows) + 1) > CELLS):
            yield Block.of(rows)
            rows, tokens = [], set()
        rows.append(r)
        tokens |= mine
    if rows:
        yield Block.of(rows)


def lexical_block(texts: pa.Array, block: Block) -> np.ndarray:
    """Cosines of word counts: a row per text, a column per question. Texts become Python's one by one, as a batch of long ones is large."""
    out = np.zeros((len(texts), len(block.ids)))
    if not block.place:
        return out
    step = max(16, CELLS // len(block.place))
    for at in range(0, len(texts), step):
        part = texts.slice(at, step)
        counts = np.zeros((len(part), len(block.place)))
        for row, words in enumerate(part):
            found = retrieval.query_tokens(words.as_py())
            if not found:
                continue
            length = math.sqrt(sum(n * n for n in found.values()))
            for t in found.keys() & block.place.keys():
                counts[row, block.place[t]] = found[t] / length
        out[at : at + step] = counts @ block.words
    return out


def cosine_block(vectors: pa.Array, block: Block) -> np.ndarray:
    """Cosines of vectors: a row per vector, a column per question; NaN where either has none, 0 for a vector without length."""
    out = np.full((len(vectors), len(block.ids)), np.nan)
    there = np.flatnonzero(~vectors.is_null().to_numpy(zero_copy_only=False))
    if block.vectors is None or not len(there):
        return out
    held = vectors.take(pa.array(there))
    x = held.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(there), -1)
    length = np.sqrt(np.einsum("ij,ij->i", x, x))
    x = np.divide(x, length[:, None], out=np.zeros_like(x), where=length[:, None] > 0)
    out[there] = np.round(x @ block.vectors.T, 9)
    return out


class _Best:
    """The best rows of one question so far, at most ``cap`` of a source."""

    def __init__(self, n: int, cap: int, descending: bool):
        self.n, self.cap, self.sign = n, cap, -1 if descending else 1
        self.rows = [np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]  # score, id, source, lexical, cosine

    def least(self) -> float:
        return self.rows[0][-1] if len(self.rows[0]) == self.n else -np.inf

    def add(self, *new: np.ndarray) -> None:
        rows = [np.concatenate(x) for x in zip(self.rows, new, strict=True)]
        order = np.lexsort((self.sign * rows[1], -rows[0]))
        if self.cap > 0:
            source = rows[2][order]
            by_source = np.argsort(source, kind="stable")
            same = source[by_source]
            begins = np.flatnonzero(np.append(True, same[1:] != same[:-1]))
            nth = np.arange(len(same)) - np.repeat(begins, np.diff(np.append(begins, len(same))))
            order = order[np.sort(by_source[nth < self.cap])]
        self.rows = [x[order[: self.n]] for x in rows]


#: What a task gets of a block's pool: number of the question, chunk, cosine, by chunk.
Near = tuple[np.ndarray, np.ndarray, np.ndarray]
Weights = tuple[float, float, float]
PAIR = "query_id bigint, chunk_id bigint, source_id {0}, score double, lexical double, cosine double"


@dataclass
class _Scored:
    """Rows against a block: a row per row, a column per question. ``counts``: has a cosine or a word in common."""

    ids: np.ndarray
    source: pa.Array | None
    score: np.ndarray
    lexical: np.ndarray
    cosine: np.ndarray
    counts: np.ndarray


def _scored(batches: Iterator[pa.RecordBatch], block: Block, weights: Weights, near: Near | None = None) -> Iterator[_Scored]:
    wv, wl, wt = weights
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            ids = column["chunk_id"].to_numpy(zero_copy_only=False).astype(np.int64)
            lexical = lexical_block(column["text"], block) if "text" in column else np.zeros((len(ids), len(block.ids)))
            cosine = cosine_block(column["vector"], block) if "vector" in column else np.full(lexical.shape, np.nan)
            if near is not None:
                asked, found, value = near
                first, last = np.searchsorted(found, ids), np.searchsorted(found, ids, side="right")
                for k in np.flatnonzero(last > first):
                    cosine[k, asked[first[k] : last[k]]] = value[first[k] : last[k]]
            score = wl * lexical + wv * np.nan_to_num((cosine + 1) / 2)
            if wt and "title" in column:
                score += wt * lexical_block(column["title"], block)
            if "static" in column:
                score += column["static"].to_numpy(zero_copy_only=False)[:, None]
            yield _Scored(ids, column.get("source_id"), np.round(score, 9), lexical, cosine, ~np.isnan(cosine) | (lexical > 0))


def _read(rows: DataFrame) -> tuple[DataFrame, str]:
    """``rows`` with the columns that count, and the type of their sources."""
    kind = rows.schema["source_id"].dataType.simpleString() if "source_id" in rows.columns else "string"
    return rows.select([c for c in ("chunk_id", "source_id", "text", "title", "vector", "static") if c in rows.columns]), kind


def _of(frame: DataFrame, block: Block, *columns: str):
    """The rows of a block's questions, few of each, in pandas, with the number of the question.

    Questions are named in the filter: a frame made of a list goes through Python workers of another kind, which stay beside the scan's on every executor.
    """
    found = frame.where(F.col("query_id").isin(block.ids)).select("query_id", *columns).toPandas()
    return found.assign(number=found["query_id"].map({i: k for k, i in enumerate(block.ids)}))


def _each_block(rows: DataFrame, queries: DataFrame, schema: str, task: Callable[[Block], Callable]) -> DataFrame:
    """``task`` of every block, each over all rows."""
    found = None
    for block in blocks_of(queries):
        part = rows.mapInArrow(task(block), schema)
        found = part if found is None else found.unionByName(part)
    return rows.sparkSession.createDataFrame([], schema) if found is None else found


def scan(rows: DataFrame, queries: DataFrame, n: int, weights: Weights, cap: int = 0, pool: DataFrame | None = None, descending: bool = False) -> DataFrame:
    """query_id, chunk_id, source_id, score, lexical, cosine: the best ``n`` rows of every question, at most ``cap`` of a source (0: all).

    ``rows``: chunk_id, and of these what there is: source_id, text, title, vector, static (added to the score). A row counts where it has a cosine or a word in common.
    score: weights of (half of cosine + 1), of text and of title, and static. ``pool`` (query_id, chunk_id, cosine; few rows a question) gives cosines in place of vectors.
    """
    rows, kind = _read(rows)

    def task(block: Block) -> Callable:
        near = None
        if pool is not None:
            pairs = _of(pool, block, "chunk_id", "cosine").sort_values("chunk_id")
            near = pairs["number"].to_numpy(np.int64), pairs["chunk_id"].to_numpy(np.int64), pairs["cosine"].to_numpy(float)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = [_Best(n, cap, descending) for _ in block.ids]
            least = np.full(len(block.ids), -np.inf)
            names, of_source, source_type = [], {}, pa.string()
            for x in _scored(batches, block, weights, near):
                source = np.zeros(len(x.ids), np.int64)
                if x.source is not None:
                    source_type, said = x.source.type, x.source.to_pylist()
                    for s in said:
                        if s not in of_source:
                            of_source[s] = len(names)
                            names.append(s)
                    source = np.array([of_source[s] for s in said], np.int64)
                stays = x.counts & (x.score >= least)
                for q in np.flatnonzero(stays.any(axis=0)):
                    pick = stays[:, q]
                    best[q].add(x.score[pick, q], x.ids[pick], source[pick], x.lexical[pick, q], x.cosine[pick, q])
                    least[q] = best[q].least()
            asked = np.repeat(np.array(block.ids, np.int64), [len(b.rows[0]) for b in best])
            score, ids, source, lexical, cosine = (np.concatenate([b.rows[k] for b in best]) for k in range(5))
            if len(asked):
                named = pa.array([names[s] for s in source] if names else [None] * len(asked), source_type)
                yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(ids), named, pa.array(score), pa.array(lexical), pa.array(cosine, from_pandas=True)], names=["query_id", "chunk_id", "source_id", "score", "lexical", "cosine"])

        return run

    found = _each_block(rows, queries, PAIR.format(kind), task)
    return ranked(retrieval.source_cap(found, cap, per=["query_id"]), n, descending).drop("rank")


def all_scores(rows: DataFrame, queries: DataFrame, weights: Weights) -> DataFrame:
    """query_id, chunk_id, score of all pairs that ``scan`` would choose from; for few rows."""

    def task(block: Block) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in _scored(batches, block, weights):
                row, q = np.nonzero(x.counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(block.ids, np.int64)[q]), pa.array(x.ids[row]), pa.array(x.score[row, q])], names=["query_id", "chunk_id", "score"])

        return run

    return _each_block(_read(rows)[0], queries, "query_id bigint, chunk_id bigint, score double", task)


def above(rows: DataFrame, queries: DataFrame, marks: DataFrame, weights: Weights) -> DataFrame:
    """query_id, n: how many rows come before each question's mark (query_id, score, chunk_id), a row per task."""

    def task(block: Block) -> Callable:
        found = _of(marks, block, "score", "chunk_id")
        score, ids = np.full(len(block.ids), np.inf), np.zeros(len(block.ids), np.int64)
        score[found["number"]], ids[found["number"]] = found["score"], found["chunk_id"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(block.ids), np.int64)
            for x in _scored(batches, block, weights):
                n += (x.counts & ((x.score > score) | ((x.score == score) & (x.ids[:, None] < ids)))).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(block.ids, np.int64)), pa.array(n)], names=["query_id", "n"])

        return run

    return _each_block(_read(rows)[0], queries, "query_id bigint, n bigint", task)


def ranked(hits: DataFrame, n: int | None = None, descending: bool = False) -> DataFrame:
    """``hits`` with rank, 1 for a question's best; the first ``n`` where given."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.desc("chunk_id") if descending else F.asc("chunk_id"))
    out = hits.withColumn("rank", F.row_number().over(order))
    return out if n is None else out.where(F.col("rank") <= n)


def first_ranks(rows: DataFrame, queries: DataFrame, gold: DataFrame, weights: Weights) -> DataFrame:
    """query_id, rank: the place of the first expected chunk (``gold``: query_id, uri) among all of ``scan``, 1 + how many are better; null if it isn't among them.

    No question's hits are ranked: the best expected one is looked up first, then better ones are counted in each task.
    """
    mine = rows.join(gold.select(F.col("uri").alias("chunk_id")).distinct(), "chunk_id", "left_semi")
    expected = gold.select("query_id", F.col("uri").alias("chunk_id")).distinct()
    hits = all_scores(mine, queries, weights).join(expected, ["query_id", "chunk_id"])
    best = durable(hits.groupBy("query_id").agg(F.max(F.struct("score", (-F.col("chunk_id")).alias("first"))).alias("__best")))
    better = above(rows, queries, best.select("query_id", F.col("__best.score").alias("score"), (-F.col("__best.first")).alias("chunk_id")), weights)
    found = best.select("query_id").join(better.groupBy("query_id").agg(F.sum("n").alias("n")), "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) + 1).alias("rank"))
    return gold.select("query_id").distinct().join(found, "query_id", "left")


def vector_bulk(embeddings: DataFrame, queries: DataFrame, k: int, model: str | None = None) -> DataFrame:
    """query_id, chunk_id, cosine: the ``k`` nearest vectors (chunk_id, vector) of every question (query_id, vector)."""
    asked = queries.select("query_id", F.lit("").alias("query_text"), "vector")
    return scan(retrieval.of_model(embeddings, model).select("chunk_id", "vector"), asked, k, (1.0, 0.0, 0.0)).select("query_id", "chunk_id", "cosine")


def hybrid_bulk(
    chunks: DataFrame, embeddings: DataFrame | None, queries: DataFrame, now: Column, n: int, profile: str = "balanced", pool_of: int = 5, cap: int = 2, usage: DataFrame | None = None, title_weight: float = 0.05,
    restrict_ids: DataFrame | None = None, source_types: list[str] | None = None, model: str | None = None,
) -> DataFrame:
    """The best ``n`` hits of every question, as ``retrieval.hybrid_scores`` scores them, at most ``cap`` of a source.

    ``chunks``: chunk_id, source_id, text, ts and, where there are some, title and source_type. Pools hold ``retrieval.pool_size(pool_of)`` vectors a question and are cut before chunks are restricted.
    """
    wv, wl, wr, wu = scores.CHUNK_WEIGHTS[profile]
    static = wr * scores.recency(F.col("ts"), now)
    rows = retrieval.restrict(chunks, restrict_ids, source_types)
    if wu > 0 and usage is not None:
        used = usage.where("target_kind = 'chunk'") if "target_kind" in usage.columns else usage
        rows = rows.join(used.select(F.col("target_id").alias("chunk_id"), F.col("strength").alias("__strength")), "chunk_id", "left")
        static = static + wu * scores.saturated(F.coalesce("__strength", F.lit(0.0)))
    pool = durable(vector_bulk(embeddings, queries, retrieval.pool_size(pool_of), model)) if embeddings is not None else None
    return scan(rows.withColumn("static", static).drop("vector"), queries, n, (wv, wl, title_weight), cap, pool)


def nodes_bulk(nodes: DataFrame, embeddings: DataFrame, queries: DataFrame, now: Column, k: int, profile: str = "balanced") -> DataFrame:
    """query_id, node_id, score: the best ``k`` nodes of every question, as ``retrieval.node_scores`` scores them."""
    wv, wl, wr, wc = scores.NODE_WEIGHTS[profile]
    words = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")))
    static = wr * scores.recency(F.col("time_start"), now) + wc * F.coalesce("centrality", F.lit(0.0))
    rows = nodes.select(F.col("node_id").alias("chunk_id"), words.alias("text"), static.alias("static")).join(embeddings.select(F.col("node_id").alias("chunk_id"), "vector"), "chunk_id", "left")
    return scan(rows, queries, k, (wv, wl, 0.0), descending=True).select("query_id", F.col("chunk_id").alias("node_id"), "score")


def distilled_bulk(distilled: DataFrame, nodes: DataFrame, queries: DataFrame, now: Column, k: int, model: str | None = None, profile: str = "balanced") -> DataFrame:
    """query_id, node_id, score: the best ``k`` distilled nodes of every question, as ``retrieval.distilled_scores`` scores them."""
    known = distilled.join(nodes.select("node_id", "time_start", "centrality"), "node_id")
    wv, wl, wr, wc = scores.NODE_WEIGHTS[profile]
    static = wr * scores.recency(F.col("time_start"), now) + wc * F.coalesce("centrality", F.lit(0.0))
    mine = F.lit(True) if model is None else F.coalesce(F.col("model") == model, F.lit(False))
    rows = known.select(F.col("node_id").alias("chunk_id"), F.coalesce("summary", F.lit("")).alias("text"), static.alias("static"), F.when(mine, F.col("vector")).alias("vector"))
    return scan(rows, queries, k, (wv, wl, 0.0), descending=True).select("query_id", F.col("chunk_id").alias("node_id"), "score")


def drill_down_bulk(hits: DataFrame, evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, uri, rank: the sources under each question's nodes, each where it is reached first, those of one node by uri.

    ``evidence``: node_id, chunk_id; ``chunks``: chunk_id, source_uri.
    """
    place = ranked(hits.withColumnRenamed("node_id", "chunk_id"), descending=True).select("query_id", F.col("chunk_id").alias("node_id"), F.col("rank").alias("__place"))
    reached = place.join(evidence, "node_id").join(chunks.select("chunk_id", "source_uri"), "chunk_id")
    first = reached.groupBy("query_id", F.col("source_uri").alias("uri")).agg(F.min("__place").alias("__place"))
    return first.select("query_id", "uri", F.row_number().over(Window.partitionBy("query_id").orderBy("__place", "uri")).alias("rank"))


def retrieve_bulk(chunks: DataFrame, embeddings: DataFrame | None, queries: DataFrame, now: Column, top_k: int = 5, cap: int = 2, threshold: float = 0.95, **options) -> DataFrame:
    """The ``top_k`` hits of every question without near duplicates: query_id, chunk_id, source_id, score, lexical, cosine, rank."""
    texts = chunks.select("chunk_id", "text")

    def best(n: int, open_: DataFrame | None) -> DataFrame:
        asked = queries if open_ is None else queries.join(open_, "query_id", "left_semi")
        return hybrid_bulk(chunks, embeddings, asked, now, n, pool_of=top_k, cap=cap, **options)

    return ranked(retrieval.dedupe_prefixes(best, texts, top_k, threshold))


def merge_slots_bulk(pools: DataFrame, top_k: int) -> DataFrame:
    """``retrieval.merge_slots`` of every question at once. ``pools``: question_id, pool (0: the whole question, 1 and 2: its sides), chunk_id, score, and more; a row per hit."""
    side = max(1, top_k // 4)
    share = max(0, top_k - 2 * side)
    within = lambda *more: Window.partitionBy("question_id", *more)
    best = [F.desc("score"), F.asc("chunk_id")]
    rows = pools.repartition("question_id").withColumn("__r", F.row_number().over(within("pool").orderBy(*best))).where(F.col("__r") <= top_k)
    rows = rows.withColumn("__mine", (F.col("pool") == 0) & (F.col("__r") <= share))
    for pool in (1, 2):
        # What an earlier pool has taken doesn't use up a share.
        rows = rows.withColumn("__taken", F.max("__mine").over(within("chunk_id")))
        free = (F.col("pool") == pool) & ~F.col("__taken")
        rows = rows.withColumn("__r", F.row_number().over(within("pool", "__taken").orderBy(*best))).withColumn("__mine", F.col("__mine") | (free & (F.col("__r") <= side)))
    first = within("__mine").orderBy("pool", *best)
    rows = rows.withColumn("__mine", F.col("__mine") & (F.row_number().over(first) <= top_k))
    # Gaps go to the best of all pools.
    rows = rows.withColumn("__taken", F.max("__mine").over(within("chunk_id"))).withColumn("__n", F.count_if("__mine").over(within()))
    once = rows.where("__mine or not __taken").withColumn("__r", F.row_number().over(within("chunk_id", "__taken").orderBy(F.desc("__mine"), *best, "pool"))).where("__mine or __r = 1")
    filled = once.withColumn("__r", F.row_number().over(within("__mine").orderBy(*best))).where(F.col("__mine") | (F.col("__r") <= top_k - F.col("__n")))
    return filled.withColumn("rank", F.row_number().over(within().orderBy(*best))).select(*pools.columns, "rank")


def comparative_bulk(chunks: DataFrame, embeddings: DataFrame | None, questions: DataFrame, now: Column, top_k: int = 5, **options) -> DataFrame:
    """``retrieve_bulk`` of ``questions`` (query_id, query_text, vector, left, left_vector, right, right_vector); those with sides are asked whole and by side, and merged.

    query_id, subquery (null: the whole question), chunk_id, source_id, score, rank.
    """
    shown = F.when(F.col("left").isNotNull() & F.col("right").isNotNull(), 3).otherwise(1)
    part = lambda k, words, vector: F.struct(F.lit(k).alias("pool"), words.alias("query_text"), F.col(vector).alias("vector"), (words if k else F.lit(None).cast("string")).alias("subquery"))
    parts = F.slice(F.array(part(0, F.col("query_text"), "vector"), part(1, F.col("left"), "left_vector"), part(2, F.col("right"), "right_vector")), 1, shown)
    # A side is a question of its own: four ids stand for one question.
    asked = durable(questions.select(F.col("query_id").alias("question_id"), F.inline(parts)).withColumn("query_id", F.shiftleft("question_id", 2) + F.col("pool")))
    hits = retrieve_bulk(chunks, embeddings, asked.select("query_id", "query_text", "vector"), now, top_k, **options).drop("rank")
    pools = hits.join(asked.select("query_id", "question_id", "pool", "subquery"), "query_id")
    merged = merge_slots_bulk(pools.select("question_id", "pool", "subquery", "chunk_id", "source_id", "score"), top_k)
    return merged.select(F.col("question_id").alias("query_id"), "subquery", "chunk_id", "source_id", "score", "rank")
