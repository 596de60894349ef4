"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

1. Every document's set of n-grams (``size`` words, A-Z lower-cased; fewer words make one
   n-gram) gives min-hashes in bands. Rows and bands are chosen for a target recall at the
   threshold. Documents with equal sets become one representative.
2. Representatives meet on band hashes. Members of a bucket are tied to its smallest
   member only, never to each other, and components of these ties are found.
3. All pairs within a component are verified on the full sets, in blocks: each
   representative goes to the block pairs of its component, and a task counts common
   n-grams of two blocks at once. It hands on, per representative, the number of linked
   rows and the smallest representative it is tied to, so output never grows with the
   pairs. Components above ``whole_limit`` whose rare n-grams make less work are verified
   by these instead: in an order of all n-grams, rare ones first, two sets of at least the
   threshold share one among the first of each, so each pair is counted in the group of the
   first that it shares. Both ways find all pairs of a component.

Links and classes are of rows: ``n_links`` counts the other rows with a similarity of at
least ``threshold``, copies included; the class is the smallest doc_id that links lead to.

Defined results: null and empty texts have no n-grams and link to nothing, each its own
class; repeated rows are copies of each other; of rows with the class's smallest doc_id the first by place stays; very long texts are read whole, their
n-grams held by one worker in about 30 bytes a word; an empty table gives no rows; rows with
null doc_ids take part, and their class is null only if it holds no other; other columns are kept by ``deduplicate`` only, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .components import components
from .hot import join_groups
from .op3_decontamination import _TABLE
from .recompress import U, chained, mix, numbered, word_digests

_LAST = (1 << 63) - 1


def bands_for(recall: float, threshold: float, most: int = 64) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands reach ``recall`` at ``threshold`` with at most ``most`` hashes.

    >>> bands_for(0.999, 0.8)
    (14, 4)
    """
    best = None
    for rows in range(1, most + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-(threshold**rows))))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches this recall with so few hashes")
    return best


def gram_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    words, ids, bounds = numbered([(t or "").encode().translate(_TABLE).split() for t in texts])
    hashes = word_digests(words)[ids] if len(ids) else np.zeros(0, U)
    grams = chained(hashes, size)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(chained(hashes[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out


def _chunks(texts: list, limit: int = 1 << 20) -> Iterator[slice]:
    first, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size > limit:
            yield slice(first, k + 1)
            first, size = k + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """__file, __row, doc_id, digest (of the set; null without n-grams), n_grams, bands."""
    rng = np.random.default_rng(20240501)
    a = rng.integers(0, 1 << 63, bands * rows, dtype=U) * U(2) + U(1)
    c = rng.integers(0, 1 << 63, bands * rows, dtype=U)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            digests, counts, hashes = [], [], []
            for part in _chunks(texts):
                for grams in gram_sets(texts[part], size):
                    counts.append(len(grams))
                    if not len(grams):
                        digests.append(None)
                        hashes.append(None)
                        continue
                    digests.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                    low = np.full(len(a), ~U(0))
                    for at in range(0, len(grams), 4096):
                        low = np.minimum(low, (((grams[None, at : at + 4096] ^ c[:, None]) * a[:, None]) >> U(16)).min(axis=1))
                    band = low.reshape(bands, rows)
                    value = np.arange(bands, dtype=U)
                    for k in range(rows):
                        value = mix(value * U(0x9E3779B97F4A7C15) + band[:, k])
                    hashes.append(value.view(np.int64))
            arrays = [*batch.columns[:3], pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["__file", "__row", "doc_id", "digest", "n_grams", "bands"])

    return docs.select("__file", "__row", "doc_id", "text").mapInArrow(run, "__file string, __row bigint, doc_id bigint, digest binary, n_grams bigint, bands array<bigint>")


def _common(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Matrix of common n-grams; ``right`` None: of ``left`` with itself."""
    sets = left if right is None else left + right
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.zeros((n, n), np.float32)
    wide = np.flatnonzero(df > 16)
    place = np.full(len(df), -1)
    for at in range(0, len(wide), 2048):
        part = wide[at : at + 2048]
        place[:] = -1
        place[part] = np.arange(len(part))
        column = place[inverse]
        has = column >= 0
        m = np.zeros((n, len(part)), np.float32)
        m[owner[has], column[has]] = 1
        common += m @ m.T
    order = np.argsort(inverse, kind="stable")
    first = np.concatenate([[0], np.cumsum(df)[:-1]])
    for k in range(2, 17):
        grams = np.flatnonzero(df == k)
        if not len(grams):
            continue
        who = owner[order[first[grams][:, None] + np.arange(k)]]
        for x in range(k):
            for y in range(x + 1, k):
                np.add.at(common, (who[:, x], who[:, y]), 1)
                np.add.at(common, (who[:, y], who[:, x]), 1)
    return common


_SLOTS = 20  # bits of an n-gram that tell its count


def _gram_counts(sets: DataFrame) -> np.ndarray:
    """How many n-grams of all ``sets`` fall in each slot: close to an n-gram's own count where that is large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << _SLOTS, np.int64)
        for batch in batches:
            for g in batch.column(0).to_pylist():
                np.add.at(counts, (np.frombuffer(g, U) >> U(64 - _SLOTS)).astype(np.int64), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["slot", "n"])

    found = sets.select("grams").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(1 << _SLOTS, np.int64)
    counts[found["slot"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


def _prefix(grams: np.ndarray, counts: np.ndarray, threshold: float) -> np.ndarray:
    """The first n-grams of a set, rare ones first: another set of at least ``threshold`` has one of them among its own first."""
    order = np.lexsort((grams, counts[(grams >> U(64 - _SLOTS)).astype(np.int64)]))
    return grams[order[: len(grams) - int(np.ceil(threshold * len(grams) - 1e-5)) + 1]]


def _prefixes(sets: DataFrame, counts, threshold: float) -> DataFrame:
    """row_id, gram: one row for each n-gram of a row's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = [_prefix(np.frombuffer(g, U), counts.value, threshold).view(np.int64) for g in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(first, pa.list_(pa.int64()))], names=["row_id", "first"])

    return sets.select("row_id", "grams").mapInArrow(run, "row_id bigint, first array<bigint>").select("row_id", F.explode("first").alias("gram"))


def _verify(work: DataFrame, threshold: float, counts=None) -> DataFrame:
    """Of rows (gid, gram, i, j, block, row_id, copies, grams) sorted by group: row_id, links, root.

    ``gram`` is null where a group holds a whole component; ``counts``: broadcast, for the others.
    """

    def settle(key: tuple, rows: list[tuple]) -> tuple[list, list, list]:
        _, gram, i, j = key
        rows = sorted(rows, key=lambda r: (r[0] != i, r[1]))
        sets = [np.frombuffer(r[3], U) for r in rows]
        n_left = sum(r[0] == i for r in rows)
        common = _common(sets, None)
        sizes = np.array([len(s) for s in sets], np.float64)
        linked = np.empty(common.shape, bool)
        for at in range(0, len(sets), 256):  # in double precision, a few rows at a time
            part = common[at : at + 256].astype(np.float64)
            linked[at : at + 256] = part >= threshold * (sizes[at : at + 256, None] + sizes[None, :] - part) - 1e-6
        np.fill_diagonal(linked, False)
        if i != j:
            linked[:n_left, :n_left] = False
            linked[n_left:, n_left:] = False
        if gram is not None:  # a pair that shares an earlier n-gram counts there
            first = [_prefix(s, counts.value, threshold) for s in sets]
            linked &= _common([x[: int(np.flatnonzero(x.view(np.int64) == gram)[0])] for x in first], None) == 0
        ids = np.array([r[1] for r in rows], np.int64)
        copies = np.array([r[2] for r in rows], np.int64)
        at = np.flatnonzero(linked.any(axis=1))
        linked = linked[np.ix_(at, at)]
        label = ids[at]
        while len(at):
            lower = label.copy()
            for k in range(0, len(at), 256):  # a few rows at a time
                lower[k : k + 256] = np.minimum(label[k : k + 256], np.where(linked[k : k + 256], label[None, :], _LAST).min(axis=1))
            if (lower == label).all():
                break
            label = lower
        return ids[at].tolist(), (linked @ copies[at]).tolist(), label.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            ids, links, roots = [], [], []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:4] != key:
                    if len(rows) > 1:
                        for column, more in zip((ids, links, roots), settle(key, rows), strict=True):
                            column += more
                    key, rows = r[:4], []
                rows.append(r[4:])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, links, roots)], names=["row_id", "links", "root"])
        if len(rows) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in settle(key, rows)], names=["row_id", "links", "root"])

    return work.select("gid", "gram", "i", "j", "block", "row_id", "copies", "grams").mapInArrow(run, "row_id bigint, links bigint, root bigint")


def classes(docs: DataFrame, size: int = 5, threshold: float = 0.8, recall: float = 0.999, block: int = 128, whole_limit: int = 1 << 15) -> DataFrame:
    """Per row of ``docs``: __file, __row (its place), doc_id, class_id, n_links, stays (the first row of its class).

    ``block`` and ``whole_limit`` (rows of a component above which its rare n-grams may be the cheaper way) change the
    work, not the result.
    """
    spark, (bands, rows) = docs.sparkSession, bands_for(recall, threshold)
    docs = scratch.located(docs)
    since = scratch.mark()
    keyed = docs.select("__file", "__row", F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = scratch.keep(signatures(keyed, size, bands, rows).withColumn("row_id", F.monotonically_increasing_id()), "signatures")
    order = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"), F.col("row_id"))
    reps = scratch.keep(
        sig.where("digest is not null").groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("copies"), F.any_value("bands").alias("bands"), F.max("n_grams").alias("n_grams"), F.min_by(F.struct("__file", "__row"), order).alias("place")).withColumn("row_id", F.col("first.row_id")),
        "representatives",
    )
    entries = reps.select("row_id", F.posexplode("bands").alias("band", "hash"))
    buckets = entries.groupBy("band", "hash").agg(F.min("row_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    ties = scratch.keep(entries.join(buckets, ["band", "hash"]).select("row_id", "band", "hash", "least"), "ties")
    of_component = components(ties.select(F.col("row_id").alias("a"), F.col("least").alias("b"))).withColumnRenamed("node", "row_id")
    members = of_component.join(reps, "row_id").select("row_id", "label", "copies", "n_grams", "place.*")
    members = scratch.keep(members, "members")

    # Blocks of a group: by rows, and by n-grams so that two blocks fit a worker.
    def blocks(groups: DataFrame) -> DataFrame:
        per = F.least(F.greatest(F.lit(block), F.ceil(F.col("m") / 32)), F.lit(2048))
        return groups.withColumn("nb", F.greatest(F.ceil(F.col("m") / per), F.ceil(F.col("total") / F.lit(1 << 21)), F.lit(1)).cast("int"))

    sizes = members.groupBy("label").agg(F.count("*").alias("m"), F.sum("n_grams").alias("total")).where("m > 1")
    sizes = scratch.keep(sizes, "group-sizes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            grams = [g.tobytes() for part in _chunks(texts) for g in gram_sets(texts[part], size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.binary())], names=["row_id", "grams"])

    wanted = members.select("__file", "__row", "row_id")
    sets = keyed.select("__file", "__row", "text").join(wanted.hint("shuffle_hash"), ["__file", "__row"]).select("row_id", "text").mapInArrow(run, "row_id bigint, grams binary")
    large, whole, by_gram, counts = sizes.where(F.col("m") > whole_limit), blocks(sizes), None, None
    if not large.isEmpty():
        loose = members.join(F.broadcast(large.select("label")), "label", "left_semi").select("row_id", "label", "copies", "n_grams")
        large_sets = scratch.keep(sets.join(loose.select("row_id"), "row_id", "left_semi"), "large-sets")
        counts = spark.sparkContext.broadcast(_gram_counts(large_sets))
        prefixes = scratch.keep(_prefixes(large_sets, counts, threshold).join(loose, "row_id"), "prefixes")
        per_gram = scratch.keep(blocks(prefixes.groupBy("label", "gram").agg(F.count("*").alias("m"), F.sum("n_grams").alias("total")).where("m > 1")), "prefix-groups")
        # The n-grams that tasks would read in either way; both find the same pairs.
        work_of = F.sum(F.col("total").cast("double") * F.col("nb"))
        cost = blocks(large).select("label", (F.col("total").cast("double") * F.col("nb")).alias("cost")).join(per_gram.groupBy("label").agg(work_of.alias("rare_cost")), "label", "left")
        rare = scratch.keep(cost.where(F.coalesce("rare_cost", F.lit(0.0)) < F.col("cost")).select("label"), "by-prefix")
        whole = whole.join(F.broadcast(rare), "label", "left_anti")
        by_gram = prefixes.join(F.broadcast(rare), "label", "left_semi").join(per_gram.select("label", "gram", "nb"), ["label", "gram"]).select(F.col("label").alias("gid"), "gram", "row_id", "copies", "nb")
    work = join_groups(members, whole, "label", "m").select(F.col("label").alias("gid"), F.lit(None).cast("bigint").alias("gram"), "row_id", "copies", "nb")
    work = work if by_gram is None else work.unionByName(by_gram)
    own = F.pmod(F.xxhash64("row_id"), F.col("nb")).cast("int")
    dealt = work.join(sets.hint("shuffle_merge"), "row_id").withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")
    dealt = dealt.repartition("gid", "gram", "i", "j").sortWithinPartitions("gid", "gram", "i", "j")
    found = scratch.keep(_verify(dealt, threshold, counts), "links")

    links = found.groupBy("row_id").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("row_id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "row_id")
    of_rep = reps.join(links, "row_id", "left").join(joined, "row_id", "left").select("digest", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "row_id").alias("label"))
    of_rep = scratch.keep(of_rep, "classes")
    heads = scratch.keep(of_rep.groupBy("label").agg(F.min("first").alias("head"), F.count("*").alias("m")), "heads")
    info = scratch.keep(join_groups(of_rep, heads, "label", "m").select("digest", "head", "copies", (F.col("links") + F.col("copies") - 1).alias("n_links")), "class-info")
    scratch.release(spark, since, sig, info)
    place = ["__file", "__row", "row_id", "doc_id"]
    with_grams = join_groups(sig.where("digest is not null").select(*place, "digest"), info, "digest", "copies").select(*place, "head", "n_links")
    without = sig.where("digest is null").select(*place, order.alias("head"), F.lit(0).cast("long").alias("n_links"))
    head_id = F.col("head.doc_id")
    return with_grams.unionByName(without).select("__file", "__row", "doc_id", F.when(head_id != _LAST, head_id).alias("class_id"), "n_links", (F.col("row_id") == F.col("head.row_id")).alias("stays"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns."""
    marked = scratch.located(docs)
    dropped = classes(marked.select("doc_id", "text"), **options).where("not stays").select("__file", "__row")
    return marked.join(dropped, ["__file", "__row"], "left_anti").transform(scratch.original, docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op8_jaccard_join``: class and number of links of every document, five words, 0.8."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "class_id", "n_links")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 10 * c >= 8 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x
), class AS (SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY 1
), degree AS (SELECT x AS doc_id, count(*) AS n_links FROM link GROUP BY 1)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links FROM class LEFT JOIN degree USING (doc_id)
"""
