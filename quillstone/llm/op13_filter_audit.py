"""What filters remove together and apart, in every order, from one SQL CUBE.

1. One scan turns each text into failure flags and a digest. Rows of one document and text are summed.
2. A flag for repeated texts needs no join: all rows count as repeats, and the rows of each digest's smallest
   doc_id are taken back (counted -1 as repeats and 1 as first ones). Sums are combined before every shuffle, so a digest, a
   part or an id with most of the rows is no hot key.
3. The rows of one part and one set of flags are added up: 2 to the power of the flags per part at most. SQL's CUBE over the
   flags and the part adds these up for every subset of the flags; its rows whose selected flags are all
   false are the survivors of that subset.
4. Subsets that differ by one filter are joined. Such a pair says what the filter removes behind the
   others; an order of filters is a walk along pairs, and the Shapley sum weighs them by how many orders walk them.

Defined results: null and empty texts are equal and have no words; a null part is the empty string, and joins the part of that
name; a row with a null doc_id comes behind all ids, so it repeats any text that a row with an id has, and no text that only such rows have; repeated
rows of one doc_id and text don't repeat each other, and each counts; a document without a label, or with a null one, is neither good nor toxic, one with several labels is
what any of them says; an empty table gives no rows; very long texts are read whole; other columns are ignored. Texts are equal if
their SHA-256 and their lengths are.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

#: What separates words.
_BLANK = " \t\n\x0b\x0c\r"
#: Measures of a set of documents.
MEASURES = ("kept", "good", "toxic")


def text_flags(column: str = "text") -> dict[str, Column]:
    """The filters on one text: too few words (A), too few distinct ones (B), capitals (C), marks (D)."""
    text = F.coalesce(F.col(column), F.lit(""))
    trimmed = F.btrim(text, F.lit(_BLANK))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    n = F.size(words).cast("long")
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 80 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def profile(docs: DataFrame, labels: DataFrame, flags: dict[str, Column], repeats: str = "E", part: str = "lang") -> DataFrame:
    """part, a boolean per flag (``repeats`` last), kept, good, toxic: how many documents of a part fail just these filters. A written table.

    ``docs``: doc_id, text, ``part``; ``labels``: doc_id, quality, toxic; ``flags``: other filters' failure conditions by name.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    names = list(flags)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.struct(F.unhex(F.sha2(text, 256)).alias("sha"), F.length(text).alias("length")).alias("digest"),
        *[flags[n].alias(n) for n in names],
    )
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    summed = lambda frame, *keys: frame.groupBy(*keys, *names).agg(*[F.sum(m).alias(m) for m in MEASURES])
    # Rows are summed before labels join them, so an id that many rows share meets its label once.
    once = rows.withColumn("kept", F.lit(1).cast("long")).groupBy("doc_id", "part", "digest", *names).agg(F.sum("kept").alias("kept"))
    judged = once.join(said, "doc_id", "left")
    documents = scratch.keep(judged.select("doc_id", "part", "digest", *names, "kept", *[(F.col("kept") * F.coalesce(F.col(m), F.lit(0))).cast("long").alias(m) for m in MEASURES[1:]]), "flags")

    # Of each digest the rows of its first id; those of one id are as few as the parts.
    of_id = documents.groupBy("digest", "doc_id", *names).agg(F.collect_list(F.struct("part", *MEASURES)).alias("rows"))
    first = of_id.groupBy("digest", *names).agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rows")).alias("first"))
    firsts = summed(first.select(*names, F.inline("first.rows")), "part")
    everyone = summed(documents, "part")
    minus = firsts.select("part", *names, *[(-F.col(m)).alias(m) for m in MEASURES])
    as_repeats, as_firsts = everyone.unionByName(minus).withColumn(repeats, F.lit(True)), firsts.withColumn(repeats, F.lit(False))
    every = summed(as_repeats.unionByName(as_firsts), "part", repeats)
    return scratch.keep(every.where("kept > 0").select("part", *names, repeats, *MEASURES), "profile")


def survivors(counted: DataFrame, filters: list[str], whole: bool = False) -> DataFrame:
    """part, subset (bit k: ``filters[k]`` is applied), kept, good, toxic of each part and each subset, zeros included.

    ``whole`` adds rows of null part: the whole table.
    """
    sets = counted.cube("part", *filters).agg(F.grouping("part").alias("__all"), *[F.grouping(f).alias(f"__without_{f}") for f in filters], *[F.sum(m).alias(m) for m in MEASURES])
    for f in filters:
        sets = sets.where((F.col(f"__without_{f}") == 1) | ~F.col(f))
    subset = sum(((1 - F.col(f"__without_{f}").cast("int")) * (1 << k) for k, f in enumerate(filters)), F.lit(0))
    parts = counted.select("part").distinct()
    if whole:
        parts = parts.unionByName(counted.select(F.lit(None).cast("string").alias("part")).distinct())
    else:
        sets = sets.where("__all = 0")
    # No row of the cube stands for a subset that nothing survives.
    zeros = parts.select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("subset"), *[F.lit(0).cast("long").alias(m) for m in MEASURES])
    return sets.select("part", subset.alias("subset"), *MEASURES).unionByName(zeros).groupBy("part", "subset").agg(*[F.sum(m).alias(m) for m in MEASURES])


def marginals(subsets: DataFrame, filters: list[str]) -> DataFrame:
    """part, filter, before (a subset without it), kept (behind both), removed, good_lost, toxic_lost: pairs of subsets that differ by one filter."""
    bits = F.array(*[F.struct(F.lit(f).alias("filter"), F.lit(1 << k).alias("bit")) for k, f in enumerate(filters)])
    grown = subsets.select("*", F.inline(bits)).where(F.col("subset").bitwiseAND(F.col("bit")) == 0)
    after = subsets.select(F.col("part").alias("__part"), F.col("subset").alias("__after"), *[F.col(m).alias(f"__{m}") for m in MEASURES])
    pairs = grown.join(after, F.col("part").eqNullSafe(F.col("__part")) & (F.col("subset") + F.col("bit") == F.col("__after")))
    lost = [(F.col(m) - F.col(f"__{m}")).alias(name) for m, name in zip(MEASURES, ("removed", "good_lost", "toxic_lost"), strict=True)]
    return pairs.select("part", "filter", F.col("subset").alias("before"), F.col("__kept").alias("kept"), *lost)


def audit(counted: DataFrame, filters: list[str], whole: bool = False) -> DataFrame:
    """A row per part, filter_order and step of every order of ``filters``: what the step keeps and removes, and its filter's figures.

    ``counted`` is a ``profile``. redundant: fail the step's filter, but went before; unique_fails: fail that filter alone;
    shapley: removed by that filter, summed over all orders. Orders grow as the factorial of the filters: up to seven or so.
    """
    n, spark = len(filters), counted.sparkSession
    everything = (1 << n) - 1
    subsets = scratch.keep(survivors(counted, filters, whole), "subsets")
    pairs = scratch.keep(marginals(subsets, filters), "pairs")
    bit = {f: 1 << k for k, f in enumerate(filters)}
    own = F.element_at(F.create_map(*[F.lit(x) for f in filters for x in (f, bit[f])]), F.col("filter"))
    others = F.bit_count("before")
    weights = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), others.cast("int") + 1)
    figures = pairs.groupBy(F.col("part").alias("__part"), F.col("filter").alias("__filter")).agg(
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(F.col("before") + own == everything, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * weights).alias("shapley"),
    )
    # The walks follow from the filters' names alone.
    walks = [("".join(o), k + 1, o[k], sum(bit[f] for f in o[:k])) for o in permutations(filters) for k in range(n)]
    steps = spark.createDataFrame(walks, "filter_order string, step int, __of string, __before int")
    walked = pairs.join(F.broadcast(steps), (F.col("filter") == F.col("__of")) & (F.col("before") == F.col("__before")))
    full = walked.join(figures, F.col("part").eqNullSafe(F.col("__part")) & (F.col("filter") == F.col("__filter")))
    return full.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op13_filter_audit``: five filters over all documents by language, in all 120 orders."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    flags = text_flags()
    return audit(profile(docs, labels, flags), [*flags, "E"])


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(words) < 100,
          100 * len(list_distinct(words)) < 80 * len(words),
          100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
          regexp_matches(text, '[#$%&*|]'),
          t.doc_id > min(t.doc_id) OVER (PARTITION BY text)] AS f
  FROM t LEFT JOIN l ON l.doc_id = t.doc_id
), g AS (
  SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic, len(list_filter(f, lambda x: x)) AS n_fails FROM fails GROUP BY part, f
), letters AS (
  SELECT unnest([1, 2, 3, 4, 5]) AS k
), orders AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS o
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), walks AS (
  SELECT o, array_to_string([substr('ABCDE', x, 1) FOR x IN o], '') AS filter_order, s.k AS step, o[s.k] AS own, o[:s.k - 1] AS before
  FROM orders, letters s
), per AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN len(list_filter(before, lambda x: f[x])) = 0 AND NOT f[own] THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN len(list_filter(before, lambda x: f[x])) = 0 AND f[own] THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN len(list_filter(before, lambda x: f[x])) > 0 AND f[own] THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN n_fails = 1 AND f[own] THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN len(list_filter(before, lambda x: f[x])) = 0 AND f[own] THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN len(list_filter(before, lambda x: f[x])) = 0 AND f[own] THEN toxic ELSE 0 END) AS toxic_lost
  FROM g, walks GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM per
"""
