"""Collocations: frequent phrases of a language whose words attract each other, mined by pivot.

1. Documents become blocks, written once: their words as numbers of the block's distinct words, with breaks between pieces.
   Word counts of all blocks are summed, and words that may stand in a candidate are ranked by how common they are.
2. Ranks go back to the blocks. A phrase belongs to its pivot, its rarest word (the leftmost place of it). Each place of a
   word becomes a fragment: the words before and behind it that a phrase with this pivot could hold, i.e. up to
   three on each side, until a piece ends or a word is rarer (before it: as rare). The rest is blanked, so a fragment holds no
   phrase of another pivot twice. Fragments of a pivot in a block travel as one row.
3. Pivots are mined on their own: each fragment yields the phrases that hold its pivot, which are counted. A common pivot is
   dealt by block over parts of at most ``PART`` places, whose counts are summed.
4. Parts of candidates are looked up by joins; phrases are ranked by language, a partial ranking in each task first.

A worker holds one block, or the fragments of at most ``PART`` places and a block. Words that stand in every block are a row each per block.

Defined results: null and empty texts have no words; a null language is ``und``, and joins the language of that name; repeated rows count each; a tie goes to the phrase
that is smaller in UTF-8; an empty table, or one without candidates, gives no rows; a very long text is a block of its own; other columns and null ids don't matter, as only text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch
from .blocks import pack, pack_words, unpack, unpack_words

#: Bytes of text in a block, places of a pivot in a part, and fragments that are mined at once.
BLOCK_BYTES, PART, AT_ONCE = 8 << 20, 1 << 20, 1 << 18
LONGEST = 4
REACH = LONGEST - 1
#: Letters A-Z become small, what ends a piece a line end, what separates words a space; bytes of other characters are above these.
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")


def _blocks(docs: DataFrame) -> DataFrame:
    """block, tokens (numbers of words from 1, 0 where a piece ends), langs, lang_of (word), words, counts."""

    def emit(found: list[tuple[str, bytes]]) -> pa.RecordBatch:
        number: dict[tuple[str, bytes], int] = {}
        tokens = []
        for lang in dict.fromkeys(x for x, _ in found):
            words = b" \n ".join(t.translate(_BYTES) for x, t in found if x == lang).replace(b"\n", b" \n ").split(b" ")
            known = {w: len(number) + k for k, w in enumerate(w for w in dict.fromkeys(words) if w not in (b"", b"\n"))}
            number |= {(lang, w): k for w, k in known.items()}
            known[b""], known[b"\n"] = -2, -1
            ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            tokens += [ids[ids > -2] + 1, np.zeros(1, np.int64)]
        ids = np.concatenate(tokens)
        langs = list(dict.fromkeys(x for x, _ in number))
        at = {x: k for k, x in enumerate(langs)}
        data = [pack(ids.astype(np.uint32)), pack_words([x.encode() for x in langs]), pack(np.array([at[x] for x, _ in number], np.int32)), pack_words([w for _, w in number]), pack(np.bincount(ids, minlength=len(number) + 1)[1:].astype(np.int64))]
        return pa.RecordBatch.from_arrays([pa.array([d], pa.binary()) for d in data], names=["tokens", "langs", "lang_of", "words", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if found and size + len(text) > BLOCK_BYTES:
                    yield emit(found)
                    found, size = [], 0
                found.append((lang, text))
                size += len(text)
        if found:
            yield emit(found)

    made = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "tokens binary, langs binary, lang_of binary, words binary, counts binary")
    return scratch.keep(made.withColumn("block", F.monotonically_increasing_id()), "blocks")


def _words(blocks: DataFrame) -> DataFrame:
    """block, at, lang, word, n: the distinct words of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, langs, lang_of, words, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names = pa.array([x.decode() for x in unpack_words(langs)], pa.string())
                found = pa.array([w.decode() for w in unpack_words(words)], pa.string())
                columns = [pa.array(np.full(len(found), block)), pa.array(np.arange(len(found), dtype=np.int32)), names.take(pa.array(unpack(lang_of, np.int32))), found, pa.array(unpack(counts, np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "at", "lang", "word", "n"])

    return blocks.select("block", "langs", "lang_of", "words", "counts").mapInArrow(run, "block bigint, at int, lang string, word string, n bigint")


def _ranked(words: DataFrame) -> DataFrame:
    """``words`` (lang, word, n) with id: 1, 2, ... from the most common one. A written table."""
    at = F.monotonically_increasing_id()
    placed = scratch.keep(words.orderBy(F.desc("n"), "lang", "word").withColumn("__part", F.shiftright(at, 33)).withColumn("__at", at.bitwiseAND((1 << 33) - 1)), "placed")
    before, shifts = 1, []
    for part, n in sorted(tuple(r) for r in placed.groupBy("__part").agg(F.count("*")).collect()):  # a row per partition
        shifts.append((part, before))
        before += n
    table = words.sparkSession.createDataFrame(shifts, "__part bigint, __shift bigint")
    return scratch.keep(placed.join(F.broadcast(table), "__part").select("lang", "word", "n", (F.col("__at") + F.col("__shift")).alias("id")), "words")


def fragments_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pivots and, row by row, the words around them (before: next one first; then behind), 0 for none. ``ids``: 0 ends a piece, larger ones are rarer."""
    padded = np.concatenate([np.zeros(REACH, ids.dtype), ids, np.zeros(REACH, ids.dtype)])
    pivot, around = ids, []
    for side, beyond in ((-1, np.less), (1, np.less_equal)):
        reached = pivot > 0
        for k in range(1, REACH + 1):
            near = padded[REACH + side * k : REACH + side * k + len(ids)]
            reached = reached & (near > 0) & beyond(near, pivot)
            around.append(np.where(reached, near, 0))
    of_use = (around[0] > 0) | (around[REACH] > 0)
    return pivot[of_use], np.stack([a[of_use] for a in around], 1)


def _width(pivot: int) -> type:
    """The numbers around a pivot are no larger than it."""
    return np.uint16 if pivot < 1 << 16 else np.uint32 if pivot < 1 << 32 else np.uint64


def _fragments(blocks: DataFrame, ranked: DataFrame) -> DataFrame:
    """lang, pivot, part, parts, around: all fragments of a pivot in a block, as packed rows of ``_width``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at, ids, uses = (c.to_numpy(zero_copy_only=False) for c in batch.column(4)[k].values.flatten())
                order = np.argsort(ids)
                at, ids, uses = at[order], ids[order], uses[order]
                lang_of = unpack(batch.column(3)[k].as_py(), np.int32)
                names = pa.array([x.decode() for x in unpack_words(batch.column(2)[k].as_py())], pa.string())
                id_of = np.zeros(len(lang_of) + 1, np.int64)
                id_of[at + 1] = ids
                pivot, around = fragments_of(id_of[unpack(batch.column(1)[k].as_py(), np.uint32)])
                order = np.argsort(pivot, kind="stable")
                pivot, around = pivot[order], around[order]
                begins, ends = np.searchsorted(pivot, ids), np.searchsorted(pivot, ids, side="right")
                width = np.array([2, 4, 8])[np.digitize(ids, [1 << 16, 1 << 32])]
                for size in np.unique(width):
                    pick = (width == size) & (ends > begins)
                    if not pick.any():
                        continue
                    first, last = begins[pick], ends[pick]  # one behind the other
                    data = np.ascontiguousarray(around[first[0] : last[-1]].astype(f"<u{size}")).tobytes()
                    offsets = ((np.append(first, last[-1]) - first[0]) * size * around.shape[1]).astype(np.int64)
                    packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]).cast(pa.binary())
                    parts = -(-uses[pick] // PART)
                    # Blocks are dealt over the parts of a common pivot.
                    part = (batch.column(0)[k].as_py() * 0x9E3779B97F4A7C15 >> 20 & 0xFFFFFFFF) % parts
                    lang = names.take(pa.array(lang_of[at[pick]]))
                    yield pa.RecordBatch.from_arrays([lang, pa.array(ids[pick]), pa.array(part.astype(np.int64)), pa.array(parts), packed], names=["lang", "pivot", "part", "parts", "around"])

    back = _words(blocks).join(ranked.select("lang", "word", "id", F.col("n").alias("__n")), ["lang", "word"])
    of_block = back.groupBy("block").agg(F.collect_list(F.struct("at", "id", F.col("__n").alias("n"))).alias("known"))  # as many as words in a block
    return blocks.join(of_block, "block").select("block", "tokens", "langs", "lang_of", "known").mapInArrow(run, "lang string, pivot bigint, part bigint, parts bigint, around binary")


def _counted(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct row, and how often it stands."""
    bits = max(1, *(int(c.max()).bit_length() for c in columns))
    if bits * len(columns) <= 64:
        key = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            key = key << np.uint64(bits) | c
    else:
        key = np.zeros(len(columns[0]), np.int64)
        for c in columns:
            distinct, number = np.unique(c, return_inverse=True)
            key = np.unique(key * len(distinct) + number, return_inverse=True)[1]
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return first, n


def mined(pivots: np.ndarray, around: np.ndarray, whole: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of a fragment that holds it, its words, how often) of phrases of one length that hold their pivots.

    Phrases of ``whole`` pivots, whose fragments are all here, are left out below ``least``.
    """
    for before in range(REACH + 1):
        for behind in range(REACH + 1 - before):
            if not before + behind:
                continue
            rows = np.ones(len(pivots), bool)
            if before:
                rows &= around[:, before - 1] > 0
            if behind:
                rows &= around[:, REACH + behind - 1] > 0
            rows = np.flatnonzero(rows)
            if not len(rows):
                continue
            columns = [*(around[rows, k] for k in reversed(range(before))), pivots[rows], *(around[rows, REACH + k] for k in range(behind))]
            first, n = _counted(columns)
            stay = (n >= least) | ~whole[rows[first]]
            first, n = first[stay], n[stay]
            if len(first):
                yield rows[first], np.stack([c[first] for c in columns], 1), n


def _mine(fragments: DataFrame, least: int) -> DataFrame:
    """lang, words (ids), a: phrases of 2 to ``LONGEST`` words that stand at least ``least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            packed = [np.frombuffer(data, f"<u{np.dtype(_width(pivot)).itemsize}").reshape(-1, 2 * REACH) for _, pivot, _, _, data in held]
            sizes = [len(p) for p in packed]
            around = np.concatenate(packed).astype(np.uint64)
            pivots = np.repeat(np.array([h[1] for h in held], np.uint64), sizes)
            whole = np.repeat(np.array([h[3] == 1 for h in held]), sizes)
            owner = np.repeat(np.arange(len(held)), sizes)
            langs = pa.array([h[0] for h in held], pa.string())
            for rows, words, n in mined(pivots, around, whole, least):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * words.shape[1]), pa.array(words.astype(np.int64).reshape(-1)))
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(owner[rows])), lists, pa.array(n.astype(np.int64))], names=["lang", "words", "a"])

        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= AT_ONCE and row[1:3] != last:
                    yield from flush(held)
                    held, size = [], 0
                last = row[1:3]
                held.append(row)
                size += len(row[4]) // (2 * REACH * np.dtype(_width(row[1])).itemsize)
        if held:
            yield from flush(held)

    found = fragments.repartition("pivot", "part").sortWithinPartitions("pivot", "part").mapInArrow(run, "lang string, words array<bigint>, a bigint")
    # Counts of parts meet; those of other pivots are whole already.
    return found.groupBy("lang", "words").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _wide(count: Column | str) -> Column:
    """For products beyond 64 bits."""
    return (F.col(count) if isinstance(count, str) else count).cast("decimal(20,0)")


def without_parts(phrases: DataFrame, percent: int) -> DataFrame:
    """Phrases that stand in no longer one which is at least ``percent`` as frequent."""
    part = F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.slice("words", i, n)))
    longer = phrases.where(F.size("words") > 2).select(F.explode(F.flatten(part)).alias("words"), "a").groupBy("words").agg(F.max("a").alias("__longer"))
    joined = phrases.join(longer, "words", "left")
    return joined.where(F.col("__longer").isNull() | (100 * _wide("__longer") < percent * _wide("a"))).drop("__longer")


def scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """``phrases`` with l, r and score of the cut that scores lowest, the first of such; ``counts``: words, f of all their parts."""
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("words", F.lit(1), F.col("k")).alias("__head"), F.expr("slice(words, k + 1, size(words) - k)").alias("__tail"))
    met = cuts.join(counts.select(F.col("words").alias("__head"), F.col("f").alias("l")), "__head").join(counts.select(F.col("words").alias("__tail"), F.col("f").alias("r")), "__tail")
    product = (F.lit(2_000_000).cast("decimal(7,0)") * _wide("a")).alias("x")
    score = met.select("lang", "words", "a", "k", "l", "r", product, (_wide("l") + _wide("r")).alias("y")).withColumn("score", F.expr("x div y"))
    best = score.groupBy("lang", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "words", "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, least: int = 30, percent: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language. ``docs``: text, lang."""
    since, spark = scratch.mark(), docs.sparkSession
    blocks = _blocks(docs)
    counted = scratch.keep(_words(blocks).groupBy("lang", "word").agg(F.sum("n").alias("n")), "counts")
    ranked = _ranked(counted.where(F.col("n") >= least))
    phrases = scratch.keep(_mine(_fragments(blocks, ranked), least), "phrases")
    counts = phrases.select("words", F.col("a").alias("f")).unionByName(ranked.select(F.array("id").alias("words"), F.col("n").alias("f")))
    order = [F.desc("score"), F.desc("a")]
    within = Window.partitionBy("lang")
    # Words are looked up for phrases that may be among the first, ties included.
    ahead = scored(without_parts(phrases, percent), counts).withColumn("__rank", F.rank().over(within.orderBy(*order))).where(F.col("__rank") <= top)
    ahead = scratch.keep(ahead.drop("__rank"), "ahead")
    spelt = ahead.select("words", F.posexplode("words").alias("__at", "id")).join(ranked.select("id", "word"), "id").groupBy("words").agg(F.array_sort(F.collect_list(F.struct("__at", "word"))).alias("__spelt"))
    named = ahead.join(spelt, "words").withColumn("phrase", F.array_join("__spelt.word", " "))
    first = named.withColumn("rank", F.row_number().over(within.orderBy(*order, "phrase")).cast("long")).where(F.col("rank") <= top)
    total = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    out = scratch.keep(first.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    scratch.release(spark, since, out)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op11_collocations``: the first 2000 phrases of each language of all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), p AS (
  SELECT lang, list_filter(string_split_regex(unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda x: x <> '') AS w FROM d
), g AS (
  SELECT lang, len, array_to_string(w[i : i + len - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, len, unnest(range(1, len(w) - len + 2)) AS i FROM p, range(1, 5) AS s(len))
  GROUP BY ALL
), c AS (
  SELECT lang, len, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE len > 1 AND f >= 30
), longer AS (
  SELECT lang, array_to_string(w[i : i + n - 1], ' ') AS phrase, max(a) AS f
  FROM (SELECT lang, w, a, n, unnest(range(1, len - n + 2)) AS i FROM c, range(2, 4) AS s(n) WHERE n < len)
  GROUP BY 1, 2
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, h.f AS l, t.f AS r, (CAST(2000000 AS HUGEINT) * c.a) // (h.f + t.f) AS score
  FROM (SELECT *, unnest(range(1, len)) AS k FROM c) c
  JOIN g h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[:k], ' ')
  JOIN g t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[k + 1 :], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
  SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase
  WHERE o.f IS NULL OR CAST(100 AS HUGEINT) * o.f < CAST(80 AS HUGEINT) * b.a
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE len = 1 GROUP BY lang
)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n.n, CAST(score AS BIGINT) AS score
FROM kept JOIN n ON n.lang = kept.lang
QUALIFY rank <= 2000
"""
