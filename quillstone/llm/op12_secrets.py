"""Secrets in texts: known forms by pattern, unknown ones by how badly a vocabulary fits them.

Three base kinds are patterns: assignments, access ids and hexadecimal runs. The method adds the kind ``random``: a run of 20 or more characters
of keys and tokens (letters, digits and ``+/_.=-``) that a byte-pair vocabulary needs a piece for every 1.9
characters or fewer. Words, names and code were in the text the vocabulary was made from, so they take two to five characters a piece; strings
drawn at random take 1.2 to 1.7. Before the test, known digests and identifiers are left out:

* digests: hexadecimal runs in one case as long as those of MD5, SHA-1 or SHA-2, and values of a table that a caller gives;
* identifiers: UUIDs, numbers, dates and times, IBANs with a right check sum, and names whose parts are words or numbers;
* runs that touch a base span, which is reported already.

A run of letters in one case may be a word of a language that the vocabulary knows badly, so it has to take a piece for fewer than 1.5 characters.

Each text is searched in one pass inside its task, without a shuffle; a worker holds one text and its spans. Known values are joined
on, and only where they are given.

Defined results: null and empty texts have no spans; places count code points; repeated rows give repeated results; an empty table gives no rows;
very long texts, and runs of any length, are searched whole; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .bpe import PRE_TOKEN

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: Runs are taken whole, so those of a least length are those that a search for this length finds.
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
#: Kinds in the order in which spans of one start are listed; the last one is the method's.
KINDS = ("assign", "access", "hex", "random")
BASE = KINDS[:3]

#: Characters a piece, in tenths, that a run must stay below, and one of letters in one case.
TENTHS, WORD_TENTHS = 19, 15
LEAST = 20
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST)
#: Hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 (fixed values).
DIGEST_DIGITS = (32, 40, 56, 64, 96, 128)
_ONE_CASE = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_IDENTIFIER = re.compile(
    r"(?i:[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})"  # UUID
    r"|[+-]?[0-9][0-9.+/=_-]*(?:T[0-9.+_-]+Z?)?"  # numbers, dates and times
    r"|(?:[a-z]+|[A-Z]+|[A-Z][a-z]+|v?[0-9]+)(?:[+/_.=-]+(?:[a-z]+|[A-Z]+|[A-Z][a-z]+|v?[0-9]+))+[+/_.=-]*"  # parts that are words or numbers
)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
_LETTERS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tiktoken encoding of a file of ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
    return tiktoken.Encoding("from-ranks", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})


def _iban(run: str) -> bool:
    return bool(_IBAN.fullmatch(run)) and int("".join(str(int(c, 36)) for c in run[4:] + run[:4])) % 97 == 1


def known_form(run: str) -> bool:
    """Whether a run is a digest or an identifier."""
    return bool((len(run) in DIGEST_DIGITS and _ONE_CASE.fullmatch(run)) or _IDENTIFIER.fullmatch(run) or _iban(run))


def is_random(run: str, pieces: int) -> bool:
    """The test: few characters a piece."""
    return 10 * len(run) < (WORD_TENTHS if _LETTERS.fullmatch(run) else TENTHS) * pieces


def spans_of(text: str, count) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) in a text by start, then kind; ``count`` gives the pieces of a string."""
    found = [("assign", *m.span(), m[0]) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(kind, *m.span(), m[0]) for kind, p in (("access", ACCESS), ("hex", HEX)) for m in p.finditer(text)]
    taken = sorted(f[1:3] for f in found)
    at = furthest = 0
    for m in _RUN.finditer(text):
        # Dots and equals signs before a run, dots behind one are punctuation.
        run = m[0].lstrip(".=-").rstrip(".-")
        start = m.start() + len(m[0]) - len(m[0].lstrip(".=-"))
        end = start + len(run)
        while at < len(taken) and taken[at][0] < end:
            furthest, at = max(furthest, taken[at][1]), at + 1
        if furthest <= start and len(run) >= LEAST and not known_form(run) and is_random(run, count(run)):
            found.append(("random", start, end, run))
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


def scan(docs: DataFrame, vocabulary: str, known: DataFrame | None = None) -> DataFrame:
    """doc_id, spans (kind, start, end, value; by start, then kind) per row of ``docs``.

    ``vocabulary``: a file of tiktoken ranks that all workers can read. ``known``: a table whose column value names digests and ids that are no secrets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoding(vocabulary).encode_ordinary
        count = lambda s: len(pieces(s))
        for batch in batches:
            rest = batch.columns[1:]
            found = [[dict(zip(("kind", "start", "end", "value"), s, strict=True)) for s in spans_of(t.as_py() or "", count)] for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(found, _SPAN_TYPE)], names=[*batch.schema.names[1:], "spans"])

    if known is None:
        return docs.select("text", F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, f"doc_id bigint, spans {SPANS}")
    rows = docs.select("text", F.col("doc_id").cast("long").alias("doc_id")).withColumn("__id", F.monotonically_increasing_id())
    found = scratch.keep(rows.mapInArrow(run, f"doc_id bigint, __id bigint, spans {SPANS}"), "spans")
    random = found.select("__id", F.inline("spans")).where("kind = 'random'").select("__id", "start", "value")
    gone = random.join(known.select(F.col("value").cast("string").alias("value")).distinct(), "value", "left_semi").groupBy("__id").agg(F.collect_set("start").alias("gone"))
    joined = found.join(gone, "__id", "left")
    stays = lambda s: (s["kind"] != "random") | F.col("gone").isNull() | ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), s["start"])
    return joined.select("doc_id", F.filter("spans", stays).alias("spans"))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op12_secrets``: spans of secrets in every whole document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts[:3], F.sha2(written(of(*BASE)), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), counts[3])
