"""Text functions as Column expressions (and the few driver-side parsers)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = "[a-zA-Z0-9_]+"
CHUNKER_VERSION = "1"


def tokenize(text: Column) -> Column:
    """Tokens in order, lower-cased each on its own; one with ``_`` is followed by its squashed form."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))

    def variants(t: Column) -> Column:
        low = F.lower(t)
        squashed = F.replace(low, F.lit("_"), F.lit(""))
        return F.when(t.contains("_") & (squashed != ""), F.array(low, squashed)).otherwise(F.array(low))

    return F.flatten(F.transform(found, variants))


def preview(text: Column, size: int = 220, tail: str = "...") -> Column:
    """White space collapsed; cut to ``size`` characters with ``tail``."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) > size, F.concat(F.rtrim(F.substring(flat, 1, size)), F.lit(tail))).otherwise(flat)


def conversation_title(first_query: Column) -> Column:
    return preview(first_query, 80, "…")


#: What may stand around a title, and behind it (fixed values).
TITLE_QUOTES, TITLE_TAIL = "\"'`“”‘’", ".,;:!?-–—"


def llm_title(raw: Column) -> Column:
    """First line of a model's answer, without quotes or ``Title:``, at most seven words, then 60 characters and an ellipsis."""
    line = F.trim(F.element_at(F.split(_strip(raw), r"\R"), 1))
    bare = F.regexp_replace(F.btrim(line, F.lit(TITLE_QUOTES)), r"^[Tt]itle\s*:\s*", "")
    words = F.filter(F.split(bare, r"(?U)\s+"), lambda w: w != "")
    title = F.rtrim(F.array_join(F.slice(words, 1, 7), " "), F.lit(TITLE_TAIL))
    return F.when(F.length(title) > 60, F.concat(F.rtrim(F.substring(title, 1, 60)), F.lit("…"))).otherwise(title)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


#: First words of a label that make it a sentence, and last characters that leave one open (fixed values).
LABEL_FIRST, LABEL_LAST = ["it", "this", "that", "these", "those", "there", "here"], [":", ".", ","]


def valid_label(label: Column) -> Column:
    """At most 80 characters and eight words, not the beginning of a sentence; null and blank labels are invalid."""
    words = F.filter(F.split(F.coalesce(label, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    return F.coalesce(
        F.size(words).between(1, 8) & (F.length(label) <= 80) & ~F.right(label, F.lit(1)).isin(LABEL_LAST) & ~F.lower(F.try_element_at(words, F.lit(1))).isin(LABEL_FIRST), F.lit(False)
    )


def citations(answer: Column) -> Column:
    """Distinct evidence numbers of ``[E#]`` in order; one beyond 64 bits is null, which no evidence has."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[E(\d+)\]"), F.lit(1)), lambda x: x.try_cast("bigint")))


def split_citations(cited: Column, n_evidence: Column) -> Column:
    """struct(valid, invalid): cited numbers from 1 to ``n_evidence``, and the others, in order."""
    known = lambda x: F.coalesce(x.between(1, n_evidence), F.lit(False))
    return F.struct(F.filter(cited, known).alias("valid"), F.filter(cited, lambda x: ~known(x)).alias("invalid"))


def strip_citations(answer: Column) -> Column:
    return F.regexp_replace(answer, r"\[E\d+\]", "")


def project_key(source_type: Column, uri: Column) -> Column:
    """What groups events into episodes: a commit's repository, a file's folder, else the type, else the uri."""
    kind = F.coalesce(source_type, F.lit(""))
    folder = F.regexp_replace(uri, "/+[^/]*$", "")
    folder = F.when(folder != "", folder).when(uri.startswith("/"), "/").otherwise(uri)
    return (
        F.when(F.coalesce(uri, F.lit("")) == "", F.when(kind == "", "unknown").otherwise(kind))
        .when(kind == "git_commit", F.regexp_replace(uri, "(?s)@[^@]*$", ""))
        .when(kind.isin("note", "pdf", "image"), folder)
        .otherwise(F.when(kind == "", uri).otherwise(kind))
    )


def name_list(names: Column, shown: int = 8) -> Column:
    """The first names joined by ``; `` and how many more there are; empty ones don't count."""
    named = F.filter(names, lambda n: F.coalesce(n, F.lit("")) != "")
    more = F.when(F.size(named) > shown, F.concat(F.lit("; … (+"), (F.size(named) - shown).cast("string"), F.lit(" more)")))
    return F.concat(F.array_join(F.slice(named, 1, shown), "; "), F.coalesce(more, F.lit("")))


def episode_title(project: Column, n: Column, start: Column, end: Column) -> Column:
    """``folder: N event(s), first day..last day``; times are texts that begin with their day."""
    base = F.element_at(F.split(F.rtrim(project, F.lit("/")), "/"), -1)
    first, last = F.substring(start, 1, 10), F.substring(F.coalesce(end, start), 1, 10)
    span = F.when(start.isNull(), "undated").when(first == last, first).otherwise(F.concat(first, F.lit(".."), last))
    return F.concat(F.when(base == "", project).otherwise(base), F.lit(": "), n.cast("string"), F.when(n == 1, " event, ").otherwise(" events, "), span)


def fingerprint(text: Column, *prefix: str, version: str = CHUNKER_VERSION) -> Column:
    """sha256 of the prefixes (engine, its version), the chunker's version and the text, unit-separated."""
    return F.sha2(F.concat_ws("\x1f", *[F.lit(p) for p in prefix], F.lit(version), text), 256)


MODALITIES = ["text", "code", "ocr", "pdf-page", "caption"]
LOCATOR = "modality string, page string, region string, figure_index string, ocr_confidence string, source_type string"


def build_locator(**fields: Column) -> Column:
    """JSON of the fields that aren't null; an unknown ``modality`` is an error."""
    row = F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    known = fields["modality"].isin(MODALITIES) if "modality" in fields else F.lit(True)
    return F.when(F.coalesce(known, F.lit(False)), row).otherwise(F.raise_error(F.lit("unknown modality")))


def event_source(metadata: Column) -> Column:
    """The source_id that an event's metadata names; null unless it is a JSON integer."""
    raw = F.regexp_extract(F.coalesce(metadata, F.lit("")), r'"source_id"\s*:\s*(-?\d+)\s*[,}]', 1)
    return F.when(F.get_json_object(metadata, "$.source_id") == raw, raw.try_cast("bigint"))


def parse_locator(raw: Column) -> Column:
    """A locator struct; null where the JSON is bad or has no modality. Booleans are no numbers."""
    parsed = F.from_json(raw, LOCATOR)
    typed = F.struct(
        parsed["modality"].alias("modality"),
        parsed["page"].try_cast("int").alias("page"),
        parsed["region"].alias("region"),
        parsed["figure_index"].try_cast("int").alias("figure_index"),
        parsed["ocr_confidence"].try_cast("double").alias("ocr_confidence"),
        parsed["source_type"].alias("source_type"),
    )
    return F.when(F.coalesce(parsed["modality"], F.lit("")) != "", typed)


def format_locator(uri: Column, locator: Column) -> Column:
    """``uri p.N fig.M [region: R]``; the bare uri without a locator."""
    return F.concat_ws(
        " ",
        uri,
        F.concat(F.lit("p."), locator["page"].cast("string")),
        F.concat(F.lit("fig."), locator["figure_index"].cast("string")),
        F.concat(F.lit("[region: "), locator["region"], F.lit("]")),
    )


#: White space at the ends of a text.
_ENDS = r"(?U)^\s+|\s+$"


def gold_uris(raw: Column) -> Column:
    """Expected sources: a JSON list, a JSON string, or, where it is no JSON, text cut at commas; other JSON and blank text give none."""
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), _ENDS, "")
    # In a list of its own, so that what stands behind a value shows.
    whole = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    value = F.when(F.size(whole) == 1, F.get(whole, F.lit(0)))
    listed = F.try_variant_get(value, "$", "array<variant>")
    # Items that are no strings stand as JSON writes them.
    items = F.transform(listed, lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))
    single = F.when(F.schema_of_variant(value) == "STRING", F.array(F.try_variant_get(value, "$", "string")))
    cut = F.filter(F.transform(F.split(text, ","), lambda x: F.regexp_replace(x, _ENDS, "")), lambda x: x != "")
    none = F.array().cast("array<string>")
    return F.when(value.isNull(), cut).otherwise(F.coalesce(F.when(F.schema_of_variant(value).startswith("ARRAY"), items), single, none))


def uri_problem(uri: Column) -> Column:
    """What is wrong with a gold uri by its form, or null: it names no place (a path from the root, or a scheme), or a part of its path is empty."""
    colon = F.instr(uri, "://")
    path = F.when(colon > 0, F.substring(uri, colon + 3, F.length(uri))).otherwise(uri)
    return F.when(colon == 1, "not_absolute").when((colon == 0) & ~uri.startswith("/"), "not_absolute").when(path.contains("//"), "doubled_slash")


def uri_warnings(queries: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """query_text, uri, issue of the gold uris of ``queries`` (query_text, expected_source_uris) that can match nothing.

    ``known`` (source_uri): sources that are there; with none, no uri counts as unknown.
    """
    each = queries.select("query_text", F.explode("expected_source_uris").alias("uri")).withColumn("issue", uri_problem(F.col("uri")))
    if known is not None and not known.isEmpty():
        there = known.select(F.col("source_uri").alias("uri")).distinct().withColumn("__known", F.lit(True))
        each = each.join(there, "uri", "left").withColumn("issue", F.coalesce("issue", F.when(F.col("__known").isNull(), "unknown_source")))
    return each.where("issue is not null").select("query_text", "uri", "issue")


#: What opens a comparison, word by word, and what joins its sides (fixed values); the first kind that gives two sides counts.
COMPARISONS = [([["difference", "differences"], ["between"]], ["and"]), ([["compare"]], ["with", "to", "and"]), ([], ["vs", "vs.", "versus"])]
#: Words that a side doesn't begin with, marks that it neither begins nor ends with, marks that end the second side (fixed values).
SIDE_FIRST, SIDE_MARKS, SIDE_ENDS = ["a", "an", "the", "using"], ",;:", ".?!"


def once(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _side(found: Column) -> Column:
    """A side without marks at its ends and a first word of ``SIDE_FIRST``; null where a line ends in it."""

    def named(side: Column) -> Column:
        parts = F.split(side, r"(?U)\s+", 2)
        return once(parts, lambda p: F.when((F.size(p) > 1) & F.lower(p[0]).isin(SIDE_FIRST), F.regexp_replace(F.get(p, F.lit(1)), _ENDS, "")).otherwise(F.regexp_replace(side, _ENDS, "")))

    return once(F.btrim(F.regexp_replace(found, _ENDS, ""), F.lit(SIDE_MARKS)), lambda side: F.when(~side.contains("\n"), named(side)))


def _between(words: Column, said: Column, openings: list[list[str]], joiners: list[str]) -> Column:
    """struct(left, right) around the first joiner that stands behind an opening and a word, or null. ``said``: the words in small letters, bare."""
    n, at = F.size(words), F.sequence(F.lit(1), F.size(words))
    begin = F.lit(1)
    if openings:

        def opens(i: Column) -> Column:
            first = F.regexp_extract(F.element_at(said, i), r"(?U)(\w+)$", 1).isin(openings[0])  # of ``(compare``, ``compare``
            for k, names in enumerate(openings[1:], 1):
                first = first & F.coalesce(F.try_element_at(said, i + k).isin(names), F.lit(False))
            return first

        begin = F.try_element_at(F.filter(at, opens), F.lit(1)) + len(openings)

    def cut(b: Column, j: Column) -> Column:
        left = F.array_join(F.slice(words, b, j - b), "")
        if not openings:
            left = F.regexp_replace(left, r"(?U)^\W+(?=\w)", "")
        ended = once(F.array_join(F.slice(words, j + 1, n), ""), lambda x: F.concat(F.left(x, F.lit(1)), F.split(F.substring(x, 2, 1 << 30), f"[{SIDE_ENDS}]")[0]))
        return F.struct(_side(left).alias("left"), _side(ended).alias("right"))

    joined = lambda b: F.try_element_at(F.filter(at, lambda j: (j > b) & (j < n) & F.element_at(said, j).isin(joiners)), F.lit(1))
    found = once(begin, lambda b: once(joined(b), lambda j: F.when(j.isNotNull(), cut(b, j))))
    return once(found, lambda s: F.when((s["left"] != "") & (s["right"] != "") & (F.lower(s["left"]) != F.lower(s["right"])), s))


def comparative(query: Column) -> Column:
    """The sides of a comparative question, struct(left, right), or null.

    A question is a row of words. Its first opening and the first joiner behind a word after that are found by position; the sides are what
    stands between them, and behind the joiner up to the end of the sentence. Without an opening the left side begins with the first letter.
    """
    # Each word with the white space behind it, so that a side keeps its own.
    words = F.split(F.regexp_replace(F.coalesce(query, F.lit("")), r"(?U)^\s+", ""), r"(?U)(?<=\s)(?=\S)")
    said = lambda w: F.transform(w, lambda x: F.lower(F.regexp_replace(x, r"(?U)\s+$", "")))
    return once(words, lambda w: once(said(w), lambda x: F.coalesce(*[_between(w, x, *kind) for kind in COMPARISONS])))


def comparative_sides(spark: SparkSession, query: str) -> tuple[str, str] | None:
    """``comparative`` of one question."""
    found = spark.range(1).select(comparative(F.lit(query)).alias("s")).first()["s"]
    return None if found is None else tuple(found)
