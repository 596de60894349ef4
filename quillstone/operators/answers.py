"""Answers: the gate before a model is asked, its prompt, what its answer cites, and the payloads that callers get."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

# The least score of a best hit, why an answer is refused, what a refusal says, how much of an old answer is told again.
MIN_SCORE, HISTORY_CHARS = 0.15, 1200
WEAK, REFUSED = "weak_retrieval", "llm_insufficient"
REFUSAL = "Insufficient evidence in the current memory store to answer this question confidently."


class LanguageModel(Protocol):
    """What writes answers; ``generate_stream`` yields the same text in parts. Raises ``Unavailable``."""

    name: str

    def generate(self, prompt: str, system: str) -> str: ...

    def generate_stream(self, prompt: str, system: str) -> Iterator[str]: ...


class Unavailable(RuntimeError):
    """The model can't be asked."""


class Guarded:
    """A model that is asked no more once it couldn't be; without one, nothing is said."""

    def __init__(self, model: LanguageModel | None):
        self.model, self.name = model, getattr(model, "name", None)

    def says(self, prompt: str, system: str = "") -> str | None:
        """Its answer, or None."""
        if self.model is None:
            return None
        try:
            return self.model.generate(prompt, system)
        except Unavailable:
            self.model = None
            return None


def conversation_name(model: Guarded, question: str, answer: str) -> str | None:
    """A title of a few words for a conversation by its first turn, or None where the model has none to give."""
    short = lambda t, n: " ".join(t.split())[:n]
    said = model.says(f"Title this conversation.\nUser: {short(question, 300)}\nAssistant: {short(answer, 400)}\nTitle:")
    if said is None:
        return None
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().range(1).select(text.llm_title(F.lit(said)).alias("t")).first()["t"] or None


def evidence(hits: DataFrame) -> DataFrame:
    """Hits numbered from 1 by score, with evidence_id, locator and the parts of their metadata; ``hits`` are the few that retrieval kept."""
    columns = hits.columns
    given = lambda name, kind="string": F.col(name) if name in columns else F.lit(None).cast(kind)
    rows = sorted(hits.collect(), key=lambda r: (-r["score"], r["chunk_id"]))
    numbered = hits.sparkSession.createDataFrame([(*r, k) for k, r in enumerate(rows, 1)], T.StructType([*hits.schema.fields, T.StructField("__n", T.IntegerType())]))
    locator = text.parse_locator(given("metadata_json"))
    return numbered.withColumn("__locator", locator).select(
        F.col("__n").alias("n"), F.concat(F.lit("E"), F.col("__n").cast("string")).alias("evidence_id"), given("source_id").alias("source_id"), "chunk_id", given("source_type").alias("source_type"),
        given("source_uri").alias("source_uri"), given("title").alias("title"), F.col("__locator.modality").alias("modality"),
        F.coalesce(text.format_locator(given("source_uri"), F.col("__locator")), given("source_uri")).alias("locator"), F.col("__locator.page").alias("page"), F.col("__locator.ocr_confidence").alias("ocr_confidence"),
        given("subquery").alias("subquery"),
        F.struct(F.col("score").alias("combined"), *[given(c, "double").alias(name) for c, name in (("vector_score", "vector"), ("lexical", "lexical"), ("recency", "recency"), ("usage", "usage"), ("title_score", "title"))]).alias("scores"),
        F.col("text").alias("text"), text.preview(F.col("text")).alias("excerpt"),
    ).orderBy("n")


def abstains(hits: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """abstained, abstention_reason of a query's hits: no hits, or a best one below ``min_score``."""
    weak = F.coalesce(F.max("score"), F.lit(0.0)) < min_score
    weak = weak | (F.count("*") == 0)
    return hits.agg(weak.alias("abstained"), F.when(weak, WEAK).alias("abstention_reason"))


def evidence_block(numbered: DataFrame) -> DataFrame:
    """block: all evidence as numbered paragraphs, a head line and its text on one line each."""
    modality = F.when(F.coalesce("modality", F.lit("")) != "", F.concat("modality", F.lit(" | "))).otherwise("")
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("untitled"))
    head = F.concat(F.lit("["), "evidence_id", F.lit("] ("), F.coalesce("source_type", F.lit("")), F.lit(": "), title, F.lit(" | "), modality, F.lit("uri="), F.coalesce("locator", F.lit("")), F.lit(" | chunk_id="), F.col("chunk_id").cast("string"), F.lit(")\n"))
    flat = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    return numbered.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat(head, flat).alias("p")))), lambda s: s["p"]), "\n").alias("block"))


def prompt(query: str, block: str, history: str = "") -> str:
    """What a model is asked: history if there is any, evidence, question."""
    before = f"{history}\n\n" if history else ""
    evidence_lines = f"Evidence:\n{block}\n" if block else "Evidence:\n"
    return f"{before}{evidence_lines}\nQuestion: {query}\nAnswer (cite evidence ids inline):"


def history_blocks(turns: DataFrame, header: str = "Conversation so far:") -> DataFrame:
    """conversation_id, history: turns (turn_index, question, answer) in order, answers without citations and cut to ``HISTORY_CHARS``."""
    bare = text.strip_citations(F.col("answer"))
    cut = F.when(F.length(bare) > HISTORY_CHARS, F.concat(F.rtrim(F.substring(bare, 1, HISTORY_CHARS)), F.lit(" […truncated]"))).otherwise(bare)
    lines = F.concat(F.lit("User: "), "question", F.lit("\nAssistant: "), cut)
    told = F.transform(F.array_sort(F.collect_list(F.struct("turn_index", lines.alias("lines")))), lambda s: s["lines"])  # the last few turns
    return turns.groupBy("conversation_id").agg(F.concat_ws("\n", F.lit(header), F.array_join(told, "\n")).alias("history"))


def cited(answer: Column, n_evidence: Column) -> Column:
    """struct(cited_evidence_ids, invalid_citations) of an answer, as ``E#``."""
    parts = text.split_citations(text.citations(answer), n_evidence)
    names = lambda c: F.transform(c, lambda x: F.concat(F.lit("E"), x.cast("string")))
    return F.struct(names(parts["valid"]).alias("cited_evidence_ids"), names(parts["invalid"]).alias("invalid_citations"))


def _evidence_rows(numbered: DataFrame, cited_ids: list[str] | None) -> list[dict]:
    out = []
    for r in numbered.collect():  # the hits of one query
        row = r.asDict(recursive=True)
        row.pop("n")
        row.pop("text")
        if cited_ids is None:
            for name in ("subquery", "excerpt"):
                row.pop(name)
            row["scores"].pop("title")
        else:
            row["cited"] = row["evidence_id"] in cited_ids
        out.append(row)
    return out


def _payload(query: str, found: list[dict], seconds: float | None, generated: float | None, **answer: Any) -> dict:
    spent = lambda s: None if s is None else round(s, 3)
    base = {"query": query, "model": None, "abstained": False, "abstention_reason": None, "truncated": False, "answer": None}
    return {**base, **answer, "timing": {"total_seconds": spent(seconds), "generation_seconds": spent(generated)}, "evidence": found}


def template_payload(query: str, hits: DataFrame, seconds: float | None = None) -> dict:
    """Evidence without an answer; it abstains only where there is none."""
    found = _evidence_rows(evidence(hits), None)
    return _payload(query, found, seconds, None, abstained=not found, abstention_reason=None if found else WEAK)


def answer_payload(query: str, hits: DataFrame, model: LanguageModel | None, system: str = "", history: str = "", min_score: float = MIN_SCORE, matched: DataFrame | None = None) -> dict:
    """The answer of a model with its evidence; the template where there is no model or it can't be asked.

    Weak evidence is refused before the model is asked.
    """
    *_, last = answer_events(query, hits, model, system, history, min_score, matched)
    return last["payload"]


def answer_events(query: str, hits: DataFrame, model: LanguageModel | None, system: str = "", history: str = "", min_score: float = MIN_SCORE, matched: DataFrame | None = None) -> Iterator[dict]:
    """The parts of an answer as they come, then one record with the whole payload."""
    extra = {} if matched is None else {"matched_nodes": [r.asDict() for r in matched.select("node_id", "level", "node_type", "title", "centrality", "score").collect()]}
    numbered = evidence(hits)
    gate = abstains(hits, min_score).first()
    if model is not None and gate["abstained"]:
        found = _evidence_rows(numbered, [])
        yield {"type": "final", "payload": _payload(query, found, None, None, model=model.name, abstained=True, abstention_reason=WEAK, answer=REFUSAL, cited_evidence_ids=[], invalid_citations=[]) | extra}
        return
    if model is not None:
        asked, parts = prompt(query, evidence_block(numbered).first()["block"], history), []
        try:
            for part in model.generate_stream(asked, system) if hasattr(model, "generate_stream") else [model.generate(asked, system)]:
                parts.append(part)
                yield {"type": "token", "text": part}
        except Unavailable:
            pass
        else:
            said = "".join(parts)
            ids = hits.sparkSession.range(1).select(cited(F.lit(said), F.lit(hits.count())).alias("c")).first()["c"]
            refused = said.strip() == REFUSAL
            found = _evidence_rows(numbered, ids["cited_evidence_ids"])
            yield {"type": "final", "payload": _payload(query, found, None, None, model=model.name, answer=said, abstained=refused, abstention_reason=REFUSED if refused else None, truncated=getattr(model, "last_done_reason", None) == "length", **ids.asDict()) | extra}
            return
    yield {"type": "final", "payload": template_payload(query, hits) | extra}


def gates(queries: DataFrame, hits: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``queries`` (query_id) with abstained and abstention_reason: no ``hits`` (query_id, score), or a best one below ``min_score``."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("__best"))
    weak = F.coalesce(F.col("__best"), F.lit(-1.0)) < min_score
    return queries.join(best, "query_id", "left").withColumn("abstained", weak).withColumn("abstention_reason", F.when(weak, WEAK)).drop("__best")
