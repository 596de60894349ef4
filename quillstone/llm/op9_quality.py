"""Quality classifier by positive-unlabelled learning.

The model sees style only: what characters, words and lines a whole text is made of.
Each of these figures is cut into bins, and a weight per bin is learnt by minimising the
non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

with logistic loss, from trusted positives (labelled 1, not held out) and unlabelled
documents. The class prior is estimated from the same two samples (``class_prior``).

Fitting takes a bounded sample (``positives``, ``unlabelled`` rows with the smallest hashes of
doc_id); scoring reads every whole text in one pass without a shuffle.

Defined results: null text counts as empty and gets a score like any; a doc_id of null
is never learnt from; repeated rows score alike, and equal texts tie; very long texts are read whole; without a positive label every score is
0.5; an empty table gives no rows; other columns are kept by ``score`` and ``select``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BINS = 12
#: All bytes but the marks that prose seldom has.
_PLAIN = bytes(b for b in range(256) if b not in _MARKS or b in b",.'-")


def figures(text: str | None) -> list[float]:
    """Style of a whole text."""
    raw = (text or "").encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    n = max(1.0, float(len(raw)))
    upper, lower, digit, other = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum(), counts[128:].sum()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    w, k = max(1, len(words)), max(1, len(lines))
    seen: dict[bytes, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    lettered = max(1.0, upper + lower)
    ends = counts[33] + counts[46] + counts[63]
    out = [
        np.log1p(len(raw)), np.log1p(len(words)), len(raw) / w, len(seen) / w ** 0.8, max(seen.values(), default=0) / w,
        np.log1p(len(lines)), len(raw) / k, len(set(lines)) / k, upper / lettered, digit / n, other / n, counts[32] / n, counts[10] / n, counts[9] / n,
        sum(x.isupper() for x in words) / w, sum(x[-1:].isalpha() or x[-1] >= 128 for x in words) / w, sum(x[:1].isupper() for x in words) / w,
        max(map(len, words), default=0), sum(len(x) == 1 for x in words) / w, ends / w, (counts[list(_MARKS)].sum() - counts[44] - counts[46]) / n,
    ]
    again = [a == b for a, b in zip(words, words[1:], strict=False)]
    run = longest = 0
    for same in again:
        run = run + 1 if same else 0
        longest = max(longest, run)
    marked = [len(x.translate(None, _PLAIN)) / len(x) for x in lines]
    out += [sum(again) / w, np.log1p(longest), max(marked, default=0), min(marked, default=0)]
    out += [counts[m] / n for m in _MARKS]
    return [float(x) for x in out]


def _figure_frame(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [figures(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float32()))], names=["figures"])

    return docs.select("text").mapInArrow(run, "figures array<float>")


class Model:
    """Bin edges per figure and a weight per bin."""

    def __init__(self, edges: list[np.ndarray], weights: np.ndarray, bias: float):
        self.edges, self.weights, self.bias = edges, weights, bias

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Index of the weight of each figure's bin."""
        cols = [np.searchsorted(e, x[:, k], "right") + k * BINS for k, e in enumerate(self.edges)]
        return np.stack(cols, axis=1) if len(x) else np.zeros((0, len(self.edges)), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        f = self.weights[self.bins(x)].sum(axis=1) + self.bias
        return 1 / (1 + np.exp(-np.clip(f, -40, 40)))


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -40, 40)))


def risk_and_slopes(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk of scores of positives and unlabelled rows, and how to descend: slopes by score.

    Where the negatives' part is below zero it has been overfitted: the slopes step back along that part.
    """
    sp, su = _sigmoid(fp), _sigmoid(fu)
    negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    risk = prior * np.logaddexp(0, -fp).mean() + max(0.0, negative)
    if negative < 0:
        return risk, prior * sp / len(fp), -su / len(fu)
    return risk, prior * (sp - 1) / len(fp) - prior * sp / len(fp), su / len(fu)


def _descend(positive: np.ndarray, unlabelled: np.ndarray, bias: float, slopes, steps: int, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Fit a model by Adam on full batches; the same input gives the same model."""
    both = np.concatenate([positive, unlabelled])
    edges = [np.unique(np.quantile(both[:, k], np.linspace(0, 1, BINS + 1)[1:-1])).astype(np.float32) for k in range(both.shape[1])]
    model = Model(edges, np.zeros(both.shape[1] * BINS), bias)
    p, u = model.bins(positive), model.bins(unlabelled)
    m, v = np.zeros(len(model.weights) + 1), np.zeros(len(model.weights) + 1)

    def gathered(rows: np.ndarray, g: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(rows.ravel(), np.repeat(g, rows.shape[1]), len(model.weights)), g.sum())

    for t in range(1, steps + 1):
        gp, gu = slopes(*(model.weights[r].sum(axis=1) + model.bias for r in (p, u)))
        grad = gathered(p, gp) + gathered(u, gu)
        grad[:-1] += decay * model.weights
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        model.weights -= step[:-1]
        model.bias -= step[-1]
    return model


def nn_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1000) -> Model:
    """Minimise the non-negative risk."""
    return _descend(positive, unlabelled, float(np.log(prior / (1 - prior))), lambda fp, fu: risk_and_slopes(fp, fu, prior)[1:], steps)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, folds: int = 5, steps: int = 100, errors: float = 2.0) -> float:
    """The share of positives among unlabelled rows, from these alone.

    Every fold is scored by a model that tells positives from unlabelled rows, fitted on the other folds. The share of
    unlabelled rows above a bound over that of positives above it is the prior plus what negatives score so high, so the ratio that is
    surely least (two standard errors added) is nearest to it, and never below but by chance; as many errors are taken off.
    """
    if len(positive) < folds or len(unlabelled) < folds:
        return 0.5
    rng = np.random.default_rng(5)
    p, u = (x[rng.permutation(len(x))] for x in (positive, unlabelled))
    sp, su = np.zeros(len(p)), np.zeros(len(u))
    for k in range(folds):
        own_p, own_u = np.arange(len(p)) % folds == k, np.arange(len(u)) % folds == k
        model = _descend(p[~own_p], u[~own_u], 0.0, lambda fp, fu: ((_sigmoid(fp) - 1) / len(fp), _sigmoid(fu) / len(fu)), steps)
        sp[own_p], su[own_u] = model.score(p[own_p]), model.score(u[own_u])
    bounds = np.quantile(sp, np.linspace(0.02, 0.9, 89))
    above_p, above_u = (1 - np.searchsorted(np.sort(s), bounds) / len(s) for s in (sp, su))
    some = (above_p > 0) & (above_u > 0)
    above_p, above_u = above_p[some], above_u[some]
    if not some.any():
        return 0.5
    ratios = above_u / above_p
    error = ratios * np.sqrt((1 - above_p) / (above_p * len(p)) + (1 - above_u) / (above_u * len(u)))
    k = int(np.argmin(ratios + errors * error))
    return float(np.clip(ratios[k] - errors * error[k], 0.02, 0.98))


def held_out(doc_id) -> F.Column:
    """Whether labels of this document are kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, positives: int = 8000, unlabelled: int = 16000) -> tuple[Model | None, float]:
    """(model, prior) from at most so many rows of each kind; labelled negatives aren't used."""
    train = labels.where(~held_out(F.col("doc_id"))).where("quality = 1 and doc_id is not null")
    by_hash = lambda df, n: df.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    texts = docs.select("doc_id", "text")

    def sample(ids: DataFrame) -> np.ndarray:
        # A doc_id may have many rows; one of them is taken, the same everywhere.
        rows = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("r"))
        found = [r[0] for r in _figure_frame(rows.select("r.text")).collect()]  # at most the sample's size
        return np.array(found, np.float32).reshape(len(found), -1) if found else np.zeros((0, 1), np.float32)

    p = sample(by_hash(train, positives))
    u = sample(by_hash(texts.where(~held_out(F.col("doc_id"))), unlabelled))
    if not len(p) or not len(u):
        return None, 0.5
    p, u = (x[np.lexsort(x.T)] for x in (p, u))  # the order of rows doesn't matter
    prior = class_prior(p, u)
    return nn_pu(p, u, prior), prior


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **sample) -> DataFrame:
    """``docs`` with score and predicted added (columns of these names, in any case, are replaced)."""
    model, prior = fit(docs, labels, **sample)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.drop("score", "predicted")
    names = plain.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            x = np.array([figures(t) for t in texts], np.float32)
            s = sent.value.score(x) if sent.value and len(texts) else np.full(len(texts), prior)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return plain.mapInArrow(run, schema)


def select(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **sample) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, with all their columns unchanged."""
    own = {c: f"__own_{c}" for c in docs.columns if c.lower() in ("score", "predicted")}
    scored = score(docs.withColumnsRenamed(own), labels, threshold, **sample)
    return scored.where("predicted = 1").select([F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op9_quality``: a score for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score(docs, labels).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
