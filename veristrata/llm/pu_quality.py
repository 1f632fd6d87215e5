"""Document quality by positive-unlabelled learning.

Documents labelled good are trusted positives; every other document of the
sample is unlabelled, whatever its own label.  A linear scorer over surface
measures and hashed words minimises the non-negative unbiased risk
``p R+(P) + max(0, R-(U) - p R-(P))`` with the logistic loss: where the bracket
falls below zero, the step goes the other way, so the model cannot fit the
unlabelled rows by memory.  The class prior ``p`` is estimated from the
scores of a first model: over thresholds, the least ratio of the unlabelled
to the positive share above.

Fitted on a bounded sample (``POSITIVES``, ``UNLABELLED``), applied to every
whole text in one narrow pass.

Defined results: null and empty texts are scored like any other, from the
measures of an empty text; without positive labels every score is 0.5; repeated
labels of a document count once, and it is good if any of them is (null ones are
no label); repeated rows are scored each; very long texts are scored whole; rows
that tie in the sample's order are alike; an empty table gives an empty result;
extra columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.llm.quality_rules import duplicate_lines, repeat_words
from veristrata.llm.session import bounded_batches, crc_mod, table, with_bytes
from veristrata.llm.words import Chunk, chunks

POSITIVES, UNLABELLED = 2000, 3000
HASHED = 128
STEPS, RATE, DECAY = 250, 0.05, 1e-3
THRESHOLD = 0.3

_TABLES = []
for _set in (b"|", b"#$%&*", b"!?", b".,;:", bytes(range(48, 58)), bytes(range(65, 91)), b"<>{}[]=_/\\", bytes(range(128, 256))):
    _t = np.zeros(256, bool)
    _t[list(_set)] = True
    _TABLES.append(_t)
N_SURFACE = len(_TABLES) + 8


def features(chunk: Chunk) -> np.ndarray:
    """A row per text: surface measures, then shares of hashed words."""
    hashes = chunk.word_hash()
    words = np.maximum(chunk.n_words, 1)
    size = np.maximum(np.diff(chunk.offsets), 1)
    lines, again = duplicate_lines(chunk)
    n = len(hashes)
    keyed = np.unique(hashes ^ (chunk.doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True)[1]
    distinct = np.bincount(chunk.doc[keyed], minlength=chunk.n)
    same = np.zeros(n, bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (chunk.doc[1:] == chunk.doc[:-1])
    lengths = (chunk.ends - chunk.starts).astype(float)
    columns = [chunk.count_bytes(t) / size for t in _TABLES]
    columns += [
        np.log1p(chunk.n_words) / 10,
        distinct / words,
        repeat_words(chunk, hashes) / words,
        again / np.maximum(lines, 1),
        chunk.per_doc(same) / words,
        chunk.per_doc(lengths) / words / 10,
        chunk.per_doc(lengths > 15) / words,
        np.log1p(lines) / 10,
    ]
    bag = np.bincount(chunk.doc * HASHED + (hashes % np.uint64(HASHED)).astype(np.int64), minlength=chunk.n * HASHED).reshape(chunk.n, HASHED)
    return np.concatenate([np.stack(columns, axis=1), np.sqrt(bag / words[:, None])], axis=1).astype(np.float32)


def _softplus(z):
    return np.logaddexp(0.0, z)


def _sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * z))


class Scorer:
    """A linear model of standardised features with squared surface terms."""

    def __init__(self, center=None, scale=None, weight=None, bias: float = 0.0):
        self.center, self.scale, self.weight, self.bias = center, scale, weight, bias

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -8, 8)
        return np.concatenate([z, np.abs(z[:, :N_SURFACE])], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.inputs(x) @ self.weight + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), 0.5) if self.weight is None else _sigmoid(self.margin(x).astype(float))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The least ratio, over thresholds that half of the positives exceed, of shares above them."""
    cuts = np.quantile(positive, np.linspace(0, 0.5, 26))
    above = [(unlabelled > c).mean() / (positive > c).mean() for c in cuts if (positive > c).mean() >= 0.4]
    return float(np.clip(min(above, default=0.5), 0.05, 0.99))


def nnpu(p: np.ndarray, u: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the non-negative risk; ``p`` and ``u`` are model inputs."""
    w, b = np.zeros(p.shape[1], np.float32), 0.0
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        zp, zu = p @ w + b, u @ w + b
        negative = _softplus(zu).mean() - prior * _softplus(zp).mean()
        # Derivatives of the mean losses by each row's margin.
        up, down_p, down_u = (_sigmoid(zp) - 1) / len(p), _sigmoid(zp) / len(p), _sigmoid(zu) / len(u)
        if negative >= 0:
            dp, du = prior * (up - down_p), down_u
        else:
            dp, du = prior * down_p, -down_u
        g = np.append(p.T @ dp + u.T @ du + DECAY * w, dp.sum() + du.sum())
        first += 0.1 * (g - first)
        second += 0.01 * (g * g - second)
        move = RATE * (1 - step / (STEPS + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Scorer:
    if not len(positive) or not len(unlabelled):
        return Scorer()
    both = np.concatenate([positive, unlabelled])
    model = Scorer(both.mean(axis=0), both.std(axis=0) + 1e-3)
    p, u = model.inputs(positive), model.inputs(unlabelled)
    # A first model at an even prior ranks the rows, which is all the estimate needs; half of the positives are held back for it.
    half = len(p) // 2 or len(p)
    w, b = nnpu(p[:half], u, 0.5)
    rest = p[half:] if len(p) > half else p
    model.prior = estimate_prior(rest @ w + b, u @ w + b)
    model.weight, model.bias = nnpu(p, u, model.prior)
    return model


def _rows(docs: DataFrame, *keep: str) -> DataFrame:
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(c).tobytes() for _, _, c in chunks(batch.column(batch.num_columns - 1))]
            width = 4 * (N_SURFACE + HASHED)
            rows = [f[i : i + width] for f in found for i in range(0, len(f), width)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.binary())], names=[*keep, "x"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return with_bytes(docs, *keep).mapInArrow(run, f"{kinds}, x binary")


def training_rows(docs: DataFrame, labels: DataFrame, learn) -> tuple[np.ndarray, np.ndarray]:
    """Features of a bounded seeded sample: trusted positives, and documents as they come."""
    spark = docs.sparkSession
    order = F.xxhash64(F.lit("pu"), F.col("doc_id"))
    good = labels.where((F.col("quality") == 1) & learn).select("doc_id").distinct().orderBy(order, "doc_id").limit(POSITIVES)
    some = docs.where(learn).select("doc_id").orderBy(F.xxhash64(F.lit("any"), F.col("doc_id")), "doc_id").limit(UNLABELLED)
    ids = [(r.doc_id, 1) for r in good.collect()] + [(r.doc_id, 0) for r in some.collect()]
    if not ids:
        return np.zeros((0, N_SURFACE + HASHED)), np.zeros((0, N_SURFACE + HASHED))
    chosen = spark.createDataFrame(sorted(set(ids)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, positive int")
    found = _rows(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "doc_id", "positive").orderBy("doc_id", "positive").collect()
    take = lambda k: np.array([np.frombuffer(r.x, np.float32) for r in found if r.positive == k]).reshape(-1, N_SURFACE + HASHED)
    return take(1), take(0)


def score_documents(docs: DataFrame, model: Scorer, *keep: str) -> DataFrame:
    """``keep`` and ``score`` of every whole text."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(features(c)) for _, _, c in chunks(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*keep, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return with_bytes(docs, *keep).mapInArrow(run, f"{kinds}, score double")


def op10_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = crc_mod("doc_id", 5)
    model = fit(*training_rows(docs, table(spark, sf_dir, "labels"), part != 0))
    scored = score_documents(docs.select("doc_id", "text", F.coalesce(part == 0, F.lit(False)).alias("held_out")), model, "doc_id", "held_out")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
