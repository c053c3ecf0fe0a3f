"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

fit(): of the labelled rows at most max_labelled (a documented bound, by hash of the
id) become neighbours. Whole texts become counts of hashed byte trigrams and a few
shape terms; damped counts times inverse document frequency are projected on the
leading right singular vectors of the labelled matrix. The projection and the labelled
vectors (at most max_labelled x rank floats) are broadcast.

score(): every document's vector is compared with every labelled vector by blocked
matrix products (exact cosines); the k largest vote with weight cosine ** power.

Null and empty texts have a zero vector and get the labelled rows' mean label, as does
any text without a positive cosine. Without labelled rows the score is 0.5 and
`fitted` false. A row in, a row out; ties between neighbours go to the earlier one in
the order of ids as text; labels that contradict each other count as the lower one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, blocks, gram_counts, id_remainder, map_arrow, table

DIMS = 4096
SHAPE_BINS = 12
SHAPES = 7
SHAPE_WEIGHT = 8.0


def shape_terms(texts: list[bytes], counts: np.ndarray) -> np.ndarray:
    """One-hot bins of seven shares: concentration of trigrams, words equal to the next, symbols, bars, capitals, digits, line ends."""
    out = np.zeros((len(texts), SHAPES * SHAPE_BINS), np.float32)
    total = np.maximum(counts.sum(1), 1)
    focus = np.sqrt(np.maximum(0, (counts.astype(np.float64) ** 2).sum(1) / total**2 - 1 / total))  # what chance alone gives is taken off
    for i, t in enumerate(texts):
        n, words = max(1, len(t)), t.split()
        shares = [
            focus[i],
            sum(map(eq, words, islice(words, 1, None))) / max(1, len(words)),
            (n - len(t.translate(None, b"#*$%&!<>")) if t else 0) / n,
            t.count(b"|") * 4 / n,
            (n - len(t.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")) if t else 0) / n,
            (n - len(t.translate(None, b"0123456789")) if t else 0) / n,
            t.count(b"\n") * 8 / n,
        ]
        for j, x in enumerate(shares):
            out[i, j * SHAPE_BINS + min(SHAPE_BINS - 1, int(np.sqrt(x) * SHAPE_BINS))] = SHAPE_WEIGHT
    return out


def features(texts: list[bytes]) -> np.ndarray:
    counts = gram_counts(texts, DIMS)
    return np.hstack([np.log1p(counts), shape_terms(texts, counts)])


def nearest(near: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values of each row; where equal ones stand on both sides of the cut, the earlier places."""
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    held = np.take_along_axis(near, top, 1)
    least = held.min(1, keepdims=True)
    for i in np.flatnonzero((near == least).sum(1) > (held == least).sum(1)):
        top[i] = np.argsort(-near[i], kind="stable")[:k]
    return top


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    k: int
    power: float

    def project(self, x: np.ndarray) -> np.ndarray:
        y = (x * self.idf) @ self.basis
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[bytes]) -> np.ndarray:
        prior = float(self.labels.mean())
        near = self.project(features(texts)) @ self.vectors.T
        k = min(self.k, near.shape[1])
        top = nearest(near, k)
        weight = np.maximum(np.take_along_axis(near, top, 1), 0) ** self.power
        voted = (weight * self.labels[top]).sum(1)
        total = weight.sum(1)
        empty = np.array([not t.strip() for t in texts])
        return np.clip(np.where((total <= 0) | empty, prior, voted / np.maximum(total, 1e-30)), 0, 1)


def latent(x: np.ndarray, rank: int, seed: int = 7) -> np.ndarray:
    """Leading right singular vectors, by a randomised range finder with power iterations."""
    rank = min(rank, *x.shape)
    rng = np.random.default_rng(seed)
    q = x @ rng.standard_normal((x.shape[1], min(rank + 16, x.shape[0]))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x @ (x.T @ q))
    q, _ = np.linalg.qr(q)
    return np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T.astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 2000, rank: int = 48, k: int = 15, power: float = 6.0) -> Model | None:
    """docs: doc_id, text; labels: doc_id, label. At most max_labelled rows reach the driver, as feature vectors."""
    named = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = named.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = as_bytes(batch.column(1))
        for a, b in blocks([len(t) for t in texts]):
            x = features(texts[a:b]).astype(np.float16)
            yield {"doc_id": batch.column(0)[a:b].cast(pa.string()), "label": batch.column(2)[a:b].cast(pa.float64()), "x": [r.tobytes() for r in x]}

    got = sorted(map_arrow(rows.select("doc_id", "text", "label"), work, "doc_id string, label double, x binary").collect(), key=lambda r: r.doc_id)
    if not got:
        return None
    x = np.stack([np.frombuffer(r.x, np.float16) for r in got]).astype(np.float32)
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    weighted = x * idf
    basis = latent(weighted, rank)
    model = Model(idf, basis, np.zeros((0, 0)), np.array([r.label for r in got]), k, power)
    model.vectors = model.project(x)
    return model


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, fitted."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if model is None:
        return docs.select("doc_id", F.lit(0.5).alias("score"), F.lit(False).alias("fitted"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = as_bytes(batch.column(1))
        for a, b in blocks([len(t) for t in texts]):
            yield {"doc_id": batch.column(0)[a:b], "score": held.value.score(texts[a:b]), "fitted": [True] * (b - a)}

    return map_arrow(docs.select("doc_id", "text"), work, f"doc_id {kind}, score double, fitted boolean")


def good_documents(docs: DataFrame, model: Model | None, threshold: float) -> DataFrame:
    """The rows that score at least threshold, with all their columns; all rows without a model."""
    if model is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    names = [f"c{i}" for i in range(len(docs.columns))]

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = as_bytes(batch.column(at))
        for a, b in blocks([len(t) for t in texts]):
            ok = pa.array(held.value.score(texts[a:b]) >= threshold)
            yield {name: column[a:b].filter(ok) for name, column in zip(names, batch.columns, strict=True)}

    schema = ", ".join(f"{name} {f.dataType.simpleString()}" for name, f in zip(names, docs.schema, strict=True))
    return map_arrow(docs.toDF(*names), work, schema).toDF(*docs.columns)


THRESHOLD = 0.7


def train_rows(labels: DataFrame) -> DataFrame:
    return labels.filter(id_remainder(F.col("doc_id"), 4) != 2).select("doc_id", F.col("quality").alias("label"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, train_rows(table(spark, sf_dir, "labels"))))
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
