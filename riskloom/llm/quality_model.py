"""Operator 4: quality classifier, histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import pieces, table
from riskloom.llm.statistics import NAMES, statistics

#: The trees are fitted on at most so many labelled documents, the first by hash of doc_id. Scoring covers all documents.
SAMPLE = 20_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
TREES, DEPTH, BINS, RATE, L2 = 60, 4, 64, 0.15, 1.0


@dataclass
class Trees:
    """Complete binary trees as arrays: node i has children 2 i + 1 and 2 i + 2; values of the leaves stand apart."""

    feature: np.ndarray  # trees x (2**depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # trees x 2**depth
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """All trees at once, level by level; 0 to 1."""
        trees, inner = self.feature.shape
        total = np.full(len(x), self.prior)
        if trees and len(x):
            node, t, r = np.zeros((len(x), trees), np.int64), np.arange(trees)[None, :], np.arange(len(x))[:, None]
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (x[r, self.feature[t, node]] > self.threshold[t, node])
            total = total + self.leaf[t, node - inner].sum(1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, l2: float = L2) -> Trees:
    """Boosts trees on the logistic loss. Features are cut into quantile bins once; each level of a tree sums gradients
    and curvatures per node, feature and bin, and splits every node where the gain is largest."""
    inner, n, m = 2**depth - 1, *x.shape
    mean = float(np.clip(y.mean(), 0.01, 0.99)) if n else 0.5
    prior = float(np.log(mean / (1 - mean)))
    if n == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)), prior)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for j in range(m)]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)  # code <= k: x <= cuts[k]
    total, feature, threshold, leaf = np.full(n, prior), np.zeros((trees, inner), np.int64), np.zeros((trees, inner), np.float32), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, curve, node = y - p, np.maximum(p * (1 - p), 1e-6), np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = (((node - first)[:, None] * m + np.arange(m)) * bins + code).ravel()
            g = np.bincount(at, np.repeat(grad, m), width * m * bins).reshape(width, m, bins).cumsum(2)
            h = np.bincount(at, np.repeat(curve, m), width * m * bins).reshape(width, m, bins).cumsum(2)
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + l2) + (gt - g) ** 2 / (ht - h + l2) - gt**2 / (ht + l2)
            gain[(h < 1) | (ht - h < 1)] = 0
            for j, c in enumerate(cuts):
                gain[:, j, len(c) :] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k, b in enumerate(best.tolist()):
                j, cut = divmod(b, bins)
                split = gain[k, j, cut] > 1e-9
                feature[t, first + k], threshold[t, first + k] = (j, cuts[j][cut]) if split else (0, np.float32(np.inf))
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        g, h = np.bincount(node - inner, grad, inner + 1), np.bincount(node - inner, curve, inner + 1)
        leaf[t] = rate * g / (h + l2)
        total = total + leaf[t, node - inner]
    return Trees(feature, threshold, leaf, prior)


def fold(column, folds: int):
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def _measure(batches):
    for batch in pieces(batches, "text"):
        x = statistics(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(list(x), pa.list_(pa.float32()))], names=["quality", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Fits the trees on labelled documents outside the held-out fold. The sample is chosen among the labels by hash; its
    ids, whose number is bounded by `sample`, are sent to the documents, so that no text is shuffled."""
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("quality").cast("int").alias("quality"), "text").mapInArrow(_measure, "quality int, x array<float>").toArrow()
    y = np.asarray(rows.column("quality").combine_chunks(), float)
    x = np.asarray(rows.column("x").combine_chunks().flatten(), np.float32).reshape(-1, len(NAMES))
    order = np.lexsort([*x.T, y])  # the order in which tasks end must not matter
    return fit(x[order], y[order])


def score(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """Adds score (0 to 1) and predicted to documents; other columns stay."""
    docs = docs.drop("score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for batch in pieces(batches, "text"):
            s = sent.value.scores(statistics(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "score double, predicted int"])
    return docs.mapInArrow(run, schema)


def classify_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Adds held_out, score and predicted to documents (doc_id, text and any other columns).

    Null and empty texts are scored from zero statistics. With no usable label the score is the prior 0.5; with labels of
    one kind it is their clipped share. Rows that repeat are scored alike, a doc_id with several labels counts once (its
    largest). An empty table gives an empty table; columns of the three names are replaced.
    """
    out = score(docs.drop("held_out"), train(docs, labels, sample), threshold)
    return out.withColumn("held_out", fold("doc_id", FOLDS) == HELD_OUT)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
