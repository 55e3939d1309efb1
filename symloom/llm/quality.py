"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL-Proximal.

Follow-the-regularised-leader keeps z and n per feature; the weight of a feature is 0 while |z| is
within l1 and -(z - sign(z) l1) / ((beta + sqrt(n)) / alpha + l2) otherwise. A document's score is
the sigmoid of a sparse dot product over its distinct n-grams.

Defined cases: a null text is an empty text, which scores the bias; null labels are no labels;
repeated label rows of one document teach once, by their highest label; repeated rows are scored
each; with no label every score is 0.5; an empty table gives an empty result; extra columns are
ignored. A text is one chunk of work however long it is, at some 90 bytes of memory a byte of text;
labels that tie in the hash that chooses a sample go by doc_id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import limit_batches, remainder, text_bytes
from ._features import BITS, feature_lists, quality_features
from .toxicity import LinearModel, scorer


@dataclass(frozen=True)
class QualityParams:
    #: Learning uses at most about so many labelled texts, chosen by hash.
    max_rows: int = 16000
    epochs: int = 3
    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 1.0
    threshold: float = 0.3


def ftrl_fit(rows: list[np.ndarray], labels: np.ndarray, p: QualityParams, bits: int = BITS) -> LinearModel:
    """One pass per epoch in the order given; the bias is a feature of every row, without l1."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        l1 = np.where(i == size - 1, 0.0, p.l1)
        w = -(zi - np.sign(zi) * l1) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    every = [np.append(r, size - 1).astype(np.int64) for r in rows]
    for _ in range(p.epochs):
        for i, y in zip(every, labels, strict=True):
            w = weight(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            root = np.sqrt(n[i])
            n[i] += g * g
            z[i] += g - (np.sqrt(n[i]) - root) / p.alpha * w
    used = np.flatnonzero(z)
    weights = np.zeros(size)
    weights[used] = weight(used)
    return LinearModel(weights[:-1].astype(np.float32), float(weights[-1]))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, p: QualityParams = QualityParams()) -> LinearModel:
    """Learn from labelled rows for which `learn` holds; only a bounded sample of features reaches the driver."""
    limit_batches(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def to_features(text: pa.Array) -> pa.Array:
        return feature_lists(text, quality_features)

    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # At most max_rows ids: these are broadcast, so that no text moves to be chosen.
    chosen = known.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(p.max_rows)
    rows = docs.select("doc_id", text_bytes(F.col("text")).alias("text")).join(F.broadcast(chosen), "doc_id")
    found = rows.select(to_features("text").alias("features"), F.col("quality").cast("int").alias("quality"), F.xxhash64("doc_id", "text").alias("of")).toArrow()
    order = np.argsort(found.column("of").to_numpy(), kind="stable")[: p.max_rows]
    if not len(order):
        return LinearModel(np.zeros(1 << BITS, np.float32), 0.0)
    lists = found.column("features").combine_chunks()
    pointers, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    y = (found.column("quality").to_numpy() == 1).astype(float)
    return ftrl_fit([values[pointers[i] : pointers[i + 1]] for i in order], y[order], p)


def quality_scores(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams(), folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; rows whose remainder is held_out teach nothing."""
    learn = remainder(F.col("doc_id"), folds) != held_out
    model = fit(docs, labels, learn, p)
    score = scorer(docs.sparkSession, model, quality_features)
    scored = docs.select("doc_id", score(text_bytes(F.col("text"))).alias("score"))
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id"), folds) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= p.threshold).cast("int").alias("predicted"),
    )
