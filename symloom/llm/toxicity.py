"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word prefixes learns from confirmed toxic texts and
unlabelled texts only. With class prior p the risk is p * R+(positive) + max(0, R-(unlabelled) -
p * R-(positive)): the unlabelled texts' negative risk is corrected for the share of toxic texts
among them, and the correction is kept from going below zero (where it does, the step ascends it).

Defined cases: a null text is an empty text, which scores the bias; null labels are no labels; a
document labelled toxic and not toxic in repeated label rows counts as toxic; repeated rows are
scored each; with no confirmed toxic text every score is the prior; an empty table gives an empty
result; extra columns are ignored. A text is one chunk of work however long it is, at some 70 bytes
of memory a byte of text; ties in the hashes that choose a sample go by id, then by place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import limit_batches, remainder, text_bytes
from ._features import BITS, feature_lists, linear_scores, toxicity_features


@dataclass(frozen=True)
class ToxicityParams:
    #: Learning uses at most about these many texts of either kind, chosen by hash.
    max_positive: int = 4000
    max_unlabelled: int = 12000
    #: Share of toxic texts; None: the share among the labelled rows that may be learnt from.
    prior: float | None = None
    epochs: int = 150
    rate: float = 0.1
    l2: float = 1e-4
    #: A feature takes part if it is over `lift` times as frequent among the toxic texts as among the
    #: unlabelled ones, in at least `min_count` of them, and that by over `z` standard deviations.
    lift: float = 3.0
    min_count: int = 3
    z: float = 4.0
    threshold: float = 0.3


@dataclass
class LinearModel:
    weights: np.ndarray
    bias: float


def telling(positive: list[np.ndarray], unlabelled: list[np.ndarray], p: ToxicityParams, bits: int = BITS) -> np.ndarray:
    """Which features take part: rare ones would only let the unlabelled texts be learnt by heart."""
    a = np.bincount(np.concatenate(positive), minlength=1 << bits)
    expected = len(positive) * (np.bincount(np.concatenate(unlabelled), minlength=1 << bits) + 0.5) / len(unlabelled)
    return (a >= p.min_count) & (a > p.lift * expected) & (a - expected > p.z * np.sqrt(expected + 1))


def nnpu_fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, p: ToxicityParams, bits: int = BITS) -> LinearModel:
    """Fit by full-batch Adam on the non-negative risk with logistic loss; deterministic."""
    prior = min(max(prior, 1e-4), 0.9)
    base = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return LinearModel(np.zeros(1 << bits, np.float32), base)
    keep = telling(positive, unlabelled, p, bits)
    rows = [x[keep[x]] for x in positive + unlabelled]
    sizes = np.array([len(x) for x in rows])
    flat = np.concatenate(rows).astype(np.int64)
    used, index = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(rows)), sizes)
    n_pos, n_un = len(positive), len(unlabelled)
    w, bias = np.zeros(len(used)), base
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for step in range(1, p.epochs + 1):
        f = np.bincount(row, w[index], len(rows)) + bias
        s = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        fp, su = s[:n_pos], s[n_pos:]
        # logistic loss: l(+)' = s - 1, l(-)' = s
        negative = np.mean(np.logaddexp(0, f[n_pos:])) - prior * np.mean(np.logaddexp(0, f[:n_pos]))
        g = np.empty(len(rows))
        if negative >= 0:
            g[:n_pos] = prior / n_pos * (fp - 1) - prior / n_pos * fp
            g[n_pos:] = su / n_un
        else:
            g[:n_pos] = prior / n_pos * fp
            g[n_pos:] = -su / n_un
        gw = np.bincount(index, g[row], len(used)) + p.l2 * w
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w -= p.rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        bias -= p.rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    weights = np.zeros(1 << bits, np.float32)
    weights[used] = w
    return LinearModel(weights, float(bias))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, p: ToxicityParams = ToxicityParams()) -> LinearModel:
    """Learn from rows of docs for which `learn` holds (an expression over doc_id).

    Only bounded, hash-chosen samples of features reach the driver; copies of a text count once.
    """
    spark = docs.sparkSession
    limit_batches(spark)

    @F.arrow_udf("array<int>")
    def to_features(text: pa.Array) -> pa.Array:
        return feature_lists(text, toxicity_features)

    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_label, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1)), F.lit(0))).first()
    texts = docs.select("doc_id", text_bytes(F.col("text")).alias("text")).filter(learn)
    n_docs = docs.select("doc_id").filter(learn).count()
    prior = p.prior if p.prior is not None else (n_toxic / n_label if n_label else 0.01)

    def gathered(chosen: DataFrame, most: int) -> list[np.ndarray]:
        """The features of distinct texts, ordered by the hash of the text."""
        found = chosen.select(to_features("text").alias("features"), F.xxhash64("text").alias("of")).dropDuplicates(["of"]).toArrow()
        order = np.argsort(found.column("of").to_numpy(), kind="stable")
        lists = found.column("features").combine_chunks()
        pointers, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        return [values[pointers[i] : pointers[i + 1]] for i in order[:most]]

    # At most max_positive ids: these are broadcast, so that no text moves to be chosen.
    toxic = known.filter(F.col("toxic") == 1).orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(p.max_positive).select("doc_id")
    positive = gathered(texts.join(F.broadcast(toxic), "doc_id", "left_semi"), p.max_positive)
    # A copied text is taken or left as one.
    rate = min(1.0, p.max_unlabelled / max(n_docs, 1))
    mark = F.pmod(F.xxhash64(F.lit(7), "text"), F.lit(1 << 20))
    unlabelled = gathered(texts.filter(mark < F.lit(int(rate * (1 << 20)))), p.max_unlabelled)
    return nnpu_fit(positive, unlabelled, prior, p)


def scorer(spark: SparkSession, model: LinearModel, features=toxicity_features):
    """A column function: bytes of a text -> score from 0 to 1."""
    held = spark.sparkContext.broadcast((model.weights, model.bias))  # 2^BITS floats, whatever the input

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        weights, bias = held.value
        f = linear_scores(text, features, weights, bias)
        return pa.array(1 / (1 + np.exp(-np.clip(f, -500, 500))))

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams(), folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; rows whose remainder is held_out teach nothing."""
    learn = remainder(F.col("doc_id"), folds) != held_out
    model = fit(docs, labels, learn, p)
    score = scorer(docs.sparkSession, model)
    scored = docs.select("doc_id", score(text_bytes(F.col("text"))).alias("score"))
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id"), folds) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= p.threshold).cast("int").alias("predicted"),
    )
