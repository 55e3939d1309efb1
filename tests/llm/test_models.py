"""The classifiers against plain Python: features, fitting and scores, one text and one weight at a time."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest

from symloom.llm import quality, toxicity
from symloom.llm._features import _BASE, BITS

from .texts import DOCS, crc_mod, small_docs

M64 = 1 << 64
WORD, VISIBLE = rb"[0-9A-Za-z\x80-\xff]+", rb"[!-/:-@\[-`{-~]+"


def mixed(h):
    h = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) % M64
    return h ^ (h >> 29)


def hashed(token: bytes, salt: int) -> int:
    return mixed((sum((b + 1) * pow(_BASE, i, M64) for i, b in enumerate(token)) + salt * 0x632BE59BD9B4E019) % M64)


def slots(hashes) -> list[int]:
    return sorted({h >> (64 - BITS) for h in hashes})


def toxic_features(text: bytes) -> list[int]:
    words = re.findall(WORD, text.lower())
    return slots([hashed(w, 1) for w in words] + [hashed(w[:n], n) for w in words for n in (4, 5, 6) if len(w) > n])


def quality_features(text: bytes) -> list[int]:
    found = [(m.start(), m.end(), m[0]) for m in re.finditer(WORD + b"|" + VISIBLE, text)]
    h = [hashed(w, 1) for _, _, w in found]
    capital = lambda b: 65 <= b <= 90
    shape = [x if re.match(VISIBLE, w) else 64 + (2 * capital(w[0]) + capital(w[-1])) * 16 + min(b - a, 15) for x, (a, b, w) in zip(h, found)]
    pairs = [mixed((y * 3 + x) % M64) for x, y in zip(h, h[1:])]
    shapes = [mixed((mixed((y + 0x51ED270B) % M64) * 5 + mixed(x) + (p[1] == q[0])) % M64) for x, y, p, q in zip(shape, shape[1:], found, found[1:])]
    return slots(h + pairs + shapes)


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def plain_nnpu(positive, unlabelled, prior, p):
    expected = {}
    for x in unlabelled:
        for f in x:
            expected[f] = expected.get(f, 0) + 1
    count = {}
    for x in positive:
        for f in x:
            count[f] = count.get(f, 0) + 1
    kept = set()
    for f, a in count.items():
        e = len(positive) * (expected.get(f, 0) + 0.5) / len(unlabelled)
        if a >= p.min_count and a > p.lift * e and a - e > p.z * math.sqrt(e + 1):
            kept.add(f)
    w, bias = dict.fromkeys(kept, 0.0), math.log(prior / (1 - prior))
    m, v, mb, vb = dict.fromkeys(kept, 0.0), dict.fromkeys(kept, 0.0), 0.0, 0.0
    rows = [[f for f in x if f in kept] for x in positive + unlabelled]
    n, u = len(positive), len(unlabelled)
    for t in range(1, p.epochs + 1):
        f = [bias + sum(w[i] for i in x) for x in rows]
        soft = lambda z: math.log1p(math.exp(z))
        corrected = sum(map(soft, f[n:])) / u - prior * sum(map(soft, f[:n])) / n
        g = []
        for k, z in enumerate(f):
            s = sigmoid(z)
            if k < n:
                g.append(prior / n * ((s - 1) - s) if corrected >= 0 else prior / n * s)
            else:
                g.append(s / u if corrected >= 0 else -s / u)
        grad = {i: p.l2 * w[i] for i in kept}
        for x, gk in zip(rows, g):
            for i in x:
                grad[i] += gk
        step = lambda m, v: p.rate * (m / (1 - 0.9**t)) / (math.sqrt(v / (1 - 0.999**t)) + 1e-8)
        for i in kept:
            m[i], v[i] = 0.9 * m[i] + 0.1 * grad[i], 0.999 * v[i] + 0.001 * grad[i] ** 2
            w[i] -= step(m[i], v[i])
        mb, vb = 0.9 * mb + 0.1 * sum(g), 0.999 * vb + 0.001 * sum(g) ** 2
        bias -= step(mb, vb)
    return w, bias


def plain_ftrl(rows, labels, p):
    z, n = {}, {}

    def weight(i):
        zi, l1 = z.get(i, 0.0), 0.0 if i == "bias" else p.l1
        if abs(zi) <= l1:
            return 0.0
        return -(zi - math.copysign(l1, zi)) / ((p.beta + math.sqrt(n.get(i, 0.0))) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for x, y in zip(rows, labels):
            own = {i: weight(i) for i in [*x, "bias"]}
            g = sigmoid(sum(own.values())) - y
            for i, wi in own.items():
                before = n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(before)) / p.alpha * wi
    return {i: weight(i) for i in z if i != "bias"}, weight("bias") if "bias" in z else 0.0


def as_bytes(text):
    return (text or "").encode()


def rows_and_labels():
    rows = [r for r in small_docs(7, 60) if len(as_bytes(r[1])) < 2000]
    rows = [(i, (t or "") + (" Vile, vile-ness!" if i and i % 4 == 1 else " fine") if t else t, *more) for i, t, *more in rows]
    labels = [(i, 1 - int(i % 4 == 1), int(i % 4 == 1)) for i, *_ in rows if i is not None and i % 3] + [(2, None, None), (None, 1, 1)]
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("features,plain", [("toxicity_features", toxic_features), ("quality_features", quality_features)])
def test_features(features, plain):
    import pyarrow as pa

    from symloom.llm import _features as f

    texts = [as_bytes(t) for _, t, *_ in small_docs()] + [b"A-b  c!d Zz", b"!!", b"x" * 40]
    assert f.feature_lists(pa.array(texts, pa.binary()), getattr(f, features)).to_pylist() == [plain(t) for t in texts]


def test_toxicity(spark):
    rows, labels = rows_and_labels()
    p = toxicity.ToxicityParams(epochs=25, min_count=1, lift=1.5, z=0.2)
    got = toxicity.toxicity_scores(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS), p).collect()
    toxic = {}
    for i, _, y in labels:
        if i is not None and y is not None and crc_mod(i, 4) != 2:
            toxic[i] = max(y, toxic.get(i, 0))
    learn = [(i, as_bytes(t)) for i, t, *_ in rows if crc_mod(i, 4) != 2]
    positive = sorted({t for i, t in learn if toxic.get(i) == 1})
    unlabelled = sorted({t for _, t in learn})
    assert positive
    w, bias = plain_nnpu([toxic_features(t) for t in positive], [toxic_features(t) for t in unlabelled], sum(toxic.values()) / len(toxic), p)
    assert sum(abs(x) for x in w.values()) > 0
    want = sorted((i is None, i or 0, crc_mod(i, 4) == 2, sigmoid(bias + sum(w.get(f, 0.0) for f in toxic_features(as_bytes(t))))) for i, t, *_ in rows)
    have = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["score"]) for r in got)
    assert [x[:3] for x in have] == [x[:3] for x in want]
    np.testing.assert_allclose([x[3] for x in have], [x[3] for x in want], atol=1e-5)


def test_quality(spark):
    rows, labels = rows_and_labels()
    p = quality.QualityParams(epochs=2)
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    got = quality.quality_scores(docs, marks, p).collect()
    known = {i: y for i, y, _ in labels if i is not None and y is not None and crc_mod(i, 5) != 0}
    # The order of the teaching rows is the operator's own: a hash of id and text.
    from pyspark.sql import functions as F

    order = [r[0] for r in docs.filter(F.col("doc_id").isin(list(known))).orderBy(F.xxhash64("doc_id", F.coalesce("text", F.lit("")).cast("binary"))).select("doc_id").collect()]
    text = {i: as_bytes(t) for i, t, *_ in rows}
    w, bias = plain_ftrl([quality_features(text[i]) for i in order], [known[i] for i in order], p)
    assert any(w.values())
    want = sorted((i is None, i or 0, crc_mod(i, 5) == 0, sigmoid(bias + sum(w.get(f, 0.0) for f in quality_features(as_bytes(t))))) for i, t, *_ in rows)
    have = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["score"]) for r in got)
    assert [x[:3] for x in have] == [x[:3] for x in want]
    np.testing.assert_allclose([x[3] for x in have], [x[3] for x in want], atol=1e-5)
