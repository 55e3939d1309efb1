"""Exact similarity links against brute force: whole, in blocks, and in one task."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from symloom.llm import simhash, similar

from .texts import DOCS, small_docs


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def rows():
    r, out = random.Random(8), small_docs()
    for k in range(40):
        body = [f"w{r.randrange(300)}" for _ in range(r.randint(60, 240))]
        for _ in range(r.randint(1, 4)):
            own = list(body)
            for _ in range(r.randint(0, 4)):
                at = r.randrange(len(own))
                own[at : at + r.choice([0, 1])] = r.choice([["changed"], [], ["one", "two"]])
            out.append((1000 + len(out), " ".join(own), "s", "x", 0.5))
    return out


def kept(docs):
    return simhash.keep_first(docs, size=5, similarity=(4, 5))


@pytest.mark.parametrize("shingles_of_block", [similar.BLOCK_SHINGLES, 400])
def test_keeps_the_first_of_each_component(spark, monkeypatch, shingles_of_block):
    whole = similar.components
    monkeypatch.setattr(similar, "components", lambda *a: whole(*a, most_shingles=shingles_of_block))
    data = rows()
    sets = [shingles(t) for _, t, *_ in data]
    root, pairs = list(range(len(data))), 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
                pairs += sets[i] != sets[j]
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert pairs >= 20
    want = {}
    for k, (i, *_) in enumerate(data):
        want[find(k)] = min(want.get(find(k), 10**9), 10**9 if i is None else i)
    got = [r["doc_id"] for r in kept(spark.createDataFrame(data, DOCS)).collect()]
    assert sorted(10**9 if i is None else i for i in got) == sorted(want.values())
    assert kept(spark.createDataFrame([], DOCS)).collect() == []


def test_links_of_one_task_equal_brute_force():
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(120)]
    sets = [np.unique(np.array(r.sample(base, r.randint(80, 120)) + [r.getrandbits(64) for _ in range(r.randint(0, 12))], np.uint64)) for _ in range(90)]
    sets += [sets[0].copy(), np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
    got = similar.linked(sets, np.zeros(len(sets), np.int64), 4, 5)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(set(a.tolist()) & set(b.tolist()))
            if 9 * both >= 4 * (len(a) + len(b)):
                root[find(i)] = find(j)
    assert len({find(i) for i in range(len(sets))}) > 5
    assert {frozenset(k for k in range(len(sets)) if got[k] == x) for x in set(got.tolist())} == {frozenset(k for k in range(len(sets)) if find(k) == x) for x in {find(k) for k in range(len(sets))}}


def test_near_duplicates_stage_links_at_four_fifths(spark):
    import corpus_pipeline

    body = [f"w{k}" for k in range(100)]
    near = [*body[:50], "other", *body[51:]]  # 91 of 101 shingles in common
    far = [*body[:10], "a", *body[11:40], "b", *body[41:70], "c", *body[71:]]  # 81 of 111
    docs = spark.createDataFrame([(i, " ".join(t), "s", "x", 0.0) for i, t in enumerate([body, near, far])], DOCS)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 2]


def test_linked_fingerprints_are_candidates(spark, monkeypatch):
    """Without the bands: the fingerprints alone bring in a pair of 2 differing bits, and the sets decide."""
    marks = similar._marks_udf
    monkeypatch.setattr(similar, "_marks_udf", lambda size: lambda body: F.struct(marks(size)(body)["sid"].alias("sid"), F.array().cast("array<long>").alias("keys")))
    body = [f"w{k}" for k in range(300)]
    texts = [" ".join([*body[:k], "other", *body[k + 1 :]]) for k in range(300)]
    own, *others = simhash.fingerprints(pa.array([" ".join(body), *texts], pa.binary()), 5)
    near = next(t for t, fp in zip(texts, others) if 1 <= int(own ^ fp).bit_count() <= 2)
    # Equal fingerprints, of sets that have only one of 16 shingles in common: one word makes up nearly all of the text.
    same = ["x " * 400 + "a b c d e", "x " * 400 + "f g h i j k l m n o"]
    both = simhash.fingerprints(pa.array(same, pa.binary()), 5)
    assert both[0] == both[1]
    docs = spark.createDataFrame([(i, t, "s", "x", 0.0) for i, t in enumerate([" ".join(body), near, *same, "a stranger"])], DOCS)
    assert sorted(r["doc_id"] for r in kept(docs).collect()) == [0, 2, 3, 4]
