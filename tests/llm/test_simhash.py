from __future__ import annotations

import random
import re

import pytest
import xxhash

from symloom.llm import simhash

from .texts import DOCS, small_docs


def fingerprint(text: str | None) -> int:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(fps: list[int]) -> dict[int, int]:
    todo, out = set(fps), {}
    while todo:
        first = todo.pop()
        group, open_ = {first}, [first]
        while open_:
            x = open_.pop()
            near = {y for y in todo if (x ^ y).bit_count() <= 2}
            todo -= near
            group |= near
            open_ += near
        out |= dict.fromkeys(group, min(group))
    return out


@pytest.mark.parametrize("most", [4096, 2])
def test_equals_brute_force(spark, most):
    rows = small_docs()
    got = sorted(map(str, simhash.near_duplicates(spark.createDataFrame(rows, DOCS), most_in_bucket=most).collect()))
    fps = [fingerprint(t) for _, t, *_ in rows]
    root = classes(fps)
    first: dict[int, int] = {}
    for (i, *_), f in zip(rows, fps):
        if i is not None:
            first[root[f]] = min(i, first.get(root[f], i))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    want = sorted(f"Row(doc_id={i}, fp={signed(f)}, component_id={first.get(root[f])})" for (i, *_), f in zip(rows, fps))
    assert got == want


@pytest.mark.parametrize("most", [4096, 3])
def test_links_of_planted_fingerprints(spark, most):
    r = random.Random(5)
    fps = {r.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:60]:
        for n in (1, 2, 3):
            g = f
            for b in r.sample(range(64), n):
                g ^= 1 << b
            fps.add(g)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"), most).collect()
    joined = {f: f for f in fps}

    def root(x):
        while joined[x] != x:
            x = joined[x]
        return x

    for a, b in links:
        a, b = a % (1 << 64), b % (1 << 64)
        assert (a ^ b).bit_count() <= 2
        joined[max(root(a), root(b))] = min(root(a), root(b))
    want = classes(list(fps))
    groups = lambda of: {frozenset(x for x in fps if of(x) == k) for k in {of(x) for x in fps}}
    assert groups(root) == groups(want.get)


def test_keep_first(spark):
    rows = [(5, "one two three four"), (3, "ONE two three four"), (3, "ONE two three four"), (None, None), (None, ""), (9, "other words stand here")]
    docs = spark.createDataFrame([(i, t, "s", "x", 0.0) for i, t in rows], DOCS)
    kept = sorted(((r["doc_id"] or -1) for r in simhash.keep_first(docs).collect()))
    assert kept == [-1, 3, 9]
    assert simhash.keep_first(spark.createDataFrame([], DOCS)).collect() == []
