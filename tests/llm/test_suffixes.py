from __future__ import annotations

import random

import numpy as np
import pytest

from symloom.llm import suffixes

from .texts import DOCS, small_docs


def brute(texts: list[bytes], length: int) -> list[tuple[bytes, int, int]]:
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((bytes(b for b, g in zip(t, gone) if not g), sum(gone), runs))
    return out


def shared_passages(seed: int = 3) -> list[tuple]:
    """One passage under many different borders, some of which are shared by two or three."""
    r = random.Random(seed)
    noise = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, edge = noise(420), noise(150)
    return [(i, noise(r.randint(0, 300)) + (edge if i % 7 == 0 else "") + passage[: r.randint(250, 420)] + noise(r.randint(0, 200)), "s", "x", 0.0) for i in range(60)]


@pytest.mark.parametrize("most", [256, 8, 1])
@pytest.mark.parametrize("rows", [small_docs(), shared_passages()], ids=["mixed", "passages"])
def test_equals_brute_force(spark, rows, most):
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffixes.without_repeats(docs, most_in_group=most).collect())
    bodies = [(t or "").encode() for _, t, *_ in rows]
    want = sorted((i is None, i or 0, kept, len(b), gone, runs) for (i, *_), b, (kept, gone, runs) in zip(rows, bodies, brute(bodies, 200)))
    assert got == want


def test_empty(spark):
    assert suffixes.without_repeats(spark.createDataFrame([], DOCS)).collect() == []


def test_windows_that_occur_once_are_not_sorted(monkeypatch):
    """Borders of one passage, all different: sorting them all was most of the time on large tables."""
    r = random.Random(5)
    passage = bytes(r.randrange(256) for _ in range(100))
    texts = [bytes(r.randrange(256) for _ in range(90)) + passage + bytes(r.randrange(256) for _ in range(90)) for _ in range(40)]
    texts[7] = texts[3][:60] + texts[7][60:90] + texts[3][90:]  # the last 190 bytes and 30 more
    texts[9] = texts[3][:75] + texts[9][75:]
    texts[11] = texts[3][:5] + texts[3][5:230] + texts[11][230:]  # 26 windows of 205
    sorted_, sort = [], suffixes.sort_suffixes
    monkeypatch.setattr(suffixes, "sort_suffixes", lambda prefixes, start, *more: sorted_.append(len(start)) or sort(prefixes, start, *more))
    n = len(texts[0]) - 205 + 1
    found = suffixes.repeated_windows(texts, np.full(len(texts), n), np.full(len(texts), 90), np.zeros(len(texts), np.int64), 205)
    assert [f.sum() for f in found] == [26 if i in (3, 11) else 0 for i in range(len(texts))]
    assert 52 <= sum(sorted_) < 0.5 * n * len(texts)


def test_segments_do_not_depend_on_the_buffer(monkeypatch):
    """Equal windows must have equal anchors, also where hashes share all but their last bits."""
    hashes = suffixes.gram_hashes
    monkeypatch.setattr(suffixes, "gram_hashes", lambda body, gram: hashes(body, gram) >> np.uint64(50))
    r = np.random.default_rng(1)
    text, more = r.integers(0, 256, 600).astype(np.uint8), r.integers(0, 256, 1 << 17).astype(np.uint8)
    alone = suffixes.segments(text, np.array([0, 600]), 200, 32)
    among = suffixes.segments(np.concatenate((text, more)), np.array([0, 600, 600 + len(more)]), 200, 32)
    own = among[0] == 0
    assert [x.tolist() for x in alone] == [x[own].tolist() for x in among]


def test_spans_of_repeated_rows_are_listed_once(spark):
    """Else n equal rows carry n times their spans each."""
    r = random.Random(6)
    text = "".join(r.choice("abcdefgh ") for _ in range(900))
    listed = [suffixes.repeated_spans(spark.createDataFrame([(1, text, "s", "x", 0.0)] * n, DOCS)).collect() for n in (2, 12)]
    assert [len(x) for x in listed] == [1, 1]
    assert len(listed[0][0]["spans"]) == len(listed[1][0]["spans"])
