from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pytest

from symloom.llm import ppm

from .texts import DOCS, crc_mod, small_docs


def low(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def tables(bodies: list[bytes], order: int) -> dict[tuple, Counter]:
    seen: dict[tuple, Counter] = defaultdict(Counter)
    for b in bodies:
        s = [256] * order + list(b) + [256]
        for i in range(order, len(s)):
            for k in range(order + 1):
                seen[tuple(s[i - k : i])][s[i]] += 1
    return seen


def code(body: bytes, seen: dict[tuple, Counter], order: int) -> float:
    s, total = [256] * order + list(body) + [256], 0.0
    for i in range(order, len(s)):
        out: set[int] = set()
        for k in range(order, -1, -1):
            own = {c: n for c, n in seen.get(tuple(s[i - k : i]), {}).items() if c not in out}
            if not own:
                continue
            if s[i] in own:
                total += math.log10((2 * own[s[i]] - 1) / (2 * sum(own.values())))
                break
            total += math.log10(len(own) / (2 * sum(own.values())))
            out |= set(own)
        else:
            total -= math.log10(257 - len(out))
    return total


@pytest.mark.parametrize("most_grams,heavy", [(4_000_000, 1 << 17), (1500, 50)])
def test_equals_brute_force(spark, most_grams, heavy):
    rows = small_docs()
    got = {}
    for r in ppm.scores(spark.createDataFrame(rows, DOCS), order=3, most_grams=most_grams, heavy=heavy).collect():
        got.setdefault(r["doc_id"], []).append(r)
    teach = [t for i, t, *_ in rows if crc_mod(i, 7) != 2]
    seen = tables([low(t).encode() for t in teach], 3)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", low(t)) + [""]
    counts = Counter(w for t in teach for w in words(t))
    n, v = sum(counts.values()), len(counts)
    for i, t, *_ in rows:
        own = words(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        score = code(low(t).encode(), seen, 3)
        r = next(r for r in got[i] if abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and abs(r["score"] - score) < 1e-6 * max(1, abs(score)))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert r["held_out"] == (crc_mod(i, 7) == 2)


def test_empty_and_untaught(spark):
    assert ppm.scores(spark.createDataFrame([], DOCS)).collect() == []
    row = ppm.scores(spark.createDataFrame([(i, "ab", "s", "x", 0.0) for i in range(200) if crc_mod(i, 7) == 2], DOCS)).first()
    assert row["train_tokens"] == 0 and row["score"] == pytest.approx(-3 * math.log10(257))
