"""License scans against a full alignment of every template with every text."""

from __future__ import annotations

import random
import re

from symloom.llm import licenses

from .texts import DOCS

WORDS = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def split(text):
    return [(m[0].lower() if m[0].isascii() else m[0], m.start(), m.end()) for m in WORDS.finditer(text or "")]


def full_alignment(template: list[str], words: list[str]) -> int:
    """Matched words of the best local alignment, without band or candidates."""
    best, above = (0, 0), [(0, 0)] * (len(words) + 1)
    for t in template:
        row = [(0, 0)]
        for j, w in enumerate(words):
            s, m = above[j]
            cell = max([(s + 2, m + 1) if t == w else (s - 1, m), (above[j + 1][0] - 1, above[j + 1][1]), (row[j][0] - 1, row[j][1])])
            row.append(cell if cell[0] > 0 else (0, 0))
        above = row
        best = max(best, *row)
    return best[1]


def shares_run(template: list[str], words: list[str], n: int = 4) -> bool:
    grams = {tuple(template[i : i + n]) for i in range(len(template) - n + 1)}
    return any(tuple(words[i : i + n]) in grams for i in range(len(words) - n + 1))


def rows() -> list[tuple]:
    r = random.Random(4)
    filler = lambda n: [r.choice(["alpha", "é漢", "the", "of", "under", "license", "x9"]) for _ in range(n)]
    out: list[str | None] = [None, "", "!!", "Released under the MIT License", "é漢🙂 RELEASED under  the\nMIT-License. " * 3, "filler " * 4000 + licenses.TEMPLATES["bsd"]]
    for text in licenses.TEMPLATES.values():
        words = [w for w, _, _ in split(text)]
        for edits in range(4):
            own = list(words)
            for _ in range(edits):
                k = r.randrange(len(own))
                own[k : k + r.choice([0, 1])] = r.choice([["changed"], [], ["one", "two"]])
            out.append(" ".join(filler(r.randint(0, 30)) + own + filler(r.randint(0, 30))))
    out += [out[3]]
    return [(i, t, "s", "x", 0.0) for i, t in enumerate(out)]


def test_equals_full_alignment(spark):
    data = rows()
    got = {r["doc_id"]: r["matches"] for r in licenses.license_matches(spark.createDataFrame(data, DOCS)).collect()}
    assert len(got) == len(data)
    for i, text, *_ in data:
        words = [w for w, _, _ in split(text)]
        for name, template in licenses.TEMPLATES.items():
            t = [w for w, _, _ in split(template)]
            own = [m for m in got[i] if m["license"] == name]
            want = full_alignment(t, words)
            if shares_run(t, words) and want >= 0.8 * len(t):
                assert own and max(m["matched"] for m in own) == want, (text, name)
            elif want < 0.8 * len(t):
                assert not own, (text, name)
            for m in own:
                assert full_alignment(t, [w for w, _, _ in split(text[m["start"] : m["end"]])]) >= m["matched"]
    assert [m["license"] for m in got[4]] == ["mit"] * 3
    assert got[4][0]["start"] == 4 and data[4][1][got[4][0]["start"] : got[4][0]["end"]] == "RELEASED under  the\nMIT-License"


def test_empty(spark):
    assert licenses.license_matches(spark.createDataFrame([], DOCS)).collect() == []


def test_best_of_overlapping(spark):
    texts = ["Licensed under CC BY-NC 4.0", "x Licensed under CC BY 4.0 y", licenses.TEMPLATES["apache-2.0-notice"] + " and " + licenses.TEMPLATES["mit"]]
    docs = spark.createDataFrame([(i, t, "s", "x", 0.0) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: [m["license"] for m in r["matches"]] for r in licenses.license_matches(docs, overlapping=False).collect()}
    assert got == {0: ["cc-by-nc-4.0"], 1: ["cc-by-4.0"], 2: ["apache-2.0-notice", "mit"]}
