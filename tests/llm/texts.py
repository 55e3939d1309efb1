"""Small documents with copies, repeats, nulls and odd bytes."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, source string, lang string, score double"


def small_docs(seed: int = 1, n: int = 40) -> list[tuple]:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé漢Z9") for _ in range(r.randint(1, 7))) for _ in range(60)]
    passage = " ".join(r.choice(words) for _ in range(80))
    rows: list[tuple] = []
    for i in range(n):
        body = [r.choice(words) for _ in range(r.randint(0, 90))]
        if i % 3 == 0:
            body.insert(len(body) // 2, passage)
        rows.append((i, " ".join(body)))
    rows += [(n, rows[4][1]), (n + 1, rows[6][1].upper()), (n + 2, None), (n + 3, ""), (n + 4, " \t\n "), (n + 5, "a" * 450), (n + 6, "ab" * 300), rows[9], (None, rows[3][1]), (n + 7, passage + "\x00" + passage)]
    rows.append((n + 8, " ".join(r.choice(words) for _ in range(4000))))
    return [(i, t, r.choice(["hot", "hot", "hot", "b", None]), "x", 0.5) for i, t in rows]


def crc_mod(doc_id, n: int) -> int:
    import zlib

    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n
