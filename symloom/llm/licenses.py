"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Words are maximal runs of 0-9, A-Z, a-z and bytes beyond ASCII, lower-cased. The hashes of `gram`
consecutive words of each template are winnowed: of every `window` neighbours the least is kept. The
kept ones are the keys of an inverted index (hash -> template and place). Texts are winnowed alike, so
that any run of gram + window - 1 words that a text shares with a template meets in the index; a match
without such a run is not found. Hits of one template on nearby diagonals are one candidate, around
which the template is aligned with the text in a band, and again in one narrower than the template (match 2, other word -1, gap -1, ends free).
Alignments that match at least `coverage` of the template's words are reported, best first, where
they don't overlap a better one of the same template.

The index holds the templates alone, a parameter of fixed size; texts are never gathered.

Defined cases: a null text is an empty text and has no matches; a template of fewer than
gram + window - 1 words is refused; repeated rows are scanned each; spans are in code points, end
exclusive, over whole words; ties go to the earlier place; an empty table gives an empty result;
extra columns are ignored; a text is one chunk of work however long it is, at some 60 bytes of memory
a byte of text.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, limit_batches, text_bytes
from ._features import Tokens, mix

# The notices of common licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mit": "Released under the MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}


@dataclass(frozen=True)
class LicenseParams:
    gram: int = 3
    window: int = 2
    band: int = 6
    coverage: float = 0.8


def winnowed(words: np.ndarray, doc: np.ndarray, p: LicenseParams) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the kept grams of a row of words; grams and windows stay within a document."""
    n = len(words) - p.gram + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(p.gram):
            h = mix(h * np.uint64(3) + words[j : j + n])
    place = np.flatnonzero(doc[:n] == doc[p.gram - 1 :])
    h, own = h[place], doc[place]
    keep = np.zeros(len(h), bool)
    size = len(h) - p.window + 1
    if size > 0:
        least = h[:size].copy()
        for j in range(1, p.window):
            np.minimum(least, h[j : j + size], out=least)
        whole = own[:size] == own[p.window - 1 :]
        for j in range(p.window):
            keep[j : j + size] |= whole & (h[j : j + size] == least)
    return place[keep], h[keep]


class Index:
    """Templates and the inverted index of their fingerprints."""

    def __init__(self, templates: dict[str, str], p: LicenseParams):
        self.p, self.names, self.words = p, list(templates), []
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, text in enumerate(templates.values()):
            body = np.frombuffer(text.encode(), np.uint8)
            _, _, _, words = words_of(body, np.array([0, len(body)]))
            if len(words) < p.gram + p.window - 1:
                raise ValueError(f"template {self.names[k]} has too few words")
            self.words.append(words)
            for at, h in zip(*winnowed(words, np.zeros(len(words), np.int64), p)):
                found[int(h)].append((k, int(at)))
        self.keys = np.array(sorted(found), np.uint64)
        self.postings = [found[int(k)] for k in self.keys]


def words_of(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document, hash) of the words of a buffer."""
    t = Tokens(body, at, lower=True)
    own = t.visible == 1
    start, end = t.start[own], t.end[own]
    return start, end, t.doc[own], t.hash(start, end, 1)


def aligned(template: np.ndarray, words: np.ndarray, low: int, high: int, diagonal: int, band: int) -> tuple[int, int, int]:
    """(matches, first word, end word) of the best local alignment in the band around a diagonal, within words[low:high]."""
    best = (0, 0, low, low)
    before = {}
    for i in range(len(template)):
        row: dict[int, tuple[int, int, int]] = {}
        for j in range(max(low, i + diagonal - band), min(high, i + diagonal + band + 1)):
            same = template[i] == words[j]
            s, m, first = before.get(j - 1, (0, 0, j))
            options = [(s + 2, m + 1, first) if same else (s - 1, m, first)]
            if j in before:
                options.append((before[j][0] - 1, *before[j][1:]))
            if j - 1 in row:
                options.append((row[j - 1][0] - 1, *row[j - 1][1:]))
            cell = max(options, key=lambda x: (x[0], x[1], -x[2]))
            if cell[0] <= 0:
                continue
            row[j] = cell
            if (cell[0], cell[1]) > best[:2] and same:
                best = (cell[0], cell[1], cell[2], j + 1)
        before = row
    return best[1], best[2], best[3]


def matches(index: Index, words: np.ndarray, low: int, high: int, hits: list[tuple[int, int]], overlapping: bool = True) -> list[tuple[int, int, int, int]]:
    """(template, matched words, first word, end word) in one document, words[low:high]; hits: (template, diagonal).

    overlapping: where templates match the same words, all are told; else the one with the most matched
    words, then the greatest coverage, then the first name.
    """
    p, found = index.p, []
    by_template: dict[int, list[int]] = defaultdict(list)
    for k, diagonal in hits:
        by_template[k].append(diagonal)
    for k, diagonals in by_template.items():
        template = index.words[k]
        narrow = min(p.band, len(template) // 2)  # less than what lies between two matches in a row
        candidates, group = [], []
        for d in sorted(set(diagonals)):
            if group and d - group[0] > narrow:
                candidates.append(group)
                group = []
            group.append(d)
        candidates.append(group)
        own = []
        for group in candidates:
            for band in {narrow, p.band}:  # the wide band may reach a neighbour instead, the narrow one may cut a match with insertions
                m, first, end = aligned(template, words, low, high, (group[0] + group[-1]) // 2, band)
                if m >= p.coverage * len(template):
                    own.append((m, first, end))
        taken: list[tuple[int, int]] = []
        for m, first, end in sorted(set(own), key=lambda x: (-x[0], x[1], x[2])):
            if all(end <= a or first >= b for a, b in taken):
                taken.append((first, end))
                found.append((k, m, first, end))
    if not overlapping:
        best: list[tuple[int, int, int, int]] = []
        for x in sorted(found, key=lambda x: (-x[1], -x[1] / len(index.words[x[0]]), index.names[x[0]], x[2])):
            # Chosen stretches are disjoint, so that the one before a place is all that must be looked at.
            at = bisect.bisect_left(best, x[2], key=lambda b: b[2])
            if (at == len(best) or x[3] <= best[at][2]) and (at == 0 or best[at - 1][3] <= x[2]):
                best.insert(at, x)
        found = best
    return sorted(found, key=lambda x: (x[2], x[3], index.names[x[0]]))


def license_lists(array: pa.Array, index: Index, overlapping: bool = True) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(len(array))]
    for row, _, body, at in chunks(array):
        start, end, doc, words = words_of(body, at)
        place, h = winnowed(words, doc, index.p)
        i = np.minimum(np.searchsorted(index.keys, h), len(index.keys) - 1)
        hit = np.flatnonzero(index.keys[i] == h)
        if not len(hit):
            continue
        own: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for x in hit:
            for k, t in index.postings[i[x]]:
                own[int(doc[place[x]])].append((k, int(place[x]) - t))
        for d, hits in own.items():
            low, high = np.searchsorted(doc, [d, d + 1])
            found = matches(index, words, int(low), int(high), hits, overlapping)
            if not found:
                continue
            text = body[at[d] : at[d + 1]]
            points = np.concatenate(([0], np.cumsum((text & 0xC0) != 0x80)))
            for k, m, first, stop in found:
                size = len(index.words[k])
                out[row + d].append({"license": index.names[k], "start": int(points[start[first] - at[d]]), "end": int(points[end[stop - 1] - at[d]]), "matched": m, "coverage": m / size})
    return out


def license_matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, p: LicenseParams = LicenseParams(), overlapping: bool = True) -> DataFrame:
    """doc_id, matches (array of license, start, end, matched words, coverage; by place) of every row.

    overlapping: tell all templates that match the same words, or the best of them alone.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    held = spark.sparkContext.broadcast(Index(templates, p))  # the templates, whatever the input
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.int32()), ("coverage", pa.float64())]))

    @F.arrow_udf("array<struct<license:string,start:long,end:long,matched:int,coverage:double>>")
    def scan(text: pa.Array) -> pa.Array:
        return pa.array(license_lists(text, held.value, overlapping), kind)

    return docs.select("doc_id", scan(text_bytes(F.col("text"))).alias("matches"))
