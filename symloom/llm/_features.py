"""Hashed token features of texts, computed for many texts at once with numpy.

A token is a maximal run of word bytes (0-9, A-Z, a-z, any byte >= 0x80) or a maximal run of other
visible bytes; ASCII space and control bytes separate. Tokens are hashed by differences of one
prefix polynomial over the buffer, so there is no Python loop over tokens.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from ._common import chunks

#: Hash space of the features.
BITS = 20
_BASE = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1

_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 2
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
#: One class for all bytes but white space: what SimHash and similarity call words.
UNSPACED = np.ones(256, np.uint8)
UNSPACED[[9, 10, 11, 12, 13, 32]] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, inverse, np.uint64)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


class Tokens:
    """Token starts, ends, documents and a hasher of byte ranges, of one buffer of documents."""

    def __init__(self, body: np.ndarray, at: np.ndarray, lower: bool, classes: np.ndarray = _CLASS):
        kind = classes[body]
        if lower:
            body = _LOWER[body]
        n = len(body)
        edge = np.ones(n + 1, bool)
        if n:
            np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
            edge[at[:-1][at[:-1] < n]] = True
        cut = np.flatnonzero(edge)
        start, end = cut[:-1], cut[1:]
        keep = kind[start] != 0
        self.start, self.end = start[keep], end[keep]
        self.doc = np.searchsorted(at, self.start, side="right") - 1
        self.visible = kind[self.start]
        size = 1 << max(20, int(n).bit_length())
        up, self._down = _powers(size)
        with np.errstate(over="ignore"):
            self._prefix = np.zeros(n + 1, np.uint64)
            np.cumsum((body.astype(np.uint64) + np.uint64(1)) * up[:n], out=self._prefix[1:])
        self.body = body

    def hash(self, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self._prefix[end] - self._prefix[start]) * self._down[start] + np.uint64(salt * 0x632BE59BD9B4E019 & _M64))


def distinct(doc: np.ndarray, h: np.ndarray, n_docs: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row pointers, features): the distinct features of each document in ascending order."""
    key = (doc.astype(np.int64) << np.int64(bits)) | (h >> np.uint64(64 - bits)).astype(np.int64)
    key.sort()
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    pointers = np.searchsorted(key, np.arange(n_docs + 1, dtype=np.int64) << np.int64(bits))
    return pointers, (key & np.int64((1 << bits) - 1)).astype(np.int32)


def toxicity_features(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct lower-cased words and their prefixes of 4, 5 and 6 bytes."""
    t = Tokens(body, at, lower=True)
    word = t.visible == 1
    start, end, doc = t.start[word], t.end[word], t.doc[word]
    h = t.hash(start, end, 1)
    found = [(doc, h)]
    for n in (4, 5, 6):
        long = end - start > n
        found.append((doc[long], t.hash(start[long], start[long] + n, n)))
    return distinct(np.concatenate([d for d, _ in found]), np.concatenate([x for _, x in found]), len(at) - 1)


def quality_features(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (1 and 2) of tokens in their own letter case, and pairs of token shapes."""
    t = Tokens(body, at, lower=False)
    h = t.hash(t.start, t.end, 1)
    with np.errstate(over="ignore"):
        same = t.doc[1:] == t.doc[:-1]
        pair = mix(h[1:] * np.uint64(3) + h[:-1])[same]
        glued = (t.start[1:] == t.end[:-1]).astype(np.uint64)
        first, last = t.body[t.start], t.body[t.end - 1]
        upper = ((first >= 65) & (first <= 90)).astype(np.uint64) * np.uint64(2) + ((last >= 65) & (last <= 90)).astype(np.uint64)
        size = np.minimum(t.end - t.start, 15).astype(np.uint64)
        shape = t.visible.astype(np.uint64) * np.uint64(64) + upper * np.uint64(16) + size
        shape = np.where(t.visible == 2, h, shape)
        shapes = mix(mix(shape[1:] + np.uint64(0x51ED270B)) * np.uint64(5) + mix(shape[:-1]) + glued)[same]
    doc = t.doc
    return distinct(np.concatenate((doc, doc[1:][same], doc[1:][same])), np.concatenate((h, pair, shapes)), len(at) - 1)


def feature_lists(array: pa.Array, features) -> pa.Array:
    """A list<int32> of the features of each text."""
    parts = []
    for _, _, body, at in chunks(array):
        pointers, index = features(body, at)
        parts.append(pa.ListArray.from_arrays(pa.array(pointers.astype(np.int32)), pa.array(index)))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))


def linear_scores(array: pa.Array, features, weights: np.ndarray, bias: float) -> np.ndarray:
    """bias + the sum of the weights of each text's features."""
    out = np.full(len(array), bias, np.float64)
    for i, j, body, at in chunks(array):
        pointers, index = features(body, at)
        total = np.concatenate(([0.0], np.cumsum(weights[index], dtype=np.float64)))
        out[i:j] += total[pointers[1:]] - total[pointers[:-1]]
    return out
