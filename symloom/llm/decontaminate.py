"""Benchmark decontamination by Wu-Manber multi-pattern search.

A pattern is a window of 8 consecutive words of a benchmark item (an item of fewer words is one
window), its words joined by single spaces with a space at either end, so that it can only match
whole words. Patterns are dealt into classes of like length; a class has a block shift table (how far
the search may jump given the last bytes seen), suffix-hash buckets (which patterns may end here), a
check of each pattern's first bytes, and a direct comparison. Many cursors walk a buffer of texts at
once, each over its own stretch, so every table look-up is one numpy gather.

The benchmark is taken in blocks of at most `most_windows` patterns; a block's tables are the only
thing broadcast at once, and every block passes over every text.

Defined cases: a null text has no words; an item without words or with a null item_id has no
windows; repeated items count once; an item of fewer than 8 words matches wherever its words stand
in a row; repeated rows of documents are judged each; with an empty benchmark nothing is hit; a word
inside several occurrences counts once; an empty table gives an empty result; extra columns are
ignored. A text is one chunk of work however long it is, at some 40 bytes of memory a byte of text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import chunks, limit_batches, text_bytes, words64

_TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_BITS = 18
_LENGTHS = (0, 12, 24, 36)


def normal(text: bytes) -> bytes:
    """Lower-cased words with a space before each and after the last; empty without words."""
    words = text.translate(_TABLE).split()
    return b" " + b" ".join(words) + b" " if words else b""


@dataclass
class _Class:
    """The tables of the patterns of like length."""

    m: int  # shortest pattern: the length that shifts are derived from
    block: int  # bytes of a block
    shift: np.ndarray
    first: np.ndarray  # bucket -> first entry in members
    members: np.ndarray  # pattern numbers by bucket
    prefix: np.ndarray  # first bytes of each member
    prefix_mask: np.uint64


@dataclass
class Automaton:
    patterns: list[bytes]
    words: np.ndarray  # words of each pattern
    item_at: np.ndarray  # pattern -> its stretch of item_of
    item_of: np.ndarray
    items: list[str]
    classes: list[_Class]


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << (8 * min(n, 8))) - 1)


def _hash(block: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((block * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)


def build(items: list[tuple[str, bytes]], window: int = 8) -> Automaton:
    """The automaton of (item id, text) pairs."""
    found: dict[bytes, set[str]] = {}
    for item, text in items:
        words = normal(text).split()
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(b" " + b" ".join(words[i : i + window]) + b" ", set()).add(item)
    patterns = sorted(found, key=lambda p: (len(p), p))
    names = sorted({i for held in found.values() for i in held})
    number = {n: k for k, n in enumerate(names)}
    held = [sorted(number[i] for i in found[p]) for p in patterns]
    size = np.array([len(p) for p in patterns], np.int64)
    classes = []
    for low, high in zip(_LENGTHS, (*_LENGTHS[1:], 1 << 60)):
        own = np.flatnonzero((size >= low) & (size < high))
        if not len(own):
            continue
        m = int(size[own].min())
        block = max(1, min(8, (m + 1) // 2))
        shift = np.full(1 << _BITS, min(m - block + 1, 255), np.uint8)
        heads = np.frombuffer(b"".join(patterns[k][:m] for k in own), np.uint8).reshape(len(own), m)
        padded = np.zeros((len(own), m + 8), np.uint8)
        padded[:, :m] = heads
        bucket = np.zeros(len(own), np.int64)
        for at in range(m - block + 1):  # block at [at, at + block) of the first m bytes
            h = _hash(np.ascontiguousarray(padded[:, at : at + 8]).view("<u8")[:, 0] & _mask(block))
            np.minimum.at(shift, h, min(m - block - at, 255))
            bucket = h
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange((1 << _BITS) + 1))
        prefix = np.ascontiguousarray(padded[:, :8]).view("<u8")[:, 0] & _mask(m)
        classes.append(_Class(m, block, shift, first.astype(np.int32), own[order].astype(np.int32), prefix[order], _mask(m)))
    return Automaton(patterns, np.array([p.count(b" ") - 1 for p in patterns], np.int64), np.cumsum([0, *map(len, held)]), np.array([i for h in held for i in h], np.int64), names, classes)


def search(a: Automaton, text: bytes, lane: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(start, pattern) of every occurrence in a buffer."""
    starts, which = [], []
    n = len(text)
    word = words64(np.frombuffer(text, np.uint8)).copy() if n else np.zeros(0, np.uint64)
    for c in a.classes:
        if n < c.m:
            continue
        cuts = np.unique(np.append(np.arange(c.m - 1, n, lane), n))
        at, end = cuts[:-1].copy(), cuts[1:]  # the byte that the window of m bytes ends with
        block_mask, seen = _mask(c.block), []
        while len(at):
            step = c.shift[_hash(word[at - (c.block - 1)] & block_mask)]
            stop = step == 0
            if stop.any():
                seen.append(at[stop])
            at = at + np.maximum(step, 1)
            live = at < end
            at, end = at[live], end[live]
        if not seen:
            continue
        at = np.concatenate(seen)
        bucket = _hash(word[at - (c.block - 1)] & block_mask)
        count = (c.first[bucket + 1] - c.first[bucket]).astype(np.int64)
        entry = np.repeat(c.first[bucket] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        begin = np.repeat(at - (c.m - 1), count)
        alike = word[begin] & c.prefix_mask == c.prefix[entry]
        begin, member = begin[alike], c.members[entry[alike]]
        exact = np.fromiter((text.startswith(a.patterns[k], s) for s, k in zip(begin.tolist(), member.tolist())), bool, len(begin))
        starts.append(begin[exact])
        which.append(member[exact].astype(np.int64))
    return (np.concatenate(starts), np.concatenate(which)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def blocks_of(benchmark: DataFrame, most_windows: int, window: int) -> list:
    """Broadcast automata of the benchmark, each of a bounded number of windows."""
    spark = benchmark.sparkSession
    items = benchmark.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), text_bytes(F.col("text")).alias("body"))
    out, held, windows = [], [], 0
    for item, body in items.dropDuplicates().toLocalIterator():
        own = len(normal(bytes(body)).split())
        if held and windows + own > most_windows:
            out.append(spark.sparkContext.broadcast(build(held, window)))
            held, windows = [], 0
        held.append((item, bytes(body)))
        windows += own
    if held:
        out.append(spark.sparkContext.broadcast(build(held, window)))
    return out


def marks(array: pa.Array, automata) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
    """(words, hit words, words of the longest window hit, sorted ids of the items with occurring windows) of each text."""
    n = len(array)
    n_words, n_hit, longest, items = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [[] for _ in range(n)]
    parts = list(chunks(array))
    held = []
    for first, end, body, at in parts:
        raw = body.tobytes()
        texts = [normal(raw[at[i] : at[i + 1]]) for i in range(end - first)]
        text = b"\n".join(texts)
        at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        spaces = np.concatenate(([0], np.cumsum(np.frombuffer(text, np.uint8) == 32)))
        held.append((first, end, text, at, spaces, np.zeros(spaces[-1] + 2, np.int64), [set() for _ in texts]))
    for load in automata:
        a = load()
        for first, end, text, at, spaces, diff, own in held:
            start, pattern = search(a, text)
            gap = spaces[start]
            np.add.at(diff, gap, 1)
            np.add.at(diff, gap + a.words[pattern], -1)
            key = np.unique((np.searchsorted(at, start, side="right") - 1) * len(a.patterns) + pattern)
            for k in key.tolist():
                doc, p = divmod(k, len(a.patterns))
                own[doc].update(a.items[i] for i in a.item_of[a.item_at[p] : a.item_at[p + 1]])
                longest[first + doc] = max(longest[first + doc], a.words[p])
        del a
    for first, end, text, at, spaces, diff, own in held:
        bounds = spaces[np.minimum(at, len(text))]
        hit = np.concatenate(([0], np.cumsum(np.cumsum(diff[:-2]) > 0)))
        n_words[first:end] = np.maximum(bounds[1:] - bounds[:-1] - 1, 0)
        n_hit[first:end] = hit[bounds[1:]] - hit[bounds[:-1]]
        items[first:end] = [sorted(x) for x in own]
    return n_words, n_hit, longest, items


def marker(spark: SparkSession, benchmark: DataFrame, window: int = 8, most_windows: int = 200_000):
    """A column function: bytes of a text -> struct(n_words, n_hit, longest, items)."""
    limit_batches(spark)
    held = blocks_of(benchmark, most_windows, window)

    @F.arrow_udf("struct<n_words:long,n_hit:long,longest:long,items:array<string>>")
    def mark(text: pa.Array) -> pa.Array:
        def loader(b):
            def load():
                value = b.value
                if len(held) > 1:  # one block at a time in a worker's memory
                    del b._value
                return value

            return load

        n_words, n_hit, longest, items = marks(text, [loader(b) for b in held])
        return pa.StructArray.from_arrays([pa.array(n_words), pa.array(n_hit), pa.array(longest), pa.array(items, pa.list_(pa.string()))], ["n_words", "n_hit", "longest", "items"])

    return mark


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 8, least_items: int = 2, most_windows: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_hit, items, contaminated of every row."""
    mark = marker(docs.sparkSession, benchmark, window, most_windows)
    found = docs.select("doc_id", mark(text_bytes(F.col("text"))).alias("m"))
    return found.select("doc_id", "m.n_words", "m.n_hit", "m.items", (F.size("m.items") >= least_items).alias("contaminated"))
