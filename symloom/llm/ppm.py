"""LM scoring by prediction by partial matching over bytes.

Texts are scored with A-Z lower-cased, whole, white space included.

The model is a trie of byte contexts, pretrained on the learning documents: for contexts of up to
`order` bytes, how often each next symbol (a byte, or the end of the text) came. A symbol is coded
in the longest context that the trie has; if it was never seen there, an escape is coded (method D: of
2N half counts, every distinct symbol gives one to the escape) and the next shorter context is tried
with the symbols of the longer one excluded; below the empty context, symbols never seen are equally
likely. The code length of a text, as log10 probability, is the sum over its bytes and its end.

Counts are gathered from all learning documents: (order + 1)-grams are counted per task, summed by
gram, and shorter contexts are sums of longer ones. The trie is dealt into blocks by the last two
bytes of the context, each of at most about `most_grams` grams; a block is the unit that is
broadcast and held, and every block passes over every text. A text's excluded mass depends only on
the context that was escaped from, so the code lengths of a whole buffer are a few table look-ups.

The unigram base counts words. Words that make up at least one in `heavy` of all tokens are at most
`heavy` many: they are broadcast. The others go to a join by word, where none can be hot.

Defined cases: a null text is an empty text and still codes its end; without learning documents all
symbols are equally likely; repeated rows are scored each (and each teaches); a null doc_id counts
as the empty text for its fold; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import chunks, cut, limit_batches, remainder, text_bytes

#: Bits of a symbol in a gram's key; symbol 256 is the end of a text and stands before its first byte.
WIDE, END, SYMBOLS = 9, 256, 257
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Spreads contexts over blocks.
_SPREAD = 2654435761


def gram_keys(body: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """Keys of the (order + 1)-grams that end at each byte and at the end of each text, in order."""
    docs, n = len(at) - 1, len(body)
    doc = np.repeat(np.arange(docs), np.diff(at))
    symbols = np.full(n + docs * (order + 1), END, np.int64)
    symbols[np.arange(n) + doc * (order + 1) + order] = body
    key = np.zeros(len(symbols) - order, np.int64)
    for j in range(order + 1):
        key <<= WIDE
        key |= symbols[j : len(symbols) - order + j]
    # After each text but the last come the `order` windows that end in the next text's padding.
    if docs < 2:
        return key
    starts = at[:-1] + np.arange(docs) * (order + 1)
    keep = np.ones(len(key), bool)
    for j in range(1, order + 1):
        keep[starts[1:] - j] = False
    return key[keep]


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their sums."""
    if not len(keys):
        return keys, n
    if np.any(keys[1:] < keys[:-1]):
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n, first)


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in an ordered table, -1 where it is not."""
    if not len(table):
        return np.full(len(keys), -1)
    i = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[i] == keys, i, -1)


class _Level:
    """Grams of one length and their contexts."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, below: _Level | None, width: int):
        self.grams, self.n = grams, n
        context = grams >> WIDE
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(grams) else np.zeros(0, np.int64)
        self.contexts = context[first]
        self.total = np.add.reduceat(n, first) if len(grams) else n
        self.distinct = np.diff(np.append(first, len(grams)))
        # After an escape from here: what is left of the shorter context, and the share of its escapes.
        if below is not None and len(grams):
            parent = _find(below.contexts, self.contexts & ((1 << WIDE * (width - 1)) - 1))
            same = below.n[_find(below.grams, grams & ((1 << WIDE * width) - 1))]
            left = below.total[parent] - np.add.reduceat(same, first)
            new = below.distinct[parent] - self.distinct
            self.after = 2.0 * left
            with np.errstate(divide="ignore", invalid="ignore"):
                self.after_escape = np.where(new > 0, np.log10(new / self.after), 0.0)


class Trie:
    """The contexts of one block (or, with blocks = 1, of all)."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, pairs: tuple[np.ndarray, np.ndarray] | None = None, order: int = 4, block: int = 0, blocks: int = 1):
        """grams: (order + 1)-gram keys with counts; pairs: all 2-grams with counts, where blocks > 1."""
        self.order, self.block, self.blocks = order, block, blocks
        levels = {order: _sums(grams.astype(np.int64), n.astype(np.int64))}
        for k in range(order - 1, -1, -1):
            above = pairs if pairs is not None and k < 2 else levels[k + 1]
            levels[k] = _sums(above[0].astype(np.int64) & ((1 << WIDE * (k + 1)) - 1), above[1].astype(np.int64))
        self.levels: list[_Level] = []
        for k in range(order + 1):
            self.levels.append(_Level(*levels[k], self.levels[-1] if k else None, k))
        self._table = None

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def _top(self) -> tuple[np.ndarray, np.ndarray, int]:
        """An open hash table of the longest grams: keys and log10 of their share in their context."""
        if self._table is None:
            top = self.levels[-1]
            bits = max(4, int(2 * len(top.grams)).bit_length())
            keys, logs = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
            context = np.repeat(np.arange(len(top.contexts)), top.distinct)
            own = np.log10((2 * top.n - 1) / (2 * top.total)[context]) if len(top.grams) else np.zeros(0)
            slot, left = self._slot(top.grams, bits), np.arange(len(top.grams))
            while len(left):
                free = left[keys[slot[left]] < 0]
                taken, first = np.unique(slot[free], return_index=True)
                keys[taken], logs[taken] = top.grams[free[first]], own[free[first]]
                left = left[keys[slot[left]] != top.grams[left]]
                slot[left] = (slot[left] + 1) & ((1 << bits) - 1)
            self._table = keys, logs, bits
        return self._table

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each gram after the others."""
        table, values, bits = self._top()
        out = np.zeros(len(keys))
        slot = self._slot(keys, bits)
        found = table[slot]
        hit = found == keys
        out[hit] = values[slot[hit]]
        left = np.flatnonzero(~hit & (found >= 0))
        missed = [np.flatnonzero(found < 0)]
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << bits) - 1)
            found = table[slot]
            hit = found == keys[left]
            out[left[hit]] = values[slot[hit]]
            missed.append(left[found < 0])
            go = ~hit & (found >= 0)
            left, slot = left[go], slot[go]
        rest = np.concatenate(missed)
        out[rest] = self._escaping(keys[rest])
        return out

    def _escaping(self, keys: np.ndarray) -> np.ndarray:
        """The walk down the contexts, for grams that the longest context does not have."""
        out = np.zeros(len(keys))
        left, child = np.arange(len(keys)), np.full(len(keys), -1)
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            gram = keys[left] & ((1 << WIDE * (k + 1)) - 1)
            context = _find(level.contexts, gram >> WIDE)
            at = _find(level.grams, gram)
            own = np.maximum(context, 0)
            if len(level.contexts):
                fresh = child < 0
                whole = 2.0 * level.total[own]
                escape = np.log10(level.distinct[own] / whole)
                if k < self.order and len(self.levels[k + 1].contexts):
                    above, c = self.levels[k + 1], np.maximum(child, 0)
                    whole = np.where(fresh, whole, above.after[c])
                    escape = np.where(fresh, escape, above.after_escape[c])
                hit = at >= 0
                with np.errstate(divide="ignore", invalid="ignore"):
                    out[left] += np.where(hit, np.log10((2 * level.n[np.maximum(at, 0)] - 1) / whole), np.where(context >= 0, escape, 0.0))
                left, child = left[~hit], np.where(context >= 0, context, -1)[~hit]
            if not len(left):
                return out
        seen = int(self.levels[0].distinct[0]) if len(self.levels[0].distinct) else 0
        out[left] -= np.log10(SYMBOLS - seen)
        return out

    def here(self, keys: np.ndarray) -> np.ndarray:
        """Which grams this block answers for: by the two symbols before the last."""
        pair = (keys >> WIDE) & ((1 << 2 * WIDE) - 1)
        return (pair * _SPREAD >> 16) % self.blocks == self.block


_LOW = np.frombuffer(_LOWER, np.uint8)


def text_logs(array: pa.Array, tries) -> np.ndarray:
    """log10 probability of each text; tries: loaders of the blocks, each held only while it is used."""
    out = np.zeros(len(array))
    for load in tries:
        trie = load()
        for first, end, body, at in chunks(array):
            keys = gram_keys(_LOW[body], at, trie.order)
            stop = at[1:] + np.arange(1, end - first + 1)
            if trie.blocks == 1:
                logs = trie.logs(keys)
            else:
                logs = np.zeros(len(keys))
                own = np.flatnonzero(trie.here(keys))
                logs[own] = trie.logs(keys[own])
            total = np.concatenate(([0.0], np.cumsum(logs)))
            out[first:end] += total[stop] - total[np.concatenate(([0], stop[:-1]))]
        del trie
    return out


def count_grams(texts: DataFrame, order: int, most_held: int = 1_000_000) -> DataFrame:
    """(gram, n) over the column body: counted per task, then summed by gram."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["gram", "n"])

        for batch in batches:
            for _, _, body, at in chunks(batch.column(0)):
                keys = gram_keys(_LOW[body], at, order)
                keys.sort()
                held.append(_sums(keys, np.ones(len(keys), np.int64)))
                size += len(held[-1][0])
                if size > 2 * most_held:
                    merged = _sums(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))
                    held, size = [merged], len(merged[0])
                    if size > most_held:
                        yield out(*merged)
                        held, size = [], 0
        if held:
            yield out(*_sums(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held])))

    return texts.select("body").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def count_words(texts: DataFrame, most_held: int = 400_000) -> DataFrame:
    """(word, known, every) over the columns body and learn: tokens of learning texts, and of all.

    The end of a text is the empty word.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Counter[bytes] = Counter()
        other: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = list(known.keys() | other.keys())
            a = np.fromiter((known[w] for w in words), np.int64, len(words))
            b = np.fromiter((other[w] for w in words), np.int64, len(words))
            known.clear()
            other.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(a), pa.array(a + b)], ["word", "known", "every"])

        for batch in batches:
            learn = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for first, end, body, at in chunks(batch.column(0)):
                low = body.tobytes().translate(_LOWER)
                for i in range(end - first):
                    into = known if learn[first + i] else other
                    into.update(low[at[i] : at[i + 1]].split())
                    into[b""] += 1
                if len(known) + len(other) > most_held:
                    yield out()
        if known or other:
            yield out()

    return texts.select("body", "learn").mapInArrow(count, "word binary, known long, every long").groupBy("word").agg(F.sum("known").alias("known"), F.sum("every").alias("every"))


def tries_of(grams: DataFrame, order: int, most_grams: int) -> list:
    """Broadcast tries of the grams, in blocks."""
    spark = grams.sparkSession
    blocks = max(1, -(-grams.count() // most_grams))

    def arrays(of: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        found = of.toArrow()
        return _sums(found.column(0).to_numpy(), found.column(1).to_numpy())

    if blocks == 1:
        return [spark.sparkContext.broadcast(Trie(*arrays(grams), order=order))]
    pair = F.col("gram").bitwiseAND(F.lit((1 << 2 * WIDE) - 1))
    pairs = arrays(grams.groupBy(pair.alias("gram")).agg(F.sum("n").alias("n")))  # at most 257^2
    before = F.shiftright("gram", WIDE).bitwiseAND(F.lit((1 << 2 * WIDE) - 1))
    block = F.shiftright(before * F.lit(_SPREAD), 16) % F.lit(blocks)
    return [spark.sparkContext.broadcast(Trie(*arrays(grams.filter(block == b)), pairs=pairs, order=order, block=b, blocks=blocks)) for b in range(blocks)]


def score(docs: DataFrame, learn: Column, order: int = 5, most_grams: int = 4_000_000, heavy: int = 1 << 17) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    learn: an expression over doc_id that holds for the documents that teach.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    texts = docs.select("doc_id", text_bytes(F.col("text")).alias("body"), learn.alias("learn"))
    words = cut(count_words(texts), "words")
    n, v, every = words.agg(F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("known") > 0, 1)), F.lit(0)), F.coalesce(F.sum("every"), F.lit(0))).first()
    is_heavy = F.col("every") * heavy >= every
    top = words.filter(is_heavy | (F.col("word") == F.lit(b""))).select("word", "known").toArrow()  # at most heavy + 1 words
    known = dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist()))
    grams = cut(count_grams(texts.filter("learn"), order), "grams")
    tries = tries_of(grams, order, most_grams)
    table = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def loader(b):
            def load():
                value = b.value
                if len(tries) > 1:
                    del b._value
                return value

            return load

        counts = table.value
        end = counts.get(b"", 0)
        for batch in batches:
            body = batch.column("body")
            size = len(body)
            tokens, hits, logs = np.ones(size, np.int64), np.zeros(size, np.int64), np.zeros(size)
            rare_words: list[bytes] = []
            rare_counts: list[int] = []
            ends = np.zeros(size + 1, np.int32)
            for first, stop, part, at in chunks(body):
                low = part.tobytes().translate(_LOWER)
                for i in range(stop - first):
                    own = low[at[i] : at[i + 1]].split()
                    got = list(map(counts.get, own))
                    tokens[first + i] += len(own)
                    c = np.fromiter((x for x in got if x is not None), float)
                    hits[first + i] = np.count_nonzero(c) + (end > 0)
                    logs[first + i] = np.log10(c + 1).sum() + np.log10(end + 1)
                    if len(c) < len(own):
                        rare = Counter([w for w, x in zip(own, got) if x is None])
                        rare_words.extend(rare.keys())
                        rare_counts.extend(rare.values())
                    ends[first + i + 1] = len(rare_words)
            entries = pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_counts, pa.int64())], ["word", "count"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("learn"), pa.array(tokens), pa.array(hits), pa.array(logs), pa.array(text_logs(body, map(loader, tries))), pa.ListArray.from_arrays(pa.array(ends), entries)],
                ["row", "doc_id", "learn", "n_tokens", "hits", "logs", "score", "rare"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, learn boolean, n_tokens long, hits long, logs double, score double, rare array<struct<word:binary,count:long>>"
    scored = cut(texts.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "learn", "body").mapInArrow(run, schema), "scored")
    rare = scored.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.count")
    found = rare.join(words.filter(~is_heavy & (F.col("known") > 0)), "word")
    more = found.groupBy("row").agg(F.sum("count").alias("more_hits"), F.sum(F.col("count") * F.log10(F.col("known") + 1)).alias("more_logs"))
    nothing = F.log10(F.lit(float(n + v + 1)))
    return scored.drop("rare").join(more, "row", "left").select(
        "doc_id",
        (~F.col("learn")).alias("held_out"),
        "n_tokens",
        (F.col("hits") + F.coalesce("more_hits", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * nothing).alias("base_score"),
        "score",
    )


def scores(docs: DataFrame, folds: int = 7, held_out: int = 2, **more) -> DataFrame:
    return score(docs, remainder(F.col("doc_id"), folds) != held_out, **more)
