"""Components of documents by similarity of their shingle sets.

The shingles of a text are hashes of `size` consecutive words (runs of bytes that are no ASCII white
space, A-Z lower-cased); a text of fewer words is one shingle. Two texts link if the Jaccard
similarity of their shingle sets is at least p / q (0.8).

Candidates by fingerprints. Texts whose SimHash fingerprints link (operator 6's pigeonring chains, on
the shingles of `size` words) are joined in clusters. Such links find the closest pairs only.

Candidates by bands of minima, for the rest. Of each set, the least of each of BANDS * ROWS permutations is taken;
ROWS of them make a key. Two sets of similarity s share a key with probability 1 - (1 - s^ROWS)^BANDS:
at 0.8 a pair is missed with probability 3e-9, at 0.85 with 6e-13, while sets of similarity 0.1 meet
with 5e-4. Sets that share a key are joined in clusters: each is tied to the least set of every list
that it is in, and components of these ties and those of fingerprints are the clusters. The least sets are found by an
aggregation that combines before it shuffles; no list is gathered.

Links by comparison. Only texts in a cluster are read again. A cluster is solved in one task if its
sets are few; else it is dealt into blocks of bounded size, and every two blocks meet in a task. In
a task the sizes and the exclusive or of bitmaps (a lower bound of the symmetric difference) drop
pairs, texts that are joined already are passed over, and the sets themselves decide the rest. What
leaves a task is a star for each component found, never more than a row for each text.

Defined cases: null, empty and blank texts have the empty set and are alike; sets are told apart by
64-bit hashes, and so are shingles; equal rows and ties are alike to each other; an empty table
gives an empty result; a text is one chunk of work however long it is, at some 90 bytes of memory a
byte of text, and its set is held whole with those of its block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from ._common import chunks, cut, forget, limit_batches, text_bytes
from ._features import UNSPACED, Tokens, mix
from ._graph import connected_components

#: Keys of a set, and minima of a key.
BANDS, ROWS = 50, 5
#: Shingles and texts of a block.
BLOCK_SHINGLES, BLOCK_TEXTS = 1 << 20, 4096
_BITS = 512


def shingle_sets(array: pa.Array, size: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, pointers, hashes): the sorted distinct shingle hashes (uint64) of runs of texts."""
    for first, end, body, at in chunks(array):
        docs = end - first
        t = Tokens(body, at, lower=True, classes=UNSPACED)
        doc, word = t.doc, t.hash(t.start, t.end, 1)
        n = len(word) - size + 1
        h, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            if n > 0:
                h = np.zeros(n, np.uint64)
                for j in range(size):
                    h = mix(h * np.uint64(3) + word[j : j + n])
                whole = doc[:n] == doc[size - 1 :]
                h, owner = h[whole], doc[:n][whole]
            count = np.bincount(doc, minlength=docs)
            begin = np.concatenate(([0], np.cumsum(count)))
            short = np.flatnonzero((count > 0) & (count < size))
            if len(short):
                whole_text = np.zeros(len(short), np.uint64)
                for j in range(size - 1):
                    own = count[short] > j
                    whole_text[own] = mix(whole_text[own] * np.uint64(5) + word[begin[short[own]] + j])
                h, owner = np.concatenate((h, whole_text)), np.concatenate((owner, short))
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        if len(h):
            fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])))
            h, owner = h[fresh], owner[fresh]
        yield first, np.searchsorted(owner, np.arange(docs + 1)), h


def _set_ids(pointers: np.ndarray, h: np.ndarray) -> np.ndarray:
    raw = h.tobytes()
    return np.array([xxhash.xxh3_64_intdigest(raw[8 * a : 8 * b]) for a, b in zip(pointers[:-1].tolist(), pointers[1:].tolist())], np.uint64).view(np.int64)


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.view(np.int64)))


def _joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def _sets_udf(size: int):
    @F.arrow_udf("array<long>")
    def sets(text: pa.Array) -> pa.Array:
        return _joined([_lists(pointers, h) for _, pointers, h in shingle_sets(text, size)], pa.list_(pa.int64()))

    return sets


def _odd(k: int) -> np.uint64:
    """The k-th multiplier: fixed, so that a set has the same keys wherever it is met."""
    return mix(np.array([2 * k + 1], np.uint64) * np.uint64(0xD1342543DE82EF95))[0] | np.uint64(1)


def band_keys(pointers: np.ndarray, h: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(sets, bands) keys; either half of a product is a permutation of its own. Sets must not be empty."""
    n = len(pointers) - 1
    minima = np.zeros((2 * -(-bands * rows // 2), n), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(minima), 2):
            both = (h * _odd(k)).view(np.uint32)
            for half in (0, 1):
                minima[k + half] = np.minimum.reduceat(both[half::2], pointers[:-1])
        key = np.tile(np.arange(1, bands + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15), (1, n))
        for r in range(rows):
            key = mix(key * np.uint64(3) + minima[r : bands * rows : rows])
    return key.T


def _marks_udf(size: int):
    kind = pa.struct([("sid", pa.int64()), ("keys", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<sid:long,keys:array<long>>")
    def marks(text: pa.Array) -> pa.Array:
        parts = []
        for _, pointers, h in shingle_sets(text, size):
            full = np.diff(pointers) > 0
            keys = band_keys(np.append(pointers[:-1][full], pointers[-1]), h) if full.any() else np.zeros((0, BANDS), np.uint64)
            ends = np.concatenate(([0], np.cumsum(full * BANDS)))
            parts.append(pa.StructArray.from_arrays([pa.array(_set_ids(pointers, h)), _lists(ends, np.ascontiguousarray(keys).ravel())], ["sid", "keys"]))
        return _joined(parts, kind)

    return marks


def linked(sets: list[np.ndarray], block: np.ndarray, p: int, q: int) -> np.ndarray:
    """A label for each set: sets of one label are joined by links. block: 0 and 1; sets of one block meet only if there is one block."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    size, side = size[order], block[order]
    own = [sets[i] for i in order]
    bits = np.zeros((m, _BITS // 8), np.uint8)
    for i, s in enumerate(own):
        bits[i] = np.packbits(np.bincount((s & np.uint64(_BITS - 1)).astype(np.int64), minlength=_BITS) & 1)
    bits = bits.view(np.uint64)
    label = np.arange(m)
    both = len(np.unique(side)) > 1
    # |A & B| >= p / (p + q) (|A| + |B|) if and only if the symmetric difference is at most (q - p) / (p + q) (|A| + |B|).
    for i in range(m):
        stop = int(np.searchsorted(size, q * size[i] // p, side="right"))
        near = np.flatnonzero(label[i + 1 : stop] != label[i]) + i + 1
        if both:
            near = near[side[near] != side[i]]
        if not len(near):
            continue
        differ = np.bitwise_count(bits[near] ^ bits[i]).sum(1, dtype=np.int64)
        for j in near[(p + q) * differ <= (q - p) * (size[i] + size[near])]:
            if label[i] != label[j]:
                shared = len(np.intersect1d(own[i], own[j], assume_unique=True))
                if (p + q) * shared >= p * (size[i] + size[j]):
                    label[label == label[j]] = label[i]
    out = np.empty(m, np.int64)
    out[order] = label
    return out


def _solve_udf(p: int, q: int):
    @F.arrow_udf("array<struct<a:long,b:long>>")
    def solve(members: pa.Array) -> pa.Array:
        at, flat = members.offsets.to_numpy(), members.values
        sid, block = flat.field("sid").to_numpy(), flat.field("block").to_numpy()
        grams = flat.field("grams")
        inner, values = grams.offsets.to_numpy(), grams.values.to_numpy().view(np.uint64)
        a, b, ends = [], [], [0]
        for i in range(len(members)):
            rows = range(at[i], at[i + 1])
            label = linked([values[inner[k] : inner[k + 1]] for k in rows], block[at[i] : at[i + 1]], p, q)
            ids = sid[at[i] : at[i + 1]]
            order = np.lexsort((ids, label))
            label, ids = label[order], ids[order]
            head = np.maximum.accumulate(np.where(np.concatenate(([True], label[1:] != label[:-1])), np.arange(len(ids)), 0))
            tied = np.flatnonzero(head != np.arange(len(ids)))
            a.append(ids[tied])
            b.append(ids[head[tied]])
            ends.append(ends[-1] + len(tied))
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (a, b)], ["a", "b"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)

    return solve


def fingerprint_ties(marked: DataFrame) -> DataFrame:
    """(a, b): sets (sid) tied by equal or linked fingerprints (fp); a star for each fingerprint."""
    known = cut(marked.select("fp", "sid").distinct(), "fingerprints")
    heads = cut(known.groupBy("fp").agg(F.min("sid").alias("least")), "distinct")
    equal = known.join(heads, "fp").select(F.col("sid").alias("a"), F.col("least").alias("b"))
    ends = [heads.select(F.col("fp").alias(x), F.col("least").alias(f"{x}_sid")) for x in ("a", "b")]
    near = simhash.fingerprint_links(heads.select("fp")).join(ends[0], "a").join(ends[1], "b").select(F.col("a_sid").alias("a"), F.col("b_sid").alias("b"))
    return equal.unionByName(near).filter("a <> b")


def clusters(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """((doc_id, of, sid) of every row, `of` a hash of the text; (sid, cluster) of sets that may link)."""
    body = text_bytes(F.col("text"))
    marked = docs.select("doc_id", F.xxhash64(body).alias("of"), _marks_udf(size)(body).alias("m"), simhash.fingerprint_udf(size)(body).alias("fp"))
    marked = cut(marked.select("doc_id", "of", "m.sid", "m.keys", "fp"), "sets")
    rows = cut(marked.select("doc_id", "of", "sid"), "rows")
    each = marked.select("sid", "keys").dropDuplicates(["sid"])  # else a copied text makes every list of its own long
    listed = cut(each.select("sid", F.explode("keys").alias("key")), "keys")
    close = cut(fingerprint_ties(marked), "close")
    forget(marked)
    heads = listed.groupBy("key").agg(F.min("sid").alias("least"), F.max("sid").alias("most"))
    heads = cut(heads.filter("least <> most").select("key", "least"), "heads")
    ties = cut(listed.join(heads, "key").filter("sid <> least").select(F.col("sid").alias("a"), F.col("least").alias("b")).distinct(), "ties")
    forget(listed)
    held = connected_components(ties.unionByName(close))
    return rows, cut(held.select(F.col("node").alias("sid"), F.col("root").alias("cluster")), "clusters")


def components(docs: DataFrame, size: int = 5, p: int = 4, q: int = 5, most_shingles: int = BLOCK_SHINGLES, most_texts: int = BLOCK_TEXTS) -> tuple[DataFrame, DataFrame]:
    """((doc_id, of, sid) of every row, `of` a hash of the text; (sid, root) of sets joined to others)."""
    limit_batches(docs.sparkSession)
    rows, held = clusters(docs, size)
    body = text_bytes(F.col("text"))
    wanted = rows.select("sid", "of").groupBy("sid").agg(F.min("of").alias("of")).join(held, "sid")
    texts = docs.select(F.xxhash64(body).alias("of"), body.alias("body")).join(wanted, "of")
    grams = texts.select("sid", "cluster", _sets_udf(size)("body").alias("grams")).dropDuplicates(["sid"])
    grams = cut(grams.withColumn("n", F.size("grams")), "grams")
    totals = grams.groupBy("cluster").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("texts") / most_texts), F.ceil(F.col("shingles") / most_shingles)).cast("int")
    totals = totals.filter("texts > 1").select("cluster", blocks.alias("blocks"))
    dealt = grams.join(totals, "cluster").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    # A block meets every other one; where there is but one, it meets itself.
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("low"), F.greatest(x, F.col("own")).alias("high")))
    sent = dealt.select("cluster", F.explode(meets).alias("pair"), "own", "sid", "grams")
    side = F.when(F.col("pair.low") < F.col("own"), 1).otherwise(0)
    tasks = sent.groupBy("cluster", "pair").agg(F.collect_list(F.struct("sid", side.alias("block"), "grams")).alias("members"))
    stars = tasks.select(F.explode(_solve_udf(p, q)("members")).alias("x")).select("x.a", "x.b")
    roots = connected_components(stars)
    return rows, cut(roots.withColumnRenamed("node", "sid"), "roots")
