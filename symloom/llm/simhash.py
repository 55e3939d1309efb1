"""Near-duplicates by SimHash fingerprints, linked by pigeonring filtering.

A fingerprint has 64 bits; two fingerprints link at `most` (2) or fewer differing bits. The bits are
dealt into 8 segments on a ring. If two fingerprints differ in at most 2 bits, then from some start
segment every chain of l consecutive segments has at most l * 2 / 8 differing bits: none in the
first three, at most one up to the seventh. So the three first segments of each of the 8 chains are
the key of an exact bucket, the longer chains prune its pairs, and the full Hamming distance decides.

A bucket of over `most_in_bucket` fingerprints is not compared pair by pair: its members go by the
ball route, exact too: two fingerprints differ in at most 2 bits just if some point lies within 1
bit of both, and no point has more than 65 fingerprints that near.

Defined cases: a null or blank text has fingerprint zero and links like any other; equal texts have
equal fingerprints; a null doc_id is never a component id unless all of its component are null;
repeated rows are kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import similar
from ._common import chunks, cut, limit_batches, text_bytes
from ._graph import connected_components

SEED = 42
SEGMENTS, WIDTH, MOST = 8, 8, 2
#: Differing bits allowed over the first l segments of a chain, l from 1.
BUDGET = [l * MOST // SEGMENTS for l in range(1, SEGMENTS + 1)]
#: Segments of a chain that must be equal: the bucket key.
EXACT = sum(b == 0 for b in BUDGET)

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprints(array: pa.Array, size: int = 3) -> np.ndarray:
    """uint64 SimHash of each text: bit b is set if over half of the shingles' XXH64 have it."""
    out = np.zeros(len(array), np.uint64)
    digest = xxhash.xxh64_intdigest
    for first, end, body, at in chunks(array):
        low = body.tobytes().translate(_LOWER)
        hashes: list[int] = []
        counts = np.zeros(end - first, np.int64)
        for i in range(end - first):
            words = low[at[i] : at[i + 1]].split()
            n = len(words)
            if n == 0:
                continue
            joined = b" ".join(words)
            if n <= size:
                hashes.append(digest(joined, SEED))
                counts[i] = 1
                continue
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
            starts = [0, *(ends[: n - size]).tolist()]
            stops = (ends[size - 1 :] - 1).tolist()
            hashes.extend([digest(joined[a:b], SEED) for a, b in zip(starts, stops)])
            counts[i] = n - size + 1
        h = np.array(hashes, np.uint64)
        stop = np.cumsum(counts)
        for i in np.flatnonzero(counts):
            own = h[stop[i] - counts[i] : stop[i]].view(np.uint8).reshape(-1, 8)
            ones = np.zeros(64, np.int64)
            for k in range(0, len(own), 4096):
                ones += np.unpackbits(own[k : k + 4096], axis=1, bitorder="little").sum(0, dtype=np.int64)
            out[first + i] = np.packbits(ones * 2 > counts[i], bitorder="little").view(np.uint64)[0]
    return out


def fingerprint_udf(size: int = 3):
    @F.arrow_udf("long")
    def fingerprint(text: pa.Array) -> pa.Array:
        return pa.array(fingerprints(text, size).view(np.int64))

    return fingerprint


def chain_key(fp: Column, start: int) -> Column:
    """The exact part of the chain that begins at segment `start`, told apart by the start."""
    turned = F.shiftleft(fp, WIDTH * start).bitwiseOR(F.shiftrightunsigned(fp, (64 - WIDTH * start) % 64))
    return F.shiftrightunsigned(turned, 64 - WIDTH * EXACT) + F.lit(start << (WIDTH * EXACT))


def bucket_links(keys: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one bucket that join its components: pairs that pass the chains and the full check.

    Works by blocks of rows; a pair inside a component that is joined already is not returned.
    """
    n = len(members)
    start = np.uint64(WIDTH * (int(keys) >> (WIDTH * EXACT)))
    turned = (members << start) | (members >> ((np.uint64(64) - start) % np.uint64(64)))
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    a, b = [], []
    for lo in range(0, n, 256):
        block = turned[lo : lo + 256]
        differ = block[:, None] ^ turned[None, lo:]
        passed = np.ones(differ.shape, bool)
        for l, budget in enumerate(BUDGET, 1):
            if l > EXACT and (l == SEGMENTS or budget < BUDGET[l]):  # the longest chain of each budget
                passed &= np.bitwise_count(differ >> np.uint64(64 - WIDTH * l)) <= budget
        for i, j in zip(*np.nonzero(passed)):
            i, j = i + lo, j + lo
            if i < j and (x := root(i)) != (y := root(j)):
                parent[max(x, y)] = min(x, y)
                a.append(members[i])
                b.append(members[j])
    return np.array(a, np.uint64), np.array(b, np.uint64)


def _links_udf():
    @F.arrow_udf("array<struct<a:long,b:long>>")
    def links(key: pa.Array, members: pa.Array) -> pa.Array:
        at, flat = members.offsets.to_numpy(), members.values.to_numpy(zero_copy_only=False).view(np.uint64)
        firsts, seconds, ends = [], [], [0]
        for i, k in enumerate(key.to_numpy(zero_copy_only=False)):
            a, b = bucket_links(k, np.sort(flat[at[i] : at[i + 1]]))
            firsts.append(a)
            seconds.append(b)
            ends.append(ends[-1] + len(a))
        a, b = (np.concatenate([np.zeros(0, np.uint64), *x]).view(np.int64) for x in (firsts, seconds))
        pairs = pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)

    return links


def fingerprint_links(distinct: DataFrame, most_in_bucket: int = 4096) -> DataFrame:
    """(a, b): enough links among distinct fingerprints (column fp) to join whatever links join."""
    keyed = distinct.select("fp", F.explode(F.array(*[chain_key(F.col("fp"), i) for i in range(SEGMENTS)])).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > 1)
    shared = cut(keyed.join(sizes, "key"), "chains")
    links = _links_udf()
    cold = shared.filter(F.col("size") <= most_in_bucket).groupBy("key").agg(F.collect_list("fp").alias("members"))
    cold = cold.select(F.explode(links("key", "members")).alias("link")).select("link.a", "link.b")
    hot = shared.filter(F.col("size") > most_in_bucket).select("fp").distinct()
    near = F.concat(F.array("fp"), *[F.array(F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), b))) for b in range(64)])
    ball = hot.select("fp", F.explode(near).alias("point")).groupBy("point").agg(F.sort_array(F.collect_list("fp")).alias("members")).filter(F.size("members") > 1)
    ball = ball.select(F.col("members")[0].alias("a"), F.explode(F.slice("members", 2, 64)).alias("b")).distinct()
    return cold.unionByName(ball)


def _classes(docs: DataFrame, size: int, most_in_bucket: int) -> tuple[DataFrame, DataFrame]:
    """((doc_id, of, fp) of every row, with `of` a hash of the text; (fp, component_id))."""
    limit_batches(docs.sparkSession)
    body = text_bytes(F.col("text"))
    marked = cut(docs.select("doc_id", F.xxhash64(body).alias("of"), fingerprint_udf(size)(body).alias("fp")), "fingerprints")
    first = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = connected_components(fingerprint_links(first.select("fp"), most_in_bucket))
    named = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked, named.select("fp", "root").join(names, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, size: int = 3, most_in_bucket: int = 4096) -> DataFrame:
    """doc_id, fp (long) and component_id of every row."""
    marked, classes = _classes(docs, size, most_in_bucket)
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, size: int = 3, most_in_bucket: int = 4096, similarity: tuple[int, int] | None = None) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row of the smallest doc_id.

    Components are of fingerprints that link; with a similarity (p, q), of texts whose shingle sets
    have a Jaccard similarity of p / q or more. No distance of fingerprints can stand for that: at 0.8
    they differ in 10 of 64 bits on average, so that 2 bits miss nearly all and 16 link strangers.
    Such components are found by `similar.components`: linked fingerprints are candidates there, bands
    of minima give the rest, and the sets themselves decide.

    A component without any doc_id keeps one row; repeated rows of the kept doc_id leave one. Extra
    columns are kept, whatever their names are.
    """
    if similarity is None:
        marked, classes = _classes(docs, size, most_in_bucket)
        return keep_least(docs, marked.join(classes, "fp").select("doc_id", "of", "root"))
    rows, roots = similar.components(docs, size, *similarity)
    return keep_least(docs, rows.join(roots, "sid", "left").select("doc_id", "of", F.coalesce("root", "sid").alias("root")))


def keep_least(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """The rows of docs that stand for their component; rooted: (doc_id, of, root) of every row, `of` a hash of the text."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "of")
    best = rooted.groupBy("root").agg(F.min(rank).alias("best"))
    kept = cut(best.select(F.col("best.doc_id").alias("id"), F.col("best.of").alias("of")), "kept")
    held = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64(text_bytes(F.col("text"))).alias("of"))
    held = held.join(kept, held["id"].eqNullSafe(kept["id"]) & (held["of"] == kept["of"]), "left_semi")
    if not rooted.groupBy("doc_id", "of").count().filter(F.col("count") > 1).isEmpty():
        held = held.dropDuplicates(["id", "of"])
    return held.select("row.*")
