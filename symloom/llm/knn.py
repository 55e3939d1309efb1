"""Exact top-k search by inner product: a Voronoi kNN join.

Vectors become integers (floor(scale * x)). Pivots deal all vectors into cells; a cell's summary has
its number of vectors, its radius (the largest distance of a vector from the pivot), and a ladder of
radii within which at least 1, 2, 4, ... of its vectors lie. Queries are grouped by their nearest
pivot too. For a group of queries around pivot p with radius r, and a cell around c with radius s,
every score lies within p.c +- (r |c| + |p| s + r s). From the ladders follows a score that each
query of the group surely reaches k times; a cell whose upper bound is below it cannot hold an
answer. First each query is solved in its own cell, which raises the score that it surely reaches;
then it is sent to those other cells alone that its group's bounds and its own (q.c + |q| s) leave.
Cells and the queries sent to them are dealt into parts of bounded size, which are solved locally
with blocked matrix products; of a part, only scores that a query does not surely exceed are kept.

Defined cases: vectors that are null, hold a null or a component that is not finite take no part;
vectors of different lengths score over the positions that both have (the shorter is filled with
zeros); ties go to the smaller vec_id; rows with the vec_id of the query are the query's own; equal
rows (vec_id and vector) are candidates each, and one query; a null vec_id takes no part; fewer than
k candidates give fewer rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, limit_batches

OUT = "query_id long, rank int, vec_id long, score long"


def quantised(embedding: Column, scale: int = 64) -> Column:
    """array<long>, null where the vector takes no part."""
    x = embedding.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.when(~bad, F.transform(x, lambda v: F.floor(F.lit(scale) * v).cast("long")))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _pivots(vectors: DataFrame, n: int, most: int) -> np.ndarray:
    """Spread pivots out of a bounded, hash-chosen sample: farthest-first."""
    total = vectors.count()
    rate = min(1.0, most / max(total, 1))
    sample = vectors.filter(F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1 << 20)) < int(rate * (1 << 20))).orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).toPandas()
    if not len(sample):
        sample = vectors.limit(1).toPandas()
    if not len(sample):
        return np.zeros((1, 1))
    width = int(max(map(len, sample["v"]), default=0))
    points = _matrix(sample["v"], max(width, 1))
    n = max(1, min(n, len(points)))
    chosen = [0]
    far = ((points - points[0]) ** 2).sum(1)
    while len(chosen) < n:
        i = int(far.argmax())
        if far[i] == 0:
            break
        chosen.append(i)
        far = np.minimum(far, ((points - points[i]) ** 2).sum(1))
    return points[chosen]


def _fit(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: floats while every sum is below 2^53, Python integers beyond."""
    width = max(a.shape[1], b.shape[1])
    a, b = _fit(a, width), _fit(b, width)
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * width < 2**53:
        return (a @ b.T).astype(np.int64)
    return (a.astype(np.int64).astype(object) @ b.astype(np.int64).astype(object).T).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one query, ties to the smaller id; ids come sorted."""
    scores, ids = scores[ids != own], ids[ids != own]
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64, pivots: int = 64, most_sample: int = 4000, part: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: of every row for which `queries` holds, its k best other rows."""
    spark = vectors.sparkSession
    limit_batches(spark, 4096, 32)
    whole = vectors.filter(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("v")).filter(F.col("v").isNotNull())
    centre = _pivots(whole, pivots, most_sample)
    held = spark.sparkContext.broadcast(centre)  # at most `pivots` vectors

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            width = max(held.value.shape[1], max(map(len, f["v"])))
            points, c = _matrix(f["v"], width), _fit(held.value, width)
            square = (points**2).sum(1)[:, None] - 2 * points @ c.T + (c**2).sum(1)
            cell = square.argmin(1)
            away = np.sqrt(((points - c[cell]) ** 2).sum(1))
            yield f.assign(cell=cell.astype(np.int32), away=away)

    dealt = cut(whole.mapInPandas(deal, "vec_id long, v array<long>, cell int, away double"), "cells")
    asked = dealt.filter(queries)

    # Summaries: per cell the count, the radius, and a histogram of distances from which the ladder is read.
    steps = 64
    radius = {r["cell"]: (r["n"], r["radius"]) for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}
    if not radius:
        return spark.createDataFrame([], OUT)
    reach = {r["cell"]: r["radius"] for r in asked.groupBy("cell").agg(F.max("away").alias("radius")).collect()}
    widths = F.element_at(F.create_map(*[x for c, (_, r) in radius.items() for x in (F.lit(c), F.lit(r))]), F.col("cell"))
    rung = F.least(F.lit(steps - 1), F.when(widths > 0, F.floor(F.col("away") / widths * steps)).otherwise(0)).cast("int")
    ladder = {(r["cell"], r["rung"]): r["n"] for r in dealt.groupBy("cell", rung.alias("rung")).agg(F.count("*").alias("n")).collect()}

    sure, wanted = _group_bounds(centre, radius, reach, ladder, steps, k)
    parts = _table({c: -(-n // part) for c, (n, _) in radius.items()})
    data = dealt.select(F.col("cell").alias("d_cell"), F.pmod(F.xxhash64("vec_id"), parts("cell")).cast("int").alias("d_part"), F.col("vec_id"), F.col("v").alias("d_v"))
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q_v"), F.col("cell").alias("own")).distinct()

    own = asked.select("query_id", "q_v", F.col("own").alias("cell"), _table(sure)("own").cast("double").alias("least"))
    near = cut(_solve(own, data, parts, k, part), "near")
    reached = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k)
    bounds = spark.sparkContext.broadcast((centre, radius, sure, wanted))  # pivots^2 flags at most

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, held_radius, held_sure, held_wanted = bounds.value
        cells = np.array(sorted(held_radius))
        s = np.array([held_radius[x][1] for x in cells])
        for f in frames:
            if not len(f):
                continue
            width = max(c.shape[1], max(map(len, f["q_v"])))
            q = _matrix(f["q_v"], width)
            upper = q @ _fit(c, width)[cells].T + np.sqrt((q**2).sum(1))[:, None] * s
            least = np.maximum(f["kth"].fillna(-np.inf).to_numpy(float), np.array([held_sure[x] for x in f["own"]]))
            go = upper >= (least - 1e-6 * (1 + np.where(np.isfinite(least), np.abs(least), 0)))[:, None]
            go &= np.array([[x in held_wanted[o] and x != o for x in cells] for o in f["own"]])
            row, col = np.nonzero(go)
            yield pd.DataFrame({"query_id": f["query_id"].to_numpy()[row], "q_v": f["q_v"].to_numpy()[row], "cell": cells[col].astype(np.int32), "least": least[row]})

    far = asked.join(reached.select("query_id", "kth"), "query_id", "left").mapInPandas(send, "query_id long, q_v array<long>, cell int, least double")
    return merged(near.unionByName(_solve(cut(far, "sent"), data, parts, k, part)), k)


def _table(values: dict[int, float]):
    """A column function that looks a cell's value up; there are no more values than pivots."""
    if not values:
        return lambda name: F.lit(None)
    held = F.create_map(*[x for c, v in values.items() for x in (F.lit(c), F.lit(float(v)) if isinstance(v, float) else F.lit(v))])
    return lambda name: F.element_at(held, F.col(name))


def _group_bounds(centre, radius, reach, ladder, steps: int, k: int) -> tuple[dict[int, float], dict[int, set[int]]]:
    """By query group: the score that each of its queries surely reaches k times; the cells that may hold answers."""
    norm = np.sqrt((centre**2).sum(1))
    sure, wanted = {}, {}
    for p, r in reach.items():
        floor = []
        for c, (_, s) in radius.items():
            for j in range(steps):
                if m := ladder.get((c, j)):
                    near = s * (j + 1) / steps * (1 + 1e-9)
                    floor.append((centre[p] @ centre[c] - r * norm[c] - norm[p] * near - r * near, m))
        floor.sort(reverse=True)
        sure[p], left = float("-inf"), k + 1  # one of them may be the query itself
        for score, m in floor:
            left -= m
            if left <= 0:
                sure[p] = float(score - 1e-6 * (1 + abs(score)))
                break
        wanted[p] = {c for c, (_, s) in radius.items() if centre[p] @ centre[c] + r * norm[c] + norm[p] * s + r * s >= sure[p]}
    return sure, wanted


def _solve(sent: DataFrame, data: DataFrame, parts, k: int, part: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query in each part of the cells that it is sent to."""
    asked = {r["cell"]: -(-r["n"] // part) for r in sent.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    if not asked:
        return sent.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
    blocks = _table(asked)
    left = sent.withColumn("block", F.pmod(F.xxhash64("query_id"), blocks("cell")).cast("int"))
    left = left.select("cell", "block", F.explode(F.sequence(F.lit(0), (parts("cell") - 1).cast("int"))).alias("part"), "query_id", "q_v", "least")
    right = data.filter(F.col("d_cell").isin(list(asked)))
    right = right.select("d_cell", "d_part", F.explode(F.sequence(F.lit(0), (blocks("d_cell") - 1).cast("int"))).alias("d_block"), "vec_id", "d_v")

    def solve(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        right = right.sort_values("vec_id", kind="stable")
        ids = right["vec_id"].to_numpy()
        width = max(max(map(len, left["q_v"])), max(map(len, right["d_v"])), 1)
        points = _matrix(right["d_v"], width)
        q_ids, v_ids, scores = [], [], []
        for lo in range(0, len(left), 256):
            block = left.iloc[lo : lo + 256]
            dots = _dots(_matrix(block["q_v"], width), points)
            for q, least, row in zip(block["query_id"].to_numpy(), block["least"].to_numpy(), dots):
                keep = np.flatnonzero(row >= least)
                best, score = _best(row[keep], ids[keep], q, k)
                q_ids.append(np.full(len(best), q))
                v_ids.append(best)
                scores.append(score)
        return pd.DataFrame({"query_id": np.concatenate(q_ids), "vec_id": np.concatenate(v_ids), "score": np.concatenate(scores)})

    left, right = left.groupBy("cell", "part", "block"), right.groupBy("d_cell", "d_part", "d_block")
    return left.cogroup(right).applyInPandas(solve, "query_id long, vec_id long, score long")


def merged(local: DataFrame, k: int) -> DataFrame:
    """The k best of each query's local answers."""
    key = F.struct((-F.col("score")).alias("low"), "vec_id")
    best = local.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(key)), 1, k).alias("best"))
    out = best.select("query_id", F.posexplode("best").alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.low")).alias("score"))
