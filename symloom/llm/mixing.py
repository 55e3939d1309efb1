"""Mixing sources to target weights by Pfair scheduling.

Time runs in slots of one block. A source of weight w releases its k-th block (k from 0) at slot
floor(k / w) and must send it before slot ceil((k + 1) / w); in each slot the released block of the
earliest deadline goes. As the weights add up to 1, every deadline is met, and after every slot each
source is less than one block from its target share. Weights are multiples of 1 / slots, so that one
period of `slots` slots is scheduled once and repeats: the k-th block of a source with n slots in the
period goes in slot (k div n) * slots + (the source's (k mod n)-th slot of the period).

Documents of a source are put in the order of a hash of their id, and `block` consecutive documents
make a block. Their ordinals come from counts per source and hash bucket and a rank within the
bucket, so that no source is gathered in one place.

Nothing is dropped: slots after a source has run out stay empty of it, and `in_mix` marks the
documents up to there, where the weights hold.

Defined cases: a null source is a source by itself; repeated rows take a place each; a null doc_id
hashes as empty text; ties of the hash go by doc_id, rows equal in both take their places in any
order; an empty table gives an empty result; a source without a given weight gets weight 0 and its
documents follow after all slots, not in the mix; texts, null or very long, play no part; extra
columns are ignored by `mix` and kept by `mixed`, whatever their names are, but for mix_* and in_mix.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MixParams:
    #: Weight by source; None: the square root of each source's share of documents.
    weights: dict[str | None, float] | None = None
    #: Documents in a block.
    block: int = 16
    #: Slots of a period: weights are rounded to multiples of 1 / slots.
    slots: int = 1000
    #: More sources than this are refused: the schedule is planned on the driver.
    most_sources: int = 1000


def quotas(weights: dict[str | None, float], slots: int) -> dict[str | None, int]:
    """Slots of each source in a period, by largest remainders; a positive weight gets a slot at least."""
    total = sum(weights.values())
    names = sorted(weights, key=lambda s: (s is not None, s or ""))
    exact = {s: weights[s] / total * slots for s in names if weights[s] > 0}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    while (short := slots - sum(out.values())) > 0:
        for s in sorted(out, key=lambda s: (-(exact[s] - int(exact[s])), s is not None, s or ""))[:short]:
            out[s] += 1
    while sum(out.values()) > slots:
        out[max(out, key=lambda s: (out[s], s is not None, s or ""))] -= 1
    return out


def schedule(quota: dict[str | None, int]) -> dict[str | None, list[int]]:
    """Slots of each source in one period: earliest deadline first among the released blocks."""
    slots = sum(quota.values())
    names = sorted(quota, key=lambda s: (s is not None, s or ""))
    release: list[list[tuple[int, int, int]]] = [[] for _ in range(slots)]
    for i, s in enumerate(names):
        for k in range(quota[s]):
            release[k * slots // quota[s]].append((-(-(k + 1) * slots // quota[s]), i, k))
    ready: list[tuple[int, int, int]] = []
    out: dict[str | None, list[int]] = {s: [] for s in names}
    for now in range(slots):
        for x in release[now]:
            heapq.heappush(ready, x)
        deadline, i, _ = heapq.heappop(ready)
        assert deadline > now
        out[names[i]].append(now)
    return out


def _ordinals(rows: DataFrame) -> DataFrame:
    """rows (with id and source) and the ordinal k of each within its source, by hash.

    The window and the join with the offsets share their keys: rows are shuffled once.
    """
    key = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))
    keyed = rows.withColumns({"none": F.col("source").isNull(), "name": F.coalesce(F.col("source").cast("string"), F.lit("")), "hash": key})
    keyed = keyed.withColumn("bucket", F.substring("hash", 1, 3))
    keys = ["none", "name", "bucket"]
    counts = keyed.groupBy(*keys).agg(F.count("*").alias("n"))
    before = W.partitionBy("none", "name").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = keyed.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy("hash", "id")))
    return ranked.join(offsets, keys).withColumn("k", F.col("before") + F.col("rank") - 1).drop(*keys, "hash", "before", "rank")


def _plan(docs: DataFrame, p: MixParams) -> tuple[dict[str | None, int], dict[str | None, list[int]], int]:
    """(quota, slots by source, slots of the mix: up to where the first source runs out)."""
    counts = docs.groupBy("source").count().limit(p.most_sources + 1).collect()
    if len(counts) > p.most_sources:
        raise ValueError(f"over {p.most_sources} sources; raise most_sources and slots")
    n = {r["source"]: r["count"] for r in counts}
    if not n:
        return {}, {}, 0
    weights = p.weights if p.weights is not None else {s: c**0.5 for s, c in n.items()}
    weights = {s: weights.get(s, 0.0) for s in n}
    if not any(w > 0 for w in weights.values()):
        return {}, {}, 0
    quota = quotas(weights, max(p.slots, len(n)))
    at = schedule(quota)
    period = sum(quota.values())
    full = {s: n[s] // p.block for s in quota}  # whole blocks: the first block that is not whole ends the mix
    end = min((k // quota[s]) * period + at[s][k % quota[s]] for s, k in full.items())
    return quota, at, end


MIX = ("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_place", "in_mix")


def mixed(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """docs with mix_block, mix_release, mix_deadline, mix_slot, mix_place (within the block) and in_mix.

    Columns of docs that have one of these names are replaced.
    """
    quota, at, end = _plan(docs, p)
    held = _ordinals(docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), "source"))
    period = sum(quota.values()) or 1
    known = list(quota)
    rank = F.coalesce(*[F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(i)) for i, s in enumerate(known)], F.lit(-1)) if known else F.lit(-1)
    held = held.select("row", "k", rank.alias("i"), F.floor(F.col("k") / p.block).cast("long").alias("b"))
    n = F.get(F.array(*[F.lit(quota[s]) for s in known] or [F.lit(None).cast("int")]), F.col("i")).cast("long")
    slots = F.array(*[F.array(*map(F.lit, at[s])) for s in known] or [F.array(F.lit(None).cast("int"))])
    held = held.withColumn("n", F.when(F.col("i") >= 0, n))
    b = F.col("b")
    slot = F.floor(b / F.col("n")).cast("long") * period + F.get(F.get(slots, F.greatest(F.col("i"), F.lit(0))), (b % F.col("n")).cast("int"))
    values = (b, F.floor(b * period / F.col("n")).cast("long"), F.ceil((b + 1) * period / F.col("n")).cast("long"), slot, (F.col("k") % p.block).cast("int"), F.coalesce(slot < end, F.lit(False)))
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in MIX]
    return held.select(*own, *[v.alias(c) for v, c in zip(values, MIX, strict=True)])


def mix(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """The place of every row in the mix, without its text."""
    return mixed(docs.select("doc_id", "source"), p)
