"""Token budgets: prefixes that fit, rollups of cost, the greedy choice of a map and its rendering."""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tokens import CHARS_PER_TOKEN, estimate, estimate_text
from ..session import apart


def running_total(df: DataFrame, cost: Column, order: list, bucket_keys: list[str] | None = None) -> DataFrame:
    """df with `spent`: the cost up to and with each row.

    bucket_keys are columns whose values come in the order of `order` (such as the path of rows that
    are ordered by path and line): totals by bucket are summed first, so that only the small table of
    buckets passes one task. Without them the rows must be few.
    """
    df = df.withColumn("_cost", cost)
    if not bucket_keys:
        return df.withColumn("spent", F.sum("_cost").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))).drop("_cost")
    totals = df.groupBy(*bucket_keys).agg(F.sum("_cost").alias("_total"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_total").over(W.orderBy(*bucket_keys).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_total")
    own = F.sum("_cost").over(W.partitionBy(*bucket_keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("_own", own).join(before, bucket_keys).withColumn("spent", F.col("_own") + F.col("_before")).drop("_cost", "_own", "_before")


def budget_prefix(df: DataFrame, text: str, order: list, budget: int, bucket_keys: list[str] | None = None) -> DataFrame:
    """The rows before the first one that the budget does not reach; a line costs its estimate with its newline."""
    return running_total(df, estimate(F.col(text)) + 1, order, bucket_keys).filter(F.col("spent") <= budget)


def entry_line(line: Column, depth: Column, signature: Column) -> Column:
    """A line of a map: number, indent, signature."""
    return F.concat(F.lpad((line + 1).cast("string"), 5, " "), F.lit("  "), F.repeat(F.lit("  "), depth), signature)


def skeleton_prefix(symbols: DataFrame, budget: int) -> DataFrame:
    """Signatures in the order of paths and lines, cut at the budget."""
    shown = symbols.filter(~F.col("is_synthetic") & ~F.col("is_local")).select("id", "path", "name_start_line", F.coalesce("signature", "name").alias("signature"))
    return budget_prefix(shown, "signature", ["path", "name_start_line", "id"], budget, ["path"])


def grep_prefix(files: DataFrame, words: Iterable[str], budget: int, width: int = 120) -> DataFrame:
    """files(path, content): lines that hold any of the words in either case, busiest file first, cut at the budget."""
    low = [w.lower() for w in words]
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    any_of = F.lit(False)
    for w in low:
        any_of = any_of | F.lower("text").contains(w)
    hits = lines.filter(any_of).withColumn("text", F.substring("text", 1, width))
    busy = hits.groupBy("path").agg(F.count("*").alias("hits"))
    ordered = hits.join(busy, "path").withColumn("_rank", -F.col("hits"))
    return budget_prefix(ordered, "text", ["_rank", "path", "line"], budget, ["_rank", "path"]).drop("_rank")


def token_tree(files: DataFrame, depth: int = 3) -> DataFrame:
    """files(path, tokens, symbols) -> by path prefix up to a depth: tokens, files, symbols, the costliest first."""
    parts = F.split("path", "/")
    every = files.select("tokens", "symbols", F.explode(F.sequence(F.lit(0), F.least(F.lit(depth), F.size(parts)))).alias("level"), parts.alias("parts"))
    prefix = F.array_join(F.slice("parts", 1, F.col("level")), "/")
    out = every.groupBy("level", prefix.alias("path")).agg(F.sum("tokens").cast("long").alias("tokens"), F.count("*").alias("files"), F.sum("symbols").cast("long").alias("symbols"))
    return out.orderBy("level", F.desc("tokens"), "path")


def top_files(scored: DataFrame, n: int) -> DataFrame:
    """Rows (path, score, ...) of the n files with the best score."""
    best = scored.groupBy("path").agg(F.max("score").alias("_best")).orderBy(F.desc("_best"), "path").limit(n)
    return scored.join(F.broadcast(best.select("path")), "path", "left_semi")  # n rows


def file_discount(scored: DataFrame, spread: float = 0.5) -> DataFrame:
    """score / k ** spread for the k-th symbol of its file: what the greedy choice sees before it chooses."""
    k = F.row_number().over(W.partitionBy("path").orderBy(F.desc("score"), "id"))
    return scored.withColumn("k", k).withColumn("gain", F.col("score") / F.pow("k", F.lit(spread)))


@dataclass(frozen=True)
class Entry:
    """What the greedy choice needs of a symbol."""

    id: str
    path: str
    line: int
    signature: str
    score: float
    container_id: str | None = None
    kind: str = ""


def pool(symbols: DataFrame, ranks: DataFrame, budget: int, least_score: float = 0.0, files: int | None = None) -> DataFrame:
    """The best 4 x budget navigable symbols: no line costs less than a token, so more can't matter."""
    own = symbols.filter(~F.col("is_synthetic") & ~F.col("is_local")).select("id", "path", "name", "kind", "container_id", F.coalesce("signature", "name").alias("signature"), F.col("name_start_line").alias("line"))
    scored = own.join(apart(ranks.select(F.col("symbol_id").alias("id"), "score")), "id").filter(F.col("score") >= least_score)
    scored = top_files(scored, files) if files else scored
    return scored.orderBy(F.desc("score"), "path", "line", "id").limit(4 * budget)


def choose(entries: list[Entry], containers: dict[str, Entry], budget: int, spread: float = 0.5, chars_per_token: float = CHARS_PER_TOKEN) -> list[Entry]:
    """Greedy: of what fits, the best gain per token, again and again.

    The gain of a file's k-th symbol is its score / k ** spread; its cost is its own line, its file's
    header (and the blank line before it) if new, and the lines of containers that aren't shown yet.
    Entries come in rank order, which decides ties. The queue is keyed by what a symbol could be worth
    at best, its score over its own line; a symbol is taken only if what it is worth now is no less
    than the key of the next.
    """
    taken: dict[str, Entry] = {}
    in_file: dict[str, int] = {}

    def line(e: Entry) -> int:
        return estimate_text(f"{e.line + 1:>5}  {e.signature}\n", chars_per_token)

    def missing(e: Entry) -> list[Entry]:
        out, at = [], e.container_id
        while at in containers and at not in taken and containers[at] not in out:
            out.append(containers[at])
            at = containers[at].container_id
        return out

    def now(e: Entry) -> tuple[float, int]:
        cost = line(e) + sum(map(line, missing(e))) + (0 if e.path in in_file else estimate_text(f"{e.path}:\n", chars_per_token) + 1)
        return e.score / (in_file.get(e.path, 0) + 1) ** spread / cost, cost

    queue = [(-e.score / line(e), i) for i, e in enumerate(entries)]
    heapq.heapify(queue)
    left = budget
    while queue and left > 0:
        key, i = heapq.heappop(queue)
        e = entries[i]
        if e.id in taken:
            continue
        worth, cost = now(e)
        if queue and -worth > queue[0][0] and -worth != key:
            heapq.heappush(queue, (-worth, i))
        elif cost <= left:
            for x in [*missing(e), e]:
                taken[x.id] = x
            in_file[e.path] = in_file.get(e.path, 0) + 1
            left -= cost
    return list(taken.values())


def render(chosen: list[Entry]) -> str:
    """Files by their best score, entries in the order of the text, indented below their containers."""
    by_file: dict[str, list[Entry]] = {}
    for e in chosen:
        by_file.setdefault(e.path, []).append(e)
    known = {e.id: e for e in chosen}

    def depth(e: Entry) -> int:
        n, at, seen = 0, e.container_id, set()
        while at in known and at not in seen:
            seen.add(at)
            n, at = n + 1, known[at].container_id
        return n

    blocks = []
    for path, own in sorted(by_file.items(), key=lambda x: (-max(e.score for e in x[1]), x[0])):
        lines = [f"{e.line + 1:>5}  {'  ' * depth(e)}{e.signature}" for e in sorted(own, key=lambda e: (e.line, e.id))]
        blocks.append("\n".join([f"{path}:", *lines]))
    return "\n\n".join(blocks)


def render_map(symbols: DataFrame, ranks: DataFrame, budget: int, spread: float = 0.5, least_score: float = 0.0, files: int | None = None, chars_per_token: float = CHARS_PER_TOKEN) -> tuple[str, list[Entry]]:
    """A map within a token budget. Only the bounded pool and the containers of its symbols reach the driver."""
    held = pool(symbols, ranks, budget, least_score, files).collect()
    entries = [Entry(r["id"], r["path"], r["line"], r["signature"], r["score"], r["container_id"], r["kind"]) for r in held]
    found = {e.id: e for e in entries}
    want = {e.container_id for e in entries if e.container_id} - found.keys()
    asked: set[str] = set()
    while want:  # a round for each level of nesting; the pool is bounded, and an id is asked for once
        asked |= want
        rows = symbols.filter(F.col("id").isin(sorted(want)) & ~F.col("is_synthetic")).select("id", "path", F.coalesce("signature", "name").alias("signature"), F.col("name_start_line").alias("line"), "container_id", "kind").collect()
        new = {r["id"]: Entry(r["id"], r["path"], r["line"], r["signature"], 0.0, r["container_id"], r["kind"]) for r in rows}
        found |= new
        want = {e.container_id for e in new.values() if e.container_id} - found.keys() - asked
    chosen = choose(entries, found, budget, spread, chars_per_token)
    text = render(chosen)
    while chosen and estimate_text(text, chars_per_token) > budget:
        last = min((e for e in chosen if not any(x.container_id == e.id for x in chosen)), key=lambda e: (e.score, e.id))
        chosen.remove(last)
        text = render(chosen)
    return text, chosen

