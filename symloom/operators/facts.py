"""Facts of an index keyed by place, and their one-to-one matching with those of another."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalise_path
from ..functions.spans import overlaps
from ..schema import INHERITANCE, MENTIONS, NAVIGABLE
from ..session import apart


def edge_group(kind: Column) -> Column:
    """Kinds that indexes spell differently count as one."""
    return F.when(kind.isin(*MENTIONS), "reference-like").when(kind.isin(*INHERITANCE), "inheritance-like").otherwise(kind)


def definition_facts(symbols: DataFrame, kinds: Iterable[str] = NAVIGABLE, paths: DataFrame | None = None) -> DataFrame:
    """(path, name span, kind) of symbols that a reader could find; paths(path): only there."""
    own = symbols.filter(~F.col("is_synthetic") & ~F.col("is_local") & F.col("kind").isin(*kinds))
    out = own.select(normalise_path(F.col("path")).alias("path"), *[F.col(f"name_{x}").alias(x) for x in SPAN], "kind").distinct()
    return out.join(paths.select("path").distinct(), "path", "left_semi") if paths is not None else out


SPAN = ("start_line", "start_char", "end_line", "end_char")


def reference_facts(symbols: DataFrame, edges: DataFrame, kinds: Iterable[str] = NAVIGABLE) -> tuple[DataFrame, DataFrame]:
    """(facts, edges that give none).

    A fact is a site, the name span of what it means, and a group of kinds. An inheritance edge gives
    two: a mention at its site, and a relation anchored at its source's name. A constructor also
    answers to its class's name span in the same file.
    """
    name = [F.col(f"name_{x}").alias(x) for x in SPAN]
    real = symbols.filter(~F.col("is_synthetic"))
    outer = real.select(F.col("id").alias("_up"), F.col("path").alias("_up_path"), *[F.col(f"name_{x}").alias(f"alternate_{x}") for x in SPAN])
    target = real.select(F.col("id").alias("dst_id"), F.col("kind").alias("target_kind"), "is_local", "container_id", F.col("path").alias("target_path"), *[c.alias(f"target_{x}") for c, x in zip(name, SPAN)])
    target = target.join(outer, (F.col("target_kind") == "constructor") & (F.col("container_id") == F.col("_up")) & (F.col("target_path") == F.col("_up_path")), "left").drop("_up", "_up_path", "container_id")
    source = real.select(F.col("id").alias("src_id"), F.col("path").alias("src_path"), *[F.col(f"name_{x}").alias(f"src_{x}") for x in SPAN])
    own = edges.filter(F.col("kind") != "contains").withColumn("_edge", F.monotonically_increasing_id())
    found = own.join(target, "dst_id", "left")
    good = found.filter(F.col("target_path").isNotNull() & ~F.col("is_local") & F.col("target_kind").isin(*kinds))
    rest = ["target_path", *[f"target_{x}" for x in SPAN], *[f"alternate_{x}" for x in SPAN], "confidence"]
    group = edge_group(F.col("kind"))
    inherits = F.col("kind").isin(*INHERITANCE)
    mention = good.filter(F.col("site_path").isNotNull()).select("site_path", *[f"site_{x}" for x in SPAN], F.when(inherits, "reference-like").otherwise(group).alias("kind"), *rest)
    relation = good.filter(inherits).join(source, "src_id").select(F.col("src_path").alias("site_path"), *[F.col(f"src_{x}").alias(f"site_{x}") for x in SPAN], group.alias("kind"), *rest)
    facts = mention.unionByName(relation)
    for column in ("site_path", "target_path"):
        facts = facts.withColumn(column, normalise_path(F.col(column)))
    dropped = found.filter(F.col("target_path").isNull() | (F.col("site_path").isNull() & ~inherits)).select(*edges.columns)
    return facts, dropped


def outside(facts: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """Facts that don't lie at any of the places."""
    return facts.join(places.select(*keys).distinct(), keys, "left_anti")


def inside(facts: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    return facts.join(places.select(*keys).distinct(), keys, "left_semi")


def maximum_matching(near: list[list[int]], right: int, held: list[int] | None = None) -> list[int]:
    """Right partner of each left node (-1: none): shortest augmenting paths, lowest numbers first.

    held: a matching to begin with; its nodes stay matched, if need be to others.
    """
    partner = list(held) if held is not None else [-1] * len(near)
    owner = [-1] * right
    for left, r in enumerate(partner):
        if r >= 0:
            owner[r] = left
    for root in range(len(near)):
        if partner[root] >= 0:
            continue
        queue, reached_from = [root], {}
        for left in queue:
            free = None
            for r in near[left]:
                if r in reached_from:
                    continue
                reached_from[r] = left
                if owner[r] < 0:
                    free = r
                    break
                queue.append(owner[r])
            if free is not None:
                while free >= 0:
                    left = reached_from[free]
                    given_up = partner[left]
                    partner[left], owner[free] = free, left
                    free = given_up
                break
    return partner


def _spans_agree(a: tuple, b: tuple, policy: str) -> bool:
    if policy == "line":
        return a[0] == b[0]
    if policy == "exact":
        return a == b
    a0, a1, b0, b1 = a[:2], a[2:], b[:2], b[2:]
    if a0 == a1 or b0 == b1:
        return a0 <= b1 and b0 <= a1
    return a0 < b1 and b0 < a1


def _columns_agree(a: list[Column], b: list[Column], policy: str) -> Column:
    """_spans_agree of two spans of four columns each."""
    if policy == "line":
        return a[0].eqNullSafe(b[0])
    if policy == "exact":
        return reduce(and_, [x.eqNullSafe(y) for x, y in zip(a, b)])
    ends = lambda s: (F.struct(s[0].alias("line"), s[1].alias("char")), F.struct(s[2].alias("line"), s[3].alias("char")))
    return overlaps(ends(a), ends(b))


def _facts_agree(a: Column, b: Column, prefix: str, targets: bool, policy: str) -> Column:
    """Whether two facts agree, as match_facts has it."""
    span = lambda f, p: [f[f"{p}{x}"] for x in SPAN]
    kinds = a["kind"].isNull() | b["kind"].isNull() | (a["kind"] == b["kind"])
    agree = kinds & _columns_agree(span(a, prefix), span(b, prefix), policy)
    if not targets:
        return agree
    sides = [(span(a, p), span(b, q)) for p in ("target_", "alternate_") for q in ("target_", "alternate_")]
    meant = reduce(or_, [x[0].isNotNull() & y[0].isNotNull() & _columns_agree(x, y, policy) for x, y in sides])
    return agree & a["target_path"].eqNullSafe(b["target_path"]) & meant


def _known(side: str, prefix: str, targets: list[str], policy: str) -> Column:
    """Whether the first fact's spans can be compared by columns: overlap compares every part."""
    f = F.get(side, F.lit(0))
    if policy != "overlap":
        return F.lit(True)
    whole = lambda p: reduce(and_, [f[f"{p}{x}"].isNotNull() for x in SPAN])
    return reduce(and_, [whole(prefix), *[whole(p) | f[f"{p}start_line"].isNull() for p in (("target_", "alternate_") if targets else ())]])


def match_facts(candidate: DataFrame, oracle: DataFrame, policy: str = "overlap", prefix: str = "") -> DataFrame:
    """Facts of both sides, one row of each pair or of each fact left alone: status tp, fp or fn, tolerant or not.

    Facts meet if they lie on one line of one file; as many as can be are matched, one to one: exact
    pairs first, and from these on by the policy, which may match their facts anew. Kinds must agree where both have one;
    facts with a target must agree on it, or on the alternates of either. A fact without a place meets none.
    """
    columns = [f"{prefix}path" if prefix else "path", *[f"{prefix}{x}" for x in SPAN], "kind"]
    targets = [c for c in candidate.columns if c.startswith(("target_", "alternate_"))] if "target_path" in candidate.columns else []
    use = [*columns, *targets]
    key = [columns[0], columns[1]]
    out = f"{columns[0]} string, {columns[1]} int, status string, tolerant boolean, c_id long, o_id long"

    def solve(left: list, right: list) -> list[tuple]:
        span = lambda f, p: tuple(f[f"{p}{x}"] for x in SPAN)

        def agree(a, b, how: str) -> bool:
            if a["kind"] is not None and b["kind"] is not None and a["kind"] != b["kind"]:
                return False
            if not _spans_agree(span(a, prefix), span(b, prefix), how):
                return False
            if not targets:
                return True
            if a["target_path"] != b["target_path"]:
                return False
            sides = [[s for p in ("target_", "alternate_") if pd.notna((s := span(f, p))[0])] for f in (a, b)]
            return any(_spans_agree(x, y, how) for x in sides[0] for y in sides[1])

        near = {how: [[j for j, o in enumerate(right) if agree(c, o, how)] for c in left] for how in dict.fromkeys(("exact", policy))}
        found = maximum_matching(near["exact"], len(right))
        if policy != "exact":
            # From the exact pairs on, over all facts: a pair may be given up if both of its facts find another.
            wider = [list(dict.fromkeys([*near["exact"][i], *near[policy][i]])) for i in range(len(left))]
            found = maximum_matching(wider, len(right), found)
        partner = {i: j for i, j in enumerate(found) if j >= 0}
        tolerant = {i for i, j in partner.items() if j not in near["exact"][i]}
        rows = []
        for i, f in enumerate(left):
            rows.append((f[key[0]], f[key[1]], "tp" if i in partner else "fp", i in tolerant, f["_id"], right[partner[i]]["_id"] if i in partner else None))
        used = set(partner.values())
        rows += [(f[key[0]], f[key[1]], "fn", False, None, f["_id"]) for j, f in enumerate(right) if j not in used]
        return rows

    # Exact pairs agree on the whole span and the file that is meant, so that these keep apart what cannot meet; nulls in a struct are alike.
    rest = [*columns[2:5], *(["target_path"] if targets else [])] if policy == "exact" else []
    place = [*key, *(["_rest"] if rest else [])]

    def numbered(df: DataFrame) -> DataFrame:
        with_id = df if "_id" in df.columns else df.withColumn("_id", F.xxhash64(*use))
        return with_id.select(*use, "_id", *([F.struct(*rest).alias("_rest")] if rest else []))

    def side(df: DataFrame, name: str) -> DataFrame:
        return numbered(df).groupBy(*place).agg(F.array_sort(F.collect_list(F.struct(*use, "_id"))).alias(name))

    both = side(candidate, "c").join(apart(side(oracle, "o")), place, "full").select("c", "o")
    count = lambda name: F.when(F.col(name).isNull(), 0).otherwise(F.size(name))
    # Most facts meet nothing or one fact: only where there is a choice is it left to Python, which is given nulls of the others.
    pair = (count("c") == 1) & (count("o") == 1)
    plain = (count("c") == 0) | (count("o") == 0) | (pair & _known("c", prefix, targets, policy) & _known("o", prefix, targets, policy))
    fields = [x.split() for x in out.split(", ")]

    def row(f: Column, status: str, tolerant: Column, c_id: Column, o_id: Column) -> Column:
        return F.struct(*[x.cast(t).alias(n) for x, (n, t) in zip((f[key[0]], f[key[1]], F.lit(status), tolerant, c_id, o_id), fields)])

    no, none = F.lit(False), F.lit(None)
    c, o = F.get("c", F.lit(0)), F.get("o", F.lit(0))
    exact, agree = (_facts_agree(c, o, prefix, bool(targets), how) for how in ("exact", policy))
    every = lambda name: F.coalesce(F.col(name), F.array().cast(both.schema[name].dataType))
    alone = F.concat(F.transform(every("c"), lambda f: row(f, "fp", no, f["_id"], none)), F.transform(every("o"), lambda f: row(f, "fn", no, none, f["_id"])))
    told = F.when(pair & (exact | agree), F.array(row(c, "tp", ~exact, c["_id"], o["_id"]))).otherwise(alone)
    choose = F.udf(lambda c, o: solve(c, o) if c is not None else None, f"array<struct<{', '.join(f'{n}: {t}' for n, t in fields)}>>", useArrow=True)  # a choice has facts on both sides
    chosen = choose(F.when(~plain, F.col("c")), F.when(~plain, F.col("o")))
    return both.select(F.explode(F.coalesce(chosen, F.when(plain, told))).alias("x")).select("x.*")


def by_path(matched: DataFrame, path: str = "path") -> DataFrame:
    """tp, fp, fn per file."""
    n = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0)).alias(s)
    return matched.groupBy(F.col(path).alias("path")).agg(n("tp"), n("fp"), n("fn"))


def shape_coverage(candidates: DataFrame, seen: DataFrame, keys: list[str], least: int = 30, share: float = 0.01) -> DataFrame:
    """By shape, candidates and how many of them the oracle has anything at; blind: many, and hardly any seen."""
    marked = candidates.join(seen.select(*keys).distinct().withColumn("_seen", F.lit(1)), keys, "left")
    out = marked.groupBy("shape").agg(F.count("*").alias("candidates"), F.sum(F.coalesce("_seen", F.lit(0))).cast("long").alias("seen"))
    return out.withColumn("blind", (F.col("candidates") >= least) & (F.col("seen") < F.col("candidates") * share))


def slack_matches(answers: DataFrame, sites: DataFrame, slack: int = 1) -> DataFrame:
    """(task, tp, fp, fn): answers(task, path, line) against sites, one to one; exact lines first, then within the slack."""
    mine = answers.select("task", "path", "line").distinct().groupBy("task", "path").agg(F.array_sort(F.collect_list("line")).alias("mine"))
    theirs = sites.select("task", "path", "line").distinct().groupBy("task", "path").agg(F.array_sort(F.collect_list("line")).alias("theirs"))

    def solve(frames):
        for f in frames:
            rows = []
            for task, mine, theirs in zip(f["task"], f["mine"], f["theirs"]):
                mine, theirs = list(mine if mine is not None else []), list(theirs if theirs is not None else [])
                left, right, hits = set(mine), set(theirs), 0
                for distance in range(slack + 1):
                    for a in sorted(left):
                        b = next((x for x in dict.fromkeys((a - distance, a + distance)) if x in right), None)
                        if b is not None:
                            left.discard(a)
                            right.discard(b)
                            hits += 1
                rows.append((task, hits, len(left), len(right)))
            yield pd.DataFrame(rows, columns=["task", "tp", "fp", "fn"])

    kind = answers.schema["task"].dataType.simpleString()
    both = mine.join(theirs, ["task", "path"], "full")
    pairs = both.select("task", "mine", "theirs").mapInPandas(solve, f"task {kind}, tp long, fp long, fn long")
    return pairs.groupBy("task").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])


def credit(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, line) -> the innermost symbol there; of equal spans the first."""
    from .lookup import symbols_at

    return symbols_at(symbols, points)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two readings has, with the side."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def calibration_pairs(matched: DataFrame, facts: DataFrame) -> DataFrame:
    """(confidence, correct) of each reference fact: one that is right anywhere is right."""
    use = ["site_path", *[f"site_{x}" for x in SPAN], "kind", "target_path", *[f"target_{x}" for x in SPAN], *[f"alternate_{x}" for x in SPAN]]
    keyed = facts.select(F.xxhash64(*use).alias("c_id"), "confidence")
    told = matched.filter(F.col("c_id").isNotNull()).groupBy("c_id").agg(F.max((F.col("status") == "tp").cast("int")).alias("ok"))
    return keyed.join(told, "c_id").groupBy("c_id").agg(F.max("confidence").alias("confidence"), F.max("ok").alias("ok")).select("confidence", (F.col("ok") == 1).alias("correct"))

