"""Secret scans: a trigram inverted index chooses the texts in which each rule's regex is verified.

For every rule a Boolean query over trigrams is derived from its parsed regex: trigrams that any
match must contain are intersected, alternatives are united. One pass over the texts makes postings
of the trigrams that some rule needs (trigram -> keys of rows), dealt into shards by a hash of the
key, so that a posting list is bounded by its shard. Shard by shard the queries intersect and unite
posting lists; the keys that are left, with the rules they are left for, are joined to the texts,
and only there the rule's regex runs. A rule without mandatory trigrams scans every text. All of it
is built from DataFrame functions; Python only derives the queries.

A row's key is a hash of its id and text: rows that share one share their candidates, which can only
add to what is verified. Trigrams are of the text with A-Z lower-cased, which can only add as well.

Defined cases: a null or empty text has no spans; matches of one kind do not overlap and are taken
leftmost first; matches that fail their rule's length are dropped after they have been taken; kinds
are matched apart, so spans of two kinds may overlap, ties go by kind as listed; repeated rows are
scanned each; an empty table gives an empty result; extra columns are ignored by `find_secrets` and
kept by `redact`, whatever their names are; a text is one value however long it is: its pieces and
matches are held at once, some three times its size.
"""

from __future__ import annotations

import functools
import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # means the same to Java, Python and RE2
    group: int = 0  # the group whose length counts
    least: int = 0  # code points that it must have


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # A run that is long enough is the run itself, so the length can stand in the regex.
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    # Through the END line; without one, over its headers and the base64 lines (and at most one word) that follow.
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[^-]*(?:-{1,4}[^-]+){0,40}-----END [A-Z ]{0,20}PRIVATE KEY-----|(?:[\r\n]+(?:Proc-Type|DEK-Info):[^\r\n]*){0,4}[A-Za-z0-9+/=\r\n\\]*)"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("url_password", r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._~%-]*:[A-Za-z0-9._~%!$&*+,;=-]{3,}@"),
)
RULES = BASE + MORE

#: A trigram query: a set of alternatives, each a set of trigrams that must all occur; None: anything.
Query = frozenset[frozenset[str]] | None
_MOST_STRINGS = 64


def trigram_query(pattern: str) -> Query:
    """What the trigrams of any text with a match must satisfy."""
    exact, query = _walk(parser.parse(pattern))
    return _both(query, _of_strings(exact)) if exact is not None else query


def _of_strings(strings: frozenset[str]) -> Query:
    return _absorb(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _absorb(found: frozenset[frozenset[str]]) -> Query:
    if frozenset() in found or len(found) > _MOST_STRINGS:
        return None
    return frozenset(a for a in found if not any(b < a for b in found))


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return _absorb(frozenset(x | y for x in a for y in b)) or a


def _walk(items) -> tuple[frozenset[str] | None, Query]:
    """(all strings that it matches if they are few, else None; the query that they leave behind)."""
    run: frozenset[str] = frozenset([""])
    query: Query = None
    whole = True
    for op, arg in items:
        exact, own = _one(op, arg)
        query = _both(query, own)
        crossed = frozenset(a + b for a in run for b in exact) if exact is not None and len(run) * len(exact) <= _MOST_STRINGS else None
        if crossed is None:
            query = _both(query, _of_strings(run))
            run = frozenset([""])
            whole = False
            if exact is not None:
                run = exact
        else:
            run = crossed
    if whole:
        return run, query
    return None, _both(query, _of_strings(run))


def _one(op, arg) -> tuple[frozenset[str] | None, Query]:
    if op is sre.LITERAL:
        return frozenset([_fold(chr(arg))]), None
    if op is sre.SUBPATTERN:
        return _walk(arg[3])
    if op is sre.BRANCH:
        parts = [_walk(x) for x in arg[1]]
        if all(e is not None and q is None for e, q in parts):
            union = frozenset().union(*(e for e, _ in parts))
            return (union, None) if len(union) <= _MOST_STRINGS else (None, None)
        queries = [_both(q, _of_strings(e)) if e is not None else q for e, q in parts]
        return None, None if None in queries else _absorb(frozenset().union(*queries))
    if op is sre.IN:
        chars = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                chars.add(_fold(chr(x)))
            elif kind is sre.RANGE and x[1] - x[0] < 8:
                chars |= {_fold(chr(c)) for c in range(x[0], x[1] + 1)}
            else:
                return None, None
        return (frozenset(chars), None) if len(chars) <= 8 else (None, None)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, item = arg
        exact, own = _walk(item)
        if (low, high) == (0, 1) and exact is not None:
            return exact | {""}, None
        if low == high == 1:
            return exact, own
        if low == high and exact is not None and len(exact) == 1:
            return frozenset(s * low for s in exact), own
        return None, own if low else None
    return None, None


def _fold(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def folded(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Trigrams of an alternative that are indexed; letters that are common in texts of many languages.
INDEXED, _COMMON = 2, "etaoinsr hld"


def index_query(pattern: str) -> Query:
    """The trigram query with the INDEXED rarest trigrams of each alternative: fewer only let more candidates through."""
    query = trigram_query(pattern)
    rare = lambda g: (sum(c in _COMMON for c in g), g)
    return None if query is None else frozenset(frozenset(sorted(need, key=rare)[:INDEXED]) for need in query)


def needed_grams(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({g for r in rules for need in index_query(r.pattern) or () for g in need})


def posting_lists(docs: DataFrame, rules: tuple[Rule, ...] = RULES, shards: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(gram, shard, doc_ids): where each trigram that some rule needs occurs, a list per shard of keys."""
    low = folded(F.coalesce(F.col(text), F.lit("")))
    has = F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), F.lit(g)) for g in needed_grams(rules)])
    held = docs.select(F.col(key).alias("doc_id"), low.alias("low")).select("doc_id", F.explode(F.filter(has, lambda g: g.isNotNull())).alias("gram"))
    return held.groupBy("gram", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard")).agg(F.collect_set("doc_id").alias("doc_ids"))


def candidates(index: DataFrame, *rules: Rule) -> DataFrame:
    """(doc_id, mask): keys that the index cannot rule out; bit k of the mask is set for the k-th rule.

    Unions of intersections of posting lists, shard by shard.
    """
    queries = [index_query(r.pattern) for r in rules]
    if None in queries:
        raise ValueError(f"{rules[queries.index(None)].kind} has no mandatory trigram: scan all documents")
    kind = index.schema["doc_ids"].dataType
    lists = index.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("gram", "doc_ids"))).alias("lists"))

    def met(query: frozenset[frozenset[str]]) -> Column:
        postings = lambda g: F.coalesce(F.try_element_at("lists", F.lit(g)), F.array().cast(kind))
        every = [functools.reduce(F.array_intersect, map(postings, sorted(need))) for need in sorted(query, key=sorted)]
        return functools.reduce(F.array_union, every)

    left = F.array(*[F.struct(F.lit(1 << k).cast("long").alias("bit"), met(q).alias("doc_ids")) for k, q in enumerate(queries)])
    each = lists.select(F.explode(left).alias("x")).select("x.bit", F.explode("x.doc_ids").alias("doc_id"))
    return each.groupBy("doc_id").agg(F.bit_or("bit").alias("mask"))


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start,end>>: the rule's matches in code points, in order.

    What lies between the matches is split off by the same regex, so that the lengths of pieces and
    matches add up to the positions.
    """
    regex = F.lit(rule.pattern)
    parts = [F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"), F.transform(F.regexp_extract_all(text, regex, F.lit(0)), F.length).alias("size")]
    if rule.group:
        parts.append(F.transform(F.regexp_extract_all(text, regex, F.lit(rule.group)), F.length).alias("own"))
    empty = F.array().cast("array<struct<start:long,end:long>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(x["size"], F.lit(0))
        good = x["size"].isNotNull() & (x["own"] >= rule.least if rule.group else x["size"] >= rule.least)
        added = F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"))))
        return F.struct(end.alias("at"), F.when(good, added).otherwise(acc["spans"]).alias("spans"))

    found = F.aggregate(F.arrays_zip(*parts), start, step, lambda acc: acc["spans"])
    return F.when(F.regexp_like(text, regex), found).otherwise(empty)


def with_spans(held: DataFrame, rules: tuple[Rule, ...] = RULES, per_shard: int = 4096) -> DataFrame:
    """held (columns id, body and at most row) with a column of spans for each rule."""
    indexed = tuple(r for r in rules if trigram_query(r.pattern) is not None)
    keyed = held.withColumn("key", F.xxhash64("id", "body"))
    shards = max(1, held.select("id").count() // per_shard)
    index = posting_lists(keyed, indexed, shards, "key", "body")
    # A table, so that the join can split a key that many rows share.
    found = cut(candidates(index, *indexed).withColumnRenamed("doc_id", "key"), "candidates")
    keyed = keyed.join(found, "key", "left")
    empty = F.array().cast("array<struct<start:long,end:long>>")
    may = {r.kind: F.coalesce(F.col("mask").bitwiseAND(F.lit(1 << k)) != 0, F.lit(False)) for k, r in enumerate(indexed)}
    spans = {f"_span_{r.kind}": F.when(may.get(r.kind, F.lit(True)), spans_of(F.col("body"), r)).otherwise(empty) for r in rules}
    return keyed.withColumns(spans).drop("key", "mask")


def listed(rules: tuple[Rule, ...], prefix: str = "_span_") -> Column:
    """All spans of the rules by start, then kind as listed: array<struct<start,rank,kind,end>>."""

    def ranked(rank: int, kind: str) -> Column:
        return F.transform(f"{prefix}{kind}", lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    every = [ranked(i, r.kind) for i, r in enumerate(rules)]
    return F.sort_array(F.concat(*every))


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans (of all rules, sorted) and one array of spans per kind, of every row."""
    found = with_spans(docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("body")), rules)
    return found.select(F.col("id").alias("doc_id"), listed(rules).alias("spans"), *[F.col(f"_span_{r.kind}").alias(r.kind) for r in rules])


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[REDACTED]") -> DataFrame:
    """docs with every span of every rule replaced by the mark; overlapping spans by one mark.

    A column n_chars is counted anew where a text has changed.
    """
    held = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("body"))
    found = with_spans(held, rules).select("row", "body", listed(rules).alias("spans"))
    text = F.col("body")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.when(x["start"] >= acc["at"], F.concat(F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    clean = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    hit = F.size("spans") > 0
    redone = found.select("row", hit.alias("hit"), F.when(hit, clean).alias("clean"))
    fresh = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.length("clean").cast(docs.schema["n_chars"].dataType)
    own = lambda c: F.col("row").getField(c)
    return redone.select(*[(F.when(F.col("hit"), fresh[c]).otherwise(own(c)) if c in fresh else own(c)).alias(c) for c in docs.columns])
