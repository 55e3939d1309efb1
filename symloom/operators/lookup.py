"""Reads over the stored relations: filters, counts, search, addressing, references, outlines.

Every order is total, so that the same index gives the same answer.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import in_scope
from ..session import apart

#: Substring search looks at qualified names only from this length of the query on.
LONG_QUERY = 3


def navigable(symbols: DataFrame) -> DataFrame:
    return symbols.filter(~F.col("is_synthetic") & ~F.col("is_local"))


def of_kinds(df: DataFrame, kinds: Iterable[str] = (), known: Iterable[str] = ()) -> DataFrame:
    """Rows of the kinds (all without any); a kind that isn't known is an error that names the valid ones."""
    kinds = list(kinds)
    wrong = [k for k in kinds if known and k not in set(known)]
    if wrong:
        raise ValueError(f"unknown kind {', '.join(wrong)}; valid: {', '.join(known)}")
    return df.filter(F.col("kind").isin(kinds)) if kinds else df


def confident(edges: DataFrame, least: float = 0.0) -> DataFrame:
    """Edges that say something about use: no containment, at least so sure."""
    return edges.filter((F.col("kind") != "contains") & (F.col("confidence") >= least))


def uses(edges: DataFrame) -> DataFrame:
    """Edges that are evidenced at a place in a text and aren't structural."""
    return edges.filter((F.col("kind") != "contains") & F.col("site_path").isNotNull())


def most_referenced(symbols: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """Symbols with the most distinct sources, containment included."""
    real = symbols.filter(~F.col("is_synthetic")).select(F.col("id").alias("dst_id"))
    counted = edges.select("src_id", "dst_id").join(real, "dst_id").groupBy("dst_id").agg(F.countDistinct("src_id").alias("n"))
    return counted.orderBy(F.desc("n"), "dst_id").limit(limit).select(F.col("dst_id").alias("id"), "n")


def reference_counts(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Distinct sources by target, without containment; ids: only of these (column id)."""
    own = edges.filter(F.col("kind") != "contains").select("src_id", F.col("dst_id").alias("id"))
    own = own.join(ids.select("id").distinct(), "id", "left_semi") if ids is not None else own
    return own.groupBy("id").agg(F.countDistinct("src_id").alias("n"))


def callers(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct sources that are no stand-ins for files, by target, without containment."""
    real = symbols.filter(~F.col("is_synthetic")).select(F.col("id").alias("src_id"))
    own = edges.filter(F.col("kind") != "contains").select("src_id", "dst_id").join(real, "src_id")
    return own.groupBy(F.col("dst_id").alias("id")).agg(F.countDistinct("src_id").alias("n"))


def caller_sample(symbols: DataFrame, edges: DataFrame, target: str, limit: int = 5) -> DataFrame:
    real = symbols.filter(~F.col("is_synthetic")).select(F.col("id").alias("src_id"), "name", "path", "name_start_line")
    own = edges.filter((F.col("kind") != "contains") & (F.col("dst_id") == target)).select("src_id").distinct()
    return own.join(real, "src_id").orderBy("path", "name_start_line", "src_id").limit(limit)


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("kind") != "contains").groupBy(F.col("src_id").alias("id")).agg(F.count("*").alias("n"))


def namesakes(symbols: DataFrame) -> DataFrame:
    """How many other navigable symbols have a symbol's name."""
    return navigable(symbols).groupBy("name").agg(F.greatest(F.count("*") - 1, F.lit(0).cast("long")).alias("namesakes"))


def collision_rate(symbols: DataFrame) -> DataFrame:
    return navigable(symbols).groupBy("name").agg(F.count("*").alias("n"))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("relation"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def edges_by_kind(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(F.count("*").alias("n"))


def definitions_by_name(symbols: DataFrame) -> DataFrame:
    """By name, the sorted set of what resolution sees of its definitions: a change of it is a change of the name."""
    real = symbols.filter(~F.col("is_synthetic"))
    row = F.concat_ws("\x1f", "id", "kind", "path", F.coalesce("container_id", F.lit("")), F.coalesce("signature", F.lit("")), F.col("is_local").cast("string"))
    return real.groupBy("name").agg(F.array_sort(F.collect_set(row)).alias("definitions"))


def _hits(symbols: DataFrame, query: str, kinds: Iterable[str], index: DataFrame | None = None) -> DataFrame:
    low = query.lower()
    if index is not None and len(query) >= LONG_QUERY:
        symbols = symbols.join(trigram_hits(index, query), "id", "left_semi")
    found = F.lower("name").contains(low)
    if len(query) >= LONG_QUERY:
        found = found | F.coalesce(F.lower("qualified_name").contains(low), F.lit(False))
    return of_kinds(navigable(symbols).filter(found), kinds)


def search_count(symbols: DataFrame, query: str, kinds: Iterable[str] = ()) -> DataFrame:
    return _hits(symbols, query, kinds).agg(F.count("*").alias("n"))


def search(symbols: DataFrame, ranks: DataFrame, query: str, kinds: Iterable[str] = (), limit: int = 20, offset: int = 0, index: DataFrame | None = None) -> DataFrame:
    """Symbols with the query in their name (or, from three letters on, qualified name).

    Exact names first, then names that contain it, by rank, names that begin with it, shorter names.
    index: a trigram index of the symbols, which spares the scan of their texts.
    """
    low, name = query.lower(), F.lower("name")
    order = [F.desc(name == low), F.desc(name.contains(low)), F.desc("score"), F.desc(F.startswith(name, F.lit(low))), F.length("name"), "path", "name_start_line", "id"]
    scored = _hits(symbols, query, kinds, index).join(ranks.select(F.col("symbol_id").alias("id"), "score"), "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return scored.orderBy(*order).offset(offset).limit(limit)


def symbols_named(symbols: DataFrame, ranks: DataFrame, name: str, scope: str | None = None, limit: int = 50) -> DataFrame:
    own = navigable(symbols).filter(F.col("name") == name)
    own = own.filter(in_scope(F.col("path"), scope)) if scope else own
    scored = own.join(ranks.select(F.col("symbol_id").alias("id"), "score"), "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return scored.orderBy(F.desc("score"), "path", "name_start_line", "id").limit(limit)


def nth_named(symbols: DataFrame, ranks: DataFrame, name: str, n: int) -> DataFrame:
    """The n-th (from 1) of the symbols of a name, in their order."""
    return symbols_named(symbols, ranks, name).offset(n - 1).limit(1)


def symbols_at(symbols: DataFrame, points: DataFrame) -> DataFrame:
    """points(path, line) -> the symbol there: one declared on the line first, else the innermost that spans it.

    Spans are not paired with the points inside them: a span is cut into the few aligned blocks (of 1,
    2, 4, ... lines) that make it up, each block keeps the shortest span that covers it whole, and a
    point looks up the blocks around it, one of each size. Both sides grow with the spans and the points
    alone, however many spans lie over one line.
    """
    real = symbols.filter(~F.col("is_synthetic"))
    first, last = F.coalesce("full_start_line", "name_start_line"), F.coalesce("full_end_line", "name_end_line")
    spanned = real.select("path", F.col("name_start_line").alias("at"), first.alias("first"), last.alias("last"), "id").filter("first <= last")
    # Of equal spans the first counts alone.
    spanned = spanned.groupBy("path", "at", "first", "last").agg(F.min("id").alias("id"))
    best = F.min(F.struct((F.col("last") - F.col("first")).alias("length"), "id")).alias("best")
    declared = spanned.filter(F.col("at").between(F.col("first"), F.col("last"))).groupBy("path", F.col("at").alias("line")).agg(best)
    blocks = spanned.select("path", "first", "last", "id", F.explode(_blocks(F.col("first"), F.col("last"))).alias("x")).select("path", "x.*", "first", "last", "id")
    covered = blocks.groupBy("path", "size", "block").agg(best)
    asked = points.select("path", "line").distinct().filter("line is not null")
    sizes = F.sequence(F.lit(0), F.lit(MOST_DOUBLINGS))
    around = asked.select("path", "line", F.explode(sizes).alias("size")).withColumn("block", F.expr("shiftright(line, size)"))
    inner = around.join(covered, ["path", "size", "block"]).groupBy("path", "line").agg(F.min("best").alias("inner"))
    found = asked.join(declared, ["path", "line"], "left").join(inner, ["path", "line"], "left")
    return found.select("path", "line", F.coalesce(F.col("best"), F.col("inner"))["id"].alias("id")).filter("id is not null")


#: Lines are 32-bit numbers, so that blocks double so often at most.
MOST_DOUBLINGS = 31


def _blocks(first: Column, last: Column) -> Column:
    """The aligned blocks (size: the power of two of their lines, block: their number) that a span is made of, two of a size at most."""
    sizes = F.sequence(F.lit(0), F.floor(F.log2((last.cast("long") - first + 1).cast("double"))).cast("int"))

    def of_size(k: Column) -> Column:
        # The blocks of the size in the span: from low up to high, which is the first one outside.
        low, high = (F.negate(F.call_function("shiftright", F.negate(first.cast("long")), k)), F.call_function("shiftright", last.cast("long") + 1, k))
        block = lambda n: F.struct(k.alias("size"), n.cast("int").alias("block"))
        # Those at the ends that are no half of a block inside the span.
        return F.array(F.when((low < high) & (low % 2 != 0), block(low)), F.when((low < high) & (high % 2 != 0), block(high - 1)))

    return F.array_compact(F.flatten(F.transform(sizes, of_size)))


def innermost(scopes: DataFrame, points: DataFrame, keys: tuple[str, ...] = ("path",), width: int = 64, exclude: str | None = None) -> DataFrame:
    """Tightest scope (keys, id, lo, hi) around each point (keys, point, at): lo <= at < hi; latest start, earliest end, id.

    Scopes and points meet by key and block of `width`. exclude: a column of points with the id of a
    scope that does not count (a span that is the point itself).
    """
    held = scopes.filter("lo < hi").withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    near = points.withColumn("_b", F.floor(F.col("at") / width)).join(held, [*keys, "_b"]).filter((F.col("lo") <= F.col("at")) & (F.col("at") < F.col("hi")))
    near = near.filter(~F.col("id").eqNullSafe(F.col(exclude))) if exclude else near
    return near.groupBy("point").agg(F.min_by("id", F.struct((-F.col("lo")).alias("a"), "hi", "id")).alias("id"))


def reach(spans: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """spans(keys, lo, hi) with the furthest end up to each, in order of starts: where it is passed, nothing covers."""
    order = W.partitionBy(*keys).orderBy("lo", F.desc("hi")).rowsBetween(W.unboundedPreceding, 0)
    return spans.withColumn("reach", F.max("hi").over(order))


def references(edges: DataFrame, target: str, least: float = 0.0, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the uses of a symbol by place; edges without a site come first."""
    own = confident(edges, least).filter(F.col("dst_id") == target)
    place = [F.coalesce("site_path", F.lit("")), F.coalesce("site_start_line", F.lit(0)), F.coalesce("site_start_char", F.lit(0)), "src_id", "kind", "confidence"]
    return own.orderBy(*place).offset(offset).limit(limit)


def file_outline(symbols: DataFrame, path: str) -> DataFrame:
    """Navigable symbols of a file in the order of the text, with the number of shown symbols around each."""
    from .graph import closure

    own = navigable(symbols).filter(F.col("path") == path)
    shown = own.select(F.col("id").alias("parent"))
    up = own.select(F.col("id").alias("child"), F.col("container_id").alias("parent")).join(shown, "parent", "left_semi").select("child", "parent")
    depths = closure(up).groupBy(F.col("child").alias("id")).agg(F.count("*").cast("int").alias("depth"))
    out = own.join(depths, "id", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    return out.orderBy("name_start_line", "name_start_char", "id").select("id", "name", "kind", "name_start_line", "depth", F.coalesce("signature", F.concat_ws(" ", "kind", "name")).alias("signature"))


#: What separates the segments of a name path.
SEPARATORS = r"::|[./\\]"


def name_chain(name: Column, qualified: Column) -> Column:
    """The containers that a qualified name tells, outermost first, and the name, which may hold separators itself."""
    whole = F.coalesce(qualified, name)
    before = F.substr(whole, F.lit(1), F.greatest(F.length(whole) - F.length(name) - 1, F.lit(0)))
    inside = F.endswith(whole, F.concat(F.lit("."), name))
    parts = lambda c: F.filter(F.split(c, SEPARATORS), lambda p: p != "")
    split = parts(whole)
    return F.when(whole == name, F.array(name)).when(inside, F.concat(parts(before), F.array(name))).when(F.size(split) > 0, split).otherwise(F.array(name))


def name_path_of(name: Column, qualified: Column) -> Column:
    """Ad/save: how answers spell a symbol, and what they take back."""
    return F.array_join(name_chain(name, qualified), "/")


def container_paths(symbols: DataFrame) -> DataFrame:
    """id -> names from the outermost container down by the containers themselves, joined by slashes."""
    from .graph import container_chain, named_chains

    chains = named_chains(symbols)
    if chains is None:
        named = symbols.select(F.col("id").alias("ancestor"), "name")
        parts = container_chain(symbols).join(apart(named), "ancestor").groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("depth"), F.col("name")))).alias("chain"))
        chains = parts.select("id", "chain")
    return chains.select("id", F.array_join(F.transform(F.reverse("chain"), lambda x: x["name"]), "/").alias("name_path"))


name_paths = container_paths


def trigrams(text: Column) -> Column:
    """The distinct three-character pieces of a text, lower-cased."""
    low = F.lower(text)
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substr(low, i, F.lit(3)))
    return F.when(F.length(low) >= 3, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def trigram_index(symbols: DataFrame) -> DataFrame:
    """(gram, id): an inverted index over the names and qualified names of navigable symbols."""
    both = F.array_union(trigrams(F.col("name")), trigrams(F.coalesce("qualified_name", F.lit(""))))
    return navigable(symbols).select(F.explode(both).alias("gram"), "id")


def trigram_hits(index: DataFrame, query: str) -> DataFrame:
    """ids that have every trigram of a query of three characters or more; a superset of those that hold it."""
    low = query.lower()
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    return index.filter(F.col("gram").isin(grams)).groupBy("id").agg(F.count("*").alias("_n")).filter(F.col("_n") == len(grams)).select("id")


def described(symbols: DataFrame, path: Column | None = None) -> DataFrame:
    """id -> one line: kind, name path or name, place."""
    at = path if path is not None else F.coalesce("qualified_name", "name")
    return symbols.select("id", F.format_string("%s %s  %s:%d", "kind", at, "path", F.col("name_start_line") + 1).alias("line"))
