"""Graph operators: weights, ranking, walks and closures, as joins and aggregations over edge tables."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import is_private, mention_keys
from ..schema import EDGE_KINDS, EDGE_WEIGHTS, INHERITANCE, KIND_PRIORS, OTHER_WEIGHT, TIERS, TYPE_LIKE
from ..session import apart, cut
from .lookup import navigable, of_kinds


def _choice(column: str, values: dict[str, float], other: float | None) -> Column:
    table = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])
    found = F.element_at(table, F.col(column))
    return found if other is None else F.coalesce(found, F.lit(other))


def graph_weights(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, w): the root of the summed kind weight times confidence; containment points to the container."""
    nodes = navigable(symbols).select("id")
    turned = F.col("kind") == "contains"
    own = edges.select(
        F.when(turned, F.col("dst_id")).otherwise(F.col("src_id")).alias("src"),
        F.when(turned, F.col("src_id")).otherwise(F.col("dst_id")).alias("dst"),
        (_choice("kind", EDGE_WEIGHTS, OTHER_WEIGHT) * F.col("confidence")).alias("w"),
    ).filter(F.col("src") != F.col("dst"))
    # Summing first leaves the joins with one row of each pair.
    pairs = own.groupBy("src", "dst").agg(F.sqrt(F.sum("w")).alias("w"))
    return pairs.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "w")


def in_degree(weights: DataFrame) -> DataFrame:
    return weights.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("in_degree"))


def personalisation(symbols: DataFrame, focus: Iterable[str] = (), boost: float = 50.0, private: float = 0.25, priors: bool = True) -> DataFrame:
    """(id, r): where walks start anew: by kind, more for the focus, less for private symbols; sums to 1."""
    weight = _choice("kind", KIND_PRIORS, KIND_PRIORS["unknown"]) if priors else F.lit(1.0)
    weight = weight * F.when(is_private(F.col("name"), F.col("signature")), F.lit(private)).otherwise(F.lit(1.0))
    focus = list(focus)
    weight = weight * F.when(F.col("id").isin(focus) | F.col("path").isin(focus), F.lit(boost)).otherwise(F.lit(1.0)) if focus else weight
    raw = navigable(symbols).select("id", weight.alias("r"))
    total = raw.agg(F.sum("r").alias("total"), F.count("*").alias("n"))
    even = F.when(F.col("total") > 0, F.col("r") / F.col("total")).otherwise(1.0 / F.col("n"))
    return raw.crossJoin(F.broadcast(total)).select("id", even.alias("r"))  # one row of totals


#: Graphs of at most so many nodes and edges are walked in arrays on the driver; larger ones in blocks on the executors, with the same result.
MOST_LOCAL = 4_000_000


def pagerank(symbols: DataFrame, weights: DataFrame, focus: Iterable[str] = (), damping: float = 0.85, iterations: int | None = None, tolerance: float = 1e-6, most: int = 100, most_local: int = MOST_LOCAL) -> DataFrame:
    """(id, score): the personalised walk; a given number of steps, or until the change is below the tolerance."""
    start = cut(personalisation(symbols, focus))
    steps, tolerance = (iterations, -1.0) if iterations is not None else (most, tolerance)
    weights = cut(weights)
    if start.count() + weights.count() <= most_local:
        return _walk_in_arrays(start, weights, damping, steps, tolerance)
    return _walk_in_blocks(start, weights, damping, steps, tolerance)


def _walk_in_arrays(start: DataFrame, weights: DataFrame, damping: float, steps: int, tolerance: float) -> DataFrame:
    nodes, edges = start.orderBy("id").toArrow(), weights.orderBy("src", "dst").toArrow()
    ids = nodes["id"].combine_chunks()
    r = nodes["r"].to_numpy()
    src, dst = (pc.index_in(edges[c].combine_chunks(), ids).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("src", "dst"))
    w = edges["w"].to_numpy()
    total = np.bincount(src, w, len(r))
    p = w / total[src]
    ends = total == 0
    x = r.copy()
    for _ in range(steps):
        before, x = x, (1 - damping + damping * x[ends].sum()) * r + damping * np.bincount(dst, x[src] * p, len(r))
        if np.abs(x - before).sum() < tolerance:
            break
    return start.sparkSession.createDataFrame(pa.table({"id": ids, "score": x}))


#: Nodes in a block (as many as a step holds at a time), and edges in a packed row.
BLOCK_NODES, CHUNK_EDGES = 100_000, 500_000


def _walk_in_blocks(start: DataFrame, weights: DataFrame, damping: float, steps: int, tolerance: float) -> DataFrame:
    """Nodes are numbered in the order of their ids, in blocks; a row holds the vectors of a block, or some edges out of one.

    A step joins a block's row with the rows of its edges, sums what these give to each node, and adds
    it up by block: only packed numbers move, and near ids, which edges often join, share what they send.
    """
    total = weights.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("total"))
    nodes = start.join(apart(total), "id", "left").select("id", "r", F.coalesce("total", F.lit(0.0)).alias("total"))
    spread = cut(nodes).repartitionByRange(-(-start.count() // BLOCK_NODES) or 1, "id").sortWithinPartitions("id")
    # The number tells the partition in its upper bits, and the place in it in its lower 33.
    numbered = cut(spread.withColumn("n", F.monotonically_increasing_id())).select("id", "r", "total", F.shiftright("n", 33).cast("int").alias("b"), F.col("n").bitwiseAND((1 << 33) - 1).cast("int").alias("pos"))
    at = lambda end: numbered.select(F.col("id").alias(end), F.col("b").alias(f"{end}_b"), F.col("pos").alias(f"{end}_pos"))
    placed = weights.join(apart(at("src")), "src").join(apart(at("dst")), "dst").select("src_b", "src_pos", "dst_b", "dst_pos", "w")
    moves = cut(placed.repartition("src_b").sortWithinPartitions("src_b", "dst_b", "dst_pos", "src_pos").mapInArrow(_pack_edges, "src_b int, src_pos binary, dst_b binary, dst_pos binary, code binary, w binary"))
    # loose: what lies on nodes that nothing leaves, and goes back to the start weights.
    now = cut(numbered.select("b", "pos", "r", "total").mapInArrow(_pack_nodes, _STATE))
    for _ in range(steps):
        loose, change = now.agg(F.sum("loose"), F.sum("change")).first()
        if loose is None or (change is not None and change < tolerance):
            break
        given = moves.join(apart(now.select(F.col("b").alias("src_b"), "share")), "src_b").mapInArrow(_give, "b int, pos binary, flow binary")
        empty, none = [F.lit(None).cast("binary").alias(c) for c in ("x", "r", "total")], [F.lit(None).cast("binary").alias(c) for c in ("pos", "flow")]
        both = given.select("b", "pos", "flow", *empty).unionByName(now.select("b", *none, "x", "r", "total"))
        now = cut(both.groupBy("b").applyInArrow(_taken(damping, 1 - damping + damping * loose), _STATE))
    scores = now.select("b", "x").mapInArrow(_unpack, "b int, pos int, score double")
    return numbered.select("id", "b", "pos").join(apart(scores), ["b", "pos"]).select("id", "score")


_STATE = "b int, x binary, r binary, total binary, share binary, loose double, change double"


def _table(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(schema)], names=[n for n, _ in schema])


def _numbers(value: pa.Scalar, kind: str) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of the runs of equal keys."""
    cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
    return list(zip(cuts[:-1], cuts[1:])) if len(keys) else []


def _gathered(batches: Iterable[pa.RecordBatch], most: int | None = None) -> Iterable[dict[str, np.ndarray]]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if most is not None and n >= most:
            yield {c: x.to_numpy() for c, x in zip(batch.schema.names, pa.Table.from_batches(held).columns)}
            held, n = [], 0
    if n:
        yield {c: x.to_numpy() for c, x in zip(held[0].schema.names, pa.Table.from_batches(held).columns)}


def _pack_edges(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    schema = [("src_b", pa.int32()), *[(c, pa.binary()) for c in ("src_pos", "dst_b", "dst_pos", "code", "w")]]
    for t in _gathered(batches, CHUNK_EDGES):
        for i, j in _runs(t["src_b"]):
            values, code = np.unique(t["w"][i:j], return_inverse=True)
            ints = [t[c][i:j].astype("<i4").tobytes() for c in ("src_pos", "dst_b", "dst_pos")]
            # Weights are told by their number among those in the row, which takes fewer bytes; which ones follows from the length.
            yield _table(schema, [(int(t["src_b"][i]), *ints, code.astype("<u2" if len(values) <= 1 << 16 else "<u4").tobytes(), values.astype("<f8").tobytes())])


def _state(b: int, x: np.ndarray, r: np.ndarray, total: np.ndarray, change: float | None) -> pa.RecordBatch:
    schema = [("b", pa.int32()), *[(c, pa.binary()) for c in ("x", "r", "total", "share")], ("loose", pa.float64()), ("change", pa.float64())]
    share = np.divide(x, total, out=np.zeros(len(x)), where=total != 0)
    return _table(schema, [(b, x.tobytes(), r.tobytes(), total.tobytes(), share.tobytes(), float(x[total == 0].sum()), change)])


def _pack_nodes(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for t in _gathered(batches):
        for i, j in _runs(t["b"]):
            r = t["r"][i:j].astype("<f8")
            yield _state(int(t["b"][i]), r, r, t["total"][i:j].astype("<f8"), None)


def _give(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for k in range(batch.num_rows):
            src, block, pos, code, w, share = (batch[c][k] for c in ("src_pos", "dst_b", "dst_pos", "code", "w", "share"))
            src, block, pos, w = _numbers(src, "<i4"), _numbers(block, "<i4"), _numbers(pos, "<i4"), _numbers(w, "<f8")
            code = _numbers(code, "<u2" if len(code.as_buffer()) == 2 * len(src) else "<u4")
            first = np.flatnonzero(np.r_[True, (np.diff(block) != 0) | (np.diff(pos) != 0)])
            flow = np.add.reduceat(_numbers(share, "<f8")[src] * w[code], first)
            rows += [(int(block[first[i]]), pos[first[i:j]].tobytes(), flow[i:j].tobytes()) for i, j in _runs(block[first])]
        yield _table([("b", pa.int32()), ("pos", pa.binary()), ("flow", pa.binary())], rows)


def _taken(damping: float, anew: float):
    def take(t: pa.Table) -> pa.Table:
        state = next(k for k in range(t.num_rows) if t["x"][k].is_valid)
        x, r, total = (_numbers(t[c][state], "<f8") for c in ("x", "r", "total"))
        flow = np.zeros(len(x))
        for pos, part in zip(t["pos"], t["flow"]):
            if pos.is_valid:
                flow[_numbers(pos, "<i4")] += _numbers(part, "<f8")
        value = anew * r + damping * flow
        return pa.Table.from_batches([_state(t["b"][state].as_py(), value, r, total, float(np.abs(value - x).sum()))])

    return take


def _unpack(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        for b, x in zip(batch["b"], batch["x"]):
            score = _numbers(x, "<f8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), b.as_py(), "<i4")), pa.array(np.arange(len(score), dtype="<i4")), pa.array(score)], names=["b", "pos", "score"])


def ranked(symbols: DataFrame, weights: DataFrame, scores: DataFrame) -> DataFrame:
    """symbol_id, score, in_degree in rank order."""
    own = navigable(symbols).select("id", "path", "name_start_line", "name_start_char")
    out = scores.join(own, "id").join(in_degree(weights), "id", "left")
    return out.orderBy(F.desc("score"), "path", "name_start_line", "name_start_char", "id").select(F.col("id").alias("symbol_id"), "score", F.coalesce("in_degree", F.lit(0)).cast("int").alias("in_degree"))


def neighbours(edges: DataFrame, start: str, direction: str = "out", depth: int = 1, kinds: Iterable[str] = (), least: float = 0.0) -> DataFrame:
    """(id, depth): breadth-first, each node once, containment included."""
    if direction not in ("out", "in", "both"):
        raise ValueError("direction is out, in or both")
    if not 1 <= depth <= 3:
        raise ValueError("depth is 1 to 3")
    own = of_kinds(edges, kinds, EDGE_KINDS).filter(F.col("confidence") >= least)
    out = own.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"))
    steps = {"out": out, "in": out.select(F.col("b").alias("a"), F.col("a").alias("b"))}
    hop = steps["out"].unionByName(steps["in"]) if direction == "both" else steps[direction]
    if depth == 1:
        return hop.filter((F.col("a") == start) & (F.col("b") != start)).select(F.col("b").alias("id"), F.lit(1).alias("depth")).distinct()
    hop = cut(hop)
    seen = edges.sparkSession.createDataFrame([(start, 0)], "id string, depth int")
    frontier = seen
    for d in range(1, depth + 1):
        reached = frontier.join(hop, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
        frontier = cut(reached.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0")


#: A bound for safety, far beyond any nesting: chains that are longer are an error.
MOST_LEVELS = 1000


def closure(parents: DataFrame, most: int = MOST_LEVELS) -> DataFrame:
    """parents(child, parent) -> (child, ancestor, depth): the least depth at which each ancestor is reached; cycles end.

    Pairs beyond `most` levels are an error. Where no child has two parents, as in containers, chains
    are doubled; else the pairs are found level by level.
    """
    parents = cut(parents.select("child", "parent").filter("child <> parent").distinct())
    if not parents.groupBy("child").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return _closure_by_levels(parents, most)
    found = _chains(parents.select(F.col("child").alias("id"), F.col("parent").alias("at"), F.array("parent").alias("chain")), most)
    around = F.array_remove("chain", F.col("id"))
    return found.select(F.col("id").alias("child"), F.posexplode(around).alias("depth", "ancestor")).select("child", "ancestor", (F.col("depth") + 1).alias("depth"))


def _closure_by_levels(parents: DataFrame, most: int) -> DataFrame:
    """Each round joins the new pairs alone with the parents and drops those that are known, until there are none."""
    frontier = parents.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    seen = frontier
    step = apart(parents.select(F.col("child").alias("_c"), F.col("parent").alias("_p")))
    for d in range(2, most + 2):
        more = frontier.join(step, F.col("ancestor") == F.col("_c")).select("child", F.col("_p").alias("ancestor")).filter("child <> ancestor").distinct()
        frontier = cut(more.join(apart(seen.select("child", "ancestor")), ["child", "ancestor"], "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError(f"chains of over {most} levels")


def _chains(nodes: DataFrame, most: int = MOST_LEVELS) -> DataFrame:
    """nodes(id, at, chain), one row of an id -> (id, chain): with what follows at `at`, and so on to the end, once each.

    Chains double in each round: what lies beyond a chain is the chain of the id where it goes on, so
    that a depth of n takes log n rounds. A chain that comes back to itself, on a cycle, is at its end.
    Chains of over `most` are an error.
    """
    now = cut(nodes)
    ended, active, length = now.filter("at is null"), now.filter("at is not null"), 1
    while not active.isEmpty():
        if length > most:
            raise RuntimeError(f"chains of over {most} levels")
        beyond = ended.unionByName(active).select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("chain").alias("_chain"))
        both = active.join(apart(beyond), "at", "left").select("id", "_at", F.concat("chain", F.coalesce("_chain", F.slice("chain", 1, 0))).alias("both")).withColumn("chain", F.array_distinct("both"))
        now = cut(both.select("id", F.when(F.size("chain") == F.size("both"), F.col("_at")).alias("at"), "chain"))
        ended, active, length = ended.unionByName(now.filter("at is null")), now.filter("at is not null"), 2 * length
    if length > most and not ended.filter(F.size("chain") > most).isEmpty():
        raise RuntimeError(f"chains of over {most} levels")
    return ended.select("id", "chain")


def _single(symbols: DataFrame, *more: Column) -> DataFrame | None:
    """(id, at, ...): symbols with their container and what else is asked for; None if an id has two."""
    row = F.struct(F.when(F.col("container_id") != F.col("id"), F.col("container_id")).alias("at"), *more)
    rows = cut(symbols.groupBy("id").agg(F.min(row).alias("row"), F.max(row).alias("_last")))
    return rows.select("id", "row.*") if rows.filter("row <> _last").isEmpty() else None


def _nearest(nodes: DataFrame) -> DataFrame:
    """nodes(id, at, stop) -> (id, found, depth): the nearest stop at or above each, and how far it is; without a stop, no row.

    A pointer to the container becomes one to the container's container, and so on, in twice as long
    steps each round; when a round leaves as many without an end as before, these are on cycles.
    """
    stop = F.col("stop")
    now = cut(nodes.select("id", F.when(~stop, F.col("at")).alias("at"), F.when(stop, F.col("id")).alias("found"), F.when(stop, 0).otherwise(1).alias("depth")))
    ended, active, open_ = now.filter("at is null"), now.filter("at is not null"), None
    while (left := active.count()) and left != open_:
        beyond = ended.unionByName(active).select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("found").alias("_found"), F.col("depth").alias("_depth"))
        now = cut(active.join(apart(beyond), "at", "left").select("id", F.col("_at").alias("at"), F.col("_found").alias("found"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")))
        ended, active, open_ = ended.unionByName(now.filter("at is null")), now.filter("at is not null"), left
    return ended.filter("found is not null").select("id", "found", "depth")


def container_chain(symbols: DataFrame) -> DataFrame:
    """(id, ancestor, depth): each symbol and the containers around it, itself at depth 0."""
    up = symbols.filter(F.col("container_id").isNotNull()).select(F.col("id").alias("child"), F.col("container_id").alias("parent"))
    around = closure(up).select(F.col("child").alias("id"), "ancestor", "depth")
    return symbols.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth")).unionByName(around)


def named_chains(symbols: DataFrame) -> DataFrame | None:
    """(id, chain of (id, name)): each symbol and the symbols around it, the outermost last; None if an id has two containers or names."""
    nodes = _single(symbols, F.col("name"))
    return None if nodes is None else _chains(nodes.select("id", "at", F.array(F.struct("id", "name")).alias("chain")), MOST_LEVELS + 1)


def enclosing_types(symbols: DataFrame) -> DataFrame:
    """(id, type_id): the nearest type-like symbol around each symbol, itself included."""
    own = F.col("kind").isin(*TYPE_LIKE)
    nodes = _single(symbols, F.coalesce(own, F.lit(False)).alias("stop"))
    if nodes is not None:
        return _nearest(nodes).select("id", F.col("found").alias("type_id"))
    types = symbols.filter(own).select(F.col("id").alias("ancestor"))
    near = container_chain(symbols).join(types, "ancestor")
    return near.groupBy("id").agg(F.min_by("ancestor", F.struct("depth", "ancestor")).alias("type_id"))


def descendants(symbols: DataFrame, root: str) -> DataFrame:
    """Symbols inside one, in the order of the text, with their depth below it."""
    nodes = _single(symbols)
    if nodes is None:
        seen = _descendants_by_levels(symbols, root)
    else:
        # The root is the one stop, if need be one that is no symbol itself.
        top = symbols.sparkSession.createDataFrame([(root, None)], "id string, at string")
        seen = _nearest(nodes.filter(F.col("id") != root).unionByName(top).withColumn("stop", F.col("id") == root)).select("id", "depth")
    return symbols.join(apart(seen.filter("depth > 0")), "id").orderBy("path", "name_start_line", "name_start_char", "id").select("id", "name", "kind", "depth")


def _descendants_by_levels(symbols: DataFrame, root: str) -> DataFrame:
    up = symbols.select(F.col("id").alias("child"), F.col("container_id").alias("parent")).filter("parent is not null")
    seen = symbols.sparkSession.createDataFrame([(root, 0)], "id string, depth int")
    frontier = seen
    for d in range(1, MOST_LEVELS + 2):
        below = frontier.join(apart(up), F.col("id") == F.col("parent")).select(F.col("child").alias("id")).distinct()
        frontier = cut(below.join(apart(seen.select("id")), "id", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError(f"chains of over {MOST_LEVELS} levels")


def with_ancestors(symbols: DataFrame, chosen: DataFrame) -> DataFrame:
    """ids of a selection (column id) closed under containers; each round reads the containers of those alone that are new."""
    up = cut(symbols.select(F.col("id").alias("child"), F.col("container_id").alias("parent")).filter("parent is not null").distinct())
    out = fresh = cut(chosen.select("id").distinct())
    for _ in range(MOST_LEVELS + 1):
        more = fresh.join(apart(up), F.col("id") == F.col("child")).select(F.col("parent").alias("id")).distinct()
        fresh = cut(more.join(apart(out), "id", "left_anti"))
        if fresh.isEmpty():
            return out
        out = out.unionByName(fresh)
    raise RuntimeError(f"chains of over {MOST_LEVELS} levels")


def bases(edges: DataFrame) -> DataFrame:
    """(child, parent, confidence): recorded inheritance."""
    own = edges.filter(F.col("kind").isin(*INHERITANCE) & F.col("site_path").isNotNull())
    return own.groupBy(F.col("src_id").alias("child"), F.col("dst_id").alias("parent")).agg(F.max("confidence").alias("confidence")).filter("child <> parent")


def derive_inheritance(symbols: DataFrame, edges: DataFrame, levels: int = 12) -> DataFrame:
    """(src_id, dst_id, kind, tier, confidence): what follows from recorded inheritance.

    A class implements its further ancestors, and each of its callables the callables of the same name
    in any ancestor; as sure as the least sure link on the way.
    """
    step = cut(bases(edges))
    frontier = step.select("child", F.col("parent").alias("ancestor"), "confidence", F.lit(1).alias("depth"))
    seen = frontier
    hop = step.select(F.col("child").alias("_c"), F.col("parent").alias("_p"), F.col("confidence").alias("_w"))
    for d in range(2, levels + 1):
        more = frontier.join(hop, F.col("ancestor") == F.col("_c")).select("child", F.col("_p").alias("ancestor"), F.least("confidence", "_w").alias("confidence"))
        more = more.filter("child <> ancestor").groupBy("child", "ancestor").agg(F.max("confidence").alias("confidence"))
        frontier = cut(more.join(seen.select("child", "ancestor"), ["child", "ancestor"], "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    far = seen.filter("depth > 1").select(F.col("child").alias("src_id"), F.col("ancestor").alias("dst_id"), "confidence")
    member = symbols.filter(F.col("kind").isin("function", "method", "constructor") & F.col("container_id").isNotNull()).select("id", "name", "container_id")
    own, other = member.select(F.col("id").alias("src_id"), "name", F.col("container_id").alias("child")), member.select(F.col("id").alias("dst_id"), "name", F.col("container_id").alias("ancestor"))
    shadow = seen.select("child", "ancestor", "confidence").join(own, "child").join(other, ["ancestor", "name"]).select("src_id", "dst_id", "confidence")
    found = far.unionByName(shadow).filter("src_id <> dst_id").groupBy("src_id", "dst_id").agg(F.max("confidence").alias("confidence"))
    tier = F.element_at(F.create_map(*[x for t, c in TIERS.items() for x in (F.lit(str(c)), F.lit(t))]), F.col("confidence").cast("string"))
    return found.select("src_id", "dst_id", F.lit("implements").alias("kind"), tier.alias("tier"), "confidence")


def mention_index(symbols: DataFrame) -> DataFrame:
    """(key, id): an inverted index from mention keys to navigable symbols."""
    return navigable(symbols).select("id", F.explode(mention_keys(F.col("name"))).alias("key")).select("key", "id")


def seeds_for(symbols: DataFrame, words: DataFrame) -> DataFrame:
    """words(word) -> (word, id): symbols that a word mentions; id is null for a word that mentions none."""
    asked = words.select("word", F.lower("word").alias("key")).distinct()
    return asked.join(mention_index(symbols), "key", "left").select("word", "id")

