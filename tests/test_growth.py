"""Steps make rows in proportion to what they read: counted in the plans that ran."""

from __future__ import annotations

import random

from symloom.operators import facts as E
from symloom.operators import graph as G
from symloom.operators import lookup as L
from symloom.operators import resolve as R
from symloom.operators import select as S
from symloom.queries import resolution
from symloom.queries.base import Tables
from symloom.session import cut


def nodes(plan):
    name = plan.getClass().getSimpleName()
    below = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    yield plan
    for p in below:
        yield from nodes(p)


def most_rows(df) -> int:
    """The most rows that a step of a collected table gave."""
    counts = [n.metrics().apply("numOutputRows").value() for n in nodes(df._jdf.queryExecution().executedPlan()) if n.metrics().contains("numOutputRows")]
    return max(counts, default=0)


def test_points_are_not_paired_with_the_spans_over_them(spark):
    n = 600
    row = [("p", str(i), n + i, i, 2 * n - i % 7, False) for i in range(n)]
    symbols = spark.createDataFrame(row, "path string, id string, name_start_line int, full_start_line int, full_end_line int, is_synthetic boolean").withColumn("name_end_line", L.F.col("name_start_line"))
    points = spark.createDataFrame([("p", i) for i in range(2 * n)], "path string, line int")
    df = L.symbols_at(symbols, points)
    got = {r["line"]: r["id"] for r in df.collect()}
    spans = [(line, first, last, i) for _, i, line, first, last, _ in row]
    assert got == {x: min((at != x, last - first, i) for at, first, last, i in spans if first <= x <= last)[2] for x in range(2 * n)}
    assert most_rows(df) < 100 * n  # pairs of a point and a span around it are n * n


def test_chains_double(spark, monkeypatch):
    """Rounds grow with the logarithm of the depth, and no side of a join goes through the driver."""
    rows = [(str(i), f"n{i}", "class" if i == 0 else "method", str(i - 1) if i else None) for i in range(70)]
    rows += [("x", "x", "method", "y"), ("y", "y", "method", "x"), ("z", "z", "method", "x"), ("t", "t", "class", "t"), ("u", "u", "field", "gone"), ("v", "v", "field", "u")]
    symbols = spark.createDataFrame(rows, "id string, name string, kind string, container_id string").withColumns({"path": L.F.lit("p"), "name_start_line": L.F.lit(0), "name_start_char": L.F.lit(0)})
    rounds = []

    def counted(df):
        rounds.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(G, "cut", counted)
    up = symbols.filter("container_id is not null").select(L.F.col("id").alias("child"), L.F.col("container_id").alias("parent"))
    deep = {(str(i), str(j), i - j) for i in range(70) for j in range(i)}
    pairs = deep | {("x", "y", 1), ("y", "x", 1), ("z", "x", 1), ("z", "y", 2), ("u", "gone", 1), ("v", "u", 1), ("v", "gone", 2)}
    assert {tuple(r) for r in G.closure(up).collect()} == pairs
    assert {tuple(r) for r in G.closure(up.union(spark.createDataFrame([("z", "69")], up.schema)).filter("child in ('z', '1', '2')")).collect()} == {("z", "x", 1), ("z", "69", 1), ("1", "0", 1), ("2", "1", 1), ("2", "0", 2)}
    paths = {str(i): "/".join(f"n{j}" for j in range(i + 1)) for i in range(70)} | {"x": "y/x", "y": "x/y", "z": "y/x/z", "t": "t", "u": "u", "v": "u/v"}
    assert {r["id"]: r["name_path"] for r in L.container_paths(symbols).collect()} == paths
    assert {tuple(r) for r in G.enclosing_types(symbols).collect()} == {(str(i), "0") for i in range(70)} | {("t", "t")}
    assert [(r["id"], r["depth"]) for r in G.descendants(symbols, "3").collect()] == sorted((str(i), i - 3) for i in range(4, 70))
    assert {r["id"]: r["depth"] for r in G.descendants(symbols, "x").collect()} == {"y": 1, "z": 1}
    assert len(rounds) < 60 and not [p for p in rounds if "BroadcastHashJoin" in p]


def test_single_facts_are_matched_without_python(spark):
    kinds = "path string, start_line int, start_char int, end_line int, end_char int, kind string"
    r = random.Random(5)
    fact = lambda: (r.choice(["a", "b", None]), r.choice([*range(40), None]), (x := r.randint(0, 3)), 1 if r.random() < 0.1 else None, x + r.randint(0, 3), r.choice(["k", "l", None]))
    c, o = (spark.createDataFrame([fact() for _ in range(150)], kinds).distinct() for _ in range(2))
    for policy in ("exact", "line"):
        left, right = (sorted(df.collect(), key=str) for df in (c, o))
        near = [[j for j, b in enumerate(right) if None not in a[:2] and a[:2] == b[:2] and (policy == "line" or a[2:5] == b[2:5]) and (a[5] is None or b[5] is None or a[5] == b[5])] for a in left]
        df = E.match_facts(c, o, policy)
        got = [r["status"] for r in df.collect()]
        hits = sum(x >= 0 for x in E.maximum_matching(near, len(right)))
        assert (got.count("tp"), got.count("fp"), got.count("fn")) == (hits, len(left) - hits, len(right) - hits)
    one = spark.range(2000).select(L.F.lit("a").alias("path"), L.F.col("id").cast("int").alias("start_line"), *[L.F.lit(x).alias(y) for x, y in ((0, "start_char"), (1, "end_line"), (2, "end_char"), ("k", "kind"))])
    df = E.match_facts(one, one, "exact")
    assert {r["status"] for r in df.collect()} == {"tp"}
    sent = [n.metrics().apply("pythonDataSent").value() for n in nodes(df._jdf.queryExecution().executedPlan()) if n.metrics().contains("pythonDataSent")]
    assert sum(sent) < 40 * 2000  # a fact alone takes over 40 bytes


def test_pairs_by_name_are_not_gathered(spark):
    symbols = spark.createDataFrame([(str(i), "n", False, False) for i in range(50)] + [("0", "m", False, False), ("9", "n", False, False)], "id string, name string, is_synthetic boolean, is_local boolean")
    refs = spark.createDataFrame([("p", n, str(s)) for s in range(20) for n in "mn"], "path string, name string, container_id string")
    df = R.name_matched(refs, symbols, spark.createDataFrame([], "module_path string, module_id string"))
    got = [(r["src_id"], r["dst_id"]) for r in df.collect()]
    assert sorted(got) == sorted({(str(s), str(d)) for s in range(20) for d in range(50) if s != d})
    shuffled = [n.metrics().apply("shuffleRecordsWritten").value() for n in nodes(df._jdf.queryExecution().executedPlan()) if n.getClass().getSimpleName() == "ShuffleExchangeExec"]
    assert max(shuffled) < 200  # of 980 pairs


def test_walks_move_packed_blocks(spark, monkeypatch):
    n = 120
    start = [(str(i), "n", "class" if i % 3 else "method", "p", "", False, False) for i in range(n)]
    symbols = spark.createDataFrame(start, "id string, name string, kind string, path string, signature string, is_local boolean, is_synthetic boolean")
    r = random.Random(2)
    weights = spark.createDataFrame(sorted({(str(r.randrange(n - 9)), str(r.randrange(n))): r.choice([1.0, 0.5, r.random()]) for _ in range(500)}.items()), "k struct<src: string, dst: string>, w double").select("k.*", "w")
    want = dict(G.pagerank(symbols, weights, iterations=3).collect())
    rows = []

    def counted(df):
        out = cut(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(G, "cut", counted)
    for nodes_, edges in ((100_000, 500_000), (50, 90)):
        monkeypatch.setattr(G, "BLOCK_NODES", nodes_, raising=False)
        monkeypatch.setattr(G, "CHUNK_EDGES", edges, raising=False)
        got = dict(G.pagerank(symbols, weights, iterations=3, most_local=0).collect())
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
        assert max(rows[-3:]) <= 3  # rows of a step: blocks, not nodes


def test_symbols_are_not_broadcast(spark):
    """The joins with a row for each symbol, as planned for tables of any size."""
    t = Tables(spark, "/root/testdata/sf0.001")
    refs, _, _, imports, _ = resolution._tables(t)
    for df in (refs, imports, S.pool(t.symbols, t.ranks, 100)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
