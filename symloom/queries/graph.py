"""Queries of the graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..schema import EDGE_WEIGHTS, KIND_PRIORS, OTHER_WEIGHT
from ..session import cut
from .base import query, rounded

_W = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in EDGE_WEIGHTS.items()) + f" ELSE {OTHER_WEIGHT} END"
_P = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in KIND_PRIORS.items()) + f" ELSE {KIND_PRIORS['unknown']} END"
WEIGHTS = f"""nav AS (SELECT * FROM sym WHERE NOT is_local AND NOT is_synthetic),
turned AS (SELECT CASE WHEN kind = 'contains' THEN dst_id ELSE src_id END AS src, CASE WHEN kind = 'contains' THEN src_id ELSE dst_id END AS dst, {_W} * confidence AS w FROM edge),
wt AS (SELECT src, dst, sqrt(sum(w)) AS w FROM turned WHERE src <> dst AND src IN (SELECT id FROM nav) AND dst IN (SELECT id FROM nav) GROUP BY 1, 2)"""


def _restart(focus: str = "1") -> str:
    return f"""raw AS (SELECT id, {_P} * CASE WHEN starts_with(name, '_') OR starts_with(signature, 'private ') THEN 0.25 ELSE 1 END * {focus} AS r FROM nav),
start AS (SELECT id, r / sum(r) OVER () AS r FROM raw)"""


def _walk(steps: int, focus: str = "1") -> str:
    out = f"WITH {WEIGHTS}, {_restart(focus)}, moves AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM wt), x0 AS (SELECT id, r AS x FROM start)"
    for i in range(1, steps + 1):
        out += f""", x{i} AS MATERIALIZED (SELECT start.id, (0.15 + 0.85 * (SELECT coalesce(sum(x), 0) FROM x{i - 1} WHERE id NOT IN (SELECT src FROM moves))) * r + 0.85 * coalesce(f.flow, 0) AS x
        FROM start LEFT JOIN (SELECT dst, sum(x * p) AS flow FROM x{i - 1} JOIN moves ON src = id GROUP BY dst) f ON f.dst = start.id)"""
    return out + f" SELECT id, round(x, 9) AS score FROM x{steps}"


@query(f"WITH {WEIGHTS} SELECT src, dst, round(w, 9) AS w FROM wt")
def graph_weights(t):
    return G.graph_weights(t.symbols, t.edges).select("src", "dst", rounded("w"))


@query(f"WITH {WEIGHTS} SELECT dst AS id, count(DISTINCT src) AS in_degree FROM wt GROUP BY 1")
def in_degree(t):
    return G.in_degree(G.graph_weights(t.symbols, t.edges))


@query(f"WITH {WEIGHTS}, {_restart()} SELECT id, round(r, 12) AS r FROM start")
def personalisation(t):
    return G.personalisation(t.symbols).select("id", rounded("r", 12))


@query(_walk(10))
def pagerank_k10(t):
    return G.pagerank(t.symbols, G.graph_weights(t.symbols, t.edges), iterations=10).select("id", rounded("score"))


@query(_walk(10, "CASE WHEN path = 'Brand#3/PROMO.py' THEN 50 ELSE 1 END"))
def pagerank_focus_k10(t):
    return G.pagerank(t.symbols, G.graph_weights(t.symbols, t.edges), ["Brand#3/PROMO.py"], iterations=10).select("id", rounded("score"))


@query()
def pagerank_converged(t):
    weights = cut(G.graph_weights(t.symbols, t.edges))  # the walk and the degrees read it
    return G.ranked(t.symbols, weights, G.pagerank(t.symbols, weights)).select("symbol_id", rounded("score", 5), "in_degree")


def _bfs(depth: int, direction: str, where: str = "TRUE") -> str:
    hop = {"out": "SELECT src_id AS a, dst_id AS b FROM edge", "in": "SELECT dst_id AS a, src_id AS b FROM edge", "both": "SELECT src_id AS a, dst_id AS b FROM edge WHERE {w} UNION SELECT dst_id, src_id FROM edge"}[direction]
    hop = hop.replace("{w}", where) + f" WHERE {where}"
    out = f"WITH hop AS (SELECT DISTINCT a, b FROM ({hop})), l0 AS (SELECT '7' AS id, 0 AS depth)"
    seen = "SELECT id FROM l0"
    for d in range(1, depth + 1):
        out += f", l{d} AS (SELECT DISTINCT b AS id, {d} AS depth FROM l{d - 1} JOIN hop ON a = id WHERE b NOT IN ({seen}))"
        seen += f" UNION SELECT id FROM l{d}"
    return out + " " + " UNION ALL ".join(f"SELECT id, depth FROM l{d}" for d in range(1, depth + 1))


@query(_bfs(1, "out"))
def neighbours_d1(t):
    return G.neighbours(t.edges, "7")


@query(_bfs(2, "both", "confidence >= 0.95"))
def neighbours_d2(t):
    return G.neighbours(t.edges, "7", "both", 2, least=0.95)


@query(_bfs(3, "in", "kind IN ('calls', 'references')"))
def neighbours_d3(t):
    return G.neighbours(t.edges, "7", "in", 3, ["calls", "references"])


CHAIN = """RECURSIVE WITH up AS (SELECT id AS child, container_id AS parent FROM sym WHERE container_id IS NOT NULL),
chain AS (SELECT child, parent AS ancestor, 1 AS depth FROM up UNION ALL SELECT chain.child, up.parent, depth + 1 FROM chain JOIN up ON up.child = ancestor)"""


@query(CHAIN + " SELECT child, ancestor, depth FROM chain")
def ancestors(t):
    return G.closure(t.symbols.filter("container_id is not null").select(F.col("id").alias("child"), F.col("container_id").alias("parent")))


@query(CHAIN + """, every AS (SELECT child, ancestor, depth FROM chain UNION ALL SELECT id, id, 0 FROM sym)
SELECT child AS id, arg_min(ancestor, depth) AS type_id FROM every JOIN sym ON sym.id = ancestor AND sym.kind IN ('class', 'interface') GROUP BY child""")
def enclosing_type(t):
    return G.enclosing_types(t.symbols)


@query(CHAIN + """ SELECT sym.id, name, kind, depth FROM chain JOIN sym ON sym.id = child WHERE ancestor = '3'""")
def skeleton(t):
    return G.descendants(t.symbols, "3")


@query(CHAIN + """ SELECT DISTINCT id FROM (SELECT id FROM sym WHERE kind = 'field' UNION ALL SELECT ancestor FROM chain JOIN sym ON sym.id = child WHERE kind = 'field')""")
def with_ancestors(t):
    return G.with_ancestors(t.symbols, t.symbols.filter("kind = 'field'"))


_BASES = """base AS (SELECT src_id AS child, CAST(CAST(src_id AS BIGINT) // 3 AS VARCHAR) AS parent, max(confidence) AS c FROM edge WHERE kind = 'inherits' AND site_path IS NOT NULL AND CAST(src_id AS BIGINT) >= 3 GROUP BY 1, 2)"""


@query(f"""RECURSIVE WITH {_BASES},
up AS (SELECT child, parent AS ancestor, c, 1 AS depth FROM base UNION ALL SELECT up.child, base.parent, least(up.c, base.c), depth + 1 FROM up JOIN base ON base.child = ancestor WHERE depth < 12),
seen AS (SELECT child, ancestor, max(c) AS c, min(depth) AS depth FROM up GROUP BY 1, 2),
mem AS (SELECT id, name, container_id FROM sym WHERE kind IN ('function', 'method', 'constructor') AND container_id IS NOT NULL),
found AS (SELECT child AS src_id, ancestor AS dst_id, c FROM seen WHERE depth > 1
  UNION ALL SELECT a.id, b.id, c FROM seen JOIN mem a ON a.container_id = child JOIN mem b ON b.container_id = ancestor AND a.name = b.name)
SELECT src_id, dst_id, 'implements' AS kind, max(c) AS confidence FROM found WHERE src_id <> dst_id GROUP BY 1, 2""")
def derived_overrides(t):
    edges = t.edges.filter("kind = 'inherits' and cast(src_id as long) >= 3").withColumn("dst_id", F.floor(F.col("src_id").cast("long") / 3).cast("long").cast("string"))
    return G.derive_inheritance(t.symbols, edges).select("src_id", "dst_id", "kind", "confidence")


@query("""WITH nav AS (SELECT id, name FROM sym WHERE NOT is_local AND NOT is_synthetic),
keys AS (SELECT DISTINCT id, k FROM (SELECT id, lower(name) AS k FROM nav UNION ALL SELECT id, lower(p) FROM (SELECT id, unnest(string_split_regex(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+')) AS p FROM nav) WHERE length(p) >= 4)),
w AS (SELECT unnest(['ring', 'widget', 'Small', 'nothing']) AS word) SELECT word, id FROM w LEFT JOIN keys ON k = lower(word)""")
def mention_seeds(t):
    words = t.spark.sql("SELECT explode(array('ring', 'widget', 'Small', 'nothing')) AS word")
    return G.seeds_for(t.symbols, words)
