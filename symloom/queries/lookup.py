"""Queries of the store reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookup as L
from .base import query

NAV = "NOT is_local AND NOT is_synthetic"


@query("""SELECT dst_id AS id, count(DISTINCT src_id) AS n FROM edge JOIN sym ON sym.id = dst_id WHERE NOT is_synthetic GROUP BY 1 ORDER BY n DESC, id LIMIT 25""")
def most_referenced(t):
    return L.most_referenced(t.symbols, t.edges, 25)


@query("""SELECT dst_id AS id, count(DISTINCT src_id) AS n FROM edge WHERE kind <> 'contains' GROUP BY 1""")
def reference_counts(t):
    return L.reference_counts(t.edges)


@query("""SELECT dst_id AS id, count(DISTINCT src_id) AS n FROM edge WHERE kind <> 'contains' AND dst_id IN (SELECT id FROM sym WHERE kind = 'class') GROUP BY 1""")
def reference_counts_of(t):
    return L.reference_counts(t.edges, t.symbols.filter("kind = 'class'"))


@query("""SELECT dst_id AS id, count(DISTINCT src_id) AS n FROM edge JOIN sym ON sym.id = src_id WHERE edge.kind <> 'contains' AND NOT is_synthetic GROUP BY 1""")
def callers_total(t):
    return L.callers(t.symbols, t.edges)


@query("""SELECT DISTINCT src_id, name, path, name_start_line FROM edge JOIN sym ON sym.id = src_id WHERE edge.kind <> 'contains' AND NOT is_synthetic AND dst_id = '7' ORDER BY path, name_start_line, src_id LIMIT 5""")
def callers_sample(t):
    return L.caller_sample(t.symbols, t.edges, "7")


@query("""SELECT src_id AS id, count(*) AS n FROM edge WHERE kind <> 'contains' GROUP BY 1""")
def out_degree(t):
    return L.out_degree(t.edges)


@query(f"""SELECT name, greatest(count(*) - 1, 0) AS namesakes FROM sym WHERE {NAV} GROUP BY 1""")
def namesakes(t):
    return L.namesakes(t.symbols)


@query(f"""SELECT name, count(*) AS n FROM sym WHERE {NAV} GROUP BY 1""")
def collision_rate(t):
    return L.collision_rate(t.symbols)


@query("""SELECT 'edges' AS relation, count(*) AS rows FROM edge UNION ALL SELECT 'files', count(DISTINCT path) FROM sym UNION ALL SELECT 'ranks', count(*) FROM ranks UNION ALL SELECT 'refs', count(*) FROM edge WHERE site_path IS NOT NULL
UNION ALL SELECT 'imports', count(*) FROM edge WHERE kind = 'imports' UNION ALL SELECT 'symbols', count(*) FROM sym""")
def table_counts(t):
    return L.table_counts({"symbols": t.symbols, "edges": t.edges, "ranks": t.ranks, "files": t.symbols.select("path").distinct(), "refs": t.edges.filter("site_path is not null"), "imports": t.edges.filter("kind = 'imports'")})


@query("""SELECT kind, count(*) AS n FROM edge GROUP BY 1""")
def edges_by_kind(t):
    return L.edges_by_kind(t.edges)


@query("""SELECT name, md5(string_agg(d, chr(30) ORDER BY d)) AS definitions FROM (SELECT DISTINCT name, concat_ws(chr(31), id, kind, path, coalesce(container_id, ''), coalesce(signature, ''), CAST(is_local AS VARCHAR)) AS d FROM sym WHERE NOT is_synthetic) GROUP BY 1""")
def definitions_by_name(t):
    return L.definitions_by_name(t.symbols).select("name", F.md5(F.array_join("definitions", "\x1e")).alias("definitions"))


def _search_sql(q: str, where: str, limit: str, kinds: str = "") -> str:
    return f"""SELECT id, name, path, round(coalesce(score, 0), 9) AS score FROM sym LEFT JOIN ranks ON symbol_id = id
    WHERE {NAV} AND ({where}) {kinds} ORDER BY lower(name) = '{q}' DESC, contains(lower(name), '{q}') DESC, coalesce(score, 0) DESC, starts_with(lower(name), '{q}') DESC, length(name), path, name_start_line, id {limit}"""


def _search(t, *args, **more):
    return L.search(t.symbols, t.ranks, *args, **more).select("id", "name", "path", F.round("score", 9).alias("score"))


@query(_search_sql("ring", "contains(lower(name), 'ring') OR contains(lower(qualified_name), 'ring')", "LIMIT 20"))
def search_long(t):
    return _search(t, "RING")


@query(_search_sql("ed", "contains(lower(name), 'ed')", "LIMIT 20"))
def search_short(t):
    return _search(t, "ed")


@query(_search_sql("brand#2", "contains(lower(name), 'brand#2') OR contains(lower(qualified_name), 'brand#2')", "LIMIT 30 OFFSET 20", "AND kind IN ('class', 'method')"))
def search_kinds_page(t):
    return _search(t, "Brand#2", ["class", "method"], limit=30, offset=20)


@query(f"""SELECT count(*) AS n FROM sym WHERE {NAV} AND (contains(lower(name), 'ring') OR contains(lower(qualified_name), 'ring'))""")
def search_count(t):
    return L.search_count(t.symbols, "ring")


@query(f"""SELECT id, path, round(coalesce(score, 0), 9) AS score FROM sym LEFT JOIN ranks ON symbol_id = id WHERE {NAV} AND name = 'small_ring' AND contains(concat('/', path, '/'), '/Brand#2/')
ORDER BY coalesce(score, 0) DESC, path, name_start_line, id LIMIT 50""")
def symbols_named_scoped(t):
    return L.symbols_named(t.symbols, t.ranks, "small_ring", "Brand#2").select("id", "path", F.round("score", 9).alias("score"))


@query(f"""SELECT id FROM sym LEFT JOIN ranks ON symbol_id = id WHERE {NAV} AND name = 'small_ring' ORDER BY coalesce(score, 0) DESC, path, name_start_line, id LIMIT 1 OFFSET 2""")
def nth_named(t):
    return L.nth_named(t.symbols, t.ranks, "small_ring", 3).select("id")


@query("""WITH pts AS (SELECT DISTINCT path, name_start_line + 3 AS line FROM sym), near AS (SELECT pts.path, line, id, row_number() OVER (PARTITION BY pts.path, line ORDER BY (name_start_line = line) DESC, full_end_line - name_start_line, id) AS n
FROM pts JOIN sym ON sym.path = pts.path AND line BETWEEN name_start_line AND full_end_line WHERE NOT is_synthetic) SELECT path, line, id FROM near WHERE n = 1""")
def symbol_at(t):
    return L.symbols_at(t.symbols, t.symbols.select("path", (F.col("name_start_line") + 3).alias("line")))


@query("""RECURSIVE WITH own AS (SELECT * FROM sym WHERE NOT is_local AND NOT is_synthetic AND path IN ('Brand#2/PROMO.py')),
walk AS (SELECT id, container_id AS up, 0 AS depth FROM own UNION ALL SELECT walk.id, c.container_id, depth + 1 FROM walk JOIN own c ON c.id = walk.up)
SELECT own.id, name, kind, name_start_line, CAST(max(depth) AS INTEGER) AS depth FROM own JOIN walk ON walk.id = own.id GROUP BY 1, 2, 3, 4""")
def file_outline(t):
    return L.file_outline(t.symbols, "Brand#2/PROMO.py").select("id", "name", "kind", "name_start_line", "depth")


@query("""SELECT src_id, kind, confidence, site_path FROM edge WHERE dst_id = '7' AND kind <> 'contains' AND confidence >= 0.92
ORDER BY coalesce(site_path, ''), site_start_line, site_start_char, src_id, kind, confidence LIMIT 10 OFFSET 5""")
def references_page2(t):
    return L.references(t.edges, "7", 0.92, 10, 5).select("src_id", "kind", "confidence", "site_path")


@query("""SELECT src_id, dst_id, kind, confidence, site_path FROM edge WHERE kind <> 'contains' AND site_path IS NOT NULL AND confidence >= 0.98""")
def confident_uses(t):
    return L.confident(L.uses(t.edges), 0.98).select("src_id", "dst_id", "kind", "confidence", "site_path")


@query("""RECURSIVE WITH walk AS (SELECT id, container_id AS up, name AS path, 0 AS depth FROM sym UNION ALL SELECT walk.id, c.container_id, concat(c.name, '/', walk.path), depth + 1 FROM walk JOIN sym c ON c.id = walk.up)
SELECT id, arg_max(walk.path, depth) AS name_path FROM walk GROUP BY id""")
def name_path(t):
    return L.container_paths(t.symbols)


@query("""SELECT id, array_to_string(list_concat(list_filter(string_split(CASE WHEN qualified_name = name THEN '' ELSE left(qualified_name, length(qualified_name) - length(name) - 1) END, '.'), lambda x: x <> ''), [name]), '/') AS name_path FROM sym""")
def qualified_path(t):
    return t.symbols.select("id", L.name_path_of(F.col("name"), F.col("qualified_name")).alias("name_path"))


@query("""WITH nav AS (SELECT id, lower(name) AS n, lower(qualified_name) AS q FROM sym WHERE NOT is_local AND NOT is_synthetic),
grams AS (SELECT DISTINCT id, substr(n, i, 3) AS gram FROM (SELECT id, n, unnest(range(1, greatest(length(n) - 1, 1))) AS i FROM nav) UNION SELECT DISTINCT id, substr(q, i, 3) FROM (SELECT id, q, unnest(range(1, greatest(length(q) - 1, 1))) AS i FROM nav))
SELECT gram, count(*) AS n FROM grams WHERE length(gram) = 3 GROUP BY 1""")
def trigram_index(t):
    return L.trigram_index(t.symbols).groupBy("gram").agg(F.count("*").alias("n"))


@query(_search_sql("brand#2.small", "contains(lower(name), 'brand#2.small') OR contains(lower(qualified_name), 'brand#2.small')", "LIMIT 20"))
def search_trigrams(t):
    return _search(t, "Brand#2.small", index=L.trigram_index(t.symbols))


@query("""SELECT id, concat(kind, ' ', qualified_name, '  ', path, ':', name_start_line + 1) AS line FROM sym""")
def described(t):
    return L.described(t.symbols)


@query("""WITH scopes AS (SELECT o_custkey, o_orderkey AS id, epoch(o_orderdate) // 86400 AS lo, epoch(o_orderdate) // 86400 + 90 + o_orderkey % 30 AS hi FROM orders),
pts AS (SELECT o_custkey, o_orderkey AS point, epoch(o_orderdate) // 86400 + 10 AS pt FROM orders),
near AS (SELECT point, id, row_number() OVER (PARTITION BY point ORDER BY lo DESC, hi, id) AS n FROM pts JOIN scopes USING (o_custkey) WHERE lo <= pt AND pt < hi) SELECT point, id FROM near WHERE n = 1""", prelude=None)
def innermost_span(t):
    day = F.floor(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) / 86400)
    o = t["orders"].select("o_custkey", "o_orderkey", day.alias("d"))
    scopes = o.select("o_custkey", F.col("o_orderkey").alias("id"), F.col("d").alias("lo"), (F.col("d") + 90 + F.col("o_orderkey") % 30).alias("hi"))
    points = o.select("o_custkey", F.col("o_orderkey").alias("point"), (F.col("d") + 10).alias("at"))
    return L.innermost(scopes, points, ("o_custkey",))
