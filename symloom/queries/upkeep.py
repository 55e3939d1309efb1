"""Queries of incremental upkeep: two manifests of the same files, two versions of the same symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import upkeep as U
from .base import query

_FILES = """old AS (SELECT CAST(page_id AS VARCHAR) AS path, md5(html) AS digest, length(html) AS size, page_id AS mtime FROM pages WHERE page_id % 5 <> 0),
new AS (SELECT CAST(page_id AS VARCHAR) AS path, CASE WHEN page_id % 7 = 0 THEN md5(concat(html, 'x')) ELSE md5(html) END AS digest, length(html) AS size, page_id + CASE WHEN page_id % 2 = 0 OR page_id % 7 = 0 THEN 1 ELSE 0 END AS mtime FROM pages WHERE page_id % 6 <> 0)"""
_CHANGES = f"""WITH {_FILES}, changes AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed'
  WHEN (o.size = n.size AND o.mtime = n.mtime) OR o.digest = n.digest THEN 'unchanged' ELSE 'modified' END AS status FROM old o FULL JOIN new n ON o.path = n.path)"""


def _manifests(t):
    p, key = t["pages"], F.col("page_id")
    path, size = key.cast("string").alias("path"), F.length("html").cast("long").alias("size")
    old = p.filter(key % 5 != 0).select(path, F.md5("html").alias("digest"), size, key.alias("mtime_ns"))
    digest = F.when(key % 7 == 0, F.md5(F.concat("html", F.lit("x")))).otherwise(F.md5("html"))
    new = p.filter(key % 6 != 0).select(path, digest.alias("digest"), size, (key + F.when((key % 2 == 0) | (key % 7 == 0), 1).otherwise(0)).alias("mtime_ns"))
    return old, new


@query(f"{_CHANGES} SELECT path, status FROM changes", prelude=None)
def change_set(t):
    return U.change_set(*_manifests(t))


@query(f"{_CHANGES} SELECT count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'modified') AS modified, count(*) FILTER (WHERE status = 'unchanged') AS unchanged, count(*) FILTER (WHERE status = 'removed') AS removed FROM changes", prelude=None)
def change_report(t):
    return U.change_report(U.change_set(*_manifests(t)))


@query(f"WITH {_FILES} SELECT path, 'removed' AS side FROM old WHERE path NOT IN (SELECT path FROM new) UNION ALL SELECT path, 'added' FROM new WHERE path NOT IN (SELECT path FROM old)", prelude=None)
def file_sets(t):
    return U.file_sets(*_manifests(t))


_GONE = "WITH gone AS (SELECT concat('f', o_orderkey % 50, '.py') AS p FROM orders WHERE o_orderkey % 50 < 7)"
_COLUMNS = "src_id, dst_id, kind, confidence, site_path"


@query(f"{_GONE} SELECT {_COLUMNS} FROM edge WHERE site_path IS NULL OR site_path NOT IN (SELECT p FROM gone)")
def edges_outside_paths(t):
    gone = t["orders"].filter("o_orderkey % 50 < 7").select(F.concat(F.lit("f"), (F.col("o_orderkey") % 50).cast("string"), F.lit(".py")).alias("path"))
    return U.without_sites_in(t.edges, gone).select(*_COLUMNS.split(", "))


@query(f"SELECT {_COLUMNS} FROM edge WHERE site_path IS NULL OR site_start_line % 3 <> 0 OR site_start_char <> 2")
def edges_off_places(t):
    at = t.edges.filter("site_path is not null and site_start_line % 3 = 0 and site_start_char = 2")
    return U.without_sites_at(t.edges, at.select(F.col("site_path").alias("path"), F.col("site_start_line").alias("start_line"), F.col("site_start_char").alias("start_char"))).select(*_COLUMNS.split(", "))


@query(f"SELECT {_COLUMNS} FROM edge WHERE NOT (kind = 'inherits' AND site_path IS NULL)")
def edges_written(t):
    kind = F.col("kind")
    seen = t.edges.withColumn("kind", F.when(kind == "inherits", "implements").otherwise(kind))
    return U.without_derived(seen).withColumn("kind", F.when(kind == "implements", "inherits").otherwise(kind)).select(*_COLUMNS.split(", "))
