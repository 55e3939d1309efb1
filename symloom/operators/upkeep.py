"""Incremental upkeep: what changed, which names that touches, which references to resolve again, which edges go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CONVENTION_KINDS
from .lookup import definitions_by_name


def change_set(old: DataFrame, new: DataFrame, full: bool = False) -> DataFrame:
    """(path, status) of manifests (path, digest, size, mtime_ns): added, modified, unchanged or removed.

    Equal sizes and times are enough to call a file unchanged; otherwise digests decide. A null time
    (a tree without them) never is enough. full: every file that is there counts as modified or added.
    """
    o = old.select("path", *[F.col(c).alias(f"_{c}") for c in ("digest", "size", "mtime_ns")], F.lit(True).alias("_old"))
    n = new.select("path", "digest", "size", "mtime_ns", F.lit(True).alias("_new"))
    same = ((F.col("size") == F.col("_size")) & (F.col("mtime_ns") == F.col("_mtime_ns"))) | F.coalesce(F.col("digest") == F.col("_digest"), F.lit(False))
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.lit(full), "modified").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("modified")
    return o.join(n, "path", "full").select("path", status.alias("status"))


def changed_names(before: DataFrame, after: DataFrame) -> DataFrame:
    """Names whose set of definitions differs between two symbol tables."""
    a = definitions_by_name(before).withColumnRenamed("definitions", "_a")
    b = definitions_by_name(after).withColumnRenamed("definitions", "_b")
    return a.join(b, "name", "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("name")


def scoped_refs(refs: DataFrame, touched: DataFrame, names: DataFrame, moved: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """References to resolve again.

    Those in touched files (path), of changed names (name), by convention if files came or went
    (moved: path), and those that led to a file that came or went.
    """
    mine = refs.join(touched.select("path").distinct(), "path", "left_semi")
    named = refs.join(names.select("name").distinct(), "name", "left_semi")
    out = mine.unionByName(named.select(*refs.columns))
    if not moved.isEmpty():
        out = out.unionByName(refs.filter(F.col("kind").isin(*CONVENTION_KINDS, "import", "module")))
        if edges is not None:
            gone = edges.filter(F.col("site_path").isNotNull()).withColumn("_to", F.substring_index("dst_id", "#", 1)).join(moved.select(F.col("path").alias("_to")).distinct(), "_to", "left_semi")
            sites = gone.select(F.col("site_path").alias("path"), F.col("site_start_line").alias("start_line"), F.col("site_start_char").alias("start_char")).distinct()
            out = out.unionByName(refs.join(sites, ["path", "start_line", "start_char"], "left_semi").select(*refs.columns))
    return out.dropDuplicates(["path", "start_line", "start_char", "kind", "name"])


def without_sites_in(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges but those evidenced in the paths; edges without a site stay."""
    return edges.join(paths.select(F.col("path").alias("site_path")).distinct(), "site_path", "left_anti").select(*edges.columns)


def without_sites_at(edges: DataFrame, places: DataFrame) -> DataFrame:
    """Edges but those at the places (path, start_line, start_char)."""
    at = places.select(F.col("path").alias("site_path"), F.col("start_line").alias("site_start_line"), F.col("start_char").alias("site_start_char")).distinct()
    return edges.join(at, ["site_path", "site_start_line", "site_start_char"], "left_anti").select(*edges.columns)


def without_derived(edges: DataFrame) -> DataFrame:
    return edges.filter(~((F.col("kind") == "implements") & F.col("site_path").isNull()))


def is_derived(edges: DataFrame) -> DataFrame:
    return edges.filter((F.col("kind") == "implements") & F.col("site_path").isNull())


def union_of_lookups(refs: DataFrame, paths: DataFrame, names: DataFrame, kinds: list[str]) -> DataFrame:
    """References by path, by name or by kind, each place once."""
    parts = [refs.join(paths, "path", "left_semi"), refs.join(names, "name", "left_semi").select(*refs.columns), refs.filter(F.col("kind").isin(*kinds))]
    out = parts[0].select(*refs.columns)
    for p in parts[1:]:
        out = out.unionByName(p.select(*refs.columns))
    return out.dropDuplicates(["path", "start_line", "start_char"])


def change_report(changes: DataFrame) -> DataFrame:
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return changes.agg(*[n(s) for s in ("added", "modified", "unchanged", "removed")])


def file_sets(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Paths that only one side has."""
    gone = known.select("path").join(seen.select("path"), "path", "left_anti").withColumn("side", F.lit("removed"))
    return gone.unionByName(seen.select("path").join(known.select("path"), "path", "left_anti").withColumn("side", F.lit("added")))
