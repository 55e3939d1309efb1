"""Queries of the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from .base import query


@query(r"SELECT DISTINCT path, regexp_replace(trim(replace(concat('./', path), chr(92), '/')), '^(\./|/)+', '') AS clean, string_split(path, '/')[-1] AS base FROM sym")
def path_functions(t):
    p = F.col("path")
    return t.symbols.select("path", N.normalise_path(F.concat(F.lit("./"), p)).alias("clean"), N.basename(p).alias("base")).distinct()


@query("SELECT id, starts_with(name, '_') OR starts_with(signature, 'private ') AS private FROM sym")
def private_symbols(t):
    return t.symbols.select("id", N.is_private(F.col("name"), F.col("signature")).alias("private"))


@query("SELECT id FROM sym WHERE contains(concat('/', path, '/'), '/Brand#1/') OR starts_with(path, 'Brand#1/')")
def path_scope(t):
    return t.symbols.filter(N.in_scope(F.col("path"), "Brand#1")).select("id")


@query("""WITH n AS (SELECT DISTINCT name FROM sym), p AS (SELECT name, list_filter(string_split(lower(name), '_'), lambda x: length(x) >= 4) AS pieces FROM n)
SELECT name, array_to_string(list_sort(list_distinct(list_concat([lower(name)], pieces))), ' ') AS keys FROM p""")
def mention_keys(t):
    return t.symbols.select("name").distinct().select("name", F.array_join(N.mention_keys(F.col("name")), " ").alias("keys"))
