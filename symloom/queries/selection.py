"""Queries of token budgets and rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as K
from ..operators import select as S
from .base import query

_TOKENS = "CASE WHEN length({0}) = 0 THEN 0 ELSE CAST(floor((length({0}) - (length({0}) - length(replace({0}, chr(10), '')))) / 2.62::DOUBLE) AS BIGINT) + (length({0}) - length(replace({0}, chr(10), ''))) + 1 END"


@query(f"SELECT doc_id, {_TOKENS.format('text')} AS tokens FROM documents WHERE text IS NOT NULL", prelude=None)
def token_estimate(t):
    return t["documents"].filter("text is not null").select("doc_id", K.estimate(F.col("text")).alias("tokens"))


@query(f"""WITH line AS (SELECT path, name_start_line AS n, id, signature, {_TOKENS.format('signature')} + 1 AS cost FROM sym WHERE NOT is_synthetic AND NOT is_local),
run AS (SELECT id, CAST(sum(cost) OVER (ORDER BY path, n, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM line) SELECT id, spent FROM run WHERE spent <= 2000""")
def skeleton_budget(t):
    return S.skeleton_prefix(t.symbols, 2000).select("id", "spent")


@query(f"""WITH files AS (SELECT concat(lang, '/', source, '/', doc_id) AS p, {_TOKENS.format('text')} AS tokens, doc_id % 9 AS symbols FROM documents WHERE text IS NOT NULL),
every AS (SELECT 0 AS level, '' AS path, tokens, symbols FROM files UNION ALL SELECT 1, split_part(p, '/', 1), tokens, symbols FROM files UNION ALL SELECT 2, concat(split_part(p, '/', 1), '/', split_part(p, '/', 2)), tokens, symbols FROM files)
SELECT level, path, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS files, CAST(sum(symbols) AS BIGINT) AS symbols FROM every GROUP BY 1, 2""", prelude=None)
def token_rollup(t):
    files = t["documents"].filter("text is not null").select(F.concat_ws("/", "lang", "source", "doc_id").alias("path"), K.estimate(F.col("text")).alias("tokens"), (F.col("doc_id") % 9).alias("symbols"))
    return S.token_tree(files, 2).select("level", "path", "tokens", "files", "symbols")


_SCORED = "WITH scored AS (SELECT id, path, score FROM sym JOIN ranks ON symbol_id = id)"


@query(f"{_SCORED}, best AS (SELECT path FROM scored GROUP BY path ORDER BY max(score) DESC, path LIMIT 5) SELECT id, path, score FROM scored WHERE path IN (SELECT path FROM best)")
def top_files(t):
    return S.top_files(_scored(t), 5)


@query(f"{_SCORED}, k AS (SELECT id, path, score, row_number() OVER (PARTITION BY path ORDER BY score DESC, id) AS k FROM scored) SELECT id, CAST(k AS INTEGER) AS k, round(score / sqrt(k), 12) AS gain FROM k")
def file_discount(t):
    return S.file_discount(_scored(t)).select("id", "k", F.round("gain", 12).alias("gain"))


def _scored(t):
    return t.symbols.select("id", "path").join(t.ranks.withColumnRenamed("symbol_id", "id"), "id")


@query()
def repo_map(t):
    """The map as lines; greedy choice over a bounded pool, which SQL cannot say."""
    text, _ = S.render_map(t.symbols, t.ranks, 2000)
    return t.spark.createDataFrame([(i, line) for i, line in enumerate(text.split("\n"))], "n int, line string")


@query(f"""WITH l AS (SELECT CAST(conv_id AS VARCHAR) AS path, CAST(turn AS INTEGER) AS line, left(text, 120) AS text FROM conversations WHERE contains(lower(text), 'the') AND NOT contains(text, chr(10))), b AS (SELECT path, count(*) AS hits FROM l GROUP BY path),
r AS (SELECT l.path, line, text, CAST(sum({_TOKENS.format('text')} + 1) OVER (ORDER BY hits DESC, l.path, line ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM l JOIN b ON b.path = l.path) SELECT path, line, spent FROM r WHERE spent <= 3000""", prelude=None)
def grep_prefix(t):
    """Turns as the lines of a file that a conversation is."""
    turns = t["conversations"].filter(~F.col("text").contains("\n")).select(F.col("conv_id").cast("string").alias("path"), "turn", "text")
    last = turns.agg(F.max("turn")).first()[0] or 0
    rows = F.transform(F.sequence(F.lit(0), F.lit(int(last))), lambda i: F.coalesce(F.try_element_at("x", i.cast("bigint")), F.lit("")))
    files = turns.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("bigint"), "text"))).alias("x")).select("path", F.array_join(rows, "\n").alias("content"))
    return S.grep_prefix(files, ["THE"], 3000).select("path", "line", "spent")
