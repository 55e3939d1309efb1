"""The driver's tables seen as the relations of an index, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[["Tables"], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_KINDS = {"STANDARD": "class", "ECONOMY": "function", "MEDIUM": "method", "PROMO": "field", "SMALL": "interface", "LARGE": "variable"}
_EDGES = {"AF": "contains", "AO": "imports", "NF": "calls", "NO": "inherits", "RF": "references", "RO": "uses_type"}


def _case(column: str, values: dict[str, str], other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE '{other}' END"


#: Common table expressions that give the relations in DuckDB; the Spark side below says the same.
RELATIONS = f"""
sym AS (SELECT CAST(p_partkey AS VARCHAR) AS id, replace(p_name, ' ', '_') AS name, concat(p_brand, '/', p_type, '.py') AS path, {_case("p_type", _KINDS, "unknown")} AS kind,
  concat(p_brand, '.', replace(p_name, ' ', '_')) AS qualified_name, CASE WHEN p_partkey // 2 > 0 THEN CAST(p_partkey // 2 AS VARCHAR) END AS container_id,
  concat(CASE WHEN p_partkey % 5 = 0 THEN 'private ' ELSE '' END, 'def ', replace(p_name, ' ', '_'), '()') AS signature,
  p_size % 10 = 0 AS is_local, p_partkey % 97 = 0 AS is_synthetic, CAST(p_partkey % 1000 AS INTEGER) AS name_start_line, CAST(p_partkey % 1000 + p_size AS INTEGER) AS full_end_line FROM part),
lines AS (SELECT l_orderkey, l_linenumber, l_partkey, min(concat(l_returnflag, l_linestatus)) AS k, min(l_discount) AS disc FROM lineitem GROUP BY 1, 2, 3),
raw_edges AS (SELECT l_orderkey, l_linenumber, l_partkey, k, disc, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS nxt FROM lines),
edge AS (SELECT CAST(l_partkey AS VARCHAR) AS src_id, CAST(nxt AS VARCHAR) AS dst_id, {_case("k", _EDGES, "tests")} AS kind, round(1 - disc, 4) AS confidence,
  CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE concat('f', l_orderkey % 50, '.py') END AS site_path, CAST(l_orderkey // 50 AS INTEGER) AS site_start_line, CAST(l_linenumber AS INTEGER) AS site_start_char
  FROM raw_edges WHERE nxt IS NOT NULL),
ranks AS (SELECT dst_id AS symbol_id, round(count(*) / (SELECT count(*) FROM edge), 9) AS score FROM edge GROUP BY dst_id)
"""


class Tables:
    """Lazy readers of the driver's tables, and the relations made of them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def symbols(self) -> DataFrame:
        key = F.col("p_partkey")
        name = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
        up = F.floor(key / 2).cast("long")
        kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv]), F.col("p_type")), F.lit("unknown"))
        start = (key % 1000).cast("int")
        return self["part"].select(
            key.cast("string").alias("id"),
            name.alias("name"),
            F.concat("p_brand", F.lit("/"), "p_type", F.lit(".py")).alias("path"),
            kind.alias("kind"),
            F.concat("p_brand", F.lit("."), name).alias("qualified_name"),
            F.when(up > 0, up.cast("string")).alias("container_id"),
            F.concat(F.when(key % 5 == 0, "private ").otherwise(""), F.lit("def "), name, F.lit("()")).alias("signature"),
            F.lit(None).cast("string").alias("documentation"),
            (F.col("p_size") % 10 == 0).alias("is_local"),
            (key % 97 == 0).alias("is_synthetic"),
            start.alias("name_start_line"),
            F.lit(0).alias("name_start_char"),
            start.alias("name_end_line"),
            F.lit(9).alias("name_end_char"),
            start.alias("full_start_line"),
            (start + F.col("p_size")).cast("int").alias("full_end_line"),
        )

    @property
    def edges(self) -> DataFrame:
        from pyspark.sql import Window as W

        lines = self["lineitem"].groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.min(F.concat("l_returnflag", "l_linestatus")).alias("k"), F.min("l_discount").alias("disc"))
        nxt = F.lead("l_partkey").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
        kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _EDGES.items() for x in kv]), F.col("k")), F.lit("tests"))
        order = F.col("l_orderkey")
        return lines.withColumn("nxt", nxt).filter("nxt is not null").select(
            F.col("l_partkey").cast("string").alias("src_id"),
            F.col("nxt").cast("string").alias("dst_id"),
            kind.alias("kind"),
            F.round(1 - F.col("disc"), 4).alias("confidence"),
            F.when(order % 9 != 0, F.concat(F.lit("f"), (order % 50).cast("string"), F.lit(".py"))).alias("site_path"),
            F.floor(order / 50).cast("int").alias("site_start_line"),
            F.col("l_linenumber").cast("int").alias("site_start_char"),
        )

    @property
    def ranks(self) -> DataFrame:
        edges = self.edges
        total = edges.agg(F.count("*").alias("total"))
        counted = edges.groupBy(F.col("dst_id").alias("symbol_id")).agg(F.count("*").alias("n"))
        return counted.crossJoin(F.broadcast(total)).select("symbol_id", F.round(F.col("n") / F.col("total"), 9).alias("score"))  # one row of totals


def query(sql: str | None = None, name: str | None = None, prelude: str | None = RELATIONS) -> Callable[[Query], Query]:
    """Register a query; sql: a SELECT over the prelude's relations, or None where SQL cannot say it."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            text = sql.strip()
            recursive = text.startswith("RECURSIVE")
            text = text.removeprefix("RECURSIVE").strip()
            if prelude:
                head = f"WITH {'RECURSIVE ' if recursive else ''}{prelude.strip()}"
                text = f"{head},\n{text[5:]}" if text.startswith("WITH ") else f"{head}\n{text}"
            ORACLES[key] = text
        return f

    return add


def rounded(column: str, digits: int = 9):
    return F.round(column, digits).alias(column)
