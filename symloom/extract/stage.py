"""The extraction stage: (path, language, content) -> rows of every relation, one pass over the files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import FILES, SYMBOLS
from .registry import extract_source

_INT, _STR = T.IntegerType(), T.StringType()
_SPAN = [T.StructField(f"{end}_{axis}", _INT) for end in ("start", "end") for axis in ("line", "char")]
_SYMBOL = T.StructType([f for f in SYMBOLS.fields if f.name not in ("path", "language")])
_REF = T.StructType([T.StructField("name", _STR), T.StructField("kind", _STR), T.StructField("container_id", _STR), *_SPAN, T.StructField("receiver", _STR), T.StructField("receiver_type", _STR)])
_BINDING = T.StructType([T.StructField("ordinal", _INT), T.StructField("local", _STR), T.StructField("original", _STR), *_SPAN])
_IMPORT = T.StructType([T.StructField("module", _STR), T.StructField("relative_level", _INT), *_SPAN, T.StructField("bindings", T.ArrayType(_BINDING))])
EXTRACTED = T.StructType(
    [
        T.StructField("path", _STR), T.StructField("digest", _STR), T.StructField("error_count", _INT), T.StructField("namespace", _STR), T.StructField("failure", _STR),
        T.StructField("symbols", T.ArrayType(_SYMBOL)), T.StructField("refs", T.ArrayType(_REF)), T.StructField("imports", T.ArrayType(_IMPORT)),
    ]
)


def content_digest(content: bytes) -> str:
    import hashlib

    return hashlib.blake2b(content, digest_size=16).hexdigest()


@F.pandas_udf(_STR)
def digest_udf(content: pd.Series) -> pd.Series:
    return content.map(lambda c: content_digest(bytes(c)))


def _ordered(kind: T.StructType, row: dict) -> dict:
    return {f.name: row.get(f.name) for f in kind.fields}


def extract(contents: DataFrame) -> DataFrame:
    """A row a file; one that fails has the failure and no symbols, and never ends the others."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, language, content in zip(f["path"], f["language"], f["content"]):
                body = bytes(content)
                try:
                    x = extract_source(path, body, language)
                    rows.append((path, content_digest(body), x.errors, x.namespace, None, [_ordered(_SYMBOL, s) for s in x.symbols], [_ordered(_REF, r) for r in x.refs], [_ordered(_IMPORT, i) for i in x.imports]))
                except Exception as e:  # noqa: BLE001  a file may hold anything
                    rows.append((path, content_digest(body), 1, None, f"{type(e).__name__}: {e}", [], [], []))
            yield pd.DataFrame(rows, columns=EXTRACTED.names)

    return contents.select("path", "language", "content").mapInPandas(run, EXTRACTED)


def module_symbols(files: DataFrame) -> DataFrame:
    """The stand-in of each file: what its top-level uses come from, and what imports of the file lead to."""
    zero = F.lit(0)
    name = F.element_at(F.split("path", "/"), -1)
    spans = [zero.alias(f"{w}_{end}_{axis}") for w in ("name", "full") for end in ("start", "end") for axis in ("line", "char")]
    null = F.lit(None).cast("string")
    row = files.select(F.concat("path", F.lit("#<module>")).alias("id"), "path", name.alias("name"), F.lit("module").alias("kind"), null.alias("qualified_name"), null.alias("container_id"), null.alias("language"), null.alias("signature"), null.alias("documentation"), F.lit(False).alias("is_local"), F.lit(True).alias("is_synthetic"), *spans)
    return row.select(*SYMBOLS.names)


def relations(extracted: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """files, symbols, refs, imports and import_bindings of extracted files (a table that has been written)."""
    table = extracted.join(files.select("path", "language", "size", "mtime_ns"), "path")
    out = {"files": table.select("path", "language", "digest", "size", "mtime_ns", (F.col("error_count") > 0).alias("has_errors"), "error_count", "namespace").select(*FILES.names)}
    own = extracted.select("path", F.explode("symbols").alias("x")).select("path", "x.*").withColumn("language", F.lit(None).cast("string"))
    out["symbols"] = own.select(*SYMBOLS.names).unionByName(module_symbols(out["files"]))
    out["refs"] = extracted.select("path", F.explode("refs").alias("x")).select("path", "x.*")
    numbered = extracted.select("path", F.posexplode("imports").alias("id", "x")).withColumn("id", F.col("id").cast("long"))
    out["imports"] = numbered.select("id", "path", "x.module", "x.relative_level", *[f"x.{f.name}" for f in _SPAN])
    out["import_bindings"] = numbered.select(F.col("id").alias("import_id"), "path", F.explode("x.bindings").alias("b")).select("import_id", "path", "b.*")
    return out


def language_stats(files: DataFrame, symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """By language: files, symbols, references, files with errors, errors and their rate."""
    s = symbols.filter(~F.col("is_synthetic")).groupBy("path").agg(F.count("*").alias("symbols"))
    r = refs.groupBy("path").agg(F.count("*").alias("refs"))
    every = files.join(s, "path", "left").join(r, "path", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = every.groupBy("language").agg(F.count("*").alias("files"), total("symbols").alias("symbols"), total("refs").alias("refs"), F.count(F.when(F.col("has_errors"), 1)).alias("error_files"), total("error_count").alias("errors"))
    return out.withColumn("error_rate", F.col("error_files") / F.col("files"))
