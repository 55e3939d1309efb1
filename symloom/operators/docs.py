"""Claims of documents about places in files, held against an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import symbols_at

#: A path with a known suffix between backticks, and a line or a range of lines after it.
CLAIM = r"`([A-Za-z0-9_./+-]+\.(?:php|vue|js|jsx|ts|tsx|mjs|py|blade\.php))(?::(\d+)(?:-(\d+))?)?`"
SLACK = 50


def claims(documents: DataFrame) -> DataFrame:
    """documents(document, text) -> (document, line, ordinal, path, start, end), in the order of reading; a line without an end is its own."""
    lines = documents.select("document", F.posexplode(F.split("text", r"\r?\n")).alias("line", "text"))
    group = lambda k: F.regexp_extract_all("text", F.lit(CLAIM), F.lit(k))
    found = lines.select("document", (F.col("line") + 1).alias("line"), F.posexplode(F.arrays_zip(group(1).alias("p"), group(2).alias("a"), group(3).alias("b"))).alias("ordinal", "x"))
    number = lambda c: F.when(F.col(c) != "", F.col(c).cast("int"))
    return found.select("document", "line", "ordinal", F.col("x.p").alias("path"), number("x.a").alias("start"), F.coalesce(number("x.b"), number("x.a")).alias("end"))


def claimed_files(claimed: DataFrame, files: DataFrame) -> DataFrame:
    """(path, matches): the files that a claimed path may mean: itself, else those that end with it at a folder, a bare name by the name of files.

    A file is met by its endings, so that the join is one of equal keys: as many as the path has folders.
    """
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, -k, k), "/"))
    known = files.select(F.col("path").alias("file"), F.explode(ends).alias("path"), (F.col("path")).alias("whole"))
    met = claimed.select("path").distinct().join(known.select("file", "path"), "path")
    return met.groupBy("path").agg(F.when(F.max((F.col("file") == F.col("path")).cast("int")) == 1, F.array(F.first("path"))).otherwise(F.array_sort(F.collect_set("file"))).alias("matches"))


def check_claims(claimed: DataFrame, files: DataFrame, symbols: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """Claims with status and why: ok, stale (its lines hold nothing any more), ambiguous, unindexed.

    lengths(path, lines): how long files are, where they are at hand; else a line far beyond the last
    symbol is stale. A range of three lines or more must hold or lie in some symbol.
    """
    own = claimed.join(claimed_files(claimed, files), "path", "left").withColumn("n", F.coalesce(F.size("matches"), F.lit(0))).withColumn("file", F.when(F.col("n") == 1, F.col("matches")[0]))
    real = symbols.filter("not is_synthetic")
    last = real.groupBy(F.col("path").alias("file")).agg(F.max(F.coalesce("full_end_line", "name_end_line")).alias("last"), F.array_sort(F.collect_set("name_start_line")).alias("at"))
    out = own.join(last, "file", "left")
    out = out.join(lengths.select(F.col("path").alias("file"), F.col("lines")), "file", "left") if lengths is not None else out.withColumn("lines", F.lit(None).cast("int"))
    points = out.filter("file is not null and start is not null").select(F.col("file").alias("path"), (F.col("start") - 1).alias("line"))
    covered = symbols_at(symbols, points).select(F.col("path").alias("file"), (F.col("line") + 1).alias("start"), F.lit(True).alias("covered"))
    out = out.join(covered, ["file", "start"], "left")
    inside = F.exists("at", lambda x: (x >= F.col("start") - 1) & (x <= F.col("end") - 1))
    beyond = F.when(F.col("lines").isNotNull(), F.col("start") > F.col("lines")).otherwise(F.col("start") > F.col("last") + SLACK)
    empty = (F.col("end") - F.col("start") >= 2) & ~inside & F.col("covered").isNull()
    stale = F.col("start").isNotNull() & F.col("last").isNotNull() & (beyond | empty)
    status = F.when(F.col("n") == 0, "unindexed").when(F.col("n") > 1, "ambiguous").when(stale, "stale").otherwise("ok")
    why: Column = (
        F.when(status == "unindexed", "no indexed file matches")
        .when(status == "ambiguous", F.concat_ws("", F.col("n"), F.lit(" files match: "), F.array_join(F.slice("matches", 1, 3), ", ")))
        .when(status == "stale", F.when(beyond & F.col("lines").isNotNull(), F.concat_ws("", F.col("file"), F.lit(" has "), F.col("lines"), F.lit(" line(s)"))).when(beyond, F.concat_ws("", F.lit("nothing is indexed in "), F.col("file"), F.lit(" past line "), F.col("last") + 1)).otherwise(F.concat_ws("", F.lit("nothing is declared in "), F.col("file"), F.lit(":"), F.col("start"), F.lit("-"), F.col("end"))))
    )
    return out.select("document", "line", "ordinal", "path", "start", "end", status.alias("status"), why.alias("why"))


def claim_report(checked: DataFrame) -> DataFrame:
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return checked.agg(F.count("*").alias("claims"), *[n(s) for s in ("ok", "stale", "unindexed", "ambiguous")])

