"""Predicates over half-open spans held in four columns: start line and char, end line and char."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def start(prefix: str = "", frame: str = "") -> Column:
    at = f"{frame}." if frame else ""
    return F.struct(F.col(f"{at}{prefix}start_line").alias("line"), F.col(f"{at}{prefix}start_char").alias("char"))


def end(prefix: str = "", frame: str = "") -> Column:
    at = f"{frame}." if frame else ""
    return F.struct(F.col(f"{at}{prefix}end_line").alias("line"), F.col(f"{at}{prefix}end_char").alias("char"))


def contains(outer: tuple[Column, Column], inner: tuple[Column, Column]) -> Column:
    return (outer[0] <= inner[0]) & (inner[1] <= outer[1])


def overlaps(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Empty spans overlap what they lie in."""
    empty = (a[0] == a[1]) | (b[0] == b[1])
    return F.when(empty, (a[0] <= b[1]) & (b[0] <= a[1])).otherwise((a[0] < b[1]) & (b[0] < a[1]))


def from_scip(r: Column) -> Column:
    """struct of four ints from the 3 or 4 ints of a range; null of any other length."""
    line, char = F.get(r, F.lit(0)), F.get(r, F.lit(1))
    three = F.size(r) == 3
    found = F.struct(line.alias("start_line"), char.alias("start_char"), F.when(three, line).otherwise(F.get(r, F.lit(2))).alias("end_line"), F.when(three, F.get(r, F.lit(2))).otherwise(F.get(r, F.lit(3))).alias("end_char"))
    return F.when(F.size(r).isin(3, 4), found)


def to_scip(prefix: str = "") -> Column:
    a, b, c, d = (F.col(f"{prefix}{x}") for x in ("start_line", "start_char", "end_line", "end_char"))
    return F.when(a == c, F.array(a, b, d)).otherwise(F.array(a, b, c, d))
