"""The corpus pipeline: documents go through STAGES in order, each stage written and read again.

toxicity        drops documents that the positive-unlabelled classifier rejects
near_duplicates keeps, of each component of documents with similarity 0.8 or more (sets of 5-word
                shingles), the document of the smallest doc_id
decontaminate   drops documents that hold a whole window (8 words) of a benchmark item, or that
                operator 4 calls contaminated (windows of two items, shorter ones included)
secrets         replaces found secrets in the texts; keeps every document
mix             gives every document its slot in the mix of sources by target weights

All stages but the last return the columns of documents, extra ones included, whatever their names
are: a stage packs the row while it adds columns of its own. The last adds mix_*, in place of columns
of those names.

Defined cases. Null and empty texts: scored, linked with each other, never contaminated, without
secrets. Very long texts are one piece of work. Repeated rows: judged alike; near_duplicates leaves
one. A null doc_id: kept by near_duplicates only where no document of its component has an id, and
never learnt from. Ties: by doc_id, then by a hash of the text. An empty table passes through empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm import decontaminate, mixing, secrets, simhash, toxicity
from symloom.llm._common import read_table, remainder, shared_dir, text_bytes

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the stage's own input and the labels that may be learnt from."""
    p = toxicity.ToxicityParams()
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 4) != 2, p)
    score = toxicity.scorer(spark, model)
    scored = docs.select(F.struct("*").alias("row"), score(text_bytes(F.col("text"))).alias("score"))
    return scored.filter(F.col("score") < p.threshold).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs, size=5, similarity=(4, 5))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A whole window of 8 words is a leak here, of however few items; so is what operator 4 calls contaminated."""
    window, items = 8, 2
    mark = decontaminate.marker(spark, read_table(spark, sf_dir, "benchmark"), window)
    found = docs.select(F.struct("*").alias("row"), mark(text_bytes(F.col("text"))).alias("mark"))
    leaks = (F.col("mark.longest") >= window) | (F.size("mark.items") >= items)
    return found.filter(~leaks).select("row.*")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("secrets", without_secrets),
    ("mix", mixed),
]

#: The first stage is a trained classifier, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/symloom/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = f"{folder}/{i}-{name}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
