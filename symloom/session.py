"""Session helpers: the shared checkpoint folder and cuts of long lineages."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a local master without one gets a temporary folder."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    found = sc.getConf().get("spark.checkpoint.dir", None)
    if not found and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="symloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint, which outlives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def apart(df: DataFrame) -> DataFrame:
    """df as a side of joins that pair rows where they lie: it grows with the input, so that it never goes through the driver to be broadcast."""
    return df.hint("merge")
