"""What the corpus operators share: the shared folder, batch limits, chunked Arrow access to texts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; temporaries are a small multiple of it.
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where the setting is missing a local master gets a temporary folder of its own (tests); any
    other master is refused, as its executors would not see a folder of the driver.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="symloom-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Cuts the lineage: executors that are lost later cost no more than the tasks that read the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/symloom/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(table: DataFrame) -> None:
    """Delete a table that `cut` wrote and that nothing reads any more; only such tables are touched."""
    spark = table.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if "/symloom/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def limit_batches(spark: SparkSession, rows: int = 1000, mb: int = 16) -> None:
    """Bound what a Python worker gets at once, by rows and by bytes: texts can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text (null: the empty text), modulo n."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % F.lit(n)


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary or string array without copying; null rows are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type)
    kind = np.dtype(np.int64 if wide else np.int32)
    _, offsets, data = array.buffers()
    if offsets is None or len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    at = np.frombuffer(offsets, kind, len(array) + 1, array.offset * kind.itemsize).astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def chunks(array: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `most` bytes; a longer row is a run alone."""
    body, at = buffers(array)
    i, n = 0, len(array)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        j = min(j, n)
        yield i, j, body[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words64(body: np.ndarray) -> np.ndarray:
    """The little-endian 8-byte word that starts at each byte; the end is padded with zeros."""
    padded = np.zeros(len(body) + 8, np.uint8)
    padded[: len(body)] = body
    return np.ndarray((len(body),), dtype="<u8", buffer=padded.data, strides=(1,))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet") if "://" not in sf_dir else f"{sf_dir}/{name}.parquet")
