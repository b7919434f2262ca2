"""What several of the text operators need: Arrow access, cut points and hashing."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.recovery import cut, shared_dir

__all__ = ["NO_ID", "U64", "cut", "cut_few", "id_and_text", "id_array", "ids_of", "mixed", "partitions", "release", "remove", "shared_dir", "slices", "utf8"]

#: Stands for a null id where ids are held as 64-bit integers.
NO_ID = np.iinfo(np.int64).max

U64 = np.uint64


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle and checkpoint files of frames that nothing refers to any more.

    The cleaner acts when the driver collects its garbage, which a small driver of a large job seldom does.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut_few(df: DataFrame) -> DataFrame:
    """``cut`` for a frame that is small beside the input: dealt anew to a quarter of the partitions, but for 8, so that fewer files are written.

    On a local file system without Hadoop's native library, an executor starts four processes (``chmod``) for each file of a cut.
    """
    n = partitions(df.sparkSession)
    return cut(df.repartition(max(8, n // 4)) if n > 8 else df)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, whatever else the table has: the id as long and the text, a null text being empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ids_of(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(column, int(NO_ID)), dtype=np.int64)


def id_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], rows: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows and about ``size`` bytes; one row may be larger."""
    for batch in batches:
        step = max(1, min(rows, int(batch.num_rows * size / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two xor-multiply rounds)."""
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))
