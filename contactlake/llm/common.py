"""Small helpers shared by the operators."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir, scratch_path, ship_package

BATCH_ROWS = 1000
WORD = r"[^\x20\x09-\x0D]+"


def ready(spark: SparkSession) -> None:
    """Ship the package to the Python workers, settle the checkpoint folder, keep Arrow batches of texts small."""
    ship_package(spark)
    checkpoint_dir(spark)
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(most)) <= BATCH_ROWS:
        spark.conf.set(most, BATCH_ROWS)


_STATE: dict = {}


def worker_state(key, make):
    """What a Python worker keeps from task to task: one operator's state at a time, so that it stays bounded."""
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = make()
    return _STATE[key]


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage cut, columns read one by one, size known."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.stored_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete the files of ``stored`` frames that nothing reads any more."""
    for df in frames:
        p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is shuffled whatever its size: nothing of it passes through the driver."""
    return df.hint("merge")


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and broadcasts of steps whose results are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; a null is an empty text."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def texts(column: pa.Array) -> list[str]:
    """Python strings of a string column; a null is an empty text."""
    return [x or "" for x in column.to_pylist()]


def slices(offsets: np.ndarray, most: int):
    """(first, last) row ranges of about ``most`` bytes each, one row at least."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix) of an unsigned array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
