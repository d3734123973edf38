"""Order-dependent keys: dense positions, serial numbers, fixed-size batches.

A global position is computed without funnelling rows through one task:
range-partition by the order, number rows inside each partition, count the
rows per partition (one small row per partition), and add each partition's
running offset through a broadcast of those counts. The partition count
bounds the broadcast, not the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir

_MID = "__mid"
_PID = "__pid"
_OFF = "__off"


def with_index(df: DataFrame, order: list[str | Column], name: str = "_idx",
               start: int = 0) -> DataFrame:
    """Add ``name``: 0-based (plus ``start``) position of each row by ``order``.

    ``order`` must be a total order (ties get an arbitrary but stable
    numbering within this call). The range-sorted rows are checkpointed to
    the shared checkpoint folder so that the count pass and the numbering
    pass see exactly the same partitions.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    ranged = (df.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn(_MID, F.monotonically_increasing_id()))
    ranged = ranged.checkpoint(eager=True)
    pid = F.shiftright(F.col(_MID), 33)
    counts = ranged.groupBy(pid.alias(_PID)).agg(F.count(F.lit(1)).alias("n")).collect()
    offsets, running = [], start
    for row in sorted(counts, key=lambda r: r[_PID]):
        offsets.append((int(row[_PID]), running))
        running += int(row["n"])
    off_df = spark.createDataFrame(offsets or [(0, start)], f"{_PID} long, {_OFF} long")
    out = ranged.join(F.broadcast(off_df), pid == F.col(_PID), "inner")
    local = F.col(_MID) - F.shiftleft(F.col(_PID), 33)
    return out.withColumn(name, F.col(_OFF) + local).drop(_MID, _PID, _OFF)


def with_serial(df: DataFrame, order: list[str | Column], name: str, first: int) -> DataFrame:
    """Serial numbers ``first, first+1, ...`` in ``order``."""
    return with_index(df, order, name=name, start=first)


def with_batches(df: DataFrame, order: list[str | Column], size: int,
                 batch_col: str = "batch_id", pos_col: str = "pos") -> DataFrame:
    """Consecutive fixed-size batches in ``order``: ``batch_id``, ``pos``."""
    if size < 1:
        raise ValueError("batch size must be >= 1")
    idx = "__batch_idx"
    out = with_index(df, order, name=idx)
    return (out.withColumn(batch_col, F.floor(F.col(idx) / size).cast("long"))
               .withColumn(pos_col, (F.col(idx) % size).cast("long"))
               .drop(idx))
