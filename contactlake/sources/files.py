"""Contact files (CSV, JSON lines, Parquet, xlsx) as all-text DataFrames
with an input-order key ``_row_id`` (file path order, then row order)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.keys import with_index
from ..session import checkpoint_dir
from .csv_records import read_csv
from .workbook import read_workbooks

_LOCAL = "__local"


def _all_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col("`" + f.name + "`").cast("string").alias(f.name)
                       if not isinstance(f.dataType, T.StringType) else F.col("`" + f.name + "`")
                       for f in df.schema.fields])


def with_input_order(df: DataFrame) -> DataFrame:
    """Add ``_row_id``: dense position by (file path, split start, row in
    split).

    The rows are read once and checkpointed with their file, split and local
    position; counts and positions both come from that copy, so a split plan
    that differs between two scans can't lose rows. Rows of a split are read
    contiguously by one task: a row's position is its split's offset plus its
    local id less the split's first one. Offsets are a running sum over one
    small row per split. Needs the file-source ``_metadata`` column: call it
    on a freshly read frame.
    """
    checkpoint_dir(df.sparkSession)
    keyed = df.select("*", F.col("_metadata.file_path").alias("__path"),
                      F.col("_metadata.file_block_start").alias("__block"),
                      F.monotonically_increasing_id().alias(_LOCAL)).checkpoint(eager=True)
    before = Window.orderBy("__path", "__block").rowsBetween(Window.unboundedPreceding, -1)
    splits = keyed.groupBy("__path", "__block").agg(F.count(F.lit(1)).alias("n"), F.min(_LOCAL).alias("lo"))
    delta = splits.select(F.col("__path").alias("__p"), F.col("__block").alias("__b"),
                          (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("lo")).alias("__delta"))
    out = keyed.join(delta, (F.col("__path") == F.col("__p")) & (F.col("__block") == F.col("__b")))
    return out.withColumn("_row_id", F.col(_LOCAL) + F.col("__delta")).drop(
        "__path", "__block", "__p", "__b", _LOCAL, "__delta")


def read_contacts(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Read contact rows as text columns plus ``_row_id``.

    ``fmt``: ``csv`` (header row, every column text; read by all splits, see
    ``csv_records``), ``json`` (JSON lines), ``parquet`` or ``xlsx``; guessed from the extension when None.
    Header mapping and normalisation are separate steps.
    """
    fmt = (fmt or path.rsplit(".", 1)[-1]).lower()
    if fmt in ("xlsx", "excel"):
        return read_workbooks(spark, path, **options).frame.drop("_file")
    if fmt == "csv":
        df, order = read_csv(spark, path, {k: str(v) for k, v in options.items()})
        if order is not None:
            return with_index(df, order, "_row_id").drop("__place")
    elif fmt == "json":
        df = spark.read.options(**options).json(path)
    elif fmt == "parquet":
        df = spark.read.options(**options).parquet(path)
    else:
        raise ValueError(f"unsupported format: {fmt}")
    return _all_text(with_input_order(df)).withColumn("_row_id", F.col("_row_id").cast("long"))
