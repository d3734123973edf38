"""CSV read over all splits of a file, also where quoted fields hold line breaks.

Spark's line-wise CSV reader cuts a file into splits; its multi-line reader
takes a whole file in one task. Which lines end a record follows from quotes
alone: a quote inside a quoted field is doubled, so a line break is inside
quotes exactly where an odd number of quotes stands before it. So the file is
read as lines over all splits, and

* if no line has an odd number of quotes, no record spans lines: the line-wise
  reader gives the same rows and is used;
* otherwise quotes are summed up: in each split line by line as it is read,
  and over the splits by a running sum of one row a split. A line before which
  the sum is even starts a record. Records of one line stay where they are; the
  lines of the others are joined by a shuffle into parts of about ``PART``
  lines, and each record is parsed by itself. No task sorts or holds a split.

Only lines of records that span lines move. A file whose quotes don't pair up
ends in one long record, as it does in the multi-line reader.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir, ship_package

QUOTE = '"'
#: Lines of records that span lines, in one part of their shuffle.
PART = 1 << 18
#: Options that change where records end, beyond what counting quotes can tell.
_OTHER_RULES = {"quote", "escape", "multiLine", "lineSep", "encoding", "charset", "comment", "charToEscapeQuoteEscaping"}


def n_quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(QUOTE), F.lit("")))


def spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether a record of the CSV files at ``path`` has a line break: one pass over the lines of all splits."""
    return not spark.read.text(path).where(n_quotes(F.col("value")) % 2 == 1).isEmpty()


def _counted(batches):
    """Lines in the order of their splits, with what stands before each in its split: ``odd``, whether the number of
    quotes is odd; ``even``, how many lines up to this one have an even number; ``line``, how many lines there are."""
    last, quotes, evens, count = None, 0, 0, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        path, block, q = batch.column(0), batch.column(1), batch.column(4).to_numpy()
        new = np.zeros(n, bool)
        new[0] = (path[0].as_py(), block[0].as_py()) != last
        for x in (path, block):
            new[1:] |= pc.not_equal(x.slice(1), x.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        at = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # where each line's split begins, -1 in an earlier batch
        inside = np.maximum(at, 0)
        before = np.cumsum(q) - q
        odd = (before - before[inside] + np.where(at < 0, quotes, 0)) % 2
        even = np.cumsum(odd == 0)
        even = even - (even - (odd == 0))[inside] + np.where(at < 0, evens, 0)
        line = np.arange(n) - inside + 1 + np.where(at < 0, count, 0)
        last = (path[n - 1].as_py(), block[n - 1].as_py())
        quotes, evens, count = int(odd[-1] + q[-1]) % 2, int(even[-1]), int(line[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(odd.astype(np.int32)), pa.array(even.astype(np.int64)), pa.array(line.astype(np.int64))],
                                         names=["path", "block", "at", "value", "q", "odd", "even", "line"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """path, block, at, value: each record's text, with the file, split and place of its first line."""
    checkpoint_dir(spark)
    ship_package(spark)
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value", n_quotes(F.col("value")).alias("q"))
    placed = lines.mapInArrow(_counted, "path string, block long, at long, value string, q int, odd int, even long, line long").checkpoint()
    # one row a split: quotes and record starts, the latter for either state at its first line
    splits = placed.groupBy("path", "block").agg(F.sum("q").alias("q"), F.count_if(F.col("odd") == 0).alias("n0"),
                                                 F.count_if(F.col("odd") == 1).alias("n1")).checkpoint()
    n_lines = splits.agg(F.sum(F.col("n0") + F.col("n1"))).first()[0] or 0
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("open", F.coalesce(F.sum("q").over(earlier), F.lit(0)) % 2)
    starts = F.when(F.col("open") == 0, F.col("n0")).otherwise(F.col("n1"))
    splits = splits.select(F.col("path").alias("s_path"), F.col("block").alias("s_block"), "open",
                           F.coalesce(F.sum(starts).over(earlier), F.lit(0)).alias("first"))
    state = placed.join(F.broadcast(splits), (F.col("path") == F.col("s_path")) & (F.col("block") == F.col("s_block"))).withColumn(
        "odd", (F.col("odd") + F.col("open")) % 2)
    own = F.when(F.col("open") == 0, F.col("even")).otherwise(F.col("line") - F.col("even"))
    numbered = state.select("path", "block", "at", "value", (F.col("first") + own).alias("record"),
                            ((F.col("odd") == 0) & (F.col("q") % 2 == 0)).alias("alone"))
    alone = numbered.where("alone AND trim(value) <> ''").select("path", "block", "at", "value")
    parts = max(spark.sparkContext.defaultParallelism, n_lines // PART + 1)
    line = F.struct("block", "at", "value")
    joined = numbered.where("NOT alone").repartition(parts, "path", "record").groupBy("path", "record").agg(
        F.array_sort(F.collect_list(line)).alias("lines")).select(
        "path", F.col("lines")[0]["block"].alias("block"), F.col("lines")[0]["at"].alias("at"),
        F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("value"))
    return alone.unionByName(joined)


def read_csv(spark: SparkSession, path: str, options: dict[str, str]) -> tuple[DataFrame, list[Column] | None]:
    """Rows of CSV files with a header row, every column text, and the columns by which they are in input order.

    None in place of these columns: the rows come from the file source itself.
    """
    base = {"header": "true", "inferSchema": "false", "escape": QUOTE}
    if options.get("header", "true").lower() != "true" or _OTHER_RULES & set(options):
        return spark.read.options(**{"multiLine": "true", **base, **options}).csv(path), None
    if not spans_lines(spark, path):
        return spark.read.options(**{**base, **options}).csv(path), None
    names = spark.read.options(**{"multiLine": "true", **base, **options}).csv(path).columns  # reads the header only
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    found = records(spark, path).checkpoint()
    heads = found.groupBy("path").agg(F.min(F.struct("block", "at")).alias("head")).select(
        F.col("path").alias("h_path"), F.col("head.block").alias("h_block"), F.col("head.at").alias("h_at"))
    rows = found.join(F.broadcast(heads), (F.col("path") == F.col("h_path")) & (F.col("block") == F.col("h_block"))
                      & (F.col("at") == F.col("h_at")), "left_anti")
    parser = {k: v for k, v in {**base, **options}.items() if k not in ("header", "inferSchema")}
    parsed = rows.select(F.from_csv("value", schema.toDDL(), parser).alias("row"), F.struct("path", "block", "at").alias("__place"))
    return parsed.select("row.*", "__place"), [F.col("__place")]
