"""The truth table as Parquet in e-mail buckets, kept by Spark's own writer.

Rows live in folders ``_buckets=<B>/_bucket=<b>/`` with b =
``pmod(xxhash64(email), B)``. An upsert reads the buckets that its e-mails
fall into (a partition filter) and writes these back with dynamic partition
overwrite: the other folders aren't touched. Spark writes the new files beside
the table and exchanges folders when the job commits, so a lost executor or a
failed job changes nothing. There is no log beside the data. Folders are
exchanged one after another: a driver that dies in between leaves some of a
batch's buckets new and some old, and applying the batch again makes it whole,
since an upsert skips what is there already. One writer at a time.

``B`` is part of the path, so a table keeps the number that it was made with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators.columns import qcol

BUCKET = "_bucket"
BUCKETS = "_buckets"
DEFAULT_BUCKETS = 64
#: Parquet's own Bloom filter on the e-mail: a lookup of one that isn't there reads no row group. Values are unique,
#: so a dictionary would only take room.
EMAIL_FILTER = {f"parquet.bloom.filter.enabled#{S.EMAIL}": "true", f"parquet.enable.dictionary#{S.EMAIL}": "false"}


def empty_truth(spark: SparkSession, extra_columns: list[str] | None = None) -> DataFrame:
    """Empty table with the 23 base columns (plus any extra text columns)."""
    return spark.createDataFrame([], S.truth_schema(extra_columns))


def bucket_of(email: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(email), F.lit(buckets)).cast("int")


class TruthStore:
    """Choose ``buckets`` so that one bucket is a sensible rewrite unit (a few GB): about table size / 5 GB."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = DEFAULT_BUCKETS) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.buckets = self._made_with() or buckets

    def _made_with(self) -> int | None:
        """The bucket count in the table's path; None where there is no table yet."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{BUCKETS}=*/{BUCKET}=*")
        found = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
        return int(found[0].getPath().getParent().getName().split("=")[1]) if found else None

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The table, optionally only some buckets; the empty base table before the first commit."""
        if self._made_with() is None:
            return empty_truth(self.spark)
        rows = self.spark.read.option("mergeSchema", "true").parquet(self.root)
        if buckets is not None:
            rows = rows.where(F.col(BUCKET).isin(buckets))
        return rows.drop(BUCKETS, BUCKET)

    def max_sn(self) -> int | None:
        """Highest serial number: one column is read."""
        return self.read().agg(F.max(qcol(S.SN))).first()[0]

    def touched_buckets(self, batch: DataFrame) -> list[int]:
        """Buckets of the e-mails in ``batch`` (at most ``buckets`` values)."""
        rows = batch.select(bucket_of(qcol(S.EMAIL), self.buckets).alias("b")).distinct().collect()
        return sorted(int(r["b"]) for r in rows if r["b"] is not None)

    def lookup(self, email: str) -> DataFrame:
        """Point lookup: the folder of the e-mail's bucket, in it the row groups that its Bloom filter leaves."""
        b = self.spark.range(1).select(bucket_of(F.lit(email), self.buckets)).first()[0]
        return self.read(buckets=[int(b)]).where(qcol(S.EMAIL) == F.lit(email)).limit(1)

    def commit(self, state: DataFrame, buckets: list[int] | None = None) -> None:
        """Replace the listed buckets by the rows of ``state``, which fall into them only.

        ``buckets=None``: ``state`` is the whole table and replaces what is
        there, which it must not be read from. Rows are ordered by e-mail
        inside a bucket's files.
        """
        spread_over = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        salts = max(1, spread_over // (self.buckets if buckets is None else max(1, len(buckets))))
        salt = F.pmod(F.xxhash64(qcol(S.EMAIL), F.lit("salt")), F.lit(salts))
        out = state.withColumn(BUCKETS, F.lit(self.buckets)).withColumn(BUCKET, bucket_of(qcol(S.EMAIL), self.buckets))
        # e-mails are unique, so buckets are even; the salt keeps one bucket off one task
        (out.repartition(spread_over, BUCKET, salt).sortWithinPartitions(BUCKET, qcol(S.EMAIL))
         .write.options(**EMAIL_FILTER).option("partitionOverwriteMode", "static" if buckets is None else "dynamic")
         .mode("overwrite").partitionBy(BUCKETS, BUCKET).parquet(self.root))
