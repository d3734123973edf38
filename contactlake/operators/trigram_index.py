"""Substring search that reads only the file parts that can match.

For each file of a table and each indexed column, the trigrams of all its
lower-cased values are hashed to ``BITS`` bits and kept as bit sets (Spark's
bitmap aggregates), a few rows of 4 KB a file and column. A value that
contains the searched text contains its trigrams, so a file in which one of
them is missing has no match and isn't read. Files that are read are filtered
by the predicate itself: the result is that of the full search.

Literal runs between the wildcards ``%`` and ``_`` give the trigrams; a value
without a run of three characters reads all files.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import qcol
from .search import apply_filters

BITS = 1 << 18
GRAM = 3


def _grams(text: Column) -> Column:
    low = F.lower(text)
    places = F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - GRAM + 1))
    return F.array_distinct(F.transform(places, lambda i: F.substring(low, i, F.lit(GRAM))))


def _bit(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BITS))


class TrigramIndex:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def build(self, table: DataFrame, columns: list[str]) -> TrigramIndex:
        """Index text ``columns`` of a frame read from files (needs their ``_metadata``)."""
        values = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), qcol(c).cast("string").alias("value")) for c in columns]))
        grams = (table.select(F.col("_metadata.file_path").alias("file"), values.alias("x"))
                 .select("file", "x.column", F.explode_outer(_grams(F.col("x.value"))).alias("gram")))
        # the same gram of a file comes up in most rows: bits are made distinct before they are set
        bits = grams.select("file", "column", _bit(F.coalesce("gram", F.lit(""))).alias("bit")).distinct()
        sets = bits.groupBy("file", "column", F.bitmap_bucket_number("bit").alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("set"))
        sets.write.mode("overwrite").parquet(self.path)
        return self

    def sets(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def files(self) -> DataFrame:
        return self.sets().select("file").distinct()

    def candidates(self, filters: dict[str, str] | None) -> DataFrame:
        """The files in which every filter's trigrams occur (a case-sensitive match is one here too)."""
        left = self.files()
        for column, value in (filters or {}).items():
            wanted = self._wanted(value)
            if not wanted:
                continue
            by_bucket: dict[int, list[int]] = {}
            for bucket, place in wanted:
                by_bucket.setdefault(bucket, []).append(place)
            own = self.sets().where(F.col("column") == column)
            met = F.lit(False)
            for bucket, places in by_bucket.items():
                has = F.col("bucket") == bucket
                for place in places:
                    byte = F.conv(F.hex(F.substring("set", place // 8 + 1, 1)), 16, 10).cast("int")
                    has = has & (F.shiftright(byte, place % 8).bitwiseAND(F.lit(1)) == 1)
                met = met | has
            full = own.where(met).groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(by_bucket))
            left = left.join(full.select("file"), "file", "left_semi")
        return left

    def _wanted(self, value: str) -> list[tuple[int, int]]:
        """(bucket, place) of the bits of the literal runs' trigrams."""
        runs = [x for x in re.split("[%_]", str(value)) if len(x) >= GRAM]
        if not runs:
            return []
        bits = (self.spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in runs])).alias("run"))
                .select(F.explode(_grams(F.col("run"))).alias("gram")).select(_bit(F.col("gram")).alias("bit")).distinct())
        return [tuple(r) for r in bits.select(F.bitmap_bucket_number("bit"), F.bitmap_bit_position("bit")).collect()]

    def search(self, table: DataFrame, filters: dict[str, str] | None, case_sensitive: bool = False) -> DataFrame:
        """The rows of ``table`` (the indexed frame) that match all filters; other files aren't opened.

        The list of files is as long as the table has parts.
        """
        names = [r["file"] for r in self.candidates(filters).collect()]
        rows = table.limit(0) if not names else self.spark.read.schema(table.schema).parquet(*names)
        return apply_filters(rows, filters, case_sensitive)
