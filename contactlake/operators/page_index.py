"""Deep pages by an order-statistics index over ``S.N.``.

The table is kept once more in page order: in ranges of ``width`` consecutive
serial numbers each, ordered inside. Neighbouring ranges share a Parquet folder
as soon as there are more than ``FOLDERS`` of them, so that the number of files
doesn't grow with the table. The index is a count per range. Running sums over
these counts (one row a range) say in which ranges rows ``offset + 1 ..
offset + limit`` lie; only their folders are opened, of these only the pages
that hold such a range, and the offset left inside them is smaller than the
first range's count. So a page costs the same wherever it is, and no task holds
more than a few ranges.

For a filter, its matches are counted per range once (``counts``); further
pages of the same filter use the same counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from .columns import qcol
from .search import apply_filters, check_page_args

RANGE = "_range"
FOLDER = "_folder"
WIDTH = 100_000
#: About the most folders of a table.
FOLDERS = 1_000


class PageIndex:
    def __init__(self, spark: SparkSession, path: str, width: int = WIDTH) -> None:
        self.spark, self.path, self.width = spark, path.rstrip("/"), width

    def build(self, table: DataFrame) -> PageIndex:
        """Write the table in page order and the count of each range. A null ``S.N.`` comes first, as in a sort."""
        sn = qcol(S.SN)
        ranged = table.withColumn(RANGE, F.coalesce(F.floor(sn / self.width), F.lit(-1)).cast("long"))
        low, high = ranged.agg(F.min(RANGE), F.max(RANGE)).first()
        together = 1 if low is None else (high - low) // FOLDERS + 1
        placed = ranged.withColumn(FOLDER, F.floor(F.col(RANGE) / F.lit(together)).cast("long"))
        placed.repartitionByRange(FOLDER, RANGE, sn).sortWithinPartitions(FOLDER, RANGE, sn).write.mode(
            "overwrite").partitionBy(FOLDER).parquet(f"{self.path}/rows")
        self.counts().write.mode("overwrite").parquet(f"{self.path}/counts")
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def counts(self, filters: dict[str, str] | None = None, case_sensitive: bool = False) -> DataFrame:
        """Matches per range: (_folder, _range, n)."""
        return apply_filters(self.rows(), filters, case_sensitive).groupBy(FOLDER, RANGE).agg(F.count(F.lit(1)).alias("n"))

    def stored_counts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/counts")

    def total(self, counts: DataFrame | None = None) -> int:
        return (self.stored_counts() if counts is None else counts).agg(F.sum("n")).first()[0] or 0

    def _places(self, limit: int, offset: int, counts: DataFrame | None) -> list[Row]:
        counts = self.stored_counts() if counts is None else counts
        run = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0)))
        return placed.where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)).orderBy(RANGE).collect()

    def folders(self, limit: int, offset: int, counts: DataFrame | None = None) -> tuple[list[int], int]:
        """The ranges that hold the page, at most ``limit`` with a match each, and the rows to pass over in the first.

        The running sum is over one row a range.
        """
        found = self._places(limit, offset, counts)
        return [r[RANGE] for r in found], offset - found[0]["before"] if found else 0

    def page(self, limit: int = S.DEFAULT_PAGE_SIZE, offset: int = 0, filters: dict[str, str] | None = None,
             counts: DataFrame | None = None, case_sensitive: bool = False) -> DataFrame:
        """Rows ``offset + 1 .. offset + limit`` of the filtered table by ``S.N.``; none beyond its end."""
        check_page_args(limit, offset)
        if counts is None and filters:
            counts = self.counts(filters, case_sensitive)
        found = self._places(int(limit), int(offset), counts)
        rest = offset - found[0]["before"] if found else 0
        inside = F.col(FOLDER).isin(sorted({r[FOLDER] for r in found})) & F.col(RANGE).isin([r[RANGE] for r in found])
        rows = apply_filters(self.rows().where(inside), filters, case_sensitive).drop(RANGE, FOLDER)
        return rows.orderBy(qcol(S.SN).asc()).offset(rest).limit(int(limit))
