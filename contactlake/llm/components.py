"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_shuffle, cut, released


def components(links: DataFrame) -> DataFrame:
    """(node, root) from (a, b): root is the smallest node of the component.

    Every round links the larger neighbours of each node to its smallest
    neighbour, then the smaller ones; links only ever get shorter and no more.
    Minima are partial aggregates. They are written before they are joined,
    so that both sides of a join come straight from a shuffle, and adaptive
    execution can split a large key. No side is broadcast: nothing of the links
    passes through the driver. Rounds end when
    every link leads to a root; they are about the logarithm of the longest
    path. Null nodes and links from a node to itself are left out.
    """
    down = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(
        "a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    links = cut(down(links))
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.min("a")).alias("m")))
        larger = both.where("b > a").join(by_shuffle(least), F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = cut(down(larger))
        least = cut(links.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")))
        joined = links.join(by_shuffle(least), F.col("a") == F.col("n"))
        smaller = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("n").alias("a"), F.col("m").alias("b")))
        links = cut(down(smaller))
        parents = links.select(F.col("b").alias("p")).distinct()
        released(links.sparkSession)
        if links.join(by_shuffle(parents), F.col("a") == F.col("p"), "left_semi").isEmpty():
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
