"""A ledger of provider replies, so that what was answered isn't asked again.

Replies are Parquet rows (digest, match, err) in folders by endpoint and run;
the digest is that of endpoint and request. Before a provider is called, the
distinct requests are met with the ledger by an anti join and only those
without an answer are asked; "no match" is an answer, an error is not. What the
calls bring is written before anything else reads it: the tasks that call are
the tasks that write, so a task whose output is committed is never run again,
a lost one asks for its own requests once more, and a flow that fails later
finds all replies there. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "digest string, match string, err string, endpoint string, run int"


def request_digest(endpoint: str, req: Column) -> Column:
    """Digest of a request (JSON text) to an endpoint."""
    return F.sha2(F.concat(F.lit(endpoint + "\n"), req), 256)


class ReplyLedger:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def read(self) -> DataFrame:
        """All replies: digest, match, err, endpoint, run."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.root)

    def asked(self) -> DataFrame:
        """endpoint, run, n_asked, n_failed of every run that asked something."""
        return self.read().groupBy("endpoint", "run").agg(
            F.count("*").alias("n_asked"), F.count("err").alias("n_failed"))

    def answer(self, endpoint: str, requests: DataFrame, call: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(digest, match, err) of all ``requests`` (digest, req), each digest once.

        ``call`` gets the unanswered ones and gives (digest, match, err). Runs
        at once. Errors are those of this run; a reply wins over an error.
        """
        past = self.read().where(F.col("endpoint") == endpoint)
        run = (past.agg(F.max("run")).first()[0] or 0) + 1
        answered = past.where("err IS NULL").select("digest")
        unanswered = requests.select("digest", "req").distinct().join(answered, "digest", "left_anti")
        (call(unanswered).withColumn("endpoint", F.lit(endpoint)).withColumn("run", F.lit(run))
         .write.mode("append").partitionBy("endpoint", "run").parquet(self.root))
        return (self.read().where((F.col("endpoint") == endpoint) & (F.col("err").isNull() | (F.col("run") == run)))
                .groupBy("digest").agg(F.min("match").alias("match"), F.min("err").alias("err")))
