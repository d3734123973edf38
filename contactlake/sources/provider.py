"""Stored provider data: response files and request batches.

Responses saved as JSON (one object per line with ``batch_id`` and the
provider's ``matches`` array) are read with a declared schema. Match *i*
of a batch belongs to request *i*, so responses are zipped to requests by a
join on ``(batch_id, pos)`` -- ``posexplode_outer`` numbers the matches. A
missing or null match leaves the request unmatched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.provider import ORG_SCHEMA, PERSON_SCHEMA


def response_schema(kind: str) -> T.StructType:
    match = PERSON_SCHEMA if kind == "people" else ORG_SCHEMA
    return T.StructType([T.StructField("batch_id", T.LongType()),
                         T.StructField("matches", T.ArrayType(match))])


def read_responses(spark: SparkSession, path: str, kind: str = "people") -> DataFrame:
    """``(batch_id, pos, match)`` from JSON-lines response files."""
    raw = spark.read.schema(response_schema(kind)).json(path)
    return raw.select("batch_id", F.posexplode_outer("matches").alias("pos", "match")) \
        .where(F.col("pos").isNotNull())


def zip_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests ``(_row_id, batch_id, pos, ...)`` left-joined with their match
    by batch and position (both keys unique per request: no skew)."""
    return requests.join(responses, ["batch_id", "pos"], "left")


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Stored pages ``(page_id, url, html)``; a failed fetch is a NULL html."""
    df = spark.read.format(fmt).load(path)
    return df.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
