"""Deterministic contact-shaped inputs derived from the benchmark tables.

There is no contact table among the given tables, so contact rows are
derived from ``customer`` / ``nation`` / ``region`` (and update records from
``orders``) by plain SQL that Spark and DuckDB both run unchanged: the
``{name}`` placeholders become DataFrames on the Spark side and table names
on the DuckDB side. Every row of the source tables is used; the modulo
expressions only decide which fields are blank, padded or malformed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _k(m: int, r: int = 0) -> str:
    return f"c.c_custkey % {m} = {r}"


# Raw contact sheet: simple column names here; the Spark side renames them
# to the sheet headers in RAW_HEADERS. Rows with c_custkey % 97 = 0 are
# entirely empty.
RAW_CONTACTS_SQL = f"""
SELECT
  c.c_custkey AS _row_id,
  CAST(c.c_custkey AS STRING) AS unnamed0,
  CASE WHEN {_k(97)} THEN NULL
       WHEN {_k(17)} THEN ''
       WHEN {_k(19)} THEN NULL
       WHEN {_k(23)} THEN 'user' || CAST(c.c_custkey AS STRING) || '@invalid'
       ELSE (CASE WHEN {_k(5)} THEN '  ' ELSE '' END) || 'user'
            || CAST(c.c_custkey - c.c_custkey % 3 AS STRING) || '@example.com'
            || (CASE WHEN {_k(7)} THEN ' ' ELSE '' END)
  END AS email,
  CASE WHEN {_k(97)} OR {_k(11)} THEN NULL
       ELSE '  Ann' || CAST(c.c_custkey % 40 AS STRING) END AS fname,
  CASE WHEN {_k(97)} THEN NULL ELSE 'smith-' || lower(n.n_name) || ' ' END AS lname,
  CASE WHEN {_k(97)} OR {_k(13)} THEN NULL
       ELSE lower(c.c_mktsegment) || '  & co'
            || (CASE WHEN {_k(4)} THEN ' inc.' ELSE '' END) END AS organization,
  CASE WHEN {_k(97)} THEN NULL
       WHEN {_k(9)} THEN ''
       WHEN {_k(9, 1)} THEN NULL
       WHEN {_k(9, 2)} THEN 'WWW.' || lower(c.c_mktsegment) || '.example.com'
       WHEN {_k(9, 3)} THEN 'http://www.' || lower(c.c_mktsegment) || '.example.com:8080/about?x=1'
       WHEN {_k(9, 4)} THEN 'www.' || lower(c.c_mktsegment) || CAST(c.c_nationkey AS STRING) || '.example.net'
       ELSE 'https://' || lower(c.c_mktsegment) || CAST(c.c_nationkey AS STRING)
            || '.example.org/contact#team' END AS website,
  CASE WHEN {_k(97)} THEN NULL WHEN {_k(6)} THEN ''
       ELSE ' Buyer ' || CAST(c.c_custkey % 10 AS STRING) END AS title,
  CASE WHEN {_k(97)} THEN NULL
       ELSE '+1 (' || lpad(CAST(c.c_nationkey AS STRING), 3, '0') || ') 555-'
            || lpad(CAST(c.c_custkey % 10000 AS STRING), 4, '0') END AS phone,
  CASE WHEN {_k(97)} THEN NULL ELSE n.n_name END AS country,
  CASE WHEN {_k(97)} THEN NULL ELSE r.r_name END AS region,
  CASE WHEN {_k(97)} THEN NULL WHEN {_k(10)} THEN 'Yes' WHEN {_k(10, 1)} THEN ''
       ELSE 'No' END AS email_send,
  CASE WHEN {_k(97)} THEN NULL ELSE c.c_mktsegment END AS client_type
FROM {{customer}} c
JOIN {{nation}} n ON c.c_nationkey = n.n_nationkey
JOIN {{region}} r ON n.n_regionkey = r.r_regionkey
"""

RAW_HEADERS = {
    "_row_id": "_row_id",
    "unnamed0": "Unnamed: 0",
    "email": "E-mail",
    "fname": "fname",
    "lname": "Last_Name",
    "organization": "Organisation",
    "website": "Website URL",
    "title": "Designation",
    "phone": "Mobile",
    "country": "Nation",
    "region": "Province",
    "email_send": "Email Send (Yes/No)",
    "client_type": "Client Type",
}

# Update records from orders: one per order, e-mail of the ordering
# customer's contact, fields filled or blank depending on the order.
INCOMING_SQL = """
SELECT
  o.o_orderkey AS _row_id,
  'user' || CAST(o.o_custkey - o.o_custkey % 3 AS STRING) || '@example.com' AS email,
  CASE WHEN o.o_orderkey % 4 = 0 THEN 'Ann' || CAST(o.o_custkey % 40 AS STRING) ELSE '' END AS fname,
  CASE WHEN o.o_orderstatus = 'F' THEN 'Buyer ' || o.o_orderpriority ELSE '' END AS title,
  CASE WHEN o.o_orderkey % 5 = 0 THEN 'Tier ' || o.o_orderstatus ELSE '' END AS industry,
  CASE WHEN o.o_orderkey % 6 = 0 THEN CAST(o.o_orderkey % 1000 AS STRING) ELSE '' END AS employees,
  CASE WHEN o.o_orderkey % 7 = 0 THEN 'P-' || o.o_orderpriority ELSE '' END AS seniority,
  CASE WHEN o.o_orderkey % 8 = 0 THEN 'Yes' ELSE 'No' END AS email_send
FROM {orders} o
"""


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all tasks by a hash of ``key``, before work that is heavy for each row.

    A scan has as many splits as the file has bytes, but only those with the
    start of a row group get rows: a table of one group is read by one task.
    The number of parts grows with the splits, so their size is bounded.
    """
    parts = max(2 * df.sparkSession.sparkContext.defaultParallelism, 8 * df.rdd.getNumPartitions())
    return df.repartition(parts, key)


def spark_sql(spark: SparkSession, sf_dir: str, sql: str, names: list[str], keys: dict[str, str] | None = None) -> DataFrame:
    """Run shared SQL on Spark with the placeholders bound to the tables; those with a key in ``keys`` are dealt by it."""
    tables = {n: read_table(spark, sf_dir, n) for n in names}
    return spark.sql(sql, **{n: dealt(t, keys[n]) if n in (keys or {}) else t for n, t in tables.items()})


def duck_sql(sql: str) -> str:
    """The same shared SQL for DuckDB (placeholders -> registered views)."""
    return sql.replace("{{", "\x00").replace("}}", "\x01").format(
        **{n: n for n in TABLES}).replace("\x00", "{").replace("\x01", "}")


def raw_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark_sql(spark, sf_dir, RAW_CONTACTS_SQL, ["customer", "nation", "region"], {"customer": "c_custkey"})
    return df.toDF(*[RAW_HEADERS[c] for c in df.columns])


def incoming_updates(spark: SparkSession, sf_dir: str, prefixes=None) -> DataFrame:
    from .. import schema as S

    p = prefixes or S.DEFAULT_PREFIXES
    df = spark_sql(spark, sf_dir, INCOMING_SQL, ["orders"], {"orders": "o_orderkey"})
    names = {"_row_id": "_row_id", "email": S.EMAIL, "fname": S.FIRST, "title": S.TITLE,
             "industry": S.INDUSTRY, "employees": S.EMPLOYEES,
             "seniority": p.person + "Seniority", "email_send": S.EMAIL_SEND}
    return df.toDF(*[names[c] for c in df.columns])
