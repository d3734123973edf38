"""Provider tables derived from the benchmark tables (one row per customer
for people, one row per segment x nation and per segment for companies).

The flat columns come from SQL that Spark and DuckDB both run; the Spark
side packs them into the provider's nested response shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.provider import ORG_SCHEMA, PERSON_SCHEMA
from .derived import spark_sql

PEOPLE_SQL = """
SELECT
  'user' || CAST(c.c_custkey AS STRING) || '@example.com' AS email,
  CASE WHEN c.c_custkey % 4 = 0 THEN '' ELSE ' P' || CAST(c.c_custkey % 100 AS STRING) || ' ' END AS first_name,
  'Lname' || CAST(c.c_nationkey AS STRING) AS last_name,
  CASE WHEN c.c_acctbal > 5000 THEN 'Director of ' || lower(c.c_mktsegment) ELSE '' END AS title,
  CASE WHEN c.c_custkey % 5 = 0 THEN 'moved' || CAST(c.c_custkey AS STRING) || '@example.org' ELSE '' END AS new_email,
  'https://linkedin.example/in/u' || CAST(c.c_custkey AS STRING) AS linkedin_url,
  n.n_name AS country,
  r.r_name AS state,
  CASE WHEN c.c_custkey % 6 = 0 THEN '' ELSE '+1-555-' || lpad(CAST(c.c_custkey % 10000 AS STRING), 4, '0') END AS phone0,
  CASE WHEN c.c_custkey % 2 = 0 THEN 'verified' ELSE '' END AS email_status,
  'Works in ' || c.c_mktsegment AS headline,
  CASE WHEN c.c_custkey % 3 = 0 THEN 'senior' WHEN c.c_custkey % 3 = 1 THEN 'entry' ELSE '' END AS seniority,
  CASE WHEN c.c_custkey % 7 = 0 THEN '' ELSE 'sales' END AS dept0,
  lower(c.c_mktsegment) AS dept1,
  CASE WHEN c.c_acctbal < 0 THEN NULL ELSE c.c_acctbal > 4000 END AS engage,
  CASE WHEN c.c_custkey % 8 = 0 THEN '' ELSE 'Org' || CAST(c.c_nationkey AS STRING) END AS hist_org,
  '2020-01-' || lpad(CAST(c.c_custkey % 28 + 1 AS STRING), 2, '0') AS hist_start,
  CASE WHEN c.c_custkey % 9 = 0 THEN 'Emb ' || n.n_name ELSE '' END AS org_name,
  CASE WHEN c.c_custkey % 9 = 0 THEN lower(c.c_mktsegment) ELSE '' END AS org_industry
FROM {customer} c
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey
"""

_ORG_FIELDS = """
  CASE WHEN min(c.c_custkey) % 3 = 0 THEN CAST(count(*) AS STRING) || ',000'
       WHEN min(c.c_custkey) % 7 = 1 THEN '0' ELSE CAST(count(*) AS STRING) END AS employees,
  CASE WHEN min(c.c_custkey) % 4 = 0 THEN '0' ELSE CAST(1990 + min(c.c_custkey) % 30 AS STRING)
       || (CASE WHEN min(c.c_custkey) % 5 = 1 THEN '.0' ELSE '' END) END AS founded,
  CASE WHEN max(c.c_acctbal) > 9900 THEN upper(substr(min(c.c_mktsegment), 1, 3)) ELSE '' END AS symbol,
  CASE WHEN min(c.c_custkey) % 2 = 0 THEN '' ELSE '+44 20 ' || CAST(min(c.c_custkey) AS STRING) END AS phone,
  '+1 800 ' || CAST(min(c.c_custkey) AS STRING) AS account_phone,
  CASE WHEN min(c.c_custkey) % 3 = 0 THEN CAST(min(c.c_custkey) AS STRING) || ' Main St' ELSE '' END AS raw_address,
  CASE WHEN min(c.c_custkey) % 5 = 0 THEN '' ELSE 'City' || CAST(min(c.c_nationkey) AS STRING) END AS city,
  CASE WHEN min(c.c_custkey) % 7 = 0 THEN '' ELSE 'Region' || CAST(min(c.c_nationkey) % 5 AS STRING) END AS ostate,
  CASE WHEN min(c.c_custkey) % 6 = 0 THEN '' ELSE 'Country' || CAST(min(c.c_nationkey) AS STRING) END AS ocountry,
  CASE WHEN min(c.c_custkey) % 2 = 1 THEN '' ELSE lower(min(c.c_mktsegment)) END AS industry,
  'ind-' || lower(min(c.c_mktsegment)) AS industry0,
  CAST(sum(CASE WHEN c.c_acctbal > 5000 THEN 1 ELSE 0 END) AS BIGINT) AS dept_sales,
  CAST(sum(CASE WHEN c.c_acctbal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS dept_finance,
  lower(min(c.c_mktsegment)) AS kw0,
  CASE WHEN count(*) % 2 = 0 THEN '' ELSE 'b2b' END AS kw1,
  CASE WHEN min(c.c_custkey) % 4 = 1 THEN '1000000' ELSE '' END AS revenue,
  CASE WHEN min(c.c_custkey) % 4 = 2 THEN '0' ELSE '250000' END AS annual_revenue
"""

COMPANIES_SQL = f"""
SELECT lower(c.c_mktsegment) || CAST(c.c_nationkey AS STRING) || '.example.org' AS domain,
  upper(substr(c.c_mktsegment, 1, 1)) || lower(substr(c.c_mktsegment, 2)) || ' Group ' || CAST(c.c_nationkey AS STRING) AS name,
  {_ORG_FIELDS}
FROM {{customer}} c GROUP BY c.c_mktsegment, c.c_nationkey
UNION ALL
SELECT lower(c.c_mktsegment) || '.example.com' AS domain,
  upper(substr(c.c_mktsegment, 1, 1)) || lower(substr(c.c_mktsegment, 2)) || ' Holdings' AS name,
  {_ORG_FIELDS}
FROM {{customer}} c GROUP BY c.c_mktsegment
"""


def _typed_struct(schema: T.StructType, values: dict) -> F.Column:
    """Struct of ``schema`` with the given fields set and the rest NULL."""
    return F.struct(*[(values[f.name] if f.name in values else F.lit(None)).cast(f.dataType).alias(f.name)
                      for f in schema.fields])


def _nz(c: str) -> F.Column:
    return F.when(F.col(c) != F.lit(""), F.col(c))


def people_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = spark_sql(spark, sf_dir, PEOPLE_SQL, ["customer", "nation", "region"])
    org = F.when(F.col("org_name") != F.lit(""), _typed_struct(ORG_SCHEMA, {
        "name": F.col("org_name"), "industry": F.col("org_industry")})).when(
            F.col("seniority") == "senior", _typed_struct(ORG_SCHEMA, {}))  # an empty object is no match
    person = _typed_struct(PERSON_SCHEMA, {
        "first_name": F.col("first_name"), "last_name": F.col("last_name"), "title": F.col("title"),
        "email": F.col("new_email"), "linkedin_url": F.col("linkedin_url"),
        "country": F.col("country"), "state": F.col("state"),
        "phone_numbers": F.when(F.col("phone0") != "", F.array("phone0")).otherwise(F.array()),
        "email_status": F.col("email_status"), "headline": F.col("headline"),
        "seniority": F.col("seniority"), "departments": F.array("dept0", "dept1"),
        "functions": F.array(), "is_likely_to_engage": F.col("engage"),
        "employment_history": F.array(F.struct(F.col("hist_org").alias("organization_name"),
                                               F.col("hist_start").alias("start_date"))),
        "organization": org,
    })
    return flat.select(F.col("email"), F.lit(None).cast("string").alias("first_name"),
                       F.lit(None).cast("string").alias("last_name"),
                       F.lit(None).cast("string").alias("organization_domain"),
                       F.lit(None).cast("string").alias("organization_name"), person.alias("person"))


def company_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = spark_sql(spark, sf_dir, COMPANIES_SQL, ["customer"])
    org = _typed_struct(ORG_SCHEMA, {
        "name": F.col("name"), "industry": F.col("industry"), "industries": F.array("industry0"),
        "website_url": F.concat(F.lit("https://"), F.col("domain")),
        "primary_domain": F.col("domain"), "estimated_num_employees": F.col("employees"),
        "founded_year": F.col("founded"), "publicly_traded_symbol": _nz("symbol"),
        "phone": F.col("phone"), "account": F.struct(F.col("account_phone").alias("phone")),
        "raw_address": F.col("raw_address"), "city": F.col("city"), "state": F.col("ostate"),
        "country": F.col("ocountry"),
        "departmental_head_count": F.map_from_arrays(F.array(F.lit("sales"), F.lit("finance")),
                                                     F.array("dept_sales", "dept_finance").cast("array<string>")),
        "keywords": F.array("kw0", "kw1"), "estimated_annual_revenue": F.col("revenue"),
        "annual_revenue": F.col("annual_revenue"),
    })
    return flat.select("domain", org.alias("organization"))


def people_callable(endpoint: str, payload: dict, timeout: float) -> dict:
    """Stand-in people provider: answers from the request alone. E-mails
    ending in ``5@example.com`` have no match."""
    out = []
    for d in payload["details"]:
        email = d.get("email", "")
        if email.endswith("5@example.com"):
            out.append(None)
            continue
        out.append({"title": "Lead " + d.get("first_name", "?"),
                    "seniority": "senior" if len(email) % 2 else "",
                    "departments": ["ops", ""]})
    return {"matches": out}


def company_callable(endpoint: str, payload: dict, timeout: float) -> dict:
    """Stand-in company provider: one organisation per requested domain;
    ``.net`` domains have no match, those of 20 characters an empty one.
    Employees come as a number or as text."""
    return {"matches": [None if d.endswith(".net") else {} if len(d) == 20 else
                        {"name": d.split(".")[0].upper(),
                         "estimated_num_employees": len(d) if len(d) % 3 else f"{len(d)},000",
                         "publicly_traded_symbol": "X" if len(d) % 2 else None}
                        for d in payload["domains"]]}
