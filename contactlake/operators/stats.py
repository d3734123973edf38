"""Statistics, quality profile and run summaries: single-pass aggregates."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import has_value, is_blank, py_strip
from ..functions.url import extract_domain
from .columns import data_columns, qcol


def recent_cutoff(as_of: str | datetime, days: int = 7, boundary_day: bool = False) -> str:
    """Cutoff text for "updated in the last ``days`` days".

    Default: exact ISO ``...Z`` instant ``days`` before ``as_of``. With
    ``boundary_day=True`` the cutoff is written ``yyyy-MM-dd HH:mm:ss`` as a
    SQLite-backed store does; since ``'T' > ' '`` every stored value of the
    boundary date then counts as recent.
    """
    if isinstance(as_of, str):
        as_of = datetime.strptime(as_of.replace("Z", ""), "%Y-%m-%dT%H:%M:%S").replace(tzinfo=timezone.utc)
    cut = as_of - timedelta(days=days)
    return cut.strftime("%Y-%m-%d %H:%M:%S" if boundary_day else "%Y-%m-%dT%H:%M:%SZ")


def statistics(df: DataFrame, as_of: str | datetime, days: int = 7,
               boundary_day: bool = False, updated_col: str = S.UPDATED) -> DataFrame:
    """One row: ``total_records``, ``recent_updates``, ``total_columns``.

    Recent = ``UPDATE AS ON >= cutoff`` compared as text (the stored format
    sorts chronologically). One scan, partial aggregation.
    """
    cutoff = recent_cutoff(as_of, days, boundary_day)
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(qcol(updated_col) >= F.lit(cutoff)).alias("recent_updates"),
    ).withColumn("total_columns", F.lit(len(data_columns(df))).cast("long"))


def by_lead_source(df: DataFrame, col: str = S.LEAD_SOURCE) -> DataFrame:
    """``(lead_source, n)``; the NULL group is kept."""
    return df.groupBy(qcol(col).alias("lead_source")).agg(F.count(F.lit(1)).alias("n"))


def quality_profile(df: DataFrame) -> DataFrame:
    """One row of counts over a normalised frame: rows, rows with a usable
    domain / without one, rows that company enrichment would consider
    (domain or company) and those it would skip, rows with a valid-looking
    e-mail, and per-column non-empty counts as ``filled_<column>``."""
    web = qcol(S.WEBSITE) if S.WEBSITE in df.columns else F.lit(None).cast("string")
    comp = qcol(S.COMPANY) if S.COMPANY in df.columns else F.lit(None).cast("string")
    web_ok = ~is_blank(web) & (F.lower(py_strip(web)) != F.lit("nan"))
    comp_ok = ~is_blank(comp)
    aggs: list[Column] = [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(web_ok).alias("valid_domains"),
        F.count_if(~web_ok).alias("empty_domains"),
        F.count_if(~is_blank(web) | comp_ok).alias("will_enrich"),
        F.count_if(is_blank(web) & ~comp_ok).alias("will_skip"),
        F.count_if(extract_domain(py_strip(web)).isNotNull()).alias("requestable_domains"),
    ]
    for i, c in enumerate(data_columns(df)):
        aggs.append(F.count_if(has_value(qcol(c).cast("string"))).alias(f"filled_{i}"))
    out = df.agg(*aggs)
    renames = {f"filled_{i}": f"filled_{c}" for i, c in enumerate(data_columns(df))}
    return out.withColumnsRenamed(renames)


def enrichment_counts(df: DataFrame, error_col: str = "_enrichment_error") -> DataFrame:
    """Rows without an enrichment error (``enriched``) and with one."""
    err = qcol(error_col) if error_col in df.columns else F.lit(None).cast("string")
    return df.agg(F.count_if(~has_value(err)).alias("enriched"),
                  F.count_if(has_value(err)).alias("with_error"))


def run_summary(outcomes: DataFrame, processed: Column | int | None = None) -> DataFrame:
    """One-row run summary from per-record upsert outcomes:
    processed, new_inserts, updates, skipped, failed."""
    a = F.col("action")
    out = outcomes.agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.count_if(a == "insert").alias("new_inserts"),
        F.count_if(a == "update").alias("updates"),
        F.count_if(a == "skip").alias("skipped"),
        F.count_if(a == "failed").alias("failed"),
    )
    if processed is not None:
        out = out.withColumn("total_processed", processed if isinstance(processed, Column)
                             else F.lit(int(processed)).cast("long"))
    return out
