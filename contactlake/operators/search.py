"""Filtered search, paging and export slices over the truth table."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from .columns import qcol


def build_filters(**params: str | None) -> dict[str, str]:
    """Named parameters -> ``{column: value}``; blank values are omitted and
    values are stripped. Unknown parameter names raise ``KeyError``."""
    out: dict[str, str] = {}
    for name, value in params.items():
        col = S.FILTER_PARAMS[name]
        if value is not None and str(value).strip():
            out[col] = str(value).strip()
    return out


def like_pattern(value: str) -> str:
    """``%value%`` with ``%`` and ``_`` left as wildcards (as the reference
    passes them through); backslashes are doubled so Spark does not read
    them as escapes."""
    return "%" + str(value).replace("\\", "\\\\") + "%"


def filter_condition(filters: dict[str, str] | None, case_sensitive: bool = False) -> Column | None:
    """AND of ``column LIKE '%value%'`` over the truthy filter values."""
    conds = []
    for col, value in (filters or {}).items():
        if not value:
            continue
        pat = like_pattern(value)
        c = qcol(col)
        conds.append(c.like(pat) if case_sensitive else c.ilike(pat))
    return reduce(and_, conds) if conds else None


def apply_filters(df: DataFrame, filters: dict[str, str] | None,
                  case_sensitive: bool = False) -> DataFrame:
    """Rows matching every filter; NULL never matches. Case-insensitive by
    default (the documented behaviour); ``case_sensitive=True`` gives the
    plain ``LIKE`` of a case-sensitive store."""
    cond = filter_condition(filters, case_sensitive)
    return df if cond is None else df.where(cond)


def check_page_args(limit: int, offset: int) -> None:
    if not 1 <= int(limit) <= S.MAX_PAGE_SIZE:
        raise ValueError(f"limit must be between 1 and {S.MAX_PAGE_SIZE}")
    if int(offset) < 0:
        raise ValueError("offset must be >= 0")


def search(df: DataFrame, filters: dict[str, str] | None = None, limit: int = S.DEFAULT_PAGE_SIZE,
           offset: int = 0, case_sensitive: bool = False) -> DataFrame:
    """One page ordered by ``S.N.``. Plans as a single top-k
    (``TakeOrderedAndProject``) after the filter: no full sort, no shuffle of
    the table. The total is :func:`search_total`."""
    check_page_args(limit, offset)
    q = apply_filters(df, filters, case_sensitive).orderBy(qcol(S.SN).asc())
    if offset:
        q = q.offset(int(offset))
    return q.limit(int(limit))


def search_total(df: DataFrame, filters: dict[str, str] | None = None,
                 case_sensitive: bool = False) -> DataFrame:
    """One row ``total``: number of matching rows (a partial-aggregate count)."""
    return apply_filters(df, filters, case_sensitive).agg(F.count(F.lit(1)).alias("total"))


def search_after(df: DataFrame, filters: dict[str, str] | None, last_sn: int | None,
                 limit: int = S.DEFAULT_PAGE_SIZE, case_sensitive: bool = False) -> DataFrame:
    """Keyset page: rows with ``S.N.`` greater than ``last_sn``. Deep pages
    cost the same as the first one (the filter reaches the Parquet scan)."""
    check_page_args(limit, 0)
    q = apply_filters(df, filters, case_sensitive)
    if last_sn is not None:
        q = q.where(qcol(S.SN) > F.lit(int(last_sn)))
    return q.orderBy(qcol(S.SN).asc()).limit(int(limit))


def page_bounds(page: int, size: int) -> int:
    """Offset of a 1-based page."""
    if size not in S.PAGE_SIZES:
        raise ValueError(f"page size must be one of {S.PAGE_SIZES}")
    return (max(1, int(page)) - 1) * size


def page_count(total: int, size: int) -> int:
    return max(1, math.ceil(total / size))


def page(df: DataFrame, n: int, size: int = S.DEFAULT_PAGE_SIZE,
         filters: dict[str, str] | None = None) -> DataFrame:
    """Page ``n`` (1-based) of the ordered, filtered table."""
    return search(df, filters, limit=size, offset=page_bounds(n, size))


def export_frame(df: DataFrame, filters: dict[str, str] | None = None,
                 cap: int | None = None, case_sensitive: bool = False) -> DataFrame:
    """Filtered rows in ``S.N.`` order: all of them, by a range-partitioned
    sort, or at most ``cap`` when one is given."""
    q = apply_filters(df, filters, case_sensitive).orderBy(qcol(S.SN).asc())
    return q.limit(int(cap)) if cap else q


def first_n(df: DataFrame, n: int) -> DataFrame:
    """First ``n`` rows by ``S.N.`` (a sample preview)."""
    return df.orderBy(qcol(S.SN).asc()).limit(int(n))


def lookup(df: DataFrame, email: str) -> DataFrame:
    """Point lookup by e-mail: the equality reaches the Parquet scan as a
    pushed filter (row groups skipped by min/max statistics)."""
    return df.where(qcol(S.EMAIL) == F.lit(email)).limit(1)
