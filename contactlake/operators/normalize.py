"""Normalisation of contact rows (one projection + one filter)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import text as TX
from ..functions.url import extract_domain
from .columns import data_columns, drop_index_columns, is_internal, qcol

TRIMMED_COLUMNS = [S.FIRST, S.LAST, S.TITLE, S.EMAIL]


def _as_text(df: DataFrame, name: str) -> Column:
    c = qcol(name)
    return c if isinstance(df.schema[name].dataType, T.StringType) else c.cast("string")


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows whose data columns are all NULL (internal columns ignored)."""
    cols = data_columns(df)
    if not cols:
        return df
    return df.where(reduce(or_, [qcol(c).isNotNull() for c in cols]))


def email_kept(c: Column) -> Column:
    """Row survives the e-mail check: present, non-blank and valid."""
    return TX.is_valid_email(c)


def normalize(df: DataFrame, lead_source: str | None = None,
              validate_email: bool = True) -> DataFrame:
    """Clean and normalise contact rows, in this order:

    1. drop ``Unnamed: N`` index columns;
    2. drop rows in which every data column is NULL;
    3. ``Website URLs`` -> bare domain (NULL kept NULL);
    4. company name collapsed and title-cased (NULL kept NULL);
    5. strip first name, last name, job title and e-mail;
    6. when an e-mail column exists, drop rows without a valid e-mail;
    7. ``Lead Source`` always set (``lead_source`` or the upload default);
       ``Email Send (Yes/No)`` kept when present, else ``"No"``;
    8. NULL -> ``""`` in every text column.

    All of it is one projection and one filter; nothing is materialised.
    """
    df = drop_index_columns(df)
    df = drop_empty_rows(df)
    cols = df.columns
    exprs: list[Column] = []
    for name in cols:
        if is_internal(name):
            exprs.append(qcol(name))
            continue
        v = _as_text(df, name)
        if name == S.WEBSITE:
            v = extract_domain(v)
        elif name == S.COMPANY:
            v = F.when(v.isNull(), F.lit(None).cast("string")).otherwise(TX.normalize_company(v))
        elif name in TRIMMED_COLUMNS:
            v = TX.py_strip(v)
        if name == S.LEAD_SOURCE:
            v = F.lit(lead_source if lead_source is not None else S.DEFAULT_LEAD_SOURCE)
        exprs.append(v.alias(name))
    if S.LEAD_SOURCE not in cols:
        exprs.append(F.lit(lead_source if lead_source is not None else S.DEFAULT_LEAD_SOURCE)
                     .alias(S.LEAD_SOURCE))
    if S.EMAIL_SEND not in cols:
        exprs.append(F.lit(S.DEFAULT_EMAIL_SEND).alias(S.EMAIL_SEND))
    out = df.select(*exprs)
    if validate_email and S.EMAIL in cols:
        out = out.where(email_kept(qcol(S.EMAIL)))
    return fill_blank(out)


def fill_blank(df: DataFrame) -> DataFrame:
    """NULL -> '' in every non-internal text column."""
    exprs = []
    for f in df.schema.fields:
        if not is_internal(f.name) and isinstance(f.dataType, T.StringType):
            exprs.append(F.coalesce(qcol(f.name), F.lit("")).alias(f.name))
        else:
            exprs.append(qcol(f.name))
    return df.select(*exprs)


def rejected_emails(df: DataFrame) -> DataFrame:
    """Rows that the e-mail check of :func:`normalize` drops (for counting)."""
    df = drop_empty_rows(drop_index_columns(df))
    if S.EMAIL not in df.columns:
        return df.limit(0)
    return df.where(~email_kept(TX.py_strip(_as_text(df, S.EMAIL))))


def prepare_for_save(df: DataFrame) -> DataFrame:
    """Before the upsert: drop internal columns except ``_row_id``, stringify
    every value, NULL -> ''. Integral numbers render without ``.0``."""
    exprs = []
    for f in df.schema.fields:
        if f.name == "_row_id":
            exprs.append(qcol(f.name))
        elif is_internal(f.name):
            continue
        else:
            exprs.append(F.coalesce(qcol(f.name).cast("string"), F.lit("")).alias(f.name))
    return df.select(*exprs)


def with_email(df: DataFrame) -> Column:
    """Predicate: the record has a (non-empty) e-mail."""
    return qcol(S.EMAIL).isNotNull() & (qcol(S.EMAIL) != F.lit("")) if S.EMAIL in df.columns \
        else F.lit(False)


def has_people_identifier(df: DataFrame) -> Column:
    """E-mail, or first and last name, or company, or website (non-blank)."""
    def nb(name: str) -> Column:
        if name not in df.columns:
            return F.lit(False)
        return ~TX.is_blank(_as_text(df, name))
    return nb(S.EMAIL) | (nb(S.FIRST) & nb(S.LAST)) | nb(S.COMPANY) | nb(S.WEBSITE)
