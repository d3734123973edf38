"""Keep-first deduplication.

``dropDuplicates`` keeps an arbitrary row; here the first row by an
explicit order column wins. The first row per key is taken by an aggregate
(``min`` over ``struct(order, row)``), which Spark computes partially on the
map side: a key that holds a third of all rows is reduced to one row per
map task before the shuffle instead of landing whole in one window task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from .columns import qcol

ROW_ID = "_row_id"


def keep_first(df: DataFrame, keys: list[str], order: str = ROW_ID) -> DataFrame:
    """One row per ``keys`` (NULLs equal to each other), the lowest ``order``.

    Column order and types are preserved.
    """
    cols = df.columns
    at = {k: f"__k{i}" for i, k in enumerate(keys)}
    rest = [c for c in cols if c not in at]  # the keys go through the shuffle once, as keys
    packed = F.struct(qcol(order).alias("__o"), F.struct(*[qcol(c).alias(c) for c in rest]).alias("r"))
    firsts = df.groupBy(*[qcol(k).alias(at[k]) for k in keys]).agg(F.min(packed).alias("__first"))
    row = F.col("__first")["r"]
    return firsts.select(*[(F.col(at[c]) if c in at else row[c]).alias(c) for c in cols])


def key_digest(keys: list[str]) -> Column:
    """SHA-256 of the keys: each one's text behind its length, a null told apart from all texts."""
    parts = [F.coalesce(F.concat(F.length(k.cast("string")), F.lit(":"), k.cast("string")), F.lit("-")) for k in map(qcol, keys)]
    return F.unhex(F.sha2(F.concat_ws(",", *parts), 256))


def keep_first_wide(df: DataFrame, keys: list[str], order: str = ROW_ID) -> DataFrame:
    """:func:`keep_first` for long keys and wide rows: neither goes through an aggregate.

    ``order`` must be a unique number without nulls. The least order of each
    key's digest is a hash aggregate with buffers of fixed size; the rows come
    from a semi join on digest and order, which are unique together, so a
    frequent key is spread like any other. Long columns move once at most.
    The input is evaluated twice: best on a frame that is read from files.
    """
    digest, at = key_digest(keys), "__digest"
    firsts = (df.select(digest.alias(at), qcol(order).alias("__order")).groupBy(at)
              .agg(F.min("__order").alias("__least")).withColumnRenamed(at, "__of"))
    rows = df.withColumn(at, digest)
    return rows.join(firsts, (F.col(at) == F.col("__of")) & (qcol(order) == F.col("__least")), "left_semi").drop(at)


def dedupe_by_email(df: DataFrame, order: str = ROW_ID) -> tuple[DataFrame, list[str]]:
    """First row per e-mail (case-sensitive); unchanged with a warning when
    the frame has no e-mail column."""
    if S.EMAIL not in df.columns:
        return df, [S.MSG_NO_EMAIL_DEDUPE]
    return keep_first(df, [S.EMAIL], order), []


def dedupe_by_name_company(df: DataFrame, order: str = ROW_ID) -> tuple[DataFrame, list[str]]:
    """First row per (first name, last name, company)."""
    keys = [S.FIRST, S.LAST, S.COMPANY]
    missing = [k for k in keys if k not in df.columns]
    if missing:
        return df, [S.MSG_NO_NAME_COMPANY_DEDUPE.format(missing=missing)]
    return keep_first(df, keys, order), []
