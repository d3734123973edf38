"""Plan-time column operators: header mapping, index-column drop, schema
growth, display order and the column catalog. None of them reads data."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S

INTERNAL_PREFIX = "_"
_INDEX_COLUMN = re.compile(r"^Unnamed:\s*\d+$", re.IGNORECASE)


def qcol(name: str) -> Column:
    """Column reference safe for names with dots, spaces or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_internal(name: str) -> bool:
    return name.startswith(INTERNAL_PREFIX)


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not is_internal(c)]


def standard_name(header: str) -> str | None:
    """Standard column for a sheet header, or None when it matches nothing."""
    h = str(header).strip().lower()
    for standard, aliases in S.COLUMN_ALIASES.items():
        if h in aliases or h == standard.lower():
            return standard
    return None


def map_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rename headers to the standard names (first matching standard wins).

    Two headers that end up with the same name (case-insensitively, as Spark
    resolves names) keep the first one; later ones are dropped when mapped,
    or suffixed ``.1``, ``.2`` ... when unmapped, and a warning is returned.
    Internal ``_`` columns pass through. Renaming is positional, so headers
    with dots or duplicates are safe.
    """
    warnings: list[str] = []
    seen: dict[str, int] = {}
    tmp = [f"__c{i}" for i in range(len(df.columns))]
    keep: list[Column] = []
    dup_mapped = False
    dup_plain = False
    for i, name in enumerate(df.columns):
        target = name if is_internal(name) else (standard_name(name) or name)
        key = target.lower()
        if key in seen:
            if not is_internal(name) and standard_name(name):
                dup_mapped = True
                continue
            seen[key] += 1
            target = f"{target}.{seen[key]}"
            while target.lower() in seen:
                seen[key] += 1
                target = f"{name}.{seen[key]}"
            dup_plain = True
        seen.setdefault(target.lower(), 0)
        keep.append(F.col(tmp[i]).alias(target))
    if dup_mapped or dup_plain:
        warnings.append(S.MSG_DUPLICATE_COLUMNS)
    return df.toDF(*tmp).select(*keep), warnings


def drop_index_columns(df: DataFrame) -> DataFrame:
    """Drop exported index columns such as ``Unnamed: 0``."""
    drop = [c for c in df.columns if _INDEX_COLUMN.match(str(c).strip())]
    return df.drop(*drop) if drop else df


def ensure_columns(df: DataFrame, names: list[str], value: str | None = None) -> DataFrame:
    """Add missing columns as text (NULL by default) in one projection."""
    have = {c.lower() for c in df.columns}
    missing = [n for n in names if n.lower() not in have]
    if not missing:
        return df
    return df.select("*", *[F.lit(value).cast("string").alias(n) for n in missing])


def display_order(df: DataFrame, prefixes: S.ProviderPrefixes = S.DEFAULT_PREFIXES) -> DataFrame:
    """Base columns first, then provider columns, each alphabetical."""
    cols = data_columns(df)
    base = sorted(c for c in cols if not prefixes.is_provider(c))
    prov = sorted(c for c in cols if prefixes.is_provider(c))
    return df.select(*[qcol(c) for c in base + prov])


def column_catalog(spark: SparkSession, df: DataFrame,
                   prefixes: S.ProviderPrefixes = S.DEFAULT_PREFIXES) -> DataFrame:
    """``(name, kind, ordinal)``: table order for base columns, provider
    columns (names starting with the provider family word) sorted."""
    fam = prefixes.family()
    cols = data_columns(df)
    base = [c for c in cols if not c.startswith(fam)]
    prov = sorted(c for c in cols if c.startswith(fam))
    rows = [(c, "base", i) for i, c in enumerate(base)] + \
           [(c, "provider", len(base) + i) for i, c in enumerate(prov)]
    return spark.createDataFrame(rows, "name string, kind string, ordinal int")
