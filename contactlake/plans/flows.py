"""End-to-end flows composed from the operators.

* :func:`ingest_and_enrich` -- contact files -> header mapping ->
  normalisation -> keep-first by e-mail -> people / company enrichment ->
  fill-empty upsert into the snapshot store, with a run summary.
* :func:`ingest_base` -- the same without enrichment and without the
  e-mail-column requirement (rows without e-mail end as skipped).
* :func:`ingest_pages` -- stored pages -> extraction -> contact rows ->
  normalisation (scrape lead source) -> keep-first by name and company ->
  enrichment -> split saved / skipped -> upsert.
* :func:`search_store`, :func:`export_store`, :func:`store_statistics`.

Every step is a DataFrame transformation; the only materialisations are
the lineage cut after enrichment (so the provider is called once), the
snapshot write, and small one-row counters.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import display_value, has_value, mask_pii
from ..operators.columns import column_catalog, map_columns, qcol
from ..operators.dedupe import dedupe_by_email, dedupe_by_name_company
from ..operators.enrich import ERROR, enrich_records, prune_empty_new_columns
from ..operators.extract import extract_contacts, items_to_contacts
from ..operators.normalize import normalize, prepare_for_save
from ..operators.search import build_filters, export_frame, search, search_total
from ..operators.stats import by_lead_source, statistics
from ..operators.upsert import upsert
from ..session import checkpoint_dir
from ..sources.files import read_contacts
from ..sources.store import TruthStore
from ..sources.workbook import export_file_name, export_workbooks, read_workbooks

EXPORT_ROWS = 500_000


@dataclass
class RunResult:
    summary: dict
    outcomes: DataFrame | None = None
    errors: DataFrame | None = None
    warnings: list[str] = field(default_factory=list)
    cause: Exception | None = None
    saved: DataFrame | None = None
    skipped: DataFrame | None = None


def guess_format(path: str, fmt: str | None) -> str:
    """Explicit format, else the file extension, else xlsx (a folder of workbooks)."""
    if fmt:
        return fmt.lower()
    name = str(path).rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else "xlsx"


def _read(spark: SparkSession, source, fmt: str | None) -> tuple[DataFrame, list[str]]:
    if isinstance(source, DataFrame):
        return source, []
    f = guess_format(source, fmt)
    if f in ("xlsx", "excel"):
        wb = read_workbooks(spark, source)
        return wb.frame.drop("_file"), list(wb.warnings)
    return read_contacts(spark, source, f), []


def _empty(summary: dict, warnings: list[str]) -> RunResult:
    summary["empty_reason"] = "no_valid_rows"
    return RunResult(summary, warnings=warnings)


def enrichment_errors(df: DataFrame) -> DataFrame:
    """``(email, message)`` with the e-mail masked, for rows whose
    enrichment reported an error."""
    if ERROR not in df.columns:
        return df.sparkSession.createDataFrame([], "email string, message string")
    email = qcol(S.EMAIL) if S.EMAIL in df.columns else F.lit("Unknown")
    return df.where(has_value(qcol(ERROR))).select(
        mask_pii(F.coalesce(email, F.lit("Unknown"))).alias("email"), qcol(ERROR).alias("message"))


def save(store: TruthStore, df: DataFrame, now: str | None = None, **upsert_kw):
    """Drop internal columns, stringify, skip rows without e-mail (counted),
    upsert and write the touched buckets. Returns (upsert result, skipped count)."""
    ready = prepare_for_save(df)
    has_email = S.EMAIL in ready.columns
    skipped = ready.where(~has_value(qcol(S.EMAIL))).count() if has_email else ready.count()
    batch = ready.where(has_value(qcol(S.EMAIL))) if has_email else ready.limit(0)
    touched = store.touched_buckets(batch) if S.EMAIL in batch.columns else []
    res = upsert(store.read(buckets=touched), batch, now=now, max_sn=store.max_sn(), **upsert_kw)
    if touched:
        store.commit(res.state, buckets=touched)
    return res, skipped


def _counts(res) -> dict:
    row = res.stats.first().asDict()
    return {"new_inserts": row["inserted"], "updates": row["updated"], "failed": row["failed"],
            "skipped": row["skipped"]}


def ingest_and_enrich(spark: SparkSession, source: str | DataFrame, store: TruthStore,
                      people_provider=None, company_provider=None, enrich_people: bool = True,
                      enrich_companies: bool = True, now: str | None = None,
                      fmt: str | None = None, prefixes: S.ProviderPrefixes = S.DEFAULT_PREFIXES,
                      **kw) -> RunResult:
    """Upload-and-enrich flow. ``source`` is a path (xlsx/csv/json/parquet)
    or a DataFrame with ``_row_id``. ``prefixes`` are those of the table's
    provider columns; they hold for enrichment and for the upsert. An error
    ends up in the summary and, as it was raised, in ``RunResult.cause``."""
    summary = {"total_processed": 0, "new_inserts": 0, "updates": 0, "failed": 0,
               "people_enriched": 0, "orgs_enriched": 0, "empty_reason": None,
               "org_enrichment_skipped_no_domain": 0, "skipped_no_email": 0}
    warnings: list[str] = []
    try:
        raw, warnings = _read(spark, source, fmt)
        mapped, w = map_columns(raw)
        warnings += [x for x in w if x not in warnings]
        rows = normalize(mapped)
        if rows.isEmpty():
            return _empty(summary, warnings)
        if S.EMAIL not in rows.columns:
            raise ValueError(S.MSG_NO_EMAIL_COLUMN)
        rows = dedupe_by_email(rows)[0]
        checkpoint_dir(spark)
        rows = rows.checkpoint(eager=True)
        summary["total_processed"] = rows.count()
        if summary["total_processed"] == 0:
            return _empty(summary, warnings)
        if enrich_people or enrich_companies:
            e = enrich_records(rows, people_provider, company_provider, enrich_people, enrich_companies,
                               prefixes=prefixes, **kw)
            full = e.full.checkpoint(eager=True)  # provider called once
            c = full.agg(F.count_if(F.col("__people_ok")).alias("p"), F.count_if(F.col("__org_ok")).alias("o"),
                         F.count_if(F.col("__no_domain")).alias("n")).first()
            summary.update(people_enriched=c["p"], orgs_enriched=c["o"],
                           org_enrichment_skipped_no_domain=c["n"])
            from ..operators.enrich import FLAGS

            rows = prune_empty_new_columns(full.drop(*FLAGS), rows.columns)
        res, skipped = save(store, rows, now=now, prefixes=prefixes)
        summary.update(_counts(res))
        summary["skipped_no_email"] = skipped
        return RunResult(summary, res.outcomes, enrichment_errors(rows), warnings + res.warnings)
    except Exception as e:  # the run reports instead of raising
        summary["errors"] = [{"email": "N/A", "message": S.MSG_PROCESSING_FAILED.format(error=e)}]
        summary["processing_failed"] = True
        if summary["total_processed"] > 0:
            summary["failed"] = summary["total_processed"]
        return RunResult(summary, warnings=warnings, cause=e)


def ingest_base(spark: SparkSession, source: str | DataFrame, store: TruthStore,
                now: str | None = None, fmt: str | None = None) -> RunResult:
    """Base upload: no enrichment, no e-mail-column requirement."""
    raw, warnings = _read(spark, source, fmt)
    mapped, w = map_columns(raw)
    checkpoint_dir(spark)
    rows = dedupe_by_email(normalize(mapped))[0].checkpoint(eager=True)  # the input is evaluated once
    res, skipped = save(store, rows, now=now)
    summary = {"total": rows.count(), "skipped_no_email": skipped, **_counts(res)}
    return RunResult(summary, res.outcomes, None, warnings + w + res.warnings)


def ingest_pages(spark: SparkSession, pages: DataFrame, store: TruthStore, primary, fallback=None,
                 people_provider=None, company_provider=None, enrich_people: bool = True,
                 enrich_companies: bool = True, now: str | None = None,
                 keep_rows_without_email: bool | None = None,
                 prefixes: S.ProviderPrefixes = S.DEFAULT_PREFIXES, **kw) -> RunResult:
    """Scrape flow over stored pages. ``saved`` and ``skipped`` of the result
    are the display rows with and without an e-mail."""
    summary = {"total_processed": 0, "new_inserts": 0, "updates": 0, "failed": 0,
               "people_enriched": 0, "orgs_enriched": 0, "skipped_no_email": 0}
    items = extract_contacts(pages, primary, fallback)
    checkpoint_dir(spark)
    items = items.checkpoint(eager=True)  # extractor called once
    rows = items_to_contacts(items)
    # parity: with an e-mail column, rows without e-mail are dropped here;
    # keep_rows_without_email keeps them (they are then skipped at save)
    rows = normalize(rows, lead_source=S.SCRAPE_LEAD_SOURCE, validate_email=not keep_rows_without_email)
    rows = dedupe_by_name_company(rows)[0].checkpoint(eager=True)
    summary["total_processed"] = rows.count()
    if summary["total_processed"] == 0:
        return RunResult(summary)
    if (enrich_people and people_provider is not None) or (enrich_companies and company_provider is not None):
        e = enrich_records(rows, people_provider, company_provider, enrich_people, enrich_companies,
                           prefixes=prefixes, **kw)
        full = e.full.checkpoint(eager=True)
        c = full.agg(F.count_if(F.col("__people_ok")).alias("p"), F.count_if(F.col("__org_ok")).alias("o")).first()
        summary.update(people_enriched=c["p"], orgs_enriched=c["o"])
        from ..operators.enrich import FLAGS

        rows = prune_empty_new_columns(full.drop(*FLAGS), rows.columns)
    res, skipped = save(store, rows, now=now, prefixes=prefixes)
    summary.update(_counts(res))
    summary["skipped_no_email"] = skipped
    saved, without = saved_and_skipped(rows)
    return RunResult(summary, res.outcomes, enrichment_errors(rows), res.warnings,
                     saved=saved, skipped=without)


def saved_and_skipped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Display projections (first, last, company) of rows that will be
    saved (with e-mail) and skipped (without); one tagged pass."""
    has = has_value(F.trim(qcol(S.EMAIL))) if S.EMAIL in rows.columns else F.lit(False)
    tagged = rows.select(has.alias("__saved"), *[display_value(qcol(c)).alias(c) if c in rows.columns
                                                 else F.lit("").alias(c) for c in (S.FIRST, S.LAST, S.COMPANY)])
    return tagged.where("__saved").drop("__saved"), tagged.where(~F.col("__saved")).drop("__saved")


def search_store(store: TruthStore, limit: int = S.DEFAULT_PAGE_SIZE, offset: int = 0, **params):
    """(page DataFrame, total DataFrame) for named filter parameters."""
    t = store.read()
    f = build_filters(**params)
    return search(t, f, limit, offset), search_total(t, f)


def export_store(store: TruthStore, out_dir: str, cap: int | None = None, fmt: str = "xlsx",
                 rows_per_file: int = EXPORT_ROWS, **params) -> tuple[list[str], str]:
    """Export the filtered table in ``S.N.`` order; returns (paths, name).

    ``csv`` and ``parquet`` are written by Spark as ordered parts of at most
    ``rows_per_file`` rows, whose names rise with ``S.N.``; ``xlsx`` as
    workbook parts.
    """
    frame = export_frame(store.read(), build_filters(**params), cap)
    if fmt == "xlsx":
        return export_workbooks(frame, out_dir), export_file_name()
    write_parts(frame, out_dir, fmt, rows_per_file)
    return [out_dir], export_file_name().rsplit(".", 1)[0]


def write_parts(frame: DataFrame, out_dir: str, fmt: str, rows_per_file: int = EXPORT_ROWS) -> None:
    """A sorted frame as ordered files: the sort's ranges become parts, long ranges several files."""
    options = {"header": "true", "escape": '"', "emptyValue": "", "nullValue": ""} if fmt == "csv" else {}
    frame.write.options(**options).option("maxRecordsPerFile", rows_per_file).mode("overwrite").format(fmt).save(out_dir)


def store_statistics(spark: SparkSession, store: TruthStore, as_of: str):
    t = store.read()
    return statistics(t, as_of), by_lead_source(t), column_catalog(spark, t)
