"""Registered queries, part three: the whole flows over a stored table."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators.columns import qcol
from ..functions.provider import map_company
from ..operators.enrich import request_batches
from ..operators.keys import with_batches
from ..operators.page_index import PageIndex
from ..operators.search import build_filters, first_n, page, search_after
from ..operators.trigram_index import TrigramIndex
from ..operators.upsert import touched_emails, upsert
from ..session import scratch_path
from ..sources.files import read_contacts
from ..sources.provider import read_pages, read_responses, zip_responses
from ..sources.store import TruthStore
from ..sources.workbook import NA_TOKENS, read_workbooks
from . import oracle as O
from .catalog import UPSERT_NOW, register
from .catalog_more import (_RT_COLS, MAP_COMPANY_SQL, EXPORT_FILTERS, LOOKUP_EMAIL, _calls_sql, _na, _state_sql, _stored_sql, contacts,
                           stored_truth)
from .derived import incoming_updates, raw_contacts, read_table
from .extract_fixtures import EXTRACT_ORACLE, fallback_extractor, primary_extractor
from .flows import (export_store, ingest_and_enrich, ingest_pages, save, search_store, store_statistics,
                    write_parts)
from .provider_fixtures import company_callable, company_provider

OTHER_PREFIXES = S.ProviderPrefixes(person="Lead Person ", company="Lead Company ")
PAGE_SIZE, PAGE_OFFSET, PAGE_COMPANY = 50, 25, "building"
FIRST_ROWS = 100
STATISTICS_AT = "2024-02-03T00:00:00Z"


def _stored_and_updated(spark: SparkSession, sf_dir: str) -> TruthStore:
    """The stored contacts with the batch of updates saved into them."""
    store = TruthStore(spark, scratch_path(spark, "flow"))
    store.commit(stored_truth(spark, sf_dir))
    save(store, incoming_updates(spark, sf_dir), now=UPSERT_NOW)
    return store


def _ingest_sql() -> str:
    q = O.q
    ticker = q(S.DEFAULT_PREFIXES.company + "Public Ticker")
    return (f"SELECT row_number() OVER (ORDER BY _row_id) AS {q(S.SN)}, {q(S.EMAIL)}, {q(S.COMPANY)}, "
            f"{q(S.EMPLOYEES)}, {q(S.LISTED)}, {ticker} AS {q(OTHER_PREFIXES.company + 'Public Ticker')}, "
            f"'{UPSERT_NOW}' AS {q(S.UPDATED)} FROM ({_calls_sql('companies')}) e")


@register("ingest_enrich_flow", _ingest_sql())
def q_ingest_enrich_flow(spark, sf_dir):
    store = TruthStore(spark, scratch_path(spark, "ingest-enrich"))
    run = ingest_and_enrich(spark, raw_contacts(spark, sf_dir), store, None, company_callable,
                            enrich_people=False, now=UPSERT_NOW, prefixes=OTHER_PREFIXES)
    if run.cause is not None:
        raise run.cause
    return store.read().select(*[qcol(c) for c in (S.SN, S.EMAIL, S.COMPANY, S.EMPLOYEES, S.LISTED,
                                                   OTHER_PREFIXES.company + "Public Ticker", S.UPDATED)])


def _scrape_sql() -> str:
    q = O.q
    return (f"WITH e AS ({EXTRACT_ORACLE}), r AS (SELECT page_id, item_pos, trim(firstName) AS f, "
            f"trim(lastName) AS l, {O.d_company('trim(organization)')} AS c, "
            f"source = 'primary' AND item_pos % 4 = 0 AS saved FROM e) "
            f"SELECT f AS {q(S.FIRST)}, l AS {q(S.LAST)}, c AS {q(S.COMPANY)}, saved FROM r "
            f"QUALIFY row_number() OVER (PARTITION BY f, l, c ORDER BY page_id, item_pos) = 1")


@register("scrape_flow", _scrape_sql())
def q_scrape_flow(spark, sf_dir):
    store = TruthStore(spark, scratch_path(spark, "scrape"))
    run = ingest_pages(spark, read_table(spark, sf_dir, "pages"), store, partial(primary_extractor, mail=True),
                       fallback_extractor, now=UPSERT_NOW, keep_rows_without_email=True)
    return (run.saved.withColumn("saved", F.lit(True))
            .unionByName(run.skipped.withColumn("saved", F.lit(False))))


@register("search_flow", f"SELECT * FROM ({_state_sql()}) s WHERE {O.q(S.COMPANY)} ILIKE '%{PAGE_COMPANY}%' "
          f"ORDER BY {O.q(S.SN)} LIMIT {PAGE_SIZE} OFFSET {PAGE_OFFSET}")
def q_search_flow(spark, sf_dir):
    return search_store(_stored_and_updated(spark, sf_dir), PAGE_SIZE, PAGE_OFFSET, company=PAGE_COMPANY)[0]


@register("export_flow",
          f"SELECT CAST({O.q(S.SN)} AS VARCHAR) AS {O.q(S.SN)}, "
          + ", ".join(f"{_na(O.q(c))} AS {O.q(c)}" for c in _RT_COLS)
          + f" FROM ({_state_sql()}) s WHERE {O.q(S.EMAIL)} ILIKE '%{EXPORT_FILTERS['email']}%'")
def q_export_flow(spark, sf_dir):
    """Written as ordered CSV parts and read again; what a sheet would show as missing is null, as in the workbook."""
    out = scratch_path(spark, "export")
    export_store(_stored_and_updated(spark, sf_dir), out, fmt="csv", **EXPORT_FILTERS)
    rows = read_contacts(spark, out, "csv")
    return rows.select(qcol(S.SN), *[F.when(~qcol(c).isin(*NA_TOKENS), qcol(c)).alias(c) for c in _RT_COLS])


@register("export_workbook_flow",
          f"SELECT CAST({O.q(S.SN)} AS VARCHAR) AS {O.q(S.SN)}, "
          + ", ".join(f"{_na(O.q(c))} AS {O.q(c)}" for c in _RT_COLS)
          + f" FROM ({_state_sql()}) s WHERE {O.q(S.EMAIL)} ILIKE '%{EXPORT_FILTERS['email']}%'")
def q_export_workbook_flow(spark, sf_dir):
    out = scratch_path(spark, "export")
    export_store(_stored_and_updated(spark, sf_dir), out, **EXPORT_FILTERS)
    return read_workbooks(spark, out).frame.select(*[qcol(c) for c in [S.SN, *_RT_COLS]])


DEEP_WIDTH, DEEP_SHARE = 100, 0.8
_DEEP_FILTER = {"company": "building"}


def _deep_sql() -> str:
    state = _state_sql()
    where = f"{O.q(S.COMPANY)} ILIKE '%{_DEEP_FILTER['company']}%'"
    page = (lambda tag, cond: f"SELECT '{tag}' AS page, {O.q(S.SN)}, {O.q(S.EMAIL)}, {O.q(S.COMPANY)} FROM (SELECT *, "  # noqa: E731
            f"row_number() OVER (ORDER BY {O.q(S.SN)}) AS rn, count(*) OVER () AS n FROM ({state}) s WHERE {cond}) x "
            f"WHERE rn > CAST(floor({DEEP_SHARE} * n) AS BIGINT) AND rn <= CAST(floor({DEEP_SHARE} * n) AS BIGINT) + {PAGE_SIZE}")
    return page("all", "true") + " UNION ALL " + page("filtered", where)


@register("deep_page", _deep_sql())
def q_deep_page(spark, sf_dir):
    """The page that begins after four fifths of the table, and the same of a filter's matches."""
    index = PageIndex(spark, scratch_path(spark, "pages"), DEEP_WIDTH).build(_stored_and_updated(spark, sf_dir).read())
    filters = build_filters(**_DEEP_FILTER)
    counts = index.counts(filters)
    columns = [qcol(c) for c in (S.SN, S.EMAIL, S.COMPANY)]
    deep = index.page(PAGE_SIZE, int(DEEP_SHARE * index.total())).select(F.lit("all").alias("page"), *columns)
    return deep.unionByName(index.page(PAGE_SIZE, int(DEEP_SHARE * index.total(counts)), filters, counts).select(
        F.lit("filtered").alias("page"), *columns))


SUBSTRINGS = {"email": "user12", "company": "ildin"}


@register("substring_search", f"SELECT {O.q(S.SN)}, {O.q(S.EMAIL)}, {O.q(S.COMPANY)} FROM ({_state_sql()}) s WHERE "
          f"{O.q(S.EMAIL)} ILIKE '%{SUBSTRINGS['email']}%' AND {O.q(S.COMPANY)} ILIKE '%{SUBSTRINGS['company']}%'")
def q_substring_search(spark, sf_dir):
    table = _stored_and_updated(spark, sf_dir).read()
    index = TrigramIndex(spark, scratch_path(spark, "trigrams")).build(table, [S.EMAIL, S.COMPANY])
    return index.search(table, build_filters(**SUBSTRINGS)).select(*[qcol(c) for c in (S.SN, S.EMAIL, S.COMPANY)])


_CSV_NOTE = "o_orderstatus || '{0}said \"' || CAST(o_custkey AS VARCHAR) || '\",{0}' || o_orderpriority"


@register("csv_input", " UNION ALL ".join(
    f"SELECT '{tag}' AS file, CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, "
    f"{_CSV_NOTE.format(gap)} AS note FROM orders" for tag, gap in (("plain", " "), ("lines", "\n"))))
def q_csv_input(spark, sf_dir):
    """``orders`` as CSV, once plain and once with line breaks inside quotes, read by splits of a file."""
    orders, found = read_table(spark, sf_dir, "orders"), []
    for tag, gap in (("plain", " "), ("lines", "\n")):
        out = scratch_path(spark, "csv")
        note = F.concat("o_orderstatus", F.lit(f'{gap}said "'), F.col("o_custkey").cast("string"), F.lit(f'",{gap}'), "o_orderpriority")
        write_parts(orders.select("o_orderkey", "o_custkey", note.alias("note")), out, "csv")
        found.append(read_contacts(spark, out, "csv").select(F.lit(tag).alias("file"), "o_orderkey", "o_custkey", "note"))
    return found[0].unionByName(found[1])


@register("statistics_flow",
          f"SELECT count(*) AS total_records, count(*) FILTER (WHERE {O.q(S.UPDATED)} >= '2024-01-27T00:00:00Z') "
          f"AS recent_updates, (SELECT count(*) FROM (DESCRIBE {_state_sql()})) AS total_columns "
          f"FROM ({_state_sql()}) s")
def q_statistics_flow(spark, sf_dir):
    return store_statistics(spark, _stored_and_updated(spark, sf_dir), STATISTICS_AT)[0]


@register("first_rows", f"SELECT * FROM ({_state_sql()}) s ORDER BY {O.q(S.SN)} LIMIT {FIRST_ROWS}")
def q_first_rows(spark, sf_dir):
    return first_n(_stored_and_updated(spark, sf_dir).read(), FIRST_ROWS)


@register("store_lookup", f"SELECT * FROM ({_state_sql()}) s WHERE {O.q(S.EMAIL)} = '{LOOKUP_EMAIL}'")
def q_store_lookup(spark, sf_dir):
    return _stored_and_updated(spark, sf_dir).lookup(LOOKUP_EMAIL)


_WEB = f"trim(c.{O.q(S.WEBSITE)})"


@register("company_request",
          f"WITH d AS (SELECT c._row_id, {O.d_domain(_WEB)} AS domain FROM ({O.deduped_contacts_sql()}) c "
          f"WHERE {_WEB} <> ''), n AS (SELECT domain, row_number() OVER (ORDER BY _row_id) - 1 AS rn FROM d "
          f"WHERE domain IS NOT NULL) SELECT rn // 10 AS batch_id, '{{\"domains\":[' || "
          f"string_agg('\"' || domain || '\"', ',' ORDER BY rn) || ']}}' AS payload FROM n GROUP BY rn // 10")
def q_company_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_batches(contacts(spark, sf_dir), "companies")


# ------------------------------------------------------- counters, rejected batches, stored replies and pages

@register("scrape_summary", f"SELECT count(*) AS total_processed, count(*) FILTER (WHERE NOT saved) AS skipped_no_email "
          f"FROM ({_scrape_sql()}) s")
def q_scrape_summary(spark, sf_dir):
    """Counters of a run with rows that have no e-mail."""
    store = TruthStore(spark, scratch_path(spark, "scrape"))
    run = ingest_pages(spark, read_table(spark, sf_dir, "pages"), store, partial(primary_extractor, mail=True),
                       fallback_extractor, now=UPSERT_NOW, keep_rows_without_email=True)
    names = ("total_processed", "skipped_no_email")
    return spark.createDataFrame([tuple(run.summary[n] for n in names)], ", ".join(f"{n} long" for n in names))


UNKNOWN_COLUMN = "Shoe Size"


@register("upsert_reject",
          f"WITH i AS ({O.incoming_sql()}), s AS ({_stored_sql()}) SELECT _row_id, email AS {O.q(S.EMAIL)}, CASE WHEN email IS NULL "
          f"OR email = '' OR _row_id % 3 = 0 OR email NOT IN (SELECT email FROM s) THEN 'failed' ELSE 'skip' END AS action FROM i")
def q_upsert_reject(spark, sf_dir):
    """A batch with a column that the table doesn't know: nothing is written, records that bring something fail."""
    batch = incoming_updates(spark, sf_dir).select("_row_id", qcol(S.EMAIL), F.when(F.col("_row_id") % 3 == 0, "42").otherwise(
        "").alias(UNKNOWN_COLUMN))
    res = upsert(stored_truth(spark, sf_dir), batch, now=UPSERT_NOW)
    failed, skipped = (touched_emails(res, a).withColumn("action", F.lit(a)) for a in ("failed", "skip"))
    return failed.unionByName(skipped)


@register("stored_responses", MAP_COMPANY_SQL)
def q_stored_responses(spark, sf_dir):
    """Provider replies stored as JSON lines, ten matches each, read and put to their requests by batch and place."""
    asked = with_batches(company_provider(spark, sf_dir), ["domain"], 10).withColumn("reply", F.to_json("organization"))
    replies = asked.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("pos", "reply"))).alias("replies"))
    line = F.concat(F.lit('{"batch_id":'), F.col("batch_id").cast("string"), F.lit(',"matches":['),
                    F.array_join(F.transform("replies", lambda x: x["reply"]), ","), F.lit("]}"))
    path = scratch_path(spark, "replies")
    replies.select(line.alias("value")).write.text(path)
    zipped = zip_responses(asked.select("domain", "batch_id", "pos"), read_responses(spark, path, "companies"))
    return zipped.select("domain", *[v.alias(k) for k, v in map_company(F.col("match"))])


@register("stored_pages", "SELECT page_id, url, length(html) AS n_chars, html LIKE '%</article>%' AS article FROM pages")
def q_stored_pages(spark, sf_dir):
    path = scratch_path(spark, "pages")
    read_table(spark, sf_dir, "pages").write.json(path)
    return read_pages(spark, path, "json").select("page_id", "url", F.length("html").cast("long").alias("n_chars"),
                                                  F.col("html").contains("</article>").alias("article"))


KEYSET_PAGE, KEYSET_SIZE = 3, 25


@register("page_after", " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{tag}' AS page, {O.q(S.SN)}, {O.q(S.EMAIL)} FROM ({_state_sql()}) s ORDER BY {O.q(S.SN)} "
    f"LIMIT {KEYSET_SIZE} OFFSET {offset}) x"
    for tag, offset in (("by number", (KEYSET_PAGE - 1) * KEYSET_SIZE), ("after it", KEYSET_PAGE * KEYSET_SIZE))))
def q_page_after(spark, sf_dir):
    """A page by its number, and the one that follows its last ``S.N.``."""
    table = _stored_and_updated(spark, sf_dir).read()
    third = page(table, KEYSET_PAGE, KEYSET_SIZE)
    last = third.agg(F.max(qcol(S.SN))).first()[0]
    both = [third.select(F.lit("by number").alias("page"), qcol(S.SN), qcol(S.EMAIL)),
            search_after(table, None, last, KEYSET_SIZE).select(F.lit("after it").alias("page"), qcol(S.SN), qcol(S.EMAIL))]
    return both[0].unionByName(both[1])
