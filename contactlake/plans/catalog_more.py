"""Registered queries, part two: upsert, enrichment, extraction, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators.columns import qcol
from ..operators.dedupe import dedupe_by_email
from ..operators.stats import run_summary
from ..operators.upsert import upsert
from . import oracle as O
from .catalog import STORED_AT, UPSERT_NOW, normalized_contacts, register
from .derived import incoming_updates
from ..functions.provider import company_columns, map_company, map_person, person_columns
from ..operators.enrich import enrich_records
from ..operators.keys import with_batches
from ..operators.enrich import people_request_col
from ..functions.text import has_value
from .derived import duck_sql
from .provider_fixtures import (COMPANIES_SQL, PEOPLE_SQL, company_callable, company_provider,
                                people_callable, people_provider)
from ..operators.extract import extract_contacts, items_to_contacts, parse_reply
from .derived import read_table, spark_sql
from .extract_fixtures import (EXTRACT_ORACLE, PARSED_ITEMS_ORACLE, REPLIES_SQL,
                               fallback_extractor, primary_extractor)
from ..operators.columns import column_catalog, map_columns
from ..operators.search import build_filters, export_frame, lookup
from ..operators.stats import statistics
from ..session import scratch_path
from ..sources.store import TruthStore, empty_truth
from ..sources.workbook import NA_TOKENS, export_workbooks, read_workbooks
from ..streaming import upsert_stream
from .catalog import _CONTACTS_SN_SQL, _contacts_with_sn, _d_mask
from .derived import raw_contacts

SENIORITY = S.DEFAULT_PREFIXES.person + "Seniority"
NEW_SEGMENT = "HOUSEHOLD"  # contacts of this segment are not yet stored


def to_truth(df: DataFrame, sn, updated: str) -> DataFrame:
    """Project contact rows onto the base truth schema (missing -> NULL)."""
    cols = []
    for c in S.BASE_COLUMNS:
        if c == S.SN:
            cols.append(sn.cast("long").alias(S.SN))
        elif c == S.UPDATED:
            cols.append(F.lit(updated).alias(S.UPDATED))
        elif c in df.columns:
            cols.append(qcol(c).cast("string").alias(c))
        else:
            cols.append(F.lit(None).cast("string").alias(c))
    return df.select(*cols)


def stored_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    contacts = dedupe_by_email(normalized_contacts(spark, sf_dir))[0]
    stored = contacts.where(qcol(S.CLIENT_TYPE) != F.lit(NEW_SEGMENT))
    return to_truth(stored, F.col("_row_id") + 1, STORED_AT)


def upsert_scenario(spark: SparkSession, sf_dir: str):
    """Stored contacts published as a snapshot (as the table lives in
    production), then the order-derived batch upserted into it."""
    from ..session import scratch_path
    from ..sources.store import TruthStore

    store = TruthStore(spark, scratch_path(spark, "truth"))
    store.commit(stored_truth(spark, sf_dir))
    return upsert(store.read(), incoming_updates(spark, sf_dir), now=UPSERT_NOW, max_sn=store.max_sn())


# ----------------------------------------------------------------- oracle text

_NORMALIZED = {S.EMAIL, S.FIRST, S.LAST, S.COMPANY, S.WEBSITE, S.TITLE, S.PERSON_PHONE,
               S.COUNTRY, S.STATE, S.EMAIL_SEND, S.CLIENT_TYPE, S.LEAD_SOURCE}
_INCOMING = {S.FIRST: "fname", S.TITLE: "title", S.INDUSTRY: "industry",
             S.EMPLOYEES: "employees", SENIORITY: "seniority"}
_MERGE = [c for c in S.BASE_COLUMNS if c not in S.UPSERT_SPECIAL] + [SENIORITY]


def _stored_sql() -> str:
    q = O.q
    cols = ", ".join(f"{q(c) if c in _NORMALIZED else 'CAST(NULL AS VARCHAR)'} AS m{i}"
                     for i, c in enumerate(_MERGE))
    return (f"SELECT _row_id + 1 AS sn, {q(S.EMAIL)} AS email, '{STORED_AT}' AS upd, "
            f"{q(S.EMAIL_SEND)} AS es, {cols} FROM ({O.deduped_contacts_sql()}) d "
            f"WHERE {q(S.CLIENT_TYPE)} <> '{NEW_SEGMENT}'")


def _orders_incoming_sql(offset: int = 0) -> str:
    cols = ", ".join(f"{_INCOMING[c] if c in _INCOMING else 'CAST(NULL AS VARCHAR)'} AS m{i}"
                     for i, c in enumerate(_MERGE))
    return f"SELECT _row_id + {offset} AS _row_id, email, email_send, {cols} FROM ({O.incoming_sql()}) i"


def _contacts_incoming_sql(deduped: bool = False) -> str:
    q = O.q
    cols = ", ".join(f"{q(c) if c in _NORMALIZED else 'CAST(NULL AS VARCHAR)'} AS m{i}"
                     for i, c in enumerate(_MERGE))
    src = O.deduped_contacts_sql() if deduped else O.normalized_contacts_sql()
    return (f"SELECT _row_id, {q(S.EMAIL)} AS email, {q(S.EMAIL_SEND)} AS email_send, {cols} "
            f"FROM ({src}) n")


_NO_STORED = ("SELECT CAST(NULL AS BIGINT) AS sn, CAST(NULL AS VARCHAR) AS email, "
              "CAST(NULL AS VARCHAR) AS upd, CAST(NULL AS VARCHAR) AS es, "
              + ", ".join(f"CAST(NULL AS VARCHAR) AS m{i}" for i in range(len(_MERGE))) + " WHERE false")


def _upsert_ctes(stored: str | None = None, incoming: str | None = None) -> str:
    """Set-wise restatement of the fold for DuckDB over generic inputs:
    stored (sn, email, upd, es, m0..) and incoming (_row_id, email,
    email_send, m0..)."""
    stored = stored or _stored_sql()
    incoming = incoming or _orders_incoming_sql()
    m = [f"m{i}" for i in range(len(_MERGE))]
    per_col = ", ".join(
        f"min(ord) FILTER (WHERE {x} IS NOT NULL AND {x} <> '') AS o_{x}, "
        f"arg_min({x}, ord) FILTER (WHERE {x} IS NOT NULL AND {x} <> '') AS v_{x}, "
        f"arg_min_null({x}, ord) AS f_{x}" for x in m)
    srcs = ", ".join(f"o_{x}" for x in m)
    return f"""
stored AS ({stored}),
incoming AS ({incoming}),
inc AS (SELECT * FROM incoming WHERE email IS NOT NULL AND email <> ''),
keys AS (SELECT DISTINCT email FROM inc),
allrows AS (
  SELECT email, -1 AS ord, sn, upd, es, {', '.join(m)} FROM stored WHERE email IN (SELECT email FROM keys)
  UNION ALL
  SELECT email, _row_id AS ord, NULL, NULL, email_send, {', '.join(m)} FROM inc),
agg AS (
  SELECT email, min(ord) AS first_ord, min(ord) < 0 AS has_stored,
         arg_min_null(sn, ord) AS sn, arg_min_null(upd, ord) AS upd, arg_min_null(es, ord) AS es,
         {per_col}
  FROM allrows GROUP BY email),
flags AS (
  SELECT *, list_filter([{srcs}], lambda x: x IS NOT NULL AND x >= 0) AS srcs,
         CASE WHEN NOT has_stored THEN first_ord END AS ins FROM agg),
newsn AS (
  SELECT email, coalesce((SELECT max(sn) FROM stored), 0) + row_number() OVER (ORDER BY first_ord) AS nsn
  FROM flags WHERE NOT has_stored)
"""


def _state_sql(stored: str | None = None, incoming: str | None = None, now: str = UPSERT_NOW,
               extra: tuple[str, ...] = (SENIORITY,)) -> str:
    q = O.q
    touched_cols, untouched_cols = [], []
    for c in S.BASE_COLUMNS + list(extra):
        if c == S.SN:
            touched_cols.append(f"coalesce(f.sn, n.nsn) AS {q(c)}")
            untouched_cols.append(f"sn AS {q(c)}")
        elif c == S.EMAIL:
            touched_cols.append(f"f.email AS {q(c)}")
            untouched_cols.append(f"email AS {q(c)}")
        elif c == S.EMAIL_SEND:
            touched_cols.append(f"f.es AS {q(c)}")
            untouched_cols.append(f"es AS {q(c)}")
        elif c == S.UPDATED:
            touched_cols.append(f"CASE WHEN NOT f.has_stored OR len(f.srcs) > 0 THEN '{now}' "
                                f"ELSE f.upd END AS {q(c)}")
            untouched_cols.append(f"upd AS {q(c)}")
        else:
            x = f"m{_MERGE.index(c)}"
            touched_cols.append(f"coalesce(f.v_{x}, f.f_{x}) AS {q(c)}")
            untouched_cols.append(f"{x} AS {q(c)}")
    return (f"WITH {_upsert_ctes(stored, incoming)} "
            f"SELECT {', '.join(touched_cols)} FROM flags f LEFT JOIN newsn n ON f.email = n.email "
            f"UNION ALL SELECT {', '.join(untouched_cols)} FROM stored "
            f"WHERE email NOT IN (SELECT email FROM keys)")


def _outcomes_sql() -> str:
    return (f"WITH {_upsert_ctes()}, "
            f"winners AS (SELECT unnest(list_distinct(list_concat(srcs, "
            f"CASE WHEN ins IS NULL THEN [] ELSE [ins] END))) AS _row_id, ins FROM flags) "
            f"SELECT i._row_id, i.email AS {O.q(S.EMAIL)}, "
            f"coalesce(CASE WHEN w._row_id = w.ins THEN 'insert' WHEN w._row_id IS NOT NULL "
            f"THEN 'update' END, 'skip') AS action, CAST(NULL AS VARCHAR) AS error "
            f"FROM inc i LEFT JOIN winners w ON i._row_id = w._row_id "
            f"UNION ALL SELECT _row_id, email, 'failed', '{S.EMAIL_REQUIRED}' FROM incoming "
            f"WHERE email IS NULL OR email = ''")


_STATS_SQL = (f"SELECT count(*) FILTER (WHERE action = 'insert') AS inserted, "
              f"count(*) FILTER (WHERE action = 'update') AS updated, "
              f"count(*) FILTER (WHERE action = 'skip') AS skipped, "
              f"count(*) FILTER (WHERE action = 'failed') AS failed FROM ({_outcomes_sql()}) o")

_SUMMARY_SQL = (f"SELECT count(*) AS total_processed, count(*) FILTER (WHERE action = 'insert') AS new_inserts, "
                f"count(*) FILTER (WHERE action = 'update') AS updates, "
                f"count(*) FILTER (WHERE action = 'skip') AS skipped, "
                f"count(*) FILTER (WHERE action = 'failed') AS failed FROM ({_outcomes_sql()}) o")


@register("upsert_state", _state_sql())
def q_upsert_state(spark, sf_dir):
    return upsert_scenario(spark, sf_dir).state


@register("upsert_outcomes", _outcomes_sql())
def q_upsert_outcomes(spark, sf_dir):
    return upsert_scenario(spark, sf_dir).outcomes


@register("upsert_stats", _STATS_SQL)
def q_upsert_stats(spark, sf_dir):
    return upsert_scenario(spark, sf_dir).stats


@register("run_summary", _SUMMARY_SQL)
def q_run_summary(spark, sf_dir):
    return run_summary(upsert_scenario(spark, sf_dir).outcomes)


# ================================================================= enrichment


P = S.DEFAULT_PREFIXES.person
C = S.DEFAULT_PREFIXES.company


def contacts(spark, sf_dir):
    return dedupe_by_email(normalized_contacts(spark, sf_dir))[0]


def _nz(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL AND {x} <> '' THEN trim({x}) END"


def _flat(items: str) -> str:
    return f"array_to_string(list_filter([{items}], lambda x: x IS NOT NULL AND x <> ''), ', ')"


def _person_d(a: str) -> dict[str, str]:
    m = f"{a}.email IS NOT NULL"
    d = {
        S.FIRST: _nz(f"{a}.first_name"), S.LAST: _nz(f"{a}.last_name"), S.TITLE: _nz(f"{a}.title"),
        S.EMAIL: _nz(f"{a}.new_email"), S.PERSON_LINKEDIN: _nz(f"{a}.linkedin_url"),
        S.COUNTRY: _nz(f"{a}.country"), S.STATE: _nz(f"{a}.state"),
        S.PERSON_PHONE: _nz(f"{a}.phone0"),
        P + "Email Status": _nz(f"{a}.email_status"), P + "Headline": _nz(f"{a}.headline"),
        P + "Seniority": _nz(f"{a}.seniority"),
        P + "Departments": _flat(f"{a}.dept0, {a}.dept1"),
        P + "Subdepartments": "NULL", P + "Functions": "NULL", P + "Photo URL": "NULL",
        P + "Twitter URL": "NULL", P + "Github URL": "NULL", P + "Facebook URL": "NULL",
        P + "Is Likely To Engage": f"CASE WHEN {a}.engage IS NULL THEN NULL WHEN {a}.engage THEN 'Yes' ELSE 'No' END",
        P + "Current Org": _nz(f"{a}.hist_org"), P + "Current Role Start Date": _nz(f"{a}.hist_start"),
    }
    return {k: f"(CASE WHEN {m} THEN {v} END)" for k, v in d.items()}


_ORG_COLS = company_columns()


def _emb_d(a: str) -> dict[str, str]:
    m = f"({a}.email IS NOT NULL AND {a}.org_name <> '')"
    d = {c: "NULL" for c in _ORG_COLS}
    d.update({S.COMPANY: _nz(f"{a}.org_name"), S.INDUSTRY: _nz(f"{a}.org_industry"), S.LISTED: "'No'"})
    return {k: f"(CASE WHEN {m} THEN {v} END)" for k, v in d.items()}


def _number(x: str) -> str:
    return f"CASE WHEN {x} <> '' AND coalesce(TRY_CAST({x} AS DOUBLE) <> 0, true) THEN {x} END"


def _org_d(a: str) -> dict[str, str]:
    m = f"{a}.domain IS NOT NULL"
    d = {c: "NULL" for c in _ORG_COLS}
    d.update({
        S.COMPANY: _nz(f"{a}.name"),
        S.INDUSTRY: f"coalesce({_nz(a + '.industry')}, trim({a}.industry0))",
        S.WEBSITE: f"'https://' || {a}.domain",
        S.EMPLOYEES: _number(f"{a}.employees"),
        S.COMPANY_PHONE: f"coalesce({_nz(a + '.phone')}, {_nz(a + '.account_phone')})",
        S.ADDRESS: (f"CASE WHEN {a}.raw_address <> '' THEN {a}.raw_address "
                    f"WHEN {a}.city <> '' OR {a}.ostate <> '' OR {a}.ocountry <> '' "
                    f"THEN {_flat(f'{a}.city, {a}.ostate, {a}.ocountry')} END"),
        S.LISTED: f"CASE WHEN {a}.symbol <> '' THEN 'Yes' ELSE 'No' END",
        S.REVENUE: (f"CASE WHEN {a}.revenue <> '' AND coalesce(TRY_CAST({a}.revenue AS DOUBLE) <> 0, true) "
                    f"THEN {a}.revenue WHEN {a}.annual_revenue <> '' AND "
                    f"coalesce(TRY_CAST({a}.annual_revenue AS DOUBLE) <> 0, true) THEN {a}.annual_revenue END"),
        C + "Primary Domain": _nz(f"{a}.domain"),
        C + "Founded Year": _number(f"{a}.founded"),
        C + "Keywords": _flat(f"{a}.kw0, {a}.kw1"),
        C + "Public Ticker": _nz(f"{a}.symbol"),
        C + "Department Headcount": (
            f"nullif({_flat(f'CASE WHEN {a}.dept_sales <> 0 THEN ' + chr(39) + 'sales: ' + chr(39) + f' || CAST({a}.dept_sales AS VARCHAR) END, CASE WHEN {a}.dept_finance <> 0 THEN ' + chr(39) + 'finance: ' + chr(39) + f' || CAST({a}.dept_finance AS VARCHAR) END')}, '')"),
    })
    return {k: f"(CASE WHEN {m} THEN {v} END)" for k, v in d.items()}


_CONTACT_COLS = [S.EMAIL, S.FIRST, S.LAST, S.COMPANY, S.WEBSITE, S.TITLE, S.PERSON_PHONE,
                 S.COUNTRY, S.STATE, S.EMAIL_SEND, S.CLIENT_TYPE, S.LEAD_SOURCE]


def _hv(x: str) -> str:
    return f"({x} IS NOT NULL AND {x} <> '')"


def _enrich_sql(people: bool, orgs: bool) -> str:
    q = O.q
    pers = {**_emb_d("p"), **{k: v for k, v in _person_d("p").items()}} if people else {}
    if people:
        emb, pd_ = _emb_d("p"), _person_d("p")
        pers = {}
        for c in list(emb) + [k for k in pd_ if k not in emb]:
            parts = [x for x in (emb.get(c), pd_.get(c)) if x is not None]
            pers[c] = parts[0] if len(parts) == 1 else f"coalesce({', '.join(parts)})"
    org = _org_d("o") if orgs else {}

    def orig(c):
        return f"c.{q(c)}" if c in _CONTACT_COLS else "CAST(NULL AS VARCHAR)"

    def keep(c):
        return orig(c) if c in _CONTACT_COLS else "''"

    people_val = {c: f"(CASE WHEN {_hv(v)} THEN {v} ELSE {keep(c)} END)" for c, v in pers.items()}
    final = {}
    for c in list(dict.fromkeys(list(people_val) + list(org))):
        p_c = people_val.get(c, keep(c))
        if not orgs:
            final[c] = p_c
            continue
        fallback = f"(CASE WHEN {_hv(orig(c))} THEN {orig(c)} ELSE {p_c} END)" if people else p_c
        if c in org:
            o = org[c]
            final[c] = (f"(CASE WHEN {o} IS NOT NULL THEN (CASE WHEN {o} <> '' THEN {o} ELSE {p_c} END) "
                        f"ELSE {fallback} END)")
        else:
            final[c] = fallback
    sel = ["c._row_id"]
    for c in _CONTACT_COLS:
        sel.append(f"{final[c]} AS {q(c)}" if c in final else f"c.{q(c)}")
    for c, v in final.items():
        if c not in _CONTACT_COLS:
            sel.append(f"{v} AS {q(c)}")
    sel.append(f"'' AS {q('_enrichment_error')}")
    joins = ""
    if people:
        joins += f" LEFT JOIN ({duck_sql(PEOPLE_SQL)}) p ON p.email = c.{q(S.EMAIL)}"
    if orgs:
        dom = O.d_domain(f"trim(c.{q(S.WEBSITE)})")
        joins += (f" LEFT JOIN ({duck_sql(COMPANIES_SQL)}) o ON o.domain = "
                  f"(CASE WHEN trim(c.{q(S.WEBSITE)}) <> '' THEN {dom} END)")
    return f"SELECT {', '.join(sel)} FROM ({O.deduped_contacts_sql()}) c{joins}"


@register("enrich_people", _enrich_sql(True, False))
def q_enrich_people(spark, sf_dir):
    return enrich_records(contacts(spark, sf_dir), people_provider(spark, sf_dir), None).frame


@register("enrich_companies", _enrich_sql(False, True))
def q_enrich_companies(spark, sf_dir):
    return enrich_records(contacts(spark, sf_dir), None, company_provider(spark, sf_dir)).frame


@register("enrich_both_precedence", _enrich_sql(True, True))
def q_enrich_both(spark, sf_dir):
    return enrich_records(contacts(spark, sf_dir), people_provider(spark, sf_dir),
                          company_provider(spark, sf_dir)).frame


@register("enrich_counts",
          f"SELECT count(*) AS people_enriched, count(o.domain) AS orgs_enriched_matched, "
          f"count(*) AS orgs_enriched, count(*) FILTER (WHERE trim(c.{O.q(S.WEBSITE)}) = '') "
          f"AS orgs_skipped_no_domain FROM ({O.deduped_contacts_sql()}) c LEFT JOIN "
          f"({duck_sql(COMPANIES_SQL)}) o ON o.domain = (CASE WHEN trim(c.{O.q(S.WEBSITE)}) <> '' "
          f"THEN {O.d_domain('trim(c.' + O.q(S.WEBSITE) + ')')} END)")
def q_enrich_counts(spark, sf_dir):
    e = enrich_records(contacts(spark, sf_dir), people_provider(spark, sf_dir), company_provider(spark, sf_dir))
    return e.full.agg(
        F.count_if(F.col("__people_ok")).alias("people_enriched"),
        F.count_if(has_value(qcol(S.DEFAULT_PREFIXES.company + "Primary Domain"))).alias("orgs_enriched_matched"),
        F.count_if(F.col("__org_ok")).alias("orgs_enriched"),
        F.count_if(F.col("__no_domain")).alias("orgs_skipped_no_domain"))


@register("map_person", "SELECT email, " + ", ".join(
    f"{v} AS {O.q(k)}" for k, v in _person_d("p").items()) + f" FROM ({duck_sql(PEOPLE_SQL)}) p")
def q_map_person(spark, sf_dir):
    prov = people_provider(spark, sf_dir)
    return prov.select("email", *[v.alias(k) for k, v in map_person(F.col("person"))])


MAP_COMPANY_SQL = "SELECT domain, " + ", ".join(
    f"{v} AS {O.q(k)}" for k, v in _org_d("o").items()) + f" FROM ({duck_sql(COMPANIES_SQL)}) o"


@register("map_company", MAP_COMPANY_SQL)
def q_map_company(spark, sf_dir):
    prov = company_provider(spark, sf_dir)
    return prov.select("domain", *[v.alias(k) for k, v in map_company(F.col("organization"))])


def _req_json_sql(a: str) -> str:
    q = O.q
    f, l_, w, co, e = (f"{a}.{q(x)}" for x in (S.FIRST, S.LAST, S.WEBSITE, S.COMPANY, S.EMAIL))
    parts = [f"CASE WHEN {_hv(f)} THEN '\"first_name\":' || to_json({f})::VARCHAR END",
             f"CASE WHEN {_hv(l_)} THEN '\"last_name\":' || to_json({l_})::VARCHAR END",
             f"CASE WHEN {_hv(w)} THEN '\"organization_domain\":' || to_json({w})::VARCHAR END",
             f"CASE WHEN NOT {_hv(w)} AND {_hv(co)} THEN '\"organization_name\":' || to_json({co})::VARCHAR END",
             f"CASE WHEN {_hv(e)} THEN '\"email\":' || to_json({e})::VARCHAR END"]
    return f"'{{' || array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), ',') || '}}'"


@register("people_request",
          f"SELECT _row_id, (row_number() OVER (ORDER BY _row_id) - 1) // 10 AS batch_id, "
          f"(row_number() OVER (ORDER BY _row_id) - 1) % 10 AS pos, {_req_json_sql('c')} AS request "
          f"FROM ({O.deduped_contacts_sql()}) c")
def q_people_request(spark, sf_dir):
    df = contacts(spark, sf_dir)
    req = df.select("_row_id", F.to_json(people_request_col(df)).alias("request"))
    return with_batches(req, ["_row_id"], S.MAX_PROVIDER_BATCH)


# ================================================================= extraction



@register("parse_items", PARSED_ITEMS_ORACLE)
def q_parse_items(spark, sf_dir):
    replies = spark_sql(spark, sf_dir, REPLIES_SQL, ["supplier", "nation"])
    return parse_reply(replies)


@register("extract_contacts", EXTRACT_ORACLE)
def q_extract_contacts(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    return extract_contacts(pages, primary_extractor, fallback_extractor)


# ================================================================= sources, sinks, streaming, flows


SOURCE2_OFFSET = 1 << 40  # second source's rows come after every row of the first
LOOKUP_EMAIL = "user3@example.com"
EXPORT_FILTERS = {"email": "user1"}


def _na(x: str) -> str:
    toks = ", ".join("'" + t.replace("'", "''") + "'" for t in sorted(NA_TOKENS))
    return f"CASE WHEN {x} IN ({toks}) THEN NULL ELSE {x} END"


_RT_COLS = [S.EMAIL, S.FIRST, S.LAST, S.COMPANY, S.WEBSITE, S.TITLE, S.PERSON_PHONE, S.COUNTRY,
            S.STATE, S.EMAIL_SEND, S.CLIENT_TYPE, S.LEAD_SOURCE]


@register("workbook_roundtrip",
          "SELECT row_number() OVER (ORDER BY t." + O.q(S.SN) + ") - 1 AS _row_id, "
          + f"CAST(t.{O.q(S.SN)} AS VARCHAR) AS {O.q(S.SN)}, "
          + ", ".join(f"{_na('t.' + O.q(c))} AS {O.q(c)}" for c in _RT_COLS)
          + f" FROM ({_CONTACTS_SN_SQL}) t")
def q_workbook_roundtrip(spark, sf_dir):
    frame = _contacts_with_sn(spark, sf_dir).drop("_row_id")
    out = scratch_path(spark, "workbooks")
    export_workbooks(frame, out, rows_per_part=500)
    return read_workbooks(spark, out).frame.drop("_file")


@register("stream_upsert", _state_sql())
def q_stream_upsert(spark, sf_dir):
    root = scratch_path(spark, "stream")
    store = TruthStore(spark, root + "/truth")
    store.commit(stored_truth(spark, sf_dir))
    inc = incoming_updates(spark, sf_dir)
    inc.repartitionByRange(3, "_row_id").write.parquet(root + "/incoming")
    stream = spark.readStream.schema(inc.schema).parquet(root + "/incoming")
    upsert_stream(stream, store, root + "/checkpoint", now=UPSERT_NOW).awaitTermination()
    return store.read()


@register("consolidate_sources",
          _state_sql(_NO_STORED, f"{_contacts_incoming_sql()} UNION ALL {_orders_incoming_sql(SOURCE2_OFFSET)}"))
def q_consolidate(spark, sf_dir):
    first = normalized_contacts(spark, sf_dir)
    second = incoming_updates(spark, sf_dir).withColumn("_row_id", F.col("_row_id") + F.lit(SOURCE2_OFFSET))
    both = first.unionByName(second, allowMissingColumns=True)
    return upsert(empty_truth(spark), both, now=UPSERT_NOW).state


@register("ingest_base_flow", _state_sql(_NO_STORED, _contacts_incoming_sql(deduped=True), extra=()))
def q_ingest_base_flow(spark, sf_dir):
    from .flows import ingest_base

    root = scratch_path(spark, "ingest")
    raw = raw_contacts(spark, sf_dir)
    raw.repartitionByRange(4, "_row_id").sortWithinPartitions("_row_id").drop("_row_id") \
        .write.parquet(root + "/upload")
    store = TruthStore(spark, root + "/truth")
    ingest_base(spark, root + "/upload", store, now=UPSERT_NOW, fmt="parquet")
    return store.read()


def _catalog_sql() -> str:
    fam = S.DEFAULT_PREFIXES.family()
    return (f"WITH c AS (SELECT column_name AS name, row_number() OVER () AS pos FROM (DESCRIBE {_state_sql()})) "
            f"SELECT name, CASE WHEN starts_with(name, '{fam}') THEN 'provider' ELSE 'base' END AS kind, "
            f"CAST(CASE WHEN starts_with(name, '{fam}') "
            f"THEN (SELECT count(*) FROM c WHERE NOT starts_with(name, '{fam}')) - 1 + "
            f"row_number() OVER (PARTITION BY starts_with(name, '{fam}') ORDER BY name) "
            f"ELSE row_number() OVER (PARTITION BY starts_with(name, '{fam}') ORDER BY pos) - 1 END AS INTEGER) "
            f"AS ordinal FROM c")


@register("column_catalog", _catalog_sql())
def q_column_catalog(spark, sf_dir):
    return column_catalog(spark, upsert_scenario(spark, sf_dir).state)


@register("lookup", f"SELECT * FROM ({_state_sql()}) s WHERE {O.q(S.EMAIL)} = '{LOOKUP_EMAIL}'")
def q_lookup(spark, sf_dir):
    return lookup(upsert_scenario(spark, sf_dir).state, LOOKUP_EMAIL)


@register("export_slice", f"SELECT * FROM ({_state_sql()}) s WHERE {O.q(S.EMAIL)} ILIKE '%user1%' "
          f"ORDER BY {O.q(S.SN)}")
def q_export_slice(spark, sf_dir):
    return export_frame(upsert_scenario(spark, sf_dir).state, build_filters(**EXPORT_FILTERS))


@register("stats_recent_boundary",
          "SELECT count(*) AS total_records, count(*) FILTER (WHERE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') "
          ">= '2024-01-24 00:00:00') AS recent_updates, CAST(3 AS BIGINT) AS total_columns FROM events")
def q_stats_boundary(spark, sf_dir):
    from ..functions.text import format_utc

    ev = read_table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias(S.LEAD_SOURCE), format_utc(F.col("ts")).alias(S.UPDATED))
    return statistics(ev, "2024-01-31T00:00:00Z", boundary_day=True)


def _scrape_split_sql() -> str:
    q = O.q
    return (f"WITH e AS ({EXTRACT_ORACLE}), r AS (SELECT page_id * 1000000 + item_pos AS _row_id, "
            f"trim(firstName) AS f, trim(lastName) AS l, {O.d_company('trim(organization)')} AS c FROM e) "
            f"SELECT f AS {q(S.FIRST)}, l AS {q(S.LAST)}, c AS {q(S.COMPANY)} FROM r "
            f"QUALIFY row_number() OVER (PARTITION BY f, l, c ORDER BY _row_id) = 1")


@register("scrape_split", _scrape_split_sql())
def q_scrape_split(spark, sf_dir):
    from ..operators.dedupe import dedupe_by_name_company
    from ..operators.normalize import normalize
    from .flows import saved_and_skipped

    items = extract_contacts(read_table(spark, sf_dir, "pages"), primary_extractor, fallback_extractor)
    rows = normalize(items_to_contacts(items), lead_source=S.SCRAPE_LEAD_SOURCE)
    rows = dedupe_by_name_company(rows)[0]
    return saved_and_skipped(rows)[1]


def _errors_sql() -> str:
    def nb(c):
        return f"(raw.{c} IS NOT NULL AND trim(raw.{c}) <> '')"
    ident = f"({nb('email')} OR ({nb('fname')} AND {nb('lname')}) OR {nb('organization')} OR {nb('website')})"
    return (f"SELECT {_d_mask("coalesce(raw.email, 'Unknown')")} AS email, "
            f"'{S.SKIPPED_NO_IDENTIFIER}' AS message FROM ({O.raw_contacts_sql()}) raw WHERE NOT {ident}")


@register("enrichment_errors", _errors_sql())
def q_enrichment_errors(spark, sf_dir):
    from .flows import enrichment_errors

    mapped, _ = map_columns(raw_contacts(spark, sf_dir))
    e = enrich_records(mapped, people_provider(spark, sf_dir), None)
    return enrichment_errors(e.frame)


# ================================================================= batched provider calls



def _calls_sql(kind: str) -> str:
    q = O.q
    email, first, web = f"c.{q(S.EMAIL)}", f"c.{q(S.FIRST)}", f"c.{q(S.WEBSITE)}"
    cols = list(dict.fromkeys(company_columns() + person_columns())) if kind == "people" else company_columns()
    if kind == "people":
        matched = f"NOT ends_with({email}, '5@example.com')"
        set_vals = {S.TITLE: f"'Lead ' || CASE WHEN {first} <> '' THEN {first} ELSE '?' END",
                    S.DEFAULT_PREFIXES.person + "Seniority":
                        f"CASE WHEN length({email}) % 2 = 1 THEN 'senior' END",
                    S.DEFAULT_PREFIXES.person + "Departments": "'ops'"}
    else:
        dom = O.d_domain(f"trim({web})")
        matched = f"(trim({web}) <> '' AND {dom} IS NOT NULL AND NOT ends_with({dom}, '.net') AND length({dom}) <> 20)"
        set_vals = {S.COMPANY: f"upper(split_part({dom}, '.', 1))",
                    S.EMPLOYEES: f"CAST(length({dom}) AS VARCHAR) || CASE WHEN length({dom}) % 3 = 0 THEN ',000' ELSE '' END",
                    S.LISTED: f"CASE WHEN length({dom}) % 2 = 1 THEN 'Yes' ELSE 'No' END",
                    S.DEFAULT_PREFIXES.company + "Public Ticker": f"CASE WHEN length({dom}) % 2 = 1 THEN 'X' END"}
    sel = ["c._row_id"]
    for c in _CONTACT_COLS + [x for x in cols if x not in _CONTACT_COLS]:
        keep = f"c.{q(c)}" if c in _CONTACT_COLS else "''"
        if c in set_vals:
            v = set_vals[c]
            sel.append(f"CASE WHEN {matched} AND ({v}) IS NOT NULL AND ({v}) <> '' THEN {v} ELSE {keep} END AS {q(c)}")
        else:
            sel.append(f"{keep} AS {q(c)}")
    sel.append(f"'' AS {q('_enrichment_error')}")
    return f"SELECT {', '.join(sel)} FROM ({O.deduped_contacts_sql()}) c"


@register("enrich_people_calls", _calls_sql("people"))
def q_enrich_people_calls(spark, sf_dir):
    return enrich_records(contacts(spark, sf_dir), people_callable, None).frame


@register("enrich_companies_calls", _calls_sql("companies"))
def q_enrich_companies_calls(spark, sf_dir):
    return enrich_records(contacts(spark, sf_dir), None, company_callable).frame


@register("enrich_ledger", f"SELECT x.*, count(*) OVER () AS asked_first, CAST(0 AS BIGINT) AS asked_again FROM ({_calls_sql('people')}) x")
def q_enrich_ledger(spark, sf_dir):
    """Enrichment run twice with a ledger: the second run takes all replies from it."""
    from ..sources.replies import ReplyLedger

    ledger = ReplyLedger(spark, scratch_path(spark, "replies"))
    rows = contacts(spark, sf_dir)
    enrich_records(rows, people_callable, None, ledger=ledger)
    first = ledger.read().count()
    frame = enrich_records(rows, people_callable, None, ledger=ledger).frame
    again = ledger.read().count() - first
    return frame.withColumn("asked_first", F.lit(first).cast("long")).withColumn("asked_again", F.lit(again).cast("long"))
