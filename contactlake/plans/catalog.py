"""Registered queries: each runs one operator family on Spark over the given
tables, paired with an equivalent DuckDB statement used as the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as TX
from ..functions.json import json_path
from ..functions.url import extract_domain
from ..operators.columns import map_columns, qcol
from ..operators.dedupe import dedupe_by_email, dedupe_by_name_company, keep_first, keep_first_wide
from ..operators.keys import with_batches, with_serial
from ..operators.normalize import normalize
from ..operators.search import search, search_total
from ..operators.stats import by_lead_source, quality_profile, statistics
from . import oracle as O
from .derived import raw_contacts, read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# Fixed scenario parameters of the registered queries.
TRUNCATE_AT = 4096
SEARCH_FILTERS = {"company": "house", "email": "USER1"}
SEARCH_LIMIT, SEARCH_OFFSET = 50, 20
STATS_AS_OF = "2024-01-31T00:00:00Z"
UPSERT_NOW = "2024-02-01T00:00:00Z"
STORED_AT = "2024-01-01T00:00:00Z"


def normalized_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped, _ = map_columns(raw_contacts(spark, sf_dir))
    return normalize(mapped)


# ---------------------------------------------------------------- scalars

@register("domain_extract", f"SELECT page_id, {O.d_domain('url')} AS domain FROM pages")
def q_domain_extract(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", extract_domain("url").alias("domain"))


@register("domain_counts", f"SELECT domain, count(*) AS n FROM "
          f"(SELECT {O.d_domain('url')} AS domain FROM pages) GROUP BY domain")
def q_domain_counts(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    return pages.groupBy(extract_domain("url").alias("domain")).agg(F.count(F.lit(1)).alias("n"))


def _d_mask(text: str) -> str:
    # Unicode word boundaries emulated for RE2: the neighbour characters are
    # captured and written back; two passes catch e-mails that share one
    # separator character.
    email = (rf"(^|[^\p{{L}}\p{{N}}_])([a-zA-Z0-9])[a-zA-Z0-9._%+-]*@([a-zA-Z0-9])"
             rf"[a-zA-Z0-9.-]*\.[a-zA-Z]{{2,}}([^\p{{L}}\p{{N}}_]|$)")
    t = text
    for _ in range(2):
        t = f"regexp_replace({t}, '{email}', '\\1\\2***@\\3***.com\\4', 'g')"
    mask = ("CASE WHEN length(regexp_replace(p, '[^0-9]', '', 'g')) >= 4 "
            "THEN regexp_replace(left(p, length(p) - 2), '[0-9]', '*', 'g') || right(p, 2) "
            "ELSE repeat('*', length(p)) END")
    for pat in [r"\+\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}",
                r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
                r"\d{3}[-.\s]?\d{3}[-.\s]?\d{4}"]:
        t = (f"list_reduce(list_prepend({t}, regexp_extract_all({t}, '{pat}')), "
             f"lambda a, p: replace(a, p, {mask}))")
    return f"CASE WHEN {text} IS NULL OR {text} = '' THEN {text} ELSE {t} END"


@register("mask_pii", f"SELECT doc_id, {_d_mask('text')} AS masked FROM documents")
def q_mask_pii(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", TX.mask_pii("text").alias("masked"))


@register("mask_pii_conversations",
          f"SELECT conv_id, turn, {_d_mask('text')} AS masked FROM conversations")
def q_mask_conv(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations")
    return conv.select("conv_id", "turn", TX.mask_pii("text").alias("masked"))


@register("email_valid_split",
          f"SELECT _row_id, CASE WHEN {O.d_valid_email('email')} THEN 'valid' ELSE 'invalid' END "
          f"AS status FROM ({O.raw_contacts_sql()}) raw")
def q_email_valid(spark, sf_dir):
    raw = raw_contacts(spark, sf_dir)
    return raw.select("_row_id", F.when(TX.is_valid_email(qcol("E-mail")), "valid")
                      .otherwise("invalid").alias("status"))


_PART_COMPANY = "p_name || '  ' || p_brand || '-' || lower(p_type) || ' ' || CAST(p_size AS STRING)"


@register("company_title", f"SELECT p_partkey, {O.d_company(_PART_COMPANY)} AS company FROM part")
def q_company_title(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    return part.select("p_partkey", TX.normalize_company(F.expr(_PART_COMPANY)).alias("company"))


@register("company_title_docs", f"SELECT doc_id, {O.d_company('text')} AS company FROM documents")
def q_company_title_docs(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", TX.normalize_company("text").alias("company"))


@register("phone_clean", "SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN '' "
          "ELSE regexp_replace(text, '[^0-9+]', '', 'g') END AS phone FROM documents")
def q_phone_clean(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", TX.clean_phone("text").alias("phone"))


_EVENT_TEXT = ("CASE event_id % 5 WHEN 0 THEN ' ' || CAST(user_id AS STRING) || ' ' "
               "WHEN 1 THEN CAST(user_id AS STRING) || '.5' "
               "WHEN 2 THEN CAST(user_id AS STRING) || '_000' "
               "WHEN 3 THEN '+' || CAST(user_id AS STRING) ELSE 'x' || CAST(user_id AS STRING) END")


def _d_safe_int(x: str, default: int = 0) -> str:
    return (f"(CASE WHEN regexp_full_match(trim({x}), '[+-]?[0-9]+(_[0-9]+)*') "
            f"THEN coalesce(TRY_CAST(replace(trim({x}), '_', '') AS BIGINT), {default}) "
            f"ELSE {default} END)")


@register("safe_cast",
          f"SELECT event_id, {_d_safe_int("json_extract_string(props, '$.k')")} "
          f"AS k_int, {_d_safe_int(_EVENT_TEXT, -1)} AS v_int, "
          f"trim({_EVENT_TEXT}) AS v_str FROM events")
def q_safe_cast(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    txt = F.expr(_EVENT_TEXT)
    return ev.select("event_id", TX.safe_int(json_path("props", "k")).alias("k_int"),
                     TX.safe_int(txt, -1).alias("v_int"), TX.safe_str(txt).alias("v_str"))


@register("json_path", "SELECT event_id, json_extract_string(props, '$.k') AS k, "
          "coalesce(json_extract_string(props, '$.a.b'), 'none') AS missing FROM events")
def q_json_path(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    return ev.select("event_id", json_path("props", "k").alias("k"),
                     json_path("props", "a.b", "none").alias("missing"))


_PART_LIST = "CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END"


@register("flatten_list",
          f"SELECT p_partkey, array_to_string(list_filter([p_name, {_PART_LIST}, NULL, p_type], "
          f"lambda x: x IS NOT NULL AND x <> ''), ', ') AS flat FROM part")
def q_flatten_list(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    arr = F.array(F.col("p_name"), F.expr(_PART_LIST), F.lit(None).cast("string"), F.col("p_type"))
    return part.select("p_partkey", TX.flatten_list(arr).alias("flat"))


@register("truncate_html",
          f"SELECT page_id, CASE WHEN length(html) > {TRUNCATE_AT} THEN left(html, {TRUNCATE_AT}) "
          f"|| chr(10) || '[... truncated ...]' ELSE html END AS html_cut FROM pages")
def q_truncate(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    return pages.select("page_id", TX.truncate_text("html", TRUNCATE_AT).alias("html_cut"))


# ---------------------------------------------------------------- columns, normalise, dedupe

_MAPPED = {"_row_id": "_row_id", "unnamed0": "Unnamed: 0", "email": S.EMAIL, "fname": S.FIRST,
           "lname": S.LAST, "organization": S.COMPANY, "website": S.WEBSITE, "title": S.TITLE,
           "phone": S.PERSON_PHONE, "country": S.COUNTRY, "region": S.STATE,
           "email_send": S.EMAIL_SEND, "client_type": S.CLIENT_TYPE}


@register("column_map", "SELECT " + ", ".join(f"{k} AS {O.q(v)}" for k, v in _MAPPED.items())
          + f" FROM ({O.raw_contacts_sql()}) raw")
def q_column_map(spark, sf_dir):
    return map_columns(raw_contacts(spark, sf_dir))[0]


@register("normalize_contacts", O.normalized_contacts_sql())
def q_normalize(spark, sf_dir):
    return normalized_contacts(spark, sf_dir)


@register("dedupe_email", O.deduped_contacts_sql())
def q_dedupe_email(spark, sf_dir):
    return dedupe_by_email(normalized_contacts(spark, sf_dir))[0]


@register("dedupe_name_company",
          f"SELECT * FROM ({O.normalized_contacts_sql()}) n QUALIFY row_number() OVER "
          f"(PARTITION BY {O.q(S.FIRST)}, {O.q(S.LAST)}, {O.q(S.COMPANY)} ORDER BY _row_id) = 1")
def q_dedupe_name(spark, sf_dir):
    return dedupe_by_name_company(normalized_contacts(spark, sf_dir))[0]


@register("dedupe_documents", "SELECT doc_id, lang, source FROM documents "
          "QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def q_dedupe_docs(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return keep_first_wide(docs, ["text"], order="doc_id").select("doc_id", "lang", "source")


@register("first_turn", "SELECT conv_id, turn, role, text FROM conversations "
          "QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1")
def q_first_turn(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations")
    return keep_first(conv, ["conv_id"], order="turn")


# ---------------------------------------------------------------- keys

@register("serial_numbers", "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS sn FROM supplier")
def q_serial(spark, sf_dir):
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey")
    return with_serial(sup, ["s_suppkey"], "sn", 1)


@register("batches", "SELECT p_partkey, (rn - 1) // 10 AS batch_id, (rn - 1) % 10 AS pos FROM "
          "(SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS rn FROM part)")
def q_batches(spark, sf_dir):
    part = read_table(spark, sf_dir, "part").select("p_partkey")
    return with_batches(part, ["p_partkey"], S.MAX_PROVIDER_BATCH)


# ---------------------------------------------------------------- search, stats

def _search_where() -> str:
    f = {S.FILTER_PARAMS[k]: v for k, v in SEARCH_FILTERS.items()}
    return " AND ".join(f"{O.q(c)} ILIKE '%{v}%'" for c, v in f.items())


def _contacts_with_sn(spark, sf_dir):
    df = normalized_contacts(spark, sf_dir)
    return df.withColumn(S.SN, F.col("_row_id") + 1)


_CONTACTS_SN_SQL = f"SELECT *, _row_id + 1 AS {O.q(S.SN)} FROM ({O.normalized_contacts_sql()}) n"


@register("search_page", f"SELECT * FROM ({_CONTACTS_SN_SQL}) t WHERE {_search_where()} "
          f"ORDER BY {O.q(S.SN)} LIMIT {SEARCH_LIMIT} OFFSET {SEARCH_OFFSET}")
def q_search_page(spark, sf_dir):
    from ..operators.search import build_filters

    return search(_contacts_with_sn(spark, sf_dir), build_filters(**SEARCH_FILTERS),
                  SEARCH_LIMIT, SEARCH_OFFSET)


@register("search_total", f"SELECT count(*) AS total FROM ({_CONTACTS_SN_SQL}) t WHERE {_search_where()}")
def q_search_total(spark, sf_dir):
    from ..operators.search import build_filters

    return search_total(_contacts_with_sn(spark, sf_dir), build_filters(**SEARCH_FILTERS))


@register("stats_by_source", "SELECT event_type AS lead_source, count(*) AS n FROM events GROUP BY event_type")
def q_stats_source(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select(F.col("event_type").alias(S.LEAD_SOURCE))
    return by_lead_source(ev)


@register("stats_recent",
          "SELECT count(*) AS total_records, count(*) FILTER (WHERE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') "
          ">= '2024-01-24T00:00:00Z') AS recent_updates, CAST(3 AS BIGINT) AS total_columns FROM events")
def q_stats_recent(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias(S.LEAD_SOURCE), TX.format_utc(F.col("ts")).alias(S.UPDATED))
    return statistics(ev, STATS_AS_OF)


def _quality_sql() -> str:
    cols = [S.EMAIL, S.FIRST, S.LAST, S.COMPANY, S.WEBSITE, S.TITLE, S.PERSON_PHONE, S.COUNTRY,
            S.STATE, S.EMAIL_SEND, S.CLIENT_TYPE, S.LEAD_SOURCE]
    web, comp = O.q(S.WEBSITE), O.q(S.COMPANY)
    web_ok = f"(trim({web}) <> '' AND lower(trim({web})) <> 'nan')"
    parts = [
        "count(*) AS rows",
        f"count(*) FILTER (WHERE {web_ok}) AS valid_domains",
        f"count(*) FILTER (WHERE NOT {web_ok}) AS empty_domains",
        f"count(*) FILTER (WHERE trim({web}) <> '' OR trim({comp}) <> '') AS will_enrich",
        f"count(*) FILTER (WHERE trim({web}) = '' AND trim({comp}) = '') AS will_skip",
        f"count(*) FILTER (WHERE {O.d_domain('trim(' + web + ')')} IS NOT NULL) AS requestable_domains",
    ]
    parts += [f"count(*) FILTER (WHERE {O.q(c)} <> '') AS {O.q('filled_' + c)}" for c in cols]
    return f"SELECT {', '.join(parts)} FROM ({O.normalized_contacts_sql()}) n"


@register("quality_profile", _quality_sql())
def q_quality(spark, sf_dir):
    return quality_profile(normalized_contacts(spark, sf_dir))


def queries() -> dict[str, Query]:
    from . import catalog_flows, catalog_more  # noqa: F401  (register the remaining queries)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import catalog_flows, catalog_more  # noqa: F401

    return dict(ORACLE)
