"""People and company enrichment.

Two provider forms:

* a **provider table** (DataFrame): people keyed by the request fields, or
  organisations keyed by domain. Enrichment is then a left join. Broadcast
  or shuffle is left to the planner's size estimate and AQE, which also
  splits a skewed key (one domain holding a large share of the contacts)
  across tasks.
* a **provider callable** (``fn(endpoint, payload, timeout) -> dict``), called
  with batches of at most 10 requests from ``mapInPandas``; the request JSON
  is built by Spark, Python only batches, calls and zips ``matches[i]`` to
  the i-th request. Companies are asked for once a distinct domain. Retries with exponential backoff on 429 / 5xx /
  timeout; any other error marks the whole batch.

Merging is by key (``_row_id`` / domain), not by position. Precedence with
both stages on: organisation value > original non-empty value > person
value; people stage alone: value of the organisation embedded in the person
match > person value > original.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.provider import ORG_SCHEMA, PERSON_SCHEMA, map_company, map_person, people_request
from ..functions.text import has_value, is_blank, py_strip
from ..functions.url import extract_domain
from .columns import qcol
from ..session import ship_package
from ..sources.replies import ReplyLedger, request_digest
from .normalize import has_people_identifier

ROW_ID = "_row_id"
ERROR = "_enrichment_error"
PEOPLE_ENDPOINT = "/people/bulk_match"
ORG_ENDPOINT = "/organizations/bulk_enrich"


class ProviderError(Exception):
    """Provider failure; ``status`` is the HTTP status when there is one."""

    def __init__(self, message: str, status: int | None = None) -> None:
        super().__init__(message)
        self.status = status


@dataclass
class RetryPolicy:
    max_attempts: int = 5
    initial_backoff: float = 1.0
    max_backoff: float = 60.0
    timeout: float = 30.0
    sleep: Callable[[float], None] = time.sleep

    def backoff(self, attempt: int) -> float:
        return min(self.initial_backoff * (2 ** attempt), self.max_backoff)


def call_with_retry(fn, endpoint: str, payload: dict, policy: RetryPolicy) -> dict:
    """Call ``fn``; retry on 429, 5xx and timeouts with exponential backoff
    (timeout grows x1.5 after a timeout); other errors fail at once."""
    attempt, timeout = 0, policy.timeout
    while attempt < policy.max_attempts:
        try:
            return fn(endpoint, payload, timeout)
        except ProviderError as e:
            if e.status is not None and (e.status == 429 or 500 <= e.status < 600):
                policy.sleep(policy.backoff(attempt))
                attempt += 1
                continue
            raise
        except TimeoutError:
            policy.sleep(policy.backoff(attempt))
            attempt += 1
            timeout = int(timeout * 1.5)
        except Exception as e:  # connection errors and the like
            raise ProviderError(S.MSG_REQUEST_FAILED.format(error=e)) from e
    raise ProviderError(S.MSG_RETRIES_EXHAUSTED.format(attempts=policy.max_attempts))


def _text(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("string")
    c = qcol(name)
    return c if isinstance(df.schema[name].dataType, T.StringType) else c.cast("string")


def people_request_col(df: DataFrame) -> Column:
    return people_request(_text(df, S.FIRST), _text(df, S.LAST), _text(df, S.WEBSITE),
                          _text(df, S.COMPANY), _text(df, S.EMAIL))


def request_key(req: Column) -> Column:
    """Join key of a people request: the e-mail when given, else names and
    organisation."""
    return F.coalesce(
        F.concat(F.lit("e|"), req["email"]),
        # as JSON: parts that hold the separator can't run into one another
        F.concat(F.lit("n|"), F.to_json(F.array(
            F.coalesce(req["first_name"], F.lit("")), F.coalesce(req["last_name"], F.lit("")),
            F.coalesce(req["organization_domain"], req["organization_name"], F.lit(""))))))


def org_domain_col(df: DataFrame) -> Column:
    """Domain a record is enriched by: NULL when the website is blank or
    yields no domain."""
    web = _text(df, S.WEBSITE)
    return F.when(~is_blank(web), extract_domain(py_strip(web)))


def _first_per_key(df: DataFrame, key: str, obj: str, unique: bool = False) -> DataFrame:
    """One provider row per key (deterministic pick among duplicates).
    Skipped when the caller declares the provider keys unique."""
    if unique:
        return df
    return df.groupBy(key).agg(F.min_by(F.col(obj), F.to_json(F.col(obj))).alias(obj))


# ---------------------------------------------------------------- callable providers

def provider_batch(size: int) -> int:
    """``size`` itself, if a provider call may hold that many requests."""
    if not 1 <= int(size) <= S.MAX_PROVIDER_BATCH:
        raise ValueError(f"batch size must be between 1 and {S.MAX_PROVIDER_BATCH}")
    return int(size)


def _batched_calls(rows: DataFrame, fn, endpoint: str, payload_key: str, batch_size: int,
                   policy: RetryPolicy, parallelism: int | None, key: str = ROW_ID,
                   unwrap: bool = False) -> DataFrame:
    """``(key, req)`` -> ``(key, match, err)`` by batched calls in key order.
    ``req`` is JSON text; with ``unwrap`` it is a one-element array whose
    element is the request item."""
    batch_size = provider_batch(batch_size)
    ship_package(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()
    if parallelism:
        rows = rows.repartition(parallelism)
    rows = rows.sortWithinPartitions(key)

    def run(it):
        import pandas as pd

        for pdf in it:
            ids = pdf[key].tolist()
            reqs = pdf["req"].tolist()
            matches, errors = [None] * len(ids), [None] * len(ids)
            for start in range(0, len(ids), batch_size):
                chunk = range(start, min(start + batch_size, len(ids)))
                items = [json.loads(reqs[i]) for i in chunk]
                if unwrap:
                    items = [x[0] for x in items]
                try:
                    resp = call_with_retry(fn, endpoint, {payload_key: items}, policy) or {}
                    got = resp.get("matches") or []
                    for j, i in enumerate(chunk):
                        m = got[j] if j < len(got) else None
                        matches[i] = json.dumps(m) if m else None
                except Exception as e:  # whole batch marked
                    for i in chunk:
                        errors[i] = str(e)
            yield pd.DataFrame({key: ids, "match": matches, "err": errors})

    return rows.mapInPandas(run, f"{key} {kind}, match string, err string")


def _replies(rows: DataFrame, fn, endpoint: str, payload_key: str, batch_size: int, policy: RetryPolicy,
             parallelism: int | None, ledger: ReplyLedger | None, key: str = ROW_ID, unwrap: bool = False) -> DataFrame:
    """``_batched_calls``; with a ledger only for the distinct requests that it has no answer to."""
    if ledger is None:
        return _batched_calls(rows, fn, endpoint, payload_key, batch_size, policy, parallelism, key, unwrap)
    rows = rows.withColumn("digest", request_digest(endpoint, F.col("req")))
    answers = ledger.answer(endpoint, rows, lambda unanswered: _batched_calls(
        unanswered, fn, endpoint, payload_key, batch_size, policy, parallelism, "digest", unwrap))
    return rows.join(answers, "digest").select(key, "match", "err")


# ---------------------------------------------------------------- stages

FLAGS = ("__sent", "__people_ok", "__org_ok", "__no_domain")


@dataclass
class Enriched:
    """Enriched rows plus per-row flags for the run counters."""

    full: DataFrame

    @property
    def frame(self) -> DataFrame:
        return self.full.drop(*FLAGS)

    def counts(self) -> DataFrame:
        """One row: people_enriched, orgs_enriched, orgs_skipped_no_domain."""
        return self.full.agg(
            F.count_if(F.col("__people_ok")).alias("people_enriched"),
            F.count_if(F.col("__org_ok")).alias("orgs_enriched"),
            F.count_if(F.col("__no_domain")).alias("orgs_skipped_no_domain"))


def _unmatched_key(prefix: str) -> Column:
    """Distinct per-row key for rows that are not looked up, so they spread
    over all join partitions instead of piling up under a NULL key."""
    return F.concat(F.lit(prefix), qcol(ROW_ID).cast("string"))


def _people_matches(df: DataFrame, provider, batch_size: int, policy: RetryPolicy, parallelism: int | None,
                    unique: bool = False, ledger: ReplyLedger | None = None) -> tuple[DataFrame, str]:
    """Person matches for records with an identifier; (frame, join column)."""
    sent = has_people_identifier(df)
    if isinstance(provider, DataFrame):
        prov = provider.select(request_key(F.struct(
            *[F.col(c).cast("string").alias(c) for c in
              ("first_name", "last_name", "organization_domain", "organization_name", "email")]
        )).alias("__key"), F.col("person"))
        prov = _first_per_key(prov, "__key", "person", unique)
        return prov.select("__key", F.col("person").alias("__person"),
                           F.lit(None).cast("string").alias("__perr")), "__key"
    rows = df.where(sent).select(qcol(ROW_ID).alias(ROW_ID), F.to_json(people_request_col(df)).alias("req"))
    calls = _replies(rows, provider, PEOPLE_ENDPOINT, "details", batch_size, policy, parallelism, ledger)
    return calls.select(ROW_ID, F.from_json("match", PERSON_SCHEMA).alias("__person"),
                        F.col("err").alias("__perr")), ROW_ID


def _org_matches(df: DataFrame, provider, batch_size: int, policy: RetryPolicy, parallelism: int | None,
                 unique: bool = False, ledger: ReplyLedger | None = None) -> DataFrame:
    """Organisation matches by ``__domain``."""
    if isinstance(provider, DataFrame):
        prov = provider.select(F.lower(F.col("domain")).alias("__domain"), F.col("organization"))
        prov = _first_per_key(prov, "__domain", "organization", unique)
        return prov.select("__domain", F.col("organization").alias("__org"),
                           F.lit(None).cast("string").alias("__oerr"))
    asked = df.select(org_domain_col(df).alias("__domain")).where("__domain IS NOT NULL").distinct()
    calls = _replies(asked.select("__domain", F.to_json(F.array("__domain")).alias("req")), provider,
                     ORG_ENDPOINT, "domains", batch_size, policy, parallelism, ledger, key="__domain", unwrap=True)
    return calls.select("__domain", F.from_json("match", ORG_SCHEMA).alias("__org"), F.col("err").alias("__oerr"))


def enrich_records(df: DataFrame, people_provider=None, company_provider=None,
                   enrich_people: bool = True, enrich_companies: bool = True,
                   prefixes: S.ProviderPrefixes = S.DEFAULT_PREFIXES,
                   batch_size: int = S.MAX_PROVIDER_BATCH, policy: RetryPolicy | None = None,
                   parallelism: int | None = None, provider_unique: bool = False,
                   ledger: ReplyLedger | None = None) -> Enriched:
    """Enrich contact rows (with ``_row_id``) by people and/or companies.

    ``provider_unique=True`` declares provider tables unique on their key,
    which skips the per-key pick (an aggregation) before the join. With a
    ``ledger``, callable providers are asked at once, and only what it has no
    answer to.

    Without any provider the frame is returned unchanged. Records without
    a people identifier get ``Skipped (no identifier for matching)``. New
    columns start as ``""``; a mapped non-empty value overwrites per the
    stage precedence described in the module docstring.
    """
    policy = policy or RetryPolicy()
    do_people = enrich_people and people_provider is not None
    do_orgs = enrich_companies and company_provider is not None
    no_dom = is_blank(_text(df, S.WEBSITE))
    if not (do_people or do_orgs):
        return Enriched(df.select("*", F.lit(False).alias("__sent"), F.lit(False).alias("__people_ok"),
                                  F.lit(False).alias("__org_ok"), no_dom.alias("__no_domain")))

    out = df
    person_cols: list[tuple[str, Column]] = []
    emb_cols: list[tuple[str, Column]] = []
    org_cols: list[tuple[str, Column]] = []
    if do_people:
        pm, key = _people_matches(df, people_provider, batch_size, policy, parallelism, provider_unique, ledger)
        if key == "__key":
            k = F.when(has_people_identifier(df), request_key(people_request_col(df)))
            out = out.withColumn("__key", F.coalesce(k, _unmatched_key("\u0000"))).join(pm, "__key", "left")
        else:
            out = out.join(pm, ROW_ID, "left")
        person_cols = map_person(F.col("__person"), PERSON_SCHEMA, prefixes)
        emb_cols = map_company(F.col("__person")["organization"], ORG_SCHEMA, prefixes)
    if do_orgs:
        om = _org_matches(df, company_provider, batch_size, policy, parallelism, provider_unique, ledger)
        dom = F.coalesce(org_domain_col(df), _unmatched_key("\u0000"))
        out = out.withColumn("__domain", dom).join(om, "__domain", "left")
        org_cols = map_company(F.col("__org"), ORG_SCHEMA, prefixes)

    orig = set(df.columns)

    def orig_val(c: str) -> Column:
        return _text(df, c) if c in orig else F.lit(None).cast("string")

    # Stage 1: mapped values as named columns, so the merge below refers to
    # them instead of repeating the mapping expressions.
    staged: list[Column] = []
    set_name: dict[str, str] = {}
    if do_people:
        emb, pv = dict(emb_cols), dict(person_cols)
        for c in list(emb) + [k for k in pv if k not in emb]:
            parts = [x for x in (emb.get(c), pv.get(c)) if x is not None]
            set_name[c] = f"__ps{len(set_name)}"
            staged.append((parts[0] if len(parts) == 1 else F.coalesce(*parts)).alias(set_name[c]))
    org_name: dict[str, str] = {}
    if do_orgs:
        for c, v in org_cols:
            org_name[c] = f"__os{len(org_name)}"
            staged.append(v.alias(org_name[c]))
    sent = has_people_identifier(df)
    flags = [sent.alias("__sent"),
             (F.col("__perr") if do_people else F.lit(None).cast("string")).alias("__perr"),
             (F.col("__oerr") if do_orgs else F.lit(None).cast("string")).alias("__oerr")]
    stage1 = out.select(*[qcol(c) for c in df.columns], *staged, *flags)

    # Stage 2: merge with the stage precedence.
    sent_c = F.col("__sent")
    people_val: dict[str, Column] = {}
    for c, n in set_name.items():
        keep = orig_val(c) if c in orig else F.lit("")  # new columns start as ""
        people_val[c] = F.when(has_value(F.col(n)), F.col(n)).otherwise(keep)
    p_err = F.when(~sent_c, F.lit(S.SKIPPED_NO_IDENTIFIER)).otherwise(F.col("__perr")) if do_people \
        else F.lit(None).cast("string")

    final: dict[str, Column] = {}
    if do_orgs:
        for c in list(dict.fromkeys(list(org_name) + list(people_val))):
            p_c = people_val.get(c, orig_val(c) if c in orig else F.lit(""))
            fallback = F.when(has_value(orig_val(c)), orig_val(c)).otherwise(p_c) if do_people else p_c
            if c not in org_name:
                final[c] = fallback
            else:
                o_c = F.col(org_name[c])
                final[c] = F.when(o_c.isNotNull(), F.when(has_value(o_c), o_c).otherwise(p_c)).otherwise(fallback)
        o_err = F.col("__oerr")
        err = F.when(has_value(o_err), o_err).otherwise(p_err)
    else:
        final = people_val
        err = p_err

    cols = []
    for c in df.columns:
        if c == ERROR:
            continue
        cols.append(final[c].alias(c) if c in final else qcol(c))
    for c in list(final):
        if c not in orig:
            cols.append(final[c].alias(c))
    prior_err = _text(df, ERROR) if ERROR in orig else F.lit(None).cast("string")
    cols.append(F.coalesce(F.when(has_value(err), err), prior_err, F.lit("")).alias(ERROR))
    people_ok = (sent_c & ~has_value(F.col("__perr"))) if do_people else F.lit(False)
    orgs_ok = ~has_value(F.col("__oerr")) if do_orgs else F.lit(False)
    full = stage1.select(*cols, sent_c.alias("__sent"), people_ok.alias("__people_ok"),
                         orgs_ok.alias("__org_ok"), is_blank(_text(df, S.WEBSITE)).alias("__no_domain"))
    return Enriched(full)


def prune_empty_new_columns(df: DataFrame, before: list[str]) -> DataFrame:
    """Drop columns added by enrichment that are empty in every row (the
    reference only creates a column when some record carries it). One
    aggregate pass over the frame."""
    new = [c for c in df.columns if c not in before and c != ERROR]
    if not new:
        return df
    row = df.agg(*[F.max(has_value(qcol(c)).cast("int")).alias(f"c{i}") for i, c in enumerate(new)]).first()
    drop = [c for i, c in enumerate(new) if not row[f"c{i}"]]
    return df.drop(*drop) if drop else df


def request_batches(df: DataFrame, kind: str = "people", size: int = S.MAX_PROVIDER_BATCH) -> DataFrame:
    """Provider request payloads as rows, one per batch of at most ``size``
    requests in ``_row_id`` order: ``(batch_id, payload)`` with payload
    ``{"details": [...]}`` (people) or ``{"domains": [...]}`` (companies,
    only records whose website yields a domain). A batch holds at most
    ``size`` small items, so ``collect_list`` per batch is bounded."""
    from .keys import with_batches

    size = provider_batch(size)
    if kind == "people":
        rows = df.where(has_people_identifier(df)).select(qcol(ROW_ID).alias(ROW_ID),
                                                         people_request_col(df).alias("item"))
        key = "details"
    else:
        rows = df.select(qcol(ROW_ID).alias(ROW_ID), org_domain_col(df).alias("item")) \
            .where(F.col("item").isNotNull())
        key = "domains"
    rows = with_batches(rows, [ROW_ID], size)
    per = rows.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("xs"))
    return per.select("batch_id", F.to_json(F.struct(
        F.transform("xs", lambda x: x["item"]).alias(key))).alias("payload"))
