"""Fill-empty upsert of a batch into the truth table, keyed by e-mail.

Semantics (records are applied in ``_row_id`` order, as a sequential fold
would apply them one by one):

* a stored non-empty value is never overwritten; an empty one (NULL or
  ``""``, whitespace counts as a value) takes the first non-empty incoming
  value; for a new e-mail the first record is inserted as it is and later
  records fill its empty fields;
* outcome per record: ``insert`` (first record of a new e-mail), ``update``
  (it supplied at least one value), ``skip`` (nothing new), ``failed``
  (no e-mail, or rejected because of unknown columns);
* ``Email Send (Yes/No)`` is never changed after insert; a new row takes
  the first record's value, ``"No"`` when the batch has no such column;
* ``S.N.`` is kept for stored rows and continues after the current maximum,
  in input order, for new rows; an incoming ``S.N.`` is ignored;
* ``UPDATE AS ON`` becomes ``now`` for every e-mail with an insert or
  update and stays unchanged otherwise.

Set-wise restatement used here: per e-mail and column, the winner is the
lowest order (stored row = -1) among rows with a value; a record is updated
when it wins some column. One grouped aggregate computes all winners; it
runs partially on the map side, so a hot e-mail does not overload one task.
Outcomes are attached by a join on the unique ``_row_id``, never on e-mail.
Rows of e-mails absent from the batch pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import has_value
from .columns import is_internal, qcol
from ..session import checkpoint_dir
from .keys import with_serial

ROW_ID = "_row_id"
ORD = "__ord"
ACTIONS = ("insert", "update", "skip", "failed")


@dataclass
class UpsertResult:
    state: DataFrame
    outcomes: DataFrame
    stats: DataFrame
    added_columns: list[str] = field(default_factory=list)
    unknown_columns: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    max_sn: int | None = None  # highest serial number in ``state``


def _now_col(now: str | Column | None) -> Column:
    from ..functions.text import utc_now_text

    if now is None:
        return utc_now_text()
    return now if isinstance(now, Column) else F.lit(now)


def classify_columns(truth_cols: list[str], batch_cols: list[str],
                     prefixes: S.ProviderPrefixes) -> tuple[list[str], list[str]]:
    """(provider columns new to the table, unknown columns)."""
    have = set(truth_cols) | set(S.BASE_COLUMNS)
    added, unknown = [], []
    for c in batch_cols:
        if c in have or c == ROW_ID or is_internal(c):
            continue
        (added if prefixes.is_provider(c) else unknown).append(c)
    return added, unknown


def upsert(truth: DataFrame, batch: DataFrame, now: str | Column | None = None,
           prefixes: S.ProviderPrefixes = S.DEFAULT_PREFIXES,
           unknown_columns: str = "reject", max_sn: int | None = None) -> UpsertResult:
    """Merge ``batch`` (with a unique long ``_row_id`` giving input order)
    into ``truth``; returns the new state, one outcome per record and a
    one-row count summary.

    ``unknown_columns``: ``"reject"`` reproduces the reference outcome for
    columns that are neither base nor provider columns (no write; new
    e-mails and records carrying anything new fail, the rest are skipped);
    ``"drop"`` removes such columns with a warning and upserts the rest.

    ``max_sn``: the table's highest serial number when known (the store
    keeps it in its commit log); otherwise it is computed from ``truth``.
    The incoming batch is checkpointed once, so its upstream plan runs a
    single time whatever reads it afterwards.
    """
    if ROW_ID not in batch.columns:
        raise ValueError("batch needs a _row_id column giving input order")
    now_c = _now_col(now)
    warnings: list[str] = []
    batch_cols = [c for c in batch.columns if not is_internal(c) and c != S.SN]
    added, unknown = classify_columns(truth.columns, batch_cols, prefixes)
    if unknown and unknown_columns == "drop":
        warnings.append(f"Dropped columns that are not in the table: {unknown}")
        batch = batch.drop(*unknown)
        batch_cols = [c for c in batch_cols if c not in unknown]
        unknown = []

    if S.EMAIL not in batch.columns:
        failed = batch.select(qcol(ROW_ID).alias(ROW_ID), F.lit(None).cast("string").alias(S.EMAIL),
                              F.lit("failed").alias("action"), F.lit(S.EMAIL_REQUIRED).alias("error"))
        return UpsertResult(truth, failed, _stats(failed), [], unknown, warnings)

    email = qcol(S.EMAIL)
    checkpoint_dir(batch.sparkSession)
    # winners are a sort aggregate: each task sorts what its part holds, so parts are of bounded size
    batch = batch.hint("rebalance", qcol(ROW_ID)).checkpoint(eager=True)
    repeated = batch.groupBy(ROW_ID).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(ROW_ID).head(1)
    if repeated:
        raise ValueError(f"_row_id {repeated[0][0]} occurs more than once in the batch")
    valid = batch.where(has_value(email))
    bad = batch.where(~has_value(email)).select(
        qcol(ROW_ID).alias(ROW_ID), email.alias(S.EMAIL), F.lit("failed").alias("action"),
        F.lit(S.EMAIL_REQUIRED).alias("error"))

    if unknown:
        return _reject(truth, valid, bad, batch_cols, unknown, warnings)

    # Merge columns: everything except the four special ones, table order
    # first, then provider columns new to the table.
    merge_cols = [c for c in truth.columns if c not in S.UPSERT_SPECIAL] + added
    in_batch = set(batch_cols)
    email_send_in_batch = S.EMAIL_SEND in in_batch

    keys = valid.select(email.alias(S.EMAIL)).distinct()
    stored = truth.join(keys, S.EMAIL, "left_semi")
    untouched = truth.join(keys, S.EMAIL, "left_anti")

    def side(df: DataFrame, is_stored: bool) -> DataFrame:
        cols = [email.alias(S.EMAIL),
                (F.lit(-1).cast("long") if is_stored else qcol(ROW_ID).cast("long")).alias(ORD),
                (qcol(S.SN).cast("long") if is_stored else F.lit(None).cast("long")).alias(S.SN),
                (qcol(S.UPDATED) if is_stored else F.lit(None).cast("string")).alias(S.UPDATED)]
        if is_stored or email_send_in_batch:
            cols.append(qcol(S.EMAIL_SEND).cast("string").alias(S.EMAIL_SEND))
        else:
            cols.append(F.lit(None).cast("string").alias(S.EMAIL_SEND))
        for c in merge_cols:
            present = (c in df.columns) if is_stored else (c in in_batch)
            cols.append((qcol(c).cast("string") if present else F.lit(None).cast("string")).alias(c))
        return df.select(*cols)

    rows = side(stored, True).unionByName(side(valid, False))
    idx = {c: f"__v{i}" for i, c in enumerate(merge_cols)}
    aggs = [F.min(F.struct(F.col(ORD).alias("o"), qcol(S.SN).alias("sn"), qcol(S.UPDATED).alias("upd"),
                           qcol(S.EMAIL_SEND).alias("es"),
                           *[qcol(c).alias(idx[c]) for c in merge_cols])).alias("__first")]
    for c in merge_cols:
        aggs.append(F.min(F.when(has_value(qcol(c)), F.struct(F.col(ORD).alias("o"), qcol(c).alias("v"))))
                    .alias(idx[c]))
    per_email = rows.groupBy(S.EMAIL).agg(*aggs)
    per_email = per_email.checkpoint(eager=True)

    first = F.col("__first")
    has_stored = first["o"] < 0
    srcs = F.array_distinct(F.filter(F.array(*[F.col(idx[c])["o"] for c in merge_cols])
                                     if merge_cols else F.array().cast("array<long>"),
                                     lambda o: o.isNotNull() & (o >= 0)))
    insert_ord = F.when(~has_stored, first["o"])
    changed = (~has_stored) | (F.size(srcs) > 0)

    # Serial numbers for new e-mails, in the order of their first record.
    new_rows = per_email.where(~has_stored)
    if max_sn is None:
        max_sn = truth.agg(F.max(qcol(S.SN)).alias("m")).collect()[0]["m"]
    start = int(max_sn) + 1 if max_sn is not None else 1
    n_new = new_rows.count()
    new_rows = with_serial(new_rows, [first["o"]], "__new_sn", start)
    old_rows = per_email.where(has_stored).withColumn("__new_sn", F.lit(None).cast("long"))
    touched = old_rows.unionByName(new_rows)

    es = F.when(has_stored, first["es"]).otherwise(
        first["es"] if email_send_in_batch else F.lit(S.DEFAULT_EMAIL_SEND))
    out_cols = []
    for c in truth.columns + added:
        if c == S.SN:
            out_cols.append(F.coalesce(first["sn"], F.col("__new_sn")).alias(S.SN))
        elif c == S.EMAIL:
            out_cols.append(qcol(S.EMAIL).alias(S.EMAIL))
        elif c == S.EMAIL_SEND:
            out_cols.append(es.alias(S.EMAIL_SEND))
        elif c == S.UPDATED:
            out_cols.append(F.when(changed, now_c).otherwise(first["upd"]).alias(S.UPDATED))
        else:
            out_cols.append(F.coalesce(F.col(idx[c])["v"], first[idx[c]]).alias(c))
    new_state_rows = touched.select(*out_cols)
    untouched_full = untouched.select(*[qcol(c) for c in truth.columns],
                                      *[F.lit(None).cast("string").alias(c) for c in added])
    state = untouched_full.unionByName(new_state_rows)

    winners = per_email.select(
        qcol(S.EMAIL).alias("__email"),
        F.explode(F.filter(F.array_union(srcs, F.array(insert_ord)), lambda o: o.isNotNull())).alias(ROW_ID),
        insert_ord.alias("__ins"))
    winners = winners.select(ROW_ID, F.when(F.col(ROW_ID) == F.col("__ins"), "insert")
                             .otherwise("update").alias("action"))
    good = valid.select(qcol(ROW_ID).alias(ROW_ID), email.alias(S.EMAIL)).join(winners, ROW_ID, "left")
    good = good.select(ROW_ID, S.EMAIL, F.coalesce("action", F.lit("skip")).alias("action"),
                       F.lit(None).cast("string").alias("error"))
    outcomes = good.unionByName(bad)
    top = start + n_new - 1 if n_new else (int(max_sn) if max_sn is not None else None)
    return UpsertResult(state, outcomes, _stats(outcomes), added, [], warnings, top)


def _stats(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(*[F.count_if(F.col("action") == a).cast("long").alias(
        {"insert": "inserted", "update": "updated", "skip": "skipped", "failed": "failed"}[a])
        for a in ACTIONS])


def _reject(truth: DataFrame, valid: DataFrame, bad: DataFrame, batch_cols: list[str],
            unknown: list[str], warnings: list[str]) -> UpsertResult:
    """Batch with unknown columns: nothing is written. A record fails when
    its e-mail is new or it brings a value the stored row lacks (a value in
    an unknown column counts); otherwise it is skipped."""
    warnings.append(f"Columns not in the table: {unknown}; batch not written")
    known = [c for c in batch_cols if c not in unknown and c not in S.UPSERT_SPECIAL
             and c in truth.columns]
    provider_new = [c for c in batch_cols if c not in unknown and c not in truth.columns
                    and c not in S.UPSERT_SPECIAL]
    st = truth.select(qcol(S.EMAIL).alias("__se"), F.lit(True).alias("__has"),
                      *[qcol(c).alias(f"__s{i}") for i, c in enumerate(known)])
    joined = valid.join(st, qcol(S.EMAIL) == F.col("__se"), "left")
    brings = [has_value(qcol(c)) & ~has_value(F.col(f"__s{i}")) for i, c in enumerate(known)]
    brings += [has_value(qcol(c)) for c in provider_new + unknown]
    new_info = F.lit(False)
    for b in brings:
        new_info = new_info | b
    fails = F.col("__has").isNull() | new_info
    msg = F.lit("table has no column named " + ", ".join(unknown))
    good = joined.select(qcol(ROW_ID).alias(ROW_ID), qcol(S.EMAIL).alias(S.EMAIL),
                         F.when(fails, "failed").otherwise("skip").alias("action"),
                         F.when(fails, msg).alias("error"))
    outcomes = good.unionByName(bad)
    return UpsertResult(truth, outcomes, _stats(outcomes), [], unknown, warnings)


def serials(result: UpsertResult) -> DataFrame:
    """``(_row_id, S.N.)`` per record, -1 for failed ones (input order by
    ``_row_id``). Joins on e-mail; AQE splits a skewed e-mail partition."""
    sn = result.state.select(qcol(S.EMAIL).alias(S.EMAIL), qcol(S.SN).alias(S.SN))
    o = result.outcomes
    return o.join(sn, S.EMAIL, "left").select(
        ROW_ID, F.when(F.col("action") == "failed", F.lit(-1).cast("long"))
        .otherwise(qcol(S.SN)).alias(S.SN))


def touched_emails(result: UpsertResult, action: str) -> DataFrame:
    """E-mails with the given outcome, in input order column ``_row_id``."""
    return result.outcomes.where(F.col("action") == action).select(ROW_ID, S.EMAIL)
