"""Fill-empty upsert: fixtures of the reference tests plus a property check
against a sequential record-by-record fold on random batches."""

import random

import pytest

from contactlake import schema as S
from contactlake.operators.upsert import serials, upsert

NOW = "2024-02-01T00:00:00Z"
OLD = "2024-01-01T00:00:00Z"
PROV = S.DEFAULT_PREFIXES.person + "Headline"
COLS = [S.FIRST, S.LAST, S.TITLE]


def empty(v):
    return v is None or v == ""


def fold(stored, records, now):
    """Sequential model: one lookup and at most one write per record.

    Provider columns new to the table are taken as already added (NULL on
    stored rows). The reference adds them on the first write of the batch,
    so that one write may store "" where this model keeps NULL; both are
    empty for every later operation.
    """
    new_cols = {k for r in records for k in r if k not in S.BASE_COLUMNS and k != "_row_id"}
    state = {e: {**{k: None for k in new_cols}, **r} for e, r in stored.items()}
    max_sn = max([r[S.SN] for r in state.values()], default=0)
    outcomes = []
    for rec in records:
        email = rec.get(S.EMAIL)
        if not email:
            outcomes.append("failed")
            continue
        ex = state.get(email)
        if ex is None:
            new = {k: v for k, v in rec.items() if k not in (S.SN, "_row_id")}
            new[S.UPDATED] = now
            new.setdefault(S.EMAIL_SEND, "No")
            max_sn += 1
            new[S.SN] = max_sn
            state[email] = new
            outcomes.append("insert")
            continue
        merged, filled = dict(ex), 0
        for k, v in rec.items():
            if k in (S.SN, S.EMAIL_SEND, "_row_id"):
                continue
            if k not in merged:
                merged[k] = v
                filled += not empty(v)
            elif empty(merged[k]) and not empty(v):
                merged[k] = v
                filled += 1
        if filled == 0:
            outcomes.append("skip")
        else:
            merged[S.UPDATED] = now
            state[email] = merged
            outcomes.append("update")
    return state, outcomes


def make_truth(spark, stored):
    cols = S.BASE_COLUMNS
    rows = []
    for e, r in stored.items():
        rows.append(tuple(r.get(c) if c != S.EMAIL else e for c in cols))
    return spark.createDataFrame(rows, S.truth_schema())


def make_batch(spark, records, with_send):
    cols = ["_row_id", S.EMAIL] + COLS + [PROV] + ([S.EMAIL_SEND] if with_send else [])
    schema = ", ".join(f"`{c}` {'long' if c == '_row_id' else 'string'}" for c in cols)
    rows = [tuple(r.get(c) for c in cols) for r in records]
    return spark.createDataFrame(rows, schema)


def run(spark, stored, records, with_send, parts=3):
    truth = make_truth(spark, stored)
    batch = make_batch(spark, records, with_send).repartition(parts)
    res = upsert(truth, batch, now=NOW)
    state = {r[S.EMAIL]: r.asDict() for r in res.state.collect()}
    out = {r["_row_id"]: r["action"] for r in res.outcomes.collect()}
    return res, state, out


def random_case(rng):
    pool = [f"u{i}@x.com" for i in range(6)]
    vals = [None, "", " ", "a", "b"]
    stored = {}
    for i, e in enumerate(rng.sample(pool, rng.randint(0, 4))):
        r = {c: None for c in S.BASE_COLUMNS}
        r.update({S.SN: 10 + i * 3, S.EMAIL: e, S.UPDATED: OLD, S.EMAIL_SEND: rng.choice(["Yes", "", None])})
        for c in COLS:
            r[c] = rng.choice(vals)
        stored[e] = r
    with_send = rng.random() < 0.5
    records = []
    for i in range(rng.randint(1, 14)):
        rec = {"_row_id": i * 7 + rng.randint(0, 6), S.EMAIL: rng.choice(pool + ["", None])}
        for c in COLS + [PROV]:
            rec[c] = rng.choice(vals)
        if with_send:
            rec[S.EMAIL_SEND] = rng.choice(["Yes", "No", ""])
        records.append(rec)
    records.sort(key=lambda r: r["_row_id"])
    for i, r in enumerate(records):  # unique, increasing order keys
        r["_row_id"] = i * 5 + 1
    return stored, records, with_send


@pytest.mark.parametrize("seed", range(8))
def test_upsert_matches_sequential_fold(spark, seed):
    rng = random.Random(seed)
    stored, records, with_send = random_case(rng)
    exp_state, exp_out = fold(stored, [dict(r) for r in records], NOW)
    res, state, out = run(spark, stored, records, with_send, parts=1 + seed % 4)
    assert [out[r["_row_id"]] for r in records] == exp_out
    assert set(state) == set(exp_state)
    for e, exp in exp_state.items():
        got = state[e]
        for c in COLS + [PROV, S.SN, S.UPDATED, S.EMAIL_SEND]:
            assert got.get(c) == exp.get(c), (seed, e, c, got.get(c), exp.get(c))


def test_fill_empty_update_keeps_sn(spark):
    stored = {"a@x.com": {S.SN: 1, S.EMAIL: "a@x.com", S.UPDATED: OLD, S.TITLE: "", S.FIRST: "Ann",
                          S.EMAIL_SEND: "Yes"}}
    recs = [{"_row_id": 1, S.EMAIL: "a@x.com", S.TITLE: "CEO", S.FIRST: "Bob", S.EMAIL_SEND: "No"}]
    res, state, out = run(spark, stored, recs, True, parts=1)
    row = state["a@x.com"]
    assert out == {1: "update"}
    assert row[S.SN] == 1 and row[S.TITLE] == "CEO" and row[S.FIRST] == "Ann"
    assert row[S.EMAIL_SEND] == "Yes" and row[S.UPDATED] == NOW


def test_replay_is_all_skip(spark):
    recs = [{"_row_id": 1, S.EMAIL: "a@x.com", S.FIRST: "A"}, {"_row_id": 2, S.EMAIL: "b@x.com", S.FIRST: "B"}]
    res1, state1, out1 = run(spark, {}, recs, False, parts=2)
    assert sorted(out1.values()) == ["insert", "insert"]
    assert {state1[e][S.SN] for e in state1} == {1, 2}
    stored = {e: {c: v for c, v in r.items() if c in S.BASE_COLUMNS} for e, r in state1.items()}
    res2, state2, out2 = run(spark, stored, recs, False, parts=2)
    assert sorted(out2.values()) == ["skip", "skip"]
    assert all(state2[e][S.UPDATED] == state1[e][S.UPDATED] for e in state1)
    assert res2.stats.first().asDict() == {"inserted": 0, "updated": 0, "skipped": 2, "failed": 0}


def test_missing_email_fails_and_serials(spark):
    recs = [{"_row_id": 1, S.EMAIL: "", S.FIRST: "A"}, {"_row_id": 2, S.EMAIL: "b@x.com", S.FIRST: "B"}]
    res, state, out = run(spark, {}, recs, False, parts=1)
    assert out == {1: "failed", 2: "insert"}
    sn = {r["_row_id"]: r[S.SN] for r in serials(res).collect()}
    assert sn == {1: -1, 2: 1}


def test_unknown_column_reject_and_drop(spark):
    stored = {"a@x.com": {S.SN: 5, S.EMAIL: "a@x.com", S.UPDATED: OLD, S.FIRST: "A"}}
    truth = make_truth(spark, stored)
    batch = spark.createDataFrame(
        [(1, "a@x.com", "A", ""), (2, "a@x.com", "", "v"), (3, "n@x.com", "N", "")],
        f"_row_id long, `{S.EMAIL}` string, `{S.FIRST}` string, `Mystery` string")
    res = upsert(truth, batch, now=NOW, unknown_columns="reject")
    out = {r["_row_id"]: r["action"] for r in res.outcomes.collect()}
    assert out == {1: "skip", 2: "failed", 3: "failed"}
    assert res.state.count() == 1
    res = upsert(truth, batch, now=NOW, unknown_columns="drop")
    out = {r["_row_id"]: r["action"] for r in res.outcomes.collect()}
    assert out == {1: "skip", 2: "skip", 3: "insert"}
    assert "Mystery" not in res.state.columns


def test_provider_columns_grow_schema(spark):
    stored = {"a@x.com": {S.SN: 1, S.EMAIL: "a@x.com", S.UPDATED: OLD}}
    truth = make_truth(spark, stored)
    col = S.DEFAULT_PREFIXES.company + "Founded Year"
    batch = spark.createDataFrame([(1, "a@x.com", "1999")], f"_row_id long, `{S.EMAIL}` string, `{col}` string")
    res = upsert(truth, batch, now=NOW)
    assert col in res.state.columns and res.added_columns == [col]
    assert res.state.first()[col] == "1999"


def test_hot_email_third_of_batch(spark):
    """One e-mail holds a third of the records; result equals the fold and
    keep-first dedupe picks the first of the hot group."""
    from contactlake.operators.dedupe import dedupe_by_email

    rng = random.Random(7)
    records = []
    for i in range(600):
        email = "hot@x.com" if i % 3 == 0 else f"u{rng.randint(0, 150)}@x.com"
        rec = {"_row_id": i, S.EMAIL: email}
        for c in COLS + [PROV]:
            rec[c] = rng.choice([None, "", f"v{i}"]) if rng.random() < 0.3 else None
        records.append(rec)
    stored = {"hot@x.com": {**{c: None for c in S.BASE_COLUMNS}, S.SN: 7, S.EMAIL: "hot@x.com",
                            S.UPDATED: OLD, S.FIRST: "Kept"}}
    exp_state, exp_out = fold(stored, [dict(r) for r in records], NOW)
    res, state, out = run(spark, stored, records, False, parts=7)
    assert [out[r["_row_id"]] for r in records] == exp_out
    for e, exp in exp_state.items():
        for c in COLS + [PROV, S.SN, S.UPDATED]:
            assert state[e].get(c) == exp.get(c), (e, c)
    batch = make_batch(spark, records, False).repartition(7)
    firsts = {r[S.EMAIL]: r["_row_id"] for r in dedupe_by_email(batch)[0].collect()}
    assert firsts["hot@x.com"] == 0


def test_repeated_row_ids_are_refused(spark):
    import pytest

    from contactlake.operators.upsert import upsert
    from contactlake.sources.store import empty_truth

    batch = spark.createDataFrame([(1, "a@x.com"), (1, "b@x.com")], f"_row_id long, `{S.EMAIL}` string")
    with pytest.raises(ValueError, match="_row_id 1"):
        upsert(empty_truth(spark), batch, now="n")


def test_a_batch_of_one_part_is_merged_in_several(spark, monkeypatch):
    """The winners are a sort aggregate: what one task sorts must not be as large as the part that the batch came in."""
    from pyspark.sql.classic.dataframe import DataFrame

    from contactlake.sources.store import empty_truth

    kept, made = DataFrame.checkpoint, []

    def spy(df, eager=True):
        out = kept(df, eager)
        made.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(DataFrame, "checkpoint", spy)
    sizes = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")
    for size in sizes:
        spark.conf.set(size, "1024")
    try:
        batch = spark.range(0, 4000, 1, 1).selectExpr("id AS _row_id", f"concat('u', id % 1000) AS `{S.EMAIL}`", f"cast(id AS string) AS `{S.FIRST}`")
        state = {r[S.EMAIL]: r for r in upsert(empty_truth(spark), batch, now=NOW).state.collect()}
    finally:
        for size in sizes:
            spark.conf.unset(size)
    assert made[0] > 1
    assert len(state) == 1000 and all(r[S.FIRST] == e[1:] and r[S.SN] == int(e[1:]) + 1 for e, r in state.items())
