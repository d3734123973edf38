"""End-to-end flows with fake providers, and the streaming upsert."""

import os

from pyspark.sql import functions as F

from contactlake import schema as S
from contactlake.operators.enrich import ProviderError, RetryPolicy, call_with_retry, enrich_records
from contactlake.plans.flows import ingest_and_enrich, ingest_base, saved_and_skipped
from contactlake.sources.store import TruthStore
from contactlake.sources.workbook import build_xlsx
from contactlake.streaming import upsert_stream

NOW = "2024-03-01T00:00:00Z"


def sheet(path, header, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as fh:
        fh.write(build_xlsx(header, rows))


def fake_people(endpoint, payload, timeout):
    assert endpoint == "/people/bulk_match" and len(payload["details"]) <= 10
    out = []
    for d in payload["details"]:
        if d.get("email", "").startswith("fail"):
            raise ProviderError("API error 400: bad", status=400)
        out.append({"title": "CTO", "seniority": "c_suite", "departments": ["eng", ""],
                    "organization": {"name": "Acme Org", "industry": "software"}}
                   if d.get("email") == "a@x.com" else None)
    return {"matches": out}


def fake_orgs(endpoint, payload, timeout):
    return {"matches": [{"name": f"Org {d}", "publicly_traded_symbol": "ACM", "founded_year": 1999,
                         "departmental_head_count": {"eng": 3, "ops": 0}} for d in payload["domains"]]}


def test_upload_and_enrich(spark, tmpdir_path):
    sheet(f"{tmpdir_path}/up/a.xlsx", ["E-mail", "fname", "lname", "organization", "website"],
          [["a@x.com ", "Ann", "Lee", "acme  inc", "https://www.acme.com/about"],
           ["bad-email", "Bob", "B", "", ""],
           ["a@x.com", "Dup", "", "", ""],
           ["fail@x.com", "Fay", "F", "", "foo.org"]])
    store = TruthStore(spark, f"{tmpdir_path}/truth")
    r = ingest_and_enrich(spark, f"{tmpdir_path}/up", store, fake_people, fake_orgs, now=NOW, batch_size=1)
    s = r.summary
    assert s["total_processed"] == 2 and s["new_inserts"] == 2 and s["empty_reason"] is None
    assert s["people_enriched"] == 1 and s["orgs_enriched"] == 2
    rows = {x[S.EMAIL]: x.asDict() for x in store.read().collect()}
    a = rows["a@x.com"]
    assert a[S.TITLE] == "CTO" and a[S.COMPANY] == "Org acme.com" and a[S.LISTED] == "Yes"
    assert a[S.DEFAULT_PREFIXES.person + "Departments"] == "eng"
    assert a[S.DEFAULT_PREFIXES.company + "Department Headcount"] == "eng: 3"
    assert a[S.WEBSITE] == "acme.com" and a[S.UPDATED] == NOW and a[S.SN] == 1
    # provider columns nobody carried are not added to the table
    assert S.DEFAULT_PREFIXES.person + "Github URL" not in a
    assert S.DEFAULT_PREFIXES.person + "Seniority" in a
    errs = r.errors.collect()
    assert len(errs) == 1 and errs[0]["email"].startswith("f***@x***.com") and "400" in errs[0]["message"]
    # second upload of the same sheet: nothing new
    r2 = ingest_and_enrich(spark, f"{tmpdir_path}/up", store, fake_people, fake_orgs, now="2024-04-01T00:00:00Z")
    assert r2.summary["new_inserts"] == 0 and r2.summary["updates"] == 0


def test_empty_and_missing_email(spark, tmpdir_path):
    sheet(f"{tmpdir_path}/e/a.xlsx", ["Email", "First Name"], [["", "A"], ["invalid", "B"]])
    store = TruthStore(spark, f"{tmpdir_path}/t1")
    assert ingest_and_enrich(spark, f"{tmpdir_path}/e", store).summary["empty_reason"] == "no_valid_rows"
    sheet(f"{tmpdir_path}/n/a.xlsx", ["First Name", "Company"], [["A", "C"]])
    r = ingest_and_enrich(spark, f"{tmpdir_path}/n", store)
    assert r.summary.get("processing_failed") and "email column" in r.summary["errors"][0]["message"]
    b = ingest_base(spark, f"{tmpdir_path}/n", store, now=NOW)
    assert b.summary["skipped_no_email"] == 1 and b.summary["new_inserts"] == 0


def test_retry_policy():
    calls, sleeps = [], []

    def flaky(endpoint, payload, timeout):
        calls.append(timeout)
        if len(calls) < 3:
            raise ProviderError("rate", status=429)
        if len(calls) == 3:
            raise TimeoutError()
        return {"ok": True}

    pol = RetryPolicy(sleep=sleeps.append)
    assert call_with_retry(flaky, "/x", {}, pol) == {"ok": True}
    assert sleeps == [1.0, 2.0, 4.0] and calls[-1] == 45
    sleeps.clear()

    def always(endpoint, payload, timeout):
        raise ProviderError("down", status=503)

    try:
        call_with_retry(always, "/x", {}, RetryPolicy(sleep=sleeps.append))
    except ProviderError as e:
        assert "after 5 attempts" in str(e)
    assert sleeps == [1.0, 2.0, 4.0, 8.0, 16.0]

    def client_error(endpoint, payload, timeout):
        raise ProviderError("API error 404: no", status=404)

    try:
        call_with_retry(client_error, "/x", {}, RetryPolicy(sleep=sleeps.append))
    except ProviderError as e:
        assert "404" in str(e)


def test_saved_and_skipped(spark):
    df = spark.createDataFrame([("a@x.com", "A", "L", "C"), ("", " B ", None, "D")],
                               f"`{S.EMAIL}` string, `{S.FIRST}` string, `{S.LAST}` string, `{S.COMPANY}` string")
    saved, skipped = saved_and_skipped(df)
    assert [tuple(r) for r in saved.collect()] == [("A", "L", "C")]
    assert [tuple(r) for r in skipped.collect()] == [("B", "", "D")]


def test_stream_upsert_replay(spark, tmpdir_path):
    src = f"{tmpdir_path}/incoming"
    store = TruthStore(spark, f"{tmpdir_path}/truth")
    schema = f"_row_id long, `{S.EMAIL}` string, `{S.FIRST}` string"
    spark.createDataFrame([(1, "a@x.com", "A"), (2, "b@x.com", "")], schema).coalesce(1).write.parquet(src + "/p1")
    stream = spark.readStream.schema(schema).parquet(src + "/p1")
    q = upsert_stream(stream, store, f"{tmpdir_path}/ckpt1", now=NOW)
    q.awaitTermination()
    assert store.read().count() == 2
    # same records again through a new stream: all skip, nothing changes
    spark.createDataFrame([(3, "a@x.com", "A"), (4, "b@x.com", "")], schema).coalesce(1).write.parquet(src + "/p2")
    q = upsert_stream(spark.readStream.schema(schema).parquet(src + "/p2"), store, f"{tmpdir_path}/ckpt2", now="x")
    q.awaitTermination()
    outs = spark.read.parquet(store.root + "/_outcomes").where(F.col("_row_id") >= 3).collect()
    assert sorted(o["action"] for o in outs) == ["skip", "skip"]
    assert {r[S.UPDATED] for r in store.read().collect()} == {NOW}


def scrape_reply(html, url):
    return '```json\n[{"name": "Jane Smith", "company": "acme corp", "email": "jane@acme.com"},' \
           ' {"firstName": "Bob", "organization": "Beta"}, {"name": "Jane Smith", "company": "acme corp"}]\n```'


def no_reply(html, url):
    return ""


def fallback_items(url):
    return {"items": [{"name": "Fall Back", "org": "Gamma", "email": "fb@gamma.com"}]}


def test_ingest_pages(spark, tmpdir_path):
    from contactlake.plans.flows import ingest_pages

    pages = spark.createDataFrame([(1, "https://a.com", "<html>x</html>"), (2, "https://b.com", None)],
                                  "page_id long, url string, html string")
    store = TruthStore(spark, f"{tmpdir_path}/scrape")
    r = ingest_pages(spark, pages, store, scrape_reply, fallback_items, now=NOW)
    # page 1: three items, the repeated name+company dropped; as some items
    # carry an e-mail, Bob (none) is dropped by normalisation; page 2 (no
    # html) goes to the fallback
    assert r.summary["total_processed"] == 2
    assert r.summary["new_inserts"] == 2 and r.summary["skipped_no_email"] == 0
    rows = {x[S.EMAIL]: x for x in store.read().collect()}
    assert rows["jane@acme.com"][S.COMPANY] == "Acme Corp" and rows["jane@acme.com"][S.LEAD_SOURCE] == "Website Scrape"
    assert rows["fb@gamma.com"][S.FIRST] == "Fall" and rows["fb@gamma.com"][S.LAST] == "Back"
    kept = ingest_pages(spark, pages, TruthStore(spark, f"{tmpdir_path}/scrape3"), scrape_reply, fallback_items,
                        now=NOW, keep_rows_without_email=True)
    assert kept.summary["total_processed"] == 3 and kept.summary["skipped_no_email"] == 1
    r2 = ingest_pages(spark, pages, TruthStore(spark, f"{tmpdir_path}/scrape2"), no_reply, None, now=NOW)
    assert r2.summary["total_processed"] == 0


def test_export_file_name():
    import re

    from contactlake.sources.workbook import export_file_name

    assert re.match(r"^contacts_export_\d{8}_\d{6}\.xlsx$", export_file_name())


def test_stream_batch_retry_after_a_crash(spark, tmpdir_path, monkeypatch):
    import pytest

    from contactlake.streaming.upsert_stream import apply_batch

    store = TruthStore(spark, f"{tmpdir_path}/retry")
    batch = spark.createDataFrame([(1, "a@x.com"), (2, "b@x.com")], f"_row_id long, `{S.EMAIL}` string")

    def crash(*a, **k):
        raise RuntimeError("crash")

    with monkeypatch.context() as m:
        m.setattr(TruthStore, "commit", crash)
        with pytest.raises(RuntimeError):
            apply_batch(store, batch, 7, now=NOW, stream="s")
    assert apply_batch(store, batch, 7, now=NOW, stream="s") is True
    before = sorted(map(str, store.read().collect()))
    assert apply_batch(store, batch, 7, now="later", stream="s") is False
    assert sorted(map(str, store.read().collect())) == before
    outs = spark.read.parquet(store.root + "/_outcomes").collect()
    assert sorted(o["action"] for o in outs) == ["insert", "insert"]
    with pytest.raises(ValueError, match="order_cols"):
        apply_batch(store, batch.drop("_row_id"), 8, now=NOW, stream="s")


def test_prefixes_hold_through_the_flow(spark, tmpdir_path):
    from contactlake.plans.flows import ingest_and_enrich

    prefixes = S.ProviderPrefixes("X Person: ", "X Company: ")
    rows = spark.createDataFrame([(0, "a@x.com", "https://x.com")], f"_row_id long, `{S.EMAIL}` string, `{S.WEBSITE}` string")
    people = lambda endpoint, payload, timeout: {
        "matches": [{"first_name": "Ann", "seniority": "chief"} for _ in payload["details"]]}
    store = TruthStore(spark, f"{tmpdir_path}/prefixed")
    r = ingest_and_enrich(spark, rows, store, people, None, enrich_companies=False, now=NOW, prefixes=prefixes)
    assert r.cause is None and r.summary["new_inserts"] == 1 and r.summary["failed"] == 0
    assert store.read().first()["X Person: Seniority"] == "chief"


def test_ledger_asks_only_what_is_unanswered(spark, tmpdir_path):
    from contactlake.operators.enrich import ORG_ENDPOINT, PEOPLE_ENDPOINT
    from contactlake.sources.replies import ReplyLedger

    def provider(endpoint, payload, timeout):
        if any("bad" in str(x) for x in payload.get("details", [])):
            raise ProviderError("refused", 422)
        return {"matches": [None if "none" in str(x) else {"title": "Lead " + x.get("email", "")} for x in payload["details"]]}

    def orgs(endpoint, payload, timeout):
        return {"matches": [{"name": "Org " + x} for x in payload["domains"]]}

    def run(emails):
        rows = spark.createDataFrame([(i, e, "x.com") for i, e in enumerate(emails)],
                                     f"_row_id long, `{S.EMAIL}` string, `{S.WEBSITE}` string")
        return [(r[S.EMAIL], r[S.TITLE], r["_enrichment_error"]) for r in enrich_records(
            rows, provider, orgs, batch_size=1, ledger=ledger).frame.orderBy("_row_id").collect()]

    def asked(endpoint):
        return {r["run"]: (r["n_asked"], r["n_failed"]) for r in ledger.asked().where(F.col("endpoint") == endpoint).collect()}

    ledger = ReplyLedger(spark, tmpdir_path + "/replies")
    got = run(["a@x.com", "none@x.com", "bad@x.com", "a@x.com", None])
    assert got[0] == ("a@x.com", "Lead a@x.com", "") and got[3] == got[0]
    assert got[1] == ("none@x.com", "", "") and got[2] == ("bad@x.com", "", "refused")
    first = asked(PEOPLE_ENDPOINT)[1]
    assert first[1] == 1 and asked(ORG_ENDPOINT) == {1: (1, 0)}
    again = run(["a@x.com", "none@x.com", "bad@x.com", "new@x.com"])
    assert again[:3] == got[:3] and again[3][1] == "Lead new@x.com"
    assert asked(PEOPLE_ENDPOINT) == {1: first, 2: (2, 1)}  # the failed one and the new one
    assert asked(ORG_ENDPOINT) == {1: (1, 0)}


def test_tables_of_one_row_group_are_worked_on_by_many_tasks(spark, tmpdir_path):
    from contactlake.plans.derived import incoming_updates, raw_contacts

    def keep(df, name):
        df.coalesce(1).write.parquet(f"{tmpdir_path}/{name}.parquet")

    customers = spark.range(0, 400).selectExpr("nullif(id, 7) AS c_custkey", "id % 3 AS c_nationkey", "'BUILDING' AS c_mktsegment")
    keep(customers.unionByName(customers.limit(20)), "customer")
    keep(spark.range(3).selectExpr("id AS n_nationkey", "concat('N', id) AS n_name", "id % 2 AS n_regionkey"), "nation")
    keep(spark.range(2).selectExpr("id AS r_regionkey", "concat('R', id) AS r_name"), "region")
    keep(spark.range(0, 500).selectExpr("id AS o_orderkey", "id % 90 AS o_custkey", "'F' AS o_orderstatus", "'1-URGENT' AS o_orderpriority"), "orders")
    for df, n in ((raw_contacts(spark, tmpdir_path), 420), (incoming_updates(spark, tmpdir_path), 500)):
        parts = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("part")).count().collect()]
        assert sum(parts) == n and len(parts) > 3 and max(parts) < n // 2
