"""Operator expectations modelled on the reference's ingest and table tests."""

from pyspark.sql import functions as F

from contactlake import schema as S
from contactlake.operators.columns import column_catalog, display_order, map_columns
from contactlake.operators.dedupe import dedupe_by_email, dedupe_by_name_company
from contactlake.operators.enrich import enrich_records
from contactlake.operators.normalize import has_people_identifier, normalize
from contactlake.operators.search import build_filters, page_bounds, page_count, search, search_after, search_total
from contactlake.operators.stats import by_lead_source, quality_profile, recent_cutoff, statistics


def frame(spark, cols, rows):
    schema = ", ".join(f"`{c}` {'long' if c == '_row_id' else 'string'}" for c in cols)
    return spark.createDataFrame(rows, schema)


def test_alias_headers_and_index_column(spark):
    df = frame(spark, ["_row_id", "Unnamed: 0", "E-Mail ", "FNAME", "lname", "Organization", "website", "Email"],
               [(1, "0", "a@x.com", "A", "L", "org", "x.com", "b@x.com")])
    mapped, warnings = map_columns(df)
    assert mapped.columns == ["_row_id", "Unnamed: 0", S.EMAIL, S.FIRST, S.LAST, S.COMPANY, S.WEBSITE]
    assert warnings and mapped.first()[S.EMAIL] == "a@x.com"
    out = normalize(mapped)
    assert "Unnamed: 0" not in out.columns and out.first()[S.LEAD_SOURCE] == "Excel Upload"


def test_normalize_dirty_rows(spark):
    df = frame(spark, ["_row_id", S.EMAIL, S.COMPANY, S.WEBSITE, S.FIRST],
               [(1, "  test@example.com  ", "  acme   corp ", "https://www.acme.com/path", " Ann "),
                (2, "invalid", "x", "", "B"),
                (3, None, None, None, None)])
    rows = normalize(df, lead_source="Website Scrape").collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r[S.EMAIL], r[S.COMPANY], r[S.WEBSITE], r[S.FIRST]) == ("test@example.com", "Acme Corp", "acme.com", "Ann")
    assert r[S.LEAD_SOURCE] == "Website Scrape" and r[S.EMAIL_SEND] == "No"


def test_empty_emails_dropped(spark):
    df = frame(spark, ["_row_id", S.EMAIL], [(1, "valid@example.com"), (2, ""), (3, "  "), (4, None)])
    assert [r[S.EMAIL] for r in normalize(df).collect()] == ["valid@example.com"]


def test_email_send_kept_when_present(spark):
    df = frame(spark, ["_row_id", S.EMAIL, S.EMAIL_SEND], [(1, "a@x.com", "Yes"), (2, "b@x.com", None)])
    got = {r[S.EMAIL]: r[S.EMAIL_SEND] for r in normalize(df).collect()}
    assert got == {"a@x.com": "Yes", "b@x.com": ""}


def test_dedupe_keeps_first(spark):
    df = frame(spark, ["_row_id", S.EMAIL, S.FIRST], [(3, "a@x.com", "third"), (1, "a@x.com", "first"),
                                                     (2, "b@x.com", "B")])
    got = {r[S.EMAIL]: r[S.FIRST] for r in dedupe_by_email(df)[0].collect()}
    assert got == {"a@x.com": "first", "b@x.com": "B"}
    df2 = frame(spark, ["_row_id", S.FIRST, S.LAST, S.COMPANY],
                [(1, "A", "B", "C"), (2, "A", "B", "C"), (3, "A", "B", None), (4, "A", "B", None), (5, "A", "B", "")])
    assert sorted(r["_row_id"] for r in dedupe_by_name_company(df2)[0].collect()) == [1, 3, 5]
    no_email = frame(spark, ["_row_id", S.FIRST], [(1, "A")])
    same, warn = dedupe_by_email(no_email)
    assert same.count() == 1 and warn


def test_people_identifier(spark):
    df = frame(spark, ["_row_id", S.EMAIL, S.FIRST, S.LAST, S.COMPANY, S.WEBSITE],
               [(1, "a@x.com", "", "", "", ""), (2, "", "A", "", "", ""), (3, "", "A", "B", "", ""),
                (4, " ", "", "", " ", "x.com"), (5, None, None, None, None, None)])
    got = {r["_row_id"]: r["ok"] for r in df.select("_row_id", has_people_identifier(df).alias("ok")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False}


def test_merge_enriched_from_tables(spark):
    from contactlake.functions.provider import ORG_SCHEMA, PERSON_SCHEMA

    df = frame(spark, ["_row_id", S.EMAIL, S.FIRST, S.TITLE, S.WEBSITE, S.COMPANY],
               [(1, "a@x.com", "", "Keep", "acme.com", "Orig Co"), (2, "b@x.com", "B", "", "", "")])
    person = F.struct(*[(F.lit("Ann") if f.name == "first_name" else F.lit("New") if f.name == "title"
                         else F.lit(None)).cast(f.dataType).alias(f.name) for f in PERSON_SCHEMA.fields])
    people = spark.range(1).select(F.lit("a@x.com").alias("email"), F.lit(None).cast("string").alias("first_name"),
                                   F.lit(None).cast("string").alias("last_name"),
                                   F.lit(None).cast("string").alias("organization_domain"),
                                   F.lit(None).cast("string").alias("organization_name"), person.alias("person"))
    org = F.struct(*[(F.lit("Acme Inc") if f.name == "name" else F.lit(None)).cast(f.dataType).alias(f.name)
                     for f in ORG_SCHEMA.fields])
    orgs = spark.range(1).select(F.lit("acme.com").alias("domain"), org.alias("organization"))
    out = {r[S.EMAIL]: r for r in enrich_records(df, people, orgs).frame.collect()}
    a = out["a@x.com"]
    # person fills empty first name; the original non-empty title beats the person value
    # once companies are enriched too; the organisation value beats the original company
    assert a[S.FIRST] == "Ann" and a[S.TITLE] == "Keep" and a[S.COMPANY] == "Acme Inc"
    assert a[S.LISTED] == "No" and out["b@x.com"][S.LISTED] == ""
    only_people = {r[S.EMAIL]: r for r in enrich_records(df, people, None).frame.collect()}
    assert only_people["a@x.com"][S.TITLE] == "New"  # people stage alone: person value wins


def test_search_paging_and_stats(spark):
    t = frame(spark, [S.EMAIL, S.COMPANY, S.LEAD_SOURCE, S.UPDATED],
              [(f"u{i}@x.com", "Acme" if i % 2 else "Beta", "Excel Upload" if i < 5 else None,
                "2024-01-30T00:00:00Z" if i < 3 else "2024-01-01T00:00:00Z") for i in range(10)])
    t = t.withColumn(S.SN, F.regexp_extract(S.EMAIL, r"^u(\d+)@", 1).cast("long") + 1)
    f = build_filters(company=" acme ", email="")
    assert f == {S.COMPANY: "acme"}
    assert search_total(t, f).first()["total"] == 5
    page = [r[S.EMAIL] for r in search(t, f, limit=2, offset=2).collect()]
    assert page == ["u5@x.com", "u7@x.com"]
    assert [r[S.EMAIL] for r in search_after(t, f, last_sn=6, limit=2).collect()] == ["u7@x.com", "u9@x.com"]
    assert search(t, {S.COMPANY: "ACME"}, case_sensitive=True).count() == 0
    assert page_bounds(3, 25) == 50 and page_count(0, 50) == 1 and page_count(101, 50) == 3
    st = statistics(t, "2024-01-31T00:00:00Z").first()
    assert st["total_records"] == 10 and st["recent_updates"] == 3
    assert {r["lead_source"]: r["n"] for r in by_lead_source(t).collect()} == {"Excel Upload": 5, None: 5}
    assert recent_cutoff("2024-01-31T00:00:00Z", boundary_day=True) == "2024-01-24 00:00:00"
    q = quality_profile(t.drop(S.SN)).first()
    assert q["rows"] == 10 and q["will_enrich"] == 10


def test_display_order_and_catalog(spark):
    P = S.DEFAULT_PREFIXES
    df = frame(spark, [S.SN, S.EMAIL, P.company + "Keywords", S.FIRST, P.person + "Headline"], [])
    assert display_order(df).columns == [S.EMAIL, S.FIRST, S.SN, P.company + "Keywords", P.person + "Headline"]
    cat = [(r["name"], r["kind"], r["ordinal"]) for r in column_catalog(spark, df).orderBy("ordinal").collect()]
    assert cat[:3] == [(S.SN, "base", 0), (S.EMAIL, "base", 1), (S.FIRST, "base", 2)]
    assert [c[0] for c in cat[3:]] == sorted([P.company + "Keywords", P.person + "Headline"])


def test_people_match_by_name_when_no_email(spark):
    from contactlake.functions.provider import PERSON_SCHEMA

    df = frame(spark, ["_row_id", S.EMAIL, S.FIRST, S.LAST, S.WEBSITE, S.COMPANY, S.TITLE],
               [(1, "", "Ann", "Lee", "acme.com", "Acme", ""), (2, "", "Bob", "Ray", "", "Beta Co", ""),
                (3, "", "Cy", "", "", "", "")])
    person = F.struct(*[(F.lit("Found") if f.name == "title" else F.lit(None)).cast(f.dataType).alias(f.name)
                        for f in PERSON_SCHEMA.fields])
    rows = [("Ann", "Lee", "acme.com", None), ("Bob", "Ray", None, "Beta Co"), ("Cy", None, None, None)]
    prov = spark.createDataFrame(rows, "first_name string, last_name string, organization_domain string, "
                                       "organization_name string") \
        .withColumn("email", F.lit(None).cast("string")).withColumn("person", person)
    out = {r["_row_id"]: r for r in enrich_records(df, prov, None, provider_unique=True).frame.collect()}
    assert out[1][S.TITLE] == "Found" and out[2][S.TITLE] == "Found"
    # row 3 has no identifier (first name alone): skipped, not looked up
    assert out[3][S.TITLE] == "" and out[3]["_enrichment_error"] == S.SKIPPED_NO_IDENTIFIER


def test_rejected_emails_and_enrichment_counts(spark):
    from contactlake.operators.normalize import rejected_emails
    from contactlake.operators.stats import enrichment_counts

    df = frame(spark, ["_row_id", S.EMAIL, S.FIRST], [(1, "a@x.com", "A"), (2, "bad", "B"), (3, None, "C"),
                                                      (4, None, None)])
    # row 4 is entirely empty: dropped before the e-mail check, not counted as rejected
    assert sorted(r["_row_id"] for r in rejected_emails(df).collect()) == [2, 3]
    e = frame(spark, ["_row_id", "_enrichment_error"], [(1, ""), (2, None), (3, "API error 400: x")])
    c = enrichment_counts(e).first()
    assert (c["enriched"], c["with_error"]) == (2, 1)


def test_provider_numbers_as_text_and_empty_objects(spark):
    from contactlake.functions.provider import ORG_SCHEMA, map_company

    replies = ['{"estimated_num_employees": "1,000", "founded_year": 1999.0, "alexa_ranking": "12"}',
               '{"estimated_num_employees": 250, "founded_year": 0, "departmental_head_count": {"a": 0, "b": 3, "c": "4"}}',
               "{}", None, '{"name": "X"}']
    rows = spark.createDataFrame(list(enumerate(replies)), "i long, reply string").select(
        "i", F.from_json("reply", ORG_SCHEMA).alias("o"))
    got = {r["i"]: r for r in rows.select("i", *[v.alias(k) for k, v in map_company(F.col("o"))]).collect()}
    prefix = S.DEFAULT_PREFIXES.company
    assert (got[0][S.EMPLOYEES], got[0][prefix + "Founded Year"], got[0][prefix + "Alexa Ranking"]) == ("1,000", "1999.0", "12")
    assert (got[1][S.EMPLOYEES], got[1][prefix + "Founded Year"]) == ("250", None)
    assert got[1][prefix + "Department Headcount"] == "b: 3, c: 4"
    assert [got[i][S.LISTED] for i in range(5)] == ["No", "No", None, None, "No"]


def test_keep_first_wide_equals_keep_first(spark):
    from contactlake.operators.dedupe import keep_first, keep_first_wide

    rows = [(i, ["a", "a,1:b", None, "", "long " * 500][i % 5], [None, "b", "1:b"][i % 3], f"r{i}") for i in range(300)]
    rows += [(1000 + i, "hot", "hot", "x") for i in range(200)]
    df = spark.createDataFrame(rows, "_row_id long, k string, l string, v string").repartition(6)
    for keys in (["k"], ["k", "l"], ["l"]):
        got = keep_first_wide(df, keys)
        assert got.columns == df.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, keep_first(df, keys).collect()))
    assert keep_first_wide(df.limit(0), ["k"]).collect() == []
    plan = keep_first_wide(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
