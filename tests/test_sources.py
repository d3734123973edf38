"""Workbook reader/writer, file readers and the snapshot store."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from contactlake import schema as S
from contactlake.sources.files import read_contacts
from contactlake.sources.store import TruthStore, empty_truth
from contactlake.sources import workbook
from contactlake.sources.workbook import build_xlsx, export_workbooks, parse_xlsx, read_workbooks


def write(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as fh:
        fh.write(data)


def two_sheet_shared_strings() -> bytes:
    m = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets>'
                   '<sheet name="Sheet1" sheetId="1" r:id="rId1"/><sheet name="Sheet2" sheetId="2" r:id="rId2"/>'
                   '</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Target="worksheets/sheet1.xml" Type="x"/>'
                   '<Relationship Id="rId2" Target="worksheets/sheet2.xml" Type="x"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{m}"><si><t>Email</t></si><si><t>First Name</t></si>'
                   '<si><t>a@x.com</t></si><si><r><t>A</t></r><r><t>nn</t></r></si><si><t>NA</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{m}"><sheetData>'
                   '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'
                   '<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2" t="s"><v>3</v></c><c r="C2"><v>42</v></c></row>'
                   '<row r="4"><c r="B4" t="s"><v>4</v></c><c r="C4" t="b"><v>1</v></c></row>'
                   '</sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{m}"><sheetData/></worksheet>')
    return out.getvalue()


def test_parse_xlsx_cells():
    n, rows = parse_xlsx(two_sheet_shared_strings())
    assert n == 2
    assert rows[0] == ["Email", "First Name"]
    assert rows[1] == ["a@x.com", "Ann", "42"]
    assert rows[2] == []
    assert rows[3] == [None, None, "True"]


def test_read_workbooks_warnings_and_names(spark, tmpdir_path):
    write(f"{tmpdir_path}/in/a.xlsx", two_sheet_shared_strings())
    res = read_workbooks(spark, f"{tmpdir_path}/in")
    assert any("Multiple sheets" in w for w in res.warnings)
    rows = res.frame.orderBy("_row_id").collect()
    assert res.frame.columns[1:4] == ["Email", "First Name", "Unnamed: 2"]
    assert [r["_row_id"] for r in rows] == [0, 1, 2]
    assert rows[0]["Email"] == "a@x.com" and rows[1]["Email"] is None and rows[2]["Unnamed: 2"] == "True"


def test_repeated_header_and_roundtrip(spark, tmpdir_path):
    data = build_xlsx(["Email", "Email", "First Name"], [["a@x.com", "b@x.com", "A"], ["c@x.com", None, ""]])
    write(f"{tmpdir_path}/rt/one.xlsx", data)
    res = read_workbooks(spark, f"{tmpdir_path}/rt")
    assert any("Duplicate column names" in w for w in res.warnings)
    assert [c for c in res.frame.columns if not c.startswith("_")] == ["Email", "Email.1", "First Name"]
    rows = res.frame.orderBy("_row_id").collect()
    assert rows[1]["Email.1"] is None and rows[1]["First Name"] is None


def test_size_and_row_limits(spark, tmpdir_path):
    write(f"{tmpdir_path}/big/a.xlsx", build_xlsx(["Email"], [[f"u{i}@x.com"] for i in range(5)]))
    with pytest.raises(ValueError, match="too large"):
        read_workbooks(spark, f"{tmpdir_path}/big", max_file_mb=0.0001)
    with pytest.raises(ValueError, match="rows"):
        read_workbooks(spark, f"{tmpdir_path}/big", max_rows=3)
    assert read_workbooks(spark, f"{tmpdir_path}/big", max_rows=5).frame.count() == 5


def test_csv_input_order(spark, tmpdir_path):
    os.makedirs(f"{tmpdir_path}/csv")
    for name, start in (("b.csv", 100), ("a.csv", 0)):
        with open(f"{tmpdir_path}/csv/{name}", "w") as fh:
            fh.write("Email,n\n" + "".join(f"u{start + i}@x.com,{start + i}\n" for i in range(50)))
    df = read_contacts(spark, f"{tmpdir_path}/csv", "csv")
    got = [r["n"] for r in df.orderBy("_row_id").collect()]
    assert got == [str(i) for i in range(50)] + [str(100 + i) for i in range(50)]


def test_truth_store_replaces_the_whole_table(spark, tmpdir_path):
    store = TruthStore(spark, f"{tmpdir_path}/truth")
    assert store.read().count() == 0 and store.max_sn() is None
    t = empty_truth(spark)
    row = spark.createDataFrame([tuple([1] + [None] * 13 + ["a@x.com"] + [None] * 6 + ["t", "No"])], t.schema)
    for _ in range(2):  # a replay changes nothing
        store.commit(t.unionByName(row))
        assert store.lookup("a@x.com").count() == 1 and store.read().count() == 1
        assert store.read().columns == t.columns
    store.commit(t)
    assert store.read().count() == 0 and store.lookup("a@x.com").count() == 0


def bucket_files(store):
    import glob

    return {int(f.split("/_bucket=")[1].split("/")[0]): f for f in glob.glob(f"{store.root}/_buckets=*/_bucket=*/*.parquet")}


def test_bucketed_incremental_commit(spark, tmpdir_path):
    from contactlake.operators.upsert import upsert

    store = TruthStore(spark, f"{tmpdir_path}/bk", buckets=8)
    schema = f"_row_id long, `{S.EMAIL}` string, `{S.FIRST}` string"
    first = spark.createDataFrame([(i, f"u{i}@x.com", f"F{i}") for i in range(40)], schema)
    store.commit(upsert(store.read(), first, now="t1").state)
    assert store.max_sn() == 40
    old = bucket_files(store)
    assert sorted(old) == list(range(8))
    second = spark.createDataFrame([(100, "u3@x.com", "X"), (101, "new@x.com", "N")], schema)
    touched = store.touched_buckets(second)
    assert 1 <= len(touched) <= 2
    res2 = upsert(store.read(buckets=touched), second, now="t2", max_sn=store.max_sn())
    store.commit(res2.state, buckets=touched)
    new = bucket_files(store)
    assert {b for b in new if new[b] != old[b]} == set(touched) and sorted(new) == list(range(8))
    rows = {r[S.EMAIL]: r for r in store.read().collect()}
    assert len(rows) == 41 and rows["new@x.com"][S.SN] == 41 and rows["u3@x.com"][S.FIRST] == "F3"
    assert store.max_sn() == 41
    listed = store.read(buckets=touched)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in listed and "_bucket" in listed


def test_a_batch_applied_in_part_is_made_whole_by_a_replay(spark, tmpdir_path):
    from contactlake.operators.upsert import upsert

    store = TruthStore(spark, f"{tmpdir_path}/part", buckets=8)
    schema = f"_row_id long, `{S.EMAIL}` string, `{S.FIRST}` string"
    store.commit(upsert(store.read(), spark.createDataFrame([(i, f"u{i}@x.com", "") for i in range(40)], schema), now="t1").state)
    batch = spark.createDataFrame([(i, f"u{i}@x.com", f"F{i}") for i in range(45)], schema)
    touched = store.touched_buckets(batch)
    res = upsert(store.read(buckets=touched), batch, now="t2", max_sn=store.max_sn())
    state = res.state.checkpoint()
    half = touched[: len(touched) // 2]
    from contactlake.sources.store import bucket_of
    from contactlake.operators.columns import qcol

    store.commit(state.where(bucket_of(qcol(S.EMAIL), 8).isin(half)), buckets=half)  # as if the driver died half-way
    again = upsert(store.read(buckets=touched), batch, now="t2", max_sn=store.max_sn())
    store.commit(again.state, buckets=touched)
    rows = {r[S.EMAIL]: r for r in store.read().collect()}
    assert {e: r[S.FIRST] for e, r in rows.items()} == {f"u{i}@x.com": f"F{i}" for i in range(45)}
    assert len({r[S.SN] for r in rows.values()}) == 45


def test_provider_response_zip(spark, tmpdir_path):
    import json

    from contactlake.sources.provider import read_responses, zip_responses

    os.makedirs(f"{tmpdir_path}/resp")
    with open(f"{tmpdir_path}/resp/r.json", "w") as fh:
        fh.write(json.dumps({"batch_id": 0, "matches": [{"first_name": "A"}, None, {"title": "CTO"}]}) + "\n")
        fh.write(json.dumps({"batch_id": 1, "matches": []}) + "\n")
    resp = read_responses(spark, f"{tmpdir_path}/resp", "people")
    reqs = spark.createDataFrame([(10, 0, 0), (11, 0, 1), (12, 0, 2), (13, 1, 0)], "_row_id long, batch_id long, pos int")
    got = {r["_row_id"]: r["match"] for r in zip_responses(reqs, resp).collect()}
    assert got[10]["first_name"] == "A" and got[11] is None and got[12]["title"] == "CTO" and got[13] is None


def test_request_batches(spark):
    import json

    from contactlake.operators.enrich import request_batches

    df = spark.createDataFrame(
        [(i, f"u{i}@x.com", f"F{i}", "", "" if i % 2 else f"www.d{i}.com") for i in range(23)],
        f"_row_id long, `{S.EMAIL}` string, `{S.FIRST}` string, `{S.COMPANY}` string, `{S.WEBSITE}` string")
    people = {r["batch_id"]: json.loads(r["payload"]) for r in request_batches(df, "people").collect()}
    assert sorted(people) == [0, 1, 2] and [len(people[b]["details"]) for b in (0, 1, 2)] == [10, 10, 3]
    assert people[0]["details"][0] == {"first_name": "F0", "organization_domain": "www.d0.com", "email": "u0@x.com"}
    orgs = {r["batch_id"]: json.loads(r["payload"]) for r in request_batches(df, "companies").collect()}
    assert orgs[0]["domains"][:2] == ["d0.com", "d2.com"] and sum(len(v["domains"]) for v in orgs.values()) == 12
    with pytest.raises(ValueError):
        request_batches(df, "people", size=11)


def test_companies_are_asked_once_a_domain(spark):
    from contactlake.operators.enrich import enrich_records

    def provider(endpoint, payload, timeout):
        if len(payload["domains"]) != len(set(payload["domains"])) or len(payload["domains"]) > 2:
            raise ValueError("asked more than once")
        return {"matches": [{"name": f"Org {d}"} for d in payload["domains"]]}

    df = spark.createDataFrame(
        [(i, f"u{i}@x.com", "", ["www.a.com", "http://b.org/x", ""][i % 3]) for i in range(60)],
        f"_row_id long, `{S.EMAIL}` string, `{S.COMPANY}` string, `{S.WEBSITE}` string").coalesce(1)
    got = enrich_records(df, None, provider, enrich_people=False).frame.collect()
    assert {(r["_row_id"] % 3, r[S.COMPANY], r["_enrichment_error"]) for r in got} == {
        (0, "Org a.com", ""), (1, "Org b.org", ""), (2, "", "")}
    assert len(got) == 60


def test_input_order_across_splits(spark, tmpdir_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    os.makedirs(f"{tmpdir_path}/pq")
    for name, start in (("b.parquet", 5000), ("a.parquet", 0)):
        t = pa.table({"Email": [f"u{i}@x.com" for i in range(start, start + 4000)],
                      "n": list(range(start, start + 4000))})
        pq.write_table(t, f"{tmpdir_path}/pq/{name}", row_group_size=500)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = read_contacts(spark, f"{tmpdir_path}/pq", "parquet")
        assert spark.read.parquet(f"{tmpdir_path}/pq").rdd.getNumPartitions() > 2
        got = [int(r["n"]) for r in df.orderBy("_row_id").collect()]
        ids = sorted(r["_row_id"] for r in df.select("_row_id").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == list(range(0, 4000)) + list(range(5000, 9000))
    assert ids == list(range(8000))


def test_a_commit_leaves_no_old_files(spark, tmpdir_path):
    from contactlake.operators.upsert import upsert

    store = TruthStore(spark, f"{tmpdir_path}/old", buckets=4)
    schema = f"_row_id long, `{S.EMAIL}` string, `{S.FIRST}` string"
    store.commit(upsert(store.read(), spark.createDataFrame([(i, f"u{i}@x.com", "A") for i in range(20)], schema), now="t").state)
    for k in range(3):
        b = spark.createDataFrame([(100 + k, "u1@x.com", "B")], schema)
        touched = store.touched_buckets(b)
        store.commit(upsert(store.read(buckets=touched), b, now=f"t{k}", max_sn=store.max_sn()).state, buckets=touched)
    assert store.read().count() == 20
    assert not [x for x in os.listdir(store.root) if x.startswith(".spark-staging")]


def test_input_order_survives_another_split_plan(spark, tmpdir_path):
    from contactlake.sources import files

    spark.range(4000).selectExpr("cast(id as string) AS a").coalesce(2).write.json(f"{tmpdir_path}/in")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        out = files.read_contacts(spark, f"{tmpdir_path}/in", "json")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        rows = out.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r["_row_id"] for r in rows) == list(range(4000))
    assert {r["a"] for r in rows} == {str(i) for i in range(4000)}


def test_store_keeps_its_bucket_count_and_reports_a_broken_file(spark, tmpdir_path):
    import glob

    import pytest

    from contactlake import schema as S
    from contactlake.operators.upsert import upsert
    from contactlake.sources.store import TruthStore

    rows = [(i, f"u{i}@x.com", "A") for i in range(40)]
    batch = spark.createDataFrame(rows, f"_row_id long, `{S.EMAIL}` string, `{S.FIRST}` string")
    store = TruthStore(spark, f"{tmpdir_path}/t", buckets=16)
    store.commit(upsert(store.read(), batch, now="n").state)
    again = TruthStore(spark, f"{tmpdir_path}/t", buckets=3)
    assert again.buckets == 16
    touched = again.touched_buckets(batch)
    res = upsert(again.read(buckets=touched), batch, now="n", max_sn=again.max_sn())
    assert {r["action"] for r in res.outcomes.collect()} == {"skip"}
    for f in glob.glob(f"{tmpdir_path}/t/_buckets=16/_bucket=*/*.parquet"):
        with open(f, "wb") as out:
            out.write(b"broken")
    with pytest.raises(Exception):
        TruthStore(spark, f"{tmpdir_path}/t").read().count()


def test_small_workbook_parts_share_tasks(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(workbook, "ROWS_A_TASK", 100)
    rows = [(i, f"u{i}@x.com" if i % 7 else None) for i in range(1, 1001)]
    df = spark.createDataFrame(rows, "`S.N.` long, Email string").repartition(3)
    calls = spark.sparkContext.accumulator(0)

    def seen(frames):
        for frame in frames:
            calls.add(len(frame))
            yield frame

    out = f"{tmpdir_path}/parts"
    paths = export_workbooks(df.toDF("sn", "Email").mapInPandas(seen, "sn long, Email string").toDF("S.N.", "Email"),
                             out, rows_per_part=20)
    assert calls.value == len(rows)  # counted, sampled and written: computed once
    sizes = [len(parse_xlsx(open(p, "rb").read())[1]) - 1 for p in paths]
    assert sum(sizes) == len(rows) and max(sizes) <= 20 and len(paths) >= 50
    assert len({p.split("-")[-2] for p in paths}) <= max(10, 2 * spark.sparkContext.defaultParallelism)
    back = read_workbooks(spark, out).frame.orderBy("_row_id").collect()
    assert [(r["_row_id"], int(r["S.N."]), r["Email"]) for r in back] == [(i - 1, i, e) for i, e in rows]
