"""CSV read by splits, page index, trigram index, Bloom filters and ordered exports."""

import csv
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from contactlake import schema as S
from contactlake.operators.columns import qcol
from contactlake.operators.page_index import PageIndex
from contactlake.operators.search import apply_filters
from contactlake.operators.trigram_index import TrigramIndex
from contactlake.plans.flows import export_store, write_parts
from contactlake.sources import csv_records
from contactlake.sources.files import read_contacts
from contactlake.sources.store import TruthStore, empty_truth


def small_splits(spark, n_bytes):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(n_bytes))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    return old


def large_splits(spark, old):
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def write_rows(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as fh:
        out = csv.writer(fh, lineterminator=end)
        out.writerow(["Email", "Full, name", 'No"te', "n"])
        out.writerows(rows)


@pytest.mark.parametrize("lines", [False, True])
@pytest.mark.parametrize("split", [60, 333, 1 << 20])
def test_csv_of_many_splits_equals_the_whole_file_reader(spark, tmpdir_path, lines, split):
    rng = random.Random(split)
    pieces = ["a", 'say "x"', "é,ü", "", " ", "long " * 30] + (["one\ntwo", "\n", 'end "\n\n" of', '\n"'] if lines else [])
    os.makedirs(f"{tmpdir_path}/in")
    for name in ("b", "a"):
        write_rows(f"{tmpdir_path}/in/{name}.csv",
                   [[f"{name}{i}@x.com", rng.choice(pieces), rng.choice(pieces), f"{name}{i}"] for i in range(120)],
                   "\r\n" if name == "b" else "\n")
    plain = spark.read.options(header=True, multiLine=True, escape='"').csv(f"{tmpdir_path}/in")
    want = sorted((tuple(r) for r in plain.collect()), key=str)
    old = small_splits(spark, split)
    try:
        assert csv_records.spans_lines(spark, f"{tmpdir_path}/in") == lines
        df = read_contacts(spark, f"{tmpdir_path}/in", "csv")
        rows = df.orderBy("_row_id").collect()
        if split == 60:
            assert spark.read.text(f"{tmpdir_path}/in").rdd.getNumPartitions() > 20
    finally:
        large_splits(spark, old)
    assert [c for c in df.columns if c != "_row_id"] == plain.columns
    assert sorted((tuple(r)[:-1] for r in rows), key=str) == want
    assert [r["n"] for r in rows] == [f"{name}{i}" for name in ("a", "b") for i in range(120)]
    assert [r["_row_id"] for r in rows] == list(range(240))


def test_csv_with_other_rules_is_read_as_before(spark, tmpdir_path):
    with open(f"{tmpdir_path}/o.csv", "w") as fh:
        fh.write("Email;n\n'a;\nb';1\nc;2\n")
    df = read_contacts(spark, f"{tmpdir_path}/o.csv", "csv", sep=";", quote="'")
    assert sorted((r["Email"], r["n"]) for r in df.collect()) == [("a;\nb", "1"), ("c", "2")]


def truth(spark, n, **columns):
    base = empty_truth(spark)
    made = spark.range(n).select(*[
        {S.SN: (F.col("id") * 3 + 1), S.EMAIL: F.concat(F.lit("user"), "id", F.lit("@example.com")), S.UPDATED: F.lit("t"), **columns}
        .get(c, F.lit(None)).cast(t).alias(c) for c, t in ((f.name, f.dataType) for f in base.schema)])
    return base.unionByName(made)


def test_deep_pages_equal_offset_and_limit(spark, tmpdir_path):
    t = truth(spark, 1000, **{S.COMPANY: F.when(F.col("id") % 7 < 2, "Acme").otherwise("Other")}).repartition(5)
    index = PageIndex(spark, f"{tmpdir_path}/pages", width=100).build(t)
    for filters in (None, {S.COMPANY: "acm"}, {S.COMPANY: "nothing"}):
        counts = index.counts(filters)
        rows = apply_filters(t, filters).orderBy(qcol(S.SN)).select(qcol(S.SN)).collect()
        assert index.total(counts) == len(rows)
        for offset in (0, 1, 33, 34, 250, len(rows) - 3, len(rows), 5000):
            offset = max(0, offset)
            for limit in (1, 50, 100):
                got = index.page(limit, offset, filters, counts).select(qcol(S.SN)).collect()
                assert got == rows[offset:offset + limit]
                if offset == 250:
                    folders, rest = index.folders(limit, offset, counts)
                    assert rest < 100 and len(folders) <= 1 + limit
    page = index.page(10, 900)
    assert len(page.collect()) == 10 and 0 < scanned(page) <= 34  # one folder of thirty
    with pytest.raises(ValueError):
        index.page(0)
    empty = PageIndex(spark, f"{tmpdir_path}/empty", width=10).build(t.where("false").unionByName(t.limit(0)).unionByName(t.limit(1)))
    assert empty.page(5, 7).collect() == []


def test_trigram_search_equals_the_full_search_and_reads_fewer_files(spark, tmpdir_path):
    names = ["Ann Bülow", "bob_smith", "ÉCOLE 50%", None, "", "ab", "İstanbul", "a\\b\\c"]
    rows = [(i, names[i % len(names)], f"user{i}@{'rare' if i == 77 else 'common'}.example") for i in range(400)]
    t = spark.createDataFrame(rows, "id long, name string, mail string")
    t.repartitionByRange(10, "id").write.parquet(f"{tmpdir_path}/t")
    t = spark.read.parquet(f"{tmpdir_path}/t")
    index = TrigramIndex(spark, f"{tmpdir_path}/grams").build(t, ["name", "mail"])
    assert index.files().count() == 10
    cases = [{"name": "bül"}, {"name": "BOB_S"}, {"name": "cole%50"}, {"name": "a"}, {"name": "%"}, {"mail": "RARE"}, {"name": "\\b\\"},
             {"mail": "rare", "name": "nothing"}, {"mail": "user77"}, {"name": "ann", "mail": "common"}, None, {"name": "école"}, {"name": "istanbul"}]
    for filters in cases:
        for sensitive in (False, True):
            want = sorted(r["id"] for r in apply_filters(t, filters, sensitive).collect())
            assert sorted(r["id"] for r in index.search(t, filters, sensitive).collect()) == want, filters
    assert index.candidates({"mail": "rare"}).count() == 1
    assert index.candidates({"mail": "absent"}).count() == 0
    assert index.candidates({"mail": "ra"}).count() == 10


def scanned(df):
    """Rows that the scans of an executed frame gave out."""
    plan, n = df._jdf.queryExecution().executedPlan(), 0
    stack = [plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan]
    while stack:
        node = stack.pop()
        children = node.children()
        stack += [children.apply(i) for i in range(children.length())]
        name = node.getClass().getSimpleName()
        if name.endswith("QueryStageExec"):
            stack.append(node.plan())
        if name == "FileSourceScanExec":
            n += node.metrics().apply("numOutputRows").value()
    return n


def test_lookup_of_an_absent_email_reads_no_row_group(spark, tmpdir_path):
    store = TruthStore(spark, f"{tmpdir_path}/truth", buckets=1)
    store.commit(truth(spark, 5000))
    hit = store.lookup("user4000@example.com")
    assert [r[S.SN] for r in hit.collect()] == [12001]
    for absent in ("user40000@example.com", "user1x@example.com", "user77@example.org"):
        df = store.read().where(qcol(S.EMAIL) == absent)
        assert df.collect() == [] and scanned(df) == 0
    inside = store.read().where(qcol(S.LAST).isNull() & (qcol(S.EMAIL) >= "user4"))
    assert len(inside.collect()) > 0 and scanned(inside) > 0


def test_exports_in_order_by_the_writer(spark, tmpdir_path):
    store = TruthStore(spark, f"{tmpdir_path}/truth", buckets=3)
    store.commit(truth(spark, 500, **{S.FIRST: F.concat(F.lit('a "b",\n'), F.col("id"))}))
    for fmt in ("csv", "parquet"):
        paths, name = export_store(store, f"{tmpdir_path}/{fmt}", fmt=fmt, rows_per_file=60, email="user1")
        assert paths == [f"{tmpdir_path}/{fmt}"] and "." not in name
        files = sorted(f for f in os.listdir(f"{tmpdir_path}/{fmt}") if f.startswith("part"))
        assert len(files) > 1
        got = []
        for f in files:
            part = read_contacts(spark, f"{tmpdir_path}/{fmt}/{f}", fmt).orderBy("_row_id").collect()
            assert 0 < len(part) <= 60
            got += [(int(r[S.SN]), r[S.EMAIL], r[S.FIRST]) for r in part]
        ids = [i for i in range(500) if str(i).startswith("1")]
        assert got == [(3 * i + 1, f"user{i}@example.com", f'a "b",\n{i}') for i in ids]


def test_an_empty_export_has_a_header(spark, tmpdir_path):
    write_parts(spark.createDataFrame([], "a string, b string"), f"{tmpdir_path}/e", "csv")
    assert read_contacts(spark, f"{tmpdir_path}/e", "csv").collect() == []


def test_lines_of_a_split_are_counted_as_they_are_read(spark, tmpdir_path):
    write_rows(f"{tmpdir_path}/x.csv", [[f"u{i}", "one\ntwo" if i % 3 else "a", 'say "x\n"' if i % 5 == 0 else "", i] for i in range(300)])
    want = sorted(tuple(r) for r in spark.read.options(header=True, multiLine=True, escape='"').csv(f"{tmpdir_path}/x.csv").collect())
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(most)
    spark.conf.set(most, "7")  # what one batch counted goes on in the next
    try:
        plan = csv_records.records(spark, f"{tmpdir_path}/x.csv")._jdf.queryExecution().optimizedPlan().toString()
        rows = read_contacts(spark, f"{tmpdir_path}/x.csv", "csv").orderBy("_row_id").collect()
    finally:
        spark.conf.set(most, old)
    assert not re.search(r"windowspecdefinition\(path#\d+, block#\d+L?, at#", plan)  # no task sorts a split's lines
    assert sorted(tuple(r)[:-1] for r in rows) == want
    assert [r["n"] for r in rows] == [str(i) for i in range(300)]


def test_page_index_has_a_bounded_number_of_folders(spark, tmpdir_path, monkeypatch):
    from contactlake.operators import page_index

    monkeypatch.setattr(page_index, "FOLDERS", 4, raising=False)
    t = truth(spark, 1000, **{S.COMPANY: F.when(F.col("id") % 7 < 2, "Acme").otherwise("Other")}).repartition(5)
    t = t.withColumn(S.SN, F.when(qcol(S.SN) > 4, qcol(S.SN)))  # two without a number
    index = PageIndex(spark, f"{tmpdir_path}/few", width=100).build(t)
    assert len([x for x in os.listdir(f"{tmpdir_path}/few/rows") if x.startswith("_")]) <= 4 + 2 + 1  # _SUCCESS is one
    for filters in (None, {S.COMPANY: "acm"}):
        counts = index.counts(filters)
        rows = apply_filters(t, filters).orderBy(qcol(S.SN)).select(qcol(S.SN)).collect()
        for offset in (0, 1, 250, len(rows) - 3, 5000):
            assert index.page(50, offset, filters, counts).select(qcol(S.SN)).collect() == rows[offset:offset + 50]
            assert index.folders(50, offset, counts)[1] < 100
