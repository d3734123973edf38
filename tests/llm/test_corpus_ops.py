"""Operators that compare documents with one another, and the pipeline."""

import hashlib
import os
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from contactlake.llm import components, mixing, near_dup, suffix_dup, topk  # noqa: E402


def words(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def corpus(n=60):
    """(id, source, text): copies, near copies, a shared passage, odd texts."""
    rng = random.Random(9)
    passage = " ".join(words(rng, 110))
    rows = []
    for i in range(n):
        own = words(rng, rng.randrange(30, 160))
        if i % 5 == 1 and rows:
            own = rows[-1][2].split(" ")
            for _ in range(max(1, len(own) // 25)):
                own[rng.randrange(len(own))] = "edited"
        text = " ".join(own)
        if i % 7 == 3:
            text = passage + "\n" + text
        if i % 11 == 5:
            text = rows[rng.randrange(len(rows))][2]
        rows.append((i, ["a", "b", "ü", None][rng.choice([0, 0, 0, 1, 2, 3])], text))
    odd = [None, "", " ", "x" * 399, "x" * 400, "ab" * 900, "é" * 500, "q" + "é" * 400, "five words are not many", "one"]
    return rows + [(1000 + k, "a", t) for k, t in enumerate(odd)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, source string, text string").withColumn(
        "class_id", F.lit("mine")).withColumn("sha", F.lit(1)).repartition(5)


def test_banded_alignment():
    rng = random.Random(2)
    for _ in range(1500):
        a = [rng.randrange(6) for _ in range(rng.randint(1, 40))]
        b = list(a)
        for _ in range(rng.randrange(12)):
            k = rng.randrange(len(b) + 1)
            b[k:k + rng.randrange(2)] = [rng.randrange(6)] * rng.randrange(2)
        d = brute.edit_distance(a, b)
        for most in (0, 1, 2, 4, 8, 15):
            assert near_dup.banded(a, b, most) == (d <= most)
        if b:
            assert near_dup.similar(np.array(a, np.uint32), np.array(b, np.uint32)) == (5 * d <= max(len(a), len(b)))


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)]
    links += [(500, k) for k in range(501, 560)] + [(None, 3), (7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r["node"]: r["root"] for r in
           components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicates_match_brute_force(spark, docs):
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs).collect()}
    assert got == brute.near_classes([(i, t) for i, _, t in corpus()])
    assert near_dup.near_duplicates(docs.limit(0)).collect() == []


def test_near_duplicates_of_a_large_group_and_of_rows_without_id(spark):
    rng = random.Random(8)
    base = words(rng, 120)
    rows = []
    for i in range(300):
        own = list(base)
        own[rng.randrange(120)] = f"n{i}"
        rows.append((i, " ".join(own)))
    rows += [(None, rows[0][1]), (None, "only without an id"), (None, "only without an id"), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.near_duplicates(docs).collect()
    assert {r["class_id"] for r in got if r["doc_id"] is not None} == {0}
    kept = near_dup.without_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == [("0", rows[0][1]), ("None", "only without an id")]


def test_repeats_match_brute_force(spark, docs):
    rows = corpus()
    want = {i: x for (i, _, _), x in zip(rows, brute.repeats([t for _, _, t in rows]))}
    for chunk in (1 << 20, 3000):
        got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dup.remove_repeats(docs, chunk=chunk).collect()}
        assert got == {i: (*x[:3], hashlib.sha256(x[3]).hexdigest()) for i, x in want.items()}
    left = {r["doc_id"]: r["text"] for r in suffix_dup.without_repeats(docs).collect()}
    assert left == {i: None if t is None else want[i][3].decode("utf-8", "ignore") for i, _, t in rows}
    assert suffix_dup.remove_repeats(docs.limit(0)).collect() == []


def test_difference_covers():
    for q in (2, 3, 5, 7, 17):
        v, cover = suffix_dup.difference_cover(q)
        assert v == q * q + q + 1 and len(cover) == q + 1
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_mixing_matches_brute_force(spark, docs):
    rows = corpus()
    want, got = brute.mixed(rows), {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    assert {i: r["copies"] for i, r in got.items()} == want
    sizes = {r["source"]: r["source_size"] for r in got.values()}
    goal = brute.targets(sizes)
    for r in got.values():
        assert r["target"] == pytest.approx(goal[r["source"]])
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(docs.repartition(2)).collect()}
    assert again == want
    taken = {}
    for r in mixing.mixed_documents(docs).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + 1
        assert r["class_id"] == "mine"
    assert taken == {i: n for i, n in want.items() if n}
    assert mixing.mix(docs.limit(0)).collect() == []


def test_mixing_takes_about_the_target(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("abcdefg"), "w " * rng.randrange(1, 60)) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    for source in "abcdefg":
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["copies"] * r["size"] for r in own) - own[0]["target"]) <= 30


def test_mixing_takes_a_part_of_repeated_rows(spark):
    rows = [(i, "a", "w " * 100, i) for i in range(80)] + [(1000, "a", "w " * 100, 7)] * 3000
    rows += [(2000 + i, "b", "w " * 10, None) for i in range(20)] + [(3000, None, None, 1)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, k long").repartition(4)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    for source, size in (("a", 100), ("b", 10)):
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["copies"] * r["size"] for r in own) - own[0]["target"]) <= size / 2
        assert all(r["copies"] <= 2 for r in own)
    repeated = [r["copies"] for r in got if r["doc_id"] == 1000]
    assert len(repeated) == 3000 and len(set(repeated)) == 2
    count = lambda xs: sorted((k, xs.count(k)) for k in set(xs))
    want = count([r["doc_id"] for r in got for _ in range(r["copies"])])
    kept = mixing.mixed_documents(docs)
    assert kept.columns == docs.columns
    assert count([r["doc_id"] for r in kept.collect()]) == want
    assert {(r["doc_id"], r["k"]) for r in kept.collect()} <= {(r[0], r[3]) for r in rows}


def test_mixing_of_a_hot_null_source_without_broadcasts(spark):
    rows = [(i % 400, None if i % 3 else "a", "w " * (i % 9)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    key = "spark.sql.autoBroadcastJoinThreshold"
    old, found = spark.conf.get(key), []
    for most in (old, "-1"):
        spark.conf.set(key, most)
        try:
            planned = mixing.mix(docs).collect()
            n = mixing.mixed_documents(docs).count()
        finally:
            spark.conf.set(key, old)
        assert len(planned) == 600 and n == sum(r["copies"] for r in planned)
        found.append(sorted((r["doc_id"], r["source"] or "", r["size"], r["copies"]) for r in planned))
    assert found[0] == found[1]


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = {i: [float(x) for x in rng.normal(size=8).astype("float32")] for i in range(400)}
    for i in range(50, 90):
        vectors[i] = vectors[7]  # ties
    rows = [(i, v) for i, v in vectors.items()]
    rows += [(1000, None), (1001, [1.0, None] * 4), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8),
             (1100, [1.0, 2.0]), (None, [1.0] * 8), (1200, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("mine"))
    whole = {i: np.floor(1024 * np.array(v)).astype(int) for i, v in vectors.items()}
    want = [(q, k + 1, i, s) for q in range(0, 400, 100) for k, (s, i) in enumerate(
        sorted(((int(whole[q] @ whole[i]), i) for i in whole if i != q), key=lambda x: (-x[0], x[1]))[:10])]
    for tile in (2048, 16):
        got = topk.top_k(df, F.col("vec_id") % 100 == 0, tile=tile).collect()
        assert sorted(tuple(r) for r in got) == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_top_k_of_large_components_is_exact():
    q, c = np.array([[1e12, 3.0]]), np.array([[1e12, 1.0], [-1e12, 2.0], [1e-3, 5.0]])
    whole = [[int(y) for y in np.floor(1024 * x)] for x in (q[0], *c)]
    want = [min(max(sum(a * b for a, b in zip(whole[0], x)), -2 ** 63), 2 ** 63 - 1) for x in whole[1:]]
    assert topk._scores(q, c, 1024.0)[0].tolist() == want


def test_top_k_moves_little(spark):
    """Bytes in shuffle files: queries met every shuffle partition as float64 before, which filled the disk at 6 GB."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {str(f): f.stat().st_size for d in dirs for f in Path(d).rglob("shuffle_*.data")}
    confs = {"spark.sql.shuffle.partitions": "300", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {c: spark.conf.get(c) for c in confs}
    whole, before = np.floor(1024 * x.astype("float32")).astype(int), files()
    try:
        for c, value in confs.items():
            spark.conf.set(c, value)
        got = topk.top_k(df, F.col("vec_id") % 100 == 0).collect()
    finally:
        for c, value in old.items():
            spark.conf.set(c, value)
    moved = sum(n for f, n in files().items() if f not in before)
    assert moved < 4 * x.size * 4
    want = [(q, k + 1, i, s) for q in range(0, len(x), 100) for k, (s, i) in enumerate(
        sorted(((s, i) for i, s in enumerate((whole @ whole[q]).tolist()) if i != q), key=lambda x: (-x[0], x[1]))[:10])]
    assert sorted(tuple(r) for r in got) == want


@pytest.mark.parametrize("k, tile, high, dtype", [(3, 64, 3, "f4"), (10, 100, 1, "f4"), (5, 2048, 40, "f8"), (40, 33, 2, "f8"),
                                                  (3, 50, 1 << 31, "f8"), (1, 1, 3, "f4")])
def test_cell_keeps_the_best(k, tile, high, dtype, monkeypatch):
    """Ties, repeated ids, rows of a query's own id; many merges."""
    monkeypatch.setattr(topk, "MERGE_ROWS", 50)
    rng = np.random.default_rng(k)
    q_ids = rng.permutation(600)[:300].astype(np.int64) - 100
    q = rng.integers(-high, high + 1, (300, 4)).astype(dtype)
    ids = rng.integers(-100, 500, 900).astype(np.int64)
    c = rng.integers(-high, high + 1, (900, 4)).astype(dtype)
    ids[:40], c[:40] = q_ids[0], q[0]
    cell, at = topk.Cell(k, tile), 0
    cell.add(0, q_ids[:200], q[:200])
    cell.add(0, q_ids[200:], q[200:])
    while at < 900:
        n = int(rng.integers(1, 60))
        cell.add(1, ids[at: at + n], c[at: at + n])
        at += n
    rows = [np.frombuffer(x, "<i8").reshape(-1, 3) for b in cell.found(7) for x in b.column("lists").to_pylist()]
    got = sorted(tuple(r) for r in topk.merged(np.concatenate(rows), k).tolist())
    want = []
    for i, x in zip(q_ids.tolist(), q.astype(int).tolist()):
        scores = [(min(max(sum(a * b for a, b in zip(x, y)), -2 ** 63), 2 ** 63 - 1), j)
                  for y, j in zip(c.astype(int).tolist(), ids.tolist()) if j != i]
        want += [(i, j, s) for s, j in sorted(scores, key=lambda z: (-z[0], z[1]))[:k]]
    assert got == sorted(want)


def test_top_k_of_mixed_widths(spark):
    """Vectors whose components fit in 16 bits and others, of several lengths, in one table."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=3 + i % 2) * (1e5 if i % 5 == 0 else 1.0)]) for i in range(300)]
    rows += rows[40:60]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = [(i, [int(np.floor(1024 * y)) for y in v]) for i, v in rows]
    want = []
    for q, x in dict(whole).items():
        if q % 10 < 2:
            found = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in whole if i != q and len(y) == len(x))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found[:10])]
    for tile in (2048, 5):
        assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 10 < 2, tile=tile).collect()) == sorted(want)


def test_grid_moves_few_times_the_vectors():
    for n in (10_000, 15_000_000, 80_000_000):
        for tasks in (12, 200, 600, 3000):
            down, across = topk.grid(n, n // 100, n // 100 * 128, 10, tasks, 6)
            moved = across * n * 128 + down * (n // 100) * (128 + 240)
            assert 6 <= down * across and moved < 8 * n * 128  # of the packed vectors, which are half of the floats
    assert topk.grid(0, 0, 0, 10, 12, 4)[0] >= 1
    down, across = topk.grid(10 ** 6, 10 ** 6, 128 * 10 ** 6, 10, 200, 6)
    assert down * across >= 6 and (2 * 128 + 480) * 10 ** 6 / across <= topk.HELD_BYTES


def test_pipeline_matches_brute_force(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import public_tokenizers
    import sentencepiece

    rows = [(i, t, "en", s, len(t or "")) for i, s, t in corpus()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = [(i, s, t) for i, s, t in corpus() if any(x.isalpha() for x in t or "")]
    heads = brute.near_classes([(i, t) for i, _, t in kept])
    kept = [r for r in kept if heads[r[0]] == r[0]]
    left = brute.repeats([t for _, _, t in kept])
    kept = [(i, s, x[3].decode("utf-8", "ignore")) for (i, s, _), x in zip(kept, left)]
    copies = brute.mixed(kept)
    lib = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    want = sorted((i, lib.encode(t, add_eos=True)) for i, _, t in kept for _ in range(copies[i]))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], list(r["ids"])) for r in got) == want
    stages = [name for name, _ in corpus_pipeline.STAGES]
    assert stages == ["language", "near_dedup", "suffix_dedup", "mixing", "encode"]
    first = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert first.columns == docs.columns


def edited(rng, own, share, spread):
    """``own`` with a share of its words replaced, at random or evenly."""
    own, n = list(own), int(len(own) * share)
    for i in rng.sample(range(len(own)), n) if spread == "random" else [k * len(own) // n for k in range(n)]:
        own[i] = f"e{rng.randrange(10 ** 9)}"
    return own


def test_pairs_near_the_limit_agree_in_a_sketch():
    rng = random.Random(12)
    for share, spread, least in ((0.1, "random", 200), (0.15, "random", 200), (0.2, "random", 198), (0.15, "even", 198),
                                 (0.2, "even", 190)):
        found = 0
        for _ in range(200):
            a = words(rng, 200)
            data = [" ".join(x).encode() for x in (a, edited(rng, a, share, spread))]
            h, offsets = near_dup.word_hashes(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
            assert near_dup.similar(h[:offsets[1]], h[offsets[1]:])
            x, y = near_dup.all_sketches(h, offsets)
            found += bool((x == y).any())
        assert found >= least, (share, spread, found)


def all_pairs_classes(rows):
    """{id: smallest id of its class} by aligning every pair of texts, whatever words they share."""
    number, parent = {}, {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    hashed = [(i, np.array([number.setdefault(w, len(number)) for w in t.split()], np.uint32)) for i, t in rows]
    for x, (i, a) in enumerate(hashed):
        for j, b in hashed[:x]:
            if near_dup.similar(a, b):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return {i: find(i) for i, _ in rows}


def test_pairs_near_the_limit_match_alignment_of_all_pairs(spark):
    rng = random.Random(13)
    rows = []
    for share in (0.1, 0.15, 0.2):
        for spread in ("random", "random", "even"):
            for _ in range(8):
                own = words(rng, 150)
                rows += [" ".join(own), " ".join(edited(rng, own, share, spread))]
    rows = list(enumerate(rows))
    got = {r["doc_id"]: r["class_id"] for r in
           near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == all_pairs_classes(rows)


def test_links_past_the_smallest_id_are_found(spark):
    rng = random.Random(14)
    # b is like a and like c, but a isn't like c
    rows = []
    for _ in range(3):
        a = words(rng, 200)
        b = [f"b{k}" for k in range(30)] + a[30:]
        c = b[:170] + [f"c{k}" for k in range(30)]
        rows += [" ".join(x) for x in (a, b, c)]
    # texts of one template, whose smallest id is like none of them, in pairs alike in their own part
    template = words(rng, 140)
    for _ in range(40):
        own = words(rng, 60)
        rows += [" ".join(template + x) for x in (own, edited(rng, own, 0.15, "random"))]
    rows = list(enumerate(rows))
    got = {r["doc_id"]: r["class_id"] for r in
           near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == all_pairs_classes(rows)


def test_boilerplate_texts_end_in_one_pass_with_all_links(spark):
    rng = random.Random(15)
    template = words(rng, 140)
    rows = []
    for _ in range(300):  # pairs alike in their own part, in buckets of all texts of the template
        own = words(rng, 60)
        rows += [" ".join(template + x) for x in (own, edited(rng, own, 0.6, "random"))]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs).collect()}
    assert got == {i: i - i % 2 for i in range(600)}


def test_rows_of_one_class_and_a_few_others_in_a_bucket(spark):
    rng = random.Random(16)
    base = words(rng, 150)
    rows = [" ".join(edited(rng, base, 0.02, "random")) for _ in range(200)]
    # each of these is like one of the others only, and like no text of the class
    far = edited(rng, base, 0.35, "even")
    rows += [" ".join(edited(rng, far, 0.05, "random")) for _ in range(50)]
    rows += [" ".join(reversed(base)), " ".join(sorted(base))]
    rows = list(enumerate(rows))
    got = {r["doc_id"]: r["class_id"] for r in
           near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), small=4, large=6).collect()}
    assert got == all_pairs_classes(rows)


def test_texts_of_one_template_are_not_all_compared(spark, monkeypatch):
    rng = random.Random(17)
    template = [f"t{k}" for k in range(45)]
    rows = []
    for i in range(60):
        own, shared = [f"o{i}-{k}" for k in range(15)], template[:: 1 if i % 2 else -1]
        rows += [" ".join(own + shared), " ".join(own[:-2] + [f"x{i}", f"y{i}"] + shared)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    compared, checked = [], near_dup._checked

    def counted(pairs, words, fifth):
        compared.append(pairs.count())
        return checked(pairs, words, fifth)

    monkeypatch.setattr(near_dup, "_checked", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs, small=4, large=80).collect()}
    assert got == all_pairs_classes(rows)
    # the words of the template are among those beyond the first fifth and one: their lists are left out
    assert compared[1] <= 2 * len(rows)


def test_a_pair_of_many_common_words_is_made_once_in_the_lists(spark):
    # texts 1 and 2 share words 0 .. 29, texts 1 and 3 only 0, 2, 4, ... 18
    shares = {1: range(30), 2: range(30), 3: range(0, 20, 2), 4: range(100, 130)}
    rows = [(e, i, 60, i, p, 4, list(ws)[:p]) for i, ws in shares.items() for p, e in enumerate(ws)]
    schema = "key long, id long, n_words long, class long, p long, main long, before array<long>"
    met = []
    for key in range(30):  # each list by itself
        some = spark.createDataFrame([r for r in rows if r[0] == key], schema)
        if key in (0, 5, 9, 12, 13, 18, 29):
            met += [(key, r["a"], r["b"]) for r in near_dup._across(some, 5, 13).collect()]
    assert met == [(12, 1, 2)]
    got = near_dup._across(spark.createDataFrame(rows, schema), 5, 5).collect()
    assert sorted((r["a"], r["b"]) for r in got) == [(1, 2), (1, 3), (2, 3)]


def test_near_duplicates_keep_columns_of_any_name(spark):
    rows = [(i, t) for i, _, t in corpus(30)] + [(None, "no id"), (3, "other text of the same id " * 9), (2, corpus(30)[2][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = ["w", "h", "known", "id", "sha", "key", "star", "class", "class_id", "t_id", "t_sha", "row", "row_id", "row_sha",
             "words", "a", "b", "node", "root", "n", "p", "rare"]
    wide = docs.select("doc_id", *[F.lit(c).alias(c) for c in names], "text")
    want = near_dup.near_duplicates(docs).collect()
    assert sorted(map(str, near_dup.near_duplicates(wide).collect())) == sorted(map(str, want))
    kept = near_dup.without_duplicates(wide)
    assert kept.columns == wide.columns
    kept = kept.collect()
    assert all(r[c] == c for r in kept for c in names)
    heads = {r["class_id"] for r in want if r["doc_id"] is not None}
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(heads)
    assert [r["text"] for r in kept if r["doc_id"] is None] == ["no id"]


def test_rare_words_of_similar_rows_always_meet():
    rng = random.Random(17)
    for _ in range(300):
        a = [rng.randrange(40) for _ in range(rng.randint(1, 60))]
        b = list(a)
        for _ in range(rng.randrange(12)):
            k = rng.randrange(len(b) + 1)
            b[k:k + rng.randrange(2)] = [rng.randrange(40)] * rng.randrange(2)
        a, b = (np.array(x, np.uint32) << np.uint32(20) for x in (a, b))
        if len(b) and near_dup.similar(a, b):
            counts = np.bincount(np.concatenate([a, b]) >> np.uint32(32 - near_dup.COUNTS), minlength=1 << near_dup.COUNTS)
            common = sum((Counter(a.tolist()) & Counter(b.tolist())).values())
            for depth in range(3):
                x, y = (set(near_dup.rare_words(h, counts, len(h) // 5 + 1 + depth)[1].tolist()) for h in (a, b))
                assert len(x & y) >= min(1 + depth, common)
