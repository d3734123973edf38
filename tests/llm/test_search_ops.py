"""Phrase index, fill-in-the-middle and ranked lexical search against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contactlake.llm import fill_middle, lexical, phrase_index

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return [w.translate(LOWER) for w in WORD.findall(text or "")]


def corpus(seed=5, n=60):
    """Documents of few different words with items planted in them, and odd ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(25)] + ["É", "straße", "x9"]
    items = [" ".join(rng.choice(vocabulary) for _ in range(m)) for m in (25, 14, 10, 10, 6, 3, 1)]
    items += [items[1].upper(), "nowhere to be found in any of the documents at all", "", None, "!?", items[2] + " tail", "w1 w1 w1"]
    items = [(k, t) for k, t in enumerate(items)] + [(0, items[0]), (1, items[3]), (None, items[4])]
    docs = []
    for k in range(n):
        own = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 80))]
        if k % 3 == 0:
            item = words(items[rng.randrange(8)][1])
            a = rng.randrange(len(item))
            at = rng.randrange(len(own) + 1)
            own[at:at] = item[a // 2:] if k % 2 else item
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(own)))
    docs += [(100, None), (101, ""), (102, "?! ."), (103, "W1"), (104, docs[3][1]), (3, docs[3][1]), (3, "other " + items[2][1]),
             (None, docs[6][1]), (105, "w1 " * 3000), (106, (items[1][1] + " ") * 40), (107, "\x00w1\x7fw1_w1")]
    return docs, items


def frame(spark, rows, kind):
    df = spark.createDataFrame(rows, kind).repartition(3)
    for clash in ("h", "doc", "word", "words", "pos", "item", "id", "query", "score", "rank", "n", "shard", "ids", "output"):
        df = df.withColumn(clash, F.lit("mine"))
    return df


def tables(spark, docs, items):
    return frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string")


def contaminated(docs, items, window=10):
    windows = {}
    for i, t in items:
        own = words(t)
        m = min(len(own), window)
        for s in range(len(own) - m + 1 if m else 0):
            windows.setdefault(tuple(own[s:s + m]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        own, hit, ids = words(t), set(), set()
        for m in {len(x) for x in windows}:
            for p in range(len(own) - m + 1):
                found = windows.get(tuple(own[p:p + m]))
                if found:
                    hit |= set(range(p, p + m))
                    ids |= found
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((d, len(own), len(hit), len(ids), digest, bool(hit)))
    return sorted(out, key=str)


def test_contamination_matches_brute_force(spark):
    docs, items = corpus()
    d, b = tables(spark, docs, items)
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    for most in (old, "-1"):
        spark.conf.set(key, most)
        try:
            got = phrase_index.decontaminate(d, b)
            assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
            got = sorted((tuple(r) for r in got.collect()), key=str)
        finally:
            spark.conf.set(key, old)
        assert got == contaminated(docs, items)
    assert sum(x[-1] for x in got) > 20


def test_contamination_of_empty_tables_and_string_ids(spark):
    docs, items = corpus(n=9)
    d, b = tables(spark, docs, items)
    assert phrase_index.decontaminate(d.limit(0), b).collect() == []
    got = phrase_index.decontaminate(d.withColumn("doc_id", F.col("doc_id").cast("string")), b.limit(0)).collect()
    assert len(got) == len(docs) and not any(r["contaminated"] for r in got)
    assert {r["items_sha256"] for r in got} == {hashlib.sha256(b"").hexdigest()}


def test_proximity_matches_brute_force(spark):
    docs, items = corpus()
    docs = [(k, t) for k, (_, t) in enumerate(docs)]
    d, b = tables(spark, docs, items)
    found = phrase_index.Items(b)
    postings = phrase_index.build_index(d, found.vocabulary)
    for within in (3, 6, 15):
        want = set()
        for t in {tuple(words(t)) for _, t in items if words(t)}:
            for i, text in docs:
                own = words(text)
                for first in range(len(own)):
                    met = {}
                    for p in range(first, min(first + within, len(own))):
                        if own[p] in t:
                            met.setdefault(own[p], p)
                    if own[first] in t and len(met) == len(set(t)):
                        want.add((t, i, first, max(met.values())))
        rows = found.words.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "word"))), lambda x: x["word"]).alias("t"))
        got = {(tuple(r["t"]), r["doc"], r["first"], r["last"]) for r in
               phrase_index.proximity_matches(postings, found, within).join(rows, "item").collect()}
        assert got == want and want


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def filled(i, t, seed=42):
    t = t or ""
    units = UNIT.findall(t)
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return i, len(units), "plain", None, None, t
    if h[3] % 100 < 80:
        return i, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_matches_brute_force(spark):
    rng = random.Random(3)
    odd = [None, "", " ", "\n\t ", "one", " one ", "<P> in it", "a<S", "S> b <M", "<M", "日本 語　x é", "x\x85y\x1f z\xa0", "\x00 ÿ"]
    texts = odd * 8 + ["".join(rng.choice("ab <>PSM\n\té日") for _ in range(rng.randrange(70))) for _ in range(300)]
    texts += [" word" * 300_000, "x" * 1_200_000]
    rows = list(enumerate(texts)) + [(None, "no id here"), (7, "again"), (7, "again")]
    got = fill_middle.restore(fill_middle.fill_in_middle(frame(spark, rows, "doc_id long, text string"))).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((filled(i, t) for i, t in rows), key=str)
    assert sorted(r["restored"] for r in got) == sorted(t or "" for _, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    empty = fill_middle.restore(fill_middle.fill_in_middle(frame(spark, [], "doc_id long, text string")))
    assert empty.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    assert empty.collect() == []


def test_fill_in_middle_does_not_depend_on_slices(monkeypatch, spark):
    rows = [(k, "some words of a text " * (k % 5)) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").coalesce(1)
    whole = fill_middle.fill_in_middle(docs, rate=100, spm=30).collect()
    monkeypatch.setattr(fill_middle, "SLICE", 60)
    assert fill_middle.fill_in_middle(docs, rate=100, spm=30).collect() == whole
    assert {r["form"] for r in whole} == {"plain", "psm", "spm"}


def scored(docs, items, k=10):
    own = [(i, Counter(words(t)), len(words(t))) for i, t in docs if words(t)]
    n_docs, n_words = len(own), sum(n for *_, n in own)
    df = Counter(w for _, c, _ in own for w in c)
    weight = {w: math.floor(1000 * math.log((2.0 * n_docs + 2) / (2 * df[w] + 1))) for w in df}
    out = []
    for q, t in {(q, t) for q, t in items}:
        found = []
        for i, c, n in own:
            m = 25 + 75 * n * n_docs // n_words
            s = sum(weight[w] * (10 ** 9 * c[w] // (1000 * c[w] + 8 * m)) for w in words(t) if w in c)
            if s > 0:
                found.append((-s, i is None, i))
        out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def test_ranked_search_matches_brute_force(spark):
    for seed, n in ((5, 60), (6, 400)):
        docs, items = corpus(seed, n)
        d, b = tables(spark, docs, items)
        for shard, block, step, short in ((1 << 24, 1024, 256, 32), (2000, 3, 7, 4)):
            got = lexical.search(lexical.build_index(d, shard=shard), b, block=block, step=step, short=short)
            assert got.columns == ["item_id", "rank", "doc_id", "score"]
            assert sorted((tuple(r) for r in got.collect()), key=str) == scored(docs, items)


def test_ranked_search_of_empty_tables(spark):
    docs, items = corpus(n=9)
    d, b = tables(spark, docs, items)
    assert lexical.search(lexical.build_index(d.limit(0)), b).collect() == []
    assert lexical.search(lexical.build_index(d.where("text IS NULL OR text = ''")), b).collect() == []
    assert lexical.search(lexical.build_index(d), b.limit(0)).collect() == []
    strings = d.withColumn("doc_id", F.col("doc_id").cast("string"))
    want = sorted((r["score"] for r in lexical.search(lexical.build_index(d), b).collect()))
    assert sorted(r["score"] for r in lexical.search(lexical.build_index(strings), b).collect()) == want


def test_skipping_in_a_shard_loses_nothing():
    rng = np.random.default_rng(8)
    for _ in range(60):
        n, table = int(rng.integers(1, 900)), {"word": [""], "w": [0], "docs": [b""], "tfs": []}
        sizes = rng.integers(1, 50, n)
        table["tfs"].append(sizes.astype("<i8").tobytes())
        terms = []
        for k in range(int(rng.integers(1, 9))):
            docs = np.flatnonzero(rng.random(n) < rng.choice([0.01, 0.1, 0.5, 0.95]))
            table["word"].append(f"t{k}")
            table["w"].append(int(rng.choice([0, 3, 400, 5000])))
            table["docs"].append(docs.astype("<i4").tobytes())
            table["tfs"].append(rng.integers(1, 4, len(docs)).astype("<i8").tobytes())
            terms.append((f"t{k}", int(rng.integers(1, 3))))
        lists = lexical.Lists(table, 1000, 25_000, 16)
        total = np.zeros(n, np.int64)
        for word, times in terms:
            total[lists.docs[word]] += lists.parts[word] * times
        order = [i for i in np.lexsort((np.arange(n), -total)) if total[i] > 0][:10]
        places, scores = lexical.ranked(lists, terms, 10, 8)
        assert places.tolist() == order and scores.tolist() == total[order].tolist()


def test_words_of_arrow_columns():
    texts = ["a b", None, "", "B", "C-d\x00E_f[g]", "Éa straße", "  ", "9z"]
    found, ends = lexical.words(pa.array(texts, pa.large_string()))
    found = found.to_pylist()
    assert [found[a:b] for a, b in zip(ends, ends[1:])] == [words(t) for t in texts]


def test_new_operators_are_registered():
    queries = pytest.importorskip("contactlake.llm.queries")
    for name in ("op11_decontaminate", "op12_fill_middle", "op13_lexical_search"):
        assert name in queries.QUERIES and name in queries.ORACLE_SQL
