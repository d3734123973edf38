"""Operators that judge or rewrite one text at a time."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from contactlake.llm import html_text, language, piece_codec, quality, token_count, url_filter
from contactlake.llm.pieces import Vocabulary

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))
ODD = [None, "", " ", "  hi  there ", "\n\n", "a\n b", "<s>x</s>", "<0x41>", "ｆｕｌｌ ▁x", "日本語 😀 é", "a" * 5000,
       " " * 37 + "x" + " " * 50, "The and ation. " * 3000, "a\u0000b"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def sample_texts(spark, n=40):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(n).collect()
    return [r["text"] for r in rows]


# -- token counts and codec ---------------------------------------------------------------

def test_counts_match_the_library_at_every_prefix(spark, library):
    prefixes = token_count.Prefixes(Vocabulary(PATH))
    for text in [x or "" for x in ODD] + sample_texts(spark, 10):
        text = text[:3000]
        table = token_count.PrefixCounts(text, prefixes)
        assert len(table.counts) == len(text) + 1
        random.seed(len(text))
        for n in {0, len(text), *random.sample(range(len(text) + 1), min(25, len(text)))}:
            assert table.count(n) == len(library.encode(text[:n])), (text[:40], n)
        budget = table.count(len(text)) // 2
        assert table.count(table.fit(budget)) <= budget


def test_count_tokens_rows(spark, library):
    texts = ODD + sample_texts(spark) + ODD[:3]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r["doc_id"]: r for r in token_count.count_tokens(rows, PATH).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or ""))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 4096)
    assert token_count.count_tokens(rows.limit(0), PATH).collect() == []


def test_codec_matches_the_library(spark, library):
    texts = ODD + sample_texts(spark) + ODD[:3]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    hexed = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r["doc_id"]: r for r in piece_codec.encode_digests(rows, PATH).collect()}
    whole = {r["doc_id"]: r for r in piece_codec.encode(rows, PATH).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_eos=True)
        assert whole[i]["ids"] == ids and whole[i]["decoded"] == library.decode(ids)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hexed(" ".join(map(str, ids)))
        assert got[i]["decoded_sha256"] == hexed(library.decode(ids))
    assert piece_codec.encode(rows.limit(0), PATH).collect() == []


def test_codec_reports_a_difference(monkeypatch):
    codec = piece_codec.Codec(Vocabulary(PATH))
    monkeypatch.setattr(codec.vocab, "encode", lambda segments: [[5] for _ in segments])
    with pytest.raises(ValueError, match="by the library"):
        codec.encoded(["some words"])


# -- language -----------------------------------------------------------------------------

def slow_length(text, counts, order=3):
    """Code length of a text by method C with exclusion, one byte after another."""
    data, bits = bytes(order) + text.encode(), 0.0
    for at in range(order, len(data)):
        banned = set()
        for n in range(order, -1, -1):
            here = {b: c for b, c in counts[n].get(data[at - n:at], {}).items() if b not in banned}
            if not here:
                continue
            total, kinds = sum(here.values()), len(here)
            if data[at] in here:
                bits -= math.log2(here[data[at]] / (total + kinds))
                break
            bits -= math.log2(kinds / (total + kinds))
            banned |= set(here)
        else:
            bits += math.log2(256 - len(banned))
    return bits


def test_code_lengths_match_a_slow_coder(spark):
    docs = {"en": ["the ant and the hen then", "an ant"], "de": ["der die das und", "die äpfel", "und"]}
    rows = spark.createDataFrame([(i, t, k) for k, ts in docs.items() for i, t in enumerate(ts)],
                                 "doc_id long, text string, lang string")
    tables = language.Tables(language.train(rows))
    data = [t.encode() for t in ["then an äpfel", "", "zz", "the"]]
    offsets = np.append(0, np.cumsum([len(x) for x in data]))
    got = tables.lengths(np.frombuffer(b"".join(data), np.uint8), offsets)
    for k, lang in enumerate(tables.langs):
        counts = [defaultdict(Counter) for _ in range(4)]
        for t in docs[lang]:
            raw = bytes(3) + t.encode()
            for at in range(3, len(raw)):
                for n in range(4):
                    counts[n][raw[at - n:at]][raw[at]] += 1
        for i, t in enumerate(data):
            assert got[i, k] == pytest.approx(slow_length(t.decode(), counts), abs=0.03)


def test_language_is_right_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).where(language.held_out(F.col("doc_id"))).select("text", "lang", "lang_pred").collect()
    known = [r for r in got if r["lang_pred"] != "und" and len(r["text"]) > 20]
    assert len(known) > 150
    assert sum(r["lang"] == r["lang_pred"] for r in known) >= 0.97 * len(known)


def test_language_of_odd_rows(spark):
    rows = spark.createDataFrame(
        [(0, "the ant and the hen", "en"), (1, None, "en"), (2, "123 !!", None), (3, "", "en"), (3, "", "en"),
         (None, "ant", None)], "doc_id long, text string, score string").withColumnRenamed("score", "lang")
    got = language.identify(rows.withColumn("score", F.lit("mine"))).collect()
    assert sorted((str(r["doc_id"]), r["lang_pred"]) for r in got if r["text"] in (None, "", "123 !!")) == [
        ("1", "und"), ("2", "und"), ("3", "und"), ("3", "und")]
    assert all(0 <= r["score"] <= 1 for r in got)
    untaught = language.identify(rows.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in untaught} == {"und"}
    assert language.identify(rows.limit(0)).collect() == []


# -- HTML ---------------------------------------------------------------------------------

def test_main_text_of_marked_and_plain_pages():
    page = ("<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href=/x>Menu</a></ul></nav>"
            "<div class=ad>Buy</div><article><h1>Head</h1><p><b>One&amp;two</b>three <br>four"
            "<p>Five   six.</p><div class='share-box'>Share</div><form><p>Mail</p></form></article>"
            "<div id=comments><p>Nice post</p></div><footer>&copy; x")
    weights = html_text.weights_of(html_text.observe(page) + html_text.observe(page))
    want = "Head One&twothree four Five six."
    assert html_text.main_text(page, weights) == want
    assert html_text.main_text(page, {}) == want  # fixed weights
    for broken in ["", "<", "<p", "<!--", "<p>x", "a < b"]:
        html_text.main_text(broken, weights)
    assert html_text.main_text("<p>x", weights) == "x"
    assert html_text.main_text(None, weights) == ""


def test_long_parts_left_out_do_not_cut_the_article():
    long = "<p>" + "other words " * 200 + "</p>"
    page = ("<html><body><nav><a href=/x>Menu</a></nav><article><h1>Head</h1><p>A short lead.</p><aside>" + long + "</aside><p>"
            + "The middle. " * 20 + "</p><div class=newsletter>" + long + "</div><p>A short ending.</p></article><footer>x</footer>")
    want = "Head A short lead. " + "The middle. " * 20 + "A short ending."
    assert html_text.main_text(page, {}) == want
    assert html_text.main_text(page, html_text.weights_of(html_text.observe(page))) == want


def _generated_page(rng, rich):
    """A page with an article of known text, among menus, notices and adverts."""
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta omega sigma kappa".split()) for _ in range(n))
    parts, want = [], []

    def block(shape, *texts):
        parts.append(shape.format(*texts))
        want.extend(texts)

    block("<header class='article-header'><h1>{}</h1><p class=lead>{}</p></header>" if rich else "<h1>{}</h1><p>{}</p>",
          words(6), words(20))
    block("<p>{}</p>", words(120))
    for _ in range(rng.randrange(2, 6)):
        kind = rng.randrange(6) if rich else 5
        if kind == 0:
            block("<ul><li>{}</li>\n<li>{}<li>{}</ul>", words(3), words(9), words(2))
        elif kind == 1:
            block("<table><thead><tr><th>{}<th>{}</tr></thead><tr><td>{}</td><td>{}</td></tr></table>",
                  words(1), words(2), words(1), words(4))
        elif kind == 2:
            block("<figure><img src=x><figcaption>{}</figcaption></figure>", words(7))
        elif kind == 3:
            block("<blockquote><p>{}</p></blockquote><dl><dt>{}<dd>{}</dl>", words(15), words(1), words(5))
        elif kind == 4:
            parts.append("<div class='share-box'><a href=/s>Share this</a></div><aside>See also</aside>")
        else:
            block("<p>{}</p>", words(rng.randrange(5, 50)))
    block("<div class='entry-footer'>{}</div>" if rich else "<p>{}</p>", words(12))
    menu = "".join(f"<li><a href=/m{k}>Menu entry {k}</a></li>" for k in range(rng.randrange(2, 9)))
    return (f"<html><head><title>t</title></head><body><header><a href=/>Site</a></header><ul>{menu}</ul><div class=ad>Buy now</div>"
            f"<article>{''.join(parts)}</article><ul>{menu}</ul><div id=comments><p>{words(40)}</p></div>"
            f"<footer>&copy; all</footer></body></html>", " ".join(want))


def test_whole_article_of_generated_pages():
    rng = random.Random(8)
    learned = sum((html_text.observe(_generated_page(rng, False)[0]) for _ in range(50)), Counter())
    weights = html_text.weights_of(learned)  # from pages that have lists in menus only
    for rich in (False, True):
        for _ in range(100):
            page, want = _generated_page(rng, rich)
            assert html_text.main_text(page, weights) == want


def test_scan_finds_the_best_region():
    random.seed(3)
    for _ in range(200):
        rows = [("p" if random.random() < 0.5 else "li+a", "w " * random.randint(1, 4), False, False) if random.random() < 0.6
                else (None, "div", False, False) for _ in range(12)]
        weights = {"p": 1.0, "li+a": -1.0, "<div": -0.5}
        value = lambda r: -0.5 if r[0] is None else weights[r[0]] * len(r[1].split())
        best = max([0.0] + [sum(map(value, rows[a:b])) for a in range(12) for b in range(a + 1, 13)])
        a, b = html_text.region(rows, weights)
        assert sum(map(value, rows[a:b])) == pytest.approx(best)


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "v", "<article><p>a b</article>"),
                                   (3, "v", "<article><p>a b</article>"), (4, "w", "<article><p>" + "x " * 200_000)],
                                  "page_id long, url string, html string").withColumn("text", F.lit("mine"))
    got = sorted((r["page_id"], r["n_chars"]) for r in html_text.extract(pages).collect())
    assert got == [(1, 0), (2, 0), (3, 3), (3, 3), (4, 399_999)]
    assert html_text.extract(pages.limit(0)).collect() == []


# -- URL filter ---------------------------------------------------------------------------

def test_hosts_paths_and_rules(spark):
    cases = [
        ("http://A.Example.org/es/1?q#f", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("https://x.example.org/en/12", "x.example.org", "/en/12", "example.org/en/1", "block"),
        ("https://x.example.org/en/2", "x.example.org", "/en/2", "org/", "allow"),
        ("http://shop.com/fr/a", "shop.com", "/fr/a", "com/fr/", "allow"),
        ("http://shop.com/de/a", "shop.com", "/de/a", "com/de/", "block"),
        ("http://notorg/x", "notorg", "/x", None, "allow"),
        ("http://b.net?x=://c/d", "b.net", "", None, "allow"),
        ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow")]
    pages = spark.createDataFrame([(i, c[0], None, "x") for i, c in enumerate(cases)],
                                  "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), cases[i]
        if rule:
            assert got[i]["verdict"] == verdict
    assert url_filter.judge(pages.limit(0)).collect() == []


def test_scores_match_power_iteration(spark):
    links = [("good.org", "a.net", 3), ("a.net", "b.net", 1), ("b.net", "bad.com", 2), ("c.net", "bad.com", 5),
             ("c.net", "a.net", 1), ("bad.com", "c.net", 1)]
    edges = spark.createDataFrame(links, "src string, dst string, n long")
    seeds = spark.createDataFrame([("good.org", 1.0, 0.0), ("bad.com", 0.0, 1.0), ("a.net", 0.0, 0.0),
                                   ("lone.net", 0.0, 0.0)], "host string, good double, bad double")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in url_filter.host_scores(edges, seeds, rounds=6).collect()}
    hosts = sorted(got)
    for k, (seed, way) in enumerate([("good.org", lambda s, d: (s, d)), ("bad.com", lambda s, d: (d, s))]):
        start = np.array([h == seed for h in hosts], float)
        step = np.zeros((len(hosts), len(hosts)))
        for s, d, n in links:
            a, b = way(s, d)
            step[hosts.index(b), hosts.index(a)] += n
        step = step / np.maximum(step.sum(0), 1e-300)
        x = start
        for _ in range(6):
            flow = 0.85 * step @ x
            x = flow + (1 - flow.sum()) * start
        assert [got[h][k] for h in hosts] == pytest.approx(list(x * len(hosts)))


def test_scores_flow_along_a_long_chain(spark):
    n = 30
    edges = spark.createDataFrame([(f"h{k:02}", f"h{k + 1:02}", 1) for k in range(n - 1)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("h00", 1.0, 0.0), (f"h{n - 1}", 0.0, 1.0)], "host string, good double, bad double")
    got = {r["host"]: r for r in url_filter.host_scores(edges, seeds, tolerance=1e-4).collect()}
    share = 0.85 ** np.arange(n) * 0.15 / (1 - 0.85 ** n)  # what the last host holds returns to the seed
    assert [got[f"h{k:02}"]["trust"] for k in range(n)] == pytest.approx(list(share * n), abs=0.03)
    assert [got[f"h{n - 1 - k:02}"]["distrust"] for k in range(n)] == pytest.approx(list(share * n), abs=0.03)


def test_links_are_those_of_anchors_only(spark):
    page = ("<link href='http://a.net/x'><!-- <a href=http://b.net/>x</a> --><script>s='<a href=\"http://c.net/\">'</script>"
            "<a class=x href='//D.net/1'>y</a><A HREF=https://e.net>z</A><area href=\"http://e.net/2\"><a data-href=http://f.net/>")
    rows = spark.createDataFrame([("http://me.net/", page), (None, page), ("http://me.net/2", None)], "url string, html string")
    assert {(r["src"], r["dst"], r["n"]) for r in url_filter.host_edges(rows).collect()} == {
        ("me.net", "d.net", 1), ("me.net", "e.net", 2)}


def test_a_host_that_links_to_blocked_hosts_is_blocked(spark):
    rows = [(1, "http://bad.com/de/1", None)]
    rows += [(k, f"http://feeder.net/p{k}", "<a href='http://bad.com/de/1'>x</a>") for k in range(2, 5)]
    rows += [(k, f"http://fine{k}.net/x", "<a href=/local>x</a>") for k in range(5, 30)]
    got = {r["page_id"]: r["verdict"] for r in
           url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "block" and {got[k] for k in range(2, 5)} == {"block"} and {got[k] for k in range(5, 30)} == {"allow"}


# -- quality ------------------------------------------------------------------------------

def test_counts_of_a_text():
    assert quality.counts("") == (0, 0, 0, 0, 0)
    assert quality.counts("a b\na b\n\n \na b") == (6, 6, 0, 2, 6)
    assert quality.counts("x y z q x y z") == (7, 7, 0, 0, 6)
    assert quality.counts("# a|b c $") == (3, 7, 3, 0, 0)


def slow_fit(x):
    """The estimate of one group in plain arrays."""
    floor, p = np.array(quality.FLOOR), quality.P
    cells = np.floor(x / (floor / 8))
    middle, spread = np.empty(p), np.empty(p)
    for i in range(p):
        own = np.sort(cells[:, i])
        at = [own[math.ceil(q * len(own)) - 1] for q in (0.25, 0.5, 0.75)]
        middle[i], spread[i] = (at[1] + 0.5) * floor[i] / 8, max((at[2] - at[0]) * floor[i] / 8 / 1.349, floor[i])

    def estimate(rows, factor):
        c = np.cov(rows.T, bias=True) * factor
        c += np.diag(np.maximum(floor ** 2 - np.diag(c), 0) + floor ** 2 * 1e-6)
        return rows.mean(0), np.linalg.inv(c)

    d2 = lambda m, inv: np.einsum("ij,jk,ik->i", x - m, inv, x - m)
    fit = middle, np.diag(1 / spread ** 2)
    for _ in range(quality.STEPS):
        cell = np.maximum(-200, np.floor(np.log2(np.maximum(d2(*fit), 1e-9)) * 16))
        fit = estimate(x[cell <= np.sort(cell)[math.ceil(quality.HALF * len(x)) - 1]], quality._FACTOR_HALF)
    return d2(*estimate(x[d2(*fit) <= quality._Q975], quality._FACTOR_975))


def test_distances_match_plain_arrays_and_reject_outliers(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(200):
        words = [f"w{rng.integers(400)}" for _ in range(int(rng.integers(80, 300)))]
        rows.append((i, " ".join(words), "en", "s"))
    rows += [(200 + i, " ".join(f"w{k}$$$" for k in range(120)), "en", "s") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    counts = np.array([quality.counts(t) for _, t, _, _ in rows], float)
    n = counts[:, 0]
    x = np.column_stack([np.log(n), counts[:, 1] / n, counts[:, 2] / n, np.log1p(counts[:, 3]) / math.log(1000), counts[:, 4] / n])
    assert [got[i]["distance"] for i in range(220)] == pytest.approx(list(slow_fit(x)), rel=1e-6)
    assert all(got[i]["kept"] for i in range(200)) and not any(got[200 + i]["kept"] for i in range(20))


def test_quality_of_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = spark.createDataFrame([(1, None, None, None), (2, "", "en", None), (3, long, None, "s"), (3, long, None, "s"),
                                  (4, "a b c " * 60, "en", "s"), (None, long, "en", "s")],
                                 "doc_id long, text string, lang string, source string").withColumn("kept", F.lit("mine"))
    got = sorted((str(r["doc_id"]), r["n_words"], r["base_failed"], r["kept"]) for r in quality.quality(rows).collect())
    assert got == [("1", 0, True, False), ("2", 0, True, False), ("3", 60, False, True), ("3", 60, False, True),
                   ("4", 180, True, False), ("None", 60, False, True)]
    assert quality.quality(rows.limit(0)).collect() == []


def test_copies_of_a_third_of_a_group_are_outliers(spark):
    rng = np.random.default_rng(7)
    rows = []
    junk = [" ".join(f"w{k}$$$" for k in range(60)), " ".join(f"word{k}#" for k in range(60)),
            "\n".join(["five words are a line"] * 2 + [f"l{k} a{k} b{k}" + " |" * 12 for k in range(20)])]
    for g, (share, bad) in enumerate([(0.3, 0), (0.35, 0), (0.4, 0), (0.4, 1), (0.38, 2), (0.45, 0)]):
        n_bad = int(200 * share)
        for i in range(200):
            text = junk[bad] if i < n_bad else " ".join(
                f"w{rng.integers(400)}" for _ in range(int(np.exp(rng.normal(5.5, 0.5))) + 50))
            rows.append((1000 * g + i, text, "en", f"s{g}", i >= n_bad))
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in quality.quality(docs).collect()}
    assert not [i for i, _, _, _, good in rows if not good and got[i]]
    assert sum(not got[i] for i, _, _, _, good in rows if good) <= 5


def test_outliers_of_a_few_deviations_are_rejected(spark):
    rng = np.random.default_rng(11)
    some = lambda n: [f"w{k}" for k in rng.integers(100_000, size=n)]
    rows = [" ".join(some(int(np.exp(rng.normal(5.5, 0.4))) + 50)) for _ in range(400)]
    passage = some(10)
    rows += [" ".join(some(200) + ["|"] * 40) for _ in range(8)]  # a sixth are symbols
    rows += [" ".join(some(120) + passage * 8) for _ in range(8)]  # two fifths are repeated
    rows += ["\n".join([" ".join(some(20)) for _ in range(12)] + ["and more"] * 2 + [f"see {k}" for k in range(12)] * 2)
             for _ in range(8)]  # thirteen repeated lines
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert not [i for i in range(400, 424) if got[i]["kept"]]
    assert sum(not got[i]["kept"] for i in range(400)) <= 4
