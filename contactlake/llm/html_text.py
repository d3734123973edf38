"""Main text of web pages by the maximum-scoring subsequence.

A page is read as a row of words and tags. A word scores by the block it
stands in and by whether it is in a link, a tag scores below zero; one linear
scan finds the contiguous part with the highest sum, which is the content
region. A tag's weight also goes by whether its element holds a link, so that
lists and tables of an article don't score like menus. The weights are log odds learned from labelled pages: pages that mark
their article themselves, of which a bounded sample (about ``SAMPLE`` pages,
those with the smallest hashes of their id) is counted. Words of one text run
weigh the same, so the scan goes over runs and tags. What stands in the parts
that are left out below scores nothing.

Out of the region, what stands in elements that never belong to an article is
left out: menus, page headers and footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments, told by their tag or by the words of
their class, id or role (fixed lists below): a whole word, its first or its
last part; inside an article ``article-header`` and the like are its own parts,
so that the words in ``OWN`` count as whole words there. Text without a link in
a kind of block that the labelled pages don't show weighs like that of a
paragraph. Character references are decoded,
white space inside a block becomes one space, blocks are trimmed and joined in
page order by one space.

Defined cases: null or empty html and pages without words give an empty text;
broken markup (unclosed or cut-off tags) is read as far as it goes; pages of
any length are read whole; with no labelled page, fixed weights are used;
repeated rows give repeated results; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready

SAMPLE = 2000
# Element names of HTML, and words that name parts of a page.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "title")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("nav footer aside form button select dialog menu head script style noscript template svg iframe "
                    "textarea title".split())
NAMES = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary "
                  "contentinfo cookie cookies dialog disclaimer disqus footer header masthead menu modal nav navbar "
                  "navigation newsletter notice notices popup promo related respond share sharing sidebar skip social "
                  "sponsor sponsored subscribe toolbar widget".split())
OWN = frozenset("header footer masthead banner".split())
NEVER = frozenset(("html", "body", "main", "article"))
CONTENT = frozenset("caption col colgroup dd dl dt figcaption figure h4 h5 h6 hr li ol table tbody tfoot th thead tr ul".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                     "header hr main nav ol p pre section table ul".split())
SIBLINGS = frozenset("li dt dd tr td th option".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)""", re.S)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in RAW}
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PART = re.compile(r"[\s_-]+")
_DEFAULT = {"body": 0.3, "div": 0.3, "section": 0.3, "td": 0.3, "p": 1.0, "h1": 1.0, "h2": 1.0, "h3": 1.0, "blockquote": 1.0, "pre": 1.0, "article": 1.0, "main": 1.0}
_TAG_DEFAULT, _INSIDE_DEFAULT, _WORD_DEFAULT, _MOST = -0.5, -0.05, -1.0, 4.0


def _named_outside(name: str, attributes: str, article: bool) -> bool:
    if name in NEVER:
        return False
    for match in _ATTRIBUTE.finditer(attributes):
        for word in (match[1] or match[2] or match[3] or "").lower().split():
            parts = _PART.split(word)
            if word in NAMES or any(x in NAMES and not (article and x in OWN) for x in (parts[0], parts[-1])):
                return True
    return False


def parse(page: str) -> list[tuple]:
    """Rows of the page: (kind, value, outside, in an article).

    kind is None for a tag (value: its name, with a slash if it closes, with
    ``+a`` if its element holds a link), else the context of a text run (value:
    the run).
    """
    out, at = [], 0
    #: open elements: name, outside so far, in an article so far, nearest block, in a link, their row
    stack = [("", False, False, "body", False, -1)]
    opened: Counter = Counter()

    def close(n: int):
        for x in stack[n:]:
            opened[x[0]] -= 1
        del stack[n:]

    def text(run: str):
        _, outside, article, block, link, _ = stack[-1]
        if run:
            out.append((block + ("+a" if link else ""), run, outside, article))

    for match in iter(lambda: _TOKEN.search(page, at), None):
        text(page[at: match.start()])
        at = match.end()
        name = match[2]
        if name is None:
            if match[0].startswith("<![CDATA["):
                text(html.escape(match[0][9:].removesuffix("]]>"), quote=False))
            continue
        name = name.lower()
        if match[1]:
            if opened[name]:
                n = len(stack) - 1
                while stack[n][0] != name:
                    n -= 1
                _, tag, outside, _ = out[stack[n][5]]
                close(n)
            else:
                tag, outside = name, stack[-1][1]
            out.append((None, "/" + tag, outside, stack[-1][2]))
            continue
        if name in CLOSES_P and opened["p"]:
            n = len(stack) - 1
            while stack[n][0] in INLINE:
                n -= 1
            if stack[n][0] == "p":
                close(n)
        elif name in SIBLINGS and stack[-1][0] == name:
            close(len(stack) - 1)
        _, outside, article, block, link, _ = stack[-1]
        if name == "a":  # what is open and not marked yet is innermost
            for x in reversed(stack):
                if x[5] < 0 or out[x[5]][1].endswith("+a"):
                    break
                out[x[5]] = (None, x[0] + "+a", *out[x[5]][2:])
        outside = (outside or name in OUTSIDE or name == "header" and not article
                   or bool(match[3]) and _named_outside(name, match[3], article))
        out.append((None, name, outside, article))
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID and not match[3].endswith("/"):
            opened[name] += 1
            stack.append((name, outside, article or name == "article",
                          block if name in INLINE else name, link or name == "a", len(out) - 1))
    text(page[at:])
    return out


def observe(page: str) -> Counter:
    """Counts for the weights, of a page that marks its article: (context or tag, inside?) -> words or tags."""
    rows, seen = parse(page), Counter()
    if not any(kind is None and value == "article" for kind, value, _, _ in rows):
        return seen
    for kind, value, outside, article in rows:
        if kind is None:
            seen["<" + value, article] += 1
        elif n := len(value.split()):
            seen[("-" if outside else "") + kind, article and not outside] += n
    return seen


def weights_of(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds of each context (words) and tag; tags are always below zero."""
    out: dict[str, float] = {}
    for tags in (False, True):
        own = {k: v for k, v in counts.items() if k[0].startswith("<") == tags}
        inside, outside = (sum(v for k, v in own.items() if k[1] == side) for side in (True, False))
        for name in {k[0] for k in own}:
            a, b = own.get((name, True), 0) + 0.5, own.get((name, False), 0) + 0.5
            odds = math.log(a / (inside + 1)) - math.log(b / (outside + 1))
            out[name] = min(-0.05, odds / 4) if tags else max(-_MOST, min(_MOST, odds))
    return out


def region(rows: list[tuple], weights: dict[str, float]) -> tuple[int, int]:
    """First and one past the last row of the part with the highest sum; (0, 0) if no part scores above zero."""
    best, span, total, first = 0.0, (0, 0), 0.0, 0
    for i, (kind, value, outside, _) in enumerate(rows):
        if outside:  # is left out of the region anyway, so it neither parts nor joins
            continue
        if kind is None:
            name = value.lstrip("/")
            total += weights.get("<" + value, _INSIDE_DEFAULT if name.removesuffix("+a") in INLINE or name in _DEFAULT
                                 or name in CONTENT else _TAG_DEFAULT)
        else:
            plain = _WORD_DEFAULT if kind.endswith("+a") else max(weights.get("p", _DEFAULT["p"]), _DEFAULT["div"])
            total += weights.get(kind, _DEFAULT.get(kind, plain)) * len(value.split())
        if total <= 0:
            total, first = 0.0, i + 1
        elif total > best:
            best, span = total, (first, i + 1)
    return span


def main_text(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    rows = parse(page)
    first, last = region(rows, weights)
    blocks: list[str] = []
    run: list[str] = []
    for kind, value, outside, _ in rows[first:last]:
        if kind is None:
            if value == "br":
                run.append(" ")
            elif value.lstrip("/").removesuffix("+a") not in INLINE:
                blocks.append("".join(run))
                run = []
        elif not outside:
            run.append(value)
    blocks.append("".join(run))
    return " ".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> dict[str, float]:
    """Weights from about ``sample`` pages that mark their article."""
    ready(pages.sparkSession)
    marked = pages.where(F.col(html_col).rlike(r"(?i)<article[\s>]")).select(
        F.col(html_col).alias("html"), F.xxhash64(F.col(id_col)).alias("h"))
    n = marked.count()
    if not n:
        return {}
    most = min((1 << 63) - 1, int(sample / n * 2.0 ** 64) - (1 << 63))

    def run(batches):
        for batch in batches:
            seen: Counter = Counter()
            for page in batch.column(0).to_pylist():
                seen.update(observe(page))
            keys = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()),
                 pa.array([seen[k] for k in keys], pa.int64())], names=["name", "inside", "n"])

    found = (marked.where(F.col("h") <= most).select("html")
             .mapInArrow(run, "name string, inside boolean, n long").groupBy("name", "inside").agg(F.sum("n").alias("n")))
    return weights_of({(r["name"], r["inside"]): r["n"] for r in found.collect()})  # bounded by the sample


def extract(pages: DataFrame, weights: dict[str, float] | None = None, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every row."""
    ready(pages.sparkSession)
    weights = learn(pages, id_col, html_col) if weights is None else weights

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [main_text(x, weights) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()),
                     pa.array([len(x) for x in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return (rows.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
            .withColumnsRenamed({"id": id_col, "url": url_col}))
