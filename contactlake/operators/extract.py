"""Contact extraction from stored pages.

Pages are a table ``(page_id, url, html)`` (a failed fetch is a NULL
``html``). The primary extractor is an injected callable
``(html, url) -> reply text`` (e.g. a model reply holding a JSON array,
possibly inside a code fence); it runs in ``mapInPandas`` on the whole
HTML. Parsing the reply into items is Spark-native: fence strip, JSON
array or ``result`` / ``items`` / ``people`` object, objects only, loose
key spellings, and the keep rule (first name, last name or organisation).
Pages that yield no item go to the fallback extractor ``(url) -> payload``
(a JSON array or object as text, or a Python list / dict), selected with a
``left_anti`` join, so the fallback runs only where needed.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.json import keep_item, normalize_item, reply_objects
from ..functions.text import py_strip, truncate_text
from ..session import apply_runtime_conf, checkpoint_dir, ship_package
from .keys import with_index

ITEM_COLUMNS = ["firstName", "lastName", "organization", "email"]


def _call_each(df: DataFrame, fn: Callable, args: list[str], parallelism: int | None) -> DataFrame:
    """``(page_id, reply)`` from calling ``fn`` once per row (Python only for
    the external call itself); a failing call yields an empty reply."""
    ship_package(df.sparkSession)
    if parallelism:
        df = df.repartition(parallelism)

    def run(it):
        import pandas as pd

        for pdf in it:
            out = []
            for vals in zip(*[pdf[a].tolist() for a in args]):
                try:
                    r = fn(*vals)
                except Exception:  # extractor errors mean "no items"
                    r = None
                if r is not None and not isinstance(r, str):
                    r = json.dumps(r)
                out.append(r)
            yield pd.DataFrame({"page_id": pdf["page_id"].tolist(), "url": pdf["url"].tolist(), "reply": out})

    cols = ["page_id", "url"] + [a for a in args if a != "url"]
    return df.select(*cols).mapInPandas(run, "page_id long, url string, reply string")


def parse_reply(replies: DataFrame, keep: tuple[str, ...] = (), shapes: bool = True) -> DataFrame:
    """``(page_id, reply)`` -> ``(page_id, item_pos, firstName, lastName,
    organization, email)`` keeping items with a name or organisation.
    ``shapes=False`` (primary replies) takes items from a top-level array only.
    Sets ``spark.sql.mapKeyDedupPolicy=LAST_WIN`` on the session (item keys
    that collide after lower-casing: the later one wins)."""
    apply_runtime_conf(replies.sparkSession)
    objs = replies.select("page_id", *keep, F.posexplode(reply_objects("reply", shapes)).alias("item_pos", "m"))
    items = objs.select("page_id", *keep, "item_pos", normalize_item("m").alias("it")).where(keep_item(F.col("it")))
    return items.select("page_id", *keep, "item_pos", *[F.col("it")[c].alias(c) for c in ITEM_COLUMNS])


def extract_contacts(pages: DataFrame, primary: Callable[[str, str], str] | None,
                     fallback: Callable[[str], object] | None = None,
                     max_chars: int | None = None,
                     parallelism: int | None = None) -> DataFrame:
    """Items per page: ``(page_id, url, source, item_pos, firstName,
    lastName, organization, email)`` with ``source`` = primary / fallback.

    The extractor sees whole pages; ``max_chars`` cuts them when given. The
    primary replies are checkpointed, so that each page is asked about once.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    found = None
    if primary is not None:
        usable = pages.where(F.col("html").isNotNull() & (py_strip(F.col("html")) != F.lit("")))
        html = truncate_text(F.col("html"), max_chars) if max_chars else F.col("html")
        checkpoint_dir(pages.sparkSession)
        replies = _call_each(usable.select("page_id", "url", html.alias("html")), primary, ["html", "url"],
                             parallelism).checkpoint(eager=True)
        found = parse_reply(replies, keep=("url",), shapes=False) \
            .withColumn("source", F.lit("primary"))
    if fallback is not None:
        # only (page_id, url) is shuffled for the anti join, never the html
        ids = pages.select("page_id", "url")
        rest = ids if found is None else ids.join(found.select("page_id").distinct(), "page_id", "left_anti")
        more = parse_reply(_call_each(rest, fallback, ["url"], parallelism), keep=("url",)) \
            .withColumn("source", F.lit("fallback"))
        found = more if found is None else found.unionByName(more)
    if found is None:
        raise ValueError("no extractor given")
    return found.select("page_id", "url", "source", "item_pos", *ITEM_COLUMNS)


def items_to_contacts(items: DataFrame, lead_source: str = S.SCRAPE_LEAD_SOURCE) -> DataFrame:
    """Items -> base-column contact rows: ``Lead Source`` = the scrape value,
    ``Email Send`` = "No", other base columns ''. The e-mail column is
    present only when some item has an e-mail (normalisation then drops the
    rows without one, unless it is told not to validate e-mails). Order key
    ``_row_id`` = position by page id and item position."""
    def s(c: str):
        return F.coalesce(py_strip(F.col(c)), F.lit(""))

    rows = with_index(items, ["page_id", "item_pos"], name="_row_id").where((s("firstName") != "") | (s("lastName") != "") | (s("organization") != ""))
    with_email = rows.where(s("email") != "").limit(1).count() > 0
    base = [c for c in S.BASE_COLUMNS if c not in (S.SN, S.UPDATED)]
    cols = [F.col("_row_id")]
    for c in base:
        if c == S.FIRST:
            v = s("firstName")
        elif c == S.LAST:
            v = s("lastName")
        elif c == S.COMPANY:
            v = s("organization")
        elif c == S.LEAD_SOURCE:
            v = F.lit(lead_source)
        elif c == S.EMAIL_SEND:
            v = F.lit(S.DEFAULT_EMAIL_SEND)
        elif c == S.EMAIL:
            if not with_email:
                continue
            v = F.when(s("email") != "", s("email"))
        else:
            v = F.lit("")
        cols.append(v.alias(c))
    return rows.select(*cols)
