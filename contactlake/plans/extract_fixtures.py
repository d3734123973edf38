"""Deterministic stand-ins for the page extractors, and reply texts built
from the benchmark tables, for the extraction queries."""

from __future__ import annotations

import json
import re

_LINK = re.compile(r'<a href="/[^"]*">([^<]*)</a>')
_HOST = re.compile(r"^https?://([^/?#]*)")

# Replies of four shapes, one per supplier: fenced array with a non-object
# element, object with "result", object with an empty "items" and
# "people", and text that is not JSON.
REPLIES_SQL = """
SELECT s.s_suppkey AS page_id,
  CASE s.s_suppkey % 4
    WHEN 0 THEN '```json' || chr(10) || '[{{"name": "' || s.s_name || '  X", "company": "' || n.n_name || '"}}, 7]' || chr(10) || '```'
    WHEN 1 THEN '{{"result": [{{"FirstName": "A' || CAST(s.s_suppkey AS STRING) || '", "last_name": " B ", "org": ""}}]}}'
    WHEN 2 THEN '{{"items": [], "people": [{{"organisation": "' || n.n_name || '"}}, "x"]}}'
    ELSE 'no JSON here ' || s.s_name
  END AS reply
FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey
"""

PARSED_ITEMS_ORACLE = """
SELECT s.s_suppkey AS page_id, CAST(0 AS INTEGER) AS item_pos,
  CASE s.s_suppkey % 4 WHEN 0 THEN s.s_name WHEN 1 THEN 'A' || CAST(s.s_suppkey AS VARCHAR) ELSE '' END AS firstName,
  CASE s.s_suppkey % 4 WHEN 0 THEN 'X' WHEN 1 THEN 'B' ELSE '' END AS lastName,
  CASE s.s_suppkey % 4 WHEN 0 THEN n.n_name WHEN 2 THEN n.n_name ELSE '' END AS organization,
  CAST(NULL AS VARCHAR) AS email
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
WHERE s.s_suppkey % 4 <> 3
"""


def primary_extractor(html: str, url: str, mail: bool = False) -> str:
    """Pairs of navigation link texts become people of the page's host.
    Reply shape varies with the page: a fenced list, an object (which holds
    no items, so that the page goes to the fallback), or a list with other
    values in it; a path number that is a multiple of 7 gives no reply. With
    ``mail`` every fourth person, from the first on, has an e-mail."""
    host = (_HOST.match(url) or [None, ""])[1]
    num = re.search(r"/(\d+)", url)
    if num and int(num.group(1)) % 7 == 0:
        return ""
    links = _LINK.findall(html)
    items = [{"firstName": links[i], "lastName": links[i + 1], "organization": host}
             for i in range(0, len(links) - 1, 2)]
    if mail:
        for i, item in enumerate(items[::4]):
            item["email"] = f"person{4 * i}@{host}"
    shape = len(url) % 3
    if shape == 0:
        return "```json\n" + json.dumps(items) + "\n```"
    if shape == 1:
        return json.dumps({"result": items})
    return json.dumps(["junk"] + items[:1] + [42] + items[1:])


def fallback_extractor(url: str) -> dict:
    host = (_HOST.match(url) or [None, ""])[1]
    return {"items": [{"name": "Fallback  Contact", "company": host}]}


EXTRACT_ORACLE = r"""
WITH p AS (
  SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host,
         regexp_extract_all(html, '<a href="/[^"]*">([^<]*)</a>', 1) AS links,
         -- an empty reply, or an object where a list is asked for
         coalesce(TRY_CAST(regexp_extract(url, '/(\d+)', 1) AS BIGINT) % 7 = 0, false)
           OR length(url) % 3 = 1 AS empty_reply
  FROM pages),
prim AS (
  SELECT page_id, url, 'primary' AS source, CAST(i AS INTEGER) AS item_pos,
         trim(links[2 * i + 1]) AS firstName, trim(links[2 * i + 2]) AS lastName, host AS organization
  FROM p, range(CAST(len(links) // 2 AS BIGINT)) r(i) WHERE NOT empty_reply),
fb AS (
  SELECT page_id, url, 'fallback' AS source, CAST(0 AS INTEGER) AS item_pos, 'Fallback' AS firstName,
         'Contact' AS lastName, host AS organization
  FROM p WHERE empty_reply OR len(links) < 2)
SELECT *, CAST(NULL AS VARCHAR) AS email FROM prim
WHERE firstName <> '' OR lastName <> '' OR organization <> ''
UNION ALL SELECT *, CAST(NULL AS VARCHAR) AS email FROM fb
"""
