"""JSON helpers: dotted-path lookup, loose scraped items, extractor replies."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PY_SPACE, py_strip

# --------------------------------------------------------------------------
# Accepted key spellings of a scraped item (after lower-casing),
# in priority order, and the reply-shape keys tried in order.
# --------------------------------------------------------------------------
FIRST_NAME_KEYS = ["firstname", "first_name"]
LAST_NAME_KEYS = ["lastname", "last_name"]
FULL_NAME_KEY = "name"
ORGANIZATION_KEYS = ["organization", "organisation", "company", "companyname",
                     "company_name", "org"]
EMAIL_KEYS = ["email", "emailaddress", "email_address"]
REPLY_LIST_KEYS = ["result", "items", "people"]
FENCE_PATTERN = r"```(?:json)?\s*([\s\S]*?)\s*```"
# --------------------------------------------------------------------------

_SIMPLE_KEY = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def json_path(c: Column | str, key_path: str, default: str | None = None) -> Column:
    """Value at a dotted path of a JSON text, as text, else ``default``.

    Objects and arrays come back as JSON text. A JSON ``null`` at the path
    gives the default as well.
    """
    parts = key_path.split(".")
    path = "$" + "".join(f".{p}" if _SIMPLE_KEY.match(p) else f"['{p}']" for p in parts)
    v = F.get_json_object(_c(c), path)
    return v if default is None else F.coalesce(v, F.lit(default))


def normalize_item(m: Column | str) -> Column:
    """Loose scraped item (``map<string,string>``) -> struct of
    ``firstName, lastName, organization, email``.

    Keys are lower-cased (a later duplicate wins; needs
    ``spark.sql.mapKeyDedupPolicy=LAST_WIN``), NULL and blank values are
    ignored, values are stripped. ``name`` is split at its first whitespace
    run when no first-name key exists. ``email`` stays NULL when absent.
    """
    kept = F.map_filter(_c(m), lambda k, v: v.isNotNull() & (py_strip(v) != F.lit("")))
    low = F.transform_keys(kept, lambda k, v: F.lower(k))

    def pick(keys: list[str]) -> Column:
        return F.coalesce(*[py_strip(F.try_element_at(low, F.lit(k))) for k in keys])

    explicit_first = pick(FIRST_NAME_KEYS)
    name = py_strip(F.try_element_at(low, F.lit(FULL_NAME_KEY)))
    name_first = F.regexp_extract(name, rf"(?U)^((?:(?!{PY_SPACE}).)+)", 1)
    name_rest = F.regexp_extract(name, rf"(?sU)^(?:(?!{PY_SPACE}).)+{PY_SPACE}+(.*)$", 1)
    first = F.coalesce(explicit_first, name_first, F.lit(""))
    rest = F.when(explicit_first.isNull() & (name_rest != F.lit("")), name_rest)
    last = F.coalesce(pick(LAST_NAME_KEYS), rest, F.lit(""))
    org = F.coalesce(pick(ORGANIZATION_KEYS), F.lit(""))
    email = pick(EMAIL_KEYS)
    return F.struct(first.alias("firstName"), last.alias("lastName"),
                    org.alias("organization"), email.alias("email"))


def strip_fence(c: Column | str) -> Column:
    """Reply text trimmed; a fenced block (```json ... ```) is unwrapped."""
    t = py_strip(_c(c))
    inner = F.regexp_extract(t, FENCE_PATTERN, 1)
    fenced = t.contains("```") & t.rlike(FENCE_PATTERN)
    return F.when(fenced, py_strip(inner)).otherwise(t)


def _is_truthy_json(v: Column) -> Column:
    """Python truthiness of a JSON value given as raw text."""
    s = py_strip(v)
    return v.isNotNull() & ~s.isin("", "[]", "{}", '""', "0", "0.0", "false", "null")


def reply_items_text(c: Column | str) -> Column:
    """The JSON array text that holds the items of a reply.

    A top-level array is used as is; an object contributes the first truthy
    of ``result`` / ``items`` / ``people``. Anything else gives NULL.
    """
    t = _one_value(strip_fence(c))
    is_array = t.startswith("[")
    is_object = t.startswith("{")
    picked = None
    for k in reversed(REPLY_LIST_KEYS):
        v = F.get_json_object(t, f"$.{k}")
        picked = F.when(_is_truthy_json(v), v).otherwise(picked) if picked is not None else \
            F.when(_is_truthy_json(v), v)
    from_obj = F.when(picked.isNotNull() & py_strip(picked).startswith("["), picked)
    return F.when(is_array, t).when(is_object, from_obj)


#: Strict JSON: what a plain JSON parser rejects isn't taken either.
_STRICT = {"allowSingleQuotes": "false"}


def _one_value(t: Column) -> Column:
    """The text of the one JSON value that ``t`` consists of; NULL if it isn't
    one value (not JSON, or more text after it)."""
    values = F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>", _STRICT)
    return F.when(F.size(values) == 1, py_strip(t))


def reply_list_text(c: Column | str) -> Column:
    """The reply itself if it is a JSON array, else NULL (the primary
    extractor's rule: an object holds no items)."""
    t = _one_value(strip_fence(c))
    return F.when(t.startswith("["), t)


def reply_objects(c: Column | str, shapes: bool = True) -> Column:
    """Array of ``map<string,string>``, one per object element of the reply.

    ``shapes=False`` takes a top-level array only.

    Elements that are not JSON objects are dropped singly (parsing as
    ``array<string>`` first keeps one bad element from nulling the rest).
    """
    elems = F.from_json(reply_items_text(c) if shapes else reply_list_text(c), "array<string>", _STRICT)
    as_maps = F.transform(
        F.filter(elems, lambda e: py_strip(e).startswith("{")),
        lambda e: F.from_json(e, "map<string,string>", _STRICT),
    )
    return F.coalesce(F.filter(as_maps, lambda m: m.isNotNull()),
                      F.array().cast("array<map<string,string>>"))


def keep_item(item: Column) -> Column:
    """An item is kept when it has a first name, last name or organisation."""
    return (item["firstName"] != F.lit("")) | (item["lastName"] != F.lit("")) | (
        item["organization"] != F.lit(""))
