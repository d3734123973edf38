"""Scalar text functions as Column -> Column expressions (no Python UDFs).

Each function reproduces a Python string routine of the reference
semantics with JVM-side expressions, so it stays inside whole-stage codegen
or at worst the interpreted higher-order-function path, never a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S

# --------------------------------------------------------------------------
# Regular expressions that must match the reference rules.
# (?U) makes \b, \d, \s and \w Unicode-aware, as Python's str patterns are.
# --------------------------------------------------------------------------
EMAIL_MASK_PATTERN = (
    r"(?U)\b([a-zA-Z0-9])[a-zA-Z0-9._%+-]*@([a-zA-Z0-9])[a-zA-Z0-9.-]*"
    r"\.[a-zA-Z]{2,}\b"
)
EMAIL_MASK_REPLACEMENT = "$1***@$2***.com"
PHONE_MASK_PATTERNS = [
    r"(?U)\+\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}",
    r"(?U)\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    r"(?U)\d{3}[-.\s]?\d{3}[-.\s]?\d{4}",
]
EMAIL_VALID_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
# Python's str.isspace() set: Unicode White_Space plus \x1c-\x1f.
PY_SPACE = r"[\s\x1c-\x1f]"
# "Cased" characters in Python's str.title() sense.
CASED = r"\p{IsLowercase}\p{IsUppercase}\p{IsTitlecase}"
# --------------------------------------------------------------------------


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace.

    Spark's ``trim`` removes only the space character.
    """
    return F.regexp_replace(_c(c), rf"(?U)^{PY_SPACE}+|{PY_SPACE}+$", "")


def has_value(c: Column | str) -> Column:
    """Non-empty in the upsert sense: not NULL and not ``""``.

    Whitespace-only strings count as values (no trim).
    """
    c = _c(c)
    return c.isNotNull() & (c != F.lit(""))


def has_value_any(c: Column | str, dtype) -> Column:
    """``has_value`` for any column type; doubles also exclude NaN."""
    from pyspark.sql import types as T

    c = _c(c)
    if isinstance(dtype, T.StringType):
        return has_value(c)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()


def is_blank(c: Column | str) -> Column:
    """NULL or only whitespace (after ``str.strip()``)."""
    c = _c(c)
    return c.isNull() | (py_strip(c) == F.lit(""))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a lambda variable).

    Expressions inside higher-order functions are not shared by Spark's
    subexpression elimination; binding through a one-element ``transform``
    keeps a stage that reads its input twice from evaluating it twice.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _mask_phone(p: Column) -> Column:
    n_digits = F.length(F.regexp_replace(p, r"(?U)\D", ""))
    head = p.substr(F.lit(1), F.length(p) - 2)
    return F.when(
        n_digits >= 4,
        F.concat(F.regexp_replace(head, r"(?U)\d", "*"), F.right(p, F.lit(2))),
    ).otherwise(F.repeat(F.lit("*"), F.length(p)))


def mask_pii(c: Column | str) -> Column:
    """Mask e-mails as ``u***@e***.com`` and phone numbers.

    Phones: each of three patterns in turn; every match whose digits number
    at least four keeps its last two characters and turns digits before them
    into ``*``; shorter matches become all ``*``. Every occurrence of a
    matched substring is replaced, in match order, like ``str.replace`` in a
    loop. NULL and ``""`` come back unchanged.
    """
    text = F.regexp_replace(_c(c), F.lit(EMAIL_MASK_PATTERN), F.lit(EMAIL_MASK_REPLACEMENT))
    for pattern in PHONE_MASK_PATTERNS:
        text = let(text, _phone_stage(pattern))
    return text


def _phone_stage(pattern: str):
    """One phone pattern applied to a bound text (single-argument lambda)."""
    def stage(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(pattern), 0)
        return F.aggregate(found, t, lambda acc, p: F.replace(acc, p, _mask_phone(p)))
    return stage


def is_valid_email(c: Column | str) -> Column:
    """Non-blank, at most 254 characters after strip, and matching the pattern.

    NULL is invalid.
    """
    s = py_strip(_c(c))
    return F.coalesce(
        (s != F.lit(""))
        & (F.length(s) <= S.EMAIL_MAX_LENGTH)
        & s.rlike(EMAIL_VALID_PATTERN),
        F.lit(False),
    )


_SPACE_MARK = "\uffff"  # stands in for original spaces while initcap runs


def title_case(c: Column | str) -> Column:
    """Python ``str.title()``: upper-case a cased character that follows an
    uncased one (start, digit, apostrophe, ``&`` ...), lower-case the rest.

    Codegen-friendly form: original spaces are parked on a marker, a space
    is put before every cased character that follows an uncased one,
    ``initcap`` capitalises after those spaces, then the inserted spaces go
    and the marker turns back into spaces. A word-initial ``ß`` becomes
    ``Ss`` (its full title-case mapping). Text containing U+FFFF is not
    supported (that code point is the marker).
    """
    lowered = F.lower(_c(c))
    parked = F.translate(lowered, " ", _SPACE_MARK)
    spaced = F.regexp_replace(parked, rf"(?<=[^{CASED}])(?=[{CASED}])", " ")
    # one pass fixes a word-initial sharp s (referencing the initcap result
    # once: a CASE over it would evaluate it per branch)
    capped = F.regexp_replace(F.initcap(spaced), "(^| )ß", "$1Ss")
    return F.translate(F.replace(capped, F.lit(" "), F.lit("")), _SPACE_MARK, " ")


def collapse_spaces(c: Column | str) -> Column:
    """``' '.join(s.split())``: trim and collapse whitespace runs to one space."""
    return F.regexp_replace(py_strip(_c(c)), rf"(?U){PY_SPACE}+", " ")


def normalize_company(c: Column | str) -> Column:
    """Company name: collapse whitespace, then title case; NULL/'' -> ''."""
    c = _c(c)
    return F.when(c.isNull() | (c == F.lit("")), F.lit("")).otherwise(
        title_case(collapse_spaces(c)))


def clean_phone(c: Column | str) -> Column:
    """Keep digits and ``+``; NULL/'' -> ''."""
    c = _c(c)
    return F.when(c.isNull() | (c == F.lit("")), F.lit("")).otherwise(
        F.regexp_replace(c, r"(?U)[^\d+]", ""))


def flatten_list(c: Column | str, sep: str = ", ") -> Column:
    """Join array items with ``sep``, dropping NULL and '' items; NULL/[] -> ''."""
    arr = _c(c)
    kept = F.filter(arr, lambda x: x.isNotNull() & (x.cast("string") != F.lit("")))
    return F.coalesce(F.array_join(F.transform(kept, lambda x: x.cast("string")), sep), F.lit(""))


def safe_int(c: Column | str, default: int | Column = 0) -> Column:
    """Python ``int(value)`` for text, else ``default`` (bigint).

    Accepts surrounding whitespace, a sign and single underscores between
    digits; anything else ('3.7', '', NULL, overflow) gives the default.
    """
    s = py_strip(_c(c).cast("string"))
    ok = s.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$")
    parsed = F.when(ok, F.regexp_replace(s, "_", "").try_cast("bigint"))
    d = default if isinstance(default, Column) else F.lit(default).cast("bigint")
    return F.coalesce(parsed, d)


def safe_str(c: Column | str, default: str = "") -> Column:
    """``str(value).strip()``, or ``default`` when NULL."""
    return F.coalesce(py_strip(_c(c).cast("string")), F.lit(default))


def display_value(c: Column | str) -> Column:
    """Blank or NULL -> '', else the stripped text."""
    return F.coalesce(py_strip(_c(c).cast("string")), F.lit(""))


def truncate_text(c: Column | str, max_chars: int = S.DEFAULT_MAX_HTML_CHARS,
                  marker: str = S.TRUNCATION_MARKER) -> Column:
    """Cut to ``max_chars`` characters and append the marker when longer."""
    c = _c(c)
    return F.when(
        F.length(c) > max_chars,
        F.concat(c.substr(F.lit(1), F.lit(max_chars)), F.lit(marker)),
    ).otherwise(c)


def utc_now_text() -> Column:
    """Current UTC time as ``yyyy-MM-ddTHH:mm:ssZ`` whatever the session zone."""
    return format_utc(F.current_timestamp())


def format_utc(ts: Column) -> Column:
    """Render a timestamp in UTC with second precision and a ``Z`` suffix."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), S.TIMESTAMP_FORMAT)
