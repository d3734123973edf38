"""Domain extraction from website values (Column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extract_domain(c: Column | str) -> Column:
    """Bare lower-case domain of a URL or domain string; NULL when empty.

    Rules (same as the standard-library URL split the reference relies on):

    * a value not starting with ``http://`` / ``https://`` (case-sensitive)
      gets ``https://`` in front, so ``HTTP://a.com`` yields ``http:``;
    * tab, CR and LF are removed anywhere;
    * the network location is everything after ``//`` up to the first of
      ``/ ? #``; port and user-info are kept;
    * with an empty network location the path is used instead (up to
      ``? #``, and without ``;params`` of its last segment);
    * a leading ``www.`` is removed before lower-casing (so ``WWW.`` stays);
    * unbalanced ``[`` / ``]`` in the network location is invalid -> NULL.
    """
    raw = _c(c)
    cleaned = F.regexp_replace(raw, r"[\t\r\n]", "")
    url = F.when(
        cleaned.startswith("http://") | cleaned.startswith("https://"), cleaned
    ).otherwise(F.concat(F.lit("https://"), cleaned))
    host = F.regexp_extract(url, r"^https?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1)
    # urlparse drops ";params" from the last path segment only.
    path = F.regexp_replace(path, r";[^/]*$", "")
    domain = F.when(host != F.lit(""), host).otherwise(path)
    domain = F.regexp_replace(domain, r"^www\.", "")
    bad_brackets = host.contains("[") != host.contains("]")
    return (
        F.when(raw.isNull() | (raw == F.lit("")), F.lit(None).cast("string"))
        .when(bad_brackets, F.lit(None).cast("string"))
        .when(domain == F.lit(""), F.lit(None).cast("string"))
        .otherwise(F.lower(domain))
    )
