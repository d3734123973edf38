"""DuckDB SQL builders for the oracle side of the query catalog.

These restate each operator's rule in DuckDB's dialect (RE2 regular
expressions, list lambdas) so the Spark result can be checked against an
independent engine. They are test oracles only; nothing here runs on Spark.
"""

from __future__ import annotations

from .. import schema as S
from .derived import INCOMING_SQL, RAW_CONTACTS_SQL, duck_sql


def q(name: str) -> str:
    """Double-quoted identifier."""
    return '"' + name.replace('"', '""') + '"'


def d_domain(x: str) -> str:
    w = f"replace(replace(replace({x}, chr(9), ''), chr(13), ''), chr(10), '')"
    u = (f"(CASE WHEN starts_with({w}, 'http://') OR starts_with({w}, 'https://') THEN {w} "
         f"ELSE 'https://' || {w} END)")
    host = f"regexp_extract({u}, '^https?://([^/?#]*)', 1)"
    path = f"regexp_replace(regexp_extract({u}, '^https?://[^/?#]*([^?#]*)', 1), ';[^/]*$', '')"
    d = f"regexp_replace(CASE WHEN {host} <> '' THEN {host} ELSE {path} END, '^www\\.', '')"
    return (f"(CASE WHEN {x} IS NULL OR {x} = '' THEN NULL "
            f"WHEN (strpos({host}, '[') > 0) <> (strpos({host}, ']') > 0) THEN NULL "
            f"WHEN {d} = '' THEN NULL ELSE lower({d}) END)")


def d_title(x: str) -> str:
    cased = r"\p{Ll}\p{Lu}\p{Lt}"
    return (f"array_to_string(list_transform(regexp_extract_all(lower({x}), "
            f"'[^{cased}]|[{cased}]+'), lambda t: (CASE WHEN left(t, 1) = 'ß' THEN 'Ss' "
            f"ELSE upper(left(t, 1)) END) || substr(t, 2)), '')")


def d_company(x: str) -> str:
    collapsed = f"regexp_replace(trim({x}, ' ' || chr(9) || chr(10) || chr(13)), '\\s+', ' ', 'g')"
    return f"(CASE WHEN {x} IS NULL OR {x} = '' THEN '' ELSE {d_title(collapsed)} END)"


def d_valid_email(x: str) -> str:
    s = f"trim({x})"
    return (f"coalesce(({s} <> '' AND length({s}) <= {S.EMAIL_MAX_LENGTH} AND "
            f"regexp_full_match({s}, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}')), false)")


def raw_contacts_sql() -> str:
    return duck_sql(RAW_CONTACTS_SQL)


def incoming_sql() -> str:
    return duck_sql(INCOMING_SQL)


def normalized_contacts_sql() -> str:
    """Header mapping + normalisation of the derived sheet, in DuckDB."""
    return f"""
SELECT _row_id,
  trim(email) AS {q(S.EMAIL)},
  coalesce(trim(fname), '') AS {q(S.FIRST)},
  coalesce(trim(lname), '') AS {q(S.LAST)},
  coalesce(CASE WHEN organization IS NULL THEN NULL ELSE {d_company('organization')} END, '') AS {q(S.COMPANY)},
  coalesce({d_domain('website')}, '') AS {q(S.WEBSITE)},
  coalesce(trim(title), '') AS {q(S.TITLE)},
  coalesce(phone, '') AS {q(S.PERSON_PHONE)},
  coalesce(country, '') AS {q(S.COUNTRY)},
  coalesce(region, '') AS {q(S.STATE)},
  coalesce(email_send, '') AS {q(S.EMAIL_SEND)},
  coalesce(client_type, '') AS {q(S.CLIENT_TYPE)},
  '{S.DEFAULT_LEAD_SOURCE}' AS {q(S.LEAD_SOURCE)}
FROM ({raw_contacts_sql()}) raw
WHERE {d_valid_email('email')}
"""


def deduped_contacts_sql() -> str:
    return f"""
SELECT * FROM ({normalized_contacts_sql()}) n
QUALIFY row_number() OVER (PARTITION BY {q(S.EMAIL)} ORDER BY _row_id) = 1
"""
