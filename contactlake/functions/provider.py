"""Provider response objects -> truth columns (Column expressions).

A person or organisation match is a struct column. Every target column is
an expression that is NULL when the source field is "falsy" in the
Python sense (NULL, '', 0, empty list) -- NULL plays the role of "key not
set" -- and the stripped text of the value otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from .text import flatten_list, py_strip

# --------------------------------------------------------------------------
# Response shapes (field names as the provider sends them).
# --------------------------------------------------------------------------
ORG_SCHEMA = T.StructType([
    T.StructField(n, t) for n, t in [
        ("id", T.StringType()), ("name", T.StringType()), ("website_url", T.StringType()),
        ("primary_domain", T.StringType()), ("industry", T.StringType()),
        ("industries", T.ArrayType(T.StringType())), ("keywords", T.ArrayType(T.StringType())),
        ("estimated_num_employees", T.StringType()), ("founded_year", T.StringType()),
        ("publicly_traded_symbol", T.StringType()), ("publicly_traded_exchange", T.StringType()),
        ("linkedin_url", T.StringType()), ("phone", T.StringType()),
        ("account", T.StructType([T.StructField("phone", T.StringType())])),
        ("raw_address", T.StringType()), ("city", T.StringType()), ("state", T.StringType()),
        ("country", T.StringType()), ("logo_url", T.StringType()),
        ("short_description", T.StringType()), ("seo_description", T.StringType()),
        ("departmental_head_count", T.MapType(T.StringType(), T.StringType())),
        ("estimated_annual_revenue", T.StringType()), ("annual_revenue", T.StringType()),
        ("size", T.StringType()), ("organization_size", T.StringType()),
        ("alexa_ranking", T.StringType()), ("twitter_url", T.StringType()),
        ("facebook_url", T.StringType()), ("revenue_range", T.StringType()),
        ("employee_count_range", T.StringType()), ("total_funding", T.StringType()),
        ("latest_funding_round_date", T.StringType()), ("technologies", T.ArrayType(T.StringType())),
    ]
])

PERSON_SCHEMA = T.StructType([
    T.StructField(n, t) for n, t in [
        ("first_name", T.StringType()), ("last_name", T.StringType()), ("title", T.StringType()),
        ("email", T.StringType()), ("linkedin_url", T.StringType()), ("country", T.StringType()),
        ("state", T.StringType()), ("phone_numbers", T.ArrayType(T.StringType())),
        ("email_status", T.StringType()), ("headline", T.StringType()),
        ("seniority", T.StringType()), ("departments", T.ArrayType(T.StringType())),
        ("subdepartments", T.ArrayType(T.StringType())), ("functions", T.ArrayType(T.StringType())),
        ("photo_url", T.StringType()), ("twitter_url", T.StringType()),
        ("github_url", T.StringType()), ("facebook_url", T.StringType()),
        ("is_likely_to_engage", T.BooleanType()),
        ("employment_history", T.ArrayType(T.StructType([
            T.StructField("organization_name", T.StringType()),
            T.StructField("start_date", T.StringType())]))),
        ("organization", ORG_SCHEMA),
    ]
])

# Text fields that carry numbers, as numbers or as text: "0" is falsy like the number 0.
NUMERIC_TEXT = {"estimated_annual_revenue", "annual_revenue", "total_funding", "estimated_num_employees", "founded_year",
                "alexa_ranking"}
YES, NO = "Yes", "No"
# --------------------------------------------------------------------------


def _field_type(struct_type: T.StructType, name: str) -> T.DataType | None:
    for f in struct_type.fields:
        if f.name == name:
            return f.dataType
    return None


def truthy(c: Column, dtype: T.DataType, numeric_text: bool = False) -> Column:
    """Python truthiness of a value of the given type (NULL is falsy)."""
    if isinstance(dtype, T.StringType):
        t = c.isNotNull() & (c != F.lit(""))
        if numeric_text:
            t = t & F.coalesce(c.try_cast("double") != F.lit(0.0), F.lit(True))
        return t
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return c.isNotNull() & (F.size(c) > 0)
    if isinstance(dtype, T.NumericType):
        return c.isNotNull() & (c != F.lit(0))
    return c.isNotNull()


def as_text(c: Column, dtype: T.DataType) -> Column:
    """``str(value).strip()``; NULL -> ''."""
    if isinstance(dtype, T.BooleanType):
        return F.when(c.isNull(), F.lit("")).when(c, F.lit("True")).otherwise(F.lit("False"))
    if isinstance(dtype, T.StringType):
        return F.coalesce(py_strip(c), F.lit(""))
    return F.coalesce(py_strip(c.cast("string")), F.lit(""))


class _Obj:
    """Field access on a struct column with type-aware truthiness."""

    def __init__(self, col: Column, dtype: T.StructType) -> None:
        self.col, self.dtype = col, dtype

    def t(self, name: str) -> T.DataType:
        return _field_type(self.dtype, name) or T.StringType()

    def get(self, name: str) -> Column:
        if _field_type(self.dtype, name) is None:
            return F.lit(None).cast("string")
        return self.col[name]

    def ok(self, name: str) -> Column:
        if _field_type(self.dtype, name) is None:
            return F.lit(False)
        return self.col.isNotNull() & truthy(self.get(name), self.t(name), name in NUMERIC_TEXT)

    def text(self, name: str) -> Column:
        return as_text(self.get(name), self.t(name))

    def set_if(self, name: str) -> Column:
        return F.when(self.ok(name), self.text(name))

    def first_text(self, name: str) -> Column:
        arr = self.get(name)
        el_type = self.t(name).elementType if isinstance(self.t(name), T.ArrayType) else T.StringType()
        return as_text(F.get(arr, 0), el_type)


def _some(col: Column, dtype: T.StructType) -> Column:
    """Whether an object has a field that is set."""
    return col.isNotNull() & F.coalesce(*[F.when(col[f.name].isNotNull(), F.lit(True)) for f in dtype.fields], F.lit(False))


def map_person(col: Column, dtype: T.StructType = PERSON_SCHEMA,
               prefixes: S.ProviderPrefixes = S.DEFAULT_PREFIXES) -> list[tuple[str, Column]]:
    """Person match -> ``[(column, value-or-NULL)]``: 8 base and 13 provider columns."""
    p = _Obj(col, dtype)
    P = prefixes.person
    out = [
        (S.FIRST, p.set_if("first_name")),
        (S.LAST, p.set_if("last_name")),
        (S.TITLE, p.set_if("title")),
        (S.EMAIL, p.set_if("email")),
        (S.PERSON_LINKEDIN, p.set_if("linkedin_url")),
        (S.COUNTRY, p.set_if("country")),
        (S.STATE, p.set_if("state")),
        (S.PERSON_PHONE, F.when(p.ok("phone_numbers"), p.first_text("phone_numbers"))),
        (P + "Email Status", p.set_if("email_status")),
        (P + "Headline", p.set_if("headline")),
        (P + "Seniority", p.set_if("seniority")),
        (P + "Departments", F.when(p.ok("departments"), flatten_list(p.get("departments")))),
        (P + "Subdepartments", F.when(p.ok("subdepartments"), flatten_list(p.get("subdepartments")))),
        (P + "Functions", F.when(p.ok("functions"), flatten_list(p.get("functions")))),
        (P + "Photo URL", p.set_if("photo_url")),
        (P + "Twitter URL", p.set_if("twitter_url")),
        (P + "Github URL", p.set_if("github_url")),
        (P + "Facebook URL", p.set_if("facebook_url")),
    ]
    eng = p.get("is_likely_to_engage")
    out.append((P + "Is Likely To Engage",
                F.when(col.isNotNull() & eng.isNotNull(), F.when(eng, YES).otherwise(NO))))
    hist_t = p.t("employment_history")
    if isinstance(hist_t, T.ArrayType) and isinstance(hist_t.elementType, T.StructType):
        cur = _Obj(F.get(p.get("employment_history"), 0), hist_t.elementType)
        has_hist = p.ok("employment_history")
        out.append((P + "Current Org", F.when(has_hist, cur.set_if("organization_name"))))
        out.append((P + "Current Role Start Date", F.when(has_hist, cur.set_if("start_date"))))
    else:
        out.append((P + "Current Org", F.lit(None).cast("string")))
        out.append((P + "Current Role Start Date", F.lit(None).cast("string")))
    return out


ORG_BASE_COLUMNS = [S.COMPANY, S.INDUSTRY, S.WEBSITE, S.COMPANY_LINKEDIN, S.EMPLOYEES,
                    S.COMPANY_PHONE, S.ADDRESS, S.LISTED, S.REVENUE, S.SIZE]
PERSON_BASE_COLUMNS = [S.FIRST, S.LAST, S.TITLE, S.EMAIL, S.PERSON_LINKEDIN, S.COUNTRY, S.STATE,
                       S.PERSON_PHONE]


def company_columns(prefixes: S.ProviderPrefixes = S.DEFAULT_PREFIXES) -> list[str]:
    """Names :func:`map_company` produces, in its order (no session needed)."""
    return ORG_BASE_COLUMNS + prefixes.company_columns()


def person_columns(prefixes: S.ProviderPrefixes = S.DEFAULT_PREFIXES) -> list[str]:
    """Names :func:`map_person` produces, in its order (no session needed)."""
    return PERSON_BASE_COLUMNS + prefixes.person_columns()


def map_company(col: Column, dtype: T.StructType = ORG_SCHEMA,
                prefixes: S.ProviderPrefixes = S.DEFAULT_PREFIXES) -> list[tuple[str, Column]]:
    """Organisation match -> ``[(column, value-or-NULL)]``: 10 base and 17
    provider columns, with the fallback chains (industry <- industries[0],
    phone <- account.phone, address <- city/state/country, revenue and
    size alternatives). ``Listed Company`` is set for every match that holds
    something; an empty object is no match."""
    o = _Obj(col, dtype)
    C = prefixes.company
    acct_t = o.t("account")
    acct_phone = F.lit(None).cast("string")
    if isinstance(acct_t, T.StructType) and _field_type(acct_t, "phone") is not None:
        acct = _Obj(o.get("account"), acct_t)
        acct_phone = F.when(acct.ok("phone"), acct.text("phone"))
    parts = F.array(o.text("city"), o.text("state"), o.text("country"))
    address = F.when(o.ok("raw_address"), o.text("raw_address")).when(
        o.ok("city") | o.ok("state") | o.ok("country"),
        F.array_join(F.filter(parts, lambda x: x != F.lit("")), ", "))
    dept_t = o.t("departmental_head_count")
    dept = F.lit(None).cast("string")
    if isinstance(dept_t, T.MapType):
        entries = F.filter(F.map_entries(o.get("departmental_head_count")),
                           lambda e: truthy(e["value"], dept_t.valueType, True))
        joined = F.array_join(F.transform(entries, lambda e: F.concat(
            e["key"], F.lit(": "), e["value"].cast("string"))), ", ")
        dept = F.when(o.ok("departmental_head_count") & (F.size(entries) > 0), joined)
    out = [
        (S.COMPANY, o.set_if("name")),
        (S.INDUSTRY, F.when(o.ok("industry"), o.text("industry"))
         .when(o.ok("industries"), o.first_text("industries"))),
        (S.WEBSITE, o.set_if("website_url")),
        (S.COMPANY_LINKEDIN, o.set_if("linkedin_url")),
        (S.EMPLOYEES, o.set_if("estimated_num_employees")),
        (S.COMPANY_PHONE, F.when(o.ok("phone"), o.text("phone")).otherwise(acct_phone)),
        (S.ADDRESS, address),
        (S.LISTED, F.when(_some(col, dtype), F.when(o.ok("publicly_traded_symbol"), YES).otherwise(NO))),
        (S.REVENUE, F.when(o.ok("estimated_annual_revenue"), o.text("estimated_annual_revenue"))
         .when(o.ok("annual_revenue"), o.text("annual_revenue"))),
        (S.SIZE, F.when(o.ok("size"), o.text("size")).when(o.ok("organization_size"),
                                                             o.text("organization_size"))),
        (C + "Primary Domain", o.set_if("primary_domain")),
        (C + "Founded Year", o.set_if("founded_year")),
        (C + "Alexa Ranking", o.set_if("alexa_ranking")),
        (C + "SEO Description", o.set_if("seo_description")),
        (C + "Short Description", o.set_if("short_description")),
        (C + "Keywords", F.when(o.ok("keywords"), flatten_list(o.get("keywords")))),
        (C + "Public Ticker", o.set_if("publicly_traded_symbol")),
        (C + "Public Exchange", o.set_if("publicly_traded_exchange")),
        (C + "Logo URL", o.set_if("logo_url")),
        (C + "Twitter URL", o.set_if("twitter_url")),
        (C + "Facebook URL", o.set_if("facebook_url")),
        (C + "Department Headcount", dept),
        (C + "Revenue Range", o.set_if("revenue_range")),
        (C + "Employee Range", o.set_if("employee_count_range")),
        (C + "Total Funding", o.set_if("total_funding")),
        (C + "Latest Funding Round Date", o.set_if("latest_funding_round_date")),
        (C + "Technologies", F.when(o.ok("technologies"), flatten_list(o.get("technologies")))),
    ]
    return out


def people_request(first: Column, last: Column, website: Column, company: Column,
                   email: Column) -> Column:
    """Request object of one record: names, domain else company name, and
    e-mail; fields with falsy values are left out (``to_json`` omits NULL)."""
    def v(c: Column) -> Column:
        return F.when(c.isNotNull() & (c != F.lit("")), c)
    return F.struct(
        v(first).alias("first_name"), v(last).alias("last_name"),
        v(website).alias("organization_domain"),
        F.when(v(website).isNull(), v(company)).alias("organization_name"),
        v(email).alias("email"))
