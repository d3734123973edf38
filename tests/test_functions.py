"""Scalar function expectations (mirroring the reference's unit tests)."""

import pytest
from pyspark.sql import functions as F

from contactlake import functions as CF


def one(spark, expr, value, typ="string"):
    df = spark.createDataFrame([(value,)], f"x {typ}")
    return df.select(expr(F.col("x")).alias("y")).first()["y"]


def test_mask_email(spark):
    out = one(spark, CF.mask_pii, "Contact user@example.com for details")
    assert "user@example.com" not in out and "u***@e***.com" in out


def test_mask_multiple_emails(spark):
    out = one(spark, CF.mask_pii, "Email john@test.com or jane@demo.org")
    assert "john@test.com" not in out and "jane@demo.org" not in out


def test_mask_phone(spark):
    out = one(spark, CF.mask_pii, "Call +1-555-123-4567")
    assert "555" not in out and out.endswith("67")


def test_mask_no_pii_and_empty(spark):
    assert one(spark, CF.mask_pii, "This is a normal message") == "This is a normal message"
    assert one(spark, CF.mask_pii, "") == ""
    assert one(spark, CF.mask_pii, None) is None


@pytest.mark.parametrize("url,expected", [
    ("https://www.example.com/path", "example.com"),
    ("http://subdomain.test.com", "subdomain.test.com"),
    ("example.com", "example.com"),
    ("www.test.org", "test.org"),
    ("", None),
    (None, None),
    ("WWW.X.com", "www.x.com"),
    ("https://u@h.com:8080/x", "u@h.com:8080"),
    ("https:///foo", "/foo"),
    ("HTTP://a.com", "http:"),
])
def test_extract_domain(spark, url, expected):
    assert one(spark, CF.extract_domain, url) == expected


@pytest.mark.parametrize("email,ok", [
    ("test@example.com", True), ("user.name+tag@domain.co.uk", True), ("  a@b.io  ", True),
    ("invalid", False), ("@example.com", False), ("user@", False), ("", False), (None, False),
    ("a" * 250 + "@x.com", False),
])
def test_validate_email(spark, email, ok):
    assert one(spark, CF.is_valid_email, email) is ok


@pytest.mark.parametrize("name,expected", [
    ("acme corp", "Acme Corp"), ("  ACME   CORP  ", "Acme Corp"), ("", ""), (None, ""),
    ("at&t", "At&T"), ("3m-foo", "3M-Foo"), ("mcdonald's", "Mcdonald'S"),
])
def test_company_name(spark, name, expected):
    assert one(spark, CF.normalize_company, name) == expected


@pytest.mark.parametrize("phone,expected", [
    ("+1 (555) 123-4567", "+15551234567"), ("555.123.4567", "5551234567"), ("", ""), (None, ""),
])
def test_clean_phone(spark, phone, expected):
    assert one(spark, CF.clean_phone, phone) == expected


@pytest.mark.parametrize("value,expected", [
    ("12", 12), (" 12 ", 12), ("-3", -3), ("+4", 4), ("1_000", 1000), ("3.7", 0), ("abc", 0),
    ("", 0), (None, 0), ("1__0", 0),
])
def test_safe_int(spark, value, expected):
    assert one(spark, CF.safe_int, value) == expected


def test_safe_str(spark):
    assert one(spark, CF.safe_str, "  hi ") == "hi"
    assert one(spark, CF.safe_str, None) == ""


def test_flatten_list(spark):
    df = spark.createDataFrame([(["a", "", None, "b"],), ([],), (None,)], "x array<string>")
    out = [r.y for r in df.select(CF.flatten_list("x").alias("y")).collect()]
    assert out == ["a, b", "", ""]


def test_json_path(spark):
    df = spark.createDataFrame([('{"person": {"name": "John"}}',), ('{"person": {}}',)], "x string")
    out = [r.y for r in df.select(CF.json_path("x", "person.name", "Unknown").alias("y")).collect()]
    assert out == ["John", "Unknown"]


def test_truncate(spark):
    df = spark.createDataFrame([("abcdef",), ("abc",)], "x string")
    out = [r.y for r in df.select(CF.truncate_text("x", 4).alias("y")).collect()]
    assert out == ["abcd\n[... truncated ...]", "abc"]


def test_utc_timestamp_format(spark):
    v = spark.range(1).select(CF.utc_now_text().alias("t")).first()["t"]
    import re

    assert re.match(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$", v)


@pytest.mark.parametrize("item,expected", [
    ({"firstName": "John", "lastName": "Doe", "organization": "Acme"}, ("John", "Doe", "Acme", None)),
    ({"name": "Jane Smith", "company": "Beta"}, ("Jane", "Smith", "Beta", None)),
    ({"name": "Madonna", "organization": "Music"}, ("Madonna", "", "Music", None)),
    ({"organisation": "Org"}, ("", "", "Org", None)),
    ({"company_name": "C"}, ("", "", "C", None)),
    ({}, ("", "", "", None)),
    ({"FirstName": " A ", "email": " a@b.com "}, ("A", "", "", "a@b.com")),
    ({"name": "  Ann   Lee  Jr ", "first_name": ""}, ("Ann", "Lee  Jr", "", None)),
])
def test_normalize_item(spark, item, expected):
    df = spark.createDataFrame([(item,)], "m map<string,string>")
    r = df.select(CF.normalize_item("m").alias("i")).first()["i"]
    assert (r.firstName, r.lastName, r.organization, r.email) == expected


def test_replies_of_the_primary_extractor_are_lists(spark):
    from contactlake.functions.json import reply_objects

    replies = ['[{"a": "1"}, 7]', '```json\n[{"a": "1"}]\n```', '{"result": [{"a": "1"}]}', '[{"a": "1"}] and more',
               '[{"a": "1"}], [2]', "[{'a': '1'}]", "no", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(replies)], "i int, t string")
    got = {r["i"]: (len(r["x"]), len(r["y"])) for r in
           df.select("i", reply_objects("t", False).alias("x"), reply_objects("t").alias("y")).collect()}
    assert got == {0: (1, 1), 1: (1, 1), 2: (0, 1), 3: (0, 0), 4: (0, 0), 5: (0, 0), 6: (0, 0), 7: (0, 0)}
