import pytest
from pyspark.sql import functions as F

from fieldloom.functions import text as X


def apply(spark, values, function):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v string").repartition(3)
    found = df.select("i", function(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(found)]


def test_amounts(spark):
    cases = {
        "$100,000": 100.0, "100k": 100000.0, "weekly 500": 500000.0, "1.234,56": 1.23456,
        "۱۲۳": 123.0, "": None, "1,5k": 1500.0, "5.": 5.0, "$100,000 - $130,000": None,
        "$100k-$130k": 100130000.0, "$120,000.00": 120000.0, "market": None, "85000": 85000.0,
        "40.000.000.0 to 70.000.000.0 IRR": None, ".": None, "1,234,567": None, None: None,
    }
    assert apply(spark, cases, X.normalize_amount) == list(cases.values())


def test_truncate(spark):
    cases = {
        "abcdefghi jklm": "abcdefghi...", "abcdefgh ijklm": "abcdefgh i...",
        "ab cdefghijklm": "ab cdefghi...", "abcdefghij": "abcdefghij",
        "é" * 12: "é" * 10 + "...", "": "",
    }
    assert apply(spark, cases, lambda v: X.truncate_text(v, 10)) == list(cases.values())


def test_clean_text(spark):
    cases = {
        " a \n\n b ": "a b", "a&nbsp;b": "a\u00a0b", "a\u00a0b": "a b", "a\x1cb": "a b",
        None: "", "&amp;amp;": "&amp;", "&nbsp; a": "a", "x & y": "x & y", "&copy;": "©",
    }
    assert apply(spark, cases, X.clean_text) == list(cases.values())


def test_urls(spark):
    cases = {
        "HTTPS://Me@Host.org:8080/a?b=linkedin.com": "me@host.org:8080", "no scheme": "",
        None: "unknown",
    }
    assert apply(spark, cases, X.url_authority) == list(cases.values())
    urls = ["https://www.linkedin.com/x", "https://a.org/?q=linkedin.com", None]
    assert apply(spark, urls, lambda v: X.host_contains(v, "linkedin.com")) == [True, False, False]


def test_previews_and_counts(spark):
    assert apply(spark, ["ab", "abcd"], lambda v: X.preview(v, 3)) == ["ab", "abc..."]
    assert apply(spark, ["", "abcdefgh", "abc"], X.estimate_tokens) == [0, 2, 0]
    assert apply(spark, ["well ok", "no"], X.reply_accepted) == [True, False]
    long = "x" * 101
    assert apply(spark, [long, " " * 200, None], X.is_substantial) == [True, False, False]


@pytest.mark.parametrize("text,number", [("1e3", 1000.0), (" 5 ", 5.0), ("1d", None), ("x", None)])
def test_to_number(spark, text, number):
    assert apply(spark, [text], X.to_number) == [number]


def test_url_id(spark):
    df = spark.createDataFrame([(7,), (1234,)], "n long")
    assert [r.u for r in df.select(X.url_id(F.col("n")).alias("u")).collect()] == [
        "url_007", "url_1234",
    ]
