"""Registered queries next to their SQL, and the URL filter's parts."""

import pytest

import __spark_entry__ as entry
import compare
from filespoor.llm import url_filter
from filespoor.llm.registry import CHECKS, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_check(spark, name):
    assert compare.compare(spark, compare.duck(FOLDER), name, FOLDER) is None


def test_all_registered():
    names = set(entry.queries())
    assert set(QUERIES) | {"pipeline"} <= names
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in QUERIES}


def test_url_filter(spark):
    urls = [
        (1, "http://A.Example.NET/en/x?q#f"), (2, "https://x.example.net/fr/"), (3, "https://example.com/de/1"), (4, "ftp://a.org/fr/"),
        (5, None), (6, ""), (7, "no scheme/x"), (8, "http://"), (9, "http://bad.com"), (10, "http://www.bad.com/"), (11, "http://bad.com/x?y"),
        (12, "http://notexample.com/de/"), (13, "http://host#x/y"), (14, "http://host?x/y"), (None, "http://bad.com/"), (9, "http://bad.com"),
    ]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in urls], "page_id long, url string, host string, block int")
    listed = spark.createDataFrame([("bad.com",), ("bad.com",), ("other.com/x",)], "canon string")
    found = sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, listed).collect())
    want = sorted([
        ("1", "a.example.net", "/en/x", "example.net/en/", "allow"), ("2", "x.example.net", "/fr/", "net/", "block"),
        ("3", "example.com", "/de/1", "example.com/de/", "block"), ("4", "a.org", "/fr/", "org/fr/", "allow"),
        ("5", "", "", None, "allow"), ("6", "", "", None, "allow"), ("7", "", "", None, "allow"), ("8", "", "", None, "allow"),
        ("9", "bad.com", "", None, "block"), ("9", "bad.com", "", None, "block"), ("10", "www.bad.com", "/", None, "block"),
        ("11", "bad.com", "/x", None, "allow"), ("12", "notexample.com", "/de/", None, "allow"), ("13", "host", "", None, "allow"),
        ("14", "host", "", None, "allow"), ("None", "bad.com", "/", None, "block"),
    ], key=str)
    assert sorted(found, key=str) == want
    assert url_filter.url_filter(pages, listed.limit(0)).filter("verdict = 'block'").count() == 2
    assert url_filter.url_filter(pages.limit(0), listed).count() == 0


def test_false_hits_of_the_filter_are_removed(spark):
    pages = spark.range(500).selectExpr("id page_id", "concat('http://h', id, '.com/') url")
    listed = spark.range(0, 500, 2).selectExpr("concat('h', id, '.com') canon")
    found = url_filter.url_filter(pages, listed, blocks=1)  # one full block: all pass it
    assert {(r.page_id % 2, r.verdict) for r in found.collect()} == {(0, "block"), (1, "allow")}
    assert url_filter.bloom(listed, 4).count() == 4
