import hashlib
import json

import pytest
from pyspark.sql import functions as F

from filespoor.functions import text, urls
from filespoor.functions.fingerprint import canonical, canonical_checksum, checksum, pack, raw_checksum
from filespoor.functions.html import page_signals


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lits(*values):
    return [F.lit(v) for v in values]


def test_checksum_vector(spark):
    want = "9538768a30827ed37a2ec380cc6db568"
    assert checksum(b"foobar123").hex() == want
    assert one(spark, F.lower(F.hex(raw_checksum(F.lit(b"foobar123"))))) == want
    assert checksum(b"foobar123") != hashlib.blake2b(b"foobar123", digest_size=16).digest()


@pytest.mark.parametrize("parts, want", [
    (("/asdf", "foo"), "/asdf/foo"),
    (("asdf", "foo"), "asdf/foo"),
    (("asdf", "/foo"), "asdf/foo"),
    (("asdf", "/foo", "/bar"), "asdf/foo/bar"),
    (("asdf", "foo", "/bar"), "asdf/foo/bar"),
    (("foo", "foo", "bar/", "/baz"), "foo/foo/bar/baz"),
    (("asdf", "/foo/"), "asdf/foo/"),
    (("asdf", "foo/", "/bar"), "asdf/foo/bar"),
    (("asdf", "/foo/", "/bar"), "asdf/foo/bar"),
])
def test_join_paths(spark, parts, want):
    assert one(spark, urls.join_paths(*lits(*parts))) == want


@pytest.mark.parametrize("parts, want", [
    (("https://foo/", "https://bar"), "https://bar/"),
    (("https://foo/", "https://bar", "baz"), "https://bar/baz"),
    # a path below a folder stays below it
    (("https://foo/bar", "/baz"), "https://foo/bar/baz"),
    (("https://foo/", "/bar", "baz"), "https://foo/bar/baz"),
    (("https://foo/", "/bar", "/baz"), "https://foo/bar/baz"),
    (("https://foo/", "bar", "..", "baz"), "https://foo/baz"),
    (("https://foo/", "bar/../baz"), "https://foo/baz"),
    (("https://foo",), "https://foo/"),
    (("https://foo/",), "https://foo/"),
    (("https://foo/", "bar/", "/baz"), "https://foo/bar/baz"),
    (("http://Foo:80/a/?q=1", "b.js?v=2"), "http://foo/a/b.js?v=2"),
    (("http://foo/", "//cdn/x.js"), "http://cdn/x.js"),
    (("http://foo/", "a/./b/"), "http://foo/a/b/"),
    (("http://foo/", "a/.."), "http://foo/"),
])
def test_join_url(spark, parts, want):
    assert one(spark, urls.join_url(*lits(*parts))) == want


def test_url_parts(spark):
    assert one(spark, urls.path(F.lit("http://h/a/b;p=1?x#y"))) == "/a/b"
    assert one(spark, urls.webroot_path(F.lit("http://h/a/b"))) == "a/b"
    assert one(spark, urls.webroot_path(F.lit("http://h/a/b"), strict=True)) == "/a/b"
    assert one(spark, urls.is_parsable(F.lit("http://[::1/x"))) is False


@pytest.mark.parametrize("name, index, analysis", [
    ("a.CSS", "css", "css"), ("index.html", "html", None), ("README", "extensionless", None),
    (".htaccess", "dotfile", "dotfile"), (".a.json", "json", "json"), (".x.html", "html", "dotfile"),
    ("x.tar", None, None), ("p.yml", "yaml", "yaml"), ("f.xap", "media", "media"), ("", "extensionless", None),
])
def test_file_type(spark, name, index, analysis):
    assert one(spark, text.file_type(F.lit(name))) == index
    assert one(spark, text.file_type(F.lit(name), analysis_only=True)) == analysis


def test_basename(spark):
    assert one(spark, text.basename(F.lit("http://h/a/b.js?x=1"))) == "b.js"
    assert one(spark, text.basename(F.lit("http://h/a.js?x=/y.css"))) == "y.css"


def test_natural_order(spark):
    names = ["v2", "1.10", "1.9.1", "1.9-rc1", "1.9"]
    df = spark.createDataFrame([(n,) for n in names], "n STRING")
    assert [r.n for r in df.orderBy(text.natural_key(F.col("n"))).collect()] == names[::-1]


def test_tag_names(spark):
    assert one(spark, text.dashed_tag_name(F.lit("TYPO3_6-2-1"))) == "typo3_6.2.1"
    assert one(spark, text.dashed_tag_name(F.lit("TYPO3_6-2-1rc1"))) == "typo3_6.2.1-rc1"
    assert text.java_regex(r"^v(?P<version_name>\d+)$") == (r"^v(\d+)$", 1)


def test_glob(spark):
    for name, glob, want in [("WordPress", "word*", True), ("Drupal", "d?upal", True), ("Drupal", "d[!r]*", False), ("xDrupal", "drupal", False)]:
        assert one(spark, F.rlike(F.lower(F.lit(name)), F.lit(text.glob_regex(glob)))) is want


def test_rule_pattern(spark):
    assert one(spark, text.clean_rule_pattern(F.lit(r"a;b\;version:\1"))) == "a;b"


def test_pack():
    assert pack([b"a", b"bc"]) == b"\x92\xa1a\xa2bc"
    assert pack(True) == b"\xc3" and pack(None) == b"\xc0" and pack(-1) == b"\xff" and pack(200) == b"\xcc\xc8"
    assert pack(-200) == b"\xd1\xff\x38" and pack(1.5)[:1] == b"\xcb" and pack(b"x" * 40)[:3] == b"\xda\x00\x28"
    with pytest.raises(TypeError):
        pack(object())


def test_canonical_is_order_insensitive():
    a = json.loads('{"a": [1, 2], "b": " x "}')
    b = json.loads('{"b":"x","a":[2,1]}')
    assert canonical(a) == canonical(b)
    assert canonical({"a": 1}) != canonical({"a": 1.0})


def test_canonical_checksum(spark):
    rows = [("json", b'{"a":1}'), ("json", b'{ "a" : 1 }'), ("json", b"{broken"), ("yaml", b"a: 1"), ("yaml", b"a: [")
            , ("css", b"x")]
    df = spark.createDataFrame(rows, "kind STRING, content BINARY")
    got = [r.c for r in df.select(canonical_checksum("kind", "content").alias("c")).collect()]
    assert got[0] == got[1] == got[3] and got[2] is None and got[4] is None and bytes(got[5]) == checksum(b"x")


def test_page_signals(spark):
    html = """<!-- <script src="no.js"> --><LINK href='a.css'><script src=b.js>"<link href=c.css>"</script>
    <meta name="generator" content="X &amp; Y"><a href="d.html">d</a><img src=e.png>"""
    df = spark.createDataFrame([(1, html), (2, None)], "site_id BIGINT, html STRING")
    rows = {r.site_id: r for r in page_signals(df, "site_id", "html", ("link", "script", "style")).collect()}
    assert rows[1].refs == ["a.css", "b.js"] and rows[1].script_srcs == ["b.js"]
    assert rows[1].metas[0].content == "X & Y" and rows[2].refs == []


def test_page_that_cannot_be_read_keeps_earlier_signals(spark):
    df = spark.createDataFrame([(1, "<link href=a.css><![foo[x]]><link href=b.css>")], "site_id BIGINT, html STRING")
    assert page_signals(df, "site_id", "html", ("link",)).first().refs[0] == "a.css"
