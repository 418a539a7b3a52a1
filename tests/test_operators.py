from collections import Counter

import pytest
from pyspark.sql import functions as F

from filespoor import schema
from filespoor.operators import build, delta, entropy, index, matching, recency, scoring, signals
from filespoor.operators.skew import salted_join
from filespoor.params import InferenceParams
from filespoor.session import Workspace

PACKAGES = [(1, "Alpha", "A", ["Al", "alf"]), (2, "Beta", "B", []), (3, "Gam%a", "C", [])]
VERSIONS = [
    (11, 1, "1.9"), (12, 1, "1.9-rc1"), (13, 1, "1.9.1"), (14, 1, "1.10"),
    (21, 2, "1.0"), (22, 2, "2.0"), (31, 3, "1.0"), (32, 3, "2.0"),
]
USES = [(v, f"common.js", "c0") for v, _, _ in VERSIONS] + [
    (11, "a.css", "a1"), (12, "a.css", "a2"), (13, "a.css", "a3"), (14, "a.css", "a3"),
    (11, "only.txt", "u1"), (21, "b.css", "b1"), (22, "b.css", "b1"), (31, "g.css", "g1"), (32, "h.css", "g1"),
]


@pytest.fixture(scope="module")
def toy(spark):
    packages = spark.createDataFrame(PACKAGES, "package_id BIGINT, name STRING, vendor STRING, alternative_names ARRAY<STRING>")
    versions = spark.createDataFrame(
        [(v, p, n, f"id{v}", 1_000_000 + (v // 2) * 86400, v != 32) for v, p, n in VERSIONS],
        "version_id BIGINT, package_id BIGINT, name STRING, internal_identifier STRING, t BIGINT, i BOOLEAN",
    ).select("version_id", "package_id", "name", "internal_identifier", F.timestamp_seconds("t").alias("release_date"),
             F.when(F.col("i"), F.timestamp_seconds(F.lit(0))).alias("indexed"))
    used = spark.createDataFrame(USES, "version_id BIGINT, webroot_path STRING, checksum STRING")
    return packages, versions, used


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.createDataFrame([(k if k else None, i) for i, k in enumerate([1] * 40 + [2] * 3 + [3, 0, 0, 4])], "k INT, i INT")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (3, "d"), (5, "e")], "k INT, v STRING")
    plain = Counter(left.join(right, "k", how).collect())
    assert plain == Counter(salted_join(left, right, ["k"], how, hot_rows=5, salts=4).collect())


def assets(spark, n=30):
    rows = []
    for site in range(n):
        rows += [(site, "common.js", True, "c0"), (site, "a.css", True, f"a{site % 4}"), (site, "b.css", site % 2 == 0, "b1"),
                 (site, f"own{site}.txt", True, "u1" if site % 3 == 0 else f"own{site}"), (site, "g.css", True, f"x{site}")]
    rows += [(0, f"p{i}.js", True, f"a{i % 4}") for i in range(50)]
    rows = [(s, p, ok, c if ok else None) for s, p, ok, c in rows]
    return spark.createDataFrame(rows, "site_id INT, webroot_path STRING, success BOOLEAN, checksum STRING"), rows


def test_scores_by_brute_force_with_and_without_hot_keys(spark, toy):
    _, versions, used = toy
    by_checksum, by_path = index.checksum_versions(used), index.path_versions(used)
    idf = index.idf_weights(by_checksum, versions)
    observed, rows = assets(spark)
    weight = {r.checksum: r.weight_micro for r in idf.collect()}
    want = Counter()
    for site, path, ok, checksum in rows:
        using = {v for v, _, c in USES if ok and c == checksum}
        expected = {v for v, p, _ in USES if p == path}
        w = weight.get(checksum, 1_000_000) if ok else 1_000_000
        for v in using | expected:
            want[site, v, "pos" if v in using else "neg"] += w
            want[site, v, "n_pos" if v in using else "n_neg"] += 1
    for hot_rows in (3, 1_000_000):
        weighted = matching.weigh_assets(observed, idf, hot_rows=hot_rows)
        got = Counter()
        for r in scoring.site_scores(weighted, matching.pack_index(by_checksum, by_path), hot_rows).collect():
            for key, value in (("pos", r.pos_micro), ("neg", r.neg_micro), ("n_pos", r.n_pos), ("n_neg", r.n_neg)):
                got[r.site_id, r.version_id, key] += value
        assert +got == +want
    kinds = matching.kind_matches(matching.asset_kinds(observed), by_checksum, by_path)
    total = kinds.join(matching.content_key(observed), ["webroot_path", "checksum"]).count()
    assert total == sum(v for (_, _, k), v in want.items() if k.startswith("n_"))


def test_idf(toy):
    _, versions, used = toy
    weights = {r.checksum: r.weight_micro for r in index.idf_weights(index.checksum_versions(used), versions).collect()}
    assert weights["c0"] == 0 and weights["u1"] == 903090 and weights["a3"] == 602060


def test_unique_files_are_almost_unique(toy):
    _, _, used = toy
    uses = used.select("version_id", F.concat_ws(":", "webroot_path", "checksum").alias("file_id"))
    unique = {tuple(r) for r in index.unique_files(uses).collect()}
    almost = {(r.version_id, r.file_id) for r in index.almost_unique_files(uses, 2).collect()}
    assert (11, "only.txt:u1") in unique and unique < almost and (21, "b.css:b1") in almost


def test_path_entropy(toy):
    _, versions, used = toy
    sets = versions.select(F.col("package_id").alias("set_id"), "version_id")
    rows = {(r.set_id, r.webroot_path): (r.version_count, r.checksum_count) for r in entropy.path_entropy(sets, index.path_checksums(used)).collect()}
    assert rows == {(1, "a.css"): (4, 3), (1, "only.txt"): (1, 1), (3, "g.css"): (1, 1), (3, "h.css"): (1, 1)}


def test_delta(spark, toy):
    _, versions, used = toy
    at_path = delta.files_at_path(used.withColumn("src_path", F.concat(F.lit("s/"), "webroot_path")))
    pairs = [(11, 12), (12, 11), (11, 11), (13, 14), (11, 21)]
    rows = delta.version_delta(spark.createDataFrame(pairs, "old_version_id BIGINT, new_version_id BIGINT"), at_path).collect()
    found = {p: sorted((r.change, r.webroot_path) for r in rows if (r.old_version_id, r.new_version_id) == p) for p in pairs}
    assert found[11, 12] == [("changed", "a.css"), ("deleted", "only.txt")]
    assert found[12, 11] == [("changed", "a.css"), ("created", "only.txt")]
    assert found[11, 11] == found[13, 14] == []
    assert found[11, 21] == [("created", "b.css"), ("deleted", "a.css"), ("deleted", "only.txt")]
    order = [(r.old_version_id, r.new_version_id) for r in delta.previous_versions(versions).filter("package_id = 1").collect()]
    assert sorted(order) == [(11, 12), (12, 13), (13, 14)]


def test_best_guesses_cut(spark):
    def run(rows):
        df = spark.createDataFrame(rows, "site_id INT, version_id INT, pos_micro BIGINT, neg_micro BIGINT, n_pos BIGINT, n_neg BIGINT")
        return [r.version_id for r in scoring.best_guesses(scoring.with_strength(df)).orderBy("rank").collect()]

    million = 1_000_000
    assert run([(1, 1, 20 * million, 0, 1, 0), (1, 2, 14 * million, 0, 1, 0), (1, 3, 13 * million, 0, 1, 0)]) == [1, 2]
    assert run([(1, 1, 5 * million, 0, 1, 0), (1, 2, 2 * million, 0, 1, 0), (1, 3, million, 0, 1, 0)]) == [1, 2]
    # too little positive evidence: no cut, but at most seven
    assert run([(1, v, million // v, 30 * million // v, 1, 1) for v in range(1, 10)]) == [1, 2, 3, 4, 5, 6, 7]


def test_decisiveness_support_and_ties(spark):
    g = spark.createDataFrame([(1, 5, 0, 0), (1, 6, 1, 4 * 10**9), (2, 7, 1, 3 * 10**9), (3, 8, 1, 12 * 10**9), (3, 9, 2, 12 * 10**9), (3, 1, 3, 9 * 10**9)],
                              "site_id INT, version_id INT, rank INT, strength_nano BIGINT")
    assert {r.site_id: r.decisiveness for r in scoring.decisiveness(g).collect()} == {1: -2.0, 2: 3.0, 3: 1.0}
    counts = spark.createDataFrame([(1, 4), (2, 10), (3, 30)], "site_id INT, n_assets BIGINT")
    rated = {r.site_id: (r.support, r.enough) for r in scoring.support(g, counts).collect()}
    assert rated == {1: (0.0, False), 2: (0.3, False), 3: (0.4, True)}
    tied = {(r.site_id, r.version_id) for r in scoring.best_tie_group(g).collect()}
    assert tied == {(1, 5), (2, 7), (3, 8), (3, 9)}


def test_base_path(spark, toy):
    _, _, used = toy
    files = used.select("webroot_path", "checksum")
    seen = spark.createDataFrame(
        [(1, "shop/a.css", True, "a1"), (1, "shop/b.css", True, "b1"), (1, "x/only.txt", True, "u1"), (2, "a.css", True, "a1"), (3, "css", True, "a1")],
        "site_id INT, webroot_path STRING, success BOOLEAN, checksum STRING")
    for hot_rows in (1, 1000):
        votes = matching.base_path_votes(seen, files, hot_rows)
        assert {(r.site_id, r.base_path) for r in matching.updated_base_path(votes).collect()} == {(1, "/shop/"), (3, "a.")}


def test_file_ids_stay_distinct(spark):
    key = (b"\x01" * 16)
    new = spark.createDataFrame([("s", "w", key), ("s", "w", key), ("t", "w", key)], "src_path STRING, webroot_path STRING, checksum BINARY")
    taken = new.filter("src_path = 's'").select(F.xxhash64(*build.FILE_KEY).alias("h")).first().h
    old = spark.createDataFrame([(taken, "other", "w", key), (5, "t", "w", key)], "file_id BIGINT, src_path STRING, webroot_path STRING, checksum BINARY")
    ids = {r.src_path: r.file_id for r in build.static_files_dim(old, new).collect()}
    assert ids["other"] == taken and ids["t"] == 5 and len(set(ids.values())) == 3


def test_file_ids_that_meet_again_and_again_stay_distinct(spark):
    """A hash of 8 bits for up to 200 files: many meet, more than once; old ids stay."""
    def short(attempt):
        return F.xxhash64(*build.FILE_KEY, F.lit(attempt)) % 128 + 128

    rows = [(f"s{i}", f"w{i % 7}", bytes([i % 256])) for i in range(200)]
    schema = "src_path STRING, webroot_path STRING, checksum BINARY"
    space = Workspace(spark, "ids")
    old = space.save(build.static_files_dim(None, spark.createDataFrame(rows[:120] * 2, schema), space.save, short), "old")
    new = build.static_files_dim(old, spark.createDataFrame(rows[60:], schema), space.save, short)
    before = {r.src_path: r.file_id for r in old.collect()}
    after = {r.src_path: r.file_id for r in new.collect()}
    assert len(before) == len(set(before.values())) == 120
    assert len(after) == len(set(after.values())) == new.count() == 200
    assert before == {k: after[k] for k in before}


def test_upsert_policies(spark, toy):
    _, versions, _ = toy
    incoming = spark.createDataFrame([(1, "id11", "new", 5), (2, "idX", "fresh", 6)], "package_id BIGINT, internal_identifier STRING, name STRING, t BIGINT").select(
        "package_id", "internal_identifier", "name", F.timestamp_seconds("t").alias("release_date"))
    for policy, name, moved in (("update_all", "new", True), ("name_only", "new", False), ("ignore", "1.9", False)):
        rows = {r.internal_identifier: r for r in build.upsert_versions(versions, incoming, policy).collect()}
        assert len(rows) == 9 and rows["id11"].name == name and rows["id11"].version_id == 11
        assert (rows["id11"].release_date.year == 1970 and rows["id11"].release_date.second == 5) is moved
        assert rows["idX"].name == "fresh" and rows["idX"].indexed is None


def test_fingerprint_files(spark):
    rows = [(1, "a.json", b"{broken", "a.json"), (1, ".a.json", b"{broken", ".a.json"), (1, "b.json", b"[2,1]", "b.json"),
            (1, "c.json", b"[1, 2]", "c.json"), (1, "d.tar", b"x", "d.tar")]
    placed = spark.createDataFrame(rows, "version_id BIGINT, src_path STRING, content BINARY, file_name STRING").withColumn("webroot_path", F.col("src_path"))
    got = {r.src_path: r for r in build.fingerprint_files(placed).collect()}
    assert set(got) == {".a.json", "b.json", "c.json"} and got["b.json"].checksum == got["c.json"].checksum
    assert got[".a.json"].file_type == "dotfile"
    assert got["b.json"].checksum != {r.src_path: r for r in build.fingerprint_files(placed, raw=True).collect()}["b.json"].checksum


def test_names_and_generator(spark, toy):
    packages, versions, _ = toy
    texts = spark.createDataFrame(
        [(1, "alpha 1.9"), (2, "Alpha 7"), (3, "beta"), (4, "Al 1.9"), (5, "%eta 2"), (6, "gam%a\\x"), (7, "Gam%a 1.0 x"), (8, "_lpha RC1")],
        "site_id INT, generator STRING")
    got = {}
    for r in signals.generator_versions(texts, packages, versions).collect():
        got.setdefault(r.site_id, set()).add(r.version_id)
    assert got == {1: {11, 12, 13}, 2: {11, 12, 13, 14}, 3: {21, 22}, 5: {22}, 7: {31}, 8: {12}}
    assert [r.package_id for r in signals.packages_by_glob(packages, "al*", any_name=True).collect()] == [1]
    assert recency.most_recent(versions, "package_id").filter("package_id = 1").first().version_id == 14


def test_generator_needs_exactly_one_tag(spark):
    m = "site_id INT, metas ARRAY<STRUCT<name: STRING, content: STRING>>"
    df = spark.createDataFrame([(1, [("generator", "x")]), (2, [("generator", "x"), ("generator", "y")]), (3, [("generator", "")]), (4, [("a", "b")])], m)
    assert [r.site_id for r in signals.generator_texts(df).collect()] == [1]


def test_rules(spark):
    rules = spark.createDataFrame(
        [("H", "headers", "X-By", "php"), ("M", "meta", "generator", r"word\;version:\1"), ("T", "html", None, "<b>\\s*hi"), ("S", "script", None, "jq.*\\.js$"), ("N", "html", None, "absent"),
         ("BAD", "html", None, "(unclosed"), ("BAD", "headers", "X-By", "[z-a]")],
        "app STRING, kind STRING, field STRING, pattern STRING")
    pages = spark.createDataFrame(
        [(1, "<B> HI", [("x-by", "PHP/7")], [("Generator", "Wordy")], ["/jquery.JS"]), (2, "none", [("x-by", "no php")], [("generator", "a word")], [])],
        "site_id INT, html STRING, headers ARRAY<STRUCT<name: STRING, value: STRING>>, metas ARRAY<STRUCT<name: STRING, content: STRING>>, script_srcs ARRAY<STRING>")
    assert {(r.site_id, r.app) for r in signals.tech_rule_match(pages, rules).collect()} == {(1, a) for a in "HMTS"}
    assert sorted(signals.invalid_patterns(spark, ["a+", "(unclosed", "[z-a]"])) == ["(unclosed", "[z-a]"]


PATTERNS = [
    "wp-content", "Powered by (?:Foo|Bar)", "foo|barbaz", "colou?rful", "abc{0,2}defg", r"min\.js", "a+?bcde", "[a-f]xyzzy", "(?i)quux",
    "x{2}yyyy", "((a(b|c))d)?tail", "gen(?=erator)", r"\d+ items", "<link[^>]+href=\"shop", "z", "", "^start", "end$", "(((((deep)))))", "tail(?!or)",
    "\u00e4\u00f6plain", "line\nbreak", "(?<name>v)ersion", "k(?:elvin)", r"\x41bcd", "no*ne",
]


def test_rules_found_by_text_equal_all_rules_on_all_pages(spark, monkeypatch):
    monkeypatch.setattr(signals, "STRETCH", 7)  # pieces across stretches
    pages = [
        "see WP-Content here", "powered BY bar", "barbaz", "colorful and Colourful", "abdefg ABCDEFG", "jquery.MIN.js", "aabcde", "Fxyzzy", "QUUX",
        "xxyyyy", "tail tailor", "the generator", "12 items", "<LINK rel=x href=\"shop/1", "start", "the end", "deep", "", "\u00c4\u00f6plain", "\u00e4\u00f6plain", "line\nbreak",
        "version", "\u212aelvin", "Abcd", "nne", None,
    ]
    rows = [(i, p, None, None, ["x", p] if i % 2 else None) for i, p in enumerate(pages)]
    shown = spark.createDataFrame(rows, "site_id INT, html STRING, headers ARRAY<STRUCT<name: STRING, value: STRING>>, "
                                  "metas ARRAY<STRUCT<name: STRING, content: STRING>>, script_srcs ARRAY<STRING>")
    listed = [(f"{kind}{i}", kind, None, p) for i, p in enumerate([*PATTERNS, "(bad", "[z-a]"]) for kind in ("html", "script")]
    rules = spark.createDataFrame(listed, schema.TECH_RULE)
    got = {tuple(r) for r in signals.tech_rule_match(shown, rules).collect()}
    good = rules.filter(signals.compiles(F.col("pattern"))).withColumn("regex", F.concat(F.lit("(?i)"), "pattern"))
    assert good.count() == 2 * len(PATTERNS)
    all_pairs = shown.crossJoin(good).where(
        "(kind = 'html' AND html RLIKE regex) OR (kind = 'script' AND exists(script_srcs, x -> x RLIKE regex))")
    assert got == {tuple(r) for r in all_pairs.select("site_id", "app").collect()}
    literals = spark.createDataFrame([(p,) for p in PATTERNS], "pattern STRING").select(signals.required_literal(F.col("pattern")))
    found = dict(zip(PATTERNS, (r[0] for r in literals.collect())))
    assert found["wp-content"] == "wp-content" and found["Powered by (?:Foo|Bar)"] == "powered by " and found["colou?rful"] == "rful"
    assert found["foo|barbaz"] == found["(?i)quux"] == found[PATTERNS[24]] == ""


def test_included_assets(spark):
    refs = ["a.css", "/b.js?v=1", "ftp://x/c.js", "http://cdn/d.png", "page.html", "README", "http://[bad/e.js", "a.css"]
    df = spark.createDataFrame([(1, "http://h/sub/", refs)], "site_id INT, url STRING, refs ARRAY<STRING>")
    got = {r.url for r in signals.included_assets(df, F.col("url")).collect()}
    assert got == {"http://h/sub/a.css", "http://h/sub/b.js?v=1", "http://cdn/d.png"}


def test_probe_prefix(spark):
    df = spark.createDataFrame([(1, r, f) for r, f in enumerate([False, True, False, True, False, True])] + [(2, 1, False)], "site_id INT, rank INT, found BOOLEAN")
    got = sorted((r.site_id, r.rank) for r in scoring.probe_prefix(df, 2).collect())
    assert got == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 1)]


def test_weights_can_be_set():
    assert InferenceParams(negative_match_weight=0.25).negative_milli == 250
