"""Findings of round 3: shared names, tables in folders, large indexes."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from filespoor.operators import entropy, matching, reports, scoring, signals, version_sets
from filespoor.operators.skew import expanding_join
from filespoor.params import InferenceParams
from filespoor.plans import compare, infer
from filespoor.session import Workspace
from filespoor.world import index_queries, report_queries
from filespoor.world.views import World
from test_version_sets import brute, world


def test_compare_releases_of_one_name(spark, tmp_path):
    """Two releases of the package have the name of its first one."""
    save = lambda rows, kind, name: spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    save([(0, "EUROPE")], "r_regionkey int, r_name string", "region")
    save([(1, "FRANCE", 0)], "n_nationkey int, n_name string, n_regionkey int", "nation")
    # 3 and 3003 have one name and date
    save([(3, "s", 1, 120.0), (3003, "s", 1, 150.0), (4, "s", 1, 20.0)],
         "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double", "supplier")
    save([(1, "one", "b", "t", 1), (2, "two", "b", "t", 1), (3, "three", "b", "u", 2)],
         "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int", "part")
    save([(3, 1), (3003, 2), (4, 2), (4, 3)], "l_suppkey bigint, l_partkey bigint", "lineitem")
    world = World(spark, str(tmp_path))
    named = world.versions.filter("name = '0.1'")
    assert named.count() == 2
    rows = {tuple(r) for r in index_queries.compare_versions(world).collect()}
    assert rows == {("t/1/b", "b/one -> b/two"), ("u/2/b", "newly created: b/three")}
    with pytest.raises(ValueError):  # a name alone has to be that of one release
        compare.compare_versions(world.index, world.used_files, "FRANCE", "0.1", "1.0")


def test_stream_of_a_table_in_a_folder(spark, tmp_path):
    rows = [(0, "x", "en", "s1"), (1, "x", "en", "s1"), (25, "y", "en", "s1"), (40, "z", "fr", "s2")]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    documents.repartition(3).write.parquet(f"{tmp_path}/many/documents.parquet")
    documents.coalesce(1).write.parquet(f"{tmp_path}/out")
    (tmp_path / "one").mkdir()
    next((tmp_path / "out").glob("part-*")).rename(tmp_path / "one/documents.parquet")
    for folder in ("many", "one"):
        found = report_queries.incremental_index(World(spark, f"{tmp_path}/{folder}"))
        assert {tuple(r) for r in found.collect()} == {(1, 2, 2), (1002, 1, 1)}


@pytest.mark.parametrize("share", [10**6, 40])
def test_scores_by_blocks(spark, monkeypatch, share):
    """Lists beyond a broadcast reach each block of sites once; a site's sums stay narrow, also over shares of the versions."""
    monkeypatch.setattr(version_sets, "BROADCAST_ENTRIES", 0)
    monkeypatch.setattr(version_sets, "BLOCK_ENTRIES", share)
    users, paths, assets = world(5)
    space = Workspace(spark, "blocks")
    frame = spark.createDataFrame(assets, "site_id long, webroot_path string, success boolean, checksum string, found boolean, weight_micro long")
    by_checksum = spark.createDataFrame([(c, v * 2**50) for c, vs in users.items() for v in vs], "checksum string, version_id long")
    by_path = spark.createDataFrame([(p, v * 2**50) for p, vs in paths.items() for v in vs], "webroot_path string, version_id long")
    packed = version_sets.intern(by_checksum, by_path, space.save)
    sums, others = version_sets.set_sums(frame, packed, save=space.save)
    dealt, shares = version_sets.blocks(sums, packed, others)
    assert (shares > 1) == (share == 40)
    # no list stands on a row of sums, and a block has each set once for a share
    assert dealt.filter("versions is not null and site_id is not null").isEmpty()
    assert dealt.filter("versions is not null").groupBy("_part", "set_id").count().filter("count > 1").isEmpty()
    want = brute(users, paths, assets)
    got = {(r.site_id, r.version_id // 2**50): tuple(r[n] for n in version_sets.SCORES) for r in version_sets.block_scores(dealt).collect()}
    assert got == want
    params = InferenceParams()
    best = {}
    for (site, v), (pos, neg, *_) in want.items():
        best.setdefault(site, []).append((-(pos * params.positive_milli + neg * params.negative_milli), v))
    want_top = sorted((site, v, -s, *want[site, v]) for site, x in best.items() for s, v in sorted(x)[:params.guess_limit])
    top = scoring.strongest(sums, packed, others, params)
    rows = [(r.site_id, r.version_id // 2**50, r.strength_nano, *(r[n] for n in version_sets.SCORES)) for r in top.collect()]
    assert sorted(rows) == want_top


def test_strongest_of_a_block_equals_all_sums():
    """Lists that are only looked up change nothing, whatever the gains."""
    rng = np.random.default_rng(4)
    lists = [np.unique(rng.integers(0, 400, n)) for n in rng.integers(1, 120, 60)]
    block = version_sets._Block([pa.array(map(str, range(60)))], [pa.array(lists, pa.list_(pa.int64()))])
    for turn in range(600):
        chosen = rng.choice(60, rng.integers(1, 9), replace=False)
        high = (3, 100, 10_000)[turn % 3]
        gains = [int(g) if rng.random() < 0.5 else int(g) * 10 for g in rng.integers(-5 if turn % 10 == 0 else 0, high, len(chosen))]
        total = {}
        for k, gain in zip(chosen, gains):
            for v in lists[k]:
                total[int(v)] = total.get(int(v), 0) + gain
        want = sorted(total, key=lambda v: (-total[v], v))[:7]
        assert block.versions[block.strongest([block.list_of(k) for k in chosen], gains, 7)].tolist() == want
        assert not block.sum.any()


@pytest.mark.parametrize("listed", [1000, 1])
def test_excluded_paths_meet_lists(spark, listed):
    """Paths that are dealt by site are neither shuffled nor sorted, also where some sites have seen too much for a list."""
    rows = [(1, "a"), (1, "b"), (1, None), (2, "a"), (2, "a"), (3, "c"), (None, "a")]
    paths = spark.createDataFrame(rows, "site_id long, webroot_path string").repartition(4, "site_id")
    seen = spark.createDataFrame([(1, "a"), (1, "c"), (2, "b"), (2, None), (None, "a"), (1, "a")], "site_id long, webroot_path string")
    left = entropy.exclude_paths(paths, seen, "site_id", listed)
    want = paths.join(seen.distinct(), ["site_id", "webroot_path"], "left_anti")
    key = lambda x: sorted(map(repr, x.collect()))
    assert key(left) == key(want) and left.columns == want.columns
    plan = entropy.exclude_paths(paths, seen, "site_id")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan


def test_matches_of_kinds_are_not_shuffled(spark):
    """Versions are given out from lists: no shuffle has a row per kind and version."""
    kinds = spark.createDataFrame([("p", "x", True), ("p", "", False), ("q", "y", True), (None, "x", True), ("r", "z", True)],
                                  "webroot_path string, checksum string, success boolean")
    by_checksum = spark.createDataFrame([("x", 1), ("x", 2), ("x", None), ("", 9), ("y", 3)], "checksum string, version_id long")
    by_path = spark.createDataFrame([("p", 2), ("p", 4), ("p", None), ("q", 3)], "webroot_path string, version_id long")
    found = matching.kind_matches(kinds, by_checksum, by_path)
    assert {tuple(r) for r in found.collect()} == {
        ("p", "x", 1, True), ("p", "x", 2, True), ("p", "x", None, True), ("p", "x", 4, False), ("p", "", 2, False), ("p", "", 4, False),
        ("p", "", None, False), ("q", "y", 3, True), (None, "x", 1, True), (None, "x", 2, True), (None, "x", None, True),
    }
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.strip().startswith(("Generate", "Project")) and "explode(versions" in plan.split("Join")[0]


def test_estimates_are_made_distinct_before_they_are_many(spark):
    """Only versions of several packages and sites with several texts need an aggregation over sites and versions."""
    packages = spark.createDataFrame([(1, "a", ["x"]), (2, "b", ["x"]), (3, "c", None)], "package_id long, name string, alternative_names array<string>")
    versions = spark.createDataFrame(
        [(1, 10, "1.0", 1), (1, 10, "1.0", 1), (1, 11, "1.1", 1), (2, 10, "1.0", 1), (2, 20, "2.0", 1), (3, 30, "3", 1), (3, 31, "4", None)],
        "package_id long, version_id long, name string, indexed int")
    matches = spark.createDataFrame([(7, "X"), (7, "a"), (8, "c"), (8, "c"), (9, "none")], "site_id long, app string")
    found = signals.rule_versions(matches, packages, versions)
    assert sorted(tuple(r) for r in found.collect()) == [(7, 10), (7, 11), (7, 20), (8, 30)]
    texts = spark.createDataFrame([(7, "a 1.0"), (7, "a"), (7, "a"), (8, "b"), (8, "b"), (9, "c 9")], "site_id long, generator string")
    named = signals.generator_versions(texts, packages, versions)
    assert sorted(tuple(r) for r in named.collect()) == [(7, 10), (7, 11), (8, 10), (8, 20), (9, 30)]
    for rows in (found, named):
        union = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert union[0].startswith("Union") and union[1].strip(" :+-").startswith("Project")


def test_strongest_paths_equal_path_entropy(spark, monkeypatch):
    """Blocks of sets give the first paths of each, as a row for each set and file does; over shares of the paths too."""
    rng = np.random.default_rng(7)
    rows = {(int(v), f"p{p:02d}" if p else None, f"c{c}" if c else None) for v, p, c in rng.integers(0, (9, 30, 4), (400, 3))}
    by_path = spark.createDataFrame(sorted(rows, key=repr), "version_id long, webroot_path string, checksum string")
    chosen = {f"s{k}": sorted({int(v) for v in rng.integers(0, 11, rng.integers(1, 7))}) for k in range(40)} | {"none": [99], "one": [3]}
    members = spark.createDataFrame([(s, v) for s, vs in chosen.items() for v in vs], "set_id string, version_id long")
    want = entropy.rank_paths(entropy.path_entropy(members, by_path)).collect()
    for share in (10**6, 50):
        monkeypatch.setattr(entropy, "BLOCK_FILES", share)
        for depth in (1, 5, 1000):
            sets = spark.createDataFrame([(s, vs, depth) for s, vs in chosen.items()], "set_id string, versions array<long>, depth int")
            found = entropy.strongest_paths(sets, entropy.version_paths(by_path))
            assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
            got = entropy.rank_paths(found).filter(f"rank <= {depth}")
            assert sorted(map(repr, got.select(*want[0].asDict()).collect())) == sorted(repr(r) for r in want if r["rank"] <= depth)


def test_ranks_of_a_long_list(spark):
    """Ranges of paths are numbered one after the other, so no task sorts a whole set."""
    rows = [(0, f"p{k % 501}", k % 7, k % 3) for k in range(501)] + [(1, "x", 1, 1), (1, None, 1, 1), (1, "y", 2, 5)]
    paths = spark.createDataFrame(rows, "set_id int, webroot_path string, version_count long, checksum_count long")
    found = entropy.rank_long(paths, Workspace(spark, "ranges").save)
    assert found.schema == entropy.rank_paths(paths).schema
    assert sorted(map(repr, found.collect())) == sorted(map(repr, entropy.rank_paths(paths).collect()))
    assert "[set_id#" not in "".join(x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Window [row_number" in x and "_range" not in x)


@pytest.mark.parametrize("listed", [1000, 1])
def test_all_paths_of_a_site(spark, listed):
    """A site's ranks come from those of its versions less the paths it has seen; no window or shuffle has a row for each site and path."""
    by_path = spark.createDataFrame([(v, f"p{p}", f"c{(v * p) % 3}") for v in range(4) for p in range(9)], "version_id long, webroot_path string, checksum string")
    guesses = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 0), (2, 0), (3, 2), (4, 9)], "site_id long, version_id long")
    seen = spark.createDataFrame([(1, "p3"), (1, "p3"), (1, "p8"), (1, "other"), (2, None), (3, "p0"), (5, "p1")], "site_id long, webroot_path string")
    sites = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e"), (5, "f")], "site_id long, base_url string")

    class Tables:
        path_checksums = by_path

    found = infer.all_candidate_paths(sites, guesses, seen, Tables, listed=listed)
    sets = guesses.distinct().withColumnRenamed("site_id", "set_id")
    all_paths = entropy.path_entropy(sets, by_path).withColumnRenamed("set_id", "site_id")
    unseen = all_paths.join(seen.distinct(), ["site_id", "webroot_path"], "left_anti").withColumnRenamed("site_id", "set_id")
    want = sites.join(entropy.rank_paths(unseen).withColumnRenamed("set_id", "site_id"), "site_id").select(*found.columns)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect())) and found.schema["rank"].dataType == want.schema["rank"].dataType


def test_responses_that_are_asked_for(spark):
    """Only responses of wanted addresses get weights, by hash or not."""
    served = spark.createDataFrame([("a", True, "x"), ("b", True, "y"), ("a", True, "z"), (None, True, "x")], "url string, success boolean, checksum string")
    idf = spark.createDataFrame([("x", 5)], "checksum string, weight_micro long")
    wanted = spark.createDataFrame([(1, "a"), (2, "a"), (3, "c")], "site_id long, url string")
    for asked in (10, 0):
        found = infer.asked_responses(wanted, served, idf, asked)
        assert sorted((r.url, r.checksum, r.found) for r in found.collect()) == [("a", "x", True), ("a", "z", False)]


def test_expanding_join_uses_many_tasks(spark):
    """Few rows that make many are not put together in one task."""
    left = spark.createDataFrame([(k, k % 2) for k in range(400)], "site long, key int").unionByName(spark.createDataFrame([(1, None)], "site long, key int"))
    right = spark.createDataFrame([(k % 3, k) for k in range(30)], "key int, path int")
    found = expanding_join(left, right, ["key"], 10)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, left.join(right, "key").collect()))
    assert found.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 1


def test_flags_of_results_without_rows_of_versions(spark):
    """Flags are those of all versions of a result, of which no shuffle has a row; versions of several names come once."""
    packages = spark.createDataFrame([(1, "a", ["x"]), (2, "b", ["x"])], "package_id long, name string, alternative_names array<string>")
    versions = spark.createDataFrame(
        [(1, 10, "1.0", 1, 5), (1, 11, "1.0", 9, 5), (1, 12, "2.0", 3, 5), (2, 20, "1.0", 9, 5), (2, 21, "1.0", 2, None), (2, None, "3", 1, 5)],
        "package_id long, version_id long, name string, release_date int, indexed int")
    vulnerable = spark.createDataFrame([("c", 11), ("c", 12)], "cve_id string, version_id long")
    rows = [("u", 0, "A", "1.0"), ("u", 1, "a", "1.0"), ("u", 2, "x", "1.0"), ("v", 0, "a", "2.0"), ("w", 0, "q", "1"), ("w", 1, None, "1"), ("y", 0, "b", "3"), (None, 0, "a", "1.0")]
    guesses = spark.createDataFrame(rows, "url string, position int, package_name string, version_name string")
    found = reports.result_versions(guesses, packages, versions)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, [
        ("u", 10), ("u", 11), ("u", 20), ("v", 12), ("y", None), (None, 10), (None, 11)]))
    flags = reports.vulnerability_by_url(guesses, packages, versions, vulnerable)
    assert {tuple(r) for r in flags.collect()} == {
        ("u", "A", False, False, True), ("v", "a", True, True, True), ("w", "q", False, True, False), ("y", "b", False, True, False),
        (None, "a", False, True, False)}
    plan = flags._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate [url" in x and "version_id" in x for x in plan.splitlines())


@pytest.mark.parametrize("sent", [100, 0])
def test_pieces_of_pages_are_not_shuffled(spark, monkeypatch, sent):
    """With a catalogue of usual size only the pieces that a rule has leave the task of their page."""
    monkeypatch.setattr(signals, "BROADCAST_RULES", sent)
    kind = "array<struct<name:string,value:string>>"
    pages = spark.createDataFrame([(1, "an Alpha page", None, None, ["x.js"]), (2, "none", None, None, None), (None, "alpha", None, None, None)],
                                  f"site_id long, html string, headers {kind}, metas array<struct<name:string,content:string>>, script_srcs array<string>")
    rules = spark.createDataFrame([("a", "html", None, "alpha"), ("j", "script", None, "\\.js$"), ("n", "html", None, None)],
                                  "app string, kind string, field string, pattern string")
    found = signals.tech_rule_match(pages, rules)
    assert {tuple(r) for r in found.collect()} == {(1, "a"), (1, "j")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert ("rightHint=(strategy=broadcast)" in plan) == (sent == 100)


def test_landed_files_grow_with_the_table(spark, monkeypatch):
    """Documents in many parts land in as many files."""
    from filespoor.world import index_queries as q

    rows = [(k, f"x{k}", "en", "s1") for k in range(12)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(9)
    landed = []

    class Landed(World):
        def table(self, name):
            return documents

    monkeypatch.setattr(q.incremental, "settled_index", lambda source, *a: landed.append(a))
    monkeypatch.setattr(q.incremental, "latest_index", lambda spark, path: None)
    monkeypatch.setattr(q, "_version_counts", lambda built: None)
    monkeypatch.setattr(q.settling, "clock_row", lambda timed, *a: timed.limit(0))
    world, path = Landed(spark, ""), []
    monkeypatch.setattr(Workspace, "folder", lambda self, name: path.append(f"{self.path}/{name}") or path[-1])
    q.settled_index(world)
    assert len(landed) == 2 and len(spark.read.parquet(path[0]).inputFiles()) >= 9
