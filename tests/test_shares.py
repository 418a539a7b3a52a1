"""Findings of round 4: what grows with the square of the tables is neither listed nor moved."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from filespoor.operators import matching, scoring, signals, skew, version_sets
from filespoor.session import Workspace
from test_version_sets import brute, world


def frames(spark, seed):
    users, paths, assets = world(seed)
    frame = spark.createDataFrame(assets, "site_id long, webroot_path string, success boolean, checksum string, found boolean, weight_micro long")
    by_checksum = spark.createDataFrame([(c, v) for c, vs in users.items() for v in vs], "checksum string, version_id long")
    by_path = spark.createDataFrame([(p, v) for p, vs in paths.items() for v in vs], "webroot_path string, version_id long")
    return (users, paths, assets), frame, by_checksum, by_path


@pytest.mark.parametrize("entries", [10**6, 0])
def test_providers_of_a_path_are_not_listed_again(spark, monkeypatch, entries):
    """Of a path with very many providers, each content of it lists its own users at most."""
    monkeypatch.setattr(version_sets, "BROADCAST_ENTRIES", entries)
    space = Workspace(spark, "shared")
    many = list(range(100, 400))
    users = {"a": [1, 2, 3], "b": [2, 3, 100, 101], "c": [100, 399], "d": [7]}
    paths = {"p": many, "q": [1, 2, 3, 4], "r": [7]}
    assets = [(s, p, True, c, True, 10 + s) for s, (p, c) in enumerate((p, c) for p in paths for c in users)] + [(50, "p", False, None, False, 5), (-1, "p", True, "b", True, 3)]
    frame = spark.createDataFrame(assets, "site_id long, webroot_path string, success boolean, checksum string, found boolean, weight_micro long")
    by_checksum = spark.createDataFrame([(c, v) for c, vs in users.items() for v in vs], "checksum string, version_id long")
    by_path = spark.createDataFrame([(p, v) for p, vs in paths.items() for v in vs], "webroot_path string, version_id long")
    packed = version_sets.intern(by_checksum, by_path, space.save)
    sums, others = version_sets.set_sums(frame, packed, save=space.save)
    assert version_sets.count_entries(others) <= len(paths) * sum(map(len, users.values()))  # not for each content all of a path
    got = {(r.site_id, r.version_id): tuple(r[n] for n in version_sets.SCORES) for r in scoring.site_scores(frame, packed, save=space.save).collect()}
    assert got == brute(users, paths, assets)
    top = scoring.strongest(sums, packed, others)
    assert {r.version_id for r in top.collect() if r.site_id == -1} == {2, 3, 100, 101, 102, 103, 104}


@pytest.mark.parametrize("step", [1, 200, 2**20, 2**40])
def test_lists_as_bytes(step):
    """A block gets lists with steps as narrow as they fit; also over the whole range of ids."""
    rng = np.random.default_rng(3)
    lists = [np.unique(rng.integers(-5, 60, n)) * step for n in rng.integers(1, 40, 30)] + [np.array([-2**63, 2**63 - 1])]
    batch = pa.RecordBatch.from_pydict({
        "set_id": pa.array([str(i).encode() for i in range(len(lists))]), "_share": pa.array([0] * len(lists), pa.int32()),
        "versions": pa.array(lists, pa.list_(pa.int64())),
    }).slice(2)
    codes = next(version_sets._coded(iter([batch]))).column("versions")
    flat, sizes = version_sets._ids(codes)
    assert flat.tolist() == [v for x in lists[2:] for v in x.tolist()] and sizes.tolist() == list(map(len, lists[2:]))
    assert step > 1 or len(codes[0].as_py()) == 9 + len(lists[2]) - 1
    block = version_sets._Block([batch.column("set_id")], [codes])
    assert [block.versions[block.list_of(k)].tolist() for k in range(len(codes))] == [x.tolist() for x in lists[2:]]


def test_assets_stay_where_they_are(spark, monkeypatch):
    """Few contents and kinds come to the assets, which are shuffled by site only once they are sums; many kinds meet them as before."""
    monkeypatch.setattr(version_sets, "BROADCAST_ENTRIES", 0)
    brutal, frame, by_checksum, by_path = frames(spark, 6)
    idf = spark.createDataFrame([("a", 3), ("b", 5)], "checksum string, weight_micro long")
    observed = frame.select("site_id", "webroot_path", "success", "checksum")
    results = []
    for rows in (skew.NEAR_ROWS, 0):
        monkeypatch.setattr(skew, "NEAR_ROWS", rows)
        space = Workspace(spark, "near")
        weighed = matching.weigh_assets(observed, idf)
        plan = weighed._jdf.queryExecution().executedPlan().toString()
        assert ("Exchange hashpartitioning" in plan) == (rows == 0)
        packed = version_sets.intern(by_checksum, by_path, space.save)
        results.append(({(r.site_id, r.version_id): tuple(r[n] for n in version_sets.SCORES) for r in scoring.site_scores(frame, packed, save=space.save).collect()},
                        sorted(map(tuple, weighed.collect()), key=repr)))
    assert results[0] == results[1] and results[0][0] == brute(*brutal)


@pytest.mark.parametrize("near", [10**6, 0])
def test_estimates_meet_where_their_sites_are(spark, monkeypatch, near):
    """The rows of all sites and versions are not shuffled to be made distinct; many versions meet the sites as before."""
    monkeypatch.setattr(skew, "NEAR_PAIRS", near)
    packages = spark.createDataFrame([(1, "a", ["x"]), (2, "b", ["x"]), (3, "c", None)], "package_id long, name string, alternative_names array<string>")
    versions = spark.createDataFrame(
        [(1, 10, "1.0", 1), (1, 10, "1.0", 1), (1, 11, "1.1", 1), (2, 10, "1.0", 1), (2, 20, "2.0", 1), (3, 30, "3", 1), (3, 31, "4", None)],
        "package_id long, version_id long, name string, indexed int")
    matches = spark.createDataFrame([(7, "X"), (7, "a"), (8, "c"), (8, "c"), (9, "none"), (None, "c")], "site_id long, app string")
    texts = spark.createDataFrame([(7, "a 1.0"), (7, "a"), (8, "b"), (8, "b"), (9, "c 9"), (10, None)], "site_id long, generator string")
    found = signals.candidate_versions(
        signals.rule_versions(matches, packages, versions), signals.generator_versions(texts, packages, versions)
    )
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(
        [(7, 10), (7, 11), (7, 20), (8, 30), (8, 10), (8, 20), (9, 30), (None, 30)], key=repr)
    plan = found._jdf.queryExecution().executedPlan().toString().split("Union")[0]
    assert ("Exchange" in plan) == (near == 0)
