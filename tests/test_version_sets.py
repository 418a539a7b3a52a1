"""Interned version sets: sums, scores and documents against brute force."""

import json
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from filespoor.operators import scoring, version_sets
from filespoor.params import InferenceParams
from filespoor.session import Workspace
from filespoor.sources import scan_results


def world(seed):
    rng = random.Random(seed)
    users = {c: rng.sample(range(1, 40), rng.randint(1, 12)) for c in "abcdefgh"}
    paths = {p: sorted({v for c in rng.sample("abcdefgh", 3) for v in users[c]}) for p in ("p", "q", "r")}
    assets = []
    for site in range(25):
        for _ in range(rng.randint(0, 12)):
            path, content = rng.choice("pqrs"), rng.choice("abcdefghxy")
            success = rng.random() < 0.8
            found = success and content in users
            assets.append((site, path, success, content if success else None, found, rng.choice([0, 5, 1000, 70_000])))
    return users, paths, assets


def brute(users, paths, assets):
    total = Counter()
    for site, path, _, content, found, weight in assets:
        using = set(users[content]) if found else set()
        for v in using | set(paths.get(path, ())):
            kind = "pos" if v in using else "neg"
            total[site, v, kind + "_micro"] += weight
            total[site, v, "n_" + kind] += 1
    return {(s, v): tuple(total[s, v, n] for n in version_sets.SCORES) for s, v, _ in total}


@pytest.mark.parametrize("entries", [10**6, 0])
def test_scores_and_strongest(spark, monkeypatch, entries):
    """Sets sent to all tasks, or joined by a shuffle when they are too many."""
    monkeypatch.setattr(version_sets, "BROADCAST_ENTRIES", entries)
    users, paths, assets = world(3)
    space = Workspace(spark, "sets")
    frame = spark.createDataFrame(assets, "site_id long, webroot_path string, success boolean, checksum string, found boolean, weight_micro long")
    by_checksum = spark.createDataFrame([(c, v) for c, vs in users.items() for v in vs], "checksum string, version_id long")
    by_path = spark.createDataFrame([(p, v) for p, vs in paths.items() for v in vs], "webroot_path string, version_id long")
    packed = version_sets.intern(by_checksum, by_path, space.save)
    assert packed.sets.count() == len({tuple(sorted(x)) for x in (*users.values(), *paths.values())})
    sums, others = version_sets.set_sums(frame, packed, hot_rows=20, save=space.save)
    sums, others = space.save(sums, "sums"), space.save(others, "others")
    want = brute(users, paths, assets)
    listed = version_sets.with_versions(sums, packed, others)
    got = {(r.site_id, r.version_id): tuple(r[n] for n in version_sets.SCORES) for r in version_sets.score_versions(listed).collect()}
    assert got == want
    params = InferenceParams()
    best = {}
    for (site, v), (pos, neg, *_) in want.items():
        best.setdefault(site, []).append((-(pos * params.positive_milli + neg * params.negative_milli), v))
    want_top = sorted((site, v, -s, *want[site, v]) for site, x in best.items() for s, v in sorted(x)[:params.guess_limit])
    top = scoring.strongest(sums, packed, others, params)
    assert sorted((r.site_id, r.version_id, r.strength_nano, *(r[n] for n in version_sets.SCORES)) for r in top.collect()) == want_top
    # two lots of assets add up to the same
    lots = [version_sets.set_sums(frame.filter(F.col("site_id") % 2 == i), packed, save=space.save) for i in (0, 1)]
    added = space.save(version_sets.add_sums(*(s for s, _ in lots)), "added")
    both = space.save(version_sets.add_sets(*(o for _, o in lots)), "both")
    listed = version_sets.with_versions(added, packed, both)
    assert {(r.site_id, r.version_id): tuple(r[n] for n in version_sets.SCORES) for r in version_sets.score_versions(listed).collect()} == want


def test_rows_of_a_site_over_several_batches():
    """The kernel gives the same wherever batches end."""
    import numpy as np

    rng = np.random.default_rng(2)
    site = np.sort(rng.integers(0, 9, 60))
    lists = [np.unique(rng.integers(-5, 30, rng.integers(1, 9))) for _ in site]
    numbers = (site, rng.random(60) < 0.5, rng.integers(0, 50, 60), rng.integers(1, 4, 60))
    whole = version_sets._best_of_sites(*numbers, np.array(list(map(len, lists))), np.concatenate(lists), 4, 1000, 100)
    parts = [
        version_sets._best_of_sites(*(x[site == s] for x in numbers), np.array([len(x) for x, t in zip(lists, site) if t == s]),
                                    np.concatenate([x for x, t in zip(lists, site) if t == s]), 4, 1000, 100)
        for s in np.unique(site)
    ]
    assert whole.to_pylist() == pa.Table.from_batches(parts).to_pylist()
    huge = np.concatenate(lists) * 2**50  # ids too far apart for one number
    far = version_sets._best_of_sites(*numbers, np.array(list(map(len, lists))), huge, 4, 1000, 100)
    assert [r | {"version_id": r["version_id"] // 2**50} for r in far.to_pylist()] == whole.to_pylist()


def test_documents_are_expanded_on_read(spark):
    space = Workspace(spark, "documents")
    lists = [[{"name": "1.0", "release_date": None}], [{"name": "1.0", "release_date": None}, {"name": '2"0', "release_date": "x"}]]
    kind = "array<struct<name:string,release_date:string>>"
    texts = spark.createDataFrame([(x,) for x in lists], f"v {kind}").select(scan_results.set_text(F.col("v")).alias("versions"))
    sets = texts.select(F.md5("versions").alias("set_key"), "versions")
    none = spark.createDataFrame([(scan_results.NO_VERSIONS, "[]")], scan_results.SETS)
    path = space.folder("sets")
    for part in (sets.limit(1), sets.unionByName(none), sets):  # sets are stored once, whoever names them
        scan_results.append_sets(part, path)
    stored = scan_results.read_sets(spark, path)
    assert stored.count() == 3
    keys = {r.versions: r.set_key for r in stored.collect()}
    one, two = sorted((k for k in keys if k != "[]"), key=len)
    def asset(a, b):
        return {"url": "u", "expected_versions": a, "using_versions": b}
    whole = {1: [asset(lists[0], lists[1]), asset(lists[1], [])], 2: [asset([], lists[0])]}
    named = {1: [asset(keys[one], keys[two]), asset(keys[two], keys["[]"])], 2: [asset(keys["[]"], keys[one])]}
    documents = spark.createDataFrame(
        [(i, json.dumps({"result": x}, separators=(",", ":"))) for i, x in named.items()] + [(3, '{"result":false}')], "site_id long, result string"
    )
    expanded = {r.site_id: r.result for r in scan_results.expand_documents(documents, ["site_id"], stored).collect()}
    assert {i: json.loads(x)["result"] for i, x in expanded.items()} == whole | {3: False}
    chars = {r.site_id: r.result_chars for r in scan_results.expanded_chars(documents, ["site_id"], stored).collect()}
    assert chars == {i: len(x) for i, x in expanded.items()}
