import json
import random

import pytest
from pyspark.sql import functions as F

from filespoor import schema
from filespoor.functions.fingerprint import checksum
from filespoor.operators import index as ops
from filespoor.plans import compare, cve_update, index_build, infer, scan
from filespoor.session import Workspace
from filespoor.sources import feeds, index_store, releases, scan_results, sites
from filespoor.streaming import incremental, settling
from model import Model


def random_world(seed):
    """Two packages with versions that change some files, and sites that run one of them."""
    rng = random.Random(seed)
    uses, served, version = [], {}, 0
    for package, paths in (("a", 18), ("b", 14)):
        current = {f"{package}/f{i}.js": f"{package}{i}-0" for i in range(paths)}
        current["favicon.ico"] = f"{package}ico"
        for step in range(9):
            version += 1
            for path in rng.sample(sorted(current), 4):
                current[path] = f"{path}-{step}"
            if rng.random() < 0.5:
                current[f"{package}/new{step}.css"] = f"{package}new{step}"
            served[version] = dict(current)
            uses += [(version, p, c) for p, c in current.items()]
    crawl, listed = {}, []
    for site in range(14):
        runs = rng.choice(sorted(served))
        folder = rng.choice(["", "", "shop/", "cms/x/"])
        base = f"http://s{site}.example/"
        for path, content in served[runs].items():
            if rng.random() < 0.9:
                crawl[base + folder + path] = (200, content if rng.random() < 0.93 else f"own{site}{path}")
            else:
                crawl[base + folder + path] = (500, None)
        paths = sorted(p for p in served[runs])
        included = [base + folder + p for p in rng.sample(paths, rng.randint(0, 5))] + [base + "gone.js"]
        estimates = rng.sample(range(1, version + 1), rng.choice([0, 0, 3]))
        listed.append((site, base, included, estimates))
    return uses, version, crawl, listed


@pytest.mark.parametrize("seed", [1])
def test_inference_equals_brute_force(spark, seed):
    uses, n_versions, crawl, listed = random_world(seed)
    model = Model(uses, n_versions, crawl, min_absolute=4.0)
    space = Workspace(spark, "infer")
    used = space.save(spark.createDataFrame(uses, "version_id BIGINT, webroot_path STRING, checksum STRING"), "used")
    versions = spark.range(1, n_versions + 1).withColumnRenamed("id", "version_id")
    tables = index_store.derive_match_tables(used, versions, space.save)
    result = infer.infer_sites(
        spark.createDataFrame([(s, b) for s, b, _, _ in listed], "site_id BIGINT, base_url STRING"),
        spark.createDataFrame([(s, u) for s, _, inc, _ in listed for u in inc], "site_id BIGINT, url STRING"),
        spark.createDataFrame([(s, v) for s, _, _, est in listed for v in est] or [], "site_id BIGINT, version_id BIGINT"),
        spark.createDataFrame([(u, st, c) for u, (st, c) in crawl.items()], "url STRING, status INT, checksum STRING"),
        tables, used.select("webroot_path", "checksum"), space,
        infer.InferenceParams(min_absolute_support=4.0),
    )
    answers = {}
    for r in result.guesses.collect():
        answers.setdefault(r.site_id, []).append(r.version_id)
    rounds = {r.site_id: r.rounds for r in result.sites.collect()}
    want = {s: model.infer(b, inc, est) for s, b, inc, est in listed}
    assert rounds == {s: n for s, (_, n) in want.items()}
    assert {s: sorted(v) for s, v in answers.items()} == {s: a for s, (a, _) in want.items() if a}
    assert answers and len(answers) < len(listed)
    assert result.trace.count() == sum(rounds.values())
    record = result.probes.groupBy("site_id").agg({"round": "max"}).collect()
    assert record and all(last <= rounds[site] for site, last in record)
    assert {r.finish_reason for r in result.sites.collect()} <= {"no guess", "no guess left", "no improvement", "decided", "iteration limit"}
    assert result.listed.filter("round = 0").count() > 0


DEFS = [("alpha", "A", ["al"], "tags", r"^v(\d+)$", 1, None, False, [("/", "/")], None),
        ("beta", "B", [], "tags", None, 0, None, False, [("/st/", "/src/st")], r"src/st/skip")]
RELEASES = [
    ("alpha", "v1", "a.js", b"one"), ("alpha", "v1", "d/b.json", b"[1, 2]"), ("alpha", "v1", "bad.json", b"{"),
    ("alpha", "v2", "a.js", b"two"), ("alpha", "v2", "d/b.json", b"[2,1]"), ("alpha", "v2", "x.tar", b"t"),
    ("beta", "r1", "src/st/c.css", b"c"), ("beta", "r1", "src/st/skip/d.css", b"d"), ("beta", "r1", "other.css", b"o"),
    ("beta", "r1", "src/stat.css", b"s"),
]


def inputs(spark):
    defs = spark.createDataFrame(DEFS, schema.DEFINITION)
    refs = spark.createDataFrame(
        [("alpha", "refs/tags/v1", 1000, 0), ("alpha", "refs/tags/v2", 2000, 60), ("alpha", "refs/tags/x3", 5, 0),
         ("alpha", "refs/heads/v4", 5, 0), ("beta", "refs/tags/r1", 3000, 0)], schema.TAG_REF)
    return defs, releases.version_refs(refs, defs), spark.createDataFrame(RELEASES, schema.RELEASE_FILE)


def test_index_build_update_and_gc(spark):
    defs, available, files = inputs(spark)
    space = Workspace(spark, "build")
    first, second = space.folder("one"), space.folder("two")
    built = index_build.update_index(spark, None, first, defs, available.filter("internal_identifier <> 'v2'"), files)
    assert built.versions.count() == 2 and built.indexed_versions().count() == 2
    updated = index_build.update_index(spark, first, second, defs, available, files)
    named = ops.describe_versions(ops.version_files(updated.files, updated.uses), updated.versions, updated.packages)
    got = {(r.package_name, r.version_name, r.webroot_path, bytes(r.checksum)) for r in named.collect()}
    pair = {r[3] for r in got if r[2] == "d/b.json"}
    assert len(pair) == 1
    assert {r[:3] for r in got} == {
        ("alpha", "1", "a.js"), ("alpha", "1", "d/b.json"), ("alpha", "2", "a.js"), ("alpha", "2", "d/b.json"),
        ("beta", "r1", "st/c.css"), ("beta", "r1", "st/at.css"),
    }
    assert checksum(b"two") in {r[3] for r in got}
    old_ids = {tuple(r) for r in built.files.select("file_id", "src_path").collect()}
    assert old_ids < {tuple(r) for r in updated.files.select("file_id", "src_path").collect()}
    lines = [r.line for r in compare.compare_versions(updated, ops.version_files(updated.files, updated.uses), "ALPHA", "1", "2").collect()]
    assert lines == ["a.js -> a.js"]
    with pytest.raises(ValueError):
        compare.compare_versions(updated, ops.version_files(updated.files, updated.uses), "alpha", "1", "9")
    kept = index_build.gc_index(updated, available.filter("internal_identifier <> 'v1'"))
    assert kept.versions.count() == 2 and kept.uses.join(kept.versions, "version_id", "left_anti").count() == 0
    index_store.export_index(kept, space.folder("export"))
    assert index_build.select_definitions(defs, "AL*").count() == 1


def test_own_types_normalizers_and_names(spark):
    from filespoor import fixed_values as fv
    from filespoor.functions.fingerprint import NORMALIZERS

    defs, _, files = inputs(spark)
    types = (*fv.FILE_TYPES, ("archive", ("tar",), False, True, "canonical"))
    kinds = {"types": types, "normalizers": NORMALIZERS | {"archive": lambda content: content.upper()}}
    found = {r.src_path: (r.file_type, bytes(r.checksum)) for r in index_build.fingerprinted_files(files, defs, **kinds).collect()}
    assert found["x.tar"] == ("archive", checksum(b"T")) and found["a.js"][0] == "javascript" and "bad.json" not in found
    refs = spark.createDataFrame([("alpha", "refs/tags/v1", 1000, 0), ("beta", "refs/tags/r1", 3000, 0)], schema.TAG_REF)
    named = releases.version_refs(refs, defs, {"alpha": lambda tag: F.concat(F.lit("release "), tag)})
    assert {(r.package, r.name) for r in named.collect()} == {("alpha", "release v1"), ("beta", "r1")}


def test_version_without_files_stays_missing(spark):
    defs, available, files = inputs(spark)
    space = Workspace(spark, "late")
    first, second = space.folder("one"), space.folder("two")
    built = index_build.update_index(spark, None, first, defs, available, files.filter("version <> 'v2'"))
    assert built.versions.count() == 3 and built.indexed_versions().count() == 2
    assert index_build.update_index(spark, first, second, defs, available, files).indexed_versions().count() == 3


def test_streams_lose_and_repeat_nothing(spark):
    from filespoor.streaming import incremental

    space = Workspace(spark, "streams")
    rows = space.folder("in")
    spark.createDataFrame([(1, "a"), (1, "b")], "version_id BIGINT, path STRING").coalesce(1).write.parquet(rows)
    index = space.folder("index")

    def stream(folder):
        return spark.readStream.schema("version_id BIGINT, path STRING").parquet(folder)

    incremental.incremental_index(stream(rows), lambda b: b, index, space.folder("p1"))
    more = space.folder("more")
    spark.createDataFrame([(1, "c"), (2, "d")], "version_id BIGINT, path STRING").coalesce(1).write.parquet(more)
    incremental.incremental_index(stream(more), lambda b: b, index, space.folder("p2"))
    assert sorted((r.version_id, r.path) for r in spark.read.parquet(index).collect()) == [(1, "a"), (1, "b"), (2, "d")]

    def scanned(batch):
        return batch.selectExpr("concat('u', version_id) url", "current_timestamp() scan_time", "path result")

    results = space.folder("results")
    incremental.incremental_scan(stream(rows), scanned, results, space.folder("p3"), "t")
    incremental.incremental_scan(stream(more), scanned, results, space.folder("p4"), "t")
    assert sorted(r.url for r in scan_results.read_results(spark, results).collect()) == ["u1", "u2"]
    with_id = scanned(spark.createDataFrame([(3, "x"), (3, "y")], "version_id BIGINT, path STRING")).selectExpr("*", "'t' scan_identifier")
    scan_results.append_results(with_id, results)
    scan_results.append_results(with_id, results)
    assert scan_results.read_results(spark, results).count() == 3


def test_rows_wait_until_their_key_is_quiet(spark):
    space = Workspace(spark, "settling")
    landing, out = space.folder("in"), space.folder("out")
    batches = [
        [("a", 100, [("h", b"1")]), ("b", 105, None)],
        [("a", 108, []), (None, 109, None)],
        [("c", 130, [("x", None)])],  # the clock is at 120: a and b are due in the next batch
        [("b", 125, None), ("a", 103, None), ("c", 131, None)],  # b has to wait again; rows of the due batch are not late yet
        [("d", 101, None), (None, 1000, None)],  # d is late
    ]
    plain = "key STRING, s BIGINT, more ARRAY<STRUCT<n: STRING, v: BINARY>>"
    for rows in batches:
        frame = spark.createDataFrame(rows, plain).withColumn("time", F.timestamp_seconds("s"))
        frame.coalesce(1).write.mode("append").parquet(landing)
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    incremental._run(
        settling.settled(source, "key", "time", 10),
        space.folder("progress"), lambda batch, n: batch.withColumn("n", F.lit(n)).write.mode("append").parquet(out),
    )
    found = {}
    for r in spark.read.parquet(out).collect():
        found.setdefault((r.n, r.key), []).append((r.s, r.more))
        assert r.time.timestamp() == r.s
    assert sorted((key, sorted(s for s, _ in rows)) for (_, key), rows in found.items()) == [("a", [100, 103, 108]), ("b", [105, 125]), ("c", [130, 131])]
    of_a = next(rows for (_, key), rows in found.items() if key == "a")
    assert sorted((s, [(x.n, bytes(x.v)) for x in more]) for s, more in of_a if more is not None) == [(100, [("h", b"1")]), (108, [])]


def test_stream_of_releases_yields_index_snapshots(spark):
    from filespoor.streaming import incremental

    defs, available, files = inputs(spark)
    space = Workspace(spark, "snapshots")
    rows, path, progress = space.folder("in"), space.folder("index"), space.folder("progress")
    assert incremental.latest_index(spark, path).versions.count() == 0
    files.filter("version <> 'v2'").coalesce(1).write.parquet(rows)

    def run():
        source = spark.readStream.schema(schema.RELEASE_FILE).parquet(rows)
        incremental.incremental_snapshots(source, defs, available, path, progress)
        return incremental.latest_index(spark, path)

    assert run().indexed_versions().count() == 2
    files.filter("version = 'v2'").coalesce(1).write.mode("append").parquet(rows)
    assert run().indexed_versions().count() == 3
    last = run()
    assert last.indexed_versions().count() == 3 and last.files.count() == 5


def test_files_of_a_version_come_in_several_batches(spark):
    from filespoor.streaming import incremental

    defs, available, files = inputs(spark)
    space = Workspace(spark, "settled-index")
    path = space.folder("index")
    plain = index_build.update_index(spark, None, space.folder("plain"), defs, available, files)

    def run(package, progress):
        """One stream per package, whose versions are torn apart."""
        landing = space.folder("landing")
        timed = files.filter(F.col("package") == package).withColumn("fetched", F.timestamp_seconds(F.lit(1000)))
        timed.repartition(2).write.parquet(landing)
        settling.clock_row(timed, "fetched", 10_000).write.mode("append").parquet(landing)
        source = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(landing)
        incremental.settled_index(source, "fetched", 60, defs, available, path, progress, space)

    run("alpha", space.folder("p1"))
    half = incremental.latest_index(spark, path).indexed_versions()
    assert half.count() == plain.indexed_versions().count() - 1
    run("beta", space.folder("p2"))
    built = incremental.latest_index(spark, path)
    for name in ("packages", "uses", "files"):
        table = getattr(plain, name)
        assert sorted(map(str, getattr(built, name).select(table.columns).collect())) == sorted(map(str, table.collect())), name
    marked = "version_id", "name", "indexed IS NOT NULL"
    assert {tuple(r) for r in built.versions.selectExpr(*marked).collect()} == {tuple(r) for r in plain.versions.selectExpr(*marked).collect()}


def test_one_snapshot_of_a_number_is_logged(spark):
    from filespoor.streaming import incremental

    path = Workspace(spark, "log").path
    assert incremental._snapshots(spark, path).count() == 0
    assert incremental.log_snapshot(spark, path, (0, "a", "s", 0))
    assert not incremental.log_snapshot(spark, path, (0, "b", "t", 0))
    made = []

    def write(old, new):
        made.append(old)
        if len(made) == 1:  # another stream is faster
            assert incremental.log_snapshot(spark, path, (1, "c", "t", 1))

    incremental._extend(spark, path, "s", 1, write)
    incremental._extend(spark, path, "s", 1, write)
    assert made == ["a", "c"]
    assert [(r.sequence, r.stream) for r in incremental._snapshots(spark, path).orderBy("sequence").collect()] == [(0, "s"), (1, "t"), (2, "s")]


def test_natural_key_compares_long_numbers(spark):
    from filespoor.functions.text import natural_key
    from pyspark.sql import functions as F

    names = ["a2", "a010", "a" + "9" * 45, "a1" + "0" * 45, "b"]
    df = spark.createDataFrame([(n,) for n in reversed(names)], "n STRING")
    assert [r.n for r in df.orderBy(natural_key(F.col("n"))).collect()] == names


def test_definitions_table(spark):
    defs = releases.definitions(spark)
    assert defs.count() == 19 and defs.filter("version_group > 0").count() == 7


def test_files_are_hashed_in_pieces(spark, tmp_path, monkeypatch):
    from filespoor.functions import fingerprint

    folder = tmp_path / "my snap" / "alpha" / "v 1"
    folder.mkdir(parents=True)
    contents = {"empty.js": b"", "one.js": b"x" * 1000, "two %41.js": bytes(range(256)) * 70_000, "many.js": b"ab" * (13 << 20)}
    for name, data in contents.items():
        (folder / name).write_bytes(data)
    rows = releases.file_snapshot_checksums(spark, str(tmp_path / "my snap")).collect()
    assert {(r.package, r.version, r.path): (r.length, bytes(r.checksum)) for r in rows} == {
        ("alpha", "v 1", name): (len(data), checksum(data)) for name, data in contents.items() if data}  # Spark lists no empty files
    assert fingerprint.file_digest(str(folder / "empty.js")) == checksum(b"")
    monkeypatch.setattr(fingerprint, "CHUNK", 7)
    assert fingerprint.file_digest(str(folder / "one.js")) == fingerprint.file_digest(f"file://{folder / 'one.js'}") == checksum(contents["one.js"])


def test_file_snapshot(spark, tmp_path):
    folder = tmp_path / "snap" / "alpha" / "v1" / "d"
    folder.mkdir(parents=True)
    (folder / "b.txt").write_bytes(b"x")
    rows = releases.file_snapshot(spark, str(tmp_path / "snap")).collect()
    assert [(r.package, r.version, r.path, bytes(r.content)) for r in rows] == [("alpha", "v1", "d/b.txt", b"x")]


def test_manifest(spark, tmp_path):
    text = "Package: a-web\nVersion: 1\nFilename: p/a1.deb\n\nPackage: a-web\nVersion: 1\nFilename: p/a2.deb\n\nPackage: z\nVersion: 2\nFilename: z.deb\n"
    (tmp_path / "Packages").write_text(text)
    stanzas = releases.read_manifest(spark, str(tmp_path / "Packages"))
    assert [tuple(r) for r in releases.package_manifest(stanzas, "a-web").collect()] == [("a-web", "1", "p/a2.deb")]


def test_site_lists(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("\n".join(f"s{i}.example" for i in range(20)))
    listed = sites.site_urls(sites.slice_sites(sites.url_list(spark, str(tmp_path / "urls.txt")), 3, 2), "url")
    assert sorted(r.url for r in listed.collect()) == [f"http://s{i}.example" for i in (2, 3, 4)]
    with pytest.raises(ValueError):
        sites.ranked_sites(spark, "x", 999_999, 10)
    with pytest.raises(ValueError):
        scan_results.check_identifier("a-b")


def test_rule_catalogue(spark):
    doc = {"apps": {"X": {"html": "[a-z]", "script": ["p", "q"], "headers": {"S": "v"}, "cats": [1]}, "Y": {"meta": {"g": "w"}, "html": []}}}
    df = spark.createDataFrame([(json.dumps(doc),)], "value STRING")
    got = {tuple(r) for r in feeds.parse_tech_rules(df).collect()}
    assert got == {("X", "html", None, "[a-z]"), ("X", "script", None, "p"), ("X", "script", None, "q"), ("X", "headers", "S", "v"), ("Y", "meta", "g", "w")}


def test_cve_update(spark, tmp_path):
    defs, available, files = inputs(spark)
    built = index_build.update_index(spark, None, Workspace(spark, "cve").folder("i"), defs, available, files)
    item = lambda cve, product, *versions: {"cve": {"CVE_data_meta": {"ID": cve}, "affects": {"vendor": {"vendor_data": [
        {"vendor_name": "v", "product": {"product_data": [{"product_name": product, "version": {"version_data": [{"version_value": x} for x in versions]}}]}}]}}}}
    (tmp_path / "y1.json").write_text(json.dumps({"CVE_Items": [item("C1", "ALPHA", "1", "2"), item("C2", "al", "1")]}, indent=1))
    (tmp_path / "y2.json").write_text(json.dumps({"CVE_Items": [item("C3", "alpha", "1", "7"), {"cve": {"CVE_data_meta": {"ID": "C4"}}}]}))
    stats = cve_update.update_cve(feeds.cve_feed(spark, str(tmp_path / "*.json")), built)
    named = ops.describe_versions(stats, built.versions, built.packages)
    assert {(r.version_name, tuple(r.cve_ids)) for r in named.collect()} == {("1", ("C1", "C2", "C3")), ("2", ("C1",))}


def scan_world(spark):
    """One package of six versions with fourteen files each, two sites and a dead one."""
    versions = range(1, 7)
    content = {v: {f"f{i}.js": f"f{i} of {v if i > 3 else 0}".encode() for i in range(14)} for v in versions}
    files, uses = {}, []
    for v in versions:
        for path, data in content[v].items():
            key = (path, data)
            files.setdefault(key, len(files))
            uses.append((v, files[key]))
    index = index_store.Index(
        spark.createDataFrame([(1, "Alpha", "A", [])], schema.PACKAGE),
        spark.createDataFrame([(v, 1, f"{v}.0", f"id{v}", v * 86400, True) for v in versions], "version_id BIGINT, package_id BIGINT, name STRING, internal_identifier STRING, t BIGINT, i BOOLEAN")
        .select("version_id", "package_id", "name", "internal_identifier", F.timestamp_seconds("t").alias("release_date"), F.timestamp_seconds(F.lit(0)).alias("indexed")),
        spark.createDataFrame([(i, p, p, checksum(d)) for (p, d), i in files.items()], schema.STATIC_FILE),
        spark.createDataFrame(uses, schema.STATIC_FILE_USE),
    )
    html = b"<meta name=generator content='alpha'>" + b"".join(b"<script src='/f%d.js'></script>" % i for i in range(12)) + b"<link href=/style.css>"
    crawl = []
    for site, v in (("http://one.example", 4), ("http://two.example", 6)):
        crawl.append((site, site + "/", 200, [("X", "y")], html))
        crawl += [(f"{site}/{p}", None, 200, None, d) for p, d in content[v].items()]
    crawl.append(("http://dead.example", None, 503, None, None))
    listed = spark.createDataFrame([(1, "http://one.example"), (2, "http://two.example"), (3, "http://dead.example")], "site_id BIGINT, url STRING")
    return index, spark.createDataFrame(crawl, schema.CRAWL), listed


def test_scan_batch_resumes_and_stream_equals_batch(spark):
    index, crawl, listed = scan_world(spark)
    space = Workspace(spark, "scan")
    tables = index_store.stage_match_tables(index, space)
    rules = spark.createDataFrame([], schema.TECH_RULE)
    none = spark.createDataFrame([], schema.SCAN_RESULT)
    params = infer.InferenceParams(min_absolute_support=5.0, max_iterations=3)

    def run(some_sites, rows, stored):
        return scan.scan_batch(
            some_sites, rows, rules, index, tables, stored, "t", Workspace(spark, "scan"), params)

    path = space.folder("results")
    scan_results.append_results(run(listed.filter("site_id = 1"), crawl, none), path)
    scan_results.append_results(run(listed, crawl, scan_results.read_results(spark, path)), path)
    rows = {r.url: json.loads(r.result) for r in scan_results.read_results(spark, path).collect()}
    assert len(rows) == 3 and rows["http://dead.example"] == {"result": False, "more_recent": None}
    one, two = rows["http://one.example"], rows["http://two.example"]
    assert [g["software_version"]["name"] for g in one["result"]] == ["4.0"]
    assert one["more_recent"]["name"] == "6.0" and two["more_recent"] is None
    assert one["result"][0]["software_version"]["release_date"] == "1970-01-05T00:00:00"
    matched = one["result"][0]["positive_matches"]
    assert {"http://one.example/f0.js", "http://one.example/f11.js"} <= {a["url"] for a in matched}
    by_url = {a["url"].rsplit("/", 1)[1]: a for a in matched}
    names = [[v["name"] for v in by_url["f11.js"][k]] for k in ("expected_versions", "using_versions")]
    assert names == [["1.0", "2.0", "3.0", "4.0", "5.0", "6.0"], ["4.0"]]
    assert matched[0]["checksum"] == checksum(b"f0 of 0").hex()

    landing, streamed = space.folder("landing"), space.folder("streamed")
    for name in ("one", "two", "dead"):
        crawl.filter(F.contains("url", F.lit(f"//{name}."))).coalesce(1).write.mode("append").parquet(landing)
    source = spark.readStream.schema(schema.CRAWL).option("maxFilesPerTrigger", 2).parquet(landing)

    def handle(batch):
        here = listed.join(batch.select("url").distinct(), "url", "left_semi").select("site_id", "url")
        return run(here, batch, none)

    incremental.incremental_scan(source, handle, streamed, space.folder("progress"), "t")
    assert {r.url: json.loads(r.result) for r in scan_results.read_results(spark, streamed).collect()} == rows

    # the rows of each site over three batches, and a fourth one that ends the crawl
    landing, settled, progress = space.folder("pieces"), space.folder("settled"), space.folder("progress")
    own = crawl.withColumns({
        "site": F.concat(F.lit("http://"), F.regexp_extract("url", "//([a-z]+[.]example)", 1)), "fetched": F.timestamp_seconds(F.lit(1000)),
    })
    for piece in range(3):
        own.filter(F.pmod(F.crc32("url"), F.lit(3)) == piece).coalesce(1).write.mode("append").parquet(landing)
    handled = []

    def scan_settled(batch):
        handled.append(batch.count())
        here = listed.join(batch.select(F.col("site").alias("url")).distinct(), "url", "left_semi").select("site_id", "url")
        return run(here, batch.drop("site", "fetched"), none)

    def stream():
        source = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(landing)
        incremental.settled_scan(source, "site", "fetched", 60, scan_settled, settled, progress, "t", space)

    stream()
    assert not handled
    settling.clock_row(own, "fetched", 9000).coalesce(1).write.mode("append").parquet(landing)
    stream()
    assert handled == [own.count()]
    assert {r.url: json.loads(r.result) for r in scan_results.read_results(spark, settled).collect()} == rows
    stream()
    assert handled == [own.count()]
