"""Queries on site lists, vulnerability data, stored results and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from filespoor import schema
from filespoor.operators import cve, reports
from filespoor.plans import cve_update, evaluate, scan
from filespoor.sources import feeds, index_store, scan_results, sites
from filespoor.streaming import incremental, settling
from filespoor.world.registry import query
from filespoor.world.views import World, content_version, site_url


# --- site lists --------------------------------------------------------------


@query("ranked_sites", """
SELECT CAST(c_custkey + 1 AS INTEGER) AS rank, lower(c_name) AS domain, lower(c_mktsegment) AS tld, CAST(c_nationkey AS INTEGER) AS tld_rank
FROM customer WHERE c_custkey + 1 BETWEEN 11 AND 110""")
def ranked_sites(w: World) -> DataFrame:
    """Customers as a ranking, written as CSV and read back; the slice is the feature."""
    key, empty = (F.col("c_custkey") + 1).cast("int"), F.lit("")
    ranking = w.table("customer").select(
        key.alias("rank"), F.col("c_nationkey").alias("tld_rank"), F.lower("c_name").alias("domain"),
        F.lower("c_mktsegment").alias("tld"), empty.alias("subnets"), empty.alias("ips"), empty.alias("idn_domain"),
        empty.alias("idn_tld"), key.alias("prev_rank"), F.col("c_nationkey").alias("prev_tld_rank"),
        empty.alias("prev_subnets"), empty.alias("prev_ips"),
    )
    path = w.workspace("ranking").folder("csv")
    ranking.write.option("header", True).csv(path)
    return sites.ranked_sites(w.spark, path, 11, 100).select("rank", "domain", "tld", "tld_rank")


@query("url_list_sites", """
SELECT position, concat('http://', regexp_replace(url, '^https?://', '')) AS url FROM (
    SELECT row_number() OVER (ORDER BY page_id) - 1 AS position, url FROM pages) WHERE position BETWEEN 5 AND 34""")
def url_list_sites(w: World) -> DataFrame:
    """Page URLs as a list file; the slice is the feature."""
    path = w.workspace("urls").folder("txt")
    # several files; their lines are numbered over all files in order
    listed = w.table("pages").repartitionByRange(4, "page_id").sortWithinPartitions("page_id")
    listed.select(F.regexp_replace("url", "^https?://", "").alias("value")).write.text(path)
    chosen = sites.slice_sites(sites.url_list(w.spark, path), 30, 5)
    return sites.site_urls(chosen, "url").select("position", "url")


# --- vulnerabilities ---------------------------------------------------------


def _feed_documents(w: World) -> DataFrame:
    record = F.struct(
        F.struct(
            F.struct(F.col("cve_id").alias("ID")).alias("CVE_data_meta"),
            F.struct(F.struct(F.array(F.struct(
                F.col("vendor").alias("vendor_name"),
                F.struct(F.array(F.struct(
                    F.col("product_name").alias("product_name"),
                    F.struct(F.array(F.struct(F.col("version_value").alias("version_value")))
                             .alias("version_data")).alias("version"),
                )).alias("product_data")).alias("product"),
            )).alias("vendor_data")).alias("vendor")).alias("affects"),
        ).alias("cve")
    )
    return w.cves.select(F.to_json(F.struct(F.array(record).alias("CVE_Items"))).alias("value"))


def _feed_items(w: World) -> DataFrame:
    path = w.workspace("feeds").folder("json")
    _feed_documents(w).write.option("compression", "gzip").text(path)
    return feeds.cve_feed(w.spark, path, multi_line=False)


@query("cve_feed_scan", "SELECT cve_id, vendor, product_name, version_value FROM cve")
def cve_feed_scan(w: World) -> DataFrame:
    return cve.affected_products(_feed_items(w))


@query("cve_versions", "SELECT cve_id, version_id FROM cve_version")
def cve_versions(w: World) -> DataFrame:
    return w.vulnerable


@query("cve_stats", """
SELECT version_id, array_to_string(list_sort(list(cve_id)), ',') AS cve_ids FROM cve_version GROUP BY version_id""")
def cve_stats(w: World) -> DataFrame:
    return cve.cve_stats(w.vulnerable).select("version_id", F.array_join("cve_ids", ",").alias("cve_ids"))


@query("update_cve", """
SELECT version_id, array_to_string(list_sort(list(cve_id)), ',') AS cve_ids FROM cve_version GROUP BY version_id""")
def update_cve(w: World) -> DataFrame:
    stats = w.workspace("cve").folder("stats")
    cve_update.write_cve_stats(cve_update.update_cve(_feed_items(w), w.index), stats)
    return w.spark.read.parquet(stats).select("version_id", F.array_join("cve_ids", ",").alias("cve_ids"))


@query("vulnerable_versions_flag", """
SELECT version_id, version_id IN (SELECT version_id FROM cve_version) AS vulnerable FROM software_version""")
def vulnerable_versions_flag(w: World) -> DataFrame:
    return cve.vulnerable_flags(w.versions.select("version_id"), w.vulnerable)


@query("cve_stats_table", """
SELECT v.version_id, v.is_indexed, s.cves FROM software_version v
JOIN (SELECT version_id, count(*) AS cves FROM cve_version GROUP BY version_id) s USING (version_id)""")
def cve_stats_table(w: World) -> DataFrame:
    """The written table of records per version, read again by its users."""
    path = w.workspace("cve").folder("stats")
    cve_update.write_cve_stats(cve.cve_stats(w.vulnerable), path)
    stats = w.spark.read.parquet(path)
    return w.versions.join(stats, "version_id").select(
        "version_id", F.col("indexed").isNotNull().alias("is_indexed"), F.size("cve_ids").cast("bigint").alias("cves")
    )


@query("tech_rules_scan", """
SELECT c_name AS app, kind, field, pattern FROM customer, LATERAL (VALUES
    ('headers', 'X-Powered-By', lower(c_name)), ('meta', 'generator', concat('^', c_name)), ('html', NULL, concat('<p>', c_name)),
    ('script', NULL, concat(lower(c_mktsegment), '\\.js')), ('script', NULL, 'app\\.js')) t(kind, field, pattern)""")
def tech_rules_scan(w: World) -> DataFrame:
    """A rule catalogue with one document per customer."""
    rule = F.struct(
        F.struct(F.lower("c_name").alias("X-Powered-By")).alias("headers"),
        F.struct(F.concat(F.lit("^"), "c_name").alias("generator")).alias("meta"),
        F.concat(F.lit("<p>"), "c_name").alias("html"),
        F.array(F.concat(F.lower("c_mktsegment"), F.lit("\\.js")), F.lit("app\\.js")).alias("script"),
    )
    documents = w.table("customer").select(
        F.concat(F.lit('{"apps":'), F.to_json(F.create_map("c_name", rule)), F.lit("}")).alias("value")
    )
    return feeds.parse_tech_rules(documents)


# --- stored results ----------------------------------------------------------


def _stored(w: World) -> DataFrame:
    """Result documents, written as a scan and read back."""
    path = w.workspace("results").folder("scan")
    scan_results.append_results(w.scan_results, path)
    return scan_results.read_results(w.spark, path)


@query("scan_results_append", """
SELECT url, CASE WHEN guesses = 0 THEN 'false' ELSE 'array' END AS kind, guesses FROM result_site""")
def scan_results_append(w: World) -> DataFrame:
    """A second append of the same scan adds nothing."""
    space = w.workspace("results")
    path, incoming = space.folder("scan"), space.save(w.scan_results, "incoming")
    scan_results.append_results(incoming, path)
    stored = scan_results.read_results(w.spark, path)
    scan_results.append_results(scan_results.new_results(incoming, stored), path)
    outcome = reports.outcome()
    return scan_results.read_results(w.spark, path).select(
        "url",
        F.when(outcome == "false", "false").otherwise("array").alias("kind"),
        F.coalesce(F.json_array_length(outcome), F.lit(0)).cast("bigint").alias("guesses"),
    )


@query("scan_result_lookup", """
SELECT url, guesses FROM result_site
WHERE url IN (SELECT concat('http://site', CAST(c_custkey AS VARCHAR), '.example/') FROM customer)""")
def scan_result_lookup(w: World) -> DataFrame:
    wanted = w.table("customer").select(site_url(F.col("c_custkey")).alias("url"))
    found = scan_results.lookup_results(w.scan_results, "orders", wanted)
    return found.select("url", F.coalesce(F.json_array_length(reports.outcome()), F.lit(0)).cast("bigint").alias("guesses"))


@query("scanned_sites", "SELECT url FROM result_site")
def scanned_sites(w: World) -> DataFrame:
    return scan_results.scanned_sites(w.scan_results, "orders")


@query("unscanned_sites", """
SELECT c_custkey AS site_id, concat('http://site', CAST(c_custkey * 17 AS VARCHAR), '.example/') AS url FROM customer
WHERE c_custkey * 17 NOT IN (SELECT o_orderkey FROM orders)""")
def unscanned_sites(w: World) -> DataFrame:
    listed = w.table("customer").select(
        F.col("c_custkey").alias("site_id"), site_url(F.col("c_custkey") * 17).alias("url")
    )
    return scan_results.unscanned(listed, w.scan_results, "orders").select("site_id", "url")


@query("results_with_guess", "SELECT url FROM result_site WHERE guesses > 0")
def results_with_guess(w: World) -> DataFrame:
    return reports.with_guesses(w.scan_results).select("url")


@query("result_versions", "SELECT DISTINCT url, version_id FROM result_version")
def result_versions(w: World) -> DataFrame:
    return reports.result_versions(reports.guesses(w.scan_results), w.packages, w.versions)


@query("inference_json", """
SELECT url, CASE WHEN count(version_id) = 0 THEN '{"result":false,"more_recent":null}' ELSE
    concat('{"result":[', string_agg(guess, ',' ORDER BY version_id), '],"more_recent":null}') END AS result
FROM (SELECT s.url, g.version_id, CASE WHEN g.version_id IS NOT NULL THEN concat(
        '{"software_version":{"software_package":{"name":"', p.name, '","vendor":"', p.vendor, '","alternative_names":["',
        array_to_string(p.alternative_names, '","'), '"]},"name":"', v.name, '","internal_identifier":"', v.internal_identifier,
        '","release_date":"', strftime(v.release_date, '%Y-%m-%dT%H:%M:%S'), '"}}') END AS guess
    FROM result_site s LEFT JOIN result_guess g ON g.site_id = s.site_id LEFT JOIN software_version v USING (version_id)
    LEFT JOIN software_package p ON p.package_id = v.package_id)
GROUP BY url""")
def inference_json(w: World) -> DataFrame:
    return w.scan_results.select("url", "result")


@query("report_available", "SELECT count(*) AS results FROM result_site")
def report_available(w: World) -> DataFrame:
    return reports.available_count(_stored(w))


@query("report_result_count", "SELECT count(*) AS results FROM result_site WHERE guesses > 0")
def report_result_count(w: World) -> DataFrame:
    return reports.result_count(_stored(w))


@query("report_guess_counts", """
SELECT CAST(0 AS BIGINT) AS guesses, count(*) AS results FROM result_site WHERE guesses = 0
UNION SELECT guesses, count(*) FROM result_site WHERE guesses > 0 GROUP BY guesses""")
def report_guess_counts(w: World) -> DataFrame:
    return reports.guess_counts(_stored(w))


@query("report_package_counts", "SELECT package_name, count(DISTINCT url) AS results FROM result_guess GROUP BY package_name")
def report_package_counts(w: World) -> DataFrame:
    return reports.package_counts(reports.guesses(_stored(w)))


@query("report_distinct_packages", """
SELECT CAST(0 AS BIGINT) AS packages, count(*) AS results FROM result_site WHERE guesses = 0
UNION SELECT n, count(*) FROM (SELECT url, count(DISTINCT package_name) AS n FROM result_guess GROUP BY url) GROUP BY n""")
def report_distinct_packages(w: World) -> DataFrame:
    results = _stored(w)
    return reports.distinct_package_counts(results, reports.guesses(results))


_BY_URL_SQL = """,
by_url AS (
    SELECT s.site_id, s.url, arg_min(g.package_name, g.version_id) AS package_name FROM result_site s
    JOIN result_guess g USING (site_id) GROUP BY s.site_id, s.url),
flags AS (
    SELECT site_id, arg_max(vulnerable, {'d': release_date, 'v': version_id}) AS most_recent, bool_and(vulnerable) AS all_versions,
           bool_or(vulnerable) AS any_version
    FROM result_version GROUP BY site_id),
rated AS (
    SELECT b.*, coalesce(most_recent, FALSE) AS most_recent, coalesce(all_versions, TRUE) AS all_versions,
           coalesce(any_version, FALSE) AS any_version
    FROM by_url b LEFT JOIN flags USING (site_id))
"""


@query("report_vulnerable", _BY_URL_SQL + """
SELECT (SELECT count(*) FROM result_site) AS total, count(*) AS total_with_guess, count(*) FILTER (most_recent) AS most_recent_vulnerable,
       count(*) FILTER (all_versions) AS all_vulnerable, count(*) FILTER (any_version) AS any_vulnerable FROM rated""")
def report_vulnerable(w: World) -> DataFrame:
    results = _stored(w)
    rows = w.workspace("report").save(reports.guesses(results), "guesses")
    by_url = reports.vulnerability_by_url(rows, w.packages, w.versions, w.vulnerable)
    return reports.vulnerable_totals(results, by_url)


@query("report_vulnerable_by_package", _BY_URL_SQL + """
SELECT package_name, count(*) AS total, count(*) FILTER (most_recent) AS most_recent_vulnerable,
       count(*) FILTER (all_versions) AS all_vulnerable, count(*) FILTER (any_version) AS any_vulnerable FROM rated GROUP BY package_name""")
def report_vulnerable_by_package(w: World) -> DataFrame:
    rows = w.workspace("report").save(reports.guesses(_stored(w)), "guesses")
    by_url = reports.vulnerability_by_url(rows, w.packages, w.versions, w.vulnerable)
    return reports.vulnerable_by_package(by_url)


@query("evaluate_scan", _BY_URL_SQL + """
SELECT 'available' AS report, '' AS key, count(*) AS results FROM result_site
UNION ALL SELECT 'with guesses', '', count(*) FROM result_site WHERE guesses > 0
UNION ALL SELECT 'guesses', CAST(guesses AS VARCHAR), count(*) FROM result_site GROUP BY guesses
UNION ALL SELECT 'package', package_name, count(DISTINCT url) FROM result_guess GROUP BY package_name
UNION ALL SELECT 'packages', CAST(n AS VARCHAR), count(*) FROM (
    SELECT s.url, count(DISTINCT g.package_name) AS n FROM result_site s LEFT JOIN result_guess g USING (site_id) GROUP BY s.url) GROUP BY n
UNION ALL SELECT 'vulnerable', 'total', count(*) FROM result_site
UNION ALL SELECT 'vulnerable', 'total_with_guess', count(*) FROM rated
UNION ALL SELECT 'vulnerable', 'most_recent_vulnerable', count(*) FROM rated WHERE most_recent
UNION ALL SELECT 'vulnerable', 'all_vulnerable', count(*) FROM rated WHERE all_versions
UNION ALL SELECT 'vulnerable', 'any_vulnerable', count(*) FROM rated WHERE any_version""")
def evaluate_scan(w: World) -> DataFrame:
    """All reports of a scan as one table."""
    return evaluate.evaluate_scan(_stored(w), w.index, w.vulnerable, w.workspace("evaluate"))


# --- whole scans and streams -------------------------------------------------


def content_crawl(w: World) -> tuple[DataFrame, DataFrame, index_store.Index, DataFrame]:
    """Sites, crawl with bodies, index and rules of the content world.

    A user is a site whose main page has a generator tag of its language and refers to
    the paths of the user's events as scripts.
    """
    documents = w.table("documents")
    host = F.concat(F.lit("http://u"), F.col("site_id").cast("string"), F.lit(".example"))
    events = w.table("events").select(F.col("user_id").alias("site_id"), F.get_json_object("props", "$.k").alias("k")).distinct()
    runs = events.select("site_id").distinct().join(documents, F.col("site_id") == F.col("doc_id")).select(
        "site_id", "lang", content_version(F.col("lang"), F.col("source")).alias("version_id")
    )
    links = events.groupBy("site_id").agg(
        F.array_join(F.sort_array(F.collect_set(F.concat(F.lit('<script src="/p'), "k", F.lit('.js"></script>')))), "").alias("links")
    )
    headers = F.array().cast("array<struct<name: string, value: string>>").alias("headers")
    pages = runs.join(links, "site_id").select(
        host.alias("url"), F.concat(host, F.lit("/")).alias("final_url"), F.lit(200).alias("status"), headers,
        F.encode(F.concat(F.lit('<html><head><meta name="generator" content="'), "lang", F.lit('"></head>'), "links", F.lit("</html>")), "UTF-8").alias("body"),
    )
    files = documents.select(
        content_version(F.col("lang"), F.col("source")).alias("version_id"),
        F.concat(F.lit("p"), (F.col("doc_id") / 20).cast("bigint").cast("string"), F.lit(".js")).alias("path"), "text", "lang", "source",
    )
    served = files.groupBy("version_id", "path").agg(F.max("text").alias("text"))
    bodies = runs.join(served, "version_id").select(
        F.concat(host, F.lit("/"), "path").alias("url"), F.concat(host, F.lit("/"), "path").alias("final_url"),
        F.lit(200).alias("status"), headers, F.encode("text", "UTF-8").alias("body"),
    )
    from filespoor.functions.fingerprint import raw_checksum

    summed = files.select("version_id", F.col("path").alias("src_path"), F.col("path").alias("webroot_path"),
                          raw_checksum(F.encode("text", "UTF-8")).alias("checksum"))
    keyed = summed.select("version_id", F.xxhash64("src_path", "webroot_path", "checksum").alias("file_id"), "src_path", "webroot_path", "checksum").distinct()
    languages = documents.select("lang").distinct().select(
        F.xxhash64("lang").alias("package_id"), F.col("lang").alias("name"), F.lit("docs").alias("vendor"),
        F.array().cast("array<string>").alias("alternative_names"),
    )
    versions = w.doc_versions.select(
        "version_id", F.xxhash64("package").alias("package_id"), "name", F.col("name").alias("internal_identifier"),
        F.timestamp_seconds(F.lit(1_500_000_000) + F.col("version_id") * 86400).alias("release_date"),
        F.lit("2020-01-01").cast("timestamp").alias("indexed"),
    )
    index = index_store.Index(
        languages, versions, keyed.drop("version_id").distinct(), keyed.select("version_id", "file_id")
    )
    site_list = runs.select("site_id", host.alias("url"))
    # each language is named by its generator tag and by a pattern of the page
    rules = languages.select(
        F.col("name").alias("app"), F.explode(F.array(
            F.struct(F.lit("meta").alias("kind"), F.lit("Generator").alias("field"), F.col("name").alias("pattern")),
            F.struct(F.lit("html").alias("kind"), F.lit(None).cast("string").alias("field"), F.concat(F.lit('content="'), "name", F.lit('"')).alias("pattern")),
        )).alias("rule")
    ).select("app", "rule.*")
    return site_list, pages.unionByName(bodies), index, rules


@query("scan_batch")
def scan_batch(w: World) -> DataFrame:
    """Scan results with their version sets kept apart; lengths are those of the whole documents."""
    results, sets = _scan(w)
    chars = scan_results.expanded_chars(results.select("url", "result"), ["url"], sets)
    return results.join(chars, "url").select(
        "url", F.col("result_chars").cast("int").alias("result_chars"),
        F.coalesce(F.json_array_length(reports.outcome()), F.lit(0)).alias("guesses"),
        F.get_json_object("result", "$.more_recent.name").alias("more_recent"),
    )


def _scan(w: World) -> tuple[DataFrame, DataFrame]:
    space = w.workspace("scan")
    site_list, crawl_rows, index, rules = content_crawl(w)
    saved = index_store.Index(**{
        name: space.save(getattr(index, name), name) for name in ("packages", "versions", "files", "uses")
    })
    tables = index_store.stage_match_tables(saved, space)
    stored = w.spark.createDataFrame([], schema.SCAN_RESULT)
    path = space.folder("version-sets")
    results = scan.scan_batch(
        space.save(site_list, "site-list"), space.save(crawl_rows, "crawl"), rules, saved, tables, stored, "content", space, sets_path=path
    )
    return space.save(results, "results"), scan_results.read_sets(w.spark, path)


def _stream(w: World, table: str) -> DataFrame:
    """A table as a file stream; it is one file or a folder of files, which a pattern covers both."""
    return w.spark.readStream.schema(w.table(table).schema).parquet(f"{w.folder}/{{{table}.parquet}}")


_YEAR = 365 * 24 * 3600  # seconds


@query("incremental_scan", """
SELECT concat('http://u', CAST(user_id AS VARCHAR), '.example') AS url, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'false' ELSE 'array' END AS outcome,
       count(DISTINCT json_extract_string(props, '$.k')) AS paths
FROM events GROUP BY user_id""")
def incremental_scan(w: World) -> DataFrame:
    """The event log as a stream of crawl rows, scanned once per site.

    The rows of a site come in several batches and wait as state until the end of the log is told. The outcome of a site is
    a count over its rows here, so that it can be checked.
    """
    space = w.workspace("stream")
    results, landing, progress = space.folder("results"), space.folder("landing"), space.folder("progress")
    crawled = w.table("events").select("user_id", "event_type", "props", F.col("ts").cast("timestamp").alias("fetched"))
    crawled.repartition(4).write.parquet(landing)
    settling.clock_row(crawled, "fetched", 300 * _YEAR).write.mode("append").parquet(landing)

    def scan_rows(batch: DataFrame) -> DataFrame:
        per_site = batch.groupBy("user_id").agg(
            F.count_if(F.col("event_type") == "error").alias("errors"),
            F.count_distinct(F.get_json_object("props", "$.k")).alias("paths"),
        )
        document = F.when(F.col("errors") > 0, F.concat(F.lit('{"result":false,"paths":'), F.col("paths").cast("string"), F.lit("}"))).otherwise(
            F.concat(F.lit('{"result":[],"paths":'), F.col("paths").cast("string"), F.lit("}"))
        )
        return per_site.select(
            F.concat(F.lit("http://u"), F.col("user_id").cast("string"), F.lit(".example")).alias("url"),
            F.current_timestamp().alias("scan_time"), document.alias("result"),
        )

    source = w.spark.readStream.schema(crawled.schema).option("maxFilesPerTrigger", 2).parquet(landing)
    # a site may be in the whole log
    incremental.settled_scan(source, "user_id", "fetched", 100 * _YEAR, scan_rows, results, progress, "events", space)
    # a second run has nothing to do
    incremental.settled_scan(source, "user_id", "fetched", 100 * _YEAR, scan_rows, results, progress, "events", space)
    stored = scan_results.read_results(w.spark, results)
    return stored.select(
        "url", F.when(reports.outcome() == "false", "false").otherwise("array").alias("outcome"),
        F.get_json_object("result", "$.paths").cast("bigint").alias("paths"),
    )


@query("incremental_index", """
SELECT version_id, count(DISTINCT concat(webroot_path, ':', checksum)) AS files, count(DISTINCT checksum) AS checksums FROM doc_file GROUP BY version_id""")
def incremental_index(w: World) -> DataFrame:
    """The documents as a stream of release files, fingerprinted per batch."""
    from filespoor.functions.fingerprint import raw_checksum

    space = w.workspace("stream")
    path = space.folder("index")
    source = _stream(w, "documents")

    def fingerprint(batch: DataFrame) -> DataFrame:
        return batch.select(
            content_version(F.col("lang"), F.col("source")).alias("version_id"),
            F.concat(F.lit("p"), (F.col("doc_id") / 20).cast("bigint").cast("string")).alias("webroot_path"),
            raw_checksum(F.encode("text", "UTF-8")).alias("checksum"),
        ).distinct()

    incremental.incremental_index(source, fingerprint, path, space.folder("progress"))
    return w.spark.read.parquet(path).groupBy("version_id").agg(
        F.count(F.lit(1)).alias("files"), F.count_distinct("checksum").alias("checksums")
    )
