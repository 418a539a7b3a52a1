"""The given tables seen as a fingerprint index, site observations and content.

Two worlds are used. In the *parts* world, nations are packages, suppliers are versions,
parts are files and orders are sites. In the *content* world, languages are packages,
the sources of each language are versions, documents are files with real content, and
users of the event log are sites. ``SQL`` holds the same views for the check queries.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from filespoor.operators.index import version_files
from filespoor.session import Workspace
from filespoor.sources.index_store import Index, MatchTables, match_tables


def _release_name(key: Column, balance: Column) -> Column:
    number = F.floor(F.abs(balance) / 100).cast("bigint")
    suffix = F.when(balance < 0, F.lit("-rc1")).otherwise(F.lit(""))
    return F.concat((key % 3).cast("string"), F.lit("."), number.cast("string"), suffix)


class World:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def workspace(self, label: str) -> Workspace:
        return Workspace(self.spark, label)

    # --- parts world ---------------------------------------------------------

    @cached_property
    def packages(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("n_nationkey").cast("bigint").alias("package_id"),
            F.col("n_name").alias("name"),
            F.col("r_name").alias("vendor"),
            F.array(F.lower("n_name"), F.concat(F.lit("alt-"), F.col("n_nationkey").cast("string"))).alias(
                "alternative_names"
            ),
        )

    @cached_property
    def versions(self) -> DataFrame:
        key, balance = F.col("s_suppkey"), F.col("s_acctbal")
        day = F.date_add(F.lit("1995-01-01").cast("date"), (key * 37 % 3000).cast("int"))
        return self.table("supplier").select(
            key.alias("version_id"),
            F.col("s_nationkey").cast("bigint").alias("package_id"),
            _release_name(key, balance).alias("name"),
            F.col("s_name").alias("internal_identifier"),
            day.cast("timestamp").alias("release_date"),
            F.when(balance >= 0, F.lit("2020-01-01").cast("timestamp")).alias("indexed"),
        )

    @cached_property
    def files(self) -> DataFrame:
        size = F.col("p_size").cast("string")
        return self.table("part").select(
            F.col("p_partkey").alias("file_id"),
            F.concat_ws("/", "p_brand", "p_name").alias("src_path"),
            F.concat_ws("/", F.col("p_type"), size, F.col("p_brand")).alias("webroot_path"),
            F.md5(F.concat_ws("|", F.col("p_name"), F.col("p_brand"), size)).alias("checksum"),
        )

    @cached_property
    def uses(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("version_id"), F.col("l_partkey").alias("file_id")
        ).distinct()

    @cached_property
    def index(self) -> Index:
        return Index(self.packages, self.versions, self.files, self.uses)

    @cached_property
    def used_files(self) -> DataFrame:
        return version_files(self.files, self.uses)

    @cached_property
    def tables(self) -> MatchTables:
        return match_tables(self.index)

    @cached_property
    def assets(self) -> DataFrame:
        served = F.col("l_returnflag") != "R"
        return (
            self.table("lineitem")
            .join(self.files, F.col("l_partkey") == F.col("file_id"))
            .select(
                F.col("l_orderkey").alias("site_id"),
                "webroot_path",
                served.alias("success"),
                F.when(served, F.col("checksum")).alias("checksum"),
            )
            .distinct()
        )

    @cached_property
    def cves(self) -> DataFrame:
        customer, nation = self.table("customer"), self.table("nation")
        return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.concat(F.lit("CVE-"), F.col("c_custkey").cast("string")).alias("cve_id"),
            F.lower("c_mktsegment").alias("vendor"),
            F.upper("n_name").alias("product_name"),
            _release_name(F.col("c_custkey"), F.col("c_acctbal")).alias("version_value"),
        )

    @cached_property
    def vulnerable(self) -> DataFrame:
        from filespoor.operators.cve import cve_versions

        return cve_versions(self.cves, self.packages, self.versions)

    @cached_property
    def guess_rows(self) -> DataFrame:
        """Stored guesses: orders that are not pending have their suppliers as guesses."""
        orders, lines = self.table("orders"), self.table("lineitem")
        has_result = F.col("o_orderstatus") != "P"
        return (
            orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
            .select(
                F.col("o_orderkey").alias("site_id"),
                has_result.alias("has_result"),
                F.when(has_result, F.col("l_suppkey")).alias("version_id"),
            )
            .distinct()
        )

    @cached_property
    def scan_results(self) -> DataFrame:
        """Result documents for ``guess_rows``; pending orders and orders without lines have none."""
        from filespoor.sources.scan_results import result_documents, version_json

        named = self.versions.join(
            self.packages.withColumnRenamed("name", "package_name"), "package_id"
        ).select(
            "version_id",
            F.struct(
                version_json(
                    F.col("package_name"), F.col("vendor"), F.col("alternative_names"),
                    F.col("name"), F.col("internal_identifier"), F.col("release_date"),
                ).alias("software_version")
            ).alias("guess"),
        )
        rows = self.guess_rows
        guesses = rows.join(named, "version_id").select(
            "site_id", F.col("version_id").alias("rank"), "guess"
        )
        nothing_newer = rows.select(
            "site_id", F.lit(None).cast("string").alias("more_recent")
        ).filter(F.lit(False))
        documents = result_documents(rows.select("site_id").distinct(), guesses, nothing_newer)
        return documents.select(
            site_url(F.col("site_id")).alias("url"),
            F.lit("2020-01-01").cast("timestamp").alias("scan_time"),
            "result",
            F.lit("orders").alias("scan_identifier"),
        )

    # --- content world -------------------------------------------------------

    @cached_property
    def doc_versions(self) -> DataFrame:
        """Versions are the sources of a language; ids count sources within languages."""
        return self.table("documents").select("lang", "source").distinct().select(
            content_version(F.col("lang"), F.col("source")).alias("version_id"),
            F.col("lang").alias("package"),
            F.col("source").alias("name"),
        )

    @cached_property
    def doc_files(self) -> DataFrame:
        """``(version_id, file_id, webroot_path, checksum)``, one row per document."""
        return self.table("documents").select(
            content_version(F.col("lang"), F.col("source")).alias("version_id"),
            F.concat(F.lit("p"), (F.col("doc_id") / 20).cast("bigint").cast("string")).alias("webroot_path"),
            F.md5("text").alias("checksum"),
        )

    @cached_property
    def doc_uses(self) -> DataFrame:
        """Uses of distinct files; the path with the checksum names a file."""
        return self.doc_files.select(
            "version_id", F.concat_ws(":", "webroot_path", "checksum").alias("file_id")
        ).distinct()

    @cached_property
    def doc_index_files(self) -> DataFrame:
        return self.doc_files.select("webroot_path", "checksum").distinct()


def site_url(site: Column) -> Column:
    return F.concat(F.lit("http://site"), site.cast("string"), F.lit(".example/"))


def content_version(lang: Column, source: Column) -> Column:
    place = F.when(lang == "en", 0).when(lang == "fr", 1).when(lang == "de", 2).when(lang == "es", 3).otherwise(4)
    return (place * 1000 + F.regexp_extract(source, r"(\d+)", 1).cast("bigint")).cast("bigint")


SQL = """
WITH software_package AS (
    SELECT CAST(n_nationkey AS BIGINT) AS package_id, n_name AS name, r_name AS vendor,
           [lower(n_name), concat('alt-', CAST(n_nationkey AS VARCHAR))] AS alternative_names
    FROM nation JOIN region ON n_regionkey = r_regionkey),
software_version AS (
    SELECT s_suppkey AS version_id, CAST(s_nationkey AS BIGINT) AS package_id,
           concat(CAST(s_suppkey % 3 AS VARCHAR), '.',
                  CAST(CAST(floor(abs(s_acctbal) / 100) AS BIGINT) AS VARCHAR),
                  CASE WHEN s_acctbal < 0 THEN '-rc1' ELSE '' END) AS name,
           s_name AS internal_identifier,
           CAST(DATE '1995-01-01' + CAST(s_suppkey * 37 % 3000 AS INTEGER) AS TIMESTAMP) AS release_date,
           s_acctbal >= 0 AS is_indexed
    FROM supplier),
name_key AS (
    SELECT package_id, lower(name) AS name_key FROM software_package
    UNION SELECT package_id, lower(unnest(alternative_names)) FROM software_package),
static_file AS (
    SELECT p_partkey AS file_id, concat(p_brand, '/', p_name) AS src_path,
           concat(p_type, '/', CAST(p_size AS VARCHAR), '/', p_brand) AS webroot_path,
           md5(concat(p_name, '|', p_brand, '|', CAST(p_size AS VARCHAR))) AS checksum
    FROM part),
static_file_use AS (SELECT DISTINCT l_suppkey AS version_id, l_partkey AS file_id FROM lineitem),
used_file AS (SELECT * FROM static_file_use JOIN static_file USING (file_id)),
checksum_version AS (SELECT DISTINCT checksum, version_id FROM used_file),
path_version AS (SELECT DISTINCT webroot_path, version_id FROM used_file),
path_checksum AS (SELECT DISTINCT version_id, webroot_path, checksum FROM used_file),
idf AS (
    SELECT checksum, CAST(round(ln((SELECT count(*) FROM software_version)::DOUBLE / count(*)) / ln(10.0)
                                * 1000000) AS BIGINT) AS weight_micro
    FROM checksum_version GROUP BY checksum),
asset AS (
    SELECT DISTINCT l_orderkey AS site_id, webroot_path, l_returnflag <> 'R' AS success,
           CASE WHEN l_returnflag <> 'R' THEN checksum END AS checksum
    FROM lineitem JOIN static_file ON l_partkey = file_id),
asset_match AS (
    SELECT a.site_id, a.webroot_path, a.success, a.checksum, m.version_id, bool_or(m.is_using) AS is_using
    FROM asset a JOIN (
        SELECT DISTINCT a1.webroot_path AS p, a1.checksum AS c, v.version_id, TRUE AS is_using
        FROM asset a1 JOIN checksum_version v ON v.checksum = a1.checksum
        UNION ALL
        SELECT DISTINCT a2.webroot_path, a2.checksum, v.version_id, FALSE
        FROM asset a2 JOIN path_version v ON v.webroot_path = a2.webroot_path) m
    ON m.p = a.webroot_path AND m.c IS NOT DISTINCT FROM a.checksum
    GROUP BY ALL),
weighted AS (
    SELECT m.*, CASE WHEN NOT m.success THEN 1000000 ELSE coalesce(i.weight_micro, 1000000) END AS weight_micro
    FROM asset_match m LEFT JOIN idf i ON i.checksum = m.checksum),
score AS (
    SELECT site_id, version_id,
           CAST(sum(CASE WHEN is_using THEN weight_micro ELSE 0 END) AS BIGINT) AS pos_micro,
           CAST(sum(CASE WHEN is_using THEN 0 ELSE weight_micro END) AS BIGINT) AS neg_micro,
           count(*) FILTER (is_using) AS n_pos, count(*) FILTER (NOT is_using) AS n_neg
    FROM weighted GROUP BY site_id, version_id),
strength AS (SELECT *, pos_micro * 1000 + neg_micro * 100 AS strength_nano FROM score),
ranked_guess AS (
    SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY strength_nano DESC, version_id) AS rank
    FROM strength),
top_guess AS (
    SELECT *, first_value(strength_nano / 1e9) OVER w AS best, first_value(pos_micro / 1e6) OVER w AS best_pos
    FROM ranked_guess WHERE rank <= 7
    WINDOW w AS (PARTITION BY site_id ORDER BY rank)),
best_guess AS (
    SELECT site_id, version_id, pos_micro, neg_micro, n_pos, n_neg, strength_nano, CAST(rank AS INTEGER) AS rank
    FROM top_guess
    WHERE best_pos < 2 OR strength_nano / 1e9 >= least(CAST(0.7 AS DOUBLE) * best, best - 3)),
site_support AS (
    SELECT site_id, min(strength_nano) FILTER (rank = 1) AS best_nano, count(*) AS n_guesses,
           any_value(n_assets) AS n_assets
    FROM best_guess JOIN (SELECT site_id, count(*) AS n_assets FROM asset GROUP BY site_id) USING (site_id)
    GROUP BY site_id),
cve AS (
    SELECT concat('CVE-', CAST(c_custkey AS VARCHAR)) AS cve_id, lower(c_mktsegment) AS vendor,
           upper(n_name) AS product_name,
           concat(CAST(c_custkey % 3 AS VARCHAR), '.',
                  CAST(CAST(floor(abs(c_acctbal) / 100) AS BIGINT) AS VARCHAR),
                  CASE WHEN c_acctbal < 0 THEN '-rc1' ELSE '' END) AS version_value
    FROM customer JOIN nation ON c_nationkey = n_nationkey),
cve_version AS (
    SELECT DISTINCT c.cve_id, v.version_id
    FROM cve c JOIN name_key k ON k.name_key = lower(c.product_name)
    JOIN software_version v ON v.package_id = k.package_id AND lower(v.name) = lower(c.version_value)
    WHERE v.is_indexed),
guess_row AS (
    SELECT DISTINCT o_orderkey AS site_id, o_orderstatus <> 'P' AS has_result,
           CASE WHEN o_orderstatus <> 'P' THEN l_suppkey END AS version_id
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey),
result_guess AS (
    SELECT g.site_id, concat('http://site', CAST(g.site_id AS VARCHAR), '.example/') AS url, g.version_id,
           v.name AS version_name, v.package_id, p.name AS package_name
    FROM guess_row g JOIN software_version v USING (version_id) JOIN software_package p USING (package_id)),
result_site AS (
    SELECT site_id, concat('http://site', CAST(site_id AS VARCHAR), '.example/') AS url,
           count(version_id) AS guesses
    FROM guess_row GROUP BY site_id),
result_version AS (
    SELECT DISTINCT g.site_id, g.url, v.version_id, v.release_date,
           v.version_id IN (SELECT version_id FROM cve_version) AS vulnerable
    FROM result_guess g JOIN name_key k ON k.name_key = lower(g.package_name)
    JOIN software_version v ON v.package_id = k.package_id AND lower(v.name) = lower(g.version_name)
    WHERE v.is_indexed),
doc_file AS (
    SELECT CAST((CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 WHEN 'es' THEN 3 ELSE 4 END) * 1000
                + CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) AS BIGINT) AS version_id,
           lang, source, doc_id, concat('p', CAST(doc_id // 20 AS VARCHAR)) AS webroot_path, md5(text) AS checksum
    FROM documents),
doc_use AS (SELECT DISTINCT version_id, concat(webroot_path, ':', checksum) AS file_id FROM doc_file)
"""
