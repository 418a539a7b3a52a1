"""Queries on observed sites: signals, matching, scoring, inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from filespoor.functions import urls
from filespoor.functions.html import page_signals
from filespoor.functions.text import basename, clean_path_name, default_scheme, file_type
from filespoor.operators import index as ops, matching, recency, scoring, signals, version_sets
from filespoor.operators.skew import expanding_join
from filespoor.params import InferenceParams
from filespoor.plans import infer
from filespoor.plans.infer import infer_sites
from filespoor.sources import crawl, index_store
from filespoor.world.registry import query
from filespoor.world.views import World

PARAMS = InferenceParams()


# --- URLs and names ----------------------------------------------------------

_PAGE_URL_SQL = """,
page_url AS (
    SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
           regexp_extract(url, '^[a-z]+://[^/?#]*([^?#;]*)', 1) AS path FROM pages)
"""


@query("crawl_scan", """
SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 404 WHEN 'A' THEN 200 END AS status, l_returnflag = 'A' AS success
FROM lineitem""")
def crawl_scan(w: World) -> DataFrame:
    flag = F.col("l_returnflag")
    responses = w.table("lineitem").select(
        "l_orderkey", "l_linenumber", F.when(flag == "R", 404).when(flag == "A", 200).alias("status")
    )
    return crawl.with_success(responses)


@query("resource_archive", _PAGE_URL_SQL + """,
keyed AS (
    SELECT page_id, url, regexp_replace(replace(url, '/', '_'), '[^A-Za-z0-9\\-_.()=\\[\\]{}\\\\]', '', 'g') AS site_dir,
           concat(scheme, '_', host) AS host_dir,
           regexp_replace(replace(substr(path, 2), '/', '_'), '[^A-Za-z0-9\\-_.()=\\[\\]{}\\\\]', '', 'g') AS name FROM page_url)
SELECT page_id, site_dir, substr(sha1(site_dir), 1, 2) AS shard1, substr(sha1(site_dir), 3, 2) AS shard2, host_dir,
       CASE WHEN name = '' THEN '__index__' ELSE name END AS file_name FROM keyed""")
def resource_archive(w: World) -> DataFrame:
    pages = w.table("pages").select("page_id", "url", F.col("url").alias("site_url"))
    return crawl.archive_keys(pages).select("page_id", "site_dir", "shard1", "shard2", "host_dir", "file_name")


@query("webroot_path", _PAGE_URL_SQL + "SELECT page_id, path, host, scheme FROM page_url")
def webroot_path(w: World) -> DataFrame:
    url = F.col("url")
    return w.table("pages").select(
        "page_id", urls.webroot_path(url, strict=True).alias("path"), urls.authority(url).alias("host"),
        urls.scheme(url).alias("scheme"),
    )


@query("join_url", _PAGE_URL_SQL + """
SELECT page_id, concat(scheme, '://', host, '/', CASE WHEN path IN ('', '/') THEN '' ELSE concat(trim(path, '/'), '/') END, 'favicon.ico') AS favicon,
       concat(scheme, '://', host, '/b.css') AS beside
FROM page_url""")
def join_url(w: World) -> DataFrame:
    host = F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.authority(F.col("url")))
    return w.table("pages").select(
        "page_id",
        urls.join_url(F.col("url"), F.lit("favicon.ico")).alias("favicon"),
        urls.join_url(host, F.lit("a/./c"), F.lit("../../b.css")).alias("beside"),
    )


@query("join_paths", """
SELECT p_partkey, concat(p_brand, '/', p_type, '/', p_name) AS path FROM part""")
def join_paths(w: World) -> DataFrame:
    joined = urls.join_paths(F.col("p_brand"), F.concat(F.lit("/"), "p_type", F.lit("/")), F.concat(F.lit("/"), "p_name"))
    return w.table("part").select("p_partkey", joined.alias("path"))


@query("default_scheme", """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE concat('http://', regexp_replace(url, '^https?://', '')) END AS url FROM pages""")
def default_scheme_query(w: World) -> DataFrame:
    bare = F.regexp_replace("url", "^https?://", "")
    listed = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(bare)
    return w.table("pages").select("page_id", default_scheme(listed).alias("url"))


_HREF_SQL = """,
href AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1)) AS ref FROM pages)
"""


def _refs(w: World) -> DataFrame:
    parsed = page_signals(w.table("pages"), "page_id", "html", ("a",))
    return parsed.select("page_id", F.explode(F.array_distinct("refs")).alias("ref"))


@query("scheme_filter", _HREF_SQL + """
SELECT page_id, ref FROM href WHERE regexp_extract(ref, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) IN ('', 'http', 'https')""")
def scheme_filter(w: World) -> DataFrame:
    return _refs(w).filter(signals.keep_scheme(F.col("ref")))


@query("classify_for_analysis", """,
name AS (
    SELECT l_orderkey, l_linenumber, CASE l_linenumber % 7 WHEN 0 THEN concat('a/', l_shipmode_like, '.JS?v=1')
        WHEN 1 THEN '.hidden' WHEN 2 THEN 'README' WHEN 3 THEN 'x/index.html' WHEN 4 THEN 'logo.Png'
        WHEN 5 THEN '.a.json' ELSE 'pack.tar' END AS url
    FROM (SELECT *, l_linestatus AS l_shipmode_like FROM lineitem))
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 7 WHEN 0 THEN 'javascript' WHEN 1 THEN 'dotfile' WHEN 4 THEN 'image'
    WHEN 5 THEN 'json' END AS file_type FROM name""")
def classify_for_analysis(w: World) -> DataFrame:
    place = F.col("l_linenumber") % 7
    url = (
        F.when(place == 0, F.concat(F.lit("a/"), "l_linestatus", F.lit(".JS?v=1"))).when(place == 1, ".hidden")
        .when(place == 2, "README").when(place == 3, "x/index.html").when(place == 4, "logo.Png")
        .when(place == 5, ".a.json").otherwise("pack.tar")
    )
    return w.table("lineitem").select(
        "l_orderkey", "l_linenumber", file_type(basename(url), analysis_only=True).alias("file_type")
    )


@query("clean_path_name", """
SELECT doc_id, regexp_replace(replace(text, '/', '_'), '[^A-Za-z0-9\\-_.()=\\[\\]{}\\\\]', '', 'g') AS name FROM documents""")
def clean_path_name_query(w: World) -> DataFrame:
    return w.table("documents").select("doc_id", clean_path_name(F.col("text")).alias("name"))


@query("included_assets", _PAGE_URL_SQL + _HREF_SQL + """
,
ref AS (
    SELECT page_id, ref FROM href
    UNION SELECT page_id, unnest(['css/site.CSS', 'https://cdn.example/lib.js?v=1', 'mailto:me@example.com', 'data.unknown', '.htaccess', 'ftp://x.example/a.js']) FROM pages),
typed AS (
    SELECT *, regexp_extract(ref, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS own_scheme, split_part(regexp_extract(ref, '[^/]*$'), '?', 1) AS name FROM ref)
SELECT DISTINCT h.page_id AS site_id, CASE WHEN own_scheme <> '' THEN ref ELSE
    concat(scheme, '://', host, '/', CASE WHEN path IN ('', '/') THEN '' ELSE concat(trim(path, '/'), '/') END, ltrim(ref, '/')) END AS url
FROM typed h JOIN page_url USING (page_id)
WHERE own_scheme IN ('', 'http', 'https') AND (NOT contains(name, '.') OR starts_with(name, '.') OR lower(regexp_extract(name, '[^.]*$')) IN (
    'conf', 'dist', 'ini', 'css', 'less', 'scss', 'ttf', 'mo', 'po', 'htm', 'html', 'xhtml', 'gif', 'ico', 'jpeg', 'jpg', 'png', 'svg', 'js', 'json',
    'swf', 'xap', 'markdown', 'md', 'rst', 'txt', 'xml', 'yaml', 'yml'))""")
def included_assets(w: World) -> DataFrame:
    """All links of the pages, with some of other kinds added to each page."""
    pages = w.table("pages").repartition(w.spark.sparkContext.defaultParallelism)
    parsed = page_signals(pages, "page_id", "html", ("a",), ("url",))
    added = ("css/site.CSS", "https://cdn.example/lib.js?v=1", "mailto:me@example.com", "data.unknown", ".htaccess", "ftp://x.example/a.js")
    linked = parsed.select(F.col("page_id").alias("site_id"), "url", F.concat("refs", F.array(*map(F.lit, added))).alias("refs"))
    return signals.included_assets(linked, F.col("url"), analysis_only=False)


# --- page signals ------------------------------------------------------------

_RULE_SQL = """,
digit AS (SELECT n_name AS app, concat('<!-- AD \\d*', CAST(n_nationkey % 10 AS VARCHAR), ' -->') AS pattern FROM nation),
matched AS (
    SELECT page_id AS site_id, app FROM pages JOIN digit ON regexp_matches(html, concat('(?i)', pattern))
    UNION SELECT page_id, 'alt-1' FROM pages WHERE regexp_matches(url, '^https')
    UNION SELECT page_id, 'alt-2' FROM pages WHERE regexp_matches(html, '<meta charset="utf-8">')
    UNION SELECT page_id, 'alt-3' FROM pages WHERE regexp_matches(url, '(?i)PAGE=\\d+'))
"""


def _rule_matches(w: World) -> DataFrame:
    """Rules from the nations on the text of pages, and on headers and script sources made from their URL."""
    rules = w.table("nation").select(
        F.col("n_name").alias("app"), F.lit("html").alias("kind"), F.lit(None).cast("string").alias("field"),
        F.concat(F.lit("<!-- AD \\d*"), (F.col("n_nationkey") % 10).cast("string"), F.lit(" -->\\;version:\\1")).alias("pattern"),
    ).union(
        w.spark.createDataFrame(
            [("alt-1", "headers", "X-Scheme", "HTTPSS"), ("alt-2", "meta", "CHARSET", "UTF"), ("alt-3", "script", None, "PAGE=\\d+")],
            "app STRING, kind STRING, field STRING, pattern STRING",
        )
    )
    pages = w.table("pages")
    text = pages.select(
        F.col("page_id").alias("site_id"), "html",
        F.array(F.struct(F.lit("x-scheme").alias("name"), F.concat(urls.scheme(F.col("url")), F.lit("s")).alias("value"))).alias("headers"),
        F.when(F.contains("html", F.lit('<meta charset="utf-8">')),
               F.array(F.struct(F.lit("charset").alias("name"), F.lit("utf-8").alias("content")))).alias("metas"),
        F.array(F.lit(""), "url").alias("script_srcs"),
    )
    return signals.tech_rule_match(text, rules)


@query("tech_rule_match", _RULE_SQL + "SELECT site_id, app FROM matched")
def tech_rule_match(w: World) -> DataFrame:
    return _rule_matches(w)


@query("rules_to_packages", _RULE_SQL + """
SELECT DISTINCT app, package_id FROM matched JOIN name_key ON name_key = lower(app)""")
def rules_to_packages(w: World) -> DataFrame:
    apps = _rule_matches(w).select("app").distinct()
    return signals.packages_by_any_name(apps, "app", w.packages)


_RULE_VERSION_SQL = _RULE_SQL + """,
by_rule AS (
    SELECT DISTINCT m.site_id, v.version_id FROM matched m JOIN name_key k ON k.name_key = lower(m.app)
    JOIN software_version v USING (package_id) WHERE v.is_indexed)
"""

_GENERATOR_SQL = """,
generator AS (
    SELECT page_id AS site_id, concat(CASE WHEN length(html) > 5000 THEN 'nation_' ELSE 'Nation-' END,
               CAST(page_id % 30 AS VARCHAR), CASE WHEN length(url) % 2 = 0 THEN ' 1.' WHEN length(url) % 3 = 0 THEN ' none' ELSE '' END) AS generator
    FROM pages),
option AS (
    SELECT g.site_id, g.generator, v.package_id, v.version_id,
           coalesce(contains(lower(v.name), nullif(split_part(g.generator, ' ', 2), '')), FALSE) AS hit
    FROM generator g JOIN software_package p ON lower(p.name) LIKE lower(split_part(g.generator, ' ', 1))
    JOIN software_version v ON v.package_id = p.package_id WHERE v.is_indexed),
by_generator AS (
    SELECT DISTINCT site_id, version_id FROM (
        SELECT *, bool_or(hit) OVER (PARTITION BY site_id, package_id) AS any_hit FROM option) WHERE hit OR NOT any_hit)
"""


def _generator_versions(w: World) -> DataFrame:
    """Pages with a generator tag of their own put in front of their markup."""
    length = F.length("url")
    text = F.concat(
        F.when(F.length("html") > 5000, "nation_").otherwise("Nation-"), (F.col("page_id") % 30).cast("string"),
        F.when(length % 2 == 0, " 1.").when(length % 3 == 0, " none").otherwise(""),
    )
    pages = w.table("pages").select(
        F.col("page_id").alias("site_id"),
        F.concat(F.lit("<META name='generator' content=\""), text, F.lit("\">"), "html").alias("html"),
    )
    parsed = page_signals(pages, "site_id", "html", ("link",))
    # the texts are read several times, the pages once
    texts = w.workspace("generators").save(signals.generator_texts(parsed), "texts")
    return signals.generator_versions(texts, w.packages, w.versions)


def _rule_versions(w: World) -> DataFrame:
    matches = w.workspace("rules").save(_rule_matches(w), "matches")
    return signals.rule_versions(matches, w.packages, w.versions)


@query("generator_versions", _GENERATOR_SQL + "SELECT site_id, version_id FROM by_generator")
def generator_versions(w: World) -> DataFrame:
    return _generator_versions(w)


@query("tech_rule_versions", _RULE_VERSION_SQL + "SELECT site_id, version_id FROM by_rule")
def tech_rule_versions(w: World) -> DataFrame:
    return _rule_versions(w)


@query("candidate_versions", _RULE_VERSION_SQL + _GENERATOR_SQL + """
SELECT site_id, version_id FROM by_rule UNION SELECT site_id, version_id FROM by_generator""")
def candidate_versions(w: World) -> DataFrame:
    return signals.candidate_versions(_rule_versions(w), _generator_versions(w))


# --- matching and scoring ----------------------------------------------------


@query("matchable_assets", """
SELECT site_id, webroot_path, checksum FROM asset WHERE success AND checksum IN (SELECT checksum FROM checksum_version)""")
def matchable_assets(w: World) -> DataFrame:
    return matching.matchable_assets(w.assets, w.tables.by_checksum).select("site_id", "webroot_path", "checksum")


@query("asset_version_matches", """
SELECT DISTINCT webroot_path, coalesce(checksum, '') AS checksum, version_id, is_using FROM asset_match""")
def asset_version_matches(w: World) -> DataFrame:
    return matching.kind_matches(matching.asset_kinds(w.assets), w.tables.by_checksum, w.tables.by_path)


_MOVED_SQL = """,
moved AS (
    SELECT DISTINCT l_orderkey AS site_id, concat(CASE WHEN l_linestatus = 'F' THEN 'shop/' WHEN l_shipdate < DATE '1998-01-01' THEN 'cms/' ELSE '' END,
           webroot_path) AS webroot_path, checksum
    FROM lineitem JOIN static_file ON l_partkey = file_id WHERE l_returnflag <> 'R'),
vote AS (
    SELECT site_id, base_path, count(*) AS votes FROM (
        SELECT DISTINCT m.site_id, m.webroot_path, m.checksum, CASE WHEN ends_with(f.webroot_path, m.webroot_path) THEN replace(f.webroot_path, m.webroot_path, '')
               WHEN ends_with(m.webroot_path, f.webroot_path) THEN concat('/', replace(m.webroot_path, f.webroot_path, '')) END AS base_path
        FROM moved m JOIN static_file f USING (checksum) WHERE f.webroot_path <> m.webroot_path)
    WHERE base_path IS NOT NULL GROUP BY ALL)
"""


def _votes(w: World) -> DataFrame:
    folder = F.when(F.col("l_linestatus") == "F", "shop/").when(F.col("l_shipdate") < F.lit("1998-01-01").cast("date"), "cms/").otherwise("")
    moved = (
        w.table("lineitem").filter("l_returnflag <> 'R'")
        .join(w.files, F.col("l_partkey") == F.col("file_id"))
        .select(
            F.col("l_orderkey").alias("site_id"), F.concat(folder, "webroot_path").alias("webroot_path"),
            F.lit(True).alias("success"), "checksum",
        ).distinct()
    )
    return matching.base_path_votes(moved, w.files)


@query("base_path_votes", _MOVED_SQL + "SELECT site_id, base_path, votes FROM vote")
def base_path_votes(w: World) -> DataFrame:
    return _votes(w)


@query("updated_base_path", _MOVED_SQL + """
SELECT site_id, arg_min(base_path, {'v': -votes, 'b': base_path}) AS base_path FROM vote GROUP BY site_id""")
def updated_base_path(w: World) -> DataFrame:
    return matching.updated_base_path(_votes(w))


@query("new_assets", """
SELECT DISTINCT a.l_orderkey AS site_id, concat('u', CAST(a.l_suppkey AS VARCHAR)) AS url FROM lineitem a
WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_returnflag = 'R' AND b.l_orderkey = a.l_orderkey AND b.l_suppkey = a.l_suppkey)""")
def new_assets(w: World) -> DataFrame:
    url = F.concat(F.lit("u"), F.col("l_suppkey").cast("string")).alias("url")
    line = w.table("lineitem")
    found = line.select(F.col("l_orderkey").alias("site_id"), url).distinct()
    known = line.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("site_id"), url)
    return matching.new_assets(found, known)


def _weighed(w: World):
    """Written match tables and weighed assets."""
    space = w.workspace("match")
    tables = index_store.stage_match_tables(w.index, space)
    return space, tables, space.save(matching.weigh_assets(w.assets, tables.idf), "weighed-assets")


def _strengths(w: World) -> DataFrame:
    """Strengths of all sites and versions."""
    space, tables, weighted = _weighed(w)
    return scoring.with_strength(scoring.site_scores(weighted, tables.packed, save=space.save))


def _best(w: World) -> DataFrame:
    space, tables, weighted = _weighed(w)
    sums, others = version_sets.set_sums(weighted, tables.packed, save=space.save)
    sums, others = space.save(sums, "sums"), space.save(others, "others")
    return scoring.best_guesses(scoring.strongest(sums, tables.packed, others))


@query("guess_strength", """
SELECT site_id, count(*) AS versions, CAST(sum(n_pos) AS BIGINT) AS positives, CAST(sum(n_neg) AS BIGINT) AS negatives,
       CAST(sum(pos_micro) AS BIGINT) / 1e6 AS positive_strength, CAST(sum(neg_micro) AS BIGINT) / 1e6 AS negative_strength,
       max(strength_nano) / 1e9 AS best_strength, min(strength_nano) / 1e9 AS least_strength
FROM strength GROUP BY site_id""")
def guess_strength(w: World) -> DataFrame:
    """Strength of every site and version, summed up per site."""
    return _strengths(w).groupBy("site_id").agg(
        F.count(F.lit(1)).alias("versions"), F.sum("n_pos").alias("positives"), F.sum("n_neg").alias("negatives"),
        (F.sum("pos_micro") / 1e6).alias("positive_strength"), (F.sum("neg_micro") / 1e6).alias("negative_strength"),
        (F.max("strength_nano") / 1e9).alias("best_strength"), (F.min("strength_nano") / 1e9).alias("least_strength"),
    )


@query("best_guesses", """
SELECT site_id, version_id, rank, n_pos, n_neg, strength_nano / 1e9 AS strength FROM best_guess""")
def best_guesses(w: World) -> DataFrame:
    return _best(w).select("site_id", "version_id", "rank", "n_pos", "n_neg", scoring.nano("strength_nano").alias("strength"))


@query("best_tie_group", """
SELECT site_id, version_id FROM (SELECT *, max(strength_nano) OVER (PARTITION BY site_id) AS top FROM best_guess) WHERE strength_nano = top""")
def best_tie_group(w: World) -> DataFrame:
    return scoring.best_tie_group(_best(w)).select("site_id", "version_id")


def _asset_counts(w: World) -> DataFrame:
    return w.assets.groupBy("site_id").agg(F.count(F.lit(1)).alias("n_assets"))


@query("guess_support", """
SELECT site_id, n_guesses, n_assets, best_nano / 1e9 / n_assets AS support,
       best_nano / 1e9 / n_assets >= 0.2 AND best_nano / 1e9 >= 3 AS enough FROM site_support""")
def guess_support(w: World) -> DataFrame:
    """Support with a threshold of 3, as orders have few assets."""
    params = InferenceParams(min_absolute_support=3.0)
    return scoring.support(_best(w), _asset_counts(w), params).select("site_id", "n_guesses", "n_assets", "support", "enough")


@query("decisiveness", """
SELECT site_id, CASE WHEN n_guesses = 1 THEN best_nano / 1e9 ELSE (n_guesses * best_nano - total)::DOUBLE / n_guesses / 1e9 END AS decisiveness
FROM (SELECT site_id, count(*) AS n_guesses, max(strength_nano) AS best_nano, CAST(sum(strength_nano) AS BIGINT) AS total
      FROM best_guess GROUP BY site_id)""")
def decisiveness(w: World) -> DataFrame:
    return scoring.decisiveness(_best(w))


@query("initial_candidates", """
SELECT site_id, version_id, CAST(0 AS INTEGER) AS rank, CAST(0 AS DOUBLE) AS strength FROM (SELECT DISTINCT l_orderkey AS site_id, l_suppkey AS version_id FROM lineitem)
UNION ALL SELECT site_id, version_id, rank, strength_nano / 1e9 FROM best_guess""")
def initial_candidates(w: World) -> DataFrame:
    estimates = w.table("lineitem").select(F.col("l_orderkey").alias("site_id"), F.col("l_suppkey").alias("version_id")).distinct()
    first = estimates.select("site_id", "version_id", F.lit(0).alias("rank"), F.lit(0.0).alias("strength"))
    return first.unionByName(_best(w).select("site_id", "version_id", "rank", scoring.nano("strength_nano").alias("strength")))


@query("guess_label", """
SELECT site_id, version_id, concat(name, ' (+', CAST(n_pos AS VARCHAR), '[', CAST(pos_micro // 1000000 AS VARCHAR), '.', lpad(CAST(pos_micro % 1000000 AS VARCHAR), 6, '0'),
    ']-', CAST(n_neg AS VARCHAR), '[', CAST(neg_micro // 1000000 AS VARCHAR), '.', lpad(CAST(neg_micro % 1000000 AS VARCHAR), 6, '0'), '])') AS label
FROM best_guess JOIN software_version USING (version_id)""")
def guess_label(w: World) -> DataFrame:
    return _best(w).join(w.versions, "version_id").select("site_id", "version_id", scoring.guess_label(F.col("name")).alias("label"))


@query("probe_prefix", """,
probe AS (
    SELECT l_orderkey AS site_id, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank,
           l_returnflag = 'A' AS found FROM lineitem)
SELECT site_id, CAST(rank AS INTEGER) AS rank, l_partkey, found FROM (
    SELECT *, coalesce(sum(CAST(found AS INTEGER)) OVER (PARTITION BY site_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM probe)
WHERE before < 2""")
def probe_prefix(w: World) -> DataFrame:
    from pyspark.sql import Window as W

    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    probes = w.table("lineitem").select(
        F.col("l_orderkey").alias("site_id"), F.row_number().over(order).alias("rank"), "l_partkey",
        (F.col("l_returnflag") == "A").alias("found"),
    )
    return scoring.probe_prefix(probes, PARAMS.min_assets_per_iteration)


@query("site_statistics", """
SELECT o_orderkey AS site_id, count(l_orderkey) AS retrieved_assets_total, count(l_orderkey) + 1 AS retrieved_resources_total,
       count(*) FILTER (l_returnflag <> 'R') + CASE WHEN any_value(o_orderstatus) <> 'P' THEN 1 ELSE 0 END AS retrieved_resources_successful
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def site_statistics(w: World) -> DataFrame:
    pages = w.table("orders").select(
        F.col("o_orderkey").alias("site_id"), F.lit(False).alias("is_asset"), (F.col("o_orderstatus") != "P").alias("success")
    )
    assets = w.table("lineitem").select(
        F.col("l_orderkey").alias("site_id"), F.lit(True).alias("is_asset"), (F.col("l_returnflag") != "R").alias("success")
    )
    return scoring.site_statistics(pages.unionByName(assets))


@query("more_recent_version", """,
recent AS (
    SELECT site_id, arg_max(version_id, {'d': release_date, 'v': version_id}) AS version_id, min(package_id) AS package_id,
           min(package_id) <> max(package_id) AS package_conflict
    FROM best_guess JOIN software_version USING (version_id) GROUP BY site_id),
latest AS (SELECT package_id, arg_max(version_id, {'d': release_date, 'v': version_id}) AS latest_id FROM software_version GROUP BY package_id)
SELECT site_id, CASE WHEN NOT package_conflict THEN version_id END AS version_id,
       CASE WHEN NOT package_conflict AND latest_id <> version_id THEN latest_id END AS more_recent_id, package_conflict
FROM recent JOIN latest USING (package_id)""")
def more_recent_version(w: World) -> DataFrame:
    return recency.more_recent_version(_best(w), w.versions)


# --- inference over the content world ----------------------------------------


def content_sites(w: World) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Users as sites that run the version of the document with their number.

    Their events refer to paths; a site serves one file per path of its version.
    """
    users = w.table("events").select("user_id", F.get_json_object("props", "$.k").alias("k"))
    host = F.concat(F.lit("http://u"), F.col("site_id").cast("string"), F.lit(".example/"))
    runs = (
        users.select("user_id").distinct()
        .join(w.table("documents"), F.col("user_id") == F.col("doc_id"))
        .select(F.col("user_id").alias("site_id"), _version_of("lang", "source").alias("version_id"))
    )
    sites = runs.select("site_id", host.alias("base_url"))
    included = users.select(
        F.col("user_id").alias("site_id"), F.col("k")
    ).distinct().join(runs, "site_id").select(
        "site_id", F.concat(host, F.lit("p"), "k").alias("url")
    )
    served = w.doc_files.groupBy("version_id", "webroot_path").agg(F.max("checksum").alias("checksum"))
    responses = expanding_join(runs, served, ["version_id"]).select(
        F.concat(host, "webroot_path").alias("url"), F.lit(200).alias("status"), "checksum"
    )
    versions = w.doc_versions
    languages = w.table("documents").select("doc_id", "lang")
    estimates = (
        w.table("events").filter("event_type = 'error'").select("user_id").distinct()
        .join(languages, F.col("user_id") == F.col("doc_id"))
        .join(versions, F.col("lang") == F.col("package"))
        .select(F.col("user_id").alias("site_id"), "version_id")
    )
    return sites, included, estimates, responses


def _version_of(lang: str, source: str):
    from filespoor.world.views import content_version

    return content_version(F.col(lang), F.col(source))


def content_inference(w: World):
    space = w.workspace("infer")
    parts = [space.save(df, name) for df, name in zip(content_sites(w), ("sites", "included", "estimates", "crawl"))]
    tables = index_store.derive_match_tables(ops.path_checksums(w.doc_files), w.doc_versions, space.save)
    return infer_sites(*parts, tables, space.save(w.doc_index_files, "files"), space)


@query("complete_retrieval", """,
run AS (SELECT DISTINCT e.user_id AS site_id, d.lang, d.source FROM events e JOIN documents d ON d.doc_id = e.user_id),
size AS (SELECT lang, count(DISTINCT version_id) AS n FROM doc_file GROUP BY lang),
telling AS (
    SELECT lang, webroot_path, count(DISTINCT version_id) + count(DISTINCT checksum) AS weight FROM doc_file JOIN size USING (lang)
    GROUP BY lang, webroot_path, n HAVING NOT (n > 1 AND count(DISTINCT version_id) = n AND count(DISTINCT checksum) = 1)),
unseen AS (
    SELECT r.site_id, r.lang, r.source, t.webroot_path,
           CAST(row_number() OVER (PARTITION BY site_id ORDER BY weight DESC, webroot_path) AS INTEGER) AS rank
    FROM run r JOIN telling t USING (lang)
    WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = r.site_id
                      AND concat('p', json_extract_string(e.props, '$.k')) = t.webroot_path)),
served AS (SELECT DISTINCT d.lang, d.source, concat('p', CAST(d.doc_id // 20 AS VARCHAR)) AS webroot_path FROM documents d)
SELECT u.site_id, u.rank, u.webroot_path, concat('http://u', CAST(u.site_id AS VARCHAR), '.example/', u.webroot_path) AS url,
       s.lang IS NOT NULL AS success, s.lang IS NOT NULL AS found
FROM unseen u LEFT JOIN served s ON s.lang = u.lang AND s.source = u.source AND s.webroot_path = u.webroot_path""")
def complete_retrieval(w: World) -> DataFrame:
    """All telling paths of the versions in a site's language, except those its pages name."""
    space = w.workspace("complete-retrieval")
    listed, included, _, crawled = content_sites(w)
    tables = index_store.derive_match_tables(ops.path_checksums(w.doc_files), w.doc_versions, space.save)
    languages = w.table("documents").select(F.col("doc_id").alias("site_id"), F.col("lang").alias("package"))
    guesses = listed.join(languages, "site_id").join(w.doc_versions, "package").select("site_id", "version_id")
    responses = space.save(infer.known_responses(crawled, tables.idf), "responses")
    seen = infer.request(included, responses, PARAMS)
    return infer.complete_retrieval(listed, space.save(guesses, "guesses"), space.save(seen, "seen"), responses, tables, save=space.save)


@query("infer_sites")
def infer_sites_query(w: World) -> DataFrame:
    result = content_inference(w)
    return result.sites.join(result.guesses.select("site_id", "version_id"), "site_id", "left").select(
        "site_id", "rounds", "n_guesses", "n_assets", "support", "has_result", "version_id"
    )


@query("iteration_trace")
def iteration_trace(w: World) -> DataFrame:
    return content_inference(w).trace.select(
        "site_id", "round", "probed", "n_assets", "n_guesses", "decisiveness", "gain", "useless_reason", "streak", "stopped"
    )


@query("useless_streak")
def useless_streak(w: World) -> DataFrame:
    """Longest run of rounds without progress per site."""
    return content_inference(w).trace.groupBy("site_id").agg(
        F.max("streak").alias("longest"), F.count("useless_reason").alias("useless_rounds"), F.max("round").alias("rounds")
    )
