"""Queries on scans, lookups and statistics of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from filespoor.functions.text import natural_key
from filespoor.operators import build, delta, entropy, index, recency, signals
from filespoor.plans import compare, index_build, infer
from filespoor.sources import index_store, releases
from filespoor.streaming import incremental, settling
from filespoor.world.registry import query
from filespoor.world.views import World


@query("packages_scan", """
SELECT package_id, name, vendor, array_to_string(alternative_names, ',') AS alternatives FROM software_package""")
def packages_scan(w: World) -> DataFrame:
    return w.packages.select("package_id", "name", "vendor", F.array_join("alternative_names", ",").alias("alternatives"))


@query("versions_scan", """
SELECT version_id, package_id, name, internal_identifier, strftime(release_date, '%Y-%m-%d') AS release_date
FROM software_version WHERE is_indexed""")
def versions_scan(w: World) -> DataFrame:
    return w.index.indexed_versions().select(
        "version_id", "package_id", "name", "internal_identifier",
        F.date_format("release_date", "yyyy-MM-dd").alias("release_date"),
    )


@query("package_versions_union", """
SELECT version_id, package_id, name FROM software_version
WHERE is_indexed AND package_id IN (SELECT package_id FROM software_package WHERE vendor LIKE 'A%')""")
def package_versions_union(w: World) -> DataFrame:
    chosen = w.packages.filter(F.startswith("vendor", F.lit("A")))
    return index_store.versions_of(chosen, w.versions).select("version_id", "package_id", "name")


@query("static_file_uses", """
SELECT DISTINCT version_id, src_path, webroot_path, checksum FROM static_file_use JOIN static_file USING (file_id)""")
def static_file_uses(w: World) -> DataFrame:
    found = w.table("lineitem").select(
        F.col("l_suppkey").alias("version_id"), F.col("l_partkey").alias("file_id")
    ).join(w.files, "file_id").drop("file_id")
    # several parts share a key, so uses are compared by what their files are
    files = w.files.groupBy(*build.FILE_KEY).agg(F.min("file_id").alias("file_id"))
    return build.static_file_uses(found, files).join(files, "file_id").select("version_id", *build.FILE_KEY)


@query("static_files_dim", """
SELECT src_path, webroot_path, checksum, CAST(1 AS BIGINT) AS ids
FROM static_file GROUP BY src_path, webroot_path, checksum""")
def static_files_dim(w: World) -> DataFrame:
    dim = build.static_files_dim(None, w.files)
    ids = dim.groupBy("file_id").agg(F.count(F.lit(1)).alias("ids"))
    return dim.join(ids, "file_id").select(*build.FILE_KEY, "ids")


@query("lookup_ids", """
SELECT DISTINCT v.version_id, v.package_id, f.file_id
FROM lineitem JOIN software_version v ON v.version_id = l_suppkey
JOIN static_file g ON g.file_id = l_partkey
JOIN (SELECT src_path, webroot_path, checksum, min(file_id) AS file_id FROM static_file GROUP BY ALL) f
  ON f.src_path = g.src_path AND f.webroot_path = g.webroot_path AND f.checksum = g.checksum""")
def lookup_ids(w: World) -> DataFrame:
    """Every use by its natural keys, resolved back to ids."""
    named = index.describe_versions(w.used_files.drop("file_id"), w.versions, w.packages).select(
        F.col("package_name").alias("package"), "vendor", "internal_identifier", *build.FILE_KEY
    )
    files = w.files.groupBy(*build.FILE_KEY).agg(F.min("file_id").alias("file_id"))
    found = index.lookup_file_ids(index.lookup_version_ids(named, w.versions, w.packages), files)
    return found.select("version_id", "package_id", "file_id").distinct()


@query("files_by_checksum", """
SELECT file_id, webroot_path, checksum FROM static_file
WHERE checksum IN (SELECT checksum FROM asset WHERE success)""")
def files_by_checksum(w: World) -> DataFrame:
    return index.files_by_checksum(w.files, w.assets.filter("success")).select("file_id", "webroot_path", "checksum")


@query("files_of_version", """
SELECT file_id, webroot_path FROM static_file WHERE file_id IN (
    SELECT file_id FROM static_file_use JOIN software_version USING (version_id) WHERE NOT is_indexed)""")
def files_of_version(w: World) -> DataFrame:
    chosen = w.versions.filter(F.col("indexed").isNull())
    return index.files_of_versions(w.files, w.uses, chosen).select("file_id", "webroot_path")


@query("in_list", """
SELECT version_id, name FROM software_version
WHERE internal_identifier IN (SELECT concat('Supplier#', lpad(CAST(c_custkey AS VARCHAR), 9, '0')) FROM customer)""")
def in_list(w: World) -> DataFrame:
    keys = w.table("customer").select(
        F.concat(F.lit("Supplier#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("internal_identifier")
    )
    return w.versions.join(keys, "internal_identifier", "left_semi").select("version_id", "name")


@query("users_by_checksum", """
SELECT c.checksum, c.version_id, p.name AS package_name, v.name AS version_name
FROM checksum_version c JOIN software_version v USING (version_id) JOIN software_package p USING (package_id)
WHERE c.checksum IN (SELECT checksum FROM asset WHERE success)""")
def users_by_checksum(w: World) -> DataFrame:
    users = index.users_by_checksum(w.assets.filter("success"), w.tables.by_checksum)
    return index.describe_versions(users, w.versions, w.packages).select(
        "checksum", "version_id", "package_name", "version_name"
    )


@query("users_by_path", """
SELECT c.webroot_path, c.version_id, p.name AS package_name, v.name AS version_name
FROM path_version c JOIN software_version v USING (version_id) JOIN software_package p USING (package_id)
WHERE c.webroot_path IN (SELECT webroot_path FROM asset)""")
def users_by_path(w: World) -> DataFrame:
    users = index.users_by_path(w.assets, w.tables.by_path)
    return index.describe_versions(users, w.versions, w.packages).select(
        "webroot_path", "version_id", "package_name", "version_name"
    )


@query("file_users", """
SELECT u.file_id, u.version_id, p.name AS package_name, v.name AS version_name
FROM static_file_use u JOIN software_version v USING (version_id) JOIN software_package p USING (package_id)""")
def file_users(w: World) -> DataFrame:
    return index.describe_versions(w.uses, w.versions, w.packages).select(
        "file_id", "version_id", "package_name", "version_name"
    )


@query("idf_weight", "SELECT checksum, weight_micro / 1e6 AS weight FROM idf")
def idf_weight(w: World) -> DataFrame:
    return w.tables.idf.select("checksum", (F.col("weight_micro") / 1e6).alias("weight"))


_ENTROPY_SQL = """,
member AS (SELECT package_id, version_id FROM software_version WHERE is_indexed),
entropy AS (
    SELECT m.package_id, c.webroot_path, count(DISTINCT c.version_id) AS version_count,
           count(DISTINCT c.checksum) AS checksum_count, any_value(n) AS n
    FROM member m JOIN path_checksum c USING (version_id)
    JOIN (SELECT package_id, count(*) AS n FROM member GROUP BY package_id) USING (package_id)
    GROUP BY m.package_id, c.webroot_path),
telling AS (SELECT * FROM entropy WHERE NOT (n > 1 AND version_count = n AND checksum_count = 1))
"""


def _package_sets(w: World) -> DataFrame:
    return w.index.indexed_versions().select(F.col("package_id").alias("set_id"), "version_id")


@query("path_entropy", _ENTROPY_SQL + "SELECT package_id, webroot_path, version_count, checksum_count FROM telling")
def path_entropy(w: World) -> DataFrame:
    rows = entropy.path_entropy(_package_sets(w), w.tables.path_checksums)
    return rows.withColumnRenamed("set_id", "package_id")


@query("high_entropy_paths", _ENTROPY_SQL + """
SELECT package_id, webroot_path, version_count, checksum_count, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY version_count + checksum_count DESC, webroot_path) AS rank
    FROM telling) WHERE rank <= 8""")
def high_entropy_paths(w: World) -> DataFrame:
    rows = entropy.top_paths(entropy.path_entropy(_package_sets(w), w.tables.path_checksums), 8)
    return rows.withColumnRenamed("set_id", "package_id")


@query("exclude_paths", """
SELECT DISTINCT s.user_id AS site_id, f.webroot_path
FROM (SELECT DISTINCT user_id FROM events) s JOIN documents d ON d.doc_id = s.user_id
JOIN doc_file f ON f.lang = d.lang
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = s.user_id
                  AND concat('p', json_extract_string(e.props, '$.k')) = f.webroot_path)""")
def exclude_paths(w: World) -> DataFrame:
    """Paths of the language of a user's document that the user's events do not name."""
    events, documents = w.table("events"), w.table("documents")
    seen = events.select(
        F.col("user_id").alias("site_id"), F.concat(F.lit("p"), F.get_json_object("props", "$.k")).alias("webroot_path")
    )
    languages = documents.select("doc_id", "lang")
    paths = documents.select(
        "lang", F.concat(F.lit("p"), (F.col("doc_id") / 20).cast("bigint").cast("string")).alias("webroot_path")
    ).distinct()
    # a small table of sites makes very many rows: they are dealt by site before that, and stay so
    parts = max(int(w.spark.conf.get("spark.sql.shuffle.partitions")), 3 * w.spark.sparkContext.defaultParallelism)
    sites = seen.select("site_id").distinct().join(languages, F.col("site_id") == F.col("doc_id")).select("site_id", "lang")
    # one row for 20 documents and language at most
    options = sites.repartition(parts, "site_id").join(F.broadcast(paths), "lang").select("site_id", "webroot_path")
    return entropy.exclude_paths(options, seen, "site_id")


@query("complete_retrieval_plan", """,
member AS (SELECT version_id FROM software_version WHERE is_indexed AND package_id IN (
    SELECT package_id FROM name_key WHERE name_key LIKE 'nation_1%')),
entropy AS (
    SELECT c.webroot_path, count(DISTINCT c.version_id) AS version_count, count(DISTINCT c.checksum) AS checksum_count
    FROM member JOIN path_checksum c USING (version_id) GROUP BY c.webroot_path)
SELECT *, CAST(row_number() OVER (ORDER BY version_count + checksum_count DESC, webroot_path) AS INTEGER) AS rank
FROM entropy WHERE NOT ((SELECT count(*) FROM member) > 1
    AND version_count = (SELECT count(*) FROM member) AND checksum_count = 1)""")
def complete_retrieval_plan(w: World) -> DataFrame:
    chosen = signals.packages_by_glob(w.packages, "nation_1*", any_name=True)
    return infer.complete_retrieval_plan(chosen, w.versions, w.tables, w.workspace("retrieval-plan").save)


@query("almost_unique_files", """
SELECT u.version_id, u.file_id, n.user_count FROM doc_use u
JOIN (SELECT file_id, count(*) AS user_count FROM doc_use GROUP BY file_id) n USING (file_id)
WHERE n.user_count <= 2""")
def almost_unique_files(w: World) -> DataFrame:
    return index.almost_unique_files(w.doc_uses, 2)


@query("unique_files", """
SELECT any_value(version_id) AS version_id, file_id FROM doc_use GROUP BY file_id HAVING count(*) = 1""")
def unique_files(w: World) -> DataFrame:
    return index.unique_files(w.doc_uses)


@query("popular_files", """,
chosen AS (SELECT version_id FROM software_version WHERE name LIKE '1.%'),
top_file AS (
    SELECT file_id, count(c.version_id) AS user_count
    FROM static_file_use LEFT JOIN chosen c USING (version_id)
    GROUP BY file_id ORDER BY user_count DESC, file_id LIMIT 25)
SELECT t.file_id, t.user_count, u.version_id FROM top_file t
LEFT JOIN (SELECT * FROM static_file_use JOIN chosen USING (version_id)) u USING (file_id)""")
def popular_files(w: World) -> DataFrame:
    chosen = w.versions.filter(F.col("name").like("1.%"))
    top = index.popular_files(w.uses, chosen, 25)
    return index.users_within(top, w.uses, chosen)


@query("static_file_count", """
SELECT v.version_id, count(u.file_id) AS file_count FROM software_version v
LEFT JOIN static_file_use u USING (version_id) GROUP BY v.version_id""")
def static_file_count(w: World) -> DataFrame:
    return index.file_counts(w.versions, w.uses)


_NATURAL_SQL = """,
keyed AS (
    SELECT *, list_transform(range(1, len(t) + 1), lambda i: {'text': t[i],
               'number': coalesce(try_cast(n[i] AS DECIMAL(38, 0)), -1)}) AS natural_key
    FROM (SELECT *, string_split_regex(name, '\\d+') AS t, regexp_extract_all(name, '\\d+') AS n FROM software_version)),
neighbour AS (
    SELECT * FROM (
        SELECT package_id, lag(version_id) OVER (PARTITION BY package_id ORDER BY natural_key, version_id) AS old_version_id,
               version_id AS new_version_id FROM keyed WHERE is_indexed)
    WHERE old_version_id IS NOT NULL),
at_path AS (
    SELECT version_id, webroot_path, max({'src_path': src_path, 'checksum': checksum}) AS file
    FROM used_file GROUP BY version_id, webroot_path),
delta AS (
    SELECT old_version_id, new_version_id, webroot_path,
           CASE WHEN a IS NULL THEN 'created' WHEN b IS NULL THEN 'deleted' ELSE 'changed' END AS change,
           a.src_path AS old_path, b.src_path AS new_path
    FROM (
        SELECT coalesce(x.old_version_id, y.old_version_id) AS old_version_id,
               coalesce(x.new_version_id, y.new_version_id) AS new_version_id,
               coalesce(x.webroot_path, y.webroot_path) AS webroot_path, x.file AS a, y.file AS b
        FROM (SELECT n.*, f.webroot_path, f.file FROM neighbour n JOIN at_path f ON f.version_id = n.old_version_id) x
        FULL JOIN (SELECT n.*, f.webroot_path, f.file FROM neighbour n JOIN at_path f ON f.version_id = n.new_version_id) y
        ON x.old_version_id = y.old_version_id AND x.new_version_id = y.new_version_id AND x.webroot_path = y.webroot_path)
    WHERE a IS NULL OR b IS NULL OR a.checksum <> b.checksum)
"""


@query("natural_sort", _NATURAL_SQL + """
SELECT package_id, version_id, name,
       CAST(row_number() OVER (PARTITION BY package_id ORDER BY natural_key, version_id) AS INTEGER) AS place FROM keyed""")
def natural_sort(w: World) -> DataFrame:
    from pyspark.sql import Window as W

    order = W.partitionBy("package_id").orderBy(natural_key(F.col("name")), "version_id")
    return w.versions.select("package_id", "version_id", "name", F.row_number().over(order).alias("place"))


@query("previous_version", _NATURAL_SQL + "SELECT package_id, old_version_id, new_version_id FROM neighbour")
def previous_version(w: World) -> DataFrame:
    return delta.previous_versions(w.index.indexed_versions())


def _delta(w: World) -> DataFrame:
    pairs = delta.previous_versions(w.index.indexed_versions())
    return delta.version_delta(pairs, delta.files_at_path(w.used_files))


@query("version_delta", _NATURAL_SQL + "SELECT * FROM delta")
def version_delta(w: World) -> DataFrame:
    return _delta(w)


@query("delta_listing", _NATURAL_SQL + """
SELECT old_version_id, new_version_id, webroot_path,
       CASE change WHEN 'created' THEN 1 WHEN 'deleted' THEN 2 ELSE 0 END AS "group",
       CASE change WHEN 'created' THEN concat('newly created: ', new_path) WHEN 'deleted' THEN concat('deleted: ', old_path)
            ELSE concat(old_path, ' -> ', new_path) END AS line
FROM delta""")
def delta_listing(w: World) -> DataFrame:
    return delta.delta_listing(_delta(w)).select("old_version_id", "new_version_id", "webroot_path", "group", "line")


@query("pairwise_delta_counts", _NATURAL_SQL + """
SELECT n.package_id, n.old_version_id, n.new_version_id, count(d.webroot_path) AS changed_files
FROM neighbour n LEFT JOIN delta d USING (old_version_id, new_version_id) GROUP BY ALL""")
def pairwise_delta_counts(w: World) -> DataFrame:
    return compare.pairwise_comparison(w.index, w.used_files)


@query("delta_count", _NATURAL_SQL + """
SELECT change, count(*) AS files FROM delta GROUP BY change""")
def delta_count(w: World) -> DataFrame:
    return _delta(w).groupBy("change").agg(F.count(F.lit(1)).alias("files"))


_ENDS_SQL = """,
ends AS (
    SELECT arg_min(version_id, {'d': release_date, 'v': version_id}) AS old_id,
           arg_max(version_id, {'d': release_date, 'v': version_id}) AS new_id
    FROM software_version WHERE is_indexed AND package_id = (
        SELECT package_id FROM software_version WHERE is_indexed GROUP BY package_id
        ORDER BY count(*) DESC, package_id LIMIT 1)),
end_file AS (
    SELECT 'a' AS side, webroot_path, max({'src_path': src_path, 'checksum': checksum}) AS file
    FROM used_file JOIN ends ON version_id = old_id GROUP BY webroot_path
    UNION ALL SELECT 'b', webroot_path, max({'src_path': src_path, 'checksum': checksum})
    FROM used_file JOIN ends ON version_id = new_id GROUP BY webroot_path),
end_pair AS (
    SELECT webroot_path, max(file) FILTER (side = 'a') AS a, max(file) FILTER (side = 'b') AS b
    FROM end_file GROUP BY webroot_path)
"""


@query("compare_versions", _ENDS_SQL + """
SELECT webroot_path, CASE WHEN a IS NULL THEN concat('newly created: ', b.src_path)
    WHEN b IS NULL THEN concat('deleted: ', a.src_path) ELSE concat(a.src_path, ' -> ', b.src_path) END AS line
FROM end_pair WHERE a IS NULL OR b IS NULL OR a.checksum <> b.checksum""")
def compare_versions(w: World) -> DataFrame:
    """First and last release of the package with most versions, given by their names; ids tell releases of one name apart."""
    indexed = w.index.indexed_versions()
    package = indexed.groupBy("package_id").count().orderBy(F.desc("count"), "package_id").limit(1)
    release = F.struct("name", "version_id")
    ends = indexed.join(package, "package_id").groupBy("package_id").agg(
        F.min_by(release, F.struct("release_date", "version_id")).alias("old"),
        F.max_by(release, F.struct("release_date", "version_id")).alias("new"),
    )
    name, old, new = ends.join(w.packages, "package_id").select(w.packages["name"], "old", "new").first()  # one row
    return compare.compare_versions(w.index, w.used_files, name, tuple(old), tuple(new)).select("webroot_path", "line")


@query("most_recent_version", """
SELECT package_id, arg_max(version_id, {'d': release_date, 'v': version_id}) AS version_id
FROM software_version GROUP BY package_id""")
def most_recent_version(w: World) -> DataFrame:
    return recency.most_recent(w.versions, "package_id")


@query("packages_by_name", """,
pattern AS (SELECT concat('NATION_', CAST(r_regionkey AS VARCHAR), '%') AS pattern FROM region
            UNION SELECT DISTINCT concat('nation_', CAST(c_nationkey AS VARCHAR)) FROM customer
            UNION SELECT DISTINCT concat('%', CAST(s_nationkey AS VARCHAR)) FROM supplier)
SELECT t.pattern, p.package_id, p.name FROM pattern t JOIN software_package p ON lower(p.name) LIKE lower(t.pattern)""")
def packages_by_name(w: World) -> DataFrame:
    patterns = (
        w.table("region").select(F.concat(F.lit("NATION_"), F.col("r_regionkey").cast("string"), F.lit("%")).alias("pattern"))
        .union(w.table("customer").select(F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string"))))
        .union(w.table("supplier").select(F.concat(F.lit("%"), F.col("s_nationkey").cast("string"))))
    )
    return signals.packages_by_name(patterns, w.packages).select("pattern", "package_id", "name")


@query("packages_by_any_name", """,
wanted AS (SELECT DISTINCT concat('ALT-', CAST(c_nationkey AS VARCHAR)) AS wanted FROM customer
           UNION SELECT DISTINCT upper(n_name) FROM nation)
SELECT wanted, package_id FROM wanted JOIN name_key ON name_key = lower(wanted)""")
def packages_by_any_name(w: World) -> DataFrame:
    wanted = (
        w.table("customer").select(F.concat(F.lit("ALT-"), F.col("c_nationkey").cast("string")).alias("wanted"))
        .union(w.table("nation").select(F.upper("n_name"))).distinct()
    )
    return signals.packages_by_any_name(wanted, "wanted", w.packages)


@query("definitions_glob", """
SELECT p_partkey AS package_id, p_name AS name FROM part
WHERE regexp_full_match(lower(p_name), '[br].* .o.*') OR regexp_full_match(lower(p_brand), 'brand#1.')""")
def definitions_glob(w: World) -> DataFrame:
    """Parts as packages, their brand as alternative name."""
    parts = w.table("part").select(
        F.col("p_partkey").alias("package_id"), F.col("p_name").alias("name"), F.array("p_brand").alias("alternative_names")
    )
    by_name = signals.packages_by_glob(parts, "[BR]* ?o*")
    by_any = signals.packages_by_glob(parts, "brand#1?", any_name=True)
    return by_name.union(by_any).select("package_id", "name").distinct()


# --- building ----------------------------------------------------------------

_UPSERT_SQL = """,
incoming AS (
    SELECT DISTINCT CASE WHEN c_mktsegment = 'BUILDING' THEN n_name ELSE concat(n_name, ' ', c_mktsegment) END AS name,
           r_name AS vendor, [lower(c_mktsegment)] AS alternative_names
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


@query("upsert_packages", _UPSERT_SQL + """
SELECT name, vendor, array_to_string(coalesce(i.alternative_names, p.alternative_names), ',') AS alternatives,
       p.package_id IS NOT NULL AS was_known
FROM software_package p FULL JOIN incoming i USING (name, vendor)""")
def upsert_packages(w: World) -> DataFrame:
    places = w.packages.select("package_id", "name", "vendor")
    segment = F.col("c_mktsegment")
    incoming = (
        w.table("customer").join(places, F.col("c_nationkey") == F.col("package_id"))
        .select(
            F.when(segment == "BUILDING", F.col("name")).otherwise(F.concat_ws(" ", "name", segment)).alias("name"),
            "vendor", F.array(F.lower(segment)).alias("alternative_names"),
        ).distinct()
    )
    merged = build.upsert_packages(w.packages, incoming)
    known = w.packages.select("package_id", F.lit(True).alias("was_known"))
    return merged.join(known, "package_id", "left").select(
        "name", "vendor", F.array_join("alternative_names", ",").alias("alternatives"),
        F.coalesce("was_known", F.lit(False)).alias("was_known"),
    )


_AVAILABLE_SQL = """,
available AS (
    SELECT package_id, CASE WHEN s_acctbal > 5000 THEN s_name ELSE concat(s_name, '-next') END AS internal_identifier,
           concat('r', v.name) AS name, release_date
    FROM software_version v JOIN supplier ON s_suppkey = version_id)
"""


def _available(w: World) -> DataFrame:
    balance = w.table("supplier").select(F.col("s_suppkey").alias("version_id"), "s_acctbal")
    known = F.col("internal_identifier")
    return w.versions.join(balance, "version_id").select(
        "package_id",
        F.when(F.col("s_acctbal") > 5000, known).otherwise(F.concat(known, F.lit("-next"))).alias("internal_identifier"),
        F.concat(F.lit("r"), "name").alias("name"),
        "release_date",
    )


@query("upsert_versions", _AVAILABLE_SQL + """
SELECT package_id, internal_identifier, coalesce(a.name, v.name) AS name,
       strftime(coalesce(v.release_date, a.release_date), '%Y-%m-%d') AS release_date,
       coalesce(v.is_indexed, FALSE) AS is_indexed
FROM software_version v FULL JOIN available a USING (package_id, internal_identifier)""")
def upsert_versions(w: World) -> DataFrame:
    return build.upsert_versions(w.versions, _available(w), "name_only").select(
        "package_id", "internal_identifier", "name",
        F.date_format("release_date", "yyyy-MM-dd").alias("release_date"),
        F.col("indexed").isNotNull().alias("is_indexed"),
    )


@query("missing_versions", _AVAILABLE_SQL + """
SELECT package_id, internal_identifier, name FROM available a WHERE NOT EXISTS (
    SELECT 1 FROM software_version v WHERE v.is_indexed AND v.package_id = a.package_id
    AND v.internal_identifier = a.internal_identifier)""")
def missing_versions(w: World) -> DataFrame:
    return build.missing_versions(_available(w), w.index.indexed_versions()).select(
        "package_id", "internal_identifier", "name"
    )


@query("gone_versions", _AVAILABLE_SQL + """
SELECT version_id, package_id, internal_identifier FROM software_version v WHERE is_indexed AND NOT EXISTS (
    SELECT 1 FROM available a WHERE v.package_id = a.package_id AND v.internal_identifier = a.internal_identifier)""")
def gone_versions(w: World) -> DataFrame:
    return build.gone_versions(w.index.indexed_versions(), _available(w)).select(
        "version_id", "package_id", "internal_identifier"
    )


@query("delete_versions", """
SELECT u.version_id, count(*) AS uses FROM static_file_use u
WHERE u.version_id NOT IN (SELECT version_id FROM software_version WHERE NOT is_indexed) GROUP BY u.version_id""")
def delete_versions(w: World) -> DataFrame:
    versions, uses = build.delete_versions(w.versions, w.uses, w.versions.filter(F.col("indexed").isNull()))
    return uses.join(versions, "version_id", "left_semi").groupBy("version_id").agg(F.count(F.lit(1)).alias("uses"))


@query("gc_index", """,
gone AS (
    SELECT version_id FROM software_version JOIN supplier ON s_suppkey = version_id WHERE is_indexed AND s_acctbal <= 5000)
SELECT v.version_id, count(u.file_id) AS uses FROM software_version v LEFT JOIN static_file_use u USING (version_id)
WHERE v.version_id NOT IN (SELECT version_id FROM gone) GROUP BY v.version_id""")
def gc_index(w: World) -> DataFrame:
    named = _available(w).join(w.packages.select("package_id", F.col("name").alias("package")), "package_id").drop("package_id")
    kept = index_build.gc_index(w.index, named)
    return kept.versions.join(kept.uses, "version_id", "left").groupBy("version_id").agg(F.count("file_id").alias("uses"))


@query("mark_indexed", """,
done AS (SELECT DISTINCT version_id FROM static_file_use)
SELECT version_id, is_indexed OR version_id IN (SELECT version_id FROM done) AS is_indexed FROM software_version""")
def mark_indexed(w: World) -> DataFrame:
    marked = index_store.mark_indexed(w.versions, w.uses, F.lit("2021-01-01").cast("timestamp"))
    return marked.select("version_id", F.col("indexed").isNotNull().alias("is_indexed"))


@query("index_export", """
SELECT p_partkey AS file_id, upper(md5(p_name)) AS checksum_hex, n AS alternatives_json
FROM part, LATERAL (SELECT concat('["', lower(p_brand), '","', p_type, '"]') AS n)""")
def index_export(w: World) -> DataFrame:
    dump = w.table("part").select(
        F.col("p_partkey").alias("file_id"),
        F.concat(F.lit("\\x"), F.md5("p_name")).alias("checksum"),
        F.concat(F.lit("{"), F.lower("p_brand"), F.lit(","), F.col("p_type"), F.lit("}")).alias("alternative_names"),
    )
    exported = index_store.export_packages(index_store.export_files(dump))
    return exported.select(
        "file_id", F.hex("checksum").alias("checksum_hex"), F.col("alternative_names_json").alias("alternatives_json")
    )


@query("archive_versions", """
SELECT DISTINCT n_name AS package, s_name AS version FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION SELECT DISTINCT n_name, concat('Supplier#', lpad(CAST(c_custkey AS VARCHAR), 9, '0'))
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def archive_versions(w: World) -> DataFrame:
    names = w.packages.select("package_id", F.col("name").alias("package"))
    mapping = w.versions.join(names, "package_id").select("package", F.col("internal_identifier").alias("version"))
    cached = w.table("customer").join(names, F.col("c_nationkey") == F.col("package_id")).select(
        "package", F.concat(F.lit("Supplier#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("version")
    )
    return releases.archive_versions(mapping, cached)


@query("file_snapshot_scan", """
SELECT concat('lang=', lang) AS package, concat('source=', source) AS version,
       CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes
FROM documents GROUP BY ALL""")
def file_snapshot_scan(w: World) -> DataFrame:
    """Documents written as plain files per version, read back with their bytes."""
    path = w.workspace("snapshot").folder("files")
    documents = w.table("documents").select("lang", "source", "text")
    documents.repartition("lang", "source").write.partitionBy("lang", "source").text(path)
    files = releases.file_snapshot(w.spark, path, "*.txt")
    return files.groupBy("package", "version").agg(F.sum(F.octet_length("content").cast("bigint")).alias("bytes"))


@query("file_checksums", """
SELECT concat('lang=', lang) AS package, concat('source=', source) AS version, count(*) AS n_texts,
       CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes, TRUE AS same
FROM documents GROUP BY ALL""")
def file_checksums(w: World) -> DataFrame:
    """The same files hashed where they lie, in pieces, next to checksums of their whole content."""
    from filespoor.functions.fingerprint import raw_checksum

    path = w.workspace("checksums").folder("files")
    documents = w.table("documents").select("lang", "source", "text")
    documents.repartition("lang", "source").write.partitionBy("lang", "source").text(path)
    key = ["package", "version", "path"]
    whole = releases.file_snapshot(w.spark, path, "*.txt").select(*key, raw_checksum("content").alias("_whole"))
    files = releases.file_snapshot_checksums(w.spark, path, "*.txt").join(whole, key)
    summed = files.groupBy("package", "version").agg(
        F.sum("length").alias("bytes"), F.bool_and(F.col("checksum") == F.col("_whole")).alias("same")
    )
    texts = documents.groupBy(
        F.concat(F.lit("lang="), "lang").alias("package"), F.concat(F.lit("source="), "source").alias("version")
    ).agg(F.count(F.lit(1)).alias("n_texts"))
    return summed.join(texts, ["package", "version"])


@query("version_refs", """,
ref AS (
    SELECT o_orderkey, concat(CASE WHEN o_orderstatus = 'P' THEN 'refs/heads/' ELSE 'refs/tags/' END,
                  CASE o_orderpriority WHEN '1-URGENT' THEN 'v' WHEN '2-HIGH' THEN 'release-' ELSE 'TYPO3_' END,
                  CAST(o_custkey % 9 AS VARCHAR), CASE WHEN o_orderpriority LIKE '%-N%' THEN '-' ELSE '.' END,
                  CAST(o_orderkey % 13 AS VARCHAR), CASE WHEN o_orderpriority LIKE '%-N%' THEN '-' ELSE '.' END,
                  CAST(o_orderkey AS VARCHAR)) AS ref,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'Moodle' WHEN '2-HIGH' THEN 'phpBB' WHEN '3-MEDIUM' THEN 'WordPress'
                ELSE 'TYPO3' END AS package,
           CAST(epoch(o_orderdate) AS BIGINT) AS author_epoch
    FROM orders),
tag AS (SELECT *, substr(ref, 11) AS tag FROM ref WHERE starts_with(ref, 'refs/tags/'))
SELECT package, tag AS internal_identifier, strftime(to_timestamp(author_epoch) AT TIME ZONE 'UTC', '%Y-%m-%d') AS release_date,
       CASE package WHEN 'WordPress' THEN tag
            WHEN 'Moodle' THEN regexp_extract(tag, '^v(\\d+\\.\\d+\\.\\d+)$', 1)
            WHEN 'phpBB' THEN regexp_extract(tag, '^release-(\\d+(\\.\\d+)?(\\.\\d+)?)$', 1)
            ELSE regexp_replace(regexp_replace(lower(tag), '(\\d+)-(\\d+)-(\\d+)(.*)', '\\1.\\2.\\3-\\4'), '-$', '') END AS name
FROM tag
WHERE CASE package WHEN 'WordPress' THEN TRUE
           WHEN 'Moodle' THEN regexp_full_match(tag, 'v(\\d+\\.\\d+\\.\\d+)')
           WHEN 'phpBB' THEN regexp_full_match(tag, 'release-(\\d+(\\.\\d+)?(\\.\\d+)?)')
           ELSE regexp_full_match(tag, 'TYPO3_\\d+-\\d+-\\d+') END""")
def version_refs(w: World) -> DataFrame:
    priority = F.col("o_orderpriority")
    dash = F.when(priority.like("%-N%"), F.lit("-")).otherwise(F.lit("."))
    refs = w.table("orders").select(
        F.when(priority == "1-URGENT", "Moodle").when(priority == "2-HIGH", "phpBB")
        .when(priority == "3-MEDIUM", "WordPress").otherwise("TYPO3").alias("package"),
        F.concat(
            F.when(F.col("o_orderstatus") == "P", "refs/heads/").otherwise("refs/tags/"),
            F.when(priority == "1-URGENT", "v").when(priority == "2-HIGH", "release-").otherwise("TYPO3_"),
            (F.col("o_custkey") % 9).cast("string"), dash, (F.col("o_orderkey") % 13).cast("string"), dash,
            F.col("o_orderkey").cast("string"),
        ).alias("ref"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("author_epoch"),
    )
    return releases.version_refs(refs, releases.definitions(w.spark)).select(
        "package", "internal_identifier", F.date_format("release_date", "yyyy-MM-dd").alias("release_date"), "name"
    )


@query("package_manifest", """
SELECT n_name AS package, concat(CAST(s_suppkey % 3 AS VARCHAR), '.0') AS name,
       arg_max(concat('pool/', s_name, '.deb'), s_suppkey) AS internal_identifier, CAST(NULL AS VARCHAR) AS release_date
FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""")
def package_manifest(w: World) -> DataFrame:
    names = w.packages.select("package_id", F.col("name").alias("package"))
    stanzas = w.versions.join(names, "package_id").select(
        F.concat(
            F.lit("Package: "), "package", F.lit("\nArchitecture: amd64\nVersion: "),
            (F.col("version_id") % 3).cast("string"), F.lit(".0\nFilename: pool/"), "internal_identifier", F.lit(".deb\nSize: 1"),
        ).alias("stanza"),
        F.col("version_id").alias("position"),
    )
    # one file per range of stanzas, read back by the manifest reader in the order of their positions
    path = w.workspace("manifest").folder("packages")
    stanzas.repartitionByRange(4, "position").sortWithinPartitions("position").select(
        F.concat("stanza", F.lit("\n")).alias("value")
    ).write.text(path)
    versions = releases.manifest_versions(releases.package_manifest(releases.read_manifest(w.spark, path)))
    return versions.withColumn("release_date", F.col("release_date").cast("string"))


_PLACED_SQL = """,
entry AS (SELECT * FROM (VALUES ('en', 'static/', 'en/src1'), ('en', '', 'en/'), ('fr', 'x/', 'fr/src1'), ('de', '', 'de/')) t(lang, webroot, src)),
release_file AS (SELECT doc_id, lang, concat(lang, '/', source, '/', CAST(doc_id AS VARCHAR), '.', CASE WHEN n_chars > 500 THEN 'js' WHEN n_chars > 200 THEN 'JSON5' ELSE 'MD' END) AS path FROM documents),
placed AS (
    SELECT doc_id, path AS src_path, CASE WHEN starts_with(substr(path, length(src) + 1), '/') THEN webroot || substr(path, length(src) + 2)
           ELSE webroot || substr(path, length(src) + 1) END AS webroot_path
    FROM release_file JOIN entry USING (lang) WHERE starts_with(path, src))
"""


def _placed(w: World) -> DataFrame:
    chars = F.col("n_chars")
    release_files = w.table("documents").select(
        "doc_id",
        F.col("lang").alias("package"),
        F.concat(
            "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."),
            F.when(chars > 500, "js").when(chars > 200, "JSON5").otherwise("MD"),
        ).alias("path"),
    )
    entries = [
        ("en", [("/static/", "/en/src1"), ("/", "/en/")], r"en/src2\d?/"),
        ("fr", [("/x/", "/fr/src1")], None),
        ("de", [("/", "/de/")], "src1"),
    ]
    defs = w.spark.createDataFrame(
        entries, "package STRING, path_map ARRAY<STRUCT<webroot: STRING, src: STRING>>, ignore_paths STRING"
    )
    return build.expand_path_map(release_files, defs)


@query("path_map_expand", _PLACED_SQL + "SELECT doc_id, src_path, webroot_path FROM placed")
def path_map_expand(w: World) -> DataFrame:
    return _placed(w).select("doc_id", "src_path", "webroot_path")


@query("ignore_paths", _PLACED_SQL + """
SELECT doc_id, src_path, webroot_path FROM placed WHERE NOT regexp_matches(src_path, '^en/src2\\d?/')""")
def ignore_paths(w: World) -> DataFrame:
    return build.drop_ignored(_placed(w)).select("doc_id", "src_path", "webroot_path")


@query("classify_for_index", _PLACED_SQL + """
SELECT doc_id, webroot_path, CASE WHEN webroot_path LIKE '%.js' THEN 'javascript' ELSE 'text' END AS file_type
FROM placed WHERE webroot_path NOT LIKE '%.JSON5'
UNION ALL SELECT doc_id, concat('f', CAST(doc_id AS VARCHAR), ['.css', '.LESS', '.ini', '.ttf', '.po', '.xhtml', '.jpeg', '.js', '.json', '.swf', '.rst', '.xml', '.yml', '']
    [CAST(doc_id % 14 AS INTEGER) + 1]), ['css', 'css', 'config', 'font', 'gettext', 'html', 'image', 'javascript', 'json', 'media', 'text', 'xml', 'yaml', 'extensionless']
    [CAST(doc_id % 14 AS INTEGER) + 1] FROM documents
UNION ALL SELECT doc_id, concat('.f', CAST(doc_id AS VARCHAR)), 'dotfile' FROM documents""")
def classify_for_index(w: World) -> DataFrame:
    """The placed files, and names of all types made from the documents."""
    from filespoor.functions.text import file_type

    endings = F.array(*map(F.lit, (".css", ".LESS", ".ini", ".ttf", ".po", ".xhtml", ".jpeg", ".js", ".json", ".swf", ".rst", ".xml", ".yml", "")))
    number = F.col("doc_id").cast("string")
    names = F.array(F.concat(F.lit("f"), number, F.get(endings, (F.col("doc_id") % 14).cast("int"))), F.concat(F.lit(".f"), number))
    made = w.table("documents").select("doc_id", F.explode(names).alias("webroot_path")).withColumn("file_name", F.col("webroot_path"))
    typed = _placed(w).select("doc_id", "webroot_path", "file_name").unionByName(made).withColumn("file_type", file_type(F.col("file_name")))
    return typed.filter(F.col("file_type").isNotNull()).select("doc_id", "webroot_path", "file_type")


@query("fingerprint", """
SELECT min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY text""")
def fingerprint(w: World) -> DataFrame:
    from filespoor.functions.fingerprint import raw_checksum

    summed = w.table("documents").select("doc_id", raw_checksum(F.encode("text", "UTF-8")).alias("checksum"))
    return summed.groupBy("checksum").agg(
        F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies")
    ).drop("checksum")


@query("normalize", """
SELECT json_extract_string(props, '$.k') AS k, count(*) AS copies, CAST(1 AS BIGINT) AS forms, CAST(1 AS BIGINT) AS sharing FROM events GROUP BY 1""")
def normalize(w: World) -> DataFrame:
    """Spacing and key order do not change the canonical checksum of structured content."""
    from filespoor.functions.fingerprint import canonical_checksum

    spaced = F.when(F.col("event_type") == "click", F.replace("props", F.lit(": "), F.lit(" :\n  "))).otherwise(F.col("props"))
    summed = w.table("events").select(
        F.get_json_object("props", "$.k").alias("k"),
        canonical_checksum(F.lit("json"), F.encode(spaced, "UTF-8")).alias("checksum"),
    )
    by_k = summed.groupBy("k").agg(
        F.count(F.lit(1)).alias("copies"), F.count_distinct("checksum").alias("forms"), F.min("checksum").alias("checksum")
    )
    # different contents have different forms
    sharing = by_k.groupBy("checksum").agg(F.count(F.lit(1)).alias("sharing"))
    return by_k.join(sharing, "checksum").select("k", "copies", "forms", "sharing")


_BUILT_SQL = """,
dim AS (
    SELECT DISTINCT lang, source, concat(lang, '/', source, '/', CAST(doc_id // 20 AS VARCHAR), '.txt') AS src_path, text FROM documents)
SELECT lang AS package, source AS version, count(*) AS files, count(DISTINCT text) AS checksums, TRUE AS is_indexed
FROM dim GROUP BY ALL"""


def _release_inputs(w: World) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Definitions, available versions and release files: the documents, one version per language and source."""
    documents = w.table("documents")
    release_files = documents.select(
        F.col("lang").alias("package"),
        F.col("source").alias("version"),
        F.concat_ws("/", "lang", "source", F.concat((F.col("doc_id") / 20).cast("bigint").cast("string"), F.lit(".txt"))).alias("path"),
        F.encode("text", "UTF-8").alias("content"),
    )
    available = documents.select(
        F.col("lang").alias("package"), F.col("source").alias("name"), F.col("source").alias("internal_identifier"),
        F.lit("2020-01-01").cast("timestamp").alias("release_date"),
    ).distinct()
    packages = documents.select("lang").distinct().select(
        F.col("lang").alias("package"), F.lit("docs").alias("vendor"), F.array().cast("array<string>").alias("alternative_names"),
        F.array(F.struct(F.lit("/").alias("webroot"), F.lit("/").alias("src"))).alias("path_map"),
        F.lit(None).cast("string").alias("ignore_paths"),
    )
    return packages, available, release_files


def _version_counts(built: index_store.Index) -> DataFrame:
    used = index.version_files(built.files, built.uses)
    counts = used.groupBy("version_id").agg(
        F.count(F.lit(1)).alias("files"), F.count_distinct("checksum").alias("checksums")
    )
    named = index.describe_versions(counts, built.versions, built.packages).join(
        built.versions.select("version_id", F.col("indexed").isNotNull().alias("is_indexed")), "version_id"
    )
    return named.select(
        F.col("package_name").alias("package"), F.col("version_name").alias("version"), "files", "checksums", "is_indexed"
    )


@query("build_index", _BUILT_SQL)
def build_index(w: World) -> DataFrame:
    """A full index of the documents as release files, counted per version."""
    packages, available, release_files = _release_inputs(w)
    space = w.workspace("build_index")
    path = space.folder("index")
    index_store.write_index(
        index_build.build_index(index_store.empty_index(w.spark), packages, available, release_files, space), path
    )
    return _version_counts(index_store.read_index(w.spark, path))


@query("settled_index", _BUILT_SQL)
def settled_index(w: World) -> DataFrame:
    """The same from a stream: files of each version come in several batches and wait as checksums."""
    packages, available, release_files = _release_inputs(w)
    space = w.workspace("settled_index")
    landing, path, progress = space.folder("landing"), space.folder("index"), space.folder("progress")
    timed = release_files.withColumn("fetched", F.timestamp_seconds(F.lit(1_600_000_000)))
    # as many files as the documents have parts, so that no task reads more of a larger table
    pieces = max(4, timed.rdd.getNumPartitions())
    timed.repartition(pieces).write.parquet(landing)
    settling.clock_row(timed, "fetched", 2_000_000_000).write.mode("append").parquet(landing)
    definitions, listed = space.save(packages, "definitions"), space.save(available, "available")
    source = w.spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", max(3, pieces * 3 // 4)).parquet(landing)
    # a second run has nothing to do
    for _ in range(2):
        incremental.settled_index(source, "fetched", 3600, definitions, listed, path, progress, space)
    return _version_counts(incremental.latest_index(w.spark, path))
