"""Lookups and statistics over the fingerprint index.

Tables: ``files(file_id, src_path, webroot_path, checksum)``, ``uses(version_id, file_id)``,
``versions`` and ``packages``. Every lookup is one job over all keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from filespoor.params import MICRO


def version_files(files: DataFrame, uses: DataFrame) -> DataFrame:
    """One row per use: ``version_id`` with the columns of its file.

    Every use has one file, so a file with very many users adds no rows to either side
    and the adaptive skew join splits it.
    """
    return uses.join(files, "file_id")


def checksum_versions(used_files: DataFrame) -> DataFrame:
    """Distinct ``(checksum, version_id)``."""
    return used_files.select("checksum", "version_id").distinct()


def path_versions(used_files: DataFrame) -> DataFrame:
    """Distinct ``(webroot_path, version_id)``."""
    return used_files.select("webroot_path", "version_id").distinct()


def path_checksums(used_files: DataFrame) -> DataFrame:
    """Distinct ``(version_id, webroot_path, checksum)``."""
    return used_files.select("version_id", "webroot_path", "checksum").distinct()


def idf_weights(by_checksum: DataFrame, versions: DataFrame) -> DataFrame:
    """``(checksum, weight_micro)`` from distinct ``(checksum, version_id)``.

    The weight is log10(all versions / versions that use the checksum), in micro units;
    versions that are not indexed count too. A checksum without users has no row and
    weighs ``UNKNOWN_MICRO``.
    """
    total = versions.agg(F.count(F.lit(1)).cast("double").alias("total")).scalar()
    users = by_checksum.groupBy("checksum").agg(F.count(F.lit(1)).alias("users"))
    log10 = F.ln(total / F.col("users")) / F.ln(F.lit(10.0))
    return users.select("checksum", F.round(log10 * MICRO).cast("bigint").alias("weight_micro"))


UNKNOWN_MICRO = MICRO


def files_by_checksum(files: DataFrame, checksums: DataFrame) -> DataFrame:
    """Files whose checksum occurs in ``checksums``."""
    return files.join(checksums.select("checksum").distinct(), "checksum", "left_semi")


def files_of_versions(files: DataFrame, uses: DataFrame, versions: DataFrame) -> DataFrame:
    """Files used by at least one of ``versions``."""
    wanted = uses.join(versions.select("version_id").distinct(), "version_id", "left_semi")
    return files.join(wanted.select("file_id").distinct(), "file_id", "left_semi")


def describe_versions(rows: DataFrame, versions: DataFrame, packages: DataFrame) -> DataFrame:
    """Add the names of version and package to rows with a ``version_id``."""
    named = versions.join(packages, "package_id").select(
        "version_id",
        versions["package_id"],
        packages["name"].alias("package_name"),
        packages["vendor"],
        versions["name"].alias("version_name"),
        versions["internal_identifier"],
        versions["release_date"],
    )
    return rows.join(named, "version_id")


def users_by_checksum(keys: DataFrame, by_checksum: DataFrame) -> DataFrame:
    """``(checksum, version_id)`` for every checksum in ``keys``."""
    return by_checksum.join(keys.select("checksum").distinct(), "checksum", "left_semi")


def users_by_path(keys: DataFrame, by_path: DataFrame) -> DataFrame:
    """``(webroot_path, version_id)`` for every path in ``keys``."""
    return by_path.join(keys.select("webroot_path").distinct(), "webroot_path", "left_semi")


def almost_unique_files(uses: DataFrame, max_users: int) -> DataFrame:
    """``(version_id, file_id, user_count)`` of files with at most ``max_users`` users.

    Counting combines before the shuffle, and only files with few users are joined back,
    so a file that all versions use never forms a group.
    """
    rare = (
        uses.groupBy("file_id")
        .agg(F.count(F.lit(1)).alias("user_count"))
        .filter(F.col("user_count") <= max_users)
    )
    return uses.join(rare, "file_id").select("version_id", "file_id", "user_count")


def unique_files(uses: DataFrame) -> DataFrame:
    """``(version_id, file_id)`` of files that no other version uses."""
    return (
        uses.groupBy("file_id")
        .agg(F.count(F.lit(1)).alias("n"), F.first("version_id").alias("version_id"))
        .filter(F.col("n") == 1)
        .select("version_id", "file_id")
    )


def popular_files(uses: DataFrame, chosen: DataFrame, limit: int) -> DataFrame:
    """``(file_id, user_count)`` of the ``limit`` files that most chosen versions use.

    Files that only other versions use count as 0 and fill up the list.
    """
    marked = uses.join(
        chosen.select("version_id").distinct().withColumn("_chosen", F.lit(True)),
        "version_id",
        "left",
    )
    return (
        marked.groupBy("file_id")
        .agg(F.count("_chosen").alias("user_count"))
        .orderBy(F.desc("user_count"), "file_id")
        .limit(limit)
    )


def users_within(top_files: DataFrame, uses: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen versions that use the given files, one row per pair."""
    users = uses.join(chosen.select("version_id").distinct(), "version_id", "left_semi")
    return top_files.join(users, "file_id", "left")


def file_counts(versions: DataFrame, uses: DataFrame) -> DataFrame:
    """``(version_id, file_count)``, 0 for versions without files."""
    counts = uses.groupBy("version_id").agg(F.count(F.lit(1)).alias("file_count"))
    return versions.join(counts, "version_id", "left").select(
        "version_id", F.coalesce("file_count", F.lit(0).cast("bigint")).alias("file_count")
    )


def lookup_version_ids(rows: DataFrame, versions: DataFrame, packages: DataFrame) -> DataFrame:
    """Resolve ``(package, vendor, internal_identifier)`` to package and version ids."""
    keys = versions.join(packages, "package_id").select(
        packages["name"].alias("package"),
        packages["vendor"].alias("vendor"),
        versions["internal_identifier"],
        versions["package_id"],
        versions["version_id"],
    )
    return rows.join(keys, ["package", "vendor", "internal_identifier"], "left")


def lookup_file_ids(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Resolve ``(src_path, webroot_path, checksum)`` to a file id, NULL if unknown."""
    return rows.join(files, ["src_path", "webroot_path", "checksum"], "left")
