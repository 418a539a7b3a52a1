"""Steps that turn release files into index tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from filespoor import fixed_values as fv
from filespoor.functions.fingerprint import NORMALIZERS, index_entry
from filespoor.functions.text import file_type, matches_at_start
from filespoor.functions.urls import join_paths, strip_slash

VERSION_KEY = ["package_id", "internal_identifier"]
FILE_KEY = ["src_path", "webroot_path", "checksum"]


def missing_versions(available: DataFrame, indexed: DataFrame) -> DataFrame:
    return available.join(indexed.select(*VERSION_KEY).distinct(), VERSION_KEY, "left_anti")


def gone_versions(indexed: DataFrame, available: DataFrame) -> DataFrame:
    return indexed.join(available.select(*VERSION_KEY).distinct(), VERSION_KEY, "left_anti")


def expand_path_map(release_files: DataFrame, definitions: DataFrame) -> DataFrame:
    """Place every release file below the web root, once per fitting path map entry.

    A file fits if its path starts with the source prefix (plain text, not a folder).
    """
    entries = definitions.select("package", "ignore_paths", F.explode("path_map").alias("entry")).select(
        "package",
        "ignore_paths",
        strip_slash(F.col("entry.src")).alias("_src"),
        strip_slash(F.col("entry.webroot")).alias("_webroot"),
    )
    path, src = F.col("path"), F.col("_src")
    inner = F.substr(path, F.length(src) + 1)
    return (
        release_files.join(entries, "package")
        .filter(F.startswith(path, src))
        .withColumn("src_path", path)
        .withColumn("webroot_path", join_paths(F.col("_webroot"), inner))
        .withColumn("file_name", basename_of(inner))
        .drop("_src", "_webroot", "path")
    )


def basename_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def drop_ignored(placed: DataFrame) -> DataFrame:
    """Drop files whose source path matches the ignore pattern of their package."""
    ignored = F.coalesce(matches_at_start(F.col("src_path"), F.col("ignore_paths")), F.lit(False))
    return placed.filter(~ignored).drop("ignore_paths")


def fingerprint_files(
    placed: DataFrame, raw: bool = False, types: tuple = fv.FILE_TYPES,
    normalizers: Mapping[str, Callable[[bytes], bytes]] = NORMALIZERS,
) -> DataFrame:
    """Classify by name and replace ``content`` by ``file_type`` and ``checksum``.

    ``types`` and ``normalizers`` say which types there are and how files of a type are
    brought into canonical form; others can be added to those of the package.

    Structured files that cannot be parsed are dropped, unless their name also has a
    leading dot: those count as dotfiles and keep their raw checksum.
    """
    typed = placed.withColumn("file_type", file_type(F.col("file_name"), types=types)).filter(
        F.col("file_type").isNotNull()
    )
    hidden = F.startswith(F.col("file_name"), F.lit("."))
    made = typed.withColumn("_entry", index_entry(F.col("file_type"), hidden, F.col("content"), raw, normalizers))
    kept = made.drop("content", "file_name", "file_type").filter("_entry.keep")
    return kept.withColumns({c: F.col(f"_entry.{c}") for c in ("file_type", "checksum")}).drop("_entry")


def upsert_packages(existing: DataFrame, incoming: DataFrame, update: bool = True) -> DataFrame:
    """Merge packages by ``(name, vendor)``; known ones take the new alternative names."""
    key = ["name", "vendor"]
    new = incoming.select(*key, F.col("alternative_names").alias("_new"), F.lit(True).alias("_incoming"))
    names = F.col("alternative_names")
    if update:
        names = F.when(F.col("_incoming"), F.col("_new")).otherwise(names)
    else:
        names = F.when(F.col("package_id").isNull(), F.col("_new")).otherwise(names)
    merged = existing.join(new, key, "full")
    return merged.select(
        F.coalesce("package_id", F.xxhash64(*key)).alias("package_id"),
        *key,
        names.alias("alternative_names"),
    )


def upsert_versions(existing: DataFrame, incoming: DataFrame, policy: str = "name_only") -> DataFrame:
    """Merge versions by package and internal identifier.

    ``update_all`` takes over name and release date of known versions, ``name_only`` the
    name, ``ignore`` nothing. New versions are not marked as indexed.
    """
    taken = {"update_all": ("name", "release_date"), "name_only": ("name",), "ignore": ()}[policy]
    new = incoming.select(
        *VERSION_KEY,
        F.col("name").alias("_name"),
        F.col("release_date").alias("_release_date"),
    )

    def merged(column: str) -> Column:
        known = F.col("version_id").isNotNull()
        if column in taken:
            return F.coalesce(f"_{column}", column).alias(column)
        return F.when(known, F.col(column)).otherwise(F.col(f"_{column}")).alias(column)

    return existing.join(new, VERSION_KEY, "full").select(
        F.coalesce("version_id", F.xxhash64(*VERSION_KEY)).alias("version_id"),
        *VERSION_KEY,
        merged("name"),
        merged("release_date"),
        "indexed",
    )


def file_hash(attempt: int) -> Column:
    """The id that a file's key tries first, second, ..."""
    return F.xxhash64(*FILE_KEY, *[F.lit(attempt)] * (attempt > 0))


def static_files_dim(
    existing: DataFrame | None, found: DataFrame, save: Callable[[DataFrame, str], DataFrame] = lambda df, name: df,
    id_of: Callable[[int], Column] = file_hash,
) -> DataFrame:
    """Distinct files with an id per ``(src_path, webroot_path, checksum)``.

    Known files keep their id. The id of a new file is a 64-bit hash of its key. Of new files that meet in an id the first by
    key gets it, if no file has it yet; the others try another hash, until no two files share an id. A round beyond the
    first is one over the few files that met.
    """
    keys = found.select(*FILE_KEY).distinct()
    if existing is None:
        assigned, pending = keys.limit(0).select(F.lit(0).cast("bigint").alias("file_id"), *FILE_KEY), keys
    else:
        assigned = existing.groupBy(*FILE_KEY).agg(F.max("file_id").alias("file_id")).select("file_id", *FILE_KEY)
        pending = keys.join(assigned, FILE_KEY, "left_anti")
    attempt = 0
    while True:
        tried = pending.withColumn("file_id", id_of(attempt))
        free = tried.join(assigned.select("file_id"), "file_id", "left_anti") if existing is not None or attempt else tried
        first = W.partitionBy("file_id").orderBy(*FILE_KEY)
        marked = free.withColumn("_place", F.row_number().over(first))
        taken = save(marked.filter("_place = 1").select("file_id", *FILE_KEY), f"file-ids-{attempt}")
        assigned = assigned.unionByName(taken)
        pending = save(pending.join(taken, FILE_KEY, "left_anti"), f"files-without-id-{attempt}")
        if pending.isEmpty():
            return assigned
        attempt += 1


def static_file_uses(found: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct ``(version_id, file_id)`` of fingerprinted files."""
    return found.join(files, FILE_KEY).select("version_id", "file_id").distinct()


def delete_versions(
    versions: DataFrame, uses: DataFrame, gone: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Versions and uses without the versions in ``gone``."""
    ids = gone.select("version_id").distinct()
    return (
        versions.join(ids, "version_id", "left_anti"),
        uses.join(ids, "version_id", "left_anti"),
    )
