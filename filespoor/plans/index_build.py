"""Building and cleaning the fingerprint index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from filespoor.operators import build
from filespoor.session import Workspace
from filespoor.sources.index_store import Index, empty_index, mark_indexed, read_index, write_index


def select_definitions(definitions: DataFrame, glob: str | None) -> DataFrame:
    """Definitions whose package name fits a shell glob."""
    from filespoor.functions.text import glob_regex

    return definitions if glob is None else definitions.filter(F.rlike(F.lower("package"), F.lit(glob_regex(glob))))


def available_with_ids(available: DataFrame, packages: DataFrame) -> DataFrame:
    """Attach package ids to ``available(package, name, internal_identifier, release_date)``."""
    ids = packages.select(F.col("name").alias("package"), "package_id")
    return available.join(ids, "package").select("package_id", "package", "name", "internal_identifier", "release_date")


def fingerprinted_files(release_files: DataFrame, definitions: DataFrame, raw: bool = False, **kinds) -> DataFrame:
    """``(package, version, src_path, webroot_path, file_type, checksum)`` of release files.

    ``kinds`` are ``types`` and ``normalizers`` of ``fingerprint_files``.
    """
    placed = build.drop_ignored(build.expand_path_map(release_files, definitions))
    return build.fingerprint_files(placed, raw, **kinds)


def _listed(index: Index, definitions: DataFrame, available: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Packages and versions with those that are listed now, and ``(package, version, version_id)`` of missing ones."""
    incoming = definitions.select(F.col("package").alias("name"), "vendor", "alternative_names")
    packages = build.upsert_packages(index.packages, incoming)
    listed = available_with_ids(available, packages)
    missing = build.missing_versions(listed, index.indexed_versions())
    versions = build.upsert_versions(index.versions, missing.drop("package"))
    ids = versions.select("package_id", "internal_identifier", "version_id")
    todo = missing.join(ids, build.VERSION_KEY).select(
        "package", F.col("internal_identifier").alias("version"), "version_id"
    )
    return packages, versions, todo


def _filled(
    index: Index, packages: DataFrame, versions: DataFrame, found: DataFrame, done: DataFrame, workspace: Workspace
) -> Index:
    """The tables with the written checksums ``found`` of the versions ``done``."""
    files = workspace.save(build.static_files_dim(index.files, found, workspace.save), "files")
    uses = index.uses.unionByName(build.static_file_uses(found, files)).distinct()
    marked = mark_indexed(versions, done, F.current_timestamp())
    return Index(packages=packages, versions=marked, files=files, uses=uses)


def build_index(
    index: Index,
    definitions: DataFrame,
    available: DataFrame,
    release_files: DataFrame,
    workspace: Workspace,
    raw: bool = False,
    **kinds,
) -> Index:
    """The index with all available versions that were missing and have files.

    ``available(package, name, internal_identifier, release_date)`` lists versions,
    ``release_files(package, version, path, content)`` holds their files; ``version`` is
    the internal identifier. Only files of missing versions are read on, once: their
    checksums are written and all tables come from them. A version without any file here
    is listed, but stays missing until its files come.
    """
    packages, versions, todo = _listed(index, definitions, available)
    wanted = release_files.join(todo, ["package", "version"])
    found = workspace.save(
        fingerprinted_files(wanted, definitions, raw, **kinds).select("version_id", *build.FILE_KEY), "found"
    )
    # also versions of which every file is ignored have been read
    come = release_files.select("package", "version").distinct()
    done = todo.join(come, ["package", "version"], "left_semi")
    return _filled(index, packages, versions, found, done, workspace)


def build_from_checksums(
    index: Index, definitions: DataFrame, available: DataFrame, checksums: DataFrame, workspace: Workspace
) -> Index:
    """``build_index`` from ``checksums(package, version, src_path, webroot_path, checksum)``: no content is moved.

    A row with null ``src_path`` tells only that files of its version have come.
    """
    packages, versions, todo = _listed(index, definitions, available)
    came = workspace.save(checksums.join(todo, ["package", "version"]).select("version_id", *build.FILE_KEY), "came")
    found = came.filter(F.col("src_path").isNotNull())
    done = todo.join(came.select("version_id").distinct(), "version_id", "left_semi")
    return _filled(index, packages, versions, found, done, workspace)


def update_index(
    spark: SparkSession,
    old_path: str | None,
    new_path: str,
    definitions: DataFrame,
    available: DataFrame,
    release_files: DataFrame,
) -> Index:
    """Write the next snapshot of the index and read it back."""
    current = read_index(spark, old_path) if old_path else empty_index(spark)
    space = Workspace(spark, "index-build")
    write_index(build_index(current, definitions, available, release_files, space), new_path)
    return read_index(spark, new_path)


def gc_index(index: Index, available: DataFrame) -> Index:
    """The index without indexed versions that are no longer available.

    Uses of removed versions go with them; files stay, as other versions may use them.
    """
    listed = available_with_ids(available, index.packages)
    gone = build.gone_versions(index.indexed_versions(), listed)
    versions, uses = build.delete_versions(index.versions, index.uses, gone)
    return Index(index.packages, versions, index.files, uses)
