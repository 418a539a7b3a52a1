"""The fingerprint index as parquet tables, one folder per snapshot."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from filespoor import schema
from filespoor.operators import index as ops
from filespoor.operators.matching import pack_index
from filespoor.operators.version_sets import VersionSets
from filespoor.session import Workspace

TABLES = {
    "packages": schema.PACKAGE,
    "versions": schema.VERSION,
    "files": schema.STATIC_FILE,
    "uses": schema.STATIC_FILE_USE,
}


@dataclass(frozen=True)
class Index:
    packages: DataFrame
    versions: DataFrame
    files: DataFrame
    uses: DataFrame

    def indexed_versions(self) -> DataFrame:
        return self.versions.filter(F.col("indexed").isNotNull())


@dataclass(frozen=True)
class MatchTables:
    """Tables derived from an index for matching."""

    by_checksum: DataFrame
    by_path: DataFrame
    path_checksums: DataFrame
    idf: DataFrame
    packed: VersionSets


def derive_match_tables(
    path_checksums: DataFrame,
    versions: DataFrame,
    save: Callable[[DataFrame, str], DataFrame] = lambda df, name: df,
) -> MatchTables:
    """Match tables from distinct ``(version_id, webroot_path, checksum)``.

    With a ``save`` that writes, each table is computed once from the written ones.
    """
    pairs = save(path_checksums, "path-checksums")
    by_checksum = save(ops.checksum_versions(pairs), "checksum-versions")
    by_path = save(ops.path_versions(pairs), "path-versions")
    idf = save(ops.idf_weights(by_checksum, versions), "idf")
    return MatchTables(by_checksum, by_path, pairs, idf, pack_index(by_checksum, by_path, save))


def match_tables(index: Index) -> MatchTables:
    return derive_match_tables(ops.path_checksums(ops.version_files(index.files, index.uses)), index.versions)


def stage_match_tables(index: Index, workspace: Workspace) -> MatchTables:
    """Write the derived tables of an index once, to be matched many times.

    Shuffled by file alone, the rows of a file stay beside each other, where their long texts take little space.
    """
    used = ops.version_files(index.files, index.uses).select("version_id", "webroot_path", "checksum")
    return derive_match_tables(ops.path_checksums(used.repartition("webroot_path", "checksum")), index.versions, workspace.save)


def empty_index(spark: SparkSession) -> Index:
    return Index(**{name: spark.createDataFrame([], table) for name, table in TABLES.items()})


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(**{name: spark.read.schema(table).parquet(f"{path}/{name}") for name, table in TABLES.items()})


def write_index(index: Index, path: str) -> None:
    """Write a new snapshot; files first, versions last.

    The versions carry the mark that they are indexed, so a write that was cut off never
    shows versions whose files are missing. Files are sorted within their partitions by
    checksum, so row groups can be skipped.
    """
    index.files.sortWithinPartitions("checksum").write.parquet(f"{path}/files")
    index.uses.write.parquet(f"{path}/uses")
    index.packages.write.parquet(f"{path}/packages")
    index.versions.write.parquet(f"{path}/versions")


def mark_indexed(versions: DataFrame, done: DataFrame, moment: Column) -> DataFrame:
    """Mark the versions in ``done`` as fully indexed."""
    marks = done.select("version_id").distinct().withColumn("_done", F.lit(True))
    return (
        versions.join(marks, "version_id", "left")
        .withColumn("indexed", F.when(F.col("_done"), moment).otherwise(F.col("indexed")))
        .drop("_done")
    )


def versions_of(packages: DataFrame, versions: DataFrame, indexed_only: bool = True) -> DataFrame:
    """Versions of the given packages."""
    rows = versions.filter(F.col("indexed").isNotNull()) if indexed_only else versions
    return rows.join(packages.select("package_id").distinct(), "package_id", "left_semi")


def export_files(dump: DataFrame) -> DataFrame:
    """Checksums of a text dump (``\\x`` and hex digits) as binary."""
    return dump.withColumn("checksum", F.unhex(F.substr("checksum", F.lit(3))))


def export_packages(dump: DataFrame) -> DataFrame:
    """Alternative names of a text dump (``{a,b}``) as a list; also as JSON text."""
    inner = F.regexp_extract("alternative_names", r"^\{(.*)\}$", 1)
    names = F.transform(F.split(inner, ","), lambda n: F.regexp_replace(n, '^"|"$', ""))
    return dump.withColumn("alternative_names", names).withColumn(
        "alternative_names_json", F.to_json("alternative_names")
    )


def export_index(index: Index, path: str) -> None:
    """A compact copy of the index without scan results."""
    for name in TABLES:
        df = getattr(index, name)
        order = "checksum" if name == "files" else df.columns[0]
        df.sortWithinPartitions(order).write.option("compression", "zstd").parquet(f"{path}/{name}")
