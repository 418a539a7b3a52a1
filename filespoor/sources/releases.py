"""Release inputs: definitions, tag lists, package manifests, file snapshots."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from filespoor import fixed_values as fv, schema
from filespoor.functions.fingerprint import location_checksum
from filespoor.functions.text import dashed_tag_name, java_regex, matches_at_start


def definitions(spark: SparkSession) -> DataFrame:
    """The software definitions as a table."""
    rows = []
    for name, vendor, alternatives, source, pattern, path_map in fv.DEFINITIONS:
        regex, group = java_regex(pattern)
        rows.append(
            (name, vendor, list(alternatives), source, regex, group, None,
             name in fv.DASHED_TAG_PACKAGES, [tuple(entry) for entry in path_map], None)
        )
    return spark.createDataFrame(rows, schema.DEFINITION)


def file_snapshot(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Release files below ``folder/package/version/``, one row per file with its bytes. Spark lists no empty files."""
    return _snapshot_files(spark, folder, glob).select("package", "version", "path", "content")


def file_snapshot_checksums(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``(package, version, path, length, checksum)`` of the same files, of any size.

    Only names and lengths are listed; tasks read the files in pieces and keep none of them. Files are dealt to tasks by name,
    as a listing has many in one task. Spark lists no empty files.
    """
    listed = _snapshot_files(spark, folder, glob).select("package", "version", "path", "length", "location")
    dealt = listed.repartition(max(spark.sparkContext.defaultParallelism, 1), "location")
    return dealt.select("package", "version", "path", "length", location_checksum("location").alias("checksum"))


def _snapshot_files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    layout = r"/([^/]+)/([^/]+)/(.*)$"
    prefix = folder.rstrip("/").rsplit("/", 1)[-1]
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(folder)
        .withColumnRenamed("path", "location")
        .withColumn("_inner", F.regexp_extract("location", f"/{prefix}{layout}", 0))
    )
    part = f"^/{prefix}{layout}"
    return files.select(
        F.regexp_extract("_inner", part, 1).alias("package"),
        F.regexp_extract("_inner", part, 2).alias("version"),
        F.regexp_extract("_inner", part, 3).alias("path"),
        "location",
        "length",
        "content",
    )


def read_release_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.RELEASE_FILE).parquet(path)


def version_refs(
    refs: DataFrame, defs: DataFrame, derive: Mapping[str, Callable[[Column], Column]] | None = None
) -> DataFrame:
    """``(package, name, internal_identifier, release_date)`` of accepted tags.

    A tag must fit the version pattern from its start and not the exclude pattern. The
    named group gives the version name, the whole tag if there is none; packages with
    dashed tags derive the name from the whole tag. ``derive`` has, by package, functions
    of the tag that make the name instead.
    """
    tag = F.regexp_extract("ref", "^refs/tags/(.*)$", 1)
    tags = refs.filter(F.startswith("ref", F.lit("refs/tags/"))).withColumn("tag", tag)
    joined = tags.join(
        defs.select("package", "version_pattern", "version_group", "exclude_pattern", "dashed_tags"),
        "package",
    )
    fits = F.col("version_pattern").isNull() | matches_at_start(F.col("tag"), F.col("version_pattern"))
    excluded = F.coalesce(matches_at_start(F.col("tag"), F.col("exclude_pattern")), F.lit(False))
    group = F.expr("regexp_extract(tag, version_pattern, version_group)")
    name = (
        F.when(F.col("dashed_tags"), dashed_tag_name(F.col("tag")))
        .when(F.col("version_pattern").isNotNull() & (F.col("version_group") > 0), group)
        .otherwise(F.col("tag"))
    )
    for package, make in (derive or {}).items():
        name = F.when(F.col("package") == package, make(F.col("tag"))).otherwise(name)
    return joined.filter(fits & ~excluded).select(
        "package",
        name.alias("name"),
        F.col("tag").alias("internal_identifier"),
        F.timestamp_seconds("author_epoch").alias("release_date"),
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A package manifest as ``(stanza, position)``, one row per stanza.

    Positions rise by file name, place of the split in its file, and place in the split.
    """
    meta = F.col("_metadata")
    place = F.struct(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("id")
    )
    return spark.read.option("lineSep", "\n\n").text(path).select(F.col("value").alias("stanza"), place.alias("position"))


def package_manifest(stanzas: DataFrame, package: str | None = None) -> DataFrame:
    """``(name, version, filename)``; of equal versions the last stanza counts."""
    fields = stanzas.select(
        F.regexp_extract("stanza", r"Package:\s*([\w-]+)", 1).alias("name"),
        F.regexp_extract("stanza", r"Version:\s*(.*?)(\n|$)", 1).alias("version"),
        F.regexp_extract("stanza", r"Filename:\s*(.*?)(\n|$)", 1).alias("filename"),
        "position",
    ).filter(F.col("filename") != "")
    if package is not None:
        fields = fields.filter(F.col("name") == package)
    return fields.groupBy("name", "version").agg(F.max_by("filename", "position").alias("filename"))


def manifest_versions(manifest: DataFrame) -> DataFrame:
    """``(package, name, internal_identifier, release_date)`` of a manifest, ready for an index build.

    The file of a version identifies it; a manifest knows no dates.
    """
    return manifest.select(
        F.col("name").alias("package"), F.col("version").alias("name"), F.col("filename").alias("internal_identifier"),
        F.lit(None).cast("timestamp").alias("release_date"),
    )


def archive_versions(mapping: DataFrame, cached: DataFrame) -> DataFrame:
    """Version identifiers that can be downloaded or are cached."""
    return mapping.select("package", "version").union(cached.select("package", "version")).distinct()
