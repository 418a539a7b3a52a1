"""Differences between the files of versions, for many version pairs in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from filespoor.functions.text import natural_key

PAIR = ["old_version_id", "new_version_id"]


def previous_versions(versions: DataFrame) -> DataFrame:
    """``(package_id, old_version_id, new_version_id)`` of neighbours in natural order.

    The windows are over the release lists of packages, which are short rows of a
    dimension table; no file is involved.
    """
    order = W.partitionBy("package_id").orderBy("_key", "version_id")
    return (
        versions.withColumn("_key", natural_key(F.col("name")))
        .withColumn("old_version_id", F.lag("version_id").over(order))
        .filter(F.col("old_version_id").isNotNull())
        .select("package_id", "old_version_id", F.col("version_id").alias("new_version_id"))
    )


def files_at_path(used_files: DataFrame) -> DataFrame:
    """One file per version and path; of several, the one with the greatest source path."""
    return used_files.groupBy("version_id", "webroot_path").agg(
        F.max(F.struct("src_path", "checksum")).alias("file")
    )


def version_delta(pairs: DataFrame, at_path: DataFrame) -> DataFrame:
    """Files that were changed, created or deleted between the versions of each pair.

    Both sides are tagged and grouped by pair and path, which needs one shuffle where a
    full outer join needs two.
    """
    keys = pairs.select(*PAIR)
    old = keys.join(at_path.withColumnRenamed("version_id", "old_version_id"), "old_version_id").select(
        *PAIR, "webroot_path", F.col("file").alias("old"), F.lit(None).cast(at_path.schema["file"].dataType).alias("new")
    )
    new = keys.join(at_path.withColumnRenamed("version_id", "new_version_id"), "new_version_id").select(
        *PAIR, "webroot_path", F.lit(None).cast(at_path.schema["file"].dataType).alias("old"), F.col("file").alias("new")
    )
    change = (
        F.when(F.col("old").isNull(), "created")
        .when(F.col("new").isNull(), "deleted")
        .when(~F.col("old.checksum").eqNullSafe(F.col("new.checksum")), "changed")
    )
    return (
        old.unionByName(new)
        .groupBy(*PAIR, "webroot_path")
        .agg(F.max("old").alias("old"), F.max("new").alias("new"))
        .withColumn("change", change)
        .filter(F.col("change").isNotNull())
        .select(
            *PAIR,
            "webroot_path",
            "change",
            F.col("old.src_path").alias("old_path"),
            F.col("new.src_path").alias("new_path"),
        )
    )


def delta_listing(delta: DataFrame) -> DataFrame:
    """Rendered lines: changed files first, then created, then deleted ones."""
    group = F.when(F.col("change") == "created", 1).when(F.col("change") == "deleted", 2).otherwise(0)
    line = (
        F.when(F.col("change") == "created", F.concat(F.lit("newly created: "), F.col("new_path")))
        .when(F.col("change") == "deleted", F.concat(F.lit("deleted: "), F.col("old_path")))
        .otherwise(F.concat(F.col("old_path"), F.lit(" -> "), F.col("new_path")))
    )
    return (
        delta.withColumn("group", group)
        .withColumn("line", line)
        .orderBy(*PAIR, "group", "old_path", "new_path")
    )


def delta_counts(delta: DataFrame, pairs: DataFrame) -> DataFrame:
    """Number of differing files per pair, 0 for equal versions."""
    counts = delta.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("changed_files"))
    return pairs.join(counts, PAIR, "left").withColumn(
        "changed_files", F.coalesce("changed_files", F.lit(0).cast("bigint"))
    )
