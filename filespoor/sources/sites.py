"""Site lists to scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from filespoor import fixed_values as fv, schema
from filespoor.functions.text import default_scheme


def ranked_sites(spark: SparkSession, path: str, rank: int, count: int) -> DataFrame:
    """Ranking entries ``rank .. rank + count - 1`` of a CSV file with a header."""
    last = rank + count - 1
    if not (1 <= rank <= fv.MAX_SITE_RANK and 1 <= last <= fv.MAX_SITE_RANK):
        raise ValueError(f"valid ranks are 1 to {fv.MAX_SITE_RANK}, not {rank} to {last}")
    ranking = spark.read.csv(path, schema=schema.RANKED_SITE, header=True)
    return ranking.filter(F.col("rank").between(rank, last))


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """``(position, url)`` of one or more files with one URL per line.

    Files follow each other by name, and their splits by offset; lines are counted per
    split first, so no split passes through another.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(
        F.monotonically_increasing_id().alias("_id"), F.col("value").alias("url"),
        meta["file_path"].alias("_file"), meta["file_block_start"].alias("_start"),
    )
    # one row per split, so the running sum is over a handful of rows; ids rise within a split
    earlier = W.orderBy("_file", "_start").rowsBetween(W.unboundedPreceding, -1)
    splits = (
        lines.groupBy("_file", "_start")
        .agg(F.count(F.lit(1)).alias("_size"), F.min("_id").alias("_first"))
        .select("_file", "_start", "_first", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    )
    return lines.join(splits, ["_file", "_start"]).select(
        (F.col("_before") + F.col("_id") - F.col("_first")).alias("position"), "url"
    )


def slice_sites(sites: DataFrame, count: int, skip: int = 0, order: str = "position") -> DataFrame:
    """The ``count`` sites after the first ``skip`` ones, by a position that starts at 0."""
    return sites.filter(F.col(order).between(skip, skip + count - 1))


def site_urls(sites: DataFrame, column: str) -> DataFrame:
    """Add the URL to request; a missing scheme becomes http."""
    return sites.withColumn("url", default_scheme(F.col(column)))
