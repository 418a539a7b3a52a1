"""Vulnerability records joined with the versions of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from filespoor.operators.signals import name_keys
from filespoor.operators.skew import HOT_ROWS, salted_join


def affected_products(items: DataFrame) -> DataFrame:
    """``(cve_id, vendor, product_name, version_value)`` rows of feed items.

    ``items(cve)`` holds one record per row.
    """
    products = (
        items.select(
            F.col("cve.CVE_data_meta.ID").alias("cve_id"),
            F.explode("cve.affects.vendor.vendor_data").alias("_vendor"),
        )
        .select(
            "cve_id",
            F.col("_vendor.vendor_name").alias("vendor"),
            F.explode("_vendor.product.product_data").alias("_product"),
        )
    )
    return products.select(
        "cve_id",
        "vendor",
        F.col("_product.product_name").alias("product_name"),
        F.explode("_product.version.version_data.version_value").alias("version_value"),
    )


def resolve_names(names: DataFrame, packages: DataFrame, versions: DataFrame) -> DataFrame:
    """``(product_name, version_value, version_id)`` for distinct name pairs.

    Names are compared without case; a package also answers to its alternative names;
    only indexed versions count.
    """
    indexed = versions.filter(F.col("indexed").isNotNull()).select(
        "package_id", "version_id", F.lower("name").alias("_version_key")
    )
    keys = name_keys(packages).join(indexed, "package_id").select(
        F.col("name_key").alias("_product_key"), "_version_key", "version_id"
    ).distinct()
    return (
        names.select("product_name", "version_value").distinct()
        .withColumn("_product_key", F.lower("product_name"))
        .withColumn("_version_key", F.lower("version_value"))
        .join(keys, ["_product_key", "_version_key"])
        .select("product_name", "version_value", "version_id")
    )


def cve_versions(
    affected: DataFrame, packages: DataFrame, versions: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Distinct ``(cve_id, version_id)``; vendors are not compared."""
    resolved = resolve_names(affected, packages, versions)
    return (
        salted_join(
            affected.select("cve_id", "product_name", "version_value"),
            resolved,
            ["product_name", "version_value"],
            hot_rows=hot_rows,
        )
        .select("cve_id", "version_id")
        .distinct()
    )


def cve_stats(pairs: DataFrame) -> DataFrame:
    """``(version_id, cve_ids)``: sorted distinct record ids per version."""
    return pairs.groupBy("version_id").agg(F.sort_array(F.collect_set("cve_id")).alias("cve_ids"))


def vulnerable_flags(versions: DataFrame, vulnerable: DataFrame) -> DataFrame:
    """Add ``vulnerable`` to versions: whether any record affects them."""
    marked = vulnerable.select("version_id").distinct().withColumn("_hit", F.lit(True))
    return (
        versions.join(marked, "version_id", "left")
        .withColumn("vulnerable", F.coalesce("_hit", F.lit(False)))
        .drop("_hit")
    )
