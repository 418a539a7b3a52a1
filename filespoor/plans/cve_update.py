"""Refreshing the vulnerability table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from filespoor.operators import cve
from filespoor.sources.index_store import Index


def update_cve(items: DataFrame, index: Index) -> DataFrame:
    """``(version_id, cve_ids)`` from feed records of any number of years."""
    affected = cve.affected_products(items)
    return cve.cve_stats(cve.cve_versions(affected, index.packages, index.versions))


def write_cve_stats(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").parquet(path)
