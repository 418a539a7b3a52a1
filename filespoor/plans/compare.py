"""Comparing versions of a package by their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from filespoor.operators import delta
from filespoor.operators.signals import packages_by_name
from filespoor.sources.index_store import Index


def _only(rows: DataFrame, what: str) -> int:
    """The single id of ``rows``; at most two rows are looked at."""
    found = rows.take(2)
    if len(found) != 1:
        raise ValueError(f"not exactly one match for {what}")
    return found[0][0]


def _release(versions: DataFrame, wanted: str | tuple[str | None, int]) -> int:
    """The id of the one version with a name, or of the one with a name and id."""
    name, own_id = wanted if isinstance(wanted, tuple) else (wanted, None)
    named = versions.filter(F.col("name").eqNullSafe(F.lit(name)))
    if own_id is not None:
        named = named.filter(F.col("version_id") == own_id)
    return _only(named.select("version_id"), name)


def compare_versions(
    index: Index, used_files: DataFrame, package: str, old: str | tuple[str | None, int], new: str | tuple[str | None, int]
) -> DataFrame:
    """Listing of the differences between two named versions of one package.

    Where several versions of the package share a name, ``(name, version_id)`` says which one is meant.
    """
    pattern = index.packages.sparkSession.createDataFrame([(package,)], "pattern STRING")
    package_id = _only(packages_by_name(pattern, index.packages).select("package_id"), package)
    versions = index.indexed_versions().filter(F.col("package_id") == package_id)
    ids = [_release(versions, wanted) for wanted in (old, new)]
    pair = index.packages.sparkSession.createDataFrame([tuple(ids)], "old_version_id BIGINT, new_version_id BIGINT")
    chosen = used_files.filter(F.col("version_id").isin(ids))
    return delta.delta_listing(delta.version_delta(pair, delta.files_at_path(chosen)))


def pairwise_comparison(index: Index, used_files: DataFrame) -> DataFrame:
    """Number of differing files between neighbouring indexed versions of every package."""
    pairs = delta.previous_versions(index.indexed_versions())
    return delta.delta_counts(delta.version_delta(pairs, delta.files_at_path(used_files)), pairs)
