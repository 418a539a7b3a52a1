"""Matching of observed assets against the index.

``assets(site_id, webroot_path, success, checksum)``: a failed asset has no checksum.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from filespoor.operators import skew
from filespoor.operators.index import UNKNOWN_MICRO
from filespoor.operators.skew import HOT_ROWS, salted_join
from filespoor.operators.version_sets import VersionSets, intern, no_checksum
from filespoor.params import MICRO


def content_key(assets: DataFrame) -> DataFrame:
    """Checksum of successful assets, an empty value of the same type for failed ones."""
    served = F.when(F.col("success"), F.col("checksum"))
    return assets.withColumn("checksum", F.coalesce(served, no_checksum(assets)))


def asset_kinds(assets: DataFrame) -> DataFrame:
    """Distinct path and content; matches depend on nothing else."""
    return content_key(assets).select("webroot_path", "checksum", "success").distinct()


def kind_matches(kinds: DataFrame, by_checksum: DataFrame, by_path: DataFrame) -> DataFrame:
    """``(webroot_path, checksum, version_id, is_using)`` of every asset kind.

    Versions that use the checksum match positively; those that only provide a file at
    the path match negatively. Versions come as one list per content and per path, so only lists are
    shuffled; rows are made from them where they are given out.
    """
    found = kinds.groupBy("webroot_path", "checksum").agg(F.max("success").alias("_success"))
    users = _version_list(by_checksum, "checksum", "_using")
    providers = _version_list(by_path, "webroot_path", "_providers")
    none = F.array().cast(users.schema["_using"].dataType)
    lists = (
        salted_join(salted_join(found, users, ["checksum"], "left"), providers, ["webroot_path"], "left")
        .withColumn("_using", F.when(F.col("_success"), F.col("_using")))
        .select("webroot_path", "checksum", F.coalesce("_using", none).alias("_using"), F.coalesce("_providers", none).alias("_providers"))
    )
    matches = F.array(
        F.struct(F.lit(True).alias("is_using"), F.col("_using").alias("versions")),
        F.struct(F.lit(False).alias("is_using"), F.array_except("_providers", "_using").alias("versions")),
    )
    return lists.select("webroot_path", "checksum", F.inline(matches)).select(
        "webroot_path", "checksum", F.explode("versions").alias("version_id"), "is_using"
    )


def _version_list(pairs: DataFrame, key: str, name: str) -> DataFrame:
    """The distinct versions of each ``key``; a missing version is one of them."""
    listed = pairs.groupBy(key).agg(F.collect_set("version_id").alias(name), F.max(F.col("version_id").isNull()).alias("_no_version"))
    missing = F.lit(None).cast(pairs.schema["version_id"].dataType)
    return listed.select(key, F.when(F.col("_no_version"), F.array_append(name, missing)).otherwise(F.col(name)).alias(name))


def weigh_assets(
    assets: DataFrame, idf: DataFrame, failed_micro: int = MICRO, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``found`` (some version uses the content) and ``weight_micro`` (its rarity).

    Failed assets and unknown content have fixed weights.
    """
    weights = idf.select("checksum", F.col("weight_micro").alias("_weight"))
    weight = F.when(~F.col("success"), F.lit(failed_micro)).otherwise(
        F.coalesce("_weight", F.lit(UNKNOWN_MICRO))
    )
    return (
        skew.near(weights, skew.NEAR_ROWS)(assets, weights, ["checksum"], "left", hot_rows=hot_rows)
        .withColumn("found", F.col("_weight").isNotNull())
        .withColumn("weight_micro", weight.cast("bigint"))
        .drop("_weight")
    )


def pack_index(
    by_checksum: DataFrame, by_path: DataFrame, save: Callable[[DataFrame, str], DataFrame] = lambda df, name: df
) -> VersionSets:
    """The sets of versions of every content and path, interned once per index."""
    return intern(by_checksum, by_path, save)


def matchable_assets(assets: DataFrame, by_checksum: DataFrame) -> DataFrame:
    """Assets whose content at least one version uses."""
    known = by_checksum.select("checksum").distinct()
    return assets.filter("success").join(known, "checksum", "left_semi")


def base_path_votes(assets: DataFrame, files: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(site_id, base_path, votes)`` from assets that sit below another folder than expected.

    Where the observed and an indexed path of the same content differ and one ends with
    the other, the remainder is a candidate base path; a folder of the site itself starts
    with ``/``. The remainder depends on the asset kind only and is computed once per kind.
    """
    served = assets.filter("success").select("site_id", "webroot_path", "checksum")
    kinds = served.select("webroot_path", "checksum").distinct()
    known = files.select("checksum", F.col("webroot_path").alias("expected")).distinct()
    observed, expected = F.col("webroot_path"), F.col("expected")
    remainder = F.when(F.endswith(expected, observed), F.replace(expected, observed, F.lit(""))).when(
        F.endswith(observed, expected),
        F.concat(F.lit("/"), F.replace(observed, expected, F.lit(""))),
    )
    bases = (
        kinds.filter(observed != "")
        .join(known.filter(expected != ""), "checksum")
        .filter(expected != observed)
        .select("webroot_path", "checksum", remainder.alias("base_path"))
        .filter(F.col("base_path").isNotNull())
        .distinct()
    )
    return (
        salted_join(served, bases, ["webroot_path", "checksum"], hot_rows=hot_rows)
        .groupBy("site_id", "base_path")
        .agg(F.count(F.lit(1)).alias("votes"))
    )


def updated_base_path(votes: DataFrame) -> DataFrame:
    """``(site_id, base_path)``: most votes, then the smallest path."""
    return votes.groupBy("site_id").agg(
        F.min_by("base_path", F.struct(-F.col("votes"), F.col("base_path"))).alias("base_path")
    )


def new_assets(found: DataFrame, known: DataFrame) -> DataFrame:
    """Assets of ``found`` whose URL the site has not requested yet."""
    return found.join(known.select("site_id", "url").distinct(), ["site_id", "url"], "left_anti")
