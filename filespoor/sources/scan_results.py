"""Stored scan results: one JSON document per scanned URL."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from filespoor import schema


def check_identifier(identifier: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_]*", identifier):
        raise ValueError(f"invalid scan identifier {identifier!r}")
    return identifier


def version_json(package: Column, vendor: Column, alternatives: Column, name: Column,
                 identifier: Column, release_date: Column) -> Column:
    """A version as it appears in result documents."""
    return F.struct(
        F.struct(
            package.alias("name"), vendor.alias("vendor"), alternatives.alias("alternative_names")
        ).alias("software_package"),
        name.alias("name"),
        identifier.alias("internal_identifier"),
        F.date_format(release_date, "yyyy-MM-dd'T'HH:mm:ss").alias("release_date"),
    )


def asset_json(*extra: str) -> Column:
    """An asset as it appears in result documents; failed ones have no status or checksum."""
    known = F.col("success")
    return F.struct(
        "url",
        "webroot_path",
        F.when(known, F.lit(200)).alias("status_code"),
        "success",
        F.when(known, F.lower(F.hex("checksum"))).alias("checksum"),
        *extra,
    )


# key of the empty list of versions
NO_VERSIONS = hashlib.md5(b"[]").hexdigest()
_SET_KEY = r'"(?:expected|using)_versions":"([0-9a-f]{32})"'
SETS = "set_key string, versions string"


def set_text(versions: Column) -> Column:
    """A list of versions as it stands in whole documents; its MD5 is the key of the set."""
    return F.to_json(versions, {"ignoreNullFields": "false"})


def expand_documents(documents: DataFrame, key: list[str], sets: DataFrame) -> DataFrame:
    """``documents`` (``key``, result) in which the lists of ``sets`` (set_key, versions) stand in place of their keys."""
    named = documents.select(*key, F.explode(F.array_distinct(F.expr(f"regexp_extract_all(result, r'{_SET_KEY}', 1)"))).alias("set_key"))
    # a document names few sets, each once
    lists = named.join(sets, "set_key").groupBy(*key).agg(F.collect_list(F.struct("set_key", "versions")).alias("_lists"))
    put_in = F.aggregate(
        "_lists", F.col("result"), lambda text, s: F.replace(text, F.concat(F.lit('"'), s["set_key"], F.lit('"')), s["versions"])
    )
    joined = documents.join(lists, key, "left")
    return joined.withColumn("result", F.when(F.col("_lists").isNull(), F.col("result")).otherwise(put_in)).drop("_lists")


def expanded_chars(documents: DataFrame, key: list[str], sets: DataFrame) -> DataFrame:
    """``(key, result_chars)``: the lengths that whole documents would have, without making them."""
    named = documents.select(*key, F.explode(F.expr(f"regexp_extract_all(result, r'{_SET_KEY}', 1)")).alias("set_key"))
    counted = named.groupBy(*key, "set_key").agg(F.count(F.lit(1)).alias("times"))
    sizes = sets.select("set_key", (F.length("versions") - 34).alias("more"))
    more = counted.join(sizes, "set_key").groupBy(*key).agg(F.sum(F.col("times") * F.col("more")).alias("more"))
    return documents.join(more, key, "left").select(*key, (F.length("result") + F.coalesce("more", F.lit(0))).alias("result_chars"))


def append_sets(sets: DataFrame, path: str) -> None:
    """Add the sets that the table lacks."""
    sets.sparkSession.createDataFrame([], SETS).write.mode("append").parquet(path)
    sets.join(read_sets(sets.sparkSession, path), "set_key", "left_anti").write.mode("append").parquet(path)


def read_sets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SETS).parquet(path)


def result_documents(sites: DataFrame, guesses: DataFrame, more_recent: DataFrame) -> DataFrame:
    """``(site_id, result)`` for every site.

    ``guesses(site_id, rank, guess)`` and ``more_recent(site_id, more_recent)`` hold
    structs. A site without guesses gets the outcome ``false``. Guesses per site are few
    by the guess limit, so the lists stay short.
    """
    lists = guesses.groupBy("site_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "guess"))), lambda g: g["guess"]).alias("_list")
    )
    joined = sites.select("site_id").join(lists, "site_id", "left").join(more_recent, "site_id", "left")
    keep_nulls = {"ignoreNullFields": "false"}
    found = F.to_json(F.struct(F.col("_list").alias("result"), "more_recent"), keep_nulls)
    none = F.lit('{"result":false,"more_recent":null}')
    return joined.select("site_id", F.when(F.col("_list").isNull(), none).otherwise(found).alias("result"))


def unscanned(sites: DataFrame, results: DataFrame, identifier: str) -> DataFrame:
    """Sites whose URL has no result in this scan yet."""
    done = results.filter(F.col("scan_identifier") == check_identifier(identifier)).select("url")
    return sites.join(done, "url", "left_anti")


def new_results(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming results without URLs that the scan already has; one per URL."""
    fresh = incoming.join(stored.select("scan_identifier", "url"), ["scan_identifier", "url"], "left_anti")
    return fresh.dropDuplicates(["scan_identifier", "url"])


def append_results(incoming: DataFrame, path: str) -> None:
    """Store results; of a scan each URL has one, the first stored. A new store starts empty."""
    spark = incoming.sparkSession
    spark.createDataFrame([], schema.SCAN_RESULT).write.mode("append").partitionBy("scan_identifier").parquet(path)
    fresh = new_results(incoming, read_results(spark, path))
    fresh.write.mode("append").partitionBy("scan_identifier").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.SCAN_RESULT).parquet(path)


def lookup_results(results: DataFrame, identifier: str, wanted: DataFrame) -> DataFrame:
    """Results of the given URLs."""
    scan = results.filter(F.col("scan_identifier") == check_identifier(identifier))
    return scan.join(wanted.select("url").distinct(), "url", "left_semi")


def scanned_sites(results: DataFrame, identifier: str) -> DataFrame:
    return results.filter(F.col("scan_identifier") == check_identifier(identifier)).select("url")
