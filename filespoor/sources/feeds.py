"""Vulnerability feeds and technology rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from filespoor import schema


def cve_feed(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``(cve)``, one record per row, of (compressed) JSON feeds.

    Yearly feeds are one document each; ``multi_line=False`` reads one document per line.
    """
    feeds = spark.read.schema(schema.CVE_ITEM).option("multiLine", multi_line).json(path)
    return feeds.select(F.explode("CVE_Items").alias("item")).select("item.cve")


def tech_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``(app, kind, field, pattern)`` of a rule catalogue in JSON."""
    return parse_tech_rules(spark.read.option("wholetext", True).text(path))


def parse_tech_rules(documents: DataFrame) -> DataFrame:
    """The same for documents in a ``value`` column. Single patterns count as lists."""
    apps = documents.select(
        F.explode(F.variant_get(F.parse_json("value"), "$.apps", "map<string,variant>")).alias("app", "rule")
    )
    rule = F.col("rule")

    def pairs(kind: str) -> DataFrame:
        mapped = F.try_variant_get(rule, f"$.{kind}", "map<string,string>")
        return apps.select("app", F.lit(kind).alias("kind"), F.explode(mapped).alias("field", "pattern"))

    def patterns(kind: str) -> DataFrame:
        listed = F.coalesce(
            F.try_variant_get(rule, f"$.{kind}", "array<string>"),
            F.array_compact(F.array(F.try_variant_get(rule, f"$.{kind}", "string"))),
        )
        return apps.select(
            "app",
            F.lit(kind).alias("kind"),
            F.lit(None).cast("string").alias("field"),
            F.explode(listed).alias("pattern"),
        )

    return (
        pairs("headers").unionByName(pairs("meta"))
        .unionByName(patterns("html")).unionByName(patterns("script"))
    )
