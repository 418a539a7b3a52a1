"""All reports of one scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from filespoor.operators import reports
from filespoor.session import Workspace
from filespoor.sources.index_store import Index


def evaluate_scan(results: DataFrame, index: Index, vulnerable: DataFrame, workspace: Workspace) -> DataFrame:
    """``(report, key, results)`` of every report over the results of a scan.

    The guesses, which are parsed, and the flags per result, which need the index, are
    worked out once and written.
    """
    rows = workspace.save(reports.guesses(results), "guesses")
    by_url = workspace.save(
        reports.vulnerability_by_url(rows, index.packages, index.versions, vulnerable), "by-url"
    )
    totals = reports.vulnerable_totals(results, by_url)
    names = totals.columns
    pairs = ", ".join(f"'{name}', `{name}`" for name in names)
    parts = [
        _keyed("available", F.lit(""), reports.available_count(results)),
        _keyed("with guesses", F.lit(""), reports.result_count(results)),
        _keyed("guesses", F.col("guesses"), reports.guess_counts(results)),
        _keyed("package", F.col("package_name"), reports.package_counts(rows)),
        _keyed("packages", F.col("packages"), reports.distinct_package_counts(results, rows)),
        _keyed("vulnerable", F.col("key"), totals.selectExpr(f"stack({len(names)}, {pairs}) AS (key, results)")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _keyed(report: str, key, rows: DataFrame) -> DataFrame:
    return rows.select(F.lit(report).alias("report"), key.cast("string").alias("key"), "results")
