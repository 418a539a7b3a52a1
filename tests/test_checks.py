"""Every registered query with a check gives the rows of its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import compare

FOLDER = "/root/testdata/sf0.001"
# nothing to find in the smallest tables
MAY_BE_EMPTY = {
    "files_of_version", "cve_versions", "cve_stats", "update_cve", "compare_versions", "previous_version",
    "version_delta", "delta_listing", "delta_count", "pairwise_delta_counts", "cve_stats_table",
}


@pytest.fixture(scope="module")
def duck():
    return compare.duck(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_check(spark, duck, name):
    problem = compare.compare(spark, duck, name, FOLDER)
    assert problem is None or (problem == "both empty" and name in MAY_BE_EMPTY)


def test_entry_has_rows(spark):
    """The flagship with generated code, as in production; the other tests switch it off."""
    names = ("spark.sql.codegen.wholeStage", "spark.sql.codegen.factoryMode")
    before = [spark.conf.get(name) for name in names]
    try:
        spark.conf.set(names[0], "true")
        spark.conf.set(names[1], "FALLBACK")
        assert entry.entry(spark).count() > 1000
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)
