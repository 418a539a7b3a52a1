"""The corpus pipeline: language, quality rules, exact and near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's
docs. All but the last return the columns of ``documents``. Texts meet a stage's decisions in one join by keys of whole rows,
so an id that stands on several texts is decided on for each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filespoor.llm import exact_dedup, language, packing, quality, simhash
from filespoor.llm.common import row_keys, table
from filespoor.session import Workspace


KEYS = ("_k1", "_k2")


def _only(docs: DataFrame, decided: DataFrame, once: bool = False) -> DataFrame:
    """The rows of ``docs`` (with KEYS) whose keys are in ``decided``; ``once``: one row of each key."""
    kept = docs.join(decided.select(*KEYS).distinct(), list(KEYS), "left_semi")
    return (kept.dropDuplicates(list(KEYS)) if once else kept).drop(*KEYS)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; others go."""
    docs = row_keys(docs, KEYS)
    found = language.identify(docs, table(spark, sf_dir, "pages"), Workspace(spark, "pipeline-language"), row_key=KEYS)
    return _only(docs, found.filter("kept"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without lines that their host repeats, on a large host too; n_chars follows the text."""
    kept = quality.clean(docs, quality.judge(docs, Workspace(spark, "pipeline-quality"), line_most=quality.LINE_MOST))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    docs = row_keys(docs, KEYS)
    found = exact_dedup.exact_dedup(docs, Workspace(spark, "pipeline-exact"), row_key=KEYS)
    return _only(docs, found.filter("kept"), once=True)


def near_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the document that gives it its name."""
    docs = row_keys(docs, KEYS)
    found = simhash.near_duplicates(docs, Workspace(spark, "pipeline-simhash"), row_key=KEYS)
    return _only(docs, found.filter("kept"), once=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in training sequences."""
    return packing.pack(docs, Workspace(spark, "pipeline-packing"), with_ids=False)


STAGES = [
    ("language", identify), ("quality_rules", rules), ("exact_dedup", unique), ("simhash", near_unique), ("packing", packed),
]

# models, hashes and tokenizers are beyond SQL; tests hold the stages against brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, space = table(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = space.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
