"""Exact duplicates by progressive refinement: length, then hash of a prefix, then hash of the whole text.

A row goes on to the next, dearer key only while another row shares all its keys so far. The first two keys are read
into a narrow table; whole texts are hashed only in groups that length and prefix leave together. All of it is
aggregation and joins of narrow rows with small tables of group keys, so a group of copies of any size is summed up
before it is shuffled, and the adaptive join splits what is left of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filespoor.llm.common import table, text_of, without_space
from filespoor.llm.registry import query
from filespoor.session import Workspace

PREFIX_CHARS = 256


def _rows(docs: DataFrame, prefix_chars: int, row_key: tuple[str, ...]) -> DataFrame:
    bare = docs.select("doc_id", *row_key, text_of().alias("raw")).select(
        "doc_id", *row_key, F.length("raw").cast("long").alias("n_chars"), without_space(F.col("raw")).alias("bare")
    )
    return bare.select(
        "doc_id", *row_key, "n_chars", "bare", F.length("bare").cast("long").alias("length"),
        F.xxhash64(F.substring("bare", 1, prefix_chars)).alias("head"),
    )


def exact_dedup(
    docs: DataFrame, space: Workspace, prefix_chars: int = PREFIX_CHARS, digest_all: bool = False, row_key: tuple[str, ...] = ()
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are once white space is deleted. The row with the longest original text stays, of those the
    smallest doc_id. ``text_sha256`` is null for rows that length or prefix already set apart, unless ``digest_all``.
    A null text is an empty one and equal to other empty ones; a null doc_id sorts behind all others. Rows that repeat
    a doc_id with an equal text are all counted in group_size and are kept or not together. Other columns are ignored.
    ``row_key`` names columns that tell such rows apart: they are returned too, and only the row with the smallest key is kept.
    """
    rows = _rows(docs, prefix_chars, row_key)
    keys = space.save(rows.select("length", "head"), "keys")
    counted = keys.groupBy("length", "head").agg(F.count("*").alias("n"))
    lengths = keys.groupBy("length").agg(F.count("*").alias("n")).filter("n > 1").select("length")
    heads = counted.join(lengths, "length", "left_semi").filter("n > 1").select("length", "head", F.lit(True).alias("open"))
    if digest_all:
        rows = rows.select("doc_id", *row_key, "n_chars", "length", "head", F.sha2("bare", 256).alias("sha"))
        marked = rows.join(heads, ["length", "head"], "left")
    else:
        marked = rows.join(heads, ["length", "head"], "left").withColumn("sha", F.expr("if(open, sha2(bare, 256), null)"))
    hashed = space.save(marked.select("doc_id", *row_key, "n_chars", "open", "sha"), "hashed")
    left = hashed.filter("open")
    # the greatest (length, -id) is the longest text and the smallest id; null ids sort lowest
    # written, so that the join below deals out both of its sides and can split a large group
    groups = space.save(left.groupBy("sha").agg(
        F.count("*").alias("group_size"), F.max(F.struct("n_chars", (-F.col("doc_id")).alias("neg"), *[F.bitwise_not(c).alias(c) for c in row_key])).alias("best")
    ).select("sha", "group_size", (-F.col("best.neg")).alias("keep_id"), *[F.bitwise_not(f"best.{c}").alias(f"_best{c}") for c in row_key]), "groups")
    stays = F.expr("doc_id <=> keep_id")
    for c in row_key:
        stays = stays & (F.col(c) == F.col(f"_best{c}"))
    columns = ("doc_id", *row_key, "keep_id", "group_size", stays.alias("kept"), F.col("sha").alias("text_sha256"))
    alone = hashed.filter("open is null").withColumns(
        {"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")} | {f"_best{c}": F.col(c) for c in row_key}
    )
    return left.join(groups, "sha").select(*columns).unionByName(alone.select(*columns))


SQL = r"""
WITH bare AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS bare
  FROM documents
), keyed AS (SELECT doc_id, n, sha256(bare) AS text_sha256 FROM bare)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER best AS kept, text_sha256
FROM keyed WINDOW best AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""


@query("op2_exact_dedup", SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents"), Workspace(spark, "exact"), digest_all=True)
