"""Lines that several documents share: explode normalised lines, hash, count documents per hash, drop, reassemble.

Only hashes and positions are shuffled to find the lines; texts meet their own dropped positions once, by document. A
line that a large part of all documents holds is summed up before the shuffle, and its rows are split by the adaptive
join when the verdict goes back to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filespoor.llm.common import LAST_ID, SPACE, join_same, lower_ascii, table, text_of
from filespoor.llm.registry import query
from filespoor.session import Workspace

MIN_CHARS, MIN_DOCS = 10, 2


def line_dedup(docs: DataFrame, space: Workspace, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_lines, n_dropped, kept_text.

    Keys are lines without white space at both ends, A-Z in lower case. Keys of at least ``min_chars`` code points in at
    least ``min_docs`` documents lose all their lines except in the smallest doc_id that holds them; repeats within that
    document stay. A null or empty text is one empty line. A null doc_id counts as one document behind all others. Rows
    that repeat a doc_id are one document; each keeps its own text. A document without lines left has an empty text.
    """
    rows = docs.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), text_of().alias("text")
    ).withColumn("row", F.xxhash64("text"))
    lines = rows.select("id", "row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("id", "row", "pos", lower_ascii(F.btrim("line", F.lit(SPACE))).alias("key"))
    # two hashes with different seeds: 128 bits
    hashed = space.save(
        keyed.filter(F.length("key") >= min_chars)
        .select("id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")), "lines"
    )
    # written, so that the join below deals out both of its sides and can split a common line
    shared = space.save(
        hashed.select("h1", "h2", "id").distinct().groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.min("id").alias("first")).filter(F.col("n") >= min_docs).drop("n"), "shared"
    )
    dropped = (
        hashed.join(shared, ["h1", "h2"]).filter("id <> first")
        .groupBy("id", "row").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    )
    whole = join_same(rows, dropped, ("id", "row"), "left").select(
        "doc_id", F.split("text", "\n", -1).alias("lines"), F.coalesce("gone", F.expr("array()")).alias("gone")
    )
    # what lies between two dropped positions stays
    kept = whole.withColumn("ends", F.expr("concat(array(-1), gone, array(size(lines)))")).withColumn("kept", F.expr(
        "flatten(transform(sequence(0, size(gone)), i -> slice(lines, ends[i] + 2, ends[i + 1] - ends[i] - 1)))"
    ))
    return kept.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("kept_text"),
    )


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT doc_id, pos, line, first IS NOT NULL AND first <> doc_id AS gone FROM keyed LEFT JOIN shared USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query("op8_line_dedup", SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    rows = line_dedup(table(spark, folder, "documents"), Workspace(spark, "lines"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
