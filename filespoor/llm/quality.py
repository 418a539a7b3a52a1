"""Quality rules: measures of each text and lines that many documents of a host share.

Lines are normalised and hashed; distinct documents are counted per host and line, copies of a text once. Lines above the
limits are boilerplate of the host and go, except in the first document that has them; documents that keep too few of
their words are rejected. Only hashes are shuffled; a common line is summed up before the shuffle, and its rows are split
by the adaptive join when they meet the verdict.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filespoor.llm import chunks
from filespoor.llm.common import SPACE, join_same, table, text_of
from filespoor.llm.registry import query
from filespoor.session import Workspace

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT = 50, 50  # words; percent of words in repeated windows
WINDOW = 3
# a line is boilerplate in more than so many documents of a host and more than this percentage of them
LINE_DOCS, LINE_PERCENT = 20, 2
# and, where asked for, in more than so many documents of a host of any size
LINE_MOST = 1000
# a document that keeps less than this percentage of its words is rejected
LEFT_PERCENT = 25
KEY = ("doc_id", "host", "content")


def repeated(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, each word once."""
    windows = list(zip(*(words[i:] for i in range(window))))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    end = total = 0
    for i, w in enumerate(windows):
        if w in often:
            total += i + window - max(i, end)
            end = i + window
    return total


def normal(line: bytes) -> bytes:
    """A line's key: words in lower case (A-Z) with single spaces."""
    return b" ".join(line.lower().split())


def line_hash(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key, 0) - 2**63


def _measure(text: str) -> tuple:
    raw = text.encode()
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    keys: dict[int, int] = {}
    for line in lines:
        h = line_hash(normal(line))
        keys[h] = keys.get(h, 0) + len(line.split())
    return (
        len(words), len(text) - sum(map(text.count, SPACE)), len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)), repeated(words), [{"h": h, "words": n} for h, n in keys.items()],
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LINES = pa.list_(pa.struct([("h", pa.int64()), ("words", pa.int64())]))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in chunks.parts(batch):
            *numbers, lines = zip(*map(_measure, texts))
            yield pa.RecordBatch.from_pydict(
                {name: batch.column(name).slice(start, len(texts)) for name in KEY}
                | {name: pa.array(x, pa.int64()) for name, x in zip(MEASURES, numbers)}
                | {"lines": pa.array(lines, LINES)}
            )


def measure(docs: DataFrame) -> DataFrame:
    """Measures and distinct line hashes of each row of ``docs`` (doc_id, source, text)."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"),
        F.xxhash64(text_of()).alias("content"), F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(
        _run, "doc_id long, host string, content long, " + "".join(f"{n} long, " for n in MEASURES)
        + "lines array<struct<h:long, words:long>>"
    )


def judge(
    docs: DataFrame, space: Workspace, line_docs: int = LINE_DOCS, line_percent: int = LINE_PERCENT,
    left_percent: int = LEFT_PERCENT, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT, line_most: int | None = None,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, text) with its measures and the verdict.

    Columns: doc_id, host, content (hash of the text), the measures, base_failed, cut_words (words in lines that go),
    cut_lines (hashes of those lines), kept. The host is ``source``; a null host is one host of its own. A null text has
    no words and fails. Copies of a text on a host count as one document and share their fate; the first of a host's
    documents with a line (smallest doc_id, null last) and its copies keep it. Rows that repeat are judged alike.
    With ``line_most``, a line in more than so many documents of a host goes whatever share of them that is. Other columns
    are ignored.
    """
    rows = space.save(measure(docs), "measured")
    lines = rows.select(*KEY, F.inline("lines"))
    each = lines.groupBy("host", "h", "content").agg(F.min("doc_id").alias("doc_id"))
    counted = space.save(
        each.groupBy("host", "h").agg(F.count("*").alias("n"), F.min_by("content", F.struct(F.expr("doc_id is null"), "doc_id", "content")).alias("first"))
        .filter(F.col("n") > line_docs), "counted"
    )
    hosts = rows.groupBy("host", "content").agg(F.count("*").alias("copies")).groupBy("host").agg(F.count("*").alias("docs"))
    shared = 100 * F.col("n") > line_percent * F.col("docs")
    if line_most is not None:
        shared = shared | (F.col("n") > line_most)
    often = join_same(counted, hosts, ("host",)).filter(shared)
    common = space.save(often.select("host", "h", "first"), "common")
    cut = join_same(lines, common, ("host", "h")).filter("content <> first")
    # repeated rows give a line's words once
    cut = cut.groupBy(*KEY, "h").agg(F.max("words").alias("words")).groupBy(*KEY).agg(
        F.sum("words").alias("cut_words"), F.collect_list("h").alias("cut_lines")
    )
    joined = join_same(rows.drop("lines"), cut, KEY, "left").withColumn("cut_words", F.coalesce("cut_words", F.lit(0)))
    failed = f"n_words < {min_words} or 100 * n_repeat_words > {max_repeat} * n_words"
    return joined.withColumn("base_failed", F.expr(failed)).withColumn(
        "kept", F.expr(f"not base_failed and 100 * (n_words - cut_words) >= {left_percent} * n_words")
    )


def _drop_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns, texts = {n: batch.column(n) for n in batch.schema.names if n != "cut_lines"}, []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("cut_lines").to_pylist()):
            if gone:
                drop = set(gone)
                raw = text.encode().split(b"\n")
                text = b"\n".join(x for x in raw if not x.strip() or line_hash(normal(x)) not in drop).decode()
            texts.append(text)
        columns["text"] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_pydict(columns, schema=pa.schema([batch.schema.field(n) for n in columns]))


def clean(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, without the lines that go. Columns are those of ``docs``."""
    keep = judged.filter("kept").select(*KEY, "cut_lines").dropDuplicates(list(KEY))
    own = docs.withColumns({"_doc": F.col("doc_id").cast("long"), "_host": F.col("source").cast("string"), "_text": F.xxhash64(text_of())})
    keep = keep.select(F.col("doc_id").alias("_doc"), F.col("host").alias("_host"), F.col("content").alias("_text"), F.col("cut_lines").alias("_cut"))
    joined = join_same(own, keep, ("_doc", "_host", "_text"))
    rows = joined.select(*docs.columns, F.col("_cut").alias("cut_lines"))
    return rows.mapInArrow(_drop_lines, docs.schema)


SQL = r"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs),
windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM worded)
), twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY doc_id),
lines AS (
  SELECT doc_id, source, text, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM docs)
), full_lines AS (
  SELECT doc_id, source, text, line, len(words) AS n,
    translate(array_to_string(words, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines WHERE len(words) > 0
), dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM full_lines GROUP BY doc_id),
firsts AS (SELECT source, key, text, min(doc_id) AS doc_id FROM full_lines GROUP BY ALL),
hosts AS (SELECT source, count(DISTINCT text) AS docs FROM docs GROUP BY source),
common AS (
  SELECT source, key, count(*) AS n, arg_min(text, doc_id) AS first FROM firsts GROUP BY source, key HAVING count(*) > 20
), cut AS (
  SELECT doc_id, sum(f.n) AS n FROM full_lines f JOIN common c USING (source, key) JOIN hosts h USING (source)
  WHERE (100 * c.n > 2 * h.docs OR c.n > 1000) AND f.text <> c.first GROUP BY doc_id
), measured AS (
  SELECT w.doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(d.n, 0) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, coalesce(c.n, 0)::BIGINT AS cut_words
  FROM worded w LEFT JOIN dups d USING (doc_id) LEFT JOIN repeats r USING (doc_id) LEFT JOIN cut c USING (doc_id)
), failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, cut_words, base_failed,
  NOT base_failed AND 100 * (n_words - cut_words) >= 25 * n_words AS kept
FROM failed
"""


@query("op1_quality_rules", SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    judged = judge(table(spark, folder, "documents"), Workspace(spark, "quality"), line_most=LINE_MOST)
    return judged.select("doc_id", *MEASURES, "cut_words", "base_failed", "kept")
