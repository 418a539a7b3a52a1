"""Language identification by Bayesian fusion of what the text, the page's markup, its address and its host say.

The text gives a likelihood per language from hashed letter triples. Declared markup languages and address suffixes give
likelihoods counted over all rows against the languages that the texts alone suggest. Hosts give priors: counts of those
languages per host, smoothed towards the domain, the domain towards the top-level suffix, that towards all rows; a row's
own vote is taken out of its host's counts. All counts are grouped aggregations that are summed up before the shuffle, and
each language counts, however rare: rows are kept per value and language, arrays are as long as there are languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filespoor.llm import chunks
from filespoor.llm.common import join_same, table
from filespoor.llm.registry import query
from filespoor.llm.url_filter import with_parts
from filespoor.session import Workspace

SAMPLE_ROWS = 4000  # labelled ids that the letter model is fitted on, in equal parts from all languages
LEAST_ROWS = 20  # ids of a language, even if that makes more than SAMPLE_ROWS
BUCKETS = 1 << 15
EVIDENCE = 60  # letter triples that a text counts for at most: they depend on each other
STRENGTH = 5.0  # of a parent in the smoothing, in rows
MIN_PROB = 0.5


def triples(text: str) -> np.ndarray:
    """Buckets of the letter triples of a text; what is no letter is a space."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
    letter = ((codes >= 97) & (codes <= 122)) | (codes >= 0xC0)
    codes = np.where(letter, codes, 32).astype(np.uint64)
    mixed = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1]) * np.uint64(0x85EBCA6B) + codes[2:]
    mixed = (mixed * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    return mixed[letter[1:-1]].astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for start, texts in chunks.parts(batch):
            for lang, text in zip(langs[start:], texts):
                counts = np.bincount(triples(text), minlength=BUCKETS)
                totals[lang] = totals[lang] + counts if lang in totals else counts
    for lang, counts in totals.items():
        bucket = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([lang] * len(bucket), pa.string()), "bucket": pa.array(bucket), "n": pa.array(counts[bucket])
        })


def choose(known: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """lang, doc_id: the ids of ``known`` (doc_id, lang) to fit on, chosen by a hash within each language.

    Each language gives the same number of ids, or all that it has: ``rows`` in all, but LEAST_ROWS at least. Only ids
    below a bound of the hash are sent on, a few more than are needed, so no task sorts those of a common language.
    """
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("ids")).collect()  # one row a language
    part = max(LEAST_ROWS, -(-rows // max(1, len(sizes))))
    bounds = known.sparkSession.createDataFrame([(r.lang, (2 * part + 100) / max(1, r.ids) - 0.5) for r in sizes], "lang string, bound double")
    hashed = known.withColumn("order", F.xxhash64("doc_id"))
    few = hashed.join(F.broadcast(bounds), "lang").filter(F.col("order") / F.lit(2.0**64) <= F.col("bound"))
    ids: dict[str, list[tuple[int, int]]] = {}
    for lang, order, doc_id in few.select("lang", "order", "doc_id").distinct().collect():
        ids.setdefault(lang, []).append((order, doc_id))
    chosen = [(lang, doc_id) for lang, found in ids.items() for _, doc_id in sorted(found)[:part]]
    return known.sparkSession.createDataFrame(chosen, "lang string, doc_id long")


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (language, bucket) from ``labelled`` (doc_id, lang, text).

    The rows of the ids that ``choose`` takes are read for it. All languages with a labelled row stay.
    """
    known = labelled.filter("doc_id is not null and lang is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    )
    # ids first, so that no task gets the texts of all tasks' candidates
    sample = known.join(F.broadcast(choose(known.select("doc_id", "lang"), rows)), ["lang", "doc_id"], "left_semi")
    counted = sample.select("lang", "text").mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # BUCKETS rows a language at most
    found = counted.toArrow()
    names = found.column("lang").to_pylist()
    langs = sorted(set(names))
    if not langs:
        return [], np.zeros((0, BUCKETS), np.float32)
    place = {x: i for i, x in enumerate(langs)}
    table_ = np.full((len(langs), BUCKETS), 0.05)
    table_[[place[x] for x in names], found.column("bucket").to_numpy()] += found.column("n").to_numpy()
    return langs, np.log(table_ / table_.sum(axis=1, keepdims=True)).astype(np.float32)


def score(docs: DataFrame, logs: np.ndarray, row_key: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``row_key`` (long), source, n (letter triples) and the mean log likelihoods of each row of ``docs``; 0 without letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in chunks.parts(batch):
                found = [triples(x) for x in texts]
                means = [[float(row[x].mean()) if len(x) else 0.0 for row in logs] for x in found]
                yield pa.RecordBatch.from_pydict({c: batch.column(c).slice(start, len(texts)) for c in ("doc_id", *row_key, "source")} | {
                    "n": pa.array(list(map(len, found)), pa.int64()), "means": pa.array(means, pa.list_(pa.float64())),
                })

    rows = docs.select(F.col("doc_id").cast("long"), *row_key, F.col("source").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, " + "".join(f"{c} long, " for c in row_key) + "source string, n long, means array<double>")


def page_evidence(pages: DataFrame) -> DataFrame:
    """doc_id, page_host, declared, address of the documents that ``pages`` (url, html) show.

    A page's address ends in its document's number. ``declared`` is the lang of its html tag, ``address`` its top-level
    suffix with the language part of its path. Of several pages of a document the commonest values count.
    """
    parts = with_parts(pages.select("url", F.col("html").cast("string").alias("html")))
    declared = F.lower(F.regexp_extract("html", r"""(?i)<html[^>]*?\slang\s*=\s*["']?([a-z]{2})""", 1))
    part = F.lower(F.regexp_extract("path", r"^/([A-Za-z]{2})/", 1))
    rows = parts.select(
        F.expr(r"try_cast(regexp_extract(path, '/([0-9]{1,18})(?:[./]|$)', 1) as long)").alias("doc_id"), F.col("host").alias("page_host"),
        F.nullif(declared, F.lit("")).alias("declared"), F.concat_ws("/", F.substring_index("host", ".", -1), F.nullif(part, F.lit(""))).alias("address"),
    ).filter("doc_id is not null")
    return rows.groupBy("doc_id").agg(*(F.mode(c, True).alias(c) for c in ("page_host", "declared", "address")))


def _votes(rows: DataFrame, by: tuple[str, ...], size: int) -> DataFrame:
    """``by`` and v, the number of votes for each language, from ``rows`` (by, vote, n). Null votes count for none."""
    sums = rows.groupBy(*by, "vote").agg(F.sum("n").alias("n")).groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.expr("if(vote is null, null, struct(vote, n))"))).alias("m")
    )
    return sums.select(*by, F.expr(f"transform(sequence(0, {size - 1}), i -> coalesce(try_element_at(m, i), 0L))").alias("v"))


def _numbers(values: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


_WHOLE = "aggregate(v, 0L, (s, x) -> s + x)"


def _smoothed(parent: str) -> Column:
    return F.expr(f"zip_with(v, {parent}, (x, p) -> (x + {STRENGTH}D * p) / (whole + {STRENGTH}D))")


def _likelihood(rows: DataFrame, column: str, base: list[float]) -> DataFrame:
    """log P(value | language) of each value of ``column``, up to a part that is the same for all languages."""
    known = rows.filter(F.col(column).isNotNull() & F.col("vote").isNotNull())
    counts = _votes(known.groupBy(column, "vote").agg(F.count("*").alias("n")), (column,), len(base))
    counts = counts.withColumns({"whole": F.expr(_WHOLE), "base": _numbers(base)})
    # P(value | l) / P(value) = P(l | value) / P(l), with P(l | value) smoothed towards P(l)
    return counts.select(column, F.expr("zip_with(v, base, (x, b) -> ln((x + b) / (whole + 1D) / b))").alias(f"{column}_log"))


def identify(
    docs: DataFrame, pages: DataFrame, space: Workspace, min_prob: float = MIN_PROB, rows: int = SAMPLE_ROWS,
    row_key: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source, lang): doc_id, language, prob, text_language, n_letters, kept.

    ``lang`` is the label that the letter model is fitted on and is used for nothing else. ``pages`` (url, html) show
    some of the documents. Rejected are texts without letters, null and empty ones too (language null), and rows whose
    best language has less than ``min_prob``. Ties go to the first language by name. The host of a document is its
    page's, else its ``source``; null is a host of its own. Rows may repeat; an empty table gives no rows; without a
    labelled row nothing is known and all is rejected. Other columns are ignored. ``row_key`` names long columns that are
    returned too.
    """
    langs, logs = fit(docs, rows)
    size = len(langs)
    if not size:
        return docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), *row_key, F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("prob"),
            F.lit(None).cast("string").alias("text_language"), F.lit(0).cast("long").alias("n_letters"), F.lit(False).alias("kept"),
        )
    scored = score(docs, logs, row_key).withColumn("vote", F.expr("if(n > 0, cast(array_position(means, array_max(means)) as int) - 1, null)"))
    scored = space.save(scored, "scored")
    shown = space.save(page_evidence(pages), "pages")
    named = scored.join(shown, "doc_id", "left").withColumn("host", F.coalesce("page_host", "source")).drop("page_host", "source")
    named = named.withColumns({"domain": F.substring_index("host", ".", -2), "top": F.substring_index("host", ".", -1)})
    named = space.save(named, "evidence")

    hosts = space.save(named.groupBy("host", "domain", "top", "vote").agg(F.count("*").alias("n")), "hosts")
    votes = dict(hosts.groupBy("vote").agg(F.sum("n")).collect())  # one row a language
    votes = [votes.get(i, 0) for i in range(size)]
    total = sum(votes)
    base = [(v + 1) / (total + size) for v in votes]
    tops = _votes(hosts, ("top",), size).withColumns({"whole": F.expr(_WHOLE), "base": _numbers(base)})
    tops = tops.select("top", _smoothed("base").alias("top_prior"))
    domains = join_same(_votes(hosts, ("domain", "top"), size), tops, ("top",)).withColumn("whole", F.expr(_WHOLE))
    domains = domains.select("domain", _smoothed("top_prior").alias("domain_prior"))
    priors = join_same(_votes(hosts, ("host", "domain"), size), domains, ("domain",)).drop("domain")
    priors = space.save(priors.withColumn("whole", F.expr(_WHOLE)), "priors")
    declared = space.save(_likelihood(named, "declared", base), "declared")
    address = space.save(_likelihood(named, "address", base), "address")

    joined = join_same(named.drop("domain", "top"), priors, ("host",))
    joined = joined.join(declared, "declared", "left").join(address, "address", "left")
    # the row's own vote is taken out
    own = f"(v[i] - if(vote <=> i, 1, 0) + {STRENGTH}D * domain_prior[i]) / (whole - if(vote is null, 0, 1) + {STRENGTH}D)"
    terms = (
        f"transform(sequence(0, {size - 1}), i -> ln({own}) + least(n, {EVIDENCE}) * means[i]"
        " + coalesce(declared_log[i], 0D) + coalesce(address_log[i], 0D))"
    )
    names = F.array(*map(F.lit, langs))
    fused = joined.withColumn("logs", F.expr(terms)).withColumn("top", F.array_max("logs"))
    fused = fused.withColumn("prob", F.expr("1 / aggregate(logs, 0D, (s, x) -> s + exp(x - top))"))
    best = F.when(F.col("n") > 0, F.element_at(names, F.array_position("logs", F.col("top")).cast("int")))
    return fused.select(
        "doc_id", *row_key, best.alias("language"), F.when(F.col("n") > 0, F.col("prob")).otherwise(0.0).alias("prob"),
        F.get(names, F.col("vote")).alias("text_language"), F.col("n").alias("n_letters"),
        F.expr(f"n > 0 and prob >= {min_prob}").alias("kept"),
    )


@query("op6_language_id")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return identify(table(spark, folder, "documents"), table(spark, folder, "pages"), Workspace(spark, "language"))
