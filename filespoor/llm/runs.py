"""Periodic runs of words, found online by catchers over dyadic blocks.

Whenever a block of 2^k words that begins at a multiple of 2^k is complete, it becomes a catcher for periods from
2^(k+1) - 1 to 2^(k+2) - 2: the first half of any square with such a period holds a whole block of that size. Each appended
word ends one new suffix of 2^k words for every k, and exactly two live catchers of the size have it in their reach, so a
word advances two comparisons a size. They are of hashes that double from size to size, and the words appended together
are one numpy vector. A hit says that a block comes again q words later. Hits of neighbouring blocks at one q are one
stretch; beyond its ends less than a block can agree, which halving steps over the smaller sizes measure. A stretch in
which q words agree with those q before them is a square, and it is given out merged with all squares of that stretch: as
the run. Multiples of a run's period give the same stretch of words; the least one stays. Equal words have equal hashes, so
no run is missed; each run is checked against the words, and another numbering is taken should hashes ever have met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filespoor.llm import chunks
from filespoor.llm.common import table
from filespoor.llm.registry import query

LEAST = 12  # words of a run
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_NONE = np.zeros(0, np.int64)


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of two halves each; not linear, so that no pattern of words makes sums meet."""
    x = (left ^ (left >> np.uint64(29))) * _A + right
    return (x ^ (x >> np.uint64(32))) * _B


class Catchers:
    """Finds the runs of a sequence of hashed words that grows at its end."""

    def __init__(self, longest: int):
        """``longest``: no run is longer than this; it bounds the block sizes."""
        self.sizes = max(1, (longest // 2 + 2).bit_length() - 1)  # 2 ** (k + 1) - 1 is at most half of the words
        self.n = 0
        self.hashes = [np.zeros(0, np.uint64) for _ in range(self.sizes)]  # [k][i]: of words i to i + 2 ** k
        self.hits: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(self.sizes)]  # (block, period)

    def append(self, words: np.ndarray) -> None:
        """Append hashed words; each advances the comparisons of the catchers within its reach."""
        if not len(words):
            return
        fresh = words.astype(np.uint64)
        for k in range(self.sizes):
            if k:
                half, below = 1 << k - 1, self.hashes[k - 1]
                start = len(self.hashes[k])
                fresh = _mixed(below[start:len(below) - half], below[start + half:]) if len(below) - half > start else fresh[:0]
            before = len(self.hashes[k])
            if len(fresh):
                self.hashes[k] = np.concatenate([self.hashes[k], fresh]) if before else fresh
            self._compare(k, before)
        self.n += len(words)

    def _compare(self, k: int, before: int) -> None:
        """The suffixes of size 2^k that begin at ``before`` or later, each with its two catchers."""
        size, all_hashes = 1 << k, self.hashes[k]
        begin, end = max(before, 2 * size - 1), len(all_hashes)
        if begin >= end:
            return
        first = (begin - 2 * size + 1) // size  # block of the nearer catcher of the first suffix
        last = (end - 1 - 2 * size + 1) // size
        heads = np.repeat(all_hashes[first * size:last * size + 1:size], size)
        skip = begin - 2 * size + 1 - first * size
        suffixes = all_hashes[begin:end]
        near = np.flatnonzero(suffixes == heads[skip:skip + len(suffixes)])
        far = _NONE
        low = max(first - 1, 0)
        heads = np.repeat(all_hashes[low * size:max(last, 0) * size:size], size)
        moved = (low - first + 1) * size  # the first suffixes of the text have no farther catcher
        at = max(0, moved - skip)
        rest = suffixes[at:]
        if len(rest) and len(heads):
            from_head = skip + at - moved
            far = np.flatnonzero(rest == heads[from_head:from_head + len(rest)]) + at
        for found, back in ((near, 0), (far, 1)):
            if len(found):
                x = found + begin
                block = ((x - 2 * size + 1) // size - back) * size
                self.hits[k].append((block, x - block))

    def _matched(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretches (begin, end, period) in which words agree with those a period later, from hits of size 2^k."""
        if not self.hits[k]:
            return _NONE, _NONE, _NONE
        size = 1 << k
        block, period = (np.concatenate(x) for x in zip(*self.hits[k]))
        order = np.lexsort((block, period))
        block, period = block[order], period[order]
        opens = np.flatnonzero(np.r_[True, (np.diff(block) != size) | (np.diff(period) != 0)])
        closes = np.r_[opens[1:], len(block)] - 1
        begin, end, period = block[opens], block[closes] + size, period[opens]
        # a stretch has to have a period's length; less than a block is left at each side
        able = (end - begin + 2 * size - 2 >= period) & (end - begin + 2 * size - 2 + period >= LEAST)
        begin, end, period = begin[able], end[able], period[able]
        for step in range(k - 1, -1, -1):
            width, hashes = 1 << step, self.hashes[step]
            at = np.flatnonzero(begin >= width)
            same = at[hashes[begin[at] - width] == hashes[begin[at] + period[at] - width]]
            begin[same] -= width
            at = np.flatnonzero(end + period + width <= self.n)
            same = at[hashes[end[at]] == hashes[end[at] + period[at]]]
            end[same] += width
        return begin, end, period

    def runs(self) -> np.ndarray:
        """Rows (start, length, period) of all runs of the words so far, by start and period."""
        found = [self._matched(k) for k in range(self.sizes)]
        begin, end, period = (np.concatenate(x) for x in zip(*found))
        length = end - begin + period
        run = (end - begin >= period) & (length >= LEAST)
        begin, length, period = begin[run], length[run], period[run]
        order = np.lexsort((period, length, begin))  # of equal stretches of words the least period
        begin, length, period = begin[order], length[order], period[order]
        new = np.r_[True, (np.diff(begin) != 0) | (np.diff(length) != 0)] if len(begin) else np.zeros(0, bool)
        rows = np.stack([begin[new], length[new], period[new]], axis=1)
        return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _holds(words: list[bytes], start: int, length: int, period: int) -> bool:
    end = start + length
    return (
        words[start:end - period] == words[start + period:end]
        and (start == 0 or words[start - 1] != words[start - 1 + period])
        and (end == len(words) or words[end] != words[end - period])
    )


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each list of words, by start and period."""
    number = hash
    for _ in range(2):
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        catchers = Catchers(max(map(len, texts), default=0))
        starts, at = [], 0
        parts = []
        for i, words in enumerate(texts):
            starts.append(at)
            parts.append(np.fromiter(map(number, words), np.int64, len(words)))
            parts.append(np.array([-1 - i], np.int64))  # a word of its own behind each text
            at += len(words) + 1
        if parts:
            catchers.append(np.concatenate(parts).view(np.uint64))
        rows = catchers.runs()
        texts_of = np.searchsorted(np.array(starts + [at]), rows[:, 0], "right") - 1
        good = True
        for i, (start, length, period) in zip(texts_of.tolist(), rows.tolist()):
            start -= starts[i]
            good = good and start + length <= len(texts[i]) and _holds(texts[i], start, length, period)
            out[i].append((start, length, period))
        if good:
            return out
        numbers: dict[bytes, int] = {}  # words met in a hash: number them instead
        number = lambda word: numbers.setdefault(word, len(numbers))
    raise ValueError("hashes of different stretches of words met twice")


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """True for words that no run holds beyond its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, runs (start, length, period) and the collapsed text.

    Words are stretches other than 0x20 and 0x09 to 0x0D. A run has a smallest period q, at least 12 words and 2q of them,
    and no word beside it goes on with q; runs come by start, then period. In the collapsed text each run has its first period only,
    and one space stands between words. Null is an empty text: no words, no runs, an empty text. Rows may repeat, doc_id
    may be null; other columns are ignored. A batch of texts is worked at once; a text longer than a batch by itself, in
    memory of some 200 bytes a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks.parts(batch):
                words = [x.encode().split() for x in texts]  # of bytes: at ASCII white space only
                found = runs_of(words)
                texts = [
                    b" ".join([w for w, stays in zip(ws, kept(len(ws), rs).tolist()) if stays] if rs else ws).decode()
                    for ws, rs in zip(words, found)
                ]
                flat = np.array([r for rs in found for r in rs], np.int64).reshape(-1, 3)
                rows = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(first, len(texts)),
                    "n_words": pa.array(list(map(len, words)), pa.int64()),
                    "runs": pa.ListArray.from_arrays(pa.array(ends), rows),
                    "collapsed": pa.array(texts, pa.string()),
                })

    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) in which a tenth of the documents, by the checksum of the id, end in copies of their words.

    From word a on, word i is the document's word a + (i - a) % p. Documents without an id or words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("_h"),
        F.when(h % 10 == 0, F.expr(r"regexp_extract_all(text, '[^ \\t-\\r]+', 0)")).alias("_w"),
    ).withColumn("_n", F.size("_w"))
    start = F.expr("_h div 10 % _n")
    size = F.expr("1 + (_n - _a) div (3 + (_h div 10) % 8)")
    sized = chosen.withColumn("_a", F.when(F.col("_n") > 0, start)).withColumn("_p", size)
    repeated = F.expr("array_join(transform(sequence(0L, _n - 1L), i -> _w[cast(if(i < _a, i, _a + (i - _a) % _p) as int)]), ' ')")
    return sized.select("doc_id", F.when(F.col("_n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@query("op12_periodic_runs")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, folder, "documents")))
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    greatest = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    best = found.withColumn("best", greatest)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.expr("-best.start").alias("start"), F.col("best.length").alias("length"),
        F.expr("-best.period").alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        _sha(lines).alias("runs_sha256"), _sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
