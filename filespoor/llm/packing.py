"""Best-fit packing of documents into sequences, planned over the histogram of piece lengths.

Pieces of one length are interchangeable, so best-fit decreasing runs over counts: whatever the number of documents, the
driver sees one count per length and makes a plan of some steps per length. A step says which ranks within a length go to
which run of sequences, how many to each, and at which offset they begin. Pieces get their rank from a counter per task and
length and the sums of the tasks before, so no length, however frequent, is sorted or numbered in one place.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filespoor.llm import chunks
from filespoor.llm.bpe import vocabulary
from filespoor.llm.common import table
from filespoor.llm.registry import query
from filespoor.session import Workspace

VOCABULARY = "byte_bpe_50k.json"
SIZE, END_ID = 1024, 2


def pieces(docs: DataFrame, path: str, size: int, end_id: int, with_ids: bool) -> DataFrame:
    """Tokenized documents in pieces of at most ``size`` ids, each numbered within its task and length."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, seen = chunks.Cache(vocabulary(path).encode), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for first, texts in chunks.parts(batch):
                rows: list[tuple] = []
                for row, values in enumerate(cache.of(texts), first):
                    ids = b"".join(values) + end
                    n = len(ids) // 4
                    cuts = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        own = ids[4 * a:4 * b]
                        rows.append((row, piece, a, b - a, zlib.crc32(own), part, seen[b - a], own))
                        seen[b - a] += 1
                at, *columns, own = zip(*rows)
                names = ("piece", "start", "length", "ids_crc32", "part", "place")
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column("doc_id").take(pa.array(at))}
                    | {name: pa.array(x, pa.int64()) for name, x in zip(names, columns)}
                    | ({"ids": pa.array(own, pa.binary())} if with_ids else {})
                )

    schema = "doc_id long, piece long, start long, length long, ids_crc32 long, part long, place long"
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(
        run, schema + ", ids binary" * with_ids
    )


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts by length: steps (length, first rank, first sequence, pieces each, offset)."""
    steps: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # by free space: runs of sequences (first, number)
    made = 0
    for length in sorted(counts, reverse=True):
        rank, end = 0, counts[length]
        free = sorted(r for r, runs in room.items() if r >= length and runs)
        while rank < end:
            if free:
                space = free[0]
                each = space // length
                first, number = room[space].pop()
                if not room[space]:
                    free.pop(0)
            else:
                space, each = size, size // length
                first, number = made, -(-(end - rank) // each)
                made += number
            full = min(number, (end - rank) // each)
            for n, many in ((full, each), (min(1, number - full), end - rank - full * each)):
                if n and many > 0 and rank < end:
                    many = min(many, each)
                    steps.append((length, rank, first, many, size - space))
                    room.setdefault(space - many * length, []).append((first, n))
                    rank, first, number = rank + n * many, first + n, number - n
            if number:
                room.setdefault(space, []).append((first, number))
        room.pop(0, None)
    return steps


def pack(
    docs: DataFrame, space: Workspace, size: int = SIZE, end_id: int = END_ID, path: str | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids.

    A document is its ids and ``end_id``; only longer ones than ``size`` are cut, the first piece is the shorter one. A
    null or empty text is ``end_id`` alone. Each sequence is filled from 0 without gaps. Rows that repeat are packed each
    on their own; doc_id may be null; other columns are ignored. Without ``with_ids`` the ids (little-endian unsigned
    32-bit integers) are left out. An empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = space.save(pieces(docs, path or public_tokenizers.path(VOCABULARY), size, end_id, with_ids), "pieces")
    counted = space.save(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # one row per length: at most ``size``
    counts = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps: dict[int, list] = {}
    for length, *step in plan(counts, size):
        steps.setdefault(length, []).append(tuple(step))
    planned = spark.createDataFrame(
        list(steps.items()), "length long, steps array<struct<rank:long, first:long, each:long, at:long>>"
    )
    # sums of all tasks, which grow with the input: not to be broadcast
    ranked = cut.join(bases.hint("merge"), ["part", "length"]).withColumn("rank", F.expr("base + place"))
    # the plan has at most ``size`` rows of some steps each
    slots = ranked.join(F.broadcast(planned), "length").withColumn(
        "step", F.expr("element_at(filter(steps, s -> s.rank <= rank), -1)")
    ).withColumn("nth", F.expr("rank - step.rank"))
    return slots.select(
        "doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32",
        F.expr("step.first + nth div step.each").alias("sequence_id"),
        F.expr("step.at + nth % step.each * length").alias("offset"), *["ids"] * with_ids,
    )


@query("op5_packing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), Workspace(spark, "packing"), with_ids=False)
