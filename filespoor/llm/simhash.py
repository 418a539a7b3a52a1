"""SimHash near duplicates found through popcounts of segments.

A fingerprint of 64 bits is cut into 32 segments of two bits, and each segment is replaced by its number of set bits. The
Manhattan distance of two such vectors is at most the number of differing bits, so fingerprints that differ in few bits are
close there too. The vector is cut into 7 runs of segments; at a distance of at most 4 some 3 runs agree, as each
difference spoils one run. So each fingerprint goes to one cell of the unit grid for every 3 of the 7 runs, close pairs
meet in a cell. In a cell, numpy blocks of pairs are kept if the Manhattan distance of their vectors allows a link, and
what is left is checked by its bits.

A cell with n linked members gives n - 1 links, not all pairs: what is asked for are components. Cells that hold more
than BLOCK fingerprints are dealt out as pairs of blocks, so no task has more than two blocks in hand. Only distinct
fingerprints take part, so copies of a text cost nothing here.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filespoor.llm import chunks
from filespoor.llm.common import table
from filespoor.llm.registry import query
from filespoor.session import Workspace

SHINGLE, SEED = 4, 42
MAX_BITS = 4
RUNS = 7
BLOCK = 2048
EVEN = 0x5555555555555555  # the lower bit of each segment
_EVEN = np.uint64(EVEN)
_TINY = 64  # cells up to this size are compared many at a time


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The bits set in over half of the shingles' hashes, repeats included; no words: 0."""
    words = text.lower().split()  # both only know ASCII
    if not words:
        return 0
    size = min(size, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-1]]
    ends = (ends - 1)[size - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends)), np.uint64, len(ends))
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # 64 bytes each
        part = hashes[at:at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def fingerprints(docs: DataFrame, row_key: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``row_key`` (long) and fp (signed) of each row of ``docs`` (doc_id, text). Null is an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in chunks.parts(batch):
                yield pa.RecordBatch.from_pydict({c: batch.column(c).slice(start, len(texts)) for c in ("doc_id", *row_key)} | {
                    "fp": pa.array([_signed(fingerprint(x.encode())) for x in texts], pa.int64()),
                })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + "".join(f"{c} long, " for c in row_key) + "fp long")


def cells(runs: int = RUNS, agree: int = RUNS - MAX_BITS) -> list[int]:
    """Masks of the segments of each choice of ``agree`` runs."""
    bounds = [32 * i // runs for i in range(runs + 1)]
    masks = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(bounds, bounds[1:])]
    return [sum(chosen) for chosen in combinations(masks, agree)]


def grid(prints: DataFrame, masks: list[int]) -> DataFrame:
    """Each fingerprint (fp) in its cells (cell)."""
    # the number of set bits of each segment, in the segment's place: both bits above, one of them below
    # (as in ``popcounts``)
    counts = prints.withColumn("next", F.shiftrightunsigned("fp", 1)).select("fp", F.expr(
        f"shiftleft(fp & next & {EVEN}L, 1) | ((fp ^ next) & {EVEN}L)"
    ).alias("counts"))
    one = [F.xxhash64(F.lit(i), F.col("counts").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)]
    return counts.select("fp", F.explode(F.array(*one)).alias("cell"))


def popcounts(fp: np.ndarray) -> np.ndarray:
    """The set bits of each segment (0, 1 or 2) of unsigned fingerprints, in the segment's place."""
    high = fp >> np.uint64(1)
    return ((fp & high & _EVEN) << np.uint64(1)) | ((fp ^ high) & _EVEN)


def manhattan(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The Manhattan distance of vectors of ``popcounts``; never more than the number of differing bits."""
    apart = left ^ right  # of a segment: equal 00, by one 01 or 11, by two 10
    return np.bitwise_count(apart & _EVEN) + 2 * np.bitwise_count((apart >> np.uint64(1)) & ~apart & _EVEN)


def _close(fp: np.ndarray, counts: np.ndarray, i: int | np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    """Which pairs of places ``i`` and ``j`` are linked, as places in ``j``: by the lower bound, then by all bits."""
    near = np.flatnonzero(manhattan(counts[i], counts[j]) <= most)
    first = i if np.isscalar(i) else i[near]
    return near[np.bitwise_count(fp[first] ^ fp[j[near]]) <= most]


def _links(left: np.ndarray, right: np.ndarray, most: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links enough to join what is linked in two blocks of fingerprints: each joins two sets that were apart."""
    both = left if same else np.r_[left, right]
    counts = popcounts(both)
    label = np.arange(len(both))
    place = np.arange(len(both))
    out: list[tuple[int, int]] = []
    for i in range(len(left)):
        first = i + 1 if same else len(left)
        near = _close(both, counts, i, place[first:], most) + first
        for other, j in zip(*np.unique(label[near], return_index=True)):
            if other != label[i]:
                out.append((i, near[j]))
                label[label == other] = label[i]
        if len(out) == len(both) - 1:
            break
    a, b = np.array(out, np.int64).reshape(-1, 2).T
    return both[a], both[b]


def compare(cell: np.ndarray, fp: np.ndarray, side: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within groups of equal ``cell`` (sorted), fewer than members. Side 0 is compared within itself, or 1 with 2."""
    fp = fp.view(np.uint64)  # bits of signed numbers would be counted without their sign
    counts = popcounts(fp)
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    size = np.diff(np.r_[first, len(cell)])
    group = np.repeat(np.arange(len(size)), size)
    pairs = [(np.zeros(0, np.int64), 0)]
    for step in range(1, min(_TINY, int(size.max()))):
        at = np.flatnonzero((cell[step:] == cell[:-step]) & (size[group[step:]] <= _TINY))
        if not len(at):
            break
        at = at[(side[at] == 0) | (side[at] != side[at + step])]
        pairs.append((at[_close(fp, counts, at, at + step, most)], step))
    left = np.concatenate([at for at, _ in pairs])
    right = np.concatenate([at + step for at, step in pairs])
    # groups with as many pairs as members go the way of the large ones
    dense = (np.bincount(group[left], minlength=len(size)) >= size) | (size > _TINY)
    plain = ~dense[group[left]]
    found = [(fp[left[plain]], fp[right[plain]])]
    for a, n in zip(first[dense], size[dense]):
        prints, sides = fp[a:a + n], side[a:a + n]
        if sides[0] == 0:
            found.append(_links(prints, prints, most, True))
        else:
            found.append(_links(prints[sides == 1], prints[sides == 2], most, False))
    return found


def links(prints: DataFrame, space: Workspace, most: int = MAX_BITS, runs: int = RUNS, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints ``prints`` (fp) that differ in at most ``most`` bits.

    Not all such pairs: as many as join what is linked. ``runs`` is above ``most``; more runs make finer cells, and more.
    """
    if runs <= most:
        raise ValueError("runs must be more than the differing bits")
    dealt = grid(prints, cells(runs, runs - most))
    large = space.save(
        dealt.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > block)
        .select("cell", F.expr(f"cast(ceil(n / {block}) as int) blocks")), "large"
    )
    # a large cell in blocks of about ``block`` members; each pair of blocks is a group
    sized = dealt.join(large, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.expr("cast(pmod(xxhash64(fp), blocks) as int)")
    groups = sized.withColumn("own", own).select(
        "cell", "blocks", "fp", "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")
    ).select(
        F.expr("if(blocks = 1, cell, xxhash64(cell, least(own, other), greatest(own, other)))").alias("cell"), "fp",
        F.expr("if(own = other, 0, if(own < other, 1, 2))").alias("side"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            held.append(tuple(batch.column(n).to_numpy(zero_copy_only=False) for n in ("cell", "fp", "side")))
            cell, fp, side = (np.concatenate(x) for x in zip(*held))
            last = int(np.searchsorted(cell, cell[-1]))  # the last group may go on
            held = [(cell[last:], fp[last:], side[last:])]
            if last:
                yield from _batches(compare(cell[:last], fp[:last], side[:last], most))
        if held and len(held[0][0]):
            yield from _batches(compare(*(np.concatenate(x) for x in zip(*held)), most))

    sorted_groups = groups.repartition("cell").sortWithinPartitions("cell")
    return sorted_groups.mapInArrow(run, "a long, b long").distinct()


def _batches(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for a, b in found:
        if len(a):
            a, b = a.view(np.int64), b.view(np.int64)
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})


def components(edges: DataFrame, space: Workspace) -> DataFrame:
    """node, label of every node of ``edges`` (a, b): label is the smallest node reachable.

    Each round a node takes the smallest label of its neighbours and then that label's own label, so the number of
    rounds grows with the logarithm of a component's width. Rounds are written; only whether labels changed is counted.
    """
    both = space.save(edges.union(edges.select("b", "a")).toDF("node", "near"), "edges")
    labels = space.save(both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("label")), "labels")
    while True:
        of_near = both.join(labels.select(F.col("node").alias("near"), "label"), "near")
        lowest = of_near.groupBy("node").agg(F.min("label").alias("low"))
        hop = space.save(
            labels.join(lowest, "node").select("node", F.least("label", "low").alias("label"), F.col("label").alias("old")), "hop"
        )
        jump = hop.select(F.col("node").alias("label"), F.col("label").alias("next"))
        stepped = space.save(
            hop.join(jump, "label").select("node", F.least("label", "next").alias("label"), "old"), "step"
        )
        changed = stepped.filter("label <> old").limit(1).count()
        labels = stepped.select("node", "label")
        if not changed:
            return labels


def near_duplicates(
    docs: DataFrame, space: Workspace, most: int = MAX_BITS, runs: int = RUNS, row_key: tuple[str, ...] = ()
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fp, component_id (smallest doc_id reachable, itself included).

    Texts without words, null too, have fingerprint zero and are linked like others. Rows that repeat a doc_id are
    nodes of their own fingerprints. Null doc_ids count for links but are no component's id unless all are null.
    An empty table gives no rows; other columns are ignored. ``row_key`` names long columns that tell rows apart: they are
    returned too, and ``kept``, true for one row of a component: the smallest doc_id, null last, then the smallest key.
    """
    printed = space.save(fingerprints(docs, row_key), "prints")
    least = F.min("doc_id") if not row_key else F.min(F.struct(F.expr("doc_id is null").alias("none"), "doc_id", *row_key))
    distinct = space.save(printed.groupBy("fp").agg(least.alias("least")), "distinct")
    labels = components(space.save(links(distinct.select("fp"), space, most, runs), "links"), space)
    named = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    named = space.save(named, "named")
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    final = space.save(named.join(ids, "label").select("fp", "component_id"), "components")
    if not row_key:
        return printed.join(final, "fp").select("doc_id", "fp", "component_id")
    stays = F.expr("doc_id <=> component_id.doc_id")
    for c in row_key:
        stays = stays & (F.col(c) == F.col(f"component_id.{c}"))
    return printed.join(final, "fp").select("doc_id", *row_key, "fp", "component_id.doc_id", stays.alias("kept")).toDF(
        "doc_id", *row_key, "fp", "component_id", "kept"
    )


@query("op4_simhash")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"), Workspace(spark, "simhash"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
