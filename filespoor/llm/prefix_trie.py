"""The trie of conversations' first turns, with totals of subtrees rolled up in bands of depths.

A node is a distinct sequence of first turns; its key is the exclusive or, over these turns, of 128-bit hashes of (depth,
turn). Such keys can be made of parts, so that a conversation of any length is numbered and hashed in pieces: rows are
sorted by range, each piece of a conversation within a task gets its own counts, and the sums before it come from the
pieces. A node's smallest conversation stands for it, and its ancestors are the keys of that conversation at lesser depths.

Rollup: nodes are in bands of BAND depths, and a node's values go to its ancestors in its band only, so at most BAND rows
a node. The first nodes of bands form a trie of their own, whose values are the sums in their bands; its totals are rolled
up the same way, at BAND times the stride. Totals of a band's first nodes then go to their ancestors in the band above. So
depth D takes about log D / log BAND rounds instead of D.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filespoor.llm.common import join_same, table
from filespoor.llm.registry import query
from filespoor.operators.skew import salted_join
from filespoor.session import Workspace

BAND = 64
CHUNK = 4096  # ids in a piece of text
HOT = 100_000  # rows of a key that are spread over more tasks
KEY = ["depth", "k1", "k2"]


def _turns(conversations: DataFrame, space: Workspace) -> DataFrame:
    """(conv_id, part, at, t1, t2, words): the turns without their texts, in order within pieces of conversations.

    Turns of one number come by role, then text. ``part`` is the task that sorted the row, ``at`` grows within it.
    """
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")}
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text["role"], text["text"]
    )
    # null comes first; of texts the beginning is enough to deal them out
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64)]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order[:3], "text")
    at = F.monotonically_increasing_id()
    return space.save(placed.select(
        "conv_id", F.shiftright(at, 33).cast("int").alias("part"), at.alias("at"),
        *[F.xxhash64(F.lit(i), "role", "text").alias(f"t{i}") for i in (1, 2)],
        F.regexp_count("text", F.lit(r"[^ \t-\r]+")).cast("long").alias("words"),
    ), "turns")


def _numbered(turns: DataFrame, space: Workspace) -> DataFrame:
    """Turns with their number ``own`` in the conversation, from 1."""
    pieces = turns.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    # a conversation has at most one piece a task
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = pieces.select("conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    here = Window.partitionBy("conv_id", "part").orderBy("at")
    joined = turns.join(before, ["conv_id", "part"])
    return space.save(joined.withColumn("own", F.col("before") + F.row_number().over(here)).drop("before", "at"), "numbered")


def regrouped(turns: DataFrame, every: int, kinds: int, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another: ``(conv_id, n_turns)`` and ``(conv_id, part, depth, t1, t2, words)``.

    Conversation c has the first h turns of conversation c - c % every, h being the checksum of its id modulo ``kinds``, then its own after its first h.
    """
    convs = turns.groupBy("conv_id").agg(F.max("own").alias("n_own")).select(
        "conv_id", "n_own", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % kinds).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % every).alias("base"),
    )
    heads = turns.filter(f"conv_id % {every} = 0 and own < {kinds}").select(
        F.col("conv_id").alias("base"), F.col("own").alias("depth"), "t1", "t2", "words"
    )
    # at most ``every`` conversations share a base
    lent = convs.join(heads, "base").filter("depth <= h")
    taken = space.save(convs.join(
        lent.groupBy("conv_id").agg(F.count(F.lit(1)).alias("lent")), "conv_id", "left"
    ).withColumn("lent", F.coalesce("lent", F.lit(0))), "convs")
    # own turns know their shift through the pieces, which are as many as tasks for a long conversation
    shifts = turns.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("_n")).drop("_n").join(
        taken.select("conv_id", "h", "lent"), "conv_id"
    )
    own = turns.join(shifts, ["conv_id", "part"]).filter("own > h").withColumn("depth", F.expr("own - h + lent"))
    columns = ["conv_id", "part", "depth", "t1", "t2", "words"]
    rebuilt = own.select(*columns).unionByName(lent.withColumn("part", F.lit(-1)).select(*columns))
    lengths = taken.select("conv_id", F.expr("lent + greatest(n_own - h, 0)").alias("n_turns"))
    return space.save(lengths, "lengths"), space.save(rebuilt, "rebuilt")


def _keyed(turns: DataFrame, lengths: DataFrame, space: Workspace) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, words): each conversation's nodes from the root, with the parent's key (p1, p2)."""
    hashed = turns.select("conv_id", "part", "depth", "words", *[
        F.xxhash64(F.lit(i), "depth", "t1", "t2").alias(f"x{i}") for i in (1, 2)
    ])
    pieces = hashed.groupBy("conv_id", "part").agg(*[F.bit_xor(f"x{i}").alias(f"all{i}") for i in (1, 2)])
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = pieces.select("conv_id", "part", *[
        F.coalesce(F.bit_xor(f"all{i}").over(earlier), F.lit(0)).alias(f"before{i}") for i in (1, 2)
    ])
    upto = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    keyed = hashed.join(before, ["conv_id", "part"])
    for i in (1, 2):
        keyed = keyed.withColumn(f"k{i}", F.col(f"before{i}").bitwiseXOR(F.bit_xor(f"x{i}").over(upto)))
    paths = keyed.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "k1", "k2",
        *[F.col(f"k{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"p{i}") for i in (1, 2)], "words",
    )
    none = [F.lit(0).cast("long").alias(c) for c in ("depth", "k1", "k2", "p1", "p2", "words")]
    return space.save(paths.unionByName(lengths.select("conv_id", *none)), "paths")


def _sums(rows: DataFrame, values: list[str]) -> DataFrame:
    return rows.groupBy(*KEY).agg(*[F.sum(v).alias(v) for v in values])


def rollup(nodes: DataFrame, paths: DataFrame, values: list[str], space: Workspace, band: int = BAND, deepest: int | None = None) -> DataFrame:
    """(depth, k1, k2) with sums of ``values`` over each node's subtree, its top included.

    ``nodes`` have the key, values and ``conv_id``, a conversation that passes them; ``paths`` has each such conversation's
    keys at all depths. ``deepest`` is the greatest depth, if it is known.
    """
    if deepest is None:
        deepest = nodes.agg(F.max("depth")).first()[0] or 0

    def above(rows: DataFrame, stride: int, up: int) -> DataFrame:
        """Rows once for each ancestor (itself included) at multiples of ``stride`` in the band ``up`` bands above theirs."""
        span = stride * band
        lists = paths.filter(F.col("depth") % stride == 0).groupBy("conv_id", F.expr(f"depth div {span}").alias("_band")).agg(
            F.collect_list(F.struct(*KEY)).alias("_path")  # at most ``band``
        )
        placed = rows.withColumn("_band", F.expr(f"depth div {span} - {up}")).withColumnRenamed("depth", "_own")
        found = placed.join(lists, ["conv_id", "_band"])
        reached = F.filter("_path", lambda x: x["depth"] <= F.col("_own"))
        return found.select(F.inline(reached), *values)

    def totals(rows: DataFrame, stride: int) -> DataFrame:
        inside = space.save(_sums(above(rows, stride, 0), values), f"inside-{stride}")
        span = stride * band
        if deepest < span:
            return inside
        roots = inside.filter(F.col("depth") % span == 0)
        named = roots.join(rows.select(*KEY, "conv_id").filter(F.col("depth") % span == 0), KEY)
        complete = totals(named, span)
        lower = complete.filter("depth > 0").join(rows.select(*KEY, "conv_id"), KEY)
        return space.save(_sums(inside.unionByName(above(lower, stride, 1)), values), f"totals-{stride}")

    return totals(nodes, 1)


def _ends(paths: DataFrame, lengths: DataFrame, space: Workspace) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of nodes at which conversations end.

    Sorted by range, ids become pieces of text of at most CHUNK ids; a node that many conversations share is hashed from
    these pieces, one after the other.
    """
    last = lengths.select("conv_id", F.col("n_turns").cast("long").alias("depth"))
    ends = paths.join(last, ["conv_id", "depth"]).select(*KEY, "conv_id")
    order = [*KEY, "conv_id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*KEY, "first", "ids"]
        key, ids = None, []
        for batch in batches:
            rows: list[tuple] = []
            for *own, conv_id in zip(*(batch.column(c).to_pylist() for c in order)):
                if ids and (own != key or len(ids) == CHUNK):
                    rows.append((*key, ids[0], ",".join(map(str, ids))))
                    ids = []
                key = own
                ids.append(conv_id)
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows))))
        if ids:
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip((*key, ids[0], ",".join(map(str, ids)))))))

    packed = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        pack, "depth long, k1 long, k2 long, first long, ids string"
    )
    chunks = space.save(packed, "ends")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*KEY, "ends_sha256"]
        key, hashed = None, None
        for batch in batches:
            rows: list[tuple] = []
            for *own, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
                if own != key:
                    if key is not None:
                        rows.append((*key, hashed.hexdigest()))
                    key, hashed = own, hashlib.sha256()
                else:
                    hashed.update(b",")
                hashed.update(ids.encode())
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows))))
        if key is not None:
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip((*key, hashed.hexdigest())))))

    ordered = chunks.repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return ordered.mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame, space: Workspace, band: int = BAND, hot_rows: int = HOT) -> DataFrame:
    """One row per node of conversations ``(conv_id, part, depth, t1, t2, words)`` with ``(conv_id, n_turns)``.

    conv_id (the smallest that begins so), depth, parent_conv_id (root: null), n_convs, n_children, n_leaves and
    saved_tokens (both over the subtree), ends_sha256. No conversations give no nodes.
    """
    paths = _keyed(turns, lengths, space)
    nodes = space.save(paths.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"),
    ), "nodes")
    parent = [F.expr("depth - 1").alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    children = nodes.filter("depth > 0").groupBy(*parent).agg(F.count(F.lit(1)).alias("n_children"))
    valued = space.save(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).select(
        *KEY, "conv_id", "n_children", F.when(F.col("n_children") == 0, 1).otherwise(0).alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    ), "values")
    totals = rollup(valued, paths, ["n_leaves", "saved_tokens"], space, band)
    # one parent may have a large share of all nodes as children
    above = nodes.select(F.expr("depth + 1").alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    linked = salted_join(nodes.drop("words"), above, ["depth", "p1", "p2"], "left", hot_rows=hot_rows)
    ends = _ends(paths, lengths, space)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        linked.join(valued.select(*KEY, "n_children"), KEY).join(totals, KEY).join(ends, KEY, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"),
            "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"),
        )
    )


def conversation_trie(
    conversations: DataFrame, space: Workspace, every: int = 0, kinds: int = 1, band: int = BAND, hot_rows: int = HOT
) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text); columns as in ``trie``.

    Turns come by number, null first, equal ones by role and text; null role or text is empty. Rows without conv_id
    belong to no conversation and are left out. Other columns are ignored; repeated rows are turns of their own. With ``every``, conversations share beginnings as
    ``regrouped`` says. A table without conversations gives no nodes, not even the root.
    """
    turns = _numbered(_turns(conversations, space), space)
    if every:
        lengths, turns = regrouped(turns, every, kinds, space)
    else:
        lengths = turns.groupBy("conv_id").agg(F.max("own").alias("n_turns"))
        turns = turns.withColumnRenamed("own", "depth")
    return trie(turns, lengths, space, band, hot_rows)


@query("op13_prefix_trie")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie(table(spark, folder, "conversations"), Workspace(spark, "trie"), every=20, kinds=4)
