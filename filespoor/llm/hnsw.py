"""Nearest neighbours by hierarchical navigable small-world graphs, one per shard, whose results are merged.

A shard is a graph over its distinct vectors, which are numbered by falling level, so each layer is a range from 0 and its
links one flat array of WIDTH numbers a node. Layers are built from the top; nodes join a layer in batches, whose searches
go on in lockstep as matrix operations. A coordinate is added that gives all vectors of a shard one length, so nearness by
inner product is nearness in a metric space. Shards are dealt by id, so they are even whatever the vectors are; equal
vectors of a shard are one node with its ids. Graphs are written as one row per shard, then searched by blocks of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filespoor.llm.common import table
from filespoor.llm.registry import query
from filespoor.session import Workspace

WIDTH = 32  # links of a node
SHRINK = 16  # each layer has about a 16th of the nodes below
BUILD, SEARCH = 64, 96  # nodes in hand while building and searching
BATCH = 256
SHARD_ROWS, SHARDS = 1 << 16, 8
BLOCK, BLOCKS = 1024, 64  # queries of a block, blocks of a task
_FAR = np.float32(-np.inf)


def _rounded(x: int) -> int:
    return 1 << max(x - 1, 0).bit_length()


class Graph:
    """The layers over ``vectors`` (float32, of one length, the first ones on the higher layers)."""

    def __init__(self, vectors: np.ndarray, sizes: list[int], layers: list[np.ndarray] | None = None):
        self.vectors, self.sizes = vectors, sizes
        self.layers = layers if layers is not None else [np.full((n, WIDTH), -1, np.int32) for n in sizes]

    @classmethod
    def build(cls, vectors: np.ndarray, levels: np.ndarray) -> Graph:
        """``levels``: the highest layer of each vector, falling."""
        graph = cls(vectors, [int((levels >= level).sum()) for level in range(int(levels.max(initial=0)) + 1)])
        for layer in range(len(graph.sizes) - 1, -1, -1):
            graph._fill(layer)
        return graph

    def _fill(self, layer: int) -> None:
        n, done = self.sizes[layer], 0
        while done < n:
            own = np.arange(done, min(n, done + max(BATCH // 4, min(BATCH, done))))
            some = self.vectors[own]
            near = some @ some.T
            np.fill_diagonal(near, _FAR)
            ids, score = np.broadcast_to(own, near.shape), near
            if done:
                entry = self._descend(some, layer)
                ids, score = (np.concatenate(x, axis=1) for x in zip((ids, score), self._walk(some, layer, entry, BUILD)))
            top = np.argsort(-score, axis=1, kind="stable")[:, :BUILD]
            ids, score = np.take_along_axis(ids, top, 1), np.take_along_axis(score, top, 1)
            ids = np.where(np.isfinite(score), ids, -1)
            chosen = self._choose(ids, score)
            self.layers[layer][own] = chosen
            self._link_back(layer, own, chosen)
            done += len(own)

    def _choose(self, ids: np.ndarray, score: np.ndarray) -> np.ndarray:
        """WIDTH links of each row from candidates by falling score: first those nearer to it than to a chosen one, then others."""
        rows, width = ids.shape
        out = np.full((rows, WIDTH), -1, np.int32)
        for a in range(0, rows, BATCH):
            some, own = ids[a:a + BATCH], score[a:a + BATCH]
            vectors = self.vectors[np.maximum(some, 0)]
            between = vectors @ vectors.transpose(0, 2, 1)
            blocked = some < 0
            taken, count = np.zeros(some.shape, bool), np.zeros(len(some), np.int64)
            for i in range(width):
                take = ~blocked[:, i] & (count < WIDTH)
                taken[:, i] = take
                count += take
                blocked |= take[:, None] & (between[:, i] > own)
            rest = (some >= 0) & ~taken
            order = np.argsort(np.where(taken, 0, np.where(rest, 1, 2)), axis=1, kind="stable")[:, :WIDTH]
            kept = np.take_along_axis(np.where(taken | rest, some, -1), order, 1)
            out[a:a + BATCH, :kept.shape[1]] = kept
        return out

    def _link_back(self, layer: int, own: np.ndarray, chosen: np.ndarray) -> None:
        """Nodes get a link to those that chose them; a node with too many chooses anew."""
        links = self.layers[layer]
        to, back = chosen.ravel(), np.repeat(own, WIDTH)
        back, to = back[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, count)
        # few nodes are chosen very often: those of like numbers together
        size = np.array([_rounded(int(c)) for c in count])
        for width in np.unique(size):
            some = np.flatnonzero(size == width)
            row = np.full(len(nodes), -1)
            row[some] = np.arange(len(some))
            of = np.repeat(row, count)
            added = np.full((len(some), width), -1, np.int32)
            added[of[of >= 0], place[of >= 0]] = back[of >= 0]
            for a in range(0, len(some), BATCH):
                part = nodes[some[a:a + BATCH]]
                old, new = links[part], added[a:a + BATCH]
                new = np.where((new[:, :, None] == old[:, None, :]).any(2), -1, new)  # linked already
                both = np.concatenate([old, new], axis=1)
                score = np.einsum("bkd,bd->bk", self.vectors[np.maximum(both, 0)], self.vectors[part])
                score[both < 0] = _FAR
                order = np.argsort(-score, axis=1, kind="stable")
                both, score = np.take_along_axis(both, order, 1), np.take_along_axis(score, order, 1)
                full = (both >= 0).sum(1) > WIDTH
                links[part] = both[:, :WIDTH]
                if full.any():
                    links[part[full]] = self._choose(both[full], score[full])

    def _descend(self, vectors: np.ndarray, layer: int) -> np.ndarray:
        """Entries to ``layer``: nodes found on the layers above, -1 for none."""
        entry = np.zeros((len(vectors), 1), np.int32)
        for above in range(len(self.sizes) - 1, layer, -1):
            entry = self._walk(vectors, above, entry, 8)[0]
        return entry

    def _walk(self, vectors: np.ndarray, layer: int, entry: np.ndarray, hold: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest ``hold`` nodes that each vector's walk through the layer meets, nearest first, and their scores."""
        links, n, rows = self.layers[layer], self.sizes[layer], np.arange(len(vectors))[:, None]
        seen = np.zeros((len(vectors), n), bool)
        held = np.full((len(vectors), hold), -1, np.int32)
        score = np.full((len(vectors), hold), _FAR, np.float32)
        open_ = np.zeros((len(vectors), hold), bool)

        def add(live: np.ndarray, fresh: np.ndarray) -> None:
            at = rows[:len(live)]
            fresh = np.sort(fresh, axis=1)
            new = fresh >= 0
            new[:, 1:] &= fresh[:, 1:] != fresh[:, :-1]
            new &= ~seen[live[:, None], np.maximum(fresh, 0)]
            seen[np.broadcast_to(live[:, None], fresh.shape)[new], fresh[new]] = True
            near = np.einsum("bkd,bd->bk", self.vectors[np.maximum(fresh, 0)], vectors[live])
            near[~new] = _FAR
            ids = np.concatenate([held[live], fresh], axis=1)
            all_scores = np.concatenate([score[live], near], axis=1)
            is_open = np.concatenate([open_[live], new], axis=1)
            order = np.argpartition(-all_scores, hold - 1, axis=1)[:, :hold] if all_scores.shape[1] > hold else None
            if order is not None:
                ids, all_scores, is_open = ids[at, order], all_scores[at, order], is_open[at, order]
            held[live], score[live], open_[live] = ids, all_scores, is_open & (all_scores > _FAR)

        live = np.arange(len(vectors))
        add(live, entry)
        steps = min(4, hold)
        while len(live):
            waiting = np.where(open_[live], score[live], _FAR)
            best = np.argpartition(-waiting, steps - 1, axis=1)[:, :steps]
            real = np.take_along_axis(waiting, best, 1) > _FAR
            going = real.any(1)
            live, best, real = live[going], best[going], real[going]
            if not len(live):
                break
            at = rows[:len(live)]
            nodes = np.where(real, held[live[:, None], best], 0)
            open_[live[:, None], best] = False
            fresh = np.where(real[:, :, None], links[nodes], -1).reshape(len(live), -1)
            add(live, fresh)
        order = np.argsort(-score, axis=1, kind="stable")
        held, score = np.take_along_axis(held, order, 1), np.take_along_axis(score, order, 1)
        return np.where(score > _FAR, held, -1), score

    def search(self, vectors: np.ndarray, hold: int) -> np.ndarray:
        """The nodes nearest to each vector, nearest first, -1 for none."""
        found = [np.zeros((0, hold), np.int32)]
        for a in range(0, len(vectors), BATCH):
            some = vectors[a:a + BATCH]
            found.append(self._walk(some, 0, self._descend(some, 0), hold)[0])
        return np.concatenate(found)


def usable(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector): rows with an id whose vectors hold finite numbers only, not all of them zero."""
    values = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    good = "forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)"
    return values.filter(F.col("vec_id").isNotNull() & F.expr(f"vector is not null and {good}"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = array.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(array), -1) if len(array) else flat.reshape(0, 1)


def _scaled(vectors: np.ndarray, scale: float) -> np.ndarray:
    return (vectors / scale).astype(np.float32)


def build_shards(vectors: DataFrame, space: Workspace, shards: int, keep: int) -> DataFrame:
    """One row per shard of ``vectors`` (vec_id, vector): its graph as flat arrays, vectors and ids.

    Each dimension has shards of its own. Of rows with one id the smallest vector counts. A node holds the ``keep`` smallest ids of its vector; a search that wants fewer never needs more.
    """

    def build(rows: pa.Table) -> pa.Table:
        original, ids = _matrix(rows["vector"]) + 0.0, rows["vec_id"].to_numpy()  # + 0.0: one zero only
        order = np.argsort(ids, kind="stable")
        if (np.diff(ids[order]) == 0).any():
            order = np.lexsort((*original.T[::-1], ids))
        order = order[np.r_[True, np.diff(ids[order]) != 0]]
        original, ids = original[order], ids[order]
        whole = np.ascontiguousarray(original).view(f"V{original.shape[1] * 8}").ravel()
        _, first, node = np.unique(whole, return_index=True, return_inverse=True)
        scale = float(np.abs(original).max()) or 1.0
        distinct = _scaled(original[first], scale)
        square = (distinct.astype(np.float64) ** 2).sum(1)
        extra = np.sqrt(np.maximum(square.max() - square, 0.0)).astype(np.float32)
        # levels from the ids' hashes, so a lost task builds the same graph again
        mixed = (ids[first].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        chance = ((mixed >> np.uint64(11)).astype(np.float64) + 1) / 2**53
        levels = np.minimum((-np.log(chance) / np.log(SHRINK)).astype(np.int64), 12)
        falling = np.argsort(-levels, kind="stable")
        graph = Graph.build(np.c_[distinct, extra][falling], levels[falling])
        number = np.empty(len(falling), np.int64)
        number[falling] = np.arange(len(falling))
        node = number[node]
        by_node = np.argsort(node, kind="stable")  # ids stay in order within a node
        node, ids = node[by_node], ids[by_node]
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        place = np.arange(len(node)) - np.repeat(starts, np.diff(np.r_[starts, len(node)]))
        node, ids = node[place < keep], ids[place < keep]
        return pa.table({
            "shard": rows["shard"].slice(0, 1),
            "dimension": pa.array([original.shape[1]], pa.int32()),
            "sizes": pa.array([graph.sizes], pa.list_(pa.int32())),
            "links": pa.array([[x.tobytes() for x in graph.layers]], pa.list_(pa.binary())),
            "vectors": pa.array([original[first][falling].tobytes()], pa.binary()),
            "scaled": pa.array([graph.vectors.tobytes()], pa.binary()),
            "nodes": pa.array([node.astype(np.int32).tobytes()], pa.binary()),
            "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()),
        })

    schema = "shard long, dimension int, sizes array<int>, links array<binary>, vectors binary, scaled binary, nodes binary, ids binary"
    dealt = vectors.withColumn("shard", F.expr(f"{shards}L * size(vector) + pmod(xxhash64(vec_id), {shards})"))
    return space.save(dealt.groupBy("shard").applyInArrow(build, schema), "graphs")


class _Shard:
    """A written graph, read back."""

    def __init__(self, row: dict):
        numbers = [np.frombuffer(x, np.int32).reshape(-1, WIDTH) for x in row["links"]]
        self.scaled = np.frombuffer(row["scaled"], np.float32).reshape(-1, row["dimension"] + 1)
        self.graph = Graph(self.scaled, row["sizes"], numbers)
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dimension"])
        self.ids = np.frombuffer(row["ids"], np.int64)
        nodes = np.frombuffer(row["nodes"], np.int32)
        self.first = np.searchsorted(nodes, np.arange(len(self.vectors) + 1))

    def search(self, ids: np.ndarray, vectors: np.ndarray, k: int, hold: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(query, id, score) of the ``k`` nearest found rows of each query but itself, by exact scores."""
        scale = np.abs(vectors).max(axis=1, keepdims=True)
        plain = np.c_[(vectors / scale).astype(np.float32), np.zeros(len(vectors), np.float32)]
        found = self.graph.search(plain, hold)
        for own, vector, nodes in zip(ids, vectors, found):
            nodes = nodes[nodes >= 0]
            scores = exact(self.vectors[nodes], vector)
            many = self.first[nodes + 1] - self.first[nodes]
            rows = np.concatenate([self.ids[self.first[n]:self.first[n + 1]] for n in nodes]) if len(nodes) else self.ids[:0]
            scores = np.repeat(scores, many)
            other = rows != own
            rows, scores = rows[other], scores[other]
            top = np.lexsort((rows, -scores))[:k]
            yield np.full(len(top), own), rows[top], scores[top]


def exact(rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component on, so that every order of rows gives the same."""
    total = np.zeros(len(rows))
    for i in range(rows.shape[1]):
        total += rows[:, i] * vector[i]
    return total


def nearest(
    vectors: DataFrame, queries: DataFrame, space: Workspace, k: int = 20, hold: int = SEARCH, shard_rows: int = SHARD_ROWS,
    shards: int = SHARDS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` (vec_id, vector) found nearest to each of ``queries``.

    Both are ``usable``. Nearness is the largest inner product; a query's own id is no candidate, other rows with an equal vector are.
    Ties go to the smaller id. Of rows with one id the smallest vector counts; vectors of different dimensions are not compared. There are ``shards`` shards, more when
    these would hold over ``shard_rows`` rows. Fewer than ``k`` candidates: all of them. No rows give no rows.
    """
    total = vectors.count()
    if not total:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = max(shards, -(-total // shard_rows))
    graphs = build_shards(vectors, space, shards, k + 1)
    width = max(hold, 2 * k)
    asking = queries.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("row", F.monotonically_increasing_id())
    # rows of a task are numbered in order, so a block has at most BLOCK queries
    blocks = space.save(
        asking.groupBy(F.size("vector").alias("dimension"), F.expr(f"row div {BLOCK}").alias("block"))
        .agg(F.collect_list(F.struct("vec_id", "vector")).alias("asked")), "blocks"
    )
    # tasks that take about BLOCKS blocks each; a shard's graph goes to as many
    parts = max(1, -(-blocks.count() // BLOCKS))
    lots = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    nothing = [F.lit(None).cast(graphs.schema[c].dataType).alias(c) for c in graphs.columns if c != "shard"]
    asked = blocks.select(
        F.explode(F.expr(f"sequence({shards}L * dimension, {shards}L * dimension + {shards - 1})")).alias("shard"), *nothing,
        F.expr(f"cast(pmod(xxhash64(block, dimension), {parts}) as int)").alias("part"), F.lit(1).alias("turn"), "asked",
    )
    stored = graphs.select(*graphs.columns, lots).withColumn("turn", F.lit(0)).withColumn("asked", F.lit(None).cast(blocks.schema["asked"].dataType))

    stored_columns = graphs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, of = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                key = row.column("shard")[0].as_py()
                if row.column("turn")[0].as_py() == 0:
                    shard, of = _Shard({c: row.column(c)[0].as_py() for c in stored_columns}), key
                elif of == key:  # a shard that no vector fell to has no graph
                    some = row.column("asked").flatten()
                    ids = some.field("vec_id").to_numpy()
                    found = [np.concatenate(x) for x in zip(*shard.search(ids, _matrix(some.field("vector")), k, width))]
                    yield pa.RecordBatch.from_pydict(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found))))

    order = ["shard", "part", "turn"]
    met = stored.unionByName(asked).repartition("shard", "part").sortWithinPartitions(*order)
    partial = space.save(met.mapInArrow(run, "query_id long, vec_id long, score double"), "partial")
    # at most k rows of each shard meet by query
    best = partial.groupBy("query_id").agg(F.collect_list(F.struct(
        (-F.col("score")).alias("minus"), "vec_id", "score"
    )).alias("all")).select("query_id", F.posexplode(F.slice(F.sort_array("all"), 1, k)))
    return best.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.vec_id").alias("vec_id"), F.col("col.score").alias("score"))


@query("op11_nearest_neighbours")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    space = Workspace(spark, "hnsw")
    vectors = space.save(usable(table(spark, folder, "embeddings")), "vectors")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"), space)
