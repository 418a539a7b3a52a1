"""Version lists of contents and paths, interned: each distinct list is one row, all else names it by its id.

The id is a hash of the list (128 bits), so it needs no numbering and is the same in every run. A site's matches are sums
by set; versions come in only where a site's sets are together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from filespoor.operators import skew
from filespoor.operators.skew import HOT_ROWS, salted_join

KEY = ["is_using", "key_path", "key_checksum"]
SUM_KEY = ["site_id", "is_using", "set_id"]
# version ids in sets that are sent to all tasks; more are joined by a shuffle
BROADCAST_ENTRIES = 4_000_000
# version ids that one task of a block holds, 4 bytes each
BLOCK_ENTRIES = 120_000_000
# pairs of site and version that a task gives out at a time
BLOCK_ROWS = 500_000
SCORES = ("pos_micro", "neg_micro", "n_pos", "n_neg")
BOTH = 2  # a missing flag beside 0 and 1


@dataclass
class VersionSets:
    """``keys(is_using, key_path, key_checksum, set_id)`` of an index and ``sets(set_id, versions)``."""

    keys: DataFrame
    sets: DataFrame
    _entries: list[int] = field(default_factory=list)

    def entries(self) -> int:
        """Version ids in all sets, counted once."""
        if not self._entries:
            self._entries.append(count_entries(self.sets))
        return self._entries[0]


def count_entries(sets: DataFrame) -> int:
    return sets.agg(F.sum(F.size("versions"))).first()[0] or 0


def set_id(versions: Column, kind: str) -> Column:
    """Id of a sorted list. Lists of an index and those made from two of them have ids of their own."""
    return F.unhex(F.md5(F.concat_ws(",", F.lit(kind), versions.cast("array<string>"))))


def no_checksum(rows: DataFrame) -> Column:
    return F.lit("").cast(rows.schema["checksum"].dataType)


def intern(by_checksum: DataFrame, by_path: DataFrame, save: Callable[[DataFrame, str], DataFrame]) -> VersionSets:
    """Sets of the versions that use each content and of those that provide each path."""
    none = no_checksum(by_checksum)
    users = by_checksum.select(
        F.lit(True).alias("is_using"), F.lit("").alias("key_path"), F.col("checksum").alias("key_checksum"), "version_id"
    )
    providers = by_path.select(
        F.lit(False).alias("is_using"), F.col("webroot_path").alias("key_path"), none.alias("key_checksum"), "version_id"
    )
    lists = users.unionByName(providers).groupBy(*KEY).agg(F.sort_array(F.collect_list("version_id")).alias("versions"))
    named = save(lists.withColumn("set_id", set_id(F.col("versions"), "index")), "set-lists")
    sets = named.groupBy("set_id").agg(F.first("versions").alias("versions"))
    return VersionSets(save(named.drop("versions"), "set-keys"), save(sets, "sets"))


def kind_sets(weighted: DataFrame, packed: VersionSets, save: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``(webroot_path, checksum, matched)``: flags and sets of each kind of asset, and sets that the index does not have.

    An asset matches the versions that use its content and, negatively, those that only provide its path. All content that no
    version uses is one kind at a path (an empty checksum). For known content all providers match negatively, which is taken
    back from those that use it; the flag of these is missing (``_signed``). So only the versions that two sets share are listed,
    once for each pair of sets: a path may have very many providers for each of its contents.
    """
    kinds = weighted.select("webroot_path", _known(weighted).alias("checksum"), "found").distinct()
    providers = packed.keys.filter(~F.col("is_using")).select(F.col("key_path").alias("webroot_path"), F.col("set_id").alias("_providers"))
    users = packed.keys.filter("is_using").select(F.col("key_checksum").alias("checksum"), F.col("set_id").alias("_users"))
    placed = save(kinds.join(providers, "webroot_path", "left").join(users, "checksum", "left"), "kinds")
    lists = [packed.sets.select(F.col("set_id").alias(f"_{n}"), F.col("versions").alias(f"{n}_versions")) for n in ("providers", "users")]
    pairs = placed.filter("found").select("_providers", "_users").distinct().join(lists[0], "_providers").join(lists[1], "_users")
    shared = pairs.select("_providers", "_users", "users_versions", F.array_intersect("users_versions", "providers_versions").alias("_both"))
    rest = F.when(F.size("_both") == F.size("users_versions"), F.array().cast(packed.sets.schema["versions"].dataType))
    # users that all provide the path are a set of the index
    parts = save(
        shared.withColumn("_rest", rest.otherwise(F.array_except("users_versions", "_both"))).select(
            "_providers", "_users", F.when(F.size("_rest") > 0, F.col("_both")).alias("both_versions"), F.col("_rest").alias("rest_versions"),
            F.when(F.size("_rest") == 0, F.col("_users")).when(F.size("_both") > 0, set_id(F.col("_both"), "other")).alias("_both"),
            F.when(F.size("_rest") > 0, set_id(F.col("_rest"), "other")).alias("_rest"),
        ), "shared"
    )

    def match(is_using: bool | None, name: str) -> Column:
        return F.struct(F.lit(is_using).cast("boolean").alias("is_using"), F.col(name).alias("set_id"))

    known = F.when(F.col("_both").isNull(), F.array(match(True, "_users"), match(False, "_providers"))).otherwise(
        F.array(match(None, "_both"), match(True, "_rest"), match(False, "_providers"))
    )
    each = F.when(~F.col("found"), F.array(match(False, "_providers"))).when(F.col("_users").isNotNull(), known)
    matched = placed.join(parts.drop("both_versions", "rest_versions"), ["_providers", "_users"], "left").select(
        "webroot_path", "checksum", F.filter(each, lambda m: m["set_id"].isNotNull()).alias("matched")
    ).filter(F.size("matched") > 0)
    others = parts.select(F.inline(F.array(*[F.struct(F.col(f"_{n}").alias("set_id"), F.col(f"{n}_versions").alias("versions")) for n in ("both", "rest")])))
    return matched, others.filter(F.size("versions") > 0).groupBy("set_id").agg(F.first("versions").alias("versions"))


def _known(weighted: DataFrame) -> Column:
    return F.coalesce(F.when(F.col("found"), F.col("checksum")), no_checksum(weighted))


def set_sums(
    weighted: DataFrame, packed: VersionSets, hot_rows: int = HOT_ROWS, save: Callable[[DataFrame, str], DataFrame] = lambda df, name: df
) -> tuple[DataFrame, DataFrame]:
    """``(site_id, is_using, set_id, weight_micro, n)`` summed over assets, and sets that the index does not have; flags as in ``kind_sets``.

    ``weighted`` are assets from ``weigh_assets``. Few kinds come to the assets by a broadcast; of many, one that a large share
    of all sites has is spread by ``salted_join``. A site with very many assets is summed up before its rows meet.
    """
    matched, others = kind_sets(weighted, packed, save)
    assets = weighted.select("site_id", "weight_micro", "webroot_path", _known(weighted).alias("checksum"))
    matched = save(matched, "matched")
    met = skew.near(matched, skew.NEAR_ROWS)(assets, matched, ["webroot_path", "checksum"], hot_rows=hot_rows)
    each = met.select("site_id", "weight_micro", F.inline("matched"))
    sums = each.groupBy(*SUM_KEY).agg(F.sum("weight_micro").alias("weight_micro"), F.count(F.lit(1)).alias("n"))
    return sums, others


def _signed(sums: DataFrame) -> DataFrame:
    """Sums without missing flags: such versions match positively, and all providers of the path count them too, which is taken back."""
    def row(is_using: Column, sign: int) -> Column:
        return F.struct(is_using.alias("is_using"), (F.col("weight_micro") * sign).alias("weight_micro"), (F.col("n") * sign).alias("n"))

    both = F.when(F.col("is_using").isNull(), F.array(row(F.lit(True), 1), row(F.lit(False), -1))).otherwise(F.array(row(F.col("is_using"), 1)))
    return sums.select("site_id", "set_id", F.inline(both))


def add_sums(*parts: DataFrame) -> DataFrame:
    """Sums over several disjoint lots of assets; no asset is matched again."""
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total.groupBy(*SUM_KEY).agg(F.sum("weight_micro").alias("weight_micro"), F.sum("n").alias("n"))


def add_sets(*parts: DataFrame) -> DataFrame:
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total.groupBy("set_id").agg(F.first("versions").alias("versions"))


def with_versions(sums: DataFrame, packed: VersionSets, others: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Sums by site with their versions, the rows of a site together and in a row.

    Sums are narrow and are what is shuffled by site. Sets of up to BROADCAST_ENTRIES versions in all go to every task;
    larger ones are joined by set first, and lists travel with the sums, which ``blocks`` spares.
    """
    sets = packed.sets.unionByName(others)
    if packed.entries() + count_entries(others) <= BROADCAST_ENTRIES:
        listed = _signed(sums.repartition("site_id")).join(F.broadcast(sets), "set_id")
    else:
        listed = salted_join(_signed(sums), sets, ["set_id"], hot_rows=hot_rows).repartition("site_id")
    # behind the join: a sort before it would be taken for needless and left out
    return listed.sortWithinPartitions("site_id")


def blocks(sums: DataFrame, packed: VersionSets, others: DataFrame) -> tuple[DataFrame, int] | None:
    """Sums of a block of sites with the sets that it needs, and the number of shares of versions; None for few version ids.

    Sums stay narrow. Each block gets a set once, however many of its sites have it, as ``_coded`` bytes, and holds at most some
    BLOCK_ENTRIES version ids: beyond that versions are dealt to shares, and a block is there once for each share. Rows of a
    block are in one partition, sets first, then sums by site and set.
    """
    entries = packed.entries() + count_entries(others)
    if entries <= BROADCAST_ENTRIES:
        return None
    shares = -(-entries // BLOCK_ENTRIES)
    n = max(1, -(-2 * sums.sparkSession.sparkContext.defaultParallelism // shares))
    placed = sums.withColumn("_block", F.pmod(F.xxhash64("site_id"), F.lit(n)).cast("int"))
    needed = placed.select("_block", "set_id").distinct()
    sets = packed.sets.unionByName(others).withColumn("versions", F.col("versions").cast("array<bigint>"))
    every = F.sequence(F.lit(0), F.lit(shares - 1))
    if shares == 1:
        sets, placed = sets.withColumn("_share", F.lit(0)), placed.withColumn("_share", F.lit(0))
    else:
        of_share = F.transform(every, lambda i: F.filter("versions", lambda v: F.pmod(F.xxhash64(v), F.lit(shares)) == i))
        sets = sets.select("set_id", F.posexplode(of_share).alias("_share", "versions"))
        placed = placed.withColumn("_share", F.explode(every))
    coded = sets.filter(F.size("versions") > 0).select("set_id", "_share", "versions").mapInArrow(
        _coded, "set_id binary, _share int, versions binary"
    )
    kinds = {c: placed.schema[c].dataType for c in ("site_id", "is_using", "weight_micro", "n")}
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()]
    part = (F.col("_block") * shares + F.col("_share")).alias("_part")
    lists = needed.join(coded, "set_id").select(part, "set_id", *nothing, "versions")
    rows = placed.select(part, "set_id", *kinds, F.lit(None).cast("binary").alias("versions"))
    dealt = lists.unionByName(rows).repartitionById(n * shares, F.col("_part"))
    return dealt.sortWithinPartitions("_part", F.col("versions").isNull(), "site_id", "set_id").select(
        "_part", "set_id", F.col("site_id").cast("bigint"), "is_using", "weight_micro", "n", "versions"
    ), shares


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted lists as bytes: the first version, the width of a step, then the steps to the next ones in as few bytes as they fit."""
    for batch in batches:
        lists = batch.column("versions")
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        ends = ends - ends[0]
        made = []
        for begin, end in zip(ends[:-1], ends[1:]):
            steps = np.diff(flat[begin:end]).view(np.uint64)  # two's complement: also where a step is beyond an int64
            width = np.min_scalar_type(steps.max(initial=0))
            made.append(flat[begin:begin + 1].tobytes() + bytes([width.itemsize]) + steps.astype(width).tobytes())
        yield pa.RecordBatch.from_pydict({"set_id": batch.column("set_id"), "_share": batch.column("_share"), "versions": pa.array(made, pa.binary())})


def _ids(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Version ids of lists in a row, and the length of each; lists may be ``_coded``."""
    if not pa.types.is_binary(lists.type):
        return lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    made = []
    for code in lists:
        code = memoryview(code.as_buffer())
        steps = np.frombuffer(code, f"u{code[8]}", offset=9)
        versions = np.empty(len(steps) + 1, np.int64)
        versions[0] = np.frombuffer(code, np.int64, 1)[0]
        versions[1:] = steps.astype(np.uint64).view(np.int64) if code[8] == 8 else steps
        made.append(np.cumsum(versions, out=versions))
    return np.concatenate(made), np.array(list(map(len, made)))


class _Block:
    """Sets of a block as places in its sorted versions, and a sum for each version."""

    def __init__(self, names: list[pa.Array], lists: list[pa.Array]):
        self.names = pa.chunked_array(names).combine_chunks()
        sizes, some = [], np.empty(0, np.int64)
        for x in lists:  # one at a time: ids are twice as wide as places
            flat, n = _ids(x)
            sizes.append(n)
            some = _distinct(np.concatenate([some, _distinct(flat)]))
        self.versions, sizes = some, np.concatenate(sizes)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.places = np.empty(int(sizes.sum()), np.int32)
        end = 0
        for x in lists:
            flat, _ = _ids(x)
            self.places[end:end + len(flat)] = self._place(flat)
            end += len(flat)
        self.sum = np.zeros(len(self.versions), np.int64)

    def _place(self, versions: np.ndarray) -> np.ndarray:
        least, span = self.versions[0], int(self.versions[-1]) - int(self.versions[0]) + 1
        if span > 8 * len(self.versions) + 1024:
            return np.searchsorted(self.versions, versions).astype(np.int32)
        at = np.empty(span, np.int32)
        at[self.versions - least] = np.arange(len(self.versions), dtype=np.int32)
        return at[versions - least]

    def list_of(self, k: int) -> np.ndarray:
        return self.places[self.starts[k]:self.ends[k]]

    def strongest(self, lists: list[np.ndarray], gains: list[int], limit: int) -> np.ndarray:
        """Places of the ``limit`` versions with the greatest sum of gains; ties go to smaller versions.

        Lists are taken by gain. A version that is only in the last ones, which add up to less than what ``limit`` versions
        have, is not among these; so the last lists are only looked up for versions that they can still lift.
        """
        lists, gains = zip(*sorted(zip(lists, gains), key=lambda x: -x[1]))
        total, split, rest = self.sum, len(lists), 0
        if gains[-1] < 0:
            option = _distinct(np.concatenate(lists))
            self._add(lists, gains)
            strength = total[option]
            self._clear(lists)
            return option[np.argsort(-strength, kind="stable")[:limit]]
        sure = next((gain for at, gain in zip(lists, gains) if len(at) >= limit), 0)
        while split > 1 and rest + gains[split - 1] < sure:
            split -= 1
            rest += gains[split]
        first, last = [at.astype(np.intp) for at in lists[:split]], lists[split:]
        self._add(first, gains)
        # a version in one list only comes behind those before it there, so the first ones stand for these
        some = [at[:limit] for at in first]
        for at, gain in zip(first, gains):
            if len(at) > limit:
                tail = at[limit:]
                some.append(tail[total[tail] > gain])
        option = _distinct(np.concatenate(some))
        strength = total[option]
        if last:
            least = np.partition(strength, len(strength) - limit)[len(strength) - limit]
            alone = [at for at, gain in zip(first, gains) if gain + rest >= least]
            if alone:
                self._add(last, gains[split:])
                option = _distinct(np.concatenate([option, *(self._first_of(at, limit) for at in alone)]))
                strength = total[option]
                self._clear(last)
            else:
                lifted = strength + rest >= least
                option, strength = option[lifted], strength[lifted]
                for at, gain in zip(last, gains[split:]):
                    strength += gain * _held(at, option)
        self._clear(first)
        return option[np.argsort(-strength, kind="stable")[:limit]]

    def _first_of(self, at: np.ndarray, limit: int) -> np.ndarray:
        """The ``limit`` places of a list with the greatest sums, and perhaps more."""
        if len(at) <= limit:
            return at
        total = self.sum[at]
        least = np.partition(total, len(at) - limit)[len(at) - limit]
        return np.concatenate([at[total > least], at[total == least][:limit]])

    def _add(self, lists: Iterable[np.ndarray], gains: Iterable[int]) -> None:
        for at, gain in zip(lists, gains):
            self.sum[at] += gain

    def _clear(self, lists: Iterable[np.ndarray]) -> None:
        for at in lists:
            self.sum[at] = 0

    def held(self, k: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether list ``k`` has the place beside it, all at once."""
        low, high, end = self.starts[k], self.ends[k], self.ends[k]
        for _ in range(int((high - low).max(initial=0)).bit_length()):
            middle = (low + high) >> 1
            before = (self.places[np.minimum(middle, len(self.places) - 1)] < places) & (low < high)
            low, high = np.where(before, middle + 1, low), np.where(before, high, middle)
        return (low < end) & (self.places[np.minimum(low, len(self.places) - 1)] == places)

    def scores(self, k: np.ndarray, values: np.ndarray, opens: np.ndarray, chosen: list[np.ndarray]) -> np.ndarray:
        """One row for each of SCORES, over the ``chosen`` places of sites; lists ``k`` and their ``values`` begin at ``opens`` for each."""
        many = np.diff(np.r_[opens, len(k)])
        n = np.array(list(map(len, chosen)))
        places = np.concatenate(chosen)
        # each place of a site meets each list of the site
        lists = np.repeat(many, n)
        begins = np.cumsum(lists) - lists
        entry = np.repeat(np.repeat(opens, n) - begins, lists) + np.arange(int(lists.sum()))
        own = self.held(k[entry], np.repeat(places, lists))
        return np.add.reduceat(values[:, entry] * own, begins, axis=1)


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted values without repeats; for short arrays much faster than by hash."""
    values = np.sort(values)
    fresh = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=fresh[1:])
    return values[fresh]


def _held(at: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which ``places`` a sorted list has."""
    places = places.astype(at.dtype)
    return at.take(at.searchsorted(places), mode="clip") == places


def _score_blocks(dealt: DataFrame, limit: int | None, positive: int, negative: int) -> DataFrame:
    """Scores of the versions of each site in rows from ``blocks``: the ``limit`` strongest ones, or all of them."""

    def scored(block: _Block, sites: pa.Array, k: np.ndarray, using: np.ndarray, weight: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Scores of whole sites; rows stand by site and list."""
        has = k >= 0  # no version of another set is in this share
        sites, k, using, weight, n = sites.filter(pa.array(has)), k[has], using[has], weight[has], n[has]
        if not len(k):
            return
        opens = _begins(sites)
        of_site = np.zeros(len(k), bool)
        of_site[opens] = True
        first = np.flatnonzero(of_site | np.r_[True, k[1:] != k[:-1]])
        # as in _signed
        signs = ((using != 0).astype(np.int64), np.where(using == 0, 1, np.where(using == BOTH, -1, 0)))
        values = np.add.reduceat(np.stack([x * sign for x in (weight, n) for sign in signs]), first, axis=1)
        names, k, opens = sites.take(pa.array(opens)), k[first], np.searchsorted(first, opens)
        gains = (values[0] * positive + values[1] * negative).tolist()
        ends, places, size, done = np.r_[opens[1:], len(k)], [], 0, 0
        for site, (begin, end) in enumerate(zip(opens.tolist(), ends.tolist())):
            own = [block.list_of(i) for i in k[begin:end]]
            places.append(_distinct(np.concatenate(own)) if limit is None else block.strongest(own, gains[begin:end], limit))
            size += len(places[-1])
            if size >= BLOCK_ROWS or site + 1 == len(opens):
                at = opens[done]
                scores = block.scores(k[at:end], values[:, at:end], opens[done:site + 1] - at, places)
                named = names.slice(done, site + 1 - done).take(pa.array(np.repeat(np.arange(len(places)), list(map(len, places)))))
                columns = {"site_id": named, "version_id": block.versions[np.concatenate(places)], **dict(zip(SCORES, scores))}
                columns["strength_nano"] = scores[0] * positive + scores[1] * negative
                yield pa.RecordBatch.from_pydict({name: pa.array(x) for name, x in columns.items()})
                places, size, done = [], 0, site + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, names, lists = None, None, [], []
        held: list[tuple] = []  # rows of the last site, which may go on

        def joined() -> tuple:
            return pa.concat_arrays([x[0] for x in held]), *(np.concatenate(x) for x in list(zip(*held))[1:])

        for batch in batches:
            parts = batch.column("_part").to_numpy()
            for first, last in runs_of(parts):
                rows = batch.slice(first, last - first)
                if part != parts[first]:
                    if held:
                        yield from scored(block, *joined())
                    part, block, names, lists, held = parts[first], None, [], [], []
                n_sets = rows.num_rows - rows.column("versions").null_count
                if n_sets:
                    names.append(rows.column("set_id").slice(0, n_sets))
                    lists.append(rows.column("versions").slice(0, n_sets))
                rows = rows.slice(n_sets)
                if not rows.num_rows or not names:
                    continue
                if block is None:
                    block = _Block(names, lists)
                    lists = []
                at = pc.fill_null(pc.index_in(rows.column("set_id"), value_set=block.names), -1).to_numpy(zero_copy_only=False)
                flag = pc.fill_null(rows.column("is_using").cast(pa.int8()), BOTH).to_numpy(zero_copy_only=False)
                held.append((rows.column("site_id"), at, flag, *(rows.column(c).to_numpy(zero_copy_only=False) for c in ("weight_micro", "n"))))
                whole = joined()
                cut = int(_begins(whole[0])[-1])
                yield from scored(block, whole[0].slice(0, cut), *(x[:cut] for x in whole[1:]))
                held = [(whole[0].slice(cut), *(x[cut:] for x in whole[1:]))]
        if held:
            yield from scored(block, *joined())

    return dealt.mapInArrow(run, "site_id bigint, version_id bigint, " + "".join(f"{n} bigint, " for n in SCORES) + "strength_nano bigint")


def _begins(sites: pa.Array) -> np.ndarray:
    """Where each site begins; a missing one is a site too."""
    missing, value = sites.is_null().to_numpy(zero_copy_only=False), sites.fill_null(0).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (missing[1:] != missing[:-1])])


def runs_of(keys: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal keys."""
    if not len(keys):
        return []
    begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return list(zip(begins.tolist(), [*begins[1:].tolist(), len(keys)]))


def block_scores(dealt: DataFrame) -> DataFrame:
    """Scores of every ``(site_id, version_id)`` from ``blocks``."""
    return _score_blocks(dealt, None, 0, 0).drop("strength_nano")


def block_tops(dealt: DataFrame, shares: int, limit: int, positive_milli: int, negative_milli: int) -> DataFrame:
    """Scores of the ``limit`` strongest versions of each site from ``blocks``; ties go to smaller versions."""
    found = _score_blocks(dealt, limit, positive_milli, negative_milli)
    if shares == 1:
        return found
    order = W.partitionBy("site_id").orderBy(F.desc("strength_nano"), "version_id")
    return found.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= limit).drop("_rank")


def score_versions(listed: DataFrame) -> DataFrame:
    """Scores of every ``(site_id, version_id)`` from ``with_versions``."""
    using = F.col("is_using")
    # sums of a site are in one task, so this is no shuffle
    unpacked = listed.select("site_id", "is_using", "weight_micro", "n", F.explode("versions").alias("version_id"))
    none = F.lit(0).cast("bigint")
    return unpacked.groupBy("site_id", "version_id").agg(*[
        F.sum(F.when(using if own else ~using, F.col(value)).otherwise(none)).alias(name)
        for name, value, own in zip(SCORES, ("weight_micro", "weight_micro", "n", "n"), (True, False, True, False))
    ])


def _grouped(place: np.ndarray, versions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of entries by place and version, and where each pair begins in it."""
    least, span, n = int(versions.min()), int(versions.max()) - int(versions.min()) + 1, len(versions)
    bits = n.bit_length()
    if (int(place[-1]) + 1) * span < 2 ** (62 - bits):
        packed = np.sort((place * span + (versions - least)) << bits | np.arange(n))  # faster than an order of its own
        order = packed & ((1 << bits) - 1)
        key = packed >> bits
        return order, np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    order = np.lexsort((versions, place))
    place, versions = place[order], versions[order]
    return order, np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (versions[1:] != versions[:-1])])


def _best_of_sites(
    site: np.ndarray, using: np.ndarray, weight: np.ndarray, n: np.ndarray, sizes: np.ndarray, versions: np.ndarray,
    limit: int, positive: int, negative: int,
) -> pa.RecordBatch | None:
    """Scores of the ``limit`` strongest versions of each site; rows of a site stand in a row and have ``sizes`` versions."""
    if not len(versions):
        return None
    row = np.repeat(np.arange(len(site)), sizes)
    place = np.cumsum(np.r_[0, site[1:] != site[:-1]])[row]
    order, first = _grouped(place, versions)
    ends = np.r_[first[1:], len(order)]
    strength = np.add.reduceat((weight * np.where(using, positive, negative))[row][order], first)
    of_site = place[order[first]]
    opens = np.flatnonzero(np.r_[True, of_site[1:] != of_site[:-1]])
    groups = np.diff(np.r_[opens, len(first)])
    left, taken, lowest = strength.copy(), [], np.iinfo(np.int64).min
    for rank in range(limit):
        top = np.where(groups > rank, np.maximum.reduceat(left, opens), lowest + 1)
        best = np.flatnonzero(left == np.repeat(top, groups))
        if not len(best):
            break
        best = best[np.r_[True, of_site[best[1:]] != of_site[best[:-1]]]]  # the smallest version
        taken.append(best)
        left[best] = lowest
    at = np.sort(np.concatenate(taken))
    # single scores of the chosen only
    many = ends[at] - first[at]
    starts = np.cumsum(many) - many
    entry = order[np.repeat(first[at] - starts, many) + np.arange(int(many.sum()))]
    own = row[entry]
    parts = [np.where(flag, value, 0)[own] for value, flag in ((weight, using), (weight, ~using), (n, using), (n, ~using))]
    scores = np.add.reduceat(np.stack(parts), starts, axis=1)
    chosen = order[first[at]]
    columns = {"site_id": site[row[chosen]], "version_id": versions[chosen], **dict(zip(SCORES, scores)), "strength_nano": strength[at]}
    return pa.RecordBatch.from_pydict({name: pa.array(x) for name, x in columns.items()})


def top_scores(listed: DataFrame, limit: int, positive_milli: int, negative_milli: int) -> DataFrame:
    """Scores of the ``limit`` strongest versions of each site from ``with_versions``; ties go to smaller versions.

    A site is summed up and cut in one pass over its rows; no row per site and version leaves the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def best(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            found = _best_of_sites(*rows, limit, positive_milli, negative_milli)
            if found is not None:
                yield found

        for batch in batches:
            numbers = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("site_id", "is_using", "weight_micro", "n")]
            lists = batch.column("versions")
            held.append((*numbers, np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)))
            *rows, versions = (np.concatenate(x) for x in zip(*held))
            last = int(np.argmax(rows[0] == rows[0][-1]))  # the last site may go on; it has each set twice at most
            cut = int(rows[4][:last].sum())
            held = [(*(x[last:] for x in rows), versions[cut:])]
            yield from best((*(x[:last] for x in rows), versions[:cut]))
        if held:
            yield from best(held[0])

    rows = listed.select(F.col("site_id").cast("bigint"), "is_using", "weight_micro", "n", F.col("versions").cast("array<bigint>"))
    return rows.mapInArrow(run, "site_id bigint, version_id bigint, " + "".join(f"{n} bigint, " for n in SCORES) + "strength_nano bigint")
