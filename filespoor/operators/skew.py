"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F

HOT_ROWS = 1_000_000
# rows of a table that are sent to all tasks; of two numbers each, and with texts
NEAR_PAIRS = 2_000_000
NEAR_ROWS = 300_000
SALTS = 64


def hot_keys(rows: DataFrame, on: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows; rows are counted with a map-side combine."""
    return counted_hot_keys(rows, on, hot_rows).select(*on)


def counted_hot_keys(rows: DataFrame, on: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Hot keys with ``_parts``, the number of shares of about ``hot_rows`` rows that each is worth."""
    counted = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > hot_rows)
    return counted.select(*on, F.ceil(F.col("_rows") / hot_rows).cast("int").alias("_parts"))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "inner",
    hot: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join ``left`` to ``right`` on ``on``, spreading keys that are hot in ``left``.

    Rows of ``left`` with a hot key are spread over as many sub-keys as they are worth,
    and the rows of ``right`` with such a key are repeated once per sub-key; all other
    rows keep sub-key 0. Every pair of the plain join appears exactly once. NULL keys
    match nothing, as in a plain join, and are spread over ``salts`` sub-keys. ``hot`` are
    the hot keys if they are known; each then gets ``salts`` sub-keys.

    The table of hot keys is broadcast: it has at most ``rows(left) / hot_rows`` rows,
    a million keys for 10**12 rows.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    keys = counted_hot_keys(left, on, hot_rows) if hot is None else hot.select(*on, F.lit(salts).alias("_parts"))
    marked = F.broadcast(keys)
    shares = F.coalesce("_parts", F.lit(salts))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), shares).cast("int")
    no_key = reduce(or_, [F.col(c).isNull() for c in on])
    salted_left = (
        left.join(marked, on, "left")
        .withColumn("_salt", F.when(F.col("_parts").isNotNull() | no_key, spread).otherwise(F.lit(0)))
        .drop("_parts")
    )
    salted_right = (
        right.join(marked, on, "left")
        .withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts") - 1, F.lit(0))))
        )
        .drop("_parts")
    )
    return salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")


def near(right: DataFrame, rows: int) -> Callable[..., DataFrame]:
    """The join for a ``right`` side, or parts of it: of up to ``rows`` rows, counted here, it is sent to all tasks, so the left side is
    neither counted nor shuffled; else ``salted_join``."""
    if right.count() > rows:
        return salted_join

    def join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
        return left.join(F.broadcast(right), on, how)

    return join


def dealt_by(rows: DataFrame, key: str) -> DataFrame:
    """Few rows that make very many, dealt to told tasks by ``key``: what is made of them by broadcasts is grouped by it without a shuffle."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), key)


def expanding_join(left: DataFrame, right: DataFrame, on: list[str], share: int = 100) -> DataFrame:
    """Inner join of few rows that makes very many: about ``share`` rows of ``left`` with a key meet all its rows of ``right`` in one task.

    Adaptive execution puts small inputs into few tasks, however many rows come out; so tasks are told here.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(counted_hot_keys(left, on, share))
    parts, spread = F.coalesce("_parts", F.lit(1)), F.xxhash64(*[F.col(f"`{c}`") for c in left.columns])
    dealt = left.join(hot, on, "left").withColumn("_salt", F.pmod(spread, parts).cast("int")).drop("_parts")
    copies = right.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    key = [*on, "_salt"]
    return dealt.repartition(tasks, *key).join(copies.repartition(tasks, *key), key).drop("_salt")
