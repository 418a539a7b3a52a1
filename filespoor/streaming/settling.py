"""Groups of a stream whose rows come in several batches: kept as state until no more are expected."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Gather(StatefulProcessor):
    """Appends rows to a group's list and gives the list out when the group's timer is due."""

    def __init__(self, schema: T.StructType, quiet_ms: int):
        self.schema, self.quiet_ms = schema, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.schema)
        self.due = handle.getValueState("due", "ms bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        if key[0] is None:  # moves the clock only
            return iter([])
        came, last = [], 0
        for row in rows:
            came.append(tuple(row[name] for name in self.schema.names))
            last = max(last, row["_ms"])
        self.rows.appendList(came)
        before = self.due.get()[0] if self.due.exists() else None
        due = last + self.quiet_ms
        if before is None or due > before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
            self.due.update((due,))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        for row in self.rows.get():
            yield Row(**dict(zip(self.schema.names, row)))
        self.rows.clear()
        self.due.clear()


def clock_row(rows: DataFrame, time: str, seconds: int) -> DataFrame:
    """One row like ``rows`` that belongs to no key and moves the clock to ``seconds`` since 1970."""
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != time]
    row = rows.sparkSession.range(1).select(F.timestamp_seconds(F.lit(seconds)).alias(time), *nulls)
    return row.select(*rows.columns)


def settled(source: DataFrame, key: str, time: str, quiet_seconds: int) -> DataFrame:
    """The rows of ``source``, all rows of a ``key`` in one batch, once it was quiet for ``quiet_seconds``.

    The clock is the latest ``time`` (timestamp) of the stream less ``quiet_seconds``; a key is due when the clock passes its
    last row by as much. A row with null key belongs to none and only moves the clock: one far ahead, at the end of a
    crawl, makes all keys due. Rows that come with a time before the clock of the batch before, or 1970, are left out; a key of which all rows are so late
    never comes out, so its site stays unscanned and comes with the next run. State is as large as the rows of keys
    not yet due: project away what is not needed, and fingerprint bodies, before.
    """
    source.sparkSession.conf.set(_STORE, _ROCKSDB)
    timed = source.withColumn("_ms", F.unix_millis(time)).withWatermark(time, f"{quiet_seconds} seconds")
    gather = _Gather(source.schema, 1000 * quiet_seconds)
    return timed.groupBy(key).transformWithState(gather, source.schema, "append", "eventTime")
