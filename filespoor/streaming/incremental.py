"""Resumable work as file streams: every input file is processed once.

Both jobs run until the input is used up and then stop. A batch that is repeated after a
failure writes the same rows again, because what is stored already is left out.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from filespoor.operators import build
from filespoor.plans.index_build import build_from_checksums, fingerprinted_files, update_index
from filespoor.session import Workspace
from filespoor.sources.index_store import Index, empty_index, read_index, write_index
from filespoor.sources.scan_results import append_results, check_identifier
from filespoor.streaming.settling import settled


def _run(source: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    query = (
        source.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def incremental_scan(
    source: DataFrame,
    scan: Callable[[DataFrame], DataFrame],
    results_path: str,
    checkpoint: str,
    identifier: str,
) -> None:
    """Scan the sites of a stream of crawl rows.

    ``scan`` turns the rows of one batch into ``(url, scan_time, result)``. All rows of a
    site have to arrive in one batch; ``settled_scan`` does without that. Sites with a stored result are skipped.
    """
    check_identifier(identifier)

    def handle(batch: DataFrame, _: int) -> None:
        append_results(scan(batch).withColumn("scan_identifier", F.lit(identifier)), results_path)

    _run(source, checkpoint, handle)


def settled_scan(
    source: DataFrame,
    site: str,
    time: str,
    quiet_seconds: int,
    scan: Callable[[DataFrame], DataFrame],
    results_path: str,
    checkpoint: str,
    identifier: str,
    workspace: Workspace,
) -> None:
    """``incremental_scan`` of sites whose rows may come in several batches.

    Rows wait as state until their ``site`` was quiet for ``quiet_seconds`` of ``time``, see ``settled``; what is not due when
    the input is used up waits for the next run with the same ``checkpoint``. Due rows are written before they are scanned,
    so that state is read once a batch.
    """
    check_identifier(identifier)

    def handle(batch: DataFrame, _: int) -> None:
        due = workspace.save(batch, "due")
        if not due.isEmpty():
            append_results(scan(due).withColumn("scan_identifier", F.lit(identifier)), results_path)

    _run(settled(source, site, time, quiet_seconds), checkpoint, handle)


def incremental_index(
    source: DataFrame,
    fingerprint: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
) -> None:
    """Fingerprint a stream of release files into ``path``.

    ``fingerprint`` turns the files of one batch into rows with a ``version_id``. All
    files of a version have to arrive in one batch; versions that are stored already, by
    earlier batches or other streams, are not indexed again. The rows of a batch have a
    folder of their own, by stream and batch, that a repeated batch replaces.
    """
    stream = _stream_id(checkpoint)

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = fingerprint(batch)
        stored = T.StructType([*rows.schema, T.StructField("stream", T.StringType()), T.StructField("batch", T.LongType())])
        spark.createDataFrame([], stored).write.mode("append").partitionBy("stream", "batch").parquet(path)
        own = (F.col("stream") == stream) & (F.col("batch") == number)
        done = spark.read.schema(stored).parquet(path).filter(~own).select("version_id").distinct()
        fresh = rows.join(done, "version_id", "left_anti").select(*rows.columns)
        fresh.write.mode("overwrite").parquet(f"{path}/stream={stream}/batch={number}")

    _run(source, checkpoint, handle)


_SNAPSHOT = T.StructType([
    T.StructField("sequence", T.LongType()), T.StructField("snapshot", T.StringType()),
    T.StructField("stream", T.StringType()), T.StructField("batch", T.LongType()),
])


def _folder(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _snapshots(spark: SparkSession, path: str) -> DataFrame:
    """The log of finished snapshots, one file each; a new one starts empty."""
    folder, files = _folder(spark, f"{path}/log")
    files.mkdirs(folder)
    return spark.read.schema(_SNAPSHOT).json(f"{path}/log")


def log_snapshot(spark: SparkSession, path: str, entry: tuple[int, str, str, int]) -> bool:
    """Log a finished snapshot; False if its sequence number has been taken meanwhile.

    The entry is written beside the log and moved in whole; the move fails where there is one already. That is atomic on
    file systems that rename atomically, as HDFS does; on others one stream at a time may write to ``path``.
    """
    jvm = spark._jvm
    source, files = _folder(spark, f"{path}/pending/{uuid.uuid4().hex}")
    target, _ = _folder(spark, f"{path}/log/{entry[0]:012d}.json")
    out = files.create(source)
    out.write(bytearray(json.dumps(dict(zip(_SNAPSHOT.names, entry))).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    mode = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    mode[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(source, target, mode)
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        files.delete(source, False)
        return False
    return True


def latest_index(spark: SparkSession, path: str) -> Index:
    """The index of the last finished snapshot."""
    last = _snapshots(spark, path).orderBy(F.desc("sequence")).first()
    return read_index(spark, last.snapshot) if last else empty_index(spark)


def _extend(spark: SparkSession, path: str, stream: str, number: int, write: Callable[[str | None, str], object]) -> None:
    """Write the snapshot of a batch on top of the last one, once.

    ``write(old, new)`` makes the snapshot. Where another stream was faster it is made again on top of that one's, so
    none is lost.
    """
    while True:
        log = _snapshots(spark, path)
        if not log.filter((F.col("stream") == stream) & (F.col("batch") == number)).isEmpty():
            return
        last = log.orderBy(F.desc("sequence")).first()
        target = f"{path}/snapshots/{uuid.uuid4().hex}"
        write(last.snapshot if last else None, target)
        if log_snapshot(spark, path, (last.sequence + 1 if last else 0, target, stream, number)):
            return


def _stream_id(checkpoint: str) -> str:
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def incremental_snapshots(
    source: DataFrame, definitions: DataFrame, available: DataFrame, path: str, checkpoint: str
) -> None:
    """Extend an index by a stream of release files, one snapshot per batch.

    A snapshot gets a folder of its own and counts once it is logged; a batch that is
    repeated after that adds nothing. All files of a version have to arrive in one batch; ``settled_index`` does without that.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        _extend(
            spark, path, _stream_id(checkpoint), number,
            lambda old, new: update_index(spark, old, new, definitions, available, batch),
        )

    _run(source, checkpoint, handle)


def settled_index(
    source: DataFrame,
    time: str,
    quiet_seconds: int,
    definitions: DataFrame,
    available: DataFrame,
    path: str,
    checkpoint: str,
    workspace: Workspace,
    raw: bool = False,
    **kinds,
) -> None:
    """``incremental_snapshots`` of versions whose files may come in several batches.

    Files ``(package, version, path, content)`` with a ``time`` are fingerprinted as they come; only their checksums wait as
    state, until the version was quiet for ``quiet_seconds``, see ``settled``. A row with null ``package`` moves the clock.
    Several streams may write to ``path``; each version has to come by one of them.
    """
    key = ["package", "version"]
    files = fingerprinted_files(source, definitions, raw, **kinds).select(*key, *build.FILE_KEY, time)
    # ignored files tell that their version has come
    nulls = [F.lit(None).cast(files.schema[name].dataType).alias(name) for name in build.FILE_KEY]
    rows = files.unionByName(source.select(*key, *nulls, time)).withColumn(
        "release", F.when(F.col("package").isNotNull(), F.to_json(F.struct(*key)))
    )

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        due = workspace.save(batch, "due")
        if due.isEmpty():
            return

        def write(old: str | None, new: str) -> None:
            current = read_index(spark, old) if old else empty_index(spark)
            write_index(build_from_checksums(current, definitions, available, due, workspace), new)

        _extend(spark, path, _stream_id(checkpoint), number, write)

    _run(settled(rows, "release", time, quiet_seconds), checkpoint, handle)
