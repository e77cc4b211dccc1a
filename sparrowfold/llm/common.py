"""What the operators of this subpackage share: workspaces, file access, partition counts, table reading."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import math
import os
import tempfile
import threading
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of scanned input that one shuffle partition is planned to hold.
PARTITION_BYTES = 96 << 20
#: Rows of a few numbers each up to which a side of a join is broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000

#: Bytes that a writer gathers in the JVM's heap before it writes them out.
ROW_GROUP = 16 << 20
#: Spark's settings while a table is saved: an execution removes its own shuffle files at its end, and rows go to Python
#: in batches that stay small even for long texts.
BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "2500"
SAVING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", BATCH: ROWS}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(spark: SparkSession, rows: str = ROWS) -> None:
    """So many rows go to Python at a time from now on, unless the session has another number than Spark's or ROWS:
    whole texts are long, and what a batch takes beside the JVM's heap isn't given back."""
    if spark.conf.get(BATCH) in ("10000", ROWS):
        spark.conf.set(BATCH, rows)


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one in local mode, else one in the warehouse."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if not root:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get().rstrip("/")
        local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        root = "file://" + tempfile.mkdtemp(prefix="sparrowfold-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_sparrowfold"
        sc.setCheckpointDir(root)
        return sc._jsc.sc().getCheckpointDir().get().rstrip("/")
    return root.rstrip("/")


class Workspace:
    """A folder of its own under the shared root. Tables saved here cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._leave)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, **options) -> DataFrame:
        """df as a table; the shuffle files that made it go as soon as it stands, since nothing reads them again."""
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in SAVING}
        fewer = 0 < int(before[BATCH] or 0) < int(ROWS)
        for k, v in SAVING.items():
            if k != BATCH or not fewer:
                conf.set(k, v)
        try:
            df.write.mode("overwrite").options(**{"compression": "zstd", "parquet.block.size": ROW_GROUP, **options}).parquet(self.path(name))
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _leave(self) -> None:
        with contextlib.suppress(Exception):
            self.drop()


def partitions_for(df: DataFrame, bytes_each: int = PARTITION_BYTES) -> int:
    """Shuffle partitions for df's rows: the session's number, or more where the plan's size estimate asks for it."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, min(1_000_000, math.ceil(size / bytes_each))) if size < 1 << 58 else least


def small(rows: DataFrame) -> DataFrame:
    """rows, marked for broadcast if their count is within BROADCAST_ROWS."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


#: Seconds after which a retired worker ends, if it gets no more work, and for which the driver waits for that.
LEAVE, WAIT = 3.0, 4.0
_TIMER: list = []


def _leave(batches):
    while _TIMER:
        _TIMER.pop().cancel()
    for _ in batches:
        time.sleep(0.05)
    _TIMER.append(threading.Timer(LEAVE, os._exit, (0,)))
    _TIMER[0].daemon = True
    _TIMER[0].start()
    return iter(())


def retire_workers(spark: SparkSession) -> None:
    """Python workers that idle on the executors end, and what they hold goes back to the system; later tasks get new ones.

    Between the stages of a long job, so that the memory of one stage's workers isn't held beside the next one's. For
    when nothing else runs Python in this application: a task that gets such a worker is tried again. Nothing is done
    in local mode, where tasks are not tried again.
    """
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        return
    # idle workers are taken in turn, and a stage with several Python steps leaves more than one for each core
    tasks = 4 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).mapInArrow(_leave, "id long").write.format("noop").mode("overwrite").save()
    time.sleep(WAIT)


_HELD: dict = {}


def held(kind, make=None):
    """What a worker process keeps between tasks, such as encoded words: of one kind at a time, since the processes of
    all operators outlive them. What another kind held is given back to the system. Without make, only that is done."""
    if kind not in _HELD:
        _HELD.clear()
        _HELD[kind] = make() if make else None
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(Exception):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)
    return _HELD[kind]


def file_system(uri: str):
    """pyarrow's file system and path for a URI, for executors: any store that pyarrow reaches."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, chunks) -> None:
    """Writes chunks to a name of this attempt's own, then moves it into place, so a repeated task leaves one whole file."""
    store, path = file_system(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        for chunk in chunks:
            out.write(chunk)
    try:
        store.move(draft, path)
    except OSError:
        # some stores don't replace; an earlier attempt of the same task has left the same bytes there
        if not store.get_file_info(path).is_file:
            raise
        store.delete_file(draft)


def get_range(uri: str, start: int | None = None, length: int | None = None) -> bytes:
    """Bytes of a file: all, or length from start (from the end, if start is negative)."""
    store, path = file_system(uri)
    with store.open_input_file(path) as f:
        if start is None:
            return f.read()
        f.seek(start if start >= 0 else f.size() + start)
        return f.read(length)


def crc_mod(column: str, n: int):
    """crc32 of the column's decimal text, modulo n; null for null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))
