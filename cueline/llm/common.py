"""Shared helpers: staged tables in the cluster's shared folder, word rules, batch limits."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows and bytes in one Arrow batch: they bound what a Python worker holds at once (a longer row is a batch of its own).
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent (local tests) a temporary folder of this process is set and
    removed at exit.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="cueline-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found := f"file://{own}")
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cueline/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Staged:
    """A table written to the shared folder: it survives lost executors and cuts lineage."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = fresh_path(self.spark, name)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        delete_path(self.spark, self.path)


def forget_finished(spark: SparkSession) -> None:
    """Have the driver look for broadcasts and shuffles that nothing refers to: Spark removes them from the executors only then.

    A driver whose heap is seldom full collects seldom, and its executors keep what finished queries sent them.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shrink_heaps(spark: SparkSession) -> None:
    """Have the executors collect their heaps, so that the JVMs return what an earlier stage grew them by.

    JVM and Python workers share an executor's memory, and a grown heap is not given back before a full collection. Tasks that only
    ask for one are dealt over the cluster's cores; an executor that gets none keeps its heap, and no result hangs on it.
    """
    forget_finished(spark)
    tasks = 2 * spark.sparkContext.defaultParallelism
    asked = spark.range(0, tasks, 1, tasks).select(F.expr("java_method('java.lang.System', 'gc')").alias("asked"))
    asked.write.format("noop").mode("overwrite").save()


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch sizes, in rows and bytes, so that long texts do not pile up in a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def with_row_id(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with an identity of their own (hash of the file, and row number in it), and its column's name, with which no other column's begins.

    Rows that come straight from files have it without a copy, the same however often and in whatever splits they are read. Others
    are written to the shared folder first.
    """
    name = "row_id"
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"

    def marked(df: DataFrame) -> DataFrame:
        of = df.metadataColumn("_metadata")
        return df.withColumn(name, F.struct(F.xxhash64(of["file_path"]).alias("file"), of["row_index"].alias("row")))

    try:
        return marked(docs), name
    except AnalysisException:
        return marked(Staged(docs, "rows").df), name


#: Rows of a narrow table (some 50 bytes each) up to which it is broadcast.
BROADCAST_ROWS = 1_000_000


def small_side(table: DataFrame) -> DataFrame:
    """A written narrow table, to be broadcast if its rows are few enough; beyond that Spark joins it by an exchange."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def without_rows(rows: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """The rows of ``with_row_id`` whose identity is not in ``gone`` (its one column), without their identity."""
    out = Staged(gone.select(F.col(gone.columns[0]).alias(f"{row}_gone")), "gone").df
    return rows.join(small_side(out), F.col(row) == F.col(f"{row}_gone"), "left_anti").drop(row)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; ASCII texts take the fast path of ``lower``."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, ASCII_UPPER, ASCII_LOWER)
    )


_kept: dict[str, dict] = {}


def give_back() -> None:
    """Return to the system what this process has freed but still holds."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def kept_for(operator: str) -> dict:
    """What this process keeps between tasks for one operator.

    Python workers are reused by the tasks of other operators: what those kept is let go and given back to the system first, so
    that an executor never holds the caches of two operators.
    """
    if operator not in _kept:
        _kept.clear()
        give_back()
        _kept[operator] = {}
    return _kept[operator]


def returning(scan: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a task's batches, whose worker gives its free memory back at the task's end: idle workers wait beside busy ones.

    Batches come from the system's allocator, which gives back at ``give_back`` what Arrow's own pool would hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from scan(batches)
        finally:
            give_back()

    return run


def single_threaded() -> None:
    """Executors own their cores: native libraries in a worker stay at one thread."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
