"""Small helpers that the operators share: text buffers, shared folders, let-binding."""

import ctypes
import gc
import posixpath
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(values: Column, block: int = 256) -> Column:
    """0 and the sums of the first 1, 2, ... values.  Sums are folded in blocks, then over the blocks, so that no fold
    copies an array longer than its block and the work grows with the length."""

    def fold(numbers: Column) -> Column:
        return F.aggregate(numbers, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def in_blocks(v: Column, width: int) -> Column:
        """Arrays of `width` values, by index."""
        last = F.ceil(F.size(v) / F.lit(width)).cast("int") - 1
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.transform(F.sequence(k * width, F.least(k * width + width, F.size(v)) - 1), lambda i: v[i].cast("long")))

    def spread(sums: Column, width: int, whole) -> Column:
        """Sums within blocks, each raised by what whole(totals) puts before its block."""
        before = whole(F.transform(sums, lambda s: F.element_at(s, -1)))
        lifted = let(before, lambda b: F.transform(sums, lambda s, k: F.transform(F.sequence(F.lit(0), F.size(s) - 2), lambda i: s[i] + b[k])))
        return F.concat(F.flatten(lifted), let(before, lambda b: F.array(F.element_at(b, -1))))

    def levels(v: Column, depth: int) -> Column:
        if not depth:
            return fold(v)
        return let(F.transform(in_blocks(v, block), fold), lambda sums: spread(sums, block, lambda totals: let(totals, lambda t: levels(t, depth - 1))))

    return let(values, lambda v: F.when(F.size(v) == 0, F.array(F.lit(0).cast("long"))).when(F.size(v) <= block, fold(F.transform(v, lambda x: x.cast("long")))).otherwise(levels(v, 1)))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder of the cluster (spark.checkpoint.dir)."""
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return posixpath.join(base.rstrip("/"), f"{name}-{uuid.uuid4().hex}")


def store_of(folder: str):
    """File system and path of a folder, for tasks that write files of their own."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (fs.LocalFileSystem(), folder)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's folder; set one only where none is set (local tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "/tmp/spark-checkpoints")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to_ = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that `written` made, once nothing lazy reads them any more."""
    for table in tables:
        spark, path = table.sparkSession, table.written_to_
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def slices(df: DataFrame) -> int:
    """Number of partitions that a repartition by key should use."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver's collector find finished plans now, not at its next periodic turn, so
    that Spark's cleaner deletes their shuffle files on the executors."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(df: DataFrame, rows: int = 2048, size: int = 4 << 20) -> DataFrame:
    """Bound what a Python worker gets at once: the session's Arrow batches take at most
    `rows` rows and about `size` bytes (a longer row is a batch of its own)."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = conf.get(key, str(most))
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


def giving_back(batches):
    """The batches; at their end the worker, which waits for its next task, gives the memory that it no longer needs back to the system."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], (off - off[0]).astype(np.int64)


def row_chunks(offsets: np.ndarray, most: int = 1 << 20):
    """Row ranges of at most `most` bytes each; a longer row is a range of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end
        at = end


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.large_binary()).cast(pa.binary())
