"""Shared intermediate tables and row keys."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from collections.abc import Callable

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in an Arrow batch handed to Python, so that long texts stay within a worker's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="atlasq-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    """Delete a folder; one that is gone already, or whose session has ended, is left to its owner."""
    if spark.sparkContext._jsc is None:
        return
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except (Py4JError, OSError):  # the JVM may be gone at exit
        pass


def temporary(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one, deleted when the Python process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/atlasq-{label}-{uuid.uuid4().hex}"
    atexit.register(_at_exit, spark, path)
    return path


#: Half seconds that release() waits for Python's dropped objects at most; what isn't dropped then goes the next time.
RELEASE_WAITS = 10
#: Written tables by folder, with a weak reference to the file index that all plans over the table share.
_readers: dict[str, JavaObject] = {}


def release(spark: SparkSession) -> list[str]:
    """Delete the written tables that no plan reads any more; returns their folders.

    A plan holds the file index of each table it reads, and a DataFrame, or one derived from it, holds its plan;
    the index is only collected when all of them are gone. So a lazy result keeps its tables, however many
    results are alive at once, and an RDD taken from a DataFrame needs that DataFrame to be kept.
    """
    jvm = spark.sparkContext._jvm
    gc.collect()
    # what Python drops is released in the JVM by a thread that looks about once a second, in order; so this object goes last
    last = jvm.java.lang.ref.WeakReference(jvm.java.lang.Object())
    for _ in range(RELEASE_WAITS):
        time.sleep(0.5)
        jvm.System.gc()
        if last.get() is None:
            break
    gone = [path for path, index in _readers.items() if index.get() is None]
    for path in gone:
        del _readers[path]
        _delete(spark, path)
    return gone


def stage(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs) as a stage of a pipeline. Tables that nothing reads any more go before it, as do, after it, those that its result doesn't read."""
    release(docs.sparkSession)
    out = work(docs)
    release(docs.sparkSession)
    return out


def materialize(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = temporary(spark, label)
    df.write.option("compression", compression).parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    index = written._jdf.queryExecution().analyzed().collectLeaves().apply(0).relation().location()
    _readers[path] = spark.sparkContext._jvm.java.lang.ref.WeakReference(index)
    return written


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session's Python stages."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def with_row_id(df: DataFrame, name: str = "_rid") -> DataFrame:
    """Number the rows within one job. Another scan, cut for another number of cores, gives other numbers: see keyed()."""
    return df.withColumn(name, F.monotonically_increasing_id())


def keyed(df: DataFrame, label: str, name: str = "_rid") -> DataFrame:
    """df with numbered rows, written once. What is joined by the number in later jobs reads this copy, not df again."""
    return materialize(with_row_id(df, name), label, "zstd")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def bounded_sample(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """At most so many rows: all of a small table, else those whose hash of keys lies below a share of all hashes.

    Spread over the whole table and alike on every run; unlike a sort with a limit, no task hands over a full sample of its own.
    """
    n = df.count()
    if n <= most:
        return df
    cut = int(0.85 * most / n * (1 << 64)) - (1 << 63)
    return df.where(F.xxhash64(*keys) < F.lit(cut)).limit(most)


def bounded_runs(texts: DataFrame, most: int, chars: int, *keys: str) -> DataFrame:
    """text: at most so many runs of so many characters of all texts, which are cut at equal distances, so that a long text has as many more.

    Runs are chosen by a hash of keys and their place, alike on every run and spread over the whole table.
    """
    runs = texts.where("length(text) > 0").withColumn("_run", F.explode(F.sequence(F.lit(0), F.expr(f"cast((length(text) - 1) div {chars} as int)"))))
    n = texts.agg(F.sum(F.expr(f"(length(text) + {chars} - 1) div {chars}"))).first()[0] or 0
    if n > most:
        runs = runs.where(F.xxhash64(*keys, "_run") < F.lit(int(0.85 * most / n * (1 << 64)) - (1 << 63)))
    return runs.select(F.substring(F.col("text"), F.col("_run") * chars + 1, F.lit(chars)).alias("text")).limit(most)


#: Bytes of a table's files for each of its buckets.
BUCKET_BYTES = 16 << 20


def buckets(df: DataFrame, factor: int = 2) -> int:
    """How many buckets df's rows are dealt to: by its size where the plan knows it, at least factor for each shuffle partition."""
    spark = df.sparkSession
    least = max(1, factor * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, size // BUCKET_BYTES if size < 1 << 60 else 0)


def text_of(docs: DataFrame, *more: Column) -> DataFrame:
    """documents as doc_id bigint and text string, and what more asks for; other columns are left out, whatever their names."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
