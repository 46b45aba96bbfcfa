"""Importance resampling of documents: a target and a raw model of hashed word n-grams, and Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytesops as B
from .store import bounded_sample, materialize, small_batches, text_of

#: Buckets of hashed words and word pairs.
FEATURES = 1 << 13
#: The target model is fitted on at most so many labelled documents (chosen by a hash of doc_id).
TARGET_DOCS = 20_000
#: Share of rows kept where no label tells it.
DEFAULT_SHARE = 0.5
KEY_BITS, STEP_BITS = 64, 13
#: Tasks that add up the others' counts.
ADDERS = 16


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a piece's words and word pairs (lower case, A-Z), and the document of each."""
    low = B.LOWER[data]
    start, end, first = B.words(low, at)
    word = B.span_hash(B.prefix_hash(low), start, end)
    of = np.repeat(np.arange(len(at) - 1), np.diff(first))
    pair = B.shingle_hashes(word, 2)
    whole = of[1:] == of[:-1] if len(of) > 1 else np.zeros(0, bool)
    key = np.concatenate([word, pair[whole]])
    return (key % np.uint64(FEATURES)).astype(np.int64), np.concatenate([of, of[:-1][whole]]) if len(of) else of


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 0) -> DataFrame:
    """doc_id, n_features, log_ratio, sample_key, kept for each row of docs.

    The raw model counts all documents, the target model those labelled quality 1. A document's
    log_ratio is the logarithm of its probability under the target model over that under the raw one;
    a Gumbel variate from a hash of doc_id, text and, among rows equal in both, a number is added, and
    the rows with the largest sums are kept: share of all rows, by default the share of quality 1 among
    the labels. Keeping the largest of such sums draws without replacement in proportion to the ratios,
    and the draw is the same however the rows are laid out. Rows equal to the last one kept are kept too
    (ties). A null, empty or blank text has no features and log_ratio 0; a very long one is counted as a
    whole. Repeated rows draw their own variates; a null doc_id is kept. Other columns play no part. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = text_of(docs)
    marks = labels.where("doc_id is not null and quality is not null")
    told = marks.agg(F.count("*").alias("n"), F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good")).first()
    if share is None:
        share = told["good"] / told["n"] if told["n"] else DEFAULT_SHARE
    good = bounded_sample(marks.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), TARGET_DOCS, "doc_id").collect()
    wanted = spark.sparkContext.broadcast(np.sort(np.array([r["doc_id"] for r in good], np.int64)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, FEATURES), np.int64)
        ids = wanted.value
        for batch in batches:
            doc_id = batch.column("doc_id").fill_null(-(1 << 62)).to_numpy()
            for i, j, data, at in B.pieces(batch.column("text")):
                bucket, of = features(data, at)
                own = np.isin(doc_id[i:j], ids)
                total[0] += np.bincount(bucket, minlength=FEATURES)
                total[1] += np.bincount(bucket[own[of]], minlength=FEATURES)
        if total.any():
            yield pa.RecordBatch.from_arrays([B.binary_array([total.tobytes()])], ["counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, FEATURES), np.int64)
        for batch in batches:
            for counts in batch.column("counts").to_pylist():
                total += np.frombuffer(counts, np.int64).reshape(2, FEATURES)
        if total.any():
            yield pa.RecordBatch.from_arrays([B.binary_array([total.tobytes()])], ["counts"])

    # a task's counts are one row; the sums of ADDERS tasks reach the driver
    counted = rows.mapInArrow(count, "counts binary").repartition(ADDERS).mapInArrow(added, "counts binary").collect()
    raw, target = np.ones(FEATURES), np.ones(FEATURES)
    for r in counted:
        own = np.frombuffer(bytes(r["counts"]), np.int64).reshape(2, FEATURES)
        raw += own[0]
        target += own[1]
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in B.pieces(batch.column("text")):
                bucket, of = features(data, at)
                log_ratio = np.bincount(of, weights=ratio[bucket], minlength=j - i).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("doc_id", "t", "part")), pa.array(np.bincount(of, minlength=j - i), pa.int64()), pa.array(log_ratio)], ["doc_id", "t", "part", "n_features", "log_ratio"])

    told_apart = rows.withColumns({"t": F.xxhash64("text"), "part": F.spark_partition_id()})
    slim = materialize(told_apart.mapInArrow(weigh, "doc_id long, t long, part int, n_features long, log_ratio double"), "ratios")
    # equal rows are numbered by part and within it, so that no task has all of a large group
    same = ["doc_id", "t", "part"]
    inner = F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0)))
    parts = slim.groupBy(*same).count()
    before = F.sum("count").over(Window.partitionBy("doc_id", "t").orderBy("part")) - F.col("count")
    parts = parts.withColumn("before", before).where("before > 0").select(*(F.col(c).alias(f"p_{c}") for c in same), "before")
    on = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in same]
    numbered = slim.withColumn("i", inner).join(parts, on, "left").withColumn("i", F.col("i") + F.coalesce("before", F.lit(0)))
    draw = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "t", F.col("i").cast("long"), F.lit(seed).cast("long"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uniform = (batch.column("draw").to_numpy().view(np.uint64) >> np.uint64(11)).astype(np.float64) / (1 << 53)
            key = batch.column("log_ratio").to_numpy() - np.log(-np.log(np.clip(uniform, 1e-300, 1 - 1e-16)))
            bits = key.view(np.int64)
            bits = np.where(bits >= 0, bits, bits ^ np.int64(0x7FFFFFFFFFFFFFFF))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_features", "log_ratio")), pa.array(key), pa.array(bits)], ["doc_id", "n_features", "log_ratio", "sample_key", "bits"])

    drawn = numbered.select("doc_id", "n_features", "log_ratio", draw.alias("draw"))
    weighed = materialize(drawn.mapInArrow(keyed, "doc_id long, n_features long, log_ratio double, sample_key double, bits long"), "weights")
    n = weighed.count()
    cut = kth_largest(weighed, "bits", round(share * n))
    return weighed.select("doc_id", "n_features", "log_ratio", "sample_key", (F.col("bits") >= cut if cut is not None else F.lit(False)).alias("kept"))


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a long column, by histograms of ever finer bits; at most 2**STEP_BITS rows reach the driver at a time."""
    if k <= 0:
        return None
    # from signed to unsigned order
    u = F.col(column).bitwiseXOR(F.lit(-(1 << 63)))
    prefix, done = 0, 0
    while done < KEY_BITS:
        bits = min(STEP_BITS, KEY_BITS - done)
        inside = df.where(F.shiftrightunsigned(u, KEY_BITS - done) == prefix) if done else df
        done += bits
        bucket = F.shiftrightunsigned(u, KEY_BITS - done).bitwiseAND(F.lit((1 << bits) - 1))
        for r in sorted(inside.groupBy(bucket.alias("bucket")).count().collect(), key=lambda r: -r["bucket"]):
            if r["count"] >= k:
                prefix = (prefix << bits) | r["bucket"]
                break
            k -= r["count"]
        else:
            return -(1 << 63)
    value = prefix ^ (1 << 63)
    return value - (1 << 64) if value >= 1 << 63 else value
