"""Token ids in shards of separately compressed documents that share one trained dictionary.

A shard is a block of bytes: a header (magic, bytes per id, end id, number of documents, SHA-256
of the dictionary), an index entry for each document (doc_id, whether it is set, offset and
length of its frame, number of ids) and the frames. One document is read by its index entry and
its own frame. A written corpus is a folder of three Parquet tables: shards, with their doc_id ranges; dictionary,
one row with its bytes, their SHA-256 and the end id; and index, one row for each document with its shard and the place of its frame, in
doc_id order, so that a reader skips row groups and shards without the wanted documents.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from . import tokens
from .store import bounded_runs, small_batches, temporary, text_of

MAGIC = b"ATQS"
HEAD = struct.Struct("<4sBxxxII32s")
ENTRY = np.dtype([("doc_id", "<i8"), ("is_set", "u1"), ("offset", "<u8"), ("size", "<u4"), ("n_tokens", "<u8")])
#: Bytes of the documents' files for each range of doc_ids that one task sorts and compresses.
PART_BYTES = 128 << 20
#: A shard is closed when its frames reach this many bytes.
SHARD_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10
#: The dictionary is trained on at most so many runs of so many characters (chosen by a hash of doc_id and place), long texts having as many more.
SAMPLE_RUNS, SAMPLE_CHARS = 1500, 8192
LEVEL = 3


@dataclass
class TokenShards:
    """A written corpus: its folder, the shard table, the dictionary, and how to read it."""

    table: DataFrame
    dictionary: bytes
    end_id: int
    folder: str


def serialize(ids: np.ndarray, width: int) -> bytes:
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def train_dictionary(docs: DataFrame, path: str) -> bytes:
    """A zstandard dictionary from serialized id arrays of a bounded sample; empty where there is too little text."""
    few = bounded_runs(docs, SAMPLE_RUNS, SAMPLE_CHARS, "doc_id").collect()
    coder = tokens.encoder(path)
    width = 2 if coder.vocabulary <= 1 << 16 else 4
    samples = []
    for r in few:
        data, at = B.text_bytes(pa.array([r["text"]]))
        samples.append(serialize(coder.encode(data, at)[0], width))
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _coder(kind, dictionary: bytes, **more):
    return kind(dict_data=zstandard.ZstdCompressionDict(dictionary), **more) if dictionary else kind(**more)


def pack(entries: list[tuple], frames: list[bytes], width: int, end_id: int, digest: bytes) -> bytes:
    index = np.array(entries, ENTRY)
    return HEAD.pack(MAGIC, width, end_id, len(index), digest) + index.tobytes() + b"".join(frames)


def opened(shard: bytes, dictionary: bytes) -> tuple[np.ndarray, int, int]:
    """A shard's index, bytes per id, and where its frames begin; the dictionary must be the one it was written with."""
    magic, width, _, n, digest = HEAD.unpack_from(shard)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    if digest != hashlib.sha256(dictionary).digest():
        raise ValueError("the shard was written with another dictionary")
    return np.frombuffer(shard, ENTRY, n, HEAD.size), width, HEAD.size + n * ENTRY.itemsize


def read_document(shard: bytes, dictionary: bytes, doc_id: int) -> list[np.ndarray]:
    """The ids of all documents of a shard with this doc_id, each decompressed alone."""
    index, width, base = opened(shard, dictionary)
    coder = _coder(zstandard.ZstdDecompressor, dictionary)
    out = []
    for e in index[(index["doc_id"] == doc_id) & (index["is_set"] == 1)]:
        raw = coder.decompress(shard[base + int(e["offset"]) : base + int(e["offset"]) + int(e["size"])], max_output_size=int(e["n_tokens"]) * width)
        out.append(np.frombuffer(raw, "<u2" if width == 2 else "<u4").astype(np.uint32))
    return out


def parts_of(docs: DataFrame) -> int:
    """Ranges that a corpus is dealt to: one for PART_BYTES of its files where the plan knows them, at least as many as shuffle partitions."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, size // PART_BYTES if size < 1 << 60 else 0)


def write(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = 0) -> TokenShards:
    """Encode docs and write them to folder in ascending doc_id order (null first; equal ones by a hash of their text).

    folder must be new; where it isn't given, a folder beside the other intermediate tables is taken, which goes when Python ends. path is the tokenizer's.
    A null or empty text has the end id alone; a very long one is one frame. Repeated rows are documents
    of their own, next to each other; rows with equal doc_ids are ordered by their texts' hashes. Columns besides doc_id and text play no part. An empty table gives no shards.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = path or tokens.tokenizer_path()
    rows = text_of(docs)
    dictionary = train_dictionary(rows, path)
    digest = hashlib.sha256(dictionary).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(zstandard.ZstdCompressor, dictionary, level=LEVEL, write_content_size=True, write_dict_id=False)
        width = 2 if tokens.encoder(path).vocabulary <= 1 << 16 else 4
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        entries: list[tuple] = []
        frames: list[bytes] = []
        size = count = before = shard = 0

        def closed() -> pa.RecordBatch:
            ids = [e[0] for e in entries if e[1]]
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([count], pa.int64()), pa.array([min(ids, default=None)], pa.int64()), pa.array([max(ids, default=None)], pa.int64()), B.binary_array([pack(entries, frames, width, end_id, digest)])],
                ["part", "shard", "before", "n_tokens", "first_id", "last_id", "payload"],
            )

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for i, ids, at in tokens.encoded(batch.column("text"), path, end_id):
                for k in range(len(at) - 1):
                    own = ids[at[k] : at[k + 1]]
                    frame = coder.compress(serialize(own, width))
                    doc = doc_ids[i + k]
                    entries.append((doc or 0, doc is not None, size, len(frame), len(own)))
                    frames.append(frame)
                    size += len(frame)
                    count += len(own)
                    if size >= SHARD_BYTES:
                        yield closed()
                        shard, before = shard + 1, before + count
                        entries, frames, size, count = [], [], 0, 0
        if entries:
            yield closed()

    # equal doc_ids are dealt by their texts' hashes, and equal texts by their place in the scan, so no range is forced to grow
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("place").asc()]
    ordered = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(parts_of(docs), *keys).sortWithinPartitions(*keys)
    table = ordered.select("doc_id", "text").mapInArrow(run, "part int, shard int, before long, n_tokens long, first_id long, last_id long, payload binary")
    if folder is None:
        folder = temporary(spark, "token-shards")
    table.write.parquet(f"{folder}/shards")
    one = spark.createDataFrame([(bytearray(dictionary), hashlib.sha256(dictionary).hexdigest(), end_id)], "bytes binary, sha256 string, end_id long")
    one.write.parquet(f"{folder}/dictionary")
    written = reopen(spark, folder)
    _index(written).write.parquet(f"{folder}/index")
    return written


def reopen(spark: SparkSession, folder: str) -> TokenShards:
    """A corpus written before, by this session or another."""
    d = spark.read.parquet(f"{folder}/dictionary").first()
    dictionary = bytes(d["bytes"])
    if hashlib.sha256(dictionary).hexdigest() != d["sha256"]:
        raise ValueError(f"the dictionary in {folder} isn't the one that was written")
    return TokenShards(spark.read.parquet(f"{folder}/shards"), dictionary, d["end_id"], folder)


def _index(shards: TokenShards) -> DataFrame:
    """doc_id, part, shard, n_tokens, offset (in the shard's bytes) and size of each document's frame."""
    dictionary = shards.dictionary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "payload"))):
                index, _, base = opened(payload, dictionary)
                n = len(index)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(index["doc_id"].astype(np.int64), pa.int64(), mask=index["is_set"] == 0), pa.array([part] * n, pa.int32()), pa.array([shard] * n, pa.int32()), *(pa.array(x.astype(np.int64)) for x in (index["n_tokens"], index["offset"] + np.uint64(base), index["size"]))],
                    ["doc_id", "part", "shard", "n_tokens", "offset", "size"],
                )

    return shards.table.select("part", "shard", "payload").mapInArrow(run, "doc_id long, part int, shard int, n_tokens long, offset long, size long")


def look_up(shards: TokenShards, doc_ids: DataFrame) -> DataFrame:
    """doc_id, ids of the documents with the doc_ids of a table (column doc_id): each found by the index, its frame decompressed alone.

    Null doc_ids find nothing; a doc_id asked for twice is answered once, one of several documents with each of them.
    """
    spark = shards.table.sparkSession
    wanted = spark.read.parquet(f"{shards.folder}/index").join(doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    by_shard = wanted.groupBy("part", "shard").agg(F.collect_list(F.struct("doc_id", "n_tokens", "offset", "size")).alias("want"))
    dictionary = shards.dictionary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(zstandard.ZstdDecompressor, dictionary)
        for batch in batches:
            for payload, want in zip(batch.column("payload").to_pylist(), batch.column("want").to_pylist()):
                width = opened(payload, dictionary)[1]
                ids = [np.frombuffer(coder.decompress(payload[w["offset"] : w["offset"] + w["size"]], max_output_size=w["n_tokens"] * width), "<u2" if width == 2 else "<u4").astype(np.int64) for w in want]
                yield pa.RecordBatch.from_arrays([pa.array([w["doc_id"] for w in want], pa.int64()), pa.array([x.tolist() for x in ids], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return shards.table.join(by_shard, ["part", "shard"]).select("payload", "want").mapInArrow(run, "doc_id long, ids array<long>")


def documents(shards: TokenShards) -> DataFrame:
    """Read all shards back: doc_id, start, n_tokens, ids_crc32 of each document.

    A document's start is what the parts before its own hold (one total for each part of the
    range partitioning, of which there are as many as shuffle partitions), what its part's earlier
    shards hold (kept with each shard) and its place in the shard.
    """
    spark = shards.table.sparkSession
    totals = {r["part"]: r["n"] for r in shards.table.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    starts, run_total = {}, 0
    for part in sorted(totals):
        starts[part] = run_total
        run_total += totals[part]
    dictionary = shards.dictionary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(zstandard.ZstdDecompressor, dictionary)
        for batch in batches:
            for part, before, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "payload"))):
                index, width, base = opened(payload, dictionary)
                kind = "<u2" if width == 2 else "<u4"
                n = index["n_tokens"].astype(np.int64)
                crc = np.empty(len(index), np.int64)
                for k, (offset, size, count) in enumerate(zip(index["offset"].tolist(), index["size"].tolist(), n.tolist())):
                    raw = coder.decompress(payload[base + offset : base + offset + size], max_output_size=count * width)
                    crc[k] = zlib.crc32(np.frombuffer(raw, kind).astype("<u4").tobytes())
                start = starts[part] + before + np.cumsum(n) - n
                ids = pa.array(index["doc_id"].astype(np.int64), pa.int64(), mask=index["is_set"] == 0)
                yield pa.RecordBatch.from_arrays([ids, pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    small_batches(spark)
    return shards.table.select("part", "before", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame) -> DataFrame:
    """Write docs as token shards and give each document's digest as read back from them."""
    return documents(write(docs))
