"""Packing token sequences into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import tokens
from .store import small_batches, text_of

WINDOW = 2048
#: Pieces that are packed with others hold at most so many ids.
PIECE = 512
#: Windows that are balanced together, and the free places left in each on average at first.
GROUP, SLACK = 48, 8


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Deal items to k windows of near-equal sums: the two partial partitions with the widest spreads
    are merged, the fullest window of one with the emptiest of the other, until one is left."""
    heap: list = []
    for i, s in enumerate(sizes):
        loads = np.zeros(k, np.int64)
        loads[0] = s
        heap.append((-s, i, loads, [i] + [None] * (k - 1)))
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, la, ca = heapq.heappop(heap)
        _, _, lb, cb = heapq.heappop(heap)
        loads = la + lb[::-1]
        order = np.argsort(-loads, kind="stable")
        loads = loads[order]
        merged = [y if x is None else x if y is None else (x, y) for x, y in zip(ca, reversed(cb))]
        loads -= loads[-1]
        heapq.heappush(heap, (-int(loads[0]), tick, loads, [merged[j] for j in order.tolist()]))
        tick += 1
    out = []
    for tree in heap[0][3] if heap else []:
        own, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            elif x is not None:
                own.append(x)
        out.append(own)
    return out


def windows(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Items (none above capacity) dealt to as few windows as differencing manages: their number rises while one overflows."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in dealt):
            return [w for w in dealt if w]
        k += 1


def cuts(n: int) -> list[tuple[int, int]]:
    """A document's pieces (start, length): whole windows first, then near-equal pieces of at most PIECE ids."""
    full = n // WINDOW
    out = [(i * WINDOW, WINDOW) for i in range(full)]
    at, rest = full * WINDOW, n - full * WINDOW
    parts = -(-rest // PIECE)
    for i in range(parts):
        step = rest // parts + (i < rest % parts)
        out.append((at, step))
        at += step
    return out


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of documents and their places in sequences of at most WINDOW ids.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the
    ids themselves if with_ids. A null text counts as empty, its document being the end id alone.
    Repeated rows are documents of their own; a null doc_id is kept. Columns besides doc_id and
    text play no part. An empty table gives an empty result. Very long texts are whole windows and a rest; pieces of
    equal length are packed in the order in which they come.

    Each task packs its own documents, a bounded group of windows at a time, so nothing is shuffled
    and no group grows with the input; only the last window group of a task may be partly filled.
    """
    small_batches(docs.sparkSession)
    path = path or tokens.tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 33
        held: list[tuple] = []  # doc_id, start, length, crc, doc_tokens, ids
        total = 0
        room = GROUP * (WINDOW - SLACK)

        def rows(placed: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*placed))
            arrays = [pa.array(c, pa.int64()) for c in (columns[0], columns[1], columns[2], columns[3], columns[4], columns[6], columns[7])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int64) for x in columns[5]], pa.list_(pa.int64())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        def dealt(pieces: list[tuple]) -> list[tuple]:
            nonlocal sequence
            out = []
            for window in windows([p[2] for p in pieces]):
                offset = 0
                for i in window:
                    out.append((*pieces[i], sequence, offset))
                    offset += pieces[i][2]
                sequence += 1
            return out

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for i, ids, at in tokens.encoded(batch.column("text"), path, end_id):
                ready: list[tuple] = []
                for k in range(len(at) - 1):
                    n = int(at[k + 1] - at[k])
                    for start, length in cuts(n):
                        own = ids[at[k] + start : at[k] + start + length]
                        piece = (doc_ids[i + k], start, length, zlib.crc32(own.astype("<u4").tobytes()), n, own if with_ids else None)
                        if length == WINDOW:
                            ready.append((*piece, sequence, 0))
                            sequence += 1
                            continue
                        if total + length > room:
                            ready += dealt(held)
                            held, total = [], 0
                        held.append(piece)
                        total += length
                if ready:
                    yield rows(ready)
        if held:
            yield rows(dealt(held))

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<long>" if with_ids else "")
    return text_of(docs).mapInArrow(run, schema)
