"""Exact search for the largest inner products by an index of pivots and distances."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytesops as B
from .store import bounded_sample, materialize, small_batches, with_row_id

#: Pivots are centres of at most SAMPLE vectors (chosen by a hash of vec_id); the bound holds for any input.
PIVOTS, SAMPLE = 64, 4096
#: Annuli for each pivot, cut at quantiles of the sample's distances.
RINGS = 8
#: Vectors in a block of the index, queries in a chunk.
BLOCK, CHUNK = 2048, 256
#: A query's annuli are taken in waves; each ends at this many times the annuli of the last one's end.
GROWTH = 4
SCALE = 64
LONG = (1 << 63) - 1
#: Bytes of a score beyond a long, moved so that it is positive.
WIDE = 270


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """_rid, vec_id, largest (of the components' absolute values), comps (float64 whole numbers floor(scale * x)) of the vectors that take part.

    Rows with a null vec_id, a null vector, or a null or non-finite component take no part; a component
    whose product with scale is beyond a double counts as non-finite.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, ids, largest, comps = [], [], [], []
            for r, i, v in zip(batch.column("_rid").to_pylist(), batch.column("vec_id").to_pylist(), batch.column("embedding")):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                with np.errstate(over="ignore"):
                    x = np.floor(v.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                if not np.isfinite(x).all():
                    continue
                rid.append(r)
                ids.append(i)
                largest.append(float(np.abs(x).max(initial=0)))
                comps.append(x.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(ids, pa.int64()), pa.array(largest, pa.float64()), B.binary_array(comps)], ["_rid", "vec_id", "largest", "comps"])

    rows = with_row_id(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")))
    return rows.mapInArrow(run, "_rid long, vec_id long, largest double, comps binary")


def matrix(comps: list[bytes], dim: int) -> np.ndarray:
    """Vectors as rows; a shorter one is filled up with zeros, which adds nothing to a product."""
    out = np.zeros((len(comps), dim))
    for k, c in enumerate(comps):
        v = np.frombuffer(c, "<f8")
        out[k, : len(v)] = v
    return out


def centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means from evenly spaced rows; an empty cell keeps its centre."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].mean(0)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0))


class Products:
    """Products of whole numbers. Where doubles can't hold them exactly, they only tell which ones are worked out in long arithmetic."""

    def __init__(self, largest: float, dim: int) -> None:
        self.exact = largest * largest * max(dim, 1) < 1 << 52
        # a power of two, so that scaling rounds nothing; scaled components are at most 1
        self.unit = 1.0 if self.exact else 2.0 ** -(math.frexp(largest)[1])
        self.slack = 0.0 if self.exact else 4 * (dim + 1) * 2.0**-52

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return x * self.unit

    def best(self, near: np.ndarray, error: float, q: np.ndarray, x: np.ndarray, k: int, floor: float, order: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int, bytes, float]]:
        """The k best of x for one query q, given their near products: place, score, what is beyond a long, near product. Ties go by order."""
        good = np.flatnonzero((near >= floor - error) & (near > -np.inf))
        if len(good) > k:
            least = np.partition(near[good], len(good) - k)[len(good) - k]
            good = good[near[good] >= least - 2 * error]
        if self.exact:
            good = good[np.lexsort((order[1][good], order[0][good], -near[good]))[:k]]
            return [(i, int(near[i]), b"", near[i]) for i in good.tolist()]
        mine = [int(c) for c in q]
        known: dict[bytes, int] = {}
        scores = []
        for i in good.tolist():
            raw = x[i].tobytes()
            if raw not in known:
                known[raw] = sum(a * int(c) for a, c in zip(mine, x[i]))
            scores.append((-known[raw], int(order[0][i]), int(order[1][i]), i))
        return [(i, max(-LONG - 1, min(LONG, -s)), b"" if -LONG - 1 < -s < LONG else (-s + (1 << 8 * WIDE - 1)).to_bytes(WIDE, "big"), near[i]) for s, _, _, i in sorted(scores)[:k]]


def top_products(vectors: DataFrame, k: int = 20, query_step: int = 20, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose vec_id is divisible by query_step its k largest products.

    A largest-product search becomes a nearest-neighbour search by one more coordinate: with R the
    largest norm, x' = (x, sqrt(R^2 - |x|^2)) and q' = (q, 0) have |q' - x'|^2 = R^2 + |q|^2 - 2 qx.
    Every x' is keyed by its nearest pivot and the annulus that its distance falls in. A query takes the annuli in
    the order of their triangle-inequality bounds, the first one alone, then ever more at a time; after each wave its
    k-th product so far is its floor, and it stops where the next annulus's bound falls short of it.
    Ties go to the smaller vec_id. Repeated rows are vectors of their
    own, and a query's own row isn't a candidate. Fewer than k candidates are all returned; an
    empty table gives an empty result. Products of any finite components are ranked exactly; a score beyond a long
    is given as the nearest long.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    schema = "query_id long, rank int, vec_id long, score long"
    table = materialize(quantized(vectors, scale), "vectors")
    stats = table.agg(F.count("*").alias("n"), F.max("largest").alias("largest"), F.max(F.length("comps")).alias("bytes")).first()
    if not stats["n"]:
        return spark.createDataFrame([], schema)
    dim = int(stats["bytes"]) // 8
    products = Products(float(stats["largest"]), dim)
    few = [bytes(r["comps"]) for r in bounded_sample(table, SAMPLE, "vec_id", "_rid").select("comps").collect()]

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = products.scaled(matrix(batch.column("comps").to_pylist(), dim))
            yield pa.RecordBatch.from_arrays([pa.array((x * x).sum(1))], ["norm"])

    top = float(table.select("comps").mapInArrow(longest, "norm double").agg(F.max("norm")).first()[0])

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]], axis=1)

    sample = lifted(products.scaled(matrix(few, dim)))
    pivots = centres(sample, PIVOTS)
    d = distances(sample, pivots)
    near = d.argmin(1)
    own = d[np.arange(len(d)), near]
    edges = np.stack([np.quantile(own[near == j], np.arange(1, RINGS) / RINGS) if (near == j).any() else np.zeros(RINGS - 1) for j in range(len(pivots))])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        B.one_thread()
        for batch in batches:
            if not batch.num_rows:
                continue
            d = distances(lifted(products.scaled(matrix(batch.column("comps").to_pylist(), dim))), pivots)
            cell = d.argmin(1)
            dist = d[np.arange(len(d)), cell]
            ring = (dist[:, None] > edges[cell]).sum(1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_rid", "vec_id", "comps")), pa.array(cell * RINGS + ring, pa.int32()), pa.array(dist)], ["_rid", "vec_id", "comps", "annulus", "dist"])

    placed = materialize(table.mapInArrow(keyed, "_rid long, vec_id long, comps binary, annulus int, dist double"), "annuli")
    # at most PIVOTS * RINGS rows
    directory = placed.groupBy("annulus").agg(F.count("*").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high")).orderBy("annulus").collect()
    annulus = np.array([r["annulus"] for r in directory])
    blocks = np.array([-(-r["n"] // BLOCK) for r in directory])
    low, high = np.array([r["low"] for r in directory]), np.array([r["high"] for r in directory])
    parts = spark.createDataFrame([(int(a), int(b)) for a, b in zip(annulus, blocks)], "annulus int, blocks int")
    spread = placed.join(F.broadcast(parts), "annulus").withColumn("block", (F.pmod(F.xxhash64("_rid"), F.col("blocks"))).cast("int"))

    def packed(group: pa.Table) -> pa.Table:
        x = matrix(group.column("comps").to_pylist(), dim)
        ids = np.stack([group.column("_rid").to_numpy(), group.column("vec_id").to_numpy()], 1).astype("<i8")
        return pa.table([group.column("annulus").slice(0, 1), group.column("block").slice(0, 1), B.binary_array([ids.tobytes()]), B.binary_array([x.tobytes()])], ["annulus", "block", "ids", "x"])

    index = materialize(spread.groupBy("annulus", "block").applyInArrow(packed, "annulus int, block int, ids binary, x binary"), "vector-blocks")
    # queries of one annulus have like orders of annuli, so they are asked together
    turn = F.pmod(F.xxhash64(F.col("_rid") + 1), F.greatest(F.lit(1), F.ceil(F.col("blocks") * F.lit(BLOCK / query_step / CHUNK)))).cast("int")
    asked = spread.where(F.col("vec_id") % query_step == 0).withColumn("chunk", F.concat_ws("/", "annulus", turn))
    chunk_of = materialize(asked.select("chunk", F.col("_rid").alias("q"), "vec_id", "comps"), "queries")

    def wave(first: int, last: int):
        def run(queries: pa.Table) -> pa.Table:
            """From the queries of a chunk and their floors to the blocks of the annuli first .. last of each one's order that may hold better ones."""
            B.one_thread()
            q = matrix(queries.column("comps").to_pylist(), dim)
            q_ids = np.stack([queries.column("q").to_numpy(), queries.column("vec_id").to_numpy()], 1).astype("<i8")
            floor = queries.column("floor").to_numpy()
            x = products.scaled(q)
            d = distances(np.concatenate([x, np.zeros((len(x), 1))], axis=1), pivots)[:, annulus // RINGS]
            gap = np.maximum(0, np.maximum(d - high, low - d))
            most = (top + (x * x).sum(1)[:, None] - gap * gap) / 2
            turn = np.argsort(np.argsort(-most, axis=1, kind="stable"), axis=1)
            may = (most + 1e-6 * (top + np.abs(most)) >= floor[:, None]) & (turn >= first) & (turn < last)
            out: list[list] = [[], [], [], [], []]
            for j in np.flatnonzero(may.any(0)):
                mine = may[:, j]
                for i in range(0, int(mine.sum()), CHUNK):
                    ask = [y[mine][i : i + CHUNK].tobytes() for y in (q_ids, q, floor)]
                    for b in range(blocks[j]):
                        for column, value in zip(out, (int(annulus[j]), b, *ask)):
                            column.append(value)
            return pa.table([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), *map(B.binary_array, out[2:])], ["annulus", "block", "q_ids", "q", "floor"])

        return run

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        B.one_thread()
        for batch in batches:
            for row in batch.to_pylist():
                ids, q_ids = np.frombuffer(row["ids"], "<i8").reshape(-1, 2), np.frombuffer(row["q_ids"], "<i8").reshape(-1, 2)
                x, q = np.frombuffer(row["x"], "<f8").reshape(len(ids), dim), np.frombuffer(row["q"], "<f8").reshape(len(q_ids), dim)
                sx, sq = products.scaled(x), products.scaled(q)
                near = sq @ sx.T
                near[q_ids[:, :1] == ids[:, 0]] = -np.inf
                error = products.slack * (math.sqrt(top) * np.sqrt((sq * sq).sum(1)) + 1e-250)
                out: list[tuple] = []
                for i, floor in enumerate(np.frombuffer(row["floor"], np.float64).tolist()):
                    for j, score, beyond, about in products.best(near[i], float(error[i]), q[i], x, k, floor, (ids[:, 1], ids[:, 0])):
                        out.append((int(q_ids[i, 0]), int(q_ids[i, 1]), int(ids[j, 0]), int(ids[j, 1]), score, beyond, float(about - error[i])))
                columns = list(zip(*out)) or [()] * 7
                kinds = (*[pa.int64()] * 5, pa.binary(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["q", "query_id", "c", "vec_id", "score", "beyond", "about"])

    found = "q long, query_id long, c long, vec_id long, score long, beyond binary, about double"
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("beyond").desc(), "vec_id", "c")
    best, first, last = None, 0, 1
    while first < len(annulus):
        queries = chunk_of.withColumn("floor", F.lit(float("-inf")))
        if best is not None:
            floors = best.where(F.col("rank") == k).select("q", F.col("about").alias("own"))
            queries = chunk_of.join(floors, "q", "left").select(*chunk_of.columns, F.coalesce("own", F.lit(float("-inf"))).alias("floor"))
        todo = materialize(queries.groupBy("chunk").applyInArrow(wave(first, last), "annulus int, block int, q_ids binary, q binary, floor binary"), f"asked{first}")
        if first and not todo.limit(1).count():
            break  # every query has stopped: later bounds are no better
        new = todo.join(index, ["annulus", "block"]).mapInArrow(searched, found)
        rows = new if best is None else new.union(best.drop("rank"))
        best = materialize(rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), f"best{first}")
        first, last = last, last * GROWTH
    return best.select("query_id", "rank", "vec_id", "score")


#: For embeddings of one length and vec_ids that don't repeat.
SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64e0 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
