"""Exact join of documents by the Jaccard similarity of their word shingles, in a metric space.

Jaccard distance is a metric. Texts that share nothing are all at distance 1 of each other, so pivots
cannot part them; the first regions are therefore formed by shared shingles: two sets that are alike
enough share one among the first few in any fixed order (rare ones first), and how far down the order the
first shared one stands bounds how alike they can be. What is connected by such shared shingles, between sets that
this bound lets be near, is a region. Inside a region pivots are chosen, documents lie in Voronoi cells
around them, the triangle inequality tells which ones beyond a cell's border could still be near
one inside, and cells join recursively; what no pivot can part is compared exactly in blocks.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .components import connected_components
from .store import buckets, free_name, keyed, materialize, release, small_batches, text_of

WORDS, PERCENT = 5, 80
#: The distance within which two documents are linked.
NEAR = 1 - PERCENT / 100
#: Regions of more documents than this are joined by several tasks.
REGION = 500
#: Documents compared pairwise at once, and pivots of a region within a task.
LEAF, PIVOTS = 40, 8
#: Pivots of a large region, at most and one for so many of its documents; documents (and bytes of sets) measured, and compared, at once.
SPREAD_PIVOTS, PER_PIVOT, BLOCK, BLOCK_BYTES = 32, 250, 1024, 8 << 20
#: A region is cut along its cells if they have no more than this many copies of its documents together, and the
#: largest no more than this share of them; otherwise its blocks are compared.
COPIES, SHARE = 3.0, 0.8
#: Shingles are counted by this many bits of their hashes; rows of a chunk, which are counted together: 2**CHUNK_SHIFT, and the
#: characters of a text beyond which it is a chunk of its own.
BITS, CHUNK_SHIFT, LONG = 38, 10, 1 << 17
#: An order is all that common shingles (found at least COMMON_TIMES times) decide: they come last, the COMMON most common ones by number.
COMMON_TIMES, COMMON = 16, 20_000
#: Tasks that join the buckets' lists of common shingles before they reach the driver.
JOINERS = 16
#: A shingle of a set's prefix, the set, its size, and the largest set that it can be linked with if this is the first shared one.
ENTRY = np.dtype([("h", "<u8"), ("sid", "V12"), ("n", "<u4"), ("most", "<u4")])


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document of a piece, ascending, and their offsets by document."""
    docs = len(at) - 1
    low = B.LOWER[data]
    start, end, first = B.words(low, at)
    word = B.span_hash(B.prefix_hash(low), start, end)
    count = np.diff(first)
    hashes = B.shingle_hashes(word, k)
    of = np.repeat(np.arange(docs), count)
    whole = of[k - 1 :] == of[: len(of) - k + 1] if len(of) >= k else np.zeros(0, bool)
    h, d = hashes[whole], of[: len(whole)][whole]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        lone = np.array([B.mix(np.array([sum(int(w) * int(B._LANES[8 + i]) for i, w in enumerate(word[first[x] : first[x + 1]])) + int(count[x]) & (1 << 64) - 1], np.uint64))[0] for x in short], np.uint64)
        h, d = np.concatenate([h, lone]), np.concatenate([d, short])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(docs + 1))


def set_ids(h: np.ndarray, at: np.ndarray) -> list[bytes]:
    """96-bit digests of the sets, which stand for them."""
    n = np.diff(at).astype(np.uint64)
    sums = []
    for salt in (0x51A3C5D7, 0x2B992DDFA232):
        run = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(B.mix(h ^ np.uint64(salt)), out=run[1:])
        sums.append(B.mix(run[at[1:]] - run[at[:-1]] + n))
    out = np.empty(len(n), [("a", "<u8"), ("b", "<u4")])
    out["a"], out["b"] = sums[0], sums[1].astype(np.uint32)
    return [out[i : i + 1].tobytes() for i in range(len(n))]


def needed(n: int | np.ndarray) -> int | np.ndarray:
    """The least intersection that a set of n needs with any other to be linked."""
    return (PERCENT * n + 99) // 100


def largest_partner(n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The size up to which a set can be linked with one of n whose first shared shingle stands at place (from 0) of its order."""
    return np.maximum((100 + PERCENT) * (n - place) // PERCENT - n, 0)


class Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def linked(inter: np.ndarray, n: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    return 100 * inter >= PERCENT * (n + m - inter)


def shared_with(one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted set with others."""
    size = np.fromiter(map(len, many), np.int64, len(many))
    flat = np.concatenate(many) if many else np.zeros(0, np.uint64)
    place = np.searchsorted(one, flat)
    place[place == len(one)] = 0
    hit = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(one[place] == flat, out=hit[1:])
    ends = np.cumsum(size)
    return hit[ends] - hit[ends - size]


def distance_to(one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    inter = shared_with(one, many)
    return 1 - inter / (np.fromiter(map(len, many), np.int64, len(many)) + len(one) - inter)


def join_region(sets: list[np.ndarray], links: Union, ids: list[int]) -> None:
    """Join ids (all near pairs among them) into links; sets are sorted and not empty."""
    if len(ids) < 2:
        return
    if len(ids) <= LEAF:
        own = [sets[i] for i in ids]
        _, col = np.unique(np.concatenate(own), return_inverse=True)
        size = np.fromiter(map(len, own), np.int64, len(own))
        grid = np.zeros((len(own), int(col.max()) + 1), np.float32)
        grid[np.repeat(np.arange(len(own)), size), col] = 1
        inter = np.rint(grid @ grid.T).astype(np.int64)
        for a, b in np.argwhere(np.triu(linked(inter, size[:, None], size[None, :]), 1)).tolist():
            links.join(ids[a], ids[b])
        return
    own = [sets[i] for i in ids]
    picks = np.unique(np.linspace(0, len(ids) - 1, PIVOTS).astype(int)).tolist()
    d = np.stack([distance_to(own[p], own) for p in picks], 1)
    for j, p in enumerate(picks):
        # all within a pivot's ball are linked with it, so they are one component
        for i in np.flatnonzero(d[:, j] <= NEAR + 1e-9).tolist():
            if i != p and linked(shared_with(own[p], [own[i]]), np.array([len(own[i])]), len(own[p]))[0]:
                links.join(ids[p], ids[i])
    root = np.array([links.find(i) for i in ids])
    if (root == root[0]).all():
        return
    near = d.min(1)
    home = d.argmin(1)
    for j in range(len(picks)):
        cell = np.flatnonzero((d[:, j] - near <= 2 * NEAR + 1e-9) & (near <= 1 - 1e-12) | (home == j) & (near <= 1 - 1e-12))
        far = np.flatnonzero(near > 1 - 1e-12) if j == 0 else np.zeros(0, int)
        for part in (cell, far):
            # documents at distance 1 of every pivot can still be near ones that are at 1 - NEAR or more of all
            if part is far and len(far):
                part = np.flatnonzero(near >= 1 - NEAR - 1e-9)
            if len(part) > 0.8 * len(ids):
                _stragglers(own, ids, d, links)
                return
            if len(part) > 1:
                join_region(sets, links, [ids[i] for i in part.tolist()])


def _stragglers(own: list[np.ndarray], ids: list[int], d: np.ndarray, links: Union) -> None:
    """Compare what is outside the largest component with everything that the pivots' distances and the sizes allow."""
    size = np.fromiter(map(len, own), np.int64, len(own))
    root = np.array([links.find(i) for i in ids])
    names, count = np.unique(root, return_counts=True)
    main = names[count.argmax()]
    for x in np.flatnonzero(root != main).tolist():
        mine = links.find(ids[x])
        may = (size * 100 >= PERCENT * size[x]) & (size[x] * 100 >= PERCENT * size) & (np.abs(d - d[x]).max(1) <= NEAR + 1e-9)
        rivals = [i for i in np.flatnonzero(may).tolist() if links.find(ids[i]) != mine]
        inter = shared_with(own[x], [own[i] for i in rivals])
        for i in np.flatnonzero(linked(inter, size[rivals], int(size[x]))).tolist() if rivals else []:
            links.join(ids[x], ids[rivals[i]])


def ties(e: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Pairs of sets that connect all sets which entries of shared shingles allow to be linked.

    The sets of a shingle are taken in the order of their sizes. Two can only be linked by it if each is at most as
    large as the other's entry allows; sets without any such partner fall out. Each of the others is tied to the first
    of its run, and a run ends where the next size is too large for any link.
    """
    parts = np.frombuffer(np.ascontiguousarray(e["sid"]).tobytes(), [("a", "<u8"), ("b", "<u4")])
    order = np.lexsort((parts["b"], parts["a"], e["n"], e["h"]))
    e = e[order]
    new = np.ones(len(e), bool)
    new[1:] = (e["h"][1:] != e["h"][:-1]) | (e["sid"][1:] != e["sid"][:-1])
    e = e[new]
    head = np.ones(len(e), bool)
    head[1:] = e["h"][1:] != e["h"][:-1]
    of = np.cumsum(head) - 1
    # sizes and bounds below 2**32, so that those of one shingle lie together in one ascending order
    n, most, base = e["n"].astype(np.int64), e["most"].astype(np.int64), of.astype(np.int64) << 32
    end = np.searchsorted(base + n, base + most, side="right")
    best = np.maximum.accumulate(base + most) if len(e) else base
    second = np.full(len(e), -1, np.int64)
    if len(e) > 1:
        second[1:] = np.maximum.accumulate(np.minimum((base + most)[1:], best[:-1]))
    at = np.maximum(end - 1, 0)
    inside = np.arange(len(e)) < end
    other = np.where(inside & (base + most == best[at]), second[at], best[at])
    e = e[(end > 0) & (other >= base + n)] if len(e) else e
    n = e["n"].astype(np.int64)
    fresh = np.ones(len(e), bool)
    fresh[1:] = (e["h"][1:] != e["h"][:-1]) | (100 * n[:-1] < PERCENT * n[1:])
    lead = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(e) else np.zeros(0, np.int64)
    apart = e["sid"][lead] != e["sid"]
    pair = np.empty(int(apart.sum()), [("a", "V12"), ("b", "V12")])
    pair["a"], pair["b"] = e["sid"][lead[apart]], e["sid"][apart]
    pair = np.unique(pair.view("V24")) if len(pair) else pair.view("V24")
    raw = [x.tobytes() for x in pair]
    return [x[:12] for x in raw], [x[12:] for x in raw]


def pack_ascending(v: np.ndarray) -> bytes:
    """Ascending numbers as their first one and the steps to the others, in as few bytes each as the largest step needs."""
    if not len(v):
        return b""
    step = np.diff(v).astype("<u8")
    width = next(w for w in range(3, 9) if not int(step.max(initial=0)) >> 8 * w)
    return bytes([width]) + int(v[0]).to_bytes(8, "little") + step.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_ascending(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    step = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, raw[0])
    v = np.zeros((len(step) + 1, 8), np.uint8)
    v[0] = np.frombuffer(raw, np.uint8, 8, 1)
    v[1:, : raw[0]] = step
    return np.cumsum(v.view("<u8").ravel(), dtype=np.uint64)


class Piece:
    """The sets of a run of rows: all shingles and their offsets by row, the sets' digests, which rows are the first of their
    set and have shingles, and the hashes (BITS each) of those rows' shingles, ascending, each as often as it occurs, twice at most."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray) -> None:
        found = [shingle_sets(data, at) for _, _, data, at in B.pieces(texts)]
        self.h = np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in found)])
        self.n = np.concatenate([np.zeros(0, np.int64), *(np.diff(offset) for _, offset in found)])
        self.at = np.append(0, np.cumsum(self.n))
        self.ids = set_ids(self.h, self.at)
        self.sid = np.frombuffer(b"".join(self.ids), "V12")
        first = np.zeros(len(self.n), bool)
        first[np.unique(self.sid, return_index=True)[1]] = True
        self.chosen = first & (self.n > 0)
        self.of = np.repeat(np.arange(len(self.n)), self.n)
        inside = self.chosen[self.of]
        self.h, self.of = self.h[inside], self.of[inside]
        own, self.back, times = np.unique(self.h >> np.uint64(64 - BITS), return_inverse=True, return_counts=True)
        times = np.minimum(times, 2)
        self.sent, self.place = np.repeat(own, times), np.append(0, np.cumsum(times))[:-1]

    def dealt(self, nb: int) -> tuple[np.ndarray, np.ndarray]:
        """The chosen rows in the order of the buckets of their sets, and those buckets."""
        rows = np.flatnonzero(self.chosen)
        b = (np.frombuffer(self.sid[rows].tobytes(), [("a", "<u8"), ("b", "<u4")])["a"] % np.uint64(nb)).astype(np.int32)
        order = np.argsort(b, kind="stable")
        return rows[order], b[order]


def groups(rows: DataFrame, key: str = "_rid") -> DataFrame:
    """_rid (rows' column key, which each scan of rows must give alike), doc_id, n_shingles, member (the digest of the row's set) and cluster (the smallest digest it is connected with)
    for each row; member and cluster are null for an empty set."""
    spark = rows.sparkSession
    small_batches(spark)
    nb, shift = buckets(rows, 1), CHUNK_SHIFT
    rid = F.col(key).cast("long")
    long = F.coalesce(F.length(F.col("text").cast("string")) > LONG, F.lit(False))
    texts = text_of(rows, rid.alias("_rid"), F.when(long, -1 - rid).otherwise(F.shiftright(rid, shift)).alias("chunk")).select("_rid", "doc_id", "chunk", "text")

    # which shingles occur in two sets: the others can link nothing. A chunk's hashes are sent to their buckets in ascending
    # order, a bit for each comes back, and the chunk's rows, read again, make the same hashes in the same order. Nothing here has a
    # fixed size that a larger input would fill; hashes alike in BITS bits are taken for shared, which costs time only. Copies in
    # several chunks share all shingles, so the chunk's sets are sent too: a bit tells which rows are the first of their set anywhere
    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = -1

        def blobs(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            run = pa.Table.from_batches(rows)
            p = Piece(run.column("text"))
            v, (own, of) = p.sent, p.dealt(nb)
            b = (v * np.uint64(nb) >> np.uint64(BITS)).astype(np.int32)
            # a run without shingles is told too
            told = np.union1d(b, of) if len(v) else np.zeros(1, np.int32)
            row = [pa.array([run.column(c)[i].as_py()] * len(told), pa.int64()) for c, i in (("chunk", 0), ("_rid", 0), ("_rid", -1))]
            sids, rids = p.sid[own], run.column("_rid").to_numpy()[own].astype("<i8")
            lists = [[x.tobytes() for x in np.split(y, np.searchsorted(of, told[1:]))] for y in (sids, rids)]
            blobs = [pack_ascending(x) for x in np.split(v, np.searchsorted(b, told[1:]))]
            return pa.RecordBatch.from_arrays([*row, pa.array(told, pa.int32()), *map(B.binary_array, (blobs, *lists))], ["chunk", "low", "high", "b", "blob", "sids", "rids"])

        for batch in batches:
            rid, alone = batch.column("_rid").to_numpy(), batch.column("chunk").to_numpy() < 0
            # a run holds rows that follow each other; a task may read a part of a chunk only
            before = np.append(last, rid[:-1])
            new = (rid != before + 1) | (rid >> shift != before >> shift)
            start = np.unique(np.append(0, np.flatnonzero(new)))
            for i, j in zip(start.tolist(), [*start[1:].tolist(), len(rid)]):
                if new[i] and held:
                    yield blobs(held)
                    held.clear()
                for x in (i + np.flatnonzero(alone[i:j])).tolist():
                    yield blobs([batch.slice(x, 1)])
                if not alone[i:j].all():
                    held.append(batch.slice(i, j - i).filter(pa.array(~alone[i:j])))
            last = int(rid[-1]) if len(rid) else last
        if held:
            yield blobs(held)

    def marked(group: pa.Table) -> pa.Table:
        parts = [unpack_ascending(x) for x in group.column("blob").to_pylist()]
        v, back, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        shared, many = (times > 1)[back], (times >= COMMON_TIMES)[back]
        cut = np.cumsum([len(x) for x in parts])[:-1]
        bits = [np.packbits(np.concatenate(x)).tobytes() for x in zip(np.split(shared, cut), np.split(many, cut))]
        often = np.argsort(-times, kind="stable")[: 4 + 2 * COMMON // nb]
        often = np.sort(often[times[often] >= COMMON_TIMES])
        n = pa.array([len(x) for x in parts] + [None], pa.int64())
        rids = [np.frombuffer(x, "<i8") for x in group.column("rids").to_pylist()]
        rid, sid = np.concatenate(rids), np.frombuffer(b"".join(group.column("sids").to_pylist()), [("a", "<u8"), ("b", "<u4")])
        by_set = np.lexsort((rid, sid["b"], sid["a"]))
        lead = np.ones(len(rid), bool)
        lead[by_set[1:]] = sid[by_set[1:]] != sid[by_set[:-1]]
        leads = [np.packbits(x).tobytes() for x in np.split(lead, np.cumsum([len(x) for x in rids])[:-1])]
        m = pa.array([len(x) for x in rids] + [None], pa.int64())
        row = [pa.concat_arrays([*group.column(c).chunks, pa.nulls(1, t)]) for c, t in (("chunk", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("b", pa.int32()))]
        lists = [B.binary_array([None] * len(parts) + [x.tobytes()]) for x in (v[often], times[often].astype(np.int64))]
        return pa.table([*row, n, B.binary_array([*bits, None]), m, B.binary_array([*leads, None]), *lists], ["chunk", "low", "high", "b", "n", "bits", "m", "leads", "common", "times"])

    def most_common(lists: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        v, n = np.frombuffer(b"".join(x for x, _ in lists), np.uint64), np.frombuffer(b"".join(x for _, x in lists), np.int64)
        most = np.lexsort((v, -n))[:COMMON]
        return v[most], n[most]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, n = most_common([x for batch in batches for x in zip(*(batch.column(c).to_pylist() for c in ("common", "times")))])
        yield pa.RecordBatch.from_arrays([B.binary_array([v.tobytes()]), B.binary_array([n.tobytes()])], ["common", "times"])

    back = texts.mapInArrow(sent, "chunk long, low long, high long, b int, blob binary, sids binary, rids binary").groupBy("b")
    back = materialize(back.applyInArrow(marked, "chunk long, low long, high long, b int, n long, bits binary, m long, leads binary, common binary, times binary"), "shared")
    # what has been sent and come back takes no disk any more
    release(spark)
    # buckets grow with the input; what reaches the driver doesn't: their lists are joined by JOINERS tasks
    lists = back.where("chunk is null").select("common", "times").repartition(JOINERS).mapInArrow(joined, "common binary, times binary").collect()
    common, times = most_common([(bytes(r["common"]), bytes(r["times"])) for r in lists])
    place = np.empty(len(common), np.uint64)
    place[np.lexsort((common, times))] = np.arange(len(common), dtype=np.uint64)
    order = np.argsort(common)
    ranks = spark.sparkContext.broadcast((common[order], place[order]))

    def prefixes(texts: pa.Table, back: pa.Table) -> pa.Table:
        common, place = ranks.value
        names = ["_rid", "doc_id", "n_shingles", "sid", "b", "blob"]
        out: list[pa.Table] = []
        entries: list[np.ndarray] = []
        texts, back = texts.sort_by("_rid"), back.sort_by([("low", "ascending"), ("b", "ascending")])
        rid, low, high = texts.column("_rid").to_numpy(), back.column("low").to_numpy(), back.column("high").to_numpy()
        start = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        for i, j in zip(start.tolist(), [*start[1:].tolist(), len(low)]):
            run = texts.slice(x := int(np.searchsorted(rid, low[i])), int(np.searchsorted(rid, high[i], side="right")) - x)
            p = Piece(run.column("text"))
            counts, bits, sizes, leads = (back.column(c).slice(i, j - i).to_pylist() for c in ("n", "bits", "m", "leads"))
            both = [np.unpackbits(np.frombuffer(x, np.uint8), count=2 * n).reshape(2, n).astype(bool) for n, x in zip(counts, bits)]
            lead = np.zeros(len(p.n), bool)
            lead[p.dealt(nb)[0]] = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=m) for m, x in zip(sizes, leads)])
            shared, many = np.concatenate(both, axis=1)[:, p.place][:, p.back]
            h, of = p.h, p.of
            alone = np.bincount(of[~shared], minlength=len(p.n))
            take = np.where(lead, np.maximum(p.n - needed(p.n) + 1 - alone, 0), 0)
            own = [*(run.column(c) for c in ("_rid", "doc_id")), pa.array(p.n, pa.int64()), pa.array([x if m else None for x, m in zip(p.ids, p.n.tolist())], pa.binary())]
            out.append(pa.table([*own, pa.nulls(len(p.n), pa.int32()), pa.nulls(len(p.n), pa.binary())], names))
            may = shared & (take > 0)[of]
            h, of, many = h[may], of[may], many[may]
            v = h >> np.uint64(64 - BITS)
            # those found once or a few times, then common ones, then the most common ones by their numbers
            key = (h >> np.uint64(2)) | (many.astype(np.uint64) << np.uint64(62))
            if len(common):
                where = np.searchsorted(common, v)
                where[where == len(common)] = 0
                hit = common[where] == v
                key[hit] = (np.uint64(1) << np.uint64(63)) | place[where[hit]]
            h = h[np.lexsort((key, of))]
            first = np.searchsorted(of, np.arange(len(p.n) + 1))
            pick = B.ragged(first[:-1], take)
            e = np.empty(len(pick), ENTRY)
            e["h"], e["sid"], e["n"] = h[pick], np.repeat(p.sid, take), np.repeat(p.n, take)
            # the shingles that no other set has come before all these
            e["most"] = largest_partner(np.repeat(p.n, take), np.repeat(alone - first[:-1], take) + pick)
            entries.append(e)
        e = np.concatenate(entries)
        b = (e["h"] % np.uint64(nb)).astype(np.int32)
        order = np.argsort(b, kind="stable")
        e, b = e[order], b[order]
        cut = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, np.int64)
        gap = [pa.nulls(len(cut), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
        out.append(pa.table([*gap, pa.array(b[cut], pa.int32()), B.binary_array([x.tobytes() for x in np.split(e, cut[1:])] if len(cut) else [])], names))
        return pa.concat_tables(out)

    back = back.where("chunk is not null").select(F.col("chunk").alias("of"), "low", "high", "b", "n", "bits", "m", "leads")
    told = texts.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(prefixes, "_rid long, doc_id long, n_shingles long, sid binary, b int, blob binary")
    told = materialize(told, "entries")
    del back
    release(spark)

    def stars(group: pa.Table) -> pa.Table:
        a, b = ties(np.frombuffer(b"".join(group.column("blob").to_pylist()), ENTRY))
        return pa.table([B.binary_array(a), B.binary_array(b)], ["a", "b"])

    edges = told.where("b is not null").select("b", "blob").groupBy("b").applyInArrow(stars, "a binary, b binary")
    regions = connected_components(edges, "regions").select(F.col("node").alias("sid"), F.col("component").alias("region"))
    slim = materialize(told.where("b is null").select("_rid", "doc_id", "n_shingles", "sid"), "members")
    # entries are as many as shingles that chance shares, more a document in a larger input; only who is in a region matters from here on
    del told, edges
    release(spark)
    sizes = regions.groupBy("region").agg(F.count("*").alias("region_size"))
    first = slim.where("sid is not null").groupBy("sid").agg(F.min("_rid").alias("_rid"))
    wanted = materialize(regions.join(sizes, "region").join(first, "sid").select("_rid", "sid", "region", "region_size"), "region-members")

    # a set takes more room than its text, so it is made again, for one text of each set of a region
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in B.pieces(batch.column("text")):
                h, offset = shingle_sets(data, at)
                sets = B.binary_array([h[a:z].tobytes() for a, z in zip(offset[:-1], offset[1:])])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("sid", "region", "region_size")), sets], ["sid", "region", "region_size", "set"])

    full = texts.select("_rid", "text").join(wanted.hint("shuffle_hash"), "_rid").select("sid", "region", "region_size", "text")
    full = materialize(full.mapInArrow(made, "sid binary, region binary, region_size long, set binary"), "region-sets")
    # nor are the texts needed any more, unless the caller holds them
    del texts, rows, wanted, first, sizes, regions
    release(spark)

    small = _joined(full.where(f"region_size <= {REGION}"), buckets(full))
    large = full.where(f"region_size > {REGION}")
    if large.limit(1).count():
        small = small.union(_join_large(large))
    clusters = materialize(small, "clusters")
    return slim.join(clusters, "sid", "left").select("_rid", "doc_id", "n_shingles", F.col("sid").alias("member"), F.coalesce("cluster", "sid").alias("cluster"))


def _joined(sets: DataFrame, nb: int) -> DataFrame:
    """(sid, cluster) of small regions (sid, region, set): each region in one task, cluster being the smallest sid reached in it."""

    def run(group: pa.Table) -> pa.Table:
        B.one_thread()
        sid, region, raw = (group.column(c).to_pylist() for c in ("sid", "region", "set"))
        content = [np.frombuffer(x, np.uint64) for x in raw]
        links = Union(len(sid))
        order = sorted(range(len(sid)), key=lambda i: (region[i], len(content[i]), sid[i]))
        i = 0
        while i < len(order):
            j = i
            while j < len(order) and region[order[j]] == region[order[i]]:
                j += 1
            join_region(content, links, order[i:j])
            i = j
        least: dict[int, bytes] = {}
        for x in range(len(sid)):
            r = links.find(x)
            least[r] = min(least.get(r, sid[x]), sid[x])
        return pa.table([B.binary_array(sid), B.binary_array([least[links.find(x)] for x in range(len(sid))])], ["sid", "cluster"])

    return sets.select("sid", "region", "set").withColumn("b", F.pmod(F.xxhash64("region"), F.lit(nb))).groupBy("b").applyInArrow(run, "sid binary, cluster binary")


def _blocks(size: Column, total: Column) -> Column:
    """Parts that so many sets of so many bytes together are dealt to."""
    return F.greatest(F.ceil(size / BLOCK), F.ceil(total / BLOCK_BYTES), F.lit(1))


def _measured(level: DataFrame, depth: int) -> DataFrame:
    """The members of parts (sid, part, size, set) with their distances to their part's pivots (d), the nearest one (home),
    the pivots in whose balls they lie (balls), and all cells that they belong to (cells).

    A cell of a pivot has what is nearest to it and what is at most 2 * NEAR farther from it than from its own
    pivot; no link crosses such a border. One more cell has what may be near a document at distance 1 of all pivots.
    """
    by_part = level.groupBy("part").agg(F.first("size").alias("all"), F.sum(F.length("set")).alias("bytes"))
    by_part = materialize(by_part.withColumn("blocks", _blocks(F.col("all"), F.col("bytes"))), f"parts{depth}")
    number = F.least(F.greatest(F.ceil(F.col("size") / PER_PIVOT), F.lit(PIVOTS)), F.lit(SPREAD_PIVOTS))
    drawn = level.withColumn("pivot", F.pmod(F.xxhash64("sid", F.lit(depth)), number))
    drawn = drawn.groupBy("part", "pivot").agg(F.min_by(F.struct("sid", "set"), F.xxhash64("sid", F.lit(-1 - depth))).alias("p"))
    pivots = drawn.join(by_part, "part").select(F.col("part").alias("p_part"), F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("p_block"), F.col("p.sid").alias("p_sid"), F.col("p.set").alias("p_set"))
    members = level.join(by_part, "part").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")).select("part", "block", "size", "sid", "set")

    def measure(own: pa.Table, pivots: pa.Table) -> pa.Table:
        many = [np.frombuffer(x, np.uint64) for x in own.column("set").to_pylist()]
        names, ones = zip(*sorted(zip(pivots.column("p_sid").to_pylist(), pivots.column("p_set").to_pylist())))
        n = np.fromiter(map(len, many), np.int64, len(many))
        d, balls = np.empty((len(many), len(ones))), np.empty((len(many), len(ones)), bool)
        for j, raw in enumerate(ones):
            one = np.frombuffer(raw, np.uint64)
            inter = shared_with(one, many)
            d[:, j], balls[:, j] = 1 - inter / (n + len(one) - inter), linked(inter, n, len(one))
        near, home = d.min(1), d.argmin(1)
        cells = (d - near[:, None] <= 2 * NEAR + 1e-9) & (near < 1 - 1e-12)[:, None]
        cells = np.concatenate([cells, (near >= 1 - NEAR - 1e-9)[:, None]], axis=1)
        lists = [[names[j] for j in np.flatnonzero(x).tolist()] for x in balls]
        return pa.table(
            [*(own.column(c) for c in ("part", "size", "sid", "set")), pa.array(d.tolist(), pa.list_(pa.float64())), pa.array(home, pa.int32()), pa.array(lists, pa.list_(pa.binary())), pa.array([np.flatnonzero(x).tolist() for x in cells], pa.list_(pa.int32()))],
            ["part", "size", "sid", "set", "d", "home", "balls", "cells"],
        )

    schema = "part string, size long, sid binary, set binary, d array<double>, home int, balls array<binary>, cells array<int>"
    return members.groupBy("part", "block").cogroup(pivots.groupBy("p_part", "p_block")).applyInArrow(measure, schema)


def _join_large(large: DataFrame) -> DataFrame:
    """Clusters of the members of large regions, by several tasks for each region.

    A region is cut along the cells of its pivots, whose borders are replicated, and the cells are regions of the next
    round; small ones are joined in one task each. A region that its pivots can't part, as nearly all of it is near all of
    them, or far from all, is joined in blocks.
    """
    level = large.select("sid", F.hex("region").alias("part"), F.col("region_size").alias("size"), "set")
    edges: list[DataFrame] = []
    for depth in itertools.count():
        placed = materialize(_measured(level, depth), f"placed{depth}")
        edges.append(placed.select(F.col("sid").alias("a"), F.explode("balls").alias("b")))
        cells = placed.select("part", "size", F.explode("cells").alias("cell")).groupBy("part", "size", "cell").count()
        shape = cells.groupBy(F.col("part").alias("of"), F.col("size").alias("all")).agg(F.sum("count").alias("copies"), F.max("count").alias("largest"))
        # as many rows as large parts, and as their cells
        shape = materialize(shape.withColumn("cut", (F.col("copies") <= F.col("all") * COPIES) & (F.col("largest") <= F.col("all") * SHARE)), f"shape{depth}")
        number = {r["cut"]: r["count"] for r in shape.groupBy("cut").count().collect()}
        if number.get(False):
            edges.append(_join_blocks(placed.join(shape.where("not cut").select(F.col("of").alias("part")), "part", "left_semi"), depth))
        if not number.get(True):
            break
        mine = placed.select("part", "sid", "set", F.explode("cells").alias("cell")).join(shape.where("cut").select(F.col("of").alias("part")), "part", "left_semi")
        named = mine.join(cells.drop("size"), ["part", "cell"]).where("count > 1")
        named = materialize(named.select("sid", F.concat_ws("/", "part", "cell").alias("part"), F.col("count").alias("size"), "set"), f"cells{depth}")
        small = _joined(named.where(f"size <= {REGION}").withColumnRenamed("part", "region"), buckets(named))
        edges.append(small.select(F.col("sid").alias("a"), F.col("cluster").alias("b")))
        level = named.where(f"size > {REGION}")
        if not level.limit(1).count():
            break
    links = functools.reduce(DataFrame.union, edges)
    whole = connected_components(links, "large").select(F.col("node").alias("sid"), F.col("component").alias("cluster"))
    return large.select("sid").join(whole, "sid", "left").select("sid", F.coalesce("cluster", "sid").alias("cluster"))


def _join_blocks(placed: DataFrame, depth: int) -> DataFrame:
    """Links (a, b) that connect, with those of members and pivots, all that is near in regions that can't be cut.

    The balls of the pivots connect most of what is near. Members outside their region's largest component so far
    are compared with all blocks of members that the triangle inequality and the sizes leave.
    """
    star = placed.select(F.col("sid").alias("a"), F.explode("balls").alias("b"))
    labels = connected_components(star, "balls").withColumnRenamed("node", "sid").withColumnRenamed("component", "label")
    placed = placed.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    main = placed.groupBy("part", "label").count().groupBy("part").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    n = (F.length("set") / 8).cast("long")
    cells = placed.groupBy("part", "home").agg(F.count("*").alias("cell_size"), F.sum(F.length("set")).alias("bytes"))
    marked = placed.join(main, "part").join(cells, ["part", "home"]).withColumn("n", n)
    marked = marked.withColumn("block", F.concat_ws("/", "part", "home", F.pmod(F.xxhash64("sid"), _blocks(F.col("cell_size"), F.col("bytes")))))
    marked = materialize(marked.select("part", "home", "block", "sid", "label", "main", "n", "set", "d"), f"marked{depth}")
    # a block's distances to its own pivot, and its sizes, tell which stragglers it can be near
    span = F.element_at("d", F.col("home") + 1)
    directory = marked.groupBy("part", "home", "block").agg(F.min(span).alias("low"), F.max(span).alias("high"), F.min("n").alias("least"), F.max("n").alias("most"))
    outside = marked.where("label <> main")
    counts = outside.groupBy("part").agg(F.count("*").alias("outside"), F.sum(F.length("set")).alias("bytes"))
    asked = outside.join(counts, "part").withColumn("turn", F.pmod(F.xxhash64("sid", F.lit(1)), _blocks(F.col("outside"), F.col("bytes"))))
    asked = asked.select("part", "turn", F.col("sid").alias("q_sid"), F.col("label").alias("q_label"), F.col("n").alias("q_n"), F.col("set").alias("q_set"), F.col("d").alias("q_d"))
    mine = F.element_at("q_d", F.col("home") + 1)
    near = (mine >= F.col("low") - NEAR - 1e-9) & (mine <= F.col("high") + NEAR + 1e-9) & (F.col("most") * 100 >= F.col("q_n") * PERCENT) & (F.col("least") * PERCENT <= F.col("q_n") * 100)
    left = asked.join(directory, "part").where(near).select(F.col("block").alias("q_block"), F.col("turn").alias("q_turn"), "q_sid", "q_label", "q_set", "q_d")
    turns = left.select(F.col("q_block").alias("block"), F.col("q_turn").alias("turn")).distinct()
    right = marked.select("block", "sid", "label", "set", "d").join(turns, "block").select("block", "turn", "sid", "label", "set", "d")

    def compare(asked: pa.Table, members: pa.Table) -> pa.Table:
        sid, label, d = (members.column(c).to_pylist() for c in ("sid", "label", "d"))
        content = [np.frombuffer(x, np.uint64) for x in members.column("set").to_pylist()]
        size = np.fromiter(map(len, content), np.int64, len(content))
        near = np.array(d, np.float64).reshape(len(sid), -1)
        a, b = [], []
        for s, lab, raw, own in zip(*(asked.column(c).to_pylist() for c in ("q_sid", "q_label", "q_set", "q_d"))):
            one = np.frombuffer(raw, np.uint64)
            may = (size * 100 >= PERCENT * len(one)) & (len(one) * 100 >= PERCENT * size) & (np.abs(near - np.array(own)).max(1) <= NEAR + 1e-9)
            found = [i for i in np.flatnonzero(may).tolist() if label[i] != lab]
            hit = linked(shared_with(one, [content[i] for i in found]), size[found], len(one)) if found else []
            met = {label[i]: sid[i] for i, ok in zip(found, hit) if ok}
            a += [s] * len(met)
            b += met.values()
        return pa.table([B.binary_array(a), B.binary_array(b)], ["a", "b"])

    return left.groupBy("q_block", "q_turn").cogroup(right.groupBy("block", "turn")).applyInArrow(compare, "a binary, b binary")


def component_ids(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs.

    component_id is the smallest doc_id connected by links, of similarity PERCENT or more. A null
    or empty text has an empty set: it is linked with nothing and its own component. Rows that share
    their set are linked. Rows with a null doc_id take part; a component of such rows alone has a null
    id. Very long texts count whole, all their shingles. Ties don't arise: links are a threshold and a component's id
    is a minimum. Columns besides doc_id and text play no part. An empty table gives an empty result.
    """
    found = materialize(groups(keyed(text_of(docs), "documents")), "groups")
    # written first: a join of two exchanges splits a hot cluster, a join with an aggregate of the same stage can't
    least = materialize(found.where("cluster is not null").groupBy("cluster").agg(F.min("doc_id").alias("least")), "least")
    return found.join(least, "cluster", "left").select("doc_id", "n_shingles", F.when(F.col("cluster").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each component: the one with the smallest doc_id stays."""
    key = free_name(docs, "_rid")
    rows = keyed(docs, "documents", key)
    found = materialize(groups(rows, key), "groups")
    stay = found.where("cluster is not null").groupBy("cluster").agg(F.min_by("_rid", F.struct(F.col("doc_id").isNull(), "doc_id", "_rid")).alias("_rid")).select("_rid")
    stay = stay.union(found.where("cluster is null").select("_rid"))
    return rows.join(stay.withColumnRenamed("_rid", key), key, "left_semi").select(*docs.columns)
