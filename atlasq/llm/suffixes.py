"""Removal of long byte strings that occur more than once, by suffix arrays of shards.

A string of LENGTH bytes is found again wherever it stands by the smallest hash among its
GRAM-byte pieces: equal strings have equal smallest hashes. Consecutive positions
of a document that share that piece (the first, if several have its hash) form a window. Windows whose hash occurs once
in the corpus hold nothing repeated and go no further; of the others one of each kind is dealt to a shard by its hash, with its number.
A shard is sorted into a suffix array (Larsson-Sadakane refinement), its common prefixes follow by
Kasai's rule, and neighbours that share LENGTH bytes (or one string of a window found twice) are repeats. Hashes with
many different windows are spread over shards, and the sorted strings of those shards are merged by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .store import bounded_sample, buckets, free_name, keyed, materialize, small_batches

LENGTH, GRAM = 200, 64
#: Different windows of one hash beyond which they are spread over shards.
HOT = 128
#: Hashes of at least so many windows among at most so many documents (chosen by a hash of the row's number) are spread before they meet
#: in one task. The sample decides where windows go, not what is found.
SAMPLE_TIMES, SAMPLE_DOCS = 32, 20_000
#: Bytes of windows sorted at once in a shard.
SORT_BYTES = 2 << 20
FLUSH = 200_000

#: A string of a spread window in the merge: two hashes, whether its shard found it repeated, and its place.
STRING = np.dtype([("key", "<u8"), ("more", "<u8"), ("known", "u1"), ("h", "<i8"), ("digest", "<i8"), ("a", "<u2")])
#: A window on its way to its shard. state: 0 one window, 1 one that stands for several equal ones, 2 one of those, which has what the first has.
ENTRY = np.dtype([("h", "<u8"), ("digest", "<u8"), ("rid", "<i8"), ("lo", "<u4"), ("n", "u1"), ("state", "u1"), ("hot", "u1")])


def fingerprints(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of a piece's documents: smallest hash, digest of their bytes, document, first position, positions."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    prefix = B.prefix_hash(data)
    _, down = B.powers(len(data))
    grams = B.mix((prefix[GRAM:] - prefix[:-GRAM]) * down[: len(prefix) - GRAM])
    w = LENGTH - GRAM + 1
    count = len(grams) - w + 1
    padded = np.full(-(-len(grams) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(grams)] = grams
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1]).ravel()
    least = np.minimum(behind[:count], ahead[w - 1 : w - 1 + count])
    step = np.zeros(count + 1, np.int32)
    begin, stop = at[:-1], at[1:] - LENGTH + 1
    long = stop > begin
    np.add.at(step, begin[long], 1)
    np.add.at(step, stop[long], -1)
    valid = np.cumsum(step[:-1]) > 0
    fresh = valid.copy()
    # a new window starts where the piece with the smallest hash changes: another value, or the old piece is left behind
    fresh[1:] &= (least[1:] != least[:-1]) | (grams[: count - 1] == least[:-1]) | ~valid[:-1]
    fresh[begin[long]] = True
    lo = np.flatnonzero(fresh)
    ends = valid.copy()
    ends[:-1] &= fresh[1:] | ~valid[1:]
    n = np.flatnonzero(ends) + 1 - lo
    doc = np.searchsorted(at, lo, side="right") - 1
    return least[lo], B.span_hash(prefix, lo, lo + n + LENGTH - 1), doc, lo - at[doc], n


def suffix_array(text: np.ndarray, target: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Target positions in the order of the depth bytes that start there, and the ranks of all positions of text at that depth.

    Larsson-Sadakane: positions sorted by their first bytes form groups; groups of more than one
    are sorted by the rank of the position as many bytes further on as are sorted so far, which
    doubles what is sorted. Positions closer than depth to the end are ranked as if zeros followed.
    """
    n = len(text)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = text
    word = np.zeros(n, np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | padded[i : i + n].astype(np.uint64)
    order = np.argsort(word)
    head = np.empty(n, bool)
    head[:1] = True
    head[1:] = word[order[1:]] != word[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    done = 8
    while done < depth:
        step = min(done, depth - done)
        # only groups that are not yet single are refined
        size = np.diff(np.append(np.flatnonzero(head), n))
        loose = np.repeat(size > 1, size)
        places = np.flatnonzero(loose)
        if not len(places):
            break
        members = order[places]
        further = np.zeros(len(members), np.int64)
        inside = members + step < n
        further[inside] = rank[members[inside] + step] + 1
        key = rank[members] * np.int64(n + 2) + further
        again = np.argsort(key)
        members, key = members[again], key[again]
        order[places] = members
        new = np.empty(len(key), bool)
        new[:1] = True
        new[1:] = key[1:] != key[:-1]
        head[places] = new
        rank = np.empty(n, np.int64)
        rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
        done += step
    return order[target[order]], rank


def common_prefixes(text: np.ndarray, order: np.ndarray, lane: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """For each entry of order the bytes (depth at most) it shares with the entry before it.

    Kasai's rule: if a position shares l bytes with its neighbour, the next position shares at
    least l - 1 with its own, provided the neighbour's successor is sorted and stands before it.
    The runs of consecutive positions (lane: start of each) advance side by side.
    """
    n = len(text)
    padded = np.zeros(n + depth + 16, np.uint8)
    padded[:n] = text
    place = np.full(n + 1, -1, np.int64)
    place[order] = np.arange(len(order))
    before = np.full(n + 1, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n + 1, np.int64)
    at, carry = lane.copy(), np.zeros(len(lane), np.int64)
    while len(at):
        other = before[at]
        length = np.where(other >= 0, carry, 0)
        grow = np.flatnonzero((other >= 0) & (length < depth))
        while len(grow):
            same = padded[at[grow] + length[grow]] == padded[other[grow] + length[grow]]
            grow = grow[same]
            length[grow] += 1
            grow = grow[length[grow] < depth]
        shared[at] = length
        going = place[at + 1] >= 0
        at, other, length = at[going] + 1, other[going], length[going]
        follows = (other >= 0) & (place[other + 1] >= 0) & (place[other + 1] < place[at])
        carry = np.where(follows, np.maximum(length - 1, 0), 0)
    return shared[order]


def repeats(strings: list[bytes], number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sort all LENGTH-byte strings of some windows: positions in their concatenation, the window of each,
    whether the string occurs at least twice (windows counting as often as number says), and the first of each group of equal ones."""
    text = np.frombuffer(b"".join(strings), np.uint8)
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    base = np.cumsum(size) - size
    n = size - LENGTH + 1
    target = np.zeros(len(text), bool)
    target[B.ragged(base, n)] = True
    order, _ = suffix_array(text, target)
    # a run of targets ends before LENGTH - 1 other positions, so runs are separate
    same = common_prefixes(text, order, base) >= LENGTH
    of = np.searchsorted(base, order, side="right") - 1
    group = np.cumsum(~same) - 1
    twice = np.bincount(group, weights=number[of])[group] >= 2 if len(group) else np.zeros(0, bool)
    return order, of, twice, ~same


def _intervals(h: np.ndarray, digest: np.ndarray, base: np.ndarray, at: np.ndarray, of: np.ndarray) -> list[pa.Array]:
    """Runs of consecutive positions: hash and digest of their window, first and last place in it."""
    order = np.argsort(at)
    at, of = at[order], of[order]
    if not len(at):
        return [pa.array([], pa.int64())] * 4
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1])
    start = np.flatnonzero(first)
    end = np.append(start[1:], len(at)) - 1
    w = of[start]
    return [pa.array(h[w]), pa.array(digest[w]), pa.array(at[start] - base[w]), pa.array(at[end] - base[w])]


def merged(lists: list[np.ndarray]) -> np.ndarray:
    """The strings of several sorted shards that two shards have, as far as their own shard doesn't know them as repeated.

    Two lists at a time: each string of the shorter one is looked for in the longer by binary search; those found are
    repeated in both, the others are put in at their places. So n strings of k shards take log k rounds.
    """
    out: list[np.ndarray] = []
    # bytes that sort like the two hashes, one after the other; the last byte keeps numpy from cutting zeros off
    todo = [(_sortable(x), x.copy()) for x in lists]
    while len(todo) > 1:
        todo.sort(key=lambda t: len(t[1]))
        (few, x), (many, y) = todo[0], todo[1]
        at = np.searchsorted(many, few)
        same = at < len(many)
        same[same] = many[at[same]] == few[same]
        other = at[same]
        out += [x[same][x["known"][same] == 0], y[other][y["known"][other] == 0]]
        y["known"][other] = 1
        fresh = ~same
        todo[:2] = [(np.insert(many, at[fresh], few[fresh]), np.insert(y, at[fresh], x[fresh]))]
    return np.concatenate([np.zeros(0, STRING), *out])


def _sortable(e: np.ndarray) -> np.ndarray:
    raw = np.full((len(e), 17), 1, np.uint8)
    for i, c in enumerate(("key", "more")):
        raw[:, 8 * i : 8 * i + 8] = np.ascontiguousarray(e[c]).astype(">u8").view(np.uint8).reshape(-1, 8)
    return raw.view("S17").ravel()


_SECOND = np.random.Generator(np.random.PCG64(7)).permutation(256).astype(np.uint8)


def spans(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with one more column, whose name comes second: the removed byte ranges (start, end) of each row, null where there are none."""
    spark = docs.sparkSession
    small_batches(spark)
    key, name = free_name(docs, "_rid"), free_name(docs, "_spans")
    rows = keyed(docs, "documents", key)
    nb = buckets(rows)
    ranges = max(1, nb // 8)
    texts = rows.select(F.col(key).alias("_rid"), F.col("text").cast("string").alias("text"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, at in B.pieces(batch.column("text")):
                h, digest, _, _, _ = fingerprints(data, at)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(digest.view(np.int64))], ["h", "digest"])

    often = bounded_sample(texts, SAMPLE_DOCS, "_rid").mapInArrow(hashes, "h long, digest long").distinct().groupBy("h").count().where(F.col("count") >= SAMPLE_TIMES).select("h").collect()
    spread = spark.sparkContext.broadcast(np.sort(np.array([r["h"] for r in often], np.int64).view(np.uint64)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flushed() -> pa.RecordBatch:
            e = np.concatenate(held)
            held.clear()
            # one of several equal windows goes on to its shard, the others are spread by document
            pair = B.mix(e["h"] ^ (e["digest"] * np.uint64(0x9E3779B97F4A7C15)))
            _, first, back, times = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
            e["state"] = np.where(times[back] > 1, 2, 0)
            e["state"][first[times > 1]] = 1
            e["hot"] = np.isin(e["h"], spread.value)
            rid = np.ascontiguousarray(e["rid"]).view(np.uint64)
            b = (np.where(e["state"] == 2, B.mix(rid), np.where(e["hot"] == 1, e["digest"], e["h"])) % np.uint64(nb)).astype(np.int32)
            order = np.argsort(b, kind="stable")
            e, b = e[order], b[order]
            cut = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
            return pa.RecordBatch.from_arrays([pa.array(b[cut]), B.binary_array([x.tobytes() for x in np.split(e, cut[1:])])], ["b", "blob"])

        for batch in batches:
            rid = batch.column("_rid").to_numpy()
            for i, _, data, at in B.pieces(batch.column("text")):
                h, digest, doc, lo, n = fingerprints(data, at)
                if len(h):
                    e = np.empty(len(h), ENTRY)
                    e["h"], e["digest"], e["rid"], e["lo"], e["n"], e["state"], e["hot"] = h, digest, rid[i + doc], lo, n, 0, 0
                    held.append(e)
                if sum(map(len, held)) >= FLUSH:
                    yield flushed()
        if held:
            yield flushed()

    def members(group: pa.Table) -> pa.Table:
        e = np.frombuffer(b"".join(group.column("blob").to_pylist()), ENTRY)
        more, e = e[e["state"] == 2], e[e["state"] < 2]
        _, back = np.unique(e["h"], return_inverse=True)
        n = np.bincount(back, weights=1 + e["state"]) if len(e) else np.zeros(0)
        # windows of a spread hash may have others elsewhere
        e = e[(n[back] > 1) | (e["hot"] == 1)]
        e = e[np.lexsort((e["lo"], e["rid"], e["digest"], e["h"]))]
        new_h = np.ones(len(e), bool)
        new_h[1:] = e["h"][1:] != e["h"][:-1]
        rep = new_h.copy()
        rep[1:] |= e["digest"][1:] != e["digest"][:-1]
        which, kind = np.cumsum(new_h) - 1, np.cumsum(rep) - 1
        variants = np.bincount(which[rep], minlength=which[-1] + 1 if len(which) else 0)[which] if len(e) else np.zeros(0, np.int64)
        number = np.bincount(kind, weights=1 + e["state"])[kind] if len(e) else np.zeros(0, np.int64)
        hot = (variants > HOT) | (e["hot"] == 1)
        if len(more):
            e = np.concatenate([e, more])
            fill = lambda x, v: np.concatenate([x, np.full(len(more), v, x.dtype)])
            rep, number, hot = fill(rep, False), fill(number, 2), fill(hot, False)
        as_long = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))
        return pa.table([*(as_long(e[c]) for c in ("rid", "h", "digest", "lo", "n")), pa.array(rep), as_long(np.minimum(number, 2)), pa.array(hot)], ["_rid", "h", "digest", "lo", "n", "rep", "number", "hot"])

    found = materialize(texts.mapInArrow(find, "b int, blob binary").groupBy("b").applyInArrow(members, "_rid long, h long, digest long, lo long, n long, rep boolean, number long, hot boolean"), "windows")

    # one of each kind of window is fetched from its document
    wanted = found.where("rep").groupBy("_rid").agg(F.collect_list(F.struct("h", "digest", "lo", "n", "number", "hot")).alias("want"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, digest, number, hot, string = [], [], [], [], []
            for text, want in zip(batch.column("text").to_pylist(), batch.column("want").to_pylist()):
                raw = text.encode()
                for x in want:
                    h.append(x["h"])
                    digest.append(x["digest"])
                    number.append(x["number"])
                    hot.append(x["hot"])
                    string.append(raw[x["lo"] : x["lo"] + x["n"] + LENGTH - 1])
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(digest, pa.int64()), pa.array(number, pa.int64()), pa.array(hot, pa.bool_()), B.binary_array(string)], ["h", "digest", "number", "hot", "bytes"])

    fetched = texts.join(wanted.hint("shuffle_hash"), "_rid").mapInArrow(fetch, "h long, digest long, number long, hot boolean, bytes binary")
    fetched = fetched.withColumn("shard", F.pmod(F.when(F.col("hot"), F.col("digest")).otherwise(F.col("h")), F.lit(nb)).cast("int"))

    def columns(table: pa.Table):
        h, digest, number = (table.column(c).to_numpy() for c in ("h", "digest", "number"))
        return h, digest, number, table.column("bytes").to_pylist()

    def sort_shard(group: pa.Table) -> pa.Table:
        h, digest, number, strings = columns(group)
        hot = group.column("hot")[0].as_py()
        order = np.lexsort((digest, h))
        h, digest, number, strings = h[order], digest[order], number[order], [strings[i] for i in order.tolist()]
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        out: list[pa.Table] = []
        i = 0
        while i < len(strings):
            # whole hashes, about SORT_BYTES of them
            j = i + max(1, int(np.searchsorted(np.cumsum(size[i:]), SORT_BYTES)))
            while j < len(strings) and h[j] == h[j - 1]:
                j += 1
            base = np.cumsum(size[i:j]) - size[i:j]
            at, of, twice, first = repeats(strings[i:j], number[i:j])
            names = ["h", "digest", "a", "z", "range", "strings"]
            runs = _intervals(h[i:j], digest[i:j], base, at[twice], of[twice])
            out.append(pa.table([*runs, pa.nulls(len(runs[0]), pa.int32()), pa.nulls(len(runs[0]), pa.binary())], names))
            if hot:
                # one entry for each different string, for the merge with other shards
                text = np.frombuffer(b"".join(strings[i:j]), np.uint8)
                p, w = at[first], of[first]
                e = np.empty(len(p), STRING)
                e["key"], e["more"] = (B.span_hash(B.prefix_hash(t), p, p + LENGTH) for t in (text, _SECOND[text]))
                e["known"], e["h"], e["digest"], e["a"] = twice[first], h[i:j][w], digest[i:j][w], p - base[w]
                part = (e["key"] % np.uint64(ranges)).astype(np.int32)
                order = np.lexsort((e["more"], e["key"], part))
                e, part = e[order], part[order]
                cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                gap = pa.nulls(len(cut), pa.int64())
                out.append(pa.table([gap, gap, gap, gap, pa.array(part[cut]), B.binary_array([x.tobytes() for x in np.split(e, cut[1:])])], names))
            i = j
        return pa.concat_tables(out)

    schema = "h long, digest long, a long, z long, range int, strings binary"
    sorted_shards = materialize(fetched.groupBy("shard", "hot").applyInArrow(sort_shard, schema), "suffixes")

    def merge(group: pa.Table) -> pa.Table:
        hit = merged([np.frombuffer(x, STRING) for x in group.column("strings").to_pylist()])
        columns = [pa.array(np.ascontiguousarray(hit[c]).astype(np.int64)) for c in ("h", "digest", "a", "a")]
        return pa.table(columns, ["h", "digest", "a", "z"])

    across = sorted_shards.where("strings is not null").select("range", "strings").groupBy("range").applyInArrow(merge, "h long, digest long, a long, z long")
    runs = sorted_shards.where("strings is null").select("h", "digest", "a", "z").union(across)
    ranges_of = found.select("_rid", "h", "digest", "lo").join(runs.hint("merge"), ["h", "digest"]).select("_rid", (F.col("lo") + F.col("a")).alias("start"), (F.col("lo") + F.col("z") + LENGTH).alias("end"))
    cut = ranges_of.groupBy("_rid").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    cut = cut.select(F.col("_rid").alias(key), F.col("_spans").alias(name))
    return rows.join(cut.hint("shuffle_hash"), key, "left").select(*docs.columns, name), name


def _joined(values: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted((v["start"], v["end"]) for v in values or ()):
        if out and a <= out[-1][1]:
            if z > out[-1][1]:
                out[-1] = (out[-1][0], z)
        else:
            out.append((a, z))
    return out


def _kept(raw: bytes, removed: list[tuple[int, int]]) -> bytes:
    ends = [0, *(z for _, z in removed)]
    return b"".join(raw[a:z] for a, z in zip(ends, [*(a for a, _ in removed), len(raw)]))


def removal_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs.

    A byte is removed if a string of LENGTH bytes that covers it also starts anywhere else, in
    the same document or another; strings are judged on the input. A null or empty text has no
    bytes; a very long one is a piece of its own and treated as a whole. Repeated rows are documents of
    their own, so their long strings repeat, and nothing is the first or the one to keep (no ties); a null doc_id is kept. Columns besides doc_id and text play no part. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, digest = [], [], [], []
            for text, values in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist()):
                raw = (text or "").encode()
                removed = _joined(values)
                n_bytes.append(len(raw))
                n_removed.append(sum(z - a for a, z in removed))
                n_spans.append(len(removed))
                digest.append(hashlib.sha256(_kept(raw, removed)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    marked, _ = spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return marked.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with what removal_digest() counts cut out of text; n_chars, if there, is counted anew.

    A character of which a byte is cut is dropped as a whole. Documents of which no word is left
    are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, values in zip(batch.column("text").to_pylist(), batch.column(name).to_pylist()):
                removed = _joined(values)
                out.append(_kept(text.encode(), removed).decode("utf-8", "ignore") if removed and text is not None else text)
            names = [c for c in batch.schema.names if c != name]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in names], names)

    marked, name = spans(docs)
    marked = marked.withColumn("text", F.col("text").cast("string"))
    cut = marked.mapInArrow(run, marked.drop(name).schema).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)
