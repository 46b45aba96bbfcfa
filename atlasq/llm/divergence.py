"""Divergence of sources: how far the terms of each source are from those of the others of its language, exactly."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytesops as B
from . import tries
from .store import bounded_sample, buckets, materialize, small_batches

#: A language keeps the terms that so many of its documents have; each source's terms are told to this rank.
LEAST_DOCS, TOP = 3, 200
#: Shares are in parts of SCALE, which is STEP to the third power.
SCALE, STEP = 1_000_000_000, 1000
#: Entries that a task holds of tries before it merges them; a merged trie larger than half of this is handed on.
MOST_ENTRIES = 2_000_000
#: Prefix ranges, and the sampled prefixes that tell their borders (they only steer which task merges what).
MOST_RANGES, SAMPLED = 1 << 14, 1 << 16
#: Groups (lang, source) whose totals a task holds at once; more are paired block by block.
BLOCK = 2048
#: Cells of a matrix of terms and sources worked on at once.
CELLS = 1 << 19

#: Bytes outside terms: ASCII other than letters.
OUTSIDE = np.ones(256, bool)
OUTSIDE[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tries of a task's documents by language: each distinct term of a piece is counted by arrays and put into the language's trie."""
    held: dict[str, list[tries.Trie]] = {}
    entries: dict[str, int] = {}

    def rows(lang: str, trie: tries.Trie) -> Iterator[pa.RecordBatch]:
        own = list(trie.rows(lang))
        for i in range(0, len(own), 64):
            yield tries.table(own[i : i + 64])

    for batch in batches:
        lang = batch.column("lang").fill_null("").dictionary_encode()
        source = batch.column("source").fill_null("").dictionary_encode()
        langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
        lang_of, source_of = lang.indices.to_numpy(), source.indices.to_numpy()
        for i, j, data, at in B.pieces(batch.column("text")):
            low = B.LOWER[data]
            start, end, first = B.words(low, at, OUTSIDE)
            if not len(start):
                continue
            coded = tries.term_array(low[~OUTSIDE[low]], np.concatenate([[0], np.cumsum(end - start)])).dictionary_encode()
            n = len(coded.dictionary)
            of = np.repeat(np.arange(j - i), np.diff(first))
            # occurrences by document and term, then by source and term, and documents by term, of each language
            pair, many = np.unique(of * n + coded.indices.to_numpy(), return_counts=True)
            doc, term = pair // n, pair % n
            for k in np.unique(lang_of[i:j]).tolist():
                mine = lang_of[i:j][doc] == k
                if not mine.any():
                    continue
                t, s, c = term[mine], source_of[i:j][doc[mine]], many[mine]
                used, leaf = np.unique(t, return_inverse=True)
                key, back = np.unique(leaf * len(sources) + s, return_inverse=True)
                count = np.zeros(len(key), np.int64)
                np.add.at(count, back, c)
                spread = np.searchsorted(key, np.arange(len(used) + 1) * len(sources))
                own = tries.Trie(coded.dictionary.take(pa.array(used)), np.bincount(leaf, minlength=len(used)), spread, key % len(sources), count, sources)
                name = langs[k]
                held.setdefault(name, []).append(own)
                entries[name] = entries.get(name, 0) + len(key)
        if sum(entries.values()) > MOST_ENTRIES:
            for name in list(held):
                held[name] = [tries.merge(held[name])]
                entries[name] = len(held[name][0].count)
            if sum(entries.values()) > MOST_ENTRIES // 2:
                for name in sorted(held):
                    yield from rows(name, held[name][0])
                held, entries = {}, {}
    for name in sorted(held):
        yield from rows(name, tries.merge(held[name]))


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """A table of tries with the terms in at least least_docs documents of their language, with their documents and occurrences by source.

    Tasks count terms into tries, cut them at borders between prefixes, and each prefix range of a
    language is merged by one task, a bounded number of leaves at a time. Borders come from a sample of the tries' first terms.
    """
    spark = docs.sparkSession
    parts = materialize(docs.mapInArrow(counted, tries.SCHEMA), "tries", "zstd")
    ranges = min(MOST_RANGES, 2 * buckets(docs))
    seen = sorted((r["lang"], bytes(r["low"])) for r in bounded_sample(parts.select("lang", "low"), SAMPLED, "lang", "low").collect())
    borders = sorted({seen[k * len(seen) // ranges] for k in range(1, ranges)} if seen else set())
    told = spark.sparkContext.broadcast(borders)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, where = [], []
            for row in batch.to_pylist():
                lang = row["lang"]
                a, b = bisect_left(told.value, (lang, b"")), bisect_left(told.value, (lang + "\0", b""))
                for k, trie in tries.from_row(row).cut([x for _, x in told.value[a:b]]):
                    for own in trie.rows(lang):
                        found.append(own)
                        where.append(a + k)
            if found:
                yield tries.table(found, range=pa.array(where, pa.int64()))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tries.Trie] = []
        at, entries = None, 0

        def done() -> Iterator[pa.RecordBatch]:
            whole = tries.merge(held)
            whole = whole.kept(whole.docs >= least_docs)
            if len(whole):
                yield tries.table(whole.rows(at[1]))

        for batch in batches:
            for row in batch.to_pylist():
                if (row["range"], row["lang"]) != at:
                    if held:
                        yield from done()
                    at, held, entries = (row["range"], row["lang"]), [], 0
                held.append(tries.from_row(row))
                entries += len(held[-1].count)
                if entries > MOST_ENTRIES:
                    held = [tries.merge(held)]
                    entries = min(len(held[0].count), MOST_ENTRIES // 2)
        if held:
            yield from done()

    dealt = parts.mapInArrow(cut, f"{tries.SCHEMA}, range long").repartition(ranges, "range").sortWithinPartitions("range", "lang")
    return materialize(dealt.mapInArrow(merged, tries.SCHEMA), "kept-tries", "zstd")


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, n, terms, lang_n, block for every group that occurs: occurrences of kept terms in it, kept terms and their occurrences of its language."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, str | None], int] = {}
        for batch in batches:
            for row in batch.to_pylist():
                count, own = np.frombuffer(row["count"], np.int64), np.frombuffer(row["source"], np.int32)
                total = np.zeros(len(row["sources"]), np.int64)
                np.add.at(total, own, count)
                for source, x in zip(row["sources"], total.tolist()):
                    n[row["lang"], source] = n.get((row["lang"], source), 0) + x
                n[row["lang"], None] = n.get((row["lang"], None), 0) + row["leaves"]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n]), pa.array([k[1] for k in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["lang", "source", "n"])

    summed = materialize(kept.mapInArrow(sums, "lang string, source string, n long").groupBy("lang", "source").agg(F.sum("n").alias("n")), "trie-sums")
    groups = docs.select("lang", "source").distinct()
    own = summed.where("source is not null")
    by_lang = summed.groupBy("lang").agg(F.sum(F.when(F.col("source").isNull(), F.col("n"))).alias("terms"), F.coalesce(F.sum(F.when(F.col("source").isNotNull(), F.col("n"))), F.lit(0)).alias("lang_n"))
    out = groups.join(own, ["lang", "source"], "left").join(by_lang, "lang", "left")
    return out.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "terms", "lang_n")))


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total) in long division by STEP, exact for totals below 9 * 10**15."""
    rest, out = count + 1, np.zeros(np.broadcast_shapes(count.shape, total.shape), np.int64)
    for _ in range(3):
        rest = rest * STEP
        digit = rest // total
        out = out * STEP + digit
        rest = rest - digit * total
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class _Sources:
    """The groups of one language in a block: names, their places, totals."""

    def __init__(self, rows: list) -> None:
        self.names = [r["source"] for r in rows]
        self.place = {s: k for k, s in enumerate(self.names)}
        self.total = np.array([r["n"] + r["terms"] for r in rows], np.int64)
        self.lang_total = rows[0]["lang_n"] + rows[0]["terms"] if rows else 0


def _by_lang(rows: list) -> dict[str, _Sources]:
    own: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["source"])):
        own.setdefault(r["lang"], []).append(r)
    return {k: _Sources(v) for k, v in own.items()}


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank for every group (lang, source) of docs.

    Part `pair` has a row for each other source of the language: the sum over the language's kept terms of
    floor((p - q)^2 / q), p and q being the terms' smoothed shares in the group and in the other source, in
    parts of SCALE. Part `term` has the group's kept terms whose share is above the language's, by their
    distance to it, to rank top. Ranks go by value, falling, then by the item's UTF-8 bytes.

    A null text, lang or source counts as an empty one. Empty texts make a group without terms, whose shares are
    all alike; a language without kept terms has pairs of value 0. Very long texts and terms count whole; repeated
    rows are documents of their own. Columns besides text, lang and source play no part. An empty table
    gives an empty result. Groups' totals reach tasks by blocks of about block groups, whatever their number.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = kept_terms(slim, least_docs)
    groups = materialize(group_totals(slim, kept), "trie-groups")
    blocks = max(1, -(-groups.count() // block))
    own_block = F.pmod(F.xxhash64("lang", "source"), F.lit(blocks))
    read = [spark.sparkContext.broadcast(_by_lang(groups.where(own_block == k).collect())) for k in range(blocks)]
    found = None
    for i in range(blocks):
        for j in range(blocks):
            one, other = read[i], read[j]
            parts = kept.mapInArrow(_compared(one, other, top if not j else 0), RESULT).unionByName(groups.where(own_block == i).mapInArrow(_nothing(other), RESULT))
            found = parts if found is None else found.unionByName(parts)
    found = materialize(found, "divergence")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())).alias("rank")
    terms = found.where("part = 'term'").select("*", place).where(F.col("rank") <= top)
    return pairs.select("*", place).unionByName(terms)


RESULT = "lang string, source string, part string, item string, value long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:4]), pa.array(columns[4], pa.int64())], ["lang", "source", "part", "item", "value"])


def _nothing(other):
    """Pairs of value 0 for all groups, so that those without kept terms are there too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, source in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()):
                rows = [(lang, source, "pair", s, 0) for s in (other.value[lang].names if lang in other.value else ()) if s != source]
                if rows:
                    yield _batch(rows)

    return run


def _dense(trie: tries.Trie, sources: _Sources) -> np.ndarray:
    """Occurrences of a trie's leaves by the sources of a block."""
    out = np.zeros((len(trie), len(sources.names)), np.int64)
    column = np.array([sources.place.get(s, -1) for s in trie.sources], np.int64)[trie.source]
    row = np.repeat(np.arange(len(trie)), np.diff(trie.at))
    here = column >= 0
    out[row[here], column[here]] = trie.count[here]
    return out


def _compared(one, other, top: int):
    """Sums over a task's kept terms for the pairs of two blocks of groups, and the best terms of one's groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        best: dict[tuple[str, int], list[tuple[int, bytes]]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                lang = row["lang"]
                if lang not in one.value:
                    continue
                a, b = one.value[lang], other.value.get(lang)
                whole = tries.from_row(row)
                step = max(1, CELLS // max(len(a.names), len(b.names) if b else 1))
                for k in range(0, len(whole), step):
                    part = whole.part(k, min(k + step, len(whole)))
                    count = _dense(part, a)
                    p = share(count, a.total)
                    if b:
                        q = share(_dense(part, b), b.total)
                        if lang not in sums:
                            sums[lang] = np.zeros((len(a.names), len(b.names)), np.int64)
                        for x in range(len(a.names)):
                            sums[lang][x] += distance(p[:, x : x + 1], q).sum(0)
                    if top:
                        _candidates(part, lang, a, count, p, top, best)
        for lang, total in sums.items():
            a, b = one.value[lang], other.value[lang]
            for s, line in zip(a.names, total.tolist()):
                rows = [(lang, s, "pair", t, v) for t, v in zip(b.names, line) if s != t]
                if rows:
                    yield _batch(rows)
        for (lang, x), found in best.items():
            yield _batch([(lang, one.value[lang].names[x], "term", term.decode(), -v) for v, term in found])

    return run


def _candidates(part: tries.Trie, lang: str, a: _Sources, count: np.ndarray, p: np.ndarray, top: int, best: dict) -> None:
    """Take a trie's leaves into the lists of the top terms of each source; leaves come in byte order, so a stable sort orders ties."""
    size = np.diff(part.at)
    every = np.zeros(len(part), np.int64)
    np.add.at(every, np.repeat(np.arange(len(part)), size), part.count)
    q = share(every, np.array(a.lang_total, np.int64))[:, None]
    value = np.where((count > 0) & (p > q), distance(p, q), -1)
    for x in np.flatnonzero((value >= 0).any(0)).tolist():
        own = np.flatnonzero(value[:, x] >= 0)
        own = own[np.argsort(-value[own, x], kind="stable")[:top]]
        new = [(-int(v), t) for v, t in zip(value[own, x].tolist(), part.terms.take(pa.array(own)).to_pylist())]
        best[lang, x] = sorted(best.get((lang, x), []) + new)[:top]


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, source, term, count(*) AS c FROM w JOIN k USING (lang, term) GROUP BY w.lang, source, term),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (coalesce(n.n, 0) + v.v) AS p
    FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN n ON n.lang = g.lang AND n.source = g.source),
l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 1)) // ((SELECT sum(n) FROM n WHERE n.lang = p.lang) + (SELECT v FROM v WHERE v.lang = p.lang)) AS q FROM p GROUP BY lang, term),
x AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
    UNION ALL SELECT p.lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p JOIN l USING (lang, term) WHERE c > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM e)
SELECT * FROM o WHERE part = 'pair' OR rank <= 200
"""
