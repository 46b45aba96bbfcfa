"""Mergeable radix tries over the bytes of terms, with a leaf's documents and occurrences by source.

A trie is held and travels in the order of its leaves, which is that of their UTF-8 bytes: a leaf
branches off after the bytes that it shares with the leaf before it, and its label is the rest. Tries
merge leaf by leaf, are cut at borders between prefixes, and are traversed in byte order.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Leaves and bytes of labels in one row of a table of tries.
LEAVES, LABEL_BYTES = 1024, 1 << 20
SCHEMA = "lang string, low binary, leaves long, shared binary, label binary, label_size binary, docs binary, size binary, source binary, count binary, sources array<string>"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Shared bytes are compared for all neighbours at once up to here, beyond it pair by pair.
_STEPS = 40


def shared_bytes(terms: pa.Array) -> np.ndarray:
    """How many bytes each term shares with the one before it."""
    data, at = _buffers(terms)
    out = np.zeros(len(terms), np.int64)
    if len(terms) < 2:
        return out
    most = np.zeros(len(terms), np.int64)
    size = np.diff(at)
    most[1:] = np.minimum(size[1:], size[:-1])
    alive = np.flatnonzero(most > 0)
    for d in range(_STEPS):
        alive = alive[data[at[alive] + d] == data[at[alive - 1] + d]]
        out[alive] = d + 1
        alive = alive[most[alive] > d + 1]
        if not len(alive):
            return out
    for i in alive.tolist():
        a, b = data[at[i - 1] : at[i - 1] + most[i]], data[at[i] : at[i] + most[i]]
        differ = np.flatnonzero(a != b)
        out[i] = differ[0] if len(differ) else most[i]
    return out


def _buffers(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = terms.buffers()
    at = np.frombuffer(offsets, np.int64)[terms.offset : terms.offset + len(terms) + 1] if len(terms) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def term_array(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Terms from their bytes, one after another, and their offsets."""
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


class Trie:
    """terms in byte order (of a trie that merge() made), the documents of each, and its occurrences by source as runs at[i] .. at[i + 1]."""

    def __init__(self, terms: pa.Array, docs: np.ndarray, at: np.ndarray, source: np.ndarray, count: np.ndarray, sources: list[str]) -> None:
        self.terms, self.docs, self.at, self.source, self.count, self.sources = terms, docs, at, source, count, sources

    def __len__(self) -> int:
        return len(self.terms)

    def part(self, i: int, j: int) -> Trie:
        a, b = self.at[i], self.at[j]
        return Trie(self.terms.slice(i, j - i), self.docs[i:j], self.at[i : j + 1] - a, self.source[a:b], self.count[a:b], self.sources)

    def kept(self, keep: np.ndarray) -> Trie:
        """The leaves that keep marks."""
        size = np.diff(self.at)
        own = np.repeat(keep, size)
        return Trie(self.terms.filter(pa.array(keep)), self.docs[keep], np.concatenate([[0], np.cumsum(size[keep])]), self.source[own], self.count[own], self.sources)

    def cut(self, borders: list[bytes]) -> Iterator[tuple[int, Trie]]:
        """The subtries between borders (sorted): number of borders at or below their terms, and the trie."""
        terms = self.terms.to_pylist()
        ends = [bisect_left(terms, b) for b in borders] + [len(terms)]
        start = 0
        for k, end in enumerate(ends):
            if end > start:
                yield k, self.part(start, end)
            start = max(start, end)

    def rows(self, lang: str) -> Iterator[dict]:
        """Rows of a table of tries, each a trie of its own with a bounded number of leaves and bytes."""
        data, at = _buffers(self.terms)
        i = 0
        while i < len(self):
            j = min(i + LEAVES, max(i + 1, int(np.searchsorted(at, at[i] + LABEL_BYTES, side="right")) - 1))
            yield self.part(i, j)._row(lang)
            i = j

    def _row(self, lang: str) -> dict:
        shared = shared_bytes(self.terms)
        data, at = _buffers(self.terms)
        size = np.diff(at)
        begin = at[:-1] + shared
        tail = size - shared
        place = np.arange(int(tail.sum()), dtype=np.int64) + np.repeat(begin - (np.cumsum(tail) - tail), tail)
        used, own = np.unique(self.source, return_inverse=True)
        return {
            "lang": lang,
            "low": data[at[0] : at[1]].tobytes()[:BORDER_BYTES],
            "leaves": len(self),
            "shared": shared.astype(np.int32).tobytes(),
            "label": data[place].tobytes(),
            "label_size": tail.astype(np.int32).tobytes(),
            "docs": self.docs.astype(np.int64).tobytes(),
            "size": np.diff(self.at).astype(np.int32).tobytes(),
            "source": own.astype(np.int32).tobytes(),
            "count": self.count.astype(np.int64).tobytes(),
            "sources": [self.sources[k] for k in used],
        }


#: Bytes of a prefix that a border between subtries looks at.
BORDER_BYTES = 24


def from_row(row: dict) -> Trie:
    """The trie of a row: each leaf's term is what it shares with the one before it and its label."""
    label, at, word, words = row["label"], 0, b"", []
    for s, n in zip(np.frombuffer(row["shared"], np.int32).tolist(), np.frombuffer(row["label_size"], np.int32).tolist()):
        word = word[:s] + label[at : at + n]
        at += n
        words.append(word)
    size = np.frombuffer(row["size"], np.int32).astype(np.int64)
    return Trie(pa.array(words, pa.large_binary()), np.frombuffer(row["docs"], np.int64), np.concatenate([[0], np.cumsum(size)]), np.frombuffer(row["source"], np.int32), np.frombuffer(row["count"], np.int64), list(row["sources"]))


def merge(tries: list[Trie]) -> Trie:
    """One trie with the leaves of all, their documents and occurrences added up. The given ones may be in any order of terms."""
    names: dict[str, int] = {}
    maps = [np.array([names.setdefault(s, len(names)) for s in t.sources], np.int64) for t in tries]
    coded = pa.concat_arrays([t.terms for t in tries]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    leaf = rank[coded.indices.to_numpy()]
    docs = np.zeros(len(order), np.int64)
    np.add.at(docs, leaf, np.concatenate([t.docs for t in tries]))
    many = max(1, len(names))
    entry = np.repeat(leaf, np.concatenate([np.diff(t.at) for t in tries])) * many + np.concatenate([m[t.source] for m, t in zip(maps, tries)])
    own, back = np.unique(entry, return_inverse=True)
    count = np.zeros(len(own), np.int64)
    np.add.at(count, back, np.concatenate([t.count for t in tries]))
    return Trie(coded.dictionary.take(pa.array(order)), docs, np.searchsorted(own, np.arange(len(order) + 1) * many), (own % many).astype(np.int32), count, list(names))


def table(rows: Iterable[dict], **more: pa.Array) -> pa.RecordBatch:
    rows = list(rows)
    kinds = {"lang": pa.string(), "leaves": pa.int64(), "sources": pa.list_(pa.string())}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.binary())) for c in COLUMNS] + list(more.values()), COLUMNS + list(more))
