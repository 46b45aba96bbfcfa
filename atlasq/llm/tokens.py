"""Batched encoding with a public byte-level BPE tokenizer.

Texts are split into the tokenizer's words with array operations (its splitting pattern:
contractions, letters, digits, other signs, white space). The tokenizers library then encodes
each distinct word once in a worker, and documents are put together from those ids.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

from . import bytesops as B

LETTER, DIGIT, OTHER, BLANK = 1, 2, 0, 3
#: Fixed values of the splitting pattern: what may follow an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Distinct words that a worker remembers before it starts anew.
MOST_WORDS = 3_000_000
_SLOTS = 1 << 20


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _classes() -> np.ndarray:
    """The class of each code point."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            if b - a + 1 == len(m[0]):
                out[a : b + 1] = kind
            else:
                out[[ord(c) for c in m[0]]] = kind
    return out


@functools.cache
def _byte_letters() -> dict[int, str]:
    """The letters that stand for the 256 bytes in a byte-level vocabulary: printable ones stand for themselves, others follow from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


def split(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where words start: code holds code points, first marks the first one of each document."""
    n = len(code)
    if not n:
        return np.zeros(0, bool)
    kind = _classes()[code]
    fresh = np.empty(n, bool)
    fresh[0] = True
    np.not_equal(kind[1:], kind[:-1], out=fresh[1:])
    fresh |= first
    blank = kind == BLANK
    # the last blank before something else in the same document is a word of its own, or the head of the next one if it is a space
    last = np.zeros(n, bool)
    last[:-1] = blank[:-1] & ~blank[1:] & ~first[1:]
    fresh |= last
    after = np.zeros(n, bool)
    after[1:] = last[:-1] & (code[:-1] == 32)
    fresh &= ~after
    quotes = np.flatnonzero((code == 39) & fresh)
    if len(quotes):
        ends = np.append(np.flatnonzero(first)[1:], n)
        limit = ends[np.searchsorted(ends, quotes, side="right")]
        for q, end in zip(quotes.tolist(), limit.tolist()):
            for tail in CONTRACTIONS:
                stop = q + 1 + len(tail)
                if stop <= end and all(code[q + 1 + i] == ord(c) for i, c in enumerate(tail)):
                    fresh[q + 1] = False
                    if stop < end and kind[stop] == LETTER:
                        fresh[stop] = True
                    break
    return fresh


class Encoder:
    """Encodes Arrow string columns; one per worker and file, see encoder()."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.model._resize_cache(0)
        self.specials = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.vocabulary = self.whole.get_vocab_size()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.keys = [np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.uint64)]
        self.where = [np.full(_SLOTS, -1, np.int32), np.full(_SLOTS, -1, np.int32)]
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def _learn(self, key: int, text: bytes) -> int:
        letters = _byte_letters()
        ids = [t.id for t in self.model.tokenize("".join(map(letters.__getitem__, text)))]
        at = len(self.known)
        if at == len(self.start):
            self.start, self.length = np.resize(self.start, 2 * at), np.resize(self.length, 2 * at)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used : self.used + len(ids)] = ids
        self.start[at], self.length[at] = self.used, len(ids)
        self.used += len(ids)
        self.known[key] = at
        for shift, keys, where in zip((0, 24), self.keys, self.where):
            slot = (key >> shift) & (_SLOTS - 1)
            if where[slot] < 0:
                keys[slot], where[slot] = key, at
                break
        return at

    def _find(self, key: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.full(len(key), -1, np.int32)
        todo = np.arange(len(key))
        for shift, keys, where in zip((0, 24), self.keys, self.where):
            slot = ((key[todo] >> np.uint64(shift)) & np.uint64(_SLOTS - 1)).astype(np.int64)
            hit = (keys[slot] == key[todo]) & (where[slot] >= 0)
            out[todo[hit]] = where[slot[hit]]
            todo = todo[~hit]
        if len(todo):
            own, at, back = np.unique(key[todo], return_index=True, return_inverse=True)
            found = np.empty(len(own), np.int32)
            raw = None
            for i, (k, j) in enumerate(zip(own.tolist(), todo[at].tolist())):
                place = self.known.get(k)
                if place is None:
                    raw = raw or data.tobytes()
                    place = self._learn(k, raw[start[j] : end[j]])
                found[i] = place
            out[todo] = found[back]
        return out

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a piece's documents (bytes and offsets), one after another, and their offsets."""
        docs = len(at) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(docs + 1, np.int64)
        raw = data.tobytes()
        if any(s in raw for s in self.specials):
            parts = [self.whole.encode(raw[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids for a, b in zip(at[:-1], at[1:])]
            return np.array([x for p in parts for x in p], np.uint32), np.cumsum([0, *map(len, parts)])
        if len(self.known) > MOST_WORDS:
            self._forget()
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        code = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        first = np.zeros(len(code) + 1, bool)
        first[np.searchsorted(lead, at[:-1])] = True
        start = lead[split(code, first[:-1])]
        end = np.append(start[1:], len(data))
        place = self._find(B.span_hash(B.prefix_hash(data), start, end), data, start, end)
        length = self.length[place]
        ids = self.pool[B.ragged(self.start[place], length)]
        total = np.zeros(len(place) + 1, np.int64)
        np.cumsum(length, out=total[1:])
        return ids, total[np.searchsorted(start, at)]


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def with_end(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same documents with one more id at the end of each."""
    docs = len(at) - 1
    out = np.empty(len(ids) + docs, np.uint32)
    is_end = np.zeros(len(out), bool)
    new = at + np.arange(docs + 1)
    is_end[new[1:] - 1] = True
    out[is_end] = end_id
    out[~is_end] = ids
    return out, new


def encoded(column: pa.Array, path: str, end_id: int):
    """For each piece of a string column: its first row, the ids with end_id after each document, their offsets."""
    coder = encoder(path)
    for i, _, data, at in B.pieces(column):
        yield i, *with_end(*coder.encode(data, at), end_id)
