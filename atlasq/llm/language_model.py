"""Scores of documents under a log-bilinear model trained by noise-contrastive estimation, and under word counts.

The model predicts units: the most frequent words one by one, all others in classes. A word with LEARNT training tokens
is in a class by its last letters and so that classes have equally many such words; a rarer one is in that of its last letters. A token's probability is that of its unit given the words before it (log-bilinear, over
all units) times that of the word in its class given the words before it: counts plus one, with one place
for unseen words, times the exponential of a log-bilinear score, over their sum in the class. So
probabilities add up to 1 over all words. Each learnt word of a class has a target
and context embeddings of its own, so the model grows with the vocabulary; rarer ones have score 0. Counts cover all training documents. Training passes over
all of them: each task continues from one start model with its own documents, and the models'
parameters are averaged by the numbers of their tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .store import bounded_runs, buckets, materialize, small_batches, text_of, with_row_id

FOLDS, HELD_OUT = 7, 2
#: Words that are units of their own, and classes of the others.
OWN, CLASSES = 128, 192
UNITS = OWN + CLASSES
CONTEXT, WIDTH = 3, 16
#: The start model is trained on at most so many runs of so many characters of the training texts; all documents follow.
START_RUNS, START_CHARS = 400, 4000
NOISE, BATCH, RATE = 48, 2048, 0.05
#: Training tokens from which a word of a class has embeddings, most such words, noise words of its class a token.
LEARNT, WORDS, CLASS_NOISE = 20, 32_768, 4
#: Places from which the search for a drawn word begins in each class.
SLOTS = 1024
#: Parameters are averaged in chunks of this many.
CHUNK = 1 << 16
#: Counts of this many words at most go to every task; those of the others are joined.
FREQUENT = 300_000
FLUSH = 300_000
END = np.uint64(0xE0D0FD0C5EED5EED)
COUNT = np.dtype([("h", "<u8"), ("c", "<i8"), ("s", "u1")])
RARE = np.dtype([("h", "<u8"), ("rid", "<i8")])


def token_stream(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a piece's documents, each closed by an end token: hashes, classes by last letters, offsets by document."""
    docs = len(at) - 1
    low = B.LOWER[data]
    start, end, first = B.words(low, at)
    word = B.span_hash(B.prefix_hash(low), start, end)
    tail = np.zeros(len(word), np.uint64)
    for back in (1, 2, 3):
        there = end - back >= start
        tail = tail * np.uint64(257) + np.where(there, low[np.maximum(end - back, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0)) if len(word) else tail
    kind = (B.mix(tail) % np.uint64(CLASSES)).astype(np.uint8)
    offset = first + np.arange(docs + 1)
    h = np.empty(len(word) + docs, np.uint64)
    s = np.zeros(len(h), np.uint8)
    is_end = np.zeros(len(h), bool)
    is_end[offset[1:] - 1] = True
    h[is_end] = END
    h[~is_end], s[~is_end] = word, kind
    return h, s, offset


class Classes:
    """The learnt words sorted by class: edges of the classes, counts plus one, and those of all other words of each class with one place for unseen ones."""

    def __init__(self, edges: np.ndarray, weight: np.ndarray, total: np.ndarray) -> None:
        self.edges, self.weight = edges, weight
        self.heap = np.append(0.0, np.cumsum(weight, dtype=np.float64))
        self.rest = total - (self.heap[edges[1:]] - self.heap[edges[:-1]])
        self.total = total
        parts = self.heap[edges[:-1]][:, None] + np.arange(SLOTS) / SLOTS * total[:, None]
        found = np.searchsorted(self.heap, parts, side="right") - 1
        self.slots = np.minimum(np.maximum(found, edges[:-1][:, None]), edges[1:][:, None]).ravel()

    def draw(self, k: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """CLASS_NOISE words of each class in k by weight; the number of learnt words for any other word."""
        low, high = self.edges[k][:, None], self.edges[k + 1][:, None]
        # most of the search is done beforehand: where each SLOTS-th part of a class's weight begins
        x = rng.random((len(k), CLASS_NOISE))
        at = self.heap.take(low) + x * self.total.take(k)[:, None]
        found = self.slots.take((x * SLOTS).astype(np.int64) + k[:, None] * SLOTS)
        moving = np.flatnonzero((found < high) & (self.heap.take(found + 1, mode="clip") <= at))
        found, at, high = found.ravel(), at.ravel(), np.broadcast_to(high, found.shape).ravel()
        while len(moving):
            found[moving] += 1
            f = found[moving]
            moving = moving[(f < high[moving]) & (self.heap.take(f + 1, mode="clip") <= at[moving])]
        return np.where(found < high, found, len(self.weight)).reshape(len(k), CLASS_NOISE)


def _ascend(x: np.ndarray, seen: np.ndarray, at: np.ndarray, g: np.ndarray) -> None:
    """An AdaGrad step on the rows at of x but the last one; g may have several rows for one."""
    # two bytes hold the places of WORDS rows, which numpy sorts by digits
    order = np.argsort(at.astype(np.uint16) if len(x) <= 1 << 16 else at, kind="stable")
    at = at[order]
    n = int(np.searchsorted(at, len(x) - 1))
    if not n:
        return
    at = at[:n]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    rows, size = order[:n], np.diff(np.append(first, n))
    at = at[first]
    # most rows have one gradient; only those with several are summed
    several = np.flatnonzero(size > 1)
    own = g.take(rows[first], axis=0)
    if len(several):
        size = size[several]
        own[several] = np.add.reduceat(g.take(rows[B.ragged(first[several], size)], axis=0), np.cumsum(size) - size, axis=0)
    g = own
    sum_of_squares = seen.take(at, axis=0)
    sum_of_squares += g * g
    seen[at] = sum_of_squares
    np.sqrt(sum_of_squares, out=sum_of_squares)
    g *= np.float32(RATE)
    g /= sum_of_squares
    x[at] += g


def _logistic(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)), in place."""
    np.negative(x, out=x)
    np.minimum(x, np.float32(60), out=x)
    np.exp(x, out=x)
    x += np.float32(1)
    return np.reciprocal(x, out=x)


def _sums(at: np.ndarray, g: np.ndarray, rows: int) -> np.ndarray:
    """The rows of g added up by their places."""
    width = g.shape[1]
    place = (at[:, None] * width + np.arange(width)).ravel()
    return np.bincount(place, weights=g.ravel(), minlength=rows * width).reshape(rows, width).astype(np.float32)


class Model:
    """Context tables (CONTEXT, UNITS + 1, WIDTH; the last unit stands before a document), targets and biases.

    The same of the learnt words of classes: near (CONTEXT, words + 1, WIDTH) and inner (words + 1, WIDTH); the last one is no such word, its row 0.
    """

    def __init__(self, tables: np.ndarray, targets: np.ndarray, bias: np.ndarray, near: np.ndarray, inner: np.ndarray) -> None:
        self.tables, self.targets, self.bias, self.near, self.inner = tables, targets, bias, near, inner

    @staticmethod
    def start(share: np.ndarray, words: int = 0) -> Model:
        rng = np.random.Generator(np.random.PCG64(11))
        own = np.random.Generator(np.random.PCG64(12))
        near, inner = (own.normal(0, 0.1, shape).astype(np.float32) for shape in ((CONTEXT, words + 1, WIDTH), (words + 1, WIDTH)))
        near[:, -1] = inner[-1] = 0
        return Model(rng.normal(0, 0.1, (CONTEXT, UNITS + 1, WIDTH)).astype(np.float32), rng.normal(0, 0.1, (UNITS, WIDTH)).astype(np.float32), np.log(share).astype(np.float32), near, inner)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.tables, self.targets, self.bias, self.near, self.inner)])

    @staticmethod
    def of(flat: np.ndarray) -> Model:
        a, b = CONTEXT * (UNITS + 1) * WIDTH, UNITS * WIDTH
        rows = (len(flat) - a - b - UNITS) // (WIDTH * (CONTEXT + 1))
        flat = flat.astype(np.float32)
        tables, targets, bias, near, inner = np.split(flat, np.cumsum([a, b, UNITS, CONTEXT * rows * WIDTH]))
        return Model(tables.reshape(CONTEXT, UNITS + 1, WIDTH).copy(), targets.reshape(UNITS, WIDTH).copy(), bias.copy(), near.reshape(CONTEXT, rows, WIDTH).copy(), inner.reshape(rows, WIDTH).copy())

    def predicted(self, context: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        r = self.tables[0].take(context[0], axis=0)
        for i in range(1, CONTEXT):
            r += self.tables[i].take(context[i], axis=0)
        for i in range(CONTEXT if before is not None else 0):
            r += self.near[i].take(before[i], axis=0)
        return r

    def log_in_class(self, unit: np.ndarray, r: np.ndarray, word: np.ndarray, classes: Classes) -> np.ndarray:
        """For tokens of classes the natural logarithm of their words' probabilities in the class over counts plus one; 0 for others."""
        out = np.zeros(len(unit))
        # two bytes hold a unit; numpy sorts those by digits
        order = np.argsort(unit.astype(np.uint16), kind="stable")
        edge = np.searchsorted(unit[order], np.arange(OWN, UNITS + 1))
        for k in np.flatnonzero(np.diff(edge)):
            a, b = edge[k], edge[k + 1]
            low, high = classes.edges[k], classes.edges[k + 1]
            # scores of a step stay in a core's cache
            step = max(64, (1 << 16) // max(1, high - low))
            words, weight = np.ascontiguousarray(self.inner[low:high].T), classes.weight[low:high].astype(np.float32)
            for i in range(a, b, step):
                t = order[i : min(b, i + step)]
                own = r.take(t, axis=0)
                score = own @ words
                if score.max(initial=0) > 30:
                    np.minimum(score, np.float32(30), out=score)
                np.exp(score, out=score)
                total = score @ weight + classes.rest[k]
                out[t] = np.minimum(np.einsum("ij,ij->i", own, self.inner.take(word[t], axis=0)), 30) - np.log(total)
        return out

    def log_probabilities(self, unit: np.ndarray, predicted: np.ndarray) -> np.ndarray:
        """Natural logarithms of the units' normalised probabilities."""
        out = np.empty(len(unit))
        weights = np.ascontiguousarray(np.concatenate([self.targets, self.bias[:, None]], axis=1).T)
        ones = np.ones(UNITS, np.float32)
        for i in range(0, len(unit), 256):
            u = unit[i : i + 256]
            r = np.ones((len(u), WIDTH + 1), np.float32)
            r[:, :-1] = predicted[i : i + 256]
            score = r @ weights
            if score.max() > 60:
                np.minimum(score, np.float32(60), out=score)
            own = score[np.arange(len(u)), u]
            np.exp(score, out=score)
            out[i : i + 256] = own - np.log(score @ ones)
        return out


class Trainer:
    """Noise-contrastive estimation with AdaGrad steps; a batch shares its noise."""

    def __init__(self, model: Model, share: np.ndarray, seed: int, classes: Classes) -> None:
        self.classes = classes
        self.seen_words = [np.full(x.shape, 1e-7, np.float32) for x in (model.near, model.inner)]
        self.m, self.rng, self.tokens = model, np.random.Generator(np.random.PCG64(seed)), 0
        self.noise = np.log(NOISE * share).astype(np.float32)
        self.heap = np.cumsum(share)
        self.seen = [np.full(x.shape, 1e-7, np.float32) for x in (model.tables, model.targets, model.bias)]

    def step(self, unit: np.ndarray, context: np.ndarray, word: np.ndarray, before: np.ndarray) -> None:
        m, n = self.m, len(unit)
        drawn = np.minimum(np.searchsorted(self.heap, self.rng.random(NOISE) * self.heap[-1]), UNITS - 1)
        r = m.predicted(context, before)
        q, z = m.targets.take(unit, axis=0), m.targets[drawn]
        # a real token's chance of being taken for noise, a noise word's of being taken for real
        real = _logistic((self.noise - m.bias).take(unit) - np.einsum("ij,ij->i", r, q))
        fake = _logistic(r @ z.T - (self.noise - m.bias)[drawn])
        real /= np.float32(n)
        fake /= np.float32(n)
        back = real[:, None] * q
        back -= fake @ z
        # within classes the noise has the counts' shares, so a score's ratio to it is the log-bilinear part
        inside = np.flatnonzero(unit >= OWN)
        if len(inside) and len(m.inner) > 1:
            own = word.take(inside)
            other = self.classes.draw(unit.take(inside) - OWN, self.rng)
            mine, base = r.take(inside, axis=0), np.float32(np.log(CLASS_NOISE))
            w, v = m.inner.take(own, axis=0), m.inner.take(other, axis=0)
            up = _logistic(base - np.einsum("ij,ij->i", mine, w))
            down = _logistic(np.einsum("ij,ikj->ik", mine, v) - base)
            up /= np.float32(n)
            down /= np.float32(n)
            w *= up[:, None]
            w -= np.einsum("ik,ikj->ij", down, v)
            back[inside] += w
            g = np.empty((len(inside) * (1 + CLASS_NOISE), WIDTH), np.float32)
            np.multiply(up[:, None], mine, out=g[: len(inside)])
            np.multiply(-down[:, :, None], mine[:, None, :], out=g[len(inside) :].reshape(-1, CLASS_NOISE, WIDTH))
            _ascend(m.inner, self.seen_words[1], np.concatenate([own, other.ravel()]), g)
        for i in range(CONTEXT):
            _ascend(m.near[i], self.seen_words[0][i], before[i], back)
        targets, bias = _sums(unit, real[:, None] * r, UNITS), np.bincount(unit, weights=real, minlength=UNITS).astype(np.float32)
        np.add.at(targets, drawn, -(fake.T @ r))
        np.add.at(bias, drawn, -fake.sum(0))
        tables = np.stack([_sums(context[i], back, UNITS + 1) for i in range(CONTEXT)])
        for x, g, seen in zip((m.tables, m.targets, m.bias), (tables, targets, bias), self.seen):
            seen += g * g
            x += RATE * g / np.sqrt(seen)
        self.tokens += n

    def learn(self, unit: np.ndarray, context: np.ndarray, word: np.ndarray, before: np.ndarray) -> None:
        for i in range(0, len(unit), BATCH):
            self.step(unit[i : i + BATCH], context[:, i : i + BATCH], word[i : i + BATCH], before[:, i : i + BATCH])


def contexts(unit: np.ndarray, offset: np.ndarray, none: int = UNITS) -> np.ndarray:
    """For each token the units (or words) one, two, ... before it in its document."""
    place = np.arange(len(unit)) - np.repeat(offset[:-1], np.diff(offset))
    out = np.full((CONTEXT, len(unit)), none, np.int64)
    for i in range(CONTEXT):
        there = np.flatnonzero(place > i)
        out[i, there] = unit[there - i - 1]
    return out


def _sum_counts(parts: list[np.ndarray]) -> np.ndarray:
    e = np.concatenate(parts) if parts else np.zeros(0, COUNT)
    h, first, back = np.unique(e["h"], return_index=True, return_inverse=True)
    out = np.empty(len(h), COUNT)
    out["h"], out["s"] = h, e["s"][first]
    out["c"] = np.bincount(back, weights=e["c"].astype(np.float64), minlength=len(h)).astype(np.int64)
    return out


def _by_bucket(e: np.ndarray, nb: int) -> tuple[np.ndarray, list[bytes]]:
    b = (e["h"] % np.uint64(nb)).astype(np.int32)
    order = np.argsort(b, kind="stable")
    e, b = e[order], b[order]
    cut = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(e) else np.zeros(0, np.int64)
    return b[cut], [x.tobytes() for x in np.split(e, cut[1:])] if len(e) else []


def _lookup(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of h in the sorted keys, -1 where missing."""
    if not len(keys):
        return np.full(len(h), -1, np.int64)
    own, back = np.unique(h, return_inverse=True)
    at = np.searchsorted(keys, own)
    at[at == len(keys)] = 0
    return np.where(keys[at] == own, at, -1)[back]


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    A null or empty text has the end token alone. A null doc_id counts as a training document.
    Repeated rows are documents of their own. Very long texts are scored and learnt from whole; words of equal counts are
    ordered by their hashes. Columns besides doc_id and text play no part. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    nb = buckets(docs)
    rows = with_row_id(text_of(docs)).withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False)))
    train = rows.where("not held_out").select("doc_id", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for _, _, data, at in B.pieces(batch.column("text")):
                h, s, _ = token_stream(data, at)
                own, first, n = np.unique(h, return_index=True, return_counts=True)
                e = np.empty(len(own), COUNT)
                e["h"], e["c"], e["s"] = own, n, s[first]
                held.append(e)
                if sum(map(len, held)) > 2 * FLUSH:
                    held = [_sum_counts(held)]
                    if len(held[0]) > FLUSH:
                        b, blobs = _by_bucket(held.pop(), nb)
                        yield pa.RecordBatch.from_arrays([pa.array(b), B.binary_array(blobs)], ["b", "blob"])
        if held:
            b, blobs = _by_bucket(_sum_counts(held), nb)
            yield pa.RecordBatch.from_arrays([pa.array(b), B.binary_array(blobs)], ["b", "blob"])

    quota = 2 * FREQUENT // nb + 8

    def total(group: pa.Table) -> pa.Table:
        e = _sum_counts([np.frombuffer(x, COUNT) for x in group.column("blob").to_pylist()])
        top = e[np.argsort(-e["c"], kind="stable")[:quota]]
        of_class = [np.bincount(e["s"], weights=w, minlength=CLASSES).astype(np.int64).tolist() for w in (e["c"].astype(np.float64), None)]
        return pa.table([group.column("b").slice(0, 1), pa.array([int(e["c"].sum())], pa.int64()), pa.array([len(e)], pa.int64()), pa.array([of_class[0]], pa.list_(pa.int64())), pa.array([of_class[1]], pa.list_(pa.int64())), B.binary_array([top.tobytes()]), B.binary_array([e.tobytes()])], ["b", "tokens", "words", "class_tokens", "class_words", "top", "blob"])

    counts = materialize(train.mapInArrow(count, "b int, blob binary").groupBy("b").applyInArrow(total, "b int, tokens long, words long, class_tokens array<long>, class_words array<long>, top binary, blob binary"), "word-counts")
    told = counts.drop("blob").collect()  # as many rows as buckets, each with a bounded list of words
    n_train, n_words = sum(r["tokens"] for r in told), sum(r["words"] for r in told)
    top = np.concatenate([np.frombuffer(bytes(r["top"]), COUNT) for r in told]) if told else np.zeros(0, COUNT)
    top = top[np.lexsort((top["h"], -top["c"]))][:FREQUENT]
    own = top[:OWN]
    rest = top[OWN:]
    rest = rest[rest["c"] >= LEARNT][:WORDS]
    # learnt words in the order of their classes by letters, cut into equally many a class; all others stay in theirs
    rest = rest[np.lexsort((rest["h"], rest["s"]))]
    n_learnt = len(rest)
    dealt = np.arange(n_learnt) * CLASSES // max(n_learnt, 1)
    by_letters = lambda e, w=None: np.bincount(e["s"], weights=w, minlength=CLASSES).astype(np.int64)
    class_tokens = np.array([r["class_tokens"] for r in told], np.int64).reshape(-1, CLASSES).sum(0) - by_letters(own, own["c"]) - by_letters(rest, rest["c"]) + np.bincount(dealt, weights=rest["c"], minlength=CLASSES).astype(np.int64)
    class_words = np.array([r["class_words"] for r in told], np.int64).reshape(-1, CLASSES).sum(0) - by_letters(own) - by_letters(rest) + np.bincount(dealt, minlength=CLASSES)
    share = np.concatenate([own["c"], np.zeros(OWN - len(own), np.int64), class_tokens]).astype(np.float64) + 0.5
    share /= share.sum()
    classes = Classes(np.searchsorted(dealt, np.arange(CLASSES + 1)), rest["c"] + 1.0, class_tokens + class_words + 1.0)
    learnt = {int(h): i for i, h in enumerate(rest["h"])}
    top = top[np.argsort(top["h"])]
    number = {int(h): i for i, h in enumerate(own["h"])} | {int(h): OWN + int(k) for h, k in zip(rest["h"], dealt)}
    unit_of_top = np.array([number.get(int(h), -1) for h in top["h"]], np.int16)
    shared = spark.sparkContext.broadcast((top["h"].copy(), top["c"].copy(), unit_of_top, np.array([learnt.get(int(h), n_learnt) for h in top["h"]], np.int64)))

    def units(h: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        keys, c, unit, word = shared.value
        at = _lookup(keys, h)
        own = np.where(at >= 0, unit[at], -1) if len(keys) else np.full(len(h), -1)
        return np.where(own >= 0, own, OWN + s.astype(np.int64)), np.where(at >= 0, c[at], -1) if len(keys) else np.full(len(h), -1), (own >= 0) & (own < OWN), np.where(at >= 0, word[at], n_learnt) if len(keys) else np.full(len(h), n_learnt)

    start = Model.start(share, n_learnt)
    few = bounded_runs(train, START_RUNS, START_CHARS, "doc_id").collect()
    if few:
        trainer = Trainer(start, share, 1, classes)
        for _ in range(4):
            for _, _, data, at in B.pieces(pa.array([r["text"] for r in few])):
                h, s, offset = token_stream(data, at)
                unit, _, _, word = units(h, s)
                trainer.learn(unit, contexts(unit, offset), word, contexts(word, offset, n_learnt))
    first = spark.sparkContext.broadcast(start.flat())

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        B.one_thread()
        trainer = Trainer(Model.of(first.value), share, 2, classes)
        for batch in batches:
            for _, _, data, at in B.pieces(batch.column("text")):
                h, s, offset = token_stream(data, at)
                unit, _, _, word = units(h, s)
                trainer.learn(unit, contexts(unit, offset), word, contexts(word, offset, n_learnt))
        if trainer.tokens:
            flat = trainer.m.flat()
            cut = range(0, len(flat), CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), B.binary_array([flat[i : i + CHUNK].tobytes() for i in cut]), pa.array([float(trainer.tokens)] * len(cut))], ["i", "x", "w"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for i, x, w in zip(*(batch.column(c).to_pylist() for c in ("i", "x", "w"))):
                sums = held.setdefault(i, [0.0, 0.0])
                sums[0] = sums[0] + np.frombuffer(x, np.float32).astype(np.float64) * w
                sums[1] += w
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), B.binary_array([(x / w).astype(np.float32).tobytes() for x, w in held.values()]), pa.array([w for _, w in held.values()], pa.float64())], ["i", "x", "w"])

    mean = train.mapInArrow(learn, "i int, x binary, w double").repartition("i").mapInArrow(added, "i int, x binary, w double").collect()
    flat = first.value.copy()
    for r in mean:
        x = np.frombuffer(bytes(r["x"]), np.float32)
        flat[r["i"] * CHUNK : r["i"] * CHUNK + len(x)] = x
    model = spark.sparkContext.broadcast(flat)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_rid", "doc_id", "held_out", "n_tokens", "known", "logs", "own_logs", "lm", "b", "blob"]
        B.one_thread()
        m = Model.of(model.value)
        waiting: list[np.ndarray] = []

        def rare() -> pa.RecordBatch:
            b, blobs = _by_bucket(np.concatenate(waiting), nb)
            waiting.clear()
            gap = [pa.nulls(len(b), t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays([*gap, pa.array(b), B.binary_array(blobs)], names)

        for batch in batches:
            rid = batch.column("_rid").to_numpy()
            for i, j, data, at in B.pieces(batch.column("text")):
                h, s, offset = token_stream(data, at)
                unit, c, own, word = units(h, s)
                n = np.diff(offset)
                of = np.repeat(np.arange(j - i), n)
                log = np.where(c >= 0, np.log10(np.maximum(c, 0) + 1.0), 0.0)
                context, before = contexts(unit, offset), contexts(word, offset, n_learnt)
                r = m.predicted(context, before)
                lm = (m.log_probabilities(unit, r) + m.log_in_class(unit, r, word, classes)) / np.log(10)
                sums = [np.bincount(of, weights=w, minlength=j - i) for w in (log, np.where(own, log, 0.0), lm)]
                known = np.bincount(of[c > 0], minlength=j - i)
                unknown = c < 0
                if unknown.any():
                    e = np.empty(int(unknown.sum()), RARE)
                    e["h"], e["rid"] = h[unknown], rid[i:j][of[unknown]]
                    waiting.append(e)
                yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(i, j - i) for x in ("_rid", "doc_id", "held_out")), pa.array(n, pa.int64()), pa.array(known, pa.int64()), *map(pa.array, sums), pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.binary())], names)
                if sum(map(len, waiting)) > FLUSH:
                    yield rare()
        if waiting:
            yield rare()

    scored = materialize(rows.mapInArrow(score, "_rid long, doc_id long, held_out boolean, n_tokens long, known long, logs double, own_logs double, lm double, b int, blob binary"), "scores")

    def look_up(asked: pa.Table, known: pa.Table) -> pa.Table:
        e = np.concatenate([np.frombuffer(x, RARE) for x in asked.column("blob").to_pylist()]) if asked.num_rows else np.zeros(0, RARE)
        table = np.frombuffer(known.column("blob")[0].as_py(), COUNT) if known.num_rows else np.zeros(0, COUNT)
        at = _lookup(table["h"], e["h"])
        found = at >= 0
        rid, back = np.unique(e["rid"][found], return_inverse=True)
        log = np.bincount(back, weights=np.log10(table["c"][at[found]] + 1.0), minlength=len(rid)) if len(rid) else np.zeros(0)
        return pa.table([pa.array(rid, pa.int64()), pa.array(np.bincount(back, minlength=len(rid)), pa.int64()), pa.array(log, pa.float64())], ["_rid", "more_known", "more_logs"])

    more = scored.where("b is not null").select("b", "blob").groupBy("b").cogroup(counts.select(F.col("b").alias("cb"), "blob").groupBy("cb")).applyInArrow(look_up, "_rid long, more_known long, more_logs double")
    more = more.groupBy("_rid").agg(F.sum("more_known").alias("more_known"), F.sum("more_logs").alias("more_logs"))
    out = scored.where("_rid is not null").drop("b", "blob").join(more, "_rid", "left").na.fill(0, ["more_known"]).na.fill(0.0, ["more_logs"])
    logs = F.col("logs") + F.col("more_logs")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("more_known")).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(n_train + n_words + 1.0)))).alias("base_score"),
        (F.col("lm") + logs - F.col("own_logs")).alias("score"),
    )
