"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .store import free_name, keyed, materialize, small_batches, text_of, with_row_id

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: A document stays if its probability of being good is at least this.
KEEP_POSTERIOR = 0.5

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[ord("A") : ord("Z") + 1] = 1
_LETTER = _UPPER.copy()
_LETTER[ord("a") : ord("z") + 1] = 1
_SHOUT = np.zeros(256, np.int64)
_SHOUT[ord("!")] = 1
_STOP = np.zeros(256, np.int64)
_STOP[[ord(c) for c in ".?!"]] = 1

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_letters", "n_shouts", "n_stops", "n_symbol_words")


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _repeats(key: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries share their key with another of the same group, and which are the first with theirs."""
    if not len(key):
        return np.zeros(0, bool), np.zeros(0, bool)
    own = B.mix(key + (group.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    _, first, where, n = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(key), bool)
    is_first[first] = True
    return n[where] > 1, is_first


def measures(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each document of a piece (bytes and offsets)."""
    docs = len(at) - 1
    start, end, first_word = B.words(data, at)
    n_words = np.diff(first_word)
    of_word = np.repeat(np.arange(docs), n_words)
    prefix = B.prefix_hash(data)
    word = B.span_hash(prefix, start, end)
    in_word = ~B.SPACE[data]
    _, new_word = _repeats(word, of_word)
    triple = B.shingle_hashes(word, 3)
    whole = of_word[2:] == of_word[:-2] if len(word) >= 3 else np.zeros(0, bool)
    again = np.zeros(len(triple), bool)
    again[whole] = _repeats(triple[whole], of_word[: len(triple)][whole])[0]
    covered = np.zeros(len(word), bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=symbols[1:])
    feeds = np.flatnonzero(data == 10)
    # each document owns 1 + (its line feeds) lines, in order
    per_doc = 1 + _sums((data == 10).astype(np.int64), at)
    of_line = np.repeat(np.arange(docs), per_doc)
    bounds = np.cumsum(per_doc)
    heads = np.concatenate([[0], bounds[:-1]]).astype(np.int64) if docs else np.zeros(0, np.int64)
    line_start = np.empty(int(per_doc.sum()), np.int64)
    is_head = np.zeros(len(line_start), bool)
    is_head[heads] = True
    line_start[is_head] = at[:-1]
    line_start[~is_head] = feeds + 1
    is_tail = np.zeros(len(line_start), bool)
    is_tail[bounds - 1] = True
    line_end = np.empty_like(line_start)
    line_end[is_tail] = at[1:]
    line_end[~is_tail] = feeds
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(in_word, out=filled[1:])
    has_word = filled[line_end] > filled[line_start]
    line = B.span_hash(prefix, line_start[has_word], line_end[has_word])
    _, new_line = _repeats(line, of_line[has_word])
    return {
        "n_words": n_words,
        "word_chars": _sums((in_word & ((data & 0xC0) != 0x80)).astype(np.int64), at),
        "n_symbols": _sums(_SYMBOL[data], at),
        "n_dup_lines": np.bincount(of_line[has_word][~new_line], minlength=docs),
        "n_repeat_words": np.bincount(of_word[covered], minlength=docs),
        "n_lines": np.bincount(of_line[has_word], minlength=docs),
        "n_distinct": np.bincount(of_word[new_word], minlength=docs),
        "n_symbol_words": np.bincount(of_word[symbols[end] > symbols[start]], minlength=docs),
        "n_upper": _sums(_UPPER[data], at),
        "n_letters": _sums(_LETTER[data], at),
        "n_shouts": _sums(_SHOUT[data], at),
        "n_stops": _sums(_STOP[data], at),
    }


def votes() -> dict[str, F.Column]:
    """Each rule as a column: 2 for good, 1 for bad, 0 for abstaining."""

    def rule(bad: str, good: str) -> F.Column:
        return F.when(F.expr(bad), 1).when(F.expr(good), 2).otherwise(0)

    return {
        "symbols": rule("n_symbols * 100 > n_words * 10", "n_symbols * 100 <= n_words * 2"),
        "symbol_words": rule("n_symbol_words * 100 > n_words * 20", "n_symbol_words * 100 <= n_words * 5"),
        "symbol_share": rule("n_symbols * 100 > word_chars * 5", "n_symbols * 100 <= word_chars"),
        "word_length": rule("word_chars > n_words * 14 or word_chars * 2 < n_words * 5", "word_chars * 2 >= n_words * 6 and word_chars <= n_words * 11"),
        "repeated_lines": rule("n_dup_lines * 100 > n_lines * 50", "n_dup_lines * 100 <= n_lines * 10 and n_lines >= 3"),
        "repeated_words": rule("n_repeat_words * 100 > n_words * 45", "n_repeat_words * 100 <= n_words * 10"),
        "capitals": rule("n_upper * 100 > n_letters * 50", "n_upper * 100 <= n_letters * 20"),
        "shouting": rule("n_shouts * 100 > n_words * 15", "n_shouts * 100 <= n_words * 2"),
        "sentences": rule("n_stops * 120 < n_words", "n_stops * 40 >= n_words and n_stops * 2 <= n_words"),
        "variety": rule("n_distinct * 100 < n_words * 10", "n_distinct * 100 >= n_words * 35"),
    }


def fit_accuracies(patterns: np.ndarray, weight: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over vote patterns (rows of 0 abstain, 1 bad, 2 good) with their numbers of documents.

    Returns the share of good documents and, for each rule, the chance that it votes good on a
    good one and bad on a bad one, given that it votes. Junk is of several kinds and a rule sees only
    its own, so the second chance may be low: a vote for good then says little, one for bad much.
    """
    good, bad = patterns == 2, patterns == 1
    share, on_good, on_bad = 0.8, np.full(patterns.shape[1], 0.97), np.full(patterns.shape[1], 0.3)
    prior = 2.0
    for _ in range(rounds if weight.sum() else 0):
        p = posterior(patterns, share, on_good, on_bad)
        g, b = weight * p, weight * (1 - p)
        new = (
            float((g.sum() + 8) / (weight.sum() + 10)),
            np.clip((g @ good + 0.97 * prior) / (g @ (good | bad) + prior), 0.6, 0.9995),
            np.clip((b @ bad + 0.3 * prior) / (b @ (good | bad) + prior), 0.05, 0.9995),
        )
        step = max(abs(new[0] - share), np.abs(new[1] - on_good).max(), np.abs(new[2] - on_bad).max())
        share, on_good, on_bad = new
        if step < 1e-9:
            break
    return share, on_good, on_bad


def posterior(patterns: np.ndarray, share: float, on_good: np.ndarray, on_bad: np.ndarray) -> np.ndarray:
    odds = math.log(share / (1 - share)) + (patterns == 2) @ np.log(on_good / (1 - on_bad)) + (patterns == 1) @ np.log((1 - on_good) / on_bad)
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, at in B.pieces(batch.column("text")):
            m = measures(data, at)
            yield pa.RecordBatch.from_arrays([batch.column("_rid").slice(i, j - i), batch.column("doc_id").slice(i, j - i), *(pa.array(m[c], pa.int64()) for c in COUNTS)], ["_rid", "doc_id", *COUNTS])


def judged(docs: DataFrame, key: str | None = None) -> DataFrame:
    """One row per row of docs: _rid, doc_id, the counts of COUNTS, base_failed, votes, posterior, kept.

    _rid is docs' column key, if given, and otherwise a number of this result alone.

    Null and empty texts count as no words, so base_failed holds. Repeated rows are judged alike,
    each for itself; a null doc_id is kept as it is. Columns besides doc_id and text play no part.
    Very long texts are measured whole; a posterior of exactly the threshold is kept, there are no other ties.
    An empty table gives an empty result. Only the numbers of documents by vote pattern (at most
    3 to the number of rules, whatever the input) reach the driver.
    """
    small_batches(docs.sparkSession)
    rows = text_of(docs, F.col(key).alias("_rid")) if key else with_row_id(text_of(docs))
    counted = materialize(rows.mapInArrow(_count, "_rid long, doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)), "rules")
    rules = votes()
    pattern = sum((v * 3**k for k, v in enumerate(rules.values())), F.lit(0)).cast("int")
    failed = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words")
    voted = counted.withColumns({"base_failed": failed, "votes": pattern})
    found = voted.groupBy("votes").count().collect()
    every = np.arange(3 ** len(rules))
    digits = (every[:, None] // 3 ** np.arange(len(rules))) % 3
    seen = np.array([r["votes"] for r in found], np.int64)
    share, on_good, on_bad = fit_accuracies(digits[seen], np.array([float(r["count"]) for r in found]))
    p = posterior(digits[seen], share, on_good, on_bad)
    table = docs.sparkSession.createDataFrame([(int(a), float(b)) for a, b in zip(seen, p)], "votes int, posterior double")
    return voted.join(F.broadcast(table), "votes").withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP_POSTERIOR))


def quality_rules(docs: DataFrame) -> DataFrame:
    """The digest of judged(): doc_id, the base counts, base_failed, kept and the posterior."""
    return judged(docs).select("doc_id", *COUNTS[:5], "base_failed", "kept", "posterior")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    key = free_name(docs, "_rid")
    rows = keyed(docs, "documents", key)
    kept = judged(rows, key).where("kept").select(F.col("_rid").alias(key))
    return rows.join(kept, key, "left_semi").select(*docs.columns)
