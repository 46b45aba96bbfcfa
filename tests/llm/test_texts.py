"""Operators on texts against brute force, and their defined results for odd input."""

import collections
import hashlib
import math
import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from atlasq.llm import bytesops, jaccard, language_model, licenses, mixing, packing, resampling, rules, shards, store, suffixes, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- suffix-array dedup


def removed_by_force(texts):
    raws = [(t or "").encode() for t in texts]
    n = suffixes.LENGTH
    seen = collections.Counter(r[p : p + n] for r in raws for p in range(len(r) - n + 1))
    out = []
    for r in raws:
        spans = []
        for p in range(len(r) - n + 1):
            if seen[r[p : p + n]] > 1:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + n
                else:
                    spans.append([p, p + n])
        ends = [0, *(z for _, z in spans)]
        kept = b"".join(r[a:z] for a, z in zip(ends, [*(a for a, _ in spans), len(r)]))
        out.append((len(r), sum(z - a for a, z in spans), len(spans), hashlib.sha256(kept).hexdigest()))
    return out


def digest(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("hot", [500, 0])
def test_repeats_are_removed(make, plain, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    some = [t for _, t, _ in plain[:60]]
    passage = some[3][:400]
    texts = [*some, some[5], some[7][50:900] + "x" + some[7][901:], "start " + passage + " end", passage, "ab" * 300, "ab" * 150, "q" * 199, "q" * 199, "z" * 200, "z" * 201, None, ""]
    want = sorted((i, *w) for i, w in enumerate(removed_by_force(texts)))
    assert digest(suffixes.removal_digest(make(texts))) == want


def test_repeats_odd_input(odd, none):
    rows = digest(suffixes.removal_digest(odd.orderBy(F.col("doc_id").asc_nulls_last()).where("doc_id is not null")))
    long = [r for r in rows if r[0] in (5, 6)]
    assert all(r[1] == r[2] > 0 for r in long) and [r[1] for r in rows if r[0] in (1, 2)] == [0, 0, 0]
    assert suffixes.removal_digest(none).count() == 0 and suffixes.removal_digest(odd).count() == 11
    cut = suffixes.without_repeats(odd)
    assert cut.columns == odd.columns and {r.doc_id for r in cut.collect()} == {3, 4, None, 8, 9} - {3} - {8, 9} | {r.doc_id for r in cut.where("doc_id in (8, 9)").collect()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 1), st.integers(0, 1)), max_size=12), max_size=6))
def test_shards_are_merged(shards_):
    """What two sorted shards have is found for all of them that don't know it; what one shard has is not."""
    lists = []
    for k, entries in enumerate(shards_):
        keys = sorted({(key % 8 << 61 | key, more) for key, more, _ in entries})
        x = np.zeros(len(keys), suffixes.STRING)
        for i, (key, more) in enumerate(keys):
            x[i] = (key, more, (key + k) % 2, k, 0, i)
        lists.append(x)
    every = [(int(x["key"]), int(x["more"])) for own in lists for x in own]
    want = sorted((int(x["h"]), int(x["a"])) for own in lists for x in own if every.count((int(x["key"]), int(x["more"]))) > 1 and not x["known"])
    assert sorted((int(x["h"]), int(x["a"])) for x in suffixes.merged(lists)) == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=60).map(lambda b: bytes(x % 3 + 97 for x in b)), min_size=1, max_size=6))
def test_suffix_array_and_prefixes(parts):
    depth = 16
    text = np.frombuffer(b"".join(p + b"\0" * depth for p in parts), np.uint8)
    target = text != 0
    order, _ = suffixes.suffix_array(text, target, depth)
    raw = text.tobytes() + b"\0" * depth
    keys = [raw[p : p + depth] for p in order]
    assert keys == sorted(keys) and sorted(order) == np.flatnonzero(target).tolist()
    lanes = np.flatnonzero(target & ~np.concatenate([[False], target[:-1]]))
    got = suffixes.common_prefixes(text, order, lanes, depth)
    for i in range(1, len(order)):
        a, b = keys[i - 1], keys[i]
        assert got[i] == next((k for k in range(depth) if a[k] != b[k]), depth)


# --- rules


def counts_by_force(text):
    words = WORD.findall(text or "")
    triples = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(map((text or "").count, "#*$%&|<>")), dup, len(covered)


def test_rules(make, documents, plain, odd, none):
    got = {r.doc_id: r for r in rules.quality_rules(documents).collect()}
    for doc_id, text, _ in plain:
        r, want = got[doc_id], counts_by_force(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.kept and r.base_failed)
    rows = rules.quality_rules(odd).collect()
    assert len(rows) == 11 and not any(r.kept for r in rows if r.n_words < 50) and rules.quality_rules(none).count() == 0
    texts = [None, "", "a\n\na\n b\r\n b\r\n", "x y z x y z", "é #*$ <|>\n#", "\n", "a\x0bb\x1fc"]
    for r in rules.quality_rules(make(texts)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts_by_force(texts[r.doc_id])
    assert rules.keep_good(odd).columns == odd.columns


def test_rules_hold_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = rules.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed")
    wrong = got.where("kept <> (quality = 1)").count()
    assert wrong <= 0.02 * got.count()


def test_posteriors_by_force(documents):
    """Expectation-maximisation over documents one by one, from votes worked out again."""
    rows = rules.judged(documents).collect()

    def vote(bad, good):
        return 1 if bad else 2 if good else 0

    def votes(r):
        w, c, n, d, t, lines = r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines
        return [
            vote(n * 100 > w * 10, n * 100 <= w * 2), vote(r.n_symbol_words * 100 > w * 20, r.n_symbol_words * 100 <= w * 5), vote(n * 100 > c * 5, n * 100 <= c),
            vote(c > w * 14 or c * 2 < w * 5, c * 2 >= w * 6 and c <= w * 11), vote(d * 100 > lines * 50, d * 100 <= lines * 10 and lines >= 3), vote(t * 100 > w * 45, t * 100 <= w * 10),
            vote(r.n_upper * 100 > r.n_letters * 50, r.n_upper * 100 <= r.n_letters * 20), vote(r.n_shouts * 100 > w * 15, r.n_shouts * 100 <= w * 2), vote(r.n_stops * 120 < w, r.n_stops * 40 >= w and r.n_stops * 2 <= w), vote(r.n_distinct * 100 < w * 10, r.n_distinct * 100 >= w * 35),
        ]

    v = [votes(r) for r in rows]
    share, good, bad = 0.8, [0.97] * 10, [0.3] * 10

    def p_good(own):
        a, b = math.log(share), math.log(1 - share)
        for x, g, z in zip(own, good, bad):
            a += math.log(g) if x == 2 else math.log(1 - g) if x == 1 else 0
            b += math.log(1 - z) if x == 2 else math.log(z) if x == 1 else 0
        return 1 / (1 + math.exp(min(50, max(-50, b - a))))

    for _ in range(200):
        p = [p_good(own) for own in v]
        n = sum(p)
        told = lambda k, kind, w: sum(q for q, own in zip(w, v) if own[k] in kind)
        q = [1 - x for x in p]
        new_good = [min(0.9995, max(0.6, (told(k, (2,), p) + 0.97 * 2) / (told(k, (1, 2), p) + 2))) for k in range(10)]
        new_bad = [min(0.9995, max(0.05, (told(k, (1,), q) + 0.3 * 2) / (told(k, (1, 2), q) + 2))) for k in range(10)]
        new = (n + 8) / (len(v) + 10)
        step = max(abs(new - share), *(abs(x - y) for x, y in zip(new_good + new_bad, good + bad)))
        share, good, bad = new, new_good, new_bad
        if step < 1e-9:
            break
    for r, own in zip(rows, v):
        assert r.posterior == pytest.approx(p_good(own), abs=1e-6)
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)


# --- row keys


@pytest.mark.parametrize("name", ["removal_digest", "without_repeats", "component_ids", "one_of_each", "keep_good", "licenses", "resample", "scores"])
def test_rows_stay_the_same_when_cores_change(spark, documents, monkeypatch, tmp_path, name):
    """Another number of cores between two jobs cuts scans otherwise; no job may rely on another one's row numbers."""
    run = {
        "removal_digest": suffixes.removal_digest, "without_repeats": suffixes.without_repeats, "component_ids": jaccard.component_ids, "one_of_each": jaccard.one_of_each, "keep_good": rules.keep_good,
        "licenses": lambda d: licenses.licenses(d.select("doc_id", F.concat_ws("/", "source", "doc_id").alias("path"), "text")),
        "resample": lambda d: resampling.resample(d, spark.read.parquet("/root/testdata/sf0.001/labels.parquet")),
        "scores": lambda d: language_model.score_documents(d).select("doc_id", "n_tokens", "n_known", F.round("base_score", 6)),
    }[name]
    documents.repartition(7).write.parquet(f"file://{tmp_path}/documents")
    docs = spark.read.parquet(f"file://{tmp_path}/documents")
    rows = lambda df: sorted(map(str, df.collect()))
    cores, cost = "spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes"
    want = rows(run(docs))
    plain, calls = store.temporary, []

    def changing(session, label):
        calls.append(label)
        session.conf.set(cores, 2 + 5 * (len(calls) % 2))
        return plain(session, label)

    spark.conf.set(cost, 1)
    try:
        numbers = []
        for n in (2, 7):
            spark.conf.set(cores, n)
            numbers.append({r.doc_id: r._rid for r in store.with_row_id(docs).select("doc_id", "_rid").collect()})
        assert numbers[0] != numbers[1]
        monkeypatch.setattr(store, "temporary", changing)
        assert rows(run(docs)) == want and calls
    finally:
        spark.conf.unset(cores)
        spark.conf.unset(cost)


# --- tokens, shards, packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


ODD_TEXTS = ["", "  ", "don't 'tis ''s I'll we've're  'S \n\n x", "x  \n y\t\tz  ", "'s's's", "１２ab３", "é'd 'dé ñ'll", "<|endoftext|> hi", "!'s 're \n're\t'll", "'", "\U0001F600's x\U0001F600 y", "a\r\n b", "end 's"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t'tsmrevldé1!.A ☯", max_size=40), min_size=1, max_size=8))
def test_encoder_equals_library(texts):
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path()
    whole = Tokenizer.from_file(path)
    got = [ids[a:z].tolist() for _, ids, at in tokens.encoded(pa.array(texts), path, 0) for a, z in zip(at, at[1:])]
    assert got == [whole.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def test_encoder_odd(tokenizer):
    got = [ids[a:z].tolist() for _, ids, at in tokens.encoded(pa.array(ODD_TEXTS), tokens.tokenizer_path(), 0) for a, z in zip(at, at[1:])]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in ODD_TEXTS]


def test_shards_round_trip(documents, plain, tokenizer, odd, none):
    ids = {d: tokenizer.encode(t, add_special_tokens=False).ids + [0] for d, t, _ in plain}
    written = shards.write(documents)
    start = 0
    for r in shards.documents(written).orderBy("doc_id").collect():
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[r.doc_id]), zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes()))
        start += r.n_tokens
    found = {r.doc_id: r.ids for r in shards.look_up(written, documents.select("doc_id").where("doc_id in (7, 8, 150)")).collect()}
    assert found == {d: ids[d] for d in (7, 8, 150)}
    row = written.table.where("first_id <= 7 and last_id >= 7").first()
    assert shards.read_document(bytes(row.payload), written.dictionary, 7)[0].tolist() == ids[7]
    with pytest.raises(ValueError):
        shards.opened(bytes(row.payload), b"other")
    assert shards.token_output(none).count() == 0
    rows = shards.token_output(odd).collect()
    assert len(rows) == 11 and sorted(r.n_tokens for r in rows)[:3] == [1, 1, 1] and max(r.start + r.n_tokens for r in rows) == sum(r.n_tokens for r in rows)


def test_written_shards_are_reopened(spark, make, tokenizer, tmp_path):
    """A corpus in a folder of its own is read by another session; a long text takes part in the dictionary's sample."""
    texts = ["a b c", "", None, "word " * 9000, "é" * 20]
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    folder = f"file://{tmp_path}/corpus"
    shards.write(make([*texts, "a b c"], [10, 11, 12, 13, 14, 10]), folder)
    other = spark.newSession()
    again = shards.reopen(other, folder)
    asked = other.createDataFrame([(10,), (13,), (12,), (99,), (None,)], "doc_id long")
    assert sorted((r.doc_id, r.ids) for r in shards.look_up(again, asked).collect()) == sorted([(10, ids[0]), (10, ids[0]), (12, ids[2]), (13, ids[3])])
    assert [r.n_tokens for r in shards.documents(again).orderBy("doc_id").collect()] == [len(ids[i]) for i in (0, 0, 1, 2, 3, 4)]
    index = other.read.parquet(f"{folder}/index")
    assert index.count() == 6 and {"doc_id", "part", "shard", "offset", "size"} <= set(index.columns)


def test_runs_cover_long_texts(make):
    runs = [r.text for r in store.bounded_runs(make(["abcdefg", "", None, "xy"]), 10, 3, "doc_id").collect()]
    assert sorted(runs) == ["abc", "def", "g", "xy"]
    assert 0 < store.bounded_runs(make(["z" * 30_000]), 50, 3, "doc_id").count() <= 50


def check_pieces(rows, ids):
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for d, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[d][at : at + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids[d])
            at += r.length
        assert at == len(ids[d])
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
    return by_doc, by_sequence


def test_packing(documents, plain, tokenizer, odd, none):
    ids = {d: tokenizer.encode(t, add_special_tokens=False).ids + [1] for d, t, _ in plain}
    by_doc, by_sequence = check_pieces(packing.pack_documents(documents).collect(), ids)
    assert set(by_doc) == set(ids) and len(by_sequence) <= 1.1 * sum(map(len, ids.values())) / packing.WINDOW + 2
    assert packing.pack_documents(none).count() == 0
    rows = packing.pack_documents(odd, with_ids=True).collect()
    assert sum(r.doc_tokens for r in rows if r.start == 0) == sum(r.length for r in rows) == sum(len(r.ids) for r in rows) and sum(r.start == 0 for r in rows) == 11


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, packing.PIECE), max_size=60))
def test_windows_hold_all(sizes):
    dealt = packing.windows(sizes)
    assert sorted(i for w in dealt for i in w) == list(range(len(sizes))) and all(sum(sizes[i] for i in w) <= packing.WINDOW for w in dealt)
    assert all(n <= packing.WINDOW for n in [s for _, s in packing.cuts(sum(sizes) or 1)]) and sum(s for _, s in packing.cuts(sum(sizes) or 1)) == (sum(sizes) or 1)


def test_token_shards_of_rows_without_ids(spark, make, plain, documents, monkeypatch):
    """Rows that share a doc_id, or have none, are dealt to several ranges too."""
    texts = [t for _, t, _ in plain[:60]]
    docs = make([*texts, *texts[:5] * 8], [None] * 60 + [3] * 40)
    monkeypatch.setattr(shards, "PART_BYTES", 1)
    assert shards.parts_of(documents) > 4
    monkeypatch.setattr(shards, "parts_of", lambda df: 6)
    found = shards.write(docs)
    assert found.table.select("part").distinct().count() >= 4
    rows = shards.documents(found).collect()
    assert len(rows) == 100 and sorted(r.start for r in rows) == list(np.cumsum([0, *[r.n_tokens for r in sorted(rows, key=lambda r: r.start)]])[:-1])
    assert {r.doc_id for r in rows if r.start <= max(x.start for x in rows if x.doc_id is None)} == {None}


# --- mixing


def test_mixing(spark, make, documents, odd, none):
    rows = mixing.mix(documents).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += r["size"]
    names = sorted(sizes)
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while True:
        share = {n: left * weight[n] / sum(weight[x] for x in open_) for n in open_}
        over = {n for n in open_ if share[n] > 2 * sizes[n]}
        if not over:
            target |= share
            break
        for n in over:
            target[n] = 2 * sizes[n]
            left -= target[n]
        open_ -= over
    taken = collections.Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
    largest = max(r["size"] for r in rows)
    assert all(abs(target[n] - taken[n]) <= largest / 2 for n in names)
    assert sorted(r.doc_id for r in mixing.mixed_rows(documents).collect()) == sorted(r.doc_id for r in rows for _ in range(r.takes))
    assert mixing.mix(none).count() == 0 and mixing.mixed_rows(none).count() == 0
    assert mixing.mix(odd).count() == 11 and mixing.mixed_rows(odd).columns == odd.columns
    # the document at the border is taken if the mix then ends nearer to the target
    few = mixing.mix(make(["w " * (60 + 7 * i) for i in range(12)], sources=["a", "b"] * 6)).collect()
    for name in "ab":
        own = [r for r in few if r.source == name]
        miss = abs(sum(r.taken for r in own) - own[0].target)
        assert miss <= max(r["size"] for r in own) / 2
    alone = mixing.mix(make([None, ""])).collect()
    assert [(r["size"], r.target, r.taken) for r in alone] == [(0, 0.0, 0)] * 2


def test_mixing_rows_without_ids(make):
    """Rows that share a doc_id, or have none, are taken one by one, even if their texts are equal too."""
    for ids in ([None] * 40, [7] * 40, None):
        for texts in (["w " * 100] * 40, [f"w{i} " * 100 for i in range(40)]):
            docs = make(texts, ids, ["a"] * 30 + ["b"] * 10)
            rows = mixing.mix(docs).collect()
            for name in "ab":
                own = [r for r in rows if r.source == name]
                assert abs(sum(r.taken for r in own) - own[0].target) <= 50
            taken = collections.Counter((r.doc_id, r.source) for r in rows for _ in range(r.takes))
            assert collections.Counter((r.doc_id, r.source) for r in mixing.mixed_rows(docs).collect()) == taken
            again = mixing.mix(docs.repartition(7)).collect()
            assert sorted((r.source, r.h, r.takes) for r in again) == sorted((r.source, r.h, r.takes) for r in rows)


def test_mixing_many_sources(make):
    """Sources as many as documents: places and levels without a window over all of them."""
    docs = make([f"w{i} " * (i % 60 + 1) for i in range(600)], sources=[f"host{i:03d}" for i in range(600)])
    out = mixing.mix(docs)
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    places = {f"host{i:03d}": i for i in range(600)}
    target, left, open_ = {}, 1.5 * sum(r["size"] for r in rows), set(places)
    size = {r.source: r["size"] for r in rows}
    while True:
        share = {n: left * (5, 2, 1)[places[n] % 3] / sum((5, 2, 1)[places[x] % 3] for x in open_) for n in open_}
        over = {n for n in open_ if share[n] > 2 * size[n]}
        if not over:
            break
        for n in over:
            target[n] = 2 * size[n]
            left -= target[n]
        open_ -= over
    target |= share
    assert all(r.target == pytest.approx(target[r.source]) for r in rows)


def test_mixing_against_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    want = sorted(map(tuple, con.sql(mixing.SQL).df()[["doc_id", "size", "source_size", "target", "taken"]].values.tolist()))
    got = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
    assert sorted(map(list, got.collect())) == list(map(list, want))
    assert not [x for x in ("Python", "Pandas", "Arrow") if x in got._jdf.queryExecution().executedPlan().toString()]


# --- Jaccard join


def components_by_force(texts, ids):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOW))
        sets.append(frozenset([tuple(w[k : k + 5]) for k in range(len(w) - 4)] or ([tuple(w)] if w else [])))
    links = jaccard.Union(len(texts))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                links.join(i, j)
    least = {}
    for i in range(len(texts)):
        r = links.find(i)
        least[r] = min(least.get(r, ids[i]), ids[i])
    return sorted((ids[i], len(s), least[links.find(i)]) for i, s in enumerate(sets))


def family(n, words=120, seed=0, edits=6):
    rng = np.random.default_rng(seed)
    base = [f"w{seed}x{i}" for i in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for p in rng.integers(0, words, rng.integers(0, edits)):
            own[p] = f"e{rng.integers(1 << 30)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("region", [500, 4])
def test_jaccard_components(make, plain, region, monkeypatch):
    monkeypatch.setattr(jaccard, "REGION", region)
    texts = [t for _, t, _ in plain[:80]] + family(60) + family(12, 40, 1, 3) + ["a b c", "A B c", "a b", None, "", "a b c d e", "a b c d e f"]
    ids = [1000 - i for i in range(len(texts))]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.component_ids(make(texts, ids)).collect())
    assert got == components_by_force(texts, ids)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 120), st.integers(1, 14))
def test_region_join(seed, n, edits):
    texts = family(n, 60, seed, edits) + family(n // 3, 60, seed + 1, edits)
    data, at = bytesops.text_bytes(pa.array(texts))
    h, offset = jaccard.shingle_sets(data, at)
    sets = [h[a:z] for a, z in zip(offset, offset[1:])]
    links = jaccard.Union(len(sets))
    jaccard.join_region(sets, links, list(range(len(sets))))
    want = components_by_force(texts, list(range(len(texts))))
    assert [links.find(i) for i in range(len(sets))] == [c for _, _, c in want]


def pairs_within(spark, texts, monkeypatch):
    """The components of texts, and how many sets were sent to be compared."""
    sent = []
    plain = store.materialize

    def counting(df, label):
        out = plain(df, label)
        if label == "region-sets":
            sent.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "materialize", counting)
    rows = jaccard.component_ids(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows), sum(sent)


def test_form_letters_are_not_compared(spark, monkeypatch):
    """Texts that share 70 in 100 of their shingles: the place of the first shared one tells that none can be linked."""
    rng = np.random.default_rng(2)
    texts = []
    for k in range(300):
        w = [f"t{i}" for i in range(380)]
        for p in rng.choice(380, 20, replace=False):
            w[p] = f"o{k}x{p}"
        texts.append(" ".join(w))
    got, sent = pairs_within(spark, texts, monkeypatch)
    assert sent < 30 and got == components_by_force(texts, list(range(300)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 40) - 1), max_size=30), st.integers(0, 39))
def test_ascending_numbers_packed(numbers, shift):
    v = np.sort(np.array(numbers, np.uint64) >> np.uint64(shift))
    assert jaccard.unpack_ascending(jaccard.pack_ascending(v)).tolist() == v.tolist()


def test_shared_shingles_come_back(spark, tmp_path, monkeypatch):
    """Chunks of four rows, long texts apart, several files read by one task: each chunk gets its own bits back, and
    no table of a fixed size, which a larger input would fill, goes to the tasks."""
    monkeypatch.setattr(jaccard, "CHUNK_SHIFT", 2)
    monkeypatch.setattr(jaccard, "LONG", 600)
    sizes = []
    plain = spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: (sizes.append(len(pickle.dumps(x))), plain(x))[1])
    copies = family(9, 120, 3, 5) + family(7, 60, 4, 3) + ["", None, "one two"] * 2
    texts = [t for i, c in enumerate(copies) for t in (c, *(f"x{i}y{k} " * 3 + " ".join(f"u{i}v{k}w{j}" for j in range(30 * k)) for k in range(5)))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9).write.parquet(str(tmp_path / "documents.parquet"))
    sent = []
    store_table = store.materialize
    monkeypatch.setattr(jaccard, "materialize", lambda df, label: (out := store_table(df, label), label == "region-sets" and sent.append(out.count()))[0])
    rows = jaccard.component_ids(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == components_by_force(texts, list(range(len(texts))))
    assert sum(sent) <= 17 and max(sizes) < 1 << 20


def test_large_regions_are_cut(spark, monkeypatch):
    """Families that hang together by some shared passages only: their region is cut along cells, round by round."""
    monkeypatch.setattr(jaccard, "REGION", 12)
    monkeypatch.setattr(jaccard, "PER_PIVOT", 6)
    cut = []
    plain = store.materialize
    monkeypatch.setattr(jaccard, "materialize", lambda df, label: (cut.append(label), plain(df, label))[1])
    shared = " ".join(f"s{i}" for i in range(90))
    texts = [f"{shared} {t}" for seed in range(8) for t in family(9, 24, seed, 4)] + family(40, 120, 50, 8)
    rows = jaccard.component_ids(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == components_by_force(texts, list(range(len(texts))))
    assert any(x.startswith("placed") for x in cut)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9), st.integers(1, 12), st.integers(0, 30)), max_size=25))
def test_ties_connect_all_partners(rows):
    own = {}
    e = np.zeros(len(rows), jaccard.ENTRY)
    for i, (h, sid, n, most) in enumerate(rows):
        # a set's size and a shingle's place in it are the same wherever the set is found
        n, most = own.setdefault(sid, n), own.setdefault((h, sid), most)
        e[i] = (h, bytes([sid + 1]) * 12, n, most)
    links = jaccard.Union(256)
    for a, b in zip(*jaccard.ties(e)):
        links.join(a[0], b[0])
    for x in e:
        for y in e:
            n, m = int(x["n"]), int(y["n"])
            if x["h"] == y["h"] and m <= x["most"] and n <= y["most"] and 100 * min(n, m) >= jaccard.PERCENT * max(n, m):
                assert links.find(bytes(x["sid"])[0]) == links.find(bytes(y["sid"])[0])


def test_scores_in_classes_sort_once(monkeypatch):
    """Probabilities in classes equal the plain sums; tokens are put in order once, not for each class."""
    m, n = language_model, 400
    rng = np.random.default_rng(4)
    dealt = np.arange(n) * m.CLASSES // n
    weight = rng.integers(1, 50, n) + 1.0
    classes = m.Classes(np.searchsorted(dealt, np.arange(m.CLASSES + 1)), weight, np.bincount(dealt, weights=weight, minlength=m.CLASSES) + 3)
    model = m.Model.start(np.full(m.UNITS, 1 / m.UNITS), n)
    word = rng.integers(0, n + 1, 900)
    unit = np.where(word < n, m.OWN + dealt[np.minimum(word, n - 1)], rng.integers(0, m.UNITS, 900))
    r = rng.normal(0, 1, (900, m.WIDTH)).astype(np.float32)
    want = np.zeros(900)
    for t in np.flatnonzero(unit >= m.OWN):
        k = unit[t] - m.OWN
        w = slice(classes.edges[k], classes.edges[k + 1])
        want[t] = r[t] @ model.inner[word[t]] - np.log(np.exp(model.inner[w] @ r[t]) @ weight[w] + classes.rest[k])
    plain, asked = np.searchsorted, []
    monkeypatch.setattr(np, "searchsorted", lambda *a, **b: asked.append(1) or plain(*a, **b))
    got = model.log_in_class(unit, r, word, classes)
    monkeypatch.undo()
    assert np.allclose(got, want, rtol=1e-4, atol=1e-4)
    assert len(asked) == 1


def test_sums_of_gradients():
    """Rows with one gradient, several and none; the last row of the table stays."""
    rng = np.random.default_rng(5)
    at = np.array([3, 1, 3, 7, 0, 3, 7, 5])
    g = rng.normal(0, 1, (8, 16)).astype(np.float32)
    plain = np.zeros((8, 16), np.float32)
    np.add.at(plain, at, g)
    assert np.allclose(language_model._sums(at, g, 8), plain, atol=1e-6)
    x, seen = np.zeros((8, 16), np.float32), np.ones((8, 16), np.float32)
    language_model._ascend(x, seen, at, g)
    plain[7] = 0
    assert np.allclose(seen, 1 + plain**2, atol=1e-5)
    assert np.allclose(x, language_model.RATE * plain / np.sqrt(1 + plain**2), atol=1e-6)


def test_jaccard_copies_take_no_room(spark, monkeypatch):
    """Copies in other chunks share all shingles; they add no entries, no sets, and change no component."""
    monkeypatch.setattr(jaccard, "CHUNK_SHIFT", 2)
    rng = np.random.default_rng(8)
    once = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 120)) for _ in range(12)]
    once.append(once[3] + " one more")
    plain, room = jaccard.materialize, {}

    def measured(df, label):
        out = plain(df, label)
        for c in {"set", "blob"} & set(out.columns) if label in ("sets", "entries", "region-sets") else ():
            room[n] = room.get(n, 0) + (out.agg(F.sum(F.length(c))).first()[0] or 0)
        return out

    monkeypatch.setattr(jaccard, "materialize", measured)
    for n in (2, 10):
        texts = once * n
        rows = jaccard.component_ids(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
        assert {r.doc_id: r.component_id for r in rows} == {i: 3 if i % 13 == 12 else i % 13 for i in range(len(texts))}
    assert 0 < room[10] <= room[2]


def test_jaccard_odd(odd, none):
    rows = jaccard.component_ids(odd).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.n_shingles, r.component_id))
    assert by[1] == [(0, 1)] * 2 and by[2] == [(0, 2)] and by[4] == [(1, 4)] * 2 and by[5][0][1] == by[6][0][1] == 5 and by[None][0] == (4, None)
    assert jaccard.component_ids(none).count() == 0
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 1, 2, 3, 4, 5, 8, 9]


# --- language model


def test_language_model(spark, plain, odd, none, make):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: WORD.findall((r.text or "").translate(LOW)) + [None] for r in docs.collect()}
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    c = collections.Counter(w for d, t in texts.items() if not out[d] for w in t)
    n, v = sum(c.values()), len(c)
    total = collections.Counter()
    for r in language_model.score_documents(docs).collect():
        t = texts[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        if r.held_out:
            total["base"] += r.base_score
            total["score"] += r.score
    assert total["score"] > total["base"]
    rows = language_model.score_documents(odd).collect()
    assert len(rows) == 11 and all(math.isfinite(r.score) for r in rows) and language_model.score_documents(none).count() == 0


def test_model_is_normalised():
    rng = np.random.default_rng(0)
    share = rng.random(language_model.UNITS)
    m = language_model.Model.start(share / share.sum())
    context = rng.integers(0, language_model.UNITS, (language_model.CONTEXT, 1))
    every = np.arange(language_model.UNITS)
    p = np.exp(m.log_probabilities(every, m.predicted(np.repeat(context, len(every), 1))))
    assert p.sum() == pytest.approx(1, abs=1e-5)
    assert (language_model.Model.of(m.flat()).tables == m.tables).all()


def test_words_of_all_classes_add_up_to_one():
    """Units times words in class, over every learnt word and the rest of each class, by plain sums."""
    rng = np.random.default_rng(1)
    units, classes, words = language_model.UNITS, language_model.CLASSES, 400
    share = rng.random(units)
    m = language_model.Model.start(share / share.sum(), words)
    m.inner[:-1] = rng.normal(0, 1, (words, language_model.WIDTH))
    edges = np.arange(classes + 1) * words // classes
    own = language_model.Classes(edges, rng.integers(2, 50, words).astype(float), np.bincount(np.searchsorted(edges, np.arange(words), "right") - 1, minlength=classes) * 60.0 + 5)
    context, before = rng.integers(0, units, (language_model.CONTEXT, 1)), rng.integers(0, words, (language_model.CONTEXT, 1))
    r = m.predicted(context, before)
    by_hand = sum(m.tables[i][context[i, 0]] + m.near[i][before[i, 0]] for i in range(language_model.CONTEXT))
    assert r[0] == pytest.approx(by_hand)
    p_unit = np.exp(m.bias + m.targets @ by_hand)
    p_unit /= p_unit.sum()
    total = p_unit[: language_model.OWN].sum()
    for k in range(classes):
        mine = np.arange(edges[k], edges[k + 1])
        weight = own.weight[mine] * np.exp(m.inner[mine] @ by_hand)
        sums = weight.sum() + own.rest[k]
        got = m.log_probabilities(np.full(len(mine), language_model.OWN + k), np.repeat(r, len(mine), 0)) + m.log_in_class(np.full(len(mine), language_model.OWN + k), np.repeat(r, len(mine), 0), mine, own) + np.log(own.weight[mine])
        assert got == pytest.approx(np.log(p_unit[language_model.OWN + k] * weight / sums), abs=1e-4)
        total += np.exp(got).sum() + p_unit[language_model.OWN + k] * own.rest[k] / sums
    assert total == pytest.approx(1, abs=1e-4)


def test_rare_words_are_joined(spark, make, monkeypatch):
    texts = [f"alpha beta gamma{i % 7} delta{i}" for i in range(60)]
    want = {r.doc_id: (r.n_known, round(r.base_score, 9)) for r in language_model.score_documents(make(texts)).collect()}
    monkeypatch.setattr(language_model, "FREQUENT", 3)
    got = {r.doc_id: (r.n_known, round(r.base_score, 9)) for r in language_model.score_documents(make(texts)).collect()}
    assert got == want


def test_words_of_a_class_are_told_apart_by_context(spark, make):
    """Exchanging two words of one class changes scores as the corpus has them; each pair's counts cancel out."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 128, 150)) + (" aaving mooing" if d % 2 else " bbving cooing") for d in range(600)]
    texts += ["aaving mooing", "aaving cooing", "bbving cooing", "bbving mooing"]
    score = {r.doc_id: r.score for r in language_model.score_documents(make(texts)).collect()}
    assert score[600] - score[601] + score[602] - score[603] > 0.1


# --- resampling and licences


def test_resampling(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = resampling.resample(docs, labels).collect()
    share = labels.agg(F.avg("quality")).first()[0]
    assert abs(sum(r.kept for r in rows) - share * len(rows)) <= 1
    cut = min(r.sample_key for r in rows if r.kept)
    assert all((r.sample_key >= cut) == r.kept for r in rows)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    mean = lambda q: np.mean([r.log_ratio / max(r.n_features, 1) for r in rows if quality.get(r.doc_id) == q])
    assert mean(1) > mean(0)
    assert len(resampling.resample(odd, labels).collect()) == 11 and resampling.resample(none, labels).count() == 0
    assert sum(r.kept for r in resampling.resample(docs, labels, 0.25).collect()) == 250


def test_log_ratios_by_force(spark, documents):
    """Ratios of counts over all texts; a draw depends on the rows, not on their layout."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    texts = {r.doc_id: r.text for r in documents.collect()}

    def buckets(text):
        data, at = bytesops.text_bytes(pa.array([text or ""]))
        return resampling.features(data, at)[0].tolist()

    own = {d: buckets(t) for d, t in texts.items()}
    for d in list(texts)[:20]:
        w = WORD.findall((texts[d] or "").translate(LOW))
        assert len(own[d]) == len(w) + max(0, len(w) - 1)
        assert all(own[d][i] == own[d][w.index(x)] for i, x in enumerate(w))
    raw, target = collections.Counter(), collections.Counter()
    for d, b in own.items():
        raw.update(b)
        if d in good:
            target.update(b)
    size = resampling.FEATURES
    n, m = sum(raw.values()) + size, sum(target.values()) + size
    rows = {r.doc_id: r for r in resampling.resample(documents, labels).collect()}
    for d, b in own.items():
        want = sum(math.log((target[x] + 1) / m) - math.log((raw[x] + 1) / n) for x in b)
        assert rows[d].log_ratio == pytest.approx(want, abs=1e-6) and rows[d].n_features == len(b)
    again = {r.doc_id: r for r in resampling.resample(documents.repartition(5, "text"), labels).collect()}
    assert again == rows


def test_equal_rows_draw_apart(make, spark):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    rows = resampling.resample(make(["same text"] * 40 + [None] * 3, [None] * 20 + [5] * 20 + [None] * 3).repartition(3), labels, 0.5).collect()
    assert len({r.sample_key for r in rows}) == len(rows) == 43


def test_kth_largest(spark):
    values = [5, -3, 7, 7, 0, -(1 << 62), 1 << 62]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in range(1, 8):
        assert resampling.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


def test_licences(spark, none):
    rows = [
        (1, "r/LICENSE", "Released under the MIT License.\nmore"), (2, "r/a.txt", "text"), (3, "r/s/t/b.txt", None), (4, "r/s/LICENSE", "Licensed under the Apache License, Version 2.0."), (5, "r/s/t/c.txt", "Licensed under CC BY-NC 4.0."),
        (6, "q/d.txt", "nothing to see"), (7, None, "This work is licensed under the GNU General Public License, version 3."), (8, "r/t/e.txt", "my driving licence was lost in the storm and never seen again by anyone"), (None, "r/s/x/y/z.txt", ""), (2, "r/a.txt", "text"),
    ]
    got = sorted(((r.doc_id or 0), r.own_license, r.license, r.inherited_from) for r in licenses.licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect())
    assert got == [
        (0, None, "Apache-2.0", "r/s"), (1, "MIT", "MIT", None), (2, None, "MIT", "r"), (2, None, "MIT", "r"), (3, None, "Apache-2.0", "r/s"), (4, "Apache-2.0", "Apache-2.0", None), (5, "CC-BY-NC-4.0", "CC-BY-NC-4.0", None), (6, None, None, None), (7, "GPL-3.0", "GPL-3.0", None), (8, None, "MIT", "r"),
    ]
    assert licenses.licenses(none.withColumn("path", F.lit("a/b"))).count() == 0


def test_cosines_by_force(spark):
    """Each part's best window against all forms, with term frequencies times idf as dictionaries."""
    templates = licenses.Templates(np.zeros(len(licenses.vocabulary()) + 1))
    words = licenses.vocabulary()
    idf = collections.defaultdict(lambda: templates.idf[-1], zip(words, templates.idf))

    def vector(own):
        return {t: n * idf[t] for t, n in collections.Counter(own).items()}

    def cosine(a, b):
        length = lambda v: math.sqrt(sum(x * x for x in v.values()))
        return sum(x * b.get(t, 0) for t, x in a.items()) / length(a) / length(b)

    for text in ["see below. Released under the MIT License, as is usual", licenses.TEMPLATES["BSD"][2].replace(",", "\n#"), "Permission is hereby granted free of charge to any person", licenses.TEMPLATES["Apache-2.0"][1] + " and more words follow here"]:
        for whole, part in licenses.notices(text, True):
            own, found = part.split(" "), []
            for name, form in templates.forms:
                size = len(own) if whole else min(len(form), len(own))
                needs = [g for g in licenses.DECIDING if g & set(form) and not any((name, t) in licenses.NO_NEED for t in g)]
                for i in range(len(own) - size + 1):
                    w = own[i : i + size]
                    around = set(own[max(0, i - licenses.NEAR) : i + size + licenses.NEAR]) if not whole else set(own)
                    if all(g & set(w) for g in needs) and not licenses.BARRED.get(name, set()) & set(w) and not licenses.BARRED_NEAR.get(name, set()) & around:
                        found.append((-round(cosine(vector(w), vector(form)), 5), name))
            least = min(found, default=(0.0, None))
            got = templates.best(own, whole)
            assert got[0] == pytest.approx(-least[0], abs=2e-5) and (got[1] == least[1] or not least[0])


def test_licence_ties_and_odd_input(spark, odd, none):
    """Equally similar files of one folder: the first by name; long texts, clashing columns and repeated rows."""
    text = "This work is licensed under the GNU General Public License, version {}."
    rows = [(1, "a/LICENSE", text.format(3)), (2, "a/LICENSE", text.format(2)), (3, "a/b/c.txt", "x"), (4, "a/long.txt", "word " * 60_000 + "\n" + text.format(3) + "\n" + "word " * 60_000)]
    got = {r.doc_id: (r.own_license, r.license) for r in licenses.licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got[3] == (None, "GPL-2.0") and got[4] == ("GPL-3.0", "GPL-3.0")
    rows = licenses.licenses(odd.withColumns({"path": F.lit("p/q.txt"), "_part": F.lit(1), "folder": F.lit(2), "license": F.lit(3)})).collect()
    assert len(rows) == 11 and not any(r.license for r in rows)


def test_licences_inside_longer_texts(spark):
    """Notices in one line with other text, across line breaks, and told apart by version and name."""
    wrapped = "/*\n * This {} is free\n * software; you can redistribute it and/or\n * modify it under the terms of the GNU {}General\n * Public License as published by the Free Software\n * Foundation; either version {} of the\n * License, or (at your option) any later version.\n */\nint main;"
    other = "lorem ipsum dolor sit amet " * 10
    cases = [
        ("Copyright 2020 Foo Bar. Released under the MIT License.", "MIT"), (other + "Released under the MIT License. " + other, "MIT"),
        (wrapped.format("program", "", "3"), "GPL-3.0"), (wrapped.format("program", "", "2"), "GPL-2.0"), (wrapped.format("library", "Lesser ", "2.1"), "LGPL-2.1"), (wrapped.format("library", "Lesser ", "3"), "LGPL-3.0"), (wrapped.format("program", "Affero ", "3"), "AGPL-3.0"),
        (other + "This work is licensed under the GNU General\nPublic License, version 2. " + other, "GPL-2.0"), ("It is under the GNU General Public License. " + other, "GPL"), ("MIT License\n\nCopyright (c) 2020 Foo\n\n" + licenses.TEMPLATES["MIT"][2], "MIT"), (licenses.TEMPLATES["MIT"][2].replace(" ", "\n# "), "MIT"),
        ("ISC License\n\nCopyright (c) 2020 Foo\n\n" + licenses.TEMPLATES["ISC"][2].replace(" the ", " the\n"), "ISC"), ("/*\n * Permission to use, copy, modify, and/or\n * distribute this software for any purpose with or\n * without fee is hereby granted, provided that the\n * above copyright notice and this permission notice\n * appear in all copies.\n */\nint x;", "ISC"),
        ("Copyright (c) 2020, Foo\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n", "BSD"),
        ("# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\nimport os", "Apache-2.0"),
        ("Released under the Foo License.", None), (other + "my driving licence was lost", None), ("Licensed under CC BY-NC-SA 4.0.", None), (other * 200 + "Licensed under CC BY-SA 4.0. " + other * 200, "CC-BY-SA-4.0"),
    ]
    docs = spark.createDataFrame([(i, f"d{i}/a.txt", t) for i, (t, _) in enumerate(cases)], "doc_id long, path string, text string")
    got = {r.doc_id: r.own_license for r in licenses.licenses(docs).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]
