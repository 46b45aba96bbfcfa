"""Draws towards a target, URL filters and source audits against brute force, and their defined results for odd input."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from atlasq.llm import divergence, target_draw, tries, url_filter

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- draws towards a target distribution


def drawn_by_force(rows, target, shortest, longest, buckets, least, percent, seed):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        own = word.findall((text or "").translate(LOW))
        return own, [" ".join(own[i : i + n]) for n in range(shortest, longest + 1) for i in range(len(own) - n + 1)]

    of = lambda f: zlib.crc32(f.encode()) % buckets
    s = collections.Counter(of(f) for _, t in rows for f in features(t)[1])
    t = collections.Counter(of(f) for x in target for f in features(x)[1])
    up, down = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log(float((t[b] + 1) * up) / float((s[b] + 1) * down))) for b in range(buckets)}
    out = []
    for doc_id, text in rows:
        own, fs = features(text)
        weight = sum(gain[of(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(own)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("lengths", [(1, 1), (1, 3), (2, 2)])
def test_draw(make, plain, spark, lengths):
    texts = [t for _, t, _ in plain[:80]]
    target = ["the Quick brown fox", None, "", "one two three", *[t[:500] for t in texts[:4]]]
    rows = [*((i, t) for i, t in enumerate(texts)), (None, texts[0]), (None, texts[1]), (7, texts[7]), (7, texts[9]), (90, None), (91, ""), (92, "naïve CAFÉ 0x1F " * 9)]
    docs = make([t for _, t in rows], [i for i, _ in rows])
    found = target_draw.draw(docs, spark.createDataFrame([(t,) for t in target], "text string"), *lengths, buckets=512, least_words=5, percent=30)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=str) == drawn_by_force(rows, target, *lengths, 512, 5, 30, target_draw.SEED)


def test_draw_odd_input(odd, none, spark):
    target = spark.createDataFrame([("one two",)], "text string")
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    found = target_draw.draw(odd.withColumns({"rank": F.lit("x"), "bucket": F.lit(1), "gain": F.lit(2), "_at": F.lit(0)}), target)
    assert sorted(map(tuple, found.collect()), key=str) == drawn_by_force(rows, ["one two"], 1, 1, 10_000, 20, 10, 2024)
    assert target_draw.draw(none, target).count() == 0
    everything = target_draw.draw(odd, target.limit(0), least_words=0, percent=100).collect()
    assert sorted(r["rank"] for r in everything) == list(range(1, 12))


# --- URL filters


def url_parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate(LOW), m[2]) if m else ("", "")


def url_rule(url, rules):
    own, path = url_parts(url)
    fits = [(len(r), r, v) for r, v in rules if (own == r.split("/")[0] or own.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits)[1:] if fits else (None, None)


def url_features(url):
    url, (own, path) = url or "", url_parts(url)
    counts = collections.Counter(url).values()
    query = re.match(r"[^?#]*\?([^#]*)", url)
    lex = [len(url), sum(x != "" for x in path.split("/")), sum(c in "0123456789" for c in url) / max(1, len(url)), sum(c * math.log2(len(url) / c) for c in counts) / max(1, len(url)), sum(x != "" for x in query[1].split("&")) if query else 0]
    ext = re.search(r"\.([0-9A-Za-z]{1,8})/?$", path)
    labels = own.split(".")
    return lex, [zlib.crc32(x.encode()) % url_filter.SUFFIX_BUCKETS for x in (labels[-1], ".".join(labels[-2:]), own, ext[1] if ext else "")]


def forest_by_force(urls, rules):
    """Scores of urls: the same trees, grown over plain lists."""
    told = sorted({u for u in urls if u is not None and url_rule(u, rules)[0]}, key=str.encode)
    y = [int(url_rule(u, rules)[1] == "block") for u in told]
    prior = (sum(y) + 1) / (len(y) + 2)
    seen = collections.Counter()
    for u, b in zip(told, y):
        for k, x in enumerate(url_features(u)[1]):
            for own in (None, zlib.crc32(u.encode()) % url_filter.FOLDS):
                seen[k, x, own, "n"] += 1
                seen[k, x, own, "b"] += b

    def row(u, fold):
        lex, buckets = url_features(u)
        out = list(map(float, lex))
        for k, x in enumerate(buckets):
            n, b = ((seen[k, x, None, c] - (seen[k, x, fold, c] if fold is not None else 0)) for c in "nb")
            out.append((b + 4 * prior) / (n + 4))
        return out

    base = math.log(prior / (1 - prior))
    x = np.array([row(u, zlib.crc32(u.encode()) % url_filter.FOLDS) for u in told])
    every = np.array([row(u, None) for u in urls])
    margin, out = np.full(len(told), base), np.full(len(urls), base)
    if not 0 < sum(y) < len(y):
        return 1 / (1 + np.exp(-out))
    edges = [sorted({float(np.quantile(x[:, f], i / url_filter.BINS)) for i in range(1, url_filter.BINS)}) for f in range(x.shape[1])]

    def grow(rows, level):
        """A function of feature rows."""
        gs, hs = g[rows].sum(), h[rows].sum()
        best, cut = 1e-9, None
        for f in range(x.shape[1]) if level < url_filter.DEPTH else ():
            for e in edges[f]:
                left = rows[x[rows, f] <= e]
                if min(len(left), len(rows) - len(left)) < url_filter.LEAST_ROWS:
                    continue
                gl, hl = g[left].sum(), h[left].sum()
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                if gain > best + 1e-12:
                    best, cut = gain, (f, e)
        if cut is None:
            value = url_filter.RATE * gs / (hs + 1)
            return lambda m: np.full(len(m), value)
        f, e = cut
        low, high = grow(rows[x[rows, f] <= e], level + 1), grow(rows[x[rows, f] > e], level + 1)
        return lambda m: np.where(m[:, f] <= e, low(m), high(m))

    for _ in range(url_filter.TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = np.array(y) - p, p * (1 - p)
        tree = grow(np.arange(len(told)), 0)
        margin, out = margin + tree(x), out + tree(every)
    return 1 / (1 + np.exp(-out))


def test_url_filter(spark, sf, monkeypatch):
    monkeypatch.setattr(url_filter, "TREES", 4)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    urls = [(r.page_id, r.url) for r in pages.collect()]
    urls += [(None, urls[0][1]), (7, urls[7][1]), (9000, None), (9001, ""), (9002, "no host"), (9003, "HTTP://WWW.A.NET"), (9004, "x://Example.NET/en/1?a&b=&&c#d?e"), (9005, "x://net/"), (9006, "x://notnet/en/"), (9007, "x://a.org/fr/" + "z9" * 30_000), (9008, "a://b://c.net/x"), (9009, "x://a.example.com/DE/")]
    odd = spark.createDataFrame(urls, "page_id long, url string").withColumns({"host": F.lit("clash"), "rule": F.lit(1), "fold": F.lit(2), "kind": F.lit(""), "score": F.lit(0)})
    found = sorted((tuple(r) for r in url_filter.judge(odd).collect()), key=str)
    scores = forest_by_force([u for _, u in urls], url_filter.RULES)
    want = []
    for (page_id, url), score in zip(urls, scores):
        rule, verdict = url_rule(url, url_filter.RULES)
        want.append((page_id, *url_parts(url), rule, verdict or ("block" if score > 0.5 else "allow"), score))
    want.sort(key=str)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in found], [r[5] for r in want])


def test_url_filter_learns(spark):
    """On URLs held out from the rules, blocked ones being long, deep and full of digits, the trees find most."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1200):
        bad = bool(rng.integers(2))
        domain = ("bad.net" if bad else "good.org") if i < 800 else "other.com"
        word = "".join(rng.choice(list("0123456789xyz" if bad else "abcdefgh"), 25 if bad else 9))
        rows.append((i, f"http://h{i % 50}.{domain}/{'a/b/' if bad else ''}{word}" + ("?q=1&r=2" if bad else ""), bad))
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    judged = url_filter.judge(pages, (("net/", "block"), ("org/", "allow")))
    held = judged.where("rule is null").join(pages.select("page_id", "bad"), "page_id")
    assert held.count() == 400 and held.where((F.col("verdict") == "block") == F.col("bad")).count() >= 380


def test_url_filter_without_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.com/"), (2, None), (2, None)], "page_id long, url string")
    assert sorted(map(tuple, url_filter.judge(pages).collect()), key=str) == [(1, "a.com", "/", None, "allow", 0.5), (2, "", "", None, "allow", 0.5), (2, "", "", None, "allow", 0.5)]
    assert url_filter.judge(pages.limit(0)).count() == 0
    one_kind = spark.createDataFrame([(1, "http://a.net/"), (2, "http://b.com/")], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge(one_kind).orderBy("page_id").collect()] == ["block", "block"]


# --- source divergence


def audit_by_force(rows, least=3, top=200):
    """rows of (lang, source, text)."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    rows = [(a or "", b or "", term.findall((t or "").translate(LOW))) for a, b, t in rows]
    docs = collections.Counter((a, w) for a, _, ws in rows for w in set(ws))
    count = collections.Counter((a, b, w) for a, b, ws in rows for w in ws if docs[a, w] >= least)
    out = []
    for lang in {a for a, _, _ in rows}:
        kept = [w for (a, w), n in docs.items() if a == lang and n >= least]
        sources = {b for a, b, _ in rows if a == lang}
        n = {b: sum(count[lang, b, w] for w in kept) for b in sources}
        share = lambda c, total: 1 + 1000000000 * (c + 1) // (total + len(kept))
        p = {(b, w): share(count[lang, b, w], n[b]) for b in sources for w in kept}
        q = {w: share(sum(count[lang, b, w] for b in sources), sum(n.values())) for w in kept}
        for a in sources:
            pairs = [(-sum((p[a, w] - p[b, w]) ** 2 // p[b, w] for w in kept), b.encode()) for b in sources if b != a]
            terms = [(-((p[a, w] - q[w]) ** 2 // q[w]), w.encode()) for w in kept if count[lang, a, w] and p[a, w] > q[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, a, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block, top", [(2048, 200), (3, 5)])
def test_audit(documents, block, top):
    rows = [(r.lang, r.source, r.text) for r in documents.select("lang", "source", "text").collect()]
    assert sorted(map(tuple, divergence.audit(documents, top=top, block=block).collect())) == audit_by_force(rows, top=top)


def test_audit_odd_input(odd, none, spark):
    texts = ["", None, "Übung ÜBUNG a1b", "x" * 300_000, "x" * 300_000 + "y", "tie tie ab ba", "ab ba", "12 !!"]
    rows = [("l" if k % 3 else None, ["s", "", None, "ß", "s/t"][k % 5], t) for k, t in enumerate(texts * 4)] + [("alone", "only", "one"), ("none", "a", ""), ("none", "b", "z")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"part": F.lit(1), "value": F.lit("v"), "range": F.lit(0), "n": F.lit(3)})
    assert sorted(map(tuple, divergence.audit(docs).collect())) == audit_by_force(rows)
    rows = [(r.lang, r.source, r.text) for r in odd.select("lang", "source", "text").collect()]
    assert sorted(map(tuple, divergence.audit(odd, least_docs=1).collect())) == audit_by_force(rows, 1)
    assert divergence.audit(none).count() == 0


TERMS = st.dictionaries(st.binary(min_size=1, max_size=5) | st.just(b"a" * 60) | st.just(b"a" * 60 + b"b"), st.dictionaries(st.sampled_from(["s", "t", ""]), st.integers(1, 9), min_size=1), max_size=8)


def trie_of(terms):
    sources = ["", "s", "t"]
    entries = [(k, sources.index(s), c) for k, (w, own) in enumerate(terms.items()) for s, c in own.items()]
    size = [len(own) for own in terms.values()]
    return tries.Trie(pa.array(list(terms), pa.large_binary()), np.array(size, np.int64), np.cumsum([0, *size]), np.array([e[1] for e in entries], np.int64), np.array([e[2] for e in entries], np.int64), sources)


def leaves_of(trie):
    return {w: {trie.sources[s]: c for s, c in zip(trie.source[a:b].tolist(), trie.count[a:b].tolist())} for w, a, b in zip(trie.terms.to_pylist(), trie.at[:-1].tolist(), trie.at[1:].tolist())}


@settings(max_examples=80, deadline=None)
@given(st.lists(TERMS, min_size=1, max_size=4), st.lists(st.binary(max_size=3), max_size=3))
def test_tries(some, borders):
    whole = tries.merge([trie_of(t) for t in some])
    want: dict = {}
    for t in some:
        for w, own in t.items():
            for s, c in own.items():
                want.setdefault(w, collections.Counter())[s] += c
    assert leaves_of(whole) == want and list(leaves_of(whole)) == sorted(want)
    assert whole.docs.tolist() == [sum(len(t[w]) for t in some if w in t) for w in sorted(want)]
    back = [tries.from_row(r) for r in whole.rows("en")]
    assert {w: c for t in back for w, c in leaves_of(t).items()} == want
    parts = list(whole.cut(sorted(borders)))
    assert [w for _, t in parts for w in leaves_of(t)] == sorted(want)
    assert all(sum(b <= w for b in sorted(borders)) == k for k, t in parts for w in leaves_of(t))
    assert leaves_of(whole.kept(whole.docs > 1)) == {w: c for w, c in want.items() if sum(len(t[w]) for t in some if w in t) > 1}


def test_tries_handed_on_in_parts(monkeypatch):
    """A task that holds many entries hands its tries on before its end; nothing is lost or counted twice."""
    texts = [f"w{'abcdefghij'[i % 10]}{'klmnop'[i % 6]} same {'q' * (i % 50)}" for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 400), pa.array([f"s{i % 7}" for i in range(400)]), pa.array(texts)], ["lang", "source", "text"])
    want = None
    for most in (2_000_000, 50):
        monkeypatch.setattr(divergence, "MOST_ENTRIES", most)
        found = [tries.from_row(r) for b in divergence.counted(iter([batch.slice(0, 150), batch.slice(150)])) for r in b.to_pylist()]
        whole = leaves_of(tries.merge(found))
        want = want or whole
        assert whole == want and len(found) == (1 if most > 50 else 2)


def test_shares_are_exact():
    rng = np.random.default_rng(3)
    total = rng.integers(1, 9 * 10**15, 500)
    count = np.minimum(rng.integers(0, 9 * 10**15, 500), total - 1)
    assert divergence.share(count, total).tolist() == [1 + 10**9 * (c + 1) // t for c, t in zip(count.tolist(), total.tolist())]
