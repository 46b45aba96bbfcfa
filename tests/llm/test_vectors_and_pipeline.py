import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasq.llm import queries, search
from atlasq.llm.components import connected_components


def force(rows, k=20):
    good = [(i, [np.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (qi, q) in enumerate(good):
        if qi % 20 == 0:
            scores = sorted((-int(sum(x * y for x, y in zip(q, v))), vi) for b, (vi, v) in enumerate(good) if b != a)[:k]
            out += [(qi, n + 1, vi, -s) for n, (s, vi) in enumerate(scores)]
    return sorted(out)


def test_search(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted(map(tuple, search.top_products(spark.read.parquet(f"{sf}/embeddings.parquet")).collect()))
    assert got == force(rows)


def test_search_odd(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(45)] + [(60, [1.0, 1.0, 1.0, 1.0]), (61, [1.0, 1.0, 1.0, 1.0]), (62, [1.0, 1.0, 1.0, 1.0]), (80, None), (100, [1.0, None, 1.0, 1.0]), (120, [float("nan")] * 4), (140, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (160, []), (180, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("_rid", F.lit("clash"))
    assert sorted(map(tuple, search.top_products(df).collect())) == force(rows)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, search.top_products(few).collect())) == force(rows[:3])
    assert search.top_products(df.limit(0)).count() == 0


def test_search_large_components(spark):
    """Products beyond doubles and longs are ranked exactly; scores stop at the ends of a long."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=3) * 10.0 ** rng.integers(0, 9)).tolist()) for i in range(50)] + [(60, [1e8, 2.0, 0.0]), (61, [1e8, 2.0, 1 / 64]), (62, [3e38, 1.0, -1.0]), (80, [-3e38, 1.0, 1.0]), (81, [3e38, 1.0, 2.0]), (82, [1e300, 0.0, 0.0]), (100, [0.0, 0.0, 0.0]), (101, [1.7e308, 1.0, 1.0])]
    clipped = lambda n: max(-(1 << 63), min((1 << 63) - 1, n))
    good = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if np.isfinite(64 * np.array(v)).all()]
    want = []
    for a, (qi, q) in enumerate(good):
        if qi % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(q, v)), vi) for b, (vi, v) in enumerate(good) if b != a)[:20]
            want += [(qi, n + 1, vi, clipped(-s)) for n, (s, vi) in enumerate(scores)]
    got = search.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_search_stops_at_far_annuli(spark, monkeypatch):
    """Vectors in tight groups: most annuli can't hold a better product, and what is left out changes nothing."""
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(40, 8)) * 20
    rows = [(i, (centre[i % 40] + rng.normal(size=8)).tolist()) for i in range(800)]
    monkeypatch.setattr(search, "BLOCK", 64)
    got = search.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5)
    assert sorted(map(tuple, got.collect())) == force(rows, 5)


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, 5), (1, 2), (2, 1), (2, 3), (200, 140), (7, 8)] + [(300, i) for i in range(301, 360)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and got[200] == 100 and got[3] == got[2] == 1 and got[8] == 7 and got[359] == 300 and 5 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark, documents, sf):
    import corpus_pipeline as P

    docs, kept = documents, {}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == documents.columns and docs.schema.simpleString() == documents.schema.simpleString()
        kept[name] = docs.count()
    assert 0 < kept["n-gram Jaccard join"] < kept["quality rules"] < documents.count()
    pieces = P.STAGES[-1][1](spark, docs, sf)
    words = lambda df: df.agg(F.sum("length")).first()[0]
    assert words(pieces) == pieces.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
    assert pieces.where("start = 0").count() == docs.count()
    assert P.run(spark, sf).count() == pieces.count()


def _written():
    from atlasq.llm import store

    return {p for p in store._readers if os.path.exists(p.removeprefix("file://"))}


def test_stages_leave_no_tables_behind(spark, documents, sf, tmp_path):
    """Tables of a result go once nothing reads them any more, not while it, or what is derived from it, is still there."""
    import corpus_pipeline as P
    from atlasq.llm import store

    store.release(spark)
    before = _written()
    first = P.STAGES[0][1](spark, documents, sf)
    mine = _written() - before
    derived = first.where("doc_id >= 0").select("doc_id")
    rows = sorted(r.doc_id for r in first.collect())
    first.write.parquet(f"file://{tmp_path}/first")
    del first
    assert mine and not mine & set(store.release(spark)) and sorted(r.doc_id for r in derived.collect()) == rows
    del derived
    second = P.STAGES[1][1](spark, spark.read.parquet(f"file://{tmp_path}/first"), sf)
    assert not mine & _written() and 0 < second.count() < len(rows)


def test_two_stages_alive_at_once(spark, documents, sf):
    import corpus_pipeline as P

    halves = [documents.where(f"doc_id % 2 = {k}") for k in range(2)]
    alone = [sorted(r.doc_id for r in P.STAGES[0][1](spark, h, sf).collect()) for h in halves]
    one, other = (P.STAGES[0][1](spark, h, sf) for h in halves)
    later = P.STAGES[1][1](spark, one, sf)
    assert sorted(r.doc_id for r in one.collect()) == alone[0] and sorted(r.doc_id for r in other.collect()) == alone[1]
    assert {r.doc_id for r in later.collect()} < set(alone[0])


def test_two_pipelines_alive_at_once(spark, documents, tmp_path):
    import corpus_pipeline as P

    found = []
    for k in range(2):
        documents.where(f"doc_id % 2 = {k}").write.parquet(f"file://{tmp_path}/{k}/documents.parquet")
        found.append(P.run(spark, f"file://{tmp_path}/{k}"))
    for k in range(2):
        ids = {r.doc_id for r in found[k].collect()}
        assert ids and all(i % 2 == k for i in ids)


def test_pipeline_with_odd_rows(spark, odd):
    """Nulls, repeated rows, clashing columns and long texts pass through every stage; columns stay."""
    import corpus_pipeline as P

    docs = odd
    for _, work in P.STAGES[:-1]:
        docs = work(spark, docs, "")
        assert docs.columns == odd.columns
    kept = [r.doc_id for r in docs.collect()]
    pieces = P.STAGES[-1][1](spark, docs, "").collect()
    assert set(kept) <= {5, 6} and {r.doc_id for r in pieces} == set(kept)


def test_pipeline_takes_nothing(spark, none):
    import corpus_pipeline as P

    docs = none
    for _, stage in P.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_registered():
    numbers = {int(n[2:].split("_")[0]) for n in queries.QUERIES}
    assert numbers == set(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)
    assert os.path.exists("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "pages"):
        con.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want, got = con.sql(queries.ORACLES[name]).df(), queries.QUERIES[name](spark, sf).toPandas()
    rows = lambda d: sorted(map(tuple, d[sorted(d.columns)].map(str).values))
    assert sorted(want.columns) == sorted(got.columns) and rows(want) == rows(got)
