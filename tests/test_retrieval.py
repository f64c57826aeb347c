import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.operators import links as L
from quern.operators import retrieval as R
from quern.operators import vectors as V
from quern.plans import retrieval as plans


def fused(spark, sem, link=None, cross=None, rel=None, hops=1, bonus=False):
    c = lambda v, k: F.lit(v).cast(k)
    return spark.range(1).select(R.fusion(c(sem, "double"), c(link, "double"), c(cross, "double"), c(rel, "string"), c(hops, "int"), F.lit(bonus)).alias("s")).first().s


def test_fusion(spark):
    assert fused(spark, 0.8, cross=0.85) == 0.69
    assert fused(spark, 0.0) == 0.0
    assert fused(spark, 0.8, link=0.9, bonus=True) == 0.73
    assert fused(spark, 0.8, link=0.9, hops=2) == 0.6856
    assert [fused(spark, 0.6, rel=r) for r in ("IS_VARIANT_OF", "RELATED_TO", "odd")] == [0.5325, 0.5025, 0.495]
    assert fused(spark, 1.0, link=1.0, rel="IS_VARIANT_OF", bonus=True) == 1.0


def test_merge_keeps_the_best_and_all_without_id(spark):
    df = spark.createDataFrame([("q", "c1", 0.5), ("q", "c1", 0.9), ("q", "c2", 0.7), ("q", "c2", 0.3), ("q", "c3", 0.6), ("q", None, 0.1), ("q", None, 0.1)], "qid string, id string, score double")
    assert sorted((r.id or "", r.score) for r in R.merge_seeds(df).collect()) == [("", 0.1), ("", 0.1), ("c1", 0.9), ("c2", 0.7), ("c3", 0.6)]


def test_diversify_passes_images_and_empty_texts(spark):
    rows = [("q", "a", 0.9, "d", 1, "text", "Same "), ("q", "b", 0.8, "d", 1, "text", "same"), ("q", "c", 0.7, "d", 2, "text", "same"), ("q", "i", 0.6, "d", 1, "image", "same"), ("q", "n", 0.5, "d", 1, "text", None)]
    df = spark.createDataFrame(rows, "qid string, id string, score double, document_id string, page_number int, modality string, chunk_text string")
    assert sorted(r.id for r in R.diversify(df).collect()) == ["a", "c", "i", "n"]


def test_topk_is_exact(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((300, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, [0.0] * 8), (901, None), (902, [1.0])], "id bigint, vector array<float>").repartition(5)
    q = df.where("id < 7").withColumnRenamed("id", "qid")
    got = {(r.qid, r["rank"]): r.id for r in V.topk(q, df, 5, block=3).collect()}
    u = np.float32(v).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for i in range(7):
        assert [got[i, k + 1] for k in range(5)] == np.argsort(-(u @ u[i]), kind="stable")[:5].tolist()
    assert V.topk(q.where("false"), df, 5).count() == 0


def test_bm25_and_rerank(spark):
    docs = spark.createDataFrame([(1, "radar antenna"), (2, "radar radar mixer"), (3, None), (4, "")], "id int, text string")
    q = spark.createDataFrame([(9, "Antenna?"), (8, None)], "qid int, text string")
    rows = R.bm25(docs, q, 5).collect()
    assert [(r.qid, r.id) for r in rows] == [(9, 1)]


def test_links_are_symmetric(spark, data):
    df = plans.chunk_links_all(spark, data)
    back = df.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "link_type", "weight", "hop")
    assert df.exceptAll(back).count() == 0 and df.count() > 0
    assert L.next_chunk(df.where("false").select(F.lit("d").alias("document_id"), F.lit(1).alias("page_number"), F.lit(1).alias("chunk_index"), F.lit("x").alias("id"))).count() == 0


def test_query_spec():
    assert R.QuerySpec(top_k=10).fetched == 80 and R.QuerySpec(top_k=100).fetched == 800
    for bad in ({"top_k": 0}, {"top_k": 101}, {"strategy": "x"}, {"modality": "x"}):
        try:
            R.QuerySpec(**bad)
        except ValueError:
            continue
        raise AssertionError(bad)


@settings(max_examples=25, deadline=None)
@given(st.floats(0, 1), st.floats(0, 1), st.integers(1, 4))
def test_fusion_is_monotone_in_python(sem, link, hops):
    f = lambda s, w, h: R.SEMANTIC * s + R.STRUCTURE * w * R.HOP ** (h - 1)
    assert f(min(1, sem + 0.1), link, hops) >= f(sem, link, hops) >= f(sem, link, hops + 1) and f(sem, link, hops) <= 1


def test_smoke_entry(spark, data):
    out = plans.hybrid_query(spark, data)
    assert out.count() > 0


def test_fuzzy_terms(spark):
    docs = spark.createDataFrame([(1, "the hydraulic pump"), (2, "the hydralic pump"), (3, "a valve"), (4, None), (5, "")], "id int, text string")
    q = spark.createDataFrame([(1, "hydraulic"), (2, "zzz"), (3, None)], "qid int, text string")
    assert [r.id for r in R.bm25(docs, q, 5).collect()] == [1]
    assert {r.id for r in R.bm25(docs, q, 5, fuzzy=True).collect()} == {1, 2}
    assert R.bm25(docs.where("false"), q, 5).count() == R.bm25(docs, q.where("false"), 5).count() == 0
    assert all(R.within_one(a, b) == w for a, b, w in (("abc", "abc", True), ("abc", "abd", True), ("abc", "ab", True), ("abc", "xabc", True), ("abc", "acb", False), ("ab", "abcd", False)))
