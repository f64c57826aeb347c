import uuid

from pyspark.sql import functions as F

from quern.engine import Engine
from quern.functions import sql
from quern.operators.retrieval import QuerySpec
from quern.providers import GazetteerExtract, HashedEmbedding, schema_prompt
from quern.sources import store


def test_store_snapshots(spark, tmp_path):
    s, schema = store.TableStore(spark, str(tmp_path)), "k int, v string"
    assert s.read("t", schema).count() == 0
    s.write("t", spark.createDataFrame([(1, "a"), (2, "b")], schema))
    s.upsert("t", spark.createDataFrame([(2, "c"), (3, "d")], schema), schema, ["k"], ["v"])
    s.purge("t", spark.createDataFrame([(1,)], "k int"), schema, "k")
    assert sorted(map(tuple, s.read("t", schema).collect())) == [(2, "c"), (3, "d")]
    assert s.vacuum("t") == 2 and s.read("t", schema).count() == 2


def test_ingest_replaces_and_purges(spark, data, tmp_path):
    e = Engine(spark, data, str(tmp_path))
    files = lambda body: spark.createDataFrame([("a.md", bytearray(body)), ("b.md", bytearray(b"# B\n\ntext"))], "path string, content binary")
    first = e.ingest(files(b"# A\n\none\n\ntwo"))
    assert first == {"elements": 5, "chunks": 2} == e.ingest(files(b"# A\n\none\n\ntwo"))
    assert e.ingest(files(b"# A"))["elements"] == 3
    e.purge(spark.createDataFrame([(str(uuid.uuid5(uuid.NAMESPACE_URL, "a.md")),)], "document_id string"))
    assert e.store.read("chunks", "document_id string, text string").count() == 1


def test_every_strategy_answers_a_query(spark, data):
    e = Engine(spark, data)
    name = spark.read.parquet(f"{data}/extracted_relationships.parquet").select("from_name").first()[0]
    text = spark.read.parquet(f"{data}/text_chunks.parquet").where("embedding IS NOT NULL AND length(chunk_text) > 40 AND aggregate(embedding, 0D, (a, x) -> a + x * x) > 0").select("id", "chunk_text", "embedding").first()
    q = spark.createDataFrame([("q1", f"what is {name}", None), ("q2", text.chunk_text, text.embedding)], "qid string, query_text string, vector array<float>")
    for strategy in ("basic", "hybrid"):
        got = e.search(QuerySpec(strategy=strategy, top_k=5, rerank=True), q).where("qid = 'q2'").orderBy("rank").collect()
        assert text.id in [r.id for r in got] and [r["rank"] for r in got] == list(range(1, len(got) + 1)) and got[0].rerank_score == max(r.rerank_score or 0 for r in got) > 0
    assert {r.qid for r in e.search(QuerySpec(strategy="local", top_k=5), q).collect()} >= {"q1"}
    assert 0 < e.search(QuerySpec(strategy="global", top_k=5), q).where("qid = 'q1'").count() <= 5
    assert e.search(QuerySpec(strategy="drift", top_k=5), q).where("qid = 'q1'").count() > 0
    assert e.search("images_only", q).where("modality NOT IN ('image', 'schematic', 'image_description')").count() == 0
    assert e.search(QuerySpec(min_confidence=2.0), q).count() == 0
    assert e.search(QuerySpec(filters={"document_ids": ["none"]}), q).count() == e.search(QuerySpec(filters={"source_names": ["none"]}), q).count() == 0
    assert [r.a for r in e.neighbourhood(["nobody"]).collect()] == ["nobody"]


def test_sql_functions(spark):
    sql.register(spark)
    r = spark.sql("SELECT norm_text('a‑b') AS n, approx_tokens('a b c d e f g h i j') AS t, uuid5_url('x') AS u, uuid5_dns('x') AS d, cosine_similarity(array(1D, 0D), array(1D, 1D)) AS c, cosine_similarity(array(0D), array(1D)) AS z, fusion_score(0.8, 0.9, NULL, NULL, 2, false) AS f, fusion_score(0.9, 1, NULL, 'PART_OF', 1, true) AS g, mil_id_overlap('see PN-4521', 'PN-4521.') AS m, mil_id_overlap(NULL, 'x') AS k").first()
    assert (r.n, r.t, r.u, r.d, round(r.c, 6), r.z, r.f) == ("a-b", 13, str(uuid.uuid5(uuid.NAMESPACE_URL, "x")), str(uuid.uuid5(uuid.NAMESPACE_DNS, "x")), 0.707107, None, 0.6856)
    assert (r.g, r.m, r.k) == (0.95, True, False)


def test_providers(spark):
    el = spark.createDataFrame([("d", "u", "The Coppervane radar")], "document_id string, element_uid string, content_text string")
    g = spark.createDataFrame([("coppervane", "RADAR_SYSTEM"), ("x", "ODD")], "name string, entity_type string")
    assert [(r.name, r.layer) for r in GazetteerExtract(g).extract(el).collect()] == [("coppervane", "equipment")]
    v = el.select(HashedEmbedding(8).embed(F.col("content_text"), "query").alias("v"), HashedEmbedding(8).embed(F.lit(None).cast("string")).alias("n")).first()
    assert len(v.v) == 8 and abs(sum(x * x for x in v.v) - 1) < 1e-9 and v.n is None
    assert "- RADAR_SYSTEM EMITS RF_EMISSION" in schema_prompt("equipment")


def test_patterns(spark):
    df = spark.createDataFrame([("a.pdf",), ("b.PDF",), ("c[1].txt",), (None,)], "n string")
    assert [r.m for r in df.select(store.matches_any(F.col("n"), ["*.pdf", "c?1?.*"]).alias("m")).collect()] == [True, False, True, False]
    assert not df.where(store.matches_any(F.col("n"), [])).count()


def test_objects_are_kept_once(spark, tmp_path):
    o = store.ObjectStore(spark, str(tmp_path))
    key, n = o.put([b"ab", b"", b"c"])
    assert (n, o.put([b"abc"])[0], o.get(key)) == (3, key, b"abc") and len(key) == 64
    empty, n = o.put([])
    assert n == 0 and o.get(empty) == b""
    assert o.delete(key) and o.get(key) is None and not o.delete(key)


def test_vector_table(spark, tmp_path):
    t = store.VectorTable(store.TableStore(spark, str(tmp_path)), "v")
    make = lambda *rows: spark.createDataFrame([(i, v, d, "text", c, {"a": "b"}) for i, v, d, c in rows], t.SCHEMA)
    assert t.read().count() == 0
    t.upsert(make(("1", [1.0, 0.0], "d", "CUI"), ("2", [0.0, 1.0], "e", None), (None, [0.0, 1.0], "e", None)))
    t.upsert(make(("2", [1.0, 0.1], "e", "CUI"), ("3", None, "d", None)))
    q = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, vector array<float>")
    assert [r.id for r in t.search(q, 5).orderBy("rank").collect()] == ["1", "2"]
    assert [r.id for r in t.search(q, 5, {"document_ids": ["e"], "classification": "CUI"}).collect()] == ["2"]
    t.delete(F.col("document_id") == "d")
    assert [r.id for r in t.read().collect()] == ["2"]


def test_graph_index_round_trip(spark, data, tmp_path):
    g = store.GraphTables(store.TableStore(spark, str(tmp_path / "none")))
    assert not g.ready() and g.read("entities").count() == 0
    made = Engine(spark, data).index_graph(str(tmp_path / "g"))
    assert made.ready() and all(made.read(t).count() for t in store.GRAPH_TABLES)


def test_periodic_jobs(spark, tmp_path):
    from datetime import datetime

    from quern.streaming.watch import Periodic

    runs = []
    p = Periodic(store.TableStore(spark, str(tmp_path)))
    at = lambda m: datetime(2024, 1, 1, 0, m)
    assert [p.run("index", 600, lambda: runs.append(1), at(m)) for m in (0, 5, 10, 12, 20)] == [True, False, True, False, True] and len(runs) == 3
    assert not p.run("index", 0, lambda: p.run("index", 0, lambda: runs.append(2), at(50)), at(40)) or 2 not in runs
