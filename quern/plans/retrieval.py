"""Queries of retrieval: vector search, links, expansion, fusion, ranking, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import links as L
from quern.operators import retrieval as R
from quern.operators import vectors as V
from quern.operators.cleaning import keep_first
from quern.sources.ontology import weight_sql
from quern.tables import latest, materialise, table

DIM = 64


TEXT = ("artifact_id", "document_id", "chunk_index", "chunk_text", "embedding", "modality", "page_number", "classification")
#: The columns that links are made by.
PLACE = ("artifact_id", "document_id", "chunk_index", "page_number")


def _texts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row of each text chunk, of the given columns."""
    return latest(table(spark, d, "text_chunks").select("id", "updated_at", *(columns or TEXT)), "id", "updated_at")


def _images(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return latest(table(spark, d, "image_chunks").select("id", "created_at", *(columns or ("document_id", "chunk_index", "chunk_text", "modality", "page_number"))), "id", "created_at")


def _is_query(column: str = "id"):  # noqa: ANN202
    """The stated query set: rows whose id, its first eight digits read as a number, is divisible by 20."""
    return F.conv(F.substring(column, 1, 8), 16, 10).cast("bigint") % 20 == 0


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    found = V.topk(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 10)
    return found.select("qid", "id", F.round("score", 6).alias("score"), "rank")


def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    """As vector_topk among vectors of given labels, at a score of 0.25 or more."""
    e = table(spark, d, "embeddings")
    own = e.where(R.payload_filter({"label": [0, 1, 2], "vec_id": None}))
    found = V.topk(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector")), own.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 10, R.LEAST_SCORE)
    return found.select("qid", "id", F.round("score", 6).alias("score"), "rank")


def vector_normalize(spark: SparkSession, d: str) -> DataFrame:
    v = _texts(spark, d, "embedding").where("embedding IS NOT NULL").select("id", V.unit(F.col("embedding")).alias("u"))
    return v.select("id", F.size("u").alias("dim"), F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm2"), F.round(F.element_at("u", 1), 6).alias("first"))


def hashed_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """The stand-in embedding model over image captions, with the prefix of passages."""
    v = _images(spark, d).where("chunk_text <> ''").select("id", V.hashed_embedding(F.concat(F.lit("passage: "), "chunk_text"), 16).alias("u"))
    return v.select("id", F.array_join(F.transform("u", lambda x: F.round(x, 4).cast("string")), " ").alias("embedding"))


def next_chunk_links(spark: SparkSession, d: str) -> DataFrame:
    return L.next_chunk(_texts(spark, d, *PLACE))


def section_links(spark: SparkSession, d: str) -> DataFrame:
    return L.same_section(table(spark, d, "structured_chunks").select(F.col("chunk_key").alias("id"), "document_id", "section_path", "page_number", "chunk_index").distinct())


def same_page_links(spark: SparkSession, d: str) -> DataFrame:
    return L.same_page(_texts(spark, d, *PLACE), _images(spark, d, "document_id", "page_number"))


def chunk_links_all(spark: SparkSession, d: str) -> DataFrame:
    return L.all_links(_texts(spark, d, *PLACE), _images(spark, d, "document_id", "page_number"))


def _seeds(queries: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank, document_id, ...): the diversified best chunks for each query (qid, vector)."""
    spec = R.QuerySpec(top_k=k)
    found = V.topk(queries.select("qid", "vector"), texts.select("id", F.col("embedding").alias("vector")), spec.fetched, R.LEAST_SCORE)
    rows = found.select("qid", "id", F.round("score", 6).alias("score")).join(texts.select("id", "document_id", "page_number", "modality", "classification", "chunk_text"), "id")
    return R.cut(R.diversify(rows), k)


def seed_search(spark: SparkSession, d: str) -> DataFrame:
    t = _texts(spark, d)
    return _seeds(stated_queries(t), t, 10).select("qid", "id", "score", "rank")


def link_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Structural links of every query chunk itself, scored by fusion."""
    t = _texts(spark, d, *PLACE)
    seeds = t.where(_is_query()).select(F.col("id").alias("qid"), "id", F.lit(0.8).alias("score"))
    rows = L.expand(seeds, L.all_links(t, _images(spark, d, "document_id", "page_number")))
    none = F.lit(None).cast("string")
    return rows.select("qid", "target_id", "link_type", "hop", R.fusion(F.col("score"), F.col("weight"), F.lit(None).cast("double"), none, F.col("hop"), F.lit(False)).alias("score"))


def cross_modal(spark: SparkSession, d: str) -> DataFrame:
    """Texts of the document of query images that have no link, five each, by the chunk - document - chunk path."""
    i, t = _texts(spark, d, *PLACE), _images(spark, d, "document_id", "page_number", "chunk_index")
    bare = t.where(_is_query()).join(L.all_links(i, t).select(F.col("source_id").alias("id")).distinct(), "id", "left_anti")
    rows = bare.select(F.col("id").alias("qid"), "document_id").join(i.select("document_id", F.col("id").alias("target_id"), F.col("chunk_index")), "document_id")
    ranked = R.cut(rows.withColumnsRenamed({"target_id": "id"}).withColumn("score", -F.col("chunk_index").cast("double")), 5)
    none = F.lit(None).cast("string")
    return ranked.select("qid", F.col("id").alias("target_id"), R.fusion(F.lit(0.8), F.lit(None).cast("double"), F.lit(R.CROSS), none, F.lit(2), F.lit(False)).alias("score"))


def fusion_score(spark: SparkSession, d: str) -> DataFrame:
    """The fusion formula over every relationship, its confidence standing for similarity."""
    r = table(spark, d, "extracted_relationships")
    hops = F.when(F.col("from_type") == F.col("to_type"), 2).otherwise(1)
    s = R.fusion(F.col("confidence"), F.lit(0.9), F.lit(None).cast("double"), F.col("rel_type"), hops, F.col("from_name") == F.col("to_name"))
    return r.select("document_id", "from_name", "rel_type", "to_name", s.alias("score")).distinct()


def identifier_match(spark: SparkSession, d: str) -> DataFrame:
    """Extraction requests with whether their text shares an identifier with the stored Markdown of their document."""
    g = latest(table(spark, d, "ingest_documents").select("document_id", "markdown", "updated_at"), "document_id", "updated_at")
    r = latest(table(spark, d, "extraction_requests").select("request_id", "document_id", "text", "requested_at"), "request_id", "requested_at")
    return r.join(g, "document_id").select("request_id", X.shared_identifier(F.col("text"), F.col("markdown")).alias("shared"))


def seed_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two result lists of each query, one of them without ids for odd ranks, merged."""
    e = vector_topk(spark, d).select("qid", "id", "score")
    other = vector_topk_filtered(spark, d).select("qid", F.when(F.col("rank") % 2 == 0, F.col("id")).alias("id"), F.round(F.col("score") * 1.01, 6).alias("score"))
    return R.merge_seeds(e, other).withColumn("id", F.coalesce("id", F.lit(-1)))


def dedupe_diversify(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a document with equal texts on a page, the best by length kept, cut to twenty."""
    t = _texts(spark, d, "document_id", "page_number", "modality", "chunk_text").select(F.col("document_id").alias("qid"), "id", "document_id", "page_number", "modality", "chunk_text", F.lit("seed").alias("source"), (F.coalesce(F.length("chunk_text"), F.lit(0)) / 1000).alias("score"))
    return R.cut(R.diversify(R.dedupe(t)), 20).select("qid", "id", F.round("score", 6).alias("score"), "rank")


def lexical_rerank(spark: SparkSession, d: str) -> DataFrame:
    """BM25 results of the evaluation items ordered anew by the stand-in reranker."""
    items = table(spark, d, "eval_items").select(F.col("item_id").alias("qid"), "text")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    rows = R.bm25(docs, items, 10).join(docs.withColumnRenamed("text", "chunk_text"), "id").join(items.withColumnRenamed("text", "query_text"), "qid")
    return R.rerank(rows, 5).select("qid", "id", "score", "rerank_score", "rank")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items").select(F.col("item_id").alias("qid"), "text")
    return R.bm25(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), items, 10)


def modality_counts(spark: SparkSession, d: str) -> DataFrame:
    t = _texts(spark, d, "modality")
    return t.agg(*(F.count_if(R.modality_filter(m)).alias(m) for m in ("all", "text", "image")))


def source_filter(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the documents of given sources only, as a semi-join."""
    own = table(spark, d, "ingest_documents").where(F.col("source_name").isin("field-archive", "range-logs"))
    return _texts(spark, d, "document_id", "modality").join(own, "document_id", "left_semi").groupBy("modality").agg(F.count("*").alias("n"))


def chunk_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by id, texts before images, without the text where context isn't wanted."""
    t, i = _texts(spark, d, "document_id", "modality", "chunk_text"), _images(spark, d, "document_id", "modality", "chunk_text")
    both = t.select("id", "document_id", "modality", "chunk_text", F.lit(0).alias("place")).unionByName(i.select("id", "document_id", "modality", "chunk_text", F.lit(1).alias("place")))
    rows = keep_first(both, ["id"], ["place"])
    return rows.select("id", "modality", F.when(F.col("place") == 0, F.coalesce(F.length("chunk_text"), F.lit(0))).otherwise(-1).alias("n_chars"), R.image_url(F.col("modality"), F.col("document_id"), F.col("id")).alias("image_url"))


def chunk_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Structured chunks with the elements they are made of."""
    c = table(spark, d, "structured_chunks").select("chunk_key", "document_id", F.explode("element_uids").alias("element_uid")).distinct()
    e = table(spark, d, "document_elements").select("document_id", "element_uid", "element_type").distinct()
    return c.join(e, ["document_id", "element_uid"]).groupBy("chunk_key").agg(F.count("*").alias("n_elements"), F.count_if(F.col("element_type") == "table").alias("n_tables"))


def agent_context(spark: SparkSession, d: str) -> DataFrame:
    t = _texts(spark, d).where("classification IS NOT NULL")
    rows = R.cut(t.select(F.col("document_id").alias("qid"), "document_id", "id", "modality", "classification", "page_number", "chunk_text", (1 / (1 + F.col("chunk_index"))).alias("score")), 3)
    return R.context_text(rows)


def latest_listing(spark: SparkSession, d: str) -> DataFrame:
    """The ten newest documents of each source and state."""
    g = latest(table(spark, d, "ingest_documents"), "document_id", "updated_at")
    w = Window.partitionBy("source_name", "pipeline_status").orderBy(F.desc("created_at"), "document_id")
    return g.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("source_name", "pipeline_status", "document_id", "rank")


def stated_queries(texts: DataFrame) -> DataFrame:
    """(qid, query_text, vector) of the stated query set."""
    return texts.where(_is_query()).where(F.size("embedding") == DIM).select(F.col("id").alias("qid"), F.col("chunk_text").alias("query_text"), F.col("embedding").alias("vector"))


def with_vectors(queries: DataFrame) -> DataFrame:
    """Queries (qid, query_text[, vector]) with a vector: their own or that of the stand-in model."""
    own = V.hashed_embedding(F.concat(F.lit("query: "), "query_text"), DIM)
    return queries.select("qid", "query_text", (F.coalesce(F.col("vector").cast("array<double>"), own) if "vector" in queries.columns else own).alias("vector"))


def hybrid(spark: SparkSession, d: str, spec: R.QuerySpec, queries: DataFrame | None = None) -> DataFrame:
    """Seeds, structural, cross-modal and ontology expansion, fused, deduplicated, diversified, cut and, if asked, reranked.

    `queries` (qid, query_text[, vector]) is a stated set; without one it is the
    chunks of `_is_query`. Filters apply to seeds and to what they are expanded
    to. An entity is taken to be extracted from the chunks of its page. The basic
    strategy has seeds only and leaves descriptions of images out.
    """
    docs, sources = table(spark, d, "ingest_documents"), spec.filters.get("source_names")
    every = _texts(spark, d)
    q = materialise(stated_queries(every) if queries is None else with_vectors(queries))
    t = R.of_sources(every.where(R.payload_filter(spec.filters)), docs, sources)
    i = R.of_sources(_images(spark, d).where(R.payload_filter({k: v for k, v in spec.filters.items() if k != "classification"})), docs, sources)
    seen = t.where(R.modality_filter(spec.modality))
    if spec.strategy == "basic":
        seen = seen.where(F.coalesce(F.lower(F.trim("modality")) != "image_description", F.lit(True)))
    seeds = materialise(_seeds(q, seen, spec.top_k).select("qid", "id", "score", "document_id"))
    none, no = F.lit(None).cast("string"), F.lit(None).cast("double")
    carry = ["qid", "id", "score", "source", "seed_id", "link_type", "rel_type", "entity_name", "related_name"]
    blank = {c: none.alias(c) for c in ("seed_id", "link_type", "rel_type", "entity_name", "related_name")}
    rows = seeds.select("qid", "id", "score", F.lit("seed").alias("source"), *blank.values())
    if spec.strategy == "hybrid":
        body = t.select("id", F.col("chunk_text").alias("body")).unionByName(i.select("id", F.col("chunk_text").alias("body")))
        asked = q.select("qid", "query_text", F.col("vector").alias("q"))

        def fused(found: DataFrame, semantic, link, crossing, relation, hop) -> DataFrame:  # noqa: ANN001
            """Scores of expanded chunks, with the bonus of an identifier that query and chunk share."""
            full = found.join(body, "id").join(asked, "qid")
            return full.withColumn("score", R.fusion(semantic, link, crossing, relation, hop, X.shared_identifier(F.col("query_text"), F.col("body"))))

        near = seeds.select("document_id").distinct()
        own_t, own_i = t.join(near, "document_id", "left_semi"), i.join(near, "document_id", "left_semi")
        links = materialise(L.all_links(own_t, own_i).join(seeds.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi"))
        doc = L.expand(seeds, links).withColumnRenamed("target_id", "id")
        doc = fused(doc, F.col("score"), F.col("weight"), no, none, F.col("hop")).select("qid", "id", "score", F.lit("doc_structure").alias("source"), "seed_id", "link_type", blank["rel_type"], blank["entity_name"], blank["related_name"])
        lone = seeds.join(links.select(F.col("source_id").alias("id")).distinct(), "id", "left_anti").withColumnRenamed("id", "seed_id")
        first = keep_first(own_i.select("document_id", "id", "chunk_index").withColumn("n", F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index", "id"))).where("n <= 5"), ["document_id", "id"], ["n"])
        crossed = fused(lone.join(first.select("document_id", "id"), "document_id"), F.col("score"), no, F.lit(R.CROSS), none, F.lit(1)).select("qid", "id", "score", F.lit("cross_modal").alias("source"), "seed_id", blank["link_type"], blank["rel_type"], blank["entity_name"], blank["related_name"])
        named = materialise(table(spark, d, "extracted_entities").select("document_id", "name", F.get_json_object("properties", "$.page").cast("int").alias("page_number")).distinct().join(t.select("document_id", "page_number", F.col("id").alias("chunk")), ["document_id", "page_number"]).select("name", "chunk").distinct())
        rel = table(spark, d, "extracted_relationships").select("from_name", "rel_type", "to_name").distinct()
        ways = rel.unionAll(rel.select(F.col("to_name").alias("from_name"), "rel_type", F.col("from_name").alias("to_name"))).distinct()
        path = seeds.withColumnRenamed("id", "seed_id").join(named, F.col("seed_id") == F.col("chunk")).select("qid", "seed_id", F.col("name").alias("from_name")).join(ways, "from_name").join(named.withColumnsRenamed({"name": "to_name", "chunk": "id"}), "to_name").where("id <> seed_id")
        w = Window.partitionBy("qid", "seed_id").orderBy("rel_type", "from_name", "to_name", "id")
        five = path.withColumn("r", F.row_number().over(w)).where("r <= 5").join(t.select("id", "embedding"), "id")
        own = fused(five, F.greatest(F.coalesce(V.cosine(F.col("q"), F.col("embedding")), F.lit(0.0)), F.lit(0.0)), no, no, F.col("rel_type"), F.lit(1))
        rows = rows.unionByName(doc).unionByName(crossed).unionByName(own.select("qid", "id", "score", F.lit("ontology").alias("source"), "seed_id", blank["link_type"], "rel_type", F.col("from_name").alias("entity_name"), F.col("to_name").alias("related_name")))
    shown = t.select("id", "document_id", "page_number", "modality", "classification", "chunk_text").unionByName(i.select("id", "document_id", "page_number", "modality", F.lit(None).cast("string").alias("classification"), "chunk_text"))
    full = R.dedupe(rows.select(*carry)).join(shown, "id")
    out = R.cut(R.diversify(full).where(R.modality_filter(spec.modality)), spec.top_k)
    if spec.rerank:
        out = R.rerank(out.drop("rank").join(q.select("qid", "query_text"), "qid")).drop("query_text")
    if spec.min_confidence is not None:
        out = out.where(F.col("score") >= spec.min_confidence)
    return out.select("qid", "rank", "id", "score", "source", "seed_id", "link_type", "rel_type", "entity_name", "related_name", "document_id", "page_number", "modality", "classification", *(["rerank_score"] if spec.rerank else []), *(["chunk_text"] if spec.include_context else []))


_SHOWN = ("qid", "rank", "id", "score", "source", "seed_id", "link_type", "rel_type")


def hybrid_query(spark: SparkSession, d: str) -> DataFrame:
    out = hybrid(spark, d, R.QuerySpec(include_context=False))
    return out.select(*(F.coalesce(c, F.lit("")).alias(c) if c in _SHOWN[5:] else F.col(c) for c in _SHOWN))


def hybrid_reranked(spark: SparkSession, d: str) -> DataFrame:
    """Twenty results of hybrid retrieval over text chunks, ordered anew by the stand-in reranker."""
    return hybrid(spark, d, R.QuerySpec(top_k=20, modality="text", rerank=True)).select("qid", "rank", "id", "score", "rerank_score")


def basic_search(spark: SparkSession, d: str) -> DataFrame:
    return hybrid(spark, d, R.QuerySpec(strategy="basic", include_context=False)).select("qid", "rank", "id", "score")


def hybrid_context(spark: SparkSession, d: str) -> DataFrame:
    """The results of hybrid retrieval as text for an agent."""
    return R.context_text(hybrid(spark, d, R.QuerySpec(top_k=5)))


QUERIES = {f.__name__: f for f in (vector_topk, vector_topk_filtered, vector_normalize, hashed_embeddings, next_chunk_links, section_links, same_page_links, chunk_links_all, seed_search, link_expansion, cross_modal, fusion_score, identifier_match, seed_merge, dedupe_diversify, lexical_rerank, bm25_topk, modality_counts, source_filter, chunk_lookup, chunk_artifacts, agent_context, latest_listing, hybrid_query, hybrid_reranked, basic_search, hybrid_context)}

_T = "t AS (SELECT * FROM text_chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)"
_I = "i AS (SELECT * FROM image_chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC) = 1)"
_Q = "CAST('0x' || substr({c}, 1, 8) AS BIGINT) % 20 = 0"
_TOP = """SELECT qid, id, round(s, 6) AS score, rank FROM (SELECT q.vec_id AS qid, e.vec_id AS id, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) AS s,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(s, 9) DESC, e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON {on} WHERE q.vec_id % 20 = 0) WHERE rank <= 10{more}"""
_PAIRS = """{name} AS (SELECT id AS a, lead(id) OVER (PARTITION BY {group} ORDER BY page_number ASC NULLS LAST, chunk_index, id) AS b FROM {source} WHERE {some})"""
_WAYS = "SELECT a AS source_id, b AS target_id, '{kind}' AS link_type, {w} AS weight FROM {name} WHERE b IS NOT NULL UNION ALL SELECT b, a, '{kind}', {w} FROM {name} WHERE b IS NOT NULL"
_LINKS = f"{_T}, {_I}, n1 AS (SELECT id AS a, lead(id) OVER (PARTITION BY document_id ORDER BY page_number ASC NULLS LAST, chunk_index, id) AS b FROM t WHERE document_id IS NOT NULL), n2 AS (SELECT id AS a, lead(id) OVER (PARTITION BY document_id, artifact_id ORDER BY page_number ASC NULLS LAST, chunk_index, id) AS b FROM t WHERE document_id IS NOT NULL AND artifact_id IS NOT NULL), n3 AS (SELECT t.id AS a, i.id AS b FROM t JOIN i USING (document_id, page_number)), links AS (SELECT DISTINCT *, 1 AS hop FROM ({_WAYS.format(kind='NEXT_CHUNK', w='0.9::DOUBLE', name='n1')} UNION ALL {_WAYS.format(kind='SAME_ARTIFACT', w='0.82::DOUBLE', name='n2')} UNION ALL {_WAYS.format(kind='SAME_PAGE', w='0.78::DOUBLE', name='n3')}))"
_TERMS = "list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda x: x <> '')"
_BM25 = f"""d AS (SELECT doc_id AS id, {_TERMS.format(c='text')} AS w FROM documents WHERE text IS NOT NULL), tot AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
    q AS (SELECT item_id AS qid, unnest(list_distinct({_TERMS.format(c='text')})) AS term FROM eval_items),
    x AS (SELECT id, len(w) AS len, unnest(w) AS term FROM d), tf AS (SELECT id, len, term, count(*) AS tf FROM x WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    p AS (SELECT id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl)) AS part FROM tf JOIN df USING (term), tot),
    s AS (SELECT qid, id, round(sum(part), 6) AS score FROM p JOIN q USING (term) GROUP BY 1, 2), top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10)"""
_WEIGHT = weight_sql("rel_type")

_SEEDS = _T + """, v AS (SELECT *, embedding::DOUBLE[] AS e FROM t WHERE len(embedding) = 64 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
        sd1 AS (SELECT q.id AS qid, c.id, c.document_id, c.page_number, c.modality, c.chunk_text, list_dot_product(q.e, c.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(c.e, c.e)) AS r FROM v q JOIN v c ON CAST('0x' || substr(q.id, 1, 8) AS BIGINT) % 20 = 0{more}),
        sd2 AS (SELECT *, round(r, 6) AS score, regexp_replace(chunk_text, '^[ \\t\\r\\n\\f]+|[ \\t\\r\\n\\f]+$', '', 'g') AS bare FROM sd1 WHERE r >= 0.25 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(r, 9) DESC, id) <= {n}),
        sd3 AS (SELECT *, coalesce(modality IN ('image', 'graph_node') OR chunk_text IS NULL OR bare = '', true) AS through FROM sd2),
        sd4 AS (SELECT * FROM sd3 QUALIFY through OR row_number() OVER (PARTITION BY through, qid, document_id, page_number, lower(bare) ORDER BY score DESC, id) = 1),
        seeds AS (SELECT qid, id, score, document_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sd4 QUALIFY rank <= {k})"""
_SHARED = " OR ".join("len(list_intersect(regexp_extract_all(q.chunk_text, '" + p.replace("{", "{{").replace("}", "}}") + "'), regexp_extract_all(b.body, '" + p.replace("{", "{{").replace("}", "}}") + "'))) > 0" for p in X.IDENTIFIERS)
_LINKS2 = _LINKS.replace(f"{_T}, {_I}, ", "")
_HYBRID = _SEEDS.replace("{more}", "") + f""", {_I}, {_LINKS2.replace("{", "{{").replace("}", "}}")},
        body AS (SELECT id, chunk_text AS body FROM t UNION ALL SELECT id, chunk_text FROM i),
        dx AS (SELECT qid, s.id AS seed_id, target_id AS id, link_type, weight, score FROM seeds s JOIN links ON source_id = s.id QUALIFY row_number() OVER (PARTITION BY qid, s.id ORDER BY weight DESC, link_type, target_id) <= 5),
        cx AS (SELECT qid, s.id AS seed_id, i.id, score FROM seeds s JOIN (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, id) <= 5) i USING (document_id) WHERE s.id NOT IN (SELECT source_id FROM links)),
        named AS (SELECT DISTINCT name, t.id AS chunk FROM (SELECT DISTINCT document_id, name, CAST(json_extract_string(properties, '$.page') AS INT) AS page_number FROM extracted_entities) JOIN t USING (document_id, page_number)),
        rel AS (SELECT DISTINCT from_name, rel_type, to_name FROM extracted_relationships UNION SELECT DISTINCT to_name, rel_type, from_name FROM extracted_relationships),
        ox AS (SELECT DISTINCT qid, s.id AS seed_id, b.chunk AS id, rel_type, from_name, to_name FROM seeds s JOIN named a ON a.chunk = s.id JOIN rel ON rel.from_name = a.name JOIN named b ON b.name = rel.to_name WHERE b.chunk <> s.id QUALIFY row_number() OVER (PARTITION BY qid, s.id ORDER BY rel_type, from_name, to_name, b.chunk) <= 5),
        ov AS (SELECT ox.*, greatest(coalesce(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) / nullif(sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])), 0), 0), 0) AS sem FROM ox JOIN t q ON q.id = ox.qid JOIN t c ON c.id = ox.id),
        raw AS (SELECT qid, id, 0.65::DOUBLE * score + 0.20::DOUBLE * weight AS s, 'doc_structure' AS source, 1 AS place, seed_id, link_type, NULL AS rel_type, NULL AS f, NULL AS g FROM dx
                UNION ALL SELECT qid, id, 0.65::DOUBLE * score + 0.20::DOUBLE * 0.85::DOUBLE, 'cross_modal', 2, seed_id, NULL, NULL, NULL, NULL FROM cx
                UNION ALL SELECT qid, id, 0.65::DOUBLE * sem + CASE WHEN rel_type IS NULL THEN 0 ELSE 0.15::DOUBLE * ({_WEIGHT})::DOUBLE END, 'ontology', 3, seed_id, NULL, rel_type, from_name, to_name FROM ov),
        fus AS (SELECT raw.* EXCLUDE (s), round(CASE WHEN coalesce({_SHARED}, false) THEN least(s + 0.03::DOUBLE, 1) ELSE s END, 6) AS score FROM raw JOIN body b ON b.id = raw.id JOIN t q ON q.id = raw.qid),
        every AS (SELECT qid, id, score, 'seed' AS source, 0 AS place, NULL AS seed_id, NULL AS link_type, NULL AS rel_type, NULL AS f, NULL AS g FROM seeds UNION ALL SELECT qid, id, score, source, place, seed_id, link_type, rel_type, f, g FROM fus),
        one AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY qid, id ORDER BY score DESC, place, seed_id NULLS FIRST, link_type NULLS FIRST, rel_type NULLS FIRST, f NULLS FIRST, g NULLS FIRST) = 1),
        shown AS (SELECT id, document_id, page_number, modality, chunk_text FROM t UNION ALL SELECT id, document_id, page_number, modality, chunk_text FROM i),
        full_ AS (SELECT one.*, document_id, page_number, regexp_replace(chunk_text, '^[ \\t\\r\\n\\f]+|[ \\t\\r\\n\\f]+$', '', 'g') AS bare, modality, chunk_text FROM one JOIN shown USING (id)),
        thr AS (SELECT *, coalesce(modality IN ('image', 'graph_node') OR chunk_text IS NULL OR bare = '', true) AS through FROM full_),
        best AS (SELECT * FROM thr QUALIFY through OR row_number() OVER (PARTITION BY through, qid, document_id, page_number, lower(bare) ORDER BY score DESC, id) = 1)"""

SQL = {
    "vector_topk": _TOP.format(on="true", more=""),
    "vector_topk_filtered": _TOP.format(on="e.label IN (0, 1, 2)", more=" AND s >= 0.25"),
    "vector_normalize": f"WITH {_T}, n AS (SELECT id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM t WHERE embedding IS NOT NULL) SELECT id, len(v) AS dim, round(CASE WHEN n = 0 THEN 0 ELSE list_dot_product(v, v) / (n * n) END, 6) AS norm2, round(v[1] / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS first FROM n",
    "next_chunk_links": f"WITH {_T}, {_PAIRS.format(name='p', group='document_id', source='t', some='document_id IS NOT NULL')} {_WAYS.format(kind='NEXT_CHUNK', w='0.9::DOUBLE', name='p')}",
    "section_links": f"WITH c AS (SELECT DISTINCT chunk_key AS id, document_id, section_path, page_number, chunk_index FROM structured_chunks), {_PAIRS.format(name='p', group='document_id, section_path', source='c', some='document_id IS NOT NULL AND section_path IS NOT NULL')} {_WAYS.format(kind='SAME_SECTION', w='0.88::DOUBLE', name='p')}",
    "same_page_links": f"WITH {_T}, {_I}, p AS (SELECT t.id AS a, i.id AS b FROM t JOIN i USING (document_id, page_number)) {_WAYS.format(kind='SAME_PAGE', w='0.78::DOUBLE', name='p')}",
    "chunk_links_all": f"WITH {_LINKS} SELECT * FROM links",
    "seed_search": f"""
        WITH {_T}, v AS (SELECT *, embedding::DOUBLE[] AS e FROM t WHERE len(embedding) = 64 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
        s AS (SELECT q.id AS qid, c.id, c.document_id, c.page_number, c.modality, c.chunk_text, list_dot_product(q.e, c.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(c.e, c.e)) AS r FROM v q JOIN v c ON {_Q.format(c='q.id')}),
        f AS (SELECT *, round(r, 6) AS score FROM s WHERE r >= 0.25 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(r, 9) DESC, id) <= 80),
        g AS (SELECT *, regexp_replace(chunk_text, '^[ \\t\\r\\n\\f]+|[ \\t\\r\\n\\f]+$', '', 'g') AS bare FROM f),
        h AS (SELECT * FROM g WHERE coalesce(modality IN ('image', 'graph_node') OR chunk_text IS NULL OR bare = '', true) UNION ALL SELECT * FROM (SELECT * FROM g WHERE NOT coalesce(modality IN ('image', 'graph_node') OR chunk_text IS NULL OR bare = '', true) QUALIFY row_number() OVER (PARTITION BY qid, document_id, page_number, lower(bare) ORDER BY score DESC, id) = 1))
        SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM h QUALIFY rank <= 10""",
    "identifier_match": "WITH g AS (SELECT * FROM ingest_documents QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY updated_at DESC) = 1), r AS (SELECT * FROM extraction_requests QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY requested_at DESC) = 1) SELECT request_id, coalesce(" + " OR ".join(f"len(list_intersect(regexp_extract_all(r.text, '{p}'), regexp_extract_all(g.markdown, '{p}'))) > 0" for p in X.IDENTIFIERS) + ", false) AS shared FROM r JOIN g USING (document_id)",
    "seed_merge": "WITH a AS (" + _TOP.format(on="true", more="") + "), b AS (" + _TOP.format(on="e.label IN (0, 1, 2)", more=" AND s >= 0.25") + "), u AS (SELECT qid, id, score FROM a UNION ALL SELECT qid, CASE WHEN rank % 2 = 0 THEN id END, round(score * 1.01, 6) FROM b) SELECT qid, coalesce(id, -1) AS id, score FROM (SELECT * FROM u QUALIFY id IS NULL OR row_number() OVER (PARTITION BY qid, id ORDER BY score DESC) = 1)",
    "agent_context": f"""
        WITH {_T}, r AS (SELECT document_id AS qid, *, 1 / (1 + chunk_index)::DOUBLE AS score, row_number() OVER (PARTITION BY document_id ORDER BY 1 / (1 + chunk_index)::DOUBLE DESC, id) AS rank FROM t WHERE classification IS NOT NULL QUALIFY rank <= 3)
        SELECT qid, string_agg('### Result ' || rank || ' (score: ' || format('{{:.0f}}', score * 100) || '%, modality: ' || coalesce(modality, 'unknown') || ')' || CASE WHEN classification <> 'UNCLASSIFIED' THEN chr(10) || '**Classification**: ' || classification ELSE '' END
               || CASE WHEN page_number IS NOT NULL THEN chr(10) || '**Page**: ' || page_number ELSE '' END || chr(10) || CASE WHEN chunk_text <> '' THEN chr(10) || chunk_text || chr(10) ELSE '' END, chr(10) ORDER BY rank) AS context, any_value(qid) AS sources FROM r GROUP BY 1""",
    "basic_search": f"""
        WITH {_SEEDS.format(more=" AND coalesce(lower(trim(c.modality)) <> 'image_description', true)", n=80, k=10)} SELECT qid, rank, id, score FROM seeds""",
    "hybrid_query": f"""
        WITH {_HYBRID.format(n=80, k=10)} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank, id, score, source, coalesce(seed_id, '') AS seed_id, coalesce(link_type, '') AS link_type, coalesce(rel_type, '') AS rel_type FROM best QUALIFY rank <= 10""",
    "link_expansion": f"WITH {_LINKS} SELECT source_id AS qid, target_id, link_type, hop, round(0.65 * 0.8 + 0.20 * weight, 6) AS score FROM links WHERE {_Q.format(c='source_id')} AND source_id IN (SELECT id FROM t) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, link_type, target_id) <= 5",
    "cross_modal": f"WITH {_LINKS} SELECT i.id AS qid, t.id AS target_id, round(0.65 * 0.8 + 0.20 * 0.85, 6)::DOUBLE AS score FROM t JOIN i USING (document_id) WHERE {_Q.format(c='i.id')} AND i.id NOT IN (SELECT source_id FROM links) QUALIFY row_number() OVER (PARTITION BY i.id ORDER BY t.chunk_index, t.id) <= 5",
    "fusion_score": f"""
        WITH h AS (SELECT *, CASE WHEN from_type = to_type THEN 0.92::DOUBLE ELSE 1 END AS decay FROM extracted_relationships),
             s AS (SELECT *, 0.65::DOUBLE * coalesce(confidence, 0) + 0.20::DOUBLE * (0.9::DOUBLE * decay) + CASE WHEN rel_type IS NULL THEN 0 ELSE 0.15::DOUBLE * ({_WEIGHT})::DOUBLE * decay END AS s FROM h)
        SELECT DISTINCT document_id, from_name, rel_type, to_name, round(CASE WHEN coalesce(from_name = to_name, false) THEN least(s + 0.03, 1) ELSE s END, 6) AS score FROM s""",
    "dedupe_diversify": f"""
        WITH {_T}, s AS (SELECT document_id AS qid, *, coalesce(length(chunk_text), 0) / 1000::DOUBLE AS score, regexp_replace(chunk_text, '^[ \\t\\r\\n\\f]+|[ \\t\\r\\n\\f]+$', '', 'g') AS bare FROM t),
        x AS (SELECT *, coalesce(modality IN ('image', 'graph_node') OR chunk_text IS NULL OR bare = '', true) AS through FROM s),
        k AS (SELECT *, CASE WHEN through THEN 1 ELSE row_number() OVER (PARTITION BY through, qid, document_id, page_number, lower(bare) ORDER BY score DESC, id) END AS r FROM x)
        SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM k WHERE r = 1 QUALIFY rank <= 20""",
    "lexical_rerank": f"""
        WITH {_BM25}, w AS (SELECT top.*, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS was, list_distinct({_TERMS.format(c='e.text')}) AS qw, list_distinct({_TERMS.format(c='substr(d2.text, 1, 512)')}) AS dw FROM top JOIN eval_items e ON e.item_id = qid JOIN documents d2 ON d2.doc_id = top.id),
        r AS (SELECT *, CASE WHEN was <= 5 THEN round(len(list_intersect(qw, dw)) / greatest(len(qw), 1), 6) END AS rerank_score FROM w)
        SELECT qid, id, score, rerank_score, row_number() OVER (PARTITION BY qid ORDER BY was > 5, rerank_score DESC NULLS LAST, was) AS rank FROM r""",
    "bm25_topk": f"WITH {_BM25} SELECT qid, id, score, rank FROM top",
    "modality_counts": f"WITH {_T} SELECT count(*) AS \"all\", count(*) FILTER (WHERE lower(trim(modality)) IN ('text', 'table')) AS text, count(*) FILTER (WHERE lower(trim(modality)) IN ('image', 'schematic', 'image_description')) AS image FROM t",
    "source_filter": f"WITH {_T} SELECT modality, count(*) AS n FROM t WHERE document_id IN (SELECT document_id FROM ingest_documents WHERE source_name IN ('field-archive', 'range-logs')) GROUP BY 1",
    "chunk_lookup": f"WITH {_T}, {_I} SELECT id, modality, coalesce(length(chunk_text), 0) AS n_chars, CASE WHEN modality IN ('image', 'schematic', 'image_description') THEN '/v1/documents/' || document_id || '/artifacts/' || id || '/image' END AS image_url FROM t UNION ALL SELECT id, modality, -1, CASE WHEN modality IN ('image', 'schematic', 'image_description') THEN '/v1/documents/' || document_id || '/artifacts/' || id || '/image' END FROM i WHERE id NOT IN (SELECT id FROM t)",
    "chunk_artifacts": "WITH c AS (SELECT DISTINCT chunk_key, document_id, unnest(element_uids) AS element_uid FROM structured_chunks), e AS (SELECT DISTINCT document_id, element_uid, element_type FROM document_elements) SELECT chunk_key, count(*) AS n_elements, count(*) FILTER (WHERE element_type = 'table') AS n_tables FROM c JOIN e USING (document_id, element_uid) GROUP BY 1",
    "latest_listing": "WITH g AS (SELECT * FROM ingest_documents QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY updated_at DESC) = 1) SELECT source_name, pipeline_status, document_id, row_number() OVER (PARTITION BY source_name, pipeline_status ORDER BY created_at DESC, document_id) AS rank FROM g QUALIFY rank <= 10",
}
