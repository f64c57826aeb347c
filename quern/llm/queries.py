"""The queries pN_ of the training-data operators and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import encode, language, leaks, lookalike, names, neardup, neighbours, probing, reading, scans, split
from quern.operators.vectors import topk
from quern.tables import latest, materialise, spread, table

#: table, key, text column and the columns by which the latest delivery is known.
ITEMS = (("structured_chunks", "chunk_key", "text", ()), ("ingest_documents", "document_id", "markdown", ("updated_at",)), ("extraction_requests", "request_id", "text", ("requested_at",)))


def _rows(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The columns of a table that an operator reads, over all cores."""
    return spread(table(spark, folder, name).select(*columns))


def _repaired(spark: SparkSession, folder: str) -> DataFrame:
    elements = _rows(spark, folder, "document_elements", "id", "document_id", "element_type", "content_text", "page_number", "confidence", "updated_at")
    reader = scans.learn(elements.select("content_text", F.col("confidence").isNotNull().alias("scanned")))
    scanned = scans.scanned_documents(elements, table(spark, folder, "structured_chunks"), table(spark, folder, "ingest_documents"))
    return scans.repair_elements(elements, scanned, reader)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = _repaired(spark, folder).groupBy("id").agg(F.max(F.struct("at", "kinds")).alias("v"))
    return rows.select("id", F.explode("v.kinds").alias("kind"))


def p1_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Every element with its text: repaired where it is a text of a scanned document, as it was elsewhere."""
    last = latest(table(spark, folder, "document_elements").select("id", "document_id", "content_text", "updated_at"), "id", "updated_at")
    repaired = latest(_repaired(spark, folder).select("id", "at", "repaired"), "id", "at")
    return last.join(repaired, "id", "left").select("id", "document_id", F.when(F.col("at").isNotNull(), F.col("repaired")).otherwise(F.col("content_text")).alias("content_text"))


def _named(spark: SparkSession, folder: str) -> DataFrame:
    relations = table(spark, folder, "extracted_relationships")
    return names.entities(names.spellings([(table(spark, folder, "extracted_entities"), "name", "entity_type"), (relations, "from_name", "from_type"), (relations, "to_name", "to_type")]))


def p2_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Every spelling with the entity it names: kind, name, entity."""
    return _named(spark, folder)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.variant_pairs(materialise(_named(spark, folder)))


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every item of the three tables: table_name, item_key, piece_no, start, end, piece_text."""
    parts = [split.split_items(latest(_rows(spark, folder, t, key, text, *newest), key, *newest), key, text).select(F.lit(t).alias("table_name"), "*") for t, key, text, newest in ITEMS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items that had to be cut: those with more than one piece."""
    parts = [split.item_sizes(_rows(spark, folder, t, key, text, *newest), key, text, *newest).where("n_pieces > 1").select(F.lit(t).alias("table_name"), "item_key") for t, key, text, newest in ITEMS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


#: table, key and text column of the texts to be compared by look.
LOOKS = (("text_chunks", "id", "chunk_text"), ("document_elements", "id", "content_text"))


def _lattice(spark: SparkSession, folder: str) -> lookalike.Lattice:
    texts = [_rows(spark, folder, t, text).withColumnRenamed(text, "text") for t, _, text in LOOKS]
    return lookalike.Lattice(lookalike.bigram_counts(texts[0].unionByName(texts[1]), "text"))


def p4_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent form of every text: table_name, id, canonical."""
    lattice = _lattice(spark, folder)
    parts = [lookalike.canonical_texts(latest(table(spark, folder, t).select(key, text, "updated_at"), key, "updated_at"), text, lattice).select(F.lit(t).alias("table_name"), F.col(key).alias("id"), "canonical") for t, key, text in LOOKS]
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    lattice = _lattice(spark, folder)
    parts = [lookalike.same_look_pairs(_rows(spark, folder, t, key, text, "updated_at"), key, text, lattice, "updated_at").select(F.lit(t).alias("table_name"), "id_a", "id_b") for t, key, text in LOOKS]
    return parts[0].unionByName(parts[1])


def _tagged(spark: SparkSession, folder: str) -> DataFrame:
    chunks = _rows(spark, folder, "text_chunks", "id", "document_id", "chunk_text", "updated_at")
    model = language.train(table(spark, folder, "ingest_documents"), chunks)
    if model is None:
        return spark.createDataFrame([], f"id string, document_id string, segments {language.SEGMENT}")
    return language.tag(chunks, model)


def p5_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every segment of every chunk: id, segment_no, start, end, lang, confidence, words."""
    rows = _tagged(spark, folder).select("id", F.posexplode("segments").alias("segment_no", "s"))
    return rows.select("id", "segment_no", "s.start", "s.end", "s.lang", "s.confidence", "s.words")


def p5_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The language of each document by its chunks: document_id, lang, confidence."""
    return language.document_language(_tagged(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    tagged = materialise(_tagged(spark, folder))
    docs = language.wrong_labels(table(spark, folder, "ingest_documents"), language.document_language(tagged)).select(F.lit("document").alias("scope"), F.col("document_id").alias("item_id"), "lang")
    langs = F.array_distinct(F.transform("segments", lambda s: s["lang"]))
    chunks = tagged.select("id", langs.alias("langs")).where(F.size("langs") > 1).select(F.lit("chunk").alias("scope"), F.col("id").alias("item_id"), F.explode("langs").alias("lang"))
    return docs.unionByName(chunks)


#: table, key and text column of the texts to be grouped by similarity.
SIMILAR = (("text_chunks", "id", "chunk_text"), ("ingest_documents", "document_id", "document_summary"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [neardup.similar_pairs(_rows(spark, folder, t, key, text, "updated_at"), key, text, "updated_at").select(F.lit(t).alias("table_name"), "id_a", "id_b") for t, key, text in SIMILAR]
    return parts[0].unionByName(parts[1])


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each record with its class of equal texts, its group of similar ones and its number of links, by five-word shingles at 0.8."""
    parts = [neardup.similar_groups(_rows(spark, folder, t, key, text, "updated_at"), key, text, "updated_at").select(F.lit(t).alias("table_name"), "*") for t, key, text in SIMILAR]
    return parts[0].unionByName(parts[1])


#: table, key, vector column and the column by which the latest delivery is known.
VECTORS = (("text_chunks", "id", "embedding", "updated_at"), ("image_chunks", "id", "embedding", "created_at"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [neighbours.near_pairs(_rows(spark, folder, t, key, vector, newest), key, vector, newest).select(F.lit(t).alias("table_name"), "id_a", "id_b") for t, key, vector, newest in VECTORS]
    return parts[0].unionByName(parts[1])


def p7_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Of every vector the up to five most similar others at a cosine of 0.9 or more: table_name, id, neighbour, cosine, rank."""
    parts = [neighbours.nearest(_rows(spark, folder, t, key, vector, newest), key, vector, newest, least_cosine=0.9).select(F.lit(t).alias("table_name"), "*") for t, key, vector, newest in VECTORS]
    return parts[0].unionByName(parts[1])


def _asked(column: str = "id") -> Column:
    """The stated query set: ids whose first eight digits make a number divisible by 20."""
    return F.conv(F.substring(column, 1, 8), 16, 10).cast("bigint") % 20 == 0


def p7_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar others, near or far, of the stated query set among all vectors, by multi-probe hashing."""
    parts = [probing.search(_rows(spark, folder, t, key, vector, newest), key, vector, _asked(), newest).select(F.lit(t).alias("table_name"), "qid", "id", F.round("cosine", 6).alias("cosine"), "rank") for t, key, vector, newest in VECTORS]
    return parts[0].unionByName(parts[1])


def p7_search(spark: SparkSession, folder: str) -> DataFrame:
    """As p7_nearest, but exact: the queries are compared with all vectors, in blocks. What the recall of p7_nearest is measured against."""
    parts = []
    for t, key, vector, newest in VECTORS:
        rows = latest(table(spark, folder, t).select(key, vector, newest), key, newest).select(F.col(key).alias("id"), F.col(vector).alias("vector"))
        asked = rows.where(_asked() & (F.size("vector") > 0)).withColumnRenamed("id", "qid")
        found = topk(asked, rows, neighbours.K + 1).where("id <> qid")
        w = Window.partitionBy("qid").orderBy("rank")
        parts.append(found.select(F.lit(t).alias("table_name"), "qid", "id", F.round("score", 6).alias("cosine"), F.row_number().over(w).alias("rank")).where(F.col("rank") <= neighbours.K))
    return parts[0].unionByName(parts[1])


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode_corpus(_rows(spark, folder, "documents", "doc_id", "text"))


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a window of 13 words of an item within two word edits, with the longest common run and the least edits."""
    return leaks.find_leaks(_rows(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Of the leaks those with at least 13 consecutive words of the item."""
    return p9_leaks(spark, folder).where(F.col("run_words") >= leaks.RUN).select("doc_id", "item_id")


def _grader(spark: SparkSession, folder: str, docs: DataFrame) -> reading.Model | None:
    """A model from the graded texts and the words of all English documents."""
    return reading.train(docs.where("lang = 'en'").select("doc_id", "text"), table(spark, folder, "reading_labels"))


def p10_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Level and confidence of every document with a word in it."""
    docs = _rows(spark, folder, "documents", "doc_id", "text", "lang")
    model = _grader(spark, folder, docs)
    return reading.levels(docs, model) if model else spark.createDataFrame([], "doc_id bigint, level int, confidence double")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """The level of each English document of at least 40 words."""
    docs = spread(table(spark, folder, "documents").where("lang = 'en'").select("doc_id", "text", "lang"))
    model = _grader(spark, folder, docs)
    return reading.grade(docs, model).select("doc_id", "level") if model else spark.createDataFrame([], "doc_id bigint, level int")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_repaired, p2_entities, p2_found, p3_pieces, p3_found, p4_canonical, p4_found, p5_segments, p5_documents, p5_found, p6_found, p6_groups, p7_found, p7_neighbours, p7_nearest, p7_search, p8_ids, p9_found, p9_leaks, p10_levels, p10_found)}

SQL: dict[str, str] = {
    "p3_found": " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS table_name, {key} AS item_key FROM {t} WHERE length({text}) > 3000" for t, key, text, _ in ITEMS),
    "p6_found": " UNION ALL ".join(rf"""SELECT '{t}' AS table_name, id_a, id_b FROM (
        WITH l AS (SELECT {key} AS id, arg_max({text}, updated_at) AS body FROM {t} WHERE {text} IS NOT NULL GROUP BY 1),
             w AS (SELECT id, regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+') AS w FROM l),
             r AS (SELECT id, w, unnest(range(1, len(w) - 1)) AS k FROM w WHERE len(w) >= 12),
             s AS (SELECT DISTINCT id, hash(w[k:k + 2]) AS g FROM r),
             n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
             c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
        SELECT id_a, id_b FROM c JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE c * 1.0 / (x.n + y.n - c) >= 0.5)""" for t, key, text in SIMILAR),
    "p6_groups": "WITH RECURSIVE " + ", ".join(rf"""
        l{i} AS (SELECT {key} AS id, arg_max({text}, updated_at) AS body FROM {t} WHERE {text} IS NOT NULL GROUP BY 1),
        w{i} AS (SELECT id, regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+') AS w FROM l{i}),
        r{i} AS (SELECT id, w, unnest(range(1, len(w) - 3)) AS k FROM w{i} WHERE len(w) >= 5),
        s{i} AS (SELECT DISTINCT id, hash(w[k:k + 4]) AS g FROM r{i}),
        d{i} AS (SELECT id, count(*) AS n, hash(list(g ORDER BY g)) AS digest FROM s{i} GROUP BY 1),
        e{i} AS (SELECT digest, min(id) AS class_id, min(n) AS n FROM d{i} GROUP BY 1),
        m{i} AS (SELECT class_id, n, g FROM e{i} JOIN s{i} ON s{i}.id = class_id),
        c{i} AS (SELECT a.class_id AS x, b.class_id AS y, count(*) * 1.0 / (any_value(a.n) + any_value(b.n) - count(*)) AS s FROM m{i} a JOIN m{i} b ON a.g = b.g AND a.class_id <> b.class_id GROUP BY 1, 2 HAVING s >= 0.8),
        k{i}(x, y) AS (SELECT class_id, class_id FROM e{i} UNION SELECT k{i}.x, c{i}.y FROM k{i} JOIN c{i} ON k{i}.y = c{i}.x),
        f{i} AS (SELECT x AS class_id, min(y) AS group_id FROM k{i} GROUP BY 1),
        z{i} AS (SELECT '{t}' AS table_name, d{i}.id, class_id, group_id, (SELECT count(*) FROM c{i} WHERE x = class_id) AS n_links FROM d{i} JOIN e{i} USING (digest) JOIN f{i} USING (class_id))""" for i, (t, key, text) in enumerate(SIMILAR)) + " SELECT * FROM z0 UNION ALL SELECT * FROM z1",
    "p7_found": " UNION ALL ".join(f"""SELECT '{t}' AS table_name, id_a, id_b FROM (
        WITH l AS (SELECT {key} AS id, arg_max({vector}, {newest})::DOUBLE[] AS v FROM {t} GROUP BY 1),
             u AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM l WHERE v IS NOT NULL AND list_dot_product(v, v) > 0),
             c AS (SELECT a.id AS x, b.id AS y, list_dot_product(a.v, b.v) / (a.n * b.n) AS c FROM u a JOIN u b ON a.id <> b.id),
             t AS (SELECT x, y, c, row_number() OVER (PARTITION BY x ORDER BY c DESC, y) AS r FROM c WHERE c >= 0.9)
        SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM t WHERE r <= 5)""" for t, key, vector, newest in VECTORS),
    "p7_search": " UNION ALL ".join(f"""SELECT '{t}' AS table_name, * FROM (
        WITH l AS (SELECT {key} AS id, {vector}::DOUBLE[] AS v FROM {t} WHERE {vector} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {newest} DESC) = 1),
             u AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM l WHERE list_dot_product(v, v) > 0)
        SELECT a.id AS qid, b.id AS id, round(list_dot_product(a.v, b.v) / (a.n * b.n), 6) AS cosine, row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.v, b.v) / (a.n * b.n), 9) DESC, b.id) AS rank
        FROM u a JOIN u b ON a.id <> b.id WHERE CAST('0x' || substr(a.id, 1, 8) AS BIGINT) % 20 = 0 QUALIFY rank <= 5)""" for t, key, vector, newest in VECTORS),
    "p9_found": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
             i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
             dr AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13),
             ir AS (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i WHERE len(w) >= 13),
             dw AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 12], ' ') AS g FROM dr),
             iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 12], ' ') AS g FROM ir)
        SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)""",
}
