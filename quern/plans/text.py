"""Queries over texts, keys, cleaning and chunking, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import keys as K
from quern.functions import text as X
from quern.operators import chunking, cleaning
from quern.sources import ontology
from quern.tables import latest, materialise, table

MODEL = "hashed-64"
LOW = "abcdefghijklmnopqrstuvwxyz"
_DASH = X.DASHES + X.SPACES
_PLAIN = "-" * len(X.DASHES) + " " * len(X.SPACES)


def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.normalise(F.col("text")).alias("text"))


def text_nfc(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_elements").select("id", X.nfc(F.col("content_text")).alias("text")).distinct()


def sanitize_table(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.sanitise(table(spark, d, "image_chunks").select("id", "document_id", "chunk_text", "modality")).distinct()


def line_cleanup(spark: SparkSession, d: str) -> DataFrame:
    docs = cleaning.keep_first(table(spark, d, "ingest_documents").select("document_id", "markdown", "updated_at"), ["document_id"], [F.desc("updated_at")])
    return cleaning.line_cleanup(docs, "document_id", "markdown")


def element_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Elements without exact repeats of type, page, section, text and place in a document."""
    e = table(spark, d, "document_elements")
    keys = ["document_id", "element_type", "page_number", "section_path", "content_text", *(F.col(f"bounding_box.{c}") for c in ("x0", "y0", "x1", "y1"))]
    return cleaning.keep_first(e, keys, ["element_order", "id"]).select("id", "document_id", "element_order")


def chunk_text_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The first chunk of each text of a document."""
    return cleaning.keep_first(table(spark, d, "text_chunks").where("chunk_text IS NOT NULL"), ["document_id", "chunk_text"], ["chunk_index", "id"]).select("id", "document_id", "chunk_index")


def file_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The oldest of the files with one hash in a source, unless it failed and another may replace it."""
    g = table(spark, d, "ingest_documents").select("document_id", "source_name", "file_hash", "pipeline_status", "created_at").distinct()
    return cleaning.keep_first(g, ["source_name", "file_hash"], [F.col("pipeline_status").isin("FAILED", "ERROR").cast("int"), "created_at", "document_id"]).select("document_id", "source_name", "file_hash")


def file_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each file as it comes in: taken, taken in place of those before, which all failed, or rejected."""
    g = table(spark, d, "ingest_documents").groupBy("document_id", "source_name", "file_hash").agg(F.max_by("pipeline_status", F.struct("updated_at", "pipeline_status")).alias("s"), F.min("created_at").alias("created_at"))
    before = Window.partitionBy("source_name", "file_hash").orderBy("created_at", "document_id").rowsBetween(Window.unboundedPreceding, -1)
    held = F.count(F.when(F.coalesce(~F.col("s").isin("FAILED", "ERROR"), F.lit(True)), 1)).over(before)
    return g.select("document_id", F.when(held > 0, "reject").when(F.count("*").over(before) > 0, "replace").otherwise("accept").alias("decision"))


def element_keys(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "document_elements").select("id", "document_id", "page_number", "element_order", "element_type", "content_text").distinct()
    uid = K.element_uid(F.col("page_number"), F.col("element_order"), F.col("element_type"), F.col("content_text"))
    return e.withColumn("uid", uid).select("id", "uid", K.artifact_id(F.col("document_id"), F.col("uid")).alias("artifact_id"), K.element_hash(F.col("document_id"), F.col("uid"), F.col("content_text")).alias("element_hash"))


def chunk_keys(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "structured_chunks").select("chunk_key", "document_id", "chunk_index", "element_uids").distinct()
    return c.select("chunk_key", K.chunk_id(F.col("document_id"), F.col("element_uids"), F.col("chunk_index"), F.lit(MODEL)).alias("chunk_id"), K.trusted_point_id(F.col("chunk_key")).alias("point_id"))


def label_sanitize(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "extracted_entities")
    return e.select("name", X.label(F.col("name")).alias("label")).distinct()


def script_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_elements").groupBy("document_id").agg(F.count_if(X.is_foreign_script(F.col("content_text"))).alias("n_foreign"), F.count("*").alias("n_elements"))


def document_language(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent language among a document's elements in other scripts, `en` without any."""
    t = table(spark, d, "document_elements").select("document_id", F.coalesce(X.script_language(F.col("content_text")), F.lit("")).alias("l"))
    return cleaning.dominant_language(t, "document_id", "l", F.col("l") != "")


def element_languages(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "document_elements").select("id", X.script_language(F.col("content_text")).alias("lang")).where("lang IS NOT NULL")
    return e.distinct()


def _foreign(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "document_elements").where(X.is_foreign_script(F.col("content_text")))
    e = e.groupBy("document_id", F.concat_ws("/", F.lpad(F.col("element_order").cast("string"), 8, "0"), "id").alias("place")).agg(F.max_by("content_text", F.struct("updated_at", "content_text")).alias("content_text"))
    return e


def translation_batches(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.pack(_foreign(spark, d), "document_id", "place", F.length("content_text"), 2000)


def translated(spark: SparkSession, d: str) -> DataFrame:
    """Elements in other scripts after a stand-in translation, ASCII letters in capitals, in batches; a batch with a 7 loses its marks and goes one by one."""
    high = lambda c: F.translate(c, LOW, LOW.upper())
    model = lambda c: F.when(c.contains("7"), F.replace(high(c), F.lit(cleaning.BOUNDARY.strip()), F.lit(" "))).otherwise(high(c))
    return cleaning.translate(_foreign(spark, d), "document_id", "place", "content_text", model)


def reassemble_markdown(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "document_elements").where("content_text <> ''").select("document_id", "element_order", "id", "element_type", "content_text").distinct()
    line = F.when(F.col("element_type") == "heading", F.concat(F.lit("## "), "content_text")).otherwise(F.col("content_text"))
    parts = F.array_sort(F.collect_list(F.struct("element_order", "id", line.alias("line"))))
    return e.groupBy("document_id").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n\n").alias("markdown"))


def classification_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ingest_documents").select(X.classification(F.col("classification")).alias("classification"), F.left("document_summary", F.lit(120)).alias("summary")).groupBy("classification").agg(F.count("*").alias("n"), F.count("summary").alias("n_summaries"))


def metadata_merge(spark: SparkSession, d: str) -> DataFrame:
    """The properties of an entity's mentions merged over its first ones."""
    e = table(spark, d, "extracted_entities").where("properties IS NOT NULL").withColumn("m", F.from_json("properties", "map<string,string>"))
    w = e.groupBy("name", "entity_type").agg(F.min_by("m", F.struct("extracted_at", "document_id", "properties")).alias("first"), F.max_by("m", F.struct("extracted_at", "document_id", "properties")).alias("last"))
    merged = cleaning.metadata_merge(F.col("first"), F.col("last"))
    return w.select("name", "entity_type", F.array_join(F.array_sort(F.transform(F.map_entries(merged), lambda x: F.concat(x["key"], F.lit("="), F.coalesce(x["value"], F.lit("null"))))), ";").alias("properties"))


def image_placeholders(spark: SparkSession, d: str) -> DataFrame:
    req = table(spark, d, "extraction_requests").where("text IS NOT NULL").select("request_id", "document_id", "text").distinct()
    img = table(spark, d, "document_elements").where("element_type = 'image'").select("document_id", "element_uid").distinct().groupBy("document_id").agg(F.array_sort(F.collect_list("element_uid")).alias("images"))
    out = cleaning.fill_placeholders(F.col("text"), F.transform(F.coalesce("images", F.array().cast("array<string>")), lambda u: F.concat(F.lit("![image]("), u, F.lit(")"))))
    return req.join(img, "document_id", "left").select("request_id", out.alias("text"))


def review_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Recognised texts by confidence: taken, read again by a second engine, or left to a person."""
    e = table(spark, d, "document_elements").where("confidence IS NOT NULL")
    step = F.when(F.col("confidence") >= 0.75, "accept").when(F.col("confidence") >= 0.60, "second_engine").otherwise("human_review")
    return e.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def triple_validation(spark: SparkSession, d: str) -> DataFrame:
    """Extracted relationships with whether the ontology allows their triple."""
    r = table(spark, d, "extracted_relationships").groupBy("from_type", "rel_type", "to_type").agg(F.count("*").alias("n"))
    allowed = F.broadcast(ontology.triples(spark)).withColumn("valid", F.lit(True))  # the ontology's 128 triples
    return r.join(allowed, (F.col("from_type") == F.col("source")) & (F.col("rel_type") == F.col("relationship")) & (F.col("to_type") == F.col("target")), "left").select("from_type", "rel_type", "to_type", "n", F.coalesce("valid", F.lit(False)).alias("valid"))


def json_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Properties wrapped as models answer, and what is read from them."""
    e = table(spark, d, "extracted_entities").where("properties IS NOT NULL").select("properties").distinct()
    kinds = [F.col("properties"), F.concat(F.lit("<think>{maybe}</think>"), "properties"), F.concat(F.lit("Final Answer: "), "properties"), F.concat(F.lit("Here:\n```json\n"), "properties", F.lit("\n```")), F.concat(F.lit("{x} so "), "properties", F.lit(" ok")), F.lit("nothing here")]
    rows = e.select("properties", F.posexplode(F.array(*kinds)).alias("kind", "answer"))
    return rows.select("properties", "kind", X.json_text(F.col("answer")).alias("found"))


def query_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_entities").select("name", X.query_terms(F.col("name")).alias("query")).distinct()


def token_stats(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return t.groupBy("lang", "source").agg(F.count("*").alias("docs"), F.sum(F.size(X.tokens(F.col("text")))).alias("words"), F.sum(X.approx_tokens(F.col("text"))).alias("tokens"))


def chunk_words(spark: SparkSession, d: str) -> DataFrame:
    return chunking.word_windows(table(spark, d, "documents"), "doc_id", "text", 128, 16)


def chunk_chars(spark: SparkSession, d: str) -> DataFrame:
    return chunking.char_windows(table(spark, d, "documents"), "doc_id", "text", 1000, 200)


def chunk_structured(spark: SparkSession, d: str) -> DataFrame:
    e = cleaning.keep_first(table(spark, d, "document_elements"), ["id"], [F.desc("updated_at")])
    return chunking.structured(e).withColumns({"element_uids": F.array_join("element_uids", "|"), "page_number": F.coalesce("page_number", F.lit(-1))})


def description_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of every element's text, with the places they take among the chunks of its document."""
    e = table(spark, d, "document_elements").select("id", "element_order", "content_text").distinct()
    return chunking.element_sections(e, "id", "element_order", "content_text")


def element_text_packs(spark: SparkSession, d: str) -> DataFrame:
    """Plain texts cut at blank lines and packed to 2,000 characters: the packed texts in order."""
    t = latest(table(spark, d, "ingest_documents").select("document_id", "markdown", "updated_at"), "document_id", "updated_at").where("markdown IS NOT NULL")
    p = materialise(t.select("document_id", F.posexplode(F.split("markdown", "\n\n")).alias("place", "paragraph")).where(X.strip(F.col("paragraph")) != ""))
    b = cleaning.pack(p, "document_id", "place", F.length("paragraph"), 2000)
    parts = F.array_sort(F.collect_list(F.struct("place", "paragraph")))
    return p.join(b, ["document_id", "place"]).groupBy("document_id", "batch").agg(F.array_join(F.transform(parts, lambda x: x["paragraph"]), "\n\n").alias("text"))


def derived_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of images' chunks, of the first section of their descriptions and of elements from plain extractors."""
    e = table(spark, d, "document_elements").where("element_type = 'image'").select("document_id", "element_uid", "element_order", "element_type", "content_text").distinct()
    doc, uid = F.col("document_id"), F.col("element_uid")
    return e.select("document_id", "element_uid", K.image_chunk_id(doc, uid, F.lit(MODEL)).alias("image_id"), K.section_chunk_id(doc, uid, F.lit(0), F.lit(MODEL)).alias("section_id"), K.legacy_uid(F.col("element_order"), F.col("element_type"), F.col("content_text")).alias("legacy"))


def section_artifact_links(spark: SparkSession, d: str) -> DataFrame:
    """Links between consecutive sections of each element's text."""
    return chunking.section_links(description_sections(spark, d), "id")


def upsert_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 128 chunks of a document and their sizes."""
    c = table(spark, d, "structured_chunks").groupBy("document_id", "chunk_key").agg(F.min("chunk_index").alias("chunk_index"))
    return chunking.numbered(c, "document_id", "chunk_index", ["chunk_key"]).groupBy("document_id", "batch").agg(F.count("*").alias("n"))


def document_metadata(spark: SparkSession, d: str) -> DataFrame:
    """What is shown of a document: its classification by metadata, else unclassified, its language and the start of its summary or text."""
    g = latest(table(spark, d, "ingest_documents").select("document_id", "classification", "detected_language", "document_summary", "markdown", "updated_at"), "document_id", "updated_at")
    return g.select("document_id", X.classification(F.col("classification")).alias("classification"), F.coalesce(F.nullif(F.trim("detected_language"), F.lit("")), F.lit("unknown")).alias("language"), F.left(F.coalesce(F.nullif(X.strip(F.col("document_summary")), F.lit("")), F.col("markdown"), F.lit("")), F.lit(300)).alias("shown"))


def image_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """The described images of documents, as a viewer lists them."""
    e = latest(table(spark, d, "document_elements").where("element_type = 'image'").select("id", "document_id", "page_number", "content_text", "updated_at"), "id", "updated_at")
    return e.where(X.strip(F.col("content_text")) != "").select("document_id", "id", F.coalesce("page_number", F.lit(0)).alias("page"), "content_text")


def table_text(spark: SparkSession, d: str) -> DataFrame:
    """Tables of elements as rows of cells again in text form."""
    e = table(spark, d, "document_elements").where("element_type = 'table' AND content_text IS NOT NULL").select("id", "content_text").distinct()
    rows = F.transform(F.split("content_text", "\n"), lambda r: F.split(r, "\\|"))
    return e.select("id", X.table_text(rows).alias("text"))


QUERIES = {f.__name__: f for f in (text_normalize, text_nfc, sanitize_table, line_cleanup, element_dedupe, chunk_text_dedupe, file_dedupe, element_keys, chunk_keys, label_sanitize, script_flags, document_language, translation_batches, reassemble_markdown, classification_normalize, metadata_merge, image_placeholders, review_ladder, triple_validation, json_ladder, query_terms, token_stats, chunk_words, chunk_chars, chunk_structured, description_sections, element_text_packs, table_text, element_languages, translated, file_decisions, derived_keys, section_artifact_links, upsert_batches, document_metadata, image_descriptions)}

_UUID5 = "substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr({h}, 17, 1)) AS INTEGER) % 4 + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"
_FOREIGN = r"coalesce(length({c}) >= 5 AND regexp_matches({c}, '[\x{{0400}}-\x{{04FF}}\x{{4E00}}-\x{{9FFF}}\x{{3040}}-\x{{30FF}}\x{{0600}}-\x{{06FF}}\x{{0900}}-\x{{097F}}\x{{0E00}}-\x{{0E7F}}\x{{0590}}-\x{{05FF}}\x{{AC00}}-\x{{D7AF}}]'), false)"
_WORDS = r"list_filter(regexp_split_to_array({c}, '[ \t\r\n\f]+'), lambda x: x <> '')"
_LONG = r"list_filter(list_transform({c}, lambda x: regexp_replace(x, '^[ \t\r\n\f]+|[ \t\r\n\f]+$', '', 'g')), lambda x: length(x) >= 10)"

_LANG = "CASE WHEN " + _FOREIGN.format(c="content_text") + " THEN CASE " + " ".join(f"WHEN regexp_matches(content_text, '{p}') THEN '{lang}'" for lang, p in X.SCRIPT_LANGUAGES) + " END END"
_DASHED = "substr({c}, 1, 8) || '-' || substr({c}, 9, 4) || '-' || substr({c}, 13, 4) || '-' || substr({c}, 17, 4) || '-' || substr({c}, 21, 12)"
_FOREIGN_ROWS = f"items AS (SELECT *, length(content_text) AS n, row_number() OVER (PARTITION BY document_id ORDER BY place) AS rn FROM (SELECT document_id, lpad(CAST(element_order AS VARCHAR), 8, '0') || '/' || id AS place, last(content_text ORDER BY updated_at, content_text) AS content_text FROM document_elements WHERE {_FOREIGN.format(c='content_text')} GROUP BY 1, 2))"
_PACKED = f"""{_FOREIGN_ROWS}, pack AS (SELECT document_id, rn, place, n, n AS used, 0 AS batch FROM items WHERE rn = 1
    UNION ALL SELECT i.document_id, i.rn, i.place, i.n, CASE WHEN used + i.n > 2000 THEN i.n ELSE used + i.n END, CASE WHEN used + i.n > 2000 THEN batch + 1 ELSE batch END FROM pack JOIN items i ON i.document_id = pack.document_id AND i.rn = pack.rn + 1)"""

SQL = {
    "text_normalize": f"SELECT doc_id, translate(text, '{_DASH}', '{_PLAIN}') AS text FROM documents",
    "text_nfc": f"SELECT DISTINCT id, translate(nfc_normalize(content_text), '{_DASH}', '{_PLAIN}') AS text FROM document_elements",
    "sanitize_table": "SELECT DISTINCT " + ", ".join(f"translate({c}, '{_DASH}', '{_PLAIN}') AS {c}" for c in ("id", "document_id", "chunk_text", "modality")) + " FROM image_chunks",
    "line_cleanup": r"""
        WITH doc AS (SELECT document_id, arg_max(markdown, updated_at) AS markdown FROM ingest_documents WHERE markdown IS NOT NULL GROUP BY 1),
             l AS (SELECT document_id, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS pos FROM doc),
             s AS (SELECT *, regexp_replace(line, '^[ \t\r\n\f]+|[ \t\r\n\f]+$', '', 'g') AS bare FROM l),
             a AS (SELECT *, coalesce(lag(bare, 1) OVER w = bare AND lag(bare, 2) OVER w = bare, false) AS same FROM s WINDOW w AS (PARTITION BY document_id ORDER BY pos)),
             b AS (SELECT *, count(*) OVER (PARTITION BY document_id, bare) AS n, row_number() OVER (PARTITION BY document_id, bare ORDER BY pos) AS r FROM a WHERE NOT same),
             c AS (SELECT document_id, string_agg(line, chr(10) ORDER BY pos) AS body FROM b WHERE n < 5 OR r = 1 OR bare IN ('', '---', '***', '___', '|', '<!-- image -->') GROUP BY 1)
        SELECT document_id, regexp_replace(regexp_replace(regexp_replace(body, '(?m)^[ \t\r\n\f]*<!-- image -->[ \t\r\n\f]*$', '', 'g'), '\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '(?m)[ \t\r\f]+$', '', 'g') AS cleaned FROM c""",
    "element_dedupe": "SELECT id, document_id, element_order FROM (SELECT *, row_number() OVER (PARTITION BY document_id, element_type, page_number, section_path, content_text, bounding_box.x0, bounding_box.y0, bounding_box.x1, bounding_box.y1 ORDER BY element_order, id) AS r FROM document_elements) WHERE r = 1",
    "chunk_text_dedupe": "SELECT id, document_id, chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY document_id, chunk_text ORDER BY chunk_index, id) AS r FROM text_chunks WHERE chunk_text IS NOT NULL) WHERE r = 1",
    "file_dedupe": "SELECT document_id, source_name, file_hash FROM (SELECT *, row_number() OVER (PARTITION BY source_name, file_hash ORDER BY CASE WHEN pipeline_status IN ('FAILED', 'ERROR') THEN 1 ELSE 0 END, created_at, document_id) AS r FROM ingest_documents) WHERE r = 1",
    "element_keys": f"""
        WITH e AS (SELECT DISTINCT id, document_id, content_text, coalesce(page_number, 0) || '-' || element_order || '-' || element_type || '-' || substr(sha256(coalesce(content_text, '')), 1, 8) AS uid FROM document_elements),
             h AS (SELECT *, sha1(unhex('{K.URL}') || encode(document_id || ':' || uid)) AS h FROM e)
        SELECT id, uid, {_UUID5.format(h='h')} AS artifact_id, sha256(document_id || ':' || uid || ':' || coalesce(content_text, '')) AS element_hash FROM h""",
    "chunk_keys": f"""
        WITH c AS (SELECT DISTINCT chunk_key, md5(sha256(document_id || ':' || array_to_string(element_uids, '|') || ':' || chunk_index || ':{MODEL}')) AS m, sha1(unhex('{K.DNS}') || encode('trusted:' || chunk_key)) AS h FROM structured_chunks)
        SELECT chunk_key, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) AS chunk_id, {_UUID5.format(h='h')} AS point_id FROM c""",
    "label_sanitize": "SELECT DISTINCT name, CASE WHEN s IS NULL OR s = '' THEN 'UNKNOWN' WHEN regexp_matches(s, '^[0-9]') THEN '_' || s ELSE s END AS label FROM (SELECT name, regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g') AS s FROM extracted_entities)",
    "script_flags": f"SELECT document_id, count(*) FILTER (WHERE {_FOREIGN.format(c='content_text')}) AS n_foreign, count(*) AS n_elements FROM document_elements GROUP BY 1",
    "document_language": f"""
        WITH e AS (SELECT document_id, {_LANG} AS l FROM document_elements), c AS (SELECT document_id, l, count(*) AS n FROM e WHERE l IS NOT NULL GROUP BY 1, 2),
             r AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY n DESC, l) = 1)
        SELECT document_id, coalesce(l, 'en') AS lang FROM (SELECT DISTINCT document_id FROM document_elements) LEFT JOIN r USING (document_id)""",
    "element_languages": f"SELECT DISTINCT id, {_LANG} AS lang FROM document_elements WHERE {_LANG} IS NOT NULL",
    "file_decisions": """
        WITH g AS (SELECT document_id, source_name, file_hash, last(pipeline_status ORDER BY updated_at, pipeline_status) AS s, min(created_at) AS created_at FROM ingest_documents GROUP BY 1, 2, 3),
             w AS (SELECT *, count(*) FILTER (WHERE coalesce(s NOT IN ('FAILED', 'ERROR'), true)) OVER b AS held, count(*) OVER b AS n FROM g WINDOW b AS (PARTITION BY source_name, file_hash ORDER BY created_at, document_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT document_id, CASE WHEN held > 0 THEN 'reject' WHEN n > 0 THEN 'replace' ELSE 'accept' END AS decision FROM w""",
    "derived_keys": f"""
        WITH e AS (SELECT DISTINCT document_id, element_uid, element_order, element_type, content_text FROM document_elements WHERE element_type = 'image'),
             k AS (SELECT *, md5(sha256(document_id || ':' || element_uid || ':{MODEL}')) AS a, md5(sha256(document_id || ':' || element_uid || ':0:{MODEL}')) AS b FROM e)
        SELECT document_id, element_uid, {_DASHED.format(c='a')} AS image_id, {_DASHED.format(c='b')} AS section_id, 'legacy-' || element_order || '-' || element_type || '-' || substr(sha256(coalesce(content_text, '')), 1, 8) AS legacy FROM k""",
    "translation_batches": f"WITH RECURSIVE {_PACKED} SELECT document_id, place, n AS size, batch FROM pack",
    "translated": f"WITH {_FOREIGN_ROWS} SELECT document_id, place, translate(regexp_replace(content_text, '^[ \\t\\r\\n\\f]+|[ \\t\\r\\n\\f]+$', '', 'g'), '{LOW}', '{LOW.upper()}') AS translated FROM items",
    "element_text_packs": r"""
        WITH RECURSIVE g AS (SELECT * FROM ingest_documents QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY updated_at DESC) = 1),
             q AS (SELECT document_id, unnest(string_split(markdown, chr(10) || chr(10))) AS paragraph, generate_subscripts(string_split(markdown, chr(10) || chr(10)), 1) AS place FROM g WHERE markdown IS NOT NULL),
             items AS (SELECT *, length(paragraph) AS n, row_number() OVER (PARTITION BY document_id ORDER BY place) AS rn FROM q WHERE regexp_replace(paragraph, '^[ \t\r\n\f]+|[ \t\r\n\f]+$', '', 'g') <> ''),
             f AS (SELECT document_id, rn, paragraph, n AS used, 0 AS batch FROM items WHERE rn = 1
                   UNION ALL SELECT i.document_id, i.rn, i.paragraph, CASE WHEN used + n > 2000 THEN n ELSE used + n END, CASE WHEN used + n > 2000 THEN batch + 1 ELSE batch END FROM f JOIN items i ON i.document_id = f.document_id AND i.rn = f.rn + 1)
        SELECT document_id, batch, string_agg(paragraph, chr(10) || chr(10) ORDER BY rn) AS text FROM f GROUP BY 1, 2""",
    "upsert_batches": "WITH k AS (SELECT document_id, chunk_key, min(chunk_index) AS i FROM structured_chunks GROUP BY 1, 2), n AS (SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY coalesce(i, 0), chunk_key) - 1) // 128 AS batch FROM k) SELECT document_id, CAST(batch AS INT) AS batch, count(*) AS n FROM n GROUP BY 1, 2",
    "document_metadata": r"""
        WITH g AS (SELECT *, regexp_replace(document_summary, '^[ \t\r\n\f]+|[ \t\r\n\f]+$', '', 'g') AS s FROM ingest_documents QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY updated_at DESC) = 1)
        SELECT document_id, CASE WHEN upper(trim(classification)) IN ('UNCLASSIFIED', 'CUI', 'CONFIDENTIAL', 'SECRET', 'TOP SECRET') THEN upper(trim(classification)) ELSE 'UNCLASSIFIED' END AS classification, coalesce(nullif(trim(detected_language), ''), 'unknown') AS language, left(coalesce(nullif(s, ''), markdown, ''), 300) AS shown FROM g""",
    "image_descriptions": r"SELECT document_id, id, coalesce(page_number, 0) AS page, content_text FROM (SELECT * FROM document_elements WHERE element_type = 'image' QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1) WHERE regexp_replace(content_text, '^[ \t\r\n\f]+|[ \t\r\n\f]+$', '', 'g') <> ''",
    "reassemble_markdown": "SELECT document_id, string_agg(CASE WHEN element_type = 'heading' THEN '## ' || content_text ELSE content_text END, chr(10) || chr(10) ORDER BY element_order, id) AS markdown FROM (SELECT DISTINCT document_id, element_order, id, element_type, content_text FROM document_elements WHERE content_text <> '') GROUP BY 1",
    "classification_normalize": "SELECT CASE WHEN upper(trim(classification)) IN ('UNCLASSIFIED', 'CUI', 'CONFIDENTIAL', 'SECRET', 'TOP SECRET') THEN upper(trim(classification)) ELSE 'UNCLASSIFIED' END AS classification, count(*) AS n, count(document_summary) AS n_summaries FROM ingest_documents GROUP BY 1",
    "review_ladder": "SELECT CASE WHEN confidence >= 0.75 THEN 'accept' WHEN confidence >= 0.60 THEN 'second_engine' ELSE 'human_review' END AS step, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM document_elements WHERE confidence IS NOT NULL GROUP BY 1",
    "triple_validation": "WITH t(s, r, o) AS (VALUES " + ", ".join(f"('{s}', '{r}', '{o}')" for s, r, o in ontology.default().triples) + ") SELECT from_type, rel_type, to_type, count(*) AS n, (from_type, rel_type, to_type) IN (SELECT (s, r, o) FROM t) AS valid FROM extracted_relationships GROUP BY 1, 2, 3",
    "query_terms": rf"SELECT DISTINCT name, array_to_string(list_transform({_WORDS.format(c='name')}, lambda w: regexp_replace(w, '([+\-&|!(){{}}\[\]^\"~*?:\\/])', '\\\1', 'g') || '~'), ' AND ') AS query FROM extracted_entities",
    "token_stats": f"SELECT lang, source, count(*) AS docs, sum(len({_WORDS.format(c='text')})) AS words, sum(CAST(floor(len({_WORDS.format(c='text')}) * 1.3::DOUBLE) AS INTEGER)) AS tokens FROM documents WHERE text IS NOT NULL GROUP BY 1, 2",
    "chunk_words": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format(c='text')} AS w FROM documents WHERE text IS NOT NULL),
             n AS (SELECT *, CASE WHEN len(w) <= 98 THEN 1 ELSE CAST(ceil((len(w) - 98) / 86.0) AS INTEGER) + 1 END AS c FROM d),
             k AS (SELECT doc_id, w, unnest(range(0, c)) AS k FROM n)
        SELECT doc_id, k AS chunk_no, len(w[k * 86 + 1:k * 86 + 98]) AS n_words, array_to_string(w[k * 86 + 1:k * 86 + 98], ' ') AS chunk_text FROM k""",
    "chunk_chars": "WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), 800)) AS start FROM documents WHERE length(text) > 0) SELECT doc_id, start // 800 AS window_no, start, substr(text, start + 1, 1000) AS window_text FROM s",
    "chunk_structured": f"""
        WITH RECURSIVE e AS (SELECT * FROM document_elements WHERE document_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1),
             t AS (SELECT document_id, coalesce(element_order, 0) AS o, element_uid AS uid, element_type AS kind, page_number AS page, section_path AS section, regexp_replace(content_text, '^[ \\t\\r\\n\\f]+|[ \\t\\r\\n\\f]+$', '', 'g') AS t FROM e),
             r AS (SELECT *, len({_WORDS.format(c='t')}) AS n, kind IN ('table', 'equation', 'image') AS alone, sum(CASE WHEN kind IN ('heading', 'table', 'equation', 'image') THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY o, uid) AS c FROM t WHERE t <> ''),
             p AS (SELECT *, row_number() OVER (PARTITION BY document_id, c ORDER BY o, uid) AS rn FROM r WHERE NOT alone),
             f AS (SELECT document_id, c, rn, 0 AS part, n AS held FROM p WHERE rn = 1
                   UNION ALL SELECT p.document_id, p.c, p.rn, CASE WHEN over THEN part + 1 ELSE part END, CASE WHEN over THEN n ELSE held + n END
                   FROM (SELECT f.*, CAST(floor(f.held * 1.3::DOUBLE) AS INT) + CAST(floor(p.n * 1.3::DOUBLE) AS INT) > 512 AS over FROM f JOIN p ON p.document_id = f.document_id AND p.c = f.c AND p.rn = f.rn + 1) g JOIN p ON p.document_id = g.document_id AND p.c = g.c AND p.rn = g.rn + 1),
             h AS (SELECT document_id, c, t AS heading FROM r WHERE kind = 'heading'),
             k AS (SELECT document_id, c, part, first(page ORDER BY o, uid) FILTER (WHERE page IS NOT NULL) AS page, first(section ORDER BY o, uid) FILTER (WHERE section IS NOT NULL) AS section, string_agg(uid, '|' ORDER BY o, uid) AS uids, string_agg(t, chr(10) || chr(10) ORDER BY o, uid) AS body, max(part) OVER (PARTITION BY document_id, c) AS last FROM p JOIN f USING (document_id, c, rn) GROUP BY 1, 2, 3),
             b AS (SELECT k.document_id, k.c, 1 AS after, part, 'text' AS modality, page, section, uids, CASE WHEN part = 0 THEN heading END AS heading, body, {_WORDS.format(c='body')} AS w FROM k LEFT JOIN h USING (document_id, c)),
             z AS (SELECT *, string_split(body, chr(10) || chr(10)) AS ps FROM b WHERE floor(len(w) * 1.3::DOUBLE) > 512),
             u AS (SELECT document_id, c, part, ps, i, CAST(floor(len({_WORDS.format(c='ps[i]')}) * 1.3::DOUBLE) AS INT) AS n, CASE WHEN i = 1 THEN 0 ELSE CAST(floor(len({_WORDS.format(c='ps[i - 1]')}) * 1.3::DOUBLE) AS INT) END AS m FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM z WHERE len(ps) > 1)),
             g AS (SELECT document_id, c, part, i, n AS used, 0 AS piece, false AS carry FROM u WHERE i = 1
                   UNION ALL SELECT u.document_id, u.c, u.part, u.i, CASE WHEN used + n > 512 THEN n + CASE WHEN m <= 64 THEN m ELSE 0 END ELSE used + n END, CASE WHEN used + n > 512 THEN piece + 1 ELSE piece END, used + n > 512 AND m <= 64
                   FROM g JOIN u ON u.document_id = g.document_id AND u.c = g.c AND u.part = g.part AND u.i = g.i + 1),
             v AS (SELECT document_id, c, part, piece, min(CASE WHEN carry THEN i - 1 ELSE i END) AS lo, max(i) AS hi FROM g GROUP BY 1, 2, 3, 4),
             s AS (SELECT b.*, 0 AS piece, body AS text FROM b WHERE floor(len(w) * 1.3::DOUBLE) <= 512
                   UNION ALL SELECT z.* EXCLUDE (ps), piece, array_to_string(ps[lo:hi], chr(10) || chr(10)) FROM z JOIN v USING (document_id, c, part)
                   UNION ALL SELECT * EXCLUDE (ps), array_to_string(w[piece * 344 + 1:piece * 344 + 393], ' ') FROM (SELECT *, unnest(range(0, CAST(ceil((len(w) - 393) / 344.0) AS INT) + 1)) AS piece FROM z WHERE len(ps) = 1)),
             x AS (SELECT document_id, c, after, part, piece, modality, page, section, uids, heading, text FROM s
                   UNION ALL SELECT r.document_id, r.c, 0, 0, 0, kind, page, section, uid, h.heading, t FROM r LEFT JOIN (SELECT h.* FROM h JOIN k USING (document_id, c) WHERE k.part = 0 AND k.last = 0) h ON h.document_id = r.document_id AND h.c + 1 = r.c WHERE alone)
        SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY c, after, part, piece) - 1 AS INT) AS chunk_index, modality, coalesce(CAST(page AS INT), -1) AS page_number, section AS section_path, uids AS element_uids, heading AS heading_text, text FROM x""",
    "description_sections": f"""
        WITH e AS (SELECT DISTINCT id, element_order, content_text AS t FROM document_elements WHERE content_text IS NOT NULL),
             k AS (SELECT *, CASE {" ".join(f"WHEN len(regexp_extract_all(t, '(?m){p}')) >= 2 THEN string_split(regexp_replace(t, '(?m)({p})', chr(1) || '\\1', 'g'), chr(1))" for p in X.SECTION_HEADERS)} ELSE string_split(t, chr(10) || chr(10)) END AS parts FROM e),
             s AS (SELECT id, element_order, {_LONG.format(c='parts')} AS parts, {_LONG.format(c='[t]')} AS whole FROM k),
             n AS (SELECT id, element_order, CASE WHEN len(parts) > 0 THEN parts ELSE whole END AS parts FROM s)
        SELECT id, element_order, i - 1 AS section_no, 100000 + element_order * 100 + i - 1 AS chunk_index, parts[i] AS section_text FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM n)""",
    "metadata_merge": """
        WITH m AS (SELECT name, entity_type, first(properties ORDER BY extracted_at, document_id, properties) AS a, last(properties ORDER BY extracted_at, document_id, properties) AS b FROM extracted_entities WHERE properties IS NOT NULL GROUP BY 1, 2),
             k AS (SELECT name, entity_type, list_distinct(list_concat(json_keys(a), json_keys(b))) AS ks, json_keys(b) AS kb, a, b FROM m)
        SELECT name, entity_type, array_to_string(list_sort(list_transform(ks, lambda x: x || '=' || coalesce(CASE WHEN list_contains(kb, x) THEN json_extract_string(b, '$."' || x || '"') ELSE json_extract_string(a, '$."' || x || '"') END, 'null'))), ';') AS properties FROM k""",
    "image_placeholders": """
        WITH r AS (SELECT DISTINCT request_id, document_id, text FROM extraction_requests WHERE text IS NOT NULL), i AS (SELECT document_id, list(u ORDER BY u) AS us FROM (SELECT DISTINCT document_id, element_uid AS u FROM document_elements WHERE element_type = 'image') GROUP BY 1),
             p AS (SELECT request_id, string_split(text, '<!-- image -->') AS ps, us FROM r LEFT JOIN i USING (document_id))
        SELECT request_id, array_to_string(list_transform(range(1, len(ps) + 1), lambda k: CASE WHEN k = 1 THEN ps[1] ELSE coalesce('![image](' || us[k - 1] || ')', '<!-- image -->') || ps[k] END), '') AS text FROM p""",
    "json_ladder": "SELECT properties, kind, CASE WHEN kind < 5 THEN properties END AS found FROM (SELECT DISTINCT properties FROM extracted_entities WHERE properties IS NOT NULL), (SELECT unnest(range(0, 6)) AS kind)",
    "section_artifact_links": "",
    "table_text": r"SELECT DISTINCT id, array_to_string(list_transform(string_split(content_text, chr(10)), lambda r: array_to_string(list_transform(string_split(r, '|'), lambda x: trim(x)), ' | ')), chr(10)) AS text FROM document_elements WHERE element_type = 'table' AND content_text IS NOT NULL",
}

SQL["section_artifact_links"] = f"WITH d AS ({SQL['description_sections']}), n AS (SELECT id, chunk_index AS source, lead(chunk_index) OVER (PARTITION BY id ORDER BY section_no, chunk_index) AS target FROM d) SELECT * FROM n WHERE target IS NOT NULL UNION ALL SELECT id, target, source FROM n WHERE target IS NOT NULL"
