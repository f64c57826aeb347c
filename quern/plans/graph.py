"""Queries of the graph, of table maintenance, sources and streams, and their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import graph as G
from quern.operators import tables as U
from quern.operators.components import components
from quern.operators.ordered import last_seen
from quern.sources import documents as S
from quern.sources import ontology
from quern.streaming import watch
from quern.tables import checkpoint_folder, latest, materialise, table

#: Tables that hold what was derived from a document.
CASCADE = ("document_elements", "structured_chunks", "text_chunks", "image_chunks", "extraction_requests", "extracted_entities", "extracted_relationships")
STAGES = ("click", "view", "purchase", "signup", "error")


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_entities")


def _relations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_relationships")


def _plain_edges(spark: SparkSession, d: str) -> DataFrame:
    """(edge_id, a, b, type): the distinct named relations, by a hash of their parts."""
    e = _relations(spark, d).select(F.col("from_name").alias("a"), F.col("rel_type").alias("type"), F.col("to_name").alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    return e.withColumn("edge_id", F.md5(F.concat_ws("|", "a", "type", "b")))


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.merge_nodes(_entities(spark, d))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.merge_edges(_relations(spark, d))


def confidence_gate(spark: SparkSession, d: str) -> DataFrame:
    return G.confident_edges(_relations(spark, d), _entities(spark, d)).select("document_id", "from_name", "rel_type", "to_name", "confidence").distinct()


def resolved_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.resolved_edges(G.merge_edges(_relations(spark, d)), _entities(spark, d))


def pipeline_metrics(spark: SparkSession, d: str) -> DataFrame:
    """How many nodes of each type and how many relations pass their gates."""
    ok = F.coalesce("confidence", F.lit(G.NO_CONFIDENCE))
    gate = lambda df, kind, least: df.groupBy(kind.alias("kind")).agg(F.count_if(ok >= least).alias("accepted"), F.count_if(ok < least).alias("rejected"))
    return gate(_entities(spark, d), F.concat(F.lit("node "), F.coalesce("entity_type", F.lit(""))), G.NODE_GATE).unionByName(gate(_relations(spark, d), F.lit("edge"), G.EDGE_GATE))


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    n = _entities(spark, d).select("name", "entity_type").distinct().agg(F.count("*").alias("nodes"))
    return n.crossJoin(_plain_edges(spark, d).agg(F.count("*").alias("edges")))  # one row each


def graph_degree(spark: SparkSession, d: str) -> DataFrame:
    return G.degree(_plain_edges(spark, d).select(F.col("a").alias("from_name"), F.col("b").alias("to_name")))


def entity_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Every entity with the number of relations it stands in, at either end, those without kept."""
    e = _plain_edges(spark, d)
    ways = e.select(F.col("a").alias("name"), F.col("b").alias("other")).unionAll(e.where("a <> b").select("b", "a"))
    out = ways.groupBy("name").agg(F.count("*").alias("n"), F.min("other").alias("first_neighbour"))
    return _entities(spark, d).select("name").distinct().join(out, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("first_neighbour", F.lit("")).alias("first_neighbour"))


def entity_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each entity's documents as text units: their number and a digest of the list."""
    e = _entities(spark, d).select("name", "document_id").distinct()
    return e.groupBy("name").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("document_id")), ",")).alias("digest"))


def document_units(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "structured_chunks").select("document_id", "chunk_key").distinct()
    units = c.groupBy("document_id").agg(F.count("*").alias("n_units"), F.min("chunk_key").alias("first_unit"))
    return table(spark, d, "ingest_documents").select("document_id").distinct().join(units, "document_id", "left").select("document_id", F.coalesce("n_units", F.lit(0)).alias("n_units"), F.coalesce("first_unit", F.lit("")).alias("first_unit"))


def cooccurrence_edges(spark: SparkSession, d: str) -> DataFrame:
    m = _entities(spark, d).select("document_id", "name", F.get_json_object("properties", "$.page").alias("page"))
    return G.cooccurrences(m, ["document_id", "page"], _relations(spark, d))


def khop_neighborhood(spark: SparkSession, d: str) -> DataFrame:
    """Trails of up to two relations from every failure mode."""
    starts = _entities(spark, d).where("entity_type = 'FAILURE_MODE'").select(F.col("name").alias("start"))
    return G.khop(starts, _plain_edges(spark, d), 2).select("start", "node", "hops", "first_type", F.array_join("path", ",").alias("path"))


def neighborhood_graph(spark: SparkSession, d: str) -> DataFrame:
    starts = _entities(spark, d).where("entity_type = 'STANDARD'").select(F.col("name").alias("start"))
    return G.neighbourhood(starts, _plain_edges(spark, d), 2)


def mentions(spark: SparkSession, d: str) -> DataFrame:
    return G.mentions(table(spark, d, "document_elements"), _entities(spark, d).select("name"))


def mention_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that a name is mentioned in, through any of their elements; documents without a mention link their entities to the first chunk."""
    c = table(spark, d, "structured_chunks").select("document_id", "chunk_key", "chunk_index", "element_uids").distinct()
    found = G.mentions(table(spark, d, "document_elements"), _entities(spark, d).select("name")).join(c.select("document_id", "chunk_key", F.explode("element_uids").alias("element_uid")), ["document_id", "element_uid"]).select("document_id", "name", "chunk_key").distinct()
    found = materialise(found)
    first = c.groupBy("document_id").agg(F.min(F.struct("chunk_index", "chunk_key")).alias("f")).select("document_id", F.col("f.chunk_key").alias("chunk_key"))
    rest = _entities(spark, d).select("document_id", "name").distinct().join(found.select("document_id").distinct(), "document_id", "left_anti").join(first, "document_id")
    return found.unionByName(rest.select("document_id", "name", "chunk_key"))


def canonicalize(spark: SparkSession, d: str) -> DataFrame:
    """Names against aliases without titles and with their nearest more frequent spelling."""
    n = _entities(spark, d).groupBy("name", "entity_type").agg(F.count("*").alias("mentions"))
    bare = F.regexp_replace("name", r"^(Dr|Prof|Maj|Capt|LTC|Sgt)\.? +", "")
    aliases = n.where(bare != F.col("name")).select(F.col("name").alias("alias"), bare.alias("canonical")).distinct()
    return G.canonicalise(n, aliases)


def entity_descriptions(spark: SparkSession, d: str) -> DataFrame:
    e = _entities(spark, d).groupBy("name", "entity_type").agg(F.max("properties").alias("p"))
    return e.select("name", "entity_type", G.describe(F.col("name"), F.col("entity_type"), F.from_json("p", "map<string,string>")).alias("description"))


def relationship_export(spark: SparkSession, d: str) -> DataFrame:
    return G.export_relationships(_relations(spark, d))


def connected_components(spark: SparkSession, d: str) -> DataFrame:
    e = _plain_edges(spark, d)
    return components(e.select(F.col("a").alias("node")).unionAll(e.select("b")), e)


def _communities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = _plain_edges(spark, d).select("a", "b", F.lit(1.0).alias("weight"))
    return G.communities(e.select(F.col("a").alias("node")).unionAll(e.select("b")), e), e


def _components(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(members, edges) of the topmost level of communities."""
    e = materialise(_plain_edges(spark, d).select("a", "b", F.lit(1.0).alias("weight")))
    own = components(e.select(F.col("a").alias("node")).unionAll(e.select("b")), e).withColumnRenamed("component", "community")
    return materialise(own.join(own.groupBy("community").agg(F.count("*").alias("size")), "community").select("node", "community", "size")), e


def communities(spark: SparkSession, d: str) -> DataFrame:
    return _communities(spark, d)[0]


def community_reports(spark: SparkSession, d: str) -> DataFrame:
    return G.reports(*_components(spark, d))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: relations in words, of those whose edge_id, its first eight digits read as a number, is divisible by 20."""
    e = _plain_edges(spark, d).where(F.conv(F.substring("edge_id", 1, 8), 16, 10).cast("bigint") % 20 == 0)
    return e.select(F.col("edge_id").alias("qid"), F.concat_ws(" ", "a", "type", "b").alias("text"))


def local_search(spark: SparkSession, d: str) -> DataFrame:
    return G.local_search(_asked(spark, d), *_components(spark, d))


def global_search(spark: SparkSession, d: str) -> DataFrame:
    return G.global_search(_asked(spark, d), *_components(spark, d))


def drift_search(spark: SparkSession, d: str) -> DataFrame:
    return G.drift_search(_asked(spark, d), *_components(spark, d))


def structural_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _structure(spark, d)[0]


def structural_edges(spark: SparkSession, d: str) -> DataFrame:
    return _structure(spark, d)[1]


def _structure(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return G.structure(table(spark, d, "ingest_documents"), table(spark, d, "structured_chunks"), table(spark, d, "document_elements"))


def relation_units(spark: SparkSession, d: str) -> DataFrame:
    """Each relation with the number of text units of its ends and the first of them."""
    return G.relation_units(_plain_edges(spark, d), _entities(spark, d)).groupBy("edge_id").agg(F.count("*").alias("n_units"), F.min("unit").alias("first_unit"))


def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """Orders up to the middle of 1995 merged with those from its beginning on, whose price and priority changed."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", F.col("o_orderdate").cast("date").alias("day"))
    old, new = o.where("day < DATE '1995-07-01' OR day IS NULL").drop("day"), o.where("day >= DATE '1995-01-01'").drop("day").withColumns({"o_orderstatus": F.lit("N"), "o_totalprice": F.round(F.col("o_totalprice") + 1, 2)})
    return U.upsert(old, new, ["o_orderkey"], ["o_totalprice", "o_orderpriority"])


def purge_document(spark: SparkSession, d: str) -> DataFrame:
    """Elements left when the failed documents are purged."""
    gone = table(spark, d, "ingest_documents").where("pipeline_status = 'FAILED'")
    return U.purge(table(spark, d, "document_elements").select("document_id", "id").distinct(), gone, "document_id").groupBy("document_id").agg(F.count("*").alias("n"))


def purge_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Rows left in every table when the failed documents are purged from all."""
    gone = table(spark, d, "ingest_documents").where("pipeline_status = 'FAILED'")
    left = U.purge_all({t: table(spark, d, t) for t in CASCADE}, gone)
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t, df in left.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def chunk_patch(spark: SparkSession, d: str) -> DataFrame:
    """Chunks after patches: unclassified ones get a class, those of odd places lose theirs."""
    c = latest(table(spark, d, "text_chunks").select("id", "chunk_index", "chunk_text", "classification", "updated_at"), "id", "updated_at")
    odd = (F.col("chunk_index") % 2 == 1) & F.col("classification").isNotNull()
    patches = c.select("id", F.lit("classification").alias("path"), F.when(F.col("classification").isNull(), "add").when(odd, "remove").alias("op"), F.lit("CUI").alias("value"), F.lit(1).alias("at")).where("op IS NOT NULL")
    return U.patch_rows(c, patches, "id", ("chunk_text", "classification")).select("id", F.coalesce("classification", F.lit("")).alias("classification"), F.coalesce(F.length("chunk_text"), F.lit(0)).alias("n_chars"))


def missing_stages(spark: SparkSession, d: str) -> DataFrame:
    """Of a set of event types those that a user has none of."""
    e = table(spark, d, "events").where("user_id IS NOT NULL").select("user_id", "event_type").distinct()
    kinds = F.array(*(F.lit(x) for x in STAGES))
    seen = e.where(F.col("event_type").isin(*STAGES)).groupBy("user_id").agg(F.collect_set("event_type").alias("s"))  # at most STAGES
    return e.select("user_id").distinct().join(seen, "user_id", "left").select("user_id", F.array_join(F.array_except(kinds, F.coalesce("s", F.array().cast("array<string>"))), ",").alias("missing"))


def stale_elements(spark: SparkSession, d: str) -> DataFrame:
    """Elements that no structured chunk of their document holds."""
    held = table(spark, d, "structured_chunks").select("document_id", F.explode("element_uids").alias("element_uid"))
    return U.stale(table(spark, d, "document_elements").select("document_id", "element_uid").distinct(), held, ["document_id", "element_uid"])


def json_patch(spark: SparkSession, d: str) -> DataFrame:
    """Event properties after a patch that the event's type stands for."""
    e = table(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"), F.when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "click", "replace").otherwise("keep").alias("op"))
    out = U.patch_map(F.col("m"), F.col("op"), F.lit("k"), F.lit("0"))
    return e.select("event_id", F.coalesce(F.try_element_at(out, F.lit("k")), F.lit("")).alias("k"))


def latest_event(spark: SparkSession, d: str) -> DataFrame:
    """The newest event of each user."""
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.count("*").alias("n"))


def heading_carry(spark: SparkSession, d: str) -> DataFrame:
    """Every element with the heading above it."""
    e = latest(table(spark, d, "document_elements").select("id", "document_id", "element_order", "element_type", "content_text", "updated_at"), "id", "updated_at")
    seen = last_seen(e, ["document_id"], "element_order", ["id"], {"heading": F.when(F.col("element_type") == "heading", F.col("content_text"))})
    return seen.select("id", F.coalesce("heading", F.lit("")).alias("heading"))


def section_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every element with the path of the headings above it, by their levels."""
    e = latest(table(spark, d, "document_elements").select("id", "document_id", "element_order", "element_type", "heading_level", "content_text", "updated_at"), "id", "updated_at")
    return S.section_paths(e).select("id", F.coalesce("path", F.lit("")).alias("path"))


def ontology_layers(spark: SparkSession, d: str) -> DataFrame:
    """Entities by the layer of the ontology that their type belongs to."""
    layers = F.broadcast(ontology.entity_types(spark))  # the ontology's 46 types
    return _entities(spark, d).join(layers, "entity_type", "left").groupBy(F.coalesce("layer", F.lit("unknown")).alias("layer")).agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


def file_routes(spark: SparkSession, d: str) -> DataFrame:
    """Files by type and parser."""
    f = table(spark, d, "ingest_documents").select("document_id", "filename").distinct()
    mime = S.mime_type(F.col("filename"))
    return f.groupBy(mime.alias("mime_type"), S.route(mime).alias("parser")).agg(F.count("*").alias("n"))


def name_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten first names with a wanted substring, whatever the case."""
    return _entities(spark, d).select("name", "entity_type").distinct().where(F.lower("name").contains("cor")).orderBy("name", "entity_type").limit(10)


def parse_documents(spark: SparkSession, d: str) -> DataFrame:
    """The stored Markdown read as files and parsed into elements again."""
    g = latest(table(spark, d, "ingest_documents"), "document_id", "updated_at")
    return S.parse(g.select(F.concat("document_id", F.lit(".md")).alias("path"), F.encode("markdown", "utf-8").alias("content")))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    out = watch.windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def stream_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """event_windows as a stream over the files of the table, run until all that is there is done; each batch's state of the windows is written to the checkpoint folder."""
    schema = table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = f"{checkpoint_folder(spark)}/event-windows-{uuid.uuid4().hex}"
    query = watch.windowed_counts(raw).writeStream.outputMode("complete").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(out)).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("window_start timestamp, event_type string, n bigint, total double").parquet(out).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


QUERIES = {f.__name__: f for f in (graph_nodes, graph_edges, confidence_gate, resolved_edges, pipeline_metrics, graph_stats, graph_degree, entity_neighbours, entity_documents, document_units, cooccurrence_edges, khop_neighborhood, neighborhood_graph, mentions, mention_chunks, canonicalize, entity_descriptions, relationship_export, connected_components, communities, community_reports, local_search, global_search, drift_search, structural_nodes, structural_edges, relation_units, upsert_merge, purge_document, purge_cascade, chunk_patch, missing_stages, stale_elements, json_patch, latest_event, heading_carry, section_paths, ontology_layers, file_routes, name_search, parse_documents, event_windows, stream_event_windows)}

_EDGES = "e AS (SELECT DISTINCT from_name AS a, rel_type AS type, to_name AS b, md5(from_name || '|' || rel_type || '|' || to_name) AS edge_id FROM extracted_relationships WHERE from_name IS NOT NULL AND to_name IS NOT NULL)"
_WAYS = f"{_EDGES}, ways AS (SELECT edge_id, a AS x, b AS y, type FROM e UNION ALL SELECT edge_id, b, a, type FROM e WHERE a <> b)"
_TRAILS = """{ways}, l1 AS (SELECT s.start, y AS node, 1 AS hops, type AS first_type, [edge_id] AS path FROM (SELECT DISTINCT name AS start FROM extracted_entities WHERE entity_type = '{kind}') s JOIN ways ON s.start = x),
    l2 AS (SELECT start, y AS node, 2 AS hops, first_type, list_append(path, edge_id) AS path FROM l1 JOIN ways ON node = x WHERE NOT list_contains(path, edge_id)), trails AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2)"""
_MENTIONS = r"""n AS (SELECT DISTINCT name FROM extracted_entities WHERE trim(name) <> ''), el AS (SELECT DISTINCT document_id, element_uid, content_text FROM document_elements WHERE content_text IS NOT NULL),
    m AS (SELECT DISTINCT document_id, element_uid, name, CASE WHEN length(name) <= 4 THEN 'word_boundary' ELSE 'substring' END AS match_type FROM el JOIN n ON CASE WHEN length(name) > 4 THEN contains(lower(content_text), lower(name)) ELSE regexp_matches(lower(content_text), '(^|[^\pL\pN_])' || regexp_escape(lower(name)) || '($|[^\pL\pN_])') END)"""
_WEIGHT = ontology.weight_sql("rel_type")
_DAYS = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"

_PARTS = f"""{_EDGES}, ww AS (SELECT a, b FROM e UNION SELECT b, a FROM e), rr AS (SELECT a AS node, a AS c FROM ww UNION SELECT ww.b, rr.c FROM rr JOIN ww ON rr.node = ww.a),
        cc AS (SELECT node, min(c) AS community FROM rr GROUP BY 1), mm AS (SELECT *, count(*) OVER (PARTITION BY community) AS size FROM cc), dg AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY 1),
        hd AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY degree DESC, node) AS r FROM mm JOIN dg USING (node)),
        rp AS (SELECT community, any_value(size) AS size, string_agg(node, ', ' ORDER BY r) AS names FROM hd WHERE r <= 3 GROUP BY 1),
        reports AS (SELECT community, size, 'Community of ' || size || ' around ' || names || ' with ' || (SELECT count(*) FROM e JOIN cc x ON x.node = e.a WHERE x.community = rp.community) || ' relations.' AS report FROM rp),
        nb AS (SELECT node, string_agg(other, ', ' ORDER BY other) AS neighbours FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY other) AS r FROM (SELECT DISTINCT a AS node, b AS other FROM ww WHERE a <> b)) WHERE r <= 5 GROUP BY 1),
        ask AS (SELECT edge_id AS qid, concat_ws(' ', a, type, b) AS text FROM e WHERE CAST('0x' || substr(edge_id, 1, 8) AS BIGINT) % 20 = 0)"""
_TERMS = "list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda x: x <> '')"
_GLOBAL = f"""{_PARTS}, gd AS (SELECT community AS id, {_TERMS.format(c='report')} AS w FROM reports), gt AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM gd), gq AS (SELECT qid, unnest(list_distinct({_TERMS.format(c='text')})) AS term FROM ask),
        gx AS (SELECT id, len(w) AS len, unnest(w) AS term FROM gd), gf AS (SELECT id, len, term, count(*) AS tf FROM gx WHERE term IN (SELECT term FROM gq) GROUP BY ALL), gn AS (SELECT term, count(*) AS df FROM gf GROUP BY 1),
        gp AS (SELECT id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl)) AS part FROM gf JOIN gn USING (term), gt),
        gs AS (SELECT qid, id AS community, round(sum(part), 6) AS score FROM gp JOIN gq USING (term) GROUP BY 1, 2),
        gr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, community) AS rank FROM gs)"""

SQL = {
    "graph_nodes": "SELECT name, entity_type, max(confidence) AS confidence, first(properties ORDER BY extracted_at, document_id, properties) AS properties, first(document_id ORDER BY extracted_at, document_id, properties) AS first_document, last(document_id ORDER BY extracted_at, document_id, properties) AS last_document, count(*) AS mentions FROM extracted_entities WHERE name IS NOT NULL GROUP BY 1, 2",
    "graph_edges": "SELECT from_name, from_type, coalesce(rel_type, 'RELATED_TO') AS rel_type, to_name, to_type, document_id, max(confidence) AS confidence FROM extracted_relationships GROUP BY ALL",
    "confidence_gate": "WITH n AS (SELECT DISTINCT name FROM extracted_entities WHERE coalesce(confidence, 0.8) >= 0.60) SELECT DISTINCT document_id, from_name, rel_type, to_name, confidence FROM extracted_relationships WHERE coalesce(confidence, 0.8) >= 0.55 AND from_name IN (SELECT name FROM n) AND to_name IN (SELECT name FROM n)",
    "resolved_edges": "WITH n AS (SELECT DISTINCT name, entity_type FROM extracted_entities), g AS (SELECT from_name, from_type, coalesce(rel_type, 'RELATED_TO') AS rel_type, to_name, to_type, document_id, max(confidence) AS confidence FROM extracted_relationships GROUP BY ALL) SELECT g.* FROM g JOIN n x ON x.name = from_name AND x.entity_type = from_type JOIN n y ON y.name = to_name AND y.entity_type = to_type",
    "pipeline_metrics": "SELECT 'node ' || coalesce(entity_type, '') AS kind, count(*) FILTER (WHERE coalesce(confidence, 0.8) >= 0.60) AS accepted, count(*) FILTER (WHERE coalesce(confidence, 0.8) < 0.60) AS rejected FROM extracted_entities GROUP BY 1 UNION ALL SELECT 'edge', count(*) FILTER (WHERE coalesce(confidence, 0.8) >= 0.55), count(*) FILTER (WHERE coalesce(confidence, 0.8) < 0.55) FROM extracted_relationships HAVING count(*) > 0",
    "graph_stats": f"WITH {_EDGES} SELECT (SELECT count(*) FROM (SELECT DISTINCT name, entity_type FROM extracted_entities)) AS nodes, (SELECT count(*) FROM e) AS edges",
    "graph_degree": f"WITH {_EDGES} SELECT name, count(*) AS degree FROM (SELECT a AS name FROM e UNION ALL SELECT b FROM e) GROUP BY 1",
    "entity_neighbours": f"WITH {_EDGES}, o AS (SELECT name, count(*) AS n, min(other) AS f FROM (SELECT a AS name, b AS other FROM e UNION ALL SELECT b, a FROM e WHERE a <> b) GROUP BY 1) SELECT name, coalesce(n, 0) AS n, coalesce(f, '') AS first_neighbour FROM (SELECT DISTINCT name FROM extracted_entities) LEFT JOIN o USING (name)",
    "entity_documents": "SELECT name, count(*) AS n, md5(string_agg(document_id, ',' ORDER BY document_id)) AS digest FROM (SELECT DISTINCT name, document_id FROM extracted_entities) GROUP BY 1",
    "document_units": "WITH u AS (SELECT document_id, count(*) AS n, min(chunk_key) AS f FROM (SELECT DISTINCT document_id, chunk_key FROM structured_chunks) GROUP BY 1) SELECT document_id, coalesce(n, 0) AS n_units, coalesce(f, '') AS first_unit FROM (SELECT DISTINCT document_id FROM ingest_documents) LEFT JOIN u USING (document_id)",
    "cooccurrence_edges": "WITH m AS (SELECT DISTINCT document_id, json_extract_string(properties, '$.page') AS page, name FROM extracted_entities WHERE name IS NOT NULL AND json_extract_string(properties, '$.page') IS NOT NULL), p AS (SELECT x.name AS a, y.name AS b, count(*) AS n FROM m x JOIN m y USING (document_id, page) WHERE x.name < y.name GROUP BY 1, 2) SELECT a, b, n, round(least(0.5 + 0.1 * n, 0.85), 6)::DOUBLE AS weight FROM p WHERE NOT EXISTS (SELECT 1 FROM extracted_relationships r WHERE least(r.from_name, r.to_name) = a AND greatest(r.from_name, r.to_name) = b)",
    "khop_neighborhood": f"WITH {_TRAILS.format(ways=_WAYS, kind='FAILURE_MODE')} SELECT start, node, hops, first_type, array_to_string(path, ',') AS path FROM trails",
    "neighborhood_graph": f"WITH {_TRAILS.format(ways=_WAYS, kind='STANDARD')} SELECT DISTINCT start, e.edge_id, a, type, b FROM (SELECT start, unnest(path) AS edge_id FROM trails) JOIN e USING (edge_id) UNION ALL SELECT DISTINCT name, NULL, name, NULL, NULL FROM extracted_entities WHERE entity_type = 'STANDARD' AND name NOT IN (SELECT start FROM trails)",
    "mentions": f"WITH {_MENTIONS} SELECT * FROM m",
    "mention_chunks": f"WITH {_MENTIONS}, c AS (SELECT DISTINCT document_id, chunk_key, chunk_index, element_uids FROM structured_chunks), u AS (SELECT document_id, chunk_key, unnest(element_uids) AS element_uid FROM c), f AS (SELECT DISTINCT document_id, name, chunk_key FROM m JOIN u USING (document_id, element_uid)), g AS (SELECT document_id, first(chunk_key ORDER BY chunk_index, chunk_key) AS chunk_key FROM c GROUP BY 1) SELECT * FROM f UNION ALL SELECT document_id, name, chunk_key FROM (SELECT DISTINCT document_id, name FROM extracted_entities) JOIN g USING (document_id) WHERE document_id NOT IN (SELECT document_id FROM f)",
    "canonicalize": r"""
        WITH n AS (SELECT name, entity_type, count(*) AS mentions FROM extracted_entities WHERE name IS NOT NULL GROUP BY 1, 2),
             a AS (SELECT DISTINCT name AS alias, regexp_replace(name, '^(Dr|Prof|Maj|Capt|LTC|Sgt)\.? +', '') AS canonical FROM n WHERE regexp_replace(name, '^(Dr|Prof|Maj|Capt|LTC|Sgt)\.? +', '') <> name),
             c AS (SELECT x.name, x.entity_type, first(y.name ORDER BY y.mentions DESC, y.name DESC) AS by_near FROM n x JOIN n y ON x.entity_type = y.entity_type AND y.mentions > x.mentions AND length(x.name) > 5 AND length(y.name) > 5
                   AND abs(length(x.name) - length(y.name)) <= 2 WHERE levenshtein(x.name, y.name) BETWEEN 1 AND 2 GROUP BY 1, 2)
        SELECT n.name, n.entity_type, CASE WHEN n.name IN (SELECT canonical FROM a) THEN n.name ELSE coalesce((SELECT min(canonical) FROM a WHERE alias = n.name), by_near, n.name) END AS canonical,
               CASE WHEN n.name IN (SELECT canonical FROM a) THEN 'exact' WHEN n.name IN (SELECT alias FROM a) THEN 'alias' WHEN by_near IS NOT NULL THEN 'fuzzy' ELSE 'self' END AS how
        FROM n LEFT JOIN c USING (name, entity_type)""",
    "entity_descriptions": """
        WITH e AS (SELECT name, entity_type, max(properties) AS p FROM extracted_entities GROUP BY 1, 2),
             k AS (SELECT name, entity_type, list_sort(list_transform(list_filter(coalesce(json_keys(p), []), lambda x: coalesce(json_extract_string(p, '$."' || x || '"'), '') <> ''), lambda x: array_to_string(list_transform(string_split(replace(x, '_', ' '), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') || ': ' || json_extract_string(p, '$."' || x || '"'))) AS ps FROM e)
        SELECT name, entity_type, name || ' is a ' || lower(replace(entity_type, '_', ' ')) || '.' || CASE WHEN len(ps) > 0 THEN ' ' || array_to_string(ps, '; ') ELSE '' END AS description FROM k""",
    "relationship_export": f"SELECT DISTINCT from_name AS source, to_name AS target, rel_type, ({_WEIGHT})::DOUBLE AS weight, from_name || ' ' || rel_type || ' ' || to_name AS description FROM extracted_relationships",
    "connected_components": f"WITH RECURSIVE {_EDGES}, w AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS c FROM w UNION SELECT w.b, r.c FROM r JOIN w ON r.node = w.a) SELECT node, min(c) AS component FROM r GROUP BY 1",
    "community_reports": f"WITH RECURSIVE {_PARTS} SELECT * FROM reports",
    "local_search": rf"""
        WITH RECURSIVE {_PARTS}, nm AS (SELECT DISTINCT qid, node FROM ask JOIN mm ON trim(node) <> '' AND CASE WHEN length(node) > 4 THEN contains(lower(text), lower(node)) ELSE regexp_matches(lower(text), '(^|[^\pL\pN_])' || regexp_escape(lower(node)) || '($|[^\pL\pN_])') END)
        SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY degree DESC, node) AS rank, node AS entity, degree, coalesce(neighbours, '') AS neighbours, community, report FROM nm JOIN mm USING (node) JOIN dg USING (node) LEFT JOIN nb USING (node) JOIN reports USING (community) QUALIFY rank <= 10""",
    "global_search": f"WITH RECURSIVE {_GLOBAL} SELECT qid, rank, community, score, size, report FROM gr JOIN reports USING (community) WHERE rank <= 5",
    "drift_search": f"""
        WITH RECURSIVE {_GLOBAL} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, degree DESC, node) AS rank, node AS entity, degree, coalesce(neighbours, '') AS neighbours, community, score
        FROM (SELECT * FROM gr WHERE rank <= 3) g JOIN (SELECT * FROM hd WHERE r <= 10) USING (community) LEFT JOIN nb USING (node) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, degree DESC, node) <= 10""",
    "structural_nodes": "SELECT DISTINCT document_id AS node_id, 'Document' AS label FROM ingest_documents UNION ALL SELECT DISTINCT chunk_key, 'Chunk' FROM structured_chunks UNION ALL SELECT DISTINCT document_id || ':' || element_uid, 'Element' FROM document_elements",
    "structural_edges": "WITH k AS (SELECT document_id, chunk_key, min(chunk_index) AS i FROM structured_chunks GROUP BY 1, 2), n AS (SELECT chunk_key AS source, lead(chunk_key) OVER (PARTITION BY document_id ORDER BY coalesce(i, 0), chunk_key) AS target FROM k) SELECT DISTINCT document_id AS source, chunk_key AS target, 'HAS_CHUNK' AS type FROM structured_chunks UNION ALL SELECT source, target, 'NEXT' FROM n WHERE target IS NOT NULL UNION ALL SELECT DISTINCT chunk_key, document_id || ':' || u, 'MADE_OF' FROM (SELECT chunk_key, document_id, unnest(element_uids) AS u FROM structured_chunks)",
    "relation_units": f"WITH {_EDGES}, o AS (SELECT DISTINCT name, document_id AS unit FROM extracted_entities WHERE name IS NOT NULL AND document_id IS NOT NULL), x AS (SELECT edge_id, unit FROM e JOIN o ON o.name = e.a UNION SELECT edge_id, unit FROM e JOIN o ON o.name = e.b) SELECT edge_id, count(*) AS n_units, min(unit) AS first_unit FROM x GROUP BY 1",
    "upsert_merge": "WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, CAST(o_orderdate AS DATE) AS day FROM orders), a AS (SELECT * EXCLUDE (day) FROM o WHERE day < DATE '1995-07-01' OR day IS NULL), b AS (SELECT o_orderkey, 'N' AS o_orderstatus, round(o_totalprice + 1, 2) AS o_totalprice, o_orderpriority FROM o WHERE day >= DATE '1995-01-01') SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, coalesce(a.o_orderstatus, b.o_orderstatus) AS o_orderstatus, coalesce(b.o_totalprice, a.o_totalprice) AS o_totalprice, coalesce(b.o_orderpriority, a.o_orderpriority) AS o_orderpriority FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey",
    "purge_document": "SELECT document_id, count(*) AS n FROM (SELECT DISTINCT document_id, id FROM document_elements) WHERE document_id NOT IN (SELECT document_id FROM ingest_documents WHERE pipeline_status = 'FAILED') GROUP BY 1",
    "purge_cascade": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t} WHERE document_id NOT IN (SELECT document_id FROM ingest_documents WHERE pipeline_status = 'FAILED')" for t in CASCADE),
    "chunk_patch": "SELECT id, CASE WHEN classification IS NULL THEN 'CUI' WHEN chunk_index % 2 = 1 THEN '' ELSE classification END AS classification, coalesce(length(chunk_text), 0) AS n_chars FROM text_chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1",
    "missing_stages": f"SELECT user_id, array_to_string(list_filter({list(STAGES)}, lambda x: NOT list_contains(list(DISTINCT event_type), x)), ',') AS missing FROM events WHERE user_id IS NOT NULL GROUP BY 1",
    "stale_elements": "SELECT DISTINCT document_id, element_uid FROM document_elements e WHERE NOT EXISTS (SELECT 1 FROM (SELECT document_id, unnest(element_uids) AS element_uid FROM structured_chunks) c WHERE c.document_id = e.document_id AND c.element_uid = e.element_uid)",
    "json_patch": "SELECT event_id, CASE event_type WHEN 'error' THEN '' WHEN 'click' THEN '0' ELSE coalesce(json_extract_string(props, '$.k'), '') END AS k FROM events",
    "latest_event": "SELECT user_id, last(event_id ORDER BY ts, event_id) AS event_id, last(event_type ORDER BY ts, event_id) AS event_type, count(*) AS n FROM events GROUP BY 1",
    "heading_carry": "WITH e AS (SELECT * FROM document_elements QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1) SELECT id, coalesce(last_value(CASE WHEN element_type = 'heading' THEN content_text END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY element_order, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS heading FROM e",
    "section_paths": """
        WITH e AS (SELECT *, coalesce(element_order, 0) AS o, CASE WHEN element_type = 'heading' THEN least(greatest(coalesce(heading_level, 1), 1), 6) END AS l FROM document_elements QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1),
             s AS (SELECT e.id, e.document_id, h.o, h.id AS hid, h.l, h.content_text AS t, row_number() OVER (PARTITION BY e.id, h.l ORDER BY h.o DESC, h.id DESC) AS r FROM e JOIN e h ON h.document_id = e.document_id AND h.l IS NOT NULL AND (h.o, h.id) <= (e.o, e.id)),
             b AS (SELECT * FROM s WHERE r = 1),
             k AS (SELECT id, l, t FROM b x WHERE NOT EXISTS (SELECT 1 FROM b y WHERE y.id = x.id AND y.l < x.l AND (y.o, y.hid) > (x.o, x.hid)))
        SELECT e.id, coalesce(string_agg(k.t, ' > ' ORDER BY k.l), '') AS path FROM e LEFT JOIN k USING (id) GROUP BY 1""",
    "ontology_layers": "WITH t(layer, entity_type) AS (VALUES " + ", ".join(f"('{g}', '{t}')" for t, g in ontology.default().layers.items()) + ") SELECT coalesce(layer, 'unknown') AS layer, count(*) AS n, count(DISTINCT name) AS names FROM extracted_entities LEFT JOIN t USING (entity_type) GROUP BY 1",
    "file_routes": "WITH f AS (SELECT DISTINCT document_id, lower(regexp_extract(filename, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM ingest_documents), t(ext, mime_type, parser) AS (VALUES " + ", ".join(f"('{k}', '{v}', '{'text' if v == 'text/plain' else 'converter'}')" for k, v in S.TYPES.items()) + ") SELECT coalesce(mime_type, 'application/octet-stream') AS mime_type, coalesce(parser, 'none') AS parser, count(*) AS n FROM f LEFT JOIN t USING (ext) GROUP BY 1, 2",
    "name_search": "SELECT DISTINCT name, entity_type FROM extracted_entities WHERE contains(lower(name), 'cor') ORDER BY name, entity_type LIMIT 10",
    "event_windows": _DAYS,
    "stream_event_windows": _DAYS,
}
