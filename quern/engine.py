"""The engine's verbs over a folder of tables: ingest, search, neighbourhood, purge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import keys as K
from quern.operators import chunking
from quern.operators import graph as G
from quern.operators.retrieval import QuerySpec
from quern.operators.tables import purge
from quern.sources import documents
from quern.sources.store import GraphTables, TableStore
from quern.tables import materialise, table

#: Older names of retrieval modes and what they stand for (strategy, modality).
MODES = {"text_basic": ("basic", "text"), "text_only": ("hybrid", "text"), "images_only": ("hybrid", "image"), "multi_modal": ("hybrid", "all"), "graphrag_local": ("local", "all"), "graphrag_global": ("global", "all")}
ELEMENTS = "document_id string, element_uid string, element_type string, element_order int, page_number int, section_path string, heading_level int, content_text string"
CHUNKS = chunking.CHUNK + ", chunk_id string"
MODEL = "hashed-64"


class Engine:
    """Searches a folder of tables and keeps ingested documents in a store of its own."""

    def __init__(self, spark: SparkSession, folder: str, store: str | None = None):
        self.spark, self.folder = spark, folder
        self.store = TableStore(spark, store) if store else None

    def ingest(self, files: DataFrame) -> dict[str, int]:
        """Parse (path, content) files, chunk their elements and merge both into the store; a known document is replaced."""
        parsed = documents.parse(files)
        doc = K.uuid5(F.col("path"))
        rows = parsed.select(doc.alias("document_id"), K.element_uid(F.lit(None).cast("int"), F.col("element_order"), F.col("element_type"), F.col("content_text")).alias("element_uid"), "element_type", "element_order", F.lit(None).cast("int").alias("page_number"), "section_path", "heading_level", "content_text")
        rows = materialise(rows.dropDuplicates(["document_id", "element_uid"]))
        chunks = chunking.structured(rows)
        chunks = chunks.withColumn("chunk_id", K.chunk_id(F.col("document_id"), F.col("element_uids"), F.col("chunk_index"), F.lit(MODEL)))
        sizes = {}
        for name, new, schema in (("elements", rows, ELEMENTS), ("chunks", chunks, CHUNKS)):
            kept = purge(self.store.read(name, schema), rows, "document_id")
            self.store.write(name, kept.unionByName(new))
            sizes[name] = self.store.read(name, schema).count()
        return sizes

    def purge(self, gone: DataFrame) -> None:
        """Remove the documents of `gone` (document_id) from every stored table."""
        for name, schema in (("elements", ELEMENTS), ("chunks", CHUNKS)):
            self.store.purge(name, gone, schema, "document_id")

    def search(self, spec: QuerySpec | str, queries: DataFrame | None = None) -> DataFrame:
        """Results of a retrieval for queries (qid, query_text[, vector]) by specification or by an older mode's name; without queries, for the stated query set of chunks."""
        from quern.plans import graph, retrieval

        if isinstance(spec, str):
            strategy, modality = MODES[spec]
            spec = QuerySpec(strategy=strategy, modality=modality)
        if spec.strategy in ("basic", "hybrid"):
            return retrieval.hybrid(self.spark, self.folder, spec, queries)
        asked = graph._asked(self.spark, self.folder) if queries is None else queries.select("qid", F.col("query_text").alias("text"))
        how = {"local": G.local_search, "global": G.global_search, "drift": G.drift_search}[spec.strategy]
        return how(asked, *graph._components(self.spark, self.folder), spec.top_k)

    def neighbourhood(self, names: list[str], hops: int = 2) -> DataFrame:
        from quern.plans import graph

        return G.neighbourhood(self.spark.createDataFrame([(n,) for n in names], "start string"), graph._plain_edges(self.spark, self.folder), hops)

    def index_graph(self, folder: str) -> GraphTables:
        """Export the graph's nodes, relations, text units, documents, communities and reports to a folder of tables."""
        from quern.plans import graph

        entities, relations = self.table("extracted_entities"), self.table("extracted_relationships")
        members, edges = graph._communities(self.spark, self.folder)
        members = materialise(members)
        degree = G.degree(edges.select(F.col("a").alias("from_name"), F.col("b").alias("to_name")))
        nodes = G.merge_nodes(entities).join(degree, "name", "left")
        top = members.where("level = 0").select("node", "community", "size")
        out = GraphTables(TableStore(self.spark, folder))
        out.write({
            "entities": nodes.select("name", "entity_type", G.describe(F.col("name"), F.col("entity_type"), F.from_json("properties", "map<string,string>")).alias("description"), F.coalesce("degree", F.lit(0)).alias("degree")),
            "relationships": G.export_relationships(relations),
            "text_units": self.table("structured_chunks").groupBy("document_id", F.col("chunk_key").alias("unit")).agg(F.max("text").alias("text")),
            "documents": self.table("ingest_documents").groupBy("document_id").agg(F.max("filename").alias("title")),
            "communities": members,
            "community_reports": G.reports(top, edges),
        })
        return out

    def tables(self) -> list[str]:
        return ["documents", "document_elements", "structured_chunks", "text_chunks", "image_chunks", "extracted_entities", "extracted_relationships"]

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)
