"""What stands in for models: protocols of embedding, reranking, extraction and reporting, with deterministic defaults."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import graph as G
from quern.operators.retrieval import lexical_score
from quern.operators.vectors import hashed_embedding
from quern.sources import ontology


class EmbeddingProvider(Protocol):
    def embed(self, text: Column, kind: str) -> Column: ...


class RerankProvider(Protocol):
    def score(self, query: Column, text: Column) -> Column: ...


class ExtractProvider(Protocol):
    def extract(self, elements: DataFrame) -> DataFrame: ...


class ReportProvider(Protocol):
    def report(self, members: DataFrame, edges: DataFrame) -> DataFrame: ...


class HashedEmbedding:
    """Signed counts of hashed words; queries and passages carry the prefix that asymmetric models want."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, text: Column, kind: str = "passage") -> Column:
        return hashed_embedding(F.concat(F.lit(f"{kind}: "), text), self.dim)


class LexicalRerank:
    def score(self, query: Column, text: Column) -> Column:
        return lexical_score(query, text)


class GazetteerExtract:
    """Entities by the names of a gazetteer (name, entity_type), each with the layer of the ontology that its type belongs to."""

    def __init__(self, gazetteer: DataFrame):
        self.gazetteer = gazetteer

    def extract(self, elements: DataFrame) -> DataFrame:
        """(document_id, element_uid, name, entity_type, layer, confidence)."""
        spark = elements.sparkSession
        found = G.mentions(elements, self.gazetteer.select("name"))
        typed = found.join(self.gazetteer.select("name", "entity_type").distinct(), "name")
        layers = F.broadcast(ontology.entity_types(spark))  # the ontology's 46 types
        return typed.join(layers, "entity_type", "left").select("document_id", "element_uid", "name", "entity_type", F.coalesce("layer", F.lit("unknown")).alias("layer"), F.lit(G.NO_CONFIDENCE).alias("confidence"))


class SummaryReport:
    def report(self, members: DataFrame, edges: DataFrame) -> DataFrame:
        return G.reports(members, edges)


def schema_prompt(layer: str, known: list[tuple[str, str]] = (), most: int = 15) -> str:
    """The types of an ontology layer and the relations between them, as text for an extracting model.

    `known` (name, type) are entities found before, of which the first `most` by
    name are listed as context for relations.
    """
    o = ontology.default()
    types = o.types_of(layer)
    lines = [f"Entity types of the layer {layer}:", *(f"- {t}" for t in types), "", "Relations:"]
    lines += [f"- {s} {r} {t}" for s, r, t in o.triples if s in types or t in types]
    if known:
        lines += ["", "Entities found:", *(f"- {n} ({t})" for n, t in sorted(known)[:most])]
    return "\n".join(lines)
