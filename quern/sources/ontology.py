"""The ontology: entity types by layer, allowed triples and relation weights, read from `ontology.yaml` or a file of its form."""

from __future__ import annotations

import pkgutil
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.tables import upsert

VERSIONED = "version int, kind string, name string, value string, is_current boolean"


@dataclass(frozen=True)
class Ontology:
    """Entity types with their layer, triples (source, relationship, target) and weights of relations."""

    version: int
    layers: dict[str, str]
    triples: tuple[tuple[str, str, str], ...]
    weights: dict[str, float]
    default_weight: float

    def types_of(self, layer: str) -> list[str]:
        return [t for t, own in self.layers.items() if own == layer]


def read(text: str) -> Ontology:
    """The ontology in a YAML text of scalars and of lists of scalars or single pairs; `yaml` isn't needed for that much."""
    plain: dict[str, str] = {}
    lists: dict[str, list[str]] = {}
    section = ""
    for line in text.splitlines():
        body = line.split("#", 1)[0].rstrip()
        if not body:
            continue
        if body.lstrip().startswith("- "):
            lists[section].append(body.lstrip()[2:].strip())
        else:
            section, _, value = body.partition(":")
            if value.strip():
                plain[section] = value.strip()
            else:
                lists[section] = []
    pairs = lambda name: {k: v for k, _, v in (x.partition(": ") for x in lists.get(name, []))}
    triples = tuple(tuple(x.split()) for x in lists.get("triples", []))
    return Ontology(int(plain.get("version", "1")), pairs("entity_types"), triples, {k: float(v) for k, v in pairs("relation_weights").items()}, float(plain.get("default_weight", "0.7")))


@lru_cache(maxsize=1)
def default() -> Ontology:
    return read(pkgutil.get_data("quern.sources", "ontology.yaml").decode())


def entity_types(spark: SparkSession, ontology: Ontology | None = None) -> DataFrame:
    """(entity_type, layer)."""
    return spark.createDataFrame(list((ontology or default()).layers.items()), "entity_type string, layer string")


def triples(spark: SparkSession, ontology: Ontology | None = None) -> DataFrame:
    """(source, relationship, target) that the ontology allows."""
    return spark.createDataFrame(list((ontology or default()).triples), "source string, relationship string, target string")


def weight_of(relation: Column, ontology: Ontology | None = None) -> Column:
    """Weight of a relation type; unknown and null types have the default."""
    o = ontology or default()
    table = F.create_map(*(F.lit(x) for kv in o.weights.items() for x in kv))
    return F.coalesce(F.try_element_at(table, relation), F.lit(o.default_weight))


def weight_sql(column: str, ontology: Ontology | None = None) -> str:
    """`weight_of` as SQL."""
    o = ontology or default()
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in o.weights.items()) + f" ELSE {o.default_weight} END"


def rows(spark: SparkSession, ontology: Ontology | None = None) -> DataFrame:
    """The ontology as rows (version, kind, name, value, is_current) of a versioned table."""
    o = ontology or default()
    every = [(o.version, "entity_type", t, layer, True) for t, layer in o.layers.items()]
    every += [(o.version, "triple", " ".join(t), "", True) for t in o.triples]
    every += [(o.version, "weight", k, str(w), True) for k, w in o.weights.items()]
    return spark.createDataFrame(every, VERSIONED)


def seed(held: DataFrame, new: DataFrame) -> DataFrame:
    """`held` with the rows of `new` that it lacks; the version of `new` becomes the current one, all others cease to be.

    Rows are known by version, kind and name; what is held of one isn't
    overwritten. An empty `new` changes nothing.
    """
    both = upsert(held, new, ["version", "kind", "name"], [])
    now = new.agg(F.max("version").alias("now"))
    return both.crossJoin(F.broadcast(now)).withColumn("is_current", F.when(F.col("now").isNull(), F.col("is_current")).otherwise(F.col("version") == F.col("now"))).select(*held.columns)  # one row
