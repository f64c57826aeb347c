"""Scoring, merging, diversifying and reranking of retrieved chunks; everything works on batches of queries (qid)."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.sources.ontology import weight_of

#: Weights of similarity, structure and ontology; penalty of a hop, bonus of a shared identifier, decay across modalities.
SEMANTIC, STRUCTURE, ONTOLOGY = 0.65, 0.20, 0.15
HOP, BONUS, CROSS = 0.92, 0.03, 0.85
LEAST_SCORE, OVERFETCH, MOST_FETCHED, RERANKED, RERANK_CHARS = 0.25, 8, 800, 20, 512
TEXT_KINDS, IMAGE_KINDS = ("text", "table"), ("image", "schematic", "image_description")
TERM = re.compile("[a-z0-9]+")
#: Sources of results, in order of precedence at equal scores.
SOURCES = ("seed", "doc_structure", "cross_modal", "ontology")


@dataclass(frozen=True)
class QuerySpec:
    """What a retrieval asks for, besides its queries."""

    strategy: str = "hybrid"
    modality: str = "all"
    top_k: int = 10
    filters: dict[str, object] = field(default_factory=dict)
    min_confidence: float | None = None
    include_context: bool = True
    rerank: bool = False

    def __post_init__(self) -> None:
        if not 1 <= self.top_k <= 100:
            raise ValueError("top_k is from 1 to 100")
        if self.strategy not in ("basic", "hybrid", "local", "global", "drift"):
            raise ValueError(f"no such strategy: {self.strategy}")
        if self.modality not in ("all", "text", "image"):
            raise ValueError(f"no such modality filter: {self.modality}")

    @property
    def fetched(self) -> int:
        return min(OVERFETCH * self.top_k, MOST_FETCHED)


def payload_filter(filters: dict[str, object]) -> Column:
    """All of the filters: a list means any of its values; None is no filter."""
    names = {"document_ids": "document_id", "modalities": "modality", "classifications": "classification"}
    parts = [F.col(names.get(k, k)).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(names.get(k, k)) == v for k, v in filters.items() if v is not None and k != "source_names"]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def of_sources(rows: DataFrame, documents: DataFrame, sources: list[str] | None) -> DataFrame:
    """`rows` of the documents of given sources; all rows if none are given."""
    if sources is None:
        return rows
    return rows.join(documents.where(F.col("source_name").isin(*sources)).select("document_id").distinct(), "document_id", "left_semi")


def modality_filter(which: str, column: str = "modality") -> Column:
    m = F.lower(F.trim(F.col(column)))
    return {"all": F.lit(True), "text": m.isin(*TEXT_KINDS), "image": m.isin(*IMAGE_KINDS)}[which]


def fusion(semantic: Column, link: Column, cross: Column, relation: Column, hops: Column, bonus: Column) -> Column:
    """Fused score of an expanded chunk, rounded to six places.

    A null link, cross or relation adds nothing; an identifier bonus is added
    last, and only then is the score capped at 1.
    """
    decay = F.pow(F.lit(HOP), F.greatest(F.coalesce(hops, F.lit(1)) - 1, F.lit(0)))
    structure = F.greatest(F.coalesce(link, F.lit(0.0)) * decay, F.coalesce(cross, F.lit(0.0)))
    score = F.lit(SEMANTIC) * F.coalesce(semantic, F.lit(0.0)) + F.lit(STRUCTURE) * structure + F.when(relation.isNotNull(), F.lit(ONTOLOGY) * weight_of(relation) * decay).otherwise(0.0)
    return F.round(F.when(F.coalesce(bonus, F.lit(False)), F.least(score + BONUS, F.lit(1.0))).otherwise(score), 6)


def merge_seeds(*lists: DataFrame) -> DataFrame:
    """The best row of each (qid, id) of several lists; rows without an id all stay."""
    both = reduce(lambda a, b: a.unionByName(b), lists)
    w = Window.partitionBy("qid", "id").orderBy(F.desc("score"), *(c for c in sorted(both.columns) if c not in ("qid", "id", "score") and not dict(both.dtypes)[c].startswith("map")))
    named = both.where("id IS NOT NULL").withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    return named.unionByName(both.where("id IS NULL"))


def dedupe(rows: DataFrame) -> DataFrame:
    """The best row of each (qid, id), of equal ones the one from the earlier source."""
    rank = reduce(lambda a, x: a.when(F.col("source") == x[1], x[0]), enumerate(SOURCES[1:], 1), F.when(F.col("source") == SOURCES[0], 0)).otherwise(len(SOURCES))
    w = Window.partitionBy("qid", "id").orderBy(F.desc("score"), rank, *(c for c in ("seed_id", "link_type", "rel_type", "entity_name", "related_name") if c in rows.columns))
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def diversify(rows: DataFrame) -> DataFrame:
    """The best of equal texts on a page of a document; images, graph nodes and rows without text all stay."""
    through = F.col("modality").isin("image", "graph_node") | F.col("chunk_text").isNull() | (X.strip(F.col("chunk_text")) == "")
    w = Window.partitionBy("qid", "document_id", "page_number", F.lower(X.strip(F.col("chunk_text")))).orderBy(F.desc("score"), "id")
    kept = rows.where(~F.coalesce(through, F.lit(True))).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    return kept.unionByName(rows.where(F.coalesce(through, F.lit(True))))


def cut(rows: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their rank; ties by id."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def lexical_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that the start of a text holds: the stand-in for a reranking model."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != ""))
    q, t = words(query), words(F.left(text, F.lit(RERANK_CHARS)))
    return F.round(F.size(F.array_intersect(q, t)) / F.greatest(F.size(q), F.lit(1)), 6)


def rerank(rows: DataFrame, top: int = RERANKED) -> DataFrame:
    """The first `top` of each query ordered anew by `lexical_score` (those without text last), the others behind them."""
    first = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    r = rows.withColumn("was", F.row_number().over(first))
    head = F.when((F.col("was") <= top) & F.col("chunk_text").isNotNull(), lexical_score(F.col("query_text"), F.col("chunk_text")))
    again = Window.partitionBy("qid").orderBy((F.col("was") > top).cast("int"), F.desc_nulls_last("rerank_score"), "was")
    return r.withColumn("rerank_score", head).withColumn("rank", F.row_number().over(again)).drop("was")


def image_url(modality: Column, document: Column, artifact: Column) -> Column:
    """Path of a chunk's image; null for texts."""
    return F.when(modality.isin(*IMAGE_KINDS), F.concat(F.lit("/v1/documents/"), document, F.lit("/artifacts/"), artifact, F.lit("/image")))


def context_text(rows: DataFrame) -> DataFrame:
    """(qid, context, sources): the results of each query as text for an agent, in order of rank, and the documents they come from.

    A result found through a relation or a link says so in a line of its own.
    Rows are a query's results, at most its top_k.
    """
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    percent = F.format_string("%.0f", F.col("score") * 100)
    head = F.concat(F.lit("### Result "), F.col("rank").cast("string"), F.lit(" (score: "), percent, F.lit("%, modality: "), F.coalesce("modality", F.lit("unknown")), F.lit(")"))
    hops = F.coalesce(F.col("hops") if "hops" in rows.columns else F.lit(1), F.lit(1))
    onto = F.concat(F.lit("*Via*: "), F.nullif(have("entity_name"), F.lit("")), F.lit(" → "), F.nullif(have("rel_type"), F.lit("")), F.lit(" → "), F.nullif(have("related_name"), F.lit("")))
    link = F.concat(F.lit("*Via*: "), have("link_type"), F.when(hops > 1, F.concat(F.lit(" ("), hops.cast("string"), F.lit(" hops)"))).otherwise(F.lit("")))
    via = F.when(have("source") == "ontology", onto).when(have("source") == "doc_structure", link)
    lines = F.concat_ws("\n", head, F.when(F.col("classification") != "UNCLASSIFIED", F.concat(F.lit("**Classification**: "), "classification")), F.when(F.col("page_number").isNotNull(), F.concat(F.lit("**Page**: "), F.col("page_number").cast("string"))), F.when(F.col("chunk_text") != "", F.concat(F.lit("\n"), "chunk_text", F.lit("\n"))).when(via.isNull(), F.lit("")), F.when(via.isNotNull(), F.concat(via, F.lit("\n"))))
    parts = F.array_sort(F.collect_list(F.struct("rank", lines.alias("line"))))
    named = F.array_sort(F.collect_set("document_id")) if "document_id" in rows.columns else F.array().cast("array<string>")
    return rows.groupBy("qid").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("context"), F.array_join(named, ",").alias("sources"))


#: Queries that are scored together.
BLOCK = 256


def _terms(text: str | None) -> list[str]:
    return TERM.findall(text.lower()) if text else []


def _term_blocks(queries: DataFrame, fuzzy: bool) -> Iterator[tuple[list, list[list[str]]]]:
    ids, terms = [], []
    for q, s in queries.select("qid", "text").where("text IS NOT NULL").toLocalIterator():
        ids.append(q)
        terms.append(sorted(set(_terms(s))))
        if len(ids) == BLOCK:
            yield ids, terms
            ids, terms = [], []
    if ids:
        yield ids, terms


def near_terms(term: str) -> set[str]:
    """A term and what is left of it without one of its letters: terms at one edit share one of these."""
    return {term, *(term[:i] + term[i + 1 :] for i in range(len(term)))}


def within_one(a: str, b: str) -> bool:
    """Whether two terms are equal or one insertion, deletion or exchange of a letter apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, fuzzy: bool = False) -> DataFrame:
    """(qid, id, score, rank) of the k best of `docs` (id, text) for each of `queries` (qid, text) by BM25.

    Terms are lower-case runs of ASCII letters and digits; with `fuzzy`, a term of
    four or more also finds those at one edit, each by its own frequency. Queries
    are a stated set, taken in blocks: document frequencies of a block's terms are
    counted in one pass, and in a second each document is scored for all queries
    of the block at once. A task keeps its k best for each query, so no term,
    however frequent, brings rows together. Null texts are no documents.
    """
    spark, kinds = docs.sparkSession, (dict(queries.dtypes)["qid"], dict(docs.dtypes)["id"])
    schema = f"qid {kinds[0]}, id {kinds[1]}, score double"
    arrow = [{"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind] for kind in kinds]
    body = docs.where("text IS NOT NULL").select("id", "text")
    parts = []
    for ids, terms in _term_blocks(queries, fuzzy):
        wanted = {t for own in terms for t in own}
        rests = {r for t in wanted if len(t) > 3 for r in near_terms(t)} if fuzzy else set()

        def count(batches: Iterator[pa.RecordBatch], wanted=wanted, rests=rests) -> Iterator[pa.RecordBatch]:
            df: Counter[str] = Counter()
            n = length = 0
            seen: dict[str, bool] = {}
            for batch in batches:
                for s in batch.column(0).to_pylist():
                    ws = _terms(s)
                    n, length = n + 1, length + len(ws)
                    for w in set(ws):
                        if w not in seen:
                            if len(seen) > 500_000:
                                seen.clear()
                            seen[w] = w in wanted or bool(rests and len(w) > 2 and not rests.isdisjoint(near_terms(w)))
                        if seen[w]:
                            df[w] += 1
            rows = [("", n), (" ", length), *df.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64())], names=["term", "n"])

        counts = {r.term: r.n for r in body.select("text").mapInArrow(count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()}
        n, length = counts.pop("", 0), counts.pop(" ", 0)
        if not n:
            continue
        known = {t: i for i, t in enumerate(sorted(counts))}
        asks = np.zeros((len(known), len(ids)), dtype=np.float64)
        by_rest: dict[str, list[str]] = {}
        for t in known if fuzzy else ():
            for r in near_terms(t):
                by_rest.setdefault(r, []).append(t)
        for q, own in enumerate(terms):
            for t in own:
                found = {t} if t in known else set()
                if fuzzy and len(t) > 3:
                    found |= {x for r in near_terms(t) for x in by_rest.get(r, ()) if within_one(t, x)}
                for x in found:
                    asks[known[x], q] = 1
        idf = np.array([math.log(1 + (n - counts[t] + 0.5) / (counts[t] + 0.5)) for t in known])
        sent = spark.sparkContext.broadcast((ids, known, asks, idf, length / n))  # a block's terms

        def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, known, asks, idf, mean = sent.value
            best: list[tuple[np.ndarray, np.ndarray, list]] = []

            def cut_best() -> None:
                """The k best of each query of all that is held, ties by id."""
                q, v, names = (np.concatenate([x[i] for x in best]) if i < 2 else [y for x in best for y in x[2]] for i in range(3))
                order = sorted(range(len(q)), key=lambda i: (q[i], -v[i], names[i]))
                keep, last, m = [], None, 0
                for i in order:
                    m = m + 1 if q[i] == last else 1
                    last = q[i]
                    if m <= k:
                        keep.append(i)
                best[:] = [(q[keep], v[keep], [names[i] for i in keep])]

            for batch in batches:
                names, tf = batch.column(0).to_pylist(), []
                for s in batch.column(1).to_pylist():
                    ws = _terms(s)
                    tf.append((len(ws), Counter(known[w] for w in ws if w in known)))
                for lo in range(0, len(names), 1024):
                    own = tf[lo : lo + 1024]
                    sizes = np.array([len(c) for _, c in own])
                    if not sizes.sum():
                        continue
                    term = np.array([t for _, c in own for t in c])
                    f = np.array([x for _, c in own for x in c.values()], dtype=np.float64)
                    size = np.repeat([m for m, _ in own], sizes)
                    part = idf[term] * f * (k1 + 1) / (f + k1 * (1 - b + b * size / mean))
                    full = np.flatnonzero(sizes)
                    total = np.round(np.add.reduceat(asks[term] * part[:, None], (np.cumsum(sizes) - sizes)[full], axis=0), 6)
                    if len(full) > k:
                        least = np.partition(total, len(full) - k, axis=0)[len(full) - k]
                        d, q = np.nonzero((total >= least) & (total > 0))
                    else:
                        d, q = np.nonzero(total > 0)
                    best.append((q, total[d, q], [names[lo + full[i]] for i in d]))
                if sum(len(x[0]) for x in best) > 8 * k * len(ids):
                    cut_best()
            if best:
                cut_best()
                q, v, names = best[0]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q.tolist()], arrow[0]), pa.array(names, arrow[1]), pa.array(v)], names=["qid", "id", "score"])

        parts.append(body.mapInArrow(score, schema))
    if not parts:
        return spark.createDataFrame([], schema + ", rank int")
    return cut(reduce(lambda a, b: a.unionByName(b), parts), k)
