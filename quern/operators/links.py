"""Links between chunks by the structure of their documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.ordered import next_of

#: Weights of links.
WEIGHTS = {"NEXT_CHUNK": 0.90, "SAME_SECTION": 0.88, "SAME_ARTIFACT": 0.82, "SAME_PAGE": 0.78}
#: Pages of a document that are put in order together.
SPAN = 64


def _both(pairs: DataFrame, kind: str) -> DataFrame:
    weight = F.lit(WEIGHTS[kind]).alias("weight")
    one = pairs.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.lit(kind).alias("link_type"), weight)
    return one.unionAll(pairs.select(F.col("b").alias("source_id"), F.col("a").alias("target_id"), F.lit(kind).alias("link_type"), weight))


def neighbours(chunks: DataFrame, kind: str, group: list[str]) -> DataFrame:
    """Links both ways between consecutive chunks (id) of a group, by page (unknown ones last), place and id; groups with a null have none."""
    rows = chunks
    for g in group:
        rows = rows.where(F.col(g).isNotNull())
    rows = rows.select(*group, "id", F.coalesce("page_number", F.lit(2**31 - 1)).alias("p"), F.coalesce("chunk_index", F.lit(-1)).alias("i"))
    return _both(next_of(rows, group, "p", ["i", "id"], F.col("id"), "b", SPAN).select(F.col("id").alias("a"), "b").where("b IS NOT NULL"), kind)


def next_chunk(chunks: DataFrame) -> DataFrame:
    return neighbours(chunks, "NEXT_CHUNK", ["document_id"])


def same_section(chunks: DataFrame) -> DataFrame:
    return neighbours(chunks, "SAME_SECTION", ["document_id", "section_path"])


def same_artifact(chunks: DataFrame) -> DataFrame:
    return neighbours(chunks, "SAME_ARTIFACT", ["document_id", "artifact_id"])


def same_page(texts: DataFrame, images: DataFrame) -> DataFrame:
    """Links both ways between the texts and the images of a page; unknown pages have none."""
    a, b = texts.select("document_id", "page_number", F.col("id").alias("a")), images.select("document_id", "page_number", F.col("id").alias("b"))
    return _both(a.join(b, ["document_id", "page_number"]).select("a", "b"), "SAME_PAGE")


def all_links(texts: DataFrame, images: DataFrame, hops: int = 1) -> DataFrame:
    """(source_id, target_id, link_type, weight, hop): every structural link once.

    Sections link where `texts` has a section_path. With `hops` 2, pairs that are
    linked through one chunk only are added, with the type of the first and the
    lesser weight of the two links.
    """
    one = next_chunk(texts).unionAll(same_artifact(texts)).unionAll(same_page(texts, images))
    if "section_path" in texts.columns:
        one = one.unionAll(same_section(texts))
    one = one.distinct().withColumn("hop", F.lit(1))
    if hops < 2:
        return one
    a, b = one.alias("a"), one.alias("b")
    two = a.join(b, (F.col("a.target_id") == F.col("b.source_id")) & (F.col("a.source_id") != F.col("b.target_id"))).select(F.col("a.source_id").alias("source_id"), F.col("b.target_id").alias("target_id"), F.struct(F.least("a.weight", "b.weight").alias("weight"), F.col("a.link_type").alias("link_type")).alias("v"))
    far = two.groupBy("source_id", "target_id").agg(F.max("v").alias("v")).join(one.select("source_id", "target_id").distinct(), ["source_id", "target_id"], "left_anti")
    return one.unionByName(far.select("source_id", "target_id", "v.link_type", "v.weight", F.lit(2).alias("hop")))


def expand(seeds: DataFrame, links: DataFrame, most: int = 5, hops: int = 2) -> DataFrame:
    """(qid, seed_id, target_id, link_type, weight, hop, score): the best links of every seed (qid, id, score); ties by type and target."""
    w = Window.partitionBy("qid", "seed_id").orderBy(F.desc("weight"), "link_type", "target_id")
    rows = seeds.select("qid", F.col("id").alias("seed_id"), "score").join(links.where(F.col("hop") <= hops), F.col("seed_id") == F.col("source_id"))
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("qid", "seed_id", "target_id", "link_type", "weight", "hop", "score")
