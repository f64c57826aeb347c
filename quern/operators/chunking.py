"""Cutting documents into chunks: word and character windows in closed form, structure-aware chunks by sections."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators.ordered import next_of, running_sum
from quern.tables import materialise

#: Tokens of a chunk and of the overlap, tokens a word.
TOKENS, OVERLAP, RATE = 512, 64, 1.3
#: Words stand between ASCII white space, as in the column functions.
WORD = re.compile(r"[^ \t\r\n\f]+")


def word_windows(df: DataFrame, key: str, text: str, most: int = TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """(`key`, chunk_no, n_words, chunk_text): windows of int(most / 1.3) words that overlap by int(overlap / 1.3).

    The number of windows is closed-form, so nothing is folded or shuffled. Null
    texts have no row, empty ones one empty window.
    """
    size, lap = int(most / RATE), min(int(overlap / RATE), int(most / RATE) - 1)
    step = size - lap
    rows = df.where(F.col(text).isNotNull()).select(F.col(key), X.tokens(F.col(text)).alias("w"))
    count = F.when(F.size("w") <= size, 1).otherwise(F.ceil((F.size("w") - size) / step) + 1).cast("int")
    out = rows.select(key, "w", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_no"))
    part = F.slice("w", F.col("chunk_no") * step + 1, F.lit(size))
    return out.select(key, "chunk_no", F.size(part).alias("n_words"), F.array_join(part, " ").alias("chunk_text"))


def char_windows(df: DataFrame, key: str, text: str, size: int = 100_000, overlap: int = 2_000) -> DataFrame:
    """(`key`, window_no, start, window_text): windows of characters, one for each start below the length; empty and null texts have none."""
    step = size - min(overlap, size - 1)
    rows = df.where(F.length(text) > 0).select(key, F.col(text).alias("body"), F.explode(F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).alias("start"))
    return rows.select(key, (F.col("start") / step).cast("int").alias("window_no"), "start", F.substring(F.col("body"), F.col("start") + 1, F.lit(size)).alias("window_text"))


def paragraph_spans(sizes: list[int], most: int, overlap: int) -> list[tuple[int, int]]:
    """[first, end) of the pieces that paragraphs of these sizes fill up to `most`; a piece begins with the paragraph before it if that is at most `overlap`."""
    first, used, spans = 0, 0, []
    for i, n in enumerate(sizes):
        if i > first and used + n > most:
            spans.append((first, i))
            first = i - 1 if 0 < overlap and sizes[i - 1] <= overlap else i
            used = sum(sizes[first:i])
        used += n
    return [*spans, (first, len(sizes))]


def split_long(text: str, most: int, overlap: int) -> list[str]:
    """A text in pieces of `most` tokens: as it is, by paragraphs (kept whole, as they stand), or one paragraph by word windows."""
    words = WORD.findall(text)
    if int(len(words) * RATE) <= most:
        return [text]
    paragraphs = text.split("\n\n")
    if len(paragraphs) > 1:
        spans = paragraph_spans([int(len(WORD.findall(p)) * RATE) for p in paragraphs], most, overlap)
        return ["\n\n".join(paragraphs[a:b]) for a, b in spans]
    size = max(1, int(most / RATE))
    step = size - min(int(overlap / RATE), size - 1)
    return [" ".join(words[k * step : k * step + size]) for k in range(max(1, -(-(len(words) - size) // step) + 1))]


def pack_places(words: list[int], most: int) -> list[int]:
    """The number of the chunk that each element of a section falls in, by the elements' words: a chunk takes elements while they fit."""
    out, held, chunk = [], 0, 0
    for n in words:
        if held and int(held * RATE) + int(n * RATE) > most:
            held, chunk = 0, chunk + 1
        out.append(chunk)
        held += n
    return out


CHUNK = "document_id string, chunk_index int, modality string, page_number int, section_path string, element_uids array<string>, heading_text string, text string"
ALONE = ("table", "equation", "image")


def structured(elements: DataFrame, most: int = TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """Structure-aware chunks of document_elements-like rows.

    Headings and the elements that stand alone (tables, equations, images) part
    a document into sections, which are numbered by a running count over spans of
    places. A section's texts fill chunks in order, the heading first; a chunk
    over the limit is split. What stands alone is a chunk with the heading above
    it, if that heading's section wasn't cut. Page and section path of a chunk are
    the first known ones of its elements.

    Only the word counts of a section are gathered in one row, so neither a long
    document nor a long section is held in a task as text. A null order counts as
    0, blank elements make no chunk, rows without a document are dropped, and
    elements that repeat order and uid share a place.
    """
    rows = elements.where(F.col("document_id").isNotNull()).select("document_id", F.coalesce("element_order", F.lit(0)).alias("o"), "element_type", X.strip(F.col("content_text")).alias("t"), F.col("page_number").cast("int").alias("page"), "section_path", "element_uid").where("t <> ''")
    marks = F.col("element_type").isin("heading", *ALONE)
    rows = materialise(running_sum(rows, ["document_id"], "o", ["element_uid"], marks.cast("int"), "c"))
    alone = rows.where(F.col("element_type").isin(*ALONE))
    prose = rows.where(F.col("element_type").isNull() | ~F.col("element_type").isin(*ALONE))

    @F.pandas_udf("array<int>")
    def places(sections: pd.Series) -> pd.Series:
        return sections.map(lambda words: pack_places(words, most))

    item = F.struct("o", F.coalesce("element_uid", F.lit("")).alias("uid"), F.size(X.tokens(F.col("t"))).alias("n"))
    sections = prose.groupBy("document_id", "c").agg(F.array_sort(F.array_distinct(F.collect_list(item))).alias("s"))
    sections = sections.withColumn("p", places(F.transform("s", lambda x: x["n"])))
    placed = sections.select("document_id", "c", F.explode(F.arrays_zip("s", "p")).alias("z")).select("document_id", "c", F.col("z.s.o").alias("o"), F.col("z.s.uid").alias("uid"), F.col("z.p").alias("part")).distinct()
    whole = sections.select("document_id", (F.col("c") + 1).alias("c"), (F.element_at("p", -1) == 0).alias("whole"))
    heads = rows.where("element_type = 'heading'").select("document_id", "c", F.col("t").alias("heading"))

    every = prose.withColumn("uid", F.coalesce("element_uid", F.lit(""))).join(placed, ["document_id", "c", "o", "uid"])
    ordered = F.array_sort(F.collect_list(F.struct("o", "uid", "element_uid", "page", "section_path", "t")))
    chunks = every.groupBy("document_id", "c", "part").agg(ordered.alias("e")).join(heads, ["document_id", "c"], "left")
    known = lambda name: F.try_element_at(F.filter(F.transform("e", lambda x: x[name]), lambda v: v.isNotNull()), F.lit(1))
    chunks = chunks.select("document_id", "c", F.lit(1).alias("after"), "part", F.lit("text").alias("modality"), known("page").alias("page_number"), known("section_path").alias("section_path"), F.transform("e", lambda x: x["element_uid"]).alias("element_uids"), F.when(F.col("part") == 0, F.col("heading")).alias("heading_text"), F.array_join(F.transform("e", lambda x: x["t"]), "\n\n").alias("body"))

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: split_long(s, most, overlap))

    long = chunks.where(X.approx_tokens(F.col("body")) > most).withColumn("pieces", pieces("body"))
    short = chunks.where(X.approx_tokens(F.col("body")) <= most).withColumn("pieces", F.array("body"))
    above = heads.withColumn("c", F.col("c") + 1).join(whole.where("whole"), ["document_id", "c"], "left_semi")
    lone = alone.join(above, ["document_id", "c"], "left").select("document_id", "c", F.lit(0).alias("after"), F.lit(0).alias("part"), F.col("element_type").alias("modality"), F.col("page").alias("page_number"), "section_path", F.array("element_uid").alias("element_uids"), F.col("heading").alias("heading_text"), F.col("t").alias("body"), F.array("t").alias("pieces"))
    out = long.unionByName(short).unionByName(lone).select("*", F.posexplode("pieces").alias("piece", "text"))
    numbered = running_sum(out, ["document_id"], "c", ["after", "part", "piece"], F.lit(1), "n", 512)
    return numbered.select("document_id", (F.col("n") - 1).cast("int").alias("chunk_index"), "modality", "page_number", "section_path", "element_uids", "heading_text", "text")


def element_sections(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(`key`, `order`, section_no, chunk_index, section_text): a description's sections with the places they take among chunks."""
    rows = df.where(F.col(text).isNotNull()).select(key, order, F.posexplode(X.sections(F.col(text))).alias("section_no", "section_text"))
    return rows.select(key, order, "section_no", (F.lit(100_000) + F.col(order) * 100 + F.col("section_no")).alias("chunk_index"), "section_text")


def section_links(sections: DataFrame, key: str) -> DataFrame:
    """(source, target) of consecutive sections (`key`, section_no, chunk_index) of one description, both ways, by their chunk_index."""
    pairs = next_of(sections, [key], "section_no", ["chunk_index"], F.col("chunk_index"), "n", 256).where("n IS NOT NULL").select(key, F.col("chunk_index").alias("source"), F.col("n").alias("target"))
    return pairs.unionAll(pairs.select(key, "target", "source"))


def numbered(df: DataFrame, group: str, place: str, tie: list[str], size: int = 128) -> DataFrame:
    """`df` with the batch, of `size` rows of its group in order, that each row is embedded or written with."""
    return running_sum(df, [group], place, tie, F.lit(1), "__n").withColumn("batch", F.floor((F.col("__n") - 1) / size).cast("int")).drop("__n")
