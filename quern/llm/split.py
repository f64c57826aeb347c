"""Splitting oversized items at natural boundaries with a fixed overlap (problem 3).

Method: the text is cut into tokens (runs of word characters, of white space,
single other characters); the prefix sums of the token lengths give every
token's offset. Offsets at which a paragraph, a line, a sentence or a word ends
form one sorted boundary array for each of these four grades. From a piece's
start the last boundary under the limit is found by binary search, in the best
grade that has one in the piece's last part; with none, the cut is hard. The
next piece steps back from the cut by the overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT = 3000
OVERLAP = 200
#: A boundary counts only if it leaves a piece at least this full (by grade: paragraph, line, sentence, word).
FILL = (0.5, 0.6, 0.6, 0.3)

TOKEN = re.compile(r"\w+|\s+|[^\w\s]")
ENDERS = frozenset(".!?;:…。！？")
CLOSERS = frozenset("\"')]}»”’")


def boundaries(text: str) -> tuple[np.ndarray, ...]:
    """Sorted cut offsets of the grades paragraph, line, sentence, word.

    A cut stands after the white space that ends the unit, so that the pieces
    without their overlaps join to the text again.
    """
    tokens = TOKEN.findall(text)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)))
    grades: list[list[int]] = [[], [], [], []]
    for i, token in enumerate(tokens):
        if not token[0].isspace():
            if token[0] in "。！？":
                grades[2].append(int(ends[i]))
            continue
        end = int(ends[i])
        grades[3].append(end)
        breaks = token.count("\n")
        if breaks:
            grades[1].append(end)
            if breaks > 1:
                grades[0].append(end)
        j = i - 1
        while j >= 0 and tokens[j] in CLOSERS:
            j -= 1
        if j >= 0 and tokens[j] in ENDERS:
            grades[2].append(end)
    return tuple(np.array(g, dtype=np.int64) for g in grades)


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Half-open (start, end) ranges of the pieces of `text`, in code points.

    A text of at most `limit` code points, the empty one too, is one piece.
    """
    if not 0 <= overlap < limit * min(FILL):
        raise ValueError("the overlap must be smaller than the least filled piece")
    n = len(text)
    if n <= limit:
        return [(0, n)]
    grades, out, start = boundaries(text), [], 0
    while n - start > limit:
        most, cut = start + limit, 0
        for grade, fill in zip(grades, FILL):
            k = int(np.searchsorted(grade, most, side="right")) - 1
            if k >= 0 and grade[k] >= start + fill * limit:
                cut = int(grade[k])
                break
        cut = cut or most
        out.append((start, cut))
        start = cut - overlap
    out.append((start, n))
    return out


PIECE = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("start", "end")]))


def _ranges(limit: int, overlap: int):
    @F.pandas_udf(PIECE)
    def ranges(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda s: None if s is None else [{"start": a, "end": b} for a, b in cuts(s, limit, overlap)])

    return ranges


def piece_ranges(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """array<struct<start,end>> of the pieces of a text column.

    Only oversized texts travel to Python; the others are one range made on the
    JVM side. A null text has no pieces (an empty array), an empty text one
    empty piece.
    """
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end")))
    long = _ranges(limit, overlap)(F.when(F.length(text) > limit, text))
    return F.when(text.isNull(), F.array().cast(PIECE)).when(F.length(text) > limit, long).otherwise(whole.cast(PIECE))


def split_items(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item_key, piece_no, start, end, piece_text) of every row's text.

    Null texts give no row, empty texts one empty piece, equal rows each their
    own pieces; white space alone counts as text. Pieces hold `limit` code
    points at most; each after the first starts `overlap` before the end of the
    one before. Other columns of `df`, whatever their names, don't matter.
    """
    ranges = df.select(F.col(key).alias("item_key"), F.col(text).alias("body"), piece_ranges(F.col(text), limit, overlap).alias("ranges"))
    out = ranges.select("item_key", "body", F.posexplode("ranges").alias("piece_no", "range"))
    start, end = F.col("range.start"), F.col("range.end")
    return out.select("item_key", F.col("piece_no").cast("int").alias("piece_no"), start.alias("start"), end.alias("end"), F.substring(F.col("body"), start + 1, end - start).alias("piece_text"))


def item_sizes(df: DataFrame, key: str, text: str, *newest: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item_key, n_pieces) of the latest delivery of each item, by the same cuts.

    The cuts are made row by row before any shuffle, so only a key, a time and a
    count are shuffled, never a text. Items with a null text have 0 pieces.
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("item_key"), F.struct(*(F.col(c) for c in newest), F.size(piece_ranges(F.col(text), limit, overlap)).alias("n")).alias("v"))
    return rows.groupBy("item_key").agg(F.max("v").getField("n").alias("n_pieces"))
