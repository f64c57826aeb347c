"""Cleaning and deduplication of documents and elements."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as X

#: Lines that may recur: they carry layout, not content.
LAYOUT = ("", "---", "***", "___", "|", "<!-- image -->")
OFTEN = 5
WHITE = " \t\r\n\f"


def sanitise(df: DataFrame) -> DataFrame:
    """Every string column normalised."""
    return df.withColumns({c: X.normalise(F.col(c)) for c, kind in df.dtypes if kind == "string"})


def tidy(text: str) -> str:
    """A text without the lines that recur: of a run of equal lines two stay; then a line that still occurs OFTEN times has its first only, layout lines excepted."""
    lines = text.split("\n")
    bare = [x.strip(WHITE) for x in lines]
    kept = [i for i, b in enumerate(bare) if not (i > 1 and bare[i - 1] == b == bare[i - 2])]
    counts = Counter(bare[i] for i in kept)
    seen: set[str] = set()
    out = []
    for i in kept:
        b = bare[i]
        if counts[b] < OFTEN or b in LAYOUT or b not in seen:
            out.append(lines[i])
        seen.add(b)
    return "\n".join(out)


def line_cleanup(df: DataFrame, key: str, text: str) -> DataFrame:
    """(`key`, cleaned): recurring lines thinned out and layout tidied, a row at a time and without a shuffle.

    A run of equal lines keeps two; then a line that still occurs five times or
    more keeps its first occurrence, layout lines excepted; then image marks go,
    more than three line breaks become three and line ends lose white space.
    Null texts have no row; empty ones stay empty.
    """

    @F.pandas_udf("string")
    def thinned(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: None if s is None else tidy(s))

    many = F.col("t").contains("\n")
    body = F.when(many, thinned(F.when(many, F.col("t")))).otherwise(F.col("t"))
    s = F.regexp_replace(body, "(?m)^[ \\t\\r\\n\\f]*<!-- image -->[ \\t\\r\\n\\f]*$", "")
    s = F.regexp_replace(s, "\n{4,}", "\n\n\n")
    return df.where(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("t")).select(key, F.regexp_replace(s, "(?m)[ \\t\\r\\f]+$", "").alias("cleaned"))


def keep_first(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order; null keys are equal to each other."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__first", F.row_number().over(w)).where("__first = 1").drop("__first")


def metadata_merge(left: Column, right: Column) -> Column:
    """Shallow merge of two map<string,string>, the right one winning; null counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(left, empty), F.coalesce(right, empty), lambda k, a, b: F.when(F.map_contains_key(F.coalesce(right, empty), k), b).otherwise(a))


def batch_numbers(sizes: list[int], limit: int) -> list[int]:
    """The batch of each item in order: a batch takes items while they fit; one over the limit stands alone."""
    out, batch, used = [], 0, 0
    for n in sizes:
        if used and used + n > limit:
            batch, used = batch + 1, 0
        out.append(batch)
        used += n
    return out


def pack(items: DataFrame, key: str, order: str, size: Column, limit: int) -> DataFrame:
    """(`key`, `order`, size, batch): items in order are put into a batch until the next would exceed `limit`; larger ones stand alone.

    Only the places and sizes of one key's items are gathered. `key` and `order`
    together must be unique.
    """

    @F.pandas_udf("array<int>")
    def numbers(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda s: batch_numbers(s, limit))

    rows = items.select(F.col(key).alias("k"), F.col(order).alias("o"), size.cast("int").alias("n"))
    lists = rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("o", "n"))).alias("s")).withColumn("b", numbers(F.transform("s", lambda x: x["n"])))
    each = lists.select("k", F.explode(F.arrays_zip("s", "b")).alias("z"))
    return each.select(F.col("k").alias(key), F.col("z.s.o").alias(order), F.col("z.s.n").alias("size"), F.col("z.b").alias("batch"))


#: Stands between the texts of a batch that are translated together.
BOUNDARY = "\n\n<<<SEGMENT>>>\n\n"


def translate(items: DataFrame, key: str, order: str, text: str, model: Callable[[Column], Column], limit: int = 2000) -> DataFrame:
    """(`key`, `order`, translated): texts translated in batches by `model`, a function of columns.

    A batch is one text with a mark between its items. If it comes back with
    another number of marks, its items are translated one by one; where a
    translation is empty, the text stays as it was.
    """
    placed = items.where(F.col(text).isNotNull()).join(pack(items.where(F.col(text).isNotNull()), key, order, F.length(text), limit).drop("size"), [key, order])
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    batches = placed.groupBy(key, "batch").agg(parts.alias("p"))
    back = batches.withColumn("whole", F.split(model(F.array_join(F.transform("p", lambda x: x["t"]), BOUNDARY)), BOUNDARY.strip()))
    each = back.select(key, F.size("whole") == F.size("p"), F.posexplode("p").alias("i", "x"), "whole").toDF(key, "fits", "i", "x", "whole")
    one = F.when(F.col("fits"), F.try_element_at("whole", F.col("i") + 1)).otherwise(model(F.col("x.t")))
    return each.select(key, F.col("x.o").alias(order), F.coalesce(F.nullif(X.strip(one), F.lit("")), F.col("x.t")).alias("translated"))


def fill_placeholders(markdown: Column, images: Column, mark: str = "<!-- image -->") -> Column:
    """The nth mark replaced by the nth of `images`; marks without an image stay."""
    parts = F.split(markdown, mark)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.coalesce(F.try_element_at(images, i.cast("int")), F.lit(mark)), p))), "")


def dominant_language(df: DataFrame, key: str, lang: str, flagged: Column) -> DataFrame:
    """(`key`, lang): the most frequent language of flagged rows, `en` without any; ties by name."""
    counts = df.groupBy(key, lang).agg(F.count_if(flagged).alias("n"))
    best = counts.groupBy(key).agg(F.max(F.struct(F.col("n"), F.col(lang).alias("l"))).alias("b"))
    top = counts.join(best, key).where((F.col("n") == F.col("b.n")) & (F.col("n") > 0)).groupBy(key).agg(F.min(lang).alias("l"))
    return df.select(key).distinct().join(top, key, "left").select(key, F.coalesce("l", F.lit("en")).alias("lang"))
