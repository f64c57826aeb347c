"""Running values over rows in order, without a task that holds a whole group.

A group, such as a document with a third of all rows, is cut into spans of its
place numbers. Windows run within a span; what a span hands on to the later ones
is one row, and only these rows are put in order by group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places in one span.
SPAN = 4096
_GROUP, _SPAN, _PLACE, _TIE = "__group", "__span", "__place", "__tie"


def _spanned(df: DataFrame, group: list[str], place: str, tie: list[str], span: int) -> DataFrame:
    at = F.coalesce(F.col(place), F.lit(0)).cast("bigint")
    return df.withColumns({_GROUP: F.struct(*group), _PLACE: at, _SPAN: F.floor(at / span), _TIE: F.struct(*(tie or [place]))})


def _plain(df: DataFrame, *more: str) -> DataFrame:
    return df.drop(_GROUP, _SPAN, _PLACE, _TIE, *more)


def running_sum(df: DataFrame, group: list[str], place: str, tie: list[str], value: Column, name: str, span: int = SPAN) -> DataFrame:
    """`df` with the sum of `value` over the rows of its group up to and including each, in order of `place` (null as 0) and `tie`."""
    rows = _spanned(df, group, place, tie, span).withColumn("__v", value.cast("bigint"))
    within = Window.partitionBy(_GROUP, _SPAN).orderBy(_PLACE, _TIE).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(_GROUP).orderBy(_SPAN).rowsBetween(Window.unboundedPreceding, -1)
    borders = rows.groupBy(_GROUP, _SPAN).agg(F.sum("__v").alias("__s")).select(_GROUP, _SPAN, F.sum("__s").over(before).alias("__b"))
    out = rows.withColumn("__own", F.sum("__v").over(within)).join(borders, [_GROUP, _SPAN])
    return _plain(out.withColumn(name, F.coalesce("__own", F.lit(0)) + F.coalesce("__b", F.lit(0))), "__v", "__own", "__b")


def last_seen(df: DataFrame, group: list[str], place: str, tie: list[str], values: dict[str, Column], span: int = SPAN) -> DataFrame:
    """`df` with, for each name, the last of its values that isn't null up to and including each row of its group, in order of `place` and `tie`."""
    names = [f"__v{i}" for i in range(len(values))]
    rows = _spanned(df, group, place, tie, span).withColumns({n: F.struct(v.alias("v")) for n, v in zip(names, values.values())})
    rows = rows.withColumns({n: F.when(F.col(f"{n}.v").isNotNull(), F.col(n)) for n in names})
    within = Window.partitionBy(_GROUP, _SPAN).orderBy(_PLACE, _TIE).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(_GROUP).orderBy(_SPAN).rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(_PLACE, _TIE)
    ends = rows.groupBy(_GROUP, _SPAN).agg(*(F.max_by(n, F.when(F.col(n).isNotNull(), at)).alias(n) for n in names))
    borders = ends.select(_GROUP, _SPAN, *(F.last(n, ignorenulls=True).over(before).alias(f"{n}b") for n in names))
    out = rows.withColumns({f"{n}o": F.last(n, ignorenulls=True).over(within) for n in names}).join(borders, [_GROUP, _SPAN])
    out = out.withColumns({name: F.coalesce(f"{n}o", f"{n}b")["v"] for name, n in zip(values, names)})
    return _plain(out, *names, *(f"{n}{x}" for n in names for x in "ob"))


def next_of(df: DataFrame, group: list[str], place: str, tie: list[str], value: Column, name: str, span: int = SPAN) -> DataFrame:
    """`df` with the `value` of the row after each in its group, null after the last, in order of `place` and `tie`."""
    rows = _spanned(df, group, place, tie, span).withColumn("__v", F.struct(value.alias("v")))
    within = Window.partitionBy(_GROUP, _SPAN).orderBy(_PLACE, _TIE)
    firsts = rows.groupBy(_GROUP, _SPAN).agg(F.min_by("__v", F.struct(_PLACE, _TIE)).alias("__f"))
    borders = firsts.select(_GROUP, _SPAN, F.lead("__f").over(Window.partitionBy(_GROUP).orderBy(_SPAN)).alias("__b"))
    out = rows.withColumn("__own", F.lead("__v").over(within)).join(borders, [_GROUP, _SPAN])
    return _plain(out.withColumn(name, F.coalesce("__own", "__b")["v"]), "__v", "__own", "__b")
