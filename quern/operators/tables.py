"""Upserts, purges and patches of tables, each as a new state to be written beside the old."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], overwrite: list[str]) -> DataFrame:
    """`old` with the rows of `new` merged in: of a known key only `overwrite` changes, unknown keys are added.

    A null in `new` overwrites nothing. Keys must be unique in each table.
    """
    rest = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*rest).alias("__old"))
    n = new.select(*keys, F.struct(*rest).alias("__new"))
    both = o.join(n, keys, "full_outer")
    value = lambda c: F.coalesce(F.col(f"__new.{c}"), F.col(f"__old.{c}")) if c in overwrite else F.when(F.col("__old").isNull(), F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}"))
    return both.select(*keys, *(value(c).alias(c) for c in rest))


def purge(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """`df` without the rows of keys in `gone`."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def stale(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `old` whose keys `new` no longer has."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti")


def patch_map(props: Column, op: Column, key: Column, value: Column) -> Column:
    """A map<string,string> after one patch: replace and add set a key, remove drops it, merge sets every key of `value`, a JSON object; anything else leaves the map."""
    base = F.coalesce(props, F.create_map().cast("map<string,string>"))
    more = F.coalesce(F.from_json(value, "map<string,string>"), F.create_map().cast("map<string,string>"))
    without = F.map_filter(base, lambda k, _: k != key)
    return F.when(op.isin("replace", "add"), F.map_concat(without, F.create_map(key, value))).when(op == "merge", F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(more, k)), more)).when(op == "remove", without).otherwise(base)


def purge_all(tables: dict[str, DataFrame], gone: DataFrame, key: str = "document_id") -> dict[str, DataFrame]:
    """Every one of `tables` without the rows of the keys in `gone`; tables without the key stay as they are."""
    return {name: purge(df, gone, key) if key in df.columns else df for name, df in tables.items()}


def patch_rows(df: DataFrame, patches: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """`df` after the last patch (`key`, path, op, value, at) of each row and path: replace and add set a field, remove empties it; paths outside `fields` are left out."""
    last = patches.where(F.col("path").isin(*fields)).groupBy(key, "path").agg(F.max(F.struct("at", "op", "value")).alias("p"))
    wide = last.groupBy(key).agg(*(F.max(F.when(F.col("path") == f, F.col("p"))).alias(f"__{f}") for f in fields))
    both = df.join(wide, key, "left")
    value = lambda f: F.when(F.col(f"__{f}.op").isin("replace", "add"), F.col(f"__{f}.value")).when(F.col(f"__{f}.op") == "remove", F.lit(None)).otherwise(F.col(f))
    return both.withColumns({f: value(f) for f in fields}).select(*df.columns)
