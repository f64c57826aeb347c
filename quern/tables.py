"""Reading the tables of a data folder, keeping one record of each key, and cutting lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of `folder` (a file or a directory of files)."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df`, as read from a table, over all cores: rows are dealt out anew only where the files make fewer partitions than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def latest(df: DataFrame, key: str | list[str], *newest: str) -> DataFrame:
    """One row for each `key`: the one with the greatest `newest` columns.

    Rows that tie on all of `newest` are repeats of one delivery; the one with
    the smallest hash over all columns stays, so the choice doesn't depend on
    row order. Null `newest` values count as oldest. Rows whose key holds a
    null are no records and are dropped.
    """
    keys = [key] if isinstance(key, str) else list(key)
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    hashable = [c for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]
    order: list[Column] = [F.col(c).desc_nulls_last() for c in newest] + [F.xxhash64(*hashable)]
    w = Window.partitionBy(*keys).orderBy(*order)
    rank = "__latest_rank"
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank)


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`, which all executors share; only where that is unset and the master is local, as in tests, a temporary folder."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quern-checkpoint-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame) -> DataFrame:
    """`df` written once to the checkpoint folder and read back, its lineage cut."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
