"""Tables and objects in a folder that all executors share: snapshots, missing tables, content-addressed objects."""

from __future__ import annotations

import fnmatch
import hashlib
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.retrieval import payload_filter
from quern.operators.tables import purge, upsert
from quern.operators.vectors import topk


class TableStore:
    """Parquet tables under a root, each a sequence of snapshots; a pointer file names the one that counts.

    A new snapshot is written whole before the pointer moves, so a reader sees
    the old state or the new one. The root may be any Hadoop path.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):  # noqa: ANN202
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _current(self, name: str) -> str | None:
        fs, p = self._fs(f"{self.root}/{name}/current.txt")
        if not fs.exists(p):
            return None
        return self.spark.read.text(f"{self.root}/{name}/current.txt").first().value

    def read(self, name: str, schema: str) -> DataFrame:
        """The table's current snapshot; an empty table of `schema` if there is none."""
        now = self._current(name)
        return self.spark.createDataFrame([], schema) if now is None else self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{now}")

    def write(self, name: str, df: DataFrame) -> str:
        """Write a snapshot and let it count; earlier ones stay until `vacuum`."""
        snapshot = f"s-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}/{snapshot}")
        fs, p = self._fs(f"{self.root}/{name}/current.txt")
        out = fs.create(p, True)
        out.write(bytearray(snapshot.encode()))
        out.close()
        return snapshot

    def upsert(self, name: str, new: DataFrame, schema: str, keys: list[str], overwrite: list[str]) -> None:
        self.write(name, upsert(self.read(name, schema), new, keys, overwrite))

    def purge(self, name: str, gone: DataFrame, schema: str, key: str) -> None:
        self.write(name, purge(self.read(name, schema), gone, key))

    def vacuum(self, name: str) -> int:
        """Delete the snapshots that don't count any more; returns how many."""
        now, n = self._current(name), 0
        fs, p = self._fs(f"{self.root}/{name}")
        for status in fs.listStatus(p):
            if status.getPath().getName().startswith("s-") and status.getPath().getName() != now:
                fs.delete(status.getPath(), True)
                n += 1
        return n


def objects(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256, content) of the files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def matches_any(name: Column, patterns: list[str]) -> Column:
    """Whether a file name matches one of several shell patterns; no pattern matches nothing."""
    if not patterns:
        return F.lit(False)
    return F.coalesce(name.rlike("|".join(f"(?:{fnmatch.translate(p).replace(chr(92) + 'Z', '$').replace('\\z', '$')})" for p in patterns)), F.lit(False))


class ObjectStore:
    """Raw files under a root that all executors share, each under the hash of its content; any Hadoop path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, key: str):  # noqa: ANN202
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key[:2]}/{key}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def put(self, parts: Iterable[bytes]) -> tuple[str, int]:
        """(key, length) of an object given in parts: hashed as it is written, under its name only when it is whole. Known content is kept once."""
        digest, n = hashlib.sha256(), 0
        fs, made = self._at(f"new-{uuid.uuid4().hex}")
        out = fs.create(made, True)
        for part in parts:
            digest.update(part)
            n += len(part)
            out.write(bytearray(part))
        out.close()
        _, whole = self._at(digest.hexdigest())
        fs.mkdirs(whole.getParent())
        if fs.exists(whole) or not fs.rename(made, whole):
            fs.delete(made, False)
        return digest.hexdigest(), n

    def get(self, key: str) -> bytes | None:
        fs, p = self._at(key)
        if not fs.exists(p):
            return None
        if not fs.getFileStatus(p).getLen():
            return b""
        return bytes(self.spark.read.format("binaryFile").load(p.toString()).first().content)

    def delete(self, key: str) -> bool:
        fs, p = self._at(key)
        return bool(fs.delete(p, False))


class VectorTable:
    """Vectors with a payload in a store: upsert, exact search under a filter, deletion by a condition."""

    SCHEMA = "id string, vector array<float>, document_id string, modality string, classification string, payload map<string,string>"

    def __init__(self, store: TableStore, name: str):
        self.store, self.name = store, name

    def read(self) -> DataFrame:
        return self.store.read(self.name, self.SCHEMA)

    def upsert(self, rows: DataFrame) -> None:
        """Add rows or replace those of the same id, whole; of several new rows with an id the one with the greatest hash stays."""
        names = [f.split()[0] for f in self.SCHEMA.split(", ")]
        new = rows.select(*names).where("id IS NOT NULL")
        new = new.groupBy("id").agg(F.max_by(F.struct(*names[1:]), F.xxhash64(*names[1:5])).alias("v")).select("id", "v.*")
        self.store.write(self.name, purge(self.read(), new, "id").unionByName(new))

    def search(self, queries: DataFrame, k: int, filters: dict[str, object] | None = None, least: float | None = None) -> DataFrame:
        """(qid, id, score, rank) for `queries` (qid, vector)."""
        return topk(queries, self.read().where(payload_filter(filters or {})).select("id", "vector"), k, least)

    def delete(self, condition: Column) -> None:
        """Remove the rows for which a condition holds; where it is null, a row stays."""
        self.store.write(self.name, self.read().where(~F.coalesce(condition, F.lit(False))))


#: The tables of an indexed graph and what each holds.
GRAPH_TABLES = {
    "entities": "name string, entity_type string, description string, degree bigint",
    "relationships": "source string, target string, rel_type string, weight double, description string",
    "text_units": "unit string, document_id string, text string",
    "documents": "document_id string, title string",
    "communities": "node string, level int, community string, parent string, size bigint",
    "community_reports": "community string, size bigint, report string",
}


class GraphTables:
    """The tables of an indexed graph in a store; one that wasn't written reads as empty."""

    def __init__(self, store: TableStore):
        self.store = store

    def write(self, tables: dict[str, DataFrame]) -> None:
        for name, df in tables.items():
            self.store.write(name, df.select(*(f.split()[0] for f in GRAPH_TABLES[name].split(", "))))

    def read(self, name: str) -> DataFrame:
        return self.store.read(name, GRAPH_TABLES[name])

    def ready(self) -> bool:
        """Whether there are communities and reports to search."""
        return all(self.read(t).take(1) for t in ("communities", "community_reports"))
