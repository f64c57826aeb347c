"""Exact vector search by blocks of queries, and vector columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.tables import materialise

#: Queries sent to the workers at once: a block of 1,024-dimensional vectors is 32 MB.
BLOCK = 4096


def unit(v: Column) -> Column:
    """array<double> of length one; a zero vector stays as it is."""
    d = v.cast("array<double>")
    n = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(d, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of equal length; null if either is null, zero or of another length."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda acc, s: acc + s)
    n = F.sqrt(dot(x, x) * dot(y, y))
    return F.when((F.size(x) == F.size(y)) & (n > 0), dot(x, y) / F.nullif(n, F.lit(0.0)))


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: counts of hashed words, signed, of length one. Null texts have none."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    bins = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(2 * dim)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.size(F.filter(bins, lambda b: b == i)) - F.size(F.filter(bins, lambda b: b == i + dim))).cast("double"))
    return F.when(text.isNotNull(), unit(counts))


def _blocks(queries: DataFrame, size: int) -> Iterator[tuple[list, np.ndarray]]:
    ids, rows = [], []
    for q, v in queries.select("qid", "vector").where("vector IS NOT NULL").toLocalIterator():
        ids.append(q)
        rows.append(v)
        if len(ids) == size:
            yield ids, np.array(rows, dtype=np.float64)
            ids, rows = [], []
    if ids:
        yield ids, np.array(rows, dtype=np.float64)


def topk(queries: DataFrame, vectors: DataFrame, k: int, least: float | None = None, block: int = BLOCK) -> DataFrame:
    """(qid, id, score, rank): the k nearest by cosine of every query, exactly; ties by id.

    `queries` (qid, vector) is a stated set, taken in blocks against all of
    `vectors` (id, vector). Each Arrow batch is one matrix product, and a task
    sends on its k best for each query, so little is shuffled. Null and zero vectors, and such
    of another length than the queries, are never found; queries of zero length
    find nothing. All queries must have one length.
    """
    kinds = dict(queries.dtypes)["qid"], dict(vectors.dtypes)["id"]
    schema = f"qid {kinds[0]}, id {kinds[1]}, score double"
    parts = []
    for ids, q in _blocks(materialise(queries.select("qid", "vector")), block):
        norm = np.linalg.norm(q, axis=1)
        keep = norm > 0
        sent = queries.sparkSession.sparkContext.broadcast(([i for i, g in zip(ids, keep) if g], q[keep] / norm[keep, None]))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, m = sent.value
            dim = m.shape[1] if len(names) else 0
            best, held = np.full((len(names), k), -np.inf), []
            for batch in batches:
                lengths = np.nan_to_num(batch.column(1).value_lengths().to_numpy(zero_copy_only=False), nan=-1)
                rows = np.flatnonzero(lengths == dim)
                if not len(rows) or not len(names):
                    continue
                v = batch.column(1).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                n = np.linalg.norm(v, axis=1)
                rows, v = rows[n > 0], v[n > 0] / n[n > 0, None]
                if not len(rows):
                    continue
                s = m @ v.T
                own = batch.column(0).take(pa.array(rows))
                best = -np.partition(-np.concatenate([best, s], axis=1), k - 1, axis=1)[:, :k]
                x, y = np.nonzero(s >= best.min(axis=1, keepdims=True) - 1e-12)  # everything that ties with the kth so far
                held.append((x, s[x, y], own.take(pa.array(y))))
            least = best.min(axis=1) - 1e-12
            for x, score, own in held:
                keep = score >= least[x]
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in x[keep].tolist()]).cast(_arrow(kinds[0])), own.filter(pa.array(keep)), pa.array(score[keep])], names=["qid", "id", "score"])

        parts.append(vectors.select("id", "vector").mapInArrow(search, schema))
    if not parts:
        return queries.sparkSession.createDataFrame([], schema + ", rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    if least is not None:
        found = found.where(F.col("score") >= least)
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]
