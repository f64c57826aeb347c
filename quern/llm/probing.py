"""The k most similar vectors for a stated set of query vectors, near or far (problem 7).

Method: multi-probe p-stable hashing, probed from the query's side. Every vector
stands in one bucket of each table. A query visits its own bucket and, in the order
of their estimated success, buckets that differ by single steps in some
coordinates; the order of the sets of steps follows from the expected distances of
a point to its cell's borders and is the same for all queries. Candidates of all
tables are merged by their exact cosines.

The number of hash values and of probes is chosen by measurement: of the settings
that reach the recall at the target cosine, the one that visits the fewest vectors.
The farther the target, the more vectors that is: see the README for figures.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.buckets import mix
from quern.llm.neighbours import K, SEED, WIDTH, _marks, _unit, classes, collision
from quern.tables import materialise

TABLES, RECALL, TARGET = 12, 0.95, 0.45
#: Most buckets of a table that a query visits, and parts of a table's buckets.
MOST_PROBES, PARTS = 256, 8
#: Queries that are sent to the workers together (256 bytes each at 64 dimensions), and pairs compared at once.
QUERIES, PAIRS = 4096, 400_000


@lru_cache(maxsize=32)
def step_sets(m: int, most: int) -> tuple[tuple[int, ...], ...]:
    """Sets of places among a point's 2 m borders in order of distance, the likeliest first: those with the least expected sum of squared distances. Borders of one cell exclude each other."""
    near = [(j * (j + 1)) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    far = [1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(m + 1, 2 * m + 1)]
    z = near + far
    cost = lambda s: sum(z[j] for j in s)
    heap, out = [(z[0], (0,))], []
    while heap and len(out) < most:
        _, s = heapq.heappop(heap)
        if len({min(j, 2 * m - 1 - j) for j in s}) == len(s):
            out.append(s)
        if s[-1] + 1 < 2 * m:
            for ahead in ((*s[:-1], s[-1] + 1), (*s, s[-1] + 1)):
                heapq.heappush(heap, (cost(ahead), ahead))
    return tuple(out)


class Index:
    """Projections of all tables, the keys of vectors and the probes of queries."""

    def __init__(self, dim: int, m: int, tables: int, probes: int):
        rng = np.random.default_rng(SEED)
        self.dim, self.m, self.tables = dim, m, tables
        self.a = rng.standard_normal((tables, m, dim)).astype(np.float32)
        self.b = rng.uniform(0, WIDTH, (tables, m)).astype(np.float32)
        self.salt = mix(np.arange(1, tables * m + 1, dtype=np.uint64)).reshape(tables, m)
        self.sets = step_sets(m, probes)

    def _cells(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        f = (x @ self.a[table].T + self.b[table]) / np.float32(WIDTH)
        cell = np.floor(f).astype(np.int64)
        return cell, f - cell

    def keys(self, x: np.ndarray, table: int) -> np.ndarray:
        """int64 key of the bucket of each vector."""
        cell, _ = self._cells(x, table)
        return mix(cell.astype(np.uint64) + self.salt[table]).sum(axis=1, dtype=np.uint64).view(np.int64)

    def probes(self, x: np.ndarray, table: int) -> np.ndarray:
        """int64 (query x 1 + probes) keys of the buckets to visit, in order."""
        cell, low = self._cells(x, table)
        own = mix(cell.astype(np.uint64) + self.salt[table])
        home = own.sum(axis=1, dtype=np.uint64)
        order = np.argsort(np.concatenate([low, 1 - low], axis=1), axis=1)
        at, step = order % self.m, np.where(order < self.m, -1, 1)
        rows = np.arange(len(x))[:, None]
        change = mix((cell[rows, at] + step).astype(np.uint64) + self.salt[table][at]) - own[rows, at]
        out = [home, *(home + change[:, list(s)].sum(axis=1, dtype=np.uint64) for s in self.sets)]
        return np.stack(out, axis=1).view(np.int64)

    def found(self, cosine: float, pairs: int = 600) -> np.ndarray:
        """Share of random pairs at a cosine that have met after so many probes in every table."""
        rng = np.random.default_rng(SEED + 1)
        x = rng.standard_normal((pairs, self.dim)).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z = rng.standard_normal((pairs, self.dim)).astype(np.float32)
        z -= (z * x).sum(1, keepdims=True) * x
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        y = np.float32(cosine) * x + np.float32(math.sqrt(1 - cosine * cosine)) * z
        met = np.zeros((pairs, len(self.sets) + 1), dtype=bool)
        for t in range(self.tables):
            met |= self.probes(x, t) == self.keys(y, t)[:, None]
        return np.logical_or.accumulate(met, axis=1).mean(axis=0)


@lru_cache(maxsize=16)
def choose(n: int, dim: int, cosine: float, recall: float, tables: int) -> tuple[int, int, float]:
    """(hash values, probes, expected share of all vectors visited) of the cheapest setting with the recall.

    Shares are those of unrelated vectors; short hashes have few probes to make
    and large buckets, long ones the opposite.
    """
    p = collision(math.sqrt(2.0))
    most = max(2, math.ceil(math.log(max(4.0, n / 16)) / -math.log(p)))
    best = None
    for m in sorted({max(1, round(most * f)) for f in (0.1, 0.2, 0.3, 0.45, 0.6, 0.8, 1.0)}):
        share = Index(dim, m, tables, MOST_PROBES).found(cosine)
        enough = np.flatnonzero(share >= recall)
        if len(enough):
            cost = tables * (enough[0] + 1) * p**m
            if best is None or cost < best[2]:
                best = (m, int(enough[0]), float(cost))
    return best or (1, MOST_PROBES, 1.0)


def search(df: DataFrame, key: str, vector: str, asked: Column, *newest: str, k: int = K, cosine: float = TARGET, recall: float = RECALL, tables: int = TABLES) -> DataFrame:
    """(qid, id, cosine, rank): the k most similar others of each vector for which `asked` (a condition on `id`) holds, ties by id.

    Null, zero and non-finite vectors neither ask nor are found; vectors of
    different lengths are searched by length; of several deliveries the latest
    counts. Records with an equal vector are others like any. Neighbours beyond
    the target cosine are found less surely than with the recall.
    """
    dims = [r.d for r in df.select(F.size(vector).alias("d")).where("d > 0").distinct().collect()]  # a handful
    parts = [_search(df, key, vector, asked, newest, dim, k, cosine, recall, tables) for dim in sorted(dims)]
    out = df.sparkSession.createDataFrame([], "qid string, id string, cosine double, rank int")
    for p in parts:
        out = out.unionByName(p)
    return out


def _search(df: DataFrame, key: str, vector: str, asked: Column, newest: tuple[str, ...], dim: int, k: int, cosine: float, recall: float, tables: int) -> DataFrame:
    spark = df.sparkSession
    members = classes(df, key, vector, dim, newest)
    m, probes, _ = choose(members.count(), dim, cosine, recall, tables)
    index = Index(dim, m, tables, probes)
    source = df.select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("v")).where(F.col("id").isNotNull())

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, unit = _unit(batch.column(1), dim)
            if len(rows):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(_marks(unit)), pa.array(list(unit), pa.list_(pa.float32()))], names=["id", "mark", "v"])

    # Of the deliveries of a record the one whose vector counts.
    rows = materialise(source.mapInArrow(settled, "id string, mark bigint, v array<float>").join(members, ["id", "mark"]).dropDuplicates(["id"]).select("id", "v"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for t in range(tables):
                own = index.keys(x, t)
                part = t * PARTS + (own.view(np.uint64) % np.uint64(PARTS)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(own), batch.column(0), batch.column(1)], names=["part", "key", "id", "v"])

    # Within a part, Spark may deal rows to several tasks; each task answers for the rows it has.
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), tables)
    held = materialise(rows.mapInArrow(placed, "part int, key bigint, id string, v array<float>").repartition(n, F.col("part"), F.pmod(F.xxhash64("id"), F.lit(max(1, n // (tables * PARTS))))))
    parts = []
    for ids, q in _query_blocks(rows.where(asked), dim):
        sent = spark.sparkContext.broadcast((index, ids, q))  # at most QUERIES vectors

        def answer(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, ids, q = sent.value
            tops = Tops(ids, k)
            visits: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                part, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                names, x = np.array(batch.column(2).to_pylist(), dtype=object), batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                for t in np.unique(part // PARTS):
                    if t not in visits:
                        keys = index.probes(q, int(t))
                        order = np.argsort(keys.ravel(), kind="stable")
                        visits[t] = keys.ravel()[order], order // keys.shape[1]
                    keys, who = visits[t]
                    at = np.flatnonzero(part // PARTS == t)
                    low, high = np.searchsorted(keys, own[at], side="left"), np.searchsorted(keys, own[at], side="right")
                    edge = np.concatenate([[0], np.cumsum(high - low)])
                    for lo in range(0, int(edge[-1]), PAIRS):
                        # Pairs of rows and their visitors, by the running number of the pair.
                        pair = np.arange(lo, min(int(edge[-1]), lo + PAIRS))
                        row = np.searchsorted(edge, pair, side="right") - 1
                        asks = who[low[row] + pair - edge[row]]
                        cos = np.einsum("ij,ij->i", q[asks], x[at[row]])
                        tops.add(asks, cos.astype(np.float64), names[at[row]])
            asks, names = tops.merge()
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in asks.tolist()], pa.string()), pa.array(names.tolist(), pa.string())], names=["qid", "id"])

        parts.append(held.mapInArrow(answer, "qid string, id string"))
    if not parts:
        return spark.createDataFrame([], "qid string, id string, cosine double, rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1) for c in (2, 3))
            if batch.num_rows:
                c = (x * y).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c)], names=["qid", "id", "cosine"])

    full = found.distinct().join(rows.withColumnRenamed("v", "y"), "id").join(rows.where(asked).withColumnsRenamed({"id": "qid", "v": "x"}), "qid").select("qid", "id", "x", "y")
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("cosine", 9)), "id")
    return full.mapInArrow(exact, "qid string, id string, cosine double").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _query_blocks(rows: DataFrame, dim: int) -> Iterator[tuple[list[str], np.ndarray]]:
    ids, held = [], []
    for q, v in rows.select("id", "v").toLocalIterator():
        ids.append(q)
        held.append(v)
        if len(ids) == QUERIES:
            yield ids, np.array(held, dtype=np.float32)
            ids, held = [], []
    if ids:
        yield ids, np.array(held, dtype=np.float32)


class Tops:
    """The k best neighbours of each query so far, each once and none the query itself; what comes near the kth stays, as cosines are of single precision here."""

    def __init__(self, ids: list[str], k: int):
        self.ids, self.k = ids, k
        self.kth = np.full(len(ids), -2.0)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, asks: np.ndarray, cos: np.ndarray, names: np.ndarray) -> None:
        keep = cos >= self.kth[asks] - 1e-5
        self.held.append((asks[keep], cos[keep], names[keep]))
        self.size += int(keep.sum())
        if self.size > 200_000 + 4 * self.k * len(self.ids):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        """(query numbers, names) of what is held, cut."""
        if not self.held:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=object)
        asks, cos, names = (np.concatenate([h[i] for h in self.held]) for i in range(3))
        order = np.lexsort((-cos, asks))
        asks, cos, names = asks[order], cos[order], names[order]
        seen: set[tuple[int, str]] = set()
        good, count, last = [], 0, -1
        for i, (a, c, n) in enumerate(zip(asks.tolist(), cos.tolist(), names.tolist())):
            if a != last:
                last, count = a, 0
            if n == self.ids[a] or (count >= self.k and c < self.kth[a] - 1e-5) or (a, n) in seen:
                continue
            seen.add((a, n))
            good.append(i)
            count += 1
            if count == self.k:
                self.kth[a] = c
        self.held, self.size = [(asks[good], cos[good], names[good])], len(good)
        return asks[good], names[good]
