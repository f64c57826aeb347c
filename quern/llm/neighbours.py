"""The k most similar vectors of every vector (problem 7).

Method: multi-probe p-stable hashing. In each table a unit vector v has M hash
values floor((a.v + b) / w) with Gaussian a; the bucket is the tuple of them. Near
vectors that miss each other's bucket mostly do so by one step in the
coordinates that lie next to a cell border, so each vector is also sent to the
buckets of the likeliest such steps, in the order of the estimated success.
Members of a bucket are compared in blocks by sketches or 8-bit vectors, which
are all that is shuffled of sparse buckets. An estimate only tells whether a pair
may reach the bound; it never ranks. Where a member has more such partners than
are worth a row each, it and they are sent on with their full vectors, and its k
nearest in the bucket are found by exact cosines. The merged candidates of all
tables are reranked by their exact distance.

M grows with the logarithm of the number of vectors, so that buckets keep their
size. As long as the least number of tables reaches the recall wanted at the target
cosine with buckets of up to `MOST_BUCKET` unrelated vectors, there are no more;
beyond that the tables grow in number, not the buckets. Buckets that hold more
because vectors are alike are cut into tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.buckets import HOME, PROBE, bucket_pairs, hot_keys, may_pair, mix, sampled, spread_hot
from quern.tables import materialise

K = 5
WIDTH = 3.0
PROBES = 3
#: Expected members of a bucket for unrelated vectors, if that reaches the recall with TABLES, and the most before tables are added.
BUCKET, MOST_BUCKET = 128, 1024
#: Rows of a bucket beyond which it is cut into tiles.
TILE = 8192
#: Least number of hash tables, and the recall of the candidate search at the target cosine.
TABLES, RECALL = 8, 0.99
#: Partners of a member in a bucket, in units of k, beyond which they are ranked there by full vectors instead of being sent on as pairs.
CROWD = 4
#: Bits of a sketch: the signs of a vector's projections on random directions.
SKETCH = 192
#: Standard deviations by which a sketch may overstate an angle (3.5: it loses one pair in 4,000), and the most a cosine of 8-bit vectors is off.
SIGMAS, SLACK = 3.5, 0.03
#: Cells of a bucket compared at once, so that they stay in the cache; the size of buckets that are compared many at once; the pairs of a bucket that are held as a list.
CELLS, SMALL, DENSE = 65_536, 64, 1_000_000
SEED = 7


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that one p-stable hash value of two vectors at this distance agrees."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


class Plan:
    """Number of hash values and tables, and the projections, for n vectors of a dimension."""

    def __init__(self, n: int, dim: int, least_cosine: float, recall: float = RECALL, probes: int = PROBES, bucket: int = BUCKET, tables: int = TABLES):
        far = -math.log(collision(math.sqrt(2.0)))
        self.dim, self.probes = dim, probes
        length = lambda size: max(1, math.ceil(math.log(max(2.0, n / size)) / far))
        least = length(max(bucket, MOST_BUCKET))
        for m in range(length(bucket), least - 1, -1):
            self._draw(m, tables)
            if self.recall(least_cosine) >= recall:
                return
        while self.recall(least_cosine) < recall:
            tables += max(1, tables // 4)
            self._draw(least, tables)

    def _draw(self, m: int, tables: int) -> None:
        rng = np.random.default_rng(SEED)
        self.m, self.tables = m, tables
        self.a = rng.standard_normal((tables, m, self.dim)).astype(np.float32)
        self.b = rng.uniform(0, WIDTH, (tables, m)).astype(np.float32)
        self.salt = mix(np.arange(1, tables * m + 1, dtype=np.uint64)).reshape(tables, m)

    def recall(self, cosine: float, pairs: int = 1024) -> float:
        """Measured share of random pairs at a cosine that meet in a bucket."""
        rng = np.random.default_rng(SEED + 1)
        x = rng.standard_normal((pairs, self.dim)).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z = rng.standard_normal((pairs, self.dim)).astype(np.float32)
        z -= (z * x).sum(1, keepdims=True) * x
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        y = np.float32(cosine) * x + np.float32(math.sqrt(max(0.0, 1 - cosine * cosine))) * z
        hit = np.zeros(pairs, dtype=bool)
        for t in range(self.tables):
            p, q = self.keys(x, t), self.keys(y, t)
            hit |= (p == q[:, :1]).any(1) | (q == p[:, :1]).any(1)
        return float(hit.mean())

    def keys(self, x: np.ndarray, table: int) -> np.ndarray:
        """uint64 (vector x 1 + probes): the home bucket, then the likeliest neighbours by one step in one or two coordinates."""
        f = (x @ self.a[table].T + self.b[table]) / np.float32(WIDTH)
        cell = np.floor(f).astype(np.int64)
        low = f - cell
        score = np.concatenate([low**2, (1 - low) ** 2], axis=1)  # the smaller, the likelier that a near vector lies there
        terms = mix(cell.astype(np.uint64) + self.salt[table])
        home = terms.sum(axis=1, dtype=np.uint64)
        n, m = len(x), self.m
        order = np.argsort(score, axis=1)[:, : self.probes + 1]
        best = np.take_along_axis(score, order, axis=1)
        moved = np.where(order < m, -1, 1)
        at = order % m
        rows = np.arange(n)[:, None]
        change = mix((cell[rows, at] + moved).astype(np.uint64) + self.salt[table][at]) - terms[rows, at]
        sets, cost = [change[:, i] for i in range(order.shape[1])], [best[:, i] for i in range(order.shape[1])]
        if order.shape[1] > 1:  # both of the two nearest borders at once, unless they are borders of one cell
            sets.append(change[:, 0] + change[:, 1])
            cost.append(np.where(at[:, 0] == at[:, 1], np.inf, best[:, 0] + best[:, 1]))
        pick = np.argsort(np.stack(cost, 1), axis=1, kind="stable")[:, : self.probes]
        return np.concatenate([home[:, None], home[:, None] + np.take_along_axis(np.stack(sets, 1), pick, axis=1)], axis=1)


def _unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit vectors) of the vectors of this dimension that are finite and not zero."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(np.nan_to_num(lengths, nan=-1) == dim)
    values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
    norm = np.linalg.norm(values.astype(np.float64), axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return rows[good], (values[good] / norm[good, None]).astype(np.float32)


def _marks(unit: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(v.tobytes()) for v in unit], dtype=np.uint64).view(np.int64)


def classes(df: DataFrame, key: str, vector: str, dim: int, newest: tuple[str, ...]) -> DataFrame:
    """(id, mark): latest delivery of each record with a usable vector; equal unit vectors have one mark. Materialised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.zeros(batch.num_rows, dtype=np.int64)
            none = np.ones(batch.num_rows, dtype=bool)
            rows, unit = _unit(batch.column(1), dim)
            marks[rows], none[rows] = _marks(unit), False
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(marks, mask=none)], names=["id", "at", "mark"])

    source = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("v"), F.concat_ws(" ", *(F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in newest)).alias("at"))
    last = source.mapInArrow(run, "id string, at string, mark bigint").groupBy("id").agg(F.max(F.struct("at", "mark")).alias("v"))
    return materialise(last.where("v.mark IS NOT NULL").select("id", "v.mark"))


def payload_of(unit: np.ndarray, bits: int) -> np.ndarray:
    """Rows of bytes to compare vectors by: with 1 bit their sketches, with 8 their components scaled by the largest."""
    if bits == 1:
        a = np.random.default_rng(SEED + 2).standard_normal((unit.shape[1], SKETCH)).astype(np.float32)
        return np.packbits(unit @ a > 0, axis=1).view(np.int8)
    return np.rint(unit / np.abs(unit).max(axis=1, keepdims=True) * 127).astype(np.int8)


class Compare:
    """Which pairs of payload rows may have a given cosine, by their estimated one."""

    def __init__(self, bits: int, least: float):
        self.bits = bits
        if bits == 1:
            p = math.acos(max(-1.0, min(1.0, least))) / math.pi
            floor = math.cos(math.pi * min(1.0, p + SIGMAS * math.sqrt(p * (1 - p) / SKETCH)))
            cosine = np.cos(np.pi * np.arange(SKETCH + 1) / SKETCH).astype(np.float32)
            self.most = np.flatnonzero(cosine >= floor).max()  # bits that may differ
        else:
            self.least = least - SLACK

    def ready(self, rows: np.ndarray) -> np.ndarray:
        if self.bits == 1:
            return np.ascontiguousarray(rows).view(np.uint64)
        v = rows.astype(np.float32)
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def may(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in x and y of the pairs of a row of each that may be near."""
        if self.bits == 1:
            words = zip(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T))
            near = sum(np.bitwise_count(p[:, None] ^ q) for p, q in words) <= self.most  # at most SKETCH, so bytes hold it
        else:
            near = x @ y.T >= self.least
        return np.divmod(np.flatnonzero(near), len(y))

    def may_each(self, v: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether rows x and y of v may be near, pair by pair."""
        if self.bits == 1:
            return sum(np.bitwise_count(v[x, k] ^ v[y, k]) for k in range(v.shape[1])) <= self.most
        return np.einsum("ij,ij->i", v[x], v[y]) >= self.least


def _small_partners(compare: Compare, starts: np.ndarray, sizes: np.ndarray, v: np.ndarray, role: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (x, y) of the pairs that may be near, of many small buckets at once, each bucket in one piece."""
    for m in np.unique(sizes[sizes > 1]):
        i, j = np.triu_indices(int(m), 1)
        own = starts[sizes == m]
        step = max(1, 4 * CELLS // len(i))
        for k in range(0, len(own), step):
            x, y = (own[k : k + step, None] + i).ravel(), (own[k : k + step, None] + j).ravel()
            pair = may_pair(role[x], role[y])
            x, y = x[pair], y[pair]
            near = compare.may_each(v, x, y)
            yield x[near], y[near]


def _large_partners(compare: Compare, v: np.ndarray, role: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """As before, of one bucket; None if there are more than `most`.

    Rows are taken by role, and only roles that pair are compared: home rows with each other and with the probing ones,
    the lower of two tiles with the higher.
    """
    places = {r: np.flatnonzero(role == r) for r in np.unique(role).tolist()}
    xs, ys, size = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], 0
    for r, own in places.items():
        for o in [o for o in places if o >= r and may_pair(np.int64(r), np.int64(o))]:
            mine, at, his = v[own], places[o], v[places[o]]
            step = max(1, CELLS // len(at))
            for lo in range(0, len(own), step):
                first = lo if o == r else 0  # of one role only the pairs above the diagonal
                x, y = compare.may(mine[lo : lo + step], his[first:])
                if o == r:
                    x, y = x[y > x], y[y > x]
                size += len(x)
                if size > most:
                    return None
                xs.append(own[lo + x])
                ys.append(at[first + y])
    return np.concatenate(xs), np.concatenate(ys)


def _near(least: float, crowd: int, bits: int):
    """Pairing that yields (a, b, -1) for the pairs that may reach `least` of members with at most `crowd` such partners.

    The other members and their partners come as (block, member, role), to be
    compared exactly. The block is known by what it holds, so that equal ones of
    several tables are one.
    """
    compare = Compare(bits, least)

    def listed(x: np.ndarray, y: np.ndarray, member: np.ndarray) -> list[np.ndarray]:
        p, q = member[x], member[y]
        return [np.minimum(p, q), np.maximum(p, q), np.full(len(x), -1, dtype=np.int32)]

    def block(sent: np.ndarray, member: np.ndarray, role: np.ndarray) -> list[np.ndarray]:
        p, q = member[sent], role[sent]
        name = np.array([xxhash.xxh64_intdigest(p.tobytes() + q.tobytes())], dtype=np.uint64).view(np.int64)
        return [np.full(len(p), name[0]), p, q]

    def settled(x: np.ndarray, y: np.ndarray, starts: np.ndarray, member: np.ndarray, role: np.ndarray) -> Iterator[list[np.ndarray]]:
        """What to send on of whole buckets that have the pairs (x, y)."""
        many = np.bincount(x, minlength=len(member)) + np.bincount(y, minlength=len(member)) > crowd
        if many.any():
            p, q = many[x], many[y]
            sent = many.copy()
            sent[y[p]], sent[x[q]] = True, True
            at = np.flatnonzero(sent)
            for one in np.split(at, np.flatnonzero(np.diff(np.searchsorted(starts, at, "right"))) + 1):
                yield block(one, member, role)
            x, y = x[~(p & q)], y[~(p & q)]
        if len(x):
            yield listed(x, y, member)

    def dense(v: np.ndarray, member: np.ndarray, role: np.ndarray) -> Iterator[list[np.ndarray]]:
        """The same of one bucket of too many pairs to hold, row by row."""
        n = len(v)
        sent = np.zeros(n, dtype=bool)
        for lo in range(0, n, 512):
            hi = min(lo + 512, n)
            may = np.zeros((hi - lo, n), dtype=bool)
            may[compare.may(v[lo:hi], v)] = True
            may &= may_pair(role[lo:hi, None], role[None, :])
            may[np.arange(hi - lo), np.arange(lo, hi)] = False
            crowded = may.sum(axis=1) > crowd
            if crowded.any():
                sent[lo:hi] |= crowded
                sent |= may[crowded].any(axis=0)
                may[crowded] = False
            x, y = np.nonzero(may)
            if len(x):
                yield listed(lo + x, y, member)
        if sent.any():
            yield block(np.flatnonzero(sent), member, role)

    def parts(starts: np.ndarray, ends: np.ndarray, member: np.ndarray, role: np.ndarray, payload: np.ndarray) -> Iterator[list[np.ndarray]]:
        v, sizes = compare.ready(payload), ends - starts
        small = sizes <= SMALL
        for x, y in _small_partners(compare, starts[small], sizes[small], v, role):
            yield from settled(x, y, starts, member, role)
        for s, e in zip(starts[~small].tolist(), ends[~small].tolist()):
            one = member[s:e], role[s:e]
            found = _large_partners(compare, v[s:e], one[1], DENSE)
            yield from dense(v[s:e], *one) if found is None else settled(*found, np.zeros(1, dtype=np.int64), *one)

    def pairing(*bucket: np.ndarray) -> Iterator[list[np.ndarray]]:
        out: list[list[np.ndarray]] = []
        size = 0
        for columns in parts(*bucket):
            out.append(columns)
            size += len(columns[0])
            if size > 500_000:
                yield [np.concatenate(z) for z in zip(*out)]
                out, size = [], 0
        if out:
            yield [np.concatenate(z) for z in zip(*out)]

    return pairing


def _block_nearest(k: int, least: float):
    """Of each member of a block (block, mark, role, v) its k nearest by exact cosine, at `least` or more, as (a, b); ties by mark."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("mark")
        mark, role = block.column("mark").to_numpy(), block.column("role").to_numpy()
        n = len(mark)
        v = block.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        out = [np.zeros((2, 0), dtype=np.int64)]
        for lo in range(0, n, 128):
            hi = min(lo + 128, n)
            c = v[lo:hi] @ v.T
            c[~may_pair(role[lo:hi, None], role[None, :])] = -2
            c[np.arange(hi - lo), np.arange(lo, hi)] = -2
            keep = (c > -2) & (c >= least - 1e-9)
            if k < n:
                kth = -np.partition(-c, k - 1, axis=1)[:, k - 1 : k]
                above, level = c > kth, c == kth
                keep &= above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)))
            x, y = np.nonzero(keep)
            p, q = mark[lo + x], mark[y]
            out.append(np.stack([np.minimum(p, q), np.maximum(p, q)]))
        a, b = np.unique(np.concatenate(out, axis=1), axis=1)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def similar_classes(df: DataFrame, key: str, vector: str, dim: int, members: DataFrame, plan: Plan, k: int, least_cosine: float, bits: int, copied: bool = False) -> DataFrame:
    """(a, b, cosine) of different marks, a < b: bucket candidates with their exact cosine, at least `least_cosine`.

    Copies within a task are hashed once; if most vectors are copies (`copied`), one record of each class is.
    """
    first = members.groupBy("mark").agg(F.min("id").alias("id"))
    source = df.select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("v"))

    def hashed(hot: tuple[np.ndarray, np.ndarray] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in batches:
                _, unit = _unit(batch.column(0), dim)
                if not len(unit):
                    continue
                marks = _marks(unit)
                new = np.array([i for i, m in enumerate(marks.tolist()) if not (m in seen or seen.add(m))], dtype=np.int64)
                if len(seen) > 2_000_000:
                    seen.clear()
                if not len(new):
                    continue
                unit, marks = unit[new], marks[new]
                blob = pa.array([r.tobytes() for r in payload_of(unit, bits)], pa.binary())
                for t in range(plan.tables):
                    keys = plan.keys(unit, t).view(np.int64)
                    for p in range(keys.shape[1]):
                        role, at, own = np.full(len(marks), HOME if p == 0 else PROBE, dtype=np.int32), np.arange(len(marks)), keys[:, p]
                        if hot is not None:
                            at, own, role = spread_hot(own, marks, role, hot)
                        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(marks[at]), pa.array(role), blob.take(pa.array(at))], names=["key", "member", "role", "payload"])

        return run

    made = "key bigint, member bigint, role int, payload binary"
    each = materialise(source.join(first.select("id"), "id", "left_semi")) if copied else source
    hot = hot_keys(sampled(each, "id").select("v").mapInArrow(hashed(None), made).select("key"), members.count())
    rows = each.select("v").mapInArrow(hashed(hot), made)
    found = materialise(bucket_pairs(rows, _near(least_cosine, CROWD * k, bits), "a bigint, b bigint, role int", TILE).distinct())
    pairs, crowds = found.where("role < 0").select("a", "b"), found.where("role >= 0").select(F.col("a").alias("block"), F.col("b").alias("mark"), "role")
    wanted = pairs.select(F.col("a").alias("mark")).union(pairs.select("b")).union(crowds.select("mark")).distinct().join(first, "mark")
    vectors = source.join(wanted, "id").select("mark", "v").dropDuplicates(["mark"])
    if crowds.take(1):
        vectors = materialise(vectors)
        pairs = materialise(pairs.union(crowds.join(vectors, "mark").select("block", "mark", "role", "v").groupBy("block").applyInArrow(_block_nearest(k, least_cosine), "a bigint, b bigint")).distinct())

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1) for c in (2, 3))
                c = (x * y).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
                keep = pa.array(c >= least_cosine)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(c).filter(keep)], names=["a", "b", "cosine"])

    full = pairs.join(vectors.withColumnsRenamed({"mark": "a", "v": "x"}), "a").join(vectors.withColumnsRenamed({"mark": "b", "v": "y"}), "b").select("a", "b", "x", "y")
    return full.mapInArrow(exact, "a bigint, b bigint, cosine double")


def nearest(df: DataFrame, key: str, vector: str, *newest: str, k: int = K, least_cosine: float = -1.0, target_cosine: float | None = None, recall: float = RECALL, probes: int = PROBES, bucket: int = BUCKET, tables: int = TABLES, bits: int = 1) -> DataFrame:
    """(id, neighbour, cosine, rank): the k most similar other vectors of every vector, ties by id.

    Null, zero and non-finite vectors are no records; vectors of different
    lengths are never neighbours and are searched by length. Records with equal
    vectors are one class: it is searched once, and each member's neighbours are
    the first ids of its own class, then those of the nearest classes. Of several
    deliveries the latest counts.
    """
    dims = [r.d for r in df.select(F.size(vector).alias("d")).where("d > 0").distinct().collect()]  # a handful
    parts = []
    for dim in sorted(dims):
        members = classes(df, key, vector, dim, newest)
        n, different = members.agg(F.count("*"), F.count_distinct("mark")).first()
        plan = Plan(different, dim, target_cosine if target_cosine is not None else max(least_cosine, 0.5), recall, probes, bucket, tables)
        pairs = materialise(similar_classes(df, key, vector, dim, members, plan, k, least_cosine, bits, copied=2 * different <= n))
        # Most classes are single vectors without neighbours; only the others go on.
        copied = members.groupBy("mark").count().where("count > 1").select("mark")
        members = materialise(members.join(pairs.select(F.col("a").alias("mark")).unionAll(pairs.select("b")).unionAll(copied).distinct(), "mark", "left_semi"))
        # The first k + 1 ids of a class are enough for the neighbours of any vector.
        w = Window.partitionBy("mark").orderBy("id")
        heads = members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).select("mark", F.col("id").alias("neighbour"))
        both = pairs.select(F.col("a").alias("mark"), F.col("b").alias("other"), "cosine").unionAll(pairs.select(F.col("b").alias("mark"), F.col("a").alias("other"), "cosine"))
        near = Window.partitionBy("mark").orderBy(F.desc("cosine"), "other")
        both = both.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k).drop("r")
        across = both.join(heads.withColumnRenamed("mark", "other"), "other").select("mark", "neighbour", "cosine")
        own = heads.join(heads.groupBy("mark").count().where("count > 1").select("mark"), "mark", "left_semi").select("mark", "neighbour", F.lit(1.0).alias("cosine"))
        top = Window.partitionBy("mark").orderBy(F.desc("cosine"), "neighbour")
        lists = across.unionByName(own).withColumn("r", F.row_number().over(top)).where(F.col("r") <= 2 * k + 1).drop("r")
        mine = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
        parts.append(members.join(lists, "mark").where(F.col("id") != F.col("neighbour")).select("id", "neighbour", "cosine", F.row_number().over(mine).alias("rank")).where(F.col("rank") <= k))
    if not parts:
        return df.sparkSession.createDataFrame([], "id string, neighbour string, cosine double, rank int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def near_pairs(df: DataFrame, key: str, vector: str, *newest: str, k: int = K, least_cosine: float = 0.9) -> DataFrame:
    """(id_a, id_b), id_a < id_b: records of which one is among the k most similar of the other, at `least_cosine` or more."""
    near = nearest(df, key, vector, *newest, k=k, least_cosine=least_cosine)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
