"""Pairs of the members of hash buckets, made in bounded pieces.

Rows (key, member, role[, payload]) are brought together by key, sorted by Spark,
and read bucket by bucket, so a task holds one bucket at a time. A bucket of more
than `TILE` rows is cut into tiles, and every two tiles are sent out again as work
of their own. Buckets so large that no task should hold them whole are known
beforehand: `hot_keys` counts the buckets of a 64th of the rows, and their rows go
straight to their tiles. The counts only plan the work; no pair depends on them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.tables import materialise

TILE = 2048
#: A bucket is hot if it holds one in HOT of all members, but more than HOT_TILE; so there are few of them, whatever the data.
HOT, HOT_TILE, SHARE = 10_000, 16_384, 64
#: Roles of rows: 0 pairs with 0 and 1, 1 only with 0. Two or four more for the lower and the higher of two tiles, which pair with each other only.
HOME, PROBE, LOWER, HIGHER = 0, 1, 2, 4

Pairing = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, "np.ndarray | None"], Iterator[list[np.ndarray]]]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers, as uint64."""
    z = x.astype(np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def may_pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows of roles x and y pair."""
    a, b = x >> 1, y >> 1
    return ((x & y & 1) == 0) & ((a + b == 0) | (a + b == 3))


def sampled(df: DataFrame, key: str) -> DataFrame:
    """A SHARE-th of the rows, by a hash of their key, for `hot_keys`."""
    return df.where(F.pmod(F.xxhash64(F.lit("hot"), key), F.lit(SHARE)) == 0)


def hot_keys(sample: DataFrame, members: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, tiles of each) of the hot buckets, by the rows (key) of a sample; at most HOT for each row that a member has."""
    least = max(members / HOT, HOT_TILE) / SHARE
    rows = sorted((r.key, max(2, -(-r["count"] * SHARE // HOT_TILE))) for r in sample.groupBy("key").count().where(F.col("count") >= least).collect())
    return np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64)


def to_tiles(key: np.ndarray, member: np.ndarray, role: np.ndarray, tiles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row number, key, role) of rows cut into so many tiles each: each row once for every other tile of its bucket, and once for its own."""
    at = np.repeat(np.arange(len(key)), tiles)
    other = np.arange(len(at)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
    n = tiles[at]
    own = (mix(member).astype(np.uint64)[at] % n.astype(np.uint64)).astype(np.int64)
    pair = np.minimum(own, other) * n + np.maximum(own, other)
    code = mix(mix(key)[at] + mix(pair + 1)).view(np.int64)
    return at, code, role[at] + np.where(own < other, LOWER, np.where(own > other, HIGHER, 0)).astype(role.dtype)


def spread_hot(key: np.ndarray, member: np.ndarray, role: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row number, key, role) of rows as they are to be shuffled: those of hot buckets as rows of tiles."""
    keys, tiles = hot
    if not len(keys):
        return np.arange(len(key)), key, role
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    is_hot = keys[at] == key
    cold, warm = np.flatnonzero(~is_hot), np.flatnonzero(is_hot)
    row, code, part = to_tiles(key[warm], member[warm], role[warm], tiles[at[warm]])
    return np.concatenate([cold, warm[row]]), np.concatenate([key[cold], code]), np.concatenate([role[cold], part])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(key, member, role, payload) of whole buckets from batches in order of key, member and role; each member once in a bucket."""

    def columns(parts: list[pa.RecordBatch]) -> tuple:
        t = pa.Table.from_batches(parts)
        key, member, role = (t.column(c).to_numpy() for c in ("key", "member", "role"))
        first = np.ones(len(key), dtype=bool)
        first[1:] = (key[1:] != key[:-1]) | (member[1:] != member[:-1])
        payload = None
        if "payload" in t.column_names:
            flat = t.column("payload").to_pylist()
            payload = np.frombuffer(b"".join(flat), dtype=np.int8).reshape(len(flat), -1)[first]
        return key[first], member[first], role[first], payload

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))  # where the last bucket begins
        if held and (cut or held[-1].column(0)[-1].as_py() != int(key[-1])):
            yield columns([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield columns([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield columns(held)


def bucket_pairs(rows: DataFrame, pairing: Pairing, schema: str, tile: int = TILE) -> DataFrame:
    """What `pairing` yields for all buckets of `rows` (key bigint, member bigint, role int[, payload binary]).

    `pairing(starts, ends, member, role, payload)` gets the ranges of some
    buckets and yields columns of `schema`. A pair comes once for each bucket
    that its members share. No rows give no pairs.
    """
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "float": pa.float32(), "binary": pa.binary()}
    extra = [("t_key", "bigint"), ("t_member", "bigint"), ("t_role", "int")] + [("t_payload", "binary")] * ("payload" in rows.columns)

    def batch(columns: list, before: int, all_fields: list) -> pa.RecordBatch:
        """`columns` at place `before`, nulls in the other fields."""
        n = len(columns[0])
        arrays = [pa.array(columns[i - before], kinds[kind]) if 0 <= i - before < len(columns) else pa.nulls(n, kinds[kind]) for i, (_, kind) in enumerate(all_fields)]
        return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in all_fields])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, member, role, payload in _buckets(batches):
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(starts[1:], len(key))
            big = ends - starts > tile
            for columns in pairing(starts[~big], ends[~big], member, role, payload):
                yield batch(columns, 0, fields + extra)
            for s, e in zip(starts[big], ends[big]):
                tiles = np.full(1, -(-int(e - s) // tile))
                for lo in range(s, e, max(1, 100_000 // int(tiles[0]))):
                    part = slice(lo, min(e, lo + max(1, 100_000 // int(tiles[0]))))
                    at, code, own = to_tiles(key[part], member[part], role[part], np.repeat(tiles, part.stop - part.start))
                    columns = [code, member[part][at], own]
                    yield batch(columns + ([[p.tobytes() for p in payload[part][at]]] if payload is not None else []), len(fields), fields + extra)

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, member, role, payload in _buckets(batches):
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            for columns in pairing(starts, np.append(starts[1:], len(key)), member, role, payload):
                yield batch(columns, 0, fields)

    def gathered(df: DataFrame) -> DataFrame:
        return df.repartition("key").sortWithinPartitions("key", "member", "role")

    first = materialise(gathered(rows).mapInArrow(whole, ", ".join(f"{n} {k}" for n, k in fields + extra)))
    parts = first.where("t_key IS NOT NULL").select(*(F.col(f"t_{c}").alias(c) for c in rows.columns))
    return first.where("t_key IS NULL").select(*(n for n, _ in fields)).unionByName(gathered(parts).mapInArrow(tiles, schema))


def near_signed(bits: int, least: int, most: int = 2_000_000) -> Pairing:
    """Pairing that yields [smaller member, greater member] of the pairs whose payloads, signatures of so many bits, agree in `least` or more; buckets of one size together."""

    def pairing(starts: np.ndarray, ends: np.ndarray, member: np.ndarray, role: np.ndarray, payload: np.ndarray) -> Iterator[list[np.ndarray]]:
        sign = np.ascontiguousarray(payload).view(np.uint64)
        sizes = ends - starts
        for m in np.unique(sizes[sizes > 1]):
            i, j = np.triu_indices(int(m), 1)
            own = starts[sizes == m]
            step = max(1, most // len(i))
            for k in range(0, len(own), step):
                x, y = (own[k : k + step, None] + i).ravel(), (own[k : k + step, None] + j).ravel()
                differ = sum(np.bitwise_count(sign[x, c] ^ sign[y, c]).astype(np.int32) for c in range(sign.shape[1]))
                keep = may_pair(role[x], role[y]) & (bits - differ >= least)
                x, y = x[keep], y[keep]
                if len(x):
                    yield [np.minimum(member[x], member[y]), np.maximum(member[x], member[y])]

    return pairing
