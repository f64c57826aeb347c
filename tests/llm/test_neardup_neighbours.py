import random

import numpy as np
from pyspark.sql import functions as F

from quern.llm import buckets, neardup, neighbours, probing


def jaccard(a, b):
    w = lambda s: neardup.WORD.findall(s.lower())
    g = lambda s: {tuple(s[i : i + 3]) for i in range(len(s) - 2)}
    x, y = g(w(a)), g(w(b))
    return len(x & y) / len(x | y)


def texts(n=60, seed=2):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(300)]
    out = []
    for i in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(14, 60))]
        out.append((f"{i:03}a", " ".join(base)))
        for c in "bcd"[: rng.randint(0, 3)]:
            ws = list(base)
            for _ in range(rng.randint(0, 4)):
                ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
            out.append((f"{i:03}{c}", (" ".join(ws)).upper() if rng.random() < 0.3 else " ".join(ws)))
    return out


def test_pairs_against_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(k, t, 1) for k, t in rows] + [("n", None, 1), ("e", "", 1), ("s", "too short", 1), (rows[0][0], "an older text " * 20, 0), (None, rows[0][1], 1)], "id string, t string, v int").withColumn("v", F.timestamp_seconds("v")).withColumn("digest", F.lit("clash")).repartition(4)
    got = {(r.id_a, r.id_b): r.similarity for r in neardup.similar_pairs(df, "id", "t", "v").collect()}
    want = {(a, b): jaccard(x, y) for a, x in rows for b, y in rows if a < b and jaccard(x, y) >= 0.5}
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want)
    assert all(abs(want[p] - s) < 1e-9 for p, s in got.items())
    assert neardup.similar_pairs(df.where("false"), "id", "t", "v").count() == 0


def test_hot_copies_are_one_class(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(f"c{i:03}", text) for i in range(300)] + [("x", text.replace("w39", "zz"))]
    df = spark.createDataFrame(rows, "id string, t string").withColumn("v", F.timestamp_seconds(F.lit(1)))
    got = neardup.similar_groups(df, "id", "t", "v").collect()
    assert len(got) == 301 and {r.class_id for r in got} == {"c000", "x"} and {r.n_links for r in got} == {1} and {r.group_id for r in got} == {"c000"}
    pairs = neardup.similar_pairs(df, "id", "t", "v")
    assert pairs.count() == pairs.distinct().count() == 301 * 300 // 2


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a, b = neardup._functions(neardup.PACKED)
    x = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
    y = np.unique(np.concatenate([x[:200], rng.integers(0, 2**63, 200, dtype=np.uint64)]))
    low = neardup.minima([x, y], a, b)
    p = [np.frombuffer(s, dtype=np.uint8)[None, :] for s in neardup.packed(low)]
    assert abs(neardup.estimate(*p)[0] - 1 / 3) < 0.2 and neardup.estimate(p[0], p[0])[0] == 1.0


def every_pair():
    def pairing(starts, ends, member, role, payload=None):
        for s, e in zip(starts, ends):
            for i in range(s, e):
                j = np.arange(i + 1, e)
                j = j[buckets.may_pair(role[i], role[j])]
                if len(j):
                    yield [np.minimum(member[i], member[j]), np.maximum(member[i], member[j])]

    return pairing


def test_big_buckets_are_tiled_without_loss(spark):
    rows = [(1, m, 0) for m in range(100)] + [(2, m, 0) for m in range(3)] + [(1, 5, 0), (3, 9, 0)]
    df = spark.createDataFrame(rows, "key bigint, member bigint, role int")
    got = {(r.a, r.b) for r in buckets.bucket_pairs(df, every_pair(), "a bigint, b bigint", tile=16).collect()}
    assert got == {(a, b) for b in range(100) for a in range(b)}


def test_hot_buckets_go_straight_to_their_tiles(spark):
    key = np.array([1] * 90 + [2] * 5, dtype=np.int64)
    member, role = np.arange(95), np.zeros(95, dtype=np.int32)
    at, code, part = buckets.spread_hot(key, member, role, (np.array([1]), np.array([6])))
    rows = list(zip(code.tolist(), member[at].tolist(), part.tolist()))
    assert max(np.unique(code, return_counts=True)[1]) < 50
    got = [(r.a, r.b) for r in buckets.bucket_pairs(spark.createDataFrame(rows, "key bigint, member bigint, role int"), every_pair(), "a bigint, b bigint").collect()]
    want = {(a, b) for b in range(90) for a in range(b)} | {(a, b) for b in range(90, 95) for a in range(90, b)}
    assert set(got) == want and len(got) == len(want)


def test_hot_keys_are_counted_in_a_sample(spark, monkeypatch):
    monkeypatch.setattr(buckets, "HOT_TILE", 640)
    df = spark.createDataFrame([(7,)] * 30 + [(8,)] * 3, "key bigint")
    keys, tiles = buckets.hot_keys(df, 3000)
    assert keys.tolist() == [7] and tiles.tolist() == [3]
    assert len(buckets.hot_keys(df.where("false"), 0)[0]) == 0


def clusters(n=400, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    near = base[: n // 4] + 0.08 * rng.standard_normal((n // 4, dim))
    return np.concatenate([base, near, base[:5], base[:3] * 2]).astype(np.float32)


def test_near_pairs_against_brute_force(spark):
    v = clusters()
    ids = [f"{i:05}" for i in range(len(v))]
    rows = [(i, [float(x) for x in r]) for i, r in zip(ids, v)] + [("zero", [0.0] * 16), ("null", None), ("dim", [1.0, 2.0]), (None, [1.0] * 16), ("nan", [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "id string, v array<float>").withColumn("t", F.timestamp_seconds(F.lit(1))).withColumn("mark", F.lit("clash")).repartition(4)
    got = {(r.id_a, r.id_b) for r in neighbours.near_pairs(df, "id", "v", "t").collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    c = u @ u.T
    np.fill_diagonal(c, -1)
    want = {tuple(sorted((ids[i], ids[j]))) for i in range(len(v)) for j in sorted(range(len(v)), key=lambda j: (-round(float(c[i, j]), 5), j))[:5] if c[i, j] >= 0.9}
    assert got <= want and len(got) >= 0.97 * len(want)
    assert neighbours.near_pairs(df.where("false"), "id", "v", "t").count() == 0


def test_recall_of_far_neighbours(spark):
    v = np.random.default_rng(5).standard_normal((600, 24)).astype(np.float32)
    df = spark.createDataFrame([(f"{i:04}", [float(x) for x in r]) for i, r in enumerate(v)], "id string, v array<float>").withColumn("t", F.timestamp_seconds(F.lit(1)))
    got = {}
    for r in neighbours.nearest(df, "id", "v", "t", target_cosine=0.45, recall=0.95, probes=6, bucket=1024, tables=16, bits=8).collect():
        got.setdefault(int(r.id), set()).add(int(r.neighbour))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    c = u @ u.T
    np.fill_diagonal(c, -1)
    hit = sum(len(got.get(i, set()) & set(np.argsort(-c[i])[:5].tolist())) for i in range(600))
    assert hit / 3000 >= 0.9 and all(len(x) == 5 for x in got.values())


def test_hot_vector_has_five_neighbours_each(spark):
    df = spark.createDataFrame([(f"{i:04}", [1.0, 2.0, 3.0]) for i in range(500)], "id string, v array<float>").withColumn("t", F.timestamp_seconds(F.lit(1)))
    got = neighbours.nearest(df, "id", "v", "t", least_cosine=0.9).collect()
    assert len(got) == 2500 and {r.neighbour for r in got} == {f"{i:04}" for i in range(6)}


def test_dense_group_of_distinct_vectors(spark):
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.standard_normal((1, 48)) + 0.2 * rng.standard_normal((2000, 48)), rng.standard_normal((300, 48))]).astype(np.float32)
    df = spark.createDataFrame([(f"{i:04}", [float(x) for x in r]) for i, r in enumerate(v)], "id string, v array<float>").withColumn("t", F.timestamp_seconds(F.lit(1))).repartition(4)
    got = {}
    for r in neighbours.nearest(df, "id", "v", "t", least_cosine=0.9).collect():
        got.setdefault(int(r.id), {})[int(r.neighbour)] = r.cosine
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    c = u @ u.T
    np.fill_diagonal(c, -1)
    want = {(i, j) for i in range(len(v)) for j in np.argsort(-c[i])[:5].tolist() if c[i, j] >= 0.9}
    have = {(i, j) for i, x in got.items() for j in x}
    assert len(want) >= 10_000 and len(want & have) >= 0.99 * len(want)
    assert all(len(x) <= 5 and all(abs(c[i, j] - s) < 1e-6 for j, s in x.items()) for i, x in got.items())


def test_crowded_tiles_rank_exactly(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE", 64)
    v = (np.ones(16) + 0.2 * np.random.default_rng(3).standard_normal((300, 16))).astype(np.float32)
    df = spark.createDataFrame([(f"{i:04}", [float(x) for x in r]) for i, r in enumerate(v)], "id string, v array<float>").withColumn("t", F.timestamp_seconds(F.lit(1)))
    got = {(int(r.id), int(r.neighbour)) for r in neighbours.nearest(df, "id", "v", "t", least_cosine=0.9).collect()}
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    c = u @ u.T
    np.fill_diagonal(c, -1)
    want = {(i, j) for i in range(300) for j in np.argsort(-c[i])[:5].tolist() if c[i, j] >= 0.9}
    assert len(want) > 1000 and len(want & got) >= 0.99 * len(want)


def test_step_sets_come_in_order_and_exclude_each_other():
    sets = probing.step_sets(4, 40)
    assert sets[0] == (0,) and len(set(sets)) == len(sets) and all(0 not in s or 7 not in s for s in sets)
    x = np.random.default_rng(2).standard_normal((5, 8)).astype(np.float32)
    i = probing.Index(8, 4, 2, 20)
    keys = i.probes(x, 1)
    assert (keys[:, 0] == i.keys(x, 1)).all() and all(len(set(k)) == len(k) for k in keys.tolist())


def test_far_neighbours_of_a_query_set(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((1500, 32)).astype(np.float32)
    v[700:720] = v[0]
    rows = [(f"{i:04}", [float(x) for x in r], 1) for i, r in enumerate(v)] + [("zero", [0.0] * 32, 1), ("null", None, 1), ("0005", [9.0] * 32, 0), (None, [1.0] * 32, 1), ("dim", [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "id string, v array<float>, t int").withColumn("t", F.timestamp_seconds("t")).withColumn("key", F.lit("clash")).repartition(4)
    asked = F.substring("id", 4, 1).isin("0", "5") & (F.length("id") == 4)
    got = {}
    for r in probing.search(df, "id", "v", asked, "t", cosine=0.5).collect():
        got.setdefault(int(r.qid), {})[int(r.id)] = (r.cosine, r["rank"])
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    c = u @ u.T
    np.fill_diagonal(c, -1)
    asks = [i for i in range(1500) if i % 5 == 0]
    want = {i: sorted(range(1500), key=lambda j: (-round(c[i, j], 9), j))[:5] for i in asks}
    hit = sum(len(set(want[i]) & set(got[i])) for i in asks)
    assert set(got) == set(asks) and hit >= 0.9 * 5 * len(asks)
    assert all(len(x) == 5 and sorted(r for _, r in x.values()) == [1, 2, 3, 4, 5] and all(abs(c[i, j] - s) < 1e-6 for j, (s, _) in x.items()) for i, x in got.items())
    assert sorted(got[0]) == [700, 701, 702, 703, 704]
    assert probing.search(df.where("false"), "id", "v", asked, "t").count() == probing.search(df, "id", "v", F.lit(False), "t").count() == 0


def test_only_rows_that_pair_are_compared(monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((800, 32)).astype(np.float32)
    v[400:500] = v[:100] + 0.05 * rng.standard_normal((100, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    role = rng.choice([0, 1, 1, 1], 800).astype(np.int32)
    starts, ends = np.array([0, 40, 60]), np.array([40, 60, 800])
    cells, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: (cells.append(x.size), count(x))[1])
    out = list(neighbours._near(0.9, 20, 1)(starts, ends, np.arange(800), role, neighbours.payload_of(v, 1)))
    got = {(int(a), int(b)) for part in out for a, b in zip(part[0], part[1])}
    bits = np.unpackbits(neighbours.payload_of(v, 1).view(np.uint8), axis=1).astype(int)
    differ = (bits[:, None] != bits[None]).sum(2)
    pair = buckets.may_pair(role[:, None], role[None]) & np.triu(np.ones((800, 800), dtype=bool), 1)
    pair &= np.searchsorted(ends, np.arange(800), "right")[:, None] == np.searchsorted(ends, np.arange(800), "right")
    may = np.cos(np.pi * differ / neighbours.SKETCH) >= np.cos(np.pi * 44 / neighbours.SKETCH) - 1e-6
    assert got == set(zip(*(x.tolist() for x in np.nonzero(pair & may)))) and len(got) > 15
    assert sum(cells) <= 1.3 * (neighbours.SKETCH // 64) * pair.sum()


def test_many_pairs_of_a_bucket_come_as_few_ones(monkeypatch):
    v = (np.ones(16) + 0.2 * np.random.default_rng(3).standard_normal((300, 16))).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    role = np.random.default_rng(1).choice([0, 1, 2, 3, 4, 5], 300).astype(np.int32)
    got = []
    for most in (1_000_000, 50):
        monkeypatch.setattr(neighbours, "DENSE", most)
        out = neighbours._near(0.9, 20, 1)(np.array([0]), np.array([300]), np.arange(300), role, neighbours.payload_of(v, 1))
        got.append({tuple(int(c) for c in r) for part in out for r in zip(*part)})
    assert got[0] == got[1] and any(r[2] >= 0 for r in got[0])


def test_tables_follow_the_different_vectors(spark, monkeypatch):
    asked, plan = [], neighbours.Plan
    monkeypatch.setattr(neighbours, "Plan", lambda n, *rest: (asked.append(n), plan(n, *rest))[1])
    v = np.random.default_rng(2).standard_normal((20, 8))
    v[10:] = v[:10] + 0.01
    df = spark.createDataFrame([(f"{i:03}", [float(x) for x in v[i % 20]]) for i in range(100)], "id string, v array<float>").withColumn("t", F.timestamp_seconds(F.lit(1))).repartition(4)
    got = {(int(r.id_a), int(r.id_b)) for r in neighbours.near_pairs(df, "id", "v", "t", k=9).collect()}
    want = {(a, b) for b in range(100) for a in range(b) if a % 10 == b % 10}
    assert asked == [20] and got == want
