import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import leaks

DOCS = "doc_id bigint, text string, item_id string"
ITEMS = "item_id bigint, text string"


def brute(docs, items, run=13):
    out = {}
    for i, s in items:
        ws = leaks.words(s or "")
        grams = {tuple(ws[k : k + run]) for k in range(len(ws) - run + 1)}
        for d, t in docs:
            ts = leaks.words(t or "")
            if any(tuple(ts[k : k + run]) in grams for k in range(len(ts) - run + 1)):
                out[d, i] = True
    return set(out)


def sample(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(100 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 40)))) for i in range(12)] + [(200, None), (201, "")]
    docs = []
    for d in range(60):
        ws = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        src = leaks.words(rng.choice(items[:12])[1])
        n, at = rng.randint(8, 16), rng.randint(0, max(0, len(src) - 8))
        ws[len(ws) // 2 : len(ws) // 2] = [w.upper() if rng.random() < 0.2 else w for w in src[at : at + n]]
        docs.append((d, rng.choice((" ", ", ", "\n-- ")).join(ws)))
    return docs + [(900, None), (901, "")], items


def test_equals_brute_force(spark):
    docs, items = sample()
    df = spark.createDataFrame([(*d, "clash") for d in docs], DOCS).repartition(3)
    it = spark.createDataFrame(items, ITEMS)
    got = leaks.find_leaks(df.union(df), it).where("run_words >= 13").collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items) and len(got) == len({(r.doc_id, r.item_id) for r in got})
    assert all(r.run_words >= 13 and r.edits == 0 for r in got)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items = sample(4)
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 60)
    df, it = spark.createDataFrame([(*d, "") for d in docs], DOCS), spark.createDataFrame(items, ITEMS)
    assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(df, it, edits=0).collect()} == brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(df, it).where("run_words >= 13").collect()} == brute(docs, items)
    assert leaks.find_leaks(df, it.where("false")).count() == leaks.find_leaks(df.where("false"), it).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edits_are_found_with_the_recall_aimed_at(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(18))) for i in range(120)]
    docs = []
    for i, s in items:
        ws = s.split()
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(ws))
            ws[k : k + rng.randint(0, 1)] = [rng.choice(["changed", rng.choice(vocabulary)])] * rng.randint(0, 1)
        docs.append((i, "before words here " + " ".join(ws) + " after them"))
    windows = {i: [s.split()[k : k + 13] for k in range(len(s.split()) - 12)] for i, s in items}
    want = {}
    for d, t in docs:
        ws = t.split()
        mine = [ws[k : k + 13] for k in range(len(ws) - 12)]
        best = min((distance(x, y) for x in mine for y in windows[d]), default=99)
        if best <= 2:
            want[d] = best
    got = {r.doc_id: r.edits for r in leaks.find_leaks(spark.createDataFrame([(*d, "") for d in docs], DOCS), spark.createDataFrame(items, ITEMS)).collect() if r.doc_id == r.item_id}
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want) and len(want) > 60
    assert sum(got[d] == want[d] for d in got) >= 0.97 * len(got)


def test_repeats_grow_until_the_recall_is_there():
    assert leaks.repeats_for(0) == (1, 0)
    few, more = leaks.repeats_for(1)[0], leaks.repeats_for(2)[0]
    assert few < more
    assert leaks.least_runs(13, 2) == [(4, 2), (3, 5), (2, 8)] and leaks.least_runs(13, 0)[0] == (13, 1) and leaks.least_runs(3, 3) == [(1, 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=13), st.lists(st.integers(0, 3), min_size=1, max_size=13))
def test_bit_parallel_distance(a, b):
    assert leaks.edit_distances(np.array([a, a]), np.array([b, b])).tolist() == [distance(a, b)] * 2


def test_walk_maps_equal_windows_to_equal_walks():
    ids = np.array([1, 2, 3, 4, 5, 9, 1, 2, 3, 4, 5, 7], dtype=np.int64)
    for r in range(3):
        w = leaks.cgk_walk(ids, np.array([0, 6, 1]), 5, leaks._bits(10, 12, r))
        assert (w[:, 0] == w[:, 1]).all() and (w[:, 0] != w[:, 2]).any()
        k = leaks.sample_keys(w, leaks._places(5, 4, r))
        assert k[0] == k[1]
