"""Evaluation passages inside a training corpus (problem 9).

Method: words of documents and items become symbols; windows are embedded by the
CGK random walk, which copies the current symbol at each step and moves on as a
random bit of (step, symbol) says. So the edit distance of two windows becomes a
Hamming distance of two walks. Each repeat has a walk of its own and samples some
of its places; a window of a document and one of an item that agree on a sample
and differ in few places of the walk are candidates. The number of repeats follows
from the recall aimed at, measured on random windows with so many edits, and isn't
capped. Candidates are verified by their exact edit distance, which bit-parallel
arithmetic gives for all of them at once, and by the length of the run of words
they have in common.

Before they are embedded, windows of documents are dropped that can't be within
the edits of any item: of the w - q + 1 runs of q words in a window, e edits spoil
q e at most, so a window in which fewer of them are runs of some item isn't near.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a window and of the least common run, word edits in a window.
RUN = WINDOW = 13
EDITS = 2
#: Places of a walk in a sample, recall, and the share of near windows whose walks may differ more than is allowed.
SAMPLE, RECALL, LOST = 7, 0.99, 0.002
SEED = 20_011
#: Item words in one block: it is sent to the workers with 8 bytes a word, and a worker makes 12 bytes a word and repeat of it.
BLOCK_WORDS = 200_000
#: Document words handled at once in a worker.
FLAT_WORDS = 500_000
#: Runs of Unicode letters and numbers (re's \w without the underscore).
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Lower-cased runs of letters and numbers."""
    return WORD.findall(text.lower())


@lru_cache(maxsize=64)
def _places(window: int, sample: int, repeat: int) -> np.ndarray:
    return np.sort(np.random.default_rng((SEED, repeat)).choice(2 * window, size=sample, replace=False))


def _bits(steps: int, symbols: int, walk: int) -> np.ndarray:
    """A walk's random bits by step and symbol: a fixed hash, the same in every worker."""
    z = (np.arange(steps, dtype=np.uint64)[:, None] << np.uint64(40)) + np.arange(symbols, dtype=np.uint64)[None, :] + np.uint64(SEED + (walk << 52))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) & np.uint64(1)).astype(np.int8)


def cgk_walk(ids: np.ndarray, starts: np.ndarray, window: int, bits: np.ndarray) -> np.ndarray:
    """int32 symbols (2 window x window's number) that one walk copies from the windows of `ids` that begin at `starts`.

    Symbols are non-negative; past its end a window reads the last symbol of
    the walk's bits, the pad. Of a walk's 3 w steps the first 2 w are made, as
    later ones mostly read pads.
    """
    at, pad = np.zeros(len(starts), dtype=np.int64), bits.shape[1] - 1
    out = np.empty((2 * window, len(starts)), dtype=np.int32)
    for step in range(2 * window):
        symbol = np.where(at < window, ids[starts + np.minimum(at, window - 1)], pad)
        out[step] = symbol
        at += bits[step][symbol]
    return out


def sample_keys(walk: np.ndarray, places: np.ndarray) -> np.ndarray:
    """uint64 keys of walks by their symbols at the sampled places."""
    keys = np.full(walk.shape[1], 0x9E3779B97F4A7C15, dtype=np.uint64)
    for p in places:
        keys = (keys ^ walk[p].astype(np.uint64)) * np.uint64(0x100000001B3)
        keys ^= keys >> np.uint64(29)
    return keys


@lru_cache(maxsize=16)
def repeats_for(edits: int, window: int = WINDOW, sample: int = SAMPLE, recall: float = RECALL) -> tuple[int, int]:
    """(repeats, most differing places): what it takes to find a window with so many random edits with probability `recall`.

    Equal windows agree in every repeat, so 0 edits need one. Otherwise the share
    of random windows found is measured repeat by repeat until it is reached.
    """
    if edits == 0:
        return 1, 0
    rng, trials, symbols = np.random.default_rng(SEED), 2000, 5000
    a = rng.integers(0, symbols, size=(trials, window))
    b = []
    for row in a:
        new = list(row)
        for _ in range(edits):
            kind, i = rng.integers(0, 3), int(rng.integers(0, len(new)))
            if kind == 0:
                new[i] = int(rng.integers(0, symbols))
            elif kind == 1 and len(new) > 1:
                del new[i]
            else:
                new.insert(i, int(rng.integers(0, symbols)))
        b.append((new + [symbols] * window)[:window])
    starts = np.arange(trials) * window
    flat = a.reshape(-1), np.array(b).reshape(-1)
    found, apart, most = np.zeros(trials, dtype=bool), [], 2 * window
    for repeat in range(10_000):
        bits, places = _bits(2 * window, symbols + 1, repeat), _places(window, sample, repeat)
        x, y = (cgk_walk(f, starts, window, bits) for f in flat)
        same, differ = sample_keys(x, places) == sample_keys(y, places), (x != y).sum(axis=0)
        apart.append(differ[same])
        most = int(np.quantile(np.concatenate(apart), 1 - LOST))
        found |= same & (differ <= most)
        if repeat > 3 and found.mean() >= recall:
            return repeat + 1, most
    raise ValueError(f"windows of {window} words with {edits} edits can't be found with recall {recall} by samples of {sample}")


def least_runs(window: int, edits: int) -> list[tuple[int, int]]:
    """(q, how many of a window's runs of q words so many edits surely leave) for all q up to the longest run that is left, longest first."""
    longest = max(1, -(-(window - edits) // (edits + 1)))
    return [(q, max(1, window - q + 1 - q * edits)) for q in range(longest, min(2, longest) - 1, -1)]


def run_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """uint64 hashes of every n words in a row, at their starts."""
    out = np.zeros(max(0, len(ids) - n + 1), dtype=np.uint64)
    for k in range(n):
        out = (out ^ (ids[k : len(ids) - n + 1 + k].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return out


class Block:
    """The words of a bounded number of items, and in each worker their window keys."""

    def __init__(self, items: list[tuple[int, list[str]]], window: int, sample: int, edits: int, recall: float):
        self.vocabulary: dict[str, int] = {}
        flat, owner, starts = [], [], []
        for item, ws in items:
            starts += range(len(flat), len(flat) + len(ws) - window + 1)
            flat += [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws] + [-2]
            owner += [item] * (len(ws) + 1)
        self.ids, self.owner = np.array(flat, dtype=np.int32), np.array(owner, dtype=np.int64)
        self.starts = np.array(starts, dtype=np.int64)
        self.other = len(self.vocabulary)
        self.window, self.sample, self.edits = window, sample, edits
        self.repeats, self.most = repeats_for(edits, window, sample, recall)
        self.keys: list[tuple[np.ndarray, np.ndarray]] | None = None

    def prepare(self) -> None:
        """Make the walks' bits, the sorted keys of all windows and the hashes of all runs, once in a worker."""
        if self.keys is not None:
            return
        self.held = []
        for q, least in least_runs(self.window, self.edits):
            inside = np.ones(max(0, len(self.ids) - q + 1), dtype=bool)
            for k in range(q):
                inside &= self.ids[k : len(inside) + k] >= 0
            self.held.append((q, least, np.unique(run_hashes(self.ids, q)[inside])))
        self.bits = [_bits(2 * self.window, self.other + 2, r) for r in range(self.repeats)]
        self.keys = []
        for r in range(self.repeats):
            k = sample_keys(cgk_walk(self.ids, self.starts, self.window, self.bits[r]), _places(self.window, self.sample, r))
            order = np.argsort(k, kind="stable")
            self.keys.append((k[order], self.starts[order].astype(np.int32)))

    def hopeful(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The windows that hold few enough unknown words and enough runs of items."""
        w = self.window
        unknown = np.concatenate([[0], np.cumsum(ids == self.other)])
        starts = starts[unknown[starts + w] - unknown[starts] <= self.edits]
        for q, least, held in self.held:
            h = run_hashes(ids, q)
            at = np.minimum(np.searchsorted(held, h), len(held) - 1)
            n = np.concatenate([[0], np.cumsum(held[at] == h)])
            starts = starts[n[starts + w - q + 1] - n[starts] >= least]
        return starts

    def candidates(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document window start, item window start) pairs that agree on the sample of some repeat and whose walks differ in few places."""
        found, fresh = np.zeros(0, dtype=np.int64), []
        for r, (items, at) in enumerate(self.keys):
            walk = cgk_walk(ids, starts, self.window, self.bits[r])
            own = sample_keys(walk, _places(self.window, self.sample, r))
            low, high = np.searchsorted(items, own, side="left"), np.searchsorted(items, own, side="right")
            n = high - low
            hit = np.flatnonzero(n)
            if len(hit):
                reach = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(n[hit])[:-1]]), n[hit]) + np.arange(int(n[hit].sum()))
                x, y = np.repeat(hit, n[hit]), at[reach].astype(np.int64)
                # The walks of few windows of the items are enough, whatever their number of partners.
                some, where = np.unique(y, return_inverse=True)
                theirs = cgk_walk(self.ids, some, self.window, self.bits[r])
                for lo in range(0, len(x), 500_000):
                    part = slice(lo, lo + 500_000)
                    near = (walk[:, x[part]] != theirs[:, where[part]]).sum(axis=0) <= self.most
                    fresh.append((starts[x[part][near]] << 32) + y[part][near])
                if sum(map(len, fresh)) > 2_000_000:
                    found, fresh = np.unique(np.concatenate([found, *fresh])), []
        found = np.unique(np.concatenate([found, *fresh]))
        return found >> 32, found & 0xFFFFFFFF

    def runs(self, ids: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Length of the run of equal words through each candidate, 0 where its first words differ."""
        total = np.zeros(len(p), dtype=np.int64)
        for step, first in ((1, 0), (-1, -1)):
            live, k = np.arange(len(p)), first
            while len(live):
                a, b = p[live] + k, q[live] + k
                inside = (a >= 0) & (a < len(ids)) & (b >= 0) & (b < len(self.ids))
                live, a, b = live[inside], a[inside], b[inside]
                live = live[(ids[a] == self.ids[b]) & (ids[a] != self.other)]
                total[live] += 1
                k += step
        return total

    def leaks(self, names: np.ndarray, flat: list[int], starts: list[int], ends: list[int]) -> pa.RecordBatch:
        """Verified (doc_id, item_id, run_words, edits) of the documents `names`, whose words are `flat` up to `ends`."""
        self.prepare()
        ids, w = np.array(flat, dtype=np.int32), self.window
        p, q = self.candidates(ids, self.hopeful(ids, np.array(starts, dtype=np.int64)))
        cost = edit_distances(ids[p[:, None] + np.arange(w)], self.ids[q[:, None] + np.arange(w)])
        p, q, cost = p[cost <= self.edits], q[cost <= self.edits], cost[cost <= self.edits]
        length = self.runs(ids, p, q)
        doc = names[np.searchsorted(np.array(ends), p, side="right")]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for pair, n, c in zip(zip(doc.tolist(), self.owner[q].tolist()), length.tolist(), cost.tolist()):
            was = best.get(pair, (0, self.edits))
            best[pair] = (max(was[0], n), min(was[1], c))
        columns = [[k[0] for k in best], [k[1] for k in best], [v[0] for v in best.values()], [v[1] for v in best.values()]]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "run_words", "edits"])


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Levenshtein distances of the rows of two matrices of symbols, of under 64 columns each: one bit a column, all rows at once."""
    n, w = a.shape
    if w > 63 or b.shape[1] > 63:
        raise ValueError("windows of at most 63 words can be compared")
    one, bit = np.uint64(1), np.uint64(1) << np.arange(w, dtype=np.uint64)
    up, down = np.full(n, (1 << w) - 1, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    out, top = np.full(n, w, dtype=np.int64), np.uint64(w - 1)
    for j in range(b.shape[1]):
        same = ((a == b[:, j : j + 1]) * bit).sum(axis=1, dtype=np.uint64)
        across = (((same & up) + up) ^ up) | same
        more, less = down | ~(across | up), up & across
        out += ((more >> top) & one).astype(np.int64) - ((less >> top) & one).astype(np.int64)
        more, less = (more << one) | one, less << one
        held = same | down
        up, down = less | ~(held | more), more & held
    return out


def _blocks(items: DataFrame, key: str, text: str, run: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Items with at least `run` words, in blocks of bounded size, streamed through the driver one partition at a time."""
    block, n = [], 0
    for item, s in items.select(F.col(key), F.col(text)).where(F.col(key).isNotNull() & F.col(text).isNotNull()).toLocalIterator():
        ws = words(s)
        if len(ws) < run:
            continue
        block.append((item, ws))
        n += len(ws)
        if n >= BLOCK_WORDS:
            yield block
            block, n = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", window: int = WINDOW, edits: int = EDITS, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """(doc_id bigint, item_id bigint, run_words int, edits int): documents that hold item passages.

    A row says that a window of `window` consecutive words of the document is
    within `edits` word edits of one of the item; `edits` is the least distance
    found, run_words the longest run of equal words through such windows. Equal
    windows are found for certain, so the rows with run_words of at least `window`
    are whole; others with the probability `recall` for each window. Items are a
    stated query set: they are taken in blocks of `BLOCK_WORDS` words, each
    against all documents. Null and empty texts, and items shorter than `window`
    words, leak nowhere; a document or item filed twice under one id counts once.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_key).cast("bigint").alias("doc_id"), F.col(text).alias("body")).where(F.col("body").isNotNull() & F.col("doc_id").isNotNull())
    schema = "doc_id bigint, item_id bigint, run_words int, edits int"
    parts = []
    for rows in _blocks(items, item_key, text, window):
        sent = spark.sparkContext.broadcast(Block(rows, window, sample, edits, recall))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block: Block = sent.value
            for batch in batches:
                names = batch.column(0).to_numpy(zero_copy_only=False)
                first, flat, starts, ends = 0, [], [], []
                for d, s in enumerate(batch.column(1).to_pylist()):
                    base = len(flat)
                    flat += [block.vocabulary.get(w, block.other) for w in words(s)]
                    starts += range(base, len(flat) - window + 1)
                    flat.append(-1)
                    ends.append(len(flat))
                    if len(flat) >= FLAT_WORDS or d == batch.num_rows - 1:
                        if starts:
                            yield block.leaks(names[first : d + 1], flat, starts, ends)
                        first, flat, starts, ends = d + 1, [], [], []

        parts.append(source.mapInArrow(scan, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("doc_id", "item_id").agg(F.max("run_words").alias("run_words"), F.min("edits").alias("edits"))
