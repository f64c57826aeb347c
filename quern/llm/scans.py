"""Noise in text from scanned pages (problem 1).

Method: skip-gram vectors with negative sampling are learned from the word
co-occurrences of the whole corpus. Words that clean pages don't know are linked
to frequent words that differ in one place and are near by the vectors of the
words around them; what stands in the two at that place, counted over all links,
is the channel: how often a glyph is read as another. A word is then corrected in
context: each known word that the channel leads to is weighed by its frequency,
by the channel and by how its vector fits the words around, against the
possibility that what stands there is a word of its own. Without vectors there are
no links, no channel and no corrections.

Lines that repeat a document's title, manual number, issue or chapter, lines that
recur over the pages of one document only, and page numbers are furniture and are
removed; words divided at line ends are joined, unless they are compounds written
with a hyphen; lines are reflowed into paragraphs.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.tables import materialise

#: A word is known if clean pages hold it so often (and at least this share of how often scans do), and it makes up a
#: MOST_WORDS-th of their words; so no more than MOST_WORDS words are known, whatever the corpus.
LEAST_COUNT, CLEAN_SHARE, MOST_WORDS = 2, 0.2, 2_000_000
#: The most frequent words, which serve as context of all others, and those that unknown words are linked to.
CONTEXTS, FREQUENT = 1024, 4096
DIMENSIONS, WINDOW, NEGATIVE, STEPS = 24, 3, 5, 60
#: Penalty on the length of a vector; share of a context's evidence that counts, as neighbouring words depend on each other.
PENALTY, TRUST = 1.0, 0.5
#: Most misread places in a word, and the most letters read or printed at one.
EDITS, PLACE = 3, 3
#: Nats by which the best known word must beat a word that is known itself, or a new one.
MARGIN_KNOWN, MARGIN_NEW = 9.0, 0.0
#: Links of which a pair of glyphs must make up one in so many; so there are no more pairs than that.
MOST_PAIRS = 100_000
#: Pages of a document that a line must recur on, the share of all its pages, and the most documents it may recur in, for a running head.
RECURS, PAGES, DOCUMENTS = 4, 0.6, 2

#: Signs that a plain word doesn't hold; a word with one of them is misread for sure.
SIGNS = frozenset("0123456789|!@$€")
HYPHEN = "[-‐‑¬\xad]"
TOKEN = re.compile(r"[^\W_|!@$€]*[^\W\d_][^\W_]*(?:[|!@$€]+[^\W_]+)*[|!@$€]*|[|!@$€]+[^\W_]+(?:[|!@$€]+[^\W_]+)*[|!@$€]*")
WORDISH = re.compile(r"(?:[^\W_]|[|!@$€])+")
#: White-space tokens with a digit, and which of them are codes such as part numbers, unless the whole token is a misread word.
DIGITAL = re.compile(r"(?<!\S)[^\s\d]*+\d\S*")
CODE = re.compile(r"\d-|-\d|-[A-Z0-9]*\d|[A-Z]\d|\d[A-Z]|\d{3}")
EDGES = re.compile(r"\A[^\w|!@$€]+|[^\w|!@$€]+\Z")
WORDS = re.compile(r"[^\W_]+(?:[-‐‑][^\W_]+)*")
MIXED = re.compile(r"\w*(?:[A-Za-z][Ѐ-ӿͰ-Ͽ]|[Ѐ-ӿͰ-Ͽ][A-Za-z])\w*")
SOFT = re.compile("\xad(?![ \\t]*\\n)")
LINE_END = re.compile(HYPHEN + r"[ \t]*\n")
SEPARATED = re.compile(f"({HYPHEN}[ \\t]*\\n[ \\t]*)")
DIVIDED = re.compile(rf"\S+{HYPHEN}[ \t]*\n[ \t]*\S+(?:(?<={HYPHEN})[ \t]*\n[ \t]*\S+)*")
LEFT_PART = re.compile(r"[^\s.,;:()\[\]«»\"“”]*[^\W_]\Z|[|!@$€]\Z")
RIGHT_PART = re.compile(r"(?:[^\W_]|[|!@$€])+")
INVISIBLE = re.compile("[\u200b-\u200f\u2060\ufeff]")
_LATIN, _OTHER = "ABCEHIKMOPTXacehijopsxyABEZHIKMNOPTYXo", "АВСЕНІКМОРТХасеһіјорѕхуΑΒΕΖΗΙΚΜΝΟΡΤΥΧο"
TO_LATIN = str.maketrans(_OTHER, _LATIN)
TO_CYRILLIC = str.maketrans(_LATIN[:23], _OTHER[:23])


def plain(text: str) -> str:
    """Text in one character form, so that odd characters aren't taken for misread ones; line-end hyphens stay."""
    if text.isascii():
        return text
    s = INVISIBLE.sub("", SOFT.sub("", unicodedata.normalize("NFKC", text)))
    return MIXED.sub(lambda m: _one_script(m.group()), s)


def _one_script(word: str) -> str:
    if word.isascii():
        return word
    kinds = [unicodedata.name(c, "")[:5] for c in word]
    if len(set(kinds) & {"LATIN", "CYRIL", "GREEK"}) < 2:
        return word
    pure = [k for k, c in zip(kinds, word) if c.translate(TO_LATIN) == c and c.translate(TO_CYRILLIC) == c]
    return word.translate(TO_CYRILLIC if pure.count("CYRIL") > len(pure) / 2 else TO_LATIN)


def words(text: str) -> list[str]:
    """Lower-cased words of letters; compounds with a hyphen are one word, tokens with digits none."""
    return [w.lower() for w in WORDS.findall(text) if w.isalpha() or not any(map(str.isdigit, w))]


def counted(text: str) -> list[str]:
    """What the vocabulary counts: words, compounds and their parts, without words divided at line ends."""
    out = words(LINE_END.sub("\x00", text))
    for w in [w for w in out if not w.isalpha()]:
        w = w.replace("‐", "-").replace("‑", "-")
        out.append(w)
        out += w.split("-")
    return out


class Vocabulary:
    """The known words with their counts on clean pages and on scans, and the share of clean pages' words that aren't known."""

    def __init__(self, words: dict[str, tuple[int, int]], total: int):
        self.words, self.total = words, max(1, total)
        self.unknown = max(1 - sum(c for c, _ in words.values()) / self.total, 1 / self.total)


def vocabulary(elements: DataFrame, text: str, scanned: str) -> Vocabulary:
    """The known words over all texts; counted in each task first.

    Without clean pages the scans' own frequent words stand in.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean: Counter[str] = Counter()
        scan: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            every = list(clean.keys() | scan.keys())
            out = pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([clean[w] for w in every], pa.int64()), pa.array([scan[w] for w in every], pa.int64())], names=["word", "clean", "scan"])
            clean.clear()
            scan.clear()
            return out

        for batch in batches:
            for s, noisy in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if s:
                    (scan if noisy else clean).update(counted(plain(s)))
            if len(clean) + len(scan) > 500_000:
                yield flush()
        yield flush()

    rows = elements.select(text, F.coalesce(F.col(scanned), F.lit(False)).alias("noisy")).mapInArrow(count, "word string, clean bigint, scan bigint").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("scan").alias("scan"))
    rows = materialise(rows)
    total = rows.agg(F.sum("clean").alias("clean"), F.sum("scan").alias("scan")).first()
    if not total.clean:
        rows, n = rows.where("scan >= 5").select("word", F.col("scan").alias("clean"), F.lit(0).alias("scan")), total.scan or 0
    else:
        rows, n = rows.where(F.col("clean") >= CLEAN_SHARE * F.col("scan")), total.clean
    known = rows.where(F.col("clean") >= max(LEAST_COUNT, n / MOST_WORDS)).collect()  # at most MOST_WORDS words
    return Vocabulary({r.word: (r.clean, r.scan) for r in sorted(known, key=lambda r: (-r.clean, -r.scan, r.word))}, n)


def cooccurrences(elements: DataFrame, text: str, words_: dict[str, int], contexts: int) -> DataFrame:
    """(word, context, n): counts over all texts of a known word, by its number, within WINDOW words of one of the first `contexts`. Materialised."""
    sent = elements.sparkSession.sparkContext.broadcast(words_)  # at most MOST_WORDS words

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        pairs, n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array((pairs // contexts).astype(np.int32)), pa.array((pairs % contexts).astype(np.int32)), pa.array(n)], names=["word", "context", "n"])

        for batch in batches:
            ids: list[int] = []
            for s in batch.column(0).to_pylist():
                if s:
                    ids += [index.get(w, -1) for w in words(plain(s))]
                    ids += [-1] * WINDOW
            a = np.array(ids, dtype=np.int64)
            new = []
            for k in range(1, WINDOW + 1):
                for x, y in ((a[:-k], a[k:]), (a[k:], a[:-k])):
                    good = (x >= 0) & (y >= 0) & (y < contexts)
                    new.append(x[good] * contexts + y[good])
            every = np.concatenate([pairs, *new])
            pairs, at = np.unique(every, return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([n, np.ones(len(every) - len(n), dtype=np.int64)]), minlength=len(pairs)).astype(np.int64)
            if len(pairs) > 2_000_000:
                yield out()
                pairs, n = pairs[:0], n[:0]
        yield out()

    rows = elements.select(text).mapInArrow(count, "word int, context int, n bigint").groupBy("word", "context").agg(F.sum("n").alias("n"))
    return materialise(rows)


def skipgram(counts: np.ndarray, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(word, context) vectors that maximise the skip-gram objective with negative sampling on the counts, by Adam on all pairs at once."""
    rng = np.random.default_rng(seed)
    n = len(counts)
    total = max(1.0, counts.sum())
    c = counts.astype(np.float32)
    noise = (NEGATIVE * counts.sum(1)[:, None] * (counts.sum(0) / total)[None, :]).astype(np.float32)
    scale = 1.0 / np.maximum(1.0, np.sqrt(counts.sum(1)))[:, None].astype(np.float32)
    w, v = (rng.standard_normal((2, n, DIMENSIONS)) * 0.1).astype(np.float32)
    moments = [np.zeros_like(w) for _ in range(4)]
    for t in range(1, STEPS + 1):
        s = 1 / (1 + np.exp(-np.clip(w @ v.T, -8, 8)))
        g = c - s * (c + noise)  # the gradient with respect to each score
        for k, (x, d) in enumerate(((w, (g @ v) * scale), (v, (g.T @ w) * scale))):
            m, u = moments[2 * k], moments[2 * k + 1]
            m *= 0.9
            m += 0.1 * d
            u *= 0.98
            u += 0.02 * d * d
            x += 0.08 * (m / (1 - 0.9**t)) / (np.sqrt(u / (1 - 0.98**t)) + 1e-6)
    return w, v


def fold_in(counts: np.ndarray, v: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The word vectors that maximise the same objective for rows of counts, the context vectors being given, by Newton's method."""
    w = np.zeros((len(counts), v.shape[1]))
    noise = NEGATIVE * counts.sum(1, keepdims=True) * share[None, :]
    outer = np.einsum("ci,cj->cij", v, v).reshape(len(v), -1)
    eye = PENALTY * np.eye(v.shape[1])
    for _ in range(8):
        s = 1 / (1 + np.exp(-np.clip(w @ v.T, -8, 8)))
        g = (counts - s * (counts + noise)) @ v - PENALTY * w
        h = (((counts + noise) * s * (1 - s)) @ outer).reshape(len(w), v.shape[1], -1) + eye
        step = np.linalg.solve(h, g[:, :, None])[:, :, 0]
        w += step * np.minimum(1, 4 / np.maximum(1e-9, np.abs(step).max(1, keepdims=True)))
    return w


def vectors(counts: DataFrame, n_words: int, contexts: int) -> tuple[np.ndarray, np.ndarray]:
    """(word vectors of all known words, context vectors): contexts among themselves first, then every word by its own counts, in Spark."""
    core = np.zeros((contexts, contexts))
    for r in counts.where(F.col("word") < contexts).toPandas().itertuples(index=False):  # at most CONTEXTS^2 numbers
        core[r.word, r.context] = r.n
    if not core.any():
        return np.zeros((n_words, DIMENSIONS), dtype=np.float32), np.zeros((contexts, DIMENSIONS), dtype=np.float32)
    _, v = skipgram(core)
    share = core.sum(0) / core.sum()

    def fold(table: pa.Table) -> pa.Table:
        word = table.column("word").to_numpy()
        every, at = np.unique(word, return_inverse=True)
        context, n = table.column("context").to_numpy(), table.column("n").to_numpy()
        out = []
        for lo in range(0, len(every), 256):
            own = (at >= lo) & (at < lo + 256)
            dense = np.zeros((min(256, len(every) - lo), contexts))
            dense[at[own] - lo, context[own]] = n[own]
            out.append(fold_in(dense, v, share))
        w = np.concatenate(out).astype(np.float32)
        return pa.table({"word": pa.array(every, pa.int32()), "vector": pa.array(list(w), pa.list_(pa.float32()))})

    w = np.zeros((n_words, DIMENSIONS), dtype=np.float32)
    blocks = counts.withColumn("block", F.floor(F.col("word") / 1024)).groupBy("block").applyInArrow(lambda t: fold(t), "word int, vector array<float>")
    for r in blocks.toLocalIterator():  # at most MOST_WORDS vectors
        w[r.word] = r.vector
    return w, v


def difference(read: str, word: str) -> tuple[str, str]:
    """What stands in a reading and in a word where they differ, in one place; where one of the two has nothing, with the letter before (or after)."""
    n = min(len(read), len(word))
    i = next((k for k in range(n) if read[k] != word[k]), n)
    j = next((k for k in range(n - i) if read[-1 - k] != word[-1 - k]), n - i)
    if len(read) == i + j or len(word) == i + j:
        i, j = (i - 1, j) if i else (i, max(0, j - 1))
    return read[i : len(read) - j], word[i : len(word) - j]


class Links:
    """Frequent words by what is left of them when one place is taken out."""

    def __init__(self, frequent: list[str]):
        self.by: dict[tuple[str, str], list[int]] = {}
        for k, w in enumerate(frequent):
            for i in range(len(w) + 1):
                for n in range(PLACE):
                    if i + n <= len(w) and len(w) - n >= 2:
                        self.by.setdefault((w[:i], w[i + n :]), []).append(k)

    def near(self, read: str) -> set[int]:
        """Numbers of the frequent words that a reading becomes by another text of under PLACE letters in one place."""
        out: set[int] = set()
        for i in range(len(read) + 1):
            for n in range(PLACE):
                if i + n <= len(read):
                    out.update(self.by.get((read[:i], read[i + n :]), ()))
        return out


class Reader:
    """Corrects words and finds the noise of a text, with everything that a worker needs."""

    def __init__(self, known: Vocabulary, vectors_: tuple[np.ndarray, np.ndarray], channel: dict[tuple[str, str], int] | None = None):
        self.known, self.total = {w: c for w, (c, _) in known.words.items()}, known.total
        self.sorted = sorted(self.known)
        self.index = {w: i for i, w in enumerate(known.words)}
        self.w, self.v = vectors_
        self.found: dict[str, tuple[tuple[str, float], ...]] = {}
        self.prior = {w: math.log(c / self.total) for w, c in self.known.items()}
        self.new = math.log(known.unknown)
        self.letters = self._letters()
        self.by_first: dict[str, list[tuple[str, str, float]]] = {}
        self.teach(known, channel or {})

    def _letters(self) -> dict[str, float]:
        """Log probabilities of letter pairs in known words, ends included: what a word of its own looks like."""
        pair: Counter[str] = Counter()
        first: Counter[str] = Counter()
        for w in self.known:
            for i, c in enumerate("\n" + w):
                pair[c + (w[i] if i < len(w) else "\n")] += 1
                first[c] += 1
        return {p: math.log(n / first[p[0]]) for p, n in pair.items()}

    def teach(self, known: Vocabulary, channel: dict[tuple[str, str], int]) -> None:
        """Take over the channel: {(read, printed): links}; a pair's probability is by how often scans hold what is printed."""
        held: Counter[str] = Counter()
        wanted = {printed for _, printed in channel}
        for w, (_, scan) in known.words.items():
            for i in range(len(w)):
                for n in range(1, 2 * PLACE):
                    if w[i : i + n] in wanted:
                        held[w[i : i + n]] += scan
        self.by_first, self.found = {}, {}
        for (read, printed), n in sorted(channel.items()):
            if read:
                self.by_first.setdefault(read[0], []).append((read, printed, math.log(n / (n + held[printed] + 1))))

    def starts(self, prefix: str) -> bool:
        i = bisect.bisect_left(self.sorted, prefix)
        return i < len(self.sorted) and self.sorted[i].startswith(prefix)

    def candidates(self, word: str) -> tuple[tuple[str, float], ...]:
        """(known word, log probability of the reading) of the known words that a reading may stand for, by up to EDITS places of the channel.

        The known words' prefixes steer the search, so it needs no cap.
        """
        out = self.found.get(word)
        if out is None:
            best: dict[str, float] = {}
            stack = [("", 0, 0.0, 0)]
            seen: dict[tuple[str, int, int], float] = {}
            while stack:
                done, at, cost, edits = stack.pop()
                if at == len(word):
                    if edits and done in self.known and done != word and cost > best.get(done, -math.inf):
                        best[done] = cost
                    continue
                ahead = [(done + word[at], at + 1, cost, edits)]
                if edits < EDITS:
                    ahead += [(done + printed, at + len(read), cost + p, edits + 1) for read, printed, p in self.by_first.get(word[at], ()) if word.startswith(read, at)]
                for x in ahead:
                    k = (x[0], x[1], x[3])
                    if x[2] > seen.get(k, -math.inf) and self.starts(x[0]):
                        seen[k] = x[2]
                        stack.append(x)
            out = tuple(sorted(best.items(), key=lambda x: (-x[1] - self.prior[x[0]], x[0])))
            if len(self.found) > 300_000:
                self.found.clear()
            self.found[word] = out
        return out

    def context(self, around: list[str]) -> tuple[np.ndarray, int] | None:
        """The sum of the context vectors around a word, and how many they are."""
        ids = [i for i in map(self.index.get, around) if i is not None and i < len(self.v)]
        return (self.v[ids].sum(axis=0), len(ids)) if ids else None

    def fit(self, word: str, context: tuple[np.ndarray, int] | None) -> float:
        """Nats by which a context makes a known word likelier, by the vectors: the sum of w.v + log(NEGATIVE) over the context; 0 without vectors."""
        if context is None or not context[0].any():
            return 0.0
        w = self.w[self.index[word]]
        return float(w @ context[0]) + context[1] * math.log(NEGATIVE) if w.any() else 0.0

    def as_new(self, word: str) -> float:
        """Log probability that a word that isn't known stands where it is read: new words' share times that of its letters."""
        s = "\n" + word + "\n"
        return self.new + sum(self.letters.get(s[i : i + 2], -9.0) for i in range(len(s) - 1))

    def correct(self, word: str, around: list[str]) -> str | None:
        """What a misread word stands for, in lower case; None for a word that is none or can't be told."""
        low = word.lower()
        letters = sum(c.isalpha() for c in low)
        if letters < 2 or (len(low) < 3 and letters < len(low)):
            return None
        options = self.candidates(low)
        if not options:
            return None
        c = self.context(around)
        score = {w: self.prior[w] + p + TRUST * self.fit(w, c) for w, p in options}
        best = max(score, key=lambda w: (score[w], w))
        if low in self.known:
            return best if score[best] > self.prior[low] + TRUST * self.fit(low, c) + MARGIN_KNOWN else None
        return best if score[best] > self.as_new(low) + MARGIN_NEW else None

    def is_word(self, word: str) -> bool:
        return word.lower() in self.known

    def joins(self, left: str, right: str) -> tuple[bool, str]:
        """(whether a word divided at a line end is written in one, the word as it reads whole)."""
        part = re.split("[-‐‑]", left)[-1]
        one, two = part + right, part + "-" + right
        if self.is_word(one):
            return True, left + right
        if self.is_word(two):
            return False, left + "-" + right
        if self.correct(one, []):
            return True, left + right
        known = [self.is_word(x) or self.correct(x, []) is not None for x in (part, right)]
        return (not all(known), left + right if not all(known) else left + "-" + right)

    def same(self, read: str, word: str) -> bool:
        """Whether a reading becomes a given word by places of the channel alone."""
        reach = {(0, 0, 0)}
        while reach:
            ahead = set()
            for i, j, e in reach:
                if i == len(read) and j == len(word):
                    return True
                if i < len(read) and j < len(word) and read[i] == word[j]:
                    ahead.add((i + 1, j + 1, e))
                if i < len(read) and e < EDITS:
                    ahead.update((i + len(r), j + len(p), e + 1) for r, p, _ in self.by_first.get(read[i], ()) if read.startswith(r, i) and word.startswith(p, j))
            reach = ahead
        return False


def channel(elements: DataFrame, text: str, scanned: str, reader: Reader) -> dict[tuple[str, str], int]:
    """{(read, printed): links} over all scans: each unknown word there is linked to the frequent word that differs in one place and fits the words around it best, if it fits at all."""
    sent = elements.sparkSession.sparkContext.broadcast(reader)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader: Reader = sent.value
        frequent = [w for w in reader.index if len(w) > 2 and w.isalpha()][:FREQUENT]
        links, near = Links(frequent), {}
        total: Counter[tuple[str, str]] = Counter()
        for batch in batches:
            for s in batch.column(0).to_pylist():
                if not s:
                    continue
                tokens = [t.lower() for t in TOKEN.findall(DIVIDED.sub(" \n ", plain(s)))]
                for n, low in enumerate(tokens):
                    if low in reader.known or len(low) < 4 or sum(c.isalpha() for c in low) < 2:
                        continue
                    if low not in near:
                        if len(near) > 300_000:
                            near.clear()
                        near[low] = [frequent[k] for k in links.near(low)]
                    if near[low] and (c := reader.context(tokens[max(0, n - WINDOW) : n] + tokens[n + 1 : n + 1 + WINDOW])) is not None:
                        fit, best = max((reader.fit(w, c), w) for w in near[low])
                        if fit > 0:
                            total[difference(low, best)] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["read", "printed", "n"])

    rows = materialise(elements.where(F.col(scanned)).select(text).mapInArrow(count, "read string, printed string, n bigint").groupBy("read", "printed").agg(F.sum("n").alias("n")))
    every = rows.agg(F.sum("n").alias("n")).first().n or 0
    return {(r.read, r.printed): r.n for r in rows.where(F.col("n") >= every / MOST_PAIRS).collect()}  # at most MOST_PAIRS


NUMBER = r"(?:page\s+\d+(?:\s+of\s+\d+)?|p\.\s*\d+|[-—–]\s*\d+\s*[-—–]|\d+\s*/\s*\d+|\d+-\d+|\d+|[ivxl]+|\[\d+\])"
ONLY_NUMBER = re.compile(NUMBER)
BEFORE = re.compile(rf"({NUMBER})(?:\s*\|\s*|\s+)")
AFTER = re.compile(rf"(?:\s*\|\s*|\s+)({NUMBER})")
CHAPTER = re.compile(r"\s*[-—–]\s*\w+\s+[\divxl]+")
ISSUE = re.compile(r"(?:(?:tm|change\s+\d+|issue\s+\d+|rev\.?\s*\d+)\s+)?")
BARE = re.compile(r"\d+|\[\d+\]")
DIGITS = re.compile(r"\d+")


class Heads:
    """Recognises the furniture of one document by its title and manual number, as far as its file name holds them, and by the lines that recur on its pages."""

    def __init__(self, filename: str | None, recurring: tuple[int, ...] | None = None):
        self.recurring = frozenset(recurring or ())
        stem = (filename or "").rsplit(".", 1)[0]
        number, _, title = stem.partition("_")
        self.number = number.lower()
        self.title = " ".join(title.lower().split("_"))
        self.words = tuple(w for w in (*self.title.split(), self.number) if w)

    def _head(self, line: str) -> set[str]:
        """Kinds of a line that holds the title or the number: the head, with a page number before or after it."""
        for key, left, right in ((self.title, None, CHAPTER), (self.number, ISSUE, None)):
            at = line.find(key) if key else -1
            if at < 0:
                continue
            before, after = line[:at], line[at + len(key) :]
            if right is not None and (m := right.match(after)):
                after = after[m.end() :]
            first = BEFORE.match(before)
            for start in {0, first.end() if first else 0}:
                rest = before[start:]
                if (left.fullmatch(rest) if left is not None else not rest) and (not after or AFTER.fullmatch(after)):
                    return {"running_head"} | ({"page_number"} if start or after else set())
        return set()

    def kinds(self, line: str, page: int | None, fix) -> set[str]:
        """The kinds of furniture in a line; empty for text. A bare number is a page number only if it is the page's."""
        t = line.strip().lower()
        if not t:
            return set()
        if any(w in t for w in self.words) and len(t) <= len(self.title) + 50:
            found = self._head(t) or self._head(fix(t))
            if found:
                return found
        if ONLY_NUMBER.fullmatch(t):
            if BARE.fullmatch(t):
                return {"page_number"} if page is None or int(t.strip("[]")) == page else set()
            return {"page_number"} if len(t) < 6 or not t.isalpha() else set()
        return {"running_head"} if self.recurring and line_mark(t) in self.recurring else set()


def line_mark(line: str) -> int:
    """A hash of a line whatever its numbers, case and white space."""
    s = " ".join(DIGITS.sub("0", line.lower()).split())
    return xxhash.xxh64_intdigest(s) - 2**63


def recurring_lines(elements: DataFrame, text: str = "content_text") -> DataFrame:
    """(document_id, lines array<bigint>): the lines that recur on RECURS pages and the share PAGES of a document or more, and so in DOCUMENTS documents at most.

    Only hashes of lines are shuffled. What recurs in many documents is layout
    of the text, such as a warning's headline, and no running head. Lines without
    a letter, and elements without a page, don't count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, line_mark(x), p) for d, s, p in zip(*(batch.column(i).to_pylist() for i in range(3))) for x in {y.strip() for y in (s or "").split("\n")} if any(map(str.isalpha, x))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int32()))], names=["document_id", "line", "page"])

    own = elements.where("page_number IS NOT NULL AND document_id IS NOT NULL")
    lines = own.select("document_id", text, F.col("page_number").cast("int")).mapInArrow(run, "document_id string, line bigint, page int")
    often = lines.groupBy("document_id", "line").agg(F.min("page").alias("lo"), F.max("page").alias("hi"), F.count("*").alias("n")).where(F.col("n") >= RECURS)
    often = materialise(lines.join(often.where("lo < hi").select("document_id", "line"), ["document_id", "line"], "left_semi").groupBy("document_id", "line").agg(F.countDistinct("page").alias("n")).where(F.col("n") >= RECURS))
    pages = own.join(often.select("document_id").distinct(), "document_id", "left_semi").groupBy("document_id").agg(F.countDistinct("page_number").alias("pages"))
    often = often.join(pages, "document_id").where(F.col("n") >= PAGES * F.col("pages")).select("document_id", "line")
    common = often.groupBy("line").agg(F.count("*").alias("d")).where(F.col("d") > DOCUMENTS)
    return often.join(common, "line", "left_anti").groupBy("document_id").agg(F.collect_set("line").alias("lines"))


def repair(text: str | None, page: int | None, heads: Heads, reader: Reader) -> tuple[set[str], str | None]:
    """(kinds of noise, the text repaired) of one scanned text.

    Furniture lines go, divided words are joined, misread words corrected and
    lines reflowed; blank lines separate paragraphs. Null stays null, an empty
    text empty; a text of furniture alone becomes empty.
    """
    if not text:
        return set(), text
    s = plain(text)
    kinds: set[str] = set()
    lines, kept = s.split("\n"), []
    known = set(re.findall(r"[^\W\d_]+", heads.title))

    def fix(line: str) -> str:
        return re.sub(WORDISH, lambda m: m.group() if m.group() in known or m.group().isdigit() else next((w for w in known if reader.same(m.group(), w)), m.group()), line)

    for line in lines:
        found = heads.kinds(line, page, fix)
        kinds |= found
        if not found:
            kept.append(line)

    def whole(m: re.Match) -> str:
        """The words of a chain of line ends, joined where they were divided."""
        parts = SEPARATED.split(m.group())
        done = parts[0]
        for gap, ahead in zip(parts[1::2], parts[2::2]):
            left, right = LEFT_PART.search(done), RIGHT_PART.match(ahead)
            if left is None or right is None:
                done += gap + ahead
                continue
            a, b = left.group(), right.group()
            one, word = (False, a + "-" + b) if a[-1].isdigit() or b[0].isdigit() else reader.joins(a, b)
            if one:
                kinds.add("broken_word")
            done = done[: left.start()] + word + ahead[right.end() :]
        return done

    s = DIVIDED.sub(whole, "\n".join(kept))
    spans = [(m.start(), m.end()) for m in DIGITAL.finditer(s)]
    tokens = list(TOKEN.finditer(s))
    low = [t.group().lower() for t in tokens]
    out, last, k = [], 0, 0
    for n, t in enumerate(tokens):
        while k < len(spans) and spans[k][1] <= t.start():
            k += 1
        word = t.group()
        if word.isdigit() or (word.isupper() and len(word) < 4) or (low[n].rstrip("!") in reader.known and low[n].endswith("!")) or not reader.candidates(low[n]):
            continue
        code = k < len(spans) and spans[k][0] <= t.start() < spans[k][1]
        if code:
            chunk = s[spans[k][0] : spans[k][1]]
            if sum(c.isalpha() for c in word) < 2 or (CODE.search(chunk) and EDGES.sub("", chunk) != word):
                continue
        fixed = reader.correct(word, low[max(0, n - WINDOW) : n] + low[n + 1 : n + 1 + WINDOW])
        if fixed:
            kinds.add("misread")
            capital = word[0].isupper() or word[0] in "$8" or (word[0] in SIGNS and s[: t.start()].rstrip().endswith((".", "?")))
            out += [s[last : t.start()], fixed.upper() if word.isupper() and len(word) > 3 else fixed.capitalize() if capital else fixed]
            last = t.end()
    s = "".join([*out, s[last:]])
    paragraphs = [" ".join(p.split()) for p in re.split(r"\n[ \t]*\n", s)]
    return kinds, "\n\n".join(p for p in paragraphs if p)


def learn(elements: DataFrame, text: str = "content_text", scanned: str = "scanned") -> Reader:
    """Vocabulary, vectors, channel and with them the corrector, from all texts."""
    known = vocabulary(elements, text, scanned)
    index = {w: i for i, w in enumerate(known.words)}
    contexts = min(CONTEXTS, len(index))
    if not contexts:
        return Reader(known, (np.zeros((0, DIMENSIONS)), np.zeros((0, DIMENSIONS))))
    reader = Reader(known, vectors(cooccurrences(elements, text, index, contexts), len(index), contexts))
    reader.teach(known, channel(elements, text, scanned, reader))
    return reader


def scanned_documents(elements: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, filename, lines) of the scanned documents: those with an `ocr` chunk, in any case, or with recognition confidences; with their recurring lines."""
    by_chunk = chunks.where(F.lower(F.trim("modality")) == "ocr").select("document_id")
    by_page = elements.where("confidence IS NOT NULL").select("document_id")
    docs = by_chunk.union(by_page).where("document_id IS NOT NULL").distinct()
    lines = recurring_lines(elements.where("element_type = 'text'"))
    return docs.join(documents.groupBy("document_id").agg(F.max("filename").alias("filename")), "document_id", "left").join(lines, "document_id", "left")


def repair_elements(elements: DataFrame, scanned: DataFrame, reader: Reader, newest: str = "updated_at") -> DataFrame:
    """(id, kinds array<string>, repaired): the latest delivery of each text element of a scanned document.

    Elements of other types and of other documents are clean and left as they
    are; they aren't in the result. Null and empty texts have no kinds.
    """
    sent = elements.sparkSession.sparkContext.broadcast(reader)  # bounded by MOST_WORDS and MOST_PAIRS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: dict[tuple, Heads] = {}
        for batch in batches:
            kinds, texts = [], []
            for body, page, name, lines in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5))):
                own = (name, tuple(lines or ()))
                h = heads.get(own)
                if h is None:
                    if len(heads) > 10_000:
                        heads.clear()
                    h = heads[own] = Heads(*own)
                k, t = repair(body, page, h, sent.value)
                kinds.append(sorted(k))
                texts.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kinds, pa.list_(pa.string())), pa.array(texts, pa.string())], names=["id", "at", "kinds", "repaired"])

    rows = elements.where("element_type = 'text' AND id IS NOT NULL").join(scanned, "document_id").select("id", F.date_format(newest, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), F.col("content_text").alias("body"), F.col("page_number").cast("int").alias("page"), "filename", "lines")
    return rows.mapInArrow(run, "id string, at string, kinds array<string>, repaired string")
