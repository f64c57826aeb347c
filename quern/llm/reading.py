"""The reading level of each document (problem 10).

Method: regularised ordinal regression (proportional odds) over features of
lexical diversity, word rarity, graded vocabulary, connectives, a proxy of clause
depth, and length, fitted to graded texts. Rarity comes from word counts over the
whole corpus. A word's grade is how its occurrence in the graded texts is spread
over the levels; for the fit, a text's own fold is left out of these counts.

Texts in other languages have no graded examples. They are graded by a second
regression over the features that don't depend on a vocabulary (length of words and
sentences, diversity, punctuation), each on the scale of its own language: as so
many standard deviations from the mean of all that language's texts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.tables import materialise

LEAST_WORDS = 40
#: Graded texts used for the fit, chosen by hash.
SAMPLE = 4000
FOLDS = 5
#: Words that are counted one by one: those that make up a MOST_WORDS-th of all words; rarer ones count as if they made up that much.
MOST_WORDS = 1_000_000
#: Texts of a language that give it a scale of its own, and the share of all that they must be; other texts share one scale.
LEAST_TEXTS, LANGUAGES = 30, 1000
#: Share of a text's words in COMMON from which a text without a label is taken for English.
ENGLISH = 0.15
PENALTY = 3.0
STEPS = 1500

WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"[.!?;]+(?=\s|$)|\n+")
VOWELS = re.compile("[aeiouy]+")
#: Connectives of plain and of formal prose, and words that open a subordinate clause.
PLAIN = frozenset("and but so or then also because if when while before after until".split())
FORMAL = frozenset("although whereas notwithstanding consequently furthermore moreover nevertheless insofar thereby hence thus albeit neither nor rather irrespective whereby inasmuch".split())
OPENERS = frozenset("that which who whom whose where when while although whereas because since unless if whether than as".split())

#: Frequent words of English.
COMMON = PLAIN | OPENERS | frozenset("the of a an in is are to for on with be by at from it this its not".split())
#: Columns of `Features.of` from the words (length, share of words over 6 and 9 letters), and of those after them (words a sentence, diversity, punctuation).
NEUTRAL_WORDS, NEUTRAL_TEXT = [0, 1, 2], [0, 2, 3, 4, 5, 6]


def plain(text: str) -> str:
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()


class Counts(dict[str, int]):
    """Counts of the words that are counted one by one; all others have the floor. The total is of all words."""

    total, floor = 0, 1


def word_counts(docs: DataFrame, text: str) -> Counts:
    """Counts of all words without digits over all texts; counted in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for s in batch.column(0).to_pylist():
                if s:
                    total.update(WORD.findall(plain(s)))
            if len(total) > 500_000:
                yield _counts(total)
                total = Counter()
        yield _counts(total)

    rows = materialise(docs.select(text).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    every = rows.agg(F.sum("n").alias("total"), F.min("n").alias("floor")).first()
    out = Counts()
    if every.total:
        out.total, out.floor = every.total, max(every.floor, every.total / MOST_WORDS)
        out.update((r.word, r.n) for r in rows.where(F.col("n") > out.floor).toLocalIterator())  # at most MOST_WORDS words
    return out


def _counts(total: Counter[str]) -> pa.RecordBatch:
    kept = {w: n for w, n in total.items() if w.isalpha()}
    return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], names=["word", "n"])


class Grades:
    """How words are spread over the levels, by documents that hold them."""

    def __init__(self, sets: list[set[str]], levels: np.ndarray, count: int, strength: float = 1.0):
        per = np.bincount(levels, minlength=count).astype(float)
        n: dict[str, np.ndarray] = {}
        for ws, level in zip(sets, levels):
            for w in ws:
                n.setdefault(w, np.zeros(count))[level] += 1
        base = 1.0 / np.maximum(per, 1)
        self.table = {}
        for w, c in n.items():
            share = (c + strength / count) * base / ((c + strength / count) * base).sum()
            trust = c.sum() / (c.sum() + 2.0)
            self.table[w] = (np.log(share * count) * trust).astype(np.float32)
        self.none = np.zeros(count, dtype=np.float32)

    def of(self, word: str) -> np.ndarray:
        return self.table.get(word, self.none)


class Features:
    """Feature rows of texts, under given corpus counts and grades."""

    def __init__(self, counts: dict[str, int], grades: Grades):
        whole = isinstance(counts, Counts)
        self.total = max(1, counts.total if whole else sum(counts.values()))
        self.floor = counts.floor if whole else min(counts.values(), default=1)
        self.counts, self.grades = counts, grades
        self.known: dict[str, int] = {}
        self.rows: list[np.ndarray] = []

    def _word(self, w: str) -> np.ndarray:
        n = len(w)
        digits = not w.isalpha()
        rare = 0.0 if digits else math.log(self.total / max(self.counts.get(w, 0), self.floor))
        own = [min(n, 20), n > 6, n > 9, 0 if digits else len(VOWELS.findall(w)), rare, rare > 9, w in PLAIN, w in FORMAL, w in OPENERS, w == "of", digits]
        g = self.grades.of(w)
        return np.concatenate([np.array(own, dtype=np.float32), g, (g == g.max()) & (g.max() > 0.3)]).astype(np.float32)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(features, words) of each text; a text without words has a row of zeros."""
        flat, starts, extra, sizes = [], [], [], []
        for s in texts:
            s = plain(s)
            ws = WORD.findall(s)
            sizes.append(len(ws))
            starts.append(len(flat))
            for w in ws:
                i = self.known.get(w)
                if i is None:
                    i = self.known[w] = len(self.rows)
                    self.rows.append(self._word(w))
                flat.append(i)
            n = max(1, len(ws))
            units = max(1, sum(1 for x in SENTENCE.split(s) if len(x) > 2))
            extra.append([math.log(n / units), math.log(n), len(set(ws)) / math.sqrt(2 * n), s.count(",") / n, (s.count(";") + s.count(":")) / n, s.count("-") / n, s.count(",") / units])
        sizes = np.array(sizes)
        width = len(self._word("a"))
        mean = np.zeros((len(texts), width), dtype=np.float64)
        full = np.flatnonzero(sizes)
        if len(full):
            mean[full] = np.add.reduceat(np.array(self.rows)[flat], np.array(starts)[full], axis=0) / sizes[full, None]
        if len(self.rows) > 300_000:
            self.known, self.rows = {}, []
        return np.concatenate([mean, np.array(extra, dtype=np.float64).reshape(len(texts), -1)], axis=1), sizes


def neutral(x: np.ndarray) -> np.ndarray:
    """The columns of feature rows that depend on no vocabulary."""
    return np.concatenate([x[:, NEUTRAL_WORDS], x[:, x.shape[1] - 7 :][:, NEUTRAL_TEXT]], axis=1)


class Ordinal:
    """Proportional odds: P(level <= k) = sigmoid(cut_k - w.x), with an L2 penalty on w."""

    def __init__(self, x: np.ndarray, y: np.ndarray, count: int):
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-6
        z = np.clip((x - self.mean) / self.sd, -4, 4)
        n, d = z.shape
        w, cuts = np.zeros(d), np.linspace(-1.5, 1.5, count - 1)
        params = np.concatenate([w, [cuts[0]], np.log(np.diff(cuts))]) if count > 2 else np.concatenate([w, cuts])
        m, v = np.zeros_like(params), np.zeros_like(params)
        for t in range(1, STEPS + 1):
            g = self._gradient(params, z, y, d, count) + np.concatenate([PENALTY * params[:d] / n, np.zeros(len(params) - d)])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            params = params - 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.w, self.cuts = params[:d], self._cuts(params[d:])

    @staticmethod
    def _cuts(p: np.ndarray) -> np.ndarray:
        return p[0] + np.concatenate([[0], np.cumsum(np.exp(p[1:]))])

    def _gradient(self, params: np.ndarray, z: np.ndarray, y: np.ndarray, d: int, count: int) -> np.ndarray:
        cuts = self._cuts(params[d:])
        s = z @ params[:d]
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        hi, lo = 1 / (1 + np.exp(-(edge[y + 1] - s))), 1 / (1 + np.exp(-(edge[y] - s)))
        p = np.maximum(hi - lo, 1e-9)
        dh, dl = hi * (1 - hi) / p, lo * (1 - lo) / p
        gw = z.T @ (dh - dl) / len(y)
        gc = np.array([(dl * (y == k + 1)).sum() - (dh * (y == k)).sum() for k in range(count - 1)]) / len(y)
        steps = np.exp(params[d + 1 :])
        return np.concatenate([gw, [gc.sum()], [gc[k + 1 :].sum() * steps[k] for k in range(count - 2)]])

    def predict(self, x: np.ndarray, mean: np.ndarray | None = None, sd: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(index of the likeliest level, its probability), on the scale of the fit or on a given one."""
        s = np.clip((x - (self.mean if mean is None else mean)) / (self.sd if sd is None else sd), -4, 4) @ self.w
        below = 1 / (1 + np.exp(-(self.cuts[None, :] - s[:, None])))
        p = np.diff(np.concatenate([np.zeros((len(s), 1)), below, np.ones((len(s), 1))], axis=1), axis=1)
        return p.argmax(1), p.max(1)


class Model:
    """Everything that a worker needs to grade texts."""

    def __init__(self, counts: dict[str, int], texts: list[str], levels: list[int]):
        self.levels = sorted(set(levels))
        y = np.array([self.levels.index(v) for v in levels])
        n = len(self.levels)
        sets = [set(WORD.findall(plain(s))) for s in texts]
        x = None
        for fold in range(FOLDS):
            own, rest = np.arange(len(y)) % FOLDS == fold, np.arange(len(y)) % FOLDS != fold
            if not own.any():
                continue
            part, _ = Features(counts, Grades([sets[i] for i in np.flatnonzero(rest)], y[rest], n)).of([texts[i] for i in np.flatnonzero(own)])
            x = np.zeros((len(y), part.shape[1])) if x is None else x
            x[own] = part
        self.fit = Ordinal(x, y, n) if n > 1 else None
        self.features = Features(counts, Grades(sets, y, n))
        self.other = Ordinal(neutral(x), y, n) if n > 1 else None

    def grade(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(level, confidence, words) of each text."""
        x, sizes = self.features.of(texts)
        k, p = self.fit.predict(x) if self.fit else (np.zeros(len(texts), dtype=np.int64), np.ones(len(texts)))
        return np.array(self.levels)[k], p, sizes


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", level: str = "level") -> Model | None:
    """A model from SAMPLE labelled texts, give or take a few by hash, or from all if there are no more; None without any.

    A document with several different labels, or with a null one, gives no
    example; repeated labels count once.
    """
    one = labels.where(F.col(level).isNotNull()).groupBy(key).agg(F.min(level).alias("lo"), F.max(level).alias("hi")).where("lo = hi").select(F.col(key).alias("k"), F.col("lo").alias("level"))
    one = materialise(one)
    n = one.count()
    some = one.where(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < 1_000_000 * SAMPLE / n) if n > SAMPLE else one
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("body")).where("body <> ''").join(F.broadcast(some), "k").collect()  # at most SAMPLE labels
    rows = sorted({r.k: r for r in rows}.values(), key=lambda r: r.k)
    if not rows:
        return None
    return Model(word_counts(docs, text), [r.body for r in rows], [r.level for r in rows])


def grade(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, level, confidence) of every English text of at least `least` words.

    Null, empty and shorter texts have no row; repeated rows of a document give
    one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # grows with the different words of more than the least count, and SAMPLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                levels, sure, sizes = sent.value.grade(part.column(1).to_pylist())
                keep = pa.array(sizes >= least)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), pa.array(levels, pa.int32()).filter(keep), pa.array(np.round(sure, 4)).filter(keep)], names=["doc_id", "level", "confidence"])

    source = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("body")).where("body <> '' AND doc_id IS NOT NULL")
    return source.mapInArrow(run, "doc_id bigint, level int, confidence double").dropDuplicates(["doc_id"])


def _groups(texts: list[str | None], langs: list[str | None]) -> list[str]:
    """The language of each text: its label in lower case, `en` for unlabelled texts with many frequent words of English, else empty."""
    out = []
    for s, lang in zip(texts, langs):
        own = (lang or "").strip().lower()
        if not own:
            ws = WORD.findall(plain(s or ""))
            own = "en" if ws and sum(w in COMMON for w in ws) >= ENGLISH * len(ws) else ""
        out.append(own)
    return out


def scales(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """{language: (mean, standard deviation)} of the neutral features over all texts of each language; summed in each task first. The empty name is all texts together."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                texts, langs = (batch.column(i).slice(lo, 2000).to_pylist() for i in (0, 1))
                x, sizes = sent.value.features.of([s or "" for s in texts])
                x, groups = neutral(x), _groups(texts, langs)
                for i in np.flatnonzero(sizes):
                    row = np.stack([np.ones(x.shape[1]), x[i], x[i] ** 2])
                    for g in {groups[i], ""}:
                        held[g] = held[g] + row if g in held else row
        rows = [(g, k, *v) for g, m in held.items() for k, v in enumerate(m.T.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.float64()))], names=["lang", "k", "n", "s", "q"])

    sums = materialise(docs.select(text, lang).mapInArrow(run, "lang string, k int, n double, s double, q double").groupBy("lang", "k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")))
    total = sums.where("lang = ''").agg(F.max("n").alias("n")).first().n or 0
    out: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    rows = sorted(sums.where(F.col("n") >= max(LEAST_TEXTS, total / LANGUAGES)).unionByName(sums.where((F.col("lang") == "") & (F.col("n") < max(LEAST_TEXTS, total / LANGUAGES)))).collect(), key=lambda r: (r.lang, r.k))  # at most LANGUAGES languages
    for g in {r.lang for r in rows}:
        n, s, q = np.array([(r.n, r.s, r.q) for r in rows if r.lang == g]).T
        out[g] = s / n, np.sqrt(np.maximum(q / n - (s / n) ** 2, 0)) + 1e-6
    return out


def levels(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, level, confidence) of every document with a word in it, whatever its language and length.

    English texts are graded by all features, others by the neutral ones on their
    language's scale. Null, empty and wordless texts have no row; repeated rows of
    a document give one.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model, scales(docs, model, text, lang)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, own = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                texts, langs = part.column(1).to_pylist(), part.column(2).to_pylist()
                x, sizes = model.features.of(texts)
                k, sure = model.fit.predict(x) if model.fit else (np.zeros(len(x), dtype=np.int64), np.ones(len(x)))
                groups = np.array(_groups(texts, langs))
                for g in set(groups.tolist()) - {"en"} if model.other else ():
                    at = np.flatnonzero(groups == g)
                    k[at], sure[at] = model.other.predict(neutral(x[at]), *own.get(g, own.get("", (None, None))))
                keep = pa.array(sizes > 0)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), pa.array(np.array(model.levels)[k], pa.int32()).filter(keep), pa.array(np.round(sure, 4)).filter(keep)], names=["doc_id", "level", "confidence"])

    source = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("body"), F.col(lang).alias("lang")).where("body <> '' AND doc_id IS NOT NULL")
    return source.mapInArrow(run, "doc_id bigint, level int, confidence double").dropDuplicates(["doc_id"])
