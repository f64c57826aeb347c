"""The language of each document and of each segment of mixed texts (problem 5).

Method: hierarchical discrimination. A linear support vector machine for each
language family (one against the rest) picks the family, then one-versus-one
linear machines between the languages of that family vote. Features are hashed
character n-grams inside words and the words themselves; a sentence is the mean of
its words, so a word's score is a constant that workers look up.

The machines are trained here, on a bounded sample of labelled documents. Their
labels are partly wrong, so sentences that lie nearer to another label's mean are
left out first.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The families of the languages told apart.
FAMILIES = {"germanic": ("de", "en"), "romance": ("es", "fr", "pt"), "slavic": ("ru", "uk")}
LANGUAGES = tuple(sorted(x for f in FAMILIES.values() for x in f))
#: Notations of a language besides its two letters, a region after - or _ being left off first.
NOTATIONS = {
    "en": ("eng", "english", "englisch", "anglais", "inglés", "ingles", "английский"),
    "de": ("deu", "ger", "german", "deutsch", "allemand", "alemán", "немецкий"),
    "fr": ("fra", "fre", "french", "français", "francais", "französisch", "francés"),
    "es": ("spa", "spanish", "español", "espanol", "castilian", "castellano", "spanisch"),
    "pt": ("por", "portuguese", "português", "portugues", "portugiesisch"),
    "ru": ("rus", "russian", "русский", "russisch"),
    "uk": ("ukr", "ukrainian", "українська", "ukrainisch", "ua"),
}
#: The training sample: documents of a label, chunks of a document, sentences of a language.
SAMPLE_DOCS, SAMPLE_CHUNKS, SAMPLE_SENTENCES = 250, 4, 400
#: Fewest words and least confidence of a sentence that can show a second language in a text; a phrase, a title or a foreign name doesn't.
LEAST_WORDS, LEAST_SURE = 6, 0.8
DIMENSIONS = 1 << 15
EPOCHS = 6
#: Steepness of the confidence as a function of the margin.
STEEP = 4.0

SENTENCE_END = re.compile(r"(?:(?<=[.!?。])|(?<=[.!?。][\"'»)\]”’]))\s+|\s*\n+\s*|\s+/\s+")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
WITH_DIGIT = re.compile(r"\S*\d\S*")
INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_LATIN = "ABCEHIKMOPTXacehijopsxy"
_CYRILLIC = "АВСЕНІКМОРТХасеһіјорѕху"
TO_LATIN = str.maketrans(_CYRILLIC + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", _LATIN + "ABEZHIKMNOPTYXo")
TO_CYRILLIC = str.maketrans(_LATIN, _CYRILLIC)


def language_of(label: Column) -> Column:
    """The language a label names in any notation; null for other labels, null and blank ones."""
    plain = F.regexp_replace(F.lower(F.trim(label)), "[-_].*$", "")
    out = F.when(plain.isin(*LANGUAGES), plain)
    for code, names in NOTATIONS.items():
        out = out.when(plain.isin(*names), F.lit(code))
    return out


def clean(text: str) -> str:
    """Text with compatibility forms folded and invisible characters removed."""
    return text if text.isascii() else INVISIBLE.sub("", unicodedata.normalize("NFKC", text))


def one_script(word: str) -> str:
    """A word with look-alike letters of another script set right, by the majority of its letters that have none."""
    if word.isascii():
        return word
    kinds = {unicodedata.name(c, "")[:5] for c in word}
    if len(kinds & {"LATIN", "CYRIL", "GREEK"}) < 2:
        return word
    pure = [unicodedata.name(c, "")[:5] for c in word if c.translate(TO_LATIN) == c and c.translate(TO_CYRILLIC) == c]
    return word.translate(TO_CYRILLIC if pure.count("CYRIL") > len(pure) / 2 else TO_LATIN)


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences and lines of a text."""
    out, start = [], 0
    for m in SENTENCE_END.finditer(text):
        if m.start() > start:
            out.append((start, m.start()))
        start = m.end()
    if start < len(text):
        out.append((start, len(text)))
    return out


def words(sentence: str) -> list[str]:
    """Lower-cased words of a sentence; tokens with digits, such as part numbers, hold none."""
    found = WORD.findall(WITH_DIGIT.sub(" ", sentence))
    return [w.lower() for w in found] if sentence.isascii() else [one_script(w).lower() for w in found]


def features(word: str) -> np.ndarray:
    """Hashed n-grams of one to four characters within the word's edges, and the word."""
    s = f"<{word}>"
    grams = [s[i : i + n] for n in (1, 2, 3, 4) for i in range(len(s) - n + 1)] + [f"={word}"] * 3
    return np.array([zlib.crc32(g.encode()) % DIMENSIONS for g in grams], dtype=np.int64)


def _vectors(sents: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse mean feature vectors (indices, values)."""
    known: dict[str, np.ndarray] = {}
    out = []
    for ws in sents:
        every = np.concatenate([known.setdefault(w, features(w)) if w not in known else known[w] for w in ws])
        index, count = np.unique(every, return_counts=True)
        out.append((index, (count / len(ws)).astype(np.float64)))
    return out


def _machine(xs: list[tuple[np.ndarray, np.ndarray]], ys: np.ndarray, weight: np.ndarray, seed: int, rate: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear support vector machine by averaged stochastic subgradient steps; y is 1 or -1."""
    rng = np.random.default_rng(seed)
    w, total, scale, b, bs, t = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 1.0, 0.0, 0.0, 0
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(xs)):
            t += 1
            index, value = xs[i]
            step = 1.0 / (rate * (t + 1000))
            scale *= 1 - step * rate
            if ys[i] * (scale * (w[index] @ value) + b) < 1:
                move = step * weight[i] * ys[i] * 0.01
                w[index] += move / scale * value
                b += move * 0.1
        if epoch >= EPOCHS // 2:
            total += scale * w
            bs += b
    n = EPOCHS - EPOCHS // 2
    return total / n, bs / n


class Model:
    """Family machines, then pairs within a family; built from (language, words of a sentence) examples."""

    def __init__(self, examples: list[tuple[str, list[str]]], seed: int = 5):
        by: dict[str, list[list[str]]] = defaultdict(list)
        for lang, ws in self._consistent(examples):
            if len(by[lang]) < SAMPLE_SENTENCES:
                by[lang].append(ws)
        self.languages = sorted(by)
        self.families = [f for f in FAMILIES if any(x in by for x in FAMILIES[f])]
        labels = [x for x in self.languages for _ in by[x]]
        xs = _vectors([ws for x in self.languages for ws in by[x]])
        family = {x: f for f, own in FAMILIES.items() for x in own}
        self.tasks: list[tuple[str, str]] = [(f, "") for f in self.families] if len(self.families) > 1 else []
        for f in self.families:
            own = [x for x in FAMILIES[f] if x in by]
            self.tasks += [(a, b) for i, a in enumerate(own) for b in own[i + 1 :]]
        weights, biases = [], []
        for n, (a, b) in enumerate(self.tasks):
            y = np.array([(1 if family[x] == a else -1) if not b else 1 if x == a else -1 if x == b else 0 for x in labels])
            keep = np.flatnonzero(y)
            share = {s: max(1, (y[keep] == s).sum()) for s in (1, -1)}
            cost = np.array([len(keep) / 2 / share[int(s)] for s in y[keep]])
            w, c = _machine([xs[i] for i in keep], y[keep], cost, seed + n)
            weights.append(w)
            biases.append(c)
        self.weights = np.array(weights).reshape(len(self.tasks), DIMENSIONS).astype(np.float32)
        self.biases = np.array(biases, dtype=np.float32)
        self.known: dict[str, int] = {}
        self.rows: list[np.ndarray] = []

    @staticmethod
    def _consistent(examples: list[tuple[str, list[str]]], rounds: int = 3) -> list[tuple[str, list[str]]]:
        """Examples nearest to the mean of their own label; means are taken over those kept so far."""
        xs = _vectors([ws for _, ws in examples])
        kept = list(range(len(examples)))
        for _ in range(rounds):
            mean: dict[str, np.ndarray] = {}
            for x in {examples[i][0] for i in kept}:
                m = np.zeros(DIMENSIONS)
                for i in kept:
                    if examples[i][0] == x:
                        np.add.at(m, xs[i][0], xs[i][1])
                mean[x] = m / (np.linalg.norm(m) or 1)
            kept = [i for i, (x, _) in enumerate(examples) if x in mean and max(mean, key=lambda k: (mean[k][xs[i][0]] @ xs[i][1], k)) == x]
        return [examples[i] for i in kept]

    def scores(self, sents: list[list[str]]) -> np.ndarray:
        """Margin of each task for each sentence (sentence x task)."""
        known, flat, starts = self.known, [], []
        for ws in sents:
            starts.append(len(flat))
            for w in ws:
                i = known.get(w)
                if i is None:
                    i = known[w] = len(self.rows)
                    self.rows.append(self.weights[:, features(w)].sum(axis=1))
                flat.append(i)
        if len(known) > 300_000:
            table = np.array(self.rows)
            self.known, self.rows = {}, []
        else:
            table = np.array(self.rows)
        n = np.diff([*starts, len(flat)])
        return np.add.reduceat(table[flat], starts, axis=0) / n[:, None] + self.biases

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into `languages`, confidence) of each row of margins."""
        at = {t: k for k, t in enumerate(self.tasks)}
        n = len(margins)
        fm = margins[:, [at[f, ""] for f in self.families]] if len(self.families) > 1 else np.full((n, 1), 2.0)
        family = fm.argmax(axis=1)
        rest = np.where(np.arange(fm.shape[1]) == family[:, None], -np.inf, fm).max(axis=1, initial=-np.inf)
        lead = np.where(np.isfinite(rest), (fm.max(axis=1) - rest) / 2, 1.0)
        lang, sure = np.zeros(n, dtype=np.int64), lead.copy()
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(family == k)
            own = [x for x in FAMILIES[f] if x in self.languages]
            against = np.full((len(rows), len(own), len(own)), np.nan)
            for i, a in enumerate(own):
                for j in range(i + 1, len(own)):
                    against[:, i, j] = margins[rows, at[a, own[j]]]
                    against[:, j, i] = -margins[rows, at[a, own[j]]]
            votes = (against > 0).sum(axis=2) + 1e-3 * np.tanh(np.nansum(against, axis=2))
            best = votes.argmax(axis=1)
            lang[rows] = np.array([self.languages.index(x) for x in own])[best]
            if len(own) > 1:
                sure[rows] = np.minimum(lead[rows], np.nanmin(against[np.arange(len(rows)), best], axis=1))
        return lang, np.round(1 / (1 + np.exp(-STEEP * sure)), 4)

    def segments(self, texts: list[str | None]) -> list[list[tuple[int, int, str, float, int]]]:
        """For each text, its (start, end, language, confidence, words) runs of whole sentences of one language.

        Offsets are those of the text as given by `clean`. Sentences below
        LEAST_WORDS or LEAST_SURE join the run before them. A text with such
        sentences only is one segment; one without words has none.
        """
        sents: list[list[str]] = []
        places: list[list[tuple[int, int, int]]] = []
        for s in texts:
            own = []
            if s:
                s = clean(s)
                for a, b in sentences(s):
                    ws = words(s[a:b])
                    if ws:
                        own.append((a, b, len(sents)))
                        sents.append(ws)
            places.append(own)
        if not sents:
            return [[] for _ in texts]
        lang_of, sure_of = self.decide(self.scores(sents))
        out = []
        for own in places:
            whole = {i for _, _, i in own if len(sents[i]) >= LEAST_WORDS and sure_of[i] >= LEAST_SURE}
            if not whole and own:
                every = [w for _, _, i in own for w in sents[i]]
                best, sure = self.decide(self.scores([every]))
                out.append([(own[0][0], own[-1][1], self.languages[best[0]], float(sure[0]), len(every))])
                continue
            runs: list[list] = []
            for a, b, i in own:
                n = len(sents[i])
                if i not in whole:
                    if runs:
                        runs[-1][1] = b
                    continue
                lang, sure = self.languages[lang_of[i]], float(sure_of[i])
                if runs and runs[-1][2] == lang:
                    r = runs[-1]
                    r[3] = (r[3] * r[4] + sure * n) / (r[4] + n)
                    r[1], r[4] = b, r[4] + n
                else:
                    runs.append([a, b, lang, sure, n])
            out.append([(a, b, lang, round(sure, 4), n) for a, b, lang, sure, n in runs])
        return out


def train(documents: DataFrame, chunks: DataFrame, key: str = "document_id", label: str = "detected_language", text: str = "chunk_text", order: str = "id") -> Model | None:
    """A model from a bounded sample: SAMPLE_DOCS documents of each label, SAMPLE_CHUNKS chunks of each, by hash.

    None if no document has a label of a known language.
    """
    named = documents.select(F.col(key).alias("doc"), language_of(F.col(label)).alias("lang")).where("lang IS NOT NULL AND doc IS NOT NULL").distinct()
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc"), "doc")
    docs = named.withColumn("r", F.row_number().over(w)).where(F.col("r") <= SAMPLE_DOCS).select("doc", "lang")
    own = chunks.select(F.col(key).alias("doc"), F.col(order).alias("o"), F.col(text).alias("body")).where("body <> ''").join(F.broadcast(docs), "doc")  # at most SAMPLE_DOCS rows a language
    c = Window.partitionBy("doc", "lang").orderBy(F.xxhash64("o"), "o")
    rows = own.withColumn("r", F.row_number().over(c)).where(F.col("r") <= SAMPLE_CHUNKS).select("lang", "body", "doc", "r").collect()
    examples = []
    for r in sorted(rows, key=lambda r: (r.lang, r.r, r.doc)):
        s = clean(r.body)
        for a, b in sentences(s):
            ws = words(s[a:b])
            if len(ws) >= LEAST_WORDS:
                examples.append((r.lang, ws))
    some: dict[str, list[list[str]]] = defaultdict(list)
    for lang, ws in examples:
        if len(some[lang]) < 3 * SAMPLE_SENTENCES:
            some[lang].append(ws)
    return Model([(x, ws) for x in sorted(some) for ws in some[x]]) if some else None


SEGMENT = "array<struct<start:int,end:int,lang:string,confidence:double,words:int>>"


def tag(chunks: DataFrame, model: Model, key: str = "id", document: str = "document_id", text: str = "chunk_text", newest: str = "updated_at") -> DataFrame:
    """(id, document_id, segments): the latest delivery of each text with its segments.

    Null, empty and wordless texts have no segments.
    """
    sent = chunks.sparkSession.sparkContext.broadcast(model)  # bounded: tasks x DIMENSIONS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("words", pa.int32())]))
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                found = sent.value.segments(part.column(3).to_pylist())
                rows = pa.array([[dict(zip(("start", "end", "lang", "confidence", "words"), s)) for s in own] for own in found], kind)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], rows], names=["id", "document_id", "at", "segments"])

    rows = chunks.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(document).alias("document_id"), F.date_format(newest, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), F.col(text).alias("body"))
    out = rows.mapInArrow(run, f"id string, document_id string, at string, segments {SEGMENT}")
    return out.groupBy("id").agg(F.max(F.struct("at", "document_id", "segments")).alias("v")).select("id", "v.document_id", "v.segments")


def chunk_language(tagged: DataFrame) -> DataFrame:
    """(id, document_id, lang, confidence): the language of most of a text's words, ties by name."""
    by = tagged.select("id", "document_id", F.explode("segments").alias("s")).groupBy("id", "document_id", "s.lang").agg(F.sum("s.words").alias("n"), (F.sum(F.col("s.confidence") * F.col("s.words")) / F.sum("s.words")).alias("confidence"))
    best = by.groupBy("id", "document_id").agg(F.max(F.struct("n", "lang", "confidence")).alias("b"))
    return best.select("id", "document_id", "b.lang", "b.confidence")


def document_language(tagged: DataFrame) -> DataFrame:
    """(document_id, lang, confidence): the language of most of a document's chunks, ties by words, then by name.

    The confidence is the mean of those chunks', times their share. A hot
    document is counted in every task first.
    """
    words_in = lambda s, x: F.aggregate(s, F.lit(0), lambda a, y: a + F.when(y["lang"] == x, y["words"]).otherwise(0))
    each = tagged.select("document_id", "segments", F.array_distinct(F.transform("segments", lambda s: s["lang"])).alias("langs"))
    best = F.array_max(F.transform("langs", lambda x: F.struct(words_in(F.col("segments"), x).alias("n"), x.alias("lang"))))
    mean = F.aggregate("segments", F.lit(0.0), lambda a, s: a + s["confidence"] * s["words"]) / F.aggregate("segments", F.lit(0), lambda a, s: a + s["words"])
    rows = each.where(F.size("langs") > 0).select("document_id", best.alias("b"), mean.alias("sure")).select("document_id", "b.lang", "b.n", "sure")
    votes = rows.groupBy("document_id", "lang").agg(F.count("*").alias("chunks"), F.sum("n").alias("n"), F.avg("sure").alias("sure"))
    top = votes.groupBy("document_id").agg(F.max(F.struct("chunks", "n", "lang", "sure")).alias("t"), F.sum("chunks").alias("all"))
    return top.select("document_id", "t.lang", F.round(F.col("t.sure") * F.col("t.chunks") / F.col("all"), 4).alias("confidence"))


def wrong_labels(documents: DataFrame, languages: DataFrame, key: str = "document_id", label: str = "detected_language", newest: str = "updated_at") -> DataFrame:
    """(document_id, lang, confidence) of documents whose label doesn't name their language, missing and unknown labels included."""
    d = documents.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("document_id")).agg(F.max(F.struct(F.col(newest).alias("at"), language_of(F.col(label)).alias("named"))).alias("v"))
    return d.join(languages, "document_id").where(~F.col("v.named").eqNullSafe(F.col("lang"))).select("document_id", "lang", "confidence")
