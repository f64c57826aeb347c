"""One consistent form for texts that look the same (problem 4).

Method: texts are normalised for compatibility as far as the look stays (wide
and narrow forms, joined letters, spaces of a fixed kind, fixed hyphens), and
ignorable characters are deleted. Every run of letters is then a lattice: each
letter that has look-alikes in other scripts may stand for any of them. Viterbi
finds the best path under letter bigram scores of each script, counted over the
whole corpus, where a change of script within a run has a price; a run that can
stand in several scripts is read in each, and the cheapest reading counts, where a
script that the runs around don't have (beside digits, as in part numbers: any but
Latin) has a price too. A text that Latin can write throughout is read as Latin. So rare words go with their neighbours, while a word that
only one script knows is read in that script in any neighbourhood.

The result depends on a text's look alone: the lattice has no memory of which
look-alike stood there. So texts that look the same get the same form whatever the
scores are, and `same_look_pairs` doesn't depend on them; they decide which form
it is, and so whether the form is the one that was written.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.tables import materialise

#: Letters that print alike, as Latin, Greek, Cyrillic, Armenian, Cherokee (a blank where a script has none).
ALIKE = (
    "AΑА Ꭺ", "BΒВ Ᏼ", "C С Ꮯ", "D   Ꭰ", "EΕЕ Ꭼ", "G   Ꮐ", "HΗН Ꮋ", "IΙІ  ", "J Ј Ꭻ", "KΚК Ꮶ", "L   Ꮮ", "MΜМ Ꮇ", "NΝ   ", "OΟОՕ ", "PΡР Ꮲ", "R   Ꭱ", "S ЅՏᏚ", "TΤТ Ꭲ",
    "V   Ꮩ", "W   Ꮃ", "XΧХ  ", "YΥҮ  ", "ZΖ  Ꮓ",
    "a а  ", "c с  ", "e е  ", "g  ց ", "h һհ ", "i і  ", "j јյ ", "l ӏ  ", "n  ո ", "oοоօ ", "p р  ", "s ѕ  ", "u  ս ", "x х  ", "y у  ", "d ԁ  ", "q ԛզ ", "w ԝ  ",
    " ΓГ  ", " ΠП  ", " ΦФ  ", " ΛЛ  ",
)
SCRIPTS = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "CHEROKEE")
OPTIONS: dict[str, tuple[tuple[int, str], ...]] = {c: own for group in ALIKE for own in [tuple((k, x) for k, x in enumerate(group) if x != " ")] for _, c in own}
#: Compatibility forms that look like what they stand for.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")
HYPHENS = {0x2010: "-", 0x2011: "-"}
#: Nats that a change of script costs; more than any bigram score of a run of ordinary length can make up.
CHANGE = 40.0
#: Nats that a bigram never seen costs.
UNSEEN = 14.0
#: Nats that a script costs which the runs around don't have, and any but Latin beside digits.
APART, CODE = 8.0, 30.0
#: Parts that the copies of one spelling are dealt to before they are paired.
FAN = 16
RUN = re.compile(r"[^\W\d_][^\W\d_\u0300-\u036f]*(?:[\u0300-\u036f]+[^\W\d_\u0300-\u036f]*)*")
EMOJI = re.compile("[\u2600-\u27bf\U0001f000-\U0001faff]")
#: Scripts in which joiners change the shape of letters.
JOINING = re.compile("[\u0600-\u08ff\u0900-\u0dff\u1000-\u109f\u1780-\u18af]")
EDGE = "\n"


class _Table(dict):
    """Code point to its replacement, filled as characters come up."""

    def __missing__(self, code: int) -> str | int:
        c = chr(code)
        form = unicodedata.decomposition(c)
        out: str | int = code
        if form.startswith(SAME_LOOK):
            plain = "".join(chr(int(x, 16)) for x in form.split()[1:])
            if plain == " " or not plain.startswith(" "):
                out = plain.translate(self)
        if code in (0x1680, 0x205F):
            out = " "
        if unicodedata.category(c) == "Cf" or 0xFE00 <= code <= 0xFE0F or code in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
            out = ""
        self[code] = out
        return out


TABLE = _Table(HYPHENS)


def plain(text: str) -> str:
    """The compatibility stage: decomposed text without ignorable characters.

    A zero-width joiner or a variation selector stays beside an emoji, and
    joiners stay beside letters whose shape they change.
    """
    if EMOJI.search(text) or JOINING.search(text):
        out = []
        for i, c in enumerate(text):
            near = text[max(0, i - 2) : i] + text[i + 1 : i + 2]
            if c in "\u200d\ufe0e\ufe0f" and EMOJI.search(near) or c in "\u200c\u200d" and JOINING.search(near):
                out.append(c)
            else:
                out.append(c.translate(TABLE))
        return unicodedata.normalize("NFD", "".join(out))
    return unicodedata.normalize("NFD", text.translate(TABLE))


def script(c: str) -> int | None:
    """The number in SCRIPTS of a letter's script, None for other characters."""
    name = unicodedata.name(c, "")
    return next((k for k, s in enumerate(SCRIPTS) if name.startswith(s)), None)


class Lattice:
    """Canonical forms of runs of letters under given bigram scores."""

    def __init__(self, bigrams: dict[str, int]):
        first: Counter[str] = Counter()
        for pair, n in bigrams.items():
            first[pair[0]] += n
        self.cost = {pair: math.log(first[pair[0]] / n) for pair, n in bigrams.items()}
        self.scripts: dict[str, tuple[tuple[int | None, str], ...]] = {}
        self.known: dict[str, tuple[str | None, tuple[tuple[int, float, str], ...]]] = {}
        self.latin: dict[str, bool] = {}

    def options(self, c: str) -> tuple[tuple[int | None, str], ...]:
        if c not in self.scripts:
            self.scripts[c] = OPTIONS.get(c) or ((script(c), c),)
        return self.scripts[c]

    def path(self, run: str, allowed: int | None = None) -> tuple[float, str]:
        """Viterbi: the cheapest path of `run`, all in one script if `allowed` names it."""
        best: dict[tuple[int | None, str], tuple[float, str]] = {(allowed, EDGE): (0.0, "")}
        for c in run:
            ahead: dict[tuple[int | None, str], tuple[float, str]] = {}
            for k, x in self.options(c):
                if allowed is not None and k is not None and k != allowed:
                    continue
                for (j, y), (cost, text) in best.items():
                    step = cost + self.cost.get(y + x, UNSEEN) + (CHANGE if None not in (j, k) and j != k else 0.0)
                    at = (j if k is None else k, x)
                    if at not in ahead or (step, text + x) < ahead[at]:
                        ahead[at] = (step, text + x)
            best = ahead
        ends = [(cost + self.cost.get(text[-1:] + EDGE, UNSEEN), text) for cost, text in best.values()]
        return min(ends, default=(math.inf, run))

    def resolve(self, run: str) -> tuple[str | None, tuple[tuple[int, float, str], ...]]:
        """(form, ()) if the look decides; else (None, (script, cost, form) of each script that fits)."""
        if run not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            sets = [{k for k, _ in self.options(c)} for c in run]
            fits = [k for k in range(len(SCRIPTS)) if all(k in s or None in s for s in sets)]
            if all(None in s for s in sets):
                self.known[run] = (run, ())
            elif len(fits) > 1:
                self.known[run] = (None, tuple((k, *self.path(run, k)) for k in fits))
            else:
                self.known[run] = (self.path(run, fits[0] if fits else None)[1], ())
        return self.known[run]

    def is_latin(self, form: str) -> bool:
        if form not in self.latin:
            if len(self.latin) > 200_000:
                self.latin.clear()
            self.latin[form] = all(script(c) in (0, None) for c in form)
        return self.latin[form]

    def canonical(self, text: str) -> str:
        """The one form of all texts that look like `text`; a text that can be read as Latin throughout is."""
        if text.isascii():
            return text.translate(TABLE)
        s = plain(text)
        runs = [(m.start(), m.end(), m.group()) for m in RUN.finditer(s)]
        found = [self.resolve(r) for _, _, r in runs]
        if all(f is None and fits[0][0] == 0 or f is not None and self.is_latin(f) for f, fits in found):
            found = [(f or fits[0][2], ()) for f, fits in found]
        around, near = [None] * len(runs), None
        for order in (range(len(runs)), range(len(runs) - 1, -1, -1)):
            near = None
            for i in order:
                form = found[i][0]
                if form is not None:
                    near = next((k for k in map(script, form) if k is not None), near)
                elif around[i] is None:
                    around[i] = near
        out, last = [], 0
        for i, (start, end, _) in enumerate(runs):
            form, fits = found[i]
            if form is None:
                code = s[start - 1 : start].isdigit() or s[end : end + 1].isdigit() or (s[end : end + 1] == "-" and s[end + 1 : end + 2].isdigit()) or (s[start - 1 : start] == "-" and s[start - 2 : start - 1].isdigit())
                near = 0 if around[i] is None else around[i]
                form = min((c + (CODE if code and k else 0.0) + (APART if not code and k != near else 0.0), k, f) for k, c, f in fits)[2]
            out += [s[last:start], form]
            last = end
        out.append(s[last:])
        return unicodedata.normalize("NFC", "".join(out))


def bigram_counts(texts: DataFrame, column: str) -> dict[str, int]:
    """Counts of letter bigrams (with run edges) within one script over all texts.

    Counted in each task first; the result is bounded by the square of the
    three alphabets' sizes, whatever the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            runs: Counter[str] = Counter()
            for s in batch.column(0).to_pylist():
                if s:
                    runs.update(RUN.findall(s if s.isascii() else plain(s)))
            for run, n in runs.items():
                whole = EDGE + run + EDGE
                for i in range(len(whole) - 1):
                    total[whole[i : i + 2]] += n
        kept = {}
        for pair, n in total.items():
            kinds = {script(c) for c in pair if c != EDGE and not unicodedata.combining(c)}
            if None not in kinds and len(kinds) < 2:
                kept[pair] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], names=["pair", "n"])

    rows = texts.select(column).mapInArrow(count, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    return {r.pair: r.n for r in rows.collect()}


def canonical_texts(df: DataFrame, column: str, lattice: Lattice, out: str = "canonical") -> DataFrame:
    """`df` with the canonical form of `column` added as `out`.

    Null stays null, an empty text stays empty, a text of ignorable characters
    alone becomes empty. An ASCII text without control characters is its own
    form (its letters fit one script, Latin, and others only where all do), so
    such texts don't travel to Python.
    """
    sent = df.sparkSession.sparkContext.broadcast(lattice)  # bounded: bigrams of three alphabets

    @F.pandas_udf("string")
    def canonical(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda s: None if s is None else sent.value.canonical(s))

    odd = F.col(column).rlike("[^\\x00-\\x7F]")
    return df.withColumn(out, F.when(odd, canonical(F.when(odd, F.col(column)))).otherwise(F.col(column)))


def same_look_pairs(df: DataFrame, key: str, column: str, lattice: Lattice, *newest: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: records whose texts differ as stored and have one canonical form.

    Of several rows of one key the one with the greatest `newest` counts. Null
    and empty texts pair with nothing. Rows are shuffled as hashes; forms that
    all records write alike leave before the join, so a hot group of exact
    copies makes no pairs and no work. Spellings are paired as classes first, and
    the copies of the commoner of two are dealt to FAN parts.
    """
    rows = canonical_texts(df.select(F.col(key).alias("id"), F.col(column).alias("stored"), *(F.col(c).alias(f"at_{i}") for i, c in enumerate(newest))).where(F.col("id").isNotNull()), "stored", lattice)
    mark = F.struct(*(c for c in rows.columns if c.startswith("at_")), F.unhex(F.md5("canonical")).alias("form"), F.xxhash64("stored").alias("spelling"), (F.col("canonical") != "").alias("some"))
    marks = materialise(rows.select("id", mark.alias("m")).groupBy("id").agg(F.max("m").alias("m")).where("m.some").select("id", "m.form", "m.spelling"))
    spellings = marks.groupBy("form", "spelling").agg(F.count("*").alias("n"))
    several = spellings.groupBy("form").agg(F.count("*").alias("k")).where("k > 1").select("form")
    odd = materialise(spellings.join(several, "form", "left_semi"))
    a, b = odd.select("form", F.struct("n", "spelling").alias("a")), odd.select("form", F.struct("n", "spelling").alias("b"))
    # The commoner spelling of two is dealt to FAN parts, the rarer goes to each.
    two = materialise(a.join(b, "form").where("a > b").select("form", F.col("a.spelling").alias("often"), F.col("b.spelling").alias("rare")))
    parts = two.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(FAN - 1))))
    dealt = marks.select("form", F.col("spelling").alias("often"), F.pmod(F.xxhash64("id"), F.lit(FAN)).cast("int").alias("part"), F.col("id").alias("x")).join(parts, ["form", "often", "part"])
    other = marks.select("form", F.col("spelling").alias("rare"), F.col("id").alias("y")).join(two.select("form", "rare").distinct(), ["form", "rare"], "left_semi")
    pairs = dealt.join(other, ["form", "rare"])
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
