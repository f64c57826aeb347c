"""Variant spellings of one person's or organisation's name (problem 2).

Method: trie join. The distinct words of names are sharded by what is left when a
letter is taken out (words at one edit share such a rest), each shard is a trie, and
a Levenshtein automaton (with transposition) walks it for every word to enumerate
the neighbours within one edit. A person's name is a family name with a given name,
nickname or initial; an organisation's is a house name with the words of its trade.
Names are linked if their words, in whatever order they stood, are neighbours one
by one: where nothing marks a family name, both orders of the words are weighed by
how often all names use them as family and as given names.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.components import components
from quern.tables import materialise

KINDS = ("PERSON", "ORGANIZATION")
#: Words shorter than this have no neighbours; one of two neighbours must be longer.
LEAST = 4
#: How much better the other order of a name's words must be than the common one.
SWAP = 4.0

#: Titles and ranks before personal names.
TITLES = frozenset("dr prof professor mr mrs ms miss sir maj major capt captain col colonel ltc lt lieutenant gen general sgt sergeant cpl cmdr adm ing eng rev hon jr sr".split())
#: English given names with their short forms.
SHORT_FORMS = {
    "alexander": "alex sandy", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny", "charles": "chuck charlie", "christopher": "chris kit",
    "daniel": "dan danny", "deborah": "deb debbie debby", "donald": "don", "edward": "ed eddie ted ned", "elizabeth": "liz beth betty eliza lizzie",
    "frederick": "fred freddie freddy", "gregory": "greg", "jacqueline": "jackie", "james": "jim jimmy", "jennifer": "jen jenny", "john": "jack johnny", "joseph": "joe joey",
    "katherine": "kate kathy katie kat", "kenneth": "ken kenny", "lawrence": "larry", "margaret": "peggy maggie meg marge", "matthew": "matt", "michael": "mike mick mickey",
    "nicholas": "nick nicky", "patricia": "pat patty trish tricia", "peter": "pete", "philip": "phil", "rebecca": "becky becca", "richard": "dick rick rich ricky",
    "robert": "bob rob bobby robbie", "ronald": "ron", "samuel": "sam sammy", "stephen": "steve", "susan": "sue susie", "theodore": "ted teddy theo", "thomas": "tom tommy",
    "timothy": "tim timmy", "victoria": "vicky vicki tori", "walter": "walt", "william": "bill will billy willy",
}
#: Legal forms and articles that don't tell organisations apart.
LEGAL = frozenset("the ltd limited co company inc incorporated llc plc gmbh ag sa bv".split())
#: Short forms of words for kinds of organisation.
SHORT_WORDS = {
    "corp": "corporation", "dpt": "depot", "dept": "department", "rsch": "research", "ctr": "center", "centre": "center", "engr": "engineering", "eng": "engineering", "sys": "systems",
    "lab": "laboratory", "tech": "technologies", "inst": "institute", "mfg": "manufacturing", "cmd": "command", "wks": "works", "labs": "laboratory", "univ": "university", "intl": "international",
}
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*\.?")
LONG_FORMS: dict[str, tuple[str, ...]] = {}
for _full, _shorts in SHORT_FORMS.items():
    for _s in _shorts.split():
        LONG_FORMS[_s] = (*LONG_FORMS.get(_s, ()), _full)


def person(name: str) -> tuple[str, str, str] | None:
    """(family, given, initial) of a personal name, lower-cased; given is empty where only an initial stands.

    The family name stands last, before a comma, or in capitals among words
    that aren't. Titles and middle names are left out. None without a family name.
    """
    p = person_in_order(name)
    return p and p[:3]


def person_in_order(name: str) -> tuple[str, str, str, bool] | None:
    """As `person`, with whether the name is two plain words of which nothing tells which is the family name."""
    s = unicodedata.normalize("NFKC", name)
    before, comma, after = s.partition(",")
    ws = [w.rstrip(".") for w in WORD.findall(s)]
    # Two capitals at the end are initials, whatever title they may be elsewhere.
    keep = [w for i, w in enumerate(ws) if w.lower() not in TITLES or (i and i == len(ws) - 1 and len(w) == 2 and w.isupper())]
    if not keep:
        return None
    full = [w for w in keep if len(w) > 1]
    if not full:
        return None
    head = [w.rstrip(".") for w in WORD.findall(before) if w.rstrip(".").lower() not in TITLES]
    capitals = [w for w in full if w.isupper() and (len(w) > 3 or (len(w) == 3 and w is full[0]))]
    if comma and head and WORD.findall(after):
        family = head[-1]
    elif len(capitals) == 1 and len(capitals) < len([w for w in full if len(w) > 3] or [0, 0]) or (len(capitals) == 1 and all(len(w) < 4 for w in full if w is not capitals[0])):
        family = capitals[0]
    elif len(full) > 1 and len(full[-1]) < 4 and full[-1].isupper():
        family = next(w for w in reversed(full) if w is not full[-1])
    else:
        family = full[-1]
    rest = list(keep)
    rest.remove(family)
    given = next((w for w in rest if len(w) > 1 and not (len(w) < 4 and w.isupper() and not any(x.isupper() and len(x) > 3 for x in rest))), "")
    first = next((w[0] for w in rest), "")
    return family.lower(), given.lower(), (given or first)[:1].lower(), not comma and len(capitals) != 1 and len(keep) == len(full) == 2 and bool(given)


def organisation(name: str) -> list[str]:
    """The telling words of an organisation's name, lower-cased, short forms of known words written out; a short form with a full stop keeps it."""
    s = re.sub(r"\([^)]*\)", " ", unicodedata.normalize("NFKC", name))
    out = []
    for w in WORD.findall(s):
        low = w.lower()
        bare = low.rstrip(".")
        if bare in LEGAL or len(bare) < 2:
            continue
        out.append(SHORT_WORDS.get(bare, low if low.endswith(".") and len(bare) > 2 else bare))
    return out


class Automaton:
    """Levenshtein automaton of a word for one edit, a transposition counting as one; states are sets of (position, edits, swapping)."""

    def __init__(self, word: str):
        self.word, self.n = word, len(word)
        self.start = self._close({(0, 0, False)})

    def _close(self, states: set[tuple[int, int, bool]]) -> frozenset[tuple[int, int, bool]]:
        return frozenset(states | {(i + 1, 1, False) for i, e, t in states if not e and not t and i < self.n})

    def step(self, states: frozenset[tuple[int, int, bool]], c: str) -> frozenset[tuple[int, int, bool]]:
        out: set[tuple[int, int, bool]] = set()
        for i, e, swapping in states:
            if swapping:
                if self.word[i] == c:
                    out.add((i + 2, 1, False))
                continue
            if i < self.n and self.word[i] == c:
                out.add((i + 1, e, False))
            if not e:
                out.add((i, 1, False))
                if i < self.n:
                    out.add((i + 1, 1, False))
                if i + 1 < self.n and self.word[i + 1] == c:
                    out.add((i, 1, True))
        return self._close(out)

    def accepts(self, states: frozenset[tuple[int, int, bool]]) -> bool:
        return any(i == self.n and not t for i, _, t in states)


def trie_neighbours(words: list[str]) -> list[tuple[str, str]]:
    """All (word, other) of a list of distinct words at distance one, both ways."""
    trie: dict = {}
    for w in words:
        node = trie
        for c in w:
            node = node.setdefault(c, {})
        node[""] = w
    out = []
    for w in words:
        auto = Automaton(w)
        stack = [(trie, auto.start)]
        while stack:
            node, states = stack.pop()
            other = node.get("")
            if other is not None and other != w and auto.accepts(states):
                out.append((w, other))
            for c, child in node.items():
                if c:
                    ahead = auto.step(states, c)
                    if ahead:
                        stack.append((child, ahead))
    return out


def _shards(word: str) -> list[str]:
    """Shard keys: the word, and what is left of it without each of its letters; words at distance one share a key, and few words share any."""
    return [word, *{word[:i] + word[i + 1 :] for i in range(len(word))}] if len(word) >= LEAST else []


def neighbours(words: DataFrame) -> DataFrame:
    """(kind, word, near) of all words of `words` (kind, word) at distance one, both ways, by the sharded trie join."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, w, s) for k, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for s in _shards(w)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1, 2)], names=["kind", "word", "shard"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[str, str, str]] = []
        last, own = None, []

        def close() -> None:
            if len(own) > 1:
                found.extend((last[0], a, b) for a, b in trie_neighbours(own))

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in range(3)], names=["kind", "word", "near"])

        for batch in batches:
            for k, w, s in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))):
                if (k, s) != last:
                    close()
                    last, own = (k, s), []
                own.append(w)
            if len(found) > 100_000:
                yield out()
                found.clear()
        close()
        yield out()

    spark = words.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = words.select("kind", "word").distinct().mapInArrow(shard, "kind string, word string, shard string")
    return spread.repartition(parts, "kind", "shard").sortWithinPartitions("kind", "shard").mapInArrow(join, "kind string, word string, near string").distinct()


def spellings(parts: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Distinct (kind, name) of the given (table, name column, type column); null and blank names are none. Repeats leave in each task."""
    out = None
    for df, name, kind in parts:
        own = df.select(F.col(kind).alias("kind"), F.col(name).alias("name")).where(F.col("kind").isin(*KINDS) & F.col("name").rlike("\\S"))
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def _parsed(names: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for kind, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if kind == "PERSON":
                    p = person_in_order(name)
                    if p:
                        rows.append((kind, name, *p, []))
                else:
                    ws = organisation(name)
                    if ws:
                        rows.append((kind, name, None, None, None, None, ws))
            kinds = [pa.string()] * 5 + [pa.bool_(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["kind", "name", "family", "given", "initial", "unmarked", "words"])

    rows = materialise(names.select("kind", "name").mapInArrow(run, "kind string, name string, family string, given string, initial string, unmarked boolean, words array<string>"))
    return materialise(_in_order(rows).drop("unmarked"))


def _in_order(parsed: DataFrame) -> DataFrame:
    """`parsed` with the words of unmarked names in the order that all names' use of them speaks for."""
    people = parsed.where("kind = 'PERSON' AND given <> ''")
    uses = people.select(F.col("family").alias("w"), F.lit(1).alias("f")).unionAll(people.select("given", F.lit(0)))
    uses = uses.groupBy("w").agg((F.sum("f") + 0.5).alias("f"), (F.sum(1 - F.col("f")) + 0.5).alias("g"))
    # Only words used both ways can speak for another order; names without one stay as they are. A name has no vote on itself.
    both = uses.where("f > 1 AND g > 1")
    doubtful = parsed.where("unmarked").select("family", "given").distinct()
    doubtful = doubtful.join(both.select(F.col("w").alias("family")), "family", "left_semi").union(doubtful.join(both.select(F.col("w").alias("given")), "given", "left_semi").select("family", "given")).distinct()
    a, b = uses.select(F.col("w").alias("family"), F.col("f").alias("ff"), F.col("g").alias("fg")), uses.select(F.col("w").alias("given"), F.col("f").alias("gf"), F.col("g").alias("gg"))
    turned = doubtful.join(a, "family").join(b, "given").where(F.col("gf") * F.col("fg") > SWAP * (F.col("ff") - 1) * (F.col("gg") - 1)).select("family", "given", F.lit(True).alias("turn"))
    rows = parsed.join(turned, ["family", "given"], "left").withColumn("turn", F.coalesce("turn", F.lit(False)) & F.coalesce("unmarked", F.lit(False)))
    turn = lambda yes, no: F.when(F.col("turn"), F.col(yes)).otherwise(F.col(no))
    return rows.select("kind", "name", turn("given", "family").alias("family"), turn("family", "given").alias("given"), F.when(F.col("turn"), F.left("family", F.lit(1))).otherwise(F.col("initial")).alias("initial"), "unmarked", "words")


def _with_self(near: DataFrame, words: DataFrame, kind: str) -> DataFrame:
    """(word, near) of one kind, each word being near itself."""
    return near.where((F.col("kind") == kind) & (F.greatest(F.length("word"), F.length("near")) > LEAST)).select("word", "near").unionByName(words.where(F.col("kind") == kind).select("word", F.col("word").alias("near"))).distinct()


def _persons(parsed: DataFrame, words: DataFrame, near: DataFrame) -> DataFrame:
    """(name, entity) of personal names."""
    people = parsed.where("kind = 'PERSON'")
    spark = parsed.sparkSession
    forms = spark.createDataFrame([(s, f) for s, fs in LONG_FORMS.items() for f in fs], "short string, full string")  # a fixed list
    families = materialise(_with_self(near, words, "family"))
    # What a given name may stand for: itself or its neighbours, short forms written out.
    own = _with_self(near, words, "given").join(F.broadcast(forms), F.col("near") == F.col("short"), "left")
    stands = own.select(F.col("word").alias("given"), F.coalesce("full", "near").alias("full"), (F.col("full").isNotNull()).cast("int").alias("written")).groupBy("given").agg(F.collect_set("full").alias("fulls"), F.collect_set(F.when(F.col("written") == 1, F.col("full"))).alias("long"))
    # A short form of several names is ambiguous; its spelling is no full name itself.
    given = stands.select("given", F.when(F.size("long") > 0, F.col("long")).otherwise(F.col("fulls")).alias("fulls"), (F.size("long") > 1).alias("ambiguous"))
    profiles = materialise(people.where("given <> ''").select("family", "given").distinct().join(given, "given").select("family", "given", F.concat_ws(" ", "family", "given").alias("node"), "fulls", "ambiguous"))
    sure = profiles.where("NOT ambiguous").select("node", "family", F.explode("fulls").alias("full"))
    left = sure.join(families.withColumnRenamed("word", "family"), "family").select(F.col("node").alias("a"), F.col("near").alias("family"), "full")
    edges = left.join(sure.select(F.col("node").alias("b"), "family", "full"), ["family", "full"]).where("a < b").select("a", "b")
    settled = materialise(components(profiles.select("node"), edges))
    known = profiles.join(settled, "node").select("family", "given", "node", "component", "fulls", "ambiguous")

    def attach(rows: DataFrame, targets: DataFrame) -> DataFrame:
        """(node, component) of `rows` (node, family, mark) that have one target component: with their family name, else with a neighbour of it."""
        found = rows.join(families.withColumnRenamed("word", "family"), "family").select("node", "mark", F.col("near").alias("family"), (F.col("near") == F.col("family")).cast("int").alias("same")).join(targets, ["family", "mark"])
        own = F.when(F.col("same") == 1, F.col("component"))
        per = found.groupBy("node").agg(F.min(own).alias("lo"), F.max(own).alias("hi"), F.min("component").alias("first"), F.max("component").alias("last"))
        return per.select("node", F.when(F.col("lo") == F.col("hi"), F.col("lo")).when(F.col("lo").isNull() & (F.col("first") == F.col("last")), F.col("first")).alias("component")).where("component IS NOT NULL")

    full = known.where("NOT ambiguous").select("family", F.explode("fulls").alias("mark"), "component").distinct()
    short = known.where("ambiguous").select("node", "family", F.explode("fulls").alias("mark"))
    moved = attach(short, full)
    known = materialise(known.join(moved.withColumnRenamed("component", "to"), "node", "left").select("family", "given", "node", F.coalesce("to", "component").alias("component"), "fulls", "ambiguous", F.col("to").isNotNull().alias("moved")))
    letters = known.where("NOT ambiguous OR NOT moved").select("family", F.explode("fulls").alias("full"), "component").select("family", F.substring("full", 1, 1).alias("mark"), "component").distinct()
    lone = people.where("given = ''").select("family", "initial").distinct().select(F.concat_ws(" ", "family", F.concat("initial", F.lit("."))).alias("node"), "family", F.col("initial").alias("mark"))
    placed = lone.select("node").join(attach(lone.where("mark <> ''"), letters), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    every = known.select("node", "component").unionByName(placed)
    keyed = people.select("name", F.concat_ws(" ", "family", F.when(F.col("given") != "", F.col("given")).otherwise(F.concat("initial", F.lit(".")))).alias("node"))
    return keyed.join(every, "node").select("name", F.col("component").alias("entity"))


def _organisations(parsed: DataFrame, words: DataFrame, near: DataFrame) -> DataFrame:
    """(name, entity) of organisations' names."""
    firms = parsed.where("kind = 'ORGANIZATION'").select("name", "words")
    counts = words.where("kind = 'word'").select("word", "n")
    pairs = _with_self(near, words, "word")
    weighed = pairs.join(counts.select(F.col("word").alias("near"), "n"), "near")
    # The most used word among a word's neighbours: what it is a slip of, if it is one.
    best = weighed.groupBy("word").agg(F.max(F.struct("n", "near")).alias("b")).select("word", F.col("b.n").alias("n"), F.col("b.near").alias("common"))
    # Words cut short with a full stop: the most used word that begins so.
    cut = counts.where("word LIKE '%.'").select("word", F.expr("rtrim('.', word)").alias("head"))
    begins = counts.where("word NOT LIKE '%.' AND length(word) > 3").select("word", "n", F.explode(F.sequence(F.lit(3), F.lit(6))).alias("k")).where("length(word) > k").select(F.expr("substring(word, 1, k)").alias("head"), "word", "n").groupBy("head").agg(F.max(F.struct("n", "word")).alias("b"))
    whole = cut.join(begins, "head").select("word", F.col("b.n").alias("n"), F.col("b.word").alias("common"))
    reading = materialise(best.join(whole.select("word"), "word", "left_anti").unionByName(whole))
    each = firms.select("name", F.posexplode("words").alias("at", "word")).join(reading, "word")
    # The house name is the word whose reading is used least.
    w = Window.partitionBy("name").orderBy("n", F.desc(F.length("word")), "at")
    ranked = materialise(each.withColumn("r", F.row_number().over(w)))
    rest = ranked.where("r > 1").groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("common")), " ").alias("rest"))
    profiles = ranked.where("r = 1").select("name", F.col("word").alias("house")).join(rest, "name", "left").select("name", "house", F.coalesce("rest", F.lit("")).alias("rest"))
    profiles = materialise(profiles.withColumn("node", F.concat_ws(" / ", "house", "rest")))
    nodes = profiles.select("node", "house", "rest").distinct()
    edges = nodes.join(pairs, F.col("house") == F.col("word")).select(F.col("node").alias("a"), F.col("near").alias("house"), "rest").join(nodes.select(F.col("node").alias("b"), "house", "rest"), ["house", "rest"]).where("a < b").select("a", "b")
    return profiles.select("name", "node").join(components(nodes.select("node"), edges), "node").select("name", F.col("component").alias("entity"))


def entities(names: DataFrame) -> DataFrame:
    """(kind, name, entity): the distinct names of `names` (kind, name) with the entity each names.

    Names without letters are left out. An initial, or a short form of several
    given names, joins the one entity it fits; where several fit, it stays by
    itself, as it would wrongly link them. Family or house names alone don't
    link: the given name or the words of the trade must agree too.
    """
    parsed = _parsed(names)
    tokens = parsed.where("kind = 'PERSON'").select(F.lit("family").alias("kind"), F.col("family").alias("word"))
    tokens = tokens.unionByName(parsed.where("kind = 'PERSON' AND given <> ''").select(F.lit("given").alias("kind"), F.col("given").alias("word")))
    tokens = tokens.unionByName(parsed.where("kind = 'ORGANIZATION'").select(F.lit("word").alias("kind"), F.explode("words").alias("word")))
    words = materialise(tokens.groupBy("kind", "word").agg(F.count("*").alias("n")))
    near = materialise(neighbours(words))
    people = _persons(parsed, words, near).select(F.lit("PERSON").alias("kind"), "name", "entity")
    return people.unionByName(_organisations(parsed, words, near).select(F.lit("ORGANIZATION").alias("kind"), "name", "entity"))


def variant_pairs(named: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b: different spellings of one entity."""
    a, b = named.alias("a"), named.alias("b")
    return a.join(b, (F.col("a.kind") == F.col("b.kind")) & (F.col("a.entity") == F.col("b.entity")) & (F.col("a.name") < F.col("b.name"))).select(F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b")).distinct()
