import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import lookalike as L

LATTICE = L.Lattice({a + b: 5 for a in "\nabcdeхор" for b in "abcdeхор\n"})
SWAP = {"a": "а", "c": "с", "e": "е", "o": "ο", "p": "р", "B": "Β", "T": "Т", "i": "і"}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aceopBTi dw-5.,\n", max_size=60), st.randoms(use_true_random=False))
def test_disguises_have_one_form(text, rng):
    def odd(c):
        kind = rng.random()
        if c in SWAP and kind < 0.3:
            return SWAP[c]
        if c == " ":
            return rng.choice([" ", " ", " ", " "])
        if c == "-":
            return rng.choice(["-", "‐", "‑"])
        if c.isalnum() and kind < 0.5:
            return chr(ord(c) + 0xFEE0)
        return c + rng.choice(["", "", "​", "⁠", "­", "﻿"])

    assert LATTICE.canonical("".join(map(odd, text))) == LATTICE.canonical(text) == text


def test_different_looks_stay_different():
    forms = ["m2", "m²", "1/2", "½", "O0", "00", "l1", "I1", "a b", "a  b", "a\nb", "A b", "a—b", "a-b", "👩‍🔧", "👩🔧", "x.", "x,"]
    assert len({LATTICE.canonical(f) for f in forms}) == len(forms)


def test_same_looks():
    for a, b in (("µm", "μm"), ("Å", "Å"), ("ﬁlter", "filter"), ("café", "café"), ("Ω", "Ω"), ("ΝΧ-5", "NX-5"), ("й", "й"), ("​", "")):
        assert LATTICE.canonical(a) == LATTICE.canonical(b)
    assert LATTICE.canonical("В отчёте") == "В отчёте"


def test_pairs(spark):
    rows = [("1", "Type AB", 1), ("2", "Type АВ", 1), ("3", "Type AB", 1), ("4", None, 1), ("5", "", 1), ("6", "​", 1), ("2", "other", 0), ("7", "Type AB ", 1), (None, "Type AB", 1)]
    df = spark.createDataFrame(rows, "id string, t string, v int")
    got = sorted(tuple(r) for r in L.same_look_pairs(df, "id", "t", LATTICE, "v").collect())
    assert got == [("1", "2"), ("2", "3")]
    assert L.same_look_pairs(df.where("false"), "id", "t", LATTICE, "v").count() == 0
    assert L.bigram_counts(df.where("false"), "t") == {}
    assert L.bigram_counts(df, "t")["\nT"] == 5


RUSSIAN = "после проверки оператор записывает результат в журнал и сверяет его с отчётом о работе насоса роса сера раса хор оса ухо".split()
#: Words that look-alikes alone can write in either script, as they were written.
EITHER = "роса сера раса хор оса ухо scope race copy pace space core".split()
LATIN_ALIKE = str.maketrans("аеорсухі", "aeopcyxi")


def restored(lattice):
    """Share of such words that come back as written from Russian texts after all their letters with a Latin look-alike were exchanged for it."""
    rng, good, n = random.Random(3), 0, 0
    for _ in range(150):
        ws = [rng.choice(EITHER if rng.random() < 0.4 else RUSSIAN[:14]) for _ in range(12)]
        got = lattice.canonical(" ".join(ws + ["журнал"]).translate(LATIN_ALIKE)).split()
        good += sum(a == b for a, b in zip(got, ws) if b in EITHER)
        n += sum(b in EITHER for b in ws)
    return good / n


def counts(words):
    out = {}
    for w in words:
        w = L.EDGE + L.plain(w) + L.EDGE
        for i in range(len(w) - 1):
            out[w[i : i + 2]] = out.get(w[i : i + 2], 0) + 1
    return out


def test_scores_restore_what_was_written():
    english = "the operator checks a pump and the cooling loop so that no part of it can come loose over a course".split()
    with_scores, without = restored(L.Lattice(counts((RUSSIAN + EITHER[6:] + english) * 9))), restored(L.Lattice({}))
    assert with_scores >= 0.85 and without < with_scores - 0.2, (with_scores, without)


def test_a_word_of_another_script_stays_in_it_where_scores_say_so():
    lattice = L.Lattice(counts(["cope", "core", "race", "pace", "scope"] * 50 + RUSSIAN * 5))
    assert lattice.canonical("Насос scope работает") == "Насос scope работает"
    assert lattice.canonical("Насос роса работает") == "Насос роса работает"
    assert lattice.canonical("Насос poca работает") == "Насос роса работает"


def test_more_scripts():
    assert LATTICE.canonical("Ꭺ-5 ΤᎬЅΤ") == "A-5 TEST" and LATTICE.canonical("իսկ օր") == "իսկ օր"


def test_a_hot_form_is_dealt_to_parts(spark):
    rows = [(f"{i:03}", "Type AB", 1) for i in range(200)] + [("x", "Type АВ", 1), ("y", "Type ΑВ", 1)]
    df = spark.createDataFrame(rows, "id string, t string, v int")
    got = [tuple(r) for r in L.same_look_pairs(df, "id", "t", LATTICE, "v").collect()]
    assert sorted(got) == sorted([(f"{i:03}", o) for i in range(200) for o in "xy"] + [("x", "y")])
