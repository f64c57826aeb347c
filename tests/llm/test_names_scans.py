import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import names as N
from quern.llm import scans as S


def damerau(a, b):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text(alphabet="abc", min_size=1, max_size=6), max_size=25))
def test_trie_join_is_exact(words):
    ws = sorted(words)
    assert set(N.trie_neighbours(ws)) == {(a, b) for a in ws for b in ws if a != b and damerau(a, b) == 1}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab", min_size=4, max_size=14), st.text(alphabet="ab", min_size=4, max_size=14))
def test_neighbours_share_a_shard(a, b):
    if a != b and damerau(a, b) == 1:
        assert set(N._shards(a)) & set(N._shards(b))


def test_order_of_words(spark):
    people = ["Robert Jones", "Jones, Robert", "JONES Robert", "Jones Robert", "Robert Miller", "Mary Jones", "Jones Mary", "Ann Jones", "Zed Quill"]
    got = entities(spark, people)
    assert ["JONES Robert", "Jones Robert", "Jones, Robert", "Robert Jones"] in got and ["Jones Mary", "Mary Jones"] in got and ["Zed Quill"] in got


def test_person_forms():
    want = ("kigovulo", "jackie", "j")
    for s in ("Jackie Kigovulo", "KIGOVULO Jackie", "Kigovulo, Jackie", "Maj. Jackie Kigovulo", "jackie kigovulo", " Jackie  Kigovulo", "Jackie B. Kigovulo"):
        assert N.person(s) == want, s
    for s in ("J. Kigovulo", "Kigovulo, J.", "Kigovulo JB", "Kigovulo MS"):
        assert N.person(s)[:2] == ("kigovulo", ""), s
    assert N.person("Dr.") is None and N.person("...") is None


def entities(spark, people, firms=()):
    rows = [("PERSON", n) for n in people] + [("ORGANIZATION", n) for n in firms]
    df = N.entities(spark.createDataFrame(rows, "kind string, name string"))
    groups = {}
    for r in df.collect():
        groups.setdefault((r.kind, r.entity), set()).add(r.name)
    return sorted(map(sorted, groups.values()))


def test_links(spark):
    people = ["Edward Kakivanbo", "Ted Kakivanbo", "E. Kakivanbo", "KAKIVANBO, Ed", "Edward Kakivnabo", "Rebecca Kakivanbo", "Theodore Viretraro", "Ted Viretraro", "Jen Rogugredu", "Jennifer Rogugrdeu", "J. Rogugredu", "Daniel Dosotrabi", "Deborah Dosotrabi", "D. Dosotrabi"]
    firms = ["Brevugeze Metrology Depot", "Brevugeze-Metrology Dpt", "Brevugeze Metr. Depot", "The Brevugrze Metrology Depot Inc.", "Depot, Brevugeze Metrology Ltd", "Brevugeze Optics Depot", "Mefolofi Power Works", "Mefolofi Guidance Works", "Zolokesu Metrology Lab", "Zolokesu Metrolgy Laboratory (ZML)"]
    got = entities(spark, people, firms)
    want = [
        ["E. Kakivanbo", "Edward Kakivanbo", "Edward Kakivnabo", "KAKIVANBO, Ed", "Ted Kakivanbo"], ["Rebecca Kakivanbo"], ["Ted Viretraro", "Theodore Viretraro"], ["J. Rogugredu", "Jen Rogugredu", "Jennifer Rogugrdeu"],
        ["Daniel Dosotrabi"], ["Deborah Dosotrabi"], ["D. Dosotrabi"],
        sorted(firms[:5]), ["Brevugeze Optics Depot"], ["Mefolofi Power Works"], ["Mefolofi Guidance Works"], sorted(firms[8:]),
    ]
    assert got == sorted(want)


def test_pairs_and_odd_rows(spark):
    df = spark.createDataFrame([("PERSON", "Ann Roe", 1), ("PERSON", "ROE Ann", 1), ("PERSON", "ROE Ann", 1), ("PERSON", None, 1), ("PERSON", "  ", 1), ("PERSON", "...", 1), ("RADAR", "Ann Roe", 1), (None, "x", 1)], "t string, n string, kind int")
    named = N.entities(N.spellings([(df, "n", "t"), (df, "n", "t")]))
    assert [tuple(r) for r in N.variant_pairs(named).collect()] == [("Ann Roe", "ROE Ann")]
    assert N.variant_pairs(N.entities(N.spellings([(df.where("false"), "n", "t")]))).count() == 0


CLEAN = ["The operator checks the cooling loop and the phase-locked receiver of the modern station", "The driver records the interval between the internal harness and the filter"] * 4
GLYPHS = (("0", "o"), ("c", "e"), ("1", "l"), ("cl", "d"), ("m", "in"))


def reader(words, pairs=GLYPHS):
    known = S.Vocabulary(words, sum(c for c, _ in words.values()))
    return S.Reader(known, (np.zeros((len(words), 4)), np.zeros((0, 4))), dict.fromkeys(pairs, 50))


READER = reader({w: (9, 1) for s in CLEAN for w in S.counted(s)} | {"modern": (9, 1)})
HEADS = S.Heads("jd-23805_coppervane_duplexer.pdf")


def repaired(text, page=3):
    return S.repair(text, page, HEADS, READER)


def test_repairs():
    assert repaired("The 0perator chccks the coo1ing loop") == ({"misread"}, "The operator checks the cooling loop")
    assert repaired("The opera- \ntor checks the phase-\nlocked recei¬\nver") == ({"broken_word"}, "The operator checks the phase-locked receiver")
    assert repaired("The opera-\nJD-23805\ntor checks\n- 3 -") == ({"broken_word", "running_head", "page_number"}, "The operator checks")
    assert repaired("COPPERVANE DUPLEXER | 3-2") == ({"running_head", "page_number"}, "")
    assert repaired("The clriver records\nthe mterval") == ({"misread"}, "The driver records the interval")


def test_what_is_no_noise():
    for text in ("(3)\nThe operator", "Step 3\nThe operator", "NOTE\nThe filter", "17\nThe operator", "part T44-9850A and B01-O5 / l0-S5", "The modern receiver", "Unbekannt und fremd"):
        assert repaired(text)[0] == set(), text
    assert repaired(None) == (set(), None) and repaired("") == (set(), "")
    assert S.repair("The operator", None, S.Heads(None), READER) == (set(), "The operator")


def test_paragraphs_are_reflowed():
    assert repaired("The operator\nchecks.\n\nThe driver\nrecords.")[1] == "The operator checks.\n\nThe driver records."


def test_skipgram_brings_exchangeable_words_together():
    rng = np.random.default_rng(0)
    n = 30
    counts = rng.integers(0, 3, (n, n)).astype(float)
    counts[0, 10:15] = counts[1, 10:15] = 60
    counts[2, 20:25] = 60
    w, _ = S.skipgram(counts + counts.T)
    cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    assert cos(w[0], w[1]) > cos(w[0], w[2])


def test_elements(spark):
    rows = [("a", "d", "text", "The 0perator checks", 1, 0.9, 1), ("a", "d", "text", "older", 1, 0.9, 0), ("b", "d", "table", "0perator", 1, 0.9, 1), ("c", "e", "text", "The 0perator", 1, None, 1), ("n", "d", "text", None, None, 0.9, 1)]
    el = spark.createDataFrame(rows, "id string, document_id string, element_type string, content_text string, page_number int, confidence double, v int").withColumn("updated_at", F.timestamp_seconds("v"))
    chunks = spark.createDataFrame([("d", "OCR "), ("e", "text"), (None, "ocr")], "document_id string, modality string")
    docs = spark.createDataFrame([("d", None)], "document_id string, filename string")
    scanned = S.scanned_documents(el, chunks, docs)
    assert [r.document_id for r in scanned.collect()] == ["d"]
    got = {(r.id, r["at"][-15:-13] and r.repaired): r.kinds for r in S.repair_elements(el, scanned, READER).collect()}
    assert got == {("a", "The operator checks"): ["misread"], ("a", "older"): got["a", "older"], ("n", None): []}
    assert S.repair_elements(el.where("false"), scanned, READER).count() == 0
    r = S.learn(el.withColumn("scanned", F.col("confidence").isNotNull()))
    assert isinstance(r, S.Reader) and S.learn(el.where("false").withColumn("scanned", F.lit(True))).known == {}
    assert S.recurring_lines(el).count() == S.recurring_lines(el.where("false")).count() == 0


def test_capitals_beside_digits_are_misread_words_or_codes():
    known = dict.fromkeys(("please", "clean", "configuration", "the", "pump", "valve"), (100, 0))
    own = reader(known)
    fix = lambda s: S.repair(s, None, S.Heads("X1_Manual.pdf"), own)[1]
    assert fix("P1ease (C1ean) the pump, C0nfiguration of THE VA1VE.") == "Please (Clean) the pump, Configuration of THE VALVE."
    for code in ("K4T9", "PN-C1ean", "C1ean/7", "B12", "A320x", "4711-P1ease"):
        assert fix(f"the pump {code} valve") == f"the pump {code} valve"


def test_difference_is_one_place():
    assert S.difference("recorcled", "recorded") == ("cl", "d") and S.difference("modem", "modern") == ("m", "rn")
    assert S.difference("fiter", "filter") == ("i", "il") and S.difference("filtter", "filter") == ("tt", "t")
    links = S.Links(["filter", "driver", "mixer"])
    assert links.near("clriver") == {1} and links.near("fi1ter") == {0} and links.near("station") == set()


SENTENCES = ["the operator checks the cooling loop before every start", "the driver records the interval of the filter in the log", "a technician replaced the filter of the cooling loop", "the second operator records the pressure in the log book", "the driver checks the pressure of the hydraulic pump"]


def noisy_corpus(spark, seed=4):
    """Clean pages, scans with misread words, and the ids of the scans that have one."""
    rng = np.random.default_rng(seed)
    rows, true = [], set()
    for i in range(900):
        s = SENTENCES[i % 5]
        scan = i % 2 == 0
        if scan and rng.random() < 0.6:
            ws = s.split()
            k = int(rng.choice([j for j, w in enumerate(ws) if len(w) > 4]))
            wrong = ws[k]
            for a, b in (("d", "cl"), ("e", "c"), ("o", "0"), ("l", "1")):
                if a in wrong[1:]:
                    wrong = wrong[0] + wrong[1:].replace(a, b, 1)
                    break
            if wrong != ws[k]:
                true.add(f"{i}")
            ws[k] = wrong
            s = " ".join(ws)
        rows.append((f"{i}", s, scan))
    return spark.createDataFrame(rows, "id string, content_text string, scanned boolean"), true


def test_channel_is_learned_through_the_vectors(spark, monkeypatch):
    df, true = noisy_corpus(spark)
    found = lambda r: {x.id for x in df.collect() if x.scanned and "misread" in S.repair(x.content_text, None, S.Heads(None), r)[0]}
    learned = S.learn(df)
    assert {("cl", "d"), ("c", "e"), ("0", "o")} <= {(r, p) for v in learned.by_first.values() for r, p, _ in v}
    assert found(learned) == true and len(true) > 150
    whole = S.vectors
    monkeypatch.setattr(S, "vectors", lambda *a: tuple(np.zeros_like(x) for x in whole(*a)))
    assert found(S.learn(df)) == set()


def test_context_chooses_between_known_words():
    words = {"lead": (50, 0), "head": (50, 0), "cable": (90, 0), "crew": (90, 0)}
    w = np.array([[1.0, 0], [0, 1.0], [1.0, 0], [0, 1.0]]) * 3
    r = S.Reader(S.Vocabulary(words, 280), (w, w / 2), {("1", "l"): 5, ("1", "h"): 5})
    assert r.correct("1ead", ["cable"]) == "lead" and r.correct("1ead", ["crew"]) == "head"


def test_running_heads_by_recurrence(spark):
    rows = [("d", f"North Depot Handbook {p}\nSome text of page {p * 17} that is {'x' * p}", p) for p in range(1, 6)] + [(f"e{k}", f"NOTE\nAnother text {'y' * p}", p) for k in range(4) for p in range(1, 5)] + [("d", None, 1), (None, "x", 1)]
    el = spark.createDataFrame(rows, "document_id string, content_text string, page_number int")
    got = S.recurring_lines(el).collect()
    assert [(r.document_id, r.lines) for r in got] == [("d", [S.line_mark("north depot handbook 9")])]
    assert S.repair(rows[0][1], 1, S.Heads(None, tuple(got[0].lines)), READER)[0] == {"running_head"}
