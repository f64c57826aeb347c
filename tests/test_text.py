import hashlib
import unicodedata
import uuid

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import keys as K
from quern.functions import text as X
from quern.operators import chunking, cleaning, ordered


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_normalise(spark):
    assert one(spark, "a‑b–c d", X.normalise) == "a-b-c d"
    assert one(spark, None, X.normalise) is None
    assert one(spark, "é x", X.nfc) == unicodedata.normalize("NFC", "é x")


def test_tokens(spark):
    assert one(spark, " ".join("abcdefghij"), X.approx_tokens) == 13
    assert one(spark, "", X.approx_tokens) == 0


def test_labels_and_scripts(spark):
    assert [one(spark, v, X.label) for v in ("a b", "9x", "", None)] == ["a_b", "_9x", "UNKNOWN", "UNKNOWN"]
    assert one(spark, "радар тест", X.is_foreign_script) is True
    assert one(spark, "рад", X.is_foreign_script) is False
    assert one(spark, None, X.is_foreign_script) is False


def test_identifiers(spark):
    rows = spark.createDataFrame([("NSN 1234-56-789-0123", "x 1234-56-789-0123."), ("MIL-STD-810G", "MIL-STD-810G"), ("PN-4521", "PN-45210"), ("AN/MPQ-53(V)2", "the AN/MPQ-53(V)2"), (None, "PN-4521")], "a string, b string")
    assert [r.s for r in rows.select(X.shared_identifier(F.col("a"), F.col("b")).alias("s")).collect()] == [True, True, False, True, False]


def test_json_ladder(spark):
    cases = {'<think>{x}</think>{"a": 1}': '{"a": 1}', 'Final Answer: {"a": 1}': '{"a": 1}', 'x\n```json\n{"a": 1}\n```': '{"a": 1}', 'so {x} then {"a": 1} ok': '{"a": 1}', "[1, 2]": "[1, 2]", "none": None, "": None, "so {'a': True, b: [1, 2,],": '{"a": true, "b": [1, 2]}', 'x {"a": "}"} y': '{"a": "}"}'}
    for answer, want in cases.items():
        assert one(spark, answer, X.json_text) == want, answer
    assert one(spark, None, X.json_text) is None


def test_sections(spark):
    assert one(spark, "intro text long enough\n# One head\nbody of one\n# Two head\nbody of two", X.sections) == ["intro text long enough", "# One head\nbody of one", "# Two head\nbody of two"]
    assert [one(spark, v, X.sections) for v in ("short", "", " \n ", None)] == [[], [], [], None]
    assert one(spark, "a first paragraph\n\na second paragraph\n \nof it", X.sections) == ["a first paragraph", "a second paragraph\n \nof it"]
    assert one(spark, "only one line here", X.sections) == ["only one line here"]


def test_keys_match_the_library(spark):
    names = [f"doc-{i}:uid {i}é" for i in range(50)]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", K.uuid5(F.col("n")).alias("u"), K.uuid5(F.col("n"), K.DNS).alias("d")).collect()
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, r.n)) and r.d == str(uuid.uuid5(uuid.NAMESPACE_DNS, r.n)) for r in rows)
    r = spark.createDataFrame([("d", ["a", "b"], 3)], "d string, u array<string>, i int").select(K.chunk_id(F.col("d"), F.col("u"), F.col("i"), F.lit("m")).alias("c")).first()
    assert r.c == str(uuid.UUID(hashlib.md5(hashlib.sha256(b"d:a|b:3:m").hexdigest().encode()).hexdigest()))


def test_line_cleanup(spark):
    def clean(text):
        got = cleaning.line_cleanup(spark.createDataFrame([("k", text)], "k string, t string"), "k", "t").collect()
        return got[0].cleaned if got else None

    assert clean("A\nA\nA\nB") == "A\nA\nB"
    assert clean("\n".join(["X", "a", "X", "b", "X", "c", "X", "d", "X"])) == "X\na\nb\nc\nd"
    assert clean("\n".join(["X"] * 6)) == "X\nX"
    assert clean("a\n\n\n<!-- image -->\n\n\nb") == "a\n\nb"
    assert clean("") == ""
    assert clean(None) is None


def test_keep_first_treats_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a")], "i int, k string")
    assert sorted(r.i for r in cleaning.keep_first(df, ["k"], ["i"]).collect()) == [1, 3]


def test_word_windows(spark):
    def starts(n):
        df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "k int, t string")
        return sorted((r.chunk_no, r.n_words, r.chunk_text.split(" ")[0] if r.chunk_text else "") for r in chunking.word_windows(df, "k", "t").collect())

    assert [len(starts(n)) for n in (393, 394, 737, 738)] == [1, 2, 2, 3]
    assert [s[2] for s in starts(738)] == ["w0", "w344", "w688"]
    assert starts(0) == [(0, 0, "")]


def test_char_windows(spark):
    df = spark.createDataFrame([(1, "x" * 3000), (2, ""), (3, None)], "k int, t string")
    assert sorted(r.start for r in chunking.char_windows(df, "k", "t", 1000, 200).collect()) == [0, 800, 1600, 2400]


ELEMENTS = "document_id string, element_order int, element_type string, content_text string, page_number int, section_path string, element_uid string"


def fold(spark, rows, most=9999, overlap=64):
    df = spark.createDataFrame([("d", o, k, t, 1, None, f"u{o:03}") for o, k, t in rows], ELEMENTS)
    return [(r.text, r.modality, r.heading_text) for r in sorted(chunking.structured(df, most, overlap).collect(), key=lambda r: r.chunk_index)]


def test_structure_aware_chunks(spark):
    assert fold(spark, [(0, "text", "Before heading."), (1, "heading", "Section Title"), (2, "text", "After heading.")]) == [("Before heading.", "text", None), ("Section Title\n\nAfter heading.", "text", "Section Title")]
    assert [m for _, m, _ in fold(spark, [(0, "heading", "H"), (1, "text", "a"), (2, "table", "t"), (3, "text", "b"), (4, "equation", "e")])] == ["text", "table", "text", "equation"]
    assert fold(spark, [(0, "heading", "My Section"), (1, "table", "t"), (2, "table", "v")]) == [("My Section", "text", "My Section"), ("t", "table", "My Section"), ("v", "table", None)]
    assert fold(spark, [(0, "image", " ")]) == []
    assert fold(spark, [(2, "text", "b"), (1, "text", "a"), (3, "text", "c")]) == [("a\n\nb\n\nc", "text", None)]
    cut = fold(spark, [(0, "heading", "Head"), *((i, "text", "A short sentence here.") for i in range(1, 20)), (20, "table", "t")], 20)
    assert [h for _, _, h in cut] == ["Head"] + [None] * (len(cut) - 1) and len(cut) > 3
    long = fold(spark, [(0, "text", " ".join(["w"] * 500))], 50, 10)
    assert len(long) > 1 and all(len(t.split()) <= 38 for t, _, _ in long)


def test_paragraphs_stay_as_they_are():
    p = ["one two three", "", "four five six seven", " eight"]
    assert chunking.split_long("\n\n".join(p), 7, 0) == ["one two three\n\n", "four five six seven\n\n eight"]
    assert chunking.split_long("a b c d\n\ne\n\nf g h i", 6, 1) == ["a b c d\n\ne", "e\n\nf g h i"]
    assert chunking.split_long("a", 1, 0) == ["a"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=40), st.integers(1, 40))
def test_chunks_of_a_section_fill_in_order(words, most):
    got = chunking.pack_places(words, most)
    assert got[0] == 0 and all(b - a in (0, 1) for a, b in zip(got, got[1:]))
    for k in set(got):
        own = [n for n, g in zip(words, got) if g == k]
        assert len(own) == 1 or int(sum(own[:-1]) * 1.3) + int(own[-1] * 1.3) <= most or sum(own[:-1]) == 0


def test_spans_give_what_one_window_gives(spark):
    rows = [("a", i, f"t{i}", i * 7 % 11 if i % 3 else None) for i in range(40)] + [("b", 5, "x", None), ("b", None, "y", 4), ("b", 6, "z", None)]
    df = spark.createDataFrame(rows, "g string, o int, t string, v int").repartition(3)
    for op in (lambda span: ordered.running_sum(df, ["g"], "o", ["t"], F.lit(1), "x", span), lambda span: ordered.last_seen(df, ["g"], "o", ["t"], {"x": F.col("v")}, span), lambda span: ordered.next_of(df, ["g"], "o", ["t"], F.col("t"), "x", span)):
        one, many = ({(r.g, r.t): r.x for r in op(span).collect()} for span in (10**6, 4))
        assert one == many and len(one) == 43
    assert {r.t: r.x for r in ordered.next_of(df, ["g"], "o", ["t"], F.col("t"), "x", 4).where("g = 'b'").collect()} == {"y": "x", "x": "z", "z": None}


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 2000), st.integers(20, 200), st.integers(0, 15))
def test_word_fallback_covers_all_words(n, most, overlap):
    ws = [f"w{i}" for i in range(n)]
    got = chunking.split_long(" ".join(ws), most, overlap)
    assert set(" ".join(got).split()) == set(ws)


def test_structured_survives_odd_rows(spark):
    df = spark.createDataFrame([("d", None, "text", "x", None, None, "u1"), ("d", 1, "heading", None, 2, "s", "u2"), (None, 1, "text", "y", 1, None, "u3")], ELEMENTS)
    assert [r.text for r in chunking.structured(df).collect()] == ["x"]
    assert chunking.structured(df.where("false")).count() == 0


def test_spans_are_found_in_one_pass():
    assert X.bracketed('{"a": [1]} and [2] or {"b": "]"') == [(0, 10), (15, 18), (22, 31)]
    assert X.bracketed("{" * 50_000) == [(0, 50_000)] and X.bracketed("none ]") == []


def test_translation_falls_back_to_single_texts(spark):
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(["ab", "cd", "e7", None, "", "x" * 50, "7"])], "k string, o int, t string")
    model = lambda c: F.when(c.contains("7"), F.replace(F.upper(c), F.lit(cleaning.BOUNDARY.strip()), F.lit(" "))).otherwise(F.upper(c))
    got = {r.o: r.translated for r in cleaning.translate(df, "k", "o", "t", model, 8).collect()}
    assert got == {0: "AB", 1: "CD", 2: "E7", 4: "", 5: "X" * 50, 6: "7"}
    silent = {r.translated for r in cleaning.translate(df, "k", "o", "t", lambda c: F.lit(""), 8).collect()}
    assert silent == {"ab", "cd", "e7", "", "x" * 50, "7"}
    assert cleaning.translate(df.where("false"), "k", "o", "t", F.upper).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=30), st.integers(1, 40))
def test_batches_fill_in_order(sizes, limit):
    got = cleaning.batch_numbers(sizes, limit)
    assert len(got) == len(sizes) and all(b - a in (0, 1) for a, b in zip(got, got[1:]))
    for k in set(got):
        own = [n for n, g in zip(sizes, got) if g == k]
        assert sum(own) <= limit or len([n for n in own if n]) == 1
