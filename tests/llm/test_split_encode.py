import random
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import encode, split


def check_pieces(text, limit, overlap):
    got = split.cuts(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(b - a <= limit for a, b in got)
    assert all(n[0] == p[1] - overlap for p, n in zip(got, got[1:]))
    return got


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n漢é", max_size=900), st.integers(20, 200))
def test_pieces_cover_the_text(text, limit):
    check_pieces(text, limit, limit // 10)


def test_cuts_prefer_paragraphs_then_lines_sentences_words():
    text = "a" * 60 + "\n\n" + "b" * 20 + ". " + "c" * 60
    assert split.cuts(text, 100, 10)[0] == (0, 62)
    assert split.cuts("a" * 70 + ". " + "b" * 60, 100, 10)[0] == (0, 72)
    assert split.cuts("a" * 250, 100, 10)[0] == (0, 100)
    assert split.cuts("", 100, 10) == [(0, 0)]
    with pytest.raises(ValueError):
        split.cuts("a", 100, 90)


def test_split_items(spark):
    df = spark.createDataFrame([("n", None), ("e", ""), ("s", "short"), ("l", "word " * 2000), ("l2", "🙂" * 3500)], "k string, t string").withColumn("start", F.lit("clash"))
    got = split.split_items(df, "k", "t").collect()
    by = {}
    for r in sorted(got, key=lambda r: r.piece_no):
        by.setdefault(r.item_key, []).append(r)
        assert len(r.piece_text) == r.end - r.start <= 3000
    assert set(by) == {"e", "s", "l", "l2"} and len(by["e"]) == len(by["s"]) == 1
    for k, text in (("l", "word " * 2000), ("l2", "🙂" * 3500)):
        assert by[k][0].piece_text + "".join(r.piece_text[200:] for r in by[k][1:]) == text
    assert {r.item_key: r.n_pieces for r in split.item_sizes(df.union(df), "k", "t").collect()} == {"n": 0, "e": 1, "s": 1, "l": 4, "l2": 2}
    assert split.split_items(df.where("false"), "k", "t").count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sdllvere09é漢🙂-!"), st.sampled_from(string.ascii_letters), st.characters(codec="utf-8")), max_size=300), st.integers(1, 40))
def test_tree_equals_one_go(text, leaf):
    run, sizes, decode = encode.encoder()
    ids = encode.encode_tree(text, run, sizes, leaf)
    assert ids == run(text) and decode(ids) == text


def test_tree_on_long_odd_texts():
    run, sizes, decode = encode.encoder()
    rng = random.Random(1)
    for text in ("a" * 5000, " " * 3000 + "x", "\n" * 4000, "<|endoftext|>" * 300, "".join(rng.choice(" ab'\n1漢🙂") for _ in range(6000))):
        for leaf in (1, 7, 256):
            if leaf > 1 or len(text) < 4500:
                assert encode.encode_tree(text, run, sizes, leaf) == run(text)


def test_join_is_associative():
    run, sizes, _ = encode.encoder()
    a, b, c = (("we'", run("we'")), ("ll see 1", run("ll see 1")), ("23  the", run("23  the")))
    j = lambda x, y: encode.join(x, y, run, sizes)
    assert j(j(a, b), c) == j(a, j(b, c)) == ("we'll see 123  the", run("we'll see 123  the")) and j(("", []), a) == a == j(a, ("", []))


def test_corpus(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "Hello <|endoftext|> world", 0), (3, "Hello <|endoftext|> world", 0), (None, "x", 0)], "doc_id bigint, text string, ids int")
    rows = encode.encode_corpus(df).collect()
    run, _, _ = encode.encoder()
    assert sorted(((r.doc_id or 0, list(r.ids)) for r in rows)) == sorted([(1, []), (2, []), (3, run("Hello <|endoftext|> world")), (3, run("Hello <|endoftext|> world")), (0, run("x"))])
    assert encode.encode_corpus(df.where("false")).count() == 0
