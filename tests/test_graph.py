import random

from pyspark.sql import functions as F

from quern.operators import graph as G
from quern.operators import tables as U
from quern.operators.components import components
from quern.sources import documents as S
from quern.sources import ontology
from quern.streaming import watch


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(200)}", f"n{rng.randrange(200)}") for _ in range(120)] + [("hub", f"h{i}") for i in range(50)] + [("p0", "p0"), (None, "p1")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    e = spark.createDataFrame(edges, "a string, b string")
    nodes = spark.createDataFrame([(n,) for n in parent], "node string")
    assert {r.node: r.component for r in components(nodes, e).collect()} == {n: find(n) for n in parent}
    assert components(nodes.where("false"), e.where("false")).count() == 0


def test_khop_uses_no_edge_twice(spark):
    e = spark.createDataFrame([("1", "a", "b", "r"), ("2", "b", "c", "r"), ("3", "c", "a", "s")], "edge_id string, a string, b string, type string")
    got = G.khop(spark.createDataFrame([("a",)], "start string"), e, 3).collect()
    assert len(got) == 6 and all(len(set(r.path)) == len(r.path) == r.hops for r in got)
    assert {r.node for r in got if r.hops == 3} == {"a"}


def test_mentions(spark):
    el = spark.createDataFrame([("d", "u1", "The program of PATRIOT battery"), ("d", "u2", "RAM, and ram_x"), ("d", "u3", None)], "document_id string, element_uid string, content_text string")
    names = spark.createDataFrame([("RAM",), ("Patriot",), (" ",), (None,)], "name string")
    assert sorted((r.element_uid, r.name, r.match_type) for r in G.mentions(el, names).collect()) == [("u1", "Patriot", "substring"), ("u2", "RAM", "word_boundary")]


def test_cooccurrence_weights(spark):
    m = spark.createDataFrame([(u, n) for u in "12345" for n in "ab"] + [("1", "c"), (None, "c")], "unit string, name string")
    none = spark.createDataFrame([("a", "c")], "from_name string, to_name string")
    assert sorted((r.a, r.b, r.n, r.weight) for r in G.cooccurrences(m, ["unit"], none).collect()) == [("a", "b", 5, 0.85), ("b", "c", 1, 0.6)]


def test_canonicalise(spark):
    n = spark.createDataFrame([("Coppervane", "T", 9), ("Coppervene", "T", 1), ("Dr X", "T", 1), ("X", "T", 2)], "name string, entity_type string, mentions int")
    a = spark.createDataFrame([("Dr X", "X")], "alias string, canonical string")
    assert {r.name: (r.canonical, r.how) for r in G.canonicalise(n, a).collect()} == {"Coppervane": ("Coppervane", "self"), "Coppervene": ("Coppervane", "fuzzy"), "Dr X": ("X", "alias"), "X": ("X", "exact")}


def test_communities_form_a_hierarchy(spark):
    ring = lambda name, n: [(f"{name}{i:02}", f"{name}{j:02}", 1.0) for i in range(n) for j in range(i)]
    rows = [*ring("a", 8), *ring("b", 8), ("a00", "b00", 0.1), ("x", "y", 1.0)]
    e = spark.createDataFrame(rows, "a string, b string, weight double")
    got = G.communities(e.select(F.col("a").alias("node")).union(e.select("b")).union(spark.createDataFrame([("lone",)], "n string")), e).collect()
    top = {r.node: r.community for r in got if r.level == 0}
    assert len(top) == 19 and set(top.values()) == {"a00", "lone", "x"}
    low = {}
    for r in got:
        if r.level == 1:
            assert r.parent == "a00"
            low.setdefault(r.community, set()).add(r.node[0])
    assert sorted(low.values(), key=str) == [{"a"}, {"b"}]
    assert G.communities(e.select(F.col("a").alias("node")).where("false"), e.where("false")).count() == 0


def test_near_names_against_brute_force(spark):
    rng = random.Random(1)
    names = {"".join(rng.choice("abc/ ") for _ in range(rng.choice((1, 2, 5, 9, 14)))) for _ in range(60)}
    for n in list(names) + ["a much longer name of a station", "another long name with words"]:
        for _ in range(2):
            s = list(n)
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(s) + 1)
                s[k : k + rng.randint(0, 1)] = rng.choice(["", "z", "a"])
            names.add("".join(s))
    names.discard("")
    df = spark.createDataFrame([(n, "T", "clash") for n in names] + [("abz", "U", "clash"), (None, "T", "clash")], "name string, entity_type string, key string")
    far = lambda a, b: spark_levenshtein(a, b) <= 2
    got = {(r.a, r.b) for r in G.near_names(df).collect() if r.entity_type == "T"}
    assert got == {(a, b) for a in names for b in names if a != b and far(a, b)}


def spark_levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_neighbourhood_is_that_of_the_trails(spark):
    rows = [("1", "a", "b", "T"), ("2", "b", "c", "T"), ("3", "c", "d", "T"), ("4", "a", "a", "T"), ("5", "b", "a", "T")]
    e = spark.createDataFrame(rows, "edge_id string, a string, b string, type string")
    s = spark.createDataFrame([("a",), ("d",), ("nobody",)], "start string")
    for hops in (1, 2, 3):
        trails = {(r.start, x) for r in G.khop(s, e, hops).collect() for x in r.path}
        got = {(r.start, r.edge_id) for r in G.neighbourhood(s, e, hops).collect()}
        assert got == trails | {("nobody", None)}
    assert G.khop(s, e, 3, limit=2).groupBy("start").count().where("count > 2").count() == 0


def test_searches_follow_the_query(spark):
    e = spark.createDataFrame([("Radar One", "Antenna", 1.0), ("Radar One", "Mast", 1.0), ("Pump", "Valve", 1.0)], "a string, b string, weight double")
    m = spark.createDataFrame([(n, c, k) for n, c, k in (("Radar One", "Antenna", 3), ("Antenna", "Antenna", 3), ("Mast", "Antenna", 3), ("Pump", "Pump", 2), ("Valve", "Pump", 2))], "node string, community string, size bigint")
    q = spark.createDataFrame([(1, "how is the radar one mounted"), (2, "pump"), (3, "nothing"), (4, None)], "qid int, text string")
    assert [(r.qid, r.entity, r.neighbours) for r in G.local_search(q, m, e).orderBy("qid").collect()] == [("1", "Radar One", "Antenna, Mast"), ("2", "Pump", "Valve")]
    best = {r.qid: r.community for r in G.global_search(q, m, e, 1).collect()}
    assert best == {1: "Antenna", 2: "Pump"}
    assert {r.entity for r in G.drift_search(q, m, e, 10, 1).where("qid = 2").collect()} == {"Pump", "Valve"}
    assert G.local_search(q.where("false"), m, e).count() == G.global_search(q.where("false"), m, e).count() == 0


def test_upsert_is_idempotent_and_keeps_other_columns(spark):
    old = spark.createDataFrame([(1, "x", "SECRET"), (2, "y", None)], "k int, v string, c string")
    new = spark.createDataFrame([(2, "z", "CUI"), (3, "w", "CUI"), (1, None, "CUI")], "k int, v string, c string")
    once = U.upsert(old, new, ["k"], ["v"])
    want = [(1, "x", "SECRET"), (2, "z", None), (3, "w", "CUI")]
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, U.upsert(once, new, ["k"], ["v"]).collect()))
    assert U.purge(once, new.where("k > 1"), "k").count() == 1


def test_patch_map(spark):
    df = spark.createDataFrame([({"a": "1"}, op) for op in ("replace", "add", "remove", "other")] + [(None, "add")], "m map<string,string>, op string")
    assert [r.m for r in df.select(U.patch_map(F.col("m"), F.col("op"), F.lit("a"), F.lit("2")).alias("m")).collect()] == [{"a": "2"}, {"a": "2"}, {}, {"a": "1"}, {"a": "2"}]


def test_ontology():
    assert len(ontology.default().layers) == 46
    assert len(ontology.default().triples) == 127 and ("PLATFORM", "OPERATED_BY", "ORGANIZATION") in ontology.default().triples


def test_parsing(spark):
    files = [("a.html", b"<h1>One</h1><p>x <b>y</b></p><h2>Two</h2><table><tr><th>A</th><td>B</td></tr></table><script>no</script><img alt='z'>"), ("b.md", b"# T\n\ntext\n\n<!-- image -->\n\n## U\n\na | b\nc | d"), ("c.csv", b"a,b\nc,d"), ("d.bin", b"x"), ("e.txt", "caf\xe9".encode("latin-1")), ("f.md", b"")]
    got = S.parse(spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")).orderBy("path", "element_order").collect()
    rows = [(r.path, r.element_type, r.section_path, r.content_text) for r in got]
    assert rows == [
        ("a.html", "heading", "One", "One"), ("a.html", "text", "One", "x y"), ("a.html", "heading", "One > Two", "Two"), ("a.html", "table", "One > Two", "A | B"), ("a.html", "image", "One > Two", "z"),
        ("b.md", "heading", "T", "T"), ("b.md", "text", "T", "text"), ("b.md", "image", "T", ""), ("b.md", "heading", "T > U", "U"), ("b.md", "table", "T > U", "a | b\nc | d"),
        ("c.csv", "table", None, "a | b\nc | d"), ("e.txt", "text", None, "café"),
    ]


def test_stream_takes_each_file_once(spark, tmp_path):
    source, seen = tmp_path / "in", []
    source.mkdir()
    for name, body in (("a.txt", "x"), ("b.txt", "x"), ("c.txt", "y"), ("d.txt", "")):
        (source / name).write_text(body)

    def run():
        q = watch.ingest(watch.new_files(spark, str(source), "*.txt"), str(tmp_path / "cp"), lambda df, _: seen.extend(r.file_hash for r in df.collect()))
        q.awaitTermination()

    run()
    assert len(seen) == 2
    (source / "e.txt").write_text("y")
    (source / "f.txt").write_text("new")
    run()
    assert len(seen) == len(set(seen)) == 3


def test_patches_and_cascade(spark):
    c = spark.createDataFrame([("1", "a", None), ("2", "b", "CUI"), ("3", None, "X")], "id string, chunk_text string, classification string")
    p = spark.createDataFrame([("1", "classification", "add", "CUI", 1), ("1", "classification", "replace", "SECRET", 2), ("2", "classification", "remove", None, 1), ("3", "chunk_text", "add", "t", 1), ("3", "other", "add", "t", 1), ("9", "chunk_text", "add", "t", 1)], "id string, path string, op string, value string, at int")
    got = sorted(map(tuple, U.patch_rows(c, p, "id", ("chunk_text", "classification")).collect()))
    assert got == [("1", "a", "SECRET"), ("2", "b", None), ("3", "t", "X")]
    assert U.patch_rows(c, p.where("false"), "id", ("chunk_text",)).count() == 3
    t = {"a": spark.createDataFrame([("d",), ("e",)], "document_id string"), "b": c}
    left = U.purge_all(t, spark.createDataFrame([("d",)], "document_id string"))
    assert left["a"].count() == 1 and left["b"].count() == 3


def test_ontology_is_seeded_once():
    from quern.sources import ontology as O

    o = O.read("version: 2\n# x\nentity_types:\n  - A: one\n  - B: two\ntriples:\n  - A R B\nrelation_weights:\n  - R: 0.9\ndefault_weight: 0.5\n")
    assert (o.version, o.layers, o.triples, o.weights, o.default_weight) == (2, {"A": "one", "B": "two"}, (("A", "R", "B"),), {"R": 0.9}, 0.5)


def test_seeding_keeps_what_is_held(spark):
    from quern.sources import ontology as O

    first = O.rows(spark, O.read("version: 1\nentity_types:\n  - A: one\n"))
    second = O.rows(spark, O.read("version: 2\nentity_types:\n  - A: other\n"))
    once = O.seed(first.where("false"), first)
    both = O.seed(O.seed(once, second), second)
    assert sorted((r.version, r.value, r.is_current) for r in both.collect()) == [(1, "one", False), (2, "other", True)]
    assert O.seed(once, second.where("false")).where("is_current").count() == 1
