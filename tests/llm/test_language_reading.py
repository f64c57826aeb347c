import random

import numpy as np
from pyspark.sql import functions as F

from quern.llm import language as G
from quern.llm import reading as R

SENTENCES = {
    "en": ["The operator must check the pump before the morning shift", "We found a small leak in the cooling loop of the station", "Write the result of the test in the log book"],
    "de": ["Der Bediener muss die Pumpe vor der Schicht prüfen", "Wir haben ein kleines Leck im Kühler der Anlage gefunden", "Das Ergebnis der Prüfung ist in das Heft einzutragen"],
    "fr": ["L'opérateur doit vérifier la pompe avant chaque équipe", "Nous avons trouvé une petite fuite dans le circuit de la station", "Il faut noter le résultat de l'essai dans le carnet"],
    "es": ["El operador debe revisar la bomba antes de cada turno", "Hemos encontrado una pequeña fuga en el circuito de la estación", "Hay que anotar el resultado de la prueba en el cuaderno"],
    "pt": ["O operador deve verificar a bomba antes de cada turno", "Encontrámos uma pequena fuga no circuito da estação", "É preciso anotar o resultado do ensaio no caderno"],
    "ru": ["Оператор должен проверить насос перед каждой сменой", "Мы нашли небольшую утечку в контуре этой станции", "Результат проверки нужно записать в рабочий журнал"],
    "uk": ["Оператор повинен перевірити насос перед кожною зміною", "Ми знайшли невеликий витік у контурі цієї станції", "Результат перевірки потрібно записати в робочий журнал"],
}


def model():
    rng = random.Random(1)
    rows = [(lang, G.words(s)) for lang, ss in SENTENCES.items() for s in ss for _ in range(6)]
    rows += [(rng.choice(list(SENTENCES)), G.words(rng.choice(SENTENCES["en"]))) for _ in range(8)]  # wrong labels
    return G.Model(rows)


def test_hierarchy_and_segments():
    m = model()
    for lang, ss in SENTENCES.items():
        assert all(m.segments([s])[0][0][2] == lang for s in ss)
    mixed = SENTENCES["en"][0] + ". " + SENTENCES["ru"][1] + ".\n\n" + SENTENCES["pt"][2] + '. "' + SENTENCES["pt"][1] + '."'
    got = m.segments([mixed, None, "", "123 45", "le café"])
    assert [s[2] for s in got[0]] == ["en", "ru", "pt"] and all(0 < s[3] <= 1 for s in got[0])
    assert got[1:4] == [[], [], []] and len(got[4]) == 1


def test_labels(spark):
    labels = {"en": "en", " EN-us ": "en", "German": "de", "deu": "de", "pt-BR": "pt", "UK": "uk", "unknown": None, "nl": None, "": None, None: None}
    df = spark.createDataFrame([(k,) for k in labels], "l string")
    assert {r.l: r.x for r in df.select("l", G.language_of(F.col("l")).alias("x")).collect()} == labels


def test_found_labels_and_chunks(spark):
    rows = [(f"{d}-{i}", d, SENTENCES[lang][i] + ".", 1) for d, lang in (("d1", "de"), ("d2", "ru"), ("d3", "en")) for i in range(3)] + [("d1-0", "d1", "an older English text that is not of this document", 0), ("x", "d4", None, 1)]
    chunks = spark.createDataFrame(rows, "id string, document_id string, chunk_text string, v int").withColumn("updated_at", F.timestamp_seconds("v"))
    docs = spark.createDataFrame([("d1", "German"), ("d2", "en"), ("d3", None), ("d4", None)], "document_id string, detected_language string").withColumn("updated_at", F.timestamp_seconds(F.lit(1)))
    tagged = G.tag(chunks, model())
    assert tagged.count() == 10
    assert sorted((r.document_id, r.lang) for r in G.wrong_labels(docs, G.document_language(tagged)).collect()) == [("d2", "ru"), ("d3", "en")]
    assert {r.id: r.lang for r in G.chunk_language(tagged).collect()}["d1-0"] == "de"
    assert G.train(docs.where("false"), chunks) is None
    assert G.tag(chunks.where("false"), model()).count() == 0


def graded():
    rng = random.Random(2)
    plain = ["the cat sat on the mat", "put the box by the door", "we see the red bus"]
    hard = ["notwithstanding the aforementioned characterisation, the heterogeneity precludes extrapolation", "consequently the epistemological considerations necessitate differentiation", "insofar as interoperability presupposes standardisation, the implications are multidimensional"]
    mid = ["the report describes how the pump was tested after the upgrade", "when the sensor fails, the operator replaces it and notes the time", "measure the voltage between the cable and the receiver"]
    texts, levels = [], []
    for level, pool in ((1, plain), (2, mid), (3, hard)):
        for _ in range(30):
            texts.append(". ".join(rng.choice(pool) for _ in range(rng.randint(6, 12))) + ".")
            levels.append(level)
    return texts, levels


def test_levels_on_held_out_texts():
    texts, levels = graded()
    counts = {}
    for t in texts:
        for w in R.WORD.findall(R.plain(t)):
            counts[w] = counts.get(w, 0) + 1
    train = [i for i in range(len(texts)) if i % 3]
    held = [i for i in range(len(texts)) if not i % 3]
    m = R.Model(counts, [texts[i] for i in train], [levels[i] for i in train])
    got, sure, _ = m.grade([texts[i] for i in held])
    assert (got == np.array(levels)[held]).mean() >= 0.9 and ((sure > 0) & (sure <= 1)).all()


def test_grading_odd_rows(spark):
    texts, levels = graded()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "too short"), (0, texts[0]), (903, "1 2 3 " * 30)], "doc_id bigint, text string").withColumn("level", F.lit("clash"))
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(levels)] + [(0, 1), (5, 3), (7, None)], "doc_id bigint, level int")
    m = R.train(docs, labels)
    got = R.grade(docs, m).collect()
    want = {i for i, t in enumerate(texts) if len(R.WORD.findall(t)) >= 40} | {903}
    assert {r.doc_id for r in got} == want and len(got) == len(want)
    assert R.train(docs, labels.where("false")) is None
    assert R.grade(docs.where("false"), m).count() == 0


def test_rarity_counts_every_word(spark):
    from quern.llm import reading

    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    df = spark.createDataFrame([(" ".join(map(word, range(55_000))),), (" ".join(map(word, range(56_000))),)], "t string")
    counts = reading.word_counts(df, "t")
    features = reading.Features(counts, reading.Grades([], np.array([], dtype=np.int64), 2))
    assert features.total == 111_000 and features.floor == 1
    assert all(features.counts.get(word(i), features.floor) == (2 if i < 55_000 else 1) for i in range(56_000))
    assert reading.word_counts(df.where("false"), "t") == {}


def test_every_document_has_a_level(spark):
    texts, levels = graded()
    rng = random.Random(8)
    short, long = ["casa", "sol", "mar", "pan", "luz", "pie"], ["extraordinariamente", "responsabilidades", "constitucionalidad", "independientemente"]
    other = [(500 + i, ". ".join(" ".join(rng.choice(short if i < 20 else long + short) for _ in range(5 if i < 20 else 24)) for _ in range(8)) + ".", "es") for i in range(40)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + other + [(900, None, "en"), (901, "", None), (902, "too short", "en"), (903, "the cat and the dog", None), (904, "...", "en"), (905, "xx", "zz"), (0, texts[0], "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("level", F.lit("clash"))
    m = R.train(docs.where("lang = 'en'"), spark.createDataFrame(list(enumerate(levels)), "doc_id bigint, level int"))
    got = {r.doc_id: r.level for r in R.levels(docs, m).collect()}
    assert set(got) == {r[0] for r in rows} - {900, 901, 904}
    assert sum(got[500 + i] for i in range(20)) / 20 < sum(got[520 + i] for i in range(20)) / 20
    same = {r.doc_id: r.level for r in R.grade(docs.where("lang = 'en'"), m, least=1).collect()}
    assert all(got[d] == v for d, v in same.items())
    assert R.levels(docs.where("false"), m).count() == 0
