import random

import numpy as np

from veloframe.llm.prose import N_FEATURES, Grades, Lexicon, features, prose
from veloframe.llm.reading import grade, train, validation
from veloframe.llm.trees import boost

EASY = "the dog runs . a cat sees the box . one day it gets wet . we put the pen in the red bag .".split(" . ")
HARD = "the stratification of heterogeneous interdependence presupposes idempotency notwithstanding that equilibration underdetermines the commensurability inasmuch as it recapitulates disaggregation".split(" | ")


def text(rng, level):
    if level == 0:
        return "".join(f"int f{i}(int a) {{ return a * {i}; }}\n" for i in range(rng.randrange(1, 9)))
    lines = [rng.choice(EASY if rng.random() < (5 - level) / 4 else HARD).capitalize() + "." for _ in range(6)]
    return "/*\n" + "".join(f" * {x}\n" for x in lines) + " */\nint main(void) { return 0; }\n"


def test_prose():
    assert prose(None) == "" and prose("") == ""
    assert prose("int f(int a) { return a; }\nfor (int i = 0; i < 3; i++) { x(); }") == ""
    got = prose("# The cold light fills each lock and\n# one day holds it.\nx = f(3)\n// Here nobody stops the pen.\n")
    assert got.split() == "The cold light fills each lock and one day holds it. . Here nobody stops the pen. .".split()
    assert prose("x = 1\n# It is not known what came before it\nend it\n\ny = 2") == "It is not known what came before it end it"


def test_features_of_a_batch_are_those_of_each_text():
    rng = random.Random(3)
    texts = [prose(text(rng, i % 6)) for i in range(40)] + ["", "one", "One dog. Sees; a box, (red): a box."]
    grades = Grades({"dog": 1.0, "box": 2.5}, {"ence": 4.0}, {"stra": 5.0}, frozenset({"the", "a", "in"}))
    both = features(texts, np.full(len(texts), 999), Lexicon(grades))
    assert both.shape == (len(texts), N_FEATURES) and not np.isnan(both).any()
    for i, t in enumerate(texts):
        assert np.allclose(both[i], features([t], np.array([999]), Lexicon(grades))[0])
    words, sentences = np.expm1(both[-1, 0]), np.expm1(both[-1, 1])
    assert (round(words), round(sentences)) == (8, 2) and both[-1, 2] == len(texts[-1]) / 999
    overlap = both[-1, 35]
    assert overlap == 0.0 and np.isclose(both[-1, 36], 5 / 6)  # dog, sees, box, red and one once, box twice
    assert not both[-2].any() and not both[-3].any()


def test_boosting_fits_steps():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(800, 3))
    y = np.where(x[:, 1] > 0.5, 3.0, 0.0) + x[:, 0]
    m = boost(x[:600], y[:600])
    clear = np.abs(x[600:, 1] - 0.5) > 0.03  # rows within a bin of the step may fall on either side
    assert np.sqrt(np.mean((m.predict(x[600:]) - y[600:])[clear] ** 2)) < 0.1
    assert boost(x[:0], y[:0]).predict(x).tolist() == [0.0] * 800


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, text(rng, i % 6), rng.choice(["s1", "s2", "s3", None]), "x") for i in range(420)] + [(1000, None, "s1", "x"), (1001, "", "s1", "x"), (1002, "  \n", None, "x"), (1003, text(rng, 5) * 300, "s2", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, id string")
    labels = spark.createDataFrame([(i, i % 6) for i in range(300)] + [(5, 5), (7, None), (8, 9), (9, 0), (None, 1), (99999, 3)], "doc_id long, reading_level int")
    model = train(docs, labels)
    got = {r.doc_id: r.reading_level for r in grade(docs, model).collect()}
    assert len(got) == len(rows) and [got[i] for i in (1000, 1001, 1002)] == [0, 0, 0]
    held = [(i % 6, got[i]) for i in range(300, 420)]
    assert np.mean([abs(a - b) <= 1 for a, b in held]) > 0.8 and all(b == 0 for a, b in held if a == 0)
    assert sum(r.n for r in validation(model, docs).collect()) == 299  # label 9 has two levels


def test_labelled_texts_are_read_whole(spark):
    rng = random.Random(8)
    easy = lambda n: "".join(f"# {rng.choice(EASY).capitalize()}.\n" for _ in range(n))
    hard = "".join(f"# {HARD[0].capitalize()}.\n" for _ in range(60))
    rows = [(i, easy(400) + (hard if i % 2 else ""), f"s{i % 3}") for i in range(60)]  # the first 5,000 characters tell nothing
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, 5 * (i % 2)) for i in range(60)], "doc_id long, reading_level int")
    model = train(docs, labels)
    assert all(r.accuracy >= 0.9 for r in validation(model, docs).collect())
    assert np.mean([r.reading_level == 5 * (r.doc_id % 2) for r in grade(docs, model).collect()]) >= 0.9


def test_repeated_documents_are_learned_once(spark):
    rng = random.Random(9)
    rows = [(i, text(rng, i % 6), "s") for i in range(60)]
    docs = spark.createDataFrame(rows + rows[:30] * 5, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 6) for i in range(60)], "doc_id long, reading_level int")
    model = train(docs, labels)
    assert sum(r.n for r in validation(model, docs).collect()) == 60 and grade(docs, model).count() == 210


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "The dog sees one red box and runs.", "s")], "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, reading_level int")
    assert [r.reading_level for r in grade(docs, train(docs, none)).collect()] == [0]
    assert grade(docs.filter("false"), train(docs, none)).count() == 0
