from veloframe.operators import references
from veloframe.operators.references import Table, orphan_counts, orphans


def graph(spark):
    df = spark.createDataFrame
    return {
        "links": Table(df([("a", 0, None), ("b", 2, 4), ("b", 2, 4), ("c", 5, None), (None, 0, None)], "id string, f int, t int"), "id", valid=("f", "t")),
        "fac": Table(df([("f1", "a", 1), ("f2", "zz", 1), ("f2", "zz", 1), ("f3", None, 1), ("f4", "", 1), ("f5", "b", 5), ("f6", "c", 1), ("f7", "b", None), (None, "zz", 1)], "id string, link string, n int"), "id", time="n", references={"link": "links"}),
        "act": Table(df([(1, "a", "f2", 1, 1), (1, "zz", "f1", 1, 2), (2, "b", "f2", 3, 1), (3, "undefined", "null", 3, 1)], "seq long, link string, fac string, n int, at int"), "seq", time="n", newest="at", references={"link": "links", "fac": "fac"}),
        "note": Table(df([("n1", "1"), ("n2", "2"), ("n3", "9"), ("n4", "n1")], "id string, act string"), "id", references={"act": "act"}),
    }


EXPECTED = {
    ("fac", "f2", "link", "missing", 1, 0), ("fac", "f5", "link", "removed", 5, 0), ("fac", "f6", "link", "later", 1, 0),
    ("act", "1", "link", "missing", 1, 0), ("act", "2", "fac", "inherited", 3, 1),
    ("note", "n3", "act", "missing", None, 0), ("note", "n4", "act", "missing", None, 0), ("note", "n1", "act", "inherited", None, 1), ("note", "n2", "act", "inherited", None, 2),
}


def test_direct_and_inherited(spark):
    rows = [tuple(r) for r in orphans(graph(spark)).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == EXPECTED


def test_salted_join_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(references, "BROADCAST_ROWS", 0)
    assert {tuple(r) for r in orphans(graph(spark)).collect()} == EXPECTED


def test_cycle_ends_and_counts(spark):
    t = Table(spark.createDataFrame([("x", "y"), ("y", "x"), ("z", "gone"), ("w", "z"), ("v", "w")], "id string, up string"), "id", references={"up": "t"})
    got = {(r.record_key, r.kind, r.depth) for r in orphans({"t": t}).collect()}
    assert got == {("z", "missing", 0), ("w", "inherited", 1), ("v", "inherited", 2)}
    assert {(r.kind, r.n_cases) for r in orphan_counts(orphans({"t": t})).collect()} == {("missing", 1), ("inherited", 2)}


def test_empty_tables(spark):
    e = spark.createDataFrame([], "id string, up string")
    full = spark.createDataFrame([("q", "r")], "id string, up string")
    assert orphans({"t": Table(e, "id", references={"up": "p"}), "p": Table(e, "id")}).collect() == []
    assert [r.kind for r in orphans({"t": Table(full, "id", references={"up": "p"}), "p": Table(e, "id")}).collect()] == ["missing"]
