import random

from veloframe.operators.copies import differences

SCHEMA = "seq long, a long, b string, at long, mask string, bucket string, _rn string"


def brute(x, y):
    def current(rows):
        out = {}
        for r in rows:
            if r[0] is not None and (r[0] not in out or (r[3] is not None and (out[r[0]][3] is None or r[3] > out[r[0]][3]))):
                out[r[0]] = r
        return out

    x, y = current(x), current(y)
    found = [(k, "only_in_first") for k in x if k not in y] + [(k, "only_in_second") for k in y if k not in x]
    return sorted(found + [(k, n) for k in x if k in y for i, n in ((1, "a"), (2, "b")) if x[k][i] != y[k][i]])


def run(spark, x, y, **kw):
    df = lambda rows: spark.createDataFrame([(*r, "m", "n", "o") for r in rows], SCHEMA).drop("_rn")
    got = differences(df(x), df(y), "seq", ["a", "b"], newest="at", **kw)
    assert got.columns == ["seq", "field_name"]
    return sorted(map(tuple, got.collect()))


def test_against_brute_force(spark):
    rng = random.Random(3)
    x = [(k, rng.choice([1, 2, None]), rng.choice(["", "u", None, "w" * 5000]), rng.randrange(5) + 10 * v) for k in [*range(60)] for v in range(rng.randrange(1, 3))]
    y = [r if rng.random() < 0.8 else (r[0], rng.choice([1, None]), "v", r[3]) for r in x if rng.random() < 0.95]
    x += [(None, 1, "n", 1), (500, None, None, None), (501, 1, "", 1)]
    y += [(None, 2, "n", 1), (501, 1, None, 1), (501, 1, None, 1)]
    rng.shuffle(y)
    for per in (1, 8, 1000):
        assert run(spark, x, y, rows_per_bucket=per) == brute(x, y)


def test_empty_and_equal(spark):
    x = [(1, None, "p", 1), (1, 2, "q", None), (2, 3, "", 4)]
    assert run(spark, x, x) == []
    assert run(spark, x, []) == [(1, "only_in_first"), (2, "only_in_first")]
    assert run(spark, [], x) == [(1, "only_in_second"), (2, "only_in_second")]
    assert run(spark, [], []) == []


def test_without_versions_and_swapped_values(spark):
    a = spark.createDataFrame([(i, i % 3) for i in range(50)], "k long, v long")
    b = spark.createDataFrame([(i, {4: 5 % 3, 5: 4 % 3}.get(i, i % 3)) for i in range(50)], "k long, v long")
    assert sorted(map(tuple, differences(a, b, "k", ["v"], rows_per_bucket=100).collect())) == [(4, "v"), (5, "v")]
