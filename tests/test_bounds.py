"""Nothing is dropped for being much: parameter tables beyond any usual size, and what is refused instead of cut."""

import pytest
from pyspark.sql import functions as F

from veloframe import storage
from veloframe.operators import planops, scoring, selection


def test_many_modes(spark):
    persons = spark.createDataFrame([("p",), ("p",), (None,)], "person string").filter("person is not null")
    modes = spark.range(1500).select(F.concat(F.lit("m"), "id").alias("mode")).union(spark.createDataFrame([("m0",), (None,)], "mode string"))
    assert planops.generated_vehicles(persons, modes).distinct().count() == 1500
    assert planops.generated_vehicles(persons, modes.limit(0)).count() == 0
    assert planops.generated_vehicles(persons, modes, spark.createDataFrame([("p_m7",)], "vehicle string")).count() == 1499


def test_more_modes_than_a_person_can_have_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(planops, "MOST_MODES", 3)
    with pytest.raises(ValueError, match="4 modes"):
        planops.generated_vehicles(spark.createDataFrame([("p",)], "person string"), spark.range(4).select(F.col("id").cast("string").alias("mode")))


@pytest.mark.parametrize("bound", [0, 100_000])
def test_many_subpopulations(spark, monkeypatch, bound):
    monkeypatch.setattr(storage, "BROADCAST_ROWS", bound)
    persons = spark.range(20_000).select(F.concat(F.lit("p"), "id").alias("person"), F.concat(F.lit("s"), "id").alias("subpopulation"))
    weights = persons.select("subpopulation", F.lit("BestScore").alias("strategy"), F.lit(1.0).alias("weight"))
    assert selection.strategies(persons, weights, F.lit(0.5)).count() == 20_000
    sets = persons.select("subpopulation", F.lit(1.0).alias("performing"))
    assert scoring.set_or_default(persons, sets).filter("_known").count() == 20_000


def test_no_shared_folder(spark):
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())


def test_parts_of_a_population(spark):
    p = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "person string, n int")
    assert planops.united([p.filter("person = 'a'"), p.filter("person = 'b'"), p.limit(0)]).count() == 3
    with pytest.raises(ValueError, match="several parts"):
        planops.united([p, p.filter("n = 2")])
