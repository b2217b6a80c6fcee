import math

import pytest
from pyspark.sql import functions as F

from scenario import events, links
from veloframe.operators import scoring
from veloframe.operators.experienced import experienced_plans
from veloframe.sources import config

SETS = [{"activity_params": [{"activity_type": "home", "typical_duration_s": 43200}, {"activity_type": "cabin", "typical_duration_s": 43200}, {"activity_type": "bakery", "typical_duration_s": 3600, "opening_time_s": 21600, "closing_time_s": 64800}, {"activity_type": "kiln", "typical_duration_s": 36000}, {"activity_type": "free", "activity_scoring": "ignore"}], "mode_params": [{"mode": "walk", "marginal_utility_of_traveling": -6, "constant": -0.5}, {"mode": "car", "marginal_utility_of_traveling": -3, "marginal_utility_of_distance": -0.001, "monetary_distance_cost_rate": -0.0002, "daily_money_constant": -5, "daily_utility_constant": -1}, {"mode": "ferry", "marginal_utility_of_traveling": -1, "constant": -0.25}, {"mode": "pt", "marginal_utility_of_traveling": -2}]}, {"subpopulation": "rich", "marginal_utility_of_money": 0.5, "activity_params": [{"activity_type": "home", "typical_duration_s": 43200}], "mode_params": []}]


def parameters(spark):
    s, a, m = config.parameter_rows(SETS)
    return scoring.Parameters(spark.createDataFrame(s, config._SET), spark.createDataFrame(a, config._ACT), spark.createDataFrame(m, config._MODE))


def utility(d, t, b=6 / 3600):
    z = t / math.e
    return b * t * (math.log(d / t) + 1) if d >= z else -(b * t / z) * (z - d)


def score(spark, elements, who="ana&co", sub="person"):
    persons = spark.createDataFrame([(who, sub)], "person string, subpopulation string")
    return scoring.scores(elements, persons, parameters(spark), ["pt"], 86400 * 10**9).first().score


def test_utility(spark):
    for d, t in ((3600.0, 3600.0), (10.0, 3600.0), (-50.0, 3600.0), (90000.0, 7200.0)):
        assert spark.range(1).select(scoring.activity_utility(F.lit(d), F.lit(t), F.lit(6 / 3600)).alias("u")).first().u == pytest.approx(utility(d, t))


def test_experienced_plan(spark):
    e = experienced_plans(events(spark), links(spark))
    want = utility(20400, 43200) + utility(22201 - 21600, 3600) + utility(86400 - 22447, 36000)  # the bakery opens at six
    want += (30 + 60) * -6 / 3600 - 0.5  # one trip: the constant of walking counts once
    want += 153 * -3 / 3600 + 1300 * -0.001 + 1300 * -0.0002 - 5 - 1
    want += 600 * -1 / 3600 - 0.25
    assert score(spark, e) == pytest.approx(want)
    assert score(spark, e, sub="rich") is None  # a set of its own without the modes
    assert score(spark, e.filter("false")) == 0
    assert scoring.travel_time_scores(e).first().score == -(600 + 22446 - 22201)


def test_aborted_single_and_overnight(spark):
    E = "person string, elem_idx int, kind string, act_type string, mode string, start_ns long, end_ns long, dep_ns long, trav_ns long, distance double, route_type string, boarding_ns long, aborted boolean"
    s = lambda x: None if x is None else x * 10**9
    act = lambda i, t, a, z, ab=False: ("q", i, "act", t, None, s(a), s(z), None, None, None, None, None, ab)
    leg = lambda i, m, d, t, kind="generic", b=None, ab=False: ("q", i, "leg", None, m, None, None, s(d), s(t), 0.0, kind, s(b), ab)
    run = lambda *rows: score(spark, spark.createDataFrame(list(rows), E), "q")
    assert run(act(0, "home", None, None)) == pytest.approx(utility(86400, 43200))
    assert run(act(0, "home", None, 30000), leg(1, "walk", 30000, 600), act(2, "free", 30600, 40000), leg(3, "walk", 40000, 600), act(4, "home", 40600, None)) == pytest.approx(utility(30000 + 86400 - 40600, 43200) + 1200 * -6 / 3600 - 1.0)
    assert run(act(0, "home", None, 30000), leg(1, "walk", 30000, 60), act(2, "pt interaction", 30060, 30060), leg(3, "pt", 30060, 600, "default_pt", 30160), act(4, "pt interaction", 30660, 30660), leg(5, "pt", 30660, 600, "default_pt", 30660), act(6, "free", 31260, None)) == pytest.approx(utility(30000, 43200) - 60 * 6 / 3600 - 0.5 - 1200 * 2 / 3600 - 1 + 100 * (-2 / 3600 + 2 / 3600))
    assert run(act(0, "home", None, 30000), leg(1, "walk", 30000, 60, ab=True)) == pytest.approx(utility(30000, 43200) - 0.1 - 0.5 + 24 * -18)
    assert run(act(0, "home", None, 30000), leg(1, "walk", 30000, None), act(2, "free", 1, None)) is None
    assert run(act(0, "unknown", None, None)) is None


def test_parameter_errors(spark):
    p = parameters(spark)
    assert p.errors() == []
    assert len(scoring.Parameters(p.sets.union(p.sets), p.activities, p.modes).errors()) == 2


def test_config_files(spark, tmp_path):
    (tmp_path / "c.yml").write_text("modules:\n  network:\n    type: Network\n    path: net.xml\n  population: {type: Population, path: ./pop.xml}\n  partitioning:\n    num_parts: 2\n    method: !Metis\n      vertex_weight:\n        - Constant\n  routing: {mode: UsePlans, network_modes: [car, bike]}\n  output: {output_dir: o, overwrite_files: DeleteDirectoryIfExists, compression_type: Zst}\n  qsim: {main_modes: [car], end_time: 3600}\n")
    c = config.load(str(tmp_path / "c.yml"), ["controller.last_iteration=3", "qsim.sample_size=0.1"])
    assert c.files.network == "net.xml" and c.path("net.xml") == str(tmp_path / "net.xml") and c.path("./pop.xml") == "./pop.xml" and c.partitioning.num_parts == 2 and c.routing.network_modes == ["car", "bike"] and c.output.overwrite_files is config.Overwrite.DELETE
    assert (c.controller.last_iteration, c.qsim.sample_size, c.qsim.end_time, c.qsim.stuck_threshold, c.replanning.max_plan_memory, c.computational_setup.random_seed, c.travel_time_bin_s) == (3, 0.1, 3600, 10, 5, 4711, 900)
    config.write_config(c, str(tmp_path / "d.yml"))
    assert config.load(str(tmp_path / "d.yml")).qsim == c.qsim
    for bad in ("nothing", "unknown.key=1"):
        with pytest.raises(ValueError):
            config.load(str(tmp_path / "c.yml"), [bad])
    (tmp_path / "s.xml").write_text('<config><module name="scoring"><param name="x" value="1"/><parameterset type="scoringParameters"><param name="subpopulation" value="null"/><param name="performing" value="6"/><param name="lateArrival" value="-18"/><parameterset type="activityParams"><param name="activityType" value="home"/><param name="typicalDuration" value="12:00:00"/><param name="openingTime" value="undefined"/></parameterset><parameterset type="activityParams"><param name="activityType" value="car interaction"/></parameterset><parameterset type="modeParams"><param name="mode" value="car"/><param name="marginalUtilityOfTraveling_util_hr" value="-20"/></parameterset></parameterset></module></config>')
    sets = config.converted(str(tmp_path / "s.xml"))
    assert sets[0]["aborted_plan_score"] == -26 and [a["activity_scoring"] for a in sets[0]["activity_params"]] == ["full", "ignore"] and sets[0]["activity_params"][0]["typical_duration_s"] == 43200
    config.write_parameters(sets, str(tmp_path / "s.yml"))
    assert config.parameters(spark, str(tmp_path / "s.yml")).activities.count() == config.parameters(spark, str(tmp_path / "s.xml")).activities.count() == 2
