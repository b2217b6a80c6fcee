"""Command line: python -m veloframe.cli COMMAND ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from veloframe.operators import events as ev
from veloframe.operators import network, planops
from veloframe.plans import controller
from veloframe.sources import config, folders, sinks, xml
from veloframe.storage import parameters, session


def _log(spark, path):
    from pathlib import Path

    return folders.read_folder(spark, path) if Path(path).is_dir() and not path.endswith(".parquet") else folders.read_events(spark, path)


def run(spark, a) -> int:
    c = config.load(a.config, a.set)
    nodes, links, _ = xml.network(spark, c.path(c.files.network))
    elements = xml.population(spark, c.path(c.files.population))
    persons = xml.persons(elements)
    types, vehicles = xml.vehicles(spark, c.path(c.files.vehicles))
    modes = types.filter(F.col("id").isin(*c.qsim.main_modes)).select(F.col("id").alias("mode"), "pce", "max_v")
    named = planops.generated_vehicles(persons, modes).join(parameters(modes), "mode").select("vehicle", "pce", "max_v")
    fleet = vehicles.select("vehicle", "pce", "max_v").unionByName(named).dropDuplicates(["vehicle"])
    speeds = {r.id: r.max_v for r in types.filter(F.col("id").isin(*c.routing.network_modes)).select("id", "max_v").dropDuplicates(["id"]).collect()}
    weights = [(s.get("subpopulation"), x.get("strategy", x.get("name")), float(x.get("weight", 1))) for s in c.replanning.strategies for x in s.get("strategies", [s])]
    facilities = xml.facilities(spark, c.path(c.files.facilities))[0] if c.files.facilities else None
    transit = xml.transit(spark, c.path(c.transit.schedule_path)) if c.transit.schedule_path else None
    scenario = controller.Scenario(nodes, links, elements, persons, fleet, spark.createDataFrame(weights, "subpopulation string, strategy string, weight double") if weights else None, speeds, facilities=facilities, transit=transit)
    scorer = None
    if c.scoring.scoring_parameters_path:
        scorer = controller.utility_scorer(config.parameters(spark, c.path(c.scoring.scoring_parameters_path)), c)
    controller.run(scenario, c, scorer)
    return 0


def compare_events(spark, a) -> int:
    found = ev.compare(_log(spark, a.first), _log(spark, a.second))
    print(found)
    return 0 if found == "equal" else 1


def merge_events(spark, a) -> int:
    log = _log(spark, a.folder)
    sinks.write_events_xml(log, a.output, single_file=True) if a.output.endswith(".xml") else log.write.mode("overwrite").parquet(a.output)
    return 0


def convert(spark, a) -> int:
    """XML scenario files to Parquet tables, with the route counts of selected plans as weights of nodes."""
    nodes, links, _ = xml.network(spark, a.network)
    elements = xml.population(spark, a.population)
    counts = network.traversals(elements.filter("selected and links is not null"))
    weights = network.node_weights(links, counts).withColumnRenamed("node", "id")
    nodes = nodes.drop("weight").join(weights, "id", "left").withColumn("weight", F.coalesce("weight", F.lit(1)))
    folders.write_scenario({"nodes": nodes, "links": links, "plan_elements": elements, "persons": xml.persons(elements)}, a.output)
    return 0


def convert_to_xml(spark, a) -> int:
    t = folders.read_scenario(spark, a.folder, ["nodes", "links", "plan_elements"])
    sinks.write_network_xml(t["nodes"], t["links"], f"{a.output}/network.xml", single_file=True)
    sinks.write_population_xml(t["plan_elements"], f"{a.output}/population.xml", single_file=True)
    return 0


def partition_network(spark, a) -> int:
    nodes, links, _ = xml.network(spark, a.network)
    parts = network.partitions(nodes, a.parts)
    parts.write.mode("overwrite").parquet(a.output)
    return 0


def neighbors(spark, a) -> int:
    nodes, links, _ = xml.network(spark, a.network)
    for k in range(1, a.most + 1):
        sinks.write_neighbours(network.neighbour_counts(links, network.partitions(nodes, 1 << k), a.modes), 1 << k, a.output)
    return 0


def filter_population(spark, a) -> int:
    sinks.write_population_xml(folders.first_persons(xml.population(spark, a.population), a.n), a.output, single_file=True)
    return 0


def convert_scoring_parameters(spark, a) -> int:
    config.write_parameters(config.converted(a.config), a.output)
    return 0


COMMANDS = {
    "run": (run, ["--config"]), "compare-events": (compare_events, ["first", "second"]), "merge-events": (merge_events, ["folder", "output"]), "convert": (convert, ["network", "population", "output"]), "convert-to-xml": (convert_to_xml, ["folder", "output"]),
    "partition-network": (partition_network, ["network", "output"]), "neighbors": (neighbors, ["network", "output"]), "filter-population": (filter_population, ["population", "output"]), "convert-scoring-parameters": (convert_scoring_parameters, ["config", "output"]),
}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="veloframe")
    sub = p.add_subparsers(dest="command", required=True)
    for name, (_, args) in COMMANDS.items():
        s = sub.add_parser(name)
        for x in args:
            s.add_argument(x, **({"required": True} if x.startswith("--") else {}))
        s.add_argument("--set", action="append", default=[], help="module.key=value")
        s.add_argument("--parts", type=int, default=2)
        s.add_argument("--most", type=int, default=11)
        s.add_argument("--modes", nargs="*", default=["car"])
        s.add_argument("-n", type=int, default=1)
    a = p.parse_args(argv)
    return COMMANDS[a.command][0](session("veloframe"), a)


if __name__ == "__main__":
    sys.exit(main())
