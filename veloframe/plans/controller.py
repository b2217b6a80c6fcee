"""The iterative loop: prepare plans, simulate, measure travel times, rebuild experienced plans, score, and choose or make plans anew.

The driver only holds the loop; each phase is a few jobs over tables. At the end of an iteration the plans are written to the shared folder,
which cuts their lineage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veloframe.functions.times import NS
from veloframe.operators import experienced, mobsim, planops, prepare, routing, scoring, selection, traveltime
from veloframe.sources import sinks
from veloframe.sources.config import Config, TransitSimulation
from veloframe.storage import materialize


class Scorer(Protocol):
    """Experienced elements and persons (``person, subpopulation``) to ``person, score``."""

    def __call__(self, elements: DataFrame, persons: DataFrame) -> DataFrame: ...


@dataclass
class Bus:
    """Callbacks by name and priority (higher first, then in order of registration); every payload gets the iteration and a running number."""

    handlers: dict[str, list[tuple[int, int, Callable]]] = field(default_factory=dict)
    number: int = 0

    def on(self, name: str, handler: Callable, priority: int = 0) -> None:
        h = self.handlers.setdefault(name, [])
        h.append((-priority, len(h), handler))
        h.sort(key=lambda x: x[:2])

    def publish(self, name: str, iteration: int, **payload) -> None:
        self.number += 1
        for _, _, h in self.handlers.get(name, []) + self.handlers.get("*", []):
            h({"name": name, "iteration": iteration, "number": self.number, **payload})


@dataclass
class Scenario:
    """elements: plan rows with ``selected, score``; weights: ``subpopulation, strategy, weight``; max_speeds: m/s by network mode;
    travel_time_modes: network modes with the mode whose observed travel times their router uses, by default their own; facilities:
    ``id, x, y, link``; transit: the tables of a schedule, see ``mobsim.schedule``."""

    nodes: DataFrame
    links: DataFrame
    elements: DataFrame
    persons: DataFrame
    vehicles: DataFrame | None = None
    weights: DataFrame | None = None
    max_speeds: dict[str, float] = field(default_factory=dict)
    travel_time_modes: dict[str, str] = field(default_factory=dict)
    facilities: DataFrame | None = None
    transit: dict[str, DataFrame] | None = None


@dataclass
class State:
    elements: DataFrame  # all plans
    plans: DataFrame  # person, plan_idx, selected, score, msa_n
    events: DataFrame | None = None
    travel_times: DataFrame | None = None
    experienced: DataFrame | None = None


def initial(s: Scenario) -> State:
    """The plans as they come in, activities with the places of their facilities. Plans that can't be prepared are an error that names some."""
    e = prepare.normal(s.elements)
    if s.facilities is not None:
        e = materialize(planops.located_activities(e, s.facilities, s.links, s.nodes), "located")
        if found := planops.issue_report(planops.issues(e, s.facilities), 3).collect():  # a row a kind of issue
            raise ValueError("; ".join(f"{r['message']}: {r['n']}, as of {[x['person'] for x in r['examples']]}" for r in found))
    meta = s.elements.groupBy("person", "plan_idx").agg(F.max("selected").alias("selected"), F.max("score").alias("score")).withColumn("msa_n", F.lit(0))
    return State(materialize(e, "elements"), materialize(meta, "plans"))


def selected_elements(st: State) -> DataFrame:
    return st.elements.join(st.plans.filter("selected").select("person", "plan_idx"), ["person", "plan_idx"], "left_semi")


def replanned(st: State, s: Scenario, c: Config, iteration: int) -> State:
    """Plans beyond the memory go, every person draws a strategy, selectors move the selection, innovations copy the selected plan."""
    seed = c.computational_setup.random_seed
    plans = selection.bounded(st.plans, c.replanning.max_plan_memory)
    elements = st.elements.join(plans.select("person", "plan_idx"), ["person", "plan_idx"], "left_semi")
    if s.weights is None:
        return State(elements, plans)
    innovate = not selection.innovation_off(iteration, c.controller.first_iteration, c.controller.last_iteration, c.replanning.fraction_to_disable_innovation)
    drawn = selection.strategies(s.persons, s.weights, selection.person_stream(seed, "replanning.strategy", iteration, F.col("person")), innovate)
    drawn = materialize(drawn, "strategies")
    of = lambda *names: plans.join(drawn.filter(F.col("strategy").isin(*names)).select("person"), "person", "left_semi")
    u = lambda purpose: selection.person_stream(seed, purpose, iteration, F.col("person"))
    choice = selection.best(of("BestScore")).unionByName(selection.worst(of("WorstScore"))).unionByName(selection.at_random(of("SelectRandom"), u("replanning.random"))).unionByName(selection.by_logit(of("SelectExpBeta"), u("replanning.exp_beta")))
    plans = selection.apply_choice(plans, choice)
    fresh = drawn.filter(F.col("strategy").isin(*selection.INNOVATIONS))
    copied = materialize(selection.copy_selected(plans, fresh), "plans")
    old = plans.filter("selected").join(fresh.select("person"), "person", "left_semi").select("person", "plan_idx")
    new = copied.filter("selected").join(fresh.select("person"), "person", "left_semi").select("person", F.col("plan_idx").alias("_new"))
    copies = elements.join(old, ["person", "plan_idx"], "left_semi").join(new, "person").withColumn("plan_idx", F.col("_new")).drop("_new")
    # a copied plan is routed by the next preparation, as its network routes are gone
    ignored = fresh.filter("strategy = 'ReRouteIgnore'").select("person").withColumn("_ig", F.lit(True))
    copies = copies.join(ignored, "person", "left")
    keep = F.coalesce(F.col("_ig"), F.lit(False)) & F.coalesce(F.col("routing_mode").isin(*c.replanning.ignore_modes), F.lit(False)) if c.replanning.ignore_modes else F.lit(False)
    copies = copies.withColumn("links", F.when(keep | (F.col("kind") == "act") | (F.col("route_type") != "links"), F.col("links"))).drop("_ig")
    return State(elements.unionByName(copies.select(*elements.columns)), copied)


def run(s: Scenario, c: Config, scorer: Scorer | None = None, bus: Bus | None = None, write: bool = True) -> State:
    """All iterations; the state after the last one. Scores stay missing without a scorer. Replanning is left out in the last iteration."""
    bus = bus or Bus()
    first, last = c.controller.first_iteration, c.controller.last_iteration
    if write:
        sinks.prepare_folder(c.output.output_dir, c.output.overwrite_files)
    links = s.links.dropDuplicates(["id"])
    if unknown := sorted(set(s.travel_time_modes) - set(c.routing.network_modes)):
        raise ValueError(f"travel times are mapped to {unknown}, which are not network modes")
    graphs = {m: routing.build_graph(s.nodes, links, m) for m in c.routing.network_modes}
    settings = mobsim.Settings(c.qsim.start_time, c.qsim.end_time, c.qsim.ticks_per_second, c.qsim.sample_size, c.qsim.stuck_threshold, tuple(c.qsim.main_modes), tuple(c.transit.passenger_modes), c.qsim.traffic_dynamics == "KinematicWaves", c.qsim.link_dynamics == "PassingQ", seed=c.computational_setup.random_seed)
    timetable = s.transit if c.transit.simulation is TransitSimulation.SCHEDULE_BASED else None
    lines = s.transit["route_stops"].groupBy("line", "route").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "facility"))), lambda x: x["facility"]).alias("stops")) if timetable else None
    st = initial(s)
    adaptive = next((m for m in graphs if m in c.qsim.main_modes), None) if not st.elements.filter("horizon_ns is not null").isEmpty() else None
    for i in range(first, last + 1):
        bus.publish("iteration_starts", i)
        chosen = selected_elements(st)
        for m, g in graphs.items():
            seen = routing.observed_bins(st.travel_times, g, s.travel_time_modes.get(m, m), traveltime.bin_count(c.qsim.end_time * NS, c.travel_time_bin_s * NS)) if m and st.travel_times is not None else None
            chosen = materialize(prepare.prepared(chosen, links, s.nodes, g, [m], {k: tuple(v) for k, v in c.routing.teleported.items()}, max_speed=s.max_speeds.get(m, float("inf")), observed=seen, bin_s=c.travel_time_bin_s, transit=lines) if m else chosen, "prepared")
        rest = st.elements.join(st.plans.filter("selected").select("person", "plan_idx"), ["person", "plan_idx"], "left_anti")
        st.elements = materialize(rest.unionByName(chosen.select(*rest.columns)), "elements")
        st.events = materialize(mobsim.simulate(chosen.withColumn("scenario", F.lit(0)), links, s.vehicles, settings, transit_tables=timetable, graph=graphs.get(adaptive)).drop("scenario"), "events")
        bus.publish("simulated", i, events=st.events)
        st.travel_times = materialize(traveltime.travel_times(st.events, links, c.travel_time_bin_s * NS, c.qsim.end_time * NS), "travel_times")  # of the next routing
        st.experienced = materialize(experienced.experienced_plans(st.events, links), "experienced")
        if scorer is not None:
            start = selection.averaging_start(first, last, c.scoring.fraction_for_msa) if c.scoring.fraction_for_msa is not None else last + 1
            st.plans = materialize(selection.assign_scores(st.plans, scorer(st.experienced, s.persons), i >= start), "plans")
            bus.publish("scored", i, plans=st.plans)
        else:
            st.plans = st.plans.withColumn("score", F.lit(None).cast("double"))
        if write and c.output.write_events != "None" and sinks.due(i, last, c.controller.write_events_interval):
            sinks.write_events(st.events, f"{c.output.output_dir}/events", i)
        if write and sinks.due(i, last, c.controller.write_plans_interval):
            st.elements.join(st.plans, ["person", "plan_idx"]).write.mode("overwrite").parquet(f"{c.output.output_dir}/{sinks.output_name('plans.parquet', c.output.run_id, i)}")
        bus.publish("iteration_ends", i, state=st)
        if i < last:
            nxt = replanned(st, s, c, i)
            st.elements, st.plans = materialize(nxt.elements, "elements"), materialize(nxt.plans, "plans")
    if write:
        st.events.write.mode("overwrite").parquet(f"{c.output.output_dir}/{sinks.output_name('events.parquet', c.output.run_id)}")
        if c.scoring.write_experienced_plans:
            meta = s.elements.join(st.plans.filter("selected").select("person", F.col("score").alias("_score")), "person").withColumn("score", F.col("_score"))
            meta = meta if "person_attributes" in meta.columns else meta.withColumn("person_attributes", F.lit(None).cast("map<string,string>"))
            sinks.experienced_output(st.experienced, meta).write.mode("overwrite").parquet(f"{c.output.output_dir}/{sinks.output_name('experienced_plans.parquet', c.output.run_id)}")
    return st


def utility_scorer(parameters: scoring.Parameters, c: Config) -> Scorer:
    return lambda elements, persons: scoring.scores(elements, persons, parameters, c.transit.passenger_modes, c.qsim.end_time * NS)


def travel_time_scorer(elements: DataFrame, persons: DataFrame) -> DataFrame:
    return scoring.travel_time_scores(elements)
