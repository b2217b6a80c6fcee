"""Configuration: typed modules with defaults from a YAML file, overrides from the command line, and scoring parameters from YAML or XML."""

from __future__ import annotations

import dataclasses
import os
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

import yaml
from pyspark.sql import SparkSession

from veloframe.functions.attributes import is_interaction_parameter  # noqa: F401  (the rule for types in parameters, as a column)
from veloframe.functions.times import checked_bin
from veloframe.operators.scoring import Parameters


class TransitSimulation(Enum):
    TELEPORTED = "Teleported"
    SCHEDULE_BASED = "ScheduleBased"


class ModalLinks(Enum):
    BASE_LINK_FIRST = "BaseLinkFirst"
    NEAREST = "NearestLink"


class Overwrite(Enum):
    DELETE = "DeleteDirectoryIfExists"
    FAIL = "FailIfDirectoryExists"
    OVERWRITE = "OverwriteExistingFiles"


class Compression(Enum):
    PROTO = "Proto"  # the binary format, here Parquet
    NONE = "None"
    GZIP = "Gz"
    ZSTD = "Zst"


@dataclass
class Files:
    network: str | None = None
    population: str | None = None
    vehicles: str | None = None
    ids: str | None = None
    facilities: str | None = None
    modal_link_selection: ModalLinks = ModalLinks.BASE_LINK_FIRST


@dataclass
class Transit:
    schedule_path: str | None = None
    vehicles_path: str | None = None
    simulation: TransitSimulation = TransitSimulation.TELEPORTED
    passenger_modes: list[str] = field(default_factory=lambda: ["pt"])


@dataclass
class Partitioning:
    num_parts: int = 1
    method: str = "None"
    non_main_mode_links: str = "Nearest"


@dataclass
class Output:
    output_dir: str = "./output"
    run_id: str | None = None
    overwrite_files: Overwrite = Overwrite.FAIL
    profiling: str = "None"
    logging: str = "None"
    write_events: str = "None"
    compression_type: Compression = Compression.PROTO


@dataclass
class Routing:
    network_modes: list[str] = field(default_factory=lambda: ["car"])
    access_egress_mode: str = "walk"
    teleported: dict[str, tuple[float, float]] = field(default_factory=lambda: {"walk": (1.3, 3 / 3.6)})


@dataclass
class Replanning:
    fraction_to_disable_innovation: float = 1.0
    max_plan_memory: int = 5
    plan_remover: str = "WorstScore"
    ignore_modes: list[str] = field(default_factory=list)
    strategies: list[dict] = field(default_factory=list)


@dataclass
class Scoring:
    mode: str = "None"
    write_experienced_plans: bool = False
    fraction_for_msa: float | None = None
    scoring_parameters_path: str | None = None


@dataclass
class QSim:
    start_time: int = 0
    end_time: int = 86_400
    ticks_per_second: int = 1
    sample_size: float = 1.0
    stuck_threshold: int = 10
    main_modes: list[str] = field(default_factory=list)
    vehicles_source: str = "ModeVehicleTypesFromVehiclesData"
    traffic_dynamics: str = "Queue"
    link_dynamics: str = "Fifo"


@dataclass
class Controller:
    first_iteration: int = 0
    last_iteration: int = 1000
    write_events_interval: int = 50
    write_plans_interval: int = 50


@dataclass
class Setup:
    global_sync: bool = False
    threads: int | None = None
    retry_time_seconds: int = 600
    random_seed: int = 4711


@dataclass
class Config:
    files: Files = field(default_factory=Files)
    transit: Transit = field(default_factory=Transit)
    partitioning: Partitioning = field(default_factory=Partitioning)
    output: Output = field(default_factory=Output)
    routing: Routing = field(default_factory=Routing)
    replanning: Replanning = field(default_factory=Replanning)
    scoring: Scoring = field(default_factory=Scoring)
    qsim: QSim = field(default_factory=QSim)
    travel_time_bin_s: int = 900
    controller: Controller = field(default_factory=Controller)
    computational_setup: Setup = field(default_factory=Setup)
    base: str = "."

    def path(self, p: str | None) -> str | None:
        return resolved(p, self.base)


#: Module names of a configuration file, and the parts of the configuration they fill.
MODULES = {"transit": "transit", "partitioning": "partitioning", "output": "output", "routing": "routing", "replanning": "replanning", "scoring": "scoring", "qsim": "qsim", "controller": "controller", "computational_setup": "computational_setup"}
FILE_MODULES = ("network", "population", "vehicles", "ids", "facilities")


def resolved(path: str | None, base: str) -> str | None:
    """A path beside the configuration file; absolute paths, addresses and those that begin with ``./`` stay."""
    if path is None or path.startswith(("/", "./")) or "://" in path:
        return path
    return os.path.join(base, path)


class _Loader(yaml.SafeLoader):
    """Takes tagged values as one-entry maps of the tag's name."""


def _tagged(loader: _Loader, suffix: str, node: yaml.Node) -> Any:
    value = loader.construct_mapping(node, deep=True) if isinstance(node, yaml.MappingNode) else loader.construct_sequence(node, deep=True) if isinstance(node, yaml.SequenceNode) else loader.construct_scalar(node)
    return {suffix: value} if value not in ("", None) else suffix


_Loader.add_multi_constructor("!", _tagged)


def _fill(target: Any, values: dict[str, Any]) -> None:
    """Known keys by their field's type; unknown keys are left alone, as files may have more than this engine needs."""
    for f in dataclasses.fields(target):
        if f.name in values and values[f.name] is not None:
            v, old = values[f.name], getattr(target, f.name)
            if isinstance(old, Enum):
                v = type(old)(v if isinstance(v, str) else next(iter(v)))
            elif isinstance(old, bool):
                v = v if isinstance(v, bool) else str(v).lower() in ("true", "yes", "1")
            elif isinstance(old, (int, float)) and not isinstance(v, (dict, list)):
                v = type(old)(float(v)) if isinstance(old, int) else float(v)
            elif isinstance(v, dict) and not isinstance(old, (dict, list)):
                v = next(iter(v))
            setattr(target, f.name, v)


def _apply(c: Config, name: str, values: dict[str, Any]) -> None:
    if name in FILE_MODULES:
        setattr(c.files, name, values.get("path", getattr(c.files, name)))
        if name == "facilities" and values.get("modal_link_selection"):
            c.files.modal_link_selection = ModalLinks(values["modal_link_selection"])
    elif name == "travel_time_calculator":
        c.travel_time_bin_s = int(values.get("bin_size", c.travel_time_bin_s))
    elif name == "simulation":  # the former name of two modules
        _fill(c.qsim, values)
        _fill(c.controller, values)
    elif name in MODULES:
        values = dict(values)
        if name == "routing":
            modes = values.pop("teleported_modes", values.pop("teleported", None)) or []
            for m in modes if isinstance(modes, list) else [{"mode": k, **v} for k, v in modes.items()]:
                c.routing.teleported[m["mode"]] = (float(m.get("beeline_distance_factor", 1.3)), float(m.get("speed", m.get("teleported_mode_speed", 3 / 3.6))))
        if name == "replanning" and "strategy_settings" in values:
            values["strategies"] = values.pop("strategy_settings")
        _fill(getattr(c, MODULES[name]), values)


def load(path: str, overrides: list[str] | None = None) -> Config:
    """A configuration with ``module.key=value`` overrides put over it. The bin width must be a whole number of ticks."""
    with open(path, encoding="utf-8") as f:
        document = yaml.load(f, Loader=_Loader) or {}
    c = Config(base=os.path.dirname(os.path.abspath(path)))
    for name, values in (document.get("modules") or {}).items():
        _apply(c, name, values or {})
    for o in overrides or []:
        key, _, value = o.partition("=")
        module, _, name = key.rpartition(".")
        if not module or not name or not _:
            raise ValueError(f"not module.key=value: {o}")
        if module not in (*MODULES, *FILE_MODULES, "travel_time_calculator", "simulation"):
            raise ValueError(f"unknown module: {module}")
        _apply(c, module, {name: yaml.safe_load(value)})
    checked_bin(c.travel_time_bin_s * 1_000_000_000, c.qsim.ticks_per_second)
    return c


_SET = "subpopulation string, performing double, waiting double, money double, aborted double, waiting_pt double, line_switch double"
_ACT = "subpopulation string, act_type string, typical_s double, scored boolean, open_s double, close_s double"
_MODE = "subpopulation string, mode string, travelling_h double, distance_m double, money_rate_m double, daily_money double, daily_utility double, constant double"


def _number(v: Any) -> float | None:
    return None if v is None else float(v)


def parameter_rows(sets: list[dict]) -> tuple[list, list, list]:
    s, a, m = [], [], []
    for x in sets:
        p = x.get("subpopulation")
        g = lambda k, d: float(x.get(k, d) if x.get(k) is not None else d)  # noqa: B023, E731
        s.append((p, g("performing", 6), g("waiting", 0), g("marginal_utility_of_money", 1), g("aborted_plan_score", -18), _number(x.get("waiting_pt")), g("utility_of_line_switch", -1)))
        for y in x.get("activity_params") or []:
            a.append((p, y["activity_type"], float(y.get("typical_duration_s", 1)), str(y.get("activity_scoring", "full")).lower() != "ignore", _number(y.get("opening_time_s")), _number(y.get("closing_time_s"))))
        for y in x.get("mode_params") or []:
            m.append((p, y["mode"], *(float(y.get(k, 0) or 0) for k in ("marginal_utility_of_traveling", "marginal_utility_of_distance", "monetary_distance_cost_rate", "daily_money_constant", "daily_utility_constant", "constant"))))
    return s, a, m


def parameters(spark: SparkSession, path: str) -> Parameters:
    """Scoring parameters of a YAML file with one set per subpopulation, or of the scoring module of an XML file."""
    sets = converted(path) if path.endswith((".xml", ".xml.gz")) else yaml.safe_load(open(path, encoding="utf-8"))
    s, a, m = parameter_rows(sets or [])
    return Parameters(spark.createDataFrame(s, _SET), spark.createDataFrame(a, _ACT), spark.createDataFrame(m, _MODE))


def _seconds(v: str | None) -> float | None:
    if v in (None, "", "undefined"):
        return None
    parts = [float(x) for x in v.split(":")]
    return sum(x * k for x, k in zip(parts, (3600, 60, 1), strict=False)) if len(parts) > 1 else parts[0]


#: Names of the XML scoring module, and what they are called here.
_XML_SET = {"performing": "performing", "waiting": "waiting", "marginalUtilityOfMoney": "marginal_utility_of_money", "waitingPt": "waiting_pt", "utilityOfLineSwitch": "utility_of_line_switch"}
_XML_MODE = {"marginalUtilityOfTraveling_util_hr": "marginal_utility_of_traveling", "marginalUtilityOfDistance_util_m": "marginal_utility_of_distance", "monetaryDistanceRate": "monetary_distance_cost_rate", "dailyMonetaryConstant": "daily_money_constant", "dailyUtilityConstant": "daily_utility_constant", "constant": "constant"}


def converted(path: str) -> list[dict]:
    """The parameter sets of an XML scoring module. The score of an aborted plan is, per hour, the least of being late (-18 by default) and what
    travelling or not performing cost at their worst. Values that aren't supported are rejected; interaction types are
    not scored unless the file says so."""
    module = next((m for m in ET.parse(path).getroot().iter("module") if m.get("name") in ("scoring", "planCalcScore")), None)
    if module is None:
        raise ValueError(f"{path} has no scoring module")
    values = lambda e: {p.get("name"): p.get("value") for p in e.findall("param")}
    sets = []
    for box in [b for b in module.findall("parameterset") if b.get("type") == "scoringParameters"] or [module]:
        v = values(box)
        name = v.get("subpopulation")
        out: dict[str, Any] = {"subpopulation": None if name in (None, "null", "default", "") else name}
        out |= {k: float(v[x]) for x, k in _XML_SET.items() if v.get(x) not in (None, "null")}
        out["activity_params"], out["mode_params"] = [], []
        for s in box.findall("parameterset"):
            w = values(s)
            if s.get("type") == "activityParams":
                kind = w["activityType"]
                refused = [k for k in ("latestStartTime", "earliestEndTime", "minimalDuration") if _seconds(w.get(k)) is not None]
                refused += ["priority"] if float(w.get("priority", 1)) != 1 else []
                refused += ["typicalDurationScoreComputation"] if w.get("typicalDurationScoreComputation", "relative") != "relative" else []
                if refused:
                    raise ValueError(f"unsupported values of {kind}: {refused}")
                scored = w["scoringThisActivityAtAll"] == "true" if "scoringThisActivityAtAll" in w else not kind.endswith("interaction")
                if scored and _seconds(w.get("typicalDuration")) is None:
                    raise ValueError(f"no typical duration of {kind}")
                out["activity_params"].append({"activity_type": kind, "typical_duration_s": _seconds(w.get("typicalDuration")) or 1.0, "activity_scoring": "full" if scored else "ignore", "opening_time_s": _seconds(w.get("openingTime")), "closing_time_s": _seconds(w.get("closingTime"))})
            elif s.get("type") == "modeParams":
                out["mode_params"].append({"mode": w["mode"]} | {k: float(w[x]) for x, k in _XML_MODE.items() if x in w})
        late, early, performing, waiting = (float(v.get(k, d)) for k, d in (("lateArrival", -18), ("earlyDeparture", 0), ("performing", 6), ("waiting", 0)))
        worst = min([0.0, *(m.get("marginal_utility_of_traveling", 0.0) for m in out["mode_params"])])
        out["aborted_plan_score"] = min(late, early, worst - performing, waiting - performing)
        sets.append(out)
    return sets


def write_parameters(sets: list[dict], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(sets, f, sort_keys=False)


def write_config(c: Config, path: str) -> None:
    plain = lambda v: v.value if isinstance(v, Enum) else list(v) if isinstance(v, tuple) else {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v
    doc = {k: {a: plain(b) for a, b in vars(getattr(c, k)).items()} for k in MODULES.values()}
    doc["routing"]["teleported_modes"] = [{"mode": m, "beeline_distance_factor": f, "speed": v} for m, (f, v) in doc["routing"].pop("teleported").items()]
    doc |= {f: {"path": getattr(c.files, f)} for f in FILE_MODULES if getattr(c.files, f)}
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump({"modules": doc}, f, sort_keys=False)
