"""Least-cost routing: a search kernel over arrays, run on batches of requests in all tasks.

The graph is the one thing every task needs whole, so it is broadcast, after its size is checked; beyond the bound ``network.relaxed_costs``
computes costs by joins instead."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veloframe.functions.geometry import beeline_time_ns

#: Graphs of more links than this are not broadcast (about 60 bytes a link).
MOST_LINKS = 20_000_000
#: Bins of observed links that are collected and broadcast (800 MB).
MOST_BINS = 100_000_000


@dataclass
class Graph:
    """Forward and backward adjacency arrays; nodes and links in the order of their file (``seq``) if they have one, else of their ids."""

    nodes: np.ndarray
    links: np.ndarray
    tail: np.ndarray
    head: np.ndarray
    length: np.ndarray
    speed: np.ndarray
    out_start: np.ndarray
    out_link: np.ndarray
    in_start: np.ndarray
    in_link: np.ndarray
    lm_from: np.ndarray | None = None  # landmarks x nodes
    lm_to: np.ndarray | None = None
    core: np.ndarray | None = None

    places: tuple[dict[str, int], dict[str, int]] | None = None

    def _find(self, kind: int, name: str) -> int:
        if self.places is None:
            self.places = tuple({x: i for i, x in enumerate(names)} for names in (self.nodes, self.links))
        return self.places[kind].get(name, -1)

    def node(self, name: str) -> int:
        return self._find(0, name)

    def link(self, name: str) -> int:
        return self._find(1, name)


def build_graph(nodes: DataFrame, links: DataFrame, mode: str | None = None) -> Graph:
    """The graph of a mode: all nodes, the links that allow the mode. Raises beyond MOST_LINKS."""
    usable = links.filter(F.array_contains("modes", mode)) if mode else links
    order = lambda df: (F.min("seq") if "seq" in df.columns else F.min("id")).alias("_order")
    usable = usable.groupBy("id").agg(order(usable), *(F.first(c).alias(c) for c in ("from_node", "to_node", "length_m", "freespeed")))
    n = usable.count()
    if n > MOST_LINKS:
        raise ValueError(f"{n} links are too many to broadcast; use network.relaxed_costs")
    places = nodes.groupBy("id").agg(order(nodes))
    if (n := places.count()) > MOST_LINKS:
        raise ValueError(f"{n} nodes are too many to broadcast; use network.relaxed_costs")
    names = places.orderBy("_order", "id").toPandas()["id"].to_numpy(object)
    return from_arrays(names, usable.toPandas().sort_values(["_order", "id"]))


def from_arrays(names: np.ndarray, links: pd.DataFrame) -> Graph:
    index = pd.Index(names)
    tail, head = index.get_indexer(links["from_node"]), index.get_indexer(links["to_node"])
    ok = (tail >= 0) & (head >= 0)
    links, tail, head = links[ok], tail[ok], head[ok]

    def adjacency(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(at, kind="stable")
        return np.searchsorted(at[order], np.arange(len(names) + 1)), order

    return Graph(names, links["id"].to_numpy(object), tail, head, links["length_m"].to_numpy(float), links["freespeed"].to_numpy(float), *adjacency(tail), *adjacency(head))


Cost = Callable[[int, float], tuple[float, float]]  # link, entering second -> travel seconds, cost


def free_cost(g: Graph, max_speed: float = float("inf"), per_second: float = 1.0, per_metre: float = 0.0) -> Cost:
    speed = np.minimum(g.speed, max_speed)
    with np.errstate(divide="ignore", invalid="ignore"):
        time = np.where(g.length < 1e-9, 0.0, np.where((speed > 0) & np.isfinite(speed), g.length / speed, np.inf))
    t, c = time.tolist(), (time * per_second + g.length * per_metre).tolist()
    return lambda link, _: (t[link], c[link])


def observed_cost(g: Graph, bins: dict[int, list[float] | np.ndarray], bin_s: float, max_speed: float = float("inf"), per_second: float = 1.0, per_metre: float = 0.0) -> Cost:
    """Times of observed links by the bin of entering (the last one open-ended), never faster than the vehicle; free speed elsewhere."""
    free, length = free_cost(g, max_speed), g.length.tolist()

    def cost(link: int, at: float) -> tuple[float, float]:
        if (b := bins.get(link)) is None:
            t = free(link, at)[0]
        else:
            t = max(b[min(int(at // bin_s), len(b) - 1)], length[link] / max_speed if 0 < max_speed < float("inf") else 0.0)
        return t, t * per_second + length[link] * per_metre

    return cost


def observed_bins(travel_times: DataFrame, g: Graph, mode: str, bins: int) -> dict[int, np.ndarray]:
    """Seconds by bin of the mode's observed links, from ``mode, link, bin, mean_ns``. Raises beyond MOST_BINS."""
    rows = travel_times.filter(F.col("mode") == mode).select("link", "bin", (F.col("mean_ns") / 1e9).alias("s"))
    n = rows.count()
    if n > MOST_BINS:
        raise ValueError(f"{n} bins of observed links are too many to broadcast; use longer bins")
    found = rows.toPandas()
    names, at = np.unique(found["link"].to_numpy(str), return_inverse=True)
    table = np.zeros((len(names), bins))
    table[at, found["bin"].to_numpy(int)] = found["s"].to_numpy(float)
    return {link: table[i] for i, x in enumerate(names.tolist()) if (link := g.link(x)) >= 0}


def search(g: Graph, source: int, target: int, at: float, cost: Cost, bound: Callable[[int], float] | None = None, backward: bool = False, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs, times and the last link of the best path of all nodes settled before the target (-1: all nodes).

    A lower bound of the rest makes it A*; equal nodes are settled in order of their index and only a strict improvement replaces a path."""
    n = len(g.nodes)
    best, when, via = np.full(n, np.inf), np.full(n, np.inf), np.full(n, -1)
    best[source], when[source] = 0.0, at
    start, edges, ends = (g.in_start, g.in_link, g.tail) if backward else (g.out_start, g.out_link, g.head)
    heap, done = [(bound(source) if bound else 0.0, source)], np.zeros(n, bool)
    while heap:
        _, u = heapq.heappop(heap)
        if done[u]:
            continue
        done[u] = True
        if u == target:
            break
        for e in edges[start[u] : start[u + 1]].tolist():
            v = int(ends[e])
            if skip is not None and skip[v] and v != target:
                continue
            t, c = cost(e, when[u])
            if best[u] + c < best[v]:
                best[v], when[v], via[v] = best[u] + c, when[u] + t, e
                done[v] = False
                heapq.heappush(heap, (best[v] + (bound(v) if bound else 0.0), v))
    return best, when, via


def prepare_landmarks(g: Graph, landmarks: list[int], cost: Cost) -> None:
    """Costs from and to every landmark. The cost must be a lower bound of any later one (free speed)."""
    g.lm_from = np.array([search(g, x, -1, 0.0, cost)[0] for x in landmarks]).reshape(len(landmarks), len(g.nodes))
    g.lm_to = np.array([search(g, x, -1, 0.0, cost, backward=True)[0] for x in landmarks]).reshape(len(landmarks), len(g.nodes))


def choose_landmarks(g: Graph, count: int) -> list[int]:
    """Farthest nodes by hops over the undirected graph, the smallest index of equals, beginning with index 0."""
    out: list[int] = []
    hops = np.full(len(g.nodes), np.iinfo(np.int64).max)
    nxt = 0
    while len(out) < count and len(g.nodes):
        out.append(nxt)
        front, d = [nxt], 0
        hops[nxt] = 0
        while front:
            d += 1
            new = []
            for u in front:
                for v in [*g.head[g.out_link[g.out_start[u] : g.out_start[u + 1]]].tolist(), *g.tail[g.in_link[g.in_start[u] : g.in_start[u + 1]]].tolist()]:
                    if hops[v] > d:
                        hops[v] = d
                        new.append(v)
            front = new
        reach = np.where(hops == np.iinfo(np.int64).max, -1, hops)
        if reach.max() <= 0:
            break
        nxt = int(reach.argmax())
    return out


def landmark_bound(g: Graph, target: int) -> Callable[[int], float]:
    """Triangle bounds over all landmarks; those that a node or the target can't reach are skipped."""
    f, t = g.lm_from, g.lm_to

    def bound(v: int) -> float:
        with np.errstate(invalid="ignore"):
            a, b = f[:, target] - f[:, v], t[:, v] - t[:, target]
        both = np.concatenate([a, b])
        both = both[np.isfinite(both)]
        return float(max(0.0, both.max())) if len(both) else 0.0

    return bound


def dead_end_nodes(g: Graph) -> np.ndarray:
    """True for nodes outside the undirected 2-core."""
    pairs = {(min(a, b), max(a, b)) for a, b in zip(g.tail.tolist(), g.head.tolist(), strict=True) if a != b}
    near: dict[int, set[int]] = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = np.array([len(near.get(i, ())) < 2 for i in range(len(g.nodes))])
    todo = np.flatnonzero(out).tolist()
    while todo:
        u = todo.pop()
        for v in near.pop(u, ()):
            if v in near:
                near[v].discard(u)
                if len(near[v]) < 2 and not out[v]:
                    out[v] = True
                    todo.append(v)
    return out


def path(g: Graph, from_link: str, to_link: str, at: float, cost: Cost, heuristic: bool = True) -> tuple[list[str], float, float] | None:
    """Links after the first up to and with the last, seconds and cost from the end of the first link to the beginning of the last; None for
    unknown links or no way. Dead ends in which neither end lies are left out."""
    a, z = g.link(from_link), g.link(to_link)
    if a < 0 or z < 0:
        return None
    s, t = int(g.head[a]), int(g.tail[z])
    if a == z:
        return [], 0.0, 0.0
    skip = None
    if g.core is not None and not g.core[s] and not g.core[t]:
        skip = g.core
    bound = landmark_bound(g, t) if heuristic and g.lm_from is not None and len(g.lm_from) else None
    best, when, via = search(g, s, t, at, cost, bound, skip=skip)
    if not np.isfinite(best[t]):
        return None
    links, v = [z], t
    while v != s:
        links.append(int(via[v]))
        v = int(g.tail[via[v]])
    return [str(g.links[x]) for x in links[::-1]], float(when[t] - at), float(best[t])


def least_cost_paths(requests: DataFrame, graph: Graph, max_speed: float = float("inf"), per_second: float = 1.0, per_metre: float = 0.0, heuristic: bool = True, observed: dict[int, np.ndarray] | None = None, bin_s: float = 900.0) -> DataFrame:
    """``request, links, travel_s, cost, distance_m`` of ``request, from_link, to_link, dep_s``; nulls where there is no way.

    The network leg's time is that of the path and of the last link at the vehicle's speed; its distance is that of all links but the first.
    observed: times of links by bin, see ``observed_bins``; without, every link is driven at free speed."""
    shared = requests.sparkSession.sparkContext.broadcast((graph, observed))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, bins = shared.value
        cost = free_cost(g, max_speed, per_second, per_metre) if bins is None else observed_cost(g, bins, bin_s, max_speed, per_second, per_metre)
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                found = None if pd.isna(r.from_link) or pd.isna(r.to_link) else path(g, r.from_link, r.to_link, float(r.dep_s), cost, heuristic)
                if found is None:
                    out.append((r.request, None, None, None, None))
                    continue
                links, t, c = found
                if links:
                    z = g.link(links[-1])
                    t += g.length[z] / min(g.speed[z], max_speed)
                out.append((r.request, [r.from_link, *links], t, c, float(sum(g.length[g.link(x)] for x in links))))
            yield pd.DataFrame(out, columns=["request", "links", "travel_s", "cost", "distance_m"])

    kind = requests.schema["request"].dataType.simpleString()
    return requests.select("request", "from_link", "to_link", "dep_s").mapInPandas(run, f"request {kind}, links array<string>, travel_s double, cost double, distance_m double")


def teleported(requests: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, factor: float = 1.3, speed: float = 3 / 3.6) -> DataFrame:
    """``requests`` with ``distance_m`` and ``travel_ns`` along the beeline; plain columns, nothing is shuffled."""
    d = F.sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)
    return requests.withColumns({"distance_m": d * factor, "travel_ns": beeline_time_ns(d, factor, speed)})


def network_trip(paths: DataFrame, access: Column, egress: Column, mode: str, access_mode: str = "walk") -> DataFrame:
    """Five elements per routed trip: access leg, interaction, network leg, interaction, egress leg; ``request, pos, kind, mode, act_type,
    trav_ns, distance, links``. access, egress: seconds of the walks."""
    ns = lambda s: F.floor(s * 1_000_000_000).cast("long")
    none_l, none_s, none_d = F.lit(None).cast("array<string>"), F.lit(None).cast("string"), F.lit(None).cast("double")
    el = lambda pos, kind, m, act, t, d, links: F.struct(F.lit(pos).alias("pos"), F.lit(kind).alias("kind"), m.alias("mode"), act.alias("act_type"), t.alias("trav_ns"), d.alias("distance"), links.alias("links"))
    stop = F.lit(f"{mode} interaction")
    walk = F.lit(access_mode)
    rows = F.array(el(0, "leg", walk, none_s, ns(access), none_d, none_l), el(1, "act", none_s, stop, F.lit(0).cast("long"), none_d, none_l), el(2, "leg", F.lit(mode), none_s, ns(F.col("travel_s")), F.col("distance_m"), F.col("links")), el(3, "act", none_s, stop, F.lit(0).cast("long"), none_d, none_l), el(4, "leg", walk, none_s, ns(egress), none_d, none_l))
    return paths.filter("links is not null").select("request", F.explode(rows).alias("e")).select("request", "e.*")


def routed_by_mode(requests: DataFrame, routers: dict[str, Callable[[DataFrame], DataFrame]], mode: str = "mode") -> DataFrame:
    """Each request by the router of its mode; a mode without a router is an error, found before anything is routed."""
    unknown = [r[0] for r in requests.select(mode).distinct().filter(~F.col(mode).isin(*routers)).limit(5).collect()]
    if unknown:
        raise ValueError(f"no router for {unknown}")
    parts = [f(requests.filter(F.col(mode) == m)) for m, f in routers.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
