"""The queue simulation of plans on a network: an event-driven kernel, one group per scenario.

A tick depends on the one before, so a scenario is simulated by one task; scenarios (samples, seeds, policies) run in parallel, each task has many
and takes them from its sorted rows one after the other. The kernel never scans idle links: links and nodes are visited only when something on
them is due, and while they wait for flow or room they rest until there can be some. Where all agents of a scenario drive one route, nobody
overtakes, and the order of the log isn't asked for, vehicles are swept along the route one after the other instead of tick by tick. A network, and the plans and vehicles of one scenario, must fit
into a task's memory, which MOST_ELEMENTS checks; plans with teleported legs only don't need it (planops.teleport_schedule)."""

from __future__ import annotations

import copy
import gc
import heapq
import math
from bisect import insort
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import repeat
from operator import attrgetter, lt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veloframe.functions.rng import Stream
from veloframe.functions.times import NS
from veloframe.operators import routing, transit
from veloframe.operators.events import COLUMNS, FIELDS, KINDS
from veloframe.storage import BROADCAST_ROWS, shuffle_partitions

#: Plan elements of one scenario that a task may be given (about 1 kB each).
MOST_ELEMENTS = 5_000_000
#: Plan elements that are worth a task, while there are fewer tasks than partitions of a shuffle.
LEAST_ELEMENTS = 20_000
#: Events that a task hands over at a time.
BATCH = 20_000
#: Flow below this is none.
MARGIN = 1e-10
GAP_SPEED = 15 / 3.6


@dataclass(frozen=True)
class Settings:
    start_s: int = 0
    end_s: int = 86_400
    ticks_per_second: int = 1
    sample: float = 1.0
    stuck_s: int = 10
    main_modes: tuple[str, ...] = ("car",)
    passenger_modes: tuple[str, ...] = ("pt",)
    kinematic: bool = False
    passing: bool = False
    cell: float = 7.5
    seed: int = 4711


@dataclass(eq=False, slots=True)
class Link:
    name: str
    tail: str
    head: str
    length: float
    speed: float
    flow: float  # vehicles a tick
    room: float
    gap: int  # ticks that a gap travels back; -1: at once
    inflow: float  # vehicles a tick that may enter; 0: any
    order: int
    queue: object = field(default_factory=deque)
    buffer: deque = field(default_factory=deque)
    waiting: deque = field(default_factory=deque)
    gaps: deque = field(default_factory=deque)
    used: float = 0.0
    in_buffer: float = 0.0
    left: float = 0.0
    at: int = 0
    in_left: float = 0.0
    in_at: int = 0
    since: int | None = None
    wake: int | None = None  # the earliest tick at which it is due
    blocked: bool = False  # someone waits for flow
    flow_at: int | None = None  # when there will be some; None: not before the buffer changes
    starved: bool = False  # its node rests until a vehicle has left


class Network:
    """What the links of a network are in a simulation, by id; scenarios make their own of those that they use."""

    def __init__(self, links: pd.DataFrame, s: Settings):
        self.rows: dict[str, tuple] = {}
        for i, r in enumerate(links.sort_values("id").itertuples(index=False)):
            flow_s = r.capacity * s.sample / 3600
            free = r.length_m / r.freespeed
            room = max(flow_s, r.length_m * r.permlanes * s.sample / s.cell, (free + (r.length_m / GAP_SPEED if s.kinematic else 0.0)) * flow_s)
            inflow = r.permlanes / s.cell / (1 / GAP_SPEED + 1 / r.freespeed) * s.sample / s.ticks_per_second if s.kinematic else 0.0
            gap = int(r.length_m / GAP_SPEED * s.ticks_per_second) if s.kinematic else -1
            self.rows[r.id] = (r.id, r.from_node, r.to_node, r.length_m, r.freespeed, flow_s / s.ticks_per_second, room, gap, inflow, i)


def _ticks(left: float, rate: float, most: float) -> int | None:
    """Ticks until more than MARGIN is left, of what grows by the rate up to the most; None: never."""
    if min(rate, most) <= MARGIN:
        return None
    n = max(1, int((MARGIN - left) / rate) - 1)
    while n * rate + left <= MARGIN:
        n += 1
    return n


@dataclass(eq=False, slots=True)
class Agent:
    name: str
    elements: list[dict]
    pos: int = 0
    links: list[str] | None = None
    hop: int = 0
    vehicle: str | None = None
    pce: float = 1.0
    top: float = float("inf")
    aborted: bool = False

    @property
    def now(self) -> dict:
        return self.elements[self.pos]


@dataclass
class Bus:
    """A transit vehicle on its departure; times in ns since midnight."""

    driver: str
    vehicle: str
    line: str
    route: str
    departure: str
    mode: str
    links: tuple[str, str]
    stops: list[tuple[str, int, int]]  # facility, scheduled arrival and departure
    place: int  # in its route, by time of departure
    pos: int = 0
    next_ns: int = 0
    started: bool = False
    finished: bool = False
    riders: list[Agent] = field(default_factory=list)

    @property
    def key(self) -> tuple[str, str, int]:
        return self.line, self.route, self.pos


class Transit:
    """Schedule-based transit: vehicles go from stop to stop by their timetable, never overtaking one of their own route.

    A vehicle that comes before its predecessor waits in front of the stop. Riders alight, then those who wait board, if the line is theirs and
    their egress lies ahead; both take no time. A vehicle leaves when it is due, not before its predecessors and not before it arrived; being
    late at departure it reaches the next stop as much later, in the next tick at the earliest."""

    def __init__(self, sim: Simulation, buses: list[Bus]):
        self.sim = sim
        self.buses = buses
        self.starting = [(sim.tick(b.stops[0][2]), b.driver, b) for b in buses]
        heapq.heapify(self.starting)
        self.coming: list[tuple[int, str, Bus]] = []
        self.leaving: list[tuple[int, str, Bus]] = []
        self.arrived: dict[tuple[str, str, int], int] = {}
        self.blocked: dict[tuple[str, str, int], dict[int, Bus]] = {}
        self.halting: dict[str, list[Bus]] = {}
        self.waiting: dict[str, list[Agent]] = {}
        self.fresh: list[Agent] = []

    def ns(self, t: int) -> int:
        return t * NS // self.sim.tps

    def start_drivers(self, t: int) -> None:
        while self.starting and self.starting[0][0] <= t:
            b = heapq.heappop(self.starting)[2]
            b.started = True
            self.sim.emit(t, "TransitDriverStarts", driver=b.driver, vehicle=b.vehicle, transit_line=b.line, transit_route=b.route, departure=b.departure)
            self.sim.emit(t, "departure", person=b.driver, link=b.links[0], leg_mode=b.mode)
            self.sim.emit(t, "PersonEntersVehicle", person=b.driver, vehicle=b.vehicle)
            heapq.heappush(self.coming, (max(self.sim.tick(b.stops[0][1]), t), b.driver, b))

    def arrive(self, b: Bus, t: int) -> None:
        self.arrived[b.key] = b.place + 1
        stop = b.stops[b.pos]
        self.sim.emit(t, "VehicleArrivesAtFacility", vehicle=b.vehicle, facility=stop[0], delay=0.0)
        b.next_ns = max(stop[2], self.ns(t))
        heapq.heappush(self.leaving, (self.sim.tick(b.next_ns), b.driver, b))
        self.halting.setdefault(stop[0], []).append(b)

    def exchange(self, stop: str, t: int) -> None:
        for b in self.halting.get(stop, ()):
            out = [a for a in b.riders if a.now["egress_facility"] == stop]
            b.riders = [a for a in b.riders if a.now["egress_facility"] != stop] if out else b.riders
            for a in out:
                self.sim.emit(t, "PersonLeavesVehicle", person=a.name, vehicle=b.vehicle)
                self.sim.end_leg(a, t, a.now["end_link"])
            ahead = {s[0] for s in b.stops[b.pos + 1 :]}
            going = [a for a in self.waiting.get(stop, ()) if a.now["line"] == b.line and a.now["egress_facility"] in ahead]
            if going:
                gone = set(map(id, going))
                self.waiting[stop] = [a for a in self.waiting[stop] if id(a) not in gone]
            for a in going:
                self.sim.emit(t, "PersonEntersVehicle", person=a.name, vehicle=b.vehicle)
                b.riders.append(a)

    def step(self, t: int) -> None:
        touched = set()
        while self.coming and self.coming[0][0] <= t:
            b = heapq.heappop(self.coming)[2]
            if b.place != self.arrived.get(b.key, 0):
                self.blocked.setdefault(b.key, {})[b.place] = b
                continue
            while b is not None:
                self.arrive(b, t)
                touched.add(b.stops[b.pos][0])
                b = self.blocked.get(b.key, {}).pop(self.arrived[b.key], None)
        for a in sorted(self.fresh, key=lambda a: a.name):
            e = a.now
            self.sim.emit(t, "waitingForPt", agent=a.name, at_stop=e["access_facility"], destination_stop=e["egress_facility"])
            self.waiting.setdefault(e["access_facility"], []).append(a)
            touched.add(e["access_facility"])
        self.fresh = []
        for stop in sorted(touched):
            self.exchange(stop, t)
        later = []
        while self.leaving and self.leaving[0][0] <= t:
            _, driver, b = heapq.heappop(self.leaving)
            here = self.halting[b.stops[b.pos][0]]
            before = [o.next_ns for o in here if (o.line, o.route) == (b.line, b.route) and o.place < b.place]
            if before:
                later.append((max(self.sim.tick(max(before)), t + 1), driver, b))
                continue
            here.remove(b)
            self.leave(b, t)
        for x in later:
            heapq.heappush(self.leaving, x)

    def leave(self, b: Bus, t: int) -> None:
        self.sim.emit(t, "VehicleDepartsAtFacility", vehicle=b.vehicle, facility=b.stops[b.pos][0], delay=0.0)
        if b.pos + 1 == len(b.stops):
            b.finished = True
            self.sim.emit(t, "PersonLeavesVehicle", person=b.driver, vehicle=b.vehicle)
            self.sim.emit(t, "arrival", person=b.driver, link=b.links[1], leg_mode=b.mode)
            return
        late = max(0, self.ns(t) - b.stops[b.pos][2])
        b.pos += 1
        b.next_ns = max(b.stops[b.pos][1] + late, self.ns(t + 1))
        heapq.heappush(self.coming, (self.sim.tick(b.next_ns), b.driver, b))

    def heads(self) -> list[int]:
        return [h[0][0] for h in (self.starting, self.coming, self.leaving) if h]

    def stuck(self, end: int) -> None:
        for b in self.buses:
            if not b.finished:
                self.sim.emit(end, "stuckAndAbort", person=b.driver, leg_mode=b.mode if b.started else None)


class Simulation:
    """Ticks in this order: agents whose leg ended start their next element, activities that are over end, departures, nodes, links, transit,
    teleported arrivals. An agent that arrives in a tick starts its activity in the next one."""

    def __init__(self, links: Network | pd.DataFrame, elements: list[dict] | pd.DataFrame, vehicles: dict[str, tuple[float, float]], s: Settings, buses: list[Bus] | None = None, router: Callable[[str, str, float], list[str] | None] | None = None, types: frozenset[str] | None = None):
        self.s, self.tps = s, s.ticks_per_second
        self.types = frozenset(FIELDS) if types is None else types  # of the events that are kept
        self.events: list[tuple] = []
        self.seq: list[int] = []  # their places among all events
        self.emitted = 0
        self.network = links if isinstance(links, Network) else Network(links, s)
        self.links: dict[str, Link] = {}  # those in use
        self.ins: dict[str, list[Link]] = {}
        self.random: dict[str, Stream] = {}
        self.vehicles = vehicles
        self.active: dict[int, Link] = {}  # links with someone waiting or due
        self.due: list[tuple[int, int, Link]] = []  # queue heads to look at again
        self.nodes: set[str] = set()
        self.resting: list[tuple[int, str]] = []  # nodes that can't let anyone pass before
        self.sleeping: list[tuple[int, int, Agent]] = []
        self.waking: list[tuple[int, int, Agent, int]] = []  # agents who look for a route before their activity ends
        self.router = router
        self.flying: list[tuple[int, str, Agent]] = []
        self.heaps = self.sleeping, self.waking, self.flying, self.due, self.resting
        self.finished: list[Agent] = []
        self.pending: list[Agent] = []
        self.n = 0
        self.transit = Transit(self, buses) if buses is not None else None
        plans: dict[str, list[dict]] = {}
        for e in elements.to_dict("records") if isinstance(elements, pd.DataFrame) else elements:
            if e["person"] is not None:
                plans.setdefault(e["person"], []).append(e)
        place = lambda e: (e["elem_idx"] is None, e["elem_idx"])
        self.agents = [Agent(p, sorted(plans[p], key=place)) for p in sorted(plans)]

    # time

    def tick(self, ns: float) -> int:
        return -(-int(ns) * self.tps // NS)

    def emit(self, t: int, kind: str, **fields) -> None:
        if kind in self.types:
            self.events.append((t * NS // self.tps, kind, fields))
            self.seq.append(self.emitted)
        self.emitted += 1

    # agents

    def start_activity(self, a: Agent, t: int, first: bool = False) -> None:
        e = a.now
        if not first:
            self.emit(t, "actstart", person=a.name, link=e["link"], x=e["x"], y=e["y"], act_type=e["act_type"])
        if a.pos + 1 >= len(a.elements):
            return
        end = e["end_ns"] if e["end_ns"] is not None else None if e["max_dur_ns"] is None else t * NS // self.tps + e["max_dur_ns"]
        if end is not None:
            self.n += 1
            end_tick = max(self.tick(end), t)
            heapq.heappush(self.sleeping, (end_tick, self.n, a))
            if self.router is not None and e.get("horizon_ns") is not None:
                heapq.heappush(self.waking, (max(self.tick(max(end - e["horizon_ns"], 0)), t), self.n, a, end_tick))

    def replan(self, a: Agent, end: int) -> None:
        """A new route, as of the activity's end, for the network leg of the agent's next trip; without one the planned route stays."""
        for i in range(a.pos + 1, len(a.elements)):
            e = a.elements[i]
            if e["kind"] == "act" and "interaction" not in (e["act_type"] or ""):
                return
            if e["kind"] == "leg" and e["mode"] in self.s.main_modes and e["start_link"] and e["end_link"]:
                links = self.router(e["start_link"], e["end_link"], end / self.tps)
                if links is not None:
                    a.elements[i] = dict(e, links=links)
                return

    def depart(self, a: Agent, t: int) -> None:
        e = a.now
        mode = e["mode"]
        start = e["start_link"] or a.elements[a.pos - 1]["link"]
        self.emit(t, "departure", person=a.name, link=start, leg_mode=mode, routing_mode=e["routing_mode"] or mode)
        if mode in self.s.main_modes:
            a.links, a.hop = list(e["links"] if e["links"] is not None and len(e["links"]) else [start]), 0
            a.vehicle = e["vehicle"] or f"{a.name}_{mode}"
            a.pce, a.top = self.vehicles.get(a.vehicle, (1.0, float("inf")))
            self.emit(t, "PersonEntersVehicle", person=a.name, vehicle=a.vehicle)
            link = self.link(a.links[0])
            if link is None:
                self.abort(a, t, a.links[0])
                return
            link.waiting.append(a)
            self.active[link.order] = link
        elif self.transit is not None and mode in self.s.passenger_modes and e["line"]:
            self.transit.fresh.append(a)
        else:
            d = e["route_trav_ns"] if e["route_trav_ns"] is not None else e["trav_ns"]
            if d is None:
                raise ValueError(f"{a.name} has a teleported leg without travel time")
            heapq.heappush(self.flying, (self.tick(t * NS // self.tps + d), a.name, a))

    def abort(self, a: Agent, t: int, link: str) -> None:
        """A vehicle whose route can't go on is taken out; the others don't notice."""
        a.aborted = True
        self.emit(t, "stuckAndAbort", person=a.name, link=link, leg_mode=a.now["mode"])

    def end_leg(self, a: Agent, t: int, link: str | None) -> None:
        self.emit(t, "arrival", person=a.name, link=link, leg_mode=a.now["mode"])
        self.finished.append(a)

    # links

    def link(self, name: str) -> Link | None:
        k = self.links.get(name)
        if k is None and (row := self.network.rows.get(name)) is not None:
            k = self.links[name] = Link(*row, queue=[] if self.s.passing else deque())
            k.left, k.in_left = k.flow, k.inflow
            insort(self.ins.setdefault(k.head, []), k, key=attrgetter("order"))
        return k

    def watch(self, k: Link, t: int) -> None:
        """Has the link looked at when its first vehicle is due or there is flow again."""
        at, queue = k.flow_at, k.queue
        if queue and (h := queue[0][0]) > t and (at is None or h < at):
            at = h
        if at is not None and (k.wake is None or at < k.wake):
            k.wake = at
            heapq.heappush(self.due, (at, k.order, k))

    def update_flow(self, k: Link, t: int) -> None:
        if k.at < t:
            k.left, k.at = min((t - k.at) * k.flow + k.left, k.flow - k.in_buffer), t

    def has_room(self, k: Link, t: int) -> bool:
        while k.gaps and k.gaps[0][0] <= t:
            k.used -= k.gaps.popleft()[1]
        ok = k.room - k.used > 0.0
        if k.inflow:
            if k.in_at < t:
                k.in_left, k.in_at = min((t - k.in_at) * k.inflow + k.in_left, k.inflow), t
            ok = ok and k.in_left > MARGIN
        return ok

    def release(self, k: Link, pce: float, t: int) -> None:
        if k.gap < 0:
            k.used -= pce
        else:
            k.gaps.append((t + k.gap, pce))
        if k.starved:
            k.starved = False
            self.nodes.add(k.tail)

    def enter(self, k: Link, a: Agent, t: int) -> None:
        out = t + max(1, int(k.length / (k.speed if k.speed < a.top else a.top) * self.tps))
        k.used += a.pce
        k.in_left -= a.pce if k.inflow else 0.0
        self.n += 1
        if self.s.passing:
            heapq.heappush(k.queue, (out, self.n, a))
        else:
            k.queue.append((out, self.n, a))
        self.watch(k, t)

    def from_buffer(self, k: Link, t: int) -> Agent:
        if k.blocked:  # it may have flow now; up to here it had room for less
            self.update_flow(k, t - 1)
            self.active[k.order] = k
        a = k.buffer.popleft()
        k.in_buffer -= a.pce
        k.since = t
        return a

    def to_buffer(self, k: Link, a: Agent) -> None:
        k.left -= a.pce
        k.in_buffer += a.pce
        k.buffer.append(a)

    def move_link(self, k: Link, t: int) -> None:
        empty, queue, emit = not k.buffer, k.queue, self.emit
        if k.at < t:
            self.update_flow(k, t)
        ended = []
        while k.waiting and k.left > MARGIN:
            a = k.waiting.popleft()
            emit(t, "vehicle enters traffic", vehicle=a.vehicle, link=k.name, person=a.name, network_mode=a.now["mode"], relative_position=1.0)
            if a.hop == len(a.links) - 1:
                ended.append(a)
            else:
                self.to_buffer(k, a)
        while queue and queue[0][0] <= t:
            a = queue[0][2]
            arrives = a.hop == len(a.links) - 1
            if not arrives and k.left <= MARGIN:
                break
            if self.s.passing:
                heapq.heappop(queue)
            else:
                queue.popleft()
            self.release(k, a.pce, t)
            if arrives:
                ended.append(a)
            else:
                self.to_buffer(k, a)
        if ended:
            for a in ended:
                emit(t, "vehicle leaves traffic", vehicle=a.vehicle, link=k.name, person=a.name, network_mode=a.now["mode"], relative_position=1.0)
            for a in ended:
                emit(t, "PersonLeavesVehicle", person=a.name, vehicle=a.vehicle)
                self.end_leg(a, t, k.name)
        if empty and k.buffer:
            k.since = t
            self.nodes.add(k.head)
        k.blocked = bool(k.waiting or (queue and queue[0][0] <= t))
        n = _ticks(k.left, k.flow, k.flow - k.in_buffer) if k.blocked else None
        k.flow_at = None if n is None else t + n
        self.watch(k, t)

    def move_node(self, node: str, t: int) -> bool:
        """Whether someone waits to pass in the next tick."""
        offered = [k for k in self.ins.get(node, ()) if k.buffer]
        offers = offered[:]
        total = sum([k.flow for k in offers])
        rng = full = None
        while offers and total > MARGIN:
            if len(offers) == 1:
                i = 0
            else:
                rng = rng or self.random.setdefault(node, Stream.of(self.s.seed, "network.node", node))
                u, run, i = rng.uniform() * total, 0.0, len(offers) - 1
                for j, k in enumerate(offers):
                    run += k.flow
                    if run >= u:
                        i = j
                        break
            k = offers[i]
            offers[i] = offers[-1]
            offers.pop()
            total -= k.flow
            buffer = k.buffer
            while buffer:
                a = buffer[0]
                to = self.links.get(a.links[a.hop + 1]) or self.link(a.links[a.hop + 1])
                if to is None or to.tail != node:
                    self.from_buffer(k, t)
                    self.abort(a, t, k.name)
                    continue
                if not self.has_room(to, t) and not (k.since is not None and t - k.since > self.s.stuck_s * self.tps):
                    full = k, to
                    break
                self.from_buffer(k, t)
                a.hop += 1
                self.emit(t, "left link", link=k.name, vehicle=a.vehicle)
                self.emit(t, "entered link", link=to.name, vehicle=a.vehicle)
                self.enter(to, a, t)
        rest = len([k for k in offered if k.buffer])
        if rest == 1 and full is not None and full[0].buffer:  # with more, each tick draws who is first
            self.rest(node, *full, t)
            return False
        return rest > 0

    def rest(self, node: str, k: Link, to: Link, t: int) -> None:
        """The next tick in which the first vehicle of k may enter: there is room and inflow, or it has been stuck for too long."""
        room, used = (t, to.used) if to.room - to.used > 0.0 else (None, to.used)
        if room is None:
            for at, pce in to.gaps:
                used -= pce
                if to.room - used > 0.0:
                    room = at
                    break
            else:
                to.starved = True
        flow = _ticks(to.in_left, to.inflow, to.inflow) if to.inflow and to.in_left <= MARGIN else 0
        times = [] if room is None or flow is None else [max(room, t + flow)]
        if k.since is not None:
            times.append(k.since + math.floor(self.s.stuck_s * self.tps) + 1)
        if times:
            heapq.heappush(self.resting, (max(min(times), t + 1), node))

    # loop

    def step(self, t: int) -> None:
        legs = []
        if self.finished or self.pending:
            ended, self.finished = self.finished, []
            starting, self.pending = self.pending, []
            for a in ended:
                a.pos += 1
                if a.pos < len(a.elements):
                    (starting if a.now["kind"] == "act" else legs).append(a)
            for a in starting:
                self.start_activity(a, t)
        while self.waking and self.waking[0][0] <= t:
            _, _, a, end = heapq.heappop(self.waking)
            self.replan(a, end)
        while self.sleeping and self.sleeping[0][0] <= t:
            a = heapq.heappop(self.sleeping)[2]
            e = a.now
            self.emit(t, "actend", person=a.name, link=e["link"], x=e["x"], y=e["y"], act_type=e["act_type"])
            a.pos += 1
            (legs if a.now["kind"] == "leg" else self.pending).append(a)
        for a in legs:
            self.depart(a, t)
        if self.transit is not None:
            self.transit.start_drivers(t)
        while self.resting and self.resting[0][0] <= t:
            self.nodes.add(heapq.heappop(self.resting)[1])
        if self.nodes:
            for node in sorted(self.nodes):
                if not self.move_node(node, t):
                    self.nodes.discard(node)
        while self.due and self.due[0][0] <= t:
            at, o, k = heapq.heappop(self.due)
            k.wake = None if at == k.wake else k.wake
            if (k.queue and k.queue[0][0] <= t) or (k.flow_at is not None and k.flow_at <= t):
                self.active[o] = k
            else:
                self.watch(k, t)
        if self.active:
            links, self.active = self.active, {}
            for o in sorted(links):
                self.move_link(links[o], t)
        if self.transit is not None:
            self.transit.step(t)
        while self.flying and self.flying[0][0] <= t:
            a = heapq.heappop(self.flying)[2]
            e = a.now
            if e["mode"] in self.s.passenger_modes and e.get("line"):
                self.emit(t, "travelled with pt", person=a.name, distance=e["distance"], mode=e["mode"], line=e["line"], route=e["route"], boarding_time_ns=e["boarding_ns"], access_facility=e["access_facility"], egress_facility=e["egress_facility"])
            else:
                self.emit(t, "travelled", person=a.name, distance=e["distance"], mode=e["mode"])
            end = e["end_link"] or (a.elements[a.pos + 1]["link"] if a.pos + 1 < len(a.elements) else None)
            self.end_leg(a, t, end)

    def next_tick(self, t: int) -> int | None:
        if self.finished or self.pending or self.nodes:
            return t + 1
        heads = [h[0][0] for h in self.heaps if h]
        if self.transit is not None:
            heads += self.transit.heads()
        return max(min(heads), t + 1) if heads else None

    def run(self) -> list[tuple]:
        t, end = self.s.start_s * self.tps, self.s.end_s * self.tps
        for a in self.agents:
            if a.elements and a.now["kind"] == "act":
                self.start_activity(a, t, first=True)
        nxt: int | None = t
        while nxt is not None and nxt <= end:
            self.step(nxt)
            nxt = self.next_tick(nxt)
        for a in self.finished:  # in the last tick
            a.pos += 1
        for a in (a for a in self.agents if not a.aborted):
            leg = a.pos < len(a.elements) and a.now["kind"] == "leg"
            if leg or a.pos + 1 < len(a.elements):
                link = (a.links[a.hop] if a.links and a.now["mode"] in self.s.main_modes else a.now["start_link"]) if leg else None
                self.emit(end, "stuckAndAbort", person=a.name, link=link, leg_mode=a.now["mode"] if leg else None)
        if self.transit is not None:
            self.transit.stuck(end)
        return self.events


#: Types of the events that a sweep along a route tells.
SWEPT = frozenset({"PersonEntersVehicle", "vehicle enters traffic", "left link", "entered link", "vehicle leaves traffic"})


class Hop:
    """A link of a route that all vehicles drive, as the next vehicle finds it: what Link has, with the ticks at which those before it went on."""

    __slots__ = "flow", "room", "inflow", "stay", "back", "left", "at", "in_buffer", "inside", "turn", "passed", "used", "gaps", "in_left", "in_at"

    def __init__(self, row: tuple, tps: int):
        _, _, _, length, speed, self.flow, self.room, gap, self.inflow, _ = row
        self.stay = max(1, int(length / speed * tps))
        self.back = max(1, gap)  # nodes come before links in a tick
        self.left, self.in_left = self.flow, self.inflow
        self.at = self.in_at = 0
        self.in_buffer = self.used = 0.0
        self.inside: deque[int] = deque()  # when those in the buffer pass
        self.gaps: deque[int] = deque()  # when there is room behind those who left
        self.turn = self.passed = -1  # when the one before got into the buffer, and passed

    def flows(self, t: int, never: int) -> int:
        """The first tick from t on with flow for one who waits; as in Simulation, what the buffer has no room for is lost meanwhile."""
        flow, inside, left = self.flow, self.inside, self.left
        while left <= MARGIN:
            most = flow - self.in_buffer
            n = _ticks(left, flow, most)
            passing = inside[0] if inside else never
            if n is not None and t + n < passing:
                t, left = t + n, min(n * flow + left, most)
            elif passing < never:
                if t < passing - 1:
                    left = min((passing - 1 - t) * flow + left, most)
                while inside and inside[0] == passing:
                    inside.popleft()
                    self.in_buffer -= 1.0
                t, left = passing, min(flow + left, flow - self.in_buffer)
            else:
                return never
            if t >= never:
                return never
        self.left = left
        return t

    def has_room(self, t: int) -> bool:
        gaps = self.gaps
        while gaps and gaps[0] <= t:
            gaps.popleft()
            self.used -= 1.0
        if not self.inflow:
            return self.room - self.used > 0.0
        if self.in_at < t:
            self.in_left, self.in_at = min((t - self.in_at) * self.inflow + self.in_left, self.inflow), t
        return self.room - self.used > 0.0 and self.in_left > MARGIN

    def opens(self, t: int, limit: int) -> int:
        """The first tick after t with room and inflow; the limit, if there is none before."""
        n = _ticks(self.in_left, self.inflow, self.inflow) if self.inflow and self.in_left <= MARGIN else 0
        room, used = t, self.used
        if self.room - used <= 0.0:
            room = limit
            for at in self.gaps:
                used -= 1.0
                if self.room - used > 0.0:
                    room = at
                    break
        t = limit if n is None else min(max(room, t + n), limit)
        self.has_room(t)
        return t


def corridor(network: Network, route: Sequence[str]) -> list[tuple] | None:
    """The rows of a route's links, unless it can't be swept: some are unknown or don't follow each other, or it comes to a place again."""
    rows = [network.rows.get(x) for x in route]
    if len(rows) < 2 or None in rows or len(set(route)) < len(route):
        return None
    heads = [r[2] for r in rows[:-1]]
    return rows if heads == [r[1] for r in rows[1:]] and len(set(heads)) == len(heads) else None


def sweep(rows: list[tuple], departures: Iterable[int], s: Settings, times: list[list[int]]) -> None:
    """What Simulation does with vehicles that all drive one route, in the order of their departures: each goes its whole way before the next, as
    on a route without side roads it depends on those before it only. To the lists of times are added the ticks at which it enters
    traffic, passes each node and leaves traffic; what doesn't happen until the end is a tick later."""
    hops = [Hop(r, s.ticks_per_second) for r in rows]
    pairs, final, first = list(zip(hops, hops[1:], times[1:])), hops[-1], hops[0]
    never, stuck = s.end_s * s.ticks_per_second + 1, math.floor(s.stuck_s * s.ticks_per_second) + 1
    entering, leaving = times[0], times[-1]
    for t in departures:
        for k, to, passing in pairs:
            if t > k.turn:  # nobody waits
                inside = k.inside
                while inside and inside[0] <= t:
                    inside.popleft()
                    k.in_buffer -= 1.0
                if k.at < t:
                    k.left = min((t - k.at) * k.flow + k.left, k.flow - k.in_buffer)
            else:
                t = k.turn
            if k.left <= MARGIN and t < never:
                t = k.flows(t, never)
            k.turn = k.at = t
            if t >= never:
                break
            k.left -= 1.0
            k.in_buffer += 1.0
            if k is first:
                entering.append(t)
            else:
                k.gaps.append(t + k.back)
            since, t = (t, t + 1) if t >= k.passed else (k.passed, k.passed)
            if not to.has_room(t) and t < since + stuck:
                t = to.opens(t, since + stuck)
            k.passed = t
            if t >= never:
                break
            k.inside.append(t)
            to.used += 1.0
            to.in_left -= 1.0 if to.inflow else 0.0
            passing.append(t)
            t += to.stay
        else:
            final.turn = t = max(t, final.turn)
            final.gaps.append(t + final.back)
            leaving.append(min(t, never))
            continue
        for x in times:
            if len(x) <= len(leaving):
                x.append(never)


_NEED = ["person", "elem_idx", "kind", "act_type", "link", "x", "y", "end_ns", "max_dur_ns", "mode", "routing_mode", "trav_ns", "route_trav_ns", "start_link", "end_link", "distance", "vehicle", "links", "line", "route", "access_facility", "egress_facility", "boarding_ns", "horizon_ns"]
_PLAIN = frozenset({"person", "elem_idx", "kind", "end_ns", "mode", "links"})
#: Columns without a meaning for events of types in SWEPT, where no agent rides transit or looks for a route.
_UNREAD = frozenset({"act_type", "x", "y", "routing_mode", "end_link", "distance", "line", "route", "access_facility", "egress_facility", "boarding_ns", "horizon_ns"})
#: The kind of rows that tell a scenario's task of a vehicle: its name, with its pce and greatest speed as x and y.
_VEHICLE = "vehicle"


def _counted(df: DataFrame, what: str) -> DataFrame:
    """The table, which is to be collected, unless it has more than MOST_ELEMENTS rows."""
    n = df.count()
    if n > MOST_ELEMENTS:
        raise ValueError(f"{n} {what}, more than one task is given")
    return df


def schedule(tables: dict[str, DataFrame]) -> list[Bus]:
    """The departures of transit tables (``departures, route_stops, routes, stop_facilities``), each with a driver and a vehicle of its own."""
    d = transit.own_vehicles(transit.sequences(tables["departures"])).join(tables["routes"].select("line", "route", "mode"), ["line", "route"])
    d = d.join(transit.end_links(tables["route_stops"], tables["stop_facilities"]), ["line", "route"])
    stops = transit.offsets(tables["route_stops"]).groupBy("line", "route").agg(F.array_sort(F.collect_list(F.struct("pos", "facility", "arr_off_ns", "dep_off_ns"))).alias("stops"))
    rows = _counted(d.join(stops, ["line", "route"]), "departures").orderBy("line", "route", "sequence").collect()
    out = []
    for r in rows:
        at = [(s["facility"], r["dep_ns"] + s["arr_off_ns"], r["dep_ns"] + s["dep_off_ns"]) for s in r["stops"]]
        out.append(Bus(f"pt_{r['line']}_{r['route']}_{r['id']}", r["vehicle"], r["line"], r["route"], r["id"], r["mode"] or "pt", (r["start_link"], r["end_link"]), at, r["sequence"]))
    return out


def simulate(elements: DataFrame, links: DataFrame, vehicles: DataFrame | None = None, settings: Settings = Settings(), scenario: str = "scenario", transit_tables: dict[str, DataFrame] | None = None, graph: routing.Graph | None = None, types: Sequence[str] | None = None, ordered: bool = True, plan: Column | None = None) -> DataFrame:
    """The event log of every scenario: ``scenario`` and the columns of an event log.

    elements: the selected plans' element rows with a ``scenario`` column; links: one row per link, the same for all; vehicles: ``vehicle, pce,
    max_v``, of which a task gets those that its scenarios drive. With ``transit_tables`` legs of passenger modes that name a line wait for its vehicles and ride them; without, they are teleported.
    With a ``graph`` agents whose activity has a ``horizon_ns`` look for a least-cost route of their next trip that long before the activity ends.
    Agents who haven't finished at the end are stuck. An empty table gives an empty log. With ``types`` only the events of these types leave the
    tasks, as the filtered log: their ``seq`` stays the place in the whole one, and fields that none of them has are left out. Not ordered, the log has
    no ``seq`` and a scenario's events come in any order; those of types in SWEPT are then swept where that can be done.
    With a ``plan`` elements has a row per person instead, which that column, an array of structs, makes the element rows of; where there are no
    vehicles, only in the tasks."""
    known = [] if plan is None else elements.select(plan.alias("plan")).schema["plan"].dataType.elementType.names
    size = F.count(F.lit(1)) if plan is None else F.sum(F.greatest(F.size(plan.getField("kind")), F.lit(0)))
    sizes = elements.groupBy(scenario).agg(size.alias("count")).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("count", scenario)).alias("top"), F.sum("count").alias("rows")).first()
    if sizes["n"] and sizes["top"][0] > MOST_ELEMENTS:
        raise ValueError(f"scenario {sizes['top'][1]} has {sizes['top'][0]} elements, more than one task is given")
    kinds = lambda c: "bigint" if c.endswith("_ns") else "array<string>" if c == "links" else "double" if c in ("x", "y", "distance") else "string"
    asked = ["person", "kind", "vehicle", "x", "y"] if vehicles is not None else ["person", "kind"]
    swept = not ordered and vehicles is None and transit_tables is None and graph is None and not settings.passing and types is not None and SWEPT.issuperset(types)
    unread = _UNREAD if swept else ()
    # one task has many scenarios, in rows that follow each other; by their bytes Spark would put too many of them into one
    tasks = min(shuffle_partitions(elements.sparkSession), max(sizes["n"], 1), (sizes["rows"] or 0) // LEAST_ELEMENTS + 1)
    spread = lambda df: df.repartition(tasks, F.col(scenario)).sortWithinPartitions(scenario)
    folded = plan is not None and vehicles is None
    if folded:  # a list a column and person
        rows = spread(elements).select(scenario, "person", *(plan.getField(c).alias(c) for c in _NEED if c in known and c not in unread))
    else:
        elements = elements if plan is None else elements.select(scenario, "person", F.explode(plan).alias("element")).select(scenario, "person", "element.*")
        rows = elements.select(scenario, *(F.col(c) if c in elements.columns else F.lit(None).cast(kinds(c)).alias(c) for c in _NEED if c in asked or c in elements.columns and c not in unread))
    net = _counted(links.select("id", "from_node", "to_node", "length_m", "capacity", "freespeed", "permlanes").dropDuplicates(["id"]), "links").toPandas()
    if vehicles is not None:
        rows = rows.unionByName(_fleet(rows, vehicles.select("vehicle", "pce", "max_v"), scenario, settings, sizes["n"]))
    shared = elements.sparkSession.sparkContext.broadcast((net, schedule(transit_tables) if transit_tables is not None else None, graph))
    kind = elements.schema[scenario].dataType.simpleString()
    kept = None if types is None else frozenset(types)
    columns = [c for c in COLUMNS if kept is None or any(c in FIELDS[k] for k in kept)]
    schema = f"time_ns bigint, {'seq bigint, ' if ordered else ''}type string" + "".join(f", {c} {KINDS.get(c, 'string')}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net_, buses, g = shared.value
        batches = _opened(batches) if folded else batches
        network, out, route = Network(net_, settings), _Log(scenario, columns, ordered), None
        if g is not None:
            cost = routing.free_cost(g)  # the same at any time

            @lru_cache(100_000)
            def found(a: str, z: str) -> tuple[str, ...] | None:
                way = routing.path(g, a, z, 0.0, cost, False)
                return None if way is None else (a, *way[0])

            def route(a: str, z: str, _: float) -> list[str] | None:
                return None if (way := found(a, z)) is None else list(way)

        gc.disable()  # what a scenario leaves has no cycles
        try:
            for told, others in _swept(batches, out, network, settings, kept) if swept else [((), batches)]:
                yield from told
                for key, plans, fleet in _scenarios(others, out):
                    mine = None if buses is None else [copy.copy(b) for b in buses]
                    for b in mine or ():
                        b.riders = []
                    sim = Simulation(network, plans, fleet, settings, mine, route, kept)
                    log, sim.transit = sim.run(), None
                    yield from out.add(key, log, sim.seq)
            yield from out.rest()
        finally:
            gc.enable()

    return (rows if folded else spread(rows)).mapInArrow(run, f"`{scenario}` {kind}, {schema}")


def _fleet(rows: DataFrame, vehicles: DataFrame, scenario: str, settings: Settings, scenarios: int) -> DataFrame:
    """A row of kind _VEHICLE for the vehicles that each scenario drives and that the fleet knows; the fleet is spread like the plans."""
    fleet = vehicles.dropDuplicates(["vehicle"])
    n = fleet.count()
    if n > MOST_ELEMENTS * max(scenarios, 1):
        raise ValueError(f"{n} vehicles, more than the tasks of {scenarios} scenarios are given")
    fleet = F.broadcast(fleet) if n <= BROADCAST_ROWS else fleet.hint("merge")  # by its estimated size Spark may broadcast any
    own = F.when(F.length("vehicle") > 0, F.col("vehicle")).otherwise(F.concat_ws("_", F.col("person").cast("string"), "mode"))
    driven = rows.filter((F.col("kind") == "leg") & F.col("mode").isin(*settings.main_modes)).select(F.col(scenario), own.alias("vehicle"))
    known = {"kind": F.lit(_VEHICLE), "vehicle": F.col("vehicle"), "x": F.col("pce").cast("double"), "y": F.col("max_v").cast("double")}
    return driven.join(fleet, "vehicle").select(scenario, *(known.get(c, F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns[1:]))


def _listed(v: pa.Array, ns: bool) -> Iterable:
    """The values of a column; what is missing or no number is None, and times are integers. Equal texts are one object."""
    if v.null_count == len(v):
        return repeat(None, len(v))
    if pa.types.is_string(v.type):
        codes = v.dictionary_encode()
        texts = [*codes.dictionary.to_pylist(), None]
        return [texts[i] for i in pc.fill_null(codes.indices, len(texts) - 1).to_numpy().tolist()]
    if pa.types.is_list(v.type) and pa.types.is_string(v.type.value_type):
        at, texts = v.offsets.to_numpy().tolist(), list(_listed(v.values, False))
        return [texts[i:j] if ok else None for i, j, ok in zip(at, at[1:], v.is_valid().to_numpy(zero_copy_only=False).tolist())]
    if pa.types.is_integer(v.type):
        if not v.null_count:
            return v.to_numpy().tolist()
        return [x if ok else None for x, ok in zip(pc.fill_null(v, 0).to_numpy().tolist(), v.is_valid().to_numpy(zero_copy_only=False).tolist())]
    if pa.types.is_floating(v.type):
        return [None if x is None or x != x else int(x) if ns else x for x in v.to_pylist()]
    return [None if x is None else int(x) for x in v.to_pylist()] if ns else v.to_pylist()


def _scenarios(batches: Iterator[pa.RecordBatch], out: _Log) -> Iterator[tuple[object, list[dict], dict[str, tuple[float, float]]]]:
    """The elements and the fleet of one scenario after the other, from batches in the order of the scenarios."""
    key, rows, fleet, any_ = None, [], {}, False
    for batch in batches:
        out.kind = batch.schema.field(0).type
        have = dict(zip(batch.schema.names[1:], batch.columns[1:]))
        elements = zip(*(_listed(have[c], c.endswith("_ns")) if c in have else repeat(None, len(batch)) for c in _NEED))
        kind, vehicle, x, y = (_NEED.index(c) for c in ("kind", "vehicle", "x", "y"))
        for k, e in zip(batch.column(0).to_pylist(), elements):
            if k != key or not any_:
                if any_:
                    yield key, rows, fleet
                key, rows, fleet, any_ = k, [], {}, True
            if e[kind] == _VEHICLE:
                fleet[e[vehicle]] = float(e[x]), float(e[y])
            else:
                rows.append(dict(zip(_NEED, e)))
    if any_:
        yield key, rows, fleet


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The element rows of persons whose columns, but the first two, are lists of an item an element."""
    for batch in batches:
        person = pc.list_parent_indices(batch.column(2))
        yield pa.RecordBatch.from_arrays([*(c.take(person) for c in batch.columns[:2]), *(c.flatten() for c in batch.columns[2:])], names=batch.schema.names)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """The rows of batches in the order of the scenarios, cut between scenarios, and where each scenario of them ends."""
    rest: list[pa.RecordBatch] = []

    def together() -> tuple[pa.RecordBatch, list[int]]:
        block = pa.concat_batches(rest)
        return block, pc.run_end_encode(block.column(0)).run_ends.to_pylist()

    for batch in batches:
        if not len(batch):
            continue
        ends = pc.run_end_encode(batch.column(0)).run_ends.to_pylist()
        last = ends[-2] if len(ends) > 1 else 0
        if last or rest and rest[-1].column(0)[-1] != batch.column(0)[0]:
            rest += [batch.slice(0, last)]
            yield together()
            rest = []
        rest.append(batch.slice(last))
    if rest:
        yield together()


def _swept(batches: Iterator[pa.RecordBatch], out: _Log, network: Network, s: Settings, kept: frozenset[str]) -> Iterator[tuple[list[pa.RecordBatch], list[pa.RecordBatch]]]:
    """Sweeps scenarios whose agents all drive one route from one activity to another: batches of their events, and the rows of the other scenarios."""
    start, tps, ways = s.start_s * s.ticks_per_second, s.ticks_per_second, {}
    for block, ends in _whole(batches):
        out.kind = block.schema.field(0).type
        have = dict(zip(block.schema.names[1:], block.columns[1:]))
        if not _PLAIN <= have.keys() or not pa.types.is_string(have["person"].type) or not pa.types.is_integer(have["end_ns"].type) or have["person"].null_count or have["elem_idx"].null_count:
            yield [], [block]
            continue
        person, place, kind, end, mode, links, vehicle = (list(_listed(have[c], False)) if c in have else [None] * len(block) for c in ("person", "elem_idx", "kind", "end_ns", "mode", "links", "vehicle"))
        groups: dict[tuple, tuple] = {}
        others: list[list[int]] = []
        for i, j in zip([0, *ends], ends):
            n, who, drives, by = (j - i) // 3, person[i:j:3], links[i + 1 : j : 3], mode[i + 1 : j : 3]
            first, second, third = (place[x:j:3] for x in (i, i + 1, i + 2))
            plain = kind[i:j] == ["act", "leg", "act"] * n and who == person[i + 1 : j : 3] == person[i + 2 : j : 3] and len(set(who)) == n and all(map(lt, first, second)) and all(map(lt, second, third))
            plain = plain and None not in end[i:j:3] and by[0] in s.main_modes and by.count(by[0]) == n and drives[0] and drives.count(drives[0]) == n
            if plain and (way := tuple(drives[0])) not in ways:
                ways[way] = corridor(network, way)
            if not plain or ways[way] is None:
                if others and others[-1][1] == i:
                    others[-1][1] = j
                else:
                    others.append([i, j])
                continue
            rows, whos, cars, left, times = groups.setdefault((way, by[0]), ([], [], [], [], [[] for _ in range(len(way) + 1)]))
            ticks, who, car = zip(*sorted(zip([max(-(-x * tps // NS), start) for x in end[i:j:3]], who, vehicle[i + 1 : j : 3])))
            sweep(ways[way], ticks, s, times)
            rows += [i] * n
            whos += who
            cars += [v or f"{p}_{by[0]}" for p, v in zip(who, car)]
            left += ticks
        told = [x for g, v in groups.items() for x in out.told(block.column(0).take(pa.array(v[0])), *g, *v[1:], s, kept)]
        yield told, [block.slice(i, j - i) for i, j in others]


def _arrow(column: str) -> pa.DataType:
    return {"double": pa.float64(), "bigint": pa.int64()}.get(KINDS.get(column), pa.string())


class _Log:
    """Events of scenarios on their way to batches."""

    def __init__(self, scenario: str, columns: Sequence[str] = COLUMNS, ordered: bool = True):
        self.scenario, self.columns, self.kind, self.ordered = scenario, columns, pa.string(), ordered
        self.keys: list = []
        self.seq: list[int] = []
        self.events: list[tuple] = []

    def add(self, key: object, log: list[tuple], seq: Sequence[int]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(log), BATCH):
            part = log[i : i + BATCH]
            self.keys += [key] * len(part)
            self.seq += seq[i : i + BATCH]
            self.events += part
            if len(self.events) >= BATCH:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if not self.events:
            return
        n = len(self.events)
        times, types, fields = zip(*self.events)
        used = {f for t in set(types) for f in FIELDS[t]}
        columns = {self.scenario: pa.array(self.keys, self.kind), "time_ns": pa.array(times, pa.int64()), "seq": pa.array(self.seq, pa.int64()), "type": pa.array(types, pa.string())}
        if not self.ordered:
            del columns["seq"]
        for c in self.columns:
            kind = _arrow(c)
            columns[c] = pa.array([f.get(c) for f in fields], kind, from_pandas=True) if c in used else pa.nulls(n, kind)
        self.keys, self.seq, self.events = [], [], []
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def told(self, keys: pa.Array, way: Sequence[str], mode: str, whos: list[str], cars: list[str], left: list[int], times: list[list[int]], s: Settings, kept: frozenset[str]) -> Iterator[pa.RecordBatch]:
        """The events of a sweep."""
        tps, fields = s.ticks_per_second, {"person": pa.array(whos, pa.string()), "vehicle": pa.array(cars, pa.string()), "network_mode": mode, "relative_position": 1.0}
        kinds = [("PersonEntersVehicle", None, left), ("vehicle enters traffic", way[0], times[0]), ("vehicle leaves traffic", way[-1], times[-1])]
        for a, b, t in zip(way, way[1:], times[1:]):
            kinds += [("left link", a, t), ("entered link", b, t)]
        for kind, link, ticks in kinds:
            if kind in kept:
                t = np.array(ticks, np.int64)
                columns = {self.scenario: keys, "time_ns": pa.array(t // tps * NS + t % tps * NS // tps), "type": pa.repeat(kind, len(t))}
                for c in self.columns:
                    v = (fields | {"link": link}).get(c) if c in FIELDS[kind] else None
                    columns[c] = v if isinstance(v, pa.Array) else pa.nulls(len(t), _arrow(c)) if v is None else pa.repeat(pa.scalar(v, _arrow(c)), len(t))
                batch = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns)).filter(pa.array(t <= s.end_s * tps))
                yield from (batch.slice(i, BATCH) for i in range(0, len(batch), BATCH))
