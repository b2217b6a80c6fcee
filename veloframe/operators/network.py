"""Road networks as node and link tables: modes, weights, partitions, cores, distances and edits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veloframe.operators.dualtree import nearest_segment
from veloframe.storage import materialize, parameters

EDGE = ["from_node", "to_node"]
#: Edges that are searched in one task; more are by rounds of joins.
MOST_EDGES = 4_000_000


def allows(modes: Column, mode: str) -> Column:
    return F.array_contains(modes, mode)


def without_modes(links: DataFrame) -> DataFrame:
    """Links that nothing may use; they are counted and reported, and stay."""
    return links.filter(F.size("modes") == 0)


def modes_of(links: DataFrame) -> DataFrame:
    """The distinct modes of a network, ``mode``."""
    return links.select(F.explode("modes").alias("mode")).distinct()


def mode_union(links: DataFrame, key: str) -> DataFrame:
    """``key, modes``: the modes of all links of a key, sorted and distinct; empty where no link has any. Modes meet before the shuffle."""
    per = links.select(key, F.explode_outer("modes").alias("m")).distinct().groupBy(key).agg(F.array_sort(F.collect_list("m")).alias("modes"))
    return per


def with_ends(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links with the coordinates ``x0, y0, x1, y1`` of their nodes; links with an unknown node are left out (see references)."""
    n = nodes.select("id", "x", "y").distinct()
    return links.join(n.toDF("from_node", "x0", "y0"), "from_node").join(n.toDF("to_node", "x1", "y1"), "to_node")


def nearest_link(points: DataFrame, links: DataFrame, nodes: DataFrame, mode: str | None = None) -> DataFrame:
    """``id, link, distance`` of the link closest to each point (``id, x, y``), of one mode if given; ties go to the smallest id."""
    usable = links.filter(allows(F.col("modes"), mode)) if mode else links
    found = nearest_segment(points, with_ends(usable.select("id", *EDGE).distinct(), nodes).select("id", "x0", "y0", "x1", "y1"))
    return found.withColumnRenamed("segment", "link")


def nearest_node(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, node, distance`` of the node closest to each point; ties go to the smallest id."""
    dots = nodes.select("id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    return nearest_segment(points, dots).withColumnRenamed("segment", "node")


def modal_link(facilities: DataFrame, links: DataFrame, nodes: DataFrame, mode: str, base_first: bool = True) -> DataFrame:
    """``id, link`` for a mode: the base link if it allows the mode (base first), else the nearest link of the mode, else the base link.

    facilities: ``id, x, y, link``."""
    ok = links.filter(allows(F.col("modes"), mode)).select(F.col("id").alias("link")).distinct().withColumn("_ok", F.lit(True))
    rows = facilities.join(ok, "link", "left").withColumn("_own", F.col("_ok").isNotNull() & F.lit(base_first))
    near = nearest_link(rows.filter("not _own").select("id", "x", "y"), links, nodes, mode).select("id", F.col("link").alias("_near"))
    return rows.join(near, "id", "left").select("id", F.when(F.col("_own"), F.col("link")).otherwise(F.coalesce("_near", "link")).alias("link"))


def traversals(routes: DataFrame, column: str = "links") -> DataFrame:
    """``link, n``: how many routes of selected plans pass each link; counted before the shuffle."""
    return routes.select(F.explode(column).alias("link")).groupBy("link").agg(F.count(F.lit(1)).alias("n"))


def node_weights(links: DataFrame, counts: DataFrame) -> DataFrame:
    """``node, weight``: the greatest count among the links that end at a node."""
    return links.join(counts, links["id"] == counts["link"]).groupBy(F.col("to_node").alias("node")).agg(F.max("n").alias("weight"))


def vertex_weights(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node, in_links, in_capacity`` for every node; nodes that nothing leads to have 0."""
    per = links.groupBy(F.col("to_node").alias("node")).agg(F.count(F.lit(1)).alias("in_links"), F.sum("capacity").alias("in_capacity"))
    return nodes.select(F.col("id").alias("node")).distinct().join(per, "node", "left").select("node", F.coalesce("in_links", F.lit(0)).alias("in_links"), F.coalesce("in_capacity", F.lit(0.0)).alias("in_capacity"))


def undirected_edges(links: DataFrame, weight: Column) -> DataFrame:
    """``a, b, weight``: links in either direction and parallel ones as one edge, loops dropped; each weight is cut to an integer, the sum is at
    least 1."""
    rows = links.filter(F.col("from_node") != F.col("to_node")).select(F.least(*EDGE).alias("a"), F.greatest(*EDGE).alias("b"), weight.cast("long").alias("w"))
    return rows.groupBy("a", "b").agg(F.greatest(F.sum("w"), F.lit(1)).alias("weight"))


def _neighbours(links: DataFrame) -> DataFrame:
    e = undirected_edges(links, F.lit(1)).select("a", "b")
    return e.union(e.select("b", "a")).toDF("node", "other")


def dead_ends(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes outside the 2-core of the undirected network: nodes of degree 0 or 1 are peeled off until none is left.

    Each round removes all such nodes at once, so rounds grow with the depth of the deepest dead end, not with the nodes."""
    rest = materialize(_neighbours(links), "edges")
    left = rest.count()
    while True:
        kept = rest.groupBy("node").count().filter("count > 1").select("node")
        rest = materialize(rest.join(kept, "node", "left_semi").join(kept.withColumnRenamed("node", "other"), "other", "left_semi").select("node", "other"), "core")
        before, left = left, rest.count()
        if left == before:
            break
    return nodes.select(F.col("id").alias("node")).distinct().join(rest.select("node").distinct(), "node", "left_anti")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node, component``: the smallest node id of each weakly connected part.

    Labels hook onto the smallest neighbouring label and are then compressed by looking up the label's own label, so rounds grow with the
    logarithm of the diameter; hub nodes meet in map-side minima."""
    edges = materialize(_neighbours(links), "edges")
    label = materialize(nodes.select(F.col("id").alias("node")).union(edges.select("node")).filter("node is not null").distinct().withColumn("component", F.col("node")), "labels")
    while True:
        low = edges.join(label.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("low"))
        hooked = label.join(low, "node", "left").withColumn("new", F.least("component", F.coalesce("low", "component")))
        hooked = materialize(hooked, "hooked")
        # few labels, of which one may have most of the nodes, are broadcast; many are spread by themselves
        roots = parameters(hooked.groupBy(F.col("component").alias("root")).agg(F.min("new").alias("to")))
        jumped = materialize(hooked.join(roots, F.col("component") == F.col("root")).select("node", F.least("new", "to").alias("new"), "component"), "jumped")
        named = jumped.select(F.col("new").alias("_n")).distinct()
        named = parameters(named.join(jumped.select(F.col("node").alias("_n"), F.col("new").alias("_new")), "_n"))
        again = jumped.join(named, F.col("new") == F.col("_n"), "left")
        table = materialize(again.select("node", F.least("new", F.coalesce("_new", "new")).alias("new"), "component"), "labels")
        if table.filter("new <> component").isEmpty():
            return table.select("node", "component")
        label = table.select("node", F.col("new").alias("component"))


def hop_distances(nodes: DataFrame, links: DataFrame, sources: DataFrame, directed: bool = False) -> DataFrame:
    """``node, hops`` from the nearest source (``node``), by breadth-first rounds; unreachable nodes have no row.

    Up to MOST_EDGES edges are searched in one task, as rounds are as many as the network is deep; beyond, each round is a join."""
    edges = links.select(F.col("from_node").alias("node"), F.col("to_node").alias("other")).distinct() if directed else _neighbours(links)
    edges = materialize(edges.filter("node is not null and other is not null"), "edges")
    starts = materialize(sources.select("node").distinct(), "starts")
    if edges.count() <= MOST_EDGES and starts.count() <= MOST_EDGES:
        return _searched(edges, starts)
    front = materialize(starts.withColumn("hops", F.lit(0)), "front")
    reached, depth = front, 0
    while not front.isEmpty():
        depth += 1
        new = front.join(edges, "node").select(F.col("other").alias("node")).distinct()
        front = materialize(new.join(reached.select("node"), "node", "left_anti").withColumn("hops", F.lit(depth)), "front")
        reached = reached.unionAll(front)
        if depth % 16 == 0:  # few files a round
            reached = materialize(reached, "reached")
    return reached


def _searched(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Hops by one search in one task, whose rounds are no jobs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (rows := list(batches)):
            return
        table = pa.Table.from_batches(rows)
        first = table.filter(pc.field("start"))["node"]
        if first.null_count:
            yield pa.RecordBatch.from_pydict({"node": pa.nulls(1, pa.string()), "hops": pa.array([0], pa.int32())})
        first = first.drop_null()
        table = table.filter(~pc.field("start"))
        names = pc.unique(pa.chunked_array([*first.chunks, *table["node"].chunks, *table["other"].chunks], pa.string()))
        place = lambda c: pc.index_in(c, names).to_numpy()
        tail, head = place(table["node"]), place(table["other"])
        order = np.argsort(tail, kind="stable")
        head, begins = head[order], np.searchsorted(tail[order], np.arange(len(names) + 1))
        hops = np.full(len(names), -1, np.int32)
        front, depth = np.unique(place(first)), 0
        while len(front):
            hops[front] = depth
            depth += 1
            lengths = begins[front + 1] - begins[front]
            at = np.repeat(begins[front] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            next_ = np.unique(head[at])
            front = next_[hops[next_] < 0]
        found = pa.table({"node": names.filter(pa.array(hops >= 0)), "hops": pa.array(hops[hops >= 0])})
        yield from found.to_batches(max_chunksize=100_000)

    rows = edges.select("node", "other", F.lit(False).alias("start")).unionByName(starts.select("node", F.lit(None).cast("string").alias("other"), F.lit(True).alias("start")))
    return rows.coalesce(1).mapInArrow(run, "node string, hops int")


def farthest_landmarks(nodes: DataFrame, links: DataFrame, first: str, count: int) -> list[str]:
    """Landmarks: from the first on, each next one is the node with the most hops from those there are; the smallest id of equals; ends early
    when every node is a landmark or unreachable."""
    out = [first]
    spark = nodes.sparkSession
    while len(out) < count:
        far = hop_distances(nodes, links, spark.createDataFrame([(x,) for x in out], "node string"))
        top = far.filter("hops > 0").agg(F.max_by(F.struct("node", "hops"), F.struct("hops")).alias("t"), F.max("hops").alias("h")).first()
        if top["h"] is None:
            break
        out.append(far.filter(F.col("hops") == top["h"]).agg(F.min("node").alias("n")).first()["n"])
    return out


def landmark_count(n_nodes: int) -> int:
    return 16 if n_nodes >= 256 else -(-n_nodes // 16)


def relaxed_costs(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``source, node, cost``: least costs from each source over ``from_node, to_node, cost`` (not negative), by rounds of relaxation in which
    only improved nodes are expanded. For few sources on large networks; single pairs are the routing kernel's."""
    known = materialize(sources.select(F.col("node").alias("source"), "node").distinct().withColumn("cost", F.lit(0.0)), "costs")
    front = known
    e = edges.groupBy("from_node", "to_node").agg(F.min("cost").alias("step"))
    e = materialize(e, "edges")
    while not front.isEmpty():
        step = front.join(e, F.col("node") == F.col("from_node")).groupBy("source", F.col("to_node").alias("node")).agg(F.min(F.col("cost") + F.col("step")).alias("new"))
        merged = materialize(known.join(step, ["source", "node"], "full_outer").withColumn("better", F.col("new").isNotNull() & (F.col("cost").isNull() | (F.col("new") < F.col("cost")))), "costs")
        known = merged.select("source", "node", F.when(F.col("better"), F.col("new")).otherwise(F.col("cost")).alias("cost"))
        front = merged.filter("better").select("source", "node", F.col("new").alias("cost"))
    return known


def partitions(nodes: DataFrame, parts: int) -> DataFrame:
    """``node, partition_no``: coordinate bisection, a stand-in for a graph partitioner; nothing may depend on it but speed.

    Cuts are approximate medians along the longer side, so parts are about equal; ``parts`` is rounded up to a power of two."""
    rows = nodes.select(F.col("id").alias("node"), "x", "y").distinct().withColumn("partition_no", F.lit(0))
    depth = 0
    while 1 << depth < parts:
        e = rows.groupBy("partition_no").agg(F.percentile_approx("x", 0.5).alias("mx"), F.percentile_approx("y", 0.5).alias("my"), ((F.max("x") - F.min("x")) >= (F.max("y") - F.min("y"))).alias("wide"))
        rows = rows.join(e, "partition_no")  # one row a part
        rows = rows.withColumn("partition_no", F.col("partition_no") * 2 + F.when(F.col("wide"), F.col("x") > F.col("mx")).otherwise(F.col("y") > F.col("my")).cast("int")).select("node", "x", "y", "partition_no")
        depth += 1
    return rows.select("node", "partition_no")


def partition_rest(nodes: DataFrame, links: DataFrame, parts: DataFrame, main_modes: list[str]) -> DataFrame:
    """``node, partition_no`` where only nodes of main-mode links have one so far: the others take that of the nearest node that has."""
    main = links.filter(F.arrays_overlap("modes", F.array(*map(F.lit, main_modes))))
    used = main.select(F.col("from_node").alias("node")).union(main.select("to_node")).distinct()
    have = parts.join(used, "node", "left_semi")
    points = nodes.select("id", "x", "y").distinct()
    rest = points.join(have.select(F.col("node").alias("id")), "id", "left_anti")
    near = nearest_node(rest, points.join(have.select(F.col("node").alias("id")), "id", "left_semi"))
    return have.unionByName(near.join(have, "node").select(F.col("id").alias("node"), "partition_no"))


def link_partitions(links: DataFrame, parts: DataFrame) -> DataFrame:
    """Links with ``partition_no``, that of the node they end at."""
    return links.drop("partition_no").join(parts.withColumnRenamed("node", "to_node"), "to_node", "left")


def neighbour_counts(links: DataFrame, parts: DataFrame, main_modes: list[str]) -> DataFrame:
    """``partition_no, n``: other parts a part shares links with, of main-mode links; a part that has only others counts those."""
    a = links.join(parts.toDF("from_node", "p"), "from_node").join(parts.toDF("to_node", "q"), "to_node").filter("p <> q")
    main = F.arrays_overlap("modes", F.array(*map(F.lit, main_modes)))
    pairs = a.select("p", "q", main.alias("main")).union(a.select("q", "p", main))
    per = pairs.groupBy("p").agg(F.count_distinct(F.when(F.col("main"), F.col("q"))).alias("m"), F.count_distinct("q").alias("n"))
    return parts.select(F.col("partition_no").alias("p")).distinct().join(per, "p", "left").select(F.col("p").alias("partition_no"), F.coalesce(F.when(F.col("m") > 0, F.col("m")).otherwise(F.col("n")), F.lit(0)).alias("n"))


def edited(nodes: DataFrame, links: DataFrame, add_nodes: DataFrame | None = None, add_links: DataFrame | None = None, drop_nodes: DataFrame | None = None, drop_links: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and links after an edit, and what is wrong with it (``kind, id``): removed nodes take their links along; ids added twice and links
    to unknown nodes are errors."""
    if drop_links is not None:
        links = links.join(drop_links.select("id").distinct(), "id", "left_anti")
    if drop_nodes is not None:
        gone = drop_nodes.select("id").distinct()
        nodes = nodes.join(gone, "id", "left_anti")
        for end in EDGE:
            links = links.join(gone.withColumnRenamed("id", end), end, "left_anti")
    nodes = nodes.unionByName(add_nodes) if add_nodes is not None else nodes
    links = links.unionByName(add_links.select(*links.columns)) if add_links is not None else links
    twice = [df.groupBy("id").count().filter("count > 1").select(F.lit(f"repeated {k}").alias("kind"), "id") for k, df in (("node", nodes), ("link", links))]
    loose = [links.join(nodes.select(F.col("id").alias(e)), e, "left_anti").select(F.lit(f"unknown {e}").alias("kind"), "id") for e in EDGE]
    return nodes, links, reduce(DataFrame.unionAll, [*twice, *loose])


def route_distance(routes: DataFrame, links: DataFrame, key: str = "route_id", from_position: Column | None = None, to_position: Column | None = None) -> DataFrame:
    """``key, distance`` of ``links`` arrays: the whole lengths between the ends, and of the first and last link what lies after the position of
    departure and before that of arrival (1 is the end of a link). One link alone counts between both positions. Unknown lengths give null."""
    a = F.lit(1.0) if from_position is None else from_position
    z = F.lit(1.0) if to_position is None else to_position
    rows = routes.select(key, a.alias("_a"), z.alias("_z"), F.size("links").alias("_n"), F.posexplode("links").alias("_i", "link"))
    rows = rows.join(links.select(F.col("id").alias("link"), "length_m").groupBy("link").agg(F.max("length_m").alias("length_m")), "link", "left")
    first, last = F.col("_i") == 0, F.col("_i") == F.col("_n") - 1
    share = F.when(first & last, F.greatest(F.col("_z") - F.col("_a"), F.lit(0.0))).when(first, 1 - F.col("_a")).when(last, F.col("_z")).otherwise(1.0)
    return rows.groupBy(key).agg(F.sum(F.col("length_m") * share).alias("s"), F.count("length_m").alias("k"), F.max("_n").alias("n")).select(key, F.when(F.col("k") == F.col("n"), F.col("s")).alias("distance"))


def connected(routes: DataFrame, links: DataFrame, key: str = "route_id", mode: str | None = None) -> DataFrame:
    """``key, valid``: whether every link of a route exists, allows the mode, and begins where the one before ends."""
    rows = routes.select(key, F.size("links").alias("_n"), F.posexplode("links").alias("_i", "link"))
    ends = links.groupBy(F.col("id").alias("link")).agg(F.first("from_node").alias("f"), F.first("to_node").alias("t"), F.first("modes").alias("modes"))
    w = Window.partitionBy(key).orderBy("_i")
    rows = rows.join(ends, "link", "left").withColumn("_next", F.lead("f").over(w))
    ok = F.col("f").isNotNull() & ((F.col("_i") == F.col("_n") - 1) | (F.col("t") == F.col("_next")))
    ok = ok & F.coalesce(allows(F.col("modes"), mode), F.lit(False)) if mode else ok
    return rows.groupBy(key).agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("valid"))
