"""Dual-tree joins of points and boxes: near pairs, nearest neighbours and containing regions, over trees whose nodes are rows of distributed
tables.

A tree is a pyramid of grid cells: a node is a non-empty cell with the tight bounding box of what lies in it. A join starts with the pairs
of root nodes and works on all pairs of a level at once: pairs of boxes that are too far apart are dropped, pairs that are certainly near
are accepted wholesale, small pairs become leaves to be compared exactly, the rest is replaced by the pairs of their children. Each step is
an equi-join on the parent's id, so a level is spread over all executors; what is dense goes deeper, and what is still dense in the finest
nodes is dealt out in chunks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veloframe.storage import materialize

#: Each level splits a cell into 4 x 4.
FAN = 2
#: A pair of nodes with at most this many pairs of points is compared exactly instead of being split.
LEAF_PAIRS = 2_048
#: Points of a node are handed out in chunks of about this many, so that no task gets a whole dense node.
CHUNK = 2_048
#: So many levels below the one on which the tree has about a node per object: places so much denser than the mean get nodes of their own.
DEEPER = 2
#: So many levels are decided in one job.
LEVELS_A_JOB = 2
#: A grid has at most this many coarser levels; what lies beyond it shares the last cell, whose box stays tight.
MOST_LEVELS = 24
#: A piece of a long segment is at most this long (in units of the data).
PIECE = 1_000.0


@dataclass(frozen=True)
class Grid:
    """Finest cells of this size from the least coordinates on; ``levels`` coarser grids above it, the coarsest of at most 4 x 4 cells."""

    size: float
    x: float
    y: float
    levels: int

    def cell(self, x: Column, y: Column, level: Column | int = 0) -> tuple[Column, Column]:
        shift = level * F.lit(FAN) if isinstance(level, Column) else F.lit(FAN * level)
        inside = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(float(3 << FAN * MOST_LEVELS)), v))
        at = lambda c, o: F.call_function("shiftright", F.floor(inside((c - F.lit(o)) / F.lit(self.size))).cast("long"), shift.cast("int"))
        return at(x, self.x).alias("gx"), at(y, self.y).alias("gy")


def _grid(objects: DataFrame, size: float | None = None) -> Grid:
    """objects: ``cx, cy``, by which they are placed. Without a size of the finest cells they get one by the number of objects."""
    e = objects.agg(F.min("cx").alias("x"), F.min("cy").alias("y"), F.greatest(F.max("cx") - F.min("cx"), F.max("cy") - F.min("cy")).alias("m"), F.count(F.lit(1)).alias("n")).first()  # one row
    if not size:
        depth = ceil(log(max(e.n, 1), 1 << 2 * FAN)) + DEEPER
        size = (e.m or 1.0) / (1 << FAN * min(depth, MOST_LEVELS))
    k = 0
    while e.m is not None and e.m / (size * (1 << FAN * k)) > 3 and k < MOST_LEVELS:
        k += 1
    return Grid(size, e.x or 0.0, e.y or 0.0, k)


def _pyramid(objects: DataFrame, grid: Grid) -> list[DataFrame]:
    """Node tables from coarse to fine: ``gx, gy, n, x0, y0, x1, y1, w``. objects: ``cx, cy``, their boxes and, if they have one, a weight ``w``.

    The finest nodes are counted first, map-side; the coarser levels are made of those in one job."""
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    weight = F.sum("w") if "w" in objects.columns else F.count(F.lit(1))
    finest = objects.groupBy(*grid.cell(F.col("cx"), F.col("cy"))).agg(F.count(F.lit(1)).alias("n"), weight.alias("w"), *box)
    every = finest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(grid.levels))))
    up = lambda c: F.call_function("shiftright", F.col(c), F.col("level") * FAN).alias(c)
    table = materialize(every.groupBy("level", up("gx"), up("gy")).agg(F.sum("n").alias("n"), F.sum("w").alias("w"), *box), "nodes")
    return [table.filter(F.col("level") == k).drop("level") for k in range(grid.levels, -1, -1)]


def _root_pairs(a: DataFrame, b: DataFrame, once: bool) -> DataFrame:
    """All pairs of the coarsest nodes of two trees, each pair in one order only if ``once``: at most 16 x 16 rows, put together on the driver."""
    left = sorted(map(tuple, a.collect()))
    right = left if once else sorted(map(tuple, b.collect()))
    kinds = ", ".join(f"{s}{f.name} {f.dataType.simpleString()}" for s, df in (("a", a), ("b", b)) for f in df.schema)
    return a.sparkSession.createDataFrame([(*x, *y) for x in left for y in right if not once or x[:2] <= y[:2]], kinds).coalesce(1)


def _descend(step: Callable[[int, DataFrame | None], DataFrame], levels: int) -> DataFrame:
    """The pairs that aren't ``open``, with their ``level``. step: from the open pairs of the level before (None at first), the pairs of the k-th level
    with their ``state``."""
    done, group, pairs = [], [], None
    for k in range(levels + 1):
        pairs = step(k, pairs)
        group.append(pairs.withColumn("level", F.lit(levels - k)))
        if len(group) < LEVELS_A_JOB and k < levels:
            pairs = pairs.filter("state = 'open'").drop("state")
            continue
        table = materialize(reduce(DataFrame.unionByName, [*(g.filter("state <> 'open'") for g in group[:-1]), group[-1]]), "node-pairs")
        done.append(table.filter("state <> 'open'"))
        pairs, group = table.filter("state = 'open'").drop("state", "level"), []
        if k < levels and pairs.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def _node(side: str) -> list[str]:
    return [f"{side}{c}" for c in ("gx", "gy", "n", "x0", "y0", "x1", "y1", "w")]


def _as(nodes: DataFrame, side: str) -> DataFrame:
    return nodes.select(*(F.col(c[1:]).alias(c) for c in _node(side)), F.shiftright("gx", FAN).alias(f"{side}px"), F.shiftright("gy", FAN).alias(f"{side}py"))


def _least2() -> Column:
    """Least squared distance between the boxes a and b."""
    d = lambda c: F.greatest(F.lit(0.0), F.col(f"a{c}0") - F.col(f"b{c}1"), F.col(f"b{c}0") - F.col(f"a{c}1"))
    return d("x") * d("x") + d("y") * d("y")


def _most2() -> Column:
    """Greatest squared distance between points of the boxes a and b."""
    d = lambda c: F.greatest(F.col(f"a{c}1") - F.col(f"b{c}0"), F.col(f"b{c}1") - F.col(f"a{c}0"))
    return d("x") * d("x") + d("y") * d("y")


def _children(pairs: DataFrame, a: DataFrame, b: DataFrame, r2: float | None) -> DataFrame:
    """Pairs of the children of both nodes; with r2, a's children that are too far from b go before b is split."""
    ids = pairs.select(F.col("agx").alias("apx"), F.col("agy").alias("apy"), F.col("bgx").alias("bpx"), F.col("bgy").alias("bpy"), *([] if r2 is None else _node("b")[3:]), *(c for c in ("bound2",) if c in pairs.columns))
    half = ids.join(_as(a, "a"), ["apx", "apy"])
    if r2 is not None:
        half = half.filter(_least2() <= r2).drop(*_node("b")[3:])
    return half.join(_as(b, "b"), ["bpx", "bpy"]).drop("apx", "apy", "bpx", "bpy")


def _chunks(n: str) -> Column:
    return F.ceil(F.col(n) / F.lit(CHUNK)).cast("int")


def _depths(nodes: DataFrame) -> list[int]:
    """The levels that occur: at most one per level of the tree."""
    return [r["level"] for r in nodes.select("level").distinct().collect()]


def _placed(objects: DataFrame, x: str, y: str, nodes: DataFrame, grid: Grid, depths: list[int]) -> DataFrame:
    """Objects with the ``level, gx, gy, ...`` of each of these nodes that they lie in."""
    levels = F.array(*map(F.lit, depths)) if depths else F.array().cast("array<int>")
    at = F.explode(F.transform(levels, lambda k: F.struct(k.alias("level"), *grid.cell(F.col(x), F.col(y), k))))
    return objects.withColumn("_g", at).select(*objects.columns, "_g.*").join(nodes, ["level", "gx", "gy"])


def _meet(leaves: DataFrame, a: DataFrame, b: DataFrame, grid: Grid, a_id: str, b_id: str) -> DataFrame:
    """The objects of both sides of each leaf pair ``level, agx, agy, an, bgx, bgy, bn, ...`` together; a has ``ax, ay``, b ``bx, by``, by which they
    are placed.

    Objects of a node with many are dealt into chunks by the hash of their id, so a unit of work has a bounded number of pairs."""
    depths = _depths(leaves)
    work = leaves.withColumn("ac", F.explode(F.sequence(F.lit(0), _chunks("an") - 1))).withColumn("bc", F.explode(F.sequence(F.lit(0), _chunks("bn") - 1)))

    def side(objects: DataFrame, s: str, id: str) -> DataFrame:
        used = leaves.select("level", *(F.col(f"{s}{c}").alias(c) for c in ("gx", "gy", "n"))).distinct()
        rows = _placed(objects, f"{s}x", f"{s}y", used, grid, depths).withColumn(f"{s}c", F.pmod(F.xxhash64(id), _chunks("n")).cast("int"))
        return rows.drop("n").withColumnsRenamed({"gx": f"{s}gx", "gy": f"{s}gy"})

    return work.drop("an", "bn").join(side(a, "a", a_id), ["level", "agx", "agy", "ac"]).join(side(b, "b", b_id), ["level", "bgx", "bgy", "bc"])


def _refine(leaves: DataFrame, points: DataFrame, grid: Grid, r2: float) -> DataFrame:
    """Pairs of points of the leaf pairs ``level, agx, agy, an, bgx, bgy, bn, sure``: those within the radius, all where ``sure``."""
    side = lambda s: points.select(*(F.col(c).alias(f"{s}{c}") for c in ("id", "x", "y", "w")))
    pairs = _meet(leaves, side("a"), side("b"), grid, "aid", "bid")
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    near = F.col("sure") | (dx * dx + dy * dy <= F.lit(r2))
    same = (F.col("agx") == F.col("bgx")) & (F.col("agy") == F.col("bgy"))
    return pairs.filter(near & F.when(same, F.col("aid") < F.col("bid")).otherwise(F.col("aid") != F.col("bid")))


def located(df: DataFrame, id: str, x: str, y: str) -> DataFrame:
    """Distinct ``id, x, y`` of the rows with a location: null or not finite coordinates, and x = 0 with y = 0, are none."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return df.select(F.col(id).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter(F.col("id").isNotNull() & ok("x") & ok("y") & ~((F.col("x") == 0) & (F.col("y") == 0))).distinct()


def _near_nodes(points: DataFrame, radius: float) -> tuple[DataFrame, Grid]:
    """The pairs of nodes in which everything is within the radius (``sure``) or has to be compared: ``level, agx, agy, an, aw, bgx, bgy, bn, bw, sure``,
    and their grid. points: ``id, x, y, w``. The finest cells have the radius as their diagonal."""
    if not radius >= 0:
        raise ValueError(f"{radius} is no radius")
    r2 = radius * radius
    x, y = F.col("x"), F.col("y")
    objects = points.select(x.alias("cx"), y.alias("cy"), x.alias("x0"), y.alias("y0"), x.alias("x1"), y.alias("y1"), "w")
    grid = _grid(objects, radius / 2.0**0.5)
    pyramid, levels = _pyramid(objects, grid), grid.levels
    once = (F.col("agx") < F.col("bgx")) | ((F.col("agx") == F.col("bgx")) & (F.col("agy") <= F.col("bgy")))

    def step(k: int, pairs: DataFrame | None) -> DataFrame:
        if pairs is None:
            pairs = _root_pairs(pyramid[0], pyramid[0], True)
        else:
            pairs = _children(pairs, pyramid[k], pyramid[k], r2)
            pairs = pairs.filter(once | ~((F.shiftright("agx", FAN) == F.shiftright("bgx", FAN)) & (F.shiftright("agy", FAN) == F.shiftright("bgy", FAN))))
        state = F.when(_most2() <= r2, "sure").when((F.col("an") * F.col("bn") <= LEAF_PAIRS) | F.lit(k == levels), "leaf").otherwise("open")
        return pairs.filter(_least2() <= r2).withColumn("state", state)

    done = _descend(step, levels).select("level", "agx", "agy", "an", "aw", "bgx", "bgy", "bn", "bw", (F.col("state") == "sure").alias("sure"))
    return done, grid


def near_pairs(df: DataFrame, id: str, x: str, y: str, radius: float) -> DataFrame:
    """``id_a, id_b`` of the different ids at most ``radius`` apart (inclusive), the smaller id first, each pair once.

    Rows without an id or a location are in no pair; repeated rows count once; an id with several locations is near whatever any of them is
    near. The result has every pair, also those of equal points, which with many points on one spot is much: ``near_counts`` has the same
    links without writing them all out. An empty table gives an empty result; a radius of 0 pairs equal points; a negative one is an error."""
    points = materialize(located(df, id, x, y).withColumn("w", F.lit(1).cast("long")), "points")
    several = not points.groupBy("id").count().filter("count > 1").isEmpty()
    nodes, grid = _near_nodes(points, radius)
    found = _refine(nodes.drop("aw", "bw"), points, grid, radius * radius)
    result = found.select(F.least("aid", "bid").alias("id_a"), F.greatest("aid", "bid").alias("id_b"))
    return result.distinct() if several else result


def near_counts(df: DataFrame, id: str, x: str, y: str, radius: float) -> DataFrame:
    """``id, place, n_near``: one row per id and place with the number of others at most ``radius`` away (inclusive).

    Ids at one place are a class, named by its coordinates; classes meet in the tree with the number of their members as weight. Pairs of
    nodes that are near as a whole are added up as wholes; only members of uncertain leaves are compared. So many points on one spot, or in
    one spot's neighbourhood, cost no more than few. An id with several places has a row for each, and its other places count as others.
    Rows without an id or a location are left out; an empty table gives an empty result; a negative radius is an error."""
    members = materialize(located(df, id, x, y).withColumn("place", F.concat_ws(",", F.col("x") + F.lit(0.0), F.col("y") + F.lit(0.0))), "members")
    points = materialize(members.groupBy(F.col("place").alias("id")).agg(F.first("x").alias("x"), F.first("y").alias("y"), F.count(F.lit(1)).alias("w")), "places")
    nodes, grid = _near_nodes(points, radius)
    sure = nodes.filter("sure")
    own = (F.col("agx") == F.col("bgx")) & (F.col("agy") == F.col("bgy"))
    gains = sure.select("level", F.col("agx").alias("gx"), F.col("agy").alias("gy"), F.col("bw").alias("gain"), own.cast("long").alias("own"))
    gains = gains.unionAll(sure.filter(~own).select("level", "bgx", "bgy", "aw", F.lit(0).cast("long")))
    gains = gains.groupBy("level", "gx", "gy").agg(F.sum("gain").alias("gain"), F.sum("own").alias("own"))
    whole = _placed(points.select("id", "x", "y", "w"), "x", "y", gains, grid, _depths(sure)).select("id", (F.col("gain") - F.col("own") * F.col("w")).alias("n"))
    one = _refine(nodes.filter("not sure").drop("aw", "bw"), points, grid, radius * radius)
    one = one.select(F.explode(F.array(F.struct(F.col("aid").alias("id"), F.col("bw").alias("n")), F.struct(F.col("bid").alias("id"), F.col("aw").alias("n")))).alias("e")).select("e.*")
    per = points.select("id", (F.col("w") - 1).alias("n")).unionAll(whole).unionAll(one).groupBy("id").agg(F.sum("n").alias("n_near"))
    return members.select("id", "place").join(per.withColumnRenamed("id", "place"), "place").select("id", "place", "n_near")


def nearest_segment(points: DataFrame, segments: DataFrame, finest: float | None = None) -> DataFrame:
    """``id, segment, distance`` of the segment closest to each point; equal distances go to the smallest segment id.

    points: ``id, x, y``; segments: ``id, x0, y0, x1, y1``, several rows of an id are parts of one. Rows with a null in any of these are left
    out; an empty table on either side gives an empty result. Long segments enter the tree as pieces of bounded length, so boxes stay
    tight; distances are those to the whole segment. A pair of nodes goes when it is farther than the closest certain node of its points;
    a node with few candidates left is compared with them, the others are split, and the finest ones are dealt out in chunks."""
    pts = materialize(points.select("id", "x", "y").na.drop().distinct(), "points")
    seg = segments.select("id", "x0", "y0", "x1", "y1").na.drop().distinct()
    n = F.greatest(F.lit(1), F.ceil(F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2) / F.lit(PIECE))).cast("int")
    cut = seg.withColumn("k", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    on = lambda a, z, i: F.col(a) + (F.col(z) - F.col(a)) * i / F.col("k")
    cut = cut.select("id", "i", "x0", "y0", "x1", "y1", *(on(f"{c}0", f"{c}1", F.col("i") + j).alias(f"{c}{m}") for c in "xy" for j, m in ((0, "p"), (1, "q"))))
    pieces = materialize(cut.select("id", "i", "x0", "y0", "x1", "y1", ((F.col("xp") + F.col("xq")) / 2).alias("cx"), ((F.col("yp") + F.col("yq")) / 2).alias("cy"), F.least("xp", "xq").alias("bx0"), F.greatest("xp", "xq").alias("bx1"), F.least("yp", "yq").alias("by0"), F.greatest("yp", "yq").alias("by1")), "pieces")
    a_obj = pts.select(F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b_obj = pieces.select("cx", "cy", F.col("bx0").alias("x0"), F.col("by0").alias("y0"), F.col("bx1").alias("x1"), F.col("by1").alias("y1"))
    grid = _grid(a_obj.select("cx", "cy").union(b_obj.select("cx", "cy")), finest)
    at, bt, levels = _pyramid(a_obj, grid), _pyramid(b_obj, grid), grid.levels
    mine = Window.partitionBy("agx", "agy")

    def step(k: int, pairs: DataFrame | None) -> DataFrame:
        if pairs is None:
            pairs = _root_pairs(at[0], bt[0], False).withColumn("bound2", F.lit(float("inf")))
        else:
            pairs = _children(pairs, at[k], bt[k], None)
        pairs = pairs.withColumn("bound2", F.least("bound2", F.min(_most2()).over(mine)))
        pairs = pairs.filter(_least2() <= F.col("bound2") * F.lit(1 + 1e-9))
        return pairs.withColumn("state", F.when((F.sum(F.col("an") * F.col("bn")).over(mine) > LEAF_PAIRS) & F.lit(k < levels), "open").otherwise("leaf"))

    a = pts.select(F.col("id").alias("aid"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = pieces.select(F.col("id").alias("segment"), F.struct("id", "i").alias("piece"), "x0", "y0", "x1", "y1", F.col("cx").alias("bx"), F.col("cy").alias("by"))
    leaves = _descend(step, levels).select("level", "agx", "agy", "an", "bgx", "bgy", "bn")
    found = _meet(leaves, a, b, grid, "aid", "piece")
    found = found.select(F.col("aid").alias("id"), "segment", segment_distance(F.col("ax"), F.col("ay"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("distance"))
    best = found.groupBy("id").agg(F.min(F.struct("distance", "segment")).alias("m"))
    return best.select("id", "m.segment", "m.distance")


def _crosses(x: Column, y: Column) -> Column:
    """Whether an edge ``ex0, ey0, ex1, ey1`` crosses the ray from a point to greater x; an end counts for the edge that goes up from it."""
    up0, up1 = F.col("ey0") > y, F.col("ey1") > y
    rise = F.col("ey1") - F.col("ey0")
    return (up0 != up1) & (x < F.col("ex0") + (y - F.col("ey0")) / F.when(rise != 0, rise) * (F.col("ex1") - F.col("ex0")))


def containing_regions(points: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, region`` of every region that a point lies in. points: ``id, x, y``; edges: ``region, x0, y0, x1, y1``, the closed rings of a region's
    outline (rings within rings are holes). Regions may overlap; a point on an outline belongs to the region on the side of greater x and y.

    A node of points that no edge of a region touches lies in it, or doesn't, as a whole, by the edges that a ray from its corner crosses;
    other nodes are split and keep only the edges that can still matter. Few enough points and edges are compared exactly. Rows with a null
    or a value that isn't finite are left out; repeated rows count once; an empty table on either side gives an empty result."""
    pts = materialize(located(points.withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double")}), "id", "x", "y"), "points")
    ends = ("x0", "y0", "x1", "y1")
    fine = reduce(lambda p, q: p & q, (F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))) for c in ends))
    rows = edges.select("region", *(F.col(c).cast("double").alias(c) for c in ends)).filter(F.col("region").isNotNull() & fine).distinct().select("region", *(F.col(c).alias(f"e{c}") for c in ends))
    objects = pts.select(F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    grid = _grid(objects)
    pyramid, levels = _pyramid(objects, grid), grid.levels
    node = [c for c in _node("a") if c != "aw"]
    matters = (F.least("ey0", "ey1") <= F.col("ay1")) & (F.greatest("ey0", "ey1") >= F.col("ay0")) & (F.greatest("ex0", "ex1") >= F.col("ax0"))
    touches = matters & (F.least("ex0", "ex1") <= F.col("ax1"))
    edge = [f"e{c}" for c in ends]
    rows = rows.join(F.broadcast(_as(pyramid[0], "a").select(*node)), matters)  # at most 16 nodes
    inside, leaves = [], []
    for k in range(levels + 1):
        level = levels - k
        if k:
            rows = rows.select(F.col("agx").alias("apx"), F.col("agy").alias("apy"), "region", *edge).join(_as(pyramid[k], "a").select(*node, "apx", "apy"), ["apx", "apy"]).drop("apx", "apy").filter(matters)
        rows = materialize(rows, "region-edges")
        per = rows.groupBy(*node, "region").agg(F.max(touches).alias("touched"), F.sum(_crosses(F.col("ax0"), F.col("ay0")).cast("int")).alias("k"), F.count(F.lit(1)).alias("n"))
        per = materialize(per.withColumn("open", F.col("touched") & (F.col("an") * F.col("n") > LEAF_PAIRS) & F.lit(level > 0)), "region-nodes")
        inside.append(per.filter("not touched and k % 2 = 1").select(F.lit(level).alias("level"), F.col("agx").alias("gx"), F.col("agy").alias("gy"), "region"))
        of = lambda which, p=per: p.filter(which).select("agx", "agy", "region")
        leaves.append(rows.join(of("touched and not open"), ["agx", "agy", "region"]).select(F.lit(level).alias("level"), F.col("agx").alias("gx"), F.col("agy").alias("gy"), "an", "region", *edge))
        rows = rows.join(of("open"), ["agx", "agy", "region"])
        if level and per.filter("open").isEmpty():
            break
    sure, unsure = materialize(reduce(DataFrame.unionAll, inside), "inside"), materialize(reduce(DataFrame.unionAll, leaves), "leaves")
    whole = _placed(pts, "x", "y", sure, grid, _depths(sure)).select("id", "region")
    used = unsure.select("level", "gx", "gy", "an").distinct()
    dealt = _placed(pts, "x", "y", used, grid, _depths(used)).withColumn("c", F.pmod(F.xxhash64("id"), _chunks("an")).cast("int")).drop("an")
    work = unsure.withColumn("c", F.explode(F.sequence(F.lit(0), _chunks("an") - 1)))
    one = work.join(dealt, ["level", "gx", "gy", "c"]).groupBy("id", "x", "y", "region").agg(F.sum(_crosses(F.col("x"), F.col("y")).cast("int")).alias("k")).filter("k % 2 = 1").select("id", "region")
    return whole.unionAll(one).distinct()


def segment_distance(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance of a point from a segment; a segment without length is a point."""
    dx, dy = x1 - x0, y1 - y0
    l2 = dx * dx + dy * dy
    t = F.when(l2 > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - x0) * dx + (y - y0) * dy) / F.when(l2 > 0, l2)))).otherwise(F.lit(0.0))
    px, py = x0 + t * dx, y0 + t * dy
    return F.sqrt((x - px) * (x - px) + (y - py) * (y - py))
