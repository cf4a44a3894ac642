"""Road graph as tables: nodes(node, x, y), edges(u, v, length_m, tt_s)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulgrid.sources.stage import cut


def way_edges(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Directed edges of ways (way, refs, speed, fwd, bwd): consecutive nodes, both directions
    where allowed, length from coordinates, time from speed."""
    steps = ways.select("way", "speed", "fwd", "bwd", F.posexplode("refs").alias("pos", "u"))
    steps = steps.withColumn("v", F.lead("u").over(Window.partitionBy("way").orderBy("pos"))).filter(F.col("v").isNotNull())
    a = nodes.select(F.col("node").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    b = nodes.select(F.col("node").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    steps = steps.join(a, "u").join(b, "v").withColumn("length_m", F.hypot(F.col("ux") - F.col("vx"), F.col("uy") - F.col("vy")))
    steps = steps.withColumn("tt_s", F.col("length_m") / (F.col("speed") / F.lit(3.6)))
    back = steps.filter("bwd").select(F.col("v").alias("u"), F.col("u").alias("v"), "length_m", "tt_s")
    return steps.filter("fwd").select("u", "v", "length_m", "tt_s").unionAll(back)


def merge_parallel(edges: DataFrame, how: str = "min") -> DataFrame:
    """One edge per (u, v): the shortest of parallel ones, or (``sum``) their sum. Edges of
    length zero have no speed and go."""
    best = F.min if how == "min" else F.sum
    return edges.filter("length_m > 0").groupBy("u", "v").agg(best("length_m").alias("length_m"), best("tt_s").alias("tt_s"))


def snap_nodes(points: DataFrame, nodes: DataFrame, cell: float, rings: int = 1, id_col: str = "id") -> DataFrame:
    """Nearest node of each point, ties to the smaller node.

    Points probe the grid cells within ``rings`` steps; whatever they find closer than the
    searched margin is the nearest. Points that find none search twice as far, until all are
    placed; when the search spans all nodes a last look takes every node of the cells' extent.
    """
    def at(df: DataFrame, size: float) -> DataFrame:
        return df.withColumns({"gx": F.floor(F.col("x") / size).cast("bigint"), "gy": F.floor(F.col("y") / size).cast("bigint")})

    bounds = nodes.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if bounds[0] is None:
        return points.select(id_col, F.lit(None).cast("bigint").alias("node"), F.lit(None).cast("double").alias("snap_m"))
    ends = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if ends[0] is None:
        return points.select(id_col, F.lit(None).cast("bigint").alias("node"), F.lit(None).cast("double").alias("snap_m"))
    span = math.hypot(max(bounds[1], ends[1]) - min(bounds[0], ends[0]), max(bounds[3], ends[3]) - min(bounds[2], ends[2]))
    todo, placed, size = points.select(id_col, "x", "y"), None, float(cell)
    while True:
        reach = F.sequence(F.lit(-rings), F.lit(rings))
        probe = at(todo, size).withColumn("i", F.explode(reach)).withColumn("j", F.explode(reach))
        probe = probe.select(id_col, "x", "y", (F.col("gx") + F.col("i")).alias("gx"), (F.col("gy") + F.col("j")).alias("gy"))
        grid = at(nodes.select("node", F.col("x"), F.col("y")), size).withColumnsRenamed({"x": "nx", "y": "ny"})
        d = F.hypot(F.col("x") - F.col("nx"), F.col("y") - F.col("ny"))
        found = probe.join(grid, ["gx", "gy"]).groupBy(id_col).agg(F.min(F.struct(d.alias("d"), F.col("node").alias("node"))).alias("best"))
        last = rings * size >= span
        good = cut(found.filter(F.lit(last) | (F.col("best.d") <= rings * size)).select(id_col, F.col("best.node").alias("node"), F.col("best.d").alias("snap_m")))
        placed = good if placed is None else placed.unionAll(good)
        if last:
            return placed
        todo = cut(todo.join(good, id_col, "left_anti"))
        if todo.isEmpty():
            return placed
        size *= 2


def od_euclid(points: DataFrame) -> DataFrame:
    """Straight-line kilometres between all stops of a depot (depot, bu, x, y): an equi join on
    the depot; stops are units, a few hundred per depot."""
    a = points.select("depot", F.col("bu").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    b = points.select("depot", F.col("bu").alias("d"), F.col("x").alias("dx"), F.col("y").alias("dy"))
    return a.join(b, "depot").select("depot", "o", "d", (F.hypot(F.col("ox") - F.col("dx"), F.col("oy") - F.col("dy")) / 1000).alias("euclid_km"))


def circuity(od: DataFrame, least_km: float = 0.3) -> DataFrame:
    """Median of road over straight-line distance, off the diagonal and beyond a least distance."""
    ok = (F.col("o") != F.col("d")) & (F.col("euclid_km") > least_km)
    return od.filter(ok).groupBy("depot").agg(F.median(F.col("km") / F.col("euclid_km")).alias("circ"))


def snap_summary(snapped: DataFrame) -> DataFrame:
    """Median and 95th percentile of the distance from stops (depot, snap_m) to their node."""
    return snapped.groupBy("depot").agg(
        F.median("snap_m").alias("snap_median"), F.percentile("snap_m", F.lit(0.95)).alias("snap_p95"))


def od_diagnostics(od: DataFrame) -> DataFrame:
    """Unreachable pairs, circuity and mean ratio of the shortest way's minutes to the fastest's, by depot."""
    return od.groupBy("depot").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("km").isNull()).alias("unreachable"),
        F.median(F.when((F.col("o") != F.col("d")) & (F.col("euclid_km") > 0.3), F.col("km") / F.col("euclid_km"))).alias("circ"),
        F.avg(F.try_divide(F.col("min"), F.col("min_fast"))).alias("time_ratio"))


def sequence_cost(stops: DataFrame, od: DataFrame) -> DataFrame:
    """Cost of driving stops (depot, date, cid, t, bu) in their order, runs of one unit once,
    from and back to the stop '@' of the depot."""
    w = Window.partitionBy("depot", "date", "cid").orderBy("t")
    moved = stops.withColumn("o", F.lag("bu").over(w)).filter(F.col("o").isNull() | (F.col("o") != F.col("bu")))
    w2 = Window.partitionBy("depot", "date", "cid").orderBy("t")
    legs = moved.withColumns({"o": F.coalesce(F.lag("bu").over(w2), F.lit("@")), "next": F.lead("bu").over(w2)})
    home = legs.filter("next IS NULL").select("depot", "date", "cid", F.col("bu").alias("o"), F.lit("@").alias("d"))
    legs = legs.select("depot", "date", "cid", "o", F.col("bu").alias("d")).unionAll(home)
    return legs.join(od.select("depot", "o", "d", "km", "min"), ["depot", "o", "d"]).groupBy("depot", "date", "cid").agg(
        F.sum("km").alias("actual_km"), F.sum("min").alias("actual_min"), F.count(F.lit(1)).alias("legs"))
