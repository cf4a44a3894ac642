"""Shortest paths and tours as grouped kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulgrid.operators.groups import per_group
from haulgrid.operators.kernels import significance as S
from haulgrid.operators.kernels import tours as K
from haulgrid.operators.kernels.clusters import tour_bhh
from haulgrid.sources.stage import deal

#: Most bytes of a road graph and its stops that are sent to tasks (24 an edge, 8 a node, 40 a stop).
MAX_BYTES = 500_000_000


def collect_graph(nodes: DataFrame, edges: DataFrame) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Node ids in order, and edges as arrays (from, to, metres, seconds) of their positions, for
    shipping to tasks; refuses a graph of more than MAX_BYTES before it is collected."""
    size = 24 * edges.count() + 8 * nodes.count()
    if size > MAX_BYTES:
        raise ValueError(f"a graph of {size} bytes is too large for one task; cut the network to the area of a depot")
    ids = nodes.select(F.col("node").cast("bigint")).orderBy("node").toArrow()["node"].to_numpy()
    arcs = edges.select("u", "v", F.col("length_m").cast("double"), F.col("tt_s").cast("double")).orderBy("u", "v", "length_m").toArrow()
    u, v = (np.searchsorted(ids, arcs[c].to_numpy()).astype(np.int32) for c in ("u", "v"))
    for at, c in ((u, "u"), (v, "v")):
        if len(at) and not np.array_equal(ids[np.minimum(at, len(ids) - 1)], arcs[c].to_numpy()):
            raise ValueError("an edge ends at a node that is not in the graph")
    return ids, (u, v, arcs["length_m"].to_numpy(), arcs["tt_s"].to_numpy())


def largest_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of the largest strongly connected component (of equals, the one with the smallest node)."""
    ids, (u, v, _, _) = collect_graph(nodes, edges)
    label = K.strong_components(len(ids), u, v)
    if not len(ids):
        return nodes.select(F.col("node").cast("bigint"))
    size = np.bincount(label)
    big = label[np.flatnonzero(size[label] == size.max())[0]]
    return nodes.sparkSession.createDataFrame(pa.table({"node": ids[label == big]}))


def od_matrix(stops: DataFrame, nodes: DataFrame, edges: DataFrame, weight: str = "length") -> DataFrame:
    """Shortest ways between the stops (depot, o, node) of each depot.

    ``length`` minimises metres, then seconds among the shortest; ``time`` the other way round.
    The graph and the stops go to all tasks as arrays, after a check of their size; sources are
    dealt over tasks, and each runs Dijkstra's search. Pairs without a way have null cost.
    """
    ids, (u, v, metres, seconds) = collect_graph(nodes, edges)
    if (n := 40 * stops.count()) > MAX_BYTES:
        raise ValueError(f"{n} bytes of stops are too many for one task")
    targets = {}
    every = stops.select("depot", "o", "node").orderBy("depot", "o").toArrow()
    at = np.searchsorted(ids, every["node"].to_numpy())
    for depot, o, node in zip(every["depot"].to_pylist(), every["o"].to_pylist(), at.tolist(), strict=True):
        targets.setdefault(depot, ([], []))
        targets[depot][0].append(o)
        targets[depot][1].append(node)
    first, second = (metres, seconds) if weight == "length" else (seconds, metres)
    graph = K.Graph(len(ids), u, v, first, second)
    data = stops.sparkSession.sparkContext.broadcast((ids, graph, targets))

    def run(frames):
        ids, graph, targets = data.value
        for f in frames:
            out = []
            for depot, o, node in zip(f["depot"], f["o"], np.searchsorted(ids, f["node"]), strict=True):
                names, ends = targets[depot]
                ways = [w[ends] for w in graph.shortest(int(node))]
                km, minutes = (x / c for x, c in zip(ways if weight == "length" else ways[::-1], (1000, 60), strict=True))
                far = ~np.isfinite(km)
                km[far] = minutes[far] = np.nan
                out.append(pd.DataFrame({"depot": depot, "o": o, "d": names, "km": km, "min": minutes}))
            if out:
                yield pd.concat(out, ignore_index=True)

    rows = deal(stops.select("depot", "o", "node"), "depot", "o").mapInPandas(run, "depot string, o string, d string, km double, min double")
    return rows.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("km", "min")})


def routes(assign: DataFrame, od: DataFrame, seeds: tuple = (0,), starts: int = 6, home: str = "@") -> DataFrame:
    """Tour of every (depot, date, design, k) over its units, from and to the depot's stop.

    ``od`` may hold several variants (column variant); each is costed by itself. A group is a
    variant, depot and month: it gets the depot's matrix once and all tours of the month, one
    row each with its units.
    """
    keys = ["variant", "depot", "date", "design", "k"]
    group = ["variant", "depot", "m"]
    tours = assign.groupBy("depot", "date", "design", "k").agg(F.sort_array(F.collect_set("bu")).alias("units"), F.sum("n").alias("parcels"))
    tours = tours.withColumn("m", F.month("date")).join(od.select("variant", "depot").distinct(), "depot")
    legs = od.select("variant", "depot", "o", "d", "km", "min").join(tours.select("depot", "m").distinct(), "depot")
    legs = legs.select(*[F.col(c).alias(f"leg_{c}") for c in legs.columns])  # else both sides share columns

    def cost(key: tuple, tours: pd.DataFrame, legs: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.append(legs["leg_o"].to_numpy(str), home))
        km, minutes = np.full((2, len(names), len(names)), 1e9)
        np.fill_diagonal(km, 0.0)
        np.fill_diagonal(minutes, 0.0)
        if len(legs):
            i, j = (np.searchsorted(names, legs[f"leg_{c}"].to_numpy(str)) for c in "od")
            km[i, j], minutes[i, j] = legs["leg_km"].fillna(1e9), legs["leg_min"].fillna(1e9)
        out = []
        for t in tours.itertuples():
            stops = [home, *(u for u in t.units if u != home)]
            at = np.searchsorted(names, stops)
            own = np.ix_(at, at)
            for seed in seeds:
                a, b, _ = K.route_multi(km[own], minutes[own], starts, seed)
                out.append((*key[:2], t.date, t.design, t.k, seed, len(stops) - 1, a, b, t.parcels))
        return pd.DataFrame(out, columns=[*keys, "seed", "stops", "route_km", "route_min", "parcels"])

    kinds, side = dict(tours.dtypes), [f"leg_{c}" for c in group]
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + f", seed int, stops int, route_km double, route_min double, parcels {kinds['parcels']}"
    return deal(tours, *group).groupBy(*group).cogroup(deal(legs, *side).groupBy(*side)).applyInPandas(cost, schema)


def intra_distance(d: DataFrame, circ: DataFrame, keys: tuple = ("depot", "date", "bu")) -> DataFrame:
    """Kilometres within each unit and day: the tour estimate times the depot's circuity."""

    est = per_group(d, keys, ("x", "y"), lambda x, y: (tour_bhh(np.c_[x, y]) / 1000,), "est_km double")
    return est.join(circ, "depot").select(*keys, (F.col("est_km") * F.col("circ")).alias("intra_km"))


def with_intra(tours: DataFrame, assign: DataFrame, intra: DataFrame, intra_couriers: DataFrame) -> DataFrame:
    """Tours with the distance within their units; couriers count only their own parcels."""
    key = ["depot", "date", "design", "k"]
    plain = assign.filter("design <> 'OPR'").join(intra, ["depot", "date", "bu"], "left")
    own = assign.filter("design = 'OPR'").join(intra_couriers.withColumnRenamed("cid", "k"), ["depot", "date", "bu", "k"], "left")
    sums = plain.select(*key, "intra_km").unionByName(own.select(*key, "intra_km")).groupBy(*key).agg(F.sum(F.coalesce("intra_km", F.lit(0.0))).alias("intra_km"))
    return tours.join(sums, key, "left").withColumn("intra_km", F.coalesce("intra_km", F.lit(0.0)))


def tour_lengths(s: DataFrame, keys: tuple = ("depot", "date", "cid")) -> DataFrame:
    """Straight-line tour by 2-opt and the estimate for each group of points."""

    def one(x: np.ndarray, y: np.ndarray) -> tuple:
        p = np.c_[x, y]
        return len(p), K.nn2opt(p) / 1000, tour_bhh(p) / 1000

    return per_group(s, keys, ("x", "y"), one, "n int, tsp_km double, bhh_km double")


def wilcoxon_p(x: DataFrame) -> DataFrame:
    """Signed-rank p of each scope of (scope, x): one number per day, so a scope fits a task."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"scope": g["scope"].iloc[0], "n": len(g), "p": S.signed_rank_p(g["x"].to_numpy())}])

    return x.select("scope", "x").groupBy("scope").applyInPandas(one, "scope string, n int, p double")


def cluster_bootstrap(weeks: DataFrame, draws: int = 5000, seed: int = 2026) -> DataFrame:
    """Week-block interval of the mean difference of each (comp, scope) from weekly sums."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("week")
        lo, hi = S.block_bootstrap(g["sum_d"].to_numpy(), g["n_d"].to_numpy(), draws, seed)
        means = (g["sum_d"] / g["n_d"]).to_numpy()
        return pd.DataFrame([{
            "comp": g["comp"].iloc[0], "scope": g["scope"].iloc[0], "n_days": int(g["n_d"].sum()), "n_weeks": len(g),
            "mean_diff": g["sum_d"].sum() / g["n_d"].sum(), "boot_lo": lo, "boot_hi": hi, "p_week_wilcoxon": S.signed_rank_p(means)}])

    return deal(weeks, "comp", "scope").groupBy("comp", "scope").applyInPandas(
        one, "comp string, scope string, n_days bigint, n_weeks int, mean_diff double, boot_lo double, boot_hi double, p_week_wilcoxon double")


def cluster_table(d: DataFrame, draws: int = 5000, seed: int = 2026) -> DataFrame:
    """Cluster-robust row of each (comp, scope) of daily differences (comp, depot, date, d): the
    week-block interval, signed-rank p of weekly and of monthly means, and how many months have
    the sign of the overall mean."""
    from haulgrid.operators import statistics

    table = cluster_bootstrap(statistics.week_sums(d), draws, seed)
    months = statistics.month_means(d)
    p = wilcoxon_p(months.select(F.concat_ws("|", "comp", "scope").alias("scope"), F.col("mean_d").alias("x")))
    p = p.select(F.col("scope").alias("id"), F.col("p").alias("p_month_wilcoxon"))
    signs = months.join(table.select("comp", "scope", "mean_diff"), ["comp", "scope"]).groupBy("comp", "scope").agg(F.concat(
        F.count_if(F.signum("mean_d") == F.signum("mean_diff")).cast("string"), F.lit("/"), F.count("mean_d").cast("string")).alias("months_same_sign"))
    table = table.join(signs, ["comp", "scope"]).withColumn("id", F.concat_ws("|", "comp", "scope"))
    return table.join(p, "id").drop("id")
