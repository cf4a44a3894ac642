"""Queries on policies, tours, shortest paths and resampling: what SQL cannot express."""

from __future__ import annotations

import uuid
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulgrid.functions import geo
from haulgrid.functions.roads import speed_variants
from haulgrid.operators import designs, districts, policies, roads, routing
from haulgrid.operators.groups import per_group
from haulgrid.operators.kernels import assignment as A
from haulgrid.operators.kernels import clusters as C
from haulgrid.operators.kernels import tours as K
from haulgrid.plans.queries_designs import _WITH_EDGES, PAIRS, grid_edges, grid_nodes
from haulgrid.plans.registry import query
from haulgrid.sources import bu_loads, readers, sinks
from haulgrid.sources import fixtures as fx
from haulgrid.sources.stage import cut, deal, shared_folder

#: Cells of 1,000 m, for the stand-in data are sparse, and parcels a district: fixed, so a larger
#: scale has more districts (two at sf0.01, about ten at sf0.1).
SIDE, TARGET = 1000.0, 40.0


def _d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.deliv(spark, sf_dir, SIDE)


def _days(spark, sf_dir):
    """Parcels of each unit and weekday, counted in one pass over the scans."""
    return cut(fx.parcels(spark, sf_dir, SIDE))


def _plans(spark, sf_dir, engine="mcf", seed=42, annual=False, days=None):
    """Parcels of units by day, and the plans learnt from them."""
    d = _days(spark, sf_dir) if days is None else days
    return d, policies.fix_plans(policies.units_for_plan(d, SIDE, TARGET, annual), engine, seed=seed)


def _kept_plans(spark, sf_dir):
    """The same for several readers of the plans."""
    d, plans = _plans(spark, sf_dir)
    return d, cut(plans)


@query()
def policy_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plans(spark, sf_dir)[1].drop("sec", "centers")


@query()
def fix_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units unseen in training, at their nearest centre."""
    def unseen(key: tuple, plan: pd.DataFrame, after: pd.DataFrame) -> pd.DataFrame:
        return plan.loc[~plan["trained"].astype(bool), ["depot", "train", "bu", "k"]]

    return policies.planned(fx.parcels(spark, sf_dir, SIDE), SIDE, TARGET, unseen, "depot string, train int, bu string, k int")


@query()
def cap_generic_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plans(spark, sf_dir, "greedy")[1].drop("sec", "centers")


@query()
def cap_generic_wvor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plans(spark, sf_dir, "wvor")[1].drop("sec", "centers")


def _kernel_on_demand(spark, sf_dir, name, kernel) -> DataFrame:
    """Labels that a kernel gives the units of each depot and month around seeded centres."""
    units = policies.units_for_plan(_days(spark, sf_dir), SIDE, TARGET).filter("w > 0")

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("bu")
        points, w = g[["x", "y"]].to_numpy(), g["w"].to_numpy()
        centers = C.kpp(points, w, int(g["n_districts"].iloc[0]), np.random.default_rng(1))
        return pd.DataFrame({"depot": key[0], "train": key[1], "bu": g["bu"], "w": w, "k": kernel(points, w, centers)})

    return deal(units, "depot", "train").groupBy("depot", "train").applyInPandas(run, "depot string, train int, bu string, w double, k int")


@query()
def kpp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest seed of each unit."""
    return _kernel_on_demand(spark, sf_dir, "kpp", lambda p, w, c: A.nearest(p, c))


@query()
def assign_lp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kernel_on_demand(spark, sf_dir, "lp", lambda p, w, c: A.assign_lp(p, w, c)[0])


@query()
def assign_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kernel_on_demand(spark, sf_dir, "greedy", A.assign_greedy)


@query()
def assign_wvor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kernel_on_demand(spark, sf_dir, "wvor", A.assign_wvor)


@query()
def repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest centres, then border units moved towards balance."""
    def kernel(p, w, c):
        d = A.distances(p, p)
        near = [np.flatnonzero((row > 0) & (row < SIDE * 1.8)).tolist() for row in d]
        return A.repair(p, w, A.nearest(p, c), len(c), near, centers=c)

    return _kernel_on_demand(spark, sf_dir, "repair", kernel)


@query()
def hungarian_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Districts of a month matched to those of the month before by their centres."""
    def places(key: tuple, plan: pd.DataFrame, after: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"depot": key[0], "train": key[1], "now": [c for c in plan["centers"] if c is not None]})

    now = policies.planned(fx.parcels(spark, sf_dir, SIDE), SIDE, TARGET, places, "depot string, train int, now array<array<double>>")
    month = Window.partitionBy("depot").orderBy("train")
    both = now.withColumns({"old": F.lag("now").over(month), "gap": F.col("train") - F.lag("train").over(month)}).filter("gap = 1")

    def match(frames):
        for f in frames:
            for r in f.itertuples():
                to = A.match_places(np.array(r.now.tolist()), np.array(r.old.tolist()))
                yield pd.DataFrame({"depot": r.depot, "train": r.train, "k": np.arange(len(to)), "k_before": to})

    rows = deal(both.select("depot", "train", "now", "old"), "depot", "train")
    return rows.mapInPandas(match, "depot string, train int, k int, k_before int")


@query()
def policy_pen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimal-change rebalancing and its solver log."""
    d, plans = _kept_plans(spark, sf_dir)
    return policies.rebalanced(plans, policies.day_loads(d)).drop("sec")


@query()
def solver_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rebalancing's calls, a row each."""
    d, plans = _kept_plans(spark, sf_dir)
    return policies.solver_log(policies.rebalanced(plans, policies.day_loads(d))).drop("sec")


@query()
def assignment_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """District (or courier) of every unit and test day under every policy."""
    return policies.rolling(fx.parcels(spark, sf_dir, SIDE, "cid"), SIDE, TARGET)


@query(rounded="inband moved_share")
def plan_age_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed plan and rebalancing by test month, with plans of the month before and of January."""
    d, out = _days(spark, sf_dir), None
    for annual in (False, True):
        plans = cut(_plans(spark, sf_dir, annual=annual, days=d)[1])
        loads = policies.day_loads(d)
        a = policies.fixed(plans, loads).unionByName(
            policies.rebalanced(plans, loads, (1000.0,)).select("depot", "train", "date", "design", "bu", "k", "n"))
        a = a.join(plans.groupBy("depot", "train").agg(F.max("n_districts").alias("n_districts")), ["depot", "train"])
        part = designs.plan_age(policies.plan_metrics(cut(a)).withColumn("annual", F.lit(annual)), ("annual", "design"))
        out = part if out is None else out.unionByName(part)
    return out


@query()
def policy_dws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.planned_daily(fx.parcels(spark, sf_dir, SIDE), SIDE, TARGET, designs=("DWS",)).drop("sec")


@query()
def policy_dcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.planned_daily(fx.parcels(spark, sf_dir, SIDE), SIDE, TARGET, designs=("DCS",)).drop("sec")


@query()
def policy_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of each solver call, with its size; of the rebalancing also status, fallback and
    the certificate that a unit above the upper bound makes the day infeasible."""
    d = _days(spark, sf_dir)
    plans = cut(policies.planned(d, SIDE, TARGET))
    loads = policies.day_loads(d)
    fix = plans.groupBy("depot", "train").agg(F.max("sec").alias("sec"), F.count(F.lit(1)).alias("n"), F.max("n_districts").alias("n_districts")).select(
        "depot", "train", F.lit(None).cast("date").alias("date"), F.lit("FIX").alias("step"), "sec", "n", "n_districts")
    day = policies.daily(plans, loads).groupBy("depot", "train", "date", F.col("design").alias("step")).agg(
        F.max("sec").alias("sec"), F.count(F.lit(1)).alias("n"))
    sizes = plans.groupBy("depot", "train").agg(F.max("n_districts").alias("n_districts"))
    pen = policies.rebalanced(plans, loads).groupBy("depot", "train", "date", F.col("design").alias("step")).agg(
        F.max("sec").alias("sec"), F.count(F.lit(1)).alias("n"), F.max("status").alias("status"), F.max("fallback").alias("fallback"),
        F.max("max_bu_over_hi").alias("max_bu_over_hi"), (F.max("max_bu_over_hi") > 1).alias("cert")).join(sizes, ["depot", "train"])
    return fix.unionByName(day.join(sizes, ["depot", "train"])).unionByName(pen, allowMissingColumns=True).withColumn("nvar", F.col("n") * F.col("n_districts"))


def _measured(d: DataFrame, side: float, target: float, own: DataFrame | None = None, **how) -> DataFrame:
    """``own``: the parcels counted by courier, where they are at hand."""
    a = cut(policies.rolling(d if own is None else own, side, target, **how))  # read by every measure
    return policies.rolling_metrics(a).join(policies.spread_and_tours(d, a), ["depot", "date", "design"], "left")


@query()
def rolling_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All policies over the evaluation window, measured, with plans learnt anew each month and
    with those of the first month only."""
    d, days = _d(spark, sf_dir), _days(spark, sf_dir)
    month, year = (_measured(d, SIDE, TARGET, annual=annual, days=days).withColumn("annual", F.lit(annual)) for annual in (False, True))
    return month.unionByName(year)


@query()
def sensitivity_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All policies (penalty 1000) on every test day, and the balance of the plans they start
    from, for other cells, targets, seeds and engines, each varied by itself."""
    return _sensitivity(spark, sf_dir)


def _sensitivity(spark, sf_dir, sides=(1000.0, 1500.0), factors=(1.0, 1.5), seeds=(42, 1, 2, 3), engines=("mcf", "greedy", "wvor"), full=False) -> DataFrame:
    """``full``: all combinations instead of one change at a time from the first of each."""
    every = list(product(factors, seeds, engines))
    base, out = every[0], None
    for side in sides:
        settings = every if full else [x for x in every if sum(a != b for a, b in zip(x, base, strict=True)) <= (side == sides[0])]
        own = cut(fx.parcels(spark, sf_dir, side, "cid"))
        every_day = cut(policies.scenarios(policies.counted(own), settings))
        plans = cut(policies.planned(every_day, side, TARGET, tasks=8))
        load = plans.filter("trained").groupBy("depot", "train", "k").agg(F.sum("w").alias("load"))
        days = policies.day_loads(every_day).select("depot", "train", "date").distinct()
        balance = days.join(districts.plan_balance(load, ("depot", "train")), ["depot", "train"])
        part = _measured(fx.deliv(spark, sf_dir, side), side, TARGET, own, lambdas=(1000.0,), plans=plans, days=every_day, settings=settings)
        part = policies.couriers_everywhere(part, settings).join(balance, ["depot", "date"])
        part = part.select(F.lit(side).alias("side"), *policies.scenario_columns(), *[c for c in part.columns if c != "depot"])
        out = part if out is None else out.unionByName(part)
    return out


def _identity(spark, sf_dir):
    return policies.identity_labels(_d(spark, sf_dir))


@query(rounded="otr")
def pitfall_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return districts.outside_rate(_identity(spark, sf_dir), ("depot", "m", "random"))


@query(rounded="otr")
def pitfall_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return districts.outside_rate(_identity(spark, sf_dir), ("depot", "m", "aligned"))


@query()
def identity_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.identity_hulls(_identity(spark, sf_dir))


@query()
def bhh_tour(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _d(spark, sf_dir).filter("dow < 5")
    return policies.tour_estimates(d, ("depot", "date", "cid"))


@query()
def nn2opt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.tour_lengths(fx.seq(spark, sf_dir))


@query(rounded="bhh_tsp act_tsp")
def bhh_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median ratios of the estimate and of the driven path to the 2-opt tour."""
    from haulgrid.operators.stability import path_length

    s = fx.seq(spark, sf_dir)
    both = routing.tour_lengths(s).join(path_length(s).drop("n"), ["depot", "date", "cid"]).filter("n >= 3")
    return both.groupBy("depot").agg(
        F.median(F.try_divide("bhh_km", "tsp_km")).alias("bhh_tsp"), F.median(F.try_divide("actual_km", "tsp_km")).alias("act_tsp"))


@query()
def scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.largest_component(grid_nodes(spark), grid_edges(spark))


def _snapped(spark, sf_dir) -> DataFrame:
    """Units (depot, o) at their nearest node of the street grid's largest component, and how far that is."""
    units = _d(spark, sf_dir).filter("dow < 5").groupBy("depot", "bu").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    points = units.select(F.concat_ws(" ", "depot", "bu").alias("id"), (F.col("x") / 6).alias("x"), (F.col("y") / 6).alias("y"))
    nodes = grid_nodes(spark).join(routing.largest_component(grid_nodes(spark), grid_edges(spark)), "node", "left_semi")
    placed = roads.snap_nodes(points, nodes, 150.0)
    part = F.split("id", " ")
    return placed.select(part[0].alias("depot"), part[1].alias("o"), "node", "snap_m")


def _stops(spark, sf_dir) -> DataFrame:
    """Stops (depot, o, node): units at their nearest node, and a depot '@'."""
    nodes = grid_nodes(spark).join(routing.largest_component(grid_nodes(spark), grid_edges(spark)), "node", "left_semi")
    home = nodes.agg(F.min("node").alias("node")).crossJoin(spark.createDataFrame([(d,) for d in fx.DEPOTS], "depot string")).select("depot", F.lit("@").alias("o"), "node")
    return _snapped(spark, sf_dir).drop("snap_m").unionByName(home)


def _od(spark, sf_dir, weight="length", times="tt_mapped") -> DataFrame:
    edges = roads.merge_parallel(grid_edges(spark))
    edges = edges.withColumn("tt_s", speed_variants(F.col("length_m"), F.col("tt_s"))[times])
    return routing.od_matrix(_stops(spark, sf_dir), grid_nodes(spark), edges, weight)


@query(rounded="km min")
def od_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kilometres of the shortest and minutes of the fastest ways."""
    short, fast = _od(spark, sf_dir), _od(spark, sf_dir, "time")
    return short.select("depot", "o", "d", "km").join(fast.select("depot", "o", "d", "min"), ["depot", "o", "d"])


@query(rounded="km min min_uniform25 min_congested")
def od_lex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest ways, and among them the quickest, for each of the travel models."""
    out = _od(spark, sf_dir)
    for model in ("uniform25", "congested"):
        own = _od(spark, sf_dir, times=f"tt_{model}").select("depot", "o", "d", F.col("min").alias(f"min_{model}"))
        out = out.join(own, ["depot", "o", "d"])
    return out


@query(rounded="circ time_ratio snap_median snap_p95")
def od_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = _stops(spark, sf_dir).join(grid_nodes(spark), "node").select("depot", F.col("o").alias("bu"), "x", "y")
    fast = _od(spark, sf_dir, "time").select("depot", "o", "d", F.col("min").alias("min_fast"))
    od = _od(spark, sf_dir).join(fast, ["depot", "o", "d"]).join(roads.od_euclid(stops), ["depot", "o", "d"])
    return roads.od_diagnostics(od).join(roads.snap_summary(_snapped(spark, sf_dir)), "depot")


@query(_WITH_EDGES + "SELECT u, v, length_m, tt_s FROM (SELECT u, v, length_m, tt_s FROM edges)", rounded="length_m tt_s")
def network_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a road network that was written as tables and read again."""
    folder = f"{shared_folder(spark)}/network-{uuid.uuid4().hex}"
    sinks.write_network(grid_nodes(spark), grid_edges(spark), None, folder)
    return readers.read_network(spark, folder)["edges"]


def _assign(spark, sf_dir) -> DataFrame:
    """Rule-based districts and couriers, for the routing queries."""
    d = _d(spark, sf_dir).filter(F.col("dow") < 5)
    units = d.groupBy("depot", "date", "bu", "q", "r").agg(F.count(F.lit(1)).alias("n"))
    own = d.groupBy("depot", "date", "bu", F.col("cid").alias("k")).agg(F.count(F.lit(1)).alias("n")).withColumn("design", F.lit("OPR"))
    plan = units.select("depot", "date", "bu", F.pmod(F.col("q") + F.col("r"), F.lit(4)).cast("bigint").alias("k"), "n").withColumn("design", F.lit("FIX"))
    return plan.unionByName(own)


def _variants(spark, sf_dir) -> DataFrame:
    od = _od(spark, sf_dir)
    slow = od.withColumn("min", F.col("km") / 25 * 60)
    congested = _od(spark, sf_dir, times="tt_congested")
    return od.withColumn("variant", F.lit("base")).unionByName(slow.withColumn("variant", F.lit("uniform25"))).unionByName(
        congested.withColumn("variant", F.lit("congested")))


@query(rounded="route_km route_min")
def route_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.routes(_assign(spark, sf_dir), _variants(spark, sf_dir).filter("variant = 'base'"))


@query(rounded="route_km route_min")
def route_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three speed variants and two seeds."""
    return routing.routes(_assign(spark, sf_dir), _variants(spark, sf_dir), seeds=(0, 1))


def _intra(spark, sf_dir):
    d = _d(spark, sf_dir).filter("dow < 5")
    circ = spark.createDataFrame([(x, 1.3) for x in fx.DEPOTS], "depot string, circ double")
    return routing.intra_distance(d, circ), routing.intra_distance(d, circ, ("depot", "date", "bu", "cid"))


@query(rounded="intra_km")
def intra_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _intra(spark, sf_dir)[0]


@query(rounded="route_km route_min intra_km")
def route_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tours of all districts with the distance within units."""
    a = _assign(spark, sf_dir)
    tours = routing.routes(a, _variants(spark, sf_dir).filter("variant = 'base'"))
    return routing.with_intra(tours, a, *_intra(spark, sf_dir))


def _tour_kernel(spark, sf_dir, kernel) -> DataFrame:
    """Length of a tour kernel over the points of each courier-day."""
    def run(t, event_id, x, y) -> tuple:
        p = np.c_[x, y]
        return len(p), kernel(A.distances(p, p)) / 1000

    return per_group(fx.seq(spark, sf_dir), ("depot", "date", "cid"), ("t", "event_id", "x", "y"), run, "n int, km double")


@query(rounded="km")
def route_two_opt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tour_kernel(spark, sf_dir, lambda d: K.length(d, K.two_opt(K.greedy_tour(d, 0), d)))


@query(rounded="km")
def route_or_opt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tour_kernel(spark, sf_dir, lambda d: K.length(d, K.or_opt(K.two_opt(K.greedy_tour(d, 0), d), d)))


@query(rounded="km")
def route_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tour_kernel(spark, sf_dir, lambda d: K.route_single(d, d)[0])


@query(rounded="mean_diff boot_lo boot_hi p_week_wilcoxon p_month_wilcoxon")
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each measure's cluster-robust table, of 5,000 draws."""
    metrics, out = fx.metrics(spark, sf_dir), None
    for name in ("inband", "cv", "total_km", "cont"):
        part = routing.cluster_table(designs.pair_differences(metrics, name, PAIRS)).withColumn("metric", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query(rounded="p")
def wilcoxon_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = designs.pair_differences(fx.metrics(spark, sf_dir), "road_km", PAIRS)
    return routing.wilcoxon_p(d.select(F.concat_ws(" | ", "comp", "depot").alias("scope"), F.col("d").alias("x")))


@query("""SELECT 'Depot0' || (1 + l_suppkey % 4) AS depot, DATE '2025-01-01' + CAST((dayofyear(l_shipdate) - 1) % 365 AS INTEGER) AS date,
        CAST(month(DATE '2025-01-01' + CAST((dayofyear(l_shipdate) - 1) % 365 AS INTEGER)) AS INTEGER) AS m, CAST(l_partkey % 7 - 3 AS INTEGER) AS q, CAST(l_partkey % 5 - 2 AS INTEGER) AS r,
        (l_partkey % 7 - 3) || '_' || (l_partkey % 5 - 2) AS bu, CAST(count(*) AS INTEGER) AS n FROM lineitem GROUP BY ALL""")
def bu_loads_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load text written from the line items, and parsed again."""
    li = fx.lines(spark, sf_dir)
    cells = [(i, j) for i in range(7) for j in range(5)]
    head = ";".join(f"{i - 3},{j - 2}" for i, j in cells)
    index = (F.col("l_partkey") % 7) * 5 + F.col("l_partkey") % 5
    pairs = li.groupBy("depot", F.dayofyear("date").alias("doy"), index.alias("i")).agg(F.count(F.lit(1)).alias("n"))
    text = pairs.groupBy("depot", "doy").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(",", F.col("i").cast("string"), F.col("n").cast("string")))), ";").alias("p"))
    body = text.select(F.col("depot").alias("file"), F.col("doy").cast("bigint").alias("pos"), F.concat(F.col("doy").cast("string"), F.lit(":"), F.col("p")).alias("line"))
    heads = li.select(F.col("depot").alias("file")).distinct().select("file", F.lit(0).cast("bigint").alias("pos"), F.concat(F.lit("#"), F.col("file"), F.lit(";" + head)).alias("line"))
    return bu_loads.parse_loads(heads.unionByName(body))
