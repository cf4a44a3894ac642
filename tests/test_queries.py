"""Registered queries against DuckDB on the smallest tables, and invariants of the kernels'."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from haulgrid.operators import policies, roads, stability
from haulgrid.plans import ORACLE_SQL, QUERIES
from haulgrid.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if type(v).__name__ == "Decimal":
        v = float(v)
    return repr(v + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_its_oracle(spark, db, name):
    got = QUERIES[name](spark, SF)
    want = db.sql(ORACLE_SQL[name])
    columns = list(want.columns)
    assert sorted(got.columns) == sorted(columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    assert mine == sorted(tuple(map(plain, r)) for r in want.fetchall())


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_policies_keep_their_promises(spark):
    d = fx.deliv(spark, SF, 2000.0)
    plans = policies.fix_plans(policies.units_for_plan(d, 2000.0, 3.0)).cache()
    loads = policies.day_loads(d).cache()
    assert plans.groupBy("depot", "train", "bu").count().filter("count > 1").isEmpty()
    a = policies.rolling(d, 2000.0, 3.0, lambdas=(250.0, 1000.0), time_limit=1.0).cache()
    total = loads.agg(F.sum("n")).first()[0]
    for r in a.groupBy("design").agg(F.sum("n").alias("n")).collect():
        assert r.n == total
    m = policies.rolling_metrics(a).cache()
    assert m.filter("inband < 0 OR inband > 1").isEmpty()
    assert m.filter("design = 'FIX' AND moved_share <> 0").isEmpty()
    first = loads.groupBy("depot", "train").agg(F.min("date").alias("date"))
    opening = m.join(first, ["depot", "date"])
    assert opening.filter("cont IS NOT NULL").isEmpty()
    again = policies.rolling(d.repartition(7), 2000.0, 3.0, lambdas=(250.0, 1000.0), time_limit=1.0)
    assert a.exceptAll(again).isEmpty()


def test_shortest_way_never_beats_the_straight_line(spark):
    od = QUERIES["od_matrix"](spark, SF)
    assert od.filter("km < 0 OR (o = d AND km <> 0)").isEmpty()
    assert QUERIES["scc"](spark, SF).count() == 400


def test_snap_far_points_and_empty_sides(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 0.0), (3, 300.0, 300.0)], "node bigint, x double, y double")
    points = spark.createDataFrame([("a", 1.0, 1.0), ("b", 5.0, 0.0), ("far", -400.0, 300.0), ("on", 300.0, 300.0)], "id string, x double, y double")
    assert {r.id: r.node for r in roads.snap_nodes(points, nodes, 3.0).collect()} == {"a": 1, "b": 1, "far": 1, "on": 3}
    assert roads.snap_nodes(points.limit(0), nodes, 3.0).count() == 0
    assert all(r.node is None for r in roads.snap_nodes(points, nodes.limit(0), 3.0).collect())


def test_stability_of_one_courier_and_one_day(spark):
    d = fx.deliv(spark, SF).filter("dow < 5").limit(1)
    row = stability.stability(d).first()
    assert row.parcels == 1 and row.couriers == 1 and row.drift_med is None and row.prev_month_mode_share is None


def test_rolling_metrics_has_all_policies_modes_and_measures(spark):
    m = QUERIES["rolling_metrics"](spark, SF).cache()
    want = {"FIX", "DWS", "DCS", "OPR", "PEN250", "PEN1000", "PEN5000"}
    assert {(r.design, r.annual) for r in m.select("design", "annual").distinct().collect()} == {(x, y) for x in want for y in (False, True)}
    assert m.filter("comp_m IS NULL OR tour_km IS NULL OR comp_m < 0 OR tour_km < 0").isEmpty()
    assert m.groupBy("depot", "date", "design", "annual").count().filter("count > 1").isEmpty()


def test_policy_pen_tells_gap_and_status(spark):
    assert {"gap", "status", "fallback"} <= set(QUERIES["policy_pen"](spark, SF).columns)


def test_sensitivity_has_test_days_of_all_policies(spark):
    from haulgrid.plans.queries_kernels import _sensitivity

    got = _sensitivity(spark, SF, sides=(1500.0,), factors=(1.0,), seeds=(1,), engines=("wvor",)).cache()
    assert {r.design for r in got.select("design").distinct().collect()} == {"FIX", "DWS", "DCS", "OPR", "PEN1000"}
    assert {"side", "target_factor", "seed", "engine", "inband", "cont", "tour_km", "comp_m", "plan_maxdev"} <= set(got.columns)
    assert got.filter("date IS NULL OR inband IS NULL").isEmpty()


def test_couriers_are_counted_once_and_are_the_same_in_every_setting(spark):
    from haulgrid.operators import policies
    from haulgrid.plans.queries_kernels import _sensitivity
    from haulgrid.sources import fixtures as fx

    settings = [(1.0, 1, "wvor"), (1.0, 2, "wvor")]
    own = fx.parcels(spark, SF, 1500.0, "cid").cache()
    rows = policies.rolling(own, 1500.0, 40.0, days=policies.scenarios(policies.counted(own), settings), settings=settings, lambdas=(1000.0,))
    assert rows.filter("design = 'OPR'").count() == policies.couriers(own).count()
    got = _sensitivity(spark, SF, sides=(1500.0,), factors=(1.0,), seeds=(1, 2), engines=("wvor",), full=True).filter("design = 'OPR'").drop("plan_maxdev").cache()
    measures = [c for c in got.columns if c not in ("seed",) and not c.startswith("plan_")]
    one, two = ({tuple(r) for r in got.filter(f"seed = {s}").select(*measures).collect()} for s in (1, 2))
    assert one and one == two


def test_timing_has_the_rebalancing(spark):
    got = QUERIES["policy_timing"](spark, SF).cache()
    pen = got.filter("step LIKE 'PEN%'")
    assert {r.step for r in got.select("step").distinct().collect()} == {"FIX", "DWS", "DCS", "PEN250", "PEN1000", "PEN5000"}
    assert pen.filter("sec IS NULL OR status IS NULL OR fallback IS NULL OR cert IS NULL OR nvar <> n * n_districts").isEmpty()
    assert pen.filter("cert AND NOT fallback").isEmpty()


def test_travel_models_cost_the_same_ways(spark):
    from haulgrid.plans.queries_kernels import _variants

    od = QUERIES["od_lex"](spark, SF).cache()
    assert not od.filter("km > 0").isEmpty() and od.filter("km > 0 AND (abs(min_uniform25 - km / 25 * 60) > 1e-5 OR min_congested <= min)").isEmpty()
    v = _variants(spark, SF).cache()
    assert {r.variant for r in v.select("variant").distinct().collect()} == {"base", "uniform25", "congested"}
    assert v.groupBy("depot", "o", "d").agg(F.count_distinct("km").alias("n")).filter("n > 1").isEmpty()


def test_bootstrap_has_all_measures(spark):
    got = QUERIES["cluster_bootstrap"](spark, SF).cache()
    assert {r.metric for r in got.select("metric").distinct().collect()} == {"inband", "cv", "total_km", "cont"}
    assert got.groupBy("metric", "comp", "scope").count().filter("count > 1").isEmpty()


def test_plan_age_of_both_modes(spark):
    got = QUERIES["plan_age_rolling"](spark, SF).collect()
    assert {(r.annual, r.design) for r in got} == {(a, d) for a in (False, True) for d in ("FIX", "PEN1000")}
    assert all(2 <= r.test <= 12 and 0 <= r.inband <= 1 for r in got)
    assert all(r.moved_share == 0 for r in got if r.design == "FIX")
    # in February both modes have learnt from January
    for d in ("FIX", "PEN1000"):
        one, two = [[(r.inband, r.moved_share) for r in got if r.design == d and r.test == 2 and r.annual == a] for a in (False, True)]
        assert one == two


def test_a_month_without_training_demand_says_so(spark):
    units = spark.createDataFrame([("D", 1, 2, "0_0", 0.0, 0.0, 0.0), ("D", 1, 2, "1_0", 9.0, 0.0, 0.0)],
                                  "depot string, train int, n_districts int, bu string, x double, y double, w double")
    got = policies.fix_plans(units).collect()
    assert [(r.bu, r.k, r.status) for r in sorted(got)] == [("0_0", None, "no demand in training"), ("1_0", None, "no demand in training")]


def test_an_empty_last_district_still_counts(spark):
    day = __import__("datetime").date(2025, 2, 3)
    a = spark.createDataFrame([("D", 1, day, "FIX", "a", 0, 4, 3), ("D", 1, day, "FIX", "b", 1, 2, 3)],
                              "depot string, train int, date date, design string, bu string, k int, n int, n_districts int")
    r = policies.plan_metrics(a).first()
    assert abs(r.inband - 1 / 3) < 1e-12  # loads 4, 2, 0 around a mean of 2


def test_solver_log_has_a_row_a_call(spark):
    log = QUERIES["solver_log"](spark, SF).cache()
    solved = QUERIES["policy_pen"](spark, SF)
    assert log.count() == solved.select("depot", "date", "lam").distinct().count()
    assert log.filter("status = 'infeasible' AND NOT fallback").isEmpty()


def test_cluster_table_by_hand(spark):
    from datetime import date, timedelta

    from haulgrid.operators import routing

    days = [(c, dep, date(2025, 1, 1) + timedelta(days=k), float((k * 7 + len(dep)) % 5 - 1)) for c in ("A - B",) for dep in ("X", "YY") for k in range(200)]
    got = {r.scope: r for r in routing.cluster_table(spark.createDataFrame(days, "comp string, depot string, date date, d double"), 500).collect()}
    assert set(got) == {"All", "X", "YY"}
    for scope, r in got.items():
        own = [x for x in days if scope in ("All", x[1])]
        mean = sum(x[3] for x in own) / len(own)
        months = {}
        for x in own:
            months.setdefault(x[2].month, []).append(x[3])
        same = sum(math.copysign(1, sum(v)) == math.copysign(1, mean) for v in months.values())
        assert abs(r.mean_diff - mean) < 1e-12 and r.months_same_sign == f"{same}/{len(months)}"
        assert r.boot_lo <= mean <= r.boot_hi and 0 <= r.p_month_wilcoxon <= 1


def test_routes_against_the_kernel_and_graph_limits(spark, monkeypatch):
    from haulgrid.operators import routing
    from haulgrid.operators.kernels import tours as K
    import numpy as np

    day = __import__("datetime").date(2025, 2, 3)
    rng = np.random.default_rng(0)
    names = ["@", "a", "b", "c", "d", "e"]
    km = rng.random((6, 6)) + 0.1
    np.fill_diagonal(km, 0)
    od = spark.createDataFrame([("base", "D", o, d, float(km[i, j]), float(2 * km[i, j])) for i, o in enumerate(names) for j, d in enumerate(names)],
                               "variant string, depot string, o string, d string, km double, min double")
    assign = spark.createDataFrame([("D", day, "FIX", 0, u, 2) for u in "abc"] + [("D", day, "FIX", 1, u, 1) for u in "de"],
                                   "depot string, date date, design string, k int, bu string, n int")
    got = {r.k: r for r in routing.routes(assign, od, seeds=(0, 3)).filter("seed = 0").collect()}
    for k, units, parcels in ((0, [0, 1, 2, 3], 6), (1, [0, 4, 5], 2)):
        own = km[np.ix_(units, units)]
        want = K.route_multi(own, 2 * own, 6, 0)
        assert abs(got[k].route_km - want[0]) < 1e-9 and got[k].parcels == parcels and got[k].stops == len(units) - 1
    nodes = spark.createDataFrame([(1,), (2,)], "node bigint")
    edges = spark.createDataFrame([(1, 2, 5.0, 1.0)], "u bigint, v bigint, length_m double, tt_s double")
    monkeypatch.setattr(routing, "MAX_BYTES", 20)
    with pytest.raises(ValueError, match="too large"):
        routing.collect_graph(nodes, edges)
    monkeypatch.undo()
    with pytest.raises(ValueError, match="not in the graph"):
        routing.collect_graph(nodes, edges.selectExpr("u", "v + 7 AS v", "length_m", "tt_s"))


def test_districts_without_a_unit_stay_in_plans_and_policies(spark):
    """More districts than units: the mean load and the numbers of districts are those of the plan."""
    day = __import__("datetime").date(2025, 2, 3)
    units = spark.createDataFrame([("D", 1, 5, f"{i}_0", 1000.0 * i, 0.0, 10.0) for i in range(3)],
                                  "depot string, train int, n_districts int, bu string, x double, y double, w double")
    plans = policies.fix_plans(units).cache()
    assert sorted(r.k for r in policies.plan_centers(plans).collect()) == list(range(5))
    loads = spark.createDataFrame([("D", 1, day, f"{i}_0", 10) for i in range(3)], "depot string, train int, date date, bu string, n int")
    pen = policies.rebalanced(plans, loads, (250.0,)).collect()
    assert all(abs(r.max_bu_over_hi - 10 / (30 / 5 * 8 / 7)) < 1e-9 and r.status == "infeasible" for r in pen)
    own = {r.bu: r.k for r in plans.collect()}
    warm = policies.daily(plans, loads, designs=("DWS",)).collect()
    assert {r.bu: r.k for r in warm} == own  # same demand, so each unit stays in the plan's own district
    assert policies.daily(plans, loads).filter("design = 'DWS'").select("bu", "k").exceptAll(policies.daily(plans, loads, designs=("DWS",)).select("bu", "k")).isEmpty()


def test_counted_parcels_give_the_same_units_and_loads(spark):
    d = fx.deliv(spark, SF, 2000.0)
    few = policies.counted(d).cache()
    for make in (lambda x: policies.units_for_plan(x, 2000.0, 3.0), policies.day_loads):
        one, two = make(d), make(few)
        assert one.dtypes == two.dtypes and one.count() == two.count() and one.exceptAll(two).isEmpty()


def test_spread_and_tours_are_those_of_each_design_by_itself(spark):
    from haulgrid.operators import districts

    d = fx.deliv(spark, SF, 2000.0)
    settings = [(1.0, 42, "mcf"), (2.0, 1, "greedy")]
    a = policies.rolling(d, 2000.0, 3.0, lambdas=(250.0,), settings=settings).cache()
    day = policies.scenarios(d.filter("dow < 5 AND m > 1").select("depot", "date", "bu", "x", "y", F.col("cid").cast("int").alias("cid")), settings)
    p = day.join(a.filter("design <> 'OPR'").select("depot", "date", "design", "bu", "k"), ["depot", "date", "bu"]).select("depot", "date", "design", "k", "x", "y")
    p = p.unionByName(day.select("depot", "date", F.lit("OPR").alias("design"), F.col("cid").alias("k"), "x", "y"))
    tours = policies.tour_estimates(p).groupBy("depot", "date", "design").agg(F.sum("bhh_km").alias("tour_km"))
    want = {(r.depot, r.date, r.design): (r.comp_m, r.tour_km) for r in districts.compactness(p).join(tours, ["depot", "date", "design"]).collect()}
    got = {(r.depot, r.date, r.design): (r.comp_m, r.tour_km) for r in policies.spread_and_tours(d, a).collect()}
    assert set(got) == set(want) and all(abs(x - y) < 1e-6 for key in want for x, y in zip(got[key], want[key], strict=True))


def test_parcels_are_counted_by_cell_and_day_alone(spark):
    d = fx.deliv(spark, SF, 2000.0)
    few, want = policies.counted(d.drop("bu", "m")), d.filter("dow < 5").groupBy("depot", "date", "m", "dow", "bu").agg(F.count(F.lit(1)).cast("int").alias("n"))
    assert few.dtypes == want.dtypes and few.exceptAll(want).isEmpty() and want.exceptAll(few).isEmpty()
    by_courier = policies.counted(d, "cid")
    assert policies.counted(by_courier).exceptAll(want).isEmpty() and want.exceptAll(policies.counted(by_courier)).isEmpty()
    own = d.filter("dow < 5 AND m > 1").groupBy("depot", (F.col("m") - 1).alias("train"), "date", F.lit("OPR").alias("design"), "bu", F.col("cid").cast("int").alias("k")).agg(
        F.count(F.lit(1)).cast("int").alias("n"))
    for got in (policies.couriers(d), policies.couriers(by_courier)):
        assert got.dtypes == own.dtypes and got.exceptAll(own).isEmpty() and own.exceptAll(got).isEmpty()


def test_parcels_of_line_items_are_those_counted(spark):
    for more in ((), ("cid",)):
        got, want = fx.parcels(spark, SF, 1000.0, *more), policies.counted(fx.deliv(spark, SF, 1000.0), *more)
        assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect())


def _made_by(query):
    """Scans and joins in a query's plan."""
    plan = query._jdf.queryExecution().executedPlan().toString()
    return plan.count("FileScan"), plan.count("Join") + plan.count("CoGroup")


def _counted_days(spark):
    """Units of two depots (one a scenario): B has a gap in March, so it has a plan of January only; a unit of A comes in February."""
    rows = [(depot, f"2025-{m:02d}-{day:02d}", m, day % 5, f"{q}_{-q % 3}", 3 + (q * day + m) % 7)
            for depot in ("A", "factor=0.5,seed=7,engine=mcf|B") for m in (1, 2, 3, 4) if depot == "A" or m != 3
            for day in (3, 4, 12, 13) for q in range(9 if depot != "A" or m > 1 else 8)]
    return spark.createDataFrame(rows, "depot string, date string, m int, dow int, bu string, n int").selectExpr("depot", "cast(date AS date) AS date", "m", "dow", "bu", "n").cache()


def test_plans_and_days_of_one_kernel_are_those_of_the_joins(spark):
    d = _counted_days(spark)
    plans = policies.fix_plans(policies.units_for_plan(d, 250.0, 10.0)).cache()
    assert {r.train for r in plans.filter("depot LIKE '%B'").collect()} == {1} and not plans.filter("NOT trained").isEmpty()
    assert sorted(policies.planned(d, 250.0, 10.0).drop("sec").collect()) == sorted(plans.drop("sec").collect())
    one, two = policies.planned_daily(d, 250.0, 10.0).drop("sec"), policies.daily(plans, policies.day_loads(d)).drop("sec")
    assert one.schema == two.schema and sorted(one.collect()) == sorted(two.collect())


def test_policy_dcs_scans_once_and_joins_nothing(spark):
    assert _made_by(QUERIES["policy_dcs"](spark, SF)) == (1, 0)


def test_policy_dws_scans_once_and_joins_nothing(spark):
    assert _made_by(QUERIES["policy_dws"](spark, SF)) == (1, 0)


def test_policy_timing_joins_nothing_for_its_plans(spark, monkeypatch):
    def joined(*_):
        raise AssertionError("units by joins")

    monkeypatch.setattr(policies, "units_for_plan", joined)
    assert QUERIES["policy_timing"](spark, SF).columns[:4] == ["depot", "train", "date", "step"]


def test_fix_labels_are_the_unseen_units_of_the_plans(spark):
    from haulgrid.plans.queries_kernels import _plans

    got = QUERIES["fix_labels"](spark, SF)
    assert _made_by(got) == (1, 0)
    want = _plans(spark, SF)[1].filter("NOT trained").select("depot", "train", "bu", "k")
    assert got.schema == want.schema and sorted(got.collect()) == sorted(want.collect()) != []


def test_hungarian_align_matches_each_month_to_the_one_before(spark):
    import numpy as np

    from haulgrid.operators.kernels import assignment
    from haulgrid.plans.queries_kernels import _plans

    got = QUERIES["hungarian_align"](spark, SF)
    assert _made_by(got) == (1, 0)
    at = {}
    for r in sorted(policies.plan_centers(_plans(spark, SF)[1]).collect()):
        at.setdefault((r.depot, r.train), []).append((r.cx, r.cy))
    want = [(depot, m, k, int(before)) for (depot, m), c in at.items() if (depot, m - 1) in at
            for k, before in enumerate(assignment.match_places(np.array(c), np.array(at[depot, m - 1])))]
    assert sorted(map(tuple, got.collect())) == sorted(want) != []
