"""Queries on design comparison, statistics and the road tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulgrid.functions import roads as road_functions
from haulgrid.operators import designs, districts, roads, statistics
from haulgrid.plans.registry import query
from haulgrid.sources import fixtures as fx
from haulgrid.sources.fixtures import DESIGNS, with_views

PAIRS = (("DWS", "FIX"), ("PEN1000", "FIX"), ("PEN1000", "DWS"), ("DCS", "DWS"))
_PAIRS = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PAIRS) + ") p(a, b)"


def _diffs(value: str) -> str:
    return f"""SELECT x.depot, x.date, p.a || ' - ' || p.b AS comp, x.{value} AS va, y.{value} AS vb, x.{value} - y.{value} AS d
        FROM metrics x JOIN metrics y ON x.depot = y.depot AND x.date = y.date JOIN {_PAIRS} ON x.design = p.a AND y.design = p.b WHERE x.{value} - y.{value} IS NOT NULL"""


def _x(spark, sf_dir, value="road_km") -> DataFrame:
    """Paired differences as rows (scope, id, x)."""
    d = designs.pair_differences(fx.metrics(spark, sf_dir), value, PAIRS)
    return d.select(F.concat_ws(" | ", "comp", "depot").alias("scope"), F.col("date").alias("id"), F.col("d").alias("x"))


_X = {"diffs": _diffs("road_km"), "x": "SELECT comp || ' | ' || depot AS scope, date AS id, d AS x FROM diffs"}


@query(with_views("metrics") + "SELECT depot, date, " + ", ".join(
    f"avg(inband) FILTER (design = '{d}') AS {d}" for d in DESIGNS) + " FROM metrics GROUP BY depot, date", " ".join(DESIGNS), 9)
def design_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return designs.design_pivot(fx.metrics(spark, sf_dir), "inband")


@query(with_views("routes") + "SELECT depot, date, " + ", ".join(
    f"sum(route_min) FILTER (design = '{d}') AS {d}" for d in DESIGNS) + " FROM routes WHERE variant = 'uniform25' GROUP BY depot, date", " ".join(DESIGNS), 7)
def design_pivot_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return designs.design_pivot(fx.routes(spark, sf_dir).filter("variant = 'uniform25'"), "route_min", how="sum")


@query(with_views("metrics") + "SELECT a.design AS a, b.design AS b FROM (SELECT DISTINCT design FROM metrics) a JOIN (SELECT DISTINCT design FROM metrics) b ON a.design < b.design")
def design_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return designs.design_pairs(fx.metrics(spark, sf_dir).select("design").distinct())


_ROAD = {"road": "SELECT variant, depot, date, design, sum(route_km + intra_km) AS road_km, sum(route_min) AS road_min, count(*) AS routes FROM routes GROUP BY ALL"}


@query(with_views("metrics") + """SELECT m.depot, m.date, m.design, 100 * m.total_km / f.total_km AS tidx_total, 100 * m.tour_km / f.tour_km AS tidx_local
        FROM metrics m LEFT JOIN metrics f ON m.depot = f.depot AND m.date = f.date AND f.design = 'FIX'""", "tidx_total tidx_local", 9)
def fix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.metrics(spark, sf_dir).select("depot", "date", "design", "total_km", "tour_km")
    return designs.fix_index(m, tidx_total="total_km", tidx_local="tour_km").drop("total_km", "tour_km")


@query(with_views("routes", more=_ROAD) + "SELECT * FROM road", "road_km road_min", 7)
def road_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return designs.road_day(fx.routes(spark, sf_dir))


@query(with_views("metrics", "routes", more=_ROAD | {"j": """SELECT m.depot, m.date, m.design, m.total_km, r.road_km, r.road_min, r.routes FROM metrics m
        LEFT JOIN road r ON m.depot = r.depot AND m.date = r.date AND m.design = r.design AND r.variant = 'base'"""}) + """SELECT j.*, 100 * j.road_km / f.road_km AS ridx, 100 * j.road_min / f.road_min AS midx, 100 * j.total_km / f.total_km AS sidx
        FROM j LEFT JOIN j f ON j.depot = f.depot AND j.date = f.date AND f.design = 'FIX'""", "total_km road_km road_min ridx midx sidx", 7)
def road_day_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.metrics(spark, sf_dir).select("depot", "date", "design", "total_km")
    return designs.road_day_join(m, designs.road_day(fx.routes(spark, sf_dir)))


@query(with_views("routes", more=_ROAD) + """SELECT depot, design, avg(road_km) AS km, avg(road_min) AS mn, avg(routes) AS routes, avg(road_km) / avg(routes) AS km_route
        FROM road WHERE variant = 'base' GROUP BY ALL""", "km mn routes km_route")
def road_cost_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return designs.road_cost_table(designs.road_day(fx.routes(spark, sf_dir)))


@query(with_views("metrics", more={"diffs": _diffs("total_km")}) + "SELECT comp, 100 * avg(va / vb - 1) AS effect, avg(d) AS mean_diff, count(*) AS n_days FROM diffs GROUP BY comp", "effect mean_diff")
def relative_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return designs.relative_effect(fx.metrics(spark, sf_dir), "total_km", PAIRS)


@query(with_views("routes") + """SELECT depot, m.multiplier, sum(route_km + intra_km * m.multiplier) AS km, 100 * (1 - sum(route_km) / sum(route_km + intra_km * m.multiplier)) AS intra_share
        FROM routes, (VALUES (CAST(0 AS DOUBLE)), (CAST(1 AS DOUBLE)), (CAST(2 AS DOUBLE))) m(multiplier) WHERE variant = 'base' AND design = 'FIX' GROUP BY ALL""", "km intra_share")
def intra_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return designs.intra_share(fx.routes(spark, sf_dir))


@query(with_views("routes", more=_ROAD | {"b": """SELECT x.depot, x.road_km AS km0, y.road_km AS km1 FROM road x JOIN road y ON x.depot = y.depot AND x.date = y.date AND x.design = y.design
        AND x.variant = 'base' AND y.variant = 'seed1'"""}) + """SELECT depot, avg(km1 - km0) AS mean, stddev_samp(km1 - km0) AS sd, median(100 * abs(km1 - km0) / km0) AS rel_median,
        quantile_cont(100 * abs(km1 - km0) / km0, 0.95) AS rel_p95 FROM b GROUP BY depot""", "mean sd rel_median rel_p95")
def seed_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return designs.seed_noise(designs.road_day(fx.routes(spark, sf_dir)))


@query(with_views("metrics", more={"day": """SELECT depot, date, max(road_km) FILTER (design = 'PEN1000') - max(road_km) FILTER (design = 'DWS') AS dk,
        max(road_min) FILTER (design = 'PEN1000') - max(road_min) FILTER (design = 'DWS') AS dm, max(cont) FILTER (design = 'PEN1000') - max(cont) FILTER (design = 'DWS') AS dc,
        max(V) FILTER (design = 'FIX') AS V FROM metrics GROUP BY depot, date"""}) + """SELECT count(*) AS n_days, avg(dk) AS dk, avg(dm) AS dm, avg(dc * V) AS parcels, 1000 * avg(dk) / avg(dc * V) AS m_per_parcel,
        60 * avg(dm) / avg(dc * V) AS s_per_parcel FROM day WHERE dc IS NOT NULL""", "dk dm parcels m_per_parcel s_per_parcel")
def breakeven(spark: SparkSession, sf_dir: str) -> DataFrame:
    return designs.breakeven(fx.metrics(spark, sf_dir))


@query(with_views("metrics") + "SELECT depot, design, avg(inband) AS inband, avg(cv) AS cv, avg(cont) AS cont, avg(total_km) AS total_km FROM metrics GROUP BY depot, design", "inband cv cont total_km", 9)
def design_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return designs.design_means(fx.metrics(spark, sf_dir), ("inband", "cv", "cont", "total_km"), ("depot", "design"))


@query(with_views("metrics") + "SELECT design, avg(inband) AS inband, avg(cont) AS cont, avg(road_km) AS road_km FROM metrics GROUP BY design", "inband cont road_km", 9)
def tradeoff_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return designs.design_means(fx.metrics(spark, sf_dir), ("inband", "cont", "road_km"))


@query(with_views("metrics") + """SELECT depot, date, design, rank() OVER (PARTITION BY depot, date ORDER BY road_km) + (count(*) OVER (PARTITION BY depot, date, road_km) - 1) / CAST(2 AS DOUBLE) AS rank,
        first_value(design) OVER (PARTITION BY depot, date ORDER BY road_km, design) AS best FROM metrics""")
def design_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return designs.design_rank(fx.metrics(spark, sf_dir), "road_km")


@query(with_views("metrics") + "SELECT design, CAST(month(date) AS INTEGER) AS test, avg(inband) AS inband, avg(moved_share) AS moved_share FROM metrics GROUP BY ALL", "inband moved_share", 9)
def plan_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return designs.plan_age(fx.metrics(spark, sf_dir))


@query(with_views("metrics") + "SELECT variant, depot, date, design, inband FROM (SELECT 'monthly' AS variant, * FROM metrics WHERE month(date) < 7 UNION ALL SELECT 'seed1', * FROM metrics WHERE month(date) >= 7)", "inband", 9)
def metrics_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of result tables by variant, the annual one left out."""
    m = fx.metrics(spark, sf_dir).select("depot", "date", "design", "inband")
    parts = {"monthly": m.filter(F.month("date") < 7), "seed1": m.filter(F.month("date") >= 7), "annual": m}
    every = None
    for name, part in parts.items():
        part = part.withColumn("variant", F.lit(name))
        every = part if every is None else every.unionByName(part)
    return every.filter("variant <> 'annual'")


_WALSH = _X | {
    "ranked": "SELECT *, row_number() OVER (PARTITION BY scope ORDER BY x, id) AS i FROM x",
    "walsh": "SELECT a.scope, (a.x + b.x) / 2 AS w FROM ranked a JOIN ranked b ON a.scope = b.scope AND a.i <= b.i",
    "size": f"""SELECT scope, n, n * (n + 1) / CAST(2 AS DOUBLE) AS nn, greatest(floor(n * (n + 1) / CAST(4 AS DOUBLE) - CAST({statistics.Z95!r} AS DOUBLE) * sqrt(n * (n + 1) * (2 * n + 1) / CAST(24 AS DOUBLE))), 0) AS k
        FROM (SELECT scope, CAST(count(*) AS DOUBLE) AS n FROM x GROUP BY scope)""",
    "placed": "SELECT *, row_number() OVER (PARTITION BY scope ORDER BY w) - 1 AS r FROM walsh",
}


@query(with_views("metrics", more=_WALSH) + """SELECT p.scope, CAST(max(n) AS BIGINT) AS n, median(w) AS hl, max(w) FILTER (r = k) AS ci_lo, max(w) FILTER (r = least(nn - 1 - k, nn - 1)) AS ci_hi
        FROM placed p JOIN size s ON p.scope = s.scope GROUP BY p.scope""", "hl ci_lo ci_hi")
def hodges_lehmann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.hodges_lehmann(_x(spark, sf_dir))


@query(with_views("metrics", more=_X) + """SELECT scope, count(*) AS n_nonzero, sum(CASE WHEN x > 0 THEN r ELSE 0 END) AS r_plus, sum(CASE WHEN x < 0 THEN r ELSE 0 END) AS r_minus,
        least(sum(CASE WHEN x > 0 THEN r ELSE 0 END), sum(CASE WHEN x < 0 THEN r ELSE 0 END)) AS W FROM (SELECT *, rank() OVER (PARTITION BY scope ORDER BY abs(x))
        + (count(*) OVER (PARTITION BY scope, abs(x)) - 1) / CAST(2 AS DOUBLE) AS r FROM x WHERE x <> 0) GROUP BY scope""")
def wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.wilcoxon(_x(spark, sf_dir))


@query(with_views("metrics", more=_X) + """SELECT scope, sum(sign(x) * r) / sum(r) AS r_rb FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY abs(x), id) AS r FROM x WHERE x <> 0) GROUP BY scope""", "r_rb", 9)
def rank_biserial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.rank_biserial(_x(spark, sf_dir))


_TESTS = """SELECT 'c' || c_custkey AS test, abs(c_acctbal) / 200000 AS p, c_acctbal AS effect FROM customer"""


def _tests(spark, sf_dir):
    return fx.read(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("test"), (F.abs("c_acctbal") / 200000).alias("p"), F.col("c_acctbal").alias("effect"))


@query(f"SELECT *, least(p * 48, 1) AS p_bonf FROM ({_TESTS})", "p p_bonf", 12)
def bonferroni(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.bonferroni(_tests(spark, sf_dir), 48)


@query(f"""SELECT test, p, effect, least(min(p * m / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING), 1) AS q_bh
        FROM (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, test) AS i FROM ({_TESTS}))""", "p q_bh", 12)
def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.benjamini_hochberg(_tests(spark, sf_dir))


@query(f"""SELECT count(*) FILTER (p_bonf < 0.05) AS n_significant, count(*) AS n_tests, coalesce(string_agg(test, ',' ORDER BY test) FILTER (p_bonf >= 0.05), '') AS not_significant,
        min(abs(effect)) FILTER (p_bonf < 0.05) AS min_effect FROM (SELECT *, least(p * 20, 1) AS p_bonf FROM ({_TESTS}))""")
def family_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.family_summary(statistics.bonferroni(_tests(spark, sf_dir), 20))


@query(with_views("metrics", more={"diffs": _diffs("inband")}) + """SELECT comp, scope, CAST(weekofyear(date) AS INTEGER) AS week, sum(d) AS sum_d, count(d) AS n_d
        FROM (SELECT *, unnest(['All', depot]) AS scope FROM diffs) GROUP BY ALL""", "sum_d", 9)
def week_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.week_sums(designs.pair_differences(fx.metrics(spark, sf_dir), "inband", PAIRS))


@query(with_views("metrics", more={"diffs": _diffs("road_km")}) + """SELECT m.comp, CAST(count(*) FILTER (sign(mm) = sign(mean_diff)) AS VARCHAR) || '/' || count(*) AS months FROM
        (SELECT comp, month(date) AS m, avg(d) AS mm FROM diffs GROUP BY ALL) m JOIN (SELECT comp, avg(d) AS mean_diff FROM diffs GROUP BY comp) w ON m.comp = w.comp GROUP BY m.comp""")
def months_same_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.months_same_sign(designs.pair_differences(fx.metrics(spark, sf_dir), "road_km", PAIRS))


def _rank(c: str) -> str:
    return f"rank() OVER (PARTITION BY depot ORDER BY {c}) + (count(*) OVER (PARTITION BY depot, {c}) - 1) / CAST(2 AS DOUBLE)"


@query(with_views("metrics") + f"SELECT depot, corr(a, b) AS rho FROM (SELECT depot, {_rank('tour_km')} AS a, {_rank('road_km')} AS b FROM metrics) GROUP BY depot", "rho", 9)
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.spearman(fx.metrics(spark, sf_dir), ["depot"], "tour_km", "road_km")


@query(with_views("metrics", more={"d1": _diffs("road_km"), "d2": _diffs("total_km")}) + """SELECT a.comp, 100 * avg(CAST(sign(a.d) = sign(b.d) AS INTEGER)) AS sign_agree, corr(a.d, b.d) AS corr, avg(a.d) AS mean1, avg(b.d) AS mean2
        FROM d1 a JOIN d2 b ON a.depot = b.depot AND a.date = b.date AND a.comp = b.comp GROUP BY a.comp""", "sign_agree corr mean1 mean2")
def pair_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.metrics(spark, sf_dir)
    one = designs.pair_differences(m, "road_km", PAIRS).select("depot", "date", "comp", F.col("d").alias("d1"))
    two = designs.pair_differences(m, "total_km", PAIRS).select("depot", "date", "comp", F.col("d").alias("d2"))
    return statistics.pair_agreement(one.join(two, ["depot", "date", "comp"]))


@query(with_views("metrics", more={"p": """SELECT x.depot, x.date, sign(x.road_km - y.road_km) AS sa, sign(x.total_km - y.total_km) AS sb FROM metrics x JOIN metrics y
        ON x.depot = y.depot AND x.date = y.date AND x.design < y.design"""}) + "SELECT depot, date, sum(sa * sb) / nullif(sqrt(sum(abs(sa)) * sum(abs(sb))), 0) AS tau FROM p GROUP BY depot, date", "tau")
def kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.kendall(fx.metrics(spark, sf_dir), "road_km", "total_km")


@query(with_views("metrics", more={"p": """SELECT x.depot, x.date, sign(x.road_km - y.road_km) AS sa, sign(x.total_km - y.total_km) AS sb FROM metrics x JOIN metrics y
        ON x.depot = y.depot AND x.date = y.date AND x.design < y.design""",
        "t": "SELECT depot, date, sum(sa * sb) / nullif(sqrt(sum(abs(sa)) * sum(abs(sb))), 0) AS tau FROM p GROUP BY depot, date",
        "b": "SELECT depot, date, min({a: road_km, d: design}) AS x, min({a: total_km, d: design}) AS y FROM metrics GROUP BY depot, date"}) +
       "SELECT (SELECT median(tau) FROM t) AS tau_median, 100 * avg(CAST(x.d = y.d AS INTEGER)) AS same_best, count(*) AS days FROM b", "tau_median same_best")
def kendall_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.kendall_summary(fx.metrics(spark, sf_dir), "road_km", "total_km")


SIDE = 20
_GRID = f"""SELECT CAST(i AS BIGINT) AS node, CAST(i % {SIDE} * 110 AS DOUBLE) AS x, CAST(i // {SIDE} * 130 + (i * 7) % 11 AS DOUBLE) AS y FROM range({SIDE * SIDE + 2}) t(i)"""
#: Ways of the grid: rows and columns of streets, every third one-way, one apart from the rest.
_GRID_WAYS = f"""SELECT w AS way, CASE WHEN w % 2 = 0 THEN CAST(30 AS DOUBLE) ELSE CAST(50 AS DOUBLE) END AS speed, w % 11 <> 5 AS fwd, w % 3 <> 0 AS bwd,
        CASE WHEN w < {SIDE} THEN list_transform(range({SIDE}), lambda c: w * {SIDE} + c) WHEN w < {2 * SIDE} THEN list_transform(range({SIDE}), lambda c: c * {SIDE} + w - {SIDE})
             ELSE [{SIDE * SIDE}, {SIDE * SIDE + 1}] END AS refs FROM range({2 * SIDE + 1}) t(w)"""


def grid_nodes(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(SIDE * SIDE + 2).select(
        i.alias("node"), (i % SIDE * 110).cast("double").alias("x"), (F.floor(i / SIDE) * 130 + (i * 7) % 11).cast("double").alias("y"))


def grid_ways(spark: SparkSession) -> DataFrame:
    w, steps = F.col("id"), F.sequence(F.lit(0).cast("bigint"), F.lit(SIDE - 1).cast("bigint"))
    refs = F.when(w < SIDE, F.transform(steps, lambda c: w * SIDE + c)).when(
        w < 2 * SIDE, F.transform(steps, lambda c: c * SIDE + w - SIDE)).otherwise(F.array(F.lit(SIDE * SIDE).cast("bigint"), F.lit(SIDE * SIDE + 1).cast("bigint")))
    return spark.range(2 * SIDE + 1).select(
        w.alias("way"), F.when(w % 2 == 0, 30.0).otherwise(50.0).alias("speed"), (w % 11 != 5).alias("fwd"), (w % 3 != 0).alias("bwd"), refs.alias("refs"))


def grid_edges(spark: SparkSession) -> DataFrame:
    return roads.way_edges(grid_ways(spark), grid_nodes(spark))


_EDGES = {
    "nodes": _GRID, "ways": _GRID_WAYS,
    "steps": "SELECT speed, fwd, bwd, refs[i] AS u, refs[i + 1] AS v FROM (SELECT *, unnest(generate_series(1, len(refs) - 1)) AS i FROM ways)",
    "long": """SELECT s.*, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS length_m FROM steps s JOIN nodes a ON s.u = a.node JOIN nodes b ON s.v = b.node""",
    "edges": """SELECT u, v, length_m, length_m / (speed / CAST(3.6 AS DOUBLE)) AS tt_s FROM long WHERE fwd
        UNION ALL SELECT v, u, length_m, length_m / (speed / CAST(3.6 AS DOUBLE)) FROM long WHERE bwd""",
}
_WITH_EDGES = "WITH " + ", ".join(f"{n} AS ({q})" for n, q in _EDGES.items()) + " "


@query(_WITH_EDGES + "SELECT * FROM edges", "length_m tt_s", 9)
def way_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_edges(spark)


@query(_WITH_EDGES + "SELECT u, v, min(length_m) AS length_m, min(tt_s) AS tt_s FROM (SELECT * FROM edges UNION ALL SELECT u, v, length_m + 5, tt_s + 1 FROM edges WHERE u % 7 = 0 UNION ALL SELECT u, u, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM edges) WHERE length_m > 0 GROUP BY u, v",
       "length_m tt_s", 9)
def edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = grid_edges(spark)
    twice = e.filter("u % 7 = 0").select("u", "v", F.col("length_m") + 5, F.col("tt_s") + 1)
    none = e.select("u", F.col("u").alias("v"), F.lit(0.0), F.lit(0.0))
    return roads.merge_parallel(e.unionAll(twice).unionAll(none))


@query(_WITH_EDGES + """SELECT u, v, tt_s AS tt_mapped, length_m / (CAST(25 AS DOUBLE) / CAST(3.6 AS DOUBLE)) AS tt_uniform25,
        length_m / (least(CAST(0.6 AS DOUBLE) * length_m / tt_s * CAST(3.6 AS DOUBLE), 40) / CAST(3.6 AS DOUBLE)) AS tt_congested FROM edges""", "tt_mapped tt_uniform25 tt_congested")
def speed_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = road_functions.speed_variants(F.col("length_m"), F.col("tt_s"))
    return grid_edges(spark).select("u", "v", *[c.alias(n) for n, c in v.items()])


_ANCHOR = {"anchor": "SELECT depot || ' ' || bu AS id, x % 2600 - 200 AS x, y % 3100 - 300 AS y FROM (SELECT depot, bu, avg(x) AS x, avg(y) AS y FROM deliv WHERE dow < 5 GROUP BY ALL)", "nodes": _GRID}


@query(with_views("deliv", more=_ANCHOR) + """SELECT id, min({d: sqrt(power(a.x - n.x, 2) + power(a.y - n.y, 2)), n: node}).n AS node, min(sqrt(power(a.x - n.x, 2) + power(a.y - n.y, 2))) AS snap_m
        FROM anchor a, nodes n GROUP BY id""", "snap_m")
def snap_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = fx.deliv(spark, sf_dir).filter("dow < 5").groupBy("depot", "bu").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    anchor = units.select(F.concat_ws(" ", "depot", "bu").alias("id"), (F.col("x") % 2600 - 200).alias("x"), (F.col("y") % 3100 - 300).alias("y"))
    return roads.snap_nodes(anchor, grid_nodes(spark), 120.0)


_STOPS = {"big": fx.hex_sql("scans", 1000.0), "pts": "SELECT depot, bu, avg(x) AS x, avg(y) AS y FROM big WHERE dow < 5 GROUP BY ALL"}


def _points(spark, sf_dir):
    return fx.deliv(spark, sf_dir, 1000.0).filter("dow < 5").groupBy("depot", "bu").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


@query(with_views("scans", more=_STOPS) + "SELECT a.depot, a.bu AS o, b.bu AS d, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) / 1000 AS euclid_km FROM pts a JOIN pts b ON a.depot = b.depot", "euclid_km")
def od_euclid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads.od_euclid(_points(spark, sf_dir))


@query(with_views("scans", more=_STOPS | {"od": """SELECT a.depot, a.bu AS o, b.bu AS d, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) / 1000 AS e, (abs(a.x - b.x) + abs(a.y - b.y)) / 1000 AS km
        FROM pts a JOIN pts b ON a.depot = b.depot"""}) + "SELECT depot, median(km / e) AS circ FROM od WHERE o <> d AND e > CAST(0.3 AS DOUBLE) GROUP BY depot", "circ")
def circuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circuity with rectangular distances in the place of the road's."""
    p = _points(spark, sf_dir)
    other = p.select("depot", F.col("bu").alias("d"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    rect = p.join(other, "depot").select("depot", F.col("bu").alias("o"), "d", ((F.abs(F.col("x") - F.col("x2")) + F.abs(F.col("y") - F.col("y2"))) / 1000).alias("km"))
    return roads.circuity(roads.od_euclid(p).join(rect, ["depot", "o", "d"]))


@query(with_views("deliv") + """SELECT depot, median(x) AS mx, median(y) AS my, quantile_cont(x - mid, 0.002) AS x_lo, quantile_cont(x - mid, 0.998) AS x_hi FROM
        (SELECT *, median(x) OVER (PARTITION BY depot) AS mid FROM deliv WHERE dow < 5) GROUP BY depot""", "mx my x_lo x_hi")
def study_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depot medians and the range of offsets around them."""
    d = fx.deliv(spark, sf_dir).filter("dow < 5")
    mid = d.groupBy("depot").agg(F.median("x").alias("mx"), F.median("y").alias("my"))
    return d.join(mid, "depot").groupBy("depot").agg(
        F.first("mx").alias("mx"), F.first("my").alias("my"), F.percentile(F.col("x") - F.col("mx"), 0.002).alias("x_lo"),
        F.percentile(F.col("x") - F.col("mx"), 0.998).alias("x_hi"))


@query(with_views("seq", more={
    "u": "SELECT depot, date, cid, t, event_id, 'u' || (event_id % 6) AS bu FROM seq",
    "moved": "SELECT *, row_number() OVER (PARTITION BY depot, date, cid ORDER BY t) AS i FROM (SELECT *, lag(bu) OVER (PARTITION BY depot, date, cid ORDER BY t) AS b FROM u) WHERE b IS NULL OR b <> bu",
    "legs": """SELECT depot, date, cid, coalesce(lag(bu) OVER w, '@') AS o, bu AS d FROM moved WINDOW w AS (PARTITION BY depot, date, cid ORDER BY t)
        UNION ALL SELECT depot, date, cid, arg_max(bu, t), '@' FROM moved GROUP BY depot, date, cid""",
    "stops": "SELECT * FROM (VALUES ('@', 0), ('u0', 1), ('u1', 2), ('u2', 3), ('u3', 4), ('u4', 5), ('u5', 6)) s(bu, i)"})
    + """SELECT depot, date, cid, sum(abs(a.i - b.i) * CAST(1.5 AS DOUBLE)) AS actual_km, sum(CAST(1 + (a.i * 3 + b.i) % 5 AS DOUBLE)) AS actual_min, count(*) AS legs
        FROM legs l JOIN stops a ON l.o = a.bu JOIN stops b ON l.d = b.bu GROUP BY ALL""", "actual_km actual_min")
def validate_road(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of driving the scans in their order on an origin-destination table."""
    stops = fx.seq(spark, sf_dir).select("depot", "date", "cid", "t", F.concat(F.lit("u"), (F.col("event_id") % 6).cast("string")).alias("bu"))
    s = spark.createDataFrame([("@", 0)] + [(f"u{k}", k + 1) for k in range(6)], "bu string, i int")
    od = s.select(F.col("bu").alias("o"), F.col("i").alias("a")).crossJoin(s.select(F.col("bu").alias("d"), F.col("i").alias("b")))
    od = od.select("o", "d", (F.abs(F.col("a") - F.col("b")) * 1.5).alias("km"), (1 + (F.col("a") * 3 + F.col("b")) % 5).cast("double").alias("min"))
    depots = spark.createDataFrame([(d,) for d in fx.DEPOTS], "depot string")
    return roads.sequence_cost(stops, depots.crossJoin(od))
