"""Queries on sources, geometry, stability, feasibility and district measures."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulgrid.functions import geo, roads
from haulgrid.operators import districts, feasibility as feas, stability
from haulgrid.plans.registry import query
from haulgrid.sources import fixtures as fx
from haulgrid.sources import readers, sinks
from haulgrid.sources.fixtures import K, hex_sql, with_views
from haulgrid.sources.stage import shared_folder

#: The stand-in data are sparser than real depots: fewer parcels a day, so a lower target.
TARGET = 10.0
WD = "SELECT * FROM deliv WHERE dow < 5"
DAYS = "SELECT depot, date, min(m) AS m, count(*) AS V, count(DISTINCT cid) AS k_obs FROM deliv WHERE dow < 5 GROUP BY depot, date"


def _weekdays(spark, sf_dir):
    return fx.deliv(spark, sf_dir).filter("dow < 5")


_SCANS = with_views("scans") + "SELECT barcode, t, CAST(month(t) AS INTEGER) AS m, depot AS facility, CAST(cid AS VARCHAR) AS user_id, lon, lat FROM scans"


def _raw_scans(spark, sf_dir):
    return fx.scans(spark, sf_dir).select(
        F.col("barcode").alias("ShipmentItemBarcode"), F.col("t").cast("string").alias("EventDatetime"),
        F.col("depot").alias("FacilityCode"), F.col("cid").cast("string").alias("UserID"),
        F.col("lon").cast("string").alias("EventGeoX"), F.col("lat").cast("string").alias("EventGeoY"))


def _short_names(events):
    return events.select(
        F.col("ShipmentItemBarcode").alias("barcode"), "t", "m", F.col("FacilityCode").alias("facility"),
        F.col("UserID").alias("user_id"), F.col("EventGeoX").alias("lon"), F.col("EventGeoY").alias("lat"))


@query(_SCANS)
def scan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed scan of delivery events that arrive as text."""
    return _short_names(readers.typed_events(_raw_scans(spark, sf_dir)))


@query(_SCANS)
def scan_events_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through gzipped CSV files, written and read."""
    folder = f"{shared_folder(spark)}/scans-{uuid.uuid4().hex}"
    sinks.write_csv(_raw_scans(spark, sf_dir), folder, gzip=True)
    return _short_names(readers.read_events(spark, folder))


@query(with_views("lines") + """SELECT 'Depot0' || (l_suppkey % 10 // 2) AS depot, count(*) AS n FROM lines
        WHERE l_suppkey % 10 // 2 BETWEEN 1 AND 4 GROUP BY ALL""")
def facility_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of mapped facilities only, by depot."""
    pairs = [(f"{c:02d}", f"Depot0{c // 2}") for c in range(10)]
    mapped = readers.check_facility_map(spark.createDataFrame(pairs, "FacilityCode string, depot string"))
    events = fx.read(spark, sf_dir, "lineitem").select(F.lpad((F.col("l_suppkey") % 10).cast("string"), 2, "0").alias("FacilityCode"))
    return readers.apply_facility_map(events, mapped).groupBy("depot").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'Depot0' || (1 + s_suppkey % 4) AS depot, min(15.9 + s_suppkey % 4 / CAST(10 AS DOUBLE)) AS lon, CAST(45.8 AS DOUBLE) AS lat
        FROM supplier GROUP BY ALL""", "lon lat")
def depot_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depot coordinates through the projection and back."""
    rows = [(f"Depot0{1 + i}", 45.8, 15.9 + i / 10) for i in range(4)]
    d = readers.check_depots(spark.createDataFrame(rows, "depot string, lat double, lon double"))
    lon, lat = geo.unproject_tm("x", "y")
    return d.select("depot", lon.alias("lon"), lat.alias("lat"))


@query(with_views("scans") + """SELECT barcode, lon, lat, (lon - CAST(15.9819 AS DOUBLE)) * (111320 * cos(radians(CAST(45.8150 AS DOUBLE)))) AS lx,
        (lat - CAST(45.8150 AS DOUBLE)) * CAST(111132.9 AS DOUBLE) AS ly FROM scans""", "lx ly")
def local_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.local_xy("lon", "lat")
    return fx.scans(spark, sf_dir).select("barcode", "lon", "lat", x.alias("lx"), y.alias("ly"))


_A, _B = geo._ALPHA, geo._BETA
_TM = f"""SELECT lon, lat, n,
    {geo.FALSE_EAST!r}::DOUBLE + {geo.SCALE * geo._RADIUS!r}::DOUBLE * (eta + {' + '.join(f'{a!r}::DOUBLE * cos({2 * k} * xi) * sinh({2 * k} * eta)' for k, a in enumerate(_A, 1))}) AS x,
    {geo.SCALE * geo._RADIUS!r}::DOUBLE * (xi + {' + '.join(f'{a!r}::DOUBLE * sin({2 * k} * xi) * cosh({2 * k} * eta)' for k, a in enumerate(_A, 1))}) AS y
    FROM (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta
    FROM (SELECT *, sinh(atanh(sin(phi)) - {geo._ECC!r}::DOUBLE * atanh({geo._ECC!r}::DOUBLE * sin(phi))) AS t
    FROM (SELECT lon, lat, radians(lat) AS phi, radians(lon) - radians(CAST(16.5 AS DOUBLE)) AS lam, count(*) AS n FROM scans GROUP BY lon, lat)))"""


@query(with_views("scans") + _TM, "x y lon lat", 5)
def project_tm(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = fx.scans(spark, sf_dir).groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("n"))
    x, y = geo.project_tm("lon", "lat")
    return places.select("lon", "lat", "n", x.alias("x"), y.alias("y"))


@query(with_views("scans") + "SELECT lon, lat, lon AS lon_back, lat AS lat_back, count(*) AS n FROM scans GROUP BY lon, lat", "lon lat lon_back lat_back", 8)
def unproject_tm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward and back again: the degrees must return."""
    places = fx.scans(spark, sf_dir).groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("n"))
    x, y = geo.project_tm("lon", "lat")
    lon, lat = geo.unproject_tm("x", "y")
    return places.withColumns({"x": x, "y": y}).select("lon", "lat", lon.alias("lon_back"), lat.alias("lat_back"), "n")


@query(with_views("deliv") + "SELECT depot, count(*) AS n, count(DISTINCT bu) AS units, sum(q) AS sum_q, sum(r) AS sum_r FROM deliv GROUP BY depot")
def hex_axial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.deliv(spark, sf_dir).groupBy("depot").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("bu").alias("units"), F.sum("q").alias("sum_q"), F.sum("r").alias("sum_r"))


@query(with_views("deliv") + """SELECT DISTINCT bu, q, r, CAST(250 AS DOUBLE) * CAST(1.7320508075688772 AS DOUBLE) * (q + r / CAST(2 AS DOUBLE)) AS hx,
        CAST(375 AS DOUBLE) * r AS hy FROM deliv""", "hx hy")
def hex_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.hex_center("q", "r", 250.0)
    return fx.deliv(spark, sf_dir).select("bu", "q", "r").distinct().select("bu", "q", "r", x.alias("hx"), y.alias("hy"))


@query(with_views("deliv") + "SELECT DISTINCT bu, CAST(split_part(bu, '_', 1) AS INTEGER) AS q, CAST(split_part(bu, '_', 2) AS INTEGER) AS r FROM deliv")
def bu_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r = geo.bu_parse("bu")
    return fx.deliv(spark, sf_dir).select("bu").distinct().select("bu", q.alias("q"), r.alias("r"))


@query(with_views("scans", more={"big": hex_sql("scans", 1000.0)}) + """SELECT CAST(1000 AS DOUBLE) * CAST(1.7320508075688772 AS DOUBLE) * (q + r / CAST(2 AS DOUBLE)) AS sx,
        CAST(1500 AS DOUBLE) * r AS sy, count(*) AS n FROM big GROUP BY ALL""", "sx sy")
def hex_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.hex_snap("x", "y", 1000.0)
    return fx.scans(spark, sf_dir).select(x.alias("sx"), y.alias("sy")).groupBy("sx", "sy").agg(F.count(F.lit(1)).alias("n"))


_NORM = """greatest(abs(x - {cx}), abs((x - {cx}) * CAST(0.5 AS DOUBLE) + (y - {cy}) * CAST(0.8660254037844386 AS DOUBLE)),
        abs((x - {cx}) * CAST(-0.5 AS DOUBLE) + (y - {cy}) * CAST(0.8660254037844386 AS DOUBLE))) / CAST(0.8660254037844386 AS DOUBLE)"""


@query(with_views("scans") + f"SELECT depot, avg({_NORM.format(cx='6000', cy='6000')}) AS mean_norm, max({_NORM.format(cx='6000', cy='6000')}) AS max_norm FROM scans GROUP BY depot",
       "mean_norm max_norm", 4)
def hex_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = geo.hex_norm("x", "y", F.lit(6000.0), F.lit(6000.0))
    return fx.scans(spark, sf_dir).groupBy("depot").agg(F.avg(norm).alias("mean_norm"), F.max(norm).alias("max_norm"))


def _envelope_sql(keys: str) -> dict[str, str]:
    """Views mean0 .. env of the envelope of each group."""
    return {
        "mean0": f"SELECT {keys}, avg(x) AS x, avg(y) AS y FROM wd GROUP BY {keys}",
        "mean1": hex_sql("mean0", 1000.0),
        "mean2": f"""SELECT {keys}, CAST(1000 AS DOUBLE) * CAST(1.7320508075688772 AS DOUBLE) * (q + r / CAST(2 AS DOUBLE)) AS ex,
            CAST(1500 AS DOUBLE) * r AS ey FROM mean1""",
        "env": f"""SELECT {keys}, ex, ey, least(greatest(max(sqrt((x-ex)*(x-ex)+(y-ey)*(y-ey)) * CAST(1.1547005383792517 AS DOUBLE)), 750), 2000) AS side
            FROM wd JOIN mean2 USING ({keys}) GROUP BY {keys}, ex, ey""",
    }


@query(with_views("deliv", more={"wd": WD, **_envelope_sql("depot, cid")}) + "SELECT depot, cid, ex, ey, side FROM env", "ex ey side", 4)
def hex_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return districts.hex_envelope(_weekdays(spark, sf_dir), ("depot", "cid"))


@query(with_views("deliv", more={"wd": WD, **_envelope_sql("depot, cid")}) + f"""SELECT depot,
        100 * avg(CASE WHEN {_NORM.format(cx='ex', cy='ey')} <= side + CAST(1e-9 AS DOUBLE) THEN 0 ELSE 1 END) AS otr FROM wd JOIN env USING (depot, cid) GROUP BY depot""", "otr")
def otr_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return districts.outside_rate(_weekdays(spark, sf_dir), ("depot", "cid"))


@query(with_views("deliv", more={"wd": WD, **_envelope_sql("depot, date, cid")}) + f"""SELECT depot,
        100 * avg(CASE WHEN {_NORM.format(cx='ex', cy='ey')} <= side + CAST(1e-9 AS DOUBLE) THEN 0 ELSE 1 END) AS otr FROM wd JOIN env USING (depot, date, cid) GROUP BY depot""", "otr")
def otr_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return districts.outside_rate(_weekdays(spark, sf_dir), ("depot", "date", "cid"))


@query(with_views("scans") + """SELECT DISTINCT date, CAST(month(date) AS INTEGER) AS m, CAST(isodow(date) - 1 AS INTEGER) AS dow,
        CAST(weekofyear(date) AS INTEGER) AS week, strftime(date, '%Y-%m-%d') AS text FROM scans""")
def calendar_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.scans(spark, sf_dir).select(F.to_date("t").alias("date")).distinct().select(
        "date", F.month("date").alias("m"), F.weekday("date").alias("dow"), F.weekofyear("date").alias("week"),
        F.substring(F.col("date").cast("string"), 1, 10).alias("text"))


WAYS = [
    ("motorway", "130", None, None), ("motorway_link", None, "yes", None), ("primary", "50 mph", "no", None), ("residential", "walk", None, None),
    ("residential", None, "-1", None), ("service", "", "1", None), ("tertiary", "40", "true", "roundabout"), ("trunk", None, None, "circular"),
    ("living_street", "7", None, "other"), ("road", None, "reversible", None), ("secondary", "RO:urban", None, None),
]
_WAYS_SQL = "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in w) + ")" for w in WAYS) + ") w(highway, maxspeed, oneway, junction)"
_SPEED_SQL = "CASE highway " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in roads.CLASS_SPEED.items()) + " END"


def _ways(spark):
    return spark.createDataFrame(WAYS, "highway string, maxspeed string, oneway string, junction string")


@query(f"""SELECT highway, maxspeed, CAST(coalesce(TRY_CAST(nullif(regexp_extract(coalesce(maxspeed, ''), '^(\\d+)', 1), '') AS DOUBLE), {_SPEED_SQL}) AS DOUBLE) AS speed
        FROM {_WAYS_SQL}""")
def edge_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ways(spark).select("highway", "maxspeed", roads.edge_speed(F.col("highway"), F.col("maxspeed")).alias("speed"))


@query(f"""SELECT highway, oneway, junction, coalesce(oneway, 'no') <> '-1' AS fwd, CASE WHEN oneway = '-1' THEN true
        ELSE NOT (coalesce(oneway, 'no') IN ('yes', '1', 'true') OR coalesce(junction, '') IN ('roundabout', 'circular') OR highway = 'motorway') END AS bwd FROM {_WAYS_SQL}""")
def edge_oneway(spark: SparkSession, sf_dir: str) -> DataFrame:
    fwd, bwd = roads.directions(F.col("highway"), F.col("oneway"), F.col("junction"))
    return _ways(spark).select("highway", "oneway", "junction", fwd.alias("fwd"), bwd.alias("bwd"))


@query(with_views("deliv", more={"days": DAYS}) + "SELECT depot, m, avg(V) AS mean_v, greatest(2, CAST(round_even(avg(V) / 10, 0) AS INTEGER)) AS K FROM days GROUP BY depot, m", "mean_v")
def roster_K(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feas.rosters(fx.deliv(spark, sf_dir), TARGET)


@query(with_views("deliv") + "SELECT depot, date, count(*) AS V, count(DISTINCT cid) AS k_obs, min(m) AS m, min(dow) AS dow FROM deliv GROUP BY depot, date")
def depot_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stability.depot_day(fx.deliv(spark, sf_dir))


@query(with_views("deliv", more={"days": "SELECT depot, date, min(dow) AS dow, count(*) AS V, count(DISTINCT cid) AS k FROM deliv GROUP BY ALL"}) +
       """SELECT depot, dow < 5 AS weekday, count(*) AS days, CAST(median(V) AS DOUBLE) AS V, CAST(median(k) AS DOUBLE) AS k, count(*) FILTER (dow = 6) AS sundays
        FROM days GROUP BY depot, dow < 5""")
def depot_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stability.depot_profile(fx.deliv(spark, sf_dir))


@query(with_views("deliv") + "SELECT depot, cid, date, median(x) AS x, median(y) AS y FROM deliv WHERE dow < 5 GROUP BY ALL", "x y")
def courier_day_loc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stability.courier_day_location(_weekdays(spark, sf_dir))


_DISP = {
    "loc": "SELECT depot, cid, date, median(x) AS x, median(y) AS y FROM deliv WHERE dow < 5 GROUP BY ALL",
    "disp": """SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS disp FROM loc
        WINDOW w AS (PARTITION BY depot, cid ORDER BY date)""",
}


@query(with_views("deliv", more=_DISP) + """SELECT depot, median(disp) AS drift_med, quantile_cont(disp, 0.75) AS drift_p75,
        100 * avg(CASE WHEN disp > 2000 THEN 1 ELSE 0 END) AS drift_gt2km FROM disp GROUP BY depot""", "drift_med drift_p75 drift_gt2km")
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stability.drift(_weekdays(spark, sf_dir))


_PER = {"per": "SELECT depot, m, bu, cid, count(*) AS n FROM deliv WHERE dow < 5 GROUP BY ALL"}


@query(with_views("deliv", more=_PER) + """SELECT depot, 100 * avg(p) AS purity FROM (SELECT depot, m, sum(top) / sum(n) AS p FROM
        (SELECT depot, m, bu, max(n) AS top, sum(n) AS n FROM per GROUP BY ALL) GROUP BY depot, m) GROUP BY depot""", "purity")
def bu_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stability.bu_purity(_weekdays(spark, sf_dir))


_MODE = _PER | {"mode": "SELECT depot, m, bu, min({a: -n, b: cid}).b AS mode_cid FROM per GROUP BY depot, m, bu"}


@query(with_views("deliv", more=_MODE) + "SELECT * FROM mode")
def bu_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stability.bu_mode(_weekdays(spark, sf_dir))


@query(with_views("deliv", more=_MODE) + """SELECT depot, 100 * avg(s) AS prev_month_mode_share FROM (
        SELECT d.depot, d.m, avg(CASE WHEN d.cid = p.mode_cid THEN 1 ELSE 0 END) AS s FROM deliv d JOIN mode p
        ON d.depot = p.depot AND d.m = p.m + 1 AND d.bu = p.bu WHERE d.dow < 5 GROUP BY d.depot, d.m) GROUP BY depot""", "prev_month_mode_share")
def mode_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stability.mode_share(_weekdays(spark, sf_dir))


@query(with_views("deliv", more={
    "days": "SELECT DISTINCT depot, date FROM deliv WHERE dow < 5",
    "every": "SELECT u.depot, u.bu, d.date FROM (SELECT DISTINCT depot, bu FROM deliv WHERE dow < 5) u JOIN days d ON u.depot = d.depot",
    "daily": "SELECT depot, bu, date, count(*) AS n FROM deliv WHERE dow < 5 GROUP BY ALL",
    "unit": """SELECT e.depot, e.bu, avg(coalesce(n, 0)) AS mu, stddev_samp(coalesce(n, 0)) AS sd FROM every e
        LEFT JOIN daily d ON e.depot = d.depot AND e.bu = d.bu AND e.date = d.date GROUP BY e.depot, e.bu"""})
    + "SELECT depot, median(sd / mu) AS bu_cv_med FROM unit WHERE mu >= CAST(0.05 AS DOUBLE) GROUP BY depot", "bu_cv_med")
def bu_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stability.bu_cv(_weekdays(spark, sf_dir), least=0.05)


@query(with_views("deliv", more={"per": "SELECT depot, date, cid, count(*) AS w FROM deliv WHERE dow < 5 GROUP BY ALL",
                                 "day": "SELECT depot, date, stddev_samp(w) / avg(w) AS cv FROM per GROUP BY ALL"}) +
       "SELECT p.depot, p.w_med, d.w_cv FROM (SELECT depot, CAST(median(w) AS DOUBLE) AS w_med FROM per GROUP BY depot) p JOIN (SELECT depot, median(cv) AS w_cv FROM day GROUP BY depot) d ON p.depot = d.depot", "w_cv")
def workload_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stability.workload(_weekdays(spark, sf_dir))


_FEAS = {
    "days": DAYS,
    "prior": "SELECT depot, m + 1 AS m, greatest(2, CAST(round_even(avg(V) / 10, 0) AS INTEGER)) AS K_month FROM days GROUP BY depot, m",
    "feas": """SELECT d.depot, d.date, d.m AS month, V, K_month, k_obs AS k_observed, V >= 8.5 * K_month AND V <= 11.5 * K_month AS feasible_monthly,
        V < 8.5 * K_month AS under_load, V > 11.5 * K_month AS over_load, V >= 8.5 * k_obs AND V <= 11.5 * k_obs AS feasible_observed,
        (V >= 8.5 * greatest(1, floor(V / 10)) AND V <= 11.5 * greatest(1, floor(V / 10)))
        OR (V >= 8.5 * greatest(1, ceil(V / 10)) AND V <= 11.5 * greatest(1, ceil(V / 10))) AS feasible_daily_roster
        FROM days d JOIN prior p ON d.depot = p.depot AND d.m = p.m""",
}


def _feasible(spark, sf_dir):
    return feas.feasibility(fx.deliv(spark, sf_dir), TARGET, 8.5, 11.5)


@query(with_views("deliv", more=_FEAS) + "SELECT * FROM feas")
def feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feasible(spark, sf_dir)


_PCT = ", ".join(f"100 * avg(CAST({c} AS INTEGER)) AS {c}" for c in feas.PERCENT)


@query(with_views("deliv", more=_FEAS) + f"SELECT coalesce(depot, 'All') AS depot, count(*) AS test_days, {_PCT} FROM feas GROUP BY ROLLUP (depot)", " ".join(feas.PERCENT))
def feasibility_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feas.feasibility_summary(_feasible(spark, sf_dir))


@query(with_views("units") + """SELECT depot, date, CAST(sum(n) AS BIGINT) AS V, max(n) AS max_bu, max(n) / (sum(n) / CAST(20 AS DOUBLE) * CAST(8 AS DOUBLE) / 7) AS max_bu_over_hi,
        max(n) > sum(n) / CAST(20 AS DOUBLE) * CAST(8 AS DOUBLE) / 7 AS infeasible FROM units GROUP BY depot, date""", "max_bu_over_hi")
def infeasible_cert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feas.infeasible_certificate(_weekdays(spark, sf_dir), 20)


@query(with_views("deliv") + """SELECT d.depot, d.m, bu, count(*) / CAST(max(days) AS DOUBLE) AS w FROM deliv d JOIN
        (SELECT depot, m, count(DISTINCT date) AS days FROM deliv WHERE dow < 5 GROUP BY ALL) n ON d.depot = n.depot AND d.m = n.m WHERE dow < 5 GROUP BY d.depot, d.m, bu""", "w")
def bu_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return districts.bu_demand(_weekdays(spark, sf_dir))


_UNION = {"u": "SELECT depot, m AS train, bu FROM deliv WHERE dow < 5 UNION SELECT depot, m - 1, bu FROM deliv WHERE dow < 5 AND m > 1"}


@query(with_views("deliv", more=_UNION) + "SELECT * FROM u")
def bu_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return districts.bu_union(_weekdays(spark, sf_dir))


@query(with_views("deliv", more=_UNION) + "SELECT *, CAST(row_number() OVER (PARTITION BY depot, train ORDER BY bu) - 1 AS INTEGER) AS pos FROM u")
def bu_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return districts.bu_position(districts.bu_union(_weekdays(spark, sf_dir)))


_LOADS = {"loads": f"""SELECT e.depot, e.date, e.design, e.k, CAST(coalesce(l.load, 0) AS BIGINT) AS load FROM
        (SELECT *, unnest(generate_series(0, {K - 1})) AS k FROM (SELECT DISTINCT depot, date, design FROM assign WHERE design <> 'OPR')) e
        LEFT JOIN (SELECT depot, date, design, k, sum(n) AS load FROM assign GROUP BY ALL) l
        ON e.depot = l.depot AND e.date = l.date AND e.design = l.design AND e.k = l.k"""}


def _plans(spark, sf_dir):
    return fx.assign(spark, sf_dir).filter("design <> 'OPR'")


def _loads(spark, sf_dir):
    return districts.district_load(_plans(spark, sf_dir), K)


@query(with_views("assign", more=_LOADS) + "SELECT * FROM loads")
def district_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loads(spark, sf_dir)


_MU = _LOADS | {"dev": "SELECT *, avg(load) OVER (PARTITION BY depot, date, design) AS mu FROM loads"}


@query(with_views("assign", more=_MU) + """SELECT depot, date, design, max(abs(load - mu)) / max(mu) AS plan_maxdev,
        avg(CAST(abs(load - mu) <= mu * CAST(0.05 AS DOUBLE) + CAST(1e-9 AS DOUBLE) AS INTEGER)) AS plan_share_in5,
        avg(CAST(abs(load - mu) <= mu / 7 + CAST(1e-9 AS DOUBLE) AS INTEGER)) AS plan_share_in14 FROM dev GROUP BY ALL""", "plan_maxdev plan_share_in5 plan_share_in14")
def plan_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return districts.plan_balance(_loads(spark, sf_dir))


_BAND = "CAST(load BETWEEN mu * (1 - CAST(1 AS DOUBLE) / 7) - CAST(1e-6 AS DOUBLE) AND mu * (1 + CAST(1 AS DOUBLE) / 7) + CAST(1e-6 AS DOUBLE) AS INTEGER)"


@query(with_views("assign", more=_MU) + f"""SELECT depot, date, design, stddev_pop(load) / avg(load) AS cv, avg({_BAND}) AS inband,
        avg(CAST(load BETWEEN mu * CAST(0.95 AS DOUBLE) AND mu * CAST(1.05 AS DOUBLE) AS INTEGER)) AS in5, avg(CAST(load BETWEEN 6 AND 8 AS INTEGER)) AS inband_abs,
        max(abs(load - mu)) / max(mu) AS maxdev FROM dev GROUP BY ALL""", "cv inband in5 inband_abs maxdev")
def district_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return districts.district_metrics(_loads(spark, sf_dir), low=6.0, high=8.0)


@query(with_views("assign", more=_MU) + f"SELECT depot, date, design, avg({_BAND}) AS inband FROM dev GROUP BY ALL", "inband")
def inband_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _loads(spark, sf_dir).filter("load > 0")
    return districts.inband_recompute(stored, K)


_PARCELS = {"p": "SELECT d.*, a.design, a.k FROM deliv d JOIN assign a ON d.depot = a.depot AND d.date = a.date AND d.bu = a.bu WHERE d.dow < 5 AND a.design <> 'OPR'"}


def _parcels(spark, sf_dir):
    return districts.parcels_by_district(_weekdays(spark, sf_dir), _plans(spark, sf_dir))


@query(with_views("assign", more=_PARCELS) + """SELECT depot, date, design, avg(c) AS comp_m FROM (SELECT p.depot, p.date, p.design, p.k, avg(sqrt(power(x - mx, 2) + power(y - my, 2))) AS c
        FROM p JOIN (SELECT depot, date, design, k, median(x) AS mx, median(y) AS my FROM p GROUP BY ALL) m USING (depot, date, design, k) GROUP BY ALL) GROUP BY ALL""", "comp_m")
def compactness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return districts.compactness(_parcels(spark, sf_dir))


@query(with_views("assign", more=_PARCELS) + "SELECT depot, date, design, k, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY ALL", "cx cy")
def district_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return districts.district_centroids(_parcels(spark, sf_dir))


_CONT = {"seen": "SELECT *, lag(k) OVER (PARTITION BY depot, m, design, bu ORDER BY date) AS before FROM assign WHERE design <> 'OPR'"}


@query(with_views("assign", more=_CONT) + """SELECT depot, date, design, sum(CASE WHEN before = k THEN n ELSE 0 END) FILTER (before IS NOT NULL) / CAST(sum(n) FILTER (before IS NOT NULL) AS DOUBLE) AS cont
        FROM seen GROUP BY ALL""", "cont")
def continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return districts.continuity(_plans(spark, sf_dir))


_OPR = {
    "own": "SELECT * FROM assign WHERE design = 'OPR'",
    "prev": "SELECT *, lag(last) OVER (PARTITION BY depot, m, bu ORDER BY date) AS before FROM (SELECT depot, m, date, bu, max(k) AS last FROM own GROUP BY ALL)",
}


@query(with_views("assign", more=_OPR) + """SELECT o.depot, o.date, sum(CASE WHEN before = k THEN n ELSE 0 END) FILTER (before IS NOT NULL) / CAST(sum(n) FILTER (before IS NOT NULL) AS DOUBLE) AS cont
        FROM own o JOIN prev p ON o.depot = p.depot AND o.date = p.date AND o.bu = p.bu GROUP BY o.depot, o.date""", "cont")
def continuity_opr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return districts.continuity_couriers(fx.assign(spark, sf_dir).filter("design = 'OPR'"))


@query(with_views("assign") + """SELECT a.depot, a.date, a.design, sum(CASE WHEN a.k <> f.k THEN a.n ELSE 0 END) / CAST(sum(a.n) AS DOUBLE) AS moved_share FROM assign a JOIN assign f
        ON a.depot = f.depot AND a.date = f.date AND a.bu = f.bu AND f.design = 'FIX' WHERE a.design <> 'OPR' GROUP BY ALL""", "moved_share")
def moved_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return districts.moved_share(_plans(spark, sf_dir))


_DEPOTS = [(f"Depot0{i}", 1500.0 * i, 2000.0 * i) for i in range(1, 5)]


@query(with_views("assign", "metrics", more=_PARCELS | {
    "cent": "SELECT depot, date, design, k, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY ALL",
    "stem": """SELECT depot, date, design, 2 * sum(sqrt(power(cx - 1500 * CAST(right(depot, 1) AS INTEGER), 2) + power(cy - 2000 * CAST(right(depot, 1) AS INTEGER), 2))) / 1000 AS stem_km
        FROM cent GROUP BY ALL"""}) + "SELECT m.depot, m.date, m.design, m.tour_km, s.stem_km, m.tour_km + s.stem_km AS total_km FROM metrics m LEFT JOIN stem s ON m.depot = s.depot AND m.date = s.date AND m.design = s.design", "tour_km stem_km total_km", 9)
def stem_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    depots = spark.createDataFrame(_DEPOTS, "depot string, px double, py double")
    cent = districts.district_centroids(_parcels(spark, sf_dir))
    return districts.stem_total(fx.metrics(spark, sf_dir).select("depot", "date", "design", "tour_km"), cent, depots)


_CENT = {"cent": "SELECT depot, k, avg(x) AS cx, avg(y) AS cy FROM (SELECT *, ((cid % 7) + 7) % 7 AS k FROM deliv WHERE dow < 5) GROUP BY ALL"}


@query(with_views("deliv", more=_CENT) + """SELECT d.depot, d.bu, d.x, d.y, min({a: (d.x - cx) * (d.x - cx) + (d.y - cy) * (d.y - cy), b: k}).b AS k
        FROM (SELECT depot, bu, avg(x) AS x, avg(y) AS y FROM deliv WHERE dow < 5 GROUP BY ALL) d JOIN cent c ON d.depot = c.depot GROUP BY ALL""", "x y")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _weekdays(spark, sf_dir)
    cent = d.withColumn("k", F.pmod("cid", F.lit(7))).groupBy("depot", "k").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return districts.nearest_centroid(d.groupBy("depot", "bu").agg(F.avg("x").alias("x"), F.avg("y").alias("y")), cent)


@query(with_views("assign", more=_PARCELS | {"w": "SELECT depot, design, k, bu, count(*) AS w, avg(x) AS x, avg(y) AS y FROM p GROUP BY ALL"}) +
       "SELECT depot, design, k, sum(w * x) / sum(w) AS cx, sum(w * y) / sum(w) AS cy FROM w GROUP BY ALL", "cx cy")
def weighted_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _parcels(spark, sf_dir).groupBy("depot", "design", "k", "bu").agg(F.count(F.lit(1)).alias("w"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    return districts.weighted_centroid(units)


@query(with_views("deliv", more={"u": "SELECT DISTINCT depot, bu, q, r FROM deliv"}) + """SELECT a.depot, a.bu, b.bu AS neighbor FROM u a JOIN u b ON a.depot = b.depot
        AND greatest(abs(a.q - b.q), abs(a.r - b.r), abs(a.q + a.r - b.q - b.r)) = 1""")
def hex_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return districts.hex_neighbors(fx.deliv(spark, sf_dir).select("depot", "bu", "q", "r").distinct())


@query(with_views("scans") + "SELECT min(lon) - CAST(0.03 AS DOUBLE) AS west, max(lon) + CAST(0.03 AS DOUBLE) AS east, min(lat) - CAST(0.02 AS DOUBLE) AS south, max(lat) + CAST(0.02 AS DOUBLE) AS north FROM scans",
       "west east south north")
def bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.scans(spark, sf_dir).agg(
        (F.min("lon") - 0.03).alias("west"), (F.max("lon") + 0.03).alias("east"), (F.min("lat") - 0.02).alias("south"), (F.max("lat") + 0.02).alias("north"))


@query(with_views("deliv") + "SELECT depot, bu, avg(x) AS x, avg(y) AS y FROM deliv WHERE dow < 5 GROUP BY ALL", "x y")
def bu_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weekdays(spark, sf_dir).groupBy("depot", "bu").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


@query(with_views("seq") + """SELECT depot, date, cid, count(*) AS n, coalesce(sum(step), 0) / 1000 AS actual_km FROM (
        SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS step FROM seq WINDOW w AS (PARTITION BY depot, date, cid ORDER BY t, event_id)) GROUP BY ALL""", "actual_km")
def scan_path_km(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stability.path_length(fx.seq(spark, sf_dir))


@query(with_views("seq", more={"hexed": hex_sql("seq", 2500.0)}) + """SELECT depot, date, cid, count(*) AS visits, count(DISTINCT bu) AS stops, count(*) - count(DISTINCT bu) AS revisits FROM (
        SELECT *, lag(bu) OVER (PARTITION BY depot, date, cid ORDER BY t, event_id) AS before FROM hexed) WHERE before IS NULL OR before <> bu GROUP BY ALL""")
def revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r = geo.hex_axial("x", "y", 2500.0)
    return stability.revisits(fx.seq(spark, sf_dir).withColumn("bu", geo.bu_key(q, r)))


@query(with_views("seq") + "SELECT depot, date, cid, (epoch_us(max(t)) - epoch_us(min(t))) / CAST(60e6 AS DOUBLE) AS span_min FROM seq GROUP BY ALL", "span_min", 9)
def scan_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stability.scan_span(fx.seq(spark, sf_dir))


@query(with_views("deliv") + """SELECT depot, date, cid, n FROM (SELECT *, row_number() OVER (PARTITION BY depot ORDER BY md5('7|' || depot || '|' || CAST(date AS VARCHAR) || '|' || cid)) AS rank
        FROM (SELECT depot, date, cid, count(*) AS n FROM deliv WHERE dow < 5 GROUP BY ALL HAVING count(*) >= 3)) WHERE rank <= 150""")
def courier_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stability.sampled_courier_days(_weekdays(spark, sf_dir), 150, 3)
