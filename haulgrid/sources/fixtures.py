"""Deterministic stand-ins for delivery data over the star-schema tables.

Each view exists twice: as a DataFrame and as a DuckDB common table expression of the same name
in :data:`SQL`, so that queries and their oracles start from equal rows.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulgrid.functions import geo

DEPOTS = ("Depot01", "Depot02", "Depot03", "Depot04")
DESIGNS = ("FIX", "PEN250", "PEN1000", "PEN5000", "DWS", "DCS", "OPR")
K = 5
VARIANTS = {"base": (1.0, 1.0), "uniform25": (1.0, 1.25), "congested": (1.0, 1.75), "seed1": (1.01, 1.0)}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _day() -> Column:
    return F.date_add(F.lit("2025-01-01").cast("date"), ((F.dayofyear("l_shipdate") - 1) % 365).cast("int"))


def _place() -> tuple[Column, Column]:
    x = ((F.col("l_partkey") % 97) * 130 + F.col("l_quantity") * 7).cast("double")
    return x, ((F.col("l_partkey") % 89) * 140 + F.col("l_linenumber") * 11).cast("double")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with depot and a day of 2025."""
    return read(spark, sf_dir, "lineitem").withColumns({
        "depot": F.concat(F.lit("Depot0"), (1 + F.col("l_suppkey") % 4).cast("string")), "date": _day(),
    })


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = lines(spark, sf_dir)
    x, y = _place()
    second = (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11) % 36000
    return li.select(
        "depot", "date", F.month("date").alias("m"), F.weekday("date").alias("dow"),
        (F.col("date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(8), secs=second.cast("decimal(18,6)"))).alias("t"),
        (F.col("l_suppkey") % 25).alias("cid"),
        x.alias("x"), y.alias("y"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("barcode"),
        (F.lit(15.85) + (F.col("l_partkey") % 97) * F.lit(0.003)).alias("lon"),
        (F.lit(45.75) + (F.col("l_partkey") % 89) * F.lit(0.0016)).alias("lat"),
    )


def deliv(spark: SparkSession, sf_dir: str, side: float = 250.0) -> DataFrame:
    """One row per delivered parcel, snapped to its basic unit."""
    q, r = geo.hex_axial("x", "y", side)
    return scans(spark, sf_dir).withColumns({"q": q, "r": r}).withColumn("bu", geo.bu_key("q", "r"))


def parcels(spark: SparkSession, sf_dir: str, side: float, *more: str) -> DataFrame:
    """Weekday rows of :func:`deliv` as :func:`haulgrid.operators.policies.counted` counts them, by unit (and
    by "cid"). Line items are grouped by whole numbers only; names are made of the rows that are left."""
    x, y = _place()
    q, r = geo.hex_axial("x", "y", side)
    by = F.col("l_suppkey") % (100 if more else 4)  # gives both depot and courier
    li = read(spark, sf_dir, "lineitem").select(by.cast("int").alias("by"), _day().alias("date"), x.alias("x"), y.alias("y"))
    few = li.filter(F.weekday("date") < 5).select("by", "date", q.alias("q"), r.alias("r")).groupBy("by", "date", "q", "r").agg(F.count(F.lit(1)).cast("int").alias("n"))
    names = {"cid": (F.col("by") % 25).cast("bigint").alias("cid")}
    return few.select(
        F.concat(F.lit("Depot0"), (1 + F.col("by") % 4).cast("string")).alias("depot"), "date", F.month("date").alias("m"), F.weekday("date").alias("dow"),
        geo.bu_key("q", "r").alias("bu"), *[names[c] for c in more], "n")


def assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """depot, date, design, bu, k, n on weekdays: rule-based districts, couriers for OPR."""
    d = deliv(spark, sf_dir).filter("dow < 5")
    units = d.groupBy("depot", "date", "m", "q", "r", "bu").agg(F.count(F.lit(1)).alias("n"))
    q, r, day = F.col("q"), F.col("r"), F.dayofmonth("date")
    rules = {
        "FIX": q + r,
        "PEN1000": q + r + F.when(day % 3 == 0, 1).otherwise(0),
        "DWS": q + day,
        "DCS": q * 7 + r * 13 + F.dayofyear("date"),
    }
    per = F.array(*[F.struct(F.lit(n).alias("design"), F.pmod(v, F.lit(K)).cast("bigint").alias("k")) for n, v in rules.items()])
    plans = units.select("depot", "date", "m", "bu", "n", F.explode(per).alias("p")).select("depot", "date", "m", "p.design", "bu", "p.k", "n")
    own = d.groupBy("depot", "date", "m", "bu", F.col("cid").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return plans.unionByName(own.withColumn("design", F.lit("OPR")))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per depot, day and design: measures in the shape of the experiment's result rows."""
    li = lines(spark, sf_dir).filter(F.weekday("date") < 5)
    design = F.element_at(F.array(*[F.lit(x) for x in DESIGNS]), F.col("l_linenumber"))
    g = li.filter("l_linenumber <= 7").withColumn("design", design).groupBy("depot", "date", "design").agg(
        (F.avg("l_discount") * 5).alias("inband"), F.avg("l_tax").alias("cv"), F.avg("l_discount").alias("cont"),
        F.sum("l_quantity").alias("road_km"), (F.sum("l_extendedprice") / 1000).alias("road_min"),
        (F.avg("l_extendedprice") / 100).alias("tour_km"), (F.avg("l_extendedprice") / 100 + F.avg("l_quantity")).alias("total_km"),
        F.avg("l_tax").alias("moved_share"), F.count(F.lit(1)).alias("V"))
    return g.withColumn("cont", F.when(F.dayofmonth("date") > 3, F.col("cont"))).withColumn("K", F.lit(K))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """variant, depot, date, design, k, parcels, stops, route_km, route_min, intra_km."""
    li = lines(spark, sf_dir).filter(F.weekday("date") < 5).filter("l_linenumber <= 7")
    design = F.element_at(F.array(*[F.lit(x) for x in DESIGNS]), F.col("l_linenumber"))
    g = li.withColumn("design", design).groupBy("depot", "date", "design", (F.col("l_partkey") % K).alias("k")).agg(
        F.count(F.lit(1)).alias("parcels"), F.countDistinct("l_partkey").alias("stops"), F.sum("l_quantity").alias("route_km"),
        (F.sum("l_extendedprice") / 100).alias("route_min"), (F.sum("l_tax") * 10).alias("intra_km"))
    kinds = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(a).alias("a"), F.lit(b).alias("b")) for v, (a, b) in VARIANTS.items()])
    return g.withColumn("v", F.explode(kinds)).select(
        "v.variant", "depot", "date", "design", "k", "parcels", "stops", (F.col("route_km") * F.col("v.a")).alias("route_km"),
        (F.col("route_min") * F.col("v.b")).alias("route_min"), "intra_km")


_DESIGN = "CASE l_linenumber " + " ".join(f"WHEN {k} THEN '{d}'" for k, d in enumerate(DESIGNS, 1)) + " END"
_VARIANTS = ", ".join(f"('{v}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for v, (a, b) in VARIANTS.items())


def hex_sql(source: str, side: float) -> str:
    """Rows of ``source`` with q, r and bu."""
    s = f"CAST({side} AS DOUBLE)"
    return f"""
        SELECT *, q || '_' || r AS bu FROM (
            SELECT * EXCLUDE (cx, cy, cz, rx, ry, rz),
                   CAST(CASE WHEN abs(rx-cx) > abs(ry-cy) AND abs(rx-cx) > abs(rz-cz) THEN -ry-rz ELSE rx END AS INTEGER) AS q,
                   CAST(CASE WHEN abs(rx-cx) > abs(ry-cy) AND abs(rx-cx) > abs(rz-cz) THEN rz
                             WHEN abs(ry-cy) > abs(rz-cz) THEN rz ELSE -rx-ry END AS INTEGER) AS r
            FROM (SELECT *, round_even(cx, 0) AS rx, round_even(cy, 0) AS ry, round_even(cz, 0) AS rz
                  FROM (SELECT *, -cx - cz AS cy
                        FROM (SELECT *, (CAST(0.5773502691896257 AS DOUBLE) * x - y / CAST(3 AS DOUBLE)) / {s} AS cx,
                                     (CAST(0.6666666666666666 AS DOUBLE) * y) / {s} AS cz FROM {source}))))"""


#: DuckDB text of each view, and the views it needs first.
SQL: dict[str, str] = {
    "lines": """SELECT *, 'Depot0' || (1 + l_suppkey % 4) AS depot,
        DATE '2025-01-01' + CAST((dayofyear(l_shipdate) - 1) % 365 AS INTEGER) AS date FROM lineitem""",
    "scans": """SELECT depot, date, CAST(month(date) AS INTEGER) AS m, CAST(isodow(date) - 1 AS INTEGER) AS dow,
        CAST(date AS TIMESTAMP) + INTERVAL 8 HOUR + to_seconds((l_orderkey * 37 + l_linenumber * 11) % 36000) AS t,
        l_suppkey % 25 AS cid, CAST((l_partkey % 97) * 130 + l_quantity * 7 AS DOUBLE) AS x,
        CAST((l_partkey % 89) * 140 + l_linenumber * 11 AS DOUBLE) AS y, l_orderkey || '-' || l_linenumber AS barcode,
        CAST(15.85 AS DOUBLE) + (l_partkey % 97) * CAST(0.003 AS DOUBLE) AS lon,
        CAST(45.75 AS DOUBLE) + (l_partkey % 89) * CAST(0.0016 AS DOUBLE) AS lat FROM lines""",
    "deliv": hex_sql("scans", 250.0),
    "units": "SELECT depot, date, m, q, r, bu, count(*) AS n FROM deliv WHERE dow < 5 GROUP BY ALL",
    "assign": f"""SELECT depot, date, m, design, bu, ((v % {K}) + {K}) % {K} AS k, n FROM (
            SELECT depot, date, m, bu, n, unnest([
                {{'design': 'FIX', 'v': CAST(q + r AS BIGINT)}}, {{'design': 'PEN1000', 'v': q + r + CASE WHEN day(date) % 3 = 0 THEN 1 ELSE 0 END}},
                {{'design': 'DWS', 'v': q + day(date)}}, {{'design': 'DCS', 'v': q * 7 + r * 13 + dayofyear(date)}}], recursive := true) FROM units)
        UNION ALL SELECT depot, date, m, 'OPR', bu, cid, count(*) FROM deliv WHERE dow < 5 GROUP BY ALL""",
    "metrics": f"""SELECT depot, date, design, inband, cv, CASE WHEN day(date) > 3 THEN disc END AS cont, road_km, road_min, tour_km,
            total_km, cv AS moved_share, V, {K} AS K FROM (
        SELECT depot, date, {_DESIGN} AS design, avg(l_discount) * 5 AS inband, avg(l_tax) AS cv, avg(l_discount) AS disc,
            sum(l_quantity) AS road_km, sum(l_extendedprice) / 1000 AS road_min, avg(l_extendedprice) / 100 AS tour_km,
            avg(l_extendedprice) / 100 + avg(l_quantity) AS total_km, count(*) AS V
        FROM lines WHERE isodow(date) < 6 AND l_linenumber <= 7 GROUP BY ALL)""",
    "routes": f"""SELECT v.variant, depot, date, design, k, parcels, stops, route_km * v.a AS route_km, route_min * v.b AS route_min, intra_km
        FROM (SELECT depot, date, {_DESIGN} AS design, l_partkey % {K} AS k, count(*) AS parcels, count(DISTINCT l_partkey) AS stops,
            sum(l_quantity) AS route_km, sum(l_extendedprice) / 100 AS route_min, sum(l_tax) * 10 AS intra_km
        FROM lines WHERE isodow(date) < 6 AND l_linenumber <= 7 GROUP BY ALL), (VALUES {_VARIANTS}) v(variant, a, b)""",
    "seq": f"""SELECT 'Depot0' || (1 + user_id % 4) AS depot, CAST(ts AS DATE) AS date, user_id AS cid, ts AS t, event_id,
        CAST((event_id % 97) * 130 AS DOUBLE) AS x, (event_id % 89) * 140 + value AS y FROM events""",
}
_NEEDS = {"scans": ["lines"], "deliv": ["scans"], "units": ["deliv"], "assign": ["units", "deliv"], "metrics": ["lines"], "routes": ["lines"]}


def seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan sequences with real times of day."""
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("Depot0"), (1 + F.col("user_id") % 4).cast("string")).alias("depot"), F.col("ts").cast("date").alias("date"),
        F.col("user_id").alias("cid"), F.col("ts").alias("t"), "event_id",
        ((F.col("event_id") % 97) * 130).cast("double").alias("x"), ((F.col("event_id") % 89) * 140 + F.col("value")).alias("y"))


def with_views(*names: str, more: dict[str, str] | None = None) -> str:
    """``WITH`` clause of the named views, of what they need, and of further ones."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    parts = [f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({q})" for n, q in (more or {}).items()]
    return "WITH " + ", ".join(parts) + " "
