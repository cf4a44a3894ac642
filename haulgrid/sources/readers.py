"""Typed readers with the input contracts of the delivery data."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulgrid.functions import geo

DEPOTS = ("Depot01", "Depot02", "Depot03", "Depot04")
EVENTS = T.StructType([T.StructField(c, T.StringType()) for c in (
    "ShipmentItemBarcode", "EventDatetime", "FacilityCode", "UserID", "EventGeoX", "EventGeoY")])


def typed_events(raw: DataFrame) -> DataFrame:
    """Text columns to types: codes stay text, coordinates become doubles, t and m are added."""
    t = F.to_timestamp_ntz(F.col("EventDatetime"))
    return raw.select(
        "ShipmentItemBarcode", "FacilityCode", "UserID", F.col("EventGeoX").cast("double").alias("EventGeoX"),
        F.col("EventGeoY").cast("double").alias("EventGeoY"), t.alias("t")).withColumn("m", F.month("t"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Delivery scans from (gzipped) CSV with a fixed schema, so no pass to infer one."""
    return typed_events(spark.read.schema(EVENTS).option("header", True).csv(path))


def _require(df: DataFrame, columns: set[str], what: str) -> None:
    if missing := columns - set(df.columns):
        raise ValueError(f"{what} lacks columns: {', '.join(sorted(missing))}")


def check_facility_map(df: DataFrame) -> DataFrame:
    """Facilities of the four depots; raises unless exactly these are mapped."""
    _require(df, {"FacilityCode", "depot"}, "facility map")
    own = df.filter(F.col("depot").isin(*DEPOTS)).select(F.col("FacilityCode").cast("string"), "depot")
    if own.select("depot").distinct().count() != len(DEPOTS):
        raise ValueError("the facility map must map exactly " + ", ".join(DEPOTS))
    return own


def apply_facility_map(events: DataFrame, mapped: DataFrame) -> DataFrame:
    """Events of mapped facilities; the map has a row per facility of four depots."""
    return events.join(mapped, "FacilityCode")


def check_depots(df: DataFrame) -> DataFrame:
    """Depot coordinates with projected x, y; raises unless exactly the four depots are given."""
    _require(df, {"depot", "lat", "lon"}, "depot file")
    if {r.depot for r in df.select("depot").distinct().limit(len(DEPOTS) + 1).collect()} != set(DEPOTS):
        raise ValueError("the depot file must list exactly " + ", ".join(DEPOTS))
    x, y = geo.project_tm("lon", "lat")
    return df.select("depot", x.alias("x"), y.alias("y"))


def read_depots(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Depot coordinates: the given path, else DEPOT_COORDS_FILE, else depots_private.csv."""
    path = path or os.environ.get("DEPOT_COORDS_FILE") or "depots_private.csv"
    return check_depots(spark.read.schema("depot string, lat double, lon double").option("header", True).csv(path))


def read_identity_sample(spark: SparkSession, path: str) -> DataFrame:
    """A month of identity samples: names dropped, local x and y."""
    raw = spark.read.option("header", True).csv(path).drop("UserFirstName", "UserLastName")
    _require(raw, set(EVENTS.names), "identity sample")
    x, y = geo.local_xy("EventGeoX", "EventGeoY")
    return typed_events(raw).withColumns({"x": x, "y": y, "date": F.to_date("t"), "cid": F.col("UserID").cast("double").cast("bigint")})


def enrich(events: DataFrame, mapped: DataFrame, side: float = 250.0) -> DataFrame:
    """Events to parcels: depot, calendar, projected coordinates, unit."""
    x, y = geo.project_tm("EventGeoX", "EventGeoY")
    d = apply_facility_map(events, mapped).withColumns({"x": x, "y": y, "date": F.to_date("t"), "dow": F.weekday("t"), "cid": F.col("UserID").cast("double").cast("bigint")})
    q, r = geo.hex_axial("x", "y", side)
    return d.withColumns({"q": q, "r": r}).withColumn("bu", geo.bu_key("q", "r")).select(
        "depot", "date", "m", "dow", "t", "cid", "x", "y", "q", "r", "bu", "ShipmentItemBarcode")


def read_results(spark: SparkSession, folder: str, exclude: str = "annual") -> DataFrame:
    """Union of result tables below a folder partitioned by variant, without one variant."""
    return spark.read.parquet(folder).filter(F.col("variant") != exclude)


def read_if_all(spark: SparkSession, paths: list[str]) -> list[DataFrame] | None:
    """Tables at all the paths, or None if one is missing: a block of variants is read only as
    a whole. The stores' own clients look, so any path that Spark reads will do."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        if not where.getFileSystem(conf).exists(where):
            return None
    return [spark.read.parquet(p) for p in paths]


def read_network(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a road network that were written below a folder: nodes, edges and, if there, od."""
    found = {"nodes": f"{folder}/nodes", "edges": f"{folder}/edges"}
    tables = {name: spark.read.parquet(path) for name, path in found.items()}
    od = read_if_all(spark, [f"{folder}/od"])
    return tables | ({"od": od[0]} if od else {})
