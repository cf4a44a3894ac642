"""An extension: depot-day volumes over a stream of scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from haulgrid.sources.readers import EVENTS


def read_scan_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """New CSV files of a folder as a stream of typed scans."""
    raw = spark.readStream.schema(EVENTS).option("header", True).option("maxFilesPerTrigger", files_per_trigger).csv(folder)
    return raw.select("ShipmentItemBarcode", "FacilityCode", "UserID", F.to_timestamp("EventDatetime").alias("t"))


def facility_day_volumes(scans: DataFrame, late: str = "1 day") -> DataFrame:
    """Parcels and (approximate) couriers of each facility and day; state of days older than the
    watermark is dropped, so it is bounded by facilities times days within it."""
    return scans.withWatermark("t", late).groupBy(F.window("t", "1 day"), "FacilityCode").agg(
        F.count(F.lit(1)).alias("V"), F.approx_count_distinct("UserID").alias("k_obs")).select(
        F.to_date("window.start").alias("date"), "FacilityCode", "V", "k_obs")


def write_volumes(volumes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished days as Parquet; exactly once through the checkpoint."""
    return volumes.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
