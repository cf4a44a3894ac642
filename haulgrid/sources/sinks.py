"""Sinks: partitioned Parquet for tables that later steps read, CSV for export."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_parcels(d: DataFrame, path: str) -> None:
    """Parcels by depot and month, sorted within files for column statistics that prune."""
    d.repartition("depot", "m").sortWithinPartitions("date", "cid", "t").write.mode("overwrite").partitionBy("depot", "m").parquet(path)


def write_table(df: DataFrame, path: str, *partition: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition).parquet(path)


def write_network(nodes: DataFrame, edges: DataFrame, od: DataFrame | None, folder: str) -> None:
    """A road network as tables nodes, edges and, where given, od below a folder."""
    write_table(nodes, f"{folder}/nodes")
    write_table(edges, f"{folder}/edges")
    if od is not None:
        write_table(od, f"{folder}/od", "depot")


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    writer = df.write.mode("overwrite").option("header", True)
    (writer.option("compression", "gzip") if gzip else writer).csv(path)
