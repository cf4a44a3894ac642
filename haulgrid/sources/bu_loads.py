"""Unit-day load text: ``#depot;q,r;q,r...`` then ``doy:i,n;i,n...``, possibly LZMA-packed."""

from __future__ import annotations

import lzma

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parse_loads(lines: DataFrame) -> DataFrame:
    """(file, pos, line) to (depot, date, m, q, r, bu, n), in built-in functions.

    A header line applies to the lines after it up to the next header of its file.
    """
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("line").startswith("#"), F.substring("line", 2, 1 << 30))
    tagged = lines.withColumn("head", F.last(head, ignorenulls=True).over(w)).filter(~F.col("line").startswith("#") & (F.trim("line") != ""))
    parts = F.split("head", ";")
    day = F.split("line", ":")
    rows = tagged.select(
        parts[0].alias("depot"), F.slice(parts, 2, F.size(parts) - 1).alias("cells"), day[0].cast("int").alias("doy"),
        F.explode(F.split(day[1], ";")).alias("pair"))
    pair = F.split("pair", ",")
    rows = rows.select("depot", F.date_add(F.lit("2025-01-01").cast("date"), F.col("doy") - 1).alias("date"),
                       F.split(F.get("cells", pair[0].cast("int")), ",").alias("cell"), pair[1].cast("int").alias("n"))
    return rows.select(
        "depot", "date", F.month("date").alias("m"), F.col("cell")[0].cast("int").alias("q"), F.col("cell")[1].cast("int").alias("r"),
        F.concat_ws("_", F.col("cell")[0], F.col("cell")[1]).alias("bu"), "n")


def read_loads(spark: SparkSession, path: str) -> DataFrame:
    """Files of packed load text; each is unpacked line by line in one task, for LZMA cannot be
    split, and everything after that is distributed."""

    def unpack(batches):
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                raw = lzma.decompress(content) if content[:6] == b"\xfd7zXZ\x00" else content
                lines = raw.decode("utf-8").splitlines()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(lines)), pa.array(range(len(lines)), pa.int64()), pa.array(lines, pa.string())], ["file", "pos", "line"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return parse_loads(files.mapInArrow(unpack, "file string, pos bigint, line string"))
