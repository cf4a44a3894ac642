"""OpenStreetMap extracts (.osm.pbf) as tables of nodes and ways.

A PBF file is a row of blobs: a length, a header that names the kind and size, the blob itself.
The driver reads only the headers; blobs are decoded where they are read, several to a task.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulgrid.functions import roads

NODES = "node bigint, lon double, lat double"
WAYS = "way bigint, refs array<bigint>, tags map<string,string>"


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of a protocol buffer message."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        number, kind = key >> 3, key & 7
        if kind == 0:
            yield number, kind, varint()
        elif kind == 2:
            size = varint()
            yield number, kind, data[at:at + size]
            at += size
        else:
            size = 8 if kind == 1 else 4
            yield number, kind, data[at:at + size]
            at += size


def packed(data: bytes, signed: bool = False) -> list[int]:
    """Varints of a packed field, zigzag-decoded where signed."""
    out, value, shift = [], 0, 0
    for byte in data:
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            out.append((value >> 1) ^ -(value & 1) if signed else value)
            value = shift = 0
    return out


def blobs(read, size: int) -> Iterator[tuple[str, int, int]]:
    """(kind, offset, length) of each blob; ``read(offset, n)`` gives bytes of the file."""
    at = 0
    while at < size:
        head_size = struct.unpack(">I", read(at, 4))[0]
        kind, length = "", 0
        for number, _, value in fields(read(at + 4, head_size)):
            if number == 1:
                kind = value.decode()
            elif number == 3:
                length = value
        at += 4 + head_size
        yield kind, at, length
        at += length


def unpack(blob: bytes) -> bytes:
    for number, _, value in fields(blob):
        if number == 1:
            return value
        if number == 3:
            return zlib.decompress(value)
    raise ValueError("the blob is packed in an unknown way")


def _running(values: list[int]) -> list[int]:
    out, total = [], 0
    for v in values:
        total += v
        out.append(total)
    return out


def decode(block: bytes) -> tuple[list[tuple], list[tuple]]:
    """Nodes (id, lon, lat) and ways (id, refs, tags) of a primitive block."""
    strings, groups, grain, lat0, lon0 = [], [], 100, 0, 0
    for number, _, value in fields(block):
        if number == 1:
            strings = [v.decode("utf-8", "replace") for n, _, v in fields(value) if n == 1]
        elif number == 2:
            groups.append(value)
        elif number == 17:
            grain = value
        elif number == 19:
            lat0 = value - (1 << 64) if value >> 63 else value
        elif number == 20:
            lon0 = value - (1 << 64) if value >> 63 else value
    nodes, ways = [], []
    for group in groups:
        for number, _, value in fields(group):
            if number == 2:
                dense = {n: packed(v, True) for n, _, v in fields(value) if n in (1, 8, 9)}
                for i, la, lo in zip(*(_running(dense.get(n, [])) for n in (1, 8, 9)), strict=True):
                    nodes.append((i, (lon0 + grain * lo) * 1e-9, (lat0 + grain * la) * 1e-9))
            elif number == 1:
                one = {n: v for n, _, v in fields(value)}
                i, la, lo = ((one[n] >> 1) ^ -(one[n] & 1) for n in (1, 8, 9))
                nodes.append((i, (lon0 + grain * lo) * 1e-9, (lat0 + grain * la) * 1e-9))
            elif number == 3:
                one = {n: v for n, _, v in fields(value)}
                keys, values = packed(one.get(2, b"")), packed(one.get(3, b""))
                tags = {strings[k]: strings[v] for k, v in zip(keys, values, strict=True)}
                ways.append((one[1], _running(packed(one.get(8, b""), True)), tags))
    return nodes, ways


def open_input(path: str) -> pa.NativeFile:
    store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(name)


def read_pbf(spark: SparkSession, path: str, per_task: int = 64) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways) of an extract: a path that all executors can open, or a URI of a store that
    Arrow's file systems know (s3, gs, hdfs, file)."""
    with open_input(path) as file:
        end = file.size()

        def read(at: int, n: int) -> bytes:
            file.seek(at)
            return file.read(n)

        parts = [(path, at, n) for kind, at, n in blobs(read, end) if kind == "OSMData"]
    todo = spark.createDataFrame(parts, "path string, at bigint, n bigint").repartition(max(1, -(-len(parts) // per_task)))

    def load(want: str):
        def run(batches):
            for b in batches:
                for name, at, n in zip(*(b.column(c).to_pylist() for c in ("path", "at", "n")), strict=True):
                    with open_input(name) as file:
                        file.seek(at)
                        nodes, ways = decode(unpack(file.read(n)))
                    if want == "nodes" and nodes:
                        i, lon, lat = zip(*nodes, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(lon), pa.array(lat)], ["node", "lon", "lat"])
                    elif want == "ways" and ways:
                        i, refs, tags = zip(*ways, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(i, pa.int64()), pa.array(refs, pa.list_(pa.int64())), pa.array([list(t.items()) for t in tags], pa.map_(pa.string(), pa.string()))],
                            ["way", "refs", "tags"])

        return run

    return todo.mapInArrow(load("nodes"), NODES), todo.mapInArrow(load("ways"), WAYS)


def drivable_ways(ways: DataFrame, nodes: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(way, refs, speed, fwd, bwd) of roads one may drive that touch the box (west, east,
    south, north); ways with a node whose place is unknown are left out."""
    tag = F.col("tags")
    fwd, bwd = roads.directions(tag["highway"], tag["oneway"], tag["junction"])
    kept = ways.filter(roads.drivable(tag["highway"], tag["access"], tag["motor_vehicle"], tag["area"]))
    places = kept.select("way", F.explode("refs").alias("node")).join(nodes, "node", "left")
    inside = F.lit(True) if box is None else F.col("lon").between(box[0], box[1]) & F.col("lat").between(box[2], box[3])
    good = places.groupBy("way").agg(F.max(F.coalesce(inside, F.lit(False))).alias("touch"), F.min(F.col("lon").isNotNull()).alias("known"))
    return kept.join(good.filter("touch AND known"), "way", "left_semi").select(
        "way", "refs", roads.edge_speed(tag["highway"], tag["maxspeed"]).alias("speed"), fwd.alias("fwd"), bwd.alias("bwd"))
