import gzip
import lzma
import struct
import zlib

import pytest

from haulgrid.sources import bu_loads, osm, readers, sinks
from haulgrid.streaming import volumes

EVENTS = "ShipmentItemBarcode,EventDatetime,FacilityCode,UserID,EventGeoX,EventGeoY\nb1,2025-03-01 08:00:00,007,12.0,15.98,45.81\nb2,2025-03-02 09:30:00,x,5,16.0,45.8\n"


def test_events_from_gzipped_csv_to_parcels_and_back(spark, tmp_path):
    with gzip.open(tmp_path / "scans.csv.gz", "wt") as f:
        f.write(EVENTS)
    got = readers.read_events(spark, str(tmp_path / "scans.csv.gz"))
    rows = {r.ShipmentItemBarcode: r for r in got.collect()}
    assert rows["b1"].FacilityCode == "007" and rows["b1"].m == 3 and rows["b1"].EventGeoX == 15.98
    pairs = [("007", "Depot01"), ("b", "Depot02"), ("c", "Depot03"), ("d", "Depot04"), ("x", "Elsewhere")]
    mapped = readers.check_facility_map(spark.createDataFrame(pairs, "FacilityCode string, depot string"))
    one = readers.enrich(got, mapped).collect()
    assert len(one) == 1 and one[0].depot == "Depot01" and one[0].cid == 12 and one[0].dow == 5 and one[0].bu == f"{one[0].q}_{one[0].r}"
    sinks.write_parcels(readers.enrich(got, mapped), str(tmp_path / "parcels"))
    assert spark.read.parquet(str(tmp_path / "parcels")).filter("depot = 'Depot01' AND m = 3").count() == 1
    sinks.write_csv(got, str(tmp_path / "out"), gzip=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    sinks.write_table(got, str(tmp_path / "t"), "FacilityCode")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_input_contracts(spark, tmp_path, monkeypatch):
    with pytest.raises(ValueError):
        readers.check_facility_map(spark.createDataFrame([("a", "Depot01")], "FacilityCode string, depot string"))
    with pytest.raises(ValueError):
        readers.check_facility_map(spark.createDataFrame([("a",)], "FacilityCode string"))
    (tmp_path / "d.csv").write_text("depot,lat,lon\n" + "".join(f"Depot0{i},45.8,16.{i}\n" for i in range(1, 5)))
    monkeypatch.setenv("DEPOT_COORDS_FILE", str(tmp_path / "d.csv"))
    assert readers.read_depots(spark).count() == 4
    with pytest.raises(ValueError):
        readers.check_depots(spark.createDataFrame([("Depot01", 1.0, 2.0)], "depot string, lat double, lon double"))
    (tmp_path / "s.csv").write_text(EVENTS.replace("EventGeoY", "EventGeoY,UserFirstName").replace("45.81", "45.81,Ann").replace("45.8\n", "45.8,Bob\n"))
    got = readers.read_identity_sample(spark, str(tmp_path / "s.csv"))
    assert "UserFirstName" not in got.columns and got.filter("x IS NOT NULL").count() == 2


def test_results_by_variant(spark, tmp_path):
    spark.createDataFrame([(1, "annual"), (2, "base"), (3, "seed1")], "v int, variant string").write.partitionBy("variant").parquet(str(tmp_path / "r"))
    assert sorted(r.v for r in readers.read_results(spark, str(tmp_path / "r")).collect()) == [2, 3]
    assert readers.read_if_all(spark, [str(tmp_path / "r"), str(tmp_path / "none")]) is None
    assert [d.count() for d in readers.read_if_all(spark, [str(tmp_path / "r")])] == [3]


def test_packed_load_text(spark, tmp_path):
    text = "#Depot01;0,0;1,-2\n1:0,5;1,7\n32:1,3\n#Depot02;4,4\n2:0,9\n"
    (tmp_path / "loads.xz").write_bytes(lzma.compress(text.encode()))
    got = {(r.depot, str(r.date), r.bu): (r.n, r.m, r.q, r.r) for r in bu_loads.read_loads(spark, str(tmp_path / "loads.xz")).collect()}
    assert got == {
        ("Depot01", "2025-01-01", "0_0"): (5, 1, 0, 0), ("Depot01", "2025-01-01", "1_-2"): (7, 1, 1, -2),
        ("Depot01", "2025-02-01", "1_-2"): (3, 2, 1, -2), ("Depot02", "2025-01-02", "4_4"): (9, 1, 4, 4)}


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def field(number, value):
    return varint(number << 3 | 0) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def zigzag(values, delta=True):
    out, last = b"", 0
    for v in values:
        d = v - last if delta else v
        out += varint(d << 1 if d >= 0 else (-d << 1) - 1)
        last = v
    return out


def pbf(blocks):
    out = b""
    for kind, data in [("OSMHeader", b""), *(("OSMData", b) for b in blocks)]:
        blob = field(2, len(data)) + field(3, zlib.compress(data))
        head = field(1, kind.encode()) + field(3, len(blob))
        out += struct.pack(">I", len(head)) + head + blob
    return out


def block(nodes, ways):
    words = sorted({w for _, _, tags in ways for pair in tags.items() for w in pair})
    table = field(1, b"".join(field(1, w.encode()) for w in ["", *words]))
    at = {w: i + 1 for i, w in enumerate(words)}
    dense = field(1, zigzag([n for n, _, _ in nodes])) + field(8, zigzag([round(la * 1e7) for _, _, la in nodes])) + field(9, zigzag([round(lo * 1e7) for _, lo, _ in nodes]))
    group = field(2, field(2, dense)) if nodes else b""
    for i, refs, tags in ways:
        way = field(1, i) + field(2, b"".join(varint(at[k]) for k in tags)) + field(3, b"".join(varint(at[v]) for v in tags.values())) + field(8, zigzag(refs))
        group += field(2, field(3, way))
    return table + group


def test_osm_extract(spark, tmp_path):
    nodes = [(10, 15.9, 45.8), (11, 15.901, 45.8), (5, -0.5, -45.1), (12, 20.0, 50.0)]
    ways = [
        (1, [10, 11], {"highway": "primary", "maxspeed": "70"}), (2, [10, 11], {"highway": "footway"}), (3, [11, 99], {"highway": "service"}),
        (4, [5, 12], {"highway": "residential"}), (5, [11, 10, 12], {"highway": "motorway"}), (6, [10, 11], {"highway": "road", "access": "no"})]
    path = tmp_path / "x.osm.pbf"
    path.write_bytes(pbf([block(nodes[:2], []), block(nodes[2:], ways)]))
    n, w = osm.read_pbf(spark, str(path), per_task=1)
    assert sorted((r.node, round(r.lon, 7), round(r.lat, 7)) for r in n.collect()) == sorted(nodes)
    assert {r.way: (list(r.refs), r.tags) for r in w.collect()} == {i: (refs, tags) for i, refs, tags in ways}
    kept = {r.way: r for r in osm.drivable_ways(w, n, (15.8, 16.0, 45.7, 45.9)).collect()}
    assert set(kept) == {1, 5} and kept[1].speed == 70 and kept[1].bwd and kept[5].speed == 110 and not kept[5].bwd
    assert {r.way for r in osm.drivable_ways(w, n).collect()} == {1, 4, 5}


def test_stream_of_volumes(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text(EVENTS)
    (folder / "b.csv").write_text(EVENTS.split("\n")[0] + "\nb9,2025-03-09 08:00:00,007,3,15.98,45.81\n")
    scans = volumes.read_scan_stream(spark, str(folder), files_per_trigger=1)
    for _ in range(2):
        volumes.write_volumes(volumes.facility_day_volumes(scans), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {(str(r.date), r.FacilityCode): r.V for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("2025-03-01", "007"): 1, ("2025-03-02", "x"): 1}
