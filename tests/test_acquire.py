"""Acquisition, verification and feeds, all without a network."""

import hashlib
import json
import os
import struct

import pytest

from tramline import __main__ as cli
from tramline.sources import acquire, realtime_feed, verify
from tramline.sources.bundle import BundleError


class Net:
    """Pages by URL; ``breaks`` connections end early first."""

    def __init__(self, pages, breaks=0, lengths=True):
        self.pages, self.breaks, self.lengths, self.asked = pages, breaks, lengths, []

    def __call__(self, url):
        self.asked.append(url)
        if url not in self.pages:
            raise OSError(f"no {url}")
        body = self.pages[url]

        def parts():
            yield body[: len(body) // 2]
            if self.breaks:
                self.breaks -= 1
                raise OSError("the connection ended")
            yield body[len(body) // 2 :]

        return (len(body) if self.lengths else None), parts()


def test_dictionaries(tmp_path):
    asked = {}

    def service(operation, body):
        asked[operation] = body.decode()
        if operation == "SeznamLinky":
            return b"<r xmlns='urn:x'><l Kod='S9'><Nazev> Line </Nazev><PlatnostOd>2031-01-02T00:00:00</PlatnostOd></l><l><Kod>R1</Kod><Znacka>U1</Znacka><Zkratka/></l><other><a>b</a></other></r>"
        if operation == "SeznamSpolecnosti":
            return b"<r><c><Kod>7</Kod><EvCisloEU>3054</EvCisloEU><ObchodNazev/><Nazev>Rail</Nazev></c></r>"
        return b"<r><t KodTAF='12'><Kod>Os</Kod></t></r>" if "Vlaku" in operation else b"<r/>"

    catalog = json.loads(acquire.snapshot_dictionaries(tmp_path, service, "urn:service").read_text())
    assert catalog["lines"] == [
        {"abbreviation": None, "code": "R1", "mark": "U1", "name": "", "valid_from": None, "valid_to": None},
        {"abbreviation": None, "code": "S9", "mark": "S9", "name": "Line", "valid_from": "2031-01-02", "valid_to": None},
    ]
    assert catalog["companies"] == [{"code": "3054", "name": "Rail", "url": None}] and catalog["train_types"] == [{"abbreviation": "12", "code": "12"}] and catalog["ids"] == []
    assert set(asked) == set(acquire.OPERATIONS) and "<jenAktualnePlatne>false" in asked["SeznamSpolecnosti"] and (tmp_path / "SeznamIDS.xml").read_bytes() == b"<r/>"


def test_extracts(tmp_path):
    body = b"map" * 1000
    md5 = hashlib.md5(body).hexdigest()
    url = "https://maps.example/europe/x-latest.osm.pbf"
    pages = {url: body, f"{url}.md5": f"{md5.upper()}  x.pbf".encode()}
    net = Net(pages)
    got = acquire.extract("europe/x", "https://maps.example", tmp_path, net)
    assert got.bytes == len(body) and got.sha256 == hashlib.sha256(body).hexdigest() and net.asked.count(url) == 1
    assert acquire.extract("europe/x", "https://maps.example", tmp_path, net) == got and net.asked.count(url) == 1
    os.utime(got.path, ns=(1, 1))
    again = acquire.extract("europe/x", "https://maps.example", tmp_path, net)
    assert again.mtime_ns == 1 and net.asked.count(url) == 1
    open(got.path, "wb").write(b"bad" * 1000)
    assert acquire.extract("europe/x", "https://maps.example", tmp_path, net).sha256 == got.sha256 and net.asked.count(url) == 2
    acquire.recheck_edition(got, net)
    pages[f"{url}.md5"] = b"0" * 32
    with pytest.raises(acquire.AcquisitionError, match="edition"):
        acquire.recheck_edition(got, net)
    with pytest.raises(acquire.AcquisitionError, match="checksum"):
        acquire.extract("europe/x", "https://maps.example", tmp_path, net)
    assert sorted(os.listdir(tmp_path / "europe--x")) == [f"{md5}.json", f"{md5}.osm.pbf"]
    assert list(acquire.polled(Net({"u": b"a"}), "u", 3, sleep=lambda s: None)) == [b"a"]


def bundle(root, **changes):
    files = {
        "gtfs-intermediate/trips.txt": "route_id,trip_id\nr,t\n",
        "gtfs-intermediate/routes.txt": "route_id\nr\n",
        "gtfs-intermediate/stops.txt": "﻿stop_id,stop_name,stop_lat,stop_lon,location_type,parent_station\nc,N,50,14,,p\np,N,50,14,1,\nz,Z,0,0,,\n",
        "gtfs-intermediate/stop_times.txt": "trip_id,stop_sequence,stop_id\nt,1,c\nt,2,z\n",
        "extensions/cz_routes.txt": "route_id\nr\n",
        "extensions/cz_trips.txt": "trip_id\nt\n",
        "extensions/cz_trip_stop_zones.txt": "trip_id,stop_sequence,zone\nt,2,Z1\n",
        "diagnostics.json": json.dumps({"diagnostics": [{"severity": "warning"}]}),
    } | changes
    entries = []
    for name, text in files.items():
        if text is None:
            continue
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
        entries.append({"path": name, "bytes": path.stat().st_size, "sha256": hashlib.sha256(path.read_bytes()).hexdigest()})
    (root / "manifest.json").write_text(json.dumps({"files": entries}))
    return root


def test_a_sound_bundle(spark, tmp_path, capsys):
    root = bundle(tmp_path / "b")
    assert verify.verify_bundle(spark, root, ["gtfs-intermediate/stops.txt"])["zero_stops"] == ["z"]
    assert cli.main(["verify", str(root)], spark) == 0 and "zero_stops" in capsys.readouterr().out


STOPS = "gtfs-intermediate/stops.txt"
HEADER = "stop_id,stop_name,stop_lat,stop_lon,location_type,parent_station\n"


@pytest.mark.parametrize(
    "changes, said",
    [
        ({"diagnostics.json": json.dumps({"diagnostics": [{"severity": "Error"}]})}, "errors"),
        ({"gtfs-intermediate/trips.txt": "route_id,trip_id\n"}, "no trips"),
        ({STOPS: HEADER + "c,N,50,14,,p\np,N,50,14,1,\n"}, "dangling"),
        ({STOPS: HEADER + "c,N,50,14,,p\nz,Z,0,0,,\n"}, "missing parents"),
        ({STOPS: HEADER + "c,N,50,14,,p\np,O,50,14,1,\nz,Z,0,0,,\n"}, "another name|other name"),
        ({STOPS: HEADER + "c,N,95,14,,p\np,N,50,14,1,\nz,Z,0,0,,\n"}, "out of range"),
        ({STOPS: HEADER + "c,N,50,14,,p\nc,N,50,14,,p\np,N,50,14,1,\nz,Z,0,0,,\n"}, "repeated"),
        ({STOPS: HEADER + "c,N,50,14,,p\np,N,50,14,1,\nq,N,50,14,1,\nz,Z,0,0,,\n"}, "extra stations"),
        ({STOPS: "stop_id\nc\n"}, "lacks"),
        ({"gtfs-intermediate/stop_times.txt": "trip_id,stop_sequence,stop_id\nt,1,c\n"}, "unreferenced"),
        ({"extensions/cz_trips.txt": None}, "missing"),
        ({"extensions/cz_routes.txt": "route_id\nx\n"}, "cz_routes"),
        ({"extensions/cz_trip_stop_zones.txt": "trip_id,stop_sequence,zone\nt,3,Z\n"}, "cz_trip_stop_zones"),
        ({"gtfs-intermediate/cz_trips.txt": "trip_id\nt\n"}, "in the feed"),
    ],
)
def test_unsound_bundles(spark, tmp_path, changes, said):
    with pytest.raises(BundleError, match=said):
        verify.verify_bundle(spark, bundle(tmp_path, **changes))


def test_other_checks_of_bundles(spark, tmp_path):
    root = bundle(tmp_path)
    (root / STOPS).write_text("changed")
    with pytest.raises(BundleError, match="isn't what"):
        verify.check_files(root)
    stops = spark.createDataFrame([("c", "N", "x", "1", "", "p", "1")], "stop_id string, stop_name string, stop_lat string, stop_lon string, location_type string, parent_station string, code string")
    with pytest.raises(Exception, match="no number"):
        verify.check_stops(stops, stops.select("stop_id"))
    authority = spark.createDataFrame([("1", 14.0, 50.0)], "code string, lon double, lat double")
    place = lambda lat: spark.createDataFrame([("c", "N", lat, "14", "", "", "1"), ("d", "M", "1", "1", "", "", None)], stops.schema)
    verify.check_hierarchy(place("50.0000001"), authority)
    with pytest.raises(BundleError, match="elsewhere"):
        verify.check_hierarchy(place("50.1"), authority)
    verify.check_foreign(spark, ["x:CZ:1", "x:DE:2"], {"x:DE:2": "closed"}, "x:CZ:")
    with pytest.raises(BundleError, match="x:DE:2"):
        verify.check_foreign(spark, ["x:CZ:1", "x:DE:2"], {"x:DE:2": 5, "y": "z"}, "x:CZ:")


def tag(number, value):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value & (1 << 64) - 1)
    body = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(body)) + body


def test_realtime_feeds(spark):
    trip = tag(1, tag(1, "T9") + tag(5, "R2"))
    vehicle = tag(2, tag(1, "e1") + tag(4, trip + tag(2, tag(1, 50.5) + tag(2, 14.25)) + tag(3, 7) + tag(5, 1_900_000_000) + tag(8, tag(1, "bus"))))
    update = tag(2, tag(1, "e2") + tag(3, trip + tag(2, tag(1, 3) + tag(2, tag(1, -90))) + tag(2, tag(4, "s4") + tag(3, tag(1, 60) + tag(2, 1_900_000_100)))))
    alert = tag(2, tag(1, "e3") + tag(5, tag(1, tag(1, 5) + tag(2, 9)) + tag(1, tag(1, 20)) + tag(5, tag(2, "R2")) + tag(10, tag(1, tag(1, "Works")))))
    feed = tag(1, tag(1, "2.0") + tag(3, 1_900_000_001)) + vehicle + update + alert
    rows = spark.createDataFrame([("a", bytearray(feed)), ("b", bytearray(b"\xff\xff")), ("c", bytearray(b""))], "path string, content binary")
    got = realtime_feed.feed_rows(rows).orderBy("entity_id", "stop_sequence", "period_start").collect()
    assert [(r.path, r.kind) for r in got] == [("b", "broken"), ("a", "vehicle"), ("a", "stop"), ("a", "stop"), ("a", "alert"), ("a", "alert")]
    assert (got[1].trip_id, got[1].route_id, got[1].latitude, got[1].longitude, got[1].stop_sequence, got[1].timestamp, got[1].vehicle_id, got[1].feed_timestamp) == ("T9", "R2", 50.5, 14.25, 7, 1_900_000_000, "bus", 1_900_000_001)
    assert (got[2].departure_delay, got[2].stop_id, got[3].arrival_delay, got[3].stop_sequence) == (60, "s4", -90, 3)
    assert [(r.header, r.period_start, r.period_end, r.route_id) for r in got[4:]] == [("Works", 5, 9, "R2"), ("Works", 20, None, "R2")]


def test_feeds_written_and_read_back(spark):
    rows = [
        {"kind": "vehicle", "entity_id": "v1", "trip_id": "T1", "latitude": 50.5, "longitude": -14.25, "timestamp": 1_900_000_000, "vehicle_id": "b", "stop_sequence": 300},
        {"kind": "stop", "entity_id": "u1", "trip_id": "T2", "route_id": "R", "stop_sequence": 1, "arrival_delay": -61},
        {"kind": "stop", "entity_id": "u1", "trip_id": "T2", "route_id": "R", "stop_id": "s", "departure_time": 1_900_000_060},
    ]
    back = list(realtime_feed.rows_of(realtime_feed.feed_of(rows, 1_900_000_005)))
    assert [{k: v for k, v in r.items() if k != "feed_timestamp"} for r in back] == rows and {r["feed_timestamp"] for r in back} == {1_900_000_005}


def test_payloads_as_a_stream(spark, tmp_path):
    folder, out = tmp_path / "captured", tmp_path / "out"
    folder.mkdir()
    feed = lambda k: realtime_feed.feed_of([{"kind": "vehicle", "entity_id": f"v{k}", "trip_id": f"T{k}"}, {"kind": "vehicle", "entity_id": "w"}], 1_900_000_000 + k)

    def capture(k, body):
        (folder / f"{k}.pb").write_bytes(body)

    def query():
        rows = realtime_feed.feed_rows(realtime_feed.payload_stream(spark, str(folder), files=2))
        q = rows.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sum(p["numInputRows"] > 0 for p in q.recentProgress)

    for k in range(5):
        capture(k, feed(k // 2))  # some payloads repeat the one before
    capture(9, b"\xff\xff")
    assert query() == 3
    capture(10, feed(7))
    capture(11, feed(0))
    assert query() == 1
    got = sorted((r.kind, r.entity_id, r.feed_timestamp) for r in spark.read.schema(realtime_feed.SCHEMA).parquet(str(out)).collect() if r.kind == "vehicle")
    assert got == sorted(("vehicle", e, 1_900_000_000 + k) for k in (0, 1, 2, 7) for e in (f"v{k}", "w"))
