"""Feed projections, bundles and configuration."""

import datetime

import pytest
from pyspark.sql import functions as F

from tramline.operators import export
from tramline.sources import bundle

D = datetime.date


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_stop_times_and_shifts(spark):
    calls = rows(spark, [("t", 10, True, -60, None, "b1", 0, 0), ("t", 20, False, None, None, None, 1, 1), ("t", 30, True, 90_000, 90_061, "b2", 0, 1)], "trip_id string, sequence int, passenger_service boolean, scheduled_arrival int, scheduled_departure int, boarding_point_id string, pickup_type int, dropoff_type int")
    got = export.stop_times(export.shifted(calls, ["scheduled_arrival", "scheduled_departure"])).orderBy("stop_sequence").collect()
    assert [(r.stop_sequence, r.arrival_time, r.departure_time, r.stop_id) for r in got] == [(1, "23:59:00", "23:59:00", "b1"), (2, "49:00:00", "49:01:01", "b2")]


def test_calendars(spark):
    r = export.calendar_rows(rows(spark, [("s", 33, D(2026, 1, 1), D(2026, 2, 1))], "service_id string, weekday_mask short, valid_from date, valid_to date")).first()
    assert (r.monday, r.tuesday, r.saturday, r.sunday, r.start_date) == (1, 0, 1, 0, "20260101")
    e = export.calendar_dates(rows(spark, [("s", D(2026, 1, 2), True), ("s", D(2026, 1, 3), False)], "service_id string, service_date date, added boolean")).orderBy("date").collect()
    assert [(x.date, x.exception_type) for x in e] == [("20260102", 1), ("20260103", 2)]


def test_stops_lines_codes_shapes(spark):
    calls = rows(spark, [("L", "1"), ("L", None), ("L", "1")], "location_id string, platform string")
    stops = export.parent_stops(calls, rows(spark, [("L", "Name")], "location_id string, name string")).collect()
    assert sorted(r.stop_id for r in stops) == ["L", "L:1", "L:unspecified"]
    lines = rows(spark, [(None, "545009"), ("9A", "545009"), (None, "x")], "e string, l string").select(export.public_line(F.col("e"), F.col("l")).alias("p")).collect()
    assert [r.p for r in lines] == ["9", "9A", None]
    assert [r.k for r in export.coded(rows(spark, [("R",), ("?",)], "c string"), {"R": "reservation"}, "c", "k").collect()] == ["reservation", None]
    s = lambda x: rows(spark, x, "trip_id string, shape_id string")
    got = export.chosen_shape(rows(spark, [("a",), ("b",), ("c",)], "trip_id string"), s([("a", "r")]), s([("a", "n"), ("b", "n")]), s([])).orderBy("trip_id").collect()
    assert [(r.shape_id, r.origin) for r in got] == [("r", "regional"), ("n", "national"), (None, "none")]


def test_export_checks(spark):
    ext = {"calls": rows(spark, [("t1",), ("t9",), (None,)], "trip_id string")}
    got = export.extension_violations(ext, {"trip_id": (rows(spark, [("t1",)], "trip_id string"), "trip_id")}).collect()
    assert [(r.extension, r.violations) for r in got] == [("calls", 1)]
    points = rows(spark, [("CZ1", False), ("DE1", False), ("DE2", False), ("DE3", True)], "point_id string, resolved boolean")
    accepted = rows(spark, [("DE1", "known"), ("DE2", " ")], "point_id string, disposition string")
    assert [r.point_id for r in export.without_disposition(points, accepted, "CZ").collect()] == ["DE2"]
    j = rows(spark, [("5", D(2026, 1, 5)), ("6", D(2026, 1, 5))], "number string, service_date date")
    a = rows(spark, [("5", D(2026, 1, 1), None, 2, "old", "s"), ("5", D(2026, 1, 4), D(2026, 1, 9), 1, "new", "s")], "number string, valid_from date, valid_to date, priority int, attribute string, source_id string")
    assert sorted((r.number, r.attribute) for r in export.dated_attributes(j, a, "number").collect()) == [("5", "new"), ("6", None)]


def test_bundles(spark, tmp_path):
    src = tmp_path / "src"
    (src / "d").mkdir(parents=True)
    (src / "d/b.txt").write_text("b")
    (src / "a.txt").write_text("a")
    known = bundle.manifest_of(src)
    assert [x["path"] for x in known] == ["a.txt", "d/b.txt"]
    assert bundle.copy_snapshot(src, tmp_path / "copy", known) == known
    with pytest.raises(bundle.BundleError):
        bundle.copy_snapshot(src, tmp_path / "other", known[:1])
    assert bundle.deterministic_zip(src, tmp_path / "1.zip") == bundle.deterministic_zip(tmp_path / "copy", tmp_path / "2.zip")
    assert bundle.recheck_inventory(["a"], ["a", "b"]) == ["b"]
    with pytest.raises(bundle.BundleError):
        bundle.recheck_inventory(["a", "c"], ["a"])
    derived = bundle.Derived.of(src / "a.txt", "k")
    assert derived.check("k") == src / "a.txt"
    with pytest.raises(bundle.BundleError):
        derived.check("other")
    assert bundle.provenance("c", b"", [src / "a.txt"], ["x"])["dirty"] is False
    assert bundle.cache_key(1, {"a": 1}, ["x", "y"]) != bundle.cache_key(1, {"a": 1}, ["y", "x"])
    assert bundle.write_csv(rows(spark, [("b", None), ("a", True)], "k string, v boolean"), tmp_path / "x.csv", ["k"]) == 2
    assert (tmp_path / "x.csv").read_bytes() == b"k,v\r\na,1\r\nb,\r\n"
    assert bundle.dictionary_catalog({"op": rows(spark, [("2", ""), ("1", "x")], "code string, name string")}) == {"op": [{"code": "1", "name": "x"}, {"code": "2"}]}


def test_atomic_publishing(tmp_path):
    assert (bundle.publish(tmp_path / "ok", lambda p: (p / "x").write_text("1")) / "x").read_text() == "1"

    def fail(p):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        bundle.publish(tmp_path / "bad", fail)
    assert not (tmp_path / "bad").exists() and (tmp_path / ".bad.staging/failure.json").exists()


@pytest.mark.parametrize("text, ok", [('[snapshot]\npath = "/a"', True), ('[snapshot]\npath = "a"', False), ("[snapshot]\n[remote]\n", False), ("", False), ('[remote]\na = 1', False), ("[remote]\na = 1\nb = 2", True)])
def test_config(tmp_path, text, ok):
    (tmp_path / "c.toml").write_text(text)
    load = lambda: bundle.load_config(tmp_path / "c.toml", ["snapshot", "remote"], ["path"], [("a", "b")])
    if ok:
        assert load()["mode"] in text
    else:
        with pytest.raises(bundle.BundleError):
            load()


def test_a_whole_feed_and_its_extensions(spark, tmp_path):
    import csv

    from test_package import frames
    from tramline.sources import verify

    relations = frames(spark)
    counts = bundle.write_feed(export.feed(relations), tmp_path / verify.FEED)
    more = bundle.write_feed(export.extensions(relations), tmp_path / verify.EXTENSIONS)
    read = lambda folder, name: list(csv.DictReader(open(tmp_path / folder / name, encoding="utf-8")))
    assert set(counts) == {f"{n}.txt" for n in "agency routes trips stops stop_times calendar calendar_dates shapes".split()} and set(more) == set(verify.EXTENSION_FILES)
    stops = {r["stop_id"]: r for r in read(verify.FEED, "stops.txt")}
    called = {r["stop_id"] for r in read(verify.FEED, "stop_times.txt")}
    assert called <= set(stops) and all(r.get("parent_station", "") in ("", *stops) for r in stops.values())
    assert [int(r["stop_sequence"]) for r in read(verify.FEED, "stop_times.txt")] == list(range(1, counts["stop_times.txt"] + 1))
    verify.check_extensions(spark, tmp_path)
