"""The NeTEx document: well formed, in order, the same at any parallelism, and never more than the claims say."""

from xml.etree import ElementTree

import pytest

from tramline.operators import netex

NS = {"n": netex.NAMESPACE, "x": netex.EXTENSION}
CLAIM = "connection_id string, direction string, origin_trip_id string, origin_sequence int, target_trip_id string, target_route_id string, wait_minutes int, resolution_status string"


@pytest.fixture
def relations(spark):
    make = spark.createDataFrame
    return {
        "agency": make([("A", 'Bus & "Co" <x>\u0001')], "agency_id string, name string"),
        "location": make([("p", "stop_place", None, "Place\n1", 14.5, 50.25), ("q2", "boarding_point", "p", "Two", None, None), ("q1", "boarding_point", "p", None, 1.0, 2.0), ("o", "operational_point", None, "Point", 3.0, None)], "location_id string, kind string, parent_location_id string, name string, longitude double, latitude double"),
        "route": make([("R", "A", "trolleybus", "7"), ("S", None, "cable", None)], "route_id string, agency_id string, mode string, short_name string"),
        "service_calendar": make([("C", "2031-01-01", "2031-02-01", 0b1000001)], "service_id string, valid_from string, valid_to string, weekday_mask int"),
        "trip": make([("T", "R", "C", None, 1), ("U", "S", "C", "Up", None)], "trip_id string, route_id string, service_id string, headsign string, direction int"),
        "trip_call": make([("T", 20, "p", "q1", True, 90_061, 90_100, None), ("T", 3, "o", None, False, None, None, 0), ("T", 100, "p", None, True, -60, None, None)], "trip_id string, sequence int, location_id string, boarding_point_id string, passenger_service boolean, scheduled_arrival int, scheduled_departure int, scheduled_passage int"),
        "connection_claim": make([("1", "waits_for", "T", 3, "U", "S", 5, "resolved"), ("2", "waits_for", "T", 3, "U", "S", None, "pattern"), ("3", "connects_to", "T", 3, "U", "S", 1, "unresolved"), ("4", "connects_to", "T", 3, None, "S", 1, "resolved")], CLAIM),
    }


def test_document(spark, relations, tmp_path):
    texts = set()
    for size, parts in ((65_536, 1), (3, 4)):
        path = tmp_path / f"{size}.xml"
        n = netex.write({k: df.repartition(parts) for k, df in relations.items()}, path, size=size)
        assert n == netex.objects(relations).count()
        texts.add(path.read_bytes())
    assert len(texts) == 1
    root = ElementTree.fromstring(texts.pop())
    assert [e.tag.split("}")[1] for e in root.find("n:dataObjects", NS)] == [name for name, _ in netex.FRAMES]
    assert root.find(".//n:Operator/n:Name", NS).text == 'Bus & "Co" <x>' and root.find(".//n:StopPlace/n:Name", NS).text == "Place\n1"
    assert [q.get("id") for q in root.findall(".//n:StopPlace/n:quays/n:Quay", NS)] == ["q1", "q2"] and root.find(".//n:TimingPoint[@id='o']/n:Centroid", NS) is None
    assert {e.get("id"): e.find("n:TransportMode", NS).text for e in root.findall(".//n:Line", NS)} == {"R": "trolleyBus", "S": "other"}
    assert root.find(".//n:DaysOfWeek", NS).text == "Monday Sunday"
    interchanges = [e.get("id") for e in root.findall(".//n:ServiceJourneyInterchange", NS)]
    assert interchanges == ["1"] and [e.get("id") for e in root.findall(".//n:InterchangeRule", NS)] == ["2", "4"]
    assert len(root.findall(".//x:ConnectionClaim", NS)) == 4
    read = netex.calls_of(netex.read(spark, f"file://{path}", "ServiceJourney", netex.JOURNEY))
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, relations["trip_call"].collect()))
    assert [tuple(r) for r in netex.lost(relations).collect()] == [("trip", "direction", 1)]


def test_parts_may_be_absent(relations, tmp_path):
    netex.write({"agency": relations["agency"].limit(0)}, tmp_path / "none.xml")
    assert len(ElementTree.parse(tmp_path / "none.xml").getroot().find("n:dataObjects", NS)) == 0
    with pytest.raises(ValueError, match="no relation"):
        netex.write({}, tmp_path / "x.xml")
