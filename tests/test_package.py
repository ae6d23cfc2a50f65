"""The package contract: a round trip, every breach that must be told, and the lifecycle of builds and jobs."""

import datetime
import json
import shutil

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tramline.contract import DOMAINS, REFERENCES, RELATIONS
from tramline.operators import checks
from tramline.sources import package, publish

SHA = "a" * 64
DAY = datetime.date(2026, 1, 1)

#: One valid row set; other non-null columns are filled in by type.
ROWS = {
    "agency": [{"agency_id": "A"}],
    "location": [{"location_id": "BP", "kind": "boarding_point", "domain": "surface", "parent_location_id": "SP"}, {"location_id": "OP", "kind": "operational_point", "domain": "heavy_rail"}, {"location_id": "SP", "kind": "stop_place", "domain": "surface", "longitude": 14.4, "latitude": 50.1}],
    "route": [{"route_id": "R", "agency_id": "A"}],
    "service_calendar": [{"service_id": "S", "valid_from": DAY, "valid_to": datetime.date(2026, 12, 31), "weekday_mask": 31}],
    "service_exception": [],
    "shape": [{"shape_id": "H"}],
    "shape_point": [{"shape_id": "H", "sequence": 0, "longitude": 14.0, "latitude": 50.0}, {"shape_id": "H", "sequence": 1, "longitude": 14.5, "latitude": 50.5}],
    "trip": [{"trip_id": "T", "route_id": "R", "service_id": "S", "shape_id": "H"}],
    "trip_call": [
        {"trip_id": "T", "sequence": 10, "location_id": "SP", "passenger_service": True, "boarding_point_id": "BP", "scheduled_arrival": 3600, "scheduled_departure": 90_000},
        {"trip_id": "T", "sequence": 20, "location_id": "OP", "passenger_service": False, "scheduled_passage": 91_000, "pickup_type": 1, "dropoff_type": 1},
    ],
    "route_segment": [{"trip_id": "T", "from_sequence": 10, "to_sequence": 20, "route_id": "R"}],
    "transfer": [],
    "fare_system": [{"fare_system_id": "FS"}],
    "fare_zone": [{"fare_system_id": "FS", "zone_id": "Z"}],
    "location_zone": [{"location_id": "SP", "fare_system_id": "FS", "zone_id": "Z"}],
    "call_zone": [{"trip_id": "T", "sequence": 10, "fare_system_id": "FS", "zone_id": "Z"}],
    "service_note": [{"note_id": "N", "kind": "service_note", "label": "x"}],
    "service_note_assignment": [{"assignment_id": "NA", "note_id": "N", "scope": "route", "route_id": "R"}],
    "service_feature_assignment": [{"feature_id": "F", "scope": "call", "kind": "request_stop", "trip_id": "T", "call_sequence": 10, "note_id": "N"}],
    "location_feature": [{"feature_id": "LF", "location_id": "SP", "kind": "toilet"}],
    "connection_claim": [{"connection_id": "C", "direction": "waits_for", "origin_trip_id": "T", "origin_sequence": 10, "target_derivation": "none", "resolution_status": "unresolved"}],
    "travel_restriction_assignment": [{"assignment_id": "V", "scope": "trip_call", "trip_id": "T", "call_sequence": 10, "group_code": "§"}],
    "operational_location": [{"source_id": "s", "source_location_id": "L"}],
    "operational_journey": [{"source_id": "s", "source_journey_id": "J"}],
    "operational_call": [{"source_id": "s", "source_journey_id": "J", "sequence": 10, "source_location_id": "L", "passenger_service": False, "scheduled_passage": -60}],
    "source_entity_map": [{"source_id": "s"}],
    "source_trip_map": [{"source_id": "s", "trip_namespace": "n", "source_trip_id": "1", "trip_id": "T", "valid_from": DAY, "valid_to": DAY}],
    "source_call_map": [{"source_id": "s", "trip_namespace": "n", "source_trip_id": "1", "trip_id": "T", "call_sequence": 10}],
    "source_trip_coverage": [{"source_id": "s", "trip_namespace": "n", "source_trip_id": "1", "trip_id": "T", "from_sequence": 10, "to_sequence": 20}],
    "identifier_alias": [{"source_id": "s", "observed_id": "704411", "canonical_value": "004411"}],
    "road_route_key": [{"cis_line_id": "004411", "route_id": "R"}],
    "road_trip_key": [{"cis_line_id": "004411", "cis_trip_id": 3, "trip_id": "T"}],
    "rail_trip_key": [{"train_number": 9001, "trip_id": "T"}],
    "selected_field_provenance": [{"object_type": "trip"}],
}
FILL = {"string": "x", "int": 1, "smallint": 0, "bigint": 1, "double": 1.0, "boolean": False, "date": DAY}


def frames(spark, change=None):
    out = {}
    for name, relation in RELATIONS.items():
        rows = [dict(r) for r in ROWS[name]]
        if change and name in change:
            change[name](rows)
        full = [tuple(r.get(f.name, None if f.nullable else SHA if f.name.endswith("sha256") else FILL[f.dataType.simpleString()]) for f in relation.schema) for r in rows]
        out[name] = spark.createDataFrame(full, relation.schema)
    return out


def manifest(**more):
    return {k: SHA for k in package.DIGESTS} | {"identity_contract": "provisional-v0", "feed_version": "1", "compiler_identity": {}, "registry_snapshot_sha256": None} | more


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("package") / "p"
    package.write_package(frames(spark), root, manifest())
    return root


@pytest.fixture
def copy(written, tmp_path):
    return shutil.copytree(written, tmp_path / "p")


def test_contract_is_complete():
    assert len(RELATIONS) == 33 and len(REFERENCES) == 36
    for r in REFERENCES:
        names = list(RELATIONS)
        assert names.index(r.parent) <= names.index(r.child)
        assert set(r.columns) <= set(RELATIONS[r.child].schema.names) and set(r.parent_columns) == set(RELATIONS[r.parent].sort_key)
    assert set(DOMAINS) <= set(RELATIONS)
    assert sum(len(r.schema) for r in RELATIONS.values()) > 200


def test_round_trip(spark, written):
    found = package.validate_package(spark, written)
    assert found.rows == {k: len(v) for k, v in ROWS.items()}
    assert [r.sequence for r in found.read(spark)["trip_call"].orderBy("sequence").collect()] == [10, 20]
    footer = pq.read_schema(written / "serving" / "trip_call.parquet")
    assert not footer.field("trip_id").nullable and footer.field("boarding_point_id").nullable


def test_writing_again_gives_the_same_bytes(spark, written, tmp_path):
    package.write_package(frames(spark), tmp_path / "again", manifest())
    assert (tmp_path / "again/manifest.json").read_bytes() == (written / "manifest.json").read_bytes()


def rewrite(root, **changes):
    path = root / "manifest.json"
    path.write_text(json.dumps(json.loads(path.read_text()) | changes))


@pytest.mark.parametrize(
    "changes, said",
    [({"schema_version": 2}, "schema version"), ({"identity_contract": "other"}, "identity"), ({"feed_version": ""}, "feed_version"), ({"gtfs_sha256": "A" * 64}, "gtfs_sha256"), ({"identity_contract": "registry-v1"}, "registry"), ({"compiler_identity": None}, "compiler"), ({"relations": {}}, "array"), ({"serving_sha256": "b" * 64}, "digest")],
)
def test_header_breaches(spark, copy, changes, said):
    rewrite(copy, **changes)
    with pytest.raises(package.PackageError, match=said):
        package.validate_package(spark, copy)


def test_changed_bytes(spark, copy):
    with open(copy / "serving/route.parquet", "ab") as f:
        f.write(b"x")
    with pytest.raises(package.PackageError, match="route: size or digest"):
        package.validate_package(spark, copy)


@pytest.mark.parametrize("rows, said", [([2, 1, 0], "unsorted"), ([0, 0, 1], "duplicate")])
def test_key_order_breaches(spark, copy, rows, said):
    path = copy / "serving/location.parquet"
    t = pq.read_table(path).take(rows)
    pq.write_table(t, path)
    m = json.loads((copy / "manifest.json").read_text())
    entry = next(e for e in m["relations"] if e["name"] == "location")
    entry |= {"sha256": package.file_sha256(path), "size_bytes": path.stat().st_size}
    rewrite(copy, relations=m["relations"])
    with pytest.raises(package.PackageError, match=said):
        package.validate_package(spark, copy)


def test_missing_relation(spark, copy):
    m = json.loads((copy / "manifest.json").read_text())
    rewrite(copy, relations=m["relations"][:-1])
    with pytest.raises(package.PackageError, match="missing"):
        package.validate_package(spark, copy)


def test_valid_rows_break_no_check(spark):
    r = frames(spark)
    for found in (checks.summary(r), checks.references_summary(r), checks.domains_summary(r)):
        assert found.filter("violations > 0").collect() == []
    assert checks.null_violations("trip", r["trip"]).filter("violations > 0").count() == 0


@pytest.mark.parametrize(
    "relation, column, value, check",
    [
        ("trip_call", "boarding_point_id", None, "trip call shape"),
        ("trip_call", "boarding_point_id", "SP", "boarding point kind"),
        ("location", "domain", "heavy_rail", "location parent kind/domain"),
        ("source_trip_coverage", "to_sequence", 30, "coverage endpoints"),
        ("source_trip_coverage", "source_trip_id", "2", "coverage source trip mapping"),
        ("source_call_map", "trip_namespace", "m", "source call trip mapping"),
        ("service_note", "label", None, "empty service note"),
        ("service_feature_assignment", "call_sequence", 11, "service feature references"),
        ("location_feature", "location_id", "no", "location feature references"),
        ("connection_claim", "resolution_status", "resolved", "connection resolution"),
        ("connection_claim", "target_route_id", "no", "connection target references"),
        ("travel_restriction_assignment", "call_sequence", None, "travel restriction references"),
    ],
)
def test_each_check_finds_its_breach(spark, relation, column, value, check):
    r = frames(spark, {relation: lambda rows: rows[0].update({column: value})})
    assert check in [x["check"] for x in checks.summary(r).filter("violations > 0").collect()]


def test_overlapping_segments_both_ways(spark):
    rows = [("T", 1, 5), ("T", 3, 4), ("T", 5, 9), ("U", 1, 2), ("U", 3, 9)]
    r = {"route_segment": spark.createDataFrame(rows, "trip_id string, from_sequence int, to_sequence int")}
    assert checks.overlapping_segments(r).count() == 2
    assert sorted(x.from_sequence for x in checks.segments_in_overlap(r).collect()) == [3, 5]


def test_lifecycle(spark, written, tmp_path):
    store = publish.Store(tmp_path / "store")
    builds = publish.Builds(store)
    found = package.validate_package(spark, written)
    ids = [builds.create("key0", "1", **publish.facts_of(found)), *[builds.create(f"key{k}", f"feed{k}") for k in range(1, 4)]]
    assert ids == [1, 2, 3, 4] and builds.create("key0", "1") == 1
    counts = builds.load(spark, 1, found)
    assert counts == found.rows and builds.state(1) == "ready"
    assert builds.read(spark, "trip", 1).count() == 1
    assert builds.read(spark, "shape_line", 1).columns == ["shape_id", "n_points", "line"]
    assert builds.read(spark, "position", 1).count() == counts["location"]
    for k in ids[1:]:  # what a load leaves, without its checks
        builds.mark_loading(k)
        shutil.copytree(builds.folder(1), builds.folder(k))
        with store.locked():
            builds._build(k)["attached"] = True
        builds.mark_ready(k)
    for k in (1, 2, 3, 4, 3, 4):
        builds.activate(k)
    assert builds.active_build() == 4 and builds.prune(spark, retain=3) == (1,)
    assert builds.state(1) == "pruned" and not builds.folder(1).exists() and builds.relation_path("trip", 2).exists()
    builds.activate(4, "other")
    builds.activate(3)
    assert builds.state(4) == "active"
    builds.activate(3, "other")
    assert builds.state(4) == "retired"
    with pytest.raises(publish.LifecycleError):
        builds.mark_failed(3, {})
    assert publish.Builds(publish.Store(tmp_path / "store")).active_build() == 3


def test_failed_load_leaves_nothing(spark, tmp_path):
    root = tmp_path / "bad"
    package.write_package(frames(spark, {"trip_call": lambda rows: rows[0].update(boarding_point_id=None)}), root, manifest())
    builds = publish.Builds(publish.Store(tmp_path / "store"))
    found = package.validate_package(spark, root)
    k = builds.create("k", "1", **publish.facts_of(found))
    with pytest.raises(publish.LifecycleError, match="trip call shape"):
        builds.load(spark, k, found)
    assert builds.state(k) == "failed" and not builds.folder(k).exists()


@pytest.mark.parametrize("fact", [*publish.FACTS, "manifest_sha256"])
def test_a_package_of_other_facts_is_not_loaded(spark, written, tmp_path, fact):
    found = package.Package(written, json.loads((written / "manifest.json").read_text()), SHA, {})
    builds = publish.Builds(publish.Store(tmp_path))
    facts = {"feed_version": "1", **publish.facts_of(found)}
    k = builds.create("k", **(facts | {fact: "other"}))
    with pytest.raises(publish.LifecycleError, match="another manifest" if fact == "manifest_sha256" else fact):
        builds.load(spark, k, found)
    assert builds.state(k) == "building"
    builds.compare(builds.create("j", **facts) if fact == "feed_version" else k, found) if fact == "feed_version" else None


def test_advisory_validators(tmp_path):
    builds = publish.Builds(publish.Store(tmp_path))
    k = builds.create("k", "1")
    builds.add_validation(k, "MobilityData-GTFS-Validator", False, {})
    builds.add_validation(k, "mobilitydata", False, {})
    assert not builds.blocked(k)
    builds.add_validation(k, "netex-validator", False, {})
    assert builds.blocked(k)


def test_two_workers_never_share_a_job(tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    publish.Jobs(publish.Store(tmp_path))
    first = publish.Jobs(publish.Store(tmp_path))
    ids = [first.enqueue(SHA) for _ in range(24)]
    workers = [publish.Jobs(publish.Store(tmp_path)) for _ in range(6)]
    with ThreadPoolExecutor(6) as pool:
        got = [x for xs in pool.map(lambda w: [w.claim("w") for _ in range(4)], workers) for x in xs]
    assert sorted(j for j, _ in got) == ids and publish.Jobs(publish.Store(tmp_path)).claim("w") is None


def test_events_of_an_interrupted_change_go(spark, tmp_path):
    store = publish.Store(tmp_path)
    jobs = publish.Jobs(store)
    jobs.enqueue(SHA)
    with open(store.log, "ab") as f:
        f.write(b'{"event_id": 2, "job_id": 9')
    other = publish.Jobs(publish.Store(tmp_path))
    other.enqueue(SHA)
    assert [(r.event_id, r.job_id, r.event) for r in other.events(spark).orderBy("event_id").collect()] == [(1, 1, "queued"), (2, 2, "queued")]


def test_jobs(spark, tmp_path):
    store = publish.Store(tmp_path)
    jobs = publish.Jobs(store)
    low, high = jobs.enqueue(SHA), jobs.enqueue(SHA, priority=5)
    assert jobs.claim("w") == (high, 1)
    assert jobs.heartbeat(high, 1, {"done": 1}) is False
    jobs.finish(high, 1, False, error="x")
    jobs.retry(high)
    assert jobs.claim("w") == (high, 2)
    jobs.request_cancel(high)
    assert jobs.heartbeat(high, 2, {}) is True
    jobs.finish(high, 2, True)
    assert store.data["jobs"][str(high)]["state"] == "cancelled"
    with pytest.raises(publish.LifecycleError):
        jobs.retry(high)
    assert jobs.events(spark).filter(F.col("job_id") == high).count() == 9
    assert jobs.claim("w") == (low, 1) and jobs.claim("w") is None


def test_facts_and_keys(tmp_path):
    store = publish.Store(tmp_path)
    store.register("source", "s", {"a": 1})
    store.register("source", "s", {"a": 1})
    with pytest.raises(ValueError):
        store.register("source", "s", {"a": 2})
    assert store.register_document("spec", {"b": 1, "a": 2}) == store.register_document("spec", {"a": 2, "b": 1})
    assert publish.storage_key("a/b-c.d/e:f") == "a/b-c.d/e:f"
    for bad in ("a\\b/c", "./a", "a/", "", "/a", "C:/a", "a/../b", "a//b"):
        with pytest.raises(ValueError):
            publish.storage_key(bad)
