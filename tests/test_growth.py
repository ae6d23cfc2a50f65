"""Work that grows with the input: what joins give, what is sent whole, and how files are cut."""

import gzip
import math
import os
from collections.abc import Iterator

import pandas as pd
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.operators import checks, derive, export, matching, netex, overlay, resolve
from tramline.plans import further, registry
from tramline.sources import archives, joined, readers, realtime_feed


def ran(df: DataFrame) -> tuple[list, list[tuple[str, int]]]:
    """The rows of a query, and the steps of the plan that ran, each with the rows that it gave."""

    def steps(node) -> Iterator[tuple[str, int]]:
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            yield from steps(node.executedPlan())
        elif "QueryStage" in name:
            yield from steps(node.plan())
        else:
            count = node.metrics().get("numOutputRows")
            yield name, count.get().value() if count.isDefined() else 0
            for k in range(node.children().size()):
                yield from steps(node.children().apply(k))

    rows = df.collect()
    return rows, list(steps(df._jdf.queryExecution().executedPlan()))


def most_joined(told: list[tuple[str, int]]) -> int:
    return max(n for name, n in told if "Join" in name)


def test_entities_of_a_key_with_many_rows(spark):
    mapping = spark.range(2_000).selectExpr("'s' AS source_id", "'n' AS identifier_namespace", "'k' AS entity_kind", "if(id < 1900, 'a', 'b') AS source_object_id", "if(id < 1900, concat('P', id % 3), 'Q') AS public_id")
    observed = spark.range(300).selectExpr("id AS event_id", "'s' AS source_id", "'n' AS identifier_namespace", "'k' AS entity_kind", "substr('abc', cast(id % 3 AS int) + 1, 1) AS source_object_id")
    rows, told = ran(resolve.entity(observed, mapping, ["event_id"]))
    assert {(r.event_id % 3, r.status, r.public_id) for r in rows} == {(0, "ambiguous", None), (1, "resolved", "Q"), (2, "unmatched", None)} and len(rows) == 300
    assert most_joined(told) <= 300


def test_trips_per_day_send_no_days_whole(spark):
    calendars = spark.createDataFrame([("a", "2024-01-01", "2024-01-31", 127), ("a", "2024-01-01", "2024-01-02", 1), ("b", "2024-01-31", "2024-02-01", 127), ("c", "2024-03-01", "2024-03-02", 127)], "service_id string, f string, t string, weekday_mask int")
    calendars = calendars.selectExpr("service_id", "cast(f AS date) AS valid_from", "cast(t AS date) AS valid_to", "weekday_mask")
    trips = spark.range(1_000).selectExpr("concat('T', id) AS trip_id", "if(id < 900, 'a', if(id < 990, 'b', null)) AS service_id")
    rows, told = ran(derive.trips_per_day(trips, calendars))
    each, sent = ran(derive.trip_instances(trips, derive.active_days(calendars)))
    counts = {}
    for r in each:
        counts[r.service_date] = counts.get(r.service_date, 0) + 1
    assert {r.service_date: r.trips for r in rows} == counts and len(counts) == 32
    assert most_joined(told) <= 4 and not [n for n, _ in told + sent if "Broadcast" in n]


def _relations(spark, n: int) -> dict[str, DataFrame]:
    calls = spark.range(4 * n).selectExpr("concat('T', id % {n}) AS trip_id".format(n=n), f"cast(id div {n} AS int) AS sequence", "'p' AS location_id", "if(id % 2 = 0, 'q\\n<1>', null) AS boarding_point_id", "id % 2 = 0 AS passenger_service", "cast(id AS int) AS scheduled_arrival", "cast(null AS int) AS scheduled_departure", "cast(null AS int) AS scheduled_passage")
    trips = spark.range(n).selectExpr("concat('T', id) AS trip_id", "'R' AS route_id", "'S' AS service_id", "'up' AS headsign")
    return {"trip": trips, "trip_call": calls}


def test_a_document_is_written_without_being_kept_twice(spark, tmp_path, monkeypatch):
    """What is joined goes: while the document is joined, parts and document hold its bytes once."""
    most, append = [0], joined.append_bytes

    def watched(parts, out):
        for part in parts:
            append([part], out)
            out.flush()
            most[0] = max(most[0], sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file()))

    monkeypatch.setattr(joined, "append_bytes", watched)
    assert netex.write(_relations(spark, 500), tmp_path / "a.xml", size=50) == 500
    assert most[0] <= (tmp_path / "a.xml").stat().st_size + 1_000


def test_lines_of_a_document_are_read_by_many_tasks(spark, tmp_path):
    relations = _relations(spark, 500)
    netex.write(relations, tmp_path / "a.xml", size=100)
    path = f"file://{tmp_path}/a.xml"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = netex.read(spark, path, "ServiceJourney", netex.JOURNEY, lines=True)
        assert rows.rdd.getNumPartitions() > 5
        calls = lambda df: sorted(map(repr, netex.calls_of(df).collect()))
        assert calls(rows) == calls(netex.read(spark, path, "ServiceJourney", netex.JOURNEY)) and len(calls(rows)) == 2_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_cycle_costs_no_rounds(spark, monkeypatch):
    rounds, cut = [], overlay.cut
    monkeypatch.setattr(overlay, "cut", lambda df: rounds.append(1) or cut(df))
    rows = spark.range(1_000).selectExpr("id AS old_id", "if(id < 3, (id + 1) % 3, if(id % 4 = 3, 5000, id + 1)) AS new_id")
    got = {r.old_id: (r.final_id, r.status) for r in overlay.follow_redirects(rows).collect()}
    assert got == {k: (None, "cycle") if k < 3 else (5000, "redirected") for k in range(1_000)}
    assert len(rounds) <= 6


def test_dates_within_many_intervals(spark):
    """Intervals of a key that hold a date aren't told one by one; a long one, one of a day, days before 1970 and an empty one are among them."""
    keys = spark.range(900).selectExpr("cast(1 AS int) AS train_number", "concat('T', id) AS trip_id", "date_add(date '1969-12-20', cast(id % 7 AS int)) AS valid_from", "date_add(date '1970-01-10', cast(id % 5 AS int)) AS valid_to")
    more = [(2, "U", "1969-12-31", "1969-12-31"), (2, "V", "1970-01-02", "2031-05-07"), (2, "W", "1980-01-02", "1980-01-01"), (3, "X", None, "1980-01-01")]
    more = spark.createDataFrame(more, "train_number int, trip_id string, f string, t string").selectExpr("train_number", "trip_id", "cast(f AS date) AS valid_from", "cast(t AS date) AS valid_to")
    keys = keys.unionByName(more)
    observed = spark.range(400).selectExpr("id AS event_id", "cast(1 + id % 4 AS int) AS train_number", "if(id = 399, null, date_add(date '1969-12-18', cast(id div 4 AS int))) AS service_date")
    rows, told = ran(resolve.rail_trip(observed, keys, ["event_id"]))
    by = {}
    for k in keys.collect():
        by.setdefault(k.train_number, []).append(k)
    for o, r in zip(sorted(observed.collect()), sorted(rows)):
        fit = {k.trip_id for k in by.get(o.train_number, []) if o.service_date and k.valid_from and k.valid_from <= o.service_date <= k.valid_to}
        assert tuple(r) == (o.event_id, "unmatched" if not fit else "resolved" if len(fit) == 1 else "ambiguous", min(fit) if len(fit) == 1 else None)
    assert most_joined(told) < 10_000


def test_points_and_objects_of_a_name_are_not_paired(spark):
    """Many points and objects share two names that differ in a letter: the closest object is found without a row for each pair, and nothing is sent whole."""
    points = spark.range(300).selectExpr("concat('p', lpad(id, 3, '0')) AS point_id", "'DE' AS country", "'' AS code", "if(id % 2 = 0, 'kingsford', 'queensbury') AS name")
    objects = spark.range(300).selectExpr("concat('o', lpad(id, 3, '0')) AS object_id", "cast(null AS string) AS reference", "if(id % 2 = 0, 'kingsfort', 'queensburg') AS name", "cast(id AS double) AS longitude", "cast(id AS double) AS latitude")
    authority = spark.createDataFrame([], "code string, longitude double, latitude double")
    rows, told = ran(matching.candidates(points, authority, objects, spark.createDataFrame([], "point_id string, object_id string")))
    assert sorted((r.point_id, r.object_id, r.longitude, r.method) for r in rows) == [(f"p{k:03}", f"o{k % 2:03}", float(k % 2), "fuzzy_name") for k in range(300)]
    assert most_joined(told) <= 1_000


def test_dates_of_a_road_trip_within_many_intervals(spark):
    keys = spark.range(600).selectExpr("lpad(cast(id % 2 AS string), 6, '0') AS cis_line_id", "id % 3 AS cis_trip_id", "if(id % 2 = 0, 'T', concat('T', id)) AS trip_id", "date_add(date '1999-12-20', cast(id % 7 AS int)) AS valid_from", "date_add(date '2000-12-31', cast(id % 5 AS int)) AS valid_to")
    observed = spark.range(300).selectExpr("id AS event_id", "lpad(cast(id % 2 AS string), 6, '0') AS cis_line_id", "id % 4 AS cis_trip_id", "date_add(date '2000-01-01', cast(id AS int)) AS service_date")
    rows, told = ran(resolve.road_trip(observed, keys, ["event_id"]))
    want = {k: "unmatched" if k % 4 == 3 else "resolved" if k % 2 == 0 else "ambiguous" for k in range(300)}
    assert {r.event_id: r.status for r in rows} == want and {r.trip_id for r in rows if r.status == "resolved"} == {"T"}
    assert most_joined(told) < 10_000


def test_runs_need_no_table_of_all_runs(spark):
    calls = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, None), ("a", 4, None), ("a", 5, "x"), ("b", 7, "x"), ("c", 1, None)], "trip_id string, sequence int, line_id string")
    rows, told = ran(derive.change_segments(calls, "line_id"))
    assert sorted(map(tuple, rows)) == [("a", 0, "x", 1, 2), ("a", 1, None, 3, 4), ("a", 2, "x", 5, 5), ("b", 0, "x", 7, 7), ("c", 0, None, 1, 1)]
    assert not [n for n, _ in told if "Aggregate" in n]


def test_attributes_of_one_span_meet_days_once(spark):
    journeys = spark.range(100).selectExpr("id AS journey_id", "if(id < 90, 'a', 'b') AS number", "date_add(date'2024-01-01', cast(id % 50 AS int)) AS service_date")
    attributes = spark.range(400).selectExpr("'a' AS number", "concat('x', id) AS attribute", "cast(id % 2 AS int) AS priority", "concat('s', 1000 - id) AS source_id", "date'2024-01-01' AS valid_from", "if(id % 2 = 0, date'2024-01-20', null) AS valid_to")
    rows, told = ran(export.dated_attributes(journeys, attributes, "number"))
    best = {k: min((f"s{1000 - i}", f"x{i}") for i in range(400) if i % 2 == k) for k in (0, 1)}
    assert len(rows) == 100 and all((r.source_id, r.attribute) == ((None, None) if r.number == "b" else best[0 if r.service_date.isoformat() <= "2024-01-20" else 1]) for r in rows)
    assert most_joined(told) <= 100


def test_calendar_days_are_told_after_exceptions_meet(spark):
    spans = "id string, f string, t string, weekday_mask int"
    calendars = spark.createDataFrame([("a", "2024-01-01", "2024-01-31", 127), ("a", "2024-01-30", "2024-02-02", 127), ("b", "2024-01-01", "2024-01-07", 1), (None, "2024-01-01", "2024-01-01", 127), ("d", None, "2024-01-01", 127)], spans)
    calendars = calendars.selectExpr("id AS service_id", "cast(f AS date) AS valid_from", "cast(t AS date) AS valid_to", "weekday_mask")
    exceptions = spark.createDataFrame([("a", "2024-01-31", False), ("a", "2024-01-02", False), ("a", "2024-01-02", True), ("b", "2024-05-01", True), ("b", "2024-05-01", True), ("c", "2024-06-01", True), ("c", None, True), ("c", "2024-06-01", None), (None, "2024-01-01", False)], "service_id string, d string, added boolean")
    rows, told = ran(derive.active_days(calendars, exceptions.selectExpr("service_id", "cast(d AS date) AS service_date", "added")))
    january = [f"2024-01-{k:02}" for k in range(1, 31)]
    expected = [("a", d) for d in [*january, "2024-02-01", "2024-02-02"]] + [("b", "2024-01-01"), ("b", "2024-05-01"), ("c", "2024-06-01"), ("c", "None")]
    assert sorted((r.service_id, str(r.service_date)) for r in rows) == sorted(expected)
    assert not [n for n, _ in told if "Join" in n] and max(n for name, n in told if "Aggregate" in name) <= 14


def test_compositions_meet_days_by_spans(spark):
    trains = spark.range(60).selectExpr("7 AS train_number", "date_add(date'2024-01-01', cast(id % 30 AS int)) AS service_date")
    compositions = spark.range(200).selectExpr("7 AS train_number", "date'2024-01-01' AS valid_from", "if(id < 3, date'2024-01-10', date'2024-03-01') AS valid_to", "if(id < 3, 1, if(id = 199, null, 2)) AS priority", "cast(id AS int) AS position", "'v' AS vehicle_type")
    rows, told = ran(overlay.train_composition(trains.filter("service_date <= '2024-01-10'"), compositions))
    assert sorted((r.service_date.day, r.position) for r in rows) == [(d, p) for d in range(1, 11) for p in range(3)]
    assert most_joined(told) <= 40
    assert overlay.train_composition(trains, compositions).count() == 30 + 20 * 196


def test_feeds_are_read_in_frames_of_bounded_rows(spark, small):
    rows = [{"entity_id": str(k), "kind": "vehicle", "trip_id": "t"} for k in range(25)]
    pdf = pd.DataFrame({"path": ["a", "b", "c"], "content": [realtime_feed.feed_of(rows, 1), b"\xff", realtime_feed.feed_of(rows, 2)]})
    frames = list(realtime_feed.row_frames(pdf, 10))
    assert [len(f) for f in frames] == [10, 10, 10, 10, 10, 1]
    whole = pd.concat(frames)
    assert whole.entity_id.dropna().tolist() == 2 * [str(k) for k in range(25)] and (whole.kind == "broken").sum() == 1
    assert [len(f) for f in realtime_feed.row_frames(pdf[:0], 10)] == [0]


def test_payloads_become_more_as_claims_do(spark, small, monkeypatch):
    held = []
    known = realtime_feed.feed_rows
    monkeypatch.setattr(realtime_feed, "feed_rows", lambda p: held.append(p.count()) or known(p))
    for size in (1 << 20, 1):
        monkeypatch.setattr(further, "FEED_ROWS", size)
        assert registry.queries()["feed_vehicles"](spark, small).count() == spark.read.parquet(f"{small}/events.parquet").count()
    assert held[1] > held[0]


def test_archives_become_more_as_texts_do(spark, small, monkeypatch):
    many = []
    known = archives.split_members
    monkeypatch.setattr(archives, "split_members", lambda s, folder, **o: many.append(len(os.listdir(folder.removeprefix("file:")))) or known(s, folder, **o))
    told = []
    for size in (1 << 40, 20_000):
        monkeypatch.setattr(further, "ARCHIVE_BYTES", size)
        told.append(sorted(map(tuple, registry.queries()["read_archives"](spark, small).collect())))
    assert told[0] == told[1] and many[0] == 8 and many[1] > 20


def test_ids_of_names_are_paired_last(spark):
    names = spark.range(400).selectExpr("cast(id as int) AS object_id", "concat('old gear ', cast(100 + id % 4 AS string)) AS _o")
    asked = spark.range(60).selectExpr("cast(id as int) AS point_id", "concat('old gear ', cast(100 + id % 2 AS string)) AS _p")
    rows, told = ran(matching.fuzzy_pairs(asked, names).select("point_id", "object_id"))
    assert len(rows) == len(set(rows)) == 60 * 400 and most_joined(told) < 1_000


def test_lists_of_ids_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(matching, "HELD", 7)
    names = spark.range(40).selectExpr("cast(id as int) AS object_id", "if(id < 30, 'hot bolt', 'hot bell') AS _o")
    asked = spark.range(20).selectExpr("cast(id as int) AS point_id", "if(id < 15, 'hot bolt', 'cold ring') AS _p")
    assert max(len(r.object_id) for r in matching._held(names, "_o", "object_id").collect()) == 7
    assert sorted((r.point_id, r.object_id) for r in matching.fuzzy_pairs(asked, names).collect()) == [(p, o) for p in range(15) for o in range(40)]


def test_kept_grams_that_an_edit_repeats_meet(spark):
    """The rarest gram that both keep may occur once more in one of them, before its place."""
    for one, other in (("aacacacbcbbbbcbbaacacb", "bacbcacbcbbbbcbbaacacb"), ("cabbaabcbbacbbbbcaabbbbac", "babbaacbbacbbbbcaabbbbac")):
        p, o = spark.createDataFrame([(1, one)], "point_id int, _p string"), spark.createDataFrame([(2, other)], "object_id int, _o string")
        assert [tuple(r) for r in matching.fuzzy_pairs(p, o).select("point_id", "object_id", "edits").collect()] == [(1, 2, 2)]


def test_a_message_is_read_once(spark):
    rows = spark.createDataFrame([("a", "<M><CZPTTInformation><CZPTTLocation><Location/></CZPTTLocation></CZPTTInformation></M>", 1), ("b", "<M><CZPTTInformation/></M>", 2)], "path string, content string, ord long")
    calls = readers.message_calls(readers.messages(rows))
    assert [(r.path, r.sequence) for r in calls.collect()] == [("a", 10)]
    assert calls._jdf.queryExecution().optimizedPlan().toString().count("from_xml(") == 1
    # a change's message is read by two schemas, once by each
    assert readers.changes(rows)._jdf.queryExecution().optimizedPlan().toString().count("from_xml(") == 2


def test_rows_without_a_target_are_spread(spark):
    rows = spark.range(4_000).selectExpr("concat('F', id) AS feature_id", "if(id % 10 = 0, concat('R', id % 7), null) AS route_id")
    keys = spark.range(5).selectExpr("concat('R', id) AS _r", "true AS _has__r")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        out = checks._found(rows, keys, ("route_id", "_r")).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(out) == 4_000 and all((r._r is not None) == (r.route_id in ("R0", "R1", "R2", "R3", "R4")) for r in out)
    count = [sum(r.task == k for r in out) for k in range(4)]
    assert max(count) < 1_600


def test_candidates_meet_calls_with_their_neighbours(spark):
    """A trip of many candidates and sure calls: no row for each pair of them, and the same candidates are ruled out."""
    calls = [("t", k, "own" if k in (31, 33, 190) else f"p{k}", k * 60 if k % 11 else None) for k in range(200)]
    made = spark.createDataFrame(calls, "trip_id string, sequence int, point_id string, seconds int")
    found = [(f"p{k}", "authority", k / 50, 50.0, "authority") for k in range(0, 200, 2)]
    found += [(p, f"o{n}", (k + n * n * 3) / 50, 50.0, "alias") for k, p in ((k, p) for _, k, p, _ in calls) if k % 2 or p == "own" for n in range(3)]
    found = sorted({(p, o): (p, o, x, y, m) for p, o, x, y, m in found}.values()) + [("p1", "null", None, 50.0, "alias")]
    rows, told = ran(matching.too_fast(spark.createDataFrame(found, "point_id string, object_id string, longitude double, latitude double, method string"), made))

    def fast(a, b, x, y):
        return math.radians(abs(x - y)) * math.cos(math.radians(50.0)) * 6371.0088 > abs(a - b) / 3600 * 150 + 2

    at = {p: x for p, _, x, _, m in found if m == "authority"}
    want = set()
    for point, o, x, _, m in found:
        stands = [(s, c, at.get(p, x)) for _, s, p, c in calls if c is not None and (p in at or p == point)] if m != "authority" and x is not None else []
        judged = [any(fast(c, stands[j][1], x, stands[j][2]) for j in (i - 1, i + 1) if 0 <= j < len(stands)) for i, (s, c, _) in enumerate(stands) if calls[s][2] == point]
        if judged and all(judged):
            want.add((point, o))
    assert {tuple(r) for r in rows} == want and 50 < len(want) < 290
    assert most_joined(told) <= 1_000


def test_rests_of_names_fit_the_lengths_beside_them(spark):
    """Names leave only rests that a name of the other side can have too, and those of one letter a few."""
    names = spark.createDataFrame([("abcdefghi",), ("other abcdefghi",), ("aaaaaaaaaaaaaaaaaaaa",)], "_o string")
    rests = lambda lengths: {r._o: r.n for r in matching._shortened(names, "_o", 2, spark.createDataFrame([("x" * n,) for n in lengths], "_p string")).groupBy("_o").agg(F.count("*").alias("n")).collect()}
    assert rests([9]) == {"abcdefghi": 36} and rests([11]) == {"abcdefghi": 1} and rests([10, 18]) == {"abcdefghi": 9, "aaaaaaaaaaaaaaaaaaaa": 1} and rests([30]) == {}


def test_a_packed_document_has_the_same_text_and_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    """Its members tell their sizes, so that it needn't be unpacked on the disk; calls without a trip, and trips without calls or twice, are as in the plain one."""
    monkeypatch.setattr(netex, "PIECE", 4_096)
    monkeypatch.setattr(netex, "READ", 2)
    relations = _relations(spark, 500)
    relations["trip"] = relations["trip"].filter("trip_id <> 'T7'").unionByName(spark.sql("SELECT stack(3, 'T8', 'T9', 'none') AS trip_id, 'R' AS route_id, 'S' AS service_id, 'again' AS headsign"))
    relations["agency"] = spark.createDataFrame([("A", "ž & <x>")], "agency_id string, name string")
    assert netex.write(relations, tmp_path / "a.xml", size=100) == netex.write(relations, tmp_path / "a.xml.gz", size=30) == netex.objects(relations).count() == 503
    plain = (tmp_path / "a.xml").read_bytes()
    assert gzip.decompress((tmp_path / "a.xml.gz").read_bytes()) == plain
    assert (tmp_path / "a.xml.gz").stat().st_size * 3 < len(plain) and len(netex.members(tmp_path / "a.xml.gz")) > 20
    read = lambda name: netex.read(spark, f"file://{tmp_path}/{name}", "ServiceJourney", netex.JOURNEY, lines=True)
    calls = lambda df: sorted(map(repr, netex.calls_of(df).collect()))
    assert read("a.xml.gz").rdd.getNumPartitions() > 5 and calls(read("a.xml.gz")) == calls(read("a.xml")) and len(calls(read("a.xml"))) == 2_004
    (tmp_path / "other.gz").write_bytes(gzip.compress(plain))
    with pytest.raises(ValueError, match="members"):
        netex.members(tmp_path / "other.gz")


def test_a_document_is_shuffled_as_values(spark, tmp_path, monkeypatch):
    """XML is made behind the only shuffle."""
    kind, plans = type(spark.range(0)), []
    write = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **k: plans.append(self._jdf.queryExecution().executedPlan().toString()) or write(self, *a, **k))
    netex.write(_relations(spark, 50), tmp_path / "a.xml")
    assert plans[0].count("Exchange ") == 1 and "passingTimes" not in plans[0][plans[0].index("Exchange ") :]
