"""Streams over the test events give what the batch functions give."""

import datetime

import pytest
from pyspark.sql import functions as F

from tramline.operators import derive, overlay, reconcile
from tramline.plans.projections import frames
from tramline.streaming import realtime


@pytest.fixture(scope="module")
def claims(spark, small, tmp_path_factory):
    """The claims as files, in three parts, so that a stream has several batches."""
    path = str(tmp_path_factory.mktemp("claims") / "c")
    batch = realtime.freshness(frames(spark, small, ["claim"])["claim"], 300).withColumn("event_time", F.col("event_time").cast("timestamp")).withColumn("received_time", F.col("received_time").cast("timestamp"))
    batch.repartition(3).write.parquet(path)
    batch = spark.read.parquet(path)
    return batch, spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_arbitration_stream_equals_batch(spark, claims, tmp_path):
    batch, stream = claims
    out = str(tmp_path / "best")
    state = {}

    def sink(part, n):
        before = [state["df"]] if "df" in state else []
        merged = part
        for df in before:
            merged = merged.unionByName(df)
        realtime.arbitrate(merged, ["trip_instance"]).write.parquet(f"{out}/{n}")
        state["df"] = spark.read.parquet(f"{out}/{n}")

    realtime.arbitration_stream(stream, sink, str(tmp_path / "cp")).start().awaitTermination()
    expected = realtime.arbitrate(batch, ["trip_instance"]).select("trip_instance", "capability", "claim_id")
    assert sorted(map(tuple, state["df"].select(*expected.columns).collect())) == sorted(map(tuple, expected.collect()))


def test_window_stream_equals_batch(spark, claims, tmp_path):
    batch, stream = claims
    realtime.downsampled_stream(stream, "trip_instance").writeStream.outputMode("complete").format("memory").queryName("hourly").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("hourly").collect())) == sorted(map(tuple, realtime.downsampled(batch, "trip_instance").collect()))


def test_dedupe_stream(spark, claims, tmp_path):
    batch, stream = claims
    realtime.deduplicated_stream(stream, ["trip_instance", "capability"], "40 days").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == batch.select("trip_instance", "capability").distinct().count()


def test_alerts_platforms_crossings(spark):
    alerts = spark.createDataFrame([(1, "Line 5: delay!", 0, 9, "r"), (2, " line 5 DELAY", 0, 9, "r"), (3, "line 5 delay", 1, 9, "r")], "alert_id int, text string, period_start int, period_end int, scope string")
    assert sorted((r.alert_id, r.copies) for r in realtime.same_alerts(alerts).collect()) == [(1, 2), (3, 1)]
    rows = spark.createDataFrame([(None, "2", None, "4"), (None, None, None, None)], "a string, b string, c string, d string")
    got = rows.select(realtime.platform(*map(F.col, "abcd")).alias("p")).collect()
    assert [(r.p.platform, r.p.origin) for r in got] == [("2", "operator"), (None, "unspecified")]
    moves = spark.createDataFrame([("v", 0, 0.0, 5.0), ("v", 10, 10.0, 5.0), ("v", 20, 12.0, 5.0)], "k string, seconds int, distance double, at double")
    assert [(r.at, r.crossed_seconds) for r in realtime.crossings(moves, "k", "at").collect()] == [(5.0, 5.0)]


def test_redirects_messages_snapshots(spark):
    r = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8), (8, 7)], "old_id int, new_id int")
    assert sorted(map(tuple, overlay.follow_redirects(r).collect())) == [(1, 4, "redirected"), (2, 4, "redirected"), (3, 4, "redirected"), (7, None, "cycle"), (8, None, "cycle")]
    day = datetime.date(2026, 7, 18)
    m = spark.createDataFrame([("t", day, 1, False, "a"), ("t", day, 2, True, "c"), ("u", day, 1, True, "x"), ("v", day, 3, False, "b")], "trip string, service_date date, ord int, cancels boolean, path string")
    assert [x.trip for x in overlay.apply_messages(m).collect()] == ["v"]
    assert [x.trip for x in overlay.unknown_cancellations(m).collect()] == ["u"]
    s = spark.createDataFrame([("s", "old", True, "2026-01-01 00:00:00"), ("s", "new", True, "2026-01-09 00:00:00"), ("s", "bad", False, "2026-01-09 12:00:00"), ("t", "stale", True, "2025-01-01 00:00:00")], "source string, snapshot string, usable boolean, at string").withColumn("retrieved_at", F.to_timestamp("at"))
    assert [(x.source, x.snapshot) for x in overlay.last_known_good(s, "source", "2026-01-10 00:00:00", "7 days").collect()] == [("s", "new")]


def test_candidates_and_bitmaps(spark):
    c = spark.createDataFrame([("a", 3, "x"), ("a", 1, "z"), ("a", 1, "y")], "k string, priority int, v string")
    assert [r.v for r in overlay.best_candidate(c, "k", "v").collect()] == ["y"]
    b = spark.createDataFrame([("1011", datetime.date(2026, 7, 18))], "bitmap string, start date")
    assert [str(r.service_date) for r in derive.bitmap_days(b, "bitmap", "start").collect()] == ["2026-07-18", "2026-07-20", "2026-07-21"]
    groups = overlay.stop_groups(spark.createDataFrame([("s1", None, "k"), ("s2", None, None), ("s3", "p", "k")], "stop_id string, parent string, key string"), "parent", "key").collect()
    assert [(r.stop_id, r.group) for r in groups] == [("s1", "key:k"), ("s2", "single:s2"), ("s3", "parent:p")]


def test_positions(spark):
    rows = spark.createDataFrame([(14.5, 50.0), (None, None)], "lon double, lat double")
    assert [r.p for r in rows.select(derive.position_wkt(F.col("lon"), F.col("lat")).alias("p")).collect()] == ["POINT(14.500000 50.000000)", None]
    with pytest.raises(Exception, match="both coordinates"):
        spark.createDataFrame([(14.5, None)], "lon double, lat double").select(derive.position_wkt(F.col("lon"), F.col("lat")).alias("p")).collect()


def test_paths_and_names(spark):
    rows = spark.createDataFrame([("a/b",), ("../a",), ("C:\\x",), ("/x",), ("a/..b",), ("A/B",)], "p string")
    assert sorted(r.p for r in reconcile.unsafe_paths(rows, "p").collect()) == ["../a", "/x", "C:\\x"]
    assert [tuple(r) for r in reconcile.case_duplicates(rows, "p").collect()] == [("a/b", 2)]


@pytest.mark.parametrize("length", [1, 2, 31, 32, 33, 40, 100])
def test_redirect_chains_of_any_length(spark, length):
    chain = [(k, k + 1) for k in range(length)]
    cycle = [(1_000 + k, 1_000 + (k + 1) % 7) for k in range(7)] + [(2_000, 2_001), (2_001, 1_003), (3_000, 3_000)]
    more = [(4_000, None), (4_001, 4_000), (5_000, 5_001), (5_000, 5_002), (5_003, 5_000), (6_000, 6_001), (6_000, 6_001)]
    got = {r.old_id: (r.final_id, r.status) for r in overlay.follow_redirects(spark.createDataFrame(chain + cycle + more, "old_id int, new_id int")).collect()}
    assert got == {
        **{k: (length, "redirected") for k in range(length)}, **{1_000 + k: (None, "cycle") for k in range(7)}, 2_000: (None, "cycle"), 2_001: (None, "cycle"), 3_000: (None, "cycle"),
        4_000: (None, "gone"), 4_001: (None, "gone"), 5_000: (None, "ambiguous"), 5_003: (5_000, "redirected"), 6_000: (6_001, "redirected"),
    }


def test_overlays_keep_repeated_rows(spark):
    calls = spark.createDataFrame([("t", 10, "a"), ("t", 10, "a"), ("t", 20, None)], "trip_id string, sequence int, line string")
    cover = spark.createDataFrame([("t", 5, 15, "x"), ("t", 1, 30, "y")], "trip_id string, from_sequence int, to_sequence int, line string")
    assert sorted((r.sequence, r.line) for r in overlay.segment_overlay(calls, cover, "line").collect()) == [(10, "y"), (10, "y"), (20, "y")]
    routes = spark.createDataFrame([("r", "A", "bus", 5, None), ("r", "A", "bus", 5, None), ("q", None, "bus", 5, 1)], "route_id string, agency_id string, mode string, route_number int, public_line int")
    rules = spark.createDataFrame([("A", 1, 9, None, None, "bus", "tram", "why")], "agency_id string, route_id_from int, route_id_to int, public_line_from int, public_line_to int, expected_mode string, effective_mode string, reason string")
    assert sorted((r.route_id, r.effective_mode) for r in overlay.mode_rules(routes, rules).collect()) == [("q", "bus"), ("r", "tram"), ("r", "tram")]


def test_authoritative_conflicts_block(spark):
    base = spark.createDataFrame([("k", "f", "b")], "id string, field string, value string")
    claims = lambda mode: spark.createDataFrame([("k", "f", "x", "s1", mode, 1), ("k", "f", "y", "s2", mode, 1)], "id string, field string, value string, source_id string, mode string, priority int")
    rules = {m: (r.value, r.rule) for m in ("authoritative", "preferred") for r in overlay.overlay(base, claims(m), ["id"]).collect()}
    assert rules == {"authoritative": ("b", "blocking"), "preferred": ("b", "conflict")}


def test_operational_points_and_adjacent_trips(spark):
    calls = spark.createDataFrame([("t", 1, False, 1.0), ("t", 2, True, None), ("t", 3, False, 1.0), ("t", 4, False, None), ("t", 5, True, 1.0), ("t", 6, False, 1.0), ("u", 1, False, 1.0)], "trip_id string, sequence int, passenger_service boolean, longitude double")
    shown = lambda mode: sorted(r.sequence for r in overlay.operational_points(calls, mode).filter("published").collect())
    assert (shown("gtfs"), shown("sidecar")) == ([2, 3, 5], [2, 5])
    rows = [("a", 1, "CZ", 0.0), ("a", 2, "CZ", 9.0), ("b", 1, "DE", 0.0), ("c", 1, "CZ", 0.0), ("c", 2, "DE", 59.0), ("d", 1, "CZ", 0.0), ("d", 2, "DE", 61.0), ("d", 3, "DE", 200.0), ("e", 1, "CZ", 0.0), ("e", 2, "FR", 5.0), ("f", 1, "CZ", 0.0), ("f", 2, "DE", 100.0), ("f", 3, "CZ", 119.0)]
    frame = spark.createDataFrame([(*r, False) for r in rows], "trip_id string, sequence int, country string, distance_km double, integrated boolean")
    got = {r.trip_id: (r.disposition, r.depth_km) for r in overlay.regional_adjacent(frame, "CZ", ["DE", "PL"]).collect()}
    assert got == {"a": ("domestic", 0.0), "b": ("foreign", 0.0), "c": ("adjacent", 59.0), "d": ("rejected", 200.0), "e": ("rejected", 5.0), "f": ("adjacent", 19.0)}


def test_stop_events(spark):
    positions = spark.createDataFrame([("v", 0.0, 0.0), ("v", 100.0, 100.0), ("v", 160.0, 100.5), ("v", 200.0, 300.0), ("v", 210.0, 900.0)], "key string, seconds double, distance double")
    stops = spark.createDataFrame([("v", "a", 100.25), ("v", "b", 600.0), ("v", "c", 890.0)], "key string, stop_id string, at double")
    got = {r.stop_id: (r.arrival, r.departure, r.passage) for r in realtime.stop_events(positions, stops, "key").collect()}
    assert got["a"][0] == pytest.approx(70.25) and got["a"][1] == pytest.approx(160 + 40 * 29.75 / 199.5) and got["a"][2] is None
    assert got["b"][:2] == (None, None) and got["b"][2] == pytest.approx(205.0)
    assert got["c"][0] == pytest.approx(200 + 10 * 560 / 600) and got["c"][1:] == (None, None)


def test_a_query_goes_over_to_a_new_build_between_batches(spark, tmp_path):
    maps = {7: "old", 8: "new", 9: "newest"}
    shown, out, fail = [7], [], [2]
    spark.range(5).selectExpr("CAST(id AS STRING) AS source_trip_id").repartition(5, "source_trip_id").write.option("maxRecordsPerFile", 1).parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source_trip_id string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def sink(df, n):
        rows = df.collect()
        if n in fail:
            raise RuntimeError("the sink is down")
        out.append((n, {(r.build_id, r.trip_id) for r in rows}))
        if n == 0:
            shown[0] = 8

    def query():
        realtime.resolution_stream(stream, lambda b, build: b.withColumn("trip_id", F.lit(maps[build])), lambda: shown[0], sink, str(tmp_path / "checkpoint")).start().awaitTermination()

    with pytest.raises(Exception, match="the sink is down"):
        query()
    shown[0] = 9
    fail.clear()
    query()
    # the batch that failed keeps the build that was shown when it began
    assert out == [(0, {(7, "old")}), (1, {(8, "new")}), (2, {(8, "new")}), (3, {(9, "newest")}), (4, {(9, "newest")})]
    assert realtime.Epochs(spark, str(tmp_path / "checkpoint")).of(2) == 8


def test_observations_by_day(spark, tmp_path):
    rows = spark.sql("SELECT id AS claim_id, timestamp'2031-01-01 23:00:00' + make_interval(0, 0, 0, 0, id) AS event_time FROM range(4)")
    for _ in range(2):
        realtime.write_observations(rows, str(tmp_path / "o"))
    assert {(str(r.date), r["count"]) for r in spark.read.parquet(str(tmp_path / "o")).groupBy("date").count().collect()} == {("2031-01-01", 2), ("2031-01-02", 6)}
