"""Readers of source formats, on small files written here."""

import gzip
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tramline.functions import identifiers
from tramline.sources import readers

MESSAGE = """<?xml version="1.0"?>
<x:CZPTTCISMessage xmlns:x="urn:x"><x:Identifiers>
 <PlannedTransportIdentifiers><ObjectType>TR</ObjectType><Company>0054</Company><Core>000009001</Core><Variant>01</Variant><TimetableYear>2026</TimetableYear></PlannedTransportIdentifiers>
 <PlannedTransportIdentifiers><ObjectType>PA</ObjectType><Company>0054</Company><Core>{core}</Core><Variant>00</Variant><TimetableYear>2026</TimetableYear></PlannedTransportIdentifiers></x:Identifiers>
 <CZPTTInformation><CZPTTLocation><Location><CountryCodeISO>CZ</CountryCodeISO><LocationPrimaryCode>09001</LocationPrimaryCode><PrimaryLocationName>A</PrimaryLocationName></Location>
  <TimingAtLocation><Timing TimingQualifierCode="ALD"><Time>08:00:00</Time><Offset>0</Offset></Timing></TimingAtLocation><OperationalTrainNumber>9001</OperationalTrainNumber><TrainActivity><TrainActivityType>0001</TrainActivityType></TrainActivity></CZPTTLocation>
 <CZPTTLocation><Location><CountryCodeISO>CZ</CountryCodeISO><LocationPrimaryCode>09002</LocationPrimaryCode><PrimaryLocationName>B</PrimaryLocationName></Location>
  <TimingAtLocation><Timing TimingQualifierCode="ALD"><Time>00:12:00.0</Time><Offset>1</Offset></Timing></TimingAtLocation></CZPTTLocation>
 <PlannedCalendar><BitmapDays>1011</BitmapDays><ValidityPeriod><StartDateTime>2026-07-18T00:00:00</StartDateTime></ValidityPeriod></PlannedCalendar></CZPTTInformation></x:CZPTTCISMessage>"""


def test_messages(spark):
    rows = spark.createDataFrame([("a", MESSAGE.format(core="A1"))], "path string, content string")
    parsed = readers.messages(rows)
    assert parsed.first().root == "CZPTTCISMessage"
    calls = readers.message_calls(parsed).orderBy("sequence").collect()
    assert [(c.sequence, c.code, c.scheduled_departure, c.scheduled_passage) for c in calls] == [(10, "09001", 28800, None), (20, "09002", None, 87120)]
    ids = parsed.select(readers.message_identity(F.col("message.Identifiers.PlannedTransportIdentifiers")).alias("i")).first().i
    assert ids == "PA/0054/A1/00/2026|TR/0054/000009001/01/2026"


def packed(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark, tmp_path):
    inner = packed({"2.xml": b"<b/>", "skip.txt": b""})
    (tmp_path / "a.zip").write_bytes(packed({"z.xml": b"<z/>", "in.zip": inner}))
    got = [(r.member, bytes(r.content)) for r in readers.archive_members(spark, str(tmp_path)).orderBy("member").collect()]
    assert got == [("in.zip!2.xml", b"<b/>"), ("z.xml", b"<z/>")]


@pytest.mark.parametrize("members", [{"../x.xml": b""}, {"A.xml": b"", "a.xml": b""}])
def test_unsafe_archives(spark, tmp_path, members):
    (tmp_path / "a.zip").write_bytes(packed(members))
    with pytest.raises(Exception, match="unsafe member|repeat but for case"):
        readers.archive_members(spark, str(tmp_path)).collect()


def test_gzip_by_content(spark, tmp_path):
    (tmp_path / "m.xml.zip").write_bytes(gzip.compress(b"<m/>"))
    assert [bytes(r.content) for r in readers.gzip_objects(spark, str(tmp_path)).collect()] == [b"<m/>"]
    assert readers.file_manifest(spark, str(tmp_path)).count() == 1


def test_delimited_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffstop_id,name\n007,\"a, b\"\n", encoding="utf-8")
    assert [tuple(r) for r in readers.csv_rows(spark, str(tmp_path / "a.csv"), ["stop_id", "name"]).collect()] == [("007", "a, b")]
    (tmp_path / "c.csv").write_text("123456,X,50.1,14.2\n12345,Y,50.1,14.2\n22222,Z,bad,1\n33333,a,1,2\n33333,b,1,3\nshort\n")
    assert [tuple(r) for r in readers.reference_coordinates(spark, str(tmp_path / "c.csv")).collect()] == [("12345", 14.2, 50.1)]
    (tmp_path / "j.txt").write_bytes('"1";"Žďár; x";\r\n"2";"Plzeň";\r\n'.encode("cp1250"))
    got = readers.encoded_rows(spark, str(tmp_path / "j.txt"), ["id", "name"]).select("line", "id", "name").orderBy("line").collect()
    assert [tuple(r) for r in got] == [(1, "1", "Žďár; x"), (2, "2", "Plzeň")]


def test_listing_and_logs(spark):
    page = """<a href="b/">b</a> <A class=x HREF='a.zip'>a</A> <a href=c>c</a> <a href="b/">again</a> <p href="no">"""
    assert readers.listing_links(spark.createDataFrame([(page,)], "html string")).first().links == ["a.zip", "b/", "c"]
    lines = spark.createDataFrame([('\x1b[31mERROR\x1b[0m bad',), ('EVENT {"k": 1}',), ("EVENT {broken",)], "line string")
    got = readers.log_events(lines, "line", "EVENT ", "k int").collect()
    assert [(r.severity, r.event.k if r.event else None) for r in got] == [("error", None), (None, 1), (None, None)]


def test_long_log_event(spark):
    lines = spark.createDataFrame([('EVENT {"x": "' + "y" * (1 << 20) + '", "k": 1}',)], "line string")
    assert readers.log_events(lines, "line", "EVENT ", "k int").first().event.k == 1


def test_stop_identity_keeps_plus(spark):
    r = spark.createDataFrame([("-CZPTT-CZ:1%3A2:a+b",)], "s string").select(readers.stop_identity(F.col("s")).alias("x")).first().x
    assert (list(r.parts), r.parent) == (["-CZPTT-CZ", "1:2", "a+b"], "-CZPTT-CZ:1%3A2")


def test_tagged_nodes(spark):
    rows = [(1, {"railway": "halt"}), (2, {"highway": "bus_stop"}), (3, {"railway": "tram_stop"}), (4, {"x": "y"}), (5, None)]
    nodes = spark.createDataFrame(rows, "id long, tags map<string,string>")
    ids = lambda tags: [r.id for r in readers.tagged_nodes(nodes, tags).orderBy("id").collect()]
    assert ids(readers.RAILWAY_TAGS) == [1] and ids(readers.TRANSIT_TAGS) == [2, 3]
    again = nodes.withColumn("type", F.lit("n")).withColumn("version", F.lit(1))
    assert readers.merged_nodes(again.drop("tags"), again.drop("tags")).count() == 5


def test_identifiers(spark):
    rows = spark.createDataFrame([("001588", 0, 5), ("1588", -1, 0), ("001588\n", None, None), ("", 3, 9)], "line string, trip long, train int")
    got = rows.select(identifiers.is_line(F.col("line")).alias("a"), identifiers.is_trip_number(F.col("trip")).alias("b"), identifiers.is_train_number(F.col("train")).alias("c"), identifiers.is_public_id(F.col("line")).alias("d")).collect()
    assert [tuple(r) for r in got] == [(True, True, True, True), (False, False, False, True), (False, None, None, True), (False, True, True, False)]
    assert [identifiers.timetable_year(*x) for x in ((2025, 12, 13), (2025, 12, 14), (2026, 1, 1))] == [2025, 2026, 2026]
    years = spark.createDataFrame([(2019,), (2024,), (2025,), (2026,)], "y int").select(identifiers.timetable_change(F.col("y")).alias("d")).collect()
    assert [str(r.d) for r in years] == ["2019-12-08", "2024-12-08", "2025-12-14", "2026-12-13"]
    assert [str(identifiers.second_sunday(y)) for y in (2019, 2024, 2025, 2026)] == [str(r.d) for r in years]
    assert identifiers.jobs("auto") == "auto" and identifiers.jobs("4") == 4
    assert identifiers.memory("10GiB") == 10 * 2**30
    for bad in ("0", "-1", "x", ""):
        with pytest.raises(ValueError):
            identifiers.jobs(bad)


def test_listing_names(spark):
    pages = ["<a href='a/b.zip'>x</a><a href=\"c%26&amp;d/\">y</a><a href=../>z</a>", "total 2\n-rw 1 one.gz\n\n  \n..\n.\nsub/two.gz \r\n", "", None]
    rows = readers.listing_names(spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "k int, html string")).orderBy("k").collect()
    assert [r.names for r in rows] == [["b.zip", "c%26&d"], ["2", "one.gz", "two.gz"], [], []]


def message(root, core, bits, start="2031-03-01T00:00:00", variant="00"):
    ids = f"<n:PlannedTransportIdentifiers><ObjectType>TR</ObjectType><Company>9001</Company><Core>{core}</Core><Variant>{variant}</Variant><TimetableYear>2031</TimetableYear></n:PlannedTransportIdentifiers>"
    calendar = f"<PlannedCalendar><BitmapDays>{bits}</BitmapDays><ValidityPeriod><StartDateTime>{start}</StartDateTime></ValidityPeriod></PlannedCalendar>"
    inner = f"<Identifiers>{ids}</Identifiers><CZPTTInformation>{calendar}</CZPTTInformation>" if root == readers.TIMETABLE else ids + calendar
    return f'<?xml version="1.0"?><n:{root} xmlns:n="urn:n">{inner}</n:{root}>'


def test_cancellations_alter_calendars(spark):
    from tramline.operators import overlay

    xml = [message(readers.TIMETABLE, "0A", "1011"), message(readers.CANCELLATION, "0A", "11", "2031-03-03T00:00:00"), message(readers.TIMETABLE, "0B", "1"), message(readers.CANCELLATION, "0C", "1"), message(readers.TIMETABLE, "0A", "1", "2031-03-04T00:00:00")]
    rows = spark.createDataFrame([(f"m{k}", k, x) for k, x in enumerate(xml)], "path string, ord int, content string")
    found = readers.changes(rows).cache()
    days = sorted((r.trip.split("/")[2], str(r.service_date), r.path) for r in overlay.apply_messages(found).collect())
    assert days == [("0A", "2031-03-01", "m0"), ("0A", "2031-03-04", "m4"), ("0B", "2031-03-01", "m2")]
    assert [(r.path, r.trip.split("/")[2]) for r in overlay.unknown_cancellations(found).collect()] == [("m3", "0C")]
    for bad, said in (("<x/>", "unknown message"), (message(readers.TIMETABLE, "0A", "1").replace("<Core>0A</Core>", ""), "no full identity")):
        with pytest.raises(Exception, match=said):
            readers.changes(spark.createDataFrame([("p", 0, bad)], "path string, ord int, content string")).collect()


def test_payloads_and_severities(spark):
    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, "{"), (3, None)], "k int, body string")
    got = {r.k: (r.payload and r.payload.a, r.broken) for r in readers.json_payloads(rows, "body", "a int").collect()}
    assert got[1] == (1, False) and got[2][1] and got[3] == (None, True)
    events = spark.createDataFrame([("Error",), ("warning",), (None,)], "severity string")
    assert readers.errors_of(events).count() == 1


def test_numbers_dates_and_identifiers(spark):
    from tramline.functions import identifiers
    from tramline.operators import derive, reconcile

    times = ["08:00:00+02:00", "8:05", "23:59:59.7Z", "08:00:00.0000000+01:00", "nonsense", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(times)], "k int, t string")
    assert [r[0] for r in rows.orderBy("k").select(derive.local_seconds(F.col("t"), F.lit("-1"))).collect()] == [28_800 - 86_400, 29_100 - 86_400, 86_399 - 86_400, 28_800 - 86_400, None, None]
    with pytest.raises(Exception, match="no number"):
        reconcile.with_numbers(rows, "t").collect()
    instants = spark.sql("SELECT timestamp'2026-12-12 22:59:59' AS a, timestamp'2026-12-12 23:00:00' AS b")
    assert tuple(instants.select(identifiers.year_of(F.col("a")), identifiers.year_of(F.col("b"))).first()) == (2026, 2027)
    for kind, good, bad in (("public_id", "x", ""), ("line", "001234", "1234"), ("trip_number", 0, True), ("train_number", 1, 0), ("trip_number", 5, -1), ("line", "000000", 0), ("public_id", "a", "a\0")):
        assert identifiers.checked(kind, good) == good
        with pytest.raises(ValueError):
            identifiers.checked(kind, bad)
    assert reconcile.exists(rows) and not reconcile.exists(rows.filter("false"))
    assert spark.range(1).select(reconcile.overlapping(F.array(F.lit(1), F.lit(None)), F.array(F.lit(None), F.lit(1))), reconcile.overlapping(F.array(F.lit(None).cast("int")), F.array(F.lit(None).cast("int")))).first() == (True, False)


def test_line_segments_share_their_ends(spark):
    from tramline.operators import derive

    calls = [("t", k, v) for k, v in enumerate([None, None, "A", "A", "A", None, None, "B", "C", None], 1)] + [("u", 1, None), ("v", 1, "A"), ("v", 2, "A"), ("w", 1, None), ("w", 2, "A"), ("w", 3, None)]
    got = sorted(((r.trip_id, r.from_sequence, r.to_sequence, r.line) for r in derive.line_segments(spark.createDataFrame(calls, "trip_id string, sequence int, line string"), "line").collect()), key=str)
    assert got == [("t", 1, 3, None), ("t", 3, 5, "A"), ("t", 5, 8, None), ("t", 8, 9, "B"), ("t", 9, 10, None), ("u", 1, 1, None), ("v", 1, 2, "A"), ("w", 1, 2, None), ("w", 2, 3, None)]


def test_archives_in_place(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("c.xml", "<c/>")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("b.xml", "<b/>")
        z.writestr("n.zip", inner.getvalue())
        z.writestr("x.txt", "no")
    both = [sorted((r.member, bytes(r.content), r.bytes) for r in readers.archive_members(spark, str(tmp_path), in_place=x).collect()) for x in (False, True)]
    assert both[0] == both[1] == [("b.xml", b"<b/>", 4), ("n.zip!c.xml", b"<c/>", 4)]
