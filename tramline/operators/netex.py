"""A NeTEx document of the relations: elements made by Spark, nested by aggregation, put in order and written in pieces by many tasks.

Each object is a row: its list, its place in it and its XML. Ranges of the rows in order are written side by side, and joined between the frames' ends. A ledger decides what a claim may become: a claim is never told as more than its resolution says; what has no standard place goes
into an extension of a namespace of its own. Texts lose characters that XML forbids. The document isn't checked against the published schema here.
"""

from __future__ import annotations

import os
import shutil
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import joined
from .overlay import through_ledger

#: Fixed: the standard's namespace and version.
NAMESPACE, VERSION = "http://www.netex.org.uk/netex", "2.0"
EXTENSION = "urn:tramline:netex:1"
#: Bytes of text from which on a member of a .gz ends, and members that a task reads.
PIECE, READ = 4 << 20, 16
#: The head of a member: marks of gzip with an extra field, no time, and a field of this name with the member's size.
HEAD, MAGIC, FIELD = struct.Struct("<4sIBBH2sHI"), b"\x1f\x8b\x08\x04", b"TL"
#: Frames in their order, with the list that holds their objects; the calendar's has two.
FRAMES = (
    ("ResourceFrame", ("organisations",)),
    ("SiteFrame", ("stopPlaces",)),
    ("ServiceFrame", ("lines", "timingPoints", "notices")),
    ("ServiceCalendarFrame", ("dayTypes", "dayTypeAssignments")),
    ("TimetableFrame", ("vehicleJourneys", "journeyInteractions", "extensions")),
)
LISTS = [name for _, own in FRAMES for name in own]
# Fixed: the standard's names of modes and days.
MODES = {"bus": "bus", "tram": "tram", "rail": "rail", "trolleybus": "trolleyBus", "metro": "metro", "ferry": "water"}
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
# Fixed: what a connection claim becomes by its resolution.
LEDGER = [
    ("connection_claim", "trip", "ServiceJourneyInterchange", "ConnectionClaim", "resolved"),
    ("connection_claim", "route", "InterchangeRule", "ConnectionClaim", "pattern"),
    ("connection_claim", "none", None, "ConnectionClaim", None),
]
#: The fields that the document holds, by relation.
MAPPED = {
    "agency": "agency_id name",
    "location": "location_id kind parent_location_id name longitude latitude",
    "route": "route_id agency_id mode short_name",
    "service_calendar": "service_id valid_from valid_to weekday_mask",
    "service_exception": "service_id service_date added",
    "trip": "trip_id route_id service_id headsign",
    "trip_call": "trip_id sequence location_id boarding_point_id passenger_service scheduled_arrival scheduled_departure scheduled_passage",
    "service_note": "note_id kind label text",
    "connection_claim": "connection_id direction origin_trip_id origin_sequence target_trip_id target_route_id wait_minutes resolution_status",
}


def escaped(text: Column) -> Column:
    text = text.cast("string")
    plain = F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f￾￿]", "")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#9;")):
        plain = F.replace(plain, F.lit(mark), F.lit(name))
    # most texts have none of these
    return F.when(text.rlike("[&<>\"\\x00-\\x1f\ufffe\uffff]"), plain).otherwise(text)


def element(name: str, *inner: Column, **attributes: Column) -> Column:
    """An element with its attributes that aren't null; inner parts that are null are left out."""
    head = [F.coalesce(F.concat(F.lit(f' {k.rstrip("_")}="'), escaped(v), F.lit('"')), F.lit("")) for k, v in attributes.items()]
    return F.concat(F.lit(f"<{name}"), *head, F.lit(">"), *[F.coalesce(x, F.lit("")) for x in inner], F.lit(f"</{name}>"))


def text(name: str, value: Column) -> Column:
    """An element of a text, null for null."""
    return F.concat(F.lit(f"<{name}>"), escaped(value), F.lit(f"</{name}>"))


def number(name: str, value: Column) -> Column:
    """text() of what needs no escapes."""
    return F.concat(F.lit(f"<{name}>"), value.cast("string"), F.lit(f"</{name}>"))


def ref(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), element(name, ref=value))


def _version(**more: Column) -> dict[str, Column]:
    return {**more, "version": F.lit("1")}


def _clock(name: str, seconds: Column) -> Column:
    """A time of the day and, from the second day on, the days it lies behind."""
    day = F.floor(seconds / 86_400).cast("int")
    rest = seconds - day * 86_400
    at = F.concat_ws(":", *[F.lpad(F.floor(x).cast("string"), 2, "0") for x in (rest / 3_600, rest % 3_600 / 60, rest % 60)])
    return F.when(seconds.isNotNull(), F.concat(number(f"{name}Time", at), F.when(day != 0, number(f"{name}DayOffset", day)).otherwise(F.lit(""))))


def _gathered(rows: DataFrame, key: str, columns: list[str], xml: Callable[[Column], Column], name: str) -> DataFrame:
    """(key, name): the parts of each key in the order of the columns, one after another. Values are shuffled, not the longer XML that is made of them."""
    own = rows.select(F.col(key).alias("_key"), F.struct(*columns).alias("x"))
    return own.groupBy("_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), xml), "").alias(name)).withColumnRenamed("_key", key)


def objects(relations: dict[str, DataFrame], namespace_prefix: str = "x") -> DataFrame:
    """(list, id, xml) of all relations that are given; those not given have no objects."""
    return _rendered(_valued(relations, namespace_prefix))


def _call(c: Column) -> Column:
    point = F.when(c["passenger_service"], ref("StopPointRef", c["location_id"])).otherwise(ref("TimingPointRef", c["location_id"]))
    return element(
        "TimetabledPassingTime", point, ref("QuayRef", c["boarding_point_id"]), _clock("Arrival", c["scheduled_arrival"]), _clock("Departure", c["scheduled_departure"]),
        _clock("Passing", c["scheduled_passage"]), order=c["sequence"],
    )


def _rendered(values: DataFrame) -> DataFrame:
    """(list, id, xml) of _valued(): the journeys of an id with all its calls in their order, and other objects as they are.

    Rows that were dealt by ranges of list and id aren't shuffled again.
    """
    if "call" not in values.columns:
        return values.select("list", "id", "xml")
    parts = values.groupBy("list", "id").agg(F.array_sort(F.collect_list("call")).alias("_calls"), F.collect_list(F.when(F.col("call").isNull(), F.struct("xml", "trip"))).alias("_own"))
    rows = parts.select("list", "id", "_calls", F.explode("_own").alias("_own")).select("list", "id", "_calls", "_own.xml", "_own.trip")
    times = F.when(F.size("_calls") > 0, F.concat(F.lit("<passingTimes>"), F.array_join(F.transform("_calls", _call), ""), F.lit("</passingTimes>")))
    trip = F.col("trip")
    journey = element("ServiceJourney", text("DestinationDisplay", trip["headsign"]), element("dayTypes", ref("DayTypeRef", trip["service_id"])), ref("LineRef", trip["route_id"]), times, **_version(id=trip["trip_id"]))
    return rows.select("list", "id", F.when(trip.isNotNull(), journey).otherwise(F.col("xml")).alias("xml"))


def _valued(relations: dict[str, DataFrame], namespace_prefix: str) -> DataFrame:
    """(list, id, xml) of all relations that are given, and of journeys, in place of the far longer XML, what it is made of: (trip) and, as rows of their own with the trip's id, (call)."""
    out: list[DataFrame] = []
    has = relations.__contains__

    def add(rows: DataFrame, where: str, key: str, xml: Column, **values: Column) -> None:
        out.append(rows.select(F.lit(LISTS.index(where)).alias("list"), F.col(key).cast("string").alias("id"), xml.cast("string").alias("xml"), *[v.alias(k) for k, v in values.items()]))

    if has("agency"):
        add(relations["agency"], "organisations", "agency_id", element("Operator", text("Name", F.col("name")), **_version(id=F.col("agency_id"))))
    if has("location"):
        locations = relations["location"]

        def centroid(lon: Column, lat: Column) -> Column:
            return F.when(lon.isNotNull() & lat.isNotNull(), element("Centroid", element("Location", text("Longitude", lon), text("Latitude", lat))))

        there = centroid(F.col("longitude"), F.col("latitude"))
        quay = lambda q: element("Quay", text("Name", q["name"]), centroid(q["longitude"], q["latitude"]), **_version(id=q["location_id"]))
        quays = _gathered(locations.filter("kind = 'boarding_point'"), "parent_location_id", ["location_id", "name", "longitude", "latitude"], quay, "_quays")
        places = locations.filter("kind = 'stop_place'").join(quays.withColumnRenamed("parent_location_id", "_place"), F.col("location_id") == F.col("_place"), "left")
        inner = F.when(F.col("_quays").isNotNull(), F.concat(F.lit("<quays>"), "_quays", F.lit("</quays>")))
        add(places, "stopPlaces", "location_id", element("StopPlace", text("Name", F.col("name")), there, inner, **_version(id=F.col("location_id"))))
        add(locations.filter("kind = 'operational_point'"), "timingPoints", "location_id", element("TimingPoint", text("Name", F.col("name")), there, **_version(id=F.col("location_id"))))
    if has("route"):
        mode = reduce(lambda c, m: c.when(F.col("mode") == m[0], F.lit(m[1])), MODES.items(), F.when(F.lit(False), "")).otherwise("other")
        name = text("Name", F.col("short_name")) if "short_name" in relations["route"].columns else F.lit("")
        add(relations["route"], "lines", "route_id", element("Line", name, text("TransportMode", mode), ref("OperatorRef", F.col("agency_id")), **_version(id=F.col("route_id"))))
    if has("service_note"):
        add(relations["service_note"], "notices", "note_id", element("Notice", text("Name", F.col("label")), text("Text", F.col("text")), text("TypeOfNotice", F.col("kind")), **_version(id=F.col("note_id"))))
    if has("service_calendar"):
        days = F.array_join(F.filter(F.array(*[F.when(F.col("weekday_mask").bitwiseAND(1 << k) > 0, F.lit(d)) for k, d in enumerate(DAYS)]), lambda d: d.isNotNull()), " ")
        add(relations["service_calendar"], "dayTypes", "service_id", element("DayType", element("PropertyOfDay", text("DaysOfWeek", days)), **_version(id=F.col("service_id"))))
        period = element("DayTypeAssignment", text("FromDate", F.col("valid_from")), text("ToDate", F.col("valid_to")), ref("DayTypeRef", F.col("service_id")), text("isAvailable", F.lit("true")), **_version(id=F.concat("service_id", F.lit(":period"))))
        add(relations["service_calendar"], "dayTypeAssignments", "service_id", period)
    if has("service_exception"):
        one = element("DayTypeAssignment", text("Date", F.col("service_date")), ref("DayTypeRef", F.col("service_id")), text("isAvailable", F.col("added")), **_version(id=F.concat("service_id", F.lit(":"), "service_date")))
        add(relations["service_exception"].withColumn("_id", F.concat("service_id", F.lit(":"), "service_date")), "dayTypeAssignments", "_id", one)
    if has("trip") and has("trip_call"):
        fields = MAPPED["trip_call"].split()[1:]
        add(relations["trip"], "vehicleJourneys", "trip_id", F.lit(None), trip=F.struct(*MAPPED["trip"].split()))
        add(relations["trip_call"].filter("trip_id IS NOT NULL"), "vehicleJourneys", "trip_id", F.lit(None), call=F.struct(*fields))
    if has("connection_claim"):
        claims = claimed(relations["connection_claim"])
        journeys = [ref("FromJourneyRef", F.col("origin_trip_id")), ref("ToJourneyRef", F.col("target_trip_id"))]
        lines = [ref("FeederJourneyRef", F.col("origin_trip_id")), ref("DistributorLineRef", F.col("target_route_id"))]
        wait = text("MaximumWaitTime", F.concat(F.lit("PT"), F.col("wait_minutes"), F.lit("M")))
        for target, parts in (("ServiceJourneyInterchange", journeys), ("InterchangeRule", lines)):
            add(claims.filter(F.col("target") == target), "journeyInteractions", "connection_id", element(target, wait, *parts, **_version(id=F.col("connection_id"))))
        whole = [text(f"{namespace_prefix}:{c}", F.col(c)) for c in MAPPED["connection_claim"].split() if c in claims.columns]
        add(claims, "extensions", "connection_id", element(f"{namespace_prefix}:ConnectionClaim", *whole))
    if not out:
        raise ValueError("there is no relation to write")
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), out)


def claimed(claims: DataFrame) -> DataFrame:
    """Connection claims with target and standard: a claim on a journey needs to be resolved, one on a line at least a pattern, and any other is an extension only."""
    spark = claims.sparkSession
    ledger = spark.createDataFrame(LEDGER, "relation string, kind string, standard_target string, extension_target string, needs string")
    kind = F.when(F.col("target_trip_id").isNotNull() & (F.col("resolution_status") == "resolved"), "trip").when(F.col("target_route_id").isNotNull() & F.col("resolution_status").isin("resolved", "pattern"), "route").otherwise("none")
    rows = claims.withColumns({"relation": F.lit("connection_claim"), "kind": kind, "resolution": F.col("resolution_status")})
    return through_ledger(rows, F.broadcast(ledger)).drop("relation", "kind", "resolution")


def write(relations: dict[str, DataFrame], path: str | os.PathLike, publication: str = "tramline", prefix: str = "x", size: int = joined.GROUP) -> int:
    """Writes the document; the number of its objects. Objects of a list go by id and by their text, each on a line of its own, so equal relations give equal bytes.

    A path that ends in .gz gets a gzip file of the same text, in members of some PIECE bytes of text that end with a line and tell their sizes, so that
    many tasks can read it; any gzip tool reads it whole. Where members end depends on the ranges, the text doesn't.

    Values are dealt out, and XML is made of them where it is written. Ranges of the objects, of some ``size`` each, are written side by side, a file for each list and range. They are joined between what begins and ends
    the lists, and go as they are joined: what is written is on the disk once.
    """
    values = _valued(relations, prefix)
    ranges = max(1, -(-sum(df.count() for name, df in relations.items() if name != "trip_call") // size))
    spread = _rendered(values.repartitionByRange(ranges, "list", "id")).sortWithinPartitions("list", "id", "xml").select("list", "xml", F.spark_partition_id().alias("part"))
    whole = str(Path(path).resolve())
    folder = f"{whole}.{uuid.uuid4().hex}.parts"
    os.makedirs(folder)
    packed = whole.endswith(".gz")
    encode = _member if packed else bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, own, file, now, held = [], "", None, None, bytearray()

        def flush() -> None:
            if held:
                file.write(encode(held))
                held.clear()

        for batch in batches:
            for k, xml, part in zip(*(c.to_pylist() for c in batch.columns)):
                if k != now:
                    if file is not None:
                        flush()
                        file.close()
                    now, own = k, f"{uuid.uuid4().hex}.part"
                    file = open(f"{folder}/{own}", "wb")
                    told.append([k, part, own, 0])
                held += xml.encode()
                held += b"\n"
                told[-1][3] += 1
                if len(held) >= PIECE:
                    flush()
        if file is not None:
            flush()
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*told), (pa.int32(), pa.int32(), pa.string(), pa.int64()))], names=["list", "part", "file", "n"])

    try:
        # a task that runs again writes other files; those of the one that ended count
        told = sorted(map(tuple, spread.mapInArrow(run, "list int, part int, file string, n long").collect()))
        with open(f"{folder}/whole", "wb") as out:
            add = lambda part: out.write(encode(part.encode()))
            add(f'<?xml version="1.0" encoding="UTF-8"?>\n<PublicationDelivery xmlns="{NAMESPACE}" xmlns:{prefix}="{EXTENSION}" version="{VERSION}"><ParticipantRef>{publication}</ParticipantRef><dataObjects>\n')
            for name, own in FRAMES:
                lists = [LISTS.index(x) for x in own if any(LISTS.index(x) == t[0] for t in told)]
                for k in lists:
                    add((f'<{name} id="{publication}:{name}" version="1">' if k == lists[0] else "") + f"<{LISTS[k]}>\n")
                    joined.append_bytes([f"{folder}/{t[2]}" for t in told if t[0] == k], out)
                    add(f"</{LISTS[k]}>" + (f"</{name}>" if k == lists[-1] else "") + "\n")
            add("</dataObjects></PublicationDelivery>\n")
        os.replace(f"{folder}/whole", whole)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    return sum(t[3] for t in told)


def _member(text: bytes) -> bytes:
    """A gzip member whose extra field tells its own size."""
    body = zlib.compress(text, 1, -15)
    size = HEAD.size + len(body) + 8
    return HEAD.pack(MAGIC, 0, 4, 255, 8, FIELD, 4, size) + body + struct.pack("<II", zlib.crc32(text), len(text) & 0xFFFFFFFF)


def members(path: str) -> list[tuple[int, int]]:
    """(place, size) of the members of a file of write(): only their heads are read."""
    out, at = [], 0
    with open(path, "rb") as f:
        while head := f.read(HEAD.size):
            magic, *_, field, _, size = HEAD.unpack(head)
            if magic != MAGIC or field != FIELD:
                raise ValueError(f"{path} has members that don't tell their size")
            out.append((at, size))
            at += size
            f.seek(at)
    return out


def _lines(spark: SparkSession, path: str, heads: tuple[str, ...]) -> DataFrame:
    """(value): the lines of a .gz file of write() that begin with one of the heads, read by many tasks of READ members each."""
    path = path.removeprefix("file://")
    found = members(path)
    heads = tuple(h.encode() for h in heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as f:
            for batch in batches:
                for at, size in zip(*(c.to_pylist() for c in batch.columns)):
                    f.seek(at)
                    own = [x.decode() for x in zlib.decompress(f.read(size), 31).split(b"\n") if x.startswith(heads)]
                    for k in range(0, len(own), 1_024):
                        yield pa.RecordBatch.from_arrays([pa.array(own[k : k + 1_024], pa.string())], names=["value"])

    places = spark.createDataFrame(spark.sparkContext.parallelize(found, max(1, -(-len(found) // READ))), "at long, size long")
    return places.mapInArrow(run, "value string")


def read(spark: SparkSession, path: str, tag: str, schema: str, lines: bool = False) -> DataFrame:
    """Rows of all elements of a name, by Spark's XML reader, which reads a file in one task.

    With ``lines`` a file is read by as many tasks as it fills: for documents of write(), where each object begins and ends a line, and for names of objects.
    """
    if not lines:
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    if path.endswith(".gz"):
        own = _lines(spark, path, (f"<{tag} ", f"<{tag}>"))
    else:
        own = spark.read.text(path).filter(F.col("value").startswith(f"<{tag} ") | F.col("value").startswith(f"<{tag}>"))
    return own.select(F.from_xml("value", schema).alias("x")).select("x.*")


#: What read() needs for journeys.
JOURNEY = (
    "_id string, DestinationDisplay string, dayTypes struct<DayTypeRef: struct<_ref: string>>, LineRef struct<_ref: string>, passingTimes struct<TimetabledPassingTime: array<struct<_order: int,"
    " StopPointRef: struct<_ref: string>, TimingPointRef: struct<_ref: string>, QuayRef: struct<_ref: string>, ArrivalTime: string, ArrivalDayOffset: int, DepartureTime: string, DepartureDayOffset: int,"
    " PassingTime: string, PassingDayOffset: int>>>"
)


def calls_of(journeys: DataFrame) -> DataFrame:
    """The calls of journeys that were read, with the columns of their relation."""
    c = F.col("c")

    def seconds(name: str) -> Column:
        parts = F.split(c[f"{name}Time"], ":")
        return (parts[0].cast("int") * 3_600 + parts[1].cast("int") * 60 + parts[2].cast("int") + F.coalesce(c[f"{name}DayOffset"], F.lit(0)) * 86_400).cast("int")

    rows = journeys.select(F.col("_id").alias("trip_id"), F.explode("passingTimes.TimetabledPassingTime").alias("c"))
    return rows.select(
        "trip_id", c["_order"].alias("sequence"), F.coalesce(c["StopPointRef"]["_ref"], c["TimingPointRef"]["_ref"]).alias("location_id"), c["QuayRef"]["_ref"].alias("boarding_point_id"),
        c["StopPointRef"].isNotNull().alias("passenger_service"), seconds("Arrival").alias("scheduled_arrival"), seconds("Departure").alias("scheduled_departure"), seconds("Passing").alias("scheduled_passage"),
    )


def lost(relations: dict[str, DataFrame]) -> DataFrame:
    """(relation, field, rows): values that the document doesn't hold; fields without any aren't told."""
    out = []
    for name, rows in relations.items():
        gone = [c for c in rows.columns if c not in MAPPED.get(name, "").split()]
        if gone:
            counts = rows.agg(*[F.count(F.col(c)).alias(c) for c in gone])
            out.append(counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, gone)), F.array(*[F.col(c) for c in gone]))).alias("field", "rows")).select(F.lit(name).alias("relation"), "field", "rows"))
    if not out:
        raise ValueError("there is no relation, or none loses a field")
    return reduce(DataFrame.unionByName, out).filter("rows > 0")
