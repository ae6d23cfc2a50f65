"""Queries over layouts, written packages, the whole cascade of matchers and the timeline of winning claims, each with SQL of its own."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matching, netex, reconcile, spatial
from ..operators.lineage import shared_folder
from ..sources import archives, joined, readers, realtime_feed
from ..streaming import stateful
from .base import Frames, query


def _folder(df: DataFrame, name: str) -> str:
    """A new folder where all executors write and read."""
    shared_folder(df.sparkSession)
    return f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


# layouts


@query("box_of_a_layout", "location", "SELECT location_id, longitude, latitude FROM location WHERE longitude BETWEEN 3 AND 45.5 AND latitude BETWEEN 5.5 AND 60")
def _box(f: Frames) -> DataFrame:
    points = f["location"].select("location_id", "longitude", "latitude")
    path = _folder(points, "layout")
    spatial.write_clustered(points, path)
    return spatial.read_boxed(points.sparkSession, path, 3.0, 5.5, 45.5, 60.0)


# packages


@query("package_relation", "trip_call", "SELECT trip_id, sequence, location_id, CAST(row_number() OVER (ORDER BY trip_id, sequence) - 1 AS BIGINT) AS place FROM trip_call")
def _package(f: Frames) -> DataFrame:
    """A relation written as one file by many tasks, and read with each row's place in it."""
    rows = f["trip_call"].select("trip_id", "sequence", "location_id")
    spark = rows.sparkSession
    path = _folder(rows, "relation").removeprefix("file:") + ".parquet"
    schema = pa.schema([pa.field("trip_id", pa.string(), False), pa.field("sequence", pa.int32(), False), pa.field("location_id", pa.string(), False)])
    joined.write_parquet(rows, ["trip_id", "sequence"], path, schema, 4_096)
    return spark.read.parquet(f"file://{path}").select("*", F.col("_metadata.row_index").alias("place"))


# claims

_MAX_AGE = 6 * 3_600
_LIVES = f"""
    lives AS (
        SELECT trip_instance, capability, priority, claim_id, value, event_time AS starts,
               least(event_time + INTERVAL {_MAX_AGE} SECOND, CASE WHEN claim_id % 3 = 0 THEN event_time + INTERVAL 90 MINUTE END) AS ends
        FROM claim)"""


@query(
    "claim_winners",
    "claim",
    f"""
    WITH {_LIVES},
    points AS (
        SELECT trip_instance, capability, starts AS since FROM lives UNION SELECT trip_instance, capability, ends FROM lives),
    live AS (
        SELECT p.trip_instance, p.capability, p.since, l.priority, l.claim_id, l.value
        FROM points p LEFT JOIN lives l
          ON l.trip_instance = p.trip_instance AND l.capability = p.capability AND l.starts <= p.since AND p.since < l.ends
        QUALIFY row_number() OVER (PARTITION BY p.trip_instance, p.capability, p.since ORDER BY l.priority DESC NULLS LAST, l.starts DESC, l.claim_id) = 1)
    SELECT * FROM live
    QUALIFY claim_id IS DISTINCT FROM lag(claim_id) OVER (PARTITION BY trip_instance, capability ORDER BY since)
    """,
)
def _winners(f: Frames) -> DataFrame:
    until = F.when(F.col("claim_id") % 3 == 0, F.col("event_time") + F.expr("INTERVAL 90 MINUTE"))
    return stateful.winners(f["claim"].withColumn("valid_until", until), ["trip_instance"], _MAX_AGE)


# the same as streams: rows come as files, the query ends, goes on from its checkpoint when a row of the far future comes, and tells the rest

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _through(inputs: list[tuple[DataFrame, DataFrame]], stream: Callable[..., DataFrame], name: str) -> DataFrame:
    """What a stream tells of its inputs, each with a row that moves the watermark beyond all others."""
    spark = inputs[0][0].sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    base = _folder(inputs[0][0], name)
    told = None
    for last in (False, True):
        streams = []
        for k, (rows, end) in enumerate(inputs):
            (end.coalesce(1) if last else rows).write.mode("append").parquet(f"{base}/in{k}")
            streams.append(spark.readStream.schema(rows.schema).parquet(f"{base}/in{k}"))
        told = stream(*streams)
        out = told.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
        out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(told.schema).parquet(f"{base}/out")


def _far(rows: DataFrame, **values: object) -> DataFrame:
    """One row of the far future, with the given values."""
    far = {"event_time": "2200-01-01 00:00:00", **values}
    return rows.sparkSession.range(1).select(*[F.lit(far.get(c)).cast(t).alias(c) for c, t in rows.dtypes])


@query(
    "stream_winners",
    "claim",
    f"""
    WITH {_LIVES},
    points AS (SELECT trip_instance, capability, starts AS since FROM lives UNION SELECT trip_instance, capability, ends FROM lives),
    live AS (
        SELECT p.*, arg_max(l.claim_id, (l.priority, l.starts, -l.claim_id)) AS claim_id
        FROM points p LEFT JOIN lives l ON l.trip_instance = p.trip_instance AND l.capability = p.capability AND l.starts <= p.since AND p.since < l.ends
        GROUP BY ALL)
    SELECT * FROM live
    QUALIFY claim_id IS DISTINCT FROM lag(claim_id) OVER (PARTITION BY trip_instance, capability ORDER BY since)""",
)
def _stream_winners(f: Frames) -> DataFrame:
    until = F.when(F.col("claim_id") % 3 == 0, F.col("event_time") + F.expr("INTERVAL 90 MINUTE")).cast("timestamp")
    claims = f["claim"].select("trip_instance", "capability", "priority", F.col("event_time").cast("timestamp").alias("event_time"), until.alias("valid_until"), "claim_id", F.col("value").cast("double").alias("value"))
    told = _through([(claims, _far(claims, trip_instance=-1, capability="end", priority=0, claim_id=-1, value=0.0))], lambda s: stateful.winners_stream(s, _MAX_AGE), "winners")
    return told.filter("trip_instance >= 0").select("trip_instance", "capability", "since", "claim_id")


@query(
    "stream_stop_events",
    "position mark",
    """
    WITH w AS (SELECT *, lag(seconds) OVER v AS s0, lag(distance) OVER v AS d0 FROM position WHERE seconds > 0 WINDOW v AS (PARTITION BY vehicle ORDER BY seconds)),
    x AS (
        SELECT m.vehicle, m.stop_id, k.n, min(s0 + (seconds - s0) * (m.at + k.d - d0) / (distance - d0)) AS t
        FROM w JOIN mark m USING (vehicle), (VALUES ('in', -30.0::DOUBLE), ('at', 0.0::DOUBLE), ('out', 30.0::DOUBLE)) k(n, d)
        WHERE d0 < m.at + k.d AND distance >= m.at + k.d GROUP BY ALL),
    p AS (SELECT vehicle, stop_id, min(t) FILTER (n = 'in') AS i, min(t) FILTER (n = 'at') AS c, min(t) FILTER (n = 'out') AS o FROM x GROUP BY ALL)
    SELECT vehicle, stop_id, CASE WHEN o - i < 10 THEN NULL ELSE i END AS arrival, CASE WHEN o - i < 10 THEN NULL ELSE o END AS departure, CASE WHEN o - i < 10 THEN c END AS passage
    FROM p WHERE i IS NOT NULL OR o IS NOT NULL""",
)
def _stream_stop_events(f: Frames) -> DataFrame:
    # a stream's watermark begins at second 0, where nothing is in time
    positions = f["position"].filter("seconds > 0").select("vehicle", F.timestamp_seconds("seconds").alias("event_time"), "distance")
    told = _through([(positions, _far(positions, vehicle="end", distance=0.0))], lambda s: stateful.stop_events_stream(s, f["mark"]), "stops")
    last = told.groupBy("vehicle", "stop_id").agg(F.max_by(F.struct("arrival", "departure", "passage"), F.col("phase") != "arrived").alias("x"))
    return last.select("vehicle", "stop_id", "x.*")


@query(
    "stream_as_of",
    "claim",
    """
    WITH changes AS (SELECT trip_instance, event_time, max(value) AS value FROM claim WHERE claim_id % 5 = 0 AND value IS NOT NULL GROUP BY ALL)
    SELECT c.claim_id AS id, v.value FROM claim c ASOF LEFT JOIN changes v ON v.trip_instance = c.trip_instance AND c.event_time >= v.event_time WHERE c.claim_id % 5 > 0""",
)
def _stream_as_of(f: Frames) -> DataFrame:
    rows = f["claim"].select(F.col("trip_instance").cast("string").alias("key"), F.col("event_time").cast("timestamp").alias("event_time"), F.col("claim_id").alias("id"), F.col("value").cast("double").alias("value"))
    observations, changes = rows.filter("id % 5 > 0").drop("value"), rows.filter("id % 5 = 0").drop("id")
    told = _through([(observations, _far(observations, key="end", id=-1)), (changes, _far(changes, key="end", value=0.0))], stateful.as_of_stream, "as-of")
    return told.filter("id >= 0").select("id", "value")


# the cascade of matchers

_KM = "2 * 6371.0088 * asin(sqrt(pow(sin(radians({b}.y - {a}.y) / 2), 2) + cos(radians({a}.y)) * cos(radians({b}.y)) * pow(sin(radians({b}.x - {a}.x) / 2), 2)))"
_CASCADE = f"""
    WITH single AS (
        SELECT name, min(object_id) AS object_id, min(longitude) AS longitude, min(latitude) AS latitude FROM place_object GROUP BY name HAVING count(*) = 1),
    coded AS (
        SELECT reference, min(object_id) AS object_id, min(longitude) AS longitude, min(latitude) AS latitude FROM place_object GROUP BY reference HAVING count(*) = 1),
    found AS (
        SELECT point_id, 'authority' AS object_id, longitude, latitude, 0 AS priority FROM place JOIN place_authority USING (code) WHERE country = 'CZ'
        UNION ALL SELECT point_id, object_id, longitude, latitude, 1 FROM place JOIN coded ON reference = country || code
        UNION ALL SELECT point_id, object_id, longitude, latitude, 2 FROM place_alias JOIN place_object USING (object_id)
        UNION ALL SELECT point_id, object_id, longitude, latitude, 3 FROM place JOIN single USING (name)
        UNION ALL SELECT * FROM (
            SELECT p.point_id, o.object_id, o.longitude, o.latitude, 5 FROM place p JOIN place_object o ON levenshtein(p.name, o.name) <= 2
            QUALIFY row_number() OVER (PARTITION BY p.point_id ORDER BY levenshtein(p.name, o.name), o.object_id) = 1)),
    sure AS (SELECT * FROM found WHERE priority = 0),
    tried AS (
        SELECT point_id, object_id, min(longitude) AS longitude, min(latitude) AS latitude FROM found
        WHERE point_id NOT IN (SELECT point_id FROM sure) GROUP BY point_id, object_id),
    own AS (SELECT c.trip_id, c.sequence, t.point_id, t.object_id, t.longitude AS x, t.latitude AS y, c.seconds AS s FROM place_call c JOIN tried t USING (point_id) WHERE c.seconds IS NOT NULL),
    others AS (SELECT trip_id, sequence, longitude AS x, latitude AS y, seconds AS s FROM place_call JOIN sure USING (point_id) WHERE seconds IS NOT NULL),
    -- a candidate stands among the sure calls and its own ones
    stands AS (
        SELECT trip_id, point_id, object_id, sequence, x, y, s, true AS tried FROM own
        UNION ALL SELECT DISTINCT w.trip_id, w.point_id, w.object_id, o.sequence, o.x, o.y, o.s, false FROM own w JOIN others o ON o.trip_id = w.trip_id),
    beside AS (
        SELECT *, {{'x': x, 'y': y}} AS own, lag({{'x': x, 'y': y, 's': s}}) OVER w AS a, lead({{'x': x, 'y': y, 's': s}}) OVER w AS b FROM stands
        WINDOW w AS (PARTITION BY trip_id, point_id, object_id ORDER BY sequence)),
    judged AS (
        SELECT point_id, object_id, coalesce({_KM.format(a="a", b="own")} > abs(s - a.s) / 3600.0 * 150 + 2, false) OR coalesce({_KM.format(a="b", b="own")} > abs(s - b.s) / 3600.0 * 150 + 2, false) AS fast
        FROM beside WHERE tried AND (a IS NOT NULL OR b IS NOT NULL)),
    vetoed AS (SELECT point_id, object_id FROM judged GROUP BY point_id, object_id HAVING bool_and(fast)),
    chosen AS (
        SELECT f.* FROM found f LEFT JOIN vetoed v ON v.point_id = f.point_id AND v.object_id = f.object_id AND f.priority > 0 WHERE v.point_id IS NULL
        QUALIFY row_number() OVER (PARTITION BY f.point_id ORDER BY f.priority, f.object_id) = 1),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY sequence) AS n FROM place_call),
    anchors AS (SELECT c.trip_id, c.n, c.seconds AS s, k.longitude AS x, k.latitude AS y FROM numbered c JOIN chosen k USING (point_id) WHERE c.seconds IS NOT NULL),
    asked AS (SELECT * FROM numbered WHERE seconds IS NOT NULL AND point_id NOT IN (SELECT point_id FROM chosen)),
    between_ AS (
        SELECT c.point_id, c.trip_id, c.sequence, c.n, c.seconds, c.days, max(a) FILTER (WHERE a.n < c.n) AS a, min(a) FILTER (WHERE a.n > c.n) AS b
        FROM asked c JOIN (SELECT trip_id, {{'n': n, 's': s, 'x': x, 'y': y}} AS a FROM anchors) USING (trip_id) GROUP BY ALL),
    estimated AS (
        SELECT point_id,
               CASE WHEN a IS NULL THEN b.x WHEN b IS NULL THEN a.x ELSE a.x + (b.x - a.x) * share END AS longitude,
               CASE WHEN a IS NULL THEN b.y + (b.n - n) * (0.3 / 111.195) WHEN b IS NULL THEN a.y + (n - a.n) * (0.3 / 111.195) ELSE a.y + (b.y - a.y) * share END AS latitude
        FROM (SELECT *, CASE WHEN b.s <> a.s THEN (seconds - a.s) / CAST(b.s - a.s AS DOUBLE) ELSE 0.5 END AS share FROM between_)
        QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY a IS NULL OR b IS NULL, CASE WHEN a IS NULL THEN b.n - n WHEN b IS NULL THEN n - a.n ELSE b.n - a.n END,
                CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE {_KM.format(a="a", b="b")} END, days DESC, trip_id, sequence) = 1)
    SELECT point_id, c.object_id, round(coalesce(c.longitude, e.longitude), 9) AS longitude, round(coalesce(c.latitude, e.latitude), 9) AS latitude,
           CASE WHEN c.priority IS NOT NULL THEN ['authority', 'exact_code', 'alias', 'exact_name', 'cleaned_name', 'fuzzy_name'][c.priority + 1] WHEN e.point_id IS NOT NULL THEN 'estimate' END AS method
    FROM place LEFT JOIN chosen c USING (point_id) LEFT JOIN estimated e USING (point_id)
    """


@query("match_cascade", "place place_authority place_object place_alias place_call", _CASCADE)
def _cascade(f: Frames) -> DataFrame:
    found = matching.cascade(f["place"], f["place_authority"], f["place_object"], f["place_alias"], f["place_call"])
    return found.select("point_id", "object_id", F.round("longitude", 9).alias("longitude"), F.round("latitude", 9).alias("latitude"), "method")


# captured feeds


#: Vehicles of a payload, on an average, from which on there are more payloads.
FEED_ROWS = 2_048


@query(
    "feed_vehicles",
    "claim",
    """
    SELECT CAST(claim_id AS VARCHAR) AS entity_id, 'vehicle' AS kind, trip_instance % 50 AS feed_timestamp, 'T' || trip_instance AS trip_id,
           CAST(claim_id % 90 AS DOUBLE) AS latitude, CAST(claim_id % 180 AS DOUBLE) + 0.5 AS longitude, CASE WHEN claim_id % 3 > 0 THEN CAST(priority AS INT) END AS stop_sequence
    FROM claim""",
)
def _vehicles(f: Frames) -> DataFrame:
    """Claims are put into feeds, one for each fiftieth of the trips, and these are read again."""
    rows = f["claim"].select(
        (F.col("trip_instance") % 50).alias("feed"),
        F.col("claim_id").cast("string").alias("entity_id"),
        F.lit("vehicle").alias("kind"),
        F.concat(F.lit("T"), "trip_instance").alias("trip_id"),
        (F.col("claim_id") % 90).cast("double").alias("latitude"),
        ((F.col("claim_id") % 180).cast("double") + 0.5).alias("longitude"),
        F.when(F.col("claim_id") % 3 > 0, F.col("priority")).cast("int").alias("stop_sequence"),
    )
    # payloads of a feed become more as claims do
    part = F.pmod(F.xxhash64("entity_id"), F.lit(max(16, -(-rows.count() // (50 * FEED_ROWS)))))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.drop(columns=["feed", "part"]).astype(object)
        body = realtime_feed.feed_of(own.where(own.notna(), None).to_dict("records"), int(key[0]))
        return pd.DataFrame({"path": [f"{key[0]}-{key[1]}"], "content": [body]})

    payloads = rows.withColumn("part", part).groupBy("feed", "part").applyInPandas(pack, "path string, content binary")
    return realtime_feed.feed_rows(payloads).select("entity_id", "kind", "feed_timestamp", "trip_id", "latitude", "longitude", "stop_sequence")


# a NeTEx document, written and read again

_NETEX = "agency location route trip trip_call service_calendar service_exception service_note connection_claim"


def _document(f: Frames) -> tuple[SparkSession, str]:
    spark = f["trip"].sparkSession
    shared_folder(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    path = f"{folder}/netex-{uuid.uuid4().hex}.xml.gz"
    netex.write(f, path, size=8_192)
    return spark, path


@query(
    "netex_calls",
    _NETEX,
    """
    SELECT trip_id, sequence, location_id, boarding_point_id, passenger_service, scheduled_arrival, scheduled_departure, scheduled_passage
    FROM trip_call JOIN (SELECT DISTINCT trip_id FROM trip) USING (trip_id)""",
)
def _netex_calls(f: Frames) -> DataFrame:
    spark, path = _document(f)
    return netex.calls_of(netex.read(spark, f"file://{path}", "ServiceJourney", netex.JOURNEY, lines=True))


@query(
    "netex_interchanges",
    "trip connection_claim",
    """
    SELECT connection_id, origin_trip_id AS from_trip, target_trip_id AS to_trip, wait_minutes AS wait
    FROM connection_claim WHERE resolution_status = 'resolved' AND target_trip_id IS NOT NULL""",
)
def _netex_interchanges(f: Frames) -> DataFrame:
    spark, path = _document(f)
    schema = "_id string, MaximumWaitTime string, FromJourneyRef struct<_ref: string>, ToJourneyRef struct<_ref: string>"
    rows = netex.read(spark, f"file://{path}", "ServiceJourneyInterchange", schema, lines=True)
    wait = F.regexp_extract("MaximumWaitTime", r"^PT(-?\d+)M$", 1).cast("int")
    return rows.select(F.col("_id").alias("connection_id"), F.col("FromJourneyRef._ref").alias("from_trip"), F.col("ToJourneyRef._ref").alias("to_trip"), wait.alias("wait"))


@query(
    "netex_lost",
    "trip connection_claim",
    """
    SELECT 'trip' AS relation, f AS field, n AS rows
    FROM (SELECT {'direction': count(direction), 'shape_id': count(shape_id)} AS x FROM trip), LATERAL (SELECT unnest(['direction', 'shape_id']) AS f, unnest([x.direction, x.shape_id]) AS n)
    UNION ALL
    SELECT 'connection_claim', f, n
    FROM (SELECT [count(target_derivation), count(target_public_line), count(target_destination_text), count(target_location_id), count(source_snapshot_sha256)] AS x FROM connection_claim),
         LATERAL (SELECT unnest(['target_derivation', 'target_public_line', 'target_destination_text', 'target_location_id', 'source_snapshot_sha256']) AS f, unnest(x) AS n)""",
)
def _netex_lost(f: Frames) -> DataFrame:
    return netex.lost({name: f[name] for name in ("trip", "connection_claim")})


# files in the sources' formats, written from the tables and read again


@query("read_csv", "route", "SELECT route_id, agency_id, mode, CAST(route_number AS VARCHAR) AS route_number FROM route")
def _read_csv(f: Frames) -> DataFrame:
    rows = f["route"].select("route_id", "agency_id", "mode", "route_number")
    path = _folder(rows, "csv")
    rows.write.option("header", True).csv(path)
    return readers.csv_rows(rows.sparkSession, path, rows.columns)


@query("read_encoded", "agency", "SELECT agency_id AS id, 'Café ' || name AS name, CASE WHEN agency_id LIKE '%7' THEN 'a;b \"c\"' END AS note FROM agency")
def _read_encoded(f: Frames) -> DataFrame:
    note = F.when(F.endswith("agency_id", F.lit("7")), F.lit('a;b "c"'))
    rows = f["agency"].select(F.col("agency_id").alias("id"), F.concat(F.lit("Café "), "name").alias("name"), note.alias("note"))
    path = _folder(rows, "encoded")
    rows.fillna("").write.options(sep=";", encoding="iso-8859-1", quoteAll=True, escape='"').csv(path)
    read = readers.encoded_rows(rows.sparkSession, path, ["id", "name", "note"], encoding="iso-8859-1")
    return read.select("id", "name", F.when(F.col("note") != "", F.col("note")).alias("note"))


@query(
    "read_coordinates",
    "coordinate",
    """
    SELECT substr(code, 1, 5) AS code, min(lon) AS lon, min(lat) AS lat FROM coordinate
    GROUP BY substr(code, 1, 5) HAVING count(DISTINCT lon) = 1 AND count(DISTINCT lat) = 1""",
)
def _read_coordinates(f: Frames) -> DataFrame:
    lines = [f["coordinate"].select(F.concat_ws(",", "code", F.lit("any name"), F.col("lat").cast("string"), F.col("lon").cast("string")).alias("value"))]
    lines.append(lines[0].select(F.regexp_replace("value", ",[^,]*$", ",none").alias("value")))
    path = _folder(lines[0], "coordinates")
    lines[0].unionByName(lines[1]).write.text(path)
    return readers.reference_coordinates(lines[0].sparkSession, path)


@query("read_gzip", "alert", "SELECT alert_id AS id FROM alert")
def _read_gzip(f: Frames) -> DataFrame:
    rows = f["alert"].select(F.concat(F.lit("id "), "alert_id").alias("value"))
    path = _folder(rows, "gzip")
    rows.repartition(5, "value").write.option("compression", "gzip").text(path)
    lines = readers.gzip_objects(rows.sparkSession, path).select(F.explode(F.split(F.rtrim(F.col("content").cast("string"), F.lit("\n")), "\n")).alias("line"))
    return lines.select(F.regexp_extract("line", r"^id (\d+)$", 1).cast("long").alias("id"))


#: Bytes of texts of an archive, from which on there are more archives.
ARCHIVE_BYTES = 8 << 20


@query(
    "read_archives",
    "text_line",
    """
    SELECT CASE WHEN doc_id % 3 = 0 THEN 'inner.zip!' ELSE '' END || doc_id || '.xml' AS member, strlen(text) AS bytes, sha256(text) AS sha256
    FROM text_line WHERE text IS NOT NULL""",
)
def _read_archives(f: Frames) -> DataFrame:
    """Texts are packed into archives, a third of them into archives within these, and read by many tasks."""
    texts = f["text_line"].filter("text IS NOT NULL")
    # a task packs an archive, so archives become more as texts do
    many = max(8, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ARCHIVE_BYTES))
    rows = texts.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(many)))
    folder = _folder(rows, "archives-of")
    local = folder.removeprefix("file:")

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        inner, outer = io.BytesIO(), io.BytesIO()
        with zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED) as nested, zipfile.ZipFile(outer, "w", zipfile.ZIP_DEFLATED) as whole:
            for doc_id, text in zip(pdf.doc_id, pdf.text):
                (whole if doc_id % 3 else nested).writestr(f"{doc_id}.xml", text)
            nested.close()
            whole.writestr("inner.zip", inner.getvalue())
        os.makedirs(local, exist_ok=True)
        part = f"{local}/.{uuid.uuid4().hex}"
        with open(part, "wb") as file:
            file.write(outer.getvalue())
        os.replace(part, f"{local}/{key[0]}.zip")
        return pd.DataFrame({"n": [len(pdf)]})

    rows.groupBy("part").applyInPandas(pack, "n long").agg(F.sum("n")).collect()
    return archives.split_members(rows.sparkSession, folder, task_bytes=1 << 18).select("member", "bytes", "sha256")


@query(
    "file_digests",
    "source_object",
    """
    SELECT source, CAST(octet_length(encode(line)) AS BIGINT) + 1 AS bytes, sha256(line || chr(10)) AS sha256
    FROM (SELECT source, string_agg(identity, ' ' ORDER BY doc_id) AS line FROM source_object WHERE source IS NOT NULL GROUP BY source)""",
)
def _file_digests(f: Frames) -> DataFrame:
    rows = f["source_object"].filter("source IS NOT NULL")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "identity"))), lambda x: x["identity"])
    lines = rows.groupBy("source").agg(F.array_join(ids, " ").alias("value"))
    path = _folder(lines, "files")
    lines.repartition("source").write.partitionBy("source").text(path)
    found = readers.file_manifest(lines.sparkSession, path)
    return found.select(F.regexp_extract("path", r"/source=([^/]*)/", 1).alias("source"), "bytes", "sha256")


@query("text_numbers", "location", "SELECT location_id, longitude, latitude FROM location WHERE longitude IS NOT NULL")
def _text_numbers(f: Frames) -> DataFrame:
    rows = f["location"].filter("longitude IS NOT NULL").select("location_id", F.col("longitude").cast("string"), F.col("latitude").cast("string"))
    return reconcile.with_numbers(rows, "longitude", "latitude")


@query(
    "odd_coordinates",
    "stop",
    """
    SELECT stop_id, CASE k % 6 WHEN 0 THEN 'invalid' WHEN 1 THEN 'invalid' WHEN 2 THEN 'missing' WHEN 3 THEN 'invalid' WHEN 4 THEN 'zero' ELSE 'fine' END AS status
    FROM (SELECT stop_id, CAST(substr(stop_id, 3) AS INT) AS k FROM stop)""",
)
def _odd_coordinates(f: Frames) -> DataFrame:
    """Coordinates that are no numbers, infinite, missing on one side, just beyond the world, zero, or at its corner."""
    k = F.substring("stop_id", 3, 20).cast("int") % 6
    lon = F.when(k == 0, float("nan")).when(k == 1, 0.0).when(k == 2, 1.0).when(k == 3, 180.0000001).when(k == 4, 0.0).otherwise(-180.0)
    lat = F.when(k == 0, 0.0).when(k == 1, float("-inf")).when(k == 2, F.lit(None).cast("double")).when(k == 3, 0.0).when(k == 4, -0.0).otherwise(90.0)
    return f["stop"].select("stop_id", reconcile.coordinate_status(lon, lat).alias("status"))
