"""Queries over the rest of the operators, each with SQL of its own: conditions and references are written out here again, not read from the contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers
from ..operators import checks, derive, export, matching, overlay, reconcile
from ..sources import readers
from ..streaming import realtime
from .base import Frames, query

# references: child columns, parent columns, written out

_ALL_REFERENCES = (
    ("location", "parent_location_id", "location", "location_id"),
    ("route", "agency_id", "agency", "agency_id"),
    ("service_exception", "service_id", "service_calendar", "service_id"),
    ("shape_point", "shape_id", "shape", "shape_id"),
    ("trip", "route_id", "route", "route_id"),
    ("trip", "service_id", "service_calendar", "service_id"),
    ("trip", "shape_id", "shape", "shape_id"),
    ("trip_call", "trip_id", "trip", "trip_id"),
    ("trip_call", "location_id", "location", "location_id"),
    ("trip_call", "boarding_point_id", "location", "location_id"),
    ("route_segment", "trip_id", "trip", "trip_id"),
    ("route_segment", "route_id", "route", "route_id"),
    ("transfer", "from_location_id", "location", "location_id"),
    ("transfer", "to_location_id", "location", "location_id"),
    ("fare_zone", "fare_system_id", "fare_system", "fare_system_id"),
    ("location_zone", "location_id", "location", "location_id"),
    ("location_zone", "fare_system_id,zone_id", "fare_zone", "fare_system_id,zone_id"),
    ("call_zone", "trip_id,sequence", "trip_call", "trip_id,sequence"),
    ("call_zone", "fare_system_id,zone_id", "fare_zone", "fare_system_id,zone_id"),
    ("service_note_assignment", "note_id", "service_note", "note_id"),
    ("service_note_assignment", "route_id", "route", "route_id"),
    ("service_note_assignment", "trip_id", "trip", "trip_id"),
    ("service_feature_assignment", "route_id", "route", "route_id"),
    ("service_feature_assignment", "trip_id", "trip", "trip_id"),
    ("service_feature_assignment", "trip_id,call_sequence", "trip_call", "trip_id,sequence"),
    ("service_feature_assignment", "note_id", "service_note", "note_id"),
    ("location_feature", "location_id", "location", "location_id"),
    ("connection_claim", "origin_trip_id,origin_sequence", "trip_call", "trip_id,sequence"),
    ("operational_call", "source_id,source_journey_id", "operational_journey", "source_id,source_journey_id"),
    ("operational_call", "source_id,source_location_id", "operational_location", "source_id,source_location_id"),
    ("source_trip_map", "trip_id", "trip", "trip_id"),
    ("source_call_map", "trip_id,call_sequence", "trip_call", "trip_id,sequence"),
    ("source_trip_coverage", "trip_id", "trip", "trip_id"),
    ("road_route_key", "route_id", "route", "route_id"),
    ("road_trip_key", "trip_id", "trip", "trip_id"),
    ("rail_trip_key", "trip_id", "trip", "trip_id"),
)


def _missing_sql(child: str, columns: str, parent: str, keys: str) -> str:
    pairs = list(zip(columns.split(","), keys.split(",")))
    on = " AND ".join(f"p.{k} = c.{c}" for c, k in pairs)
    given = " AND ".join(f"c.{c} IS NOT NULL" for c, _ in pairs)
    return f"SELECT '{child}({columns})' AS reference, (SELECT count(*) FROM {child} c LEFT JOIN (SELECT DISTINCT {keys}, true AS there FROM {parent}) p ON {on} WHERE {given} AND p.there IS NULL) AS violations"


query("all_references", " ".join(sorted({x for r in _ALL_REFERENCES for x in (r[0], r[2])})), " UNION ALL ".join(_missing_sql(*r) for r in _ALL_REFERENCES))(checks.references_summary)

# domains: what breaks each condition, written out as the comparing engine has it

_HEX = "NOT regexp_full_match(source_snapshot_sha256, '[0-9a-f]{64}')"
_BREACHES = {
    "location": {
        "kind": "kind NOT IN ('stop_place', 'boarding_point', 'operational_point')",
        "domain": "domain NOT IN ('surface', 'heavy_rail')",
        "parent": "(kind = 'boarding_point' AND parent_location_id IS NULL) OR (kind <> 'boarding_point' AND parent_location_id IS NOT NULL)",
        "wheelchair": "wheelchair_boarding < 0 OR wheelchair_boarding > 2",
        "coordinates": "(longitude IS NULL AND latitude IS NOT NULL) OR (longitude IS NOT NULL AND latitude IS NULL)",
    },
    "service_calendar": {"validity": "valid_to < valid_from", "weekdays": "weekday_mask < 0 OR weekday_mask > 127"},
    "shape_point": {"sequence": "sequence < 0", "distance": "distance_traveled < 0"},
    "call_zone": {"order": "source_order < 0"},
    "service_note": {"kind": "kind NOT IN ('route_information', 'service_note', 'reservation')", "validity": "valid_to < valid_from", "snapshot": _HEX},
    "service_note_assignment": {
        "scope": "scope NOT IN ('route', 'trip')",
        "target": "NOT CASE scope WHEN 'route' THEN route_id IS NOT NULL AND trip_id IS NULL WHEN 'trip' THEN trip_id IS NOT NULL AND route_id IS NULL ELSE false END",
    },
    "service_feature_assignment": {
        "scope": "scope NOT IN ('route', 'trip', 'call')",
        "kind": "kind = 'unknown'",
        "target": "NOT CASE scope WHEN 'route' THEN route_id IS NOT NULL AND trip_id IS NULL AND call_sequence IS NULL WHEN 'trip' THEN route_id IS NULL AND trip_id IS NOT NULL AND call_sequence IS NULL WHEN 'call' THEN route_id IS NULL AND trip_id IS NOT NULL AND call_sequence IS NOT NULL ELSE false END",
        "snapshot": _HEX,
    },
    "location_feature": {"kind": "kind = 'pool'", "snapshot": _HEX},
    "connection_claim": {
        "direction": "direction NOT IN ('waits_for', 'connects_to')",
        "resolution": "resolution_status NOT IN ('unresolved', 'pattern', 'resolved')",
        "derivation": "target_derivation NOT IN ('none', 'structured', 'spec_note')",
        "wait": "wait_minutes < 0",
        "snapshot": _HEX,
    },
    "travel_restriction_assignment": {
        "scope": "scope NOT IN ('route_stop', 'trip_call')",
        "group": "group_code NOT IN ('§', 'A', 'B', 'C')",
        "target": "NOT CASE scope WHEN 'route_stop' THEN route_id IS NOT NULL AND trip_id IS NULL AND call_sequence IS NULL WHEN 'trip_call' THEN route_id IS NULL AND trip_id IS NOT NULL ELSE false END",
        "snapshot": _HEX,
    },
    "operational_call": {"times": "scheduled_arrival IS NULL AND scheduled_departure IS NULL AND scheduled_passage IS NULL"},
    "road_route_key": {"line": "NOT regexp_full_match(cis_line_id, '[0-9]{6}')", "validity": "valid_to < valid_from"},
    "road_trip_key": {"line": "NOT regexp_full_match(cis_line_id, '[0-9]{6}')", "trip": "cis_trip_id < 0", "validity": "valid_to < valid_from"},
    "rail_trip_key": {"number": "train_number <= 0", "validity": "valid_to < valid_from"},
    "source_trip_map": {"validity": "valid_to < valid_from"},
    "source_trip_coverage": {"sequence": "from_sequence <= 0 OR to_sequence < from_sequence"},
    "identifier_alias": {"validity": "valid_to < valid_from"},
}
query("all_domains", " ".join(_BREACHES), " UNION ALL ".join(f"SELECT '{r}' AS relation, '{k}' AS condition, (SELECT count(*) FROM {r} WHERE {c}) AS violations" for r, own in _BREACHES.items() for k, c in own.items()))(checks.domains_summary)


@query("null_keys", "trip", "SELECT c AS \"column\", CASE c WHEN 'trip_id' THEN count(*) FILTER (WHERE trip_id IS NULL) WHEN 'route_id' THEN count(*) FILTER (WHERE route_id IS NULL) ELSE count(*) FILTER (WHERE service_id IS NULL) END AS violations FROM trip, (VALUES ('trip_id'), ('route_id'), ('service_id')) v(c) GROUP BY c")
def _nulls(f: Frames) -> DataFrame:
    return checks.null_violations("trip", f["trip"])


# identifiers, texts and times

query("identifier_checks", "road_route_key", "SELECT cis_line_id, route_id, regexp_full_match(cis_line_id, '[0-9]{6}') AS is_line, cis_line_id <> '' AS is_public FROM road_route_key")(
    lambda f: f["road_route_key"].select("cis_line_id", "route_id", identifiers.is_line(F.col("cis_line_id")).alias("is_line"), identifiers.is_public_id(F.col("cis_line_id")).alias("is_public"))
)
query("digest_checks", "service_note", "SELECT note_id, regexp_full_match(source_snapshot_sha256, '[0-9a-f]{64}') AS is_digest, sha256(source_snapshot_sha256) AS again FROM service_note")(
    lambda f: f["service_note"].select("note_id", identifiers.is_sha256(F.col("source_snapshot_sha256")).alias("is_digest"), F.sha2("source_snapshot_sha256", 256).alias("again"))
)
query("checksum_tokens", "service_note", "SELECT note_id, coalesce(lower(regexp_extract('sum ' || substr(source_snapshot_sha256, 1, 32) || ' *' || note_id, '(?i)\\b([0-9a-f]{32})\\b', 1)), '') AS token FROM service_note")(
    lambda f: f["service_note"].select("note_id", identifiers.first_md5(F.concat(F.lit("sum "), F.substring("source_snapshot_sha256", 1, 32), F.lit(" *"), "note_id")).alias("token"))
)
query("first_filled", "service_note", "SELECT note_id, CASE WHEN label IS NOT NULL AND label <> '' THEN label WHEN text <> '' THEN text END AS value FROM service_note")(
    lambda f: f["service_note"].select("note_id", identifiers.first_filled(F.col("label"), F.col("text")).alias("value"))
)
query("date_prefixes", "snapshot", "SELECT snapshot, substr(strftime(retrieved_at, '%Y-%m-%dT%H:%M:%S'), 1, 10) AS day FROM snapshot")(
    lambda f: f["snapshot"].select("snapshot", identifiers.date_prefix(F.date_format("retrieved_at", "yyyy-MM-dd'T'HH:mm:ss")).alias("day"))
)
query(
    "timetable_years",
    "journey",
    """SELECT journey_id, CAST(year(service_date) + CASE WHEN service_date >= make_date(year(service_date), 12, 1) + CAST((7 - isodow(make_date(year(service_date), 12, 1))) + 7 AS INT) THEN 1 ELSE 0 END AS INT) AS timetable_year FROM journey""",
)(lambda f: f["journey"].select("journey_id", identifiers.year_of(F.col("service_date").cast("timestamp"), "UTC").cast("int").alias("timetable_year")))
query("clock_seconds", "trip_call", "SELECT trip_id, sequence, CAST(scheduled_departure + 86400 * (sequence % 3 - 1) AS INT) AS seconds FROM trip_call WHERE scheduled_departure IS NOT NULL")(
    lambda f: f["trip_call"].filter("scheduled_departure IS NOT NULL").select("trip_id", "sequence", derive.local_seconds(F.concat(export.clock(F.col("scheduled_departure")), F.when(F.col("sequence") % 20 == 0, "+02:00").otherwise(".250Z")), (F.col("sequence") % 3 - 1).cast("string")).alias("seconds"))
)
query("bitmap_dates", "bitmap", "SELECT id, CAST(start + CAST(k AS INT) AS DATE) AS service_date FROM bitmap, (SELECT unnest(range(32)) AS k) WHERE substr(bits, CAST(k AS INT) + 1, 1) = '1'")(
    lambda f: derive.bitmap_days(f["bitmap"], "bits", "start").select("id", "service_date")
)
query("stop_id_parts", "stop", "SELECT stop_id, 'a+b c' AS kind, 'x:a%2Bb+c'[1:0] || 'cz:a%2Bb%20c' AS parent FROM stop")(
    lambda f: f["stop"].withColumn("_p", readers.stop_identity(F.concat(F.lit("cz:a%2Bb%20c:"), "stop_id"))).select("stop_id", F.col("_p.parts")[1].alias("kind"), F.col("_p.parent").alias("parent"))
)
query("typed_codes", "location_feature", "SELECT feature_id, CASE kind WHEN 'toilet' THEN 'sanitary' END AS target FROM location_feature")(
    lambda f: export.coded(f["location_feature"], {"toilet": "sanitary", "refreshments": "food"}, "kind", "target").select("feature_id", "target")
)
query("public_lines", "road_route_key route", "SELECT cis_line_id, route_id, CASE WHEN length(cis_line_id) % 2 = 1 THEN 'X' ELSE CAST(TRY_CAST(right(cis_line_id, 3) AS INT) AS VARCHAR) END AS line FROM road_route_key")(
    lambda f: f["road_route_key"].select("cis_line_id", "route_id", export.public_line(F.when(F.length("cis_line_id") % 2 == 1, "X"), F.col("cis_line_id")).alias("line"))
)
query("log_severity", "event_line", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'error' WHEN event_id % 4 = 1 THEN 'warning' END AS severity FROM event_line")(
    lambda f: readers.log_events(f["event_line"].withColumn("line", F.concat(F.lit("\x1b[1m"), F.when(F.col("event_id") % 4 == 0, "an ERROR: ").when(F.col("event_id") % 4 == 1, "Warn "), F.lit("x\x1b[0m"))), "line", "P ", "k long").select("event_id", "severity")
)

# derivations and reconciliation

query("position_texts", "location", "SELECT location_id, CASE WHEN longitude IS NOT NULL AND latitude IS NOT NULL THEN 'POINT(' || CAST(CAST(longitude AS DECIMAL(12,6)) AS VARCHAR) || ' ' || CAST(CAST(latitude AS DECIMAL(12,6)) AS VARCHAR) || ')' END AS position FROM location WHERE longitude IS NOT NULL")(
    lambda f: f["location"].filter("longitude IS NOT NULL").select("location_id", derive.position_wkt(F.col("longitude"), F.col("latitude")).alias("position"))
)
query(
    "line_segments",
    "trip_call",
    """WITH c AS (SELECT trip_id, sequence, CASE WHEN line_id <> 'R:1' THEN line_id END AS line FROM trip_call), n AS (SELECT *, row_number() OVER w AS k, lag(line) OVER w AS b, lag(sequence) OVER w AS p, max(sequence) OVER (PARTITION BY trip_id) AS z FROM c WINDOW w AS (PARTITION BY trip_id ORDER BY sequence)),
       s AS (SELECT trip_id, line, sequence, z, CASE WHEN line IS NULL AND b IS NOT NULL THEN p ELSE sequence END AS a FROM n WHERE k = 1 OR line IS DISTINCT FROM b), e AS (SELECT *, coalesce(lead(a) OVER (PARTITION BY trip_id ORDER BY sequence), z) AS t FROM s)
       SELECT trip_id, line, a AS from_sequence, t AS to_sequence FROM e WHERE a < t OR (a = t AND t = z AND z = sequence)""",
)(lambda f: derive.line_segments(f["trip_call"].select("trip_id", "sequence", F.when(F.col("line_id") != "R:1", F.col("line_id")).alias("line")), "line"))
query("pattern_digests", "trip_call", "SELECT trip_id, count(*) AS n_calls, sha256(string_agg(location_id || '|' || CAST(pickup_type AS VARCHAR), ';' ORDER BY sequence)) AS pattern_sha256 FROM trip_call GROUP BY trip_id")(
    lambda f: derive.pattern_digest(f["trip_call"], "location_id", "pickup_type")
)
query("folded_names", "stop", "SELECT lower(stop_name) AS folded, count(*) AS n FROM stop GROUP BY lower(stop_name) HAVING count(*) > 1")(lambda f: reconcile.case_duplicates(f["stop"], "stop_name"))
query("prefix_collisions", "node", "SELECT lower(k) AS folded, count(*) AS n FROM (SELECT 'a/' || segment AS k FROM node UNION ALL SELECT 'b/' || CAST(id AS VARCHAR) FROM node) GROUP BY 1 HAVING count(*) > 1")(
    lambda f: reconcile.prefix_collisions({"a": f["node"].select(F.col("segment").alias("id")), "b": f["node"].select("id")}, "id")
)
query("source_counts", "text_line", "SELECT source, count(*) AS n, CAST(coalesce(sum(octet_length(encode(text))), 0) AS BIGINT) AS bytes FROM text_line GROUP BY source")(lambda f: reconcile.source_counts(f["text_line"], "source", F.col("text")))
query("unsafe_paths", "source_object", "SELECT doc_id FROM source_object WHERE doc_id % 5 < 2")(
    lambda f: reconcile.unsafe_paths(f["source_object"].withColumn("path", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("a\\..\\"), "path")).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("/"), "path")).otherwise(F.col("path"))), "path").select("doc_id")
)
query("attempt_numbers", "job_event", "SELECT job_id, max(event_id % 5) + 1 AS attempt FROM job_event GROUP BY job_id")(lambda f: reconcile.next_attempts(f["job_event"].withColumn("n", F.col("event_id") % 5), "job_id", "n"))
query("shared_elements", "source_object", "SELECT doc_id, len(list_intersect(string_split(text, ' '), ['the', 'de', 'der'])) > 0 AS shares FROM source_object")(
    lambda f: f["source_object"].select("doc_id", reconcile.overlapping(F.split("text", " "), F.array(F.lit("the"), F.lit("de"), F.lit("der"))).alias("shares"))
)
query("railway_nodes", "node", "SELECT id FROM node WHERE tag = 'station'")(lambda f: readers.tagged_nodes(f["node"].withColumn("tags", F.create_map(F.lit("railway"), "tag")), readers.RAILWAY_TAGS).select("id"))
query("transit_nodes", "node", "SELECT id FROM node WHERE CASE WHEN id % 2 = 0 THEN tag = 'bus_stop' ELSE tag IN ('tram_stop') END")(
    lambda f: readers.tagged_nodes(f["node"].withColumn("tags", F.create_map(F.when(F.col("id") % 2 == 0, "highway").otherwise("railway"), "tag")), readers.TRANSIT_TAGS).select("id")
)
query("merged_nodes", "node", "SELECT 'node' AS type, id, version FROM node")(
    lambda f: readers.merged_nodes(*[f["node"].filter(c).select(F.lit("node").alias("type"), "id", "version") for c in ("id % 3 < 2", "id % 3 > 0", "id % 2 = 0")])
)
query(
    "listing_names",
    "page",
    """WITH l AS (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*"([^"]*)"', 1) AS x FROM page WHERE html LIKE '%<a %'), n AS (SELECT page_id, [replace(string_split(regexp_replace(v, '/+$', ''), '/')[-1], '&amp;', '&') FOR v IN x] AS x FROM l)
       SELECT page_id, array_to_string(list_sort(list_distinct([v FOR v IN x IF v NOT IN ('', '.', '..')])), ' ') AS names FROM n""",
)(
    lambda f: readers.listing_names(f["page"].filter("html LIKE '%<a %'")).select("page_id", F.array_join("names", " ").alias("names"))
)

# overlays, policies and projections

query(
    "redirects",
    "redirect",
    """WITH RECURSIVE step(old_id, target, n) AS (SELECT old_id, new_id, 1 FROM redirect UNION ALL SELECT s.old_id, r.new_id, s.n + 1 FROM step s JOIN redirect r ON r.old_id = s.target WHERE s.n <= 200),
       ends AS (SELECT old_id, max(n) AS n, arg_max(coalesce(target, -999999), n) AS target FROM step GROUP BY old_id)
       SELECT old_id, CASE WHEN n <= 200 AND target <> -999999 THEN target END AS final_id, CASE WHEN n > 200 THEN 'cycle' WHEN target = -999999 THEN 'gone' ELSE 'redirected' END AS status FROM ends""",
)(lambda f: overlay.follow_redirects(f["redirect"]))
query("stop_groups", "stop", "SELECT stop_id, CASE WHEN parent_station IS NOT NULL THEN 'parent_station:' || parent_station ELSE 'single:' || stop_id END AS \"group\" FROM stop")(lambda f: overlay.stop_groups(f["stop"], "parent_station"))
query(
    "stop_continuity_by_tuple",
    "stop",
    """SELECT n.stop_id, CASE WHEN n.c = 1 AND o.c = 1 THEN o.id END AS previous_id, CASE WHEN n.c > 1 OR o.c > 1 THEN 'review' WHEN o.c IS NULL THEN 'new' ELSE 'same' END AS status
       FROM (SELECT *, count(*) OVER (PARTITION BY stop_name, lon) AS c FROM stop) n LEFT JOIN (SELECT stop_name, lon, count(*) AS c, min(stop_id) AS id FROM stop WHERE lon > -50 GROUP BY stop_name, lon) o USING (stop_name, lon)""",
)(lambda f: overlay.continuity(f["stop"].filter("lon > -50"), f["stop"], ["stop_name", "lon"], "stop_id"))
query("applied_messages", "message_day", "SELECT trip, service_date, path FROM (SELECT *, row_number() OVER (PARTITION BY trip, service_date ORDER BY ord DESC) AS k FROM message_day) WHERE k = 1 AND NOT cancels")(lambda f: overlay.apply_messages(f["message_day"]))
query("unknown_cancellations", "message_day", "SELECT c.path FROM message_day c WHERE c.cancels AND NOT EXISTS (SELECT 1 FROM message_day a WHERE a.trip = c.trip AND a.service_date = c.service_date AND a.ord < c.ord AND NOT a.cancels)")(
    lambda f: overlay.unknown_cancellations(f["message_day"]).select("path")
)
query(
    "last_known_good",
    "snapshot",
    """SELECT source_id, snapshot, retrieved_at FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY retrieved_at DESC, snapshot DESC) AS k FROM snapshot
       WHERE usable AND retrieved_at BETWEEN TIMESTAMP '1996-06-01' - INTERVAL 200 DAY AND TIMESTAMP '1996-06-01') WHERE k = 1""",
)(lambda f: overlay.last_known_good(f["snapshot"], "source_id", "1996-06-01", "200 DAY"))
query(
    "vehicle_attributes",
    "journey vehicle_attribute",
    """SELECT journey_id, attribute, source_id FROM (SELECT j.journey_id, a.attribute, a.source_id, row_number() OVER (PARTITION BY j.journey_id ORDER BY a.priority, a.valid_from DESC, a.source_id) AS k
       FROM journey j LEFT JOIN vehicle_attribute a ON a.number = j.number AND j.service_date >= a.valid_from AND (a.valid_to IS NULL OR j.service_date <= a.valid_to)) WHERE k = 1""",
)(lambda f: export.dated_attributes(f["journey"], f["vehicle_attribute"], "number").select("journey_id", "attribute", "source_id"))
query(
    "train_compositions",
    "journey composition",
    """SELECT train_number, service_date, position, vehicle_type FROM (SELECT j.*, c.position, c.vehicle_type, c.priority, min(c.priority) OVER (PARTITION BY j.train_number, j.service_date) AS best
       FROM (SELECT DISTINCT CAST(number AS INT) AS train_number, service_date FROM journey) j JOIN composition c ON c.train_number = j.train_number AND j.service_date BETWEEN c.valid_from AND c.valid_to) WHERE priority = best""",
)(lambda f: overlay.train_composition(f["journey"].select(F.col("number").cast("int").alias("train_number"), "service_date"), f["composition"]))
query("parent_stops", "trip_call location", """WITH u AS (SELECT DISTINCT c.location_id, CAST(c.pickup_type AS VARCHAR) AS platform, l.name FROM trip_call c JOIN location l USING (location_id))
   SELECT location_id || ':' || platform AS stop_id, name AS stop_name, location_id AS parent_station, platform AS platform_code FROM u UNION ALL SELECT DISTINCT location_id, name, NULL, NULL FROM u""")(
    lambda f: export.parent_stops(f["trip_call"].select("location_id", F.col("pickup_type").cast("string").alias("platform")), f["location"].select("location_id", "name"))
)
query("chosen_shapes", "trip", "SELECT trip_id, CASE WHEN direction = 0 AND shape_id IS NOT NULL THEN 'r' || shape_id WHEN direction < 2 AND shape_id IS NOT NULL THEN 'n' || shape_id ELSE shape_id END AS shape_id, CASE WHEN shape_id IS NULL THEN 'none' WHEN direction = 0 THEN 'regional' WHEN direction = 1 THEN 'national' ELSE 'generated' END AS origin FROM trip")(
    lambda f: export.chosen_shape(f["trip"], *[f["trip"].filter(f"direction < {n} AND shape_id IS NOT NULL").select("trip_id", F.concat(F.lit(p), "shape_id").alias("shape_id")) for n, p in ((1, "r"), (2, "n"), (3, ""))])
)
query(
    "shape_offsets",
    "offset_call",
    """WITH n AS (SELECT *, last_value(off_km IGNORE NULLS) OVER (PARTITION BY trip_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM offset_call),
       p AS (SELECT trip_id, CASE WHEN count(off_km) > 0 AND count(off_km) < count(*) THEN 'incomplete' WHEN bool_or(off_km < b) THEN 'falls' WHEN bool_or(off_km > length OR off_km < 0) THEN 'outside' END AS problem FROM n GROUP BY trip_id)
       SELECT * FROM p WHERE problem IS NOT NULL""",
)(lambda f: export.shape_offsets(f["offset_call"].withColumnRenamed("off_km", "offset")))
query("extension_references", "extension route trip", "SELECT 'x' AS extension, 'route_id' AS \"column\", (SELECT count(*) FROM extension WHERE route_id NOT IN (SELECT route_id FROM route)) AS violations UNION ALL SELECT 'x', 'trip_id', (SELECT count(*) FROM extension WHERE trip_id NOT IN (SELECT trip_id FROM trip))")(
    lambda f: export.extension_violations({"x": f["extension"]}, {"route_id": (f["route"], "route_id"), "trip_id": (f["trip"], "trip_id")})
)
query("foreign_points", "location", "SELECT location_id AS point_id FROM location WHERE longitude IS NULL AND location_id NOT LIKE 'SP:%' AND location_id NOT IN (SELECT location_id FROM location WHERE wheelchair_boarding = 1)")(
    lambda f: export.without_disposition(f["location"].select(F.col("location_id").alias("point_id"), F.col("longitude").isNotNull().alias("resolved")), f["location"].filter("wheelchair_boarding = 1").select(F.col("location_id").alias("point_id"), F.lit(" reviewed").alias("disposition")), "SP:").select("point_id")
)
query(
    "operational_points",
    "trip_call",
    """SELECT trip_id, sequence, coalesce(sequence BETWEEN a AND b, false) AND (passenger_service OR location_id <> 'SP:3') AS published FROM (SELECT *, min(sequence) FILTER (WHERE passenger_service) OVER (PARTITION BY trip_id) AS a, max(sequence) FILTER (WHERE passenger_service) OVER (PARTITION BY trip_id) AS b FROM trip_call)""",
)(lambda f: overlay.operational_points(f["trip_call"].withColumn("longitude", F.when(F.col("location_id") != "SP:3", 1.0)), "gtfs").select("trip_id", "sequence", "published"))
query(
    "regional_adjacent",
    "abroad_call",
    """WITH far AS (SELECT a.trip_id, a.sequence, least(a.distance_km - max(h.distance_km) FILTER (WHERE h.sequence < a.sequence), min(h.distance_km) FILTER (WHERE h.sequence > a.sequence) - a.distance_km) AS d
         FROM abroad_call a JOIN abroad_call h ON h.trip_id = a.trip_id AND h.country = 'CZ' WHERE a.country <> 'CZ' GROUP BY a.trip_id, a.sequence, a.distance_km), deep AS (SELECT trip_id, max(d) AS d FROM far GROUP BY trip_id),
       t AS (SELECT trip_id, count(*) FILTER (WHERE country = 'CZ') AS h, count(*) FILTER (WHERE country <> 'CZ') AS a, bool_and(country IN ('CZ', 'DE', 'PL')) AS near, max(distance_km) - min(distance_km) AS span_km, bool_and(integrated) AS i FROM abroad_call GROUP BY trip_id)
       SELECT trip_id, span_km, coalesce(d, 0.0::DOUBLE) AS depth_km, CASE WHEN a = 0 THEN 'domestic' WHEN h = 0 THEN 'foreign' WHEN near AND span_km <= CASE WHEN i THEN 200 ELSE 120 END AND coalesce(d, 0) <= CASE WHEN i THEN 80 ELSE 60 END THEN 'adjacent' ELSE 'rejected' END AS disposition
       FROM t LEFT JOIN deep USING (trip_id)""",
)(lambda f: overlay.regional_adjacent(f["abroad_call"], "CZ", ["DE", "PL"]))
query("transfers_of_claims", "connection_claim", "SELECT connection_id, origin_trip_id AS from_trip_id, target_trip_id AS to_trip_id, wait_minutes * 60 AS minimum_transfer_time FROM connection_claim WHERE resolution_status = 'resolved' AND target_trip_id IS NOT NULL")(
    lambda f: overlay.transfers_of(f["connection_claim"])
)
_LEDGER = [("connection_claim", None, "Interchange", "ext:Claim", "resolved"), ("location_feature", "toilet", "SanitaryFacility", "ext:Code", None), ("location_feature", "pool", None, "ext:Code", None)]


@query(
    "ledger_projection",
    "connection_claim location_feature",
    """SELECT connection_id AS id, CASE WHEN resolution_status = 'resolved' THEN 'Interchange' ELSE 'ext:Claim' END AS target, resolution_status = 'resolved' AS standard FROM connection_claim
       UNION ALL SELECT feature_id, CASE kind WHEN 'toilet' THEN 'SanitaryFacility' ELSE 'ext:Code' END, kind = 'toilet' FROM location_feature""",
)
def _ledger(f: Frames) -> DataFrame:
    claims = f["connection_claim"].select(F.col("connection_id").alias("id"), F.lit("connection_claim").alias("relation"), F.lit(None).cast("string").alias("kind"), F.col("resolution_status").alias("resolution"))
    features = f["location_feature"].select(F.col("feature_id").alias("id"), F.lit("location_feature").alias("relation"), "kind", F.lit(None).cast("string").alias("resolution"))
    ledger = claims.sparkSession.createDataFrame(_LEDGER, "relation string, kind string, standard_target string, extension_target string, needs string")
    return overlay.through_ledger(claims.unionByName(features), F.broadcast(ledger)).select("id", "target", "standard")


query("zones_of_calls", "trip_call trip call_zone", """WITH z AS (SELECT DISTINCT t.route_id, c.location_id, x.zone_id FROM call_zone x JOIN trip_call c USING (trip_id, sequence) JOIN trip t USING (trip_id))
   SELECT c.trip_id, c.sequence, z.zone_id FROM trip_call c JOIN trip t USING (trip_id) JOIN z ON z.route_id = t.route_id AND z.location_id = c.location_id WHERE c.sequence = 10""")(
    lambda f: overlay.zones_of_calls(
        f["trip_call"].filter("sequence = 10").join(f["trip"].select("trip_id", "route_id"), "trip_id").select("trip_id", "sequence", "route_id", "location_id"),
        f["call_zone"].join(f["trip_call"].select("trip_id", "sequence", "location_id"), ["trip_id", "sequence"]).join(f["trip"].select("trip_id", "route_id"), "trip_id").select("route_id", "location_id", "zone_id").distinct(),
    ).select("trip_id", "sequence", "zone_id")
)
query("extended_types", "route", "SELECT route_id, CASE WHEN mode = 'bus' THEN CASE route_number % 3 WHEN 0 THEN 704 WHEN 1 THEN 701 ELSE 202 END END AS extended_type FROM route")(
    lambda f: f["route"].select("route_id", overlay.extended_type(F.col("mode"), F.element_at(F.array(F.lit("city"), F.lit("regional"), F.lit("long_distance")), F.col("route_number") % 3 + 1)).alias("extended_type"))
)
query(
    "build_report",
    "location trip trip_call",
    """SELECT 'location' AS relation, 'rows' AS metric, (SELECT count(*) FROM location) AS value UNION ALL SELECT 'location', 'without_coordinates', (SELECT count(*) FROM location WHERE longitude IS NULL)
       UNION ALL SELECT 'location', 'boarding_points', (SELECT count(*) FROM location WHERE kind = 'boarding_point') UNION ALL SELECT 'trip', 'rows', (SELECT count(*) FROM trip)
       UNION ALL SELECT 'trip', 'without_headsign', (SELECT count(*) FROM trip WHERE headsign IS NULL) UNION ALL SELECT 'trip', 'without_shape', (SELECT count(*) FROM trip WHERE shape_id IS NULL)
       UNION ALL SELECT 'trip_call', 'rows', (SELECT count(*) FROM trip_call) UNION ALL SELECT 'trip_call', 'passenger', (SELECT count(*) FROM trip_call WHERE passenger_service)
       UNION ALL SELECT 'trip_call', 'without_time', (SELECT count(*) FROM trip_call WHERE scheduled_arrival IS NULL AND scheduled_departure IS NULL AND scheduled_passage IS NULL)""",
)(lambda f: export.build_report({k: f[k] for k in ("location", "trip", "trip_call")}))

# matching

_DEGREE = f"{matching.STEP_KM / matching.DEGREE_KM!r}::DOUBLE"
query(
    "coordinate_estimates",
    "trip_call matched_point",
    f"""WITH c AS (SELECT trip_id, sequence, location_id AS point_id, coalesce(scheduled_departure, scheduled_passage) AS s, m.longitude AS x, m.latitude AS y, row_number() OVER (PARTITION BY trip_id ORDER BY sequence) AS n FROM trip_call LEFT JOIN matched_point m ON m.point_id = location_id),
        o AS (SELECT *, CASE WHEN x IS NOT NULL AND s IS NOT NULL THEN {{'x': x, 'y': y, 's': s, 'n': n}} END AS own FROM c),
        w AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY trip_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, first_value(own IGNORE NULLS) OVER (PARTITION BY trip_id ORDER BY sequence ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM o),
        e AS (SELECT point_id, trip_id, sequence, a IS NOT NULL AND b IS NOT NULL AS two, coalesce(a, b) AS one, a, b, n, CASE WHEN b.s <> a.s THEN (s - a.s) / (b.s - a.s) ELSE 0.5 END AS f FROM w WHERE x IS NULL AND s IS NOT NULL AND (a IS NOT NULL OR b IS NOT NULL)),
        r AS (SELECT point_id, two, CASE WHEN two THEN a.x + (b.x - a.x) * f ELSE one.x END AS longitude, CASE WHEN two THEN a.y + (b.y - a.y) * f ELSE one.y + abs(n - one.n) * {_DEGREE} END AS latitude, row_number() OVER (PARTITION BY point_id ORDER BY NOT two,
              CASE WHEN two THEN b.n - a.n ELSE abs(n - one.n) END, round(CASE WHEN two THEN 2 * 6371.0::DOUBLE * asin(sqrt(pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2))) ELSE 0 END, 6), trip_id, sequence) AS k FROM e)
        SELECT point_id, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude, two AS two_sided FROM r WHERE k = 1""",
)(
    lambda f: matching.estimates(f["trip_call"].select("trip_id", "sequence", F.col("location_id").alias("point_id"), F.coalesce("scheduled_departure", "scheduled_passage").alias("seconds"), F.lit(1).alias("days")), f["matched_point"]).select(
        "point_id", F.round("longitude", 6).alias("longitude"), F.round("latitude", 6).alias("latitude"), "two_sided"
    )
)
query("fuzzy_names", "word_name", "SELECT a.id AS point_id, b.id AS object_id, CAST(levenshtein(a.name, b.name) AS INT) AS edits FROM word_name a JOIN word_name b ON levenshtein(a.name, b.name) <= 2 WHERE a.id % 7 = 0 AND length(a.name) > 2 AND length(b.name) > 2")(
    lambda f: matching.fuzzy_pairs(f["word_name"].filter("id % 7 = 0 AND length(name) > 2").select(F.col("id").alias("point_id"), F.col("name").alias("_p")), f["word_name"].select(F.col("id").alias("object_id"), F.col("name").alias("_o"))).select("point_id", "object_id", "edits")
)

# realtime

query(
    "same_alerts",
    "alert",
    """SELECT trim(regexp_replace(lower(text), '[\\s!-/:-@\\[-`{-~]+', ' ', 'g')) AS normal_text, period_start, period_end, scope, min(alert_id) AS alert_id, count(*) AS copies FROM alert GROUP BY ALL""",
)(lambda f: realtime.same_alerts(f["alert"]))
query("platforms", "platform_claim", """SELECT event_id, coalesce(infrastructure, operator, previous, scheduled) AS platform, CASE WHEN infrastructure IS NOT NULL THEN 'infrastructure' WHEN operator IS NOT NULL THEN 'operator' WHEN previous IS NOT NULL THEN 'previous'
   WHEN scheduled IS NOT NULL THEN 'scheduled' ELSE 'unspecified' END AS origin FROM platform_claim""")(
    lambda f: f["platform_claim"].select("event_id", realtime.platform(*[F.col(c) for c in ("infrastructure", "operator", "previous", "scheduled")]).alias("x")).select("event_id", "x.*")
)
query(
    "stop_passages",
    "position mark",
    """WITH w AS (SELECT *, lag(seconds) OVER v AS s0, lag(distance) OVER v AS d0 FROM position WINDOW v AS (PARTITION BY vehicle ORDER BY seconds)),
       x AS (SELECT m.vehicle, m.stop_id, k.n, min(s0 + (seconds - s0) * (m.at + k.d - d0) / (distance - d0)) AS t FROM w JOIN mark m USING (vehicle), (VALUES ('in', -30.0::DOUBLE), ('at', 0.0::DOUBLE), ('out', 30.0::DOUBLE)) k(n, d) WHERE d0 < m.at + k.d AND distance >= m.at + k.d GROUP BY ALL),
       p AS (SELECT vehicle, stop_id, min(t) FILTER (WHERE n = 'in') AS i, min(t) FILTER (WHERE n = 'at') AS c, min(t) FILTER (WHERE n = 'out') AS o FROM x GROUP BY ALL)
       SELECT vehicle, stop_id, CASE WHEN NOT coalesce(o - i < 10, false) THEN i END AS arrival, CASE WHEN NOT coalesce(o - i < 10, false) THEN o END AS departure, CASE WHEN o - i < 10 THEN c END AS passage FROM p""",
)(lambda f: realtime.stop_events(f["position"], f["mark"], "vehicle"))
query("observations_by_day", "claim", "SELECT CAST(event_time AS DATE) AS day, count(*) AS n FROM claim GROUP BY 1")(lambda f: f["claim"].groupBy(F.to_date("event_time").alias("day")).agg(F.count("*").alias("n")))

# feeds

query("feed_routes", "agency route trip location trip_call service_calendar service_exception shape_point", "SELECT route_id, agency_id, gtfs_route_type AS route_type FROM route")(lambda f: export.feed(f)["routes.txt"][0])
query(
    "feed_stops",
    "agency route trip location trip_call service_calendar service_exception shape_point",
    """WITH u AS (SELECT boarding_point_id AS u FROM trip_call WHERE passenger_service UNION SELECT location_id FROM trip_call WHERE passenger_service), d AS (SELECT * FROM location WHERE kind <> 'operational_point' AND location_id IN (SELECT u FROM u WHERE u IS NOT NULL))
       SELECT location_id AS stop_id, name AS stop_name, latitude AS stop_lat, longitude AS stop_lon, CAST(CASE kind WHEN 'stop_place' THEN 1 ELSE 0 END AS INT) AS location_type, parent_location_id AS parent_station FROM location
       WHERE kind <> 'operational_point' AND location_id IN (SELECT location_id FROM d UNION SELECT parent_location_id FROM d WHERE parent_location_id IS NOT NULL)""",
)(lambda f: export.feed(f)["stops.txt"][0].withColumnRenamed("parent_station?", "parent_station"))
query(
    "feed_trips",
    "agency route trip location trip_call service_calendar service_exception shape_point",
    "SELECT route_id, service_id, trip_id, headsign AS trip_headsign, direction AS direction_id, shape_id FROM trip",
)(lambda f: export.feed(f)["trips.txt"][0].toDF("route_id", "service_id", "trip_id", "trip_headsign", "direction_id", "shape_id"))
query("extension_trips", "route trip trip_call call_zone source_trip_map", "SELECT t.trip_id, string_agg(DISTINCT source_id || ':' || trip_namespace || ':' || source_trip_id, '|' ORDER BY source_id || ':' || trip_namespace || ':' || source_trip_id) AS source_trip_ids FROM trip t JOIN source_trip_map USING (trip_id) GROUP BY t.trip_id")(
    lambda f: export.extensions(f)["cz_trips.txt"][0]
)
query(
    "extension_zones",
    "route trip trip_call call_zone source_trip_map",
    """SELECT DISTINCT trip_id, CAST(k AS INT) AS stop_sequence, fare_system_id, zone_id FROM call_zone JOIN (SELECT trip_id, sequence, row_number() OVER (PARTITION BY trip_id ORDER BY sequence) AS k FROM trip_call WHERE passenger_service) USING (trip_id, sequence)""",
)(lambda f: export.extensions(f)["cz_trip_stop_zones.txt"][0])
