"""All queries by name, and the SQL that gives the same rows: operators over the projections of the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import DOMAINS, REFERENCES
from ..functions import names
from ..operators import checks, derive, export, matching, overlay, reconcile, resolve
from ..sources import readers
from ..streaming import realtime
from . import further, more  # noqa: F401  their queries register themselves
from .base import QUERIES, Frames, Query, query
from .projections import cte, frames

# resolution of foreign identifiers

_TRIP_ON = """o.source_id = m.source_id AND o.trip_namespace = m.trip_namespace AND o.source_trip_id = m.source_trip_id AND o.service_date BETWEEN m.valid_from AND m.valid_to
  AND (o.scheduled_start IS NULL OR m.scheduled_start = o.scheduled_start)"""
_ROUTE_ON = " AND (o.source_route_id IS NULL OR m.source_route_id IS NULL OR m.source_route_id = o.source_route_id)"


def _one_sql(value: str, count: str, keys: str = "event_id") -> str:
    return f"""SELECT {keys}, CASE WHEN {count} = 0 THEN 'unmatched' WHEN {count} = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN {count} = 1 THEN {value} END"""


_SOURCE_TRIP = _one_sql("min(m.trip_id)", "count(DISTINCT m.trip_id)", "o.event_id") + f" AS trip_id FROM observation o LEFT JOIN source_trip_map m ON {_TRIP_ON}{_ROUTE_ON} GROUP BY o.event_id"


def _trips_of(f: Frames) -> DataFrame:
    o = f["observation"].select("event_id", "source_id", "trip_namespace", "source_trip_id", "service_date", "scheduled_start", "source_route_id")
    return resolve.source_trip(o, f["source_trip_map"], ["event_id"])


query("resolve_source_trip", "observation source_trip_map", _SOURCE_TRIP)(_trips_of)


@query("resolve_status_counts", "observation source_trip_map", f"SELECT status, count(*) AS n FROM ({_SOURCE_TRIP}) GROUP BY status")
def _status_counts(f: Frames) -> DataFrame:
    return _trips_of(f).groupBy("status").agg(F.count("*").alias("n"))


@query(
    "resolve_alias_fallback",
    "observation identifier_alias",
    """SELECT o.event_id, CASE WHEN count(m.canonical_value) = 0 THEN 'unaliased' WHEN count(m.canonical_value) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status,
       CASE WHEN count(m.canonical_value) = 0 THEN o.observed_id WHEN count(m.canonical_value) = 1 THEN min(m.canonical_value) END AS canonical
       FROM observation o LEFT JOIN identifier_alias m ON o.source_id = m.source_id AND o.namespace = m.namespace AND o.observed_id = m.observed_id
        AND m.valid_from <= o.service_date AND (m.valid_to IS NULL OR m.valid_to >= o.service_date) GROUP BY o.event_id, o.observed_id""",
)
def _alias(f: Frames) -> DataFrame:
    return resolve.alias(f["observation"].select("event_id", "source_id", "namespace", "observed_id", "service_date"), f["identifier_alias"], ["event_id"])


@query(
    "resolve_entity",
    "observation source_entity_map",
    _one_sql("min(m.public_id)", "count(DISTINCT m.public_id)", "o.event_id")
    + """ AS public_id FROM observation o LEFT JOIN source_entity_map m ON o.source_id = m.source_id AND o.identifier_namespace = m.identifier_namespace AND o.entity_kind = m.entity_kind
          AND o.source_object_id = m.source_object_id GROUP BY o.event_id""",
)
def _entity(f: Frames) -> DataFrame:
    return resolve.entity(f["observation"].select("event_id", "source_id", "identifier_namespace", "entity_kind", "source_object_id"), f["source_entity_map"], ["event_id"])


@query(
    "resolve_call_two_step",
    "observation source_trip_map source_call_map_of_trips",
    f"""SELECT t.event_id, CASE WHEN t.n = 0 THEN 'unmatched' WHEN t.n > 1 THEN 'ambiguous' WHEN count(DISTINCT c.call_sequence) = 0 THEN 'unmatched' WHEN count(DISTINCT c.call_sequence) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status,
        CASE WHEN t.n = 1 AND count(DISTINCT c.call_sequence) = 1 THEN t.trip_id END AS trip_id, CASE WHEN t.n = 1 AND count(DISTINCT c.call_sequence) = 1 THEN min(c.call_sequence) END AS call_sequence
        FROM (SELECT o.event_id, o.source_id, o.trip_namespace, o.source_trip_id, o.call_namespace, o.source_sequence, count(DISTINCT m.trip_id) AS n, min(m.trip_id) AS trip_id
              FROM observation o LEFT JOIN source_trip_map m ON {_TRIP_ON} GROUP BY ALL) t
        LEFT JOIN source_call_map_of_trips c ON t.n = 1 AND c.source_id = t.source_id AND c.trip_namespace = t.trip_namespace AND c.source_trip_id = t.source_trip_id AND c.call_namespace = t.call_namespace
         AND c.source_sequence = t.source_sequence AND c.trip_id = t.trip_id GROUP BY t.event_id, t.n, t.trip_id""",
)
def _call(f: Frames) -> DataFrame:
    o = f["observation"].select("event_id", "source_id", "trip_namespace", "source_trip_id", "call_namespace", "source_sequence", "service_date", "scheduled_start")
    # the trip step reads event_id as part of the observation
    return resolve.source_call(o, f["source_trip_map"], f["source_call_map_of_trips"], ["event_id"])


@query(
    "resolve_road_key",
    "observation road_trip_key",
    _one_sql("min(m.trip_id)", "count(DISTINCT m.trip_id)", "o.event_id")
    + " AS trip_id FROM observation o LEFT JOIN road_trip_key m ON o.cis_line_id = m.cis_line_id AND o.cis_trip_id = m.cis_trip_id AND o.service_date BETWEEN m.valid_from AND m.valid_to GROUP BY o.event_id",
)
def _road(f: Frames) -> DataFrame:
    return resolve.road_trip(f["observation"].select("event_id", "cis_line_id", "cis_trip_id", "service_date"), f["road_trip_key"], ["event_id"])


@query(
    "resolve_rail_key",
    "observation rail_trip_key",
    _one_sql("min(m.trip_id)", "count(DISTINCT m.trip_id)", "o.event_id") + " AS trip_id FROM observation o LEFT JOIN rail_trip_key m ON o.train_number = m.train_number AND o.service_date BETWEEN m.valid_from AND m.valid_to GROUP BY o.event_id",
)
def _rail(f: Frames) -> DataFrame:
    return resolve.rail_trip(f["observation"].select("event_id", "train_number", "service_date"), f["rail_trip_key"], ["event_id"])


# checks: rows that violate, and their counts

_PARENT = "SELECT c.location_id FROM location c LEFT JOIN location p ON p.location_id = c.parent_location_id WHERE c.kind = 'boarding_point' AND (p.location_id IS NULL OR p.kind <> 'stop_place' OR p.domain <> c.domain)"
_SHAPE = """SELECT trip_id, sequence FROM trip_call WHERE (passenger_service AND (boarding_point_id IS NULL OR scheduled_passage IS NOT NULL)) OR (NOT passenger_service AND (boarding_point_id IS NOT NULL
            OR scheduled_arrival IS NOT NULL OR scheduled_departure IS NOT NULL OR pickup_type <> 1 OR dropoff_type <> 1))"""
_KIND = "SELECT c.trip_id, c.sequence FROM trip_call c JOIN location l ON l.location_id = c.boarding_point_id WHERE l.kind <> 'boarding_point'"
_ENDS = """SELECT c.coverage_id FROM source_trip_coverage c LEFT JOIN trip_call a ON a.trip_id = c.trip_id AND a.sequence = c.from_sequence LEFT JOIN trip_call b ON b.trip_id = c.trip_id AND b.sequence = c.to_sequence
           WHERE a.trip_id IS NULL OR b.trip_id IS NULL"""
_COVER = "SELECT c.coverage_id FROM source_trip_coverage c LEFT JOIN source_trip_map m USING (source_id, trip_namespace, source_trip_id, trip_id) WHERE m.valid_from IS NULL"
_CALLS = "SELECT c.trip_id, c.call_sequence FROM source_call_map c LEFT JOIN source_trip_map m USING (source_id, trip_namespace, source_trip_id, trip_id) WHERE m.valid_from IS NULL"
_OVERLAP = """SELECT a.trip_id, a.from_sequence AS left_from, a.to_sequence AS left_to, b.from_sequence AS right_from, b.to_sequence AS right_to
              FROM route_segment a JOIN route_segment b ON a.trip_id = b.trip_id AND a.from_sequence < b.from_sequence AND a.to_sequence >= b.from_sequence"""
_NOTE = "SELECT note_id FROM service_note WHERE label IS NULL AND text IS NULL"
_FEATURE = """SELECT f.feature_id FROM service_feature_assignment f LEFT JOIN route r ON r.route_id = f.route_id LEFT JOIN trip t ON t.trip_id = f.trip_id
              LEFT JOIN trip_call c ON c.trip_id = f.trip_id AND c.sequence = f.call_sequence LEFT JOIN service_note n ON n.note_id = f.note_id
              WHERE (f.scope = 'route' AND r.route_id IS NULL) OR (f.scope = 'trip' AND t.trip_id IS NULL) OR (f.scope = 'call' AND c.trip_id IS NULL) OR (f.note_id IS NOT NULL AND n.note_id IS NULL)"""
_PLACE = "SELECT f.feature_id FROM location_feature f LEFT JOIN location l ON l.location_id = f.location_id WHERE l.location_id IS NULL"
_STATE = """SELECT connection_id FROM connection_claim WHERE (resolution_status = 'resolved' AND target_trip_id IS NULL) OR (resolution_status = 'pattern' AND target_route_id IS NULL)
            OR (resolution_status = 'unresolved' AND (target_trip_id IS NOT NULL OR target_route_id IS NOT NULL))
            OR (target_derivation = 'none' AND (target_public_line IS NOT NULL OR target_destination_text IS NOT NULL OR target_source_route_id IS NOT NULL OR target_source_trip_id IS NOT NULL
                OR target_source_stop_id IS NOT NULL OR target_source_post_id IS NOT NULL OR target_source_end_stop_id IS NOT NULL OR target_source_end_post_id IS NOT NULL))"""
_TARGETS = """SELECT c.connection_id FROM connection_claim c LEFT JOIN route r ON r.route_id = c.target_route_id LEFT JOIN trip t ON t.trip_id = c.target_trip_id LEFT JOIN location l ON l.location_id = c.target_location_id
              WHERE (c.target_route_id IS NOT NULL AND r.route_id IS NULL) OR (c.target_trip_id IS NOT NULL AND t.trip_id IS NULL) OR (c.target_location_id IS NOT NULL AND l.location_id IS NULL)"""
_RESTRICT = """SELECT v.assignment_id FROM travel_restriction_assignment v LEFT JOIN route r ON r.route_id = v.route_id LEFT JOIN trip_call c ON c.trip_id = v.trip_id AND c.sequence = v.call_sequence
               WHERE (v.scope = 'route_stop' AND r.route_id IS NULL) OR (v.scope = 'trip_call' AND c.trip_id IS NULL)"""

for _name, _needs, _check, _columns, _sql in (
    ("check_parent_domain", "location", "location parent kind/domain", "location_id", _PARENT),
    ("check_call_shape", "trip_call", "trip call shape", "trip_id sequence", _SHAPE),
    ("check_boarding_kind", "trip_call location", "boarding point kind", "trip_id sequence", _KIND),
    ("check_coverage_endpoints", "source_trip_coverage trip_call", "coverage endpoints", "coverage_id", _ENDS),
    ("check_map_anti", "source_trip_coverage source_trip_map", "coverage source trip mapping", "coverage_id", _COVER),
    ("check_call_map_anti", "source_call_map source_trip_map", "source call trip mapping", "trip_id call_sequence", _CALLS),
    ("check_overlap_pairs", "route_segment", "overlapping route segments", "trip_id left_from left_to right_from right_to", _OVERLAP),
    ("check_empty_note", "service_note", "empty service note", "note_id", _NOTE),
    ("check_feature_scope", "service_feature_assignment route trip trip_call service_note", "service feature references", "feature_id", _FEATURE),
    ("check_location_feature", "location_feature location", "location feature references", "feature_id", _PLACE),
    ("check_connection_state", "connection_claim", "connection resolution", "connection_id", _STATE),
    ("check_connection_refs", "connection_claim route trip location", "connection target references", "connection_id", _TARGETS),
    ("check_restriction_scope", "travel_restriction_assignment route trip_call", "travel restriction references", "assignment_id", _RESTRICT),
):
    query(_name, _needs, _sql)(lambda f, c=checks.CHECKS[_check], k=tuple(_columns.split()): c(f).select(*k))

query("check_overlap_linear", "route_segment", "SELECT DISTINCT b.trip_id, b.from_sequence, b.to_sequence, b.route_id FROM route_segment a JOIN route_segment b ON a.trip_id = b.trip_id AND a.from_sequence < b.from_sequence AND a.to_sequence >= b.from_sequence")(
    checks.segments_in_overlap
)

_ALL = "location trip_call source_trip_coverage source_trip_map source_call_map route_segment service_note service_feature_assignment route trip location_feature connection_claim travel_restriction_assignment"
_ALL_SQL = (_PARENT, _SHAPE, _KIND, _ENDS, _COVER, _CALLS, _OVERLAP, _NOTE, _FEATURE, _PLACE, _STATE, _TARGETS, _RESTRICT)
query("all_checks_summary", _ALL, " UNION ALL ".join(f"SELECT '{label}' AS \"check\", (SELECT count(*) FROM ({s})) AS violations" for label, s in zip(checks.CHECKS, _ALL_SQL)))(checks.summary)

_FK_NEEDS = "agency location route service_calendar service_exception trip trip_call route_segment service_note service_feature_assignment location_feature source_trip_map source_trip_coverage rail_trip_key road_trip_key"


def _fk_sql() -> str:
    there = set(_FK_NEEDS.split())
    out = []
    for r in REFERENCES:
        if r.child in there and r.parent in there and _has(r.child, r.columns):
            on = " AND ".join(f"p.{p} = c.{k}" for k, p in zip(r.columns, r.parent_columns))
            known = " AND ".join(f"c.{k} IS NOT NULL" for k in r.columns)
            out.append(f"SELECT '{r.name}' AS reference, (SELECT count(*) FROM {r.child} c WHERE {known} AND NOT EXISTS (SELECT 1 FROM {r.parent} p WHERE {on})) AS violations")
    return " UNION ALL ".join(out)


def _has(child: str, columns: tuple[str, ...]) -> bool:
    """The projections lack some optional columns."""
    return not (child == "trip" and columns == ("shape_id",))


@query("fk_violations", _FK_NEEDS, _fk_sql())
def _fk(f: Frames) -> DataFrame:
    return checks._counted([(x.name, checks.reference_violations(f, x)) for x in REFERENCES if x.child in f and x.parent in f and _has(x.child, x.columns)], "reference")


_DOMAIN_NEEDS = ("location", "route", "service_calendar", "trip", "trip_call", "route_segment")


def _domain_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{r}' AS relation, '{k}' AS condition, (SELECT count(*) FROM {r} WHERE NOT ({c})) AS violations" for r in _DOMAIN_NEEDS for k, c in DOMAINS[r].items())


query("domain_violations", " ".join(_DOMAIN_NEEDS), _domain_sql())(checks.domains_summary)


@query(
    "key_order_violations",
    "trip_call",
    """SELECT kind, count(*) AS violations FROM (SELECT CASE WHEN b IS NULL THEN NULL WHEN k = b THEN 'duplicate' WHEN k < b THEN 'unsorted' END AS kind FROM (
         SELECT location_id AS k, lag(location_id) OVER (ORDER BY trip_id, sequence) AS b FROM trip_call)) WHERE kind IS NOT NULL GROUP BY kind""",
)
def _key_order(f: Frames) -> DataFrame:
    # ranges of the order hold consecutive rows, and there are as many as the rows fill
    rows = f["trip_call"].repartitionByRange("trip_id", "sequence").withColumn("at", F.struct("trip_id", "sequence")).withColumn("part", F.spark_partition_id())
    return checks.key_order(rows, ["location_id"], "at", "part")


# derivations


def _km_sql(side: str) -> str:
    return f"2 * 6371.0::DOUBLE * asin(sqrt(pow(sin(radians(y - {side}.y) / 2), 2) + cos(radians({side}.y)) * cos(radians(y)) * pow(sin(radians(x - {side}.x) / 2), 2)))"


query(
    "shape_linestring",
    "shape_point",
    """SELECT shape_id, count(*) AS n_points, CASE WHEN count(*) > 1 THEN 'LINESTRING(' || string_agg(CAST(CAST(longitude AS DECIMAL(12,6)) AS VARCHAR) || ' ' || CAST(CAST(latitude AS DECIMAL(12,6)) AS VARCHAR), ', ' ORDER BY sequence) || ')' END AS line
       FROM shape_point GROUP BY shape_id""",
)(lambda f: derive.shape_lines(f["shape_point"]))
query(
    "shape_distance_falls",
    "shape_point",
    """SELECT shape_id, sequence FROM (SELECT *, last_value(distance_traveled IGNORE NULLS) OVER (PARTITION BY shape_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM shape_point) WHERE distance_traveled < b""",
)(lambda f: derive.monotone_violations(f["shape_point"]).select("shape_id", "sequence"))

_DAYS = "SELECT service_id, CAST(d AS DATE) AS service_date FROM (SELECT service_id, weekday_mask, unnest(generate_series(valid_from, valid_to, INTERVAL 1 DAY)) AS d FROM service_calendar WHERE valid_to >= valid_from) WHERE (CAST(weekday_mask AS INT) >> CAST(isodow(d) - 1 AS INT)) & 1 = 1"
query("calendar_active_days", "service_calendar", _DAYS)(lambda f: derive.active_days(f["service_calendar"].filter("valid_to >= valid_from")))
_WITH_EXCEPTIONS = f"""SELECT DISTINCT service_id, service_date FROM (({_DAYS} EXCEPT SELECT service_id, service_date FROM service_exception WHERE NOT added) UNION ALL SELECT service_id, service_date FROM service_exception WHERE added)"""
query("calendar_with_exceptions", "service_calendar service_exception", _WITH_EXCEPTIONS)(lambda f: derive.active_days(f["service_calendar"].filter("valid_to >= valid_from"), f["service_exception"]))
query("trip_instances_per_day", "service_calendar trip", f"SELECT service_date, count(*) AS trips FROM trip JOIN ({_DAYS}) d USING (service_id) GROUP BY service_date")(
    lambda f: derive.trips_per_day(f["trip"], f["service_calendar"].filter("valid_to >= valid_from"))
)
query(
    "operating_patterns",
    "service_calendar",
    f"SELECT service_id, 'pattern:' || substr(sha256(string_agg(CAST(service_date AS VARCHAR), ',' ORDER BY service_date)), 1, 16) AS pattern_id, count(*) AS n_days FROM ({_DAYS}) GROUP BY service_id",
)(lambda f: derive.operating_patterns(derive.active_days(f["service_calendar"].filter("valid_to >= valid_from"))))

_OVER = "OVER (PARTITION BY trip_id ORDER BY sequence)"
query(
    "segment_line_changes",
    "trip_call",
    f"""SELECT trip_id, segment, line_id, min(sequence) AS from_sequence, max(sequence) AS to_sequence FROM (SELECT *, CAST(sum(n) {_OVER} AS BIGINT) AS segment FROM (
        SELECT *, CASE WHEN row_number() {_OVER} > 1 AND line_id IS DISTINCT FROM lag(line_id) {_OVER} THEN 1 ELSE 0 END AS n FROM trip_call)) GROUP BY trip_id, segment, line_id""",
)(lambda f: derive.change_segments(f["trip_call"], "line_id"))
query(
    "collapse_consecutive",
    "turn",
    f"SELECT trip_id, sequence, role FROM (SELECT *, row_number() {_OVER} AS k, lag(role) {_OVER} AS b FROM turn) WHERE k = 1 OR role IS DISTINCT FROM b",
)(lambda f: derive.collapse_consecutive(f["turn"], "role").select("trip_id", "sequence", "role"))
query(
    "reject_bad_chronology",
    "trip_call",
    """SELECT trip_id, sequence FROM trip_call WHERE trip_id NOT IN (SELECT trip_id FROM (SELECT trip_id, scheduled_departure AS t,
       max(CASE WHEN scheduled_departure IS NOT NULL THEN sequence END) OVER (PARTITION BY trip_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM trip_call) x
       JOIN (SELECT trip_id AS tid, sequence AS s, scheduled_departure AS bt FROM trip_call) y ON x.trip_id = y.tid AND x.s = y.s WHERE t < bt)""",
)(lambda f: derive.chronological(f["trip_call"], "scheduled_departure").select("trip_id", "sequence"))
query(
    "first_last_passenger",
    "trip_call",
    """SELECT trip_id, sequence, a AS first_passenger, b AS last_passenger FROM trip_call JOIN (SELECT trip_id, min(sequence) AS a, max(sequence) AS b FROM trip_call WHERE passenger_service GROUP BY trip_id) USING (trip_id)
       WHERE sequence BETWEEN a AND b""",
)(lambda f: derive.passenger_range(f["trip_call"]).select("trip_id", "sequence", "first_passenger", "last_passenger"))
query(
    "interpolate_gaps",
    "trip_call",
    """SELECT c.trip_id, c.sequence, round(CASE WHEN c.scheduled_arrival IS NOT NULL THEN c.scheduled_arrival
        ELSE a.scheduled_arrival + (b.scheduled_arrival - a.scheduled_arrival) * (c.sequence - a.sequence) / (b.sequence - a.sequence) END, 6) AS seconds
       FROM (SELECT *, max(CASE WHEN scheduled_arrival IS NOT NULL THEN sequence END) OVER (PARTITION BY trip_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sa,
              min(CASE WHEN scheduled_arrival IS NOT NULL THEN sequence END) OVER (PARTITION BY trip_id ORDER BY sequence ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sb FROM trip_call) c
       LEFT JOIN trip_call a ON a.trip_id = c.trip_id AND a.sequence = c.sa LEFT JOIN trip_call b ON b.trip_id = c.trip_id AND b.sequence = c.sb""",
)(lambda f: derive.interpolate(f["trip_call"].withColumn("x", F.col("scheduled_arrival").cast("double")), "x", "sequence", "y").select("trip_id", "sequence", F.round("y", 6).alias("seconds")))
query(
    "call_patterns",
    "trip_call",
    """SELECT trip_id, count(*) AS n_calls, sha256(string_agg(location_id || '|' || CAST(passenger_service AS VARCHAR), ';' ORDER BY sequence)) AS pattern_sha256 FROM trip_call GROUP BY trip_id""",
)(lambda f: derive.pattern_digest(f["trip_call"], "location_id", "passenger_service"))
query(
    "linked_trips",
    "route_segment",
    """SELECT trip_id, trip_id || ':' || k AS part_id, trip_id || ':' || (k + 1) AS next_part_id, CAST(4 AS INT) AS transfer_type FROM (SELECT trip_id, row_number() OVER (PARTITION BY trip_id ORDER BY from_sequence) AS k,
       count(*) OVER (PARTITION BY trip_id) AS n FROM route_segment) WHERE k < n""",
)(lambda f: derive.linked_trips(f["route_segment"]))
query(
    "departure_board",
    "trip_call trip",
    """SELECT location_id, position, trip_id, sequence, scheduled_departure FROM (SELECT c.*, CAST(row_number() OVER (PARTITION BY location_id ORDER BY scheduled_departure, trip_id, sequence) AS INT) AS position
       FROM trip_call c JOIN trip USING (trip_id) WHERE passenger_service AND scheduled_departure IS NOT NULL) WHERE position <= 20""",
)(lambda f: derive.departures(f["trip_call"], f["trip"], "location_id", 20).select("location_id", "position", "trip_id", "sequence", "scheduled_departure"))
query(
    "speed_veto",
    "trip_call location",
    f"""WITH c AS (SELECT t.trip_id, t.sequence, t.location_id AS candidate, l.longitude AS x, l.latitude AS y, coalesce(scheduled_arrival, scheduled_departure) AS s FROM trip_call t JOIN location l USING (location_id)),
        k AS (SELECT *, CASE WHEN x IS NOT NULL AND y IS NOT NULL AND s IS NOT NULL THEN {{'x': x, 'y': y, 's': s}} END AS own FROM c),
        n AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY trip_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
              first_value(own IGNORE NULLS) OVER (PARTITION BY trip_id ORDER BY sequence ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM k),
        v AS (SELECT candidate, own IS NOT NULL AND (a IS NOT NULL OR b IS NOT NULL) AS told, coalesce({_km_sql("a")} > abs(s - a.s) / 3600 * 150 + 2, false) OR coalesce({_km_sql("b")} > abs(s - b.s) / 3600 * 150 + 2, false) AS fast FROM n)
        SELECT candidate, count(*) FILTER (WHERE told) AS occurrences, coalesce(bool_and(fast) FILTER (WHERE told), false) AS vetoed FROM v GROUP BY candidate""",
)(
    lambda f: derive.speed_veto(
        f["trip_call"].select("trip_id", "sequence", "location_id", F.coalesce("scheduled_arrival", "scheduled_departure").alias("seconds")).join(f["location"].select("location_id", "longitude", "latitude"), "location_id").withColumnRenamed("location_id", "candidate"),
        "candidate",
    )
)

# reconciliation

query(
    "dedupe_first_occurrence",
    "source_object",
    """SELECT doc_id, digest FROM (SELECT doc_id, sha256(text) AS digest, row_number() OVER (PARTITION BY sha256(text) ORDER BY CASE WHEN is_change THEN 1 ELSE 0 END,
        CASE WHEN is_change THEN array_to_string(list_slice(string_split(path, '/'), 1, 2), '/') END NULLS FIRST, CASE WHEN is_change THEN CASE WHEN contains(lower(path), 'cancel') THEN 0 ELSE 1 END END NULLS FIRST, path) AS k FROM source_object) WHERE k = 1""",
)(lambda f: reconcile.first_occurrence(f["source_object"].withColumn("digest", F.sha2("text", 256)), ["digest"], reconcile.message_order(F.col("path"), F.col("is_change"))).select("doc_id", "digest"))
query("conflicting_identity", "source_object", "SELECT identity, count(DISTINCT text) AS contents FROM source_object GROUP BY identity HAVING count(DISTINCT text) > 1")(lambda f: reconcile.conflicting(f["source_object"], ["identity"], "text"))
query("unique_value_per_group", "coordinate", "SELECT code, min(lon) AS lon, min(lat) AS lat FROM coordinate GROUP BY code HAVING count(DISTINCT (lon, lat)) = 1")(lambda f: reconcile.unique_value(f["coordinate"], "code", "lon", "lat"))
query(
    "tolerance_mismatch",
    "location coordinate",
    """SELECT l.location_id, CASE WHEN a.code IS NULL THEN 'missing' ELSE 'mismatch' END AS why FROM (SELECT location_id, split_part(location_id, ':', 2) || 'BUILDING' AS code, CAST(1 AS DOUBLE) AS lon, CAST(1 AS DOUBLE) AS lat FROM location WHERE kind = 'stop_place') l
       LEFT JOIN (SELECT code, min(lon) AS lon, min(lat) AS lat FROM coordinate GROUP BY code HAVING count(DISTINCT (lon, lat)) = 1) a ON a.code = l.code WHERE a.code IS NULL OR abs(a.lon - l.lon) > 1e-6 OR abs(a.lat - l.lat) > 1e-6""",
)(
    lambda f: reconcile.beyond_tolerance(
        f["location"].filter("kind = 'stop_place'").select("location_id", F.concat(F.element_at(F.split("location_id", ":"), 2), F.lit("BUILDING")).alias("code"), F.lit(1.0).alias("lon"), F.lit(1.0).alias("lat")),
        reconcile.unique_value(f["coordinate"], "code", "lon", "lat"),
        "code",
        ["lon", "lat"],
    ).select("location_id", "why")
)


def _difference_sql(name: str, a: str, ka: str, b: str, kb: str) -> str:
    rows = f"SELECT DISTINCT CAST({ka} AS VARCHAR) AS k FROM {a} WHERE {ka} IS NOT NULL EXCEPT SELECT CAST({kb} AS VARCHAR) FROM {b}"
    return f"SELECT '{name}' AS difference, (SELECT count(*) FROM ({rows})) AS n, coalesce((SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT k FROM ({rows}) ORDER BY k LIMIT 20)), '') AS examples"


query("set_reconciliation", "trip trip_call route", " UNION ALL ".join((_difference_sql("trips without calls", "trip", "trip_id", "trip_call", "trip_id"), _difference_sql("calls without trips", "trip_call", "trip_id", "trip", "trip_id"), _difference_sql("routes of trips", "trip", "route_id", "route", "route_id"), _difference_sql("unused routes", "route", "route_id", "trip", "route_id"))))(
    lambda f: reconcile.set_differences({"trips without calls": (f["trip"].select(F.col("trip_id").alias("k0")), f["trip_call"].select(F.col("trip_id").alias("k0"))), "calls without trips": (f["trip_call"].select(F.col("trip_id").alias("k0")), f["trip"].select(F.col("trip_id").alias("k0"))), "routes of trips": (f["trip"].select(F.col("route_id").alias("k0")), f["route"].select(F.col("route_id").alias("k0"))), "unused routes": (f["route"].select(F.col("route_id").alias("k0")), f["trip"].select(F.col("route_id").alias("k0")))}, "k0")
)
query("missing_required_keys", "source_trip_coverage trip_call", "SELECT DISTINCT trip_id, to_sequence AS sequence FROM source_trip_coverage EXCEPT SELECT trip_id, sequence FROM trip_call")(
    lambda f: reconcile.missing_keys(f["source_trip_coverage"].select("trip_id", F.col("to_sequence").alias("sequence")), f["trip_call"], ["trip_id", "sequence"])
)
query("stop_hierarchy", "stop", "SELECT s.stop_id, s.parent_station, CASE WHEN p.stop_id IS NULL THEN 'no parent' ELSE 'other name' END AS why FROM stop s LEFT JOIN stop p ON p.stop_id = s.parent_station WHERE s.parent_station IS NOT NULL AND (p.stop_id IS NULL OR p.stop_name <> s.stop_name)")(
    lambda f: reconcile.hierarchy_violations(f["stop"])
)
query("coordinate_status", "stop", "SELECT stop_id, CASE WHEN NOT (lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180) THEN 'invalid' WHEN lat = 0 AND lon = 0 THEN 'zero' ELSE 'fine' END AS status FROM stop")(
    lambda f: f["stop"].select("stop_id", reconcile.coordinate_status(F.col("lon"), F.col("lat")).alias("status"))
)
query("retention_topn", "build publication", """SELECT build_id, state, n <= 3 OR p IS NOT NULL OR state = 'active' AS keep FROM (SELECT build_id, state, row_number() OVER (ORDER BY activated_at DESC NULLS FIRST, build_id DESC) AS n FROM build WHERE state IN ('active', 'retired'))
   LEFT JOIN (SELECT DISTINCT active_build_id AS p FROM publication) ON p = build_id""")(lambda f: reconcile.retained(f["build"], f["publication"]))
query("queue_pop_order", "job", "SELECT job_id, priority, created_at FROM job WHERE state = 'queued' ORDER BY priority DESC, created_at, job_id LIMIT 50")(lambda f: reconcile.queue_order(f["job"], 50).select("job_id", "priority", "created_at"))
query("job_state_fold", "job_event", "SELECT job_id, arg_max(event, event_id) AS event, count(*) AS events FROM job_event GROUP BY job_id")(lambda f: reconcile.folded_states(f["job_event"], "job_id", "event", ["event_id"]))
query("inflight_max", "span", """SELECT worker, CAST(max(n) AS BIGINT) AS most FROM (SELECT worker, sum(d) OVER (PARTITION BY worker ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS n FROM (
   SELECT worker, started AS t, 1 AS d FROM span UNION ALL SELECT worker, ended, -1 FROM span WHERE ended IS NOT NULL)) GROUP BY worker""")(lambda f: reconcile.most_in_flight(f["span"], "worker", "started", "ended"))
query("problem_examples", "source_object", """SELECT source, count(*) AS n, any_value(examples) AS examples FROM source_object JOIN (SELECT source, string_agg(path, ',' ORDER BY path) AS examples FROM (SELECT source, path, row_number() OVER (PARTITION BY source ORDER BY path) AS k
   FROM (SELECT DISTINCT source, path FROM source_object)) WHERE k <= 20 GROUP BY source) USING (source) GROUP BY source""")(lambda f: reconcile.problems(f["source_object"], ["source"], "path"))
query("prefixed_union", "agency route", "SELECT 'a/' || agency_id AS id FROM agency UNION ALL SELECT 'b/' || agency_id FROM route")(
    lambda f: reconcile.prefixed_union({"a": f["agency"].select(F.col("agency_id").alias("id")), "b": f["route"].select(F.col("agency_id").alias("id"))}, "id")
)
query(
    "listing_hrefs",
    "page",
    """SELECT page_id, len(x) AS n_links, array_to_string(x, ' ') AS links FROM (SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*"([^"]*)"', 1))) AS x FROM page)""",
)(lambda f: readers.listing_links(f["page"]).select("page_id", F.size("links").cast("long").alias("n_links"), F.array_join("links", " ").alias("links")))
query(
    "props_json_event_fold",
    "event_line",
    """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(json_extract(substr(line, 10), '$.k') AS BIGINT) END AS k FROM event_line""",
)(lambda f: readers.log_events(f["event_line"], "line", "PROGRESS ", "k long").select("event_id", F.col("event.k").alias("k")))

# overlays

query("mode_rule_range_join", "route mode_rule", """SELECT route_id, mode, coalesce(effective_mode, mode) AS effective_mode, reason FROM (SELECT r.route_id, r.mode, m.effective_mode, m.reason, row_number() OVER (PARTITION BY r.route_id ORDER BY m.route_id_from) AS k
   FROM route r LEFT JOIN mode_rule m ON m.agency_id = r.agency_id AND m.expected_mode = r.mode AND r.route_number BETWEEN m.route_id_from AND m.route_id_to AND (m.public_line_from IS NULL OR r.public_line BETWEEN m.public_line_from AND m.public_line_to)) WHERE k = 1""")(
    lambda f: overlay.mode_rules(f["route"], f["mode_rule"]).select("route_id", "mode", "effective_mode", "reason")
)
query("zone_agreement", "zone_of_location", "SELECT location_id, min(zone_id) AS zone_id FROM zone_of_location GROUP BY location_id HAVING count(DISTINCT zone_id) = 1")(lambda f: overlay.agreed_zone(f["zone_of_location"]))
query("dominant_direction", "leg", """SELECT end_a, end_b, origin, destination, days FROM (SELECT *, least(origin, destination) AS end_a, greatest(origin, destination) AS end_b, row_number() OVER (PARTITION BY least(origin, destination), greatest(origin, destination)
   ORDER BY days DESC, origin, destination) AS k FROM (SELECT origin, destination, CAST(sum(active_days) AS BIGINT) AS days FROM leg GROUP BY origin, destination)) WHERE k = 1""")(lambda f: overlay.dominant_direction(f["leg"]))
query(
    "field_overlay",
    "base_field field_claim",
    """SELECT trip_id, field, CASE WHEN used THEN v ELSE value END AS value, CASE WHEN used THEN s END AS source_id,
        CASE WHEN n > 1 AND r = 0 THEN 'blocking' WHEN n > 1 THEN 'conflict' WHEN used THEN CASE r WHEN 0 THEN 'authoritative' WHEN 1 THEN 'preferred' ELSE 'fill_missing' END ELSE 'base' END AS rule
       FROM (SELECT *, coalesce(r IS NOT NULL AND n = 1 AND (r < 2 OR value IS NULL), false) AS used FROM base_field FULL JOIN (
         SELECT trip_id, field, count(DISTINCT value) AS n, min(value) AS v, min(source_id) AS s, min(r) AS r FROM (SELECT *, rank() OVER (PARTITION BY trip_id, field ORDER BY r, priority) AS k FROM (
           SELECT *, CASE mode WHEN 'authoritative' THEN 0 WHEN 'preferred' THEN 1 ELSE 2 END AS r FROM field_claim WHERE mode <> 'disabled' AND value IS NOT NULL)) WHERE k = 1 GROUP BY trip_id, field) USING (trip_id, field))""",
)(lambda f: overlay.overlay(f["base_field"], f["field_claim"], ["trip_id"]))
query("coverage_overlap", "route_segment source_trip_coverage", """SELECT a.trip_id, a.from_sequence AS left_from, b.from_sequence AS right_from, greatest(a.from_sequence, b.from_sequence) AS from_sequence, least(a.to_sequence, b.to_sequence) AS to_sequence
   FROM route_segment a JOIN source_trip_coverage b ON a.trip_id = b.trip_id AND a.from_sequence <= b.to_sequence AND b.from_sequence <= a.to_sequence""")(lambda f: overlay.coverage_overlap(f["route_segment"], f["source_trip_coverage"]))
query("segment_overlay", "trip_call route_segment", """SELECT trip_id, sequence, coalesce(r, line_id) AS line_id FROM (SELECT c.trip_id, c.sequence, c.line_id, s.route_id AS r, row_number() OVER (PARTITION BY c.trip_id, c.sequence ORDER BY s.from_sequence, s.to_sequence) AS k
   FROM trip_call c LEFT JOIN route_segment s ON s.trip_id = c.trip_id AND c.sequence BETWEEN s.from_sequence AND s.to_sequence) WHERE k = 1""")(
    lambda f: overlay.segment_overlay(f["trip_call"].select("trip_id", "sequence", "line_id"), f["route_segment"].withColumnRenamed("route_id", "line_id"), "line_id")
)
query("exact_posts", "trip_call source_call_map_of_trips", """SELECT c.trip_id, c.sequence, coalesce(m.post, c.location_id || ':unspecified') AS boarding_point_id FROM trip_call c LEFT JOIN (SELECT trip_id, call_sequence, 'P:' || source_sequence AS post FROM source_call_map_of_trips) m
   ON m.trip_id = c.trip_id AND m.call_sequence = c.sequence""")(
    lambda f: overlay.exact_post(f["trip_call"].select("trip_id", "sequence", "location_id"), f["source_call_map_of_trips"].select("trip_id", F.col("call_sequence").alias("sequence"), F.concat(F.lit("P:"), "source_sequence").alias("post_id"))).drop("location_id")
)
query("stop_continuity", "stop", """SELECT n.stop_id, CASE WHEN n.c = 1 AND o.c = 1 THEN o.id END AS previous_id, CASE WHEN n.c > 1 OR o.c > 1 THEN 'review' WHEN o.c IS NULL THEN 'new' ELSE 'same' END AS status
   FROM (SELECT *, count(*) OVER (PARTITION BY stop_name) AS c FROM stop) n LEFT JOIN (SELECT stop_name, count(*) AS c, min(stop_id) AS id FROM stop WHERE lon > -100 GROUP BY stop_name) o USING (stop_name)""")(
    lambda f: overlay.continuity(f["stop"].filter("lon > -100"), f["stop"], ["stop_name"], "stop_id")
)
query("reachable_locations", "location trip_call", """WITH used AS (SELECT location_id AS u FROM trip_call UNION SELECT boarding_point_id FROM trip_call), direct AS (SELECT * FROM location WHERE location_id IN (SELECT u FROM used WHERE u IS NOT NULL))
   SELECT location_id FROM location WHERE location_id IN (SELECT location_id FROM direct UNION SELECT parent_location_id FROM direct WHERE parent_location_id IS NOT NULL)""")(lambda f: overlay.reachable(f["location"], f["trip_call"]).select("location_id"))
query("provisional_ids", "stop", "SELECT stop_id, 'v0:stop:' || substr(sha256(stop_name), 1, 16) AS public_id FROM stop")(lambda f: f["stop"].select("stop_id", overlay.provisional_id("stop", F.col("stop_name")).alias("public_id")))

# realtime, in batch

_FRESH = "SELECT *, date_diff('microsecond', event_time, received_time) / 1e6 <= 300 AS eligible FROM claim"


def _claims(f: Frames) -> DataFrame:
    return realtime.freshness(f["claim"], 300)


query("arbitrate_claims", "claim", f"SELECT trip_instance, capability, claim_id, value FROM (SELECT *, row_number() OVER (PARTITION BY trip_instance, capability ORDER BY priority DESC, event_time DESC, claim_id) AS k FROM ({_FRESH}) WHERE eligible) WHERE k = 1")(
    lambda f: realtime.arbitrate(_claims(f), ["trip_instance"]).select("trip_instance", "capability", "claim_id", "value")
)
query("freshness_split", "claim", f"SELECT eligible, count(*) AS n FROM ({_FRESH}) GROUP BY eligible")(lambda f: _claims(f).groupBy("eligible").agg(F.count("*").alias("n")))
query("losing_claims", "claim", f"SELECT claim_id, CASE WHEN eligible THEN 'outranked' ELSE 'stale' END AS reason FROM (SELECT *, row_number() OVER (PARTITION BY trip_instance, capability, eligible ORDER BY priority DESC, event_time DESC, claim_id) AS k FROM ({_FRESH})) WHERE NOT eligible OR k > 1")(
    lambda f: realtime.losers(_claims(f), ["trip_instance"]).select("claim_id", "reason")
)
query("delay_interval", "claim", "SELECT claim_id, CASE WHEN m > 0 THEN CAST(m * 60 AS INT) WHEN m < 0 THEN CAST(m * 60 - 59 AS INT) END AS lower, CASE WHEN m > 0 THEN CAST(m * 60 + 59 AS INT) WHEN m < 0 THEN CAST(m * 60 AS INT) END AS upper FROM (SELECT claim_id, claim_id % 7 - 3 AS m FROM claim)")(
    lambda f: f["claim"].select("claim_id", realtime.delay_bounds(F.col("claim_id") % 7 - 3).alias("d")).select("claim_id", "d.lower", "d.upper")
)
query("downsample_1h", "claim", "SELECT trip_instance, date_trunc('hour', event_time) AS window_start, count(*) AS n, arg_max(value, (event_time, claim_id)) AS last_value FROM claim GROUP BY 1, 2")(
    lambda f: realtime.downsampled(f["claim"], "trip_instance").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
)
query("dedupe_events", "claim", "SELECT trip_instance, capability, priority, min(claim_id) AS claim_id FROM claim GROUP BY trip_instance, capability, priority")(
    lambda f: realtime.deduplicated(f["claim"], ["trip_instance", "capability", "priority"], [F.col("claim_id")]).select("trip_instance", "capability", "priority", "claim_id")
)
query(
    "as_of_schedule",
    "observation source_trip_map",
    """SELECT o.event_id, max(m.valid_from) AS last_start FROM observation o LEFT JOIN source_trip_map m ON m.source_trip_id = o.source_trip_id AND m.valid_from <= o.service_date GROUP BY o.event_id""",
)(
    lambda f: realtime.as_of(
        f["observation"].select("event_id", "source_trip_id", F.col("service_date").alias("at")), f["source_trip_map"].select("source_trip_id", F.col("valid_from").alias("at"), F.col("valid_from").alias("last_start")), "source_trip_id", "at", "last_start"
    ).select("event_id", "last_start")
)
query("bounding_box", "location", "SELECT location_id FROM location WHERE longitude BETWEEN 10 AND 30.5 AND latitude BETWEEN 5 AND 45")(lambda f: realtime.boxed(f["location"], 10.0, 5.0, 30.5, 45.0).select("location_id"))


# feeds

_CLOCK = "lpad(CAST({0} // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} % 60 AS VARCHAR), 2, '0')"
query(
    "feed_stop_times",
    "trip_call",
    f"""SELECT trip_id, CAST(row_number() OVER (PARTITION BY trip_id ORDER BY sequence) AS INT) AS stop_sequence, {_CLOCK.format("coalesce(scheduled_arrival, scheduled_departure)")} AS arrival_time,
        {_CLOCK.format("coalesce(scheduled_departure, scheduled_arrival)")} AS departure_time, boarding_point_id AS stop_id, pickup_type, dropoff_type AS drop_off_type FROM trip_call WHERE passenger_service""",
)(lambda f: export.stop_times(f["trip_call"]))
query(
    "feed_calendar",
    "service_calendar",
    "SELECT service_id, "
    + ", ".join(f"CAST((CAST(weekday_mask AS INT) >> {k}) & 1 AS INT) AS {d}" for k, d in enumerate("monday tuesday wednesday thursday friday saturday sunday".split()))
    + ", strftime(valid_from, '%Y%m%d') AS start_date, strftime(valid_to, '%Y%m%d') AS end_date FROM service_calendar",
)(lambda f: export.calendar_rows(f["service_calendar"]))
query("feed_calendar_dates", "service_exception", "SELECT service_id, strftime(service_date, '%Y%m%d') AS date, CAST(CASE WHEN added THEN 1 ELSE 2 END AS INT) AS exception_type FROM service_exception")(lambda f: export.calendar_dates(f["service_exception"]))
query(
    "category_colours",
    "trip",
    "SELECT trip_id, CASE WHEN c IN ('IC', 'EC', 'RJ', 'rj', 'LE', 'SC', 'AEx') THEN 'b91c1c' WHEN c IN ('R', 'Ex', 'Rx') THEN 'b45309' WHEN c IN ('Os', 'Sp', 'TL', 'TLX', 'LET') THEN '1c1745' WHEN c IN ('NJ', 'EN', 'ES') THEN '4c1d95' ELSE '475569' END AS color FROM (SELECT trip_id, CASE direction WHEN 0 THEN 'EC' WHEN 1 THEN 'Os' ELSE headsign END AS c FROM trip)",
)(lambda f: f["trip"].select("trip_id", names.colour(F.when(F.col("direction") == 0, "EC").when(F.col("direction") == 1, "Os").otherwise(F.col("headsign"))).alias("color")))
query("normal_names", "stop", "SELECT stop_id, trim(regexp_replace(lower(stop_name), '[^a-z0-9]+', ' ', 'g')) AS normal_name, CASE WHEN length(stop_name) > 12 THEN rtrim(substr(stop_name, 1, 11)) || '.' ELSE stop_name END AS label FROM stop")(
    lambda f: f["stop"].select("stop_id", names.normal(F.col("stop_name")).alias("normal_name"), names.label(F.col("stop_name"), 12).alias("label"))
)
query(
    "regional_trip_match",
    "trip trip_call",
    """SELECT trip_id, CASE WHEN days > 0 AND a = b THEN a END AS national_trip_id, days, CASE WHEN days = 0 THEN 'unmatched' WHEN a = b THEN 'resolved' ELSE 'ambiguous' END AS status FROM (
         SELECT r.trip_id, min(n.low) AS a, max(n.high) AS b, count(n.low) AS days FROM (SELECT trip_id, sequence AS d, location_id AS p FROM trip_call WHERE passenger_service) r
         LEFT JOIN (SELECT sequence AS d, location_id AS p, min(trip_id) AS low, max(trip_id) AS high FROM trip_call WHERE line_id = 'R:1' AND pickup_type = 2 GROUP BY 1, 2) n ON n.d = r.d AND n.p = r.p GROUP BY r.trip_id)""",
)(
    lambda f: matching.regional_matches(
        f["trip_call"].filter("passenger_service").select("trip_id", F.col("sequence").alias("service_date"), F.col("location_id").alias("pattern")),
        f["trip_call"].filter("line_id = 'R:1' AND pickup_type = 2").select("trip_id", F.col("sequence").alias("service_date"), F.col("location_id").alias("pattern")),
    )
)


@query(
    "xml_calls",
    "trip_call",
    """SELECT trip_id AS path, CAST(row_number() OVER (PARTITION BY trip_id ORDER BY sequence) * 10 AS INT) AS sequence, location_id AS code, passenger_service,
       CASE WHEN passenger_service THEN t END AS scheduled_departure, CASE WHEN NOT passenger_service THEN t END AS scheduled_passage FROM (SELECT *, CAST(coalesce(scheduled_departure, scheduled_passage) * 20 AS INT) AS t FROM trip_call)""",
)
def _xml_calls(f: Frames) -> DataFrame:
    """Messages are written from the calls and read back."""
    t = F.coalesce("scheduled_departure", "scheduled_passage") * 20
    activity = F.when(F.col("passenger_service"), "<TrainActivity><TrainActivityType>0001</TrainActivityType></TrainActivity>").otherwise("")
    xml = F.concat(
        F.lit("<q:CZPTTLocation><Location><CountryCodeISO>CZ</CountryCodeISO><LocationPrimaryCode>"), "location_id", F.lit("</LocationPrimaryCode></Location><TimingAtLocation><Timing TimingQualifierCode='ALD'><Time>"),
        export.clock(t % 86400), F.lit("</Time><Offset>"), F.floor(t / 86400).cast("string"), F.lit("</Offset></Timing></TimingAtLocation>"), activity, F.lit("</q:CZPTTLocation>"),
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("sequence", xml.alias("x")))), lambda c: c["x"])
    body = f["trip_call"].groupBy(F.col("trip_id").alias("path")).agg(F.concat(F.lit('<q:M xmlns:q="urn:q"><CZPTTInformation>'), F.array_join(ordered, ""), F.lit("</CZPTTInformation></q:M>")).alias("content"))
    return readers.message_calls(readers.messages(body)).select("path", "sequence", "code", "passenger_service", "scheduled_departure", "scheduled_passage")


def _run(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: q.run(frames(spark, sf_dir, list(q.needs)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _run(q) for name, q in QUERIES.items()}


def _with(q: Query) -> str:
    head = cte(list(q.needs))
    body = q.sql.strip()
    if body.startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE" + head.rstrip()[4:] + ", " + body[15:]
    return head.rstrip() + ", " + body[5:] if body.startswith("WITH ") else head + body


def oracle_sql() -> dict[str, str]:
    return {name: _with(q) for name, q in QUERIES.items() if q.sql}
