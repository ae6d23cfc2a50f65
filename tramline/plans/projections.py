"""The contract's relations as projections of the test tables: SQL that Spark and the comparing engine both run.

Names in braces are base tables. Some rows break the contract on purpose, so that every check has work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_LINE_ORDER = "l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
_LINES = f"(SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) AS INT) AS rn FROM {{lineitem}})"
_LETTERS = "translate(substr(md5(c_name), 1, 9), '0123456789', 'ghijklmnop')"
_DAY = "CAST(DATE '1995-01-01' + CAST({0} AS INT) AS DATE)"



def _sha(key: str, text: str) -> str:
    """64 hexadecimal digits, some in the wrong case or with one missing."""
    return f"CASE WHEN {key} % 23 = 0 THEN upper(md5({text}) || md5({text})) WHEN {key} % 29 = 0 THEN substr(md5({text}) || md5({text}), 2) ELSE md5({text}) || md5({text}) END"


PROJECTIONS: dict[str, str] = {
    "agency": "SELECT 'A:' || CAST(s_suppkey AS STRING) AS agency_id, s_name AS name FROM {supplier}",
    "location": """
        SELECT 'SP:' || CAST(n_nationkey AS STRING) AS location_id, 'stop_place' AS kind, CASE WHEN n_regionkey % 2 = 0 THEN 'surface' ELSE 'heavy_rail' END AS domain,
               CAST(NULL AS STRING) AS parent_location_id, n_name AS name, CAST(n_nationkey * 1.5 AS DOUBLE) AS longitude, CAST(40 + n_nationkey * 0.25 AS DOUBLE) AS latitude,
               CAST(NULL AS SMALLINT) AS wheelchair_boarding FROM {nation}
        UNION ALL
        SELECT 'BP:' || CAST(c_custkey AS STRING), CASE WHEN c_custkey % 97 = 0 THEN 'operational_point' ELSE 'boarding_point' END, CASE WHEN c_custkey % 11 = 0 THEN 'heavy_rail' ELSE 'surface' END,
               CASE WHEN c_custkey % 101 = 0 THEN 'SP:missing' ELSE 'SP:' || CAST(c_nationkey AS STRING) END, c_name, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(c_custkey % 180 AS DOUBLE) END,
               CAST(c_custkey % 90 AS DOUBLE), CAST(c_custkey % 4 AS SMALLINT) FROM {customer}""",
    "route": """
        SELECT 'R:' || CAST(p_partkey AS STRING) AS route_id, 'A:' || CAST(p_partkey % 120 AS STRING) AS agency_id, CASE WHEN p_partkey % 3 = 0 THEN 'bus' WHEN p_partkey % 3 = 1 THEN 'tram' ELSE 'rail' END AS mode,
               CAST(p_partkey % 12 - 1 AS INT) AS gtfs_route_type, CAST(p_partkey AS INT) AS route_number, p_size AS public_line FROM {part}""",
    "service_calendar": """
        SELECT 'S:' || CAST(p_partkey AS STRING) AS service_id, CAST(DATE '1996-01-01' + p_size AS DATE) AS valid_from,
               CAST(DATE '1996-01-01' + CAST(p_size + p_partkey % 60 - CASE WHEN p_partkey % 211 = 0 THEN 100 ELSE 0 END AS INT) AS DATE) AS valid_to, CAST(p_partkey % 131 AS SMALLINT) AS weekday_mask FROM {part}""",
    "service_exception": """
        SELECT 'S:' || CAST(p_partkey AS STRING) AS service_id, CAST(DATE '1996-01-01' + CAST(p_size + p_partkey % 40 AS INT) AS DATE) AS service_date, p_partkey % 2 = 0 AS added FROM {part} WHERE p_partkey % 5 < 2""",
    "trip": """
        SELECT 'T:' || CAST(o_orderkey AS STRING) AS trip_id, 'R:' || CAST(o_orderkey % 2100 AS STRING) AS route_id, 'S:' || CAST(o_custkey % 2010 AS STRING) AS service_id,
               CAST(o_orderkey % 3 AS SMALLINT) AS direction, o_orderpriority AS headsign,
               CASE WHEN o_orderkey % 4 > 0 THEN 'H:' || CAST(o_orderkey % 1100 AS STRING) END AS shape_id FROM {orders}""",
    "trip_call": f"""
        SELECT 'T:' || CAST(l_orderkey AS STRING) AS trip_id, CAST(rn * 10 AS INT) AS sequence, 'SP:' || CAST(l_suppkey % 26 AS STRING) AS location_id, l_returnflag <> 'R' AS passenger_service,
               CASE WHEN l_returnflag <> 'R' AND l_linenumber <> 7 THEN 'BP:' || CAST(l_partkey % 1600 AS STRING) END AS boarding_point_id,
               CASE WHEN l_returnflag <> 'R' AND l_linenumber <> 3 THEN CAST(rn * 600 + l_quantity * 20 AS INT) END AS scheduled_arrival,
               CASE WHEN l_returnflag <> 'R' THEN CAST(rn * 600 + l_quantity * 20 + 60 AS INT) END AS scheduled_departure,
               CASE WHEN l_returnflag = 'R' OR l_linenumber = 5 THEN CAST(rn * 600 AS INT) END AS scheduled_passage,
               CAST(CASE WHEN l_returnflag = 'R' AND l_suppkey % 9 <> 0 THEN 1 ELSE l_linenumber % 5 END AS SMALLINT) AS pickup_type,
               CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS SMALLINT) AS dropoff_type, 'R:' || CAST(l_partkey % 4 AS STRING) AS line_id,
               CAST(l_extendedprice AS DOUBLE) AS price FROM {_LINES}""",
    "route_segment": f"""
        SELECT 'T:' || CAST(l_orderkey AS STRING) AS trip_id, CAST(rn * 10 AS INT) AS from_sequence, CAST(rn * 10 + l_suppkey % 15 AS INT) AS to_sequence, 'R:' || CAST(l_partkey AS STRING) AS route_id FROM {_LINES}""",
    "shape_point": f"""
        SELECT 'H:' || CAST(l_orderkey % 1000 AS STRING) AS shape_id, CAST(l_orderkey * 20 + rn AS INT) AS sequence, CAST(l_partkey % 180 AS DOUBLE) + 0.125 AS longitude, CAST(l_suppkey % 90 AS DOUBLE) - 0.5 AS latitude,
               CAST(rn * 100 + l_quantity AS DOUBLE) AS distance_traveled FROM {_LINES}""",
    "source_trip_map": """
        SELECT 'src' AS source_id, 'ns' AS trip_namespace, CAST(o_custkey AS STRING) AS source_trip_id, 'T:' || CAST(o_orderkey AS STRING) AS trip_id, CAST(o_orderdate AS DATE) AS valid_from,
               CAST(CAST(o_orderdate AS DATE) + 180 AS DATE) AS valid_to, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 3 AS INT) END AS scheduled_start,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS source_route_id FROM {orders}""",
    "source_call_map": f"""
        SELECT 'src' AS source_id, 'ns' AS trip_namespace, CAST(l_orderkey % 1500 AS STRING) AS source_trip_id, 'calls' AS call_namespace, CAST(rn AS STRING) AS source_sequence,
               'T:' || CAST(l_orderkey AS STRING) AS trip_id, CAST(rn * 10 AS INT) AS call_sequence FROM {_LINES}""",
    "source_call_map_of_trips": """
        SELECT m.source_id, m.trip_namespace, m.source_trip_id, 'calls' AS call_namespace, CAST(k.n AS STRING) AS source_sequence, m.trip_id, CAST(k.n * 10 AS INT) AS call_sequence
        FROM (SELECT 'src' AS source_id, 'ns' AS trip_namespace, CAST(o_custkey AS STRING) AS source_trip_id, 'T:' || CAST(o_orderkey AS STRING) AS trip_id, o_orderkey FROM {orders}) m
        JOIN (SELECT CAST(n_nationkey AS INT) AS n FROM {nation} WHERE n_nationkey BETWEEN 1 AND 3) k ON k.n <= 1 + m.o_orderkey % 3""",
    "source_trip_coverage": """
        SELECT 'src' AS source_id, 'C:' || CAST(o_orderkey AS STRING) AS coverage_id, 'T:' || CAST(o_orderkey AS STRING) AS trip_id, CAST(10 AS INT) AS from_sequence, 'ns' AS trip_namespace,
               CAST(CASE WHEN o_orderkey % 10 = 0 THEN o_custkey + 1 ELSE o_custkey END AS STRING) AS source_trip_id, CAST(10 * (1 + o_orderkey % 4) AS INT) AS to_sequence FROM {orders}""",
    "source_entity_map": """
        SELECT 'src' AS source_id, 'stops' AS identifier_namespace, 'stop_place' AS entity_kind, CAST(c_custkey % 900 AS STRING) AS source_object_id, 'SP:' || CAST(c_nationkey AS STRING) AS public_id FROM {customer}""",
    "identifier_alias": """
        SELECT 'src' AS source_id, 'lines' AS namespace, CAST(c_custkey % 1000 AS STRING) AS observed_id, CAST(DATE '1995-01-01' + CAST(c_custkey % 700 AS INT) AS DATE) AS valid_from,
               CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(DATE '1995-01-01' + CAST(c_custkey % 700 + 400 AS INT) AS DATE) END AS valid_to, 'L' || CAST(c_custkey % 50 AS STRING) AS canonical_value FROM {customer}""",
    "road_trip_key": """
        SELECT lpad(CAST(o_custkey % 400 AS STRING), 6, '0') AS cis_line_id, CAST(o_orderkey % 40 AS BIGINT) AS cis_trip_id, 'T:' || CAST(o_orderkey AS STRING) AS trip_id, CAST(o_orderdate AS DATE) AS valid_from,
               CAST(CAST(o_orderdate AS DATE) + 365 AS DATE) AS valid_to FROM {orders}""",
    "rail_trip_key": """
        SELECT CAST(o_custkey % 3000 AS INT) AS train_number, 'T:' || CAST(o_orderkey AS STRING) AS trip_id, CAST(o_orderdate AS DATE) AS valid_from, CAST(CAST(o_orderdate AS DATE) + 90 AS DATE) AS valid_to FROM {orders}""",
    "observation": f"""
        SELECT event_id, 'src' AS source_id, CASE WHEN event_id % 50 = 0 THEN 'other' ELSE 'ns' END AS trip_namespace, CAST(user_id AS STRING) AS source_trip_id, {_DAY.format("event_id * 37 % 2400")} AS service_date,
               CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 3 AS INT) END AS scheduled_start, CASE WHEN event_id % 3 = 0 THEN 'O' END AS source_route_id,
               'lines' AS namespace, CAST(user_id AS STRING) AS observed_id, 'stops' AS identifier_namespace, 'stop_place' AS entity_kind, CAST(user_id * 7 % 1000 AS STRING) AS source_object_id,
               'calls' AS call_namespace, CAST(1 + event_id % 4 AS STRING) AS source_sequence, lpad(CAST(user_id % 400 AS STRING), 6, '0') AS cis_line_id, CAST(event_id % 40 AS BIGINT) AS cis_trip_id,
               CAST(user_id % 3000 AS INT) AS train_number FROM {{events}}""",
    "claim": """
        SELECT event_id AS claim_id, user_id AS trip_instance, event_type AS capability, CAST(event_id % 3 AS INT) AS priority, CAST(ts AS TIMESTAMP) AS event_time, value,
               CAST(ts AS TIMESTAMP) + CASE WHEN event_id % 7 = 0 THEN INTERVAL '20' MINUTE ELSE INTERVAL '1' MINUTE END AS received_time FROM {events}""",
    "service_note": """
        SELECT 'N:' || CAST(p_partkey AS STRING) AS note_id, CASE WHEN p_partkey % 4 = 0 THEN 'other' ELSE 'service_note' END AS kind, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_name END AS label,
               CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type END AS text,
               CAST(DATE '1996-01-01' + p_size AS DATE) AS valid_from, CASE WHEN p_partkey % 3 > 0 THEN CAST(DATE '1996-01-20' + CAST(p_partkey % 40 AS INT) AS DATE) END AS valid_to, {sha} AS source_snapshot_sha256 FROM {part}""".replace(
        "{sha}", _sha("p_partkey", "p_name")
    ),
    "service_feature_assignment": f"""
        SELECT 'F:' || CAST(l_orderkey AS STRING) || ':' || CAST(rn AS STRING) AS feature_id, CASE WHEN rn % 3 = 0 THEN 'route' WHEN rn % 3 = 1 THEN 'trip' ELSE 'call' END AS scope,
               CASE WHEN rn % 3 = 0 THEN 'R:' || CAST(l_partkey + 5 AS STRING) END AS route_id, CASE WHEN rn % 3 > 0 THEN 'T:' || CAST(l_orderkey + l_suppkey % 2 * 100000000 AS STRING) END AS trip_id,
               CASE WHEN rn % 3 = 2 THEN CAST(rn * 10 + CASE WHEN l_suppkey % 5 = 4 THEN 1 ELSE 0 END AS INT) END AS call_sequence, CASE WHEN l_linenumber = 1 THEN 'N:' || CAST(l_partkey * 2 AS STRING) END AS note_id,
               CASE WHEN l_suppkey % 9 = 0 THEN 'unknown' WHEN l_suppkey % 2 = 0 THEN 'bicycle_transport' ELSE 'request_stop' END AS kind, {_sha("l_partkey", "l_returnflag")} AS source_snapshot_sha256 FROM {_LINES}""",
    "location_feature": """
        SELECT 'LF:' || CAST(s_suppkey AS STRING) AS feature_id, 'SP:' || CAST(s_nationkey + s_suppkey % 2 AS STRING) AS location_id, CASE WHEN s_suppkey % 2 = 0 THEN 'toilet' ELSE 'pool' END AS kind,
               {sha} AS source_snapshot_sha256 FROM {supplier}""".replace("{sha}", _sha("s_suppkey", "s_name")),
    "connection_claim": """
        SELECT 'X:' || CAST(o_orderkey AS STRING) AS connection_id, CASE WHEN o_orderkey % 3 = 0 THEN 'resolved' WHEN o_orderkey % 3 = 1 THEN 'pattern' ELSE 'unresolved' END AS resolution_status,
               CASE WHEN o_orderkey % 4 = 0 THEN 'none' ELSE 'structured' END AS target_derivation, CASE WHEN o_orderkey % 8 = 0 THEN o_orderpriority END AS target_public_line,
               CASE WHEN o_orderkey % 12 = 0 THEN o_orderstatus END AS target_destination_text, CAST(NULL AS STRING) AS target_source_route_id, CAST(NULL AS STRING) AS target_source_trip_id,
               CAST(NULL AS STRING) AS target_source_stop_id, CAST(NULL AS STRING) AS target_source_post_id, CAST(NULL AS STRING) AS target_source_end_stop_id, CAST(NULL AS STRING) AS target_source_end_post_id,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'R:' || CAST(o_orderkey % 2500 AS STRING) END AS target_route_id,
               CASE WHEN o_orderkey % 7 < 3 THEN 'T:' || CAST(o_orderkey + 50 AS STRING) END AS target_trip_id, CASE WHEN o_orderkey % 9 = 0 THEN 'SP:' || CAST(o_orderkey % 30 AS STRING) END AS target_location_id,
               CASE WHEN o_orderkey % 17 = 0 THEN 'waits' WHEN o_orderkey % 2 = 0 THEN 'waits_for' ELSE 'connects_to' END AS direction, 'T:' || CAST(o_orderkey AS STRING) AS origin_trip_id,
               CAST(10 * (1 + o_orderkey % 5) AS INT) AS origin_sequence, CASE WHEN o_orderkey % 6 > 0 THEN CAST(o_orderkey % 20 - 2 AS INT) END AS wait_minutes, {sha} AS source_snapshot_sha256 FROM {orders}""".replace("{sha}", _sha("o_orderkey", "o_orderstatus")),
    "travel_restriction_assignment": f"""
        SELECT 'V:' || CAST(l_orderkey AS STRING) || ':' || CAST(rn AS STRING) AS assignment_id, CASE WHEN rn % 2 = 0 THEN 'route_stop' ELSE 'trip_call' END AS scope, CASE WHEN rn % 2 = 0 THEN 'R:' || CAST(l_partkey + 3 AS STRING) END AS route_id,
               CASE WHEN rn % 2 = 1 THEN 'T:' || CAST(l_orderkey AS STRING) END AS trip_id, CASE WHEN rn % 2 = 1 AND l_suppkey % 6 > 0 THEN CAST(rn * 10 + l_suppkey % 6 - 1 AS INT) END AS call_sequence,
               CASE WHEN l_suppkey % 10 = 0 THEN 'D' ELSE 'A' END AS group_code, {_sha("l_suppkey", "l_linestatus")} AS source_snapshot_sha256 FROM {_LINES}""",
    "source_object": """
        SELECT doc_id, source, text, source || '/' || CAST(doc_id % 100 AS STRING) || CASE WHEN doc_id % 4 = 0 THEN '/cancel' ELSE '/change' END || CAST(doc_id AS STRING) AS path, doc_id % 3 = 0 AS is_change,
               CAST(doc_id % 300 AS STRING) AS identity FROM {documents}""",
    "turn": "SELECT CAST(conv_id AS STRING) AS trip_id, CAST(turn AS INT) AS sequence, role, length(text) AS size FROM {conversations}",
    "zone_of_location": """
        SELECT 'SP:' || CAST(c_nationkey AS STRING) || ':' || c_mktsegment || ':' || CAST(c_custkey % 20 AS STRING) AS location_id, 'Z' || CAST(c_custkey % 20 + CASE WHEN c_custkey % 30 = 0 THEN 1 ELSE 0 END AS STRING) AS zone_id FROM {customer}""",
    "leg": "SELECT CAST(o_custkey % 40 AS INT) AS origin, CAST(o_orderkey % 40 AS INT) AS destination, CAST(o_orderkey % 9 AS INT) AS active_days FROM {orders}",
    "mode_rule": """
        SELECT 'A:' || CAST(s_suppkey AS STRING) AS agency_id, CAST(s_suppkey * 10 AS INT) AS route_id_from, CAST(s_suppkey * 10 + 900 AS INT) AS route_id_to, CASE WHEN s_suppkey % 2 = 0 THEN CAST(10 AS INT) END AS public_line_from,
               CASE WHEN s_suppkey % 2 = 0 THEN CAST(40 AS INT) END AS public_line_to, CASE WHEN s_suppkey % 3 = 0 THEN 'bus' ELSE 'tram' END AS expected_mode, 'trolleybus' AS effective_mode, s_name AS reason FROM {supplier}""",
    "base_field": "SELECT 'T:' || CAST(o_orderkey AS STRING) AS trip_id, 'status' AS field, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS value FROM {orders}",
    "field_claim": """
        SELECT 'T:' || CAST(l_orderkey AS STRING) AS trip_id, 'status' AS field, l_returnflag AS value, 'src' || CAST(l_suppkey % 4 AS STRING) AS source_id,
               CASE WHEN l_linenumber = 1 THEN 'authoritative' WHEN l_linenumber = 2 THEN 'preferred' WHEN l_linenumber < 5 THEN 'fill_missing' ELSE 'disabled' END AS mode, CAST(l_suppkey % 3 AS INT) AS priority FROM {lineitem}""",
    "build": "SELECT CAST(o_orderkey AS BIGINT) AS build_id, CASE WHEN o_orderkey % 5 = 0 THEN 'failed' WHEN o_orderkey % 97 = 0 THEN 'active' ELSE 'retired' END AS state, CASE WHEN o_orderkey % 500 = 1 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS activated_at FROM {orders}",
    "publication": "SELECT CAST(n_nationkey * 7 AS BIGINT) AS active_build_id FROM {nation}",
    "job": "SELECT CAST(o_orderkey AS BIGINT) AS job_id, CASE WHEN o_orderstatus = 'O' THEN 'queued' ELSE 'running' END AS state, CAST(o_custkey % 10 AS INT) AS priority, CAST(o_orderdate AS DATE) AS created_at FROM {orders}",
    "job_event": "SELECT event_id, user_id AS job_id, event_type AS event, ts FROM {events}",
    "span": "SELECT CAST(user_id AS BIGINT) AS worker, CAST(event_id AS BIGINT) AS started, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id + 50 + floor(value) AS BIGINT) END AS ended FROM {events}",
    "stop": "SELECT 'st' || CAST(c_custkey AS STRING) AS stop_id, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS stop_name, CASE WHEN c_custkey % 4 > 0 THEN 'st' || CAST(c_custkey * 3 AS STRING) END AS parent_station, c_acctbal AS lat, CAST(c_custkey % 400 - 200 AS DOUBLE) AS lon FROM {customer}",
    "coordinate": "SELECT CAST(c_nationkey AS STRING) || c_mktsegment AS code, CAST(c_custkey % 2 AS DOUBLE) AS lon, CAST(c_custkey % 3 AS DOUBLE) AS lat FROM {customer} WHERE c_custkey % 40 < 2",
    "page": "SELECT page_id, url, html FROM {pages}",
    "shape": "SELECT DISTINCT 'H:' || CAST(o_orderkey % 900 AS STRING) AS shape_id FROM {orders}",
    "transfer": "SELECT 'X:' || CAST(o_orderkey AS STRING) AS transfer_key, 'SP:' || CAST(o_custkey % 27 AS STRING) AS from_location_id, 'SP:' || CAST(o_orderkey % 26 AS STRING) AS to_location_id FROM {orders}",
    "fare_system": "SELECT 'FS:' || CAST(r_regionkey AS STRING) AS fare_system_id, r_name AS name FROM {region}",
    "fare_zone": "SELECT 'FS:' || CAST(n_regionkey + CASE WHEN n_nationkey % 7 = 0 THEN 10 ELSE 0 END AS STRING) AS fare_system_id, 'Z' || CAST(n_nationkey AS STRING) AS zone_id FROM {nation}",
    "location_zone": """
        SELECT 'BP:' || CAST(c_custkey * 2 AS STRING) AS location_id, 'FS:' || CAST(c_custkey % 5 AS STRING) AS fare_system_id, CASE WHEN c_custkey % 8 > 0 THEN 'Z' || CAST(c_nationkey AS STRING) END AS zone_id FROM {customer}""",
    "call_zone": f"""
        SELECT 'T:' || CAST(l_orderkey AS STRING) AS trip_id, CAST(rn * 10 + CASE WHEN l_suppkey % 7 = 0 THEN 1 ELSE 0 END AS INT) AS sequence, 'FS:' || CAST(l_partkey % 5 AS STRING) AS fare_system_id,
               'Z' || CAST(l_partkey % 25 AS STRING) AS zone_id, CAST(l_suppkey % 12 - 1 AS INT) AS source_order FROM {_LINES}""",
    "service_note_assignment": """
        SELECT 'A:' || CAST(o_orderkey AS STRING) AS assignment_id, 'N:' || CAST(o_custkey AS STRING) AS note_id, CASE WHEN o_orderkey % 13 = 0 THEN 'call' WHEN o_orderkey % 2 = 0 THEN 'route' ELSE 'trip' END AS scope,
               CASE WHEN o_orderkey % 2 = 0 THEN 'R:' || CAST(o_custkey * 3 AS STRING) END AS route_id, CASE WHEN o_orderkey % 2 = 1 OR o_orderkey % 10 = 0 THEN 'T:' || CAST(o_orderkey AS STRING) END AS trip_id FROM {orders}""",
    "operational_location": "SELECT 'src' AS source_id, 'OL:' || CAST(n_nationkey AS STRING) AS source_location_id, n_name AS name FROM {nation}",
    "operational_journey": "SELECT 'src' AS source_id, 'OJ:' || CAST(o_orderkey AS STRING) AS source_journey_id FROM {orders} WHERE o_orderkey % 6 > 0",
    "operational_call": f"""
        SELECT 'src' AS source_id, 'OJ:' || CAST(l_orderkey AS STRING) AS source_journey_id, CAST(rn * 10 AS INT) AS sequence, 'OL:' || CAST(l_suppkey % 27 AS STRING) AS source_location_id,
               CASE WHEN l_linenumber = 1 THEN CAST(rn AS INT) END AS scheduled_arrival, CASE WHEN l_linenumber % 2 = 0 THEN CAST(rn AS INT) END AS scheduled_departure, CASE WHEN l_returnflag = 'R' THEN CAST(rn AS INT) END AS scheduled_passage FROM {_LINES}""",
    "road_route_key": """
        SELECT CASE WHEN p_partkey % 19 = 0 THEN CAST(p_partkey AS STRING) WHEN p_partkey % 31 = 0 THEN lpad(CAST(p_partkey AS STRING), 6, 'x') ELSE lpad(CAST(p_partkey AS STRING), 6, '0') END AS cis_line_id, 'R:' || CAST(p_partkey + p_size AS STRING) AS route_id,
               CAST(DATE '1996-01-01' + p_size AS DATE) AS valid_from, CAST(DATE '1996-01-10' + CAST(p_partkey % 60 AS INT) AS DATE) AS valid_to FROM {part}""",
    "redirect": "SELECT CAST(o_orderkey AS BIGINT) AS old_id, CASE WHEN o_orderkey % 61 = 0 THEN NULL ELSE CAST(o_orderkey + 1 + o_orderkey % 3 AS BIGINT) END AS new_id FROM {orders} WHERE o_orderkey % 41 > 0 UNION ALL SELECT CAST(-n_nationkey AS BIGINT), CAST(-((n_nationkey + 1) % 25) AS BIGINT) FROM {nation}",
    "message_day": """
        SELECT 'J:' || CAST(l_orderkey % 700 AS STRING) AS trip, CAST(DATE '1996-01-01' + CAST(l_partkey % 5 AS INT) AS DATE) AS service_date, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS ord, l_linenumber % 3 = 0 AS cancels,
               'm' || CAST(l_orderkey AS STRING) || ':' || CAST(l_linenumber AS STRING) AS path FROM {lineitem}""",
    "snapshot": "SELECT 'src' || CAST(o_custkey % 50 AS STRING) AS source_id, 'v' || CAST(o_orderkey AS STRING) AS snapshot, CAST(o_orderdate AS TIMESTAMP) AS retrieved_at, o_orderstatus <> 'P' AS usable FROM {orders}",
    "vehicle_attribute": """
        SELECT CAST(p_partkey % 300 AS STRING) AS number, p_type AS attribute, CAST(p_partkey % 3 AS INT) AS priority, 'src' || CAST(p_partkey AS STRING) AS source_id, CAST(DATE '1995-01-01' + p_size AS DATE) AS valid_from,
               CASE WHEN p_partkey % 4 > 0 THEN CAST(DATE '1996-01-01' + CAST(p_partkey % 400 AS INT) AS DATE) END AS valid_to FROM {part}""",
    "journey": "SELECT o_orderkey AS journey_id, CAST(o_custkey % 320 AS STRING) AS number, CAST(o_orderdate AS DATE) AS service_date FROM {orders}",
    "composition": "SELECT CAST(p_partkey % 90 AS INT) AS train_number, CAST(DATE '1994-01-01' + CAST(p_partkey % 900 AS INT) AS DATE) AS valid_from, CAST(DATE '1995-06-01' + CAST(p_partkey % 900 AS INT) AS DATE) AS valid_to, CAST(p_size % 4 AS INT) AS priority, CAST(p_partkey % 7 AS INT) AS position, p_brand AS vehicle_type FROM {part}",
    "alert": """
        SELECT doc_id AS alert_id, CASE WHEN doc_id % 3 = 0 THEN '  ' || text || '!! ' ELSE text END AS text, CAST(doc_id % 2 AS BIGINT) AS period_start, CAST(doc_id % 4 AS BIGINT) AS period_end, source AS scope
        FROM {documents}""",
    "platform_claim": """
        SELECT event_id, CASE WHEN event_id % 7 = 0 THEN CAST(event_id % 4 AS STRING) END AS infrastructure, CASE WHEN event_id % 5 = 0 THEN event_type END AS operator, CASE WHEN event_id % 3 = 0 THEN 'p' || CAST(user_id AS STRING) END AS previous,
               CASE WHEN event_id % 2 = 0 THEN 's' END AS scheduled FROM {events}""",
    "bitmap": "SELECT 'B:' || CAST(p_partkey AS STRING) AS id, CAST(DATE '1996-01-01' + p_size AS DATE) AS start, translate(md5(p_name), '0123456789abcdef', '0101101001011010') AS bits FROM {part}",
    "extension": "SELECT 'R:' || CAST(c_custkey AS STRING) AS route_id, 'T:' || CAST(c_custkey * 2 AS STRING) AS trip_id, CAST(10 * (1 + c_custkey % 4) AS INT) AS stop_sequence FROM {customer}",
    "offset_call": f"""
        SELECT 'T:' || CAST(l_orderkey AS STRING) AS trip_id, CAST(rn AS INT) AS sequence, CASE WHEN l_suppkey % 40 > 0 THEN CAST(rn * 50 + l_quantity AS DOUBLE) END AS "offset", CAST(400.0 AS DOUBLE) AS length FROM {_LINES}""".replace('"offset"', "off_km"),
    "abroad_call": f"""
        SELECT 'T:' || CAST(l_orderkey AS STRING) AS trip_id, CAST(rn AS INT) AS sequence, CASE WHEN l_orderkey % 4 = 0 THEN 'CZ' WHEN l_suppkey % 3 = 0 THEN 'CZ' WHEN l_suppkey % 41 = 0 THEN 'FR' WHEN l_suppkey % 3 = 1 THEN 'DE' ELSE 'PL' END AS country,
               CAST(rn * 22 AS DOUBLE) AS distance_km, l_orderkey % 3 = 0 AS integrated FROM {_LINES}""",
    "matched_point": "SELECT 'SP:' || CAST(n_nationkey AS STRING) AS point_id, CAST(n_nationkey * 1.5 AS DOUBLE) AS longitude, CAST(40 + n_nationkey * 0.25 AS DOUBLE) AS latitude FROM {nation} WHERE n_nationkey % 3 > 0",
    "word_name": "SELECT CAST(p_partkey AS INT) AS id, p_name || ' ' || CAST(p_partkey * 7 % 900 AS STRING) AS name FROM {part}",
    # places whose names are nine letters; objects have the same, one with another letter, or other names
    "place": f"""
        SELECT 'P' || CAST(c_custkey AS STRING) AS point_id, CASE WHEN c_custkey % 3 = 0 THEN 'CZ' ELSE 'DE' END AS country, lpad(CAST(c_custkey AS STRING), 6, '0') AS code, {_LETTERS} AS name FROM {{customer}}""",
    "place_authority": "SELECT lpad(CAST(c_custkey AS STRING), 6, '0') AS code, CAST(c_custkey % 30 AS DOUBLE) / 10 AS longitude, CAST(50 + c_custkey % 20 * 0.1 AS DOUBLE) AS latitude FROM {customer} WHERE c_custkey % 6 = 0",
    "place_object": f"""
        SELECT 'O' || CAST(c_custkey AS STRING) AS object_id, CASE WHEN c_custkey % 5 = 0 THEN 'DE' || lpad(CAST(c_custkey AS STRING), 6, '0') END AS reference,
               CASE WHEN c_custkey % 7 < 3 THEN {_LETTERS} WHEN c_custkey % 7 < 5 THEN 'z' || substr({_LETTERS}, 2) ELSE 'other ' || {_LETTERS} END AS name,
               CAST((c_custkey + c_custkey % 4) % 30 AS DOUBLE) / 10 AS longitude, CAST(50 + c_custkey % 20 * 0.1 AS DOUBLE) AS latitude FROM {{customer}}""",
    "place_alias": "SELECT 'P' || CAST(c_custkey AS STRING) AS point_id, 'O' || CAST(c_custkey + 1 AS STRING) AS object_id FROM {customer} WHERE c_custkey % 29 = 0",
    "place_call": f"""
        SELECT 'T' || CAST(l_orderkey AS STRING) AS trip_id, CAST(rn * 10 AS INT) AS sequence, 'P' || CAST(o_custkey % 500 + l_partkey % 40 AS STRING) AS point_id,
               CASE WHEN l_suppkey % 9 > 0 THEN CAST(rn * 2400 AS INT) END AS seconds, CAST(1 + l_orderkey % 5 AS INT) AS days FROM {_LINES} JOIN {{orders}} ON o_orderkey = l_orderkey""",
    "text_line": "SELECT doc_id, source, text FROM {documents}",
    "position": "SELECT CAST(user_id AS STRING) AS vehicle, CAST(event_id AS DOUBLE) AS seconds, CAST(event_id * 3 AS DOUBLE) AS distance FROM {events}",
    "mark": "SELECT CAST(user_id AS STRING) AS vehicle, CAST(event_id AS STRING) AS stop_id, CAST(event_id * 3 + 40 AS DOUBLE) AS at FROM {events} WHERE event_id % 17 = 0",
    "node": "SELECT c_custkey AS id, c_mktsegment AS segment, CAST(c_custkey % 3 AS INT) AS version, CASE WHEN c_custkey % 4 = 0 THEN 'station' WHEN c_custkey % 4 = 1 THEN 'tram_stop' WHEN c_custkey % 4 = 2 THEN 'bus_stop' ELSE 'bench' END AS tag FROM {customer}",
    "event_line": "SELECT event_id, 'PROGRESS ' || CASE WHEN event_id % 9 = 0 THEN substr(props, 2) ELSE props END AS line FROM {events}",
}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def frames(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    out = {}
    for name in names:
        sql = PROJECTIONS[name]
        used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
        out[name] = spark.sql(sql, **used)
    return out


def cte(names: list[str]) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({PROJECTIONS[n].format(**{t: t for t in TABLES})})" for n in names) + "\n"
