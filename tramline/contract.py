"""The serving contract: 33 relations, their types, keys, references and domains, in one declarative registry.

A relation is written as its columns in order; ``*`` marks a nullable one, and the types follow
from the names (see _TYPES). All checks are generated from this registry.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Version of the contract.
SCHEMA_VERSION = 1

# Fixed types: every other column is text.
_TYPES: dict[str, T.DataType] = {
    **dict.fromkeys("longitude latitude distance_traveled shape_distance_traveled".split(), T.DoubleType()),
    **dict.fromkeys("weekday_mask pickup_type dropoff_type wheelchair_boarding wheelchair_accessible bikes_allowed transfer_type".split(), T.ShortType()),
    **dict.fromkeys(
        "gtfs_route_type sort_order sequence from_sequence to_sequence call_sequence origin_sequence scheduled_arrival scheduled_departure scheduled_passage scheduled_start scheduled_end"
        " minimum_transfer_time source_order wait_minutes train_number".split(),
        T.IntegerType(),
    ),
    "cis_trip_id": T.LongType(),
    **dict.fromkeys("added passenger_service timepoint".split(), T.BooleanType()),
    **dict.fromkeys("valid_from valid_to service_date".split(), T.DateType()),
}
#: The same name with another type.
_TYPES_BY_RELATION: dict[tuple[str, str], T.DataType] = {("trip", "direction"): T.ShortType()}

_PROVENANCE = "source_id source_snapshot_sha256 source_object_id"

# Fixed columns. The words before the bar are the sort key: the primary key after the build's number.
_RELATIONS = f"""
agency: agency_id | name url* timezone language* phone* fare_url* email*
location: location_id | kind domain parent_location_id* name public_code* description* municipality_name* district_name* district_code* nearby_place* country_code* coordinate_precision* longitude* latitude* url* timezone* wheelchair_boarding*
route: route_id | agency_id mode gtfs_route_type short_name* long_name* description* url* color* text_color* sort_order*
service_calendar: service_id | valid_from valid_to weekday_mask
service_exception: service_id service_date | added
shape: shape_id | generation_method
shape_point: shape_id sequence | longitude latitude distance_traveled*
trip: trip_id | route_id service_id direction* headsign* short_name* block_key* wheelchair_accessible* bikes_allowed* shape_id*
trip_call: trip_id sequence | location_id passenger_service boarding_point_id* scheduled_arrival* scheduled_departure* scheduled_passage* pickup_type dropoff_type timepoint stop_headsign* shape_distance_traveled*
route_segment: trip_id from_sequence | to_sequence route_id
transfer: transfer_key | from_location_id to_location_id from_route_id* to_route_id* from_trip_id* to_trip_id* transfer_type minimum_transfer_time*
fare_system: fare_system_id | name
fare_zone: fare_system_id zone_id | name*
location_zone: location_id fare_system_id zone_id |
call_zone: trip_id sequence fare_system_id zone_id | source_order
service_note: note_id | kind label* text* valid_from* valid_to* service_note_type* {_PROVENANCE}
service_note_assignment: assignment_id | note_id scope route_id* trip_id*
service_feature_assignment: feature_id | scope kind route_id* trip_id* call_sequence* source_code note_id* {_PROVENANCE}
location_feature: feature_id | location_id kind source_code {_PROVENANCE}
connection_claim: connection_id | direction origin_trip_id origin_sequence target_source_route_id* target_source_trip_id* target_source_stop_id* target_source_post_id* target_source_end_stop_id* target_source_end_post_id* wait_minutes* note* target_public_line* target_destination_text* target_derivation resolution_status target_route_id* target_trip_id* target_location_id* {_PROVENANCE}
travel_restriction_assignment: assignment_id | scope route_id* trip_id* source_route_stop_id call_sequence* group_code {_PROVENANCE}
operational_location: source_id source_location_id | source_snapshot_sha256 country_code primary_code name longitude* latitude* coordinate_source* coordinate_source_object_id* coordinate_match_method*
operational_journey: source_id source_journey_id | source_snapshot_sha256 domain mode
operational_call: source_id source_journey_id sequence | source_location_id passenger_service scheduled_arrival* scheduled_departure* scheduled_passage* subsidiary_code* subsidiary_name* active_line_code*
source_entity_map: source_id identifier_namespace entity_kind source_object_id | public_id
source_trip_map: source_id trip_namespace source_trip_id trip_id valid_from | valid_to scheduled_start* scheduled_end* source_route_id* source_direction_id* source_start_location_id* source_end_location_id* source_block_id* source_run_id* source_duty_id* call_pattern_sha256* variant_key*
source_call_map: source_id trip_namespace source_trip_id call_namespace source_sequence trip_id call_sequence |
source_trip_coverage: source_id coverage_id trip_id from_sequence | trip_namespace source_trip_id to_sequence coverage_type system_id* coverage_role*
identifier_alias: source_id namespace observed_id valid_from | valid_to* canonical_value reason
road_route_key: cis_line_id route_id valid_from | valid_to
road_trip_key: cis_line_id cis_trip_id trip_id valid_from | valid_to
rail_trip_key: train_number trip_id valid_from | valid_to
selected_field_provenance: object_type object_key field_name | source_id source_snapshot_sha256 source_object_id selection_rule
"""

# Fixed references, child columns to parent: a null in any child column means that the row is not checked.
_REFERENCES = """
location (parent_location_id) -> location (location_id)
route (agency_id) -> agency (agency_id)
service_exception (service_id) -> service_calendar (service_id)
shape_point (shape_id) -> shape (shape_id)
trip (route_id) -> route (route_id)
trip (service_id) -> service_calendar (service_id)
trip (shape_id) -> shape (shape_id)
trip_call (trip_id) -> trip (trip_id)
trip_call (location_id) -> location (location_id)
trip_call (boarding_point_id) -> location (location_id)
route_segment (trip_id) -> trip (trip_id)
route_segment (route_id) -> route (route_id)
transfer (from_location_id) -> location (location_id)
transfer (to_location_id) -> location (location_id)
fare_zone (fare_system_id) -> fare_system (fare_system_id)
location_zone (location_id) -> location (location_id)
location_zone (fare_system_id, zone_id) -> fare_zone (fare_system_id, zone_id)
call_zone (trip_id, sequence) -> trip_call (trip_id, sequence)
call_zone (fare_system_id, zone_id) -> fare_zone (fare_system_id, zone_id)
service_note_assignment (note_id) -> service_note (note_id)
service_note_assignment (route_id) -> route (route_id)
service_note_assignment (trip_id) -> trip (trip_id)
service_feature_assignment (route_id) -> route (route_id)
service_feature_assignment (trip_id) -> trip (trip_id)
service_feature_assignment (trip_id, call_sequence) -> trip_call (trip_id, sequence)
service_feature_assignment (note_id) -> service_note (note_id)
location_feature (location_id) -> location (location_id)
connection_claim (origin_trip_id, origin_sequence) -> trip_call (trip_id, sequence)
operational_call (source_id, source_journey_id) -> operational_journey (source_id, source_journey_id)
operational_call (source_id, source_location_id) -> operational_location (source_id, source_location_id)
source_trip_map (trip_id) -> trip (trip_id)
source_call_map (trip_id, call_sequence) -> trip_call (trip_id, sequence)
source_trip_coverage (trip_id) -> trip (trip_id)
road_route_key (route_id) -> route (route_id)
road_trip_key (trip_id) -> trip (trip_id)
rail_trip_key (trip_id) -> trip (trip_id)
"""

SHA256_PATTERN = r"^[0-9a-f]{64}\z"
_SNAPSHOT = f"source_snapshot_sha256 rlike '{SHA256_PATTERN}'".replace("\\", "\\\\")

# Fixed domains: conditions that hold for every row (a null result passes, as in SQL checks).
DOMAINS: dict[str, dict[str, str]] = {
    "location": {
        "kind": "kind IN ('stop_place', 'boarding_point', 'operational_point')",
        "domain": "domain IN ('surface', 'heavy_rail')",
        "parent": "(kind = 'boarding_point') = (parent_location_id IS NOT NULL)",
        "wheelchair": "wheelchair_boarding BETWEEN 0 AND 2",
        "coordinates": "(longitude IS NULL) = (latitude IS NULL)",
    },
    "route": {"type": "gtfs_route_type >= 0"},
    "service_calendar": {"validity": "valid_to >= valid_from", "weekdays": "weekday_mask BETWEEN 0 AND 127"},
    "shape_point": {"sequence": "sequence >= 0", "distance": "distance_traveled >= 0"},
    "trip": {"direction": "direction IN (0, 1)"},
    "trip_call": {
        "sequence": "sequence > 0",
        "arrival": "scheduled_arrival >= 0",
        "departure": "scheduled_departure >= 0",
        "passage": "scheduled_passage >= 0",
        "pickup": "pickup_type BETWEEN 0 AND 3",
        "dropoff": "dropoff_type BETWEEN 0 AND 3",
    },
    "route_segment": {"start": "from_sequence > 0", "end": "to_sequence >= from_sequence"},
    "call_zone": {"order": "source_order >= 0"},
    "service_note": {
        "kind": "kind IN ('route_information', 'service_note', 'reservation')",
        "validity": "valid_to >= valid_from",
        "snapshot": _SNAPSHOT,
    },
    "service_note_assignment": {
        "scope": "scope IN ('route', 'trip')",
        "target": "(scope = 'route' AND route_id IS NOT NULL AND trip_id IS NULL) OR (scope = 'trip' AND trip_id IS NOT NULL AND route_id IS NULL)",
    },
    "service_feature_assignment": {
        "scope": "scope IN ('route', 'trip', 'call')",
        "kind": "kind IN ('reservation_available', 'reservation_required', 'wheelchair_accessible_vehicle', 'partly_wheelchair_accessible_vehicle', 'refreshments_on_vehicle', 'luggage_transport',"
        " 'bicycle_transport', 'on_request', 'conditional', 'self_service_ticketing', 'integrated_transport', 'not_stopping', 'diversion', 'request_stop', 'exit_only', 'boarding_only')",
        "target": "(scope = 'route' AND route_id IS NOT NULL AND trip_id IS NULL AND call_sequence IS NULL) OR (scope = 'trip' AND route_id IS NULL AND trip_id IS NOT NULL AND call_sequence IS NULL)"
        " OR (scope = 'call' AND route_id IS NULL AND trip_id IS NOT NULL AND call_sequence IS NOT NULL)",
        "snapshot": _SNAPSHOT,
    },
    "location_feature": {
        "kind": "kind IN ('wheelchair_accessible', 'refreshments', 'toilet', 'accessible_toilet', 'request_stop', 'urban_transport_interchange', 'border_control_only', 'visually_impaired_accessible',"
        " 'accessibility_terminal', 'rail_interchange', 'line_interchange', 'metro_interchange', 'ship_terminal', 'airport_nearby', 'park_and_ride')",
        "snapshot": _SNAPSHOT,
    },
    "connection_claim": {
        "direction": "direction IN ('waits_for', 'connects_to')",
        "resolution": "resolution_status IN ('unresolved', 'pattern', 'resolved')",
        "derivation": "target_derivation IN ('none', 'structured', 'spec_note')",
        "wait": "wait_minutes >= 0",
        "snapshot": _SNAPSHOT,
    },
    "travel_restriction_assignment": {
        "scope": "scope IN ('route_stop', 'trip_call')",
        "group": "group_code IN ('§', 'A', 'B', 'C')",
        "target": "(scope = 'route_stop' AND route_id IS NOT NULL AND trip_id IS NULL AND call_sequence IS NULL) OR (scope = 'trip_call' AND route_id IS NULL AND trip_id IS NOT NULL)",
        "snapshot": _SNAPSHOT,
    },
    "operational_call": {"times": "coalesce(scheduled_arrival, scheduled_departure, scheduled_passage) IS NOT NULL"},
    "road_route_key": {"line": "cis_line_id rlike '^[0-9]{6}\\\\z'", "validity": "valid_to >= valid_from"},
    "road_trip_key": {"line": "cis_line_id rlike '^[0-9]{6}\\\\z'", "trip": "cis_trip_id >= 0", "validity": "valid_to >= valid_from"},
    "rail_trip_key": {"number": "train_number > 0", "validity": "valid_to >= valid_from"},
    "source_trip_map": {"validity": "valid_to >= valid_from"},
    "source_trip_coverage": {"sequence": "from_sequence > 0 AND to_sequence >= from_sequence"},
    "identifier_alias": {"validity": "valid_to >= valid_from"},
}


@dataclass(frozen=True)
class Relation:
    name: str
    schema: T.StructType
    sort_key: tuple[str, ...]


@dataclass(frozen=True)
class Reference:
    child: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]

    @property
    def name(self) -> str:
        return f"{self.child}({','.join(self.columns)})"


def _type(relation: str, column: str) -> T.DataType:
    return _TYPES_BY_RELATION.get((relation, column)) or _TYPES.get(column, T.StringType())


def _relation(line: str) -> Relation:
    name, _, columns = line.partition(":")
    key, _, rest = columns.partition("|")
    fields = [T.StructField(c.rstrip("*"), _type(name, c.rstrip("*")), c.endswith("*")) for c in (*key.split(), *rest.split())]
    return Relation(name, T.StructType(fields), tuple(key.split()))


def _reference(line: str) -> Reference:
    child, parent = (side.strip(" )").split(" (") for side in line.split("->"))
    return Reference(child[0], tuple(child[1].split(", ")), parent[0], tuple(parent[1].split(", ")))


#: In load order: a parent comes before its children.
RELATIONS: dict[str, Relation] = {r.name: r for r in map(_relation, _RELATIONS.strip().splitlines())}
REFERENCES: tuple[Reference, ...] = tuple(map(_reference, _REFERENCES.strip().splitlines()))
