"""Set-wise checks of a build's relations: each is a DataFrame of violating rows, counted in one result.

Relations come as a mapping from name to DataFrame. All checks group or join on trip, route or location
keys, never on a source's id alone, which a few values share.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..contract import DOMAINS, REFERENCES, RELATIONS, Reference

Relations = Mapping[str, DataFrame]


def _key(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under new names, each combination once, and a mark that a left join found one."""
    return df.select(*[F.col(old).alias(new) for new, old in columns.items()]).dropna().distinct().withColumn(f"_has_{next(iter(columns))}", F.lit(True))


def _found(rows: DataFrame, keys: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """rows left joined with keys, by pairs of a column of rows and one of keys. Rows with a null, which find nothing, are spread over all tasks by their first column, an id, instead of one task."""
    one, other = pairs[0]
    spread = F.coalesce(F.col(one), F.concat(F.lit("\u0000"), F.xxhash64(rows.columns[0]).cast("string")))
    on = spread == F.col(other)
    for a, b in pairs:
        on &= F.col(a) == F.col(b)
    return rows.join(keys, on, "left")


def parent_kind(r: Relations) -> DataFrame:
    """Boarding points whose parent is missing, no stop place, or of another domain."""
    parent = r["location"].select(F.col("location_id").alias("_parent"), F.col("kind").alias("_kind"), F.col("domain").alias("_domain"))
    points = r["location"].filter("kind = 'boarding_point'")
    bad = F.col("_parent").isNull() | (F.col("_kind") != "stop_place") | (F.col("_domain") != F.col("domain"))
    return points.join(parent, F.col("parent_location_id") == F.col("_parent"), "left").filter(bad).select(*r["location"].columns)


def call_shape(r: Relations) -> DataFrame:
    """Passenger calls without a boarding point or with a passage, and operational calls with anything but a passage."""
    return r["trip_call"].filter(
        "(passenger_service AND (boarding_point_id IS NULL OR scheduled_passage IS NOT NULL)) OR (NOT passenger_service AND (boarding_point_id IS NOT NULL"
        " OR scheduled_arrival IS NOT NULL OR scheduled_departure IS NOT NULL OR pickup_type <> 1 OR dropoff_type <> 1))"
    )


def boarding_kind(r: Relations) -> DataFrame:
    """Calls whose boarding point is a location of another kind."""
    others = r["location"].filter("kind <> 'boarding_point'").select(F.col("location_id").alias("_id"))
    return r["trip_call"].join(others, F.col("boarding_point_id") == F.col("_id"), "left_semi")


def coverage_endpoints(r: Relations) -> DataFrame:
    """Coverages of which an end is no call of the trip."""
    calls = r["trip_call"].select("trip_id", "sequence")
    first = _key(calls, _t1="trip_id", _s1="sequence")
    last = _key(calls, _t2="trip_id", _s2="sequence")
    c = r["source_trip_coverage"]
    out = c.join(first, (c["trip_id"] == F.col("_t1")) & (c["from_sequence"] == F.col("_s1")), "left")
    out = out.join(last, (c["trip_id"] == F.col("_t2")) & (c["to_sequence"] == F.col("_s2")), "left")
    return out.filter("_has__t1 IS NULL OR _has__t2 IS NULL").select(*[c[x] for x in c.columns])


_TRIP_MAP_KEY = ["source_id", "trip_namespace", "source_trip_id", "trip_id"]


def coverage_mapping(r: Relations) -> DataFrame:
    """Coverages of a trip that the source's trip isn't mapped to."""
    return r["source_trip_coverage"].join(r["source_trip_map"], _TRIP_MAP_KEY, "left_anti")


def call_mapping(r: Relations) -> DataFrame:
    """Call mappings of a trip that the source's trip isn't mapped to."""
    return r["source_call_map"].join(r["source_trip_map"], _TRIP_MAP_KEY, "left_anti")


def overlapping_segments(r: Relations) -> DataFrame:
    """Pairs of a trip's segments of which the later begins before the earlier ends: one row for each pair."""
    s = r["route_segment"]
    a = s.select("trip_id", F.col("from_sequence").alias("left_from"), F.col("to_sequence").alias("left_to"))
    b = s.select("trip_id", F.col("from_sequence").alias("right_from"), F.col("to_sequence").alias("right_to"))
    return a.join(b, "trip_id").filter("left_from < right_from AND left_to >= right_from")


def segments_in_overlap(r: Relations) -> DataFrame:
    """Segments that begin before an earlier one of their trip ends: the same trips as overlapping_segments, in one pass."""
    before = W.Window.partitionBy("trip_id").orderBy("from_sequence").rangeBetween(W.Window.unboundedPreceding, -1)
    return r["route_segment"].withColumn("_reach", F.max("to_sequence").over(before)).filter("_reach >= from_sequence").drop("_reach")


def empty_note(r: Relations) -> DataFrame:
    return r["service_note"].filter("label IS NULL AND text IS NULL")


def feature_references(r: Relations) -> DataFrame:
    """Features whose target, by their scope, or whose note doesn't exist."""
    f = r["service_feature_assignment"]
    out = _found(f, _key(r["route"], _r="route_id"), ("route_id", "_r"))
    out = _found(out, _key(r["trip"], _t="trip_id"), ("trip_id", "_t"))
    out = _found(out, _key(r["trip_call"], _ct="trip_id", _cs="sequence"), ("trip_id", "_ct"), ("call_sequence", "_cs"))
    out = _found(out, _key(r["service_note"], _n="note_id"), ("note_id", "_n"))
    bad = "(scope = 'route' AND _has__r IS NULL) OR (scope = 'trip' AND _has__t IS NULL) OR (scope = 'call' AND _has__ct IS NULL) OR (note_id IS NOT NULL AND _has__n IS NULL)"
    return out.filter(bad).select(*f.columns)


def location_feature_references(r: Relations) -> DataFrame:
    return r["location_feature"].join(r["location"], "location_id", "left_anti")


def connection_state(r: Relations) -> DataFrame:
    """Claims whose resolution or derivation contradicts their targets."""
    texts = "target_public_line target_destination_text target_source_route_id target_source_trip_id target_source_stop_id target_source_post_id target_source_end_stop_id target_source_end_post_id".split()
    return r["connection_claim"].filter(
        "(resolution_status = 'resolved' AND target_trip_id IS NULL) OR (resolution_status = 'pattern' AND target_route_id IS NULL)"
        " OR (resolution_status = 'unresolved' AND (target_trip_id IS NOT NULL OR target_route_id IS NOT NULL))"
        f" OR (target_derivation = 'none' AND coalesce({', '.join(texts)}) IS NOT NULL)"
    )


def connection_targets(r: Relations) -> DataFrame:
    """Claims with a target that doesn't exist."""
    c = r["connection_claim"]
    out = _found(c, _key(r["route"], _r="route_id"), ("target_route_id", "_r"))
    out = _found(out, _key(r["trip"], _t="trip_id"), ("target_trip_id", "_t"))
    out = _found(out, _key(r["location"], _l="location_id"), ("target_location_id", "_l"))
    bad = "(target_route_id IS NOT NULL AND _has__r IS NULL) OR (target_trip_id IS NOT NULL AND _has__t IS NULL) OR (target_location_id IS NOT NULL AND _has__l IS NULL)"
    return out.filter(bad).select(*c.columns)


def restriction_references(r: Relations) -> DataFrame:
    """Restrictions whose target, by their scope, doesn't exist; a call without a sequence has none."""
    x = r["travel_restriction_assignment"]
    out = _found(x, _key(r["route"], _r="route_id"), ("route_id", "_r"))
    out = _found(out, _key(r["trip_call"], _ct="trip_id", _cs="sequence"), ("trip_id", "_ct"), ("call_sequence", "_cs"))
    return out.filter("(scope = 'route_stop' AND _has__r IS NULL) OR (scope = 'trip_call' AND _has__ct IS NULL)").select(*x.columns)


#: In the order in which a load reports them.
CHECKS: dict[str, Callable[[Relations], DataFrame]] = {
    "location parent kind/domain": parent_kind,
    "trip call shape": call_shape,
    "boarding point kind": boarding_kind,
    "coverage endpoints": coverage_endpoints,
    "coverage source trip mapping": coverage_mapping,
    "source call trip mapping": call_mapping,
    "overlapping route segments": overlapping_segments,
    "empty service note": empty_note,
    "service feature references": feature_references,
    "location feature references": location_feature_references,
    "connection resolution": connection_state,
    "connection target references": connection_targets,
    "travel restriction references": restriction_references,
}


def _counted(found: list[tuple[str, DataFrame]], name: str) -> DataFrame:
    parts = [df.agg(F.count("*").alias("violations")).select(F.lit(label).alias(name), "violations") for label, df in found]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def summary(r: Relations, checks: Mapping[str, Callable[[Relations], DataFrame]] = CHECKS) -> DataFrame:
    """(check, violations) for the checks whose relations are all there: one plan, so shared scans run once."""
    return _counted([(label, f(r)) for label, f in checks.items()], "check")


def reference_violations(r: Relations, reference: Reference) -> DataFrame:
    """Child rows without a parent; a null in any of the columns exempts the row."""
    child = r[reference.child].dropna(subset=list(reference.columns))
    parent = r[reference.parent].select(*[F.col(p).alias(f"_p{k}") for k, p in enumerate(reference.parent_columns)])
    on = [F.col(c) == F.col(f"_p{k}") for k, c in enumerate(reference.columns)]
    return child.join(parent, on, "left_anti")


def references_summary(r: Relations) -> DataFrame:
    """(reference, violations) for every reference whose two relations are there."""
    return _counted([(x.name, reference_violations(r, x)) for x in REFERENCES if x.child in r and x.parent in r], "reference")


def domains_summary(r: Relations) -> DataFrame:
    """(relation, condition, violations): one scan for each relation, whatever the number of conditions."""
    out = None
    for name, conditions in DOMAINS.items():
        if name not in r:
            continue
        counts = r[name].agg(*[F.count_if(~F.coalesce(F.expr(c), F.lit(True))).alias(k) for k, c in conditions.items()])
        rows = counts.select(F.lit(name).alias("relation"), F.explode(F.array(*[F.struct(F.lit(k).alias("condition"), F.col(k).alias("violations")) for k in conditions])).alias("x")).select("relation", "x.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def null_violations(name: str, df: DataFrame) -> DataFrame:
    """(column, violations): nulls in columns that the contract holds non-null; file schemas lose this on reading."""
    required = [f.name for f in RELATIONS[name].schema if not f.nullable]
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("violations")) for c in required])).alias("x")).select("x.*")


def key_order(df: DataFrame, key: list[str], order: str, within: str) -> DataFrame:
    """(kind, violations) of keys that don't rise strictly in ``order``: null, duplicate or unsorted.

    ``within`` splits the rows into parts that hold consecutive rows, as files or row groups do. Parts are
    checked in parallel, and the first and last row of each, one row a part, against each other.
    """
    k = F.struct(*key)
    rows = df.select(within, order, k.alias("key"), F.greatest(*[F.col(c).isNull().cast("int") for c in key], F.lit(0)).alias("null"))
    inner = W.Window.partitionBy(within).orderBy(order)
    steps = rows.withColumn("before", F.lag("key").over(inner)).select("key", "before", "null")
    edges = rows.groupBy(within).agg(F.min_by("key", order).alias("first"), F.max_by("key", order).alias("last"), F.min(order).alias("at"))
    borders = edges.withColumn("before", F.lag("last").over(W.Window.orderBy("at"))).filter("before IS NOT NULL").select(F.col("first").alias("key"), "before", F.lit(0).alias("null"))
    kinds = steps.filter("null = 1 OR before IS NOT NULL").unionByName(borders)
    kind = F.when(F.col("null") == 1, "null").when(F.col("key") == F.col("before"), "duplicate").when(F.col("key") < F.col("before"), "unsorted")
    return kinds.select(kind.alias("kind")).filter("kind IS NOT NULL").groupBy("kind").agg(F.count("*").alias("violations"))
