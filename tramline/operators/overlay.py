"""Overlays of sources on a national base. These follow prose contracts, and so are interpretations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .lineage import cut

#: Modes of a claim from the strongest to the weakest; disabled claims never count.
MODES = ("authoritative", "preferred", "fill_missing")


def provisional_id(kind: str, seed: Column) -> Column:
    """An id that equal seeds share; seeds are equal whatever the blanks around and between their words."""
    normal = F.regexp_replace(F.trim(seed), r"\s+", " ")
    return F.concat(F.lit(f"v0:{kind}:"), F.substring(F.sha2(normal, 256), 1, 16))


def overlay(base: DataFrame, claims: DataFrame, key: list[str]) -> DataFrame:
    """(key, field, value, source_id, rule) for each field of base or claims.

    base: key, field, value; claims also source_id, mode, priority. An authoritative or preferred claim
    replaces the base's value, one that fills counts where the base has none; the smaller priority
    wins within a mode. Claims of the same rank with different values are a conflict: the value is then
    the base's and the rule ``conflict``, or ``blocking`` between authoritative ones, with which no build goes on. A field
    without a claim keeps its value: omission is no deletion. Claims of one scope or capability only count there if key names its column.
    """
    rank = F.when(F.col("mode") == "authoritative", 0).when(F.col("mode") == "preferred", 1).when(F.col("mode") == "fill_missing", 2)
    live = claims.filter(F.col("mode").isin(*MODES) & F.col("value").isNotNull()).withColumn("_rank", F.struct(rank.alias("r"), F.col("priority").alias("p")))
    best = live.groupBy(*key, "field").agg(F.min("_rank").alias("_best"))
    top = live.join(best, [*key, "field"]).filter(F.col("_rank") == F.col("_best"))
    won = top.groupBy(*key, "field").agg(F.count_distinct("value").alias("_values"), F.min("value").alias("_value"), F.min("source_id").alias("_source"), F.min("_best.r").alias("_r"))
    both = base.select(*key, "field", "value").join(won, [*key, "field"], "full")
    conflict, fills = F.col("_values") > 1, F.col("_r") == 2
    use = F.col("_r").isNotNull() & ~conflict & (~fills | F.col("value").isNull())
    rule = F.when(conflict & (F.col("_r") == 0), "blocking").when(conflict, "conflict").when(use, F.element_at(F.array(*map(F.lit, MODES)), F.col("_r") + 1)).otherwise("base")
    return both.select(*key, "field", F.when(use, F.col("_value")).otherwise(F.col("value")).alias("value"), F.when(use, F.col("_source")).alias("source_id"), rule.alias("rule"))


def segment_overlay(calls: DataFrame, coverage: DataFrame, column: str) -> DataFrame:
    """Calls with ``column`` from the coverage whose closed interval holds them, and their own elsewhere.

    Where intervals overlap the one that starts first counts, then the one that ends first.
    """
    c = coverage.select("trip_id", F.struct("from_sequence", "to_sequence", F.col(column).alias("new")).alias("_c"))
    there = calls.select("trip_id", "sequence").distinct().join(c, "trip_id").filter(F.col("sequence").between(F.col("_c.from_sequence"), F.col("_c.to_sequence")))
    best = there.groupBy("trip_id", "sequence").agg(F.min("_c").alias("_c"))
    rows = calls.join(best, ["trip_id", "sequence"], "left").withColumn(column, F.coalesce(F.col("_c.new"), F.col(column)))
    return rows.select(*calls.columns)


def coverage_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """(trip_id, left_from, right_from, from_sequence, to_sequence): overlaps of two interval sets on the same trip."""
    a = left.select("trip_id", F.col("from_sequence").alias("left_from"), F.col("to_sequence").alias("left_to"))
    b = right.select("trip_id", F.col("from_sequence").alias("right_from"), F.col("to_sequence").alias("right_to"))
    both = a.join(b, "trip_id").filter("left_from <= right_to AND right_from <= left_to")
    return both.select("trip_id", "left_from", "right_from", F.greatest("left_from", "right_from").alias("from_sequence"), F.least("left_to", "right_to").alias("to_sequence"))


def exact_post(calls: DataFrame, matched: DataFrame) -> DataFrame:
    """Calls with their matched post, or the unspecified child of their place."""
    m = matched.select("trip_id", "sequence", "post_id")
    return calls.join(m, ["trip_id", "sequence"], "left").withColumn("boarding_point_id", F.coalesce("post_id", F.concat(F.col("location_id").cast("string"), F.lit(":unspecified")))).drop("post_id")


def stop_groups(stops: DataFrame, *evidence: str, key: str = "stop_id") -> DataFrame:
    """(stop, group): the first evidence that isn't null, else the stop alone."""
    return stops.select(key, F.coalesce(*[F.concat(F.lit(f"{e}:"), F.col(e).cast("string")) for e in evidence], F.concat(F.lit("single:"), F.col(key).cast("string"))).alias("group"))


def continuity(old: DataFrame, new: DataFrame, identity: list[str], id_col: str) -> DataFrame:
    """(id, previous_id, status): new stops by a tuple that is unique on both sides; a tuple that isn't is for review."""
    w = W.Window.partitionBy(*identity)
    o = old.groupBy(*identity).agg(F.count("*").alias("_n_old"), F.min(id_col).alias("previous_id"))
    rows = new.withColumn("_n", F.count("*").over(w)).join(o, identity, "left")
    status = F.when((F.col("_n") > 1) | (F.col("_n_old") > 1), "review").when(F.col("_n_old").isNull(), "new").otherwise("same")
    return rows.select(F.col(id_col), F.when(status == "same", F.col("previous_id")).alias("previous_id"), status.alias("status"))


def follow_redirects(redirects: DataFrame) -> DataFrame:
    """(old_id, final_id, status) for each different old id, whatever the length of its chain.

    redirects: old_id, new_id; a null new_id is a tombstone. status: ``redirected``; ``gone`` where the chain ends in a
    tombstone; ``ambiguous`` for an id of several targets, at which chains that lead to it end as at any other id; ``cycle`` for
    ids in a cycle or leading into one. Only a redirected id has a final one. Chains are followed by doubling: as many rounds as
    their longest length has binary digits, each written. An id that has come to its end is followed no more; where none comes to
    one in a round all that are left lead round cycles, as ids of any chain end in each.
    """
    targets = redirects.groupBy("old_id").agg(F.count_distinct("new_id").alias("n"), F.count("*").alias("rows"), F.count("new_id").alias("named"), F.min("new_id").alias("new_id"))
    several = (F.col("n") > 1) | ((F.col("n") == 1) & (F.col("named") < F.col("rows")))
    first = cut(targets.select("old_id", F.when(~several, F.col("new_id")).alias("new_id"), several.alias("several")))
    now = first.filter("NOT several").select("old_id", F.col("new_id").alias("at"), F.lit(False).alias("ended"))
    done = []
    while True:
        known = reduce(DataFrame.unionByName, done, now).select(F.col("old_id").alias("_o"), F.col("at").alias("_at"), F.col("ended").alias("_ended"))
        told = now.join(known, F.col("at") == F.col("_o"), "left")
        there = F.col("_o").isNotNull()
        new = cut(told.select("old_id", F.when(there, F.col("_at")).otherwise(F.col("at")).alias("at"), (~there | F.col("_ended")).alias("ended")))
        left = {r["ended"] for r in new.select("ended").distinct().collect()}
        done.append(new.filter("ended"))
        now = new.filter("NOT ended")
        if left != {True, False}:
            break
    status = F.when(~F.col("ended"), "cycle").when(F.col("at").isNull(), "gone").otherwise("redirected")
    every = reduce(DataFrame.unionByName, done, now).select("old_id", F.when(status == "redirected", F.col("at")).alias("final_id"), status.alias("status"))
    return every.unionByName(first.filter("several").select("old_id", F.col("new_id").alias("final_id"), F.lit("ambiguous").alias("status")))


def mode_rules(routes: DataFrame, rules: DataFrame) -> DataFrame:
    """Routes with effective_mode and reason: the rule of their agency whose ranges hold the route's id and line and whose mode is theirs.

    A route without a rule keeps its mode. Of several rules the one with the smallest route range start counts.
    """
    key = ["agency_id", "mode", "route_number", "public_line"]
    r = rules.select(*[F.col(c).alias(f"_{c}") for c in rules.columns])
    kinds = routes.select(*key).distinct()
    on = (
        (kinds["agency_id"] == r["_agency_id"])
        & (kinds["mode"] == r["_expected_mode"])
        & kinds["route_number"].between(r["_route_id_from"], r["_route_id_to"])
        & (r["_public_line_from"].isNull() | kinds["public_line"].between(r["_public_line_from"], r["_public_line_to"]))
    )
    hit = kinds.join(r, on).groupBy(*[F.col(c).alias(f"_k_{c}") for c in key]).agg(F.min(F.struct("_route_id_from", "_effective_mode", "_reason")).alias("_hit"))
    same = [routes[c].eqNullSafe(hit[f"_k_{c}"]) for c in key]
    both = routes.join(hit, same[0] & same[1] & same[2] & same[3], "left")
    return both.select(*routes.columns, F.coalesce("_hit._effective_mode", "mode").alias("effective_mode"), F.col("_hit._reason").alias("reason"))


def extended_type(mode: Column, scope: Column) -> Column:
    """The extended type of bus routes by their scope; other modes have none. Fixed numbers."""
    code = F.when(scope == "long_distance", 202).when(scope == "international", 201).when(scope.isin("regional", "regional_international"), 701).when(scope == "city", 704)
    return F.when(mode == "bus", code)


def agreed_zone(zones: DataFrame, key: str = "location_id") -> DataFrame:
    """(key, zone_id): places all of whose memberships name the same zone."""
    agg = zones.groupBy(key).agg(F.min("zone_id").alias("zone_id"), F.max("zone_id").alias("_high"))
    return agg.filter("zone_id = _high").select(key, "zone_id")


def dominant_direction(trips: DataFrame) -> DataFrame:
    """(end_a, end_b, origin, destination, days): for each unordered pair of ends the direction with the most active days, ties to the smaller origin.

    trips: origin, destination, active_days.
    """
    pairs = trips.groupBy("origin", "destination").agg(F.sum("active_days").alias("days"))
    best = pairs.groupBy(F.least("origin", "destination").alias("end_a"), F.greatest("origin", "destination").alias("end_b"))
    return best.agg(F.min(F.struct((-F.col("days")).alias("n"), "origin", "destination")).alias("_w")).select("end_a", "end_b", F.col("_w.origin").alias("origin"), F.col("_w.destination").alias("destination"), (-F.col("_w.n")).alias("days"))


def best_candidate(candidates: DataFrame, key: str, tie: str) -> DataFrame:
    """Each key's candidate of the smallest priority, ties by ``tie``: the end of a cascade of matchers."""
    w = W.Window.partitionBy(key).orderBy("priority", tie)
    return candidates.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def reachable(locations: DataFrame, calls: DataFrame) -> DataFrame:
    """Locations that a call uses, as location or boarding point, and the parents of these."""
    used = calls.select(F.col("location_id").alias("_u")).union(calls.select("boarding_point_id")).dropna().distinct()
    direct = locations.join(used, F.col("location_id") == F.col("_u"), "left_semi")
    ids = direct.select(F.col("location_id").alias("_u")).union(direct.select("parent_location_id")).dropna().distinct()
    return locations.join(ids, F.col("location_id") == F.col("_u"), "left_semi")


def apply_messages(messages: DataFrame) -> DataFrame:
    """(trip, service_date, path): each trip's running days after all messages in order: the last that names a day decides.

    messages: trip, service_date, ord, cancels, path.
    """
    w = W.Window.partitionBy("trip", "service_date").orderBy(F.desc("ord"))
    return messages.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1 AND NOT cancels").select("trip", "service_date", "path")


def unknown_cancellations(messages: DataFrame) -> DataFrame:
    """Cancellations of a trip's day that no earlier message announced."""
    w = W.Window.partitionBy("trip", "service_date").orderBy("ord").rowsBetween(W.Window.unboundedPreceding, -1)
    return messages.withColumn("_known", F.max((~F.col("cancels")).cast("int")).over(w)).filter("cancels AND coalesce(_known, 0) = 0").drop("_known")


def last_known_good(snapshots: DataFrame, key: str, at: str, age: str) -> DataFrame:
    """(key, snapshot, retrieved_at): each source's newest usable snapshot not older than ``age`` at the time ``at``."""
    fresh = snapshots.filter(F.col("usable") & (F.col("retrieved_at") <= F.lit(at).cast("timestamp")) & (F.col("retrieved_at") >= F.lit(at).cast("timestamp") - F.expr(f"INTERVAL {age}")))
    return fresh.groupBy(key).agg(F.max_by("snapshot", F.struct("retrieved_at", "snapshot")).alias("snapshot"), F.max("retrieved_at").alias("retrieved_at"))


def operational_points(calls: DataFrame, mode: str = "gtfs") -> DataFrame:
    """Calls with ``published``: whether the schedule has them. Calls outside the first and last passenger call never are.

    calls: trip_id, sequence, passenger_service, longitude (null where the point has no real coordinate). ``gtfs`` publishes the
    operational calls between that have a coordinate, ``sidecar`` none.
    """
    if mode not in ("gtfs", "sidecar"):
        raise ValueError(f"unknown mode {mode!r}")
    w = W.Window.partitionBy("trip_id")
    seq = F.when(F.col("passenger_service"), F.col("sequence"))
    inside = F.coalesce(F.col("sequence").between(F.min(seq).over(w), F.max(seq).over(w)), F.lit(False))
    shown = F.col("passenger_service") | (F.lit(mode == "gtfs") & F.col("longitude").isNotNull())
    return calls.withColumn("published", inside & shown)


# Fixed limits in kilometres of an adjacent trip's length and of its way abroad, and those of integrated trips.
ADJACENT, INTEGRATED = (120.0, 60.0), (200.0, 80.0)


def regional_adjacent(calls: DataFrame, home: str, neighbours: list[str]) -> DataFrame:
    """(trip_id, span_km, depth_km, disposition) for each trip.

    calls: trip_id, sequence, country, distance_km (along the timetable), integrated. ``domestic`` trips have no call abroad,
    ``foreign`` ones none at home; others are ``adjacent`` if all calls abroad are in neighbouring countries and the span and the
    longest way from the nearest call at home are within the limits, else ``rejected``.
    """
    w = W.Window.partitionBy("trip_id").orderBy("sequence")
    at_home = F.col("country") == home
    here = F.when(at_home, F.col("distance_km"))
    before = F.last(here, ignorenulls=True).over(w.rowsBetween(W.Window.unboundedPreceding, 0))
    after = F.first(here, ignorenulls=True).over(w.rowsBetween(0, W.Window.unboundedFollowing))
    far = F.least(F.col("distance_km") - before, after - F.col("distance_km"))
    agg = calls.withColumn("_far", F.when(~at_home, far)).groupBy("trip_id").agg(
        F.count_if(at_home).alias("_home"),
        F.count_if(~at_home).alias("_abroad"),
        F.bool_and(at_home | F.col("country").isin(neighbours)).alias("_near"),
        (F.max("distance_km") - F.min("distance_km")).alias("span_km"),
        F.coalesce(F.max("_far"), F.lit(0.0)).alias("depth_km"),
        F.bool_and("integrated").alias("_integrated"),
    )
    limit = lambda k: F.when(F.col("_integrated"), INTEGRATED[k]).otherwise(ADJACENT[k])
    fits = F.col("_near") & (F.col("span_km") <= limit(0)) & (F.col("depth_km") <= limit(1))
    disposition = F.when(F.col("_abroad") == 0, "domestic").when(F.col("_home") == 0, "foreign").when(fits, "adjacent").otherwise("rejected")
    return agg.select("trip_id", "span_km", "depth_km", disposition.alias("disposition"))


def transfers_of(claims: DataFrame) -> DataFrame:
    """(connection_id, from_trip_id, to_trip_id, minimum_transfer_time): claims that are resolved to one trip; patterns and unresolved claims stay claims."""
    one = claims.filter("resolution_status = 'resolved' AND target_trip_id IS NOT NULL")
    return one.select("connection_id", F.col("origin_trip_id").alias("from_trip_id"), F.col("target_trip_id").alias("to_trip_id"), (F.col("wait_minutes") * 60).alias("minimum_transfer_time"))


def through_ledger(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """rows (relation, kind, resolution) with target and standard: what a mapping ledger makes of each, never more than the row says.

    ledger: relation, kind (null: any), standard_target, extension_target, needs (the resolution from which the standard target
    may stand, null: any). A row without that, or without a standard target, has the extension's; one that the ledger lacks has none.
    """
    own = ledger.select(*[F.col(c).alias(f"_{c}") for c in ledger.columns])
    on = (rows["relation"] == own["_relation"]) & (own["_kind"].isNull() | own["_kind"].eqNullSafe(rows["kind"]))
    strength = lambda c: F.when(c == "resolved", 2).when(c == "pattern", 1).otherwise(0)
    may = F.col("_standard_target").isNotNull() & (F.col("_needs").isNull() | (strength(F.col("resolution")) >= strength(F.col("_needs"))))
    return rows.join(own, on, "left").select(*rows.columns, F.when(may, F.col("_standard_target")).otherwise(F.col("_extension_target")).alias("target"), F.coalesce(may, F.lit(False)).alias("standard"))


def unmapped(fields: DataFrame, ledger_fields: DataFrame) -> DataFrame:
    """Fields (relation, field) of the relations that a ledger says nothing of."""
    return fields.select("relation", "field").distinct().join(ledger_fields.select("relation", "field"), ["relation", "field"], "left_anti")


def zones_of_calls(calls: DataFrame, zones: DataFrame) -> DataFrame:
    """Calls (trip_id, sequence, route_id, location_id) with the zones of their route's stop, for the calls that are asked for only: zones stay rows of (route_id, location_id, zone_id)."""
    return calls.join(zones.select("route_id", "location_id", "zone_id"), ["route_id", "location_id"])


def train_composition(trains: DataFrame, compositions: DataFrame) -> DataFrame:
    """Trains (train_number, service_date) with the vehicles (position, vehicle_type) of the composition of their number and day, of the smallest priority."""
    c = compositions.select(*[F.col(old).alias(new) for old, new in (("train_number", "_n"), ("valid_from", "_from"), ("valid_to", "_to"), ("priority", "_p"))], "position", "vehicle_type")
    # days meet different spans first: a day's vehicles are told once its priority is known
    spans = c.select("_n", "_from", "_to", "_p").distinct()
    on = (F.col("train_number") == F.col("_n")) & F.col("service_date").between(F.col("_from"), F.col("_to"))
    days = trains.select("train_number", "service_date").distinct()
    best = days.join(spans, on).groupBy("train_number", "service_date").agg(F.min("_p").alias("_best"))
    met = best.join(spans, on & (F.col("_p") == F.col("_best"))).select("train_number", "service_date", "_n", "_from", "_to", "_p")
    return met.join(c.hint("merge"), ["_n", "_from", "_to", "_p"]).select("train_number", "service_date", "position", "vehicle_type")
