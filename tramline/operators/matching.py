"""Matching of places to coordinates by a cascade of methods, and of regional trips to national ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.names import cleaned, normal, sides
from .derive import haversine_km
from .lineage import cut, kept
from .overlay import best_candidate

#: From the strongest to the weakest.
METHODS = ("authority", "exact_code", "alias", "exact_name", "cleaned_name", "fuzzy_name", "estimate")
#: Letters of a gram, and what stands before and behind a name.
GRAM, PAD = 3, "\u0001"
#: Letters of a name that is short: what is left without two of its letters are 211 texts at most.
SHORT = 20
#: Points that are sent to all tasks, at most.
BROADCAST_ROWS = 200_000
#: Ids in a list, at most.
HELD = 1_000
#: Kilometres of a degree of latitude, and those that a call at an open end lies north of the one before.
DEGREE_KM, STEP_KM = 111.195, 0.3


def _shortened(names: DataFrame, name: str, edits: int, others: DataFrame) -> DataFrame:
    """(name, rest): the hashes of what is left of names without so many letters or fewer, as far as others (of a name beside) have lengths that it can meet.

    Names within the edits keep all but so many letters of the longer one. So the longer one, or either if they are of a length, goes without just so many
    letters, and the shorter one without as many fewer as it is shorter. Of a run of one letter only the last is left out: the others leave the same.
    """
    own = F.length(name)
    (other,) = others.columns
    lengths = others.agg(F.collect_set(F.length(other)).alias("_lengths"))
    rows = names.crossJoin(F.broadcast(lengths)).select(name, "_lengths", F.col(name).alias("_text"), own.alias("_upto"))
    out = None
    for gone in range(edits + 1):
        # the length of the longer name, and those of names that can be beside it
        able = F.arrays_overlap("_lengths", F.array(*[own - k for k in range(edits + 1)])) if gone == edits else F.array_contains("_lengths", own + (edits - gone))
        told = rows.filter(able).select(name, F.xxhash64("_text").alias("rest"))
        out = told if out is None else out.unionByName(told)
        if gone < edits:
            rows = rows.filter("_upto > 0").select("*", F.explode(F.sequence(F.lit(1), "_upto")).alias("_at")).filter("substr(_text, _at, 1) <> substr(_text, _at + 1, 1)")
            rows = rows.select(name, "_lengths", F.expr("concat(substr(_text, 1, _at - 1), substr(_text, _at + 1))").alias("_text"), (F.col("_at") - 1).alias("_upto"))
    return out


def _met_by_deletions(points: DataFrame, objects: DataFrame, edits: int) -> DataFrame:
    """(_p, _o) that have something in common once so many letters of each are left out; the letters that an edit doesn't touch are such a rest.

    Names that meet are within twice the edits of each other, however often their grams are in other names.
    """
    return _shortened(points, "_p", edits, objects).join(_shortened(objects, "_o", edits, points).hint("merge"), "rest").select("_p", "_o")


def _grams(names: DataFrame) -> DataFrame:
    """(name, gram, place) for each run of GRAM letters of the padded name."""
    padded = F.concat(F.lit(PAD * (GRAM - 1)), "name", F.lit(PAD * (GRAM - 1)))
    grams = F.transform(F.sequence(F.lit(1), F.length("name") + GRAM - 1), lambda i: F.substring(padded, i, GRAM))
    return names.select("name", F.posexplode(grams).alias("place", "gram"))


def _rarest(names: DataFrame, counts: DataFrame, many: int) -> DataFrame:
    """(name, n, gram, place) of the ``many`` rarest grams of each name, in one order for all names."""
    order = F.struct("often", "gram", "place")
    kept = _grams(names).join(counts, "gram").groupBy("name").agg(F.slice(F.array_sort(F.collect_list(order)), 1, many).alias("x"))
    return kept.select("name", F.length("name").alias("n"), F.explode("x").alias("x")).select("name", "n", "x.gram", "x.place")


def _met_by_rare_grams(points: DataFrame, objects: DataFrame, edits: int) -> DataFrame:
    """(_p, _o) that share a gram, of either's rarest ones, at places and in names of lengths that so many edits allow.

    An edit changes GRAM grams at most, so names within the edits keep all but GRAM * edits of the longer one's, in their order. Then the first
    that is kept, in any one order of grams and places, is among the first GRAM * edits + 1 of either; with the rarest first few names meet. It is moved
    by the edits before it, and the end of the name by those behind: both are at most the edits. Names of no more grams can share none.
    """
    own, asked = objects.select(F.col("_o").alias("name")), points.select(F.col("_p").alias("name"))
    counts = _grams(own).groupBy("gram").agg(F.count("*").alias("often"))
    there = _rarest(own, counts, GRAM * edits + 1).withColumnRenamed("name", "_o")
    # grams that no object has come first and meet nothing
    every = _grams(asked).select("gram").distinct().join(counts, "gram", "left").fillna(0, ["often"])
    probes = _rarest(asked, every, GRAM * edits + 1).withColumnRenamed("name", "_p")
    moves = [(longer, move) for longer in range(-edits, edits + 1) for move in range(-edits, edits + 1) if abs(move) + abs(longer - move) <= edits]
    at = F.explode(F.array(*[F.struct((F.col("n") + longer).alias("n"), (F.col("place") + move).alias("place")) for longer, move in moves]))
    near = probes.select("_p", "gram", at.alias("x")).select("_p", "gram", "x.*")
    return near.join(there.hint("merge"), ["n", "gram", "place"]).select("_p", "_o")


def _held(rows: DataFrame, name: str, key: str) -> DataFrame:
    """(name, _part, key): the keys of a name as lists of HELD at most, numbered from 0."""
    w = W.Window.partitionBy(name).orderBy(key)
    parts = rows.select(name, key, F.floor((F.row_number().over(w) - 1) / HELD).alias("_part"))
    return parts.groupBy(name, "_part").agg(F.collect_list(key).alias(key))


def _with_held(names: DataFrame, held: DataFrame, name: str) -> DataFrame:
    """names beside each list of held; the lists of a name lie in several tasks. Only names of more than one list are sent to all, at most a HELDth of the rows."""
    more = held.groupBy(name).agg(F.max("_part").alias("_last")).filter("_last > 0")
    spread = names.join(F.broadcast(more), name, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_last", F.lit(0).cast("long"))))).drop("_last")
    return spread.join(held.hint("merge"), [name, "_part"]).drop("_part")


def fuzzy_pairs(points: DataFrame, objects: DataFrame, edits: int = 2) -> DataFrame:
    """(point_id, object_id, edits): names (of points: _p, of objects: _o) within so many edits of each other; no pair is missed.

    Different names are compared once. Where either is longer than SHORT they meet by rare grams, else by what is left without a few letters.
    Names no longer than the edits take no part. The distance then decides. Ids meet as lists, and pairs of them are told last, where nothing is shuffled any more.
    """
    names = _with_held(fuzzy_words(points, objects, edits), _held(points, "_p", "point_id"), "_p")
    both = _with_held(names, _held(objects, "_o", "object_id"), "_o")
    return both.withColumn("point_id", F.explode("point_id")).withColumn("object_id", F.explode("object_id")).select("point_id", "object_id", "_p", "_o", "edits")


def fuzzy_words(points: DataFrame, objects: DataFrame, edits: int = 2, alike: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(_p, _o, edits): fuzzy_pairs() of the different names, whatever the number of points and objects that share one.

    With ``alike`` names must agree in it too; it is asked only of names that are near enough.
    """
    p, o = cut(points.select("_p").filter(F.length("_p") > edits).distinct()), cut(objects.select("_o").filter(F.length("_o") > edits).distinct())
    small = lambda df, c: df.filter(F.length(c) <= SHORT)
    large = lambda df, c: df.filter(F.length(c) > SHORT - edits)
    met = _met_by_rare_grams(large(p, "_p"), large(o, "_o"), edits).unionByName(_met_by_deletions(small(p, "_p"), small(o, "_o"), edits))
    distance = F.levenshtein("_p", "_o", edits)
    if alike is not None:
        distance = F.when(distance >= 0, F.when(alike(F.col("_p"), F.col("_o")), distance))
    # names that meet more than once are fewer, when shuffled, once their distance is known
    return met.withColumn("edits", distance).filter("edits >= 0").distinct()


def _hits(points: DataFrame, objects: DataFrame, left: Column, right: Column, method: str) -> DataFrame:
    """Points and the objects of an equal key; a key that several objects share matches none."""
    o = objects.select(right.alias("_key"), "object_id", "longitude", "latitude").filter("_key IS NOT NULL AND _key <> ''")
    single = o.groupBy("_key").agg(F.count("*").alias("_n"), F.first("object_id").alias("object_id"), F.first("longitude").alias("longitude"), F.first("latitude").alias("latitude")).filter("_n = 1").drop("_n")
    p = points.select("point_id", left.alias("_left"))
    return p.join(single.hint("merge"), p["_left"] == single["_key"]).select("point_id", "object_id", "longitude", "latitude", F.lit(METHODS.index(method)).alias("priority"), F.lit(method).alias("method"))


def candidates(points: DataFrame, authority: DataFrame, objects: DataFrame, aliases: DataFrame, edits: int = 2) -> DataFrame:
    """(point_id, object_id, longitude, latitude, priority, method) by all methods but the estimate.

    points: point_id, country, code, name; authority: code, longitude, latitude; objects: object_id,
    reference, name, longitude, latitude; aliases: point_id, object_id. Fuzzy names of four letters or more agree
    but for so many edits, and in their words that tell sides.
    """
    first = authority.select(F.col("code").alias("_c"), F.lit("authority").alias("object_id"), "longitude", "latitude")
    found = points.filter("country = 'CZ'").join(first.hint("merge"), F.col("code") == F.col("_c")).select("point_id", "object_id", "longitude", "latitude", F.lit(0).alias("priority"), F.lit("authority").alias("method"))
    found = found.unionByName(_hits(points, objects, F.concat("country", "code"), F.col("reference"), "exact_code"))
    named = aliases.join(objects.select("object_id", "longitude", "latitude").hint("merge"), "object_id")
    found = found.unionByName(named.select("point_id", "object_id", "longitude", "latitude", F.lit(2).alias("priority"), F.lit("alias").alias("method")))
    # names' forms cost more than all else of a row, and each join would find them again
    forms = [normal(F.col("name")).alias("_normal"), cleaned(F.col("name")).alias("_cleaned")]
    points, objects = cut(points.select("point_id", *forms)), cut(objects.select("object_id", "longitude", "latitude", *forms))
    found = found.unionByName(_hits(points, objects, F.col("_normal"), F.col("_normal"), "exact_name"))
    found = found.unionByName(_hits(points, objects, F.col("_cleaned"), F.col("_cleaned"), "cleaned_name"))
    p = points.select("point_id", F.col("_cleaned").alias("_p")).filter("length(_p) >= 4")
    o = objects.select("object_id", "longitude", "latitude", F.col("_cleaned").alias("_o")).filter("length(_o) >= 4")
    # of the objects of a name only the first can be the closest, and points of a name have the same
    first = o.groupBy("_o").agg(F.min_by(F.struct("object_id", "longitude", "latitude"), "object_id").alias("x"))
    # an equal name is the closest, so that other names are looked for only where there is none
    same = first.select(F.col("_o").alias("_p"), "x")
    near = fuzzy_words(p.join(same.hint("merge"), "_p", "left_anti"), o, edits, lambda a, b: sides(a) == sides(b))
    best = near.join(first.hint("merge"), "_o").groupBy("_p").agg(F.min_by("x", F.struct("edits", "x.object_id")).alias("x"))
    closest = p.join(same.unionByName(best).hint("merge"), "_p")
    return found.unionByName(closest.select("point_id", "x.*", F.lit(5).alias("priority"), F.lit("fuzzy_name").alias("method")))


def matched(points: DataFrame, found: DataFrame, vetoed: DataFrame | None = None) -> DataFrame:
    """points with the best candidate that isn't vetoed (point_id, object_id); the authority can't be vetoed. Without one all is null."""
    if vetoed is not None:
        bad = vetoed.select(F.col("point_id").alias("_p"), F.col("object_id").alias("_o"))
        found = found.join(bad.hint("merge"), (F.col("point_id") == F.col("_p")) & (F.col("object_id") == F.col("_o")) & (F.col("method") != "authority"), "left_anti")
    return points.join(best_candidate(found, "point_id", "object_id").drop("priority").hint("merge"), "point_id", "left")


def _with_points(calls: DataFrame, points: DataFrame, called: DataFrame, how: str = "inner") -> DataFrame:
    """calls joined with points by point_id. The points that have calls (called: point_id) are counted first: calls are shuffled by their point only where these are too many to be sent to all."""
    own = cut(points.join(called.hint("merge"), "point_id", "left_semi"))
    return calls.join(F.broadcast(own) if own.count() <= BROADCAST_ROWS else own.hint("merge"), "point_id", how)


def _called(calls: DataFrame) -> DataFrame:
    return cut(calls.select("point_id").distinct())


def estimates(calls: DataFrame, known: DataFrame) -> DataFrame:
    """(point_id, longitude, latitude, two_sided): where the timetable puts points without a coordinate, from one occurrence each.

    calls: trip_id, sequence, point_id, seconds, days; known: point_id, longitude, latitude. Of a point's timed occurrences counts the
    one between two known calls, with the fewest calls between these, the shortest way between them, the most days, then by trip
    and sequence; it lies on the line between them by time. At an open end each call lies STEP_KM north of the one before.
    """
    k = known.select("point_id", F.col("longitude").alias("_lon"), F.col("latitude").alias("_lat"))
    w = W.Window.partitionBy("trip_id").orderBy("sequence")
    rows = _with_points(calls, k, _called(calls), "left").withColumn("_n", F.row_number().over(w))
    own = F.when(F.col("_lon").isNotNull() & F.col("seconds").isNotNull(), F.struct(F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), F.col("seconds").alias("t"), F.col("_n").alias("n")))
    rows = rows.withColumn("_a", F.last(own, ignorenulls=True).over(w.rowsBetween(W.Window.unboundedPreceding, -1))).withColumn("_b", F.first(own, ignorenulls=True).over(w.rowsBetween(1, W.Window.unboundedFollowing)))
    open_ = rows.filter("_lon IS NULL AND seconds IS NOT NULL AND (_a IS NOT NULL OR _b IS NOT NULL)")
    two = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    share = F.when(F.col("_b.t") != F.col("_a.t"), (F.col("seconds") - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t"))).otherwise(F.lit(0.5))
    one = F.coalesce("_a", "_b")
    lon = F.when(two, F.col("_a.lon") + (F.col("_b.lon") - F.col("_a.lon")) * share).otherwise(one["lon"])
    lat = F.when(two, F.col("_a.lat") + (F.col("_b.lat") - F.col("_a.lat")) * share).otherwise(one["lat"] + F.abs(F.col("_n") - one["n"]) * (STEP_KM / DEGREE_KM))
    span = F.when(two, haversine_km(F.col("_a.lon"), F.col("_a.lat"), F.col("_b.lon"), F.col("_b.lat"))).otherwise(F.lit(0.0))
    gap = F.when(two, F.col("_b.n") - F.col("_a.n")).otherwise(F.abs(F.col("_n") - one["n"]))
    order = F.struct((~two).alias("open"), gap.alias("gap"), span.alias("span"), (-F.col("days")).alias("days"), "trip_id", "sequence")
    return open_.groupBy("point_id").agg(F.min_by(F.struct(lon.alias("longitude"), lat.alias("latitude"), two.alias("two_sided")), order).alias("x")).select("point_id", "x.*")


def too_fast(found: DataFrame, calls: DataFrame, km_h: float = 150.0, slack_km: float = 2.0) -> DataFrame:
    """(point_id, object_id) of candidates that every occurrence in calls rules out, by the speed from and to neighbours with a coordinate of the authority's.

    calls: trip_id, sequence, point_id, seconds. Each candidate is tried at its point's calls; calls of other points stand where the authority has them.
    A neighbour is of the authority's or of the candidate's own point, where nothing is too fast. So it is the same for all candidates of a call, and
    calls are gone through once, whatever the number of candidates; these meet the calls with their neighbours last.
    """
    placed = F.col("longitude").isNotNull() & F.col("latitude").isNotNull()
    of = found.groupBy("point_id").agg(F.bool_or(F.col("method") == "authority").alias("_sure"), F.min(F.when(placed & (F.col("method") == "authority"), F.struct("longitude", "latitude"))).alias("_there"))
    called = _called(calls)
    rows = _with_points(calls.filter("seconds IS NOT NULL").select("trip_id", "sequence", "point_id", "seconds"), of.filter("NOT _sure OR _there IS NOT NULL"), called)
    trip = W.Window.partitionBy("trip_id").orderBy("sequence")
    own = W.Window.partitionBy("trip_id", "point_id").orderBy("sequence")
    sure = F.when(F.col("_sure"), F.struct("_there.longitude", "_there.latitude", "seconds", "sequence"))
    rows = rows.withColumn("_a", F.last(sure, ignorenulls=True).over(trip.rowsBetween(W.Window.unboundedPreceding, -1))).withColumn("_b", F.first(sure, ignorenulls=True).over(trip.rowsBetween(1, W.Window.unboundedFollowing)))
    rows = rows.filter(~F.col("_sure")).withColumn("_before", F.lag("sequence").over(own)).withColumn("_behind", F.lead("sequence").over(own))
    told = F.col("_a").isNotNull() | F.col("_b").isNotNull() | F.col("_before").isNotNull() | F.col("_behind").isNotNull()

    def side(name: str, nearer: Column) -> Column:
        at = F.col(name)
        return F.when(~F.coalesce(nearer, F.lit(False)), F.struct(at["longitude"].alias("longitude"), at["latitude"].alias("latitude"), (F.abs(F.col("seconds") - at["seconds"]) / 3600 * km_h + slack_km).alias("km"))).alias(name)

    rows = rows.filter(told).select("point_id", side("_a", F.col("_before") > F.col("_a.sequence")), side("_b", F.col("_behind") < F.col("_b.sequence")))
    tried = found.join(of.filter("_sure").select("point_id").hint("merge"), "point_id", "left_anti").groupBy("point_id", "object_id").agg(F.min("longitude").alias("longitude"), F.min("latitude").alias("latitude"))
    tried = tried.filter(placed).groupBy("point_id").agg(F.collect_list(F.struct("object_id", "longitude", "latitude")).alias("_tried"))
    both = _with_points(rows, tried, called).withColumn("_o", F.explode("_tried"))
    fast = [F.coalesce(haversine_km(F.col(f"{x}.longitude"), F.col(f"{x}.latitude"), F.col("_o.longitude"), F.col("_o.latitude")) > F.col(f"{x}.km"), F.lit(False)) for x in ("_a", "_b")]
    return both.groupBy("point_id", F.col("_o.object_id").alias("object_id")).agg(F.bool_and(fast[0] | fast[1]).alias("_vetoed")).filter("_vetoed").select("point_id", "object_id")


def cascade(points: DataFrame, authority: DataFrame, objects: DataFrame, aliases: DataFrame, calls: DataFrame, edits: int = 2) -> DataFrame:
    """points with (object_id, longitude, latitude, method) by the whole cascade: candidates, those too fast left out, the best that is left, and estimates where none is.

    calls: trip_id, sequence, point_id, seconds, days. Points, objects and calls meet by shuffles: their number isn't told by the size of the files that
    they come from. Only points that have calls are sent to all tasks, where they are counted to be few. Calls are made once and kept as Parquet for what reads them.
    """
    found, calls = cut(candidates(points, authority, objects, aliases, edits)), kept(calls.select("trip_id", "sequence", "point_id", "seconds", "days"))
    return with_estimates(matched(points, found, too_fast(found, calls)), calls)


def with_estimates(found: DataFrame, calls: DataFrame) -> DataFrame:
    """matched() points, those without a coordinate with the estimate of the calls, if there is one."""
    known = found.filter("longitude IS NOT NULL").select("point_id", "longitude", "latitude")
    e = estimates(calls, known).select("point_id", F.col("longitude").alias("_lon"), F.col("latitude").alias("_lat"))
    both = found.join(e.hint("merge"), "point_id", "left")
    use = F.col("longitude").isNull() & F.col("_lon").isNotNull()
    new = {"longitude": F.coalesce("longitude", "_lon"), "latitude": F.coalesce("latitude", "_lat"), "method": F.when(use, "estimate").otherwise(F.col("method"))}
    return both.select(*[new.get(c, F.col(c)).alias(c) for c in found.columns])


def regional_matches(regional: DataFrame, national: DataFrame) -> DataFrame:
    """(trip_id, national_trip_id, days, status): trips by their pattern on each day.

    Inputs: trip_id, service_date, pattern. A regional trip matches if all of its days that have any
    national trip of its pattern name the same single one; else it is ambiguous, and without any unmatched.
    """
    n = national.groupBy("service_date", "pattern").agg(F.min("trip_id").alias("_low"), F.max("trip_id").alias("_high"))
    both = regional.join(n, ["service_date", "pattern"], "left")
    agg = both.groupBy("trip_id").agg(F.min("_low").alias("_a"), F.max("_high").alias("_b"), F.count("_low").alias("days"))
    status = F.when(F.col("days") == 0, "unmatched").when(F.col("_a") == F.col("_b"), "resolved").otherwise("ambiguous")
    return agg.select("trip_id", F.when(status == "resolved", F.col("_a")).alias("national_trip_id"), "days", status.alias("status"))
