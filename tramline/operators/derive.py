"""Derivations over ordered calls, calendars and shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Radius of the earth in kilometres, for distances between coordinates.
EARTH_KM = 6371.0


def point_text(lon: Column, lat: Column) -> Column:
    """Longitude, blank, latitude; both as decimals of six places, so that all engines write them alike."""
    return F.concat(lon.cast("decimal(12,6)").cast("string"), F.lit(" "), lat.cast("decimal(12,6)").cast("string"))


def position_wkt(lon: Column, lat: Column) -> Column:
    """A point's text, null without coordinates; a single missing coordinate is an error."""
    text = F.concat(F.lit("POINT("), point_text(lon, lat), F.lit(")"))
    return F.when(lon.isNull() != lat.isNull(), F.raise_error(F.lit("a position needs both coordinates or none")).cast("string")).when(lon.isNotNull(), text)


def shape_lines(points: DataFrame) -> DataFrame:
    """(shape_id, n_points, line): the points in order of sequence; a shape of one point has no line."""
    ordered = F.array_sort(F.collect_list(F.struct("sequence", point_text(F.col("longitude"), F.col("latitude")).alias("p"))))
    agg = points.groupBy("shape_id").agg(F.count("*").alias("n_points"), F.transform(ordered, lambda x: x["p"]).alias("_p"))
    return agg.select("shape_id", "n_points", F.when(F.col("n_points") > 1, F.concat(F.lit("LINESTRING("), F.array_join("_p", ", "), F.lit(")"))).alias("line"))


def _on_days(calendars: DataFrame, *columns: str) -> DataFrame:
    """(columns, service_date): days in the closed range whose bit is set (bit 0 is Monday)."""
    days = calendars.select(*columns, "weekday_mask", F.explode(F.sequence("valid_from", "valid_to")).alias("service_date"))
    return days.filter(F.expr("(shiftright(weekday_mask, weekday(service_date)) & 1) = 1")).select(*columns, "service_date")


def active_days(calendars: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """(service_id, service_date): days in the closed range whose bit is set (bit 0 is Monday), with and without the exceptions."""
    if exceptions is None:
        return _on_days(calendars, "service_id")
    # calendars and exceptions meet by service, before days are told: days are neither shuffled nor held but for one service's
    span, day = F.struct("valid_from", "valid_to", "weekday_mask"), F.struct("service_date")
    spans = calendars.select("service_id", span.alias("_span"))
    dated = exceptions.select("service_id", F.when(~F.col("added"), day).alias("_off"), F.when(F.col("added"), day).alias("_on"))
    sets = [F.collect_set(c).alias(c) for c in ("_span", "_off", "_on")]
    own = spans.unionByName(dated, allowMissingColumns=True).groupBy("service_id").agg(*sets)

    def on_days(s: Column) -> Column:
        days = F.filter(F.sequence(s["valid_from"], s["valid_to"]), lambda d: F.call_function("shiftright", s["weekday_mask"], F.weekday(d)).bitwiseAND(1) == 1)
        return F.coalesce(days, F.array().cast("array<date>"))

    dates = lambda c: F.transform(c, lambda x: x["service_date"])
    days = F.aggregate("_span", F.array().cast("array<date>"), lambda found, s: F.array_union(found, on_days(s)))
    return own.select("service_id", F.explode(F.array_union(F.array_except(days, dates("_off")), dates("_on"))).alias("service_date"))


def trip_instances(trips: DataFrame, days: DataFrame) -> DataFrame:
    """(trip_id, service_date): each trip on each active day of its service."""
    # days come from few rows of calendars, whose size tells nothing of theirs: they are never broadcast
    return trips.select("trip_id", "service_id").join(days.hint("merge"), "service_id").select("trip_id", "service_date")


def trips_per_day(trips: DataFrame, calendars: DataFrame) -> DataFrame:
    """(service_date, trips): how many trip_instances() a day has. Trips are counted by service before these are told by days."""
    counts = trips.groupBy("service_id").agg(F.count("*").alias("trips"))
    days = _on_days(calendars.join(counts.hint("merge"), "service_id"), "trips")
    return days.groupBy("service_date").agg(F.sum("trips").alias("trips"))


def bitmap_days(rows: DataFrame, bitmap: str, start: str) -> DataFrame:
    """A row for each set bit, with its date: the first bit is the start."""
    bits = F.posexplode(F.split(F.col(bitmap), "(?<=.)(?=.)"))
    return rows.select("*", bits.alias("_at", "_bit")).filter("_bit = '1'").withColumn("service_date", F.date_add(F.col(start), F.col("_at"))).drop("_at", "_bit")


def local_seconds(time: Column, day_offset: Column) -> Column:
    """hh:mm:ss with a day offset as seconds of the service day; can be over a day or negative.

    Fractions of seconds are cut. A zone behind the time is not used: times are local. Other texts give null.
    """
    pattern = r"^\s*(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?\s*(?:Z|[+-]\d{2}:?\d{2})?\s*\z"
    part = lambda k: F.regexp_extract(time, pattern, k).try_cast("int")
    return day_offset.cast("int") * 86400 + part(1) * 3600 + part(2) * 60 + F.coalesce(part(3), F.lit(0))


def _order(trip: str, sequence: str) -> W.WindowSpec:
    return W.Window.partitionBy(trip).orderBy(sequence)


def change_segments(calls: DataFrame, value: str, trip: str = "trip_id", sequence: str = "sequence") -> DataFrame:
    """(trip, segment, value, from_sequence, to_sequence): runs of calls with the same value, nulls being a value."""
    w = _order(trip, sequence)
    new = F.when(F.row_number().over(w) == 1, 0).otherwise((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"))
    last = F.lead(F.lit(1)).over(w).isNull() | ~F.col(value).eqNullSafe(F.lead(value).over(w))
    first = (F.row_number().over(w) == 1) | (new == 1)
    runs = calls.select(trip, value, sequence, new.alias("_new"), first.alias("_first"), last.alias("_last")).withColumn("segment", F.sum("_new").over(w.rowsBetween(W.Window.unboundedPreceding, 0)))
    # of a run its first call and its last one are left, beside each other in the order that there is
    ends = runs.filter("_first OR _last").withColumn("to_sequence", F.when(F.col("_last"), F.col(sequence)).otherwise(F.lead(sequence).over(w)))
    return ends.filter("_first").select(trip, "segment", value, F.col(sequence).alias("from_sequence"), "to_sequence")


def line_segments(calls: DataFrame, value: str, trip: str = "trip_id", sequence: str = "sequence") -> DataFrame:
    """(trip, value, from_sequence, to_sequence): parts of a trip that share the calls where a line begins or ends.

    A line begins at the call where it is new. It ends one call earlier than the first call without it, since it isn't shown any more on
    the way there. A part of no length goes: a line on one call only has no way.
    """
    w = _order(trip, sequence)
    new = (F.row_number().over(w) == 1) | ~F.col(value).eqNullSafe(F.lag(value).over(w))
    start = F.when(F.col(value).isNull() & F.lag(value).over(w).isNotNull(), F.lag(sequence).over(w)).otherwise(F.col(sequence))
    last = F.max(sequence).over(W.Window.partitionBy(trip))
    starts = calls.select(trip, sequence, value, new.alias("_new"), start.alias("from_sequence"), last.alias("_last")).filter("_new")
    parts = starts.withColumn("to_sequence", F.coalesce(F.lead("from_sequence").over(w), F.col("_last")))
    return parts.filter("from_sequence < to_sequence OR from_sequence = _last AND to_sequence = _last AND _last = sequence").select(trip, value, "from_sequence", "to_sequence")


def collapse_consecutive(calls: DataFrame, value: str, trip: str = "trip_id", sequence: str = "sequence") -> DataFrame:
    """Calls without those that repeat the value of the one before."""
    w = _order(trip, sequence)
    same = (F.row_number().over(w) > 1) & F.col(value).eqNullSafe(F.lag(value).over(w))
    return calls.withColumn("_same", same).filter("NOT _same").drop("_same")


def chronological(calls: DataFrame, time: str, trip: str = "trip_id", sequence: str = "sequence") -> DataFrame:
    """Calls of trips whose times never fall; one falling step rejects the whole trip. Calls without a time don't count."""
    w = _order(trip, sequence)
    before = F.last(time, ignorenulls=True).over(w.rowsBetween(W.Window.unboundedPreceding, -1))
    stepped = calls.withColumn("_falls", F.coalesce((F.col(time) < before).cast("int"), F.lit(0)))
    return stepped.withColumn("_bad", F.max("_falls").over(W.Window.partitionBy(trip))).filter("_bad = 0").drop("_falls", "_bad")


def passenger_range(calls: DataFrame, trip: str = "trip_id", sequence: str = "sequence") -> DataFrame:
    """Calls from the first to the last passenger call of their trip, with those two sequences."""
    w = W.Window.partitionBy(trip)
    seq = F.when(F.col("passenger_service"), F.col(sequence))
    ends = calls.withColumn("first_passenger", F.min(seq).over(w)).withColumn("last_passenger", F.max(seq).over(w))
    return ends.filter(F.col(sequence).between(F.col("first_passenger"), F.col("last_passenger")))


def interpolate(calls: DataFrame, value: str, along: str, out: str, trip: str = "trip_id", sequence: str = "sequence") -> DataFrame:
    """``out``: the value, or where it is null the line between the nearest known ones over ``along``; null beyond the ends."""
    w = _order(trip, sequence)
    back, ahead = w.rowsBetween(W.Window.unboundedPreceding, 0), w.rowsBetween(0, W.Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col(along).alias("t")))
    rows = calls.withColumn("_a", F.last(known, ignorenulls=True).over(back)).withColumn("_b", F.first(known, ignorenulls=True).over(ahead))
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col(along) - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t"))
    return rows.withColumn(out, F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_b.t") != F.col("_a.t"), line)).drop("_a", "_b")


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(a))


def speed_veto(calls: DataFrame, candidate: str, km_h: float = 150.0, slack_km: float = 2.0, trip: str = "trip_id", sequence: str = "sequence") -> DataFrame:
    """(candidate, occurrences, vetoed): a coordinate is vetoed if every occurrence is too fast from or to a neighbour.

    calls has longitude, latitude and seconds. Neighbours are the nearest calls before and behind with all three; an occurrence
    without these, or without a neighbour, tells nothing, and without any that does a coordinate isn't vetoed.
    """
    w = _order(trip, sequence)
    known = F.when(F.col("longitude").isNotNull() & F.col("latitude").isNotNull() & F.col("seconds").isNotNull(), F.struct("longitude", "latitude", "seconds"))
    rows = calls.withColumn("_own", known)
    rows = rows.withColumn("_a", F.last("_own", ignorenulls=True).over(w.rowsBetween(W.Window.unboundedPreceding, -1))).withColumn("_b", F.first("_own", ignorenulls=True).over(w.rowsBetween(1, W.Window.unboundedFollowing)))

    def fast(side: str) -> Column:
        km = haversine_km(F.col(f"{side}.longitude"), F.col(f"{side}.latitude"), F.col("longitude"), F.col("latitude"))
        return F.coalesce(km > F.abs(F.col("seconds") - F.col(f"{side}.seconds")) / 3600 * km_h + slack_km, F.lit(False))

    told = F.col("_own").isNotNull() & (F.col("_a").isNotNull() | F.col("_b").isNotNull())
    rows = rows.withColumn("_told", told).withColumn("_fast", fast("_a") | fast("_b"))
    return rows.groupBy(candidate).agg(F.count_if("_told").alias("occurrences"), F.coalesce(F.bool_and(F.when(F.col("_told"), F.col("_fast"))), F.lit(False)).alias("vetoed"))


def monotone_violations(points: DataFrame) -> DataFrame:
    """Shape points whose distance falls against the point before."""
    before = F.last("distance_traveled", ignorenulls=True).over(_order("shape_id", "sequence").rowsBetween(W.Window.unboundedPreceding, -1))
    return points.withColumn("_before", before).filter("distance_traveled < _before").drop("_before")


def linked_trips(segments: DataFrame) -> DataFrame:
    """Segments as trips of one block: (trip_id, part_id, next_part_id, transfer_type 4) for each but the last."""
    w = W.Window.partitionBy("trip_id").orderBy("from_sequence")
    part = F.concat(F.col("trip_id").cast("string"), F.lit(":"), F.row_number().over(w).cast("string"))
    return segments.withColumn("part_id", part).withColumn("next_part_id", F.lead("part_id").over(w)).filter("next_part_id IS NOT NULL").select("trip_id", "part_id", "next_part_id", F.lit(4).alias("transfer_type"))


def pattern_digest(calls: DataFrame, *columns: str, trip: str = "trip_id", sequence: str = "sequence") -> DataFrame:
    """(trip, n_calls, pattern_sha256): a digest of the ordered values, equal for trips with equal calls."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    ordered = F.array_sort(F.collect_list(F.struct(F.col(sequence).alias("s"), text.alias("t"))))
    return calls.groupBy(trip).agg(F.count("*").alias("n_calls"), F.sha2(F.array_join(F.transform(ordered, lambda x: x["t"]), ";"), 256).alias("pattern_sha256"))


def operating_patterns(days: DataFrame) -> DataFrame:
    """(service_id, pattern_id, n_days): services with the same days share a derived id."""
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_set("service_date")), lambda d: d.cast("string")), ","), 256)
    return days.groupBy("service_id").agg(F.count_distinct("service_date").alias("n_days"), digest.alias("_d")).select("service_id", F.concat(F.lit("pattern:"), F.substring("_d", 1, 16)).alias("pattern_id"), "n_days")


def departures(calls: DataFrame, trips: DataFrame, place: str, limit: int | None = None) -> DataFrame:
    """The departure board of every ``place``: passenger calls with a departure, by time, numbered; with a limit the first so many."""
    rows = calls.filter("passenger_service AND scheduled_departure IS NOT NULL").join(trips.select("trip_id", "headsign", "route_id"), "trip_id")
    w = W.Window.partitionBy(place).orderBy("scheduled_departure", "trip_id", "sequence")
    out = rows.withColumn("position", F.row_number().over(w))
    return (out.filter(F.col("position") <= limit) if limit else out).select(place, "position", "trip_id", "route_id", "headsign", "sequence", "scheduled_departure")
