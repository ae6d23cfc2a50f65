"""Projections of the relations for feeds: passenger schedules, effective modes and colours, shapes, and checks of what was exported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def clock(seconds: Column) -> Column:
    """hh:mm:ss of seconds of the service day, with hours over 24; null stays null."""
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)


def shifted(calls: DataFrame, times: list[str], trip: str = "trip_id") -> DataFrame:
    """Calls with day_shift: trips with a negative time move by whole days so that none is negative."""
    low = F.min(F.least(*[F.coalesce(F.col(t), F.lit(0)) for t in times])).over(W.Window.partitionBy(trip))
    days = F.greatest(F.lit(0), F.ceil(-low / 86400)).cast("int")
    rows = calls.withColumn("day_shift", days)
    for t in times:
        rows = rows.withColumn(t, F.col(t) + F.col("day_shift") * 86400)
    return rows


def stop_times(calls: DataFrame) -> DataFrame:
    """Passenger calls only, numbered from 1 without gaps."""
    w = W.Window.partitionBy("trip_id").orderBy("sequence")
    arrival, departure = F.coalesce("scheduled_arrival", "scheduled_departure"), F.coalesce("scheduled_departure", "scheduled_arrival")
    rows = calls.filter("passenger_service")
    return rows.select("trip_id", F.row_number().over(w).alias("stop_sequence"), clock(arrival).alias("arrival_time"), clock(departure).alias("departure_time"), F.col("boarding_point_id").alias("stop_id"), "pickup_type", F.col("dropoff_type").alias("drop_off_type"))


def calendar_rows(calendars: DataFrame) -> DataFrame:
    """The weekday bits as columns of 0 and 1."""
    days = "monday tuesday wednesday thursday friday saturday sunday".split()
    bit = lambda k: F.shiftright("weekday_mask", k).bitwiseAND(F.lit(1))
    return calendars.select("service_id", *[bit(k).alias(d) for k, d in enumerate(days)], F.date_format("valid_from", "yyyyMMdd").alias("start_date"), F.date_format("valid_to", "yyyyMMdd").alias("end_date"))


def calendar_dates(exceptions: DataFrame) -> DataFrame:
    return exceptions.select("service_id", F.date_format("service_date", "yyyyMMdd").alias("date"), F.when(F.col("added"), 1).otherwise(2).alias("exception_type"))


def parent_stops(calls: DataFrame, names: DataFrame) -> DataFrame:
    """(stop_id, stop_name, parent_station, platform_code): a child for each platform of a called place, and the places themselves. names: location_id, name."""
    used = calls.select("location_id", "platform").distinct().join(names, "location_id")
    children = used.select(F.concat_ws(":", F.col("location_id"), F.coalesce("platform", F.lit("unspecified"))).alias("stop_id"), F.col("name").alias("stop_name"), F.col("location_id").alias("parent_station"), F.col("platform").alias("platform_code"))
    parents = used.select("location_id", "name").distinct().select(F.col("location_id").alias("stop_id"), F.col("name").alias("stop_name"), F.lit(None).cast("string").alias("parent_station"), F.lit(None).cast("string").alias("platform_code"))
    return children.unionByName(parents)


def public_line(extension: Column, line_id: Column) -> Column:
    """The public designation, or the line id's last three digits without leading zeros: an interpretation."""
    return F.coalesce(extension, F.right(line_id, F.lit(3)).try_cast("int").cast("string"))


def coded(rows: DataFrame, codes: dict[str, str], column: str, out: str) -> DataFrame:
    """Rows with a typed kind for each known code; unknown codes give null and are kept."""
    known = F.create_map(*[F.lit(x) for pair in sorted(codes.items()) for x in pair])
    return rows.withColumn(out, F.try_element_at(known, F.col(column)))


def chosen_shape(trips: DataFrame, regional: DataFrame, national: DataFrame, generated: DataFrame) -> DataFrame:
    """(trip_id, shape_id, origin): the regional shape, else the national, else the generated, else none. Each input: trip_id, shape_id."""
    out = trips.select("trip_id")
    for name, df in (("regional", regional), ("national", national), ("generated", generated)):
        one = df.groupBy("trip_id").agg(F.min("shape_id").alias(name))
        out = out.join(one, "trip_id", "left")
    origin = F.when(F.col("regional").isNotNull(), "regional").when(F.col("national").isNotNull(), "national").when(F.col("generated").isNotNull(), "generated").otherwise("none")
    return out.select("trip_id", F.coalesce("regional", "national", "generated").alias("shape_id"), origin.alias("origin"))


def extension_violations(extensions: dict[str, DataFrame], keys: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(extension, column, violations): values of an extension's column that the feed lacks. keys: column to (feed table, its column)."""
    out = None
    for name, df in sorted(extensions.items()):
        for column, (table, key) in keys.items():
            if column not in df.columns:
                continue
            missing = df.select(F.col(column).alias("_k")).dropna().join(table.select(F.col(key).alias("_k")), "_k", "left_anti")
            row = missing.agg(F.count("*").alias("violations")).select(F.lit(name).alias("extension"), F.lit(column).alias("column"), "violations")
            out = row if out is None else out.unionByName(row)
    return out


def without_disposition(points: DataFrame, accepted: DataFrame, domestic: str) -> DataFrame:
    """Unresolved foreign points for which no text says why they may stay. points: point_id, resolved; accepted: point_id, disposition."""
    foreign = points.filter(~F.col("resolved") & ~F.col("point_id").startswith(domestic))
    return foreign.join(accepted.filter(F.trim("disposition") != "").select("point_id"), "point_id", "left_anti")


def dated_attributes(journeys: DataFrame, attributes: DataFrame, key: str) -> DataFrame:
    """Journeys with the attributes of their key that are valid on their date: the smallest priority, then the latest start."""
    a = attributes.select(*[F.col(c).alias(f"_{c}") for c in attributes.columns])
    # of a key's attributes of one span and priority only one can be the best; they are numbered from the best on, so days keep a number and no texts
    one = a.groupBy(f"_{key}", "_valid_from", "_valid_to", "_priority").agg(F.min_by(F.struct("_attribute", "_source_id"), F.struct("_source_id")).alias("_x"))
    order = F.struct("_priority", F.datediff(F.lit("9999-12-31").cast("date"), F.col("_valid_from")), "_x._source_id")
    ranked = one.withColumn("_nth", F.row_number().over(W.Window.partitionBy(f"_{key}").orderBy(order)))
    days = journeys.select(key, "service_date").distinct()
    spans = ranked.select(f"_{key}", "_valid_from", "_valid_to", "_nth")
    there = days.join(spans, (days[key] == spans[f"_{key}"]) & (spans["_valid_from"] <= days["service_date"]) & (spans["_valid_to"].isNull() | (spans["_valid_to"] >= days["service_date"])))
    first = there.groupBy(F.col(key).alias("_k"), F.col("service_date").alias("_d")).agg(F.min("_nth").alias("_first"))
    best = first.join(ranked.select(f"_{key}", "_nth", "_x"), (F.col("_k") == F.col(f"_{key}")) & (F.col("_first") == F.col("_nth"))).select("_k", "_d", "_x")
    both = journeys.join(best, journeys[key].eqNullSafe(best["_k"]) & journeys["service_date"].eqNullSafe(best["_d"]), "left")
    return both.select(*journeys.columns, F.col("_x._attribute").alias("attribute"), F.col("_x._source_id").alias("source_id"))


def shape_offsets(calls: DataFrame) -> DataFrame:
    """(trip_id, problem): trips whose offsets along their shape are partly missing, fall, or pass the shape's length. calls: trip_id, sequence, offset, length."""
    w = W.Window.partitionBy("trip_id").orderBy("sequence")
    rows = calls.withColumn("_before", F.last("offset", ignorenulls=True).over(w.rowsBetween(W.Window.unboundedPreceding, -1)))
    agg = rows.groupBy("trip_id").agg(F.count("offset").alias("_n"), F.count("*").alias("_all"), F.bool_or(F.col("offset") < F.col("_before")).alias("_falls"), F.bool_or((F.col("offset") > F.col("length")) | (F.col("offset") < 0)).alias("_out"))
    problem = F.when((F.col("_n") > 0) & (F.col("_n") < F.col("_all")), "incomplete").when(F.col("_falls"), "falls").when(F.col("_out"), "outside")
    return agg.select("trip_id", problem.alias("problem")).filter("problem IS NOT NULL")


def build_report(relations: dict[str, DataFrame]) -> DataFrame:
    """(relation, metric, value): rows of each relation, and what is missing in those that have measures; one scan for each relation."""
    measures = {
        "location": {"without_coordinates": "longitude IS NULL", "boarding_points": "kind = 'boarding_point'"},
        "trip": {"without_headsign": "headsign IS NULL", "without_shape": "shape_id IS NULL"},
        "trip_call": {"passenger": "passenger_service", "without_time": "coalesce(scheduled_arrival, scheduled_departure, scheduled_passage) IS NULL"},
        "connection_claim": {"unresolved": "resolution_status = 'unresolved'"},
    }
    out = None
    for name, df in sorted(relations.items()):
        own = {"rows": "true"} | measures.get(name, {})
        counts = df.agg(*[F.count_if(F.expr(c)).alias(m) for m, c in own.items()])
        rows = counts.select(F.lit(name).alias("relation"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in own])).alias("x")).select("relation", "x.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def feed(relations: dict[str, DataFrame]) -> dict[str, tuple[DataFrame, list[str]]]:
    """The standard feed's files: name to rows and their order, for bundle.write_feed(). A column marked with a question mark may be left out.

    Operational calls and points stay out; a stop is a place or a boarding point that a passenger call uses, or the place of one.
    """
    passenger = relations["trip_call"].filter("passenger_service")
    used = passenger.select(F.col("boarding_point_id").alias("_u")).union(passenger.select("location_id")).dropna().distinct()
    own = relations["location"].filter("kind <> 'operational_point'")
    direct = own.join(used, F.col("location_id") == F.col("_u"), "left_semi")
    ids = direct.select(F.col("location_id").alias("_u")).union(direct.select("parent_location_id")).dropna().distinct()
    stops = own.join(ids, F.col("location_id") == F.col("_u"), "left_semi")
    renamed = lambda df, **columns: df.select(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in columns.items()])
    stop_kind = F.when(F.col("kind") == "stop_place", 1).otherwise(0)
    files = {
        "agency": (renamed(relations["agency"], agency_id="agency_id", agency_name="name"), ["agency_id"]),
        "routes": (renamed(relations["route"], route_id="route_id", agency_id="agency_id", route_type="gtfs_route_type"), ["route_id"]),
        "trips": (relations["trip"].select("route_id", "service_id", "trip_id", F.col("headsign").alias("trip_headsign?"), F.col("direction").alias("direction_id?"), F.col("shape_id").alias("shape_id?")), ["trip_id"]),
        "stops": (stops.select(F.col("location_id").alias("stop_id"), F.col("name").alias("stop_name"), F.col("latitude").alias("stop_lat"), F.col("longitude").alias("stop_lon"), stop_kind.alias("location_type"), F.col("parent_location_id").alias("parent_station?")), ["stop_id"]),
        "stop_times": (stop_times(relations["trip_call"]), ["trip_id", "stop_sequence"]),
        "calendar": (calendar_rows(relations["service_calendar"]), ["service_id"]),
        "calendar_dates": (calendar_dates(relations["service_exception"]), ["service_id", "date"]),
        "shapes": (relations["shape_point"].select("shape_id", F.col("latitude").alias("shape_pt_lat"), F.col("longitude").alias("shape_pt_lon"), F.col("sequence").alias("shape_pt_sequence"), F.col("distance_traveled").alias("shape_dist_traveled?")), ["shape_id", "shape_pt_sequence"]),
    }
    return {f"{name}.txt": x for name, x in files.items()}


def extensions(relations: dict[str, DataFrame]) -> dict[str, tuple[DataFrame, list[str]]]:
    """Files beside the feed: routes with their source's mode, trips with the sources' ids, and zones by the feed's numbers of calls."""
    numbered = relations["trip_call"].filter("passenger_service").select("trip_id", "sequence", F.row_number().over(W.Window.partitionBy("trip_id").orderBy("sequence")).alias("stop_sequence"))
    zones = relations["call_zone"].join(numbered, ["trip_id", "sequence"]).select("trip_id", "stop_sequence", "fare_system_id", "zone_id").distinct()
    ids = relations["source_trip_map"].groupBy("trip_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "source_id", "trip_namespace", "source_trip_id"))), "|").alias("source_trip_ids"))
    return {
        "cz_routes.txt": (relations["route"].select("route_id", F.col("mode").alias("source_mode")), ["route_id"]),
        "cz_trips.txt": (relations["trip"].select("trip_id").join(ids, "trip_id"), ["trip_id"]),
        "cz_trip_stop_zones.txt": (zones, ["trip_id", "stop_sequence", "fare_system_id", "zone_id"]),
    }
