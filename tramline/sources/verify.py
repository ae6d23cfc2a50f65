"""Verification of a finished bundle: its files, its diagnostics, and its feed as DataFrames."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.export import without_disposition
from ..operators.reconcile import beyond_tolerance, coordinate_status, exists, hierarchy_violations, missing_keys, set_differences, with_numbers
from .bundle import BundleError
from .package import file_sha256
from .readers import csv_rows

# Fixed names of a bundle's folders, and of the extensions with the columns that refer to the feed.
FEED, EXTENSIONS = "gtfs-intermediate", "extensions"
EXTENSION_FILES = {"cz_routes.txt": ["route_id"], "cz_trips.txt": ["trip_id"], "cz_trip_stop_zones.txt": ["trip_id", "stop_sequence"]}
STOP_COLUMNS = ["stop_id", "stop_name", "stop_lat", "stop_lon", "location_type", "parent_station"]


def _need(fine: bool, message: str) -> None:
    if not fine:
        raise BundleError(message)


def check_files(root: str | os.PathLike, required: Iterable[str] = ()) -> dict[str, Any]:
    """The manifest, if every file it lists is there with its size and digest, and all required ones are listed."""
    base = Path(root)
    manifest = json.loads((base / "manifest.json").read_text(encoding="utf-8"))
    listed = set()
    for entry in manifest.get("files", []):
        path = base / entry["path"]
        listed.add(entry["path"])
        _need(path.is_file(), f"{entry['path']} is missing")
        _need(path.stat().st_size == entry["bytes"] and file_sha256(path) == entry["sha256"], f"{entry['path']} isn't what the manifest says")
    _need(set(required) <= listed, f"the manifest lacks {sorted(set(required) - listed)}")
    return manifest


def check_diagnostics(diagnostics: Mapping[str, Any]) -> None:
    bad = [d for d in diagnostics.get("diagnostics", []) if str(d.get("severity", "")).lower() == "error"]
    _need(not bad, f"{len(bad)} diagnostics are errors, the first {bad[:1]}")


def feed_table(spark: SparkSession, root: str | os.PathLike, name: str, columns: list[str]) -> DataFrame:
    path = Path(root) / name
    _need(path.is_file(), f"{name} is missing")
    header = path.open(encoding="utf-8-sig").readline().strip().split(",")
    _need(set(columns) <= set(header), f"{name} lacks {sorted(set(columns) - set(header))}")
    return csv_rows(spark, str(path), header).select(*columns)


def check_stops(stops: DataFrame, stop_times: DataFrame) -> list[str]:
    """Stops and the calls of them agree both ways, parents are there, and coordinates are numbers in their range; the stops at 0,0, which are a warning only.

    stops: stop_id, stop_lat, stop_lon, location_type, parent_station, as text; stop_times: stop_id.
    """
    blank = F.coalesce(F.trim("stop_id"), F.lit("")) == ""
    _need(not exists(stop_times.filter(blank)), "a stop time has no stop")
    _need(not exists(stops.filter(blank)) and not exists(stops.groupBy("stop_id").count().filter("count > 1")), "a stop_id is blank or repeated")
    points = with_numbers(stops, "stop_lat", "stop_lon").withColumn("status", coordinate_status(F.col("stop_lon"), F.col("stop_lat")))
    _need(not exists(points.filter("status IN ('invalid', 'missing')")), "a stop's coordinates are out of range")
    boarding = stops.filter("coalesce(location_type, '') <> '1'").select("stop_id")
    stations = stops.filter("location_type = '1'").select("stop_id")
    parents = stops.filter("coalesce(parent_station, '') <> ''").select(F.col("parent_station").alias("stop_id"))
    found = set_differences({"dangling": (stop_times, stops), "unreferenced": (boarding, stop_times), "missing parents": (parents, stops), "extra stations": (stations, parents)}, "stop_id").filter("n > 0").collect()
    _need(not found, f"stops and calls differ: {[(r['difference'], r['n'], r['examples']) for r in found]}")
    return [r["stop_id"] for r in points.filter("status = 'zero'").select("stop_id").orderBy("stop_id").limit(20).collect()]


def check_hierarchy(stops: DataFrame, authority: DataFrame | None = None) -> None:
    """Children have a parent of their name; stops whose code the authority (code, lon, lat) knows lie where it says. stops: code beside the feed's columns."""
    bad = hierarchy_violations(stops.withColumn("parent_station", F.nullif("parent_station", F.lit("")))).limit(1).collect()
    _need(not bad, f"a stop's parent is missing or of another name: {bad}")
    if authority is not None:
        own = with_numbers(stops.filter("code IS NOT NULL"), "stop_lat", "stop_lon").select("stop_id", "code", F.col("stop_lon").alias("lon"), F.col("stop_lat").alias("lat"))
        off = beyond_tolerance(own.join(authority.select("code"), "code", "left_semi"), authority, "code", ["lon", "lat"]).limit(1).collect()
        _need(not off, f"a stop lies elsewhere than its authority says: {off}")


def check_extensions(spark: SparkSession, root: str | os.PathLike) -> None:
    """Extensions are all there, none in the feed's folder, and refer to routes, trips and calls of the feed."""
    feed, more = Path(root) / FEED, Path(root) / EXTENSIONS
    _need(more.is_dir(), "there are no extensions")
    _need(not (leaked := [n for n in EXTENSION_FILES if (feed / n).exists()]), f"extensions are in the feed: {leaked}")
    _need(not (gone := [n for n in EXTENSION_FILES if not (more / n).is_file()]), f"extensions are missing: {gone}")
    targets = {"cz_routes.txt": "routes.txt", "cz_trips.txt": "trips.txt", "cz_trip_stop_zones.txt": "stop_times.txt"}
    for name, key in EXTENSION_FILES.items():
        own = feed_table(spark, more, name, key).na.fill("")
        bad = missing_keys(own, feed_table(spark, feed, targets[name], key), key).limit(1).collect()
        _need(not bad, f"{name} refers to {bad}, which {targets[name]} lacks")


def check_foreign(spark: SparkSession, unresolved: Iterable[str], dispositions: Mapping[str, Any], domestic: str) -> None:
    """Every foreign point without a coordinate has a text that says why it may stay."""
    points = spark.createDataFrame([(p, False) for p in unresolved], "point_id string, resolved boolean")
    told = spark.createDataFrame([(k, v) for k, v in dispositions.items() if isinstance(v, str)], "point_id string, disposition string")
    missing = [r["point_id"] for r in without_disposition(points, told, domestic).orderBy("point_id").limit(20).collect()]
    _need(not missing, f"foreign points lack a coordinate or a disposition: {missing}")


def verify_bundle(spark: SparkSession, root: str | os.PathLike, required: Iterable[str] = ()) -> dict[str, Any]:
    """The manifest and the stops at 0,0 of a bundle whose files, diagnostics, trips, stops and extensions are as they must be."""
    base = Path(root)
    manifest = check_files(base, required)
    check_diagnostics(json.loads((base / "diagnostics.json").read_text(encoding="utf-8")))
    _need(exists(feed_table(spark, base / FEED, "trips.txt", ["trip_id"])), "the feed has no trips")
    zero = check_stops(feed_table(spark, base / FEED, "stops.txt", STOP_COLUMNS), feed_table(spark, base / FEED, "stop_times.txt", ["stop_id"]))
    check_hierarchy(feed_table(spark, base / FEED, "stops.txt", STOP_COLUMNS))
    if (base / EXTENSIONS).exists():
        check_extensions(spark, base)
    return manifest | {"zero_stops": zero}
