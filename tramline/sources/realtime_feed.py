"""Captured realtime feeds in their binary form, as rows: vehicle positions, stop time updates and alerts; as tables and as streams.

Messages are parsed by the protobuf library from a descriptor that is built here, so that only their values are met in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
from google.protobuf import descriptor_pb2, descriptor_pool, message_factory
from google.protobuf.message import DecodeError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed: the public feed's messages, of each field its name, number and type; * marks repeated ones. Texts are read as bytes, as not all are UTF-8.
MESSAGES = {
    "Feed": "header 1 Header, entity 2 Entity*",
    "Header": "version 1 bytes, timestamp 3 uint64",
    "Entity": "id 1 bytes, update 3 Update, vehicle 4 Vehicle, alert 5 Alert",
    "Trip": "trip_id 1 bytes, start_date 3 bytes, route_id 5 bytes",
    "Update": "trip 1 Trip, stop 2 Stop*",
    "Stop": "stop_sequence 1 uint32, arrival 2 Event, departure 3 Event, stop_id 4 bytes",
    "Event": "delay 1 int32, time 2 int64",
    "Vehicle": "trip 1 Trip, position 2 Position, stop_sequence 3 uint32, timestamp 5 uint64, stop_id 7 bytes, vehicle 8 Identity",
    "Position": "latitude 1 float, longitude 2 float",
    "Identity": "vehicle_id 1 bytes",
    "Alert": "period 1 Period*, target 5 Target*, header 10 Texts",
    "Period": "period_start 1 uint64, period_end 2 uint64",
    "Target": "route_id 2 bytes, trip 4 Trip, stop_id 5 bytes",
    "Texts": "text 1 Text*",
    "Text": "header 1 bytes",
}
SCHEMA = (
    "path string, entity_id string, kind string, feed_timestamp long, trip_id string, route_id string, start_date string, stop_id string, stop_sequence int, vehicle_id string,"
    " latitude double, longitude double, timestamp long, arrival_delay int, arrival_time long, departure_delay int, departure_time long, header string, period_start long, period_end long"
)
#: Rows that a worker holds at once, beside one payload's message.
ROWS = 2_048
#: Names of a feed's columns that are texts.
TEXTS = frozenset(c.split()[0] for c in SCHEMA.split(", ") if c.split()[1] == "string")


@cache
def feed_class() -> type:
    """The class of a whole feed."""
    file = descriptor_pb2.FileDescriptorProto(name="tramline_feed.proto", package="tramline_feed", syntax="proto2")
    kinds = descriptor_pb2.FieldDescriptorProto
    for name, text in MESSAGES.items():
        message = file.message_type.add(name=name)
        for field in text.split(", "):
            own, number, kind = field.split()
            label = kinds.LABEL_REPEATED if kind.endswith("*") else kinds.LABEL_OPTIONAL
            kind = kind.rstrip("*")
            if kind in MESSAGES:
                message.field.add(name=own, number=int(number), label=label, type=kinds.TYPE_MESSAGE, type_name=f".tramline_feed.{kind}")
            else:
                message.field.add(name=own, number=int(number), label=label, type=getattr(kinds, f"TYPE_{kind.upper()}"))
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName("tramline_feed.Feed"))


def values(message, prefix: str = "") -> dict[str, object]:
    """The values that a message and those within it have; of repeated ones the first."""
    out: dict[str, object] = {}
    for field, value in message.ListFields():
        if field.is_repeated:
            value = value[0]
        if field.message_type is not None:
            out |= values(value, f"{field.name}_" if field.message_type.name == "Event" else "")
        else:
            out[prefix + field.name] = value.decode("utf-8", "replace") if isinstance(value, bytes) else value
    return out


def rows_of(data: bytes) -> Iterator[dict[str, object]]:
    """A row for each vehicle, each stop of a trip update, and each period of an alert; an entity or part of another kind gives none."""
    feed = feed_class().FromString(data)
    stamp = feed.header.timestamp if feed.header.HasField("timestamp") else None
    for entity in feed.entity:
        base = {"entity_id": entity.id.decode("utf-8", "replace") if entity.HasField("id") else None, "feed_timestamp": stamp}
        if entity.HasField("vehicle"):
            yield base | {"kind": "vehicle"} | values(entity.vehicle)
        if entity.HasField("update"):
            trip = values(entity.update.trip)
            for stop in entity.update.stop:
                yield base | {"kind": "stop"} | trip | values(stop)
        if entity.HasField("alert"):
            own = {k: v for k, v in values(entity.alert).items() if k in ("header", "route_id", "trip_id", "stop_id")}
            for period in entity.alert.period or [None]:
                yield base | {"kind": "alert"} | own | ({} if period is None else values(period))


def _set(message, row: dict[str, object], prefix: str = "") -> None:
    """Puts a row's values that aren't null into a message and those within it, which are there only if they have one."""
    for field in message.DESCRIPTOR.fields:
        if field.message_type is not None and not field.is_repeated:
            inner = type(getattr(message, field.name))()
            _set(inner, row, f"{field.name}_" if field.message_type.name == "Event" else "")
            if inner.ListFields():
                getattr(message, field.name).CopyFrom(inner)
        elif field.message_type is None and row.get(prefix + field.name) is not None:
            value = row[prefix + field.name]
            setattr(message, field.name, str(value).encode() if prefix + field.name in TEXTS else float(value) if field.name in ("latitude", "longitude") else int(value))


def feed_of(rows: list[dict[str, object]], timestamp: int) -> bytes:
    """A full feed of rows as rows_of() tells them: vehicles, and stops, those of an entity's id together in its trip update."""
    feed = feed_class()()
    feed.header.version, feed.header.timestamp = b"2.0", timestamp
    known: dict[str, object] = {}
    for row in rows:
        key = str(row["entity_id"])
        if row["kind"] == "vehicle" or key not in known:
            known[key] = feed.entity.add(id=key.encode())
        if row["kind"] == "vehicle":
            known[key].vehicle.SetInParent()  # there even without a value
            _set(known[key].vehicle, row)
        elif row["kind"] == "stop":
            if not known[key].HasField("update"):
                _set(known[key].update.trip, row)
            _set(known[key].update.stop.add(), row)
    return feed.SerializeToString(deterministic=True)


def row_frames(pdf: pd.DataFrame, size: int = ROWS) -> Iterator[pd.DataFrame]:
    """The rows of a batch of payloads (path, content), at most ``size`` at a time, and at least one frame."""
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    frame = lambda rows: pd.DataFrame({n: pd.array([r.get(n) for r in rows], dtype=object) for n in names})
    out = []
    for path, content in zip(pdf.path, pdf.content):
        try:
            for row in rows_of(bytes(content)):
                if len(out) == size:
                    yield frame(out)
                    out = []
                out.append({"path": path, **row})
        except (DecodeError, TypeError):
            out.append({"path": path, "kind": "broken"})
    yield frame(out)


def feed_rows(payloads: DataFrame) -> DataFrame:
    """Rows of captured payloads (path, content), a table or a stream; one that is no feed gives a row of the kind ``broken``. No entities, no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from row_frames(pdf)

    return payloads.select("path", "content").mapInPandas(run, SCHEMA)


def payload_stream(spark: SparkSession, folder: str, files: int = 1_000, delay: str = "1 hour") -> DataFrame:
    """(path, captured, content) of payloads as they are captured into a folder, a file each, so many files a micro-batch.

    Spark's file source keeps which files were read in the checkpoint: after a failure a batch is read again with the same files, and none is lost or
    read twice. A payload with the same bytes as one before it, within the delay, isn't given again, as a feed that has no news repeats itself.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    held = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files).load(folder)
    rows = held.select("path", F.col("modificationTime").alias("captured"), "content", F.sha2("content", 256).alias("_digest"))
    return rows.withWatermark("captured", delay).dropDuplicatesWithinWatermark(["_digest"]).drop("_digest")
