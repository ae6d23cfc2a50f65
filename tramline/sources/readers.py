"""Readers of source formats: delimited text, archives, XML messages and HTML listings, as DataFrames.

Files are read by Spark's readers, so paths may be in any store; archives and compressed objects
are opened from their bytes, one object a row.
"""

from __future__ import annotations

import gzip
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_rows(spark: SparkSession, path: str, columns: list[str], separator: str = ",") -> DataFrame:
    """A CSV with a header, all columns as text; a byte order mark before the header is no part of a name."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.option("header", True).option("sep", separator).option("enforceSchema", True).schema(schema).csv(path)


def reference_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """(code, lon, lat) of a headerless table of ragged rows: the code is the first field's first five characters, the last two fields are latitude and longitude.

    Rows whose numbers can't be read are skipped; a code stays only if all its rows agree.
    """
    f = F.split(F.col("value"), ",")
    rows = spark.read.text(path).filter(F.size(f) >= 3)
    parsed = rows.select(F.substring(F.trim(f[0]), 1, 5).alias("code"), F.expr("try_cast(trim(element_at(split(value, ','), -1)) AS double)").alias("lon"), F.expr("try_cast(trim(element_at(split(value, ','), -2)) AS double)").alias("lat"))
    both = parsed.dropna()
    agg = both.groupBy("code").agg(F.min(F.struct("lon", "lat")).alias("a"), F.max(F.struct("lon", "lat")).alias("b")).filter("a = b")
    return agg.select("code", "a.lon", "a.lat")


def encoded_rows(spark: SparkSession, path: str, columns: list[str], encoding: str = "windows-1250", separator: str = ";") -> DataFrame:
    """Quoted rows with CRLF ends in a legacy encoding: file and line number, then the fields as text; short rows end in nulls.

    A row ends with a semicolon in some exports; it is no field.
    """
    names = list(columns)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv

        for pdf in batches:
            out = []
            for path_, content in zip(pdf.path, pdf.content):
                text = bytes(content).decode({"windows-1250": "cp1250"}.get(encoding, encoding))
                for n, row in enumerate(csv.reader(io.StringIO(text.replace("\r\n", "\n")), delimiter=separator), 1):
                    if row:
                        row[-1] = row[-1].removesuffix(";")
                        out.append([path_, n, *(row[k] if k < len(row) else None for k in range(len(names)))])
            yield pd.DataFrame(out, columns=["file", "line", *names])

    fields = ", ".join(f"`{c}` string" for c in names)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, f"file string, line int, {fields}")


class _Stored(io.RawIOBase):
    """A file of a store, with the errors that files of a disk give."""

    def __init__(self, file):
        self._file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._file.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        at = offset + (0, self._file.tell(), self._file.size())[whence]
        if at < 0:
            raise OSError(f"{at} is before the file")
        self._file.seek(at)
        return at

    def readinto(self, into) -> int:
        data = self._file.read(len(into))
        into[: len(data)] = data
        return len(data)

    def close(self) -> None:
        self._file.close()
        super().close()


def opened(path: str):
    """A file where it lies, of the local or shared disk or of a store that pyarrow reaches."""
    if path.startswith("file:"):
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return io.BufferedReader(_Stored(store.open_input_file(inner)), 1 << 16)


def archive_members(spark: SparkSession, path: str, suffix: str = ".xml", depth: int = 2, in_place: bool = False) -> DataFrame:
    """(archive, member, content, bytes, sha256) of all members with the suffix, by name; archives within archives are opened ``depth`` deep.

    Members that would leave their folder are an error, and so are two whose names differ in case only. A row holds an archive of 2 GB at most;
    ``in_place`` reads larger ones member by member where they lie.
    """

    def members(name: str, source: io.IOBase | bytes, level: int) -> Iterator[tuple[str, bytes]]:
        with zipfile.ZipFile(io.BytesIO(source) if isinstance(source, bytes) else source) as archive:
            entries = sorted((i for i in archive.infolist() if not i.is_dir()), key=lambda i: i.filename)
            folded = [i.filename.casefold() for i in entries]
            if len(set(folded)) != len(folded):
                raise ValueError(f"{name}: member names repeat but for case")
            for i in entries:
                parts = i.filename.replace("\\", "/").split("/")
                if i.filename.startswith(("/", "\\")) or ".." in parts or ":" in parts[0]:
                    raise ValueError(f"{name}: unsafe member {i.filename}")
                if i.filename.lower().endswith(".zip") and level > 1:
                    for inner, content in members(i.filename, archive.read(i), level - 1):
                        yield f"{i.filename}!{inner}", content
                elif i.filename.lower().endswith(suffix):
                    yield i.filename, archive.read(i)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive, content in zip(pdf.path, [None] * len(pdf) if in_place else pdf.content):
                with opened(archive) if in_place else io.BytesIO(bytes(content)) as source:
                    for member, data in members(archive, source, depth):
                        yield pd.DataFrame({"archive": [archive], "member": [member], "content": [data]})

    files = spark.read.format("binaryFile").load(path)
    rows = files.select("path", *[] if in_place else ["content"]).mapInPandas(run, "archive string, member string, content binary")
    return rows.withColumn("bytes", F.length("content").cast("long")).withColumn("sha256", F.sha2("content", 256))


def gzip_objects(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): objects that are gzip whatever they are named; others are an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf.path, "content": [gzip.decompress(bytes(x)) for x in pdf.content]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, content binary")


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files, by path; for files under 2 GB, which is what a row can hold."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy("path")


#: A rail message. All text: inferred types would lose leading zeros and time zones.
MESSAGE_SCHEMA = (
    "Identifiers struct<PlannedTransportIdentifiers: array<struct<ObjectType: string, Company: string, Core: string, Variant: string, TimetableYear: string>>>,"
    " CZPTTInformation struct<PlannedCalendar: struct<BitmapDays: string, ValidityPeriod: struct<StartDateTime: string, EndDateTime: string>>,"
    " CZPTTLocation: array<struct<Location: struct<CountryCodeISO: string, LocationPrimaryCode: string, PrimaryLocationName: string>,"
    " TimingAtLocation: struct<Timing: array<struct<_TimingQualifierCode: string, Time: string, Offset: string>>>,"
    " TrainType: string, OperationalTrainNumber: string, TrainActivity: array<struct<TrainActivityType: string>>>>>"
)


def without_namespaces(xml: Column) -> Column:
    """Element names without their prefixes, and no namespace declarations."""
    plain = F.regexp_replace(xml, r"""\sxmlns(?::[\w.-]+)?\s*=\s*("[^"]*"|'[^']*')""", "")
    # possessive: a name without a prefix isn't tried again letter by letter
    return F.regexp_replace(plain, r"(</?)[\w.-]++:", "$1")


def messages(rows: DataFrame, content: str = "content") -> DataFrame:
    """rows with root (the element's name) and message, parsed by the fixed schema."""
    xml = without_namespaces(F.decode(F.col(content), "UTF-8") if rows.schema[content].dataType == T.BinaryType() else F.col(content))
    root = F.regexp_extract(xml, r"(?s)^(?:\s|<\?.*?\?>|<!--.*?-->)*<([\w.-]+)", 1)
    return rows.withColumn("root", root).withColumn("message", F.from_xml(xml, MESSAGE_SCHEMA))


# Fixed names of the elements that are a whole message: a timetable, and the cancellation of days of one.
TIMETABLE, CANCELLATION = "CZPTTCISMessage", "CZCanceledPTTMessage"
#: A cancellation: the train's identifiers and the days.
CANCELLATION_SCHEMA = (
    "PlannedTransportIdentifiers array<struct<ObjectType: string, Company: string, Core: string, Variant: string, TimetableYear: string>>,"
    " PlannedCalendar struct<BitmapDays: string, ValidityPeriod: struct<StartDateTime: string, EndDateTime: string>>"
)


def changes(rows: DataFrame, content: str = "content") -> DataFrame:
    """(path, trip, service_date, ord, cancels) of timetables and cancellations, one row for each day that a message names: what apply_messages() reads.

    rows: path, ord, content. trip is the train's identity but for its variant's kind: the message's sorted identifiers. A message
    of another root is an error, and so is one without a full identity.
    """
    xml = without_namespaces(F.decode(F.col(content), "UTF-8") if rows.schema[content].dataType == T.BinaryType() else F.col(content))
    root = F.regexp_extract(xml, r"(?s)^(?:\s|<\?.*?\?>|<!--.*?-->)*<([\w.-]+)", 1)
    known = F.when(root.isin(TIMETABLE, CANCELLATION), root).otherwise(F.raise_error(F.concat(F.lit("unknown message "), root, F.lit(" in "), F.col("path"))).cast("string"))
    both = rows.select("path", "ord", known.alias("root"), F.from_xml(xml, MESSAGE_SCHEMA).alias("_m"), F.from_xml(xml, CANCELLATION_SCHEMA).alias("_c"))
    cancels = F.col("root") == CANCELLATION
    ids = F.when(cancels, F.col("_c.PlannedTransportIdentifiers")).otherwise(F.col("_m.Identifiers.PlannedTransportIdentifiers"))
    full = F.filter(ids, lambda i: F.concat(*[i[k] for k in IDENTIFIER]).isNotNull())
    calendar = F.when(cancels, F.col("_c.PlannedCalendar")).otherwise(F.col("_m.CZPTTInformation.PlannedCalendar"))
    named = F.when(F.coalesce(F.size(full), F.lit(0)) > 0, message_identity(full)).otherwise(F.raise_error(F.concat(F.lit("no full identity in "), F.col("path"))).cast("string"))
    days = both.select("path", named.alias("trip"), "ord", cancels.alias("cancels"), calendar["BitmapDays"].alias("_bits"), F.substring(calendar["ValidityPeriod"]["StartDateTime"], 1, 10).cast("date").alias("_start"))
    # by an outer explode, which reads a message once, as in message_calls()
    bits = F.posexplode_outer(F.split(F.col("_bits"), "(?<=.)(?=.)"))
    return days.select("path", "trip", "ord", "cancels", "_start", bits.alias("_at", "_bit")).filter("_bit = '1'").select("path", "trip", F.date_add("_start", F.col("_at")).alias("service_date"), "ord", "cancels")


#: Fixed parts of an identifier, in their order.
IDENTIFIER = ("ObjectType", "Company", "Core", "Variant", "TimetableYear")


def message_identity(identifiers: Column) -> Column:
    """All identifiers as sorted tuples, so that their order in the message doesn't matter."""
    one = lambda i: F.concat_ws("/", *[F.coalesce(i[k], F.lit("")) for k in IDENTIFIER])
    return F.array_join(F.array_sort(F.transform(identifiers, one)), "|")


def message_calls(parsed: DataFrame) -> DataFrame:
    """(path, sequence, country, code, name, arrival, departure, passage, activities, train_number) of messages, in seconds of the service day.

    Sequences go in tens. A point without the passenger activity 0001 that only departs is one of passage: an
    interpretation, as the message has no passage of its own.
    """
    from ..operators.derive import local_seconds

    # by an outer explode: of another Spark infers filters on the array, which read a message once more each
    x = parsed.select("path", F.posexplode_outer("message.CZPTTInformation.CZPTTLocation").alias("n", "l")).filter("n IS NOT NULL")
    timing = lambda code: F.get(F.filter("l.TimingAtLocation.Timing", lambda t: t["_TimingQualifierCode"] == code), F.lit(0))
    # each timing is looked for once
    x = x.select("path", "n", "l", timing("ALA").alias("_ta"), timing("ALD").alias("_td"))
    seconds = lambda t: F.when(F.col(t).isNotNull(), local_seconds(F.col(f"{t}.Time"), F.coalesce(f"{t}.Offset", F.lit("0"))))
    acts = F.coalesce(F.transform("l.TrainActivity", lambda a: a["TrainActivityType"]), F.array().cast("array<string>"))
    stops = F.array_contains(acts, "0001")
    rows = x.select("path", ((F.col("n") + 1) * 10).alias("sequence"), F.col("l.Location.CountryCodeISO").alias("country"), F.col("l.Location.LocationPrimaryCode").alias("code"), F.col("l.Location.PrimaryLocationName").alias("name"), seconds("_ta").alias("_a"), seconds("_td").alias("_d"), stops.alias("passenger_service"), F.array_join(acts, ",").alias("activities"), F.col("l.OperationalTrainNumber").alias("train_number"))
    return rows.select("path", "sequence", "country", "code", "name", "passenger_service", F.when(F.col("passenger_service"), F.col("_a")).alias("scheduled_arrival"), F.when(F.col("passenger_service"), F.col("_d")).alias("scheduled_departure"), F.when(~F.col("passenger_service"), F.coalesce("_a", "_d")).alias("scheduled_passage"), "activities", "train_number")


def listing_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with links: the different targets of anchors, sorted; quoted either way or not at all."""
    found = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""), F.lit(0))
    value = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"""(?is)^.*?href\s*=\s*""", ""), r"""^["']|["']$""", ""))
    return pages.withColumn("links", F.array_sort(F.array_distinct(value)))


def listing_names(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with names: the last parts of the links' targets, sorted, each once; of a listing without any link the last words of its lines."""
    last = lambda x: F.element_at(F.split(F.regexp_replace(x, r"/+\z", ""), "/"), -1)
    rows = listing_links(pages, html)
    lines = F.filter(F.split(F.coalesce(F.col(html), F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x) != "")
    words = F.transform(lines, lambda x: F.regexp_extract(x, r"(\S+)\s*\z", 1))
    plain = lambda x: F.replace(F.replace(x, F.lit("&amp;"), F.lit("&")), F.lit("&#39;"), F.lit("'"))
    names = F.transform(F.when(F.size("links") > 0, F.transform("links", plain)).otherwise(words), last)
    return rows.withColumn("names", F.array_sort(F.array_distinct(F.filter(names, lambda x: ~x.isin("", ".", "..")))))


def stop_identity(stop_id: Column) -> Column:
    """A stop id's parts: kind, country and code, with percent escapes decoded and plus signs kept; the parent is the id without its last part."""
    parts = F.transform(F.split(stop_id, ":"), lambda p: F.url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))))
    return F.struct(parts.alias("parts"), F.array_join(F.slice(F.split(stop_id, ":"), 1, F.greatest(F.size(F.split(stop_id, ":")) - 1, F.lit(1))), ":").alias("parent"))


def log_events(lines: DataFrame, column: str, prefix: str, schema: str) -> DataFrame:
    """Log lines with text (without terminal colours), severity, and event: the JSON behind the prefix, null where there is none or it can't be read."""
    text = F.regexp_replace(F.col(column), "\x1b\\[[0-9;]*m", "")
    severity = F.lower(F.regexp_extract(text, r"(?i)\b(error|warning|warn|info)\b", 1))
    rows = lines.withColumn("text", text).withColumn("severity", F.when(severity == "warn", "warning").when(severity != "", severity))
    return rows.withColumn("event", F.when(F.col("text").startswith(prefix), F.from_json(F.expr(f"substring(text, {len(prefix) + 1})"), schema)))


def errors_of(events: DataFrame) -> DataFrame:
    """Events or diagnostics of the severity that stops a build."""
    return events.filter(F.lower("severity") == "error")


def json_payloads(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Captured payloads (text or bytes) with ``payload`` by a schema, and ``broken``: what can't be read is kept and told."""
    text = F.decode(F.col(column), "UTF-8") if rows.schema[column].dataType == T.BinaryType() else F.col(column)
    parsed = F.from_json(text, f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    return rows.withColumn("payload", parsed).withColumn("broken", F.col("payload").isNull() | F.col("payload._corrupt").isNotNull()).withColumn("payload", F.col("payload").dropFields("_corrupt"))


def tagged_nodes(nodes: DataFrame, tags: dict[str, list[str]]) -> DataFrame:
    """Nodes of a map extract (id, lon, lat, tags) that have any of the values of any of the keys."""
    fits = F.lit(False)
    for key, values in tags.items():
        fits |= F.coalesce(F.element_at("tags", key).isin(values), F.lit(False))
    return nodes.filter(fits)


#: Fixed tags of railway points and of surface stops.
RAILWAY_TAGS = {"railway": ["station", "halt", "stop"]}
TRANSIT_TAGS = {"highway": ["bus_stop"], "public_transport": ["platform", "pole", "station"], "railway": ["tram_stop"], "amenity": ["bus_station"]}


def merged_nodes(*extracts: DataFrame) -> DataFrame:
    """One row for each element and version of all extracts."""
    out = extracts[0]
    for e in extracts[1:]:
        out = out.unionByName(e)
    return out.dropDuplicates(["type", "id", "version"])
