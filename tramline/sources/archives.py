"""Archives read by many tasks: their directories are planned first, and members are dealt by bytes.

A plan has a row for each member: where its archive lies, where it begins in it and how long it is. Tasks seek to their members, so
an archive of any size is read by as many tasks as it fills, each with one member in memory. Archives within archives are
unpacked side by side into the shared folder, in parts of bounded size, and are the archives of the next level.
"""

from __future__ import annotations

import os
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut, shared_folder
from .readers import opened

#: Bytes of members that a task reads, as they are packed.
TASK_BYTES = 32 << 20
#: Bytes that are read and unpacked at once.
PIECE = 1 << 20
#: Fixed: a member's local header, and the methods that are read here: stored and deflated.
LOCAL, MAGIC, STORED, DEFLATED = struct.Struct("<4s5H3L2H"), b"PK\x03\x04", 0, 8

PLAN = "archive string, at string, inner string, member string, offset long, packed long, bytes long, method int, crc long"


def _checked(name: str, entries: list[zipfile.ZipInfo]) -> None:
    folded = [i.filename.casefold() for i in entries]
    if len(set(folded)) != len(folded):
        raise ValueError(f"{name}: member names repeat but for case")
    for i in entries:
        parts = i.filename.replace("\\", "/").split("/")
        if i.filename.startswith(("/", "\\")) or ".." in parts or ":" in parts[0]:
            raise ValueError(f"{name}: unsafe member {i.filename}")
        if i.flag_bits & 1:
            raise ValueError(f"{name}: {i.filename} is encrypted")
        if i.compress_type not in (STORED, DEFLATED):
            raise ValueError(f"{name}: {i.filename} is packed by method {i.compress_type}")


def planned(archives: DataFrame) -> DataFrame:
    """A row for each member of archives (archive, at, inner): archive is the outermost one's name, at where the bytes lie, inner its name within. Only directories are read.

    Members that would leave their folder, names that differ in case only, encrypted members and other methods are errors.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive, at, inner in zip(pdf.archive, pdf["at"], pdf.inner):
                with opened(at) as file, zipfile.ZipFile(file) as z:
                    entries = sorted((i for i in z.infolist() if not i.is_dir()), key=lambda i: i.filename)
                _checked(inner or archive, entries)
                for k in range(0, len(entries), 4_096):
                    yield pd.DataFrame([(archive, at, inner, i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.CRC) for i in entries[k : k + 4_096]], columns=[c.split()[0] for c in PLAN.split(", ")])

    return archives.mapInPandas(run, PLAN)


def pieces(file: BinaryIO, row) -> Iterator[bytes]:
    """A member's bytes in parts; an error if they aren't what the directory says."""
    file.seek(row.offset)
    head = file.read(LOCAL.size)
    fields = LOCAL.unpack(head) if len(head) == LOCAL.size else (b"",)
    if fields[0] != MAGIC:
        raise ValueError(f"{row.archive}: {row.member} has no header at {row.offset}")
    file.seek(row.offset + LOCAL.size + fields[9] + fields[10])
    unpack = zlib.decompressobj(-15) if row.method == DEFLATED else None
    left, n, crc = int(row.packed), 0, 0
    while left > 0:
        data = file.read(min(PIECE, left))
        if not data:
            raise ValueError(f"{row.archive}: {row.member} is cut off")
        left -= len(data)
        while data:  # what unpacks to much more comes in parts too
            part = unpack.decompress(data, PIECE) if unpack else data
            data = unpack.unconsumed_tail if unpack else b""
            n, crc = n + len(part), zlib.crc32(part, crc)
            yield part
    if unpack:
        part = unpack.flush()
        n, crc = n + len(part), zlib.crc32(part, crc)
        yield part
    if n != row.bytes or crc != row.crc:
        raise ValueError(f"{row.archive}: {row.member} differs from its checksum")


def dealt(plan: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The plan's rows in as many partitions as their bytes fill."""
    total = plan.agg(F.sum(F.col("packed") + LOCAL.size)).first()[0] or 0
    return plan.repartition(max(1, -(-total // task_bytes)), "at", "offset")


def split_members(spark: SparkSession, path: str, suffix: str = ".xml", depth: int = 2, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(archive, member, content, bytes, sha256) of all members with the suffix; archives within archives are opened ``depth`` deep and named ``inner!member``.

    A member of 2 GB or more is an error, as a row can't hold it; archives have no such bound. Files must lie where tasks can open them: on a shared disk or
    in a store that pyarrow reaches. An archive without members gives no rows.
    """
    shared_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/archives-{uuid.uuid4().hex}"
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), F.col("path").alias("at"), F.lit("").alias("inner"))
    found = None
    for level in range(depth, 0, -1):
        plan = cut(planned(files))
        name = F.lower("member")
        own = plan.filter(F.endswith(name, F.lit(suffix.lower())) & (~F.endswith(name, F.lit(".zip")) | F.lit(level == 1)))
        found = own if found is None else found.unionByName(own)
        nested = plan.filter(F.endswith(name, F.lit(".zip")))
        if level == 1 or not nested.limit(1).count():
            break
        files = cut(_unpacked(dealt(nested, task_bytes), folder))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                with opened(row.at) as file:
                    content = b"".join(pieces(file, row))
                yield pd.DataFrame({"archive": [row.archive], "member": [f"{row.inner}!{row.member}" if row.inner else row.member], "content": [content]})

    rows = dealt(found, task_bytes).mapInPandas(run, "archive string, member string, content binary")
    return rows.withColumn("bytes", F.length("content").cast("long")).withColumn("sha256", F.sha2("content", 256))


def _unpacked(nested: DataFrame, folder: str) -> DataFrame:
    """(archive, at, inner) of inner archives, each written to the folder in parts; a task that runs again writes another file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                at = f"{folder}/{uuid.uuid4().hex}.zip"
                with opened(row.at) as file, _created(at) as out:
                    for part in pieces(file, row):
                        out.write(part)
                yield pd.DataFrame({"archive": [row.archive], "at": [at], "inner": [f"{row.inner}!{row.member}" if row.inner else row.member]})

    return nested.mapInPandas(run, "archive string, at string, inner string")


def _created(path: str) -> BinaryIO:
    """A new file where opened() finds it again."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        store, inner = fs.FileSystem.from_uri(path)
        store.create_dir(inner.rpartition("/")[0])
        return store.open_output_stream(inner)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    return open(path, "wb")
