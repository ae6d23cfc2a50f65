"""Sorted files written by many tasks: each writes a group of rows whose place is known, and the groups are joined as they are.

A group holds so many rows, counted from the first one in the order of the keys, whatever the partitions of the input were. So the
same rows give the same bytes at any parallelism, provided the keys tell rows apart. Groups are named when they are whole, and a task that runs again
writes the same name with the same bytes. Joining copies row groups or bytes without reading rows.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import numbered

#: Rows of a group.
GROUP = 65_536


def write_groups(rows: DataFrame, keys: list[str], folder: str, encode: Callable[[str, list[pa.RecordBatch], int], None], size: int = GROUP) -> tuple[list[str], int]:
    """Writes rows in the order of keys as files of ``size`` rows; their paths in order, at least one, and the number of rows.

    encode gets a path, the batches of a group and its number. A task holds one group. Rows of a single group are sorted by one task.
    """
    os.makedirs(folder)
    total = rows.count()
    groups = max(1, -(-total // size))
    columns = rows.columns
    placed = rows.withColumn("_rank", F.lit(0).cast("long")) if groups == 1 else numbered(rows, keys)
    placed = placed.repartitionById(groups, F.expr(f"CAST(_rank div {size} AS INT)")).sortWithinPartitions("_rank", *keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            group = held[0].column(len(columns))[0].as_py() // size
            part = f"{folder}/{uuid.uuid4().hex}.part"
            encode(part, [b.select(columns) for b in held], group)
            os.replace(part, f"{folder}/{group:08d}")
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([sum(b.num_rows for b in held)], pa.int64())], names=["part", "n"])

    told = {r["part"]: r["n"] for r in placed.select(*columns, "_rank").mapInArrow(run, "part long, n long").collect()}
    if not told:
        encode(f"{folder}/{0:08d}", [], 0)
    paths = [f"{folder}/{g:08d}" for g in sorted(told) or [0]]
    if sum(told.values()) != total:
        raise ValueError(f"{sum(told.values())} of {total} rows were written")
    return paths, total


def append_bytes(parts: list[str], out: BinaryIO) -> None:
    """Adds the parts to a file, one after another; each goes once it is added."""
    for part in parts:
        with open(part, "rb") as f:
            shutil.copyfileobj(f, out, 1 << 20)
        os.remove(part)


def join_bytes(parts: list[str], path: str) -> None:
    with open(path, "wb") as out:
        append_bytes(parts, out)


def join_parquet(spark: SparkSession, parts: list[str], path: str) -> None:
    """One Parquet file of the parts' row groups, copied as they are, with the first part's schema and marks."""
    if len(parts) == 1:
        shutil.copyfile(parts[0], path)
        return
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.parquet.hadoop
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    file = lambda p: jvm.org.apache.hadoop.fs.Path(f"file://{p}")
    source = lambda p: hadoop.util.HadoopInputFile.fromPath(file(p), conf)
    reader = hadoop.ParquetFileReader.open(source(parts[0]))
    try:
        known = reader.getFooter().getFileMetaData()
        schema, marks = known.getSchema(), known.getKeyValueMetaData()
    finally:
        reader.close()
    # rows groups keep their sizes; the figures are the writer's defaults
    writer = hadoop.ParquetFileWriter(hadoop.util.HadoopOutputFile.fromPath(file(path), conf), schema, getattr(jvm, "org.apache.parquet.hadoop.ParquetFileWriter$Mode").OVERWRITE, 128 << 20, 0)
    writer.start()
    for part in parts:
        writer.appendFile(source(part))
    writer.end(marks)
    crc = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
    if os.path.exists(crc):
        os.remove(crc)


def write_sorted(rows: DataFrame, keys: list[str], path: str, encode: Callable[[str, list[pa.RecordBatch], int], None], join: Callable[[SparkSession, list[str], str], None], size: int = GROUP) -> int:
    """One file of all rows in the order of keys, which takes its name when it is whole; the number of rows."""
    folder = f"{path}.{uuid.uuid4().hex}.parts"
    try:
        parts, n = write_groups(rows, keys, folder, encode, size)
        whole = f"{folder}/whole"
        join(rows.sparkSession, parts, whole)
        os.replace(whole, path)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    return n


def write_parquet(rows: DataFrame, keys: list[str], path: str, schema: pa.Schema, size: int = GROUP) -> int:
    """One Parquet file with a row group of each ``size`` rows and schema's fields and marks; the number of rows.

    A task writes as many whole row groups as GROUP rows fill, so small ones don't make tasks and files many.
    """

    def encode(target: str, batches: list[pa.RecordBatch], group: int) -> None:
        table = pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, schema=schema) for b in batches], schema)
        pq.write_table(table.combine_chunks(), target, compression="snappy", row_group_size=size)

    return write_sorted(rows, keys, path, encode, join_parquet, size * max(1, GROUP // size))
