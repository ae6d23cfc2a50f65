"""What the operators of this folder share: lineage cuts, bounded broadcasts, Arrow passes, global ranks."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows, and bytes of texts and lists, that a pass hands to its step at once, whatever the batches' size.
SLICE, SLICE_BYTES = 1_024, 4 << 20
#: Rows a side may have to be broadcast; the side is counted first, and salted joins take over beyond it.
BROADCAST_ROWS = 200_000
#: Rows of one key that a split join gives to one task.
SPLIT_ROWS = 20_000


def shared_folder(spark: SparkSession) -> None:
    """Sets the checkpoint folder: the session's spark.checkpoint.dir, or a temporary one in local mode only."""
    sc: SparkContext = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tramline-checkpoint-")
    sc.setCheckpointDir(folder)
    # what was cut holds whole texts: Spark deletes it once no DataFrame refers to it
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and returns it without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles and checkpoints that nothing refers to any more: it does so once the driver's collector has run."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's rows and bytes in an Arrow batch to what a worker holds easily: with long texts the defaults are too much."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", SLICE), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 * SLICE_BYTES)):
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most SLICE rows, and of about SLICE_BYTES of texts and lists unless one row has more."""
    sizes = np.zeros(batch.num_rows, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(column.type):
            sizes += 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    at = 0
    for k, before in enumerate((np.cumsum(sizes) - sizes).tolist()):
        if k == at:
            start = before
        elif k - at >= SLICE or before + int(sizes[k]) - start > SLICE_BYTES:
            yield batch.slice(at, k - at)
            at, start = k, before
    if at < batch.num_rows:
        yield batch.slice(at)


def give_back() -> None:
    """Hands a worker's free memory to the system: workers wait for other tasks with what they have."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def arrow_pass(df: DataFrame, step: Callable[[pa.RecordBatch], dict], schema: T.StructType | str) -> DataFrame:
    """A narrow pass: step gives the columns of schema (lists or arrays) for each slice of a batch; rows may grow or shrink."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            out = step(batch)
            columns = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, f.type) for f, x in zip(arrow, (out[f.name] for f in arrow))]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)
            del out, columns
        give_back()

    return df.mapInArrow(run, kind)


def texts(column: pa.Array) -> list[str]:
    """Null reads as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def unused(name: str, *columns: list[str]) -> str:
    """The name, or with underscores before it, so that no column has it."""
    taken = {c.lower() for cs in columns for c in cs}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def join_bounded(big: DataFrame, small: DataFrame, key: str, spread: Column, how: str = "left", rows: int = BROADCAST_ROWS, salts: int = 32) -> DataFrame:
    """Joins small, with one row for each key, to big, of which one key may hold any share of the rows.

    small is counted; up to ``rows`` rows it is broadcast. Beyond that big's rows are dealt over
    ``salts`` parts of their key by ``spread``, and small is repeated once for each part, so no
    task gets all rows of a key. A null key matches a null key.
    """
    own, part, other = (unused(n, big.columns, small.columns) for n in ("small_key", "part", "small_part"))
    small = small.withColumnRenamed(key, own)
    if small.count() <= rows:
        return big.join(F.broadcast(small), big[key].eqNullSafe(small[own]), how).drop(own)
    big = big.withColumn(part, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    small = small.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = (big[part] == small[other]) & big[key].eqNullSafe(small[own])
    return big.join(small, on, how).drop(part, other, own)


def hot_keys(rows: DataFrame, key: str, least: int = SPLIT_ROWS) -> DataFrame:
    """(key, parts) of the keys with more than ``least`` rows: a key in so many rows at most. Written, as joins read it several times."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > least)
    return cut(counts.select(key, F.ceil(F.col("n") / least).cast("int").alias("parts")))


def split_join(left: DataFrame, key: str, right: DataFrame, right_key: str, spread: Column, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """Joins right, with one row for each key, to left, of which one key may hold any share of the rows.

    The row of a hot key (of hot_keys(), by default left's) is repeated once for each of its parts, over which
    left's rows are dealt by ``spread``. The columns of both but right_key have different names. Null keys match nothing.
    """
    hot = hot_keys(left, key) if hot is None else hot
    on = left[key] == right[right_key]
    if not hot.limit(1).count():
        return left.join(right, on, how).drop(right[right_key])
    parts, at, to = (unused(n, left.columns, right.columns) for n in ("parts", "split_at", "split_to"))
    marked = hot.toDF("hot_key", parts)
    dealt = join_bounded(left, marked.withColumnRenamed("hot_key", key), key, spread)
    dealt = dealt.withColumn(at, F.coalesce(F.pmod(F.xxhash64(spread), F.col(parts)), F.lit(0)).cast("int")).drop(parts)
    again = join_bounded(right, marked.withColumnRenamed("hot_key", right_key), right_key, F.col(right_key))
    again = again.withColumn(to, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1))).drop(parts)
    return dealt.join(again, (dealt[key] == again[right_key]) & (dealt[at] == again[to]), how).drop(again[right_key]).drop(at, to)


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Adds a 1-based rank over all rows without sorting them in one task.

    The rows are dealt by range and written; the parts' sizes, one number a part, give each part's offset.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes, before, offsets = {r["_part"]: r["n"] for r in parts.groupBy("_part").agg(F.count("*").alias("n")).collect()}, 0, []
    for part in sorted(sizes):
        offsets.append((part, before))
        before += sizes[part]
    shift = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_p int, _before long")
    inner = F.row_number().over(W.Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn(name, inner).join(F.broadcast(shift), F.col("_part") == F.col("_p")).withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_p", "_before")
