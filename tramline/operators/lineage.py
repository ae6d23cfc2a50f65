"""Cuts of lineage for plans that iterate."""

from __future__ import annotations

import tempfile
import uuid
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W


def shared_folder(spark: SparkSession) -> None:
    """Sets the checkpoint folder: the session's spark.checkpoint.dir, or a temporary one in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tramline-checkpoint-")
    sc.setCheckpointDir(folder)
    # what was cut goes once nothing refers to it
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and returns it without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder as Parquet: smaller than what cut() writes, and of wide rows only the columns that are asked for are read. It stays there."""
    shared_folder(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, keys: list[str], name: str = "_rank") -> DataFrame:
    """rows with their number in the order of keys, from 0, without sorting in one task: ranges are numbered side by side, from where those before them end.

    What the ranges hold is written, so that they stay as they are; their sizes, one number a range, go through the driver. Rows of equal keys are numbered in
    any order.
    """
    held = cut(rows.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    sizes = {r["_range"]: r["count"] for r in held.groupBy("_range").count().collect()}
    ends = dict(zip(sorted(sizes), accumulate(sizes[k] for k in sorted(sizes))))
    starts = held.sparkSession.createDataFrame([(k, ends[k] - sizes[k]) for k in ends] or [(0, 0)], "_range int, _start long")
    within = F.row_number().over(W.Window.partitionBy("_range").orderBy(*keys)) - 1
    return held.withColumn(name, within).join(F.broadcast(starts), "_range").withColumn(name, F.col(name) + F.col("_start")).drop("_range", "_start")
