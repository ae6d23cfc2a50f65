"""Realtime claims: freshness, arbitration, deduplication and inference, as batch functions and as streams over them.

The watermark delays and window sizes are this engine's own choice. Watermarks only bound
the state: late claims are kept and flagged.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.streaming import DataStreamWriter

#: How long state waits for late events.
WATERMARK = "1 hour"


def freshness(claims: DataFrame, max_age_seconds: int) -> DataFrame:
    """claims with age_seconds and eligible: received at most so long after the event, and before valid_until if there is one."""
    age = F.unix_micros("received_time") / 1e6 - F.unix_micros("event_time") / 1e6
    rows = claims.withColumn("age_seconds", age)
    live = F.col("age_seconds") <= max_age_seconds
    return rows.withColumn("eligible", (live & (F.col("valid_until").isNull() | (F.col("received_time") <= F.col("valid_until")))) if "valid_until" in claims.columns else live)


def arbitrate(claims: DataFrame, key: list[str]) -> DataFrame:
    """One claim for each key and capability: eligible ones only, then by priority, then the latest event, then the claim's id. Values are never averaged."""
    w = W.Window.partitionBy(*key, "capability").orderBy(F.desc("priority"), F.desc("event_time"), "claim_id")
    return claims.filter("eligible").withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def losers(claims: DataFrame, key: list[str]) -> DataFrame:
    """All other claims, with the reason: they are stored too."""
    won = arbitrate(claims, key).select("claim_id")
    return claims.join(won, "claim_id", "left_anti").withColumn("reason", F.when(F.col("eligible"), "outranked").otherwise("stale"))


def delay_bounds(minutes: Column) -> Column:
    """A delay in whole minutes as closed bounds in seconds; zero proves nothing, and null stays null."""
    fine = minutes.isNotNull() & (minutes != 0)
    low = F.when(minutes > 0, minutes * 60).otherwise(minutes * 60 - 59)
    return F.when(fine, F.struct(low.cast("int").alias("lower"), (low + 59).cast("int").alias("upper"), F.lit(60).alias("granularity")))


def deduplicated(claims: DataFrame, identity: list[str], order: list[Column]) -> DataFrame:
    w = W.Window.partitionBy(*identity).orderBy(*order)
    return claims.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def downsampled(observations: DataFrame, key: str, width: str = "1 hour") -> DataFrame:
    """(key, window_start, n, last_value): tumbling windows."""
    return observations.groupBy(key, F.window("event_time", width).alias("_w")).agg(F.count("*").alias("n"), F.max_by("value", F.struct("event_time", "claim_id")).alias("last_value")).select(key, F.col("_w.start").alias("window_start"), "n", "last_value")


def as_of(observations: DataFrame, schedule: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Observations with the value of the last schedule row of their key at or before their time.

    Both sides go into one window by key, so neither is broadcast nor joined by range. Of schedule rows of one time the greatest value counts.
    """
    left = observations.withColumn("_value", F.lit(None).cast(schedule.schema[value].dataType)).withColumn("_side", F.lit(1))
    right = schedule.select(key, time, F.col(value).alias("_value")).withColumn("_side", F.lit(0))
    w = W.Window.partitionBy(key).orderBy(time, "_side", "_value").rowsBetween(W.Window.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True)
    return both.withColumn(value, F.last("_value", ignorenulls=True).over(w)).filter("_side = 1").drop("_value", "_side")


def crossings(positions: DataFrame, key: str, at: str) -> DataFrame:
    """(key, event_time of the crossing in seconds): where ``distance`` passes ``at`` between two observations, on the line between them."""
    w = W.Window.partitionBy(key).orderBy("seconds")
    rows = positions.withColumn("_d", F.lag("distance").over(w)).withColumn("_s", F.lag("seconds").over(w)).filter((F.col("_d") < F.col(at)) & (F.col("distance") >= F.col(at)))
    cross = F.col("_s") + (F.col("seconds") - F.col("_s")) * (F.col(at) - F.col("_d")) / (F.col("distance") - F.col("_d"))
    return rows.select(key, at, cross.alias("crossed_seconds"))


def stop_events(positions: DataFrame, stops: DataFrame, key: str, radius: float = 30.0, dwell_seconds: float = 10.0) -> DataFrame:
    """(key, stop_id, arrival, departure, passage): what two observations before, at and behind a stop tell, in seconds.

    positions: key, seconds, distance along the way; stops: key, stop_id, at. A vehicle arrives where it comes within the radius and
    departs where it leaves it, each on the line between two observations. With less time between than the dwell it only passes, at the
    crossing of the stop itself; before it has left, it has arrived only.
    """
    w = W.Window.partitionBy(key).orderBy("seconds")
    ways = positions.select(key, "seconds", "distance", F.lag("seconds").over(w).alias("_s"), F.lag("distance").over(w).alias("_d")).filter("_d < distance")
    marks = stops.select(key, "stop_id", F.explode(F.map_from_arrays(F.array(F.lit("in"), F.lit("at"), F.lit("out")), F.array(F.col("at") - radius, F.col("at").cast("double"), F.col("at") + radius))).alias("mark", "place"))
    met = ways.join(marks, key).filter("_d < place AND distance >= place")
    at = F.col("_s") + (F.col("seconds") - F.col("_s")) * (F.col("place") - F.col("_d")) / (F.col("distance") - F.col("_d"))
    each = met.withColumn("t", at).groupBy(key, "stop_id").agg(*[F.min(F.when(F.col("mark") == m, F.col("t"))).alias(f"_{m}") for m in ("in", "at", "out")])
    passes = F.col("_out") - F.col("_in") < dwell_seconds
    return each.select(key, "stop_id", F.when(~F.coalesce(passes, F.lit(False)), F.col("_in")).alias("arrival"), F.when(~F.coalesce(passes, F.lit(False)), F.col("_out")).alias("departure"), F.when(passes, F.col("_at")).alias("passage"))


def write_observations(observations: DataFrame, path: str) -> None:
    """Appends observations in one folder for each day of their event, so that a day is read or dropped alone."""
    observations.withColumn("date", F.to_date("event_time")).repartition("date", F.pmod(F.xxhash64("claim_id"), F.lit(16))).write.mode("append").partitionBy("date").parquet(path)


class Epochs:
    """Which build each micro-batch was resolved against: a file a batch beside the query's checkpoint, in whatever store it is.

    A batch's build is written before the batch is resolved. A batch that runs again after a failure keeps it, whatever is active by
    then; so no batch mixes two builds, and results don't depend on when a query was started again.
    """

    def __init__(self, spark: SparkSession, checkpoint: str):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._folder = f"{checkpoint}/builds"

    def _path(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(self._folder, name)
        return path.getFileSystem(self._conf), path

    def of(self, batch: int) -> int | None:
        store, path = self._path(str(batch))
        if not store.exists(path):
            return None
        file = store.open(path)
        try:
            return file.readLong()
        finally:
            file.close()

    def begin(self, batch: int, active: Callable[[], int]) -> int:
        """The batch's build: the one it had, or else the active one, which takes its name in one rename."""
        known = self.of(batch)
        if known is not None:
            return known
        build = int(active())
        store, part = self._path(f".{batch}-{uuid.uuid4().hex}")
        file = store.create(part)
        file.writeLong(build)
        file.close()
        if not store.rename(part, self._path(str(batch))[1]):
            raise RuntimeError(f"batch {batch} has a build already")
        return build


def resolution_stream(observations: DataFrame, resolve: Callable[[DataFrame, int], DataFrame], active: Callable[[], int], sink: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Micro-batches of observations, each resolved against one build's relations, told by build_id.

    active tells the build that is shown now; it is asked once for each new batch, so a running query goes over to a new build between
    batches. resolve gets a batch and its build.
    """
    epochs = Epochs(observations.sparkSession, checkpoint)

    def run(batch: DataFrame, number: int) -> None:
        build = epochs.begin(number, active)
        sink(resolve(batch, build).withColumn("build_id", F.lit(build)), number)

    return observations.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def same_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts without those of equal normalised text, period and scope: the first id stays, with the number of copies."""
    text = F.trim(F.regexp_replace(F.lower("text"), r"[\s\p{Punct}]+", " "))
    return alerts.groupBy(text.alias("normal_text"), "period_start", "period_end", "scope").agg(F.min("alert_id").alias("alert_id"), F.count("*").alias("copies"))


def platform(infrastructure: Column, operator: Column, previous: Column, scheduled: Column) -> Column:
    """The first known platform, with its origin."""
    names = ("infrastructure", "operator", "previous", "scheduled")
    parts = [F.when(c.isNotNull(), F.struct(c.cast("string").alias("platform"), F.lit(n).alias("origin"))) for c, n in zip((infrastructure, operator, previous, scheduled), names)]
    return F.coalesce(*parts, F.struct(F.lit(None).cast("string").alias("platform"), F.lit("unspecified").alias("origin")))


def boxed(points: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    return points.filter(F.col("longitude").between(west, east) & F.col("latitude").between(south, north))


def arbitration_stream(claims: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Micro-batches of claims for a sink that arbitrates with what it has; event_time has a watermark, but no claim is dropped."""
    return claims.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def deduplicated_stream(claims: DataFrame, identity: list[str], delay: str = WATERMARK) -> DataFrame:
    return claims.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(identity)


def downsampled_stream(observations: DataFrame, key: str, width: str = "1 hour", delay: str = WATERMARK) -> DataFrame:
    return downsampled(observations.withWatermark("event_time", delay), key, width)
