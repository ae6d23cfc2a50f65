"""Resolution of foreign identifiers through dated mappings, for whole sets of observations at once.

An observation resolves if exactly one different value fits, is ambiguous if several do, and is
unmatched otherwise. The mapping is reduced to what the observations' keys can reach by an equi-join; dates and
contexts are conditions of that join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Context columns of a trip mapping in which a null fits every observation. The start is not among them: there a null fits none.
CONTEXT = ("scheduled_end", "source_route_id", "source_direction_id", "source_start_location_id", "source_end_location_id", "source_block_id", "source_run_id", "source_duty_id", "call_pattern_sha256")


def _on(observed: DataFrame, mapping: DataFrame, keys: list[str], extra: Column | None = None) -> Column:
    on = None
    for k in keys:
        on = (observed[k] == mapping[f"m_{k}"]) if on is None else on & (observed[k] == mapping[f"m_{k}"])
    return on if extra is None else on & extra


def _renamed(mapping: DataFrame) -> DataFrame:
    return mapping.select(*[F.col(c).alias(f"m_{c}") for c in mapping.columns])


def covers(date: Column, open_end: bool = False) -> Column:
    """Closed interval; with open_end a null end never ends."""
    end = F.col("m_valid_to") >= date
    return (F.col("m_valid_from") <= date) & ((F.col("m_valid_to").isNull() | end) if open_end else end)


def one(rows: DataFrame, observation: list[str], value: str, low: str | None = None, high: str | None = None) -> DataFrame:
    """At most one different value for each observation: (status, value). Rows may hold the least and greatest of several values instead."""
    agg = rows.groupBy(*observation).agg(F.min(low or value).alias("_low"), F.max(high or value).alias("_high"))
    status = F.when(F.col("_low").isNull(), "unmatched").when(F.col("_low") == F.col("_high"), "resolved").otherwise("ambiguous")
    return agg.select(*observation, status.alias("status"), F.when(status == "resolved", F.col("_low")).alias(value))


def source_trip(observed: DataFrame, mapping: DataFrame, observation: list[str]) -> DataFrame:
    """Foreign trips on a date: (observation columns, status, trip_id).

    observed has source_id, trip_namespace, source_trip_id, service_date and any of scheduled_start and
    CONTEXT; a context that an observation lacks or has null excludes nothing.
    """
    m = _renamed(mapping)
    extra = covers(observed["service_date"])
    if "scheduled_start" in observed.columns:
        extra &= observed["scheduled_start"].isNull() | (m["m_scheduled_start"] == observed["scheduled_start"])
    for c in CONTEXT:
        if c in observed.columns and f"m_{c}" in m.columns:
            extra &= observed[c].isNull() | m[f"m_{c}"].isNull() | (m[f"m_{c}"] == observed[c])
    joined = observed.join(m, _on(observed, m, ["source_id", "trip_namespace", "source_trip_id"], extra), "left")
    return one(joined.withColumnRenamed("m_trip_id", "trip_id") if "trip_id" not in observed.columns else joined.drop(observed["trip_id"]).withColumnRenamed("m_trip_id", "trip_id"), observation, "trip_id")


def alias(observed: DataFrame, aliases: DataFrame, observation: list[str]) -> DataFrame:
    """(observation columns, status, canonical): the observed id itself where no alias fits. Two fitting rows are ambiguous even if they agree."""
    m = _renamed(aliases)
    joined = observed.join(m, _on(observed, m, ["source_id", "namespace", "observed_id"], covers(observed["service_date"], open_end=True)), "left")
    agg = joined.groupBy(*observation, "observed_id").agg(F.count("m_canonical_value").alias("_n"), F.min("m_canonical_value").alias("_v"))
    status = F.when(F.col("_n") == 0, "unaliased").when(F.col("_n") == 1, "resolved").otherwise("ambiguous")
    return agg.select(*observation, status.alias("status"), F.when(F.col("_n") == 0, F.col("observed_id")).when(F.col("_n") == 1, F.col("_v")).alias("canonical"))


def entity(observed: DataFrame, mapping: DataFrame, observation: list[str]) -> DataFrame:
    """(observation columns, status, public_id) by the four exact keys. The mapping is brought down to a row a key first: no observation meets all rows of its key."""
    keys = ["source_id", "identifier_namespace", "entity_kind", "source_object_id"]
    m = mapping.groupBy(*[F.col(k).alias(f"m_{k}") for k in keys]).agg(F.min("public_id").alias("_least"), F.max("public_id").alias("_most"))
    return one(observed.join(m, _on(observed, m, keys), "left"), observation, "public_id", "_least", "_most")


def source_call(observed: DataFrame, trips: DataFrame, calls: DataFrame, observation: list[str]) -> DataFrame:
    """(observation columns, status, trip_id, call_sequence): first the trip, from its keys, date and start only, then the call on that trip."""
    narrow = observed.select(*observation, *[c for c in ("source_id", "trip_namespace", "source_trip_id", "call_namespace", "source_sequence", "service_date", "scheduled_start") if c in observed.columns and c not in observation])
    keys = [c for c in narrow.columns if c not in ("service_date", "scheduled_start")]
    found = source_trip(narrow, trips, keys).withColumnRenamed("status", "trip_status")
    m = _renamed(calls)
    on = _on(found, m, ["source_id", "trip_namespace", "source_trip_id", "call_namespace", "source_sequence", "trip_id"])
    joined = found.join(m, on, "left")
    agg = joined.groupBy(*observation, "trip_status", "trip_id").agg(F.min("m_call_sequence").alias("_low"), F.max("m_call_sequence").alias("_high"))
    status = F.when(F.col("trip_status") != "resolved", F.col("trip_status")).when(F.col("_low").isNull(), "unmatched").when(F.col("_low") == F.col("_high"), "resolved").otherwise("ambiguous")
    fine = status == "resolved"
    return agg.select(*observation, status.alias("status"), F.when(fine, F.col("trip_id")).alias("trip_id"), F.when(fine, F.col("_low")).alias("call_sequence"))


def _dyadic(start: Column, end: Column, levels: int) -> Column:
    """(level, node) of the fewest blocks of 2^level days that make up the closed interval of day numbers: two of a level at most."""
    nodes = []
    for k in range(levels):
        low, high = -F.shiftright(-start, k), F.shiftright(end + 1, k)  # whole blocks begin at low and end before high
        for at, odd in ((low, low), (high - 1, high)):
            nodes.append(F.when((low < high) & (odd.bitwiseAND(1) == 1), F.struct(F.lit(k).alias("level"), at.alias("node"))))
    return F.array_distinct(F.array_compact(F.array(*nodes)))


def dated(observed: DataFrame, mapping: DataFrame, keys: list[str], observation: list[str], value: str) -> DataFrame:
    """(observation columns, status, value): of the mapping's rows of equal keys those whose closed interval holds service_date.

    Intervals are cut into blocks of days, of which the least and greatest value are kept, and a date asks the blocks that it lies in, one of each
    size: so work grows with the rows of either side, whatever the number of intervals that hold a date.
    """
    m = mapping.select(*[F.col(k).alias(f"m_{k}") for k in keys], F.col(value).alias("_v"), F.unix_date("valid_from").alias("_a"), F.unix_date("valid_to").alias("_b")).filter("_a <= _b")
    longest = m.agg(F.max(F.col("_b") - F.col("_a"))).first()[0] or 0
    levels = (longest + 1).bit_length()
    known = m.select(*[f"m_{k}" for k in keys], "_v", F.explode(_dyadic(F.col("_a"), F.col("_b"), levels)).alias("_x"))
    blocks = known.groupBy(*[f"m_{k}" for k in keys], F.col("_x.level").alias("m__level"), F.col("_x.node").alias("m__node")).agg(F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    day = F.unix_date("service_date")
    within = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(day, k).alias("node")) for k in range(levels)])
    asked = observed.select(*keys, "service_date").dropna().distinct().withColumn("_x", F.explode(within)).select(*keys, "service_date", F.col("_x.level").alias("_level"), F.col("_x.node").alias("_node"))
    met = asked.join(blocks, _on(asked, blocks, [*keys, "_level", "_node"]))
    dates = [*keys, "service_date"]
    found = met.groupBy(*[F.col(k).alias(f"m_{k}") for k in dates]).agg(F.min("_least").alias("_least"), F.max("_most").alias("_most"))
    return one(observed.join(found, _on(observed, found, dates), "left"), observation, value, "_least", "_most")


def road_trip(observed: DataFrame, keys: DataFrame, observation: list[str]) -> DataFrame:
    """(observation columns, status, trip_id) by line and trip number on a date."""
    return dated(observed, keys, ["cis_line_id", "cis_trip_id"], observation, "trip_id")


def rail_trip(observed: DataFrame, keys: DataFrame, observation: list[str]) -> DataFrame:
    """(observation columns, status, trip_id) by train number on a date."""
    return dated(observed, keys, ["train_number"], observation, "trip_id")
