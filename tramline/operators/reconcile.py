"""Reconciliation of sources: first occurrences, conflicts, set differences, tolerances and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def first_occurrence(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given total order."""
    w = W.Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def message_order(path: Column, is_change: Column) -> list[Column]:
    """Annual messages by path, then changes by their month's folder (two parts), cancellations first, then path."""
    parts = F.split(path, "/")
    month = F.when(is_change, F.array_join(F.slice(parts, 1, 2), "/"))
    kind = F.when(is_change, F.when(F.lower(path).contains("cancel"), 0).otherwise(1))
    return [is_change.cast("int"), month.asc_nulls_first(), kind.asc_nulls_first(), path]


def conflicting(rows: DataFrame, identity: list[str], content: str) -> DataFrame:
    """(identity, contents): identities with more than one different content."""
    return rows.groupBy(*identity).agg(F.count_distinct(content).alias("contents")).filter("contents > 1")


def unique_value(rows: DataFrame, key: str, *values: str) -> DataFrame:
    """Keys with exactly one different combination of values, and that combination."""
    v = F.struct(*values)
    agg = rows.groupBy(key).agg(F.min(v).alias("_low"), F.max(v).alias("_high"))
    return agg.filter(F.col("_low") == F.col("_high")).select(key, *[F.col(f"_low.{x}").alias(x) for x in values])


def beyond_tolerance(rows: DataFrame, authority: DataFrame, key: str, columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Rows without an authority, or that differ from it by more than the tolerance in any column; why says which."""
    a = authority.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = rows.join(a, rows[key] == F.col("_key"), "left")
    off = F.lit(False)
    for c in columns:
        off |= F.coalesce(F.abs(F.col(c) - F.col(f"_{c}")) > tolerance, F.lit(True))
    why = F.when(F.col("_key").isNull(), "missing").when(off, "mismatch")
    return joined.withColumn("why", why).filter("why IS NOT NULL").select(*rows.columns, "why")


def set_differences(pairs: dict[str, tuple[DataFrame, DataFrame]], key: str, examples: int = 20) -> DataFrame:
    """(difference, n, examples): for each named pair the different keys of the left that the right lacks, the first few as examples."""
    out = None
    for name, (left, right) in pairs.items():
        missing = left.select(F.col(key).cast("string").alias("k")).dropna().distinct().join(right.select(F.col(key).cast("string").alias("k")).dropna(), "k", "left_anti")
        total = missing.agg(F.count("*").alias("n")).withColumn("difference", F.lit(name))
        first = missing.orderBy("k").limit(examples).agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("examples")).withColumn("difference", F.lit(name))
        row = total.join(first, "difference").select("difference", "n", "examples")
        out = row if out is None else out.unionByName(row)
    return out


def missing_keys(required: DataFrame, present: DataFrame, key: list[str]) -> DataFrame:
    """Different required keys that aren't there; nulls are required of no one."""
    return required.select(*key).dropna().distinct().join(present.select(*key), key, "left_anti")


def hierarchy_violations(stops: DataFrame) -> DataFrame:
    """Stops whose parent doesn't exist or has another name."""
    parent = stops.select(F.col("stop_id").alias("_id"), F.col("stop_name").alias("_name"))
    joined = stops.filter("parent_station IS NOT NULL").join(parent, F.col("parent_station") == F.col("_id"), "left")
    why = F.when(F.col("_id").isNull(), "no parent").when(~F.col("_name").eqNullSafe(F.col("stop_name")), "other name")
    return joined.withColumn("why", why).filter("why IS NOT NULL").select("stop_id", "parent_station", "why")


def coordinate_status(lon: Column, lat: Column) -> Column:
    """invalid (not a number, infinite, out of range), zero (a warning only), missing or fine."""
    fine = ~F.isnan(lon) & ~F.isnan(lat) & lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    return F.when(lon.isNull() | lat.isNull(), "missing").when(~fine, "invalid").when((lon == 0) & (lat == 0), "zero").otherwise("fine")


def case_duplicates(rows: DataFrame, name: str) -> DataFrame:
    """(folded, n): names that are equal but for case. Folding goes by upper case and back, which also unites sharp s and ss."""
    folded = F.lower(F.upper(F.col(name)))
    return rows.groupBy(folded.alias("folded")).agg(F.count("*").alias("n")).filter("n > 1")


def unsafe_paths(rows: DataFrame, path: str) -> DataFrame:
    """Paths that are absolute, name a drive or step upwards."""
    p = F.regexp_replace(F.col(path), r"\\", "/")
    return rows.filter(p.rlike(r"^(?:[A-Za-z]:|/)") | p.rlike(r"(?:^|/)\.\.(?:/|\z)") | (p == ""))


def prefixed_union(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """All sources' rows with the key behind the source's name, so that none collide."""
    out = None
    for name, df in sources.items():
        rows = df.withColumn(key, F.concat(F.lit(f"{name}/"), F.col(key).cast("string")))
        out = rows if out is None else out.unionByName(rows)
    return out


def retained(builds: DataFrame, publications: DataFrame, retain: int = 3) -> DataFrame:
    """(build_id, state, keep): of active and retired builds the newest by activation, those published and the active ones stay."""
    live = builds.filter("state IN ('active', 'retired')")
    newest = live.orderBy(F.desc_nulls_first("activated_at"), F.desc("build_id")).limit(retain).select(F.col("build_id").alias("_n"))
    published = publications.select(F.col("active_build_id").alias("_p")).distinct()
    kept = newest.select(F.col("_n").alias("_k")).union(published).distinct()
    return live.join(kept, F.col("build_id") == F.col("_k"), "left").select("build_id", "state", (F.col("_k").isNotNull() | (F.col("state") == "active")).alias("keep"))


def queue_order(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """Queued jobs as they are taken: priority descending, then age, then id."""
    out = jobs.filter("state = 'queued'").orderBy(F.desc("priority"), "created_at", "job_id")
    return out.limit(limit) if limit else out


def folded_states(events: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """(key, state, events): the last state of each key's event log."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias(state), F.count("*").alias("events"))


def most_in_flight(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, most): the largest number of spans open at once; a span's end closes before others start at the same time."""
    steps = spans.select(key, F.col(start).alias("t"), F.lit(1).alias("d")).unionByName(spans.filter(F.col(end).isNotNull()).select(key, F.col(end).alias("t"), F.lit(-1).alias("d")))
    w = W.Window.partitionBy(key).orderBy("t", "d").rowsBetween(W.Window.unboundedPreceding, 0)
    return steps.withColumn("n", F.sum("d").over(w)).groupBy(key).agg(F.max("n").alias("most"))


def next_attempts(events: DataFrame, key: str, attempt: str) -> DataFrame:
    """(key, attempt): the number that the next attempt of each key has: one more than the greatest so far, null numbers being none; 1 where there is none."""
    return events.groupBy(key).agg((F.coalesce(F.max(attempt), F.lit(0)) + 1).alias("attempt"))


def problems(events: DataFrame, category: list[str], example: str, shown: int = 20) -> DataFrame:
    """(category, n, examples): counts, and the first so many different examples."""
    w = W.Window.partitionBy(*category).orderBy(example)
    few = events.select(*category, example).distinct().withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= shown)
    examples = few.groupBy(*category).agg(F.array_join(F.array_sort(F.collect_list(F.col(example).cast("string"))), ",").alias("examples"))
    return events.groupBy(*category).agg(F.count("*").alias("n")).join(examples, category)


def prefix_collisions(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """(folded, n): keys of prefixed_union() that are equal but for case; a source that repeats a key has them too."""
    return case_duplicates(prefixed_union(sources, key), key)


def source_counts(rows: DataFrame, source: str, content: Column) -> DataFrame:
    """(source, n, bytes): rows and bytes of each source, null being one."""
    return rows.groupBy(source).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(content)), F.lit(0)).alias("bytes"))


def with_numbers(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows with text columns as numbers; a filled one that is no number is an error, as in a stop's coordinates."""
    number = lambda c: F.when(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull(), F.raise_error(F.concat(F.lit(f"{c} is no number: "), F.col(c))).cast("double")).otherwise(F.col(c).try_cast("double"))
    return rows.withColumns({c: number(c) for c in columns})


def overlapping(left: Column, right: Column) -> Column:
    """Whether two arrays share an element; null or empty ones share none."""
    return F.coalesce(F.arrays_overlap(F.array_compact(left), F.array_compact(right)), F.lit(False))


def exists(rows: DataFrame) -> bool:
    """Whether there is any row; the scan ends with the first."""
    return bool(rows.limit(1).count())
