"""Mixing sources to target weights: copies of documents so that each source gives its share of the words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import window as W

from .common import cut, global_rank, join_bounded, unused

#: A document's size is its number of these.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Words the mix takes for each word there is, and the most copies of a word.
SHARE, MOST = 1.5, 2.0
SEED = "mix-1"
#: u has 13 hexadecimal digits of an MD5: exact in a double, and the same in any SQL engine.
DIGITS = 13


def size_of(text: Column) -> Column:
    """Words of the text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, text: Column, nth: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) fixed by the seed, the id, the text and which of the rows with these it is."""
    parts = [F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit(""))), nth.cast("string")]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def repetitions(docs: DataFrame, name: str) -> DataFrame:
    """docs with the number, from 1, of each row among those of its id, source and text.

    Few rows repeat: only these are written, numbered in parts side by side, and each part goes on from where those before it end. So rows that
    are all alike are numbered without meeting in one task. Which of equal rows has which number doesn't matter.
    """
    key, many, part, at, before = (unused(n, docs.columns) for n in ("row_key", "row_count", "row_part", "row_at", "row_before"))
    own = docs.withColumn(key, F.struct("doc_id", "source", F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("digest")))
    again = cut(own.groupBy(key).agg(F.count("*").alias(many)).filter(F.col(many) > 1))
    if not again.limit(1).count():
        return own.withColumn(name, F.lit(1).cast("long")).drop(key)
    told = join_bounded(own, again, key, F.monotonically_increasing_id())
    once = told.filter(F.col(many).isNull()).withColumn(name, F.lit(1).cast("long"))
    held = cut(told.filter(F.col(many).isNotNull()).withColumn(part, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 16))))
    counts = held.groupBy(key, part).agg(F.count("*").alias("n"))
    goes_on = W.Window.partitionBy(key).orderBy(part).rowsBetween(W.Window.unboundedPreceding, -1)
    starts = counts.select(F.struct(key, part).alias(at), F.coalesce(F.sum("n").over(goes_on), F.lit(0)).alias(before))
    inner = F.row_number().over(W.Window.partitionBy(key, part).orderBy(part))
    placed = join_bounded(held.withColumn(name, inner).withColumn(at, F.struct(key, part)), cut(starts), at, F.col(part))
    placed = placed.withColumn(name, F.col(name) + F.col(before))
    return once.select(*docs.columns, name).unionByName(placed.select(*docs.columns, name))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources in code-point order, null last, have the weights in turn. A target is
    min(most * source_size, level * weight); the level that spends share * all sizes is found by
    closing, round after round, the sources whose bound is reached: each round is one
    distributed aggregate with one row as its result, so the number of sources has no bound.
    """
    ranked = global_rank(sizes, F.col("source").asc_nulls_last(), name="_rank")
    cases = F.array(*[F.lit(w) for w in weights])
    ranked = cut(ranked.withColumn("weight", F.element_at(cases, F.pmod(F.col("_rank") - 1, F.lit(len(weights))).cast("int") + 1)).withColumn("bound", F.lit(most) * F.col("source_size")))
    level, closed_before = None, -1
    while True:
        closed = F.lit(False) if level is None else F.col("bound") <= F.lit(level) * F.col("weight")
        row = ranked.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(closed, F.col("source_size")).otherwise(0)).alias("closed_size"),
            F.sum(F.when(closed, 0).otherwise(F.col("weight"))).alias("weight"),
            F.sum(closed.cast("int")).alias("closed"),
        ).first()
        if row["all"] is None or not row["weight"] or row["closed"] == closed_before:
            break
        closed_before = row["closed"]
        level = (share * row["all"] - most * row["closed_size"]) / row["weight"]
    target = F.least(F.col("bound"), F.lit(float(level or 0.0)) * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def rates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for (doc_id, text, source).

    copies is floor(rate) and one more where u, fixed by the seed, the id, the text and the row's number among equal ones, is
    under the fraction of rate = target / source_size.

    Null text: size 0. Null source: a source of its own, the last. A source without words has target
    0 and no copies. Rows of equal or null ids, and repeated rows, draw each for itself. Empty table: no rows.
    """
    seeded = repetitions(docs.select("doc_id", "source", "text"), "_nth")
    rows = seeded.select("doc_id", "source", size_of(F.col("text")).alias("size"), uniform(F.col("doc_id"), F.col("text"), F.col("_nth")).alias("_u"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    out = join_bounded(rows, source_targets(sizes, **options), "source", F.struct("doc_id", "size", "_u"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = whole + F.when(F.col("_u") < rate - whole, 1).otherwise(0)
    return out.withColumn("copies", copies.cast("int")).drop("_u")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document ``copies`` times, columns as before. Cases: as in rates()."""
    sizes = docs.select("source", size_of(docs["text"]).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    found = source_targets(sizes, **options)
    rate, copy, nth = (unused(n, docs.columns) for n in ("mix_rate", "mix_copy", "mix_nth"))
    found = found.select("source", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias(rate))
    numbered = repetitions(docs, nth)
    out = join_bounded(numbered, found, "source", F.xxhash64("doc_id", nth))
    whole = F.floor(rate)
    copies = (whole + F.when(uniform(F.col("doc_id"), F.col("text"), F.col(nth)) < F.col(rate) - whole, 1).otherwise(0)).cast("int")
    again = F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>")))
    return out.withColumn(copy, again).select(*[out[c] for c in docs.columns])


def op7_mixing(docs: DataFrame) -> DataFrame:
    return rates(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


SQL = rf"""
WITH sizes AS (
  SELECT doc_id, source, md5(coalesce(text, '')) || ':' || row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) AS own, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighed AS (
  SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight, sum(source_size) OVER () AS everything FROM sources),
steps AS (
  SELECT *, 2.0::DOUBLE * source_size AS bound,
         sum(source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST) AS closed_size,
         sum(weight) OVER () - sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST) AS open_weight FROM weighed),
levels AS (
  SELECT (1.5::DOUBLE * everything) / sum(weight) OVER () AS level, -1.0 AS reach FROM weighed
  UNION ALL
  SELECT (1.5::DOUBLE * everything - 2.0::DOUBLE * closed_size) / open_weight, bound / weight FROM steps WHERE open_weight > 0),
-- levels rise with each source that closes; the one that holds is the largest
lev AS (SELECT max(level) AS level FROM levels),
targets AS (SELECT source, source_size, least(bound, level * weight) AS target FROM steps, lev),
rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || d.own), 1, {DIGITS}) AS BIGINT) AS DOUBLE) / {float(16**DIGITS):.1f}::DOUBLE AS u
  FROM sizes d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated
"""
