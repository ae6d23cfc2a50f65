"""Approximate nearest neighbours: an inverted multi-index over two vector halves."""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import arrow_pass, cut, remove, shared_folder

#: Centroids of each half; cells are their pairs.
CENTROIDS = 256
#: Vectors at most from which the centroids are fitted, those with the smallest hashes of their ids; k-means rounds.
SAMPLE, ROUNDS, SEED = 20_000, 12, 7
#: Share of the vectors that a query's cells must hold. Vectors without any cluster need about a third for a recall over 0.95; the README has figures.
SHARE = 0.35
#: Queries that are sent to all executors at once, and those and the vectors that a task multiplies at once.
BLOCK, QUERIES, SLAB = 2_048, 512, 8_192
NEAREST = 5


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the vectors that take part: not null, not zero, of finite components."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    return rows.filter(F.col("id").isNotNull() & fine)


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = distances(x, centroids).argmin(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centroids))
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] - 2 * (x @ centroids.T) + (centroids**2).sum(axis=1)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Directions; scaling by the largest component first keeps squares in range."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def traverse(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray | list[int], wanted: float) -> list[int]:
    """Cells in the order of the sum of their halves' distances until they hold the wanted number of vectors.

    The heap has one entry a row of the first half, the next cell of it; a row comes in when the first cell of the row before goes.
    """
    o1, o2 = d1.argsort(kind="stable").tolist(), d2.argsort(kind="stable").tolist()
    s1, s2, k2, held = [float(d1[k]) for k in o1], [float(d2[k]) for k in o2], len(d2), 0
    heap, out, size = [(s1[0] + s2[0], 0, 0)], [], counts.tolist() if isinstance(counts, np.ndarray) else counts
    while heap and held < wanted:
        _, i, j = heap[0]
        cell = o1[i] * k2 + o2[j]
        if size[cell]:
            out.append(cell)
            held += size[cell]
        if j + 1 < k2:
            heapq.heapreplace(heap, (s1[i] + s2[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i + 1 < len(s1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
    return out


def cosines(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Row by row, in an order of sums that doesn't depend on the rows' places, so equal vectors tie exactly."""
    q, e = q / np.abs(q).max(axis=1, keepdims=True), e / np.abs(e).max(axis=1, keepdims=True)
    return (q * e).sum(axis=1) / np.sqrt((q * q).sum(axis=1) * (e * e).sum(axis=1))


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEAREST, share: float = SHARE, centroids: int = CENTROIDS, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by cosine among what its cells hold.

    is_query is a condition on the column ``id``. All vectors that take part are indexed, sorted by cell, and the
    queries go against them in blocks: a block with its cells is sent to all executors, each part
    of the index keeps its best k for each query, and the parts' bests meet in a window.
    Vectors that are null, zero, hold null or non-finite components or have a null id take no part. A query is held against the vectors of its own
    length: each length has an index of its own. Candidates are all rows but the query's own. Equal scores
    go by id. Repeated rows are candidates each; a repeated query is answered once for each different
    vector. Empty table: no rows.
    """
    rows = usable(vectors, id_col, vector_col)
    lengths = sorted(r["n"] for r in rows.select(F.size("v").alias("n")).distinct().collect())
    found = [_nearest(rows.filter(F.size("v") == n), is_query, k, share, centroids, sample, block) for n in lengths or [0]]
    return reduce(DataFrame.unionByName, found)


def _nearest(rows: DataFrame, is_query: Column, k: int, share: float, centroids: int, sample: int, block: int) -> DataFrame:
    """nearest() of rows (id, v) of one length."""
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"query_id {kind}, vec_id {kind}, score double, own boolean, part int"
    total = rows.count()
    empty = rows.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    if not total:
        return empty
    # the sample: hashes under the share that gives about `sample` rows, and no more than twice as many
    limit = min(1.0, sample / total)
    picked = rows.filter(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 20)) < F.lit(math.ceil(limit * (1 << 20)))).limit(2 * sample).toArrow()
    if picked.num_rows == 0:
        picked = rows.limit(1).toArrow()
    x = unit(matrix(picked.sort_by("id").column("v").combine_chunks()))
    half = x.shape[1] // 2
    c1, c2 = k_means(x[:, :half], centroids), k_means(x[:, half:], centroids)

    def assign(batch: pa.RecordBatch) -> dict:
        u = unit(matrix(batch.column(1))) if batch.num_rows else np.zeros((0, x.shape[1]))
        cell = distances(u[:, :half], c1).argmin(axis=1) * len(c2) + distances(u[:, half:], c2).argmin(axis=1)
        return {"id": batch.column(0), "v": batch.column(1), "cell": cell.astype(np.int32)}

    assigned = arrow_pass(rows, assign, f"id {kind}, v array<double>, cell int")
    # by cell, and by a hash within it: a cell of many vectors is several parts
    placed = assigned.withColumn("h", F.xxhash64("id"))
    parts = max(assigned.rdd.getNumPartitions(), rows.sparkSession.sparkContext.defaultParallelism)
    index = cut(placed.repartitionByRange(parts, "cell", "h").sortWithinPartitions("cell", "h").select("id", "v", "cell"))
    counts = np.zeros(len(c1) * len(c2), dtype=np.int64)
    for r in index.groupBy("cell").count().collect():  # centroids squared at most
        counts[r["cell"]] = r["count"]

    def plan(batch: pa.RecordBatch) -> dict:
        u = unit(matrix(batch.column(1))) if batch.num_rows else np.zeros((0, x.shape[1]))
        cells, sizes = [], counts.tolist()
        for a, b in zip(distances(u[:, :half], c1), distances(u[:, half:], c2)):
            mask = np.zeros(len(counts), dtype=bool)
            mask[traverse(a, b, sizes, max(k + 1, share * total))] = True
            cells.append(np.packbits(mask).tobytes())
        return {"id": batch.column(0), "v": batch.column(1), "cells": cells}

    queries = cut(index.filter(is_query).select("id", "v").distinct())
    n = queries.count()
    blocks = max(1, math.ceil(n / block))
    shared_folder(rows.sparkSession)
    folder = f"{rows.sparkSession.sparkContext.getCheckpointDir()}/nearest-{uuid.uuid4().hex}"
    answered = False
    for b in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("id", F.lit(SEED + 1)), F.lit(blocks)) == b)
        planned = arrow_pass(own.repartition(rows.sparkSession.sparkContext.defaultParallelism), plan, f"id {kind}, v array<double>, cells binary")
        table = planned.toArrow().sort_by("id")
        if table.num_rows:  # what one block was sent goes before the next comes
            out, sent = _search(index, table, k, schema)
            out.write.mode("append").parquet(folder)
            sent.destroy()
            answered = True
    if not answered:
        return empty
    # a query id with several vectors has one answer for each; of the rows equal to the query one is its own
    order = W.Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "vec_id")
    before = F.sum(F.col("own").cast("int")).over(order.rowsBetween(W.Window.unboundedPreceding, 0))
    found = rows.sparkSession.read.schema(schema).parquet(folder)
    ranked = found.withColumn("before", before).withColumn("nth", F.row_number().over(order)).filter("NOT (own AND before = 1)")
    ranked = ranked.withColumn("rank", F.col("nth") - F.least("before", F.lit(1)).cast("int")).filter(F.col("rank") <= k)
    answers = cut(ranked.select("query_id", "rank", "vec_id", "score"))
    remove(rows.sparkSession, folder)
    return answers


def best_of(query: np.ndarray, score: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Each query's k best rows, by score and id; sorted by query."""
    o = np.lexsort((ids, -score, query))
    query, score, ids, own = query[o], score[o], ids[o], own[o]
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, dtype=np.int64)
    nth = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
    return query[nth < k], score[nth < k], ids[nth < k], own[nth < k]


def distinct_enough(ids: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """Rows without those of which k rows of the same vector have smaller ids: they score alike, so no query needs them."""
    _, kind = np.unique(e, axis=0, return_inverse=True)
    o = np.lexsort((ids, kind.ravel()))
    first = np.flatnonzero(np.r_[True, kind.ravel()[o][1:] != kind.ravel()[o][:-1]])
    nth = np.arange(len(o)) - np.repeat(first, np.diff(np.r_[first, len(o)]))
    return np.sort(o[nth < k])


def _search(index: DataFrame, table: pa.Table, k: int, schema: str) -> tuple[DataFrame, Broadcast]:
    ids = table.column("id").to_numpy()
    parts = np.zeros(len(ids), dtype=np.int32)  # tells repeated query ids apart
    for i in range(1, len(ids)):
        parts[i] = parts[i - 1] + 1 if ids[i] == ids[i - 1] else 0
    q = matrix(table.column("v").combine_chunks())
    cells = np.frombuffer(b"".join(table.column("cells").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
    sent = index.sparkSession.sparkContext.broadcast((ids, parts, q, unit(q), cells))
    keep = k + 1  # the query's own row may be among them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, q, u, cells = sent.value
        best = (np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=ids.dtype), np.zeros(0, dtype=bool))
        for batch in batches:
            for at in range(0, batch.num_rows, SLAB):
                some = batch.slice(at, SLAB)
                rows = distinct_enough(some.column(0).to_numpy(), matrix(some.column(1)), keep)
                e_ids, e, cell = some.column(0).to_numpy()[rows], matrix(some.column(1))[rows], some.column(2).to_numpy()[rows]
                order = cell.argsort(kind="stable")
                e_ids, e, cell = e_ids[order], e[order], cell[order]
                eu, first = unit(e), np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                runs = list(zip(first.tolist(), np.r_[first[1:], len(e)].tolist()))
                for lo in range(0, len(ids), QUERIES):
                    hi = min(lo + QUERIES, len(ids))
                    scores = np.full((hi - lo, len(e)), -np.inf)
                    for s, t in runs:  # only the queries that visit a cell see its vectors
                        c = int(cell[s])
                        who = np.flatnonzero(cells[lo:hi, c >> 3] & (128 >> (c & 7)))
                        if len(who):
                            scores[who, s:t] = u[lo + who] @ eu[s:t].T
                    m = min(keep, len(e))
                    least = -np.partition(-scores, m - 1, axis=1)[:, m - 1] - 1e-9
                    i, j = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
                    for z in range(0, len(i), SLAB):
                        g, r = lo + i[z : z + SLAB], j[z : z + SLAB]
                        own = (e_ids[r] == ids[g]) & (e[r] == q[g]).all(axis=1)
                        new = (g, cosines(q[g], e[r]), e_ids[r], own)
                        best = best_of(*(np.concatenate(x) for x in zip(best, new)), keep)
        g, score, near, own = best
        yield pa.RecordBatch.from_arrays([pa.array(ids[g]), pa.array(near), pa.array(score), pa.array(own), pa.array(parts[g])], names=["query_id", "vec_id", "score", "own", "part"])

    return index.mapInArrow(run, schema), sent


def op9_nearest(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings, F.col("id") % 50 == 0)
