"""Hard-negative mining: branch and bound over ball trees, one or more in each partition.

Vectors become whole numbers, so that scores are exact. Each partition's rows are built into trees of balls once,
and these are written. Anchors go to all trees in blocks of bounded size. A ball bounds the inner products of its rows with
an anchor from both sides, |a·x - a·centre| <= |a| radius, and from their labels it is known whether any row can
count. A ball goes if no score within it can lie in the window asked for, or if all are strictly below the k-th
that the task has found; ties must be looked at, as ids decide them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import bounded_batches, cut, remove, shared_folder

#: Rows of a tree and of a leaf at most.
TREE, LEAF = 4_096, 64
#: Anchors that are sent to all executors at once; bytes of the blocks of scores that a task holds.
BLOCK, CELLS = 2_048, 1 << 22
#: Components become floor(SCALE * x).
SCALE = 256
#: Squared lengths from which on scores, times 100, could leave a long: such rows take no part.
LONGEST = 2.0**55
#: Squared lengths below which sums of products are exact in doubles.
EXACT = 2.0**52

TREES = "dim int, ids binary, labels binary, vectors binary, nodes binary, centres binary"


def usable(vectors: DataFrame, id_col: str, label: Column, vector_col: str) -> DataFrame:
    """(id, label, v, dim): rows that take part, v of whole numbers as doubles."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    # a component beyond 2^40 is too long by itself, and is kept from overflowing the cast
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(F.greatest(F.least(x, F.lit(2.0**40)), F.lit(-(2.0**40))) * F.lit(float(SCALE))).cast("double")))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    return rows.filter(length < LONGEST).withColumn("dim", F.size("v"))


@dataclass
class Tree:
    """Rows in the order of the leaves; nodes (first row, end, right child or 0, least label, greatest label, radius), the left child follows its parent."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    nodes: np.ndarray
    centres: np.ndarray


def build(ids: np.ndarray, labels: np.ndarray, v: np.ndarray, leaf: int = LEAF) -> Tree:
    """Balls are halved between two rows that lie far apart; equal rows stay in one leaf of any size."""
    order = np.arange(len(ids))
    nodes: list[list[float]] = []
    centres: list[np.ndarray] = []
    todo = [(0, len(ids), -1)]
    while todo:
        a, b, parent = todo.pop()
        if parent >= 0:
            nodes[parent][2] = len(nodes)
        own = v[order[a:b]]
        centre = own.mean(axis=0)
        far = ((own - centre) ** 2).sum(axis=1)
        mine = labels[order[a:b]]
        nodes.append([a, b, 0, mine.min(), mine.max(), np.sqrt(far.max()) * (1 + 1e-9) + 1e-9])
        centres.append(centre)
        if b - a <= leaf or not far.max():
            continue
        one = own[far.argmax()]
        other = own[((own - one) ** 2).sum(axis=1).argmax()]
        side = own @ (other - one)
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argsort(side, kind="stable")]
        todo += [(a + half, b, len(nodes) - 1), (a, a + half, -1)]  # the left half comes next
    return Tree(ids[order], labels[order], v[order], np.array(nodes), np.array(centres))


def trees(rows: DataFrame, size: int = TREE, leaf: int = LEAF) -> DataFrame:
    """One row a tree, of at most ``size`` rows of one length of one partition; written to the shared folder."""
    bounded_batches(rows.sparkSession)

    def packed(dim: int, held: list[tuple]) -> dict:
        ids, labels, v = (np.concatenate(x) for x in zip(*held))
        t = build(ids, labels, v.reshape(len(ids), dim), leaf)
        return {"dim": dim, "ids": t.ids.astype("<i8").tobytes(), "labels": t.labels.astype("<i8").tobytes(), "vectors": t.v.astype("<f8").tobytes(), "nodes": t.nodes.astype("<f8").tobytes(), "centres": t.centres.astype("<f8").tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            ids, labels, dims = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            start = np.cumsum(dims) - dims
            for dim in np.unique(dims).tolist():
                of = np.flatnonzero(dims == dim)
                for at in range(0, len(of), size):
                    some = of[at : at + size]
                    if counts.get(dim, 0) + len(some) > size:
                        yield pa.RecordBatch.from_pylist([packed(dim, held.pop(dim))], schema=schema)
                        counts[dim] = 0
                    held.setdefault(dim, []).append((ids[some], labels[some], flat[(start[some][:, None] + np.arange(dim)).ravel()].reshape(len(some), dim)))
                    counts[dim] = counts.get(dim, 0) + len(some)
        for dim, own in held.items():
            yield pa.RecordBatch.from_pylist([packed(dim, own)], schema=schema)

    schema = pa.schema([("dim", pa.int32()), *[(n, pa.binary()) for n in ("ids", "labels", "vectors", "nodes", "centres")]])
    return cut(rows.select("id", "label", "v", "dim").mapInArrow(run, TREES))


def unpacked(r: dict) -> Tree:
    ids = np.frombuffer(r["ids"], "<i8")
    nodes = np.frombuffer(r["nodes"], "<f8").reshape(-1, 6)
    return Tree(ids, np.frombuffer(r["labels"], "<i8"), np.frombuffer(r["vectors"], "<f8").reshape(len(ids), r["dim"]), nodes, np.frombuffer(r["centres"], "<f8").reshape(len(nodes), r["dim"]))


@dataclass
class Asked:
    """What one block asks, a row each: anchor's number, id, label and vector, and the window of scores times 100 (closed)."""

    number: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool  # rows of the anchor's own label count, else those of the others
    k: int

    def __post_init__(self) -> None:
        self.length = np.sqrt((self.q**2).sum(axis=1))
        self.exact = not len(self.q) or float((self.q**2).sum(axis=1).max()) < EXACT


class Best:
    """The k best rows of each question that a task has found: by score, ties by id."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.zeros((n, k), dtype=np.int64), np.zeros((n, k), dtype=np.int64)
        self.found = np.zeros(n, dtype=np.int64)
        self.worst = np.full(n, -(1 << 62))  # the k-th score once there are k

    def take(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Candidates one by one, with the number of their question."""
        few = np.unique(who)
        held = np.repeat(few, self.found[few])
        nth = np.arange(len(held)) - np.repeat(np.cumsum(self.found[few]) - self.found[few], self.found[few])
        who = np.concatenate([held, who])
        score = np.concatenate([self.score[held, nth], score])
        ids = np.concatenate([self.id[held, nth], ids])
        order = np.lexsort((ids, -score, who))
        who, score, ids = who[order], score[order], ids[order]
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        nth = np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)]))
        kept = nth < self.k
        self.score[who[kept], nth[kept]], self.id[who[kept], nth[kept]] = score[kept], ids[kept]
        self.found[few] = np.minimum(np.diff(np.r_[first, len(who)]), self.k)
        full = few[self.found[few] == self.k]
        self.worst[full] = self.score[full, self.k - 1]


def search(tree: Tree, asked: Asked, best: Best, seen: Callable[[int, int], None] | None = None) -> None:
    """Goes down from the root with all questions that a ball can answer; seen is told each leaf's rows and questions.

    Of two halves the one goes first whose centre is nearer to most questions, so that the k-th rises early.
    """
    slack = 1e-9
    exact = asked.exact and float((tree.v**2).sum(axis=1).max(initial=0.0)) < EXACT
    todo = [(0, np.arange(len(asked.ids)))]
    while todo:
        node, who = todo.pop()
        a, b, right, least, most, radius = tree.nodes[node]
        labels = asked.labels[who]
        who = who[(labels >= least) & (labels <= most)] if asked.same else who[(labels != least) | (labels != most)]
        middle, reach = asked.q[who] @ tree.centres[node], asked.length[who] * radius
        reach = reach + slack * (np.abs(middle) + reach + 1)
        fits = (100 * (middle + reach) >= asked.low[who]) & (100 * (middle - reach) <= asked.high[who]) & (middle + reach >= best.worst[who])
        who = who[fits]
        if not len(who):
            continue
        if right:
            left = node + 1
            if np.median(asked.q[who] @ (tree.centres[int(right)] - tree.centres[left])) > 0:
                todo += [(left, who), (int(right), who)]
            else:
                todo += [(int(right), who), (left, who)]
            continue
        rows = slice(int(a), int(b))
        if seen:
            seen(int(b - a), len(who))
        step = max(1, CELLS // max(1, int(b - a)))
        for at in range(0, len(who), step):
            some = who[at : at + step]
            if exact:
                score = (asked.q[some] @ tree.v[rows].T).astype(np.int64)
            else:
                score = asked.q[some].astype(np.int64) @ tree.v[rows].astype(np.int64).T
            counts = (asked.labels[some][:, None] == tree.labels[rows]) == asked.same
            counts &= asked.ids[some][:, None] != tree.ids[rows]
            counts &= (100 * score >= asked.low[some][:, None]) & (100 * score <= asked.high[some][:, None]) & (score >= best.worst[some][:, None])
            i, j = np.nonzero(counts)
            if len(i):
                best.take(some[i], score[i, j], tree.ids[rows][j])


def answers(forest: DataFrame, sent: Broadcast, k: int) -> DataFrame:
    """(asked, id, score): for each question the k best rows of each task; of them the k best are the answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim: dict[int, tuple[Asked, Best]] = {dim: (a, Best(len(a.ids), k)) for dim, a in sent.value.items()}
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(c)[r].as_py() for c, n in enumerate(batch.schema.names)}
                if row["dim"] in by_dim:
                    search(unpacked(row), *by_dim[row["dim"]])
        for asked, best in by_dim.values():
            who = np.repeat(np.arange(len(asked.ids)), best.found)
            nth = np.arange(len(who)) - np.repeat(np.cumsum(best.found) - best.found, best.found)
            for at in range(0, len(who), 65_536):
                w, n = who[at : at + 65_536], nth[at : at + 65_536]
                yield pa.RecordBatch.from_arrays([pa.array(asked.number[w]), pa.array(best.id[w, n]), pa.array(best.score[w, n])], names=["asked", "id", "score"])

    found = forest.mapInArrow(run, "asked long, id long, score long")
    order = W.Window.partitionBy("asked").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _questions(table: pa.Table, low: np.ndarray, high: np.ndarray, same: bool, k: int, of: np.ndarray | None = None) -> dict[int, Asked]:
    """The block's anchors, or those whose numbers ``of`` has, by the length of their vectors."""
    of = np.arange(table.num_rows) if of is None else of
    dims = table.column("dim").to_numpy()[of]
    ids, labels = table.column("id").to_numpy()[of], table.column("label").to_numpy()[of]
    vectors = table.column("v").to_pylist()
    out = {}
    for dim in np.unique(dims).tolist():
        own = np.flatnonzero(dims == dim)
        q = np.array([vectors[i] for i in of[own].tolist()], dtype=np.float64).reshape(len(own), dim)
        out[dim] = Asked(own.astype(np.int64), ids[own], labels[own], q, low[own], high[own], same, k)
    return out


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label: Column | None = None, vector_col: str = "embedding", positives: int = 5, negatives: int = 5, percent: int = 80, block: int = BLOCK, size: int = TREE, leaf: int = LEAF) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its best ``positives`` rows of its label, the best rows of other labels.

    A negative's score is from ``percent`` of the positive's up to it. is_anchor is a condition on the column ``id``. Ids are whole numbers.
    Rows with a null id, label, vector or component, or one that isn't finite, take no part, nor do those whose squared length, times
    SCALE^2, is 2^55 or more. Vectors are compared with those of their own length; the empty one scores 0. Other rows are those of
    another id: rows with an anchor's id are never its positives or negatives. Repeated rows are candidates each; an anchor
    that is repeated, all equal, is answered once, and one whose rows differ is answered for each. Empty table: no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, F.col("label") if label is None else label, vector_col)
    forest = trees(rows, size, leaf)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    anchors = cut(rows.filter(is_anchor).distinct())
    n = anchors.count()
    shared_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/negatives-{uuid.uuid4().hex}"
    blocks, written = -(-n // block), False
    for b in range(blocks):
        table = anchors.filter(F.pmod(F.xxhash64("id", "label", "v"), F.lit(blocks)) == b).toArrow().combine_chunks()
        if not table.num_rows:
            continue
        everything = np.full(table.num_rows, 1 << 62)
        sent = spark.sparkContext.broadcast(_questions(table, -everything, everything, True, positives))
        pairs = answers(forest, sent, positives).toArrow().sort_by([("asked", "ascending"), ("rank", "ascending")])  # a few for each of the block's anchors
        sent.destroy()
        if not pairs.num_rows:
            continue
        of, score, positive = (pairs.column(c).to_numpy() for c in ("asked", "score", "id"))
        # by length the numbers begin anew: told apart by the position in the block
        sent = spark.sparkContext.broadcast(_questions(table, percent * score, 100 * score, False, negatives, of))
        ids = table.column("id").to_numpy()
        known = spark.createDataFrame(pa.table({"asked": np.arange(len(of), dtype=np.int64), "anchor_id": ids[of], "positive_id": positive, "positive_score": score}))
        found = answers(forest, sent, negatives).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
        out = found.join(F.broadcast(known), "asked").select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")
        out.write.mode("append").parquet(folder)
        sent.destroy()
        written = True
    if not written:
        return spark.createDataFrame([], schema)
    result = cut(spark.read.schema(schema).parquet(folder))
    remove(spark, folder)
    return result


def op12_hard_negatives(embeddings: DataFrame) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(embeddings, F.col("id") % 100 == 0, label=moved)


SQL = """
WITH fine AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, r.id AS id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM fine a JOIN fine r ON r.id <> a.id AND len(a.v) = len(r.v) WHERE a.id % 100 = 0),
positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) AS INT) AS rank, n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""
