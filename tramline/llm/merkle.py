"""Merkle dataset manifest: authentication paths of all rows of a dataset, computed block by block.

Rows are leaves; each group's leaves form a tree of runs of ARITY nodes, and the groups' roots form the tree above
them. Leaves are ranked in their tree without a single task and dealt into aligned blocks of ARITY^HEIGHT leaves. A
block is traversed leaf by leaf: at each height a treehash stack prepares the run of nodes that comes next while the present run
serves the paths, so a traversal holds a few nodes a height. The blocks' roots are the leaves of the next pass; a
leaf's path is its block's, followed by the path that its block's root has above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded_batches, cut, join_bounded, unused

#: Nodes of a run; heights of a block, which has 3^6 = 729 leaves.
ARITY, HEIGHT = 3, 6
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: A level of a path: the siblings before and behind the path's node, as concatenated digests.
STEP = "struct<before:string,after:string>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


class TreeHash:
    """A stack that folds consecutive leaves into nodes of one height, at most a run of them: never more than ARITY - 1 of a lower height."""

    def __init__(self, leaves: list[str], height: int, start: int):
        self.leaves, self.height, self.at, self.stack = leaves, height, start, []
        self.end = min(len(leaves), start + ARITY ** (height + 1))

    def lowest(self) -> int | None:
        """The height of the last node, which tells what to advance first; None once nothing is left to do."""
        if self.at >= self.end:
            return None
        return self.stack[-1][0] if self.stack else self.height

    def _fold(self, h: int, n: int) -> None:
        node = digest("".join(d for _, d in self.stack[-n:]))
        del self.stack[-n:]
        self.stack.append((h + 1, node))

    def advance(self) -> None:
        self.stack.append((0, self.leaves[self.at]))
        self.at += 1
        while (h := self.stack[-1][0]) < self.height and len(self.stack) >= ARITY and self.stack[-ARITY][0] == h:
            self._fold(h, ARITY)
        if self.at == self.end:  # the last run of each height may be short
            for h in range(self.height):
                if n := sum(k == h for k, _ in self.stack[-ARITY:]):
                    self._fold(h, n)

    def run(self) -> list[str]:
        while self.at < self.end:
            self.advance()
        return [d for _, d in self.stack]


def traverse(leaves: list[str], height: int, held: list[int] | None = None) -> Iterator[list[tuple[str, str]]]:
    """Each leaf's path through ``height`` levels of its block, from the leaf up, as siblings before and behind.

    Each leaf spends one step a height on the stacks that prepare the next runs, on those with the lowest nodes
    first. held, if given, gets the number of nodes on all stacks after each leaf.
    """
    present = [TreeHash(leaves, h, 0).run() for h in range(height)]
    coming = [TreeHash(leaves, h, ARITY ** (h + 1)) for h in range(height)]
    for k in range(len(leaves)):
        if k:
            for h in range(height):
                if k % ARITY ** (h + 1):
                    break
                present[h] = coming[h].run()
                coming[h] = TreeHash(leaves, h, k + ARITY ** (h + 1))
        path = []
        for h, run in enumerate(present):
            own = k // ARITY**h % ARITY
            path.append(("".join(run[:own]), "".join(run[own + 1 :])))
        yield path
        for _ in range(height):
            open_ = [(low, h) for h, t in enumerate(coming) if (low := t.lowest()) is not None]
            if not open_:
                break
            coming[min(open_)[1]].advance()
        if held is not None:
            held.append(sum(len(t.stack) for t in coming))


def root_of(leaves: list[str], height: int) -> str:
    """The node in which a block of at most ARITY^height leaves ends; a block of height 0 is its leaf."""
    return digest("".join(TreeHash(leaves, height - 1, 0).run())) if height else leaves[0]


def heights(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    h = 0
    while ARITY**h < n:
        h += 1
    return h


def leaf(columns: list[Column]) -> Column:
    """H of the values: '-' for null, else the UTF-8 bytes' count, ':', the value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def folded(node: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(proof, node, lambda x, s: F.sha2(F.concat(s["before"], x, s["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """H of the path's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def _ranked(rows: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """rows with _rank (from 0) and _n (size) of their tree. Ranges of (tree, order) are numbered in tasks of their own; sums of the ranges before,
    at most one a range and tree, give the offsets. Equal rows are dealt by a number of their own, as their order doesn't matter."""
    salted = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    keys = [F.col(tree).asc_nulls_first(), *order, F.col("_salt")]
    parts = cut(salted.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy(tree, "_part").agg(F.count("*").alias("_own"))
    own = W.Window.partitionBy(tree)
    before = F.sum("_own").over(own.orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1))
    counts = counts.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("_n", F.sum("_own").over(own))
    offsets = cut(counts.select(F.struct(tree, "_part").alias("_at"), "_before", "_n"))
    inner = F.row_number().over(W.Window.partitionBy(tree, "_part").orderBy(*keys)) - 1
    numbered = parts.withColumn("_inner", inner).withColumn("_at", F.struct(tree, "_part"))
    joined = join_bounded(numbered, offsets, "_at", F.col("_salt"))
    return joined.withColumn("_rank", F.col("_inner") + F.col("_before")).drop("_salt", "_part", "_inner", "_at", "_before")


def _traversed(nodes: DataFrame, tree: str, keep: list[str], height: int) -> DataFrame:
    """(tree, keep, root, path) for nodes (tree, keep, node, _rank, _n): pass over pass, until each tree is one block.

    A block's row with what is above it comes before its leaves, so that paths leave the pass whole.
    """
    block = ARITY**height
    placed = nodes.withColumn("_block", F.floor(F.col("_rank") / block)).withColumn("_inner", F.col("_rank") - F.col("_block") * block)
    spark = nodes.sparkSession
    bounded_batches(spark)
    kind = nodes.schema[tree].dataType.simpleString()
    types = {f.name: f.dataType for f in nodes.schema}
    arrow = {k: to_arrow_type(types[k]) for k in (tree, *keep)}
    steps = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

    def blocks(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
        """(key, header, rows) of each block of a sorted partition."""
        key, header, rows = None, None, []
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
            for row in zip(*columns):
                now = row[:2]
                if now != key:
                    if rows:
                        yield key, header, rows
                    key, header, rows = now, None, []
                if row[2] < 0:
                    header = row
                else:
                    rows.append(row)
        if rows:
            yield key, header, rows

    def level(n: int) -> int:
        return height if n > block else heights(n)

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (name, number), _, rows in blocks(batches, [tree, "_block", "_inner", "_n", "node"]):
            n = rows[0][3]
            out.append((name, root_of([r[4] for r in rows], level(n)), number, -(-n // block)))
            if len(out) >= 4_096:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), root_types)], names=[tree, "node", "_rank", "_n"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), root_types)], names=[tree, "node", "_rank", "_n"])

    root_types = [arrow[tree], pa.string(), pa.int64(), pa.int64()]
    parts = max(nodes.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    order = [tree, "_block", "_inner"]
    spread = [F.coalesce(F.col(tree).cast("string"), F.lit("")), F.col("_block")]
    dealt = placed.repartition(parts, *spread).sortWithinPartitions(*order)
    found = dealt.select(tree, "_block", "_inner", "_n", "node").mapInArrow(roots, f"`{tree}` {kind}, node string, _rank long, _n long")
    above = cut(found)
    if above.filter("_n > 1").limit(1).count():
        upper = _traversed(above.withColumn("_number", F.col("_rank")), tree, ["_number"], height).withColumnRenamed("_number", "_block")
    else:
        upper = above.select(tree, F.col("_rank").alias("_block"), F.col("node").alias("root"), F.array().cast(f"array<{STEP}>").alias("path"))
    head = upper.withColumn("_inner", F.lit(-1).cast("long"))
    both = placed.unionByName(head, allowMissingColumns=True).repartition(parts, *spread).sortWithinPartitions(*order)
    names = [tree, *keep, "root", "path"]
    out_types = [arrow[tree], *[arrow[k] for k in keep], pa.string(), steps]

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (name, _), header, rows in blocks(batches, [tree, "_block", "_inner", "_n", "node", "root", "path", *keep]):
            root, rest = header[5], header[6]
            for row, path in zip(rows, traverse([r[4] for r in rows], level(rows[0][3]))):
                out.append((name, *row[7:], root, [{"before": a, "after": b} for a, b in path] + rest))
                if len(out) >= 1_024:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), out_types)], names=names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), out_types)], names=names)

    schema = ", ".join(f"`{k}` {types[k].simpleString()}" for k in (tree, *keep))
    return both.select(*order, "_n", "node", "root", "path", *[k for k in keep]).mapInArrow(paths, f"{schema}, root string, path array<{STEP}>")


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", group_col: str = "source", extra: dict[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """(id, group, extra, leaf, subroot, root, proof) for every row: proof has a step (before, after) for each level, from the leaf to the root.

    A group's leaves ascend by id, null ids first, rows of equal ids by leaf; equal rows are leaves each. Groups go by
    their name's UTF-8 bytes, null first. A group of one leaf is that leaf, and so is a dataset of one. Null values
    count as '-', empty texts as '0:'. Empty table: no rows. Other columns are ignored. extra names columns, made from the row, that travel along.
    """
    extra = extra or {}
    if taken := {"leaf", "subroot", "root", "proof"} & {*extra, id_col, group_col}:
        raise ValueError(f"these names are the manifest's own: {', '.join(sorted(taken))}")
    rows = docs.select(F.col(group_col).cast("string").alias("_tree"), F.col(id_col).alias("_id"), leaf([F.col(c) for c in columns]).alias("node"), *[c.alias(f"_x{k}") for k, c in enumerate(extra.values())])
    keep = ["_id", "_leaf", *[f"_x{k}" for k in range(len(extra))]]
    ranked = _ranked(rows, "_tree", [F.col("_id").asc_nulls_first(), F.col("node")]).withColumn("_leaf", F.col("node"))
    own = cut(_traversed(ranked, "_tree", keep, height))
    subroots = own.groupBy("_tree").agg(F.first("root").alias("node"))
    tops = _ranked(subroots.withColumn("_all", F.lit(0)), "_all", [F.col("_tree").asc_nulls_first()])
    top = cut(_traversed(tops, "_all", ["_tree"], height).select("_tree", F.col("root").alias("_top"), F.col("path").alias("_up")))
    out = join_bounded(own, top, "_tree", F.col("_leaf"))
    named = [F.col(f"_x{k}").alias(name) for k, name in enumerate(extra)]
    return out.select(F.col("_id").alias(id_col), F.col("_tree").alias(group_col), *named, F.col("_leaf").alias("leaf"), F.col("root").alias("subroot"), F.col("_top").alias("root"), F.concat("path", "_up").alias("proof"))


def verified(rows: DataFrame, node: Column) -> DataFrame:
    """rows of a manifest with folded_root, what node and the row's proof give, and verified, whether that is the root."""
    return rows.withColumn("folded_root", folded(node, F.col("proof"))).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle(docs: DataFrame) -> DataFrame:
    """Rows whose id's checksum is even are verified with a text without line ends; a null id is never tampered with."""
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    changed = F.when(even & F.contains(F.col("text"), F.lit("\n")), leaf([F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in COLUMNS]))
    rows = verified(manifest(docs, extra={"tampered": changed}), F.coalesce("tampered", "leaf"))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def _field(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(CAST(octet_length(encode({text})) AS VARCHAR) || ':' || {text}, '-')"


def _levels(name: str, leaves: str, tree: str) -> str:
    """All nodes of the trees over ``leaves`` (tree, place, node), level by level."""
    return f"""{name} AS (
  SELECT 0 AS level, {tree} AS tree, place, node, count(*) OVER (PARTITION BY {tree}) AS n FROM {leaves}
  UNION ALL
  SELECT level, tree, place, node, count(*) OVER (PARTITION BY tree) AS n FROM (
    SELECT level + 1 AS level, tree, place // {ARITY} AS place, sha256(string_agg(node, '' ORDER BY place)) AS node FROM {name} WHERE n > 1 GROUP BY level, tree, place // {ARITY}))"""


#: crc32's polynomial, a bit at a time; only the last bit of the checksum counts.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: ascii({0}[i])::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"""

SQL = rf"""
WITH RECURSIVE input AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('s' || source, '') AS tree,
         sha256({' || '.join(_field(c) for c in COLUMNS)}) AS leaf,
         CASE WHEN xor({_CRC.format("CAST(doc_id AS VARCHAR)")}, 4294967295) % 2 = 0 THEN sha256({' || '.join(_field("replace(text, chr(10), '')" if c == "text" else c) for c in COLUMNS)}) END AS tampered
  FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS place, leaf AS node FROM input),
{_levels("low", "leaves", "tree")},
subroots AS (SELECT tree, node, row_number() OVER (ORDER BY tree) - 1 AS place FROM low WHERE n = 1),
{_levels("top", "(SELECT '' AS everything, * FROM subroots) s", "everything")},
heights AS (SELECT tree, max(level) AS height FROM low GROUP BY tree),
siblings AS (
  SELECT l.r, s.level, s.place, s.node, s.place < l.place // CAST({ARITY}**s.level AS BIGINT) AS before
  FROM leaves l JOIN low s ON s.tree = l.tree AND s.place // {ARITY} = l.place // CAST({ARITY}**(s.level + 1) AS BIGINT) AND s.place <> l.place // CAST({ARITY}**s.level AS BIGINT) AND s.n > 1
  UNION ALL
  SELECT l.r, h.height + s.level, s.place, s.node, s.place < u.place // CAST({ARITY}**s.level AS BIGINT)
  FROM leaves l JOIN subroots u ON u.tree = l.tree JOIN heights h ON h.tree = l.tree
  JOIN top s ON s.place // {ARITY} = u.place // CAST({ARITY}**(s.level + 1) AS BIGINT) AND s.place <> u.place // CAST({ARITY}**s.level AS BIGINT) AND s.n > 1),
steps AS (
  SELECT r, level, coalesce(string_agg(node, '' ORDER BY place) FILTER (before), '') AS before, coalesce(string_agg(node, '' ORDER BY place) FILTER (NOT before), '') AS after
  FROM siblings GROUP BY r, level),
tops AS (SELECT max(level) AS height FROM top),
folds AS (
  SELECT l.r, 0 AS level, coalesce(l.tampered, l.leaf) AS node, h.height + t.height AS height FROM leaves l JOIN heights h ON h.tree = l.tree, tops t
  UNION ALL
  SELECT f.r, f.level + 1, sha256(coalesce(s.before, '') || f.node || coalesce(s.after, '')), f.height FROM folds f LEFT JOIN steps s ON s.r = f.r AND s.level = f.level WHERE f.level < f.height),
proofs AS (SELECT r, sha256(string_agg(before || after, '' ORDER BY level)) AS proof_sha256 FROM steps GROUP BY r)
SELECT l.doc_id, l.leaf, s.node AS subroot, t.node AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.node AS folded_root, f.node = t.node AS verified
FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN folds f ON f.r = l.r AND f.level = f.height LEFT JOIN proofs p ON p.r = l.r, (SELECT node FROM top WHERE n = 1) t
"""
