"""SimHash: fingerprints from word shingles, linked by a self-join of their binary trie; and near-duplicates by five-word shingles.

Near-duplicates are candidates of the trie join, of which an exact check of the shingles decides. Texts of similarity 0.8 differ
in some 10 of 64 fingerprint bits, up to 18, a budget under which a trie join rules out nothing; so MinHash bands add the
pairs beyond its budget, and those that it joined aren't compared again.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import BROADCAST_ROWS, SPLIT_ROWS, arrow_pass, cut, give_back, hot_keys, join_bounded, split_join, tidy, unused

WORDS, SEED, BITS = 3, 42, 64
#: Bits in which linked fingerprints differ at most.
ERRORS = 3
#: Fingerprints that one task joins at most; a larger group is cut into parts, and each pair of parts is a task.
GROUP = 8_192
#: Shingles of a bucket's texts that a task holds about twice.
GROUP_SHINGLES = 4_000_000
#: Entries of two trie nodes, on an average, that are compared rather than split further.
LEAF = 4
#: Pairs of nodes that are taken down at once, and links that are looked at before the components are told again.
PAIRS, STEP = 1 << 17, 1 << 12

#: Near-duplicates: words of a shingle, and the share of common shingles that links two texts, as a fraction.
NEAR_WORDS, SIMILAR = 5, (4, 5)
#: MinHash bands and the minima in each: at similarity 0.8 all bands of a pair differ once in 20 million pairs.
BANDS, MINIMA = 32, 4
#: Minima that agree in a pair worth the exact check; at similarity 0.8 fewer do about three times in a million.
LEAST_EQUAL = 82
#: Texts of a bucket from which its first comparisons are with its most central text.
LARGE = 64
#: Rounds in which a bucket's texts are only compared with one of them, before the others are compared with each other.
STARS = 2


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """Bit b is 1 where it is set in over half of the shingles' hashes. bytes.lower() and bytes.split() know ASCII only."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[k:] for k in range(words))))
    hashed = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), dtype=np.uint64)
    counts = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashed), 1 << 16):
        counts += np.unpackbits(hashed[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashed), bitorder="little").view(np.uint64)[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, text_key, fp): the fingerprint as a signed long. Null text reads as empty, with fingerprint 0."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def step(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "text_key": batch.column(2), "fp": [signed(fingerprint(x, words, seed)) for x in batch.column(1).to_pylist()]}

    return arrow_pass(rows.withColumn("text_key", F.xxhash64("text")), step, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key long, fp long")


class Forest:
    """Components of the entries joined so far; only links that join two of them are told."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def link(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _leaf_pairs(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of each pair of slices."""
    n, m = hi - lo, hi2 - lo2
    many = n * m
    pair = np.repeat(np.arange(len(lo)), many)
    off = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
    return lo[pair] + off // m[pair], lo2[pair] + off % m[pair]


def trie_join(left: np.ndarray, right: np.ndarray | None, errors: int = ERRORS, firm: int = 0, seen: Callable[[int, int], None] | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs that differ in at most ``errors`` bits, and in none of the first ``firm``.

    left and right are sorted different uint64; a node of the binary trie is a slice of one and a bit. Pairs of nodes are taken
    down together, many at once, each with the bits that its paths may still differ in; where they differ one is spent, and a pair
    without any left goes on with equal halves only. Pairs of a few entries are compared. Positions in right are after those in left. right None: left
    with itself. seen is told each step's bit and its pairs of nodes, and bit -1 with the pairs of entries that are compared.
    """
    same = right is None
    a, b = left, left if same else right
    shift = 0 if same else len(a)
    forest, out = Forest(len(a) + (0 if same else len(b))), []
    root = np.arange(len(forest.up))

    def link(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal root
        for k in range(0, len(x), STEP):
            i, j = x[k : k + STEP], y[k : k + STEP]
            news = np.flatnonzero(root[i] != root[j])
            before = len(out)
            for u, v in zip(i[news].tolist(), j[news].tolist()):
                if forest.link(u, v):
                    out.append((u, v))
            if len(out) > before:
                root = np.array(forest.up)
                while (root[root] != root).any():
                    root = root[root]

    first = [np.array([x], dtype=np.int64) for x in (0, len(a), 0, len(b), errors)]
    todo = [(BITS - 1, *first)] if len(a) and len(b) else []
    while todo:
        bit, lo, hi, lo2, hi2, budget = todo.pop()
        if len(lo) > PAIRS:
            half = len(lo) // 2
            todo += [(bit, *(x[half:] for x in (lo, hi, lo2, hi2, budget))), (bit, *(x[:half] for x in (lo, hi, lo2, hi2, budget)))]
            continue
        small = (hi - lo) * (hi2 - lo2) <= LEAF * LEAF if bit >= 0 else np.ones(len(lo), dtype=bool)
        if small.any():
            x, y = _leaf_pairs(lo[small], hi[small], lo2[small], hi2[small])
            if seen:
                seen(-1, len(x))
            near = (np.bitwise_count(a[x] ^ b[y]) <= errors) & ((x < y) if same else True)
            if firm:
                near &= (a[x] ^ b[y]) >> np.uint64(BITS - firm) == 0
            link(x[near], y[near] + shift)
            lo, hi, lo2, hi2, budget = (z[~small] for z in (lo, hi, lo2, hi2, budget))
        if not len(lo):
            continue
        if seen:
            seen(bit, len(lo))
        # values of a node agree above bit, so its halves meet at the first value with the bit set
        one = np.uint64(1) << np.uint64(bit)
        above = ~((one << np.uint64(1)) - np.uint64(1)) if bit < BITS - 1 else np.uint64(0)
        mid = np.clip(np.searchsorted(a, a[lo] & above | one), lo, hi)
        mid2 = np.clip(np.searchsorted(b, b[lo2] & above | one), lo2, hi2)
        spend = (budget > 0) & (bit < BITS - firm)
        own = spend & ~(same & (lo == lo2) & (hi == hi2))  # a node with itself has the crossed pair once
        parts = [(lo, mid, lo2, mid2, budget), (mid, hi, mid2, hi2, budget), tuple(z[spend] for z in (lo, mid, mid2, hi2, budget - 1)), tuple(z[own] for z in (mid, hi, lo2, mid2, budget - 1))]
        lo, hi, lo2, hi2, budget = (np.concatenate(z) for z in zip(*parts))
        full = (lo < hi) & (lo2 < hi2)
        todo.append((bit - 1, *(z[full] for z in (lo, hi, lo2, hi2, budget))))
    return out


def links(classes: DataFrame, errors: int = ERRORS, group: int = GROUP) -> DataFrame:
    """(a, b): links between different fingerprints of ``classes`` (fp) with the components of all links.

    Up to ``group`` fingerprints are one trie. More are dealt out to several: the 64 bits are cut into blocks, and of two that differ in at
    most ``errors`` bits all but ``errors`` blocks agree, so for each choice of so many blocks there is a trie whose paths begin with these and don't differ
    in them. Such a trie is dealt out by its first bits, as subtries of about half of ``group`` entries, however many there are in all. A subtrie of
    more than ``group`` is cut into parts by hash, each pair of parts a task of its own, so that no task
    gets more than 2 * group entries and no link is lost.
    """
    dealings = tries(classes.count(), errors, group)

    def leading(chosen: list[tuple[int, int]], bits: int):
        value, width = F.lit(0).cast("long"), 0
        for lo, hi in chosen:
            value = F.shiftleft(value, hi - lo).bitwiseOR(F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)))
            width += hi - lo
        return F.shiftrightunsigned(value, width - bits)

    values = F.array(*[leading(chosen, bits) for chosen, _, bits in dealings])
    dealt = cut(classes.select("fp", F.posexplode(values).alias("block", "value")))
    # a hot value is one whose count is over group: few, and each stands for over group rows
    hot = dealt.groupBy("block", "value").agg(F.count("*").alias("n")).filter(F.col("n") > group)
    hot = hot.select(F.col("block").alias("_b"), F.col("value").alias("_v"), F.ceil(F.col("n") / (group / 2)).cast("int").alias("parts"))
    marked = dealt.join(hot, (F.col("block") == F.col("_b")) & (F.col("value") == F.col("_v")), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    mine = marked.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    pairs = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keyed = pairs.select("fp", "block", "value", "mine", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"))

    parts = keyed.repartition("block", "value", "p", "q").sortWithinPartitions("block", "value", "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, mine, fp in whole_groups(batches):
            found = group_links(key, mine, fp, errors, dealings)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b"])
        give_back()

    return parts.select("block", "value", "p", "q", "mine", "fp").mapInArrow(run, "a long, b long")


def tries(n: int, errors: int, group: int) -> list[tuple[list[tuple[int, int]], list[tuple[int, int]], int]]:
    """For each choice of blocks those that come first in its trie's paths, the others, and the leading bits by which it is dealt out; one trie as it is for few."""
    if n <= group:
        return [([], [(0, BITS)], 0)]
    out = []
    for mask in block_masks(n, errors, group):
        chosen, others, lo = [], [], 0
        while lo < BITS:
            hi = lo
            while hi < BITS and (mask >> hi & 1) == (mask >> lo & 1):
                hi += 1
            (chosen if mask >> lo & 1 else others).append((lo, hi))
            lo = hi
        out.append((chosen, others, min(sum(hi - lo for lo, hi in chosen), max(1, (2 * n // group).bit_length()))))
    return out


def moved(u: np.ndarray, parts: list[tuple[int, int]]) -> np.ndarray:
    """Fingerprints with their ranges of bits in another order, the first at the top; distances stay."""
    out = np.zeros(len(u), dtype=np.uint64)
    for lo, hi in parts:
        if hi - lo == BITS:
            return u.copy()
        out = out << np.uint64(hi - lo) | u >> np.uint64(lo) & np.uint64((1 << (hi - lo)) - 1)
    return out


def block_masks(n: int, errors: int, group: int) -> list[int]:
    """The bits of each choice of blocks that must agree; a function of the number of fingerprints only."""
    blocks = errors + 1
    while n > (group // 8 or 1) << (BITS * (blocks - errors) // blocks) and blocks < 3 * errors:
        blocks += 1
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    each = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    return [sum(c) for c in itertools.combinations(each, blocks - errors)]


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted rows of (four keys, mine, fp) as arrays that hold whole groups: a batch's last group waits for the next batch."""
    held: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)], axis=1)
        new = (key, batch.column(4).to_numpy(), batch.column(5).to_numpy())
        rows = new if held is None else tuple(np.concatenate(x) for x in zip(held, new))
        last = int(np.argmax((rows[0] == rows[0][-1]).all(axis=1)))
        if last:
            yield tuple(x[:last] for x in rows)
        held = tuple(x[last:] for x in rows)
    if held is not None:
        yield held


def group_links(key: np.ndarray, mine: np.ndarray, fp: np.ndarray, errors: int, dealings: list) -> tuple[np.ndarray, np.ndarray]:
    """Links of all groups, each by the join of its trie with itself, or of two parts' (p < q) tries with each other."""
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
    a, b = [], []
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(fp)]):
        block, _, p, q = key[s].tolist()
        chosen, others, _ = dealings[block]
        own = [fp[s:e]] if p == q else [fp[s:e][mine[s:e] == p], fp[s:e][mine[s:e] == q]]
        paths = [moved(x.view(np.uint64), chosen + others) for x in own]
        order = [x.argsort() for x in paths]
        found = trie_join(paths[0][order[0]], None if p == q else paths[1][order[1]], errors, sum(hi - lo for lo, hi in chosen))
        at = np.array(found, dtype=np.int64).reshape(-1, 2)
        both = np.concatenate([x[o] for x, o in zip(own, order)])
        a.append(both[at[:, 0]])
        b.append(both[at[:, 1]])
    none = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(a or none), np.concatenate(b or none)


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, root) for each vertex of an edge: root is the smallest fp of its component.

    Each round every vertex takes the smallest root among its neighbours, and then its root's root;
    the rounds end when none changes. Each is written, so lost executors cost one round. A vertex with
    many neighbours, and a root of many, are dealt over several tasks.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    hubs = hot_keys(both, "b")
    roots = cut(both.groupBy(F.col("a").alias("fp")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = split_join(both, "b", roots.select(F.col("fp").alias("_fp"), "root"), "_fp", F.col("a"), hot=hubs).groupBy("a").agg(F.min("root").alias("near"))
        better = cut(roots.join(near, roots["fp"] == near["a"]).select("fp", F.col("root").alias("old"), F.least("root", "near").alias("root")))
        above = better.select(F.col("root").alias("_root")).distinct().join(roots.select("fp", F.col("root").alias("above")), F.col("_root") == F.col("fp")).select(F.col("_root").alias("root"), "above")
        new = cut(join_bounded(better, above, "root", F.col("fp")).select("fp", "old", F.least("root", F.coalesce("above", "root")).alias("root")))
        changed = new.filter("old != root").limit(1).count()
        roots = new.select("fp", "root")
        if not changed:
            return roots


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, words: int = NEAR_WORDS) -> np.ndarray:
    """The different shingles' hashes, sorted. A text of fewer words is one shingle, a text without words has none."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if len(w) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)] if w else [], dtype=np.uint64)
    each = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in w), dtype=np.uint64, count=len(w))
    out = np.zeros(len(w) - words + 1, dtype=np.uint64)
    for k in range(words):
        out = _mixed(out + each[k : k + len(out)])
    return np.unique(out)


_SEEDS = _mixed(np.arange(1, BANDS * MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of the BANDS * MINIMA hash functions; all ones without shingles."""
    out = np.full(len(_SEEDS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(shingles), 1 << 11):
        x = shingles[k : k + (1 << 11), None] ^ _SEEDS
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        out = np.minimum(out, x.min(axis=0))
    return out


def bands(least: np.ndarray) -> np.ndarray:
    """A bucket for each band: the band's number and its minima."""
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(MINIMA):
        out = _mixed(out + least.reshape(BANDS, MINIMA)[:, k])
    return out.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp, simhash, buckets): fp names the set of shingles, simhash is their fingerprint."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def step(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1).to_pylist()
        sets = [shingle_set(x) for x in texts]
        fps = [signed(xxhash.xxh64_intdigest(x.tobytes(), SEED)) for x in sets]
        simhashes = [signed(fingerprint(x, NEAR_WORDS)) for x in texts]
        return {"doc_id": batch.column(0), "text_key": batch.column(2), "fp": fps, "simhash": simhashes, "buckets": [bands(minima(x)) for x in sets]}

    return arrow_pass(rows.withColumn("text_key", F.xxhash64("text")), step, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key long, fp long, simhash long, buckets array<long>")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b; written) whose sets (fp, shingles) have the similarity, by exact count. b can be of many pairs, a of few."""
    left = sets.select(F.col("fp").alias("_a"), F.col("shingles").alias("_x"))
    right = sets.select(F.col("fp").alias("_b"), F.col("shingles").alias("_y"))
    sizes = F.size("_x") + F.size("_y")
    first = pairs.join(left, F.col("a") == F.col("_a"))
    both = split_join(first, "b", right, "_b", F.col("a"), hot=hot_keys(pairs, "b")).withColumn("_n", F.size(F.array_intersect("_x", "_y")))
    return both.filter(F.col("_n") * SIMILAR[1] >= (sizes - F.col("_n")) * SIMILAR[0]).select("a", "b")


def across(members: DataFrame, group: int = GROUP, shingles: int = GROUP_SHINGLES) -> DataFrame:
    """(a, b): links between a group's members (hub, fp, root, common, shingles, minima) that join different roots.

    A pair needs enough equal minima, and enough shingles that any other text has too: of a text ``common`` are, and two
    texts can't share more than the fewer. Then the shingles are counted, and only a link that joins two roots of the task's own forest
    is told. Large groups are cut into parts, by texts and by shingles, each pair of parts a task's group, as in links().
    """
    sizes = members.groupBy("hub").agg(F.count("*").alias("n"), F.sum(F.octet_length("shingles")).alias("bytes"), (F.min("root") != F.max("root")).alias("open")).filter("open")
    cuts = F.greatest(F.ceil(F.col("n") / (group / 2)), F.ceil(F.col("bytes") / (8 * shingles))).cast("int")
    parts = cut(sizes.select("hub", "n", cuts.alias("parts")))
    hot = parts.filter(F.col("n") > SPLIT_ROWS).select("hub", F.ceil(F.col("n") / SPLIT_ROWS).cast("int").alias("split"))
    mine = split_join(members, "hub", parts.select(F.col("hub").alias("_hub"), "parts"), "_hub", F.col("fp"), hot=hot).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    pairs = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keyed = pairs.select("hub", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "fp", "root", "common", "shingles", "minima")
    dealt = keyed.repartition("hub", "p", "q").sortWithinPartitions("hub", "p", "q", "mine", "fp")
    more, of = SIMILAR[0], SIMILAR[0] + SIMILAR[1]

    def compare(rows: list[tuple]) -> list[tuple[int, int]]:
        _, p, q = rows[0][:3]
        mine, fp, root, common = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(3, 7))
        sets = [np.frombuffer(r[7], dtype=np.uint64) for r in rows]
        size = np.array([len(x) for x in sets], dtype=np.int64)
        least = np.frombuffer(b"".join(r[8] for r in rows), dtype=np.uint8).reshape(len(rows), -1)
        names, at, n = np.unique(root, return_inverse=True, return_counts=True)
        forest, out = Forest(len(names)), []
        largest = at == int(n.argmax())
        for i in np.flatnonzero(~largest):  # of two members with different roots one isn't of the largest
            fit = (root != root[i]) & (largest | (fp > fp[i])) & (of * np.minimum(common, common[i]) >= more * (size + size[i]))
            if p != q:
                fit &= mine != mine[i]
            js = np.flatnonzero(fit)
            js = js[(least[js] == least[i]).sum(axis=1) >= LEAST_EQUAL]
            for j in js.tolist():
                if forest.root(int(at[i])) == forest.root(int(at[j])):
                    continue
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if of * shared >= more * int(size[i] + size[j]):
                    forest.link(int(at[i]), int(at[j]))
                    out.append((int(fp[i]), int(fp[j])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        for _, g in itertools.groupby(rows, key=lambda r: r[:3]):
            if found := compare(list(g)):
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
        give_back()

    return dealt.mapInArrow(run, "a long, b long")


def trie_candidates(one: DataFrame, group: int = GROUP) -> DataFrame:
    """(a, b): pairs of sets of shingles (one: fp, simhash) with the components of all whose fingerprints are linked.

    The sets of one fingerprint go with its least one, and the least ones of linked fingerprints with each other. a is of fewer pairs than b.
    """
    least = cut(one.groupBy(F.col("simhash").alias("_s")).agg(F.min("fp").alias("least"), F.count("*").alias("n")))
    same = split_join(one.select("fp", "simhash"), "simhash", least.filter("n > 1").select("_s", "least"), "_s", F.col("fp")).filter("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    told = cut(links(least.select(F.col("_s").alias("fp")), ERRORS, group))
    ends = [least.select(F.col("_s").alias(f"_{x}"), F.col("least").alias(f"{x}_least")) for x in "ab"]
    between = split_join(split_join(told, "a", ends[0], "_a", F.col("b")), "b", ends[1], "_b", F.col("a"))
    pairs = cut(same.union(between.select(F.col("a_least").alias("a"), F.col("b_least").alias("b"))).distinct())
    # the pairs are of forests, so hardly any is of two texts that have many
    many = hot_keys(pairs.select(F.explode(F.array("a", "b")).alias("a")), "a")
    turned = join_bounded(pairs, many, "a", F.col("b")).select("a", "b", F.col("parts").isNotNull().alias("turn"))
    return turned.select(F.when(F.col("turn"), F.col("b")).otherwise(F.col("a")).alias("a"), F.when(F.col("turn"), F.col("a")).otherwise(F.col("b")).alias("b"))


def near_links(docs: DataFrame, rows: DataFrame, group: int = GROUP) -> DataFrame:
    """(a, b): links between sets of shingles (rows: fp, text_key, simhash, buckets) with the components of all similar pairs.

    First the candidates of the trie join are checked. Then texts that share a bucket and aren't joined are compared, first for a few rounds with one text of it only, which joins most of a large group
    of near copies: at first, in a large bucket, that with the most others in its buckets. Then those are that aren't yet joined: all
    texts of the buckets that had the same text for their first are one group, so a text goes to few, however many buckets it shares.
    """
    spark = docs.sparkSession
    one = cut(rows.groupBy("fp").agg(F.min_by(F.struct("text_key", "simhash", "buckets"), "text_key").alias("x")).select("fp", "x.*"))
    candidates = cut(trie_candidates(one, group))
    each = one.select("fp", F.explode("buckets").alias("bucket"))
    sizes = cut(each.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"))
    hot = cut(sizes.filter(F.col("n") > SPLIT_ROWS).select("bucket", F.ceil(F.col("n") / SPLIT_ROWS).cast("int").alias("parts")))
    dealt = cut(split_join(each, "bucket", sizes.withColumnRenamed("bucket", "_bucket"), "_bucket", F.col("fp"), hot=hot))
    tidy(spark)

    def step(batch: pa.RecordBatch) -> dict:
        return {"fp": batch.column(1), "shingles": [shingle_set(x).view(np.int64) for x in batch.column(0).to_pylist()]}

    of = dealt.select("fp").union(candidates.select(F.explode(F.array("a", "b")))).distinct()
    wanted = cut(of.join(one.select("fp", "text_key"), "fp").groupBy("text_key").agg(F.min("fp").alias("fp")))
    keyed = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    texts = join_bounded(keyed, wanted, "text_key", F.col("doc_id"), "inner").select("text", "fp")
    sets = cut(arrow_pass(texts.dropDuplicates(["fp"]), step, "fp long, shingles array<long>"))
    tidy(spark)
    large = dealt.filter(F.col("n") > LARGE)
    central = large.join(large.groupBy("fp").agg(F.sum(F.col("n") - 1).alias("weight")), "fp").groupBy("bucket").agg(F.max_by("fp", F.struct("weight", "fp")).alias("hub"))
    small = dealt.filter(F.col("n") <= LARGE).groupBy("bucket").agg(F.max_by("fp", F.xxhash64("fp", F.lit(0))).alias("hub"))
    heads = cut(central.unionByName(small).select(F.col("bucket").alias("_bucket"), "hub"))

    def unjoined(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(fp, root) of texts by which they go, and (bucket, fp, root) of the buckets with several roots."""
        # a text goes by the least hub that it is linked to, or by this one's: texts that go by one are joined
        own = cut(found.groupBy(F.col("a").alias("fp")).agg(F.min("b").alias("hub")))
        above = own.join(found.select(F.col("b").alias("fp")).distinct(), "fp").select(F.col("fp").alias("hub"), F.col("hub").alias("next"))
        label = cut(join_bounded(own, above, "hub", F.col("fp")).select("fp", F.coalesce("next", "hub").alias("root")))
        members = cut(dealt.select("bucket", "fp").join(label, "fp", "left").select("bucket", "fp", F.coalesce("root", "fp").alias("root")))
        mixed = members.groupBy(F.col("bucket").alias("_bucket")).agg((F.min("root") != F.max("root")).alias("open")).filter("open").select("_bucket")
        return label, cut(split_join(members, "bucket", mixed, "_bucket", F.col("fp"), hot=hot))

    found = cut(similar(candidates, sets))
    label, open_ = unjoined(found)
    tidy(spark)
    for k in range(STARS):
        if not k:
            hubs = heads.join(label.withColumnRenamed("fp", "hub"), "hub", "left").select("_bucket", "hub", F.coalesce("root", "hub").alias("hub_root"))
        else:
            best = F.max_by(F.struct("fp", "root"), F.xxhash64("fp", F.lit(k))).alias("x")
            hubs = open_.groupBy(F.col("bucket").alias("_bucket")).agg(best).select("_bucket", F.col("x.fp").alias("hub"), F.col("x.root").alias("hub_root"))
        pairs = cut(split_join(open_, "bucket", hubs, "_bucket", F.col("fp"), hot=hot).filter("root <> hub_root").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct())
        found = cut(found.union(similar(pairs, sets)))
        _, open_ = unjoined(found)
        tidy(spark)
    own = sets.join(open_.select("fp").distinct(), "fp").select("fp", "shingles")
    lone = own.select("fp", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.min("fp").alias("fp")).filter("n = 1").groupBy("fp").agg(F.count("*").alias("lone"))
    common = F.size("shingles") - F.coalesce("lone", F.lit(0))
    some = own.join(lone, "fp", "left").select("fp", "shingles", common.alias("common")).filter(F.col("common") * SIMILAR[1] >= F.size("shingles") * SIMILAR[0])

    def sign(batch: pa.RecordBatch) -> dict:
        own = [np.array(x, dtype=np.int64).view(np.uint64) for x in batch.column(1).to_pylist()]
        least = [minima(x) for x in own]
        return {
            "fp": batch.column(0), "common": batch.column(2), "shingles": [x.tobytes() for x in own],
            "minima": [(x >> np.uint64(24)).astype(np.uint8).tobytes() for x in least],
        }

    bound = cut(arrow_pass(some, sign, "fp long, common long, shingles binary, minima binary"))
    grouped = split_join(open_, "bucket", heads.select("_bucket", F.col("hub").alias("group")), "_bucket", F.col("fp"), hot=hot).select(F.col("group").alias("hub"), "fp", "root").distinct()
    return cut(found.union(across(grouped.join(bound, "fp"), group)))


def _components_of(rows: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp, root, component_id) for each of the rows; classes: fp and its least doc_id."""
    roots = components(classes, edges)
    of = cut(classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = of.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id"))
    labels = cut(split_join(of, "root", ids, "_root", F.col("fp")).select(F.col("fp").alias("_fp"), "root", "component_id"))
    return split_join(rows.select("doc_id", "text_key", "fp"), "fp", labels, "_fp", F.struct("doc_id", "text_key"))


def near_fingerprints(docs: DataFrame, errors: int = ERRORS, group: int = GROUP) -> DataFrame:
    """(doc_id, text_key, fp, root, component_id) for each row of (doc_id, text).

    component_id is the smallest doc_id among all rows whose fingerprints can be reached over links.
    Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows each
    give a row. A null doc_id counts in no minimum; a component of such rows only has a null id.
    Empty table: no rows.
    """
    rows = cut(fingerprints(docs))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    return _components_of(rows, classes, links(classes, errors, group))


def near_duplicates(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(doc_id, text_key, fp, root, component_id) like near_fingerprints(), but linked are texts whose five-word shingles have a similarity of 0.8 or more; fp names a text's set of shingles. Null and empty texts are one set."""
    rows = cut(signatures(docs))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    return _components_of(rows, classes, near_links(docs, rows, group))


def keep_one(docs: DataFrame, find: Callable[..., DataFrame] = near_fingerprints, rows: int = BROADCAST_ROWS, **options) -> DataFrame:
    """docs without near-duplicates: of each component that find tells the row with its smallest doc_id stays.

    Rows repeated with that doc_id and text stay once. A component without a doc_id keeps its
    smallest text key. Null and empty texts are one component. Empty table: no rows.

    What goes is told by keys: up to ``rows`` of them are broadcast, so that texts stay where they are; beyond that rows meet
    the keys that stay by a shuffle.
    """
    found = cut(find(docs, **options))
    tidy(docs.sparkSession)
    key, own, nth = (unused(n, docs.columns) for n in ("text_key", "own_id", "nth"))
    named = F.coalesce(F.concat(F.lit("id "), F.col("doc_id").cast("string")), F.lit("none"))
    keys = cut(found.groupBy(F.col("text_key").alias(key), named.alias(own)).agg(F.count("*").alias("_n"), F.min("root").alias("_root"), F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("_first")))
    first = cut(keys.filter("_first").groupBy("_root").agg(F.min(F.struct(key, own)).alias("_x")).select(F.col(f"_x.{key}").alias(key), F.col(f"_x.{own}").alias(own)))
    going = cut(keys.join(first, [key, own], "left_anti").select(key, own))
    again = cut(keys.filter("_n > 1").join(first, [key, own], "left_semi").select(key, own))
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))).withColumn(own, named)
    once = F.row_number().over(W.Window.partitionBy(key, own).orderBy(F.lit(1)))
    if going.count() + again.count() > rows:  # rows that repeat an id and a text go before the join, most of them where they are read
        kept = keyed.withColumn(nth, once).filter(F.col(nth) == 1).join(first, [key, own])
    else:
        staying = keyed.join(F.broadcast(going.unionByName(again)), [key, own], "left_anti")
        kept = staying.unionByName(keyed.join(F.broadcast(again), [key, own], "left_semi").withColumn(nth, once).filter(F.col(nth) == 1).drop(nth)) if again.count() else staying
    return kept.select(*[kept[c] for c in docs.columns])


def op10_simhash(docs: DataFrame) -> DataFrame:
    return near_fingerprints(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
