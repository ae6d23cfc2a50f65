"""Document fingerprints: a multiset hash of a text's paragraphs that sums of vectors keep up to date.

A fingerprint is a sum of one wide vector for each paragraph, modulo powers of two: EXACT words of
64 bits hashed from the paragraph's bytes, and SKETCH words of 32 bits to which each word
shingle of the paragraph adds 1 or -1 at a hashed place. Sums don't depend on the order, and a paragraph
goes in or out by adding or subtracting its vector. The first part tells equality; the second keeps
inner products, from which the likeness of two texts is told.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded_batches

EXACT, SKETCH, SHINGLE = 8, 128, 3
BYTES = 8 * EXACT + 4 * SKETCH
#: Parts that the rows are dealt over in order of their ids: as many as the input has, within these bounds.
PARTS, MOST_PARTS = 256, 16_384

_seen: dict[str, int] = {}
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _word_hash(word: str) -> int:
    h = _seen.get(word)
    if h is None:
        if len(_seen) >= 500_000:
            _seen.clear()
        h = _seen[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"), 4)
    return h


class Fingerprint:
    """exact: uint64 words modulo 2^64; sketch: int32 words modulo 2^32."""

    __slots__ = ("exact", "sketch")

    def __init__(self, exact: np.ndarray | None = None, sketch: np.ndarray | None = None):
        self.exact = np.zeros(EXACT, dtype=np.uint64) if exact is None else exact
        self.sketch = np.zeros(SKETCH, dtype=np.int32) if sketch is None else sketch

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact + other.exact, self.sketch + other.sketch)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact - other.exact, self.sketch - other.sketch)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and self.to_hex() == other.to_hex()

    def to_hex(self) -> str:
        return self.exact.astype("<u8").tobytes().hex() + self.sketch.astype("<i4").tobytes().hex()

    @staticmethod
    def from_hex(text: str) -> Fingerprint:
        raw = bytes.fromhex(text)
        return Fingerprint(np.frombuffer(raw, "<u8", EXACT).copy(), np.frombuffer(raw, "<i4", SKETCH, 8 * EXACT).copy())


def of_paragraphs(paragraphs: list[str]) -> Fingerprint:
    """The sum over the paragraphs, computed at once."""
    digests = b"".join(hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=8 * EXACT).digest() for p in paragraphs)
    exact = np.frombuffer(digests, dtype="<u8").reshape(-1, EXACT).sum(axis=0, dtype=np.uint64)
    words = [p.split() for p in paragraphs]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    seen = _seen
    h = np.array([seen[w] if w in seen else _word_hash(w) for ws in words for w in ws], dtype=np.uint64)
    if not len(h):
        return Fingerprint(exact)
    # shingles of three words within a paragraph; a shorter paragraph is one shingle
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place, size = np.arange(len(h)) - first, np.repeat(sizes, sizes)
    pad = np.zeros(SHINGLE - 1, dtype=np.uint64)
    follow = np.concatenate([h, pad])
    mixed = np.zeros(len(h), dtype=np.uint64)
    for k in range(SHINGLE):
        mixed += np.where(place + k < size, follow[k : k + len(h)], 0).astype(np.uint64) * _ODD[k]
    mixed = mixed[(place + SHINGLE <= size) | (place == 0)]
    mixed ^= mixed >> np.uint64(31)
    mixed *= _ODD[1]
    mixed ^= mixed >> np.uint64(29)
    where = (mixed >> np.uint64(40)) % np.uint64(SKETCH)
    sign = np.where(mixed & np.uint64(1), 1.0, -1.0)
    sketch = np.bincount(where.astype(np.int64), weights=sign, minlength=SKETCH).astype(np.int64).astype(np.int32)
    return Fingerprint(exact, sketch)


def of_text(text: str) -> Fingerprint:
    """Paragraphs are the text's lines; the empty text has none."""
    return of_paragraphs(text.split("\n")) if text else Fingerprint()


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """1 for equal fingerprints, else the cosine of the sketches, from 0 to 1 (0 for texts without words)."""
    if np.array_equal(a.exact, b.exact) and np.array_equal(a.sketch, b.sketch):
        return 1.0
    x, y = a.sketch.astype(np.float64), b.sketch.astype(np.float64)
    size = math.sqrt(float(x @ x) * float(y @ y))
    return min(1.0, max(0.0, float(x @ y) / size)) if size else 0.0


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the following text's first."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def of_edited(text: str, own: Fingerprint, new: str) -> Fingerprint:
    """The fingerprint of new from that of text: the paragraphs from the first different one on go out, and the new ones come in.

    new begins with at least the first half of text, as edited() makes it; so about half of the paragraphs are hashed anew.
    """
    if not text or not new:
        return of_text(new)
    same = text.count("\n", 0, len(text) - len(text) // 2)
    return own - of_paragraphs(text.split("\n")[same:]) + of_paragraphs(new.split("\n")[same:])


def _dealt(docs: DataFrame, parts: int) -> DataFrame:
    """(doc_id, oid, hash, text, part, guest), each part a range of ids, followed by a copy of the next part's first row.

    The bounds come from an aggregate over the ids and so hold for every task that is run again. An id that fills several
    parts by itself is dealt over as many by ranges of its texts' hashes, in which its rows go. Heads are the first row
    of each part that has rows: as many as parts, and so broadcast.
    """
    oid = F.coalesce(F.col("doc_id").try_cast("long"), F.lit(-(2**63)))
    spark = docs.sparkSession
    found = docs.select(oid.alias("o")).agg(F.percentile_approx("o", F.from_json(F.lit(json.dumps([k / parts for k in range(1, parts)])), "array<double>"), F.lit(max(20_000, 8 * parts))).alias("b")).first()["b"]
    times = Counter(found or [])
    bounds = sorted(times)
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    hot = {o: n for o, n in times.items() if n > 1}
    most = max(hot.values(), default=0) + 1

    def part(o, h):
        """Bounds below o, counted in two steps; parts go by descending id, and in a part its greatest id goes first."""
        if not groups:
            return F.lit(0).cast("long")
        tops = F.from_json(F.lit(json.dumps([g[-1] for g in groups])), "array<bigint>")
        each = F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>")
        coarse = F.size(F.filter(tops, lambda x: x < o))
        fine = F.coalesce(F.size(F.filter(F.element_at(each, F.least(coarse + 1, F.lit(len(groups)))), lambda x: x < o)), F.lit(0))
        below = F.when(coarse < len(groups), coarse * step + fine).otherwise(F.lit(len(bounds)))
        if not hot:
            return (F.lit(len(bounds)) - below).cast("long")
        many = F.element_at(F.create_map(*[F.lit(x) for item in sorted(hot.items()) for x in item]), o)
        # the hash's high bits as a number from 0 to 2^32, so that ranges of it are parts in order
        within = F.when(many.isNull(), most - 1).otherwise(F.floor((F.shiftright(h, 32) + F.lit(1 << 31)) * many / F.lit(float(1 << 32))))
        return ((F.lit(len(bounds)) - below) * most + within).cast("long")

    placed = docs.select("doc_id", oid.alias("oid"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    placed = placed.withColumn("part", part(F.col("oid"), F.col("hash")))
    first = placed.groupBy("part").agg(F.min(F.struct(F.bitwise_not("oid").alias("later"), "hash")).alias("head"))
    heads = sorted((r["part"], ~r["head"]["later"], r["head"]["hash"]) for r in first.collect())
    guests = [(*heads[(k + 1) % len(heads)][1:], p) for k, (p, _, _) in enumerate(heads)]
    table = F.broadcast(spark.createDataFrame(guests or [(0, 0, 0)], "head long, head_hash long, host long"))
    both = placed.join(table, (placed["oid"] == table["head"]) & (placed["hash"] == table["head_hash"]), "left")
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("guest"))
    visit = F.struct(F.col("host").alias("part"), F.lit(True).alias("guest"))
    return both.select("doc_id", "oid", "hash", "text", F.explode(F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, visit))).alias("x")).select("doc_id", "oid", "hash", "text", "x.part", "x.guest")


def compare_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The next document is the one below in descending doc_id, after the last the first; equal ids go
    by a hash of their text and the text, and null ids come last, as do ids that are no whole numbers. The only row of a
    table follows itself. Null text reads as empty. Rows of one id and one text are read by one task, those of one id by as many
    as they fill. Empty table: no rows.
    """
    bounded_batches(docs.sparkSession)
    parts = parts or min(MOST_PARTS, max(PARTS, docs.rdd.getNumPartitions()))
    dealt = _dealt(docs, parts)
    rows = dealt.repartition(parts, "part").sortWithinPartitions("part", "guest", F.desc("oid"), "hash", "text").select("doc_id", "text", "part", "guest")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # part, id, text, fingerprint of the row whose next is still to come
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, part, guest in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                text = text.as_py()
                if guest and (held is None or held[0] != part):
                    continue  # a tie of the guest that was used
                mark = of_text(text)
                if held is not None and held[0] == part:
                    _, before, old, own = held
                    new = edited(old, text)
                    other = of_edited(old, own, new)
                    out.append((before, len(old), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own.to_hex(), other.to_hex(), likeness(own, other), likeness(own, mark)))
                held = None if guest else (part, doc_id.as_py(), text, mark)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)

    types = [to_arrow_type(docs.schema["doc_id"].dataType), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return rows.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op4_fingerprints(docs: DataFrame) -> DataFrame:
    return compare_next(docs)
