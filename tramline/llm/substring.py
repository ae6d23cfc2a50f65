"""Substring dedup: words that repeat what an earlier window of words says are removed, found by difference-cover anchors.

A difference cover D modulo a period holds two members of every difference. So for any two places i and j there is a shift
under the period with i + shift and j + shift both at cover places, and two equal windows hold, at that shift, equal
anchors: words of length window - period + 1 that begin at cover places. Only anchors are hashed over all texts,
4 of 13 places for windows of 20 words; those that occur twice name the windows to look at, and the anchors are extended to whole
windows by 128-bit keys of the words around them. Of equal windows all but the first are marked.

Rows go through shuffles packed, many anchors a row. What repeats within a task is settled there, so that of a very common
passage each task sends one occurrence; equal texts are looked at once, for their smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_pass, bounded_batches, cut, give_back, slices, tidy

WINDOW = 20
#: Perfect difference sets by their period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Occurrences that a task holds before it settles and sends them; code points whose occurrences go to one task.
HELD, CHARS = 1 << 20, 16 << 20
#: Bytes whose words are hashed at once.
PIECE = 1 << 18

_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_PACKED = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("texts", pa.binary()), ("which", pa.binary()), ("places", pa.binary())])
PACKED = "bucket int, n int, keys binary, texts binary, which binary, places binary"

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^k and its inverse^k modulo 2^64, for k under n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 12)
        if have is not None:
            n = max(n, 2 * len(have[0]))
        both = []
        for x in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, x, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = (both[0], both[1])
        if n <= 1 << 22:  # those of a very long text aren't kept
            _powers[base] = have
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_ODD[2])
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_ODD[3])
    return h ^ (h >> np.uint64(32))


def _word_hashes(data: np.ndarray, base: int) -> np.ndarray:
    inside = (data != 32) & ((data - np.uint8(9)) > 4)
    starts = np.flatnonzero(inside & np.r_[True, ~inside[:-1]])
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(base, len(data))
    values = (data.astype(np.uint64) + np.uint64(1)) * inside * up[: len(data)]
    return mixed(np.add.reduceat(values, starts) * down[starts])


def word_hashes(text: bytes, base: int) -> np.ndarray:
    """A hash of each word, in order; words are runs of other bytes than white space, which in UTF-8 is never part of a letter."""
    data, out, at = np.frombuffer(text, dtype=np.uint8), [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data):  # up to white space, however far it is
            some = data[end : end + PIECE]
            gap = np.flatnonzero((some == 32) | ((some - np.uint8(9)) <= 4))
            end += int(gap[0]) if len(gap) else len(some)
            if len(gap):
                break
        out.append(_word_hashes(data[at:end], base))
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def window_hashes(words: np.ndarray, length: int, base: int) -> np.ndarray:
    """A hash of each run of ``length`` words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(base, len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mixed((sums[length:] - sums[:n]) * down[:n])


def cover(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period at which anchors keep a third of the window."""
    period = max(p for p in COVERS if p == 1 or window - p + 1 >= max(1, window // 3))
    return period, COVERS[period]


def anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the anchors at cover places of a text that has a window at all."""
    if len(words) < window:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint32)
    period, members = cover(window)
    hashes = window_hashes(words, window - period + 1, _ODD[0])
    at = np.flatnonzero(np.isin(np.arange(period), members)[np.arange(len(hashes)) % period])
    return hashes[at], at.astype(np.uint32)


def settled(keys: np.ndarray, which: np.ndarray, places: np.ndarray, texts: np.ndarray, later: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, marked, sent) of occurrences (key, text, place): sorted and each once.

    later: of equal keys those go marked that start later, by (id, place); else all of a key that occurs more than
    once. sent: those that other tasks must see, the first of a key and what is equal to it.
    """
    owner = texts[which, 2]
    order = np.lexsort((texts[which, 1], texts[which, 0], places, owner, *keys.T[::-1]))
    k, t, p, o = keys[order], texts[which[order]], places[order], owner[order]
    new = np.r_[True, (k[1:] != k[:-1]).any(axis=1)] if len(k) else np.zeros(0, dtype=bool)
    other = new | np.r_[True, (t[1:] != t[:-1]).any(axis=1) | (p[1:] != p[:-1])] if len(k) else new
    order, k, p, o, new = order[other], k[other], p[other], o[other], new[other]
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    if later:
        marked = (o > o[first[group]]) | (p > p[first[group]]) if len(k) else new
        return order, marked, ~marked
    return order, (np.bincount(group, minlength=1)[group] > 1) if len(k) else new, new


def narrow(x: np.ndarray) -> bytes:
    """Numbers in two bytes each if all fit, else in four."""
    return x.astype("<u2" if int(x.max(initial=0)) < 1 << 16 else "<u4").tobytes()


def wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64)


class Packer:
    """What a task has found and not yet sent.

    Keys of one word are sent as its lower half: the upper one tells the bucket, and as a bucket holds about as many keys at
    any size of the table, few others look equal. They only name more windows to look at.
    """

    def __init__(self, buckets: int, later: bool, width: int):
        self.buckets, self.later, self.width = buckets, later, width
        self._clear()

    def _clear(self) -> None:
        self.texts: dict[tuple, int] = {}
        self.keys, self.which, self.places, self.n = [], [], [], 0

    def add(self, text: tuple[int, int, int], keys: np.ndarray, places: np.ndarray) -> None:
        self.keys.append(keys.reshape(len(places), self.width))
        self.which.append(np.full(len(places), self.texts.setdefault(text, len(self.texts)), dtype=np.uint32))
        self.places.append(places.astype(np.uint32))
        self.n += len(places)

    def flush(self) -> pa.RecordBatch | None:
        if not self.n:
            return None
        texts = np.array(list(self.texts), dtype=np.int64).reshape(-1, 3)
        keys, which, places = np.concatenate(self.keys), np.concatenate(self.which), np.concatenate(self.places)
        self._clear()
        order, marked, sent = settled(keys, which, places, texts, self.later)
        rows = []

        def row(bucket: int, some: np.ndarray, with_keys: bool) -> None:
            few, again = np.unique(which[some], return_inverse=True)
            sent_keys = keys[some].astype("<u4" if self.width == 1 else "<u8").tobytes() if with_keys else b""
            rows.append({"bucket": bucket, "n": len(some), "keys": sent_keys, "texts": texts[few].tobytes(), "which": narrow(again), "places": narrow(places[some])})

        out = order[sent]
        # keys are sorted, so buckets are ranges of them: as many slices
        bucket = ((keys[out, 0] >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)
        ends = np.searchsorted(bucket, np.arange(self.buckets + 1))
        for b in range(self.buckets):
            if ends[b] < ends[b + 1]:
                row(b, out[ends[b] : ends[b + 1]], True)
        known = order[marked]
        if len(known):  # to the buckets of their texts
            home = (texts[which[known], 0].view(np.uint64) >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)
            for b in np.unique(home).tolist():
                row(int(b), known[home == b], False)
        return pa.RecordBatch.from_pylist(rows, schema=_PACKED)


def marks(packed: DataFrame, buckets: int, later: bool, width: int) -> DataFrame:
    """(h1, h2, marks) for each text with marked places: 64 places a bitmap, combined by Spark, as an array of (block, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed, plain, texts, n = ([], [], []), ([], []), [], 0
        for batch in batches:
            for r in range(batch.num_rows):
                many = batch.column(1)[r].as_py()
                k, t = (np.frombuffer(batch.column(c)[r].as_py(), x) for c, x in ((2, "<u4" if width == 1 else "<u8"), (3, "<i8")))
                texts.append(t.reshape(-1, 3))
                where = keyed if len(k) else plain
                where[0].append(wide(batch.column(4)[r].as_py(), many) + n)
                where[1].append(wide(batch.column(5)[r].as_py(), many))
                if len(k):
                    keyed[2].append(k.reshape(-1, width))
                n += len(texts[-1])
        if not texts:
            return
        of = np.concatenate(texts)
        which, places = ([np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in plain])
        if keyed[0]:
            w, p, k = (np.concatenate(x) for x in keyed)
            order, marked, _ = settled(k, w, p, of, later)
            order = order[marked]
            which, places = np.concatenate([which, w[order]]), np.concatenate([places, p[order]])
        if len(which):
            # numbers of texts, so that what several tasks sent of one comes together
            _, number = np.unique(of[:, :2], axis=0, return_inverse=True)
            number, shown = number.ravel(), np.zeros(len(of), dtype=np.int64)
            shown[number] = np.arange(len(of))
            text, block, bit = number[which], places >> 6, np.left_shift(np.int64(1), places & 63)
            order = np.lexsort((block, text))
            text, block, bit = text[order], block[order], bit[order]
            first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (block[1:] != block[:-1])])
            bits = np.bitwise_or.reduceat(bit, first)
            h = of[shown[text[first]]]
            for at in range(0, len(first), 65_536):
                z = slice(at, at + 65_536)
                yield pa.RecordBatch.from_arrays([pa.array(h[z, 0]), pa.array(h[z, 1]), pa.array(block[first][z]), pa.array(bits[z])], names=["h1", "h2", "block", "bits"])
        give_back()

    found = packed.repartitionById(buckets, F.col("bucket")).mapInArrow(run, "h1 long, h2 long, block long, bits long")
    whole = found.groupBy("h1", "h2", "block").agg(F.bit_or("bits").alias("bits"))
    return whole.groupBy("h1", "h2").agg(F.collect_list(F.struct("block", "bits")).alias("marks"))


def _places(column: pa.Array, r: int) -> np.ndarray:
    """The marked places of a row, ascending."""
    if not column[r].is_valid:
        return np.zeros(0, dtype=np.int64)
    own = column[r].values
    block, bits = own.field("block").to_numpy(), own.field("bits").to_numpy()
    set_ = np.unpackbits(bits.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    return np.sort((block[:, None] * 64 + np.arange(64))[set_])


def candidates(places: np.ndarray, n: int, window: int) -> np.ndarray:
    """Starts of the windows of a text of n words that hold an anchor at one of the places."""
    period, _ = cover(window)
    change = np.zeros(n + 2, dtype=np.int32)
    np.add.at(change, np.maximum(places - period + 1, 0), 1)
    np.add.at(change, np.minimum(places, n - window) + 1, -1)
    return np.flatnonzero(np.cumsum(change)[: n - window + 1] > 0)


def covered(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n words a window from one of the starts holds."""
    change = np.zeros(n + 1, dtype=np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return np.cumsum(change)[:n] > 0


def _forget(spark: SparkSession) -> None:
    """Has the shuffles of the pass before deleted: what the first collection frees may hold others."""
    tidy(spark)
    tidy(spark)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, chars: int = CHARS, held: int = HELD) -> DataFrame:
    """(id, n_words, n_removed, kept) for every row: kept has the words that no repeated window covers, joined by one space.

    A window is repeated if its words, as they are, also start earlier: in a row of a smaller id, or in one of the same
    id at an earlier word. So rows of one id with equal texts keep what they have; a window that begins at the same word of two texts of one id is the
    first of both. Null text: no words. Ids are compared as whole numbers; null and other ones come last and count as one id. Very long
    texts are hashed in pieces. Other columns are ignored. Empty table: no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    owner = F.coalesce(F.col(id_col).try_cast("long"), F.lit(2**63 - 1))
    rows = docs.select(F.col(id_col).alias("id"), owner.alias("owner"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))
    sizes = rows.groupBy("h1", "h2").agg(F.min("owner").alias("owner"), F.sum(F.length("text")).alias("chars"))
    firsts = cut(sizes)  # a row for each different text
    total = firsts.agg(F.sum("chars")).first()[0] or 0
    buckets = max(1, -(-total // chars))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets, False, 1)
        for batch in (part for whole in batches for part in slices(whole)):
            h1, h2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for r in range(batch.num_rows):
                if (h1[r], h2[r], 0) in packer.texts:
                    continue
                hashes, places = anchors(word_hashes(batch.column(2)[r].as_buffer().to_pybytes(), _ODD[0]), window)
                packer.add((h1[r], h2[r], 0), hashes, places)
                if packer.n >= held:
                    yield packer.flush()
        if (last := packer.flush()) is not None:
            yield last
        give_back()

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets, True, 2)
        for batch in (part for whole in batches for part in slices(whole)):
            h1, h2, own = (batch.column(c).to_pylist() for c in range(3))
            for r in range(batch.num_rows):
                raw = batch.column(3)[r].as_buffer().to_pybytes()
                both = [word_hashes(raw, base) for base in _ODD[:2]]
                starts = candidates(_places(batch.column(4), r), len(both[0]), window)
                keys = np.stack([window_hashes(w, window, base)[starts] for w, base in zip(both, _ODD)], axis=1)
                packer.add((h1[r], h2[r], own[r]), keys, starts)
                if packer.n >= held:
                    yield packer.flush()
        if (last := packer.flush()) is not None:
            yield last
        give_back()

    frequent = cut(marks(rows.select("h1", "h2", "text").mapInArrow(find, PACKED), buckets, False, 1))
    _forget(spark)
    asked = firsts.select("h1", "h2", "owner").join(frequent, ["h1", "h2"])
    on = ["h1", "h2", "owner"]
    to_extend = rows.select(*on, "text").join(asked.hint("shuffle_hash"), on).select(*on, "text", "marks")
    repeated = cut(marks(to_extend.mapInArrow(extend, PACKED), buckets, True, 2))
    del asked, to_extend
    _forget(spark)

    def keep(batch: pa.RecordBatch) -> dict:
        ids, first, places = batch.column(0), batch.column(2).to_pylist(), batch.column(3)
        n_words, n_removed, kept = [], [], []
        for r in range(batch.num_rows):
            words = batch.column(1)[r].as_buffer().to_pybytes().split()
            n = len(words)
            gone = 0
            if n >= window:
                if not first[r]:  # its text is also that of a smaller id
                    words, gone = [], n
                elif places[r].is_valid:
                    mask = covered(_places(places, r), n, window)
                    gone = int(mask.sum())
                    words = list(compress(words, (~mask).tolist()))
            n_words.append(n)
            n_removed.append(gone)
            kept.append(b" ".join(words))
        return {"id": ids, "n_words": n_words, "n_removed": n_removed, "kept": pa.array(kept, pa.binary()).cast(pa.string())}

    told = firsts.select(*on).join(repeated, ["h1", "h2"], "left").withColumn("first", F.lit(True))
    joined = rows.join(told.hint("shuffle_hash"), on, "left").select("id", "text", F.coalesce("first", F.lit(False)).alias("first"), "marks")
    kind = docs.schema[id_col].dataType.simpleString()
    out = arrow_pass(joined, keep, f"id {kind}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)


def op11_substring_dedup(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
