"""Byte-level BPE encoding and decoding: overlapping chunks, stitched where their pre-tokens fall into step."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, cut, join_bounded

#: Code points of a chunk that a task of its own reads, and how far each chunk reads into the next.
CHUNK, OVERLAP = 32_768, 1_024
#: The same of the chunks of a text that one task reads: most texts have several.
WITHIN, WITHIN_OVERLAP = 1_024, 128
#: Boundaries this near to a chunk's end may differ in the whole text (a contraction is three characters); a piece is read with so many characters behind it.
MARGIN = 4
#: Rows of one long text that get its ids in one task.
SPLIT = 1_000
#: Characters of white space in a row, of which twice as many are kept from the library's splitter.
BLANK = 2_048
#: Stands for a character that is neither letter, digit nor white space.
OTHER = "\ue000"

_known: dict[str, Codec] = {}


class Codec:
    """Pre-tokens by the public pattern, each merged by the ranks on its own.

    The library's splitter of whole texts overflows its stack on a long run of white space, and tells no boundaries; so
    these, and the matches of such a text, come from another engine. Its letters and digits are of a newer Unicode: the characters
    on which the two differ are asked of the library once, and taken as it does.
    """

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.others = _classed_otherwise()
        self.least = min(map(chr, self.others), default=chr(0x10FFFF))

    def _plain(self, text: str) -> str:
        """The text with the library's classes, character for character."""
        return text if text.isascii() or max(text) < self.least else text.translate(self.others)

    def ends(self, text: str) -> list[int]:
        """Ends of the matches. The pattern fits every character, so they are the starts too."""
        return [m.end() for m in self.pattern.finditer(self._plain(text))]

    def encode(self, text: str, size: int | None = None) -> list[int]:
        """Ids of the matches that begin before ``size``; the library's own splitter finds them but where it can't be trusted with what is there."""
        size = len(text) if size is None else min(size, len(text))
        if not (size < len(text) and size and text[size - 1].isspace()) and not self._blank(text):
            return self.library.encode_ordinary(text[:size])
        out: list[int] = []
        for m in self.pattern.finditer(self._plain(text)):
            if m.start() >= size:
                break
            out += self.library._encode_single_piece(text[m.start() : m.end()].encode("utf-8", "replace"))
        return out

    @staticmethod
    def _blank(text: str) -> bool:
        """Whether a run of white space is as long as two of these steps, at least."""
        return any(text[k : k + BLANK].isspace() for k in range(0, len(text) - BLANK + 1, BLANK))

    def decode(self, ids: list[int]) -> bytes:
        return self.library.decode_bytes(ids)


def _classed_otherwise() -> dict[int, str]:
    """Characters that the pattern's engine takes for letters or digits and the library doesn't; it drops what a pattern doesn't fit."""
    single = {bytes([k]): k for k in range(256)}
    classes = [(regex.compile(name), tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={}), name == r"\s") for name in (r"\p{L}", r"\p{N}", r"\s")]
    out: dict[int, str] = {}
    for start in range(0, 0x110000, 0x1000):
        some = "".join(chr(c) for c in range(start, start + 0x1000) if not 0xD800 <= c < 0xE000)
        for pattern, library, exact in classes:
            ours, theirs = set(pattern.findall(some)), set(bytes(library.encode_ordinary(some)).decode())
            if theirs - ours or (exact and ours != theirs):
                raise ValueError("the library knows letters that the pattern's engine doesn't")
            out |= {ord(c): OTHER for c in ours - theirs}
    return out


def encoding(path: str) -> Codec:
    """The encoding by a rank file, read once a process; only the merges come from the library."""
    if path not in _known:
        _known[path] = Codec(path)
    return _known[path]


def boundaries(codec: Codec, text: str) -> list[int]:
    """Ends of the pre-tokens of text but the last, whose end the text's end may have made."""
    return [x for x in codec.ends(text) if x < len(text)]


def agreed(left: list[int], right: list[int], low: int, high: int) -> int | None:
    """First position in (low, high] where both chunks have a boundary: from there on they go in step."""
    there = set(right)
    return next((x for x in left if low < x <= high and x in there), None)


def stitch(cuts: list[int | None], length: int) -> list[tuple[int, int]]:
    """Pieces between agreed cuts; chunks that a pre-token spans have none, and their piece goes on to the next.

    Such a later cut is one of the whole text's, too: a match is a run of one class of characters, but for a blank before it and
    for a contraction, so from a chunk's second match on its boundaries are those of the text.
    """
    at, out = 0, []
    for x in cuts:
        if x is not None:
            out.append((at, x))
            at = x
    return [*out, (at, length)]


def pieces(codec: Codec, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """One text's pieces, its chunks pre-tokenised one by one."""
    if len(text) <= chunk:
        return [(0, len(text))]
    ends = [[k + x for x in boundaries(codec, text[k : k + chunk + overlap])] for k in range(0, len(text), chunk)]
    cuts = [agreed(a, b, k, k + overlap - MARGIN) for k, a, b in zip(range(chunk, len(text), chunk), ends, ends[1:])]
    return stitch(cuts, len(text))


def encode_text(text: str, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    codec = encoding(path)
    return [i for a, b in pieces(codec, text, chunk, overlap) for i in codec.encode(text[a : b + MARGIN], b - a)]


def _long_ids(docs: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(key, ids) for each different text of more than one chunk, its chunks in tasks of their own.

    Chunks are pre-tokenised in parallel and give their boundaries in the overlaps; a text's cuts
    come from these short lists; then the pieces are encoded in parallel and joined in order.
    """
    spark = docs.sparkSession
    different = docs.groupBy("key").agg(F.first("text").alias("text"))
    rows = different.select("key", "text", F.length("text").alias("length"))
    parts = max(2, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = cut(rows)

    def split(batch: pa.RecordBatch) -> dict:
        each = [(key, n, k, text[k * chunk : (k + 1) * chunk + overlap]) for key, text, n in zip(*(c.to_pylist() for c in batch.columns)) for k in range(-(-n // chunk))]
        return {name: [x[i] for x in each] for i, name in enumerate(("key", "length", "k", "part"))}

    def scan(batch: pa.RecordBatch) -> dict:
        codec = encoding(path)
        starts, ends = [], []
        for k, part in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            b = boundaries(codec, part)
            starts.append([k * chunk + x for x in b if x <= overlap])
            ends.append([k * chunk + x for x in b if chunk < x <= chunk + overlap - MARGIN])
        return {"key": batch.column(0), "length": batch.column(1), "k": batch.column(2), "starts": starts, "ends": ends}

    chunks = arrow_pass(rows, split, "key string, length int, k int, part string")
    found = arrow_pass(chunks.repartition(parts, "key", "k"), scan, "key string, length int, k int, starts array<int>, ends array<int>")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        cuts = [agreed(list(a), list(b), (k + 1) * chunk, (k + 1) * chunk + overlap - MARGIN) for k, a, b in zip(pdf.k, pdf.ends, pdf.starts[1:])]
        spans = stitch(cuts, int(pdf.length.iloc[0]))
        return pd.DataFrame({"key": pdf.key.iloc[0], "spans": [[x for span in spans for x in span]]})

    spans = found.groupBy("key").applyInPandas(join, "key string, spans array<int>")

    def part(batch: pa.RecordBatch) -> dict:
        each = [(key, k, spans[k + 1] - spans[k], text[spans[k] : spans[k + 1] + MARGIN]) for key, text, spans in zip(*(c.to_pylist() for c in batch.columns)) for k in range(0, len(spans), 2)]
        return {name: [x[i] for x in each] for i, name in enumerate(("key", "k", "size", "piece"))}

    def encode(batch: pa.RecordBatch) -> dict:
        codec = encoding(path)
        return {"key": batch.column(0), "k": batch.column(1), "ids": [codec.encode(x, n) for n, x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]}

    each = arrow_pass(rows.join(spans, "key").select("key", "text", "spans"), part, "key string, k int, size int, piece string")
    ids = arrow_pass(each.repartition(parts, "key", "k"), encode, "key string, k int, ids array<int>")
    return ids.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))


def digest(ids: list[int]) -> str:
    return hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest()


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, with_ids: bool = True) -> DataFrame:
    """keep, n_tokens, ids_sha256, decoded_sha256 and, on demand, ids for every row of (…, text).

    Null and empty texts have no ids. Texts of more than one chunk go through chunk tasks, once for
    each different text; others are cut into smaller chunks, stitched and encoded where they are read. A single match of the pattern, however
    long, is merged in one task. Repeated rows each give a row.
    Empty table: no rows. Other columns than keep and text are not read.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    out = f"{fields}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    n = len(keep)

    def digests(batch: pa.RecordBatch, lists: list[list[int]], names: tuple[str, ...] = keep, at: list[int] | None = None) -> dict:
        """lists: a batch's different ids, at: which of them each row has; by default one a row."""
        codec, at = encoding(path), range(len(lists)) if at is None else at
        made = {"n_tokens": [len(x) for x in lists], "ids_sha256": [digest(x) for x in lists], "decoded_sha256": [hashlib.sha256(codec.decode(x)).hexdigest() for x in lists], "ids": lists}
        return {name: batch.column(k) for k, name in enumerate(names)} | {k: [v[i] for i in at] for k, v in made.items()}

    def short(batch: pa.RecordBatch) -> dict:
        texts = batch.column(n).to_pylist()
        place = {x: k for k, x in enumerate(dict.fromkeys(texts))}  # a text that is there several times is encoded once
        return digests(batch, [encode_text(x, path, min(WITHIN, chunk), min(WITHIN_OVERLAP, overlap)) for x in place], at=[place[x] for x in texts])

    def long(batch: pa.RecordBatch) -> dict:
        return digests(batch, batch.column(1).to_pylist(), ("_key",))

    is_long = F.length("_text") > chunk
    long_rows = rows.filter(is_long).withColumn("_key", F.sha2("_text", 256))
    ids = _long_ids(long_rows.select(F.col("_key").alias("key"), F.col("_text").alias("text")), path, chunk, overlap)
    done = arrow_pass(ids, long, "_key string" + out[len(fields) :])
    found = _to_rows(long_rows.drop("_text"), done, keep).select(*keep, *[c for c in done.columns if c != "_key"])
    return arrow_pass(rows.filter(~is_long), short, out).unionByName(found)


def _to_rows(rows: DataFrame, done: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Gives each row what was found for its text. A text of more than SPLIT rows is repeated for each so many, and its rows are dealt over the repeats."""
    rows = cut(rows)
    hot = rows.groupBy("_key").agg(F.count("*").alias("_n")).filter(F.col("_n") > SPLIT).select("_key", F.ceil(F.col("_n") / SPLIT).cast("int").alias("_parts"))
    spread = F.xxhash64(*keep)
    rows = join_bounded(rows, hot, "_key", spread).withColumn("_at", F.pmod(spread, F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    done = join_bounded(done, hot, "_key", F.col("n_tokens")).withColumn("_to", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts").withColumnRenamed("_key", "_done")
    return rows.join(done, (rows["_key"] == done["_done"]) & (rows["_at"] == done["_to"])).drop("_key", "_done", "_at", "_to")


def decode(ids: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, bytes): the tokens' raw bytes, one after another. Null ids give empty bytes."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def step(batch: pa.RecordBatch) -> dict:
        codec = encoding(path)
        return {id_col: batch.column(0), "bytes": [codec.decode(x or []) for x in batch.column(1).to_pylist()]}

    return arrow_pass(ids.select(id_col, ids_col), step, f"`{id_col}` {ids.schema[id_col].dataType.simpleString()}, bytes binary")


def op3_byte_bpe(docs: DataFrame) -> DataFrame:
    return encode(docs, with_ids=False)
