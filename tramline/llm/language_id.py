"""Language ID: per-language unigram models over a fixed vocabulary of pieces, summed over all segmentations."""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass

#: Documents a language is learned from at most (about: hashes of ids choose them), and rounds of EM.
SAMPLE, ROUNDS = 400, 3
#: Longer words are learned from in parts of so many characters.
LEARNED = 200
#: Added to each piece's expected count.
SMOOTH = 0.01
#: Words of more characters are scored one by one, over their pieces at once, the others by lengths.
SHORT = 64
#: Words whose scores a process keeps.
CACHE = 150_000
#: Mark of a word's start in the vocabulary.
START = "▁"
UNKNOWN = "und"
#: Sums below are scaled up by as much.
SMALL = 1e-100

def _marks() -> str:
    """All combining marks, as ranges for a class of a pattern."""
    own = [k for k in range(sys.maxunicode + 1) if unicodedata.category(chr(k))[0] == "M"]
    starts = [k for k, before in zip(own, [-2, *own]) if k != before + 1]
    ends = [k for k, after in zip(own, [*own[1:], -2]) if after != k + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))


#: A word is a run of letters with their marks: vowel signs and accents belong to their letters. Digits and other characters tell of no language, but of
#: numbers and keys: scored too, they cost accuracy.
WORD = re.compile(rf"[^\W\d_](?:[^\W\d_]|[{_marks()}])*")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> frozenset[str]:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return frozenset(model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


_BASE, _SPREAD, _BITMAP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 18


def _rolling(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(_BASE) + ord(c) + 1) & (1 << 64) - 1
    return h


def _slot(h: np.ndarray) -> np.ndarray:
    return (h * _SPREAD) >> np.uint64(64 - _BITMAP)


def _codes(parts: list[str]) -> np.ndarray:
    """A row of character codes for each part; all have one length."""
    return np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(parts), -1).astype(np.uint64)


class Pieces:
    """Numbers of pieces, found by a rolling hash of their characters: in a bitmap first, then in the sorted hashes."""

    def __init__(self, names: list[str]):
        hashes = np.array([_rolling(n) for n in names], dtype=np.uint64)
        self.order = hashes.argsort()
        self.hashes = hashes[self.order]
        self.longest = max(map(len, names), default=1)
        self.bitmap = np.zeros(1 << _BITMAP, dtype=bool)
        self.bitmap[_slot(hashes)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of the piece with each hash, -1 where there is none."""
        out = np.full(h.shape, -1, dtype=np.int64)
        at = np.flatnonzero(self.bitmap[_slot(h)])
        if len(self.hashes):
            place = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            out[at] = np.where(self.hashes[place] == h[at], self.order[place], -1)
        return out


def fit(words: Counter, pieces: frozenset[str], rounds: int = ROUNDS) -> dict[str, float]:
    """Log probabilities of pieces by EM over all segmentations of the words; the key '' is for unseen ones.

    A single character is a piece always. Words of one length are taken together: forward and backward sums go over
    all their segmentations in logarithms, as products over long words would vanish.
    """
    parts: Counter = Counter()
    for word, n in words.items():
        whole = START + word
        for k in range(0, len(whole), LEARNED + 1):
            parts[whole[k : k + LEARNED + 1]] += n
    names = sorted(pieces | set("".join(parts)))
    known = Pieces(names)
    lengths: dict[int, list[str]] = {}
    for part in sorted(parts):
        lengths.setdefault(len(part), []).append(part)
    groups = []
    for n, own in sorted(lengths.items()):
        for k in range(0, len(own), 8_192):
            some = own[k : k + 8_192]
            codes, spans = _codes(some), []
            for j in range(n):
                h = np.zeros(len(some), dtype=np.uint64)
                for i in range(j + 1, min(n, j + known.longest) + 1):
                    h = h * _BASE + codes[:, i - 1] + np.uint64(1)
                    number = known.find(h)
                    at = np.flatnonzero(number >= 0)
                    if len(at):
                        spans.append((j, i, at, number[at]))
            groups.append((n, np.array([parts[x] for x in some], dtype=np.float64), spans))
    counts = np.zeros(len(names))
    for _, weight, spans in groups:
        for _, _, at, number in spans:
            counts += np.bincount(number, weights=weight[at], minlength=len(names))
    for _ in range(rounds):
        with np.errstate(divide="ignore"):
            p = np.log(counts / max(counts.sum(), 1e-300))
        counts = np.zeros(len(names))
        for n, weight, spans in groups:
            ahead, back = (np.full((n + 1, len(weight)), -np.inf) for _ in range(2))
            ahead[0] = back[n] = 0.0
            for j, i, at, number in spans:  # by starts
                ahead[i, at] = np.logaddexp(ahead[i, at], ahead[j, at] + p[number])
            for j, i, at, number in reversed(spans):
                back[j, at] = np.logaddexp(back[j, at], back[i, at] + p[number])
            for j, i, at, number in spans:
                share = np.exp(ahead[j, at] + p[number] + back[i, at] - ahead[n, at])
                counts += np.bincount(number, weights=weight[at] * share, minlength=len(names))
    seen = np.flatnonzero(counts > 1e-3)
    total = counts[seen].sum() + SMOOTH * (len(pieces) + 1)
    return {names[k]: math.log((counts[k] + SMOOTH) / total) for k in seen} | {"": math.log(SMOOTH / total)}


class Model:
    """Scores texts against all languages at once; word scores are kept, as texts repeat their words."""

    def __init__(self, table: dict[str, dict[str, float]]):
        self.langs = sorted(table)
        names = sorted({p for t in table.values() for p in t if p})
        #: The last row is for a character that is no piece.
        self.p = np.array([*([math.exp(table[x].get(n, table[x][""])) for x in self.langs] for n in names), [math.exp(table[x][""]) for x in self.langs]]).reshape(1 + len(names), len(self.langs))
        self.known = Pieces(names)
        self._reset()

    def _reset(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((4_096, len(self.langs)), dtype=np.float64)

    def forward(self, parts: list[str]) -> np.ndarray:
        """Log probability of each part in each language: the sums over their segmentations. All parts have one length.

        Sums that get small are scaled up, with what is still to be added to them.
        """
        codes = _codes(parts)
        n, longest = codes.shape[1], self.known.longest
        ahead = np.zeros((n + longest + 1, len(parts), len(self.langs)))
        ahead[0] = 1.0
        scale = np.zeros((len(parts), len(self.langs)))
        for j in range(n):
            low = ahead[j] < SMALL
            if low.any():
                ahead[j : j + longest] *= np.where(low, 1 / SMALL, 1.0)
                scale += np.where(low, math.log(SMALL), 0.0)
            h = np.zeros(len(parts), dtype=np.uint64)
            for i in range(j + 1, min(n, j + longest) + 1):
                h = h * _BASE + codes[:, i - 1] + np.uint64(1)
                number = self.known.find(h)
                at = np.flatnonzero(number >= 0) if i > j + 1 else np.arange(len(parts))
                ahead[i, at] += ahead[j, at] * self.p[number[at]]
        return np.log(ahead[n]) + scale

    def forward_long(self, part: str) -> np.ndarray:
        """The same for a single part of any length, whose pieces are found a block at a time."""
        n, longest, block = len(part), self.known.longest, 4_096
        last = np.zeros((longest, len(self.langs)))  # sums of the last places, the newest first
        last[0] = 1.0
        scale = np.zeros(len(self.langs))
        for begin in range(0, n, block):
            end = min(n, begin + block)
            first = max(0, begin - longest + 1)
            codes = _codes([part[first:end]])[0]
            p = np.zeros((end - begin, longest, len(self.langs)))
            h = np.zeros(len(codes), dtype=np.uint64)
            for size in range(1, min(longest, len(codes)) + 1):  # h[k]: of the characters from k on, so many
                h = h[: len(codes) - size + 1] * _BASE + codes[size - 1 :] + np.uint64(1)
                number = self.known.find(h)
                at = np.flatnonzero(number >= 0) if size > 1 else np.arange(len(h))
                ends = at + first + size - begin - 1
                at, ends = at[ends >= 0], ends[ends >= 0]
                p[ends, size - 1] = self.p[number[at]]
            for row in p:
                new = (row * last).sum(axis=0)
                last[1:] = last[:-1]
                last[0] = new
                if new.min() < SMALL:
                    low = new < SMALL
                    last *= np.where(low, 1 / SMALL, 1.0)
                    scale += np.where(low, math.log(SMALL), 0.0)
        return np.log(last[0]) + scale

    def learn_words(self, words: list[str]) -> None:
        """Scores words that are not known yet, those of one length together."""
        first = len(self.place)
        while first + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        by_length: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            self.place[word] = first + k
            if len(word) > SHORT:
                self.rows[first + k] = self.forward_long(START + word)
            else:
                by_length.setdefault(len(word), []).append(k)
        for own in by_length.values():
            for s in range(0, len(own), 4_096):
                some = own[s : s + 4_096]
                self.rows[[first + k for k in some]] = self.forward([START + words[k] for k in some])

    def scores(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Log likelihoods of each text, or None for one without a letter."""
        if len(self.place) > CACHE:
            self._reset()
        found = [words_of(t) if t else [] for t in texts]
        new: set[str] = set()
        for words in found:
            new |= set(words).difference(self.place)
        if new:
            self.learn_words(sorted(new))
        get = self.place.__getitem__
        return [self.rows[list(map(get, words))].sum(axis=0) if any(c.isalpha() for w in words for c in w) else None for words in found]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = []
        for found in self.scores(texts) if self.langs else [None] * len(texts):
            if found is None:
                out.append((UNKNOWN, 0.0))
            else:
                share = np.exp(found - found.max())
                out.append((self.langs[int(found.argmax())], float(share.max() / share.sum())))
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, sample: int = SAMPLE, path: str | None = None) -> dict[str, dict[str, float]]:
    """Language to piece to log probability, learned in one task for each language.

    Documents with a text, a lang and an id whose crc32 leaves no remainder 2 by 4. Of each language about
    ``sample`` are taken, by a hash of the id and the text: under the share that gives as many, all if there are
    fewer. The result has a vocabulary's pieces, and the single characters seen, for each language. A null
    text, lang or id takes no part, nor does a text without letters; a language of such texts only is not learned. Repeated
    rows count each, and are sent as one. Empty table: no languages.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}
    shares = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, math.ceil(min(1.0, sample / n) * (1 << 20)))])
    picked = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.element_at(shares, F.col("lang")))
    picked = picked.groupBy("lang", "doc_id", "text").count()

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        words: Counter = Counter()
        own = pdf.sort_values(["text", "doc_id"])
        for text, n in zip(own.text, own["count"]):
            for word in words_of(text):
                words[word] += n
        found = fit(words, vocabulary(path))
        return pd.DataFrame({"lang": pdf.lang.iloc[0], "piece": list(found), "p": list(found.values())})

    out: dict[str, dict[str, float]] = {}
    dealt = picked.repartition(2 * len(counts), "lang")  # a number of its own, so that languages aren't put together again
    for r in dealt.groupBy("lang").applyInPandas(train, "lang string, piece string, p double").collect():
        out.setdefault(r["lang"], {})[r["piece"]] = r["p"]
    return {k: v for k, v in out.items() if len(v) > 1}


def identify(docs: DataFrame, model: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of (doc_id, text, lang).

    score is the language's share of the likelihood, all languages being equally likely before.
    A null text, or one without a letter, is und with score 0, and so is all if no language could
    be learned. Equal likelihoods go to the smaller name. A null doc_id is not held out and is not
    learned from. Repeated rows each give a row. Empty table: no rows.
    """
    table = learn(docs) if model is None else model
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def step(batch: pa.RecordBatch) -> dict:
        known = _model(sent)
        found = known.predict(batch.column(2).to_pylist())
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": [a for a, _ in found], "score": [b for _, b in found]}

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return arrow_pass(rows, step, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without those that are und or whose best language has less than the given share.

    Null, empty and letterless texts go, and so do all if no language could be learned. Repeated rows
    stay repeated; other columns stay as they are. Empty table: no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs))
    names = docs.columns

    def step(batch: pa.RecordBatch) -> dict:
        known = _model(sent)
        found = known.predict(batch.column(names.index("text")).to_pylist())
        kept = batch.filter(pa.array([p != UNKNOWN and s >= least for p, s in found], pa.bool_()))
        return {n: kept.column(k) for k, n in enumerate(names)}

    return arrow_pass(docs, step, docs.schema)


#: The table that the process's model was made of, and the model.
_held: list = [None, None]


def _model(sent) -> Model:
    """The process's model for a broadcast table, which is held with it: another table can't be taken for it."""
    value = sent.value
    if _held[0] is not value:
        _held[:] = [value, Model(value)]
    return _held[1]


def op6_language_id(docs: DataFrame) -> DataFrame:
    return identify(docs)
