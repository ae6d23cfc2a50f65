"""Secret scans: fixed patterns, and probabilistic automata inferred from labelled credentials."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass

# Fixed patterns. Groups of assign: the name, the value. ASCII keeps letters like the Kelvin sign out of "either case".
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones need no look
LEAST = {"assign": 6, "access": 20, "hex": 24}
BASE = ("assign", "access", "hex")

#: Where credentials are looked for: runs of these characters of at least this length.
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{20,}")
#: Bits by which a format must explain a candidate better than running text does.
THRESHOLD = 24.0
#: Labelled credentials a format is learned from, and the test statistic (chi squared, one degree) under which states merge: one in a thousand.
SAMPLES, ALPHA, SEED = 800, 10.83, 11
#: Bits that an end costs where the format could go on.
GOING = 8.0
#: Bits that a character of its own costs at a state, and another class than that of the state before.
EDGE, CHANGE = 16.0, 24.0

_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_ALNUM, _HEX = _UPPER + _LOWER + _DIGIT, _DIGIT + "abcdef"
_URL = _ALNUM + "_-"
ALNUM = frozenset(_ALNUM)
#: Published credential formats: kind, then in turn texts of which one is drawn, and (alphabet, least length, most).
FORMATS = (
    ("digitalocean", ("dop_v1_", "doo_v1_", "dor_v1_"), (_HEX, 64, 64)),
    ("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), (_ALNUM, 36, 36)),
    ("github_fine", ("github_pat_",), (_ALNUM, 22, 22), ("_",), (_ALNUM, 59, 59)),
    ("gitlab", ("glpat-",), (_URL, 20, 20)),
    ("google", ("AIza",), (_URL, 35, 35)),
    ("huggingface", ("hf_",), (_UPPER + _LOWER, 34, 34)),
    ("jwt", ("eyJhbGciOi",), (_URL, 14, 40), (".eyJ",), (_URL, 30, 120), (".",), (_URL, 43, 43)),
    ("mailgun", ("key-",), (_HEX, 32, 32)),
    ("npm", ("npm_",), (_ALNUM, 36, 36)),
    ("pypi", ("pypi-AgEIcHlwaS5vcmc",), (_URL, 70, 130)),
    ("sendgrid", ("SG.",), (_URL, 22, 22), (".",), (_URL, 43, 43)),
    ("shopify", ("shpat_", "shpca_", "shppa_", "shpss_"), (_HEX, 32, 32)),
    ("slack", ("xoxb-", "xoxp-", "xoxa-"), (_DIGIT, 10, 13), ("-",), (_DIGIT, 10, 13), ("-",), (_ALNUM, 24, 32)),
    ("stripe", ("sk_live_", "sk_test_", "rk_live_", "rk_test_"), (_ALNUM, 24, 34)),
    ("twilio", ("SK", "AC"), (_HEX, 32, 32)),
)


def labelled_credentials(samples: int = SAMPLES, seed: int = SEED) -> list[tuple[str, str]]:
    """(kind, credential) drawn from the published formats."""
    rng = random.Random(seed)
    draw = lambda x: rng.choice(x) if isinstance(x[-1], str) else "".join(rng.choices(x[0], k=rng.randint(*x[1:])))
    return [(kind, "".join(map(draw, parts))) for kind, *parts in FORMATS for _ in range(samples)]


#: Classes of characters from the smallest; the last has all that a run may have.
CLASSES = tuple(frozenset(x) for x in (_DIGIT, _HEX, _LOWER, _UPPER, _DIGIT + _LOWER, _DIGIT + _UPPER, _LOWER + _UPPER, _ALNUM, _URL, _ALNUM + "+/=", _URL + "+/=."))


def _symbols(chars: Counter, usual: int | None) -> tuple[set[str], int | None]:
    """The characters told one by one and the class of the others that take the fewest bits; usual is the class of the state before."""
    n = sum(chars.values())
    best: tuple[float, set[str], int | None] | None = None
    for k in (None, *range(len(CLASSES))):
        single = set(chars) if k is None else set(chars) - CLASSES[k]
        inside = n - sum(chars[c] for c in single)
        if k is not None and not inside:
            continue
        bits = EDGE * len(single) + (CHANGE if k is not None and usual is not None and k != usual else 0.0)
        bits += sum(x * math.log2(n / x) for x in (*(chars[c] for c in single), inside) if x) + (inside * math.log2(len(CLASSES[k])) if inside else 0.0)
        if best is None or bits < best[0] - 1e-9:
            best = (bits, single, k)
    return best[1:]


class Grammar:
    """A probabilistic automaton. An edge's symbol is a character, or a class (its number) of which all characters are equally likely.

    Behind each prefix the tree has characters of their own and one class for the others, as takes the fewest bits; so a format's fixed text and its lengths are paths of the tree, and what states
    merge decides what of them is kept.
    """

    def __init__(self, values: list[str], alpha: float = ALPHA):
        self.next: list[dict[str | int, int]] = []
        self.count: list[dict[str | int, int]] = []
        self.end: list[int] = []
        self.seen: list[int] = []
        self._tree(values)
        self.states = self._merge(alpha)
        self._renumber()
        size = lambda c: len(CLASSES[c]) if isinstance(c, int) else 1
        self.steps = [self._by_character({c: (t, math.log2(self.count[s][c] / self.seen[s] / size(c))) for c, t in edges.items()}) for s, edges in enumerate(self.next)]
        self.stop = [math.log2(e / n) if e else -math.inf for e, n in zip(self.end, self.seen)]
        self.head = self._head()
        del self.next, self.count, self.end, self.seen

    @staticmethod
    def _by_character(edges: dict[str | int, tuple[int, float]]) -> dict[str, tuple[int, float]]:
        """A character's own edge goes before those of classes, the smallest of these first."""
        out: dict[str, tuple[int, float]] = {}
        for c, edge in sorted(edges.items(), key=lambda x: (-1, x[0]) if isinstance(x[0], str) else (x[0], "")):
            for each in CLASSES[c] if isinstance(c, int) else c:
                out.setdefault(each, edge)
        return out

    def _new(self) -> int:
        for x, empty in ((self.next, {}), (self.count, {}), (self.end, 0), (self.seen, 0)):
            x.append(empty)
        return len(self.end) - 1

    def _tree(self, values: list[str]) -> None:
        todo: list[tuple[int, list[str], int, int | None]] = [(self._new(), sorted(values), 0, None)]
        while todo:
            s, own, depth, usual = todo.pop()
            going = [v for v in own if len(v) > depth]
            self.seen[s], self.end[s] = len(own), len(own) - len(going)
            single, fit = _symbols(Counter(v[depth] for v in going), usual)
            by: dict[str | int, list[str]] = defaultdict(list)
            for v in going:
                by[v[depth] if v[depth] in single else fit].append(v)
            for c, vs in sorted(by.items(), key=lambda x: str(x[0])):
                t = self._new()
                self.next[s][c], self.count[s][c] = t, len(vs)
                todo.append((t, vs, depth + 1, fit if c == fit else usual))

    def _merge(self, alpha: float) -> int:
        """The prefix tree's states are folded into earlier ones that they agree with statistically; the number of those that stay."""
        next_, count, end, seen = self.next, self.count, self.end, self.seen

        def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
            """Likelihood ratio test of two shares; its squared statistic is compared with that of the significance."""
            if not n1 or not n2 or f1 * n2 == f2 * n1:
                return False
            both = (f1 + f2) / (n1 + n2)
            part = lambda f, n: (f * math.log(f / n / both) if f else 0.0) + ((n - f) * math.log((n - f) / n / (1 - both)) if n - f else 0.0)
            return 2 * (part(f1, n1) + part(f2, n2)) > alpha

        def agree(a: int, b: int) -> int:
            """How many of b's samples a's states explain to their ends; -1 if the two differ anywhere."""
            todo, explained = [(a, b)], 0
            while todo:
                a, b = todo.pop()
                if differ(end[a], seen[a], end[b], seen[b]):
                    return -1
                explained += end[b] if end[a] else 0
                for c in {*next_[a], *next_[b]}:
                    if differ(count[a].get(c, 0), seen[a], count[b].get(c, 0), seen[b]):
                        return -1
                    if c in next_[a] and c in next_[b]:
                        todo.append((next_[a][c], next_[b][c]))
            return explained

        def fold(a: int, b: int) -> None:
            todo = [(a, b)]
            while todo:
                a, b = todo.pop()
                end[a] += end[b]
                seen[a] += seen[b]
                for c, n in count[b].items():
                    count[a][c] = count[a].get(c, 0) + n
                for c, t in next_[b].items():
                    if c in next_[a]:
                        if next_[a][c] != t:
                            todo.append((next_[a][c], t))
                    else:
                        next_[a][c] = t

        red = {0: None}  # in the order in which they were found
        while True:
            blue = [(r, c, t) for r in red for c, t in sorted(next_[r].items(), key=lambda x: str(x[0])) if t not in red]
            if not blue:
                return len(red)
            r, c, t = max(blue, key=lambda x: (seen[x[2]], -x[0]))
            explained, first = max((agree(x, t), -k) for k, x in enumerate(red))
            if explained < 0:
                red[t] = None
            else:
                into = list(red)[-first]
                next_[r][c] = into
                fold(into, t)

    def _renumber(self) -> None:
        """Only the states that merging left within reach stay."""
        place, todo = {0: 0}, [0]
        while todo:
            for t in self.next[todo.pop()].values():
                if t not in place:
                    place[t] = len(place)
                    todo.append(t)
        self.next = [{c: place[t] for c, t in self.next[s].items()} for s in place]
        self.count, self.end, self.seen = ([x[s] for s in place] for x in (self.count, self.end, self.seen))

    def _head(self) -> tuple[str, ...]:
        """What all of the format's credentials begin with: texts along the edges of single characters, as far as these go."""
        out, todo = [], [(0, "", frozenset({0}))]
        while todo:
            s, text, past = todo.pop()
            edges = self.next[s]
            if edges and len(text) < 16 and all(isinstance(c, str) for c in edges) and not past.intersection(edges.values()):
                todo += [(t, text + c, past | {t}) for c, t in edges.items()]
            else:
                out.append(text)
        return tuple(sorted(out))

    def score(self, text: str) -> float:
        """log2 of the text's probability under the format; -inf where it doesn't fit."""
        s, total = 0, 0.0
        for c in text:
            edge = self.steps[s].get(c)
            if edge is None:
                return -math.inf
            s, bits = edge
            total += bits
        return total + self.stop[s]


#: Bits a character of running text takes: five for a letter, more for what is rare in words.
TEXT_BITS = {**dict.fromkeys(_LOWER, 5.0), **dict.fromkeys(_UPPER + _DIGIT, 9.0), **dict.fromkeys("+/_=.-", 8.0)}


def text_bits(text: str) -> float:
    return -sum(TEXT_BITS.get(c, 8.0) for c in text)


@lru_cache(maxsize=8)
def grammars(labelled: tuple[tuple[str, str], ...]) -> dict[str, Grammar]:
    by: dict[str, list[str]] = defaultdict(list)
    for kind, value in labelled:
        by[kind].append(value)
    return {kind: Grammar(values) for kind, values in sorted(by.items())}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(kind, start, end) of the fixed patterns, leftmost and non-overlapping for each kind."""
    out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return [(s, e, k) for s, k, e in sorted(out, key=lambda x: (x[0], BASE.index(x[1])))]


def bounded(text: str, at: int) -> bool:
    """Whether a credential may begin or end here: not between two letters or digits."""
    return not (0 < at < len(text) and text[at - 1] in ALNUM and text[at] in ALNUM)


def likeliest(text: str, start: int, stop: int, known: Grammar, memo: dict[tuple[int, int], tuple[float, int]]) -> tuple[float, int]:
    """(bits over running text, end) of the format's best credential that begins at start, of equal ones the longer; -inf without one.

    What the automaton can still gain from a place and a state is the same for all that come there, and
    is kept: a run is walked once for each state, wherever candidates begin.
    """
    path, p, s = [], start, 0
    tail = (-math.inf, 0)
    while True:
        if (p, s) in memo:
            tail = memo[p, s]
            break
        ends = known.stop[s] if p > start and known.stop[s] > -math.inf and bounded(text, p) else -math.inf
        edge = known.steps[s].get(text[p]) if p < stop else None
        ends -= GOING if edge else 0.0
        path.append((p, s, ends, edge[1] + TEXT_BITS[text[p]] if edge else 0.0))
        if edge is None:
            break
        p, s = p + 1, edge[0]
    for p, s, ends, gain in reversed(path):
        tail = (tail[0] + gain, tail[1])
        if ends > tail[0]:
            tail = (ends, p)
        memo[p, s] = tail
    return tail


@lru_cache(maxsize=8)
def _starts(heads: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[re.Pattern, dict[str, list[str]]]:
    """Where any format's credentials can begin, and the formats of each head."""
    of: dict[str, list[str]] = defaultdict(list)
    for kind, texts in heads:
        for t in texts:
            of[t].append(kind)
    each = "|".join(re.escape(t) for t in sorted(of, key=lambda t: (-len(t), t)))
    return re.compile(rf"(?<![A-Za-z0-9])(?={each or '(?!)'})"), dict(of)


def learned_spans(text: str, known: dict[str, Grammar], threshold: float = THRESHOLD) -> list[tuple[int, int, str]]:
    """(start, end, format) of all credentials by format likelihood, leftmost and non-overlapping.

    Candidates begin and end anywhere in a run but between two letters or digits; from each beginning the
    format and the end with the most bits over running text count, by at least the threshold.
    """
    starts, of = _starts(tuple((k, g.head) for k, g in known.items()))
    out = []
    for m in RUN.finditer(text):
        at, end = m.start(), m.end()
        memos: dict[str, dict] = defaultdict(dict)
        for h in starts.finditer(text, at, end):
            s = h.start()
            if s < at:
                continue
            kinds = sorted({k for t, ks in of.items() if text.startswith(t, s) for k in ks})
            bits, e, kind = max((*likeliest(text, s, end, known[k], memos[k]), k) for k in kinds)
            if bits >= threshold:
                out.append((s, e, kind))
                at = e
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def all_spans(text: str, known: dict[str, Grammar]) -> tuple[list, list]:
    base = base_spans(text)
    order = {k: n for n, k in enumerate((*BASE, *sorted(known)))}
    return base, sorted(base + learned_spans(text, known), key=lambda x: (x[0], order[x[2]]))


def scan(docs: DataFrame, labelled: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of (doc_id, text).

    Spans are kind:start:end in code points, end exclusive, by start and then by kind: assign,
    access, hex, the learned formats by name; a learned one may lie within a base one. Null and empty texts have no spans and the digest of
    the empty string. Repeated rows each give a row. Empty table: no rows.
    """
    known = grammars(tuple(labelled if labelled is not None else labelled_credentials()))

    def step(batch: pa.RecordBatch) -> dict:
        found = [all_spans(x, known) for x in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], "spans": [joined(a) for _, a in found]} | {f"n_{k}": [sum(x[2] == k for x in b) for b, _ in found] for k in BASE}

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")))
    return arrow_pass(rows, step, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str:
    """Overlapping spans give one mark."""
    out, at, end = [], 0, -1
    for s, e, _ in spans:
        if s >= end:
            out += [text[at:s], mark]
        end = max(end, e)
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, labelled: list[tuple[str, str]] | None = None) -> DataFrame:
    """docs with each secret replaced by a mark, n_chars (if there) counted anew for changed texts; rows without one stay as they are.

    Null and empty texts stay, repeated rows each stay, other columns are kept. Empty table: no rows.
    """
    known = grammars(tuple(labelled if labelled is not None else labelled_credentials()))
    names = docs.columns

    def step(batch: pa.RecordBatch) -> dict:
        columns = {n: batch.column(k) for k, n in enumerate(names)}
        old = columns["text"].to_pylist()
        new = [x if not x or not (spans := all_spans(x, known)[1]) else redacted(x, spans) for x in old]
        columns["text"] = new
        if "n_chars" in columns:
            columns["n_chars"] = [n if a == b else len(b) for a, b, n in zip(old, new, columns["n_chars"].to_pylist())]
        return columns

    return arrow_pass(docs, step, docs.schema)


def op1_secret_scans(docs: DataFrame) -> DataFrame:
    return scan(docs)
