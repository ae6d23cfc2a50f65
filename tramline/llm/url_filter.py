"""URL filters: all glob rules simulated at once over each canonical URL by a multiword Shift-And automaton."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass

#: Path rules: (verdict, host, path); a rule fits its host and all subdomains, and the longest that fits wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Globs over host and path, for URLs that no rule fits: ``*`` is any run of characters, ``?`` one.
BLOCK_GLOBS = ("*spam*", "*cheap-pills*", "*casino*", "*porn*", "*xxx*", "*warez*", "*phishing*", "*malware*", "*/wp-login*", "*/cgi-bin/*", "*/ads/*", "*/cart/*", "*/login*", "*.exe", "*.zip", "*viagra*")
#: A URL that a block glob and one of these fit is allowed.
ALLOW_GLOBS = ("*anti-spam*", "*antispam*")

#: Stands for the slash that begins a path, so that a rule's host ends where the URL's host does.
ROOT = 0x110000


class Automaton:
    """Bit-parallel simulation of glob patterns, packed one after another into 64-bit words.

    A pattern of m symbols (stars apart) takes m + 1 bits: bit 0 is its start, bit k is set when k
    symbols are matched. On each character all bits move up by one where the character's mask
    allows (the carry crosses words), and bits before a star stay. A pattern without a leading star
    is anchored at the start and one without a trailing star at the end.
    """

    def __init__(self, patterns: list[list]):
        """patterns: lists of character codes, tuples of codes of which any fits, '*' and '?'."""
        starts, stays, accepts, symbols, at = [], [], [], [], 0
        for pattern in patterns:
            starts.append(at)
            for item in pattern:
                if item == "*":
                    stays.append(at)
                else:
                    symbols.append((at + 1, item))
                    at += 1
            accepts.append(at)
            at += 1
        self.words = max(1, -(-at // 64))
        symbols = [(k, s if isinstance(s, (tuple, str)) else (s,)) for k, s in symbols]
        self.codes = np.array(sorted({c for _, s in symbols if s != "?" for c in s}), dtype=np.int64)
        place = {int(c): k for k, c in enumerate(self.codes)}
        self.start, self.stay = self._mask(starts), self._mask(stays)
        self.accept = [(k // 64, np.uint64(1) << np.uint64(k % 64)) for k in accepts]
        # the last class is that of all characters no pattern names
        self.masks = np.zeros((len(self.codes) + 1, self.words), dtype=np.uint64)
        for k, s in symbols:
            rows = slice(None) if s == "?" else [place[c] for c in s]
            self.masks[rows, k // 64] |= np.uint64(1) << np.uint64(k % 64)

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, dtype=np.uint64)
        for k in bits:
            out[k // 64] |= np.uint64(1) << np.uint64(k % 64)
        return out

    def classes(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.zeros(len(codes), dtype=np.int64)
        k = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[k] == codes, k, len(self.codes))

    def match(self, inputs: list[np.ndarray]) -> np.ndarray:
        """Which pattern (column) fits which whole input (row); the inputs advance together, the longest first."""
        out = np.zeros((len(inputs), len(self.accept)), dtype=bool)
        order = sorted(range(len(inputs)), key=lambda k: -len(inputs[k]))
        lengths = np.array([len(inputs[k]) for k in order], dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        flat = self.classes(np.concatenate([inputs[k] for k in order])) if len(order) else np.zeros(0, dtype=np.int64)
        state = np.tile(self.start, (len(order), 1))
        for j in range(int(lengths[0]) if len(order) else 0):
            live = int(np.searchsorted(-lengths, -j, side="left"))  # those longer than j come first
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.masks[flat[offsets[:live] + j]]) | (now & self.stay)
        for p, (word, bit) in enumerate(self.accept):
            out[order, p] = (state[:, word] & bit) != 0
        return out


def canonical(url: str | None) -> tuple[str, str]:
    """Host and path of a URL; both empty for null and where there is no ://."""
    head, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    for stop in "?#":
        rest = rest.partition(stop)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


_LOWER = {k: k + 32 for k in range(65, 91)}


def coded(host: str, path: str) -> np.ndarray:
    """A dot, the host, the path: with the dot a rule's host fits at a label's start only."""
    return np.array([46, *map(ord, host), *([ROOT] if path else []), *map(ord, path[1:])], dtype=np.int64)


def rule_pattern(host: str, path: str) -> list:
    return ["*", 46, *map(ord, host), ROOT, *map(ord, path[1:]), "*"]


def glob_pattern(glob: str) -> list:
    return [46, *(c if c in "*?" else (47, ROOT) if c == "/" else ord(c) for c in glob)]


def compiled(rules, block, allow) -> Automaton:
    return Automaton([rule_pattern(h, p) for _, h, p in rules] + [glob_pattern(g) for g in (*block, *allow)])


def filter_urls(pages: DataFrame, rules=RULES, block=BLOCK_GLOBS, allow=ALLOW_GLOBS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, by) for every row.

    by is rule, glob or default. A null URL or one without :// has an empty host and path, fits no
    rule, and is allowed unless a glob fits the empty text. Repeated rows are judged alike, each
    on its own; a rule's tie in length goes to the earlier rule. Empty table: no rows.
    """
    rules, block, allow = tuple(rules), tuple(block), tuple(allow)
    lengths = np.array([len(h) + len(p) for _, h, p in rules], dtype=np.int64)

    def step(batch: pa.RecordBatch) -> dict:
        nonlocal automaton
        automaton = automaton or compiled(rules, block, allow)
        parts = [canonical(u) for u in batch.column(1).to_pylist()]
        hits = automaton.match([coded(h, p) for h, p in parts])
        n = len(rules)
        scores = np.where(hits[:, :n], lengths + 1, 0) if n else np.zeros((len(parts), 1), dtype=np.int64)
        best, fits = scores.argmax(axis=1), scores.max(axis=1, initial=0) > 0
        bad = hits[:, n : n + len(block)].any(axis=1) & ~hits[:, n + len(block) :].any(axis=1)
        return {
            id_col: batch.column(0),
            "host": [h for h, _ in parts],
            "path": [p for _, p in parts],
            "rule": [rules[k][1] + rules[k][2] if f else None for k, f in zip(best, fits)],
            "verdict": [rules[k][0] if f else "block" if b else "allow" for k, f, b in zip(best, fits, bad)],
            "by": ["rule" if f else "glob" if b else "default" for f, b in zip(fits, bad)],
        }

    automaton: Automaton | None = None
    ids = pages.schema[id_col].dataType.simpleString()
    return arrow_pass(pages.select(id_col, F.col(url_col).cast("string")), step, f"`{id_col}` {ids}, host string, path string, rule string, verdict string, by string")


def op2_url_filters(pages: DataFrame) -> DataFrame:
    return filter_urls(pages)


def _glob_sql(glob: str) -> str:
    special = "\\.^$|()[]{}+"
    return "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in special else c for c in glob)


def _any(globs) -> str:
    return "(?s)^(?:" + "|".join(_glob_sql(g) for g in globs) + ")$"


_RULE_ROWS = ", ".join(f"({k}, '{v}', '{h}', '{p}')" for k, (v, h, p) in enumerate(RULES))
SQL = rf"""
WITH cleaned AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
rest AS (SELECT page_id, CASE WHEN strpos(u, '://') > 0 THEN regexp_extract(substr(u, strpos(u, '://') + 3), '(?s)^[^?#]*') ELSE '' END AS r FROM cleaned),
parts AS (
  SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(r, '(?s)^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN strpos(r, '/') > 0 THEN substr(r, strpos(r, '/')) ELSE '' END AS path FROM rest),
rules(k, verdict, h, p) AS (VALUES {_RULE_ROWS}),
hits AS (
  SELECT n, arg_max(h || p, (length(h || p)) * 1000 - k) AS rule, arg_max(verdict, (length(h || p)) * 1000 - k) AS verdict
  FROM parts JOIN rules ON ends_with('.' || host, '.' || h) AND starts_with(path, p) GROUP BY n),
judged AS (
  SELECT page_id, host, path, rule, hits.verdict AS v,
         regexp_matches(host || path, '{_any(BLOCK_GLOBS)}') AND NOT regexp_matches(host || path, '{_any(ALLOW_GLOBS)}') AS bad
  FROM parts LEFT JOIN hits USING (n))
SELECT page_id, host, path, rule, CASE WHEN v IS NOT NULL THEN v WHEN bad THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN v IS NOT NULL THEN 'rule' WHEN bad THEN 'glob' ELSE 'default' END AS "by"
FROM judged
"""
