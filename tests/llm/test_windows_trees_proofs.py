"""Substring dedup, hard negatives and Merkle manifests against brute force."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tramline.llm import hard_negatives, merkle, queries, substring

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators give or use themselves.
CLASH = "id string, owner int, h1 int, marks string, kept int, label string, dim int, leaf int, proof int, root string, _tree int, _rank int, node string, extra int"
ODD = [None] * 14


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# substring dedup


@pytest.mark.parametrize("period", [p for p in substring.COVERS if p > 1])
def test_covers_hold_every_difference(period):
    members = substring.COVERS[period]
    assert {(a - b) % period for a in members for b in members} == set(range(period))


def brute_windows(rows, window):
    """By the contract's words: places of a window, the first by (id, place)."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    texts = [(2**63 - 1 if i is None else i, word.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in texts:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, (i, k)), (i, k))
    out = []
    for (i, t), (own, w) in zip(rows, texts):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if (own, k) > first[tuple(w[k : k + window])]:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


def planted(seed, n, words):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)] + ["é", "中文", " x", "a b"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(10, 90))] for _ in range(6)]
    rows = []
    for k in range(n):
        text = [w for _ in range(rng.randint(0, 5)) for w in (rng.choice(passages)[rng.randint(0, 9) :] if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))])]
        rows.append((rng.choice([k, k, k, 3, None]), rng.choice([" ", "\n", "\t \x0b"]).join(text)))
    return [*rows, *rows[: n // 4], (n + 1, None), (n + 2, ""), (n + 3, " ".join(passages[0] * 30))]


@pytest.mark.parametrize("window, seed", [(20, 1), (20, 2), (7, 3), (3, 4), (1, 5), (50, 6)])
def test_windows_equal_brute_force(spark, window, seed):
    rows = planted(seed, 60, 300 if window > 3 else 4_000)
    docs = spark.createDataFrame([(i, t, *ODD) for i, t in rows], f"doc_id long, text string, {CLASH}")
    # few of a task's occurrences are held, and many tasks share the keys
    got = substring.dedup(docs, window=window, chars=2_000, held=500)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_windows(rows, window)


def test_op11_whole_table(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet")
    want = brute_windows([(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()], 20)
    assert sorted(map(tuple, queries.queries()["op11_substring_dedup"](spark, small).collect())) == sorted((i, n, gone, sha(kept)) for i, n, gone, kept in want)
    assert sum(gone > 0 for _, _, gone, _ in want) > 10


def test_long_words_and_pieces(monkeypatch):
    text = " ".join(["ab" * 40, "x", "yy" * 3, "é" * 90, "z"] * 5).encode() + b"\n "
    whole = substring.word_hashes(text, 5)
    monkeypatch.setattr(substring, "PIECE", 16)
    assert (substring.word_hashes(text, 5) == whole).all() and len(whole) == 25 and len(set(whole.tolist())) == 5


def test_one_occurrence_of_a_common_passage_leaves_a_task():
    packer = substring.Packer(4, True, 2)
    keys = np.arange(60, dtype=np.uint64).reshape(30, 2)
    for k in range(1_000):
        packer.add((k, k, k), keys, np.arange(30))
    batch = packer.flush()
    sent = sum(len(x) // 16 for x in batch.column(2).to_pylist())
    assert sent == 30 and sum(batch.column(1).to_pylist()) == 30_000


def test_ids_of_other_types(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = spark.createDataFrame([("7", text), ("x", text), (None, "a " * 3)], "doc_id string, text string")
    assert sorted(map(tuple, substring.dedup(rows).collect()), key=repr) == sorted([("7", 30, 0, text), ("x", 30, 30, ""), (None, 3, 0, "a a a")], key=repr)


def test_substring_of_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert substring.op11_substring_dedup(none).collect() == []
    lost = spark.createDataFrame([(None,) * 5] * 3, DOCS)
    assert sorted(map(tuple, substring.op11_substring_dedup(lost).collect())) == [(None, 0, 0, sha(""))] * 3


# hard negatives


def brute_negatives(rows, percent=80, positives=5, negatives=5, every=100):
    fine = [(i, l, [int(np.floor(256 * x)) for x in v]) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    fine = [r for r in fine if sum(x * x for x in r[2]) < 2**55]
    out = []
    for a, label, q in {(i, l, tuple(v)) for i, l, v in fine if i % every == 0}:
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, l) for i, l, v in fine if i != a and len(v) == len(q))
        for p, i, _ in [s for s in scored if s[2] == label][:positives]:
            found = [(s, j) for s, j, l in scored if l != label and percent * -p <= 100 * -s <= 100 * -p][:negatives]
            out += [(a, i, k + 1, j, -p, -s) for k, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("seed, scale, dim, block, size, leaf", [(1, 1.0, 8, 2, 40, 4), (2, 0.02, 3, 1, 64, 8), (3, 1.0, 1, 3, 10, 1), (4, 300.0, 6, 100, 4096, 64), (5, 90_000.0, 4, 3, 50, 5)])
def test_negatives_equal_brute_force(spark, seed, scale, dim, block, size, leaf):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, dim))
    v = (centre[rng.integers(0, 6, 500)] + 0.3 * rng.normal(size=(500, dim))) * scale
    v[200:330] = v[200]  # one vector in a quarter of the rows
    rows = [(k, int(rng.integers(0, 4)), v[k].tolist()) for k in range(500)]
    rows += [(100, 1, v[7].tolist()), (101, 2, None), (200, None, v[8].tolist()), (None, 1, v[9].tolist()), (103, 1, [float("nan")] * dim), (104, 1, [None] * dim), (300, 1, [0.5]), (105, 2, [0.25]), (106, 1, [0.5]), (107, 1, [1e300] * dim), rows[5], rows[5], rows[400]]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, label int, embedding array<double>, id string, score double").repartition(5)
    got = hard_negatives.hard_negatives(docs, F.col("id") % 100 == 0, block=block, size=size, leaf=leaf)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows) and got.count() > 0


def test_balls_outside_the_window_or_below_the_kth_are_not_opened():
    rng = np.random.default_rng(7)
    v = np.floor(256 * (np.repeat(rng.normal(size=(40, 16)), 100, axis=0) + 0.05 * rng.normal(size=(4_000, 16))))
    labels = rng.integers(0, 3, 4_000)
    tree = hard_negatives.build(np.arange(4_000), labels, v)
    asked = hard_negatives.Asked(np.arange(9), np.arange(9), labels[:9], v[:9], np.full(9, -(1 << 62)), np.full(9, 1 << 62), True, 5)
    best, looked = hard_negatives.Best(9, 5), []
    hard_negatives.search(tree, asked, best, lambda rows, who: looked.append(rows * who))
    assert (best.found == 5).all() and sum(looked) < 9 * 4_000 / 3
    high = best.score[:, 4] * 100
    window = hard_negatives.Asked(np.arange(9), np.arange(9), labels[:9], v[:9], high * 9 // 10, high, False, 5)
    looked.clear()
    hard_negatives.search(tree, window, hard_negatives.Best(9, 5), lambda rows, who: looked.append(rows * who))
    assert sum(looked) < 9 * 4_000 / 3


def test_negatives_of_empty_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(None, None, None)] * 3, [(0, [1.0], 1)], [(0, [], 1), (1, [], 1), (2, [], 2)]):
        got = hard_negatives.op12_hard_negatives(spark.createDataFrame(rows, schema))
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert list(map(tuple, got.collect())) == ([(0, 2, 1, 1, 0, 0)] if len(rows) == 3 and rows[0][1] == [] else [])


# Merkle manifests


def brute_tree(nodes):
    """The root, and for each leaf the siblings of its path, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, path in enumerate(paths):
            run = at[k] // 3 * 3
            path.append(("".join(nodes[run : at[k]]), "".join(nodes[at[k] + 1 : run + 3])))
            at[k] //= 3
        nodes = [sha("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute_leaf(row):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0], brute_leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: (x[0], x[1] or 0, x[2]))
        trees[s] = brute_tree([x[2] for x in groups[s]])
    root, ups = brute_tree([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, ups):
        for (_, i, leaf, r), path in zip(groups[s], trees[s][1]):
            path = path + up
            text = r[4]
            if i is not None and text is not None and zlib.crc32(str(i).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = brute_leaf((*r[:4], text))
            for before, after in path:
                node = sha(before + node + after)
            out.append((i, leaf, trees[s][0], root, sha("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=repr)


def manifest_rows(seed, n):
    rng = random.Random(seed)
    rows = [(k, rng.choice(["a", "a", "a", "é", "Z", "中", "", None, f"s{k % 9}"]), rng.choice(["en", None]), rng.choice([k, None]), rng.choice(["x\ny", "\n", "", None, "plain", "é\n" * 9])) for k in range(n)]
    return rows + rows[:7] + [(None, "a", None, None, None), (None, "a", "en", 1, "t\n"), (5, "a", None, None, "other")]


@pytest.mark.parametrize("n, height", [(0, 1), (1, 1), (9, 1), (60, 1), (200, 2), (400, 6)])
def test_manifest_equals_brute_force(spark, monkeypatch, n, height):
    rows = manifest_rows(n, n) if n != 1 else [(4, "s", "en", 3, "a\nb")]
    monkeypatch.setattr(merkle, "HEIGHT", height)
    docs = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], *ODD) for r in rows], f"{DOCS}, {CLASH}").repartition(3)
    extra = {"tampered": F.when(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False)), merkle.leaf([F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in merkle.COLUMNS]))}
    got = merkle.verified(merkle.manifest(docs, extra=extra, height=height), F.coalesce("tampered", "leaf"))
    got = got.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), "folded_root", "verified")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_manifest(rows)


def test_op13_equals_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted(map(tuple, queries.queries()["op13_merkle"](spark, small).collect()), key=repr) == brute_manifest(rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 250))
def test_traversal_gives_each_path_with_few_nodes(n):
    leaves, height, held = [sha(str(k)) for k in range(n)], merkle.heights(n), []
    root, paths = brute_tree(leaves)
    assert list(merkle.traverse(leaves, height, held)) == paths and merkle.root_of(leaves, height) == root
    assert max(held) <= 3 * (height + 1) + 2 * height


def test_deeper_blocks_than_their_leaves_have():
    leaves = [sha("a"), sha("b")]
    assert merkle.root_of(leaves, 3) == sha(sha(sha("".join(leaves))))
    assert list(merkle.traverse(leaves, 3)) == [[("", leaves[1]), ("", ""), ("", "")], [(leaves[0], ""), ("", ""), ("", "")]]


def test_a_changed_row_does_not_verify(spark):
    docs = spark.createDataFrame([(k, f"text {k}", "en", f"s{k % 3}", k) for k in range(40)], DOCS)
    held = merkle.manifest(docs)
    now = docs.withColumn("text", F.when(F.col("doc_id") == 11, "other").otherwise(F.col("text")))
    again = now.select("doc_id", merkle.leaf([F.col(c) for c in merkle.COLUMNS]).alias("now"))
    assert [r.doc_id for r in merkle.verified(held.join(again, "doc_id"), F.col("now")).filter("NOT verified").collect()] == [11]
    with pytest.raises(ValueError, match="proof"):
        merkle.manifest(docs, extra={"proof": F.lit(1)})


@pytest.mark.parametrize("name, table", [("op12_hard_negatives", "embeddings"), ("op13_merkle", "documents")])
def test_sql(spark, small, name, table):
    got = queries.queries()[name](spark, small)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    want = db.sql(queries.oracle_sql()[name])
    assert want.columns == got.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
