"""Coins of equal rows, letters with marks, and chunks of most texts."""

import math
import random
import unicodedata
from collections import Counter

import duckdb
import numpy as np
import pytest
import tiktoken
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tramline.llm import ann, bpe, fingerprint, language_id, mixing, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def near_target(rows):
    """Taken words by source, and how far from the target independent coins go: four deviations."""
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        rate = own[0].target / own[0].source_size if own[0].source_size else 0.0
        share = rate - math.floor(rate)
        spread = math.sqrt(share * (1 - share) * sum(r.size**2 for r in own))
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= 4 * spread + 1e-6, source


@pytest.mark.parametrize("kind", ["null ids", "one id", "equal rows", "distinct"])
def test_each_row_draws_for_itself(spark, kind):
    rows = []
    for k in range(3_000):
        text = "two words" if kind == "equal rows" else f"two w{k}"
        doc_id = {"null ids": None, "one id": 7, "equal rows": 7, "distinct": k}[kind]
        rows.append((doc_id, text, "en", ["a", "b", None][k % 3], 0))
    docs = spark.createDataFrame(rows, DOCS)
    found = mixing.rates(docs).collect()
    assert len(found) == 3_000
    near_target(found)
    # reruns agree, however the rows are dealt
    again = mixing.rates(docs.repartition(7, F.rand(3))).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))
    mixed = Counter(r.source for r in mixing.mix(docs).collect())
    assert mixed == Counter({s: sum(r.copies for r in found if r.source == s) for s in ("a", "b", None)})


def test_mixing_sql_of_repeated_rows(spark, tmp_path):
    rows = [(k % 5 if k % 4 else None, ["a b", "a b", None, "", "c"][k % 5], "en", [None, "s", "t"][k % 3], 0) for k in range(90)] * 2
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "d"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = db.sql(mixing.SQL)
    got = mixing.op7_mixing(docs)
    assert got.columns == want.columns and Counter(map(tuple, got.collect())) == Counter(want.fetchall())


def test_words_keep_their_marks():
    assert language_id.words_of("हिन्दी भाषा में") == ["हिन्दी", "भाषा", "में"]
    assert language_id.words_of(unicodedata.normalize("NFD", "L'étude où")) == ["l", unicodedata.normalize("NFD", "étude"), unicodedata.normalize("NFD", "où")]
    assert language_id.words_of("ภาษาไทยดี ab1cd ⃝ ́x") == ["ภาษาไทยดี", "ab", "cd", "x"]


def test_long_words_are_learned_from():
    pieces = frozenset({"▁", "a", "b", "c"})
    found = language_id.fit(Counter({"ab" * 400: 1, "c": 1}), pieces)
    # one c in 800 letters: the long word counts as much as its letters do
    assert math.exp(found["a"]) == pytest.approx(400 / 803, rel=0.05) and math.exp(found["c"]) < 0.01


def test_marks_tell_languages(spark):
    rows = [(k, t, lang, "s", 0) for k, (t, lang) in enumerate([("हिन्दी भाषा में लिखा है " * 5, "hi"), ("नेपालमा बोलिने भाषा हो " * 5, "ne"), ("étude de la langue française " * 5, "fr")] * 30)]
    got = language_id.identify(spark.createDataFrame(rows, DOCS)).collect()
    assert {(r.doc_id % 3, r.lang_pred) for r in got} == {(0, "hi"), (1, "ne"), (2, "fr")}


def test_most_texts_are_stitched_from_chunks(spark, small, monkeypatch):
    texts = [r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    codec = bpe.encoding(path)
    cut = [len(bpe.pieces(codec, x, bpe.WITHIN, bpe.WITHIN_OVERLAP)) for x in texts]
    assert sum(n > 1 for n in cut) > len(texts) / 2
    library = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.library._mergeable_ranks, special_tokens={})
    assert all(bpe.encode_text(x, path, bpe.WITHIN, bpe.WITHIN_OVERLAP) == library.encode_ordinary(x) for x in texts)


def test_links_of_the_table_come_out_of_the_descent(spark, small, monkeypatch):
    texts = {r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()}
    fps = sorted({simhash.fingerprint(x) for x in texts} | {simhash.fingerprint(x) ^ 0b101 << 40 for x in list(texts)[::3]})
    pairs = {(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if (a ^ b).bit_count() <= 3}
    steps, compared = [], []
    found = simhash.trie_join(np.array(fps, dtype=np.uint64), None, seen=lambda bit, n: (compared if bit < 0 else steps).append((bit, n)))
    assert {(fps[a], fps[b]) for a, b in found} <= pairs and len(found) > 50
    # paths are followed down to a few entries, and few of all pairs are compared
    assert min(bit for bit, _ in steps) < 58
    rng = random.Random(2)
    many = np.array(sorted({rng.getrandbits(64) for _ in range(8_000)}), dtype=np.uint64)
    compared.clear()
    simhash.trie_join(many, None, seen=lambda bit, n: compared.append((bit, n)) if bit < 0 else None)
    assert sum(n for _, n in compared) < len(many) ** 2 / 2 / 8
    called = []
    join = simhash.trie_join
    monkeypatch.setattr(simhash, "trie_join", lambda *a, **b: called.append(len(join(*a, **b))) or join(*a, **b))
    fp = np.array(fps, dtype=np.uint64).view(np.int64)
    for group in (64, 8192):
        called.clear()
        dealings = simhash.tries(len(fps), 3, group)
        links = []
        for block, (chosen, others, bits) in enumerate(dealings):
            value = simhash.moved(fp.view(np.uint64), chosen + others) >> np.uint64(64 - bits) if bits else np.zeros(len(fp), dtype=np.uint64)
            order = value.argsort(kind="stable")
            key = np.stack([np.full(len(fp), block), value[order].astype(np.int64), np.zeros(len(fp), dtype=np.int64), np.zeros(len(fp), dtype=np.int64)], axis=1)
            links += list(zip(*(x.tolist() for x in simhash.group_links(key, np.zeros(len(fp), dtype=np.int64), fp[order], 3, dealings))))
        assert sum(called) == len(links) and {tuple(sorted((a % 2**64, b % 2**64))) for a, b in links} <= pairs
        forest, at = simhash.Forest(len(fps)), {f: k for k, f in enumerate(fps)}
        for a, b in links:
            forest.link(at[a % 2**64], at[b % 2**64])
        whole = simhash.Forest(len(fps))
        for a, b in pairs:
            whole.link(at[a], at[b])
        assert [forest.root(k) for k in range(len(fps))] == [whole.root(k) for k in range(len(fps))]


@pytest.mark.parametrize("n", [9_000, 10**6, 10**9, 10**11])
def test_tries_have_depth_and_miss_no_pair(n):
    rng = random.Random(n)
    dealings = simhash.tries(n, 3, simhash.GROUP)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x ^ sum(1 << b for b in rng.sample(range(64), 3))
        both = [simhash.moved(np.array([x, y], dtype=np.uint64), chosen + others) for chosen, others, _ in dealings]
        assert any((u[0] ^ u[1]) >> np.uint64(64 - sum(hi - lo for lo, hi in chosen)) == 0 for u, (chosen, _, _) in zip(both, dealings))
        assert all((u[0] ^ u[1]).item().bit_count() == 3 for u in both)
    assert all(n / 2**bits <= simhash.GROUP for _, _, bits in dealings)


def test_dense_groups_tell_a_forest():
    base = 0x0123456789ABCDEF
    fps = sorted({base ^ 1 << a ^ 1 << b for a in range(64) for b in range(a)} | {base ^ 1 << a for a in range(64)})
    found = simhash.trie_join(np.array(fps, dtype=np.uint64), None)
    assert len(found) == len(fps) - 1


# licences

BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
]
ADVERTISING = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: made by X."
WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
GPL3 = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."


def third(holder):
    return f"3. Neither the name of {holder} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."


def lines(*parts):
    return "\n".join([*parts, WARRANTY])


LICENCES = [
    (lines(*BSD, third("Google Inc.")), "BSD-3-Clause"),
    (lines(*BSD, third("the University of California, Berkeley")), "BSD-3-Clause"),
    (lines(*BSD, third("the\n * copyright\n * holder")), "BSD-3-Clause"),
    (lines(*BSD, "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission."), "BSD-3-Clause"),
    (lines(*BSD), "BSD-2-Clause"),
    (lines(*BSD) + "\n" + lines(*BSD, third("Google Inc.")), "BSD-2-Clause,BSD-3-Clause"),
    (lines(*BSD, third("X")) + "\n" + lines(*BSD) + "\n" + lines(*BSD, ADVERTISING, third("Y")), "BSD-2-Clause,BSD-3-Clause,BSD-4-Clause"),
    (lines(BSD[0], BSD[1]) + "\n" + lines(*BSD, third("X")) + "\n" + BSD[2], "BSD-3-Clause"),
    ("// SPDX-License-Identifier: (MIT OR Apache-2.0)\nint x;", "Apache-2.0,MIT"),
    ("# SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception", "Apache-2.0"),
    ("/* SPDX-License-Identifier: GPL-2.0+ WITH Linux-syscall-note OR BSD-3-Clause AND ISC */", "BSD-3-Clause,GPL-2.0,ISC"),
    ("SPDX-License-Identifier: mit and other words", "MIT"),
    (GPL3, "GPL-3.0"),
    ("You may take bread or wine and water. " * 3, ""),
    ("The licenses for most software are designed to take away your freedom to share and change it.", "GPL-2.0"),
]


def test_licences_by_holders_texts_and_expressions(spark, tmp_path):
    from tramline.llm import license_scan

    rows = [(k, text, None, None, 0) for k, (text, _) in enumerate(LICENCES)] + [(99, None, None, None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.licenses for r in license_scan.scan(docs).collect()}
    assert [got[k] for k in range(len(LICENCES))] == [name for _, name in LICENCES] and got[99] == ""
    docs.write.parquet(str(tmp_path / "d"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = db.sql(license_scan.SQL)
    assert sorted(map(tuple, license_scan.scan(docs).collect())) == sorted(want.fetchall())


# fingerprints


TEXT = st.lists(st.sampled_from(["a b c", "word", "\n", "\n\n", " ", "é x y z", "b"]), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(TEXT, TEXT)
def test_edits_take_paragraphs_out_and_in(text, following):
    new = fingerprint.edited(text, following)
    assert fingerprint.of_edited(text, fingerprint.of_text(text), new) == fingerprint.of_text(new)


# neighbours


def test_vectors_of_each_length_are_searched(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 0.1]), (50, [3.0]), (51, [1.0]), (52, [-1.0]), (100, [1.0, 2.0, 3.0])]
    got = ann.op9_nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 2), (0, 2, 1), (50, 1, 51), (50, 2, 52)]
