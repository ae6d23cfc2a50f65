"""The pipeline's stages, each against brute force on its own input, and the whole of run()."""

import hashlib
import pathlib

import corpus_pipeline
from pyspark.sql import functions as F

from tramline.llm import bpe, language_id, mixing, secret_scan, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_follow_each_other(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, small).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
        if name == "language_id":
            kept = {r.doc_id for r in docs.collect()}
            assert kept == {r.doc_id for r in language_id.identify(before).filter("lang_pred <> 'und' AND score >= 0.5").collect()}
        elif name == "simhash_near_dedup":
            found = simhash.near_duplicates(before).collect()
            assert sorted(r.doc_id for r in docs.collect()) == sorted({r.component_id for r in found})
        elif name == "secret_scan":
            old = {r.doc_id: r.text for r in before.collect()}
            known = secret_scan.grammars(tuple(secret_scan.labelled_credentials()))
            for r in docs.collect():
                spans = secret_scan.all_spans(old[r.doc_id], known)[1]
                assert (r.text == old[r.doc_id]) == (not spans)
                assert r.n_chars == (len(r.text) if spans else r.n_chars)
        elif name == "mixing":
            copies = {r.doc_id: r.copies for r in mixing.rates(before).collect()}
            assert {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()} == {k: n for k, n in copies.items() if n}
        else:
            codec = bpe.encoding(bpe.public_tokenizers.path("byte_bpe_50k.tiktoken")).library
            texts = {r.doc_id: r.text for r in before.collect()}
            rows = docs.collect()
            assert len(rows) == before.count()
            for r in rows:
                assert list(r.ids) == codec.encode_ordinary(texts[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    again = corpus_pipeline.run(spark, small)
    key = ["doc_id", "ids_sha256"]
    assert sorted(map(tuple, again.select(*key).collect())) == sorted(map(tuple, docs.select(*key).collect()))
    folder = pathlib.Path(again.inputFiles()[0].split(":", 1)[1].replace("//", "/")).parent.parent
    assert [p.name for p in folder.iterdir()] == ["4-byte_bpe"]


def test_stages_on_odd_rows(spark, tmp_path):
    text = "The words of this text are plain, and they are English. "
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, None, None, None, None), (3, "", "en", "s", 0), (None, text + "more", "en", None, 1), (4, "token = 'abcdef123456' " + text, "en", "s", 2)]
    for count in (len(rows), 0):
        docs = spark.createDataFrame(rows[:count], DOCS)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = str(tmp_path / f"{count}-{k}")
            stage(spark, docs, "").write.parquet(out)
            docs = spark.read.parquet(out)
        assert docs.filter(F.col("doc_id") == 2).count() == 0


def shingles(text):
    w = text.encode().lower().split()
    return frozenset([b" ".join(w)] if 0 < len(w) < 5 else zip(*(w[k:] for k in range(5))))


def test_near_dedup_reaches_similarity(spark, small):
    """All pairs of five-word shingle sets, one by one; many of those at 0.8 or more differ in over three fingerprint bits."""
    words = [f"w{k}" for k in range(120)]
    rows = [(k, r.text) for k, r in enumerate(spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect())]
    copies = [(1_000 + k, " ".join("x" if n in (k, 3 * k) else w for n, w in enumerate(words))) for k in range(40)]
    docs = [(n, t or "", "en", "s", len(t or "")) for n, t in rows + copies + [(5_000, " ".join(words)), (5_001, "a b"), (5_002, "A  b"), (5_003, "a c")]]
    sets = [shingles(d[1]) for d in docs]
    up = list(range(len(docs)))
    root = lambda x: x if up[x] == x else root(up[x])
    far = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                far += (simhash.fingerprint(docs[i][1]) ^ simhash.fingerprint(docs[j][1])).bit_count() > 3
                up[max(root(i), root(j))] = min(root(i), root(j))
    assert far > 5
    frame = spark.createDataFrame(docs, DOCS)
    least = sorted({min(docs[k][0] for k in range(len(docs)) if root(k) == r) for r in {root(k) for k in range(len(docs))}})
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_stage(spark, frame, small).collect()) == least
    assert sorted({r.component_id for r in simhash.near_duplicates(frame, group=4).collect()}) == least


def test_near_dedup_takes_the_trie_joins_links(spark):
    """Without any common bucket what the trie join links is still found; its links of other texts are dropped."""
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join("x" if n == 9 * k + 1 else w for n, w in enumerate(words)) for k in range(30)] + ["one two", "three"]
    fps = [simhash.fingerprint(t, 5) for t in texts]
    up = list(range(len(texts)))
    root = lambda x: x if up[x] == x else root(up[x])
    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                up[max(root(i), root(j))] = min(root(i), root(j))
    assert 3 < sum(root(k) != k for k in range(30))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], DOCS)
    rows = simhash.signatures(docs).withColumn("buckets", F.array("fp")).cache()
    ids = {r.fp: r.doc_id for r in rows.collect()}
    found = simhash.near_links(docs, rows).collect()
    assert {root(ids[r.a]) == root(ids[r.b]) for r in found} == {True} and len(found) == sum(root(k) != k for k in range(30))
    assert simhash.near_links(docs, rows.withColumn("simhash", F.xxhash64("fp"))).count() == 0
    unlike = docs.filter("doc_id >= 30")
    assert simhash.near_links(unlike, simhash.signatures(unlike).withColumn("simhash", F.lit(0).cast("long"))).count() == 0
