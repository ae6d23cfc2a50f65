"""What the operators share."""

import pytest
from pyspark.sql import functions as F

from tramline.llm import common


@pytest.mark.parametrize("rows", [100, 0])
def test_bounded_join_broadcast_or_salted(spark, rows):
    big = spark.createDataFrame([(k, "hot" if k % 3 else None) for k in range(60)] + [(99, "none")], "k int, key string")
    small = spark.createDataFrame([("hot", 1), (None, 2)], "key string, v int")
    got = common.join_bounded(big, small, "key", F.col("k"), rows=rows)
    assert got.columns == ["k", "key", "v"]
    assert sorted((r.k, r.v or 0) for r in got.collect()) == sorted([(k, 1 if k % 3 else 2) for k in range(60)] + [(99, 0)])


def test_global_rank(spark):
    df = spark.createDataFrame([(x,) for x in ["b", None, "a", "é", "z", "B"]], "s string")
    got = common.global_rank(df, F.col("s").asc_nulls_last()).collect()
    assert [r.s for r in sorted(got, key=lambda r: r["rank"])] == ["B", "a", "b", "z", "é", None]
    assert common.global_rank(df.limit(0), F.col("s")).count() == 0


def test_passes_are_sliced(spark):
    df = spark.range(3_000).coalesce(1)
    sizes = common.arrow_pass(df, lambda b: {"n": [b.num_rows]}, "n int").collect()
    assert sum(r.n for r in sizes) == 3_000 and max(r.n for r in sizes) <= common.SLICE


def test_lineage_is_cut_in_the_shared_folder(spark):
    df = common.cut(spark.range(10))
    assert spark.sparkContext.getCheckpointDir() and df.count() == 10
    assert "Range" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("least", [5, 1_000])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_join_of_a_hot_key(spark, least, how):
    left = spark.createDataFrame([(k, "hot" if k % 3 else f"k{k}") for k in range(300)] + [(999, None)], "n int, key string")
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("other", 3)], "name string, v int")
    got = common.split_join(left, "key", right, "name", F.col("n"), how, hot=common.hot_keys(left, "key", least))
    assert got.columns == ["n", "key", "v"]
    expected = [(k, "hot", 1) if k % 3 else (k, f"k{k}", 2 if k == 3 else None) for k in range(300)] + [(999, None, None)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((r for r in expected if how == "left" or r[2]), key=str)
    if least == 5:
        assert common.hot_keys(left, "key", least).collect()[0]["parts"] == 40
        dealt = common.split_join(left, "key", right, "name", F.col("n"), hot=common.hot_keys(left, "key", least)).repartition("key")
        assert dealt.count() == 201


def test_removal(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "x"))
    common.remove(spark, str(tmp_path / "x"))
    common.remove(spark, str(tmp_path / "none"))
    assert not (tmp_path / "x").exists()
    assert common.unused("part", ["Part", "x"], ["_part"]) == "__part"


def test_slices_hold_few_bytes():
    import pyarrow as pa

    texts = ["x" * n for n in [10] * 3_000 + [3 << 20, 3 << 20, 9 << 20, 1, 2] + [100_000] * 100] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array([[1, 2]] * len(texts))], names=["k", "text", "ids"])
    parts = list(common.slices(batch))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    for part in parts:
        size = sum(len(t or "") for t in part.column(1).to_pylist())
        assert part.num_rows <= common.SLICE and (size <= common.SLICE_BYTES or part.num_rows == 1)
    assert list(common.slices(batch.slice(0, 0))) == []
