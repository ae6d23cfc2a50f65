"""Files joined of groups that many tasks write."""

import hashlib
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tramline.sources import bundle, joined

SCHEMA = pa.schema([pa.field("k", pa.int64(), nullable=False), pa.field("name", pa.string())]).with_metadata({"mark": "here"})


@pytest.mark.parametrize("n", [0, 1, 99, 100, 101, 1_050])
def test_one_file_of_many_groups(spark, tmp_path, n):
    rows = spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("n"), "id")).alias("name"))
    digests = set()
    for parts in (1, 3, 7):
        path = str(tmp_path / f"{parts}.parquet")
        mixed = rows.repartition(parts, F.xxhash64("k"))
        assert joined.write_parquet(mixed, ["k"], path, SCHEMA, 100) == n
        digests.add(hashlib.sha256(open(path, "rb").read()).hexdigest())
        file = pq.ParquetFile(path)
        assert [file.metadata.row_group(g).num_rows for g in range(file.metadata.num_row_groups)] == [100] * (n // 100) + [n % 100] * bool(n % 100) or n == 0
        assert file.schema_arrow.metadata[b"mark"] == b"here" and not file.schema_arrow.field("k").nullable
        assert file.read().column("k").to_pylist() == list(range(n))
        assert sorted(r.k for r in spark.read.parquet(path).filter("k >= 50").collect()) == list(range(50, n))
    assert len(digests) == 1 and sorted(os.listdir(tmp_path)) == ["1.parquet", "3.parquet", "7.parquet"]


def test_groups_are_written_by_tasks_of_their_own(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def encode(path, batches, group):
        (seen / f"{group}-{os.getpid()}").touch()
        pq.write_table(pa.Table.from_batches(batches), path)

    paths, n = joined.write_groups(spark.range(1_000).toDF("k").repartition(5), ["k"], str(tmp_path / "parts"), encode, 125)
    assert n == 1_000 and len(paths) == 8 and len(os.listdir(seen)) == 8
    for g, path in enumerate(paths):
        assert pq.read_table(path).column("k").to_pylist() == list(range(125 * g, 125 * g + 125))


def test_csv_of_many_groups(spark, tmp_path, monkeypatch):
    rows = spark.range(300).select(F.lpad("id", 3, "0").alias("k"), (F.col("id") % 2 == 0).alias("even"), F.when(F.col("id") % 5 > 0, 'a "b", c').alias("t"))
    whole = str(tmp_path / "a.csv")
    assert bundle.write_csv(rows, whole, ["k"]) == 300
    write = joined.write_sorted
    monkeypatch.setattr(joined, "write_sorted", lambda *a: write(*a, size=7))
    assert bundle.write_csv(rows.repartition(6), str(tmp_path / "b.csv"), ["k"]) == 300
    text = open(whole, "rb").read()
    assert text == open(tmp_path / "b.csv", "rb").read() and text.startswith(b'k,even,t\r\n000,1,\r\n001,0,"a ""b"", c"\r\n')


def test_small_row_groups_share_tasks(spark, tmp_path, monkeypatch):
    """Row groups stay as small as asked, and a part holds several."""
    monkeypatch.setattr(joined, "GROUP", 250)
    parts = []
    known = joined.join_parquet
    monkeypatch.setattr(joined, "join_parquet", lambda spark, paths, path: parts.append(len(paths)) or known(spark, paths, path))
    rows = spark.range(1_030).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name")).repartition(3, F.xxhash64("id"))
    path = str(tmp_path / "x.parquet")
    assert joined.write_parquet(rows, ["k"], path, SCHEMA, 100) == 1_030 and parts == [6]
    file = pq.ParquetFile(path)
    assert [file.metadata.row_group(g).num_rows for g in range(file.metadata.num_row_groups)] == [100] * 10 + [30]
    assert file.read().column("k").to_pylist() == list(range(1_030))
