"""Archives whose members many tasks read."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tramline.sources import archives, readers


def packed(members, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, content in members.items():
            z.writestr(name, content)
    return out.getvalue()


def noise(n, seed):
    return random.Random(seed).randbytes(n)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("archives")
    inner = packed({f"i{k}.xml": noise(3_000, k) for k in range(20)} | {"other.txt": b"no"})
    deep = packed({"mid.zip": packed({"deep.xml": b"<deep/>"}), "mid.XML": b"<mid/>"}, zipfile.ZIP_STORED)
    (base / "a.zip").write_bytes(packed({f"m{k}.xml": noise(20_000, k) for k in range(50)} | {"inner.ZIP": inner, "deep.zip": deep, "empty.xml": b"", "zeros.xml": bytes(5 << 20), "d/x.txt": b"no"}))
    (base / "b.zip").write_bytes(packed({"s.xml": noise(9_999, 1), "inner.zip": inner}, zipfile.ZIP_STORED))
    (base / "c.zip").write_bytes(packed({}))
    return base


@pytest.mark.parametrize("depth", [1, 2])
def test_members_are_those_of_whole_archives(spark, folder, depth):
    key = lambda r: (r.archive, r.member, r.bytes, r.sha256)
    got = archives.split_members(spark, str(folder), depth=depth, task_bytes=100_000)
    whole = readers.archive_members(spark, str(folder), depth=depth)
    assert sorted(map(key, got.collect())) == sorted(map(key, whole.collect())) and got.columns == whole.columns


def test_three_levels(spark, folder):
    got = archives.split_members(spark, str(folder / "a.zip"), depth=3)
    assert {r.member: r.bytes for r in got.filter("member LIKE 'deep%'").collect()} == {"deep.zip!mid.XML": 6, "deep.zip!mid.zip!deep.xml": 7}


def test_an_archive_is_read_by_many_tasks(spark, folder):
    got = archives.split_members(spark, str(folder / "a.zip"), task_bytes=100_000)
    sizes = got.groupBy(F.spark_partition_id()).agg(F.count("*")).collect()
    assert len(sizes) >= 6


def test_parts_of_a_member_are_bounded():
    data = packed({"zeros.xml": bytes(30 << 20)})
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        i = z.infolist()[0]
    row = type("Row", (), dict(archive="a", member=i.filename, offset=i.header_offset, packed=i.compress_size, bytes=i.file_size, method=i.compress_type, crc=i.CRC))
    sizes = [len(p) for p in archives.pieces(io.BytesIO(data), row)]
    assert sum(sizes) == 30 << 20 and max(sizes) <= archives.PIECE


@pytest.mark.parametrize("members, said", [({"../x.xml": b"a"}, "unsafe"), ({"A.xml": b"a", "a.xml": b"b"}, "repeat"), ({"/x.xml": b"a"}, "unsafe")])
def test_bad_names(spark, tmp_path, members, said):
    (tmp_path / "a.zip").write_bytes(packed(members))
    with pytest.raises(Exception, match=said):
        archives.split_members(spark, str(tmp_path)).collect()


def test_a_changed_byte(spark, tmp_path):
    data = bytearray(packed({"a.xml": noise(5_000, 1)}, zipfile.ZIP_STORED))
    data[2_000] ^= 1
    (tmp_path / "a.zip").write_bytes(bytes(data))
    with pytest.raises(Exception, match="checksum"):
        archives.split_members(spark, str(tmp_path)).collect()
