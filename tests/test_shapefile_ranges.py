"""Unpacked shapefiles by ranges of their index, and archives in bounded batches."""

import io
import random
import struct
import zipfile

import pytest

from gridlode.sources import shapefile, shapefile_ranges


def unpacked(path, n, table=True):
    r = random.Random(n)
    rings = []
    for i in range(n):
        ring = [(i + r.random(), i - r.random()) for _ in range(r.randint(3, 9))]
        rings.append(ring + ring[:1])
    keys = [f"k{i} é" if i % 5 else f"k{i}" for i in range(n)]
    with zipfile.ZipFile(io.BytesIO(shapefile.archive(keys, rings))) as z:
        shp, dbf = z.read("cells.shp"), z.read("cells.dbf")
    index, at = b"", 100
    while at < len(shp):
        size = struct.unpack(">i", shp[at + 4 : at + 8])[0]
        index += struct.pack(">2i", at // 2, size)
        at += 8 + 2 * size
    path.with_suffix(".shp").write_bytes(shp)
    path.with_suffix(".shx").write_bytes(shp[:100] + index)
    if table:
        path.with_suffix(".DBF").write_bytes(dbf)
    return keys, rings


@pytest.mark.parametrize("records", [7, 100, 50_000])
def test_ranges_of_records(spark, tmp_path, records, monkeypatch):
    monkeypatch.setattr(shapefile_ranges, "BATCH_RECORDS", 3)
    (tmp_path / "deep").mkdir()
    keys, rings = unpacked(tmp_path / "a", 101)
    unpacked(tmp_path / "deep" / "b", 1, table=False)
    df = shapefile_ranges.read_shapefile_ranges(spark, str(tmp_path), records)
    assert df.rdd.getNumPartitions() == -(-101 // records) + 1
    got = {(r["layer"], r["record"]): r for r in df.collect()}
    assert len(got) == 102 and got["b.shp", 0]["attributes"] == {} and got["b.shp", 0]["kind"] == "Polygon"
    for i in range(101):
        row = got["a.shp", i]
        assert row["attributes"]["KEY"].startswith(f"k{i}") and [(p["x"], p["y"]) for p in row["parts"][0]] == rings[i]


def test_one_file_and_none(spark, tmp_path):
    unpacked(tmp_path / "a", 5)
    assert shapefile_ranges.read_shapefile_ranges(spark, str(tmp_path / "a.shp"), 2).where("record >= 3").count() == 2
    (tmp_path / "empty").mkdir()
    assert shapefile_ranges.read_shapefile_ranges(spark, str(tmp_path / "empty")).count() == 0
    (tmp_path / "a.shx").unlink()
    with pytest.raises(Exception, match="no .shx"):
        shapefile_ranges.read_shapefile_ranges(spark, str(tmp_path / "a.shp")).count()


def test_archives_in_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shapefile, "BATCH", 4)
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    (tmp_path / "a.zip").write_bytes(shapefile.archive([f"k{i}" for i in range(11)], [ring] * 11))
    got = shapefile.read_shapefiles(spark, str(tmp_path)).collect()
    assert sorted((r["record"], r["attributes"]["KEY"]) for r in got) == [(i, f"k{i}") for i in range(11)]
