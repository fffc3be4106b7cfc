"""Clipping keeps lengths and areas, tiles decode to what was clipped."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridlode.operators import tiles

PARTS = "k long, name string, parts array<array<struct<x: double, y: double>>>"
Z = 4


def lonlat(x, y):
    """A place on the map in tiles -> degrees."""
    return x / 2**Z * 360 - 180, math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y / 2**Z))))


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def length(line):
    return sum(math.dist(a, b) for a, b in zip(line, line[1:]))


def frame(spark, shapes):
    return spark.createDataFrame([(k, f"n{k % 3}", [[lonlat(*p) for p in part] for part in parts]) for k, parts in enumerate(shapes)], PARTS)


def clipped(spark, shapes, clip):
    rows = clip(tiles.fan_out(frame(spark, shapes), "parts", Z), "parts").collect()
    return [(r["k"], r["tx"], r["ty"], [[(p["x"], p["y"]) for p in part] for part in r["parts"]]) for r in rows]


def test_polygons_keep_their_area(spark):
    r = random.Random(1)
    rings = []
    for _ in range(25):
        x, y, n = r.uniform(2, 14), r.uniform(2, 14), r.randint(3, 12)
        rings.append([[(x + r.uniform(0.2, 1.9) * math.cos(2 * math.pi * i / n), y + r.uniform(0.2, 1.9) * math.sin(2 * math.pi * i / n)) for i in range(n)]])
    rings.append([[(3.0, 3.0), (6.0, 3.0), (6.0, 6.0), (3.0, 6.0), (3.0, 3.0)], [(4.2, 4.2), (4.2, 5.8), (5.8, 5.8), (5.8, 4.2)]])
    found = clipped(spark, rings, tiles.clip_polygons)
    for k, parts in enumerate(rings):
        mine = [x for x in found if x[0] == k]
        assert sum(area(p) for x in mine for p in x[3]) == pytest.approx(sum(map(area, parts)), rel=1e-6)
        assert all(tx - 1e-6 <= px <= tx + 1 + 1e-6 and ty - 1e-6 <= py <= ty + 1 + 1e-6 for _, tx, ty, ps in mine for p in ps for px, py in p)
    assert len(found) > 60


def test_lines_keep_their_length(spark):
    r = random.Random(2)
    lines = [[[(r.uniform(1, 15), r.uniform(1, 15)) for _ in range(r.randint(2, 9))]] for _ in range(25)]
    lines += [[[(2.0, 2.5), (7.0, 2.5)]], [[(2.2, 2.2), (2.4, 2.4), (2.2, 2.7), (2.6, 2.6)], [(9.5, 9.5), (9.6, 9.6)]], [[(5.5, 5.5)]], [[]]]
    found = clipped(spark, lines, tiles.clip_lines)
    for k, parts in enumerate(lines):
        assert sum(length(p) for x in found if x[0] == k for p in x[3]) == pytest.approx(sum(map(length, parts)), rel=1e-6)
    # a line that stays in a tile stays whole, one that leaves and comes back is in pieces
    assert [len(p) for x in found if x[0] == 26 for p in sorted(x[3])] in ([4, 2], [4], [2, 4]) or sorted(len(p) for x in found if x[0] == 26 for p in x[3]) == [2, 4]
    assert {x[1] for x in found if x[0] == 25} == set(range(2, 7))


@pytest.mark.parametrize("kind", [tiles.POINT, tiles.LINE, tiles.POLYGON])
def test_tiles_decode_to_their_rows(spark, kind):
    r = random.Random(kind)
    shapes = [[[(r.uniform(1, 15), r.uniform(1, 15)) for _ in range(r.randint(3, 6))] for _ in range(r.randint(1, 2))] for _ in range(40)]
    rows = tiles.tile_rows(frame(spark, shapes).withColumns({"big": F.lit(1 << 40), "none": F.lit(None).cast("int"), "half": F.lit(0.5), "yes": F.lit(True), "low": -F.col("k")}), "parts", Z, kind)
    want = {(x["tx"], x["ty"], x["k"], x["name"], -x["k"], tuple(tuple(map(tuple, p)) for p in x["parts"])) for x in rows.collect()}
    made = tiles.encode_tiles(rows, "parts", "shapes", kind, key="k")
    got = set()
    for t in made.collect():
        found = tiles.decode_tile(bytes(t["tile"]))
        assert len(found) == t["features"] and [f["id"] for f in found] == sorted(f["id"] for f in found)
        for f in found:
            props = f["properties"]
            assert f["layer"] == "shapes" and f["kind"] == kind and props["big"] == 1 << 40 and "none" not in props and props["half"] == 0.5 and props["yes"] is True
            parts = f["parts"]
            if kind == tiles.POINT:
                parts = [[p for part in parts for p in part]]
            got.add((t["tx"], t["ty"], f["id"], props["name"], props["low"], tuple(map(tuple, parts))))
    if kind == tiles.POINT:
        want = {(*x[:5], (tuple(p for part in x[5] for p in part),)) for x in want}
    assert got == want and len(want) > 40
    assert made.select("tx", "ty").distinct().count() == made.count()
    back = tiles.read_tiles(made, "name string, low long")
    assert back.count() == len(want) and {x["name"] for x in back.collect()} == {"n0", "n1", "n2"}


def test_known_bytes():
    """The worked examples of the format's description."""
    assert tiles.geometry([[(25, 17)]], tiles.POINT) == bytes([9, 50, 34])
    assert tiles.geometry([[(5, 7), (3, 2)]], tiles.POINT) == bytes([17, 10, 14, 3, 9])
    assert tiles.geometry([[(2, 2), (2, 10), (10, 10)]], tiles.LINE) == bytes([9, 4, 4, 18, 0, 16, 16, 0])
    assert tiles.geometry([[(3, 6), (8, 12), (20, 34)]], tiles.POLYGON) == bytes([9, 6, 12, 18, 10, 12, 24, 44, 15])


def test_poles_and_empty_tables(spark):
    far = frame(spark, [[[(1.5, 3.0)]]]).withColumn("parts", F.array(F.array(F.struct(F.lit(180.0).alias("x"), F.lit(90.0).alias("y")))))
    assert tiles.fan_out(far, "parts", Z).select("tx", "ty").collect()[0] == (15, 0)
    none = spark.createDataFrame([], PARTS)
    assert tiles.encode_tiles(tiles.tile_rows(none, "parts", Z, tiles.LINE), "parts", "l", tiles.LINE).count() == 0


def test_tiles_are_made_by_the_set_number_of_tasks(spark):
    """Small tiles too: Spark would join their partitions by bytes, and one task would write and read them all."""
    rows = tiles.tile_rows(frame(spark, [[[(x + 0.2, y + 0.2), (x + 0.7, y + 0.6)]] for x in range(2, 14) for y in range(2, 14)]), "parts", Z, tiles.LINE)
    made = tiles.encode_tiles(rows, "parts", "lines", tiles.LINE, key="k")
    tasks = made.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_tile_is_read_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TOGETHER", 7)
    rows = tiles.tile_rows(frame(spark, [[[(2.1, 2.1 + k / 99), (2.9, 2.5)], [(2.2, 2.2), (2.3, 2.4), (2.5, 2.1)]] for k in range(40)]), "parts", Z, tiles.LINE)
    made = tiles.encode_tiles(rows, "parts", "lines", tiles.LINE, key="k")
    back = tiles.read_tiles(made, "name string")
    want = {(x["k"], x["name"], str(x["parts"])) for x in rows.collect()}
    assert {(x["id"], x["name"], str(x["parts"])) for x in back.collect()} == want and len(want) == 40
