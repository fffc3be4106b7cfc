"""Nearest points against brute force: dense places, the date line, the poles, bands, ties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridlode.operators import cell_tree, spatial

POINTS = "gid long, longitude double, latitude double, depth_m double, temperature_f double"
PROBES = "site long, lng double, lat double, depth double"


def km(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))


def brute(probes, points, most, depth):
    out = {}
    for site, x, y, d in probes:
        near = [] if x is None or y is None else [(km((x, y), (p[1], p[2])), p[0]) for p in points if p[1] is not None and p[3] is not None and abs(p[3] - d) <= depth]
        near = [n for n in near if n[0] <= most]
        out[site] = min(near) if near else None
    return out


@pytest.mark.parametrize("most", [5, 40, 1000])
def test_within_radius(spark, monkeypatch, most):
    monkeypatch.setattr(cell_tree, "MOST", most)
    monkeypatch.setattr(cell_tree, "PROBES", 7)
    r = random.Random(most)
    dense = [(r.gauss(10, 0.01), r.gauss(50, 0.01)) for _ in range(400)]
    line = [(r.choice([179.9, -179.9, 179.99, -180.0, 180.0]) + r.uniform(-0.05, 0.05) * 0, r.uniform(-1, 1)) for _ in range(60)]
    pole = [(r.uniform(-180, 180), r.choice([89.9, -89.95, 89.5])) for _ in range(60)]
    places = dense + line + pole + [(10.0, 50.0)] * 30 + [(r.uniform(-180, 180), r.uniform(-80, 80)) for _ in range(100)]
    points = [(i, x, y, r.choice([1000.0, 1050.0, 3000.0]), float(i)) for i, (x, y) in enumerate(places)] + [(9001, None, 1.0, 1000.0, 1.0), (9002, 10.0, 50.0, None, 1.0)]
    probes = [(i, *r.choice(places[:520]), 1000.0) for i in range(80)] + [(100 + i, r.choice([179.95, -179.95, 180.0, -180.0]), r.uniform(-1, 1), 1000.0) for i in range(20)]
    probes += [(200 + i, r.uniform(-180, 180), 89.8, 3000.0) for i in range(10)] + [(300, 10.0, 50.0, 3000.0), (301, None, 3.0, 1.0), (302, 0.0, -40.0, 9999.0)]
    got = spatial.within_radius(spark.createDataFrame(probes, PROBES), spark.createDataFrame(points, POINTS), "site").collect()
    want = brute(probes, points, 50.0, 100.0)
    assert len(got) == len(probes)
    for row in got:
        best = want[row["site"]]
        assert (row["distance_km"] is None) == (best is None), row
        if best:
            assert row["distance_km"] == pytest.approx(best[0], abs=1e-9) and row["temperature_f"] == float(best[1])
    assert sum(b is not None for b in want.values()) > 100


def test_the_date_line_is_no_border(spark):
    points = spark.createDataFrame([(1, -179.95, 10.0, 1000.0, 5.0)], POINTS)
    row = spatial.within_radius(spark.createDataFrame([(7, 179.95, 10.0, 1000.0)], PROBES), points, "site").head()
    assert row["distance_km"] == pytest.approx(10.95, abs=0.02) and row["temperature_f"] == 5.0


def test_nearest_in_cells(spark, monkeypatch):
    monkeypatch.setattr(cell_tree, "MOST", 8)
    r = random.Random(4)
    right = [(i, *r.choice([(r.gauss(3, 0.003), r.gauss(3, 0.003)), (r.uniform(-5, 5), r.uniform(-5, 5)), (3.0, 3.0), (-0.5, 0.5)])) for i in range(700)]
    left = [(i, r.uniform(-6, 6), r.uniform(-6, 6)) for i in range(150)] + [(200 + i, 3 + r.uniform(-0.01, 0.01), 3.0) for i in range(50)] + [(400, None, 1.0), (401, 50.0, 50.0)]
    got = spatial.nearest_in_cells(spark.createDataFrame(left, "k long, x double, y double"), spark.createDataFrame(right, "c long, lon double, lat double"), "k", "x", "y", "lon", "lat", ["c"], 0.5, "c").collect()
    for row in got:
        near = [] if row["x"] is None else [(math.hypot(row["x"] - p[1], row["y"] - p[2]), p[0]) for p in right if abs(math.floor(p[1] / 0.5) - math.floor(row["x"] / 0.5)) <= 1 and abs(math.floor(p[2] / 0.5) - math.floor(row["y"] / 0.5)) <= 1]
        best = min(near) if near else (None, None)
        assert row["c"] == best[1] and (best[0] is None or row["distance"] == pytest.approx(best[0], abs=1e-12))
    assert len(got) == len(left)


def test_a_dense_cell_goes_to_many_leaves(spark):
    """A hundred thousand points in a tenth of a cell, a third of them in one place."""
    n = 100_000
    at = lambda c, k: F.when(F.col("id") % 3 == 0, F.lit(0.25)).otherwise(F.pmod(F.xxhash64(c, F.lit(k)), F.lit(10**9)) / 1e10)
    points = spark.range(n).select(F.col("id").alias("c"), at("id", 1).alias("lon"), at("id", 2).alias("lat"))
    tree = cell_tree.CellTree(points, "lon", "lat", ["c"], 0.5, cell_tree.Plane(), tie="c")
    sizes = [r["count"] for r in tree.points.groupBy("_level", "_bx", "_by", "_i", "_j").count().collect()]
    assert max(sizes) <= cell_tree.MOST and sum(sizes) == n - (n + 2) // 3 + 1 and len(sizes) > 60
    probes = spark.range(300).select(F.col("id").alias("k"), (F.col("id") / 3000).alias("x"), (F.col("id") / 4000).alias("y"))
    cells = F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")))
    assert tree.nearest(probes, "k", "x", "y", cells).count() == 300


def test_empty_tables(spark):
    none = spark.createDataFrame([], POINTS)
    probes = spark.createDataFrame([(1, 0.0, 0.0, 1.0)], PROBES)
    assert spatial.within_radius(probes, none, "site").head()["distance_km"] is None
    assert spatial.within_radius(probes.limit(0), none, "site").count() == 0


def test_points_in_no_band_are_left_out_first(spark, monkeypatch):
    """Of a leaf's points one row comes to a probe, and only points that some probe may take are put into cells."""
    kept = []

    class Spy(cell_tree.CellTree):
        def __init__(self, points, *args, **more):
            kept.append(points.count())
            super().__init__(points, *args, **more)

        def _best(self, met, key, within):
            kept.append(met.count())
            return super()._best(met, key, within)

    monkeypatch.setattr(spatial, "CellTree", Spy)
    points = spark.createDataFrame([(i, 10.0 + i * 1e-4, 50.0, 1000.0 + i % 5 * 500, float(i)) for i in range(100)], POINTS)
    probes = spark.createDataFrame([(1, 10.0, 50.0, 1500.0)], PROBES)
    [best] = spatial.within_radius(probes, points, "site").collect()
    assert best["temperature_f"] == 1.0 and kept == [20, 1]
