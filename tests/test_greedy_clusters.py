"""Greedy clusters against the plain loop over items in their order, zoom by zoom."""

import random

import pytest
from pyspark.sql import functions as F

from gridlode.operators import greedy_clusters as gc

POINTS = "id long, longitude double, latitude double, acres double, lon string"


def brute(items, least, most, radius):
    """items: (order, x, y, n, w), gone through one by one; earlier clusters first at the next zoom."""
    out = {}
    for zoom in range(most, least - 1, -1):
        reach, taken, made = (radius * gc.UNITS) // (gc.PIXELS << zoom), set(), []
        items = sorted(items)
        for i, (order, x, y, *_) in enumerate(items):
            if i in taken:
                continue
            own = [j for j in range(len(items)) if j not in taken and (items[j][1] - x) ** 2 + (items[j][2] - y) ** 2 <= reach * reach]
            taken.update(own)
            n = sum(items[j][3] for j in own)
            made.append((order, sum(items[j][1] * items[j][3] for j in own) // n, sum(items[j][2] * items[j][3] for j in own) // n, n, sum(items[j][4] for j in own)))
        items = out[zoom] = made
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    places = [(r.gauss(-100, 0.004), r.gauss(40, 0.004)) for _ in range(150)] + [(r.gauss(-100, 2), r.gauss(40, 2)) for _ in range(80)]
    places += [(-100.0 + k * 0.0015, 41.0) for k in range(60)] + [(-90.0, 30.0)] * 20 + [(-180.0, 0.0), (180.0, 0.0), (0.0, 90.0), (0.0, -90.0), (5.0, 87.0)]
    out = [(i, x, y, float(r.randint(0, 50)), "x") for i, (x, y) in enumerate(places)]
    return out + [(900, None, 1.0, 1.0, "x"), (901, 1.0, float("nan"), 1.0, "x"), (None, 1.0, 1.0, 1.0, "x"), (902, -100.0, 40.0, None, None), (3, -80.0, 35.0, 2.0, "x"), out[7]]


@pytest.mark.parametrize("fan, partitions, least", [(256, 3, 10), (1, 7, 13)])
def test_against_the_plain_loop(spark, rows, monkeypatch, fan, partitions, least):
    monkeypatch.setattr(gc, "FAN", fan)
    points = spark.createDataFrame(rows, POINTS).repartition(partitions)
    items = [((x["_h"], x["_key"], x["_x"], x["_y"]), x["_x"], x["_y"], x["_n"], x["_w"]) for x in gc._items(points, "id", "longitude", "latitude", "acres").collect()]
    assert sum(i[3] for i in items) == len(rows) - 3
    want = brute(items, least, 14, 50)
    got = dict(gc.cluster_levels(points, "id", "acres", least=least))
    assert list(got) == list(range(14, least - 1, -1)) and len({len(w) for w in want.values()}) == 15 - least
    for zoom, found in got.items():
        assert found.columns == ["id", "lon", "lat", "point_count", "acres"]
        found = found.collect()
        assert sorted((x["id"], x["point_count"], x["acres"]) for x in found) == sorted((o[1], n, w) for o, _, _, n, w in want[zoom])
        place = lambda v: round(v, 5)
        assert sorted(place((x["lon"] / 360 + 0.5) * (gc.UNITS - 1) / gc.UNITS) for x in found) == sorted(place(w[1] / gc.UNITS) for w in want[zoom])


def test_a_dense_cell_and_an_empty_table(spark):
    dense = spark.range(3000).select("id", (F.col("id") % 60 * 1e-5).alias("longitude"), (F.floor(F.col("id") / 60) * 1e-5).alias("latitude"), F.lit(1.0).alias("acres"))
    [(_, found)] = gc.cluster_levels(dense, "id", "acres", least=14)
    assert [(x["point_count"], x["acres"]) for x in found.collect()] == [(3000, 3000.0)]
    for zoom, none in gc.cluster_levels(dense.where("1 = 0"), "id", "acres", least=13):
        assert none.count() == 0
    with pytest.raises(ValueError):
        next(gc.cluster_levels(dense, "id", "acres", most=26))


def clusters_of(found):
    return sorted((x["id"], x["point_count"], x["acres"], round(x["lon"], 9), round(x["lat"], 9)) for x in found.collect())


def test_views_decide_nearly_all_and_rounds_the_rest(spark, monkeypatch):
    """Small views with hardly any halo, too few rows or pairs: what they leave goes through the rounds, to the same clusters."""
    r = random.Random(9)
    rows = [(i, r.gauss(-100, 0.03), r.gauss(40, 0.03), 1.0, "x") for i in range(1500)]
    points = spark.createDataFrame(rows, POINTS).repartition(5)
    whole = [clusters_of(found) for _, found in gc.cluster_levels(points, "id", "acres", least=13)]
    stages = []
    monkeypatch.setattr(gc, "_centres", lambda *a, made=gc._centres: stages.append(1) or made(*a))
    for name, value in (("VIEW", 4), ("MOST_ROWS", 50), ("MOST_PAIRS", 2000)):
        with monkeypatch.context() as m:
            for n, v in ((name, value), ("HALO", 1), ("TOGETHER", 20)):
                m.setattr(gc, n, v)
            assert [clusters_of(found) for _, found in gc.cluster_levels(points, "id", "acres", least=13)] == whole
    assert len(stages) >= 4  # rounds were needed


def test_disk_does_not_hold_items_many_times(spark, monkeypatch):
    """Scattered items are settled in their views: no rounds, which shuffled and stored each item again several times."""
    monkeypatch.setattr(gc, "_centres", lambda *a: pytest.fail("rounds over all tasks"))
    points = spark.range(4000).select("id", (-100 + F.rand(1) * 2).alias("longitude"), (40 + F.rand(2)).alias("latitude"), F.lit(1.0).alias("acres"))
    for _, found in gc.cluster_levels(points, "id", "acres", least=12):
        assert found.agg(F.sum("point_count")).head()[0] == 4000
