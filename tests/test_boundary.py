"""Coverings of polygons against brute force over all edges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridlode.operators import boundary

SHAPES = "k long, ring array<struct<x: double, y: double>>"
POLYGONS = "name string, polygons array<array<array<struct<x: double, y: double>>>>"


def star(r, x, y, size, n):
    return [(x + size * r.uniform(0.3, 1) * math.cos(2 * math.pi * i / n), y + size * r.uniform(0.3, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]


def turn(a, b, p):
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def meet(a, b, c, d):
    if max(a[0], b[0]) < min(c[0], d[0]) or max(c[0], d[0]) < min(a[0], b[0]) or max(a[1], b[1]) < min(c[1], d[1]) or max(c[1], d[1]) < min(a[1], b[1]):
        return False
    return turn(c, d, a) * turn(c, d, b) <= 0 and turn(a, b, c) * turn(a, b, d) <= 0


def inside(p, edges):
    return sum((a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0] for a, b in edges) % 2 == 1


def brute(ring, polygons):
    edges = [e for part in polygons for hole in part for e in zip(hole, hole[1:] + hole[:1]) if e[0] != e[1]]
    sides = list(zip(ring, ring[1:]))
    return any(meet(*s, *e) for s in sides for e in edges) or inside(ring[0], edges) or any(inside(e[0], sides) for e in edges)


def closed(ring):
    return ring + ring[:1]


@pytest.mark.parametrize("step", [0.3, 1.0, 7.0])
def test_against_brute_force(spark, step):
    r = random.Random(round(step * 10))
    polygons = {
        "square": [[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]]],
        "stars": [[star(r, -6, 2, 5, 40)], [star(r, 5, -5, 3, 7), star(r, 5, -5, 0.5, 5)]],
        "sliver": [[[(-9.0, -8.0), (9.0, 8.9), (9.0, 9.0)]]],
        "dot": [[[(2.02, 2.01), (2.04, 2.01), (2.03, 2.03)]]],
        "none": [],
    }
    hexagon = lambda x, y, s: closed([(x + s * math.cos(math.pi / 3 * i), y + s * math.sin(math.pi / 3 * i)) for i in range(6)])
    shapes = [hexagon(r.uniform(-12, 12), r.uniform(-12, 12), r.choice([0.05, 0.4, 1.7])) for _ in range(260)]
    shapes += [hexagon(2.0, 2.0, 0.3), hexagon(2.03, 2.017, 0.2), closed([(3.0, 1.5), (2.0, 1.5), (2.0, 2.0)]), closed([(4.0, 4.0), (5.0, 4.0), (5.0, 5.0)]), closed([(-1.0, 1.0), (0.0, 1.0), (-1.0, 2.0)]), hexagon(0.0, 0.0, 40.0)]
    cover = boundary.covering(spark.createDataFrame(list(polygons.items()), POLYGONS), "name", step)
    got = boundary.meeting(spark.createDataFrame(list(enumerate(shapes)), SHAPES), "k", "ring", cover, "name", step).collect()
    want = {(k, name) for k, ring in enumerate(shapes) for name, parts in polygons.items() if brute(ring, parts)}
    assert {tuple(x) for x in got} == want and len(got) == len(want) > 60
    assert {name for _, name in want} == polygons.keys() - {"none"}


def test_inner_cells_are_an_equi_join(spark):
    """A large square: the cells inside it carry no edges, and outlines, not areas, have edge cells."""
    ring = [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)]
    cells, edges = boundary.covering(spark.createDataFrame([("s", [[ring]])], POLYGONS), "name", 1.0)
    counts = {(r["edge"], r["inside"]): r["count"] for r in cells.groupBy("edge", "inside").count().collect()}
    assert counts[False, True] == 98 * 98 + 2 * 98 - 98 - 98 and 390 < sum(n for (edge, _), n in counts.items() if edge) < 820
    assert edges.groupBy("cx", "cy").count().agg(F.max("count")).head()[0] <= 4


def test_diagonals_make_no_boxes(spark):
    line = [(0.0, 0.0), (1000.0, 1000.0), (1000.0, 1000.5)]
    _, edges = boundary.covering(spark.createDataFrame([("s", [[line]])], POLYGONS), "name", 1.0)
    assert edges.count() < 6500


def test_trim_and_nulls(spark):
    polygons = spark.createDataFrame([("p", [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]]]), ("empty", None)], POLYGONS)
    rows = [(1, [(0.5, 0.2), (0.6, 0.2), (0.6, 0.3), (0.5, 0.2)], None), (2, [(5.0, 5.0), (6.0, 5.0), (6.0, 6.0), (5.0, 5.0)], None), (3, None, 3.0), (4, None, None)]
    cells = spark.createDataFrame(rows, SHAPES + ", avg_temperature_f double")
    assert sorted(r["k"] for r in boundary.trim(cells, "k", "ring", polygons, "name", 0.5).collect()) == [1, 3]
