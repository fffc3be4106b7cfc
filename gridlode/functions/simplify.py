"""Line simplification: iterative, so each line is one call of a small helper in an Arrow-batched function."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"


def _visvalingam(pts: list, least: float) -> list:
    """Drops points whose triangle with their neighbours is smaller than `least`, smallest first."""
    n = len(pts)
    before, after, gone = list(range(-1, n - 1)), list(range(1, n + 1)), [False] * n
    area = lambda i: abs((pts[before[i]][0] - pts[i][0]) * (pts[after[i]][1] - pts[i][1]) - (pts[after[i]][0] - pts[i][0]) * (pts[before[i]][1] - pts[i][1])) / 2
    heap = [(area(i), i) for i in range(1, n - 1)]
    now = {i: a for a, i in heap}
    heapq.heapify(heap)
    while heap:
        a, i = heapq.heappop(heap)
        if gone[i] or now[i] != a:
            continue
        if a >= least:
            break
        gone[i] = True
        after[before[i]], before[after[i]] = after[i], before[i]
        for j in (before[i], after[i]):
            if 0 < j < n - 1:
                now[j] = max(a, area(j))  # never before the one that made it small
                heapq.heappush(heap, (now[j], j))
    return [p for p, g in zip(pts, gone) if not g]


def _douglas_peucker(pts: list, tolerance: float) -> list:
    """Keeps points further than `tolerance` from the chord of their part, without recursion."""
    keep, todo = {0, len(pts) - 1}, [(0, len(pts) - 1)]
    while todo:
        a, b = todo.pop()
        (ax, ay), (bx, by) = pts[a], pts[b]
        length = (bx - ax) ** 2 + (by - ay) ** 2
        worst, at = tolerance**2, None
        for i in range(a + 1, b):
            x, y = pts[i]
            t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / length)) if length else 0.0
            d = (x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by - ay)) ** 2
            if d > worst:
                worst, at = d, i
        if at is not None:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return [pts[i] for i in sorted(keep)]


def _each(reduce, amount: float):
    @F.pandas_udf(POINTS)
    def run(lines: pd.Series) -> pd.Series:
        def one(line):
            if line is None:
                return None
            pts = [(p["x"], p["y"]) for p in line]
            return [{"x": x, "y": y} for x, y in (reduce(pts, amount) if len(pts) > 2 else pts)]

        return lines.map(one)

    return run


def simplify_area(line, least: float):
    """Visvalingam's method."""
    return _each(_visvalingam, least)(line)


def simplify_distance(line, tolerance: float):
    """Douglas and Peucker's method."""
    return _each(_douglas_peucker, tolerance)(line)
