"""Shapes against boundary polygons by coverings: cells wholly inside a polygon, and edge cells with the edges in them.

A shape meets a polygon if it touches a cell wholly inside it: an equi-join. Only in edge cells do its edges meet the
polygon's, those of the same cell, and only there is it asked whether the shape lies inside: from the parity of the
edges between a corner of the shape and the cell's reference point, of which the covering knows whether it is inside.
Polygons are even-odd: rings of several parts and holes of any order. Touching is meeting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint

#: Where a cell's reference point is, in cells: off any regular grid.
REFERENCE = (0.5 + 0.0137**0.5 / 9, 0.5 - 0.0173**0.5 / 7)
#: An edge meets cells that are up to so far away, in cells, so that rounding loses none.
MARGIN = 1e-9


def turn(ax, ay, bx, by, px, py) -> Column:
    """Positive if p is left of the line from a to b."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def segments_meet(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether segments a b and c d have a point in common."""
    d1, d2 = turn(cx, cy, dx, dy, ax, ay), turn(cx, cy, dx, dy, bx, by)
    d3, d4 = turn(ax, ay, bx, by, cx, cy), turn(ax, ay, bx, by, dx, dy)
    boxes = (F.least(ax, bx) <= F.greatest(cx, dx)) & (F.least(cx, dx) <= F.greatest(ax, bx)) & (F.least(ay, by) <= F.greatest(cy, dy)) & (F.least(cy, dy) <= F.greatest(ay, by))
    return boxes & ~((d1 > 0) & (d2 > 0)) & ~((d1 < 0) & (d2 < 0)) & ~((d3 > 0) & (d4 > 0)) & ~((d3 < 0) & (d4 < 0))


def separated(ax, ay, bx, by, px, py, qx, qy) -> Column:
    """Whether edge a b crosses the way from p to q; ends on the way count to its left, so that each crossing counts once."""
    return ((turn(px, py, qx, qy, ax, ay) >= 0) != (turn(px, py, qx, qy, bx, by) >= 0)) & ((turn(ax, ay, bx, by, px, py) >= 0) != (turn(ax, ay, bx, by, qx, qy) >= 0))


def edges_of(boundaries: DataFrame, key: str) -> DataFrame:
    """boundaries: key, polygons (parts of rings of points x, y) -> key, ax, ay, bx, by of each edge; rings are closed if they aren't."""
    rings = boundaries.select(key, F.explode(F.flatten("polygons")).alias("r")).where("size(r) > 2")
    pairs = F.transform("r", lambda p, i: F.struct(p.alias("a"), F.get("r", F.when(i + 1 < F.size("r"), i + 1).otherwise(0)).alias("b")))
    rows = rings.select(key, F.explode(pairs).alias("e")).where("e.a <> e.b")
    return rows.select(key, F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))


def _cell(v, step: float, off: float = 0.0) -> Column:
    return F.floor(v / step + off).cast("long")


def covering(boundaries: DataFrame, key: str, step: float) -> tuple[DataFrame, DataFrame]:
    """(cells: key, cx, cy, edge, inside; edges: key, cx, cy, ax, ay, bx, by) of polygons; step: the size of a cell.

    Edge cells are as many as the polygons' outlines are long in cells, those inside as their areas have. inside is
    said of the cell's reference point. Long edges are cut by rows of cells, so that no edge makes a box of cells.
    """
    edges = checkpoint(edges_of(boundaries, key))
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    rows = edges.select("*", F.explode(F.sequence(_cell(low, step, -MARGIN), _cell(high, step, MARGIN))).alias("cy"))
    at = lambda y: F.col("ax") + (F.least(F.greatest(y, low), high) - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    flat = F.col("ay") == F.col("by")
    ends = F.when(flat, F.col("ax")).otherwise(at(F.col("cy") * step)), F.when(flat, F.col("bx")).otherwise(at((F.col("cy") + 1) * step))
    spread = rows.select("*", F.explode(F.sequence(_cell(F.least(*ends), step, -MARGIN), _cell(F.greatest(*ends), step, MARGIN))).alias("cx"))
    placed = checkpoint(spread.select(key, "cx", "cy", "ax", "ay", "bx", "by"))
    # where edges cross the line of reference points of a row, from left to right: inside between the first and second, ...
    y = (F.col("cy") + REFERENCE[1]) * step
    crossed = rows.where((F.col("ay") > y) != (F.col("by") > y)).withColumn("x", F.col("ax") + (y - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay")))
    spans = crossed.groupBy(key, "cy").agg(F.array_sort(F.collect_list("x")).alias("l"))
    pair = F.transform(F.sequence(F.lit(0), (F.size("l") / 2).cast("int") - 1), lambda i: F.struct(F.get("l", 2 * i).alias("a"), F.get("l", 2 * i + 1).alias("b")))
    # the first and last cells whose reference points lie between
    first, last = F.ceil(F.col("s.a") / step - REFERENCE[0]).cast("long"), (F.ceil(F.col("s.b") / step - REFERENCE[0]) - 1).cast("long")
    inner = spans.where("size(l) > 1").select(key, "cy", F.explode(pair).alias("s")).select(key, "cy", first.alias("i"), last.alias("j")).where("i <= j")
    inside = inner.select(key, F.explode(F.sequence("i", "j")).alias("cx"), "cy", F.lit(False).alias("edge"), F.lit(True).alias("inside"))
    outline = placed.select(key, "cx", "cy", F.lit(True).alias("edge"), F.lit(False).alias("inside"))
    cells = inside.unionByName(outline).groupBy(key, "cx", "cy").agg(F.max("edge").alias("edge"), F.max("inside").alias("inside"))
    return checkpoint(cells), placed


def meeting(shapes: DataFrame, shape_key: str, ring: str, cover: tuple[DataFrame, DataFrame], key: str, step: float) -> DataFrame:
    """shape_key, key of each convex shape (ring: closed, of points x, y) and each polygon that it meets."""
    cells, edges = cover
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    span = lambda v: F.sequence(_cell(F.array_min(v), step, -MARGIN), _cell(F.array_max(v), step, MARGIN))
    first = F.get(ring, 0)
    whole = shapes.where(F.size(ring) > 3).select(shape_key, F.col(ring).alias("_r"), first["x"].alias("_px"), first["y"].alias("_py"), span(xs).alias("_xs"), F.explode(span(ys)).alias("cy"))
    touched = whole.select(shape_key, "_r", "_px", "_py", "cy", F.explode("_xs").alias("cx"))
    met = touched.join(cells, ["cx", "cy"])
    # the box around a shape has cells that it doesn't touch: only its corners' cells are sure
    own = F.exists("_r", lambda p: (_cell(p["x"], step) == F.col("cx")) & (_cell(p["y"], step) == F.col("cy")))
    inner = met.where(~F.col("edge") & F.col("inside") & own).select(shape_key, key)
    near = met.where("edge").join(edges, [key, "cx", "cy"])
    a, b = ("ax", "ay"), ("bx", "by")
    edge = [F.col(c) for c in (*a, *b)]
    sides = F.transform(F.slice("_r", 2, F.size("_r") - 1), lambda q, i: F.struct(F.get("_r", i).alias("p"), q.alias("q")))
    crosses = F.exists(sides, lambda s: segments_meet(*edge, s["p"]["x"], s["p"]["y"], s["q"]["x"], s["q"]["y"]))
    left = lambda s: turn(s["p"]["x"], s["p"]["y"], s["q"]["x"], s["q"]["y"], F.col("ax"), F.col("ay"))
    holds = F.forall(sides, lambda s: left(s) >= 0) | F.forall(sides, lambda s: left(s) <= 0)
    home = (_cell(F.col("_px"), step) == F.col("cx")) & (_cell(F.col("_py"), step) == F.col("cy"))
    reference = ((F.col("cx") + REFERENCE[0]) * step, (F.col("cy") + REFERENCE[1]) * step)
    tested = near.select(
        shape_key,
        key,
        (crosses | holds).alias("hit"),
        (home & F.col("inside")).alias("from_inside"),
        F.when(home, separated(*edge, F.col("_px"), F.col("_py"), *reference)).otherwise(False).alias("between"),
    )
    found = tested.groupBy(shape_key, key).agg(F.max("hit").alias("hit"), (F.max(F.col("from_inside")).cast("int") + F.count_if("between")).alias("n"))
    return inner.unionByName(found.where("hit or n % 2 = 1").select(shape_key, key)).distinct()


def trim(cells: DataFrame, shape_key: str, ring: str, boundaries: DataFrame, key: str, step: float) -> DataFrame:
    """Cells (avg_temperature_f, ring) with data, and those without that meet any boundary."""
    empty = cells.where("avg_temperature_f is null")
    kept = meeting(empty, shape_key, ring, covering(boundaries, key, step), key, step).select(shape_key).distinct()
    return cells.where("avg_temperature_f is not null").unionByName(empty.join(kept, shape_key, "left_semi").select(*cells.columns))
