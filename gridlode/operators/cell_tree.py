"""Nearest points in cells that are split by counted density.

Points lie in base cells; a cell with more than MOST points is split in four, again and again, so that a leaf has MOST
at the most, however dense a place is; points of one place are one row. A probe begins with the base cells around it and
goes down, level by level: it keeps the cells that can hold its nearest point, those whose box is not farther than the
far end of the closest one. Leaves that many probes come to are given to several tasks. So neither a dense cell of points
nor one of probes makes a large task, and no probe meets all points of a dense cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .shared import checkpoint, small, stored

#: Points of a leaf, at most.
MOST = 1000
#: Probes that meet one copy of a leaf.
PROBES = 10_000
#: A cell is split so many times at most: then its points are closer than a millionth of it.
DEPTH = 20

BOX = ("_w", "_s", "_e", "_n", "_lo", "_hi")


class Plane:
    """Distances in degrees of a flat map."""

    wraps = None

    def near(self, x, y) -> Column:
        """The least distance to the box, or less."""
        gap = lambda p, lo, hi: F.greatest(F.col(lo) - p, p - F.col(hi), F.lit(0.0))
        return self._length(gap(x, "_w", "_e"), gap(y, "_s", "_n"))

    def far(self, x, y) -> Column:
        """The largest distance to the box, or more."""
        span = lambda p, lo, hi: F.greatest(F.abs(p - F.col(lo)), F.abs(p - F.col(hi)))
        return self._length(span(x, "_w", "_e"), span(y, "_s", "_n")) * (1 + 1e-9) + 1e-9

    @staticmethod
    def _length(a, b) -> Column:
        return F.sqrt(a * a + b * b)

    def distance(self, x, y, lon, lat) -> Column:
        return geo.degree_distance(x, y, lon, lat)


class Sphere(Plane):
    """Great-circle distances in kilometres; longitudes go around."""

    wraps = 360.0

    def near(self, x, y) -> Column:
        r = geo.MEAN_RADIUS_KM
        turns = [F.greatest(F.col("_w") - x + k, x - k - F.col("_e"), F.lit(0.0)) for k in (-360.0, 0.0, 360.0)]
        # as far as the meridian of the box's nearer side, or its nearer parallel
        side = F.asin(F.least(F.lit(1.0), F.cos(F.radians(y)) * F.sin(F.radians(F.least(F.least(*turns), F.lit(90.0))))))
        return r * F.greatest(F.radians(F.greatest(F.col("_s") - y, y - F.col("_n"), F.lit(0.0))), side) * (1 - 1e-9) - 1e-9

    def far(self, x, y) -> Column:
        # along the probe's parallel, then along a meridian
        turns = [F.greatest(F.abs(x - k - F.col("_w")), F.abs(x - k - F.col("_e"))) for k in (-360.0, 0.0, 360.0)]
        along = F.cos(F.radians(y)) * F.radians(F.least(*turns))
        return geo.MEAN_RADIUS_KM * (along + F.radians(F.greatest(F.abs(y - F.col("_s")), F.abs(y - F.col("_n"))))) * (1 + 1e-9) + 1e-9

    def distance(self, x, y, lon, lat) -> Column:
        return geo.haversine_km(x, y, lon, lat)


class CellTree:
    """points: lon, lat, values, which can be ordered. band: a column that probes may bound; tie: the column that tells points of one place, or as near, apart."""

    def __init__(self, points: DataFrame, lon: str, lat: str, values: list[str], step: float, metric: Plane, band: str | None = None, tie: str | None = None):
        self.step, self.metric, self.values, self.tie = step, metric, values, tie
        self.columns = math.ceil(metric.wraps / step - 1e-9) if metric.wraps else None
        placed = points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull())
        rows = placed.select(
            F.col(lon).cast("double").alias("_lon"),
            F.col(lat).cast("double").alias("_lat"),
            (F.col(band).cast("double") if band else F.lit(0.0)).alias("_band"),
            F.struct(*values).alias("_v"),
            (F.col(tie) if tie else F.lit(0)).alias("_tie"),
        ).where("_band is not null")
        x, y = self.base(F.col("_lon"), F.col("_lat"))
        rows = rows.withColumns({"_bx": x, "_by": y})
        self.nodes, self.points = [], rows
        if rows.groupBy("_bx", "_by").count().where(F.col("count") > MOST).isEmpty():
            return  # every base cell is a leaf
        one = rows.groupBy("_lon", "_lat", "_band", "_bx", "_by")
        rest, level, nodes, leaves = one.agg(F.min_by("_v", "_tie").alias("_v"), F.min("_tie").alias("_tie")), 0, [], []
        while True:
            size = step / 2**level
            at = [self._child(c, b, size) for c, b in (("_lon", "_bx"), ("_lat", "_by"))]
            rest = stored(rest.withColumns({"_i": at[0], "_j": at[1]}))
            ends = [f(c).alias(n) for n, f, c in (("_w", F.min, "_lon"), ("_s", F.min, "_lat"), ("_e", F.max, "_lon"), ("_n", F.max, "_lat"), ("_lo", F.min, "_band"), ("_hi", F.max, "_band"))]
            cells = rest.groupBy("_bx", "_by", "_i", "_j").agg(F.count("*").alias("_c"), *ends)
            cells = stored(cells.withColumn("_dense", (F.col("_c") > MOST) & F.lit(level < DEPTH)))
            nodes.append(cells)
            dense = cells.where("_dense").select("_bx", "_by", "_i", "_j")
            if dense.isEmpty():
                leaves.append(rest.withColumn("_level", F.lit(level)))
                break
            same = ["_bx", "_by", "_i", "_j"]
            leaves.append(rest.join(small(dense), same, "left_anti").withColumn("_level", F.lit(level)))
            rest, level = rest.join(small(dense), same, "left_semi").drop("_i", "_j"), level + 1
        self.nodes = [small(n) for n in nodes]
        self.points = leaves[0]
        for more in leaves[1:]:
            self.points = self.points.unionByName(more)

    def base(self, x: Column, y: Column) -> tuple[Column, Column]:
        """The base cell of a place; on the sphere columns go around."""
        i, j = F.floor(x / self.step).cast("long"), F.floor(y / self.step).cast("long")
        if self.columns:
            i = F.least(F.floor(F.pmod(x + 180.0, F.lit(360.0)) / self.step), F.lit(self.columns - 1)).cast("long")
        return i, j

    def _child(self, c: str, b: str, size: float) -> Column:
        """The place of a point's cell among those of a size in its base cell."""
        v = F.col(c)
        if self.columns and c == "_lon":
            v = F.pmod(v + 180.0, F.lit(360.0))
        n = round(self.step / size)
        # the last column of the sphere may be wider than a step
        return F.least(F.greatest(F.floor((v - F.col(b) * self.step) / size), F.lit(0)), F.lit(n - 1)).cast("long")

    def nearest(self, probes: DataFrame, key: str, x: str, y: str, cells: Column, within: float | None = None, band: tuple[str, str] | None = None) -> DataFrame:
        """key, values, distance of the nearest point of each probe that has one in its base cells (array of structs i, j), no farther than within.

        band: columns of the probes, the least and largest value of the band's column. Keys are unique.
        """
        bounds = [F.col(band[0]).cast("double"), F.col(band[1]).cast("double")] if band else [F.lit(-1.0), F.lit(1.0)]
        start = probes.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).alias("_k"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), bounds[0].alias("_least"), bounds[1].alias("_most"), F.explode(cells).alias("_o"))
        own = ["_k", "_x", "_y", "_least", "_most"]
        wrap = (lambda i: F.pmod(i, F.lit(self.columns))) if self.columns else (lambda i: i)
        at = start.select(*own, wrap(F.col("_o.i")).alias("_bx"), F.col("_o.j").alias("_by"))
        if not self.nodes:
            there = self.points.groupBy("_bx", "_by").agg(self._points())
            return self._best(at.join(there, ["_bx", "_by"]), key, within)
        at = (at.distinct() if self.columns else at).join(self.nodes[0], ["_bx", "_by"])
        found = None
        for level in range(len(self.nodes)):
            near, far = self.metric.near(F.col("_x"), F.col("_y")), self.metric.far(F.col("_x"), F.col("_y"))
            # the far end counts only if all points of the cell are in the band
            sure = F.when((F.col("_lo") >= F.col("_least")) & (F.col("_hi") <= F.col("_most")), far)
            at = at.where((F.col("_hi") >= F.col("_least")) & (F.col("_lo") <= F.col("_most"))).withColumns({"_near": near, "_far": sure, "_level": F.lit(level)})
            if within is not None:
                at = at.where(F.col("_near") <= within)
            rows = at.select(*own, "_bx", "_by", "_i", "_j", "_level", "_dense", "_near", "_far")
            rows = rows if found is None else rows.unionByName(found)
            every = rows.groupBy(*own).agg(F.collect_list(F.struct("_bx", "_by", "_i", "_j", "_level", "_dense", "_near", "_far")).alias("_l"), F.min("_far").alias("_f"))
            close = every.select(*own, F.explode(F.filter("_l", lambda c: F.coalesce(c["_near"] <= F.col("_f"), F.lit(True)))).alias("c")).select(*own, "c.*")
            close = checkpoint(close)
            found = close.where("not _dense")
            if level + 1 < len(self.nodes):
                down = close.where("_dense").select(*own, "_bx", "_by", (F.col("_i") * 2).alias("_pi"), (F.col("_j") * 2).alias("_pj"))
                children = self.nodes[level + 1].withColumns({"_pi": F.col("_i") - F.col("_i") % 2, "_pj": F.col("_j") - F.col("_j") % 2})
                at = down.join(small(children), ["_bx", "_by", "_pi", "_pj"]).drop("_pi", "_pj")
        leaf = ["_bx", "_by", "_i", "_j", "_level"]
        copies = checkpoint(found.groupBy(*leaf).agg(F.ceil(F.count("*") / PROBES).cast("int").alias("_copies")))
        spread = found.join(small(copies), leaf).withColumn("_copy", F.pmod(F.xxhash64("_k"), F.col("_copies")).cast("int")).drop("_copies")
        # only the deepest cells may have more than MOST
        part = F.when(F.col("_level") >= DEPTH, F.pmod(F.xxhash64("_lon", "_lat", "_band"), F.lit(MOST))).otherwise(0)
        there = self.points.join(small(copies), leaf).groupBy(*leaf, "_copies", part.alias("_part")).agg(self._points())
        there = there.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
        return self._best(spread.join(there.select(*leaf, "_copy", "_points"), [*leaf, "_copy"]), key, within)

    @staticmethod
    def _points() -> Column:
        return F.collect_list(F.struct("_lon", "_lat", "_band", "_tie", "_v")).alias("_points")

    def _best(self, met: DataFrame, key: str, within: float | None) -> DataFrame:
        """met: a row per probe and leaf, with the leaf's _points. Each row is brought down to its nearest point where it is made, so no pair of points is sorted or shuffled."""
        fits = F.filter("_points", lambda p: p["_band"].between(F.col("_least"), F.col("_most")))
        far = F.transform(fits, lambda p: F.struct(self.metric.distance(F.col("_x"), F.col("_y"), p["_lon"], p["_lat"]).alias("distance"), p["_tie"].alias("_tie"), p["_v"].alias("_v")))
        one = met.select("_k", F.array_min(far).alias("_b")).where("_b is not null")
        if within is not None:
            one = one.where(F.col("_b.distance") <= within)
        return one.groupBy("_k").agg(F.min("_b").alias("_b")).select(F.col("_k").alias(key), "_b._v.*", "_b.distance")
