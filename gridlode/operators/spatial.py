"""Spatial joins as equi-joins on cells, then exact refinement. No side is broadcast unless it is a fixed small list or counted to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .cell_tree import CellTree, Plane, Sphere
from .shared import small, stored

# The sections of the country as (west, south, east, north).
SECTIONS = {
    "West Coast": (-125, 32, -114, 49),
    "Mountain West": (-114, 31, -104, 49),
    "Texas/Southwest": (-107, 25, -94, 37),
    "Great Plains": (-104, 37, -96, 49),
    "Midwest": (-96, 37, -84, 49),
    "Southeast": (-94, 25, -75, 37),
    "Northeast": (-84, 37, -67, 47),
}


def with_hex(points: DataFrame, lon: str = "longitude", lat: str = "latitude", miles: float = 5.0) -> DataFrame:
    q, r = geo.hex_key(lon, lat, miles)
    return points.withColumn("hex_q", q).withColumn("hex_r", r)


def hex_mesh(points: DataFrame, miles: float = 5.0) -> DataFrame:
    """Average, least and largest temperature and the number of points of each hexagon that has any."""
    out = with_hex(points, miles=miles).groupBy("hex_q", "hex_r").agg(
        F.round(F.avg("temperature_f"), 1).alias("avg_temperature_f"),
        F.round(F.min("temperature_f"), 1).alias("min_temperature_f"),
        F.round(F.max("temperature_f"), 1).alias("max_temperature_f"),
        F.count("*").alias("point_count"),
    )
    return out.withColumn("hex_id", F.concat_ws("_", F.lit("hex"), "hex_q", "hex_r"))


def in_sections(cells: DataFrame, half_lon: float, half_lat: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """cells joined with each section that their box around (lon, lat) overlaps: seven fixed rows are broadcast."""
    spark = cells.sparkSession
    rows = spark.createDataFrame([(n, *map(float, b)) for n, b in SECTIONS.items()], "section string, west double, south double, east double, north double")
    meets = (F.col(lon) - half_lon < F.col("east")) & (F.col(lon) + half_lon > F.col("west")) & (F.col(lat) - half_lat < F.col("north")) & (F.col(lat) + half_lat > F.col("south"))
    return cells.join(F.broadcast(rows), meets).drop("west", "south", "east", "north")


def nearest_in_cells(left: DataFrame, right: DataFrame, key: str, lon: str, lat: str, to_lon: str, to_lat: str, values: list[str], step: float = 0.5, tie: str | None = None) -> DataFrame:
    """left with the values of the nearest row of right in the 3 x 3 cells around it, by distance in degrees; null if none. Keys are unique."""
    tree = CellTree(right, to_lon, to_lat, values, step, Plane(), tie=tie)
    x, y = geo.cell(lon, step), geo.cell(lat, step)
    around = F.array(*[F.struct((x + i).alias("i"), (y + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return left.join(tree.nearest(left, key, lon, lat, around), key, "left").select(left["*"], *values, "distance")


def semi_on_cells(points: DataFrame, boxes: DataFrame, step: float = 1.0) -> DataFrame:
    """points (longitude, latitude) in the cells that any box (west, south, east, north) touches."""
    xs = F.sequence(geo.cell("west", step), geo.cell("east", step))
    ys = F.sequence(geo.cell("south", step), geo.cell("north", step))
    cells = boxes.select(F.explode(xs).alias("_x"), ys.alias("_ys")).select("_x", F.explode("_ys").alias("_y")).distinct()
    keyed = points.withColumn("_x", geo.cell("longitude", step)).withColumn("_y", geo.cell("latitude", step))
    return keyed.join(cells, ["_x", "_y"], "left_semi").drop("_x", "_y")


def within_radius(probes: DataFrame, points: DataFrame, key: str, km: float = 50.0, depth: float = 100.0, tie: str = "gid") -> DataFrame:
    """For each probe (key, lat, lng, depth) the nearest reading within km and +-depth metres, by great-circle distance.

    Cells are `km` high; a probe goes to the cells that its circle can touch, more of them towards the poles, and around
    the date line.
    """
    step = km / 111.0
    values = ["temperature_f", "depth_m", "latitude", "longitude"]
    # readings that are in no probe's range are left out before anything is made of them
    least, most = probes.agg(F.min(F.col("depth") - depth).cast("double"), F.max(F.col("depth") + depth).cast("double")).head()
    points = points.where(F.col("depth_m").between(F.lit(least).cast("double"), F.lit(most).cast("double")))
    tree = CellTree(points, "longitude", "latitude", values, step, Sphere(), band="depth_m", tie=tie)
    most = tree.columns
    reach = F.ceil(1 / F.cos(F.radians(F.least(F.abs(F.col("lat")) + step, F.lit(89.9))))).cast("long") + 1
    x, y = tree.base(F.col("lng"), F.col("lat"))
    # near the poles all columns
    columns = F.when(2 * reach + 1 < most, F.sequence(x - reach, x + reach)).otherwise(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long")))
    around = F.flatten(F.transform(columns, lambda i: F.transform(F.sequence(y - 1, y + 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    asked = probes.select(key, "lat", "lng", (F.col("depth") - depth).alias("_from"), (F.col("depth") + depth).alias("_to"))
    best = tree.nearest(asked, key, "lng", "lat", around, within=km, band=("_from", "_to"))
    return probes.join(best, key, "left").select(key, *values, F.col("distance").alias("distance_km"))


#: Sizes of the cells of a pyramid in degrees, each a quarter of the one above.
STEPS = (64.0, 16.0, 4.0, 1.0, 0.25)


class Pyramid:
    """Points (lon, lat, values) by occupied cells of growing size, to find nearest points without meeting far ones.

    A level has a row per occupied cell: its cell, the cell above it, and the box around its points. Levels are as large as the
    area that the points cover, not as their number: 64,800 cells of one degree at most for valid coordinates. The points and all levels are written
    once to the shared folder.
    """

    def __init__(self, points: DataFrame, lon: str, lat: str, values: list[str]):
        self.values = values
        keys = lambda x, y, step: (geo.cell(x, step).alias("_x"), geo.cell(y, step).alias("_y"))
        points = points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull())
        self.points = stored(points.select(*keys(lon, lat, STEPS[-1]), F.col(lon).alias("_lon"), F.col(lat).alias("_lat"), *values))
        box = [F.min("_lon").alias("_w"), F.min("_lat").alias("_s"), F.max("_lon").alias("_e"), F.max("_lat").alias("_n")]
        level, levels = stored(self.points.groupBy("_x", "_y").agg(*box)), []
        merged = [F.min("_w").alias("_w"), F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.max("_n").alias("_n")]
        for i in range(len(STEPS)):
            up = [F.lit(0).cast("long") if i == len(STEPS) - 1 else F.shiftright(c, 2) for c in ("_x", "_y")]
            levels.append(level.select(up[0].alias("_px"), up[1].alias("_py"), "_x", "_y", "_w", "_s", "_e", "_n"))
            if i < len(STEPS) - 1:
                level = stored(level.groupBy(up[0].alias("_x"), up[1].alias("_y")).agg(*merged))
        self.levels = [small(x) for x in reversed(levels)]

    def nearest(self, sites: DataFrame, key: str, tie: list[str]) -> DataFrame:
        """key, values and distance in degrees of the point nearest to each site (key, lon, lat); ties by the columns `tie`.

        A site goes down the levels and keeps the cells that can hold its nearest point: those whose box is not further away
        than the far end of the closest one. All steps keep the partitioning by site.
        """
        at = sites.where("lon is not null and lat is not null").repartition(key).select(key, "lon", "lat", F.lit(0).cast("long").alias("_px"), F.lit(0).cast("long").alias("_py"))
        gap = lambda p, lo, hi: F.greatest(F.col(lo) - F.col(p), F.col(p) - F.col(hi), F.lit(0.0))
        span = lambda p, lo, hi: F.greatest(F.abs(F.col(p) - F.col(lo)), F.abs(F.col(p) - F.col(hi)))
        length = lambda a, b: F.sqrt(a * a + b * b)
        for level in self.levels:
            met = at.join(level, ["_px", "_py"])
            far = length(span("lon", "_w", "_e"), span("lat", "_s", "_n")) * (1 + 1e-9) + 1e-9
            cells = F.collect_list(F.struct(length(gap("lon", "_w", "_e"), gap("lat", "_s", "_n")).alias("_near"), far.alias("_far"), "_x", "_y"))
            met = met.groupBy(key, "lon", "lat").agg(cells.alias("_cells"))
            close = F.filter("_cells", lambda c: c["_near"] <= F.array_min(F.transform("_cells", lambda d: d["_far"])))
            at = met.select(key, "lon", "lat", F.explode(close).alias("_cells")).select(key, "lon", "lat", F.col("_cells._x").alias("_px"), F.col("_cells._y").alias("_py"))
        met = at.join(self.points, (F.col("_px") == F.col("_x")) & (F.col("_py") == F.col("_y")))
        met = met.withColumn("distance", geo.degree_distance("lon", "lat", "_lon", "_lat"))
        best = F.min_by(F.struct(*self.values, "distance"), F.struct("distance", *tie))
        return met.groupBy(key).agg(best.alias("_b")).select(key, "_b.*")


def mesh_pyramid(mesh: DataFrame, miles: float = 5.0) -> Pyramid:
    """The centres of the hexagons that have a temperature."""
    data = mesh.where(F.col("avg_temperature_f").isNotNull())
    lon, lat = geo.hex_centre("hex_q", "hex_r", miles)
    return Pyramid(data.withColumn("_clon", lon).withColumn("_clat", lat), "_clon", "_clat", ["hex_q", "hex_r", "avg_temperature_f", "point_count"])


def temperature_at(sites: DataFrame, mesh: DataFrame | Pyramid, key: str, miles: float = 5.0) -> DataFrame:
    """Mesh values at sites (key, lon, lat; keys are unique): of the hexagon that holds the site, else of the nearest centre with data."""
    pyramid = mesh if isinstance(mesh, Pyramid) else mesh_pyramid(mesh, miles)
    data = pyramid.points.select("hex_q", "hex_r", "avg_temperature_f", "point_count")
    sites = sites.select(key, "lon", "lat")
    held = stored(with_hex(sites, "lon", "lat", miles).join(data, ["hex_q", "hex_r"], "left").select(key, "lon", "lat", "avg_temperature_f", "point_count"))
    inside = held.where(F.col("avg_temperature_f").isNotNull()).withColumn("miles", F.lit(0))
    rest = held.where(F.col("avg_temperature_f").isNull()).select(key, "lon", "lat")
    near = pyramid.nearest(rest, key, ["hex_q", "hex_r"])
    near = near.select(key, "avg_temperature_f", "point_count", geo.degrees_to_miles(F.col("distance")).cast("int").alias("miles"))
    return inside.unionByName(rest.join(near, key, "left"))


def drop_ocean(cells: DataFrame) -> DataFrame:
    """Cells with data, and empty ones that aren't plainly in the sea."""
    lon, lat = F.col("lon"), F.col("lat")
    sea = ((lon > -66.0) & (lat > 25.0) & (lat < 45.0)) | ((lon < -125.0) & (lat > 32.0) & (lat < 48.0)) | ((lon > -95.0) & (lon < -80.0) & (lat < 25.0))
    return cells.where(F.col("avg_temperature_f").isNotNull() | ~sea)


def clusters(points: DataFrame, zoom: int, radius: int = 50, most: int = 14) -> DataFrame:
    """Count and acres of points in cells of `radius` pixels of the map; above zoom `most` each point is its own.

    A grid in place of a greedy cluster: the same at any order of the rows.
    """
    if zoom > most:
        return points.select(F.col("longitude").alias("lon"), F.col("latitude").alias("lat"), F.lit(1).cast("long").alias("point_count"), F.coalesce("acres", F.lit(0.0)).alias("acres"))
    x, y = geo.world_pixel("longitude", "latitude", F.lit(zoom))
    keyed = points.select(F.floor(x / radius).alias("cx"), F.floor(y / radius).alias("cy"), "longitude", "latitude", F.coalesce("acres", F.lit(0.0)).alias("acres"))
    return keyed.groupBy("cx", "cy").agg(F.count("*").alias("point_count"), F.sum("acres").alias("acres"), F.avg("longitude").alias("lon"), F.avg("latitude").alias("lat"))


def ranked(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """rows, few by now, with their number by `order`."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)))
