"""Geographic column expressions. Rings are array<struct<x,y>>, lines array<array<struct<x,y>>>; x is longitude."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6378137.0
MEAN_RADIUS_KM = 6371.0088
HALF_WORLD_M = 20037508.342789244
HALF_WORLD_SHORT_M = 20037508.34
SQ_M_TO_ACRES = 0.000247105
MILES_PER_DEGREE = 69

# Boxes of the United States as (lat_min, lat_max, lon_min, lon_max).
US_BOXES = {
    "conus": (24.0, 49.6, -125.0, -66.5),
    "alaska": (49.0, 72.0, -170.0, -130.0),
    "hawaii": (18.9, 22.4, -161.0, -154.0),
    "puerto_rico": (17.6, 18.6, -67.5, -65.0),
}
LOOSE_US_BOX = (15.0, 75.0, -170.0, -60.0)
LOOKUP_BOX = (24.0, 50.0, -125.0, -66.0)


def point(x, y) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


# projections


def mercator_to_lonlat(x, y, half_world: float = HALF_WORLD_M, clamp: bool = True) -> tuple[Column, Column]:
    """Web Mercator metres -> (lon, lat) degrees."""
    lon = _c(x) / F.lit(half_world) * 180.0
    lat = F.degrees(2 * F.atan(F.exp(_c(y) / F.lit(half_world) * math.pi)) - math.pi / 2)
    if clamp:
        lon, lat = F.greatest(F.lit(-180.0), F.least(F.lit(180.0), lon)), F.greatest(F.lit(-90.0), F.least(F.lit(90.0), lat))
    return lon, lat


def lonlat_to_mercator(lon, lat) -> tuple[Column, Column]:
    """(lon, lat) degrees -> Web Mercator metres."""
    return _c(lon) / 180.0 * HALF_WORLD_M, F.log(F.tan(math.pi / 4 + F.radians(_c(lat)) / 2)) * EARTH_RADIUS_M


def crude_lonlat(easting, northing) -> tuple[Column, Column]:
    """Metres over 111,320 per degree: an approximation that ignores the projection."""
    return _c(easting) / 111320.0, _c(northing) / 111320.0


def albers_to_lonlat(x, y, lat1=29.5, lat2=45.5, lat0=23.0, lon0=-96.0) -> tuple[Column, Column]:
    """Inverse Albers equal-area conic on the GRS80 ellipsoid (EPSG:5070 by default)."""
    a, f = 6378137.0, 1 / 298.257222101
    e2 = f * (2 - f)
    e = math.sqrt(e2)
    q_of = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
    s0, s1, s2 = (math.sin(math.radians(v)) for v in (lat0, lat1, lat2))
    m = lambda s: math.sqrt(1 - s * s) / math.sqrt(1 - e2 * s * s)
    n = (m(s1) ** 2 - m(s2) ** 2) / (q_of(s2) - q_of(s1))
    c = m(s1) ** 2 + n * q_of(s1)
    rho0 = a * math.sqrt(c - n * q_of(s0)) / n
    dx, dy = _c(x), F.lit(rho0) - _c(y)
    q = (F.lit(c) - (dx * dx + dy * dy) * (n * n / (a * a))) / n
    beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / q_of(1.0))))
    lat = beta + (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040) * F.sin(2 * beta)
    lat = lat + (23 * e2**2 / 360 + 251 * e2**3 / 3780) * F.sin(4 * beta) + (761 * e2**3 / 45360) * F.sin(6 * beta)
    return F.lit(lon0) + F.degrees(F.atan2(dx, dy)) / n, F.degrees(lat)


def looks_mercator(ring) -> Column:
    """Whether any coordinate is beyond 1,000, so not in degrees."""
    return F.exists(_c(ring), lambda p: (F.abs(p["x"]) > 1000) | (F.abs(p["y"]) > 1000))


def ring_to_lonlat(ring) -> Column:
    """A ring in degrees, whether it came in degrees or in Web Mercator metres."""

    def move(p):
        lon, lat = mercator_to_lonlat(p["x"], p["y"])
        return F.struct(lon.alias("x"), lat.alias("y"))

    return F.when(looks_mercator(ring), F.transform(_c(ring), move)).otherwise(_c(ring))


# well-known text and validity


def parse_wkt_point(wkt) -> tuple[Column, Column, Column]:
    """srid (null if absent), x and y of 'POINT(x y)' with an optional 'SRID=n;'."""
    number = r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)"
    shape = rf"(?i)POINT\s*\(\s*{number}\s+{number}\s*\)"
    get = lambda i: F.regexp_extract(_c(wkt), shape, i).try_cast("double")
    srid = F.regexp_extract(_c(wkt), r"(?i)SRID=([0-9]+);", 1).try_cast("int")
    return srid, get(1), get(2)


def wkt_to_lonlat(wkt) -> tuple[Column, Column]:
    """(lon, lat) of a point as well-known text, in degrees or, by its SRID, in Web Mercator metres."""
    srid, x, y = parse_wkt_point(wkt)
    lon, lat = mercator_to_lonlat(x, y)
    metres = F.coalesce(srid.isin(3857, 900913), F.lit(False))
    return F.when(metres, lon).otherwise(x), F.when(metres, lat).otherwise(y)


def valid_lonlat(lon, lat) -> Column:
    return _c(lat).between(-90, 90) & _c(lon).between(-180, 180)


def in_box(lat, lon, box) -> Column:
    """Inclusive (lat_min, lat_max, lon_min, lon_max)."""
    return _c(lat).between(box[0], box[1]) & _c(lon).between(box[2], box[3])


def in_us(lat, lon) -> Column:
    """Whether a point lies in one of the four boxes."""
    out = F.lit(False)
    for box in US_BOXES.values():
        out = out | in_box(lat, lon, box)
    return out


def valid_polygon(ring) -> Column:
    """At least four points, each with both coordinates."""
    return (F.size(_c(ring)) >= 4) & F.forall(_c(ring), lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def as_multiline(line) -> Column:
    return F.array(_c(line))


def drop_repeats(ring) -> Column:
    """A ring without consecutive equal points."""
    r = _c(ring)
    return F.filter(r, lambda p, i: (i == 0) | (p != F.get(r, i - 1)))


# predicates


def segment_meets_box(a, b, box) -> Column:
    """Whether the segment between points a and b meets a box: Liang-Barsky clipping."""
    lat0, lat1, lon0, lon1 = box
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    low, high, apart = F.lit(0.0), F.lit(1.0), F.lit(False)
    for p, q in ((-dx, a["x"] - lon0), (dx, lon1 - a["x"]), (-dy, a["y"] - lat0), (dy, lat1 - a["y"])):
        r = F.when(p != 0, q / p)
        low = F.when(p < 0, F.greatest(low, r)).otherwise(low)
        high = F.when(p > 0, F.least(high, r)).otherwise(high)
        apart = apart | ((p == 0) & (q < 0))
    return ~apart & (low <= high)


def line_meets_box(line, box) -> Column:
    """Whether any segment of array<struct<x,y>> meets a box."""
    pts = _c(line)
    pairs = F.transform(F.slice(pts, 2, F.greatest(F.size(pts) - 1, F.lit(0))), lambda b, i: F.struct(F.get(pts, i).alias("a"), b.alias("b")))
    return F.exists(pairs, lambda s: segment_meets_box(s["a"], s["b"], box))


def line_in_us(line) -> Column:
    out = F.lit(False)
    for box in US_BOXES.values():
        out = out | line_meets_box(line, box)
    return out


def point_in_ring(x, y, ring) -> Column:
    """Ray casting: whether a point is inside a ring, by the parity of the edges crossed."""
    px, py, r = _c(x), _c(y), _c(ring)
    shifted = F.concat(F.slice(r, -1, 1), F.slice(r, 1, F.size(r) - 1))

    def crosses(p, q):
        span = (p["y"] > py) != (q["y"] > py)
        at = (q["x"] - p["x"]) * (py - p["y"]) / F.when(q["y"] != p["y"], q["y"] - p["y"]) + p["x"]
        return F.when(span & (px < at), 1).otherwise(0)

    return F.aggregate(F.zip_with(r, shifted, crosses), F.lit(0), lambda s, v: s + v) % 2 == 1


# measures


def haversine_km(lon1, lat1, lon2, lat2, radius_km: float = MEAN_RADIUS_KM) -> Column:
    """Great-circle distance; within 0.5 % of the spheroid's."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(_c(lon2) - _c(lon1)) / 2), 2)
    return 2 * radius_km * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def degree_distance(x1, y1, x2, y2) -> Column:
    return F.sqrt(F.pow(_c(x1) - _c(x2), 2) + F.pow(_c(y1) - _c(y2), 2))


def round_half_up(x) -> Column:
    """Rounding of halves towards positive infinity."""
    return F.floor(_c(x) + 0.5)


def degrees_to_miles(d) -> Column:
    return round_half_up(_c(d) * MILES_PER_DEGREE)


def ring_area_m2(ring) -> Column:
    """Area of a ring on a sphere of radius 6,378,137 m."""
    r = _c(ring)
    n = F.size(r) - 1  # the last point repeats the first
    rad = lambda p, k: F.radians(p[k])
    terms = F.transform(
        F.slice(r, 1, F.greatest(n, F.lit(0))),
        lambda p, i: (rad(F.get(r, (i + 2) % n), "x") - rad(p, "x")) * F.sin(rad(F.get(r, (i + 1) % n), "y")),
    )
    total = F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)
    return F.when(n > 2, F.abs(total * EARTH_RADIUS_M * EARTH_RADIUS_M / 2)).otherwise(0.0)


def polygon_acres(rings) -> Column:
    """Acres of a polygon: its first ring less the holes."""
    rings = _c(rings)
    # each ring's area is in the expression once: functions of arrays are evaluated wherever they stand
    holes = F.aggregate(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), F.lit(0.0), lambda s, ring: s + ring_area_m2(ring))
    return (ring_area_m2(F.get(rings, 0)) - holes) * SQ_M_TO_ACRES


def vertex_mean(ring, closing: bool) -> Column:
    """Mean of the vertices, with or without the closing one."""
    r = _c(ring) if closing else F.slice(_c(ring), 1, F.greatest(F.size(_c(ring)) - 1, F.lit(0)))
    add = F.aggregate(r, point(0.0, 0.0), lambda s, p: F.struct((s["x"] + p["x"]).alias("x"), (s["y"] + p["y"]).alias("y")))
    return F.struct((add["x"] / F.size(r)).alias("x"), (add["y"] / F.size(r)).alias("y"))


def ring_centroid(ring) -> Column:
    """Area-weighted centroid of a closed ring in the plane; the vertex mean if it has no area."""
    r = _c(ring)
    edges = F.transform(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), lambda q, i: F.struct(F.get(r, i).alias("p"), q.alias("q")))
    cross = lambda e: e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]
    area = F.aggregate(edges, F.lit(0.0), lambda s, e: s + cross(e))
    along = lambda k: F.aggregate(edges, F.lit(0.0), lambda s, e: s + (e["p"][k] + e["q"][k]) * cross(e)) / (3 * area)
    return F.when(area != 0, F.struct(along("x").alias("x"), along("y").alias("y"))).otherwise(vertex_mean(r, False))


def corner_centre(ring) -> Column:
    """Centre of a cell from its first and third vertices."""
    a, b = F.get(_c(ring), 0), F.get(_c(ring), 2)
    return F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"))


# grids and tiles


def snap(x, step: float) -> Column:
    """The nearest multiple of step, halves to even."""
    return F.rint(_c(x) / step) * step


def cell(x, step: float) -> Column:
    return F.floor(_c(x) / step).cast("long")


def hexagon_area(radius) -> Column:
    return 1.5 * math.sqrt(3) * _c(radius) * _c(radius)


def hex_key(lon, lat, cell_miles: float = 5.0, lat_ref: float = 37.0) -> tuple[Column, Column]:
    """Axial (q, r) of the pointy hexagon that holds a point, by cube rounding.

    The plane is equirectangular in miles around lat_ref; cell_miles is the radius of a cell. The key is arithmetic, so
    points and cells meet by an equi-join.
    """
    x = _c(lon) * (MILES_PER_DEGREE * math.cos(math.radians(lat_ref)))
    y = _c(lat) * MILES_PER_DEGREE
    q = (math.sqrt(3) / 3 * x - y / 3) / cell_miles
    r = (2.0 / 3 * y) / cell_miles
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    fix_q = (dq > dr) & (dq > ds)
    return F.when(fix_q, -rr - rs).otherwise(rq).cast("long"), F.when(~fix_q & (dr > ds), -rq - rs).otherwise(rr).cast("long")


def hex_centre(q, r, cell_miles: float = 5.0, lat_ref: float = 37.0) -> tuple[Column, Column]:
    """(lon, lat) of the centre of a cell."""
    x = cell_miles * (math.sqrt(3) * _c(q) + math.sqrt(3) / 2 * _c(r))
    return x / (MILES_PER_DEGREE * math.cos(math.radians(lat_ref))), _c(r) * (1.5 * cell_miles) / MILES_PER_DEGREE


def hex_ring(q, r, cell_miles: float = 5.0, lat_ref: float = 37.0) -> Column:
    """The closed ring of a cell."""
    lon, lat = hex_centre(q, r, cell_miles, lat_ref)
    kx, ky = MILES_PER_DEGREE * math.cos(math.radians(lat_ref)), MILES_PER_DEGREE
    turn = lambda k: math.radians(60 * (k % 6) + 30)
    return F.array(*[point(lon + cell_miles * math.cos(turn(k)) / kx, lat + cell_miles * math.sin(turn(k)) / ky) for k in range(7)])


def tile_of(lon, lat, zoom) -> tuple[Column, Column]:
    """XYZ tile that holds a point."""
    n = F.pow(F.lit(2.0), _c(zoom))
    y = (1 - F.log(F.tan(F.radians(_c(lat))) + 1 / F.cos(F.radians(_c(lat)))) / math.pi) / 2
    return F.floor((_c(lon) + 180) / 360 * n).cast("long"), F.floor(y * n).cast("long")


def tiles_of_box(lon0, lat0, lon1, lat1, zoom) -> Column:
    """Array of (x, y) of all tiles that a box touches."""
    x0, y1 = tile_of(lon0, lat0, zoom)
    x1, y0 = tile_of(lon1, lat1, zoom)
    return F.flatten(F.transform(F.sequence(x0, x1), lambda x: F.transform(F.sequence(y0, y1), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def tile_bounds(x, y, zoom) -> tuple[Column, Column, Column, Column]:
    """(west, south, east, north) of a tile."""
    n = F.pow(F.lit(2.0), _c(zoom))
    lon = lambda v: v / n * 360 - 180
    lat = lambda v: F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * v / n))))
    return lon(_c(x)), lat(_c(y) + 1), lon(_c(x) + 1), lat(_c(y))


def tile_pixel_to_lonlat(px, py, x, y, zoom, extent: int = 4096) -> tuple[Column, Column]:
    """(lon, lat) of a pixel of a tile."""
    n = F.pow(F.lit(2.0), _c(zoom))
    return (_c(x) + _c(px) / extent) / n * 360 - 180, F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * (_c(y) + _c(py) / extent) / n))))


def world_pixel(lon, lat, zoom, tile: int = 512) -> tuple[Column, Column]:
    """Pixel of the whole map at a zoom."""
    n = F.pow(F.lit(2.0), _c(zoom)) * tile
    y = (1 - F.log(F.tan(F.radians(_c(lat))) + 1 / F.cos(F.radians(_c(lat)))) / math.pi) / 2
    return (_c(lon) + 180) / 360 * n, y * n


# GeoJSON

POINTS = "array<struct<x:double,y:double>>"


def geojson_point(x, y) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(_c(x), _c(y)).alias("coordinates")))


def geojson_ring(geojson) -> Column:
    """First ring of a GeoJSON polygon as points; null for other types."""
    g = F.from_json(_c(geojson), "type string, coordinates array<array<array<double>>>")
    return F.when(g["type"] == "Polygon", F.transform(F.get(g["coordinates"], 0), lambda p: point(F.get(p, 0), F.get(p, 1))))
