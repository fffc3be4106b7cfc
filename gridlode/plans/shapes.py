"""Queries on rings, lines and projections, each over shapes whose answer has a closed form."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geo, simplify
from ..operators import stats, tiles
from .catalog import query


def _square(v, side):
    """Rings of a side in degrees with a corner at each point."""
    x, y = F.col("longitude"), F.col("latitude")
    corners = ((0, 0), (side, 0), (side, side), (0, side), (0, 0))
    return v.geo_points.withColumn("ring", F.array(*[geo.point(x + a, y + b) for a, b in corners]))


@query("select gid, round(longitude, 6) as lon, round(latitude, 6) as lat from geo_points")
def albers_to_wgs84(v):  # G6: the forward projection, written out, then the inverse
    e2 = (1 / 298.257222101) * (2 - 1 / 298.257222101)
    e = math.sqrt(e2)
    q = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
    m2 = lambda s: (1 - s * s) / (1 - e2 * s * s)
    s0, s1, s2 = (math.sin(math.radians(d)) for d in (23.0, 29.5, 45.5))
    n = (m2(s1) - m2(s2)) / (q(s2) - q(s1))
    c = m2(s1) + n * q(s1)
    forward = v.geo_points.selectExpr("gid", "sin(radians(latitude)) as s", f"{n!r} * radians(longitude + 96.0) as t")
    forward = forward.selectExpr("gid", "t", f"6378137.0 / {n!r} * sqrt({c!r} - {n!r} * {1 - e2!r} * (s / (1 - {e2!r} * s * s) - ln((1 - {e!r} * s) / (1 + {e!r} * s)) / {2 * e!r})) as rho")
    metres = forward.selectExpr("gid", "rho * sin(t) as x", f"{6378137.0 / n * math.sqrt(c - n * q(s0))!r} - rho * cos(t) as y")
    lon, lat = geo.albers_to_lonlat("x", "y")
    return metres.select("gid", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("select gid, gid % 2 = 0 as metres, round(longitude + 0.5, 6) as lon, round(latitude, 6) as lat from geo_points")
def rings_to_degrees(v):  # G7: rings in degrees stay, those in metres are moved
    x, y = geo.lonlat_to_mercator("longitude", "latitude")
    x2, _ = geo.lonlat_to_mercator(F.col("longitude") + 0.5, "latitude")
    lon, lat = F.col("longitude"), F.col("latitude")
    ring = F.when(F.col("gid") % 2 == 0, F.array(geo.point(x, y), geo.point(x2, y), geo.point(x, y))).otherwise(F.array(geo.point(lon, lat), geo.point(lon + 0.5, lat), geo.point(lon, lat)))
    out = v.geo_points.select("gid", ring.alias("ring")).select("gid", geo.looks_mercator("ring").alias("metres"), F.get(geo.ring_to_lonlat("ring"), 1).alias("p"))
    return out.select("gid", "metres", F.round("p.x", 6).alias("lon"), F.round("p.y", 6).alias("lat"))


@query("select gid, round(longitude, 6) as lon, round(latitude, 6) as lat from geo_points")
def wkt_to_degrees(v):  # G5: by SRID
    x, y = geo.lonlat_to_mercator("longitude", "latitude")
    text = lambda srid, a, b: F.concat(F.lit(f"SRID={srid};POINT("), a.cast("string"), F.lit(" "), b.cast("string"), F.lit(")"))
    wkt = F.when(F.col("gid") % 2 == 0, text(3857, x, y)).otherwise(text(4326, F.col("longitude"), F.col("latitude")))
    lon, lat = geo.wkt_to_lonlat("wkt")
    return v.geo_points.select("gid", wkt.alias("wkt")).select("gid", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("""select gid, case when 0.5 * kv / 10000.0 >= 0.01 then 3 else 2 end as by_area, case when kv / 10000.0 > 0.02 then 3 else 2 end as by_distance from geo_lines where kv is not null""")
def simplified_lines(v):  # G13, G14: a line with one point off the chord of length 1 keeps it if it is far enough off
    x, y = F.col("x0"), F.lit(0.0)
    line = F.array(geo.point(x * 0, y), geo.point(x * 0 + 0.5, F.col("kv") / 10000.0), geo.point(x * 0 + 1.0, y))
    rows = v.geo_lines.where("kv is not null").select("gid", line.alias("line"))
    return rows.select("gid", F.size(simplify.simplify_area("line", 0.01)).alias("by_area"), F.size(simplify.simplify_distance("line", 0.02)).alias("by_distance"))


@query("""select gid, round(6378137.0 * 6378137.0 * (radians(0.5) * (sin(radians(latitude + 0.5)) - sin(radians(latitude))) - radians(0.1) * (sin(radians(latitude + 0.3)) - sin(radians(latitude + 0.2)))) * 0.000247105, 3) as acres from geo_points""")
def parcel_areas(v):  # G15: squares with a square hole
    x, y = F.col("longitude"), F.col("latitude")
    hole = F.array(*[geo.point(x + a, y + b) for a, b in ((0.2, 0.2), (0.3, 0.2), (0.3, 0.3), (0.2, 0.3), (0.2, 0.2))])
    return _square(v, 0.5).select("gid", F.round(geo.polygon_acres(F.array("ring", hole)), 3).alias("acres"))


@query("""select gid, round(longitude + 0.5, 6) as x, round(latitude + 0.4, 6) as y, round(longitude + 0.75, 6) as mid_x, round(latitude + 0.6, 6) as mid_y from geo_points""")
def ring_centres(v):  # G20, G32: triangles
    x, y = F.col("longitude"), F.col("latitude")
    ring = F.array(geo.point(x, y), geo.point(x, y + 0.0), geo.point(x + 1.5, y + 1.2), geo.point(x, y))
    triangle = F.array(geo.point(x, y), geo.point(x + 1.5, y), geo.point(x, y + 1.2), geo.point(x, y))
    out = v.geo_points.select("gid", geo.ring_centroid(triangle).alias("c"), geo.corner_centre(ring).alias("m"))
    return out.select("gid", *[F.round(c, 6).alias(n) for c, n in (("c.x", "x"), ("c.y", "y"), ("m.x", "mid_x"), ("m.y", "mid_y"))])


@query("select min(longitude) as west, min(latitude) as south, max(longitude + 0.5) as east, max(latitude + 0.5) as north from geo_points")
def ring_extent(v):  # A29
    return stats.ring_bounds(_square(v, 0.5), "ring")


@query("""select gid, (gid % 10 + 0.5) / 10.0 + (gid % 7 + 0.5) / 7.0 < 1 as inside from geo_points""")
def points_in_rings(v):  # G11: right triangles and points of their boxes
    x, y = F.col("longitude"), F.col("latitude")
    triangle = F.array(geo.point(x, y), geo.point(x + 1.5, y), geo.point(x, y + 1.2), geo.point(x, y))
    px, py = x + (F.col("gid") % 10 + 0.5) / 10.0 * 1.5, y + (F.col("gid") % 7 + 0.5) / 7.0 * 1.2
    return v.geo_points.select("gid", geo.point_in_ring(px, py, triangle).alias("inside"))


@query("""select gid, round(longitude + 0.25, 6) as open_x, round(latitude + 0.25, 6) as open_y, round(longitude + 0.2, 6) as closed_x, round(latitude + 0.2, 6) as closed_y, 5::int as points from geo_points""")
def vertex_means(v):  # G18, G19, and the repeated points that G14 drops
    s = _square(v, 0.5)
    open_, closed = geo.vertex_mean("ring", False), geo.vertex_mean("ring", True)
    doubled = F.flatten(F.transform("ring", lambda p: F.array(p, p)))
    out = s.select("gid", open_.alias("o"), closed.alias("c"), F.size(geo.drop_repeats(doubled)).alias("points"))
    return out.select("gid", *[F.round(c, 6).alias(n) for c, n in (("o.x", "open_x"), ("o.y", "open_y"), ("c.x", "closed_x"), ("c.y", "closed_y"))], "points")


WORLD = "(({0}) + 180.0) / 360.0 * 32 as {1}x, (1 - ln(tan(radians(least(greatest({2}, -85.0511287798066), 85.0511287798066))) + 1 / cos(radians(least(greatest({2}, -85.0511287798066), 85.0511287798066)))) / pi()) / 2 * 32 as {1}y"
SIDES = [("-dx", "(a_x - tx)"), ("dx", "(tx + 1 - a_x)"), ("-dy", "(a_y - ty)"), ("dy", "(ty + 1 - a_y)")]
ENTER = ", ".join(f"case when {d} < 0 then {gap} / ({d}) end" for d, gap in SIDES)
LEAVE = ", ".join(f"case when {d} > 0 then {gap} / ({d}) end" for d, gap in SIDES)


@query(f"""with w as (select gid, kv, {WORLD.format("x0", "a_", "y0")}, {WORLD.format("x1", "b_", "y1")} from geo_lines),
  t as (select *, b_x - a_x as dx, b_y - a_y as dy from w, unnest(generate_series(greatest(0, floor(least(a_x, b_x))::int), least(31, floor(greatest(a_x, b_x))::int))) u(tx), unnest(generate_series(greatest(0, floor(least(a_y, b_y))::int), least(31, floor(greatest(a_y, b_y))::int))) v(ty)),
  c as (select *, greatest(0.0, {ENTER}) as lo, least(1.0, {LEAVE}) as hi from t where not (dx = 0 and (a_x < tx or a_x > tx + 1)) and not (dy = 0 and (a_y < ty or a_y > ty + 1))),
  q as (select tx, ty, gid, kv, floor((case when lo > 0 then a_x + lo * dx else a_x end - tx) * 4096 + 0.5)::int as x0, floor((case when lo > 0 then a_y + lo * dy else a_y end - ty) * 4096 + 0.5)::int as y0,
    floor((case when hi < 1 then a_x + hi * dx else b_x end - tx) * 4096 + 0.5)::int as x1, floor((case when hi < 1 then a_y + hi * dy else b_y end - ty) * 4096 + 0.5)::int as y1 from c where lo < hi)
  select tx, ty, gid, kv, x0, y0, x1, y1 from q where x0 <> x1 or y0 <> y1""")
def tile_lines(v):  # S23, G26: lines clipped to the tiles they touch, encoded as vector tiles and decoded
    lines = v.geo_lines.select("gid", "kv", F.array(F.array(geo.point("x0", "y0"), geo.point("x1", "y1"))).alias("parts"))
    made = tiles.encode_tiles(tiles.tile_rows(lines, "parts", 5, tiles.LINE), "parts", "lines", tiles.LINE, key="gid")
    found = tiles.read_tiles(made, "kv double")
    p = lambda i: F.get(F.get("parts", 0), i)
    return found.select("tx", "ty", F.col("id").alias("gid"), "kv", p(0)["x"].alias("x0"), p(0)["y"].alias("y0"), p(1)["x"].alias("x1"), p(1)["y"].alias("y1"))


@query(f"""with w as (select parcel_id, {WORLD.format("longitude", "a_", "latitude")} from parcels)
  select floor(a_x)::int as tx, floor(a_y)::int as ty, parcel_id, floor((a_x - floor(a_x)) * 4096 + 0.5)::int as x, floor((a_y - floor(a_y)) * 4096 + 0.5)::int as y from w""")
def tile_points(v):  # S23: points in their tiles
    points = v.parcels.select("parcel_id", F.array(F.array(geo.point("longitude", "latitude"))).alias("parts"))
    found = tiles.tile_rows(points, "parts", 5, tiles.POINT)
    p = F.get(F.get("parts", 0), 0)
    return found.select("tx", "ty", "parcel_id", p["x"].alias("x"), p["y"].alias("y"))
