"""All queries of this package with the SQL that must give the same rows.

A query's name begins with what it shows; `op` in the comments is the number of the operation it covers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean, extract, geo, match
from ..operators import boundary, greedy_clusters, scoring, spatial, stats, upsert
from ..operators.shared import checkpoint
from . import routes
from .views import Views, duck

QUERIES: dict = {}
ORACLES: dict = {}

US = "((latitude between 24.0 and 49.6 and longitude between -125.0 and -66.5) or (latitude between 49.0 and 72.0 and longitude between -170.0 and -130.0) or (latitude between 18.9 and 22.4 and longitude between -161.0 and -154.0) or (latitude between 17.6 and 18.6 and longitude between -67.5 and -65.0))"
HEX = "round_even((sqrt(3) / 3 * x - y / 3) / 5.0, 0) as rq, round_even((2.0 / 3 * y) / 5.0, 0) as rr, round_even(-(sqrt(3) / 3 * x - y / 3) / 5.0 - (2.0 / 3 * y) / 5.0, 0) as rs, (sqrt(3) / 3 * x - y / 3) / 5.0 as q, (2.0 / 3 * y) / 5.0 as r"


def query(sql: str | None = None):
    """Registers a function of Views under its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = duck(sql)
        return f

    return add


def six(*columns):
    """Rounded to six decimals, as the oracles do."""
    return [F.round(c, 6).alias(c) for c in columns]


# points: filters and bins


@query(f"""select round_even(longitude / 0.5, 0) * 0.5 as lon, round_even(latitude / 0.5, 0) * 0.5 as lat, count(*) as point_count, round(avg(temperature_f), 1) as avg_temperature_f,
  round(avg(depth_m), 1) as avg_depth_m, round(min(temperature_f), 1) as min_temperature_f, round(max(temperature_f), 1) as max_temperature_f, round(stddev_samp(temperature_f), 1) as stddev_temperature_f
  from geo_points where {US} and temperature_f is not null group by 1, 2""")
def us_points_grid_agg(v):  # A2 over P5, G22
    return stats.grid_stats(v.geo_points.where(geo.in_us("latitude", "longitude")))


@query(f"""select row_number() over (order by lon, lat) as gid, * from (select round_even(longitude / 0.5, 0) * 0.5 as lon, round_even(latitude / 0.5, 0) * 0.5 as lat, count(*) as point_count,
  round(avg(temperature_f), 1) as avg_temperature_f, round(avg(depth_m), 1) as avg_depth_m, round(min(temperature_f), 1) as min_temperature_f, round(max(temperature_f), 1) as max_temperature_f
  from geo_points where {US} group by 1, 2)""")
def us_points_z0_9(v):  # A1, W1
    bins = stats.grid_stats(v.geo_points.where(geo.in_us("latitude", "longitude")), deviation=False, only_measured=False)
    return spatial.ranked(bins, [F.col("lon"), F.col("lat")], "gid")


@query(f"select gid, longitude, latitude, depth_m, temperature_f from geo_points where {US}")
def us_points(v):  # P5, P6
    return v.geo_points.where(geo.in_us("latitude", "longitude"))


@query("select gid, longitude, latitude, depth_m, temperature_f from geo_points where longitude between -110.0 and -100.0 and latitude between 30.0 and 40.0 and depth_m between 2950.0 and 3050.0")
def bbox_depth_points(v):  # P4, F1
    return v.geo_points.where(F.col("longitude").between(-110.0, -100.0) & F.col("latitude").between(30.0, 40.0) & F.col("depth_m").between(3000.0 - 50, 3000.0 + 50))


@query("select count(*) as n from geo_points where latitude between 15 and 75 and longitude between -170 and -60 and temperature_f >= 200")
def loose_box_hot_points(v):  # P10, P18
    return v.geo_points.where(geo.in_box("latitude", "longitude", geo.LOOSE_US_BOX) & (F.col("temperature_f") >= 200)).agg(F.count("*").alias("n"))


@query("select latitude between 24 and 50 and longitude between -125 and -66 as ok, count(*) as n from geo_points group by 1")
def lookup_box(v):  # P11, G31
    return v.geo_points.groupBy((geo.in_box("latitude", "longitude", geo.LOOKUP_BOX) & geo.valid_lonlat("longitude", "latitude")).alias("ok")).agg(F.count("*").alias("n"))


@query("select gid, floor(longitude / 0.5)::bigint as cx, floor(latitude / 0.5)::bigint as cy from geo_points")
def floor_cells(v):  # G23
    return v.geo_points.select("gid", geo.cell("longitude", 0.5).alias("cx"), geo.cell("latitude", 0.5).alias("cy"))


# projections and measures


@query("""with m as (select gid, longitude / 180.0 * 20037508.342789244 as x, ln(tan(pi() / 4 + radians(latitude) / 2)) * 6378137.0 as y from geo_points)
  select gid, round(x / 20037508.342789244 * 180.0, 6) as lon, round(degrees(2 * atan(exp(y / 20037508.342789244 * pi())) - pi() / 2), 6) as lat, round(x / 111320.0, 6) as crude_lon from m""")
def mercator_to_wgs84(v):  # G1-G4
    x, y = geo.lonlat_to_mercator("longitude", "latitude")
    m = v.geo_points.select("gid", x.alias("x"), y.alias("y"))
    lon, lat = geo.mercator_to_lonlat("x", "y")
    return m.select("gid", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"), F.round(geo.crude_lonlat("x", "y")[0], 6).alias("crude_lon"))


@query("""with w as (select gid, 'SRID=4326;POINT(' || cast(round(longitude, 3)::decimal(10, 3) as string) || ' ' || cast(round(latitude, 3)::decimal(10, 3) as string) || ')' as wkt, longitude, latitude from geo_points)
  select gid, 4326 as srid, round(longitude, 3) as x, round(latitude, 3) as y from w""")
def wkt_points(v):  # G8-G10
    text = lambda c: F.round(c, 3).cast("decimal(10,3)").cast("string")
    w = v.geo_points.select("gid", F.concat(F.lit("SRID=4326;POINT("), text("longitude"), F.lit(" "), text("latitude"), F.lit(")")).alias("wkt"))
    srid, x, y = geo.parse_wkt_point("wkt")
    return w.select("gid", srid.alias("srid"), F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("""select gid, round(2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians(latitude) - radians(40.0)) / 2), 2) + cos(radians(40.0)) * cos(radians(latitude)) * pow(sin(radians(longitude + 100.0) / 2), 2)))), 6) as km,
  floor(sqrt(pow(longitude + 100.0, 2) + pow(latitude - 40.0, 2)) * 69 + 0.5)::bigint as miles from geo_points""")
def distances(v):  # G16, G17
    lon, lat = F.lit(-100.0), F.lit(40.0)
    return v.geo_points.select("gid", F.round(geo.haversine_km(lon, lat, "longitude", "latitude"), 6).alias("km"), geo.degrees_to_miles(geo.degree_distance("longitude", "latitude", lon, lat)).alias("miles"))


@query("""select gid, floor((longitude + 180) / 360 * pow(2.0, 8))::bigint as x, floor((1 - ln(tan(radians(latitude)) + 1 / cos(radians(latitude))) / pi()) / 2 * pow(2.0, 8))::bigint as y from geo_points""")
def tile_keys(v):  # G24
    x, y = geo.tile_of("longitude", "latitude", F.lit(8))
    return v.geo_points.select("gid", x.alias("x"), y.alias("y"))


@query("""with t as (select distinct floor((longitude + 180) / 360 * 64)::bigint as x, floor((1 - ln(tan(radians(latitude)) + 1 / cos(radians(latitude))) / pi()) / 2 * 64)::bigint as y from geo_points)
  select x, y, round(x / 64.0 * 360 - 180, 6) as west, round((x + 1) / 64.0 * 360 - 180, 6) as east, round(degrees(atan(sinh(pi() * (1 - 2 * y / 64.0)))), 6) as north, round(degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 64.0)))), 6) as south,
  round((x + 1024 / 4096.0) / 64.0 * 360 - 180, 6) as quarter_lon from t""")
def tile_bounds(v):  # G25, G26, S23
    x, y = geo.tile_of("longitude", "latitude", F.lit(6))
    t = v.geo_points.select(x.alias("x"), y.alias("y")).distinct()
    west, south, east, north = geo.tile_bounds("x", "y", F.lit(6))
    quarter = geo.tile_pixel_to_lonlat(F.lit(1024.0), F.lit(0.0), "x", "y", F.lit(6))[0]
    named = {"west": west, "south": south, "east": east, "north": north, "quarter_lon": quarter}
    return t.select("x", "y", *[F.round(c, 6).alias(n) for n, c in named.items()])


# hexagons


@query(f"""with p as (select *, longitude * (69 * cos(radians(37.0))) as x, latitude * 69 as y from geo_points), h as (select *, {HEX} from p),
  k as (select *, abs(rq - q) as dq, abs(rr - r) as dr, abs(rs - (-q - r)) as ds from h),
  a as (select *, (case when dq > dr and dq > ds then -rr - rs else rq end)::bigint as hex_q, (case when not (dq > dr and dq > ds) and dr > ds then -rq - rs else rr end)::bigint as hex_r from k)
  select hex_q, hex_r, round(avg(temperature_f), 1) as avg_temperature_f, round(min(temperature_f), 1) as min_temperature_f, round(max(temperature_f), 1) as max_temperature_f, count(*) as point_count,
  'hex_' || hex_q || '_' || hex_r as hex_id from a where depth_m between 3950 and 4050 group by 1, 2""")
def hex_mesh_agg(v):  # A3, J7, G21
    return spatial.hex_mesh(v.geo_points.where("depth_m between 3950 and 4050"))


MESH = f"""p as (select *, longitude * (69 * cos(radians(37.0))) as x, latitude * 69 as y from geo_points), h as (select *, {HEX} from p),
  k as (select *, abs(rq - q) as dq, abs(rr - r) as dr, abs(rs - (-q - r)) as ds from h),
  a as (select *, (case when dq > dr and dq > ds then -rr - rs else rq end)::bigint as hex_q, (case when not (dq > dr and dq > ds) and dr > ds then -rq - rs else rr end)::bigint as hex_r from k),
  mesh as (select depth_m, hex_q, hex_r, round(avg(temperature_f), 1) as t, count(*) as n, 5.0 * (sqrt(3) * hex_q + sqrt(3) / 2 * hex_r) / (69 * cos(radians(37.0))) as clon, hex_r * 7.5 / 69 as clat from a group by 1, 2, 3)"""


@query(f"""with {MESH} select count(*) filter (t >= 302 and t < 392) as co2_only, count(*) filter (t >= 392) as both_fluids, count(*) filter (t >= 302) as total_hexes, count(*) filter (t >= 302) * 65.0 as square_miles,
  count(*) filter (t >= 302) * 41600.0 as acres, count(*) filter (t >= 302) * 13.0 / 1000 as total_gw, count(*) filter (t >= 302 and t < 392) * 13.0 / 1000 as co2_only_gw from mesh where depth_m = 5000""")
def egs_stats(v):  # A27, F13, G33
    return stats.resource_stats(spatial.hex_mesh(v.geo_points.where("depth_m = 5000")))


@query(f"""with {MESH}, c as (select count(*) filter (depth_m = 4000 and t >= 392) as conventional, count(*) filter (depth_m = 5000 and t >= 302) as co2 from mesh)
  select *, greatest(0, co2 - conventional) as unlocked, greatest(0, co2 - conventional) * 13.0 / 1000 as unlocked_gw, conventional * 13.0 / 1000 as conventional_gw from c""")
def egs_compare(v):  # A28
    at = lambda d: spatial.hex_mesh(v.geo_points.where(F.col("depth_m") == d))
    return stats.compare_meshes(at(4000.0), at(5000.0))


@query(f"""with {MESH} select s.section, count(*) as hexes, sum(n)::bigint as points from mesh join (values ('West Coast', -125, 32, -114, 49), ('Mountain West', -114, 31, -104, 49), ('Texas/Southwest', -107, 25, -94, 37),
  ('Great Plains', -104, 37, -96, 49), ('Midwest', -96, 37, -84, 49), ('Southeast', -94, 25, -75, 37), ('Northeast', -84, 37, -67, 47)) s(section, w, so, e, no)
  on clon - 0.08 < e and clon + 0.08 > w and clat - 0.07 < no and clat + 0.07 > so where depth_m = 4000 group by 1""")
def section_meshes(v):  # J8
    mesh = spatial.hex_mesh(v.geo_points.where("depth_m = 4000"))
    lon, lat = geo.hex_centre("hex_q", "hex_r")
    return spatial.in_sections(mesh.withColumn("lon", lon).withColumn("lat", lat), 0.08, 0.07).groupBy("section").agg(F.count("*").alias("hexes"), F.sum("point_count").alias("points"))


@query(f"""with {MESH} select hex_q, hex_r, t as avg_temperature_f from mesh where depth_m = 4000 and (t is not null or not ((clon > -66.0 and clat > 25.0 and clat < 45.0) or (clon < -125.0 and clat > 32.0 and clat < 48.0) or (clon > -95.0 and clon < -80.0 and clat < 25.0)))""")
def land_hexes(v):  # J15, J16
    lon, lat = geo.hex_centre("hex_q", "hex_r")
    mesh = spatial.hex_mesh(v.geo_points.where("depth_m = 4000")).withColumn("lon", lon).withColumn("lat", lat)
    return spatial.drop_ocean(mesh).select("hex_q", "hex_r", "avg_temperature_f")


def _hexagons(v):
    """The cells of the 4000 m mesh with their corners."""
    lon, lat = geo.hex_centre("hex_q", "hex_r")
    mesh = spatial.hex_mesh(v.geo_points.where("depth_m = 4000")).withColumn("lon", lon).withColumn("lat", lat)
    x, y = F.col("lon"), F.col("lat")
    corners = [geo.point(x + i * 0.08, y + j * 0.035) for i, j in ((0, -2), (1, -1), (1, 1), (0, 2), (-1, 1), (-1, -1), (0, -2))]
    return mesh.withColumn("ring", F.array(*corners))


def _boundaries(v):
    """Two parts per nation, a diamond, every other one with a hole, and a square beside it."""
    k = F.col("n_nationkey")
    x, y, w, h = -120.0 + (k * 37) % 50, 27.0 + (k * 11) % 20, 2.3 + k % 4, 1.7 + k % 3
    diamond = lambda z: F.array(geo.point(x - w * z, y), geo.point(x, y - h * z), geo.point(x + w * z, y), geo.point(x, y + h * z), geo.point(x - w * z, y))
    square = F.array(geo.point(x + w + 1, y), geo.point(x + w + 1.7, y), geo.point(x + w + 1.7, y + 0.7), geo.point(x + w + 1, y + 0.7))
    parts = F.when(k % 2 == 0, F.array(F.array(diamond(1.0), diamond(0.5)), F.array(square))).otherwise(F.array(F.array(diamond(1.0)), F.array(square)))
    return v.table("nation").select("n_nationkey", parts.alias("polygons"))


DIAMOND = "[{{'x': x - w * {0}, 'y': y}}, {{'x': x, 'y': y - h * {0}}}, {{'x': x + w * {0}, 'y': y}}, {{'x': x, 'y': y + h * {0}}}]"
TURN = "(({2} - {0}) * ({5} - {1}) - ({3} - {1}) * ({4} - {0}))"
OUTLINES = f"""b as (select n_nationkey as k, -120.0 + (n_nationkey * 37) % 50 as x, 27.0 + (n_nationkey * 11) % 20 as y, 2.3 + n_nationkey % 4 as w, 1.7 + n_nationkey % 3 as h from nation),
  r as (select k, {DIAMOND.format("1.0")} as l from b union all select k, {DIAMOND.format("0.5")} from b where k % 2 = 0
    union all select k, [{{'x': x + w + 1, 'y': y}}, {{'x': x + w + 1.7, 'y': y}}, {{'x': x + w + 1.7, 'y': y + 0.7}}, {{'x': x + w + 1, 'y': y + 0.7}}] from b),
  e as (select k, l[i].x as xa, l[i].y as ya, l[i % 4 + 1].x as xb, l[i % 4 + 1].y as yb from r, range(1, 5) t(i)),
  s as (select hex_q, hex_r, t, [{{'x': clon, 'y': clat - 0.07}}, {{'x': clon + 0.08, 'y': clat - 0.035}}, {{'x': clon + 0.08, 'y': clat + 0.035}}, {{'x': clon, 'y': clat + 0.07}}, {{'x': clon - 0.08, 'y': clat + 0.035}}, {{'x': clon - 0.08, 'y': clat - 0.035}}] as l from mesh where depth_m = 4000),
  d as (select hex_q, hex_r, l[i].x as cx, l[i].y as cy, l[i % 6 + 1].x as dx, l[i % 6 + 1].y as dy from s, range(1, 7) t(i)),
  met as (select distinct hex_q, hex_r, k from d join e on greatest(xa, xb) >= least(cx, dx) and least(xa, xb) <= greatest(cx, dx) and greatest(ya, yb) >= least(cy, dy) and least(ya, yb) <= greatest(cy, dy)
    where sign({TURN.format("cx", "cy", "dx", "dy", "xa", "ya")}) <> sign({TURN.format("cx", "cy", "dx", "dy", "xb", "yb")}) and sign({TURN.format("xa", "ya", "xb", "yb", "cx", "cy")}) <> sign({TURN.format("xa", "ya", "xb", "yb", "dx", "dy")})
    union select hex_q, hex_r, k from s join e on (ya > l[1].y) <> (yb > l[1].y) and l[1].x < (xb - xa) * (l[1].y - ya) / (yb - ya) + xa group by 1, 2, 3 having count(*) % 2 = 1)"""


@query(f"with {MESH}, {OUTLINES} select hex_q, hex_r, k as nation from met")
def boundary_hexes(v):  # J15, G12: hexagons against polygons of several parts with holes
    cells = checkpoint(_hexagons(v).select("hex_id", "hex_q", "hex_r", "ring"))
    cover = boundary.covering(_boundaries(v), "n_nationkey", 0.5)
    met = boundary.meeting(cells, "hex_id", "ring", cover, "n_nationkey", 0.5)
    return cells.join(met, "hex_id").select("hex_q", "hex_r", F.col("n_nationkey").alias("nation"))


@query(f"with {MESH}, {OUTLINES} select hex_q, hex_r, t as avg_temperature_f from s where t is not null or (hex_q, hex_r) in (select (hex_q, hex_r) from met)")
def trimmed_hexes(v):  # J15: all hexagons with data, and those without that meet a boundary
    return boundary.trim(checkpoint(_hexagons(v)), "hex_id", "ring", _boundaries(v), "n_nationkey", 0.5).select("hex_q", "hex_r", "avg_temperature_f")


def _sites(v):
    return v.ethanol.select("site", "name", "lon", "lat", "emissions"), v.emitters.select("site", "name", "lon", "lat", F.col("total_emissions_2023").alias("emissions"))


LOOKUP = f"""{MESH}, data as (select * from mesh where depth_m = 4000 and t is not null),
  s as (select *, lon * (69 * cos(radians(37.0))) as x, lat * 69 as y from sites), sh as (select *, {HEX} from s),
  sk as (select *, abs(rq - q) as dq, abs(rr - r) as dr, abs(rs - (-q - r)) as ds from sh),
  sa as (select *, (case when dq > dr and dq > ds then -rr - rs else rq end)::bigint as hq, (case when not (dq > dr and dq > ds) and dr > ds then -rq - rs else rr end)::bigint as hr from sk),
  held as (select sa.src, sa.site, sa.name, sa.emissions, sa.lon, sa.lat, d.t, d.n from sa left join data d on d.hex_q = sa.hq and d.hex_r = sa.hr),
  near as (select h.src, h.site, arg_min(struct_pack(t := d.t, n := d.n, m := floor(sqrt(pow(h.lon - d.clon, 2) + pow(h.lat - d.clat, 2)) * 69 + 0.5)::int), struct_pack(a := sqrt(pow(h.lon - d.clon, 2) + pow(h.lat - d.clat, 2)), b := d.hex_q)) as b
    from held h cross join data d where h.t is null group by 1, 2),
  found as (select h.src, h.site, h.name, h.emissions, coalesce(h.t, near.b.t) as t, coalesce(h.n, near.b.n) as n, case when h.t is not null then 0 else near.b.m end as miles from held h left join near using (src, site))"""


@query(f"""with sites as (select 1 as src, site, name, total_emissions_2023 as emissions, lon, lat from emitters), {LOOKUP}
  select site, t as avg_temperature_f, n as point_count, miles from found""")
def temperature_at_sites(v):  # J9
    mesh = spatial.hex_mesh(v.geo_points.where("depth_m = 4000"))
    return spatial.temperature_at(_sites(v)[1], mesh, "site").select("site", "avg_temperature_f", "point_count", "miles")


@query(f"""with top as (select * from emitters where total_emissions_2023 > 0 order by total_emissions_2023 desc, site limit 500),
  sites as (select 0 as src, site, name, emissions, lon, lat from ethanol where emissions > 0 union all select 1, site, name, total_emissions_2023, lon, lat from top), {LOOKUP},
  e as (select *, least(100.0, emissions / case src when 0 then 600000.0 else 20000000.0 end * 100) as es, case when coalesce(t, 0) = 0 then 0.0 else least(100.0, greatest(0.0, (t - 150) / 250 * 100)) end as gs from found),
  c as (select *, floor(es * 10 + 0.5) / 10 as emissions_score, floor(gs * 10 + 0.5) / 10 as geo_score, floor((es * 0.5 + gs * 0.5) * 10 + 0.5) / 10 as combined_score from e where es * 0.5 + gs * 0.5 > 0)
  select row_number() over (order by combined_score desc, src, emissions desc, site) as rank, site, name, case src when 0 then 'ethanol' else 'emitter' end as source_type, emissions_score, geo_score, combined_score
  from c order by 1 limit 10""")
def optimal_sites_topn(v):  # U1, F17, W2, O5
    mesh = spatial.hex_mesh(v.geo_points.where("depth_m = 4000"))
    best = scoring.optimal_sites(*_sites(v), mesh, 10)
    return best.select("rank", "site", "name", "source_type", "emissions_score", "geo_score", "combined_score")


# nearest neighbours


@query("""with h as (select site, lon, lat from emitters), d as (select h.site, arg_min(struct_pack(dt := g.dt, d := sqrt(pow(h.lon - g.longitude, 2) + pow(h.lat - g.latitude, 2))),
  struct_pack(d := sqrt(pow(h.lon - g.longitude, 2) + pow(h.lat - g.latitude, 2)), c := g.cell_id)) as b from h join geology g on abs(floor(g.longitude / 0.5) - floor(h.lon / 0.5)) <= 1 and abs(floor(g.latitude / 0.5) - floor(h.lat / 0.5)) <= 1 group by 1)
  select h.site, d.b.dt as dt, round(d.b.d, 6) as distance, coalesce(d.b.dt > 4000, false) as filtered from h left join d using (site)""")
def geology_nearest_basement(v):  # J10
    near = spatial.nearest_in_cells(v.emitters.select("site", "lon", "lat"), v.geology, "site", "lon", "lat", "longitude", "latitude", ["dt", "cell_id"], 0.5, "cell_id")
    return near.select("site", "dt", *six("distance"), F.coalesce(F.col("dt") > 4000, F.lit(False)).alias("filtered"))


@query("""with b as (select lon - 0.4 as w, lon + 0.4 as e, lat - 0.3 as s, lat + 0.3 as n from emitters where total_emissions_2023 > 10000000),
  g as (select distinct x, y from b, unnest(generate_series(floor(w)::bigint, floor(e)::bigint)) t(x), unnest(generate_series(floor(s)::bigint, floor(n)::bigint)) u(y))
  select cell_id, dt from geology where exists (select 1 from g where x = floor(longitude) and y = floor(latitude))""")
def geology_overlap_cells(v):  # J11, U4
    hot = v.emitters.where("total_emissions_2023 > 10000000")
    boxes = hot.select((F.col("lon") - 0.4).alias("west"), (F.col("lon") + 0.4).alias("east"), (F.col("lat") - 0.3).alias("south"), (F.col("lat") + 0.3).alias("north"))
    return spatial.semi_on_cells(v.geology, boxes).select("cell_id", "dt")


@query("""with p as (select site, lon as lng, lat, 3000.0 as depth from emitters), d as (select p.site, g.*, 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians(g.latitude) - radians(p.lat)) / 2), 2) + cos(radians(p.lat)) * cos(radians(g.latitude)) * pow(sin(radians(g.longitude - p.lng) / 2), 2)))) as km
  from p join geo_points g on g.depth_m between p.depth - 100 and p.depth + 100 and abs(g.latitude - p.lat) < 0.6),
  b as (select site, arg_min(struct_pack(t := temperature_f, z := depth_m, a := latitude, o := longitude, k := km), struct_pack(k := km, g := gid)) as b from d where km <= 50 group by 1)
  select p.site, b.b.t as temperature_f, b.b.z as depth_m, b.b.a as latitude, b.b.o as longitude, round(b.b.k, 6) as distance_km from p left join b using (site)""")
def nearest_temperature(v):  # J12, O4
    probes = v.emitters.select("site", F.col("lon").alias("lng"), "lat", F.lit(3000.0).alias("depth"))
    return spatial.within_radius(probes, v.geo_points, "site").withColumn("distance_km", F.round("distance_km", 6))


@query("""with w as (select (longitude + 180) / 360 * pow(2.0, 6) * 512 as x, (1 - ln(tan(radians(latitude)) + 1 / cos(radians(latitude))) / pi()) / 2 * pow(2.0, 6) * 512 as y, * from parcels)
  select floor(x / 50)::bigint as cx, floor(y / 50)::bigint as cy, count(*) as point_count, sum(acres) as acres, round(avg(longitude), 6) as lon, round(avg(latitude), 6) as lat from w group by 1, 2""")
def parcel_clusters(v):  # A31
    return spatial.clusters(v.parcels, 6).select("cx", "cy", "point_count", "acres", *six("lon", "lat"))


@query()  # the order of the items makes it, one by one: tests hold it against the plain loop
def parcel_cluster_levels(v):  # A31: each zoom from the one above
    levels = greedy_clusters.cluster_levels(v.parcels, "parcel_id", "acres", least=12)
    return reduce(DataFrame.unionByName, [found.select(F.lit(zoom).alias("zoom"), "parcel_id", *six("lon", "lat"), "point_count", "acres") for zoom, found in levels])


# lines


def _lines(v):
    return v.geo_lines.withColumn("line", F.array(geo.point("x0", "y0"), geo.point("x1", "y1")))


BANDED = "select gid, '{0}' as band, kv, {1} as owner from geo_lines where {2}"


@query(" union all ".join(BANDED.format(*b) for b in (("z0_6", "null", "kv > 138 or kv is null"), ("z7_10", "null", "kv > 69 or kv is null"), ("z11_14", "owner", "true"))))
def lines_zoom_band(v):  # P12
    out = None
    for band, least, full in (("z0_6", 138, False), ("z7_10", 69, False), ("z11_14", None, True)):
        rows = v.geo_lines if least is None else v.geo_lines.where(F.col("kv").isNull() | (F.col("kv") > least))
        rows = rows.select("gid", F.lit(band).alias("band"), "kv", (F.col("owner") if full else F.lit(None).cast("string")).alias("owner"))
        out = rows if out is None else out.unionByName(rows)
    return out


# a segment meets a box if the clipped interval of its parameter isn't empty; the oracle clips in one pass over both axes
SEGMENT = """with b(la0, la1, lo0, lo1) as (values (24.0, 49.6, -125.0, -66.5), (49.0, 72.0, -170.0, -130.0), (18.9, 22.4, -161.0, -154.0), (17.6, 18.6, -67.5, -65.0)),
  c as (select gid, x0, y0, x1 - x0 as dx, y1 - y0 as dy, b.* from geo_lines cross join b),
  t as (select *, case when dx = 0 then (case when x0 between lo0 and lo1 then 0.0 else 2.0 end) else least((lo0 - x0) / dx, (lo1 - x0) / dx) end as ax, case when dx = 0 then (case when x0 between lo0 and lo1 then 1.0 else -2.0 end) else greatest((lo0 - x0) / dx, (lo1 - x0) / dx) end as bx,
    case when dy = 0 then (case when y0 between la0 and la1 then 0.0 else 2.0 end) else least((la0 - y0) / dy, (la1 - y0) / dy) end as ay, case when dy = 0 then (case when y0 between la0 and la1 then 1.0 else -2.0 end) else greatest((la0 - y0) / dy, (la1 - y0) / dy) end as cy from c)
  select distinct gid from t where greatest(0.0, ax, ay) <= least(1.0, bx, cy)"""


@query(SEGMENT)
def lines_us(v):  # P7, P8, G12, G27
    return _lines(v).where(geo.line_in_us("line")).select("gid")


@query("""with c as (select gid, voltage, case when voltage = '-9999' then null else list_max(list_transform(string_split(regexp_replace(lower(voltage), '[^0-9\\-.,]', '', 'g'), '-'), lambda x: try_cast(nullif(regexp_extract(x, '^[0-9.]+'), '') as double))) end as parsed from geo_lines)
  select gid, parsed as kv, case when parsed is null or parsed = 0 then 'Unknown' when parsed < 69 then 'Distribution' when parsed < 138 then 'Sub-transmission' when parsed < 230 then 'Regional Transmission' when parsed < 345 then 'High Voltage Transmission' when parsed < 500 then 'Extra High Voltage' else 'Ultra High Voltage' end as voltage_class from c""")
def voltage_parse_class(v):  # F6, F9
    return v.geo_lines.select("gid", clean.parse_voltage("voltage").alias("kv")).withColumn("voltage_class", clean.voltage_class("kv"))


@query("""select count(*) as total_features, count(kv) as with_voltage, min(kv) as min_kv, max(kv) as max_kv, round(avg(kv), 6) as avg_kv, count(owner) as with_owner, min(least(x0, x1)) as west, min(least(y0, y1)) as south, max(greatest(x0, x1)) as east, max(greatest(y0, y1)) as north from geo_lines""")
def line_layer_stats(v):  # A5, G30
    return stats.line_layer_stats(v.geo_lines).withColumn("avg_kv", F.round("avg_kv", 6))


# listings and parcels

LISTED = """count(distinct sale_group) as total_listings, count(case when status = 'active' then 1 end) as active_rows, count(case when status = 'expired' then 1 end) as expired_rows, count(parcel_id) as total_parcels, sum(acres) as total_acres, round(avg(acres), 6) as avg_acres,
  cast(min(sale_start_date) as string) as first_sale, cast(max(sale_start_date) as string) as last_sale from listings left join (select sale_group, parcel_id, acres from parcels) using (sale_group)"""


def _as_text(df):
    """Dates as text and averages rounded, as the oracles have them."""
    return df.withColumns({"avg_acres": F.round("avg_acres", 6), "first_sale": F.col("first_sale").cast("string"), "last_sale": F.col("last_sale").cast("string")})


@query(f"select {LISTED}")
def listings_multi_stats(v):  # A10, A8, J1, J2
    return _as_text(stats.listing_parcel_stats(v.listings, v.parcels))


@query(f"select region, status, {LISTED} group by region, status")
def listings_by_region(v):  # A11, A9
    return _as_text(stats.listing_parcel_stats(v.listings, v.parcels, ["region", "status"]))


@query("select state, count(distinct sale_group) as listings, count(*) as parcels, sum(acres) as acres from parcels group by state")
def by_state(v):  # A9, O2
    out = v.parcels.groupBy("state").agg(F.countDistinct("sale_group").alias("listings"), F.count("*").alias("parcels"), F.sum("acres").alias("acres"))
    return out.orderBy(F.col("acres").desc_nulls_first(), "state")


UNFANNED = "count(*) as total_listings, count(*) filter (status = 'active') as active_listings, count(*) filter (status = 'expired') as expired_listings, sum(coalesce(parcel_count, 0))::bigint as total_parcels, round(sum(coalesce(total_acres, 0)), 2) as total_acres from listings"


@query(f"select {UNFANNED}")
def listings_stats_nofanout(v):  # A12, A20
    return stats.listing_stats(v.listings).withColumn("total_acres", F.round("total_acres", 2))


@query(f"select region, {UNFANNED} group by region")
def regional_stats(v):  # A13, O1
    return stats.listing_stats(v.listings, ["region"]).withColumn("total_acres", F.round("total_acres", 2)).orderBy(F.col("total_acres").desc_nulls_last())


@query("select sale_group, title, region, cast(sale_start_date as string) as sale_start_date from listings where status = 'active'")
def active_listings(v):  # P14, P15, O2
    return v.listings.where("status = 'active'").select("sale_group", "title", "region", F.col("sale_start_date").cast("string").alias("sale_start_date")).orderBy(F.col("sale_start_date").desc_nulls_first(), "sale_group")


@query(f"select parcel_id, sale_group, state, acres from parcels where {US} and is_active and exists (select 1 from listings l where l.sale_group = parcels.sale_group and l.status = 'active')")
def active_parcels_semi(v):  # P3, P9, P13, J3
    active = v.listings.where("status = 'active'").select("sale_group")
    return v.parcels.where(geo.in_us("latitude", "longitude") & F.col("is_active")).join(active, "sale_group", "left_semi").select("parcel_id", "sale_group", "state", "acres")


@query("select sale_group, case when status = 'active' and sale_group % 3 <> 0 then 'expired' else status end as status from listings")
def expire_missing(v):  # K14, J5
    return upsert.expire_missing(v.listings, v.listings.where("sale_group % 3 = 0"), "sale_group").select("sale_group", "status")


@query("select l.sale_group, case when l.sale_group % 3 <> 0 then 'expired' else status end as status, p.parcel_id, case when l.sale_group % 3 <> 0 then false else is_active end as is_active from listings l join parcels p on p.sale_group = l.sale_group")
def cleanup_expired_listings(v):  # K15
    listings, parcels = upsert.cleanup_expired(v.listings, v.parcels, v.listings.where("sale_group % 3 = 0"), "sale_group", only_active=False)
    return listings.select("sale_group", "status").join(parcels.select("sale_group", "parcel_id", "is_active"), "sale_group")


@query("select case when status = 'active' and sale_end_date < date '1997-01-01' then 'expired' else status end as status, count(*) as listings, count(*) filter (status = 'active' and sale_end_date < date '1997-01-01') as changed from listings group by 1")
def expire_by_date(v):  # K16, X1
    as_of = F.lit("1997-01-01").cast("date")
    return upsert.expire_by_date(v.listings, as_of).groupBy("status").agg(F.count("*").alias("listings"), F.count_if("changed").alias("changed"))


@query("select sale_group, status from listings where not coalesce(status = 'expired' and sale_end_date < date '1997-01-01' - interval 30 day, false)")
def purge_expired(v):  # K17, J4
    return upsert.purge_expired(v.listings, F.lit("1997-01-01").cast("date")).select("sale_group", "status")


@query("with k as (select sale_group from listings where not coalesce(status = 'expired' and sale_end_date < date '1997-01-01' - interval 30 day, false)) select parcel_id from parcels where sale_group in (select sale_group from k)")
def purge_expired_parcels(v):  # K17 (cascade), J4
    return upsert.purge_children(v.parcels, upsert.purge_expired(v.listings, F.lit("1997-01-01").cast("date")), "sale_group").select("parcel_id")


@query("select parcel_id, l.status = 'active' as is_active from parcels p left join listings l on l.sale_group = p.sale_group and l.sale_group % 5 <> 0")
def parcel_active_backfill(v):  # K19, J6
    return upsert.active_from_parent(v.parcels, v.listings.where("sale_group % 5 <> 0"), "sale_group").select("parcel_id", "is_active")


@query("select sale_group, status, count(parcel_id) as parcel_count, coalesce(sum(acres), 0) as total_acres, count(parcel_id) > 0 as is_processed from listings left join (select sale_group, parcel_id, acres from parcels) using (sale_group) group by 1, 2")
def listing_parcel_counts(v):  # K8, A30
    return upsert.with_parcel_stats(v.listings.select("sale_group", "status"), v.parcels, "sale_group")


# latest and first sightings

SEEN = "select user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) as event_type, arg_max(value, struct_pack(a := ts, b := event_id)) as value, min(ts) as first_seen_at, max(ts) as last_seen_at from sightings group by user_id"


@query(SEEN)
def upsert_first_last_seen(v):  # K10
    return upsert.seen_upsert(v.sightings, ["user_id"], ["event_type", "value"], "ts", ["event_id"])


@query("with d as (select max(ts) as m from sightings), s as (select user_id, max(ts) as last_seen_at from sightings group by 1) select user_id, last_seen_at from s, d where last_seen_at >= timestamp '2024-01-10 00:00:00' - interval 5 day")
def purge_unseen(v):  # K18
    seen = upsert.seen_upsert(v.sightings, ["user_id"], ["value"], "ts", ["event_id"])
    return upsert.purge_unseen(seen, F.lit("2024-01-10 00:00:00"), 5).select("user_id", "last_seen_at")


@query("select latitude, longitude, depth_m, min(gid) as gid from geo_points group by 1, 2, 3")
def ingest_keep_first(v):  # K3, K27
    keys = ["latitude", "longitude", "depth_m"]
    p = v.geo_points.select(*keys, "gid").crossJoin(F.broadcast(v.geo_points.agg((F.max("gid") / 2).alias("_half"))))
    old = upsert.first_per_key(p.where("gid <= _half").drop("_half"), keys, [F.col("gid")])
    return upsert.keep_first(old, p.where("gid > _half").drop("_half"), keys, [F.col("gid")])


@query("""with p as (select floor(latitude / 5)::bigint as cy, floor(longitude / 5)::bigint as cx, depth_m, gid from geo_points)
  select cy, cx, depth_m, coalesce(max(gid) filter (gid % 2 = 0), min(gid)) as gid from p group by 1, 2, 3""")
def ingest_keep_old(v):  # K3 with new rows for most of the old keys
    keys = ["cy", "cx", "depth_m"]
    p = v.geo_points.select(geo.cell("latitude", 5.0).alias("cy"), geo.cell("longitude", 5.0).alias("cx"), "depth_m", "gid")
    return upsert.keep_first(upsert.first_per_key(p.where("gid % 2 = 0"), keys, [F.desc("gid")]), p.where("gid % 2 = 1"), keys, [F.col("gid")])


@query("select region, case when exists (select 1 from listings x where x.region = l.region and x.status = 'active') then 'new' else 'old' end as origin, max(sale_group) filter (status = 'active') as sale_group from listings l group by region")
def upsert_latest_wins(v):  # K5, K7, K9
    rows = v.listings.select("region", F.lit("old").alias("origin"), F.lit(None).cast("long").alias("sale_group")).distinct()
    new = v.listings.where("status = 'active'").select("region", F.lit("new").alias("origin"), "sale_group")
    return upsert.latest_wins(rows, new, ["region"], [F.desc("sale_group")])


@query("select sale_group, case when sale_group % 4 = 0 then 'Titled ' || sale_group else title end as title, status from listings")
def update_listing(v):  # K6
    changes = v.listings.where("sale_group % 4 = 0").select("sale_group", F.concat(F.lit("Titled "), "sale_group").alias("title"))
    return upsert.update_by_key(v.listings, changes, "sale_group", ["title"]).select("sale_group", "title", "status")


@query("select region, arg_min(title, struct_pack(a := (title = 'Unknown Title')::int, b := sale_group)) as title, arg_min(sale_group, struct_pack(a := (title = 'Unknown Title')::int, b := sale_group)) as sale_group from listings group by region")
def dedupe_by_sale_group(v):  # W4
    return upsert.first_per_key(v.listings, ["region"], [F.col("title") == "Unknown Title", F.col("sale_group")]).select("region", "title", "sale_group")


@query("select name, city, state, row_number() over (partition by lower(coalesce(city, '')), lower(state) order by internal_id) > 1 as duplicate, internal_id from datacenters")
def duplicate_flags(v):  # repeats of a city and state by its SQL; W5 is duplicate_flags_named
    from pyspark.sql import Window

    w = Window.partitionBy(F.lower(F.coalesce("city", F.lit(""))), F.lower("state")).orderBy("internal_id")
    return v.datacenters.select("name", "city", "state", (F.row_number().over(w) > 1).alias("duplicate"), "internal_id")


@query("select internal_id, name, city, state, row_number() over (partition by lower(coalesce(name, '') || '|' || coalesce(city, '') || '|' || coalesce(state, '')) order by internal_id) > 1 as duplicate from found_facilities")
def duplicate_flags_named(v):  # W5
    return upsert.flag_repeats(v.found_facilities.select("internal_id", "name", "city", "state"), ["name", "city", "state"], [F.col("internal_id")])


@query("select page_id, name, operator, street from (select *, row_number() over (partition by page_id, name, street order by internal_id) as n from listed_cards) where n = 1")
def card_dedupe(v):  # W3
    text = F.concat(F.lit('<div class="ui card"><div class="header">'), "name", F.lit("</div><p>"), "operator", F.lit("</p><p>"), "street", F.lit("</p></div>"))
    cards = F.array_sort(F.collect_list(F.struct("internal_id", text.alias("card"))))
    pages = v.listed_cards.groupBy("page_id").agg(F.array_join(F.transform(cards, lambda c: c["card"]), "").alias("html"))
    return upsert.first_cards(pages, "page_id").select("page_id", "name", "operator", "street")


@query("select parcel_id, acres from parcels")
def unnest_rows(v):  # K13
    packed = v.parcels.groupBy("sale_group").agg(F.collect_list(F.struct("parcel_id", "acres")).alias("s"))
    return upsert.unnest(packed.select(F.col("s.parcel_id").alias("parcel_id"), F.col("s.acres").alias("acres")), ["parcel_id", "acres"])


# layers and points: statistics


@query("select count(*) as total_features, count(temperature_f) as with_temperature, count(depth_m) as with_depth, min(temperature_f) as min_temp, max(temperature_f) as max_temp, round(avg(temperature_f), 6) as avg_temp, min(depth_m) as min_depth, max(depth_m) as max_depth, min(longitude) as west, min(latitude) as south, max(longitude) as east, max(latitude) as north from geo_points")
def layer_stats(v):  # A4, A6, A7, G30
    return stats.point_layer_stats(v.geo_points).withColumn("avg_temp", F.round("avg_temp", 6))


@query("select count(*) as n, min(temperature_f) as min_t, max(temperature_f) as max_t, round(avg(temperature_f), 6) as avg_t from geo_points where depth_m = 3000")
def depth_slice_verify(v):  # A21
    return stats.depth_slice(v.geo_points).withColumn("avg_t", F.round("avg_t", 6))


@query("select count(*) as n, count(distinct longitude) as lons, count(distinct latitude) as lats from geo_points where depth_m = 3000")
def distinct_coordinates(v):  # A22
    return stats.distinct_coordinates(v.geo_points, 3000.0)


@query("select longitude, count(*) as n from geo_points group by 1 order by n desc, longitude limit 10")
def top_longitudes(v):  # A23, O6
    return stats.top_longitudes(v.geo_points)


@query("select longitude, latitude, count(*) as n from geo_points group by 1, 2 having count(*) > 1 order by n desc, longitude, latitude limit 5")
def duplicate_coords(v):  # A24
    return stats.duplicate_coordinates(v.geo_points)


@query("select 'geothermal' as layer_name, 'geo_points' as table_name, count(*) as row_count from geo_points union all select 'lines', 'geo_lines', count(*) from geo_lines union all select 'missing', 'none', 0")
def dataset_row_counts(v):  # J14, J17, S14
    registry = v.spark.createDataFrame([("geothermal", "geo_points"), ("lines", "geo_lines"), ("missing", "none")], "layer_name string, table_name string")
    counts = None
    for name in ("geo_points", "geo_lines"):
        one = getattr(v, name).agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        counts = one if counts is None else counts.unionByName(one)
    return registry.join(counts, "table_name", "left").fillna({"row_count": 0})


# data centres


def _centres(v):
    return v.datacenters.withColumn("missing_fields", clean.missing_fields(["operator", "state", "city", "latitude", "longitude", "facility_type", "power_capacity_mw"]))


MISSING = "list_filter([case when operator is null or operator = '' then 'operator' end, case when state is null or state = '' then 'state' end, case when city is null or city = '' then 'city' end, case when latitude is null then 'latitude' end, case when longitude is null then 'longitude' end, case when facility_type is null then 'facility_type' end, case when power_capacity_mw is null then 'power_capacity_mw' end], lambda x: x is not null)"


@query(f"select count(*) as total_datacenters, count(*) filter (is_us) as us_datacenters, count(*) filter (not is_us) as international_datacenters, count(distinct country) as countries_covered, count(distinct state) as states_covered, count(distinct operator) as unique_operators, round(sum(coalesce(power_capacity_mw, 0)), 2) as total_power_capacity_mw, round(avg(coalesce(power_capacity_mw, 0)), 6) as avg_power_capacity_mw, count(case when latitude is not null and longitude is not null then 1 end) as geocoded_count, count(*) filter (len({MISSING}) > 5) as low_quality_count from datacenters")
def datacenter_stats(v):  # A14, A20
    return stats.datacenter_stats(_centres(v)).withColumn("total_power_capacity_mw", F.round("total_power_capacity_mw", 2)).withColumn("avg_power_capacity_mw", F.round("avg_power_capacity_mw", 6))


@query("select country, is_us, count(*) as datacenter_count, count(distinct operator) as unique_operators, round(sum(coalesce(power_capacity_mw, 0)), 2) as total_power_mw, round(avg(coalesce(power_capacity_mw, 0)), 6) as avg_power_mw, count(latitude) as geocoded_count from datacenters group by 1, 2")
def country_stats(v):  # A15, A35
    return stats.country_stats(v.datacenters).withColumn("total_power_mw", F.round("total_power_mw", 2)).withColumn("avg_power_mw", F.round("avg_power_mw", 6))


@query("select operator, count(*) as facility_count, count(distinct country) as countries, round(sum(coalesce(power_capacity_mw, 0)), 2) as total_power_mw, count(*) filter (is_us) as us_facilities, count(*) filter (not is_us) as international_facilities from datacenters where operator is not null group by 1 order by 2 desc, 1 limit 50")
def operator_top50(v):  # A16, O6, O7
    return stats.operator_stats(v.datacenters).withColumn("total_power_mw", F.round("total_power_mw", 2))


@query(f"select internal_id, array_to_string({MISSING}, ',') as missing_fields, len({MISSING})::int as n_missing from datacenters")
def missing_fields(v):  # F25
    return _centres(v).select("internal_id", F.array_join("missing_fields", ",").alias("missing_fields"), F.size("missing_fields").alias("n_missing"))


@query("select facility_url, substr(sha256(facility_url), 1, 16) as internal_id, lower(country) in ('usa', 'united states', 'us', 'united states of america', 'u.s.', 'u.s.a.') as is_us from datacenters")
def url_hash_id(v):  # F23, F24
    return v.datacenters.select("facility_url", clean.id_of_url("facility_url").alias("internal_id"), clean.is_us_country("country").alias("is_us"))


@query("select internal_id, name, latitude, longitude, is_us from datacenters where latitude is not null and longitude is not null")
def datacenter_points(v):  # P1, P2, P22, O3
    return v.datacenters.where("latitude is not null and longitude is not null").select("internal_id", "name", "latitude", "longitude", "is_us").orderBy(F.col("name").asc_nulls_last())


@query("select internal_id, name from datacenters where facility_url = 'https://example.org/dc/7' limit 1")
def datacenter_by_url(v):  # P16, P17
    return v.datacenters.where(F.col("facility_url") == "https://example.org/dc/7").select("internal_id", "name").limit(1)


@query("select state, count(*) as facilities, count(*) filter (latitude is not null and longitude is not null) as with_coordinates from datacenters group by state")
def state_counts(v):  # A25, A32
    return stats.state_counts(v.datacenters)


@query("select count(*) as total_facilities, count(*) filter (coalesce(latitude, 0) <> 0 and coalesce(longitude, 0) <> 0) as facilities_with_coordinates, count(*) filter (address_full <> '') as facilities_with_full_address, count(distinct nullif(state, '')) as unique_states, count(distinct case when city <> '' and state <> '' then city || ', ' || state end) as unique_cities, round(count(*) filter (coalesce(latitude, 0) <> 0 and coalesce(longitude, 0) <> 0) * 100.0 / count(*), 1) as coordinate_success_rate from datacenters")
def facility_summary(v):  # A26
    return stats.facility_summary(v.datacenters)


@query("select count(*) as total, count(*) filter (is_us) as us, count(*) filter (not is_us) as international, count(*) filter (latitude is not null) as located, round(count(*) filter (latitude is not null) * 100.0 / count(*), 1) as coordinate_rate from datacenters")
def crawl_stats(v):  # A33, A35
    return stats.crawl_stats(v.datacenters)


# emitters

CATEGORY = "case when industry_type_sectors like '%Power Plants%' then 'Power Plants' when industry_type_sectors like '%Petroleum%' or industry_type_sectors like '%Natural Gas%' then 'Petroleum/Natural Gas' when industry_type_sectors like '%Waste%' then 'Waste' when industry_type_sectors like '%Chemicals%' then 'Chemicals' when industry_type_sectors like '%Minerals%' then 'Minerals' when industry_type_sectors like '%Metals%' then 'Metals' else 'Other' end"


@query(f"select {CATEGORY} as category, count(*) as n, (select count(*) from emitters) as total from emitters group by 1")
def emitter_categories(v):  # A17, F18
    return stats.category_counts(v.emitters)


@query(f"select site, {CATEGORY} as category, total_emissions_2023 from emitters where coalesce(total_emissions_2023, 0) >= 1000000 and {CATEGORY} in ('Power Plants', 'Waste', 'Other')")
def emitter_filter(v):  # P19, P20
    kind = clean.sector_category("industry_type_sectors")
    return v.emitters.where((F.coalesce("total_emissions_2023", F.lit(0.0)) >= 1_000_000) & kind.isin("Power Plants", "Waste", "Other")).select("site", kind.alias("category"), "total_emissions_2023")


@query("select coalesce(min(total_emissions_2023), 0) as min_emissions, coalesce(max(total_emissions_2023), 0) as max_emissions, round(avg(total_emissions_2023), 4) as avg_emissions from emitters")
def emission_range(v):  # A18, A19
    return stats.emission_range(v.emitters).withColumn("avg_emissions", F.round("avg_emissions", 4))


@query("""with e as (select site, coalesce(total_emissions_2023, 0) as x from emitters) select site, round(case when x <= 0 then 5.0 when x <= 50000 then 5 + x / 50000 * 2 when x <= 100000 then 7 + (x - 50000) / 50000 * 2 when x <= 500000 then 9 + (x - 100000) / 400000 * 3
  when x <= 1000000 then 12 + (x - 500000) / 500000 * 3 when x <= 5000000 then 15 + (x - 1000000) / 4000000 * 5 when x <= 16000000 then 20 + (x - 5000000) / 11000000 * 8 else 28.0 end, 6) as radius from e""")
def emitter_sizes(v):  # F19
    return v.emitters.select("site", F.round(clean.interpolate("total_emissions_2023"), 6).alias("radius"))


@query(f"select site, case when coalesce(total_emissions_2023, 0) = 0 then '#888888' else case {CATEGORY} when 'Power Plants' then '#F44336' when 'Petroleum/Natural Gas' then '#FF9800' when 'Waste' then '#795548' when 'Chemicals' then '#9C27B0' when 'Minerals' then '#607D8B' when 'Metals' then '#455A64' else '#9E9E9E' end end as colour from emitters")
def emitter_colours(v):  # F18
    return v.emitters.select("site", clean.sector_colour("industry_type_sectors", "total_emissions_2023").alias("colour"))


# temperatures and geology


@query("select gid, floor((temperature_f - 32) * 5 / 9 * 10 + 0.5) / 10 as temperature_c, round(depth_m * 0.3048, 6) as from_feet, case when temperature_f is null then null when temperature_f < 302 then 'none' when temperature_f < 392 then 'co2' else 'both' end as zone, (temperature_f >= 180)::int + (temperature_f >= 220)::int + (temperature_f >= 260)::int + (temperature_f >= 300)::int as band from geo_points where temperature_f is not null")
def temperature_classes(v):  # F1, F2, F11-F13
    p = v.geo_points.where("temperature_f is not null")
    return p.select("gid", clean.fahrenheit_to_celsius("temperature_f").alias("temperature_c"), F.round(clean.feet_to_metres("depth_m"), 6).alias("from_feet"), clean.egs_zone("temperature_f").alias("zone"), clean.temperature_band("temperature_f").alias("band"))


@query("""with t as (select *, case code when 'BSMT1' then 'Felsic igneous/metamorphic' when 'BSMT2' then 'Intermediate igneous/metamorphic' when 'BSMT3' then 'Mafic igneous/metamorphic' when 'BSMT4' then 'Mixed/undifferentiated crystalline' when '' then 'Unknown' else code end as kind from geology)
  select cell_id, kind, case when contains(lower(kind), 'mafic') then 'U' when dt < 3000 then 'F' when dt < 6000 then 'M' else 'U' end as quality, dt >= 5000 as deep from t""")
def geology_quality(v):  # F14, F15, P21, A32
    kind = clean.described("code", clean.BASEMENT_TYPES)
    return v.geology.select("cell_id", kind.alias("kind"), clean.geology_quality("dt", kind).alias("quality"), (F.col("dt") >= 5000).alias("deep"))


@query("select cell_id, round_even((dt - 125) / 50.0, 0)::bigint as thickness from geology")
def thickness(v):  # F16
    return v.geology.select("cell_id", clean.thickness(F.col("dt") / 50.0, F.lit(2.5)).cast("long").alias("thickness"))


@query("select gid, list_filter([case when latitude not between -90 and 90 then 'Latitude out of range' end], lambda x: x is not null) = [] as ok, case when not " + US + " then 'Coordinates outside US bounds' else '' end as warnings from geo_points")
def validated_points(v):  # F47, G28
    warn = F.array_join(clean.point_warnings(), ",")
    return v.geo_points.select("gid", (F.size(clean.point_errors()) == 0).alias("ok"), warn.alias("warnings"))


# texts: titles, names, links, JSON


@query("""with t as (select sale_group, title, lower(title) as t from listings), r as (select *, case when t like '%wyoming%' then 'Wyoming' when t like '%nevada%' then 'Nevada' when t like '%new mexico%' then 'New Mexico' when t like '%utah%' then 'Utah' when t like '%las vegas%' then 'Nevada' else 'Unknown' end as region from t)
  select sale_group, region, case when t like '%geothermal%' then 'Geothermal' when t like '%land sale%' then 'Land Sale' else 'Oil & Gas Lease' end as listing_type, case when t like '%blm%' then 'BLM ' || region || ' State Office' when t like '%state oil & gas%' or t like '%state land%' then region || ' State Lands'
  when t like '%dnr%' then region || ' DNR' when t like '%clo%' then region || ' CLO' when t like '%city of las vegas%' then 'City of Las Vegas' else 'Unknown Agency' end as agency,
  case when t like '%west virginia%' then 'West Virginia' when t like '%new mexico%' then 'New Mexico' when t like '%wyoming%' then 'Wyoming' when t like '%kansas%' then 'Kansas' when t like '%nevada%' then 'Nevada' when t like '%utah%' then 'Utah' else 'Unknown' end as state from r""")
def listing_title_class(v):  # F28, F29
    return v.listings.select("sale_group", extract.listing_class("title").alias("c"), extract.state_in("title").alias("state")).select("sale_group", "c.*", "state")


STOPS = "|".join(match.STOP_WORDS)


@query(f"select p_partkey as id, trim(regexp_replace(regexp_replace(regexp_replace(upper(p_name || ' Co. ' || p_type || ' Energy, LLC'), '[^A-Z0-9\\s]', '', 'g'), '\\b({STOPS})\\b', '', 'g'), '\\s+', ' ', 'g')) as name from part")
def name_normalize(v):  # F20
    return v.table("part").select(F.col("p_partkey").alias("id"), match.normalise_name(F.concat("p_name", F.lit(" Co. "), "p_type", F.lit(" Energy, LLC"))).alias("name"))


NORMAL = lambda x: f"trim(regexp_replace(regexp_replace(regexp_replace(upper({x}), '[^A-Z0-9\\s]', '', 'g'), '\\b({STOPS})\\b', '', 'g'), '\\s+', ' ', 'g'))"
WORDS = lambda x: f"list_filter(string_split({x}, ' '), lambda w: length(w) > 2)"


@query(f"""with c as (select p_partkey as id, {NORMAL('p_type')} as company, {NORMAL("p_brand || ' site'")} as site, cast(p_partkey % 10 as string) as state from part),
  f as (select s_suppkey as fid, {NORMAL("case s_suppkey % 4 when 0 then 'Economy Brass LLC' when 1 then 'Large Burnished Corp' when 2 then 'Promo Steel Co' else 'Standard Plated Inc' end")} as facility, {NORMAL("'Brand#' || (s_suppkey % 30)")} as city, cast(s_suppkey % 10 as string) as state from supplier where s_acctbal >= 0),
  s as (select id, fid, case when contains(company, facility) or contains(facility, company) then 50 else 0 end + case when contains(site, city) or contains(city, site) then 30 else 0 end
    + coalesce(list_sum(flatten(list_transform({WORDS('company')}, lambda a: list_transform({WORDS('facility')}, lambda b: case when a = b then 10 when contains(a, b) or contains(b, a) then 5 else 0 end)))), 0)
    + coalesce(list_sum(flatten(list_transform({WORDS('site')}, lambda a: list_transform({WORDS('city')}, lambda b: case when a = b then 15 else 0 end)))), 0) as score from c join f using (state))
  select id, arg_min(fid, struct_pack(a := -score, b := fid))::bigint as fid, max(score)::bigint as score from s group by id having max(score) >= 25""")
def fuzzy_match(v):  # J13, F21; its states are equal or don't match
    text = lambda x: match.normalise_name(x)
    c = v.table("part").select(F.col("p_partkey").alias("id"), text("p_type").alias("company"), text(F.concat("p_brand", F.lit(" site"))).alias("site"), (F.col("p_partkey") % 10).cast("string").alias("state"))
    names = F.element_at(F.array(*map(F.lit, ("Economy Brass LLC", "Large Burnished Corp", "Promo Steel Co", "Standard Plated Inc"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    f = v.table("supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("fid"), text(names).alias("facility"), text(F.concat(F.lit("Brand#"), F.col("s_suppkey") % 30)).alias("city"), (F.col("s_suppkey") % 10).cast("string").alias("state"))
    return match.best_facilities(c, f)


@query(f"""with c as (select id, {NORMAL('company')} as company, {NORMAL('site')} as site, upper(coalesce(state, '')) as state from ethanol_owners),
  f as (select fid, {NORMAL('facility')} as facility, {NORMAL('city')} as city, upper(coalesce(state, '')) as state from epa_sites),
  s as (select id, fid, case when contains(company, facility) or contains(facility, company) then 50 else 0 end + case when contains(site, city) or contains(city, site) then 30 else 0 end
    + coalesce(list_sum(flatten(list_transform({WORDS('company')}, lambda a: list_transform({WORDS('facility')}, lambda b: case when a = b then 10 when contains(a, b) or contains(b, a) then 5 else 0 end)))), 0)
    + coalesce(list_sum(flatten(list_transform({WORDS('site')}, lambda a: list_transform({WORDS('city')}, lambda b: case when a = b then 15 else 0 end)))), 0) as score
    from c join f on contains(c.state, f.state) or contains(f.state, substring(c.state, 1, 2)))
  select id, arg_min(fid, struct_pack(a := -score, b := fid))::bigint as fid, max(score)::bigint as score from s group by id having max(score) >= 25""")
def fuzzy_match_states(v):  # J13, F21, P26 over states written in different forms
    plain = lambda *names: [match.normalise_name(n).alias(n) for n in names]
    return match.best_facilities(v.ethanol_owners.select("id", *plain("company", "site"), "state"), v.epa_sites.select("fid", *plain("facility", "city"), "state"))


@query("""select page_id, regexp_extract_all(html, '<a\\b[^>]*?href=["'']([^"'']*)["''][^>]*>([^<]*)', 1) as hrefs from html""")
def page_links(v):  # F36, S16
    return v.html.select("page_id", F.transform(extract.anchors("html"), lambda a: a["href"]).alias("hrefs"))


@query("""select page_id, replace(replace(replace(replace(replace(nullif(trim(regexp_extract(html, '<title[^>]*>([^<]*)', 1)), ''), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') as title, length(html) >= 500 and not regexp_matches(html, '(?i)access denied|captcha|verify you are human') as ok from html""")
def page_titles(v):  # S17
    return v.html.select("page_id", extract.title_of("html").alias("title"), extract.valid_page("html").alias("ok"))


@query("""with l as (select page_id, url, unnest(regexp_extract_all(html, '<a\\b[^>]*?href=["'']([^"'']*)["''][^>]*>([^<]*)', 1)) as href from html)
  select href, min(page_id) as page_id, count(*) as n from l group by href""")
def url_dedupe(v):  # W6
    links = v.html.select("page_id", F.explode(extract.anchors("html")).alias("a"))
    return links.groupBy(F.col("a.href").alias("href")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


@query("""select page_id, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]+)', 1) || '/next' as absolute, regexp_replace(url, '[^/]*$', '') || 'below' as relative, lower(url) like '%partner%' or lower(url) like '%affiliate%' or lower(url) like '%utm\\_%' escape '\\' or lower(url) like '%/ad/%' or lower(url) like '%sponsor/%' as sponsor from html""")
def resolved_urls(v):  # F31, P24
    return v.html.select("page_id", extract.resolve_url(F.lit("/next"), "url").alias("absolute"), extract.resolve_url(F.lit("below"), "url").alias("relative"), extract.is_sponsor_link("url").alias("sponsor"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k, coalesce(try_cast(json_extract_string(props, '$.k') as bigint) > 50, false) as large from events")
def json_props(v):  # values out of JSON
    k = F.get_json_object("props", "$.k").try_cast("long")
    return v.table("events").select("event_id", k.alias("k"), F.coalesce(k > 50, F.lit(False)).alias("large"))


@query("select c_custkey as id, try_cast(replace(printf('%.0f', c_acctbal * 100), '.', '') as bigint) as plain, case when c_custkey % 3 = 0 then null else floor(abs(c_acctbal))::bigint end as emissions from customer")
def thousands(v):  # F22
    rows = v.table("customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    text = F.when(F.col("id") % 3 == 0, "---").otherwise(F.format_number(F.floor(F.abs("c_acctbal")), 0))
    return rows.select("id", F.format_string("%.0f", F.col("c_acctbal") * 100).try_cast("long").alias("plain"), match.parse_thousands(text).alias("emissions"))


@query("select internal_id, coalesce(nullif(address_full, ''), 'Unknown') as address, nullif(trim(state), '') as state from datacenters")
def defaults(v):  # P27, F8
    return v.datacenters.select("internal_id", clean.or_default("address_full", "Unknown").alias("address"), clean.clean_string("state").alias("state"))


# routes of the service


@query("select l.layer_name, coalesce(c.n, 0) as row_count from (values ('points', '2024'), ('lines', '2023'), ('none', '2022')) l(layer_name, created_at) left join (select 'points' as k, count(*) as n from geo_points union all select 'lines', count(*) from geo_lines) c on c.k = l.layer_name")
def route_datasets(v):
    registry = v.spark.createDataFrame([("points", "points", "2024"), ("lines", "lines", "2023"), ("none", "gone", "2022")], "layer_name string, table_name string, created_at string")
    count = lambda name, rows: rows.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
    return routes.datasets(registry, count("points", v.geo_points).unionByName(count("lines", v.geo_lines))).select("layer_name", "row_count")


@query("""select temperature_f, round(km, 6) as distance_km, depth_m, latitude, longitude from (select *, 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians(latitude) - radians(38.0)) / 2), 2) + cos(radians(38.0)) * cos(radians(latitude)) * pow(sin(radians(longitude + 100.0) / 2), 2)))) as km from geo_points)
  where km <= 50 and depth_m between 2900 and 3100 order by km limit 1""")
def route_temperature_lookup(v):
    return routes.temperature_lookup(v.geo_points, 38.0, -100.0, 3000.0).withColumn("distance_km", F.round("distance_km", 6))


@query("select longitude, latitude, depth_m, temperature_f from geo_points where longitude between -105 and -95 and latitude between 35 and 45 and depth_m between 3950 and 4050")
def route_tile_data(v):
    return routes.geothermal_tile_data(v.geo_points, -105.0, 35.0, -95.0, 45.0, 4000.0)


@query("select parcel_id, sale_group, longitude, latitude from parcels where is_active")
def route_pins(v):
    return routes.pins(v.parcels).select("parcel_id", "sale_group", "longitude", "latitude")


@query("select site, name, emissions from ethanol")
def route_ethanol_plants(v):
    return routes.ethanol_plants(v.ethanol).select("site", "name", "emissions")


@query("select cell_id, case when code = 'BSMT3' then 'U' when dt < 3000 then 'F' when dt < 6000 then 'M' else 'U' end as quality from geology where dt >= 2000")
def route_geology(v):
    return routes.geology(v.geology, 2000.0).select("cell_id", "quality")


from . import ingest, pages, shapes  # noqa: E402, F401  they register their queries
