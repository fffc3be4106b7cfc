"""Queries that write a view with a sink of this package, read it back with a source, and give what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import stats, upsert
from ..operators.shared import fresh_path
from ..operators.versions import KeyedTable
from ..sources import detect, files, ledger, shapefile, sinks
from ..streaming import sightings
from .catalog import query


def _new(v, name):
    return fresh_path(v.spark, name)


def _raw(rows, header, path):
    """Lines (value) as they are, under a header line in each file."""
    rows.select(F.col("value").alias(header)).write.option("header", True).option("sep", "\u0001").option("quote", "\u0000").csv(path)
    return path


# CSV and sheets


@query("select latitude, longitude, round(abs(depth_m * 0.3048), 6) as depth_m, round(temperature_f * 9 / 5 + 32, 6) as temperature_f from geo_points")
def csv_points(v):  # S1, S11, K2, F3-F5
    note = F.concat(F.lit('say "'), F.col("gid").cast("string"), F.lit('", ok'))
    heat = F.coalesce(F.col("temperature_f").cast("string"), F.lit("-9999"))
    rows = v.geo_points.select(note.alias("note"), F.col("latitude").alias("Latitude"), F.col("longitude").alias("Longitude"), F.col("depth_m").alias("Depth_ft"), heat.alias("Temperature_C"))
    path = _new(v, "csv")
    sinks.write_csv(rows, path)
    good, _ = files.points_from_csv(files.read_csv(v.spark, path))
    return good.select("latitude", "longitude", F.round("depth_m", 6).alias("depth_m"), F.round("temperature_f", 6).alias("temperature_f"))


@query("select 'gid|longitude|latitude' as headers, count(*) as row_count from geo_points")
def csv_headers(v):  # S2
    path = _new(v, "csv")
    sinks.write_csv(v.geo_points.select("gid", "longitude", "latitude"), path)
    headers, n = files.csv_profile(files.read_csv(v.spark, path))
    return v.spark.createDataFrame([("|".join(headers), n)], "headers string, row_count long")


@query("select parcel_id, acres, state from parcels where parcel_id % 10 not in (3, 5)")
def csv_strict_rows(v):  # S12: lines with a field too many or too few go, quoted commas don't count
    n = F.col("parcel_id") % 10
    more = F.when(n == 3, ",more").otherwise("")
    value = F.concat(F.col("parcel_id").cast("string"), F.lit(","), F.col("acres").cast("string"), F.when(n == 5, "").otherwise(F.concat(F.lit(',"'), "state", F.lit(', US"'))), more)
    path = _raw(v.parcels.select(value.alias("value")), "parcel_id,acres,state", _new(v, "csv"))
    rows = files.read_csv(v.spark, path, strict=True)
    return rows.select(F.col("parcel_id").cast("long").alias("parcel_id"), F.col("acres").cast("double").alias("acres"), F.split("state", ",")[0].alias("state"))


@query("""select internal_id as id, name || ' é' as name, case internal_id % 4 when 0 then 'plain' when 1 then 'two' || chr(10) || 'lines' when 2 then 'say "' || name || '",' || chr(10) || '"' end as note, encoding
  from datacenters cross join (values ('utf8'), ('utf16be'), ('latin1')) e(encoding)""")
def csv_quoted_records(v):  # S1, S12, S21: line breaks, separators and quotes inside fields, in the encodings that are found
    k = F.col("internal_id") % 4
    note = F.when(k == 0, "plain").when(k == 1, "two\nlines").when(k == 2, F.concat(F.lit('say "'), "name", F.lit('",\n"')))
    rows = v.datacenters.select(F.col("internal_id").alias("id"), F.concat("name", F.lit(" é")).alias("name"), note.alias("note"))
    out = None
    for charset in ("UTF-8", "UTF-16", "ISO-8859-1"):
        path = _new(v, "csv")
        sinks.write_csv(rows, path, charset)
        back = files.read_csv(v.spark, path)
        one = back.select(F.col("id").cast("long").alias("id"), "name", "note", F.lit(detect.detect(v.spark, path)["encoding"]).alias("encoding"))
        out = one if out is None else out.unionByName(one)
    return out


@query("select count(*) as all_rows, count(*) as ids, sum(parcel_id)::bigint as total from parcels where parcel_id % 10 not in (3, 5)")
def csv_strict_pruned(v):  # S12: malformed lines go whatever columns are read
    n = F.col("parcel_id") % 10
    value = F.concat(F.col("parcel_id").cast("string"), F.when(n == 5, "").otherwise(F.lit(",a")), F.when(n == 3, ",b,c").otherwise(",b"))
    path = _raw(v.parcels.select(value.alias("value")), "parcel_id,acres,state", _new(v, "csv"))
    rows = files.read_csv(v.spark, path, strict=True)
    some = rows.select("parcel_id").agg(F.count("parcel_id").alias("ids"), F.sum(F.col("parcel_id").cast("long")).alias("total"))
    return some.select(F.lit(rows.count()).cast("long").alias("all_rows"), "ids", "total")


@query("""select internal_id as id, '"' || name as name, ' Inc"' as kind, country from datacenters""")
def csv_plain_split(v):  # S13: quoted commas split too
    value = F.concat(F.col("internal_id").cast("string"), F.lit(',"'), "name", F.lit(', Inc",'), "country")
    path = _new(v, "lines")
    v.datacenters.select(value.alias("value")).write.text(path)
    return files.split_lines(v.spark.read.text(path), ["id", "name", "kind", "country"]).withColumn("id", F.col("id").cast("long"))


@query("""select site, name || ', "x"' as name, total_emissions_2023 as emissions from emitters""")
def emitter_sheets(v):  # S8, S9: sheets of 500 rows, titles above, two sets of headers
    line = F.concat(F.col("site").cast("string"), F.lit(',"'), "name", F.lit(', ""x""",'), F.coalesce(F.col("total_emissions_2023").cast("string"), F.lit("")))
    sheets = v.emitters.groupBy(F.floor(F.col("site") / 500).alias("sheet")).agg(F.array_sort(F.collect_list(line)).alias("l"))
    head = F.when(F.col("sheet") % 2 == 0, "Facility Id,Facility Name,Emissions").otherwise("ID,Name,Total")
    path = _new(v, "sheets")
    titles = [F.lit(t) for t in ("Report", "as of 2023", "in tonnes")]
    sheets.select(F.concat_ws("\n", *titles, head, F.array_join("l", "\n")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    found = files.read_sheets(v.spark, path, {"site": ["Facility Id", "ID"], "name": ["Facility Name", "Name"], "emissions": ["Emissions", "Total"]}, skip=3)
    return found.select(F.col("site").cast("long").alias("site"), "name", F.col("emissions").cast("double").alias("emissions"))


@query("select l_orderkey, l_linenumber from (select *, row_number() over () - 1 as i from lineitem) where i >= 1000 and (i - 1000) % 7 = 0")
def resumed_rows(v):  # P23: positions in the file
    return files.rows_between(v.table("lineitem").select("l_orderkey", "l_linenumber"), skip=1000, every=7)


@query("""select count(*) filter (temperature_f > 0 and longitude <> 0 and latitude <> 0) as valid, count(*) filter (not coalesce(temperature_f > 0 and longitude <> 0 and latitude <> 0, false)) as invalid
  from (select * from geo_points order by gid limit 1000)""")
def first_rows_valid(v):  # A34
    return stats.valid_sample(v.geo_points.orderBy("gid"), ["longitude", "latitude", "temperature_f"], "temperature_f")


@query("select * from (values ('csv', 'csv', 'ascii', 'gid|longitude|latitude', true), ('geojson', 'geojson', 'utf8', '', true)) t(name, kind, encoding, headers, close)")
def detected_files(v):  # S19-S22: the estimates come within a tenth
    out, points = [], v.geo_points.select("gid", "longitude", "latitude")
    total = points.count()
    for name in ("csv", "geojson"):
        path = _new(v, "detect")
        if name == "csv":
            sinks.write_csv(points, path)
        else:
            sinks.write_features(points.withColumn("name", F.lit("é")), path)
        found = detect.detect(v.spark, path)
        out.append((name, found["kind"], found["encoding"], "|".join(found["headers"]), abs(found["estimate"] - total) <= 0.1 * total))
    return v.spark.createDataFrame(out, "name string, kind string, encoding string, headers string, close boolean")


# GeoJSON, lines of JSON, shapefiles


def _feature(props, kind, coordinates):
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*props).alias("properties"), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry")))


def _collection(features):
    return F.concat(F.lit('{"type":"FeatureCollection","features":['), features, F.lit("]}"))


@query("select sale_group, parcel_id, state, longitude, latitude from parcels")
def geojson_parcels(v):  # S3, G29: a collection per listing, cut into features by many tasks
    f = _feature(["parcel_id", "sale_group", "state"], "Point", F.array("longitude", "latitude"))
    path = _new(v, "geojson")
    v.parcels.groupBy("sale_group").agg(F.array_join(F.collect_list(f), ",\n").alias("l")).select(_collection(F.col("l")).alias("value")).write.text(path)
    at = F.from_json("coordinates", "array<double>")
    p = F.from_json("properties", "parcel_id long, sale_group long, state string")
    return files.read_features(v.spark, path, split=True).select(p["sale_group"].alias("sale_group"), p["parcel_id"].alias("parcel_id"), p["state"].alias("state"), F.get(at, 0).alias("longitude"), F.get(at, 1).alias("latitude"))


@query("""select sale_group, parcel_id, 'Feature' as kind, '"type":"Feature"}]{[' || parcel_id as text, longitude, latitude from parcels""")
def geojson_by_structure(v):  # S3, S4: keys in any order, brackets and the word Feature in strings, lists of features elsewhere
    props = F.struct("sale_group", "parcel_id", F.lit("Feature").alias("kind"), F.concat(F.lit('"type":"Feature"}]{['), F.col("parcel_id").cast("string")).alias("text"))
    geometry = F.struct(F.array("longitude", "latitude").alias("coordinates"), F.lit("Point").alias("type"))
    f = F.to_json(F.struct(props.alias("properties"), geometry.alias("geometry"), F.lit("Feature").alias("type")))
    whole = F.concat(F.lit('{"old":[{"type":"Feature"}],"name":"features","features":['), "l", F.lit('],"type":"FeatureCollection","more":[{"features":[{"type":"Feature"}]}]}'))
    path = _new(v, "geojson")
    v.parcels.groupBy("sale_group").agg(F.array_join(F.collect_list(f), ",").alias("l")).select(whole.alias("value")).write.text(path)
    rows = files.read_features(v.spark, path, split=True)
    at = F.from_json("coordinates", "array<double>")
    p = F.from_json("properties", "parcel_id long, sale_group long, kind string, text string")
    return rows.select(p["sale_group"].alias("sale_group"), p["parcel_id"].alias("parcel_id"), p["kind"].alias("kind"), p["text"].alias("text"), F.get(at, 0).alias("longitude"), F.get(at, 1).alias("latitude"))


@query("select internal_id::varchar as file, ['Point', 'LineString', 'Point', 'Polygon'][internal_id % 4 + 1] as kind, [2, 1, 3, 1][internal_id % 4 + 1]::bigint as n from datacenters")
def geojson_shapes(v):  # S4: a collection, a feature, an array of features, a bare geometry
    point = _feature(["name"], "Point", F.array(F.lit(1.0), F.lit(2.0)))
    line = _feature(["name"], "LineString", F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))))
    bare = F.lit('{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}')
    k = F.col("internal_id") % 4
    value = F.when(k == 0, _collection(F.concat_ws(",", point, point))).when(k == 1, line).when(k == 2, F.concat(F.lit("["), F.concat_ws(",", point, point, point), F.lit("]"))).otherwise(bare)
    text = v.datacenters.select(F.col("internal_id").cast("string").alias("file"), value.alias("value"))
    return files.normalise_features(text).groupBy("file", "kind").agg(F.count("*").alias("n"))


@query("select gid, case when kv is null then '' else kv::int::varchar end as voltage, coalesce(nullif(trim(owner), ''), '-') as owner, kv, x0, y1 from geo_lines")
def geojson_lines(v):  # S3, K4, G27: features of lines to rows of a table
    voltage = F.when(F.col("kv").isNull(), "").otherwise(F.col("kv").cast("int").cast("string"))
    coordinates = F.array(F.array("x0", "y0"), F.array("x1", "y1"))
    props = [F.col("gid").cast("string").alias("id"), voltage.alias("voltage"), "owner"]
    path, table = _new(v, "geojson"), _new(v, "lines")
    v.geo_lines.select(_feature(props, "LineString", coordinates).alias("value")).write.text(path)
    lines, _ = files.lines_from_features(files.read_features(v.spark, path, split=True))
    sinks.append_rows(lines, table)
    out = v.spark.read.parquet(table)
    first, last = F.get(F.get("geom", 0), 0), F.get(F.get("geom", 0), 1)
    return out.select(F.col("id_text").cast("long").alias("gid"), F.coalesce(F.col("kv").cast("int").cast("string"), F.lit("")).alias("voltage"), F.coalesce("owner", F.lit("-")).alias("owner"), "kv", first["x"].alias("x0"), last["y"].alias("y1"))


@query("select sale_group, case when sale_group % 3 = 0 then null else sale_group::varchar end as listing_id from listings")
def listing_files(v):  # S10
    name = F.concat(F.lit("store://a/2024_x/"), F.when(F.col("sale_group") % 3 == 0, "all").otherwise(F.col("sale_group").cast("string")), F.lit("_parcels.geojson"))
    return v.listings.select("sale_group", files.listing_of_file(name).alias("listing_id"))


@query("select case when region = '1-URGENT' then null else left(region, 1) end as listing_id, sale_group, title from listings")
def feature_folder(v):  # S10: a folder of files, the listing from their names
    folder = _new(v, "folder")
    rows = v.listings.select("region", _feature(["sale_group", "title"], "Point", F.array(F.lit(1.0), F.lit(2.0))).alias("f"))
    for region in sorted(r["region"] for r in rows.select("region").distinct().collect()):  # five
        name = "all" if region == "1-URGENT" else region[0]
        sinks.write_collection_file(rows.where(F.col("region") == region).select(F.col("f").alias("value")), f"{folder}/{name}_parcels.geojson")
    found = files.read_feature_folder(v.spark, folder, split=True)
    p = F.from_json("properties", "sale_group long, title string")
    return found.select("listing_id", p["sale_group"].alias("sale_group"), p["title"].alias("title"))


@query("select site, name, total_emissions_2023 from emitters")
def ndjson_emitters(v):  # S5
    path = _new(v, "ndjson")
    v.emitters.select("site", "name", "total_emissions_2023").write.json(path)
    return files.read_lines_json(v.spark, path, "site long, name string, total_emissions_2023 double")


@query("""select cell_id, 'Polygon' as kind, longitude as west, latitude as south from (select *, row_number() over (partition by cell_id // 100 order by cell_id) - 1 as i from geology) where i % 3 = 0""")
def shapefile_cells(v):  # S6, S7, U2: archives of 100 cells, every third record of each
    x, y = F.col("longitude"), F.col("latitude")
    ring = F.array(geo.point(x, y), geo.point(x, y + 0.1), geo.point(x + 0.1, y + 0.1), geo.point(x, y))
    cells = v.geology.select(F.floor(F.col("cell_id") / 100).alias("archive"), F.col("cell_id").alias("key"), ring.alias("ring"))
    path = _new(v, "shapes")
    shapefile.write_archives(cells, path)
    found = shapefile.read_shapefiles(v.spark, path, every=3)
    first = F.get(F.get("parts", 0), 0)
    return found.select(F.element_at("attributes", "KEY").cast("long").alias("cell_id"), "kind", first["x"].alias("west"), first["y"].alias("south"))


# sinks


@query("""with p as (select floor(latitude / 5)::bigint as cy, floor(longitude / 5)::bigint as cx, depth_m, gid from geo_points)
  select cy, cx, depth_m, coalesce(min(gid) filter (depth_m < 4000), min(gid)) as gid from p group by 1, 2, 3""")
def staged_points(v):  # K1, K3, K27: batches to staging, then into the table where their keys are new
    keys, path = ["cy", "cx", "depth_m"], _new(v, "staging")
    p = v.geo_points.select(geo.cell("latitude", 5.0).alias("cy"), geo.cell("longitude", 5.0).alias("cx"), "depth_m", "gid")
    old = upsert.first_per_key(p.where("depth_m < 4000"), keys, [F.col("gid")])
    for batch in (p.where("depth_m >= 3000"), p.where("depth_m < 3000")):
        sinks.append_rows(batch, path)
    return upsert.keep_first(old, v.spark.read.parquet(path), keys, [F.col("gid")])


@query("""select n_name as layer_name, case when n_regionkey < 3 then 'new_' else 'old_' end || n_nationkey as table_name, '2020' as created_at from nation union all select r_name, 'layer_' || r_regionkey, '2024' from region""")
def registry_upsert(v):  # K11: created_at stays
    n, r = v.table("nation"), v.table("region")
    entry = lambda df, name, prefix, key, at: df.select(F.col(name).alias("layer_name"), F.concat(F.lit(prefix), F.col(key).cast("string")).alias("table_name"), F.lit(at).alias("created_at"))
    old = entry(n, "n_name", "old_", "n_nationkey", "2020")
    new = entry(n.where("n_regionkey < 3"), "n_name", "new_", "n_nationkey", "2024").unionByName(entry(r, "r_name", "layer_", "r_regionkey", "2024"))
    return upsert.register_dataset(old, new, [F.col("table_name")])


@query("""with n as (select region, sale_group, title from listings where sale_group % 4 = 1), o as (select region, sale_group, title from listings where sale_group % 2 = 0 union all select region, sale_group, 'old' from listings where sale_group % 8 = 1)
  select sale_group, case when sale_group % 4 = 1 then title || '!' else title end as title, case when sale_group % 8 = 1 then '2020' else '2024' end as created, region from (select * from n union all select * from o where sale_group % 2 = 0) where sale_group % 10 <> 0""")
def stored_upserts(v):  # K5, K7, K9, K10: a table on disk, changed by key, of which only touched buckets are written anew
    rows = lambda where, title, at: v.listings.where(where).select("sale_group", title.alias("title"), F.lit(at).alias("created"), "region")
    old = rows("sale_group % 2 = 0", F.col("title"), "2024").unionByName(rows("sale_group % 8 = 1", F.lit("old"), "2020"))
    new = rows("sale_group % 4 = 1", F.concat("title", F.lit("!")), "2024")
    table = KeyedTable.create(v.spark, _new(v, "listings"), old.schema, ["sale_group"], 8)
    for change in (old, new):
        table.merge(change, lambda had, came: upsert.latest_wins(had, came, ["sale_group"], [F.col("title")], keep=["created"]))
    table.delete(v.listings.where("sale_group % 10 = 0").select("sale_group"))
    return table.read()


@query("select internal_id, name from datacenters where is_us")
def reloaded_table(v):  # K12: all rows go before the new ones come
    rows = v.datacenters.select("internal_id", "name", "is_us")
    table = KeyedTable.create(v.spark, _new(v, "reload"), rows.drop("is_us").schema, ["internal_id"], 4)
    for part in (rows, rows.where("is_us")):
        table.replace(part)
    return table.read()


@query("select internal_id, longitude as x, latitude as y from datacenters")
def derived_geometry(v):  # K20, K21, X2, G29
    at = lambda i: F.get_json_object("geom", f"$.coordinates[{i}]").cast("double")
    return sinks.with_geometry(v.datacenters).select("internal_id", at(0).alias("x"), at(1).alias("y"))


@query("""select parcel_id, case when parcel_id % 3 = 0 then longitude + 1 when parcel_id % 3 = 1 then longitude end as longitude, case when parcel_id % 3 = 0 then latitude + 0.5 when parcel_id % 3 = 1 then latitude end as latitude,
  case when parcel_id % 3 = 0 then '2024-05-06' when parcel_id % 3 = 1 then '2020-01-01' end as updated, parcel_id % 3 < 2 as has_point from parcels""")
def parcel_centroids(v):  # K20, K21, X2: centroids of rings where parcels have no point, and when they were written
    k = F.col("parcel_id") % 3
    x, y = F.col("longitude"), F.col("latitude")
    ring = F.array(geo.point(x, y), geo.point(x + 2, y), geo.point(x + 2, y + 1), geo.point(x, y + 1), geo.point(x, y))
    lost = lambda c: F.when(k == 1, F.col(c))
    old = v.parcels.select("parcel_id", F.when(k == 0, ring).alias("ring"), lost("longitude").alias("longitude"), lost("latitude").alias("latitude"), F.when(k == 1, F.lit("2020-01-01")).cast("timestamp").alias("updated_at"))
    out = sinks.with_centroid(old, as_of="2024-05-06")
    return out.select("parcel_id", F.round("longitude", 9).alias("longitude"), F.round("latitude", 9).alias("latitude"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated"), F.col("geom").isNotNull().alias("has_point"))


@query("select n_nationkey as id, n_name as name, (n_nationkey * 2)::double as longitude, (n_nationkey - 10)::double as latitude, (select count(*) from nation) as total, (select sum(n_regionkey)::double from nation) as total_size, '2024-01-01' as generated from nation")
def nation_collection(v):  # K22: one collection with its metadata
    n = F.col("n_nationkey")
    rows = v.table("nation").select(n.alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("double").alias("size"), (n * 2.0).alias("longitude"), (n - 10.0).alias("latitude"))
    text = sinks.feature_collection(rows, "size", "2024-01-01", key="id")
    whole = v.spark.createDataFrame([(text,)], "value string")
    feature = "struct<id:long,properties:struct<name:string>,geometry:struct<coordinates:array<double>>>"
    parsed = whole.select(F.from_json("value", f"features array<{feature}>, metadata struct<count:long,generated:string,total_size:double>").alias("c"))
    f = parsed.select(F.explode("c.features").alias("f"), "c.metadata")
    return f.select("f.id", "f.properties.name", F.get("f.geometry.coordinates", 0).alias("longitude"), F.get("f.geometry.coordinates", 1).alias("latitude"), F.col("metadata.count").alias("total"), "metadata.total_size", "metadata.generated")


@query("select 'facilities' as source, count(*) as feature_count, '20240506' as data_version, count(*) as stored from datacenters union all select 'lines', count(*), '20240507', count(*) from geo_lines")
def cached_layers(v):  # K23, K24, S18: tables beside a manifest, read in place of the query
    folder = _new(v, "cache")
    sinks.save_cache(v.datacenters.select("internal_id", "name"), folder, "facilities", "2024-05-06T00:00:00")
    made = sinks.save_cache(v.geo_lines, folder, "lines", "2024-05-07T00:00:00")
    out = None
    for name, entry in made["sources"].items():
        rows = files.static_or(v.spark, f"{folder}/{name}", lambda: v.geo_lines.where("1 = 0")).agg(F.count("*").alias("stored"))
        one = rows.select(F.lit(name).alias("source"), F.lit(entry["featureCount"]).cast("long").alias("feature_count"), F.lit(entry["dataVersion"]).alias("data_version"), "stored")
        out = one if out is None else out.unionByName(one)
    return out


@query("""select internal_id as id, name, nullif(address_full, '') as address_full, city, nullif(state, '') as state, country, latitude, longitude, facility_url as source_url, '2024-01-02T03:04:05' as first_seen_at, null::varchar as postal_code from datacenters""")
def facility_export(v):  # K25, K2, S15
    seen = F.lit("2024-01-02 03:04:05").cast("timestamp")
    rows = v.datacenters.withColumnsRenamed({"internal_id": "id", "facility_url": "source_url"}).withColumn("first_seen_at", seen)
    path = _new(v, "export")
    sinks.export_csv(rows, path)
    back = files.read_csv(v.spark, path)
    kinds = {"id": "long", "latitude": "double", "longitude": "double"}
    names = ("id", "name", "address_full", "city", "state", "country", "latitude", "longitude", "source_url", "first_seen_at", "postal_code")
    return back.select(*[F.col(c).cast(kinds.get(c, "string")).alias(c) for c in names])


@query("select sale_group, title from listings where region = '1-URGENT'")
def listing_cache(v):  # K26: one folder per group, of which one is read
    folder = _new(v, "listings")
    sinks.save_listings(v.listings.select(F.col("region").alias("listing_id"), "sale_group", "title"), folder)
    return sinks.load_listing(v.spark, folder, "1-URGENT").select("sale_group", "title")


@query("select month(l_shipdate)::int as month, count(*) as n, sum(l_quantity) as quantity from lineitem where year(l_shipdate) = 1995 group by 1")
def month_partitions(v):  # K28: the filter prunes folders
    path = _new(v, "months")
    sinks.write_by_month(v.table("lineitem").select("l_orderkey", "l_quantity", "l_shipdate"), path, "l_shipdate")
    return v.spark.read.parquet(path).where("year = 1995").groupBy("month").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("select gid, longitude, latitude from geo_points")
def resumed_ingest(v):  # T2: an ingest that stops after one batch of ranges, and a second run that does the rest
    path = _new(v, "csv")
    sinks.write_csv(v.geo_points.select("gid", "longitude", "latitude"), path)
    lines = "gid long, longitude double, latitude double"
    parse = lambda rows: rows.where("value <> 'gid,longitude,latitude'").select("_range", F.from_csv("value", lines).alias("r")).select("_range", "r.*")
    book = ledger.Ledger(v.spark, _new(v, "ledger"))
    for most in (1, None):
        ledger.ingest(v.spark, path, book, parse, range_bytes=256 << 10, batch=4, most=most)
    return book.output(v.spark.createDataFrame([], lines).schema)


@query("select user_id, strftime(max(ts), '%Y-%m-%d') as day, min(ts) as first_seen_at, max(ts) as last_seen_at from sightings group by user_id")
def streamed_sightings(v):  # T2, K10: micro-batches from new files, then a restart that finds nothing new
    source, target, state = (_new(v, n) for n in ("stream", "seen", "offsets"))
    rows = v.sightings.select("user_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    rows.repartition(3).write.parquet(source)
    for _ in range(2):
        sightings.stream_sightings(v.spark, source, "user_id long, ts timestamp, day string", target, state, ["user_id"], ["day"], "ts", files=2).awaitTermination()
    return sightings.version(v.spark, target, 1)
