import struct
import zipfile
from datetime import date, datetime

from pyspark.sql import functions as F

from gridlode.operators import spatial, stats, upsert
from gridlode.plans import routes
from gridlode.sources import detect, files, shapefile, sinks
from gridlode.streaming import sightings

FACILITY = "id long, name string, address_full string, city string, state string, latitude double, longitude double, source string, source_url string, first_seen_at timestamp, last_seen_at timestamp"


def facilities(spark):
    t = datetime(2024, 1, 2, 3, 4, 5)
    rows = [
        (1, "Zürich DC", "1 Road", "New York", "NY", 40.7128, -74.006, "s", "u1", t, t),
        (2, "B", "2 Road", "Austin", "TX", 30.2, -97.7, "s", "u2", t, t),
        (3, "C", None, None, "CA", None, None, "s", "u3", t, t),
    ]
    return spark.createDataFrame(rows, FACILITY)


def test_export(spark, tmp_path):
    rows = facilities(spark)
    assert sinks.export_csv(rows.coalesce(1), str(tmp_path / "a"))
    text = next((tmp_path / "a").glob("part-*")).read_text("utf-8").splitlines()
    assert text[0].startswith("id,name,address_full") and "-74.006" in text[1] and "2024-01-02T03:04:05" in text[1] and "Zürich" in text[1]
    assert text[3].startswith("3,C,,,CA,,") and len(text) == 4
    sinks.export_csv(rows.coalesce(1), str(tmp_path / "b"), header=False)
    assert len(next((tmp_path / "b").glob("part-*")).read_text().splitlines()) == 3
    assert sinks.export_csv(rows.where("1 = 0"), str(tmp_path / "c")) is False
    got = stats.facility_summary(rows).head().asDict()
    assert got == {"total_facilities": 3, "facilities_with_coordinates": 2, "facilities_with_full_address": 2, "unique_states": 3, "unique_cities": 2, "coordinate_success_rate": 66.7}
    assert stats.facility_summary(rows.where("1 = 0")).count() == 0


def test_geojson_and_manifest(spark, tmp_path):
    rows = facilities(spark).where("latitude is not null").select("id", "name", "latitude", "longitude").withColumn("acres", F.lit(2.5))
    got = sinks.feature_collection(rows, "acres", "2024-01-01")
    assert '"count": 2' in got and '"total_acres": 5.0' in got
    made = sinks.save_cache(rows, str(tmp_path), "dc", "2024-05-06T00:00:00", 4000.0)
    made = sinks.save_cache(rows.limit(1), str(tmp_path), "other", "2024-05-07T00:00:00")
    assert made["sources"]["dc"]["featureCount"] == 2 and made["sources"]["other"]["dataVersion"] == "20240507"
    assert files.static_or(spark, str(tmp_path / "dc"), lambda: None).count() == 2
    assert files.static_or(spark, str(tmp_path / "none"), lambda: rows).count() == 2
    sinks.write_by_month(facilities(spark), str(tmp_path / "months"), "first_seen_at")
    assert "month=1" in str([p.name for p in (tmp_path / "months" / "year=2024").iterdir()])


def test_seen_upsert_keeps_the_first_time(spark):
    a, b = datetime(2024, 1, 1), datetime(2024, 2, 1)
    schema = "source string, source_url string, name string, city string, at timestamp"
    old = upsert.seen_upsert(spark.createDataFrame([("s", "u", "Old", "X", a)], schema), ["source", "source_url"], ["name", "city"], "at")
    got = upsert.merge_seen(old, spark.createDataFrame([("s", "u", "New", None, b), ("s", "v", "V", "Y", b)], schema), ["source", "source_url"], ["name", "city"], "at")
    rows = {r["source_url"]: r for r in got.collect()}
    assert (rows["u"]["name"], rows["u"]["city"], rows["u"]["first_seen_at"], rows["u"]["last_seen_at"]) == ("New", None, a, b)
    assert rows["v"]["first_seen_at"] == b and len(rows) == 2
    # the same time again: the new row's values win
    again = upsert.merge_seen(got, spark.createDataFrame([("s", "u", "Newer", "Z", b)], schema), ["source", "source_url"], ["name", "city"], "at")
    assert {r["name"] for r in again.collect()} == {"Newer", "V"}


def test_keyed_tables(spark):
    old = spark.createDataFrame([(1, None, "a"), (2, 5.0, "b")], "k int, d double, v string")
    new = spark.createDataFrame([(1, None, "x"), (3, None, "y"), (3, None, "z")], "k int, d double, v string")
    got = upsert.keep_first(old, new, ["k", "d"], [F.col("v")])
    assert sorted((r["k"], r["v"]) for r in got.collect()) == [(1, "a"), (2, "b"), (3, "y")]
    got = upsert.latest_wins(old, new, ["k"], [F.desc("v")], keep=["d"])
    assert sorted((r["k"], r["d"], r["v"]) for r in got.where("d is not null").collect()) == [(2, 5.0, "b")]
    assert sorted((r["k"], r["v"]) for r in got.collect()) == [(1, "x"), (2, "b"), (3, "z")]
    ok, bad = upsert.rejects(old, ["d"])
    assert ok.count() == 1 and bad.count() == 1
    ls = spark.createDataFrame([(1, "active", date(2024, 1, 1)), (2, "expired", date(2023, 1, 1)), (3, "active", None)], "g int, status string, sale_end_date date")
    got = upsert.expire_by_date(ls, date(2024, 2, 1))
    assert sorted((r["g"], r["status"], r["changed"]) for r in got.collect()) == [(1, "expired", True), (2, "expired", False), (3, "active", False)]
    assert sorted(r["g"] for r in upsert.purge_expired(ls, date(2024, 2, 1), 30).collect()) == [1, 3]
    children = spark.createDataFrame([(1,), (2,), (9,)], "g int")
    assert sorted((r["g"], r["is_active"]) for r in upsert.active_from_parent(children, ls, "g").collect()) == [(1, True), (2, False), (9, None)]
    assert upsert.purge_children(children, ls.where("g < 2"), "g").count() == 1
    reg = spark.createDataFrame([("a", "t1", "2020")], "layer_name string, table_name string, created_at string")
    more = spark.createDataFrame([("a", "t2", "2024"), ("b", "t3", "2024")], reg.schema)
    got = {r["layer_name"]: r for r in upsert.register_dataset(reg, more, [F.col("table_name")]).collect()}
    assert (got["a"]["table_name"], got["a"]["created_at"], got["b"]["created_at"]) == ("t2", "2020", "2024")
    counts = spark.createDataFrame([("t2", 7)], "table_name string, row_count long")
    assert sorted((r["layer_name"], r["row_count"]) for r in routes.datasets(upsert.register_dataset(reg, more, [F.col("table_name")]), counts).collect()) == [("a", 7), ("b", 0)]


def test_spatial_finds_far_neighbours(spark):
    mesh = spark.createDataFrame([(0, 0, None, 3), (10, 40, 250.0, 2), (-400, 60, 300.0, 1)], "hex_q long, hex_r long, avg_temperature_f double, point_count long")
    sites = spark.createDataFrame([(1, 170.0, -80.0), (2, -60.0, 10.0)], "site long, lon double, lat double")
    got = {r["site"]: r for r in spatial.temperature_at(sites, mesh, "site").collect()}
    assert got[1]["avg_temperature_f"] == 250.0 and got[2]["avg_temperature_f"] is not None and len(got) == 2
    none = spatial.temperature_at(sites, mesh.where("1 = 0"), "site").collect()
    assert [r["avg_temperature_f"] for r in none] == [None, None]


def test_lookup_route(spark):
    pts = spark.createDataFrame([(1, 40.0, -100.0, 3000.0, 200.0), (2, 40.1, -100.0, 3050.0, 210.0), (3, 40.0, -100.0, 5000.0, 300.0)], "gid long, latitude double, longitude double, depth_m double, temperature_f double")
    got = routes.temperature_lookup(pts, 40.06, -100.0, 3000.0).head()
    assert got["temperature_f"] == 210.0 and 4 < got["distance_km"] < 5
    assert routes.temperature_lookup(pts, 20.0, -100.0, 3000.0).count() == 0
    probes = spark.createDataFrame([(7, 40.06, -100.0, 3000.0), (8, 0.0, 0.0, 3000.0)], "site long, lat double, lng double, depth double")
    assert {r["site"]: r["temperature_f"] for r in spatial.within_radius(probes, pts, "site").collect()} == {7: 210.0, 8: None}


def test_csv_sources(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text('Latitude,Longitude,Depth_ft,Temperature_C,note\n40.5,-100.25,1000,100,"a ""q"", b"\n95,-100,10,20,x\n,,,,\n4e,x,-9999,abc,y\n')
    rows = files.read_csv(spark, str(path))
    assert files.csv_profile(rows) == (["Latitude", "Longitude", "Depth_ft", "Temperature_C", "note"], 4)
    good, bad = files.points_from_csv(rows)
    r = good.collect()
    assert len(r) == 1 and (r[0]["latitude"], r[0]["depth_m"], r[0]["temperature_f"]) == (40.5, 304.8, 212.0) and bad.count() == 3
    assert rows.where("note = 'a \"q\", b'").count() == 1
    wkt = spark.createDataFrame([("SRID=3857;POINT(-11131949.0793 4865942.2795)", "5")], "geom string, depth string")
    p = files.points_from_csv(wkt)[0].head()
    assert round(p["longitude"], 4) == -100.0 and round(p["latitude"], 4) == 40.0
    assert files.rows_between(rows, skip=1, every=2).count() == 2
    found = detect.detect(spark, str(path))
    assert found["kind"] == "csv" and found["headers"][0] == "Latitude" and 2 <= found["estimate"] <= 6
    assert detect.looks_like_geojson('{"type": "FeatureCollection"}') and not detect.looks_like_geojson("a,b")
    assert [detect.encoding_of(b) for b in (b"abc", "é".encode() * 9, b"\xef\xbb\xbfa", b"\xff\xfea")] == ["ascii", "utf8", "utf8", "utf16le"]


def test_geojson_sources(spark, tmp_path):
    line = '{"type":"Feature","properties":{"voltage":"138-230","owner":" A "},"geometry":{"type":"LineString","coordinates":[[-100,40],[-101,41]]}}'
    point = '{"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":[1,2]}}'
    for name, text in (("a", f'{{"type":"FeatureCollection","features":[{line},{point}]}}'), ("b", line), ("c", f"[{line}]"), ("d", '{"type":"LineString","coordinates":[[1,2],[3,4]]}'), ("e", '{"error": "no"}')):
        (tmp_path / f"{name}.geojson").write_text(text)
    found = files.read_features(spark, str(tmp_path))
    assert found.count() == 5
    lines, bad = files.lines_from_features(found)
    assert lines.count() == 4 and bad.count() == 1
    r = lines.where("kv is not null").head()
    assert (r["kv"], r["owner"], len(r["geom"][0])) == (230.0, "A", 2)


def test_shapefiles(spark, tmp_path):
    pts = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]
    body = struct.pack("<i4d2ii", 5, 0, 0, 4, 4, 1, 4, 0) + b"".join(struct.pack("<2d", *p) for p in pts)
    shp = b"\0" * 100 + b"".join(struct.pack(">2i", i + 1, len(body) // 2) + body for i in range(3))
    dbf = struct.pack("<4BIHH20x", 3, 0, 0, 0, 3, 65, 11) + b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([10, 0]) + b"\0" * 14 + b"\r" + b"".join(b" " + f"rec{i}".encode().ljust(10) for i in range(3))
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("in/A.shp", shp)
        z.writestr("in/A.dbf", dbf)
    (tmp_path / "y.zip").write_text("<html>not an archive</html>")
    got = shapefile.read_shapefiles(spark, str(tmp_path / "*.zip")).collect()
    assert [(r["kind"], r["attributes"]["NAME"], len(r["parts"][0])) for r in got] == [("Polygon", f"rec{i}", 4) for i in range(3)]
    assert shapefile.read_shapefiles(spark, str(tmp_path / "*.zip"), every=2, most=1).count() == 1


def test_stream(spark, tmp_path):
    schema = "user string, name string, at timestamp"
    src, out, chk = (str(tmp_path / x) for x in ("src", "out", "chk"))
    for i, rows in enumerate(([("a", "A1", datetime(2024, 1, 1))], [("a", "A2", datetime(2024, 1, 3)), ("b", "B", datetime(2024, 1, 2))])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        sightings.stream_sightings(spark, src, schema, out, chk, ["user"], ["name"], "at").awaitTermination(120)
        got = {r["user"]: r for r in sightings.version(spark, out, i).collect()}
    assert (got["a"]["name"], got["a"]["first_seen_at"].day, got["a"]["last_seen_at"].day, got["b"]["name"]) == ("A2", 1, 3, "B")
