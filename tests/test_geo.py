import json
import math

import pytest
from pyspark.sql import functions as F

from gridlode.functions import clean, extract, geo, match, simplify
from gridlode.sources import files

def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).head()["x"]


def ring(*pts):
    return F.array(*[geo.point(F.lit(float(x)), F.lit(float(y))) for x, y in pts])


def test_mercator_round_trip(spark):
    x, y = geo.lonlat_to_mercator(F.lit(-104.9), F.lit(39.7))
    lon, lat = geo.mercator_to_lonlat(x, y)
    assert one(spark, lon) == pytest.approx(-104.9) and one(spark, lat) == pytest.approx(39.7)


def test_albers_origin_and_known_point(spark):
    lon, lat = geo.albers_to_lonlat(F.lit(0.0), F.lit(0.0))
    assert (one(spark, lon), one(spark, lat)) == (pytest.approx(-96), pytest.approx(23, abs=1e-7))
    # forward projection of (-120, 45) by the same ellipsoid formulas
    a, f = 6378137.0, 1 / 298.257222101
    e2 = f * (2 - f)
    e = math.sqrt(e2)
    q = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
    m = lambda s: math.sqrt(1 - s * s) / math.sqrt(1 - e2 * s * s)
    s0, s1, s2, s = (math.sin(math.radians(v)) for v in (23, 29.5, 45.5, 45))
    n = (m(s1) ** 2 - m(s2) ** 2) / (q(s2) - q(s1))
    c = m(s1) ** 2 + n * q(s1)
    rho, rho0, t = a * math.sqrt(c - n * q(s)) / n, a * math.sqrt(c - n * q(s0)) / n, n * math.radians(-120 + 96)
    lon, lat = geo.albers_to_lonlat(F.lit(rho * math.sin(t)), F.lit(rho0 - rho * math.cos(t)))
    assert one(spark, lon) == pytest.approx(-120, abs=1e-7) and one(spark, lat) == pytest.approx(45, abs=1e-7)


def test_rings(spark):
    square = ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))
    assert one(spark, geo.point_in_ring(F.lit(1.0), F.lit(1.0), square)) is True
    assert one(spark, geo.point_in_ring(F.lit(5.0), F.lit(1.0), square)) is False
    assert one(spark, geo.vertex_mean(square, False)).asDict() == {"x": 2.0, "y": 2.0}
    assert one(spark, geo.vertex_mean(square, True))["x"] == pytest.approx(1.6)
    assert one(spark, geo.ring_centroid(square)).asDict() == {"x": pytest.approx(2.0), "y": pytest.approx(2.0)}
    assert one(spark, geo.corner_centre(square)).asDict() == {"x": 2.0, "y": 2.0}
    assert one(spark, geo.valid_polygon(square)) and not one(spark, geo.valid_polygon(ring((0, 0), (1, 1))))
    assert len(one(spark, geo.drop_repeats(ring((0, 0), (0, 0), (1, 1), (1, 1), (0, 0))))) == 3
    assert one(spark, geo.looks_mercator(ring((-1.2e7, 4e6), (1, 1))))


def test_hexagon_holds_its_points(spark):
    pts = spark.range(2000).select(((F.col("id") * 7919) % 5000 / 1000.0 - 100).alias("lon"), ((F.col("id") * 104729) % 4000 / 1000.0 + 35).alias("lat"))
    q, r = geo.hex_key("lon", "lat")
    inside = pts.withColumn("q", q).withColumn("r", r).withColumn("ring", geo.hex_ring("q", "r"))
    assert inside.where(~geo.point_in_ring("lon", "lat", "ring")).count() == 0


def test_parcel_acres(spark, tmp_path):
    """Boxes of degrees, whose area on the sphere has a closed form; one with a hole, one in metres, one of two parts."""
    box = lambda x, y, d: [[x, y], [x + d, y], [x + d, y + d], [x, y + d], [x, y]]
    area = lambda x, y, d: 6378137.0**2 * math.radians(d) * (math.sin(math.radians(y + d)) - math.sin(math.radians(y))) * 0.000247105
    metres = [[x * 20037508.342789244 / 180, math.log(math.tan(math.radians(45 + y / 2))) * 6378137.0] for x, y in box(-104, 40, 0.01)]
    shapes = [
        ("Polygon", [box(-105, 47, 0.02)], area(-105, 47, 0.02)),
        ("Polygon", [box(-105, 46, 0.03), box(-104.99, 46.01, 0.01)], area(-105, 46, 0.03) - area(-104.99, 46.01, 0.01)),
        ("Polygon", [metres], area(-104, 40, 0.01)),
        ("MultiPolygon", [[box(-103, 33, 0.01)], [box(-102, 34, 0.02)]], area(-103, 33, 0.01) + area(-102, 34, 0.02)),
    ]
    collection = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"TRACT": f"t{i}", "state": "MT"}, "geometry": {"type": k, "coordinates": c}} for i, (k, c, _) in enumerate(shapes)]}
    (tmp_path / "6406_parcels.geojson").write_text(json.dumps(collection))
    features = files.read_feature_folder(spark, str(tmp_path))
    got = {r["parcel_id"]: r["acres"] for r in files.parcels_from_features(features).collect()}
    assert got == {f"t{i}": pytest.approx(acres, rel=1e-9) for i, (_, _, acres) in enumerate(shapes)}
    assert {r["listing_id"] for r in features.collect()} == {"6406"}
    bare = features.withColumn("properties", F.lit("{}"))
    assert sorted(r["parcel_id"] for r in files.parcels_from_features(bare).collect()) == ["001", "002", "003", "004"]


def test_clean(spark):
    assert clean.detect_fields(["Depth (m)", "LATITUDE", "long", "T (degC)", "geom"]) == {"depth": "Depth (m)", "latitude": "LATITUDE", "longitude": "long", "geometry": "geom"}
    for text, want in (("138-230 kV", 230.0), ("69kV", 69.0), ("", None), ("n/a", None), ("-9999", None), (None, None), ("1,150", 1.0)):
        assert one(spark, clean.parse_voltage(F.lit(text))) == want, text
    assert one(spark, clean.parse_voltage(F.lit("-9999"), keep_sentinels=True)) == 9999.0
    for text, want in (("12.5 m", 12.5), ("-9999", None), ("abc", None), (None, None), ("$1,200", 1200.0)):
        assert one(spark, clean.parse_numeric(F.lit(text))) == want, text
    assert [one(spark, clean.falsy_to_null(F.lit(x))) for x in (0, "", "a", 5)] == [None, None, "a", 5]
    assert one(spark, clean.guarded_number(F.lit("12a5"))) is None
    assert one(spark, clean.voltage_class(F.lit(0.0))) == "Unknown"
    assert one(spark, clean.file_size(F.lit(1536))) == "1.5 KB" and one(spark, clean.duration(F.lit(3_725_000))) == "1h 2m 5s"
    assert one(spark, clean.table_name(F.lit(" My Layer (2)! "))) == "my_layer_2"


def test_extract(spark):
    for text, want in (
        ("123 Main St, Wilmington, DE 19801", ("Wilmington", "DE", "19801")),
        ("456 Tech Dr, Newark, Delaware 19702", ("Newark", "Delaware", "19702")),
        ("789 Data Center Blvd, CA", (None, "CA", None)),
    ):
        assert tuple(one(spark, extract.parse_address(F.lit(text)))) == want
    at = lambda html: one(spark, extract.coordinates(F.lit(html)))
    assert tuple(at("var lat = 40.7128; var longitude = -74.0060;")) == (40.7128, -74.006)
    assert tuple(at('<div data-lat="39.6837" data-lng="-75.7497"></div>')) == (39.6837, -75.7497)
    assert tuple(at("https://maps/@39.7391,-75.5398,15z")) == (39.7391, -75.5398) and at("nothing") is None
    page = """<title>X | Y</title><h1>Delaware Data Center 1</h1><div class="address">123 Main St, Wilmington, DE 19801</div><script>var lat = 39.7391; var lng = -75.5398;</script>"""
    got = one(spark, extract.facility_details(F.lit(page), F.lit("https://e.org/usa/de/x/dc-1/")))
    assert (got["name"], got["parts"]["state"], got["parts"]["postal_code"], got["at"]["lat"]) == ("Delaware Data Center 1", "DE", "19801", 39.7391)
    bare = one(spark, extract.facility_details(F.lit("<p>no name</p>"), F.lit("https://e.org/usa/de/x/my-site/")))
    assert bare["name"] == "My Site" and bare["address_full"] is None
    links = """<a href="/usa/">USA</a><a href="/usa/delaware/">Delaware</a><a href="/usa/delaware/newark/">Newark</a><a href="/usa/delaware/newark/dc-one/">DC One</a><a href="/quote/usa/delaware/newark/x">Q</a>"""
    assert [x["text"] for x in one(spark, extract.state_links(F.lit(links)))] == ["Delaware", "Newark", "DC One", "Q"]
    assert [x["text"] for x in one(spark, extract.city_links(F.lit(links), F.lit("delaware")))] == ["Newark", "DC One", "Q"]
    assert [x["text"] for x in one(spark, extract.facility_links(F.lit(links), F.lit("Delaware"), F.lit("Newark")))] == ["DC One"]
    cards = """<div class="ui card"><div class="header">DC A</div><p>Acme</p><p>1 Road</p><p>19801 Wilmington</p><a href="/usa/de/w/a/">x</a></div><div class="ui card"><div class="header">Advertisement</div><p>a</p><p>b</p></div>"""
    got = one(spark, extract.facility_cards(F.lit(cards)))
    assert [(c["name"], c["operator"], c["street"], c["postal_city"], c["href"]) for c in got] == [("DC A", "Acme", "1 Road", "19801 Wilmington", "/usa/de/w/a/")]
    assert [one(spark, extract.is_sponsor_link(F.lit(u))) for u in ("https://a/sponsor/x", "https://a?utm_source=b", "https://a/partner", "https://a/usa/", "https://b/c")] == [True, True, True, False, False]
    assert one(spark, extract.listing_id_of(F.lit("https://x?sg=6406"))) == "6406" and one(spark, extract.listing_id_of(F.lit("/salegroup/12"))) == "12"
    best = F.array(*[F.struct(F.lit(h).alias("href"), F.lit(t).alias("text")) for h, t in (("a.zip", "maps"), ("b", "GIS data"), ("c", "GIS WGS84"), ("d", "gis wgs84"))])
    assert one(spark, extract.best_gis_link(best)) == "c"
    data = '<script id="__NEXT_DATA__" type="application/json">{"props":{"name":"N &amp; M"}}</script>'
    assert one(spark, extract.decode_entities(extract.next_data(F.lit(data), "$.props.name"))) == "N & M"
    assert one(spark, extract.script_field(F.lit('{\\"city\\":\\"Newark\\"}'), "city")) == "Newark"
    assert one(spark, extract.resolve_url(F.lit("x/y"), F.lit("https://a.org/b/c"))) == "https://a.org/b/x/y"
    assert [one(spark, extract.discovery_link(F.lit(p))) for p in ("/abc-def/", "/abc", "/a-b/c", "/a-b?x")] == [True, False, False, False]


def test_match(spark):
    assert one(spark, match.normalise_name(F.lit("Green Plains Co., LLC (Ethanol Plant)"))) == "GREEN PLAINS"
    assert [one(spark, match.parse_thousands(F.lit(t))) for t in ("197,928", "---", "")] == [197928, None, None]
    score = lambda *a: one(spark, match.match_score(*map(F.lit, a)))
    assert score("GREEN PLAINS", "YORK", "GREEN PLAINS YORK", "YORK") == 50 + 30 + 20 + 15
    assert score("", "ALPHA", "ANY", "BETA") == 50


def test_simplify(spark):
    line = [(0.0, 0.0), (1.0, 0.001), (2.0, 0.0), (3.0, 5.0), (4.0, 0.0)]
    rows = spark.createDataFrame([([{"x": x, "y": y} for x, y in line],), (None,)], f"line {simplify.POINTS}")
    for f in (simplify.simplify_area("line", 0.01), simplify.simplify_distance("line", 0.1)):
        got = [r["x"] and [(p["x"], p["y"]) for p in r["x"]] for r in rows.select(f.alias("x")).collect()]
        assert got == [[line[0], *line[2:]], None]


def test_areas_of_rings_are_evaluated_once(spark):
    rings = F.array(*[F.array(*[geo.point(F.col("id") * 0.0 + x, F.lit(0.0) + y) for x, y in ring]) for ring in ([(0, 0), (2, 0), (2, 2), (0, 0)], [(1, 0), (2, 0), (2, 1), (1, 0)])])
    rows = spark.range(2).select(geo.polygon_acres(rings).alias("acres"))
    assert rows._jdf.queryExecution().analyzed().toString().upper().count("SIN(") == 2
    assert rows.select(F.countDistinct("acres"), F.min("acres")).head()[0] == 1
