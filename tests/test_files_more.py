"""Sources at their edges, versions of streams, nearest points by the pyramid, matching by distinct texts."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from gridlode.functions import clean, extract, geo, match
from gridlode.operators import shared, spatial
from gridlode.sources import detect, files
from gridlode.streaming import sightings


def test_features_cut_by_many_tasks(spark, tmp_path):
    features = [{"type": "Feature", "properties": {"n": i, "note": 'a "Feature" of a {brace}, ] and more'}, "geometry": {"type": "Point", "coordinates": [i, -i / 2]}} for i in range(200)]
    for sep, name in ((None, "a"), ((",", ":"), "b"), ((" , ", " : "), "c")):
        (tmp_path / f"{name}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, separators=sep))
    (tmp_path / "d.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": []}))
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for size in ("900", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = files.read_features(spark, str(tmp_path), split=True)
            rows = got.select(F.get_json_object("properties", "$.n").cast("int").alias("n"), F.get_json_object("properties", "$.note").alias("t"), "kind", "coordinates").collect()
            assert sorted(r["n"] for r in rows) == sorted([*range(200)] * 3) and {r["kind"] for r in rows} == {"Point"}
            assert {r["t"] for r in rows} == {features[0]["properties"]["note"]} and all(json.loads(r["coordinates"]) == [r["n"], -r["n"] / 2] for r in rows)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert files.read_features(spark, str(tmp_path)).count() == 600
    # a feature needn't begin with its type any more
    (tmp_path / "e.geojson").write_text('{"features":[{"geometry":null,"type":"Feature"}],"type":"FeatureCollection"}')
    assert files.read_features(spark, str(tmp_path), split=True).count() == 601


def test_sheets(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Title\nmore\nID,Name\n1,"a ""b"", c"\n2,\nbad\n3,x,y\n')
    (tmp_path / "b.csv").write_text("Title\nmore\nName,Key,Extra\nz,9,e\n")
    got = files.read_sheets(spark, str(tmp_path), {"id": ["ID", "Key"], "name": ["Name"]}, skip=2)
    assert sorted((r["id"], r["name"]) for r in got.collect()) == [("1", 'a "b", c'), ("2", None), ("9", "z")]
    assert files.split_lines(spark.createDataFrame([("a|b",), ("c",)], "value string"), ["x", "y"], "|").collect()[1]["y"] is None


def test_encodings_of_bytes(spark, tmp_path):
    text = "Größe,Länge\n" + "1,2\n" * 5000
    for encoding, want in (("utf-8", "utf8"), ("utf-16", "utf16le"), ("latin-1", "latin1"), ("utf-8-sig", "utf8")):
        path = tmp_path / f"{encoding}.csv"
        path.write_bytes(text.encode(encoding))
        found = detect.detect(spark, str(path))
        assert (found["encoding"], found["headers"], found["kind"]) == (want, ["Größe", "Länge"], "csv") and abs(found["estimate"] - 5000) < 100
    (tmp_path / "one.json").write_text('{"type":"FeatureCollection","features":[' + ",".join('{"type":"Feature","geometry":null}' for _ in range(9000)) + "]}")
    assert detect.detect(spark, str(tmp_path / "one.json"))["estimate"] == pytest.approx(9000, rel=0.05)
    assert shared.exists(spark, str(tmp_path)) and not shared.exists(spark, str(tmp_path / "none")) and shared.head_bytes(spark, str(tmp_path / "one.json"), 5) == b'{"typ'


def test_a_lost_version_is_an_error(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x")], "k string, t int, v string")
    with pytest.raises(Exception):
        sightings.fold(str(tmp_path / "seen"), ["k"], ["v"], "t")(rows, 3)
    (tmp_path / "table").mkdir()
    with pytest.raises(Exception):
        files.static_or(spark, str(tmp_path / "table"), lambda: rows).collect()
    run = sightings.fold(str(tmp_path / "seen"), ["k"], ["v"], "t")
    for batch in (0, 1, 2, 2):
        run(rows, batch)
    assert sorted(p.name for p in (tmp_path / "seen").iterdir() if p.name.startswith("v=")) == ["v=1", "v=2"]


def test_nearest_by_the_pyramid(spark):
    r = random.Random(4)
    points = [(i, r.uniform(-120, -70), r.uniform(25, 49)) for i in range(400)] + [(900, 10.0, -40.0), (901, 10.0, -40.0), (902, None, 1.0)]
    sites = [(i, r.uniform(-180, 180), r.uniform(-90, 90)) for i in range(300)] + [(i, *points[i - 300][1:]) for i in range(300, 360)] + [(999, None, 3.0)]
    tree = spatial.Pyramid(spark.createDataFrame(points, "p long, plon double, plat double"), "plon", "plat", ["p"])
    got = {x["s"]: x for x in tree.nearest(spark.createDataFrame(sites, "s long, lon double, lat double"), "s", ["p"]).collect()}
    assert len(got) == 360
    for s, lon, lat in sites[:-1]:
        want = min((math.dist((lon, lat), (x, y)), p) for p, x, y in points if x is not None)
        assert (got[s]["distance"], got[s]["p"]) == (pytest.approx(want[0], abs=1e-9), want[1]), s


def test_matching_distinct_texts_is_matching_all(spark):
    r = random.Random(2)
    names = ["GREEN PLAINS", "PLAINS", "BIG RIVER", "RIVER BEND MILL", "", "ACME", "YORK"]
    companies = [(i, r.choice(names), r.choice(names), r.choice(["Iowa", "IA", None, "ne"])) for i in range(120)]
    facilities = [(i, r.choice(names), r.choice(names), r.choice(["IOWA", "NE", "", None])) for i in range(60)]
    c, f = spark.createDataFrame(companies, "id long, company string, site string, state string"), spark.createDataFrame(facilities, "fid long, facility string, city string, state string")

    def points(company, site, facility, city):
        within = lambda a, b: a in b or b in a
        words = lambda t: [w for w in t.split(" ") if len(w) > 2]
        total = 50 * within(company, facility) + 30 * within(site, city)
        total += sum(10 if a == b else 5 if within(a, b) else 0 for a in words(company) for b in words(facility))
        return total + sum(15 for a in words(site) for b in words(city) if a == b)

    up = lambda s: (s or "").upper()
    want = set()
    for i, company, site, state in companies:
        met = [(-points(company, site, x, y), fid) for fid, x, y, s in facilities if up(s) in up(state) or up(state)[:2] in up(s)]
        if met and -min(met)[0] >= 25:
            want.add((i, min(met)[1], -min(met)[0]))
    assert {tuple(x) for x in match.best_facilities(c, f).collect()} == want and len(want) > 50


def test_links_once_and_cards_without_end(spark):
    one = lambda column: spark.range(1).select(column.alias("x")).head()["x"]
    links = '<a href="/usa/texas/town/a/">A</a><a href="/usa/texas/town/a/">B</a><a href="/usa/texas/town/c/">C</a>'
    assert [a["text"] for a in one(extract.facility_links(F.lit(links), F.lit("Texas"), F.lit("Town")))] == ["A", "C"]
    cards = spark.range(1).select(F.repeat(F.lit('<div class="ui card"><div class="header">N</div><p>o</p><p>s</p></div>'), 3000).alias("h"))
    assert cards.select(F.size(extract.facility_cards("h")).alias("n")).head()["n"] == 3000
    assert one(clean.line_width(F.lit(100.0), 2.0)) == 0.8 and one(clean.line_width(F.lit(None).cast("double"), 9.0)) == 1.0
    lon, lat = geo.wkt_to_lonlat(F.lit("POINT(-100.5 40.25)"))
    assert (one(lon), one(lat)) == (-100.5, 40.25)


def test_numbers_of_points_are_parsed_once(spark):
    rows = spark.createDataFrame([("1.5", "2.5", "10", "-9999"), ("95", "1", "2", "3")], "Latitude string, Longitude string, Depth_ft string, Temperature_C string")
    good, bad = files.points_from_csv(rows)
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 2 and "Filter" in plan.split("Generate")[0] and "Filter" not in plan.rpartition("Generate")[2]
    assert good.count() == 1 and bad.count() == 1
