"""CSV and GeoJSON files cut into small byte ranges give the rows of the whole files."""

import csv
import io
import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlode.sources import csv_records, detect, files, geojson_records, sinks


@pytest.fixture
def ranges(spark):
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", f"{size}b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")

    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


NAMES = ["id", "name", "note"]


def table(n=300, seed=1, plain=False):
    r = random.Random(seed)
    hard = ["", "a,b", 'say "hi"', "two\nlines", "dos\r\nlines", '"', "é ä", "ਊĀ ఊ", "long " * 60 + "\n" * 5 + "x", '",\n"', "last\n"]
    out = [(str(i), f"n{i}", r.choice(["plain", "also plain"] if plain else hard)) for i in range(n)]
    return out


def text_of(rows, end="\n"):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerows([NAMES, *rows])
    return out.getvalue()


def got(df):
    return sorted(tuple(r) for r in df.select(*NAMES).collect())


def want(rows):
    return sorted(tuple(v or None for v in r) for r in rows)


@pytest.mark.parametrize("size", [97, 700, 10_000_000])
@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16-le", "utf-16-be", "latin-1"])
def test_quoted_line_breaks(spark, ranges, tmp_path, size, encoding):
    rows = [tuple(v.replace("ਊĀ ఊ", "ü") if encoding == "latin-1" else v for v in r) for r in table(40)]
    text = text_of(rows)
    mark = "﻿" if encoding.startswith("utf-16") else ""
    (tmp_path / "a.csv").write_bytes((mark + text).encode(encoding))
    (tmp_path / "b.csv").write_bytes((mark + text_of(rows[:7])).encode(encoding))
    ranges(size)
    df = files.read_csv(spark, str(tmp_path))
    assert df.columns == NAMES and got(df) == want(rows + rows[:7])
    assert df.count() == len(rows) + 7


def test_line_ends_and_blank_lines(spark, ranges, tmp_path):
    rows = table(60)
    (tmp_path / "a.csv").write_text(text_of(rows, "\r\n") + "\r\n\r\n", newline="")
    ranges(150)
    assert got(files.read_csv(spark, str(tmp_path))) == want(rows)


def test_plain_files_take_sparks_reader(spark, tmp_path):
    rows = table(50, plain=True) + [("50", "x", "a,b"), ("51", 'plain "quote', "y")]
    (tmp_path / "a.csv").write_text(text_of(rows[:-1]) + '51,plain "quote,y\n')
    df = files.read_csv(spark, str(tmp_path))
    assert got(df) == want(rows) and "FileScan csv" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("breaks", [False, True])
def test_strict_under_column_pruning(spark, tmp_path, breaks):
    extra = '9,"two\nlines",z\n' if breaks else ""
    (tmp_path / "a.csv").write_text("id,name,note\n1,a,b\n2,a\n3,a,b,c\n4,d,e\n" + extra)
    df = files.read_csv(spark, str(tmp_path), strict=True)
    n = 3 if breaks else 2
    assert df.count() == n and df.select("id").count() == n and sorted(r["id"] for r in df.select("id").collect()) == ["1", "4", "9"][:n]
    loose = files.read_csv(spark, str(tmp_path))
    assert loose.count() == n + 2 and loose.where("id = '2'").head()["note"] is None


def test_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"first, name",B,b,\n"x\ny",2,3,4\n')
    df = files.read_csv(spark, str(tmp_path))
    assert df.columns == ["first, name", "B1", "b2", "_c3"] and [tuple(r) for r in df.collect()] == [("x\ny", "2", "3", "4")]
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "empty.csv").write_text("")
    assert files.read_csv(spark, str(tmp_path / "e")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text('a",\n', max_size=6), min_size=1, max_size=4))
def test_ends_quoted_follows_the_writer(fields):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerow(fields)
    lines = out.getvalue()[:-1].split("\n")
    quoted = False
    for i, line in enumerate(lines):
        quoted = csv_records.ends_quoted(line.encode(), quoted)
        assert quoted == (i < len(lines) - 1)


# GeoJSON


def feature(i, r):
    props = {"id": i, "text": r.choice(["Feature", '"type":"Feature"', "}{][", 'a "quoted" }', "\\", "é", "}" * 9, "", '\\"', "features"]), "deep": {"features": [{"type": "Feature"}]}}
    parts = {"type": "Feature", "properties": props, "geometry": {"type": "Point", "coordinates": [i, -i]}}
    keys = list(parts)
    r.shuffle(keys)
    return {k: parts[k] for k in keys}


def shapes(seed=2):
    r = random.Random(seed)
    many = [feature(i, r) for i in range(30)]
    others = {"type": "FeatureCollection", "other": [{"type": "Feature", "properties": {"no": 1}}], "meta": {"features": [{"a": 1}]}, "name": "features"}
    return {
        "collection": json.dumps({"type": "FeatureCollection", "features": many}),
        "late": json.dumps({**others, "features": many, "after": [{"b": 2}], "more": "}"}, indent=1),
        "list": " " + json.dumps(many, separators=(",", ":")),
        "one": json.dumps(many[3], indent=2),
        "bare": json.dumps({"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}),
        "none": json.dumps({"type": "FeatureCollection", "features": []}),
        "collection unicode": json.dumps({"features": many, "type": "FeatureCollection"}, ensure_ascii=False) + "\n\n",
    }


@pytest.mark.parametrize("size", [333, 5000, 10_000_000])
def test_features_by_structure(spark, ranges, tmp_path, size):
    for name, text in shapes().items():
        (tmp_path / f"{name}.geojson").write_text(text)
    rows = lambda df: sorted((r["file"].rpartition("/")[2], json.dumps(r["properties"] and json.loads(r["properties"]), sort_keys=True), r["kind"], r["coordinates"]) for r in df.collect())
    whole = rows(files.read_features(spark, str(tmp_path)))
    ranges(size)
    split = rows(files.read_features(spark, str(tmp_path), split=True))
    assert len(whole) == 4 * 30 + 2 and split == whole


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_summaries_compose(data):
    """However a file is cut into ranges, the state at their ends is that of the whole."""
    text = data.draw(st.sampled_from(sorted(shapes().values(), key=len)[:5])).encode()[:600]
    pieces = text.split(b"}")
    cuts = sorted(data.draw(st.sets(st.integers(1, len(pieces)), max_size=4)))
    whole = geojson_records.Summary(0)
    for p in pieces:
        whole.push(p)
    state, at = geojson_records.FIRST, 0
    for cut in [*cuts, len(pieces)]:
        part = geojson_records.Summary(at)
        for p in pieces[at:cut]:
            part.push(p)
        state, at = geojson_records.step(state, part.plain()), cut
    assert state == geojson_records.step(geojson_records.FIRST, whole.plain())


@pytest.mark.parametrize("charset, name", [("UTF-8", "utf8"), ("UTF-16", "utf16be"), ("ISO-8859-1", "latin1")])
def test_first_part_without_rows(spark, tmp_path, charset, name):
    """A table's first part may hold headers only, or nothing: what it is shows in the others."""
    rows = spark.range(0, 40, 1, 4).where("id >= 10").selectExpr("cast(id as string) as id", "'é' as name", "concat('two\n', id) as note")
    sinks.write_csv(rows, str(tmp_path / "a"), charset)
    (tmp_path / "a" / "part-0").write_bytes(b"")
    found = files.read_csv(spark, str(tmp_path / "a"))
    assert detect.detect(spark, str(tmp_path / "a"))["encoding"] == name
    assert got(found) == sorted((str(i), "é", f"two\n{i}") for i in range(10, 40))


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text('a",', max_size=9), min_size=1, max_size=40))
def test_surely_closed_lines_are_closed(spark, lines):
    rows = spark.createDataFrame([(x,) for x in lines], "value string").select("value", csv_records.closes(F.col("value")).alias("sure")).collect()
    assert all(not (r["sure"] and csv_records.ends_quoted(r["value"].encode(), False)) for r in rows)


def test_closed_quotes_go_to_no_python(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(csv_records, "start_states", None)
    (tmp_path / "a.csv").write_text('id,name,note\n1,"say ""x"", ok",""\n2,"a,b","""q"""\n3,c,d\n')
    assert got(files.read_csv(spark, str(tmp_path))) == [("1", 'say "x", ok', None), ("2", "a,b", '"q"'), ("3", "c", "d")]


@settings(max_examples=100, deadline=None)
@given(st.data())
def test_elements_of_any_batches(data):
    """Pieces come one by one or many together: the same elements, which are those of the parsed text."""
    name, text = data.draw(st.sampled_from(sorted(shapes().items())))
    pieces = text.encode().split(b"}")
    whole = geojson_records.Summary(0)
    whole.push_all(pieces)
    last = geojson_records.step(geojson_records.FIRST, whole.plain())
    cuts = [0, *sorted(data.draw(st.sets(st.integers(1, len(pieces)), max_size=6))), len(pieces)]
    cutter = geojson_records.Elements(geojson_records.FIRST, last)
    found = [raw for a, b in zip(cuts, cuts[1:]) for raw in cutter.push_all(pieces[a:b]) if b > a]
    want = json.loads(text)
    want = want if isinstance(want, list) else want.get("features", [want])
    assert [json.loads(raw) for raw in found] == want


def test_a_collection_file_is_made_by_many_tasks(spark, tmp_path):
    rows = spark.range(0, 40, 1, 4).select(F.format_string('{"type":"Feature","properties":{"id":%d,"task":%d},"geometry":null}', "id", F.spark_partition_id()).alias("value"))
    sinks.write_collection_file(rows, str(tmp_path / "c.geojson"))
    made = [f["properties"] for f in json.loads((tmp_path / "c.geojson").read_text())["features"][1:]]
    assert sorted(f["id"] for f in made) == list(range(40)) and {f["task"] for f in made} == {0, 1, 2, 3}
