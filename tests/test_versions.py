"""Keyed tables on disk: replayed sightings, interrupted and concurrent writes, touched buckets, vacuum."""

import threading

import pytest
from pyspark.sql import functions as F

from gridlode.operators import shared, upsert, versions
from gridlode.operators.versions import ConflictError, Document, KeyedTable
from gridlode.sources import sinks

SCHEMA = "source string, source_url string, name string, first_seen_at timestamp, last_seen_at timestamp"


def seen(spark, rows):
    return spark.createDataFrame(rows, "source string, source_url string, name string, at string").withColumn("at", F.col("at").cast("timestamp"))


def merge_sightings(had, came):
    return upsert.merge_seen(had, came, ["source", "source_url"], ["name"], "at")


@pytest.fixture
def table(spark):
    schema = spark.createDataFrame([], SCHEMA).schema
    made = KeyedTable.create(spark, shared.fresh_path(spark, "keyed"), schema, ["source", "source_url"], 8)
    made.merge(seen(spark, [("s", f"u{i}", f"n{i}", "2024-01-01") for i in range(40)]), merge_sightings)
    return made


def rows(df):
    return {r["source_url"]: (r["name"], str(r["first_seen_at"])[:10], str(r["last_seen_at"])[:10]) for r in df.collect()}


def test_first_seen_stays_and_last_seen_moves(spark, table):
    version = table.merge(seen(spark, [("s", "u3", "new name", "2024-02-02"), ("s", "u99", "n99", "2024-02-02")]), merge_sightings)
    got = rows(table.read())
    assert version == 2 and len(got) == 41
    assert got["u3"] == ("new name", "2024-01-01", "2024-02-02") and got["u99"] == ("n99", "2024-02-02", "2024-02-02") and got["u4"] == ("n4", "2024-01-01", "2024-01-01")
    assert len(rows(table.read(1))) == 40 and rows(table.read(1))["u3"][0] == "n3"
    # an older sighting changes neither name nor last time
    table.merge(seen(spark, [("s", "u3", "older", "2023-05-05")]), merge_sightings)
    assert rows(table.read())["u3"] == ("new name", "2023-05-05", "2024-02-02")


def test_only_touched_buckets_are_written(spark, table):
    before = table._state()[1]["folders"]
    table.merge(seen(spark, [("s", "u3", "x", "2024-02-02")]), merge_sightings)
    after = table._state()[1]["folders"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1


def test_interrupted_writes_change_nothing(spark, table, monkeypatch):
    def stop(*_):
        raise RuntimeError("the power is out")

    plain = Document.publish
    monkeypatch.setattr(Document, "publish", stop)
    with pytest.raises(RuntimeError):
        table.merge(seen(spark, [("s", "u3", "lost", "2024-02-02")]), merge_sightings)
    with pytest.raises(RuntimeError):
        table.replace(spark.createDataFrame([], SCHEMA))
    monkeypatch.setattr(Document, "publish", plain)
    assert len(rows(table.read())) == 40 and rows(table.read())["u3"][0] == "n3" and [h["what"] for h in table.history()] == ["create", "merge"]
    table.vacuum(1)
    assert len(rows(table.read())) == 40 and len(shared.list_names(spark, f"{table.path}/data")) == 1


def test_a_writer_that_comes_second_does_its_change_again(spark, table):
    """Another write lands between reading and publishing."""
    other = KeyedTable(spark, table.path)
    calls = []

    def slow(had, came):
        calls.append(1)
        if len(calls) == 1:
            other.merge(seen(spark, [("s", "u3", "other", "2024-03-03")]), merge_sightings)
        return merge_sightings(had, came)

    assert table.merge(seen(spark, [("s", "u3", "mine", "2024-02-02"), ("s", "u5", "mine", "2024-02-02")]), slow) == 3
    got = rows(table.read())
    assert len(calls) == 2 and got["u3"] == ("other", "2024-01-01", "2024-03-03") and got["u5"][0] == "mine"


def test_writers_side_by_side_lose_nothing(spark, table):
    errors = []

    def write(k):
        try:
            KeyedTable(spark, table.path).merge(seen(spark, [("s", f"w{k}-{i}", "n", "2024-02-02") for i in range(5)]), merge_sightings)
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and len(rows(table.read())) == 60 and len(table.history()) == 6


def test_null_keys_delete_and_replace(spark, table):
    table.merge(seen(spark, [(None, None, "nobody", "2024-01-01")]).drop("at").withColumns({"first_seen_at": F.lit(None).cast("timestamp"), "last_seen_at": F.lit(None).cast("timestamp")}), lambda had, came: had.unionByName(came))
    assert table.read().where("source is null").count() == 1
    table.delete(spark.createDataFrame([(None, None), ("s", "u1"), ("s", "none")], "source string, source_url string"))
    assert table.read().count() == 39 and "u1" not in rows(table.read())
    table.replace(table.read(0))
    assert table.read().count() == 0 and table.merge(seen(spark, []), merge_sightings) == 5
    with pytest.raises(ConflictError):
        KeyedTable.create(spark, table.path, table.read().schema, ["source"])
    with pytest.raises(FileNotFoundError):
        KeyedTable(spark, table.path + "-none").read()


def test_old_versions_go(spark, table):
    for i in range(4):
        table.merge(seen(spark, [("s", f"u{i}", "x", "2024-02-02")]), merge_sightings)
    whole = rows(table.read())
    table.vacuum(2)
    assert table.document.versions() == [4, 5] and rows(table.read()) == whole and len(rows(table.read(4))) == 40


def test_manifest_keeps_the_entries_of_others(spark):
    folder = shared.fresh_path(spark, "cache")
    names = [f"layer{i}" for i in range(5)]
    threads = [threading.Thread(target=sinks.save_cache, args=(spark.range(3), folder, n, "2024-05-06")) for n in names]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(sinks.read_manifest(spark, folder)["sources"]) == names
    sinks.save_cache(spark.range(7), folder, "layer2", "2024-06-06", 4000.0)
    entry = sinks.read_manifest(spark, folder)["sources"]["layer2"]
    assert entry["featureCount"] == 7 and entry["dataVersion"] == "20240606" and entry["defaultDepth"] == 4000.0
    assert sinks.cached_or(spark, folder, "layer2", None).count() == 7 and sinks.cached_or(spark, folder, "none", lambda: spark.range(1)).count() == 1


def test_names_are_taken_once(spark):
    path = f"{shared.fresh_path(spark, 'once')}/a.json"
    assert shared.write_once(spark, path, b"1") and not shared.write_once(spark, path, b"2")
    assert shared.read_bytes(spark, path) == b"1" and versions.TRIES > 1
