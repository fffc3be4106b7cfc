"""An interrupted ingest does only what is left, and every row comes once."""

import pytest
from pyspark.sql import functions as F

from gridlode.operators import shared
from gridlode.operators.versions import ConflictError, Document
from gridlode.sources import ledger as led
from gridlode.sources.ledger import Ledger, ingest


def parse(lines):
    rows = lines.where("value <> '' and value <> 'id,name'")
    return rows.select("_range", F.split("value", ",")[0].cast("long").alias("id"), F.split("value", ",")[1].alias("name"))


@pytest.fixture
def files(tmp_path):
    (tmp_path / "in").mkdir()
    for f in range(3):
        (tmp_path / "in" / f"f{f}.csv").write_text("id,name\n" + "".join(f"{1000 * f + i},name{i}\r\n" for i in range(300)))
    return str(tmp_path / "in")


@pytest.fixture
def ledger(spark):
    return Ledger(spark, shared.fresh_path(spark, "ledger"))


SCHEMA = "id long, name string"
SIZE = 1024
WANT = [1000 * f + i for f in range(3) for i in range(300)]


def ids(spark, ledger):
    schema = spark.createDataFrame([], SCHEMA).schema
    return sorted(r["id"] for r in ledger.output(schema).collect())


def test_a_run_that_stops_is_gone_on_with(spark, files, ledger, monkeypatch):
    assert ingest(spark, files, ledger, parse, SIZE, batch=4, most=1) == 4
    some = ids(spark, ledger)
    assert 0 < len(some) < 900 and len(ledger.progress()) >= 1 and not any(p["done"] for p in ledger.progress()[1:])

    plain = Document.publish

    def stop(*_):
        raise RuntimeError("out of power")

    monkeypatch.setattr(Document, "publish", stop)
    with pytest.raises(RuntimeError):
        ingest(spark, files, ledger, parse, SIZE, batch=4)
    monkeypatch.setattr(Document, "publish", plain)
    assert ids(spark, ledger) == some
    assert ledger.cleanup() > 0 and ids(spark, ledger) == some
    rest = ingest(spark, files, ledger, parse, SIZE, batch=4)
    assert ids(spark, ledger) == WANT and rest + 4 == len(ledger.entries()) and all(p["done"] and p["rows"] == 300 for p in ledger.progress())
    assert ingest(spark, files, ledger, parse, SIZE) == 0 and ledger.cleanup() == 0
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") != f"{SIZE}b"


def test_changed_and_new_files(spark, files, ledger):
    ingest(spark, files, ledger, parse, SIZE)
    with open(f"{files}/f1.csv", "w") as f:
        f.write("id,name\n5000,x\n")
    with open(f"{files}/g.csv", "w") as f:
        f.write("6000,y\n")
    assert ingest(spark, files, ledger, parse, SIZE) == 2
    assert ids(spark, ledger) == sorted([i for i in WANT if not 1000 <= i < 2000] + [5000, 6000])
    assert ledger.cleanup() > 0 and 5000 in ids(spark, ledger)


def test_damage_is_seen(spark, files, ledger):
    ingest(spark, files, ledger, parse, SIZE)
    schema = spark.createDataFrame([], SCHEMA).schema
    assert ledger.damaged(schema) == []
    lost = ledger.entries()[2]
    shared.remove(spark, f"{ledger.path}/{lost['folder']}")
    assert [e["start"] for e in ledger.damaged(schema)] == [lost["start"]]


def test_two_runs_at_a_time(spark, files, ledger, monkeypatch):
    """The second to publish is told so; nothing comes twice."""
    calls = []

    def twice(lines):
        if not calls:
            calls.append(1)
            assert ingest(spark, files, Ledger(spark, ledger.path), parse, SIZE) > 0
        return parse(lines)

    plain = Document.read
    first = []

    def stale(self, version=None):
        if version is None and not first and calls:
            first.append(1)
            return -1, None
        return plain(self, version)

    with monkeypatch.context() as m:
        m.setattr(Document, "read", lambda self, version=None: plain(self, version))
        assert ingest(spark, files, ledger, twice, SIZE) > 0
    assert ids(spark, ledger) == WANT
    monkeypatch.setattr(Document, "read", stale)
    calls.append(1)
    with open(f"{files}/h.csv", "w") as f:
        f.write("7000,z\n")
    with pytest.raises(ConflictError):
        ingest(spark, files, ledger, parse, SIZE)
    monkeypatch.setattr(Document, "read", plain)
    assert ids(spark, ledger) == WANT


def test_empty_folder_and_forgetting(spark, tmp_path, ledger):
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "empty.csv").write_text("")
    assert ingest(spark, str(tmp_path / "none"), ledger, parse) == 0 and ids(spark, ledger) == []
    (tmp_path / "none" / "blank.csv").write_text("\n\n")
    assert ingest(spark, str(tmp_path / "none"), ledger, parse) == 1 and ids(spark, ledger) == []
    ledger.forget()
    assert ledger.entries() == [] and led.BATCH > 1


def test_small_ranges_are_done_together(spark, files, ledger, monkeypatch):
    """A job goes over all ranges of its files, so many batches of small ranges must not be as many jobs."""
    published = []
    plain = Document.publish
    monkeypatch.setattr(Document, "publish", lambda self, version, content: published.append(len(content["ranges"])) or plain(self, version, content))
    assert ingest(spark, files, ledger, parse, SIZE, batch=1, most=2) == 2
    monkeypatch.setattr(led, "TOGETHER", 5 * SIZE)
    rest = ingest(spark, files, ledger, parse, SIZE, batch=1)
    assert published[0] == 2 and published[1:-1] == [5] * (rest // 5) and ids(spark, ledger) == WANT
