"""Archives of other writers: several records in a member, plain files, records that break off."""

import gzip

import pytest

from gridlode.llm import warc


def record(k, body, name="Content-Length"):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Page-ID: {k}\r\n{name}: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


BODIES = [b"a" * 50, b"", b"\r\n\r\nWARC/1.0\r\n\r\n" * 3, warc.MAGIC * 4, b"z" * 3000] * 4


@pytest.mark.parametrize("size", ["150", "128m"])
def test_members_of_several_records(spark, tmp_path, size):
    data = [record(k, b, "content-length" if k % 2 else "Content-Length") for k, b in enumerate(BODIES)]
    (tmp_path / "many.warc").write_bytes(gzip.compress(b"".join(data[:3])) + gzip.compress(data[3]) + gzip.compress(b"".join(data[4:11])))
    (tmp_path / "one.warc").write_bytes(gzip.compress(b"".join(data[11:])))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = warc.read_warc(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r["page_id"], bytes(r["payload"])) for r in got) == list(enumerate(BODIES))


@pytest.mark.parametrize(("data", "said"), [(record(1, b"plain"), "isn't compressed"), (gzip.compress(record(1, b"abc")[:-6]), "breaks off"), (gzip.compress(record(1, b"x") + b"rubbish"), "no record")])
def test_what_cannot_be_read_is_an_error(spark, tmp_path, data, said):
    (tmp_path / "a.warc").write_bytes(data)
    with pytest.raises(Exception, match=said):
        warc.read_warc(spark, str(tmp_path)).collect()
