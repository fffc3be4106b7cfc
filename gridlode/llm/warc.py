"""Writing WARC archives and a splittable reader of them.

Archives are files of gzip members, one WARC record each, written by Spark's text writer: its line separator is
a whole empty gzip member, so that any gzip tool reads the files, and any store that Spark writes to will do.

The reader never opens a file itself. Spark deals out byte ranges of the files (spark.sql.files.maxPartitionBytes)
and its line reader, with the gzip magic as separator, scans a range for the magic and hands a task what starts
inside its range. A candidate is a member if its header has no reserved flags, its deflate stream decodes and a WARC
version line comes out. The magic can occur by chance inside a member: then the pieces are put together again,
within a task, or, for a member that runs past the end of a range, from the fragments of the ranges that follow.

Defined results: a null page is an empty payload; of equal payloads of at least LEAST bytes the row with the
smallest page_id (null last; of repeated rows one) is the response and the others revisit it; smaller ones are all
responses; null urls have no target; an empty table gives an empty result; other columns are ignored. A member may hold
several records; archives that aren't compressed raise an error, as does a member that breaks off inside a record.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, fresh_path, join_counted, join_small, with_row_id
from .hashing import column, pieces

LEAST = 100
#: A task holds about so many bytes of records at a time, or one record.
HELD = 8 << 20
MAGIC = b"\x1f\x8b\x08"
_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*([0-9]+)[ \t]*\r\n", re.I)
#: A gzip member of no bytes.
EMPTY = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(row: int) -> str:
    """Pages may have no id or share one; rows have numbers of their own."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'row:{row}')}>"


def member(row: int, page, url: str | None, payload: bytes, digest: str, refers, refers_row, revisit: bool, date: str = DATE) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(row)}", f"WARC-Date: {date}"]
    if page is not None:
        lines.append(f"WARC-Page-ID: {page}")
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_row)}"]
        if refers is not None:
            lines.append(f"WARC-Refers-To-Page-ID: {refers}")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + press.flush()


def parse(raw: bytes) -> tuple[dict, bytes]:
    """Headers (names in lower case) and block of an uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    return headers, rest[: int(headers.get("content-length", len(rest)))]


def records_of(member: bytes) -> list[bytes]:
    """The records of an inflated member, by their Content-Length; ValueError if the last one breaks off."""
    out, at = [], 0
    while at < len(member):
        head = member.find(b"\r\n\r\n", at)
        found = _LENGTH.search(member, at, head + 2) if head >= 0 else None
        if not found or not member.startswith(b"WARC/", at):
            raise ValueError("a member holds something that is no record, or a record without Content-Length")
        end = head + 4 + int(found[1])
        if end > len(member):
            raise ValueError("a record breaks off")
        out.append(member[at:end])
        at = end
        while member.startswith(b"\r\n", at):
            at += 2
    return out


def write_warc(pages: DataFrame, path: str) -> None:
    """Writes pages (_rid, page_id, url, payload string, digest, refers, refers_row, revisit) as archives in the folder path."""
    fields = ["_rid", "page_id", "url", "payload", "digest", "refers", "refers_row", "revisit"]

    def run(batches):
        for part in pieces(batches, text="payload"):
            rows = zip(*(column(part, c).to_pylist() for c in fields))
            yield pa.RecordBatch.from_arrays([pa.array([member(i, p, u, t.encode(), *rest) for i, p, u, t, *rest in rows], pa.binary())], ["member"])

    members = pages.select(*fields).mapInArrow(run, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")).text(path)


class Joiner:
    """Makes records of the pieces between magics, in their order."""

    def __init__(self):
        self.stream, self.out, self.raw = None, b"", b""

    def push(self, piece: bytes) -> bytes | None:
        """The record that a piece completes, if any. An unfinished member stays in raw, else raw is empty."""
        data = MAGIC + piece
        if self.stream is not None:  # an unfinished member: this magic may be part of it
            found = self._feed(data)
            if found is not False:
                return found
        if len(piece) < 7 or piece[0] & 0xE0:
            self.stream, self.raw = None, b""
            return None
        self.stream, self.out, self.raw = zlib.decompressobj(31), b"", b""
        return self._feed(data) or None

    def _feed(self, data: bytes) -> bytes | None | bool:
        """False if data can't follow; else the record if it is complete, or None."""
        try:
            self.out += self.stream.decompress(data)
        except zlib.error:
            self.out = b"no record"
        if not b"WARC/".startswith(self.out[:5]):
            self.stream, self.raw = None, b""
            return False
        self.raw += data
        if not self.stream.eof:
            return None
        self.stream, self.raw = None, b""
        return self.out or None


def _scan(batches):
    """Rows (file, start, piece) in the order of a range -> its records, and the fragments of others at its ends.

    Fragments are all pieces before the first record of a range, and what an unfinished member has at its end.
    """
    at, joiner, seq, found_any = None, Joiner(), 0, False
    names, kinds = ["kind", "file", "start", "seq", "raw"], (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    rows = lambda found: pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found), kinds)], names)
    for batch in batches:
        found, held = [], 0
        for file, start, piece in zip(column(batch, "file").to_pylist(), column(batch, "start").to_pylist(), column(batch, "piece").to_pylist()):
            if (file, start) != at:
                if found_any and joiner.raw:
                    found.append(("tail", *at, seq, joiner.raw))
                at, joiner, seq, found_any = (file, start), Joiner(), 0, False
                if start == 0:  # what comes before the first magic
                    if piece:
                        raise ValueError(f"{file} isn't compressed by members")
                    continue
            record = joiner.push(piece)
            if record:
                found += [("record", file, start, seq, r) for r in records_of(record)]
                found_any = True
            elif not found_any:
                found.append(("head", file, start, seq, MAGIC + piece))
            seq += 1
            held += len(record or piece)
            if found and held > HELD:
                yield rows(found)
                found, held = [], 0
        if found:
            yield rows(found)
    if found_any and joiner.raw:
        yield rows([("tail", *at, seq, joiner.raw)])


def _rejoin(pdf: pd.DataFrame) -> pd.DataFrame:
    """The fragments of one file -> the records that ran past the end of a range."""
    joiner, out = Joiner(), []
    for raw in pdf.sort_values(["start", "seq"])["raw"]:
        record = joiner.push(raw[len(MAGIC) :])
        if record:
            out += records_of(record)
    return pd.DataFrame({"raw": out}, columns=["raw"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """raw: the uncompressed bytes of each record of the archives in path.

    Their names must not end in .gz: Spark would inflate such files whole, each in one task.
    """
    source = spark.read.format("text").option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1")
    pieces_ = source.load(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("piece"))
    found = pieces_.mapInArrow(_scan, "kind string, file string, start long, seq long, raw binary")
    late = found.where("kind <> 'record'").groupBy("file").applyInPandas(_rejoin, "raw binary")
    return found.where("kind = 'record'").select("raw").unionByName(late)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of every record. Revisits have no payload."""

    def run(batches):
        for batch in pieces(batches, text="raw"):
            out = []
            for raw in column(batch, "raw").to_pylist():
                headers, block = parse(raw)
                http, _, payload = block.partition(b"\r\n\r\n")
                kind = headers.get("warc-type")
                if kind == "response":
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                else:
                    lines = dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:] if b": " in x)
                    size, digest, payload = int(lines.get(b"Content-Length", 0)), headers.get("warc-payload-digest", "").removeprefix("sha256:"), None
                number = lambda name: int(headers[name]) if name in headers else None  # noqa: B023, E731
                out.append((number("warc-page-id"), headers.get("warc-target-uri"), payload, size, digest, kind, number("warc-refers-to-page-id")))
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
            names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            columns = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names)

    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return read_records(spark, path).mapInArrow(run, schema)


def archive_pages(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Writes pages (page_id, url, html) as archives; equal payloads of at least `least` bytes are written once."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    numbered = with_row_id(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))).withColumn("digest", F.sha2("payload", 256))
    large = checkpoint(numbered.where(F.octet_length("payload") >= least).select("_rid", "page_id", "digest"))
    first = F.min(F.struct(F.isnull("page_id").alias("z"), "page_id", "_rid"))
    same = checkpoint(large.groupBy("digest").agg(F.count("*").alias("n"), first.alias("first")).where("n > 1"))
    again = join_counted(large, same, ["digest"]).where("first is not null and _rid <> first._rid")
    again = checkpoint(again.select("_rid", F.col("first.page_id").alias("refers"), F.col("first._rid").alias("refers_row"), F.lit(True).alias("revisit")))
    write_warc(join_small(numbered, again, ["_rid"]).withColumn("revisit", F.coalesce("revisit", F.lit(False))), path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives pages in the shared folder and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    archive_pages(pages, path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, coalesce(html, '') as h, sha256(coalesce(html, '')) as d from pages),
f as (select *, strlen(h) as n, min(page_id) over (partition by h) as first from p)
select page_id, n::bigint as payload_bytes, d as payload_digest,
  case when n >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when n >= 100 and page_id <> first then first end as refers_to
from f
"""
