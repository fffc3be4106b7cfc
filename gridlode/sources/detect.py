"""What a file holds, from its name and its first bytes. Only those come to the driver."""

from __future__ import annotations

import codecs

from pyspark.sql import SparkSession

from ..operators.shared import head_bytes

# Kinds by the ends of names, and the words of GeoJSON.
KINDS = {".csv": "csv", ".tsv": "csv", ".txt": "csv", ".geojson": "geojson", ".json": "geojson"}
GEOJSON_WORDS = ('"type"', '"FeatureCollection"', '"Feature"', '"geometry"', '"coordinates"')


def looks_like_csv(lines: list[str]) -> bool:
    """At least two lines whose numbers of commas differ by one at most."""
    counts = [x.count(",") for x in lines[:5] if x.strip()]
    return len(counts) > 1 and counts[0] > 0 and all(abs(c - counts[0]) <= 1 for c in counts)


def looks_like_geojson(text: str) -> bool:
    return text.lstrip()[:1] in ("{", "[") and sum(w in text for w in GEOJSON_WORDS) >= 2


def encoding_of(head: bytes) -> str:
    """By byte order mark, else ascii, else utf8 if it decodes, else latin1."""
    for mark, name in ((b"\xef\xbb\xbf", "utf8"), (b"\xff\xfe", "utf16le"), (b"\xfe\xff", "utf16be")):
        if head.startswith(mark):
            return name
    if all(b < 128 for b in head):
        return "ascii"
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head)  # a character cut off at the end is no error
        return "utf8"
    except UnicodeDecodeError:
        return "latin1"


CODECS = {"utf8": "utf-8-sig", "utf16le": "utf-16-le", "utf16be": "utf-16-be", "latin1": "latin-1", "ascii": "ascii"}


def detect(spark: SparkSession, path: str) -> dict:
    """kind, encoding, headers and about how many rows or features a file or folder holds: its size by the mean length of its first lines."""
    head = head_bytes(spark, path)
    size = spark.read.format("binaryFile").load(path).drop("content").agg({"length": "sum"}).head()[0] or 0
    encoding = encoding_of(head)
    text = head.decode(CODECS[encoding], "ignore").lstrip("\ufeff")
    lines = text.splitlines()
    if len(head) < size and len(lines) > 1:
        lines = lines[:-1]  # cut off
    kind = next((k for end, k in KINDS.items() if path.lower().endswith(end)), None)
    if kind is None or (kind == "csv" and looks_like_geojson(text)):
        kind = "geojson" if looks_like_geojson(text) else "csv" if looks_like_csv(lines) else "unknown"
    mean = max(1.0, len(head) / max(1, text.count("\n")))
    first = lines[0] if lines else ""
    return {
        "kind": kind,
        "encoding": encoding,
        "headers": [h.strip().strip('"') for h in first.split(",")] if kind == "csv" else [],
        "size": size,
        "estimate": max(0, round(size / mean) - 1) if kind == "csv" else round(text.count('"Feature"') * size / max(1, len(head))),
    }
