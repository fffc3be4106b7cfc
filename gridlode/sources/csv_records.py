"""CSV files of any size, split at true record bounds, in any of the encodings that `detect` knows.

A quoted field may hold line breaks, so a line break ends a record only outside quotes. Lines with quotes are summed up
by range for both states in which a range may begin; if none opens a field that it doesn't close, every line is a
record and Spark's own reader takes the file; else records are cut by their states and parsed by Spark.

UTF-16 is cut at its two bytes of a line break, which can also be the halves of two characters; whether a cut is real
follows from the parity of its place, which the lengths before it give.
"""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.shared import head_bytes
from . import detect
from .ranges import cut_records, read_pieces, start_states

_CLOSE = re.compile(rb'(?:[^"]|"")*+"')
BREAKS = {"utf16le": b"\n\x00", "utf16be": b"\x00\n"}
MARKS = {"utf8": b"\xef\xbb\xbf", "utf16le": b"\xff\xfe", "utf16be": b"\xfe\xff"}


def ends_quoted(line: bytes, quoted: bool, sep: bytes = b",") -> bool:
    """Whether a line that begins inside a quoted field, or not, ends inside one. Quotes inside plain fields are plain."""
    at = 0
    if not quoted:
        if line.startswith(b'"'):
            at = 1
        else:
            at = line.find(sep + b'"') + 2
            if at < 2:
                return False
    while True:
        close = _CLOSE.match(line, at)
        if close is None:
            return True
        at = line.find(sep + b'"', close.end()) + 2
        if at < 2:
            return False


def closes(line, sep: str = ","):
    """Whether a line (string) that begins outside of quotes surely ends there; False may be wrong.

    Without doubled quotes, which change no state, every second piece between quotes is inside of a field, if each
    quote that opens one comes first or after a separator.
    """
    pieces = F.split(F.replace(line, F.lit('""'), F.lit("")), '"')
    stray = F.filter(pieces, lambda p, i: (i % 2 == 0) & (i + 1 < F.size(pieces)) & ~(p.endswith(sep) | ((i == 0) & (p == ""))))
    return (F.size(pieces) % 2 == 1) & (F.size(stray) == 0)


class Quotes:
    """A range for both states: where lines that begin outside and inside of quotes lead to, and if any line opens a field."""

    def __init__(self, sep: bytes):
        self.sep, self.ends, self.opens = sep, [False, True], False

    def push(self, line: bytes) -> None:
        if b'"' in line:
            after = [ends_quoted(line, q, self.sep) for q in (False, True)]
            self.opens = self.opens or after[0]
            self.ends = [after[q] for q in self.ends]

    def plain(self):
        return self.ends, self.opens


class Lines:
    """Cuts lines into records. decode: from the bytes of a record to UTF-8."""

    def __init__(self, quoted: bool, sep: bytes):
        self.inside, self.sep, self.held = quoted, sep, []

    def push(self, line: bytes) -> list[bytes]:
        if b'"' in line:
            self.inside = ends_quoted(line, self.inside, self.sep)
        if self.inside:
            self.held.append(line + b"\n")
            return []
        if not self.held:
            return [line]
        out = b"".join(self.held) + line
        self.held = []
        return [out]

    def rest(self) -> bytes:
        return b"".join(self.held)


class Pairs:
    """Whether the two-byte places of a range are off by one at its end."""

    def __init__(self):
        self.odd = False

    def push(self, piece: bytes) -> None:
        self.odd ^= len(piece) % 2 == 1

    def plain(self):
        return self.odd


class Units:
    """Cuts pieces of UTF-16 into lines, in UTF-8. odd: the range begins at the second byte of a pair."""

    def __init__(self, odd: bool, encoding: str):
        self.inside, self.encoding, self.held, self.size = odd, encoding, [], int(odd)

    def push(self, piece: bytes) -> list[bytes]:
        self.held.append(piece)
        self.size += len(piece)
        self.inside = self.size % 2 == 1
        if self.inside:  # the break is halves of two characters
            self.held.append(BREAKS[self.encoding])
            return []
        out, self.held, self.size = b"".join(self.held), [], 0
        return [out]

    def rest(self) -> bytes:
        return b"".join(self.held)


def utf8_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """file, start, value: the lines of files, in UTF-8, each range's in their order."""
    sep = BREAKS.get(encoding, b"\n")
    pieces = read_pieces(spark, path, sep)
    if encoding not in BREAKS and encoding != "latin1":
        return pieces
    text = F.decode("value", {"utf16le": "UTF-16LE", "utf16be": "UTF-16BE"}.get(encoding, "ISO-8859-1"))
    if encoding in BREAKS:
        states = start_states(pieces, lambda start: Pairs(), lambda odd, changes: odd ^ changes, False)
        lines = cut_records(pieces, states, lambda odd, _: Units(odd, encoding), False)
        # a line that began in another range goes to the end of that; the order of the others is that of the range
        pieces = lines.repartition("file", "start").sortWithinPartitions("file", "start", "place").select("file", "start", F.col("raw").alias("value"))
    return pieces.select("file", "start", F.encode(text, "UTF-8").alias("value"))


def csv_head(spark: SparkSession, path: str, encoding: str | None = None, sep: str = ",") -> tuple[list[str], str]:
    """The headers and the encoding of a file, or of a folder's first file."""
    head = head_bytes(spark, path)
    encoding = encoding or detect.encoding_of(head)
    text = head.decode(detect.CODECS[encoding], "ignore").lstrip("\ufeff")
    return next(csv.reader(io.StringIO(text, newline=""), delimiter=sep), []), encoding


def unique_names(names: list[str]) -> list[str]:
    """Names of columns: blank ones by their place, and repeated ones with it."""
    lower = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def read_csv(spark: SparkSession, path: str, strict: bool = False, encoding: str | None = None, sep: str = ",") -> DataFrame:
    """CSV files with headers, all text. Fields may be quoted and hold separators, line breaks and doubled quotes.

    strict: rows with another number of fields are dropped, whatever columns are taken; else they have nulls, or lose
    what is too many. Blank lines are no rows. encoding: as `detect.encoding_of` names it, found in the first file if None.
    """
    headers, encoding = csv_head(spark, path, encoding, sep)
    names = unique_names(headers)
    if not names:
        return spark.createDataFrame([], "_c0 string").select()
    byte = sep.encode()
    schema = StructType([StructField(n, StringType()) for n in names])
    lines = utf8_lines(spark, path, encoding)
    # what all lines surely close needs no look at how the ranges begin
    line = F.col("value").cast("string")
    plain = encoding in ("utf8", "ascii") and not lines.where(F.contains(line, F.lit('"')) & ~closes(line, sep)).limit(1).count()
    if not plain:
        # lines without quotes change no state: they go as empty ones
        marked = lines.withColumn("value", F.when(F.contains("value", F.lit(b'"')), F.col("value")).otherwise(F.lit(b"")))
        opens = []

        def step(quoted, range_):
            opens.append(range_[1])
            return range_[0][quoted]

        states = start_states(marked, lambda start: Quotes(byte), step, False)
        plain = encoding in ("utf8", "ascii") and not any(opens)
    if plain:  # every line is a record
        reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("escape", '"').option("sep", sep)
        # a reader that parses few columns doesn't see how many there are
        return reader.option("columnPruning", not strict).option("mode", "DROPMALFORMED" if strict else "PERMISSIVE").csv(path)
    records = cut_records(lines, states, lambda quoted, _: Lines(quoted, byte), False)
    records = records.where(~((F.col("start") == 0) & (F.col("place") == 0)))
    text = F.rtrim(F.decode("raw", "UTF-8"), F.lit("\r"))
    wrong = "_wrong"
    while wrong in {n.lower() for n in names}:
        wrong += "_"
    kind = StructType([*schema.fields, StructField(wrong, StringType())])
    options = {"escape": '"', "sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": wrong, "maxCharsPerColumn": "-1"}
    parsed = records.where(F.trim(text, F.lit("\ufeff \t\r")) != "").select(F.from_csv(text, _ddl(kind), options).alias("r"))
    if strict:
        parsed = parsed.where(F.col(f"r.{wrong}").isNull())
    return parsed.select(*[F.col("r").getField(n).alias(n) for n in names])


def _ddl(kind: StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` string" for f in kind.fields)

