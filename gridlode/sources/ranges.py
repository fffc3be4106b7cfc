"""Files read by byte ranges whose meaning depends on what stands before them.

Spark deals out ranges of files and its line reader cuts them at a separator, so files of any size and any store will do.
Whether a separator ends a record depends on a state (inside quotes, depth of brackets) that runs on from one range to
the next. So each range is first summed up for every state that it might begin in; the summaries of a file, a row per
range, are then composed in order, which gives the state at the begin of each range; and each range is cut into
records with it. What a record has in several ranges is put together by file and place.

The summaries of all ranges come to the driver: 100 TB in ranges of 128 MB are 800,000 rows of under 100 bytes.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from typing import Protocol

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A task hands on about so many bytes of records at a time.
HELD = 4 << 20


class Cutter(Protocol):
    """Cuts the pieces of one range, in their order, into records."""

    inside: bool  # whether a record has begun and not ended

    def push(self, piece: bytes) -> list[bytes]:
        """What of the piece, its separator included, ends records: one entry each. The rest is kept."""

    def rest(self) -> bytes:
        """What is kept at the end."""


def read_pieces(spark: SparkSession, path: str, sep: bytes) -> DataFrame:
    """file, start, value: what stands between separators, each range's pieces in their order; start is where a range begins."""
    source = spark.read.format("text").option("lineSep", sep.decode("latin-1")).option("encoding", "ISO-8859-1")
    return source.load(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))


def _ranges(batches):
    """(file, start, values) of consecutive rows of one range."""
    for batch in batches:
        files, starts, n = batch.column(0), batch.column(1), batch.num_rows
        if not n:
            continue
        other = pc.or_(pc.not_equal(files.slice(1), files.slice(0, n - 1)), pc.not_equal(starts.slice(1), starts.slice(0, n - 1)))
        ends = [i + 1 for i in pc.indices_nonzero(other).to_pylist()] + [n]
        for at, end in zip([0, *ends], ends):
            yield files[at].as_py(), starts[at].as_py(), batch.column(2).slice(at, end - at).to_pylist()


def _push(reader, values: list[bytes]) -> list[bytes]:
    """The records that end in values, of a reader that takes them all at once, or one by one."""
    if hasattr(reader, "push_all"):
        return reader.push_all(values)
    return [raw for value in values for raw in reader.push(value) or ()]


def start_states(pieces: DataFrame, new_summary, step, first) -> dict:
    """(file, start of a range) -> the state there, and (file, None) -> the state at the file's end.

    new_summary(start) gives an object that is pushed a range's pieces and then asked for its plain() data; step(state,
    these data) is the state at the range's end, first the state at the begin of a file.
    """

    def run(batches):
        at, summary, out = None, None, []
        for file, start, values in _ranges(batches):
            if (file, start) != at:
                if summary is not None:
                    out.append((*at, pickle.dumps(summary.plain())))
                at, summary = (file, start), new_summary(start)
            _push(summary, values)
        if summary is not None:
            out.append((*at, pickle.dumps(summary.plain())))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.binary()))], ["file", "start", "summary"])

    by_file = defaultdict(list)
    for r in pieces.mapInArrow(run, "file string, start long, summary binary").collect():
        by_file[r["file"]].append((r["start"], r["summary"]))
    states = {}
    for file, found in by_file.items():
        state = first
        for start, summary in sorted(found):
            states[file, start] = state
            state = step(state, pickle.loads(summary))
        states[file, None] = state
    return states


def cut_records(pieces: DataFrame, states: dict, new_cutter, first) -> DataFrame:
    """file, start, place, raw: the records of all files. new_cutter(state, state at the file's end) gives a Cutter.

    place: a record's number in its range, -1 if it began in another; start: of the range in which it began.
    states: of the ranges; those that lack one begin like a file.
    """
    shared = pieces.sparkSession.sparkContext.broadcast(states)
    names = ["file", "start", "place", "raw"]

    def rows(file, start, places, raws, more=()):
        n = len(raws)
        fixed = [pa.repeat(pa.scalar(file, pa.string()), n), pa.repeat(pa.scalar(start, pa.int64()), n)]
        flags = [pa.array([x], pa.bool_()) for x in more]
        return pa.RecordBatch.from_arrays([*fixed, pa.array(places, pa.int64()), pa.array(raws, pa.binary()), *flags], [*names, "begins", "ends"][: 4 + len(flags)])

    def cut(batches, parts: bool):
        """Records that are whole in their range, or parts of those that aren't."""
        at, cutter, place, open_ = None, None, 0, False
        for file, start, values in _ranges(batches):
            if (file, start) != at:
                if parts and cutter is not None and (cutter.inside or open_):
                    yield rows(*at, [place], [cutter.rest()], (not open_, False))
                at, place = (file, start), 0
                cutter = new_cutter(shared.value.get(at, first), shared.value.get((file, None), first))
                open_ = cutter.inside  # the range begins inside a record of another
            raws = _push(cutter, values)
            if open_ and raws:
                if parts:
                    yield rows(file, start, [-1], raws[:1], (False, True))
                raws, open_ = raws[1:], False
            held, begin = 0, 0
            for i, raw in enumerate(raws if not parts else ()):
                held += len(raw)
                if held > HELD or i + 1 == len(raws):
                    yield rows(file, start, range(place + begin, place + i + 1), raws[begin : i + 1])
                    held, begin = 0, i + 1
            place += len(raws)
        if parts and cutter is not None and (cutter.inside or open_):
            yield rows(*at, [place], [cutter.rest()], (not open_, False))

    kind = "file string, start long, place long, raw binary"
    whole = pieces.mapInArrow(lambda batches: cut(batches, False), kind)
    found = pieces.mapInArrow(lambda batches: cut(batches, True), f"{kind}, begins boolean, ends boolean")
    # two parts per range at most; in order, each belongs to the last begin
    order = Window.partitionBy("file").orderBy("start", "begins")
    marked = found.withColumn("of", F.last(F.when(F.col("begins"), F.struct("start", "place")), True).over(order))
    parts = marked.groupBy("file", "of").agg(F.array_sort(F.collect_list(F.struct("start", "begins", "raw"))).alias("l"), F.max("ends").alias("closed"))
    joined = parts.select("file", F.col("of.start").alias("start"), F.col("of.place").alias("place"), F.aggregate("l", F.lit(b""), lambda a, x: F.concat(a, x["raw"])).alias("raw"))
    return whole.unionByName(joined)
