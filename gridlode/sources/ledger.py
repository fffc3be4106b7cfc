"""Batch ingest that goes on where it stopped: a ledger of byte ranges, each recorded together with its output.

Files are taken in ranges of a fixed size, some ranges at a time; batches of small ranges are done and published many
together, up to TOGETHER bytes, as each is a job over all ranges of its files. A batch writes its rows to a new folder, a subfolder per
range, and then publishes its entries by one rename: file, start, size and time of the file, rows, and a digest of the
rows. What an interrupted batch wrote is in no entry and so in no result. A later run does the ranges that have no
entry, and those of files that changed since; of these the older entries count no more.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.shared import list_names, remove
from ..operators.versions import ConflictError, Document

RANGE_BYTES = 64 << 20
#: Ranges of a batch.
BATCH = 64
#: Batches that are smaller are done together up to so many bytes: less than a batch of the default size.
TOGETHER = 1 << 30


class Ledger:
    """The entries of an ingest and its output, in a folder of the shared store. One run writes at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.document = Document(spark, f"{self.path}/entries")

    def entries(self) -> list[dict]:
        """The entries that count, in order: a row per range that is done. Those of files as they were before they changed are left out."""
        last: dict[tuple, dict] = {}
        for n in self.document.versions():
            for e in self.document.read(n)[1]["ranges"]:
                last[e["file"], e["start"]] = e
        now = {}
        for e in last.values():
            now[e["file"]] = max(now.get(e["file"], (0, 0)), (e["batch"], e["modified"]))
        return sorted((e for e in last.values() if e["modified"] == now[e["file"]][1]), key=lambda e: (e["file"], e["start"]))

    def progress(self) -> list[dict]:
        """A row per file: ranges and rows that are done, the bytes of the file, and whether all of it is done."""
        files: dict[str, dict] = {}
        for e in self.entries():
            f = files.setdefault(e["file"], {"file": e["file"], "ranges": 0, "rows": 0, "length": e["length"], "done": False})
            f["ranges"] += 1
            f["rows"] += e["rows"]
            f["done"] = f["ranges"] * e["size"] >= e["length"]
        return list(files.values())

    def output(self, schema: StructType) -> DataFrame:
        """The rows of all ranges that are done, each once."""
        folders = [f"{self.path}/{e['folder']}" for e in self.entries() if e["rows"]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def damaged(self, schema: StructType) -> list[dict]:
        """Entries whose output isn't what was recorded."""
        bad = []
        for e in self.entries():
            if e["rows"]:
                try:
                    rows, digest = _digest(self.spark.read.schema(schema).parquet(f"{self.path}/{e['folder']}")).head()
                except Exception:
                    rows, digest = -1, None
                if (rows, digest) != (e["rows"], e["digest"]):
                    bad.append(e)
        return bad

    def cleanup(self) -> int:
        """Removes what interrupted batches wrote, and the output of entries that count no more; how many folders."""
        used = {e["folder"] for e in self.entries()}
        gone = 0
        for name in list_names(self.spark, f"{self.path}/data"):
            parts = [n for n in list_names(self.spark, f"{self.path}/data/{name}") if n.startswith("_range=")]
            dead = [n for n in parts if f"data/{name}/{n}" not in used]
            for n in [""] if len(dead) == len(parts) else dead:
                remove(self.spark, f"{self.path}/data/{name}/{n}")
            gone += len(dead)
        return gone

    def forget(self) -> None:
        """Removes all: the next run begins anew."""
        remove(self.spark, self.path)


def _digest(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*rows.columns).cast("decimal(20,0)")).cast("string").alias("digest"))


def _lines(spark: SparkSession, files: list[str], wanted: dict[tuple, int]) -> DataFrame:
    """_range, value: the lines of the wanted ranges. A task has one range, and leaves off at once if it isn't wanted."""
    source = spark.read.text(files, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.rtrim("value", F.lit("\r")).alias("value"))

    def run(batches):
        for batch in batches:
            number = wanted.get((batch.column(0)[0].as_py(), batch.column(1)[0].as_py())) if len(batch) else None
            if number is None:
                return
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(batch), pa.int32()), batch.column(2).cast(pa.string())], ["_range", "value"])

    return source.mapInArrow(run, "_range int, value string")


def ingest(spark: SparkSession, source: str, ledger: Ledger, parse: Callable[[DataFrame], DataFrame], range_bytes: int = RANGE_BYTES, batch: int = BATCH, most: int | None = None) -> int:
    """Ingests the lines of files into the ledger's output; how many ranges it did. Ranges that are done are left alone.

    parse: lines (_range, value) -> rows, with _range kept; headers and blank lines are its to drop. most: batches of this run.
    """
    found = spark.read.format("binaryFile").load(source).select("path", "length", F.unix_micros("modificationTime").alias("modified")).orderBy("path").collect()
    done = {(e["file"], e["start"]): e for e in ledger.entries()}
    todo = []
    for f in found:
        for start in range(0, f["length"], range_bytes):
            e = done.get((f["path"], start))
            if e is None or (e["length"], e["modified"], e["size"]) != (f["length"], f["modified"], range_bytes):
                todo.append((f["path"], start, f["length"], f["modified"]))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    ran = 0
    try:
        for n in names:  # with these, each task has one range
            spark.conf.set(n, f"{range_bytes}b")
        todo = todo if most is None else todo[: most * batch]
        step = batch * max(1, TOGETHER // (range_bytes * batch))
        for at in range(0, len(todo), step):
            part = todo[at : at + step]
            number = {(file, start): i for i, (file, start, _, _) in enumerate(part)}
            folder = f"data/{uuid.uuid4().hex}"
            rows = parse(_lines(spark, sorted({file for file, *_ in part}), number))
            rows.write.partitionBy("_range").parquet(f"{ledger.path}/{folder}")
            back = spark.read.schema(rows.schema).parquet(f"{ledger.path}/{folder}")
            plain = [c for c in rows.columns if c != "_range"]
            sums = {r["_range"]: r for r in back.groupBy("_range").agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*plain).cast("decimal(20,0)")).cast("string").alias("digest")).collect()}
            version, _ = ledger.document.read()
            entries = [
                {"file": file, "start": start, "size": range_bytes, "length": length, "modified": modified, "rows": sums[i]["rows"] if i in sums else 0, "digest": sums[i]["digest"] if i in sums else None, "folder": f"{folder}/_range={i}", "batch": version + 1}
                for i, (file, start, length, modified) in enumerate(part)
            ]
            try:
                ledger.document.publish(version + 1, {"ranges": entries})
            except ConflictError as e:
                raise ConflictError(f"another run writes to {ledger.path}; its ranges are kept, these {len(part)} are not") from e
            ran += len(part)
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    return ran
