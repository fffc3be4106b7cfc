"""A stream of sightings folded into a table of first and last sightings, exactly once.

Each micro-batch merges into the last version and writes the next; a version is named by its batch, so a batch that
is run again after a failure reads the version before it and writes the same one anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.shared import remove
from ..operators.upsert import merge_seen, seen_upsert


def version(spark: SparkSession, target: str, batch: int) -> DataFrame | None:
    """The table after a batch; None before the first one. A version that is missing or can't be read is an error."""
    return spark.read.parquet(f"{target}/v={batch}") if batch >= 0 else None


def fold(target: str, keys: list[str], values: list[str], at: str):
    """The function that foreachBatch calls. The last two versions stay: the one before is read again if a batch is."""

    def run(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        old = version(spark, target, batch - 1)
        new = seen_upsert(rows, keys, values, at) if old is None else merge_seen(old, rows, keys, values, at)
        new.write.mode("overwrite").parquet(f"{target}/v={batch}")
        if batch > 1:
            remove(spark, f"{target}/v={batch - 2}")

    return run


def stream_sightings(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: list[str], values: list[str], at: str, files: int = 1) -> StreamingQuery:
    """Folds new files of a folder until all that are there are done. The checkpoint is where a restart resumes."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return rows.writeStream.foreachBatch(fold(target, keys, values, at)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
