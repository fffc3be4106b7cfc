"""Helpers shared by the operators: tables, reliable checkpoints, joins on skewed keys."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.shared import checkpoint, fresh_path, shared_dir, small, stored  # noqa: F401

#: A key is hot when it holds at least one row in so many; so there are at most so many hot keys.
HOT_KEYS = 1000

WS = r"\x09-\x0D\x20"

#: Bits of a row number that are the place in its file.
ROW_BITS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores, so that df has no column that is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _plain_reading(docs: DataFrame) -> bool:
    """Whether docs is one reading of files with nothing but projections and filters over it: then each of its rows is a row of a file, once.

    Joins, generators and unions keep the place of a row, but give it to several rows.
    """
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    if node.getClass().getSimpleName() != "LogicalRelation" or not hasattr(node.relation(), "location"):
        return False
    roots = node.relation().location().rootPaths()
    paths = sorted(roots.apply(i).toString().rstrip("/") + "/" for i in range(roots.size()))
    # a file that is listed twice is read twice
    return not any(b.startswith(a) for a, b in zip(paths, paths[1:]))


def _file_place(docs: DataFrame):
    """Columns for the file of a row and its place in it, if docs is a plain reading of Parquet files, else None."""
    if not _plain_reading(docs):
        return None
    try:
        meta = docs.metadataColumn("_metadata")
        found = meta["file_path"].alias("_file"), meta["row_index"].alias("_index")
        docs.select(*found).schema
        return found
    except AnalysisException:
        return None


def with_row_id(docs: DataFrame, name: str = "_rid") -> DataFrame:
    """docs plus a long of its own per row, the same at each reading, whatever executors come or go; a column of that name is replaced.

    Rows read from Parquet files are numbered by file and place in it: numbers that follow the order in which a reading
    happens to deal out the files (monotonically_increasing_id) change with the number of cores. Other tables, joins,
    exploded rows and unions among them, are written to the shared folder with their numbers, and only that copy is read.
    """
    docs = docs.drop(name)
    place = _file_place(docs)
    if place is None:
        return stored(docs.withColumn(name, F.monotonically_increasing_id()))
    path, index = free_name(docs, "_file"), free_name(docs, "_index")
    files = docs.select(place[0]).distinct()
    # one row per file, never per document
    files = checkpoint(files.select(F.col("_file").alias(path), (F.row_number().over(Window.orderBy("_file")) - 1).cast("long").alias("_number")))
    number = free_name(docs, "_number")
    located = docs.select("*", place[0].alias(path), place[1].alias(index))
    located = join_small(located, files.withColumnRenamed("_number", number), [path])
    return located.withColumn(name, F.shiftleft(F.col(number), ROW_BITS) + F.col(index)).drop(path, index, number)


def join_counted(rows: DataFrame, values: DataFrame, keys: list[str], n: str = "n", total: int | None = None) -> DataFrame:
    """rows left-joined with values, which has one row per key and in column n the number of rows of that key.

    Keys with at least a thousandth of all rows are at most a thousand, so those are broadcast;
    the others, none of which is large, are joined by a shuffle. Keys must not be null.
    """
    if total is None:
        total = values.agg(F.sum(n)).head()[0] or 0
    hot = F.col(n) * HOT_KEYS >= F.lit(total)
    top = F.broadcast(values.where(hot).withColumn("_hot", F.lit(True)))
    marked = rows.join(top, keys, "left")
    extra = [c for c in values.columns if c not in keys]
    cold = marked.where("_hot is null").drop("_hot", *extra).join(values.where(~hot), keys, "left")
    return marked.where("_hot").drop("_hot").unionByName(cold)


def join_small(rows: DataFrame, values: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """rows joined with values of few columns: by broadcast if values are counted to be few, else by a shuffle."""
    return rows.join(small(values), keys, how)


def without(docs: DataFrame, found) -> DataFrame:
    """docs without some rows, all columns kept. found: from a frame of _rid, doc_id, text to the _rid of rows that go."""
    rid = free_name(docs, "_rid")
    numbered = with_row_id(docs, rid)
    gone = checkpoint(found(numbered.select(F.col(rid).alias("_rid"), "doc_id", "text")).select(F.col("_rid").alias(rid)))
    return join_small(numbered, gone, [rid], "left_anti").drop(rid)
