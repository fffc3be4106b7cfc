"""Exact deduplication by deterministic block naming.

A text is cut into blocks of fixed size. The distinct blocks are sorted and numbered, which gives each an
integer name; then adjacent pairs of names are named in the same way, again and again, until a document has
one name. Two documents have the same number of rounds and the same last name if and only if their texts are
identical: a name stands for one content, so nothing rests on a hash. (A 64-bit hash of a block only carries
its name back to the rows; hashes that two blocks share are found and resolved by the blocks themselves.)

Names are numbered inside hash partitions: partition number, then rank in it. They are written to the shared
folder before use, so a lost executor cannot change them.

Defined results: null counts as the empty text, which is a text like others; of equal texts the row with the
largest doc_id stays, null being smallest, and of repeated rows with that doc_id exactly one; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, join_counted, join_small, stored, with_row_id, without

BLOCK_CHARS = 2048


def _blocks(docs: DataFrame, size: int) -> DataFrame:
    """docs: _rid, doc_id, text -> _rid, doc_id, nb, pos, block."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), 0))
    parts = docs.select("_rid", "doc_id", cut.alias("_cut"))
    return parts.select("_rid", "doc_id", F.size("_cut").alias("nb"), F.posexplode("_cut").alias("pos", "block"))


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys of rows with n, their number of rows, and name, an integer by sorted order."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return found.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _name_blocks(docs: DataFrame, size: int, hashed) -> DataFrame:
    """_rid, doc_id, nb, pos, name of every block."""
    blocks = _blocks(docs, size).withColumn("h", hashed(F.col("block")))
    seq = checkpoint(blocks.select("_rid", "doc_id", "nb", "pos", "h"))
    # block texts cross the shuffle once; what is kept is a hash and a name
    names = checkpoint(_numbered(blocks.select("h", "block"), ["h", "block"]).select("h", "name", "n"))
    shared = checkpoint(names.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"))
    if shared.isEmpty():
        return join_counted(seq, names, ["h"]).select("_rid", "doc_id", "nb", "pos", "name")
    # different blocks with one hash: name those anew, by the blocks; the sign keeps both kinds apart
    clean = join_small(seq, shared, ["h"], "left_anti")
    clean = join_counted(clean, join_small(names, shared, ["h"], "left_anti"), ["h"])
    doubt = join_small(blocks, shared, ["h"], "left_semi")
    again = checkpoint(_numbered(doubt.select("block"), ["block"]))
    doubt = join_counted(doubt, again, ["block"]).withColumn("name", -F.col("name") - 2)
    cols = ["_rid", "doc_id", "nb", "pos", "name"]
    return clean.select(*cols).unionByName(doubt.select(*cols))


def identities(docs: DataFrame, size: int = BLOCK_CHARS, hashed=F.xxhash64) -> DataFrame:
    """_rid, doc_id, level, name: equal (level, name) if and only if equal texts."""
    rows = stored(_name_blocks(docs, size, hashed))
    most = rows.agg(F.max("nb")).head()[0] or 1
    whole = lambda level: rows.where("nb = 1").select("_rid", "doc_id", F.lit(level).alias("level"), "name")
    done, level = whole(0), 0
    while most > 1:
        level += 1
        even = F.col("pos") % 2 == 0
        pairs = rows.where("nb > 1").groupBy("_rid", "doc_id", "nb", F.shiftright("pos", 1).alias("pos"))
        # an odd last name pairs with -1, which names nothing
        pairs = pairs.agg(F.max(F.when(even, F.col("name"))).alias("l"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("r"))
        pairs = checkpoint(pairs)
        names = checkpoint(_numbered(pairs, ["l", "r"]))
        rows = join_counted(pairs, names, ["l", "r"]).select("_rid", "doc_id", F.expr("(nb + 1) div 2").cast("int").alias("nb"), "pos", "name")
        rows = stored(rows)
        done = done.unionByName(whole(level))
        most = (most + 1) // 2
    return done


def exact_groups(docs: DataFrame, size: int = BLOCK_CHARS, hashed=F.xxhash64) -> DataFrame:
    """docs with _rid -> _rid, doc_id, keep_id, group_size, kept of every row."""
    ids = checkpoint(identities(docs.select("_rid", "doc_id", "text"), size, hashed))
    best = F.max(F.struct(F.col("doc_id"), (-F.col("_rid")).alias("r")))
    groups = ids.groupBy("level", "name").agg(F.count("*").alias("n"), best.alias("best"))
    out = join_counted(ids, checkpoint(groups), ["level", "name"])
    return out.select("_rid", "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("_rid") == -F.col("best.r")).alias("kept"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = with_row_id(docs.select("doc_id", "text"))
    sha = docs.select("_rid", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("text_sha256"))
    return exact_groups(docs).join(sha, "_rid").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_exact(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text another row keeps."""
    return without(docs, lambda rows: exact_groups(rows).where(~F.col("kept")))


ORACLE = """
select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
  count(*) over (partition by coalesce(text, '')) as group_size,
  doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept,
  sha256(coalesce(text, '')) as text_sha256
from documents
"""
