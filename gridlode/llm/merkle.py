"""Merkle manifest of a dataset, grown and verified by Pregel-style supersteps on RDDs.

Rows are leaves: SHA-256 digests of their fields. The leaves of each group, in the order of a key, are hashed in runs of
`arity`, level by level, to a subroot; subroots, in the order of their groups, likewise to the root. In a superstep each
vertex sends its digest to its parent; a parent that has heard all its children, whose number follows from the size of
its tree, hashes them and goes on. Reverse supersteps send the siblings on the way to the root down to the leaves, which
fold a claimed digest with them to see if it gives the root.

Vertices are dealt to partitions by blocks of up to BLOCK leaves under one ancestor, so that a message stays in its
partition for as many supersteps as a block is high; then the blocks' roots are the leaves of the next phase, dealt anew.
A tree of 10 billion leaves takes four phases. A vertex keeps the vertices it has heard, a block at most; on the way down
it hands them their paths. Each phase is checkpointed in the shared folder.

Leaves are numbered by ranges of (group, key, digest), a partition each, and counts of these: no group goes through one
task, and rows with all three alike are spread too.

Defined results: nulls are a value of their own, first in both orders; of rows with one key, the least digest is first;
of equal rows each is a leaf; a lone leaf is its own subroot and a lone subroot the root; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

from pyspark import StorageLevel
from pyspark.rdd import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from .common import shared_dir, small, stored

ARITY = 2
#: Leaves under one ancestor that stay together in a partition.
BLOCK = 1024
#: About so many leaves make a partition.
TASK_LEAVES = 50_000

#: What documents are hashed by, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def row_digest(values: list[Column]) -> Column:
    """SHA-256 in hex of values, each as `-` if null, else UTF-8 byte count, `:`, value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def numbered(rows: DataFrame, group: str | None, order: list[str]) -> DataFrame:
    """rows of a written table plus, nulls first, _i, the place of each in its group from 0 on, _n, the group's number of
    rows, _t, the group's place among the groups, and _ts, their number. group None: all rows are one group.
    """
    columns = rows.columns
    if group is None:
        group, rows = "_all", rows.withColumn("_all", F.lit(0))
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    # rows alike in all of these go to any of their ranges
    ranged = rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*by, "_salt").sortWithinPartitions(*by).drop("_salt")
    placed = ranged.select("*", F.monotonically_increasing_id().alias("_at")).withColumn("_part", F.shiftright("_at", 33))
    placed = stored(placed)
    parts = placed.groupBy("_part", group).agg(F.count("*").alias("_c"), F.min("_at").alias("_first"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a row per range and group in it, so a group has no more than there are ranges
    offsets = parts.select("_part", group, "_first", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy(group)).alias("_n"))
    offsets = stored(offsets)
    if group == "_all":
        offsets = offsets.withColumns({"_t": F.lit(0).cast("long"), "_ts": F.lit(1).cast("long")})
    else:
        groups = numbered(stored(offsets.select(group).distinct()), None, [group]).select(F.col(group).alias("_g"), F.col("_i").alias("_t"), F.col("_n").alias("_ts"))
        offsets = stored(offsets.join(small(groups), F.col(group).eqNullSafe(F.col("_g"))).drop("_g"))
    offsets = offsets.withColumnsRenamed({"_part": "_p", group: "_g"})
    joined = placed.join(small(offsets), (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.select(*columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("_i"), "_n", "_t", "_ts")


class Forest:
    """Trees grown from leaves (tree, place, leaves of the tree, digest, payload), and paths sent down again."""

    def __init__(self, leaves: RDD, most: int, total: int, arity: int = ARITY):
        """most: leaves of the largest tree; total: of all trees."""
        self.arity, self.phases = arity, []
        self.steps = max(1, int(math.log(BLOCK) / math.log(arity) + 1e-9))
        self.tasks = max(min(leaves.context.defaultParallelism, total // BLOCK + 1), total // TASK_LEAVES + 1)
        vertices = leaves.map(lambda x: ((x[0], 0, x[1]), (x[2], x[3], None, x[4])))
        while True:
            place = self._placed(len(self.phases))
            vertices = vertices.partitionBy(self.tasks, place)
            for _ in range(self.steps):
                vertices = self._superstep(vertices, place)
            vertices.persist(StorageLevel.MEMORY_AND_DISK)
            vertices.checkpoint()
            vertices.count()
            vertices.unpersist()
            self.phases.append((vertices, place))
            most = -(-most // arity**self.steps)
            if most <= 1:
                return
            vertices = vertices.mapValues(lambda v: (v[0], v[1], None, None))

    def _placed(self, phase: int):
        """The partition of a vertex in a phase: that of its block."""
        arity, top, tasks = self.arity, self.steps * (phase + 1), self.tasks

        def place(key):
            tree, level, i = key
            block = i // arity ** max(0, top - level)
            return (tree * 0x9E3779B97F4A7C15 + block * 0xBF58476D1CE4E5B9 + 0x94D049BB) % ((1 << 61) - 1) % tasks

        return place

    def _superstep(self, vertices: RDD, place) -> RDD:
        """Digests go to the parents; parents that have heard all of their children hash them."""
        arity = self.arity

        def send(part):
            for (tree, level, i), (n, own, below, payload) in part:
                if n == 1:  # a root waits
                    yield (tree, level, i), [(-1, n, own, below, payload)]
                else:
                    yield (tree, level + 1, i // arity), [(i % arity, n, own, below, payload)]

        def hear(part):
            for (tree, level, i), heard in part:
                slot, n, own, below, payload = heard[0]
                if slot < 0:
                    yield (tree, level, i), (n, own, below, payload)
                    continue
                heard.sort(key=lambda m: m[0])
                if [m[0] for m in heard] != list(range(min(arity, n - arity * i))):
                    raise ValueError(f"vertex {i} of level {level} has {len(heard)} of its children")
                children = [(m[2], m[3], m[4]) for m in heard]
                yield (tree, level, i), (-(-n // arity), digest([c[0] for c in children]), children, None)

        sent = vertices.mapPartitions(send, preservesPartitioning=True)
        # both sides are dealt by the same function, so no message crosses to another partition
        heard = sent.combineByKey(lambda m: m, lambda a, m: a + m, lambda a, b: a + b, self.tasks, place)
        return heard.mapPartitions(hear, preservesPartitioning=True)

    def roots(self) -> RDD:
        """(tree, digest) of each tree."""
        return self.phases[-1][0].map(lambda kv: (kv[0][0], kv[1][1]))

    def descend(self, paths: RDD) -> RDD:
        """paths: (tree, path from its root on) -> (tree, place, digest, payload, path) of each leaf.

        A path is (place in its run, the run's other digests, path of the parent); that of a root is (None, its digest, path given).
        """
        arity = self.arity

        def start(part):
            for (tree, level, i), (_, own, below, payload) in part:
                yield (tree, level, i), [(own, below, payload)]

        def meet(part):
            for key, both in part:
                vertex = next(x[0] for x in both if isinstance(x, list))
                yield key, (vertex, next((x[0] for x in both if isinstance(x, tuple)), None))

        def send(part):
            for (tree, level, i), ((own, below, payload), path) in part:
                if below is None:
                    yield (tree, level, i), ((own, below, payload), path)
                    continue
                digests = [c[0] for c in below]
                for slot, child in enumerate(below):
                    yield (tree, level - 1, i * arity + slot), (child, (slot, digests[:slot] + digests[slot + 1 :], path))

        tops = self.phases[-1][0].map(lambda kv: (kv[0][0], (kv[0], kv[1][1])))
        down = tops.groupWith(paths).flatMap(lambda x: [(key, ((None, own, path),)) for key, own in x[1][0] for path in x[1][1]])
        for vertices, place in reversed(self.phases):
            known = vertices.mapPartitions(start, preservesPartitioning=True)
            met = known.union(down.partitionBy(self.tasks, place)).groupByKey(self.tasks, place).mapPartitions(meet, preservesPartitioning=True)
            for _ in range(self.steps):
                met = met.mapPartitions(send, preservesPartitioning=True)
            down = met.map(lambda kv: (kv[0], (kv[1][1],)))
        return met.map(lambda kv: (kv[0][0], kv[0][2], kv[1][0][0], kv[1][0][2], kv[1][1]))


def steps_of(path) -> list[tuple[int, list[str]]]:
    out = []
    while path is not None:
        out.append(path[:2])
        path = path[2]
    return out


def fold(leaf: str, path) -> str:
    """The root that a leaf gives with the digests on its path."""
    for slot, others in steps_of(path):
        if slot is not None:
            leaf = digest(others[:slot] + [leaf] + others[slot:])
    return leaf


def manifest(rows: DataFrame, group: str, key: str, arity: int = ARITY) -> DataFrame:
    """rows: group, key, leaf, claimed -> a row each: group, key, place, leaves, leaf, subroot, root, siblings, folded_root, verified.

    leaf, claimed: digests in hex. siblings: the other digests of each run from the leaf to the root; with the place,
    the number of leaves and the place of the group, they are the proof. folded_root: from claimed and the siblings.
    """
    spark = rows.sparkSession
    if arity < 2:
        raise ValueError("a run has two nodes or more")
    shared_dir(spark)
    rows = stored(rows.select(F.col(group).alias("_group"), F.col(key).alias("_key"), "leaf", "claimed"))
    leaves = stored(numbered(rows, "_group", ["_key", "leaf", "claimed"]))
    out = StructType(
        [StructField(group, leaves.schema["_group"].dataType), StructField(key, leaves.schema["_key"].dataType)]
        + [StructField(c, LongType()) for c in ("place", "leaves")]
        + [StructField(c, StringType()) for c in ("leaf", "subroot", "root")]
        + [StructField("siblings", ArrayType(StringType())), StructField("folded_root", StringType()), StructField("verified", BooleanType())]
    )
    total, most, trees = leaves.agg(F.count("*"), F.max("_n"), F.max("_ts")).head()
    if not total:
        return spark.createDataFrame([], out)
    other = F.when(~F.col("claimed").eqNullSafe(F.col("leaf")), F.col("claimed"))
    known = leaves.select("_t", "_i", "_n", "leaf", "_group", "_key", other)
    forest = Forest(known.rdd.map(lambda r: (r[0], r[1], r[2], r[3], (r[4], r[5], r[6], r[2]))), most, total, arity)
    top = Forest(forest.roots().map(lambda r: (0, r[0], trees, r[1], None)), trees, trees, arity)
    paths = top.descend(spark.sparkContext.parallelize([(0, None)], 1)).map(lambda x: (x[1], x[4]))

    def row(leaf):
        _, place, own, (of, at, claimed, n), path = leaf
        steps = steps_of(path)
        subroot, root = (d for slot, d in steps if slot is None)
        folded = fold(own if claimed is None else claimed, path)
        return of, at, place, n, own, subroot, root, [d for slot, others in steps if slot is not None for d in others], folded, folded == root

    return spark.createDataFrame(forest.descend(paths).map(row), out, verifySchema=False)


def verified_documents(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document, grouped by lang.

    Documents of whose decimal doc_id the unsigned crc32 is a multiple of 7 claim to have one character more than they have.
    """
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claimed = F.when(tampered, F.try_add(F.col("n_chars").cast("long"), F.lit(1).cast("long"))).otherwise(F.col("n_chars").cast("long"))
    leaf = row_digest([F.col(c) for c in FIELDS])
    other = row_digest([claimed if c == "n_chars" else F.col(c) for c in FIELDS])
    rows = docs.select("lang", "doc_id", leaf.alias("leaf"), F.when(tampered, other).otherwise(leaf).alias("claimed"))
    proof = F.sha2(F.array_join("siblings", ""), 256)
    return manifest(rows, "lang", "doc_id").select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


_FIELD = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format("{n}" if c == "n_chars" else c) for c in FIELDS) + ")"
#: The unsigned crc32 of the decimal doc_id, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i::int, 1))::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

ORACLE = f"""
with recursive d as (select doc_id, lang, {_LEAF.format(n="n_chars")} as leaf, {_LEAF.format(n="(n_chars + 1)")} as other, coalesce({_CRC} % 7 = 0, false) as bad from documents),
l as (select *, case when bad then other else leaf end as claimed, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i,
  dense_rank() over (order by lang nulls first) - 1 as t from d),
up as (
  select t, 0 as h, i, leaf as x, count(*) over (partition by t) as n from l
  union all
  select t, h + 1, i // 2, sha256(string_agg(x, '' order by i)), (max(n) + 1) // 2 from up where n > 1 group by t, h, i // 2),
subs as (select t, x as subroot from up where n = 1),
top as (
  select 0 as h, t as i, subroot as x, (select count(*) from subs) as n from subs
  union all
  select h + 1, i // 2, sha256(string_agg(x, '' order by i)), (max(n) + 1) // 2 from top where n > 1 group by h, i // 2),
hs as (select t, max(h) as top from up group by t),
steps as (
  select l.t, l.i, up.h, up.x, up.i & 1 as side from l join up on up.t = l.t and up.i = xor(l.i >> up.h, 1) and up.n > 1
  union all
  select l.t, l.i, hs.top + top.h, top.x, top.i & 1 from l join hs using (t) join top on top.i = xor(l.t >> top.h, 1) and top.n > 1),
proofs as (select t, i, sha256(string_agg(x, '' order by h)) as proof, map_from_entries(list({{'k': h, 'v': {{'x': x, 'a': side}}}})) as m from steps group by t, i),
tall as (select max(h) as top from top),
folded as (
  select l.doc_id, l.leaf, subs.subroot, coalesce(proof, sha256('')) as proof_sha256,
    list_reduce(list_prepend({{'k': -1, 'd': claimed}}, list_transform(range(hs.top + tall.top), lambda k: {{'k': k::int, 'd': ''}})),
      lambda a, b: {{'k': b.k, 'd': case when m[b.k] is null then sha256(a.d) when m[b.k].a = 1 then sha256(a.d || m[b.k].x) else sha256(m[b.k].x || a.d) end}}).d as folded_root
  from l join hs using (t) join subs using (t) cross join tall left join proofs p on p.t = l.t and p.i = l.i),
r as (select x as root from top where n = 1)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from folded cross join r
"""
