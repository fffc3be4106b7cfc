"""The manifest against a recursive tree by hand, over several phases and arities, and with a changed row."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from gridlode.llm import common, merkle, registry

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, _i int, root string, _t int"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(digests, arity):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h(out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def brute(rows, arity=2):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row."""
    fields = lambda r: ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r]
    groups = defaultdict(list)
    for doc_id, source, lang, n, text, *_ in rows:
        leaf = h(fields((doc_id, source, lang, n, text)))
        bad = doc_id is not None and n is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        groups[lang].append((doc_id is not None, doc_id or 0, leaf, h(fields((doc_id, source, lang, n + 1, text))) if bad else leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [levels([x[2] for x in sorted(groups[g])], arity) for g in order]
    top, out = levels([t[-1][0] for t in trees], arity), []
    for at, g in enumerate(order):
        for place, (known, doc_id, leaf, claimed) in enumerate(sorted(groups[g])):
            siblings = []
            for i, tree in ((place, trees[at]), (at, top)):
                for level in tree[:-1]:
                    run = level[i // arity * arity :][:arity]
                    others = run[: i % arity] + run[i % arity + 1 :]
                    claimed = h([*others[: i % arity], claimed, *others[i % arity :]])
                    siblings += others
                    i //= arity
            root = top[-1][0]
            out.append((doc_id if known else None, leaf, trees[at][-1][0], root, h(siblings), claimed, claimed == root))
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    out = [(i, f"s{i % 3}", r.choice(["de", "en", "en", "en", "fr", None, "é", "Z"]), r.choice([None, i, 7]), r.choice(["", None, "text é", f"t{i}", "x" * 3000]), "l", 1, "r", 2) for i in range(230)]
    out += [(500, None, "one of a kind", 1, "t", None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return out + [out[3]] * 40 + [out[-1], (None, "s", "en", 3, "no id", "l", 1, "r", 2), (3, "s", out[3][2], 9, "same id", "l", 1, "r", 2)]


def table(spark, rows):
    path = common.fresh_path(spark, "leaves")
    spark.createDataFrame(rows, SCHEMA).repartition(6).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("block", [1024, 4])
def test_documents_against_brute_force(spark, rows, monkeypatch, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    got = merkle.verified_documents(table(spark, rows))
    want = brute(rows)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert 10 < sum(not x[-1] for x in want) < 60


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 9])
def test_few_rows(spark, rows, n):
    docs = spark.createDataFrame([(i, "s", "en", 1, "t", "l", 1, "r", 2) for i in range(n)], SCHEMA)
    got = merkle.verified_documents(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute([(i, "s", "en", 1, "t") for i in range(n)]), key=str) if n else got == []


@pytest.mark.parametrize("arity", [3, 7])
def test_wider_runs(spark, rows, monkeypatch, arity):
    monkeypatch.setattr(merkle, "BLOCK", 50)
    docs = spark.createDataFrame([(i, "s", "ab"[i % 2], 1, "t", "l", 1, "r", 2) for i in range(120)], SCHEMA)
    leaf = merkle.row_digest([F.col(c) for c in merkle.FIELDS])
    got = merkle.manifest(docs.select(F.col("lang").alias("g"), "doc_id", leaf.alias("leaf"), leaf.alias("claimed")), "g", "doc_id", arity).collect()
    plain = {(r["doc_id"]): (r["leaf"], r["subroot"], r["root"], h(r["siblings"])) for r in got}
    want = {x[0]: x[1:5] for x in brute([(i, "s", "ab"[i % 2], 1, "t") for i in range(120)], arity)}
    assert {k: v[2] for k, v in plain.items()} == {k: v[2] for k, v in want.items()} and plain == want
    assert all(r["verified"] and r["leaves"] == 60 and r["place"] == r["doc_id"] // 2 for r in got)


def test_a_group_of_equal_rows_is_spread(spark):
    rows = spark.range(6000).select(F.lit("en").alias("g"), F.lit(5).alias("k"), F.lit("ab").alias("leaf"))
    placed = merkle.numbered(common.stored(rows), "g", ["k", "leaf"])
    assert sorted(r["_i"] for r in placed.select("_i").collect()) == list(range(6000))
    at = common.stored(rows.withColumn("s", F.monotonically_increasing_id()).repartitionByRange(4, "g", "k", "s")).groupBy(F.spark_partition_id()).count().collect()
    assert placed.where("_n = 6000 and _t = 0 and _ts = 1").count() == 6000 and max(r["count"] for r in at) < 3000


def test_messages_stay_in_their_partition(spark):
    """In a phase only the dealing of its leaves is a shuffle."""
    leaves = spark.sparkContext.parallelize([(0, i, 2000, h([str(i)]), i) for i in range(2000)], 3)
    forest = merkle.Forest(leaves, 2000, 2000)
    assert len(forest.phases) == 2 and forest.tasks == 2
    vertices, place = forest.phases[0]
    assert {key[1] for key, _ in vertices.collect()} == {10} and vertices.isCheckpointed()
    dealt = leaves.map(lambda x: ((x[0], 0, x[1]), (x[2], x[3], None, x[4]))).partitionBy(2, place)
    again = dealt
    for _ in range(5):
        again = forest._superstep(again, place)
    assert again.toDebugString().decode().count("ShuffledRDD") == dealt.toDebugString().decode().count("ShuffledRDD") == 1
    assert forest.roots().collect() == [(0, levels([h([str(i)]) for i in range(2000)], 2)[-1][0])]


def test_query_follows_its_sql(spark):
    data = "/root/testdata/sf0.001"
    got = registry.QUERIES["op12_merkle"](spark, data)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{data}/documents.parquet')")
    want = con.execute(registry.ORACLES["op12_merkle"])
    assert [d[0] for d in want.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_every_leaf_is_folded(spark, rows, monkeypatch):
    """The root that a leaf gives is computed from the leaf, for those without a claim of their own too."""
    monkeypatch.setattr(merkle, "fold", lambda leaf, path: f"folded {leaf}")
    table = spark.createDataFrame([r[:5] for r in rows[:40]], ", ".join(SCHEMA.split(", ")[:5]))
    found = merkle.verified_documents(table).collect()
    claimed = sum(r["folded_root"] != f"folded {r['leaf']}" for r in found)
    assert len(found) == 40 and all(r["folded_root"].startswith("folded ") for r in found) and 0 < claimed < 40
