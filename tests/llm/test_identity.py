"""Rows keep their numbers when executors come or go, and extra columns keep their values whatever they are called."""

import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import corpus_pipeline
from gridlode.llm import common, decontaminate, exact_dedup, lm_score, near_dedup, quality, token_counts, warc

CLASHES = ["_rid", "_rid_", "_file", "_index", "_number", "_size", "_h", "_key", "_whole", "_cut", "_rest", "_at_cut", "kept", "score", "level"]


def texts(n=220):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    out = [" ".join(word() for _ in range(r.randint(6, 60))) for _ in range(n)]
    for i in range(0, n, 4):
        out[i] = out[(i * 7) % 40]
        if i % 8 and len(out[i].split()) > 45:
            out[i] = out[i].rsplit(" ", 1)[0] + " changed"
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    """Nine files of documents with columns named like inner ones, and pages of the same texts."""
    rows = [(i, t, "en", "abc"[i % 3], len(t), *[f"{c}{i}" for c in CLASHES]) for i, t in enumerate(texts())]
    path = common.fresh_path(spark, "corpus")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    spark.createDataFrame(rows, schema).repartition(9).write.parquet(path)
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(len(rows))], "doc_id long, label int")
    bench = spark.createDataFrame([(1, rows[9][1]), (2, rows[14][1])], "item_id long, text string")
    return path, labels, bench


@pytest.fixture
def unsteady(spark, monkeypatch):
    """Before each checkpoint and each written table, files are dealt out to tasks in another way."""
    count, plain = [0], DataFrame.checkpoint

    def flip():
        count[0] += 1
        spark.conf.set("spark.sql.files.minPartitionNum", [1, 16, 3][count[0] % 3])
        spark.conf.set("spark.sql.files.openCostInBytes", ["1", "4m"][count[0] % 2])

    def checkpoint(self, *a, **k):
        flip()
        return plain(self, *a, **k)

    yield lambda: monkeypatch.setattr(DataFrame, "checkpoint", checkpoint)
    spark.conf.unset("spark.sql.files.minPartitionNum")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows_of(df):
    return Counter(str(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in df.collect())


def test_numbers_stay(spark, corpus):
    docs, seen = spark.read.parquet(corpus[0]), []
    try:
        for cost, least in (("1", 16), ("4m", 1)):
            spark.conf.set("spark.sql.files.openCostInBytes", cost)
            spark.conf.set("spark.sql.files.minPartitionNum", least)
            found = {r["doc_id"]: r["_rid"] for r in common.with_row_id(spark.read.parquet(corpus[0]).select("doc_id", "text")).collect()}
            assert len(set(found.values())) == len(found) == docs.count()
            seen.append(found)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert seen[0] == seen[1]
    joined = docs.join(spark.range(3).withColumnRenamed("id", "doc_id"), "doc_id")  # no file: written first
    made = common.with_row_id(joined, "_number")
    assert made.columns.count("_number") == 1 and sorted(map(tuple, made.select("doc_id", "_number").collect())) == sorted(map(tuple, made.select("doc_id", "_number").collect()))


def shapes(docs):
    """Tables with several rows for a row of a file, each with its own number of rows."""
    spark = docs.sparkSession
    two = spark.range(2).withColumnRenamed("id", "k")
    keys = docs.select("doc_id").union(docs.select("doc_id"))
    return {
        "exploded": docs.select("*", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("e")),
        "crossed": docs.crossJoin(two),
        "joined": docs.join(keys, "doc_id"),
        "united": docs.union(docs),
        "conditional": docs.join(F.broadcast(two), F.col("k") < 5),
        "read twice": spark.read.parquet(*docs.inputFiles(), *docs.inputFiles()[:1]),
    }


@pytest.mark.parametrize("shape", ["exploded", "crossed", "joined", "united", "conditional", "read twice"])
def test_each_row_has_its_own_number(spark, corpus, shape):
    docs = shapes(spark.read.parquet(corpus[0]))[shape]
    numbered = common.with_row_id(docs)
    assert numbered.select("_rid").distinct().count() == numbered.count() == docs.count() > len(texts())


def test_stages_on_tables_that_repeat_rows(spark, corpus):
    rows = texts()
    for name in ("crossed", "united", "exploded"):
        docs = shapes(spark.read.parquet(corpus[0]))[name]
        assert exact_dedup.drop_exact(docs).count() == len(set(rows))
        groups = near_dedup.near_dedup(docs, 85)
        whole = near_dedup.near_dedup(spark.read.parquet(corpus[0]), 85)
        assert groups.where("kept").count() == whole.where("kept").count() == near_dedup.drop_near(docs, 85).count()


def test_plain_readings_are_not_written(spark, corpus):
    docs = spark.read.parquet(corpus[0])
    assert common._file_place(docs.select("doc_id", "text").where("doc_id > 3")) is not None
    assert common._file_place(spark.range(3).toDF("doc_id")) is None


def operators(spark, corpus):
    path, labels, bench = corpus
    read = lambda: spark.read.parquet(path)
    return {
        "op2": lambda: near_dedup.near_dedup(read(), 85),
        "op3": lambda: exact_dedup.exact_dedup(read()),
        "op4": lambda: lm_score.language_scores(read()),
        "op5": lambda: warc.round_trip(read().select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))),
        "op7": lambda: token_counts.count_tokens(read(), public_tokenizers.path("word_bpe_49k.json"), by_words=True),
        "exact": lambda: exact_dedup.drop_exact(read()),
        "near": lambda: near_dedup.drop_near(read()),
        "leaks": lambda: decontaminate.drop_leaks(read(), bench),
        "quality": lambda: quality.drop_low_quality(read(), labels),
    }


@pytest.mark.parametrize("name", ["op2", "op3", "op4", "op5", "op7", "exact", "near", "leaks", "quality"])
def test_results_stay(spark, corpus, unsteady, name):
    run = operators(spark, corpus)[name]
    want = rows_of(run())
    unsteady()
    assert rows_of(run()) == want and len(want) > 50


def test_extra_columns_stay(spark, corpus):
    docs = spark.read.parquet(corpus[0])
    all_texts = texts()
    for name in ("exact", "near", "leaks", "quality"):
        out = operators(spark, corpus)[name]()
        assert out.columns == docs.columns
        got = out.collect()
        assert 0 < len(got) <= len(all_texts) and all(r[c] == f"{c}{r['doc_id']}" for r in got for c in CLASHES)
    assert operators(spark, corpus)["exact"]().count() == len(set(all_texts))
    assert operators(spark, corpus)["leaks"]().count() == sum(t not in (all_texts[9], all_texts[14]) for t in all_texts)
    mixed = corpus_pipeline.mix(spark, docs.withColumn("Target", F.lit("mine")), "")
    assert mixed.columns == [*docs.columns, "source_size", "target", "taken"]
    assert all(r[c] == f"{c}{r['doc_id']}" and r["taken"] > 0 for r in mixed.collect() for c in CLASHES)


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
