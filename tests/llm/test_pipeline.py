"""The pipeline, stage by stage, against brute force on a small corpus with copies, near copies, leaks and junk."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_operators import brute_groups, edit_distance

import corpus_pipeline
from gridlode.llm import common, decontaminate, mixing, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark):
    """A folder of documents, labels and benchmark."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(12))) for i in range(4)] + [(9, None), (10, "tiny")]
    good = [[word() for _ in range(60)] for _ in range(90)]
    for i in range(60, 70):
        good[i] = list(good[i - 60])  # exact copies
    for i in range(70, 80):
        good[i] = [*good[i - 60][:59], "changed"]  # near copies
    for i in range(80, 86):
        good[i][20:20] = items[i % 4][1].upper().split()  # leaks
    texts = [" ".join(w) for w in good] + [" ".join(word().upper() + "!!" for _ in range(60)) for _ in range(60)]
    docs = [(i, t, "en", [None, "a", "b", "c", "d"][i % 5], len(t)) for i, t in enumerate(texts)]
    docs += [(500, None, None, None, None), (501, "", "en", "a", 0), (502, None, None, "b", None)]
    labels = [(i, int(i < 90), 0) for i in range(150)]
    path = common.fresh_path(spark, "corpus")
    for name, rows, schema in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("benchmark", items, "item_id long, text string"),
    ):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/{name}.parquet")
    return path, docs, items


def brute_quality(spark, path, rows):
    labels = spark.read.parquet(f"{path}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(spark.read.parquet(f"{path}/documents.parquet"), labels)
    return [x for x in rows if model.score([x[1]])[0] >= quality.CUT]


def brute_exact(rows):
    last = {}
    for x in rows:
        last[x[1] or ""] = max(x, last.get(x[1] or "", x), key=lambda y: y[0])
    return sorted(last.values(), key=lambda x: x[0])


def brute_near(rows):
    return [rows[min(members)] for members in brute_groups(rows, 80)[1].values()]


def brute_leaks(rows, items):
    wanted = [p for _, q in items if int(decontaminate.RATE * len(p := decontaminate.normalise(q)))]
    return [x for x in rows if not any(edit_distance(p, decontaminate.normalise(x[1])) <= int(decontaminate.RATE * len(p)) for p in wanted)]


def test_pipeline_against_brute_force(spark, corpus):
    path, docs, items = corpus
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "near_dedup", "decontaminate", "mix_sources"]
    rows = brute_quality(spark, path, docs)
    assert {x[0] for x in rows} >= set(range(90)) and not {x[0] for x in rows} & set(range(90, 150))
    for stage in (brute_exact, brute_near, lambda rows: brute_leaks(rows, items)):
        before, rows = len(rows), stage(rows)
        assert 0 < len(rows) < before
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=COLUMNS))
    mixed = {d: (source_size, target, taken) for d, _, source_size, target, taken in con.execute(mixing.ORACLE).fetchall() if taken > 0}
    got = corpus_pipeline.run(spark, path)
    assert got.columns == [*COLUMNS, "source_size", "target", "taken"]
    got = {x["doc_id"]: tuple(x) for x in got.collect()}
    assert {d: x[:5] for d, x in got.items()} == {x[0]: x for x in rows if x[0] in mixed}
    for d, want in mixed.items():
        assert got[d][5:] == pytest.approx(want), d


def test_pipeline_on_an_empty_table(spark, corpus):
    path, docs, _ = corpus
    none = spark.read.parquet(f"{path}/documents.parquet").where("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, path).count() == 0
