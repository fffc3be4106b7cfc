from pyspark.sql import functions as F

from gridlode.llm import features, language_id


def test_repeats_of_a_drawn_id_come_once(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("b").alias("text"), F.lit(1).alias("label"))
    hot = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("a"), F.col("id")).alias("text"), F.lit(1).alias("label"))
    got = features.bounded_sample(rows.unionByName(hot), "label", 60).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(50))
    assert {r["text"] for r in got if r["doc_id"] == 7} == {"a0"}
    assert len(features.bounded_sample(rows.unionByName(hot), "label", 20).collect()) == 20


def test_rare_labels_are_drawn(spark, monkeypatch):
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("the cat sat on the mat").alias("text"), F.lit("en").alias("lang"))
    few = spark.range(5000, 5003).select(F.col("id").alias("doc_id"), F.lit("какой прекрасный день").alias("text"), F.lit("ru").alias("lang"))
    rows = many.unionByName(few)
    assert {r["lang"] for r in features.bounded_sample(rows, "lang", 20).collect()} == {"en"}
    drawn = [r["lang"] for r in features.bounded_sample(rows, "lang", 20, 5).collect()]
    assert (drawn.count("en"), drawn.count("ru")) == (20, 3)
    monkeypatch.setattr(language_id, "SAMPLE", 20)
    assert language_id.fit(rows)[0] == ["en", "ru"]
