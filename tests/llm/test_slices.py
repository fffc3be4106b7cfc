from gridlode.llm import decontaminate

EXACT = "the quick brown fox jumps over the lazy dog"
NEAR = "the quick brown fax jumps over the lazy dog"


def test_texts_of_one_item_in_several_slices(spark, monkeypatch):
    # a repeated document gives its rows each time, and each has the least distance over the item's texts
    docs = spark.createDataFrame([(1, f"x {EXACT} y"), (1, f"x {EXACT} y"), (2, f"z {NEAR}")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, EXACT), (7, NEAR), (7, NEAR.replace("dog", "cat"))] + [(i, f"item number {i} is about something else") for i in range(20, 30)], "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 50)
    assert len(decontaminate.slices_of(bench)) > 5
    assert sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect())) == whole == [(1, 7, 0), (1, 7, 0), (2, 7, 0)]


def test_a_common_text_does_not_fill_a_slice(spark, monkeypatch):
    bench = spark.createDataFrame([(i, EXACT) for i in range(200)] + [(5, EXACT)] * 500, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 2000)
    parts = [[tuple(r) for r in p.collect()] for p in decontaminate.slices_of(bench)]
    assert sorted(r for p in parts for r in p) == [(i, EXACT) for i in range(200)]
    assert max(sum(len(t) for _, t in p) for p in parts) <= 2000
