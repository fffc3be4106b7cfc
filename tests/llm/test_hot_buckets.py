"""Buckets with many unlike texts: no link is lost, and few candidates are made."""

import random
from collections import defaultdict

import pytest
from test_operators import check_near

from gridlode.llm import common, near_dedup


def template_texts(n, r):
    """Texts that share three fifths of their words, a tenth of them with a near copy."""
    common_words = [f"c{i}" for i in range(90)]
    out = [common_words + [f"t{k}x{j}" for j in range(60)] for k in range(n)]
    out += [[*out[k][:-1], "changed"] for k in range(0, n, 10)]
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def test_prefix_keys_part_templates_and_keep_links(spark):
    r = random.Random(1)
    sets = [set(r.sample(range(1000), 40)) | set(range(2000, 2060)) for _ in range(120)]
    for k in range(0, 120, 3):
        sets.append({*sorted(sets[k])[r.randrange(12) :], 5000 + k})
    rows = spark.createDataFrame([(i, len(s), i % 2 == 0, sorted(s)) for i, s in enumerate(sets)], "_rid long, size long, open boolean, s array<long>")
    for percent in (80, 85):
        keys = defaultdict(set)
        for row in near_dedup.prefix_keys(rows, percent).collect():
            keys[row["key"]].add(row["_rid"])
        met = {(a, b) for m in keys.values() for a in m for b in m if a < b}
        like = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
        assert like and {(a, b) for a, b in like if a % 2 == 0 or b % 2 == 0} <= met
    # a shared passage isn't among the rare ones: templates without near copies don't meet
    own = [(i, 100, True, [*range(60), *range(1000 * (i + 1), 1000 * (i + 1) + 40)]) for i in range(200)]
    kinds = "_rid long, size long, open boolean, s array<long>"
    assert near_dedup.prefix_keys(spark.createDataFrame(own, kinds), 85).count() == 0
    # sets that joined don't meet each other again
    copies = [(i, 100, False, [*range(100)]) for i in range(50)] + [(99, 100, True, [*range(50, 150)])]
    assert near_dedup._buckets(near_dedup.prefix_keys(spark.createDataFrame(copies, kinds), 85))[1].count() == 0


def test_templates_lose_no_link(spark, monkeypatch):
    rows = template_texts(90, random.Random(3))
    shipped = []
    plain = near_dedup._pairs
    monkeypatch.setattr(near_dedup, "_pairs", lambda members, percent: shipped.append(members.count()) or plain(members, percent))
    monkeypatch.setattr(near_dedup, "BUCKET", 3)
    monkeypatch.setattr(near_dedup, "CHUNK", 16)
    df = common.checkpoint(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    check_near(rows, near_dedup.near_dedup(df, 85).collect(), 85)
    # the second dealing ran, and its buckets hold the near copies only, not each text with each
    assert len(shipped) == 2 and shipped[1] <= 40 * len(rows)


def test_recall_on_documents(spark):
    """Against all pairs of the given documents that share any shingle."""
    import os

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no documents")
    docs = spark.read.parquet(path)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    check_near(rows, near_dedup.near_dedup(docs, 85).collect(), 85)


def test_long_members_make_smaller_chunks(spark, monkeypatch):
    rows = template_texts(60, random.Random(5))
    monkeypatch.setattr(near_dedup, "BUCKET", 3)
    monkeypatch.setattr(near_dedup, "CHUNK_SHINGLES", 1000)
    df = common.checkpoint(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    sets = spark.createDataFrame([(1, i, 146, True) for i in range(60)], "key long, _rid long, size long, open boolean")
    assert near_dedup._buckets(sets)[0].head()["most"] == 6
    check_near(rows, near_dedup.near_dedup(df, 85).collect(), 85)


def test_cells_count_all_elements(spark):
    sets = spark.createDataFrame([(i, 50, i % 3 == 0, [*range(i, i + 50)]) for i in range(90)], "_rid long, size long, open boolean, s array<long>").repartition(7)
    counts, opened = near_dedup.cell_counts(sets)
    assert counts.sum() == 90 * 50 and counts.max() >= 50 and 100 < opened.sum() <= 139
