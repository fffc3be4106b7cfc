"""Runs against brute force over all periods, on small alphabets and on whole documents with planted runs."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridlode.llm import periodic_runs, registry


def brute_runs(s, least=6, times=4):
    """Every period by itself: the maximal stretches of words that equal the word q on, smallest periods only."""
    out, seen = [], set()
    for q in range(1, len(s) // times + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            start, length = i, j + q - i
            if j > i and length >= max(least, times * q) and (start, length) not in seen:
                seen.add((start, length))
                out.append((start, length, q))
            i = max(j, i + 1)
    return sorted(out)


def brute_plant(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def brute_row(doc_id, text):
    words = brute_plant(doc_id, (text or "").encode().split())
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines.encode()), sha(kept))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(2, 8), st.integers(2, 5))
def test_runs_of_follows_brute_force(s, least, times):
    assert periodic_runs.runs_of(s, least, times) == brute_runs(s, least, times)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=5), st.integers(1, 9)), max_size=8))
def test_runs_of_powers(blocks):
    s = [x for block, n in blocks for x in block * n]
    assert periodic_runs.runs_of(s) == brute_runs(s)


def test_gram_size():
    assert periodic_runs.gram_size(6, 4) == 5
    assert periodic_runs.gram_size(4, 2) == 2


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["Ä", "ä", "A", "a", "ß x"]
    out = [(i, r.choice([" ", "\t", " \n"]).join(r.choices(words, k=r.randint(0, 160)))) for i in range(150)]
    for i in range(150, 260):
        parts = [r.choices(words, k=r.randint(1, 9)) * r.randint(1, 8) for _ in range(r.randint(1, 6))]
        out.append((i, " ".join(w for p in parts for w in p)))
    out += [(300, None), (301, ""), (302, " \t\n"), (303, "a " * 6), (304, "a A " * 3), (305, "a " * 5), (None, "b c " * 8), (None, None)]
    out += [(310, "x y z " * 4000 + "x"), (311, "\v".join(["q"] * 7) + "  q"), (303, "a " * 6), (30, "one two " * 40)]
    return out


def test_whole_query_against_brute_force(spark, rows):
    docs = spark.createDataFrame([(*x, "e", 1) for x in rows], "doc_id long, text string, runs string, n_words int").repartition(5)
    got = periodic_runs.run_digests(periodic_runs.planted(docs))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for _, t in got.dtypes} == {"bigint", "string"}
    want = [brute_row(*x) for x in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(x[1] for x in want) > 150


def test_documents_against_brute_force(spark):
    data = "/root/testdata/sf0.001"
    want = [brute_row(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = registry.QUERIES["op13_periodic_runs"](spark, data)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_texts_and_spans(spark):
    docs = spark.createDataFrame([("k", "so so so so so so it was was was was was was")], "name string, text string")
    row = periodic_runs.find_runs(docs, "name").head()
    assert row["name"] == "k" and row["n_words"] == 13 and row["collapsed"] == "so it was"
    assert [tuple(x) for x in row["runs"]] == [(0, 6, 1), (7, 6, 1)]
    assert [tuple(x) for x in periodic_runs.find_runs(docs, "name", least=3, times=2).head()["runs"]] == [(0, 6, 1), (7, 6, 1)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.run_digests(periodic_runs.planted(empty)).collect() == []
