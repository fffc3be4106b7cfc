"""Whole queries of the learned operators against plain versions, on tables with clashing columns, and on empty ones."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from gridlode.llm import features, language_id, mixing, pii, quality

SCHEMA = "doc_id long, text string, lang string, source string, label int, at string, x double, score double, held_out boolean, _d long, _rid long, spans string, size long"
CLASH = (7, "at", 1.5, -3.0, None, 9, 9, "spans", 4)
MASK = 0xFFFFFFFF
SALT = [int(s) for s in features._SALT]


def ngrams(chars, bits, orders):
    """The places of all hashed n-grams, one character after the other."""
    out = Counter()
    for n in orders:
        for s in range(len(chars) - n + 1):
            h = chars[s] * SALT[0] & MASK
            for k in range(1, n):
                h = ((h ^ h >> 15) * SALT[6] + chars[s + k] * SALT[k]) & MASK
            out[((h ^ h >> 13) * SALT[7] & MASK) >> 32 - bits] += 1
    return out


def inverse(tables):
    seen = Counter(f for t in tables for f in t)
    return lambda f: math.log((1 + len(tables)) / (1 + seen[f])) + 1


def unit(counts, idf):
    x = {f: math.log1p(n) * idf(f) for f, n in counts.items()}
    size = math.sqrt(sum(v * v for v in x.values())) or 1.0
    return {f: v / size for f, v in x.items()}


def fold(doc_id, folds):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % folds


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    alphabets = {"aa": "abcdefg", "bb": "efghijk", "cc": "жзиклмн", "": "uvwxyz"}
    out = []
    for i in range(80):
        lang = list(alphabets)[i % 4]
        word = lambda: "".join(r.choice(alphabets[lang]) for _ in range(r.randint(1, 6)))
        text = " ".join(word() for _ in range(r.randint(3, 40))) + ("." if i % 3 else " !!! ### !!!" * r.randint(1, 9))
        out.append((i, text.title() if i % 5 == 0 else text, lang, None, *CLASH))
    out += [(200, None, "aa", "s", *CLASH), (201, "", "aa", "s", *CLASH), (202, "12 34!", None, "s", *CLASH), (None, "abc abd", "bb", "s", *CLASH), (203, "abc def " * 4000, None, "t", *CLASH)]
    return out + [out[3], out[3]]


def test_language_id_against_a_plain_version(spark, rows):
    counts = lambda t: ngrams([ord(c) for c in (t or "").lower()], language_id.BITS, features.ORDERS)
    learning = [r for r in rows if fold(r[0], 4) != 2]
    idf = inverse([counts(r[1]) for r in learning])
    known = {(r[0], r[2]): r[1] for r in learning if r[0] is not None and r[2] is not None}
    kinds = sorted({lang for _, lang in known})
    vectors, labels = [], []
    for (_, lang), text in sorted(known.items()):
        x = unit(counts(text), idf)
        vectors.append((np.array(sorted(x), np.int32), np.array([x[f] for f in sorted(x)])))
        labels.append(kinds.index(lang))
    learn = [i for i in range(len(vectors)) if i % 5 != 4]
    w = language_id.follow_the_leader([vectors[i] for i in learn], np.array([labels[i] for i in learn]), len(kinds))
    logit = lambda at, x: [sum(v * w[f, k] for f, v in zip(at, x)) + w[-1, k] for k in range(len(kinds))]
    apart = [i for i in range(len(vectors)) if i % 5 == 4]
    heat = language_id.temperature(np.array([logit(*vectors[i]) for i in apart]), np.array([labels[i] for i in apart]))
    want = []
    for r in rows:
        x = unit(counts(r[1]), idf)
        e = [math.exp(v / heat) for v in logit(list(x), list(x.values()))]
        best = max(range(len(kinds)), key=e.__getitem__)
        named = any(c.isalpha() for c in r[1] or "")
        want.append((r[0] is None, r[0] or 0, fold(r[0], 4) == 2, kinds[best] if named else "und", pytest.approx(e[best] / sum(e) if named else 0.0, abs=2e-3)))
    got = language_id.identify(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    got = sorted((g["doc_id"] is None, g["doc_id"] or 0, g["held_out"], g["lang_pred"], g["score"]) for g in got)
    assert got == sorted(want, key=lambda v: v[:2]) and len({g[3] for g in got}) == 5


def test_quality_against_a_plain_version(spark, rows):
    shape = lambda c: c if c < 128 and not chr(c).isalnum() else 48 if 48 <= c < 58 else 65 if 65 <= c < 91 else 97

    def counts(t):
        chars = [ord(c) for c in t or ""]
        kinds = [shape(c) for c in chars]
        kinds = [k for i, k in enumerate(kinds) if not i or k != kinds[i - 1]]
        words = (t or "").split()
        same = sum(a == b for a, b in zip(words, words[1:]))
        return ngrams(chars, quality.BITS, features.ORDERS), ngrams(kinds, quality.SHAPE_BITS, (1, 2, 3, 4)), (same, len(words) - same)

    learning = [r for r in rows if fold(r[0], 5) != 0]
    tables = [counts(r[1]) for r in learning]
    idf_of, idf_shape = inverse([t[0] for t in tables]), inverse([t[1] for t in tables])

    def vector(t):
        one, two, both = counts(t)
        out = np.zeros(quality.WIDTH)
        for f, v in unit(one, idf_of).items():
            out[f] = v
        for f, v in unit(two, idf_shape).items():
            out[quality.CHARS + f] = v
        out[-2:] = np.sqrt(np.array(both) / max(1, sum(both)))
        return out

    marks = {i: int(i % 4 in (0, 1)) for i in range(0, 80, 2)} | {3: 2}
    known = sorted({(r[0], r[1]) for r in learning if marks.get(r[0]) in (0, 1)})
    x, y = np.array([vector(t) for _, t in known]), np.array([marks[i] for i, _ in known])
    assert 20 < len(known) <= quality.LATENT  # so few rows that the latent space is all that they span
    space = np.linalg.svd(x, full_matrices=False)[2].T
    size = lambda v: v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)
    base, want = size(x @ space), []
    for r in rows:
        near = base @ size(vector(r[1]) @ space)
        votes = sorted(zip(near, y), reverse=True)[: quality.NEIGHBOURS]
        weight = [max(n, 0.0) ** quality.POWER for n, _ in votes]
        score = sum(a * b for a, (_, b) in zip(weight, votes)) / sum(weight) if sum(weight) > 1e-9 else y.mean()
        want.append((r[0] is None, r[0] or 0, fold(r[0], 5) == 0, pytest.approx(score, abs=5e-3)))
    labels = spark.createDataFrame([*marks.items(), (4, None), (None, 1)], "doc_id long, label int")
    got = quality.quality(spark.createDataFrame(rows, SCHEMA).repartition(3), labels).collect()
    assert all(g["predicted"] == (g["score"] >= quality.CUT) for g in got)
    got = sorted((g["doc_id"] is None, g["doc_id"] or 0, g["held_out"], g["score"]) for g in got)
    assert got == sorted(want, key=lambda v: v[:2]) and len({round(g[3], 2) for g in got}) > 20


def test_clashing_columns_and_empty_tables(spark, rows, monkeypatch):
    monkeypatch.setattr(pii, "UPDATES", 4)  # any weights will do
    docs = spark.createDataFrame(rows, SCHEMA)
    plain = docs.select("doc_id", "text", "lang", "source")
    for run in (mixing.mix_sources, pii.find_personal_data):
        one, two = (sorted(map(tuple, run(d).collect()), key=repr) for d in (docs, plain))
        assert one == two and len(one) == len(rows)
        assert run(docs.where("1 = 0")).collect() == []
    none = docs.where("1 = 0")
    assert language_id.identify(none).count() == quality.quality(none, spark.createDataFrame([], "doc_id long, label int")).count() == 0
