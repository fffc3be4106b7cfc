"""Short benchmark items, long numbers and texts, repeated rows, letters, and models against plain versions."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_operators import docs, edit_distance, lower_words, rows  # noqa: F401

import corpus_pipeline
from gridlode.llm import decontaminate, language_id, lm_score, pii, quality

LONG = "the quick brown fox jumps over the lazy dog and runs " * 6000


def test_short_items_match_as_whole_words(spark):
    items = [(1, "Forty-two!"), (2, "tiny"), (3, "未来は今日始まる"), (4, "..."), (5, "quick brown fox jumps over the lazy dog")]
    texts = [(1, "it is forty two, they say"), (2, "fortytwo tinyness"), (3, "a TINY one"), (4, "昨日の未来は今日始まると言う"), (5, None), (6, "quick brwn fox jumps over the lazy dog"), (3, "a TINY one"), (7, LONG + "tiny")]
    run = lambda: Counter(map(tuple, decontaminate.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()))
    want = Counter()
    for d, t in texts:
        plain = decontaminate.normalise(t)
        for i, q in items:
            p = decontaminate.normalise(q)
            if int(decontaminate.RATE * len(p)) and t:
                n = edit_distance(p, plain[:400])
                want.update([(d, i, n)] if n <= int(decontaminate.RATE * len(p)) else [])
            elif p and (f" {p} " in f" {plain} " or p[0] >= decontaminate.UNSPACED and p in plain):
                want.update([(d, i, 0)])
    assert run() == want and {i for _, i, _ in want} == {1, 2, 3, 5} and want[3, 2, 0] == 2


def test_numbers_of_any_length():
    zeros = "0" * 500
    t = f"x {zeros}1.2.3.4 y 1.{zeros}255.3.4 z 1.{zeros}256.3.4 {'9' * 600}.1.1.1"
    want = [(2, "ip", 509), (512, "ip", 1021)]
    assert [x for x in pii.base_spans(t) if x[1] == "ip"] == want
    assert pii.all_spans([(5, "ip", 9), (20, "card", 30)], [(0, "phone", 5), (8, "phone", 12), (9, "phone", 20), (29, "email", 40), (30, "email", 31)]) == [
        (0, "phone", 5), (5, "ip", 9), (9, "phone", 20), (20, "card", 30), (30, "email", 31)]


def test_windows_cover_whole_texts():
    t = "word " * 3000 + "mail me at jane.doe@example.org or 7 " + "word " * 3000 + "at 10.1.2.3 or 8"
    groups = defaultdict(list)
    for g, window, spans in pii.windows_of(t):
        assert len(window) <= pii.WINDOW
        groups[g].append((window, spans))
    assert [k for _, s in groups[0] for _, k, _ in s] == ["email", "ip"] and len(groups[1]) == 2 and len(groups[2]) == 2
    for window, spans in groups[0]:
        assert [window[a:b] for a, _, b in spans][0] in ("jane.doe@example.org", "10.1.2.3")


#: Written by hand, in ways that the patterns miss; not made by the functions that make training windows.
BY_HAND = {
    "email": ["write to jane.doe @ example.org today", "mail bob_smith@ mail.example.com now", "contact info @example.net please", "sales.team(@)example.de is ours", "reach kim.lee @ uni.example.edu or call"],
    "ip": ["host 192 . 168 . 1 . 7 is down", "server 10. 0. 0. 12 answered", "address 172[.]16[.]4[.]9 was blocked", "node 203 .0 .113 .5 failed", "from 198. 51. 100. 23 came a request"],
    "card": ["card 4111.1111.1111.1111 was charged", "visa 5500 - 0000 - 0000 - 0004 expired", "paid by 4012.8888.8888.1881 yesterday", "number 6011 - 1111 - 1111 - 1117 please", "card 5105.1051.0510.5100 declined"],
    "phone": ["call (415) 555-2671 after noon", "phone 212-555-0187 for help", "ring 303.555.0142 tomorrow", "dial (617)555 0199 first", "text 808-555-0123 to join"],
}


def test_added_spans_by_hand(spark):
    r, rng = random.Random(8), np.random.default_rng(8)
    word = lambda: "".join(r.choice("abcdefghilmnorstu") for _ in range(r.randint(2, 9)))
    found = []
    for i in range(600):
        w = [word() for _ in range(50)]
        w[r.randrange(50)] = pii.synthetic(pii.KINDS[i % 4], rng)
        if i % 2:
            w[r.randrange(50)] = str(r.randrange(10 ** r.randint(1, 6)))
        found.append((i, " ".join(w)))
    w = pii.fit(spark.createDataFrame(found, "doc_id long, text string"))
    caught = {k: sum(any(x[1] == k for x in pii.model_spans(w, [t])[0]) for t in ts) / len(ts) for k, ts in BY_HAND.items()}
    print("recall of added spans by kind:", caught)
    assert all(v >= 0.6 for v in caught.values()) and sum(caught.values()) >= 0.8 * 4
    for t in ("order 4111 - 1111 - 1111 - 1112 of today", "number 5927243074273351 of none", "part 300 . 1 . 1 . 1 is old"):
        assert not [x for x in pii.model_spans(w, [t])[0] if x[1] in ("card", "ip")]
    plain = [" ".join(word() for _ in range(30)) + f" {r.randrange(2000)} " + word() for _ in range(60)]
    assert sum(bool(x) for x in pii.model_spans(w, plain)) <= 3


def plain_scores(rows):
    """Deleted interpolation with dictionaries: score of each row."""
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % lm_score.FOLDS
    uni, bi, starts = ([Counter(), Counter()] for _ in range(3))
    seqs = [(fold(x[0]), [*lower_words(x[1]), None]) for x in rows]
    for f, w in seqs:
        if f != lm_score.TEST:
            k = int(f == lm_score.TUNE)
            uni[k].update(w)
            bi[k].update(zip(["START", *w], w))
            starts[k]["n"] += 1
    cells = Counter()
    tokens, types = sum(map(lambda c: sum(c.values()), uni)), len(uni[0] | uni[1])
    held = tokens - sum(uni[1].values())
    bucket = lambda c: math.frexp(c)[1] if c else 0
    for f, w in seqs:
        if f == lm_score.TUNE:
            for before, x in zip(["START", *w], w):
                c = starts[0]["n"] if before == "START" else uni[0][before]
                step = lambda p: round(math.log2(p) * lm_score.STEPS) if p > 0 else 9999
                cells[bucket(c), step(bi[0][before, x] / c if c else 0), step(uni[0][x] / max(held, 1))] += 1
    value = lambda q: 0.0 if q == 9999 else 2.0 ** (q / lm_score.STEPS)
    weights = {b: [1 / 3] * 3 if b else [0, 0.5, 0.5] for b in range(64)}
    for _ in range(lm_score.ROUNDS):
        new = {b: [0.1 if b else 0.0, 0.5, 0.5] for b in range(64)}
        for (b, two, one), n in cells.items():
            part = [weights[b][0] * value(two), weights[b][1] * value(one), weights[b][2] / (types + 1)]
            for k in range(3):
                new[b][k] += n * part[k] / max(sum(part), 1e-300)
        weights = {b: [x / sum(v) for x in v] for b, v in new.items()}
    all_uni, all_bi, docs_n = uni[0] + uni[1], bi[0] + bi[1], starts[0]["n"] + starts[1]["n"]
    out = []
    for (i, *_), (_, w) in zip(rows, seqs):
        total = 0.0
        for before, x in zip(["START", *w], w):
            c = docs_n if before == "START" else all_uni[before]
            a = weights[bucket(c)]
            total += math.log10(a[0] * (all_bi[before, x] / c if c else 0) + a[1] * all_uni[x] / max(tokens, 1) + a[2] / (types + 1))
        out.append((i, len(w), round(total, 3)))
    return Counter(out)


def test_scores_follow_the_plain_model(spark, docs, rows, monkeypatch):  # noqa: F811
    want = plain_scores(rows)
    scores = lambda: Counter((r["doc_id"], r["n_tokens"], round(r["score"], 3)) for r in lm_score.language_scores(docs).collect())
    close = lambda got: all(any(abs(s - t) <= 0.002 for j, m, t in got if (j, m) == (i, n)) for i, n, s in want) and got.total() == want.total()
    assert close(scores())
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(lm_score, "BUCKET_TOKENS", 500)
    monkeypatch.setattr(lm_score, "FAN", 4)  # requests are merged in several steps
    assert len(lm_score.tiers(200)) > 2 and close(scores())


def test_requests_to_a_bucket_are_few_at_any_size():
    for blocks in (1, 512, 513, 10**5, 10**9):
        steps = lm_score.tiers(blocks)
        assert all(a / b <= lm_score.FAN for a, b in zip([blocks, *steps], steps)) and ([blocks, *steps][-1] <= lm_score.FAN)


def test_only_letters_make_a_language(spark):
    rows = [(i, t, k) for i in range(80) for t, k in ((("the and of ing", "aa") if i % 2 else ("der und ung sch", "bb")),)]
    rows += [(900, "½ ² ① Ⅷ", "aa"), (901, "é", "aa"), (902, "字", None), (903, LONG, None), rows[0]]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert (got[900]["lang_pred"], got[900]["score"]) == ("und", 0.0)
    assert got[901]["lang_pred"] != "und" and got[902]["lang_pred"] != "und" and got[903]["lang_pred"] == "aa"


def test_blank_labels_are_labels(spark):
    rows = [(i, "the and of ing" if i % 2 else "xyz zzy qqx", "aa" if i % 2 else "") for i in range(80)]
    assert language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))[0] == ["", "aa"]


def test_leader_follows_the_plain_steps():
    r = np.random.default_rng(4)
    rows = [(np.sort(r.choice(50, 6, replace=False)).astype(np.int32), r.random(6)) for _ in range(40)]
    labels = r.integers(0, 3, 40)
    got = language_id.follow_the_leader(rows, labels, 3, 2)
    z, n, order = defaultdict(float), defaultdict(float), np.random.default_rng(3)
    bias = 1 << language_id.BITS

    def weight(f, k):
        a = z[f, k]
        if abs(a) <= language_id.L1:
            return 0.0
        return -(a - math.copysign(language_id.L1, a)) / ((language_id.BETA + math.sqrt(n[f, k])) / language_id.ALPHA + language_id.L2)

    for _ in range(2):
        for i in order.permutation(40):
            x = [*zip(rows[i][0].tolist(), rows[i][1].tolist()), (bias, 1.0)]
            w = {(f, k): weight(f, k) for f, _ in x for k in range(3)}
            e = [math.exp(sum(v * w[f, k] for f, v in x)) for k in range(3)]
            for f, v in x:
                for k in range(3):
                    g = v * (e[k] / sum(e) - (k == labels[i]))
                    z[f, k] += g - (math.sqrt(n[f, k] + g * g) - math.sqrt(n[f, k])) / language_id.ALPHA * w[f, k]
                    n[f, k] += g * g
    for f in (*range(50), bias):
        for k in range(3):
            assert got[f, k] == pytest.approx(weight(f, k), abs=1e-5)


def test_temperature_is_the_best_on_a_grid():
    r = np.random.default_rng(2)
    labels = r.integers(0, 3, 300)
    logits = 6 * r.standard_normal((300, 3)) + 4 * np.eye(3)[labels]
    loss = lambda t: -np.log(language_id.softmax(logits / t)[np.arange(300), labels] + 1e-12).mean()
    assert loss(language_id.temperature(logits, labels)) <= min(map(loss, np.geomspace(0.05, 20, 400))) + 1e-6


def test_quality_of_long_and_repeated_texts(spark):
    rows = [(i, LONG[: 40 * (i % 9 + 1)] if i % 2 else "!!! ??? " * (i % 7 + 1)) for i in range(80)] + [(500, LONG), (500, LONG)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, label int")
    got = [r["score"] for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect() if r["doc_id"] == 500]
    assert len(got) == 2 and got[0] == got[1] > 0.9


def test_stages_keep_one_of_repeated_rows(spark):
    rows = [(i, LONG[:900] + f" number {i % 3}", "en", "a", 5) for i in (1, 2, 2, 3, 3)] + [(9, LONG, "en", None, 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.keep_distinct(spark, df, "").collect())
    assert kept == [1, 2, 3, 9]
    assert len({r["text"] for r in corpus_pipeline.keep_unlike(spark, df, "").collect()}) == corpus_pipeline.keep_unlike(spark, df, "").count() >= 1
