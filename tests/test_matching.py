"""Indexed matching gives the rows of all pairs, and makes few of them."""

import random

import pytest

from gridlode.functions import match
from gridlode.operators import matching


def score(company, site, facility, city):
    words = lambda t: [w for w in t.split(" ") if len(w) > 2]
    n = 50 * (company in facility or facility in company) + sum(10 if a == b else 5 if a in b or b in a else 0 for a in words(company) for b in words(facility))
    return n + 30 * (site in city or city in site) + sum(15 for a in words(site) for b in words(city) if a == b)


def same_state(a, b):
    a, b = (a or "").upper(), (b or "").upper()
    return b in a or a[:2] in b


def brute(companies, facilities, least=25):
    out = set()
    for i, company, site, state in companies:
        best = min(((-score(company, site, f, c), fid) for fid, f, c, s in facilities if same_state(state, s)), default=None)
        if best and -best[0] >= least:
            out.add((i, best[1], -best[0]))
    return out


COMPANY, FACILITY = "id long, company string, site string, state string", "fid long, facility string, city string, state string"


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_against_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(matching, "SLICE_BYTES", 400)
    r = random.Random(seed)
    words = ["CORN", "CORNER", "POET", "BIG", "BIGGER", "AL", "PRAIRIE", "PRA", "LAKE", "LAKES", "X", "GREEN", "GREENS"]
    text = lambda most: " ".join(r.choices(words, k=r.randint(0 if seed > 1 else 1, most)))
    states = ["NE", "Nebraska", "IA", "Iowa", "KS"] + (["", None] if seed > 2 else [])
    companies = [(i, text(3), text(2), r.choice(states)) for i in range(120)] + [(500, "POET", "LAKE", "NE"), (501, "POET", "LAKE", "NE")]
    facilities = [(i, text(3), text(2), r.choice(states)) for i in range(90)] + [(7, "POET POET", "LAKE", "NE"), (95, "", "", "NE"), (96, "", "LAKE", "IA"), (97, "POET", "", "IA")][: 4 if seed > 1 else 1]
    got = matching.best_facilities(spark.createDataFrame(companies, COMPANY), spark.createDataFrame(facilities, FACILITY)).collect()
    want = brute(companies, facilities)
    assert {tuple(x) for x in got} == want and len(got) == len(want) > 60


def test_few_pairs_are_made(spark):
    """A state of many companies whose names have little in common."""
    n = 3000
    names = spark.range(n).selectExpr("concat('NAME', id) as t").where("t not like '%9'")
    pairs = matching.text_pairs(names, spark.range(n).selectExpr("concat('NAME', id + 1000000) as t"), 50, 10, 5)
    # NAME1000005 holds NAME1, NAME10, NAME100, ...
    assert 0 < pairs.count() < 8 * n


def test_empty_sides(spark):
    none = spark.createDataFrame([], FACILITY)
    assert match.best_facilities(spark.createDataFrame([(1, "A", "B", "C")], COMPANY), none).count() == 0
    assert match.best_facilities(spark.createDataFrame([], COMPANY), spark.createDataFrame([(1, "A", "B", "C")], FACILITY)).count() == 0
