from gridlode.functions import match


def test_states_of_different_forms_meet(spark):
    companies = spark.createDataFrame([(1, "ALPHA", "X", "NEBRASKA"), (2, "BETA", "X", "ne"), (3, "ALPHA", "X", "Iowa"), (4, "BETA", "X", None)], "id long, company string, site string, state string")
    facilities = spark.createDataFrame([(10, "ALPHA", "Y", "NE"), (20, "BETA", "Y", "Nebraska"), (30, "ALPHA", "Y", "Texas")], "fid long, facility string, city string, state string")
    got = {r["id"]: (r["fid"], r["score"]) for r in match.best_facilities(companies, facilities).collect()}
    # an empty state text is held by every other
    assert got == {1: (10, 60), 2: (20, 60), 4: (20, 60)}


def test_pairs_by_state_are_those_of_the_rule(spark):
    states = ["Nebraska", "NE", "ne", "Iowa", "IA", "Indiana", "North Dakota", "", None, "Minnesota", "MI"]
    a = spark.createDataFrame(list(enumerate(states)), "id long, state string")
    b = spark.createDataFrame(list(enumerate(states)), "fid long, state string")
    want = {tuple(r) for r in a.crossJoin(b.withColumnRenamed("state", "there")).where(match.same_state("state", "there")).select("id", "fid").collect()}
    joined = match.in_same_state(a, b)
    assert sorted(map(tuple, joined.select("id", "fid").collect())) == sorted(want)
