from gridlode.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_old_rows_stay_where_new_ones_conflict(spark):
    got = {(r["cy"], r["cx"], r["depth_m"]): r["gid"] for r in catalog.QUERIES["ingest_keep_old"](spark, DATA).collect()}
    p = catalog.Views(spark, DATA).geo_points.selectExpr("cast(floor(latitude / 5) as long) cy", "cast(floor(longitude / 5) as long) cx", "depth_m", "gid").collect()
    old, new = {}, {}
    for r in p:
        key = (r["cy"], r["cx"], r["depth_m"])
        if r["gid"] % 2 == 0:
            old[key] = max(r["gid"], old.get(key, 0))
        else:
            new[key] = min(r["gid"], new.get(key, r["gid"]))
    assert old.keys() & new.keys() and new.keys() - old.keys()
    assert got == new | old


def test_half_of_the_rows_are_there_before(spark):
    # the stored rows come from a table of their own, not from an empty one
    plan = catalog.QUERIES["ingest_keep_first"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "Union" in plan
