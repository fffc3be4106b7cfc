from gridlode.sources import files


def test_positions_run_on_over_partitions(spark):
    rows = spark.range(0, 100, 1, 7).where("id not between 15 and 40")  # partitions of different sizes, one of them empty
    kept = [r["id"] for r in rows.collect()]
    ids = lambda **at: [r["id"] for r in files.rows_between(rows, **at).collect()]
    assert ids() == kept
    assert ids(skip=20) == kept[20:]
    assert ids(skip=3, every=7) == kept[3::7]
    assert ids(skip=10, every=4, most=9) == kept[10::4][:9]
    assert ids(skip=1000) == [] and ids(most=0) == []
    assert files.rows_between(rows.where("1 = 0"), skip=1).count() == 0
