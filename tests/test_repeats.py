from pyspark.sql import functions as F

from gridlode.operators import upsert


def test_repeats_need_the_name(spark):
    rows = [(1, "A", None, "TX"), (2, "B", None, "TX"), (3, "a", "", "tx"), (4, "A", "X", "TX"), (5, "B", "", "TX")]
    got = upsert.flag_repeats(spark.createDataFrame(rows, "i long, name string, city string, state string"), ["name", "city", "state"], [F.col("i")])
    assert [r["duplicate"] for r in got.orderBy("i").collect()] == [False, False, True, False, True]


def test_the_first_card_of_a_name_and_street_stays(spark):
    card = lambda name, operator, street: f'<div class="ui card"><div class="header">{name}</div><p>{operator}</p><p>{street}</p></div>'
    one = card("A", "first", "1 Road") + card("A", "second", "1 Road") + card("A", "third", "2 Road") + card("B", "fourth", "1 Road")
    pages = spark.createDataFrame([(1, one), (2, card("A", "fifth", "1 Road")), (3, None)], "page long, html string")
    got = upsert.first_cards(pages, "page").orderBy("page", "operator").collect()
    assert [(r["page"], r["operator"]) for r in got] == [(1, "first"), (1, "fourth"), (1, "third"), (2, "fifth")]


def test_card_texts_lose_spaces_only(spark):
    html = '<div class="ui card"><div class="header">A</div><p> Acme 33 </p><p>5 Road 5</p></div>'
    got = upsert.first_cards(spark.createDataFrame([(1, html)], "page long, html string"), "page").head()
    assert (got["name"], got["operator"], got["street"]) == ("A", "Acme 33", "5 Road 5")
