from pyspark.sql import functions as F

from lexweave.operators import html
from lexweave.operators import paragraphs as P

ONE = """<html><body><p class="coj-sum-title-1">x</p>
<table><col width="5%"/><col width="95%"/><tbody><tr><td>pre</td><td>amble</td></tr></tbody></table>
<table><col width="5%"><col width="95%"><tr><td> 1 </td><td> First Article 6 says </td></tr></table>
<table><col/><col/><col/><tr><td>more</td><td>still</td></tr></table>
<table><tr><td>plain</td></tr></table>
<table><col width="5%"/><col width="95%"/><tr><td>2</td><td>Second</td></tr></table>
<table><col width="5%"/><col width="95%"/><tr><td>–</td><td>dash</td></tr></table>
<table><col width="5%"/><col width="95%"/><tr><td></td><td>[Signatures]</td></tr></table>
<div><table><col width="5%"/><tr><td>9</td><td>nested</td></tr></table></div></body></html>"""
TWO = """<html><body><p class="C01PointnumeroteAltN"><a>1</a> One</p><p class="C02">goes on</p><p class="C04Titre1">Heading</p><p>bare</p>
<p class="C01PointnumeroteAltN">2 Two</p><p class="C01PointnumeroteAltN">unnumbered</p><p class="C01PointnumeroteAltN">3Three</p>
<p class="C09Dispositif">On those grounds</p><p class="C09Dispositif">rules</p></body></html>"""


def pages(spark):
    rows = [("A", ONE), ("B", TWO), ("C", "None of the requests returned " + TWO), ("D", "<p>unknown</p>"), ("E", None), ("F", TWO.replace("<p>bare</p>", "</body>").replace('<p class="C01PointnumeroteAltN">2', '<div><p class="C01PointnumeroteAltN">2') )]
    return spark.createDataFrame(rows, "celex string, body string")


def test_layouts(spark):
    got = {(r.celex, r.key): r.text for r in html.case_paragraphs(pages(spark).where("celex < 'F'"), process=False).collect()}
    assert got == {
        ("A", "1_A"): "First Article 6 says more still plain",
        ("A", "2_A"): "Second",
        ("B", "1_B"): "One  goes on  ",
        ("B", "2_B"): " Two   unnumbered  ",
        ("B", "3_1_B"): "Three  ",
        ("B", "3_2_B"): "On those grounds",
        ("B", "3_3_B"): "rules",
    }
    cleaned = {r.key: r.text for r in html.case_paragraphs(pages(spark).where("celex = 'A'")).collect()}
    assert cleaned["1_A"] == "First says more still plain"
    assert {r.key for r in html.case_paragraphs(pages(spark).where("celex = 'B'"), operative=True).collect()} == {"3_1_B", "3_2_B", "3_3_B"}


def test_repeated_and_deep_pages(spark):
    once = html.case_paragraphs(pages(spark).where("celex < 'C'"))
    twice = html.case_paragraphs(pages(spark).where("celex < 'C'").union(pages(spark).where("celex < 'C'")))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    deep = '<html><body class="sum-title-1">' + "<div>" * 5000 + '<table><col width="5%"><tr><td>1</td><td>x</td></tr></table>' + "</div>" * 5000
    nested = ONE.replace("Second", "<i>" * 3000 + "Second" + "</i>" * 3000)
    rows = spark.createDataFrame([("X", deep.replace('class="sum-title-1"', "") + 'class="sum-title-1"'), ("Y", nested)], "celex string, body string")
    got = html.extract(rows)
    assert got.where("error is not null").count() == 0 and got.where("celex = 'Y' and text = 'Second'").count() == 1


def test_broken_page_is_an_error_row(spark):
    got = html.extract(pages(spark).where("celex = 'F'")).collect()
    assert len(got) == 1 and "sibling" in got[0].error
    bad = spark.createDataFrame([("G", b"\xff\xfe")], "celex string, body binary")
    assert "UnicodeDecodeError" in html.extract(bad).first().error


def test_numbers(spark):
    rows = spark.createDataFrame([("d", 0, None, "a"), ("d", 1, "1", "b"), ("d", 2, "", "c"), ("d", 3, "2.0", "d"), ("d", 4, "x", "e")], "celex string, seq int, para_num string, text string")
    got = P.fill_numbers(rows).orderBy("seq").collect()
    assert [r.para for r in got] == [None, 1, 1, 2, 2] and [r.number_error is None for r in got] == [True] * 4 + [False]
    again = P.fill_numbers(P.fill_numbers(rows).select("celex", "seq", F.col("para").cast("string").alias("para_num"), "text")).orderBy("seq").collect()
    assert [r.para for r in again] == [r.para for r in got]
    assert {r.key for r in P.keyed(P.fill_numbers(rows)).collect()} == {"1_1_d", "1_2_d", "2_1_d", "2_2_d"}
    assert P.articles(P.keyed(P.fill_numbers(rows))).first().text == "b c d e"
