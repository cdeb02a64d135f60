import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexweave.functions import text as X

EXAMPLES = [
    "See (1) and (a) and (vi) but (iii) here",
    "Order No 902/2089 was made",
    "paragraph 1 or paragraphs 1 and 9, paragraphs 1, 2, and 3 or Paragraphs 1 to 4",
    "Regulation 90/234; Regulation No 90/234; Council Regulation (EEC) No 90/234; Regulation (EC) No 90/234; Regulation [90/234]",
    "Article 6, Article 6e, Articles 6 and 7, Articles 6, 7e, and 8",
    "recital 6 recitals 6 and 7 recitals 6, 7 and 8",
    "Directive 990/2013 Directives 990/2013/EEC and 990/2013 Council Directive EEC 990/2013",
    "C-90/123 Case C-1/22 Cases C‑9/12",
    "on 21 July 2024 in 1990.",
    "EU:C:2023:908 OJ 2006 L 328, p. 59",
    "the the the court court. The the\tthe",
    "non breaking… space — dash_under 12. TFEU",
    "é é és été été",
    "   x\u001c \n y  ",
    "",
]


def plain(doc, collapse=True):
    """The cleaning chain, spelled again with Python's re."""
    doc = doc.replace("\xa0", " ")
    for p in X.CITATIONS:
        doc = re.sub(p, "", doc)
    doc = re.sub(r"[^\w\.\s]", "", doc.replace("…", ""))
    doc = re.sub(r"\d+", "", doc).replace("TFEU", "")
    doc = re.sub("  +", " ", doc.replace("\n", " "))
    return (re.sub(r"\b(\w+)(?:\s+\1)+\b", r"\1", doc) if collapse else doc).strip()


def test_clean_examples(spark):
    got = spark.createDataFrame([(x,) for x in EXAMPLES], "t string").select("t", X.clean(F.col("t")).alias("c"), X.clean(F.col("t"), False).alias("d")).collect()
    for r in got:
        assert r.c == plain(r.t), r.t
        assert r.d == plain(r.t, False), r.t


def test_clean_null(spark):
    assert spark.sql("SELECT CAST(NULL AS STRING) t").select(X.clean(F.col("t"))).first()[0] is None


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet="ab (1)./é,C-Article 6\n\t", max_size=40), min_size=30, max_size=60))
def test_clean_any(spark, texts):
    for r in spark.createDataFrame([(x,) for x in texts], "t string").select("t", X.clean(F.col("t")).alias("c")).collect():
        assert r.c == plain(r.t), r.t


def test_terms_and_codes(spark):
    row = spark.createDataFrame([("The Cat's  A hat,x",)], "t string").select(X.terms(F.col("t")).alias("a"), X.terms(F.col("t"), ["the"], 3).alias("b")).first()
    assert row.a == ["the", "cats", "hatx"] and row.b == ["cats", "hatx"]
    row = spark.createDataFrame([("01.10.20", "7", "http://x/y/z", "12th")], "a string, b string, c string, d string")
    row = row.select(X.code_parent(F.col("a")), X.code_parent(F.col("b")), X.last_segment(F.col("c")), X.leading_digits(F.col("d")), X.without_leading_digits(F.col("d"))).first()
    assert tuple(row) == ("01.10", None, "z", "12", "th")


def test_stop_words(spark):
    from lexweave.functions import text as X

    stop = X.stop_words(["Don't", "zebra"], X.english_stop_words())
    assert {"dont", "zebra", "the", "isnt"} <= set(stop) and stop == sorted(set(stop))
    got = spark.createDataFrame([("The zebra, I don't see!",), (None,)], "t string").select(X.joined_terms(X.terms(F.col("t"), stop))).collect()
    assert [r[0] for r in got] == ["see", None]
