"""Fixed examples of tokens and lemmas."""

import pytest
from pyspark.sql import functions as F

from lexweave.functions import words
from lexweave.operators.lemmas import noun_lemmas

TOKENS = {
    "Good muffins cost $3.88 in New York.": "Good muffins cost $ 3.88 in New York .",
    "They'll save and invest more.": "They 'll save and invest more .",
    "hi, my name can't hello,": "hi , my name ca n't hello ,",
    '"We beat some pretty good teams to get here," he said.': "`` We beat some pretty good teams to get here , '' he said .",
    "I cannot, gimme 2,500 (or so)...": "I can not , gim me 2,500 ( or so ) ...",
    "'Tis wanna go -- it was 'twas": "'T is wan na go -- it was 't was",
    "the court's view: 10:30, dogs' bones": "the court 's view : 10:30 , dogs ' bones",
    "«Oui» “yes” l’arrêt": "« Oui » “ yes ” l ’ arrêt",
    "éCannot scannot gotta!": "éCannot scannot got ta !",
    "": "",
    " \t ": "",
}


def test_tokens(spark):
    df = spark.createDataFrame([(k,) for k in TOKENS] + [(None,)], "text string").select("text", words.word_tokens(F.col("text")).alias("t"))
    got = {r.text: r.t for r in df.collect()}
    assert got.pop(None) is None
    assert {k: " ".join(v) for k, v in got.items()} == TOKENS


def test_vector_terms(spark):
    row = spark.createDataFrame([(["l’arrêt", "a", "été–hiver", "x_1", "--", "é", "42"],)], "t array<string>").select(words.vector_terms(F.col("t")).alias("v")).first()
    assert row.v == ["arrêt", "été", "hiver", "x_1", "42"]


LEXICON = "court box church wish bus woman party wolf quiz men dog glass series law foot axis axe".split()
LEMMAS = {
    "courts": "court", "boxes": "box", "churches": "church", "wishes": "wish", "buses": "bus", "women": "woman", "parties": "party", "wolves": "wolf", "quizzes": None,
    "men": "men", "dog": "dog", "dogss": "dog", "glasses": "glass", "glass": "glass", "series": "series", "laws": "law", "feet": "foot", "axes": "axe", "xyz": None, "": None,
}


@pytest.mark.parametrize("irregular", [True, False])
def test_lemmas(spark, irregular):
    terms = spark.createDataFrame([(t,) for t in [*LEMMAS, "courts", None]], "term string")
    lexicon = spark.createDataFrame([(w,) for w in [*LEXICON, "dog", None]], "word string")
    odd = spark.createDataFrame([("feet", "foot"), ("axes", "axis"), ("axes", "axe"), ("feet", None)], "term string, lemma string") if irregular else None
    want = {t: w for t, w in LEMMAS.items() if w and (irregular or t != "feet")}
    assert {r.term: r.lemma for r in noun_lemmas(terms, lexicon, odd).collect()} == want
    assert noun_lemmas(terms.limit(0), lexicon, odd).count() == 0


BARE = [" cannot «gimme» wanna wanna» gonna\tgotta lemme", "éCannot scannot cannots CANNOT Wanna", "l’arrêt “ici” x_y cannot", "wanna", "cannot", "", "  ", " wanna na„so„"]


def test_texts_without_marks_take_the_short_rules_to_the_same_tokens(spark, monkeypatch):
    df = spark.createDataFrame([(x,) for x in BARE], "text string")
    short = df.select(words.word_tokens(F.col("text"))).collect()
    monkeypatch.setattr(words, "ASCII_MARK", "^|.")
    assert df.select(words.word_tokens(F.col("text"))).collect() == short


def test_texts_are_dealt_before_they_are_taken_apart_and_that_once(spark, data):
    from lexweave.plans import catalogue

    plan = catalogue.QUERIES["vector_term_counts"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.index("regexp_extract_all") < plan.index("RepartitionByExpression [doc_id")
