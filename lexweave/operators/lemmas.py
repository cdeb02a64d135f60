"""Noun lemmas by detachment, looked up in a lexicon by joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.words import detached

#: How often endings are taken off; more make no English word.
DEPTH = 4


def noun_lemmas(terms: DataFrame, lexicon: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """(term, lemma) for terms(term): a term's shortest form in lexicon(word).

    Forms are the term itself and what endings taken off once leave; only where none of these is in the lexicon, what endings taken off again leave. Of equally short ones that with fewer taken off comes
    first, then the least. A term in exceptions(term, lemma) has itself and those lemmas as its forms and no others. Terms without a form in the lexicon, null
    terms and null words give no row; repeated rows count once. Lexicon, exceptions and terms meet by key and are never collected or broadcast.
    """
    ready = terms.where(F.col("term").isNotNull()).select("term").distinct()
    irregular = exceptions.where("term is not null and lemma is not null").select("term", "lemma").distinct() if exceptions is not None else None
    regular = ready.join(irregular.select("term").hint("merge"), "term", "left_anti") if irregular is not None else ready
    forms, now = [F.array("term")], F.array("term")
    for _ in range(DEPTH):
        now = F.array_distinct(F.flatten(F.transform(now, detached)))
        forms.append(now)
    each = [regular.select("term", F.lit(depth).alias("depth"), F.explode(f).alias("form")) for depth, f in enumerate(forms)]
    if irregular is not None:
        odd = ready.join(irregular.hint("merge"), "term")
        each += [odd.select("term", F.lit(0).alias("depth"), F.col("term").alias("form")), odd.select("term", F.lit(1).alias("depth"), F.col("lemma").alias("form"))]
    known = reduce(DataFrame.unionByName, each).join(lexicon.where(F.col("word").isNotNull()).select(F.col("word").alias("form")).distinct().hint("merge"), "form")
    best = F.min(F.struct(F.greatest(F.col("depth"), F.lit(1)).alias("level"), F.length("form").alias("length"), "depth", "form"))
    return known.groupBy("term").agg(best.alias("best")).select("term", F.col("best.form").alias("lemma"))
