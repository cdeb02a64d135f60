"""Word tokens by ordered rules, and noun forms by rules of detachment, as built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DIGIT, SPACE, WORD

_EDGE_BEFORE, _EDGE_AFTER = f"(?<!{WORD})", f"(?!{WORD})"

# The word tokenizer's rules in their order, as (pattern, replacement).
OPENING = (
    ("([«“‘„]|`+)", " $1 "),
    ('^"', "``"),
    ("(``)", " $1 "),
    (r"""([ (\[{<])("|'{2})""", "$1 `` "),
    (rf"(?i)(')(?!re|ve|ll|m|t|s|d|n)({WORD}){_EDGE_AFTER}", "$1 $2"),
)
MARKS = (
    (rf"""([^.])(\.)([\])}}>"'»”’ ]*){SPACE}*$""", "$1 $2 $3 "),
    (rf"([:,])((?!{DIGIT})(?s:.))", " $1 $2"),
    ("([:,])$", " $1 "),
    (r"\.{2,}", " $0 "),
    ("[;@#$%&]", " $0 "),
    (rf"""([^.])(\.)([\])}}>"']*){SPACE}*$""", "$1 $2$3 "),
    ("[?!]", " $0 "),
    ("([^'])' ", "$1 ' "),
    ("[*]", " $0 "),
    (r"[\]\[(){}<>]", " $0 "),
    ("--", " -- "),
)
CLOSING = (
    ("([»”’])", " $1 "),
    ("''", " '' "),
    ('"', " '' "),
    (f"{SPACE}+", " "),
    ("([^' ])('[sS]|'[mM]|'[dD]|') ", "$1 $2 "),
    ("([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
)
JOINED = tuple((f"(?i){_EDGE_BEFORE}({a})({b}){_EDGE_AFTER}", " $1 $2 ") for a, b in (("can", "not"), ("d", "'ye"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("more", "'n"))) + (
    (f"(?i){_EDGE_BEFORE}(wan)(na)(?={SPACE})", " $1 $2 "),
    (f"(?i) ('t)(is){_EDGE_AFTER}", " $1 $2 "),
    (f"(?i) ('t)(was){_EDGE_AFTER}", " $1 $2 "),
)


#: The rules that may apply to a text without ASCII punctuation. The contractions are whole words and none makes another, so one pass finds them all.
ASCII_MARK = r"[!-/:-@\[-^`{-~]"
_HALVES = (("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"))
BARE = (
    ("([«“‘„»”’])", " $1 "),
    (f"{SPACE}+", " "),
    (f"(?i)(?=[cglw]){_EDGE_BEFORE}(?:(?:" + "|".join(f"({a})({b})" for a, b in _HALVES) + f"){_EDGE_AFTER}|(wan)(na)(?={SPACE}))", " $1$3$5$7$9$11 $2$4$6$8$10$12 "),
)


def word_tokens(c: Column) -> Column:
    """Words and marks of one sentence, in order: quotes, brackets, dashes and a final stop stand alone, contractions are cut. Null gives null, white space none."""
    replaced = lambda x, rules: reduce(lambda y, r: F.regexp_replace(y, r[0], r[1]), rules, x)
    framed = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    spaced = F.when(c.rlike(ASCII_MARK), replaced(framed(replaced(c, OPENING + MARKS)), CLOSING + JOINED)).otherwise(replaced(framed(c), BARE))
    return F.filter(F.split(spaced, f"{SPACE}+"), lambda w: w != "")


def vector_terms(tokens: Column) -> Column:
    """The terms that a vectoriser finds in tokens: runs of at least two letters, numbers and underscores."""
    return F.flatten(F.transform(tokens, lambda t: F.regexp_extract_all(t, F.lit(f"{WORD}{{2,}}"), F.lit(0))))


# Endings of English noun plurals, each with what replaces it.
DETACHED = (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"))


def detached(c: Column) -> Column:
    """Every form that one ending's replacement makes of a word."""
    made = F.array(*[F.when(c.endswith(old), F.concat(F.left(c, F.length(c) - len(old)), F.lit(new))) for old, new in DETACHED])
    return F.filter(made, lambda x: x.isNotNull())
