"""Text cleaning and term extraction, as built-in expressions only.

Character classes are spelled out because Java's \\w, \\d, \\s are ASCII by default: a word is a letter, a number or an underscore of any script.
"""

from __future__ import annotations

import string
from collections.abc import Iterable
from functools import reduce

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD, DIGIT = r"[\p{L}\p{N}_]", r"\p{Nd}"
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# The references a judgment's text is cleared of, in order.
CITATIONS = (
    r"\(([a-z]{1,2}|[0-9]{1,2})\)",
    r"Order No \d+\/\d+",
    r"(P|p)aragraph(s)? \d+((, \d+)*)?(,)?( (and|to) \d+)?",
    r"(Council )?Regulation (\((EC|EEC)\) )?(\[)?(No )?\d+\/\d+(\])?",
    r"Article(s)? \d+([a-z])?((, \d+([a-z])?)*)?(,)?( and \d+([a-z])?)?",
    r"(R|r)ecital(s)? \d+((, \d+)*)?(,)?( (and|to) \d+)?",
    r"(Council )?Directive(s)?( [A-Z]+)? \d+\/\d+(\/[A-Z]+)?((, \d+\/\d+(\/[A-Z]+)?)*)?(,)?( and \d+\/\d+(\/[A-Z]+)?)?",
    r"(Case(s)? )?C(-|‑)\d+\/\d+",
    r"\d{1,2} (January|February|March|April|May|June|July|August|September|October|November|December) \d{4}",
    r"EU:[A-Z]:\d{4}:\d+",
    r"OJ \d{4} (L|C) \d+, p\. \d+",
    r"\d{1,2}\.",
)


def strip_space(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def collapse_repeats(c: Column) -> Column:
    """`w w w` becomes `w`: one pass from the left, case counts."""
    return F.regexp_replace(c, rf"(?<!{WORD})({WORD}+)(?:{SPACE}+\1)+(?!{WORD})", "$1")


def clean(c: Column, collapse: bool = True) -> Column:
    """Remove legal references, numbers, marks and repeated words. Null stays null."""
    c = F.translate(c, "\u00a0", " ")
    c = reduce(lambda x, p: F.regexp_replace(x, p.replace(r"\d", DIGIT), ""), CITATIONS, c)
    c = F.replace(c, F.lit("…"), F.lit(""))
    c = F.regexp_replace(c, f"[^{WORD[1:-1]}.{SPACE[1:-1]}]", "")
    c = F.regexp_replace(c, f"{DIGIT}+", "")
    c = F.replace(c, F.lit("TFEU"), F.lit(""))
    c = F.regexp_replace(F.translate(c, "\n", " "), "  +", " ")
    return strip_space(collapse_repeats(c) if collapse else c)


def terms(c: Column, stop: list[str] | None = None, least: int = 2) -> Column:
    """Lower-cased words without ASCII punctuation, stop words and words shorter than `least`. Null gives null.

    stop: none by default; see stop_words().
    """
    words = F.split(F.translate(F.lower(c), string.punctuation, ""), f"{SPACE}+")
    words = F.filter(words, lambda w: F.length(w) >= least)
    if stop:
        words = F.filter(words, lambda w: ~w.isin(stop))
    return words


# Common English function words, as terms() spells words.
FUNCTION_WORDS = tuple(
    """a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down
    during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself
    no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then
    there these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours
    yourself yourselves""".split()
)


def stop_words(*lists: Iterable[str]) -> list[str]:
    """The union of stop lists in any spelling, as terms() spells words, sorted; FUNCTION_WORDS is always in it."""
    drop = str.maketrans("", "", string.punctuation)
    return sorted({w.lower().translate(drop) for words in (FUNCTION_WORDS, *lists) for w in words} - {""})


def english_stop_words() -> list[str]:
    """Spark's list; needs a session."""
    return StopWordsRemover.loadDefaultStopWords("english")


def joined_terms(c: Column) -> Column:
    """An array of terms as one text again."""
    return F.array_join(c, " ")


def last_segment(c: Column, mark: str = "/") -> Column:
    return F.substring_index(c, mark, -1)


def code_parent(c: Column) -> Column:
    """All but the last dotted segment; null for a code of one segment."""
    return F.when(c.contains("."), F.regexp_replace(c, r"\.[^.]*$", ""))


def is_numeric_root(c: Column) -> Column:
    return F.split_part(c, F.lit("."), F.lit(1)).rlike(r"^\p{N}+$")


def leading_digits(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, rf"^{DIGIT}+", 0), F.lit(""))


def without_leading_digits(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{DIGIT}+", "")


def plain_quotes(c: Column) -> Column:
    """Opening single quotes and long dashes as ASCII; then one pass over double spaces."""
    return F.replace(F.replace(F.replace(c, F.lit("‘"), F.lit("'")), F.lit("—"), F.lit("--")), F.lit("  "), F.lit(" "))


def literal_list_to_json(c: Column) -> Column:
    """A literal list of tuples or strings in single quotes, as JSON; quotes inside strings aren't expected."""
    return F.translate(F.translate(c, "()", "[]"), "'", '"')
