"""Numbered paragraphs: filters, forward fill, continuation merging, keys and articles.

Input rows are (celex, seq, para_num, text): seq is the order on the page, para_num may be null. Every window is within a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DASHES = ("–", "—")
SIGNATURES = "[Signatures]"


def in_order():
    return Window.partitionBy("celex").orderBy("seq")


def without_marks(rows: DataFrame) -> DataFrame:
    """Drop dash rows and signatures; a row without a number or text stays."""
    keep = F.coalesce(~F.col("para_num").isin(*DASHES), F.lit(True)) & F.coalesce(F.col("text") != SIGNATURES, F.lit(True))
    return rows.where(keep)


def from_first_paragraph(rows: DataFrame) -> DataFrame:
    """Rows from a document's first paragraph numbered 1 on; a document without one gives no rows."""
    first = F.min(F.when(F.col("para_num") == "1", F.col("seq"))).over(Window.partitionBy("celex"))
    return rows.withColumn("_first", first).where(F.col("seq") >= F.col("_first")).drop("_first")


def merge_continuations(rows: DataFrame, header: str = "is_header", separator: str = " ", keep: tuple[str, ...] = ()) -> DataFrame:
    """Join every row that is no header to the text of the last header before it; rows before any header are dropped. keep: columns alike in all of a document's rows."""
    island = F.sum(F.col(header).cast("int")).over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    grouped = rows.withColumn("_island", island).where("_island > 0").groupBy("celex", "_island")
    parts = F.sort_array(F.collect_list(F.struct("seq", "para_num", "text")))
    merged = grouped.agg(parts.alias("_parts"), *[F.first(c).alias(c) for c in keep])
    text = F.array_join(F.transform("_parts", lambda x: x["text"]), separator)
    return merged.select("celex", F.col("_parts")[0]["seq"].alias("seq"), F.col("_parts")[0]["para_num"].alias("para_num"), text.alias("text"), *keep)


def fill_numbers(rows: DataFrame) -> DataFrame:
    """para int: the row's own number, else the last one before it; null before the first. error: a number that is none.

    Numbers may be written as decimals and are cut to whole ones.
    """
    raw = F.nullif(F.col("para_num"), F.lit(""))
    number = F.expr("try_cast(nullif(para_num, '') AS DOUBLE)")
    filled = F.last(number, ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    error = F.when(raw.isNotNull() & number.isNull(), F.concat(F.lit("not a number: "), raw))
    return rows.withColumns({"para": filled.cast("int"), "number_error": error})


def keyed(rows: DataFrame) -> DataFrame:
    """(celex, key, text, seq): `para_celex`, or `para_i_celex` where a number has several rows, i counting them from 1."""
    w = Window.partitionBy("celex", "para")
    counted = rows.where("para is not null").withColumns({"_n": F.count("*").over(w), "_i": F.row_number().over(w.orderBy("seq"))})
    first = F.min("seq").over(w)
    key = F.when(F.col("_n") > 1, F.concat_ws("_", "para", "_i", "celex")).otherwise(F.concat_ws("_", "para", "celex"))
    return counted.select("celex", key.alias("key"), "text", "seq", first.alias("group_seq"))


def operative_only(keys: DataFrame) -> DataFrame:
    """Keys of exactly three parts: numbers with several rows."""
    return keys.where(F.size(F.split("key", "_")) == 3)


def articles(keys: DataFrame, separator: str = " ") -> DataFrame:
    """(celex, text): a document's paragraphs in one string, numbers in order of appearance."""
    parts = F.sort_array(F.collect_list(F.struct("group_seq", "seq", "text")))
    return keys.groupBy("celex").agg(F.array_join(F.transform(parts, lambda x: x["text"]), separator).alias("text"))
