"""Landed tables and files: ids, edges, titles, labels, hierarchies, paragraph citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean, last_segment, literal_list_to_json
from ..storage import EDGES

JUDGMENT_FORMS, JUDGMENT_TYPES, REFERENCE = ("JUDG",), ("CJ", "TJ", "FJ"), "REFER_PREL"
BINDINGS = T.StructType([T.StructField("results", T.StructType([T.StructField("bindings", T.ArrayType(T.MapType(T.StringType(), T.StructType([T.StructField("value", T.StringType())]))))]))])


def judgments(docs: DataFrame, year: str | None = None, limit: int | None = None, preliminary_ruling: bool = True) -> DataFrame:
    """Distinct (id) of judgments in docs(id, sector, year, form, type, procedure); one without a year or procedure never qualifies.

    A limit takes the first ids in order; 0 and None mean no limit.
    """
    got = docs.where((F.col("sector") == "6") & F.col("form").isin(*JUDGMENT_FORMS) & F.col("type").isin(*JUDGMENT_TYPES) & F.col("year").isNotNull() & F.col("procedure").isNotNull())
    got = got.where(F.col("procedure") == REFERENCE) if preliminary_ruling else got
    got = got.where(F.col("year") == year) if year is not None else got
    got = got.select("id").distinct()
    return got.orderBy("id").limit(limit) if limit else got


def legislation(docs: DataFrame, year: str | None = None, limit: int | None = None) -> DataFrame:
    got = docs.where((F.col("sector") == "3") & F.col("year").isNotNull())
    got = (got.where(F.col("year") == year) if year is not None else got).select("id").distinct()
    return got.orderBy("id").limit(limit) if limit else got


def ids_of_sector(docs: DataFrame, sector: str) -> DataFrame:
    return docs.where(F.col("sector") == sector).select("id").distinct()


def edges_of_sector(edges: DataFrame, sector: str, docs: DataFrame | None = None) -> DataFrame:
    """(source, target) bag of edges whose source is of a sector, targets cut to their last URI segment; with docs, cited works must be in docs(id)."""
    got = edges.where(F.col("source").startswith(sector)).select("source", last_segment(F.col("target")).alias("target"))
    return got.join(docs.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target") if docs is not None else got


def codes_of(edges: DataFrame, document: str) -> DataFrame:
    """(code) of one document: distinct URIs, then their last segments."""
    return edges.where(F.col("source") == document).select("target").distinct().select(last_segment(F.col("target")).alias("code"))


def title_of(titles: DataFrame, document: str) -> str | None:
    """The first title in order; None if there is none."""
    found = titles.where(F.col("id") == document).orderBy("title").limit(1).collect()
    return found[0]["title"] if found else None


def read_bindings(spark: SparkSession, path: str, source: str, target: str) -> DataFrame:
    """Edges from saved endpoint answers, one JSON document a file; an empty answer is an empty table with its columns."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", BINDINGS).alias("x"))
    return raw.select(F.explode("x.results.bindings").alias("b")).select(F.col("b")[source]["value"].alias("source"), F.col("b")[target]["value"].alias("target")).to(EDGES)


def read_titles(spark: SparkSession, path: str, cleaned: bool = True) -> DataFrame:
    """(id, title) of a JSON object of ids and titles."""
    got = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", T.MapType(T.StringType(), T.StringType()))).alias("id", "title"))
    return got.withColumn("title", clean(F.col("title"))) if cleaned else got


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("celex string, subject_matters array<string>").json(path, multiLine=True)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """(code) of an RDF/XML file's descriptions."""
    got = spark.read.format("xml").option("rowTag", "rdf:Description").schema("`_rdf:about` string").load(path)
    return got.select(last_segment(F.col("_rdf:about")).alias("code")).where("code is not null")


def subject_label(xml: str):
    """The English preferred label in an XML column."""
    return F.xpath_string(F.col(xml), F.lit('//*[local-name()="prefLabel" and @*[local-name()="lang"]="en"]/text()'))


def read_paragraph_citations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(paragraph_articles(paragraph, article), article_legislation(article, legislation)) of a CSV whose list columns are literals."""
    raw = spark.read.csv(path, header=True, escape='"', multiLine=True)
    pairs = F.from_json(literal_list_to_json(F.col("`Articles/Decision`")), T.ArrayType(T.ArrayType(T.StringType())))
    got = raw.select(F.col("id").alias("paragraph"), F.explode(pairs).alias("p")).select("paragraph", F.col("p")[0].alias("article"), F.col("p")[1].alias("legislation"))
    return got.select("paragraph", "article").distinct(), got.select("article", "legislation").distinct()


def inline_edges(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, EDGES)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(celex, body binary) of a folder of page files; the id is the file's name without its extension."""
    got = spark.read.format("binaryFile").load(path)
    return got.select(F.regexp_replace(last_segment(F.col("path")), r"\.[^.]*$", "").alias("celex"), F.col("content").alias("body"))


def write_checkpoint(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
