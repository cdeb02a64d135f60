"""The driver's tables seen as a legal corpus, for Spark and, word for word, for SQL.

Orders are cases, parts legislation, suppliers subjects; line items are citations and subject assignments; conversations are documents of
numbered paragraphs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph

SQL = """
leg AS (SELECT p_partkey, (CASE WHEN p_size > 45 THEN '1' ELSE '3' END) || p_partkey AS id FROM part),
case_node AS (SELECT '6' || o_orderkey AS id FROM orders),
leg_node AS (SELECT id FROM leg),
citations AS (
  SELECT '6' || l_orderkey AS source, id AS target FROM lineitem JOIN leg ON l_partkey = p_partkey WHERE l_quantity >= 40
  UNION ALL
  SELECT '6' || o_orderkey, '6' || prev FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders) WHERE prev IS NOT NULL
  UNION ALL
  SELECT id, prev FROM (SELECT leg.id, lag(leg.id) OVER (PARTITION BY p_brand ORDER BY part.p_partkey) AS prev FROM part JOIN leg ON leg.p_partkey = part.p_partkey) WHERE prev IS NOT NULL),
subjects AS (
  SELECT '6' || l_orderkey AS source, 'S' || l_suppkey AS target FROM lineitem WHERE l_quantity >= 48
  UNION ALL
  SELECT id, 'S' || l_suppkey FROM lineitem JOIN leg ON l_partkey = p_partkey WHERE l_quantity >= 48),
cc AS (SELECT DISTINCT source, target FROM citations WHERE source LIKE '6%' AND target LIKE '6%' AND source IN (SELECT id FROM case_node) AND target IN (SELECT id FROM case_node)),
cl AS (SELECT DISTINCT source, target FROM citations WHERE source LIKE '6%' AND (target LIKE '3%' OR target LIKE '1%') AND source IN (SELECT id FROM case_node) AND target IN (SELECT id FROM leg_node)),
cs AS (SELECT DISTINCT source, target FROM subjects WHERE source LIKE '6%' AND source IN (SELECT id FROM case_node)),
ll AS (SELECT DISTINCT source, target FROM citations WHERE (source LIKE '3%' OR source LIKE '1%') AND (target LIKE '3%' OR target LIKE '1%') AND source IN (SELECT id FROM leg_node) AND target IN (SELECT id FROM leg_node)),
ls AS (SELECT DISTINCT source, target FROM subjects WHERE (source LIKE '3%' OR source LIKE '1%') AND source IN (SELECT id FROM leg_node)),
graph AS (
  SELECT 'case' AS src_type, 'cites' AS rel, 'case' AS dst_type, source, target FROM cc
  UNION ALL SELECT 'case', 'cites', 'legislation', source, target FROM cl
  UNION ALL SELECT 'legislation', 'cited_by', 'case', target, source FROM cl
  UNION ALL SELECT 'case', 'has_subject', 'subject_matter', source, target FROM cs
  UNION ALL SELECT 'subject_matter', 'related_to', 'case', target, source FROM cs
  UNION ALL SELECT 'legislation', 'cites', 'legislation', source, target FROM ll
  UNION ALL SELECT 'legislation', 'has_subject', 'subject_matter', source, target FROM ls
  UNION ALL SELECT 'subject_matter', 'related_to', 'legislation', target, source FROM ls),
nodes AS (SELECT DISTINCT src_type AS type, source AS id FROM graph UNION SELECT dst_type, target FROM graph),
idx AS (SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY id) - 1 AS idx FROM nodes),
paras AS (SELECT CAST(conv_id AS VARCHAR) AS celex, CAST(turn AS INTEGER) AS seq, CASE WHEN turn % 3 = 0 THEN CAST(turn // 3 + 1 AS VARCHAR) END AS para_num, text FROM conversations),
filled AS (SELECT *, CAST(last_value(CAST(para_num AS INTEGER) IGNORE NULLS) OVER (PARTITION BY celex ORDER BY seq) AS INTEGER) AS para FROM paras),
keys AS (
  SELECT celex, CASE WHEN count(*) OVER w > 1 THEN para || '_' || row_number() OVER (PARTITION BY celex, para ORDER BY seq) || '_' || celex ELSE para || '_' || celex END AS key, text, seq,
    min(seq) OVER w AS group_seq FROM filled WHERE para IS NOT NULL WINDOW w AS (PARTITION BY celex, para))
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Corpus:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    def legislation(self) -> DataFrame:
        return self.part.select("p_partkey", "p_brand", F.concat(F.when(F.col("p_size") > 45, "1").otherwise("3"), F.col("p_partkey").cast("string")).alias("id"))

    def case_ids(self) -> DataFrame:
        return self.orders.select(_case("o_orderkey").alias("id"))

    def leg_ids(self) -> DataFrame:
        return self.legislation().select("id")

    def parts(self) -> int:
        """Into how many parts joins of line items are dealt."""
        return graph.parts_of(self.lineitem)

    def with_legislation(self, items: DataFrame) -> DataFrame:
        """Line items with their part's legislation."""
        n = self.parts()
        return graph.dealt(items, n, "l_partkey").join(graph.listed(graph.dealt(self.legislation(), n, "p_partkey")), F.col("l_partkey") == F.col("p_partkey"))

    def case_acts(self) -> DataFrame:
        return self.with_legislation(self.lineitem.where("l_quantity >= 40").select("l_orderkey", "l_partkey")).select(_case("l_orderkey").alias("source"), F.col("id").alias("target"))

    def case_cases(self) -> DataFrame:
        before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
        return self.orders.select("o_orderkey", before.alias("prev")).where("prev is not null").select(_case("o_orderkey").alias("source"), _case("prev").alias("target"))

    def act_acts(self) -> DataFrame:
        before = F.lag("id").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
        return self.legislation().select("id", before.alias("prev")).where("prev is not null").select(F.col("id").alias("source"), F.col("prev").alias("target"))

    def citations(self) -> DataFrame:
        return self.case_acts().unionByName(self.case_cases()).unionByName(self.act_acts())

    def subjects(self) -> DataFrame:
        items = self.lineitem.where("l_quantity >= 48").select("l_orderkey", "l_partkey", "l_suppkey").withColumn("target", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))
        mine = items.select(_case("l_orderkey").alias("source"), "target")
        return mine.unionByName(self.with_legislation(items.select("l_partkey", "target")).select(F.col("id").alias("source"), "target"))

    def paragraphs(self) -> DataFrame:
        number = F.when(F.col("turn") % 3 == 0, F.expr("turn div 3 + 1").cast("string"))
        return self.conversations.select(F.col("conv_id").cast("string").alias("celex"), F.col("turn").cast("int").alias("seq"), number.alias("para_num"), "text")


def _case(column: str):
    return F.concat(F.lit("6"), F.col(column).cast("string"))
