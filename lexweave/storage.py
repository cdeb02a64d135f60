"""Shared storage for intermediate tables, and the schemas of landed data."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

EDGES = T.StructType([T.StructField("source", T.StringType()), T.StructField("target", T.StringType())])
PARAGRAPHS = T.StructType([T.StructField("celex", T.StringType()), T.StructField("seq", T.IntegerType()), T.StructField("para_num", T.StringType()), T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one is set only where that is unset and the master is this machine, else ValueError."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = set_already.get() if set_already.isDefined() else None
    if not where:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lexweave-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


#: Whether Spark removes a query's shuffle files when it ends; otherwise they stay until the driver happens to collect its garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, which ends its lineage there: what was shuffled for it is removed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexweave/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANED, "false")
    spark.conf.set(CLEANED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANED, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*settled: DataFrame) -> None:
    """Delete settled tables that nothing will read again; a table of any other kind, or one not in the shared folder, stays."""
    for df in settled:
        spark = df.sparkSession
        base = f"{shared_dir(spark)}/lexweave/"
        for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            files = place.getFileSystem(spark._jsc.hadoopConfiguration())
            if place.toUri().getPath().startswith(spark._jvm.org.apache.hadoop.fs.Path(base).toUri().getPath()):
                files.delete(place, True)
