"""Extension: keep a table of distinct edges up to date from a stream of landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..storage import EDGES


def landed(spark, folder: str) -> DataFrame:
    return spark.readStream.schema(EDGES).parquet(folder)


def append_edges(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's new edges to the Parquet folder `table`; a batch that is run again adds nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates()
        try:
            fresh = fresh.join(spark.read.schema(EDGES).parquet(table), ["source", "target"], "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("append").parquet(table)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
