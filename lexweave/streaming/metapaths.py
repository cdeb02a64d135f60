"""A metapath's pairs kept up to date while edges come and go.

The table holds for each pair (start, end) how many paths join it, as a log of signed changes, and the edges likewise. A batch's net changes of edges are found
against the edges before it; then, step by step of the metapath, the changed edges of that step are joined with the edges after the batch on the steps before it and with those before the
batch on the steps after it. The sum over steps is exactly the change of the path counts, so a batch costs what it changes, and a pair appears and vanishes where its
count leaves or reaches zero. No path that didn't change is joined again.

Each batch writes folders of its own number and reads lower numbers alone, so a batch that is run again after a failure leaves the same table. Every COMPACT batches the
log is summed into a base.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..storage import discard, settle

#: label, the ends, whether the edge comes or goes, and its place among changes of the same edge.
CHANGES = "label string, source string, target string, added boolean, seq long"
_KEPT = {"edges": "label string, source string, target string, n long", "pairs": "start string, end string, n long"}
COMPACT = 16

#: A metapath: labels, each with whether it is followed from target to source.
Steps = list[tuple[str, bool]]


def landed(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """Changes as they land in a folder, at most `files` files a batch."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files).parquet(folder)


def _read(spark: SparkSession, path: str, fields: str, number: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"{fields}, {number} long").parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def state(spark: SparkSession, table: str, kind: str, before: int | None = None) -> DataFrame:
    """The edges (label, source, target, n = 1) or pairs (start, end, n) of the table, as they were before a batch if one is given."""
    fields = _KEPT[kind]
    base, log = _read(spark, f"{table}/{kind}-base", fields, "upto"), _read(spark, f"{table}/{kind}", fields, "batch")
    top = -1
    if base is not None:
        known = base if before is None else base.where(F.col("upto") < before)
        top = known.agg(F.max("upto")).first()[0]
        top = -1 if top is None else top
    parts = [] if base is None or top < 0 else [base.where(F.col("upto") == top).drop("upto")]
    if log is not None:
        later = log.where(F.col("batch") > top)
        parts.append((later if before is None else later.where(F.col("batch") < before)).drop("batch"))
    if not parts:
        return spark.createDataFrame([], fields)
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy(*[c for c in rows.columns if c != "n"]).agg(F.sum("n").alias("n")).where(F.col("n") > 0)


def _along(edges: DataFrame, step: tuple[str, bool]) -> DataFrame:
    label, back = step
    ends = ("target", "source") if back else ("source", "target")
    return edges.where(F.col("label") == label).select(F.col(ends[0]).alias("a"), F.col(ends[1]).alias("b"), "n")


def _joined(paths: DataFrame, edges: DataFrame, at: str) -> DataFrame:
    """paths(start, end, n) made longer by one step at their start or end; counts multiply, and paths of the same ends are added at once."""
    if at == "end":
        got = paths.join(edges.withColumnRenamed("n", "m"), paths.end == F.col("a")).select("start", F.col("b").alias("end"), (F.col("n") * F.col("m")).alias("n"))
    else:
        got = paths.join(edges.withColumnRenamed("n", "m"), paths.start == F.col("b")).select(F.col("a").alias("start"), "end", (F.col("n") * F.col("m")).alias("n"))
    return got.groupBy("start", "end").agg(F.sum("n").alias("n")).where(F.col("n") != 0)


def merge(changes: DataFrame, number: int, table: str, steps: Steps) -> None:
    """Apply a batch of changes(label, source, target, added, seq). Of several changes of one edge that of the largest seq counts, of equal ones an added; adding an edge that is there, or withdrawing one that isn't, and rows with a null change nothing."""
    spark = changes.sparkSession
    old = settle(state(spark, table, "edges", number), "metapath-edges")
    last = changes.dropna().groupBy("label", "source", "target").agg(F.max(F.struct("seq", "added")).alias("last")).select("label", "source", "target", "last.added")
    met = last.join(old.withColumnRenamed("n", "there"), ["label", "source", "target"], "left")
    sign = F.when(F.col("added") & F.col("there").isNull(), 1).when(~F.col("added") & F.col("there").isNotNull(), -1)
    delta = settle(met.select("label", "source", "target", sign.cast("long").alias("n")).where("n is not null"), "metapath-delta")
    new = old.unionByName(delta).groupBy("label", "source", "target").agg(F.sum("n").alias("n")).where("n > 0")
    grown = []
    for i, step in enumerate(steps):
        paths = _along(delta, step).select(F.col("a").alias("start"), F.col("b").alias("end"), "n")
        for after in steps[i + 1 :]:
            paths = _joined(paths, _along(old, after), "end")
        for before in steps[:i][::-1]:
            paths = _joined(paths, _along(new, before), "start")
        grown.append(paths)
    pairs = reduce(DataFrame.unionByName, grown).groupBy("start", "end").agg(F.sum("n").alias("n")).where("n <> 0")
    # The edges' own log is written last: until then the batch, run again, starts from the same state.
    pairs.write.mode("overwrite").parquet(f"{table}/pairs/batch={number}")
    delta.write.mode("overwrite").parquet(f"{table}/edges/batch={number}")
    discard(old, delta)
    if number % COMPACT == COMPACT - 1:
        for kind in _KEPT:
            state(spark, table, kind, number + 1).write.mode("overwrite").parquet(f"{table}/{kind}-base/upto={number}")


def maintain(stream: DataFrame, table: str, checkpoint: str, steps: Steps) -> StreamingQuery:
    """Apply what has landed, batch by batch; a table belongs to one checkpoint, which numbers its batches."""
    return stream.writeStream.foreachBatch(lambda batch, number: merge(batch, number, table, steps)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pairs(spark: SparkSession, table: str) -> DataFrame:
    """(start, end, n): pairs that at least one path joins, and how many do."""
    return state(spark, table, "pairs")
