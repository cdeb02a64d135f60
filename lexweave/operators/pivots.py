"""A stored exact index of unit vectors: blocks around pivots, ruled out by the triangle inequality.

Written once: each vector goes to its nearest pivot, and the vectors of a pivot, sorted by their distance to it, are cut into blocks. A block is one row, with the interval of its vectors'
distances to its own pivot and to REFERENCES reference pivots. Of any interval, |distance of the query - interval| is a lower bound of the
query's distance to every vector in the block.

Asked later: the facts of all blocks, MAX_BLOCKS at most, are read without the vectors. Each query meets the block it may be nearest to, then some more, then all others that
its k-th distance so far can't rule out; every step reads only the pivots' folders that some query needs. The answer is that of comparing with all vectors.

Pivots are a bounded sample (MAX_PIVOTS, by hash); which they are changes the work alone. All rows are in the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import normalised
from ..storage import discard, settle

MAX_PIVOTS, REFERENCES = 1024, 16
#: Vectors a block unless there would be more than MAX_BLOCKS blocks, and how many of these a query meets before the last step.
BLOCK, MAX_BLOCKS, STEPS = 1024, 1 << 16, (1, 8)
#: Queries that meet a block in one task.
ASKING = 20_000
#: How far apart bounds must be to rule a block out: distances near zero are only known to the root of a double's precision.
SLACK = 1e-6


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    gap = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(gap, 0))


def _rectangle(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(rows, -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


def _spread(pivots: np.ndarray, wanted: int) -> np.ndarray:
    """Numbers of pivots far from each other."""
    chosen = [0]
    near = _distances(pivots, pivots[:1])[:, 0]
    while len(chosen) < min(wanted, len(pivots)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(pivots, pivots[chosen[-1:]])[:, 0])
    return np.array(chosen)


def _block_fields(id_type: str) -> str:
    return f"pivot int, block long, n long, ids array<{id_type}>, vecs array<double>, low array<double>, high array<double>"


def build(vectors: DataFrame, id_col: str, vec_col: str, path: str, block: int = BLOCK) -> None:
    """Write an index of vectors of one length to `path`, a folder that all executors can reach; rows without a vector or with a null in it are left out, a zero vector is kept. An empty table makes an empty index."""
    rows = vectors.where(F.col(vec_col).isNotNull() & ~F.exists(vec_col, lambda x: x.isNull()))
    unit = settle(rows.select(F.col(id_col).alias("id"), normalised(F.col(vec_col)).alias("vec")), "pivots-units")
    n = unit.count()
    some = unit.where(F.exists("vec", lambda x: x != 0)).orderBy(F.xxhash64("vec"), "id").limit(int(min(MAX_PIVOTS, np.ceil(n**0.5)))).toArrow()
    pivots = _rectangle(some.column("vec").combine_chunks(), some.num_rows) if some.num_rows else np.zeros((1, 1))
    kind = unit.schema["id"].dataType.simpleString()
    unit.sparkSession.createDataFrame([(i, p.tolist(), kind) for i, p in enumerate(pivots)], "pivot int, vec array<double>, id_type string").coalesce(1).write.parquet(f"{path}/pivots")
    reference = _spread(pivots, REFERENCES)
    size = max(block, -(-n // (MAX_BLOCKS - len(pivots) - 1024)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                x = _rectangle(part.column("vec"), part.num_rows)
                gaps = _distances(x, pivots)
                own = gaps.argmin(axis=1)
                far = gaps[np.arange(len(x)), own]
                # A vector of zeros has no direction: no bound rules it out.
                own, g = np.where(x.any(axis=1), own, -1), np.c_[far, gaps[:, reference]]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("vec"), pa.array(own.astype(np.int32)), pa.array(far), _lists(g)], names=["id", "vec", "pivot", "far", "g"])

    dealt = unit.mapInArrow(placed, f"id {kind}, vec array<double>, pivot int, far double, g array<double>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, number = 0, TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            nonlocal number
            t = pa.Table.from_batches(held).combine_chunks()
            g = _rectangle(t.column("g").combine_chunks(), t.num_rows)
            number += 1
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            vec = t.column("vec").combine_chunks().flatten()
            return pa.RecordBatch.from_arrays([pa.array([t.column("pivot")[0].as_py()], pa.int32()), pa.array([number]), pa.array([t.num_rows]), one(t.column("id").combine_chunks()), one(vec), _lists(g.min(axis=0)[None]), _lists(g.max(axis=0)[None])], names=names)

        for part in batches:
            at = 0
            while at < part.num_rows:
                if held and (count == size or held[0].column("pivot")[0] != part.column("pivot")[at]):
                    yield out()
                    held, count = [], 0
                same = np.flatnonzero(part.column("pivot").to_numpy()[at:] != part.column("pivot")[at].as_py())
                stop = min(at + size - count, at + int(same[0]) if len(same) else part.num_rows)
                held.append(part.slice(at, stop - at))
                count, at = count + stop - at, stop
        if held:
            yield out()

    names = ["pivot", "block", "n", "ids", "vecs", "low", "high"]
    sorted_rows = dealt.repartitionByRange("pivot", "far", "id").sortWithinPartitions("pivot", "far", "id")
    blocks = sorted_rows.mapInArrow(cut, _block_fields(kind))
    blocks.write.partitionBy("pivot").parquet(f"{path}/blocks")
    discard(unit)


@dataclass
class Facts:
    """What is known of every block without its vectors: plain arrays, sent to the tasks that choose blocks."""

    pivots: np.ndarray
    reference: np.ndarray
    block: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower bounds of the distance of each row of x to each block, distances to the blocks' pivots)."""
        gaps = _distances(x, self.pivots)
        own = gaps[:, np.maximum(self.pivot, 0)]
        found = np.zeros((len(x), len(self.block)))
        for k in range(self.low.shape[1]):
            to = own if k == 0 else gaps[:, self.reference[k - 1], None]
            np.maximum(found, np.maximum(to - self.high[:, k], self.low[:, k] - to), out=found)
        found[:, self.pivot < 0] = 0
        found[~x.any(axis=1)] = 0
        return found, own


class Index:
    """An index that build() wrote."""

    def __init__(self, spark: SparkSession, path: str):
        kept = spark.read.parquet(f"{path}/pivots").orderBy("pivot").collect()
        pivots = np.array([r.vec for r in kept])
        reference = _spread(pivots, REFERENCES)
        self.blocks = spark.read.schema(_block_fields(kept[0].id_type)).parquet(f"{path}/blocks")
        facts = self.blocks.select("pivot", "block", "n", "low", "high").orderBy("pivot", "block").toArrow()  # MAX_BLOCKS rows at most, about
        wide = (facts.num_rows, 1 + len(reference))
        low, high = (facts.column(c).combine_chunks().flatten().to_numpy().reshape(wide) if facts.num_rows else np.zeros(wide) for c in ("low", "high"))
        self.facts = Facts(pivots, reference, facts.column("block").to_numpy(), facts.column("pivot").to_numpy(), low, high)

    def __len__(self) -> int:
        return len(self.facts.block)

    def nearest(self, queries: DataFrame, k: int, exclude_self: bool = True) -> tuple[DataFrame, DataFrame]:
        """((query_id, rank, id, score), (query_id, blocks)): the k nearest by cosine of queries(id, vec), ties by id, and how many blocks each query met.

        Queries are normalised as the index was; a zero vector scores 0 with everything. Query ids are distinct; a query itself is left out by id if asked.
        """
        asked = settle(queries.where(F.col("vec").isNotNull()).select(F.col("id").alias("query_id"), normalised(F.col("vec")).alias("vec")), "pivots-queries")
        best, met, lo = None, [], 0
        for hi in (*STEPS, len(self)):
            if lo >= len(self):
                break
            wanted = settle(self._wanted(asked, best, k, lo, hi), "pivots-wanted")
            met.append(wanted.select("query_id"))
            found = self._compared(wanted, k, exclude_self)
            rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id")).cast("long")
            both = found if best is None else found.unionByName(best.drop("rank"))
            best, lo = settle(both.withColumn("rank", rank).where(F.col("rank") <= k), "pivots-best"), hi
        if best is None:
            kind = asked.schema["query_id"].dataType.simpleString()
            id_kind = self.blocks.schema["ids"].dataType.elementType.simpleString()
            return asked.sparkSession.createDataFrame([], f"query_id {kind}, rank long, id {id_kind}, score double"), asked.select("query_id", F.lit(0).cast("long").alias("blocks"))
        every = met[0]
        for more in met[1:]:
            every = every.unionByName(more)
        return best.select("query_id", "rank", "id", "score"), every.groupBy("query_id").agg(F.count("*").alias("blocks"))

    def _wanted(self, asked: DataFrame, best: DataFrame | None, k: int, lo: int, hi: int) -> DataFrame:
        """(block, query_id, vec): the blocks from lo to hi in a query's own order that its k-th score so far doesn't rule out."""
        if best is not None:
            asked = asked.join(best.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth")), "query_id", "left")
        else:
            asked = asked.withColumn("kth", F.lit(None).cast("double"))
        facts = self.facts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 64):
                    part = whole.slice(at, 64)
                    x = _rectangle(part.column("vec"), part.num_rows)
                    bound, own = facts.bounds(x)
                    order = np.lexsort((own, bound), axis=1)[:, lo:hi]
                    kth = part.column("kth").to_numpy(zero_copy_only=False).astype(np.float64)
                    reach = np.where(np.isnan(kth), np.inf, np.sqrt(np.maximum(2 - 2 * kth, 0)))
                    row, place = np.nonzero(np.take_along_axis(bound, order, axis=1) <= reach[:, None] + SLACK)
                    yield pa.RecordBatch.from_arrays([pa.array(facts.block[order[row, place]]), part.column("query_id").take(pa.array(row)), part.column("vec").take(pa.array(row))], names=["block", "query_id", "vec"])

        kind = asked.schema["query_id"].dataType.simpleString()
        ready = asked.select("query_id", "vec", "kth")
        return ready.mapInArrow(run, f"block long, query_id {kind}, vec array<double>")

    def _compared(self, wanted: DataFrame, k: int, exclude_self: bool) -> DataFrame:
        """(query_id, id, score): the k best of each query in each block that it wants; a task holds a block and streams its queries."""
        asking = wanted.groupBy("block").agg(F.ceil(F.count("*") / ASKING).cast("int").alias("salts"))
        found = asking.toArrow()  # at most a row a block
        pivots = np.unique(self.facts.pivot[np.isin(self.facts.block, found.column("block").to_numpy())]).tolist()
        kind, id_kind = wanted.schema["query_id"].dataType.simpleString(), self.blocks.schema["ids"].dataType.elementType.simpleString()
        null = lambda kind: F.lit(None).cast(kind)
        read = self.blocks.where(F.col("pivot").isin(pivots)).join(F.broadcast(asking), "block")
        held = read.select("block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), null(kind).alias("query_id"), F.col("vecs").alias("vec"), "ids")
        salt = F.pmod(F.xxhash64("query_id"), F.col("salts")).cast("int")
        queries = wanted.join(F.broadcast(asking), "block").select("block", salt.alias("salt"), "query_id", "vec", null(f"array<{id_kind}>").alias("ids"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, y, ids, order = None, None, None, None
            for part in batches:
                block, has = part.column("block").to_numpy(), part.column("ids").is_valid().to_numpy(zero_copy_only=False)
                salt = part.column("salt").to_numpy()
                cut = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (salt[1:] != salt[:-1]) | has[1:] | has[:-1]]) if len(block) else []
                for lo, hi in zip(cut, [*cut[1:], len(block)]):
                    if has[lo]:
                        now, ids = (block[lo], salt[lo]), part.column("ids")[lo].values
                        y = part.column("vec")[lo].values.to_numpy().reshape(len(ids), -1)
                        names = ids.to_numpy(zero_copy_only=False)
                        order = np.argsort(names, kind="stable")
                        continue
                    assert now == (block[lo], salt[lo])
                    for at in range(lo, hi, 256):
                        some = part.slice(at, min(256, hi - at))
                        s = _rectangle(some.column("vec"), some.num_rows) @ y.T
                        if exclude_self:
                            s[some.column("query_id").to_numpy(zero_copy_only=False)[:, None] == names[None]] = -np.inf
                        best = order[np.argsort(-np.round(s[:, order], 12), axis=1, kind="stable")[:, :k]]
                        row = np.repeat(np.arange(len(s)), best.shape[1])
                        col = best.ravel()
                        good = np.isfinite(s[row, col])
                        row, col = row[good], col[good]
                        yield pa.RecordBatch.from_arrays([some.column("query_id").take(pa.array(row)), ids.take(pa.array(col)), pa.array(s[row, col])], names=["query_id", "id", "score"])

        both = held.unionByName(queries).repartition("block", "salt").sortWithinPartitions("block", "salt", F.col("ids").isNull(), "query_id")
        return both.mapInArrow(run, f"query_id {kind}, id {id_kind}, score double")
