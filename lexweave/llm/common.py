"""Plumbing the operators share: shared storage, Arrow row mapping, hashing, components.

Nothing here collects data: every helper returns a DataFrame or works on one Arrow batch.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, settle, shared_dir

#: Rows, and bytes unless one row has more, handled at once inside a Python worker; bounds its memory, changes no result.
SLICE, SLICE_BYTES = 512, 1 << 23
#: A word as every contract here defines it: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lexweave/{name}-{uuid.uuid4().hex}"


def remainder(ident: Column, modulus: int) -> Column:
    """crc32 of the id's text, modulo; null for a null id."""
    return F.crc32(ident.cast("string").cast("binary")) % modulus


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches cut to at most `rows` rows and SLICE_BYTES bytes; long texts make them shorter, down to one row."""
    for batch in batches:
        waiting = [batch.slice(at, rows) for at in range(0, batch.num_rows, rows)][::-1]
        while waiting:
            part = waiting.pop()
            if part.num_rows > 1 and part.nbytes > SLICE_BYTES:
                half = part.num_rows // 2
                waiting += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def with_columns(df: DataFrame, add: Callable[[pa.RecordBatch], dict[str, pa.Array]], fields: str, keep: list[str], per_task: Callable[[], object] | None = None) -> DataFrame:
    """Append columns that `add` computes from an Arrow batch; `keep` names the input columns to carry along.

    An input column that has the name of an appended one is replaced.
    """
    new = df.sparkSession.createDataFrame([], fields).schema
    kept = [c for c in keep if c not in new.names]
    types = [df.schema[c] for c in kept] + list(new.fields)
    schema = type(new)(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (per_task(),) if per_task else ()
        for part in slices(batches):
            got = add(part, *state)
            yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [got[c] for c in new.names], names=kept + list(new.names))

    return df.mapInArrow(run, schema)


_kept: dict[Hashable, object] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Let go of what this worker keeps, and give free memory back to the machine: Spark reuses workers, so a stage would hold what those before it needed."""
    _kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def kept(name: Hashable, make: Callable[[], object]) -> object:
    """What a worker keeps from task to task: one thing at a time, whoever asks; another name replaces it."""
    if name not in _kept:
        release()
        _kept[name] = make()
    return _kept[name]


def texts_of(part: pa.RecordBatch, name: str) -> list[str]:
    return [x or "" for x in part.column(name).to_pylist()]


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges(a, b): rows (node, root), root the smallest node reachable.

    Alternates large-star and small-star joins (Kiveris et al.), each settled in shared storage; rounds grow with the logarithm of
    the longest path. A node of very high degree is only ever the key of a min() with map-side combine and of an inner join that
    adaptive execution can split. Nodes without an edge, and rows with a null end, give no row.
    """
    pairs = settle(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        last, pairs = pairs, settle(small, name)
        discard(last)
        now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("b", "a"))).first()
        if now == before:
            break
        before = now
    stars = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def split_words(text: str) -> list[bytes]:
    """Lower-case A-Z only, cut at ASCII white space: bytes.lower() and bytes.split() do precisely that."""
    return text.encode("utf-8", "surrogatepass").lower().split()


