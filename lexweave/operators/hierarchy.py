"""Vectors of long documents: chunks encoded row by row wherever they lie, then each document's chunks in order through a chunk encoder.

Chunks are rows, so a long document's chunks are encoded by many tasks. They are then dealt by document and sorted by (document, chunk); a task reads them as a
stream, keeps the chunks of the document that it is in from one Arrow batch to the next, and gives the document to the encoder when another begins. So no document is cut by a batch or a task, none is gathered into one
row, a task holds one document's chunk vectors, and a vector depends on its own document alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import settle
from .encoders import ChunkEncoder, LongTokenizer

#: Vectors of chunks from their token ids and masks.
ChunkModel = Callable[[list[list[int]], list[list[int]]], np.ndarray]


def hashing_chunks(dim: int = 48) -> Callable[[], ChunkModel]:
    """Mean of signed one-hot token ids: a stand-in for the first vector of a word encoder."""

    def factory() -> ChunkModel:
        known: dict[int, tuple[int, int]] = {}

        def place(token: int) -> tuple[int, int]:
            if token not in known:
                h = xxhash.xxh64_intdigest(token.to_bytes(8, "little", signed=True), 0)
                known[token] = (h % dim, 1 if h >> 63 else -1)
            return known[token]

        def encode(ids: list[list[int]], masks: list[list[int]]) -> np.ndarray:
            out = np.zeros((len(ids), dim))
            for i, (row, mask) in enumerate(zip(ids, masks)):
                for token, real in zip(row, mask):
                    if real:
                        at, sign = place(token)
                        out[i, at] += sign
                out[i] /= max(1, sum(mask))
            return out

        return encode

    return factory


def chunk_vectors(chunks: DataFrame, factory: Callable[[], ChunkModel], keep: list[str]) -> DataFrame:
    """(keep..., chunk, real, vec) for chunks(keep..., chunk, ids, mask); real says that the chunk begins with a token, not with padding."""
    schema = type(chunks.schema)([*(chunks.schema[c] for c in keep), *chunks.sparkSession.createDataFrame([], "chunk int, real boolean, vec array<double>").schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                ids, masks = part.column("ids").to_pylist(), part.column("mask").to_pylist()
                vec = np.asarray(model(ids, masks), np.float64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), part.column("chunk"), pa.array([bool(m[0]) for m in masks]), pa.array(list(vec), pa.list_(pa.float64()))], names=schema.names)

    return chunks.select(*keep, "chunk", "ids", "mask").mapInArrow(run, schema)


def by_document(rows: DataFrame, key: str, order: str, fields: str, compute: Callable[[], Callable[[pa.Table], pa.RecordBatch]]) -> DataFrame:
    """Rows of `fields` that compute()'s result makes of each document's rows, in order. A document's rows come together whatever the batches; it is named by `key`, which must not be null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, held, now = compute(), [], None
        for part in batches:
            keys = part.column(key).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
            for lo, hi in zip(cut, [*cut[1:], len(keys)]):
                if held and keys[lo] != now:
                    yield use(pa.Table.from_batches(held))
                    held = []
                now = keys[lo]
                held.append(part.slice(lo, hi - lo))
        if held:
            yield use(pa.Table.from_batches(held))

    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, fields)


def document_vectors(docs: DataFrame, id_col: str, text_col: str, tokenizer: LongTokenizer, chunk_model: Callable[[], ChunkModel], dim: int, layers: int = 2, heads: int = 12, pooling: str = "mean", seed: int = 0) -> DataFrame:
    """(id, vec array<double>, chunks int): a vector for every row of docs, whole texts, however long.

    A null or empty text is one chunk of the leading token alone. Rows are told apart by place, not by id: repeated rows and null ids each give a row. Only the id and text columns are
    read. An empty table gives no rows. A document of n chunks takes work that grows with n squared and memory with n.
    """
    named = settle(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id()), "hierarchy-docs")
    chunks = tokenizer.chunks(named, "text", ["row", "id"])
    vectors = settle(chunk_vectors(chunks, chunk_model, ["row", "id"]), "hierarchy-chunks")
    most = (vectors.agg(F.max("chunk")).first()[0] or 0) + 1
    kind = named.schema["id"].dataType.simpleString()

    def compute() -> Callable[[pa.Table], pa.RecordBatch]:
        model = ChunkEncoder(dim, layers, heads, most, pooling, seed)

        def one(rows: pa.Table) -> pa.RecordBatch:
            x = rows.column("vec").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
            real = rows.column("real").to_numpy(zero_copy_only=False).astype(bool)
            return pa.RecordBatch.from_arrays([rows.column("id").chunk(0).slice(0, 1), pa.array([model(x, real)], pa.list_(pa.float64())), pa.array([rows.num_rows], pa.int32())], names=["id", "vec", "chunks"])

        return one

    return by_document(vectors, "row", "chunk", f"id {kind}, vec array<double>, chunks int", compute)
