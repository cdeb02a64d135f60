"""Document encoders: chunking, pooling, and the seam for models.

A model is a factory returning a callable; it is built once in each Python worker, so any library can stand behind it. The default is a
deterministic hashing encoder, which needs no files. Every document is encoded on its own: neighbours in a batch never change its vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import TINY_TOKENS, position_table

CLS, PAD = 101, 0
#: Chunks whose attention a chunk encoder works out at once.
ROWS = 256
#: Bytes of text whose tokens are held at once.
PIECE = 1 << 20
Encoder = Callable[[list[str]], np.ndarray]
Tokenizer = Callable[[list[str]], list[list[int]]]


def hashing_encoder(dim: int = 128) -> Callable[[], Encoder]:
    """Mean of signed one-hot words: a stand-in for a sentence encoder."""

    def factory() -> Encoder:
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for i, text in enumerate(texts):
                words = text.split()
                for w in words:
                    h = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 0)
                    out[i, h % dim] += 1 if h >> 63 else -1
                out[i] /= max(1, len(words))
            return out

        return encode

    return factory


def encode(docs: DataFrame, text_col: str, factory: Callable[[], Encoder], out_col: str = "embedding", batch: int = 256) -> DataFrame:
    """docs with out_col array<double>; null texts are empty ones. An input column of that name is replaced.

    Within an Arrow batch the model gets texts longest first, so that those of a call are of like length; rows keep their order.
    """
    keep = [c for c in docs.columns if c != out_col]
    new = docs.sparkSession.createDataFrame([], f"{out_col} array<double>").schema
    schema = type(new)([*(docs.schema[c] for c in keep), *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for part in batches:
            texts = [x or "" for x in part.column(text_col).to_pylist()]
            order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
            vectors: list = [None] * len(texts)
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                for i, v in zip(some, np.asarray(model([texts[i] for i in some]), np.float64)):
                    vectors[i] = v
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(vectors, pa.list_(pa.float64()))], names=[*keep, out_col])

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)


def encode_texts(spark: SparkSession, texts: str | list[str], factory: Callable[[], Encoder]) -> DataFrame:
    """(at, text, embedding) of one text or of several, in their order."""
    return encode(spark.createDataFrame([(i, x) for i, x in enumerate([texts] if isinstance(texts, str) else texts)], "at int, text string"), "text", factory)


def word_tokenizer(size: int = 30_000) -> Callable[[], Tokenizer]:
    """Words as hashed ids from CLS + 1 on: a stand-in for a model's tokenizer."""
    return lambda: lambda texts: [[CLS + 1 + xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 0) % size for w in x.split()] for x in texts]


def file_tokenizer(path: str) -> Callable[[], Tokenizer]:
    """A tokenizers file's ids, without special tokens. The path must be readable on every worker."""

    def factory() -> Tokenizer:
        from tokenizers import Tokenizer as File

        use = File.from_file(path)
        return lambda texts: [x.ids for x in use.encode_batch(texts, add_special_tokens=False)]

    return factory


class LongTokenizer:
    """Texts of any length as chunks of token ids.

    factory builds a tokenizer in each worker. A document keeps at most max_document_tokens of its tokens, all by default; chunks have at most
    max_chunk_tokens, the leading CLS included.
    """

    def __init__(self, factory: Callable[[], Tokenizer], max_document_tokens: int | None = None, max_chunk_tokens: int = 512):
        if max_chunk_tokens < 2 or (max_document_tokens or 1) < 1:
            raise ValueError("a chunk has at least 2 tokens, a document at least 1")
        self.factory, self.most, self.chunk = factory, max_document_tokens, max_chunk_tokens

    def ids(self, docs: DataFrame, text_col: str, out_col: str = "ids") -> DataFrame:
        """docs with out_col array<int>: CLS, then the tokens. A null text is an empty one. An input column of that name is replaced."""
        keep = [c for c in docs.columns if c != out_col]
        schema = type(docs.schema)([*(docs.schema[c] for c in keep), *docs.sparkSession.createDataFrame([], f"{out_col} array<int>").schema.fields])
        factory, most = self.factory, self.most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            use = factory()
            for whole in batches:
                for part in by_size(whole, text_col):
                    got = [[CLS, *x[:most]] for x in use([x or "" for x in part.column(text_col).to_pylist()])]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(got, pa.list_(pa.int32()))], names=[*keep, out_col])

        return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)

    def chunks(self, docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
        """(keep..., chunk, ids, mask), a row a chunk."""
        got = self.ids(docs, text_col, "_ids").select(*keep, F.explode(chunks(F.col("_ids"), self.chunk)).alias("_c"))
        return got.select(*keep, "_c.chunk", "_c.ids", "_c.mask")


def by_size(rows: pa.RecordBatch, text_col: str) -> Iterator[pa.RecordBatch]:
    """The rows, in order, in pieces of about PIECE bytes of text and at least one row: token ids as Python lists take twenty times a text's bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(rows.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    at, last = 0, 0
    while at < rows.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, last + PIECE, "right")))
        yield rows.slice(at, upto - at)
        at, last = upto, int(ends[upto - 1])


def padded_length(length: int, chunk: int) -> int:
    """Tokens (without the leading one) after padding so that windows of chunk - 1 at steps of that less a tenth cover all."""
    overlap, width = chunk // 10, chunk - 1
    rest = length - 1
    return -(-(rest + int((rest - width) / (width - overlap)) * overlap) // width) * width


def chunks(ids: Column, chunk: int) -> Column:
    """array<struct<chunk int, ids array<int>, mask array<int>>> of a token array that begins with its CLS token.

    Up to chunk tokens: one chunk, unchanged. Longer: windows of chunk - 1 tokens that overlap by a tenth of chunk, each with CLS, or PAD where the window
    begins in padding, in front. Native expressions.
    """
    overlap, width = chunk // 10, chunk - 1
    step = width - overlap
    rest = F.size(ids) - 1
    n = ((rest - width) / step).cast("int")
    total = (F.ceil((rest + n * overlap) / width) * width).cast("int")
    body = F.concat(F.slice(ids, 2, F.greatest(rest, F.lit(0))), F.array_repeat(F.lit(PAD), F.greatest(total - rest, F.lit(0))))
    count = F.floor((total - width) / step).cast("int") + 1

    def one(i: Column, padded: Column) -> Column:
        part = F.slice(padded, i * step + 1, F.lit(width))
        lead = F.when(part[0] == PAD, F.lit(PAD)).otherwise(F.lit(CLS))
        whole = F.concat(F.array(lead), part)
        return F.struct(i.cast("int").alias("chunk"), whole.alias("ids"), F.transform(whole, lambda x: F.when(x == PAD, 0).otherwise(1)).alias("mask"))

    single = F.array(F.struct(F.lit(0).alias("chunk"), ids.alias("ids"), F.transform(ids, lambda x: F.when(x == PAD, 0).otherwise(1)).alias("mask")))
    return F.when(F.size(ids) <= chunk, single).otherwise(F.flatten(F.transform(F.array(body), lambda padded: F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: one(i, padded)))))


def mean_pool(tokens: DataFrame, by: list[str], position: str = "dim", value: str = "x", mask: str = "mask") -> DataFrame:
    """Masked mean of long-form token values by group and dimension; an all-masked group gives 0."""
    m = F.col(mask).cast("double")
    return tokens.groupBy(*by, position).agg((F.sum(m * F.col(value)) / F.greatest(F.sum(m), F.lit(TINY_TOKENS))).alias("pooled"))


def max_pool(tokens: DataFrame, by: list[str], position: str = "dim", value: str = "x", mask: str = "mask", nothing: float = -1e9) -> DataFrame:
    """Masked maximum; an all-masked group gives `nothing`."""
    return tokens.groupBy(*by, position).agg(F.max(F.when(F.col(mask) == 1, F.col(value)).otherwise(F.lit(nothing))).alias("pooled"))


class ChunkEncoder:
    """Chunk vectors plus sinusoidal chunk positions through `layers` self-attention layers with seeded weights, then a masked pool.

    Padding chunks are masked, so a document's vector never depends on what it is encoded with. More than max_chunks chunks raise.
    """

    def __init__(self, dim: int, layers: int = 2, heads: int = 12, max_chunks: int = 512, pooling: str = "mean", seed: int = 0):
        if pooling not in ("mean", "max"):
            raise ValueError("pooling is mean or max")
        rng = np.random.default_rng(seed)
        self.dim, self.heads, self.pooling = dim, heads if dim % heads == 0 else 1, pooling
        self.positions = position_table(max_chunks + 1, dim, 0)
        self.layers = [[rng.standard_normal((dim, dim)) / np.sqrt(dim) for _ in range(6)] for _ in range(layers)]

    def __call__(self, chunk_vectors: np.ndarray, real: np.ndarray) -> np.ndarray:
        from ..functions.vectors import layer_norm

        n = len(chunk_vectors)
        if n >= len(self.positions):
            raise ValueError(f"{n} chunks; at most {len(self.positions) - 1}")
        x = chunk_vectors + self.positions[np.where(real, np.arange(1, n + 1), 0)]
        for q, k, v, o, up, down in self.layers:
            split = lambda y: y.reshape(n, self.heads, -1).transpose(1, 0, 2)
            queries, keys, values = split(x @ q), split(x @ k).transpose(0, 2, 1), split(x @ v)
            said = np.empty_like(queries)
            for lo in range(0, n, ROWS):  # a long document's scores are never held whole
                scores = np.where(real[None, None, :], queries[:, lo : lo + ROWS] @ keys / np.sqrt(self.dim // self.heads), -1e9)
                weight = np.exp(scores - scores.max(-1, keepdims=True))
                said[:, lo : lo + ROWS] = weight / weight.sum(-1, keepdims=True) @ values
            x = layer_norm(x + said.transpose(1, 0, 2).reshape(n, -1) @ o)
            x = layer_norm(x + np.maximum(x @ up, 0) @ down)
        return x[real].mean(0) if self.pooling == "mean" else x[real].max(0)
