"""A data source over tensor containers: a JSON header of names, types, shapes and offsets, then the numbers.

spark.dataSource.register(Tensors)
spark.read.format("tensor_container").option("path", uri).option("rename", json).load().where("name = 'encoder.0.q'")

Rows are (name, dtype, shape, begin, values): slices of at most `elements` numbers, row by row of the tensor, begin the first number's place in it. The driver reads headers alone;
each slice is a task's range of the file, read when that task runs, so a container may be larger than any memory. Names are rewritten at the scan: of rename's (beginning, new beginning) pairs
the first that fits a name counts, and two tensors that come to one name are an error. A filter on the name, equal or among, keeps all other ranges from being read (with
option filters true and spark.sql.python.filterPushdown.enabled).
"""

from __future__ import annotations

import functools
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

ELEMENTS = 1 << 20
#: Numbers an Arrow batch row holds are doubles; a row is a slice.
SCHEMA = "name string, dtype string, shape array<long>, begin long, values array<double>"

# The container's names of number types. BF16 is the upper half of a single-precision number.
TYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "BF16": "<u2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "<i1", "U8": "<u1", "BOOL": "<u1"}


@functools.cache
def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def header(uri: str) -> tuple[dict[str, dict], int]:
    """(what is known of each tensor, where the numbers begin)."""
    files, path = _place(uri)
    with files.open_input_file(path) as f:
        size = struct.unpack("<Q", f.read_at(8, 0))[0]
        found = json.loads(f.read_at(size, 8))
    found.pop("__metadata__", None)
    return found, 8 + size


def write(uri: str, tensors: dict[str, np.ndarray]) -> None:
    """A container of double, single and half precision numbers and integers."""
    kinds = {np.dtype(v): k for k, v in TYPES.items() if k not in ("BF16", "BOOL")}
    known, at = {}, 0
    for name, x in tensors.items():
        known[name] = {"dtype": kinds[x.dtype], "shape": list(x.shape), "data_offsets": [at, at + x.nbytes]}
        at += x.nbytes
    raw = json.dumps(known).encode()
    files, path = _place(uri)
    with files.open_output_stream(path) as f:
        f.write(struct.pack("<Q", len(raw)) + raw)
        for x in tensors.values():
            f.write(np.ascontiguousarray(x).tobytes())


class Slice(InputPartition):
    def __init__(self, name: str, dtype: str, shape: list[int], begin: int, count: int, at: int):
        self.name, self.dtype, self.shape, self.begin, self.count, self.at = name, dtype, shape, begin, count, at


class TensorReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri, self.elements = options["path"], int(options.get("elements", ELEMENTS))
        self.rename: list[tuple[str, str]] = [tuple(p) for p in json.loads(options.get("rename", "[]"))]
        self.wanted: set[str] | None = None

    def renamed(self, name: str) -> str:
        return next((b + name[len(a) :] for a, b in self.rename if name.startswith(a)), name)

    def partitions(self) -> list[InputPartition]:
        found, start = header(self.uri)
        names = [self.renamed(n) for n in found]
        twice = {n for n in names if names.count(n) > 1}
        if twice:
            raise ValueError(f"two tensors are called {sorted(twice)[0]}")
        out = []
        for name, known in zip(names, found.values()):
            if self.wanted is not None and name not in self.wanted:
                continue
            kind, size = known["dtype"], int(np.prod(known["shape"], dtype=np.int64))
            if kind not in TYPES:
                raise ValueError(f"{name} holds numbers of type {kind}")
            for begin in range(0, size, self.elements):
                out.append(Slice(name, kind, known["shape"], begin, min(self.elements, size - begin), start + known["data_offsets"][0] + begin * np.dtype(TYPES[kind]).itemsize))
        return out or [Slice("", "F32", [], 0, 0, 0)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        files, path = _place(self.uri)
        kind = np.dtype(TYPES[partition.dtype])
        with files.open_input_file(path) as f:
            raw = f.read_at(partition.count * kind.itemsize, partition.at)
        got = np.frombuffer(raw, kind)
        if len(got) < partition.count:
            raise ValueError(f"the container ends within {partition.name}")
        if partition.dtype == "BF16":
            got = (got.astype(np.uint32) << 16).view(np.float32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([partition.name]), pa.array([partition.dtype]), pa.array([partition.shape], pa.list_(pa.int64())), pa.array([partition.begin], pa.int64()), pa.array([got.astype(np.float64)], pa.list_(pa.float64()))],
            names=["name", "dtype", "shape", "begin", "values"],
        )


class FilteringReader(TensorReader):
    """With option filters: Spark asks that spark.sql.python.filterPushdown.enabled be set."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            names = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if names is not None and f.attribute == ("name",):
                self.wanted = names if self.wanted is None else self.wanted & names
            else:
                yield f


class Tensors(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tensor_container"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return (FilteringReader if self.options.get("filters") == "true" else TensorReader)(dict(self.options))


def state(rows) -> dict[str, np.ndarray]:
    """The tensors of some rows of the source by name, put together on the driver: for what fits there, such as an encoder to explain."""
    parts: dict[str, list] = {}
    for r in rows.orderBy("name", "begin").collect():
        parts.setdefault(r.name, []).append(r)
    return {name: np.concatenate([p["values"] for p in got]).reshape(got[0].shape) for name, got in parts.items()}
