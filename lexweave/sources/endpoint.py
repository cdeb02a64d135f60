"""A Spark data source over a SPARQL endpoint, and a page fetcher.

spark.dataSource.register(EndpointSource)
spark.read.format("sparql_endpoint").option("endpoint", url).option("query", text).option("columns", "source,target").load()

A query with {lo} and {hi} is asked in `partitions` ranges, so that answers come in parallel. Equality filters on columns go into a query at {filters}
(with spark.sql.python.filterPushdown.enabled), their values escaped. Requests time out and are tried again; the transport is
an option (`module:function`, taking url and query and returning the JSON text), which is how tests run without a network.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

TIMEOUT, TRIES = 60, 3
AGENT = "Mozilla/5.0"


def http(url: str, query: str) -> str:
    request = urllib.request.Request(f"{url}?{urllib.parse.urlencode({'query': query})}", headers={"Accept": "application/sparql-results+json"})
    return _answer(request).decode("utf-8")


def _answer(request: urllib.request.Request, any_status: bool = False, wait: float = 1.0) -> bytes:
    """The answer's body; what fails on the way is tried TRIES times."""
    for k in range(TRIES):
        try:
            with urllib.request.urlopen(request, timeout=TIMEOUT) as got:
                return got.read()
        except OSError as e:
            if any_status and isinstance(e, urllib.error.HTTPError):
                return e.read()
            if k + 1 == TRIES:
                raise
            time.sleep(wait * 2**k)
    raise AssertionError


def fetch(url: str) -> bytes | None:
    """The English page of a document, whatever the status; None if no answer comes."""
    try:
        return _answer(urllib.request.Request(url, headers={"User-Agent": AGENT, "Accept-Language": "eng"}), any_status=True)
    except OSError:
        return None


def fetched(ids: DataFrame, base: str, id_col: str = "celex", get=fetch) -> DataFrame:
    """(celex, body binary): one request a row, on executors. Ids that are URIs count by their last segment; a null id, or a page that doesn't come, has a null body."""
    import pyarrow as pa

    def run(batches):
        for part in batches:
            names = [x if x is None else str(x).rsplit("/", 1)[-1] if str(x).startswith("http") else str(x) for x in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([None if n is None else get(base + urllib.parse.quote(n)) for n in names], pa.binary())], names=["celex", "body"])

    return ids.select(id_col).mapInArrow(run, "celex string, body binary")


class Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class EndpointReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.options, self.columns = options, columns
        self.pushed: list[tuple[str, str]] = []

    def filters(self) -> str:
        escape = str.maketrans({"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r"})
        return " ".join(f'FILTER(STR(?{c}) = "{v.translate(escape)}")' for c, v in self.pushed)

    def partitions(self) -> list[InputPartition]:
        n = int(self.options.get("partitions", "1")) if "{lo}" in self.options["query"] else 1
        lo, hi = int(self.options.get("lo", "0")), int(self.options.get("hi", "0"))
        cuts = [lo + (hi - lo) * i // n for i in range(n + 1)]
        return [Range(a, b) for a, b in zip(cuts, cuts[1:])]

    def read(self, partition: Range) -> Iterator[tuple]:
        module, _, name = self.options.get("transport", "lexweave.sources.endpoint:http").partition(":")
        ask = getattr(importlib.import_module(module), name)
        query = self.options["query"].replace("{lo}", str(partition.lo)).replace("{hi}", str(partition.hi)).replace("{filters}", self.filters())
        for row in json.loads(ask(self.options["endpoint"], query))["results"]["bindings"]:
            yield tuple(row.get(c, {}).get("value") for c in self.columns)


class FilteringReader(EndpointReader):
    """For queries with a place for filters; Spark asks that spark.sql.python.filterPushdown.enabled be set."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes column = string where the query has a place for filters; all others stay with Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and isinstance(f.value, str):
                self.pushed.append((f.attribute[0], f.value))
            else:
                yield f


class EndpointSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sparql_endpoint"

    def columns(self) -> list[str]:
        return [c.strip() for c in self.options["columns"].split(",")]

    def schema(self) -> StructType:
        return StructType([StructField(c, StringType()) for c in self.columns()])

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = FilteringReader if "{filters}" in self.options["query"] else EndpointReader
        return kind(dict(self.options), self.columns())
