"""Harvesting a SPARQL endpoint in key order, as a batch or a stream that goes on where it stopped.

spark.dataSource.register(Harvest)
spark.readStream.format("sparql_harvest").option("endpoint", url).options(**question("citations", sector="6")).load()

Queries are made from columns and conditions, never handed in. The first column is the key. An offset is the greatest key harvested, kept in the stream's checkpoint; a batch asks for the greatest key there is now,
cuts the keys between into ranges of KEYS, and each range is a task that reads pages of ROWS rows, each page after the last row of the one before (by all columns, so that a key with more
rows than a page goes on in the next). A range that fails is asked again, by the task or by the restarted stream, with the same bounds: behind a sink that writes a batch once,
every row comes exactly once. Rows added later under a key that has been passed are not seen; harvest anew for these.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

#: Keys a range and rows a page, by default.
KEYS, ROWS = 5_000, 10_000

# The vocabulary of the endpoint's documents.
PREFIXES = {"cdm": "http://publications.europa.eu/ontology/cdm#", "xsd": "http://www.w3.org/2001/XMLSchema#"}
CELEX, SECTOR, YEAR = "cdm:resource_legal_id_celex", "cdm:resource_legal_id_sector", "cdm:resource_legal_year"
FORM, PROCEDURE, TYPE = "cdm:work_has_resource-type", "cdm:case-law_has_procjur", "cdm:resource_legal_type"
AUTHORITY = "http://publications.europa.eu/resource/authority"
QUESTIONS: dict[str, tuple[dict[str, str], dict[str, list[str]]]] = {
    "ids": ({"celex": CELEX}, {}),
    "legislation": ({"celex": CELEX}, {SECTOR: ["3"], YEAR: []}),
    "judgments": ({"celex": CELEX}, {SECTOR: ["6"], YEAR: [], FORM: [f"{AUTHORITY}/resource-type/JUDG"], TYPE: ["CJ", "TJ", "FJ"], PROCEDURE: []}),
    "citations": ({"source": CELEX, "target": f"cdm:work_cites_work/{CELEX}"}, {}),
    "subjects": ({"source": CELEX, "target": "cdm:resource_legal_is_about_subject-matter"}, {}),
    "directory_codes": ({"source": CELEX, "target": "cdm:resource_legal_is_about_concept_directory-code"}, {}),
}


def question(name: str, sector: str | None = None, year: str | None = None, preliminary_ruling: bool = False) -> dict[str, str]:
    """The options of one of QUESTIONS; a condition without values asks only that the property be there."""
    columns, given = QUESTIONS[name]
    given = dict(given)
    if sector:
        given[SECTOR] = [sector]
    if year:
        given[YEAR] = [f"{year}^^xsd:gYear"]
    if preliminary_ruling:
        given[PROCEDURE] = [f"{AUTHORITY}/procjur/REFER_PREL"]
    return {"columns": json.dumps(columns), "conditions": json.dumps(given)}


def quoted(value: str) -> str:
    """A string, or a literal of a type after ^^, or a URI, with whatever would end it escaped."""
    text, mark, kind = value.partition("^^")
    if value.startswith(("http://", "https://")) and not set(value) & set('<>"{}|\\^` \n'):
        return f"<{value}>"
    escaped = text.translate(str.maketrans({"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r"}))
    return f'"{escaped}"' + (f"^^{kind}" if mark else "")


class Question:
    """SPARQL for the rows of some columns under some conditions, in key order."""

    def __init__(self, options: dict[str, str]):
        self.columns: dict[str, str] = json.loads(options["columns"])
        self.conditions: dict[str, list[str]] = json.loads(options.get("conditions", "{}"))
        self.key = next(iter(self.columns))
        self.keys, self.rows = int(options.get("keys", KEYS)), int(options.get("rows", ROWS))
        module, _, name = options.get("transport", "lexweave.sources.endpoint:http").partition(":")
        self.place = (options["endpoint"], module, name)

    def ask(self, query: str) -> list[dict[str, str]]:
        url, module, name = self.place
        got = json.loads(getattr(importlib.import_module(module), name)(url, query))["results"]["bindings"]
        return [{k: v["value"] for k, v in row.items()} for row in got]

    def _query(self, select: str, filters: list[str], tail: str) -> str:
        prefixes = " ".join(f"PREFIX {k}: <{v}>" for k, v in PREFIXES.items())
        lines = [f"?doc {path} ?{name} ." for name, path in self.columns.items()]
        for i, (path, values) in enumerate(self.conditions.items()):
            lines.append(f"?doc {path} ?c{i} .")
            if values:
                strings = [v if "^^" in v or v.startswith("http") else f"{v}^^xsd:string" for v in values]
                lines.append(f"FILTER(?c{i} IN ({', '.join(map(quoted, strings))}))")
        return f"{prefixes} SELECT DISTINCT {select} WHERE {{ {' '.join(lines)} {' '.join(filters)} }} {tail}".strip()

    def _above(self, low: str) -> str:
        return f"FILTER(STR(?{self.key}) > {quoted_string(low)})"

    def _upto(self, high: str) -> str:
        return f"FILTER(STR(?{self.key}) <= {quoted_string(high)})"

    def greatest(self) -> str:
        """The greatest key there is; empty without rows."""
        got = self.ask(self._query(f"(MAX(STR(?{self.key})) AS ?key)", [], ""))
        return got[0].get("key", "") if got else ""

    def cuts(self, low: str, high: str) -> Iterator[tuple[str, str]]:
        """Ranges of keys, above the first and up to the second, of `keys` keys each."""
        while low < high:
            got = self.ask(self._query(f"(STR(?{self.key}) AS ?key)", [self._above(low), self._upto(high)], f"ORDER BY ?key LIMIT 1 OFFSET {self.keys - 1}"))
            end = got[0]["key"] if got else high
            yield low, end
            low = end

    def pages(self, low: str, high: str) -> Iterator[tuple]:
        """The rows of a range, page by page."""
        names = list(self.columns)
        order = "ORDER BY " + " ".join(f"STR(?{n})" for n in names) + f" LIMIT {self.rows}"
        after = self._above(low)
        while True:
            got = self.ask(self._query(" ".join(f"?{n}" for n in names), [after, self._upto(high)], order))
            for row in got:
                yield tuple(row.get(n) for n in names)
            if len(got) < self.rows:
                return
            last = [quoted_string(got[-1].get(n, "")) for n in names]
            steps = [" && ".join([f"STR(?{n}) = {v}" for n, v in zip(names[:i], last)] + [f"STR(?{names[i]}) > {last[i]}"]) for i in range(len(names))]
            after = f"FILTER({' || '.join(f'({s})' for s in steps)})"


def quoted_string(value: str) -> str:
    """A plain string, also where it looks like a URI or a typed literal."""
    return '"' + value.translate(str.maketrans({"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r"})) + '"'


class Keys(InputPartition):
    def __init__(self, low: str, high: str):
        self.low, self.high = low, high


class BatchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.question = Question(options)

    def partitions(self) -> list[InputPartition]:
        return [Keys(*cut) for cut in self.question.cuts("", self.question.greatest())] or [Keys("", "")]

    def read(self, partition: Keys) -> Iterator[tuple]:
        return self.question.pages(partition.low, partition.high) if partition.high else iter(())


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.question = Question(options)

    def initialOffset(self) -> dict:
        return {"key": ""}

    def latestOffset(self) -> dict:
        return {"key": self.question.greatest()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Keys(*cut) for cut in self.question.cuts(start["key"], end["key"])]

    def read(self, partition: Keys) -> Iterator[tuple]:
        return self.question.pages(partition.low, partition.high)


class Harvest(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sparql_harvest"

    def schema(self) -> StructType:
        return StructType([StructField(c, StringType()) for c in json.loads(self.options["columns"])])

    def reader(self, schema: StructType) -> DataSourceReader:
        return BatchReader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return StreamReader(dict(self.options))
