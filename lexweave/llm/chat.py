"""Chat formatting: heterogeneous records into canonical turns, and turns into one reversible template.

Schema fingerprinting. A record's layout is the set of its nested field paths with their kinds, null and absent fields left out; its hash
is the layout's fingerprint. Declarative mappings say which paths hold roles and texts. The first record of a fingerprint looks its
mapping up (the first whose required paths are all there, in the order declared); all others of that fingerprint get it from a table.
Records that no mapping fits come out with layout null and no turns, never dropped.

The template marks a turn as `<|turn|>role`, a line feed, the text and `<|end|>` with a line feed. Inside roles and texts a backslash
goes before every backslash and every `<|`, in roles before line feeds too, so nothing a text says can be taken for a mark, and every
output reads back to what went in. Each turn is formatted on its own, so a conversation of any length spreads over all tasks.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

TURN, END = "<|turn|>", "<|end|>"
LOSS_ROLES = ("assistant",)


class Part(NamedTuple):
    """Where turns come from: under `each` (a list's path; none: the record itself), role from a path or fixed, text from a path."""

    text: str
    role: str = ""
    fixed: str = ""
    each: str = ""
    optional: bool = False


class Mapping(NamedTuple):
    name: str
    parts: tuple[Part, ...]
    roles: dict[str, str] = {}

    def required(self) -> set[str]:
        got = set()
        for p in self.parts:
            if not p.optional:
                head = f"{p.each}[]." if p.each else ""
                got |= {head + p.text} | ({head + p.role} if p.role else set())
        return got


NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MAPPINGS = (
    Mapping("messages", (Part("content", role="role", each="messages"),)),
    Mapping("conversations", (Part("system", fixed="system", optional=True), Part("value", role="from", each="conversations")), NAMES),
    Mapping("dialog", (Part("text", role="speaker", each="dialog"),), NAMES),
    Mapping("instruction_input", (Part("system", fixed="system", optional=True), Part("instruction", fixed="user"), Part("input", fixed="user", optional=True), Part("output", fixed="assistant"))),
    Mapping("prompt_messages", (Part("content", role="role", each="prompt"), Part("completion", fixed="assistant"))),
    Mapping("prompt_completion", (Part("prompt", fixed="user"), Part("completion", fixed="assistant"))),
    Mapping("prompt_response", (Part("system_prompt", fixed="system", optional=True), Part("prompt", fixed="user"), Part("response", fixed="assistant"))),
    Mapping("question_answer", (Part("question", fixed="user"), Part("answer", fixed="assistant"))),
    Mapping("row", (Part("text", role="role"),)),
)


def paths(value: object, at: str = "") -> set[str]:
    """Nested field paths of a parsed record: `a.b`, `a[].b`, each with the kind of its value after a colon."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items() if v is not None)) if value else {f"{at}:object"}
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value if v is not None)) if value else {f"{at}:list"}
    kind = "bool" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"
    return {f"{at}:{kind}"}


def _digest(there: set[str]) -> int:
    return xxhash.xxh64_intdigest("\n".join(sorted(there)).encode("utf-8", "surrogatepass"), 0) - (1 << 63)


def fingerprint(value: object) -> int:
    return _digest(paths(value))


class Layouts:
    """Fingerprint -> mapping, filled as layouts turn up."""

    def __init__(self, mappings: tuple[Mapping, ...] = MAPPINGS):
        self.mappings, self.known = mappings, {}

    def of(self, value: object) -> tuple[int, Mapping | None]:
        there = paths(value)
        mark = _digest(there)
        if mark not in self.known:
            strings = {p.removesuffix(":string") for p in there if p.endswith(":string")}
            # A text may be a list of parts.
            strings |= {p.removesuffix(suffix) for p in strings for suffix in ("[].text", "[]") if p.endswith(suffix)}
            self.known[mark] = next((m for m in self.mappings if m.required() <= strings), None)
        return mark, self.known[mark]


def _get(value: object, path: str) -> object:
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return value


def said(value: object) -> str:
    """A text, or the texts of a list of parts end to end (strings, and objects with a text; other parts have none); anything else as JSON. Null is empty.

    A surrogate without its partner, which no UTF-8 text can hold, becomes U+FFFD.
    """
    if isinstance(value, list):
        return "".join(said(x.get("text") if isinstance(x, dict) else x) for x in value if isinstance(x, (str, dict)))
    text = value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def turns_of(value: object, mapping: Mapping) -> list[tuple[str, str]]:
    """(role, text) of each turn. A missing text is empty, an optional part without text gives no turn; neighbours of an instruction join by a blank line."""
    found: list[tuple[str, str]] = []
    for p in mapping.parts:
        items = _get(value, p.each) if p.each else [value]
        for item in items if isinstance(items, list) else []:
            text = _get(item, p.text)
            if p.optional and not text:
                continue
            role = p.fixed or said(_get(item, p.role))
            role, text = mapping.roles.get(role, role), said(text)
            if p.optional and p.fixed and found and found[-1][0] == role:
                found[-1] = (role, f"{found[-1][1]}\n\n{text}")
            else:
                found.append((role, text))
    return found


def canonical(records: DataFrame, json_col: str, keep: list[str], mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(keep..., fingerprint long, layout string, turns array<struct<role, text>>) of records with JSON text in json_col.

    Null, malformed or unmapped records, and records nested deeper than Python reads, have layout null and no turns. Columns of keep that
    share an output's name are left out.
    """
    new = records.sparkSession.createDataFrame([], "fingerprint long, layout string, turns array<struct<role:string,text:string>>").schema
    keep = [c for c in keep if c not in new.names]
    schema = type(new)([*(records.schema[c] for c in keep), *new.fields])
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layouts = Layouts(mappings)
        for part in slices(batches):
            marks, names, turns = [], [], []
            for raw in part.column(json_col).to_pylist():
                mark, mapping, found = None, None, []
                try:
                    value = json.loads(raw) if raw is not None else None
                    if value is not None:
                        mark, mapping = layouts.of(value)
                        found = turns_of(value, mapping) if mapping else []
                except (ValueError, RecursionError):
                    mark, mapping, found = None, None, []
                marks.append(mark)
                names.append(mapping and mapping.name)
                turns.append([{"role": r, "text": t} for r, t in found])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(marks, pa.int64()), pa.array(names, pa.string()), pa.array(turns, kind)], names=[*keep, *new.names])

    return records.select(*dict.fromkeys([*keep, json_col])).mapInArrow(run, schema)


def formatted(turns: DataFrame, role: str = "role", text: str = "text", loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """turns with `formatted`, and `loss_begin`, `loss_end`: the code points of it that are under the loss mask (equal: none).

    Built-in functions only. Null roles and texts are empty. Columns of these names are replaced.
    """
    escape = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("\\<|"))
    name, body = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    head = F.concat(F.lit(TURN), F.replace(escape(name), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    inside: Column = escape(body)
    begin = F.length(head)
    end = begin + F.when(name.isin(*loss_roles), F.length(inside)).otherwise(0)
    return turns.withColumns({"formatted": F.concat(head, inside, F.lit(END + "\n")), "loss_begin": begin, "loss_end": end})


unescape = lambda s, sub=re.compile(r"\\(.)", re.DOTALL).sub: sub(r"\1", s) if "\\" in s else s
_whole = re.compile(re.escape(TURN) + r"([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n([^\\<]*+(?:(?:\\.|<(?!\|))[^\\<]*+)*+)" + re.escape(END) + r"\n", re.DOTALL)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text; ValueError for anything else."""
    found, at = [], 0
    while at < len(text):
        got = _whole.match(text, at)
        if not got:
            raise ValueError(f"no turn at {at}")
        found.append((unescape(got[1]), unescape(got[2])))
        at = got.end()
    return found


def digests(segments: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Read formatted segments back: (by, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    Segments of a key are read in `order` as one stream: a task keeps two running hashes and some counts, whatever the key's size.
    """
    schema = segments.sparkSession.createDataFrame([], "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").schema
    full = type(schema)([segments.schema[by], *schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []

        def close() -> None:
            out.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def rows() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [()] * 6
            kinds = (None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            first = pa.array(cols[0], kind) if kind else pa.array(cols[0])
            return pa.RecordBatch.from_arrays([first, *(pa.array(c, k) for c, k in zip(cols[1:], kinds[1:]))], names=full.names)

        kind = None
        for part in slices(batches, 4096):
            kind = part.column(by).type
            for k, text, a, b in zip(*(part.column(c).to_pylist() for c in (by, "formatted", "loss_begin", "loss_end"))):
                if state is None or k != key:
                    if state:
                        close()
                    key, state = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                said = unescape(text[a:b])
                state[2] += len(said)
                state[3].update(said.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            yield rows()
            out.clear()
        if state:
            close()
            yield rows()

    ready = segments.repartition(by).sortWithinPartitions(by, *order)
    return ready.select(by, "formatted", "loss_begin", "loss_end").mapInArrow(run, full)


CONTROL = "\\### Assistant: </turn> ok"


def op5_chat_formatting(spark, sf_dir: str) -> DataFrame:
    from .common import table

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], rows.schema)
    whole = F.to_json(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    got = canonical(rows.unionByName(extra).select("conv_id", "turn", whole.alias("record")), "record", ["conv_id", "turn"])
    # A row holds one turn; conversations keep the order of their rows, equal ones by role and text.
    turns = got.select("conv_id", "turn", F.posexplode("turns").alias("within", "said")).select("conv_id", "turn", "within", "said.role", "said.text")
    return digests(formatted(turns), "conv_id", ["turn", "within", "role", "text"])


def chat_layouts(spark, sf_dir: str) -> DataFrame:
    """Each turn as a record in one of five layouts, by conversation, mapped back: what comes out depends on the mapping its fingerprint selects."""
    from .common import table

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    field = lambda a, b: F.struct(F.col("role").alias(a), F.col("text").alias(b))
    kinds = (
        field("role", "text"),
        F.struct(F.array(field("role", "content")).alias("messages")),
        F.struct(F.lit("rules").alias("system"), F.array(F.struct(F.when(F.col("role") == "user", "human").otherwise("gpt").alias("from"), F.col("text").alias("value"))).alias("conversations")),
        F.struct(F.col("text").alias("question"), F.col("role").alias("answer")),
        F.struct(F.col("role").alias("who"), F.col("text").alias("what")),
    )
    record = F.lit(None).cast("string")
    for k, kind in enumerate(kinds):
        record = F.when(F.pmod("conv_id", F.lit(5)) == k, F.to_json(kind)).otherwise(record)
    got = canonical(rows.select("conv_id", "turn", record.alias("record")), "record", ["conv_id", "turn"])
    got = got.select("conv_id", "turn", "layout", F.size("turns").cast("long").alias("n_turns"), F.concat_ws("|", F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))).alias("said"))
    return got.select("conv_id", "turn", "layout", "n_turns", F.sha2(F.col("said").cast("binary"), 256).alias("said_sha256"))


CHAT_LAYOUTS_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, conv_id % 5 AS k FROM conversations),
s AS (SELECT conv_id, turn,
    CASE k WHEN 0 THEN 'row' WHEN 1 THEN 'messages' WHEN 2 THEN 'conversations' WHEN 3 THEN 'question_answer' END AS layout,
    CASE k WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE 0 END::BIGINT AS n_turns,
    CASE k WHEN 0 THEN role || ':' || text WHEN 1 THEN role || ':' || text
      WHEN 2 THEN 'system:rules|' || CASE WHEN role = 'user' THEN 'user:' ELSE 'assistant:' END || text
      WHEN 3 THEN 'user:' || text || '|assistant:' || role ELSE '' END AS said FROM c)
SELECT conv_id, turn, layout, n_turns, sha256(said) AS said_sha256 FROM s
"""


OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(role, '\', '\\'), '<|', '\<|') AS r, replace(replace(text, '\', '\\'), '<|', '\<|') AS t FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(8 + length(replace(r, chr(10), '\' || chr(10))) + 1 + length(t) + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
