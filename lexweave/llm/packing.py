"""Best-fit packing by length patterns.

Documents are tokenised, cut only where longer than a sequence, and the pieces dealt by hash to shards of about SHARD pieces. A shard
holds only lengths and ids. It rounds lengths up to BINS bins, enumerates every way of filling a sequence with at most DEPTH
bins, and fits how often to use each pattern to the shard's histogram by non-negative least squares. The rounded-down repeats are
carried out; a pattern's last document is the longest one that still fits, by exact length. A pattern that finds no more documents of its bins
stops, and the repeats are fitted again to what is left, as long as a round places at least a share of LEAST_ROUND of it. The rest
is packed longest first, each sequence filled with the longest piece that fits. Shards grow in number with the input, never in size; a shard
wastes at most about one sequence more than a global packing would.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, settle, slices, texts_of

CAPACITY = 4096
END_ID = 1
SHARD = 1 << 17
BINS, DEPTH = 128, 3
#: The share of the pieces left that a round of patterns must place for another to follow.
LEAST_ROUND = 0.02
#: Distinct words whose ids a worker remembers, and bytes of words and ids.
REMEMBERED, REMEMBERED_BYTES = 450_000, 48 << 20

PIECES = "piece int, start long, length long, ids_crc32 long"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 bytes for themselves, the others, in order, for U+0100 and up."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = itertools.count(0x100)
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class ByteSpelling(dict):
    """For str.translate: spells a character by the letters of its UTF-8 bytes."""

    letters = byte_letters()

    def __missing__(self, code: int) -> str:
        self[code] = got = "".join(self.letters[b] for b in chr(code).encode("utf-8", "surrogatepass"))
        return got


class WordIds:
    """ids of whole texts, word by word, for tokenizers that never join text across white space: a word's ids don't depend on its neighbours.

    That is so for byte-level BPE with word ends over lower-cased text cut by a pattern (see by_words); files of any other kind go through the tokenizer
    whole. Words are remembered (at most REMEMBERED of them and as many of their parts, REMEMBERED_BYTES each), so that byte-pair merging runs once for a
    word, not once for each occurrence. Texts with characters other than printable ASCII and Latin letters below U+0250, for which normal forms and classes of
    characters are simple, and texts that spell a special token go to the tokenizer whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.full = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.full.get_added_tokens_decoder().values())
        self.plain = regex.compile(r"[\t\n\r\x20-\x7e\xa1-\u024f]*+").fullmatch
        parsed = json.loads(self.full.to_str())
        self.by_words = by_words(parsed)
        if self.by_words:
            self.parts = regex.compile(parsed["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.spelling = ByteSpelling()
        self.known: dict[str, bytes] = {}
        self.known_parts: dict[str, bytes] = {}
        self.size = self.parts_size = 0

    def _learn(self, words: set[str]) -> None:
        known, parts, merge, spelling = self.known_parts, self.parts, self.full.model.tokenize, self.spelling
        if len(known) > REMEMBERED or self.parts_size > REMEMBERED_BYTES:
            known.clear()
            self.parts_size = 0
        for word in words:
            ids = []
            for x in parts(word.lower()):
                got = known.get(x)
                if got is None:
                    got = known[x] = array("I", [t.id for t in merge(x.translate(spelling))]).tobytes()
                    self.parts_size += len(x) + len(got)
                ids.append(got)
            self.known[word] = got = b"".join(ids)
            self.size += len(word) + len(got)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = []
        for x in texts:
            if self.by_words and self.plain(x) and not any(s in x for s in self.special):
                words = x.split()
                new = set(words).difference(self.known)
                if new:
                    if len(self.known) > REMEMBERED or self.size > REMEMBERED_BYTES:
                        self.known.clear()
                        self.size, new = 0, set(words)
                    self._learn(new)
                out.append(b"".join(map(self.known.__getitem__, words)))
            else:
                out.append(np.array(self.full.encode(x, add_special_tokens=False).ids, "<u4").tobytes())
        return out


def by_words(parsed: dict) -> bool:
    """Whether a tokenizer file works on words alone: composes, folds white space and lower-cases; cuts by a pattern that drops what lies between; BPE of bytes with word ends."""
    steps = (parsed.get("normalizer") or {}).get("normalizers", [])
    cuts = (parsed.get("pre_tokenizer") or {}).get("pretokenizers", [])
    model = parsed["model"]
    return (
        [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"]
        and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
        and cuts[0]["pattern"].get("Regex", "").endswith(r"[^\s\p{L}\p{N}]+")
        and (cuts[0]["behavior"], cuts[0]["invert"]) == ("Removed", True)
        and not (cuts[1]["add_prefix_space"] or cuts[1]["use_regex"])
        and model["type"] == "BPE"
        and bool(model["end_of_word_suffix"])
        and not model["dropout"]
    )


def tokenizer(path: str) -> WordIds:
    return kept(("ids", path), lambda: WordIds(path))


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32), and `ids binary` if asked for: each document's ids, then end_id, cut every `capacity` ids. A null text is empty."""
    kind = docs.schema[id_col].dataType
    schema = docs.sparkSession.createDataFrame([], PIECES + ", ids binary" * with_ids).schema
    schema = type(schema)([type(schema.fields[0])("id", kind), *schema.fields])
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        for part in slices(batches):
            row, piece, start, length, crc, raw = [], [], [], [], [], []
            for i, ids in enumerate(encode(texts_of(part, text_col))):
                ids += tail
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
                    if with_ids:
                        raw.append(cut)
            yield pa.RecordBatch.from_arrays([part.column(id_col).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), *[pa.array(raw, pa.binary())] * with_ids], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


@functools.cache
def patterns(bins: int, depth: int) -> np.ndarray:
    """Every way to write `bins` as a sum of at most `depth` bins, longest first, padded with zeros."""
    found = []

    def extend(head: tuple[int, ...], left: int) -> None:
        if not left:
            found.append(head + (0,) * (depth - len(head)))
            return
        if len(head) == depth:
            return
        for b in range(min(left, head[-1] if head else left), 0, -1):
            if b * (depth - len(head)) < left:
                break
            extend((*head, b), left - b)

    extend((), bins)
    return np.array(found)


def fit(columns: np.ndarray, wanted: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares by the active-set method: repeats x of each pattern with sum(x * pattern) near the histogram `wanted`."""
    n, bins = len(columns), len(wanted)
    rows = np.repeat(np.arange(n), columns.shape[1])
    counts = np.zeros((n, bins + 1))
    np.add.at(counts, (rows, columns.ravel()), 1)
    counts = counts[:, 1:]
    x, active = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(wanted).max(initial=0)))
    for _ in range(rounds):
        gain = counts @ (wanted - counts[active].T @ x[active])
        gain[active] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= tolerance:
            break
        active[j] = True
        while True:
            where = np.flatnonzero(active)
            solved = np.linalg.lstsq(counts[where].T, wanted, rcond=None)[0]
            if (solved > tolerance).all():
                x[:] = 0
                x[where] = solved
                break
            bad = solved <= tolerance
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.where(bad, x[where] / (x[where] - solved), np.inf)
            x[where] += max(0.0, float(np.nanmin(step))) * (solved - x[where])
            drop = where[bad & (x[where] <= tolerance)]
            if not len(drop):
                drop = where[[int(np.nanargmin(step))]]
            x[drop] = 0
            active[drop] = False
            if not active.any():
                return x
    return x


def pack(lengths: np.ndarray, capacity: int = CAPACITY, bins: int = BINS, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; sequences are numbered from 0 and filled from 0 without gaps."""
    n = len(lengths)
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return sequence, offset
    left = np.bincount(lengths, minlength=capacity + 1).tolist()
    have = sum(1 << size for size, c in enumerate(left) if c)
    made: list[list[int]] = []
    width = -(-capacity // bins)
    bin_of = -(-np.arange(capacity + 1) // width)

    def take(size: int) -> None:
        nonlocal have
        left[size] -= 1
        if not left[size]:
            have &= ~(1 << size)

    def longest(limit: int) -> int:
        """The greatest length still there that is at most limit, else 0."""
        return (have & ((1 << (limit + 1)) - 1)).bit_length() - 1 if limit > 0 and have & ((1 << (limit + 1)) - 2) else 0

    def fill(seq: list[int], room: int) -> None:
        while size := longest(room):
            take(size)
            seq.append(size)
            room -= size

    for _ in range(left[capacity]):
        made.append([capacity])
    left[capacity] = 0
    have &= ~(1 << capacity)
    ways = patterns(bins, depth)
    while True:
        waiting = sum(left)
        wanted = np.bincount(bin_of, weights=left, minlength=bins + 1)[1:]
        for way, repeats in zip(ways.tolist(), np.floor(fit(ways, wanted) + 1e-6).astype(int).tolist()):
            heads = [b for b in way if b][:-1]
            for _ in range(repeats):
                seq, room = [], capacity
                for b in heads:
                    size = longest(min(room, b * width))
                    if size <= (b - 1) * width:
                        break
                    take(size)
                    seq.append(size)
                    room -= size
                if len(seq) == len(heads) and (size := longest(room)) > room - width:
                    take(size)
                    seq.append(size)
                    fill(seq, room - size)
                    made.append(seq)
                else:  # what the pattern needs has gone: its documents wait for the next fit
                    for size in seq:
                        left[size] += 1
                        have |= 1 << size
                    break
        if waiting - sum(left) <= LEAST_ROUND * waiting:
            break
    while size := longest(capacity):
        take(size)
        seq = [size]
        fill(seq, capacity - size)
        made.append(seq)
    order = np.argsort(lengths, kind="stable")
    sizes = np.array(list(itertools.chain.from_iterable(made)), np.int64)
    number = np.repeat(np.arange(len(made)), [len(s) for s in made])
    ends = np.cumsum(sizes)
    first = np.searchsorted(number, np.arange(len(made)))
    place = ends - sizes - np.repeat((ends - sizes)[first], [len(s) for s in made])
    slot = np.argsort(sizes, kind="stable")
    sequence[order], offset[order] = number[slot], place[slot]
    return sequence, offset


def packed(parts: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """parts(id, piece, start, length, ids_crc32) with sequence_id and offset. parts is read twice: settle it first."""
    total = parts.count()
    shards = max(1, -(-total // shard))
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("id", "piece", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)))
    schema = parts.sparkSession.createDataFrame([], "sequence_id long, offset long").schema
    names = parts.columns

    def run(key: tuple, group: pa.Table) -> pa.Table:
        seq, off = pack(group.column("length").to_numpy(), capacity)
        group = group.select(names)
        return group.append_column("sequence_id", pa.array((int(key[0].as_py()) << 32) + seq)).append_column("offset", pa.array(off))

    return dealt.groupBy("shard").applyInArrow(run, type(schema)([*parts.schema.fields, *schema.fields]))


def best_fit(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack every document: one row per piece (id, piece, start, length, ids_crc32, sequence_id, offset).

    A null or empty text is the end id alone. A text longer than a sequence is cut into full pieces and a rest. Repeated rows are
    packed once each; a null id stays null. Only the id and text columns are read. An empty table gives no rows. sequence_id values are
    any distinct numbers.
    """
    return packed(settle(pieces(docs, path, id_col, text_col, capacity, end_id), "packing"), capacity).withColumnRenamed("id", id_col)


def token_sequences(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids binary, n_tokens, parts array<struct<id, piece, length>>).

    ids are little-endian unsigned 32-bit numbers, parts in their order. Only lengths are gathered to pack; ids join them afterwards by a row
    number, and a sequence gathers at most `capacity` pieces.
    """
    full = settle(pieces(docs, path, id_col, text_col, capacity, end_id, with_ids=True).withColumn("at", F.monotonically_increasing_id()), "packing-ids")
    placed = packed(full.drop("ids"), capacity).join(full.select("at", "ids"), "at")
    grouped = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "id", "piece", "length", "ids"))).alias("x"), F.sum("length").alias("n_tokens"))
    joined = F.aggregate("x", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return grouped.select("sequence_id", joined.alias("ids"), "n_tokens", F.transform("x", lambda p: F.struct(p["id"].alias("id"), p["piece"].alias("piece"), p["length"].alias("length"))).alias("parts"))


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
