"""Language-model scoring with a log-frequency Bloom filter.

Counts. One scan of the training documents turns words into 64-bit hashes, pairs of neighbours into 48-bit ones, and counts both in numpy;
what a task has counted leaves it as sorted blobs by hash range, so a frequent word costs one entry a blob. Each range merges its
blobs, MERGE_AT_ONCE entries at a time, into exact counts. There are enough ranges that one holds at most about RANGE_BYTES of text, whatever the input.

Filter. A count is quantised to a level on a logarithmic scale and an n-gram goes into the filter once for each level up to its own; asking
for level 1, 2, ... until a probe fails gives the level back, never too low, and too high only by a false positive. Every word and every
pair of the training texts is held. The filter is as large as its entries ask for, at least BITS_PER_ENTRY bits each, whatever the
corpus. A block of 512 bits holds all an n-gram's bits, and each range has blocks of its own, so it builds its piece of the filter where it merges
its counts, and pairs are never stored. A filter of at most MAX_FILTER_BYTES is broadcast; a larger one stays in its pieces: texts are read in chunks of
FLUSH tokens, each chunk's distinct n-grams go to the ranges that hold them, and their levels come back to the chunk. Both ways read the same bits.

Scores. P(w|v) = l * c(vw) / c(v) + (1 - l) * (c(w) + 0.5) / (N + 0.5 * (V + 1)) with counts read from the filter: a level stands for the mean
count of its members, so the counts still sum to N. A text's score thus depends only on how many of its tokens fall into each cell (level of the
word before, level of the pair, level of the word): one scan reads the filter and leaves those cells behind. The weight l depends on the
level of v and is fitted by expectation maximisation over the cells of all training text, each occurrence left out of its own counts;
scores follow from the stored cells.

Exact unigram figures. Words frequent enough to be among the HEAD most frequent (by level) are looked up in a broadcast table of at most HEAD
entries; all others go, counted by document, to the range that has their count. No word is left out either way.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder, settle, slices, split_words, texts_of

#: Level boundaries: the distinct whole numbers among the powers of the square root of two, up to 2 ** 40.
EDGES = np.unique(np.ceil(2.0 ** (np.arange(81) / 2) - 1e-9).astype(np.int64))
LEVELS = len(EDGES) + 1
BITS_PER_ENTRY, PROBES, MAX_FILTER_BYTES = 12, 6, 1 << 27
HEAD = 200_000
#: Bytes of training text a hash range is made for, and counted n-grams a range merges at once.
RANGE_BYTES, MERGE_AT_ONCE = 16 << 20, 1 << 20
#: Tokens counted before a task lets go of its counts; distinct words a worker remembers, and bytes of them.
FLUSH, REMEMBERED, REMEMBERED_BYTES = 1_000_000, 200_000, 32 << 20
ROUNDS = 25

U = np.uint64
END, START = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
#: Lowest bits of word and of pair hashes that are always zero.
UNUSED = (U(0), U(16))
FILTER_ROWS = np.dtype("<u8")
#: A broadcast bytearray's file begins with three bytes and its length; so many empty bytes put the filter's numbers behind them in step.
BROADCAST_HEAD, SKIPPED = b"\x80\x05\x96", 5


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that leaves no bit where it was."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """48 bits, so that sorted pairs take few bytes; up to a million million distinct pairs the filter's false positives outnumber shared hashes."""
    return mix(left * U(0x9FB21C651E98DF25) + (right ^ (right << U(17)))) >> UNUSED[1] << UNUSED[1]


class Words(dict):
    """Word -> index; hashes by index. Index 0 is the end of a text."""

    def __init__(self):
        super().__init__()
        self.hashes, self.size = [int(END)], 0

    def __missing__(self, word: bytes) -> int:
        self[word] = got = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word, 0))
        self.size += len(word)
        return got

    def tidy(self) -> bool:
        """Forget everything once too much is remembered."""
        if len(self.hashes) <= REMEMBERED and self.size <= REMEMBERED_BYTES:
            return False
        self.clear()
        self.size = 0
        del self.hashes[1:]
        return True


def tokens(words: Words, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index of every token, where each text begins and the last ends); each text ends with index 0."""
    found, ends = [], [0]
    get = words.__getitem__
    for x in texts:
        found += map(get, split_words(x))
        found.append(0)
        ends.append(len(found))
    return np.array(found, np.int64), np.array(ends)


def pairs_of(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each token with the one before it, START before a text's first."""
    left = np.empty_like(hashes)
    left[1:] = hashes[:-1]
    left[ends[:-1]] = START
    return pair_hash(left, hashes)


def squeeze(x: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as their first one and differences of as few bytes as the largest takes."""
    if not len(x):
        return b""
    d = np.diff(x)
    wide = max(1, -(-int(d.max()).bit_length() // 8)) if len(d) else 1
    return bytes([wide]) + x[:1].astype("<u8").tobytes() + np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide]).tobytes()


def expand(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, U)
    d = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, raw[0])
    out = np.zeros((len(d) + 1, 8), np.uint8)
    out[0] = np.frombuffer(raw, np.uint8, 8, 1)
    out[1:, : raw[0]] = d
    return np.cumsum(out.view("<u8").ravel(), dtype=U)


def thin(x: np.ndarray) -> bytes:
    """Whole numbers, none negative, in as few bytes each as the largest takes."""
    wide = next(w for w in (1, 2, 4, 8) if int(x.max(initial=0)) < 1 << 8 * w)
    return bytes([wide]) + x.astype(f"<u{wide}").tobytes()


def fat(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def merged(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes with their counts added up."""
    if not hashes:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h, c = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    if not len(h):
        return h, c
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return h[first], np.add.reduceat(c, first)


def level(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(EDGES, counts, side="right")


def _cut(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of `ranges` equal ranges (a power of two) begins in sorted hashes, and the end."""
    shift = 64 - (ranges.bit_length() - 1)
    bounds = np.arange(1, ranges).astype(U) << U(shift) if ranges > 1 else np.zeros(0, U)
    return np.r_[0, np.searchsorted(hashes, bounds), len(hashes)]


def _before(levels: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The level of the word before each token; a text's start is as frequent as its end."""
    got = np.empty_like(levels)
    got[1:] = levels[:-1]
    got[ends[:-1]] = levels[ends[1:] - 1]
    return got


def _cells(ends: np.ndarray, single: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, cell, tokens) for every text and cell that has any, in order."""
    cell = (_before(single, ends) * LEVELS + pair) * LEVELS + single
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    both, n = np.unique(text * LEVELS**3 + cell, return_counts=True)
    return both // LEVELS**3, both % LEVELS**3, n


BLOBS = "range int, kind int, hashes binary, counts binary"
MERGED = "range int, words binary, word_counts binary, bits binary, blocks long, stats array<double>"


def _count(batches: Iterator[pa.RecordBatch], text_col: str, ranges: int, most: int) -> Iterator[pa.RecordBatch]:
    words, held, size = Words(), ([], []), 0

    def flush() -> Iterator[pa.RecordBatch]:
        """One kind after the other, some ranges at a time, so that neither side holds all of it."""
        for kind in (0, 1):
            h, c = np.unique(np.concatenate(held[kind]), return_counts=True)
            held[kind].clear()
            cut = _cut(h, ranges)
            full = np.flatnonzero(np.diff(cut))
            for some in np.array_split(full, max(1, len(full) // 32)):
                spans = [(cut[r], cut[r + 1]) for r in some]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), kind, np.int32)), pa.array([squeeze(h[a:b] >> UNUSED[kind]) for a, b in spans], pa.binary()), pa.array([thin(c[a:b]) for a, b in spans], pa.binary())], names=["range", "kind", "hashes", "counts"])

    for part in slices(batches):
        words.tidy()
        index, ends = tokens(words, texts_of(part, text_col))
        h = np.array(words.hashes, U)[index]
        held[0].append(h)
        held[1].append(pairs_of(h, ends))
        size += len(h)
        if size >= most:
            yield from flush()
            size = 0
    if size:
        yield from flush()


def _merge(key: tuple, group: pa.Table, ranges: int, bits: int, at_once: int) -> pa.Table:
    """Exact counts of a range, and its piece of the filter. stats: for words by level the types and tokens, then for pairs."""
    got = []
    for kind in (0, 1):
        rows = group.filter(pa.compute.equal(group.column("kind"), kind))
        sums, waiting, size = merged([], []), [], 0
        for h, c in zip(*(rows.column(x) for x in ("hashes", "counts"))):
            waiting.append((expand(h.as_py()) << UNUSED[kind], fat(c.as_py())))
            size += len(waiting[-1][0])
            if size >= at_once:
                sums, waiting, size = merged(*zip(sums, *waiting)), [], 0
        got.append(merged(*zip(sums, *waiting)))
    (w, wc), (p, pc) = got
    stats = np.concatenate([np.bincount(level(c), weights=x, minlength=LEVELS)[:LEVELS] for c in (wc, pc) for x in (None, c)])
    entries = int(level(wc).sum() + level(pc).sum())
    piece = Filter.piece(np.zeros(8 * max(1, -(-entries * bits // 512)), FILTER_ROWS), ranges)
    piece.add(w, level(wc))
    piece.add(p, level(pc))
    cols = ([key[0].as_py()], [squeeze(w)], [thin(wc)], [piece.bits.tobytes()], [len(piece.bits) // 8], [stats.tolist()])
    return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.float64())))], names=["range", "words", "word_counts", "bits", "blocks", "stats"])


class Facts(NamedTuple):
    """What scoring needs besides the filter; sizes do not depend on the corpus."""

    tokens: int
    types: int
    #: Mean count of a word and of a pair by level.
    word_mean: np.ndarray
    pair_mean: np.ndarray
    #: Words of at least this level are in the head table.
    head_level: int
    #: Bits of the filter for each of its entries.
    bits: float

    def unigram(self) -> np.ndarray:
        """Smoothed probability by level."""
        return (self.word_mean + 0.5) / (self.tokens + 0.5 * (self.types + 1))


class Filter:
    """Blocked Bloom filter: blocks of eight 64-bit numbers. A hash's top bits choose the range, its next 32 one of the range's blocks.

    starts: the first block of each range, and the end.
    """

    def __init__(self, bits: np.ndarray, starts: np.ndarray, ranges: int):
        self.bits, self.starts, self.top = bits, starts.astype(U), ranges.bit_length() - 1

    @classmethod
    def piece(cls, bits: np.ndarray, ranges: int) -> Filter:
        """One range's part, to be asked only for hashes of that range."""
        return cls(bits, np.array([0, len(bits) // 8]), ranges)

    @staticmethod
    def spread(hashes: np.ndarray, of_level: int) -> np.ndarray:
        """A number whose PROBES lowest runs of nine bits are the places, 0 to 511 in the block, that say an n-gram has a level."""
        return mix(hashes + U(of_level * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))

    def _block(self, hashes: np.ndarray) -> np.ndarray:
        """Index of the block's first number."""
        inside = hashes << U(self.top) >> U(32)
        if len(self.starts) == 2:
            return ((inside * self.starts[1] >> U(32)) << U(3)).astype(np.int64)
        at = (hashes >> U(64 - self.top)).astype(np.int64)
        first = self.starts[at]
        return (first + (inside * (self.starts[at + 1] - first) >> U(32)) << U(3)).astype(np.int64)

    def add(self, hashes: np.ndarray, levels: np.ndarray) -> None:
        block = self._block(hashes)
        for j in range(1, int(levels.max(initial=0)) + 1):
            use = np.flatnonzero(levels >= j)
            hashes, block, levels = hashes[use], block[use], levels[use]
            g = self.spread(hashes, j)
            for i in range(PROBES):
                place = (g >> U(9 * i)) & U(511)
                np.bitwise_or.at(self.bits, block + (place >> U(6)).astype(np.int64), U(1) << (place & U(63)))

    def _there(self, hashes: np.ndarray, block: np.ndarray, of_level: int) -> np.ndarray:
        """Positions of the n-grams all of whose probes for a level succeed; most that aren't there leave at the first probes."""
        g, at = self.spread(hashes, of_level), None
        for i in range(PROBES):
            place = (g >> U(9 * i)) & U(511)
            hit = np.flatnonzero((self.bits[block + (place >> U(6)).astype(np.int64)] >> (place & U(63))) & U(1))
            if len(hit) < len(g):
                g, block = g[hit], block[hit]
                at = hit if at is None else at[hit]
        return np.arange(len(hashes)) if at is None else at

    def level(self, hashes: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
        """Probe level after level until one is not there; n-grams whose bound `most` is zero aren't asked for."""
        got = np.zeros(len(hashes), np.int64)
        asked = np.arange(len(hashes)) if most is None else np.flatnonzero(most >= 1)
        found = asked[self._there(hashes[asked], self._block(hashes[asked]), 1)]
        if not len(found):
            return got
        h, back = np.unique(hashes[found], return_inverse=True)
        block, at, levels = self._block(h), np.arange(len(h)), np.ones(len(h), np.int64)
        for j in range(2, LEVELS):
            there = self._there(h, block, j)
            if not len(there):
                break
            h, block, at = h[there], block[there], at[there]
            levels[at] = j
        got[found] = levels[back]
        return got


def _mapped(held) -> np.ndarray:
    """The numbers of a broadcast filter. Mapped from the file Spark keeps a broadcast in, so that the workers of a machine share one copy; read where that isn't possible."""
    path = getattr(held, "_path", None)
    if path and os.path.exists(path):
        with open(path, "rb") as f:
            head, size = f.read(3), int.from_bytes(f.read(8), "little")
        if head == BROADCAST_HEAD and size + 11 <= os.path.getsize(path):
            return np.asarray(np.memmap(path, FILTER_ROWS, "r", 11 + SKIPPED, ((size - SKIPPED) // 8,)))
    return np.frombuffer(held.value, FILTER_ROWS, offset=SKIPPED)


class Model(NamedTuple):
    facts: Facts
    filter: object  # broadcast of SKIPPED bytes and the filter's, or None
    starts: np.ndarray  # the first block of each range in it, and the end
    head: object  # broadcast of (hashes, counts) of the head, sorted
    #: Settled counts by range, for the words outside the head.
    counts: DataFrame
    ranges: int
    #: Settled pieces of a filter that is too large to broadcast (filter is None then): (range, bits).
    pieces: DataFrame | None = None


def learn(docs: DataFrame, text_col: str = "text") -> Model:
    """Count every text of docs and build the filter. Null texts are empty; an empty table gives a model without counts."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    ranges = 1 << (max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES), 1) - 1).bit_length()
    most, bits_each, at_once = FLUSH, BITS_PER_ENTRY, MERGE_AT_ONCE
    blobs = docs.select(text_col).mapInArrow(lambda b: _count(b, text_col, ranges, most), BLOBS)
    counts = settle(blobs.groupBy("range").applyInArrow(lambda key, group: _merge(key, group, ranges, bits_each, at_once), MERGED), "lm-counts")
    sums = counts.select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    stats = np.zeros(4 * LEVELS)
    for i, x in sums:
        stats[i] = x
    word_types, word_tokens, pair_types, pair_tokens = stats.reshape(4, LEVELS)
    safe = lambda a, b: np.divide(a, b, out=np.zeros(LEVELS), where=b > 0)
    entries = int(((word_types + pair_types) * np.arange(LEVELS)).sum())
    above = np.cumsum(word_types[::-1])[::-1]
    head_level = int(np.argmax(above <= HEAD)) if (above <= HEAD).any() else LEVELS
    blocks = counts.agg(F.sum("blocks")).first()[0] or 0
    facts = Facts(int(word_tokens.sum()), int(word_types.sum()), safe(word_tokens, word_types), safe(pair_tokens, pair_types), head_level, 512 * blocks / max(1, entries))
    small = 64 * blocks <= MAX_FILTER_BYTES

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            row = part.to_pylist()[0]
            w, wc = expand(row["words"]), fat(row["word_counts"])
            top = level(wc) >= head_level
            yield pa.RecordBatch.from_arrays([part.column("range"), part.column("bits"), pa.array([w[top].tobytes()], pa.binary()), pa.array([wc[top].tobytes()], pa.binary())], names=["range", "bits", "head", "head_counts"])

    # At most MAX_FILTER_BYTES and HEAD entries come to the driver.
    made = counts.select("range", "words", "word_counts", "bits" if small else F.lit(None).cast("binary").alias("bits"))
    made = made.mapInArrow(parts, "range int, bits binary, head binary, head_counts binary")
    sizes = np.zeros(ranges, np.int64)
    if small:
        for r, n in counts.select("range", "blocks").toLocalIterator():
            sizes[r] = n
    # A range without an n-gram has an empty block.
    starts = np.r_[0, np.cumsum(np.maximum(sizes, 1))]
    bits = bytearray(SKIPPED + 64 * int(starts[-1]) if small else 0)
    head_h, head_c = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for r, raw, h, c in made.toLocalIterator(prefetchPartitions=True):
        if small:
            at = SKIPPED + 64 * int(starts[r])
            bits[at : at + len(raw)] = raw
        head_h.append(np.frombuffer(bytes(h), "<u8"))
        head_c.append(np.frombuffer(bytes(c), "<i8"))
    order = np.argsort(np.concatenate(head_h))
    head = (np.concatenate(head_h)[order], np.concatenate(head_c)[order])
    context = spark.sparkContext
    return Model(facts, context.broadcast(bits) if small else None, starts, context.broadcast(head), counts.select("range", "words", "word_counts"), ranges, None if small else counts.select("range", "bits"))


class Reader:
    """A worker's view of the model: levels (zero without a broadcast filter) and head counts by remembered word."""

    def __init__(self, held: Filter | None, head: tuple[np.ndarray, np.ndarray]):
        self.filter, self.head = held, head
        self.words = Words()
        self._seen = 0
        self.hashes, self.levels, self.counts = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(index, ends, level of each token, level of each pair); index points into hashes, levels and counts (-1 outside the head)."""
        if self.words.tidy():
            self._seen = 0
            self.hashes, self.levels, self.counts = self.hashes[:0], self.levels[:0], self.counts[:0]
        index, ends = tokens(self.words, texts)
        new = np.array(self.words.hashes[self._seen :], U)
        if len(new):
            self._seen += len(new)
            h, c = self.head
            at = np.minimum(np.searchsorted(h, new), max(0, len(h) - 1))
            known = h[at] == new if len(h) else np.zeros(len(new), bool)
            self.hashes = np.r_[self.hashes, new]
            self.levels = np.r_[self.levels, self.filter.level(new) if self.filter else np.zeros(len(new), np.int64)]
            self.counts = np.r_[self.counts, np.where(known, c[at] if len(h) else 0, -1)]
        single = self.levels[index]
        if self.filter is None:
            return index, ends, single, np.zeros(len(index), np.int64)
        # A pair is no more frequent than either of its words.
        pair = self.filter.level(pairs_of(self.hashes[index], ends), np.minimum(single, _before(single, ends)))
        return index, ends, single, pair


def _binary(values: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """values, sorted by row, as one binary value a row."""
    at = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(values.tobytes())])


def _weights(facts: Facts, cells: DataFrame) -> np.ndarray:
    """Weight of the pair estimate by the level of the word before, from cells(cells binary, cell_n binary) of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(LEVELS**3, np.int64)
        for part in batches:
            cell, n = (np.frombuffer(b"".join(part.column(c).to_pylist()), "<u4") for c in ("cells", "cell_n"))
            sums += np.bincount(cell, weights=n, minlength=len(sums)).astype(np.int64)
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(sums[found])], names=["cell", "n"])

    got = cells.select("cells", "cell_n").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cell, n = got["cell"].to_numpy(np.int64), got["n"].to_numpy(np.float64)
    left, pair, single = cell // LEVELS**2, cell // LEVELS % LEVELS, cell % LEVELS
    by_pair = np.minimum(np.maximum(facts.pair_mean[pair] - 1, 0) / np.maximum(facts.word_mean[left] - 1, 1), 1)
    alone, share = facts.unigram()[single], np.full(LEVELS, 0.5)
    total = np.bincount(left, weights=n, minlength=LEVELS)
    for _ in range(ROUNDS):
        p = share[left] * by_pair
        due = np.bincount(left, weights=n * p / np.maximum(p + (1 - share[left]) * alone, 1e-300), minlength=LEVELS)
        share = np.divide(due, total, out=np.zeros(LEVELS), where=total > 0)
    share[0] = 0
    return np.minimum(share, 0.999)


def log10_of_cells(facts: Facts, weight: np.ndarray) -> np.ndarray:
    """log10 probability of a token by cell."""
    by_pair = np.minimum(facts.pair_mean[None, :] / np.maximum(facts.word_mean[:, None], 1.0), 1.0)
    return np.log10((weight[:, None] * by_pair)[:, :, None] + (1 - weight)[:, None, None] * facts.unigram()[None, None, :]).ravel()


SCORED = "row long, learnt boolean, range int, n_tokens long, known long, logs double, cells binary, cell_n binary, tail_rows binary, tail_words binary, tail_n binary"
#: Besides, of a chunk of texts: its rows, where they end, its distinct words and each token's place among them.
CHUNK = "chunk long, chunk_rows binary, chunk_ends binary, chunk_words binary, at_word binary"
OF_CHUNK = [x.split()[0] for x in CHUNK.split(", ")][1:]


def _pack(row: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> list[bytes]:
    """OF_CHUNK of texts with so many tokens each."""
    words, at = np.unique(hashes, return_inverse=True)
    wide = max(1, -(-len(words).bit_length() // 8))
    places = np.ascontiguousarray(at.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :wide])
    return [row.astype("<i8").tobytes(), np.r_[0, np.cumsum(sizes)].astype("<i8").tobytes(), squeeze(words), bytes([wide]) + zlib.compress(places.tobytes(), 1)]


def _unpack(rows: bytes, ends: bytes, words: bytes, at_word: bytes) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(rows, ends, for words and for pairs the sorted distinct hashes and each token's place among them)."""
    ends, h = np.frombuffer(ends, "<i8"), expand(words)
    raw = np.frombuffer(zlib.decompress(at_word[1:]), np.uint8).reshape(-1, at_word[0])
    at = np.zeros((len(raw), 4), np.uint8)
    at[:, : at_word[0]] = raw
    at = at.view("<u4").ravel()
    return np.frombuffer(rows, "<i8"), ends, [(h, at), np.unique(pairs_of(h[at], ends), return_inverse=True)]


def _ask(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """What each chunk's distinct n-grams ask of the ranges."""
    for part in slices(batches, 1):
        chunk, *packed = (part.column(c)[0].as_py() for c in ("chunk", *OF_CHUNK))
        for kind, (h, _) in enumerate(_unpack(*packed)[2]):
            cut = _cut(h, ranges)
            full = np.flatnonzero(np.diff(cut))
            for some in np.array_split(full, max(1, len(full) // 32)):
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([chunk] * n, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array([squeeze(h[cut[r] : cut[r + 1]] >> UNUSED[kind]) for r in some], pa.binary())], names=["range", "chunk", "kind", "asked"])


def _cells_by_range(got: DataFrame, model: Model) -> DataFrame:
    """(row, cells, cell_n) of every text in the chunks of got, read from the pieces of the filter where they lie."""
    ranges = model.ranges
    chunks = got.where("chunk is not null").select("chunk", *OF_CHUNK)
    asked = chunks.mapInArrow(lambda b: _ask(b, ranges), "range int, chunk long, kind int, asked binary").withColumn("bits", F.lit(None).cast("binary"))
    pieces = model.pieces.select("range", F.lit(None).cast("long").alias("chunk"), F.lit(None).cast("int").alias("kind"), F.lit(None).cast("binary").alias("asked"), "bits")

    def answer(key: tuple, group: pa.Table) -> pa.Table:
        bits = group.filter(pa.compute.is_valid(group.column("bits"))).column("bits").to_pylist()
        piece = Filter.piece(np.frombuffer(bits[0], FILTER_ROWS), ranges) if bits else None
        out = []
        for kind in (0, 1):
            rows = group.filter(pa.compute.equal(group.column("kind"), kind))
            h = [expand(x) << UNUSED[kind] for x in rows.column("asked").to_pylist()]
            every = np.concatenate([np.zeros(0, U), *h])
            levels = (piece.level(every) if piece else np.zeros(len(every), np.int64)).astype(np.uint8)
            end = np.cumsum([0, *map(len, h)])
            out.append(pa.table({"chunk": rows.column("chunk"), "kind": rows.column("kind"), "range": pa.array([key[0].as_py()] * len(h), pa.int32()), "levels": pa.array([levels[a:b].tobytes() for a, b in zip(end[:-1], end[1:])], pa.binary())}))
        return pa.concat_tables(out)

    answers = asked.unionByName(pieces).groupBy("range").applyInArrow(answer, "chunk long, kind int, range int, levels binary")
    chunks = chunks.select("chunk", *[F.lit(None).cast(k).alias(c) for c, k in (("kind", "int"), ("range", "int"), ("levels", "binary"))], *OF_CHUNK)
    answers = answers.select("*", *[F.lit(None).cast("binary").alias(c) for c in OF_CHUNK])

    def assemble(group: pa.Table) -> pa.Table:
        chunk = group.filter(pa.compute.is_valid(group.column("chunk_rows")))
        row, ends, places = _unpack(*(chunk.column(c)[0].as_py() for c in OF_CHUNK))
        levels = []
        for kind, (_, at) in enumerate(places):
            rows = group.filter(pa.compute.equal(group.column("kind"), kind)).sort_by("range")
            levels.append(np.frombuffer(b"".join(rows.column("levels").to_pylist()), np.uint8)[at].astype(np.int64))
        single, pair = levels
        # As in Reader: a pair is no more frequent than either of its words.
        pair = np.where(np.minimum(single, _before(single, ends)) >= 1, pair, 0)
        text, cell, n = _cells(ends, single, pair)
        return pa.table({"row": row, "cells": _binary(cell.astype("<u4"), text, len(row)), "cell_n": _binary(n.astype("<u4"), text, len(row))})

    return settle(chunks.unionByName(answers).groupBy("chunk").applyInArrow(assemble, "row long, cells binary, cell_n binary"), "lm-cells")


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", learnt: Column | None = None) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    learnt: which rows the model was learnt from; the weights are fitted on them (by default on all rows; without any, pairs have no weight).
    base_score: the add-one-half unigram log10 probability with exact counts. A null or empty text is one token, its end. Repeated rows give
    repeated rows, a null id stays null; other columns are ignored. An empty table gives no rows.
    """
    facts, raw, starts, head, ranges = model.facts, model.filter, model.starts, model.head, model.ranges
    kind = docs.schema[id_col]
    large = raw is None
    schema = docs.sparkSession.createDataFrame([], f"{SCORED}, {CHUNK}" if large else SCORED).schema
    schema = type(schema)([type(kind)("ident", kind.dataType), *schema.fields])
    names = schema.names[1:]
    kinds = (pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), *[pa.binary()] * 5, *((pa.int64(), *[pa.binary()] * 4) if large else ()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(None if large else Filter(_mapped(raw), starts, ranges), head.value)
        rows, words, times, size = [], [], [], 0
        waiting, tokens_in = [], 0

        def tail() -> pa.RecordBatch | None:
            r, h, n = np.concatenate(rows), np.concatenate(words), np.concatenate(times)
            order = np.argsort(h)
            r, h, n = r[order], h[order], n[order]
            cut = _cut(h, ranges)
            got = [(i, r[a:b].astype("<i8").tobytes(), squeeze(h[a:b]), n[a:b].astype("<u4").tobytes()) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
            none = [None] * len(got)
            cols = dict(zip(("range", "tail_rows", "tail_words", "tail_n"), zip(*got))) if got else {}
            return pa.RecordBatch.from_arrays([pa.nulls(len(got), pa_id), *(pa.array(cols.get(c, none), k) for c, k in zip(names, kinds))], names=schema.names)

        def chunk() -> pa.RecordBatch:
            row, sizes, h = (np.concatenate(x) for x in zip(*waiting))
            cols = dict(zip(("chunk", *OF_CHUNK), (int(row[0]), *_pack(row, sizes, h))))
            return pa.RecordBatch.from_arrays([pa.nulls(1, pa_id), *(pa.array([cols.get(c)], k) for c, k in zip(names, kinds))], names=schema.names)

        pa_id = None
        for part in slices(batches):
            pa_id = part.column("ident").type
            row = part.column("row").to_numpy()
            index, ends, single, pair = reader.read(texts_of(part, text_col))
            of_doc = np.repeat(np.arange(len(row)), np.diff(ends))
            counted = reader.counts[index]
            inside = counted >= 0
            # Without a word to count, bincount would give whole numbers.
            logs = np.bincount(of_doc[inside], weights=np.log10(counted[inside] + 0.5), minlength=len(row)).astype(np.float64)
            known = np.bincount(of_doc[inside], minlength=len(row))
            none = pa.nulls(len(row))
            if large:
                waiting.append((row, np.diff(ends), reader.hashes[index]))
                tokens_in += len(index)
                stored = [none.cast(pa.binary())] * 2
            else:
                text, cell, times_in = _cells(ends, single, pair)
                stored = [_binary(x.astype("<u4"), text, len(row)) for x in (cell, times_in)]
            yield pa.RecordBatch.from_arrays([part.column("ident"), pa.array(row), part.column("learnt"), none.cast(pa.int32()), pa.array(np.diff(ends)), pa.array(known), pa.array(logs), *stored, *(none.cast(k) for k in kinds[8:])], names=schema.names)
            if tokens_in >= FLUSH:
                yield chunk()
                waiting, tokens_in = [], 0
            both, n = np.unique(of_doc[~inside] * (1 << 32) + index[~inside], return_counts=True)
            rows.append(row[both >> 32])
            words.append(reader.hashes[both & 0xFFFFFFFF])
            times.append(n)
            size += len(both)
            if size >= FLUSH // 2:
                yield tail()
                rows, words, times, size = [], [], [], 0
        if size:
            yield tail()
        if tokens_in:
            yield chunk()

    flag = F.lit(True) if learnt is None else F.coalesce(learnt, F.lit(False))
    numbered = docs.select(F.col(id_col).alias("ident"), F.col(text_col).alias(text_col), F.monotonically_increasing_id().alias("row"), flag.alias("learnt"))
    got = settle(numbered.mapInArrow(run, schema), "lm-scored")
    whole, rest = got.where("row is not null"), got.where("tail_rows is not null")
    if large:
        whole = whole.drop("cells", "cell_n").join(_cells_by_range(got, model), "row")
    blob = rest.select("range", "tail_rows", "tail_words", "tail_n", F.lit(None).cast("binary").alias("words"), F.lit(None).cast("binary").alias("word_counts"))
    exact = model.counts.select("range", *[F.lit(None).cast("binary").alias(c) for c in ("tail_rows", "tail_words", "tail_n")], "words", "word_counts")

    def look_up(key: tuple, group: pa.Table) -> pa.Table:
        there = group.filter(pa.compute.is_valid(group.column("words")))
        h = np.concatenate([np.zeros(0, U), *map(expand, there.column("words").to_pylist())])
        c = np.concatenate([np.zeros(0, np.int64), *map(fat, there.column("word_counts").to_pylist())])
        out_r, out_l, out_k = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        for r, w, n in zip(*(group.column(x) for x in ("tail_rows", "tail_words", "tail_n"))):
            if not r.is_valid:
                continue
            r, w, n = r.as_py(), w.as_py(), n.as_py()
            r, w, n = np.frombuffer(r, "<i8"), expand(w), np.frombuffer(n, "<u4").astype(np.int64)
            at = np.minimum(np.searchsorted(h, w), max(0, len(h) - 1))
            count = np.where(h[at] == w, c[at], 0) if len(h) else np.zeros(len(w), np.int64)
            row, back = np.unique(r, return_inverse=True)
            out_r.append(row)
            out_l.append(np.bincount(back, weights=n * np.log10(count + 0.5), minlength=len(row)))
            out_k.append(np.bincount(back, weights=np.where(count > 0, n, 0), minlength=len(row)).astype(np.int64))
        return pa.table({"row": np.concatenate(out_r), "logs": np.concatenate(out_l), "known": np.concatenate(out_k)})

    sums = blob.unionByName(exact).groupBy("range").applyInArrow(look_up, "row long, logs double, known long")
    sums = whole.select("row", "logs", "known").unionByName(sums).groupBy("row").agg(F.sum("logs").alias("_logs"), F.sum("known").alias("_known"))
    shift = float(np.log10(facts.tokens + 0.5 * (facts.types + 1)))
    table = docs.sparkSession.sparkContext.broadcast(log10_of_cells(facts, _weights(facts, whole.where("learnt"))))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            cell, n = (np.frombuffer(b"".join(part.column(c).to_pylist()), "<u4") for c in ("cells", "cell_n"))
            size = np.diff(np.frombuffer(part.column("cells").buffers()[1], np.int32, part.num_rows + 1, 4 * part.column("cells").offset)) // 4
            score = np.bincount(np.repeat(np.arange(part.num_rows), size), weights=table.value[cell] * n, minlength=part.num_rows).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("ident", "row", "n_tokens")), pa.array(score)], names=["ident", "row", "n_tokens", "score"])

    fields = [whole.schema["ident"], whole.schema["row"], whole.schema["n_tokens"], *docs.sparkSession.createDataFrame([], "score double").schema.fields]
    done = whole.select("ident", "row", "n_tokens", "cells", "cell_n").mapInArrow(total, type(schema)(fields)).join(sums, "row")
    return done.select(F.col("ident").alias(id_col), "n_tokens", F.col("_known").alias("n_known"), F.lit(facts.tokens).cast("long").alias("train_tokens"), (F.col("_logs") - F.col("n_tokens") * F.lit(shift)).alias("base_score"), "score")


def held_out(ident: Column) -> Column:
    return F.coalesce(remainder(ident, 5) == 1, F.lit(False))


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learnt = ~held_out(F.col("doc_id"))
    got = scored(docs, learn(docs.where(learnt)), learnt=learnt)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
