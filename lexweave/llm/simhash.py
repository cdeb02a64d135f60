"""SimHash near-duplicate detection over a Gray-ordered hierarchical index.

A document's fingerprint has bit i set when more than half of its three-word shingles' XXH64 values have it set. Fingerprints within
`radius` differing bits are linked; a component is what links reach.

Search. Equal fingerprints are one entry (any number of copies cost one row). With radius r, two linked fingerprints agree on at
least one of r + 1 equal slices of their bits, so each entry is dealt once per slice to the task that owns that slice's value: the
slice is the top node of an index tree. Inside, entries are sorted by Gray rank, runs of `FAN` neighbours become nodes that keep the
bits all members share (a mask and a pattern), runs of nodes become higher nodes, and a self-join walks the tree from the roots:
a pair of nodes whose shared bits already differ in more than r places is dropped with everything below it. Slice values with
more than `HOT_ENTRIES` entries are dealt further, by slices of the bits that are left, which loses no pair. A task reports
a spanning star of each component it sees, never all pairs; the stars are joined across tasks by components().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, release, settle, split_words, texts_of, with_columns

SEED = 42
WIDTH = 3
RADIUS = 3
FAN = 8
#: Entries of one slice value beyond which that value is dealt further.
HOT_ENTRIES = 20_000
#: Node pairs compared at once, and entries indexed at once unless one slice value has more.
PAIRS_AT_ONCE, ENTRIES_AT_ONCE = 1 << 16, 1 << 16


def fingerprint(text: str, width: int = WIDTH) -> int:
    """The text's fingerprint as an unsigned 64-bit integer; zero without words."""
    words = split_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    k = min(width, len(words))
    starts = [0, *(e + 1 for e in ends[: len(words) - k])]
    stops = ends[k - 1 :]
    n, ones = len(starts), np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for lo in range(0, n, 1 << 15):
        raw = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[lo : lo + (1 << 15)], stops[lo : lo + (1 << 15)])])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id or the columns in keep, fp long): fp holds the 64 bits as a signed integer. Null and empty texts get 0."""

    def add(part: pa.RecordBatch) -> dict[str, pa.Array]:
        got = np.array([fingerprint(x) for x in texts_of(part, text_col)], dtype=np.uint64)
        return {"fp": pa.array(got.view(np.int64))}

    keep = [id_col] if keep is None else keep
    return with_columns(docs.select(*dict.fromkeys([*keep, text_col])), add, "fp long", keep)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The position of x in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """The tree over entries (key, fp) of one or more keys; nodes never mix keys."""

    def __init__(self, key: np.ndarray, fp: np.ndarray):
        order = np.lexsort((gray_rank(fp), key))
        self.order, self.key, self.fp = order, key[order], fp[order]
        n = len(fp)
        key, lo, hi = self.key, np.arange(n), np.arange(1, n + 1)
        self.levels = [(lo, hi, self.fp, np.full(n, ~np.uint64(0)))]
        self.child: list[tuple[np.ndarray, np.ndarray]] = []
        while len(key) and not (key[1:] != key[:-1]).all():
            head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            rank = np.arange(len(key)) - np.repeat(head, np.diff(np.r_[head, len(key)]))
            start = np.flatnonzero(rank % FAN == 0)
            stop = np.r_[start[1:], len(key)]
            lo, hi, pattern, mask = self.levels[-1]
            same = np.bitwise_and.reduceat(mask, start)
            first = np.repeat(pattern[start], stop - start)
            same &= ~np.bitwise_or.reduceat(pattern ^ first, start)
            self.child.append((start, stop))
            self.levels.append((lo[start], hi[stop - 1], pattern[start] & same, same))
            key = key[start]

    def stars(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(fp, smaller fp of its component) for every entry that links to another."""
        n = len(self.fp)
        label = np.arange(n)
        self.walk(radius, label, lambda a, b: self._join(label, a, b))
        linked = np.flatnonzero(label != np.arange(n))
        return self.fp[linked], self.fp[label[linked]]

    def walk(self, radius: int, label: np.ndarray, leaf: Callable[[np.ndarray, np.ndarray], None]) -> None:
        """Give leaf() the pairs of entries within `radius` bits, block by block, but for those that label says are in one component.

        leaf() may unite components in label; what it unites is pruned from then on.
        """
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        stack = [(top, roots, roots)]
        while stack:
            level, a, b = stack.pop()
            if len(a) > PAIRS_AT_ONCE:
                half = len(a) // 2
                stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            lo, hi, pattern, mask = self.levels[level]
            near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= radius
            a, b = a[near], b[near]
            if level == 0:
                leaf(a[a != b], b[a != b])
                continue
            # Pairs of nodes that lie in one component already hold nothing new.
            least, most = np.minimum.reduceat(label, lo), np.maximum.reduceat(label, lo)
            done = (least[a] == most[a]) & (least[b] == most[b]) & (least[a] == least[b])
            a, b = a[~done], b[~done]
            start, stop = self.child[level - 1]
            na, nb = stop[a] - start[a], stop[b] - start[b]
            size = na * nb
            if size.sum() > 8 * PAIRS_AT_ONCE and len(a) > 1:
                half = len(a) // 2
                stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            which = np.repeat(np.arange(len(a)), size)
            off = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            x, y = start[a][which] + off // nb[which], start[b][which] + off % nb[which]
            go = (x < y) | ((x == y) if level > 1 else False)
            go |= (a[which] != b[which])
            x, y = x[go], y[go]
            if len(x):
                stack.append((level - 1, x, y))

    @staticmethod
    def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Unite entries a[i] and b[i]: hook roots to smaller ones and shorten paths until nothing changes."""
        while len(a):
            la, lb = label[a], label[b]
            differ = la != lb
            if not differ.any():
                return
            a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while not np.array_equal(short := label[label], label):
                label[:] = short


def _spanning(radius: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by key; whole keys are indexed together, up to ENTRIES_AT_ONCE entries."""
    release()
    keys, fps, held = [], [], 0

    def flush(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = GrayIndex(key, fp).stars(radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        keys.append(batch.column("key").to_numpy())
        fps.append(batch.column("fp").to_numpy().view(np.uint64))
        held += batch.num_rows
        if held >= ENTRIES_AT_ONCE:
            key, fp = np.concatenate(keys), np.concatenate(fps)
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield flush(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
            keys, fps, held = [key], [fp], len(key)
    if held:
        yield flush(np.concatenate(keys), np.concatenate(fps))


def links(entries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): a spanning set of links among the distinct values of entries.fp."""
    parts = radius + 1
    width = 64 // parts
    cut = lambda value, i, bits: F.shiftrightunsigned(value, i * bits).bitwiseAND(F.lit((1 << bits) - 1))
    dealt = entries.select("fp", F.posexplode(F.array(*[cut(F.col("fp"), i, width) for i in range(parts)])).alias("part", "value"))
    dealt = dealt.select("fp", "part", (F.col("part") * (1 << width) + F.col("value")).alias("key"))
    # At most (radius + 1) * 2 ** (64 / (radius + 1)) keys exist, whatever the input: 262,144 here.
    hot = dealt.groupBy("key").count().where(F.col("count") > HOT_ENTRIES).select("key", F.lit(True).alias("is_hot"))
    dealt = dealt.join(F.broadcast(hot), "key", "left")
    rest = F.when(F.col("part") == 0, F.shiftrightunsigned("fp", width))
    for i in range(1, parts):
        low = F.col("fp").bitwiseAND(F.lit((1 << (i * width)) - 1))
        high = F.shiftrightunsigned("fp", (i + 1) * width) if i + 1 < parts else F.lit(0).cast("long")
        rest = rest.when(F.col("part") == i, low.bitwiseOR(F.shiftleft(high, i * width)))
    fine = (64 - width) // parts
    last = 64 - width - fine * (parts - 1)
    rest_cuts = F.array(*[F.shiftrightunsigned(F.col("rest"), i * fine).bitwiseAND(F.lit((1 << (fine if i + 1 < parts else last)) - 1)) for i in range(parts)])
    cool = dealt.where("is_hot is null").select("key", "fp")
    deeper = dealt.where("is_hot").withColumn("rest", rest).select("key", "fp", F.posexplode(rest_cuts).alias("sub", "value"))
    deeper = deeper.select((((F.col("key") + 1) * parts + F.col("sub")) * (1 << last) + F.col("value") + (1 << 40)).alias("key"), "fp")
    ready = cool.unionByName(deeper).repartition("key").sortWithinPartitions("key")
    return ready.mapInArrow(lambda batches: _spanning(radius, batches), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fp long, component_id): the component of every document, named by its smallest id.

    Null and empty texts, and texts of white space, have fingerprint zero and link like any other. A text of one or two words
    has a single shingle. Rows with a null id get their component's smallest id (null if no member has one); repeated rows give repeated
    rows. Other columns are ignored. An empty table gives an empty result.
    """
    got = settle(fingerprints(docs, id_col, text_col), "simhash")
    of = groups(got, id_col, radius)
    return got.join(of.select("fp", F.col("least").alias("component_id")), "fp").select(id_col, "fp", "component_id")


def groups(got: DataFrame, order: str, radius: int = RADIUS) -> DataFrame:
    """(fp, least): for each fingerprint of got(fp, order) the smallest `order` in its component."""
    entries = settle(got.groupBy("fp").agg(F.min(order).alias("least")), "simhash-entries")
    stars = components(links(entries.select("fp"), radius), "simhash-links")
    named = entries.join(stars, entries.fp == stars.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return named.join(named.groupBy("root").agg(F.min("least").alias("smallest")), "root").select("fp", F.col("smallest").alias("least"))


def op2_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
