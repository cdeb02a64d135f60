"""Near-duplicate texts by five-word shingles: candidates from Gray-ordered SimHash indexes, similarity exact.

Two texts are linked when the sets of their five-word shingles have a Jaccard similarity of at least 0.8; a component is what links reach.

* Equal word sequences (A-Z lower-cased) are one entry, however many rows have them.
* Sketch. A SimHash of 256 bits over the set of two-word shingles: an edited word touches two of these but five of the others, so
  sketches of similar texts differ in few bits (measured: up to 10 of 64 for 47 of 48 such pairs; see README).
* Top nodes. A radius so wide has no useful pigeonhole over 64 bits, so the index is dealt many times: each time by the values of `width`
  bits drawn at random from the 256. `deals()` takes as many deals as find a pair that differs in `FAR` of its bits with probability `FOUND`;
  the width follows the number of texts, so that a value holds few unrelated ones, and the deals follow the width. Recall is thus the same at every size.
* Below a top node a GrayIndex is walked at growing radii over 64 bits, pairs of leaves are compared over 128. Only pairs that unite two
  components of that task are kept: a spanning forest of the nearest pairs, not all pairs of a group.
* The forests' edges are checked exactly against the shingle sets, and the links found are joined across tasks by components().
* The rest, exactly. Sort every set by one order of all shingles: two sets with a Jaccard similarity of at least t share one of their first
  n - ceil(t n) + 1. Texts of different components that share such a shingle, and whose sizes and places of it leave room for t, meet:
  first a few for each two components, so that large groups join, then all that still lie in two. Any order gives
  the same links; shingles common among up to COMMON_TEXTS texts come last, which only saves work.
* Where texts meet, their parities rule out nearly all pairs below t: a bit tells whether an odd number of the set's hashes has that residue by
  a power of two, so two sets differ in at least as many shingles as their parities in bits, and sets at t differ in at most
  (1 - t) / (1 + t) of their sizes' sum. No pair at t or above is lost; those left are compared exactly.

So every pair at or above the similarity lies in one component, whatever the index missed, and nothing below it is ever linked directly. Hashes of words,
shingles and whole texts have 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, release, settle, slices, split_words, texts_of, with_columns
from .simhash import ENTRIES_AT_ONCE, HOT_ENTRIES, SEED, GrayIndex

WIDTH, SIMILARITY = 5, 0.8
#: Words to a shingle of the sketch, and the sketch's 64-bit words.
SKETCH_WIDTH, SKETCH = 2, 4
#: The share of differing bits up to which a pair is found with probability FOUND.
FAR, FOUND = 0.14, 0.97
#: Unrelated texts that share a top node's value, about, as a power of two; and the least width.
SHARE_BITS, LEAST_WIDTH = 4, 12
#: Radii over 128 bits, nearest first, and the tree's limit over 64.
RADII, TREE_RADIUS = (4, 8, 12, 16, 20, 24, 28), 16
#: Entries of one value held at once; a value with more is walked in overlapping runs.
RUN = 4 * ENTRIES_AT_ONCE
#: Keys up to which a table of keys alone is broadcast (16 to 40 bytes each).
BROADCAST_KEYS = 500_000
#: Texts whose common shingles are put last, and how many of these; no result depends on either.
COMMON_TEXTS, COMMON = 20_000, 200_000
#: Texts with one shingle that are paired at once; a shingle of more is dealt in pairs of blocks.
HOLDERS = 2048
#: Texts of a component that look for another one, for each shingle, before all of them do.
FEW = 4
#: Most 64-bit words of a text's parity, and pairs of parities held at once; no result depends on either.
PARITY_WORDS, PARITIES = 64, 1 << 14
#: Texts a task remembers so as not to repeat their shingles.
REMEMBERED = 1 << 17
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_OFFSETS = np.arange(1, SKETCH + 1, dtype=np.uint64) * _STEP


def _mixed(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_set(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than `width` are one shingle, no words none."""
    n, digest = len(words), xxhash.xxh64_intdigest
    if not n:
        return np.zeros(0, np.uint64)
    of = np.fromiter((digest(w, SEED) for w in words), np.uint64, n)
    width = min(width, n)
    total = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        total = total * _STEP + of[j : n - width + 1 + j]
    return np.unique(_mixed(total))


def sketch(words: list[bytes]) -> np.ndarray:
    """SKETCH words of 64 bits: bit i is set where more than half of the two-word shingles have it set."""
    got, ones = shingle_set(words, SKETCH_WIDTH), np.zeros(64 * SKETCH, np.int64)
    for lo in range(0, len(got), 1 << 13):
        part = got[lo : lo + (1 << 13)]
        wide = _mixed(part[:, None] + _OFFSETS)
        ones += np.unpackbits(wide.view(np.uint8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(got)).view(np.uint64)


def parity(shingles: np.ndarray) -> bytes:
    """Bit i of the 64-bit words, low bits first: set where an odd number of the hashes is i modulo the bits, a power of two of at least twice the hashes up to PARITY_WORDS."""
    wide = 64 * min(PARITY_WORDS, 1 << max(0, (2 * len(shingles) - 1).bit_length() - 6))
    odd = np.bincount((shingles & np.uint64(wide - 1)).astype(np.int64), minlength=wide) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketches(docs: DataFrame, keep: list[str], text_col: str, width: int = WIDTH) -> DataFrame:
    """(keep, node long, s0..s3 long, parity binary): node is the hash of the whole word sequence, parity that of its shingle set."""

    def add(part: pa.RecordBatch, _: None) -> dict[str, pa.Array]:
        node, bits, odd = [], [], []
        for text in texts_of(part, text_col):
            words = split_words(text)
            node.append(xxhash.xxh64_intdigest(b" ".join(words), SEED))
            bits.append(sketch(words))
            odd.append(parity(shingle_set(words, width)))
        wide = np.array(bits, np.uint64).reshape(-1, SKETCH).view(np.int64)
        return {"node": pa.array(np.array(node, np.uint64).view(np.int64)), **{f"s{j}": pa.array(np.ascontiguousarray(wide[:, j])) for j in range(SKETCH)}, "parity": pa.array(odd, pa.binary())}

    return with_columns(docs.select(*keep, text_col), add, "node long, " + ", ".join(f"s{j} long" for j in range(SKETCH)) + ", parity binary", keep, release)


def deals(n: int) -> list[np.ndarray]:
    """The bits of each deal for n different texts: their number follows from FAR, FOUND and the width."""
    width = max(LEAST_WIDTH, math.ceil(math.log2(n + 1)) - SHARE_BITS)
    times = math.ceil(math.log(1 - FOUND) / math.log1p(-((1 - FAR) ** width)))
    rng = np.random.default_rng(SEED)
    return [rng.choice(64 * SKETCH, width, replace=False) for _ in range(times)]


class Forest(GrayIndex):
    """A GrayIndex whose entries have a second word and a name, and that reports spanning edges, nearest first."""

    def __init__(self, key: np.ndarray, first: np.ndarray, second: np.ndarray, node: np.ndarray):
        super().__init__(key, first)
        self.second, self.node = second[self.order], node[self.order]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        label, out = np.arange(len(self.fp)), [np.zeros((2, 0), np.int64)]
        for radius in RADII:

            def leaf(a: np.ndarray, b: np.ndarray, radius=radius) -> None:
                far = np.bitwise_count(self.fp[a] ^ self.fp[b]) + np.bitwise_count(self.second[a] ^ self.second[b])
                near = np.flatnonzero((far <= radius) & (label[a] != label[b]))
                near = near[np.argsort(far[near], kind="stable")]
                a, b = a[near], b[near]
                while len(a):
                    la, lb = label[a], label[b]
                    differ = la != lb
                    a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
                    root, at = np.unique(np.maximum(la, lb), return_index=True)
                    out.append(np.stack([a[at], b[at]]))
                    label[root] = np.minimum(la, lb)[at]
                    while not np.array_equal(short := label[label], label):
                        label[:] = short

            self.walk(min(radius, TREE_RADIUS), label, leaf)
        a, b = np.concatenate(out, axis=1)
        return self.node[a], self.node[b]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by key and s0; whole keys are indexed together, a key of more than RUN entries in runs that overlap by half."""
    release()
    held: list[np.ndarray] = []

    def flush(rows: np.ndarray) -> pa.RecordBatch:
        a, b = Forest(rows[0], rows[2].view(np.uint64), rows[3].view(np.uint64), rows[1]).edges()
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    for batch in batches:
        held.append(np.stack([batch.column(c).to_numpy() for c in ("key", "node", "s0", "s1")]))
        if sum(x.shape[1] for x in held) >= ENTRIES_AT_ONCE:
            rows = np.concatenate(held, axis=1)
            cut = int(np.searchsorted(rows[0], rows[0, -1]))
            if cut:
                yield flush(np.ascontiguousarray(rows[:, :cut]))
                rows = rows[:, cut:]
            elif rows.shape[1] >= RUN:
                yield flush(rows)
                rows = rows[:, rows.shape[1] // 2 :]
            held = [rows]
    if held:
        yield flush(np.concatenate(held, axis=1))


def candidates(texts: DataFrame) -> DataFrame:
    """(a, b), a > b: for texts(node, s0..s3) with distinct nodes the edges of every forest, once each."""
    n = texts.count()
    spark, drawn = texts.sparkSession, deals(n)
    power = [np.int64(1) << np.arange(len(at), dtype=np.int64) for at in drawn]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = np.stack([batch.column(f"s{j}").to_numpy() for j in range(SKETCH)], axis=1)
            bits = np.unpackbits(np.ascontiguousarray(wide).view(np.uint8), axis=1)
            for k, at in enumerate(drawn):
                key = (np.int64(k) << np.int64(len(at))) + bits[:, at].astype(np.int64) @ power[k]
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("node"), batch.column("s0"), batch.column("s1")], names=["key", "node", "s0", "s1"])

    dealt = texts.select("node", *[f"s{j}" for j in range(SKETCH)]).mapInArrow(deal, "key long, node long, s0 long, s1 long")
    hot = settle(dealt.groupBy("key").count().where(F.col("count") > HOT_ENTRIES).select("key"), "similar-hot")
    small = hot.count() <= BROADCAST_KEYS
    marked = dealt.join((F.broadcast if small else lambda x: x)(hot.withColumn("is_hot", F.lit(True))), "key", "left")
    # A hot value is dealt further by four slices of the second word; members of a large group meet many of their like in each.
    finer = F.array(*[F.xxhash64("key", F.lit(i), F.shiftrightunsigned("s1", 16 * i).bitwiseAND(F.lit(65535))) for i in range(4)])
    keys = F.when(F.col("is_hot"), finer).otherwise(F.array("key"))
    ready = marked.select(F.explode(keys).alias("key"), "node", "s0", "s1")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * len(drawn) // 1_000_000 + 1)
    return ready.repartition(parts, "key").sortWithinPartitions("key", "s0").mapInArrow(_forests, "a long, b long").distinct()


def verified(edges: DataFrame, texts: DataFrame, text_col: str, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of edges(a, b) whose texts(node, text), one row a node, have shingle sets of at least this Jaccard similarity."""

    def add(part: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"shingles": pa.array([shingle_set(split_words(x), width).view(np.int64) for x in texts_of(part, text_col)], pa.list_(pa.int64()))}

    sets = settle(with_columns(texts.select("node", text_col), add, "shingles array<long>", ["node"]), "similar-sets")
    left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "ab")
    both = edges.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    found = settle(both.where(shared / (F.size("of_a") + F.size("of_b") - shared) >= similarity).select("a", "b"), "similar-linked")
    discard(sets)
    return found


def common_shingles(rows: DataFrame, text_col: str, n: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that several of about COMMON_TEXTS texts have, at most COMMON, and in how many: what the order of shingles puts last."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held, known = [], set()

        def out() -> pa.RecordBatch:
            token, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(token[times > 1].view(np.int64)), pa.array(times[times > 1])], names=["token", "times"])

        for part in slices(batches):
            for text in set(texts_of(part, text_col)) - known:
                held.append(shingle_set(split_words(text), width))
                known.add(text)
            if sum(map(len, held)) > 1 << 20:
                yield out()
                held.clear()
                known.clear()
        if held:
            yield out()

    some = rows.select(text_col).where(F.pmod(F.xxhash64(text_col, F.lit(2)), F.lit(max(1, n // COMMON_TEXTS))) == 0).repartition(8)
    top = some.mapInArrow(count, "token long, times long").groupBy("token").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "token").limit(COMMON).toArrow()
    token, times = top.column("token").to_numpy().view(np.uint64), top.column("times").to_numpy()
    order = np.argsort(token)
    return token[order], times[order]


def prefixes(rows: DataFrame, text_col: str, common: tuple[np.ndarray, np.ndarray], width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(token, node, place): the first shingles of every text's set; place is the set's size and the shingle's rank in it. Texts of fewer than `width` words have none."""
    names, times = rows.sparkSession.sparkContext.broadcast(common[0]), common[1]
    times = rows.sparkSession.sparkContext.broadcast(times)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        known: set[int] = set()
        last, often = names.value, times.value
        for part in slices(batches):
            token, node, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for text in texts_of(part, text_col):
                words = split_words(text)
                name = xxhash.xxh64_intdigest(b" ".join(words), SEED)
                if len(words) < width or name in known:
                    continue
                known.add(name)
                got = shingle_set(words, width)
                n = len(got)
                if len(last):
                    at = np.minimum(np.searchsorted(last, got), len(last) - 1)
                    got = got[np.argsort(np.where(last[at] == got, often[at], 0), kind="stable")]
                first = min(n, n - math.ceil(similarity * n - 1e-9) + 1)
                token.append(got[:first])
                node.append(np.full(first, name, np.uint64))
                place.append((np.int64(n) << np.int64(32)) + np.arange(first))
            if len(known) > REMEMBERED:
                known.clear()
            cols = [np.concatenate(token).view(np.int64), np.concatenate(node).view(np.int64), np.concatenate(place)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["token", "node", "place"])

    return rows.select(text_col).mapInArrow(run, "token long, node long, place long")


def _runs(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], by: int) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Integer columns of sorted batches, and all their columns, in runs of at least ENTRIES_AT_ONCE rows that part no group of the first `by` columns."""
    release()
    held: list[np.ndarray] = []
    waiting: list[pa.Table] = []
    for batch in batches:
        held.append(np.stack([batch.column(c).to_numpy() for c in columns]))
        waiting.append(pa.Table.from_batches([batch]))
        if sum(x.shape[1] for x in held) >= ENTRIES_AT_ONCE:
            rows, all_of = np.concatenate(held, axis=1), pa.concat_tables(waiting)
            same = (rows[:by] == rows[:by, -1:]).all(axis=0)
            cut = rows.shape[1] - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield rows[:, :cut], all_of.slice(0, cut)
            held, waiting = [rows[:, cut:]], [all_of.slice(cut)]
    if held and (rows := np.concatenate(held, axis=1)).shape[1]:
        yield rows, pa.concat_tables(waiting)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token and node: those of tokens that several nodes have, once a node."""
    for rows, _ in _runs(batches, ("token", "node", "place"), 1):
        rows = rows[:, np.r_[True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)]]
        same = rows[0, 1:] == rows[0, :-1]
        rows = rows[:, np.r_[same, False] | np.r_[False, same]]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in rows], names=["token", "node", "place"])


def _differing(words: np.ndarray, start: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits the parities of rows x and y differ, the longer folded; row r's words are those from start[r] to start[r + 1]."""
    length, out = np.diff(start), np.zeros(len(x), np.int64)
    least = np.minimum(length[x], length[y])

    def folded(row: np.ndarray, to: int) -> np.ndarray:
        got, own = np.empty((len(row), to), np.uint64), length[row]
        for wide in np.unique(own):
            at = np.flatnonzero(own == wide)
            got[at] = np.bitwise_xor.reduce(words[start[row[at]][:, None] + np.arange(wide)].reshape(len(at), wide // to, to), axis=1)
        return got

    for to in np.unique(least):
        of = np.flatnonzero(least == to)
        for lo in range(0, len(of), PARITIES):
            at = of[lo : lo + PARITIES]
            out[at] = np.bitwise_count(folded(x[at], to) ^ folded(y[at], to)).sum(axis=1)
    return out


def _paired(batches: Iterator[pa.RecordBatch], similarity: float, few: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (token, low, high, root): pairs of nodes of different roots that may be similar; if few, once in a while one for two roots."""
    for rows, all_of in _runs(batches, ("token", "low", "high", "mine", "node", "root", "place"), 3):
        mine, node, root, size, at = rows[3], rows[4], rows[5], rows[6] >> 32, rows[6] & 0xFFFFFFFF
        odd = pa.concat_arrays(all_of.column("parity").cast(pa.binary()).chunks)
        start = np.frombuffer(odd.buffers()[1], np.int32)[odd.offset : odd.offset + len(odd) + 1].astype(np.int64) // 8
        words = np.frombuffer(odd.buffers()[2], np.uint64, start[-1])

        def out(found: list[np.ndarray]) -> pa.RecordBatch:
            x, y = np.concatenate(found, axis=1)
            near = _differing(words, start, x, y) * (1 + similarity) <= (1 - similarity) * (size[x] + size[y]) + 1e-6
            x, y = x[near], y[near]
            swap = node[x] < node[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            got = np.stack([node[x], node[y], root[x], root[y]])
            got = got[:, np.lexsort(got[2:] if few else got[:2])]
            key = got[2:] if few else got[:2]
            got = got[:, np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)]] if got.shape[1] else got
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v)) for v in got], names=["a", "b", "root_a", "root_b"])

        new = np.r_[True, (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)]
        end = np.append(np.flatnonzero(new)[1:], rows.shape[1])[np.cumsum(new) - 1]
        # Each row meets those after its root's run; of a run only the first rows if few are wanted.
        turn = new | np.r_[True, root[1:] != root[:-1]]
        run = np.cumsum(turn) - 1
        after = np.append(np.flatnonzero(turn)[1:], rows.shape[1])[run]
        whole = rows[1] == rows[2]
        i, gap, found, held = np.arange(rows.shape[1]), 0, [], 0
        if few:
            i = i[i - np.flatnonzero(turn)[run] < FEW]
        while len(i := i[after[i] + gap < end[i]]):
            j = after[i] + gap
            gap += 1
            near = whole[i] | (mine[i] != mine[j])
            x, y = i[near], j[near]
            small, large = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
            room = np.minimum(size[x] - at[x], size[y] - at[y])
            near = (small >= similarity * large - 1e-6) & (room * (1 + similarity) >= similarity * (small + large) - 1e-6)
            found.append(np.stack([x[near], y[near]]))
            held += found[-1].shape[1]
            if held >= RUN:
                yield out(found)
                found, held = [], 0
        if held:
            yield out(found)


def pairs(shared: DataFrame, roots: DataFrame, parities: DataFrame, similarity: float = SIMILARITY, few: bool = False) -> DataFrame:
    """(a, b), a > b: pairs of shared(token, node, place) that may be similar and lie in two components, by parities(node, parity); if few, one pair for each two components."""
    rows = shared.join(roots, "node", "left").select("token", "node", F.coalesce("root", "node").alias("root"), "place")
    # A shingle of one component alone leads to no pair.
    met = settle(rows.groupBy("token").agg(F.count("*").alias("held"), F.min("root").alias("one"), F.max("root").alias("other")).where("one <> other").select("token", "held"), "similar-met")
    small = met.count() <= BROADCAST_KEYS
    rows = rows.join((F.broadcast if small else lambda x: x)(met), "token").join(parities, "node")
    rows = rows.withColumn("blocks", F.when(F.col("held") > HOLDERS, F.ceil(F.col("held") / HOLDERS)).otherwise(1).cast("int"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("long")).withColumn("place_of", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    dealt = rows.select("token", F.least("mine", "place_of").alias("low"), F.greatest("mine", "place_of").alias("high"), "mine", "node", "root", "place", "parity")
    dealt = dealt.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high", "root")
    got = dealt.mapInArrow(lambda b: _paired(b, similarity, few), "a long, b long, root_a long, root_b long")
    if few:
        got = got.groupBy(F.least("root_a", "root_b"), F.greatest("root_a", "root_b")).agg(F.min(F.struct("a", "b")).alias("pair")).select("pair.a", "pair.b")
    return got.select("a", "b").distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs for each component: that with the smallest id, null ids last, and of different texts with that id one decided by hash.

    So rows that share an id but not a component each stand for their own component, and rows without an id take part like any other. Null and
    empty texts, and texts of white space, are equal; a text of fewer than `width` words is similar only to its equal. Repeated rows
    leave one. Columns keep their names whatever these are. An empty table gives an empty result.
    """
    named = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    ident, text = F.col(named[id_col]), named[text_col]
    rows = docs.withColumnsRenamed(named).withColumns({"_id": F.concat(F.when(ident.isNull(), "n").otherwise("i"), F.coalesce(ident.cast("string"), F.lit(""))), "_text": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    order = F.struct(ident.isNull().alias("nameless"), ident.alias("ident"), "_text", "_id")
    bits = [f"s{j}" for j in range(SKETCH)]
    got = sketches(rows, ["_id", "_text", named[id_col]], text, width).select("node", *bits, "parity", order.alias("order"))
    entries = settle(got.groupBy("node").agg(F.min("order").alias("least"), *[F.min(b).alias(b) for b in [*bits, "parity"]]), "similar-entries")
    edges = settle(candidates(entries), "similar-edges")

    def linked(edges: DataFrame) -> DataFrame:
        ends = settle(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(entries, "node").select("node", "least._id", "least._text"), "similar-ends")
        small = (F.broadcast if ends.count() <= BROADCAST_KEYS else lambda x: x)(ends)
        return verified(edges, rows.join(small, ["_id", "_text"]).select("node", text).dropDuplicates(["node"]), text, width, similarity)

    links = linked(edges)
    roots = settle(components(links, "similar-links"), "similar-roots")
    common = common_shingles(rows, text, entries.count(), width)
    first = prefixes(rows, text, common, width, similarity).repartition("token").sortWithinPartitions("token", "node")
    shared = settle(first.mapInArrow(_shared, "token long, node long, place long"), "similar-shared")
    checked = edges
    for few in (True, False):
        rest = settle(pairs(shared, roots, entries.select("node", "parity"), similarity, few).join(checked, ["a", "b"], "left_anti"), "similar-rest")
        if rest.isEmpty():
            continue
        if few:
            checked = checked.unionByName(rest)
        links = links.unionByName(linked(rest))
        roots = settle(components(links, "similar-links"), "similar-roots")
    discard(shared)
    held = entries.select("node", "least").join(roots, "node", "left").select("least", F.coalesce("root", "node").alias("root"))
    kept = held.groupBy("root").agg(F.min("least").alias("least")).select("least._id", "least._text")
    return rows.join(kept, ["_id", "_text"], "left_semi").dropDuplicates(["_id", "_text"]).select([F.col(v).alias(k) for k, v in named.items()])
