"""Spelling variants: pairs of words at edit distance one, by a self-join of the vocabulary's trie.

Words are counted where they lie, once a document, and summed by word. Then

* Partitions. Two words that differ by one code point, the shorter of m, share their first f or their last m - 1 - f code points, f = (m - 1) // 2. So a
  word of length L takes part in the classes m = L - 1 and m = L, and there in the partition of its first half and in that of its last. A partition of more than
  HOT words or HOT_CHARS code points is dealt again by the same rule for what lies between the ends that its words share, until it is small enough or at most
  two code points are left, which bounds it by the alphabet.
* Self-join. A task builds the trie of a partition's middles level by level and moves active pairs of nodes down it: a node is active for itself at
  distance 0; two children of one node, or a node and its own child, are active at distance 1, and from then on only children by the same code point. Where
  both nodes of a pair at distance 1 end a word, that is a pair of words. Pairs without words of the right lengths below them are dropped.
* A pair that meets by its last half is left out where the first halves are equal too, for it has met there: so every pair comes once.

Each word's neighbours are only counted and reduced to the best one, so a word of many neighbours gathers nothing. Forms are followed by pointer doubling.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, release, settle, slices, texts_of

#: Code points of a word, occurrences of a word, and how many times as often as a variant its form occurs, at least.
LENGTH, COUNT, RATIO = 7, 2, 10
#: One in this many occurrences loses a code point, by hash.
LOSES = 31
#: Words, and code points, of a partition beyond which it is dealt again; and words that a task joins at once.
HOT, HOT_CHARS, ROWS, CHARS = 20_000, 1 << 22, 1 << 16, 1 << 22
#: Words a task counts before it passes counts on.
COUNTED = 1 << 18
_CODES = np.int64(1 << 21)


def occurrences(ident: str, text: str, length: int = LENGTH, loses: int = LOSES) -> Iterator[tuple[str, int]]:
    """(word, times) of one text: runs of letters, A-Z lower-cased; a run whose hash `loses` divides is without one code point."""
    low = text.lower() if text.isascii() else text.encode("utf-8", "replace").lower().decode()
    start = zlib.crc32(f"{ident}:".encode())
    for run, times in Counter(re.findall(r"[a-zA-ZÀ-ÿ]{%d,}" % length, low)).items():
        h = zlib.crc32(run.encode(), start)
        if h % loses == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < length:
                continue
        yield run, times


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, count: int = COUNT, loses: int = LOSES) -> DataFrame:
    """(word, n) of all texts: words of at least `length` code points that occur at least `count` times. A null text has no words; a null id counts as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        found: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
            found.clear()
            return got

        for part in slices(batches):
            for ident, text in zip(part.column("_id").to_pylist(), texts_of(part, "_text")):
                for word, times in occurrences(ident, text, length, loses):
                    found[word] = found.get(word, 0) + times
                if len(found) > COUNTED:
                    yield out()
        yield out()

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.col(text_col).alias("_text"))
    counted = texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= count)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, value): every value of each range from lo[i] to before hi[i]."""
    size = hi - lo
    which = np.repeat(np.arange(len(lo)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + lo[which]


class Level:
    """The trie's nodes at one depth: words lo to before hi are below each; end is the word that ends there, or -1."""

    def __init__(self, depth: int, parents: int, parent: np.ndarray, code: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: np.ndarray):
        self.depth, self.parent, self.code, self.lo, self.hi = depth, parent, code, lo, hi
        self.end = np.where(length[lo] == depth, lo, -1) if len(lo) else lo
        self.keys = parent * _CODES + code
        at = np.searchsorted(parent, np.arange(parents + 1))
        self.first, self.stop = at[:-1], at[1:]

    def below(self, nodes: np.ndarray, codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> Level:
        """The children of some of the nodes."""
        which, word = _ranges(self.lo[nodes] + (self.end[nodes] >= 0), self.hi[nodes])
        parent, code = nodes[which], codes[start[word] + self.depth].astype(np.int64)
        new = np.r_[True, (parent[1:] != parent[:-1]) | (code[1:] != code[:-1])] if len(word) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        last = np.r_[head[1:], len(word)] - 1 if len(head) else head
        return Level(self.depth + 1, len(self.lo), parent[head], code[head], word[head], word[last] + 1, length)

    def alike(self, other: Level, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of children, of u in self and of v in other, by the same code point."""
        which, x = _ranges(self.first[u], self.stop[u])
        key = v[which] * _CODES + self.code[x]
        if not len(other.keys):
            return x[:0], x[:0]
        y = np.minimum(np.searchsorted(other.keys, key), len(other.keys) - 1)
        hit = other.keys[y] == key
        return x[hit], y[hit]


def near_pairs(key: np.ndarray, middles: list[str], short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of the same key whose middles are at distance one: two short ones, or i short and j longer by one. Rows sorted by key and middle, without repeats."""
    n = len(middles)
    length = np.fromiter(map(len, middles), np.int64, n)
    start = np.cumsum(length) - length
    codes = np.frombuffer("".join(middles).encode("utf-32-le", "surrogatepass"), np.uint32)
    shorts, longs = (np.r_[0, np.cumsum(x)] for x in (short, ~short))
    holds = lambda level, of, x: of[level.hi[x]] > of[level.lo[x]]
    none = np.zeros(0, np.int64)
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else none
    now = Level(0, 1, np.zeros(len(head), np.int64), np.arange(len(head)), head, np.r_[head[1:], n] if n else none, length)
    same, grown = (none, none), (none, none)  # pairs (u, v) at this depth, and (u, v) with u one level above
    found = []
    while len(now.lo):
        needed = now.hi - now.lo > 1
        for x in (*same, grown[1]):
            needed[x] = True
        if len(grown[0]):
            above = np.zeros(len(now.first), bool)
            above[grown[0]] = True
            needed |= above[now.parent]
        nodes = np.flatnonzero(needed)
        below = now.below(nodes, codes, start, length)
        # Substitution: two children of a node, each before those after it.
        child = np.arange(len(below.lo))
        a, b = _ranges(child + 1, below.stop[below.parent])
        c, d = below.alike(below, *same)
        u, v = np.r_[a, c], np.r_[b, d]
        good = holds(below, shorts, u) & holds(below, shorts, v)
        same = u[good], v[good]
        # Insertion: a node and its child, one code point longer.
        c, d = now.alike(below, *grown)
        u, v = np.r_[below.parent, c], np.r_[child, d]
        good = holds(now, shorts, u) & holds(below, longs, v)
        grown = u[good], v[good]
        for level, (u, v) in ((below, same), (now, grown)):
            i, j = level.end[u], below.end[v]
            both = (i >= 0) & (j >= 0)
            i, j = i[both], j[both]
            right = short[i] & (short[j] if level is below else ~short[j])
            found.append((i[right], j[right]))
        now = below
    i, j = (np.concatenate([f[k] for f in found]) if found else none for k in (0, 1))
    # A node and its child can lead to a pair by more than one code point of a run of equal ones.
    return np.divmod(np.unique(i * n + j), n) if n else (none, none)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and middle: (word, near, near_n) of every pair, both ways."""
    release()
    held: list[pa.RecordBatch] = []
    rows = chars = 0

    def out(part: pa.Table) -> pa.RecordBatch:
        key, middle, short = part.column("key").to_numpy(), part.column("middle").to_pylist(), part.column("short").to_numpy(zero_copy_only=False)
        front, back, checks = (part.column(c).to_pylist() for c in ("front", "back", "checks"))
        i, j = near_pairs(key, middle, short)
        word, keep = {}, []
        for x in np.unique(np.r_[i, j]).tolist():
            word[x] = front[x] + middle[x] + back[x]
        for at, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
            one, two, check = word[x], word[y], checks[x]
            # Keys are hashes: the ends that made them are compared as well.
            if front[x] == front[y] and back[x] == back[y] and not any(one[lo:hi] == two[lo:hi] for lo, hi in zip(check[::2], check[1::2])):
                keep.append(at)
        i, j = i[keep], j[keep]
        n = part.column("n").to_numpy()
        a, b = np.r_[i, j], np.r_[j, i]
        return pa.RecordBatch.from_arrays([pa.array([word[x] for x in a.tolist()], pa.string()), pa.array([word[x] for x in b.tolist()], pa.string()), pa.array(n[b])], names=["word", "near", "near_n"])

    for batch in batches:
        held.append(batch)
        rows, chars = rows + batch.num_rows, chars + batch.column("middle").nbytes
        if rows >= ROWS or chars >= CHARS:
            whole = pa.Table.from_batches(held)
            key = whole.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield out(whole.slice(0, cut))
                held = whole.slice(cut).combine_chunks().to_batches()
                rows, chars = len(key) - cut, sum(x.column("middle").nbytes * x.num_rows // max(1, len(key)) for x in held)
    if held:
        yield out(pa.Table.from_batches(held))


def _halves(rows: DataFrame) -> DataFrame:
    """Each of rows(key, word, n, m, lo, hi, checks), whose key stands for lo shared code points in front and hi at the back, twice: by half of those between, in front and at the back."""
    room = F.col("m") - F.col("lo") - F.col("hi") - 1
    f = F.floor(room / 2).cast("int")
    r = (room - f).cast("int")
    first = F.struct(F.lit(0).alias("side"), f.alias("by"))
    last = F.struct(F.lit(1).alias("side"), r.alias("by"))
    both = rows.withColumn("_half", F.explode(F.array(first, last))).withColumn("_f", f)
    front, by = F.col("_half.side") == 0, F.col("_half.by")
    at = F.when(front, F.col("lo") + 1).otherwise(F.length("word") - F.col("hi") - by + 1)
    key = F.xxhash64("key", "m", "lo", "hi", "_half.side", F.substr("word", at, by))
    checks = F.when(front, F.col("checks")).otherwise(F.concat("checks", F.array(F.col("lo"), F.col("lo") + F.col("_f"))))
    return both.select(key.alias("key"), "word", "n", "m", F.when(front, F.col("lo") + by).otherwise(F.col("lo")).alias("lo"), F.when(front, F.col("hi")).otherwise(F.col("hi") + by).alias("hi"), checks.alias("checks"))


def neighbours(words: DataFrame, shortest: int = LENGTH, hot: int = HOT, hot_chars: int = HOT_CHARS) -> DataFrame:
    """(word, near, near_n) for words(word, n), words distinct and of at least `shortest` code points: every pair at distance one, once each way. words is read several times: settle it first."""
    size = F.length("word")
    classes = F.when(size > shortest, F.array(size - 1, size)).otherwise(F.array(size))
    zero = F.lit(0).cast("int")
    rows = words.where(size >= shortest).select(F.lit(0).cast("long").alias("key"), "word", "n", F.explode(classes).alias("m"), zero.alias("lo"), zero.alias("hi"), F.array().cast("array<int>").alias("checks"))
    rows, ready, written = _halves(rows), [], []
    while True:
        held = F.col("m") - F.col("lo") - F.col("hi")
        large = rows.groupBy("key").agg(F.count("*").alias("rows"), F.sum(held).alias("chars"), F.max(held).alias("held"))
        large = settle(large.where((F.col("held") > 2) & ((F.col("rows") > hot) | (F.col("chars") > hot_chars))).select("key"), "spelling-large")
        if large.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(large, "key", "left_anti"))
        rows = settle(_halves(rows.join(large, "key", "left_semi")), "spelling-again")
        written += [rows, large]
    dealt = ready[0]
    for more in ready[1:]:
        dealt = dealt.unionByName(more)
    middle = F.substr("word", F.col("lo") + 1, F.length("word") - F.col("lo") - F.col("hi"))
    cut = dealt.select("key", middle.alias("middle"), F.substr("word", F.lit(1), F.col("lo")).alias("front"), F.substr("word", F.length("word") - F.col("hi") + 1).alias("back"), (F.length("word") == F.col("m")).alias("short"), "n", "checks")
    return cut.repartition("key").sortWithinPartitions("key", "middle").mapInArrow(_joined, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for forms(word, form): the last word that following forms leads to. Forms lead nowhere in a circle. Each round doubles the steps taken."""
    reached = settle(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if reached.join(further, "root", "left_semi").isEmpty():
            return reached
        before = reached
        reached = settle(reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
        discard(before)


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, count: int = COUNT, ratio: int = RATIO, loses: int = LOSES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the texts: see vocabulary() for words.

    Near words differ by exactly one inserted, deleted or replaced code point. The form is the near word of largest n, of equal ones the first in code-point
    order, if that n is at least ratio times the word's; else null, as is form_n. root is what following forms leads to, the word itself without one. Null and empty texts have no words, an empty
    table gives no rows, repeated rows count each time; other columns are ignored.
    """
    words = settle(vocabulary(docs, id_col, text_col, length, count, loses), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near").alias("near")))
    near = neighbours(words, length).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.rank") >= F.lit(ratio) * F.col("n")
    either = lambda c: F.when(is_form, c)
    known = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), either(F.col("best.near")).alias("form"), either(-F.col("best.rank")).alias("form_n"))
    known = settle(known, "spelling-forms")
    return known.join(roots(known.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
