"""Embedding near-duplicates by sorted projection passes.

Equal vectors of a label are one representative with a multiplicity. Each pass has its own HASH_BITS random hyperplanes through the mean of the
label's unit vectors, so that labels whose vectors lie close together are told apart too; sign bits, concatenated, order the representatives of a label
lexicographically, and each one is compared with the WINDOW that follow it. Vectors travel as they came and are normalised in double precision where they are compared. Pairs at
or above the threshold unite; what unites over all passes is a candidate class.

Rounds. A label of more than QUERIES rows gets further rounds of passes, each with hyperplanes of its own, up to ROUNDS and for as long as a round
adds more than a share of 1 - RECALL to the rows that joined a class; this is counted over all rows. Rounds only make the next step cheaper.

The rest, exactly. Every pair of classes of a label that passes left apart is compared, in blocks: by their balls (mean and largest distance from
it), and row by row where the balls are close enough for a link. So no link is missed, however few passes met it. A label's distinct vectors
are compared in full this way, whose work grows with the square of its classes.

The window bounds comparisons, not partners: afterwards every class is compared in full, in blocks of at most BLOCK rows spread over
tasks, so a vector's links inside its class are exact however many there are. A pass and the blocks report spanning links and counts,
never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, settle, slices

THRESHOLD = 0.98
PASSES, HASH_BITS, WINDOW = 8, 60, 64
#: Rows of a class compared at once; smaller classes are cut into up to LEAST_BLOCKS blocks of LEAST_BLOCK rows all the same, so that they spread over tasks.
BLOCK, LEAST_BLOCK, LEAST_BLOCKS = 1024, 256, 4
#: The rest of a label is compared in up to SEEN_BLOCKS blocks of at least SEEN_BLOCK rows, more only where a block would be over SEEN_BYTES; in steps of STEP rows or CELLS cells.
SEEN_BLOCK, SEEN_BLOCKS, SEEN_BYTES, STEP, CELLS = 4096, 12, 1 << 24, 512, 1 << 22
QUERIES, RECALL, ROUNDS = 4096, 0.98, 8
SEED = 20240229


def planes(passes: int, dim: int, turn: int = 0) -> np.ndarray:
    """(dim, passes * HASH_BITS) hyperplane normals of a round, the same on every worker."""
    return np.random.default_rng([SEED, dim, turn] if turn else [SEED, dim]).standard_normal((dim, passes * HASH_BITS))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as unit rows, in double precision. Scaled by their largest component first, so that squares neither overflow nor vanish."""
    x = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_dim(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each vector length in a batch."""
    column = part.column("vec")
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield rows, _matrix(column.take(pa.array(rows)))


def _hash(batches: Iterator[pa.RecordBatch], passes: int, turn: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows with a vector's label's centre, if it has one, as rows with hashes."""
    for part in slices(batches, 4096):
        out = np.zeros((part.num_rows, passes), np.int64)
        centre = part.column("centre")
        for rows, x in _by_dim(part):
            there = np.flatnonzero(np.asarray(centre.take(pa.array(rows)).is_valid()))
            if len(there):
                x[there] -= np.asarray(centre.take(pa.array(rows[there])).flatten(), np.float64).reshape(len(there), -1)
            bits = (x @ planes(passes, x.shape[1], turn) >= 0).reshape(len(x), passes, HASH_BITS)
            out[rows] = bits @ (1 << np.arange(HASH_BITS - 1, -1, -1, dtype=np.int64))
        offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * passes)
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in OF_HASHED), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], names=[*OF_HASHED, "hashes"])


OF_HASHED = ("rep", "label", "vec")


def _keyed(vectors: DataFrame, label_col: str, vec_col: str) -> list:
    """label, vec, and two hashes of the vector's values that stand for them: 128 bits."""
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    vec = F.col(vec_col) if single else F.col(vec_col).cast("array<double>")
    return [F.col(label_col).alias("label"), vec.alias("vec"), F.xxhash64(vec).alias("k1"), F.xxhash64(F.lit(1), vec).alias("k2")]


def representatives(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(rep, least, n, label, k1, k2, vec): one row for each distinct usable vector of a label, rep a number of its own."""
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).alias("id"), *_keyed(vectors, label_col, vec_col))
    rows = rows.where(F.col("label").isNotNull() & F.col("vec").isNotNull() & whole & F.exists("vec", lambda x: x != 0))
    same = rows.groupBy("label", "k1", "k2").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    return settle(same.select(F.monotonically_increasing_id().alias("rep"), "least", "n", "label", "k1", "k2", "vec"), "embeddings")


def _sums(batches: Iterator[pa.RecordBatch], most: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """By label and dimension the sum of a task's unit vectors and their number, in parts of at most `most` labels."""
    held: dict[tuple, list] = {}

    def out() -> pa.RecordBatch:
        cols = zip(*((*k, n, x.tolist()) for k, (n, x) in held.items())) if held else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (kind, pa.int32(), pa.int64(), pa.list_(pa.float64())))], names=["label", "dim", "n", "sums"])

    kind = None
    for part in slices(batches, 4096):
        kind = part.column("label").type
        for rows, x in _by_dim(part):
            names = part.column("label").take(pa.array(rows)).dictionary_encode()
            code = names.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
            for label, n, total in zip(names.dictionary.take(pa.array(code[order][first])).to_pylist(), np.diff(np.r_[first, len(order)]), np.add.reduceat(x[order], first)):
                got = held.setdefault((label, x.shape[1]), [0, 0.0])
                got[0] += int(n)
                got[1] = got[1] + total
        if len(held) > most:
            yield out()
            held.clear()
    if held:
        yield out()


def centres(reps: DataFrame) -> DataFrame:
    """(label, dim, centre): the mean of the unit vectors of each label, over all of them."""
    kind = reps.schema["label"].dataType.simpleString()
    parts = reps.select("label", "vec").mapInArrow(_sums, f"label {kind}, dim int, n long, sums array<double>")
    by_place = parts.select("label", "dim", "n", F.posexplode("sums").alias("at", "x")).groupBy("label", "dim", "at").agg((F.sum("x") / F.sum("n")).alias("x"))
    listed = by_place.groupBy("label", "dim").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("xs"))
    return settle(listed.select("label", "dim", F.transform("xs", lambda p: p["x"]).alias("centre")), "embeddings-centres")


def hashed(reps: DataFrame, means: DataFrame, passes: int, turn: int = 0) -> DataFrame:
    """(rep, label, vec, hashes) of a round."""
    of = means.select(F.col("label").alias("_label"), F.col("dim").alias("_dim"), "centre")
    rows = reps.join(of, (F.col("label") == F.col("_label")) & (F.size("vec") == F.col("_dim")), "left").select(*OF_HASHED, "centre")
    schema = type(reps.schema)([*(reps.schema[c] for c in OF_HASHED), *reps.sparkSession.createDataFrame([], "hashes array<long>").schema.fields])
    return settle(rows.mapInArrow(lambda b: _hash(b, passes, turn), schema), "embeddings-hashed")


def _codes(label: pa.Array) -> np.ndarray:
    return label.dictionary_encode().indices.to_numpy(zero_copy_only=False)


def _unite(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest of n rows that links i[k], j[k] reach, for each row."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        differ = a != b
        if not differ.any():
            break
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(short := root[root], root):
            root = short
    return root


def _neighbours(batches: Iterator[pa.RecordBatch], threshold: float, window: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows: compare each with the `window` that follow, across batches too; give spanning pairs."""
    tail = None
    for part in batches:
        table = pa.Table.from_batches([tail, part] if tail is not None else [part]).combine_chunks().to_batches()
        block = table[0] if table else part
        n, label = block.num_rows, _codes(block.column("label"))
        rep, left, right = block.column("rep").to_numpy(), [], []
        for rows, x in _by_dim(block):
            for at in range(0, len(rows), window):
                a, b = slice(at, at + window), slice(at, at + 2 * window)
                i, j = np.nonzero(x[a] @ x[b].T >= threshold)
                i, j = rows[a][i], rows[b][j]
                near = (i < j) & (j - i <= window) & (label[i] == label[j])
                left.append(i[near])
                right.append(j[near])
        i, j = np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])
        root = _unite(n, i, j)
        linked = np.flatnonzero(root != np.arange(n))
        yield pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(rep[root[linked]])], names=["a", "b"])
        tail = block.slice(max(0, n - window))


def _count_links(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (class, low, high): links of each row inside its pair of blocks, weighted by multiplicity."""

    def count(group: pa.Table) -> pa.RecordBatch:
        rep, n, mine = group.column("rep").to_numpy(), group.column("n").to_numpy(), group.column("mine").to_numpy()
        x = _matrix(group.column("vec").combine_chunks())
        links = np.zeros(len(rep), np.int64)
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        if low == high:
            near = x @ x.T >= threshold
            np.fill_diagonal(near, False)
            links = near @ n
        else:
            p, q = mine == low, mine == high
            near = x[p] @ x[q].T >= threshold
            links[p], links[q] = near @ n[q], near.T @ n[p]
        return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links.astype(np.int64))], names=["rep", "links"])

    for group in _groups(batches, ("class", "low", "high")):
        yield count(group)


def _balls(x: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows sorted by class; for each class its name, first row, mean and largest distance from it."""
    order = np.argsort(cls, kind="stable")
    x, cls = x[order], cls[order]
    first = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]])
    size = np.diff(np.r_[first, len(cls)])
    centre = np.add.reduceat(x, first) / size[:, None]
    away = x - np.repeat(centre, size, axis=0)
    return x, cls[first], first, size, centre, np.sqrt(np.maximum.reduceat((away * away).sum(axis=1), first))


def _see(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (code, low, high): spanning pairs of the classes that a link joins."""
    reach = np.sqrt(max(0.0, 2 - 2 * threshold))
    for group in _groups(batches, ("code", "low", "high")):
        cls, mine = (group.column(c).to_numpy() for c in ("class", "mine"))
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        x, p, q = _matrix(group.column("vec").combine_chunks()), mine == low, mine == high
        if not (p.any() and q.any()):
            continue
        xa, name_a, first, size, mean_a, far_a = _balls(x[p], cls[p])
        xb, name_b, _, size_b, mean_b, far_b = _balls(x[q], cls[q])
        of_b = np.repeat(np.arange(len(name_b)), size_b)
        norm_a, norm_b = (mean_a * mean_a).sum(axis=1), (mean_b * mean_b).sum(axis=1)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, min(STEP, CELLS // len(xb)))
        for at in range(0, len(name_a), step):
            a = slice(at, at + step)
            gap = norm_a[a, None] + norm_b - 2 * (mean_a[a] @ mean_b.T)
            near = gap <= (far_a[a, None] + far_b + reach) ** 2 + 1e-9
            near &= name_a[a, None] < name_b if low == high else name_a[a, None] != name_b
            for k in np.flatnonzero(near.any(axis=1)).tolist():
                rows = np.flatnonzero(near[k][of_b])
                there, begin, end = np.zeros(len(name_b), bool), first[at + k], first[at + k] + size[at + k]
                for lo in range(begin, end, step):
                    there[of_b[rows[(xa[lo : min(end, lo + step)] @ xb[rows].T >= threshold).any(axis=0)]]] = True
                other = name_b[there]
                left.append(np.full(len(other), name_a[at + k]))
                right.append(other)
        i, j = np.concatenate(left), np.concatenate(right)
        names, place = np.unique(np.concatenate([i, j]), return_inverse=True)
        root = _unite(len(names), place[: len(i)], place[len(i) :])
        linked = np.flatnonzero(root != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[linked]), pa.array(names[root[linked]])], names=["a", "b"])


def _groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """The groups of rows sorted by integer columns, across batches."""
    held = None
    for part in batches:
        held = pa.Table.from_batches([part]) if held is None else pa.concat_tables([held, pa.Table.from_batches([part])])
        keys = np.stack([held.column(c).to_numpy() for c in by], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        start = 0
        for cut in cuts.tolist():
            yield held.slice(start, cut - start)
            start = cut
        held = held.slice(start)
    if held is not None and held.num_rows:
        yield held


def merged(reps: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """labels(label, dim, rows, code) with merged: how many rows of each joined another's class."""
    moved = reps.select("label", "rep", F.size("vec").alias("dim")).join(classes.where("node <> root"), F.col("rep") == F.col("node"))
    of = moved.groupBy("label", "dim").agg(F.count("*").alias("merged"))
    return settle(labels.join(of, ["label", "dim"], "left").select(*labels.columns, F.coalesce("merged", F.lit(0)).cast("long").alias("merged")), "embeddings-merged")


def seen(reps: DataFrame, classes: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """(a, b): spanning links between the classes of labels(label, dim, rows, code, merged), from all pairs of rows whose classes differ."""
    sizes = classes.groupBy("root").agg(F.count("*").alias("size"))
    known = classes.join(sizes, "root").select("node", "root", "size")
    rows = reps.select("label", F.size("vec").alias("dim"), "rep", "vec").join(labels.where(F.col("rows") - F.col("merged") > 1), ["label", "dim"])
    rows = rows.join(known, F.col("rep") == F.col("node"), "left").withColumns({"class": F.coalesce("root", "rep"), "size": F.coalesce("size", F.lit(1))})
    rows = rows.withColumn("blocks", F.least(F.ceil(F.col("rows") / SEEN_BLOCK), F.greatest(F.lit(SEEN_BLOCKS), F.ceil(F.col("rows") * F.col("dim") * 8 / SEEN_BYTES))).cast("int"))
    # Members of a class lie in one block, or in one for each LEAST_BLOCK of them, so that blocks hold few balls.
    part = F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / LEAST_BLOCK))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("class", part), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = rows.select("code", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "class", "vec")
    dealt = dealt.repartition("code", "low", "high").sortWithinPartitions("code", "low", "high")
    return settle(dealt.mapInArrow(lambda b: _see(b, threshold), "a long, b long"), "embeddings-seen")


def _passes(rows: DataFrame, found: DataFrame | None, threshold: float, passes: int, window: int) -> DataFrame:
    """found, and the spanning links that a round's passes over hashed rows give."""
    for k in range(passes):
        turn = rows.select("label", F.col("hashes")[k].alias("hash"), "rep", "vec").repartitionByRange("label", "hash", "rep").sortWithinPartitions("label", "hash", "rep")
        pairs = settle(turn.select("label", "rep", "vec").mapInArrow(lambda b: _neighbours(b, threshold, window), "a long, b long"), f"embeddings-pass{k}")
        found = pairs if found is None else found.unionByName(pairs)
    return found


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """(id, n_links long, component_id, kept boolean), one row for each row of vectors.

    Only rows of one non-null label link, at a cosine of at least threshold. Vectors that are null, empty, zero, or hold null or
    non-finite components link with nothing and are their own component; vectors of different lengths never link. Equal rows (an id that
    repeats) each count as a row and share links. A null id has component null unless it links to a row with an id. Other columns are
    ignored; an empty table gives no rows.
    """
    reps = representatives(vectors, id_col, vec_col, label_col)
    counted = reps.groupBy("label", F.size("vec").alias("dim")).agg(F.count("*").alias("rows")).where("rows > 1")
    labels = settle(counted.withColumn("code", F.monotonically_increasing_id()), "embeddings-labels")
    means = centres(reps)
    found, before, rows = None, None, hashed(reps, means, passes)
    for turn in range(ROUNDS):
        found = _passes(rows, found, threshold, passes, window)
        classes = settle(components(found, "embeddings-links"), "embeddings-classes")
        labels = merged(reps, classes, labels.select("label", "dim", "rows", "code"))
        gained = labels.where(F.col("rows") > QUERIES)
        if before is not None:
            gained = gained.join(before, "code").where(F.col("merged") - F.col("earlier") > (1 - RECALL) * F.col("merged"))
        waiting = settle(gained.where("merged > 0").select("label", "code", F.col("merged").alias("earlier")), "embeddings-waiting")
        if turn + 1 == ROUNDS or waiting.isEmpty():
            break
        before = waiting.select("code", "earlier")
        rows = hashed(reps.join(waiting.select("label").distinct(), "label", "left_semi"), means, passes, turn + 1)
    found = found.unionByName(seen(reps, classes, labels, threshold))
    classes = settle(components(found, "embeddings-links"), "embeddings-classes")
    members = reps.select("rep", "n", "vec").join(classes, reps.rep == classes.node)
    size = F.count("*")
    blocks = classes.groupBy("root").agg(F.greatest(F.ceil(size / BLOCK), F.least(F.ceil(size / LEAST_BLOCK), F.lit(LEAST_BLOCKS))).cast("int").alias("blocks"))
    members = members.join(blocks, "root").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = members.select(F.col("root").alias("class"), F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "rep", "n", "vec")
    spread = spread.repartition("class", "low", "high").sortWithinPartitions("class", "low", "high")
    links = spread.mapInArrow(lambda b: _count_links(b, threshold), "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))
    joined = reps.select("rep", "least", "n", "label", "k1", "k2").join(classes, reps.rep == classes.node, "left").join(links, "rep", "left")
    joined = joined.select("label", "k1", "k2", "n", "least", F.coalesce("root", "rep").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))
    smallest = joined.groupBy("class").agg(F.min("least").alias("component"))
    facts = settle(joined.join(smallest, "class").select("label", "k1", "k2", (F.col("n") - 1 + F.col("links")).alias("n_links"), "component"), "embeddings-facts")
    given = vectors.select(F.col(id_col).alias("_id"), *_keyed(vectors, label_col, vec_col)).drop("vec")
    out = given.join(facts, ["label", "k1", "k2"], "left")
    component = F.coalesce("component", "_id")
    return out.select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"))


def op7_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "embeddings"))
