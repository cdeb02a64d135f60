"""Exact k-means over integer vectors, with Yinyang bounds.

Centroids are clustered into groups once, before the first round. Each vector carries, in the table that a round writes, its centroid, an upper bound of
the distance to it, and one lower bound a group: no other centroid of that group is nearer. After centroids move, the upper bound grows by the move of the vector's
own centroid and each lower bound shrinks by the largest move in its group. Then

* the global filter: if every lower bound lies above the upper bound, the vector stays where it is;
* else the upper bound is made exact, and the group filter rules out groups whose lower bound lies above it;
* only centroids of the groups left are compared, in exact integer arithmetic, ties to the smaller number.

Bounds are floating-point and a filter needs them apart by SLACK, so a rounding error can only cause a comparison, never prevent one. The centroids (k times the
number of components, both parameters) are the only thing a driver or a task holds; sums of clusters come as one row a cluster and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, settle, slices

K, ROUNDS, COMPONENTS, SCALE = 16, 3, 64, 64
#: Relative distance that a filter's bounds must be apart.
SLACK = 1e-9
#: Components must stay below this, so that squared distances of up to 1,024 components are exact in 64 bits.
LIMIT = 1 << 26
#: Rows of vectors in a task's memory at once.
ROWS = 4096


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(id, x array<long>): floor(scale * component) of the vectors with exactly `components` components, all finite. Other rows are left out.

    A component of LIMIT or more after scaling raises an error, for then distances would not be exact.
    """
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    x = F.col(vec_col).cast("array<double>")
    good = vectors.where((F.size(vec_col) == components) & ~F.exists(x, bad))
    floor = F.transform(x, lambda c: F.when(F.abs(c) * scale < LIMIT - 1, F.floor(c * scale)).otherwise(F.raise_error(F.lit(f"a component times {scale} reaches {LIMIT}")).cast("long")))
    return good.select(F.col(id_col).alias("id"), floor.alias("x"))


def hash_order(ident: Column) -> Column:
    return F.sha2(F.concat(F.lit("1:"), F.coalesce(ident.cast("string"), F.lit(""))).cast("binary"), 256)


def grouped(centroids: np.ndarray, groups: int, rounds: int = 5) -> list[np.ndarray]:
    """Numbers of the centroids in each of at most `groups` groups: a small k-means over the centroids themselves, started from spread-out ones."""
    c = centroids.astype(np.float64)
    heads = [0] if len(c) else []
    while len(heads) < min(groups, len(c)):
        heads.append(int(np.min([((c - c[h]) ** 2).sum(axis=1) for h in heads], axis=0).argmax()))
    middle = c[heads]
    of = np.zeros(len(c), int)
    for _ in range(rounds):
        of = ((c[:, None] - middle[None]) ** 2).sum(axis=2).argmin(axis=1)
        middle = np.array([c[of == g].mean(axis=0) if (of == g).any() else middle[g] for g in range(len(middle))])
    return [np.flatnonzero(of == g) for g in range(len(middle)) if (of == g).any()]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to rows of c, all as 64-bit integers."""
    out = np.empty((len(x), len(c)), np.int64)
    for j, row in enumerate(c):
        d = x - row
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


def assign(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(centroid, upper, lower, compared) of each row of x, by the two filters; own is -1 where a row has no centroid yet. Upper bounds of rows that were compared are exact."""
    own, upper, lower, compared = own.copy(), upper.copy(), lower.copy(), np.zeros(len(x), np.int64)
    todo = np.flatnonzero((own < 0) | ~(lower.min(axis=1) > upper * (1 + SLACK) + SLACK))
    if not len(todo):
        return own, upper, lower, compared
    far = np.iinfo(np.int64).max
    v, had = x[todo], own[todo]
    known = np.full((len(todo), len(centroids)), far)
    at = np.flatnonzero(had >= 0)
    d = v[at] - centroids[had[at]]
    known[at, had[at]] = np.einsum("ij,ij->i", d, d)
    compared[todo[at]] += 1
    best = known.min(axis=1)
    bound = lower[todo]
    scanned = np.zeros(bound.shape, bool)
    for g, members in enumerate(groups):
        rows = np.flatnonzero((best == far) | ~(bound[:, g] > np.sqrt(best.astype(np.float64)) * (1 + SLACK) + SLACK))
        known[rows[:, None], members] = squared(v[rows], centroids[members])
        compared[todo[rows]] += len(members)
        best[rows] = np.minimum(best[rows], known[rows[:, None], members].min(axis=1))
        scanned[rows, g] = True
    now = known.argmin(axis=1)  # the first of equal ones: the smaller number
    exact = np.sqrt(known.astype(np.float64))
    exact[known == far] = np.inf
    others = exact.copy()
    others[np.arange(len(todo)), now] = np.inf
    for g, members in enumerate(groups):
        nearest = others[:, members].min(axis=1)
        bound[:, g] = np.where(scanned[:, g], nearest, np.minimum(bound[:, g], nearest))
    own[todo], upper[todo], lower[todo] = now, exact[np.arange(len(todo)), now], bound
    return own, upper, lower, compared


def _matrix(part: pa.RecordBatch, name: str, kind: type) -> np.ndarray:
    return part.column(name).flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(part.num_rows, -1)


def assigned(state: DataFrame, centroids: np.ndarray, moved: np.ndarray, groups: list[np.ndarray], last: bool = False) -> DataFrame:
    """state(id, x, cluster, upper, lower, compared) after centroids have moved by the distances `moved`; the last time with `distance long`, exact."""
    most = np.array([moved[m].max() for m in groups])
    schema = state.schema
    if last:
        schema = type(schema)([*schema.fields, *state.sparkSession.createDataFrame([], "distance long").schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, ROWS):
            if not part.num_rows:
                continue
            x, own = _matrix(part, "x", np.int64), part.column("cluster").to_numpy().astype(np.int64)
            upper = part.column("upper").to_numpy() + np.where(own >= 0, moved[own], 0)
            own, upper, lower, compared = assign(x, own, upper, _matrix(part, "lower", np.float64) - most, centroids, groups)
            cols = [part.column("id"), part.column("x"), pa.array(own.astype(np.int32)), pa.array(upper), pa.FixedSizeListArray.from_arrays(pa.array(lower.ravel()), len(groups)).cast(pa.list_(pa.float64())), pa.array(compared + part.column("compared").to_numpy())]
            if last:
                d = x - centroids[own]
                cols.append(pa.array(np.einsum("ij,ij->i", d, d)))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return state.mapInArrow(run, schema)


def sums(state: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """(count, componentwise sum) of each non-empty cluster; each task reports one row a cluster, whatever the clusters' sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        for part in slices(batches, ROWS):
            own = part.column("cluster").to_numpy()
            for c in np.unique(own).tolist():
                mine = _matrix(part, "x", np.int64)[own == c]
                total[c] = total.get(c, 0) + mine.sum(axis=0)
                count[c] = count.get(c, 0) + len(mine)
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.int32()), pa.array(list(count.values()), pa.int64()), pa.array([t.tolist() for t in total.values()], pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = state.select("cluster", "x").mapInArrow(run, "cluster int, n long, total array<long>")
    by_component = parts.select("cluster", "n", F.posexplode("total").alias("at", "part"))
    rows = by_component.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).orderBy("cluster", "at").collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in rows:
        out.setdefault(r.cluster, (r.n, []))[1].append(int(r.total))
    return out


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, groups: int | None = None) -> DataFrame:
    """(id, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256, compared long) of vectors(id, x array<long>).

    Centroids start as the k vectors whose ids come first in hash_order, ties (repeated or null ids, null as an empty text) by the vector; with fewer vectors there
    are fewer centroids. Each round assigns, then moves every non-empty centroid to the componentwise floor of its vectors' mean; then
    vectors are assigned once more. Repeated rows count each time. An empty table gives no rows. compared counts the distances a vector was
    compared by, k a round without bounds.
    """
    vectors = settle(vectors, "centroids-vectors")
    first = vectors.orderBy(hash_order(F.col("id")), "x").limit(k).collect()
    if not first:
        fields = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string", "compared": "long"}
        return vectors.select("id", *[F.lit(None).cast(kind).alias(c) for c, kind in fields.items()])
    centroids = np.array([r.x for r in first], np.int64).reshape(len(first), -1)
    of = grouped(centroids, groups or max(1, round(len(first) ** 0.5)))
    none = F.array_repeat(F.lit(float("-inf")), len(of))
    state = vectors.select("id", "x", F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), none.alias("lower"), F.lit(0).cast("long").alias("compared"))
    moved, before = np.zeros(len(centroids)), vectors
    for _ in range(rounds):
        state = settle(assigned(state, centroids, moved, of), "centroids")
        discard(before)
        before, now = state, centroids.copy()
        for c, (n, total) in sums(state).items():
            now[c] = [t // n for t in total]
        moved = np.sqrt(((now - centroids) ** 2).sum(axis=1).astype(np.float64)) * (1 + SLACK)
        centroids = now
    last = settle(assigned(state, centroids, moved, of, last=True).select("id", "cluster", "distance", "compared"), "centroids-last")
    discard(before)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    inertia = {r.cluster: r.s for r in last.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [(c, s, sum(inertia.values()), digests[c]) for c, s in inertia.items()]
    facts = last.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows at most
    return last.join(F.broadcast(facts), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared")


def op13_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    from .common import table

    got = clusters(integer_vectors(table(spark, sf_dir, "embeddings")))
    return got.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(r: int) -> str:
    return f"""
a{r} AS MATERIALIZED (SELECT vec_id, x, c FROM (
  SELECT v.*, k.c, row_number() OVER (PARTITION BY v.row ORDER BY list_sum(list_transform(list_zip(v.x, k.m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), k.c) AS place FROM kept v, k{r} k) WHERE place = 1),
s{r} AS (SELECT c, pos, CAST(sum(x[pos]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, 65) t(pos) GROUP BY c, pos),
m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS m FROM s{r} GROUP BY c),
k{r + 1} AS MATERIALIZED (SELECT k.c, coalesce(m{r}.m, k.m) AS m FROM k{r} k LEFT JOIN m{r} USING (c))"""


OP13_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x, row_number() OVER () AS row FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
k0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS c, x AS m FROM (
  SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM kept ORDER BY h, x LIMIT 16)),
{",".join(_round_sql(r) for r in range(ROUNDS))},
d AS (SELECT v.vec_id, v.row, k.c, k.m, CAST(list_sum(list_transform(list_zip(v.x, k.m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance FROM kept v, k{ROUNDS} k),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY distance, c) AS place FROM d) WHERE place = 1)
SELECT vec_id, c AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256 FROM f
"""
