"""Mixing sources to target weights by entropy balancing.

Each source gets a target number of words. Document rates stay as close (in bounded entropy) to one common base rate as the token
constraint of their source allows; the dual has one multiplier a source, rates are exponential tilts of the base odds by document size,
and all multipliers are found together by safeguarded Newton steps, each one aggregation over the (source, size) histogram, summed up where its rows
lie before sources meet; STEPS_AT_ONCE steps are one plan. Rates become whole
copies by dithering: a hash of the document moves its rate up to the next integer or not, and a shift common to the source, found by
histogram passes over the documents' turning points, makes the copies' words meet the target to within about one document.
Where that is more than NEAR of the target, the EDGE documents nearest to their turning points, of any source, are looked at together: copies of up to three of them change at a time as long as that comes nearer.

What is known of a source is a row of a settled table, however many sources there are; the driver sees sums over all of them alone. The table is
broadcast to the histogram if it has at most BROADCAST_SOURCES rows (some 20 MB), else joined by source.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import dense_index
from .common import n_words, settle

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, LIMIT = 1.5, 2
STEPS, STEPS_AT_ONCE, TOLERANCE = 60, 6, 1e-7
BINS, PASSES = 1 << 12, 2
BROADCAST_SOURCES = 100_000
#: Rounds of rounding, and how near a target, relative to it, ends them.
ROUNDS, NEAR = 3, 1e-3
#: Documents of a source, those nearest to their turning points, whose copies may still change after rounding.
EDGE = 32


def source_key(source: Column) -> Column:
    """Text that orders sources by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sources: DataFrame, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """sources(key, size, weight) with target: share times all sizes, split by weight; none above limit times its size, the excess shared again among the others."""
    cap = F.col("size") * float(limit)
    got = sources.withColumns({"target": F.lit(None).cast("double")})
    while True:
        # One row: what is left for sources below their limit, and their weights.
        open_ = F.col("target").isNull()
        every, given, weights = got.agg(F.sum("size"), F.coalesce(F.sum("target"), F.lit(0.0)), F.sum(F.when(open_, F.col("weight")))).first()
        if not weights:
            return got
        part = F.lit(share * every - given) * F.col("weight") / F.lit(weights)
        over = got.where(open_ & (part > cap))
        if over.isEmpty():
            return got.withColumn("target", F.coalesce("target", part))
        got = settle(got.withColumn("target", F.coalesce("target", F.when(part > cap, cap))), "mixing-targets")


def _rate(size: Column, tilt: Column, mean: Column, base: float, limit: float) -> Column:
    odds = math.log(base / (limit - base))
    return limit / (1 + F.exp(-F.least(F.greatest(odds + tilt * size / mean, F.lit(-500.0)), F.lit(500.0))))


def _tilted(histogram: DataFrame, sources: DataFrame, base: float, limit: float) -> DataFrame:
    """sources with tilt, their multiplier, and whole: the target is all a source may give. Sources without a target keep tilt 0."""
    live = (F.col("target") > 0) & (F.col("target") < F.col("size") * (limit * (1 - 1e-12)))
    infinite = F.lit(math.inf)
    state = sources.withColumns({"whole": (F.col("target") > 0) & ~live, "done": ~live, "tilt": F.lit(0.0), "low": -infinite, "high": infinite})
    kept = state.columns
    held = F.broadcast if sources.count() <= BROADCAST_SOURCES else lambda rows: rows
    by_key = histogram.select(F.col("key").alias("k"), F.col("size").alias("s"), "n")

    def step(state: DataFrame) -> DataFrame:
        rate = _rate(F.col("s"), F.col("tilt"), F.col("mean"), base, limit)
        words = F.col("n") * F.col("s") * rate
        rows = by_key.join(held(state), F.col("k") == F.col("key"))
        sums = rows.groupBy("key").agg(*[F.first(c).alias(c) for c in kept if c != "key"], F.sum(words).alias("words"), F.sum(words * F.col("s") / F.col("mean") * (1 - rate / limit)).alias("slope"))
        miss = F.col("target") - F.col("words")
        done = F.col("done") | (F.abs(miss) <= TOLERANCE * F.col("target"))
        low = F.when(done | (miss <= 0), F.col("low")).otherwise(F.col("tilt"))
        high = F.when(done | (miss > 0), F.col("high")).otherwise(F.col("tilt"))
        newton = F.when(F.col("slope") > 0, F.col("tilt") + miss / F.col("slope"))
        # Outside what is known to hold the root: halve, or reach out.
        halved = F.when((low > -infinite) & (high < infinite), (low + high) / 2).otherwise((2 * F.abs("tilt") + 1) * F.when(miss > 0, 1.0).otherwise(-1.0))
        then = F.least(F.greatest(F.when((newton > low) & (newton < high), newton).otherwise(halved), F.lit(-1e6)), F.lit(1e6))
        now = {"done": done, "low": low, "high": high, "tilt": F.when(done, F.col("tilt")).otherwise(then)}
        return sums.select(*[now[c].alias(c) if c in now else F.col(c) for c in kept])

    for _ in range(STEPS // STEPS_AT_ONCE):
        for _ in range(STEPS_AT_ONCE):
            state = step(state)
        state = settle(state, "mixing-tilts")
        if state.where("not done").isEmpty():
            break
    return state.withColumn("tilt", F.round("tilt", 9)).drop("done", "low", "high")


def _rated(rows: DataFrame, base: float, limit: int) -> DataFrame:
    """Adds _rate and _chance to rows that have _id, _size and their source's tilt, mean and whole."""
    rate = F.when(F.col("whole"), F.lit(float(limit))).otherwise(_rate(F.col("_size"), F.col("tilt"), F.col("mean"), base, limit))
    chance = F.shiftrightunsigned(F.xxhash64(F.col("_id").cast("string"), "_size"), 11).cast("double") / float(1 << 53)
    return rows.withColumns({"_rate": rate, "_chance": chance})


def _shifted(sized: DataFrame, sources: DataFrame, base: float, limit: int, nearest: bool) -> DataFrame:
    """sources with at, the shift up to which a source's words stay within its target, and words, its words there; only those with in_round change.

    A document takes its k-th copy once the shift reaches k - rate - chance. PASSES histograms of BINS bins, each inside the bin in which the one before
    passed the target. If nearest is true, the row that passes it is taken where that comes nearer.
    """
    width = 2.0 * limit + 2
    turning = F.explode(F.array(*[F.lit(float(k)) - F.col("_rate") - F.col("_chance") for k in range(1, limit + 1)]))
    rows = sized.select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.col("size").alias("_size")).where("_size > 0")

    def points(state: DataFrame) -> DataFrame:
        """Turning points not yet taken, of sources still open. One at the shift itself has been taken by the round before."""
        of = rows.join(state.where("open"), F.col("_key") == F.col("key")).where("_size <= room")
        return _rated(of, base, limit).select("key", "at", "words", "target", "_size", turning.alias("turn")).where("turn > at")

    state = sources.withColumn("open", F.col("in_round"))
    for _ in range(PASSES):
        one = width / BINS
        place = F.floor((F.col("turn") - F.col("at")) / F.lit(one))
        binned = points(state).withColumn("bin", place).where(F.col("bin").between(0, BINS - 1)).groupBy("key", "words", "target", "bin").agg(F.sum("_size").cast("double").alias("mine"))
        after = F.col("words") + F.sum("mine").over(Window.partitionBy("key").orderBy("bin"))
        ends = binned.withColumn("after", after).groupBy(F.col("key").alias("k")).agg(F.max("after").alias("most"), F.min(F.when(F.col("after") > F.col("target"), F.struct("bin", (F.col("after") - F.col("mine")).alias("upto")))).alias("crossed"))
        crossed, there = F.col("crossed").isNotNull(), F.col("most").isNotNull()
        state = state.join(ends, F.col("key") == F.col("k"), "left").withColumns({
            "at": F.when(crossed, F.col("at") + F.col("crossed.bin") * F.lit(one)).when(there, F.col("at") + F.lit(width)).otherwise(F.col("at")),
            "words": F.coalesce("crossed.upto", "most", "words"),
            "open": F.col("open") & (crossed | ~there),
        })
        state = settle(state.drop("k", "most", "crossed"), "mixing-shifts")
        width = one
    if nearest:
        edge = points(state).where(F.col("turn") < F.col("at") + F.lit(width)).groupBy(F.col("key").alias("k")).agg(F.sum("_size").cast("double").alias("more"))
        state = state.join(edge, F.col("key") == F.col("k"), "left")
        nearer = F.coalesce(F.abs(F.col("words") + F.col("more") - F.col("target")) < F.abs(F.col("target") - F.col("words")), F.lit(False))
        state = state.withColumns({"at": F.when(nearer, F.col("at") + F.lit(width)).otherwise(F.col("at")), "words": F.when(nearer, F.col("words") + F.col("more")).otherwise(F.col("words"))}).drop("k", "more")
    return state.drop("open")


def nearer(words: np.ndarray, copies: np.ndarray, target: float, limit: int, near: float | None = None) -> np.ndarray:
    """Copies from 0 to limit, those of up to three entries changed at a time, best change first, while words @ copies comes nearer to target, or until it is as near as `near` (NEAR of the target by default)."""
    near = NEAR * target if near is None else near
    # Two entries without words stand for changing fewer.
    words, copies = np.append(words, [0, 0]), np.append(copies, [0, 0])
    at, to = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(limit + 1), indexing="ij"))
    same = at[:, None] == at
    while abs(miss := target - float(words @ copies)) > near:
        step = (to - copies[at]) * words[at]
        rest = np.where(same, np.inf, miss - step[:, None] - step)
        least, best = abs(miss), None
        for k in range(len(at)):
            far = np.abs(rest - step[k])
            far[same[k]], far[:, same[k]] = np.inf, np.inf
            if (found := far.min()) < least:
                least, best = found, (*np.unravel_index(np.argmin(far), far.shape), k)
        if best is None:
            break
        for k in best:
            copies[at[k]] = to[k]
    return copies[:-2]


def _changed(rows: DataFrame, limit: int) -> DataFrame:
    """(_key, _size, _name, _copies) for rows(_key, _size, _name, target, words, copies, _far): of each source the EDGE entries that are nearest to a turning point; equal rows are one entry. words: all that the source gives now."""

    def change(group: pa.Table) -> pa.Table:
        group = group.sort_by([("_size", "ascending"), ("_name", "ascending")])
        size, n, copies = (group.column(c).to_numpy() for c in ("_size", "n", "copies"))
        target, words = (group.column(c)[0].as_py() for c in ("target", "words"))
        got = nearer(size * n, copies.astype(np.int64), target - words + float(size * n @ copies), limit, NEAR * target)
        return group.select(["_key", "_size", "_name"]).append_column("_copies", pa.array(got, pa.int32()))

    entries = rows.where("_size > 0").groupBy("_key", "_size", "_name", "target", "words", "copies").agg(F.count("*").alias("n"), F.min("_far").alias("_far"))
    place = F.row_number().over(Window.partitionBy("_key").orderBy("_far", "_size", "_name"))
    return entries.withColumn("_place", place).where(F.col("_place") <= EDGE).drop("_place", "_far").groupBy("_key").applyInArrow(change, "_key string, _size long, _name string, _copies int")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """docs with size long, source_size long, target double, rate double and copies int; input columns of these names are replaced.

    Sources ordered by code point (null is a source, last) take `weights` in turn. A null or empty text has size 0 and gets no words
    whatever its copies. A source that must give everything it may has all rates at the limit. Equal rows get equal copies; a null id is hashed
    like any other. An empty table gives no rows.
    """
    sized = docs.select(F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("key"), n_words(F.col(text_col)).alias("size"))
    sized = settle(sized, "mixing-sizes")
    histogram = settle(sized.groupBy("key", "size").agg(F.count("*").alias("n")), "mixing-histogram")
    sums = histogram.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("size"), F.sum("n").alias("docs"))
    index = dense_index(sums.select(F.lit("").alias("type"), F.col("key").alias("id")))
    sums = sums.join(index.select(F.col("id").alias("key"), "idx"), "key")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    mean = F.when(F.col("size") > 0, F.col("size") / F.col("docs")).otherwise(1.0)
    sources = targets(settle(sums.select("key", "size", "docs", weight.alias("weight"), mean.alias("mean")), "mixing-sources"), share, limit)
    base = min(share, limit * 0.999)
    state = _tilted(histogram, sources.drop("weight"), base, limit)
    # shifts: the rounds' rooms and shifts, the last first.
    state = state.withColumns({"at": F.lit(-float(limit) - 1), "words": F.lit(0.0), "room": F.lit(math.inf), "in_round": ~F.col("whole"), "shifts": F.array().cast("array<struct<room:double,shift:double>>")})
    for last in [False] * (ROUNDS - 1) + [True]:
        # Each round stops short of the document that would overshoot; the next one goes on among documents no larger than what is missing.
        state = _shifted(sized, state, base, limit, last)
        state = state.withColumn("shifts", F.when(F.col("in_round"), F.concat(F.array(F.struct("room", F.col("at").alias("shift"))), "shifts")).otherwise(F.col("shifts")))
        left = F.col("target") - F.col("words")
        state = settle(state.withColumns({"room": F.when(F.col("in_round"), left).otherwise(F.col("room")), "in_round": F.col("in_round") & (left > NEAR * F.col("target"))}), "mixing-rounds")
        if last or state.where("in_round").isEmpty():
            break
    own = {"size", "source_size", "target", "rate", "copies"}
    kept = [c for c in docs.columns if c not in own]
    named = {c: f"_in_{i}" for i, c in enumerate(kept)}
    out = docs.select(*[F.col(c).alias(n) for c, n in named.items()], F.col(id_col).alias("_id"), source_key(F.col(source_col)).alias("_key"), n_words(F.col(text_col)).alias("_size"))
    out = _rated(out.join(state, F.col("_key") == F.col("key")), base, limit)
    shift = F.filter("shifts", lambda x: F.col("_size") <= x["room"])
    shift = F.coalesce(F.try_element_at(shift, F.lit(1))["shift"], F.lit(0.0))
    copies = F.floor(F.col("_rate") + F.col("_chance") + shift)
    copies = F.when(F.col("whole"), F.lit(limit)).otherwise(F.least(F.greatest(copies, F.lit(0)), F.lit(limit))).cast("int")
    missed = settle(state.where(~F.col("whole") & (F.abs(F.col("target") - F.col("words")) > NEAR * F.col("target"))).select(F.col("key").alias("_key")), "mixing-missed")
    if not missed.isEmpty():
        # A document that is used up, or not begun, is one copy from its turning point at most.
        gone = F.least(F.greatest(F.col("_rate") + F.col("_chance") + shift, F.lit(0.0)), F.lit(limit + 1.0))
        out = out.withColumns({"copies": copies, "_name": F.col("_id").cast("string"), "_far": F.array_min(F.array(*[F.abs(gone - k) for k in range(1, limit + 1)]))})
        # Turning points lie evenly, so about twice EDGE documents are so near, however many the source has; as many again by hash, where most are used up; and all of a small source.
        close = F.least("_far", "_chance") * F.col("docs") <= EDGE
        edge = out.join(missed, "_key", "left_semi").where(close).select("_key", "_size", "_name", "target", "words", "copies", "_far")
        held = settle(_changed(edge, limit), "mixing-changed")
        held = held.withColumnsRenamed({c: f"_of{c}" for c in ("_key", "_size", "_name")})
        out = out.join(held, (F.col("_key") == F.col("_of_key")) & (F.col("_size") == F.col("_of_size")) & F.col("_name").eqNullSafe(F.col("_of_name")), "left")
        copies = F.coalesce("_copies", "copies")
    return out.select(*[F.col(n).alias(c) for c, n in named.items()], F.col("_size").alias("size"), F.col("size").alias("source_size"), "target", F.col("_rate").alias("rate"), copies.alias("copies"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of docs as often as its copies say, with the columns of docs."""
    named = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    roles = {k: named[options.pop(k, v)] for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    got = mixed(docs.withColumnsRenamed(named), **roles, **options)
    got = got.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return got.select([F.col(v).alias(k) for k, v in named.items()])


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    from .common import table

    got = mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
