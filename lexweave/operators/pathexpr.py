"""Regular path expressions over a graph of labelled edges.

An expression is built from steps: `step("cites")` follows an edge of that label, `~e` goes e backwards, `a / b` is a and then b, `a | b` either, `e.times(2, 4)` from two to
four in a row, `e.times(0)` any number. It becomes an automaton whose states are the steps as they occur in it; reach() moves a frontier of (start, node, state) rows along edges
until no row is new. What was seen is never expanded again, so cycles and unbounded repetition end, and each round joins the new rows alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import settle


@dataclass(frozen=True)
class Path:
    """kind: step, then, either or times; parts: what it is made of, a label and whether it is reversed for a step, bounds for times."""

    kind: str
    parts: tuple

    def __truediv__(self, other: Path) -> Path:
        return Path("then", (self, other))

    def __or__(self, other: Path) -> Path:
        return Path("either", (self, other))

    def __invert__(self) -> Path:
        if self.kind == "step":
            return Path("step", (self.parts[0], not self.parts[1]))
        if self.kind == "times":
            return Path("times", (~self.parts[0], *self.parts[1:]))
        first, second = self.parts
        return ~second / ~first if self.kind == "then" else ~first | ~second

    def times(self, least: int, most: int | None = None) -> Path:
        """From least to most in a row; without a most, any number from least."""
        if least < 0 or (most is not None and most < max(least, 1)):
            raise ValueError(f"no path is repeated from {least} to {most} times")
        return Path("times", (self, least, most))


def step(label: str) -> Path:
    return Path("step", (label, False))


class Automaton:
    """State 0 is the start, every other one a step of the expression, repetitions written out; moves are (state, label, reversed, next state)."""

    def __init__(self, path: Path):
        self.steps: list[tuple[str, bool]] = []
        self.moves: set[tuple[int, str, bool, int]] = set()
        ends = self._add(path, {0})
        self.accepting = sorted(ends)

    def _add(self, path: Path, before: set[int]) -> set[int]:
        """States in which the path may have ended when it began in one of `before`."""
        if path.kind == "step":
            self.steps.append(path.parts)
            state = len(self.steps)
            self.moves |= {(b, *path.parts, state) for b in before}
            return {state}
        if path.kind == "then":
            return self._add(path.parts[1], self._add(path.parts[0], before))
        if path.kind == "either":
            return self._add(path.parts[0], before) | self._add(path.parts[1], before)
        inner, least, most = path.parts
        now = before
        for _ in range(least if most is not None else max(0, least - 1)):
            now = self._add(inner, now)
        if most is None:
            first = len(self.steps) + 1
            ends = self._add(inner, now)
            # From its own ends the last copy begins again, by the moves that began it.
            began = {m[1:] for m in self.moves if m[0] in now and m[3] >= first}
            self.moves |= {(e, *m) for e in ends for m in began}
            return ends if least else ends | now
        ended = set(now)
        for _ in range(most - least):
            now = self._add(inner, now)
            ended |= now
        return ended


def reach(edges: DataFrame, starts: DataFrame, path: Path) -> DataFrame:
    """Distinct (start, end): nodes that a path of the expression leads to from each of starts(id). edges(source, label, target).

    An expression that may be empty leads from every start to itself, whether or not it has edges. Edges with a null in them lead nowhere; null starts, repeated starts and edges count once. Empty tables give
    no rows. Rows grow with the pairs that are reached, rounds with the longest path that reaches something new; a hub is the key of a join that adaptive execution can split.
    """
    machine = Automaton(path)
    spark = edges.sparkSession
    used = sorted({(label, back) for _, label, back, _ in machine.moves})
    ways = [F.when(F.col("label") == label, F.struct(F.col("target" if back else "source").alias("node"), F.lit(back).alias("back"), F.col("source" if back else "target").alias("next"))) for label, back in used]
    either = edges.where(F.col("label").isin([label for label, _ in used])).select("label", F.explode(F.array_compact(F.array(*ways))).alias("e"))
    steps = settle(either.select("e.node", "label", "e.back", "e.next").dropna().distinct(), "path-steps")
    moves = F.broadcast(spark.createDataFrame([m for m in sorted(machine.moves)], "state int, label string, back boolean, to int"))  # as many as the expression has
    ids = starts.where(F.col("id").isNotNull()).select("id").distinct()
    front = settle(ids.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("state")), "path-front")
    seen, ends = [front], []
    # Rows in states that nothing follows are not seen again by any round: they only wait for the last distinct.
    last = sorted(set(range(len(machine.steps) + 1)) - {m[0] for m in machine.moves})
    onward = sorted({m[3] for m in machine.moves} - set(last))
    while True:
        moved = front.join(moves, "state").join(steps, ["node", "label", "back"]).select("start", F.col("next").alias("node"), F.col("to").alias("state"))
        if last:
            ends.append(moved.where(F.col("state").isin(last)))
        if not onward:
            break
        fresh = moved.where(F.col("state").isin(onward)).distinct()
        front = settle(fresh.join(reduce(DataFrame.unionByName, seen), ["start", "node", "state"], "left_anti"), "path-front")
        if front.isEmpty():
            break
        seen.append(front)
    return reduce(DataFrame.unionByName, seen + ends).where(F.col("state").isin(machine.accepting)).select("start", F.col("node").alias("end")).distinct()
