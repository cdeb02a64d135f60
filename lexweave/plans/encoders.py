"""Queries of the network's encoders under fixed weights, with SQL that writes the layers out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, network
from .catalogue import _HALVES, CLC, CSC, query, typed
from .fixtures import Corpus

#: Small fixed weights, (in, out).
W = {k: np.round(np.sin(np.arange(4.0) + i).reshape(2, 2), 3) for i, k in enumerate(("clc", "csc", "att", "source", "target"))}
B, A = np.array([0.1, -0.2]), np.array([0.7, -0.4])
BACK = [("legislation", "cited_by", "case"), ("subject_matter", "related_to", "case")]


def _linear(x: list[str], w: np.ndarray, b: np.ndarray | None = None) -> list[str]:
    return [f"({'' if b is None else f'{b[j]}::DOUBLE + '}" + " + ".join(f"{w[i, j]}::DOUBLE * {x[i]}" for i in range(2)) + ")" for j in range(2)]


def _attended(views: list[str]) -> str:
    """CTEs that weigh views (node, h0, h1) by semantic attention, ending in `out`."""
    hidden = [f"tanh({x})" for x in _linear(["h0", "h1"], W["att"], B)]
    every = " UNION ALL ".join(f"SELECT '{v}' AS view, node, h0, h1 FROM {v}" for v in views)
    return f"""every AS ({every}),
score AS (SELECT view, exp({A[0]}::DOUBLE * avg({hidden[0]}) + {A[1]}::DOUBLE * avg({hidden[1]})) AS e FROM every GROUP BY view),
share AS (SELECT view, e / sum(e) OVER () AS b FROM score),
out AS (SELECT node, round(sum(b * h0), 5) + 0.0e0 AS h0, round(sum(b * h1), 5) + 0.0e0 AS h1 FROM every JOIN share USING (view) GROUP BY node)"""


def _rounded(got: DataFrame) -> DataFrame:
    return got.select("node", *[(F.round(F.col("vec")[i], 5) + 0.0).alias(f"h{i}") for i in range(2)])


def _cases(c: Corpus) -> DataFrame:
    return c.orders.select(F.concat(F.lit("6"), F.col("o_orderkey").cast("string")).alias("node"), F.array(F.col("o_totalprice").cast("double") / 1e5, F.month("o_orderdate") / 6.0 - 1).alias("vec"))


_CASES = "f AS (SELECT '6' || o_orderkey AS node, o_totalprice::DOUBLE / 1e5 AS x0, month(o_orderdate) / 6.0e0 - 1 AS x1 FROM orders)"


def _convolved(name: str, edges: str) -> str:
    z = _linear(["a0", "a1"], W[name], B)
    return f"""{name}_p AS (SELECT DISTINCT a.source AS s, b.source AS e FROM {edges} a JOIN {edges} b USING (target)),
{name}_o AS (SELECT s, count(*) AS n FROM {name}_p GROUP BY s), {name}_i AS (SELECT e, count(*) AS n FROM {name}_p GROUP BY e),
{name}_a AS (SELECT e AS node, sum(x0 / sqrt(o.n)) / sqrt(any_value(i.n)) AS a0, sum(x1 / sqrt(o.n)) / sqrt(any_value(i.n)) AS a1
  FROM {name}_p JOIN {name}_o o USING (s) JOIN {name}_i i USING (e) JOIN g ON node = s GROUP BY e),
{name}_z AS (SELECT node, {z[0]} AS z0, {z[1]} AS z1 FROM (SELECT g.node, coalesce(a0, 0) AS a0, coalesce(a1, 0) AS a1 FROM g LEFT JOIN {name}_a USING (node))),
{name} AS (SELECT node, CASE WHEN z0 >= 0 THEN z0 ELSE 0.25e0 * z0 END AS h0, CASE WHEN z1 >= 0 THEN z1 ELSE 0.25e0 * z1 END AS h1 FROM {name}_z)"""


_ELU = ", ".join(f"CASE WHEN x{i} > 0 THEN x{i} ELSE exp(x{i}) - 1 END AS x{i}" for i in range(2))


@query(f", {_CASES}, g AS (SELECT node, {_ELU} FROM f), {_convolved('clc', 'cl')}, {_convolved('csc', 'cs')}, {_attended(['clc', 'csc'])} SELECT node, h0, h1 FROM out")
def case_embeddings(c):
    """Embeddings of the cases by both metapaths, under fixed weights."""
    g = typed(c)
    pairs = {name: graph.metapath_halves(g, path) for name, path in (("clc", CLC), ("csc", CSC))}
    return _rounded(network.case_embeddings(pairs, _cases(c), {k: (W[k], B) for k in pairs}, (W["att"], B, A)))


def _attention(name: str, edges: str, features: str) -> str:
    h = _linear(["x0", "x1"], W["source"])
    t = _linear(["x0", "x1"], W["target"])
    return f"""{name}_h AS (SELECT node, {h[0]} AS h0, {h[1]} AS h1 FROM {features}),
{name}_t AS (SELECT node, {A[0]}::DOUBLE * {t[0]} + {A[1]}::DOUBLE * {t[1]} AS r FROM f),
{name}_e AS (SELECT t.node, h0, h1, {A[1]}::DOUBLE * h0 + {A[0]}::DOUBLE * h1 + r AS raw FROM {edges} JOIN {name}_h h ON h.node = target JOIN {name}_t t ON t.node = source),
{name}_w AS (SELECT node, h0, h1, exp(CASE WHEN raw >= 0 THEN raw ELSE 0.2e0 * raw END) AS w FROM {name}_e),
{name}_s AS (SELECT node, sum(w * h0) / sum(w) AS s0, sum(w * h1) / sum(w) AS s1 FROM {name}_w GROUP BY node),
{name} AS (SELECT f.node, coalesce(s0, 0) + {B[0]}::DOUBLE AS h0, coalesce(s1, 0) + {B[1]}::DOUBLE AS h1 FROM f LEFT JOIN {name}_s USING (node))"""


@query(
    f""", {_CASES}, acts AS (SELECT leg.id AS node, p_size / 25.0e0 AS x0, p_retailprice::DOUBLE / 1e3 AS x1 FROM part JOIN leg USING (p_partkey)),
topics AS (SELECT 'S' || s_suppkey AS node, s_acctbal::DOUBLE / 5e3 AS x0, s_nationkey / 12.0e0 AS x1 FROM supplier),
{_attention("by_act", "cl", "acts")}, {_attention("by_topic", "cs", "topics")}, {_attended(["by_act", "by_topic"])} SELECT node, h0, h1 FROM out"""
)
def schema_attention(c):
    """The schema view over all in-edges of the cases, under fixed weights."""
    g = typed(c)
    acts = c.part.join(c.legislation().select("p_partkey", "id"), "p_partkey").select(F.col("id").alias("node"), F.array(F.col("p_size") / 25.0, F.col("p_retailprice").cast("double") / 1e3).alias("vec"))
    topics = c.supplier.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("node"), F.array(F.col("s_acctbal").cast("double") / 5e3, F.col("s_nationkey") / 12.0).alias("vec"))
    views = [network.attend(graph.of_relation(g, r), x, _cases(c), W["source"], W["target"], A[::-1], A, B).select(F.lit(r[0]).alias("view"), "node", "vec") for r, x in zip(BACK, (acts, topics))]
    return _rounded(network.semantic_attention(views[0].unionByName(views[1]), W["att"], B, A))


_P1, _P2 = np.round(np.cos(np.arange(64.0) / 3).reshape(32, 2), 3), W["clc"]
_IN = [f"({B[j]}::DOUBLE + list_dot_product(%s, {_P1[:, j].tolist()}::DOUBLE[]))" for j in range(2)]


def _projected(side: str) -> str:
    y = _linear([f"CASE WHEN {x % side} > 0 THEN {x % side} ELSE exp({x % side}) - 1 END" for x in _IN], _P2, A)
    return f"[{y[0]}, {y[1]}]"


@query(
    f"""WITH {_HALVES}, z AS (SELECT vec_id, {_projected("a")} AS u, {_projected("b")} AS v FROM h),
s AS (SELECT x.vec_id AS i, y.vec_id AS j, exp(list_cosine_similarity(x.u, y.v) / 0.8e0) AS s FROM z x, z y),
r AS (SELECT i, sum(s) AS t, sum(CASE WHEN i = j THEN s END) AS m FROM s GROUP BY i), k AS (SELECT j, sum(s) AS t, sum(CASE WHEN i = j THEN s END) AS m FROM s GROUP BY j)
SELECT round(0.3e0 * (SELECT avg(-ln(m / (t + 1e-8))) FROM r) + 0.7e0 * (SELECT avg(-ln(m / (t + 1e-8))) FROM k), 6) AS loss""",
    prelude=False,
)
def projected_contrast(c):
    """The co-contrastive loss of two views through the projection that both share."""
    one, other = (x.select(F.col("id").alias("node"), "vec") for x in _both(c))
    return network.contrast(one, other, (_P1, B), (_P2, A), 0.8, 0.3).select(F.round("loss", 6).alias("loss"))


def _both(c: Corpus) -> tuple[DataFrame, DataFrame]:
    """Both halves of each vector as they are, not normalised."""
    return tuple(c.embeddings.select(F.col("vec_id").alias("id"), F.slice("embedding", at, 32).cast("array<double>").alias("vec")) for at in (1, 33))


