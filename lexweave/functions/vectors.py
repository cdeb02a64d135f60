"""Vector arithmetic on array<double> columns, as built-in expressions, and the numeric functions encoders use."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY_TOKENS = 1e-9


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(doubles(a), lambda x: x / n)).otherwise(doubles(a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a side is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def contrast_similarity(a: Column, b: Column, tau: float = 0.5) -> Column:
    return F.exp(cosine(a, b) / tau)


def elu(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(F.expm1(x))


def prelu(x: Column, slope: float = 0.25) -> Column:
    return F.when(x >= 0, x).otherwise(slope * x)


def leaky_relu(x: Column, slope: float = 0.2) -> Column:
    return F.when(x >= 0, x).otherwise(slope * x)


def gelu_new(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x**3)))


def layer_norm(x: np.ndarray, weight: np.ndarray | float = 1.0, bias: np.ndarray | float = 0.0, eps: float = 1e-12) -> np.ndarray:
    """(x - mean) / (deviation + eps): eps outside the root."""
    return (x - x.mean(-1, keepdims=True)) / (x.std(-1, keepdims=True) + eps) * weight + bias


def position_table(n: int, dim: int, padding: int | None = None) -> np.ndarray:
    """Sinusoidal positions, all sines before all cosines; an odd dim ends in a zero column; the padding row is zero."""
    half = dim // 2
    rate = np.exp(np.arange(half) * -(math.log(10000.0) / max(1, half - 1)))
    angle = np.arange(n)[:, None] * rate[None]
    table = np.concatenate([np.sin(angle), np.cos(angle), np.zeros((n, dim % 2))], axis=1)
    if padding is not None:
        table[padding] = 0
    return table


def relevance_colour(r: Column, threshold: float = 0.0) -> Column:
    """#rrggbbaa: red above the threshold, blue otherwise, as strong as |r|."""
    alpha = F.lpad(F.hex(F.round(F.least(F.abs(r), F.lit(1.0)) * 255).cast("int")), 2, "0")
    return F.lower(F.concat(F.when(r > threshold, F.lit("#ff0000")).otherwise(F.lit("#0000ff")), alpha))
