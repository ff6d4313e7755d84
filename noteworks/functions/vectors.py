"""Vector columns as ``array<double>``: products, norms, distances."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from noteworks.functions.spans import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(a: Column) -> Column:
    """Unit vector; the zero vector stays as it is. The length is computed once, not once a coordinate."""
    return let(a, lambda v: let(norm(v), lambda size: F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(v)))


def cosine(a: Column, b: Column) -> Column:
    sizes = norm(a) * norm(b)
    return F.when(sizes > 0, dot(a, b) / sizes).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def clip_norm(a: Column, limit: float) -> Column:
    """Scale a vector down to length ``limit`` when it is longer."""
    size = norm(a)
    return F.when(size > limit, F.transform(a, lambda x: x * limit / size)).otherwise(a)


def laplace_noise(a: Column, uniforms: Column, epsilon: float, sensitivity: float = 1.0) -> Column:
    """Add Laplace noise of scale sensitivity/epsilon from uniform draws in [-0.5, 0.5)."""
    scale = sensitivity / epsilon

    def draw(x: Column, u: Column) -> Column:
        tail = F.greatest(1 - 2 * F.abs(u), F.lit(math.ulp(1.0)))
        return x - F.lit(scale) * F.signum(u) * F.log(tail)

    return F.zip_with(a, uniforms, draw)
