"""Dense vector functions over ARRAY<DOUBLE> columns (higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the floor under the norm in L2 normalisation.
NORM_EPS = 1e-12


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_doubles(v) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double"))


def array_sum(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v, eps: float = NORM_EPS) -> Column:
    v = as_doubles(v)
    norm = F.greatest(l2_norm(v), F.lit(eps))
    return F.transform(v, lambda x: x / norm)


def dot(a, b) -> Column:
    prod = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y)
    return array_sum(prod)


def logsumexp(v) -> Column:
    """log(sum(exp(v))) with the maximum subtracted first (stable)."""
    v = as_doubles(v)
    m = F.array_max(v)
    return m + F.log(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))


def softmax(v) -> Column:
    v = as_doubles(v)
    m = F.array_max(v)
    z = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x - m))
    return F.transform(v, lambda x: F.exp(x - m) / z)


def log_softmax(v) -> Column:
    v = as_doubles(v)
    lse = logsumexp(v)
    return F.transform(v, lambda x: x - lse)


def argmax(v) -> Column:
    """0-based index of the largest element; the first one on ties."""
    v = _c(v)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def first_element(v) -> Column:
    """First-token pooling: element 1 of a sequence of hidden states."""
    return F.element_at(_c(v), 1)


def round_all(v, digits: int = 6) -> Column:
    return F.transform(_c(v), lambda x: F.round(x, digits))
