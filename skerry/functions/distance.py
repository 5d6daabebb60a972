"""Vector distances as Column expressions.

They are for use inside other expressions, and for column against column: higher-order functions,
which Spark interprets.  Searches use the Arrow kernel of operators.vector, which is faster by far
(arithmetic unrolled to the dimension was slower still: its code is too long to compile).
l2 is squared; cosine is 1 - cos, null for zero vectors; dot is 1 - dot product;
hamming counts differing bits of packed bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "cosine", "dot", "hamming")


def _sum(terms: list[Column]) -> Column:
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2], strict=False)] + ([terms[-1]] if len(terms) % 2 else [])
    return terms[0]


def _fold(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def _terms(v: Column, query: Sequence[float] | Column, f) -> Column:
    if isinstance(query, Column):
        return _fold(F.zip_with(v, query, lambda x, y: f(x.cast("double"), y.cast("double"))))
    q = [float(x) for x in query]
    literal = F.array(*[F.lit(x) for x in q])
    return F.when(F.size(v) == len(q), _fold(F.zip_with(v, literal, lambda x, y: f(x.cast("double"), y))))


def l2(v: Column, query) -> Column:
    return _terms(v, query, lambda x, y: (x - y) * (x - y))


def dot_product(v: Column, query) -> Column:
    return _terms(v, query, lambda x, y: x * y)


def norm(v: Column) -> Column:
    return F.sqrt(_fold(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def cosine(v: Column, query) -> Column:
    if isinstance(query, Column):
        size, own = norm(query), norm(v)
    else:
        q = [float(x) for x in query]
        size, own = F.lit(sum(x * x for x in q) ** 0.5), norm(v)
    return F.when((own > 0) & (size > 0), 1 - dot_product(v, query) / (own * size))


def hamming(v: Column, query) -> Column:
    """v and query: arrays of bytes as integers."""
    differ = lambda x, y: F.bit_count(x.cast("int").bitwiseXOR(y.cast("int")))
    other = query if isinstance(query, Column) else F.array(*[F.lit(int(x)) for x in query])
    return F.when(F.size(v) == F.size(other), F.aggregate(F.zip_with(v, other, differ), F.lit(0), lambda a, x: a + x)).cast("double")


def distance(v: Column, query, metric: str = "l2") -> Column:
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    return {"l2": l2, "cosine": cosine, "dot": lambda a, b: 1 - dot_product(a, b), "hamming": hamming}[metric](v, query)


def late_interaction(v: Column, queries: Sequence[Sequence[float]], metric: str = "cosine") -> Column:
    """Distance of a multivector to several query vectors: for each the nearest of v's, summed."""
    if metric != "cosine":
        raise ValueError("multivectors are compared by cosine")
    nearest = lambda q: F.array_min(F.transform(v, lambda x: _cosine_of(x, q)))
    return _sum([nearest(q) for q in queries])


def _cosine_of(x: Column, q: Sequence[float]) -> Column:
    literal = F.array(*[F.lit(float(y)) for y in q])
    size = sum(float(y) ** 2 for y in q) ** 0.5
    own = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, y: a + y.cast("double") * y.cast("double")))
    product = F.aggregate(F.zip_with(x, literal, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, y: a + y)
    return 1 - product / (own * size)


def sign_bits(v: Column, dim: int) -> Column:
    """The signs of a vector packed eight to a byte (array of ints), for hamming()."""
    return F.array(*[_sum([F.when(F.get(v, F.lit(8 * b + i)) > 0, F.lit(1 << i)).otherwise(F.lit(0)) for i in range(min(8, dim - 8 * b))]) for b in range(-(-dim // 8))])
