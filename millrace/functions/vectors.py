"""Vectors and small tensors as array Columns; sums run in array order in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import let


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def rounded(v: Column, digits: int) -> Column:
    """A number to so many digits; what rounds to zero keeps its sign, as IEEE numbers do (a decimal number has none)."""
    return F.round(F.abs(v), digits) * F.signum(v)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def shortened(x: Column, n: int) -> Column:
    """The first n dimensions, of length 1 again."""
    y = F.slice(x, 1, n)
    return let(norm(y), lambda d: F.transform(y, lambda v: v.cast("double") / d))


def affine(x: Column, m: float, a: float) -> Column:
    return F.transform(x, lambda v: v * m + a)


def unary(x: Column, f) -> Column:
    return F.transform(x, lambda v: f(v.cast("double")))


def gelu(v: Column) -> Column:
    return 0.5 * v * (1 + F.tanh(math.sqrt(2 / math.pi) * (v + 0.044715 * v * v * v)))


def binary(x: Column, y: Column, f) -> Column:
    """Element by element; an array of one element is repeated."""
    a = F.when(F.size(x) == 1, F.transform(y, lambda _: F.get(x, 0))).otherwise(x)
    b = F.when(F.size(y) == 1, F.transform(x, lambda _: F.get(y, 0))).otherwise(y)
    return F.zip_with(a, b, f)


def softmax(x: Column) -> Column:
    e = let(F.array_max(x), lambda most: F.transform(x, lambda v: F.exp(v.cast("double") - most.cast("double"))))
    return let(e, lambda y: let(total(y), lambda t: F.transform(y, lambda v: v / t)))


def gather(x: Column, ids: Column) -> Column:
    """Items at 0-based positions; a position outside raises."""
    return F.transform(ids, lambda i: F.element_at(x, (i + 1).cast("int")))


def rotary(x: Column, cos: Column, sin: Column) -> Column:
    """Rotates the two halves of a vector against each other."""
    half = (F.size(x) / 2).cast("int")
    a, b = F.slice(x, F.lit(1), half), F.slice(x, half + 1, half)
    at = F.sequence(F.lit(0), half - 1)
    low = F.transform(at, lambda i: F.get(a, i) * F.get(cos, i) - F.get(b, i) * F.get(sin, i))
    return F.concat(low, F.transform(at, lambda i: F.get(b, i) * F.get(cos, i) + F.get(a, i) * F.get(sin, i)))


def rms_norm(x: Column, weight: Column, epsilon: float = 1e-6) -> Column:
    scale = F.sqrt(dot(x, x) / F.size(x) + epsilon)
    return let(scale, lambda d: F.zip_with(x, weight, lambda v, w: v / d * (1 + w)))


def narrow(x: Column, start: int, n: int) -> Column:
    return F.slice(x, start + 1, n)


def transposed(m: Column) -> Column:
    """Rows of a matrix (array of equally long arrays) as columns."""
    return F.transform(F.sequence(F.lit(0), F.size(F.get(m, 0)) - 1), lambda j: F.transform(m, lambda r: F.get(r, j)))


def reshaped(x: Column, rows: int, columns: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice(x, i * columns + 1, columns))


def matmul(a: Column, b: Column) -> Column:
    """Product of two small matrices held in one row."""
    return let(transposed(b), lambda t: F.transform(a, lambda r: F.transform(t, lambda c: dot(r, c))))


def linear(x: Column, weight: Column, bias: Column | None = None) -> Column:
    """x times the transposed weight (rows are outputs), plus a bias."""
    out = F.transform(weight, lambda row: dot(x, row))
    return out if bias is None else F.zip_with(out, bias, lambda a, b: a + b)
