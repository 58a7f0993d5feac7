"""Small numeric expressions, and the tails of the rank tests' distributions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


def r6(c: Column) -> Column:
    """Six decimals, without negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def finite(c: Column) -> Column:
    """NaN and infinities become missing."""
    x = c.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == INF), None).otherwise(x)


def clip(c: Column, low: float, high: float) -> Column:
    """Missing stays missing (greatest and least alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def ratio(a: Column, b: Column) -> Column:
    """Missing where the denominator is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def numeric_columns(df: DataFrame, with_bool: bool = True) -> list[str]:
    kinds = (T.NumericType, T.BooleanType) if with_bool else (T.NumericType,)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def check_plain(df: DataFrame) -> None:
    """Nested, decimal and time columns must be cast or declared first."""
    bad = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.DecimalType, T.TimestampType, T.TimestampNTZType, T.DateType))]
    if bad:
        raise ValueError(f"cast or declare these columns: {', '.join(bad)}")


def normal_two_sided(x: float) -> float:
    return math.erfc(abs(x) / math.sqrt(2))


def chi2_tail(x: float, k: int) -> float:
    """P(chi-square of k degrees > x): series below the mean, continued fraction above."""
    if x <= 0:
        return 1.0
    a, y = k / 2, x / 2
    front = math.exp(a * math.log(y) - y - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        i = a
        while term > total * 1e-16:
            i += 1
            term *= y / i
            total += term
        return max(0.0, 1 - front * total)
    b, c = y + 1 - a, 1e300
    d = 1 / b
    out = d
    for i in range(1, 500):
        n = -i * (i - a)
        b += 2
        d = 1 / (n * d + b)
        c = b + n / c
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def signed_rank_exact(w: float, n: int) -> float:
    """Two-sided p of the smaller rank sum w among n pairs, by counting subsets of 1..n."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for i in range(1, n + 1):
        ways[i:] = ways[i:] + ways[:-i]
    return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))


def studentized_range_tail(q: float, k: int) -> float:
    """P(range of k standard normals > q), by quadrature."""
    if q <= 0:
        return 1.0
    x = np.linspace(-8, 8, 4001)
    cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x])
    high = np.array([0.5 * math.erfc(-(v + q) / math.sqrt(2)) for v in x])
    y = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * (high - cdf) ** (k - 1)
    return float(max(0.0, 1 - k * ((y[1:] + y[:-1]) / 2 * np.diff(x)).sum()))
