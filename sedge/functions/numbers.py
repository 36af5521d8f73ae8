"""Entropy, ranks and tails of distributions, as column expressions."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def binary_entropy(p: Column) -> Column:
    """In bits; 0 at both ends, null for null."""
    q = 1 - p
    inside = -(p * F.ln(p) + q * F.ln(q)) / F.ln(F.lit(2.0))
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).when(p.isNotNull(), inside)


def midrank(value: str, by: list[str], descending: bool = False) -> Column:
    """Rank within `by`, ties sharing their mean rank."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    ranked = F.rank().over(Window.partitionBy(*by).orderBy(order))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return ranked + (ties - 1) / 2


def share_rank(value: str, by: list[str], method: str = "average") -> Column:
    """Rank over number of rows, with mean ranks of ties or (method min) the lowest."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    if method == "average":
        return midrank(value, by) / n
    if method == "min":
        return F.rank().over(Window.partitionBy(*by).orderBy(value)) / n
    raise ValueError(f"unknown method: {method}")


def two_sided_normal(z: Column) -> Column:
    """The chance of a standard normal variable at least as far from 0. For aggregated rows; it runs in Python."""

    @F.pandas_udf(DoubleType())
    def tail(z: pd.Series) -> pd.Series:
        import math

        return z.map(lambda x: None if x is None or x != x else math.erfc(abs(x) / math.sqrt(2)))

    return tail(z)


def inverse_normal(p: Column) -> Column:
    """The value that a standard normal variable is below with that chance. For aggregated rows; it runs in Python."""

    @F.pandas_udf(DoubleType())
    def inverse(p: pd.Series) -> pd.Series:
        from statistics import NormalDist

        return p.map(lambda x: NormalDist().inv_cdf(x) if 0 < x < 1 else None)

    return inverse(p)


def chi_square_tail(x: Column, df: Column) -> Column:
    """The chance of a chi-square variable with df degrees of freedom at least as large: the regularised upper incomplete
    gamma function, by its series below df + 2 and by its continued fraction above. For aggregated rows."""

    @F.pandas_udf(DoubleType())
    def tail(x: pd.Series, df: pd.Series) -> pd.Series:
        import math

        def upper(a: float, x: float) -> float:
            if x <= 0:
                return 1.0
            scale = math.exp(a * math.log(x) - x - math.lgamma(a))
            if x < a + 1:
                term = total = 1 / a
                k = a
                while abs(term) > abs(total) * 1e-15:
                    k += 1
                    term *= x / k
                    total += term
                return max(0.0, 1 - total * scale)
            # a_i = i (a - i), b_i = x + 2 i + 1 - a; numerators and denominators by their recurrence, rescaled
            p0, q0, p1, q1 = 0.0, 1.0, 1.0, x + 1 - a
            value = p1 / q1
            for i in range(1, 100_000):
                c, b = i * (a - i), x + 2 * i + 1 - a
                p0, q0, p1, q1 = p1, q1, b * p1 + c * p0, b * q1 + c * q0
                p0, q0, p1, q1 = p0 / q1, q0 / q1, p1 / q1, 1.0
                if abs(p1 - value) <= 1e-15 * abs(p1):
                    break
                value = p1
            return scale * p1

        out = [None if a != a or k != k or k < 1 else upper(k / 2, a / 2) for a, k in zip(x, df, strict=True)]
        return pd.Series(out, dtype="float64")

    return tail(x, df)


def f_tail(f: Column, df1: Column, df2: Column) -> Column:
    """The chance of an F variable at least as large: the regularised incomplete beta function I(d2 / (d2 + d1 f); d2 / 2,
    d1 / 2), by its continued fraction on the side where that converges fast. For aggregated rows."""

    @F.pandas_udf(DoubleType())
    def tail(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
        import math

        def fraction(a: float, b: float, x: float) -> float:
            # 1 / (1 + e1 / (1 + e2 / ...)), numerators and denominators by their recurrence, rescaled
            p0, q0, p1, q1, value = 0.0, 1.0, 1.0, 1.0, 1.0
            for i in range(1, 1_000_000):
                m = i // 2
                if i % 2:
                    e = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
                else:
                    e = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
                p0, q0, p1, q1 = p1 / q1, q1 / q1, (p1 + e * p0) / q1, (q1 + e * q0) / q1
                if abs(p1 / q1 - value) <= 1e-16 * abs(value):
                    break
                value = p1 / q1
            return p1 / q1

        def beta(a: float, b: float, x: float) -> float:
            if x <= 0 or x >= 1:
                return float(x >= 1)
            front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
            if x < (a + 1) / (a + b + 2):
                return front * fraction(a, b, x) / a
            return 1 - front * fraction(b, a, 1 - x) / b

        def one(f: float, d1: float, d2: float) -> float | None:
            if f != f or d1 != d1 or d2 != d2 or d1 < 1 or d2 < 1:
                return None
            return beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * max(f, 0.0)))

        return pd.Series([one(*x) for x in zip(f, df1, df2, strict=True)], dtype="float64")

    return tail(f.cast("double"), df1.cast("double"), df2.cast("double"))


def digamma(x: Column) -> Column:
    """For x of at least 1: eight steps up by the recurrence, then the asymptotic series."""
    y, back = x + 8, sum((1 / (x + i) for i in range(8)), F.lit(0.0))
    z = 1 / (y * y)
    series = z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z * (1 / 132)))))
    return F.ln(y) - 1 / (2 * y) - series - back


@lru_cache(maxsize=256)
def u_counts(n1: int, n2: int) -> list[int]:
    """In how many of the orders of n1 + n2 different values U is 0, 1, ..., n1 * n2: the coefficients of a Gaussian
    binomial, built up factor by factor."""
    n1, n2 = sorted((n1, n2))
    ways = [1] + [0] * (n1 * n2)
    for i in range(1, n1 + 1):
        for u in range(n1 * n2, n2 + i - 1, -1):
            ways[u] -= ways[u - n2 - i]
        for u in range(i, n1 * n2 + 1):
            ways[u] += ways[u - i]
    return ways


def exact_u(u: Column, n1: Column, n2: Column) -> Column:
    """The chance, without ties, of a U at least as far from n1 * n2 / 2, both sides taken together. For aggregated rows."""

    @F.pandas_udf(DoubleType())
    def tail(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
        def one(u: float, a: float, b: float) -> float | None:
            if u != u or a != a or b != b:
                return None
            ways = u_counts(int(a), int(b))
            upper = sum(ways[int(max(u, a * b - u)) :])
            return min(1.0, 2 * upper / sum(ways))

        return pd.Series([one(*x) for x in zip(u, n1, n2, strict=True)], dtype="float64")

    return tail(u.cast("double"), n1.cast("double"), n2.cast("double"))
